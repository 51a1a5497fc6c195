import hashlib
import itertools
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import quality_model, toxicity
from tickloom.llm.chat_format import PARTS, digests, format_chat, parse_chat, text_parts
from tickloom.llm.decontaminate import clean, leaks, make_index, search
from tickloom.llm.graph import components
from tickloom.llm.html_extract import PRIOR, extract, main_text, min_cut, train
from tickloom.llm.mixing import mix, splitting_tree
from tickloom.llm.ngram_join import ngram_components
from tickloom.llm.quality_rules import ablations, apply_policy, ledger
from tickloom.llm.sharding import pack, shard
from tickloom.llm.skew import lookup
from tickloom.llm.warc import url_key, write_archive
from tickloom.llm.words import text_buffers, words

DOCS = "doc_id long, text string, source string, id string, token string, comp string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, s, "x", "y", "z") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(0)
    vocab = [f"w{i}" for i in range(60)]
    out = [" ".join(rng.choice(vocab, rng.integers(1, 60))) for _ in range(60)]
    for i in range(25):  # near and exact copies
        w = out[i].split()
        if i % 3:
            w[int(rng.integers(len(w)))] = "edit"
        out.append(" ".join(w))
    return [*out, None, "", " \n\t ", "Solo", "solo"]


def brute_components(rows, k, num, den):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        both = len(s & t)
        if both and den * both >= num * (len(s) + len(t) - both):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (2, 50)])
def test_components_equal_brute_force(spark, texts, k, num):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = ngram_components(docs(spark, [(i, t, "s") for i, t in rows]), k, num, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, k, num, 100)


def test_long_lists_use_pivots(spark):
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in range(i % 7):
            w[(i * 13 + j * 29) % 120] = f"e{i}_{j}"
        rows.append((i, " ".join(w)))
    got = {r[0]: (r[1], r[2]) for r in ngram_components(docs(spark, [(i, t, "s") for i, t in rows]), 3, 90, 100).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == brute_components(rows, 3, 90, 100)


def test_components_edges(spark):
    assert ngram_components(docs(spark, [])).count() == 0
    got = ngram_components(docs(spark, [(None, "a b c d e f", "s"), (3, "a b c d e f", "s"), (3, "a b c d e f", "s"), (1, None, "s")])).collect()
    assert sorted(str(r["component_id"]) for r in got) == ["1", "3", "3", "3"]


def test_word_hashes_across_blocks():
    long = "ab " * 400_000 + "x" * 1_500_000 + " Ab"
    data, off = text_buffers(pa.array(["a b", None, long, " c"]))
    found = {}
    for i, j, at, (h,), _ in words(data, off, lower=True):
        for r in range(j - i):
            found[i + r] = h[at[r] : at[r + 1]]
    assert [len(found[i]) for i in range(4)] == [2, 0, 400_002, 1]
    assert found[2][0] == found[2][-1] != found[2][-2]


def test_rules_against_plain_python(spark, texts):
    rows = [*texts, "x y z " * 30, "a\na\nb\n\n\na", "### $$$ ok " * 30, "é" * 5 + " ü"]
    got = {r["doc_id"]: r for r in apply_policy(ledger(docs(spark, [(i, t, "s") for i, t in enumerate(rows)])), 2).collect()}
    for i, t in enumerate(rows):
        t = t or ""
        w = WORD.findall(t)
        g = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        cov = {j + d for j in range(len(g)) if g.count(g[j]) > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cov))
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == want
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_ablation_counts(spark, texts):
    book = ledger(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    kept = apply_policy(book, 2).where("kept").count()
    rows = {r["rule"]: r for r in ablations(book, 2).collect()}
    assert rows["few_words"]["kept_without"] == kept + rows["few_words"]["failed_alone"]


def test_mix_is_exact_and_repeatable(spark, texts):
    rows = [(i, t, None if i % 11 == 0 else f"s{i % 4}") for i, t in enumerate(texts * 3)]
    x = docs(spark, rows)
    a, b = ({(r["doc_id"]): r.asDict() for r in mix(x.repartition(n), shards=4).collect()} for n in (1, 5))
    assert {k: v["taken"] for k, v in a.items()} == {k: v["taken"] for k, v in b.items()}
    for s in {r["source"] for r in a.values()}:
        mine = [r for r in a.values() if r["source"] == s]
        assert sum(r["taken"] for r in mine) == int(mine[0]["target"] + 0.5)
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(d["words"] for d in r["draws"]) for r in a.values())
    assert all(0 <= d["shard"] < 4 for r in a.values() for d in r["draws"])
    total = sum(r["size"] for r in a.values())
    assert abs(sum({r["source"]: r["target"] for r in a.values()}.values()) - 1.5 * total) < 1e-6
    assert mix(docs(spark, [])).count() == 0


def test_splitting_tree_is_exact(spark):
    counts = spark.createDataFrame([(0, 7), (1, 0), (2, 9)], "i int, blocks int")
    rows = splitting_tree(counts, 4, 1).collect()
    assert sorted(sum(r["blocks"] for r in rows if r["node"] == n) for n in {r["node"] for r in rows}) == [4, 4, 4, 4]
    assert {i: sum(r["blocks"] for r in rows if r["i"] == i) for i in range(3)} == {0: 7, 1: 0, 2: 9}


def test_leaks_and_clean(spark):
    item = " ".join(f"t{i}" for i in range(30))
    part = " ".join(f"t{i}" for i in range(12))
    noise = " ".join(f"n{i}" for i in range(500))
    d = docs(spark, [(1, f"{noise} {item.upper()} {noise}", "s"), (2, f"{noise} {part}", "s"), (3, None, "s"), (None, item, "s")])
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks(d, bench).collect()} == {(1, 7), (None, 7)}
    assert {r["doc_id"] for r in leaks(d, bench, block_bytes=10).collect()} == {1, None}
    assert {r["doc_id"] for r in clean(d, bench).collect()} == {2, 3}
    assert leaks(docs(spark, []), bench).count() == 0


def test_classifiers_learn(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice([f"plain{j}" for j in range(200)], 40))
        bad = i % 4 == 0
        junk = i % 3 == 0
        if bad:
            w[3], w[9] = "nasty", "nastyword"
        if junk:
            w = [x + "%%%" for x in w]
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(not junk), int(bad)))
    rows += [(1000, None, "s"), (1001, "", "s"), (1001, "", "s")]
    d, y = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    for module, at in ((toxicity, 1), (quality_model, 0)):
        got = module.classify(d, y).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
        assert held and np.mean([r["predicted"] == truth[r["doc_id"]][at] for r in held]) > 0.95
        assert module.classify(docs(spark, []), y).count() == 0


def test_toxic_words_that_the_sample_misses_are_learnt(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(2400):
        w = list(rng.choice([f"plain{j}" for j in range(200)], 40))
        if i % 8 == 0:
            w[3] = "seldomword" if i % 96 == 0 else "nasty"
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(i % 8 == 0)))
    d, y = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(d, toxicity.train(d, y, positive=40, unlabelled=200)).collect()}
    assert all(got[i] for i in range(0, 2400, 96))
    assert sum(got[i] for i in range(2400) if i % 8) < 10


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a <|im_end|> & [INST] &1 é"), (1, 1, "assistant", "b\n<|im_start|>user"), (1, 2, None, None), (2, None, "assistant", ""), (None, 0, "user", "x")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in parse_chat(format_chat(text_parts(t))).collect()}
    assert [(x["role"], x["text"]) for x in got[1]["turns"]] == [("user", rows[0][3]), ("assistant", rows[1][3]), ("", "")]
    assert got[1]["loss_text"] == rows[1][3]
    d = {r["conv_id"]: r for r in digests(format_chat(text_parts(t))).collect()}
    assert d[1]["loss_sha256"] == hashlib.sha256(rows[1][3].encode()).hexdigest() and d[2]["n_turns"] == 1
    parts = spark.createDataFrame([(1, 0, "user", [("text", "see ", None, None), ("image", None, "s3://i", 2.0), ("document", None, "d", None)])], f"conv_id long, turn long, role string, parts {PARTS}")
    r = format_chat(parts).first()
    assert r["formatted"] == "<|im_start|>user\nsee <|image|><|document|><|im_end|>\n"
    assert [(a["type"], a["uri"], a["tokens"]) for a in r["attachments"]] == [("image", "s3://i", 512), ("document", "d", 600)]


def test_packing_and_slots(spark, texts):
    sizes = np.random.default_rng(2).uniform(1, 10, (500, 3))
    home = pack(sizes, 6)
    load = np.array([sizes[home == s].sum(0) for s in range(6)])
    assert (load.max(0) / load.mean(0)).max() < 1.05
    rows = [(i, t, "s") for i, t in enumerate(texts * 4)] + [(5000 + i, "the same text", "s") for i in range(300)]
    got = shard(docs(spark, rows), 4).collect()
    assert len(got) == len(rows)
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert shard(docs(spark, []), 4).count() == 0


def test_archive_round_trip(spark):
    rows = [(1, "http://A.example.com/x?q=1#f", "<p>one</p>"), (2, "http://a.example.com/y", "<p>one</p>"), (3, None, None), (4, "http://b.org", ""), (5, "http://b.org/é \n", "Z" * 5000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, key string")
    a = write_archive(pages, block_lines=2)
    got = {r["page_id"]: r for r in a.read(with_payload=True).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None)}
    assert bytes(got[5]["payload"]) == b"Z" * 5000 and got[1]["payload_bytes"] == 10
    assert [r["page_id"] for r in a.lookup(["http://a.example.com/y", "http://none.example"]).collect()] == [2]
    assert url_key("http://WWW.a.com:80/b?c#d") == "com,a,www:80)/b?c"
    assert write_archive(pages.limit(0)).read().count() == 0
    few = write_archive(pages, min_bytes=1)
    assert {r["page_id"] for r in few.read().where("record_type = 'response'").collect()} == {2, 3, 4, 5}


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>Head &amp; line</h1><p>The first  paragraph of it.<p>Second one, <b>bold</b> and <a href=y>linked</a>.</p>
<script>var t="</p>";</script><form><label>Mail</label><button>Go</button></form></article><aside>More stories</aside>
<section id="comments"><p>I liked this article a lot, thank you very much for writing it, it was good to read this.</p></section><footer>&copy; x</footer>"""


def test_main_text():
    assert main_text(PAGE) == "Head & line The first paragraph of it. Second one, bold and linked."
    assert main_text(None) == main_text("") == ""
    assert main_text("<nav><a>Home</a></nav>") == ""


def test_min_cut_is_minimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = 6
        s, t = rng.uniform(0, 2, n), rng.uniform(0, 2, n)
        edges = [(i, j, float(rng.uniform(0, 1))) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        cost = lambda keep: sum(t[i] if k else s[i] for i, k in enumerate(keep)) + sum(c for i, j, c in edges if keep[i] != keep[j])  # noqa: E731, B023
        best = min(cost(k) for k in itertools.product([False, True], repeat=n))
        assert abs(cost(min_cut(list(s), list(t), edges)) - best) < 1e-6


def test_extract_frame(spark):
    p = spark.createDataFrame([(1, "u", PAGE, 1), (2, None, None, 2)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in extract(p).collect()}
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] == ""


def test_leaks_equal_brute_force_and_reach_the_stated_recall(spark):
    rng = np.random.default_rng(8)
    items = [(None if i == 3 else i, " ".join(f"i{i}w{j}" for j in range(int(rng.integers(5, 90))))) for i in range(60)]
    rows = []
    for d in range(240):
        w = [f"n{x}" for x in rng.integers(0, 5000, int(rng.integers(0, 1500)))]
        for i in rng.integers(0, len(items), 3):
            own = items[i][1].split()
            cut = max(1, int(len(own) * rng.uniform(0.6, 1.0)))
            halves = [own[:cut]] if d % 2 else [own[: cut // 2], own[cut // 2 : cut]]  # in one place, or in two
            for h in halves:
                at = int(rng.integers(0, len(w) + 1))
                w[at:at] = h
        rows.append((d, " ".join(w), "s"))
    gram = lambda t: {tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))}
    sets = [(i, gram(t)) for i, t in items]
    want = {(d, i, len(s), len(s & g)) for d, t, _ in rows for g in [gram(t)] for i, s in sets if 100 * len(s & g) >= 80 * len(s)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(want) > 100 and {tuple(r) for r in leaks(docs(spark, rows), bench).collect()} == want
    assert {r["doc_id"] for r in clean(docs(spark, rows), bench).select("doc_id").collect()} == {d for d, *_ in rows} - {d for d, *_ in want}
    # the signatures decide: with so few functions that one in ten matches may be missed, candidates are missed
    column, found = pa.array([t for _, t, _ in rows]), {}
    for miss in (1e-9, 0.1, 0.5):
        index = make_index(items, 5, 80, 100, miss)
        found[miss] = {(r, index["ids"][i], n, c) for r, i, n, c in search(index, column)}
        assert found[miss] <= want and len(found[miss]) >= (1 - miss) * len(want)
    assert found[1e-9] == want and found[0.5] < want


def test_mix_takes_what_the_shards_draw(spark, texts):
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts * 3)]
    got = mix(docs(spark, rows), shards=8).collect()
    # the tree, place by place
    blocks, per = {}, {}
    for r in got:
        h = hashlib.md5(f"17:{r['doc_id']}".encode()).hexdigest()
        blocks.setdefault((r["source"], h[:2]), []).append((h, r["doc_id"], r["size"]))
    drawn = set()
    for i, s in enumerate(sorted({r["source"] for r in got})):
        r = next(r for r in got if r["source"] == s)
        full, rest = divmod(int(r["target"] + 0.5), r["source_size"])
        before, places = 0, []
        for (_, b), members in sorted((k, v) for k, v in blocks.items() if k[0] == s):
            places += [(hashlib.md5(f"17:={s}:{p}:{b}".encode()).hexdigest(), p, b) for p in range(full + (before < rest))]
            before += sum(x[2] for x in members)
        per[i] = (s, sorted(places))
    node = [(1, i, j + 1) for i, (_, p) in per.items() for j in range(len(p))]
    for _ in range(3):
        nxt = []
        for n in sorted({x[0] for x in node}):
            here = sorted((hashlib.md5(f"17:{n}:{i}:{j}".encode()).hexdigest(), i, j) for m, i, j in node if m == n)
            nxt += [(2 * n + (k >= len(here) // 2), i, j) for k, (_, i, j) in enumerate(here)]
        node = nxt
    for i, (s, places) in per.items():
        at = 0
        for n in range(8, 16):
            k = sum(x[0] == n and x[1] == i for x in node)
            drawn |= {(s, b, p, n - 8) for _, p, b in places[at : at + k]}
            at += k
    seen = {(r["source"], hashlib.md5(f"17:{r['doc_id']}".encode()).hexdigest()[:2], d["pass"], d["shard"]) for r in got for d in r["draws"]}
    assert seen <= drawn and len({x[:3] for x in drawn}) == len(drawn)
    for s in {r["source"] for r in got}:
        assert sum(r["taken"] for r in got if r["source"] == s) == int(next(r["target"] for r in got if r["source"] == s) + 0.5)


def test_components_of_chains_hubs_and_large_groups(spark):
    chain = [(i, i + 1) for i in range(100, 109)]
    hub = [(5, i) for i in range(1000, 1400)]
    got = {r["id"]: r["comp"] for r in components(spark.range(2000).select("id", F.col("id").alias("comp")), spark.createDataFrame([*chain, *hub, (7, 7)], "a long, b long")).collect()}
    assert all(got[i] == (100 if 100 <= i <= 109 else 5 if 1000 <= i < 1400 else i) for i in range(2000))
    rows = spark.range(5000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 > 0, F.lit(1)).when(F.col("id") % 9 == 0, F.col("id")).alias("k"))
    small = rows.groupBy("k").agg(F.count("*").alias("c"), F.max("row").alias("v")).where("k is not null")
    got = lookup(rows, small, ["k"], 5000, F.col("row")).collect()
    assert len(got) == 5000 and all(r["v"] == (None if r["k"] is None else 4999 if r["k"] == 1 else r["k"]) for r in got)


def test_extraction_probes():
    p = "<p>Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma.</p>"
    text = p[3:-4]
    for name in ("has-sidebar", "no-ads", "layout side-by-side", "content with-comments", "print", "sidebar-layout"):
        assert main_text(f'<body class="{name}"><nav><a href=x>Home</a></nav><div class="{name}"><article>{p}</article></div><footer>x</footer>') == text
        assert main_text(f'<body><nav><a href=x>Home</a></nav><div class="{name}">{p}</div><footer>x</footer>') == text
    assert main_text(f"<nav><a href=x>Home</a></nav><form id=page><main>{p}</main></form><div id='comments'>{p * 4}</div>") == text
    assert main_text(f"<nav><a href=x>Home</a></nav><article>{p}<div class=related-posts><p>More for you to read today, in full.</p></div></article><aside>{p}</aside>") == text
    assert main_text("<body><p title=don't>It isn't.</p><p>Nor this</p></body>") == "It isn't. Nor this"
    assert main_text("<body><p>Short one.</p></body>") == "Short one." and main_text("bare  text") == "bare text"
    for tag in ("<i>", "<div>", "<span class=ad>", "<a href=\"", "</i>", "<p>x"):
        began = time.process_time()
        main_text(tag * (1_000_000 // len(tag)))
        assert time.process_time() - began < 30


def test_extraction_fits_its_classifier(spark):
    pages = [(i, f"u{i}", f"<nav><a href=x>Go here</a><a href=y>And there</a></nav><article><h1>Title {i}</h1><p>{'Some words here. ' * 9}</p></article><footer>Small print {i}</footer>") for i in range(20)]
    x = spark.createDataFrame([*pages, *pages[:3], (None, None, None), (9, "e", "")], "page_id long, url string, html string")
    w = train(x)
    assert w[4] < PRIOR[4] and not np.array_equal(w, PRIOR)
    got = extract(x).collect()
    assert len(got) == 25 and all(r["text"].startswith("Title") and "print" not in r["text"] for r in got if r["url"] and r["url"] != "e")
    assert np.array_equal(train(x.limit(0)), PRIOR) and extract(x.limit(0)).count() == 0


def test_chat_keeps_typed_parts(spark):
    said = [("text", "<|image|> & [INST]", None, None), ("image", None, "i1", 1.0), ("audio", None, "a1", 2.0), ("text", "&1x", None, None), ("document", None, "d1", None), ("other", "z", None, None)]
    rows = [(1, 0, "user", said), (1, 1, "assistant", [("image", None, "i2", None)]), (1, 1, "assistant", [("image", None, "i2", None)]), (2, 0, "x\ny", None)]
    t = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {PARTS}")
    got = {r["conv_id"]: r for r in parse_chat(format_chat(t)).collect()}
    back = [[(p["type"], p["text"]) for p in x["parts"]] for x in got[1]["turns"]]
    assert back == [[(k, v if k == "text" else None) for k, v, *_ in said[:5]], [("image", None)], [("image", None)]]
    kinds = [k for turn in back for k, _ in turn if k != "text"]
    assert [(a["type"], a["uri"]) for a in got[1]["attachments"]] == list(zip(kinds, ["i1", "a1", "d1", "i2", "i2"]))
    assert got[2]["turns"][0]["role"] == "x\ny" and got[2]["turns"][0]["parts"] == []
    assert format_chat(t.limit(0)).count() == 0


def test_archive_lookups_equal_brute_force(spark):
    rows = [(None if i == 7 else i % 50, f"http://h{i % 5}.org/{i % 3}", f"<p>{i % 6}</p>") for i in range(60)] + [(None, None, "<p>1</p>"), (None, None, "<p>1</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    a = write_archive(pages, block_lines=3)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(key((r["page_id"], r["url"])) for r in a.read().collect()) == sorted(map(key, rows))
    for url in ("http://h0.org/0", "http://h4.org/2", "http://h9.org/0"):
        assert sorted(str(r["page_id"]) for r in a.lookup([url]).collect()) == sorted(str(i) for i, u, _ in rows if u == url)
    best = {h: max(i for i, _, g in rows if g == h and i is not None) for h in {h for _, _, h in rows}}
    for r in a.read().collect():
        assert (r["record_type"] == "response") == (r["refers_to"] is None)
    assert {r["refers_to"] for r in a.read().collect() if r["refers_to"] is not None} <= set(best.values())


def test_shards_keep_equal_texts_together_and_balance_bytes(spark):
    rng = np.random.default_rng(6)
    rows = [(None if i % 40 == 0 else i % 700, " ".join(["word"] * int(rng.integers(0, 60))) + f" {i % 500}", "s") for i in range(900)] + [(i, None, "s") for i in range(5)]
    got = shard(docs(spark, rows), 4).collect()
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    homes = {}
    for r in got:
        homes.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())
    load = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]
    assert max(load) < 1.03 * sum(load) / 4
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
