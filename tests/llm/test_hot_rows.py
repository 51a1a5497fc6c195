"""Rows without ids or with a shared one, short benchmark items, slugs of headings and unclosed elements."""

import time
from collections import Counter

import numpy as np
import pytest

from tickloom.llm.decontaminate import clean, functions, leaks, make_index, search
from tickloom.llm.html_extract import main_text
from tickloom.llm.mixing import mix
from tickloom.llm.sharding import shard

DOCS = "doc_id long, text string, source string, row long, cell string, again boolean"


def some_ids(kind, i):
    return {"none": None, "one": 7, "own": i}[kind]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", True) for r in rows], DOCS)


@pytest.mark.parametrize("kind", ["none", "one", "own"])
def test_half_of_the_rows_are_one_text(spark, kind):
    rng = np.random.default_rng(0)
    big = "long text " * 400
    rows = [(some_ids(kind, i) if i % 2 == 0 else i, big if i % 2 == 0 else f"t{i} " * int(rng.integers(5, 400)), "s") for i in range(2400)] + [(9999, "very long " * 20_000, "s")]
    got = shard(frame(spark, rows), 24).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len(t) + 8) for i, t, _ in rows)
    size, count = Counter(), Counter()
    for r in got:
        size[r["shard"]] += r["size"]
        count[r["shard"]] += 1
    assert max(size.values()) < 1.1 * sum(size.values()) / 24 and max(count.values()) < 1.2 * len(rows) / 24
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(count[s]))


@pytest.mark.parametrize("kind", ["none", "one", "own"])
def test_rows_without_own_ids_are_many_cells(spark, kind):
    rows = [(some_ids(kind, i), "word " * (1 + i % 9), "s0" if i % 3 else "s1") for i in range(3000)] + [(None, "long " * 200_000, "s2")]
    x = frame(spark, rows)
    got = mix(x, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0, keep=("row",)).collect()
    assert len(got) == len(rows) and Counter(str(r["doc_id"]) for r in got) == Counter(str(i) for i, *_ in rows)
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
    again = mix(x, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0, keep=("row",)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    orders = {d["order"][:2] for r in got if r["source"] == "s0" for d in r["draws"]}
    assert len(orders) > 100  # not one cell


def test_short_items_are_found_inside_long_texts(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, n)) for n in (1, 2, 3, 4, 7, 60, 5000)]
    items = [(1, "Zebra"), (2, "red Zebra runs"), (3, "w1"), (4, "w1 w2"), (5, "a b c d"), (6, "a b c d"), (7, " ".join(f"q{i}" for i in range(20)))]
    docs = [(i, t, "s") for i, t in enumerate(texts)] + [(100, texts[5] + " red zebra\nRUNS " + texts[6], "s"), (101, "x a b c d", "s"), (102, "a b c", "s"), (103, items[6][1] + " w1", "s"), (104, None, "s"), (105, "zebra", "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks(frame(spark, docs), bench, 5, 80, 100).collect()}

    def holds(text, item):
        a, b = (text or "").lower().split(), item.lower().split()
        runs = {tuple(a[i : i + 5]) for i in range(len(a) - 4)}
        if len(b) < 5:
            return any(a[i : i + len(b)] == b for i in range(len(a) - len(b) + 1))
        own = {tuple(b[i : i + 5]) for i in range(len(b) - 4)}
        return len(own & runs) >= 0.8 * len(own)

    assert got == {(d, i) for d, t, _ in docs for i, u in items if holds(t, u)}
    assert {r["doc_id"] for r in clean(frame(spark, docs), bench, 5, 80, 100).collect()} == {d for d, *_ in docs} - {d for d, _ in got}


def test_low_thresholds_take_as_many_functions_as_they_need():
    import pyarrow as pa

    assert functions(30, 15, 5, 100) > 256
    rng = np.random.default_rng(2)
    items = [(k, " ".join(f"i{k}_{j}" for j in range(34))) for k in range(200)]
    index = make_index(items, 5, 5, 100)
    texts = [" ".join([*(f"v{x}" for x in rng.integers(0, 10**6, 400)), *(f"i{k}_{j}" for j in range(3, 9)), *(f"v{x}" for x in rng.integers(0, 10**6, 400))]) for k in range(200)]
    assert {(r, i) for r, i, *_ in search(index, pa.array(texts))} == {(k, k) for k in range(200)}


P = "<p>This is a paragraph of the article with more than eight words in it, and it ends here.</p>"


@pytest.mark.parametrize("slug", ["related-work", "share-prices", "search-algorithms", "form-of-government", "comments-on-the-law", "method"])
def test_sections_with_slugs_stay(slug):
    t = main_text(f"<body><nav><a href=x>Home</a></nav><article><h1>Title</h1>{P}<section id='{slug}'><h2>Heading here</h2>{P}{P}</section></article><footer>Copyright</footer>")
    assert t.count("paragraph") == 3 and "Heading here" in t and "Home" not in t and "Copyright" not in t
    t = main_text(f"<body><nav><a href=x>Home</a></nav><article><h2 id='{slug}'>Leading one</h2>{P}{P}</article><footer>Copyright</footer>")
    assert t.startswith("Leading one")


def test_parts_of_the_page_inside_the_article_go():
    talk = "<p>Nice post, I really liked reading this one a lot, thanks to all.</p>"
    links = "<ul>" + "".join(f"<li><a href=x>Another story of the day number {i} with a long title</a></li>" for i in range(5)) + "</ul>"
    parts = f"<div id='comments'>{talk}</div><div id='comments-section'>{talk}</div><div id='comment-list'>{talk}</div><section id='related-work'>{links}</section><div class='related-posts'>{links}</div><div id='sidebar-left'>{talk}</div>"
    t = main_text(f"<body><article><h1>Title</h1>{P}{P}{parts}</article><footer>Copyright</footer>")
    assert "Nice post" not in t and "Another story" not in t and t.count("paragraph") == 2


@pytest.mark.parametrize("tag", ["svg", "noscript", "select", "math", "object", "canvas"])
def test_unclosed_elements_take_linear_time(tag):
    began = time.time()
    assert "a b c" in main_text("<p>a b c</p>" + f"<{tag}>x" * (1_000_000 // (len(tag) + 3)))
    assert time.time() - began < 5


def test_a_very_long_valid_page():
    t = main_text(f"<body><nav><a href=x>Home</a></nav><article><h1>Title</h1>{P * 20_000}</article><footer>Copyright</footer>")
    assert t.count("paragraph") == 20_000
