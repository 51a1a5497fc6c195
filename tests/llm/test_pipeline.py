from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tickloom.llm.mixing import mix
from tickloom.llm.store import BATCH_BYTES, small_batches

ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = np.random.default_rng(0)
    vocab = [f"v{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(300):
        w = list(rng.choice(vocab, 60))
        if i % 5 == 0:
            w[1], w[2], w[3] = "nasty", "nastier", "nasty"
            labels.append((i, 1, 1))
        else:
            labels.append((i, 1, 0))
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 1))
    rows += [(1000 + i, rows[i][1], "en", "s0", 1) for i in range(1, 5)]
    bench = [(0, " ".join(rng.choice(vocab, 30)))]
    rows.append((2000, rows[7][1] + " " + bench[0][1], "en", "s1", 1))
    rows += [(3000, None, None, None, None), (None, "loose words", "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = [r["doc_id"] for r in docs.collect()]
    assert not {i for i in range(0, 300, 5)} & set(kept["toxicity"])
    assert len(kept["toxicity"]) >= 0.97 * (len(rows) - 60)
    assert set(kept["toxicity"]) - set(kept["ngram_jaccard_join"]) == {1001, 1002, 1003, 1004}
    assert set(kept["ngram_jaccard_join"]) - set(kept["benchmark_decontamination"]) == {2000}
    assert max(kept["source_mixing"].count(i) for i in set(kept["source_mixing"])) <= 2
    assert sorted(map(str, kept["sharding"])) == sorted(map(str, kept["source_mixing"]))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_mix_draws_rows_without_or_with_shared_ids(spark, tmp_path):
    rows = [(None if i % 3 == 0 else i // 2, f"text {i} " * (5 + i % 4), "en", f"s{i % 4}", i) for i in range(240)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(r["n_chars"] for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect())
    drawn = mix(docs, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0, keep=("n_chars",)).collect()
    want = {r["n_chars"]: sum(2 * d["words"] >= r["size"] for d in r["draws"]) for r in drawn}
    assert got == {k: n for k, n in want.items() if n}
    assert any(got[i] for i in range(0, 240, 3)) and 0 in want.values()


def test_one_of_each_row_whatever_its_id(spark, tmp_path):
    rng = np.random.default_rng(5)
    a, b, c, d, e = (" ".join(rng.choice([f"v{i}" for i in range(400)], 40)) for _ in range(5))
    # repeated rows; equal texts without id; an id that a copy and an only text share; a copy that has an id
    texts = [(5, a), (5, a), (None, b), (None, b), (None, b), (1, c), (7, c), (7, d), (None, e), (9, e), (None, None), (None, ""), (3, ""), (3, "")]
    spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each(spark, docs, str(tmp_path)).collect()]
    assert Counter(got) == Counter([(5, a), (None, b), (1, c), (7, d), (9, e), (None, None), (None, ""), (3, ""), (3, "")])


def test_stages_on_empty_tables_and_clashing_names(spark, tmp_path):
    """Every stage keeps the columns of documents, extra ones named like its own included, and takes empty tables and nulls."""
    extra = DOCS + ", row long, _row long, comp string, times int, rep long, x string"
    rows = [(1, "a b c d e f g", "en", "s", 7, 1, 1, "c", 1, 1, "x"), (None, None, None, None, None, 1, 1, "c", 1, 1, "x"), (1, "", None, None, 0, 1, 1, "c", 1, 1, "x"), (2, "long " * 60_000, "en", "s", 7, 1, 1, "c", 1, 1, "x")]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, some in (("empty", []), ("few", rows)):
        spark.createDataFrame(some, extra).write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        for stage, run in corpus_pipeline.STAGES:
            got = run(spark, docs, str(tmp_path))
            assert stage == "sharding" or got.columns == docs.columns
            kept = got.count()
            assert kept == len(some) or stage == "source_mixing" and kept >= len(some) - 2, (name, stage)


def test_stages_hand_texts_to_python_in_small_batches(spark, tmp_path):
    """However many rows a table has, a task and its Python worker hold little of it at once; a session's own setting stays."""
    rows = [(i, f"w{i} " * 400, "en", "s", i) for i in range(3000)]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "some item of five words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["bytes"])

    def most(session):
        texts = session.read.parquet(f"{tmp_path}/documents.parquet").select("text")
        return max(r["bytes"] for r in texts.mapInArrow(sizes, "bytes long").collect())

    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.one_of_each, corpus_pipeline.drop_leaks):
        session = spark.newSession()
        session.conf.unset(ARROW)
        stage(session, session.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        assert most(session) < 2 * BATCH_BYTES
    session = spark.newSession()
    session.conf.set(ARROW, str(3 * BATCH_BYTES))
    small_batches(session)
    assert session.conf.get(ARROW) == str(3 * BATCH_BYTES)
