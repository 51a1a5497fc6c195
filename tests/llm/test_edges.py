"""Very long texts, empty tables and nulls for the operators whose own tests have none."""

import pytest

from tickloom.llm import quality_model, toxicity
from tickloom.llm.chat_format import digests, format_chat, text_parts
from tickloom.llm.quality_rules import apply_policy, ledger
from tickloom.llm.warc import write_archive

DOCS = "doc_id long, text string, source string, bits long, f binary"
LONG = "word and more " * 150_000


def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, b"x") for r in rows], DOCS)


def test_rules_on_a_very_long_text_and_an_empty_table(spark):
    got = {r["doc_id"]: r for r in apply_policy(ledger(docs(spark, [(1, LONG), (2, None), (2, ""), (None, "a b c")])), version=2).collect()}
    assert got[1]["n_words"] == 450_000 and got[1]["n_repeat_words"] == 450_000 and got[1]["base_failed"] and not got[1]["kept"]
    assert got[2]["n_words"] == 0 and got[None]["n_words"] == 3
    assert apply_policy(ledger(docs(spark, [])), version=2).collect() == []


@pytest.mark.parametrize("operator", [toxicity, quality_model])
def test_classifiers_on_a_very_long_text_and_empty_tables(spark, operator):
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = [(i, f"plain text number {i} " * 5 + ("nasty nastier " * 4 if i % 3 == 0 else "")) for i in range(40)] + [(100, LONG), (101, None), (101, ""), (None, "nasty")]
    got = operator.classify(docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert operator.classify(docs(spark, []), labels).collect() == []
    none = operator.classify(docs(spark, rows[:3]), labels.limit(0)).collect()
    assert len(none) == 3 and all(0 <= r["score"] <= 1 for r in none)


def test_chats_with_very_long_turns_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", LONG + "</s>[INST]"), (2, 0, "assistant", None), (None, None, None, "x")]
    got = {r["conv_id"]: r for r in digests(format_chat(text_parts(spark.createDataFrame(rows, schema)))).collect()}
    assert got[1]["n_turns"] == 2 and got[1]["loss_chars"] == len(LONG) + 10 and got[2]["loss_chars"] == 0 and got[None]["n_turns"] == 1
    assert digests(format_chat(text_parts(spark.createDataFrame([], schema)))).collect() == []


def test_archive_with_very_long_pages_and_an_empty_table(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, "http://a.org/1", "<p>" + LONG), (2, "http://a.org/2", "<p>" + LONG), (3, None, None), (4, "http://a.org/3", "")]
    got = {r["page_id"]: r for r in write_archive(spark.createDataFrame(rows, schema), min_bytes=0).read().collect()}
    assert got[1]["payload_bytes"] == len(LONG) + 3 and got[1]["refers_to"] == 2 and got[2]["record_type"] == "response"
    assert got[3]["payload_bytes"] == 0 and got[3]["refers_to"] == 4
    assert write_archive(spark.createDataFrame([], schema), min_bytes=0).read().collect() == []
