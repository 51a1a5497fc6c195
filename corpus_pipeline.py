"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last one returns
where each document goes. Stages are written as Parquet and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import toxicity
from tickloom.llm.decontaminate import clean
from tickloom.llm.mixing import mix
from tickloom.llm.ngram_join import row_components, sketch_bits
from tickloom.llm.sharding import shard
from tickloom.llm.store import free_name, numbered, sized, small_batches, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 with a model of the confirmed toxic ones among docs."""
    small_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model, threshold=0.5)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies (five-word shingles, similarity 0.8 or more).

    Rows are compared one by one, so of rows that share a doc_id or have none a group keeps one too; a row with an id
    goes before rows without, and of equal ids the first row stays. Texts without words have no copies and stay.
    """
    small_batches(spark)
    row = free_name(docs)
    rows = numbered(docs, row)
    groups = row_components(rows.select(F.col(row).alias("row"), "text", "doc_id"), k=5, num=80, den=100, bits=sketch_bits(docs))
    groups = written(groups.select("row", "component", "doc_id"), "groups")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    copies = written(groups.join(first.select(F.col("first.row").alias("row")), "row", "left_anti").select(F.col("row").alias(row)), "copies")
    return rows.join(sized(copies), row, "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (five-word shingles, four fifths of them or more)."""
    small_batches(spark)
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as the mix draws them, a row for each draw; a draw of less than half a document is none.

    Every row gets its own draws, whether or not it has a doc_id and whoever shares it.
    """
    row = free_name(docs)
    rows = numbered(docs, row)
    drawn = mix(rows, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0, keep=(row,), row=row)
    times = F.size(F.filter("draws", lambda d: 2 * d["words"] >= F.col("size"))).alias(f"{row}_times")
    drawn = written(drawn.select(row, times).where(f"{row}_times > 0"), "times")
    x = rows.join(sized(drawn), row)
    return x.select(*docs.columns, F.explode(F.sequence(F.lit(1), f"{row}_times")).alias(row)).drop(row)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard and slot of every document."""
    return shard(docs, shards=24)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix_sources),
    ("sharding", deal_shards),
]

#: The first stage trains a classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
