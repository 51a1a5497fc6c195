"""Quality rules as a ledger of failure bits, and policies over it.

Each rule is evaluated once per text. The ledger keeps the measurements and one bit per failed rule, so a
policy is a mask: changing policy, comparing policies and asking what a rule costs read the ledger and never
the texts. Everything is built-in expressions, a single projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]+"
#: Rule, in the order of its bit, and the SQL condition under which a text fails it.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_words": "n_words > 1000000",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 60 * n_lines",
    "exclamations": "5 * n_bangs > n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Versions never change once they are published; a new rule set gets a new version.
POLICIES: dict[int, int] = {
    1: BASE | BIT["many_words"] | BIT["symbols"],
    2: sum(BIT.values()),
}


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each whole text; null counts as empty.

    n_words: words [^\\x20\\x09-\\x0D]+; word_chars: code points in them; n_symbols: characters of #*$%&|<>;
    n_bangs: exclamation marks; n_lines: lines with a word; n_dup_lines: those equal to an earlier one;
    n_repeat_words: words inside a 3-word window that the text holds twice or more. Windows are compared by
    a 64-bit hash within one text. Their positions are sorted once, and gaps between the positions of
    repeated windows give the number of covered words, so the cost stays n log n in a long text.
    """
    x = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    x = x.select(
        "doc_id",
        F.array_remove(F.split("t", WS), "").alias("w"),
        F.expr(r"filter(split(t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.regexp_replace("t", "!", ""))).cast("long").alias("n_bangs"),
    )
    x = x.select(
        "doc_id", "n_symbols", "n_bangs",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("slice(transform(w, (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2))), 1, greatest(size(w) - 2, 0))").alias("g"),
    )
    keep = ["doc_id", "n_words", "word_chars", "n_symbols", "n_bangs", "n_lines", "n_dup_lines"]
    x = x.select(*keep, F.expr("CASE WHEN size(array_distinct(g)) < size(g) THEN sort_array(transform(g, (h, i) -> struct(h, i))) END").alias("s"))
    x = x.select(*keep, F.expr("sort_array(transform(filter(s, (x, j) -> coalesce(x.h = get(s, j - 1).h, false) OR coalesce(x.h = get(s, j + 1).h, false)), x -> x.i))").alias("p"))
    covered = F.expr("coalesce(aggregate(transform(p, (x, j) -> least(3, x - coalesce(get(p, j - 1), x - 3))), 0L, (a, b) -> a + b), 0L)")
    return x.select(*keep, covered.alias("n_repeat_words"))


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and `bits`, the failed rules. An empty table gives an empty ledger; repeated rows stay."""
    bits = " | ".join(f"CASE WHEN {rule} THEN {BIT[name]}L ELSE 0L END" for name, rule in RULES.items())
    return measure(docs).withColumn("bits", F.expr(bits))


def apply_policy(book: DataFrame, version: int) -> DataFrame:
    """The ledger with `base_failed` and `kept` under a policy; a base failure always rejects."""
    mask = POLICIES[version] | BASE
    return book.withColumn("base_failed", F.col("bits").bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", F.col("bits").bitwiseAND(F.lit(mask)) == 0)


def ablations(book: DataFrame, version: int) -> DataFrame:
    """Per rule of a policy: texts that fail it, that fail it alone, and that the policy without it keeps.

    One grouped count over the distinct bit patterns, at most 2 ** len(RULES) rows, feeds all rules.
    """
    mask = POLICIES[version] | BASE
    patterns = book.groupBy(F.col("bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items() if bit & mask)))
    x = patterns.select("*", rules.alias("r")).select("bits", "n", "r.*")
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).alias
    return x.groupBy("rule").agg(
        n(F.col("bits").bitwiseAND(F.col("bit")) != 0)("failed"),
        n(F.col("bits") == F.col("bit"))("failed_alone"),
        n(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0)("kept_without"),
        F.bit_or("bits").alias("seen_bits"),
    )
