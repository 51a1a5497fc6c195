r"""Conversations as training strings with typed content parts and a loss mask.

A turn is an ordered array of parts: text, image, audio or document. Text is escaped, other parts become
placeholders; what they refer to and how many tokens they expand to is recorded in the same order. A turn
reads <|im_start|>role\nbody<|im_end|>\n. Inside roles and texts "&", "<" and "[" are written as & and a
digit, so no text can hold a control string of this or of an [INST] template, and the writing is reversible:
a placeholder is the only "<" that stands in a body as it is, so parts are told apart before texts are unescaped.
Built-in expressions only; one shuffle by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
CODES = {"&": "&0", "<": "&1", "[": "&2", "\n": "&3"}
PARTS = "array<struct<type:string,text:string,uri:string,units:double>>"
#: Tokens for a unit of each kind: an image's tile, a second of audio, a page of a document.
TOKENS = {"image": 256, "audio": 25, "document": 600}


def escape(c: Column, codes: str = "&<[") -> Column:
    for x in codes:
        c = F.replace(c, F.lit(x), F.lit(CODES[x]))
    return c


def unescape(c: Column) -> Column:
    for x in reversed(CODES):
        c = F.replace(c, F.lit(CODES[x]), F.lit(x))
    return c


def text_parts(turns: DataFrame, text: str = "text") -> DataFrame:
    """Turns with a text column as turns with one text part; null is empty."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("double").alias("units"))
    return turns.select("conv_id", "turn", "role", F.array(part).cast(PARTS).alias("parts"))


def _visit(p: Column) -> Column:
    out = F.when(p["type"] == "text", escape(F.coalesce(p["text"], F.lit(""))))
    for kind in TOKENS:
        out = out.when(p["type"] == kind, F.lit(f"<|{kind}|>"))
    return out.otherwise(F.lit(""))


def _tokens(p: Column) -> Column:
    out = F.lit(0)
    for kind, rate in TOKENS.items():
        out = F.when(p["type"] == kind, F.ceil(F.coalesce(p["units"], F.lit(1.0)) * rate)).otherwise(out)
    return out.cast("long")


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans and attachments of each conversation.

    turns: conv_id, turn, role, parts (see PARTS). Turns go by turn, null last; equal turns by role, then
    text, and repeated rows are kept. A null role is empty; null parts and parts of unknown type add nothing.
    Rows without conv_id form one conversation. loss_spans: (start, length) in code points of the bodies of
    loss_role; attachments: (turn, type, uri, tokens) in the order of the placeholders.
    """
    parts = F.coalesce("parts", F.array().cast(PARTS))
    x = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    x = x.select(
        "conv_id", "turn", "role",
        F.array_join(F.transform("parts", _visit), "").alias("body"),
        F.transform(F.filter("parts", lambda p: p["type"].isin(*TOKENS)), lambda p: F.struct(F.col("turn").alias("turn"), p["type"].alias("type"), p["uri"].alias("uri"), _tokens(p).alias("tokens"))).alias("att"),
    )
    head = F.concat(F.lit(START), escape(F.col("role"), "&<[\n"), F.lit("\n"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "body")
    x = x.select("*", head.alias("head"), F.row_number().over(w).alias("seq"))
    size = F.length("head") + F.length("body") + len(END)
    x = x.select("*", (F.sum(size.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - len(END) - F.length("body")).alias("start"))
    x = x.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "head", "body", "start", (F.col("role") == loss_role).alias("loss"), "att"))).alias("t"))
    return x.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.transform(F.filter("t", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), F.length(t["body"]).cast("long").alias("length"))).alias("loss_spans"),
        F.flatten(F.transform("t", lambda t: t["att"])).alias("attachments"),
    )


def parse_chat(chats: DataFrame) -> DataFrame:
    """Adds `turns` (role, text, parts) and `loss_text`, read back from formatted and loss_spans alone.

    parts: (type, text) in order, text being null for other types than text; empty texts leave no part. The nth part of
    another type in a conversation is the nth of `attachments`. `text` joins a turn's parts, placeholders included.
    """
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")
    kinds = "|".join(TOKENS)

    def part(p: Column) -> Column:
        kind = F.regexp_extract(p, rf"^<\|({kinds})\|>$", 1)
        return F.struct(F.when(kind == "", "text").otherwise(kind).alias("type"), F.when(kind == "", unescape(p)).alias("text"))

    def turn(p: Column) -> Column:
        rest = F.substring(p, len(START) + 1, 1 << 30)
        role = F.substring_index(rest, "\n", 1)
        body = F.substr(rest, F.length(role) + 2)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"), F.transform(F.filter(F.split(body, rf"(?=<\|)|(?<=<\|(?:{kinds})\|>)"), lambda x: x != ""), part).alias("parts"))

    loss = F.transform("loss_spans", lambda s: F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return chats.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", unescape(F.array_join(loss, "")))


def digests(chats: DataFrame) -> DataFrame:
    """Counts and digests of what parse_chat reads back."""
    x = parse_chat(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return x.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
    )
