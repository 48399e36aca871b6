"""Chat formatting by native expressions: typed content parts, control marks, a loss mask, and the way back.

A turn's content is an array of parts (type, text, ref, tokens). Text parts are escaped; image, audio and document
parts become an ordered placeholder each, with the attachment's reference, place and expanded token count recorded.
A control string inside a text gets a backslash after its first character, one more if it already had some, so
that no text can close a turn and the escape can be undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's marks, and the control strings of this and other usual templates.
OPEN, CLOSE, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
ESCAPE = r"(<|\[)(\\*)(\||/?s>|/?INST\]|</?SYS>>|/?SYS>>)"
UNESCAPE = r"(<|\[)\\(\\*)(\||/?s>|/?INST\]|</?SYS>>|/?SYS>>)"
#: Tokens that an attachment takes if the part does not say.
EXPANDS = {"image": 256, "audio": 128, "document": 512}
PART = "struct<type:string,text:string,ref:string,tokens:int>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPE, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, UNESCAPE, r"$1$2$3")


def _place(p: Column) -> Column:
    """The text that stands for a part; unknown types count as text."""
    marks = [F.when(p["type"] == t, F.lit(f"<|{t}|>")) for t in EXPANDS]
    return F.coalesce(*marks, escape(F.coalesce(p["text"], F.lit(""))))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conv_id: conv_id, formatted, mask, attachments, n_turns.

    turns: conv_id, turn, role and text, or content as array<struct<type, text, ref, tokens>> (where it is null, the
    text is used). Turns are ordered by turn, then role, then text, nulls first; repeated rows are turns of their
    own. Null text is empty, null role is empty; a null conv_id is a conversation. mask: [start, stop) code points of
    each assistant text in `formatted`. Other columns are not read.
    """
    text_only = F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))
    content = F.coalesce(F.col("content").cast(f"array<{PART}>"), text_only) if "content" in turns.columns else text_only
    order = [F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.col("text")]
    rows = turns.select("conv_id", F.struct(*order, content.alias("content")).alias("row"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    def turn(r):
        head = F.concat(F.lit(OPEN), F.replace(escape(r["role"]), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
        kinds = F.array(*[F.lit(t) for t in EXPANDS])
        files = F.filter(r["content"], lambda p: F.array_contains(kinds, p["type"]))
        return F.struct(head.alias("head"), F.array_join(F.transform(r["content"], _place), "").alias("body"), (r["role"] == "assistant").alias("learn"), files.alias("files"))

    flat = whole.select("conv_id", F.transform("rows", turn).alias("turns"))
    pieces = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def mask(acc, t):
        begin = acc["at"] + F.length(t["head"])
        stop = begin + F.length(t["body"])
        span = F.array(F.struct(begin.alias("start"), stop.alias("stop")))
        return F.struct((stop + len(CLOSE)).alias("at"), F.when(t["learn"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def attachment(p, i):
        n = F.coalesce(p["tokens"], *[F.when(p["type"] == t, F.lit(k)) for t, k in EXPANDS.items()])
        return F.struct((i + 1).alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), n.alias("tokens"))

    files = F.flatten(F.transform("turns", lambda t: t["files"]))
    return flat.select(
        "conv_id",
        F.array_join(pieces, "").alias("formatted"),
        F.aggregate("turns", start, mask, lambda acc: acc["out"]).alias("mask"),
        F.transform(files, attachment).alias("attachments"),
        F.size("turns").cast("long").alias("n_turns"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, array<struct<role, text>>; text parts in their original form.

    Placeholders of attachments stay as they are.
    """
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x, i: i > 0)

    def turn(p):
        role = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(CLOSE))
        return F.struct(unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped part by part, nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["stop"] - m["start"]))), "")


def digest(turns: DataFrame) -> DataFrame:
    """What is read back from the output: turn and loss digests of each conversation."""
    done = format_chats(turns).select("conv_id", "formatted", "attachments", parse(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
