"""Chat formatting with Spark expressions only.

A conversation is one string: adjacent turns of one role share a block, its turns are divided by a part mark.

    <|im_start|>role\\nfirst text<|part|>second text<|im_end|>\\n

Control strings inside texts are escaped reversibly: each backslash is doubled, then ``<|`` becomes ``<\\|``; in roles
a line feed also becomes ``<\\n>``. After doubling, a single backslash between those characters can only be an escape,
so the two steps undo each other. The loss mask lists, per block, the character spans of assistant texts.

Defined results: a null text or role counts as empty; turns are sorted by turn, then role and text (null turns first),
so ties have one order; repeated rows are repeated turns; a null conversation id is a conversation; no rows give none.
The array of a conversation is built in one row, as its output string is one value anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the template
START, END, PART = "<|im_start|>", "<|im_end|>", "<|part|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, formatted, loss): ``loss`` has (block, start, length) in characters, counted from 0 inside the block."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # merge: fold neighbours of one role into blocks of parts. A block is known by its first turn, so no array grows in a loop.
    n = F.size("turns")
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    blocks = F.transform(F.col("first"), lambda f, k: F.struct(
        F.get("turns", f)["role"].alias("role"),
        F.transform(F.slice("turns", f + 1, F.coalesce(F.get("first", k + 1), F.size("turns")) - f), lambda t: escape(t["text"])).alias("parts")))
    head = lambda b: F.concat(F.lit(START), escape_role(b["role"]), F.lit("\n"))
    body = lambda b: F.array_join(b["parts"], PART)
    spans = F.transform(F.col("blocks"), lambda b, k: F.when(b["role"] == loss_role, F.struct(
        k.alias("block"), F.length(head(b)).alias("start"), F.length(body(b)).alias("length"))))
    return (listed.withColumn("first", first).withColumn("blocks", blocks)
            .select("conv_id", F.array_join(F.transform("blocks", lambda b: F.concat(head(b), body(b), F.lit(END + "\n"))), "").alias("formatted"),
                    F.array_compact(spans).alias("loss")))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text) parsed from the output alone: the inverse of ``format_chats``."""
    blocks = F.filter(F.split(F.col("formatted"), "(?=<\\|im_start\\|>)"), lambda b: b != "")
    inner = lambda b: F.substring(b, F.lit(len(START) + 1), F.length(b) - len(START) - len(END) - 1)
    role = lambda b: F.substring_index(inner(b), "\n", 1)
    body = lambda b: F.substring(inner(b), F.length(role(b)) + 2, F.length(b))
    turns = F.flatten(F.transform(F.col("blocks"), lambda b: F.transform(
        F.split(body(b), "<\\|part\\|>", -1), lambda p: F.struct(unescape_role(role(b)).alias("role"), unescape(p).alias("text")))))
    masked = F.transform("loss", lambda s: unescape(F.replace(F.substring(F.get("blocks", s["block"]), s["start"] + 1, s["length"]), F.lit(PART), F.lit(""))))
    return (formatted.withColumn("blocks", blocks)
            .select("conv_id", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"), "formatted"))


def report(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back."""
    back = read_back(formatted)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
