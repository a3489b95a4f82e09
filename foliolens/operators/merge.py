"""Three-way merge of JSON trees as tables of leaves, and its checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import skew
from ..functions.common import first_reason


def _is_open(v: Column) -> Column:
    text = F.to_json(v)
    return (F.startswith(text, F.lit("{")) | F.startswith(text, F.lit("["))) & ~text.isin("{}", "[]")


def json_depth(text: Column) -> Column:
    """How deep the containers of a JSON text nest, strings aside."""
    marks = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    state = "struct<now:int,most:int>"
    begin = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")).cast(state)

    def step(acc: Column, c: Column) -> Column:
        now = F.when(c.isin("{", "["), acc["now"] + 1).otherwise(acc["now"] - 1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most")).cast(state)

    return F.aggregate(F.filter(F.split(marks, ""), lambda c: c != ""), begin, step)["most"]


def to_leaves(df: DataFrame, json_column: str, levels: int | None = None) -> DataFrame:
    """JSON text to (pointer, value) leaves; empty objects and arrays are leaves, ``~`` and ``/`` are escaped.

    Every level opens the containers that are left, in one narrow pass. When
    ``levels`` is not given, it is the deepest nesting of any text, from one aggregate.
    ``kinds`` records the container kind of each step (O object, A array).
    """
    spark = df.sparkSession
    keep = [c for c in df.columns if c != json_column]
    work = df.select(*keep, F.lit("").alias("pointer"), F.lit("").alias("kinds"), F.parse_json(json_column).alias("v"))
    if levels is None:
        levels = df.agg(F.max(json_depth(F.col(json_column))).alias("d")).first()["d"] or 0
    for _ in range(levels):
        marked = work.withColumn("_open", F.when(_is_open(F.col("v")), F.col("v"))).withColumn(
            "_kind", F.when(F.col("_open").isNotNull(), F.when(F.startswith(F.to_json("v"), F.lit("{")), "O").otherwise("A")))
        opened = spark.sql("SELECT d.*, t.pos AS _pos, t.key AS _key, t.value AS _value FROM {d} d, "
                           "LATERAL variant_explode_outer(d._open) AS t", d=marked)
        step = F.coalesce(F.replace(F.replace("_key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.col("_pos").cast("string"))
        inner = F.col("_kind").isNotNull()
        step = F.when(F.col("_kind") == "A", F.col("_pos").cast("string")).otherwise(step)
        work = opened.select(*keep, F.when(inner, F.concat("pointer", F.lit("/"), step)).otherwise(F.col("pointer")).alias("pointer"),
                             F.when(inner, F.concat("kinds", "_kind")).otherwise(F.col("kinds")).alias("kinds"),
                             F.when(inner, F.col("_value")).otherwise(F.col("v")).alias("v"))
    return work.select(*keep, "pointer", "kinds", F.to_json("v").alias("value"))


def array_sizes(leaves: DataFrame) -> DataFrame:
    """Length of every array, from its leaves: the largest index below it plus one, or zero when empty."""
    steps = F.split("pointer", "/")
    filled = leaves.where(F.contains("kinds", F.lit("A"))).select("doc_id", "kinds", steps.alias("steps"), F.explode(
        F.filter(F.sequence(F.lit(1), F.length("kinds")), lambda i: F.substring("kinds", i, F.lit(1)) == "A")).alias("i")).select(
        "doc_id", F.array_join(F.slice("steps", F.lit(1), F.col("i")), "/").alias("pointer"), F.substring("kinds", F.lit(1), F.col("i")).alias("path_kinds"),
        F.element_at("steps", F.col("i") + 1).cast("int").alias("index"))
    empty = leaves.where(F.col("value") == "[]").select("doc_id", "pointer", F.concat("kinds", F.lit("A")).alias("path_kinds"), F.lit(-1).alias("index"))
    return filled.unionByName(empty).groupBy("doc_id", "pointer", "path_kinds").agg((F.max("index") + 1).alias("size"))


def leaf_diff(base: DataFrame, other: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Added, removed and changed leaves; a missing leaf differs from a null one."""
    keys = keys or ["doc_id"]
    a = base.select(*keys, "pointer", F.col("value").alias("base_value"), F.lit(True).alias("in_base"))
    b = other.select(*keys, "pointer", F.col("value").alias("value"), F.lit(True).alias("in_other"))
    return a.join(b, [*keys, "pointer"], "full_outer").select(*keys, "pointer", first_reason(
        (F.col("in_base").isNull(), "added"), (F.col("in_other").isNull(), "removed"),
        (~F.col("base_value").eqNullSafe(F.col("value")), "changed")).alias("change"), "base_value", "value").where(F.col("change").isNotNull())


def shape_changes(base: DataFrame, other: DataFrame) -> DataFrame:
    """Arrays at one place in both trees whose lengths differ."""
    keys = ["doc_id", "pointer", "path_kinds"]
    return array_sizes(base).withColumnRenamed("size", "base_size").join(
        array_sizes(other).withColumnRenamed("size", "other_size"), keys).where("base_size <> other_size").select(
        "doc_id", F.when(F.col("pointer") == "", "/").otherwise(F.col("pointer")).alias("pointer"), "base_size", "other_size")


def glob_regex(patterns: list[str]) -> str:
    """One regular expression for shell-style patterns, in which ``*`` also crosses slashes."""
    def one(p: str) -> str:
        out, i = "", 0
        while i < len(p):
            ch = p[i]
            close = p.find("]", i + 2) if ch == "[" else -1
            if ch == "*":
                out += "[\\s\\S]*"
            elif ch == "?":
                out += "[\\s\\S]"
            elif close > 0:
                body = p[i + 1:close].replace("\\", "\\\\")
                out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
                i = close
            else:
                out += re.escape(ch)
            i += 1
        return out
    return "^(?:" + "|".join(one(p) for p in patterns) + ")$" if patterns else "(?!)"


def scope_check(diff: DataFrame, allowed: list[str]) -> DataFrame:
    """Changed leaves outside the allowed pointer patterns."""
    return diff.where(~F.col("pointer").rlike(glob_regex(allowed)))


def path_conflicts(diffs: DataFrame) -> DataFrame:
    """Pointers of two roles that are equal or lie below one another. ``doc_id, role, pointer``.

    Each pointer is joined through its own prefixes by equality, so conflicts
    are found without comparing every pair of pointers.
    """
    steps = F.split("pointer", "/")
    below = diffs.select("doc_id", F.col("role").alias("lower_role"), F.col("pointer").alias("lower_pointer"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("pointer"))
    above = diffs.select("doc_id", F.col("role").alias("upper_role"), "pointer")
    distinct_roles = F.col("upper_role") != F.col("lower_role")
    once = (F.col("pointer") != F.col("lower_pointer")) | (F.col("upper_role") < F.col("lower_role"))
    return below.join(above, ["doc_id", "pointer"]).where(distinct_roles & once).select(
        "doc_id", "upper_role", F.col("pointer").alias("upper_pointer"), "lower_role", "lower_pointer")


def merge_leaves(base: DataFrame, diffs: DataFrame) -> DataFrame:
    """Base leaves with all role changes applied; the last role in name order wins and removed leaves go."""
    last = diffs.groupBy("doc_id", "pointer").agg(F.max_by(F.struct("change", "value"), "role").alias("c"))
    joined = base.select("doc_id", "pointer", "value", F.lit(True).alias("in_base")).join(last, ["doc_id", "pointer"], "full_outer")
    kept = joined.where(F.col("c").isNull() | (F.col("c.change") != "removed"))
    return kept.select("doc_id", "pointer", F.when(F.col("c").isNull(), F.col("value")).otherwise(F.col("c.value")).alias("value"))


def merge_recheck(merged: DataFrame, stored: DataFrame) -> DataFrame:
    """Leaves in which a stored merge result differs from the recomputed one."""
    return leaf_diff(merged, stored)


def attempt_chain(attempts: DataFrame, bound: int = 5) -> DataFrame:
    """Finishing attempts: input is the last output, texts untouched, progress made, no hash twice, bounded.

    ``attempts``: ``task_id, attempt, input_sha256, output_sha256, text_changed``.
    """
    linked = skew.shift(attempts, ["task_id"], ["attempt"], {"last_output": F.col("output_sha256")}, -1, F.floor(F.col("attempt") / 65536))
    start = attempts.groupBy("task_id").agg(F.min(F.struct("attempt", "input_sha256")).alias("s")).select(
        "task_id", F.col("s.input_sha256").alias("sha"), (F.col("s.attempt") - 1).alias("at"))
    seen = start.unionByName(attempts.select("task_id", F.col("output_sha256").alias("sha"), F.col("attempt").alias("at"))).groupBy(
        "task_id", "sha").agg(F.min("at").alias("first_at"))
    numbered = skew.number_rows(linked, ["task_id"], ["attempt"], F.floor(F.col("attempt") / 65536), "position")
    return numbered.join(seen, (numbered["task_id"] == seen["task_id"]) & (numbered["output_sha256"] == seen["sha"])).select(
        numbered["task_id"], "attempt", first_reason(
            (F.col("position") > bound, "bound_exhausted"), (F.col("last_output").isNotNull() & (F.col("input_sha256") != F.col("last_output")), "input_mismatch"),
            (F.col("text_changed"), "text_violation"), (F.col("input_sha256") == F.col("output_sha256"), "no_progress"),
            (F.col("first_at") < F.col("attempt"), "cycle"), default="valid").alias("outcome"))


def interval_overlap(runs: DataFrame) -> DataFrame:
    """Whether all run intervals of a group share an instant. ``group_id, start_ns, end_ns``."""
    return runs.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.max("start_ns").alias("last_start"), F.min("end_ns").alias("first_end")).select(
        "group_id", "n", ((F.col("n") > 1) & (F.col("last_start") < F.col("first_end"))).alias("overlap"))
