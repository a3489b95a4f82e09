"""Sources: file inspection, line-wise JSON, layout tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as geo
from ..functions.text import split_lines

TEXT_SUFFIXES = ["txt", "md", "markdown", "rst", "html", "htm", "svg", "tex", "csv"]
CONTAINERS = ["docx", "pptx", "pdf"]

LINE_SCHEMA = T.StructType([
    T.StructField("artifact_id", T.LongType()), T.StructField("page", T.IntegerType()), T.StructField("box_id", T.StringType()),
    T.StructField("block_id", T.IntegerType()), T.StructField("line_index", T.IntegerType()),
    *[T.StructField(e, T.DoubleType()) for e in geo.EDGES],
    T.StructField("baseline_y", T.DoubleType()), T.StructField("font_size", T.DoubleType()), T.StructField("font", T.StringType()),
    T.StructField("bold", T.BooleanType()), T.StructField("has_cjk", T.BooleanType()), T.StructField("chars", T.IntegerType()),
])
LEDGER_SCHEMA = T.StructType([
    T.StructField("workflow_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("entry_id", T.StringType()),
    T.StructField("payload", T.StringType()), T.StructField("prev_hash", T.StringType()), T.StructField("entry_hash", T.StringType()),
])


def binary_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "content")


def inspect_sources(files: DataFrame) -> DataFrame:
    """Format, hash, size and structure of files given as ``path, content``.

    An unknown suffix or unreadable body becomes a row with an error, not a failure.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    text = ext.isin(TEXT_SUFFIXES)
    is_json = ext == "json"
    body = F.when(text | is_json, F.decode("content", "UTF-8"))
    work = files.select("path", "content", ext.alias("ext"), body.alias("body"))
    parsed = F.when(F.col("ext") == "json", F.try_parse_json("body"))
    head = F.to_json(parsed)
    kind = (F.when(F.startswith(head, F.lit("{")), "object").when(F.startswith(head, F.lit("[")), "array").when(F.startswith(head, F.lit('"')), "string")
            .when(head.isin("true", "false"), "boolean").when(head == "null", "null").when(head.isNotNull(), "number"))
    magic = F.hex(F.substring("content", 1, 5))
    valid = F.when(F.col("ext") == "pdf", magic == "255044462D").when(F.col("ext").isin("docx", "pptx"), F.startswith(magic, F.lit("504B0304")))
    lines = split_lines(F.col("body"))
    error = (F.when(~F.col("ext").isin(*TEXT_SUFFIXES, *CONTAINERS, "json"), "unsupported_format").when((F.col("ext") == "json") & parsed.isNull(), "malformed_json"))
    return work.select(
        "path", F.when(F.col("ext") == "txt", "text").otherwise(F.col("ext")).alias("format"), F.sha2("content", 256).alias("sha256"),
        F.octet_length("content").alias("size_bytes"), F.when(F.col("body").isNotNull(), F.when(F.col("body") == "", 0).otherwise(F.size(lines))).alias("line_count"),
        kind.alias("top_level"), F.coalesce(F.size(F.json_object_keys("body")), F.json_array_length("body")).alias("item_count"), valid.alias("valid_container"), error.alias("error"))


def parse_jsonl(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Typed records from JSON lines; blank lines are skipped and broken ones keep their text in ``_corrupt_record``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    keep = [c for c in lines.columns if c != column]
    rows = lines.where(F.length(F.trim(column)) > 0)
    return rows.select(*keep, F.from_json(column, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select(*keep, "r.*")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return parse_jsonl(spark.read.text(path), schema)


def normalise_boxes(df: DataFrame, convention: str = "xyxy") -> DataFrame:
    """One box convention (``x0,y0,x1,y1``); rows without a finite box are dropped."""
    if convention == "xywh":
        df = df.select(*[c for c in df.columns if c not in ("x", "y", "w", "h")],
                       *geo.from_xywh(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    finite = F.lit(True)
    for e in geo.cols():
        finite = finite & e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    return df.where(finite)


def read_layout(spark: SparkSession, path: str, convention: str = "xyxy") -> DataFrame:
    return normalise_boxes(spark.read.parquet(path), convention)


def trimmed(column: Column) -> Column:
    """An identifier that is neither empty nor padded."""
    return F.coalesce((column == F.trim(column)) & (column != ""), F.lit(False))
