"""Layout, evidence and text tables derived from the given tables.

Each view exists twice: as a Spark DataFrame and as SQL for the comparison.
All numbers are whole or quarters, so both engines compute identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import skew

VIEW_SQL: dict[str, str] = {}
_BUILDERS = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A table of texts dealt over all tasks: much work per row, while a file may be one split (one row group) of any number of rows."""
    return load(spark, sf_dir, name).repartition(*keys)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _BUILDERS[name](spark, sf_dir)


def _define(name: str, sql: str):
    VIEW_SQL[name] = sql

    def wrap(fn):
        _BUILDERS[name] = fn
        return fn
    return wrap


def _projection(name: str, source: str, exprs: dict[str, str]):
    """A view that is a plain projection, in text both engines accept."""
    VIEW_SQL[name] = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in exprs.items()) + f" FROM {source}"

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = view(spark, sf_dir, source) if source in _BUILDERS else load(spark, sf_dir, source)
        return base.selectExpr(*[f"{e} AS {c}" for c, e in exprs.items()])
    _BUILDERS[name] = build


@_define("v_items", """
SELECT l_orderkey AS artifact_id, 1 AS page, l_partkey, l_suppkey, l_linenumber, min(l_quantity) AS q,
       min(l_returnflag) AS kind, min(l_linestatus) AS role
FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber""")
def _items(spark, sf_dir):
    # dealt by artifact: its groups, joins and windows need no further shuffle; by number, so that adaptive execution does
    # not merge partitions that all these steps share
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (load(spark, sf_dir, "lineitem").repartition(parts, "l_orderkey")
            .groupBy("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
            .agg(F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("kind"),
                 F.min("l_linestatus").alias("role"))
            .withColumnRenamed("l_orderkey", "artifact_id").withColumn("page", F.lit(1)))


_projection("v_boxes", "v_items", {
    "artifact_id": "artifact_id", "page": "page",
    "box_id": "concat_ws('-', CAST(artifact_id AS STRING), CAST(l_partkey AS STRING), "
              "CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING))",
    "block_id": "CAST(l_suppkey % 3 AS INT)", "line_index": "CAST(l_linenumber AS INT)",
    "kind": "kind", "role": "role",
    "x0": "CAST((l_partkey % 50) * 10 AS DOUBLE)",
    "y0": "CAST((l_suppkey * 7 + l_linenumber * 13) % 700 AS DOUBLE)",
    "x1": "CAST((l_partkey % 50) * 10 AS DOUBLE) + 4 * q",
    "y1": "CAST((l_suppkey * 7 + l_linenumber * 13) % 700 + 6 + 3 * l_linenumber AS DOUBLE)",
    "baseline_y": "CAST((l_suppkey * 7 + l_linenumber * 13) % 700 + 4 + 3 * l_linenumber AS DOUBLE)",
    "font_size": "CAST(6 + l_partkey % 7 AS DOUBLE)",
    "filled": "l_suppkey % 2 = 0", "stroked": "l_partkey % 3 = 0", "curves": "CAST(l_partkey % 9 AS INT)",
    "font": "CASE CAST(l_partkey % 4 AS INT) WHEN 0 THEN 'ABCDEF+NotoSansJP' WHEN 1 THEN 'BIZ UDGothic' "
            "WHEN 2 THEN 'Helvetica' ELSE '' END",
    "bold": "l_partkey % 5 = 0", "has_cjk": "l_suppkey % 3 <> 1",
    "chars": "CAST(5 + (l_partkey * 3 + l_linenumber) % 40 AS INT)",
})
_projection("v_pages", "orders", {
    "artifact_id": "o_orderkey", "page": "1", "width": "CAST(595 AS DOUBLE)",
    "height": "CAST(700 + (o_custkey % 5) * 20 AS DOUBLE)",
    "rotation": "CAST(CASE WHEN o_custkey % 11 = 0 THEN 90 ELSE 0 END AS INT)",
})
_projection("v_cards", "orders", {
    "artifact_id": "o_orderkey", "page": "1", "card_id": "concat('c', CAST(o_orderkey AS STRING))",
    "x0": "CAST(0 AS DOUBLE)", "y0": "CAST((o_custkey % 7) * 50 AS DOUBLE)",
    "x1": "CAST(500 AS DOUBLE)", "y1": "CAST((o_custkey % 7) * 50 + 350 AS DOUBLE)",
})
# several overlapping regions per page, as source shapes are
VIEW_SQL["v_regions"] = """
SELECT artifact_id, page, concat(box_id, '/r') AS region_id,
       CASE WHEN line_index % 4 = 0 THEN 'image' ELSE 'text_region' END AS shape_kind,
       CASE CAST(line_index % 4 AS INT) WHEN 1 THEN 'title' WHEN 2 THEN 'text-region' ELSE 'body' END AS role,
       concat('g', CAST(block_id AS STRING)) AS semantic_group,
       CASE CAST(line_index % 3 AS INT) WHEN 0 THEN 'container' WHEN 1 THEN 'heading' ELSE 'body' END AS semantic_role,
       x0 - 5 AS x0, y0 - 4 AS y0, x1 + 45 AS x1, y1 + 60 AS y1
FROM v_boxes"""


def _regions(spark, sf_dir):
    return view(spark, sf_dir, "v_boxes").selectExpr(
        "artifact_id", "page", "concat(box_id, '/r') AS region_id",
        "CASE WHEN line_index % 4 = 0 THEN 'image' ELSE 'text_region' END AS shape_kind",
        "CASE line_index % 4 WHEN 1 THEN 'title' WHEN 2 THEN 'text-region' ELSE 'body' END AS role",
        "concat('g', CAST(block_id AS STRING)) AS semantic_group",
        "CASE line_index % 3 WHEN 0 THEN 'container' WHEN 1 THEN 'heading' ELSE 'body' END AS semantic_role",
        "x0 - 5 AS x0", "y0 - 4 AS y0", "x1 + 45 AS x1", "y1 + 60 AS y1")


_BUILDERS["v_regions"] = _regions

VIEW_SQL["v_blocks"] = """
SELECT p_partkey AS block_id, CASE WHEN p_partkey = 0 THEN NULL ELSE p_partkey // 2 END AS parent_id,
       p_size AS page, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'hero' ELSE 'plain' END AS tier,
       CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'title' WHEN 1 THEN 'body' ELSE 'list' END AS role,
       CASE WHEN p_partkey % 7 = 0 THEN p_partkey // 4 ELSE NULL END AS owner_id,
       CAST((p_partkey % 10) * 20 AS DOUBLE) AS x0, CAST((p_partkey * 13) % 600 AS DOUBLE) AS y0,
       CAST((p_partkey % 10) * 20 + 150 AS DOUBLE) AS x1, CAST((p_partkey * 13) % 600 + 40 AS DOUBLE) AS y1,
       CAST(8 + p_partkey % 5 AS DOUBLE) AS line_height, p_brand AS scope_id
FROM part"""


def _blocks(spark, sf_dir):
    return load(spark, sf_dir, "part").selectExpr(
        "p_partkey AS block_id", "IF(p_partkey = 0, NULL, p_partkey div 2) AS parent_id", "p_size AS page",
        "IF(p_type IN ('ECONOMY', 'PROMO'), 'hero', 'plain') AS tier",
        "CASE p_partkey % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'body' ELSE 'list' END AS role",
        "IF(p_partkey % 7 = 0, p_partkey div 4, NULL) AS owner_id",
        "CAST((p_partkey % 10) * 20 AS DOUBLE) AS x0", "CAST((p_partkey * 13) % 600 AS DOUBLE) AS y0",
        "CAST((p_partkey % 10) * 20 + 150 AS DOUBLE) AS x1",
        "CAST((p_partkey * 13) % 600 + 40 AS DOUBLE) AS y1",
        "CAST(8 + p_partkey % 5 AS DOUBLE) AS line_height", "p_brand AS scope_id")


_BUILDERS["v_blocks"] = _blocks

_projection("v_colors", "part", {
    "token_id": "concat('t', CAST(p_partkey AS STRING))",
    "kind": "CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'foreground' WHEN 1 THEN 'surface' ELSE 'border' END",
    "r": "CAST((p_partkey * 37) % 256 AS INT)", "g": "CAST((p_partkey * 59) % 256 AS INT)",
    "b": "CAST((p_partkey * 83) % 256 AS INT)",
})


@_define("v_pixel_hist", """
SELECT l_orderkey % 200 AS region_id, CAST(l_partkey % 16 * 16 AS INT) AS r, CAST(l_suppkey % 16 * 16 AS INT) AS g,
       CAST(l_linenumber * 32 AS INT) AS b, count(*) AS n
FROM lineitem GROUP BY 1, 2, 3, 4""")
def _pixel_hist(spark, sf_dir):
    return (load(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey % 200 AS region_id", "CAST(l_partkey % 16 * 16 AS INT) AS r",
        "CAST(l_suppkey % 16 * 16 AS INT) AS g", "CAST(l_linenumber * 32 AS INT) AS b")
        .groupBy("region_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n")))


@_define("v_lines", """
SELECT doc_id, CAST(i AS INT) AS line_no, parts[i + 1] AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(len(parts))) AS u(i)""")
def _lines(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


# Latin text mapped letter by letter onto Japanese characters (fixed values)
KANA_FROM = "abcdefghijklmnopqrstuvwxyz ,."
KANA_TO = "のはがをにへとです私語確認まれたい用カナー（）①山川、。・"


def kana(column: str) -> str:
    return f"translate(lower({column}), '{KANA_FROM}', '{KANA_TO}')"


VIEW_SQL["v_kana"] = f"SELECT conv_id, turn, role, {kana('text')} AS text FROM conversations"
_BUILDERS["v_kana"] = lambda spark, d: text_rows(spark, d, "conversations", "conv_id", "turn").selectExpr(
    "conv_id", "turn", "role", f"{kana('text')} AS text")


@_define("v_turn_lines", """
SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
FROM conversations""")
def _turn_lines(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations")
    return skew.shift(turns, ["conv_id"], ["turn"], {"next_text": F.col("text")}, 1,
                      F.floor(F.col("turn") / 4096))


@_define("v_handles", """
SELECT concat(source, '/', CAST(doc_id AS VARCHAR), '.', lang) AS path, doc_id, source, lang,
       sha256(text) AS sha256, n_chars AS size_bytes, CAST(1 AS INT) AS version
FROM documents
UNION ALL
SELECT concat(source, '/', CAST(doc_id AS VARCHAR), '.', lang), doc_id, source, lang,
       CASE WHEN doc_id % 13 = 0 THEN sha256(concat(text, '#')) ELSE sha256(text) END,
       CASE WHEN doc_id % 26 = 0 THEN n_chars + 1 ELSE n_chars END, CAST(2 AS INT)
FROM documents WHERE doc_id % 17 <> 0""")
def _handles(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path")
    v1 = docs.select(path, "doc_id", "source", "lang", F.sha2("text", 256).alias("sha256"),
                     F.col("n_chars").alias("size_bytes"), F.lit(1).alias("version"))
    changed = F.when(F.col("doc_id") % 13 == 0, F.sha2(F.concat("text", F.lit("#")), 256))
    size = F.col("n_chars") + F.when(F.col("doc_id") % 26 == 0, 1).otherwise(0)
    v2 = docs.where(F.col("doc_id") % 17 != 0).select(
        path, "doc_id", "source", "lang", F.coalesce(changed, F.sha2("text", 256)).alias("sha256"),
        size.alias("size_bytes"), F.lit(2).alias("version"))
    return v1.unionByName(v2)


_projection("v_entries", "events", {
    "workflow_id": "user_id", "seq": "event_id", "entry_id": "concat('e', CAST(event_id - CASE WHEN event_id % 211 = 0 THEN 0 ELSE event_id % 3 END AS STRING))",
    "payload": "concat_ws('~', CAST(event_id AS STRING), event_type, props)",
})
VIEW_SQL["v_ledger"] = """
SELECT workflow_id, seq, entry_id, payload, prev_hash,
       CASE WHEN seq % 101 = 0 THEN sha256(concat('tampered', CAST(seq AS VARCHAR))) ELSE honest END AS entry_hash
FROM (SELECT *, coalesce(lag(honest) OVER (PARTITION BY workflow_id ORDER BY seq), repeat('0', 64)) AS prev_hash
      FROM (SELECT *, sha256(concat_ws('~', CAST(workflow_id AS VARCHAR), CAST(seq AS VARCHAR), payload)) AS honest FROM v_entries))"""


def _ledger(spark, sf_dir):
    """Each entry points to the hash of the one before it; some hashes are tampered with afterwards."""
    honest = F.sha2(F.concat_ws("~", F.col("workflow_id").cast("string"), F.col("seq").cast("string"), "payload"), 256)
    entries = view(spark, sf_dir, "v_entries").withColumn("honest", honest)
    chained = skew.shift(entries, ["workflow_id"], ["seq"], {"prev_hash": F.col("honest")}, -1,
                         F.floor(F.col("seq") / 65536))
    return chained.select("workflow_id", "seq", "entry_id", "payload", F.coalesce("prev_hash", F.lit("0" * 64)).alias("prev_hash"),
                          F.when(F.col("seq") % 101 == 0, F.sha2(F.concat(F.lit("tampered"), F.col("seq").cast("string")), 256))
                          .otherwise(F.col("honest")).alias("entry_hash"))


_BUILDERS["v_ledger"] = _ledger
VIEW_SQL["v_states"] = """
SELECT user_id AS task_id, event_id AS seq, event_type,
       CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE NULL END AS state_idx
FROM events"""
_BUILDERS["v_states"] = lambda spark, d: load(spark, d, "events").selectExpr(
    "user_id AS task_id", "event_id AS seq", "event_type",
    "CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS state_idx")

# One JSON tree per user and version: role 0 is the base, 1 and 2 edited copies.
VIEW_SQL["v_leaves"] = """
SELECT doc_id, role, pointer, value FROM (
  SELECT user_id AS doc_id, r.role AS role,
         concat('/', event_type, '/', CAST(event_id % 10 AS VARCHAR), '/k', CAST(event_id AS VARCHAR)) AS pointer,
         CASE WHEN event_id % 11 = 0 THEN NULL
              WHEN r.role = 1 AND event_id % 5 = 0 THEN concat('edit1:', props)
              WHEN r.role = 2 AND event_id % 7 = 0 THEN concat('edit2:', props)
              ELSE props END AS value,
         event_id
  FROM events, (VALUES (0), (1), (2)) AS r(role))
WHERE NOT (role = 1 AND event_id % 23 = 0) AND NOT (role = 2 AND event_id % 29 = 0) AND NOT (role = 0 AND event_id % 31 = 0)"""


def _leaves(spark, sf_dir):
    return load(spark, sf_dir, "events").withColumn("role", F.explode(F.array(*map(F.lit, [0, 1, 2])))).where(
        "NOT (role = 1 AND event_id % 23 = 0) AND NOT (role = 2 AND event_id % 29 = 0) "
        "AND NOT (role = 0 AND event_id % 31 = 0)"
    ).selectExpr(
        "user_id AS doc_id", "role",
        "concat('/', event_type, '/', CAST(event_id % 10 AS STRING), '/k', CAST(event_id AS STRING)) AS pointer",
        "CASE WHEN event_id % 11 = 0 THEN NULL WHEN role = 1 AND event_id % 5 = 0 THEN concat('edit1:', props) "
        "WHEN role = 2 AND event_id % 7 = 0 THEN concat('edit2:', props) ELSE props END AS value")


_BUILDERS["v_leaves"] = _leaves
