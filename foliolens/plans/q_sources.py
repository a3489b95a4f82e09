"""Queries over sources, sinks, streams and SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sql as fsql
from ..functions import text as tx
from ..functions.common import py_round
from ..operators import evidence as ev
from ..sources import readers, sinks
from ..streaming import flows, guards
from .q_color import MODE, lum, ratio
from .q_evidence import LEDGER_FINDINGS
from .q_findings import ident
from .q_layout import _split
from .q_text import kind_cte
from .registry import query
from .sqltext import digest, pr
from .views import load, view

S_EXT = "element_at(array('txt', 'json', 'json', 'pdf', 'docx', 'xyz', 'md', 'json'), CAST(doc_id % 8 AS INT) + 1)"
S_BODY = ("CASE CAST(doc_id % 8 AS INT) WHEN 1 THEN concat('{\"n\": ', CAST(n_chars AS STRING), ', \"l\": [1, 2]}') WHEN 2 THEN '[1, 2, 3]' WHEN 3 THEN concat('%PDF-1.7 ', text) "
          "WHEN 4 THEN concat('PK', IF(doc_id % 16 = 4, unhex('0304'), unhex('0000')), text) WHEN 7 THEN concat('{', text) ELSE text END")


@query("s1_inspect_sources", """
WITH s AS (SELECT doc_id, CAST(doc_id % 8 AS INT) AS k, text, n_chars FROM documents), b AS (SELECT doc_id, k, CASE k WHEN 1 THEN concat('{"n": ', n_chars, ', "l": [1, 2]}') WHEN 2 THEN '[1, 2, 3]' WHEN 3 THEN concat('%PDF-1.7 ', text)
  WHEN 4 THEN concat('PK', CASE WHEN doc_id % 16 = 4 THEN chr(3) || chr(4) ELSE chr(0) || chr(0) END, text) WHEN 7 THEN concat('{', text) ELSE text END AS body FROM s)
SELECT concat('/in/', doc_id, '.', list_extract(['txt','json','json','pdf','docx','xyz','md','json'], k + 1)) AS path, list_extract(['text','json','json','pdf','docx','xyz','md','json'], k + 1) AS format, sha256(body) AS sha256,
  strlen(body) AS size_bytes, CAST(CASE WHEN k IN (0, 1, 2, 6, 7) THEN CASE WHEN body = '' THEN 0 ELSE len(string_split(rtrim(body, chr(10)), chr(10))) + length(body) - length(rtrim(body, chr(10))) - CASE WHEN right(body, 1) = chr(10) THEN 1 ELSE 0 END END END AS INT) AS line_count,
  CASE k WHEN 1 THEN 'object' WHEN 2 THEN 'array' END AS top_level, CAST(CASE k WHEN 1 THEN 2 WHEN 2 THEN 3 END AS INT) AS item_count, CASE k WHEN 3 THEN true WHEN 4 THEN doc_id % 16 = 4 END AS valid_container,
  CASE k WHEN 5 THEN 'unsupported_format' WHEN 7 THEN 'malformed_json' END AS error FROM b""")
def s1(spark, d):
    pk = "concat(CAST('PK' AS BINARY), IF(doc_id % 16 = 4, unhex('0304'), unhex('0000')), CAST(text AS BINARY))"
    body = ("CASE CAST(doc_id % 8 AS INT) WHEN 1 THEN CAST(concat('{\"n\": ', CAST(n_chars AS STRING), ', \"l\": [1, 2]}') AS BINARY) WHEN 2 THEN CAST('[1, 2, 3]' AS BINARY) WHEN 3 THEN CAST(concat('%PDF-1.7 ', text) AS BINARY) "
            f"WHEN 4 THEN {pk} WHEN 7 THEN CAST(concat('{{', text) AS BINARY) ELSE CAST(text AS BINARY) END AS content")
    return readers.inspect_sources(load(spark, d, "documents").selectExpr(f"concat('/in/', doc_id, '.', {S_EXT}) AS path", body))


@query("s2_read_jsonl", """
SELECT event_id AS line_no, CASE WHEN event_id % 9 <> 1 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 9 = 1 AS malformed FROM events WHERE event_id % 9 <> 0""")
def s2(spark, d):
    lines = load(spark, d, "events").selectExpr("event_id AS line_no", "CASE event_id % 9 WHEN 0 THEN '  ' WHEN 1 THEN concat('{', props) ELSE props END AS value")
    out = readers.parse_jsonl(lines, T.StructType([T.StructField("k", T.LongType())]))
    return out.select("line_no", "k", F.col("_corrupt_record").isNotNull().alias("malformed"))


@query("s3_read_layout", "SELECT artifact_id, page, box_id, x0, y0, x1, y1 FROM v_boxes WHERE curves <> 3")
def s3(spark, d):
    raw = view(spark, d, "v_boxes").selectExpr("artifact_id", "page", "box_id", "x0 AS x", "IF(curves = 3, NULL, y0) AS y", "x1 - x0 AS w", "y1 - y0 AS h")
    return readers.normalise_boxes(raw, "xywh")


FID = ["artifact_id", "page", "rule", "element_id"]


@query("s4_write_findings", f"SELECT artifact_id, {digest('h')} AS set_hash, count(*) AS n FROM (SELECT artifact_id, sha256({ident(FID)}) AS h FROM v_findings) GROUP BY 1")
def s4(spark, d):
    """Findings written by rule, then digested from what was written."""
    path = flows.work_folder(spark, "findings")
    sinks.write_findings(view(spark, d, "v_findings").select(*FID), path, FID)
    return sinks.set_hash(spark.read.parquet(path), ["artifact_id"], FID)


@query("s5_append_frames", "SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events UNION ALL SELECT event_type FROM events WHERE event_type = 'error') GROUP BY 1")
def s5(spark, d):
    path = flows.work_folder(spark, "frames")
    events = load(spark, d, "events").select("event_id", "event_type")
    sinks.create_once(events, path)
    sinks.append_frames(events.where("event_type = 'error'"), path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("s6_assert_body_free", "SELECT event_id FROM events WHERE event_type = 'view'")
def s6(spark, d):
    rows = load(spark, d, "events").selectExpr("event_id", "map(IF(event_type = 'view', 'Text', event_type), event_id) AS facts")
    return sinks.assert_body_free(rows).select("event_id")


@query("s6_nested_keys", "SELECT event_id FROM events WHERE event_type = 'view' OR event_id % 7 = 0")
def s6_nested(spark, d):
    """Keys inside maps in arrays of structs, and inside maps of maps."""
    key = "IF(event_type = 'view', 'TEXT', event_type)"
    rows = load(spark, d, "events").selectExpr("event_id", f"array(named_struct('facts', map('a', 1)), named_struct('facts', map({key}, 2)), NULL) AS items",
                                               "map('outer', map(IF(event_id % 7 = 0, 'body', 'none'), 1), 'other', NULL) AS more")
    return sinks.assert_body_free(rows).select("event_id")


@query("s7_redact_to_evidence", "SELECT doc_id, lang, length(text) AS text_chars, sha256(text) AS text_sha256 FROM documents")
def s7(spark, d):
    return sinks.to_evidence(load(spark, d, "documents").select("doc_id", "lang", "text"), ["text"])


# ---- streams ---------------------------------------------------------------------------------
TOOLS = ["image_generate", "document_render"]
GUARD = ("user_id AS task_id, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'state' ELSE 'call' END AS kind, CASE WHEN event_type = 'view' THEN 'read_file' ELSE 'image_generate' END AS tool, "
         "CASE WHEN event_id % 11 = 0 THEN 'verify-only' END AS mode, {sha}(concat('f', CAST(event_id % 3 AS STRING)){w}) AS fingerprint, CASE WHEN event_id % 2 = 0 THEN '/plan' END AS plan_path, "
         "{sha}('adapter'{w}) AS adapter_fingerprint, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'artifact_ready' WHEN 1 THEN 'transient_retry' WHEN 2 THEN 'hard_fail' WHEN 3 THEN 'review_only' ELSE 'artifact_ready' END AS status, "
         "CAST(2 AS INT) AS max_retries, CAST(event_id % 4 AS INT) AS retry_count, CASE WHEN event_id % 53 = 0 THEN 'bad' ELSE {sha}(concat('f', CAST(event_id % 2 AS STRING)){w}) END AS ready_fingerprint, event_id % 3 > 0 AS allow_new, "
         "CASE WHEN event_id % 47 = 0 THEN 'fail' ELSE 'pass' END AS baseline, 'attachment' AS delivery")
G_SPARK, G_DUCK = GUARD.format(sha="sha2", w=", 256"), GUARD.format(sha="sha256", w="")
GUARD_SQL = f"""
WITH g AS (SELECT {G_DUCK} FROM events), m AS (SELECT *, max(CASE WHEN kind = 'state' THEN seq END) OVER (PARTITION BY task_id ORDER BY seq) AS at FROM g),
j AS (SELECT c.task_id, c.seq, c.tool, c.mode, c.fingerprint, c.plan_path, c.adapter_fingerprint, s.seq AS ss, s.status, s.max_retries, s.retry_count, s.ready_fingerprint AS rf, s.allow_new, s.baseline, s.delivery, s.plan_path AS sp, s.adapter_fingerprint AS sa
  FROM m c LEFT JOIN g s ON s.task_id = c.task_id AND s.seq = c.at WHERE c.kind = 'call'),
r AS (SELECT task_id, seq, CASE WHEN ss IS NULL THEN 'state_missing' WHEN NOT regexp_matches(rf, '^[0-9a-f]{{64}}$') THEN 'fingerprint_invalid' WHEN status='artifact_ready' AND baseline <> 'pass' THEN 'ready_without_delivery' WHEN status='hard_fail' AND sp IS NULL THEN 'repair_plan_missing'
  WHEN tool = 'read_file' THEN 'allow:non_production_tool' WHEN mode IS NOT NULL THEN 'allow:verification' WHEN status='review_only' THEN 'review_only' WHEN status='artifact_ready' AND fingerprint = rf THEN 'same_fingerprint'
  WHEN status='artifact_ready' AND NOT allow_new THEN 'new_fingerprint_not_admitted' WHEN status IN ('artifact_ready','transient_retry') AND retry_count >= max_retries THEN 'retry_limit_exhausted' WHEN status='artifact_ready' THEN 'allow:new_fingerprint'
  WHEN status='transient_retry' THEN 'allow:transient_retry' WHEN plan_path IS NOT DISTINCT FROM sp AND adapter_fingerprint = sa THEN 'allow:bound_correction' ELSE 'correction_not_bound' END AS z FROM j)
SELECT task_id, seq, CASE WHEN starts_with(z, 'allow:') THEN 'allow' ELSE 'block' END AS decision, replace(z, 'allow:', '') AS reason FROM r"""


@query("r1_fingerprint", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN sha256(props) WHEN event_id % 3 = 1 THEN sha256(event_type) ELSE sha256(concat('{"event_type":"', event_type, '","user_id":', user_id, '}')) END AS fingerprint FROM events""")
def r1(spark, d):
    rows = load(spark, d, "events").selectExpr("event_id", "event_type", "user_id", "IF(event_id % 3 = 0, sha2(props, 256), 'no') AS given", "IF(event_id % 3 = 1, sha2(event_type, 256), NULL) AS other")
    return rows.select("event_id", guards.fingerprint([F.col("given"), F.col("other")], ["user_id", "event_type"]).alias("fingerprint"))


@query("r2_retry_guard", GUARD_SQL)
def r2(spark, d):
    return guards.retry_guard(load(spark, d, "events").selectExpr(*_split(G_SPARK)), TOOLS)


def _event_stream(spark, d):
    return flows.file_stream(spark, d, "events.parquet", load(spark, d, "events").schema)


@query("r2_retry_guard_stream", GUARD_SQL)
def r2_stream(spark, d):
    return flows.run_to_table(guards.retry_guard_stream(_event_stream(spark, d).selectExpr(*_split(G_SPARK)), TOOLS), "guard")


CHAIN_ONLY = "SELECT workflow_id, seq, reason FROM (" + LEDGER_FINDINGS + ") WHERE reason <> 'duplicate_entry'"


@query("r3_ledger_stream", CHAIN_ONLY)
def r3(spark, d):
    """Ledger entries written as files, then followed as a stream."""
    folder = flows.work_folder(spark, "ledger")
    ledger = view(spark, d, "v_ledger").select("workflow_id", "seq", "payload", "prev_hash", "entry_hash")
    ledger.write.parquet(folder)
    return flows.run_to_table(guards.ledger_stream(flows.file_stream(spark, folder, "*.parquet", ledger.schema)), "ledger-findings")


@query("r4_dedupe_stream", "SELECT event_id % 4000 AS candidate_id, count(*) > 0 AS seen FROM events GROUP BY 1")
def r4(spark, d):
    stream = _event_stream(spark, d).select((F.col("event_id") % 4000).alias("candidate_id"), F.col("ts").cast("timestamp").alias("ts"))
    once = flows.dedupe_stream(stream, ["candidate_id"], "ts", "400 days")
    return flows.run_to_table(once.select("candidate_id"), "dedupe").groupBy("candidate_id").agg((F.count(F.lit(1)) == 1).alias("seen"))


def _thirds(spark, d, columns):
    """Events in three tables by time, and a last row far ahead that closes what is open."""
    events = load(spark, d, "events")
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    step = (span["b"] - span["a"]) / 3
    rows = events.selectExpr(*columns)
    at = F.col("at")
    parts = [rows.where((at >= span["a"] + step * k if k else F.lit(True)) & (at < span["a"] + step * (k + 1) if k < 2 else F.lit(True))) for k in range(3)]
    return parts, rows.limit(1).select(*[F.lit(span["b"] + step * 100).cast("timestamp").alias(c) if c == "at" else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])


def _stepwise(spark, name, parts, sink):
    """Run a stream over tables that arrive one after the other; ``sink(stream, path, checkpoint)`` starts it."""
    folder, out = flows.work_folder(spark, name), flows.work_folder(spark, name + "-out")
    flows.in_steps(parts, folder, lambda: sink(flows.file_stream(spark, folder, "*.parquet", parts[0].schema), out + "/table", out + "/state"))
    return out + "/table"


@query("r4_keep_first_stream", """
WITH o AS (SELECT event_type, user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM o)
SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS at FROM g GROUP BY user_id, event_type, k""")
def r4_first(spark, d):
    """First row of each burst of a user's events of one type, from three micro-batches."""
    parts, last = _thirds(spark, d, ["user_id", "event_type", "event_id", "CAST(ts AS TIMESTAMP) AS at"])
    first = lambda s, path, state: flows.to_parquet(flows.keep_first(s, ["user_id", "event_type"], "at", "4 hours", ["event_id"], "1 hour"), path, state)
    path = _stepwise(spark, "first", [*parts, last], first)
    return _naive(spark.read.parquet(path).where("event_id IS NOT NULL"), "at")


ROW_SQL = """
SELECT event_id, 'value_missing' AS rule FROM events WHERE value IS NULL UNION ALL SELECT event_id, 'value_low' FROM events WHERE value < 5 UNION ALL SELECT event_id, 'error_event' FROM events WHERE event_type = 'error'"""


def _row_findings(stream):
    return flows.stream_findings(stream, ["event_id"], {
        "value_missing": F.col("value").isNull(), "value_low": F.coalesce(F.col("value") < 5, F.lit(False)), "error_event": F.col("event_type") == "error"})


@query("r5_stream_findings", ROW_SQL)
def r5(spark, d):
    return flows.run_to_table(_row_findings(_event_stream(spark, d)), "row-findings")


@query("r5_findings_upsert", ROW_SQL)
def r5_upsert(spark, d):
    """The same findings from three micro-batches through the batch-numbered sink."""
    parts, _ = _thirds(spark, d, ["event_id", "event_type", "value", "CAST(ts AS TIMESTAMP) AS at"])
    path = _stepwise(spark, "upsert", parts, lambda s, path, state: flows.upsert(_row_findings(s), path, state, "append"))
    return flows.latest(spark, path, ["event_id", "rule"])


RATE = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type AS rule, count(*) AS n FROM events GROUP BY 1, 2, 3"


def _timed(df):
    return df.select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("rule"))


def _naive(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@query("r6_finding_rates", RATE)
def r6(spark, d):
    return _naive(flows.finding_rates(_timed(load(spark, d, "events")), "at", ["rule"], "1 hour"), "window_start", "window_end")


@query("r6_finding_rates_sliding", """
SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL (30 * k) MINUTE AS window_start, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL (30 * k) MINUTE + INTERVAL 2 HOUR AS window_end, event_type AS rule, count(*) AS n
FROM events, unnest([0, 1, 2, 3]) AS u(k) GROUP BY 1, 2, 3""")
def r6_sliding(spark, d):
    return _naive(flows.finding_rates(_timed(load(spark, d, "events")), "at", ["rule"], "2 hours", "30 minutes"), "window_start", "window_end")


@query("r6_finding_sessions", """
WITH o AS (SELECT event_type AS rule, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS s FROM events), g AS (SELECT *, sum(s) OVER (PARTITION BY rule ORDER BY ts) AS k FROM o)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 5 MINUTE AS session_end, rule, count(*) AS n FROM g GROUP BY rule, k""")
def r6_sessions(spark, d):
    return _naive(flows.finding_sessions(_timed(load(spark, d, "events")), "at", ["rule"], "5 minutes"), "session_start", "session_end")


# a row of the first day that arrives with the last third
LATE = "SELECT TIMESTAMP '2024-01-01 00:30:00' AS at, 'late' AS rule"


def _rated(spark, d):
    parts, last = _thirds(spark, d, ["CAST(ts AS TIMESTAMP) AS at", "event_type AS rule"])
    return [*parts[:2], parts[2].unionByName(spark.sql(LATE))], last


@query("r6_finding_rates_stream", RATE)
def r6_stream(spark, d):
    """Windows of a stream with watermark and state, upserted by batch number; the late row is dropped."""
    parts, _ = _rated(spark, d)
    path = _stepwise(spark, "rates", parts, lambda s, path, state: flows.upsert(flows.finding_rates(s, "at", ["rule"], "1 hour", delay="2 hours"), path, state))
    return _naive(flows.latest(spark, path, ["window_start", "window_end", "rule"]), "window_start", "window_end")


@query("r6_rates_with_late", f"""
SELECT window_start, window_end, rule, n, false AS late FROM ({RATE})
UNION ALL SELECT TIMESTAMP '2024-01-01 00:30:00', NULL, 'late', 1, true""")
def r6_late(spark, d):
    """The same counts without state, with the late row in the side output."""
    parts, _ = _rated(spark, d)
    path = _stepwise(spark, "late", parts, lambda s, path, state: flows.rates_with_late(s, path, state, "at", ["rule"], "1 hour", "2 hours"))
    rates = flows.read_rates(spark, path, ["rule"]).withColumn("late", F.lit(False))
    late = flows.read_late(spark, path).select(F.col("at").alias("window_start"), F.lit(None).cast("timestamp").alias("window_end"), "rule", F.lit(1).cast("long").alias("n"), F.lit(True).alias("late"))
    return _naive(rates.unionByName(late), "window_start", "window_end")


@query("r6_sessions_stream", """
WITH o AS (SELECT event_type AS rule, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS s FROM events), g AS (SELECT *, sum(s) OVER (PARTITION BY rule ORDER BY ts) AS k FROM o)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 5 MINUTE AS session_end, rule, count(*) AS n FROM g GROUP BY rule, k""")
def r6_sessions_stream(spark, d):
    """Sessions come out when the watermark has passed them; a row far ahead closes the last ones."""
    parts, last = _rated(spark, d)
    path = _stepwise(spark, "sessions", [*parts, last], lambda s, path, state: flows.to_parquet(flows.finding_sessions(s, "at", ["rule"], "5 minutes", "2 hours"), path, state))
    return _naive(spark.read.parquet(path).where("rule IS NOT NULL AND rule <> 'late'"), "session_start", "session_end")


TTL_SQL = GUARD_SQL.replace("LEFT JOIN g s ON s.task_id = c.task_id AND s.seq = c.at", "LEFT JOIN g s ON s.task_id = c.task_id AND s.seq = c.at AND c.ts <= s.ts + INTERVAL 12 HOUR").replace(" FROM events), m AS", ", ts FROM events), m AS")


@query("r2_retry_guard_ttl", TTL_SQL)
def r2_ttl(spark, d):
    return guards.retry_guard(load(spark, d, "events").selectExpr(*_split(G_SPARK), "CAST(ts AS TIMESTAMP) AS at"), TOOLS, event_time="at", ttl="12 hours")


@query("r2_retry_guard_ttl_stream", TTL_SQL)
def r2_ttl_stream(spark, d):
    """States end 12 hours after their record; three micro-batches, timers remove ended states."""
    parts, _ = _thirds(spark, d, [*_split(G_SPARK), "CAST(ts AS TIMESTAMP) AS at"])
    path = _stepwise(spark, "guard-ttl", parts, lambda s, path, state: flows.to_parquet(guards.retry_guard_stream(s, TOOLS, "at", "12 hours", "1 hour"), path, state))
    return spark.read.parquet(path)


LEDGER_AT = "timestamp_seconds(1704067200 + seq * 3600 + (seq div 5) * 172800)"


@query("r3_ledger_ttl_stream", """
WITH l AS (SELECT workflow_id, seq, prev_hash, entry_hash, sha256(concat(workflow_id, '~', seq, '~', payload)) AS expected, lag(entry_hash) OVER w AS last, seq // 5 > lag(seq) OVER w // 5 AS ended FROM (SELECT DISTINCT workflow_id, seq, payload, prev_hash, entry_hash FROM v_ledger) WINDOW w AS (PARTITION BY workflow_id ORDER BY seq))
SELECT workflow_id, seq, 'chain_mismatch' AS reason FROM l WHERE prev_hash <> CASE WHEN last IS NULL OR ended THEN repeat('0', 64) ELSE last END
UNION ALL SELECT workflow_id, seq, 'tampered' FROM l WHERE entry_hash <> expected""")
def r3_ttl(spark, d):
    """A workflow without entries for a day is forgotten, here after every fifth entry; three micro-batches."""
    ledger = view(spark, d, "v_ledger").select("workflow_id", "seq", "payload", "prev_hash", "entry_hash").distinct().withColumn("at", F.expr(LEDGER_AT))
    parts = [ledger.where(c) for c in ("seq < 4", "seq >= 4 AND seq < 7", "seq >= 7")]
    path = _stepwise(spark, "ledger-ttl", parts, lambda s, path, state: flows.to_parquet(guards.ledger_stream(s, "at", "1 day", "1 hour"), path, state))
    return spark.read.parquet(path)


# ---- SQL functions -----------------------------------------------------------------------------
@query("sql_color_functions", f"""
SELECT token_id, printf('#%02X%02X%02X', r, g, b) AS hex, {pr(lum('r', 'g', 'b'), 8)} AS luminance, {pr(ratio(lum('r', 'g', 'b'), lum('b', 'r', 'g')), 6)} AS ratio, {MODE.format(lum('r', 'g', 'b'))} AS mode, g AS green FROM v_colors""")
def sql_colors(spark, d):
    fsql.register(spark)
    rows = view(spark, d, "v_colors").selectExpr("token_id", "rgb_to_hex(r, g, b) AS hex", "color_luminance(r, g, b) AS lum", "color_contrast(r, g, b, b, r, g) AS con", "color_mode(r, g, b) AS mode")
    return rows.select("token_id", "hex", py_round(F.col("lum"), 8).alias("luminance"), py_round(F.col("con"), 6).alias("ratio"), "mode", F.expr("hex_to_rgb(hex).g").alias("green"))


@query("sql_line_join_kind", f"WITH {kind_cte('v_joins', 'conv_id, turn, word_no')} SELECT conv_id, turn, word_no, kind, allowed FROM kk")
def sql_joins(spark, d):
    from .q_text import _joins
    fsql.register(spark)
    return _joins(spark, d).selectExpr("conv_id", "turn", "word_no", "line_join_kind(l, r) AS kind", "line_join_allowed(l, r) AS allowed")
