"""Queries over evidence reconciliation, ledgers and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import merge as mg
from .q_layout import _split
from .registry import query
from .sqltext import digest
from .views import VIEW_SQL, _BUILDERS, load, view

MEDIA = "CASE lang WHEN 'en' THEN 'application/pdf' WHEN 'de' THEN 'image/png' ELSE 'application/octet-stream' END AS media_type"
H1 = f"SELECT path, sha256, size_bytes, {MEDIA}, source, doc_id, lang FROM v_handles WHERE version = 1"
H2 = f"SELECT path, sha256, size_bytes, {MEDIA}, source, doc_id, lang FROM v_handles WHERE version = 2"
VIEW_SQL["v_h1"], VIEW_SQL["v_h2"] = H1, H2
_BUILDERS["v_h1"] = lambda s, d: view(s, d, "v_handles").where("version = 1").selectExpr("path", "sha256", "size_bytes", MEDIA, "source", "doc_id", "lang")
_BUILDERS["v_h2"] = lambda s, d: view(s, d, "v_handles").where("version = 2").selectExpr("path", "sha256", "size_bytes", MEDIA, "source", "doc_id", "lang")


@query("e1_row_digest", """SELECT doc_id, sha256(concat('{"doc_id":', doc_id, ',"lang":"', lang, '","n_chars":', n_chars, ',"source":"', source, '"}')) AS digest FROM documents""")
def e1(spark, d):
    return load(spark, d, "documents").select("doc_id", ev.row_digest(["source", "doc_id", "n_chars", "lang"]).alias("digest"))


@query("e2_media_type", """
SELECT doc_id, CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'text/html' WHEN 3 THEN 'image/svg+xml'
  WHEN 4 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END AS media_type FROM documents""")
def e2(spark, d):
    ext = "element_at(array('.PDF', '.jpeg', '.htm', '.svg', '.docx', '.bin', ''), CAST(doc_id % 7 AS INT) + 1)"
    return load(spark, d, "documents").select("doc_id", ev.media_type(F.expr(f"concat(source, '/v1.2/', doc_id, {ext})")).alias("media_type"))


@query("e3_artifact_set_id", f"""
SELECT source, {digest('h')} AS artifact_set_id, count(*) AS n FROM (SELECT source, sha256(concat_ws('|', path, sha256, CAST(size_bytes AS VARCHAR), media_type)) AS h FROM v_h1) GROUP BY 1""")
def e3(spark, d):
    return ev.artifact_set_id(view(spark, d, "v_h1"), ["source"])


EXTRA = "SELECT concat('extra/', path) AS path, sha256, size_bytes, media_type FROM v_h2 WHERE doc_id % 19 = 0"


@query("e4_drift", f"""
WITH c AS (SELECT path, sha256, size_bytes, media_type FROM v_h2 UNION ALL {EXTRA} UNION ALL SELECT path, sha256, size_bytes, media_type FROM v_h2 WHERE doc_id % 29 = 0),
g AS (SELECT path, count(*) AS n, min(sha256) AS sha, min(size_bytes) AS sz FROM c GROUP BY 1)
SELECT path, reason FROM (SELECT path, CASE WHEN d.sha256 IS NULL THEN 'extra' WHEN g.sha IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN d.sha256 <> sha THEN 'hash_drift' WHEN d.size_bytes <> sz THEN 'size_drift' END AS reason
  FROM v_h1 d FULL JOIN g USING (path)) WHERE reason IS NOT NULL""")
def e4(spark, d):
    h2 = view(spark, d, "v_h2").select("path", "sha256", "size_bytes", "media_type", "doc_id")
    current = h2.unionByName(h2.where("doc_id % 19 = 0").withColumn("path", F.concat(F.lit("extra/"), "path"))).unionByName(h2.where("doc_id % 29 = 0"))
    return ev.drift(view(spark, d, "v_h1"), current)


@query("e5_receiver_copies", f"""
WITH c AS (SELECT path, sha256, size_bytes, media_type FROM v_h2 UNION ALL {EXTRA} UNION ALL SELECT path, sha256, size_bytes, media_type FROM v_h2 WHERE doc_id % 29 = 0),
g AS (SELECT path, count(*) AS n, min(sha256) AS sha, min(size_bytes) AS sz FROM c GROUP BY 1)
SELECT path, reason FROM (SELECT path, CASE WHEN m.sha256 IS NULL THEN 'unknown_source' WHEN n IS NULL THEN 'not_copied' WHEN n > 1 THEN 'copied_twice' WHEN m.sha256 <> sha OR m.size_bytes <> sz THEN 'copy_drift' END AS reason
  FROM v_h1 m FULL JOIN g USING (path)) WHERE reason IS NOT NULL""")
def e5(spark, d):
    h2 = view(spark, d, "v_h2").select("path", "sha256", "size_bytes", "media_type", "doc_id")
    copies = h2.unionByName(h2.where("doc_id % 19 = 0").withColumn("path", F.concat(F.lit("extra/"), "path"))).unionByName(h2.where("doc_id % 29 = 0"))
    return ev.receiver_copies(view(spark, d, "v_h1"), copies)


@query("e6_three_way_equal", """
WITH u AS (SELECT path, sha256, 0 AS s FROM v_h1 UNION ALL SELECT path, sha256, 1 FROM v_h2 UNION ALL SELECT path, sha256, 2 FROM v_h1 WHERE doc_id % 31 <> 0 UNION ALL SELECT path, sha256, 2 FROM v_h1 WHERE doc_id % 37 = 0),
g AS (SELECT path, count(*) FILTER (WHERE s=0) AS a, count(*) FILTER (WHERE s=1) AS b, count(*) FILTER (WHERE s=2) AS c, count(DISTINCT sha256) AS h FROM u GROUP BY 1)
SELECT path, CASE WHEN greatest(a,b,c) > 1 THEN 'duplicate_path' WHEN least(a,b,c) = 0 THEN 'map_difference' ELSE 'hash_difference' END AS reason FROM g WHERE greatest(a,b,c) > 1 OR least(a,b,c) = 0 OR h > 1""")
def e6(spark, d):
    h1 = view(spark, d, "v_h1")
    receipts = h1.where("doc_id % 31 <> 0").unionByName(h1.where("doc_id % 37 = 0"))
    return ev.three_way_equal(h1, view(spark, d, "v_h2"), receipts)


ENTRY = ("path, CASE WHEN doc_id % 41 = 0 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN doc_id % 43 = 0 THEN 'odd' WHEN doc_id % 3 = 0 THEN 'non-text' ELSE 'text' END AS kind, "
         "CASE WHEN doc_id % 47 = 0 THEN NULL ELSE sha256 END AS current_sha256, CASE WHEN doc_id % 53 = 0 THEN 'x' ELSE sha256 END AS artifact_sha256, "
         "CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN NULL ELSE sha256 END AS source_sha256, CASE WHEN doc_id % 59 = 0 THEN NULL WHEN doc_id % 61 = 0 THEN 'y' ELSE sha256 END AS current_source_sha256, "
         "CASE WHEN doc_id % 67 = 0 THEN NULL ELSE doc_id % 23 = 0 END AS final_changed, CASE WHEN doc_id % 12 = 0 THEN '  too short ' ELSE 'no text body in this file' END AS reason_text")


@query("e7_receipt_validity", f"""
SELECT path, CASE WHEN status <> 'pass' THEN 'entry_not_pass' WHEN current_sha256 IS NULL THEN 'artifact_missing' WHEN artifact_sha256 <> current_sha256 THEN 'artifact_changed' WHEN kind = 'odd' THEN 'unknown_kind'
  WHEN sourced AND current_source_sha256 IS NULL THEN 'source_missing' WHEN sourced AND coalesce(source_sha256, '') <> current_source_sha256 THEN 'source_changed' WHEN sourced AND coalesce(final_changed, true) THEN 'final_check_not_clean'
  WHEN NOT sourced AND length(trim(reason_text)) < 12 THEN 'reason_too_short' ELSE 'valid' END AS outcome
FROM (SELECT *, kind = 'text' OR (kind = 'non-text' AND source_sha256 IS NOT NULL) AS sourced FROM (SELECT {ENTRY} FROM v_h1))""")
def e7(spark, d):
    return ev.receipt_validity(view(spark, d, "v_h1").selectExpr(*_split(ENTRY)))


RU = ("doc_id AS scope_id, {v} AS schema_version, CASE WHEN doc_id % 13 = 5 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN doc_id % 17 = {k} THEN 'other' WHEN doc_id % 61 = 9 THEN NULL ELSE lang END AS scope, 'std' AS invalidation, "
      "CASE WHEN doc_id % 41 = 3 THEN NULL ELSE source END AS authority_path, CASE WHEN doc_id % 19 = {k} THEN 'h2' ELSE 'h1' END AS authority_sha256, CASE WHEN doc_id % 23 = {k} THEN 'c2' ELSE 'c1' END AS checker_sha256, "
      "sha256 AS artifact_set_id, CASE WHEN doc_id % 29 = {k} THEN 'r2' ELSE 'r1' END AS receipt_set_id")


@query("e8_reuse_decision", f"""
WITH p AS (SELECT {RU.format(v="CASE WHEN doc_id % 37 = 2 THEN 1 ELSE 2 END", k=99)} FROM v_h1 WHERE doc_id % 11 <> 0), n AS (SELECT {RU.format(v='2', k=4)} FROM v_h2)
SELECT scope_id, CASE WHEN p.status IS NULL THEN 'not_requested' WHEN p.schema_version <> n.schema_version OR p.status <> 'pass' THEN 'reuse_record_schema_or_status_drift' WHEN n.scope IS NULL THEN 'scope_missing'
  WHEN p.scope IS DISTINCT FROM n.scope THEN 'scope_drift' WHEN n.authority_path IS NULL THEN 'authority_missing' WHEN p.authority_path IS DISTINCT FROM n.authority_path THEN 'authority_scope_drift'
  WHEN p.authority_sha256 <> n.authority_sha256 THEN 'authority_hash_drift' WHEN p.checker_sha256 <> n.checker_sha256 THEN 'checker_version_drift' WHEN p.artifact_set_id <> n.artifact_set_id THEN 'artifact_scope_drift'
  WHEN p.receipt_set_id <> n.receipt_set_id THEN 'receipt_scope_drift' ELSE 'reuse' END AS decision FROM n LEFT JOIN p USING (scope_id)""")
def e8(spark, d):
    prev = view(spark, d, "v_h1").where("doc_id % 11 <> 0").selectExpr(*_split(RU.format(v="CASE WHEN doc_id % 37 = 2 THEN 1 ELSE 2 END", k=99)))
    return ev.reuse_decision(prev, view(spark, d, "v_h2").selectExpr(*_split(RU.format(v="2", k=4))))


EXT = "element_at(array('pdf', 'pptx', 'docx', 'txt', 'html', 'pdf'), CAST(doc_id % 6 AS INT) + 1)"
EXT_SQL = "list_extract(['pdf','pptx','docx','txt','html','pdf'], CAST(doc_id % 6 AS INT) + 1)"
C_ART = "source AS set_id, concat(source, '/', CAST(doc_id AS STRING), '.', {ext}) AS path, sha256"
C_DEC = ("source AS set_id, doc_id AS ord, concat(source, '/', CAST(CASE WHEN doc_id % 31 = 1 THEN doc_id + 100000000 ELSE doc_id END AS STRING), '.', {ext}) AS path, CASE WHEN doc_id % 37 = 2 THEN 'zz' WHEN doc_id % 41 = 2 THEN repeat('a', 64) ELSE sha256 END AS sha256, "
         "concat(source, '/', CAST(CASE WHEN doc_id % 43 = 2 THEN doc_id WHEN doc_id % 47 = 3 THEN doc_id - doc_id % 6 + 1 ELSE doc_id - doc_id % 6 END AS STRING), '.', CASE WHEN doc_id % 43 = 2 THEN {ext} WHEN doc_id % 47 = 3 THEN 'pptx' ELSE 'pdf' END) AS source_of")
DEC_WHERE = "doc_id % 6 IN (1, 2, 3, 4) AND source <> 'src7'"
SETS = f"""ar AS (SELECT {C_ART.format(ext=EXT_SQL)}, doc_id FROM v_h1), dc AS (SELECT {C_DEC.format(ext=EXT_SQL)} FROM v_h1 WHERE {DEC_WHERE} AND source IN ('src1','src2','src3')
   UNION ALL SELECT {C_DEC.format(ext=EXT_SQL)} FROM v_h1 WHERE doc_id % 6 = 1 AND source IN ('src4', 'src5') AND doc_id % 31 <> 1 AND doc_id % 37 <> 2 AND doc_id % 41 <> 2 AND doc_id % 43 <> 2 AND doc_id % 47 <> 3 AND source_in(doc_id)),
tg AS (SELECT set_id, path FROM ar WHERE doc_id % 53 = 2),
ow AS (SELECT set_id, path, min(sha256) AS own FROM ar GROUP BY 1, 2), fs AS (SELECT set_id, path, min(ord) AS fo FROM dc GROUP BY 1, 2),
cp AS (SELECT dc.set_id, dc.ord, dc.path, CASE WHEN ow.own IS NULL THEN 'not_declared' WHEN dc.ord > fs.fo THEN 'duplicate' WHEN regexp_extract(dc.path, '\\.([^./]+)$', 1) NOT IN ('pptx','docx','xlsx','odt','ods','odp','html','htm') THEN 'suffix'
  WHEN EXISTS (SELECT 1 FROM tg WHERE tg.set_id = dc.set_id AND tg.path = dc.path) THEN 'also_target' WHEN NOT regexp_matches(dc.sha256, '^[0-9a-f]{{64}}$') THEN 'hash_format' WHEN dc.sha256 <> ow.own THEN 'hash_mismatch'
  WHEN so.own IS NULL OR dc.source_of = dc.path OR regexp_extract(dc.source_of, '\\.([^./]+)$', 1) <> 'pdf' THEN 'source_of' WHEN sc.fo IS NOT NULL THEN 'source_is_companion' ELSE 'valid' END AS outcome
 FROM dc LEFT JOIN ow ON ow.set_id = dc.set_id AND ow.path = dc.path JOIN fs ON fs.set_id = dc.set_id AND fs.path = dc.path LEFT JOIN ow so ON so.set_id = dc.set_id AND so.path = dc.source_of LEFT JOIN fs sc ON sc.set_id = dc.set_id AND sc.path = dc.source_of)"""
# companions of a set are only valid when the pdf they come from is in the set
SETS = SETS.replace(" AND source_in(doc_id)", " AND EXISTS (SELECT 1 FROM v_h1 z WHERE z.source = v_h1.source AND z.doc_id = v_h1.doc_id - v_h1.doc_id % 6) AND doc_id % 53 <> 2")


def _sets(spark, d):
    h1 = view(spark, d, "v_h1")
    artifacts = h1.selectExpr(*_split(C_ART.format(ext=EXT)), "doc_id")
    targets = artifacts.where("doc_id % 53 = 2")
    mixed = h1.where(DEC_WHERE + " AND source IN ('src1','src2','src3')").selectExpr(*_split(C_DEC.format(ext=EXT)))
    pdfs = h1.select("source", F.col("doc_id").alias("root"))
    clean = h1.where("doc_id % 6 = 1 AND source IN ('src4', 'src5') AND doc_id % 31 <> 1 AND doc_id % 37 <> 2 AND doc_id % 41 <> 2 AND doc_id % 43 <> 2 "
                     "AND doc_id % 47 <> 3 AND doc_id % 53 <> 2").withColumn("root", F.expr("doc_id - doc_id % 6")).join(pdfs, ["source", "root"], "left_semi").selectExpr(*_split(C_DEC.format(ext=EXT)))
    return artifacts, mixed.unionByName(clean), targets


@query("e9_companions", f"WITH {SETS} SELECT set_id, ord, path, outcome FROM cp")
def e9(spark, d):
    artifacts, declared, targets = _sets(spark, d)
    return ev.companions(declared, artifacts, targets)


@query("e10_quality_targets", f"""
WITH {SETS}, ok AS (SELECT set_id FROM cp GROUP BY 1 HAVING bool_and(outcome = 'valid')), ex AS (SELECT DISTINCT cp.set_id, cp.path FROM cp JOIN ok USING (set_id))
SELECT ar.set_id, ar.path FROM ar WHERE (regexp_extract(path, '\\.([^./]+)$', 1) IN ('pdf','pptx','docx','html') OR EXISTS (SELECT 1 FROM tg WHERE tg.set_id = ar.set_id AND tg.path = ar.path))
  AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.set_id = ar.set_id AND ex.path = ar.path)""")
def e10(spark, d):
    artifacts, declared, targets = _sets(spark, d)
    return ev.quality_targets(artifacts, targets, ev.companions(declared, artifacts, targets))


IDN = ("user_id AS run_id, CASE WHEN user_id % 11 = 0 AND event_id % 37 = 0 THEN NULL ELSE 'c1' END AS contract_id, CASE WHEN user_id % 7 = 0 AND event_type = 'error' THEN 'p2' ELSE 'p1' END AS policy_hash, user_id AS producer_run_id, 's' AS artifact_set_id")


@query("e11_identity_consistency", f"""
WITH g AS (SELECT run_id, count(*) AS n, bool_or(contract_id IS NULL) AS bad, count(DISTINCT (contract_id, policy_hash)) AS k FROM (SELECT {IDN} FROM events) GROUP BY 1)
SELECT run_id, n, CASE WHEN bad THEN 'identity_incomplete' ELSE 'identity_mismatch' END AS reason FROM g WHERE bad OR k > 1""")
def e11(spark, d):
    return ev.identity_consistency(load(spark, d, "events").selectExpr(*_split(IDN)))


TRI = ("user_id AS frame_id, CAST(event_id AS STRING) AS key, state, CASE WHEN state = 'applied' AND event_id % 13 = 0 THEN concat(props, '!') WHEN state = 'effective' AND event_id % 17 = 0 THEN NULL ELSE props END AS value")


@query("e12_state_drift", f"""
WITH s AS (SELECT {TRI} FROM events, (VALUES ('requested'), ('applied'), ('effective')) AS x(state) WHERE NOT (state = 'applied' AND event_id % 29 = 0)),
w AS (SELECT frame_id, key, count(*) AS n, max(value) FILTER (WHERE state='requested') AS requested, max(value) FILTER (WHERE state='applied') AS applied, max(value) FILTER (WHERE state='effective') AS effective FROM s GROUP BY 1, 2)
SELECT frame_id, key, requested, applied, effective, CASE WHEN n < 3 THEN 'state_missing' WHEN requested IS DISTINCT FROM applied THEN 'applied_drift' ELSE 'effective_drift' END AS reason FROM w
WHERE n < 3 OR requested IS DISTINCT FROM applied OR applied IS DISTINCT FROM effective""")
def e12(spark, d):
    rows = load(spark, d, "events").withColumn("state", F.explode(F.array(*map(F.lit, ["requested", "applied", "effective"])))).where(
        "NOT (state = 'applied' AND event_id % 29 = 0)")
    return ev.state_drift(rows.selectExpr(*_split(TRI)))


FR = ("user_id AS run_id, CAST(CASE WHEN user_id % 10 = 3 AND event_id % 50 = 1 THEN 0 ELSE event_id END AS STRING) AS frame_id, CASE WHEN user_id % 10 = 4 AND event_id % 3 = 0 THEN 's2' ELSE 's1' END AS schema_version, "
      "CASE WHEN user_id % 10 = 5 AND event_id % 2 = 0 THEN 'p2' ELSE 'p1' END AS policy")
TOK_S = "CASE WHEN user_id % 10 IN (5, 6) THEN NULL WHEN user_id % 10 = 7 AND event_id % 2 = 0 THEN NULL WHEN user_id % 10 = 8 AND event_id % 9 = 0 THEN array('a', 'a') ELSE array('a', event_type) END AS token_ids"
TOK_D = TOK_S.replace("array('a', 'a')", "['a', 'a']").replace("array('a', event_type)", "['a', event_type]")


@query("e13_aggregate_frames", f"""
WITH f AS (SELECT {FR}, {TOK_D} FROM events), u AS (SELECT run_id, max(k) AS most FROM (SELECT run_id, frame_id, count(*) AS k FROM f GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT *, sha256(concat_ws('|', frame_id, coalesce(array_to_string(token_ids, ','), '~'), policy)) AS h FROM f),
g AS (SELECT run_id, count(*) AS n, count(token_ids) AS s, count(DISTINCT schema_version) AS sc, count(DISTINCT policy) AS pc, bool_or(coalesce(len(list_distinct(token_ids)) <> len(token_ids), false)) AS bad, {digest('h')} AS frames_digest FROM h GROUP BY 1)
SELECT run_id, n AS frame_count, frames_digest, CASE WHEN bad THEN 'token_ids_malformed' WHEN sc > 1 THEN 'schema_mix' WHEN s > 0 AND s < n THEN 'semantic_and_legacy_mix' WHEN s = n AND most > 1 THEN 'frame_id_repeated' WHEN s < n AND pc > 1 THEN 'policy_differs' ELSE 'pass' END AS outcome
FROM g JOIN u USING (run_id)""")
def e13(spark, d):
    return ev.aggregate_frames(load(spark, d, "events").selectExpr(*_split(FR), TOK_S))


RQ = ("l_orderkey AS request_id, CASE WHEN l_linenumber % 2 = 0 THEN 'body' ELSE 'title' END AS role, concat('t', CAST(l_partkey AS STRING)) AS token_id, concat('arg', CAST(l_suppkey % 6 AS STRING)) AS direct_argument, CAST(l_linenumber AS DOUBLE) AS direct_value")
TK = "concat('t', CAST(p_partkey AS STRING)) AS token_id, CASE WHEN p_size % 3 = 0 THEN 'body' ELSE 'title' END AS token_role, concat('arg', CAST(p_size % 6 AS STRING)) AS argument, CAST(p_size % 7 AS DOUBLE) AS amount"


@query("e14_resolve_tokens", f"""
WITH r AS (SELECT {RQ} FROM lineitem), t AS (SELECT {TK} FROM part WHERE p_partkey % 23 <> 0), j AS (SELECT r.*, token_role, argument, amount FROM r LEFT JOIN t USING (token_id)),
k AS (SELECT *, count(*) OVER (PARTITION BY request_id, token_id) AS asked, CASE WHEN argument IS NOT NULL THEN count(*) OVER (PARTITION BY request_id, argument) END AS uses FROM j)
SELECT request_id, token_id, argument, amount, CASE WHEN asked > 1 THEN 'token_repeated' WHEN token_role IS NULL THEN 'unknown_token' WHEN token_role <> role THEN 'role_drift' WHEN uses > 1 THEN 'argument_collision'
  WHEN direct_argument = argument AND abs(direct_value - amount) > 1e-9 THEN 'direct_value_drift' ELSE 'resolved' END AS outcome FROM k""")
def e14(spark, d):
    return ev.resolve_tokens(load(spark, d, "lineitem").selectExpr(*_split(RQ)), load(spark, d, "part").where("p_partkey % 23 <> 0").selectExpr(*_split(TK)))


@query("e15_bundle_coverage", """
WITH r AS (SELECT source AS run_id, path, sha256 FROM v_h2 UNION ALL SELECT source, path, sha256 FROM v_h2 WHERE doc_id % 29 = 0 UNION ALL SELECT source, concat(path, 'x'), sha256 FROM v_h2 WHERE doc_id % 31 = 0),
g AS (SELECT run_id, path, count(*) AS n, min(sha256) AS rs FROM r GROUP BY 1, 2), a AS (SELECT source AS run_id, path, sha256 FROM v_h1)
SELECT * FROM (SELECT run_id, path, CASE WHEN a.sha256 IS NULL THEN 'unknown_artifact' WHEN n IS NULL THEN 'not_covered' WHEN n > 1 THEN 'covered_twice' WHEN a.sha256 <> rs THEN 'hash_mismatch' END AS reason FROM a FULL JOIN g USING (run_id, path)) WHERE reason IS NOT NULL""")
def e15(spark, d):
    h2 = view(spark, d, "v_h2").select(F.col("source").alias("run_id"), "path", "sha256", "doc_id")
    receipts = h2.unionByName(h2.where("doc_id % 29 = 0")).unionByName(h2.where("doc_id % 31 = 0").withColumn("path", F.concat("path", F.lit("x"))))
    return ev.bundle_coverage(receipts, view(spark, d, "v_h1").withColumnRenamed("source", "run_id"))


LEDGER_FINDINGS = """
WITH l AS (SELECT *, lag(entry_hash) OVER (PARTITION BY workflow_id ORDER BY seq) AS lh, min(seq) OVER (PARTITION BY workflow_id, entry_id) AS fs FROM v_ledger)
SELECT workflow_id, seq, 'chain_mismatch' AS reason FROM l WHERE prev_hash <> coalesce(lh, repeat('0', 64))
UNION ALL SELECT workflow_id, seq, 'tampered' FROM l WHERE entry_hash <> sha256(concat_ws('~', CAST(workflow_id AS VARCHAR), CAST(seq AS VARCHAR), payload))
UNION ALL SELECT workflow_id, seq, 'duplicate_entry' FROM l WHERE seq > fs"""


@query("e16_ledger_chain", LEDGER_FINDINGS)
def e16(spark, d):
    return ev.ledger_check(view(spark, d, "v_ledger"))


WORKFLOWS = "SELECT DISTINCT user_id AS workflow_id, concat('t_', CAST(user_id AS STRING)) AS task_id, 'deadline_delivery' AS mode, 'source_repair' AS strategy, sha2(CAST(user_id AS STRING), 256) AS source_sha256 FROM {0}"


def _workflows(spark, d):
    return spark.sql(WORKFLOWS.format("{e}"), e=load(spark, d, "events"))


@query("e16_ledger_headers", """
WITH w AS (SELECT DISTINCT user_id AS u FROM events)
SELECT u AS workflow_id, r AS reason FROM (SELECT u, unnest(CASE CAST(u % 7 AS INT) WHEN 0 THEN ['ledger_missing'] WHEN 1 THEN ['header_schema_mismatch'] WHEN 2 THEN ['header_identity_mismatch', 'header_tampered']
  WHEN 3 THEN ['header_source_drift', 'header_tampered'] WHEN 4 THEN ['header_tampered'] WHEN 5 THEN ['header_schema_mismatch', 'header_identity_mismatch', 'header_tampered'] ELSE [] END) AS r FROM w)""")
def e16_headers(spark, d):
    """One kind of damage for each remainder of the workflow's number."""
    w = _workflows(spark, d)
    good = w.withColumn("header_hash", ev.header_digest()).withColumn("schema_version", F.lit(ev.LEDGER_SCHEMA))
    k = F.col("workflow_id") % 7
    headers = good.where(k != 0).select(
        "workflow_id", F.when(k != 1, F.col("schema_version")).alias("schema_version"), F.when(k == 2, "t_other").otherwise(F.col("task_id")).alias("task_id"),
        F.when(k != 5, F.col("mode")).alias("mode"), "strategy", F.when(k == 3, F.sha2(F.lit("moved"), 256)).otherwise(F.col("source_sha256")).alias("source_sha256"),
        F.when(k == 4, F.lit("0" * 64)).otherwise(F.col("header_hash")).alias("header_hash"))
    return ev.ledger_headers(headers, w)


@query("e16_ledger_entry_rules", """
SELECT user_id AS workflow_id, event_id AS seq, 'issue_family_unknown' AS reason FROM events WHERE event_type = 'error'
UNION ALL SELECT user_id, event_id, 'targets_not_anonymised' FROM events WHERE event_id % 7 = 0 OR event_id % 11 = 0 OR (event_id % 5 = 0 AND sha256(props) >= sha256(event_type))
UNION ALL SELECT user_id, event_id, 'artifact_hash_invalid' FROM events WHERE event_id % 19 = 0
UNION ALL SELECT user_id, event_id, 'schema_mismatch' FROM events WHERE event_id % 31 = 0 UNION ALL SELECT user_id, event_id, 'cross_task_identity' FROM events WHERE event_id % 31 = 1
UNION ALL SELECT user_id, event_id, 'source_drift' FROM events WHERE event_id % 31 = 2 UNION ALL SELECT user_id, event_id, 'geometry_invalid' FROM events WHERE event_id % 31 IN (3, 4, 5)
UNION ALL SELECT user_id, event_id, 'repair_invalid' FROM events WHERE event_id % 31 IN (6, 7, 8) UNION ALL SELECT user_id, event_id, 'genericization_flag_invalid' FROM events WHERE event_id % 31 IN (9, 10)
UNION ALL SELECT user_id, event_id, 'candidate_identity_mismatch' FROM events WHERE event_id % 31 = 11""")
def e16_rules(spark, d):
    """One kind of damage for each remainder of the event's number."""
    k = "CAST(event_id % 31 AS INT)"
    # dealt over tasks, as a file may be one split of any number of rows
    rows = load(spark, d, "events").repartition("event_id").selectExpr(
        "user_id AS workflow_id", "event_id AS seq", f"IF({k} = 0, NULL, '{ev.CANDIDATE_SCHEMA}') AS schema_version", f"IF({k} = 1, 't_x', concat('t_', CAST(user_id AS STRING))) AS task_id",
        f"IF({k} = 2, sha2('moved', 256), sha2(CAST(user_id AS STRING), 256)) AS source_sha256", "IF(event_type = 'error', 'other', 'safe-wrap') AS issue_family",
        "CASE WHEN event_id % 7 = 0 THEN filter(array(''), x -> false) WHEN event_id % 11 = 0 THEN array('name') WHEN event_id % 5 = 0 THEN array(sha2(props, 256), sha2(event_type, 256)) ELSE array(sha2(props, 256)) END AS target_ids",
        "IF(event_id % 19 = 0, 'short', sha2(props, 256)) AS before_sha256", "sha2(event_type, 256) AS after_sha256",
        f"CASE {k} WHEN 3 THEN array(1D, 2D, 0D, 4D) WHEN 4 THEN array(1D, 2D, 3D) ELSE array(1D, 2D, 3D, 4D) END AS before_box", f"IF({k} = 5, array(1D, 2D, double('nan'), 4D), array(1D, 1D, 1D, 1D)) AS after_box",
        f"IF({k} = 6, 'other', '{ev.REPAIR_ADAPTER}') AS adapter_id", f"IF({k} = 7, 'rewrite', 'wrap_adjustment') AS operation", f"{k} = 8 AS producer_mutation",
        f"CASE {k} WHEN 9 THEN NULL WHEN 10 THEN 'yes' ELSE 'true' END AS genericization_candidate", "sha2(props, 256) AS core_digest", f"IF({k} = 11, sha2(event_type, 256), sha2(props, 256)) AS candidate_id")
    return ev.ledger_entry_rules(rows, _workflows(spark, d))


@query("e16_entry_shape", """
SELECT user_id AS workflow_id, event_id AS seq, CASE CAST(event_id % 13 AS INT) WHEN 0 THEN 'schema_mismatch' WHEN 1 THEN 'schema_mismatch' WHEN 2 THEN 'schema_mismatch' WHEN 3 THEN 'body_or_personal_data' WHEN 4 THEN 'body_or_personal_data'
  WHEN 6 THEN 'readback_fields_mismatch' ELSE 'readback_drift' END AS reason FROM events WHERE event_id % 13 IN (0, 1, 2, 3, 4, 6, 7, 8, 9) UNION ALL SELECT user_id, event_id, 'readback_drift' FROM events WHERE event_id % 13 = 4""")
def e16_shape(spark, d):
    """Entries as JSON, with one kind of damage for each remainder of the event's number; a telephone number in a path is none."""
    k = "CAST(event_id % 13 AS INT)"
    events = load(spark, d, "events")
    entry = f"""to_json(named_struct('schema_version', IF({k} = 2, 'other', '{ev.CANDIDATE_SCHEMA}'), 'candidate_id', sha2(props, 256), 'entry_hash', sha2(event_type, 256), 'workflow_id', CAST(user_id AS STRING), 'task_id', 't_1',
      'issue_family', IF({k} = 4, 'mail a.b@example.org', 'spacing'), 'target_ids', array(sha2(props, 256)), 'source_sha256', sha2('s', 256), 'artifact_before_sha256', sha2('a', 256), 'artifact_after_sha256', IF({k} = 0, NULL, sha2('b', 256)),
      'before_geometry', IF({k} = 3, map('note "body": ', map('Body', 1)), map('box', map('x0', 1))), 'after_geometry', array(1D, 2D), 'repair', map('adapter_id', 'body'), 'renderer_readback',
      named_struct('path', concat(IF({k} = 9, 'f/', '/f/'), IF({k} IN (4, 8), 'gone-0312345678', CAST(event_id AS STRING))), 'sha256', IF({k} = 7, sha2('x', 256), sha2(props, 256)), 'size_bytes', IF({k} = 6, NULL, length(props))),
      'genericization_candidate', true, 'previous_entry_hash', sha2('p', 256), 'extra', IF({k} = 1, 1, NULL)))"""
    files = events.selectExpr("concat('/f/', event_id) AS path", "sha2(props, 256) AS sha256", "length(props) AS size_bytes")
    return ev.ledger_entry_shape(events.selectExpr("user_id AS workflow_id", "event_id AS seq", f"{entry} AS entry"), files)


@query("e16_ledger_final", """
WITH l AS (SELECT workflow_id, arg_max(entry_hash, seq) AS last_hash FROM v_ledger GROUP BY 1), s AS (SELECT user_id AS workflow_id, arg_max(sha256(concat_ws('~', CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR), concat_ws('~', CAST(event_id AS VARCHAR), event_type, props))), event_id) AS h FROM events WHERE NOT (user_id % 5 = 0 AND event_type = 'view') GROUP BY 1)
SELECT workflow_id, last_hash FROM s LEFT JOIN l USING (workflow_id) WHERE h IS DISTINCT FROM last_hash""")
def e16_final(spark, d):
    honest = F.expr("sha2(concat_ws('~', CAST(user_id AS STRING), CAST(event_id AS STRING), concat_ws('~', CAST(event_id AS STRING), event_type, props)), 256)")
    submitted = load(spark, d, "events").where("NOT (user_id % 5 = 0 AND event_type = 'view')").groupBy(F.col("user_id").alias("workflow_id")).agg(
        F.max_by(honest, "event_id").alias("sha256"))
    return ev.ledger_final(view(spark, d, "v_ledger"), submitted)


STF = "task_id, seq, CAST(state_idx AS INT) AS state_idx, seq % 7 <> 0 AS has_result, seq % 11 <> 0 AS has_ledger, seq % 3 = 0 AS has_receipt"


@query("e17_state_transitions", f"""
WITH s AS (SELECT {STF} FROM v_states), p AS (SELECT *, lag(CASE WHEN state_idx BETWEEN 0 AND 3 THEN state_idx ELSE -2 END) OVER (PARTITION BY task_id ORDER BY seq) AS b FROM s)
SELECT task_id, seq, state_idx, CASE WHEN state_idx IS NULL OR state_idx NOT BETWEEN 0 AND 3 THEN 'unknown_state' WHEN b IS NULL AND state_idx <> 0 THEN 'first_state' WHEN state_idx <> coalesce(b, -1) + 1 THEN 'not_one_step' WHEN state_idx = 1 AND NOT (has_result AND has_ledger) THEN 'submission_incomplete'
  WHEN state_idx > 1 AND NOT has_result THEN 'submitted_artifact_missing' WHEN state_idx = 3 AND NOT has_receipt THEN 'hardening_receipt_missing' WHEN state_idx <> 3 AND has_receipt THEN 'hardening_receipt_premature' ELSE 'valid' END AS outcome FROM p""")
def e17(spark, d):
    return ev.transitions(view(spark, d, "v_states").selectExpr(*_split(STF)))


STRAT = ("o_orderkey AS workflow_id, CASE WHEN o_custkey % 3 = 0 THEN 'harness_development' ELSE 'deadline_delivery' END AS mode, CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN 'source_first_rebuild' WHEN 1 THEN 'existing_artifact_repair' WHEN 2 THEN 'source_repair' ELSE CASE WHEN o_custkey % 3 = 0 THEN 'source_first_rebuild' ELSE 'source_repair' END END AS strategy, "
         "'s' AS source_id, CASE WHEN o_custkey % 5 < 2 THEN 'b' END AS baseline_id, CASE CAST(o_custkey % 7 AS INT) WHEN 0 THEN 's' WHEN 1 THEN 's' WHEN 2 THEN 'b' WHEN 3 THEN 'b' ELSE 'n' END AS output_id")


@query("e18_strategy_rules", f"""
SELECT workflow_id, CASE WHEN NOT ((mode='harness_development' AND strategy='source_first_rebuild') OR (mode='deadline_delivery' AND strategy IN ('existing_artifact_repair','source_repair'))) THEN 'mode_strategy_conflict'
  WHEN mode='harness_development' AND (baseline_id IS NOT NULL OR output_id = source_id) THEN 'new_artifact_required' WHEN strategy='existing_artifact_repair' AND output_id IS DISTINCT FROM baseline_id THEN 'artifact_path_not_preserved'
  WHEN strategy='source_repair' AND (baseline_id IS NOT NULL OR output_id <> source_id) THEN 'source_path_not_preserved' ELSE 'valid' END AS outcome FROM (SELECT {STRAT} FROM orders)""")
def e18(spark, d):
    return ev.strategy_rules(load(spark, d, "orders").selectExpr(*_split(STRAT)))


MAPS = "user_id AS workflow_id, CAST(event_id AS STRING) AS entry_id, CASE WHEN event_id % 9 = 0 THEN 'extension:new-kind' WHEN event_id % 9 = 1 THEN 'extension:Bad' WHEN event_id % 9 = 2 THEN 'nothing' ELSE 'spacing' END AS family"


@query("e19_mapping_coverage", f"""
WITH e AS (SELECT user_id AS workflow_id, CAST(event_id AS VARCHAR) AS entry_id FROM events WHERE event_type IN ('view', 'click')), mm AS (SELECT {MAPS} FROM events WHERE event_type IN ('view', 'error') AND event_id % 13 <> 0 UNION ALL SELECT {MAPS} FROM events WHERE event_id % 50 = 0 AND event_type = 'view'),
g AS (SELECT workflow_id, entry_id, count(*) AS n, min(family) AS family FROM mm GROUP BY 1, 2)
SELECT workflow_id, entry_id, reason FROM (SELECT workflow_id, entry_id, CASE WHEN e.entry_id IS NULL THEN 'not_eligible' WHEN n IS NULL THEN 'not_mapped' WHEN n > 1 THEN 'mapped_twice' WHEN family IN ('extension:Bad', 'nothing') THEN 'family_unknown' END AS reason FROM
 (SELECT DISTINCT workflow_id, entry_id, 1 AS k FROM e) e FULL JOIN g USING (workflow_id, entry_id)) WHERE reason IS NOT NULL""".replace("e.entry_id IS NULL", "k IS NULL"))
def e19(spark, d):
    events = load(spark, d, "events")
    maps = events.where("event_type IN ('view', 'error') AND event_id % 13 <> 0").unionByName(events.where("event_id % 50 = 0 AND event_type = 'view'"))
    return ev.mapping_coverage(maps.selectExpr(*_split(MAPS)), events.selectExpr(
        "user_id AS workflow_id", "CAST(event_id AS STRING) AS entry_id", "event_type IN ('view', 'click') AS eligible"))


PAR = ("l_orderkey AS annotation_id, CASE WHEN l_linenumber < 4 THEN 'pdf' WHEN l_linenumber < 6 THEN 'png' ELSE 'html' END AS format, CASE WHEN l_partkey % 40 = 0 THEN 'i2' ELSE 'i1' END AS identity, 's' AS source_sha256, CASE WHEN l_suppkey % 20 = 0 THEN 'fail' ELSE 'pass' END AS status")


@query("e20_format_parity", f"""
WITH r AS (SELECT {PAR} FROM lineitem), u AS (SELECT annotation_id, max(k) AS most FROM (SELECT annotation_id, format, count(*) AS k FROM r GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT annotation_id, count(*) AS n, count(DISTINCT identity) AS i, bool_and(status='pass') AS ok FROM r GROUP BY 1)
SELECT annotation_id, n, concat_ws(',', CASE WHEN n < 2 THEN 'too_few_records' END, CASE WHEN i > 1 THEN 'identity_drift' END, CASE WHEN most > 1 THEN 'duplicate_format' END, CASE WHEN NOT ok THEN 'not_pass' END) AS failures FROM g JOIN u USING (annotation_id)""")
def e20(spark, d):
    return ev.format_parity(load(spark, d, "lineitem").selectExpr(*_split(PAR)))


PRE = ("doc_id AS record_id, sha256 AS content_before, CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE sha256 END AS content_after, sha256 AS text_order_before, sha256 AS text_order_after, "
       "CASE WHEN doc_id % 7 = 0 THEN 'z' ELSE sha256 END AS cjk_before, CASE WHEN doc_id % 7 = 0 THEN 'z' ELSE sha256 END AS cjk_after")


@query("e21_preservation_pairs", """SELECT doc_id AS record_id, concat_ws(',', CASE WHEN doc_id % 13 = 0 THEN 'content_drift' END, CASE WHEN doc_id % 7 = 0 THEN 'cjk_drift' END) AS failures FROM v_h1""")
def e21(spark, d):
    return ev.preservation_pairs(view(spark, d, "v_h1").selectExpr(*_split(PRE)), ["content", "text_order", "cjk"])


@query("e21_selection_coverage", """
WITH s AS (SELECT DISTINCT l_orderkey AS record_id, l_partkey AS region_id FROM lineitem WHERE l_linenumber < 6), m AS (SELECT l_orderkey AS record_id, l_partkey AS region_id, count(*) AS n FROM lineitem WHERE l_linenumber > 1 GROUP BY 1, 2)
SELECT * FROM (SELECT record_id, region_id, CASE WHEN k IS NULL THEN 'not_selected' WHEN n IS NULL THEN 'not_mapped' WHEN n > 1 THEN 'mapped_twice' END AS reason FROM (SELECT *, 1 AS k FROM s) s FULL JOIN m USING (record_id, region_id)) WHERE reason IS NOT NULL""")
def e21_selection(spark, d):
    items = load(spark, d, "lineitem").selectExpr("l_orderkey AS record_id", "l_partkey AS region_id", "l_linenumber")
    return ev.selection_coverage(items.where("l_linenumber < 6"), items.where("l_linenumber > 1"))


ATT = ("user_id AS task_id, event_id AS ord, event_type AS signature, props AS artifact_sha256")


@query("e22_attempt_convergence", """
WITH a AS (SELECT user_id AS task_id, event_id AS ord, event_type AS sg, props AS ar, row_number() OVER w AS rn, lag(event_type) OVER w AS ps, lag(props) OVER w AS pa FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT task_id, ord, CASE WHEN ord % 31 = 0 THEN 'sequence_invalid' WHEN rn > 40 THEN 'bound_exceeded' WHEN sg = ps THEN 'non_convergent_issue_set' WHEN ar = pa THEN 'non_convergent_artifact' ELSE 'valid' END AS outcome FROM a""")
def e22(spark, d):
    from ..functions import skew
    attempts = skew.number_rows(load(spark, d, "events").selectExpr(*_split(ATT)), ["task_id"], ["ord"], F.floor(F.col("ord") / 65536), "attempt")
    return ev.attempt_convergence(attempts.withColumn("attempt", F.expr("IF(ord % 31 = 0, 0, attempt)")), 40)


REL_A = "o_orderkey AS relation_id, concat('a', CAST(o_orderkey AS STRING)) AS annotation_id, 'src' AS source_sha256, 'i' AS identity"
MEA_A = ("concat('a', CAST(o_orderkey AS STRING)) AS annotation_id, CASE WHEN o_custkey % 7 = 0 THEN 'other' ELSE 'src' END AS source_sha256, CASE WHEN o_custkey % 11 = 0 THEN 'j' ELSE 'i' END AS identity, CASE WHEN o_custkey % 13 = 0 THEN 'fail' ELSE 'pass' END AS status")


@query("e23_attach_readback", """
SELECT o_orderkey AS relation_id, concat('a', CAST(o_orderkey AS VARCHAR)) AS annotation_id, CASE WHEN o_custkey % 17 = 0 THEN 'evidence_missing' WHEN o_custkey % 19 = 0 THEN 'evidence_ambiguous' WHEN o_custkey % 11 = 0 THEN 'identity_drift'
  WHEN o_custkey % 7 = 0 THEN 'source_drift' WHEN o_custkey % 13 = 0 THEN 'not_pass' ELSE 'attached' END AS outcome FROM orders""")
def e23(spark, d):
    orders = load(spark, d, "orders")
    seen = orders.where("o_custkey % 17 <> 0")
    return ev.attach_readback(orders.selectExpr(*_split(REL_A)), seen.unionByName(seen.where("o_custkey % 19 = 0")).selectExpr(*_split(MEA_A)))


ST24 = ("o_orderkey AS artifact_id, CASE CAST(o_custkey % 6 AS INT) WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'scanned_no_candidates' ELSE 'evaluated' END AS status, CASE WHEN o_custkey % 5 = 0 THEN 'fixture' ELSE 'live' END AS execution_mode, o_custkey % 7 <> 0 AS invoked, "
        "CASE WHEN o_custkey % 11 = 0 THEN 'timeout' WHEN o_custkey % 13 = 0 THEN NULL ELSE 'ok' END AS reason_code, o_custkey % 17 <> 0 AS formal, 'accepted' AS provider_status")


@query("e24_required_evaluation", f"""
WITH s AS (SELECT o_orderkey AS artifact_id, o_custkey % 23 <> 0 AS is_pdf, CASE WHEN o_custkey % 19 = 0 THEN 2 ELSE 0 END AS hard_count, o_custkey FROM orders), t AS (SELECT {ST24} FROM orders WHERE o_custkey % 29 <> 0),
c AS (SELECT l_orderkey AS artifact_id, bool_and(l_partkey % 15 <> 0) AS all_sent FROM lineitem WHERE l_linenumber > 3 GROUP BY 1),
j AS (SELECT s.artifact_id, is_pdf, hard_count, t.* EXCLUDE (artifact_id), all_sent, coalesce(status='evaluated' AND execution_mode='live' AND invoked AND reason_code='ok' AND formal, false) AS live FROM s LEFT JOIN t USING (artifact_id) LEFT JOIN c USING (artifact_id))
SELECT artifact_id, CASE WHEN NOT is_pdf OR coalesce(status='not_applicable', false) OR hard_count > 0 THEN 'not_applicable' WHEN status IS NULL THEN 'state_missing' WHEN live AND NOT coalesce(all_sent, true) THEN 'identity_drift' WHEN live THEN 'complete'
  WHEN status='evaluated' AND execution_mode='fixture' THEN 'fixture_only' WHEN status='scanned_no_candidates' THEN 'state_missing' WHEN reason_code <> 'ok' THEN 'reason_given' ELSE 'provider_unavailable' END AS outcome FROM j""")
def e24(spark, d):
    orders = load(spark, d, "orders")
    scans = orders.selectExpr("o_orderkey AS artifact_id", "o_custkey % 23 <> 0 AS is_pdf", "IF(o_custkey % 19 = 0, 2, 0) AS hard_count")
    chunks = load(spark, d, "lineitem").where("l_linenumber > 3").selectExpr("l_orderkey AS artifact_id", "l_partkey % 15 <> 0 AS invoked")
    return ev.required_evaluation(scans, orders.where("o_custkey % 29 <> 0").selectExpr(*_split(ST24)), chunks)


@query("e25_required_checks", """
SELECT o_orderkey AS artifact_id, CASE WHEN o_custkey % 13 = 0 THEN 'reported_errors' WHEN o_custkey % 7 = 0 OR o_custkey % 5 = 0 THEN 'required_check_failed' WHEN o_custkey % 3 = 0 AND o_custkey % 2 = 1 THEN 'applicable_check_missing'
  WHEN o_custkey % 11 = 0 THEN 'checks_differ_from_contract' ELSE 'pass' END AS outcome FROM orders""")
def e25(spark, d):
    checks = "IF(o_custkey % 2 = 0, map('page_load', o_custkey % 7 <> 0, 'interaction', o_custkey % 5 <> 0), map('page_load', o_custkey % 7 <> 0, 'finish', o_custkey % 5 <> 0)) AS checks"
    contract = ("IF(o_custkey % 2 = 0, map('interaction', IF(o_custkey % 11 = 0, NOT (o_custkey % 5 <> 0), o_custkey % 5 <> 0), 'page_load', o_custkey % 7 <> 0), "
                "map('page_load', IF(o_custkey % 11 = 0, NOT (o_custkey % 7 <> 0), o_custkey % 7 <> 0), 'finish', o_custkey % 5 <> 0)) AS contract_checks")
    return ev.required_checks(load(spark, d, "orders").selectExpr(
        "o_orderkey AS artifact_id", checks, contract, "map('interaction', o_custkey % 3 = 0, 'external_resources', true, 'webgl', false) AS applicability",
        "IF(o_custkey % 13 = 0, array('e'), filter(array('e'), x -> false)) AS errors"), ["page_load"])


TREE = ("concat('{\"a\": ', props, ', \"b\": [', CAST(event_id % 5 AS STRING), ', {\"c~x\": \"', event_type, '\"}, []], \"d/e\": null, \"f\": {}{extra}}')")


def _tree(extra: str) -> str:
    return TREE.replace("{extra}", extra)


@query("m1_to_leaves", """
SELECT event_id AS doc_id, '/a/k' AS pointer, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, '/b/0', CAST(event_id % 5 AS VARCHAR) FROM events
UNION ALL SELECT event_id, '/b/1/c~0x', concat('"', event_type, '"') FROM events UNION ALL SELECT event_id, '/b/2', '[]' FROM events UNION ALL SELECT event_id, '/d~1e', 'null' FROM events UNION ALL SELECT event_id, '/f', '{}' FROM events""")
def m1(spark, d):
    return mg.to_leaves(load(spark, d, "events").selectExpr("event_id AS doc_id", f"{_tree('')} AS body"), "body").select("doc_id", "pointer", "value")


def _role(spark, d, role: int):
    return view(spark, d, "v_leaves").where(f"role = {role}")


DIFF = """(SELECT * FROM (
 SELECT coalesce(b.doc_id, o.doc_id) AS doc_id, 1 AS role, coalesce(b.pointer, o.pointer) AS pointer, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN o.doc_id IS NULL THEN 'removed' WHEN b.value IS DISTINCT FROM o.value THEN 'changed' END AS change, b.value AS base_value, o.value AS value
 FROM (SELECT * FROM v_leaves WHERE role = 0) b FULL JOIN (SELECT * FROM v_leaves WHERE role = 1) o ON b.doc_id = o.doc_id AND b.pointer = o.pointer
 UNION ALL SELECT coalesce(b.doc_id, o.doc_id), 2, coalesce(b.pointer, o.pointer), CASE WHEN b.doc_id IS NULL THEN 'added' WHEN o.doc_id IS NULL THEN 'removed' WHEN b.value IS DISTINCT FROM o.value THEN 'changed' END, b.value, o.value
 FROM (SELECT * FROM v_leaves WHERE role = 0) b FULL JOIN (SELECT * FROM v_leaves WHERE role = 2) o ON b.doc_id = o.doc_id AND b.pointer = o.pointer) WHERE change IS NOT NULL)"""


def _diffs(spark, d):
    """Changes of roles 1 and 2 against the base."""
    base = _role(spark, d, 0).withColumn("role", F.explode(F.array(F.lit(1), F.lit(2))))
    other = view(spark, d, "v_leaves").where("role > 0")
    return mg.leaf_diff(base, other, ["doc_id", "role"])


@query("m2_leaf_diff", f"SELECT * FROM {DIFF}")
def m2(spark, d):
    return _diffs(spark, d)


@query("m3_shape_changes", """
SELECT event_id AS doc_id, '/g' AS pointer, CAST(event_id % 3 AS INT) AS base_size, CAST(event_id % 4 AS INT) AS other_size FROM events WHERE event_id % 3 <> event_id % 4""")
def m3(spark, d):
    events = load(spark, d, "events")

    def tree(n: int) -> str:
        items = f"IF(event_id % {n} = 0, '', array_join(transform(sequence(1, CAST(event_id % {n} AS INT)), x -> concat('{{\"v\": ', x, '}}')), ','))"
        return f"concat('{{\"a\": {{\"b\": [1, 2]}}, \"g\": [', {items}, ']}}') AS body"

    base = mg.to_leaves(events.selectExpr("event_id AS doc_id", tree(3)), "body")
    return mg.shape_changes(base, mg.to_leaves(events.selectExpr("event_id AS doc_id", tree(4)), "body"))


@query("m4_scope_check", f"SELECT doc_id, role, pointer, change FROM {DIFF} WHERE NOT (pointer LIKE '/view/%' OR regexp_matches(pointer, '^/click/[0-4]/k.$'))")
def m4(spark, d):
    return mg.scope_check(_diffs(spark, d), ["/view/*", "/click/[0-4]/k?"]).select("doc_id", "role", "pointer", "change")


# roles also touch whole branches
TOUCH = """(SELECT DISTINCT doc_id, role, CASE WHEN role = 1 AND CAST(substr(pointer, strpos(pointer, '/k') + 2) AS BIGINT) % 115 = 0 THEN substr(pointer, 1, strpos(pointer, '/k') - 1) ELSE pointer END AS pointer FROM {src})"""


@query("m5_path_conflicts", f"""
WITH t AS (SELECT * FROM {TOUCH.format(src=DIFF)})
SELECT a.doc_id, a.role AS upper_role, a.pointer AS upper_pointer, b.role AS lower_role, b.pointer AS lower_pointer FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.role <> b.role
WHERE (a.pointer = b.pointer AND a.role < b.role) OR starts_with(b.pointer, concat(a.pointer, '/'))""")
def m5(spark, d):
    number = F.regexp_extract("pointer", r"/k(\d+)$", 1).cast("long")
    cut = F.regexp_replace("pointer", r"/k\d+$", "")
    touched = _diffs(spark, d).select("doc_id", "role", F.when((F.col("role") == 1) & (number % 115 == 0), cut).otherwise(F.col("pointer")).alias("pointer")).distinct()
    return mg.path_conflicts(touched)


MERGED = f"""(WITH l AS (SELECT doc_id, pointer, arg_max(change, role) AS change, max(role) AS mr FROM {DIFF} GROUP BY 1, 2), c AS (SELECT l.*, d.value FROM l JOIN {DIFF} d ON d.doc_id = l.doc_id AND d.pointer = l.pointer AND d.role = l.mr)
SELECT coalesce(b.doc_id, c.doc_id) AS doc_id, coalesce(b.pointer, c.pointer) AS pointer, CASE WHEN c.change IS NULL THEN b.value ELSE c.value END AS value
FROM (SELECT * FROM v_leaves WHERE role = 0) b FULL JOIN c ON b.doc_id = c.doc_id AND b.pointer = c.pointer WHERE c.change IS NULL OR c.change <> 'removed')"""


@query("m6_merge_leaves", f"SELECT * FROM {MERGED}")
def m6(spark, d):
    return mg.merge_leaves(_role(spark, d, 0), _diffs(spark, d))


@query("m6_merge_recheck", f"""
WITH m AS {MERGED}, s AS (SELECT doc_id, pointer, CASE WHEN doc_id % 20 = 0 AND value IS NOT NULL THEN concat(value, '?') ELSE value END AS value FROM m WHERE NOT (doc_id % 20 = 1 AND pointer LIKE '/view/1/%'))
SELECT doc_id, pointer, change, base_value, value FROM (SELECT m.doc_id, m.pointer, CASE WHEN s.doc_id IS NULL THEN 'removed' WHEN m.value IS DISTINCT FROM s.value THEN 'changed' END AS change, m.value AS base_value, s.value FROM m LEFT JOIN s ON s.doc_id = m.doc_id AND s.pointer = m.pointer) WHERE change IS NOT NULL""")
def m6_recheck(spark, d):
    merged = m6(spark, d)
    stored = merged.where("NOT (doc_id % 20 = 1 AND pointer LIKE '/view/1/%')").withColumn(
        "value", F.expr("IF(doc_id % 20 = 0 AND value IS NOT NULL, concat(value, '?'), value)"))
    return mg.merge_recheck(merged, stored)


CHAIN = ("user_id AS task_id, event_id AS attempt, CASE WHEN event_id % 17 = 0 THEN 'odd' ELSE concat('h', CAST((event_id - 1) % 300 AS STRING)) END AS input_sha256, CASE WHEN event_id % 23 = 0 THEN concat('h', CAST((event_id - 1) % 300 AS STRING)) ELSE concat('h', CAST(event_id % 300 AS STRING)) END AS output_sha256, event_id % 29 = 0 AS text_changed")


@query("m7_attempt_chain", f"""
WITH a AS (SELECT {CHAIN} FROM events), b AS (SELECT *, lag(output_sha256) OVER w AS lo, row_number() OVER w AS rn, first_value(input_sha256) OVER w AS s0, min(attempt) OVER (PARTITION BY task_id, output_sha256) AS fa FROM a WINDOW w AS (PARTITION BY task_id ORDER BY attempt))
SELECT task_id, attempt, CASE WHEN rn > 50 THEN 'bound_exhausted' WHEN lo IS NOT NULL AND input_sha256 <> lo THEN 'input_mismatch' WHEN text_changed THEN 'text_violation' WHEN input_sha256 = output_sha256 THEN 'no_progress'
  WHEN fa < attempt OR s0 = output_sha256 THEN 'cycle' ELSE 'valid' END AS outcome FROM b""")
def m7(spark, d):
    return mg.attempt_chain(load(spark, d, "events").selectExpr(*_split(CHAIN)), 50)


RUN = "l_orderkey AS group_id, l_partkey * 10 AS start_ns, l_partkey * 10 + l_suppkey * 100 AS end_ns"


@query("m8_interval_overlap", f"SELECT group_id, count(*) AS n, count(*) > 1 AND max(start_ns) < min(end_ns) AS overlap FROM (SELECT {RUN} FROM lineitem) GROUP BY 1")
def m8(spark, d):
    return mg.interval_overlap(load(spark, d, "lineitem").selectExpr(*_split(RUN)))
