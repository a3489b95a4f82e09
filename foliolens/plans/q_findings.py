"""Queries over findings, review answers and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql as fsql
from ..functions.common import PAGE_KEY
from ..operators import findings as fi
from ..operators import layout_pairs as lp
from .q_layout import _split
from .registry import query
from .sqltext import INTER, OX, OY, PAGE, digest, pr
from .views import VIEW_SQL, _BUILDERS, load, view

FIND = ("CAST(floor(artifact_id / 8) AS BIGINT) AS artifact_id, CAST(artifact_id % 8 + 1 AS INT) AS page, box_id AS element_id, "
        "CASE CAST(line_index % 6 AS INT) WHEN 0 THEN 'overlap' WHEN 1 THEN 'clipping' WHEN 2 THEN 'low_vertical_content_occupancy' WHEN 3 THEN 'unclassified_source_overlap_or_gutter' "
        "WHEN 4 THEN 'content_block_spacing_candidate' ELSE 'badge_text_interference_candidate' END AS rule, "
        "CASE CAST(curves % 4 AS INT) WHEN 0 THEN 'fail' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'review' ELSE 'pass' END AS status, bold AS required, kind, "
        "concat('f', CAST(block_id AS STRING)) AS family, CASE WHEN filled THEN 'inter_block' ELSE 'intra_block' END AS scope, role AS upper_role, kind AS lower_role, "
        "CAST(curves AS DOUBLE) / 4 AS gap, CAST(curves AS DOUBLE) / 16 AS occupancy, CASE WHEN curves = 5 THEN NULL ELSE CAST(line_index AS DOUBLE) END AS overlap, CAST(curves AS DOUBLE) AS gutter, "
        "CAST(floor(x0 / 200) * 200 AS DOUBLE) AS x0, CAST(floor(y0 / 300) * 300 AS DOUBLE) AS y0, CAST(floor(x0 / 200) * 200 + 120 AS DOUBLE) AS x1, CAST(floor(y0 / 300) * 300 + 80 AS DOUBLE) AS y1")
VIEW_SQL["v_findings"] = f"SELECT {FIND} FROM v_boxes"
_BUILDERS["v_findings"] = lambda spark, d: view(spark, d, "v_boxes").selectExpr(*_split(FIND))
FPAGES = ("CAST(floor(artifact_id / 8) AS BIGINT) AS artifact_id, CAST(artifact_id % 8 + 1 AS INT) AS page, width, height")


def ident(names: list[str]) -> str:
    return "concat_ws('|', " + ", ".join(f"concat('{n}=', coalesce(CAST({n} AS VARCHAR), '~'))" for n in sorted(names)) + ")"


ID = ["artifact_id", "page", "rule", "element_id", "x0", "y0", "x1", "y1"]


@query("f1_finding_id", f"SELECT element_id, concat('finding-', substr(sha256({ident(ID)}), 1, 16)) AS finding_id FROM v_findings")
def f1(spark, d):
    return view(spark, d, "v_findings").select("element_id", fi.finding_id(ID).alias("finding_id"))


@query("f2_union_findings", """
SELECT artifact_id, page, rule, element_id, 'direct' AS source, gap, NULL AS reason FROM v_findings WHERE status <> 'pass'
UNION ALL SELECT artifact_id, page, rule, element_id, 'shared', NULL, 'shared observation' FROM v_findings WHERE rule NOT IN ('overlap', 'clipping')""")
def f2(spark, d):
    base = view(spark, d, "v_findings")
    covered = spark.createDataFrame([("shared", "overlap"), ("shared", "clipping")], "source string, rule string")
    return fi.union_findings({
        "direct": base.where("status <> 'pass'").select("artifact_id", "page", "rule", "element_id", "gap"),
        "shared": base.select("artifact_id", "page", "rule", "element_id", F.lit("shared observation").alias("reason"))}, covered).select(
        "artifact_id", "page", "rule", "element_id", "source", "gap", "reason")


REVIEW_IN = "rule IN ('content_block_spacing_candidate', 'badge_text_interference_candidate')"


@query("f3_bucket_severity", f"""
SELECT element_id, rule, CASE WHEN {REVIEW_IN} THEN 'review' ELSE 'hard' END AS severity, CASE WHEN {REVIEW_IN} THEN 'REVIEW_CANDIDATE' ELSE 'HARD_FAIL' END AS bucket FROM v_findings""")
def f3(spark, d):
    return fi.bucket_severity(view(spark, d, "v_findings")).select("element_id", "rule", "severity", "bucket")


@query("f4_rule_status", """
SELECT artifact_id, rule, list_extract(['pass','review','unsupported','fail'], max(CASE status WHEN 'fail' THEN 3 WHEN 'unsupported' THEN 2 WHEN 'review' THEN 1 ELSE 0 END) + 1) AS status,
  count(*) FILTER (WHERE status <> 'pass') AS finding_count FROM v_findings GROUP BY 1, 2""")
def f4(spark, d):
    return fi.rule_status(view(spark, d, "v_findings"), ["artifact_id", "rule"])


RANK = "max(CASE WHEN status='fail' THEN 4 WHEN status='unsupported' AND required THEN 3 WHEN status='review' THEN 2 WHEN status='unsupported' THEN 1 ELSE 0 END)"
NAMES = "['pass','unsupported','review','unsupported','fail']"


@query("f5_artifact_status", f"""
SELECT artifact_id, rule, list_extract({NAMES}, {RANK} + 1) AS status, count(*) AS n, CAST(grouping(artifact_id, rule) AS BIGINT) AS level FROM v_findings GROUP BY ROLLUP (artifact_id, rule)""")
def f5(spark, d):
    return fi.artifact_status(view(spark, d, "v_findings"))


@query("f5_overlap_report", f"""
WITH p AS (SELECT a.artifact_id, a.page, concat_ws('/', a.box_id, b.box_id) AS element_id, greatest(a.x0,b.x0) AS x0, greatest(a.y0,b.y0) AS y0, least(a.x1,b.x1) AS x1, least(a.y1,b.y1) AS y1
  FROM v_boxes a JOIN v_boxes b ON {PAGE} AND a.box_id < b.box_id WHERE {OX} > 0 AND {OY} > 0 AND NOT (a.block_id = b.block_id AND abs(a.baseline_y - b.baseline_y) > 0.75)),
g AS (SELECT a.artifact_id, a.page, concat_ws('/', a.box_id, b.box_id) AS element_id, CAST(NULL AS DOUBLE) AS x0, CAST(NULL AS DOUBLE) AS y0, CAST(NULL AS DOUBLE) AS x1, CAST(NULL AS DOUBLE) AS y1
  FROM v_boxes a JOIN v_boxes b ON {PAGE} AND a.box_id < b.box_id WHERE a.block_id <> b.block_id AND {OX} >= 0 AND -{OY} > 0 AND -{OY} < 12),
f AS (SELECT *, 'overlap' AS rule, 'fail' AS status, true AS required FROM p UNION ALL SELECT *, 'minimum_gap', 'review', false FROM g),
h AS (SELECT *, concat('finding-', substr(sha256({ident(ID)}), 1, 16)) AS finding_id FROM f)
SELECT artifact_id, rule, list_extract({NAMES}, {RANK} + 1) AS status, count(*) AS n, min(finding_id) AS first_finding, CAST(grouping(artifact_id, rule) AS BIGINT) AS level FROM h GROUP BY ROLLUP (artifact_id, rule)""")
def overlap_report(spark, d):
    """Flagship: overlaps and tight gaps to identified findings and a corpus roll-up."""
    boxes = view(spark, d, "v_boxes")
    pair = F.concat_ws("/", "box_a", "box_b").alias("element_id")
    over = lp.overlap_pairs(boxes).select(*PAGE_KEY, pair, "x0", "y0", "x1", "y1", F.lit("overlap").alias("rule"), F.lit("fail").alias("status"), F.lit(True).alias("required"))
    none = [F.lit(None).cast("double").alias(e) for e in ("x0", "y0", "x1", "y1")]
    tight = lp.min_gap_pairs(boxes, 12.0).select(*PAGE_KEY, pair, *none, F.lit("minimum_gap").alias("rule"), F.lit("review").alias("status"), F.lit(False).alias("required"))
    found = over.unionByName(tight).withColumn("finding_id", fi.finding_id(ID))
    out = found.rollup("artifact_id", "rule").agg(
        F.max(fi.artifact_rank()).alias("k"), F.count(F.lit(1)).alias("n"), F.min("finding_id").alias("first_finding"), F.grouping_id().alias("level"))
    return out.select("artifact_id", "rule", F.element_at(F.array(*map(F.lit, fi.ARTIFACT_ORDER)), F.col("k") + 1).alias("status"), "n", "first_finding", "level")


@query("f6_set_hash", f"SELECT artifact_id, {digest('h')} AS set_hash, count(*) AS n FROM (SELECT artifact_id, sha256({ident(ID)}) AS h FROM v_findings) GROUP BY 1")
def f6(spark, d):
    return fi.set_hash(view(spark, d, "v_findings"), ["artifact_id"], ID)


def bandsql(v: str, s: str) -> str:
    return f"({pr(f'({v}) / {s}::DOUBLE', 0)} * {s}::DOUBLE)"


KEYED = f"""k AS (SELECT f.*, {pr('x0/width', 2)} AS nx0, {pr('y0/height', 2)} AS ny0, {pr('x1/width', 2)} AS nx1, {pr('y1/height', 2)} AS ny1,
  CASE WHEN rule='low_vertical_content_occupancy' THEN {bandsql('occupancy', '0.05')} ELSE {bandsql('overlap', '2.0')} END AS band1,
  CASE WHEN rule<>'low_vertical_content_occupancy' THEN {bandsql('gutter', '2.0')} END AS band2
  FROM v_findings f JOIN (SELECT {FPAGES} FROM v_pages) p USING (artifact_id, page))"""
RK = "artifact_id, rule, nx0, ny0, nx1, ny1, band1, band2"


def grouped_sql(keys: str, src: str) -> str:
    return f"""SELECT {keys}, arg_min(page, (page, element_id)) AS page, arg_min(element_id, (page, element_id)) AS element_id, count(*) AS affected_count,
  count(DISTINCT page) AS affected_pages, max(page) AS last_page FROM {src} GROUP BY {keys}"""


@query("f7_coalesce_reviews", f"WITH {KEYED} {grouped_sql(RK, 'k')}")
def f7(spark, d):
    return fi.coalesce_reviews(view(spark, d, "v_findings"), view(spark, d, "v_pages").selectExpr(*_split(FPAGES)))


@query("f7_review_members", f"WITH {KEYED} SELECT DISTINCT {RK}, page, element_id FROM k")
def f7_members(spark, d):
    return fi.review_members(view(spark, d, "v_findings"), view(spark, d, "v_pages").selectExpr(*_split(FPAGES)))


SPACE = ("CASE WHEN line_index % 6 = 4 THEN 'content_block_spacing_candidate' WHEN line_index % 6 = 5 THEN 'content_block_vertical_association_unspecified' ELSE 'content_block_geometry_relation_ambiguous' END")
SP_COLS = (f"CAST(floor(artifact_id / 8) AS BIGINT) AS artifact_id, CAST(artifact_id % 8 + 1 AS INT) AS page, box_id AS element_id, {SPACE} AS rule, concat('rel', CAST(curves AS STRING)) AS relation_id, kind AS relation_type, "
           "CASE WHEN bold THEN 'attached' ELSE 'separate' END AS mode, CASE WHEN filled THEN 'r1' ELSE 'r2' END AS reason_code, CASE WHEN filled THEN 'inter_block' ELSE 'intra_block' END AS scope, role AS upper_role, kind AS lower_role, CAST(curves AS DOUBLE) / 4 AS gap")


SPACED = f"""WITH s AS (SELECT {SP_COLS} FROM v_boxes),
k AS (SELECT *, rule = 'content_block_vertical_association_unspecified' AS va, rule = 'content_block_geometry_relation_ambiguous' AS ga FROM s),
m AS (SELECT *, CASE WHEN va THEN relation_id WHEN ga THEN relation_type ELSE scope END AS k1, CASE WHEN va OR ga THEN mode ELSE upper_role END AS k2,
  CASE WHEN ga THEN reason_code WHEN NOT va THEN lower_role END AS k3, CASE WHEN NOT va AND NOT ga THEN {bandsql('gap', '0.5')} END AS band1 FROM k)"""


@query("f8_coalesce_spacing", f"{SPACED} {grouped_sql('artifact_id, rule, k1, k2, k3, band1', 'm')}")
def f8(spark, d):
    return fi.coalesce_spacing(view(spark, d, "v_boxes").selectExpr(*_split(SP_COLS)))


@query("f8_spacing_members", f"{SPACED} SELECT DISTINCT artifact_id, rule, k1, k2, k3, band1, page, element_id FROM m")
def f8_members(spark, d):
    return fi.spacing_members(view(spark, d, "v_boxes").selectExpr(*_split(SP_COLS)))


RANKED = "row_number() OVER (PARTITION BY artifact_id ORDER BY rule, page, element_id, nx0, ny0, nx1, ny1, band1, band2)"


@query("f9_overflow_members", f"""
WITH {KEYED}, g AS ({grouped_sql(RK, 'k')}),
r AS (SELECT *, {RANKED} AS rn, count(*) OVER (PARTITION BY artifact_id) AS tot FROM g)
SELECT {RK}, page, element_id, rn AS rank, tot > 6 AND rn >= 6 AS folded, CASE WHEN tot > 6 AND rn >= 6 THEN 6 ELSE rn END AS slot FROM r""")
def f9_members(spark, d):
    return fi.place_groups(f7(spark, d), 6, F9_ORDER).select(*fi.REVIEW_KEY, "page", "element_id", "rank", "folded", "slot")


F9_ORDER = ["rule", "page", "element_id", "nx0", "ny0", "nx1", "ny1", "band1", "band2"]


@query("f9_overflow_group", f"""
WITH {KEYED}, g AS ({grouped_sql(RK, 'k')}),
r AS (SELECT *, {RANKED} AS rn, count(*) OVER (PARTITION BY artifact_id) AS tot FROM g)
SELECT artifact_id, rule, page, element_id, affected_count, CAST(1 AS BIGINT) AS group_count FROM r WHERE tot <= 6 OR rn < 6
UNION ALL SELECT artifact_id, 'review_group_overflow', arg_min(page, rn), arg_min(element_id, rn), sum(affected_count)::BIGINT, count(*) FROM r WHERE tot > 6 AND rn >= 6 GROUP BY artifact_id""")
def f9(spark, d):
    return fi.cap_groups(f7(spark, d), 6, F9_ORDER)


@query("f10_family_sample", """
WITH j AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY artifact_id, family ORDER BY page, kind, element_id) = 1 THEN 0 ELSE 1 END AS turn FROM v_findings),
r AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY turn, CASE WHEN turn = 0 THEN CASE family WHEN 'f2' THEN 0 WHEN 'f0' THEN 1 ELSE 2 END ELSE 0 END, page, kind, element_id) AS rank FROM j)
SELECT artifact_id, rank, family, page, kind, element_id, rank <= 10 AS selected FROM r""")
def f10(spark, d):
    return fi.family_sample(view(spark, d, "v_findings"), 10, ["f2", "f0", "f1"])


DUP = "event_id AS ord, CASE WHEN event_id % 3 = 0 THEN concat('c', CAST(event_id % 500 AS STRING)) WHEN event_id % 3 = 1 THEN '' END AS id, event_type, props"


@query("f11_dedupe_first", f"""
WITH e AS (SELECT {DUP} FROM events), i AS (SELECT *, CASE WHEN id <> '' THEN concat('id:', id) ELSE concat('sha:', sha256({ident(['event_type', 'props'])})) END AS k FROM e)
SELECT ord, id, event_type, props FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS rn FROM i) WHERE rn = 1""")
def f11(spark, d):
    return fi.dedupe_first(load(spark, d, "events").selectExpr(*_split(DUP)), "ord", ["event_type", "props"])


ELIG = "user_id AS artifact_id, event_id AS ord, event_type <> 'error' AS complete"


@query("f12_eligible_cap", f"""
WITH e AS (SELECT {ELIG} FROM events), r AS (SELECT *, sum(CASE WHEN complete THEN 1 ELSE 0 END) OVER (PARTITION BY artifact_id ORDER BY ord) AS k FROM e)
SELECT artifact_id, ord, CASE WHEN NOT complete THEN 'projection_incomplete' WHEN k <= 20 THEN 'eligible' ELSE 'candidate_limit_exceeded' END AS status FROM r""")
def f12(spark, d):
    return fi.eligible_cap(load(spark, d, "events").selectExpr(*_split(ELIG)), 20)


PCAND = ("artifact_id, concat('c', box_id) AS candidate_id, CASE CAST(line_index % 4 AS INT) WHEN 0 THEN 'line_spacing_candidate' WHEN 1 THEN 'unclassified_source_overlap_or_gutter' WHEN 2 THEN 'content_block_spacing_candidate' "
         "ELSE CASE WHEN bold THEN 'other' ELSE 'unclassified_source_overlap_or_gutter' END END AS rule, CASE WHEN curves = 1 THEN NULL ELSE page END AS page, CAST(curves - 2 AS DOUBLE) AS overlap, "
         "CASE WHEN curves = 3 AND line_index % 2 = 0 THEN NULL ELSE concat(box_id, '/r') END AS first_id, concat(box_id, CASE WHEN curves = 4 THEN '/none' ELSE '/r2' END) AS second_id, curves <> 5 AS has_bbox, "
         "CASE WHEN curves <> 6 THEN 'l1' END AS line_ids, CASE WHEN curves = 7 THEN 'px' ELSE 'pt' END AS units, NOT bold AS has_roles, filled AS has_relationship")
PREG = ("SELECT artifact_id, concat(box_id, '/r') AS region_id, x0, y0, x1, y1, CASE WHEN filled THEN line_index END AS source_order, CASE WHEN stroked THEN true END AS known_occlusion FROM {0} "
        "UNION ALL SELECT artifact_id, concat(box_id, '/r2'), x0 + 5, y0 + 3, x1 + 40, y1 + 30, line_index, CAST(NULL AS BOOLEAN) FROM {0}")


@query("f13_project_candidates", f"""
WITH c AS (SELECT {PCAND} FROM v_boxes), r AS ({PREG.format('v_boxes')}),
j AS (SELECT c.*, CASE WHEN rule='unclassified_source_overlap_or_gutter' THEN 'source_overlap' WHEN rule='other' THEN NULL ELSE 'measured_spacing' END AS ct,
  a.x0 ax0, a.y0 ay0, a.x1 ax1, a.y1 ay1, a.source_order ao, a.known_occlusion ak, b.x0 bx0, b.y0 b_y0, b.x1 bx1, b.y1 b_y1, b.source_order bo, b.known_occlusion bk
  FROM c LEFT JOIN r a ON a.artifact_id = c.artifact_id AND a.region_id = c.first_id LEFT JOIN r b ON b.artifact_id = c.artifact_id AND b.region_id = c.second_id),
k AS (SELECT *, CASE WHEN ct IS NULL THEN 'unsupported_candidate_type' WHEN ct='source_overlap' AND NOT overlap > 0 THEN 'non_overlap_candidate' WHEN ct='source_overlap' AND (ax0 IS NULL OR bx0 IS NULL) THEN 'member_geometry_missing' END AS reason,
  CASE WHEN ct='source_overlap' THEN concat_ws(',', CASE WHEN ao IS NULL OR bo IS NULL THEN 'source_stacking_order' END, 'rendered_stacking_order', CASE WHEN ak IS NULL AND bk IS NULL THEN 'known_occlusion' END)
   ELSE concat_ws(',', CASE WHEN page IS NULL THEN 'page' END, CASE WHEN NOT has_bbox THEN 'spacing_bbox' END, CASE WHEN first_id IS NULL THEN 'source_shape_ids' END,
    CASE WHEN rule='line_spacing_candidate' AND line_ids IS NULL THEN 'pdf_line_ids' END, CASE WHEN units <> 'pt' THEN 'explicit_units_pt' END, CASE WHEN NOT has_roles THEN 'roles' END, CASE WHEN NOT has_relationship THEN 'relationship' END) END AS mi,
  greatest(0.0, least(ax1,bx1)-greatest(ax0,bx0)) * greatest(0.0, least(ay1,b_y1)-greatest(ay0,b_y0)) AS ar, least((ax1-ax0)*(ay1-ay0), (bx1-bx0)*(b_y1-b_y0)) AS sm FROM j)
SELECT artifact_id, candidate_id, ct AS candidate_type, CASE WHEN reason IS NULL AND ct='source_overlap' THEN {pr('ar', 3)} END AS overlap_area,
  CASE WHEN reason IS NULL AND ct='source_overlap' AND sm > 0 THEN {pr('ar / sm', 6)} END AS overlap_ratio, CASE WHEN reason IS NULL THEN mi END AS missing_information,
  reason IS NULL AND (ct='source_overlap' OR mi = '') AS complete, reason FROM k""")
def f13(spark, d):
    boxes = view(spark, d, "v_boxes")
    second = boxes.selectExpr("artifact_id", "concat(box_id, '/r2') AS region_id", "x0 + 5 AS x0", "y0 + 3 AS y0", "x1 + 40 AS x1", "y1 + 30 AS y1",
                              "line_index AS source_order", "CAST(NULL AS BOOLEAN) AS known_occlusion")
    first = boxes.selectExpr("artifact_id", "concat(box_id, '/r') AS region_id", "x0", "y0", "x1", "y1", "IF(filled, line_index, NULL) AS source_order",
                             "IF(stroked, true, NULL) AS known_occlusion")
    return fi.project_candidates(boxes.selectExpr(*_split(PCAND)), first.unionByName(second))


EP = "user_id AS artifact_id, CAST(event_id AS BIGINT) AS page"
EC = "user_id AS artifact_id, event_id AS ord, event_id AS page, event_type <> 'error' AS has_bbox"


@query("f14_select_pages", f"""
WITH p AS (SELECT user_id AS artifact_id, event_id AS page, event_type IN ('view', 'click', 'error') AS sel FROM events),
r AS (SELECT *, sum(CASE WHEN sel THEN 1 ELSE 0 END) OVER (PARTITION BY artifact_id ORDER BY page) AS k FROM p)
SELECT artifact_id, page, CASE WHEN NOT sel THEN 'not_selected' WHEN k > 15 THEN 'max_pages' ELSE 'judged' END AS outcome FROM r""")
def f14(spark, d):
    events = load(spark, d, "events")
    return fi.select_pages(events.selectExpr(*_split(EP)), events.where("event_type IN ('view', 'click', 'error')").selectExpr(*_split(EP)), 15)


@query("f14_select_candidates", f"""
WITH p AS (SELECT {EC}, event_type IN ('view', 'click', 'error') AS sel FROM events),
r AS (SELECT *, sum(CASE WHEN sel AND has_bbox THEN 1 ELSE 0 END) OVER (PARTITION BY artifact_id ORDER BY ord) AS k FROM p)
SELECT artifact_id, ord, CASE WHEN NOT sel THEN 'page_not_selected' WHEN k > 8 OR (k = 8 AND NOT has_bbox) THEN 'max_candidate_calls' WHEN NOT has_bbox THEN 'no_page_bbox' ELSE 'called' END AS outcome FROM r""")
def f14_candidates(spark, d):
    events = load(spark, d, "events")
    return fi.select_candidates(events.selectExpr(*_split(EC)), events.where("event_type IN ('view', 'click', 'error')").selectExpr(*_split(EP)), 8)


PACK = "user_id AS request_id, event_id AS ord, CASE WHEN user_id % 17 = 0 AND event_id % 7 = 0 THEN 1600 ELSE 100 + event_id % 900 END AS size"


@query("f15_pack_chunks", f"""
WITH RECURSIVE e AS (SELECT {PACK}, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
ok AS (SELECT request_id FROM e GROUP BY 1 HAVING sum(size) <= 60000 AND max(size) <= 1500),
w AS (SELECT e.request_id, e.ord, e.rn, 0 AS chunk, e.size AS used, e.size FROM e JOIN ok USING (request_id) WHERE rn = 1
 UNION ALL SELECT e.request_id, e.ord, e.rn, CASE WHEN w.used + e.size <= 1500 THEN w.chunk ELSE w.chunk + 1 END, CASE WHEN w.used + e.size <= 1500 THEN w.used + e.size ELSE e.size END, e.size
  FROM w JOIN e ON e.request_id = w.request_id AND e.rn = w.rn + 1)
SELECT request_id, ord, chunk, 'packed' AS status FROM w
UNION ALL SELECT request_id, ord, NULL, CASE WHEN sum(size) OVER (PARTITION BY request_id) > 60000 THEN 'request_too_large' ELSE 'row_too_large' END FROM e WHERE request_id NOT IN (SELECT request_id FROM ok)""")
def f15(spark, d):
    return fi.pack_chunks(load(spark, d, "events").selectExpr(*_split(PACK)), 1500, 60000)


SENT = ("l_orderkey AS request_id, l_linenumber - 1 AS index, l_linenumber <= l_orderkey % 8 OR (l_orderkey % 13 = 0 AND l_linenumber = 6) AS invoked, l_orderkey % 3 > 0 AS resolved")


@query("f16_chunk_prefix", """
WITH c AS (SELECT DISTINCT l_orderkey AS request_id, l_linenumber - 1 AS idx, l_linenumber <= l_orderkey % 8 OR (l_orderkey % 13 = 0 AND l_linenumber = 6) AS invoked, l_orderkey % 3 > 0 AS resolved FROM lineitem),
p AS (SELECT *, lag(invoked) OVER (PARTITION BY request_id ORDER BY idx) AS before, row_number() OVER (PARTITION BY request_id ORDER BY idx) AS rn FROM (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY idx) - 1 AS idx, invoked, resolved FROM c))
SELECT request_id, count(*) AS n, count(*) FILTER (WHERE invoked) AS sent,
  bool_or(invoked AND rn = 1) AND NOT coalesce(bool_or(invoked AND NOT before), false) AND (NOT bool_and(resolved) OR bool_and(invoked)) AS valid FROM p GROUP BY 1""")
def f16(spark, d):
    from ..functions import skew
    chunks = load(spark, d, "lineitem").selectExpr(*_split(SENT)).distinct()
    numbered = skew.number_rows(chunks, ["request_id"], ["index"], F.floor(F.col("index") / 4096), "rn")
    return fi.chunk_prefix(numbered.withColumn("index", F.col("rn") - 1))


CH = ["intended", "acceptable", "repair_required", "insufficient_information"]
ANS = ("event_id AS answer_id, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'intended' WHEN 1 THEN 'acceptable' WHEN 2 THEN 'repair_required' WHEN 3 THEN 'insufficient_information' WHEN 4 THEN 'maybe' END AS choice, "
       "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 40 AS DOUBLE) / 32 END AS confidence, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 6 AS INT) END AS impact, event_id % 2 = 0 AS needs_probabilities")


@query("f17_answer_validate", f"""
WITH a AS (SELECT {ANS}, event_id % 7 AS k FROM events),
p AS (SELECT *, k IN (1, 2, 3, 4, 6) AND NOT (k = 4) AS complete, k > 0 AS given FROM a)
SELECT answer_id, concat_ws(',', CASE WHEN choice IS NULL OR choice = 'maybe' THEN 'choice' END, CASE WHEN CASE WHEN needs_probabilities THEN NOT (given AND k IN (1,2,3)) ELSE given AND NOT k IN (1,2,3) END THEN 'probabilities' END,
  CASE WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'confidence' END, CASE WHEN impact NOT IN (0,1,2,3) THEN 'impact' END) AS failures FROM p""")
def f17(spark, d):
    prob = ("CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 IN (1,2,3) THEN map('intended', 0.25D, 'acceptable', 0.25D, 'repair_required', 0.5D, 'insufficient_information', 0D) "
            "WHEN event_id % 7 = 4 THEN map('intended', 1.25D, 'acceptable', 0D, 'repair_required', 0D, 'insufficient_information', 0D) ELSE map('intended', 1D) END AS probabilities")
    return fi.answers_valid(load(spark, d, "events").selectExpr(*_split(ANS), prob), CH)


TIER = ("event_id AS answer_id, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'intended' WHEN 1 THEN 'acceptable' WHEN 2 THEN 'repair_required' WHEN 3 THEN 'insufficient_information' ELSE 'other' END AS choice, "
        "CAST(event_id % 16 AS DOUBLE) / 16 AS confidence, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id % 10 AS DOUBLE) / 16 END AS breakage, CAST(event_id % 12 AS DOUBLE) / 16 AS unnatural")


@query("f18_label_tiers", f"""
SELECT answer_id, CASE WHEN (choice='repair_required' AND confidence >= 0.5) OR coalesce(breakage, 0) >= 0.5 THEN 'repair_required' WHEN choice='repair_required' OR unnatural >= 0.5 THEN 'differs_from_surroundings'
  WHEN choice <> 'other' THEN choice ELSE 'insufficient_information' END AS label FROM (SELECT {TIER} FROM events)""")
def f18(spark, d):
    return load(spark, d, "events").selectExpr(*_split(TIER)).select("answer_id", fi.label_tiers(
        F.col("choice"), F.col("confidence"), F.col("breakage"), F.col("unnatural")).alias("label"))


@query("sql_label_tier", f"""
SELECT answer_id, CASE WHEN (choice='repair_required' AND confidence >= 0.5) OR coalesce(breakage, 0) >= 0.5 THEN 'repair_required' WHEN choice='repair_required' OR unnatural >= 0.5 THEN 'differs_from_surroundings'
  WHEN choice <> 'other' THEN choice ELSE 'insufficient_information' END AS label FROM (SELECT {TIER} FROM events)""")
def sql_label_tier(spark, d):
    fsql.register(spark)
    return load(spark, d, "events").selectExpr(*_split(TIER)).selectExpr("answer_id", "label_tier(choice, confidence, breakage, unnatural) AS label")


CHOICE = "user_id AS artifact_id, CASE WHEN user_id % 5 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'intended' ELSE 'acceptable' END WHEN user_id % 5 = 1 AND event_type = 'error' THEN 'repair_required' WHEN event_type = 'view' THEN 'unresolved' ELSE 'intended' END AS choice"


@query("f19_branch_decision", f"""
SELECT artifact_id, list_extract(['maintain','request_information','adjust'], max(CASE WHEN choice='repair_required' THEN 2 WHEN choice IN ('intended','acceptable') THEN 0 ELSE 1 END) + 1) AS decision, count(*) AS n
FROM (SELECT {CHOICE} FROM events) GROUP BY 1""")
def f19(spark, d):
    return fi.branch_decision(load(spark, d, "events").selectExpr(*_split(CHOICE)), ["artifact_id"])


CRIT = ("l_orderkey AS request_id, l_partkey AS candidate_id, CASE WHEN l_suppkey % 40 = 1 THEN 'fail' WHEN l_suppkey % 40 = 2 THEN 'non_japanese_glyph_likely' WHEN l_suppkey % 10 = 3 THEN 'uncertain' ELSE 'pass' END AS status")


@query("f20_criteria_disposition", f"""
WITH k AS (SELECT request_id, candidate_id, max(CASE WHEN status IN ('fail','non_japanese_glyph_likely') THEN 2 WHEN status='uncertain' THEN 1 ELSE 0 END) AS k FROM (SELECT {CRIT} FROM lineitem) GROUP BY 1, 2)
SELECT request_id, list_extract(['accepted','uncertain','repair_required'], max(k) + 1) AS disposition, count(*) AS candidates, count(*) FILTER (WHERE k = 2) AS repairs FROM k GROUP BY 1""")
def f20(spark, d):
    return fi.request_disposition(load(spark, d, "lineitem").selectExpr(*_split(CRIT)))


RC = ("artifact_id, box_id AS candidate_id, CASE WHEN line_index % 3 = 0 THEN 'line_spacing_candidate' ELSE 'overlap' END AS rule, page, x0, y0, x1, y1, 'h1' AS render_sha256")
RV = ("artifact_id, CASE WHEN curves = 1 THEN concat(box_id, '-x') ELSE box_id END AS candidate_id, CASE WHEN line_index % 3 = 0 THEN 'line_spacing_candidate' ELSE 'overlap' END AS rule, page, x0, y0, CASE WHEN curves = 2 THEN x1 + 1 ELSE x1 END AS x1, y1, "
      "CASE WHEN curves = 3 THEN 'h2' ELSE 'h1' END AS render_sha256, CASE WHEN curves = 4 THEN 'rejected' ELSE 'accepted' END AS status")


@query("f21_review_coverage", f"""
WITH c AS (SELECT {RC} FROM v_boxes), v AS (SELECT {RV} FROM v_boxes UNION ALL SELECT {RV} FROM v_boxes WHERE curves = 6),
g AS (SELECT artifact_id, candidate_id, count(*) AS n, min(rule) AS vr, min(x1) AS vx1, min(render_sha256) AS vh, min(status) AS st FROM v GROUP BY 1, 2),
j AS (SELECT artifact_id, candidate_id, CASE WHEN c.rule IS NULL THEN 'unknown_candidate' WHEN n IS NULL THEN 'not_reviewed' WHEN n > 1 THEN 'reviewed_twice' WHEN x1 <> vx1 OR render_sha256 <> vh THEN 'binding_mismatch'
  WHEN rule <> 'line_spacing_candidate' AND st <> 'accepted' THEN 'status_not_allowed' END AS reason FROM c FULL JOIN g USING (artifact_id, candidate_id))
SELECT * FROM j WHERE reason IS NOT NULL""")
def f21(spark, d):
    boxes = view(spark, d, "v_boxes")
    reviews = boxes.selectExpr(*_split(RV)).unionByName(boxes.where("curves = 6").selectExpr(*_split(RV)))
    return fi.review_coverage(boxes.selectExpr(*_split(RC)), reviews)


@query("f22_one_accepted_per_group", """
SELECT artifact_id, block_id AS group_key, count(*) FILTER (WHERE curves = 4) AS accepted, count(*) AS n FROM v_boxes GROUP BY 1, 2 HAVING count(*) FILTER (WHERE curves = 4) <> 1""")
def f22(spark, d):
    return fi.one_accepted(view(spark, d, "v_boxes").selectExpr("artifact_id", "block_id AS group_key", "IF(curves = 4, 'accepted', 'rejected') AS status"))


RAW = "concat('r', CAST(p_partkey AS STRING)) AS finding_id, p_type AS rule, CASE WHEN p_size % 2 = 0 THEN 'review' ELSE 'unsupported' END AS status"
PRIOR = ("concat('p', CAST(p_partkey AS STRING)) AS finding_id, concat('r', CAST(CASE WHEN p_partkey % 97 = 5 THEN p_partkey + 1 ELSE p_partkey END AS STRING)) AS raw_id, CASE WHEN p_partkey % 53 = 7 THEN 'changed' ELSE p_type END AS rule, "
         "CASE WHEN p_size % 2 = 0 THEN 'review' ELSE 'unsupported' END AS status, CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'unknown' WHEN 1 THEN 'intentional' ELSE 'repaired' END AS disposition")
RES = ("concat('p', CAST(p_partkey AS STRING)) AS finding_id, concat('r', CAST(CASE WHEN p_partkey % 41 = 0 THEN p_partkey + 3 ELSE p_partkey END AS STRING)) AS raw_id, CASE WHEN p_partkey % 37 = 0 THEN 'defect' ELSE 'intentional_normal' END AS verdict")
PRES = ("concat('p', CAST(p_partkey AS STRING)) AS finding_id, concat('r', CAST(p_partkey AS STRING)) AS raw_id, CASE WHEN p_partkey % 43 = 0 THEN 'unknown' WHEN p_partkey % 3 = 1 THEN 'intentional' ELSE 'repaired' END AS disposition")


@query("f23_disposition_overlay", f"""
WITH raw AS (SELECT {RAW} FROM part), prior AS (SELECT {PRIOR} FROM part), targets AS (SELECT 'p' || p_partkey AS finding_id FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 59 <> 0),
res AS (SELECT {RES}, p_partkey % 31 AS k FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 61 <> 0 UNION ALL SELECT {RES}, p_partkey % 31 FROM part WHERE p_partkey % 300 = 0 AND p_partkey % 61 <> 0),
pres AS (SELECT {PRES} FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 67 <> 0),
s AS (SELECT res.*, prior.raw_id AS praw FROM res LEFT JOIN prior USING (finding_id)),
k AS (SELECT pres.*, prior.raw_id AS praw, prior.disposition AS pd FROM pres LEFT JOIN prior USING (finding_id)),
o AS (
SELECT raw_id AS finding_id, 'prior_raw_finding_repeated' AS reason FROM prior GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT finding_id, 'prior_raw_finding_set_mismatch' FROM ((SELECT raw_id AS finding_id FROM prior EXCEPT SELECT finding_id FROM raw) UNION ALL (SELECT finding_id FROM raw EXCEPT SELECT raw_id FROM prior))
UNION ALL SELECT prior.finding_id, 'prior_raw_mapping_changed' FROM prior JOIN raw ON raw.finding_id = prior.raw_id WHERE prior.rule <> raw.rule OR prior.status <> raw.status
UNION ALL SELECT finding_id, 'target_coverage_mismatch' FROM ((SELECT finding_id FROM targets EXCEPT SELECT finding_id FROM prior WHERE disposition='unknown') UNION ALL (SELECT finding_id FROM prior WHERE disposition='unknown' EXCEPT SELECT finding_id FROM targets))
UNION ALL SELECT finding_id, 'duplicate_resolution_ids' FROM res GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT finding_id, 'resolution_target_coverage_mismatch' FROM ((SELECT finding_id FROM res EXCEPT SELECT finding_id FROM targets) UNION ALL (SELECT finding_id FROM targets EXCEPT SELECT finding_id FROM res))
UNION ALL SELECT finding_id, 'target_not_resolved_as_normal' FROM s WHERE verdict <> 'intentional_normal'
UNION ALL SELECT finding_id, 'original_current_mapping_changed' FROM s WHERE raw_id IS DISTINCT FROM praw
UNION ALL SELECT finding_id, 'insufficient_resolution_evidence' FROM s WHERE k = 0
UNION ALL SELECT finding_id, 'resolution_evidence_roles_missing' FROM s WHERE k IN (0, 1)
UNION ALL SELECT finding_id, 'preserved_prior_coverage_mismatch' FROM ((SELECT finding_id FROM pres EXCEPT (SELECT finding_id FROM prior EXCEPT SELECT finding_id FROM targets)) UNION ALL ((SELECT finding_id FROM prior EXCEPT SELECT finding_id FROM targets) EXCEPT SELECT finding_id FROM pres))
UNION ALL SELECT finding_id, 'preserved_prior_mapping_changed' FROM k WHERE disposition NOT IN ('intentional','repaired') OR disposition IS DISTINCT FROM pd OR raw_id IS DISTINCT FROM praw)
SELECT * FROM o""")
def f23(spark, d):
    part = load(spark, d, "part")
    roles = ("CASE p_partkey % 31 WHEN 0 THEN array('page_context', 'region_crop') WHEN 1 THEN array('page_context', 'region_crop', 'region_crop') "
             "ELSE array('page_context', 'viewed_contact_sheet', 'region_crop') END AS roles")
    res = part.where("p_partkey % 3 = 0 AND p_partkey % 61 <> 0")
    resolutions = res.selectExpr(*_split(RES), roles).unionByName(res.where("p_partkey % 300 = 0").selectExpr(*_split(RES), roles))
    return fi.disposition_overlay(
        part.selectExpr(*_split(RAW)), part.selectExpr(*_split(PRIOR)),
        part.where("p_partkey % 3 = 0 AND p_partkey % 59 <> 0").selectExpr("concat('p', p_partkey) AS finding_id"), resolutions,
        part.where("p_partkey % 3 <> 0 AND p_partkey % 67 <> 0").selectExpr(*_split(PRES)))


RULES = ["AQ-CHANGE-01", "AQ-IDENTITY-01", "AQ-ASSET-01", "AQ-BOUNDARY-01"]
RULE_VALUES = ", ".join(f"('{r}')" for r in RULES)
DECLS = "o_orderkey AS artifact_id, rule_id, CASE WHEN o_custkey % 5 = 0 THEN 'not_applicable' WHEN o_custkey % 7 = 0 THEN 'perhaps' ELSE 'applicable' END AS applicability"
EVID = ("o_orderkey AS artifact_id, rule_id, CASE WHEN o_custkey % 3 = 0 AND rule_id = 'AQ-ASSET-01' THEN 'fail' ELSE 'pass' END AS rule_status, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE 'p' END AS path, "
        "CASE WHEN o_custkey % 11 = 0 OR o_custkey % 13 = 0 THEN NULL ELSE 's' END AS sha256, o_custkey % 17 <> 0 AS valid")


@query("f24_applicability", f"""
WITH r(rule_id) AS (VALUES {RULE_VALUES}), dc AS (SELECT {DECLS} FROM orders, r WHERE NOT (o_custkey % 19 = 0 AND rule_id = 'AQ-CHANGE-01')), ev AS (SELECT {EVID} FROM orders, r WHERE o_custkey % 23 <> 0),
j AS (SELECT o.o_orderkey AS artifact_id, r.rule_id, applicability, rule_status, path, ev.sha256 AS h, valid FROM orders o CROSS JOIN r LEFT JOIN dc ON dc.artifact_id = o.o_orderkey AND dc.rule_id = r.rule_id
  LEFT JOIN ev ON ev.artifact_id = o.o_orderkey AND ev.rule_id = r.rule_id),
k AS (SELECT *, CASE WHEN applicability IS NULL THEN 'missing_applicability' WHEN applicability='not_applicable' THEN 'not_applicable' WHEN applicability <> 'applicable' THEN 'invalid_applicability'
  WHEN rule_status IS DISTINCT FROM 'pass' THEN 'rule_failed' WHEN path IS NULL AND h IS NULL THEN 'missing_evidence' WHEN path IS NULL OR h IS NULL OR NOT valid THEN 'invalid_evidence' ELSE 'evidence_validated' END AS disposition FROM j)
SELECT artifact_id, rule_id, disposition, CASE disposition WHEN 'not_applicable' THEN 'NOT_APPLICABLE' WHEN 'evidence_validated' THEN 'pass' ELSE 'fail' END AS status FROM k""")
def f24(spark, d):
    orders = load(spark, d, "orders")
    grid = orders.withColumn("rule_id", F.explode(F.array(*map(F.lit, RULES))))
    return fi.applicability(orders.selectExpr("o_orderkey AS artifact_id"), RULES,
                            grid.where("NOT (o_custkey % 19 = 0 AND rule_id = 'AQ-CHANGE-01')").selectExpr(*_split(DECLS)),
                            grid.where("o_custkey % 23 <> 0").selectExpr(*_split(EVID)))


SETS = "l_orderkey AS artifact_id, CASE WHEN l_linenumber % 2 = 0 THEN 'identities' ELSE 'assets' END AS check_id, CAST(l_partkey AS STRING) AS item_id"


@query("f25_expectation_sets", """
WITH m AS (SELECT l_orderkey AS artifact_id, CASE WHEN l_linenumber % 2 = 0 THEN 'identities' ELSE 'assets' END AS check_id, concat(l_partkey::VARCHAR, '|', CASE WHEN l_partkey % 50 = 0 THEN 'x' ELSE l_suppkey::VARCHAR END) AS v FROM lineitem WHERE l_partkey % 90 <> 1),
e AS (SELECT l_orderkey AS artifact_id, CASE WHEN l_linenumber % 2 = 0 THEN 'identities' ELSE 'assets' END AS check_id, concat(l_partkey::VARCHAR, '|', l_suppkey::VARCHAR) AS v FROM lineitem),
a AS (SELECT artifact_id, check_id, list_sort(list(v)) AS v FROM m GROUP BY 1, 2), b AS (SELECT artifact_id, check_id, list_sort(list(v)) AS v FROM e GROUP BY 1, 2)
SELECT artifact_id, check_id, CASE WHEN a.v IS NOT DISTINCT FROM b.v THEN 'pass' ELSE 'mismatch' END AS status FROM a FULL JOIN b USING (artifact_id, check_id)""")
def f25_sets(spark, d):
    items = load(spark, d, "lineitem")
    measured = items.where("l_partkey % 90 <> 1").selectExpr(*_split(SETS), "IF(l_partkey % 50 = 0, 'x', CAST(l_suppkey AS STRING)) AS item_hash")
    return fi.expectation_sets(measured, items.selectExpr(*_split(SETS), "CAST(l_suppkey AS STRING) AS item_hash"))


XE = ("o_orderkey AS artifact_id, o_orderkey % 4 AS relation_id, CASE WHEN o_custkey % 2 = 0 THEN 'gap' ELSE 'layer' END AS type, o_custkey % 3 = 0 AS no_contact, o_custkey % 4 = 0 AS no_overlap, CAST(3 AS DOUBLE) AS min_gap, "
      "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(12 AS DOUBLE) END AS max_gap, CAST(2 AS DOUBLE) AS max_overlap")
XM = ("o_orderkey AS artifact_id, CASE WHEN o_custkey % 29 = 0 THEN 9 ELSE o_orderkey % 4 END AS relation_id, CASE WHEN o_custkey % 2 = 0 OR o_custkey % 31 = 0 THEN 'gap' ELSE 'layer' END AS type, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_custkey % 15 = 0 END AS contact, "
      "o_custkey % 8 = 0 AS overlapping, CASE WHEN o_custkey % 37 = 0 THEN NULL ELSE CAST(o_custkey % 16 AS DOUBLE) END AS gap, CAST(o_custkey % 7 AS DOUBLE) / 2 AS overlap")


@query("f25_expectation_relations", f"""
WITH e AS (SELECT {XE} FROM orders), m AS (SELECT {XM} FROM orders)
SELECT artifact_id, relation_id, CASE WHEN e.min_gap IS NULL THEN 'undeclared_relation' WHEN m.overlapping IS NULL THEN 'relation_missing' WHEN m.type <> e.type THEN 'relation_type_mismatch'
  WHEN no_contact AND contact IS DISTINCT FROM false THEN 'no_contact_violated' WHEN no_overlap AND overlapping IS DISTINCT FROM false THEN 'no_overlap_violated' WHEN gap IS NULL OR overlap IS NULL THEN 'measurement_missing'
  WHEN gap < min_gap THEN 'gap_below_contract' WHEN gap > max_gap THEN 'gap_above_contract' WHEN overlap > max_overlap THEN 'overlap_above_contract' ELSE 'pass' END AS status
FROM e FULL JOIN m USING (artifact_id, relation_id)""")
def f25_relations(spark, d):
    orders = load(spark, d, "orders")
    return fi.expectation_relations(orders.selectExpr(*_split(XM)), orders.selectExpr(*_split(XE)))


@query("f25_expectation_counters", """
SELECT o_orderkey AS artifact_id, concat_ws(',', CASE WHEN o_custkey % 4 > 2 THEN 'clipped_count_exceeds_contract' END, CASE WHEN o_custkey % 13 = 0 OR o_custkey % 5 > 0 THEN 'overflow_count_exceeds_contract' END) AS failures FROM orders""")
def f25_counters(spark, d):
    return fi.expectation_counters(load(spark, d, "orders").selectExpr(
        "o_orderkey AS artifact_id", "o_custkey % 4 AS clipped_count", "2 AS max_clipped", "IF(o_custkey % 13 = 0, NULL, o_custkey % 5) AS overflow_count",
        "CAST(NULL AS INT) AS max_overflow"), [("clipped_count", "max_clipped"), ("overflow_count", "max_overflow")])


@query("f26_profile_compare", """
WITH m AS (SELECT artifact_id, min(CASE WHEN line_index > 1 THEN x0 END) AS outer_margin, min(CASE WHEN line_index > 3 THEN y1 - y0 END) AS line_gap FROM v_boxes GROUP BY 1)
SELECT artifact_id, concat_ws(',', CASE WHEN outer_margin < 100 THEN 'outer_margin' END, CASE WHEN line_gap < 20 THEN 'line_gap' END) AS below,
  CASE WHEN coalesce(outer_margin < 100, false) OR coalesce(line_gap < 20, false) THEN 'block' WHEN outer_margin IS NOT NULL OR line_gap IS NOT NULL THEN 'pass' ELSE 'review' END AS status FROM m""")
def f26(spark, d):
    metrics = view(spark, d, "v_boxes").groupBy("artifact_id").agg(
        F.min(F.expr("IF(line_index > 1, x0, NULL)")).alias("outer_margin"), F.min(F.expr("IF(line_index > 3, y1 - y0, NULL)")).alias("line_gap"))
    return fi.profile_compare(metrics, {"outer_margin": 100.0, "line_gap": 20.0})


LAYER = "artifact_id, concat('L', CAST(line_index % 4 AS STRING)) AS layer, box_id AS entry_id, CASE WHEN curves = 1 THEN 'block' WHEN curves IN (2, 3) THEN 'review' ELSE 'pass' END AS status"


@query("f27_layer_rollup", f"""
SELECT artifact_id, layer, CASE WHEN bool_or(status='block') THEN 'block' WHEN bool_or(status='review') THEN 'review' ELSE 'pass' END AS status, count(*) AS n
FROM (SELECT {LAYER} FROM v_boxes) GROUP BY GROUPING SETS ((artifact_id, layer), (artifact_id))""")
def f27(spark, d):
    return fi.layer_rollup(view(spark, d, "v_boxes").selectExpr(*_split(LAYER)))


SC = "artifact_id, CASE WHEN curves < 3 THEN 'hard' WHEN curves < 7 THEN 'review' ELSE 'info' END AS severity, CASE WHEN curves = 5 THEN 'HARD_FAIL' END AS bucket"


@query("f28_merge_scans", f"""
WITH s AS (SELECT {SC}, line_index FROM v_boxes), u AS (SELECT artifact_id, severity, bucket FROM s WHERE line_index % 2 = 0 UNION ALL SELECT artifact_id, severity, bucket FROM s WHERE line_index % 2 = 1 AND line_index < 6
 UNION ALL SELECT artifact_id, 'hard', bucket FROM s WHERE line_index = 7),
c AS (SELECT artifact_id, count(*) AS issue_count, count(*) FILTER (WHERE severity='hard' OR coalesce(bucket='HARD_FAIL', false)) AS hard_count, count(*) FILTER (WHERE severity='review' AND NOT coalesce(bucket='HARD_FAIL', false)) AS review_count FROM u GROUP BY 1)
SELECT *, CASE WHEN hard_count > 0 THEN 'block' WHEN review_count > 0 THEN 'review' ELSE 'pass' END AS status FROM c""")
def f28(spark, d):
    scan = view(spark, d, "v_boxes").selectExpr(*_split(SC), "line_index")
    return fi.merge_scans(scan.where("line_index % 2 = 0"), scan.where("line_index % 2 = 1 AND line_index < 6"), scan.where("line_index = 7"))


RULE4 = "CASE CAST(line_index % 5 AS INT) WHEN 0 THEN 'rendered_orphan_ratio' WHEN 1 THEN 'semantic_surface_area_ratio' WHEN 2 THEN 'semantic_surface_sparse_container' WHEN 3 THEN 'semantic_surface_consecutive_prominent_pages' ELSE 'overlap' END AS rule"
RP = f"box_id AS element_id, {RULE4}, page, block_id AS frame_id"


@query("f29_repair_plan", f"""
SELECT sha256({ident(['element_id', 'rule', 'page', 'frame_id'])}) AS issue_id, element_id, rule, CASE WHEN rule='rendered_orphan_ratio' THEN 'safe-wrap' WHEN rule='overlap' THEN 'unsupported' ELSE 'semantic-surface' END AS family,
  CASE WHEN rule='rendered_orphan_ratio' THEN 'wrap_adjustment' WHEN rule='overlap' THEN NULL ELSE 'surface_recompose' END AS operation FROM (SELECT {RP} FROM v_boxes)""")
def f29(spark, d):
    return fi.repair_plan(view(spark, d, "v_boxes").selectExpr(*_split(RP)))


INS = "artifact_id, CASE WHEN line_index % 3 = 0 THEN 'content_inset' WHEN line_index % 3 = 1 THEN 'nested_inset' ELSE 'anchor_gap' END AS type, CASE WHEN curves = 1 THEN 'fail' WHEN curves = 2 THEN 'review' ELSE 'pass' END AS status"


@query("f30_relation_rollup", f"""
WITH i AS (SELECT artifact_id, count(*) AS n, bool_and(status='pass') AS ap, bool_or(status='review') AS ar FROM (SELECT {INS} FROM v_boxes) WHERE type <> 'anchor_gap' GROUP BY 1)
SELECT o_orderkey AS artifact_id, coalesce(n, 0) AS n, CASE WHEN o_custkey % 2 = 0 AND n IS NULL THEN 'block' WHEN n IS NULL THEN 'not_applicable' WHEN ap THEN 'pass' WHEN ar THEN 'indeterminate' ELSE 'block' END AS status
FROM orders LEFT JOIN i ON artifact_id = o_orderkey""")
def f30(spark, d):
    return fi.relation_rollup(view(spark, d, "v_boxes").selectExpr(*_split(INS)), load(spark, d, "orders").selectExpr(
        "o_orderkey AS artifact_id", "o_custkey % 2 = 0 AS inset_required"))


CRI = ("l_orderkey AS artifact_id, CASE WHEN l_partkey % 70 = 0 THEN ' vis-02 ' WHEN l_partkey % 3 = 0 THEN 'VIS-01' END AS id, CASE CAST(l_suppkey % 25 AS INT) WHEN 1 THEN 'Table_Header' WHEN 2 THEN 'tables-x' WHEN 3 THEN 'cell-gap' WHEN 4 THEN 'my-vertical-insets' WHEN 5 THEN NULL ELSE 'contrast-x' END AS criterion_id")


@query("f31_criteria_flags", f"""
SELECT artifact_id, bool_or(upper(trim(coalesce(id, ''))) IN ('VIS-02','VIS-03') OR list_has_any(string_split(replace(lower(trim(coalesce(criterion_id, ''))), '_', '-'), '-'), ['table','cell','inset','insets'])
  OR contains(lower(coalesce(criterion_id, '')), 'vertical-inset')) AS inset_required FROM (SELECT {CRI} FROM lineitem) GROUP BY 1""")
def f31(spark, d):
    return fi.criteria_flags(load(spark, d, "lineitem").selectExpr(*_split(CRI)))
