"""Queries over blocks, declared relations, frames and surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql as fsql
from ..functions.common import PAGE_KEY, py_round
from ..operators import blocks as bl
from ..operators import frames as fr
from ..operators import profile as pf
from .q_layout import _split, occupancy_sql
from .registry import query
from .sqltext import INTER, OX, OY, PAGE, pr
from .views import load, view

POLICY = {"scopes": {"inter_block": {"title->body": 14.0, "list": 9.0}, "intra_block": {"title:list": 11.0, "body": 7.0, "*": 3.0}},
          "scalars": {"inter_block": 5.0}}


def gap_sql(scope: str, u: str, l: str) -> str:
    return (f"CASE WHEN {scope} = 'inter_block' THEN CASE WHEN {u}='title' AND {l}='body' THEN 14.0 WHEN {l}='list' THEN 9.0 "
            f"WHEN {u}='list' THEN 9.0 ELSE 5.0 END ELSE CASE WHEN {u}='title' AND {l}='list' THEN 11.0 WHEN {l}='body' THEN 7.0 "
            f"WHEN {u}='body' THEN 7.0 ELSE 3.0 END END")


# siblings on shared pages, some without a parent
SIB = ("block_id, CASE WHEN block_id % 9 = 0 THEN NULL ELSE CAST(floor(block_id / 6) AS BIGINT) END AS parent_id, "
       "CASE WHEN block_id % 4 = 0 THEN 7 END AS owner_id, CAST(floor(block_id / 60) AS INT) AS page, role, line_height, "
       "CASE WHEN block_id % 11 = 0 THEN 'S' END AS surface_owner, x0, "
       "CAST((block_id * 13) % 300 AS DOUBLE) AS y0, x1, CAST((block_id * 13) % 300 + 10 AS DOUBLE) AS y1")
SIB_SQL = f"""(
WITH s AS (SELECT {SIB} FROM v_blocks),
p AS (SELECT a.page, CASE WHEN coalesce(a.owner_id = b.owner_id, false) OR a.parent_id IS NOT NULL THEN 'intra_block' ELSE 'inter_block' END AS scope,
  a.block_id AS upper_id, b.block_id AS lower_id, a.role AS upper_role, b.role AS lower_role, b.y0 - a.y1 AS gap,
  greatest(0.0, {OX}) / least(a.x1-a.x0, b.x1-b.x0) AS ratio, greatest(a.line_height, b.line_height) AS lh
  FROM s a JOIN s b ON a.page = b.page AND a.parent_id IS NOT DISTINCT FROM b.parent_id AND a.block_id <> b.block_id
   AND (a.y0 < b.y0 OR (a.y0 = b.y0 AND a.block_id < b.block_id))
  WHERE greatest(0.0, {OX}) / least(a.x1-a.x0, b.x1-b.x0) >= 0.5 AND NOT coalesce(a.surface_owner = b.surface_owner, false)
   AND a.role <> 'none' AND NOT (least(a.block_id, b.block_id) + 1 = greatest(a.block_id, b.block_id) AND least(a.block_id, b.block_id) % 5 = 0)),
q AS (SELECT *, {gap_sql('scope', 'upper_role', 'lower_role')} AS mg FROM p)
SELECT CASE WHEN gap < 0 THEN 'content_block_overlap' WHEN scope = 'inter_block' THEN 'content_block_spacing_candidate' ELSE 'content_block_intra_spacing_candidate' END AS rule,
  page, scope, upper_id, lower_id, upper_role, lower_role, {pr('gap', 3)} AS gap, {pr('mg', 3)} AS requested_gap, {pr('greatest(mg, lh)', 3)} AS effective_gap,
  {pr('ratio', 4)} AS x_overlap_ratio FROM q WHERE gap < greatest(mg, lh))"""


def _siblings(spark, d):
    blocks = view(spark, d, "v_blocks").selectExpr(*_split(SIB))
    declared = blocks.where("block_id % 5 = 0").selectExpr("block_id AS first_id", "block_id + 1 AS second_id")
    return bl.sibling_spacing(blocks, POLICY, declared=declared)


@query("g29_sibling_spacing", f"SELECT * FROM {SIB_SQL}")
def g29(spark, d):
    return _siblings(spark, d)


@query("g30_min_gap_lookup", f"""
SELECT block_id, CAST({gap_sql('scope', 'upper_role', 'lower_role')} AS DOUBLE) AS min_gap FROM
 (SELECT a.block_id, CASE WHEN a.block_id % 2 = 0 THEN 'inter_block' ELSE 'intra_block' END AS scope, a.role AS upper_role, b.role AS lower_role
  FROM v_blocks a JOIN v_blocks b ON b.block_id = a.parent_id)""")
def g30(spark, d):
    blocks = view(spark, d, "v_blocks")
    parents = blocks.select(F.col("block_id").alias("parent_id"), F.col("role").alias("lower_role"))
    pairs = blocks.join(parents, "parent_id").select(
        "block_id", F.when(F.col("block_id") % 2 == 0, "inter_block").otherwise("intra_block").alias("scope"),
        F.col("role").alias("upper_role"), "lower_role")
    return bl.gap_lookup(pairs, POLICY).select("block_id", "min_gap")


@query("g31_ancestor_pairs", """
WITH RECURSIVE up AS (SELECT block_id AS node, parent_id AS ancestor FROM v_blocks WHERE parent_id IS NOT NULL
  UNION SELECT up.node, b.parent_id FROM up JOIN v_blocks b ON b.block_id = up.ancestor WHERE b.parent_id IS NOT NULL)
SELECT node, ancestor FROM up""")
def g31(spark, d):
    return bl.closure(view(spark, d, "v_blocks"))


@query("g32_relation_summary", f"""
SELECT scope, upper_role, lower_role, count(*) AS coverage_count, count(*) FILTER (WHERE rule <> 'content_block_overlap') AS candidate_count,
  min(gap) AS minimum_gap FROM {SIB_SQL} GROUP BY ALL""")
def g32(spark, d):
    return bl.relation_summary(_siblings(spark, d))


# blocks placed close together so that declared relations meet each case
REL = ("block_id, CAST(floor(block_id / 6) AS BIGINT) AS parent_id, CASE WHEN block_id % 5 < 2 THEN CAST(floor(block_id / 5) AS BIGINT) END AS owner_id, "
       "CAST(floor(block_id / 16) AS INT) AS page, line_height, CASE WHEN block_id % 29 = 0 THEN NULL ELSE CAST((block_id % 4) * 2 AS DOUBLE) END AS x0, "
       "CAST((block_id % 16) * 30 AS DOUBLE) AS y0, CAST((block_id % 4) * 2 + 100 + (block_id % 3) * 5 AS DOUBLE) AS x1, "
       "CAST((block_id % 16) * 30 + 15 + (block_id * 7) % 18 AS DOUBLE) AS y1")
PAIR = ("WITH b AS (SELECT " + REL + " FROM v_blocks), r AS (SELECT block_id AS relation_id, block_id AS first_id, block_id + 1 AS second_id FROM v_blocks), "
        "j AS (SELECT r.relation_id, a.x0 ax0, a.y0 ay0, a.x1 ax1, a.y1 ay1, a.page ap, a.owner_id ao, a.parent_id aq, c.x0 bx0, c.y0 by0, c.x1 bx1, c.y1 by1, "
        "c.page bp, c.owner_id bo, c.parent_id bq, (a.x0 IS NULL OR c.x0 IS NULL OR a.page IS NULL OR c.page IS NULL) AS miss, a.page <> c.page AS split "
        "FROM r LEFT JOIN b a ON a.block_id = r.first_id LEFT JOIN b c ON c.block_id = r.second_id) ")


def _rel_blocks(spark, d):
    return view(spark, d, "v_blocks").selectExpr(*_split(REL))


@query("g33_relation_ordered", f"""
WITH b AS (SELECT {REL} FROM v_blocks),
m AS (SELECT block_id AS relation_id, CAST(i AS INT) AS pos, block_id + i AS member, 4.0 AS min_gap FROM v_blocks, unnest(range(3)) AS u(i)),
p AS (SELECT m.*, b.x0, b.y0, b.y1, b.page, b.line_height AS lh, lead(b.y0) OVER w AS ny0, lead(b.line_height) OVER w AS nlh, lead(member) OVER w AS nm
  FROM m LEFT JOIN b ON b.block_id = m.member WINDOW w AS (PARTITION BY relation_id ORDER BY pos)),
g AS (SELECT relation_id, bool_or(x0 IS NULL OR page IS NULL) AS miss, min(page) <> max(page) AS split, coalesce(bool_or(ny0 - y1 < 0), false) AS t,
  coalesce(bool_or(ny0 - y1 < greatest(4.0, coalesce(lh, 0.0), coalesce(nlh, 0.0))), false) AS g, min(ny0 - y1) AS s, count(*) AS coverage_count FROM p GROUP BY 1),
f AS (SELECT *, concat_ws(',', CASE WHEN miss THEN 'render_mapping_missing' END, CASE WHEN NOT miss AND split AND relation_id % 2 = 0 THEN 'same_page' END,
  CASE WHEN NOT miss AND NOT split AND t AND relation_id % 3 > 0 THEN 'no_overlap' END, CASE WHEN NOT miss AND NOT split AND g THEN 'min_gap_pt' END) AS why FROM g)
SELECT relation_id, coverage_count, CASE WHEN NOT miss AND NOT split THEN s END AS smallest_gap,
  CASE WHEN why <> '' THEN 'fail' ELSE 'pass' END AS status, CASE WHEN why <> '' THEN why ELSE 'ordered_satisfied' END AS reason_code FROM f""")
def g33(spark, d):
    blocks = _rel_blocks(spark, d)
    relations = blocks.selectExpr(
        "block_id AS relation_id", "array(block_id, block_id + 1, block_id + 2) AS member_ids", "CAST(4 AS DOUBLE) AS min_gap",
        "block_id % 2 = 0 AS same_page", "block_id % 3 > 0 AS no_overlap")
    return bl.eval_ordered(relations, blocks)


MODES = "CASE CAST(block_id % 3 AS INT) WHEN 0 THEN 'attached' WHEN 1 THEN 'separate' ELSE 'unspecified' END AS mode"


@query("g34_relation_vertical", PAIR + f""",
k AS (SELECT j.*, CASE WHEN relation_id % 3 = 0 THEN 'attached' WHEN relation_id % 3 = 1 THEN 'separate' ELSE 'unspecified' END AS mode,
  coalesce(CASE WHEN ao = bo THEN ao END, CASE WHEN aq = bq THEN aq END) AS cid FROM j),
c AS (SELECT k.*, b.x0 cx0, b.y0 cy0, b.x1 cx1, b.y1 cy1, by0 - ay1 AS g, abs((ax1-ax0)-(bx1-bx0)) AS wd, least(abs(ax0-bx0), abs(ax1-bx1)) AS ed
  FROM k LEFT JOIN b ON b.block_id = k.cid),
f AS (SELECT *, concat_ws(',', CASE WHEN miss THEN 'vertical_association_render_mapping_missing' END,
  CASE WHEN NOT miss AND split THEN 'vertical_association_same_page_mismatch' END,
  CASE WHEN NOT miss AND NOT split AND mode='attached' AND abs(g) > 10 THEN 'vertical_association_attached_gap_exceeded' END,
  CASE WHEN NOT miss AND NOT split AND mode='attached' AND wd > 5 THEN 'vertical_association_attached_width_mismatch' END,
  CASE WHEN NOT miss AND NOT split AND mode='attached' AND NOT ((cx0 IS NOT NULL AND greatest(0.0, cx0-ax0, ax1-cx1, cy0-ay0, ay1-cy1, cx0-bx0, bx1-cx1, cy0-by0, by1-cy1) <= 60) OR ed <= 1)
    THEN 'vertical_association_attached_container_or_edge_misaligned' END,
  CASE WHEN NOT miss AND NOT split AND mode='separate' AND g < 6 THEN 'vertical_association_separate_gap_insufficient' END) AS why FROM c)
SELECT relation_id, mode, g AS gap, wd AS width_delta, ed AS edge_delta,
  CASE WHEN mode='unspecified' THEN 'review' WHEN why <> '' THEN 'fail' ELSE 'pass' END AS status,
  CASE WHEN mode='unspecified' THEN 'vertical_association_unspecified' WHEN why <> '' THEN why ELSE concat('vertical_association_', mode, '_satisfied') END AS reason_code FROM f""")
def g34(spark, d):
    blocks = _rel_blocks(spark, d)
    relations = blocks.selectExpr(
        "block_id AS relation_id", "block_id AS first_id", "block_id + 1 AS second_id", MODES, "CAST(10 AS DOUBLE) AS max_gap",
        "CAST(5 AS DOUBLE) AS max_width_delta", "CAST(60 AS DOUBLE) AS containment_tolerance", "CAST(1 AS DOUBLE) AS max_edge_delta",
        "CAST(6 AS DOUBLE) AS min_gap")
    return bl.eval_vertical(relations, blocks)


@query("g35_relation_anchor_gap", PAIR + f""",
k AS (SELECT j.*, CASE WHEN relation_id % 3 = 0 THEN 'attached' WHEN relation_id % 3 = 1 THEN 'separate' ELSE 'unspecified' END AS mode,
  CASE WHEN relation_id % 2 = 0 THEN 'vertical' ELSE 'horizontal' END AS axis,
  CASE WHEN relation_id % 5 = 0 THEN 'required' WHEN relation_id % 5 = 1 THEN 'forbidden' ELSE 'any' END AS sc,
  coalesce(CASE WHEN ao = bo THEN ao END, CASE WHEN aq = bq THEN aq END) AS cid FROM j),
t AS (SELECT *, CASE WHEN axis='vertical' THEN by0-ay1 ELSE bx0-ax1 END AS g,
  CASE WHEN axis='vertical' THEN ax0 ELSE ay0 END AS al, CASE WHEN axis='vertical' THEN ax1 ELSE ay1 END AS ah,
  CASE WHEN axis='vertical' THEN bx0 ELSE by0 END AS bl, CASE WHEN axis='vertical' THEN bx1 ELSE by1 END AS bh FROM k),
u AS (SELECT *, greatest(0.0, least(ah,bh)-greatest(al,bl)) / least(ah-al, bh-bl) AS ov, abs((ah-al)-(bh-bl)) AS wd, greatest(abs(al-bl), abs(ah-bh)) AS ed,
  abs((al+ah)/2-(bl+bh)/2) AS cd, (NOT miss AND NOT split) AS live FROM t),
f AS (SELECT *, concat_ws(',', CASE WHEN miss THEN 'anchor_gap_render_mapping_missing' END, CASE WHEN NOT miss AND split THEN 'anchor_gap_same_page_mismatch' END,
  CASE WHEN live AND sc='required' AND cid IS NULL THEN 'anchor_gap_shared_container_required' END,
  CASE WHEN live AND sc='forbidden' AND cid IS NOT NULL THEN 'anchor_gap_shared_container_forbidden' END,
  CASE WHEN live AND mode='attached' AND abs(g) > 12 THEN 'anchor_gap_attached_gap_exceeded' END,
  CASE WHEN live AND mode='attached' AND ov < 0.5 THEN 'anchor_gap_axis_overlap_insufficient' END,
  CASE WHEN live AND mode='attached' AND wd > 6 THEN 'anchor_gap_width_mismatch' END,
  CASE WHEN live AND mode='attached' AND ed > 8 THEN 'anchor_gap_edge_mismatch' END,
  CASE WHEN live AND mode='attached' AND cd > 4 THEN 'anchor_gap_center_mismatch' END,
  CASE WHEN live AND mode='separate' AND g < 6 THEN 'anchor_gap_separate_gap_insufficient' END) AS why FROM u)
SELECT relation_id, axis, mode, CASE WHEN live THEN g END AS gap, CASE WHEN live THEN {pr('ov', 4)} END AS axis_overlap,
  CASE WHEN live AND mode='unspecified' THEN 'review' WHEN why <> '' THEN 'fail' ELSE 'pass' END AS status,
  CASE WHEN live AND mode='unspecified' THEN 'anchor_gap_unspecified' WHEN why <> '' THEN why ELSE concat('anchor_gap_', mode, '_satisfied') END AS reason_code FROM f""")
def g35(spark, d):
    blocks = _rel_blocks(spark, d)
    relations = blocks.selectExpr(
        "block_id AS relation_id", "block_id AS first_id", "block_id + 1 AS second_id", MODES,
        "IF(block_id % 2 = 0, 'vertical', 'horizontal') AS axis",
        "CASE block_id % 5 WHEN 0 THEN 'required' WHEN 1 THEN 'forbidden' ELSE 'any' END AS shared_container",
        "CAST(12 AS DOUBLE) AS max_gap", "CAST(0.5 AS DOUBLE) AS min_axis_overlap", "CAST(6 AS DOUBLE) AS max_width_delta",
        "CAST(8 AS DOUBLE) AS max_edge_delta", "CAST(4 AS DOUBLE) AS max_center_delta", "CAST(6 AS DOUBLE) AS min_gap")
    return bl.eval_anchor(relations, blocks)


# outer boxes drawn around their members
NEST = ("block_id, CAST(floor(block_id / 16) AS INT) AS page, CASE WHEN block_id % 31 = 0 THEN NULL ELSE CAST(block_id % 16 * 2 + (block_id * 5) % 4 AS DOUBLE) END AS x0, "
        "CAST(block_id % 16 * 2 AS DOUBLE) AS y0, CAST(400 - block_id % 16 * 2 AS DOUBLE) AS x1, CAST(300 - block_id % 16 * 3 AS DOUBLE) AS y1, "
        "CAST(NULL AS DOUBLE) AS line_height, CAST(NULL AS BIGINT) AS owner_id, CAST(NULL AS BIGINT) AS parent_id")


@query("g36_relation_content_inset", f"""
WITH b AS (SELECT {NEST} FROM v_blocks),
i AS (SELECT r.block_id AS relation_id, bool_or(b.x0 IS NULL OR b.page IS NULL) AS im, min(b.page) AS p0, max(b.page) AS p1, min(b.x0) AS bx0, min(b.y0) AS by0, max(b.x1) AS bx1, max(b.y1) AS by1, count(*) AS n_inner
  FROM v_blocks r, unnest([1, 2]) AS u(k) LEFT JOIN b ON b.block_id = r.block_id + k GROUP BY 1),
j AS (SELECT i.*, a.page AS ap, bx0-a.x0 AS l, a.x1-bx1 AS r, by0-a.y0 AS t, a.y1-by1 AS bt, im OR a.x0 IS NULL OR a.page IS NULL AS miss FROM i LEFT JOIN b a ON a.block_id = i.relation_id),
f AS (SELECT *, NOT miss AND NOT (ap <> p0 OR p0 <> p1) AS live, concat_ws(',', CASE WHEN miss THEN 'content_inset_render_mapping_missing' END,
  CASE WHEN NOT miss AND (ap <> p0 OR p0 <> p1) THEN 'content_inset_same_page_mismatch' END,
  CASE WHEN NOT miss AND ap = p0 AND p0 = p1 THEN concat_ws(',', CASE WHEN least(l,r,t,bt) < -0.5 THEN 'content_inset_containment' END,
    CASE WHEN l < 1 THEN 'content_inset_minimum_left' END, CASE WHEN r < 2 THEN 'content_inset_minimum_right' END, CASE WHEN t < 1 THEN 'content_inset_minimum_top' END,
    CASE WHEN bt < 3 THEN 'content_inset_minimum_bottom' END, CASE WHEN relation_id % 3 <> 1 AND abs(l-r) > 1 THEN 'content_inset_balance_horizontal' END,
    CASE WHEN relation_id % 3 <> 0 AND abs(t-bt) > 1 THEN 'content_inset_balance_vertical' END) END) AS why0 FROM j),
w AS (SELECT *, trim(why0, ',') AS why FROM f)
SELECT relation_id, n_inner, CASE WHEN live THEN l END AS inset_left, CASE WHEN live THEN r END AS inset_right, CASE WHEN live THEN t END AS inset_top, CASE WHEN live THEN bt END AS inset_bottom,
  CASE WHEN why <> '' THEN 'fail' ELSE 'pass' END AS status, CASE WHEN why <> '' THEN why ELSE 'content_inset_satisfied' END AS reason_code FROM w""")
def g36(spark, d):
    blocks = view(spark, d, "v_blocks").selectExpr(*_split(NEST))
    relations = blocks.selectExpr(
        "block_id AS relation_id", "block_id AS outer_id", "array(block_id + 1, block_id + 2) AS inner_ids", "true AS require_contained",
        "CAST(0.5 AS DOUBLE) AS containment_tolerance", "1D AS min_left", "2D AS min_right", "1D AS min_top", "3D AS min_bottom",
        "CASE block_id % 3 WHEN 0 THEN 'horizontal' WHEN 1 THEN 'vertical' ELSE 'both' END AS balance_axes", "1D AS max_balance_delta")
    return bl.eval_inset(relations, blocks)


@query("g37_relation_nested_inset", f"""
WITH b AS (SELECT {NEST} FROM v_blocks),
j AS (SELECT r.block_id AS relation_id, c.x0-a.x0 AS l, a.x1-c.x1 AS r, c.y0-a.y0 AS t, a.y1-c.y1 AS bt, (a.x0 IS NULL OR c.x0 IS NULL OR c.page IS NULL) AS miss, a.page <> c.page AS split,
  r.block_id % 3 <> 1 AS h, r.block_id % 3 <> 0 AS v FROM v_blocks r LEFT JOIN b a ON a.block_id = r.block_id LEFT JOIN b c ON c.block_id = r.block_id + 1),
f AS (SELECT *, NOT miss AND NOT split AS live FROM j),
w AS (SELECT *, concat_ws(',', CASE WHEN miss THEN 'render_mapping_missing' END, CASE WHEN NOT miss AND split THEN 'same_page' END,
  CASE WHEN live AND least(l,r,t,bt) < 0 THEN 'require_contained' END, CASE WHEN live AND h AND abs(l-r) > 1 THEN 'inset_balance_horizontal' END,
  CASE WHEN live AND v AND abs(t-bt) > 1 THEN 'inset_balance_vertical' END) AS why FROM f)
SELECT relation_id, greatest(CASE WHEN live AND h THEN abs(l-r) END, CASE WHEN live AND v THEN abs(t-bt) END) AS delta,
  CASE WHEN why <> '' THEN 'fail' ELSE 'pass' END AS status, CASE WHEN why <> '' THEN why ELSE 'nested_inset_balanced' END AS reason_code FROM w""")
def g37(spark, d):
    blocks = view(spark, d, "v_blocks").selectExpr(*_split(NEST))
    relations = blocks.selectExpr(
        "block_id AS relation_id", "block_id AS first_id", "block_id + 1 AS second_id",
        "CASE block_id % 3 WHEN 0 THEN 'horizontal' WHEN 1 THEN 'vertical' ELSE 'both' END AS axes", "1D AS max_delta", "true AS require_contained")
    return bl.eval_nested(relations, blocks)


EVID_R = ("p_partkey AS relation_id, CASE WHEN p_partkey % 2 = 0 THEN 'connector_route' ELSE 'layer_relation' END AS relation_type, "
          "CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'terminate_at_boundary' ELSE 'through' END ELSE CASE WHEN p_size % 2 = 0 THEN 'front_of' ELSE 'behind' END END AS mode, "
          "p_size % 3 = 0 AS order_required, CAST(10 AS DOUBLE) AS max_length, CAST(20 AS DOUBLE) AS max_area, CAST(3 AS DOUBLE) AS endpoint_tolerance, CAST(4 AS DOUBLE) AS boundary_tolerance, "
          "CAST(2 AS DOUBLE) AS min_overlap, CAST(30 AS DOUBLE) AS max_overlap, 0.5 AS min_front_visible, 0.75 AS max_occluded")
EVID_M = ("p_partkey AS relation_id, CASE WHEN p_size % 17 = 0 THEN 'ambiguous' ELSE 'measured' END AS evidence_status, p_size % 4 <> 0 AS order_ok, "
          "CASE WHEN p_size % 13 = 0 THEN NULL ELSE CAST(p_size % 14 AS DOUBLE) END AS visible_length, CAST(p_size % 25 AS DOUBLE) AS visible_area, "
          "CASE WHEN p_size % 11 = 0 THEN NULL ELSE CAST(p_size % 5 AS DOUBLE) END AS endpoint_distance, CAST(p_size % 6 AS DOUBLE) AS boundary_distance, "
          "CASE WHEN p_size % 19 = 0 THEN NULL ELSE CAST(p_size % 35 AS DOUBLE) END AS overlap_area, CAST(p_size % 5 AS DOUBLE) / 4 AS front_visible, "
          "CASE WHEN p_size % 23 = 0 THEN NULL ELSE CAST(p_size % 7 AS DOUBLE) / 8 END AS occluded")


@query("g38_relation_evidence", f"""
WITH r AS (SELECT {EVID_R} FROM part), m AS (SELECT {EVID_M} FROM part),
j AS (SELECT *, relation_type = 'connector_route' AS c, relation_type = 'layer_relation' AS y, order_required AND NOT coalesce(order_ok, false) AS wo FROM r LEFT JOIN m USING (relation_id)),
w AS (SELECT *, concat_ws(',', CASE WHEN c AND wo THEN 'connector_route_source_order_contradiction' END, CASE WHEN c AND visible_length IS NULL THEN 'connector_route_visible_length_missing' END,
  CASE WHEN c AND visible_length > 10 THEN 'connector_route_visible_length_exceeded' END, CASE WHEN c AND visible_area IS NULL THEN 'connector_route_visible_area_missing' END,
  CASE WHEN c AND visible_area > 20 THEN 'connector_route_visible_area_exceeded' END,
  CASE WHEN mode='terminate_at_boundary' AND endpoint_distance IS NULL THEN 'connector_route_endpoint_distance_missing' END,
  CASE WHEN mode='terminate_at_boundary' AND endpoint_distance > 3 THEN 'connector_route_endpoint_tolerance' END,
  CASE WHEN mode='terminate_at_boundary' AND boundary_distance > 4 THEN 'connector_route_boundary_intersection' END,
  CASE WHEN y AND overlap_area IS NULL THEN 'layer_relation_overlap_missing' END, CASE WHEN y AND overlap_area < 2 THEN 'layer_relation_overlap_below_minimum' END,
  CASE WHEN y AND overlap_area > 30 THEN 'layer_relation_overlap_exceeded' END, CASE WHEN mode='front_of' AND wo THEN 'layer_relation_source_order_contradiction' END,
  CASE WHEN mode='front_of' AND (front_visible IS NULL OR occluded IS NULL) THEN 'layer_relation_visibility_missing' END,
  CASE WHEN mode='front_of' AND occluded IS NOT NULL AND front_visible < 0.5 THEN 'layer_relation_front_visibility_insufficient' END,
  CASE WHEN mode='front_of' AND front_visible IS NOT NULL AND occluded > 0.75 THEN 'layer_relation_occlusion_exceeded' END) AS why, coalesce(evidence_status, 'ambiguous') = 'ambiguous' AS amb FROM j)
SELECT relation_id, relation_type, CASE WHEN amb THEN 'review' WHEN why <> '' THEN 'fail' ELSE 'pass' END AS status,
  CASE WHEN amb THEN concat(relation_type, '_effective_evidence_unavailable') WHEN why <> '' THEN why ELSE concat(relation_type, '_satisfied') END AS reason_code FROM w""")
def g38(spark, d):
    part = load(spark, d, "part")
    return bl.eval_evidence(part.selectExpr(*_split(EVID_R)), part.selectExpr(*_split(EVID_M)))


ANCHOR = ("artifact_id, page, box_id, x0, y0, x1, y1, x0 - 30 AS ax, y0 + 5 AS ay, CAST(1 + line_index % 2 AS DOUBLE) AS dx, CAST(line_index % 3 - 1 AS DOUBLE) AS dy, "
          "CAST(0.5 AS DOUBLE) AS target, CAST(0.25 AS DOUBLE) AS tolerance, CAST(2 AS DOUBLE) AS contact_tolerance, bold AS no_contact, curves = 4 AS touching, "
          "'toward_anchor' AS facing_expected, CASE WHEN curves = 5 THEN 'neutral' ELSE 'toward_anchor' END AS facing_actual, "
          "CAST(0 AS DOUBLE) AS sx0, CAST(0 AS DOUBLE) AS sy0, CAST(560 AS DOUBLE) AS sx1, CAST(700 AS DOUBLE) AS sy1")
DIRECTION = ("(SELECT *, dx / sqrt(dx*dx+dy*dy) AS ux, dy / sqrt(dx*dx+dy*dy) AS uy FROM (SELECT " + ANCHOR + " FROM v_boxes))")
GAP = "(least(x0*ux+y0*uy, x0*ux+y1*uy, x1*ux+y0*uy, x1*ux+y1*uy) - (ax*ux+ay*uy))"


@query("g39_relative_anchor_gap", f"""
WITH g AS (SELECT *, {GAP} AS gp FROM {DIRECTION}),
w AS (SELECT *, gp / (x1-x0) AS ratio, concat_ws(',', CASE WHEN gp < 0 THEN 'relative_anchor_gap_negative' END,
  CASE WHEN gp / (x1-x0) < 0.25 - 1e-9 OR gp / (x1-x0) > 0.75 + 1e-9 THEN 'relative_anchor_gap_ratio_out_of_range' END,
  CASE WHEN no_contact AND (touching OR gp <= 2 + 1e-9) THEN 'relative_anchor_gap_contact' END,
  CASE WHEN facing_actual <> facing_expected THEN 'relative_anchor_gap_facing_mismatch' END,
  CASE WHEN x0 < sx0 OR y0 < sy0 OR x1 > sx1 + 1e-9 OR y1 > sy1 + 1e-9 THEN 'relative_anchor_gap_clip_overflow' END) AS why FROM g)
SELECT artifact_id, page, box_id, {pr('gp', 4)} AS gap, {pr('ratio', 8)} AS gap_ratio, CASE WHEN why <> '' THEN 'fail' ELSE 'pass' END AS status, why AS failed_constraints FROM w""")
def g39(spark, d):
    return fr.relative_anchor_gap(view(spark, d, "v_boxes").selectExpr(*_split(ANCHOR))).select(
        *PAGE_KEY, "box_id", "gap", "gap_ratio", "status", "failed_constraints")


@query("g40_translation_to_target", f"""
SELECT artifact_id, page, box_id, {pr(f'(target*(x1-x0) - {GAP})*ux', 4)} AS shift_x, {pr(f'(target*(x1-x0) - {GAP})*uy', 4)} AS shift_y FROM {DIRECTION}""")
def g40(spark, d):
    return fr.translation_to_target(view(spark, d, "v_boxes").selectExpr(*_split(ANCHOR))).select(
        *PAGE_KEY, "box_id", "shift_x", "shift_y")


TARGET = ("artifact_id, page, box_id, x0 AS g_x0, y0 AS g_y0, x1 AS g_x1, y1 AS g_y1, x0 - 6 + 4 * (curves % 3) AS t_x0, y0 - 8 + 20 * (curves % 2) AS t_y0, "
          "x1 + 6 AS t_x1, y1 + 8 + 20 * (curves % 2) AS t_y1, CASE CAST(line_index % 3 AS INT) WHEN 0 THEN 'inside' WHEN 1 THEN 'outside' ELSE 'no_overlap' END AS relation, CAST(2 AS DOUBLE) AS min_gap")


@query("g41_frame_relation", f"""
WITH t AS (SELECT *, greatest(0.0, least(g_x1,t_x1)-greatest(g_x0,t_x0)) AS ox, greatest(0.0, least(g_y1,t_y1)-greatest(g_y0,t_y0)) AS oy,
  greatest(t_x0-g_x1, g_x0-t_x1, 0.0) AS hx, greatest(t_y0-g_y1, g_y0-t_y1, 0.0) AS hy FROM (SELECT {TARGET} FROM v_boxes)),
u AS (SELECT *, CASE WHEN relation='inside' THEN least(g_x0-t_x0, g_y0-t_y0, t_x1-g_x1, t_y1-g_y1) WHEN ox*oy = 0 THEN sqrt(hx*hx+hy*hy) ELSE -least(ox,oy) END AS g FROM t)
SELECT artifact_id, page, box_id, {pr('g', 4)} AS effective_gap, {pr('ox*oy', 4)} AS overlap_area,
  CASE WHEN relation='inside' THEN g >= 1.99 ELSE ox*oy <= 0.0001 AND g >= 1.99 END AS relation_pass FROM u""")
def g41(spark, d):
    return fr.frame_relation(view(spark, d, "v_boxes").selectExpr(*_split(TARGET))).select(
        *PAGE_KEY, "box_id", "effective_gap", "overlap_area", "relation_pass")


ALIGN = ("artifact_id, page, box_id, x0 AS g_x0, y0 AS g_y0, x1 AS g_x1, y1 AS g_y1, x0 - 10 AS f_x0, y0 - 8 AS f_y0, x1 + 10 + curves % 3 AS f_x1, y1 + 8 + curves % 4 AS f_y1, "
         "CAST(2 AS DOUBLE) AS pad_left, CAST(2 AS DOUBLE) AS pad_right, CAST(3 AS DOUBLE) AS pad_top, CAST(2 AS DOUBLE) AS pad_bottom, CAST(0.5 AS DOUBLE) AS tolerance, "
         "CASE WHEN line_index % 2 = 0 THEN 'center' ELSE 'start' END AS horizontal_align, CASE WHEN line_index % 3 = 0 THEN 'center' ELSE 'end' END AS vertical_align, "
         "bold AS single_line, line_index % 2 + 1 AS line_count")


@query("g42_alignment_check", f"""
WITH a AS (SELECT *, (g_x0+g_x1-(f_x0+pad_left)-(f_x1-pad_right))/2 AS dx, (g_y0+g_y1-(f_y0+pad_top)-(f_y1-pad_bottom))/2 AS dy FROM (SELECT {ALIGN} FROM v_boxes))
SELECT artifact_id, page, box_id, {pr('dx', 4)} AS delta_x, {pr('dy', 4)} AS delta_y,
  (horizontal_align <> 'center' OR abs(dx) <= 0.51) AND (vertical_align <> 'center' OR abs(dy) <= 0.51) AND (NOT single_line OR line_count = 1) AS aligned FROM a""")
def g42(spark, d):
    return fr.alignment_check(view(spark, d, "v_boxes").selectExpr(*_split(ALIGN))).select(
        *PAGE_KEY, "box_id", "delta_x", "delta_y", "aligned")


# the same measures as SQL functions
@query("sql_anchor_functions", f"""
SELECT artifact_id, page, box_id, {pr('gp', 4)} AS gap, {pr('(target*(x1-x0) - gp)*ux', 4)} AS shift_x, {pr('(target*(x1-x0) - gp)*uy', 4)} AS shift_y FROM (SELECT *, {GAP} AS gp FROM {DIRECTION})""")
def sql_anchors(spark, d):
    fsql.register(spark)
    rows = view(spark, d, "v_boxes").selectExpr(*_split(ANCHOR)).selectExpr(*PAGE_KEY, "box_id", "anchor_gap(ax, ay, dx, dy, x0, y0, x1, y1) AS g", "anchor_shift(ax, ay, dx, dy, x0, y0, x1, y1, target) AS s")
    return rows.select(*PAGE_KEY, "box_id", py_round(F.col("g"), 4).alias("gap"), py_round(F.col("s.dx"), 4).alias("shift_x"), py_round(F.col("s.dy"), 4).alias("shift_y"))


@query("sql_frame_functions", f"""
WITH t AS (SELECT *, greatest(0.0, least(g_x1,t_x1)-greatest(g_x0,t_x0)) AS ox, greatest(0.0, least(g_y1,t_y1)-greatest(g_y0,t_y0)) AS oy, greatest(t_x0-g_x1, g_x0-t_x1, 0.0) AS hx, greatest(t_y0-g_y1, g_y0-t_y1, 0.0) AS hy FROM (SELECT {TARGET} FROM v_boxes))
SELECT artifact_id, page, box_id, {pr("CASE WHEN relation='inside' THEN least(g_x0-t_x0, g_y0-t_y0, t_x1-g_x1, t_y1-g_y1) WHEN ox*oy = 0 THEN sqrt(hx*hx+hy*hy) ELSE -least(ox,oy) END", 4)} AS gap, {pr('(g_x0+g_x1-(t_x0+2)-(t_x1-3))/2', 4)} AS delta FROM t""")
def sql_frames(spark, d):
    fsql.register(spark)
    rows = view(spark, d, "v_boxes").selectExpr(*_split(TARGET)).selectExpr(*PAGE_KEY, "box_id", "frame_gap(relation, g_x0, g_y0, g_x1, g_y1, t_x0, t_y0, t_x1, t_y1) AS g", "center_delta(g_x0, g_x1, t_x0, t_x1, 2D, 3D) AS c")
    return rows.select(*PAGE_KEY, "box_id", py_round(F.col("g"), 4).alias("gap"), py_round(F.col("c"), 4).alias("delta"))


STEP_L = "artifact_id, page, block_id AS frame_id, line_index, min(line_index * 12.0 + CASE WHEN curves = 3 THEN 0.75 ELSE 0 END) AS baseline_y"
STEP_F = "artifact_id, page, block_id AS frame_id, 12.0 AS applied, 12.0 + 0.25 * (block_id % 3) AS requested, 0.5 AS tolerance"


@query("g43_line_step_check", f"""
WITH l AS (SELECT {STEP_L} FROM v_boxes GROUP BY artifact_id, page, block_id, line_index), f AS (SELECT DISTINCT {STEP_F} FROM v_boxes),
s AS (SELECT *, baseline_y - lag(baseline_y) OVER (PARTITION BY artifact_id, page, frame_id ORDER BY line_index) AS st FROM l),
g AS (SELECT artifact_id, page, frame_id, count(*) AS n, count(st) AS sample_count, avg(st) AS m, bool_and(abs(st - 12.0) <= 0.51) AS ok FROM s GROUP BY ALL)
SELECT artifact_id, page, frame_id, sample_count, {pr('coalesce(m, 12.0)', 4)} AS effective_step,
  CASE WHEN n = 1 THEN abs(requested - applied) <= tolerance + 1e-9 ELSE coalesce(ok, false) END AS spacing_pass FROM g JOIN f USING (artifact_id, page, frame_id)""")
def g43(spark, d):
    boxes = view(spark, d, "v_boxes")
    lines = boxes.groupBy("artifact_id", "page", F.col("block_id").alias("frame_id"), "line_index").agg(
        F.min(F.expr("line_index * 12.0D + CASE WHEN curves = 3 THEN 0.75D ELSE 0D END")).alias("baseline_y"))
    frames = boxes.selectExpr("artifact_id", "page", "block_id AS frame_id", "12D AS applied", "12.0D + 0.25D * (block_id % 3) AS requested", "0.5D AS tolerance").distinct()
    return fr.line_steps(lines, frames)


GROUP = ("artifact_id, page, block_id AS group_id, box_id AS frame_id, line_index AS spacing_index, line_index * 20.0 + CASE WHEN curves = 2 THEN 3 ELSE 0 END AS planned_y, "
         "CASE WHEN curves = 6 THEN NULL ELSE line_index * 20.0 + CASE WHEN bold THEN 1 ELSE 0 END END AS rendered_y, 20.0 AS applied, 0.5 AS tolerance")


@query("g44_group_step_check", f"""
WITH f AS (SELECT {GROUP} FROM v_boxes),
g AS (SELECT artifact_id, page, group_id, count(*) >= 2 AND max(spacing_index)-min(spacing_index)+1 = count(*) AND count(DISTINCT spacing_index) = count(*) AS ok FROM f GROUP BY ALL),
p AS (SELECT *, lag(frame_id) OVER w AS pf, planned_y - lag(planned_y) OVER w AS ps, rendered_y - lag(rendered_y) OVER w AS rs FROM f WINDOW w AS (PARTITION BY artifact_id, page, group_id ORDER BY spacing_index, frame_id))
SELECT artifact_id, page, group_id, frame_id, spacing_index, ok AS group_ok, {pr('ps', 4)} AS planned_step, abs(ps - 20) <= 0.5 AS planned_ok, {pr('rs', 4)} AS rendered_step,
  coalesce(abs(rs - 20) <= 0.51, false) AS rendered_ok FROM p JOIN g USING (artifact_id, page, group_id) WHERE pf IS NOT NULL""")
def g44(spark, d):
    frames = view(spark, d, "v_boxes").selectExpr(*_split(GROUP)).withColumn(
        "planned_y", F.col("planned_y").cast("double")).withColumn("rendered_y", F.col("rendered_y").cast("double"))
    return fr.group_steps(frames)


@query("g45_table_tiling", """
WITH r AS (SELECT concat('g', CAST(o_orderkey AS VARCHAR)) AS group_id, concat('t', CAST(o_orderkey AS VARCHAR), '-', CAST(i AS VARCHAR)) AS target_id,
   CAST(i + CASE WHEN o_orderkey % 7 = 0 AND i = 2 THEN 1 ELSE 0 END AS INT) AS row_index, CAST(10 AS DOUBLE) AS x, i * 20.0 + CASE WHEN o_orderkey % 5 = 0 AND i = 1 THEN 0.5 ELSE 0 END AS y,
   CAST(200 AS DOUBLE) AS w, CAST(20 AS DOUBLE) AS h, 'surface' AS kind, CASE WHEN o_orderkey % 11 = 0 AND i = 0 THEN 's2' ELSE 's1' END AS style
  FROM orders, unnest(range(4)) AS u(i) WHERE i <= o_orderkey % 4),
p AS (SELECT *, lag(row_index) OVER v AS pi, lag(y) OVER v AS py, lag(style) OVER v AS pst FROM r WINDOW v AS (PARTITION BY group_id ORDER BY row_index, target_id))
SELECT group_id, count(*) AS row_count, count(*) >= 2 AND min(row_index) = 0 AND max(row_index) = count(*) - 1
   AND coalesce(bool_and(row_index = pi + 1 AND abs(y - (py + 20)) <= 0.01 AND style = pst) FILTER (WHERE pi IS NOT NULL), false) AS valid,
  CAST(10 AS DOUBLE) AS x, CAST(min(y) AS DOUBLE) AS y, CAST(200 AS DOUBLE) AS w, CAST(max(y) + 20 - min(y) AS DOUBLE) AS h FROM p GROUP BY group_id""")
def g45(spark, d):
    rows = load(spark, d, "orders").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).where("i <= o_orderkey % 4").selectExpr(
        "concat('g', CAST(o_orderkey AS STRING)) AS group_id", "concat('t', CAST(o_orderkey AS STRING), '-', CAST(i AS STRING)) AS target_id",
        "i + IF(o_orderkey % 7 = 0 AND i = 2, 1, 0) AS row_index", "10D AS x", "i * 20.0D + IF(o_orderkey % 5 = 0 AND i = 1, 0.5D, 0D) AS y", "200D AS w", "20D AS h",
        "'surface' AS kind", "IF(o_orderkey % 11 = 0 AND i = 0, 's2', 's1') AS style")
    return fr.table_groups(rows)


@query("g46_target_conflicts", """
WITH r AS (SELECT l_orderkey % 5000 AS target_id, 'surface' AS kind, CAST(l_orderkey % 5000 AS DOUBLE) AS x0, CASE WHEN l_partkey % 50 = 0 THEN 1.0 ELSE 0.0 END AS y0,
  CASE WHEN l_suppkey % 90 = 1 THEN 's2' WHEN l_orderkey % 5000 < 100 THEN NULL ELSE 's1' END AS style FROM lineitem)
SELECT target_id, count(*) AS n FROM r GROUP BY 1 HAVING count(DISTINCT concat_ws('|', kind, CAST(x0 AS VARCHAR), CAST(y0 AS VARCHAR), coalesce(style, ''))) > 1""")
def g46(spark, d):
    rel = load(spark, d, "lineitem").selectExpr(
        "l_orderkey % 5000 AS target_id", "'surface' AS kind", "CAST(l_orderkey % 5000 AS DOUBLE) AS x0", "IF(l_partkey % 50 = 0, 1D, 0D) AS y0",
        "100D AS x1", "100D AS y1", "CASE WHEN l_suppkey % 90 = 1 THEN 's2' WHEN l_orderkey % 5000 < 100 THEN NULL ELSE 's1' END AS style")
    return fr.target_conflicts(rel)


SURF = ("artifact_id, page, card_id AS component_id, x0 + 40 AS x0, y0 + 30 AS y0, x1 AS x1, y1 AS y1, artifact_id % 4 <> 0 AS outlined")
TEXT = ("artifact_id, page, box_id AS text_id, CASE WHEN curves = 1 THEN 'someone' END AS owner_id, curves = 2 AS overlay, x0, y0, x1, y1")


@query("g47_perimeter_contact", f"""
WITH s AS (SELECT {SURF} FROM v_cards), t AS (SELECT {TEXT} FROM v_boxes),
p AS (SELECT b.artifact_id, b.page, b.component_id, a.text_id, b.x0 sx0, b.y0 sy0, b.x1 sx1, b.y1 sy1, a.x0 tx0, a.y0 ty0, a.x1 tx1, a.y1 ty1
  FROM t a JOIN s b ON {PAGE} WHERE b.outlined AND a.owner_id IS NULL AND NOT a.overlay),
e AS (SELECT artifact_id, page, component_id, text_id, least(sx1,tx1)-greatest(sx0,tx0) AS length, 'top' AS edge, greatest(sx0,tx0) AS start_at, least(sx1,tx1) AS end_at, sy0 AS line_at FROM p WHERE ty0 <= sy0 AND sy0 <= ty1
  UNION ALL SELECT artifact_id, page, component_id, text_id, least(sx1,tx1)-greatest(sx0,tx0), 'bottom', greatest(sx0,tx0), least(sx1,tx1), sy1 FROM p WHERE ty0 <= sy1 AND sy1 <= ty1
  UNION ALL SELECT artifact_id, page, component_id, text_id, least(sy1,ty1)-greatest(sy0,ty0), 'left', greatest(sy0,ty0), least(sy1,ty1), sx0 FROM p WHERE tx0 <= sx0 AND sx0 <= tx1
  UNION ALL SELECT artifact_id, page, component_id, text_id, least(sy1,ty1)-greatest(sy0,ty0), 'right', greatest(sy0,ty0), least(sy1,ty1), sx1 FROM p WHERE tx0 <= sx1 AND sx1 <= tx1)
SELECT artifact_id, page, component_id, text_id, length, edge, start_at, end_at, line_at, CAST(0 AS BIGINT) AS duplicates FROM (
  SELECT *, row_number() OVER (PARTITION BY artifact_id, page, component_id, text_id ORDER BY length DESC, edge DESC) AS rn FROM e WHERE length > 0) WHERE rn = 1""")
def g47(spark, d):
    return fr.perimeter_contact(view(spark, d, "v_cards").selectExpr(*_split(SURF)), view(spark, d, "v_boxes").selectExpr(*_split(TEXT)))


SREG = ("artifact_id, page, card_id AS region_id, x0, y0, x1 + CASE WHEN artifact_id % 3 = 0 THEN 90 ELSE 0 END AS x1, y1 + CASE WHEN artifact_id % 3 = 0 THEN 100 ELSE 0 END AS y1, "
        "CASE CAST(artifact_id % 5 AS INT) WHEN 0 THEN 'Code_block' WHEN 1 THEN 'big-question' WHEN 2 THEN 'warning' WHEN 3 THEN ' Answer' ELSE 'decoder' END AS caller_role")
SURFACES = f"""(
WITH s AS (SELECT {SREG} FROM v_cards)
SELECT o.artifact_id, o.page, o.region_id, CASE CAST(o.artifact_id % 5 AS INT) WHEN 0 THEN 'code' WHEN 1 THEN 'question' WHEN 2 THEN 'warning' WHEN 3 THEN 'answer' ELSE 'caller-defined' END AS role_class,
  {pr('(x1-x0)*(y1-y0)/(width*height)', 6)} AS area_ratio, occupancy, bottom_blank_ratio, {pr('(x1-x0)*(y1-y0)/(width*height)', 6)} > 0.6 AS too_large,
  occupancy < 0.35 AND bottom_blank_ratio > 0.45 AS sparse, false AS no_page,
  CASE WHEN {pr('(x1-x0)*(y1-y0)/(width*height)', 6)} > 0.6 OR (occupancy < 0.35 AND bottom_blank_ratio > 0.45) THEN 'REVIEW_CANDIDATE' ELSE 'INFO' END AS classification
FROM {occupancy_sql('s', 'region_id')} o JOIN v_pages USING (artifact_id, page))"""


@query("g48_surface_metrics", f"SELECT * FROM {SURFACES}")
def g48(spark, d):
    return fr.surface_metrics(view(spark, d, "v_cards").selectExpr(*_split(SREG)), view(spark, d, "v_pages"), view(spark, d, "v_boxes"))


@query("g48_surface_summary", f"""
SELECT artifact_id, count(*) AS surface_count, max(area_ratio) AS max_area_ratio, min(occupancy) AS min_occupancy, max(bottom_blank_ratio) AS max_blank_ratio,
  count(*) FILTER (WHERE classification='REVIEW_CANDIDATE') AS review_count, CAST(0 AS BIGINT) AS hard_count FROM {SURFACES} GROUP BY 1""")
def g48_summary(spark, d):
    return fr.surface_summary(g48(spark, d))


RUNS = """(WITH p AS (SELECT DISTINCT scope_id, page FROM v_blocks WHERE tier = 'hero'), i AS (SELECT *, page - row_number() OVER (PARTITION BY scope_id ORDER BY page) AS k FROM p),
f AS (SELECT scope_id, page, min(page) OVER (PARTITION BY scope_id, k) AS first_page FROM i) SELECT scope_id, page, first_page FROM f)"""


@query("g49_page_runs", f"""
SELECT scope_id, first_page, max(page) AS last_page, count(*) AS region_count, max(page) - first_page + 1 AS length FROM {RUNS} JOIN
 (SELECT scope_id, page FROM v_blocks WHERE tier='hero') USING (scope_id, page) GROUP BY scope_id, first_page HAVING max(page) - first_page + 1 > 2""")
def g49(spark, d):
    return fr.page_runs(view(spark, d, "v_blocks").withColumn("region_id", F.col("block_id")), ["hero"], 2)


@query("g50_surface_identity", """
WITH st AS (SELECT p_partkey AS region_id, s.state AS state, CASE WHEN p_size % 4 = 0 THEN 'none' ELSE 'box' END AS topology, p_size AS page FROM part, (VALUES ('requested'), ('applied'), ('effective')) AS s(state)
   WHERE NOT (p_partkey % 19 = 0 AND s.state = 'applied')),
sh AS (SELECT p_partkey AS region_id, concat('s', CAST(p_partkey AS VARCHAR)) AS shape_id, CASE WHEN p_partkey % 13 = 0 THEN p_size + 1 ELSE p_size END AS page FROM part WHERE p_size % 4 <> 0 AND p_partkey % 17 <> 0
   UNION ALL SELECT p_partkey, 'x', p_size FROM part WHERE p_partkey % 23 = 0 UNION ALL SELECT -1 - p_partkey, 'y', p_size FROM part WHERE p_partkey % 29 = 0),
k AS (SELECT region_id, count(DISTINCT state) = 3 AS ok, max(topology) AS topology, max(page) AS page FROM st GROUP BY 1),
n AS (SELECT region_id, count(*) AS n, min(page) AS lo, max(page) AS hi FROM sh GROUP BY 1),
j AS (SELECT region_id, coalesce(n.n, 0) AS n_shapes, concat_ws(',', CASE WHEN k.ok IS NULL THEN 'unknown_marker' END, CASE WHEN NOT k.ok THEN 'state_set_mismatch' END,
   CASE WHEN k.ok IS NOT NULL AND coalesce(n.n, 0) <> CASE WHEN topology = 'none' THEN 0 ELSE 1 END THEN 'shape_count' END,
   CASE WHEN k.ok IS NOT NULL AND (lo <> k.page OR hi <> k.page) THEN 'page_mismatch' END) AS failures FROM k FULL JOIN n USING (region_id))
SELECT * FROM j WHERE failures <> ''""")
def g50(spark, d):
    part = load(spark, d, "part")
    states = part.withColumn("state", F.explode(F.array(*map(F.lit, ["requested", "applied", "effective"])))).where(
        "NOT (p_partkey % 19 = 0 AND state = 'applied')").selectExpr(
        "p_partkey AS region_id", "state", "IF(p_size % 4 = 0, 'none', 'box') AS topology", "p_size AS page")
    shapes = part.where("p_size % 4 <> 0 AND p_partkey % 17 <> 0").selectExpr(
        "p_partkey AS region_id", "concat('s', p_partkey) AS shape_id", "IF(p_partkey % 13 = 0, p_size + 1, p_size) AS page")
    shapes = shapes.unionByName(part.where("p_partkey % 23 = 0").selectExpr("p_partkey AS region_id", "'x' AS shape_id", "p_size AS page"))
    shapes = shapes.unionByName(part.where("p_partkey % 29 = 0").selectExpr("-1 - p_partkey AS region_id", "'y' AS shape_id", "p_size AS page"))
    return fr.surface_identity(states, shapes)


EFFECT = ("p_partkey AS region_id, CASE WHEN p_size % 2 = 0 THEN 'none' ELSE 'raised' END AS elevation_class, p_size % 3 = 0 AS shadow_present, CAST(p_size % 5 % 2 AS INT) AS shadow_count, "
          "CASE WHEN p_size % 7 = 0 THEN 3 WHEN p_size % 7 = 1 THEN 0 END AS theme_ref, CASE WHEN p_size % 11 = 0 THEN 'theme' ELSE 'adapter-direct' END AS shadow_source")


@query("g51_elevation_effect", f"""
SELECT region_id, CASE WHEN elevation_class='none' THEN NOT shadow_present AND shadow_count = 0 AND coalesce(theme_ref, 0) = 0
  ELSE shadow_present AND shadow_count = 1 AND coalesce(theme_ref, 0) = 0 AND shadow_source = 'adapter-direct' END AS ok FROM (SELECT {EFFECT} FROM part)""")
def g51(spark, d):
    return load(spark, d, "part").selectExpr(*_split(EFFECT)).select("region_id", fr.elevation_ok().alias("ok"))


@query("g52_component_geometry", """
SELECT p_partkey AS component_id, concat_ws(',', CASE WHEN p_size % 5 = 0 AND p_size % 3 > 0 THEN 'undeclared_divider' END, CASE WHEN p_size % 7 = 0 AND p_size % 2 > 0 THEN 'wrapper_border' END,
  CASE WHEN p_size % 3 > 0 AND (p_size % 13 = 0 OR p_size % 6 >= 4) THEN 'divider_geometry' END, CASE WHEN p_size % 4 > 0 AND (p_size % 9 = 0 OR p_size % 10 = 1) THEN 'connector_geometry' END) AS failures FROM part""")
def g52(spark, d):
    divider = "named_struct('foreground', p_size % 13 = 0, 'crosses_text', false, 'gap_above', CAST(p_size % 6 AS DOUBLE), 'gap_below', 4D)"
    connector = "named_struct('behind_surfaces', p_size % 9 <> 0, 'clipped', true, 'text_crossings', IF(p_size % 10 = 1, 1, 0), 'interior_length', 0D)"
    return fr.component_geometry(load(spark, d, "part").selectExpr(
        "p_partkey AS component_id", "IF(p_size % 5 = 0, 'none', 'between') AS divider_policy", "IF(p_size % 7 = 0, 'none', 'thin') AS wrapper_border",
        "p_size % 2 AS border_count", f"IF(p_size % 3 > 0, array({divider}), filter(array({divider}), x -> false)) AS dividers",
        f"IF(p_size % 4 > 0, array({connector}), filter(array({connector}), x -> false)) AS connectors"))
