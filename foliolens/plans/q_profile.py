"""Queries over region ranking, artifact profiles, fonts and glyphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import PAGE_KEY
from ..operators import profile as pf
from .q_layout import _split
from .registry import query
from .sqltext import INTER, OX, OY, PAGE, pr
from .views import load, view

CAND = ("artifact_id, page, card_id AS candidate_id, x0 + 20 AS x0, y0 + 10 AS y0, x0 + 320 AS x1, y0 + 160 AS y1")


@query("g53_region_iou_rank", f"""
WITH c AS (SELECT {CAND} FROM v_cards),
s AS (SELECT a.artifact_id, a.page, a.candidate_id, b.region_id, (b.x1-b.x0)*(b.y1-b.y0) AS ra, {INTER} AS sh, (a.x1-a.x0)*(a.y1-a.y0) AS ca
  FROM c a JOIN v_regions b ON {PAGE} WHERE {OX} > 0 AND {OY} > 0),
m AS (SELECT *, {pr('sh / (ca + ra - sh)', 6)} AS iou, {pr('sh / greatest(1.0, ra)', 6)} AS coverage FROM s),
r AS (SELECT *, {pr('iou * 2.0 + coverage', 6)} AS score FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY artifact_id, page, candidate_id ORDER BY score DESC, ra, region_id) AS rank FROM r),
l AS (SELECT artifact_id, page, candidate_id, string_agg(box_id, ',' ORDER BY box_id) AS line_ids FROM (
  SELECT a.artifact_id, a.page, a.candidate_id, b.box_id, row_number() OVER (PARTITION BY a.artifact_id, a.page, a.candidate_id ORDER BY b.box_id) AS rn
  FROM c a JOIN v_boxes b ON {PAGE} WHERE {OX} > 0 AND {OY} > 0) GROUP BY ALL)
SELECT artifact_id, page, candidate_id, rank, region_id, score, iou, coverage, line_ids FROM k LEFT JOIN l USING (artifact_id, page, candidate_id)""")
def g53(spark, d):
    return pf.region_iou_rank(view(spark, d, "v_cards").selectExpr(*_split(CAND)), view(spark, d, "v_regions"), view(spark, d, "v_boxes"))


@query("g54_region_readback", f"""
WITH r AS (SELECT artifact_id, page, card_id AS region_id, x0, y0, x1, y1 FROM v_cards),
i AS (SELECT a.artifact_id, a.page, a.region_id, b.box_id, b.x0, b.y0, b.x1, b.y1 FROM r a JOIN v_boxes b ON {PAGE} WHERE {OX} > 0 AND {OY} > 0),
s AS (SELECT *, y0 - lag(y0) OVER (PARTITION BY artifact_id, page, region_id ORDER BY y0, box_id) AS st FROM i),
g AS (SELECT artifact_id, page, region_id, count(*) AS n, min(x0) ix0, min(y0) iy0, max(x1) ix1, max(y1) iy1, min(st) FILTER (WHERE st > 0.5) AS pitch_min, max(st) FILTER (WHERE st > 0.5) AS pitch_max FROM s GROUP BY ALL),
c AS (SELECT a.artifact_id, a.page, a.region_id, count(*) AS cc FROM r a JOIN v_regions b ON {PAGE} WHERE {OX} > 0 AND {OY} > 0 GROUP BY ALL)
SELECT r.artifact_id, r.page, r.region_id, coalesce(n, 0) AS line_count, ix0 AS left_pt, iy0 AS top_pt, width - ix1 AS right_pt, height - iy1 AS bottom_pt, pitch_min, pitch_max, coalesce(cc, 0) AS candidate_count
FROM r LEFT JOIN g USING (artifact_id, page, region_id) LEFT JOIN c USING (artifact_id, page, region_id) LEFT JOIN v_pages USING (artifact_id, page)""")
def g54(spark, d):
    regions = view(spark, d, "v_cards").withColumnRenamed("card_id", "region_id")
    return pf.region_readback(regions, view(spark, d, "v_boxes"), view(spark, d, "v_pages"),
                              view(spark, d, "v_regions").withColumnRenamed("region_id", "candidate_id"))


def _spread(name: str, digits: int, src: str | None = None) -> str:
    src = src or name
    return ", ".join(f"{pr(f'{fn}({src})', digits)} AS {name}_{sfx}" for fn, sfx in (("min", "min"), ("median", "median"), ("max", "max")))


# a few pages per artifact and many artifacts per class
P_LINES = "CAST(floor(artifact_id / 4) AS BIGINT) AS artifact_id, CAST(artifact_id % 4 + 1 AS INT) AS page, box_id, x0, y0, x1, y1, chars, font_size"
P_PAGES = "CAST(floor(artifact_id / 4) AS BIGINT) AS artifact_id, CAST(artifact_id % 4 + 1 AS INT) AS page, width, height, rotation"
PROFILE = """
WITH l AS (SELECT {lines} FROM v_boxes), p AS (SELECT {pages} FROM v_pages),
c AS (SELECT artifact_id, page, count(*) AS n, sum(chars) AS ch FROM l GROUP BY ALL),
v AS (SELECT artifact_id, page, sum(greatest(0.0, hi - greatest(lo, coalesce(reach, lo)))) AS covered FROM (
   SELECT artifact_id, page, lo, hi, max(hi) OVER (PARTITION BY artifact_id, page ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (
     SELECT l.artifact_id, l.page, greatest(0.0, y0) AS lo, least(height, y1) AS hi FROM l JOIN p USING (artifact_id, page)) WHERE hi > lo) GROUP BY ALL),
pg AS (SELECT p.*, coalesce(n, 0) AS line_count, coalesce(ch, 0) AS char_count, least(1.0, coalesce(covered, 0.0) / height) AS coverage
  FROM p LEFT JOIN c USING (artifact_id, page) LEFT JOIN v USING (artifact_id, page)),
gp AS (SELECT artifact_id, page, font_size, lead(y0) OVER (PARTITION BY artifact_id, page ORDER BY y0, x0, box_id) - y1 AS gap FROM l)
"""


@query("g55_artifact_profile", PROFILE.format(lines=P_LINES, pages=P_PAGES) + f"""
, a AS (SELECT artifact_id, count(*) AS page_count, count(DISTINCT (width, height)) AS size_variants, count(*) FILTER (WHERE rotation <> 0) AS rotated_pages,
  count(*) FILTER (WHERE line_count = 0) AS empty_pages, sum(line_count)::BIGINT AS line_total, sum(char_count)::BIGINT AS char_total,
  {_spread('width', 4)}, {_spread('height', 4)}, {_spread('line_count', 2)}, {_spread('char_count', 2)}, {_spread('coverage', 6)} FROM pg GROUP BY 1),
b AS (SELECT artifact_id, {_spread('gap', 4)}, {_spread('font_size', 4)} FROM gp GROUP BY 1)
SELECT * FROM a LEFT JOIN b USING (artifact_id)""")
def g55(spark, d):
    return pf.artifact_profile(view(spark, d, "v_boxes").selectExpr(*_split(P_LINES)), view(spark, d, "v_pages").selectExpr(*_split(P_PAGES)))


CLAMP = "artifact_id, page, box_id, x0, y0, x1 + CASE WHEN curves = 3 THEN 0.00390625 ELSE 0 END AS x1, y1"


@query("g56_region_clamp", f"""
WITH r AS (SELECT CASE WHEN line_index % 2 = 0 THEN 595 - x0 ELSE x1 - x0 END AS w, artifact_id, page, box_id, x0, y0, y1, curves FROM v_boxes),
s AS (SELECT artifact_id, page, box_id, x0, y0, x0 + w + CASE WHEN curves = 3 THEN 0.00390625 WHEN curves = 4 THEN 0.5 ELSE 0 END AS x1, y1 FROM r),
t AS (SELECT s.*, width, height, NOT (x0 < 0 OR y0 < 0 OR x1 <= x0 OR y1 <= y0 OR x1 > width + 0.005 OR y1 > height + 0.005 OR least(x1, width) <= x0 OR least(y1, height) <= y0) AS valid
  FROM s JOIN v_pages USING (artifact_id, page))
SELECT artifact_id, page, box_id, CASE WHEN valid THEN x0 END AS x0, CASE WHEN valid THEN y0 END AS y0, CASE WHEN valid THEN least(x1, width) END AS x1,
  CASE WHEN valid THEN least(y1, height) END AS y1, valid, valid AND (least(x1, width) <> x1 OR least(y1, height) <> y1) AS clamped FROM t""")
def g56(spark, d):
    regions = view(spark, d, "v_boxes").selectExpr(
        "artifact_id", "page", "box_id", "x0", "y0",
        "x0 + CASE WHEN line_index % 2 = 0 THEN 595 - x0 ELSE x1 - x0 END + CASE WHEN curves = 3 THEN 0.00390625D WHEN curves = 4 THEN 0.5D ELSE 0D END AS x1", "y1")
    return pf.region_clamp(regions, view(spark, d, "v_pages"))


@query("g57_context_rect", """
SELECT artifact_id, page, box_id, greatest(0.0, x0 - mx) AS cx0, greatest(0.0, y0 - my) AS cy0, least(width, x1 + mx) AS cx1, least(height, y1 + my) AS cy1 FROM (
 SELECT b.*, width, height, greatest(36.0, (x1-x0)*0.25) AS mx, greatest(36.0, (y1-y0)*0.25) AS my FROM v_boxes b JOIN v_pages USING (artifact_id, page))""")
def g57(spark, d):
    joined = view(spark, d, "v_boxes").join(view(spark, d, "v_pages").select(*PAGE_KEY, "width", "height"), PAGE_KEY)
    return pf.context_rect(joined).select(*PAGE_KEY, "box_id", "cx0", "cy0", "cx1", "cy1")


@query("g58_to_pixels", """
SELECT artifact_id, page, box_id, greatest(0, least(700, CAST(floor(x0*1.25) AS INT))) AS px0, greatest(0, least(800, CAST(floor(y0*1.25) AS INT))) AS py0,
  greatest(0, least(700, CAST(ceil(x1*1.25) AS INT))) AS px1, greatest(0, least(800, CAST(ceil(y1*1.25) AS INT))) AS py1 FROM v_boxes""")
def g58_pixels(spark, d):
    return pf.to_pixels(view(spark, d, "v_boxes"), F.lit(1.25), F.lit(700), F.lit(800)).select(
        *PAGE_KEY, "box_id", "px0", "py0", "px1", "py1")


NORMED = ("artifact_id, page, box_id, CAST(curves AS DOUBLE) / 8 AS n_x0, CAST(line_index AS DOUBLE) / 8 AS n_y0, CAST(line_index AS DOUBLE) / 4 AS n_x1, CAST(curves AS DOUBLE) / 16 AS n_y1, "
          "CAST(800 AS DOUBLE) AS img_w, CAST(1000 AS DOUBLE) AS img_h, CAST(40 AS DOUBLE) AS c_x0, CAST(50 AS DOUBLE) AS c_y0, CAST(760 AS DOUBLE) AS c_x1, CAST(950 AS DOUBLE) AS c_y1, "
          "CAST(0 AS DOUBLE) AS o_x0, CAST(0 AS DOUBLE) AS o_y0, CAST(595 AS DOUBLE) AS o_x1, CAST(842 AS DOUBLE) AS o_y1")


@query("g58_to_points", f"""
WITH n AS (SELECT *, 595.0::DOUBLE / 720 AS sx, 842.0::DOUBLE / 900 AS sy FROM (SELECT {NORMED} FROM v_boxes)),
m AS (SELECT *, (least(greatest(n_x0*800, 40), 760) - 40) * sx AS a0, (least(greatest(n_x1*800, 40), 760) - 40) * sx AS a1,
  (least(greatest(n_y0*1000, 50), 950) - 50) * sy AS b0, (least(greatest(n_y1*1000, 50), 950) - 50) * sy AS b1 FROM n)
SELECT artifact_id, page, box_id, {pr('least(a0,a1)', 2)} AS x0, {pr('least(b0,b1)', 2)} AS y0, {pr('greatest(a0,a1)', 2)} AS x1, {pr('greatest(b0,b1)', 2)} AS y1 FROM m""")
def g58_points(spark, d):
    return pf.to_points(view(spark, d, "v_boxes").selectExpr(*_split(NORMED))).select(*PAGE_KEY, "box_id", "x0", "y0", "x1", "y1")


TRIAL = ("l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS candidate_ord, concat('r', CAST(l_orderkey % 3000 AS STRING)) AS region_id, "
         "CASE WHEN l_linenumber = 7 THEN 'heading' ELSE 'body' END AS role, l_orderkey % 8 <> 0 AS is_target, CASE WHEN l_partkey % 5 = 0 THEN 'control' ELSE 'trial' END AS kind, "
         "1 + CAST(l_suppkey % 9 AS DOUBLE) / 8 AS source_ratio, CAST(1.25 AS DOUBLE) AS control_ratio, 1 + CAST(l_linenumber AS DOUBLE) / 8 AS ratio_min, "
         "2 + CAST(l_linenumber AS DOUBLE) / 8 AS ratio_max, CAST(l_quantity AS INT) % 7 AS line_count, l_partkey % 13 <> 0 AS preserved, "
         "CASE WHEN l_suppkey % 10 = 3 THEN 'line_spacing_overflow' WHEN l_suppkey % 10 = 4 THEN 'line_spacing_overlap' END AS defect")


@query("g59_line_spacing_candidates", f"""
WITH t AS (SELECT *, CASE WHEN kind <> 'control' AND (source_ratio > 1.75 + 1e-9 OR source_ratio NOT IN (1.0, 1.125, 1.375, 1.5, 1.625, 1.75)) THEN 'line_spacing_contract_limit_exceeded'
   WHEN kind <> 'control' AND source_ratio <= control_ratio + 1e-9 THEN 'not_above_control' WHEN NOT preserved THEN 'line_spacing_preservation_mismatch'
   WHEN defect IS NOT NULL THEN defect WHEN line_count < 2 THEN 'line_spacing_text_reflow_mismatch' ELSE 'candidate' END AS outcome
  FROM (SELECT {TRIAL} FROM lineitem) WHERE is_target AND role = 'body')
SELECT region_id, min(candidate_ord) AS candidate_ord, 'candidate' AS outcome FROM t WHERE outcome = 'candidate' GROUP BY region_id, {pr('ratio_min', 3)}, {pr('ratio_max', 3)}
UNION ALL SELECT region_id, candidate_ord, outcome FROM t WHERE outcome NOT IN ('candidate', 'not_above_control')""")
def g59(spark, d):
    return pf.line_spacing_candidates(load(spark, d, "lineitem").selectExpr(*_split(TRIAL)), 1.75, [1.0, 1.125, 1.375, 1.5, 1.625, 1.75])


@query("g60_source_order", """
WITH m AS (SELECT user_id AS relation_id, event_id AS pos, CASE WHEN user_id % 3 = 0 THEN event_id ELSE event_id % 50 END AS z FROM events),
p AS (SELECT *, lag(z) OVER (PARTITION BY relation_id ORDER BY pos) AS pz FROM m)
SELECT relation_id, coalesce(bool_and(pz <= z), true) AS source_order_pass FROM p GROUP BY 1""")
def g60(spark, d):
    return pf.source_order(load(spark, d, "events").selectExpr(
        "user_id AS relation_id", "event_id AS pos", "CASE WHEN user_id % 3 = 0 THEN event_id ELSE event_id % 50 END AS z"))


@query("g61_font_missing_or_fallback", """
WITH f AS (SELECT artifact_id, page, box_id, lower(regexp_replace(font, '[^A-Za-z0-9]', '', 'g')) AS n, has_cjk, curves FROM v_boxes)
SELECT artifact_id, page, box_id, 'unsupported' AS status, 'font_name_unavailable' AS reason FROM f WHERE n = ''
UNION ALL SELECT artifact_id, page, box_id, 'fail', 'cjk_font_does_not_match_policy' FROM f WHERE has_cjk AND NOT (n LIKE '%bizudgothic%' OR n LIKE '%notosansjp%')
UNION ALL SELECT artifact_id, page, box_id, 'review', 'replacement_glyph_requires_appearance_review' FROM f WHERE curves = 0""")
def g61(spark, d):
    lines = view(spark, d, "v_boxes").withColumn("replacements", F.expr("IF(curves = 0, 1, 0)"))
    return pf.font_rule(lines, ["BIZ UDGothic", "Noto Sans JP"])


FONTS = ("p_partkey % 97 AS host_id, CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN 'BIZ UDPGothic' WHEN 1 THEN 'UD P Gothic' WHEN 2 THEN 'BIZ UD Gothic' WHEN 3 THEN 'Noto Sans JP' "
         "WHEN 4 THEN 'IPAGothic' WHEN 5 THEN 'Noto Serif JP' ELSE 'Helvetica' END AS family, CASE WHEN p_size % 2 = 0 THEN 'Regular' ELSE 'Bold' END AS style, "
         "concat('/fonts/', CAST(p_partkey AS STRING)) AS path, CASE WHEN p_size % 5 = 0 THEN 'Arial' WHEN p_partkey % 9 = 1 THEN 'BIZ UDPGothic' ELSE CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN 'BIZ UDPGothic' WHEN 2 THEN 'UD Gothic' "
         "WHEN 3 THEN 'Noto Sans JP' WHEN 4 THEN 'IPA Gothic' WHEN 5 THEN 'Noto Serif JP' ELSE 'Helvetica' END END AS readback_family")


@query("g62_rank_fonts", f"""
WITH al(a, g, i) AS (VALUES ('bizudpgothic',0,0),('bizudpゴシック',0,1),('udpgothic',0,4),('bizudgothic',1,2),('udgothic',1,4),('notosansjp',2,0),('notoserifjp',3,0),('ipagothic',4,1),('ipamincho',5,1)),
f AS (SELECT *, lower(replace(family, ' ', '')) AS n, lower(replace(readback_family, ' ', '')) AS r FROM (SELECT {FONTS} FROM part)),
al0(a, g, i) AS (VALUES ('bizudpgothic',0,0),('udpgothic',0,3),('bizudgothic',1,0),('udgothic',1,3),('notosansjp',2,0),('notoserifjp',3,0),('ipagothic',4,0)),
h AS (SELECT f.*, x.g, x.i, CASE WHEN style = 'Regular' THEN 0 ELSE 1 END AS rr FROM f JOIN al0 x ON x.a = f.n JOIN al0 y ON y.a = f.r AND y.g = x.g),
o AS (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY g, i, rr, path) AS rn FROM h)
SELECT host_id, list_extract(['ud-p-gothic-primary','ud-gothic-secondary','noto-sans-jp-tertiary','noto-serif-jp-tertiary','ipa-gothic-tertiary','ipa-mincho-tertiary'], g + 1) AS priority,
  i AS alias_rank, rr AS regular_rank, path, family FROM o WHERE rn = 1""")
def g62(spark, d):
    return pf.rank_fonts(load(spark, d, "part").selectExpr(*_split(FONTS)))


GLYPHS = ("l_orderkey % 500 AS region_id, concat(CASE WHEN l_linenumber % 2 = 0 THEN 'ABCDEF+' ELSE '' END, CASE WHEN l_partkey % 50 = 0 THEN 'Odd' ELSE 'Noto Sans' END) AS font_name, l_suppkey % 60 <> 0 AS contained")
FACES = ("l_orderkey % 500 AS region_id, l_linenumber + 10 AS font_id, concat('XYZABC+Noto', CASE WHEN l_linenumber % 2 = 0 THEN 'Sans' ELSE '-Sans' END) AS font_name, l_orderkey % 40 <> 0 AS embedded")


@query("g63_glyph_font_groups", f"""
WITH g AS (SELECT *, lower(regexp_replace(regexp_replace(font_name, '^[A-Z]{{6}}\\+', ''), '[^A-Za-z0-9]', '', 'g')) AS k FROM (SELECT {GLYPHS} FROM lineitem)),
f AS (SELECT region_id, lower(regexp_replace(regexp_replace(font_name, '^[A-Z]{{6}}\\+', ''), '[^A-Za-z0-9]', '', 'g')) AS k, min(font_id) AS font_id, bool_and(embedded) AS embedded FROM (SELECT {FACES} FROM lineitem) GROUP BY ALL)
SELECT region_id, count(*) AS glyph_count, count(*) FILTER (WHERE font_id IS NULL) AS unmapped, min(font_id) AS lowest_font_id,
  bool_and(font_id IS NOT NULL AND contained AND coalesce(embedded, false)) AS sufficient FROM g LEFT JOIN f USING (region_id, k) GROUP BY 1""")
def g63(spark, d):
    items = load(spark, d, "lineitem")
    return pf.glyph_font_groups(items.selectExpr(*_split(GLYPHS)), items.selectExpr(*_split(FACES)))


GL = "artifact_id % 300 AS region_id, CAST(curves AS INT) AS font_id, CASE WHEN bold THEN 16 ELSE 0 END AS flags, has_cjk AS contained, x0, y0, x1, y1"
TOT = "count(*) AS n, count(*) FILTER (WHERE contained) AS n_contained, count(*) FILTER (WHERE font_id = 0) AS n_unmapped, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1"


@query("g64_glyph_summary", f"""
WITH g AS (SELECT {GL} FROM v_boxes)
SELECT region_id, font_id, flags, contained, {TOT}, false AS is_total FROM g GROUP BY region_id, font_id, flags, contained
UNION ALL SELECT region_id, NULL, NULL, NULL, {TOT}, true FROM g GROUP BY region_id""")
def g64(spark, d):
    return pf.glyph_summary(view(spark, d, "v_boxes").selectExpr(*_split(GL)))


@query("g65_font_size_in_region", f"""
SELECT a.artifact_id, a.page, a.card_id AS region_id, count(*) AS span_count, count(*) FILTER (WHERE b.has_cjk) AS cjk_span_count, {pr('min(b.font_size)', 4)} AS size_min, {pr('median(b.font_size)', 4)} AS size_median
FROM v_cards a JOIN v_boxes b ON {PAGE} WHERE {OX} > 0 AND {OY} > 0 GROUP BY ALL""")
def g65(spark, d):
    return pf.font_size_in_region(view(spark, d, "v_boxes"), view(spark, d, "v_cards").withColumnRenamed("card_id", "region_id"))


DECL = "o_orderkey AS artifact_id, o_custkey % 2 = 0 AS fonts, o_custkey % 3 = 0 AS font_evidence, o_custkey % 5 <> 0 AS wrap_plan, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE true END AS appearance"


@query("g66_coverage_required", f"""
WITH f AS (SELECT artifact_id, min(page) AS first_page FROM v_boxes WHERE has_cjk GROUP BY 1), j AS (SELECT * FROM f LEFT JOIN (SELECT {DECL} FROM orders) USING (artifact_id))
SELECT artifact_id, first_page, 'expected_cjk_fonts_required' AS rule FROM j WHERE NOT coalesce(fonts, false)
UNION ALL SELECT artifact_id, first_page, 'cjk_font_evidence_missing' FROM j WHERE NOT coalesce(font_evidence, false)
UNION ALL SELECT artifact_id, first_page, 'cjk_wrap_plan_coverage_missing' FROM j WHERE NOT coalesce(wrap_plan, false)
UNION ALL SELECT artifact_id, first_page, 'cjk_appearance_coverage_missing' FROM j WHERE NOT coalesce(appearance, false)""")
def g66(spark, d):
    return pf.coverage_required(view(spark, d, "v_boxes"), load(spark, d, "orders").selectExpr(*_split(DECL)))
