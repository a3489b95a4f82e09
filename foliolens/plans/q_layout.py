"""Queries over layout boxes, lines and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import PAGE_KEY
from ..operators import layout_lines as ll
from ..operators import layout_pairs as lp
from .registry import query
from .sqltext import INTER, OX, OY, PAGE, pr
from .views import view

BROKEN = ("artifact_id", "page", "box_id",
          "CASE WHEN line_index % 5 = 0 THEN NULL WHEN line_index % 5 = 1 THEN x0 + 60 ELSE x0 END AS x0",
          "y0", "x1", "y1")


@query("g1_box_bounds", f"""
SELECT artifact_id, page, box_id FROM (SELECT {', '.join(BROKEN)} FROM v_boxes)
WHERE x0 IS NULL OR x1 - x0 <= 0 OR y1 - y0 <= 0""")
def g1(spark, d):
    return lp.box_bounds(view(spark, d, "v_boxes").selectExpr(*BROKEN)).select("artifact_id", "page", "box_id")


@query("g2_clip_to_page", """
SELECT a.artifact_id, a.page, box_id FROM v_boxes a JOIN v_pages p USING (artifact_id, page)
WHERE NOT (x0 >= -0.5 AND y0 >= -0.5 AND x1 <= width + 0.5 AND y1 <= height + 0.5)""")
def g2(spark, d):
    return lp.clip_to_page(view(spark, d, "v_boxes"), view(spark, d, "v_pages")).select(*PAGE_KEY, "box_id")


@query("g3_overlap_pairs", f"""
SELECT a.artifact_id, a.page, a.box_id AS box_a, b.box_id AS box_b, {pr(INTER, 3)} AS overlap_area,
       greatest(a.x0,b.x0) AS x0, greatest(a.y0,b.y0) AS y0, least(a.x1,b.x1) AS x1, least(a.y1,b.y1) AS y1
FROM v_boxes a JOIN v_boxes b ON {PAGE} AND a.box_id < b.box_id
WHERE {OX} > 0 AND {OY} > 0 AND NOT (a.block_id = b.block_id AND abs(a.baseline_y - b.baseline_y) > 0.75)""")
def g3(spark, d):
    return lp.overlap_pairs(view(spark, d, "v_boxes"))


@query("g3_touching_pairs", f"""
SELECT a.artifact_id, a.page, a.box_id AS box_a, b.box_id AS box_b
FROM v_boxes a JOIN v_boxes b ON {PAGE} AND a.box_id < b.box_id
WHERE {OX} >= 0 AND {OY} >= 0 AND NOT (a.block_id = b.block_id AND abs(a.baseline_y - b.baseline_y) > 0.5)""")
def g3_touching(spark, d):
    return lp.touching_pairs(view(spark, d, "v_boxes"))


@query("g4_min_gap_pairs", f"""
SELECT a.artifact_id, a.page, a.box_id AS box_a, b.box_id AS box_b, {pr('-' + OY, 3)} AS gap
FROM v_boxes a JOIN v_boxes b ON {PAGE} AND a.box_id < b.box_id
WHERE a.block_id <> b.block_id AND {OX} >= 0 AND -{OY} > 0 AND -{OY} < 12""")
def g4(spark, d):
    return lp.min_gap_pairs(view(spark, d, "v_boxes"), 12.0)


@query("g5_pair_measure", f"""
SELECT * FROM (
SELECT a.artifact_id, a.page, a.region_id AS region_a, b.region_id AS region_b,
  CASE WHEN {OX} > 0 AND {OY} > 0 THEN least({OX}, {OY}) ELSE 0.0 END AS overlap,
  CASE WHEN abs((a.y0+a.y1)/2 - (b.y0+b.y1)/2) <= least(a.y1-a.y0, b.y1-b.y0)/3
       THEN greatest(-{OX}, -{OY}, 0.0) END AS gutter,
  CASE WHEN a.semantic_group = b.semantic_group THEN 'hard' ELSE 'review' END AS pair_class
FROM v_regions a JOIN v_regions b ON {PAGE} AND a.region_id < b.region_id)
WHERE CASE WHEN pair_class = 'hard' THEN overlap > 0 OR gutter IS NOT NULL ELSE overlap > 0 OR gutter < 20 END""")
def g5(spark, d):
    return lp.pair_measure(view(spark, d, "v_regions"), 20.0)


@query("g6_element_gaps", f"""
SELECT a.artifact_id, a.page, a.region_id AS region_a, b.region_id AS region_b,
  CASE WHEN {OX} > 0 AND a.y1 <= b.y0 THEN 'below' WHEN {OX} > 0 AND b.y1 <= a.y0 THEN 'above'
       WHEN a.x1 <= b.x0 THEN 'right_of' ELSE 'left_of' END AS relation,
  {pr(f'CASE WHEN {OX} > 0 THEN -{OY} ELSE -{OX} END', 3)} AS gap, {pr(f'greatest({OX}, {OY})', 3)} AS axis_overlap
FROM v_regions a JOIN v_regions b ON {PAGE} AND a.region_id < b.region_id
WHERE NOT ({OX} > 0 AND {OY} > 0) AND ({OX} > 0 OR {OY} > 0)""")
def g6(spark, d):
    return lp.element_gaps(view(spark, d, "v_regions"))


FRAMES = ("artifact_id", "page", "box_id", "x0", "CAST(floor(y0 / 20) * 20 AS DOUBLE) AS y0",
          "CAST(x0 + 150 AS DOUBLE) AS x1", "CAST(floor(y0 / 20) * 20 + 14 + line_index % 3 AS DOUBLE) AS y1")


@query("g7_parallel_frames", f"""
WITH f AS (SELECT {', '.join(FRAMES)} FROM v_boxes),
p AS (SELECT a.artifact_id, a.page, a.box_id AS frame_a, b.box_id AS frame_b,
       a.x0 ax0, a.x1 ax1, a.y0 ay0, a.y1 ay1, b.x0 bx0, b.x1 bx1, b.y0 by0, b.y1 by1
      FROM f a JOIN f b ON {PAGE} AND a.box_id < b.box_id)
SELECT artifact_id, page, frame_a, frame_b, 'vertical' AS orientation, {pr('greatest(by0-ay1, ay0-by1)', 4)} AS gap
FROM p WHERE abs((ax1-ax0)-(bx1-bx0)) <= 1 AND abs(ax0-bx0) <= 1 AND abs(ax1-bx1) <= 1
  AND greatest(by0-ay1, ay0-by1) > 0.01 AND greatest(by0-ay1, ay0-by1) < 7.99
UNION ALL
SELECT artifact_id, page, frame_a, frame_b, 'horizontal', {pr('greatest(bx0-ax1, ax0-bx1)', 4)}
FROM p WHERE abs((ay1-ay0)-(by1-by0)) <= 1 AND abs(ay0-by0) <= 1 AND abs(ay1-by1) <= 1
  AND greatest(bx0-ax1, ax0-bx1) > 0.01 AND greatest(bx0-ax1, ax0-bx1) < 7.99""")
def g7(spark, d):
    return lp.parallel_frames(view(spark, d, "v_boxes").selectExpr(*FRAMES))


@query("g8_badge_interference", f"""
SELECT a.artifact_id, a.page, a.box_id AS badge_id, b.box_id AS line_id, least(a.x0,b.x0) AS x0, least(a.y0,b.y0) AS y0,
       greatest(a.x1,b.x1) AS x1, greatest(a.y1,b.y1) AS y1
FROM v_boxes a JOIN v_boxes b ON {PAGE}
WHERE a.filled AND a.curves >= 4 AND a.x1-a.x0 >= 8 AND a.y1-a.y0 >= 8 AND greatest(a.x1-a.x0, a.y1-a.y0) <= 36
  AND greatest(a.x1-a.x0, a.y1-a.y0) / least(a.x1-a.x0, a.y1-a.y0) <= 1.3
  AND {OX} > -5 AND {OY} > -5 AND NOT (b.x0 >= a.x0 AND b.y0 >= a.y0 AND b.x1 <= a.x1 AND b.y1 <= a.y1)""")
def g8(spark, d):
    boxes = view(spark, d, "v_boxes")
    return lp.badge_interference(boxes, boxes)


@query("g9_vector_containment", f"""
SELECT a.artifact_id, a.page, a.box_id AS drawing_id, b.box_id AS line_id, {pr(INTER, 3)} AS overlap_area,
  {pr(f'{INTER} / greatest(1.0, (b.x1-b.x0)*(b.y1-b.y0))', 4)} AS containment,
  CASE WHEN a.filled AND {INTER} / greatest(1.0, (b.x1-b.x0)*(b.y1-b.y0)) >= 0.98 THEN 'pass' ELSE 'review' END AS status
FROM (SELECT artifact_id, page, box_id, filled, x0-8 AS x0, y0-8 AS y0, x1+40 AS x1, y1+20 AS y1 FROM v_boxes) a
JOIN v_boxes b ON {PAGE} WHERE {OX} > 0 AND {OY} > 0""")
def g9(spark, d):
    boxes = view(spark, d, "v_boxes")
    drawings = boxes.selectExpr("artifact_id", "page", "box_id", "filled", "x0-8 AS x0", "y0-8 AS y0",
                                "x1+40 AS x1", "y1+20 AS y1")
    return lp.vector_containment(drawings, boxes)


PLACED = f"""(
SELECT l.*, m.region_id FROM v_boxes l LEFT JOIN (
  SELECT artifact_id, page, box_id, region_id FROM (
    SELECT b.artifact_id, b.page, b.box_id, a.region_id, row_number() OVER (PARTITION BY b.artifact_id, b.page, b.box_id
      ORDER BY CASE WHEN (b.x0+b.x1)/2 BETWEEN a.x0-1 AND a.x1+1 AND (b.y0+b.y1)/2 BETWEEN a.y0-1 AND a.y1+1 THEN 0 ELSE 1 END,
        CASE WHEN (b.x0+b.x1)/2 BETWEEN a.x0-1 AND a.x1+1 AND (b.y0+b.y1)/2 BETWEEN a.y0-1 AND a.y1+1
             THEN (a.x1-a.x0)*(a.y1-a.y0) ELSE -({INTER}) / greatest(1.0, (b.x1-b.x0)*(b.y1-b.y0)) END, a.region_id) AS rn
    FROM v_regions a JOIN v_boxes b ON {PAGE} AND a.shape_kind = 'text_region'
    WHERE ((b.x0+b.x1)/2 BETWEEN a.x0-1 AND a.x1+1 AND (b.y0+b.y1)/2 BETWEEN a.y0-1 AND a.y1+1) OR ({OX} > 0 AND {OY} > 0))
  WHERE rn = 1) m USING (artifact_id, page, box_id))"""


@query("g10_assign_region", f"SELECT artifact_id, page, box_id, region_id FROM {PLACED}")
def g10(spark, d):
    return lp.assign_region(view(spark, d, "v_boxes"), view(spark, d, "v_regions")).select(
        *PAGE_KEY, "box_id", "region_id")


@query("g11_in_frame", """
SELECT a.artifact_id, a.page, b.card_id AS frame_id, a.box_id FROM v_boxes a JOIN v_cards b USING (artifact_id, page)
WHERE (a.x0+a.x1)/2 BETWEEN b.x0-0.5 AND b.x1+0.5 AND (a.y0+a.y1)/2 BETWEEN b.y0-0.5 AND b.y1+0.5""")
def g11(spark, d):
    return lp.in_frame(view(spark, d, "v_boxes"), view(spark, d, "v_cards").withColumnRenamed("card_id", "frame_id"))


SHIFTED = ("artifact_id", "page", "concat(box_id, '/e') AS box_id", "x0 + line_index % 3 AS x0",
           "y0 + curves % 2 AS y0", "x1 + line_index % 2 AS x1", "y1 - curves % 3 AS y1")
L1 = "abs(a.x0-b.x0)+abs(a.y0-b.y0)+abs(a.x1-b.x1)+abs(a.y1-b.y1)"


@query("g12_match_nearest", f"""
SELECT artifact_id, page, box_id, distance, match_id, x0, y0, x1, y1, match_count FROM (
SELECT a.artifact_id, a.page, a.box_id, CAST({L1} AS DOUBLE) AS distance, b.box_id AS match_id, b.x0, b.y0, b.x1, b.y1,
  count(*) OVER (PARTITION BY a.artifact_id, a.page, a.box_id) AS match_count,
  row_number() OVER (PARTITION BY a.artifact_id, a.page, a.box_id ORDER BY {L1}, b.box_id) AS rn
FROM (SELECT {', '.join(SHIFTED)} FROM v_boxes) a JOIN v_boxes b ON {PAGE} WHERE {L1} <= 6) WHERE rn = 1""")
def g12(spark, d):
    boxes = view(spark, d, "v_boxes")
    return lp.match_nearest(boxes.selectExpr(*SHIFTED), boxes, 6.0)


ROWS = ("artifact_id, page, card_id AS table_id, CAST(i AS INT) AS row_index, 5 AS row_count, x0, y0, x1, y1, "
        "y0 + 70 * i AS row_y0, y0 + 70 * (i + 1) AS row_y1")
RULES = ("artifact_id, page, concat(card_id, '/', CAST(i AS STRING)) AS box_id, x0 + 1 AS x0, "
         "CASE WHEN i = 0 THEN y0 + 1 ELSE y0 + 70 * i - 1 + 0.75 * ((artifact_id + i) % 4) END AS y0, "
         "x1 - CASE WHEN (artifact_id + i) % 9 = 0 AND i > 0 THEN 100 ELSE 1 END AS x1, "
         "CASE WHEN i = 0 THEN y1 ELSE y0 + 70 * i + 1 + 0.75 * ((artifact_id + i) % 4) END AS y1")


@query("g13_match_table_row", f"""
WITH t AS (SELECT {ROWS} FROM v_cards, unnest(range(5)) AS u(i)),
c AS (SELECT {RULES} FROM v_cards, unnest(range(5)) AS u(i)),
o AS (SELECT artifact_id, page, table_id, ox0, oy0, ox1, oy1 FROM (
  SELECT a.artifact_id, a.page, a.table_id, b.x0 ox0, b.y0 oy0, b.x1 ox1, b.y1 oy1,
    row_number() OVER (PARTITION BY a.artifact_id, a.page, a.table_id ORDER BY {L1}, b.box_id) rn
  FROM (SELECT DISTINCT artifact_id, page, table_id, x0, y0, x1, y1 FROM t) a JOIN c b ON {PAGE} WHERE {L1} <= 4) WHERE rn = 1),
dv AS (SELECT artifact_id, page, x1 - x0 AS w, (y0+y1)/2 AS cy FROM c WHERE y1 - y0 <= 4),
e AS (SELECT t.*, ox0, oy0, ox1, oy1,
   (SELECT arg_min(cy, abs(cy - row_y0)) FROM dv WHERE dv.artifact_id = t.artifact_id AND w >= 0.9*(ox1-ox0) AND abs(cy-row_y0) <= 1.5) AS dt,
   (SELECT arg_min(cy, abs(cy - row_y1)) FROM dv WHERE dv.artifact_id = t.artifact_id AND w >= 0.9*(ox1-ox0) AND abs(cy-row_y1) <= 1.5) AS db
  FROM t JOIN o USING (artifact_id, page, table_id))
SELECT artifact_id, page, table_id, row_index, ox0 AS x0, CASE WHEN row_index > 0 THEN dt ELSE oy0 END AS y0, ox1 AS x1,
  CASE WHEN row_index < row_count - 1 THEN db ELSE oy1 END AS y1 FROM e
WHERE (row_index = 0 OR dt IS NOT NULL) AND (row_index = row_count - 1 OR db IS NOT NULL)""")
def g13(spark, d):
    cards = view(spark, d, "v_cards")
    five = cards.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return lp.match_table_row(five.selectExpr(*_split(ROWS)), five.selectExpr(*_split(RULES)))


def _split(exprs: str) -> list[str]:
    """Split a select list on its top-level commas."""
    out, depth, current = [], 0, ""
    for ch in exprs:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(current)
            current = ""
        else:
            current += ch
    return [*out, current]


DECLARED = ("artifact_id, page, kind, 'bbox' AS edge_basis, concat('d', box_id) AS element_id, line_index AS ord, "
            "CAST(floor(x0 / 20) * 20 AS DOUBLE) AS x0, y0, CAST(floor(x0 / 20) * 20 + 50 AS DOUBLE) AS x1, y1")
ACTUAL = ("artifact_id, page, CASE WHEN curves = 7 THEN 'other' ELSE kind END AS kind, 'bbox' AS edge_basis, "
          "concat('a', box_id) AS element_id, line_index AS ord, CAST(floor(x0 / 20) * 20 AS DOUBLE) + 0.5 AS x0, "
          "y0 + CASE WHEN curves = 3 THEN 1 ELSE 0.25 END AS y0, CAST(floor(x0 / 20) * 20 + 50 AS DOUBLE) AS x1, y1")
SIG = "PARTITION BY artifact_id, page, kind, edge_basis, x0, y0, x1, y1 ORDER BY ord, element_id"


def coverage_sql(declared: str) -> str:
    """Declared elements take actual ones in order, page by page."""
    return f"""
WITH RECURSIVE dd AS ({declared}),
aa AS (SELECT *, row_number() OVER ({SIG}) AS occ FROM (SELECT {ACTUAL} FROM v_boxes)),
pr AS (SELECT a.artifact_id, a.page, a.element_id AS d, a.ord, list(b.element_id) AS c FROM dd a JOIN aa b ON {PAGE} AND a.kind=b.kind AND a.edge_basis=b.edge_basis AND a.occ=b.occ
  WHERE greatest(abs(a.x0-b.x0), abs(a.y0-b.y0), abs(a.x1-b.x1), abs(a.y1-b.y1)) <= 0.75 GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY artifact_id, page ORDER BY ord, d) AS k FROM pr),
w AS (SELECT artifact_id, page, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS d, CAST(NULL AS VARCHAR) AS m FROM n WHERE k = 1
  UNION ALL SELECT artifact_id, page, k, CASE WHEN len(f) = 1 THEN list_append(used, f[1]) ELSE used END, d, CASE WHEN len(f) = 1 THEN f[1] END
  FROM (SELECT n.artifact_id, n.page, n.k, n.d, w.used, list_filter(n.c, lambda x: NOT list_contains(w.used, x)) AS f FROM w JOIN n ON n.artifact_id = w.artifact_id AND n.page = w.page AND n.k = w.k + 1)),
s AS (SELECT artifact_id, page, d AS element_id, m AS match_id FROM w WHERE m IS NOT NULL)
SELECT dd.artifact_id, dd.page, dd.element_id, s.match_id, CASE WHEN s.match_id IS NULL THEN 'missing_or_ambiguous' ELSE 'matched' END AS status
FROM dd LEFT JOIN s ON dd.artifact_id=s.artifact_id AND dd.page=s.page AND dd.element_id=s.element_id
UNION ALL SELECT aa.artifact_id, aa.page, NULL, aa.element_id, 'undeclared' FROM aa WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.artifact_id=aa.artifact_id AND s.page=aa.page AND s.match_id=aa.element_id)"""


@query("g14_coverage_match", coverage_sql(f"SELECT *, row_number() OVER ({SIG}) AS occ FROM (SELECT {DECLARED} FROM v_boxes)"))
def g14(spark, d):
    boxes = view(spark, d, "v_boxes")
    return lp.coverage_match(boxes.selectExpr(*_split(DECLARED)), boxes.selectExpr(*_split(ACTUAL)))


# every third element is declared twice, a little apart and with its occurrence
TWICE = ("artifact_id, page, kind, 'bbox' AS edge_basis, concat('d', box_id, '-', k) AS element_id, 2 * line_index + k AS ord, CAST(floor(x0 / 20) * 20 AS DOUBLE) + 0.5 * k AS x0, y0, "
         "CAST(floor(x0 / 20) * 20 + 50 AS DOUBLE) AS x1, y1, CASE WHEN k = 1 OR line_index % 2 = 0 THEN 1 END AS occurrence")


@query("g14_declared_twice", coverage_sql(f"SELECT * EXCLUDE (occurrence), coalesce(occurrence, row_number() OVER ({SIG})) AS occ FROM (SELECT {TWICE} FROM v_boxes, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR line_index % 3 = 0)"))
def g14_twice(spark, d):
    boxes = view(spark, d, "v_boxes")
    twice = boxes.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).where("k = 0 OR line_index % 3 = 0")
    return lp.coverage_match(twice.selectExpr(*_split(TWICE)), boxes.selectExpr(*_split(ACTUAL)))


@query("g15_union_box", f"""
SELECT artifact_id, page, block_id, {pr('min(x0)', 3)} AS x0, {pr('min(y0)', 3)} AS y0, {pr('max(x1)', 3)} AS x1,
  {pr('max(y1)', 3)} AS y1, count(*) AS n FROM v_boxes GROUP BY artifact_id, page, block_id""")
def g15(spark, d):
    return ll.union_box(view(spark, d, "v_boxes"), [*PAGE_KEY, "block_id"])


FRAGMENTS = ("artifact_id", "page", "box_id", "x0", "y0", "x1", "y1", "font_size", "kind AS text",
             "CAST(floor(baseline_y / 16) * 16 AS DOUBLE) + 0.5 * (curves % 5) AS baseline_y")


@query("g16_coalesce_baselines", f"""
WITH RECURSIVE f AS (SELECT {', '.join(FRAGMENTS)} FROM v_boxes),
lv AS (SELECT artifact_id, page, baseline_y, row_number() OVER (PARTITION BY artifact_id, page ORDER BY baseline_y) AS rn
       FROM (SELECT DISTINCT artifact_id, page, baseline_y FROM f)),
w AS (SELECT artifact_id, page, baseline_y, rn, baseline_y AS anchor FROM lv WHERE rn = 1
  UNION ALL SELECT l.artifact_id, l.page, l.baseline_y, l.rn,
    CASE WHEN l.baseline_y - w.anchor <= 0.75 THEN w.anchor ELSE l.baseline_y END
  FROM w JOIN lv l ON l.artifact_id = w.artifact_id AND l.page = w.page AND l.rn = w.rn + 1)
SELECT f.artifact_id, f.page, w.anchor, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
  {pr('avg(f.baseline_y)', 4)} AS baseline_y, max(font_size) AS font_size, count(*) AS fragments,
  string_agg(text, '' ORDER BY x0, box_id) AS text
FROM f JOIN w ON f.artifact_id = w.artifact_id AND f.page = w.page AND f.baseline_y = w.baseline_y
GROUP BY f.artifact_id, f.page, w.anchor""")
def g16(spark, d):
    return ll.coalesce_baselines(view(spark, d, "v_boxes").selectExpr(*FRAGMENTS))


DELTAS = f"""(
SELECT a.artifact_id, a.page, a.block_id, a.box_id, b.box_id AS previous_id, {pr('a.baseline_y-b.baseline_y', 3)} AS delta,
       {pr(INTER, 3)} AS overlap_area
FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id, page, block_id ORDER BY line_index, y0, box_id) AS rn FROM v_boxes) a
JOIN (SELECT *, row_number() OVER (PARTITION BY artifact_id, page, block_id ORDER BY line_index, y0, box_id) AS rn FROM v_boxes) b
  ON {PAGE} AND a.block_id = b.block_id AND a.rn = b.rn + 1)"""


@query("g17_baseline_deltas", f"SELECT * FROM {DELTAS}")
def g17(spark, d):
    return ll.baseline_deltas(view(spark, d, "v_boxes"))


@query("g17_line_geometry", f"""
SELECT * FROM (SELECT *, CASE WHEN delta <= 0.75 THEN 'review' WHEN overlap_area > 0.5 THEN 'fail' END AS status FROM {DELTAS})
WHERE status IS NOT NULL""")
def g17_findings(spark, d):
    return ll.line_geometry(view(spark, d, "v_boxes"))


STEPS = ("artifact_id", "page", "box_id", "block_id AS frame_id", "CAST(line_index * 100000 + curves * 1000 + CAST(x0 AS INT) AS BIGINT) AS line_index",
         "CAST(floor(line_index / 3) AS INT) AS paragraph", "line_index * 10.5 + 0.25 * (curves % 4) AS baseline_y",
         "CAST(8 AS DOUBLE) AS font_size", "x0")


@query("g18_baseline_ratio", f"""
WITH f AS (SELECT {', '.join(STEPS)} FROM v_boxes),
p AS (SELECT *, lag(baseline_y) OVER w AS pb, lag(paragraph) OVER w AS pp FROM f
  WINDOW w AS (PARTITION BY artifact_id, page, frame_id ORDER BY line_index, box_id)),
r AS (SELECT artifact_id, page, frame_id, min((baseline_y-pb)/font_size) AS lo, max((baseline_y-pb)/font_size) AS hi
  FROM p WHERE pp = paragraph GROUP BY ALL)
SELECT artifact_id, page, frame_id, {pr('lo', 4)} AS minimum, {pr('hi', 4)} AS maximum FROM r WHERE lo < 1.30 OR hi > 1.42""")
def g18(spark, d):
    from ..functions import skew
    lines = view(spark, d, "v_boxes").selectExpr(*STEPS)
    # a strict order within the frame
    lines = skew.number_rows(lines, [*PAGE_KEY, "frame_id"], ["line_index", "box_id"],
                             F.floor(F.col("line_index") / 4096), "rn")
    return ll.baseline_ratio(lines.withColumn("line_index", F.col("rn")))


GLYPH_LINES = ("conv_id AS artifact_id, 1 AS page, CAST(conv_id % 2 AS INT) AS frame_id, "
               "concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS box_id, turn AS line_index, "
               "CAST(floor(turn / 3) AS INT) AS paragraph, "
               "CASE WHEN turn % 3 = 0 THEN concat(role, CASE WHEN conv_id % 2 = 0 THEN ': ' ELSE '：' END, text) ELSE text END AS text")


@query("g19_hanging_indent", f"""
WITH l AS (SELECT {GLYPH_LINES} FROM conversations),
g AS (SELECT artifact_id, page, box_id, CAST(i AS INT) AS pos, text[i + 1] AS ch,
        CASE WHEN line_index % 3 = 0 THEN 5.0 * i ELSE 5.0 * i + 40 + artifact_id % 4 END AS gx FROM l, unnest(range(length(text))) AS u(i)
      WHERE trim(text[i + 1], ' ' || chr(10) || chr(9)) <> ''),
m AS (SELECT l.*, CASE WHEN strpos(text, '：') > 0 AND strpos(text, ':') > 0 THEN least(strpos(text, '：'), strpos(text, ':'))
        WHEN greatest(strpos(text, '：'), strpos(text, ':')) > 0 THEN greatest(strpos(text, '：'), strpos(text, ':')) END AS body_pos FROM l),
x AS (SELECT m.artifact_id, m.page, m.frame_id, m.paragraph, m.box_id, m.line_index, arg_min(gx, pos) AS first_x,
        arg_min(gx, pos) FILTER (WHERE pos >= body_pos) AS body_x
      FROM m LEFT JOIN g USING (artifact_id, page, box_id) GROUP BY ALL),
h AS (SELECT artifact_id, page, frame_id, paragraph, arg_min(coalesce(body_x, -1), line_index) AS head_x, min(line_index) AS head_index FROM x GROUP BY ALL),
dv AS (SELECT x.artifact_id, x.page, x.frame_id, max(CASE WHEN first_x IS NULL OR head_x = -1 THEN 3.5 ELSE abs(first_x - head_x) END) AS dev
  FROM x JOIN h USING (artifact_id, page, frame_id, paragraph) WHERE line_index > head_index GROUP BY ALL)
SELECT artifact_id, page, frame_id, {pr('dev', 4)} AS max_deviation FROM dv WHERE dev > 2.5""")
def g19(spark, d):
    from .views import load
    lines = load(spark, d, "conversations").selectExpr(*_split(GLYPH_LINES))
    glyphs = lines.select("artifact_id", "page", "box_id", "line_index",
                          F.posexplode(F.split("text", "")).alias("pos", "ch")).withColumn(
        "gx", F.expr("CASE WHEN line_index % 3 = 0 THEN 5.0D * pos ELSE 5.0D * pos + 40 + artifact_id % 4 END"))
    return ll.hanging_indent(lines, glyphs.drop("line_index"))


@query("g20_page_dead_space", f"""
SELECT artifact_id, page, coalesce(n, 0) AS line_count, {pr('blank', 3)} AS bottom_blank, {pr('blank / height', 6)} AS bottom_blank_ratio,
  blank / height > 0.4 + 1e-9 AS ratio_exceeded, blank > 100 + 0.01 AS footer_exceeded
FROM (SELECT p.artifact_id, p.page, height, n, greatest(0.0, height - coalesce(b, 0.0)) AS blank FROM v_pages p
  LEFT JOIN (SELECT artifact_id, page, max(y1) AS b, count(*) AS n FROM v_boxes GROUP BY ALL) USING (artifact_id, page))""")
def g20(spark, d):
    return ll.page_dead_space(view(spark, d, "v_boxes"), view(spark, d, "v_pages"), 0.4, 100.0)


def occupancy_sql(boxes: str, key: str, lines: str = "v_boxes") -> str:
    return f"""(
WITH pc AS (SELECT b.artifact_id, b.page, b.{key}, greatest(a.y0,b.y0) AS lo, least(a.y1,b.y1) AS hi
  FROM {lines} a JOIN {boxes} b ON {PAGE} WHERE {OX} > 0 AND {OY} > 0),
cv AS (SELECT artifact_id, page, {key}, sum(greatest(0.0, hi - greatest(lo, coalesce(reach, lo)))) AS covered, max(hi) AS bottom FROM (
  SELECT *, max(hi) OVER (PARTITION BY artifact_id, page, {key} ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pc)
  GROUP BY ALL)
SELECT b.*, {pr('coalesce(covered, 0.0) / greatest(1.0, b.y1 - b.y0)', 5)} AS occupancy,
  CASE WHEN bottom IS NULL THEN 1.0 ELSE {pr('(b.y1 - bottom) / greatest(1.0, b.y1 - b.y0)', 5)} END AS bottom_blank_ratio
FROM {boxes} b LEFT JOIN cv USING (artifact_id, page, {key}))"""


@query("g21_vertical_occupancy", f"SELECT artifact_id, page, card_id, occupancy FROM {occupancy_sql('v_cards', 'card_id')}")
def g21(spark, d):
    return ll.vertical_occupancy(view(spark, d, "v_cards"), view(spark, d, "v_boxes")).select(
        *PAGE_KEY, "card_id", "occupancy")


@query("g22_bottom_blank", f"SELECT artifact_id, page, card_id, bottom_blank_ratio FROM {occupancy_sql('v_cards', 'card_id')}")
def g22(spark, d):
    return ll.bottom_blank(view(spark, d, "v_cards"), view(spark, d, "v_boxes"))


TALL = "artifact_id, page, card_id, x0, y0, x1, y1 + 80 * (artifact_id % 3) AS y1"


@query("g23_low_occupancy", f"""
WITH t AS (SELECT {TALL} FROM v_cards), tp AS (SELECT t.* FROM t JOIN v_pages p USING (artifact_id, page) WHERE t.y1 - t.y0 >= p.height * 0.55)
SELECT artifact_id, page, card_id, occupancy FROM {occupancy_sql('tp', 'card_id')} WHERE occupancy < 0.35""")
def g23(spark, d):
    tall = view(spark, d, "v_cards").selectExpr(*_split(TALL))
    return ll.low_occupancy(tall, view(spark, d, "v_boxes"), view(spark, d, "v_pages")).select(
        *PAGE_KEY, "card_id", "occupancy")


SPACING = f"""(
WITH pl AS (SELECT l.*, r.role AS region_role FROM {PLACED} l LEFT JOIN v_regions r USING (artifact_id, page, region_id)),
nx AS (SELECT *, lead(box_id) OVER w AS lower_id, lead(block_id) OVER w AS nblock, lead(baseline_y) OVER w AS nbase, lead(y0) OVER w AS ny0,
  lead(region_role) OVER w AS nrole FROM pl WINDOW w AS (PARTITION BY artifact_id, page ORDER BY y0, x0, box_id))
SELECT artifact_id, page, box_id AS upper_id, lower_id, {pr('nbase - baseline_y', 3)} AS baseline_distance,
  {pr('greatest(0.0, ny0 - y1)', 3)} AS box_gap, CASE WHEN block_id = nblock THEN 'same_block' ELSE 'adjacent_blocks' END AS relation,
  CASE WHEN block_id <> nblock THEN {pr('greatest(0.0, ny0 - y1)', 3)} END AS paragraph_gap,
  coalesce(region_role, 'unknown') AS upper_role, coalesce(nrole, 'unknown') AS lower_role
FROM nx WHERE lower_id IS NOT NULL)"""


@query("g24_line_spacing_projection", f"SELECT * FROM {SPACING}")
def g24(spark, d):
    return ll.line_spacing_projection(view(spark, d, "v_boxes"), view(spark, d, "v_regions"))


INNER = f"""(
WITH u AS (SELECT artifact_id, page, region_id, min(x0) AS lx0, min(y0) AS ly0, max(x1) AS lx1, max(y1) AS ly1, count(*) AS line_count
  FROM {PLACED} WHERE region_id IS NOT NULL GROUP BY ALL)
SELECT artifact_id, page, region_id, line_count, greatest(0.0, lx0-x0) AS left_pt, greatest(0.0, ly0-y0) AS top_pt,
  greatest(0.0, x1-lx1) AS right_pt, greatest(0.0, y1-ly1) AS bottom_pt,
  least(greatest(0.0, lx0-x0), greatest(0.0, ly0-y0), greatest(0.0, x1-lx1), greatest(0.0, y1-ly1)) AS minimum_margin
FROM v_regions JOIN u USING (artifact_id, page, region_id))"""


@query("g25_inner_margins", f"SELECT * FROM {INNER}")
def g25(spark, d):
    return ll.inner_margins(view(spark, d, "v_boxes"), view(spark, d, "v_regions"))


OUTER = """(
SELECT artifact_id, page, greatest(0.0, lx0) AS left_pt, greatest(0.0, ly0) AS top_pt, greatest(0.0, width-lx1) AS right_pt,
  greatest(0.0, height-ly1) AS bottom_pt, least(greatest(0.0, lx0), greatest(0.0, ly0), greatest(0.0, width-lx1), greatest(0.0, height-ly1)) AS minimum_margin
FROM v_pages JOIN (SELECT artifact_id, page, min(x0) AS lx0, min(y0) AS ly0, max(x1) AS lx1, max(y1) AS ly1 FROM v_boxes GROUP BY ALL) USING (artifact_id, page))"""


@query("g26_outer_margins", f"SELECT * FROM {OUTER}")
def g26(spark, d):
    return ll.outer_margins(view(spark, d, "v_boxes"), view(spark, d, "v_pages"))


@query("g27_artifact_minima", f"""
SELECT p.artifact_id, outer_margin, title_body_gap, minimum_baseline_distance, minimum_box_gap, minimum_paragraph_gap, minimum_inner_margin, minimum_outer_margin
FROM (SELECT DISTINCT artifact_id FROM v_pages) p
LEFT JOIN (SELECT l.artifact_id, min(least(x0, y0, greatest(0.0, width-x1), greatest(0.0, height-y1))) AS outer_margin
  FROM v_boxes l JOIN v_pages USING (artifact_id, page) WHERE y0 < height * 0.9 GROUP BY 1) USING (artifact_id)
LEFT JOIN (SELECT a.artifact_id, min(b.y0 - a.y1) AS title_body_gap FROM v_regions a JOIN v_regions b ON {PAGE}
  AND a.role = 'title' AND b.role = 'text-region' AND b.y0 >= a.y1 GROUP BY 1) USING (artifact_id)
LEFT JOIN (SELECT artifact_id, min(baseline_distance) AS minimum_baseline_distance, min(box_gap) AS minimum_box_gap,
  min(paragraph_gap) AS minimum_paragraph_gap FROM {SPACING} GROUP BY 1) USING (artifact_id)
LEFT JOIN (SELECT artifact_id, min(minimum_margin) AS minimum_inner_margin FROM {INNER} GROUP BY 1) USING (artifact_id)
LEFT JOIN (SELECT artifact_id, min(minimum_margin) AS minimum_outer_margin FROM {OUTER} GROUP BY 1) USING (artifact_id)""")
def g27(spark, d):
    return ll.artifact_minima(view(spark, d, "v_boxes"), view(spark, d, "v_regions"), view(spark, d, "v_pages"))


CARD_SETS = ("artifact_id, page, region_id, semantic_role, concat('g', CAST(CAST(floor(y0 / 90) AS INT) AS STRING)) AS semantic_group, x0, y0, "
             "CASE WHEN semantic_role = 'container' THEN x1 + 300 ELSE x1 END AS x1, "
             "CASE WHEN semantic_role = 'container' THEN y1 + 120 ELSE y1 END AS y1")


@query("g28_semantic_cards", f"""
WITH m AS (SELECT {CARD_SETS} FROM v_regions),
c AS (SELECT artifact_id, page, semantic_group, count(*) FILTER (WHERE semantic_role='container') AS nc,
  count(*) FILTER (WHERE semantic_role='heading') AS nh, count(*) FILTER (WHERE semantic_role='body') AS nb FROM m GROUP BY ALL),
bx AS (SELECT m.artifact_id, m.page, m.semantic_group, x0, y0, x1, y1 FROM m JOIN c USING (artifact_id, page, semantic_group) WHERE nc = 1 AND semantic_role='container'),
o AS (SELECT m.artifact_id, m.page, m.semantic_group, count(*) AS n_outside FROM m JOIN bx USING (artifact_id, page, semantic_group)
  WHERE semantic_role IN ('heading','body') AND NOT (m.x0 >= bx.x0 AND m.y0 >= bx.y0 AND m.x1 <= bx.x1 AND m.y1 <= bx.y1) GROUP BY ALL),
k AS (SELECT DISTINCT a.artifact_id, a.page, a.semantic_group FROM bx a JOIN bx b ON {PAGE} AND a.semantic_group <> b.semantic_group WHERE {OX} > 0 AND {OY} > 0),
q AS (SELECT artifact_id, page, semantic_group, occupancy, bottom_blank_ratio FROM {occupancy_sql('bx', 'semantic_group')}),
j AS (SELECT c.*, coalesce(n_outside, 0) AS n_outside, occupancy, bottom_blank_ratio, k.semantic_group IS NOT NULL AS overlapping,
   (nc <> 1 OR nh <> 1 OR nb <> 1) AS malformed
  FROM c LEFT JOIN o USING (artifact_id, page, semantic_group) LEFT JOIN q USING (artifact_id, page, semantic_group)
  LEFT JOIN k ON c.artifact_id = k.artifact_id AND c.page = k.page AND c.semantic_group = k.semantic_group)
SELECT artifact_id, page, semantic_group, malformed, n_outside, occupancy, bottom_blank_ratio, overlapping,
  CASE WHEN malformed OR n_outside > 0 OR overlapping OR coalesce(occupancy < 0.35 AND bottom_blank_ratio > 0.45, false) THEN 'block' ELSE 'pass' END AS status FROM j""")
def g28(spark, d):
    return ll.semantic_cards(view(spark, d, "v_regions").selectExpr(*_split(CARD_SETS)), view(spark, d, "v_boxes"))
