"""Queries over colours and pixel histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color as fc
from ..operators import color as oc
from .q_layout import _split
from .registry import query
from .sqltext import pr
from .views import load, view


def lin(c: str) -> str:
    return f"(CASE WHEN {c}/255.0::DOUBLE <= 0.04045::DOUBLE THEN {c}/255.0::DOUBLE/12.92::DOUBLE ELSE pow(({c}/255.0::DOUBLE+0.055::DOUBLE)/1.055::DOUBLE, 2.4::DOUBLE) END)"


def lum(r: str, g: str, b: str) -> str:
    return f"(0.2126::DOUBLE*{lin(r)} + 0.7152::DOUBLE*{lin(g)} + 0.0722::DOUBLE*{lin(b)})"


def ratio(a: str, b: str) -> str:
    return f"((greatest({a}, {b}) + 0.05::DOUBLE) / (least({a}, {b}) + 0.05::DOUBLE))"


def luma(r: str, g: str, b: str) -> str:
    return f"CAST((({r})*19595 + ({g})*38470 + ({b})*7471 + 32768) // 65536 AS INT)"


MODE = "CASE WHEN {0} <= 0.10 THEN 'near-black' WHEN {0} >= 0.90 THEN 'near-white' ELSE 'other' END"


@query("c1_hex_rgb", """
SELECT token_id, printf('#%02X%02X%02X', r, g, b) AS hex, r AS r2, g AS g2, b AS b2 FROM v_colors""")
def c1(spark, d):
    hexed = view(spark, d, "v_colors").select("token_id", fc.rgb_to_hex("r", "g", "b").alias("hex"))
    back = fc.hex_to_rgb(F.col("hex"))
    return hexed.select("token_id", "hex", *[back[c].alias(c + "2") for c in "rgb"])


@query("c2_relative_luminance", f"SELECT token_id, {pr(lum('r', 'g', 'b'), 8)} AS luminance FROM v_colors")
def c2(spark, d):
    from ..functions.common import py_round
    return view(spark, d, "v_colors").select("token_id", py_round(fc.luminance("r", "g", "b"), 8).alias("luminance"))


@query("c3_contrast_ratio", f"SELECT token_id, {pr(ratio(lum('r', 'g', 'b'), lum('b', 'r', 'g')), 6)} AS ratio FROM v_colors")
def c3(spark, d):
    from ..functions.common import py_round
    return view(spark, d, "v_colors").select("token_id", py_round(fc.contrast(("r", "g", "b"), ("b", "r", "g")), 6).alias("ratio"))


@query("c4_foreground_mode", f"SELECT token_id, {MODE.format(lum('r', 'g', 'b'))} AS mode FROM v_colors")
def c4(spark, d):
    return view(spark, d, "v_colors").select("token_id", fc.mode_of(fc.luminance("r", "g", "b")).alias("mode"))


TOKENS = ("concat('t', CAST(p_partkey - p_partkey % 47 % 2 AS STRING)) AS token_id, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'foreground' WHEN 1 THEN 'surface' WHEN 2 THEN 'border' ELSE CASE WHEN p_size = 3 THEN 'glow' ELSE 'foreground' END END AS kind, "
          "CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey * 7 % 40 AS INT) WHEN p_partkey % 4 = 3 THEN CAST(240 + p_partkey % 16 AS INT) ELSE CAST((p_partkey * 37) % 256 AS INT) END AS r, "
          "CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey * 11 % 40 AS INT) WHEN p_partkey % 4 = 3 THEN CAST(242 + p_partkey % 14 AS INT) ELSE CAST((p_partkey * 59) % 256 AS INT) END AS g, "
          "CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey * 13 % 40 AS INT) WHEN p_partkey % 4 = 3 THEN CAST(241 + p_partkey % 15 AS INT) ELSE CAST((p_partkey * 83) % 256 AS INT) END AS b, p_size AS sz")
ROLE = ("concat('role', CAST(p_partkey AS STRING)) AS role, CASE WHEN p_size % 3 = 0 THEN 'body-near-black' WHEN p_size % 17 = 1 THEN 'free' ELSE 'contrast-select' END AS foreground_mode, "
        "concat('t', CAST(p_partkey - p_partkey % 4 + 1 AS STRING)) AS surface_id, CASE WHEN p_size % 5 = 0 THEN concat('t', CAST(p_partkey AS STRING)) END AS border_id, "
        "CAST(1 + p_size % 8 AS DOUBLE) AS min_ratio, CAST(4 + p_size % 7 AS DOUBLE) AS preferred_ratio")
FORE_SQL = "CASE WHEN p_size % 3 = 0 THEN ['t' || (p_partkey - p_partkey % 4)] ELSE ['t' || (p_partkey - p_partkey % 4), 't' || (p_partkey - p_partkey % 4 + 3)] END AS foreground_ids"
FORE = ("IF(p_size % 3 = 0, array(concat('t', p_partkey - p_partkey % 4)), array(concat('t', p_partkey - p_partkey % 4), concat('t', p_partkey - p_partkey % 4 + 3))) AS foreground_ids")


def _tokens(spark, d):
    base = load(spark, d, "part").selectExpr(*_split(TOKENS))
    exact = fc.rgb_to_hex("r", "g", "b")
    return base.withColumn("hex", F.when(F.col("sz") == 7, "#12345").when(F.col("sz") == 9, "#000001").otherwise(exact))


def _roles(spark, d):
    return load(spark, d, "part").selectExpr(*_split(ROLE), FORE, "p_size AS sz")


TOK_SQL = f"tk AS (SELECT *, CASE WHEN sz = 7 THEN '#12345' WHEN sz = 9 THEN '#000001' ELSE printf('#%02X%02X%02X', r, g, b) END AS hex FROM (SELECT {TOKENS} FROM part))"


@query("c5_palette_policy_check", f"""
WITH {TOK_SQL}, rl AS (SELECT {ROLE}, {FORE_SQL} FROM part),
nt AS (SELECT token_id, count(*) AS n FROM tk GROUP BY 1),
bt AS (SELECT tk.*, n, regexp_matches(hex, '^#[0-9A-Fa-f]{{6}}$') AS ok FROM tk JOIN nt USING (token_id)),
kn AS (SELECT token_id, min(kind) AS kind, min(sz) AS sz, min({MODE.format(lum('r', 'g', 'b'))}) AS mode FROM tk GROUP BY 1),
fr AS (SELECT role, count(*) AS nf, count(DISTINCT token_id) AS nd, bool_or(kind IS NULL) AS unknown, coalesce(bool_or(kind <> 'foreground'), false) AS wk,
   coalesce(bool_or(mode = 'near-black'), false) AS hb, coalesce(bool_or(mode = 'near-white'), false) AS hw, coalesce(bool_or(mode = 'other'), false) AS ho
  FROM (SELECT role, unnest(foreground_ids) AS token_id FROM rl) LEFT JOIN kn USING (token_id) GROUP BY 1),
j AS (SELECT rl.*, fr.* EXCLUDE (role), s.kind AS sk, b.kind AS bk FROM rl LEFT JOIN fr USING (role) LEFT JOIN kn s ON s.token_id = rl.surface_id LEFT JOIN kn b ON b.token_id = rl.border_id)
SELECT DISTINCT * FROM (
SELECT 'token' AS entity, token_id AS id, 'duplicate_id' AS reason FROM bt WHERE n > 1 UNION ALL
SELECT 'token', token_id, 'kind' FROM bt WHERE kind NOT IN ('foreground','surface','border') UNION ALL
SELECT 'token', token_id, 'hex' FROM bt WHERE NOT ok UNION ALL
SELECT 'token', token_id, 'hex_rgb_mismatch' FROM bt WHERE ok AND upper(hex) <> printf('#%02X%02X%02X', r, g, b) UNION ALL
SELECT 'role', role, 'foreground_mode' FROM j WHERE foreground_mode NOT IN ('body-near-black', 'contrast-select') UNION ALL
SELECT 'role', role, 'foreground_ids' FROM j WHERE unknown OR nf IS NULL OR nf <> nd UNION ALL
SELECT 'role', role, 'foreground_kind' FROM j WHERE wk UNION ALL
SELECT 'role', role, 'surface' FROM j WHERE coalesce(sk, '') <> 'surface' UNION ALL
SELECT 'role', role, 'border' FROM j WHERE border_id IS NOT NULL AND coalesce(bk, '') <> 'border' UNION ALL
SELECT 'role', role, 'thresholds' FROM j WHERE NOT (min_ratio > 1 AND preferred_ratio >= min_ratio AND preferred_ratio <= 21) UNION ALL
SELECT 'role', role, 'mode_constraint' FROM j WHERE (foreground_mode = 'body-near-black' AND NOT (nf = 1 AND hb)) OR (foreground_mode = 'contrast-select' AND NOT (hb AND hw AND NOT ho)))""")
def c5(spark, d):
    tokens = _tokens(spark, d)
    # ids repeat with different colours: keep the same one the comparison keeps
    return oc.palette_check(tokens, _roles(spark, d))


@query("c6_pick_role_color", f"""
WITH tk AS (SELECT token_id, r, g, b FROM v_colors), rl AS (SELECT concat('role', CAST(p_partkey AS VARCHAR)) AS role, ['t' || (p_partkey - p_partkey % 3), 't' || ((p_partkey - p_partkey % 3) // 2), 't' || (p_partkey // 3)] AS ids,
  't' || (p_partkey - p_partkey % 3 + 1) AS surface_id, CAST(1 + p_size % 4 AS DOUBLE) AS min_ratio, CASE WHEN p_size % 3 = 0 THEN printf('#%02X%02X%02X', CAST((p_partkey - p_partkey % 3) * 37 % 256 AS INT), CAST((p_partkey - p_partkey % 3) * 59 % 256 AS INT), CAST((p_partkey - p_partkey % 3) * 83 % 256 AS INT)) END AS direct_hex FROM part),
o AS (SELECT role, min_ratio, direct_hex, f.token_id, {ratio(lum('f.r', 'f.g', 'f.b'), lum('s.r', 's.g', 's.b'))} AS ra, printf('#%02X%02X%02X', f.r, f.g, f.b) AS hx
  FROM (SELECT *, unnest(ids) AS fid FROM rl) x JOIN tk f ON f.token_id = fid JOIN tk s ON s.token_id = surface_id),
k AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY ra DESC, token_id) AS rn FROM o)
SELECT role, token_id AS foreground_id, hx AS foreground_hex, {pr('ra', 6)} AS ratio, CASE WHEN ra + 1e-9 < min_ratio THEN 'below_minimum' WHEN direct_hex <> hx THEN 'direct_color_drift' ELSE 'pass' END AS status FROM k WHERE rn = 1""")
def c6(spark, d):
    direct = fc.rgb_to_hex(*[F.expr(f"CAST((p_partkey - p_partkey % 3) * {m} % 256 AS INT)") for m in (37, 59, 83)])
    roles = load(spark, d, "part").select(
        F.expr("concat('role', p_partkey)").alias("role"),
        F.expr("array(concat('t', p_partkey - p_partkey % 3), concat('t', (p_partkey - p_partkey % 3) div 2), concat('t', p_partkey div 3))").alias("foreground_ids"),
        F.expr("concat('t', p_partkey - p_partkey % 3 + 1)").alias("surface_id"), F.expr("CAST(1 + p_size % 4 AS DOUBLE)").alias("min_ratio"),
        F.when(F.col("p_size") % 3 == 0, direct).alias("direct_hex"))
    return oc.pick_colors(roles, view(spark, d, "v_colors"))


SAMPLE = ("l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS sample_id, CAST(l_partkey % 64 AS INT) AS fr, CAST(l_suppkey % 50 AS INT) AS fg, CAST(l_linenumber * 9 AS INT) AS fb, "
          "CAST(120 + l_partkey % 136 AS INT) AS sr, CAST(140 + l_suppkey % 100 AS INT) AS sg, CAST(200 + l_linenumber AS INT) AS sb, CAST(l_partkey % 64 + l_suppkey % 20 AS INT) AS efr, CAST(l_suppkey % 50 AS INT) AS efg, "
          "CAST(l_linenumber * 9 AS INT) AS efb, CAST(120 + l_partkey % 136 AS INT) AS esr, CAST(140 + l_suppkey % 100 + l_linenumber * 2 AS INT) AS esg, CAST(200 AS INT) AS esb, CAST(6 AS DOUBLE) AS min_ratio, CAST(9 AS DOUBLE) AS preferred_ratio, "
          "CASE WHEN l_linenumber % 2 = 0 THEN 'body-near-black' ELSE 'contrast-select' END AS foreground_mode")


@query("c7_rendered_color_check", f"""
WITH s AS (SELECT {SAMPLE} FROM lineitem), m AS (SELECT *, {lum('fr', 'fg', 'fb')} AS lf, {ratio(lum('fr', 'fg', 'fb'), lum('sr', 'sg', 'sb'))} AS ra,
  greatest(abs(fr-efr), abs(fg-efg), abs(fb-efb)) AS df, greatest(abs(sr-esr), abs(sg-esg), abs(sb-esb)) AS ds FROM s)
SELECT sample_id, {pr('ra', 6)} AS ratio, {MODE.format('lf')} AS mode, ra + 1e-9 >= preferred_ratio AS preferred_pass, greatest(df, ds) AS max_channel_delta,
  concat_ws(',', CASE WHEN ra + 1e-9 < min_ratio THEN 'insufficient_rendered_contrast' END, CASE WHEN foreground_mode = 'body-near-black' AND lf > 0.10 THEN 'body_foreground_not_near_black' END,
   CASE WHEN df > 12 OR ds > 12 THEN 'rendered_color_drift' END) AS failures FROM m""")
def c7(spark, d):
    return oc.color_check(load(spark, d, "lineitem").selectExpr(*_split(SAMPLE)))


REG = "o_orderkey AS region_id, CAST(o_orderkey % 16 * 16 AS INT) AS fr, CAST(o_custkey % 4 * 48 AS INT) AS fg, CAST(64 AS INT) AS fb, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 48 END AS INT) AS tolerance"
CONTRAST = """
WITH rg AS (SELECT {reg} FROM orders), h AS ({hist}),
p AS (SELECT h.*, fr, fg, fb, greatest(abs(r-fr), abs(g-fg), abs(b-fb)) <= tolerance AS isf FROM h JOIN rg USING (region_id)),
t AS (SELECT region_id, sum(n) FILTER (WHERE isf)::BIGINT AS fn, sum(n) FILTER (WHERE NOT isf)::BIGINT AS bn FROM p GROUP BY 1),
b AS (SELECT p.region_id, n, bn, n >= greatest(2, ceil(bn * 0.001::DOUBLE)) AS kept, {ratio} AS ra FROM p JOIN t USING (region_id) WHERE NOT isf),
k AS (SELECT region_id, bool_or(kept) AS anyk FROM b GROUP BY 1),
e AS (SELECT b.region_id, ra, n FROM b JOIN k USING (region_id) WHERE kept OR NOT anyk),
x AS (SELECT region_id, quantile_cont(ra, 0.05) AS p5, quantile_cont(ra, 0.5) AS p50, min(ra) AS lo FROM (SELECT region_id, ra, unnest(range(n)) FROM e) GROUP BY 1),
y AS (SELECT region_id, sum(n)::BIGINT AS bk FROM e GROUP BY 1)
SELECT rg.region_id, CASE WHEN fn IS NOT NULL AND bn IS NOT NULL THEN fn END AS foreground_n, CASE WHEN fn IS NOT NULL THEN bk END AS background_n,
  CASE WHEN fn IS NOT NULL THEN {lo} END AS min_ratio, CASE WHEN fn IS NOT NULL THEN {p5} END AS p05_ratio, CASE WHEN fn IS NOT NULL THEN {p50} END AS median_ratio,
  CASE WHEN fn IS NOT NULL AND bn IS NOT NULL THEN 'measured' ELSE 'not_verified' END AS status
FROM rg LEFT JOIN t USING (region_id) LEFT JOIN x USING (region_id) LEFT JOIN y USING (region_id)"""


def contrast_sql(reg: str, hist: str) -> str:
    return CONTRAST.format(reg=reg, hist=hist, ratio=ratio(lum("fr", "fg", "fb"), lum("r", "g", "b")),
                           lo=pr("lo", 6), p5=pr("p5", 6), p50=pr("p50", 6))


# one region per customer order, and one for each pixel histogram
@query("c8_region_contrast", contrast_sql(REG, "SELECT * FROM v_pixel_hist"))
def c8(spark, d):
    return oc.region_contrast(view(spark, d, "v_pixel_hist"), load(spark, d, "orders").selectExpr(*_split(REG)))


GRAY_REG = (f"o_orderkey AS region_id, {luma('o_orderkey % 16 * 16', 'o_custkey % 4 * 48', '64')} AS fr, {luma('o_orderkey % 16 * 16', 'o_custkey % 4 * 48', '64')} AS fg, "
            f"{luma('o_orderkey % 16 * 16', 'o_custkey % 4 * 48', '64')} AS fb, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 48 END AS INT) AS tolerance")


@query("c9_grayscale_variant", contrast_sql(GRAY_REG, f"SELECT region_id, y AS r, y AS g, y AS b, sum(n)::BIGINT AS n FROM (SELECT region_id, {luma('r', 'g', 'b')} AS y, n FROM v_pixel_hist) GROUP BY 1, 2"))
def c9(spark, d):
    return oc.grayscale_contrast(view(spark, d, "v_pixel_hist"), load(spark, d, "orders").selectExpr(*_split(REG)))


@query("c10_dominant_saturation", f"""
SELECT region_id, {pr("sum(CASE WHEN (greatest(r,g,b) > 0 AND (greatest(r,g,b)-least(r,g,b))::DOUBLE/greatest(r,g,b) >= 0.55) OR greatest(r,g,b) <= 35 THEN n ELSE 0 END)::DOUBLE / sum(n)", 6)} AS dominant_ratio
FROM v_pixel_hist GROUP BY 1""")
def c10(spark, d):
    return oc.dominant_saturation(view(spark, d, "v_pixel_hist"))


READ = ("l_orderkey AS artifact_id, concat_ws('-', CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING)) AS region_id, CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS contrast, CAST(3 AS DOUBLE) AS min_contrast, "
        "CASE WHEN l_suppkey % 37 = 0 THEN NULL ELSE CAST(6 + l_linenumber AS DOUBLE) END AS font_size, CAST(8 AS DOUBLE) AS min_font, CAST(l_partkey % 16 AS DOUBLE) / 16 AS dominant, 0.75 AS max_dominant, CAST(l_suppkey % 8 AS DOUBLE) / 8 AS glow, 0.75 AS max_glow, "
        "CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE CAST(l_quantity AS DOUBLE) - 1 END AS variant_contrast, l_orderkey % 4 = 0 AS reviewed, CASE WHEN l_orderkey % 2 = 0 THEN 'enforced' ELSE 'shadow' END AS rollout, l_orderkey % 3 = 0 AS required_evidence")
RANKS = {"AQ-CONTRAST-01": "CASE WHEN contrast IS NULL THEN 1 WHEN contrast < min_contrast THEN 3 ELSE 0 END",
         "AQ-LEGIBILITY-01": "CASE WHEN font_size IS NULL THEN 1 WHEN font_size < min_font THEN 3 ELSE 0 END",
         "AQ-HIERARCHY-01": "CASE WHEN dominant > 0.75 AND NOT reviewed THEN 2 ELSE 0 END",
         "AQ-VISUAL-01": "CASE WHEN glow > 0.75 AND NOT reviewed THEN 2 ELSE 0 END",
         "AQ-PRINT-01": "CASE WHEN variant_contrast IS NULL THEN 1 WHEN variant_contrast < min_contrast THEN 3 ELSE 0 END"}


@query("c11_readability_outcomes", f"""
WITH r AS (SELECT {READ} FROM lineitem), k AS ({' UNION ALL '.join(f"SELECT artifact_id, rollout, required_evidence, '{n}' AS rule_id, max({e}) AS k FROM r GROUP BY 1, 2, 3" for n, e in RANKS.items())})
SELECT artifact_id, rule_id, list_extract(['pass','NOT_VERIFIED','REVIEW_CANDIDATE','HARD_FAIL'], k + 1) AS status,
  (CASE WHEN rollout = 'enforced' THEN k > 0 ELSE k = 3 END) OR (required_evidence AND k = 1) AS blocking FROM k""")
def c11(spark, d):
    return oc.readability(load(spark, d, "lineitem").selectExpr(*_split(READ)))


PIX = ("region_id, x, y, CASE WHEN (x * 7 + y * 5 + region_id) % 9 < 3 AND x > 1 AND y > 0 THEN CAST(region_id % 100 AS INT) ELSE CAST(230 + region_id % 20 AS INT) END AS r, "
       "CASE WHEN (x * 7 + y * 5 + region_id) % 9 < 3 AND x > 1 AND y > 0 THEN CAST(region_id % 90 AS INT) ELSE CAST(225 + x % 3 AS INT) END AS g, CAST(220 + y % 4 AS INT) AS b")
BOXES_I = "p_partkey AS region_id, CAST(2 + p_size % 4 AS INT) AS x0, CAST(1 + p_size % 3 AS INT) AS y0, CAST(2 + p_size % 4 + p_size % 6 AS INT) AS x1, CAST(2 + p_size % 5 AS INT) AS y1"
STROKES_I = "p_partkey AS region_id, CAST(0 AS INT) AS x0, CAST(p_size % 8 AS INT) AS y0, CAST(11 AS INT) AS x1, CAST(p_size % 8 AS INT) AS y1"


@query("c12_visible_ink", f"""
WITH g AS (SELECT p_partkey AS region_id, CAST(i AS INT) AS x, CAST(j AS INT) AS y FROM part, unnest(range(12)) AS u(i), unnest(range(8)) AS w(j)),
px AS (SELECT {PIX} FROM g), bx AS (SELECT {BOXES_I} FROM part WHERE p_size % 13 <> 0), st AS (SELECT {STROKES_I} FROM part WHERE p_size % 2 = 0),
bg AS (SELECT region_id, list_sort(list(r))[3] AS br, list_sort(list(g))[3] AS bgg, list_sort(list(b))[3] AS bb FROM px WHERE x IN (0, 11) AND y IN (0, 7) GROUP BY 1),
al AS (SELECT px.* FROM px WHERE EXISTS (SELECT 1 FROM bx WHERE bx.region_id = px.region_id AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)
   AND NOT EXISTS (SELECT 1 FROM st WHERE st.region_id = px.region_id AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)),
k AS (SELECT al.region_id, x, y, {luma('abs(r-br)', 'abs(g-bgg)', 'abs(b-bb)')} >= 32 AS ink FROM al JOIN bg USING (region_id)),
a AS (SELECT region_id, count(*) AS an, count(*) FILTER (WHERE ink) AS n, min(x) FILTER (WHERE ink) AS px0, min(y) FILTER (WHERE ink) AS py0, max(x) FILTER (WHERE ink) + 1 AS px1, max(y) FILTER (WHERE ink) + 1 AS py1 FROM k GROUP BY 1),
z AS (SELECT p_partkey AS region_id, coalesce(n, 0) AS ink_n, least(1.0::DOUBLE, coalesce(n, 0) / greatest(1.0::DOUBLE, greatest(1, coalesce(an, 0)) * 0.025::DOUBLE)) AS cf, px0, py0, px1, py1 FROM part LEFT JOIN a ON a.region_id = p_partkey)
SELECT region_id, ink_n, {pr('cf', 6)} AS confidence, 10 + px0 / 2.0::DOUBLE AS x0, 20 + py0 / 2.0::DOUBLE AS y0, 10 + px1 / 2.0::DOUBLE AS x1, 20 + py1 / 2.0::DOUBLE AS y1,
  CASE WHEN ink_n > 0 AND cf + 1e-9 >= 0.8 THEN 'measured' ELSE 'indeterminate' END AS status FROM z""")
def c12(spark, d):
    part = load(spark, d, "part")
    grid = part.selectExpr("p_partkey AS region_id").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn(
        "y", F.explode(F.sequence(F.lit(0), F.lit(7))))
    regions = part.selectExpr("p_partkey AS region_id", "12 AS w", "8 AS h", "10D AS crop_x0", "20D AS crop_y0", "2D AS scale")
    return oc.visible_ink(grid.selectExpr(*_split(PIX)), regions, part.where("p_size % 13 <> 0").selectExpr(*_split(BOXES_I)),
                          part.where("p_size % 2 = 0").selectExpr(*_split(STROKES_I)))


ALPHA = "l_orderkey % 700 AS region_id, CAST(l_partkey % 300 AS INT) AS x, CAST(l_suppkey % 80 AS INT) AS y, CAST(l_quantity AS INT) % 20 AS alpha"


@query("c13_alpha_envelope", f"SELECT region_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM (SELECT {ALPHA} FROM lineitem) WHERE alpha >= 12 GROUP BY 1")
def c13(spark, d):
    return oc.alpha_bbox(load(spark, d, "lineitem").selectExpr(*_split(ALPHA)), 12)


@query("c14_relative_strength", f"""
WITH s AS (SELECT region_id, region_id % 20 AS page_id, sum(n) AS n, sum({luma('r', 'g', 'b')} * n) AS s, sum({luma('r', 'g', 'b')} * {luma('r', 'g', 'b')} * n) AS q FROM v_pixel_hist GROUP BY 1),
p AS (SELECT page_id, sum(n) AS pn, sum(s) AS ps FROM s GROUP BY 1),
m AS (SELECT region_id, {pr('s::DOUBLE / n / 255.0::DOUBLE', 6)} AS mean, {pr('ps::DOUBLE / pn / 255.0::DOUBLE', 6)} AS page_mean, {pr('(q::DOUBLE - (s * s)::DOUBLE / n) / n / 65025.0::DOUBLE', 6)} AS variance FROM s JOIN p USING (page_id)),
k AS (SELECT *, {pr('abs(mean - page_mean)', 6)} AS delta FROM m)
SELECT region_id, mean, page_mean, delta, variance, CASE WHEN delta >= 0.01 OR variance >= 0.0005 THEN 'pass' ELSE 'review' END AS status FROM k""")
def c14(spark, d):
    hist = view(spark, d, "v_pixel_hist")
    owner = hist.select("region_id").distinct().withColumn("page_id", F.col("region_id") % 20)
    return oc.relative_strength(hist, owner)


@query("c15_binarize_stats", f"""
SELECT region_id, sum(n)::BIGINT AS pixel_n, sum(CASE WHEN y >= 128 THEN n ELSE 0 END)::BIGINT AS white_n, {pr('sum(CASE WHEN y < 245 THEN n ELSE 0 END)::DOUBLE / sum(n)', 6)} AS nonwhite_ratio,
  {pr('sum(y * n)::DOUBLE / sum(n)', 4)} AS gray_mean FROM (SELECT region_id, {luma('r', 'g', 'b')} AS y, n FROM v_pixel_hist) GROUP BY 1""")
def c15(spark, d):
    return oc.binarize_stats(view(spark, d, "v_pixel_hist"), 128)


@query("c15_half_scale", "SELECT region_id, greatest(1, count(*) // 2)::BIGINT AS half_width, greatest(1, (sum(n) % 97)::BIGINT // 2)::BIGINT AS half_height FROM v_pixel_hist GROUP BY 1")
def c15_half(spark, d):
    sized = view(spark, d, "v_pixel_hist").groupBy("region_id").agg(F.count(F.lit(1)).alias("w"), (F.sum("n") % 97).alias("h"))
    return sized.select("region_id", *oc.half_scale(F.col("w"), F.col("h")))


@query("c16_readback_compare", f"""
WITH a AS (SELECT region_id, sum(n)::BIGINT AS pixel_n FROM v_pixel_hist WHERE region_id % 19 <> 0 GROUP BY 1), b AS (SELECT region_id, sum(CASE WHEN region_id % 7 = 0 AND b = 32 THEN 0 ELSE n END)::BIGINT AS pixel_n FROM v_pixel_hist WHERE region_id % 23 <> 0 GROUP BY 1)
SELECT region_id, CASE WHEN a.pixel_n IS NULL THEN 'not_stored' WHEN b.pixel_n IS NULL THEN 'not_measured' ELSE 'measurement_drift' END AS reason FROM a FULL JOIN b USING (region_id) WHERE a.pixel_n IS DISTINCT FROM b.pixel_n""")
def c16(spark, d):
    hist = view(spark, d, "v_pixel_hist")
    stored = hist.where("region_id % 19 <> 0").groupBy("region_id").agg(F.sum("n").alias("pixel_n"))
    now = hist.where("region_id % 23 <> 0").groupBy("region_id").agg(F.sum(F.expr("IF(region_id % 7 = 0 AND b = 32, 0, n)")).alias("pixel_n"))
    return oc.readback_compare(stored, now, ["region_id"])
