"""Line, margin and occupancy measures over layout tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import skew
from ..functions.common import PAGE_KEY, prefixed, py_round
from .layout_pairs import assign_region

# fixed value: share of the page above the footer band
FOOTER_BAND_RATIO = 0.90
BAND = 128.0


def _line_band() -> Column:
    return F.floor(F.col("y0") / BAND)


def union_box(boxes: DataFrame, by: list[str]) -> DataFrame:
    return boxes.groupBy(*by).agg(
        *[py_round((F.min if e in ("x0", "y0") else F.max)(e), 3).alias(e) for e in geo.EDGES],
        F.count(F.lit(1)).alias("n"))


def coalesce_baselines(lines: DataFrame, tolerance: float = 0.75, crowd: int = skew.CROWD) -> DataFrame:
    """Merge fragments on one visual baseline, measured from the group's first baseline.

    The distinct baselines of a page are folded in order in its row. On pages of more than ``crowd`` lines they
    are first cut where two neighbours are further apart than the tolerance; only the short chains between cuts need
    the ordered fold that anchors a group at its first member.
    """
    anchored = F.aggregate(
        "ys", F.array().cast("array<struct<y:double,anchor:double>>"),
        lambda acc, y: F.concat(acc, F.array(F.struct(
            y.alias("y"),
            F.when((F.size(acc) > 0) & (y - F.element_at(acc, -1)["anchor"] <= tolerance),
                   F.element_at(acc, -1)["anchor"]).otherwise(y).alias("anchor")))))

    def plain(lines: DataFrame) -> DataFrame:
        pages = lines.groupBy(*PAGE_KEY).agg(F.array_sort(F.collect_set("baseline_y")).alias("ys"))
        own = F.col("baseline_y")
        return lines.join(pages.select(*PAGE_KEY, anchored.alias("_anchors")), PAGE_KEY).withColumn(
            "anchor", F.get(F.filter("_anchors", lambda s: s["y"] == own), F.lit(0))["anchor"]).drop("_anchors").where(F.col("anchor").isNotNull())

    def spread(lines: DataFrame) -> DataFrame:
        levels = lines.groupBy(*PAGE_KEY, "baseline_y").agg(F.count(F.lit(1)).alias("_n"))
        band = F.floor(F.col("baseline_y") / BAND)
        levels = skew.shift(levels, PAGE_KEY, ["baseline_y"], {"_prev": F.col("baseline_y")}, -1, band)
        cut = F.col("_prev").isNull() | (F.col("baseline_y") - F.col("_prev") > tolerance)
        levels = skew.running(levels, PAGE_KEY, ["baseline_y"],
                              {"chain": ("max", F.when(cut, F.col("baseline_y")))}, band)
        chains = levels.groupBy(*PAGE_KEY, "chain").agg(F.array_sort(F.collect_list("baseline_y")).alias("ys"))
        anchors = chains.select(*PAGE_KEY, F.inline(F.when(
            F.size("ys") == 1, F.array(F.struct(F.col("chain").alias("y"), F.col("chain").alias("anchor")))
        ).otherwise(anchored))).withColumnRenamed("y", "baseline_y")
        return lines.join(anchors, [*PAGE_KEY, "baseline_y"]).select(*lines.columns, "anchor")

    joined = skew.by_crowd(PAGE_KEY, skew.crowds(PAGE_KEY, lines, limit=crowd), plain, spread, lines)
    ordered = F.array_sort(F.collect_list(F.struct("x0", "box_id", "text")))
    return joined.groupBy(*PAGE_KEY, "anchor").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        py_round(F.avg("baseline_y"), 4).alias("baseline_y"), F.max("font_size").alias("font_size"),
        F.count(F.lit(1)).alias("fragments"),
        F.array_join(F.transform(ordered, lambda s: s["text"]), "").alias("text"))


def baseline_deltas(lines: DataFrame) -> DataFrame:
    """Step and box overlap between consecutive lines of a block."""
    keys = [*PAGE_KEY, "block_id"]
    prev = F.struct("box_id", "baseline_y", *geo.EDGES)
    out = skew.shift(lines, keys, ["line_index", "y0", "box_id"], {"p": prev}, -1,
                     F.floor(F.col("line_index") / 4096)).where(F.col("p").isNotNull())
    out = out.select(*keys, "box_id", "baseline_y", *[F.col(e).alias("b_" + e) for e in geo.EDGES],
                     F.col("p.box_id").alias("previous_id"), F.col("p.baseline_y").alias("previous_y"),
                     *[F.col("p." + e).alias("a_" + e) for e in geo.EDGES])
    return out.select(*keys, "box_id", "previous_id",
                      py_round(F.col("baseline_y") - F.col("previous_y"), 3).alias("delta"),
                      py_round(geo.intersection_area("a_", "b_"), 3).alias("overlap_area"))


def line_geometry(lines: DataFrame, baseline_tolerance: float = 0.75, overlap_tolerance: float = 0.5) -> DataFrame:
    """Too-close baselines need review; otherwise overlapping neighbours fail."""
    close = F.col("delta") <= baseline_tolerance
    return baseline_deltas(lines).withColumn("status", F.when(close, "review").when(
        F.col("overlap_area") > overlap_tolerance, "fail")).where(F.col("status").isNotNull())


def _continuations(lines: DataFrame) -> DataFrame:
    """Lines that continue the paragraph of the line before them in their frame."""
    keys = [*PAGE_KEY, "frame_id"]
    prev = F.struct("baseline_y", "paragraph")
    out = skew.shift(lines, keys, ["line_index"], {"p": prev}, -1, F.floor(F.col("line_index") / 4096))
    return out.where(F.col("p.paragraph") == F.col("paragraph"))


def baseline_ratio(lines: DataFrame, low: float = 1.30, high: float = 1.42) -> DataFrame:
    """Frames with a continuation step over font size outside the allowed span."""
    ratio = (F.col("baseline_y") - F.col("p.baseline_y")) / F.col("font_size")
    return _continuations(lines).where(F.col("font_size") > 0).select(
        *PAGE_KEY, "frame_id", ratio.alias("ratio")).groupBy(*PAGE_KEY, "frame_id").agg(
        F.min("ratio").alias("lo"), F.max("ratio").alias("hi")).where(
        (F.col("lo") < low) | (F.col("hi") > high)).select(
        *PAGE_KEY, "frame_id", py_round(F.col("lo"), 4).alias("minimum"), py_round(F.col("hi"), 4).alias("maximum"))


def hanging_indent(lines: DataFrame, glyphs: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """Continuation lines against the first body glyph after the label colon.

    ``glyphs``: page key, ``box_id, pos`` (0-based), ``ch, gx``.
    """
    ink = glyphs.where(F.length(F.trim("ch")) > 0)
    wide, narrow = F.instr("text", "："), F.instr("text", ":")
    colon = F.when((wide > 0) & (narrow > 0), F.least(wide, narrow)).otherwise(F.greatest(wide, narrow))
    keys = [*PAGE_KEY, "frame_id", "paragraph"]
    marked = lines.select(*keys, "box_id", "line_index", F.when(colon > 0, colon).alias("body_pos"))
    measured = marked.join(skew.grown(ink.select(*PAGE_KEY, "box_id", "pos", "gx")), [*PAGE_KEY, "box_id"], "left").groupBy(
        *keys, "box_id", "line_index").agg(
        F.min(F.struct("pos", "gx"))["gx"].alias("first_x"),
        F.min(F.when(F.col("pos") >= F.col("body_pos"), F.struct("pos", "gx")))["gx"].alias("body_x"))
    heads = measured.groupBy(*keys).agg(
        F.min(F.struct("line_index", "body_x"))["body_x"].alias("head_x"), F.min("line_index").alias("head_index"))
    deviation = F.coalesce(F.abs(F.col("first_x") - F.col("head_x")), F.lit(tolerance + 1.0))
    return measured.join(heads, keys).where(F.col("line_index") > F.col("head_index")).groupBy(
        *PAGE_KEY, "frame_id").agg(py_round(F.max(deviation), 4).alias("max_deviation")).where(
        F.col("max_deviation") > tolerance)


def page_dead_space(lines: DataFrame, pages: DataFrame, ratio_max: float | None = None,
                    footer_max: float | None = None) -> DataFrame:
    """Blank height below the last content of each page."""
    bottoms = lines.groupBy(*PAGE_KEY).agg(F.max("y1").alias("bottom"), F.count(F.lit(1)).alias("line_count"))
    blank = F.greatest(F.lit(0.0), F.col("height") - F.coalesce("bottom", F.lit(0.0)))
    ratio = F.when(F.col("height") > 0, blank / F.col("height")).otherwise(F.lit(1.0))
    return pages.select(*PAGE_KEY, "height").join(bottoms, PAGE_KEY, "left").select(
        *PAGE_KEY, F.coalesce("line_count", F.lit(0)).alias("line_count"),
        py_round(blank, 3).alias("bottom_blank"), py_round(ratio, 6).alias("bottom_blank_ratio"),
        (F.lit(False) if ratio_max is None else ratio > ratio_max + 1e-9).alias("ratio_exceeded"),
        (F.lit(False) if footer_max is None else blank > footer_max + 0.01).alias("footer_exceeded"))


def _lines_over(boxes: DataFrame, lines: DataFrame, box_key: str) -> DataFrame:
    """Line pieces inside each box: start and end clipped to the box."""
    a = prefixed(boxes.select(*PAGE_KEY, box_key, *geo.EDGES), "a_", PAGE_KEY)
    b = prefixed(lines.select(*PAGE_KEY, *geo.EDGES), "b_", PAGE_KEY)
    return skew.box_pairs(a, b, PAGE_KEY, residual=geo.intersects("a_", "b_")).select(
        *PAGE_KEY, F.col("a_" + box_key).alias(box_key), F.greatest("a_y0", "b_y0").alias("lo"),
        F.least("a_y1", "b_y1").alias("hi"))


def vertical_occupancy(boxes: DataFrame, lines: DataFrame, box_key: str = "card_id") -> DataFrame:
    """Share of a box's height covered by lines, and the blank share below the last one.

    Covered length is summed over horizontal bands, each a small interval
    union, so one tall crowded box does not become one task.
    """
    keys = [*PAGE_KEY, box_key]
    pieces = _lines_over(boxes, lines, box_key)
    first, last = F.floor(F.col("lo") / BAND), F.floor(F.col("hi") / BAND)
    cut = pieces.select(*keys, "lo", "hi", F.explode(F.sequence(first, last)).alias("band")).select(
        *keys, "band", F.greatest("lo", F.col("band") * BAND).alias("lo"),
        F.least("hi", (F.col("band") + 1) * BAND).alias("hi")).groupBy(*keys, "band", "lo").agg(
        F.max("hi").alias("hi"))
    before = Window.partitionBy(*keys, "band").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("hi").over(before), F.col("lo"))
    covered = cut.select(*keys, F.greatest(F.lit(0.0), F.col("hi") - F.greatest("lo", reach)).alias("len"), "hi"
                         ).groupBy(*keys).agg(F.sum("len").alias("covered"), F.max("hi").alias("bottom"))
    tall = F.greatest(F.lit(1.0), geo.height())
    return boxes.join(covered, keys, "left").select(
        *[F.col(c) for c in boxes.columns],
        py_round(F.coalesce("covered", F.lit(0.0)) / tall, 5).alias("occupancy"),
        F.when(F.col("bottom").isNull(), F.lit(1.0)).otherwise(
            py_round((F.col("y1") - F.col("bottom")) / tall, 5)).alias("bottom_blank_ratio"))


def bottom_blank(boxes: DataFrame, lines: DataFrame, box_key: str = "card_id") -> DataFrame:
    """Blank share below the last line of each box alone; 1.0 without lines."""
    keys = [*PAGE_KEY, box_key]
    last = _lines_over(boxes, lines, box_key).groupBy(*keys).agg(F.max("hi").alias("bottom"))
    tall = F.greatest(F.lit(1.0), geo.height())
    return boxes.join(last, keys, "left").select(
        *keys, F.when(F.col("bottom").isNull(), F.lit(1.0)).otherwise(
            py_round((F.col("y1") - F.col("bottom")) / tall, 5)).alias("bottom_blank_ratio"))


def low_occupancy(regions: DataFrame, lines: DataFrame, pages: DataFrame, key: str = "card_id",
                  tall_share: float = 0.55, minimum: float = 0.35) -> DataFrame:
    """Tall text regions that are mostly empty."""
    tall = regions.join(pages.select(*PAGE_KEY, F.col("height").alias("page_height")), PAGE_KEY).where(
        geo.height() >= F.col("page_height") * tall_share).drop("page_height")
    return vertical_occupancy(tall, lines, key).where(F.col("occupancy") < minimum)


def line_spacing_projection(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Consecutive lines of a page in reading order, with their gaps and roles."""
    return spacing_of(assign_region(lines, regions, {"role": "region_role"}))


def spacing_of(placed: DataFrame) -> DataFrame:
    """The rows of ``line_spacing_projection`` from lines that carry the role of their region."""
    row = F.struct("box_id", "block_id", "baseline_y", "y0", "y1", "region_role")
    pairs = skew.shift(placed, PAGE_KEY, ["y0", "x0", "box_id"], {"nxt": row}, 1, _line_band())
    gap = py_round(F.greatest(F.lit(0.0), F.col("nxt.y0") - F.col("y1")), 3)
    return pairs.where(F.col("nxt").isNotNull()).select(
        *PAGE_KEY, F.col("box_id").alias("upper_id"), F.col("nxt.box_id").alias("lower_id"),
        py_round(F.col("nxt.baseline_y") - F.col("baseline_y"), 3).alias("baseline_distance"),
        gap.alias("box_gap"),
        F.when(F.col("block_id") == F.col("nxt.block_id"), "same_block").otherwise("adjacent_blocks").alias("relation"),
        F.when(F.col("block_id") != F.col("nxt.block_id"), gap).alias("paragraph_gap"),
        F.coalesce("region_role", F.lit("unknown")).alias("upper_role"),
        F.coalesce("nxt.region_role", F.lit("unknown")).alias("lower_role"))


def _margins(inner: str, outer: list[Column]) -> list[Column]:
    zero = F.lit(0.0)
    x0, y0, x1, y1 = geo.cols(inner)
    gaps = [x0 - outer[0], y0 - outer[1], outer[2] - x1, outer[3] - y1]
    names = ["left_pt", "top_pt", "right_pt", "bottom_pt"]
    margins = [py_round(F.greatest(zero, g), 3) for g in gaps]
    return [m.alias(n) for m, n in zip(margins, names)] + [F.least(*margins).alias("minimum_margin")]


def inner_margins(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Margins between a text region and the lines placed in it."""
    return margins_of(assign_region(lines, regions), regions)


def margins_of(placed: DataFrame, regions: DataFrame) -> DataFrame:
    """The rows of ``inner_margins`` from lines that carry their region."""
    inner = prefixed(union_box(placed.where(F.col("region_id").isNotNull()), [*PAGE_KEY, "region_id"]), "l_", [*PAGE_KEY, "region_id"])
    return regions.select(*PAGE_KEY, "region_id", *geo.EDGES).join(inner, [*PAGE_KEY, "region_id"]).select(
        *PAGE_KEY, "region_id", F.col("l_n").alias("line_count"), *_margins("l_", geo.cols()))


def outer_margins(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Margins between the page and all of its lines."""
    box = prefixed(union_box(lines, PAGE_KEY), "l_", PAGE_KEY)
    edges = [F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height")]
    return pages.select(*PAGE_KEY, "width", "height").join(box, PAGE_KEY).select(
        *PAGE_KEY, *_margins("l_", edges))


def title_body_gap(regions: DataFrame) -> DataFrame:
    """Smallest distance from a title down to a body region, per artifact.

    Walks edges from the bottom up keeping the nearest body top seen so far,
    instead of pairing every title with every body.
    """
    edge = regions.where(F.col("role").isin("title", "text-region")).select(
        *PAGE_KEY, F.when(F.col("role") == "title", F.col("y1")).otherwise(F.col("y0")).alias("at"),
        (F.col("role") == "title").alias("is_title"), "region_id")
    edge = edge.withColumn("down", -F.col("at")).withColumn("rank", F.col("is_title").cast("int"))
    body_top = F.when(~F.col("is_title"), F.col("at"))
    walked = skew.running(edge, PAGE_KEY, ["down", "rank", "region_id"], {"body_y": ("min", body_top)},
                          F.floor(F.col("down") / BAND))
    return walked.where(F.col("is_title") & F.col("body_y").isNotNull()).groupBy("artifact_id").agg(
        py_round(F.min(F.col("body_y") - F.col("at")), 3).alias("title_body_gap"))


def artifact_minima(lines: DataFrame, regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Smallest margins and gaps of each artifact."""
    placed = lines.join(pages.select(*PAGE_KEY, "width", "height"), PAGE_KEY).where(
        F.col("y0") < F.col("height") * FOOTER_BAND_RATIO)
    zero = F.lit(0.0)
    outer = placed.groupBy("artifact_id").agg(py_round(F.min(F.least(
        "x0", "y0", F.greatest(zero, F.col("width") - F.col("x1")),
        F.greatest(zero, F.col("height") - F.col("y1")))), 3).alias("outer_margin"))
    # placed once: the pairs of lines and regions are the larger part of the work
    in_region = assign_region(lines, regions, {"role": "region_role"})
    spacing = spacing_of(in_region).groupBy("artifact_id").agg(
        F.min("baseline_distance").alias("minimum_baseline_distance"), F.min("box_gap").alias("minimum_box_gap"),
        F.min("paragraph_gap").alias("minimum_paragraph_gap"))
    inner = margins_of(in_region, regions).groupBy("artifact_id").agg(
        F.min("minimum_margin").alias("minimum_inner_margin"))
    margins = outer_margins(lines, pages).groupBy("artifact_id").agg(
        F.min("minimum_margin").alias("minimum_outer_margin"))
    out = pages.select("artifact_id").distinct()
    for part in (outer, title_body_gap(regions), spacing, inner, margins):
        out = out.join(part, "artifact_id", "left")
    return out


def semantic_cards(regions: DataFrame, lines: DataFrame, min_occupancy: float = 0.35,
                   max_blank: float = 0.45) -> DataFrame:
    """Cards need one container, heading and body each, contained and not sparse; containers may not overlap."""
    key = [*PAGE_KEY, "semantic_group"]
    members = regions.where(F.col("semantic_group").isNotNull())
    role = F.col("semantic_role")
    box = F.struct(*geo.EDGES)
    counted = members.groupBy(*key).agg(
        *[F.count_if(role == r).alias("n_" + r) for r in ("container", "heading", "body")],
        F.min(F.when(role == "container", box)).alias("c"))
    single = counted.withColumn("c", F.when(F.col("n_container") == 1, F.col("c")))
    inside = members.where(role.isin("heading", "body")).join(
        single.where(F.col("c").isNotNull()).select(*key, *[F.col("c." + e).alias("c_" + e) for e in geo.EDGES]), key)
    outside = inside.where(~geo.contains("c_", "")).groupBy(*key).agg(F.count(F.lit(1)).alias("n_outside"))
    boxes = single.where(F.col("c").isNotNull()).select(*key, "c.*")
    filled = vertical_occupancy(boxes, lines, "semantic_group").select(*key, "occupancy", "bottom_blank_ratio")
    a, b = prefixed(boxes, "a_", PAGE_KEY), prefixed(boxes, "b_", PAGE_KEY)
    hit = skew.box_pairs(a, b, PAGE_KEY, residual=geo.intersects("a_", "b_") & (
        F.col("a_semantic_group") != F.col("b_semantic_group"))).select(
        *PAGE_KEY, F.col("a_semantic_group").alias("semantic_group")).distinct().withColumn("overlaps", F.lit(True))
    out = single.join(outside, key, "left").join(filled, key, "left").join(hit, key, "left")
    malformed = (F.col("n_container") != 1) | (F.col("n_heading") != 1) | (F.col("n_body") != 1)
    escaped = F.coalesce("n_outside", F.lit(0)) > 0
    sparse = F.coalesce((F.col("occupancy") < min_occupancy) & (F.col("bottom_blank_ratio") > max_blank), F.lit(False))
    clash = F.coalesce("overlaps", F.lit(False))
    return out.select(
        *key, malformed.alias("malformed"), F.coalesce("n_outside", F.lit(0)).alias("n_outside"),
        "occupancy", "bottom_blank_ratio", clash.alias("overlapping"),
        F.when(malformed | escaped | sparse | clash, "block").otherwise("pass").alias("status"))
