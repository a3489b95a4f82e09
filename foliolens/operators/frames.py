"""Frames, surfaces and components: relations, alignment, steps, tables, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import skew
from ..functions.common import PAGE_KEY, prefixed, py_round, reasons
from .layout_lines import vertical_occupancy

EPS = 1e-9
# fixed values: caller roles with a class of their own
ROLE_CLASSES = ["code", "warning", "question", "answer"]


def direction_gap(ax: Column, ay: Column, dx: Column, dy: Column) -> tuple[Column, Column, Column]:
    """Signed distance from an anchor to a box along a direction, with the unit direction."""
    length = F.sqrt(dx * dx + dy * dy)
    ux, uy = dx / length, dy / length
    corners = [F.col(x) * ux + F.col(y) * uy for x in ("x0", "x1") for y in ("y0", "y1")]
    return F.least(*corners) - (ax * ux + ay * uy), ux, uy


def relative_anchor_gap(df: DataFrame) -> DataFrame:
    """Gap from anchor ``ax, ay`` to a box along ``dx, dy`` as a share of the box width.

    Also reads ``target, tolerance, contact_tolerance, no_contact, touching,
    facing_expected, facing_actual`` and the safe rectangle ``sx0..sy1``.
    """
    gap, _, _ = direction_gap(F.col("ax"), F.col("ay"), F.col("dx"), F.col("dy"))
    ratio = gap / geo.width()
    contact = F.col("touching") | (gap <= F.col("contact_tolerance") + EPS)
    unsafe = ((F.col("x0") < F.col("sx0") - EPS) | (F.col("y0") < F.col("sy0") - EPS)
              | (F.col("x1") > F.col("sx1") + EPS) | (F.col("y1") > F.col("sy1") + EPS))
    failures = reasons(
        (gap < 0, "relative_anchor_gap_negative"),
        ((ratio < F.col("target") - F.col("tolerance") - EPS) | (ratio > F.col("target") + F.col("tolerance") + EPS),
         "relative_anchor_gap_ratio_out_of_range"),
        (F.col("no_contact") & contact, "relative_anchor_gap_contact"),
        (F.col("facing_actual") != F.col("facing_expected"), "relative_anchor_gap_facing_mismatch"),
        (F.coalesce(unsafe, F.lit(False)), "relative_anchor_gap_clip_overflow"))
    return df.select("*", py_round(gap, 4).alias("gap"), py_round(ratio, 8).alias("gap_ratio"),
                     F.when(F.size(failures) > 0, "fail").otherwise("pass").alias("status"),
                     F.array_join(failures, ",").alias("failed_constraints"))


def translation_to_target(df: DataFrame) -> DataFrame:
    """Shift along the direction that brings the box to its target ratio."""
    gap, ux, uy = direction_gap(F.col("ax"), F.col("ay"), F.col("dx"), F.col("dy"))
    delta = F.col("target") * geo.width() - gap
    return df.select("*", py_round(delta * ux, 4).alias("shift_x"), py_round(delta * uy, 4).alias("shift_y"))


def frame_relation_gap(a: str, b: str, relation: Column) -> tuple[Column, Column]:
    """Effective gap of box ``a`` to target ``b``, and their shared area."""
    ox = F.greatest(F.lit(0.0), geo.overlap_x(a, b))
    oy = F.greatest(F.lit(0.0), geo.overlap_y(a, b))
    area = ox * oy
    inset = F.least(F.col(a + "x0") - F.col(b + "x0"), F.col(a + "y0") - F.col(b + "y0"),
                    F.col(b + "x1") - F.col(a + "x1"), F.col(b + "y1") - F.col(a + "y1"))
    dx, dy = geo.gap_x(a, b), geo.gap_y(a, b)
    apart = F.when(area == 0, F.sqrt(dx * dx + dy * dy)).otherwise(-F.least(ox, oy))
    return F.when(relation == "inside", inset).otherwise(apart), area


def frame_relation(df: DataFrame) -> DataFrame:
    """Glyph box (``g_``) against its target box (``t_``): inside, outside or no_overlap."""
    gap, area = frame_relation_gap("g_", "t_", F.col("relation"))
    enough = gap >= F.col("min_gap") - 0.01
    ok = F.when(F.col("relation") == "inside", enough).otherwise((area <= 0.0001) & enough)
    return df.select("*", py_round(gap, 4).alias("effective_gap"), py_round(area, 4).alias("overlap_area"),
                     ok.alias("relation_pass"))


def alignment_check(df: DataFrame) -> DataFrame:
    """Centre offsets of the glyph box (``g_``) from the padded frame (``f_``)."""
    cx0, cx1 = F.col("f_x0") + F.col("pad_left"), F.col("f_x1") - F.col("pad_right")
    cy0, cy1 = F.col("f_y0") + F.col("pad_top"), F.col("f_y1") - F.col("pad_bottom")
    dx = (F.col("g_x0") + F.col("g_x1") - cx0 - cx1) / 2
    dy = (F.col("g_y0") + F.col("g_y1") - cy0 - cy1) / 2
    limit = F.col("tolerance") + 0.01
    ok = (((F.col("horizontal_align") != "center") | (F.abs(dx) <= limit))
          & ((F.col("vertical_align") != "center") | (F.abs(dy) <= limit))
          & (~F.col("single_line") | (F.col("line_count") == 1)))
    return df.select("*", py_round(dx, 4).alias("delta_x"), py_round(dy, 4).alias("delta_y"), ok.alias("aligned"))


def line_steps(lines: DataFrame, frames: DataFrame) -> DataFrame:
    """Every step between consecutive lines of a frame against the applied step."""
    keys = [*PAGE_KEY, "frame_id"]
    stepped = skew.shift(lines.select(*keys, "line_index", "baseline_y"), keys, ["line_index"],
                         {"prev_y": F.col("baseline_y")}, -1, F.floor(F.col("line_index") / 4096))
    spec = frames.select(*keys, "requested", "applied", "tolerance")
    step = F.col("baseline_y") - F.col("prev_y")
    agg = stepped.join(spec, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count("prev_y").alias("sample_count"), F.avg(step).alias("mean_step"),
        F.bool_and(F.abs(step - F.col("applied")) <= F.col("tolerance") + 0.01).alias("steps_ok"),
        F.first("applied").alias("applied"), F.first("requested").alias("requested"),
        F.first("tolerance").alias("tolerance"))
    single = F.abs(F.col("requested") - F.col("applied")) <= F.col("tolerance") + EPS
    return agg.select(*keys, "sample_count", py_round(F.coalesce("mean_step", "applied"), 4).alias("effective_step"),
                      F.when(F.col("n_lines") == 1, single).otherwise(
                          (F.col("sample_count") > 0) & F.coalesce("steps_ok", F.lit(False))).alias("spacing_pass"))


def group_steps(frames: DataFrame) -> DataFrame:
    """Planned and rendered steps between the frames of a spacing group.

    ``frames``: page key, ``group_id, spacing_index, planned_y, rendered_y, applied, tolerance``.
    A group needs two frames and gap-free indices from any start.
    """
    keys = [*PAGE_KEY, "group_id"]
    shape = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("spacing_index").alias("lo"), F.max("spacing_index").alias("hi"))
    prev = skew.shift(frames, keys, ["spacing_index", "frame_id"], {"p": F.struct("planned_y", "rendered_y", "spacing_index")}, -1,
                      F.floor(F.col("spacing_index") / 4096))
    planned = F.col("planned_y") - F.col("p.planned_y")
    rendered = F.col("rendered_y") - F.col("p.rendered_y")
    repeats = prev.where(F.col("p.spacing_index") == F.col("spacing_index")).select(*keys).distinct().withColumn(
        "repeated", F.lit(True))
    contiguous = (F.col("n") >= 2) & (F.col("hi") - F.col("lo") + 1 == F.col("n")) & F.col("repeated").isNull()
    return prev.where(F.col("p").isNotNull()).join(shape, keys).join(repeats, keys, "left").select(
        *keys, "frame_id", "spacing_index", contiguous.alias("group_ok"),
        py_round(planned, 4).alias("planned_step"),
        (F.abs(planned - F.col("applied")) <= F.col("tolerance") + EPS).alias("planned_ok"),
        py_round(rendered, 4).alias("rendered_step"),
        F.coalesce(F.abs(rendered - F.col("applied")) <= F.col("tolerance") + 0.01, F.lit(False)).alias("rendered_ok"))


def table_groups(rows: DataFrame) -> DataFrame:
    """Rows of one table must tile: indices 0..n-1, same x, width, kind and style, no gap.

    ``rows``: ``group_id, row_index, x, y, w, h, kind, style``.
    """
    body = F.struct("row_index", "x", "y", "w", "h", "kind", "style")
    prev = skew.shift(rows, ["group_id"], ["row_index", "target_id"], {"p": body}, -1, F.floor(F.col("row_index") / 4096))
    tiles = ((F.col("row_index") == F.col("p.row_index") + 1) & (F.abs(F.col("x") - F.col("p.x")) <= 0.01)
             & (F.abs(F.col("w") - F.col("p.w")) <= 0.01)
             & (F.abs(F.col("y") - (F.col("p.y") + F.col("p.h"))) <= 0.01)
             & F.col("style").eqNullSafe(F.col("p.style")) & (F.col("kind") == F.col("p.kind")))
    place = F.struct("row_index", "x", "y", "w", "h")
    out = prev.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("row_index").alias("lo"), F.max("row_index").alias("hi"),
        F.bool_and(F.when(F.col("p").isNotNull(), tiles)).alias("tiled"),
        F.min(place).alias("top"), F.max(place).alias("last"))
    valid = ((F.col("row_count") >= 2) & (F.col("lo") == 0) & (F.col("hi") == F.col("row_count") - 1)
             & F.coalesce("tiled", F.lit(False)))
    return out.select("group_id", "row_count", valid.alias("valid"), py_round(F.col("top.x"), 4).alias("x"),
                      py_round(F.col("top.y"), 4).alias("y"), py_round(F.col("top.w"), 4).alias("w"),
                      py_round(F.col("last.y") + F.col("last.h") - F.col("top.y"), 4).alias("h"))


def target_conflicts(relations: DataFrame) -> DataFrame:
    """Targets declared with more than one kind, box or style."""
    identity = F.struct("kind", *geo.EDGES, F.coalesce("style", F.lit("")))
    return relations.groupBy("target_id").agg(F.min(identity).alias("lo"), F.max(identity).alias("hi"),
                                              F.count(F.lit(1)).alias("n")).where(
        F.col("lo") != F.col("hi")).select("target_id", "n")


def perimeter_contact(surfaces: DataFrame, text: DataFrame) -> DataFrame:
    """Outlined surface edges that run through unowned text; the longest edge is kept.

    Repeated candidates collapse into one row with their count.
    """
    s = surfaces.where("outlined").select(*PAGE_KEY, "component_id", *geo.EDGES)
    t = text.where(F.col("owner_id").isNull() & ~F.col("overlay")).select(*PAGE_KEY, "text_id", *geo.EDGES)
    pairs = skew.box_pairs(prefixed(s, "a_", PAGE_KEY), prefixed(t, "b_", PAGE_KEY), PAGE_KEY)

    def crossing(edge: str, at: str, flat: bool) -> Column:
        across, along = ("y", "x") if flat else ("x", "y")
        start = F.greatest(F.col(f"a_{along}0"), F.col(f"b_{along}0"))
        end = F.least(F.col(f"a_{along}1"), F.col(f"b_{along}1"))
        line = F.col("a_" + at)
        hit = (F.col(f"b_{across}0") <= line) & (line <= F.col(f"b_{across}1")) & (end > start)
        return F.when(hit, F.struct(py_round(end - start, 3).alias("length"), F.lit(edge).alias("edge"),
                                    py_round(start, 3).alias("start_at"), py_round(end, 3).alias("end_at"),
                                    py_round(line, 3).alias("line_at")))

    found = F.array_compact(F.array(crossing("top", "y0", True), crossing("bottom", "y1", True),
                                    crossing("left", "x0", False), crossing("right", "x1", False)))
    best = pairs.select(*PAGE_KEY, F.col("a_component_id").alias("component_id"), F.col("b_text_id").alias("text_id"),
                        F.array_max(found).alias("c")).where(F.col("c").isNotNull())
    return best.groupBy(*PAGE_KEY, "component_id", "text_id", "c").agg(
        (F.count(F.lit(1)) - 1).alias("duplicates")).select(*PAGE_KEY, "component_id", "text_id", "c.*", "duplicates")


def role_class(role: Column) -> Column:
    name = F.replace(F.lower(F.trim(role)), F.lit("_"), F.lit("-"))
    cases = [F.when((name == r) | name.endswith("-" + r) | name.startswith(r + "-"), F.lit(r)) for r in ROLE_CLASSES]
    return F.coalesce(*cases, F.lit("caller-defined"))


def surface_metrics(regions: DataFrame, pages: DataFrame, lines: DataFrame, max_area: float = 0.60,
                    min_occupancy: float = 0.35, max_blank: float = 0.45) -> DataFrame:
    """Area share, occupancy and class of each surface, with its review flags."""
    sized = vertical_occupancy(regions, lines, "region_id").join(
        pages.select(*PAGE_KEY, "width", "height"), PAGE_KEY, "left")
    ratio = py_round(geo.area() / (F.col("width") * F.col("height")), 6)
    sparse = (F.col("occupancy") < min_occupancy) & (F.col("bottom_blank_ratio") > max_blank)
    broken = ~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    flagged = sized.select(*PAGE_KEY, "region_id", role_class(F.col("caller_role")).alias("role_class"),
                           ratio.alias("area_ratio"), "occupancy", "bottom_blank_ratio",
                           F.coalesce(ratio > max_area, F.lit(False)).alias("too_large"), sparse.alias("sparse"), broken.alias("no_page"))
    return flagged.withColumn("classification", F.when(F.col("no_page"), "HARD_FAIL").when(
        F.col("too_large") | F.col("sparse"), "REVIEW_CANDIDATE").otherwise("INFO"))


def surface_summary(surfaces: DataFrame) -> DataFrame:
    return surfaces.groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("surface_count"), F.max("area_ratio").alias("max_area_ratio"),
        F.min("occupancy").alias("min_occupancy"), F.max("bottom_blank_ratio").alias("max_blank_ratio"),
        F.count_if(F.col("classification") == "REVIEW_CANDIDATE").alias("review_count"),
        F.count_if(F.col("classification") == "HARD_FAIL").alias("hard_count"))


def page_run_members(regions: DataFrame, prominent: list[str]) -> DataFrame:
    """Prominent regions with the first page of the consecutive run they belong to."""
    picked = regions.where(F.col("tier").isin(prominent) & F.col("scope_id").isNotNull()).select(
        "scope_id", "page", "region_id")
    levels = picked.groupBy("scope_id", "page").agg(F.count(F.lit(1)).alias("_n"))
    band = F.floor(F.col("page") / 1024)
    levels = skew.shift(levels, ["scope_id"], ["page"], {"prev": F.col("page")}, -1, band)
    start = F.when(F.col("prev").isNull() | (F.col("prev") != F.col("page") - 1), F.col("page"))
    runs = skew.running(levels, ["scope_id"], ["page"], {"first_page": ("max", start)}, band)
    return picked.join(runs.select("scope_id", "page", "first_page"), ["scope_id", "page"])


def page_runs(regions: DataFrame, prominent: list[str], limit: int = 2) -> DataFrame:
    """Runs of consecutive pages longer than the limit, per scope."""
    return page_run_members(regions, prominent).groupBy("scope_id", "first_page").agg(
        F.max("page").alias("last_page"), F.count(F.lit(1)).alias("region_count")).withColumn(
        "length", F.col("last_page") - F.col("first_page") + 1).where(F.col("length") > limit)


def surface_identity(states: DataFrame, shapes: DataFrame) -> DataFrame:
    """Requested, applied and effective regions agree, and each has the shapes its topology allows.

    ``states``: ``region_id, state, topology, page``; ``shapes``: ``region_id, shape_id, page``.
    """
    known = states.groupBy("region_id").agg(
        F.bool_or(F.col("state") == "requested").alias("requested"), F.bool_or(F.col("state") == "applied").alias("applied"),
        F.bool_or(F.col("state") == "effective").alias("effective"),
        F.max(F.when(F.col("state") == "effective", F.struct("topology", "page"))).alias("e"))
    seen = shapes.groupBy("region_id").agg(F.count(F.lit(1)).alias("n_shapes"), F.min("page").alias("p_lo"),
                                           F.max("page").alias("p_hi"))
    joined = known.join(seen, "region_id", "full_outer")
    n = F.coalesce("n_shapes", F.lit(0))
    wanted = F.when(F.col("e.topology") == "none", 0).otherwise(1)
    unknown = F.col("requested").isNull()
    failures = reasons(
        (unknown, "unknown_marker"),
        (~unknown & ~(F.col("requested") & F.col("applied") & F.col("effective")), "state_set_mismatch"),
        (~unknown & (n != wanted), "shape_count"),
        (~unknown & F.coalesce((F.col("p_lo") != F.col("e.page")) | (F.col("p_hi") != F.col("e.page")), F.lit(False)), "page_mismatch"))
    return joined.select("region_id", n.alias("n_shapes"), F.array_join(failures, ",").alias("failures")).where(
        F.col("failures") != "")


def elevation_ok() -> Column:
    """Shadow evidence fits the elevation class."""
    theme_off = F.coalesce(F.col("theme_ref"), F.lit(0)) == 0
    flat = ~F.col("shadow_present") & (F.col("shadow_count") == 0) & theme_off
    raised = (F.col("shadow_present") & (F.col("shadow_count") == 1) & theme_off
              & (F.col("shadow_source") == "adapter-direct"))
    return F.when(F.col("elevation_class") == "none", flat).otherwise(raised)


def component_geometry(df: DataFrame) -> DataFrame:
    """Dividers sit nearer to their own block; connectors stay behind surfaces and cross nothing."""
    bad_divider = F.exists("dividers", lambda v: F.coalesce(
        v["foreground"] | v["crosses_text"] | v["gap_above"].isNull() | v["gap_below"].isNull()
        | (v["gap_above"] >= v["gap_below"]), F.lit(True)))
    bad_connector = F.exists("connectors", lambda c: F.coalesce(
        ~c["behind_surfaces"] | ~c["clipped"] | (c["text_crossings"] != 0) | (c["interior_length"] != 0), F.lit(True)))
    found = reasons(
        ((F.col("divider_policy") == "none") & (F.size("dividers") > 0), "undeclared_divider"),
        ((F.col("wrapper_border") == "none") & (F.col("border_count") != 0), "wrapper_border"),
        (bad_divider, "divider_geometry"), (bad_connector, "connector_geometry"))
    return df.select("component_id", F.array_join(found, ",").alias("failures"))
