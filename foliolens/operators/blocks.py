"""Content blocks: sibling spacing, ancestry and declared relations.

Blocks carry ``block_id, parent_id, owner_id, page, role, line_height`` and a
box; a missing box or page means that the block has no measured rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import skew
from ..functions.common import prefixed, py_round, reasons
from ..session import cut_lineage

EPS = 1e-9
# fixed values: default minimum gaps in points by role
DEFAULT_GAPS = {
    "inter_block": {"heading_band": 2.0, "session_heading": 4.0, "heading": 4.0, "role_label": 4.0, "label": 4.0,
                    "body": 6.0, "table": 6.0, "surface": 2.0, "block": 4.0, "text": 4.0, "*": 2.0},
    "intra_block": {"heading_band": 0.5, "session_heading": 1.0, "heading": 1.0, "role_label": 1.0, "label": 1.0,
                    "body": 1.0, "table": 0.5, "surface": 0.5, "block": 1.0, "text": 1.0, "*": 0.5},
}


def _literal_map(values: dict[str, float]) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in (kv[0], float(kv[1]))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")


def minimum_gap(policy: dict, scope: Column, upper: Column, lower: Column) -> Column:
    """Required gap of a role pair: pair, lower, upper, ``*``, scope scalar, global scalar, default.

    ``policy``: ``{"scopes": {scope: {key: gap}}, "scalars": {scope: gap}, "global": gap}``.
    """
    def for_scope(name: str) -> Column:
        declared = _literal_map(policy.get("scopes", {}).get(name, {}))
        keys = [F.concat(upper, F.lit("->"), lower), F.concat(upper, F.lit(":"), lower), lower, upper, F.lit("*")]
        steps = [F.when(declared[k].isNotNull(), F.greatest(F.lit(0.0), declared[k])) for k in keys]
        for scalar in (policy.get("scalars", {}).get(name), policy.get("global")):
            if scalar is not None:
                steps.append(F.lit(max(0.0, float(scalar))))
        defaults = DEFAULT_GAPS["inter_block" if name == "inter_block" else "intra_block"]
        table = _literal_map(defaults)
        return F.coalesce(*steps, table[lower], table[upper], F.lit(defaults["*"]))

    return F.when(scope == "inter_block", for_scope("inter_block")).otherwise(for_scope("intra_block"))


def gap_lookup(pairs: DataFrame, policy: dict) -> DataFrame:
    return pairs.withColumn("min_gap", minimum_gap(policy, F.col("scope"), F.col("upper_role"), F.col("lower_role")))


def largest_gap(policy: dict) -> float:
    values = [v for m in policy.get("scopes", {}).values() for v in m.values()]
    values += [v for v in policy.get("scalars", {}).values()] + [policy.get("global") or 0.0]
    values += [v for m in DEFAULT_GAPS.values() for v in m.values()]
    return float(max(values))


def closure(blocks: DataFrame) -> DataFrame:
    """(block, ancestor) pairs of the parent forest, of any depth and cycle safe.

    Path doubling: every round extends only the pairs of the last round by all
    pairs known so far, so a chain of a thousand needs ten rounds and no pair is
    derived from older ones again; it ends when a round adds nothing. The result
    has a row per block and ancestor. Rounds are checkpointed, which keeps the
    plan short and survives lost executors.
    """
    reached = cut_lineage(blocks.where(F.col("parent_id").isNotNull()).select(
        F.col("block_id").alias("node"), F.col("parent_id").alias("ancestor")).distinct())
    fresh = reached
    while not fresh.isEmpty():
        step = reached.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("further"))
        longer = fresh.join(step, "ancestor").select("node", F.col("further").alias("ancestor")).distinct()
        fresh = cut_lineage(longer.join(reached, ["node", "ancestor"], "left_anti"))
        reached = cut_lineage(reached.unionByName(fresh))
    return reached


def sibling_spacing(blocks: DataFrame, policy: dict, exclude_roles: list[str] | None = None,
                    declared: DataFrame | None = None, ancestry: DataFrame | None = None,
                    min_x_overlap: float = 0.5) -> DataFrame:
    """Siblings above one another that overlap or stand closer than their minimum gap.

    Each box is stretched by its own largest possible gap before the grid
    join, so only neighbours are paired even under one huge parent.
    ``declared`` (first_id, second_id) and ``ancestry`` (node, ancestor) pairs are left out.
    """
    bound = largest_gap(policy)
    reach = F.greatest(F.lit(bound), F.coalesce("line_height", F.lit(0.0)))
    keep = blocks.where(F.col("x0").isNotNull() & ~F.coalesce(F.col("role").isin(exclude_roles or []), F.lit(False)))
    side = keep.select(
        F.coalesce(F.col("parent_id").cast("string"), F.lit("")).alias("parent_key"), "page", "block_id",
        "parent_id", "owner_id", "surface_owner", "role", F.coalesce("line_height", F.lit(0.0)).alias("lh"),
        F.col("y0").alias("top"), F.col("y1").alias("bottom"), "x0", (F.col("y0") - reach).alias("y0"), "x1",
        (F.col("y1") + reach).alias("y1"))
    keys = ["parent_key", "page"]
    first = F.struct("a_top", "a_block_id") <= F.struct("b_top", "b_block_id")
    ratio = F.greatest(F.lit(0.0), geo.overlap_x("a_", "b_")) / F.least(geo.width("a_"), geo.width("b_"))
    same_surface = F.coalesce(F.col("a_surface_owner") == F.col("b_surface_owner"), F.lit(False))
    pairs = skew.box_pairs(prefixed(side, "a_", keys), prefixed(side, "b_", keys), keys,
                           residual=first & (F.col("a_block_id") != F.col("b_block_id"))
                           & (ratio >= min_x_overlap) & ~same_surface)
    intra = F.coalesce(F.col("a_owner_id") == F.col("b_owner_id"), F.lit(False)) | F.col("a_parent_id").isNotNull()
    out = pairs.select(
        "page", F.when(intra, "intra_block").otherwise("inter_block").alias("scope"),
        F.col("a_block_id").alias("upper_id"), F.col("b_block_id").alias("lower_id"),
        F.col("a_role").alias("upper_role"), F.col("b_role").alias("lower_role"),
        (F.col("b_top") - F.col("a_bottom")).alias("gap"), ratio.alias("ratio"),
        F.greatest("a_lh", "b_lh").alias("lh"))
    if declared is not None:
        both = declared.select(F.col("first_id").alias("upper_id"), F.col("second_id").alias("lower_id"))
        both = both.unionByName(both.select(F.col("lower_id").alias("upper_id"), F.col("upper_id").alias("lower_id")))
        out = out.join(both, ["upper_id", "lower_id"], "left_anti")
    if ancestry is not None:
        up = ancestry.select(F.col("node").alias("upper_id"), F.col("ancestor").alias("lower_id"))
        down = ancestry.select(F.col("ancestor").alias("upper_id"), F.col("node").alias("lower_id"))
        out = out.join(up.unionByName(down), ["upper_id", "lower_id"], "left_anti")
    out = gap_lookup(out, policy).withColumn("effective_gap", F.greatest("min_gap", "lh"))
    rule = F.when(F.col("gap") < 0, "content_block_overlap").when(
        F.col("gap") < F.col("effective_gap"),
        F.when(F.col("scope") == "inter_block", "content_block_spacing_candidate")
        .otherwise("content_block_intra_spacing_candidate"))
    return out.withColumn("rule", rule).where(F.col("rule").isNotNull()).select(
        "rule", "page", "scope", "upper_id", "lower_id", "upper_role", "lower_role",
        py_round(F.col("gap"), 3).alias("gap"), py_round(F.col("min_gap"), 3).alias("requested_gap"),
        py_round(F.col("effective_gap"), 3).alias("effective_gap"), py_round(F.col("ratio"), 4).alias("x_overlap_ratio"))


def relation_summary(issues: DataFrame) -> DataFrame:
    """Pairs found, review candidates and smallest requirement per scope and role pair."""
    return issues.groupBy("scope", "upper_role", "lower_role").agg(
        F.count(F.lit(1)).alias("coverage_count"),
        F.count_if(F.col("rule") != "content_block_overlap").alias("candidate_count"),
        F.min("gap").alias("minimum_gap"))


def _measured(blocks: DataFrame, p: str) -> DataFrame:
    return blocks.select(F.col("block_id").alias(p + "id"), F.col("page").alias(p + "page"),
                         *[F.col(e).alias(p + e) for e in geo.EDGES], F.col("line_height").alias(p + "lh"),
                         F.col("owner_id").alias(p + "owner"), F.col("parent_id").alias(p + "parent"))


def _pair(relations: DataFrame, blocks: DataFrame) -> DataFrame:
    return relations.join(_measured(blocks, "a_").withColumnRenamed("a_id", "first_id"), "first_id", "left").join(
        _measured(blocks, "b_").withColumnRenamed("b_id", "second_id"), "second_id", "left")


def _unmapped() -> Column:
    parts = [F.col(p + c).isNull() for p in ("a_", "b_") for c in ("page", "x0")]
    return parts[0] | parts[1] | parts[2] | parts[3]


def _shared_container() -> Column:
    same = lambda c: F.when(F.col("a_" + c) == F.col("b_" + c), F.col("a_" + c))
    return F.coalesce(same("owner"), same("parent"))


def _verdict(failures: Column, satisfied: Column, review: Column | None = None,
             review_code: Column | None = None) -> list[Column]:
    code = F.when(F.size(failures) > 0, F.array_join(failures, ",")).otherwise(satisfied)
    status = F.when(F.size(failures) > 0, "fail").otherwise("pass")
    if review is not None:
        code, status = F.when(review, review_code).otherwise(code), F.when(review, "review").otherwise(status)
    return [status.alias("status"), code.alias("reason_code")]


def eval_ordered(relations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Members in order on one page keep their gaps.

    ``relations``: ``relation_id, member_ids, min_gap, same_page, no_overlap``.
    """
    member = relations.select("relation_id", "min_gap", "same_page", "no_overlap",
                              F.posexplode("member_ids").alias("pos", "block_id"))
    placed = member.join(blocks.select("block_id", "page", "x0", "y0", "y1", "line_height"), "block_id", "left")
    placed = skew.shift(placed, ["relation_id"], ["pos"],
                        {"nxt": F.struct("y0", "line_height")}, 1, F.floor(F.col("pos") / 4096))
    gap = F.col("nxt.y0") - F.col("y1")
    need = F.greatest("min_gap", F.coalesce("line_height", F.lit(0.0)), F.coalesce("nxt.line_height", F.lit(0.0)))
    has_next = F.col("nxt").isNotNull()
    summary = placed.groupBy("relation_id").agg(
        F.max("same_page").alias("same_page"), F.max("no_overlap").alias("no_overlap"),
        F.bool_or(F.col("x0").isNull() | F.col("page").isNull()).alias("unmapped"),
        (F.min("page") != F.max("page")).alias("split"),
        F.bool_or(has_next & (gap < 0)).alias("touches"), F.bool_or(has_next & (gap < need)).alias("tight"),
        F.min(F.when(has_next, gap)).alias("smallest"), F.count(F.lit(1)).alias("coverage_count"))
    ok = ~F.col("unmapped")
    one_page = ok & ~F.col("split")
    undeclared = F.col("min_gap").isNull()
    failures = reasons(
        (F.col("unmapped"), "render_mapping_missing"), (ok & F.col("split") & F.col("same_page"), "same_page"),
        (one_page & F.col("touches") & F.col("no_overlap"), "no_overlap"), (one_page & F.col("tight"), "min_gap_pt"))
    out = summary.join(relations.select("relation_id", "min_gap"), "relation_id")
    failures = F.when(undeclared, F.array(F.lit("min_gap_pt_undeclared"))).otherwise(failures)
    return out.select("relation_id", "coverage_count",
                      py_round(F.when(one_page, F.col("smallest")), 3).alias("smallest_gap"),
                      *_verdict(failures, F.lit("ordered_satisfied")))


def eval_vertical(relations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Attached pairs stay close and aligned, separate pairs keep their distance.

    ``relations``: ``relation_id, first_id, second_id, mode, max_gap, max_width_delta,
    containment_tolerance, max_edge_delta, min_gap``.
    """
    pair = _pair(relations, blocks).withColumn("container_id", _shared_container())
    box = blocks.select(F.col("block_id").alias("container_id"), *[F.col(e).alias("c_" + e) for e in geo.EDGES])
    pair = pair.join(box, "container_id", "left")
    gap = F.col("b_y0") - F.col("a_y1")
    width_delta = F.abs(geo.width("a_") - geo.width("b_"))
    edge_delta = F.least(F.abs(F.col("a_x0") - F.col("b_x0")), F.abs(F.col("a_x1") - F.col("b_x1")))
    escapes = [F.lit(0.0)]
    for p in ("a_", "b_"):
        escapes += [F.col("c_x0") - F.col(p + "x0"), F.col(p + "x1") - F.col("c_x1"),
                    F.col("c_y0") - F.col(p + "y0"), F.col(p + "y1") - F.col("c_y1")]
    overflow = py_round(F.greatest(*escapes), 3)
    held = F.col("c_x0").isNotNull() & (overflow <= F.col("containment_tolerance") + EPS)
    aligned = py_round(edge_delta, 3) <= F.col("max_edge_delta") + EPS
    missing, split = _unmapped(), F.col("a_page") != F.col("b_page")
    live = ~missing & ~split
    attached, separate = live & (F.col("mode") == "attached"), live & (F.col("mode") == "separate")
    g = py_round(gap, 3)
    p = "vertical_association_"
    failures = reasons(
        (missing, p + "render_mapping_missing"), (~missing & split, p + "same_page_mismatch"),
        (attached & (F.abs(g) > F.col("max_gap") + EPS), p + "attached_gap_exceeded"),
        (attached & (py_round(width_delta, 3) > F.col("max_width_delta") + EPS), p + "attached_width_mismatch"),
        (attached & ~F.coalesce(held | aligned, F.lit(False)), p + "attached_container_or_edge_misaligned"),
        (separate & (g + EPS < F.col("min_gap")), p + "separate_gap_insufficient"))
    return pair.select("relation_id", "mode", g.alias("gap"), py_round(width_delta, 3).alias("width_delta"),
                       py_round(edge_delta, 3).alias("edge_delta"),
                       *_verdict(failures, F.concat(F.lit(p), F.col("mode"), F.lit("_satisfied")),
                                 F.col("mode") == "unspecified", F.lit(p + "unspecified")))


def eval_anchor(relations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Gap relation on either axis, with overlap, width, edge, centre and container conditions.

    ``relations``: ``relation_id, first_id, second_id, axis, mode, shared_container, max_gap,
    min_axis_overlap, max_width_delta, max_edge_delta, max_center_delta, min_gap``.
    """
    pair = _pair(relations, blocks)
    sideways = F.col("axis") == "horizontal"

    def along(p: str) -> tuple[Column, Column, Column, Column]:
        lo = F.when(sideways, F.col(p + "y0")).otherwise(F.col(p + "x0"))
        hi = F.when(sideways, F.col(p + "y1")).otherwise(F.col(p + "x1"))
        start = F.when(sideways, F.col(p + "x0")).otherwise(F.col(p + "y0"))
        end = F.when(sideways, F.col(p + "x1")).otherwise(F.col(p + "y1"))
        return lo, hi, start, end

    alo, ahi, _, aend = along("a_")
    blo, bhi, bstart, _ = along("b_")
    gap = bstart - aend
    narrow = F.least(ahi - alo, bhi - blo)
    overlap = F.when(narrow > 0, F.greatest(F.lit(0.0), F.least(ahi, bhi) - F.greatest(alo, blo)) / narrow).otherwise(0.0)
    width_delta = py_round(F.abs((ahi - alo) - (bhi - blo)), 3)
    edge_delta = py_round(F.greatest(F.abs(alo - blo), F.abs(ahi - bhi)), 3)
    center_delta = py_round(F.abs((alo + ahi) / 2 - (blo + bhi) / 2), 3)
    shared = _shared_container().isNotNull()
    missing, split = _unmapped(), F.col("a_page") != F.col("b_page")
    live = ~missing & ~split
    attached, separate = live & (F.col("mode") == "attached"), live & (F.col("mode") == "separate")
    p = "anchor_gap_"
    failures = reasons(
        (missing, p + "render_mapping_missing"), (~missing & split, p + "same_page_mismatch"),
        (live & (F.col("shared_container") == "required") & ~shared, p + "shared_container_required"),
        (live & (F.col("shared_container") == "forbidden") & shared, p + "shared_container_forbidden"),
        (attached & (F.abs(gap) > F.col("max_gap") + EPS), p + "attached_gap_exceeded"),
        (attached & (overlap + EPS < F.col("min_axis_overlap")), p + "axis_overlap_insufficient"),
        (attached & (width_delta > F.col("max_width_delta") + EPS), p + "width_mismatch"),
        (attached & (edge_delta > F.col("max_edge_delta") + EPS), p + "edge_mismatch"),
        (attached & (center_delta > F.col("max_center_delta") + EPS), p + "center_mismatch"),
        (separate & (gap + EPS < F.col("min_gap")), p + "separate_gap_insufficient"))
    return pair.select("relation_id", "axis", "mode", py_round(F.when(live, gap), 3).alias("gap"),
                       py_round(F.when(live, overlap), 4).alias("axis_overlap"),
                       *_verdict(failures, F.concat(F.lit(p), F.col("mode"), F.lit("_satisfied")),
                                 live & (F.col("mode") == "unspecified"), F.lit(p + "unspecified")))


def _insets(outer: str, inner: str) -> dict[str, Column]:
    return {"left": py_round(F.col(inner + "x0") - F.col(outer + "x0"), 3),
            "right": py_round(F.col(outer + "x1") - F.col(inner + "x1"), 3),
            "top": py_round(F.col(inner + "y0") - F.col(outer + "y0"), 3),
            "bottom": py_round(F.col(outer + "y1") - F.col(inner + "y1"), 3)}


def _balance(inset: dict[str, Column]) -> tuple[Column, Column]:
    return (py_round(F.abs(inset["left"] - inset["right"]), 3), py_round(F.abs(inset["top"] - inset["bottom"]), 3))


def eval_inset(relations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Outer block against the union of its inner blocks.

    ``relations``: ``relation_id, outer_id, inner_ids, require_contained, containment_tolerance,
    min_left, min_right, min_top, min_bottom, balance_axes, max_balance_delta``.
    """
    inner = relations.select("relation_id", F.explode("inner_ids").alias("block_id")).join(
        blocks.select("block_id", "page", *geo.EDGES), "block_id", "left").groupBy("relation_id").agg(
        F.bool_or(F.col("x0").isNull() | F.col("page").isNull()).alias("i_missing"),
        F.min("page").alias("i_page"), F.max("page").alias("i_last"),
        *[(F.min if e in ("x0", "y0") else F.max)(e).alias("b_" + e) for e in geo.EDGES],
        F.count(F.lit(1)).alias("n_inner"))
    joined = relations.drop("inner_ids").join(inner, "relation_id").join(
        blocks.select(F.col("block_id").alias("outer_id"), F.col("page").alias("a_page"),
                      *[F.col(e).alias("a_" + e) for e in geo.EDGES]), "outer_id", "left")
    missing = F.col("i_missing") | F.col("a_x0").isNull() | F.col("a_page").isNull()
    split = (F.col("a_page") != F.col("i_page")) | (F.col("i_page") != F.col("i_last"))
    live = ~missing & ~split
    inset = _insets("a_", "b_")
    dh, dv = _balance(inset)
    p = "content_inset_"
    failures = reasons(
        (missing, p + "render_mapping_missing"), (~missing & split, p + "same_page_mismatch"),
        (live & F.col("require_contained") & (F.least(*inset.values()) < -F.col("containment_tolerance") - EPS), p + "containment"),
        *[(live & (inset[e] + EPS < F.col("min_" + e)), p + "minimum_" + e) for e in ("left", "right", "top", "bottom")],
        (live & F.col("balance_axes").isin("horizontal", "both") & (dh > F.col("max_balance_delta") + EPS), p + "balance_horizontal"),
        (live & F.col("balance_axes").isin("vertical", "both") & (dv > F.col("max_balance_delta") + EPS), p + "balance_vertical"))
    return joined.select("relation_id", "n_inner", *[F.when(live, c).alias("inset_" + n) for n, c in inset.items()],
                         *_verdict(failures, F.lit(p + "satisfied")))


def eval_nested(relations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Outer block against one inner block: contained and balanced.

    ``relations``: ``relation_id, first_id, second_id, axes, max_delta, require_contained``.
    """
    pair = _pair(relations, blocks)
    missing, split = _unmapped(), F.col("a_page") != F.col("b_page")
    live = ~missing & ~split
    inset = _insets("a_", "b_")
    dh, dv = _balance(inset)
    h, v = F.col("axes").isin("horizontal", "both"), F.col("axes").isin("vertical", "both")
    failures = reasons(
        (missing, "render_mapping_missing"), (~missing & split, "same_page"),
        (live & F.col("require_contained") & (F.least(*inset.values()) < 0), "require_contained"),
        (live & h & (dh > F.col("max_delta") + EPS), "inset_balance_horizontal"),
        (live & v & (dv > F.col("max_delta") + EPS), "inset_balance_vertical"))
    delta = F.greatest(F.when(live & h, dh), F.when(live & v, dv))
    return pair.select("relation_id", delta.alias("delta"), *_verdict(failures, F.lit("nested_inset_balanced")))


def eval_evidence(relations: DataFrame, measured: DataFrame) -> DataFrame:
    """Connector and layer relations: measured lengths, areas and order against thresholds.

    ``relations``: ``relation_id, relation_type, mode, order_required`` and the thresholds
    ``max_length, max_area, endpoint_tolerance, boundary_tolerance, min_overlap, max_overlap,
    min_front_visible, max_occluded``; ``measured``: ``relation_id, evidence_status, order_ok,
    visible_length, visible_area, endpoint_distance, boundary_distance, overlap_area, front_visible, occluded``.
    """
    joined = relations.join(measured, "relation_id", "left")
    unclear = F.coalesce(F.col("evidence_status"), F.lit("ambiguous")) == "ambiguous"
    c = F.col("relation_type") == "connector_route"
    layer = F.col("relation_type") == "layer_relation"
    ends = c & (F.col("mode") == "terminate_at_boundary")
    front = layer & (F.col("mode") == "front_of")
    wrong_order = F.col("order_required") & ~F.coalesce(F.col("order_ok"), F.lit(False))

    def over(metric: str, limit: str) -> Column:
        return F.coalesce(F.col(metric) > F.col(limit) + EPS, F.lit(False))

    def under(metric: str, limit: str) -> Column:
        return F.coalesce(F.col(metric) + EPS < F.col(limit), F.lit(False))

    failures = reasons(
        (c & wrong_order, "connector_route_source_order_contradiction"),
        (c & F.col("visible_length").isNull(), "connector_route_visible_length_missing"),
        (c & over("visible_length", "max_length"), "connector_route_visible_length_exceeded"),
        (c & F.col("visible_area").isNull(), "connector_route_visible_area_missing"),
        (c & over("visible_area", "max_area"), "connector_route_visible_area_exceeded"),
        (ends & F.col("endpoint_distance").isNull(), "connector_route_endpoint_distance_missing"),
        (ends & over("endpoint_distance", "endpoint_tolerance"), "connector_route_endpoint_tolerance"),
        (ends & F.col("boundary_distance").isNull(), "connector_route_boundary_distance_missing"),
        (ends & over("boundary_distance", "boundary_tolerance"), "connector_route_boundary_intersection"),
        (layer & F.col("overlap_area").isNull(), "layer_relation_overlap_missing"),
        (layer & under("overlap_area", "min_overlap"), "layer_relation_overlap_below_minimum"),
        (layer & over("overlap_area", "max_overlap"), "layer_relation_overlap_exceeded"),
        (front & wrong_order, "layer_relation_source_order_contradiction"),
        (front & (F.col("front_visible").isNull() | F.col("occluded").isNull()), "layer_relation_visibility_missing"),
        (front & F.col("occluded").isNotNull() & under("front_visible", "min_front_visible"), "layer_relation_front_visibility_insufficient"),
        (front & F.col("front_visible").isNotNull() & over("occluded", "max_occluded"), "layer_relation_occlusion_exceeded"))
    return joined.select("relation_id", "relation_type", *_verdict(
        failures, F.concat(F.col("relation_type"), F.lit("_satisfied")), unclear,
        F.concat(F.col("relation_type"), F.lit("_effective_evidence_unavailable"))))
