"""Colour policy, rendered contrast and ink measures from pixel histograms.

Histograms ``region_id, r, g, b, n`` are summed per colour before anything
else, so a region of any pixel count is reduced on the map side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as col
from ..functions import skew
from ..functions.common import py_round, reasons

EPS = 1e-9
INK_CELL = 64.0
TOKEN_KINDS = ["foreground", "surface", "border"]
# fixed values: rule ids in report order
READABILITY_RULES = ["AQ-CONTRAST-01", "AQ-LEGIBILITY-01", "AQ-HIERARCHY-01", "AQ-VISUAL-01", "AQ-PRINT-01"]
OUTCOMES = ["pass", "NOT_VERIFIED", "REVIEW_CANDIDATE", "HARD_FAIL"]


def palette_check(tokens: DataFrame, roles: DataFrame) -> DataFrame:
    """Defects of a colour policy: one row per token or role and reason.

    ``tokens``: ``token_id, kind, hex, r, g, b``; ``roles``: ``role, foreground_mode,
    foreground_ids (array), surface_id, border_id, min_ratio, preferred_ratio``.
    """
    counted = tokens.groupBy("token_id").agg(F.count(F.lit(1)).alias("n"))
    bad_tokens = tokens.join(counted, "token_id").select(
        F.lit("token").alias("entity"), F.col("token_id").alias("id"),
        F.explode(reasons(
            ((F.col("token_id") != F.trim("token_id")) | (F.col("token_id") == ""), "blank_id"),
            (F.col("n") > 1, "duplicate_id"), (~F.col("kind").isin(TOKEN_KINDS), "kind"),
            (~col.valid_hex(F.col("hex")), "hex"),
            (col.valid_hex(F.col("hex")) & ~F.upper("hex").eqNullSafe(col.rgb_to_hex("r", "g", "b")), "hex_rgb_mismatch"),
        )).alias("reason")).distinct()
    known = tokens.groupBy("token_id").agg(
        F.min("kind").alias("kind"), F.min(col.mode_of(col.luminance("r", "g", "b"))).alias("mode"))
    fore = roles.select("role", F.explode("foreground_ids").alias("token_id")).join(known, "token_id", "left").groupBy("role").agg(
        F.count(F.lit(1)).alias("n_fore"), F.countDistinct("token_id").alias("n_distinct"),
        F.bool_or(F.col("kind").isNull()).alias("unknown"), F.bool_or(F.col("kind") != "foreground").alias("wrong_kind"),
        F.bool_or(F.col("mode") == "near-black").alias("has_black"), F.bool_or(F.col("mode") == "near-white").alias("has_white"),
        F.bool_or(F.col("mode") == "other").alias("has_other"))
    side = lambda name, key: known.select(F.col("token_id").alias(key), F.col("kind").alias(name))
    dup = roles.groupBy("role").agg(F.count(F.lit(1)).alias("n_role"))
    joined = (roles.drop("foreground_ids").join(fore, "role", "left").join(dup, "role")
              .join(side("surface_kind", "surface_id"), "surface_id", "left")
              .join(side("border_kind", "border_id"), "border_id", "left"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    body = F.col("foreground_mode") == "body-near-black"
    pick = F.col("foreground_mode") == "contrast-select"
    bad_mode = (body & ~yes((F.col("n_fore") == 1) & F.col("has_black"))) | (
        pick & ~yes(F.col("has_black") & F.col("has_white") & ~F.col("has_other")))
    limits = (F.col("min_ratio") > 1) & (F.col("preferred_ratio") >= F.col("min_ratio")) & (F.col("preferred_ratio") <= 21)
    bad_roles = joined.select(
        F.lit("role").alias("entity"), F.col("role").alias("id"),
        F.explode(reasons(
            (F.col("n_role") > 1, "duplicate_role"), (~body & ~pick, "foreground_mode"),
            (yes(F.col("unknown")) | F.col("n_fore").isNull() | (F.col("n_fore") != F.col("n_distinct")), "foreground_ids"),
            (yes(F.col("wrong_kind")), "foreground_kind"), (~yes(F.col("surface_kind") == "surface"), "surface"),
            (F.col("border_id").isNotNull() & ~yes(F.col("border_kind") == "border"), "border"),
            (~yes(limits), "thresholds"), (bad_mode, "mode_constraint"))).alias("reason")).distinct()
    return bad_tokens.unionByName(bad_roles)


def pick_colors(roles: DataFrame, tokens: DataFrame) -> DataFrame:
    """Best foreground of each role by contrast, then id; below the minimum it fails.

    ``direct_hex`` on a role, when set, must equal the chosen colour.
    """
    fore = tokens.select(F.col("token_id").alias("fore_id"), F.col("r").alias("fr"), F.col("g").alias("fg"), F.col("b").alias("fb"))
    surf = tokens.select(F.col("token_id").alias("surface_id"), F.col("r").alias("sr"), F.col("g").alias("sg"), F.col("b").alias("sb"))
    options = roles.select("role", "surface_id", "min_ratio", "direct_hex", F.explode("foreground_ids").alias("fore_id"))
    rated = options.join(fore, "fore_id").join(surf, "surface_id").withColumn(
        "ratio", col.contrast(("fr", "fg", "fb"), ("sr", "sg", "sb")))
    best = rated.groupBy("role").agg(
        F.min(F.struct((-F.col("ratio")).alias("neg"), "fore_id", "ratio", "fr", "fg", "fb")).alias("m"),
        F.first("min_ratio").alias("min_ratio"), F.first("direct_hex").alias("direct_hex"))
    chosen = col.rgb_to_hex(F.col("m.fr"), F.col("m.fg"), F.col("m.fb"))
    drift = F.col("direct_hex").isNotNull() & (F.upper("direct_hex") != chosen)
    return best.select("role", F.col("m.fore_id").alias("foreground_id"), chosen.alias("foreground_hex"),
                       py_round(F.col("m.ratio"), 6).alias("ratio"),
                       F.when(F.col("m.ratio") + EPS < F.col("min_ratio"), "below_minimum").when(drift, "direct_color_drift")
                       .otherwise("pass").alias("status"))


def color_check(samples: DataFrame) -> DataFrame:
    """Measured sample pairs against role thresholds and expected colours.

    ``samples``: ``sample_id``, measured ``fr..fb`` and ``sr..sb``, expected ``efr..esb``,
    ``min_ratio, preferred_ratio, foreground_mode``.
    """
    fore, surf = ("fr", "fg", "fb"), ("sr", "sg", "sb")
    lum_f, lum_s = col.luminance(*fore), col.luminance(*surf)
    ratio = col.ratio_of(lum_f, lum_s)
    mode = col.mode_of(lum_f)
    df, ds = col.channel_distance(fore, ("efr", "efg", "efb")), col.channel_distance(surf, ("esr", "esg", "esb"))
    minimum = ratio + EPS >= F.col("min_ratio")
    body = F.col("foreground_mode") == "body-near-black"
    found = reasons((~minimum, "insufficient_rendered_contrast"),
                    (body & (mode != "near-black"), "body_foreground_not_near_black"),
                    ((df > 12) | (ds > 12), "rendered_color_drift"))
    return samples.select("sample_id", py_round(ratio, 6).alias("ratio"), mode.alias("mode"),
                          (ratio + EPS >= F.col("preferred_ratio")).alias("preferred_pass"),
                          F.greatest(df, ds).alias("max_channel_delta"), F.array_join(found, ",").alias("failures"))


def region_contrast(hist: DataFrame, regions: DataFrame) -> DataFrame:
    """Contrast of the text colour against every supported surface colour of its region.

    ``regions``: ``region_id, fr, fg, fb, tolerance``. A surface colour needs
    ``max(2, ceil(0.1 %))`` pixels of the background; when none has, all count.
    """
    colors = hist.groupBy("region_id", "r", "g", "b").agg(F.sum("n").alias("n"))
    spec = regions.select("region_id", "fr", "fg", "fb", "tolerance")
    near = col.channel_distance(("r", "g", "b"), ("fr", "fg", "fb")) <= F.col("tolerance")
    split = colors.join(spec, "region_id").withColumn("is_fore", near)
    totals = split.groupBy("region_id").agg(
        F.sum(F.when(F.col("is_fore"), F.col("n"))).alias("fore_n"), F.sum(F.when(~F.col("is_fore"), F.col("n"))).alias("back_n"))
    back = split.where(~F.col("is_fore")).join(totals.select("region_id", "back_n"), "region_id")
    enough = F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("back_n") * 0.001))
    rated = back.select("region_id", col.contrast(("fr", "fg", "fb"), ("r", "g", "b")).alias("ratio"), "n",
                        F.when(enough, F.col("n")).otherwise(F.lit(0)).alias("kept"))
    measured = rated.groupBy("region_id").agg(
        F.sum("kept").alias("kept_n"), F.min(F.when(F.col("kept") > 0, F.col("ratio"))).alias("lo_kept"), F.min("ratio").alias("lo_all"))
    some = F.col("kept_n") > 0
    weighed = rated.join(measured.select("region_id", "kept_n"), "region_id")
    ranked = skew.quantiles(weighed, ["region_id"], "ratio", F.when(some, F.col("kept")).otherwise(F.col("n")), [0.05, 0.5], F.floor("ratio"))
    ok = F.col("fore_n").isNotNull() & F.col("back_n").isNotNull()
    return spec.select("region_id").join(totals, "region_id", "left").join(measured, "region_id", "left").join(ranked, "region_id", "left").select(
        "region_id", F.when(ok, F.col("fore_n")).alias("foreground_n"),
        F.when(ok, F.when(some, F.col("kept_n")).otherwise(F.col("back_n"))).alias("background_n"),
        F.when(ok, py_round(F.when(some, F.col("lo_kept")).otherwise(F.col("lo_all")), 6)).alias("min_ratio"),
        F.when(ok, py_round(F.col("q0"), 6)).alias("p05_ratio"), F.when(ok, py_round(F.col("q1"), 6)).alias("median_ratio"),
        F.when(ok, "measured").otherwise("not_verified").alias("status"))


def grayscale_hist(hist: DataFrame) -> DataFrame:
    gray = col.luma8("r", "g", "b")
    return hist.groupBy("region_id", gray.alias("r")).agg(F.sum("n").alias("n")).select(
        "region_id", "r", F.col("r").alias("g"), F.col("r").alias("b"), "n")


def grayscale_contrast(hist: DataFrame, regions: DataFrame) -> DataFrame:
    """Region contrast after text colour and pixels are turned to 8-bit luma."""
    gray = col.luma8("fr", "fg", "fb")
    spec = regions.select("region_id", gray.alias("fr"), gray.alias("fg"), gray.alias("fb"), "tolerance")
    return region_contrast(grayscale_hist(hist), spec)


def dominant_saturation(hist: DataFrame) -> DataFrame:
    """Share of pixels that are strongly saturated or very dark."""
    high, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    saturation = F.when(high == 0, F.lit(0.0)).otherwise((high - low) / high)
    strong = (saturation >= 0.55) | (high <= 35)
    return hist.groupBy("region_id").agg(
        py_round(F.sum(F.when(strong, F.col("n")).otherwise(0)) / F.greatest(F.lit(1), F.sum("n")), 6).alias("dominant_ratio"))


def readability(regions: DataFrame) -> DataFrame:
    """Outcome of the five readability rules per artifact.

    ``regions``: ``artifact_id, region_id, contrast, min_contrast, font_size, min_font, dominant,
    max_dominant, glow, max_glow, variant_contrast, reviewed, rollout, required_evidence``;
    a null measure means it could not be taken.
    """
    def low(value: str, limit: str) -> Column:
        return F.when(F.col(value).isNull(), 1).when(F.col(value) + EPS < F.col(limit), 3).otherwise(0)

    def review(value: str, limit: str) -> Column:
        return F.when((F.col(value) > F.col(limit)) & ~F.col("reviewed"), 2).otherwise(0)

    ranks = [low("contrast", "min_contrast"), low("font_size", "min_font"), review("dominant", "max_dominant"),
             review("glow", "max_glow"), low("variant_contrast", "min_contrast")]
    per_rule = regions.groupBy("artifact_id").agg(
        F.first("rollout").alias("rollout"), F.first("required_evidence").alias("required_evidence"),
        *[F.max(r).alias(f"k{i}") for i, r in enumerate(ranks)])
    rows = F.array(*[F.struct(F.lit(n).alias("rule_id"), F.col(f"k{i}").alias("k")) for i, n in enumerate(READABILITY_RULES)])
    flat = per_rule.select("artifact_id", "rollout", "required_evidence", F.inline(rows))
    blocked = F.when(F.col("rollout") == "enforced", F.col("k") > 0).otherwise(F.col("k") == 3) | (
        F.col("required_evidence") & (F.col("k") == 1))
    return flat.select("artifact_id", "rule_id", F.element_at(F.array(*map(F.lit, OUTCOMES)), F.col("k") + 1).alias("status"),
                       blocked.alias("blocking"))


def visible_ink(pixels: DataFrame, regions: DataFrame, boxes: DataFrame, strokes: DataFrame, threshold: int = 32,
                min_confidence: float = 0.80) -> DataFrame:
    """Ink box of a crop: pixels unlike the background, inside text boxes, outside thin strokes.

    ``pixels``: ``region_id, x, y, r, g, b``; ``regions``: ``region_id, w, h, crop_x0, crop_y0, scale``;
    ``boxes``/``strokes``: ``region_id`` and inclusive pixel edges. The background is, per
    channel, the upper median of the four corner pixels.
    """
    at_corner = F.col("x").isin(0) | (F.col("x") == F.col("w") - 1)
    at_corner = at_corner & ((F.col("y") == 0) | (F.col("y") == F.col("h") - 1))
    corner = pixels.join(regions.select("region_id", "w", "h"), "region_id").where(at_corner)
    weight = F.when(F.col("w") == 1, 2).otherwise(1) * F.when(F.col("h") == 1, 2).otherwise(1)
    corner = corner.withColumn("_k", F.explode(F.sequence(F.lit(1), weight)))
    back = corner.groupBy("region_id").agg(*[
        F.element_at(F.array_sort(F.collect_list(c)), 3).alias("bg_" + c) for c in "rgb"])  # four values per region

    def covers(df: DataFrame) -> DataFrame:
        box = df.select(F.col("region_id").alias("a_region"), *[F.col(e).cast("double").alias("a_" + e) for e in ("x0", "y0", "x1", "y1")])
        return skew.grown(skew.to_cells(box, "a_", cell_w=INK_CELL, cell_h=INK_CELL).withColumnsRenamed({"cx": "a_cx", "cy": "a_cy"}))

    # both joins keep the pixels where one shuffle by region and cell has put them
    within = ((F.col("region_id") == F.col("a_region")) & (F.col("cx") == F.col("a_cx")) & (F.col("cy") == F.col("a_cy"))
              & F.col("x").between(F.col("a_x0"), F.col("a_x1")) & F.col("y").between(F.col("a_y0"), F.col("a_y1")))
    celled = pixels.select("region_id", "x", "y", *"rgb", *[F.floor(F.col(c) / INK_CELL).alias("c" + c) for c in ("x", "y")])
    allowed = celled.join(covers(boxes), within, "left_semi").join(covers(strokes), within, "left_anti")
    allowed = skew.grown(allowed.select("region_id", "x", "y", *"rgb")).join(back, "region_id")
    delta = col.luma8(*[F.abs(F.col(c) - F.col("bg_" + c)) for c in "rgb"])
    ink = delta >= threshold
    agg = allowed.groupBy("region_id").agg(
        F.count(F.lit(1)).alias("allowed_n"), F.count_if(ink).alias("ink_n"),
        F.min(F.when(ink, F.col("x"))).alias("px0"), F.min(F.when(ink, F.col("y"))).alias("py0"),
        (F.max(F.when(ink, F.col("x"))) + 1).alias("px1"), (F.max(F.when(ink, F.col("y"))) + 1).alias("py1"))
    out = regions.join(agg, "region_id", "left")
    n, allowed_n = F.coalesce("ink_n", F.lit(0)), F.greatest(F.lit(1), F.coalesce("allowed_n", F.lit(0)))
    confidence = F.least(F.lit(1.0), n / F.greatest(F.lit(1.0), allowed_n * 0.025))
    measured = (n > 0) & (confidence + EPS >= min_confidence)
    where = [F.when(n > 0, py_round(F.col("crop_" + c) + F.col(p) / F.col("scale"), 4)).alias(e) for c, p, e in (
        ("x0", "px0", "x0"), ("y0", "py0", "y0"), ("x0", "px1", "x1"), ("y0", "py1", "y1"))]
    return out.select("region_id", n.alias("ink_n"), py_round(confidence, 6).alias("confidence"), *where,
                      F.when(measured, "measured").otherwise("indeterminate").alias("status"))


def alpha_bbox(pixels: DataFrame, threshold: int = 1) -> DataFrame:
    """Envelope of the pixels whose alpha reaches the threshold (far edges exclusive)."""
    return pixels.where(F.col("alpha") >= threshold).groupBy("region_id").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


def relative_strength(hist: DataFrame, owner: DataFrame) -> DataFrame:
    """Luma of a region against its page: clear when the mean differs or the region varies.

    ``owner`` maps ``region_id`` to ``page_id``; the page histogram is the sum of its regions.
    """
    luma = col.luma8("r", "g", "b")
    sums = hist.groupBy("region_id").agg(
        F.sum("n").alias("n"), F.sum(luma * F.col("n")).alias("s"), F.sum(luma * luma * F.col("n")).alias("q"))
    placed = sums.join(owner, "region_id")
    pages = placed.groupBy("page_id").agg(F.sum("n").alias("pn"), F.sum("s").alias("ps"))
    mean = py_round(F.col("s") / F.col("n") / 255.0, 6)
    page_mean = py_round(F.col("ps") / F.col("pn") / 255.0, 6)
    variance = py_round((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.col("n") / 65025.0, 6)
    delta = py_round(F.abs(mean - page_mean), 6)
    return placed.join(pages, "page_id").select(
        "region_id", mean.alias("mean"), page_mean.alias("page_mean"), delta.alias("delta"), variance.alias("variance"),
        F.when((delta >= 0.01) | (variance >= 0.0005), "pass").otherwise("review").alias("status"))


def binarize_stats(hist: DataFrame, threshold: int) -> DataFrame:
    """One-bit counts, ink share and mean of the 8-bit luma of each region."""
    gray = col.luma8("r", "g", "b")
    n = F.col("n")
    return hist.groupBy("region_id").agg(
        F.sum(n).alias("pixel_n"), F.sum(F.when(gray >= threshold, n).otherwise(0)).alias("white_n"),
        py_round(F.sum(F.when(gray < 245, n).otherwise(0)) / F.sum(n), 6).alias("nonwhite_ratio"),
        py_round(F.sum(gray * n) / F.sum(n), 4).alias("gray_mean"))


def half_scale(width: Column, height: Column) -> list[Column]:
    """Width and height of an image at half its scale, at least one pixel."""
    return [F.greatest(F.lit(1), F.floor(width / 2)).alias("half_width"), F.greatest(F.lit(1), F.floor(height / 2)).alias("half_height")]


def readback_compare(stored: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Stored measurements that differ from recomputed ones, or exist on one side only."""
    values = [c for c in stored.columns if c not in keys]
    a = stored.select(*keys, F.struct(*values).alias("was"))
    b = now.select(*keys, F.struct(*values).alias("is"))
    both = a.join(b, keys, "full_outer")
    return both.where(~F.col("was").eqNullSafe(F.col("is"))).select(
        *keys, F.when(F.col("was").isNull(), "not_stored").when(F.col("is").isNull(), "not_measured")
        .otherwise("measurement_drift").alias("reason"))
