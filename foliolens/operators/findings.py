"""Findings: identity, precedence, coalescing, sampling, review answers and roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import skew
from ..functions.common import first_reason, multiset_digest, py_round, reasons

STATUS_ORDER = ["pass", "review", "unsupported", "fail"]
ARTIFACT_ORDER = ["pass", "unsupported", "review", "unsupported", "fail"]
# fixed values: rules whose findings are review candidates
REVIEW_RULES = [
    "short_final_line_candidate", "split_inside_word_candidate", "manual_break_anomaly_candidate",
    "automatic_wrap_anomaly_candidate", "cjk_glyph_or_region_appearance_anomaly_candidate",
    "deterministic_coverage_gap_candidate", "line_spacing_candidate", "content_block_spacing_candidate",
    "content_block_intra_spacing_candidate", "content_block_mapping_ambiguous",
    "content_block_vertical_association_unspecified", "badge_text_interference_candidate",
]
# fixed values: rule to repair family and operation
REPAIR_MAP = [
    ("rendered_orphan_ratio", "safe-wrap", "wrap_adjustment"),
    ("semantic_surface_area_ratio", "semantic-surface", "surface_recompose"),
    ("semantic_surface_sparse_container", "semantic-surface", "surface_recompose"),
    ("semantic_surface_consecutive_prominent_pages", "semantic-surface", "surface_recompose"),
]
SPACING_RULES = ["line_spacing_candidate", "content_block_spacing_candidate", "content_block_intra_spacing_candidate"]
CHUNK_CAP, REQUEST_CAP = 32_000, 256_000


def identity_text(names: list[str]) -> Column:
    """Canonical ``name=value`` text of the sorted fields; null differs from empty."""
    parts = [F.concat(F.lit(n + "="), F.coalesce(F.col(n).cast("string"), F.lit("~"))) for n in sorted(names)]
    return F.concat_ws("|", *parts)


def finding_id(names: list[str], prefix: str = "finding-") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(identity_text(names), 256), 1, 16))


def union_findings(sources: dict[str, DataFrame], covered: DataFrame | None = None) -> DataFrame:
    """Stack rule outputs with a source tag; drop rules another source already covers.

    ``covered``: ``source, rule`` pairs to leave out; there are no more of them than rule ids, so they go to the rows:
    dealt by source and rule, all findings of a rule would meet in one task.
    """
    tagged = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return out if covered is None else out.join(F.broadcast(covered.select("source", "rule").distinct()), ["source", "rule"], "left_anti")


def bucket_severity(findings: DataFrame, review_rules: list[str] | None = None) -> DataFrame:
    review = F.col("rule").isin(review_rules or REVIEW_RULES)
    return findings.withColumn("severity", F.when(review, "review").otherwise("hard")).withColumn(
        "bucket", F.when(review, "REVIEW_CANDIDATE").otherwise("HARD_FAIL"))


def _rank(status: Column) -> Column:
    return F.coalesce(*[F.when(status == s, i) for i, s in enumerate(STATUS_ORDER)], F.lit(0))


def rule_status(findings: DataFrame, by: list[str]) -> DataFrame:
    """Worst status of each rule: fail, unsupported, review, pass."""
    worst = F.max(_rank(F.col("status")))
    return findings.groupBy(*by).agg(F.element_at(F.array(*map(F.lit, STATUS_ORDER)), worst + 1).alias("status"),
                                     F.count_if(F.col("status") != "pass").alias("finding_count"))


def artifact_rank() -> Column:
    status, required = F.col("status"), F.coalesce(F.col("required"), F.lit(False))
    return (F.when(status == "fail", 4).when((status == "unsupported") & required, 3).when(status == "review", 2)
            .when(status == "unsupported", 1).otherwise(0))


def artifact_status(rules: DataFrame) -> DataFrame:
    """Artifact outcome with a rollup: rows for every rule, artifact and the whole corpus."""
    out = rules.rollup("artifact_id", "rule").agg(
        F.max(artifact_rank()).alias("k"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    return out.select("artifact_id", "rule", F.element_at(F.array(*map(F.lit, ARTIFACT_ORDER)), F.col("k") + 1).alias("status"),
                      "n", "level")


def set_hash(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Digest of a set of rows per group that does not depend on their order."""
    return df.select(*by, F.sha2(identity_text(names), 256).alias("_h")).groupBy(*by).agg(
        multiset_digest(F.col("_h")).alias("set_hash"), F.count(F.lit(1)).alias("n"))


def band(value: Column, step: float) -> Column:
    return py_round(value / F.lit(step), 0) * F.lit(step)


def review_key(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Grouping key of a layout review: rule, page-relative box and measure bands."""
    sized = findings.join(pages.select("artifact_id", "page", "width", "height"), ["artifact_id", "page"])
    low = F.col("rule") == "low_vertical_content_occupancy"
    return sized.select(
        *findings.columns, py_round(F.col("x0") / F.col("width"), 2).alias("nx0"), py_round(F.col("y0") / F.col("height"), 2).alias("ny0"),
        py_round(F.col("x1") / F.col("width"), 2).alias("nx1"), py_round(F.col("y1") / F.col("height"), 2).alias("ny1"),
        F.when(low, band(F.col("occupancy"), 0.05)).otherwise(band(F.col("overlap"), 2.0)).alias("band1"),
        F.when(~low, band(F.col("gutter"), 2.0)).alias("band2"))


REVIEW_KEY = ["artifact_id", "rule", "nx0", "ny0", "nx1", "ny1", "band1", "band2"]


def _grouped(keyed: DataFrame, keys: list[str], member: str) -> DataFrame:
    """First member by page then id, counts and page range of each group; keys may be null.

    Counted per page first, so a group over very many pages combines on the map side and no list is built.
    """
    paged = keyed.groupBy(*keys, "page").agg(F.min(member).alias("first"), F.count(F.lit(1)).alias("n"))
    return paged.groupBy(*keys).agg(F.min(F.struct("page", "first")).alias("f"), F.sum("n").alias("affected_count"), F.count("page").alias("affected_pages"), F.max("page").alias("last_page")).select(
        *keys, F.col("f.page").alias("page"), F.col("f.first").alias(member), "affected_count", "affected_pages", "last_page")


def coalesce_reviews(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Merge layout reviews that look the same on their pages."""
    return _grouped(review_key(pages, findings), REVIEW_KEY, "element_id")


def review_members(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Every page and element of every merged review: the groups' full membership as a table."""
    return review_key(pages, findings).select(*REVIEW_KEY, "page", "element_id").distinct()


SPACING_KEY = ["artifact_id", "rule", "k1", "k2", "k3", "band1"]


def spacing_key(issues: DataFrame) -> DataFrame:
    """Issues with their grouping key: scope, role pair and half-point gap band; relation rules have keys of their own."""
    association = F.col("rule") == "content_block_vertical_association_unspecified"
    geometry = F.col("rule") == "content_block_geometry_relation_ambiguous"
    return issues.select(
        "*", F.when(association, F.col("relation_id")).when(geometry, F.col("relation_type")).otherwise(F.col("scope")).alias("k1"),
        F.when(association | geometry, F.col("mode")).otherwise(F.col("upper_role")).alias("k2"),
        F.when(geometry, F.col("reason_code")).when(~association, F.col("lower_role")).alias("k3"),
        F.when(~association & ~geometry, band(F.coalesce("gap", F.lit(0.0)), 0.5)).alias("band1"))


def coalesce_spacing(issues: DataFrame) -> DataFrame:
    """Merge spacing reviews that share their key."""
    return _grouped(spacing_key(issues), SPACING_KEY, "element_id")


def spacing_members(issues: DataFrame) -> DataFrame:
    """Every page and element of every merged spacing review."""
    return spacing_key(issues).select(*SPACING_KEY, "page", "element_id").distinct()


def nth_position(df: DataFrame, keys: list[str], order: list[str], n: int, name: str = "nth") -> DataFrame:
    """Order position of the n-th row of each key; keys with fewer rows are absent.

    The rank filter is pushed below the shuffle, so at most n rows per key and task are moved.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    top = df.select(*keys, *order, F.row_number().over(w).alias("_rn")).where(F.col("_rn") <= n)
    return top.where(F.col("_rn") == n).select(*keys, F.struct(*order).alias(name))


def place_groups(groups: DataFrame, maximum: int, order: list[str]) -> DataFrame:
    """Each group with its rank and slot: its own rank, or ``maximum`` where it is folded into the overflow row.

    The slots are the mapping from groups to the rows of ``cap_groups``, so a folded group stays known.
    """
    w = Window.partitionBy("artifact_id")
    ranked = groups.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("groups", F.count(F.lit(1)).over(w))
    folded = (F.col("groups") > maximum) & (F.col("rank") >= maximum)
    return ranked.withColumn("slot", F.when(folded, F.lit(maximum)).otherwise(F.col("rank"))).withColumn("folded", folded)


def cap_groups(groups: DataFrame, maximum: int, order: list[str]) -> DataFrame:
    """Keep ``maximum - 1`` groups per artifact and fold the rest into one overflow row when there are more.

    The ranked table is read once: folding is an aggregate by slot on the window's own partitioning.
    """
    first = F.min(F.struct("rank", "rule", "page", "element_id", "folded"))
    return place_groups(groups, maximum, order).groupBy("artifact_id", "slot").agg(first.alias("f"), F.sum("affected_count").alias("affected_count"), F.count(F.lit(1)).alias("group_count")).select(
        "artifact_id", F.when(F.col("f.folded"), F.lit("review_group_overflow")).otherwise(F.col("f.rule")).alias("rule"),
        F.col("f.page").alias("page"), F.col("f.element_id").alias("element_id"), "affected_count", "group_count")


def family_sample(df: DataFrame, cap: int, families: list[str]) -> DataFrame:
    """One of each family first, then the rest by page, kind and id; every row with its rank and whether it is within the cap."""
    rank = F.coalesce(*[F.when(F.col("family") == f, i) for i, f in enumerate(families)], F.lit(len(families)))
    first = F.row_number().over(Window.partitionBy("artifact_id", "family").orderBy("page", "kind", "element_id")) == 1
    rows = df.select("artifact_id", "family", "page", "kind", "element_id", F.when(first, 0).otherwise(1).alias("turn"), rank.alias("family_rank"))
    order = [F.col("turn"), F.when(F.col("turn") == 0, F.col("family_rank")).otherwise(0), F.col("page"), F.col("kind"), F.col("element_id")]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("artifact_id").orderBy(*order)))
    return ranked.select("artifact_id", "rank", "family", "page", "kind", "element_id", (F.col("rank") <= cap).alias("selected"))


def dedupe_first(df: DataFrame, order: str, content: list[str]) -> DataFrame:
    """First occurrence of each id, or of equal content where the id is missing."""
    identity = F.coalesce(F.when(F.col("id") != "", F.concat(F.lit("id:"), F.col("id"))),
                          F.concat(F.lit("sha:"), F.sha2(identity_text(content), 256)))
    row = F.struct(order, *[c for c in df.columns if c != order])
    return df.groupBy(identity.alias("_identity")).agg(F.min_by(row, F.col(order)).alias("r")).select("r.*")


def eligible_cap(df: DataFrame, cap: int) -> DataFrame:
    """Incomplete candidates stay unresolved; the first ``cap`` complete ones per artifact are eligible."""
    cut = nth_position(df.where("complete"), ["artifact_id"], ["ord"], cap, "cut")
    return df.join(cut, "artifact_id", "left").select(
        "artifact_id", "ord", F.when(~F.col("complete"), "projection_incomplete").when(
            F.col("cut").isNull() | (F.struct("ord") <= F.col("cut")), "eligible").otherwise("candidate_limit_exceeded").alias("status"))


def project_candidates(candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """Measurements and missing information a reviewer needs, by candidate type.

    ``candidates``: ``candidate_id, rule, artifact_id, page, overlap, first_id, second_id, has_bbox,
    line_ids, units, has_roles, has_relationship``; ``regions`` may carry ``source_order``, their ids are unique in an artifact.
    """
    def side(p: str) -> DataFrame:
        return regions.select("artifact_id", F.col("region_id").alias(p + "id"), *[F.col(e).alias(p + e) for e in geo.EDGES],
                              F.col("source_order").alias(p + "order"), F.col("known_occlusion").alias(p + "occ"))

    a, b = "first_", "second_"
    # only overlapping candidates are measured, so only they are dealt by region, with their keys alone; the others stay where they are
    measured = (F.col("rule") == "unclassified_source_overlap_or_gutter") & (F.col("overlap") > 0)
    needed = candidates.where(measured).select("artifact_id", "candidate_id", "rule", "overlap", "first_id", "second_id")
    needed = needed.join(side(a), ["artifact_id", "first_id"], "left").join(side(b), ["artifact_id", "second_id"], "left")
    joined = needed.unionByName(candidates.where(~F.coalesce(measured, F.lit(False))), allowMissingColumns=True)
    area = geo.intersection_area(a, b)
    smaller = F.least(geo.area(a), geo.area(b))
    kind = F.when(F.col("rule") == "unclassified_source_overlap_or_gutter", "source_overlap").when(
        F.col("rule").isin(SPACING_RULES), "measured_spacing")
    overlap, spacing = kind == "source_overlap", kind == "measured_spacing"
    gone_a, gone_b = F.col(a + "x0").isNull(), F.col(b + "x0").isNull()
    reason = F.when(kind.isNull(), "unsupported_candidate_type").when(
        overlap & ~F.coalesce(F.col("overlap") > 0, F.lit(False)), "non_overlap_candidate").when(
        overlap & (gone_a | gone_b), "member_geometry_missing")
    lines_needed = F.col("rule") == "line_spacing_candidate"
    missing = F.when(overlap, reasons(
        (F.col(a + "order").isNull() | F.col(b + "order").isNull(), "source_stacking_order"), (F.lit(True), "rendered_stacking_order"),
        (F.col(a + "occ").isNull() & F.col(b + "occ").isNull(), "known_occlusion"))).otherwise(reasons(
            (F.col("page").isNull(), "page"), (~F.col("has_bbox"), "spacing_bbox"), (F.col("first_id").isNull(), "source_shape_ids"),
            (lines_needed & F.col("line_ids").isNull(), "pdf_line_ids"), (~F.col("units").eqNullSafe("pt"), "explicit_units_pt"),
            (~F.col("has_roles"), "roles"), (~F.col("has_relationship"), "relationship")))
    live = reason.isNull()
    return joined.select(
        "artifact_id", "candidate_id", kind.alias("candidate_type"), F.when(live & overlap, py_round(area, 3)).alias("overlap_area"),
        F.when(live & overlap & (smaller > 0), py_round(area / smaller, 6)).alias("overlap_ratio"),
        F.when(live, F.array_join(missing, ",")).alias("missing_information"),
        (live & (overlap | (F.size(missing) == 0))).alias("complete"), reason.alias("reason"))


def select_pages(pages: DataFrame, selected: DataFrame, maximum: int) -> DataFrame:
    """Pages to review: selected ones in order up to the cap; the rest carry a skip reason."""
    flagged = pages.select("artifact_id", "page").join(
        selected.select("artifact_id", "page").distinct().withColumn("sel", F.lit(True)), ["artifact_id", "page"], "left")
    chosen = flagged.where("sel")
    cut = nth_position(chosen, ["artifact_id"], ["page"], maximum, "cut")
    return flagged.join(cut, "artifact_id", "left").select("artifact_id", "page", first_reason(
        (F.col("sel").isNull(), "not_selected"), (F.coalesce(F.struct("page") > F.col("cut"), F.lit(False)), "max_pages"),
        default="judged").alias("outcome"))


def select_candidates(candidates: DataFrame, selected: DataFrame, maximum: int) -> DataFrame:
    """Candidate calls in order: unselected pages, the call cap, then missing boxes are skipped."""
    flagged = candidates.join(selected.select("artifact_id", "page").distinct().withColumn("sel", F.lit(True)), ["artifact_id", "page"], "left")
    cut = nth_position(flagged.where(F.col("sel") & F.col("has_bbox")), ["artifact_id"], ["ord"], maximum, "cut")
    return flagged.join(cut, "artifact_id", "left").select("artifact_id", "ord", first_reason(
        (F.col("sel").isNull(), "page_not_selected"), (F.coalesce(F.struct("ord") > F.col("cut"), F.lit(False)), "max_candidate_calls"),
        (~F.col("has_bbox"), "no_page_bbox"), default="called").alias("outcome"))


def pack_chunks(rows: DataFrame, cap: int, request_cap: int) -> DataFrame:
    """Greedy in-order packing of a request's rows into chunks of at most ``cap`` bytes.

    A request is limited to ``request_cap`` bytes, which is checked by a plain sum before its rows are gathered, so the
    ordered fold sees bounded input. The fold keeps only where chunks start; rows of a refused request all come out
    with the reason.
    """
    total = rows.groupBy("request_id").agg(F.sum("size").alias("total"), F.max("size").alias("largest"))
    judged = total.select("request_id", first_reason((F.col("total") > request_cap, "request_too_large"), (F.col("largest") > cap, "row_too_large"), default="packed").alias("status"))
    joined = rows.join(judged, "request_id")
    refused = joined.where("status <> 'packed'").select("request_id", F.col("ord").cast("long").alias("ord"), F.lit(None).cast("int").alias("chunk"), "status")
    items = joined.where("status = 'packed'").groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), F.col("size").cast("long").alias("size")))).alias("items"))
    state = "struct<used:bigint,starts:array<bigint>>"
    begin = F.struct(F.lit(None).cast("long").alias("used"), F.array().cast("array<bigint>").alias("starts")).cast(state)

    def step(acc: Column, item: Column) -> Column:
        fits = F.coalesce(acc["used"] + item["size"] <= cap, F.lit(False))
        more = F.struct((acc["used"] + item["size"]).alias("used"), acc["starts"].alias("starts")).cast(state)
        new = F.struct(item["size"].alias("used"), F.array_append(acc["starts"], item["ord"]).alias("starts")).cast(state)
        return F.when(fits, more).otherwise(new)

    packed = items.select("request_id", "items", F.aggregate("items", begin, step)["starts"].alias("starts")).select("request_id", "starts", F.explode("items.ord").alias("ord"))
    chunk = F.size(F.filter("starts", lambda s: s <= F.col("ord"))) - 1
    return packed.select("request_id", "ord", chunk.cast("int").alias("chunk"), F.lit("packed").alias("status")).unionByName(refused)


def chunk_prefix(chunks: DataFrame) -> DataFrame:
    """Sent chunks must be a non-empty prefix, and all of them when the request is resolved.

    ``chunks``: ``request_id, index`` (0..n-1), ``invoked, resolved``. A prefix is
    checked by counting: the last sent index equals the number sent minus one.
    """
    agg = chunks.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("invoked").alias("sent"), F.max(F.when(F.col("invoked"), F.col("index"))).alias("last"),
        F.bool_and("resolved").alias("resolved"))
    ok = (F.col("sent") > 0) & (F.col("last") == F.col("sent") - 1) & (~F.col("resolved") | (F.col("sent") == F.col("n")))
    return agg.select("request_id", "n", "sent", F.coalesce(ok, F.lit(False)).alias("valid"))


def answers_valid(df: DataFrame, choices: list[str]) -> DataFrame:
    """Answers need a known choice, complete probabilities in [0,1], a finite confidence and impact 0-3 or null."""
    options = F.array(*map(F.lit, sorted(choices)))
    p = F.col("probabilities")
    complete = F.coalesce((F.array_sort(F.map_keys(p)) == options) & F.forall(
        F.map_values(p), lambda v: v.isNotNull() & ~F.isnan(v) & v.between(0, 1)), F.lit(False))
    conf = F.col("confidence")
    found = reasons(
        (~F.coalesce(F.col("choice").isin(choices), F.lit(False)), "choice"),
        (F.when(F.col("needs_probabilities"), ~complete).otherwise(p.isNotNull() & ~complete), "probabilities"),
        (~F.coalesce(~F.isnan(conf) & conf.between(0, 1), F.lit(False)), "confidence"),
        (F.col("impact").isNotNull() & ~F.col("impact").isin(0, 1, 2, 3), "impact"))
    return df.select("answer_id", F.array_join(found, ",").alias("failures"))


def label_tiers(choice: Column, confidence: Column, breakage: Column, unnatural: Column, threshold: float = 0.5,
                repair_confidence: float = 0.5, intent_threshold: float = 0.5) -> Column:
    """Repair tier, then differs-from-surroundings, then the plain choice."""
    repair = choice == "repair_required"
    broken = (repair & (F.coalesce(confidence, F.lit(0.0)) >= repair_confidence)) | (F.coalesce(breakage, F.lit(0.0)) >= threshold)
    odd = repair | (F.coalesce(unnatural, F.lit(0.0)) >= min(intent_threshold, threshold))
    return (F.when(F.coalesce(broken, F.lit(False)), "repair_required").when(F.coalesce(odd, F.lit(False)), "differs_from_surroundings")
            .when(choice.isin("intended", "acceptable", "repair_required", "insufficient_information"), choice)
            .otherwise("insufficient_information"))


def branch(choice: Column) -> Column:
    return F.when(choice.isin("intended", "acceptable"), "maintain").when(choice == "repair_required", "adjust").otherwise("request_information")


def branch_decision(df: DataFrame, by: list[str]) -> DataFrame:
    """Any adjust wins over any open question, which wins over maintain."""
    rank = F.when(F.col("choice") == "repair_required", 2).when(F.col("choice").isin("intended", "acceptable"), 0).otherwise(1)
    names = F.array(*map(F.lit, ["maintain", "request_information", "adjust"]))
    return df.groupBy(*by).agg(F.element_at(names, F.max(rank) + 1).alias("decision"), F.count(F.lit(1)).alias("n"))


def criteria_disposition(df: DataFrame) -> DataFrame:
    """Per candidate: any failed criterion repairs, any uncertain stays uncertain, else accepted."""
    rank = F.when(F.col("status").isin("fail", "non_japanese_glyph_likely"), 2).when(F.col("status") == "uncertain", 1).otherwise(0)
    return df.groupBy("request_id", "candidate_id").agg(F.max(rank).alias("k"))


def request_disposition(df: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, ["accepted", "uncertain", "repair_required"]))
    per = criteria_disposition(df)
    return per.groupBy("request_id").agg(
        F.element_at(names, F.max("k") + 1).alias("disposition"), F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.col("k") == 2).alias("repairs"))


def review_coverage(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every candidate reviewed exactly once, for the same rule, page, box and render."""
    fields = ["rule", "page", *geo.EDGES, "render_sha256"]
    a = candidates.select("artifact_id", "candidate_id", F.struct(*fields).alias("c"))
    b = reviews.groupBy("artifact_id", "candidate_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*fields)).alias("r"), F.min("status").alias("status"))
    joined = a.join(b, ["artifact_id", "candidate_id"], "full_outer")
    spacing = F.col("c.rule").isin(SPACING_RULES)
    bad_status = ~F.when(spacing, F.col("status").isin("accepted", "rejected")).otherwise(F.col("status") == "accepted")
    return joined.select("artifact_id", "candidate_id", first_reason(
        (F.col("c").isNull(), "unknown_candidate"), (F.col("r").isNull(), "not_reviewed"), (F.col("n") > 1, "reviewed_twice"),
        (~F.col("c").eqNullSafe(F.col("r")), "binding_mismatch"), (bad_status, "status_not_allowed")).alias("reason")).where(
        F.col("reason").isNotNull())


def one_accepted(reviews: DataFrame) -> DataFrame:
    """Groups of alternatives that do not have exactly one accepted member. ``artifact_id, group_key, status``."""
    return reviews.groupBy("artifact_id", "group_key").agg(
        F.count_if(F.col("status") == "accepted").alias("accepted"), F.count(F.lit(1)).alias("n")).where(F.col("accepted") != 1)


EVIDENCE_ROLES = ["page_context", "viewed_contact_sheet", "region_crop"]


def disposition_overlay(raw: DataFrame, prior: DataFrame, targets: DataFrame, resolutions: DataFrame,
                        preserved: DataFrame) -> DataFrame:
    """Violations when review decisions are laid over raw findings.

    ``raw``: ``finding_id, rule, status``; ``prior``: ``finding_id, raw_id, rule, status, disposition``;
    ``targets``: ``finding_id``; ``resolutions``: ``finding_id, raw_id, verdict, roles (array)``;
    ``preserved``: ``finding_id, raw_id, disposition``.
    """
    def repeated(df: DataFrame, key: str, reason: str) -> DataFrame:
        return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
            F.col(key).alias("finding_id"), F.lit(reason).alias("reason"))

    def one_sided(a: DataFrame, b: DataFrame, reason: str) -> DataFrame:
        left = a.join(b, "finding_id", "left_anti").select("finding_id", F.lit(reason).alias("reason"))
        return left.unionByName(b.join(a, "finding_id", "left_anti").select("finding_id", F.lit(reason).alias("reason")))

    mapped = prior.select(F.col("raw_id").alias("finding_id"))
    unknown = prior.where(F.col("disposition") == "unknown").select("finding_id")
    rest = prior.join(targets, "finding_id", "left_anti")
    was = prior.select("finding_id", F.col("raw_id").alias("p_raw"), F.col("rule").alias("p_rule"), F.col("status").alias("p_status"),
                       F.col("disposition").alias("p_disposition"))
    now = raw.select(F.col("finding_id").alias("p_raw"), F.col("rule").alias("r_rule"), F.col("status").alias("r_status"))
    drift = was.join(now, "p_raw").where(
        ~F.col("p_rule").eqNullSafe(F.col("r_rule")) | ~F.col("p_status").eqNullSafe(F.col("r_status"))).select(
        "finding_id", F.lit("prior_raw_mapping_changed").alias("reason"))
    solved = resolutions.join(was, "finding_id", "left").select("finding_id", F.explode(reasons(
        (F.col("verdict") != "intentional_normal", "target_not_resolved_as_normal"),
        (~F.col("raw_id").eqNullSafe(F.col("p_raw")), "original_current_mapping_changed"),
        (F.size("roles") < 3, "insufficient_resolution_evidence"),
        (F.size(F.array_except(F.array(*map(F.lit, EVIDENCE_ROLES)), F.col("roles"))) > 0, "resolution_evidence_roles_missing"))).alias("reason"))
    kept = preserved.join(was, "finding_id", "left").where(
        ~F.col("disposition").isin("intentional", "repaired") | ~F.col("disposition").eqNullSafe(F.col("p_disposition"))
        | ~F.col("raw_id").eqNullSafe(F.col("p_raw"))).select("finding_id", F.lit("preserved_prior_mapping_changed").alias("reason"))
    parts = [
        repeated(prior, "raw_id", "prior_raw_finding_repeated"),
        one_sided(mapped.distinct(), raw.select("finding_id"), "prior_raw_finding_set_mismatch"), drift,
        repeated(targets, "finding_id", "duplicate_target_ids"),
        one_sided(targets.select("finding_id").distinct(), unknown, "target_coverage_mismatch"),
        repeated(resolutions, "finding_id", "duplicate_resolution_ids"),
        one_sided(resolutions.select("finding_id").distinct(), targets.select("finding_id").distinct(), "resolution_target_coverage_mismatch"),
        solved, repeated(preserved, "finding_id", "duplicate_preserved_ids"),
        one_sided(preserved.select("finding_id").distinct(), rest.select("finding_id"), "preserved_prior_coverage_mismatch"), kept]
    return reduce(lambda a, b: a.unionByName(b), parts)


def applicability(artifacts: DataFrame, rules: list[str], declarations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Disposition of every common rule for every artifact; the rule list is fixed and explodes per artifact.

    ``declarations``: ``artifact_id, rule_id, applicability``; ``evidence``: ``artifact_id, rule_id, rule_status, path, sha256, valid``.
    """
    grid = artifacts.select("artifact_id", F.explode(F.array(*map(F.lit, rules))).alias("rule_id"))
    keys = ["artifact_id", "rule_id"]
    joined = grid.join(skew.grown(declarations.withColumn("declared", F.lit(True))), keys, "left").join(skew.grown(evidence), keys, "left")
    no_handle = F.col("path").isNull() & F.col("sha256").isNull()
    verdict = first_reason(
        (F.col("declared").isNull(), "missing_applicability"), (F.col("applicability") == "not_applicable", "not_applicable"),
        (~F.col("applicability").eqNullSafe("applicable"), "invalid_applicability"),
        (~F.col("rule_status").eqNullSafe("pass"), "rule_failed"), (no_handle, "missing_evidence"),
        (F.col("path").isNull() | F.col("sha256").isNull() | ~F.coalesce(F.col("valid"), F.lit(False)), "invalid_evidence"),
        default="evidence_validated")
    return joined.select(*keys, verdict.alias("disposition")).withColumn("status", F.when(
        F.col("disposition") == "not_applicable", "NOT_APPLICABLE").when(F.col("disposition") == "evidence_validated", "pass").otherwise("fail"))


def expectation_sets(measured: DataFrame, expected: DataFrame) -> DataFrame:
    """Measured and expected id/hash sets per artifact and check; order-free digests avoid collecting them."""
    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("artifact_id", "check_id").agg(multiset_digest(F.sha2(F.concat_ws("|", "item_id", "item_hash"), 256)).alias(name))
    return digest(measured, "m").join(digest(expected, "e"), ["artifact_id", "check_id"], "full_outer").select(
        "artifact_id", "check_id", F.when(F.col("m").eqNullSafe(F.col("e")), "pass").otherwise("mismatch").alias("status"))


def expectation_relations(measured: DataFrame, expected: DataFrame) -> DataFrame:
    """Measured relations within their declared bounds.

    ``expected``: ``artifact_id, relation_id, type, no_contact, no_overlap, min_gap, max_gap, max_overlap``;
    ``measured``: ``artifact_id, relation_id, type, contact, overlapping, gap, overlap``.
    """
    keys = ["artifact_id", "relation_id"]
    e = expected.withColumn("known", F.lit(True)).withColumnRenamed("type", "e_type")
    joined = e.join(measured.withColumn("seen", F.lit(True)), keys, "full_outer")
    over = lambda c: F.coalesce(c, F.lit(False))
    return joined.select(*keys, first_reason(
        (F.col("known").isNull(), "undeclared_relation"), (F.col("seen").isNull(), "relation_missing"),
        (~F.col("type").eqNullSafe(F.col("e_type")), "relation_type_mismatch"),
        (F.col("no_contact") & ~F.col("contact").eqNullSafe(F.lit(False)), "no_contact_violated"),
        (F.col("no_overlap") & ~F.col("overlapping").eqNullSafe(F.lit(False)), "no_overlap_violated"),
        (F.col("gap").isNull() | F.col("overlap").isNull(), "measurement_missing"),
        (over(F.col("gap") < F.col("min_gap")), "gap_below_contract"), (over(F.col("gap") > F.col("max_gap")), "gap_above_contract"),
        (over(F.col("overlap") > F.col("max_overlap")), "overlap_above_contract"), default="pass").alias("status"))


def expectation_counters(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Counters above their allowed maximum. ``pairs``: (counter column, limit column)."""
    found = reasons(*[(F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) > F.coalesce(F.col(m), F.lit(0))), c + "_exceeds_contract") for c, m in pairs])
    return df.select("artifact_id", F.array_join(found, ",").alias("failures"))


def profile_compare(metrics: DataFrame, profile: dict[str, float]) -> DataFrame:
    """Measured metrics below the declared profile block; nothing comparable is a review."""
    failed = [F.coalesce(F.col(k) < F.lit(float(v)), F.lit(False)) for k, v in profile.items()]
    known = [F.col(k).isNotNull() for k in profile]
    names = F.array_compact(F.array(*[F.when(c, F.lit(k)) for c, k in zip(failed, profile)]))
    return metrics.select("artifact_id", F.array_join(names, ",").alias("below"),
                          F.when(F.size(names) > 0, "block").when(reduce(lambda a, b: a | b, known), "pass").otherwise("review").alias("status"))


def layer_rollup(rows: DataFrame) -> DataFrame:
    """Status per layer and per artifact; any block blocks. ``artifact_id, layer, entry_id, status``."""
    out = rows.groupingSets([["artifact_id", "layer"], ["artifact_id"]], "artifact_id", "layer").agg(
        F.bool_or(F.col("status") == "block").alias("b"), F.bool_or(F.col("status") == "review").alias("r"), F.count(F.lit(1)).alias("n"))
    return out.select("artifact_id", "layer", F.when(F.col("b"), "block").when(F.col("r"), "review").otherwise("pass").alias("status"), "n")


def merge_scans(rule_scan: DataFrame, source_scan: DataFrame, surface_hard: DataFrame) -> DataFrame:
    """Recount hard and review issues over three scans; surface failures are always hard."""
    every = rule_scan.select("artifact_id", "severity", "bucket").unionByName(source_scan.select("artifact_id", "severity", "bucket")).unionByName(
        surface_hard.select("artifact_id", F.lit("hard").alias("severity"), F.col("bucket")))
    hard = (F.col("severity") == "hard") | F.coalesce(F.col("bucket") == "HARD_FAIL", F.lit(False))
    return every.groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("issue_count"), F.count_if(hard).alias("hard_count"),
        F.count_if(~hard & (F.col("severity") == "review")).alias("review_count")).withColumn(
        "status", F.when(F.col("hard_count") > 0, "block").when(F.col("review_count") > 0, "review").otherwise("pass"))


def repair_plan(findings: DataFrame) -> DataFrame:
    """Repair family and operation of each hard finding, with its issue digest."""
    family = F.coalesce(*[F.when(F.col("rule") == r, F.lit(f)) for r, f, _ in REPAIR_MAP])
    operation = F.coalesce(*[F.when(F.col("rule") == r, F.lit(o)) for r, _, o in REPAIR_MAP])
    return findings.select(
        F.sha2(identity_text(["element_id", "rule", "page", "frame_id"]), 256).alias("issue_id"), "element_id", "rule",
        F.coalesce(family, F.lit("unsupported")).alias("family"), operation.alias("operation"))


def relation_rollup(relations: DataFrame, required: DataFrame) -> DataFrame:
    """Outcome of an artifact's inset relations. ``required``: ``artifact_id, inset_required``."""
    inset = relations.where(F.col("type").isin("content_inset", "nested_inset")).groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("status") == "pass").alias("all_pass"), F.bool_or(F.col("status") == "review").alias("any_review"))
    return required.join(inset, "artifact_id", "left").select("artifact_id", F.coalesce("n", F.lit(0)).alias("n"), first_reason(
        (F.col("inset_required") & F.col("n").isNull(), "block"), (F.col("n").isNull(), "not_applicable"), (F.col("all_pass"), "pass"),
        (F.col("any_review"), "indeterminate"), default="block").alias("status"))


def criteria_flags(criteria: DataFrame) -> DataFrame:
    """Artifacts whose declared criteria name a table, cell or inset. ``artifact_id, id, criterion_id``."""
    ident = F.lower(F.trim(F.coalesce("criterion_id", F.lit(""))))
    tokens = F.split(F.replace(ident, F.lit("_"), F.lit("-")), "-")
    hit = (F.upper(F.trim(F.coalesce("id", F.lit("")))).isin("VIS-02", "VIS-03")
           | F.arrays_overlap(tokens, F.array(*map(F.lit, ["table", "cell", "inset", "insets"]))) | F.contains(ident, F.lit("vertical-inset")))
    return criteria.groupBy("artifact_id").agg(F.bool_or(hit).alias("inset_required"))
