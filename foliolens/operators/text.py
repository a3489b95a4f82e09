"""Corpus text operators: rewrites, line lint, joins, widths and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import skew
from ..functions import text as tx
from ..functions.common import PAGE_KEY, first_reason, py_round, reasons

# fixed values: single characters that may not stand alone on a line
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
ORPHANS = "はがをにへとやもののでからよりまでだけしかでもまた、。！？）］】」』"
LINT_OPENING, LINT_CLOSING = "（［【「『", "）］】」』"
META_KINDS = ["scope-only", "boundary-only", "permission-only", "authority-only", "uncertainty-meta"]
CLAUSES = [("purpose", "ため"), ("recipient", "に"), ("object", "を"), ("means", "で"), ("contact_content", ""), ("action", "")]
BODY_ROLES = ["body", "bullet-list", "role-list"]


def to_lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode_outer(tx.split_lines(F.col("text"))).alias("line_no", "line"))


def with_segments(docs: DataFrame) -> DataFrame:
    """Add the flat segment array of each document, all within its row."""
    lined = docs.withColumn("lines", tx.split_lines(F.col("text")))
    fenced = F.when(F.col("text").rlike("`{3}|~{3}"), tx.fence_spans(F.col("lines"))).otherwise(F.array().cast("array<struct<lo:int,hi:int>>"))
    return lined.withColumn("spans", fenced).withColumn("segments", tx.segments(F.col("lines"), F.col("spans")))


def mark_fences(docs: DataFrame) -> DataFrame:
    """Lines with a flag for those inside a code fence."""
    lined = docs.withColumn("lines", tx.split_lines(F.col("text"))).withColumn("spans", tx.fence_spans(F.col("lines")))
    return lined.select("doc_id", "spans", F.posexplode_outer("lines").alias("line_no", "line")).select(
        "doc_id", "line_no", "line", F.exists("spans", lambda s: (s["lo"] <= F.col("line_no")) & (F.col("line_no") <= s["hi"])).alias("fenced"))


def classify_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("kind", tx.line_kind(F.col("line")))


def split_segments(docs: DataFrame) -> DataFrame:
    return with_segments(docs).select("doc_id", F.posexplode_outer("segments").alias("seg_no", "s")).select(
        "doc_id", "seg_no", F.col("s.line_no").alias("line_no"), F.col("s.protected").alias("protected"), F.col("s.text").alias("text"))


# Outer generators are used on purpose: an inner one makes the optimizer add a
# filter on the generated array below, which would compute the array twice.
def sentences(segs: DataFrame) -> DataFrame:
    """Sentences of prose segments whose sentences join back to the segment."""
    # the sentences come out of the outer generator and are filtered there, else a filter would compute them once more
    keep = [c for c in segs.columns if c not in ("protected", "text")]
    return segs.where(~F.col("protected")).select(*keep, F.posexplode_outer(tx.whole_sentences(F.col("text"))).alias("sent_no", "sentence")).where(
        F.col("sentence").isNotNull())


def judge_sentences(segs: DataFrame) -> DataFrame:
    """Rule and replacement of every sentence of a segment table."""
    return segs.where(~F.col("protected")).select("doc_id", "seg_no", F.posexplode_outer(tx.sentence_results(F.col("text"))).alias("sent_no", "r")).where(F.col("r").isNotNull()).select(
        "doc_id", "seg_no", "sent_no", F.col("r.sentence").alias("sentence"), F.col("r.result").alias("result"), F.col("r.rule").alias("rule"))


def apply_rewrites(segs: DataFrame, limit: int = tx.MAX_REWRITES) -> DataFrame:
    """Rewritten text, rules and candidate count of each prose segment."""
    judged = segs.where(~F.col("protected")).withColumn("p", tx.prose_result(tx.sentence_results(F.col("text")), F.col("text"), limit))
    return judged.select("doc_id", "seg_no", F.col("p.text").alias("text"), F.col("p.rules").alias("rules"), F.col("p.candidates").alias("candidates"))


def rewrite_documents(docs: DataFrame, mode: str = "document", limit: int = tx.MAX_REWRITES, cap: int | None = None) -> DataFrame:
    """Rewrite every document: changed, count, ordered rules, protected, new text.

    A cheap pattern skips documents in which no rule can fire, so the
    segment work is spent on the few that may change.
    """
    if cap is None:
        cap = limit if mode == "response" else tx.MAX_DOCUMENT_REWRITES
    hinted = F.col("text").rlike(tx.REWRITE_HINT)
    seg = with_segments(docs)
    none = "array<struct<text:string,rules:array<string>,candidates:int>>"
    results = F.when(hinted, F.transform("segments", lambda s: F.when(
        s["protected"] | (s["text"] == ""), F.struct(s["text"].alias("text"), F.array().cast("array<string>").alias("rules"), F.lit(0).alias("candidates"))
    ).otherwise(tx.prose_result(tx.sentence_results(s["text"]), s["text"], limit)))).otherwise(F.array().cast(none))
    work = seg.withColumn("results", results)
    work = work.withColumn("kept", tx.accepted_segments(F.transform("results", lambda r: r["candidates"]), mode, limit, cap))
    rules = F.flatten(F.transform("kept", lambda i: F.element_at("results", i + 1)["rules"]))
    joined = F.array_join(F.transform("segments", lambda s, i: F.when(
        F.array_contains("kept", i), F.element_at("results", i + 1)["text"]).otherwise(s["text"])), "")
    text = F.when(F.size("kept") > 0, joined).otherwise(F.col("text"))
    keep = [c for c in docs.columns if c != "text"]
    return work.select(*keep, F.col("text").alias("before"), text.alias("text"), rules.alias("rules"),
                       (F.exists("segments", lambda s: s["protected"]) | (F.col("text") == "")).alias("protected"))


def rewrite_report(docs: DataFrame, mode: str = "document") -> DataFrame:
    """Report per document and the gate: clean at once, or clean after applying the rewrites."""
    first = rewrite_documents(docs, mode).withColumn("changed", F.col("text") != F.col("before")).withColumnsRenamed(
        {"rules": "rules1", "protected": "protected1", "text": "final_text"}).drop("before")
    # only what changed is looked at again
    again = rewrite_documents(first.withColumn("text", F.when(F.col("changed"), F.col("final_text")).otherwise("")), mode)
    gate = F.when(~F.col("changed"), "clean").when(F.col("text") == F.col("before"), "clean_after_apply").otherwise("still_changing")
    return again.select("doc_id", "changed", F.size("rules1").alias("rewrite_count"), F.col("rules1").alias("rules"),
                        F.col("protected1").alias("protected"), F.col("final_text").alias("text"), gate.alias("gate"))


def rule_stats(report: DataFrame, dims: list[str]) -> DataFrame:
    """Rule hits by corpus slice, with subtotals."""
    hits = report.select(*dims, F.explode_outer("rules").alias("rule")).where(F.col("rule").isNotNull())
    return hits.rollup(*dims, "rule").agg(F.count(F.lit(1)).alias("hits"), F.grouping_id().alias("level"))


def classify_boundary(df: DataFrame, left: str, right: str) -> DataFrame:
    return tx.with_join(df, F.col(left), F.col(right))


def line_boundaries(lines: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """Joins of consecutive lines of one paragraph that are not planned breaks.

    ``lines``: ``frame_id, line_index, paragraph, text``; ``planned``: ``frame_id, line_index`` of
    the line before a planned break.
    """
    nxt = skew.shift(lines, ["frame_id"], ["line_index"], {"n": F.struct("paragraph", "text")}, 1, F.floor(F.col("line_index") / 4096))
    pairs = nxt.where(F.col("n.paragraph") == F.col("paragraph"))
    if planned is not None:
        pairs = pairs.join(planned.select("frame_id", "line_index").distinct(), ["frame_id", "line_index"], "left_anti")
    judged = tx.with_join(pairs, F.col("text"), F.col("n.text"))
    return judged.select("frame_id", "line_index", tx.line_hash(F.col("text")).alias("left_hash"), tx.line_hash(F.col("n.text")).alias("right_hash"),
                         "allowed", "kind", F.array_join("rule_ids", ",").alias("rule_ids"))


def boundary_status(boundaries: DataFrame) -> DataFrame:
    return boundaries.groupBy("frame_id").agg(F.count(F.lit(1)).alias("boundary_count"), F.count_if(~F.col("allowed")).alias("blocked")).withColumn(
        "status", F.when(F.col("blocked") > 0, "block").otherwise("pass"))


def break_lint(paragraphs: DataFrame) -> DataFrame:
    """Manual breaks that split what must stay together.

    ``paragraphs``: ``paragraph_id, segments`` (array of texts, null for a break).
    """
    breaks = F.filter(F.sequence(F.lit(0), F.size("segments") - 1), lambda i: F.element_at("segments", i + 1).isNull())
    whole = F.array_join("segments", "")
    rows = paragraphs.where(F.exists("segments", lambda s: s.isNull())).withColumn("tokens", tx.token_spans(whole)).withColumn(
        "brackets", F.transform("segments", tx.only_brackets)).select("paragraph_id", "segments", "tokens", "brackets", F.explode_outer(breaks).alias("break_index"))
    n = F.size("segments")
    before = lambda c: F.array_join(F.slice(c, F.lit(1), F.col("break_index")), "")
    after = lambda c: F.array_join(F.when(F.col("break_index") + 1 < n, F.slice(c, F.col("break_index") + 2, n)), "")
    # brackets are looked for once per paragraph, not in all of it for every break
    rows = rows.withColumns({"left": before("segments"), "right": after("segments"), "lb": before("brackets"), "rb": after("brackets")}).drop("segments", "brackets")
    # without blanks at the break the joined text is the paragraph itself, whose tokens are known
    blank = tx.blank_right(F.col("left")) | tx.blank_left(F.col("right"))
    at = F.length("left")
    known = F.when(~blank, tx.let(at, lambda x: F.exists("tokens", lambda t: (t["lo"] < x) & (x < t["hi"]))))
    rows = rows.where((tx.strip_right(F.col("left")) != "") & (tx.strip_left(F.col("right")) != "")).withColumn("known", known).drop("tokens")
    rows = tx.with_join(rows, F.col("left"), F.col("right"), F.col("known"), (F.col("lb"), F.col("rb")))
    has = lambda *ids: F.arrays_overlap(F.col("rule_ids"), F.array(*map(F.lit, ids)))
    circled = F.right("left", F.lit(1)).rlike(f"[{CIRCLED}]") | F.left("right", F.lit(1)).rlike(f"[{CIRCLED}]")
    rule = first_reason(
        (has("SAFE-WRAP-DIGIT-SPLIT-01"), "manual_break_number_split"),
        (has("SAFE-WRAP-URL-SPLIT-01", "SAFE-WRAP-ENGLISH-SPLIT-01"), "manual_break_word_split"), (circled, "manual_break_circled_number_split"),
        (has("SAFE-WRAP-OPENING-BRACKET-END-01", "SAFE-WRAP-FORBIDDEN-LINE-HEAD-01", "SAFE-WRAP-BRACKET-PAIR-BOUNDARY-01"), "manual_break_bracket_or_punctuation_split"),
        (has("SAFE-WRAP-STRANDED-PARTICLE-01"), "manual_break_particle_split"), default="manual_break_inside_japanese_phrase")
    # out of an outer generator, as a filter on ``allowed`` would move down and judge every break twice
    found = F.explode_outer(F.when(~F.col("allowed"), F.array(F.struct(rule.alias("rule"), "kind")))).alias("r")
    return rows.select("paragraph_id", "break_index", found).where(F.col("r").isNotNull()).select("paragraph_id", "break_index", "r.rule", "r.kind")


def line_lint(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines that break a single-line rule. ``keys`` identify the line; reads ``text`` and ``bold``."""
    t = F.col("text")
    first, last, one = F.left(t, F.lit(1)), F.right(t, F.lit(1)), F.length(t) == 1
    found = reasons(
        (first.rlike(f"[{CIRCLED}]") & F.col("bold"), "circled_number_bold"), (F.contains(t, F.lit("\ufffd")), "replacement_glyph"),
        (one & t.rlike(f"[{ORPHANS}]"), "orphan_particle_or_punctuation"), (last.rlike(f"[{LINT_OPENING}]"), "opening_bracket_at_line_end"),
        (first.rlike(f"[{LINT_CLOSING}]"), "closing_bracket_at_line_start"), (one & t.rlike(f"[{CIRCLED}]"), "circled_number_separated"),
        (F.contains(t, F.lit("\u3000")), "fullwidth_space"))
    return lines.select(*keys, F.explode_outer(found).alias("rule")).where(F.col("rule").isNotNull())


def _tokens(text: Column, following: Column) -> tuple[Column, Column]:
    return F.element_at(F.split(tx.strip_right(text), " "), -1), F.element_at(F.split(tx.strip_left(following), " "), 1)


def _fragments(text: Column, following: Column) -> Column:
    """Whether the last token of a line and the first of the next are short Latin fragments."""
    left, right = _tokens(text, following)
    return left.rlike(r"^[A-Za-z]{2,4}\z") & right.rlike(r"^[A-Za-z]{2,4}\z") & (F.length(left) + F.length(right) <= 8)


def split_words(lines: DataFrame, keys: list[str], order: list[str], band: Column) -> DataFrame:
    """Two short Latin fragments across a line end that look like one word."""
    nxt = skew.shift(lines, keys, order, {"next_text": F.col("text")}, 1, band)
    left, right = _tokens(F.col("text"), F.col("next_text"))
    return nxt.where(F.col("next_text").isNotNull()).where(_fragments(F.col("text"), F.col("next_text"))).select(
        *keys, *order, left.alias("left_token"), right.alias("right_token"))


def wrap_blocks(lines: DataFrame, pages: DataFrame, narrow_ratio: float = 0.40) -> DataFrame:
    """Blocks whose line ends are judged, with their last two lines: two lines or more, not all bold, no labelled card, no bullet, not narrow.

    ``lines`` are boxes with ``block_id, line_index, text, bold``.
    """
    key = [*PAGE_KEY, "block_id"]
    row = F.struct(F.col("line_index").alias("i"), F.col("box_id").alias("id"), "text", *geo.EDGES)
    prev = skew.shift(lines, key, ["line_index", "box_id"], {"p": row}, -1, F.floor(F.col("line_index") / 4096))
    agg = prev.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min("x0").alias("lo"), F.max("x1").alias("hi"), F.bool_and("bold").alias("all_bold"),
        F.min(F.struct("line_index", "box_id", "text", "x0")).alias("first"), F.max(F.struct("line_index", "box_id", "text", *geo.EDGES, "p")).alias("final"),
        F.min(F.when(F.col("p").isNotNull(), F.struct("line_index", "box_id", "x0"))).alias("second"))
    joined = agg.where(F.col("n") >= 2).join(pages.select(*PAGE_KEY, "width"), PAGE_KEY)
    card = (F.length(tx.strip(F.col("first.text"))) <= 12) & (F.abs(F.col("first.x0") - F.col("second.x0")) > 20)
    bullet = tx.strip_left(F.col("first.text")).rlike("^[•・-]")
    return joined.where(~(F.col("all_bold") | card | bullet | (F.col("hi") - F.col("lo") < F.col("width") * narrow_ratio))).select(*key, "width", "final")


def _union_box(a: str, b: str) -> list[Column]:
    return [f(F.col(a + e), F.col(b + e)).alias(e) for e, f in zip(geo.EDGES, (F.least, F.least, F.greatest, F.greatest), strict=True)]


def split_candidates(lines: DataFrame, pages: DataFrame, narrow_ratio: float = 0.40) -> DataFrame:
    """Two short Latin fragments across a line end of a judged block, with the box of both lines."""
    key = [*PAGE_KEY, "block_id"]
    row = F.struct(F.col("box_id").alias("id"), F.col("text").alias("next_text"), *geo.EDGES)
    nxt = skew.shift(lines, key, ["line_index", "box_id"], {"n": row}, 1, F.floor(F.col("line_index") / 4096)).where(F.col("n").isNotNull())
    found = nxt.where(_fragments(F.col("text"), F.col("n.next_text")))
    judged = wrap_blocks(lines, pages, narrow_ratio).select(*key)
    return found.join(judged, key, "left_semi").select(*key, F.col("box_id").alias("previous_id"), F.col("n.id").alias("current_id"), *_union_box("", "n."))


def short_final(lines: DataFrame, pages: DataFrame, limit: int = 4, auto_ratio: float = 0.60, narrow_ratio: float = 0.40) -> DataFrame:
    """Judged blocks that end in a very short line, with the box of the last two lines: one row for that, one for how the wrap looks."""
    joined = wrap_blocks(lines, pages, narrow_ratio)
    end, before = tx.strip(F.col("final.text")), tx.strip(F.col("final.p.text"))
    fw = F.greatest(F.lit(0.0), F.col("final.x1") - F.col("final.x0"))
    pw = F.greatest(F.lit(0.0), F.col("final.p.x1") - F.col("final.p.x0"))
    hit = ~before.rlike(r"[。！？.!?]\z") & (F.length(end) <= limit) & (F.length(before) >= max(12, limit * 2)) & (fw <= pw * 0.45)
    mode = F.when(pw >= F.col("width") * auto_ratio, "automatic_wrap_anomaly_candidate").otherwise("manual_break_anomaly_candidate")
    return joined.where(hit).select(*PAGE_KEY, "block_id", F.col("final.p.id").alias("previous_id"), F.col("final.box_id").alias("final_id"),
                                    F.explode(F.array(F.lit("short_final_line_candidate"), mode)).alias("rule"), *_union_box("final.", "final.p."))


def list_style(lines: DataFrame) -> DataFrame:
    """Circled-number lists that mix font families or weights."""
    items = lines.where(F.left("text", F.lit(1)).rlike(f"[{CIRCLED}]"))
    agg = items.groupBy(*PAGE_KEY, "block_id").agg(
        F.count(F.lit(1)).alias("n"), (F.min("font") < F.max("font")).alias("fonts"), (F.min("bold") < F.max("bold")).alias("weights")).where(F.col("n") >= 2)
    return agg.select(*PAGE_KEY, "block_id", F.explode_outer(reasons(
        (F.col("fonts"), "font_family_inconsistent"), (F.col("weights"), "font_weight_inconsistent"))).alias("rule")).where(
        F.col("rule").isNotNull())


def visible_text(items: DataFrame) -> DataFrame:
    """Which declared items become visible, and with which text.

    ``items``: ``item_id, visibility, statement_kind, constraint_reason, supported (array), explicit_text,
    explicit_supported, explicit_action_object`` and the six clause fields.
    """
    names = [c for c, _ in CLAUSES]
    present = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names]))
    unsupported = F.array_except(present, F.col("supported"))
    explicit = F.col("explicit_text").isNotNull()
    concrete = (F.col("action").isNotNull() & F.col("object").isNotNull()) | (explicit & F.coalesce("explicit_action_object", F.lit(False)))
    kept = F.col("constraint_reason").isin("safety", "legal", "contract") & concrete
    internal = F.col("visibility") == "internal"
    hidden = internal | (F.col("statement_kind").isin(META_KINDS) & ~concrete)
    composed = F.concat(F.regexp_replace(F.concat_ws("、", *[F.when(F.col(n).isNotNull(), F.concat(F.col(n), F.lit(s))) for n, s in CLAUSES]), "[。.!！?]+$", ""), F.lit("。"))
    text = F.when(~hidden, F.coalesce("explicit_text", composed))
    duplicate = items.groupBy("item_id").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    facts = (F.size(unsupported) > 0) | (explicit & ~F.coalesce("explicit_supported", F.lit(True)))
    outcome = first_reason(
        (facts, "unsupported_facts"), (F.coalesce(~tx.single_meaning(text), F.lit(False)), "more_than_one_meaning"), (F.col("repeated"), "duplicate_id"),
        (internal, "visibility_internal"), (hidden, "meta_without_concrete_action"), (F.coalesce(kept, F.lit(False)), "preserved_constraint"),
        default="source_supported_visible_text")
    shown = outcome.isin("preserved_constraint", "source_supported_visible_text")
    return items.join(duplicate, "item_id").select("item_id", outcome.alias("reason_code"), F.when(shown, text).alias("text"))


def min_line_spacing(role: Column, requested: Column) -> Column:
    """Body and list roles need at least 12 points; other roles keep what was asked for."""
    floor = F.when(role.isin(BODY_ROLES), F.lit(12.0))
    return F.greatest(requested, floor)


def pii_scan(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """E-mail and phone-like strings; columns named path and hash values are not looked at."""
    parts = []
    for c in columns:
        if c.lower() == "path":
            continue
        hits = F.when(~F.col(c).rlike(r"^[0-9a-f]{64}\z"), F.regexp_extract_all(F.col(c), F.lit(f"({PII})"), 1))
        parts.append(F.transform(hits, lambda m: F.struct(F.lit(c).alias("field"), m.alias("match"))))
    return df.select(*keys, F.explode_outer(F.flatten(F.array_compact(F.array(*parts)))).alias("h")).where(F.col("h").isNotNull()).select(*keys, "h.field", "h.match")


# digits of any script, as in full-width phone numbers
PII = r"(?:[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\+?\p{Nd}[\p{Nd} ()-]{7,}\p{Nd})"


def plan_parity(planned: DataFrame, rendered: DataFrame) -> DataFrame:
    """Frames whose rendered line hashes differ from the plan in number, order or content. ``frame_id, line_no, text``."""
    side = lambda df, n: df.select("frame_id", "line_no", tx.line_hash(F.col("text")).alias(n))
    both = side(planned, "p").join(side(rendered, "r"), ["frame_id", "line_no"], "full_outer")
    return both.groupBy("frame_id").agg(F.count("p").alias("planned_lines"), F.count("r").alias("rendered_lines"),
                                        F.count_if(~F.col("p").eqNullSafe(F.col("r"))).alias("different")).where(F.col("different") > 0)


def line_widths(lines: DataFrame, metrics: DataFrame, ratio: float = 0.90) -> DataFrame:
    """Summed glyph widths against the safe width of the frame.

    ``lines``: ``line_id, font, text, is_continuation, frame_width, margin_left, margin_right, size``;
    ``metrics``: ``font, ch, advance`` (per point of size). Characters are counted per line first,
    so the metric join sees each distinct character of a line once.
    """
    if not 0.90 <= ratio <= 0.92:
        raise ValueError("safe width ratio must be between 0.90 and 0.92")
    chars = lines.select("line_id", "font", F.explode_outer(F.split("text", "")).alias("ch")).groupBy("line_id", "font", "ch").agg(F.count(F.lit(1)).alias("n"))
    measured = chars.join(metrics, ["font", "ch"], "left").groupBy("line_id").agg(
        F.sum(F.col("n") * F.col("advance")).alias("units"), F.count_if(F.col("advance").isNull()).alias("unknown_chars"))
    joined = lines.join(measured, "line_id", "left")
    width = F.coalesce("units", F.lit(0.0)) * F.col("size")
    safe = (F.col("frame_width") - F.col("margin_left") - F.col("margin_right")) * ratio
    share = width / safe
    return joined.select("line_id", py_round(width, 4).alias("width"), py_round(safe, 4).alias("safe_width"), py_round(F.when(safe > 0, share), 4).alias("ratio"),
                         F.coalesce("unknown_chars", F.lit(0)).alias("unknown_chars"), F.array_join(reasons(
                             (safe <= 0, "SAFE-WRAP-GEOMETRY-01"), ((safe > 0) & (width > safe), "SAFE-WRAP-IMPLICIT-OVERFLOW-01"),
                             ((safe > 0) & F.col("is_continuation") & (share < 0.30), "rendered_orphan_ratio")), ",").alias("failures"))


def wrap_check(frames: DataFrame, ratio: float = 0.90) -> DataFrame:
    """Recompute the numbers of stored wrap frames.

    ``frames``: ``frame_id, status, n_rules, frame_width, margins, font_size, safe_width, line_height, total_height,
    widths, line_count, max_lines, max_height, shrink``.
    """
    positive = [F.coalesce(F.col(c) > 0, F.lit(False)) for c in ("frame_width", "font_size", "safe_width", "line_height", "total_height")]
    sane = positive[0] & positive[1] & positive[2] & positive[3] & positive[4] & F.coalesce(
        (F.size("margins") == 2) & F.forall("margins", lambda m: m >= 0) & F.forall("widths", lambda w: w >= 0), F.lit(False))
    good = (F.col("status") == "pass") & (F.col("n_rules") == 0)
    live = good & sane
    safe = (F.col("frame_width") - F.element_at("margins", 1) - F.element_at("margins", 2)) * ratio
    found = reasons(
        (~good, "AQ-SAFE-WRAP-FRAMES-01"), (good & ~sane, "SAFE-WRAP-GEOMETRY-01"), (live & (F.abs(safe - F.col("safe_width")) > 0.01), "SAFE-WRAP-GEOMETRY-01"),
        (live & F.exists("widths", lambda w: w > F.col("safe_width") + 0.01), "SAFE-WRAP-IMPLICIT-OVERFLOW-01"),
        (live & ((F.col("line_count") != F.size("widths")) | (F.col("line_count") > F.col("max_lines"))), "SAFE-WRAP-MAX-LINES-01"),
        (live & F.coalesce(F.col("total_height") > F.col("max_height") + 0.01, F.lit(False)), "SAFE-WRAP-MAX-HEIGHT-01"), (live & F.col("shrink"), "SAFE-WRAP-NO-FONT-SHRINK-01"))
    return frames.select("frame_id", F.array_join(F.array_distinct(found), ",").alias("failures"))


def replay_edits(docs: DataFrame) -> DataFrame:
    """Replay declared edits in order; each ``before`` must occur exactly once in the text it meets.

    ``docs``: ``doc_id, source, target, edits`` (array of before/after in order).
    """
    state = "struct<text:string,bad:boolean>"
    start = F.struct(F.col("source").alias("text"), F.lit(False).alias("bad")).cast(state)

    def step(acc: Column, e: Column) -> Column:
        before, after = e["before"], e["after"]
        blank = (F.length(before) == 0) | (F.length(after) == 0)
        gone = F.length(acc["text"]) - F.length(F.replace(acc["text"], before, F.lit("")))
        once = ~blank & (gone == F.length(before))
        done = F.struct(F.replace(acc["text"], before, after).alias("text"), F.lit(False).alias("bad")).cast(state)
        failed = F.struct(acc["text"].alias("text"), F.lit(True).alias("bad")).cast(state)
        return F.when(acc["bad"], acc).when(once, done).otherwise(failed)

    played = docs.withColumn("_p", F.aggregate("edits", start, step))
    return played.select("doc_id", first_reason(
        (F.size("edits") == 0, "edit_list_missing"), (F.col("_p.bad"), "edit_not_unique"), (F.col("_p.text") != F.col("target"), "target_differs"), default="pass").alias("outcome"))
