"""Evidence reconciliation: drift, coverage, chains, states, tokens and receipts.

Everything is an equi-join on full keys or a plain aggregate. Set equality is
decided by order-free digests or anti joins, never by collecting a set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import skew
from ..functions.common import first_reason, multiset_digest, reasons
from .text import PII

EPS = 1e-9
# fixed values: media types by suffix
MEDIA_TYPES = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp",
    "svg": "image/svg+xml", "html": "text/html", "htm": "text/html",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
TARGET_SUFFIXES = ["pdf", "png", "jpg", "jpeg", "webp", "svg", "html", "htm", "pptx", "docx", "xlsx", "odt", "ods"]
COMPANION_SUFFIXES = ["pptx", "docx", "xlsx", "odt", "ods", "odp", "html", "htm"]
STATES = ["repair_in_progress", "submitted", "hardening_ready", "hardened"]
ISSUE_FAMILIES = ["boundary", "containment", "relation", "spacing", "alignment", "safe-wrap", "coverage", "identity"]
STRATEGIES = {"harness_development": ["source_first_rebuild"], "deadline_delivery": ["existing_artifact_repair", "source_repair"]}
HASH = "^[0-9a-f]{64}$"
# fixed values: schema versions, the bounded repair adapter and its operations
LEDGER_SCHEMA, CANDIDATE_SCHEMA = "docs-delivery-candidate-ledger-1", "docs-delivery-candidate-1"
REPAIR_ADAPTER = "docs-local-repair-adapter-1"
REPAIR_OPERATIONS = ["geometry_adjustment", "spacing_adjustment", "alignment_adjustment", "wrap_adjustment", "coverage_adjustment", "identity_rebind"]

# fixed values: fields of a ledger entry and of a file handle, and field names that hold bodies
ENTRY_FIELDS = ["schema_version", "candidate_id", "entry_hash", "workflow_id", "task_id", "issue_family", "target_ids", "source_sha256", "artifact_before_sha256", "artifact_after_sha256",
                "before_geometry", "after_geometry", "repair", "renderer_readback", "genericization_candidate", "previous_entry_hash"]
HANDLE_FIELDS = ["path", "sha256", "size_bytes"]
BODY_FIELDS = ["text", "body", "content", "raw", "payload", "original", "rewritten", "response_text", "actual_value", "expected_value", "user", "name", "email", "phone", "address", "campaign"]


def _no(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def row_digest(names: list[str]) -> Column:
    """SHA-256 of the sorted, null-preserving JSON of the named columns."""
    return F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def media_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(table[suffix(path)], F.lit("application/octet-stream"))


def handle_hash() -> Column:
    return F.sha2(F.concat_ws("|", "path", "sha256", F.col("size_bytes").cast("string"), "media_type"), 256)


def artifact_set_id(handles: DataFrame, by: list[str]) -> DataFrame:
    """Identity of a set of (path, hash, size, type) handles, the same in any order."""
    return handles.select(*by, handle_hash().alias("_h")).groupBy(*by).agg(
        multiset_digest(F.col("_h")).alias("artifact_set_id"), F.count(F.lit(1)).alias("n"))


def drift(declared: DataFrame, current: DataFrame) -> DataFrame:
    """Missing, extra, changed and repeated files between two handle tables."""
    body = F.struct("sha256", "size_bytes", "media_type")

    def packed(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy("path").agg(F.count(F.lit(1)).alias(p + "n"), F.min(body).alias(p))

    both = packed(declared, "d").join(packed(current, "c"), "path", "full_outer")
    reason = first_reason(
        (F.col("d").isNull(), "extra"), (F.col("c").isNull(), "missing"), ((F.col("dn") > 1) | (F.col("cn") > 1), "duplicate"),
        (F.col("d.sha256") != F.col("c.sha256"), "hash_drift"), (F.col("d.size_bytes") != F.col("c.size_bytes"), "size_drift"),
        (F.col("d.media_type") != F.col("c.media_type"), "media_type_drift"))
    return both.select("path", reason.alias("reason")).where(F.col("reason").isNotNull())


def receiver_copies(manifest: DataFrame, copies: DataFrame) -> DataFrame:
    """Every source copied exactly once with equal hash, type and size."""
    body = F.struct("sha256", "size_bytes", "media_type")
    c = copies.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min(body).alias("c"))
    m = manifest.select("path", body.alias("m"))
    return m.join(c, "path", "full_outer").select("path", first_reason(
        (F.col("m").isNull(), "unknown_source"), (F.col("n").isNull(), "not_copied"), (F.col("n") > 1, "copied_twice"),
        (~F.col("m").eqNullSafe(F.col("c")), "copy_drift")).alias("reason")).where(F.col("reason").isNotNull())


def three_way_equal(handoff: DataFrame, final: DataFrame, receipts: DataFrame) -> DataFrame:
    """Paths whose hash is not the same, exactly once, in all three maps."""
    tagged = [df.select("path", "sha256", F.lit(i).alias("source")) for i, df in enumerate((handoff, final, receipts))]
    every = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    counts = [F.count_if(F.col("source") == i).alias(f"n{i}") for i in range(3)]
    agg = every.groupBy("path").agg(*counts, F.min("sha256").alias("lo"), F.max("sha256").alias("hi"))
    repeated = (F.col("n0") > 1) | (F.col("n1") > 1) | (F.col("n2") > 1)
    absent = (F.col("n0") == 0) | (F.col("n1") == 0) | (F.col("n2") == 0)
    return agg.select("path", first_reason((repeated, "duplicate_path"), (absent, "map_difference"), (F.col("lo") != F.col("hi"), "hash_difference")
                                           ).alias("reason")).where(F.col("reason").isNotNull())


def receipt_validity(entries: DataFrame) -> DataFrame:
    """First failed condition of each final-output entry.

    ``entries``: ``path, status, kind, current_sha256, artifact_sha256, source_sha256,
    current_source_sha256, final_changed, reason_text``.
    """
    text, other = F.col("kind") == "text", F.col("kind") == "non-text"
    sourced = text | (other & F.col("source_sha256").isNotNull())
    return entries.select("path", first_reason(
        (_no(F.col("status") == "pass"), "entry_not_pass"), (F.col("current_sha256").isNull(), "artifact_missing"),
        (_no(F.col("artifact_sha256") == F.col("current_sha256")), "artifact_changed"), (_no(text | other), "unknown_kind"),
        (sourced & F.col("current_source_sha256").isNull(), "source_missing"),
        (sourced & _no(F.col("source_sha256") == F.col("current_source_sha256")), "source_changed"),
        (sourced & _no(F.col("final_changed") == F.lit(False)), "final_check_not_clean"),
        (~sourced & (F.length(F.trim(F.coalesce("reason_text", F.lit("")))) < 12), "reason_too_short"), default="valid").alias("outcome"))


def reuse_decision(previous: DataFrame, now: DataFrame) -> DataFrame:
    """Reuse a stored pass only when every binding is unchanged; else the first drift in a fixed order.

    Both sides: ``scope_id, schema_version, status, scope, invalidation, authority_path, authority_sha256,
    checker_sha256, artifact_set_id, receipt_set_id``.
    """
    p = previous.select("scope_id", F.struct(*[c for c in previous.columns if c != "scope_id"]).alias("p"))
    n = now.select("scope_id", F.struct(*[c for c in now.columns if c != "scope_id"]).alias("n"))
    differs = lambda c: ~F.col("p." + c).eqNullSafe(F.col("n." + c))
    return n.join(p, "scope_id", "left").select("scope_id", first_reason(
        (F.col("p").isNull(), "not_requested"),
        (differs("schema_version") | _no(F.col("p.status") == "pass"), "reuse_record_schema_or_status_drift"),
        (F.col("n.scope").isNull(), "scope_missing"), (differs("scope"), "scope_drift"), (differs("invalidation"), "invalidation_contract_drift"),
        (F.col("n.authority_path").isNull(), "authority_missing"), (differs("authority_path"), "authority_scope_drift"),
        (differs("authority_sha256"), "authority_hash_drift"), (differs("checker_sha256"), "checker_version_drift"),
        (differs("artifact_set_id"), "artifact_scope_drift"), (differs("receipt_set_id"), "receipt_scope_drift"),
        default="reuse").alias("decision"))


def companions(declared: DataFrame, artifacts: DataFrame, targets: DataFrame) -> DataFrame:
    """First error of each declared source companion, or valid.

    ``declared``: ``set_id, ord, path, sha256, source_of``; ``artifacts``: ``set_id, path, sha256``;
    ``targets``: ``set_id, path`` (explicit rule targets).
    """
    first = declared.groupBy("set_id", "path").agg(F.min("ord").alias("first_ord"))
    own = artifacts.groupBy("set_id", "path").agg(F.min("sha256").alias("own_sha"))
    source = own.select("set_id", F.col("path").alias("source_of"), F.lit(True).alias("source_known"))
    other = first.select("set_id", F.col("path").alias("source_of"), F.lit(True).alias("source_is_companion"))
    explicit = targets.select("set_id", "path").distinct().withColumn("is_target", F.lit(True))
    joined = (declared.join(own, ["set_id", "path"], "left").join(first, ["set_id", "path"]).join(explicit, ["set_id", "path"], "left")
              .join(source, ["set_id", "source_of"], "left").join(other, ["set_id", "source_of"], "left"))
    return joined.select("set_id", "ord", "path", first_reason(
        (F.col("own_sha").isNull(), "not_declared"), (F.col("ord") > F.col("first_ord"), "duplicate"),
        (~suffix(F.col("path")).isin(COMPANION_SUFFIXES), "suffix"), (F.col("is_target").isNotNull(), "also_target"),
        (_no(F.col("sha256").rlike(HASH)), "hash_format"), (F.col("sha256") != F.col("own_sha"), "hash_mismatch"),
        (F.col("source_known").isNull() | (F.col("source_of") == F.col("path")) | (suffix(F.col("source_of")) != "pdf"), "source_of"),
        (F.col("source_is_companion").isNotNull(), "source_is_companion"), default="valid").alias("outcome"))


def quality_targets(artifacts: DataFrame, targets: DataFrame, companion_rows: DataFrame) -> DataFrame:
    """Artifacts to check: target suffix or explicit, minus companions; one invalid companion excludes nothing of its set."""
    explicit = targets.select("set_id", "path").distinct().withColumn("is_target", F.lit(True))
    clean = companion_rows.groupBy("set_id").agg(F.bool_and(F.col("outcome") == "valid").alias("ok")).where("ok").select("set_id")
    excluded = companion_rows.join(clean, "set_id", "left_semi").select("set_id", "path").distinct()
    wanted = artifacts.select("set_id", "path").join(explicit, ["set_id", "path"], "left").where(
        suffix(F.col("path")).isin(TARGET_SUFFIXES) | F.col("is_target").isNotNull())
    return wanted.join(excluded, ["set_id", "path"], "left_anti").select("set_id", "path")


def identity_consistency(records: DataFrame) -> DataFrame:
    """Runs whose records do not all carry one four-field identity."""
    ident = F.struct("contract_id", "policy_hash", "producer_run_id", "artifact_set_id")
    incomplete = F.col("contract_id").isNull() | F.col("policy_hash").isNull() | F.col("producer_run_id").isNull() | F.col("artifact_set_id").isNull()
    return records.groupBy("run_id").agg(F.min(ident).alias("lo"), F.max(ident).alias("hi"), F.bool_or(incomplete).alias("bad"), F.count(F.lit(1)).alias("n")).where(
        F.col("bad") | (F.col("lo") != F.col("hi"))).select("run_id", "n", F.when(F.col("bad"), "identity_incomplete").otherwise("identity_mismatch").alias("reason"))


def state_drift(states: DataFrame) -> DataFrame:
    """Keys whose requested, applied and effective values differ. ``frame_id, key, state, value``."""
    has = lambda s: F.bool_or(F.col("state") == s).alias("has_" + s)
    val = lambda s: F.max(F.when(F.col("state") == s, F.col("value"))).alias(s)
    names = ["requested", "applied", "effective"]
    wide = states.groupBy("frame_id", "key").agg(*[has(s) for s in names], *[val(s) for s in names])
    absent = ~(F.col("has_requested") & F.col("has_applied") & F.col("has_effective"))
    return wide.select("frame_id", "key", "requested", "applied", "effective", first_reason(
        (absent, "state_missing"), (~F.col("requested").eqNullSafe(F.col("applied")), "applied_drift"),
        (~F.col("applied").eqNullSafe(F.col("effective")), "effective_drift")).alias("reason")).where(F.col("reason").isNotNull())


def aggregate_frames(frames: DataFrame) -> DataFrame:
    """Per run: unique frame ids, all-or-none semantic tokens, one schema family, and one order-free state digest.

    ``frames``: ``run_id, frame_id, schema_version, token_ids (array or null), policy``.
    """
    unique = frames.groupBy("run_id", "frame_id").agg(F.count(F.lit(1)).alias("k")).groupBy("run_id").agg(F.max("k").alias("most"))
    body = F.sha2(F.concat_ws("|", "frame_id", F.coalesce(F.array_join("token_ids", ","), F.lit("~")), "policy"), 256)
    agg = frames.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("frame_count"), F.count("token_ids").alias("semantic_count"), F.min("schema_version").alias("s0"), F.max("schema_version").alias("s1"),
        F.min("policy").alias("p0"), F.max("policy").alias("p1"),
        F.bool_or(F.coalesce((F.size("token_ids") == 0) | (F.size(F.array_distinct("token_ids")) != F.size("token_ids")), F.lit(False))).alias("bad_tokens"),
        multiset_digest(body).alias("frames_digest"))
    mixed = (F.col("semantic_count") > 0) & (F.col("semantic_count") < F.col("frame_count"))
    semantic = F.col("semantic_count") == F.col("frame_count")
    return agg.join(unique, "run_id").select("run_id", "frame_count", "frames_digest", first_reason(
        (F.col("bad_tokens"), "token_ids_malformed"), (F.col("s0") != F.col("s1"), "schema_mix"), (mixed, "semantic_and_legacy_mix"),
        (semantic & (F.col("most") > 1), "frame_id_repeated"), (~semantic & (F.col("p0") != F.col("p1")), "policy_differs"), default="pass").alias("outcome"))


def resolve_tokens(requests: DataFrame, tokens: DataFrame) -> DataFrame:
    """Resolve requested tokens to call arguments.

    ``requests``: ``request_id, role, token_id, direct_argument, direct_value``; ``tokens``:
    ``token_id, token_role, argument, amount``.
    """
    joined = requests.join(tokens, "token_id", "left")
    uses = joined.where(F.col("argument").isNotNull()).groupBy("request_id", "argument").agg(F.count(F.lit(1)).alias("uses"))
    asked = requests.groupBy("request_id", "token_id").agg(F.count(F.lit(1)).alias("asked"))
    full = joined.join(uses, ["request_id", "argument"], "left").join(asked, ["request_id", "token_id"])
    clash = (F.col("direct_argument") == F.col("argument")) & (F.abs(F.col("direct_value") - F.col("amount")) > EPS)
    return full.select("request_id", "token_id", "argument", "amount", first_reason(
        (F.col("asked") > 1, "token_repeated"), (F.col("token_role").isNull(), "unknown_token"), (F.col("token_role") != F.col("role"), "role_drift"),
        (F.col("uses") > 1, "argument_collision"), (F.coalesce(clash, F.lit(False)), "direct_value_drift"), default="resolved").alias("outcome"))


def bundle_coverage(receipts: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Receipts cover the artifacts of a run exactly once with equal hashes. Both: ``run_id, path, sha256``."""
    r = receipts.groupBy("run_id", "path").agg(F.count(F.lit(1)).alias("n"), F.min("sha256").alias("r_sha"))
    a = artifacts.select("run_id", "path", F.col("sha256").alias("a_sha"))
    return a.join(r, ["run_id", "path"], "full_outer").select("run_id", "path", first_reason(
        (F.col("a_sha").isNull(), "unknown_artifact"), (F.col("n").isNull(), "not_covered"), (F.col("n") > 1, "covered_twice"),
        (F.col("a_sha") != F.col("r_sha"), "hash_mismatch")).alias("reason")).where(F.col("reason").isNotNull())


def entry_digest() -> Column:
    return F.sha2(F.concat_ws("~", F.col("workflow_id").cast("string"), F.col("seq").cast("string"), "payload"), 256)


def ledger_check(ledger: DataFrame, header: str = "0" * 64, band: int = 65536) -> DataFrame:
    """Broken links, tampered hashes and repeated entry ids of append-only ledgers.

    Each entry must name the hash stored by the entry before it; the first names the header.
    """
    linked = skew.shift(ledger, ["workflow_id"], ["seq"], {"last_hash": F.col("entry_hash")}, -1, F.floor(F.col("seq") / band))
    first = ledger.groupBy("workflow_id", "entry_id").agg(F.min("seq").alias("first_seq"))
    found = reasons(
        (~F.col("prev_hash").rlike(HASH) | ~F.col("entry_hash").rlike(HASH), "hash_format"),
        (F.col("prev_hash") != F.coalesce("last_hash", F.lit(header)), "chain_mismatch"),
        (F.col("entry_hash") != entry_digest(), "tampered"), (F.col("seq") > F.col("first_seq"), "duplicate_entry"))
    return linked.join(first, ["workflow_id", "entry_id"]).select("workflow_id", "seq", F.explode(found).alias("reason"))


def header_digest() -> Column:
    return F.sha2(F.concat_ws("~", F.col("workflow_id").cast("string"), F.col("task_id").cast("string"), "mode", "strategy", "source_sha256"), 256)


def ledger_headers(headers: DataFrame, workflows: DataFrame) -> DataFrame:
    """Header rows against the workflow they claim: schema, identity, source and their own hash.

    ``headers``: ``workflow_id, schema_version, task_id, mode, strategy, source_sha256, header_hash``.
    ``workflows``: ``workflow_id, task_id, mode, strategy, source_sha256``. A workflow without a header is a finding too.
    """
    names = ["task_id", "mode", "strategy", "source_sha256"]
    own = workflows.select("workflow_id", *[F.col(n).alias("w_" + n) for n in names])
    both = own.join(headers.withColumn("given", F.lit(True)), "workflow_id", "left")
    same = F.col("task_id").eqNullSafe(F.col("w_task_id")) & F.col("mode").eqNullSafe(F.col("w_mode")) & F.col("strategy").eqNullSafe(F.col("w_strategy"))
    complete = F.col("task_id").isNotNull() & F.col("mode").isNotNull() & F.col("strategy").isNotNull() & F.col("source_sha256").isNotNull()
    found = F.when(F.col("given").isNull(), F.array(F.lit("ledger_missing"))).otherwise(reasons(
        (_no((F.col("schema_version") == LEDGER_SCHEMA) & complete), "header_schema_mismatch"), (~same, "header_identity_mismatch"),
        (~F.col("source_sha256").eqNullSafe(F.col("w_source_sha256")), "header_source_drift"), (_no(F.col("header_hash") == header_digest()), "header_tampered")))
    return both.select("workflow_id", F.explode(found).alias("reason"))


def _geometry_ok(box: Column) -> Column:
    finite = F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (F.size(box) == 4) & finite & (F.get(box, F.lit(2)) >= F.get(box, F.lit(0))) & (F.get(box, F.lit(3)) >= F.get(box, F.lit(1)))


def ledger_entry_rules(entries: DataFrame, workflows: DataFrame) -> DataFrame:
    """Row rules of ledger entries, each with its own reason.

    ``entries``: ``workflow_id, seq, schema_version, task_id, source_sha256, issue_family, target_ids, before_sha256,
    after_sha256, before_box, after_box`` (arrays of four numbers), ``adapter_id, operation, producer_mutation,
    genericization_candidate`` (text, as read), ``candidate_id`` and ``core_digest`` (what the id must be).
    ``workflows``: ``workflow_id, task_id, source_sha256``.
    """
    own = workflows.select("workflow_id", F.col("task_id").alias("w_task_id"), F.col("source_sha256").alias("w_source"))
    targets = F.col("target_ids")
    sorted_ok = (F.size(targets) > 0) & (targets == F.array_sort(F.array_distinct(targets))) & F.forall(targets, lambda t: t.rlike(HASH))
    repair_ok = (F.col("adapter_id") == REPAIR_ADAPTER) & F.col("operation").isin(REPAIR_OPERATIONS) & ~F.col("producer_mutation")
    # what needs no workflow is decided before the join, so rows meet theirs without their hashes and boxes
    alone = entries.select("workflow_id", "seq", "task_id", "source_sha256", reasons(
        (_no(F.col("schema_version") == CANDIDATE_SCHEMA), "schema_mismatch"),
        (_no(F.col("issue_family").isin(ISSUE_FAMILIES)), "issue_family_unknown"), (_no(sorted_ok), "targets_not_anonymised"),
        (_no(F.col("before_sha256").rlike(HASH) & F.col("after_sha256").rlike(HASH)), "artifact_hash_invalid"),
        (_no(_geometry_ok(F.col("before_box")) & _geometry_ok(F.col("after_box"))), "geometry_invalid"), (_no(repair_ok), "repair_invalid"),
        (_no(F.col("genericization_candidate").isin("true", "false")), "genericization_flag_invalid"),
        (_no(F.col("candidate_id") == F.col("core_digest")), "candidate_identity_mismatch")).alias("_alone"))
    met = reasons((_no(F.col("task_id") == F.col("w_task_id")), "cross_task_identity"), (_no(F.col("source_sha256") == F.col("w_source")), "source_drift"))
    return alone.join(own, "workflow_id", "left").select("workflow_id", "seq", F.explode(F.concat("_alone", met)).alias("reason"))


# one string token of a JSON text: the value of a path with its name, a name with its colon, or a value
JSON_STRING = r'"(?:[^"\\]|\\.)*+"'
JSON_TOKEN = rf'("path"\s*:\s*{JSON_STRING}|{JSON_STRING}\s*:?)'


def ledger_entry_shape(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Rules on the JSON text of ledger entries: exact field names, no body field or personal data at any depth, a live readback.

    ``entries``: ``workflow_id, seq, entry``. ``files``: ``path, sha256, size_bytes`` of what is there now. An entry of the wrong
    fields or schema has no further findings. Values of ``path`` and hashes are no personal data. Names and values are told
    apart by the strings of the text in order, so depth does not matter and no document is parsed into columns.
    """
    entry = F.col("entry")
    fields = lambda c, names: F.coalesce(F.array_sort(F.json_object_keys(c)) == F.array(*map(F.lit, sorted(names))), F.lit(False))
    tokens = F.regexp_extract_all(entry, F.lit(JSON_TOKEN), 1)
    body = F.exists(tokens, lambda t: t.rlike(r":\s*\z") & F.lower(F.regexp_extract(t, r'^"(.*)"\s*:\s*\z', 1)).isin(BODY_FIELDS))
    personal = F.exists(tokens, lambda t: ~t.rlike(r':\s*\z|^"path"\s*:') & ~t.rlike('^"[0-9a-f]{64}"$') & t.rlike(PII))
    readback = F.get_json_object(entry, "$.renderer_readback")
    part = lambda n: F.get_json_object(readback, f"$.{n}")
    rows = entries.select("workflow_id", "seq", (fields(entry, ENTRY_FIELDS) & F.coalesce(F.get_json_object(entry, "$.schema_version") == CANDIDATE_SCHEMA, F.lit(False))).alias("shaped"),
                          (body | personal).alias("body"), fields(readback, HANDLE_FIELDS).alias("handle"), part("path").alias("path"), part("sha256").alias("is_sha"), part("size_bytes").alias("is_size"))
    live = files.select(F.col("path").alias("f_path"), F.col("sha256").alias("f_sha"), F.col("size_bytes").cast("string").alias("f_size"))
    both = rows.join(live, rows["path"] == live["f_path"], "left")
    same = F.startswith("path", F.lit("/")) & (F.col("is_sha") == F.col("f_sha")) & (F.col("is_size") == F.col("f_size"))
    found = F.when(~F.col("shaped"), F.array(F.lit("schema_mismatch"))).otherwise(reasons(
        (F.col("body"), "body_or_personal_data"), (~F.col("handle"), "readback_fields_mismatch"), (F.col("handle") & _no(same), "readback_drift")))
    return both.select("workflow_id", "seq", F.explode(found).alias("reason"))


def ledger_final(ledger: DataFrame, submitted: DataFrame) -> DataFrame:
    """Workflows whose last recorded hash is not the submitted artifact's. ``submitted``: ``workflow_id, sha256``."""
    last = ledger.groupBy("workflow_id").agg(F.max_by("entry_hash", "seq").alias("last_hash"))
    return submitted.join(last, "workflow_id", "left").where(~F.col("sha256").eqNullSafe(F.col("last_hash"))).select("workflow_id", "last_hash")


def transitions(events: DataFrame, band: int = 65536) -> DataFrame:
    """Each step must advance exactly one state and carry what that state needs.

    ``events``: ``task_id, seq, state_idx, has_result, has_ledger, has_receipt``. A null or unknown state is a finding,
    and so is the step after it: nothing may follow a state that is not known.
    """
    known = F.coalesce(F.col("state_idx").between(0, 3), F.lit(False))
    prev = skew.shift(events, ["task_id"], ["seq"], {"before": F.when(known, F.col("state_idx")).otherwise(-2)}, -1, F.floor(F.col("seq") / band))
    reason = first_reason(
        (~known, "unknown_state"),
        (F.col("before").isNull() & (F.col("state_idx") != 0), "first_state"),
        (F.col("state_idx") != F.coalesce(F.col("before"), F.lit(-1)) + 1, "not_one_step"),
        ((F.col("state_idx") == 1) & ~(F.col("has_result") & F.col("has_ledger")), "submission_incomplete"),
        ((F.col("state_idx") > 1) & ~F.col("has_result"), "submitted_artifact_missing"),
        ((F.col("state_idx") == 3) & ~F.col("has_receipt"), "hardening_receipt_missing"),
        ((F.col("state_idx") != 3) & F.col("has_receipt"), "hardening_receipt_premature"), default="valid")
    return prev.select("task_id", "seq", "state_idx", reason.alias("outcome"))


def strategy_rules(df: DataFrame) -> DataFrame:
    """Mode and strategy against the source, baseline and output path identities."""
    mode, strategy = F.col("mode"), F.col("strategy")
    allowed = reduce(lambda a, b: a | b, [(mode == m) & strategy.isin(s) for m, s in STRATEGIES.items()])
    base, out, src = F.col("baseline_id"), F.col("output_id"), F.col("source_id")
    return df.select("workflow_id", first_reason(
        (_no(allowed), "mode_strategy_conflict"),
        ((mode == "harness_development") & (base.isNotNull() | (out == src)), "new_artifact_required"),
        ((strategy == "existing_artifact_repair") & _no(out == base), "artifact_path_not_preserved"),
        ((strategy == "source_repair") & (base.isNotNull() | _no(out == src)), "source_path_not_preserved"), default="valid").alias("outcome"))


def mapping_coverage(mappings: DataFrame, entries: DataFrame) -> DataFrame:
    """Hardening maps each eligible entry once to a known family or a bounded extension."""
    keys = ["workflow_id", "entry_id"]
    eligible = entries.where("eligible").select(*keys).distinct().withColumn("e", F.lit(True))
    m = mappings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("family").alias("family"))
    known = F.col("family").isin(ISSUE_FAMILIES) | F.col("family").rlike("^extension:[a-z0-9][a-z0-9-]{0,62}$")
    return eligible.join(m, keys, "full_outer").select(*keys, first_reason(
        (F.col("e").isNull(), "not_eligible"), (F.col("n").isNull(), "not_mapped"), (F.col("n") > 1, "mapped_twice"),
        (_no(known), "family_unknown")).alias("reason")).where(F.col("reason").isNotNull())


def format_parity(records: DataFrame) -> DataFrame:
    """Two or more formats of one annotation with one identity, no repeats, all passing."""
    ident = F.struct("identity", "source_sha256")
    dup = records.groupBy("annotation_id", "format").agg(F.count(F.lit(1)).alias("k")).groupBy("annotation_id").agg(F.max("k").alias("most"))
    return records.groupBy("annotation_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(ident).alias("lo"), F.max(ident).alias("hi"), F.bool_and(F.col("status") == "pass").alias("ok")).join(
        dup, "annotation_id").select("annotation_id", "n", F.array_join(reasons(
            (F.col("n") < 2, "too_few_records"), (F.col("lo") != F.col("hi"), "identity_drift"), (F.col("most") > 1, "duplicate_format"),
            (_no(F.col("ok")), "not_pass")), ",").alias("failures"))


def preservation_pairs(df: DataFrame, prefixes: list[str]) -> DataFrame:
    """Before and after hashes must be valid and equal for every prefix."""
    bad = [(_no(F.col(p + "_before").rlike(HASH) & (F.col(p + "_before") == F.col(p + "_after"))), p + "_drift") for p in prefixes]
    return df.select("record_id", F.array_join(reasons(*bad), ",").alias("failures"))


def selection_coverage(selected: DataFrame, mappings: DataFrame) -> DataFrame:
    """Each selected region mapped exactly once. Both: ``record_id, region_id``."""
    m = mappings.groupBy("record_id", "region_id").agg(F.count(F.lit(1)).alias("n"))
    return selected.select("record_id", "region_id", F.lit(True).alias("s")).distinct().join(m, ["record_id", "region_id"], "full_outer").select(
        "record_id", "region_id", first_reason((F.col("s").isNull(), "not_selected"), (F.col("n").isNull(), "not_mapped"),
                                               (F.col("n") > 1, "mapped_twice")).alias("reason")).where(F.col("reason").isNotNull())


def attempt_convergence(attempts: DataFrame, maximum: int = 2) -> DataFrame:
    """Attempts numbered 1..n within the bound; a repeated issue set or artifact hash does not converge."""
    prev = skew.shift(attempts, ["task_id"], ["ord"], {"p": F.struct("signature", "artifact_sha256")}, -1, F.floor(F.col("ord") / 65536))
    numbered = skew.number_rows(prev, ["task_id"], ["ord"], F.floor(F.col("ord") / 65536), "expected")
    return numbered.select("task_id", "ord", first_reason(
        (F.col("attempt") != F.col("expected"), "sequence_invalid"), (F.col("expected") > maximum, "bound_exceeded"),
        (F.coalesce(F.col("signature") == F.col("p.signature"), F.lit(False)), "non_convergent_issue_set"),
        (F.coalesce(F.col("artifact_sha256") == F.col("p.artifact_sha256"), F.lit(False)), "non_convergent_artifact"), default="valid").alias("outcome"))


def attach_readback(relations: DataFrame, measured: DataFrame) -> DataFrame:
    """Each declared relation needs one passing measurement of the same annotation, source and identity."""
    m = measured.groupBy("annotation_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("source_sha256", "identity", "status")).alias("m"))
    return relations.join(m, "annotation_id", "left").select("relation_id", "annotation_id", first_reason(
        (F.col("n").isNull(), "evidence_missing"), (F.col("n") > 1, "evidence_ambiguous"),
        (~F.col("identity").eqNullSafe(F.col("m.identity")), "identity_drift"), (~F.col("source_sha256").eqNullSafe(F.col("m.source_sha256")), "source_drift"),
        (~F.col("m.status").eqNullSafe("pass"), "not_pass"), default="attached").alias("outcome"))


def required_evaluation(scans: DataFrame, states: DataFrame, chunks: DataFrame) -> DataFrame:
    """Eligible artifacts need a live and complete evaluation; the first missing thing is named.

    ``scans``: ``artifact_id, is_pdf, hard_count``; ``states``: ``artifact_id, status, execution_mode,
    invoked, reason_code, formal, provider_status``; ``chunks``: ``artifact_id, invoked``.
    """
    sent = chunks.groupBy("artifact_id").agg(F.bool_and("invoked").alias("all_sent"))
    j = scans.join(states, "artifact_id", "left").join(sent, "artifact_id", "left")
    live = ((F.col("status") == "evaluated") & (F.col("execution_mode") == "live") & F.col("invoked") & (F.col("reason_code") == "ok")
            & F.col("formal") & F.col("provider_status").isin("accepted", "uncertain", "repair_required"))
    return j.select("artifact_id", first_reason(
        (~F.col("is_pdf") | F.coalesce(F.col("status") == "not_applicable", F.lit(False)), "not_applicable"),
        (F.col("hard_count") > 0, "not_applicable"), (F.col("status").isNull(), "state_missing"),
        (F.coalesce(live, F.lit(False)) & ~F.coalesce("all_sent", F.lit(True)), "identity_drift"), (F.coalesce(live, F.lit(False)), "complete"),
        ((F.col("status") == "evaluated") & (F.col("execution_mode") == "fixture"), "fixture_only"),
        (F.col("status") == "scanned_no_candidates", "state_missing"), (F.col("reason_code").isNotNull() & (F.col("reason_code") != "ok"), "reason_given"),
        default="provider_unavailable").alias("outcome"))


def required_checks(artifacts: DataFrame, base: list[str]) -> DataFrame:
    """Base checks true, applicable optional checks true, no reported errors, observed equals declared.

    ``artifacts``: ``artifact_id, checks, contract_checks, applicability`` (maps to boolean), ``errors`` (array).
    """
    checks, applicable = F.col("checks"), F.col("applicability")
    base_ok = F.forall(F.array(*map(F.lit, base)), lambda k: F.coalesce(checks[k], F.lit(False)))
    all_true = F.forall(F.map_values(checks), lambda v: F.coalesce(v, F.lit(False)))
    needed = F.forall(F.map_entries(applicable), lambda e: ~e["value"] | (e["key"] == "external_resources") | F.coalesce(checks[e["key"]], F.lit(False)))
    same = F.array_sort(F.map_entries(checks)) == F.array_sort(F.map_entries(F.col("contract_checks")))
    return artifacts.select("artifact_id", first_reason(
        (F.size("errors") > 0, "reported_errors"), (~(base_ok & all_true), "required_check_failed"),
        (~needed, "applicable_check_missing"), (~same, "checks_differ_from_contract"), default="pass").alias("outcome"))
