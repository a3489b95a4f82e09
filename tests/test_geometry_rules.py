"""Boundary values and literal cases of geometry, colour, relations and evidence."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliolens.functions import skew
from foliolens.functions.common import multiset_digest, prefixed, py_round
from foliolens.operators import blocks as bl
from foliolens.operators import color as oc
from foliolens.operators import findings as fi
from foliolens.operators import layout_lines as ll
from foliolens.operators import layout_pairs as lp
from foliolens.operators import merge as mg
from foliolens.sources import readers, sinks
from foliolens.streaming import guards

BOX = "artifact_id int, page int, box_id string, x0 double, y0 double, x1 double, y1 double"


def test_py_round(spark):
    values = [0.125, 2.675, 1.0005, -2.5, 0.5, 1.5, 1e15, 123.4565, -0.0001, 5.015, 1.005, 0.0005, 1 / 3]
    rng = random.Random(3)
    values += [rng.randint(-10**6, 10**6) / 2000 for _ in range(2000)] + [rng.uniform(-100, 100) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for d in (0, 2, 3, 6):
        got = [r[0] for r in df.select(py_round(F.col("v"), d)).collect()]
        assert got == [round(v, d) + 0.0 for v in values]


@pytest.mark.parametrize("gap,found", [(0.0, False), (-3.0, False), (0.01, False), (0.5, True), (4.0, True), (7.9, True), (7.99, False), (8.0, False), (11.0, False)])
def test_parallel_frames(spark, gap, found):
    stacked = [(1, 1, "a", 0.0, -50.0, 100.0, 0.0), (1, 1, "b", 0.5, gap, 100.5, 40.0 + gap)]
    beside = [(2, 1, "a", -100.0, 0.0, 0.0, 50.0), (2, 1, "b", gap, 0.0, 50.0 + gap, 50.0)]
    uneven = [(3, 1, "a", 0.0, -50.0, 100.0, 0.0), (3, 1, "b", 0.0, gap, 120.0, 40.0 + gap)]
    got = {(r.artifact_id, r.orientation) for r in lp.parallel_frames(spark.createDataFrame(stacked + beside + uneven, BOX)).collect()}
    assert got == ({(1, "vertical"), (2, "horizontal")} if found else set())


def test_box_pairs_equal_brute_force_on_one_crowded_page(spark):
    rng = random.Random(7)
    rows = [(1, 1, f"b{i}", *(lambda x, y: (x, y, x + rng.uniform(1, 60), y + rng.uniform(1, 30)))(rng.uniform(-200, 900), rng.uniform(-100, 1500))) for i in range(400)]
    df = spark.createDataFrame(rows, BOX).repartition(5)
    a, b = prefixed(df, "a_", ["artifact_id", "page"]), prefixed(df, "b_", ["artifact_id", "page"])
    for pad in (0.0, 12.5):
        got = sorted((r.a_box_id, r.b_box_id) for r in skew.box_pairs(a, b, ["artifact_id", "page"], pad_x=pad, pad_y=pad, cell_w=64.0, cell_h=32.0).collect())
        want = sorted((p[2], q[2]) for p in rows for q in rows if p[3] - pad <= q[5] and q[3] <= p[5] + pad and p[4] - pad <= q[6] and q[4] <= p[6] + pad)
        assert got == want


def test_banded_neighbours_and_running_equal_plain_windows(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), i, rng.randint(0, 9)) for i in rng.sample(range(5000), 600)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(7)
    band = F.floor(F.col("i") / 37)
    w = Window.partitionBy("k").orderBy("i")
    for offset, plain in ((-1, F.lag("v")), (1, F.lead("v"))):
        got = skew.shift(df, ["k"], ["i"], {"o": F.col("v")}, offset, band).select("k", "i", "o")
        want = df.select("k", "i", plain.over(w).alias("o"))
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    for agg, fn in (("sum", F.sum), ("max", F.max), ("min", F.min)):
        for inclusive in (True, False):
            frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
            got = skew.running(df, ["k"], ["i"], {"o": (agg, F.col("v"))}, band, inclusive).select("k", "i", F.col("o").cast("long"))
            want = df.select("k", "i", fn("v").over(frame).cast("long").alias("o"))
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_coalesce_anchors_do_not_chain(spark):
    rows = [(1, 1, f"b{i}", float(i), 0.0, i + 1.0, 1.0, y, 8.0, str(i)) for i, y in enumerate([10.0, 10.5, 11.0, 11.5, 20.0, 20.75, 20.76])]
    df = spark.createDataFrame(rows, BOX + ", baseline_y double, font_size double, text string")
    got = sorted((r.anchor, r.text) for r in ll.coalesce_baselines(df).collect())
    assert got == [(10.0, "01"), (11.0, "23"), (20.0, "45"), (20.76, "6")]


def test_occupancy_of_nested_and_touching_lines(spark):
    cards = spark.createDataFrame([(1, 1, "c", 0.0, 0.0, 100.0, 400.0), (2, 1, "e", 0.0, 0.0, 10.0, 10.0)], BOX.replace("box_id", "card_id"))
    spans = [(0, 100), (20, 50), (100, 120), (300, 500), (130, 130)]
    lines = spark.createDataFrame([(1, 1, f"l{i}", 10.0, float(a), 50.0, float(b)) for i, (a, b) in enumerate(spans)], BOX)
    got = {r.card_id: (r.occupancy, r.bottom_blank_ratio) for r in ll.vertical_occupancy(cards, lines).collect()}
    assert got == {"c": (0.55, 0.0), "e": (0.0, 1.0)}


def test_digest_ignores_order_and_partitioning(spark):
    df = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    one = df.agg(multiset_digest(F.col("h")).alias("d")).first().d
    assert one == df.orderBy(F.rand(1)).repartition(9).agg(multiset_digest(F.col("h")).alias("d")).first().d
    assert one != df.where("h < 'f'").agg(multiset_digest(F.col("h")).alias("d")).first().d
    assert one != df.unionAll(df.limit(1)).agg(multiset_digest(F.col("h")).alias("d")).first().d


REL_BLOCK = "block_id int, parent_id int, owner_id int, page int, x0 double, y0 double, x1 double, y1 double, line_height double"


def test_relations(spark):
    blocks = spark.createDataFrame([
        (1, None, None, 1, 0.0, 0.0, 100.0, 20.0, 0.0), (2, None, None, 1, 0.0, 22.0, 100.0, 40.0, 0.0), (3, None, None, 1, 0.0, 39.0, 100.0, 60.0, 0.0),
        (4, None, None, 2, 0.0, 0.0, 100.0, 20.0, 0.0), (5, None, None, None, None, None, None, None, 0.0)], REL_BLOCK)
    spec = "relation_id string, member_ids array<int>, min_gap double, same_page boolean, no_overlap boolean"
    rel = spark.createDataFrame([("ok", [1, 2], 2.0, True, True), ("tight", [1, 2], 3.0, True, True), ("overlap", [2, 3], 0.0, True, True), ("cross", [1, 4], 1.0, True, True),
                                 ("cross_ok", [1, 4], 1.0, False, True), ("lost", [1, 5], 1.0, True, True), ("open", [1, 2], None, True, True)], spec)
    got = {r.relation_id: (r.status, r.reason_code) for r in bl.eval_ordered(rel, blocks).collect()}
    assert got == {"ok": ("pass", "ordered_satisfied"), "tight": ("fail", "min_gap_pt"), "overlap": ("fail", "no_overlap,min_gap_pt"), "cross": ("fail", "same_page"),
                   "cross_ok": ("pass", "ordered_satisfied"), "lost": ("fail", "render_mapping_missing"), "open": ("fail", "min_gap_pt_undeclared")}
    pair = "relation_id string, first_id int, second_id int, mode string, max_gap double, max_width_delta double, containment_tolerance double, max_edge_delta double, min_gap double"
    vert = spark.createDataFrame([("a", 1, 2, "attached", 2.0, 0.0, 0.0, 0.0, None), ("b", 1, 2, "separate", None, None, None, None, 2.5), ("c", 1, 2, "unspecified", None, None, None, None, None)], pair)
    got = {r.relation_id: r.status for r in bl.eval_vertical(vert, blocks).collect()}
    assert got == {"a": "pass", "b": "fail", "c": "review"}


def test_closure_survives_cycles(spark):
    blocks = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, None)], "block_id int, parent_id int")
    got = {(r.node, r.ancestor) for r in bl.closure(blocks).collect()}
    assert got == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)} | {(4, 1), (4, 2), (4, 3)}


def test_region_contrast_support_and_missing_text(spark):
    hist = spark.createDataFrame([(1, 0, 0, 0, 50), (1, 255, 255, 255, 5000), (1, 128, 128, 128, 4), (1, 20, 200, 20, 100), (2, 255, 255, 255, 10)], "region_id int, r int, g int, b int, n int")
    regions = spark.createDataFrame([(1, 0, 0, 0, 10.0), (2, 0, 0, 0, 10.0)], "region_id int, fr int, fg int, fb int, tolerance double")
    got = {r.region_id: r for r in oc.region_contrast(hist, regions).collect()}
    assert got[1].background_n == 5100 and got[1].median_ratio == 21.0 and got[2].status == "not_verified"


def test_pack_chunks_refuses_single_over_cap(spark):
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate([50, 50, 1, 100, 99, 1])] + [("b", 0, 10), ("b", 1, 101)], "request_id string, ord int, size int")
    got = sorted(((r.request_id, r.ord, r.chunk, r.status) for r in fi.pack_chunks(rows, 100, 1000).collect()), key=str)
    assert [(o, c) for q, o, c, s in got if q == "a"] == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 3)]
    assert [s for q, o, c, s in got if q == "b"] == ["row_too_large", "row_too_large"]


def test_leaves_merge_and_conflicts(spark):
    doc = '{"a/b": {"~x": null, "e": {}}, "l": [1, [], {"k": "v"}]}'
    leaves = mg.to_leaves(spark.createDataFrame([(1, doc), (2, "3")], "doc_id int, body string"), "body")
    assert {(r.doc_id, r.pointer, r.value) for r in leaves.collect()} == {
        (1, "/a~1b/~0x", "null"), (1, "/a~1b/e", "{}"), (1, "/l/0", "1"), (1, "/l/1", "[]"), (1, "/l/2/k", '"v"'), (2, "", "3")}
    assert {(r.pointer, r.size) for r in mg.array_sizes(leaves).collect()} == {("/l", 3), ("/l/1", 0)}
    diffs = spark.createDataFrame([(1, "x", "/a"), (1, "y", "/a/b"), (1, "y", "/ab"), (1, "x", "/q"), (1, "y", "/q")], "doc_id int, role string, pointer string")
    assert {(r.upper_pointer, r.lower_pointer) for r in mg.path_conflicts(diffs).collect()} == {("/a", "/a/b"), ("/q", "/q")}
    assert mg.glob_regex(["/a/*", "/b/[!x]?"]) and [bool(__import__("re").match(mg.glob_regex(["/a/*", "/b/[!x]?"]), p)) for p in ("/a/b/c", "/b/yz", "/b/xz", "/c")] == [True, True, False, False]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.json").write_text('{"k": [1]}')
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "d.docx").write_bytes(b"nope")
    got = {r.format: r for r in readers.inspect_sources(readers.binary_files(spark, str(tmp_path))).collect()}
    assert got["text"].line_count == 2 and got["json"].top_level == "object" and got["pdf"].valid_container and not got["docx"].valid_container
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "x.jsonl").write_text('{"workflow_id": 1, "seq": 2}\n\n{broken\n')
    rows = readers.read_jsonl(spark, str(tmp_path / "log"), readers.LEDGER_SCHEMA).collect()
    assert len(rows) == 2 and sum(r._corrupt_record is not None for r in rows) == 1
    frame = spark.range(3).select(F.col("id").alias("artifact_id"), F.lit("r").alias("rule"))
    sinks.create_once(frame, str(tmp_path / "once"))
    with pytest.raises(Exception):
        sinks.create_once(frame, str(tmp_path / "once"))
    with pytest.raises(ValueError):
        sinks.assert_body_free(frame.select(F.array(F.struct(F.lit("x").alias("Text"))).alias("items")))


GUARD_CASES = [
    ("artifact_ready", dict(fingerprint="a"), "block", "same_fingerprint"), ("artifact_ready", dict(fingerprint="a", mode="verify-only"), "allow", "verification"),
    ("artifact_ready", dict(fingerprint="b"), "block", "new_fingerprint_not_admitted"), ("artifact_ready", dict(fingerprint="b", allow_new=True), "allow", "new_fingerprint"),
    ("artifact_ready", dict(fingerprint="b", allow_new=True, retry_count=2), "block", "retry_limit_exhausted"), ("transient_retry", dict(fingerprint="a"), "allow", "transient_retry"),
    ("transient_retry", dict(fingerprint="a", retry_count=2), "block", "retry_limit_exhausted"), ("review_only", dict(fingerprint="b"), "block", "review_only"),
    ("hard_fail", dict(fingerprint="b"), "block", "repair_plan_missing"), ("hard_fail", dict(fingerprint="b", plan="/p", call_plan="/p"), "allow", "bound_correction"),
    ("hard_fail", dict(fingerprint="b", plan="/p", call_plan="/q"), "block", "correction_not_bound"), ("artifact_ready", dict(fingerprint="a", baseline="fail"), "block", "ready_without_delivery"),
]


def guard_rows(order):
    rows = []
    for task, (status, o, _, _) in enumerate(GUARD_CASES):
        adapter = "c" * 64
        rows.append((task, 1, "state", None, None, None, o.get("plan"), adapter, status, 2, o.get("retry_count", 0), "a" * 64, o.get("allow_new", False), o.get("baseline", "pass"), "attachment"))
        rows.append((task, 2, "call", "image_generate", o.get("mode"), o["fingerprint"] * 64, o.get("call_plan"), adapter, *[None] * 7))
        rows.append((task, 3, "call", "read_file", None, None, None, None, *[None] * 7))
    return sorted(rows, key=order)


def test_retry_guard_batch_and_stream(spark, tmp_path):
    expected = {(t, 2): (d, r) for t, (_, _, d, r) in enumerate(GUARD_CASES)}
    batch = guards.retry_guard(spark.createDataFrame(guard_rows(lambda r: r[1]), guards.EVENT_SCHEMA), ["image_generate"])
    got = {(r.task_id, r.seq): (r.decision, r.reason) for r in batch.collect()}
    assert {k: got[k] for k in expected} == expected
    # three micro-batches: in order, reversed inside a batch, and one repeated
    from foliolens.streaming import flows
    folder = str(tmp_path / "events")
    rows = guard_rows(lambda r: r[1])
    for part in ([r for r in rows if r[1] == 1], [r for r in rows if r[1] > 1][::-1], [r for r in rows if r[1] == 2]):
        spark.createDataFrame(part, guards.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.createDataFrame([], guards.EVENT_SCHEMA).schema
    stream = guards.retry_guard_stream(flows.file_stream(spark, folder, "*.parquet", schema, 1), ["image_generate"])
    out = flows.run_to_table(stream, "guard-test").collect()
    on_time = {(r.task_id, r.seq): (r.decision, r.reason) for r in out if r.reason != "late_event"}
    assert on_time == got
    assert sum(r.reason == "late_event" for r in out) == len(GUARD_CASES)


def test_tampering_one_field_gives_one_finding(spark):
    import hashlib
    from foliolens.operators import evidence as ev
    rows, last = [], "0" * 64
    for seq in range(6):
        h = hashlib.sha256(f"1~{seq}~p{seq}".encode()).hexdigest()
        rows.append([1, seq, f"e{seq}", f"p{seq}", last, h])
        last = h
    cols = "workflow_id int, seq int, entry_id string, payload string, prev_hash string, entry_hash string"
    assert ev.ledger_check(spark.createDataFrame(rows, cols), band=2).count() == 0
    rows[3][3] = "changed"
    assert [(r.seq, r.reason) for r in ev.ledger_check(spark.createDataFrame(rows, cols), band=2).collect()] == [(3, "tampered")]


# ---- one-to-one coverage, quantiles, body-free evidence ------------------------------------------
def coverage(spark, declared, actual):
    """(id, ord, x, occurrence) and (id, ord, x): elements of 10 x 10 at (x, 0) of one page; match and status by id."""
    from foliolens.operators import layout_pairs as lp
    edges = "x0 double, y0 double, x1 double, y1 double"
    head = "artifact_id string, page int, kind string, edge_basis string, element_id string, ord int, "
    box = lambda i, o, x: ("a", 1, "line", "bbox", i, o, float(x), 0.0, x + 10.0, 10.0)
    d = spark.createDataFrame([(*box(i, o, x), occ) for i, o, x, occ in declared], head + edges + ", occurrence int")
    a = spark.createDataFrame([box(*r) for r in actual], head + edges)
    got = lp.coverage_match(d, a).collect()
    return {r.element_id: r.match_id for r in got if r.element_id}, {r.match_id for r in got if r.status == "undeclared"}


def test_second_declared_of_one_actual_is_missing(spark):
    assert coverage(spark, [("d1", 1, 0, None), ("d2", 2, 0.5, None)], [("x", 1, 0.25)]) == ({"d1": "x", "d2": None}, set())


def test_taken_elements_resolve_what_was_ambiguous(spark):
    # d1 sees x and y, d2 only x, d3 sees both again when x is taken
    matches, left = coverage(spark, [("d1", 1, 0.6, None), ("d2", 2, -0.5, None), ("d3", 3, 0.65, None)], [("x", 1, 0), ("y", 2, 1.2)])
    assert matches == {"d1": None, "d2": "x", "d3": "y"} and left == set()


def test_declared_occurrence_goes_before_the_order(spark):
    actual = [("x1", 1, 5), ("x2", 2, 5)]
    assert coverage(spark, [("d1", 1, 5, 2), ("d2", 2, 5, 1)], actual) == ({"d1": "x2", "d2": "x1"}, set())
    assert coverage(spark, [("d1", 1, 5, 3), ("d2", 2, 5, None)], actual) == ({"d1": None, "d2": "x2"}, {"x1"})


def test_long_chain_of_shared_elements_is_decided_in_order(spark):
    declared = [(f"d{i:02}", i, i * 1.0, None) for i in range(12)]
    actual = [(f"x{i:02}", i, i * 1.0 + 0.5) for i in range(11)]
    want, free = {}, {i: x for i, _, x in actual}
    for i, _, x, _ in declared:
        near = [k for k, v in free.items() if abs(v - x) <= 0.75]
        want[i] = near[0] if len(near) == 1 else None
        if want[i]:
            free.pop(want[i])
    assert coverage(spark, declared, actual) == (want, set(free))


def test_quantiles_equal_the_built_in_ones(spark):
    import random
    from foliolens.functions import skew
    rng = random.Random(3)
    rows = [(k, rng.choice([None, float(rng.randrange(-40, 40)), rng.random() * 9]), rng.randrange(0, 4)) for k in "abc" for _ in range(400)] + [("one", 7.5, 1), ("none", 1.0, 0)]
    df = spark.createDataFrame(rows, "k string, v double, w int")
    got = {r.k: (r.q0, r.q1, r.q2) for r in skew.quantiles(df, ["k"], "v", F.col("w"), [0.05, 0.5, 1.0], F.floor(F.col("v") / 3)).collect()}
    want = {r.k: tuple(r.p) for r in df.where("w > 0 AND v IS NOT NULL").groupBy("k").agg(F.percentile("v", [0.05, 0.5, 1.0], F.col("w")).alias("p")).collect()}
    assert got == want and "none" not in got


def test_forbidden_keys_are_found_at_any_depth(spark):
    from foliolens.sources import sinks
    rows = spark.sql("""SELECT * FROM VALUES (1, array(named_struct('m', map('a', map('Body', 1)))), map(1, 'x')), (2, array(named_struct('m', map('a', map('b', 1)))), map(1, 'text')), (3, array(NULL), NULL), (4, NULL, NULL) AS t(id, deep, plain)""")
    assert [r.id for r in sinks.assert_body_free(rows).collect()] == [1]
    assert sinks.assert_body_free(rows.select("id")).count() == 0
