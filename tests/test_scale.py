"""Plans at scale: what grows with the input must not pass through the driver, one task or one group."""

import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from foliolens.functions import skew
from foliolens.functions.common import PAGE_KEY, prefixed
from foliolens.operators import findings
from foliolens.operators import layout_lines as ll
from foliolens.operators import layout_pairs as lp
from foliolens.operators import profile
from foliolens.operators import text as ot
from foliolens.plans import load_all

DATA = "/root/testdata/sf0.01"
QUERIES = load_all()[0]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def broadcast_rows_grown(text):
    """Broadcasts of a plan that have an exploded table below them."""
    lines, found = text.splitlines(), 0
    for i, line in enumerate(lines):
        if "BroadcastExchange" not in line:
            continue
        depth = re.search(r"[A-Z*]", line).start()
        for below in lines[i + 1:]:
            if re.search(r"[A-Z*]", below) and re.search(r"[A-Z*]", below).start() <= depth:
                break
            found += "Generate" in below
    return found


@pytest.mark.parametrize("name", ["c12_visible_ink", "f24_applicability", "g13_match_table_row", "g19_hanging_indent"])
def test_exploded_tables_are_not_broadcast(spark, name):
    assert pathlib.Path(DATA).exists() and broadcast_rows_grown(plan(QUERIES[name](spark, DATA))) == 0


def test_rules_do_not_meet_in_one_task(spark):
    text = plan(QUERIES["f2_union_findings"](spark, DATA))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_roles_come_with_the_region(spark):
    """Placed lines are not joined by region to fetch its role."""
    assert not re.search(r"Join \[[^\]]*region_id", plan(QUERIES["g24_line_spacing_projection"](spark, DATA)))


BOX = "artifact_id int, page int, box_id string, x0 double, y0 double, x1 double, y1 double"


def some_boxes(spark, seed):
    """Pages of 3 to 60 boxes that often meet."""
    rng = random.Random(seed)
    rows = []
    for artifact in range(6):
        for i in range(rng.randint(3, 60)):
            x, y = rng.randint(0, 12) * 50.0, rng.randint(0, 60) * 5.0
            rows.append((artifact, 1 + artifact % 2, f"b{i:02}", x, y, x + rng.randint(5, 200), y + rng.randint(5, 90)))
    return spark.createDataFrame(rows, BOX)


def elements(boxes, prefix, shift):
    return boxes.select(*PAGE_KEY, F.lit("k").alias("kind"), F.lit("bbox").alias("edge_basis"), F.concat(F.lit(prefix), "box_id").alias("element_id"),
                        F.substring("box_id", 2, 2).cast("int").alias("ord"), F.floor(F.col("x0") / 100).cast("double").alias("x0"),
                        (F.floor(F.col("y0") / 60) + shift).alias("y0"), F.lit(9.0).alias("x1"), F.lit(9.0).alias("y1"))


def same(one, other):
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


@pytest.mark.parametrize("crowd", [0, 20])
def test_coverage_of_crowded_pages_equals_that_of_others(spark, crowd):
    boxes = some_boxes(spark, 5)
    d, a = elements(boxes, "d", 0.0), elements(boxes, "a", 0.5)
    same(lp.coverage_match(d, a, crowd=crowd), lp.coverage_match(d, a, crowd=1000))


def test_coverage_moves_elements_once(spark):
    """Declared and actual elements of ordinary pages are shuffled by page, once each, without checkpointed rounds."""
    text = plan(QUERIES["g14_declared_twice"](spark, DATA))
    assert text.count("Exchange hashpartitioning") == 2 and "ExistingRDD" not in text


def test_boxes_are_dealt_by_artifact_once(spark):
    """Groups, neighbours and joins of a page's boxes need no shuffle beyond the one that deals the boxes."""
    assert plan(QUERIES["t19_split_in_blocks"](spark, DATA)).count("Exchange hashpartitioning") <= 6


@pytest.mark.parametrize("crowd", [0, 20])
def test_lines_of_crowded_pages_are_placed_as_others(spark, crowd):
    boxes = some_boxes(spark, 6)
    regions = some_boxes(spark, 7).withColumnRenamed("box_id", "region_id").withColumn("shape_kind", F.lit("text_region"))
    same(lp.assign_region(boxes, regions, crowd=crowd), lp.assign_region(boxes, regions, crowd=1000))


@pytest.mark.parametrize("name,exchanges", [("g10_assign_region", 2), ("g25_inner_margins", 4), ("g53_region_iou_rank", 5), ("g54_region_readback", 6)])
def test_ordinary_pages_are_not_cut_into_cells(spark, name, exchanges):
    text = plan(QUERIES[name](spark, DATA))
    assert "cx#" not in text and text.count("Exchange hashpartitioning") <= exchanges


def test_pairs_of_crowded_pages_equal_those_of_others(spark):
    a, b = (prefixed(some_boxes(spark, s), p, PAGE_KEY) for s, p in ((8, "a_"), (9, "b_")))
    whole = skew.page_pairs(a, b, PAGE_KEY, None, pad_x=2.0)
    for limit in (0, 20):
        crowd = skew.crowds(PAGE_KEY, a, b, limit=limit)
        assert crowd.count() > 0
        same(skew.page_pairs(a, b, PAGE_KEY, crowd, pad_x=2.0), whole)


@pytest.mark.parametrize("name", ["f27_layer_rollup", "f8_spacing_members", "f21_review_coverage"])
def test_boxes_are_not_grouped_before_they_are_dealt(spark, name):
    """A file may be one split of any number of rows: its task must not hold a group for each of them."""
    lines = plan(QUERIES[name](spark, DATA)).splitlines()
    dealt = [i for i, line in enumerate(lines) if "REPARTITION_BY_NUM" in line]
    assert dealt and not any("Aggregate" in lines[i + 1] for i in dealt)


def test_list_styles_need_no_copy_of_each_line_per_style(spark):
    assert "Expand" not in plan(QUERIES["t21_list_style_consistency"](spark, DATA))
    rows = [(1, 1, 1, "①a", "x", True), (1, 1, 1, "②b", None, True), (1, 1, 2, "①a", "x", True), (1, 1, 2, "②b", "y", None), (1, 1, 3, "①a", "x", True), (1, 1, 3, "②b", "x", False)]
    items = spark.createDataFrame(rows, "artifact_id int, page int, block_id int, text string, font string, bold boolean")
    assert {(r.block_id, r.rule) for r in ot.list_style(items).collect()} == {(2, "font_family_inconsistent"), (3, "font_weight_inconsistent")}


def test_ledger_rules_of_a_row_come_before_the_join(spark):
    """Entries meet their workflow without hashes and boxes, and are dealt over tasks first."""
    text = plan(QUERIES["e16_ledger_entry_rules"](spark, DATA))
    assert text.index("Join") < text.index("issue_family_unknown") and "REPARTITION_BY_COL" in text


@pytest.mark.parametrize("crowd", [0, 20])
def test_baselines_of_crowded_pages_are_merged_as_others(spark, crowd):
    lines = some_boxes(spark, 10).withColumns({"baseline_y": F.col("y1") / 8, "font_size": F.lit(9.0), "text": F.col("box_id")})
    same(ll.coalesce_baselines(lines, crowd=crowd), ll.coalesce_baselines(lines, crowd=1000))


def test_baselines_of_a_page_are_merged_where_it_is(spark):
    assert plan(QUERIES["g16_coalesce_baselines"](spark, DATA)).count("Exchange hashpartitioning") <= 2


def test_only_measured_candidates_meet_regions(spark):
    columns = ("artifact_id int, candidate_id string, rule string, page int, overlap double, first_id string, second_id string, has_bbox boolean, "
               "line_ids string, units string, has_roles boolean, has_relationship boolean")
    over, gap = "unclassified_source_overlap_or_gutter", "line_spacing_candidate"
    tail = (True, "l", "pt", True, True)
    rows = [(1, "a", over, 1, 2.0, "r", "s", *tail), (1, "b", over, 1, 0.0, "r", "s", *tail), (1, "c", over, None, None, "r", "s", *tail),
            (1, "d", over, 1, 2.0, "r", None, *tail), (1, "e", gap, 1, 2.0, "r", "s", *tail), (1, "f", gap, None, None, None, "s", *tail), (1, "g", None, 1, 2.0, "r", "s", *tail)]
    regions = spark.createDataFrame([(1, "r", 0.0, 0.0, 4.0, 4.0, 1, None), (1, "s", 2.0, 2.0, 6.0, 6.0, None, True)],
                                    "artifact_id int, region_id string, x0 double, y0 double, x1 double, y1 double, source_order int, known_occlusion boolean")
    found = findings.project_candidates(spark.createDataFrame(rows, columns), regions)
    got = {r.candidate_id: (r.candidate_type, r.overlap_area, r.overlap_ratio, r.missing_information, r.complete, r.reason) for r in found.collect()}
    assert got == {
        "a": ("source_overlap", 4.0, 0.25, "source_stacking_order,rendered_stacking_order", True, None), "b": ("source_overlap", None, None, None, False, "non_overlap_candidate"),
        "c": ("source_overlap", None, None, None, False, "non_overlap_candidate"), "d": ("source_overlap", None, None, None, False, "member_geometry_missing"),
        "e": ("measured_spacing", None, None, "", True, None), "f": ("measured_spacing", None, None, "page,source_shape_ids", False, None),
        "g": (None, None, None, None, False, "unsupported_candidate_type")}
    assert "Union" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("crowd", [0, 20])
def test_profiles_of_crowded_artifacts_equal_those_of_others(spark, crowd):
    lines = some_boxes(spark, 11).withColumns({"page": (F.substring("box_id", 2, 2).cast("int") % 3), "chars": F.when(F.col("x0") > 50, F.length("box_id")), "font_size": F.when(F.col("y0") > 9, F.col("x0") / 4)})
    rows = [(a, p, 100.0 * (1 + p % 2), 200.0 + a * p, (a + p) % 2) for a in range(8) for p in (0, 1, 3)] + [(2, 1, 100.0, 150.0, 1), (None, 1, 9.0, 9.0, 0), (3, None, 9.0, 9.0, 0), (4, 1, None, 90.0, None)]
    pages = spark.createDataFrame(rows, "artifact_id int, page int, width double, height double, rotation int")
    one, other = profile.artifact_profile(lines, pages, crowd=crowd), profile.artifact_profile(lines, pages, crowd=1000)
    assert one.dtypes == other.dtypes
    same(one, other)


def test_lines_of_a_profile_are_moved_once(spark):
    assert plan(QUERIES["g55_artifact_profile"](spark, DATA)).count("Exchange hashpartitioning") <= 3
