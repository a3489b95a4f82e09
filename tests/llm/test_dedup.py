"""Deduplication operators against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolens.llm import base, components, line_dedup, ngram_join, suffix_dedup

SCHEMA = "doc_id bigint, text string, n int, key string, cid string, line int, _id string, component string"


def table(spark, rows):
    """Documents with extra columns whose names operators also use inside."""
    return spark.createDataFrame([(i, t, 1, "k", "c", 2, "x", "y") for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ------------------------------------------------------------------ repeated byte strings

def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] = seen.get(t[i:i + length], 0) + 1
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                gone[k:k + length] = True
        spans = int((np.diff(gone[:-1].astype(int), prepend=0) == 1).sum()) if t else 0
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeats_of(df):
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("buffer", [3, 1 << 15])
def test_suffix_dedup_equals_brute_force(spark, buffer):
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdé ") for _ in range(60))
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(90)))) for i in range(25)]
    rows += [(100 + i, words(rng, 6) + passage[rng.randrange(20):rng.randrange(40, 60)] + words(rng, 5)) for i in range(12)]
    rows += [(200, None), (201, ""), (202, "x" * 70), (203, "xy" * 40), (204, passage), (204, passage), (None, passage + "tail"), (205, "short")]
    got = repeats_of(suffix_dedup.dedup(table(spark, rows), length=20, gram=6, buffer=buffer))
    assert ordered(got) == ordered(brute_repeats(rows, 20))


def test_suffix_dedup_long_text_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh") for _ in range(3000))
    whole = list(suffix_dedup.anchors(text.encode(), 200, 32))
    parts = list(suffix_dedup.anchors(text.encode(), 200, 32, block=300))
    cover = lambda found: sorted((int(a) + k, int(s)) for f in found for a, n, s in zip(f[0], f[1], f[2], strict=True) for k in range(n))
    assert cover(whole) == cover(parts)


def test_suffix_dedup_empty_table(spark):
    assert suffix_dedup.dedup(table(spark, [])).count() == 0


def test_run_queue_keeps_order_of_equal_keys(tmp_path):
    kind = np.dtype([("key", np.int64), ("row", np.int64)])
    queue = suffix_dedup.RunQueue(kind, str(tmp_path), 5)
    rng = np.random.default_rng(1)
    rows = np.zeros(83, kind)
    rows["key"], rows["row"] = rng.integers(0, 4, 83), np.arange(83)
    for at in range(0, 83, 7):
        queue.push(rows[at:at + 7])
    got = np.concatenate(list(queue.drain()))
    assert got.tolist() == rows[np.argsort(rows["key"], kind="stable")].tolist()


# ------------------------------------------------------------------ shingle sets

def shingles(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[find(i)] = min(ids.get(find(i), doc), doc)
    return [(doc, len(sets[i]), ids.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def near_copies(rng):
    rows, number = [], 1000
    for size in (5, 12, 40, 90):
        for _ in range(6):
            text = words(rng, size, 400).split()
            for _ in range(4):
                copy = list(text)
                for _ in range(rng.randrange(3)):
                    copy[rng.randrange(size)] = f"v{rng.randrange(9)}"
                rows.append((number, " ".join(copy)))
                number -= 1
    common = words(rng, 30, 400)
    rows += [(2000 + i, words(rng, 8, 400) + " " + common) for i in range(20)]  # a shared passage, not near-duplicates
    return rows


def test_ngram_join_equals_brute_force(spark):
    rng = random.Random(5)
    rows = near_copies(rng) + [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "One  two"), (6, "two one"), (7, "a b c d"), (7, "a b c d"), (None, "a b c d"),
                               (8, "same id"), (8, "other text of same id"), (None, "alone here now"), (9, " ".join(f"l{i}" for i in range(5000)))]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.components(table(spark, rows)).collect()]
    assert ordered(got) == ordered(brute_components(rows))


def test_ngram_join_chain(spark):
    """Links a-b and b-c where a and c are no link."""
    base = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join(base[i * 4:] + [f"u{k}" for k in range(i * 4)])) for i in range(6)]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.components(table(spark, rows)).collect()]
    assert ordered(got) == ordered(brute_components(rows))


def test_ngram_join_across_small_nodes(spark, monkeypatch):
    monkeypatch.setattr(ngram_join.pack, "__defaults__", (85, 3, 1 << 20))
    monkeypatch.setattr(ngram_join.homes_of, "__defaults__", (1,))
    monkeypatch.setattr(ngram_join, "HOME", 5)
    rows = near_copies(random.Random(8))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.components(table(spark, rows)).collect()]
    assert ordered(got) == ordered(brute_components(rows))


def test_keep_one_keeps_columns_and_one_of_each_group(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (4, None), (5, ""), (6, "else where than that")]
    kept = ngram_join.keep_one(table(spark, rows))
    assert kept.columns == table(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6]
    assert ngram_join.keep_one(table(spark, [])).count() == 0


def test_keep_one_judges_rows_by_id_and_text(spark):
    near, clean, twice = "a b c d e f g h", "some wholly different clean text", "two equal rows of one document"
    rows = [(1, near), (2, near), (2, clean), (3, twice), (3, twice), (None, twice + " more"), (4, None), (4, None)]
    kept = sorted(((r["doc_id"], r["text"]) for r in ngram_join.keep_one(table(spark, rows)).collect()), key=repr)
    assert kept == sorted([(1, near), (2, clean), (3, twice), (None, twice + " more"), (4, None), (4, None)], key=repr)
    docs = spark.createDataFrame([("b", near), ("a", near), ("c", clean)], "doc_id string, text string")
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(docs).collect()) == ["a", "c"]


def test_node_corner_bounds_every_point(spark):
    rng = np.random.default_rng(2)
    points = rng.integers(0, 5, (20, ngram_join.GROUPS)).astype("<u4")
    query = rng.integers(0, 5, ngram_join.GROUPS)
    assert (np.minimum(points, query).sum(axis=1) <= np.minimum(points.max(axis=0), query).sum()).all()


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 300), (7, 7), (50, 60), (50, 60)] + [(400, 400 + i) for i in range(1, 40)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[300] == got[200] == got[100] == 100 and got[60] == 50
    assert all(got[400 + i] == 400 for i in range(40)) and 7 in got
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ------------------------------------------------------------------ fuzzy lines

def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fold(line):
    words = re.sub(r"[\s!-/:-@\[-`{-~\u2010-\u2027\u3001-\u3003]+", " ", line.lower()).strip()
    return words or " ".join(line.lower().split())


def brute_lines(rows, similarity=0.8):
    """Lines with their folded form, and the root of each form, by the edit similarity of all pairs."""
    found = [(doc, k, fold(line)) for doc, text in rows for k, line in enumerate(text.split("\n") if text is not None else [])]
    found = [f for f in found if f[2]]
    norms = sorted({f[2] for f in found})
    parent = {n: n for n in norms}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(norms):
        for b in norms[:i]:
            most = int(max(len(a), len(b)) * (1 - similarity) + 1e-9)
            if abs(len(a) - len(b)) <= most and edit(a, b) <= most:
                parent[find(a)] = find(b)
    return found, find


def removed(spark, rows):
    got = line_dedup.report(table(spark, rows)).collect()
    return {(r["doc_id"], int(k)) for r in got for k in r["removed_lines"].split(",") if k}


def spelled(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def test_line_dedup_equals_brute_force(spark):
    """The registered path, on lines whose copies differ in up to two words: no link of these is lost and none is made up."""
    rng = random.Random(11)
    long = [spelled(rng, 24) for _ in range(8)]
    rows = []
    for i in range(40):
        lines = [" ".join(spelled(rng, 9)) for _ in range(2)]
        for _ in range(2):
            w = list(rng.choice(long))
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(["changed", w[0], "x1", "x2"])
            lines.append(" ".join(w))
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(50, None), (51, ""), (52, "short line"), (53, "Short line."), (54, "One, two; three four 5 five!\none two three four 7 five"), (55, " ".join(long[0]) + "\n\n \t\r\n---\n" + " ".join(long[0])), (56, "---")]
    found, find = brute_lines(rows)
    first: dict[str, tuple] = {}
    for doc, k, norm in found:
        first[find(norm)] = min(first.get(find(norm), (doc, k)), (doc, k))
    want = {(doc, k) for doc, k, norm in found if (doc, k) != first[find(norm)]}
    assert removed(spark, rows) == want and len(want) > 70


EDITS = {
    "word": lambda rng, w: w[:(k := rng.randrange(len(w)))] + spelled(rng, 1) + w[k + 1:],
    "inserted": lambda rng, w: w[:(k := rng.randrange(len(w)))] + ["and"] + w[k:],
    "typo": lambda rng, w: w[:(k := rng.randrange(len(w)))] + [w[k][:-1] + "z"] + w[k + 1:],
    "blank": lambda rng, w: w[:(k := rng.randrange(len(w)))] + [""] + w[k:],
    "return": lambda rng, w: w[:-1] + [w[-1] + "\r"],
    "tab": lambda rng, w: ["\t".join(w[:2]), *w[2:]],
    "comma": lambda rng, w: [w[0] + ",", *w[1:]],
}


def test_one_edit_is_found_at_any_length(spark):
    rng = random.Random(4)
    rows, cases = [], []
    for size in (8, 12, 20, 40, 80, 160):
        for _ in range(12):
            line = spelled(rng, size)
            rows.append((len(rows), " ".join(line)))
            for kind, change in EDITS.items():
                copy = " ".join(change(rng, line))
                a, b = fold(" ".join(line)), fold(copy)
                cases.append((len(rows), kind, 1 - (edit(a, b) if size <= 40 else 9) / max(len(a), len(b))))
                rows.append((len(rows), copy))
    gone = removed(spark, rows)
    assert not any((i, 0) in gone for i in range(0, len(rows), len(EDITS) + 1))
    for kind in EDITS:
        near = [(doc, 0) in gone for doc, k, similar in cases if k == kind and similar >= 0.8]
        assert len(near) > 60 and sum(near) >= 0.95 * len(near), kind


def test_pieces_of_long_lines_bound_their_edit_distance(spark):
    rng = random.Random(5)
    prose = [f"{rng.choice('abcdefgh')}{rng.randrange(10 ** rng.randrange(1, 6))}" for _ in range(160)]
    near = [w if rng.random() > 0.05 else "other" for w in prose]
    far = [w if rng.random() > 0.6 else "other" for w in prose]
    pairs = [(prose, prose), (prose, near), (prose, far), (prose, prose[:60] + prose[80:]), (prose[:60] + prose[80:], near), (prose, near[20:]),
             (["thor"] * 200, ["thor"] * 90 + ["other"] + ["thor"] * 80), (prose, list(reversed(prose))), (["é"] * 200, ["é"] * 199 + ["x"])]
    pairs = [(" ".join(a), " ".join(b)) for a, b in pairs] + [("a" * 300, "b" * 300), ("ab" * 200, "ba" * 200), ("x", "x" * 300), ("", "y")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, ta string, tb string").repartition(3)
    most = F.floor(F.greatest(F.length("ta"), F.length("tb")) * 0.2 + 1e-9).cast("int")
    rows = df.select("i", F.levenshtein("ta", "tb").alias("whole"), most.alias("most"), line_dedup.in_pieces(F.col("ta"), F.col("tb"), most).alias("pieces"),
                     line_dedup.alike(F.col("ta"), F.col("tb"), 0.8).alias("alike")).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        # cut off beyond what is allowed, but never below the distance where that counts
        assert r["pieces"] >= min(r["whole"], r["most"] + 1)
        assert r["alike"] == (r["whole"] <= r["most"])
    # near copies, with a passage left out, and repeated words with some left out are linked by their pieces alone
    assert {r["i"] for r in rows if r["pieces"] <= r["most"]} >= {0, 1, 3, 5, 6, 8}


def test_long_lines_are_judged_like_short_ones(spark):
    rng = random.Random(6)
    most = spelled(rng, 9000)
    shifted = spelled(rng, 5000)
    rows = [(1, " ".join(most)), (2, " ".join(most[:5000] + ["changed"] + most[5001:])), (3, " ".join(shifted)),
            (4, " ".join(shifted[:5] + spelled(rng, 100) + shifted[5:])), (5, " ".join(spelled(rng, 5000)))]
    assert removed(spark, rows) == {(2, 0), (4, 0)}


def test_recall_of_line_links_on_a_real_table(spark):
    """Every thirtieth line of up to 900 characters against all lines, by plain edit similarity without any SimHash."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    each = line_dedup.lines(docs).cache()
    norms = each.select("norm", F.xxhash64("key").alias("id")).distinct().cache()
    asked = norms.where("abs(id) % 30 = 0 AND length(norm) <= 900").select(F.col("norm").alias("a"), F.col("id").alias("ia"))
    pairs = asked.crossJoin(norms.where("length(norm) <= 1200")).where("ia <> id")
    links = [(r["ia"], r["id"]) for r in pairs.where(line_dedup.alike(F.col("a"), F.col("norm"), 0.8)).select("ia", "id").collect()]
    group = {r["id"]: r["component"] for r in line_dedup.groups(each).collect()}
    caught = sum(a in group and group[a] == group.get(b) for a, b in links)
    print(f"{caught} of {len(links)} links")
    assert len(links) > 20 and caught >= 0.9 * len(links)


def test_simhash_has_a_block_for_each_class_of_features(spark):
    line = " ".join(f"word{i}" for i in range(40))
    rows = [("a", line), ("b", line.replace("word7", "other")), ("c", "abc"), ("d", line + " word3 word3")]
    got = {(r["id"], r["kind"]): r for r in line_dedup.simhashes(spark.createDataFrame(rows, "key string, norm string")).collect()}
    ids = {k: spark.sql(f"SELECT xxhash64('{k}') AS h").first()["h"] for k, _ in rows}
    hashes = {w: spark.sql(f"SELECT xxhash64('{w}') AS h").first()["h"] % 2**64 for w in line.split()}
    for c in range(line_dedup.BLOCKS):
        own = [h for h in hashes.values() if h >> 61 == c]
        bits = sum(1 << i for i in range(32) if 2 * sum(h >> (i if i < 16 else i + 16) & 1 for h in own) > len(own))
        assert got[ids["a"], 0][f"s{c}"] % 2**32 == bits
    same = sum(got[ids["a"], 0][f"s{c}"] == got[ids["b"], 0][f"s{c}"] for c in range(line_dedup.BLOCKS))
    assert same >= line_dedup.BLOCKS - 2
    assert sum(x == y for x, y in zip(tuple(got[ids["d"], 0])[2:10], tuple(got[ids["a"], 0])[2:10], strict=True)) >= line_dedup.BLOCKS - 1 and (ids["c"], 1) in got and (ids["c"], 0) not in got


def test_line_dedup_strip(spark):
    line = "this very line stands in two documents"
    rows = [(2, line + "\nand this one only here in two"), (1, line), (3, line), (4, None), (5, ""), (6, "tiny")]
    docs = table(spark, rows).selectExpr("*", "doc_id AS n_chars")
    kept = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.strip(docs).collect()}
    assert kept == {1: (line, 1), 2: ("and this one only here in two", 29), 4: (None, 4), 5: ("", 5), 6: ("tiny", 6)}
    assert line_dedup.strip(docs).columns == docs.columns
    assert line_dedup.strip(docs.limit(0)).count() == 0
    report = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["removed_lines"]) for r in line_dedup.report(docs).collect()}
    assert report == {1: (1, 0, ""), 2: (2, 1, "0"), 3: (1, 1, "0"), 4: (0, 0, ""), 5: (1, 0, ""), 6: (1, 0, "")}


def test_left_lines_of_a_block_are_compared_in_its_join(spark):
    rng = random.Random(5)
    base_bits = [rng.getrandbits(31) for _ in range(8)]
    bits = {i: [x ^ (rng.getrandbits(31) & (rng.getrandbits(31) if i % 2 else 0)) for x in base_bits] for i in range(12)}
    hashed = spark.createDataFrame([(i, 0, *v) for i, v in bits.items()], "id bigint, kind int, " + ", ".join(f"{s} int" for s in line_dedup.HASHES))
    rest = spark.createDataFrame([(i % 2, 0, i, i) for i in range(12)], "block bigint, kind int, a bigint, ra bigint")
    other = spark.createDataFrame([(i % 2, 0, i, i, i < 4) for i in range(12)], "block bigint, kind int, b bigint, rb bigint, mb boolean")
    found = line_dedup.left_pairs(rest, other, hashed)
    near = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(bits[a], bits[b], strict=True)) <= line_dedup.DISTANCE
    expected = [(a, b) for a in range(12) for b in range(12) if a % 2 == b % 2 and a != b and (b < 4 or a < b) and near(a, b)]
    assert sorted((r.a, r.b) for r in found.collect()) == expected and expected
    joins = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x]
    assert "bit_count" in joins[0]


def test_short_lines_left_in_a_block_leave_its_join_as_links_only(spark):
    texts = {i: f"line {i % 2} of some words that tell nothing else {'abcdefghij'[i] * 14}" for i in range(8)} | {8: "z" * 300, 9: "z" * 299 + "y"}
    texts[1] = texts[0].replace("words", "wards")
    each = spark.createDataFrame([(str(i).encode(), t) for i, t in texts.items()], "key binary, norm string")
    ids = {r.i: r.id for r in each.select(F.col("key").cast("string").cast("int").alias("i"), F.xxhash64("key").alias("id")).collect()}
    # all lie in one block and have equal hashes, so only their texts tell them apart
    hashed = spark.createDataFrame([(v, 0, *[1] * 8) for v in ids.values()], "id bigint, kind int, " + ", ".join(f"{s} int" for s in line_dedup.HASHES))
    rest = spark.createDataFrame([(1, 0, v, v) for v in ids.values()], "block bigint, kind int, a bigint, ra bigint")
    other = spark.createDataFrame([(1, 0, v, v, False) for v in ids.values()], "block bigint, kind int, b bigint, rb bigint, mb boolean")
    found = line_dedup.left_pairs(rest, other, hashed, line_dedup.short_texts(rest, other, each)).collect()
    assert {(frozenset((r.a, r.b)), r.sure) for r in found} == {(frozenset((ids[0], ids[1])), True), (frozenset((ids[8], ids[9])), False)}


def test_staged_tables_of_a_step_go_and_its_results_stay(spark):
    def folders(df):
        return {f.rsplit("/", 2)[0].removeprefix("file://").removeprefix("file:") for f in df.inputFiles()}

    with base.passing(spark):
        with base.passing(spark):
            inner, step = base.staged(spark.range(3).toDF("x"), "inner"), base.staged(spark.range(4).toDF("x"), "step", keep=True)
            gone = folders(inner)
        assert not any(os.path.exists(f) for f in gone) and step.count() == 4
        result = base.staged(step, "result", keep=True)
        gone = folders(step)
    assert not any(os.path.exists(f) for f in gone) and result.count() == 4


@pytest.mark.parametrize("run", [line_dedup.report, line_dedup.strip, ngram_join.components, ngram_join.keep_one])
def test_only_tables_that_a_result_reads_stay(spark, run):
    rng = random.Random(8)
    rows = [(i, words(rng, 30) + "\n" + words(rng, 9)) for i in range(12)]
    docs = table(spark, [*rows, *[(100 + i, t) for i, t in rows[:5]]])
    before = set(os.listdir(base.work_dir(spark).removeprefix("file://")))
    assert run(docs).count() > 0
    assert len(set(os.listdir(base.work_dir(spark).removeprefix("file://"))) - before) <= 2
