"""The pipeline's near-duplicate stage against a brute-force grouping by five-word shingles and Jaccard 0.8."""

from __future__ import annotations

import random

import corpus_pipeline
from test_dedup import shingles, table, words


def test_stage_keeps_one_of_each_group_of_five_words_and_four_fifths(spark):
    rng, rows = random.Random(12), []
    for size in (12, 40, 90, 200):
        for _ in range(8):
            text = words(rng, size, 4000).split()
            for changes in (0, 1, 2, 3):
                copy = list(text)
                for _ in range(changes):
                    copy[rng.randrange(size)] = f"v{rng.randrange(99)}"
                rows.append((len(rows), " ".join(copy)))

    def firsts(size, percent):
        sets, root = [shingles(t, size) for _, t in rows], list(range(len(rows)))
        for i, a in enumerate(sets):
            for j in range(i):
                if 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                    old, new = max(root[i], root[j]), min(root[i], root[j])
                    root = [new if r == old else r for r in root]
        return sorted(set(root))

    assert firsts(5, 80) != firsts(4, 85)
    got = corpus_pipeline.near_duplicate_stage(spark, table(spark, rows), "")
    assert sorted(r["doc_id"] for r in got.collect()) == firsts(5, 80)
