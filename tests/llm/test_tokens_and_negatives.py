"""Alignment, hard negatives and SentencePiece encoding against brute force and the libraries."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from functools import reduce

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from foliolens.llm import hard_negatives, piece_bpe, token_alignment

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ATOMS = [" ", "  ", "a", "b", "\n", "\n ", "▁", "é", "日", "本", "<s>", "<0x0A>", "<|endoftext|>", "x" * 70, "the ", "\u0000", "ing", "👩‍💻", ".", " ▁ ", "\t", "  ", "\x1c ", "'s", "12"]
TEXTS = ["", " ", "   ", "one two", "trailing \n", "日本語 のテキスト", "x" * 3000, "ab" * 40 + " " + "zyx" * 50, "▁", "a ▁ b", "\n  indented\n\n  again"]


def made(seed, n):
    rng = random.Random(seed)
    return TEXTS + ["".join(rng.choice(ATOMS) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, "x", t, 0, "y") for i, t in rows], "doc_id bigint, ids string, text string, n_a int, unit string")


# ------------------------------------------------------------------ SentencePiece

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_are_those_of_the_library(spark, library):
    rows = [*enumerate(made(3, 600)), (3, TEXTS[3]), (None, "null id"), (7000, None)]
    vocabulary = piece_bpe.Vocabulary(spark, PIECES)
    got = piece_bpe.decode(piece_bpe.encode(frame(spark, rows), vocabulary), vocabulary).collect()
    want = sorted((repr(i), tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t in rows)
    assert sorted((repr(r["doc_id"]), tuple(r["ids"]), r["text"]) for r in got) == want and not any(r["differs"] for r in got)


def test_piece_report_and_string_ids(spark, library):
    docs = spark.createDataFrame([("k", "some text"), ("n", None)], "doc_id string, text string")
    vocabulary = piece_bpe.Vocabulary(spark, PIECES)
    got = {r["doc_id"]: r for r in piece_bpe.report(piece_bpe.decode(piece_bpe.encode(docs, vocabulary), vocabulary)).collect()}
    ids = library.encode("some text")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got["k"]["n_tokens"], got["k"]["ids_sha256"], got["k"]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha("some text"))
    assert (got["n"]["n_tokens"], got["n"]["ids_sha256"], got["n"]["decoded_sha256"]) == (0, sha(""), sha(""))


def test_both_agendas_agree(library):
    with open(PIECES, "rb") as f:
        encoder = piece_bpe.Encoder(f.read())
    units = ["▁" + t.replace(" ", "▁") for t in made(9, 500)]
    units = [u for u in units if len(u) <= piece_bpe.SHORT]
    assert [encoder.long(u) for u in units] == encoder.short(units)


def test_table_of_units_is_emptied(monkeypatch, library):
    monkeypatch.setattr(piece_bpe, "REMEMBERED", 3)
    with open(PIECES, "rb") as f:
        encoder = piece_bpe.Encoder(f.read())
    for text in ("a b c", "b c d e f g", "a b a x", "c d"):
        assert list(memoryview(encoder.encode([text])[0][0]).cast("i")) == library.encode(text)


def test_a_difference_to_the_library_is_shown(monkeypatch):
    with open(PIECES, "rb") as f:
        encoder = piece_bpe.Encoder(f.read())
    monkeypatch.setattr(encoder, "merge", lambda units: [b"five" for _ in units])
    assert encoder.encode(["abc", ""])[1] == [True, False]


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        piece_bpe.Encoder(b"\x0a\x07\x0a\x05<unk>\x12\x02\x18\x01")


def test_pieces_of_no_rows(spark):
    vocabulary = piece_bpe.Vocabulary(spark, PIECES)
    assert piece_bpe.report(piece_bpe.decode(piece_bpe.encode(frame(spark, []), vocabulary), vocabulary)).count() == 0


# ------------------------------------------------------------------ alignment

@pytest.fixture(scope="module")
def aligner():
    with open(BYTES, "rb") as a, open(PIECES, "rb") as b:
        return token_alignment.Aligner(a.read(), b.read())


@pytest.fixture(scope="module")
def aligned_by_hand(aligner, library):
    whole = tokenizers.Tokenizer.from_file(BYTES)
    whole.encode_special_tokens = True

    def groups(text):
        """Groups of a text by two pointers over whole encodings, None without tokens."""
        if not text:
            return None
        data, a, b = (" " + text).encode(), whole.encode(" " + text, add_special_tokens=False).ids, library.encode(text)
        parts_b = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(library.id_to_piece, b), strict=True)]
        parts_a = [aligner.bytes_a[i] for i in a]
        if b"".join(parts_a) != data or b"".join(parts_b) != data:
            return None
        out, i, j = [], 0, 0
        while i < len(a):
            x, y, na, nb = [a[i]], [b[j]], len(parts_a[i]), len(parts_b[j])
            i, j = i + 1, j + 1
            while na != nb:
                if na < nb:
                    x.append(a[i])
                    na += len(parts_a[i])
                    i += 1
                else:
                    y.append(b[j])
                    nb += len(parts_b[j])
                    j += 1
            out.append((x, y))
        return out

    return groups


@pytest.mark.parametrize(("chunk", "frequent"), [(20, 5), (100_000, 10**6), (7, 0)])
def test_alignment_of_a_corpus(spark, aligned_by_hand, monkeypatch, chunk, frequent):
    monkeypatch.setattr(token_alignment, "FAN", 3)
    rows = [*enumerate(made(5, 150)), (500, None), (501, "twice the same " * 9), (501, "twice the same " * 9), (None, "no id at all, but a text")]
    files = token_alignment.Vocabularies(spark, BYTES, PIECES)
    got = token_alignment.report(frame(spark, rows), files, chunk, frequent).collect()
    groups = [aligned_by_hand(t) for _, t in rows]
    links = [[(x[-1], y[-1]) for x, y in g or []] for g in groups]
    count = Counter(p for x in links for p in x)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(n, best.get(b, 0))
    want = []
    for (i, _), g, pairs in zip(rows, groups, links, strict=True):
        written = "|".join(",".join(map(str, x)) + ";" + ",".join(map(str, y)) for x, y in g or [])
        want.append((repr(i), sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), len(pairs), sum(count[p] == best[p[1]] for p in pairs), sum(count[p] for p in pairs),
                     hashlib.sha256(written.encode()).hexdigest() if g else ""))
    assert sorted((repr(r["doc_id"]), *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in got) == sorted(want)


def test_fragments_are_a_monoid(aligner):
    rng = random.Random(8)
    for text in ["ab cde  fgh.\nnew 日本 line " * 5, "zyxwvut" * 30, *made(6, 40)[11:]]:
        text = " " + text
        parts = token_alignment.cuts(text, 5, aligner.unit)
        found = aligner.fragments([text[a:b] for a, b, _, _ in parts], [(len(text[a:low].encode()), len(text[a:high].encode())) for a, b, low, high in parts])
        left = reduce(token_alignment.compose, found, token_alignment.EMPTY)
        while len(found) > 1:  # any bracketing
            i = rng.randrange(len(found) - 1)
            found[i:i + 2] = [token_alignment.compose(found[i], found[i + 1])]
        assert found[0] == left and token_alignment.compose(left, token_alignment.EMPTY) == left


def test_ranges_read_whole_units_and_stay_near(aligner):
    text = " " + "word " * 50 + "y" * 90 + " end"
    parts = token_alignment.cuts(text, 20, aligner.unit)
    assert [p[2] for p in parts] == [0, *[p[3] for p in parts[:-1]]] and parts[-1][3] == len(text)
    assert all(a <= low < high <= b for a, b, low, high in parts) and sum(b - a for a, b, _, _ in parts) < 3 * len(text)


def test_wide_rows_of_fragments_are_not_read_from_files(spark, monkeypatch):
    files = token_alignment.Vocabularies(spark, BYTES, PIECES)
    written = []
    monkeypatch.setattr(token_alignment.base, "staged", lambda df, name, keep=False: written.append(name) or df)
    text = "some words, déjà vu 12 " * 40
    rows = frame(spark, [(1, text), (2, text + "end"), (3, "short"), (4, None)])
    cut = {r["doc_id"]: (r["n_a"], r["n_b"], r["groups"], *zip(*sorted(zip(r["pairs"], r["counts"], strict=True)), strict=True)) for r in token_alignment.align(rows, files, 20).collect()}
    assert written == []
    whole = {r["doc_id"]: (r["n_a"], r["n_b"], r["groups"], *zip(*sorted(zip(r["pairs"], r["counts"], strict=True)), strict=True)) for r in token_alignment.align(rows, files, 10_000).collect()}
    assert cut == whole and len(cut) == 4


def test_alignment_of_no_rows_and_string_ids(spark):
    files = token_alignment.Vocabularies(spark, BYTES, PIECES)
    assert token_alignment.report(frame(spark, []), files).count() == 0
    got = token_alignment.align(spark.createDataFrame([("k", "ab cd")], "doc_id string, text string"), files).first()
    assert got["doc_id"] == "k" and got["groups"].count("|") == len(got["pairs"]) - 1


# ------------------------------------------------------------------ hard negatives

def brute_negatives(rows, every=100, top=5):
    import math
    ready = sorted({(i, y, tuple(math.floor(256 * c) for c in v)) for i, y, v in rows if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)})
    out = []
    for a in ready:
        if a[0] % every:
            continue
        score = {r: sum(x * y for x, y in zip(a[2], r[2], strict=False)) for r in ready if r != a}
        ranked = sorted(score, key=lambda r: (-score[r], r[0]))
        for p in [r for r in ranked if r[1] == a[1]][:top]:
            fits = [r for r in ranked if r[1] != a[1] and 80 * score[p] <= 100 * score[r] <= 100 * score[p]][:top]
            out += [(a[0], p[0], k, n[0], score[p], score[n]) for k, n in enumerate(fits, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, y, v, 1, "q") for i, y, v in rows], "vec_id bigint, label int, embedding array<float>, key int, q string")


def mined(df, **more):
    return sorted(tuple(r) for r in hard_negatives.mine(df, **more).collect())


def near_vectors(seed, n, size, centres=6):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(centres)]
    return [(i, rng.randrange(4), [rng.randrange(-500, 500) / 512 * 0.3 + c for c in middle[rng.randrange(centres)]]) for i in range(n)]


@pytest.mark.parametrize("chunk_rows", [40, 10_000])
def test_negatives_against_brute_force(spark, chunk_rows):
    rows = [(i, y, [float(round(c * 256) / 256) for c in v]) for i, y, v in near_vectors(1, 900, 8)]
    assert mined(vectors(spark, rows), chunk_rows=chunk_rows, references=5) == brute_negatives(rows)


def test_negatives_with_ties_nulls_and_a_hot_vector(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, i % 3, [1.0, 0.5, 0.0]) for i in range(250)] + [(i, 1, [0.75, 0.25, 0.125]) for i in range(250, 320)]
    rows += [(400, 1, [0.0, 0.0, 0.0]), (401, 2, [0.0, 0.0, 0.0]), (500, None, [1.0, 1.0, 1.0]), (501, 0, None), (502, 0, [1.0, None, 0.0]), (503, 0, [nan, 0.0, 0.0]), (504, 0, [inf, 0.0, 0.0]),
             (None, 0, [1.0, 0.5, 0.0]), (600, 0, [1.0]), (600, 0, [1.0]), (700, 2, []), (800, 1, [-1.0, -0.5, 0.0])]
    assert mined(vectors(spark, rows), chunk_rows=64) == brute_negatives(rows)


def test_bounds_hold_every_score():
    import numpy as np
    rng = np.random.default_rng(4)
    q = np.concatenate([rng.integers(-300, 300, (200, 6)), np.zeros((1, 6), np.int64), np.eye(6, dtype=np.int64) * 256, -np.eye(6, dtype=np.int64)])
    refs = hard_negatives.directions(q.astype(float), 4)
    norm = np.linalg.norm(q, axis=1)
    theta = np.arccos(np.clip(q @ refs.T / np.where(norm > 0, norm, 1)[:, None], -1, 1))
    low, high = hard_negatives.bounds(theta, norm, theta, theta, norm, norm)
    assert (low <= q @ q.T).all() and (q @ q.T <= high).all() and ((high - low) < 2 * norm[:, None] * norm + 9).mean() > 0.5
    a, b = theta[:50].min(0, keepdims=True), theta[:50].max(0, keepdims=True)
    low, high = hard_negatives.bounds(theta, norm, a, b, norm[:50].min(keepdims=True), norm[:50].max(keepdims=True))
    assert (low[:, 0] <= (q @ q[:50].T).min(1)).all() and ((q @ q[:50].T).max(1) <= high[:, 0]).all()


def test_negatives_of_no_rows_and_of_too_large_numbers(spark):
    assert mined(vectors(spark, [])) == []
    with pytest.raises(Exception, match="64 bits"):
        mined(vectors(spark, [(100, 0, [1e30]), (1, 1, [1.0])]))
    large = [(0, 0, [3000000.0, 1.0]), (1, 0, [2999999.0, 1.0]), (2, 1, [2900000.0, 1.0])]
    assert mined(vectors(spark, large)) == brute_negatives(large)
