"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Words are runs of letters and digits, lower-cased. A term of a template weighs ``ln((1 + N) / (1 + df)) + 1`` with counts
over all documents; any other word weighs as one that no document holds. Lines and sentences (also over line ends) of the
whole text are compared with notices and headers (they stand anywhere), the whole text with whole license texts. The best
template of the best unit with a cosine of at least ``threshold`` (``file_threshold`` for whole texts) is the document's license.

A license file is one that is like a whole license text, or that has a license and the name of a license file; a header
alone makes none. It speaks for its directory and all below it. A document without a license of its own takes that of the
nearest ancestor directory: the distinct directories are expanded to their ancestors and joined to the directories that
hold license files; documents are joined to directories only, never to each other.

Defined results: a null or empty text has no license of its own; a null path is in no directory and inherits nothing;
equal cosines go to the template named first in order; several license files in a directory: the greatest cosine, then
the least path; repeated rows each get their result; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base
from .decontaminate import normal_words
from .license_texts import FILES, NOTICES

THRESHOLD = 0.75
FILE_THRESHOLD = 0.6
# names of license files: the word, a number, a license after a dash, an ending of text files
FILE_NAME = r"(?i)(^|/)(un)?(licen[sc]e|copying|copyright|notice)\d*(-[a-z0-9.]+)?(\.(txt|md|rst|html))?$"
_U = np.uint64


class Space:
    """Terms of the templates, sorted by hash, and the term frequencies of each template."""

    def __init__(self, notices: list[tuple[str, str]], files: list[tuple[str, str]]):
        self.names = [name for name, _ in [*notices, *files]]
        self.whole = np.arange(len(self.names)) >= len(notices)
        words = [normal_words(t.encode()) for _, t in [*notices, *files]]
        vocabulary = sorted({w for ws in words for w in ws})
        hashes, _ = base.word_hashes(vocabulary, base.LETTERS)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        place = {vocabulary[i]: k for k, i in enumerate(order)}
        self.tf = np.zeros((len(self.hashes), len(words)))
        for j, ws in enumerate(words):
            for w in ws:
                self.tf[place[w], j] += 1

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def _words(texts: list[bytes]):
    """(first, last, word hashes, owner text, line number, sentence number) of slices; a sentence ends at a mark or blank line."""
    for first, last in base.slices(texts):
        hashes, counts = base.word_hashes(texts[first:last], base.LETTERS, lower=True)
        data, _ = base.joined(texts[first:last])
        start, _ = base.word_spans(base.LOWER[data], base.LETTERS)
        stop = np.isin(data, list(b".!?;"))
        stop[:-1] &= ~base.SPACES[data[1:]]
        end = data == 10
        line = np.cumsum(stop | end)[start]
        stop[:-1] |= end[:-1] & end[1:]
        owner = np.repeat(np.arange(last - first), counts)
        yield first, last, hashes, owner, line, np.cumsum(stop)[start] + owner  # a text ends a sentence too


def document_counts(docs: DataFrame, space: Space) -> tuple[int, np.ndarray]:
    """Number of documents and, per template term, of documents that hold it."""
    size = len(space.hashes)

    def run(batches):
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for first, last, hashes, owner, _, _ in _words(base.byte_strings(batch.column("text"))):
                term = space.terms(hashes)
                pair = np.unique(owner[term >= 0] * size + term[term >= 0])
                total += np.bincount(pair % size, minlength=size)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(size)], pa.int32()), pa.array([n, *total.tolist()], pa.int64())], names=["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()  # one row per term
    found = {r["term"]: r["n"] for r in rows}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(size)], float)


def _best(unit: np.ndarray, hashes: np.ndarray, term: np.ndarray, weights: np.ndarray, templates: np.ndarray, other: float, threshold: float):
    """(unit, template, cosine) of units whose best cosine reaches the threshold; units are sorted numbers per word."""
    inside = term >= 0
    size = len(weights)
    pair, tf = np.unique(unit[inside] * size + term[inside], return_counts=True)
    if not len(pair):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    of, value = pair // size, tf * weights[pair % size]
    begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    dots = np.add.reduceat(value[:, None] * templates[pair % size], begin, axis=0)
    square = np.add.reduceat(value ** 2, begin)
    units = of[begin]
    # the words outside the templates only lengthen a vector: who misses the threshold without them misses it with them
    maybe = dots.max(axis=1) >= threshold * np.sqrt(square)
    units, dots, square = units[maybe], dots[maybe], square[maybe]
    if not len(units):
        return units, units, np.zeros(0)
    rest = ~inside
    slot = np.searchsorted(units, unit[rest])
    hit = (slot < len(units)) & (units[np.minimum(slot, len(units) - 1)] == unit[rest])
    key = np.stack([slot[hit].astype(_U), hashes[rest][hit]])
    if key.shape[1]:
        distinct, count = np.unique(key, axis=1, return_counts=True)
        square = square + np.bincount(distinct[0].astype(np.int64), (count * other) ** 2, minlength=len(units))
    cosine = dots / np.sqrt(square)[:, None]
    top = np.round(cosine, 9).argmax(axis=1)
    value = cosine[np.arange(len(units)), top]
    good = value >= threshold
    return units[good], top[good], value[good]


def own_licenses(docs: DataFrame, notices: list[tuple[str, str]] | None = None, files: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, file_threshold: float = FILE_THRESHOLD) -> DataFrame:
    """(doc_id, path, license, cosine, is_file) of every row of ``docs`` (doc_id, path, text)."""
    space = Space(NOTICES if notices is None else notices, FILES if files is None else files)
    n, df = document_counts(docs, space)
    weights = np.log((1 + n) / (1 + df)) + 1
    other = float(np.log(1 + n) + 1)
    vectors = space.tf * weights[:, None]
    vectors /= np.sqrt((vectors ** 2).sum(axis=0))
    kinds = [np.flatnonzero(~space.whole), np.flatnonzero(space.whole)]

    def run(batch: pa.RecordBatch):
        rows = batch.num_rows
        license_, cosine, is_file = np.full(rows, -1), np.zeros(rows), np.zeros(rows, bool)
        for first, _, hashes, owner, line, sentence in _words(base.byte_strings(batch.column("text"))):
            term = space.terms(hashes)
            if not len(owner):
                continue
            for unit, least, whole in ((line, threshold, 0), (sentence, threshold, 0), (owner, file_threshold, 1)):
                if not len(kinds[whole]):
                    continue
                text_of = np.zeros(int(unit[-1]) + 1, np.int64)
                text_of[unit] = owner
                units, top, value = _best(unit, hashes, term, weights, vectors[:, kinds[whole]], other, least)
                for u, t, v in zip(text_of[units], kinds[whole][top], value, strict=True):
                    is_file[first + u] |= bool(whole)
                    if round(v, 9) > round(cosine[first + u], 9) or (license_[first + u] < 0):
                        license_[first + u], cosine[first + u] = t, v
        yield {"doc_id": batch.column("doc_id"), "path": batch.column("path"), "license": [space.names[i] if i >= 0 else None for i in license_],
               "cosine": np.round(cosine, 6), "is_file": is_file}

    found = base.map_arrow(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, path string, license string, cosine double, is_file boolean")
    return found.withColumn("is_file", F.col("is_file") | (F.col("license").isNotNull() & F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))))


def directory(path: Column) -> Column:
    """The path without its last part; '' is the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def scan(docs: DataFrame, path: Column, notices: list[tuple[str, str]] | None = None, files: list[tuple[str, str]] | None = None,
         threshold: float = THRESHOLD, file_threshold: float = FILE_THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, path, license, origin, cosine, from_path): origin is header, file, inherited or none."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), path.alias("path"), F.col(f"`{text_col}`").alias("text"))
    own = base.staged(own_licenses(rows, notices, files, threshold, file_threshold).withColumn("dir", directory(F.col("path"))), "own")
    files = (own.where("is_file AND dir IS NOT NULL").groupBy("dir")
             .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "license")).alias("f")).select(F.col("dir").alias("ancestor"), "f"))
    dirs = own.where("license IS NULL AND dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", F.lit(0)).otherwise(F.size(parts))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("ancestor")))
    reached = dirs.select("dir", F.inline(ups)).join(files, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "f")).alias("best"))
    found = base.salted_join(own, reached, ["dir"])
    inherits = F.col("license").isNull() & F.col("best").isNotNull()
    return found.select("doc_id", "path", F.when(inherits, F.col("best.f.license")).otherwise(F.col("license")).alias("license"),
                        F.when(inherits, "inherited").when(F.col("license").isNull(), "none").when(F.col("is_file"), "file").otherwise("header").alias("origin"),
                        F.when(F.col("license").isNotNull(), F.col("cosine")).alias("cosine"), F.when(inherits, F.col("best.f.path")).when(F.col("license").isNotNull(), F.col("path")).alias("from_path"))
