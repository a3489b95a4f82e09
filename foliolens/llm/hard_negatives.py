"""Hard negatives by angular triangle filtering, scored by integer inner products.

1. A component ``x`` becomes ``floor(256 * x)``. Reference directions are taken from at most ``SAMPLE`` rows (the least hashes),
   each farthest from those before; every row stores its norm and its angle to each of them.
2. Rows lie in chunks of about ``ROWS``, ordered by label, nearest direction and angle to it; a chunk is known by the ranges of
   its labels, norms and angles, which go to the tasks in pages of at most ``PAGE`` chunks.
3. By the triangle inequality the angle between an anchor and a row lies between the difference and the sum of their angles
   to a direction. The cosines of both, times the norms and widened by ``SLACK`` for rounding, bound the score. The same
   holds for a chunk with its ranges.
4. Positives: the anchor's own chunk gives a least score; chunks, then rows that can reach it are scored.
5. Negatives: each positive opens a window of scores; chunks, then rows whose bounds meet a window are scored, and the best of
   each window stay. Anchors stream past one chunk in memory at a time.

Defined results: rows with a null id, label, vector or component, or a component that is not finite, take no part. Equal rows
(id, label, vector) count once; different rows that share an id are different rows. Shorter vectors count as filled up with
zeros. Scores must fit 64 bits; larger components are refused. Ties go to the smaller id. No rows give no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import base

REFERENCES = 12
SAMPLE = 4096
ROWS = 8192
PAGE = 65_536
BLOCK = 64  # anchors that are compared with a chunk at once
SLACK = 1e-6  # of the product of norms; angles from arccos are off by less than 2e-7
EVERY = 100
TOP = 5
LEAST, MOST = 80, 100  # percent of the positive's score
ROW = "vec_id bigint, label bigint, key bigint, q array<bigint>, norm double, angles array<double>"


def quantised(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, key, q) of the rows that take part; ``key`` tells rows that share an id apart."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), vector.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    q = F.transform("v", lambda x: F.floor(x * 256).cast("long"))
    fits = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x * 256) * (x * 256)) < 2.0**62
    safe = rows.select("vec_id", "label", F.when(fits, q).otherwise(F.raise_error(F.lit("scores of these vectors do not fit 64 bits"))).alias("q"))
    return safe.select("vec_id", "label", F.xxhash64("label", "q").alias("key"), "q").distinct()


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    counts = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), size), column.flatten().to_numpy(zero_copy_only=False).dtype)
    out[np.arange(size) < counts[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def directions(sample: np.ndarray, most: int) -> np.ndarray:
    """Unit vectors: the mean of the sample, then each time the row farthest in angle from all chosen ones."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0][:, None]
    if not len(unit):
        return np.eye(1, max(1, sample.shape[1]))
    first = unit.mean(0)
    chosen = [first / np.linalg.norm(first) if np.linalg.norm(first) > 1e-9 else unit[0]]
    near = unit @ chosen[0]
    while len(chosen) < most and near.min() < 1 - 1e-9:
        chosen.append(unit[near.argmin()])
        near = np.maximum(near, unit @ chosen[-1])
    return np.array(chosen)


def measured(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """``rows`` with norm and angles; a zero vector has the angles of the right angle and norm 0."""
    def run(batch: pa.RecordBatch):
        q = matrix(batch.column("q"), references.shape[1])
        x = q.astype(float)
        norm = np.linalg.norm(x, axis=1)
        cosine = x @ references.T / np.where(norm > 0, norm, 1)[:, None]
        angles = np.arccos(np.clip(cosine, -1, 1))
        yield {c: batch.column(c) for c in ("vec_id", "label", "key")} | {"q": base.lists(q.ravel(), [q.shape[1]] * len(q), pa.int64()), "norm": norm, "angles": base.lists(angles.ravel(), [angles.shape[1]] * len(q), pa.float64())}

    return base.map_arrow(rows, run, ROW)


def bounds(theta: np.ndarray, norm: np.ndarray, low: np.ndarray, high: np.ndarray, n_low: np.ndarray, n_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor (angles, norm) with each range of angles and norms: two tables, anchors by ranges."""
    nearest = np.zeros((len(theta), len(low)))
    farthest = np.full((len(theta), len(low)), np.pi)
    for r in range(theta.shape[1]):
        t, a, b = theta[:, r, None], low[None, :, r], high[None, :, r]
        np.maximum(nearest, np.maximum(a - t, t - b), out=nearest)
        np.minimum(farthest, np.where(t + b <= np.pi, t + b, np.where(t + a >= np.pi, 2 * np.pi - t - a, np.pi)), out=farthest)
    up, down = np.cos(nearest), np.cos(np.maximum(farthest, nearest))
    slack = SLACK * norm[:, None] * n_high + 2
    return norm[:, None] * down * np.where(down >= 0, n_low, n_high) - slack, norm[:, None] * up * np.where(up >= 0, n_high, n_low) + slack


class Rows:
    """A table of rows as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids, self.labels, self.keys, self.norm = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "key", "norm"))
        size = max([0, *np.diff(batch.column("q").offsets.to_numpy())])
        self.q = matrix(batch.column("q"), size)
        self.angles = matrix(batch.column("angles"), max([0, *np.diff(batch.column("angles").offsets.to_numpy())]))
        self.real = self.q.astype(float)

    def scores(self, q: np.ndarray, norm: float, at: np.ndarray) -> np.ndarray:
        """Integer inner products; as floating point where no sum can leave the exact range."""
        if norm * self.norm.max(initial=0) < 2.0**52:
            return (self.real[at] @ q.astype(float)).astype(np.int64)
        return self.q[at] @ q

    def best(self, at: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
        """Places in ``at`` of the first rows by score and id."""
        if len(at) > 4 * top:
            edge = -np.partition(-scores, top - 1)[top - 1]
            keep = np.flatnonzero(scores >= edge)
        else:
            keep = np.arange(len(at))
        return keep[np.lexsort((self.keys[at[keep]], self.ids[at[keep]], -scores[keep]))[:top]]


FOUND = "anchor_id bigint, anchor_key bigint, positive_id bigint, positive_key bigint, positive_score bigint, negative_id bigint, negative_key bigint, negative_score bigint"
ANCHOR = ROW + ", least bigint, windows array<struct<score:bigint,id:bigint,key:bigint>>"


def meet(rows: DataFrame, pairs: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(rows of a chunk, anchors)`` for the anchors sent to each chunk; one chunk and one batch of anchors are in memory."""
    arrow = base._arrow_schema(rows.sparkSession, schema)
    wide = rows.withColumn("least", F.lit(None).cast("long")).withColumn("windows", F.lit(None).cast("array<struct<score:bigint,id:bigint,key:bigint>>"))
    both = wide.withColumn("side", F.lit(0)).unionByName(pairs.withColumn("side", F.lit(1)))
    dealt = both.repartition("chunk").sortWithinPartitions("chunk", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, own = None, [], None
        for batch in batches:
            chunk, side = batch.column("chunk").to_numpy(), batch.column("side").to_numpy()
            turns = np.flatnonzero((np.diff(chunk) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *turns], [*turns, len(chunk)], strict=True):
                some = batch.slice(a, b - a)
                if side[a] == 0:
                    if own != chunk[a]:
                        held, parts, own = None, [], chunk[a]
                    parts.append(some)
                elif own == chunk[a]:
                    held = held or Rows(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])
                    for start in range(0, b - a, BLOCK):
                        out = fn(held, some.slice(start, BLOCK))
                        if out:
                            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return dealt.mapInArrow(run, schema)


def positives_in(top: int, own: bool):
    """Best rows of the anchor's label in a chunk; in its own chunk all rows are compared, elsewhere those that can reach ``least``."""
    def fn(rows: Rows, batch: pa.RecordBatch) -> list[dict]:
        anchors, least = Rows(batch), batch.column("least").to_pylist()
        _, high = bounds(anchors.angles, anchors.norm, rows.angles, rows.angles, rows.norm, rows.norm)
        out = []
        for i in range(batch.num_rows):
            same = (rows.labels == anchors.labels[i]) & ((rows.ids != anchors.ids[i]) | (rows.keys != anchors.keys[i]))
            if not own and least[i] is not None:
                same &= high[i] >= least[i]
            at = np.flatnonzero(same)
            scores = rows.scores(anchors.q[i], anchors.norm[i], at)
            out += [{"anchor_id": anchors.ids[i], "anchor_key": anchors.keys[i], "score": scores[k], "id": rows.ids[at[k]], "key": rows.keys[at[k]]} for k in rows.best(at, scores, top)]
        return out
    return fn


def negatives_in(top: int, least: int, most: int):
    """Best rows of other labels in each window of an anchor."""
    def fn(rows: Rows, batch: pa.RecordBatch) -> list[dict]:
        anchors, windows = Rows(batch), batch.column("windows").to_pylist()
        low, high = bounds(anchors.angles, anchors.norm, rows.angles, rows.angles, rows.norm, rows.norm)
        out = []
        for i, wanted in enumerate(windows):
            meets = np.zeros(len(rows.ids), bool)
            for w in wanted:
                meets |= (100 * high[i] >= least * w["score"]) & (100 * low[i] <= most * w["score"])
            at = np.flatnonzero(meets & (rows.labels != anchors.labels[i]))
            scores = rows.scores(anchors.q[i], anchors.norm[i], at)
            for w in wanted:
                # the limits are rounded as whole numbers of any size, so no product leaves 64 bits
                inside = np.flatnonzero((scores >= -(-least * w["score"] // 100)) & (scores <= most * w["score"] // 100))
                for k in rows.best(at[inside], scores[inside], top):
                    out.append({"anchor_id": anchors.ids[i], "anchor_key": anchors.keys[i], "positive_id": w["id"], "positive_key": w["key"], "positive_score": w["score"],
                                "negative_id": rows.ids[at[inside[k]]], "negative_key": rows.keys[at[inside[k]]], "negative_score": scores[inside[k]]})
        return out
    return fn


def sent(anchors: DataFrame, summaries: DataFrame, references: int, chunks: int, negatives: bool, least: int = LEAST, most: int = MOST) -> DataFrame:
    """``anchors`` once for each chunk whose bounds let it hold wanted rows; the chunk they lie in stays out for positives."""
    names = [c for c in summaries.columns if c != "chunk"]
    out = None
    for page in range(0, max(1, chunks), PAGE):
        some = summaries.where((F.col("chunk") >= page) & (F.col("chunk") < page + PAGE)).toPandas()
        table = anchors.sparkSession.sparkContext.broadcast({c: some[c].to_numpy() for c in ["chunk", *names]})

        def run(batch: pa.RecordBatch, table=table):
            s = table.value
            low, high = (np.stack([s[f"{side}{r}"] for r in range(references)], 1).reshape(-1, references) for side in ("low", "high"))
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                a = Rows(part)
                down, up = bounds(a.angles, a.norm, low, high, s["norm_low"], s["norm_high"])
                if negatives:
                    meets = np.zeros(down.shape, bool)
                    for i, wanted in enumerate(part.column("windows").to_pylist()):
                        for w in wanted:
                            meets[i] |= (100 * up[i] >= least * w["score"]) & (100 * down[i] <= most * w["score"])
                    meets &= (s["label_low"] != a.labels[:, None]) | (s["label_high"] != a.labels[:, None])
                else:
                    floor = np.array([-np.inf if x is None else x for x in part.column("least").to_pylist()])
                    meets = (up >= floor[:, None]) & (s["label_low"] <= a.labels[:, None]) & (s["label_high"] >= a.labels[:, None])
                    meets &= s["chunk"] != part.column("home").to_numpy()[:, None]
                who, where = np.nonzero(meets)
                taken = part.take(pa.array(who))
                yield {"chunk": s["chunk"][where]} | {c: taken.column(c) for c in ("vec_id", "label", "key", "q", "norm", "angles", "least", "windows")}

        found = base.map_arrow(anchors, run, f"chunk int, {ANCHOR}")
        out = found if out is None else out.unionByName(found)
    return out


def _first(found: DataFrame, by: list[str], order: list[Column], top: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)


def mine(table: DataFrame, every: int = EVERY, top: int = TOP, least: int = LEAST, most: int = MOST, references: int = REFERENCES, chunk_rows: int = ROWS,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): per anchor (id divisible by ``every``) and each of its
    first ``top`` positives the first ``top`` rows of other labels that score ``least`` to ``most`` percent of the positive."""
    small = base.staged(quantised(table, id_col, vector_col, label_col), "quantised")
    shape = small.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("d")).first()
    sample = small.orderBy(F.xxhash64("vec_id", "key"), "vec_id").limit(SAMPLE).select("q").toArrow().column("q").combine_chunks()
    chosen = directions(matrix(sample, shape["d"] or 1).astype(float), references)
    chunks = max(1, -(-shape["n"] // chunk_rows))
    nearest = F.array_position("angles", F.array_min("angles"))
    dealt = measured(small, chosen).repartitionByRange(chunks, "label", nearest, F.array_min("angles"), "vec_id", "key").withColumn("chunk", F.spark_partition_id())
    rows = base.staged(dealt, "rows")
    ranges = [f(F.col("angles")[r]).alias(f"{side}{r}") for side, f in (("low", F.min), ("high", F.max)) for r in range(len(chosen))]
    summaries = base.staged(rows.groupBy("chunk").agg(F.min("label").alias("label_low"), F.max("label").alias("label_high"), F.min("norm").alias("norm_low"), F.max("norm").alias("norm_high"), *ranges), "chunks")
    last = (summaries.agg(F.max("chunk")).first()[0] or 0) + 1

    empty = [F.lit(None).cast("long").alias("least"), F.lit(None).cast("array<struct<score:bigint,id:bigint,key:bigint>>").alias("windows")]
    anchors = rows.where(F.col("vec_id") % every == 0)
    pair = "anchor_id bigint, anchor_key bigint, score bigint, id bigint, key bigint"
    by, order = ["anchor_id", "anchor_key"], [F.desc("score"), F.col("id"), F.col("key")]
    near = base.staged(meet(rows, anchors.select("*", *empty), positives_in(top, True), pair), "near")
    floor = near.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= top, F.min("score")).alias("least"))
    whose = (F.col("vec_id") == F.col("anchor_id")) & (F.col("key") == F.col("anchor_key"))
    known = anchors.join(floor, whose, "left").drop("anchor_id", "anchor_key").withColumnRenamed("chunk", "home").withColumn("windows", empty[1])
    far = meet(rows, sent(known, summaries, len(chosen), last, False), positives_in(top, False), pair)
    positive = _first(near.unionByName(far), by, order, top).withColumnRenamed("key", "positive_key")
    windows = positive.groupBy(*by).agg(F.collect_list(F.struct("score", "id", F.col("positive_key").alias("key"))).alias("windows"))  # at most ``top``
    asked = base.staged(anchors.join(windows, whose).drop("anchor_id", "anchor_key", "chunk").withColumn("least", empty[0]), "asked")
    found = meet(rows, sent(asked, summaries, len(chosen), last, True, least, most), negatives_in(top, least, most), FOUND)
    ranked = _first(found, [*by, "positive_id", "positive_key"], [F.desc("negative_score"), F.col("negative_id"), F.col("negative_key")], top)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
