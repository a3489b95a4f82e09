"""Quality classifier by co-training two views.

The *content* view reads the whole text (hashed words and style ratios), the *metadata* view everything about a document
but its text (source, language, length class). Each round both views are fitted on their own labelled rows, score all
unlabelled documents in a Spark job and hand their most confident pseudo-labels to the other view: the first of every
stratum (metadata fields and class) before the second of any, so rare sources and languages are not drowned. Both are
then calibrated on held-out labelled rows and combined by the evidence they showed there; the result scores all documents.

Only what enters a fit is bounded: ``labelled`` sampled labelled rows (the least by a hash of id and text, so the sample is
the same at every run) and ``pseudo`` pseudo-labels for each view over all rounds. Every round and the result read every document whole.

Defined results: a null text counts as empty; null metadata is a value of its own; labels without a quality or without a
document are ignored, several labels of one document count by their mean (ties: 1); without both labels the scores are the
share of good labels (0.5 without any); equal rows get equal scores each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base, quality_rules

WORDS = 1024  # hashed word features of the content view
FIELDS = 256  # hashed features of the metadata view
LABELLED, PSEUDO = 6000, 3000
ROUNDS, CONFIDENT = 3, 0.95
_U = np.uint64


def content_features(texts: list[bytes]) -> np.ndarray:
    """Word frequencies (logarithmic, of length 1 per text) and style ratios of whole texts."""
    m = quality_rules.measure(texts)
    out = np.zeros((len(texts), WORDS + 8), np.float32)
    for first, last in base.slices(texts):
        hashes, counts = base.word_hashes(texts[first:last], base.LETTERS, lower=True)
        owner = np.repeat(np.arange(last - first), counts)
        cell = owner * WORDS + (hashes & _U(WORDS - 1)).astype(np.int64)
        tf = np.log1p(np.bincount(cell, minlength=(last - first) * WORDS).reshape(-1, WORDS))
        out[first:last, :WORDS] = tf / np.maximum(np.sqrt((tf ** 2).sum(axis=1, keepdims=True)), 1e-9)
    words, chars = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1)
    style = (np.log1p(m["n_words"]) / 8, 5 * m["n_symbols"] / chars, m["n_dup_lines"] / np.maximum(m["n_lines"], 1), m["n_repeat_words"] / words, m["word_chars"] / words / 10,
             m["n_capitals"] / np.maximum(m["n_letters_ascii"], 1), m["n_letters_ascii"] / chars, np.ones(len(texts)))
    out[:, WORDS:] = np.column_stack(style)
    return out


def field_features(columns: list[list]) -> np.ndarray:
    """One hashed indicator per metadata field, and a constant."""
    n = len(columns[0])
    out = np.zeros((n, FIELDS + 1), np.float32)
    out[:, -1] = 1
    for number, values in enumerate(columns):
        keys, where = np.unique(np.array([f"{number}:{v!r}" for v in values]), return_inverse=True)
        hashes, _ = base.word_hashes([k.replace(" ", "_").encode() for k in keys])
        out[np.arange(n), (hashes & _U(FIELDS - 1)).astype(np.int64)[where]] = 1
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-3, steps: int = 120) -> np.ndarray:
    """Logistic regression by accelerated gradient steps; the step follows the features' largest eigenvalue."""
    x = x.astype(np.float32)
    total = weight.sum()
    v = np.ones(x.shape[1], np.float32)
    for _ in range(8):
        v = x.T @ (weight * (x @ v))
        size = float(np.linalg.norm(v))
        v /= max(size, 1e-9)
    rate = 1 / (0.25 * size / total + decay)
    w, ahead = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for k in range(steps):
        gradient = x.T @ (weight * (sigmoid(x @ ahead.astype(np.float32)) - y)) / total + decay * ahead
        new = ahead - rate * gradient
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling with smoothed targets."""
    good, bad = (y > 0.5).sum(), (y <= 0.5).sum()
    target = np.where(y > 0.5, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * score + b)
        g = np.array([((p - target) * score).sum(), (p - target).sum()])
        d = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(d * score ** 2).sum(), (d * score).sum()], [(d * score).sum(), d.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.0)), float(b)


@dataclass
class Model:
    """Weights of both views, their calibration and their evidence on held-out rows."""

    prior: float
    weights: list[np.ndarray] = field(default_factory=list)
    scale: list[tuple[float, float]] = field(default_factory=list)
    evidence: list[float] = field(default_factory=list)
    rounds: list[tuple[int, int]] = field(default_factory=list)

    def views(self, x: list[np.ndarray]) -> list[np.ndarray]:
        if not self.weights:
            return [np.full(len(v), self.prior) for v in x]
        return [sigmoid(a * (v @ w) + b) for v, w, (a, b) in zip(x, self.weights, self.scale, strict=True)]

    def combine(self, p: list[np.ndarray]) -> np.ndarray:
        if not self.weights:
            return p[0]
        odds = lambda q: np.log(np.clip(q, 1e-6, 1 - 1e-6) / np.clip(1 - q, 1e-6, 1))
        base_odds = odds(np.array(self.prior))
        return sigmoid(base_odds + sum(e * (odds(q) - base_odds) for e, q in zip(self.evidence, p, strict=True)))


def _gain(p: np.ndarray, y: np.ndarray, prior: float) -> float:
    """Share of the prior's log loss that a view explains, 0 to 1."""
    loss = lambda q: -np.mean(y * np.log(np.clip(q, 1e-6, 1)) + (1 - y) * np.log(np.clip(1 - q, 1e-6, 1)))
    return float(np.clip(1 - loss(p) / max(loss(np.full(len(y), prior)), 1e-9), 0, 1))


def co_train(labelled: list[np.ndarray], y: np.ndarray, hand_over, rounds: int = ROUNDS) -> Model:
    """Fit both views; every fifth labelled row is held out for calibration and evidence.

    ``hand_over(model)`` scores the unlabelled documents and returns for each view the features and pseudo-labels that the other gives it.
    """
    prior = float(y.mean()) if len(y) else 0.5
    held = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
        return Model(prior)
    model = Model(prior)
    given = [[(x[:0], y[:0])] for x in labelled]

    def fitted() -> None:
        model.weights = []
        for v, x in enumerate(labelled):
            more = sum(len(t) for _, t in given[v])
            trust = np.concatenate([np.ones((~held).sum()), np.full(more, 0.5)])
            model.weights.append(fit(np.concatenate([x[~held], *[g for g, _ in given[v]]]), np.concatenate([y[~held], *[t for _, t in given[v]]]), trust.astype(np.float32)))
        model.scale = [calibrate(x[held] @ w, y[held]) for x, w in zip(labelled, model.weights, strict=True)]

    for _ in range(rounds):
        fitted()
        new = hand_over(model)
        model.rounds.append((len(new[1][1]), len(new[0][1])))
        if not sum(model.rounds[-1]):
            break
        for v in range(2):
            given[v].append(new[v])
    fitted()
    gains = [_gain(p, y[held], prior) for p in model.views([x[held] for x in labelled])]
    model.evidence = [g / max(max(gains), 1e-9) for g in gains]
    return model


def _rows(docs: DataFrame, fields: list[str], id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{f}`").cast("string").alias(f"f{i}") for i, f in enumerate(fields)],
                       F.floor(F.log2(F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)) + 1)).cast("string").alias(f"f{len(fields)}"))


def _views(batch: pa.RecordBatch, n_fields: int) -> list[np.ndarray]:
    return [content_features(base.byte_strings(batch.column("text"))), field_features([batch.column(f"f{i}").to_pylist() for i in range(n_fields)])]


def _features(rows: DataFrame, chosen: DataFrame, n_fields: int) -> list[tuple]:
    """(h, y, content, metadata) of the chosen rows (doc_id, h, y), a table of fixed bound, in order of ``h``; only these reach the driver."""
    def run(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            a, b = _views(part, n_fields)
            yield {"h": part.column("h"), "y": part.column("y"), "a": [r.tobytes() for r in a.astype(np.float16)], "b": [r.tobytes() for r in b.astype(np.float16)]}

    picked = rows.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(chosen), "h")
    made = base.map_arrow(picked.select("h", "y", "text", *[f"f{i}" for i in range(n_fields)]), run, "h bigint, y double, a binary, b binary")
    found = {r["h"]: (r["y"], bytes(r["a"]), bytes(r["b"])) for r in made.toLocalIterator()}  # equal rows count once
    return [(h, *found[h]) for h in sorted(found)]


def _arrays(found: list[tuple]) -> tuple[list[np.ndarray], np.ndarray]:
    x = [np.frombuffer(b"".join(r[i] for r in found), np.float16).reshape(len(found), width).astype(np.float32) for i, width in ((2, WORDS + 8), (3, FIELDS + 1))]
    return x, np.array([r[1] for r in found], float)


def train(docs: DataFrame, labels: DataFrame, fields: list[str], labelled: int = LABELLED, pseudo: int = PSEUDO, rounds: int = ROUNDS, confident: float = CONFIDENT,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most ``labelled`` labelled documents and ``pseudo`` pseudo-labels a view, chosen from all unlabelled documents."""
    marks = (labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("doc_id"))
             .agg(F.when(F.avg(F.col(f"`{label_col}`")) >= 0.5, 1.0).otherwise(0.0).alias("y")))
    rows = _rows(docs, fields, id_col, text_col)
    n_fields = len(fields) + 1
    order = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).join(marks, "doc_id")
    chosen = base.staged(order.orderBy("h", "doc_id").limit(labelled).select("h", "y").distinct(), "sample")  # a top-n of n rows per task
    x, y = _arrays(_features(rows, chosen, n_fields))
    strata = [f"f{i}" for i in range(n_fields)]
    taken: list[set[int]] = [set(), set()]
    kind = rows.schema["doc_id"].dataType.simpleString()

    def hand_over(model: Model) -> list[tuple[np.ndarray, np.ndarray]]:
        def run(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                p = model.views(_views(part, n_fields))
                sure = np.flatnonzero((np.maximum(p[0], 1 - p[0]) >= confident) | (np.maximum(p[1], 1 - p[1]) >= confident))
                some = part.take(pa.array(sure))
                yield {c: some.column(c) for c in ("doc_id", "h", *strata)} | {"p0": p[0][sure], "p1": p[1][sure]}

        whole = rows.withColumn("h", F.xxhash64("doc_id", "text"))
        scored = base.map_arrow(whole, run, f"doc_id {kind}, h bigint, {', '.join(f'{f} string' for f in strata)}, p0 double, p1 double")
        sure = base.staged(scored.join(marks, "doc_id", "left_anti"), "confident")
        out = []
        for view in range(2):
            p, picks = F.col(f"p{1 - view}"), None
            most = max(1, pseudo // rounds)
            free = sure.where(~F.col("h").isin(list(taken[view]))) if taken[view] else sure  # at most ``pseudo`` numbers
            for label, q, part in ((1.0, p, model.prior), (0.0, 1 - p, 1 - model.prior)):
                # the share of each class follows the labels, so one view cannot drown the other in the frequent class
                quota = max(1, round(most * part))
                rank = F.row_number().over(Window.partitionBy(*strata).orderBy(q.desc(), "h"))
                each = free.where(q >= confident).dropDuplicates(["h"]).withColumn("q", q).withColumn("rank", rank).where(F.col("rank") <= quota)
                best = each.orderBy("rank", F.desc("q"), "h").limit(quota).select("h", F.lit(label).alias("y"))
                picks = best if picks is None else picks.unionByName(best)
            found = _features(rows, base.staged(picks, "picked"), n_fields)
            taken[view] |= {r[0] for r in found}
            views, target = _arrays(found)
            out.append((views[view], target))
        return out

    return co_train(x, y, hand_over, rounds)


def score(docs: DataFrame, model: Model, fields: list[str], keep_from: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_content, p_metadata, score, keep) of every document."""
    n_fields = len(fields) + 1

    def run(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            p = model.views(_views(part, n_fields))
            both = model.combine(p)
            yield {"doc_id": part.column("doc_id"), "p_content": p[0], "p_metadata": p[1], "score": both, "keep": both >= keep_from}

    return base.map_arrow(_rows(docs, fields, id_col, text_col), run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, p_content double, p_metadata double, score double, keep boolean")
