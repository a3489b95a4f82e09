"""Quality rules as a bitmask ledger.

Every document is measured once; every rule is evaluated once on the measurements and leaves one bit. The ledger
(measurements and bits) is a table: versioned policies are masks over it and ablations are bitwise aggregates, so
changing a policy reads no text again.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined results: a null text has no words; an empty text fails the rules on
length; equal rows get equal results each; an empty table gives an empty ledger and ablations of zero rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

# fixed values of the base rules
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters_ascii", "n_capitals")
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


@dataclass(frozen=True)
class Rule:
    """A rule owns one bit for ever; ``fails`` reads measurement columns only."""

    bit: int
    name: str
    fails: Column


def rules() -> list[Rule]:
    c = F.col
    return [
        Rule(0, "too_few_words", c("n_words") < MIN_WORDS),
        Rule(1, "repeated_words", 100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words")),
        Rule(2, "no_words", c("n_words") == 0),
        Rule(3, "many_symbols", 100 * c("n_symbols") > 10 * c("word_chars")),
        Rule(4, "duplicate_lines", 100 * c("n_dup_lines") > 50 * c("n_lines")),
        Rule(5, "short_words", c("word_chars") < 2 * c("n_words")),
        Rule(6, "long_words", c("word_chars") > 20 * c("n_words")),
        Rule(7, "some_symbols", 100 * c("n_symbols") > 3 * c("word_chars")),
        Rule(8, "some_duplicate_lines", 100 * c("n_dup_lines") > 20 * c("n_lines")),
        Rule(9, "mostly_capitals", 2 * c("n_capitals") > c("n_letters_ascii")),
    ]


# policy version: bits that reject; a later version is a new entry, earlier ones stay as they are
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "no_words", "many_symbols", "duplicate_lines", "short_words", "long_words", "mostly_capitals"),
    "v2-strict": ("too_few_words", "repeated_words", "no_words", "many_symbols", "duplicate_lines", "short_words", "long_words",
                  "mostly_capitals", "some_symbols", "some_duplicate_lines"),
}
POLICY = "v1"


def mask(policy: str) -> int:
    bits = {r.name: r.bit for r in rules()}
    return sum(1 << bits[name] for name in POLICIES[policy])


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All measurements of a batch of texts, vectorised over the words of a slice."""
    hashes, n_words = base.word_hashes(texts)
    grams, owner = base.windows(hashes, n_words, 3)
    n = len(texts)
    out = {"n_words": n_words, "n_repeat_words": np.zeros(n, np.int64)}
    if len(grams):
        # a window is repeated if an equal one lies in the same text; the owner joins the hash as a second key
        order = np.lexsort((grams, owner))
        same = (grams[order][1:] == grams[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        twice = np.zeros(len(grams), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        first_word = np.concatenate([[0], np.cumsum(n_words)])[:-1]
        first_gram = np.concatenate([[0], np.cumsum(np.maximum(n_words - 2, 0))])[:-1]
        at = first_word[owner[twice]] + np.flatnonzero(twice) - first_gram[owner[twice]]
        covered = np.zeros(len(hashes), bool)
        for shift in range(3):
            covered[at + shift] = True
        out["n_repeat_words"] = np.bincount(np.repeat(np.arange(n), n_words)[covered], minlength=n)
    for name in MEASURES:
        out.setdefault(name, np.zeros(n, np.int64))
    for first, last in base.slices(texts):
        data, starts = base.joined(texts[first:last])
        edges = starts[:-1]
        if not len(data):
            continue
        lead = (data & 0xC0) != 0x80
        word = base.SPACES[data]
        add = lambda flags: np.add.reduceat(flags.astype(np.int64), edges)  # noqa: E731  every text has its own line feed at least
        out["word_chars"][first:last] = add(word & lead)
        out["n_symbols"][first:last] = add(SYMBOLS[data])
        out["n_letters_ascii"][first:last] = add(np.isin(data | 0x20, np.arange(97, 123, dtype=np.uint8)))
        out["n_capitals"][first:last] = add((data >= 65) & (data <= 90))
    for i, text in enumerate(texts):
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_digest, the measurements and ``failed`` (one bit per rule)."""
    def run(batch: pa.RecordBatch):
        yield {"doc_id": batch.column("doc_id"), "text_digest": batch.column("text_digest")} | measure(base.byte_strings(batch.column("text")))

    rows = base.id_text(docs, id_col, text_col).withColumn("text_digest", base.digest128(F.col("text")))
    measured = base.map_arrow(rows, run, "doc_id bigint, text_digest binary, " + ", ".join(f"{m} bigint" for m in MEASURES))
    bits = [F.when(r.fails, F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules()]
    return measured.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits))


def passes(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def report(marks: DataFrame, policy: str = POLICY) -> DataFrame:
    """The ledger under a policy: base verdict and final verdict."""
    base_failed = ~passes("base")
    return marks.select("doc_id", *MEASURES[:5], base_failed.alias("base_failed"), (~base_failed & passes(policy)).alias("kept"), "failed")


def ablations(marks: DataFrame, policies: list[str] | None = None) -> DataFrame:
    """(policy, rule, kept, kept_without_rule, failures): what each rule of a policy decides alone.

    Documents are first counted per bit pattern (at most 2**rules groups, combined on the map side); every policy and
    ablation is then a bitwise test on the patterns.
    """
    patterns = marks.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    bit = {r.name: 1 << r.bit for r in rules()}
    cases = [(p, r, mask(p), bit[r]) for p in (policies or list(POLICIES)) for r in POLICIES[p]]
    table = marks.sparkSession.createDataFrame(cases, "policy string, rule string, mask bigint, bit bigint")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    # one row per pattern with the list of cases: a fixed set against all patterns, not a cross join of rows
    every = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for p, r, m, b in cases])
    found = (patterns.select("failed", "n", F.explode(every).alias("c")).select("failed", "n", "c.*").groupBy("policy", "rule")
             .agg(total(hit == 0).alias("kept"), total(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without_rule"),
                  total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("failures")))
    return table.select("policy", "rule").join(found, ["policy", "rule"], "left").fillna(0)


def keep(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """Documents that pass, with all their columns; rows that share an id are judged each by its own text."""
    bad = ledger(docs).where(~passes(policy)).select(F.col("doc_id").alias("_id"), F.col("text_digest").alias("_text")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (base.digest128(docs["text"]) == bad["_text"]), "left_anti")
