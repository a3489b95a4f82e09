"""Benchmark decontamination: one automaton over normalised test windows scans every text once.

A text is reduced to its words (A-Z lower-cased, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``) joined by
single blanks. The windows of all benchmark items go into one Aho-Corasick automaton; each text passes it
once and every hit is mapped back to word numbers and to character offsets of the original text.

Defined results: a null or empty text has no words and no hits; an item without words has no window; an item
of fewer words than a window is one window; items with the same window are all reported; repeated rows are
scanned each for itself; an empty benchmark marks nothing; an item without id is reported under the id ''.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

WINDOW = 10
BLOCK = 200_000  # windows in one automaton (about 100 MB); a larger benchmark is scanned in several blocks

SCAN_SCHEMA = ("doc_id bigint, text string, n_words bigint, word_from array<int>, word_to array<int>, "
               "char_from array<int>, char_to array<int>, items array<string>")


def normal_words(text: bytes) -> list[bytes]:
    """Words of one text in order, lower-cased."""
    return text.translate(TRANSLATE).split()


# every byte that is no word byte becomes a blank, A-Z become a-z
TRANSLATE = bytes(c + 32 if 65 <= c <= 90 else c if base.LETTERS[c] else 32 for c in range(256))


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(window, items): each distinct window of consecutive item words with the ids that hold it."""
    def cut(batch: pa.RecordBatch):
        grams, owners = [], []
        for item, text in zip(batch.column("item").to_pylist(), base.byte_strings(batch.column("text")), strict=True):
            words = normal_words(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                grams.append(b" ".join(words[i:i + window]).decode("latin-1"))
                owners.append(item or "")
        yield {"window": grams, "item": owners}

    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return base.map_arrow(items, cut, "window string, item string").groupBy("window").agg(F.collect_set("item").alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK,
         id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, text, n_words, hit runs as word numbers [from, to) and characters [from, to), and the items hit.

    The automaton travels as a broadcast list of at most ``block`` windows; a larger benchmark becomes several
    blocks and the same rows pass one automaton after the other, without a shuffle.
    """
    spark = docs.sparkSession
    grams = base.staged(item_windows(benchmark, item_col, item_text, window), "windows")
    blocks = max(1, -(-grams.count() // block))
    out = base.id_text(docs, id_col, text_col)
    for number in range(blocks):
        part = grams.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == number)
        entries = spark.sparkContext.broadcast([(r["window"], sorted(r["items"])) for r in part.toLocalIterator()])
        out = base.map_arrow(out, _scanner(entries, number > 0), SCAN_SCHEMA)
    return out


def _scanner(entries, again: bool):
    state: dict[str, object] = {}

    def run(batch: pa.RecordBatch):
        if "made" not in state:
            machine = ahocorasick.Automaton()
            for number, (gram, items) in enumerate(entries.value):
                machine.add_word(f" {gram} ", (number, gram.count(" ") + 1))
            machine.make_automaton()
            state.update(made=machine if len(machine) else None, items=[items for _, items in entries.value])
        machine, names = state["made"], state["items"]
        n_words, runs, spans, found = [], [], [], []
        for row, text in enumerate(base.byte_strings(batch.column("text"))):
            words = text.translate(TRANSLATE).split()
            n_words.append(len(words))
            hits, items = [], set()
            if again:
                hits = list(zip(batch.column("word_from")[row].as_py(), batch.column("word_to")[row].as_py(), strict=True))
                items = set(batch.column("items")[row].as_py())
            hay = " " + b" ".join(words).decode("latin-1") + " "
            ends = [(end, *value) for end, value in machine.iter(hay)] if machine and words else []
            if ends:
                blanks = np.flatnonzero(np.frombuffer(hay.encode("latin-1"), np.uint8) == 32)
                last = np.searchsorted(blanks, [e[0] for e in ends])  # words before the closing blank
                hits += [(int(to) - size, int(to)) for to, (_, _, size) in zip(last, ends, strict=True)]
                for _, number, _ in ends:
                    items.update(names[number])
            merged: list[list[int]] = []
            for a, b in sorted(hits):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            runs.append(merged)
            spans.append(char_spans(text, merged))
            found.append(sorted(items))
        yield {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "n_words": n_words,
               "word_from": [[a for a, _ in r] for r in runs], "word_to": [[b for _, b in r] for r in runs],
               "char_from": [[a for a, _ in r] for r in spans], "char_to": [[b for _, b in r] for r in spans], "items": found}
    return run


def char_spans(text: bytes, runs: list[list[int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of runs of words."""
    if not runs:
        return []
    data = np.frombuffer(text, np.uint8)
    start, end = base.word_spans(base.LOWER[data], base.LETTERS)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [(int(chars[start[a]]), int(chars[end[b - 1]])) for a, b in runs]


def report(scanned: DataFrame) -> DataFrame:
    """Counts and the digest of item ids per document."""
    hit = F.coalesce(F.aggregate(F.zip_with("word_from", "word_to", lambda a, b: b - a), F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")
    return scanned.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                          F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
                          "char_from", "char_to")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without any benchmark passage, with all their columns.

    Rows are matched by the operator's own scan of the same text, so rows that share an id are judged one by one.
    """
    marks = (scan(docs, benchmark, window).where(F.size("word_from") > 0)
             .select(F.col("doc_id").alias("_id"), base.digest128(F.col("text")).alias("_text")).distinct())
    match = docs["doc_id"].eqNullSafe(marks["_id"]) & (base.digest128(docs["text"]) == marks["_text"])
    return docs.join(marks, match, "left_anti")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
