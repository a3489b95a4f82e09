"""Token counts per section by offset mapping.

A document is encoded once as a whole. Byte-level tokens concatenate to the text's bytes, so the running sum of their
lengths gives every token's span. Sections (the lines of the text, each with its line feed) are intervals of the same
axis; tokens and sections are joined by interval, and a token over a boundary goes where the rule says:

* ``first``: the section of its first byte,
* ``most``: the section that holds most of its bytes, the earlier one of equals,
* ``share``: every section its share of the bytes.

Counts of the sections of a document add up to the tokens of the whole document under every rule.

Defined results: a null or empty text has one section without tokens; a text that ends in a line feed has no section
behind it; each input row is counted for itself, so repeated rows repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import base
from .byte_bpe import Codec, Ranks

RULES = ("first", "most", "share")
SCHEMA = "doc_id bigint, section int, char_start bigint, char_end bigint, n_tokens double, n_crossing bigint"


def bounds_of(text: bytes) -> np.ndarray:
    """Start of every section and the end of the text."""
    data = np.frombuffer(text, np.uint8)
    starts = np.flatnonzero(data == 10) + 1
    return np.concatenate([[0], starts[starts < len(data)], [len(data)]])


def attribute(sizes: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section under a rule, and the boundary-crossing tokens that touch it."""
    n = len(bounds) - 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    over = np.flatnonzero(first != last)
    counts = np.bincount(np.delete(first, over) if len(over) else first, minlength=n).astype(float)[:n]
    crossing = np.zeros(n, np.int64)
    for t in over:
        touched = np.arange(first[t], last[t] + 1)
        held = np.minimum(ends[t], bounds[touched + 1]) - np.maximum(starts[t], bounds[touched])
        crossing[touched] += 1
        if rule == "first":
            counts[first[t]] += 1
        elif rule == "most":
            counts[touched[held.argmax()]] += 1
        else:
            counts[touched] += held / sizes[t]
    return counts, crossing


def count_tokens(docs: DataFrame, ranks: Ranks, rule: str = "most", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, char_start, char_end, n_tokens, n_crossing), one row per section of every document."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    data, pattern = ranks.data, ranks.pattern
    state: dict[str, object] = {}

    def run(batch: pa.RecordBatch):
        if not state:
            codec = Codec(data.value, pattern)
            state.update(codec=codec, sizes=np.array([len(t) for t in codec.tokens], np.int64))
        codec, sizes = state["codec"], state["sizes"]
        out: dict[str, list] = {k: [] for k in ("section", "char_start", "char_end", "n_tokens", "n_crossing")}
        per_row = []
        for text in batch.column("text").to_pylist():
            raw = (text or "").encode()
            bounds = bounds_of(raw)
            ids = codec.encode(text or "")
            counts, crossing = attribute(sizes[np.asarray(ids, np.int64)], bounds, rule)
            chars = bounds if len(raw) == len(text or "") else np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])[bounds]
            per_row.append(len(counts))
            for k, v in (("section", np.arange(len(counts))), ("char_start", chars[:-1]), ("char_end", chars[1:]), ("n_tokens", counts), ("n_crossing", crossing)):
                out[k].append(v)
        flat = {k: np.concatenate(v) if v else np.zeros(0) for k, v in out.items()}
        yield {"doc_id": batch.column("doc_id").take(pa.array(np.repeat(np.arange(batch.num_rows), per_row)))} | flat

    return base.map_arrow(base.id_text(docs, id_col, text_col), run, SCHEMA)


def by_document(sections: DataFrame) -> DataFrame:
    """Whole-document totals from the section counts."""
    from pyspark.sql import functions as F
    return sections.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.round(F.sum("n_tokens")).cast("long").alias("n_tokens"))
