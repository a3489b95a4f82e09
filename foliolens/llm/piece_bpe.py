"""SentencePiece encoding and decoding with a merge-type (BPE) vocabulary.

1. A text is normalised by the rules stored in the model file (dummy prefix, blanks as U+2581).
2. If no piece of the vocabulary has U+2581 behind another character, or another character behind a Latin letter (both
   looked up when the model is loaded), no merge can cross such a place, so the text falls into *units* that are encoded
   on their own; a model without either makes one unit of a text.
3. A unit starts as one symbol per character. An agenda holds each adjacent pair of symbols whose concatenation is a
   piece, best score first, then the leftmost. The best pair is merged and its two new neighbours enter the agenda. The
   agenda of a long unit is a heap, in which an entry whose symbols have changed since is stale and skipped; those of
   units of at most ``SHORT`` characters are arrays in place order, and the first entries of all of them are taken in
   one step. Symbols without a piece become their UTF-8 byte pieces.
4. Every unit that the agenda encodes is encoded by the sentencepiece library too, in the same Arrow batch; a unit of
   which the two differ marks its documents in ``differs``. Units already encoded by a worker come from a table of at
   most ``REMEMBERED`` short units, which is emptied when it is full.

Decoding is the library's ``decode`` of the ids.

Defined results: a null text counts as empty and has no ids; equal rows give equal results, and each input row comes
out once; strings that look like control pieces are ordinary text; long units cost n log n.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

SPACE = "▁"
REMEMBERED = 300_000
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
SHORT = 64  # characters of a unit that is remembered
NEVER = 1 << 30
# fixed values: kinds of pieces and of models in the model file
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
BPE = 2


def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = number() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, data[at:at + size]
            at += size


class Vocabulary:
    """A model file (under 1 MB here), read on the driver and broadcast. Merge-type models with byte pieces only."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            data = f.read()
        Encoder(data)  # refuses other kinds of models at once
        self.data = spark.sparkContext.broadcast(data)


class Encoder:
    """The encoder and decoder of one task."""

    def __init__(self, data: bytes):
        self.pieces: dict[str, tuple[float, int]] = {}
        self.bytes: dict[int, int] = {}
        kind = None
        ident = 0
        for name, value in fields(data):
            if name == 1:
                piece = {1: b"", 2: struct.pack("<f", 0), 3: NORMAL} | dict(fields(value))
                text = piece[1].decode()
                if piece[3] == BYTE:
                    self.bytes[int(text[3:5], 16)] = ident
                elif piece[3] == NORMAL:
                    self.pieces[text] = (-struct.unpack("<f", piece[2])[0], ident)
                elif piece[3] in (USER_DEFINED, UNUSED):
                    raise ValueError("vocabularies with user-defined or unused pieces are not supported")
                ident += 1
            elif name == 2:
                kind = dict(fields(value)).get(3, 1)
        if kind != BPE or len(self.bytes) != 256:
            raise ValueError("the agenda needs a merge-type vocabulary with all byte pieces")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        # symbols by number: pieces, single characters of pieces, and last what occurs in no piece
        self.texts = list(dict.fromkeys([*self.pieces, *sorted(set("".join(self.pieces))), ""]))
        number = {t: i for i, t in enumerate(self.texts)}
        self.ids = np.array([self.pieces.get(t, (0, -1))[1] for t in self.texts], np.int32)
        self.numbers = np.full(0x110000, len(self.texts) - 1, np.int64)
        for t, i in number.items():
            if len(t) == 1:
                self.numbers[ord(t)] = i
        place = {s: i for i, s in enumerate(sorted({x[0] for x in self.pieces.values()}))}
        pairs = sorted((number[p[:k]] * len(self.texts) + number[p[k:]], place[x[0]], number[p])
                       for p, x in self.pieces.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        self.keys, self.ranks, self.merged = np.array(pairs, np.int64).reshape(-1, 3).T.copy()
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        letters = not crossing and not any(re.search(f"[{LETTERS}][^{LETTERS}]", p) for p in self.pieces)
        self.parts_letters = letters
        self.unit = re.compile("(?s).+" if crossing else f"{SPACE}*[^{SPACE}{LETTERS}]*[{LETTERS}]+|{SPACE}*[^{SPACE}{LETTERS}]+|{SPACE}+" if letters else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.lead = len(self.library.encode("\n"))
        if any("\n" in p for p in self.pieces) or not self.library.normalize("a").startswith(SPACE):
            raise ValueError("the check of units needs a model with a dummy prefix and no piece with a line feed")
        self.known: dict[str, bytes] = {}

    def merge(self, units: list[str]) -> list[bytes]:
        """Ids of units by their agendas, as 32-bit integers."""
        brief = [u for u in units if len(u) <= SHORT]
        found = dict(zip(brief, self.short(brief), strict=True)) if brief else {}
        return [found[u] if u in found else self.long(u) for u in units] if len(found) < len(units) else list(found.values())

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each pair of symbol numbers in the order of scores (``NEVER`` for no piece), and the piece's number."""
        key = left * len(self.texts) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER), self.merged[at]

    def short(self, units: list[str]) -> list[bytes]:
        """Ids of many short units at once: each round merges the first entry of every unit's agenda."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        point = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        code, own = self.numbers[point], np.repeat(np.arange(len(units)), sizes)
        # entry i of the agenda is the pair of symbols i and i + 1
        entry, into = self.ranked(code, np.append(code[1:], 0))
        entry[np.append(own[1:] != own[:-1], True)] = NEVER
        ended = []
        while len(own):
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            best = np.minimum.reduceat(entry << 32 | np.arange(len(own)), starts)
            merges = best >> 32 < NEVER
            stay = np.repeat(merges, np.diff(np.append(starts, len(own))))
            ended.append((own[~stay], code[~stay], point[~stay]))
            at = best[merges] & 0xFFFFFFFF
            code[at] = into[at]
            stay[at + 1] = False
            at = np.cumsum(stay)[at] - 1
            code, own, point, entry, into = code[stay], own[stay], point[stay], entry[stay], into[stay]
            for i in (at, at[at > 0] - 1):
                follow = np.minimum(i + 1, len(own) - 1)
                rank, into[i] = self.ranked(code[i], code[follow])
                entry[i] = np.where((own[follow] == own[i]) & (follow > i), rank, NEVER)
        own, code, point = (np.concatenate(x) for x in zip(*ended, strict=True))
        order = np.argsort(own, kind="stable")
        ids, bounds = self.ids[code[order]], np.searchsorted(own[order], np.arange(len(units) + 1))
        data, ends = ids.tobytes(), (bounds * 4).tolist()
        out = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        for u in np.unique(own[self.ids[code] < 0]).tolist():
            run = order[bounds[u]:bounds[u + 1]]
            out[u] = array("i", [x for c, p in zip(code[run].tolist(), point[run].tolist(), strict=True) for x in ([int(self.ids[c])] if self.ids[c] >= 0 else [self.bytes[y] for y in chr(p).encode()])]).tobytes()
        return out

    def long(self, unit: str) -> bytes:
        """Ids of a long unit; symbols merged into their left neighbour are empty."""
        pieces, size = self.pieces, len(unit)
        symbols = list(unit)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        agenda = []
        for i in range(size - 1):
            pair = unit[i:i + 2]
            if pair in pieces:
                agenda.append((pieces[pair][0], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, left, pair = heapq.heappop(agenda)
            right = after[left]
            if right >= size or not symbols[left] or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, ""
            follow = after[left] = after[right]
            if follow < size:
                before[follow] = left
                new = pair + symbols[follow]
                if new in pieces:
                    heapq.heappush(agenda, (pieces[new][0], left, new))
            ahead = before[left]
            if ahead >= 0:
                new = symbols[ahead] + pair
                if new in pieces:
                    heapq.heappush(agenda, (pieces[new][0], ahead, new))
        return array("i", [x for s in symbols if s for x in ([pieces[s][1]] if s in pieces else [self.bytes[b] for b in s.encode()])]).tobytes()

    def by_library(self, units: list[str]) -> list[list[int]]:
        """The library's ids of units. One that does not begin with U+2581 gets it from the library and loses its piece again."""
        front = [u[0] == SPACE and len(u) > 1 for u in units]
        # a line feed has no merges, so what stands behind it is encoded as inside a text
        found = self.library.encode([u[1:] if f else "\n" + u.replace(SPACE, " ") for u, f in zip(units, front, strict=True)], num_threads=1)
        return [ids if f else ids[self.lead:] for ids, f in zip(found, front, strict=True)]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text as 32-bit integers, and whether the library has others for one of its new units."""
        split = [self.unit.findall(self.library.normalize(t)) if t else [] for t in texts]
        known = self.known
        new = list(set().union(*split).difference(known))
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(set().union(*split))
        merged = self.merge(new)
        wrong = {u for u, own, ids in zip(new, merged, self.by_library(new), strict=True) if own != array("i", ids).tobytes()}
        known.update(zip(new, merged, strict=True))
        found = [b"".join(map(known.__getitem__, units)) for units in split]
        differs = [bool(wrong) and not wrong.isdisjoint(units) for units in split]
        for u in new:
            if len(u) > SHORT or u in wrong:
                del known[u]
        return found, differs


def _loader(vocabulary: Vocabulary):
    data, state = vocabulary.data, {}

    def encoder() -> Encoder:
        if "encoder" not in state:
            state["encoder"] = Encoder(data.value)
        return state["encoder"]

    return encoder


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, differs) of every row; ``differs`` is true where the library encodes a unit of the text otherwise."""
    encoder = _loader(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        runs = iter(base.slices([t.encode("utf-8", "replace") for t in texts]))
        for first, last in runs:
            ids, differs = encoder().encode(texts[first:last])
            yield {"doc_id": batch.column("doc_id").slice(first, last - first), "ids": base.lists(np.frombuffer(b"".join(ids), np.int32), [len(x) // 4 for x in ids], pa.int32()), "differs": differs}

    return base.map_arrow(base.id_text(docs, id_col, text_col), run, f"doc_id {kind}, ids array<int>, differs boolean")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The columns of ``encode`` and the decoded ``text``."""
    encoder = _loader(vocabulary)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        column = batch.column("ids")
        yield {c: batch.column(c) for c in ("doc_id", "ids", "differs")} | {"text": encoder().library.decode(column.to_pylist(), num_threads=1)}

    return base.map_arrow(encoded.select("doc_id", "ids", "differs"), run, f"doc_id {kind}, ids array<int>, differs boolean, text string")


def report(decoded: DataFrame) -> DataFrame:
    """Per document the number of ids, the digests of the ids and of the decoded text, and ``differs``."""
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                          F.sha2("text", 256).alias("decoded_sha256"), "differs")
