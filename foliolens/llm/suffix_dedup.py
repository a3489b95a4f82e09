"""Removal of repeated byte strings by external induced sorting of sampled suffixes.

A string of ``LENGTH`` bytes is repeated if it starts at two places of the corpus. Sorting every suffix would carry a
tuple per byte; here, as in the reduction step of induced sorting, only sampled suffixes are named and sorted, and the
order of all others is induced from them:

1. *Sampling.* In every window of ``LENGTH`` bytes the ``GRAM``-byte string with the least hash is its anchor, so equal
   windows have equal anchors at equal offsets. The windows of one anchor lie next to each other; the text they cover is
   the anchor's *reach*. One row per anchor (about two for each ``LENGTH`` bytes): anchor name, reach name, place.
2. *Naming.* Anchors are counted by name. One occurrence: none of its windows is repeated. Several with one reach name:
   all are. What is left has an equal anchor and different reaches (the borders of repeated passages).
3. *Induction.* Distinct reaches of such anchors are dealt to shards by anchor name and the bytes beside it. A shard sorts
   its suffixes at the anchor with common-prefix values, then induces the order one byte further left again and again: the
   tuples (group, preceding byte, rank, common prefix) pass a queue that keeps a bounded number in memory and
   sorted runs on disk. Neighbours with a common prefix of ``LENGTH`` bytes are repeated windows.
4. The marks of each distinct reach go back to its occurrences and become byte spans of documents.

A shard needs memory for the queue's buffer only; texts and runs lie in memory-mapped files of the task.

Defined results: a null text is empty; strings never cross documents; overlapping repeats count; equal rows repeat each
other, so both lose their repeated strings; rows that share an id are kept apart by the digest of their text.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

LENGTH = 200
GRAM = 32
BUFFER = 1 << 15  # tuples of a queue in memory
_U = np.uint64
_PLACE = _U((1 << 21) - 1)


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM, block: int = base.SLICE) -> Iterator[tuple[np.ndarray, ...]]:
    """(first window, windows, anchor place, anchor name, reach name) of every anchor of a text, in blocks of windows."""
    n_windows = len(text) - length + 1
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(n_windows, 0), block):
        part = data[at:min(at + block, n_windows) + length - 1]
        yield tuple(x + at if i in (0, 2) else x for i, x in enumerate(_anchors(part, length, gram, None)))


def _anchors(data: np.ndarray, length: int, gram: int, valid: np.ndarray | None) -> tuple[np.ndarray, ...]:
    sums = base.prefix_sums(data)
    n = len(data) - gram + 1
    place = np.arange(n)
    names = base.span_hashes(sums, place, place + gram)
    # hash above, place below: the least key is the least hash, and the leftmost of equal ones
    best = (names & ~_PLACE) | place.astype(_U)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < width:
        best = np.minimum(best[:len(best) - (width - have)], best[width - have:])
    spot = (best & _PLACE).astype(np.int64)
    ok = np.ones(len(spot), bool) if valid is None else valid[:len(spot)]
    step = np.flatnonzero(np.concatenate([[True], (spot[1:] != spot[:-1]) | (ok[1:] != ok[:-1])]))
    count = np.diff(np.append(step, len(spot)))
    step, count = step[ok[step]], count[ok[step]]
    reach = base.mix(base.span_hashes(sums, step, step + count + length - 1) ^ (spot[step] - step).astype(_U))
    return step, count, spot[step], names[spot[step]], reach


def batch_anchors(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, first window, windows, anchor place, anchor name, reach name), offsets inside the text."""
    for first, last in base.slices(texts):
        if last - first == 1:
            for found in anchors(texts[first], length, gram):
                yield np.full(len(found[0]), first), *found
            continue
        data, starts = base.joined(texts[first:last])
        if len(data) < length:
            continue
        owner = np.repeat(np.arange(last - first), np.diff(starts))
        left = starts[1:][owner] - 1 - np.arange(len(data))  # bytes from here to the end of the text
        step, count, spot, name, reach = _anchors(data, length, gram, left >= length)
        own = owner[step]
        yield own + first, step - starts[own], count, spot - starts[own], name, reach


class RunQueue:
    """A priority queue of fixed-width tuples: a bounded buffer in memory, sorted runs on disk.

    Tuples come out by ``key``; equal keys keep the order in which they were pushed.
    """

    def __init__(self, kind: np.dtype, folder: str, limit: int = BUFFER):
        self.kind, self.folder, self.limit = kind, folder, max(limit, 2)
        self.held: list[np.ndarray] = []
        self.size = self.count = 0
        self.runs: list[str] = []

    def push(self, rows: np.ndarray) -> None:
        for at in range(0, len(rows), self.limit):
            part = rows[at:at + self.limit]
            if self.size + len(part) > self.limit:
                self._spill()
            self.held.append(part)
            self.size += len(part)
            self.count += len(part)

    def _sorted(self) -> np.ndarray:
        rows = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        self.held, self.size = [], 0
        return rows[np.argsort(rows["key"], kind="stable")]

    def _spill(self) -> None:
        handle, path = tempfile.mkstemp(dir=self.folder)
        with os.fdopen(handle, "wb") as f:
            self._sorted().tofile(f)
        self.runs.append(path)

    def drain(self) -> Iterator[np.ndarray]:
        """Sorted blocks; files of the runs go as they end."""
        if not self.runs:
            if self.size:
                yield self._sorted()
            return
        if self.size:
            self._spill()
        runs = [np.memmap(p, self.kind, "r") for p in self.runs]
        at, step = [0] * len(runs), max(1, self.limit // len(runs))
        while any(a < len(r) for a, r in zip(at, runs, strict=True)):
            ahead = [r[a:a + step] for a, r in zip(at, runs, strict=True)]
            # below the least of the blocks' last keys everything is at hand; at it, runs before that block's are
            cut = min((int(b["key"][-1]), i) for i, b in enumerate(ahead) if len(b))
            taken = []
            for i, b in enumerate(ahead):
                take = int(np.searchsorted(b["key"], cut[0], "right" if i <= cut[1] else "left"))
                taken.append(np.array(b[:take]))
                at[i] += take
            rows = np.concatenate(taken)
            yield rows[np.argsort(rows["key"], kind="stable")]
        del runs
        for p in self.runs:
            os.unlink(p)
        self.runs = []


_TUPLE = np.dtype([("key", np.int64), ("group", np.int64), ("row", np.int64), ("lcp", np.int64)])


def induce(texts: np.ndarray, group: np.ndarray, middle: int, right: np.ndarray, first: np.ndarray, last: np.ndarray,
           length: int, folder: str, limit: int = BUFFER) -> np.ndarray:
    """Marks (row, offset to the left of the anchor) of windows that two rows of one group share.

    ``texts`` holds the reaches with their anchors in column ``middle``; row i has ``right[i]`` bytes from there on. Rows come in order of (group, suffix at the anchor). ``first``/``last`` are the least and
    greatest offsets at which a row has windows of this group.
    """
    marks = np.memmap(os.path.join(folder, "marks"), bool, "w+", shape=(len(texts), middle + 1))
    # suffixes at the anchor: common prefix with the row before, from the sorted texts
    queue = RunQueue(_TUPLE, folder, limit)
    for at in range(0, len(texts), limit):
        rows = np.arange(at, min(at + limit, len(texts)))
        tuples = np.zeros(len(rows), _TUPLE)
        before = np.maximum(rows - 1, 0)
        differ = texts[rows, middle:] != texts[before, middle:]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1])
        tuples["lcp"] = np.minimum(np.minimum(same, right[rows]), right[before]) * ((group[rows] == group[before]) & (rows > 0))
        tuples["row"], tuples["group"], tuples["key"] = rows, group[rows], group[rows]
        queue.push(tuples)
    for offset in range(middle + 1):
        after = RunQueue(_TUPLE, folder, limit)
        carry = _Carry()
        tail: np.ndarray | None = None
        for block in queue.drain():
            # equal neighbours share a window of the wanted length at this offset
            full = block["lcp"] >= length
            hit = full.copy()
            hit[:-1] |= full[1:]
            if tail is not None and len(full) and full[0]:
                marks[tail["row"], offset] = True
            marks[block["row"][hit], offset] = True
            tail = block[-1]
            byte = texts[block["row"], middle - offset - 1].astype(np.int64) if offset < middle else np.zeros(len(block), np.int64)
            go = (last[block["row"]] > offset) if offset < middle else np.zeros(len(block), bool)
            nxt = block.copy()
            nxt["lcp"] = carry.common(block["group"], byte, block["lcp"], go)
            nxt["key"] = block["group"] * 256 + byte
            after.push(nxt[go])
        queue = after
    offsets = np.arange(middle + 1)
    for at in range(0, len(texts), limit):
        part = slice(at, at + limit)
        marks[part] &= (first[part, None] <= offsets) & (offsets <= last[part, None])
    return marks


class _Carry:
    """Common prefix of each tuple with the last one of its group and preceding byte, across blocks in rank order."""

    def __init__(self):
        self.group, self.least, self.seen = -1, np.full(256, np.iinfo(np.int64).max), np.zeros(256, bool)

    def common(self, group: np.ndarray, byte: np.ndarray, lcp: np.ndarray, go: np.ndarray) -> np.ndarray:
        n = len(group)
        key = np.where(go, group * 256 + byte, -1 - np.arange(n))
        order = np.argsort(key, kind="stable")
        prev = np.full(n, -1)
        same = key[order][1:] == key[order][:-1]
        prev[order[1:][same]] = order[:-1][same]
        out = np.zeros(n, np.int64)
        has = np.flatnonzero(prev >= 0)
        if len(has):
            # least common prefix over the ranks after the last tuple of this byte up to this one
            bounds = np.column_stack([prev[has] + 1, has + 1]).ravel()
            out[has] = 1 + np.minimum.reduceat(np.append(lcp, 0), bounds)[::2]
        head = np.flatnonzero((group == self.group) & (prev < 0) & go)
        if len(head):
            running = np.minimum.accumulate(lcp)
            known = self.seen[byte[head]]
            out[head[known]] = 1 + np.minimum(self.least[byte[head[known]]], running[head[known]])
        # what the next block needs: per byte the least common prefix since its last tuple in the last group
        last = group[-1]
        mine = np.flatnonzero(group == last)
        back = np.minimum.accumulate(lcp[mine][::-1])[::-1] if len(mine) else lcp[:0]
        if last != self.group:
            self.group = last
            self.seen[:] = False
            self.least[:] = np.iinfo(np.int64).max
        else:
            self.least[self.seen] = np.minimum(self.least[self.seen], back[0])
        used = mine[go[mine]]
        self.seen[byte[used]] = True
        since = np.append(back[1:], np.iinfo(np.int64).max)
        self.least[byte[used]] = since[used - mine[0]]  # the last tuple of a byte wins
        return out


REACH_SCHEMA = "shard bigint, name bigint, reach bigint, place int, windows int, first int, last int, body binary"


_HEAD = np.dtype([("name", np.int64), ("reach", np.int64), ("group", np.int64), ("place", np.int32), ("size", np.int32), ("first", np.int32), ("last", np.int32)])


def shard_marks(rows: Iterator[dict], length: int, gram: int, buffer: int) -> Iterator[dict]:
    """Marks of the reaches of a shard, one batch of whole groups after the other; rows come in order of group and suffix.

    Bodies go straight to a file of fixed-width rows with the anchors in one column; a group of any size adds no memory
    but some forty bytes a row.
    """
    middle = length - gram  # most bytes before an anchor
    wide = middle + 2 * length - gram
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "reaches")
        heads: list[tuple] = []
        key, group, file = None, -1, open(path, "wb")

        def flush() -> Iterator[dict]:
            file.close()
            head = np.array(heads, _HEAD)
            texts = np.memmap(path, np.uint8, "r", shape=(len(head), wide))
            left = head["place"].astype(np.int64)
            marks = induce(texts, head["group"], middle, head["size"] - left, head["first"], head["last"], length, folder, buffer)
            del texts
            for at, h in enumerate(head):
                hit = np.flatnonzero(marks[at])
                if len(hit):  # an offset to the left of the anchor becomes a window number counted from the reach's start
                    yield {"name": int(h["name"]), "reach": int(h["reach"]), "hits": sorted((int(h["place"]) - hit).tolist())}

        try:
            for row in rows:
                if (row["shard"], row["name"]) != key:
                    if len(heads) >= buffer:
                        yield from flush()
                        heads, file = [], open(path, "wb")
                    key, group = (row["shard"], row["name"]), group + 1
                heads.append((row["name"], row["reach"], group, row["place"], len(row["body"]), row["first"], row["last"]))
                file.write((b"\0" * (middle - row["place"]) + row["body"]).ljust(wide, b"\0"))
            if heads:
                yield from flush()
        finally:
            file.close()


def _spans(first: np.ndarray, last: np.ndarray) -> list[list[int]]:
    """Union of half-open spans in order of their start."""
    out: list[list[int]] = []
    for a, b in sorted(zip(first, last, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, buffer: int = BUFFER) -> DataFrame:
    """(doc_id, text_digest, start, end): byte spans covered by repeated strings, not yet united."""
    spark = docs.sparkSession
    side = (length - gram) // 2  # bytes beside the anchor that deal a hot anchor to several shards

    def sample(batch: pa.RecordBatch):
        texts = base.byte_strings(batch.column("text"))
        digests = [hashlib.sha256(t).digest()[:16] for t in texts]
        for own, start, count, _, name, reach in batch_anchors(texts, length, gram):
            yield {"doc_id": batch.column("doc_id").take(pa.array(own)), "text_digest": pa.array(digests, pa.binary()).take(pa.array(own)),
                   "start": start, "windows": count, "name": name.view(np.int64), "reach": reach.view(np.int64)}

    places = base.map_arrow(docs, sample, "doc_id bigint, text_digest binary, start bigint, windows int, name bigint, reach bigint")
    counted = places.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("reach").alias("lo"), F.max("reach").alias("hi")).where("n > 1")
    named = base.staged(counted.selectExpr("name", "lo <> hi AS mixed"), "names")
    repeats = base.staged(places.join(named, "name"), "repeats")
    whole = repeats.where("NOT mixed").selectExpr("doc_id", "text_digest", "start", "start + windows - 1 AS stop")

    mixed = named.where("mixed").select("name")
    seen = spark.sparkContext.broadcast(base.bitmap(mixed, "name", mixed.count()))

    def bodies(batch: pa.RecordBatch):
        texts = base.byte_strings(batch.column("text"))
        for own, start, count, spot, name, reach in batch_anchors(texts, length, gram):
            out: dict[str, list] = {k: [] for k in ("shard", "name", "reach", "place", "windows", "first", "last", "body")}
            for i in np.flatnonzero(base.in_bitmap(seen.value, name)):
                body = texts[own[i]][start[i]:start[i] + count[i] + length - 1]
                place = int(spot[i] - start[i])
                # windows that start up to `side` bytes before the anchor share what follows it, the others what stands before it
                for low, high, shared in ((0, side, body[place:place + length - side]), (side + 1, length, body[max(0, place - side - 1):place])):
                    first, last = max(low, place - int(count[i]) + 1), min(high, place)
                    if first <= last:
                        row = (int.from_bytes(hashlib.blake2b(shared, digest_size=8).digest(), "little", signed=True), int(name[i].view(np.int64)), int(reach[i].view(np.int64)),
                               place, int(count[i]), first, last, body)
                        for k, v in zip(out, row, strict=True):
                            out[k].append(v)
            yield out

    # one row per distinct reach before anything is dealt by anchor; how often it occurs decides before any comparison
    cut = base.map_arrow(docs.select("text"), bodies, REACH_SCHEMA)
    rows = cut.groupBy("shard", "name", "reach", "place", "windows", "first", "last").agg(F.count(F.lit(1)).alias("n"), F.first("body").alias("body"))
    rows = base.staged(rows.join(mixed, "name", "left_semi"), "reaches")
    often = rows.where("n > 1").selectExpr("name", "reach", "explode(sequence(place - last, place - first)) AS hit")
    several = rows.groupBy("shard", "name").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("shard", "name")
    ordered = (rows.join(several, ["shard", "name"], "left_semi").withColumn("suffix", F.expr("substring(body, place + 1)"))
               .repartition("shard", "name").sortWithinPartitions("shard", "name", "suffix").drop("suffix", "n"))
    arrow = base._arrow_schema(spark, "name bigint, reach bigint, hits array<int>")

    def run(batches):
        def each():
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    yield from batch.slice(at, 1000).to_pylist()

        held: list[dict] = []
        for out in shard_marks(each(), length, gram, buffer):
            held.append(out)
            if len(held) == 1000:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    induced = ordered.mapInArrow(run, "name bigint, reach bigint, hits array<int>").select("name", "reach", F.explode("hits").alias("hit"))
    marks = induced.unionByName(often).groupBy("name", "reach").agg(F.sort_array(F.collect_set("hit")).alias("hits"))
    # consecutive window numbers become runs [from, to]
    runs = marks.select("name", "reach", F.expr("filter(hits, x -> NOT array_contains(hits, x - 1))").alias("a"), F.expr("filter(hits, x -> NOT array_contains(hits, x + 1))").alias("b"))
    runs = runs.select("name", "reach", F.arrays_zip("a", "b").alias("runs"))
    partly = (repeats.where("mixed").join(runs, ["name", "reach"]).select("doc_id", "text_digest", "start", F.explode("runs").alias("r"))
              .selectExpr("doc_id", "text_digest", "start + r.a AS start", "start + r.b AS stop"))
    return whole.unionByName(partly).selectExpr("doc_id", "text_digest", "start", f"stop + {length} AS end")


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, buffer: int = BUFFER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) with ``removed`` as arrays of starts and ends."""
    rows = base.id_text(docs, id_col, text_col)
    spans = repeated_spans(rows, length, gram, buffer).groupBy("doc_id", "text_digest").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("text_digest").alias("_text"), F.expr("transform(spans, s -> s.start)").alias("a"), F.expr("transform(spans, s -> s.end)").alias("b"))
    keyed = rows.withColumn("_text", base.digest128(F.col("text")))
    both = keyed.join(spans, (F.xxhash64(keyed["doc_id"], keyed["_text"]) == F.xxhash64(spans["_id"], spans["_text"]))
                      & keyed["doc_id"].eqNullSafe(spans["_id"]) & (keyed["_text"] == spans["_text"]), "left").select("doc_id", "text", "a", "b")

    def cut(batch: pa.RecordBatch):
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed_from", "removed_to")}
        for text, a, b in zip(base.byte_strings(batch.column("text")), batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            spans_, digest, at = _spans(a or [], b or []), hashlib.sha256(), 0
            for x, y in spans_:
                digest.update(text[at:x])
                at = y
            digest.update(text[at:])
            row = (len(text), sum(y - x for x, y in spans_), len(spans_), digest.hexdigest(), [x for x, _ in spans_], [y for _, y in spans_])
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        yield {"doc_id": batch.column("doc_id")} | out

    return base.map_arrow(both, cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed_from array<bigint>, removed_to array<bigint>")
