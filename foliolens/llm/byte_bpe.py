"""Byte-level BPE encoding and decoding with a public rank file.

A text of at most ``chunk`` characters is pre-tokenised and encoded where it lies. A longer text is cut into
chunks that overlap; chunks are dealt over the cluster and pre-tokenised in parallel, each from its own start.
Two neighbours are stitched at the first pre-token boundary both have: the pattern looks only forward, so from
a common boundary on both go the same way. Each chunk reports its ids and the boundaries of its two overlaps;
the ids between two stitches are the ids of the whole text. Decoding concatenates the bytes of the ids.

If two neighbours share no boundary inside the overlap (one pre-token longer than the overlap), the text is
encoded again in one piece: pre-tokens may be as long as the text.

Defined results: a null text counts as empty and has no ids; equal rows give equal results, each input row
comes out once; strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

CHUNK = 32_768
OVERLAP = 512


class Ranks:
    """A vocabulary: bytes of a rank file (under 2 MB, read on the driver and broadcast) and the split pattern."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            self.data = spark.sparkContext.broadcast(f.read())
        self.pattern = pattern


class Codec:
    """The encoder and decoder of one task."""

    def __init__(self, data: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode_chunk(codec: Codec, text: str, start: int, own: int, head: int) -> tuple[list[int], list[list[int]], list[list[int]]]:
    """Ids of a chunk with overlap, and its boundaries [place in the whole text, ids before it] in both overlaps.

    ``text`` is the chunk and the overlap behind it; ``own`` characters are the chunk's own, the first ``head`` of
    which are also the previous chunk's overlap. Only starts of pre-tokens count as boundaries: the last end may be
    an artefact of the cut.
    """
    bounds = [m.start() for m in codec.split.finditer(text)]
    ids, front, back, at = [], [], [], 0
    for i, b in enumerate(bounds):
        if head < b < own:
            continue
        # white space before a cut reads differently without what follows it, so those pre-tokens go one by one
        k = i
        while k and bounds[k] > at and text[bounds[k] - 1].isspace():
            k -= 1
        for to in bounds[k:i + 1]:
            if to > at:
                ids += codec.encode(text[at:to])
                at = to
        if b <= head:
            front.append([start + b, len(ids)])
        if b >= own:
            back.append([start + b, len(ids)])
    return ids + codec.encode(text[at:]), front, back


def stitch(left: list[list[int]], right: list[list[int]]) -> tuple[int, int, int] | None:
    """First common boundary: its place, ids to keep of the left chunk, ids to skip of the right one."""
    ahead = dict(right)
    return next(((p, n, ahead[p]) for p, n in left if p in ahead), None)


def join_parts(codec: Codec, rows, chunk: int):
    """(row, ids) in order of the text from chunks in order; holds the chunks since the last stitch."""
    pending, skip, origin = [], 0, 0
    for row in rows:
        if row["part"] == 0:
            pending, skip, origin = [row], 0, 0
        else:
            meet = stitch(pending[-1]["back"], row["front"]) if len(pending) == 1 else None
            if meet:
                yield pending[0], pending[0]["ids"][skip:meet[1]]
                pending, skip, origin = [row], meet[2], meet[0] - row["start"]
            else:
                pending.append(row)
        if row["part"] == row["parts"] - 1:
            if len(pending) == 1:
                yield row, row["ids"][skip:]
            else:
                rest = "".join(r["text"][:chunk] for r in pending[:-1]) + row["text"]
                yield row, codec.encode(rest[origin:])


KEY = "doc_id bigint, text_digest binary, copy int, part int, parts int"
SCHEMA = KEY + ", ids array<int>"


def encode(docs: DataFrame, ranks: Ranks, chunk: int = CHUNK, overlap: int = OVERLAP,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_digest, copy, part, parts, ids): the ids of a text are those of its parts in order.

    A short text is one part with digest null; a long one has up to one part for each chunk (parts without an own
    stitch are missing), its rows lie together and in order in one partition. ``copy`` counts equal long rows.
    """
    if chunk <= overlap:
        raise ValueError("chunk must be longer than overlap")
    rows = base.id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    data, pattern = ranks.data, ranks.pattern
    state: dict[str, Codec] = {}

    def codec() -> Codec:
        if "codec" not in state:
            state["codec"] = Codec(data.value, pattern)
        return state["codec"]

    def whole(batch: pa.RecordBatch):
        c, n = codec(), batch.num_rows
        found = [np.asarray(c.encode(t), np.int32) for t in batch.column("text").to_pylist()]
        yield {"doc_id": batch.column("doc_id"), "text_digest": pa.nulls(n, pa.binary()), "copy": [0] * n, "part": [0] * n, "parts": [1] * n,
               "ids": base.lists(np.concatenate(found), [len(x) for x in found], pa.int32())}

    def cut(batch: pa.RecordBatch):
        out: dict[str, list] = {k: [] for k in ("doc_id", "text_digest", "copy", "part", "parts", "text", "start", "own", "head")}
        for doc, text, copies in zip(*[batch.column(k).to_pylist() for k in ("doc_id", "text", "copies")], strict=True):
            points = list(range(0, len(text), chunk))
            digest = hashlib.sha256(text.encode()).digest()[:16]
            for copy in range(copies):
                for i, p in enumerate(points):
                    last = i == len(points) - 1
                    row = (doc, digest, copy, i, len(points), text[p:] if last else text[p:p + chunk + overlap], p, len(text) if last else chunk, overlap if i else 0)
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
        yield out

    def each(batch: pa.RecordBatch):
        found = [encode_chunk(codec(), *x) for x in zip(*[batch.column(k).to_pylist() for k in ("text", "start", "own", "head")], strict=True)]
        yield {f: batch.column(f) for f in ("doc_id", "text_digest", "copy", "part", "parts", "text", "start")} | {
            "ids": [f[0] for f in found], "front": [f[1] for f in found], "back": [f[2] for f in found]}

    arrow = base._arrow_schema(docs.sparkSession, SCHEMA)

    def join(batches):
        rows = (r for b in batches for i in range(0, b.num_rows, 16) for r in b.slice(i, 16).to_pylist())
        for row, ids in join_parts(codec(), rows, chunk):
            yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("doc_id", "text_digest", "copy", "part", "parts")} | {"ids": ids}], schema=arrow)

    long = rows.where(F.length("text") > chunk).groupBy("doc_id", "text").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    chunks = base.map_arrow(long, cut, KEY + ", text string, start int, own int, head int").repartition("doc_id", "text_digest", "copy", "part")
    encoded = base.map_arrow(chunks, each, KEY + ", text string, start int, ids array<int>, front array<array<int>>, back array<array<int>>")
    ordered = encoded.repartition("doc_id", "text_digest", "copy").sortWithinPartitions("doc_id", "text_digest", "copy", "part")
    return base.map_arrow(rows.where(F.length("text") <= chunk), whole, SCHEMA).unionByName(ordered.mapInArrow(join, SCHEMA))


def digests(encoded: DataFrame, ranks: Ranks) -> DataFrame:
    """Per document the number of ids, their digest and the digest of the decoded bytes.

    Reads the rows of ``encode`` as it returns them (parts together and in order) and keeps only running digests.
    """
    data, pattern = ranks.data, ranks.pattern
    state: dict = {}

    def run(batch: pa.RecordBatch):
        if "codec" not in state:
            state["codec"] = Codec(data.value, pattern)
        c = state["codec"]
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")}
        column = batch.column("ids")
        flat = column.values.to_numpy(zero_copy_only=False)
        offsets = column.offsets.to_numpy()
        for i, (doc, part, parts) in enumerate(zip(*[batch.column(k).to_pylist() for k in ("doc_id", "part", "parts")], strict=True)):
            ids = flat[offsets[i]:offsets[i + 1]]
            if "n" not in state:
                state.update(n=0, ids=hashlib.sha256(), raw=hashlib.sha256())
            state["n"] += len(ids)
            state["ids"].update(ids.astype("<u4").tobytes())
            state["raw"].update(c.decode(ids.tolist()))
            if part == parts - 1:
                for k, v in zip(out, (doc, state.pop("n"), state.pop("ids").hexdigest(), state.pop("raw").hexdigest()), strict=True):
                    out[k].append(v)
        yield out

    return base.map_arrow(encoded, run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
