"""Shared helpers: work folder, staged tables, salted look-ups, Arrow batches and vectorised word hashing.

Texts are handled as UTF-8 bytes. A task never holds more than one Arrow batch
and works on *slices* of it of about a megabyte, so the numpy temporaries are
bounded by the slice or by one document.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


# ---------------------------------------------------------------- tables

_OWN_FOLDER: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; only a local session may leave it unset and gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN_FOLDER:
            _OWN_FOLDER.append(tempfile.mkdtemp(prefix="foliolens-"))
        folder = _OWN_FOLDER[0]
    return folder.rstrip("/")


_PASSING: dict[int, list[list[str]]] = {}  # by thread; plain, as the module is sent to workers


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.

    Inside ``passing`` it goes at the end of the block; with ``keep`` at the end of the block around that, or never.
    """
    spark = df.sparkSession
    folder = f"{work_dir(spark)}/llm-{uuid.uuid4().hex}"
    blocks = _PASSING.get(threading.get_ident(), [])
    blocks = blocks[:-1] if keep else blocks
    if blocks:
        blocks[-1].append(folder)
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside the block go at its end, and so do the shuffle files of the jobs that wrote them."""
    mine: list[str] = []
    blocks = _PASSING.setdefault(threading.get_ident(), [])
    blocks.append(mine)
    try:
        yield
    finally:
        blocks.pop()
        for folder in mine:
            _remove(spark, folder)
        free_shuffles(spark)


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of ended jobs when the driver collects its garbage, perhaps much later: ask for it now."""
    spark._jvm.System.gc()


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(*tables: DataFrame) -> None:
    """Remove tables of ``staged`` that nothing will read again."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if re.search(r"/llm-[0-9a-f]{32}/[a-z]+$", folder):
                _remove(df.sparkSession, folder.rsplit("/", 1)[0])


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", salts: int = 16) -> DataFrame:
    """Join to a table with one row per key when a key may hold a large part of ``left``.

    Each left row takes a salt from its own content and each right row is
    repeated once per salt, so one hot key is dealt over ``salts`` tasks.
    """
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; other columns cannot clash."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def digest128(value: Column) -> Column:
    """128 bits of SHA-256 of a string or binary column; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(value, F.lit("").cast("binary")), 256), 1, 32))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches; ``fn`` yields dictionaries of equally long columns."""
    spark = df.sparkSession
    arrow = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                for out in fn(batch.slice(start, 2000)):
                    yield pa.RecordBatch.from_arrays([_column(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(schema))


def lists(flat, counts, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list column from flat values and the count per row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    values = flat if isinstance(flat, pa.Array) else pa.array(flat, type=kind)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


# ---------------------------------------------------------------- bytes and words

def byte_strings(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs [first, last) of documents of about ``limit`` bytes; a longer document is a run of its own."""
    first = size = 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def separators(pattern_bytes) -> np.ndarray:
    """Table over all byte values: True where a byte belongs to a word."""
    table = np.ones(256, bool)
    table[list(pattern_bytes)] = False
    return table


# fixed values: words are [^\x20\x09-\x0D]+ and, for benchmark matching, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
SPACES = separators([0x20, *range(0x09, 0x0E)])
LETTERS = separators([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte array of texts separated by line feeds, and where each text starts (with the end last)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return data, starts


def word_spans(data: np.ndarray, table: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = table[data]
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (splitmix64)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of each."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE + (SLICE >> 2))
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, factor, _U)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=_U)
    return _POWERS["up"], _POWERS["down"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix hash modulo 2**64, one longer than the data."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal spans at any place get equal hashes."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def word_hashes(texts: list[bytes], table: np.ndarray = SPACES, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts in order, and the number of words of each text.

    A long text is cut into blocks at its separators, so temporaries stay near a slice.
    """
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for first, last in slices(texts):
        data, starts = joined(texts[first:last])
        if lower:
            data = LOWER[data]
        at = 0
        while at < len(data):
            end = min(at + SLICE, len(data))
            if end < len(data):
                cut = np.flatnonzero(~table[data[at:end]])
                while not len(cut) and end < len(data):
                    end = min(end + SLICE, len(data))
                    cut = np.flatnonzero(~table[data[at:end]])
                if len(cut):
                    end = at + int(cut[-1]) + 1
            block = data[at:end]
            a, b = word_spans(block, table)
            hashes.append(span_hashes(prefix_sums(block), a, b))
            counts[first:last] += np.histogram(a + at, starts)[0] if last - first > 1 else len(a)
            at = end
    return (np.concatenate(hashes) if hashes else np.zeros(0, _U)), counts


def windows(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words inside one text, and the text each belongs to."""
    n = len(hashes) - size + 1
    owner = np.repeat(np.arange(len(counts)), counts)
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    out = hashes[:n].copy()
    for i in range(1, size):
        out = mix(out * _U(0x9FB21C651E98DF25) + hashes[i:i + n])
    whole = owner[:n] == owner[size - 1:]
    return out[whole], owner[:n][whole]


# ---------------------------------------------------------------- bounded filters for broadcast

def bitmap_size(rows: int, most: int = 1 << 29) -> int:
    """Bits of a membership map: 16 for each row, a power of two, at most 64 MB."""
    return min(most, 1 << max(16, int(rows * 16 - 1).bit_length() if rows else 16))


def bitmap(df: DataFrame, key: str, rows: int) -> np.ndarray:
    """Membership map of a 64-bit key column, built by a bitwise aggregate; its size has a fixed bound.

    A set bit may belong to another key, so a hit means "perhaps": it only saves
    work and never decides a result. Only the words of the map, not keys, reach the driver.
    """
    bits = bitmap_size(rows)
    words = (df.select(F.pmod(F.col(key), F.lit(bits)).alias("slot"))
             .selectExpr("slot div 64 AS w", "shiftleft(1L, CAST(slot % 64 AS INT)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")))
    block = words.groupBy(F.floor(F.col("w") / 4096).alias("g")).agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("x"))
    out = np.zeros(bits // 64, np.int64)
    for row in block.toLocalIterator():
        for w, b in row["x"]:
            out[w] = b
    return out.view(_U)


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = len(words) * 64
    slot = keys & _U(bits - 1)  # bits is a power of two, as in ``bitmap``
    return (words[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63))) & _U(1) != 0
