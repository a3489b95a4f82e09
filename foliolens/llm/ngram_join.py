"""N-gram Jaccard join with a count-vector R-tree.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document is its set of distinct word shingles. Shingles are
hashed into groups and a document is the point of its group counts. For two points the sum of coordinate minima bounds
the overlap of the sets from above; the same bound between the upper corners of two tree nodes covers all their points.

1. Documents of one set are a class; only classes go on.
2. Directory: the fine groups (hash values) of a class that are rarest by the document counts of 2**24 coarse groups.
   Two sets with the wanted overlap share one of their first ``n - ceil(t n) + 1`` fine groups under any common order, so
   no link is lost when only classes with a common fine group meet. Common passages come last in the order.
3. Under each fine group a point stays only if another one is of a possible size and passes the bound. What is left is
   packed into leaf nodes of at most ``NODE`` points: by the least class they reach over a few shared fine groups, then
   size and counts. A node holds its points, their sets and its upper corner. Links inside a
   node are found as it is packed; linked classes become components.
4. Nodes that share a fine group are joined unless all their points are in one component already: corner bound, point
   bound, then whole sets. A node pair reports a spanning forest of its links, so a group of near copies is never
   listed as all its pairs and no link between components is lost.

Defined results: a null or empty text has no shingles, is linked with nothing and is its own component; fewer words than
a shingle are one shingle; rows of one set are one class, so repeated rows agree; a component without any id is null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import base
from .components import connected_components

SIZE = 4
PERCENT = 85
COARSE_BITS = 24  # coarse groups whose document counts order the fine groups: 16 MB, at any input size
BLOCKS = 256
STEPS = 8
GROUPS = 64  # coordinates of a point
NODE = 256  # points of a leaf
NODE_BYTES = 1 << 20  # and bytes of its sets, beyond which no further point comes in
HOME = 4096  # classes of a fine group packed by one task
_U = np.uint64


def shingle_sets(texts: list[bytes], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order of (text, hash), and their number per text."""
    hashes, counts = base.word_hashes(texts, base.SPACES, lower=True)
    grams, owner = base.windows(hashes, counts, size)
    ends = np.cumsum(counts)
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        # the words of a short text in order, marked by their number so that no full shingle equals them
        whole = np.array([_sequence(hashes[ends[i] - counts[i]:ends[i]]) for i in few], _U)
        grams, owner = np.concatenate([grams, whole]), np.concatenate([owner, few])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.bincount(owner[new], minlength=len(texts))


def _sequence(words: np.ndarray) -> int:
    value = np.array([len(words)], _U)
    for w in words:
        value = base.mix(value * _U(0x9FB21C651E98DF25) + w)
    return int(value[0])


def _sum_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum modulo 2**64 of the values of each row."""
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values, out=sums[1:])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def _class_ids(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return base.mix(_sum_by(base.mix(grams ^ _U(0xA5A5A5A5A5A5A5A5)), counts)).view(np.int64)


def coarse_counts(docs: DataFrame, size: int) -> np.ndarray:
    """Rank of each coarse group by its number of documents: 8 steps for each doubling, in one byte.

    Tasks count all documents, Spark deals the blocks of counts and they are summed; equal ranks are told apart by hash.
    """
    slots, block = 1 << COARSE_BITS, (1 << COARSE_BITS) // BLOCKS
    schema = "g int, counts binary, wide int"
    kinds = {1: np.uint8, 2: np.uint16, 8: np.int64}
    arrow = base._arrow_schema(docs.sparkSession, schema)

    def rows(total: dict[int, np.ndarray]):
        for g, part in total.items():
            if part.any():
                part = part.astype(np.uint8 if part.max() < 256 else np.uint16 if part.max() < 65536 else np.int64)
                yield pa.RecordBatch.from_pylist([{"g": g, "counts": zlib.compress(part.tobytes(), 1), "wide": part.itemsize}], schema=arrow)

    def count(batches):
        total = np.zeros(slots, np.int32)
        for batch in batches:
            texts = base.byte_strings(batch.column("text"))
            for first, last in base.slices(texts, 4 * base.SLICE):
                grams, _ = shingle_sets(texts[first:last], size)
                np.add.at(total, (grams >> _U(64 - COARSE_BITS)).astype(np.int64), 1)
        yield from rows({g: total[g * block:(g + 1) * block] for g in range(BLOCKS)})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, counts, wide in zip(*[batch.column(c).to_pylist() for c in ("g", "counts", "wide")], strict=True):
                total[g] = total.get(g, 0) + np.frombuffer(zlib.decompress(counts), kinds[wide]).astype(np.int64)
        yield from rows(total)

    out = np.zeros(slots, np.uint8)
    for row in docs.select("text").mapInArrow(count, schema).repartition("g").mapInArrow(add, schema).toLocalIterator():
        counts = np.frombuffer(zlib.decompress(row["counts"]), kinds[row["wide"]])
        out[row["g"] * block:(row["g"] + 1) * block] = np.minimum(255, np.rint(STEPS * np.log2(1.0 + counts)))
    return out


def _points(grams: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Group counts of each set."""
    cell = np.repeat(np.arange(len(n)), n) * GROUPS + (grams & _U(GROUPS - 1)).astype(np.int64)
    return [p.tobytes() for p in np.bincount(cell, minlength=len(n) * GROUPS).astype("<u4").reshape(-1, GROUPS)]


def directory(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, cid, keys, point): per row its set size, class id, rarest fine groups and group counts."""
    weight = docs.sparkSession.sparkContext.broadcast(coarse_counts(docs, size))

    def run(batch: pa.RecordBatch):
        texts = base.byte_strings(batch.column("text"))
        for first, last in base.slices(texts):
            grams, n = shingle_sets(texts[first:last], size)
            owner = np.repeat(np.arange(last - first), n)
            count = weight.value[(grams >> _U(64 - COARSE_BITS)).astype(np.int64)]
            order = np.lexsort((count, owner))  # stable: equal counts stay in order of the hash
            take = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
            rank = np.arange(len(grams)) - (np.cumsum(n) - n)[owner]
            keys = grams[order][rank < take[owner]].view(np.int64)
            yield {"doc_id": batch.column("doc_id").slice(first, last - first), "n": n, "cid": _class_ids(grams, n), "keys": base.lists(keys, take, pa.int64()),
                   "point": _points(grams, n)}

    return base.map_arrow(docs, run, "doc_id bigint, n int, cid bigint, keys array<bigint>, point binary")


def _needed(na, nb, percent: int):
    """Least overlap of two sets of these sizes that makes a link."""
    return -(-percent * (na + nb) // (100 + percent))


def class_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cid, n, grams, point) of the classes of ``wanted`` (cid, n, rep): only their texts are made into sets again."""
    wanted = base.staged(wanted.select("cid", "n", F.xxhash64("rep").alias("slot")), "wanted")
    seen = docs.sparkSession.sparkContext.broadcast(base.bitmap(wanted, "slot", wanted.count()))

    def run(batch: pa.RecordBatch):
        hit = base.in_bitmap(seen.value, batch.column("slot").to_numpy().view(_U))
        texts = base.byte_strings(batch.column("text").filter(pa.array(hit)))
        for first, last in base.slices(texts):
            grams, n = shingle_sets(texts[first:last], size)
            ends = np.cumsum(n)
            yield {"cid": _class_ids(grams, n), "n": n, "grams": [grams[e - k:e].tobytes() for e, k in zip(ends, n, strict=True)], "point": _points(grams, n)}

    rows = base.map_arrow(docs.select("text", F.xxhash64("doc_id").alias("slot")), run, "cid bigint, n int, grams binary, point binary")
    # one row per class: rows of a class are equal
    return rows.join(wanted.select("cid", "n").distinct(), ["cid", "n"], "left_semi").dropDuplicates(["cid", "n"])


class Leaf:
    """The points of a node in numpy form."""

    def __init__(self, n, points: bytes, grams: bytes):
        self.n = np.asarray(n, np.int64)
        self.points = np.frombuffer(points, "<u4").reshape(-1, GROUPS)
        self.grams = np.frombuffer(grams, _U)
        self.owner = np.repeat(np.arange(len(self.n)), self.n)


def leaf_links(a: Leaf, b: Leaf, percent: int, root_a: list, root_b: list) -> list[tuple[int, int]]:
    """A spanning forest of the links between the points of two leaves that are not yet in one component."""
    if np.minimum(a.points.max(axis=0), b.points.max(axis=0)).sum(dtype=np.int64) < _needed(int(a.n.min()), int(b.n.min()), percent):
        return []
    parent: dict = {}

    def find(x):
        while x in parent:
            x = parent[x]
        return x

    same = a is b
    maybe: list[tuple[int, np.ndarray]] = []
    for i in range(len(a.n)):
        ok = (100 * np.minimum(a.n[i], b.n) >= percent * np.maximum(a.n[i], b.n)) & (np.minimum(a.points[i], b.points).sum(axis=1, dtype=np.int64) >= _needed(a.n[i], b.n, percent))
        if same:
            ok[:i + 1] = False
        hit = np.flatnonzero(ok)
        if len(hit):
            maybe.append((i, hit))
    if not maybe:
        return []
    # exact overlaps: a 0/1 matrix of the points over shingles that both leaves hold
    shared = np.intersect1d(a.grams, b.grams)
    matrix = np.zeros((len(b.n), len(shared)), np.float32)
    if len(shared):
        at = np.minimum(np.searchsorted(shared, b.grams), len(shared) - 1)
        inside = shared[at] == b.grams
        matrix[b.owner[inside], at[inside]] = 1
    ends = np.cumsum(a.n)
    found = []
    for i, hit in maybe:
        if not len(shared):
            break
        mine = a.grams[ends[i] - a.n[i]:ends[i]]
        at = np.minimum(np.searchsorted(shared, mine), len(shared) - 1)
        overlap = matrix[:, at[shared[at] == mine]].sum(axis=1).astype(np.int64)[hit]
        for j in hit[100 * overlap >= percent * (a.n[i] + b.n[hit] - overlap)]:
            x, y = find(root_a[i]), find(root_b[j])
            if x != y:
                parent[x] = y
                found.append((i, int(j)))
    return found


NODE_SCHEMA = ("node string, lo int, hi int, cid array<bigint>, n array<int>, keys array<bigint>, link_a array<int>, link_b array<int>, points binary, grams binary")


def pack(classes: DataFrame, percent: int = PERCENT, node: int = NODE, size_limit: int = NODE_BYTES) -> DataFrame:
    """Leaf nodes with the links inside them, from classes (home, salt, cid, n, point, grams, keys)."""
    ordered = classes.repartition("home", "salt").sortWithinPartitions("home", "salt", "n", "point", "cid")
    arrow = base._arrow_schema(classes.sparkSession, NODE_SCHEMA)

    def run(batches):
        held, key, number, weight = [], None, 0, 0

        def full():
            points, grams = (b"".join(r[c] for r in held) for c in ("point", "grams"))
            n = [r["n"] for r in held]
            leaf = Leaf(n, points, grams)
            links = leaf_links(leaf, leaf, percent, *[list(range(len(n)))] * 2)
            return pa.RecordBatch.from_pylist([{
                "node": f"{key[0]}:{key[1]}:{number}", "lo": min(n), "hi": max(n), "cid": [r["cid"] for r in held], "n": n,
                "keys": sorted({k for r in held for k in r["keys"]}), "link_a": [i for i, _ in links], "link_b": [j for _, j in links],
                "points": points, "grams": grams}], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    mine = (row["home"], row["salt"])
                    if held and (mine != key or len(held) == node or weight > size_limit):
                        yield full()
                        held, weight = [], 0
                        number = number + 1 if mine == key else 0
                    key = mine
                    held.append(row)
                    weight += len(row["grams"])
        if held:
            yield full()

    return ordered.mapInArrow(run, NODE_SCHEMA)


def _cross_links(pairs: DataFrame, nodes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(ca, na, cb, nb): links between the points of node pairs (a, b) that join components."""
    full = nodes.select("node", "cid", "n", "points", "grams").join(roots, "node")
    side = lambda s: full.select(*[F.col(c).alias(f"{c}_{s}") for c in full.columns])
    both = pairs.join(side("a"), F.col("a") == F.col("node_a")).join(side("b"), F.col("b") == F.col("node_b"))

    def run(batch: pa.RecordBatch):
        out: dict[str, list] = {k: [] for k in ("ca", "na", "cb", "nb")}
        for at in range(batch.num_rows):
            r = batch.slice(at, 1).to_pylist()[0]
            a, b = (Leaf(r[f"n_{s}"], r[f"points_{s}"], r[f"grams_{s}"]) for s in "ab")
            for i, j in leaf_links(a, b, percent, r["root_a"], r["root_b"]):
                for k, v in zip(out, (r["cid_a"][i], r["n_a"][i], r["cid_b"][j], r["n_b"][j]), strict=True):
                    out[k].append(v)
        yield out

    return base.map_arrow(both, run, "ca bigint, na int, cb bigint, nb int")


def _class_key(n: Column, cid: Column) -> Column:
    """One value for a class: its size and id as text of fixed length."""
    return F.concat(F.lpad(F.hex(n), 8, "0"), F.lpad(F.hex(cid), 16, "0"))


def shared_groups(marked: DataFrame, percent: int) -> DataFrame:
    """(key, cid, n): classes under each fine group that may be linked to another class there."""
    firsts = base.staged(marked.where("n > 0").select("cid", "n", "keys", "point").dropDuplicates(["cid", "n"]), "firsts")
    several = base.staged(firsts.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "several")
    seen = marked.sparkSession.sparkContext.broadcast(base.bitmap(several, "key", several.count()))

    def run(batch: pa.RecordBatch):
        column = batch.column("keys")
        keys = column.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
        hit = base.in_bitmap(seen.value, keys.view(_U))
        at = pa.array(owner[hit])
        yield {"key": keys[hit], "cid": batch.column("cid").take(at), "n": batch.column("n").take(at)}

    shared = base.map_arrow(firsts, run, "key bigint, cid bigint, n int").join(several, "key")
    order = Window.partitionBy("key").orderBy("n", "cid")
    near = lambda other: F.coalesce(100 * F.least("n", other) >= percent * F.greatest("n", other), F.lit(False))
    shared = shared.withColumn("a", F.lag("n").over(order)).withColumn("b", F.lead("n").over(order)).where(near(F.col("a")) | near(F.col("b"))).drop("a", "b")
    sized = base.staged(shared, "sized")
    # the point bound only saves work: a very common fine group is left to the nodes
    small = bound(sized.where(F.col("m") <= HOME).join(firsts.select("cid", "n", "point"), ["cid", "n"]), percent)
    return small.unionByName(sized.where(F.col("m") > HOME).select("key", "cid", "n"))


def bound(entries: DataFrame, percent: int) -> DataFrame:
    """(key, cid, n) of entries (key, cid, n, point) that pass the bound with another entry of their key."""
    arrow = base._arrow_schema(entries.sparkSession, "key bigint, cid bigint, n int")
    ordered = entries.select("key", "cid", "n", "point").repartition("key").sortWithinPartitions("key", "n", "cid")

    def judge(key, cid, n, points):
        p, size, stays = np.frombuffer(b"".join(points), "<u4").reshape(-1, GROUPS), np.array(n, np.int64), np.zeros(len(n), bool)
        for i in range(len(n)):  # in order of size; a pair is seen from its smaller point
            far = int(np.searchsorted(size, 100 * size[i] // percent, "right"))
            ok = np.minimum(p[i], p[i + 1:far]).sum(axis=1, dtype=np.int64) >= _needed(size[i], size[i + 1:far], percent)
            stays[i] |= ok.any()
            stays[i + 1:far] |= ok
        return [(key, c, k) for c, k, s in zip(cid, n, stays, strict=True) if s]

    def run(batches):
        now, held, out = None, ([], [], []), []
        for batch in batches:
            for key, *row in zip(*[batch.column(c).to_pylist() for c in ("key", "cid", "n", "point")], strict=True):
                if key != now and held[0]:
                    out += judge(now, *held)
                    held = ([], [], [])
                now = key
                for column, value in zip(held, row, strict=True):
                    column.append(value)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out = []
        if held[0]:
            out += judge(now, *held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return ordered.mapInArrow(run, "key bigint, cid bigint, n int")


def homes_of(entries: DataFrame, rounds: int = 3) -> DataFrame:
    """(cid, n, keys, home, salt): where a class is packed; near classes get one home.

    A home is the least class id that is reached over ``rounds`` steps through shared fine groups. It only decides which
    points lie together; a home of very many classes is packed by several tasks.
    """
    label = entries.withColumn("home", F.col("cid"))
    for _ in range(rounds):
        by_key = label.groupBy("key").agg(F.min("home").alias("least"))
        by_class = label.join(by_key, "key").groupBy("cid", "n").agg(F.min("least").alias("home"))
        label = base.staged(entries.join(by_class, ["cid", "n"]), "homes")
    classes = label.groupBy("cid", "n", "home").agg(F.collect_list("key").alias("keys"))
    crowd = classes.groupBy("home").agg(F.count(F.lit(1)).alias("m"))
    return classes.join(crowd, "home").select("cid", "n", "keys", "home", F.pmod("cid", F.floor(F.col("m") / HOME) + 1).cast("int").alias("salt"))


def class_links(rows: DataFrame, marked: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, component) of linked classes; ids as in ``_class_key``."""
    spark = rows.sparkSession
    with base.passing(spark):
        with base.passing(spark):
            entries = base.staged(shared_groups(marked, percent), "entries", keep=True)
        homes = base.staged(homes_of(entries).join(classes, ["cid", "n"]), "homes")
        base.drop_staged(entries)
        base.free_shuffles(spark)
        full = class_sets(rows, homes.select("cid", "n", "rep"), size).join(homes.drop("rep"), ["cid", "n"])
        nodes = base.staged(pack(full, percent), "nodes", keep=True)
    at = lambda side: [F.get("n", f"l.link_{side}"), F.get("cid", f"l.link_{side}")]
    inside = nodes.select("cid", "n", F.explode(F.arrays_zip("link_a", "link_b")).alias("l")).select(_class_key(*at("a")).alias("a"), _class_key(*at("b")).alias("b"))
    inside = base.staged(inside, "links")
    found = base.staged(connected_components(inside), "components")
    # per node the components of its points, and which nodes share a fine group
    spots = nodes.select("node", F.posexplode(F.arrays_zip("cid", "n")).alias("i", "c")).select("node", "i", _class_key(F.col("c.n"), F.col("c.cid")).alias("id"))
    placed = spots.join(found, "id", "left").select("node", F.struct("i", F.coalesce("component", "id").alias("c")).alias("r"))
    roots = placed.groupBy("node").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["c"]).alias("root"))
    roots = base.staged(roots, "roots")
    only = roots.select("node", F.when(F.size(F.array_distinct("root")) == 1, F.get("root", F.lit(0))).alias("only"))
    shared = nodes.select("node", "lo", "hi", F.explode("keys").alias("key")).join(only, "node")
    other = shared.select(*[F.col(c).alias(f"{c}_b") for c in shared.columns])
    pairs = shared.join(other, (F.col("key") == F.col("key_b")) & (F.col("node") < F.col("node_b")) & (100 * F.col("hi") >= percent * F.col("lo_b"))
                        & (100 * F.col("hi_b") >= percent * F.col("lo")) & ~F.coalesce(F.col("only") == F.col("only_b"), F.lit(False)))
    pairs = base.staged(pairs.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    cross = base.staged(_cross_links(pairs, nodes.join(ids, "node", "left_semi"), roots, percent).select(_class_key(F.col("na"), F.col("ca")).alias("a"), _class_key(F.col("nb"), F.col("cb")).alias("b")), "cross")
    if cross.isEmpty():
        return found
    return base.staged(connected_components(inside.unionByName(cross)), "components")


def components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) for every row of ``docs``."""
    rows = base.id_text(docs, id_col, text_col)
    with base.passing(docs.sparkSession):
        marked = base.staged(directory(rows, size, percent), "directory")
        base.free_shuffles(docs.sparkSession)
        classes = base.staged(marked.where("n > 0").groupBy("cid", "n").agg(F.min("doc_id").alias("rep")), "classes")
        found = class_links(rows, marked, classes, size, percent)
        named = classes.withColumn("id", _class_key(F.col("n"), F.col("cid"))).join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        named = base.staged(named.select("cid", "n", "rep", "component"), "named")
        least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
        label = base.salted_join(named.select("cid", "n", "component"), least, ["component"], "inner").select("cid", "n", "component_id", F.col("component").alias("class_id"))
        label, each = base.staged(label, "labels", keep=True), base.staged(marked.select("doc_id", "n", "cid"), "members", keep=True)
    out = base.salted_join(each, label, ["cid", "n"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "class_id")


def keep_one(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all columns: that of the smallest id (null first), then digest; rows without words all stay.

    A row is known by its id and text: rows that share an id but not the text are judged apart, and of rows equal in
    both one stays.
    """
    key = F.xxhash64("doc_id", "text")
    with base.passing(docs.sparkSession):
        found = components(docs.select(key.alias("doc_id"), "text"), size, percent).where("n_shingles > 0")
        each = base.staged(found.groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("copies")).withColumnRenamed("doc_id", "_key"), "grouped")
        ids = docs.select(key.alias("_key"), F.col("doc_id").alias("_id")).distinct()
        firsts = each.join(ids, "_key").groupBy("component_id").agg(F.min(F.struct("_id", "_key")).alias("stays"))
        judged = base.staged(base.salted_join(each, firsts, ["component_id"], "inner").select("_key", "copies", (F.col("_key") == F.col("stays._key")).alias("stays")), "judged", keep=True)
    marked = docs.withColumn("_key", key)
    left = marked.join(judged.where(~F.col("stays") | (F.col("copies") > 1)).select("_key"), "_key", "left_anti")
    once = marked.join(judged.where(F.col("stays") & (F.col("copies") > 1)).select("_key"), "_key", "left_semi").dropDuplicates(["_key"])
    return left.unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])
