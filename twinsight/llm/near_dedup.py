"""Near-duplicates by MinHash and a multi-index Hamming join.

Every document's set of word shingles gets a signature of SYMBOLS b-bit MinHash symbols. The signature is split into
CHUNKS; by the pigeonhole principle two signatures that differ in at most DISTANCE places differ in at most one place
of some chunk, so each document is filed under each chunk with each one of its places left out, and every pair under
that distance meets in a bucket. Two documents that are similar at the threshold differ in DISTANCE places or fewer
with a probability of over 0.9995. Candidates are confirmed on their full sets.

Groups can be as large as the table, so pairs are never listed:

1. Documents with equal sets become one class; its first row stands for it.
2. Each bucket links its members to one hub, found by aggregation. A member's hub with most common keys is confirmed,
   which gives a forest, and the forest's trees are groups.
3. Buckets whose members then lie in one group are done. Groups that meet in the others make up clusters. A cluster's
   rows are cut into blocks, and pairs of blocks are compared by signature, then on full sets, within one task; rows of
   the cluster's largest group meet only rows outside it. A task gives only links that join groups not joined before.

So any pair under the distance is confirmed, refuted, or already connected. A cluster of m rows, s of them outside its
largest group, costs s * m comparisons of signatures at most and gives fewer than s links from each task.

Defined results: null or empty text, or text without a word, has an empty set and is linked with nothing; repeated
rows and rows with equal identifiers are told apart by row, so each is in the component of its own text; a null
identifier is grouped like others if its set is not empty, and is never a component's identifier while another one
exists; other columns are left out, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Words, arrow_map, by_pieces, discard, materialise, mix64, rolling, utf8

SIMILAR_PERCENT = 80
SYMBOLS, CHUNKS, DISTANCE = 128, 21, 41
_RNG = np.random.default_rng(20_240_229)
_MULTIPLY = (_RNG.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64) | 1).astype(np.uint32)
_XOR = _RNG.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32)
_CHUNKS = [c.tolist() for c in np.array_split(np.arange(SYMBOLS), CHUNKS)]
assert 2 * CHUNKS > DISTANCE  # one error allowed in each chunk


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and where each text's begin.

    A text of fewer words than width has one shingle, all its words; without words it has none.
    """
    w = Words(texts)
    hashes, count = w.hashes(), w.count
    whole = rolling(hashes, width)
    none = np.zeros(0, np.uint64)
    sets = []
    for n, first in zip(count.tolist(), w.first.tolist(), strict=False):
        if n >= width:
            own = np.sort(whole[first : first + n - width + 1])
            sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            sets.append(mix64(rolling(hashes[first : first + n], n) + np.uint64(n)) if n else none)
    return np.concatenate([none, *sets]), np.concatenate(([0], np.cumsum([len(x) for x in sets], dtype=np.int64)))


def signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of SYMBOLS bytes for each set that is not empty."""
    full = np.flatnonzero(first[1:] > first[:-1])
    out = np.zeros((len(full), SYMBOLS), np.uint8)
    if len(full):
        low = (value >> np.uint64(32)).astype(np.uint32)
        start = first[full]
        with np.errstate(over="ignore"):
            for k in range(SYMBOLS):
                least = np.minimum.reduceat((low ^ _XOR[k]) * _MULTIPLY[k], start)
                least = (least ^ (least >> 15)) * np.uint32(0x2C1B3C6D)
                out[:, k] = (least >> 24).astype(np.uint8)
    return out


def bucket_keys(sigs: np.ndarray) -> np.ndarray:
    """For each signature a key for each place: its chunk without that place."""
    terms = mix64(sigs.astype(np.uint64) + np.arange(SYMBOLS, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(1))
    out = np.empty(sigs.shape, np.uint64)
    with np.errstate(over="ignore"):
        for chunk in _CHUNKS:
            whole = terms[:, chunk].sum(1, dtype=np.uint64)
            for place in chunk:
                out[:, place] = mix64(whole - terms[:, place] + np.uint64(place))
    return out


def set_identity(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set; equal sets have equal ones. Empty sets have zeros."""
    with np.errstate(over="ignore"):
        total = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(value ^ np.uint64(salt)), dtype=np.uint64))) for salt in (0x5BD1E995, 0xC2B2AE3D27D4EB4F)]
        return tuple((t[first[1:]] - t[first[:-1]]).view(np.int64) for t in total)


def profiles(df: DataFrame, width: int) -> DataFrame:
    """doc_id, text, n (set size), c1 and c2 (identity of the set), sig; null sig for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_pieces(batches, "text"):
            value, first = shingle_sets(utf8(batch.column(1)), width)
            n, (c1, c2) = np.diff(first), set_identity(value, first)
            rows = iter(signatures(value, first))
            sig = [next(rows).tobytes() if k else None for k in n.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(c1), pa.array(c2), pa.array(sig, pa.binary())], names=["doc_id", "text", "n", "c1", "c2", "sig"])

    return arrow_map(df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, text string, n long, c1 long, c2 long, sig binary")


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: where each run of equal ones begins, and how long it is."""
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return start, np.diff(np.concatenate((start, [len(keys)])))


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=names)


#: Signatures that a task files at once: what the local pass of buckets() holds in memory.
_LOCAL = 8192


def _file_locally(shared: bool):
    """Bucket rows of blocks of signatures: those whose key occurs again in the block, or each key once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _LOCAL):
                part = batch.slice(at, _LOCAL)
                sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, SYMBOLS)
                keys, v = bucket_keys(sigs).ravel(), np.repeat(part.column(0).to_numpy(), SYMBOLS)
                order = np.lexsort((v, keys))
                keys, v = keys[order], v[order]
                start, size = _runs(keys)
                again = np.repeat(size > 1, size)
                if shared:
                    yield _batch(["key", "v", "hub"], keys[again], v[again], np.repeat(v[start], size)[again])
                else:
                    yield _batch(["key", "v"], keys[start], v[start])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and v those whose key occurs again, with its first v as hub; a key may span batches."""
    single = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last row, if its key has not been seen again so far
    known: tuple[int, int] | None = None  # the last key and its hub, if rows of it went out
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, v = (np.concatenate((s, batch.column(k).to_numpy())) for k, s in enumerate(single))
        start, size = _runs(keys)
        hub, again = np.repeat(v[start], size), np.repeat(size > 1, size)
        if known is not None and keys[0] == known[0]:
            hub[: size[0]], again[: size[0]] = known[1], True
        last = bool(again[-1])
        known = (int(keys[-1]), int(hub[-1])) if last else None
        single = (keys[:0], v[:0]) if last else (keys[-1:], v[-1:])
        yield _batch(["key", "v", "hub"], keys[again], v[again], hub[again])


def buckets(reps: DataFrame) -> DataFrame:
    """key, v, hub: all rows of buckets with two members or more.

    A task first meets its own rows, so that a key goes on once from each block of rows, however many share it there.
    """
    own = reps.select("v", "sig")
    dealt = arrow_map(own, _file_locally(False), "key long, v long").repartition("key").sortWithinPartitions("key", "v")
    across = arrow_map(dealt, _meet, "key long, v long, hub long")
    return materialise(arrow_map(own, _file_locally(True), "key long, v long, hub long").unionByName(across), "buckets")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum())


def links_between(side: np.ndarray, root: np.ndarray, sigs: np.ndarray | None, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Confirmed links (root, root) between rows of side 0 and rows of side 1, or among those of side 0 alone.

    Only links that join two groups not joined before come out: a spanning forest, however many pairs are similar.
    With signatures only pairs within DISTANCE are confirmed. Common shingles of a row with all others are counted at
    once from the other side's sorted shingles.
    """
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(right)
    right = left if alone else right
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    label, found = root.copy(), []
    index = None
    for p, x in enumerate(left.tolist()):
        others = right[p + 1 :] if alone else right
        near = (label[others] != label[x]) & (100 * np.minimum(size[others], size[x]) >= SIMILAR_PERCENT * np.maximum(size[others], size[x]))
        at = others[near]
        if len(at) and sigs is not None:
            at = at[(sigs[at] != sigs[x]).sum(1) <= DISTANCE]
        if not len(at):
            continue
        if len(at) <= 4:
            both = np.array([_common(sets[x], sets[y]) for y in at.tolist()])
        else:
            if index is None:
                value, owner = np.concatenate([sets[y] for y in right.tolist()]), np.repeat(right, size[right])
                order = np.argsort(value, kind="stable")
                index = value[order], owner[order]
            low, high = np.searchsorted(index[0], sets[x]), np.searchsorted(index[0], sets[x], side="right")
            width = high - low
            place = np.arange(width.sum()) + np.repeat(low - np.cumsum(width) + width, width)
            both = np.bincount(index[1][place], minlength=len(sets))[at]
        for y in at[100 * both >= SIMILAR_PERCENT * (size[x] + size[at] - both)].tolist():
            if label[y] != label[x]:
                found.append((int(root[x]), int(root[y])))
                label[label == label[y]] = label[x]
    return found


def compare(dealt: DataFrame, every: DataFrame, width: int) -> DataFrame:
    """a, b: confirmed links between groups, from rows (c, i, j, side, v, root, sig) dealt to comparisons (c, i, j).

    A comparison holds two blocks of bounded size; texts are joined to the few rows that are dealt, and sets are made
    anew from them in the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task: tuple | None = None
        held: list[list] = [[], [], [], []]  # side, root, sig, set

        def close() -> list[tuple[int, int]]:
            side, root, sig, sets = held
            if len(side) < 2:
                return []
            sigs = None if sig[0] is None else np.frombuffer(b"".join(sig), np.uint8).reshape(-1, SYMBOLS)
            return links_between(np.array(side), np.array(root, np.int64), sigs, sets)

        for batch in by_pieces(batches, "text"):
            value, first = shingle_sets(utf8(batch.column(6)), width)
            found = []
            for k, (*own, side, root, sig) in enumerate(zip(*(batch.column(x).to_pylist() for x in range(6)), strict=True)):
                if own != task:
                    found += close()
                    task, held = own, [[], [], [], []]
                for column, x in zip(held, (side, root, sig, value[first[k] : first[k + 1]]), strict=True):
                    column.append(x)
            yield _batch(["a", "b"], *np.array(found, np.int64).reshape(-1, 2).T.copy())
        yield _batch(["a", "b"], *np.array(close(), np.int64).reshape(-1, 2).T.copy())

    rows = dealt.join(every.select("v", "text"), "v").select("c", "i", "j", "side", "root", "sig", "text")
    return materialise(arrow_map(rows.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "side"), run, "a long, b long").distinct(), "links")


#: Rows and shingles of a block at most, on average over its hash.
_BLOCK_ROWS, _BLOCK_SHINGLES = 256, 1 << 20


def _parts(rows: Column, shingles: Column) -> Column:
    """How many blocks so many rows and shingles are cut into."""
    return F.greatest(F.ceil(rows / _BLOCK_ROWS), F.ceil(shingles / _BLOCK_SHINGLES), F.lit(1)).cast("long")


def _block(parts: str) -> Column:
    return F.pmod(F.xxhash64("v"), F.col(parts))


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join, whose hot keys Spark can split over tasks if both sides are tables and not aggregates.

    One that turns into a broadcast after its sides were dealt cannot be split.
    """
    return left.join(right.hint("merge"), on, how)


def hub_links(shared: DataFrame, reps: DataFrame, every: DataFrame, width: int) -> DataFrame:
    """a, b: for each representative b the hub a with which it shares most keys, if their sets confirm it; a < b."""
    by = shared.where("v <> hub").groupBy("hub", "v").agg(F.count(F.lit(1)).alias("keys")).where(F.col("keys") >= _HUB_KEYS)
    best = by.groupBy("v").agg(F.max(F.struct("keys", (-F.col("hub")).alias("hub"))).alias("best")).select("v", (-F.col("best.hub")).alias("c"))
    best = materialise(joined(best, reps.select("v", "n"), "v"), "hub-edges")
    parts = materialise(best.groupBy("c").agg(_parts(F.count(F.lit(1)), F.sum("n")).alias("parts")), "hubs")
    none = F.lit(None).cast("binary").alias("sig")
    spokes = joined(best, parts, "c").select("c", F.lit(0).alias("i"), _block("parts").alias("j"), F.lit(1).alias("side"), "v", F.col("v").alias("root"), none)
    hubs = parts.select("c", F.lit(0).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("j"), F.lit(0).alias("side"), F.col("c").alias("v"), F.col("c").alias("root"), none)
    out = compare(spokes.unionByName(hubs), every, width)
    discard(best)
    return out


def forest_roots(parents: DataFrame) -> DataFrame:
    """v, root for rows (v, root) that name each vertex's parent, or itself: pointers jump until they stay."""
    labels = materialise(parents, "groups")
    while True:
        above = labels.select(F.col("v").alias("root"), F.col("root").alias("above"))
        step = materialise(joined(labels, above, "root").select("v", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "groups")
        discard(labels)
        labels = step
        if step.where("moved").isEmpty():
            return labels.drop("moved")


def components(edges: DataFrame) -> DataFrame:
    """v, root for each vertex of the edges (a, b): its component's smallest vertex.

    Each vertex goes to its smallest neighbour, the trees that this gives become vertices, and edges between different
    ones go on to the next round; most edges are gone after the first.
    """
    left = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    while True:
        ends = left.select(F.col("a").alias("v"), F.col("b").alias("o")).unionByName(left.select(F.col("b").alias("v"), F.col("a").alias("o")))
        trees = forest_roots(ends.groupBy("v").agg(F.min("o").alias("o")).select("v", F.least("v", "o").alias("root")))
        if labels is None:
            labels = trees
        else:
            moves = trees.select(F.col("v").alias("root"), F.col("root").alias("to"))
            labels = materialise(joined(labels, moves, "root", "left").select("v", F.coalesce("to", "root").alias("root")), "labels")
        ends = joined(joined(left, trees.withColumnsRenamed({"v": "a", "root": "x"}), "a"), trees.withColumnsRenamed({"v": "b", "root": "y"}), "b")
        now = materialise(ends.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
        discard(left)
        left = now
        if left.isEmpty():
            return labels


def open_rows(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """v, root, low: rows of buckets whose members lie in several groups, low being the bucket's smallest root."""
    at = materialise(joined(shared.select("key", "v"), groups, "v"), "bucket-groups")
    ends = materialise(at.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "low"), "open-keys")
    out = materialise(joined(at, ends, "key").select("v", "root", "low").distinct(), "open-buckets")
    discard(at)
    return out


def deal(members: DataFrame) -> DataFrame:
    """Comparisons (c, i, j) for rows (v, root, c, n, sig) of clusters c, so that rows of different groups meet.

    Rows of a cluster's largest group need no comparison with each other. The others are cut into blocks i, the largest
    group's rows into blocks j; each i meets each j, and each pair of blocks i (with j counted on from the last).
    """
    sizes = members.groupBy("c", "root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    heads = sizes.groupBy("c").agg(F.max(F.struct("rows", "root", "shingles")).alias("top"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"))
    heads = heads.select("c", F.col("top.root").alias("head"), _parts(F.col("top.rows"), F.col("top.shingles")).alias("js"), _parts(F.col("rows") - F.col("top.rows"), F.col("shingles") - F.col("top.shingles")).alias("is"))
    rows = joined(members, materialise(heads, "heads"), "c").withColumn("in_head", F.col("root") == F.col("head"))
    rows = rows.withColumn("block", F.when(F.col("in_head"), _block("js")).otherwise(_block("is")))
    upto = lambda k: F.sequence(F.lit(0).cast("long"), F.col(k) - 1)
    place = lambda i, j, side: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), side.cast("int").alias("side"))
    of_head = F.transform(upto("is"), lambda i: place(i, F.col("block"), F.lit(1)))
    with_head = F.transform(upto("js"), lambda j: place(F.col("block"), j, F.lit(0)))
    with_rest = F.transform(upto("is"), lambda k: place(F.least("block", k), F.col("js") + F.greatest("block", k), F.when(F.col("block") <= k, 0).otherwise(1)))
    return rows.select("c", F.explode(F.when(F.col("in_head"), of_head).otherwise(F.concat(with_head, with_rest))).alias("at"), "v", "root", "sig").select("c", "at.*", "v", "root", "sig")


_NO_ID = (1 << 63) - 1
#: Keys that a hub and a member share at least before their sets are looked at; pairs with fewer are left to deal().
_HUB_KEYS = 4


def near_duplicates(documents: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    every = materialise(profiles(documents, width).withColumn("v", F.monotonically_increasing_id()), "profiles")
    classes = every.where("n > 0").groupBy("c1", "c2").agg(F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("id"), F.min("v").alias("v"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = materialise(classes, "representatives")
    shared = buckets(reps)
    linked = hub_links(shared, reps, every, width)
    groups = forest_roots(shared.select("v").distinct().join(linked.select(F.col("b").alias("v"), "a"), "v", "left").select("v", F.coalesce("a", "v").alias("root")))
    left = open_rows(shared, groups)
    discard(shared)
    if not left.isEmpty():
        clusters = components(left.where("root <> low").select(F.col("root").alias("a"), F.col("low").alias("b")).distinct())
        own = joined(left.select("v", "root").distinct(), clusters.select(F.col("v").alias("root"), F.col("root").alias("c")), "root")
        members = materialise(joined(own, reps.select("v", "n", "sig"), "v"), "open-members")
        links = compare(deal(members), every, width)
        if not links.isEmpty():
            moves = components(links).select(F.col("v").alias("root"), F.col("root").alias("to"))
            groups = materialise(joined(groups, moves, "root", "left").select("v", F.coalesce("to", "root").alias("root")), "groups")
    # A representative that shares no bucket has no group: it is its own, lest all of these meet as nulls.
    named = materialise(joined(reps.select("c1", "c2", "v", "id"), groups, "v", "left").withColumn("root", F.coalesce("root", "v")), "named")
    lowest = materialise(named.groupBy("root").agg(F.min("id").alias("low")), "lowest")
    named = joined(named, lowest, "root").select("c1", "c2", "low")
    own = F.coalesce("doc_id", F.lit(_NO_ID))
    out = joined(every.select("doc_id", "n", "c1", "c2"), named, ["c1", "c2"], "left").withColumn("low", F.when(F.col("n") > 0, F.col("low")).otherwise(own))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.nullif("low", F.lit(_NO_ID)).alias("component_id"), (own == F.col("low")).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)
