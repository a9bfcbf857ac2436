"""Hierarchical best-fit packing: partitions pack locally and emit bins; the few that may still gain merge up a tree.

Only lengths travel; token ids never leave the task that encodes. Pieces are dealt evenly over partitions, each packs
its own by best fit in falling order of length and writes its bins. After best fit at most one bin of a partition is
half full or less, because two such bins would have been one. A merge needs such a bin on one side, and any bin that
can take it can be replaced by an emptier one. So a partition passes up its CARRY emptiest bins, and every group of
FAN_IN partitions packs these as items by the same rule, until one group is left: each level has a bounded number of
rows for each partition below it.

Defined results: null text counts as empty and becomes a piece with the end id alone; repeated rows are packed like
any others; a null identifier stays null; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import arrow_map, by_pieces, materialise
from .tokens import encoder

CAPACITY = 4096
CARRY = 64
FAN_IN = 8
GROUPS_PER_TASK = 4
ROWS_PER_PARTITION = 1 << 15
_BIN_BITS = 33


def pieces_of(df: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: ids of each document with the end id, cut at capacity."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, end_id.to_bytes(4, "little")
        for batch in by_pieces(batches, text):
            rows = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(body) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, types, strict=True)], names=names)

    return arrow_map(df.select(F.col(doc_id).cast("long"), F.col(text).cast("string").alias(text)), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: Iterable[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """Each item's bin and offset, and each bin's fill, taking items in the given order.

    Open bins are stacked by what they have left; a number with a bit for each non-empty stack finds the tightest.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, fills, some = [], [], [], 0
    for n in lengths:
        fitting = some >> n
        if fitting:
            left = n + (fitting & -fitting).bit_length() - 1
            b = stacks[left].pop()
            if not stacks[left]:
                some &= ~(1 << left)
        else:
            b, left = len(fills), capacity
            fills.append(0)
        bins.append(b)
        offsets.append(fills[b])
        fills[b] += n
        left -= n
        if left:
            stacks[left].append(b)
            some |= 1 << left
    return bins, offsets, fills


def _pack_partition(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        lengths = table.column("length").to_numpy()
        order = np.argsort(-lengths, kind="stable")
        bins, offsets, fills = best_fit(lengths[order].tolist(), capacity)
        first = TaskContext.get().partitionId() << _BIN_BITS
        table = table.take(pa.array(order))
        table = table.append_column("bin", pa.array(first + np.array(bins, np.int64))).append_column("offset", pa.array(np.array(offsets, np.int64)))
        table = table.append_column("fill", pa.array(np.array(fills, np.int64)[np.array(bins)]))
        carried = sorted(range(len(fills)), key=lambda b: (fills[b], b))[:CARRY]
        up = np.zeros(len(fills), bool)
        up[carried] = True
        yield from table.append_column("up", pa.array(up[np.array(bins)])).combine_chunks().to_batches()

    return run


def _merge_groups(capacity: int):
    """For groups of carried bins: root is the bin that a bin is in by now, shift its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        for group in sorted({r["group"] for r in rows}):
            own = [r for r in rows if r["group"] == group]
            fill = {r["root"]: r["fill"] for r in own}
            roots = sorted(fill, key=lambda b: (-fill[b], b))
            bins, offsets, fills = best_fit([fill[b] for b in roots], capacity)
            heads: dict[int, int] = {}
            for b, at in zip(roots, bins, strict=True):
                heads.setdefault(at, b)
            moved = {b: (heads[at], off, fills[at]) for b, at, off in zip(roots, bins, offsets, strict=True)}
            up = {heads[at] for at in sorted(range(len(fills)), key=lambda at: (fills[at], heads[at]))[:CARRY]}
            out = [(r["bin"], (m := moved[r["root"]])[0], r["shift"] + m[1], m[2], group // FAN_IN, m[0] in up) for r in own]
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5])], names=["bin", "root", "shift", "fill", "group", "up"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece and length; lengths lie from 1 to capacity."""
    pieces = materialise(pieces, "pieces")
    parts = max(1, -(-pieces.count() // rows_per_partition))
    # Rows of each task are dealt in turn by falling length, not by a key: partitions are even, hold the same mix of
    # lengths, and repeated rows are no hot key.
    turn = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + F.spark_partition_id()
    dealt = pieces.sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32").withColumn("turn", turn)
    dealt = dealt.repartitionById(parts, F.pmod("turn", F.lit(parts)).cast("int")).drop("turn").sortWithinPartitions("doc_id", "piece", "ids_crc32")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    local = materialise(arrow_map(dealt, _pack_partition(capacity), f"{kinds}, bin long, offset long, fill long, up boolean"), "local-bins")
    carried = local.where("up").groupBy("bin").agg(F.first("fill").alias("fill")).select(
        "bin", F.col("bin").alias("root"), F.lit(0).cast("long").alias("shift"), "fill", F.expr(f"shiftright(bin, {_BIN_BITS}) div {FAN_IN}").alias("group"), F.lit(True).alias("up"))
    groups, settled = max(1, -(-dealt.rdd.getNumPartitions() // FAN_IN)), None
    while True:
        level = materialise(arrow_map(carried.repartition(-(-groups // GROUPS_PER_TASK), "group"), _merge_groups(capacity), "bin long, root long, shift long, fill long, group long, up boolean"), "merged-bins")
        if groups == 1:
            settled = level if settled is None else settled.unionByName(level)
            break
        done, carried = level.where("not up"), level.where("up")
        settled = done if settled is None else settled.unionByName(done)
        groups = -(-groups // FAN_IN)
    kept = [f.name for f in pieces.schema]
    moved = settled.select(F.col("bin"), "root", "shift")
    return local.join(moved, "bin", "left").select(*kept, F.coalesce("root", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer)


def pack_documents(documents: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(pieces_of(documents, tokenizer, end_id))
