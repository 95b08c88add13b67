"""Texts in windows of fixed size (problem 7): hierarchical residual packing.

Level 0 is a map over the partitions of the texts: sizes are counted in tokens, a text longer than a window gives whole
windows and a rest, and the rests are packed best-fit in order of size. Nearly full windows are emitted; the texts of the
others go up the tree, where groups of tasks' residues are packed again, until one root task has what is left. A task sends
at most ``MAX_UP`` texts up and emits its fullest windows beyond that as they are, so that the root's input is bounded by
FAN_IN * MAX_UP whatever the sizes are; every text gets its window.

Defined results: a text of no tokens (null, empty) has one row of size 0 in some window; repeated documents are packed as
often as they occur; an empty table has no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from recallgrid.llm.bpe import DEFAULT_RANKS, encoder
from recallgrid.session import cut_lineage, spread

WINDOW = 2048
#: A window of at least this share is emitted at once.
NEARLY_FULL = 0.995
FAN_IN, MAX_UP, CHUNK = 8, 50_000, 200_000
_COLUMNS = ["part", "size", "window_id"]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item, and each bin's fill: items in falling order of size, each into the fullest bin that has room."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    room, fills = 0, []  # bit f of room: some bin has f free
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = room >> size
        if fitting:
            f = size + (fitting & -fitting).bit_length() - 1
            b = free[f].pop()
            if not free[f]:
                room &= ~(1 << f)
            fills[b] += size
            f -= size
        else:
            b, f = len(fills), capacity - size
            fills.append(size)
        free[f].append(b)
        room |= 1 << f
        bins[i] = b
    return bins, np.asarray(fills, dtype=np.int64)


def _settle(sizes: np.ndarray, capacity: int, root: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bins, and which items' bins are emitted now."""
    bins, fills = best_fit(sizes, capacity)
    done = np.ones(len(fills), dtype=bool) if root else fills >= NEARLY_FULL * capacity
    if not root:
        left = np.bincount(bins[~done[bins]], minlength=len(fills)) if len(fills) else np.zeros(0, dtype=np.int64)
        excess = int(left.sum()) - MAX_UP
        if excess > 0:
            for b in np.argsort(-fills, kind="stable"):
                if not done[b]:
                    done[b] = True
                    excess -= int(left[b])
                    if excess <= 0:
                        break
    return bins, done[bins] if len(fills) else np.zeros(0, dtype=bool)


def _batch(key: pa.Array, part, size, window) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key, pa.array(part, pa.int32()), pa.array(size, pa.int32()), pa.array([None if w < 0 else w for w in window], pa.int64())], names=["_key", *_COLUMNS])


class _Packer:
    """Packs the items of one task in chunks; window ids are unique by level, task and number."""

    def __init__(self, capacity: int, level: int, task: int, root: bool):
        self.capacity, self.root, self.next_id = capacity, root, (level << 58) | (task << 34)
        self.keys: list = []
        self.parts: list[int] = []
        self.sizes: list[int] = []
        self.some = -1

    def window(self) -> int:
        self.next_id += 1
        return self.next_id

    def add(self, key, part: int, size: int) -> None:
        self.keys.append(key)
        self.parts.append(part)
        self.sizes.append(size)

    def flush(self, kind: pa.DataType, end: bool):
        """Emitted items with their window, at the end also the rest without one."""
        sizes = np.asarray(self.sizes, dtype=np.int64)
        empty = sizes == 0
        bins, done = _settle(sizes[~empty], self.capacity, self.root and end)
        window = np.full(len(sizes), -1, dtype=np.int64)
        ids = {b: self.window() for b in np.unique(bins[done]).tolist()}
        at = np.flatnonzero(~empty)
        window[at[done]] = [ids[b] for b in bins[done].tolist()]
        if ids:
            self.some = next(iter(ids.values()))
        if empty.any() and (end or self.some >= 0):
            if self.some < 0:
                self.some = self.window()
            window[empty] = self.some
        out = np.flatnonzero(window >= 0) if not end else np.arange(len(sizes))
        keep = np.flatnonzero(window < 0) if not end else np.zeros(0, dtype=np.int64)
        batch = _batch(pa.array([self.keys[i] for i in out], kind), [self.parts[i] for i in out], sizes[out], window[out])
        self.keys, self.parts, self.sizes = [self.keys[i] for i in keep], [self.parts[i] for i in keep], sizes[keep].tolist()
        return batch


def _merger(capacity: int, level: int, root: bool):
    """The task of an upper level: packs the residues of its group of tasks."""

    def merge(group, table):
        task, kind = group[0].as_py(), table.schema.field("_key").type
        packer = _Packer(capacity, level, task, root)
        packer.keys, packer.parts, packer.sizes = table.column("_key").to_pylist(), table.column("part").to_pylist(), table.column("size").to_pylist()
        return pa.Table.from_batches([packer.flush(kind, True)]).append_column("_task", pa.array([task] * table.num_rows, pa.int32()))

    return merge


def windows(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = WINDOW, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """Rows ``(key, part, window_id, start_token, end_token, n_tokens)``: each text's share of a window, one row unless it is longer than a window."""
    source = documents.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = source.schema["_key"].dataType
    schema = StructType([StructField("_key", kind), StructField("part", IntegerType()), StructField("size", IntegerType()), StructField("window_id", LongType())])

    def local(batches):
        encode = encoder(ranks).encode
        packer, arrow = _Packer(capacity, 0, TaskContext.get().partitionId(), False), None
        for batch in batches:
            arrow = batch.schema.field(0).type
            whole = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                full, rest = divmod(len(encode(t)) if t else 0, capacity)
                whole += [(k, p) for p in range(full)]
                if rest or not full:
                    packer.add(k, full, rest)
            if whole:
                yield _batch(pa.array([k for k, _ in whole], arrow), [p for _, p in whole], [capacity] * len(whole), [packer.window() for _ in whole])
            if len(packer.keys) >= CHUNK:
                yield packer.flush(arrow, False)
        if arrow is not None:
            yield packer.flush(arrow, True)

    levels = [cut_lineage(spread(source).mapInArrow(local, schema).withColumn("_task", F.spark_partition_id()))]
    tasks, level = max(1, levels[0].rdd.getNumPartitions()), 0
    while True:
        tasks, level = -(-tasks // FAN_IN), level + 1

        up = levels[-1].where("window_id is null").withColumn("_task", (F.col("_task") / FAN_IN).cast("int"))
        levels.append(cut_lineage(up.groupBy("_task").applyInArrow(_merger(capacity, level, tasks == 1), StructType([*schema.fields, StructField("_task", IntegerType())]))))
        if tasks == 1:
            break
    placed = levels[0]
    for more in levels[1:]:
        placed = placed.unionByName(more)
    start = F.col("part").cast("bigint") * capacity
    return placed.where("window_id is not null").select(F.col("_key").alias(key), "part", "window_id", start.alias("start_token"), (start + F.col("size")).alias("end_token"), F.col("size").alias("n_tokens"))
