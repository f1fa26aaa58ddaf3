"""Packed token-id matrices (operator 8).

Documents are tokenised, overlong ones cut without loss, and the pieces
placed best-fit-decreasing into rows of ``size`` ids.  The tightest row that
still takes a piece is found in a segment tree over row capacities.  A shard
is one row of a Parquet table: the id matrix, the cumulative segment lengths
of its rows, and the positions at which position ids restart.

A task packs the texts it reads, ``SHARD_TOKENS`` at a time, so no text is
shuffled; Spark's commit protocol keeps one copy of a shard when a task runs
twice or its executor is lost.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import batch_rows, bound_batches, shared_path, written
from chronoweave.llm.encoder import encoder

SHARD_TOKENS = 2_000_000


class CapacityTree:
    """Rows by remaining capacity 0..size; finds the smallest capacity that takes a length."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.some = bytearray(2 * self.leaves)  # a node says whether any row lies below it
        self.rows: dict[int, list[int]] = {}

    def put(self, row: int, capacity: int) -> None:
        stack = self.rows.setdefault(capacity, [])
        stack.append(row)
        i = self.leaves + capacity
        while i and not self.some[i]:
            self.some[i] = 1
            i >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(row, capacity) of a tightest row that takes ``length``, removed from the tree; None if there is none."""
        i = self.leaves + length
        if not self.some[i]:
            while i > 1 and (i & 1 or not self.some[i + 1]):  # up, to the next subtree on the right with a row
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.some[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        stack = self.rows[capacity]
        row = stack.pop()
        while i and not stack:
            self.some[i] = 0
            i >>= 1
            if self.some[2 * i] or self.some[2 * i + 1]:
                break
        return row, capacity


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int], int]:
    """(row of each piece, offset of each piece, rows); longest first, ties in given order."""
    tree, row_of, offset, rows = CapacityTree(size), [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        row, capacity = found if found else (rows, size)
        rows += found is None
        row_of[i], offset[i] = row, size - capacity
        if capacity > lengths[i]:
            tree.put(row, capacity - lengths[i])
    return row_of, offset, rows


def build_shard(docs: list[tuple[object, np.ndarray]], size: int, pad: int) -> dict:
    """Pack the ids of (id, ids) documents into one shard."""
    owner, piece, start, length = [], [], [], []
    for i, (_, ids) in enumerate(docs):
        for k, s in enumerate(range(0, len(ids), size)):
            owner.append(i)
            piece.append(k)
            start.append(s)
            length.append(min(size, len(ids) - s))
    row, offset, rows = best_fit_decreasing(length, size)
    matrix = np.full((rows, size), pad, "<u4")
    order = sorted(range(len(owner)), key=lambda i: (row[i], offset[i]))
    ends = [[0] for _ in range(rows)]
    for i in order:
        matrix[row[i], offset[i]:offset[i] + length[i]] = docs[owner[i]][1][start[i]:start[i] + length[i]]
        ends[row[i]].append(offset[i] + length[i])
    resets = []
    for r, e in enumerate(ends):  # positions restart at each segment, and where padding begins
        resets += [r * size + x for x in e if x < size]
    return {"doc": [docs[owner[i]][0] for i in order], "piece": [piece[i] for i in order],
            "start": [start[i] for i in order], "n_rows": rows, "matrix": matrix,
            "cu_seqlens": np.array([x for e in ends for x in e], "<i4"),
            "row_ends": np.cumsum([0, *map(len, ends)]).astype("<i4"), "resets": np.array(resets, "<i8")}


def position_ids(resets: np.ndarray, rows: int, size: int) -> np.ndarray:
    """The position id matrix that the resets describe."""
    flat = np.arange(rows * size)
    if not len(flat):
        return flat.reshape(rows, size)
    begin = np.zeros(len(flat), np.int64)
    begin[resets] = resets
    return (flat - np.maximum.accumulate(begin)).reshape(rows, size)


def write_matrices(docs: DataFrame, tokenizer: str, path: str | None = None, size: int = 1024, end_id: int = 50256,
                   pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write packed shards of all rows and return their folder.

    Columns: shard, n_rows, size, bits (16 or 32, by the vocabulary), ids (the
    matrix, little-endian, row by row), cu_seqlens and row_ends (int32: row r
    owns cu_seqlens[row_ends[r]:row_ends[r + 1]], from 0 to its used length),
    resets (int64 places in the flattened matrix), and the segments' document
    ids, piece numbers and starts in matrix order.  A null text is empty; an
    empty text is its end id.  Repeated rows and null ids are packed like any
    other.  An empty table writes no shard.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    path = path or shared_path(spark, "token-matrices")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    arrow = pa.int64() if kind == "bigint" else None

    def pack(batches):
        e, held, n = encoder(tokenizer), [], 0
        task, made = TaskContext.get().partitionId(), itertools.count()
        bits = 16 if max(e.whole.get_vocab_size(), end_id + 1, pad_id + 1) <= 1 << 16 else 32

        def shard():
            s = build_shard(held, size, pad_id)
            cell = s["matrix"].astype("<u2" if bits == 16 else "<u4").tobytes()
            name = f"{task:06d}-{next(made):05d}-{zlib.crc32(cell):08x}"  # equal shards keep names of their own
            cols = [[name], [s["n_rows"]], [size], [bits], [cell], [s["cu_seqlens"].tobytes()], [s["row_ends"].tobytes()],
                    [s["resets"].tobytes()]]
            lists = [pa.array([s["doc"]], pa.list_(arrow) if arrow else None), pa.array([s["piece"]], pa.list_(pa.int32())),
                     pa.array([s["start"]], pa.list_(pa.int64()))]
            kinds = [pa.string(), *[pa.int32()] * 3, *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds)), *lists],
                                              ["shard", "n_rows", "size", "bits", "ids", "cu_seqlens", "row_ends",
                                               "resets", "docs", "pieces", "starts"])

        for b in batches:
            for doc, ids in zip(b.column("_id").to_pylist(), e.encode(b.column("_text").to_pylist())):
                ids = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
                held.append((doc, ids))
                n += len(ids)
                if n >= SHARD_TOKENS:
                    yield shard()
                    held, n = [], 0
        if held:
            yield shard()

    rows.mapInArrow(pack, "shard string, n_rows int, size int, bits int, ids binary, cu_seqlens binary, row_ends binary, "
                          f"resets binary, docs array<{kind}>, pieces array<int>, starts array<bigint>").write.option(
                              "compression", "zstd").parquet(path)
    return path


def segments(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per segment as read back from written shards: id, piece, start, length, shard, row, offset, ids_crc32."""
    shards = spark.read.parquet(path)
    kind = shards.schema["docs"].dataType.elementType.simpleString()

    def read(batches):
        for b in batches:
            for i in range(len(b)):
                v = {c: b.column(c)[i] for c in b.schema.names}
                n, size = v["n_rows"].as_py(), v["size"].as_py()
                m = np.frombuffer(v["ids"].as_py(), f"<u{v['bits'].as_py() // 8}").reshape(n, size).astype("<u4")
                cu, ends = np.frombuffer(v["cu_seqlens"].as_py(), "<i4"), np.frombuffer(v["row_ends"].as_py(), "<i4")
                at, crc = [], []
                for r in range(n):
                    cut = cu[ends[r]:ends[r + 1]].tolist()
                    for s, e in zip(cut, cut[1:]):
                        at.append((r, s, e - s))
                        crc.append(zlib.crc32(m[r, s:e].tobytes()))
                r, s, length = (pa.array([x[j] for x in at], pa.int64()) for j in range(3))
                yield pa.RecordBatch.from_arrays(
                    [v["docs"].values, v["pieces"].values, v["starts"].values, length,
                     pa.array([v["shard"].as_py()] * len(at), pa.string()), r, s, pa.array(crc, pa.int64())],
                    ["_id", "piece", "start", "length", "shard", "row", "offset", "ids_crc32"])

    return (shards.mapInArrow(read, f"_id {kind}, piece int, start long, length long, shard string, row long, "
                                    "offset long, ids_crc32 long").withColumnRenamed("_id", id_col))


def packed(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """``write_matrices``, then ``segments`` of what was written."""
    spark = docs.sparkSession
    path = write_matrices(docs, tokenizer, path, **options)
    with batch_rows(spark, 1):  # a shard is megabytes: one per Arrow batch
        out = segments(spark, path, options.get("id_col", "doc_id"))
        return written(out, "token-segments")
