"""Best-fit packing of documents into token sequences (operator 2).

A sequence is a bin with three capacities: tokens, documents and attention
cost (the sum of squared piece lengths, what block-diagonal attention
computes).  Pieces come longest first.  Among the bins that can take a piece
under every capacity, the vector rule picks one: the smallest weighted norm
of what would remain (``norm``), or the largest weighted product of demand
and remainder (``dot``).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import bound_batches, written
from chronoweave.llm.encoder import encoder

GROUP_PIECES = 4096


def cut_points(n: int, size: int) -> list[int]:
    """Start of each piece of ``n`` ids: whole pieces of ``size``, the first may be shorter."""
    first = n % size or min(size, n)
    return [0, *range(first, n, size)]


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32 for each piece of each row (null text: empty, so the end id alone)."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def cut(batches):
        e, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for b in batches:
            of, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(e.encode(b.column("_text").to_pylist())):
                ids += end
                n = len(ids) // 4
                for k, s in enumerate(cut_points(n, size)):
                    stop = min(n, s + size) if k else (n % size or min(size, n))
                    of.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(stop - s)
                    crc.append(zlib.crc32(ids[4 * s:4 * stop]))
            yield pa.RecordBatch.from_arrays(
                [b.column("_id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, f"_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, tokens: int, documents: int, attention: int, rule: str = "norm",
             weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; pieces are taken longest first, ties in given order."""
    n = len(lengths)
    caps = np.array([tokens, documents, attention], float)
    w = np.asarray(weights, float) / caps**2
    place, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    rest = np.zeros((3, max(n, 1)))  # what remains of each capacity in the open bins
    name = np.zeros(max(n, 1), np.int64)
    open_, made, since = 0, 0, 0
    for i in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[i], 1, float(lengths[i]) ** 2])
        if (need > caps).any():
            raise ValueError("a piece exceeds a capacity of an empty sequence")
        best = -1
        if open_:
            r = rest[:, :open_]
            fits = np.flatnonzero((r[0] >= need[0]) & (r[1] >= 1) & (r[2] >= need[2]))
            if len(fits):
                f = r[:, fits]
                if rule == "norm":
                    score = w @ (f - need[:, None]) ** 2
                else:
                    score = -((w * need) @ f)
                best = fits[np.argmin(score)]
        if best < 0:
            best = open_
            rest[:, best], name[best] = caps, made
            open_, made = open_ + 1, made + 1
        place[i], offset[i] = name[best], tokens - rest[0, best]
        rest[:, best] -= need
        since += (rest[:2, best] == 0).any()
        if since > 64:  # full bins go, order stays
            keep = np.flatnonzero((rest[:2, :open_] > 0).all(axis=0))
            rest[:, :len(keep)], name[:len(keep)] = rest[:, keep], name[keep]
            open_, since = len(keep), 0
    return place, offset


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, max_documents: int | None = None,
         max_attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
         end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    The document capacity defaults to ``size`` and the attention capacity to
    ``size**2``, the most that ``size`` tokens can ask for.  All three
    residuals weigh in the choice of a sequence, each as a share of its
    capacity; ``weights`` sets by how much.  Pieces are cut
    and written once.  A piece of ``size`` tokens is a sequence of its own
    (with a negative sequence_id); shorter ones are dealt by hash into groups
    of about ``GROUP_PIECES`` that fill their sequences apart from each
    other, so a group leaves about one sequence part-full and no task holds
    more than a group.  Every row is packed, repeated rows and null ids too; an empty or
    null text is its end id.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    documents, attention = max_documents or size, max_attention or size * size
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = written(token_pieces(docs, tokenizer, size, end_id, id_col, text_col), "pieces")
    # under a smaller attention capacity a full piece fits nowhere, which best_fit reports
    whole = (F.col("length") == size) if attention >= size * size else F.lit(False)
    short = pieces.where(~whole)
    n = short.count()
    groups = max(1, math.ceil(n / GROUP_PIECES))
    dealt = short.withColumn("_group", F.pmod(F.xxhash64("_id", "piece", "ids_crc32", F.monotonically_increasing_id()),
                                               F.lit(groups)).cast("long"))
    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        # rows in one order whatever the shuffle, so that a rerun gives the same sequences
        pdf = pdf.sort_values(["length", "ids_crc32", "_id", "piece"], ascending=False, kind="stable")
        place, offset = best_fit(pdf["length"].to_numpy(np.int64), size, documents, attention, rule, weights)
        base = int(pdf["_group"].iloc[0]) << 32
        return pdf.drop(columns="_group").assign(sequence_id=base + place, offset=offset)

    alone = pieces.where(whole).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return (dealt.groupBy("_group").applyInPandas(fill, schema).unionByName(alone)
            .select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
