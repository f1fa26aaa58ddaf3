"""Resampling towards a target text collection by importance weights (operator 12).

Features are hashed runs of words (``word_automaton``).  A bucket's gain is
the log ratio of its smoothed shares in the target and in the documents, a
document's weight the sum of its features' gains, and adding Gumbel noise to
the weights makes the highest scores a draw without replacement.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.common import Tables, batch_rows
from chronoweave.llm.word_automaton import run_buckets
from chronoweave.llm.words import buffers


def _features(longest: int, buckets: int):
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        for b in batches:
            made, words = run_buckets(*buffers(b.column("_text")), longest, buckets)
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(words, pa.int64()), pa.array([len(m) for m in made], pa.int64()),
                 pa.array([m.astype(kind).tobytes() for m in made], pa.binary())], ["_id", "n_words", "n_features", "buckets"])
    return run


def _counts(buckets: int):
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column("buckets").to_pylist()), kind), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit])], ["bucket", "c"])
    return run


def _weights(gains: np.ndarray):
    kind = "<u2" if len(gains) <= 1 << 16 else "<u4"

    def run(batches):
        for b in batches:
            flat = np.frombuffer(b"".join(b.column("buckets").to_pylist()), kind)
            ends = np.cumsum(b.column("n_features").to_numpy())
            total = np.concatenate([[0], np.cumsum(gains[flat])])
            weight = total[ends] - total[np.concatenate([[0], ends[:-1]])] if len(b) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("n_words"), b.column("n_features"),
                                              pa.array(weight, pa.int64())], ["_id", "n_words", "n_features", "weight"])
    return run


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 * ln(smoothed target share / smoothed source share)) per bucket, in doubles."""
    s_all, t_all = sum(source.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log(float((target.get(b, 0) + 1) * (s_all + buckets))
                                                / float((source.get(b, 0) + 1) * (t_all + buckets))))
                     for b in range(buckets)], np.int64)


def noise(id_col: Column, seed: int) -> Column:
    """floor of 1000 times a Gumbel number that SHA-256 of ``seed:id`` fixes (a null id counts as empty text)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _top(tables: Tables, rows: DataFrame, keep: int) -> DataFrame:
    """``rows`` with rank 1..keep by falling score, then rising id; null beyond.

    Rows are dealt by score range, ranges are numbered by their counts, and
    only ranges that reach the first ``keep`` places are ranked, each by itself.
    """
    order = [F.col("score").desc(), F.col("_id").asc_nulls_last(), F.col("_row")]
    dealt = tables.written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "score-ranges")
    places, before = [], 0
    for r in sorted(dealt.groupBy("part").count().collect()):  # one row for each range
        if before < keep:
            places.append((r["part"], before))
        before += r["count"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(places, "part int, before long"))
    rank = (F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")).cast("long")
    ranked = dealt.join(starts, "part").withColumn("rank", rank)
    return (ranked.withColumn("rank", F.when(F.col("rank") <= keep, F.col("rank"))).drop("part", "before").unionByName(
        dealt.join(starts, "part", "left_anti").drop("part").withColumn("rank", F.lit(None).cast("long"))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", longest: int = 1, buckets: int = 10_000, min_words: int = 20, percent: int = 10,
             seed: int = 2024) -> DataFrame:
    """id, n_features, weight, score, rank per row of ``docs``.

    Words are runs of a-z, 0-9 and characters other than ASCII after A-Z were
    lower-cased; features are all runs of up to ``longest`` words.  weight sums
    the gains of a row's features; score adds the noise of its id.  Of the N
    rows with ``min_words`` words or more, floor(``percent`` * N / 100) get
    their rank by score, ties to the smaller id (null ids last, then rows as
    they come); all others have a null rank.

    Null, empty and wordless texts have no feature, weight 0, and are not
    drawn (for min_words over 0).  Repeated rows count and rank each by
    itself.  An empty target gives every bucket its smoothed share; an empty
    table of documents gives no rows.  What reaches the driver are ``buckets``
    counts and one row per score range.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    shape = f"_id {kind}, n_words long, n_features long, buckets binary"

    def hashed(df: DataFrame, i: Column, text: str, name: str) -> DataFrame:
        rows = df.select(i.alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
        return tables.written(rows.mapInArrow(_features(longest, buckets), shape), name)

    def counted(df: DataFrame) -> dict[int, int]:
        made = df.select("buckets").mapInArrow(_counts(buckets), "bucket long, c long")
        return {r["bucket"]: r["c"] for r in made.groupBy("bucket").agg(F.sum("c").alias("c")).collect()}

    with Tables(spark) as tables, batch_rows(spark, 512):
        mine = hashed(docs, F.col(f"`{id_col}`"), text_col, "features")
        theirs = hashed(target, F.lit(None).cast(kind), target_text_col, "target-features")
        worth = gains(counted(mine), counted(theirs), buckets)
        scored = tables.written(
            mine.mapInArrow(_weights(worth), f"_id {kind}, n_words long, n_features long, weight long")
            .withColumn("score", F.col("weight") + noise(F.col("_id"), seed))
            .withColumn("_row", F.monotonically_increasing_id()), "scored")
        able = F.col("n_words") >= min_words
        keep = percent * scored.where(able).count() // 100
        out = _top(tables, scored.where(able), keep).unionByName(
            scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
        return tables.written(out.select(F.col("_id").alias(id_col), "n_features", "weight", "score", "rank"), "resampled", keep=True)
