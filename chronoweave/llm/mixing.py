"""Poisson replication of documents to target source weights (operator 10).

A document of source s is repeated Poisson(r) times, where r is the target
share of s in the mixture times the target size over the rows of s.  The
count inverts the Poisson distribution at a number that is a hash of seed,
id and text, so any rerun, on any machine, draws the same mixture.  Rows that
share id and text are told apart by their other columns and a number among
equal rows, so that each has a draw of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import written

BROADCAST_SOURCES = 100_000
BROADCAST_REPEATS = 1_000_000  # hashes of repeated (id, text) sent to every executor
REPEAT_CHUNK = 10_000          # equal rows that one task restores at once
MAX_RATE = 100_000.0


def poisson_steps(rate: float) -> tuple[int, list[float]]:
    """(k0, cumulative probabilities of k0, k0+1, ...): a draw u gives k0 plus the number of entries <= u.

    Twelve deviations and twenty counts to either side of the mean are
    listed; what lies outside has less than one part in 2**52 of the mass.
    """
    if rate <= 0:
        return 0, [2.0]
    spread = 12 * math.sqrt(rate) + 20
    low, high = max(0, int(rate - spread)), int(rate + spread)
    log_rate, total, out = math.log(rate), 0.0, []
    for k in range(low, high + 1):
        total += math.exp(k * log_rate - rate - math.lgamma(k + 1))
        out.append(total)
        if k > rate and total >= 1 - 2.0**-53:
            break
    return low, out


def unit_draw(seed: int, id_: str | Column, text: str | Column, twin: Column | None = None) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5 of seed, id, text and ``twin`` (left out where null)."""
    id_, text = (F.col(c) if isinstance(c, str) else c for c in (id_, text))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("")),
                            F.md5(F.coalesce(text, F.lit("")).cast("binary")),
                            *([] if twin is None else [twin])).cast("binary"))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def told_apart(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_row, _twin): each row as a struct, and what sets it apart from other rows of its id and text, else null.

    Repeated pairs of id and text are found by a count with a map-side
    combine.  Only their rows are grouped: equal rows become one row and a
    count, which is expanded again in chunks, so a row that a third of the
    table repeats is spread over many tasks.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    pair = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))).alias("_pair")
    repeated = written(docs.groupBy(pair).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_pair"), "mix-repeats")
    rows, n = docs.select(whole, pair), repeated.count()
    if not n:
        return rows.select("_row", F.lit(None).cast("string").alias("_twin"))
    if n <= BROADCAST_REPEATS:
        repeated = F.broadcast(repeated)
    single = rows.join(repeated, "_pair", "left_anti").select("_row", F.lit(None).cast("string").alias("_twin"))
    equal = rows.join(repeated, "_pair", "left_semi").groupBy("_row").agg(F.count(F.lit(1)).alias("_n"))
    chunk = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"), F.lit(REPEAT_CHUNK).cast("long")))
    equal = equal.withColumn("_from", chunk).repartition("_from", F.xxhash64(F.col(f"_row.`{id_col}`"), F.col(f"_row.`{text_col}`")))
    nth = F.explode(F.sequence("_from", F.least(F.col("_n"), F.col("_from") + (REPEAT_CHUNK - 1))))
    others = [F.col(f"_row.`{c}`").cast("string") for c in docs.columns if c not in (id_col, text_col)]
    return single.unionByName(equal.select("_row", nth.alias("_nth"))
                              .select("_row", F.concat_ws(":", *others, F.col("_nth").cast("string")).alias("_twin")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, size: int | None = None,
        seed: int = 17, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
        copy_col: str | None = "copy") -> DataFrame:
    """``docs`` repeated to the target weights, in a globally shuffled order.

    ``weights`` names the target share of each source (scaled to sum 1,
    others 0); None takes shares in proportion to rows ** ``power``.
    ``size`` is the target number of rows, by default the rows of ``docs``.
    Columns are those of ``docs``; ``copy_col`` (1, 2, ...) follows unless None,
    and replaces a column of that name.  A null source is a source of its own
    (weight 0 where ``weights`` is given).  Rows that share id and text, equal
    rows among them, have a draw each (``told_apart``).  Rows over which a rate would exceed ``MAX_RATE`` raise an error.
    An empty table gives no rows.

    Rows per source are pre-aggregated before their shuffle and come back by
    a broadcast of at most ``BROADCAST_SOURCES`` rows, beyond that by an
    ordinary join.  The last shuffle deals rows by a hash of seed, id, text,
    what sets repeated rows apart, and copy, and sorts each partition by it, which spreads the copies of
    one document like any other rows.
    """
    def source_key(c: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")).alias("_source")

    counts = written(docs.groupBy(source_key(source_col)).agg(F.count(F.lit(1)).alias("_n")), "mix-sources")
    if weights is None:
        share = F.pow(F.col("_n").cast("double"), F.lit(power))
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("_source") == "=" + name, F.lit(float(w))).otherwise(share)
    counts = counts.withColumn("_share", share)
    all_ = counts.agg(F.sum("_n").alias("n"), F.sum("_share").alias("w"), F.count(F.lit(1)).alias("sources")).first()
    total, weight = (all_["n"] if size is None else size) or 0, all_["w"] or 1.0

    def steps(batches):
        for b in batches:
            rate = (float(total) * b["_share"] / weight / b["_n"]).to_numpy(np.float64)
            if (rate > MAX_RATE).any():
                raise ValueError(f"a source would repeat its documents over {MAX_RATE:g} times")
            made = [poisson_steps(r) for r in rate]
            yield pd.DataFrame({"_source": b["_source"], "_first": [m[0] for m in made], "_steps": [m[1] for m in made]})

    rates = written(counts.mapInPandas(steps, "_source string, _first int, _steps array<double>"), "mix-rates")
    if all_["sources"] <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    id_, text = F.col(f"_row.`{id_col}`"), F.col(f"_row.`{text_col}`")
    rows = told_apart(docs, id_col, text_col).select(
        "_row", source_key(f"_row.`{source_col}`"), unit_draw(seed, id_, text, F.col("_twin")).alias("_u"),
        F.xxhash64(F.lit(seed), id_, text, F.col("_twin")).alias("_key")).join(rates, "_source")
    times = F.col("_first") + F.size(F.filter("_steps", lambda c: c <= F.col("_u")))
    rows = rows.select("_row", "_key", times.alias("_times")).where(F.col("_times") > 0)
    rows = rows.select("_row", "_key", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy"))
    rows = rows.withColumn("_key", F.xxhash64("_key", "_copy")).repartition("_key").sortWithinPartitions("_key")
    names = [c for c in docs.columns if c != copy_col]
    out = [F.col(f"_row.`{c}`").alias(c) for c in names]
    return rows.select(*out, *([F.col("_copy").alias(copy_col)] if copy_col else []))
