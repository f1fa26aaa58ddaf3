"""Quality rules with host-level verdicts (operator 7), built-in functions only.

A document fails by its own text when it is short or repeats itself.  The
share of failing documents per host is shrunk towards the other hosts' share
with a beta prior fitted to the hosts themselves, and a host whose shrunk
share is too high takes its remaining documents with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import written

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BROADCAST_HOSTS = 100_000


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(windows: Column) -> Column:
    """Words in 3-word windows whose hash occurs twice or more; ``windows``: one hash per window, in order."""
    # most texts repeat nothing, which a sort of plain longs shows cheaply
    some = _let(F.sort_array(windows), lambda s: F.exists(
        F.transform(s, lambda x, i: F.get(s, i - 1).eqNullSafe(x)), lambda hit: hit))

    def places(s: Column) -> Column:
        twin = F.filter(s, lambda x, j: F.get(s, j - 1)["h"].eqNullSafe(x["h"]) | F.get(s, j + 1)["h"].eqNullSafe(x["h"]))
        return F.sort_array(F.transform(twin, lambda x: x["i"]))

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    width = _let(_let(pairs, places), lambda p: F.aggregate(
        F.transform(p, lambda v, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - v, F.lit(3)))),
        F.lit(0), lambda a, x: a + x))
    return F.when(some, width).otherwise(0)


def text_metrics(text: Column) -> dict[str, Column]:
    """The counted features of a text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, WHITE, "") != "")

    def windows(w: Column) -> Column:
        last = F.size(w) - 3
        return F.when(last >= 0, F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(
                F.array().cast("array<bigint>"))

    by_words = _let(words, lambda w: F.struct(F.size(w).alias("n"), _let(windows(w), _covered).alias("r")))
    by_lines = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return {"_words": by_words,
            "word_chars": F.length(F.translate(t, WHITE, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": by_lines.cast("long")}


def judge(docs: DataFrame, carry: list[str], host_col: str = "source", text_col: str = "text", min_words: int = 50,
          max_repeat_pct: int = 50, max_host_rate: float = 0.5, stored: bool = True) -> DataFrame:
    """The ``carry`` columns as one struct ``row``, then the metrics, base_failed, host_rate and kept.

    base_failed: fewer than ``min_words`` words, or over ``max_repeat_pct``
    percent of them in repeated 3-word windows.  Host verdict: with hosts'
    failing shares of mean m and sample variance v, the prior is a beta of
    mean m and strength s = m(1-m)/v - 1 (the mean host size if v is 0, null
    or too large for a beta), and a host fails when
    (failed + s*m) / (n + s) > ``max_host_rate``.  kept: neither the document
    nor its host fails.

    Null texts are empty and fail as short.  A null host has no verdict, so
    the document's own decides.  Repeated rows count as often as they occur.
    Names of other columns cannot clash, they sit inside ``row``.  The texts
    are measured once and the measured rows written, for host counts and
    result to read; with ``stored=False``, for rows that carry whole texts,
    nothing but the host counts is written and the result measures again.  Counts per host are pre-aggregated before
    their shuffle, so a host with a third of all rows is no hot key.
    """
    m = text_metrics(F.col(text_col))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(host_col).alias("host"),
                       *[c.alias(n) for n, c in m.items()])
    rows = rows.select("row", "host", F.col("_words.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
                       "n_dup_lines", F.col("_words.r").cast("long").alias("n_repeat_words"))
    short = F.col("n_words") < min_words
    repeats = 100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")
    rows = rows.withColumn("base_failed", short | repeats)
    if stored:
        rows = written(rows, "quality-rows")
    hosts = written(rows.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("base_failed")), "quality-hosts")
    prior = hosts.select(F.avg(F.col("base_failed") / F.col("n")).alias("m"),
                         F.var_samp(F.col("base_failed") / F.col("n")).alias("v"),
                         F.avg("n").alias("size"), F.count(F.lit(1)).alias("hosts")).first()
    mean, var = prior["m"] or 0.0, prior["v"] or 0.0
    room = mean * (1 - mean)
    strength = room / var - 1 if 0 < var < room else float(prior["size"] or 1.0)
    rates = hosts.select("host", ((F.col("base_failed") + F.lit(strength * mean)) / (F.col("n") + F.lit(strength)))
                         .alias("host_rate"))
    if prior["hosts"] <= BROADCAST_HOSTS:
        rates = F.broadcast(rates)
    fails = F.coalesce(F.col("host_rate") > max_host_rate, F.lit(False))
    return rows.join(rates, "host", "left").withColumn("kept", ~F.col("base_failed") & ~fails)


def quality(docs: DataFrame, id_col: str = "doc_id", **rules) -> DataFrame:
    """Metrics and verdict per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, host_rate, kept.  See ``judge``."""
    return judge(docs, [id_col], **rules).select(F.col(f"row.`{id_col}`").alias(id_col), *METRICS, "base_failed",
                                                 "host_rate", "kept")


def keep(docs: DataFrame, **rules) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns unchanged.  See ``judge``."""
    return judge(docs, docs.columns, stored=False, **rules).where("kept").select("row.*")
