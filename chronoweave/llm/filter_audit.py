"""How text filters act in every order (operator 13).

Each document is a mask of the filters it fails.  Counts per part and mask
are all that the orders need: every such cell folds, by higher-order
functions, over the array of filter orders into one struct per order and
step, and a part's cells are added up element by element.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import Tables

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: Column, min_words: int = 200, min_distinct_pct: int = 50, max_capital_pct: int = 3) -> Column:
    """Bits 0 to 3 for the filters A to D that a text fails."""
    def facts(words: Column) -> Column:
        n, distinct = F.size(words), F.size(F.array_distinct(words))
        return F.when(n < min_words, 1).otherwise(0) + F.when(100 * distinct < min_distinct_pct * n, 2).otherwise(0)

    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), "")
    by_words = F.get(F.transform(F.array(words), facts), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return (by_words + F.when(100 * capitals > max_capital_pct * F.length(text), 4).otherwise(0)
            + F.when(F.translate(text, "#$%&*|", "") != text, 8).otherwise(0))


def _orders() -> Column:
    """All orders of the filters, as arrays of their mask bits, in alphabetical order."""
    return F.array(*[F.array(*[F.lit(1 << f) for f in p]) for p in permutations(range(len(FILTERS)))])


def _folded(mask: Column, n: Column, good: Column, toxic: Column) -> Column:
    """What a cell of ``n`` rows adds to each order and step, 600 structs: the fold carries whether the cell is still there."""
    zero = F.lit(0).cast("long")

    def one_order(order: Column) -> Column:
        def step(state: Column, f: Column) -> Column:
            fails = mask.bitwiseAND(f) != 0
            here = state["there"] & fails
            row = F.struct(
                F.when(state["there"] & ~fails, n).otherwise(zero).alias("kept"),
                F.when(here, n).otherwise(zero).alias("removed"),
                F.when(~state["there"] & fails, n).otherwise(zero).alias("redundant"),
                F.when(mask == f, n).otherwise(zero).alias("unique_fails"),
                F.when(here, good).otherwise(zero).alias("good_lost"),
                F.when(here, toxic).otherwise(zero).alias("toxic_lost"))
            return F.struct((state["there"] & ~fails).alias("there"), F.concat(state["rows"], F.array(row)).alias("rows"))

        none = F.array().cast("array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>")
        return F.aggregate(order, F.struct(F.lit(True).alias("there"), none.alias("rows")), step, lambda s: s["rows"])

    return F.flatten(F.transform(_orders(), one_order))


def _added(cells: Column) -> Column:
    """Elementwise sums of several cells' arrays."""
    def add(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS]))

    return F.aggregate(F.slice(cells, 2, F.size(cells)), F.get(cells, F.lit(0)), add)


def masked_counts(tables: Tables, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str,
                  **limits) -> DataFrame:
    """(part, mask, n, good, toxic), at most 32 cells a part.

    Filter E fails a row whose text some smaller id has.  Rows are reduced to
    their text's SHA-256 and mask; a text's smallest id is found with partial
    aggregates and joined on digest and id, so copies of one text meet it in
    as many tasks as they have ids.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_mask(text, **limits).alias("mask"))
    rows = tables.written(rows.groupBy("i", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "masks")
    first = rows.where(F.col("i").isNotNull()).groupBy("digest").agg(F.min("i").alias("i")).withColumn("first", F.lit(True))
    flags = (labels.select(F.col("doc_id").alias("i"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("t"))
             .where(F.col("i").isNotNull()).groupBy("i")
             .agg(F.coalesce(F.max("g"), F.lit(False)).alias("g"), F.coalesce(F.max("t"), F.lit(False)).alias("t")))
    copy = F.col("i").isNotNull() & F.col("first").isNull()
    n = F.col("n")
    return (rows.join(first, ["digest", "i"], "left").join(flags, "i", "left")
            .withColumn("mask", F.col("mask") + F.when(copy, 16).otherwise(0))
            .groupBy("part", "mask").agg(F.sum(n).alias("n"), F.sum(F.when(F.col("g"), n).otherwise(0)).alias("good"),
                                         F.sum(F.when(F.col("t"), n).otherwise(0)).alias("toxic")))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
          **limits) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    The filters fail A: under 200 words; B: 100 * distinct words under 50 *
    words; C: 100 * capitals A-Z over 3 * characters; D: any of ``#$%&*|``;
    E: the text of a smaller id.  An order applies them left to right.
    kept: rows after the step; removed: rows that go at it; redundant: rows
    that fail its filter and went before; unique_fails: rows that fail it
    alone; good_lost and toxic_lost: removed rows labelled quality = 1 and
    toxic = 1; shapley: the filter's removed rows added up over all orders.

    Null texts are empty (and copies of each other), a null part is the empty
    string.  Rows without an id never have a smaller one and are no smaller
    one; repeated rows share their verdict and count each.  An id labelled
    more than once is good (toxic) if any of its labels says so.  An empty
    table has no part and no rows.
    """
    names = ["".join(p) for p in permutations(FILTERS)]
    with Tables(docs.sparkSession) as tables:
        cells = masked_counts(tables, docs, labels, id_col, text_col, part_col, **limits)
        cells = tables.written(cells, "mask-cells")
        parts = (cells.select("part", _folded(F.col("mask"), F.col("n"), F.col("good"), F.col("toxic")).alias("rows"))
                 .groupBy("part").agg(_added(F.collect_list("rows")).alias("rows")))
        at = F.posexplode("rows").alias("at", "row")
        long = parts.select("part", at).select(
            "part", F.get(F.array(*[F.lit(x) for x in names]), (F.col("at") / 5).cast("int")).alias("filter_order"),
            (F.col("at") % 5 + 1).cast("int").alias("step"), "row.*")
        long = long.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
        long = tables.written(long, "steps")
        share = long.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
        out = long.join(share, ["part", "letter"]).select("part", "filter_order", "step", *COUNTS, "shapley")
        return tables.written(out, "filter-audit", keep=True)
