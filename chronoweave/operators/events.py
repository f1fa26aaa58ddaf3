"""Event dictionary: key classification and grouping per component.

Dictionary rows: (ord, key, code) in file order.  Keys look like
``<component>_Qnn`` (raw level) or ``<component>_from_Qaa_to_Qbb``
(transition); everything else is ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed values (the reference's key patterns, Java-regex compatible).
RAW_PATTERN = r"^(?!.*from)(.*)_Q(\d+)$"
FROM_TO_PATTERN = r"^(.*)_from_Q(\d+)_to_Q(\d+)$"
MODES = ("old", "compact", "long")


def event_classify(d: DataFrame) -> DataFrame:
    """(ord, key, code) -> (ord, key, code, component, kind, column).

    A repeated (component, kind, column) keeps its first position and its
    last code (dict-update semantics).
    """
    k = F.col("key")
    is_raw = k.rlike(RAW_PATTERN)
    is_ft = ~is_raw & k.rlike(FROM_TO_PATTERN)
    comp = F.when(is_raw, F.regexp_extract(k, RAW_PATTERN, 1)).when(is_ft, F.regexp_extract(k, FROM_TO_PATTERN, 1))
    col = (F.when(is_raw, F.concat(F.lit("Q"), F.regexp_extract(k, RAW_PATTERN, 2)))
           .when(is_ft, F.concat(F.lit("Q"), F.regexp_extract(k, FROM_TO_PATTERN, 2), F.lit("_to_Q"),
                                 F.regexp_extract(k, FROM_TO_PATTERN, 3))))
    kind = F.when(is_raw, F.lit("raw")).when(is_ft, F.lit("from_to"))
    c = d.select("ord", "key", "code", comp.alias("component"), kind.alias("kind"), col.alias("column"))
    c = c.where(F.col("kind").isNotNull())
    return (c.groupBy("component", "kind", "column")
            .agg(F.min("ord").alias("ord"), F.max_by("key", "ord").alias("key"), F.max_by("code", "ord").alias("code"))
            .select("ord", "key", "code", "component", "kind", "column"))


def _per_kind(c: DataFrame, kind: str) -> F.Column:
    e = F.when(F.col("kind") == kind, F.struct("ord", "column", "code"))
    return F.array_sort(F.filter(F.collect_list(e), lambda x: x.isNotNull()))


def event_groups(d: DataFrame, mode: str = "compact") -> DataFrame:
    """One row per component (sorted by name when collected).

    * old:     (component, raw map<string,int>, from_to map<string,int>)
    * compact: (component, name, raw_columns, raw_encoded, from_to_columns, from_to_encoded)
    * long:    (component, name, raw array<struct<name,encoded>>, from_to array<...>)
    Each group holds one component's keys only.
    """
    if mode not in MODES:
        raise ValueError(f"invalid mode {mode!r}: use 'old', 'compact' or 'long'")
    c = event_classify(d)
    g = c.groupBy("component").agg(_per_kind(c, "raw").alias("__raw"), _per_kind(c, "from_to").alias("__ft"))
    if mode == "old":
        def as_map(a):
            return F.map_from_entries(F.transform(a, lambda x: F.struct(x["column"], x["code"])))
        return g.select("component", as_map(F.col("__raw")).alias("raw"), as_map(F.col("__ft")).alias("from_to"))
    if mode == "compact":
        return g.select("component", F.col("component").alias("name"),
                        F.transform("__raw", lambda x: x["column"]).alias("raw_columns"),
                        F.transform("__raw", lambda x: x["code"]).alias("raw_encoded"),
                        F.transform("__ft", lambda x: x["column"]).alias("from_to_columns"),
                        F.transform("__ft", lambda x: x["code"]).alias("from_to_encoded"))
    def as_list(a):
        return F.transform(a, lambda x: F.struct(x["column"].alias("name"), x["code"].alias("encoded")))
    return g.select("component", F.col("component").alias("name"), as_list(F.col("__raw")).alias("raw"),
                    as_list(F.col("__ft")).alias("from_to"))
