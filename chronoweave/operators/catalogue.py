"""Measurement catalogue joined to readings: options, lookups, labels, filters.

Catalogue table (flat): ordinal, component_id, component_name,
measurement, display_name, unit, type, description.  ``ordinal`` keeps the
manifest order (components, then measurements), which decides "first"; any
type with an order will do, and options carry it on.
Column lists are DataFrames with one string column ``column`` (+ ``ordinal``).
C1 catalogue_flat, C2 measure_options, C3 event_options, C4 fallback,
C5 measure_info, C6 measure_labels, C7-C9 filters, C10 default_measure,
A11 type_list / component_list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from chronoweave.operators.series import selector_decode

# Fixed values (reference UI rules): the "all" entry of the type and
# component lists has value "ALL" and label "Todos"; the measurement types
# "tiempo", "time", "timestamp" are not offered as types; a column named
# "timestamp" (any case) is never a measure.
ALL_VALUE, ALL_LABEL = "ALL", "Todos"
TIME_TYPES = ("tiempo", "time", "timestamp")
TIME_COLUMN = "timestamp"

CATALOGUE_COLUMNS = ("ordinal", "component_id", "component_name", "measurement",
                     "display_name", "unit", "type", "description")


def catalogue_flat(components: DataFrame) -> DataFrame:
    """Nested catalogue rows -> flat rows.

    Input: one row per component (component_id, comp_ord, name,
    measurements map<string, struct<display_name, unit, type, description>>).
    The ordinal holds the component's place in its upper 32 bits and the
    measurement's in its lower ones; a map has fewer than 2**31 entries.
    """
    e = components.select("component_id", "comp_ord", F.col("name").alias("component_name"),
                          F.posexplode(F.map_entries("measurements")).alias("m_ord", "m"))
    return e.select(
        (F.shiftleft(F.col("comp_ord").cast("bigint"), 32) + F.col("m_ord")).alias("ordinal"),
        "component_id", "component_name", F.col("m.key").alias("measurement"),
        F.col("m.value.display_name").alias("display_name"), F.col("m.value.unit").alias("unit"),
        F.col("m.value.type").alias("type"), F.col("m.value.description").alias("description"))


def _cols(columns: DataFrame, alias: str) -> DataFrame:
    return columns.select(F.col("column").alias(alias)).distinct()


def measure_options(catalogue: DataFrame, columns: DataFrame) -> DataFrame:
    """Tabular options; value = display_name if it is a real column, else the key.

    label = "<display_name or key> (<component name or id>)".  Rows whose
    candidates are both absent give no option.  Returns (ordinal, label, value).
    """
    c = catalogue.join(_cols(columns, "__d"), F.col("display_name") == F.col("__d"), "left") \
                 .join(_cols(columns, "__k"), F.col("measurement") == F.col("__k"), "left")
    value = F.coalesce(F.col("__d"), F.col("__k"))
    label = F.concat(F.coalesce("display_name", "measurement"), F.lit(" ("),
                     F.coalesce("component_name", "component_id"), F.lit(")"))
    return c.where(value.isNotNull()).select("ordinal", label.alias("label"), value.alias("value"))


def event_options(groups: DataFrame, columns: DataFrame) -> DataFrame:
    """Options from the grouped event dictionary (compact shape).

    For every raw / from_to column that exists: label "c (name · mode)",
    value "component::mode::c".  Returns (ordinal, label, value); the ordinal
    is a struct of component, place of the mode and place of the column, so
    components are never numbered across the table.
    """
    parts = []
    for place, mode in enumerate(("raw", "from_to")):
        parts.append(groups.select("component", "name", F.lit(place).alias("__m"), F.lit(mode).alias("mode"),
                                   F.posexplode(f"{mode}_columns").alias("__p", "c")))
    ex = parts[0].unionByName(parts[1]).join(_cols(columns, "c"), "c", "left_semi")
    ordinal = F.struct("component", F.col("__m").alias("mode"), F.col("__p").alias("place"))
    return ex.select(ordinal.alias("ordinal"),
                     F.concat("c", F.lit(" ("), F.coalesce("name", "component"), F.lit(" · "), "mode",
                              F.lit(")")).alias("label"),
                     F.concat_ws("::", "component", "mode", "c").alias("value"))


def _as_ordinal(c: Column, kind: T.DataType) -> Column:
    """A place as an ordinal of the options' type: in a struct the last field holds it, the others are null."""
    if not isinstance(kind, T.StructType):
        return c.cast(kind)
    last = len(kind.fields) - 1
    return F.struct(*[(c if i == last else F.lit(None)).cast(f.dataType).alias(f.name) for i, f in enumerate(kind.fields)])


def measure_options_fallback(options: DataFrame, columns: DataFrame) -> DataFrame:
    """C4: when no option matched, every column except ``timestamp`` (any case).

    No driver action: the option count is a scalar subquery in the filter.
    """
    n = options.agg(F.count(F.lit(1)).alias("__n")).scalar()
    cols = columns.where(F.lower("column") != F.lit(TIME_COLUMN))
    fb = (cols.where(n == 0)
          .select(_as_ordinal(F.col("ordinal"), options.schema["ordinal"].dataType).alias("ordinal"),
                  F.col("column").alias("label"), F.col("column").alias("value")))
    return options.select("ordinal", "label", "value").unionByName(fb)


def _first_component_by(catalogue: DataFrame, code_col: str, codes: DataFrame, on: str) -> DataFrame:
    hits = codes.join(catalogue.select(F.col(on).alias("__v"), "ordinal", "component_id", "component_name"),
                      F.col(code_col) == F.col("__v"))
    return hits.select(code_col, "ordinal", "component_id", "component_name")


def measure_info(codes: DataFrame, catalogue: DataFrame, code_col: str = "code") -> DataFrame:
    """Selector code -> (component, measurement, mode).

    ``comp::mode::col``: component = the catalogue name of comp (else comp).
    Plain name: the first component (manifest order) having it as key or
    display_name; mode NULL.  Unknown plain names give NULLs.
    """
    s = codes.select(code_col, selector_decode(F.col(code_col)).alias("__s"))
    comps = catalogue.groupBy("component_id").agg(F.min_by("component_name", "ordinal").alias("__cname"))
    coded = (s.where(F.col("__s.mode").isNotNull())
             .join(comps, F.col("__s.component") == F.col("component_id"), "left")
             .select(code_col, F.coalesce("__cname", "__s.component").alias("component"),
                     F.col("__s.column").alias("measurement"), F.col("__s.mode").alias("mode")))
    plain = s.where(F.col("__s.mode").isNull()).select(code_col)
    hits = (_first_component_by(catalogue, code_col, plain, "measurement")
            .unionByName(_first_component_by(catalogue, code_col, plain, "display_name")))
    best = hits.groupBy(code_col).agg(F.min_by(F.coalesce("component_name", "component_id"),
                                               "ordinal").alias("component"))
    pl = (plain.join(best, code_col, "left")
          .select(code_col, "component",
                  F.when(F.col("component").isNotNull(), F.col(code_col)).alias("measurement"),
                  F.lit(None).cast("string").alias("mode")))
    return coded.unionByName(pl)


def measure_labels(codes: DataFrame, catalogue: DataFrame, code_col: str = "code") -> DataFrame:
    """C6: "display [unit]", "display" without unit, the code itself if unknown.

    The entry is the first component whose name or id equals the resolved
    component, then its measurement with that key.  Returns (code, label).
    """
    info = measure_info(codes, catalogue, code_col)
    comp_keys = (catalogue.select("component_id", F.col("component_name").alias("__m"), "ordinal")
                 .unionByName(catalogue.select("component_id", F.col("component_id").alias("__m"), "ordinal"))
                 .where(F.col("__m").isNotNull())
                 .groupBy("__m").agg(F.min_by("component_id", "ordinal").alias("__cid"),
                                     F.min("ordinal").alias("__o")))
    # first component in manifest order among all that match by name or id
    first = comp_keys.select("__m", "__cid")
    e = info.join(first, F.col("component") == F.col("__m"), "left")
    meta = catalogue.select(F.col("component_id").alias("__mc"), F.col("measurement").alias("__mk"),
                            F.col("display_name").alias("__dn"), F.col("unit").alias("__u"))
    e = e.join(meta, (F.col("__cid") == F.col("__mc")) & (F.col("measurement") == F.col("__mk")), "left")
    disp = F.coalesce("__dn", "measurement")
    label = (F.when(F.col("__mk").isNull(), F.col(code_col))
             .when(F.col("__u").isNotNull() & (F.col("__u") != ""), F.concat(disp, F.lit(" ["), "__u", F.lit("]")))
             .otherwise(disp))
    return e.select(code_col, label.alias("label"))


def filter_component(options: DataFrame, component: str | None) -> DataFrame:
    """Value starts with "comp::" or label contains "(comp)"; ALL/None keeps all."""
    if component in (None, ALL_VALUE):
        return options
    return options.where(F.col("value").startswith(f"{component}::")
                         | F.col("label").contains(f"({component})"))


def filter_type(options: DataFrame, type_value: str | None, catalogue: DataFrame) -> DataFrame:
    """Label contains the type (any case); only when nothing matched, the
    options whose value is a measurement key (or ends in "::key") of that type."""
    if type_value in (None, ALL_VALUE):
        return options
    by_label = options.where(F.lower("label").contains(type_value.lower()))
    n = by_label.agg(F.count(F.lit(1)).alias("__n")).scalar()
    keys = catalogue.where(F.col("type") == F.lit(type_value)).select(F.col("measurement").alias("__k"),
                                                                     F.col("ordinal").alias("__ko"))
    parts = F.split("value", "::", -1)
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)),
                        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))
    exact = options.join(keys, F.col("value") == F.col("__k"))
    suffix = (options.where(F.col("value").contains("::")).withColumn("__t", F.explode(tails))
              .join(keys, F.col("__t") == F.col("__k")).drop("__t"))
    by_meta = (exact.unionByName(suffix).where(n == 0)
               .select("ordinal", "label", "value"))
    return by_label.select("ordinal", "label", "value").unionByName(by_meta)


def filter_selected(options: DataFrame, selected: DataFrame) -> DataFrame:
    """Options whose value is selected; an empty selection keeps all."""
    n = selected.agg(F.count(F.lit(1)).alias("__n")).scalar()
    hit = options.join(selected.select(F.col("value").alias("__v")).distinct(),
                       F.col("value") == F.col("__v"), "left_semi")
    rest = options.where(n == 0)
    return hit.unionByName(rest)


def default_measure(options: DataFrame) -> DataFrame:
    """The first option (top-1 by ordinal)."""
    return options.orderBy("ordinal", "value").limit(1)


def _capitalize(c):
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def type_list(catalogue: DataFrame) -> DataFrame:
    """ALL first, then distinct types (time types excluded), sorted, capitalised.

    Returns (position, label, value).
    """
    t = (catalogue.select("type").where(F.col("type").isNotNull() & (F.col("type") != "")
                                        & ~F.col("type").isin(*TIME_TYPES)).distinct())
    ranked = t.select((F.row_number().over(Window.orderBy("type"))).cast("bigint").alias("position"),
                      _capitalize(F.col("type")).alias("label"), F.col("type").alias("value"))
    head = catalogue.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("position"),
                                                  F.lit(ALL_LABEL).alias("label"), F.lit(ALL_VALUE).alias("value"))
    return head.unionByName(ranked)


def component_list(catalogue: DataFrame) -> DataFrame:
    """ALL first, then components (not ``timestamp``) in manifest order."""
    c = (catalogue.where(F.lower("component_id") != F.lit(TIME_COLUMN))
         .groupBy("component_id").agg(F.min("ordinal").alias("__o"),
                                      F.min_by("component_name", "ordinal").alias("__n")))
    rows = c.select(F.col("__o").alias("position"), F.coalesce("__n", "component_id").alias("label"),
                    F.col("component_id").alias("value"))
    head = catalogue.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("position"),
                                                  F.lit(ALL_LABEL).alias("label"), F.lit(ALL_VALUE).alias("value"))
    return head.unionByName(rows)
