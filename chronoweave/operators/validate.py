"""Row validation rules (V1 required, V2 enum, V3 type, V4 conditional).

``validate_rows(df, rules, key)`` checks all rules in ONE pass: every row
builds the array of its violations, which is then exploded.  Output:
(row_key, rule, column, message).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The dataset kinds a manifest may declare, and the default.
DATASET_TYPES = ("TabularDataSet", "EventEncodedDataSet")
DEFAULT_DATASET_TYPE = "TabularDataSet"


@dataclass(frozen=True)
class Rule:
    kind: str                      # required | enum | type | conditional
    column: str
    values: tuple = ()             # enum values
    type_name: str = ""            # str | bool | int | float | seq | map
    when_column: str = ""          # conditional: when when_column == when_value ...
    when_value: object = None
    predicate: Column | None = None  # conditional: ... this must hold (else violation)


def required(column: str) -> Rule:
    return Rule("required", column)


def enum(column: str, values) -> Rule:
    return Rule("enum", column, values=tuple(values))


def typed(column: str, type_name: str) -> Rule:
    return Rule("type", column, type_name=type_name)


def conditional(column: str, when_column: str, when_value, predicate: Column | None = None) -> Rule:
    return Rule("conditional", column, when_column=when_column, when_value=when_value, predicate=predicate)


def _empty(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return c.isNull() | (F.trim(c) == "")
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def _type_ok(c: Column, dtype: T.DataType, name: str) -> Column:
    s = c.cast("string") if not isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)) else None
    if name == "str":
        return F.lit(isinstance(dtype, T.StringType))
    if name == "bool":
        if isinstance(dtype, T.BooleanType):
            return F.lit(True)
        return F.lower(s).isin("true", "false") if s is not None else F.lit(False)
    if name == "int":
        return s.try_cast("bigint").isNotNull() if s is not None else F.lit(False)
    if name == "float":
        return s.try_cast("double").isNotNull() if s is not None else F.lit(False)
    if name == "seq":
        return F.lit(isinstance(dtype, T.ArrayType))
    if name == "map":
        return F.lit(isinstance(dtype, (T.MapType, T.StructType)))
    raise ValueError(f"unknown type {name!r}")


def _check(df: DataFrame, r: Rule) -> tuple[Column, str]:
    """(violation condition, message) for one rule."""
    col = F.col(f"`{r.column}`")
    dtype = df.schema[r.column].dataType
    if r.kind == "required":
        return _empty(col, dtype), f"{r.column} is required"
    if r.kind == "enum":
        return col.isNotNull() & ~col.isin(*r.values), f"{r.column} must be one of {', '.join(map(str, r.values))}"
    if r.kind == "type":
        return col.isNotNull() & ~_type_ok(col, dtype, r.type_name), f"{r.column} must be of type {r.type_name}"
    if r.kind == "conditional":
        trig = F.col(f"`{r.when_column}`") == F.lit(r.when_value)
        ok = r.predicate if r.predicate is not None else ~_empty(col, dtype)
        return trig & ~F.coalesce(ok, F.lit(False)), \
            f"{r.column} is required when {r.when_column} is {r.when_value}"
    raise ValueError(f"unknown rule kind {r.kind!r}")


def validate_rows(df: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """All violations of all rules, one pass: (row_key, rule, column, message)."""
    items = []
    for r in rules:
        cond, msg = _check(df, r)
        items.append(F.when(cond, F.struct(F.lit(r.kind).alias("rule"), F.lit(r.column).alias("column"),
                                           F.lit(msg).alias("message"))))
    arr = F.filter(F.array(*items), lambda x: x.isNotNull())
    return (df.select(F.col(f"`{key}`").cast("string").alias("row_key"), F.explode(arr).alias("v"))
            .select("row_key", "v.rule", "v.column", "v.message"))


# The manifest schema, as (section, field, type, required).  A "step"
# row speaks of every entry of pipelineCleanData.available_functions.
MANIFEST_FIELDS = (
    ("metadata", "version", "str", True), ("metadata", "dataset", "str", True), ("metadata", "description", "str", True),
    ("metadata", "date_created", "str", True), ("metadata", "type", "str", True), ("metadata", "components", "str", False),
    ("metadata", "dictionary", "str", False), ("pipelineCleanData", "run_enabled", "bool", True),
    ("pipelineCleanData", "available_functions", "seq", False),
    ("step", "enabled", "bool", True), ("step", "module", "str", True), ("step", "func", "str", True),
    ("step", "description", "str", True),
)


def validate_manifest_values(values: DataFrame) -> DataFrame:
    """V1/V3 on manifests as they were written: (dataset, section, step, rule, field, message).

    Input: one row per value (dataset, section, step, field, type, text), with
    the value's own type, and one row with a NULL field per section or step
    that is there at all.  A required field is missed where its section or
    step is there but the field is not, or is empty; ``metadata`` must be there.
    Both sides grow with the manifests and are merged by key: size estimates
    know nothing of rows exploded before, so neither may be picked for a broadcast.
    """
    spark = values.sparkSession
    schema = spark.createDataFrame([(s, f, t, r) for s, f, t, r in MANIFEST_FIELDS],
                                   "section string, field string, want string, required boolean")  # a fixed few rows
    there = values.select("dataset", "section", "step").unionByName(
        values.select("dataset", F.lit("metadata").alias("section"), F.lit(None).cast("string").alias("step"))).distinct()
    asked = there.join(F.broadcast(schema), "section")
    found = values.where(F.col("field").isNotNull()).select("dataset", "section", F.coalesce("step", F.lit("")).alias("s"),
                                                            "field", "type", "text")
    j = asked.withColumn("s", F.coalesce("step", F.lit(""))).join(found.hint("merge"), ["dataset", "section", "s", "field"], "left")
    missing = F.col("required") & (F.col("type").isNull() | (F.col("type") == "null")
                                   | ((F.col("type") == "str") & (F.trim("text") == "")))
    wrong = F.col("type").isNotNull() & (F.col("type") != "null") & (F.col("type") != F.col("want"))
    verdict = F.when(missing, F.lit("required")).when(wrong, F.lit("type"))
    message = F.when(missing, F.concat("field", F.lit(" is required"))).otherwise(
        F.concat("field", F.lit(" must be of type "), "want"))
    return (j.where(missing | wrong).select("dataset", "section", "step", verdict.alias("rule"), "field", message.alias("message")))


def manifest_rules() -> list[Rule]:
    """The manifest schema as rules over a flattened manifest table (V1-V4)."""
    return [
        required("version"), required("dataset"), required("description"),
        required("date_created"), required("type"),
        enum("type", DATASET_TYPES),
        typed("dataset", "str"), typed("description", "str"),
        conditional("dictionary", "type", "EventEncodedDataSet"),
    ]
