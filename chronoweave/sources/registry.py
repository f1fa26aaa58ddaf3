"""Dataset registry (S1): manifests -> (name, path, type, table_name, dictionary).

Manifest files are small YAML documents read on the driver; their rows go
into a DataFrame, and every rule (table name, default type) is a column
expression, so registries of any size are handled the same way.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoweave.operators.validate import DEFAULT_DATASET_TYPE

# Fixed value: the manifest file every dataset folder must hold.
MANIFEST_FILE = "control_dataset.yml"


def registry_from_manifests(manifests: DataFrame, base_path: str) -> DataFrame:
    """Registry rows from a manifest table with columns dataset, type, dictionary."""
    name = F.col("dataset")
    return manifests.select(
        name.alias("name"), F.concat(F.lit(base_path.rstrip("/") + "/"), name).alias("path"),
        F.coalesce(F.col("type"), F.lit(DEFAULT_DATASET_TYPE)).alias("type"),
        F.lower(F.replace(name, F.lit("-"), F.lit("_"))).alias("table_name"),
        F.col("dictionary"))


def read_manifests(spark: SparkSession, base_dir: str) -> DataFrame:
    """Sorted child folders holding a manifest; hidden and plain files skipped.

    Returns (dataset, version, description, date_created, type, dictionary,
    components, run_enabled, steps).  A manifest without ``components``
    has an empty catalogue (the reference would open the folder itself).
    """
    from chronoweave.plans.steps import declared_steps

    rows = []
    for name, doc in _documents(spark, base_dir):
        md = doc.get("metadata", {}) or {}
        pipe = doc.get("pipelineCleanData") or {}
        steps = [(k, bool(options.get("enabled", False))) for k, options in declared_steps(pipe).items()]
        rows.append((name, str(md.get("version")) if md.get("version") is not None else None,
                     md.get("description"), str(md.get("date_created")) if md.get("date_created") else None,
                     md.get("type"), md.get("dictionary"), md.get("components"),
                     pipe.get("run_enabled") if isinstance(pipe.get("run_enabled"), bool) else None, steps))
    schema = ("dataset string, version string, description string, date_created string, type string, "
              "dictionary string, components string, run_enabled boolean, "
              "steps array<struct<name:string,enabled:boolean>>")
    return spark.createDataFrame(rows, schema)


def _documents(spark: SparkSession, base_dir: str) -> list[tuple[str, dict]]:
    """(folder name, parsed manifest) by name, from whichever file system ``base_dir`` names."""
    import yaml

    from chronoweave.sources.files import path_exists

    pattern = f"{base_dir.rstrip('/')}/*/{MANIFEST_FILE}"
    if not path_exists(spark, pattern):
        return []
    found = (spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").collect())
    named = sorted((unquote(r.path).split("/")[-2], r.value) for r in found)
    return [(name, yaml.safe_load(text) or {}) for name, text in named if not name.startswith(".")]


def _kind(value) -> str:
    """The schema's name of a YAML value's type."""
    kinds = ((bool, "bool"), (int, "int"), (float, "float"), (str, "str"), (list, "seq"), (dict, "map"))
    return "null" if value is None else next((name for t, name in kinds if isinstance(value, t)), type(value).__name__)


def read_manifest_values(spark: SparkSession, base_dir: str) -> DataFrame:
    """Every checked manifest value with its own type: (dataset, section, step, field, type, text).

    A section or step entry that is there adds one row without field.
    """
    from chronoweave.plans.steps import declared_steps

    rows = []
    for name, doc in _documents(spark, base_dir):
        pipe = doc.get("pipelineCleanData")
        parts = [(s, None, doc[s]) for s in ("metadata", "pipelineCleanData") if isinstance(doc.get(s), dict)]
        parts += [("step", step, options) for step, options in declared_steps(pipe).items()] if isinstance(pipe, dict) else []
        for section, step, fields in parts:
            rows.append((name, section, step, None, None, None))
            rows += [(name, section, step, k, _kind(v), None if v is None else str(v)) for k, v in dict(fields).items()]
    return spark.createDataFrame(rows, "dataset string, section string, step string, field string, type string, text string")


def scan_datasets(spark: SparkSession, base_dir: str) -> DataFrame:
    """Registry of every dataset folder under ``base_dir``."""
    m = read_manifests(spark, base_dir)
    return registry_from_manifests(m, base_dir).join(
        m.select(F.col("dataset").alias("name"), "components", "run_enabled", "steps"), "name", "left")
