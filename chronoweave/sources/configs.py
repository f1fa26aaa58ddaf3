"""Readers for the two YAML configuration shapes datasets carry.

* component catalogue: ``components: {id: {name, measurements: {key:
  {display_name, unit, type, description}}}}`` -> nested rows for
  ``catalogue_flat`` (C1);
* grouped event dictionary (compact): ``components: {id: {name,
  measurements: {raw: {columns, columns_encoded}, from_to: {...}}}}`` ->
  rows for ``event_options`` (C3).

The files are small configuration documents parsed on the driver; the
resulting DataFrames join the data on the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweave.operators.catalogue import catalogue_flat

COMPONENT_SCHEMA = ("component_id string, comp_ord int, name string, measurements map<string, "
                    "struct<display_name:string, unit:string, type:string, description:string>>")
GROUP_SCHEMA = ("component string, name string, raw_columns array<string>, raw_encoded array<bigint>, "
                "from_to_columns array<string>, from_to_encoded array<bigint>")


def _load(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as fh:
        return yaml.safe_load(fh) or {}


def _text(v):
    return None if v is None else str(v)


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """Component catalogue YAML -> one row per component (manifest order kept)."""
    comps = (_load(path).get("components") or {})
    rows = []
    for i, (cid, comp) in enumerate(comps.items()):
        comp = comp or {}
        meas = {}
        for key, meta in (comp.get("measurements") or {}).items():
            meta = meta or {}
            meas[str(key)] = (_text(meta.get("display_name")), _text(meta.get("unit")),
                              _text(meta.get("type")), _text(meta.get("description")))
        rows.append((str(cid), i, _text(comp.get("name")), meas))
    return spark.createDataFrame(rows, COMPONENT_SCHEMA)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Component catalogue YAML -> flat catalogue table."""
    return catalogue_flat(read_components(spark, path))


def read_event_groups(spark: SparkSession, path: str) -> DataFrame:
    """Grouped event dictionary YAML (compact shape) -> one row per component."""
    comps = (_load(path).get("components") or {})
    rows = []
    for cid, comp in comps.items():
        m = (comp or {}).get("measurements") or {}
        raw, ft = m.get("raw") or {}, m.get("from_to") or {}
        rows.append((str(cid), _text((comp or {}).get("name")),
                     [str(c) for c in raw.get("columns") or []], [int(c) for c in raw.get("columns_encoded") or []],
                     [str(c) for c in ft.get("columns") or []], [int(c) for c in ft.get("columns_encoded") or []]))
    return spark.createDataFrame(rows, GROUP_SCHEMA)
