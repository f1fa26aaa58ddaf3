import json

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import catalogue as cat
from chronoweave.operators import events, validate
from chronoweave.sources import files

CAT_SCHEMA = ("ordinal long, component_id string, component_name string, measurement string, "
              "display_name string, unit string, type string, description string")


def catalogue(spark):
    return spark.createDataFrame([
        (1, "Bat", "Battery", "P", "Battery_P", "kW", "potencia", None),
        (2, "Bat", "Battery", "Q", None, None, "potencia", None),
        (3, "Bus", None, "V", "Volts", "V", "voltaje", None),
        (4, "Bus", None, "Z", "Zed", "", "voltaje", None),
        (5, "Time", None, "Timestamp", None, None, "tiempo", None)], CAT_SCHEMA)


def cols(spark, names):
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ordinal long, column string")


def test_measure_options(spark):
    opts = cat.measure_options(catalogue(spark), cols(spark, ["Timestamp", "Battery_P", "Q", "V"]))
    got = sorted((r.label, r.value) for r in opts.collect())
    assert ("Battery_P (Battery)", "Battery_P") in got      # display exists
    assert ("Q (Battery)", "Q") in got                      # only key exists
    assert ("Volts (Bus)", "V") in got                      # display missing, key exists
    assert not any(v == "Z" for _, v in got)                # neither


def test_fallback(spark):
    empty = spark.createDataFrame([], CAT_SCHEMA)
    c = cols(spark, ["TimeStamp", "a", "b"])
    got = [r.value for r in cat.measure_options_fallback(cat.measure_options(empty, c), c).collect()]
    assert sorted(got) == ["a", "b"]


def test_fallback_of_event_options(spark):
    groups = spark.createDataFrame([("B", "B", ["x"], ["y"]), ("A", None, ["x", "z"], [])],
                                   "component string, name string, raw_columns array<string>, from_to_columns array<string>")
    found = cat.measure_options_fallback(cat.event_options(groups, cols(spark, ["x", "y", "z"])), cols(spark, ["q"]))
    assert [r.value for r in found.orderBy("ordinal").collect()] == ["A::raw::x", "A::raw::z", "B::raw::x", "B::from_to::y"]
    assert cat.default_measure(found).first().value == "A::raw::x"
    none = cat.measure_options_fallback(cat.event_options(groups, cols(spark, ["q"])), cols(spark, ["p", "timestamp", "q"]))
    assert [r.value for r in none.orderBy("ordinal").collect()] == ["p", "q"]
    for plan in (found, cat.event_options(groups, cols(spark, ["x"]))):
        assert "Window" not in plan._jdf.queryExecution().toString()


def test_ordinals_of_a_very_large_component(spark):
    meta = "named_struct('display_name', 'd', 'unit', 'u', 'type', 't', 'description', '')"
    nested = spark.range(2).selectExpr(
        "concat('c', id) AS component_id", "cast(id AS int) AS comp_ord", "'n' AS name",
        f"map_from_entries(transform(sequence(0, 1000005 - cast(id * 1000000 AS int)), i -> struct(concat('m', i), {meta}))) AS measurements")
    flat = cat.catalogue_flat(nested)
    assert flat.count() == flat.select("ordinal").distinct().count() == 1000012
    assert flat.groupBy("component_id").agg(F.max("ordinal").alias("m"), F.min("ordinal").alias("n")).orderBy("n").collect()[1]["component_id"] == "c1"


def test_file_metrics(spark, tmp_path):
    (tmp_path / "a 1.csv").write_text("Timestamp,a\n2024-01-01 00:00:00,1.5\n2024-01-01 00:00:10,2\n")
    (tmp_path / "b+2.csv").write_text("Timestamp,b,c\n")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("Timestamp\n2024-01-01 00:00:00\n")
    got = {r.metric: r.value for r in files.file_metrics(spark, str(tmp_path / "*.csv"), max_files=2).collect()}
    assert got == {"files_found": 3, "files_selected": 2, "rows:a 1.csv": 2, "columns:a 1.csv": 2, "rows:b+2.csv": 0, "columns:b+2.csv": 3}


def test_labels(spark):
    codes = spark.createDataFrame([("P",), ("Q",), ("Z",), ("unknown",)], "code string")
    got = {r.code: r.label for r in cat.measure_labels(codes, catalogue(spark)).collect()}
    assert got == {"P": "Battery_P [kW]", "Q": "Q", "Z": "Zed", "unknown": "unknown"}


def test_filter_type(spark):
    opts = spark.createDataFrame([(1, "Battery_P (Battery)", "Battery_P"), (2, "V (Bus)", "V")],
                                 "ordinal long, label string, value string")
    assert [r.value for r in cat.filter_type(opts, "battery", catalogue(spark)).collect()] == ["Battery_P"]
    assert [r.value for r in cat.filter_type(opts, "voltaje", catalogue(spark)).collect()] == ["V"]


def test_type_list(spark):
    got = [(r.label, r.value) for r in cat.type_list(catalogue(spark)).orderBy("position").collect()]
    assert got == [("Todos", "ALL"), ("Potencia", "potencia"), ("Voltaje", "voltaje")]


def test_event_dictionary_roundtrip(spark, tmp_path):
    d = {"A_Q05": 1, "A_Q10": 2, "A_from_Q05_to_Q10": 3, "B_Q01": 4, "Bfrom_x_Q02": 5, "junk": 6,
         "C_from_Q01_to_Q02": 7}
    p = tmp_path / "dict.json"
    p.write_text(json.dumps(d))
    rows = files.read_event_dictionary(spark, str(p))
    assert [r.key for r in rows.orderBy("ord").collect()] == list(d)
    g = {r.component: r for r in events.event_groups(rows, "compact").collect()}
    assert sorted(g) == ["A", "B", "C"]
    assert list(g["A"].raw_columns) == ["Q05", "Q10"] and list(g["A"].raw_encoded) == [1, 2]
    assert list(g["A"].from_to_columns) == ["Q05_to_Q10"]
    assert list(g["C"].raw_columns) == [] and list(g["C"].from_to_encoded) == [7]
    with pytest.raises(ValueError):
        events.event_groups(rows, "bogus")


def test_validate_conditional(spark):
    df = spark.createDataFrame([("a", "EventEncodedDataSet", None), ("b", "EventEncodedDataSet", ""),
                                ("c", "EventEncodedDataSet", "d.json"), ("d", "TabularDataSet", None)],
                               "dataset string, type string, dictionary string")
    out = validate.validate_rows(df, [validate.conditional("dictionary", "type", "EventEncodedDataSet")], "dataset")
    assert sorted(r.row_key for r in out.collect()) == ["a", "b"]


def test_scan_union_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Timestamp,a,b\n2024-01-01 00:00:00,1.5,NA\n")
    (tmp_path / "b.csv").write_text("Timestamp,b,a,c\n2024-01-01 00:00:10,,NaN,7\n")
    paths = files.select_files(spark, str(tmp_path / "*.csv"))
    df = files.scan_union(spark, paths)
    rows = {r.Timestamp.second: r for r in df.collect()}
    assert rows[0].a == 1.5 and rows[0].b is None and rows[0].c is None
    assert rows[10].a is None and rows[10].b is None and rows[10].c == 7
    assert dict(df.dtypes)["a"] == "double"


def test_yaml_catalogue_and_groups(spark, tmp_path):
    from chronoweave.sources import configs
    (tmp_path / "components.yml").write_text(
        "components:\n"
        "  Pump:\n    name: Water pump\n    measurements:\n"
        "      Pump_Power: {unit: kW, type: potencia, display_name: P_Pump}\n"
        "      Pump_Speed: {unit: rpm, type: velocidad}\n"
        "  Timestamp:\n    measurements:\n      Timestamp: {type: tiempo}\n")
    c = configs.read_catalogue(spark, str(tmp_path / "components.yml"))
    rows = [(r.component_id, r.measurement, r.display_name, r.unit) for r in c.orderBy("ordinal").collect()]
    assert rows == [("Pump", "Pump_Power", "P_Pump", "kW"), ("Pump", "Pump_Speed", None, "rpm"),
                    ("Timestamp", "Timestamp", None, None)]
    opts = cat.measure_options(c, cols(spark, ["Timestamp", "P_Pump", "Pump_Speed"]))
    assert sorted(r.label for r in opts.collect()) == ["P_Pump (Water pump)", "Pump_Speed (Water pump)", "Timestamp (Timestamp)"]
    (tmp_path / "groups.yml").write_text(
        "components:\n  Pump_Power:\n    name: Pump_Power\n    measurements:\n"
        "      raw: {columns: [Q05, Q50], columns_encoded: [1, 2]}\n"
        "      from_to: {columns: [Q05_to_Q50], columns_encoded: [3]}\n")
    g = configs.read_event_groups(spark, str(tmp_path / "groups.yml"))
    eo = cat.event_options(g, cols(spark, ["Timestamp", "Q50", "Q05_to_Q50"]))
    assert sorted(r.value for r in eo.collect()) == ["Pump_Power::from_to::Q05_to_Q50", "Pump_Power::raw::Q50"]
