"""Registered queries for catalogue, event-dictionary, validation and registry operators.

Catalogues are derived from the driver tables: ``part`` is a catalogue of
components (brands) and measurements (part names) whose readings live in
``lineitem``; ``region``/``nation`` are a nested catalogue.  Nested results
are rendered as text so both engines compare them exactly.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from chronoweave.operators import catalogue as cat
from chronoweave.operators import events, validate
from chronoweave.plans.checks_common import table
from chronoweave.sources import registry


def _bnum(c):
    return F.substring_index(c, "#", -1)


def part_catalogue(spark, d):
    p = table(spark, d, "part")
    g = p.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("ordinal"), F.min("p_size").alias("sz"),
                                           F.min("p_type").alias("ptype"))
    sz = F.col("sz")
    return g.select(
        "ordinal", F.col("p_brand").alias("component_id"),
        F.when(_bnum(F.col("p_brand")).cast("int") % 2 == 0,
               F.concat(F.lit("Brand "), _bnum(F.col("p_brand")))).alias("component_name"),
        F.when(sz > 45, F.concat("p_name", F.lit(" x"))).otherwise(F.col("p_name")).alias("measurement"),
        F.when(sz % 3 == 0, F.lower("ptype")).when(sz % 3 == 1, F.lit(None).cast("string"))
         .otherwise(F.concat("p_name", F.lit("*"))).alias("display_name"),
        F.when(sz % 2 == 0, F.lit("kW")).when(sz % 5 == 0, F.lit("")).alias("unit"),
        F.concat(F.lit("t_"), F.lower("ptype")).alias("type"),
        F.concat(F.lit("size "), sz.cast("string")).alias("description"))


def reading_columns(spark, d):
    """Column list of a readings table: measurements that have lineitems (renamed ones are absent by name)."""
    p = table(spark, d, "part")
    # each part once: the join then sorts, or broadcasts, parts and not readings
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    used = p.join(li, "p_partkey", "left_semi")
    place = F.col("p_partkey").cast("bigint").alias("ordinal")
    names = (used.select(F.col("p_name").alias("column"), place)
             .unionByName(used.select(F.lower("p_type").alias("column"), place))
             .unionByName(spark.range(1).select(F.lit("Timestamp").alias("column"), F.lit(0).cast("bigint").alias("ordinal"))))
    return names.groupBy("column").agg(F.min("ordinal").alias("ordinal")).select("ordinal", "column")


def nation_components(spark, d):
    """Nested catalogue: one row per region with a map of its nations."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    k = F.col("n_nationkey")
    meta = F.struct(F.when(k % 2 == 0, F.lower("n_name")).alias("display_name"),
                    F.when(k % 3 == 0, F.lit("kW")).when(k % 3 == 1, F.lit("V")).alias("unit"),
                    F.when(k % 4 == 0, F.lit("potencia")).when(k % 4 == 1, F.lit("voltaje"))
                     .when(k % 4 == 2, F.lit("tiempo")).otherwise(F.lit("frecuencia")).alias("type"),
                    F.concat(F.lit("nation "), k.cast("string")).alias("description"))
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    g = j.groupBy("r_regionkey", "r_name").agg(
        F.array_sort(F.collect_list(F.struct(k.alias("o"), F.col("n_name").alias("n"), meta.alias("m")))).alias("__l"))
    return g.select(F.col("r_name").alias("component_id"), F.col("r_regionkey").alias("comp_ord"),
                    F.when(F.col("r_regionkey") % 2 == 0,
                           F.concat(F.upper(F.substring("r_name", 1, 1)), F.lower(F.substring("r_name", 2, 100))))
                    .alias("name"),
                    F.map_from_entries(F.transform("__l", lambda x: F.struct(x["n"], x["m"]))).alias("measurements"))


def nation_catalogue(spark, d):
    return cat.catalogue_flat(nation_components(spark, d))


def part_options(spark, d):
    return cat.measure_options(part_catalogue(spark, d), reading_columns(spark, d))


def selector_codes(spark, d):
    p = table(spark, d, "part")
    return p.select(F.explode(F.array(
        F.col("p_name"), F.concat("p_brand", F.lit("::raw::"), "p_name"), F.lower("p_type"),
        F.concat("p_name", F.lit(" x")), F.lit("zz_unknown"))).alias("code")).distinct()


def dictionary_rows(spark, d):
    """Event dictionary (ord, key, code) derived from part: levels, transitions, junk."""
    p = table(spark, d, "part")
    sz = F.lpad(F.col("p_size").cast("string"), 2, "0")
    to = F.lpad((F.lit(51) - F.col("p_size")).cast("string"), 2, "0")
    keys = F.array(F.concat("p_type", F.lit("_Q"), sz),
                   F.concat("p_type", F.lit("_from_Q"), sz, F.lit("_to_Q"), to),
                   F.concat("p_type", F.lit("_fromage_Q"), sz),
                   F.concat("p_type", F.lit("_level")))
    k = p.select("p_partkey", F.explode(keys).alias("key")).groupBy("key").agg(F.min("p_partkey").alias("code"))
    return k.select(F.col("code").alias("ord"), "key", "code")


def event_columns(spark, d):
    """Event columns; those of every third size carry another prefix and so are absent by name."""
    p = table(spark, d, "part")
    sz = F.lpad(F.col("p_size").cast("string"), 2, "0")
    to = F.lpad((F.lit(51) - F.col("p_size")).cast("string"), 2, "0")
    prefix = F.when(F.col("p_size") % 3 == 0, F.lit("old_Q")).otherwise(F.lit("Q"))
    return (p.select(F.explode(F.array(F.concat(prefix, sz), F.concat(prefix, sz, F.lit("_to_Q"), to))).alias("column"))
            .distinct())


def _csv(a):
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


def customer_rules(name: str) -> list:
    """Rule sets over ``customer`` (built lazily: Columns need an active session)."""
    return {
        "validate_enum": lambda: [validate.enum("c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"])],
        "validate_types": lambda: [validate.typed("c_acctbal", "float"), validate.typed("c_name", "int")],
        "validate_conditional": lambda: [validate.conditional("c_acctbal", "c_mktsegment", "BUILDING",
                                                              F.col("c_acctbal") > 0)],
    }[name]()


def manifests(spark, d):
    """Manifest table derived from nation: one dataset per nation."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    return n.select(
        F.regexp_replace("n_name", " ", "-").alias("dataset"),
        F.lit("1.0").alias("version"), F.concat(F.lit("readings of "), F.col("n_name")).alias("description"),
        F.lit("2024-01-01").alias("date_created"),
        F.when(k % 3 == 0, F.lit("TabularDataSet")).when(k % 3 == 1, F.lit("EventEncodedDataSet")).alias("type"),
        F.when(k % 5 == 0, F.lit("Events_Dictionary.json")).alias("dictionary"))


def part_manifest_values(spark, d):
    """Manifest values derived from part: one dataset per part, with a section or field absent, empty or of another type."""
    p = table(spark, d, "part")
    name, z = F.concat(F.lit("ds-"), F.col("p_partkey").cast("string")), F.col("p_size")
    null = F.lit(None).cast("string")

    def row(section, step, field, kind, text, when):
        return F.when(when, F.struct(F.lit(section).alias("section"), (F.lit(step) if step else null).alias("step"),
                                     (F.lit(field) if field else null).alias("field"),
                                     (kind if kind is not None else null).alias("type"),
                                     (text if text is not None else null).alias("text")))

    s, b, always = F.lit("str"), F.lit("bool"), F.lit(True)
    has = z % 4 != 0  # a cleaning section
    rows = [
        row("metadata", None, "version", F.when(z % 3 == 0, F.lit("float")).otherwise(s), F.lit("1.0"), always),
        row("metadata", None, "dataset", s, F.col("p_name"), always),
        row("metadata", None, "description", s, F.when(z % 5 == 0, F.lit(" ")).otherwise(F.col("p_type")), always),
        row("metadata", None, "date_created", s, F.lit("2024-01-01"), z % 7 != 0),
        row("metadata", None, "type", s, F.lit("TabularDataSet"), always),
        row("pipelineCleanData", None, None, None, None, has),
        row("pipelineCleanData", None, "run_enabled", F.when(z % 6 == 1, s).otherwise(b), F.lit("true"), has & (z % 9 != 1)),
    ]
    for step, k in (("merge_all_datasets", 2), ("rellenar_timestamps", 3)):
        there = has & (z % k != 1)
        rows.append(row("step", step, None, None, None, there))
        rows += [row("step", step, f, b if f == "enabled" else s, F.lit("x"), there & (z % (k + i + 3) != 2))
                 for i, f in enumerate(("enabled", "module", "func", "description"))]
    every = F.filter(F.array(*rows), lambda x: x.isNotNull())
    return p.select(name.alias("dataset"), F.explode(every).alias("v")).select("dataset", "v.*")


def q_dataset_registry(spark, d):
    return registry.registry_from_manifests(manifests(spark, d), base_path="/datasets")


def q_validate_required(spark, d):
    m = manifests(spark, d)
    return validate.validate_rows(m, validate.manifest_rules(), "dataset")


QUERIES = {
    "catalogue_flat": nation_catalogue,
    "measure_options": part_options,
    "measure_options_fallback": lambda s, d: cat.measure_options_fallback(
        cat.measure_options(nation_catalogue(s, d), reading_columns(s, d)), reading_columns(s, d)),
    "measure_options_matched": lambda s, d: cat.measure_options_fallback(part_options(s, d), reading_columns(s, d)),
    "event_options": lambda s, d: cat.event_options(
        events.event_groups(dictionary_rows(s, d), "compact"), event_columns(s, d)).select(
        *[F.col(f"ordinal.{c}").alias(f"ordinal_{c}") for c in ("component", "mode", "place")], "label", "value"),
    "measure_info": lambda s, d: cat.measure_info(selector_codes(s, d), part_catalogue(s, d)),
    "measure_labels": lambda s, d: cat.measure_labels(selector_codes(s, d), part_catalogue(s, d)),
    "filter_component": lambda s, d: cat.filter_component(part_options(s, d), "Brand#13"),
    "filter_type": lambda s, d: cat.filter_type(part_options(s, d), "small", part_catalogue(s, d)),
    "filter_type_meta": lambda s, d: cat.filter_type(part_options(s, d), "t_promo", part_catalogue(s, d)),
    "filter_selected": lambda s, d: cat.filter_selected(
        part_options(s, d), table(s, d, "part").select(F.lower("p_type").alias("value"))),
    "default_measure": lambda s, d: cat.default_measure(part_options(s, d)),
    "type_list": lambda s, d: cat.type_list(nation_catalogue(s, d)),
    "component_list": lambda s, d: cat.component_list(nation_catalogue(s, d)),
    "event_classify": lambda s, d: events.event_classify(dictionary_rows(s, d)),
    "event_groups_compact": lambda s, d: events.event_groups(dictionary_rows(s, d), "compact").select(
        "component", "name", F.array_join("raw_columns", ",").alias("raw_columns"),
        _csv(F.col("raw_encoded")).alias("raw_encoded"),
        F.array_join("from_to_columns", ",").alias("from_to_columns"),
        _csv(F.col("from_to_encoded")).alias("from_to_encoded")),
    "event_groups_old": lambda s, d: events.event_groups(dictionary_rows(s, d), "old").select(
        "component",
        F.array_join(F.transform(F.map_entries("raw"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("raw"),
        F.array_join(F.transform(F.map_entries("from_to"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("from_to")),
    "event_groups_long": lambda s, d: events.event_groups(dictionary_rows(s, d), "long").select(
        "component", "name",
        F.array_join(F.transform("raw", lambda e: F.concat(e["name"], F.lit(":"), e["encoded"].cast("string"))), ",").alias("raw"),
        F.array_join(F.transform("from_to", lambda e: F.concat(e["name"], F.lit(":"), e["encoded"].cast("string"))), ",").alias("from_to")),
    "validate_required": q_validate_required,
    "validate_enum": lambda s, d: validate.validate_rows(table(s, d, "customer"), customer_rules("validate_enum"), "c_custkey"),
    "validate_types": lambda s, d: validate.validate_rows(table(s, d, "customer"), customer_rules("validate_types"), "c_custkey"),
    "validate_conditional": lambda s, d: validate.validate_rows(table(s, d, "customer"), customer_rules("validate_conditional"), "c_custkey"),
    "dataset_registry": q_dataset_registry,
    "validate_manifests": lambda s, d: validate.validate_manifest_values(part_manifest_values(s, d)),
}

# ---------------------------------------------------------------- oracle SQL

PART_CAT = """g AS (SELECT p_brand, p_name, min(p_partkey) AS ordinal, min(p_size) AS sz, min(p_type) AS ptype
        FROM part GROUP BY p_brand, p_name),
cat AS (SELECT ordinal, p_brand AS component_id,
   CASE WHEN CAST(split_part(p_brand, '#', 2) AS INTEGER) % 2 = 0 THEN 'Brand ' || split_part(p_brand, '#', 2) END AS component_name,
   CASE WHEN sz > 45 THEN p_name || ' x' ELSE p_name END AS measurement,
   CASE WHEN sz % 3 = 0 THEN lower(ptype) WHEN sz % 3 = 1 THEN NULL ELSE p_name || '*' END AS display_name,
   CASE WHEN sz % 2 = 0 THEN 'kW' WHEN sz % 5 = 0 THEN '' END AS unit,
   't_' || lower(ptype) AS type, 'size ' || CAST(sz AS VARCHAR) AS description FROM g),
used AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)),
cn AS (SELECT p_name AS "column", CAST(p_partkey AS BIGINT) AS ordinal FROM used
       UNION ALL SELECT lower(p_type), p_partkey FROM used UNION ALL SELECT 'Timestamp', 0),
cols AS (SELECT min(ordinal) AS ordinal, "column" FROM cn GROUP BY "column"),
opts AS (SELECT * FROM (SELECT ordinal,
    coalesce(display_name, measurement) || ' (' || coalesce(component_name, component_id) || ')' AS label,
    CASE WHEN display_name IN (SELECT "column" FROM cols) THEN display_name
         WHEN measurement IN (SELECT "column" FROM cols) THEN measurement END AS value FROM cat) WHERE value IS NOT NULL)"""

NATION_CAT = """nc AS (SELECT CAST(r_regionkey AS BIGINT) * 4294967296 + row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS ordinal,
    r_name AS component_id,
    CASE WHEN r_regionkey % 2 = 0 THEN upper(substring(r_name, 1, 1)) || lower(substring(r_name, 2)) END AS component_name,
    n_name AS measurement,
    CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) END AS display_name,
    CASE WHEN n_nationkey % 3 = 0 THEN 'kW' WHEN n_nationkey % 3 = 1 THEN 'V' END AS unit,
    CASE n_nationkey % 4 WHEN 0 THEN 'potencia' WHEN 1 THEN 'voltaje' WHEN 2 THEN 'tiempo' ELSE 'frecuencia' END AS type,
    'nation ' || CAST(n_nationkey AS VARCHAR) AS description
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

CODES = """codes AS (SELECT DISTINCT code FROM (SELECT p_name AS code FROM part
    UNION ALL SELECT p_brand || '::raw::' || p_name FROM part UNION ALL SELECT lower(p_type) FROM part
    UNION ALL SELECT p_name || ' x' FROM part UNION ALL SELECT 'zz_unknown' FROM part)),
coded AS (SELECT code, split_part(code, '::', 1) AS comp, split_part(code, '::', 2) AS mode,
    regexp_extract(code, '^(.*?)::(.*?)::(.*)$', 3) AS col FROM codes WHERE regexp_matches(code, '^(.*?)::(.*?)::(.*)$')),
cnames AS (SELECT component_id, arg_min(component_name, ordinal) AS cname FROM cat GROUP BY component_id),
hits AS (SELECT c.code, k.ordinal, coalesce(k.component_name, k.component_id) AS comp
    FROM codes c JOIN cat k ON c.code = k.measurement WHERE NOT regexp_matches(c.code, '^(.*?)::(.*?)::(.*)$')
    UNION ALL SELECT c.code, k.ordinal, coalesce(k.component_name, k.component_id)
    FROM codes c JOIN cat k ON c.code = k.display_name WHERE NOT regexp_matches(c.code, '^(.*?)::(.*?)::(.*)$')),
best AS (SELECT code, arg_min(comp, ordinal) AS comp FROM hits GROUP BY code),
info AS (SELECT code, coalesce(cname, comp) AS component, col AS measurement, mode
    FROM coded LEFT JOIN cnames ON comp = component_id
    UNION ALL SELECT c.code, b.comp, CASE WHEN b.comp IS NOT NULL THEN c.code END, CAST(NULL AS VARCHAR)
    FROM codes c LEFT JOIN best b USING (code) WHERE NOT regexp_matches(c.code, '^(.*?)::(.*?)::(.*)$'))"""

DICT = """k AS (SELECT key, min(p_partkey) AS code FROM (
    SELECT p_partkey, p_type || '_Q' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS key FROM part
    UNION ALL SELECT p_partkey, p_type || '_from_Q' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '_to_Q'
              || lpad(CAST(51 - p_size AS VARCHAR), 2, '0') FROM part
    UNION ALL SELECT p_partkey, p_type || '_fromage_Q' || lpad(CAST(p_size AS VARCHAR), 2, '0') FROM part
    UNION ALL SELECT p_partkey, p_type || '_level' FROM part) GROUP BY key),
cl AS (SELECT code AS ord, key, code,
    CASE WHEN NOT contains(key, 'from') AND regexp_matches(key, '^(.*)_Q(\\d+)$') THEN regexp_extract(key, '^(.*)_Q(\\d+)$', 1)
         WHEN regexp_matches(key, '^(.*)_from_Q(\\d+)_to_Q(\\d+)$') THEN regexp_extract(key, '^(.*)_from_Q(\\d+)_to_Q(\\d+)$', 1) END AS component,
    CASE WHEN NOT contains(key, 'from') AND regexp_matches(key, '^(.*)_Q(\\d+)$') THEN 'raw'
         WHEN regexp_matches(key, '^(.*)_from_Q(\\d+)_to_Q(\\d+)$') THEN 'from_to' END AS kind,
    CASE WHEN NOT contains(key, 'from') AND regexp_matches(key, '^(.*)_Q(\\d+)$') THEN 'Q' || regexp_extract(key, '^(.*)_Q(\\d+)$', 2)
         WHEN regexp_matches(key, '^(.*)_from_Q(\\d+)_to_Q(\\d+)$') THEN 'Q' || regexp_extract(key, '^(.*)_from_Q(\\d+)_to_Q(\\d+)$', 2)
              || '_to_Q' || regexp_extract(key, '^(.*)_from_Q(\\d+)_to_Q(\\d+)$', 3) END AS "column" FROM k),
c AS (SELECT min(ord) AS ord, arg_max(key, ord) AS key, arg_max(code, ord) AS code, component, kind, "column"
    FROM cl WHERE kind IS NOT NULL GROUP BY component, kind, "column"),
grp AS (SELECT component,
    coalesce(string_agg(CASE WHEN kind = 'raw' THEN "column" END, ',' ORDER BY ord), '') AS raw_columns,
    coalesce(string_agg(CASE WHEN kind = 'raw' THEN CAST(code AS VARCHAR) END, ',' ORDER BY ord), '') AS raw_encoded,
    coalesce(string_agg(CASE WHEN kind = 'raw' THEN "column" || '=' || CAST(code AS VARCHAR) END, ',' ORDER BY ord), '') AS raw_map,
    coalesce(string_agg(CASE WHEN kind = 'raw' THEN "column" || ':' || CAST(code AS VARCHAR) END, ',' ORDER BY ord), '') AS raw_long,
    coalesce(string_agg(CASE WHEN kind = 'from_to' THEN "column" END, ',' ORDER BY ord), '') AS from_to_columns,
    coalesce(string_agg(CASE WHEN kind = 'from_to' THEN CAST(code AS VARCHAR) END, ',' ORDER BY ord), '') AS from_to_encoded,
    coalesce(string_agg(CASE WHEN kind = 'from_to' THEN "column" || '=' || CAST(code AS VARCHAR) END, ',' ORDER BY ord), '') AS ft_map,
    coalesce(string_agg(CASE WHEN kind = 'from_to' THEN "column" || ':' || CAST(code AS VARCHAR) END, ',' ORDER BY ord), '') AS ft_long
    FROM c GROUP BY component)"""

MANIFESTS = """m AS (SELECT replace(n_name, ' ', '-') AS dataset, '1.0' AS version, 'readings of ' || n_name AS description,
    '2024-01-01' AS date_created,
    CASE WHEN n_nationkey % 3 = 0 THEN 'TabularDataSet' WHEN n_nationkey % 3 = 1 THEN 'EventEncodedDataSet' END AS type,
    CASE WHEN n_nationkey % 5 = 0 THEN 'Events_Dictionary.json' END AS dictionary FROM nation)"""

def _manifest_sql() -> str:
    """Violations of part_manifest_values, field by field."""
    def need(section, step, field, cond):
        return (f"SELECT 'ds-' || CAST(p_partkey AS VARCHAR) AS dataset, '{section}' AS section, "
                f"{repr(step) if step else 'CAST(NULL AS VARCHAR)'} AS step, 'required' AS rule, '{field}' AS field, "
                f"'{field} is required' AS message FROM part WHERE {cond}")

    out = [need("metadata", None, "description", "p_size % 5 = 0"), need("metadata", None, "date_created", "p_size % 7 = 0"),
           need("pipelineCleanData", None, "run_enabled", "p_size % 4 <> 0 AND p_size % 9 = 1")]
    typed = need("metadata", None, "version", "p_size % 3 = 0") + " UNION ALL " + \
        need("pipelineCleanData", None, "run_enabled", "p_size % 4 <> 0 AND p_size % 9 <> 1 AND p_size % 6 = 1")
    typed = typed.replace("'required'", "'type'").replace("version is required", "version must be of type str") \
        .replace("run_enabled is required", "run_enabled must be of type bool")
    for step, k in (("merge_all_datasets", 2), ("rellenar_timestamps", 3)):
        out += [need("step", step, f, f"p_size % 4 <> 0 AND p_size % {k} <> 1 AND p_size % {k + i + 3} = 2")
                for i, f in enumerate(("enabled", "module", "func", "description"))]
    return " UNION ALL ".join([*out, typed])


ORACLE = {
    "validate_manifests": _manifest_sql(),
    "catalogue_flat": f"WITH {NATION_CAT} SELECT * FROM nc",
    "measure_options": f"WITH {PART_CAT} SELECT * FROM opts",
    "measure_options_fallback": f"""WITH {PART_CAT}, {NATION_CAT},
        no AS (SELECT ordinal, coalesce(display_name, measurement) || ' (' || coalesce(component_name, component_id) || ')' AS label,
           CASE WHEN display_name IN (SELECT "column" FROM cols) THEN display_name
                WHEN measurement IN (SELECT "column" FROM cols) THEN measurement END AS value FROM nc)
        SELECT * FROM no WHERE value IS NOT NULL
        UNION ALL SELECT ordinal, "column" AS label, "column" AS value FROM cols
        WHERE lower("column") <> 'timestamp' AND NOT EXISTS (SELECT 1 FROM no WHERE value IS NOT NULL)""",
    "measure_options_matched": f"""WITH {PART_CAT} SELECT * FROM opts
        UNION ALL SELECT ordinal, "column", "column" FROM cols
        WHERE lower("column") <> 'timestamp' AND NOT EXISTS (SELECT 1 FROM opts)""",
    "event_options": f"""WITH {DICT},
        ep AS (SELECT CASE WHEN p_size % 3 = 0 THEN 'old_Q' ELSE 'Q' END || lpad(CAST(p_size AS VARCHAR), 2, '0') AS q,
               '_to_Q' || lpad(CAST(51 - p_size AS VARCHAR), 2, '0') AS t FROM part),
        ec AS (SELECT q AS "column" FROM ep UNION SELECT q || t FROM ep),
        ranked AS (SELECT c.*, row_number() OVER (PARTITION BY component, kind ORDER BY ord) - 1 AS p FROM c)
        SELECT component AS ordinal_component, CASE WHEN kind = 'raw' THEN 0 ELSE 1 END AS ordinal_mode, CAST(p AS INTEGER) AS ordinal_place,
               "column" || ' (' || component || ' · ' || kind || ')' AS label,
               component || '::' || kind || '::' || "column" AS value
        FROM ranked WHERE "column" IN (SELECT "column" FROM ec)""",
    "measure_info": f"WITH {PART_CAT}, {CODES} SELECT code, component, measurement, mode FROM info",
    "measure_labels": f"""WITH {PART_CAT}, {CODES},
        ck AS (SELECT m, arg_min(component_id, ordinal) AS cid FROM (
            SELECT component_id, component_name AS m, ordinal FROM cat WHERE component_name IS NOT NULL
            UNION ALL SELECT component_id, component_id, ordinal FROM cat) GROUP BY m),
        e AS (SELECT info.*, ck.cid FROM info LEFT JOIN ck ON info.component = ck.m),
        x AS (SELECT e.code, e.measurement, k.display_name AS dn, k.unit AS u, k.measurement AS mk
              FROM e LEFT JOIN cat k ON k.component_id = e.cid AND k.measurement = e.measurement)
        SELECT code, CASE WHEN mk IS NULL THEN code
                          WHEN u IS NOT NULL AND u <> '' THEN coalesce(dn, measurement) || ' [' || u || ']'
                          ELSE coalesce(dn, measurement) END AS label FROM x""",
    "filter_component": f"""WITH {PART_CAT} SELECT * FROM opts
        WHERE starts_with(value, 'Brand#13::') OR contains(label, '(Brand#13)')""",
    "filter_type": f"""WITH {PART_CAT},
        lab AS (SELECT * FROM opts WHERE contains(lower(label), 'small')),
        meta AS (SELECT o.* FROM opts o JOIN cat k ON k.type = 'small' AND (o.value = k.measurement
                 OR (contains(o.value, '::') AND regexp_extract(o.value, '^.*::(.*)$', 1) = k.measurement)))
        SELECT * FROM lab UNION ALL SELECT * FROM meta WHERE NOT EXISTS (SELECT 1 FROM lab)""",
    "filter_type_meta": f"""WITH {PART_CAT},
        lab AS (SELECT * FROM opts WHERE contains(lower(label), 't_promo')),
        meta AS (SELECT o.* FROM opts o JOIN cat k ON k.type = 't_promo' AND (o.value = k.measurement
                 OR (contains(o.value, '::') AND regexp_extract(o.value, '^.*::(.*)$', 1) = k.measurement)))
        SELECT * FROM lab UNION ALL SELECT * FROM meta WHERE NOT EXISTS (SELECT 1 FROM lab)""",
    "filter_selected": f"WITH {PART_CAT} SELECT * FROM opts WHERE value IN (SELECT lower(p_type) FROM part)",
    "default_measure": f"WITH {PART_CAT} SELECT * FROM opts ORDER BY ordinal, value LIMIT 1",
    "type_list": f"""WITH {NATION_CAT}
        SELECT 0 AS position, 'Todos' AS label, 'ALL' AS value
        UNION ALL SELECT row_number() OVER (ORDER BY type), upper(substring(type, 1, 1)) || lower(substring(type, 2)), type
        FROM (SELECT DISTINCT type FROM nc WHERE type IS NOT NULL AND type <> '' AND type NOT IN ('tiempo', 'time', 'timestamp'))""",
    "component_list": f"""WITH {NATION_CAT}
        SELECT -1 AS position, 'Todos' AS label, 'ALL' AS value
        UNION ALL SELECT min(ordinal), coalesce(arg_min(component_name, ordinal), component_id), component_id
        FROM nc WHERE lower(component_id) <> 'timestamp' GROUP BY component_id""",
    "event_classify": f"WITH {DICT} SELECT ord, key, code, component, kind, \"column\" FROM c",
    "event_groups_compact": f"""WITH {DICT} SELECT component, component AS name, raw_columns, raw_encoded,
        from_to_columns, from_to_encoded FROM grp""",
    "event_groups_old": f"WITH {DICT} SELECT component, raw_map AS raw, ft_map AS from_to FROM grp",
    "event_groups_long": f"WITH {DICT} SELECT component, component AS name, raw_long AS raw, ft_long AS from_to FROM grp",
    "validate_required": f"""WITH {MANIFESTS}
        SELECT dataset AS row_key, 'required' AS rule, 'type' AS "column", 'type is required' AS message FROM m WHERE type IS NULL
        UNION ALL SELECT dataset, 'conditional', 'dictionary', 'dictionary is required when type is EventEncodedDataSet'
        FROM m WHERE type = 'EventEncodedDataSet' AND (dictionary IS NULL OR trim(dictionary) = '')""",
    "validate_enum": """SELECT CAST(c_custkey AS VARCHAR) AS row_key, 'enum' AS rule, 'c_mktsegment' AS "column",
        'c_mktsegment must be one of AUTOMOBILE, BUILDING, FURNITURE, MACHINERY' AS message FROM customer
        WHERE c_mktsegment IS NOT NULL AND c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY')""",
    "validate_types": """SELECT CAST(c_custkey AS VARCHAR) AS row_key, 'type' AS rule, 'c_acctbal' AS "column",
        'c_acctbal must be of type float' AS message FROM customer
        WHERE c_acctbal IS NOT NULL AND TRY_CAST(CAST(c_acctbal AS VARCHAR) AS DOUBLE) IS NULL
        UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'type', 'c_name', 'c_name must be of type int' FROM customer
        WHERE c_name IS NOT NULL AND TRY_CAST(c_name AS BIGINT) IS NULL""",
    "validate_conditional": """SELECT CAST(c_custkey AS VARCHAR) AS row_key, 'conditional' AS rule, 'c_acctbal' AS "column",
        'c_acctbal is required when c_mktsegment is BUILDING' AS message FROM customer
        WHERE c_mktsegment = 'BUILDING' AND NOT coalesce(c_acctbal > 0, false)""",
    "dataset_registry": f"""WITH {MANIFESTS}
        SELECT dataset AS name, '/datasets/' || dataset AS path, coalesce(type, 'TabularDataSet') AS type,
               lower(replace(dataset, '-', '_')) AS table_name, dictionary FROM m""",
}
