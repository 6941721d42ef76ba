"""Query plans over nested and drifting payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.operators import drift, nested
from sitelode.session import cut, fresh_path, table


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten_nested(table(spark, sf_dir, "serp_raw"), "raw_id", "payload")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object in an array of a payload, with the nearest one around it."""
    return nested.objects(_flat(spark, sf_dir)).select("raw_id", "parent_path", "path")


def p2_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagged rows themselves: table, kind, key, parent key, place and values."""
    return _flat(spark, sf_dir)


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every readable payload, with the row and column that hold it."""
    return nested.values(_flat(spark, sf_dir), "raw_id")


#: Tags of the tables that hold the places of local results, whatever is around them.
PLACES = r"(^|[.\]])local_results(\.\w+)?\[\]$"


def p2_local_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat table of the many that are written, typed: the places of local results."""
    rows = nested.write_tables(_flat(spark, sf_dir), fresh_path(spark, "tables"))
    columns = {"title": "string", "position": "int", "rating": "double", "reviews": "bigint", "gps.lat": "double", "gps.lng": "double"}
    return nested.typed_table(rows.where("row_kind = 'object'"), PLACES, columns).withColumnsRenamed({"gps.lat": "lat", "gps.lng": "lng"})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of changes of both sources."""
    both = [drift.changes(drift.compared(drift.file_summaries(table(spark, sf_dir, name), kind))) for name, kind in (("serp_raw", "place"), ("audit_reports", "report"))]
    return both[0].unionByName(both[1])


def _consistent(spark: SparkSession, sf_dir: str, name: str, kind: str, key: str) -> DataFrame:
    df = table(spark, sf_dir, name)
    seen = cut(drift.compared(drift.file_summaries(df, kind), fields=True), f"fields-{kind}")
    return drift.consistent_table(df, kind, drift.union_schema(seen), key)


def p6_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of local results as one table with one schema."""
    return _consistent(spark, sf_dir, "serp_raw", "place", "raw_id")


def p6_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All audit reports as one table with one schema."""
    return _consistent(spark, sf_dir, "audit_reports", "report", "report_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_tables, p2_values, p2_local_places, p6_found, p6_places, p6_reports)}

#: Every node of every payload: its path without the root sign, and whether it is an element of an array.
_TREE = r"""r AS (SELECT raw_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS v FROM serp_raw),
t AS (SELECT raw_id, j.id, j.type, j.atom, j.value, regexp_replace(j.fullkey, '^\$\.?', '') AS path, regexp_matches(j.fullkey, '\]$') AS element FROM r, json_tree(r.v) j WHERE v IS NOT NULL)"""
#: The nearest object in an array above a node, and a node's table.
_PARENT = r"coalesce(regexp_extract(path, '^(.*\])\.[^\[\]]*(?:\[[0-9]+\])+$', 1), '')"
_TAG = r"regexp_replace(path, '\[[0-9]+\]', '[]', 'g')"
#: Values with the row and column that hold them.
_LEAVES = rf"""{_TREE}, l AS (SELECT raw_id, id, CASE WHEN element THEN path ELSE regexp_extract(path, '^(.*\])', 1) END AS path, CASE WHEN element OR path = '' THEN 'value' ELSE regexp_replace(path, '^.*\]\.', '') END AS name,
type, CASE WHEN type IN ('OBJECT', 'ARRAY') THEN CAST(value AS VARCHAR) ELSE CAST(coalesce(atom, 'null') AS VARCHAR) END AS atom, CASE WHEN type IN ('OBJECT', 'ARRAY') THEN CAST(value AS VARCHAR) WHEN type <> 'NULL' THEN atom->>'$' END AS value
FROM t WHERE type NOT IN ('OBJECT', 'ARRAY') OR CAST(value AS VARCHAR) = '[]' OR (CAST(value AS VARCHAR) = '{{}}' AND NOT element))"""
SQL: dict[str, str] = {
    "p2_found": f"WITH {_TREE} SELECT raw_id, {_PARENT} AS parent_path, path FROM t WHERE element AND type = 'OBJECT'",
    "p2_values": f"WITH {_LEAVES} SELECT raw_id, path, name, value FROM l",
    "p2_tables": f"""WITH {_LEAVES}, p AS (SELECT raw_id, path, '{{' || string_agg('"' || name || '":' || atom, ',' ORDER BY id) || '}}' AS payload FROM l GROUP BY 1, 2),
k AS (SELECT raw_id, 'object' AS row_kind, {_TAG} AS table_tag, path, {_PARENT} AS parent_path FROM t WHERE element AND type = 'OBJECT'
UNION ALL SELECT raw_id, 'value', {_TAG} || '.value', path, {_PARENT} FROM t WHERE element AND type <> 'OBJECT' AND (type <> 'ARRAY' OR CAST(value AS VARCHAR) = '[]')
UNION ALL SELECT raw_id, 'root', '$', '', NULL FROM t WHERE path = '')
SELECT raw_id, table_tag, row_kind, path, parent_path, CASE WHEN row_kind <> 'root' THEN CAST(regexp_extract(path, '\\[([0-9]+)\\]$', 1) AS INTEGER) END AS place, coalesce(payload, '{{}}') AS payload FROM k LEFT JOIN p USING (raw_id, path)""",
    "p2_local_places": f"""WITH {_TREE} SELECT raw_id, {_TAG} AS table_tag, 'object' AS row_kind, path, {_PARENT} AS parent_path, CAST(regexp_extract(path, '\\[([0-9]+)\\]$', 1) AS INTEGER) AS place, value->>'$.title' AS title,
TRY_CAST(value->>'$.position' AS INTEGER) AS position, TRY_CAST(value->>'$.rating' AS DOUBLE) AS rating, TRY_CAST(value->>'$.reviews' AS BIGINT) AS reviews, TRY_CAST(value->>'$.gps.lat' AS DOUBLE) AS lat, TRY_CAST(value->>'$.gps.lng' AS DOUBLE) AS lng
FROM t WHERE element AND type = 'OBJECT' AND regexp_matches({_TAG}, '(^|[.\\]])local_results(\\.\\w+)?\\[\\]$')""",
}
