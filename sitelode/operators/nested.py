"""Flattens deeply nested records into related tables in one pass, without losing a value.

A depth-first visitor walks each payload once and emits tagged rows: the tag (the table a row belongs to), its
own key (the path from the root), the key of the nearest enclosing object row, its place in the array and its
values as a JSON object. Rows are of three kinds:

* ``root``: one for each readable payload, tag ``$``, key '' and no parent: all that stands above the first arrays;
* ``object``: one for each object that is an element of an array;
* ``value``: one for each other element of an array, null and empty arrays included, with the one member ``value``.

Members of plain sub-objects are dotted columns of the row around them (``gps.lat``), so each scalar of a payload
is in just one row. Writing the rows partitioned by tag gives one flat table for each tag (:func:`write_tables`);
:func:`typed_table` applies a schema to one of them.

No shuffle is needed to flatten: a record's rows are made where the record is read, and parent and child share
the record id, so tables of one parent join on (record id, path). A payload with very many elements is emitted
in slices, never held as a whole Arrow batch.

Defined cases: null, broken or empty payloads and payloads of more than one JSON value give no rows
(:func:`payload_status` counts them); a payload that is a scalar or an empty array has a root row with the member ``value``; empty
sub-objects and arrays stay as such values; repeated deliveries give their rows once for each delivery; of
repeated members the last counts; a dot or backslash inside a member's name has a backslash before it in column
names (paths have names as they stand); half of a surrogate pair stays an escape in values and becomes U+FFFD in
paths; columns of the input other than id and payload are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelode.sources.json_payloads import whole_value

#: Rows, and characters, in one emitted Arrow batch, about.
BATCH_ROWS, BATCH_CHARS = 8192, 4_000_000
ROOT, OBJECT, VALUE = "root", "object", "value"
ROOT_TAG = "$"

_HALF = re.compile("[\ud800-\udfff]")


def _members(node: dict, path: str, tag: str) -> tuple[dict, list[tuple[list, str, str]]]:
    """(column to value, arrays below as (elements, path, tag)) of an object and the plain objects in it."""
    own: dict = {}
    arrays = []
    stack = [("", path, tag, iter(node.items()))]
    while stack:
        column, at, kind, members = stack[-1]
        for name, child in members:
            key = name.replace("\\", "\\\\").replace(".", "\\.") if "." in name or "\\" in name else name
            key = f"{column}.{key}" if column else key
            if child and isinstance(child, (dict, list)):
                below = f"{at}.{name}" if at else name, f"{kind}.{name}" if kind else name
                if isinstance(child, dict):
                    stack.append((key, *below, iter(child.items())))
                    break
                arrays.append((child, *below))
            else:
                own[key] = child
        else:
            stack.pop()
    return own, arrays


def visit(value) -> Iterator[tuple[str, str, str, str | None, int | None, dict]]:
    """(kind, tag, path, parent path, place, values) of each row of a payload, parents first.

    The walk keeps its own stack, so depth is bounded by memory and not by Python's recursion limit.
    """
    if isinstance(value, dict):
        own, arrays = _members(value, "", "")
    elif value and isinstance(value, list):
        own, arrays = {}, [(value, "", "")]
    else:
        own, arrays = {"value": value}, []
    yield ROOT, ROOT_TAG, "", None, None, own
    stack = [(enumerate(a), path, f"{tag}[]", "") for a, path, tag in reversed(arrays)]
    while stack:
        elements, path, tag, parent = stack[-1]
        for place, child in elements:
            at = f"{path}[{place}]"
            if isinstance(child, dict):
                own, arrays = _members(child, at, tag)
                yield OBJECT, tag, at, parent, place, own
                if arrays:
                    stack += [(enumerate(a), p, f"{t}[]", at) for a, p, t in reversed(arrays)]
                    break
            elif child and isinstance(child, list):
                stack.append((enumerate(child), at, f"{tag}[]", parent))
                break
            else:
                yield VALUE, f"{tag}.value", at, parent, place, {"value": child}
        else:
            stack.pop()


def _strings(values: list[str | None], escape) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([v if v is None else _HALF.sub(escape, v) for v in values], pa.string())


def flatten_nested(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """Tagged rows of all payloads: id, table_tag, row_kind, path, parent_path, place, payload (a JSON object of the values)."""
    fields = [(n, T.StringType()) for n in ("table_tag", "row_kind", "path", "parent_path")] + [("place", T.IntegerType()), ("payload", T.StringType())]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(n, t) for n, t in fields)])
    dump = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
    lost, kept = (lambda m: "�"), (lambda m: f"\\u{ord(m.group()):04x}")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, chars = [], [], 0

            def out():
                kinds, tags, paths, parents, places, payloads = zip(*rows)
                ids = batch.column(0).take(pa.array(at, pa.int64()))
                return pa.RecordBatch.from_arrays([ids, _strings(tags, lost), pa.array(kinds, pa.string()), _strings(paths, lost), _strings(parents, lost), pa.array(places, pa.int32()), _strings(payloads, kept)], schema.names)

            for i, text in enumerate(batch.column(1).to_pylist()):
                ok, value = whole_value(text, halves=True)
                if not ok:
                    continue
                for *row, values in visit(value):
                    text = dump(values)
                    at.append(i)
                    rows.append((*row, text))
                    chars += len(text) + 2 * len(row[2])
                    if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield out()
                        at, rows, chars = [], [], 0
            if rows:
                yield out()

    return df.select(id_col, payload_col).where(F.col(payload_col).isNotNull()).mapInArrow(emit, schema)


def objects(rows: DataFrame) -> DataFrame:
    """The rows of objects that are elements of an array."""
    return rows.where(F.col("row_kind") == OBJECT)


def values(rows: DataFrame, id_col: str) -> DataFrame:
    """One row for each value: id, path of its row, name of its column, value as text (JSON text but for strings; null for null)."""
    each = F.explode(F.from_json("payload", "map<string,string>"))
    return rows.select(id_col, "path", each.alias("name", "value"))


def payload_status(df: DataFrame, payload_col: str) -> DataFrame:
    """How many payloads are readable, null or not one whole JSON value: status, n_payloads."""

    @F.pandas_udf("string")
    def status(texts):
        return texts.map(lambda t: "null" if t is None else "readable" if whole_value(t)[0] else "unreadable")

    return df.select(status(F.col(payload_col)).alias("status")).groupBy("status").agg(F.count("*").alias("n_payloads"))


def write_tables(rows: DataFrame, path: str) -> DataFrame:
    """Writes the tagged rows partitioned by tag, a folder for each flat table, and reads them back.

    A rebalancing exchange brings a tag's rows together, so the number of files follows the data and not tasks
    times tags; the largest tags are split. Reading one table reads one folder.
    """
    rows.hint("rebalance", "table_tag").write.partitionBy("table_tag").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)


def typed_table(rows: DataFrame, tag: str, members: dict[str, str]) -> DataFrame:
    """The flat table of the tags that match a pattern, with typed columns; ``members`` maps column names to SQL types.

    A value that its type does not admit becomes null. A member called as a key column gets the suffix ``_value``.
    """
    keys = [c for c in rows.columns if c != "payload"]
    picked = rows.where(F.col("table_tag").rlike(tag))
    quoted = lambda m: m.replace("\\", "\\\\").replace("'", "\\'").replace('"', '\\\\"')
    value = lambda m: F.expr(f"try_variant_get(v, '$[\"{quoted(m)}\"]', '{members[m]}')")
    return picked.withColumn("v", F.try_parse_json("payload")).select(*keys, *(value(m).alias(f"{m}_value" if m in keys else m) for m in members))
