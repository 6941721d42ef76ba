import json

from sitelode.operators import nested
from sitelode.plans import records
from sitelode.sources.json_payloads import whole_value


def brute(text):
    try:
        value = json.loads(text)
    except (ValueError, TypeError):
        return []
    out = []

    def walk(v, path, parent):
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, f"{path}.{k}" if path else k, parent)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                p = f"{path}[{i}]"
                if isinstance(x, dict):
                    out.append((parent, p))
                    walk(x, p, p)
                else:
                    walk(x, p, parent)

    walk(value, "", "")
    return out


PAYLOADS = [
    None, "", "null", "7", "not json", '{"a":1} {"b":2}', "[]", "{}", '[{"x":1},null,3,{"y":[{"z":1}]}]', '{"t":[{"r":[null,{"i":[{"k":{"l":[{"m":1}]}}]}]}]}', '{"a":[[{"b":1}],[2]]}', '{"a":[{"id":1,"path":"q","payload":"w"}]}',
    '{"a":NaN}', '{"a":[{"b":1}],"a":[{"c":1},{"c":2}]}',
]


def test_flatten_matches_brute_force(spark):
    df = spark.createDataFrame([(i, p, "x", "clash") for i, p in enumerate(PAYLOADS)], "id long, body string, path string, table_tag string")
    got = sorted((r["id"], r["parent_path"], r["path"]) for r in nested.objects(nested.flatten_nested(df, "id", "body")).collect())
    want = sorted((i, a, b) for i, p in enumerate(PAYLOADS) for a, b in brute(p) if p != '{"a":NaN}')
    assert got == want


def test_every_child_names_a_parent_of_its_record(spark, small):
    rows = records.p2_found(spark, small).collect()
    keys = {(r["raw_id"], r["path"]) for r in rows}
    assert all(r["parent_path"] == "" or (r["raw_id"], r["parent_path"]) in keys for r in rows) and len(keys) == len(rows)


def test_deep_nesting_and_long_arrays(spark):
    deep = '{"a":[' * 200 + "1" + "]}" * 200
    long = json.dumps({"a": [{"i": i} for i in range(20_000)]})
    df = spark.createDataFrame([(1, deep), (2, long)], "id long, body string")
    got = {r["id"]: r["n"] for r in nested.objects(nested.flatten_nested(df, "id", "body")).groupBy("id").count().withColumnRenamed("count", "n").collect()}
    assert got == {1: 199, 2: 20_000}


def test_empty_table_and_status(spark):
    df = spark.createDataFrame([], "id long, body string")
    assert nested.flatten_nested(df, "id", "body").count() == 0
    full = spark.createDataFrame([(p,) for p in PAYLOADS], "body string")
    got = {r["status"]: r["n_payloads"] for r in nested.payload_status(full, "body").collect()}
    assert got == {"null": 1, "readable": 9, "unreadable": 4}


def test_typed_table(spark):
    df = spark.createDataFrame([(1, '{"a":[{"id":"x","n":"7"},{"n":"seven"},{"n":null}]}')], "id long, body string")
    rows = nested.typed_table(nested.flatten_nested(df, "id", "body"), r"^a\[\]$", {"n": "int", "id": "string"}).orderBy("path").collect()
    assert [r["n"] for r in rows] == [7, None, None] and rows[0]["id_value"] == "x" and rows[0]["id"] == 1


def leaves(value):
    """Every scalar and empty container of a value, elements that are empty objects aside (they have a row)."""
    if isinstance(value, dict) and value:
        return [x for v in value.values() for x in leaves(v)]
    if isinstance(value, list) and value:
        return [x for v in value for x in ([] if v == {} else leaves(v))]
    return [json.dumps(value, ensure_ascii=False)]


ODD = ['{"a.b":1,"a":{"b":2,"c\\\\d":[]},"e":{}}', '[[1,[2,null]],[],{}]', '{"x":{"y":[true,{"z":{"w":"v"}}]},"u":"\\ud800","\\ud801":[3]}', '"text"']


def test_no_value_is_lost(spark, small):
    raw = [(r["raw_id"], r["payload"]) for r in spark.read.parquet(f"{small}/serp_raw.parquet").collect()] + [(10**6 + i, p) for i, p in enumerate(PAYLOADS + ODD)]
    rows = nested.flatten_nested(spark.createDataFrame(raw, "id long, body string"), "id", "body").collect()
    got = sorted((r["id"], json.dumps(v, ensure_ascii=False)) for r in rows for v in json.loads(r["payload"]).values())
    assert got == sorted((i, v) for i, p in raw if whole_value(p)[0] and whole_value(p)[1] != {} for v in leaves(whole_value(p, halves=True)[1]))
    assert {r["id"] for r in rows if r["row_kind"] == "root"} == {i for i, p in raw if whole_value(p)[0]}


def test_dots_in_names_and_halves_of_pairs(spark):
    rows = nested.flatten_nested(spark.createDataFrame(list(enumerate(ODD)), "id long, body string"), "id", "body").collect()
    by = {(r["id"], r["path"]): r for r in rows}
    assert json.loads(by[0, ""]["payload"]) == {"a\\.b": 1, "a.b": 2, "a.c\\\\d": [], "e": {}}
    assert {p for i, p in by if i == 1} == {"", "[0][0]", "[0][1][0]", "[0][1][1]", "[1]", "[2]"} and by[1, "[0][1][1]"]["payload"] == '{"value":null}'
    assert by[2, "�[0]"]["payload"] == '{"value":3}' and by[2, ""]["payload"] == '{"u":"\\ud800"}' and by[2, "x.y[1]"]["payload"] == '{"z.w":"v"}'


def test_any_depth_is_read(spark):
    deep = '{"a":[' * 60_000 + '{"b":{}}, [ ] , -1.5e1' + "]}" * 60_000
    ok, value = whole_value(deep)
    n = 0
    while isinstance(value, dict) and "a" in value:
        value, n = value["a"], n + 1
        value = value[0] if n < 60_000 else value
    assert ok and n == 60_000 and value == [{"b": {}}, [], -15.0]
    assert not any(whole_value(deep + x)[0] for x in ("]", "x", " {}")) and not whole_value(deep[:-1])[0] and not whole_value(deep.replace("[ ]", "[ ,]"))[0]
    df = spark.createDataFrame([(1, '{"a":[' * 3_000 + "1" + "]}" * 3_000)], "id long, body string")
    assert nested.objects(nested.flatten_nested(df, "id", "body")).count() == 2_999


def test_tables_are_written_by_tag(spark, tmp_path):
    rows = nested.flatten_nested(spark.createDataFrame([(i, p) for i, p in enumerate(PAYLOADS + ODD)], "id long, body string"), "id", "body")
    back = nested.write_tables(rows, f"{tmp_path}/t")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert "PartitionFilters: [isnotnull(table_tag" in back.where("table_tag = '$'")._jdf.queryExecution().toString()


def test_halves_of_pairs_are_mended():
    assert whole_value('["\\ud83d\\ude00\\ud83d","\\\\ud800",1]') == (True, ["😀�", "\\ud800", 1])
