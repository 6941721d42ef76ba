import json

from sitelode.operators import drift
from sitelode.session import cut


def frame(spark, rows):
    return spark.createDataFrame([(f, n, p if p is None or isinstance(p, str) else json.dumps(p), "x") for f, n, p in rows], "feed string, file_no int, payload string, n string")


def changes(spark, rows, kind="report"):
    return sorted(tuple(r) for r in drift.changes(drift.compared(drift.file_summaries(frame(spark, rows), kind))).collect())


def consistent(spark, rows, kind="report"):
    """(schema, rows by (feed, file_no, record id)) of the consistent table."""
    df = frame(spark, rows).selectExpr("*", "monotonically_increasing_id() AS id")
    schema = drift.union_schema(cut(drift.compared(drift.file_summaries(df, kind), fields=True), "seen"))
    return schema, drift.consistent_table(df, kind, schema, "id")


def test_added_removed_renamed_retyped(spark):
    sites = ["a", "b", "c", "d"]
    one = [("f", 1, {"domain": s, "page_count": i + 3, "gone": "x" + s, "generated": f"2026-01-0{i + 1} 10:00", "flag": True}) for i, s in enumerate(sites)]
    two = [("f", 2, {"domain": s, "pages": i + 3, "meta": {"generated": f"2026-02-0{i + 1} 12:30"}, "fresh": [1], "flag": 1}) for i, s in enumerate(sites)]
    assert changes(spark, one + two) == [
        ("f", 2, "", "report.fresh", "added"), ("f", 2, "report.flag", "report.flag", "retyped"), ("f", 2, "report.generated", "report.meta.generated", "renamed"), ("f", 2, "report.gone", "", "removed"), ("f", 2, "report.page_count", "report.pages", "renamed"),
    ]


def test_order_is_by_number_and_gaps_tell_nothing(spark):
    rows = [("f", 4, {"domain": "a", "x": 1}), ("f", 1, {"domain": "a"}), ("f", 2, {"domain": "a", "y": 1}), ("g", 1, {"domain": "a"})]
    assert changes(spark, rows) == [("f", 2, "", "report.y", "added")]


def test_nulls_broken_payloads_and_majority(spark):
    rows = [("f", 1, {"domain": "a", "v": 1}), ("f", 1, None), ("f", 1, "{broken"), ("f", 1, "[1]"), ("f", 2, {"domain": "a", "v": "1"}), ("f", 2, {"domain": "b", "v": 2}), ("f", 2, {"domain": "c", "v": 3}), ("f", 3, {"domain": "a", "v": None})]
    assert changes(spark, rows) == [("f", 3, "report.v", "", "removed")]


def test_places_wherever_they_are(spark):
    rows = [("f", 1, {"local_results": [{"title": "t", "rating": 4}, None]}), ("f", 2, {"local_results": {"more": "x", "places": [{"title": "t", "rating": 4, "gps": {"lat": 1}}]}}), ("f", 2, {"local_results": None}), ("f", 2, {"organic_results": []})]
    assert changes(spark, rows, "place") == [("f", 2, "", "place.gps.lat", "added"), ("f", 2, "local_results", "local_results", "retyped")]


def test_consistent_table_merges_names_and_types(spark):
    rows = [("f", 1, {"domain": "a", "n": 1}), ("f", 1, {"domain": "b", "n": 2}), ("f", 2, {"domain": "a", "count": 1}), ("f", 2, {"domain": "b", "count": 2}), ("f", 3, {"domain": "a", "count": "many"})]
    schema, table = consistent(spark, rows)
    assert schema.columns == {"report.count": "string", "report.domain": "string"} and schema.names["report.count"] == ["report.count", "report.n"]
    assert sorted(r["report.count"] for r in table.collect()) == ["1", "1", "2", "2", "many"]


def test_a_rename_in_one_feed_hides_nothing_in_another(spark):
    sites = [("a", 11), ("b", 12), ("c", 13)]
    rows = [("f", 1, {"domain": s, "title": f"t{n}", "votes": n}) for s, n in sites] + [("f", 2, {"domain": s, "name": f"t{n}", "votes": n + 0.5}) for s, n in sites]
    rows += [("g", 1, {"domain": s, "title": f"x{n}", "name": f"y{n}", "votes": 2**70}) for s, n in sites] + [("f", 3, {"domain": "a", "name": "new", "title": "old"})]
    assert ("f", 2, "report.title", "report.name", "renamed") in changes(spark, rows)
    schema, table = consistent(spark, rows)
    column, other = ("report.name", "report.title") if "report.title" in schema.names["report.name"] else ("report.title", "report.name")
    got = sorted((r["feed"], r["file_no"], r[column], r[other], r["report.votes"], tuple(r["others"].values())) for r in table.collect())
    told = {"report.name": "y", "report.title": "x"}
    assert [g for g in got if g[0] == "g"] == [("g", 1, f"{told[column]}{n}", f"{told[other]}{n}", str(2**70), ()) for _, n in sites]
    both = {"report.name": "new", "report.title": "old"}
    assert [g[:4] for g in got if g[0] == "f"] == [("f", 1, f"t{n}", None) for _, n in sites] + [("f", 2, f"t{n}", None) for _, n in sites] + [("f", 3, both[column], None)]
    assert [g[5] for g in got if g[:2] == ("f", 3)] == [(both[other],)] and schema.columns["report.votes"] == "string"


def test_promotion_lattice():
    assert [drift.promoted(t) for t in (["integer"], ["integer", "number"], ["big", "integer"], ["boolean", "integer"], ["array", "string"], ["array"])] == ["integer", "number", "string", "string", "string", "array"]


def test_a_time_is_not_renamed_by_its_shape_alone(spark):
    stamp = lambda f, i: f"2026-0{f}-0{i} 10:0{i}"
    one = [("f", 1, {"domain": f"d{i}", "made": stamp(1, i)}) for i in range(1, 9)]
    # Two fields of the shape are new: which of them goes on can't be told.
    two = [("f", 2, {"domain": f"d{i}", "seen": stamp(2, i), "sent": stamp(3, i)}) for i in range(1, 9)]
    assert {c[4] for c in changes(spark, one + two)} == {"added", "removed"}
    # One is new, but hardly any record has it.
    few = [("f", 2, {"domain": f"d{i}", **({"seen": stamp(2, i)} if i == 1 else {"other": i})}) for i in range(1, 9)]
    assert ("f", 2, "", "report.seen", "added") in changes(spark, one + few)
    alone = [("f", 2, {"domain": f"d{i}", "seen": stamp(2, i)}) for i in range(1, 9)]
    assert changes(spark, one + alone) == [("f", 2, "report.made", "report.seen", "renamed")]


def test_booleans_that_agree_by_chance_are_no_rename(spark):
    one = [("f", 1, {"domain": f"d{i}", "a": i % 2 == 0}) for i in range(24)]
    two = [("f", 2, {"domain": f"d{i}", "b": i % 4 < 2}) for i in range(24)]
    assert {c[4] for c in changes(spark, one + two)} == {"added", "removed"}


def test_long_feeds_files_in_many_tasks_and_flushes(spark, monkeypatch):
    """Files 1 to 100 of a feed in any order over 16 partitions, one file with most rows; a change at each edge of a block."""
    rows = [("f", no, {"domain": f"d{i}", "k": i, **({"odd": "x"} if no % 32 in (0, 31) else {})}) for no in range(1, 101) for i in range(400 if no == 50 else 3)]
    want = sorted(("f", no, *c) for no in range(2, 101) for c in ([("", "report.odd", "added")] if no % 32 == 31 else [("report.odd", "", "removed")] if no % 32 == 1 else []))
    df = frame(spark, rows).repartition(16)
    for flush in (drift.FLUSH, 7):
        monkeypatch.setattr(drift, "FLUSH", flush)
        assert sorted(tuple(r) for r in drift.changes(drift.compared(drift.file_summaries(df, "report"))).collect()) == want


def test_odd_names_and_missing_numbers(spark):
    rows = [(None, 1, {"domain": "a"}), (None, 2, {"domain": "a", "x\ud800": 1}), ("f", None, {"domain": "a", "y": 1}), ("f", 1, {"domain": "a"})]
    got = changes(spark, rows)
    assert [(c[0], c[1], c[4]) for c in got] == [(None, 2, "added")]


def test_empty_table(spark):
    assert changes(spark, []) == []
    schema, table = consistent(spark, [])
    assert schema.columns == {} and table.count() == 0
