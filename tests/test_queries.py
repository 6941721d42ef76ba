import json
from collections import Counter, defaultdict

import pytest

from sitelode.operators import drift, rules
from sitelode.plans import records, registry, site
from sitelode.sources.json_payloads import whole_value
from tests.oracle import same

CHECKED = [(name, m) for m in registry.MODULES for name in m.SQL]


@pytest.mark.parametrize("name,module", CHECKED, ids=[n for n, _ in CHECKED])
def test_sql(spark, small, name, module):
    same(spark, small, module.QUERIES[name], module.SQL[name])


def test_only_these_have_no_sql():
    without = {n for m in registry.MODULES for n in m.QUERIES if n not in m.SQL}
    assert without == {"p6_found", "p6_places", "p6_reports", "html_rule_findings", "serp_payload_rows", "serp_features"}


def _payloads(spark, small, name):
    for r in spark.read.parquet(f"{small}/{name}.parquet").select("feed", "file_no", "payload").collect():
        ok, value = whole_value(r["payload"])
        yield r["feed"], r["file_no"], value if ok else None


def _by_file(spark, small):
    """Fields of each file with their counted types, and how many records there are, by brute force."""
    fields, files, records_of = defaultdict(Counter), defaultdict(set), Counter()
    for name, kind in (("serp_raw", "place"), ("audit_reports", "report")):
        for feed, no, value in _payloads(spark, small, name):
            files[feed].add(no)
            for prefix, _, record in drift.RECORDS[kind](value) if value is not None else ():
                records_of[kind] += bool(prefix)
                for field, x in drift.leaves(record, prefix) if prefix else record.items():
                    t = drift.type_of(x)
                    fields[feed, no][field, "number" if t in drift.NUMBERS else t] += 1
    return fields, files, records_of


def test_changes_account_for_every_field(spark, small):
    fields, files, _ = _by_file(spark, small)
    got = defaultdict(list)
    for r in records.p6_found(spark, small).collect():
        got[r["feed"], r["file_no"]].append((r["old_field"], r["new_field"], r["change"]))
    top = lambda c, f: min(((-n, drift.GENERALITY.index(t), t) for (x, t), n in c.items() if x == f))[2]
    seen = 0
    for feed, numbers in files.items():
        for no in numbers:
            own = got.pop((feed, no), [])
            if no - 1 not in numbers:
                assert not own
                continue
            old, new = ({f for f, _ in fields[feed, k]} for k in (no - 1, no))
            assert sorted(a for a, _, c in own if c in ("removed", "renamed")) == sorted(old - new) and sorted(b for _, b, c in own if c in ("added", "renamed")) == sorted(new - old)
            assert sorted(a for a, _, c in own if c == "retyped") == sorted(f for f in old & new if top(fields[feed, no - 1], f) != top(fields[feed, no], f))
            seen += len(own)
    assert not got and seen


def test_consistent_tables_hold_every_record_and_value(spark, small):
    fields, _, records_of = _by_file(spark, small)
    for query, kind in ((records.p6_places, "place"), (records.p6_reports, "report")):
        rows = [r.asDict() for r in query(spark, small).collect()]
        assert len(rows) == records_of[kind]
        keys = {"record_id", "feed", "file_no", "record_no", "others"}
        held = sum(v is not None for r in rows for k, v in r.items() if k not in keys) + sum(len(r["others"] or {}) for r in rows)
        values = sum(n for c in fields.values() for (f, _), n in c.items() if f.startswith(kind + "."))
        # Values that their column's type doesn't admit are the only ones without a place.
        assert values * 0.98 <= held <= values


def test_payload_rows(spark, small):
    rows = site.serp_payload_rows(spark, small).collect()
    own = defaultdict(Counter)
    for r in rows:
        own[r["raw_id"]][r["kind"]] += 1
    want = {}
    for r in spark.read.parquet(f"{small}/serp_raw.parquet").collect():
        ok, value = whole_value(r["payload"])
        text = json.dumps(value) if ok else ""
        want[r["raw_id"]] = (ok, text.count('"type": "organic"'), len(value.get("organic_results") or []) if ok and isinstance(value, dict) and isinstance(value.get("organic_results"), list) else 0)
    assert set(own) <= set(want)
    for i, (ok, items, results) in want.items():
        assert own[i]["organic"] <= items + results and (ok or own[i] == Counter({"error": 1}))
    features = {(r["domain"], r["feature"]): r["n"] for r in site.serp_features(spark, small).collect()}
    assert sum(features.values()) == sum(r["kind"].startswith("feature:") and bool(r["domain"]) for r in rows) > 0


def test_parsed_pages_break_only_page_rules(spark, small):
    found = site.html_rule_findings(spark, small).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    fixed = {r[5] for r in rules.RULES if r[0] == rules.P and not r[5].startswith("=")}
    assert {r["title"] for r in found if not r["title"].startswith(("Client error", "Server error"))} <= fixed
    unreachable = {r["page_id"] for r in found if r["title"] == "Page unreachable"}
    assert {r["page_id"] for r in found if r["title"] == "Missing title tag"} == {i for i, p in pages.items() if not (p["title"] or "").strip() and i not in unreachable}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_entry_survives_a_broken_subpackage(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "sitelode.llm", None)
    assert "domain_tally" in __spark_entry__.queries() and not any(n.startswith("p9") for n in __spark_entry__.queries())
