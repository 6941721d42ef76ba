"""Queries against counts over whole tables, without their SQL."""

import itertools
import unicodedata
from collections import Counter, defaultdict

from sitelode.plans import probes, site, texts


def column(spark, small, name, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{small}/{name}.parquet").select(*cols).collect()]


def _matrix(spark, small):
    """Every event is a probe: two URLs of an agent."""
    seen = defaultdict(list)
    for (i,) in sorted(column(spark, small, "events", "event_id")):
        status = probes.STATUSES[i % len(probes.STATUSES)]
        seen[i // 2].append("pay per crawl" if status == 402 else "challenged" if i % 11 == 0 else "ok" if 200 <= status <= 399 else "refused" if status in (401, 403, 406, 429, 503) else "no answer")
    for k, got in seen.items():
        bad = [v for v in got if v != "ok"]
        yield k % 40, f"agent-{k // 40}", probes.ROLES[k % 3], "ok" if not bad else bad[0] if len(bad) == len(got) else bad[0] + " on some pages"


def test_agent_matrix_reads_every_event(spark, small):
    got = probes.agent_matrix(spark, small).select("site", "agent", "role", "verdict").collect()
    assert Counter(map(tuple, got)) == Counter(_matrix(spark, small))


def test_agent_findings_follow_from_every_event(spark, small):
    sites = defaultdict(Counter)
    for site, _, role, verdict in _matrix(spark, small):
        sites[site]["ok" if verdict == "ok" else "other" if verdict not in ("refused", "challenged", "pay per crawl") else "train" if role == "train" else "answer"] += 1
    want = Counter()
    for site, c in sites.items():
        if not c["ok"]:
            want[site, "MEDIUM", "Site refuses every non-browser user-agent we tried"] += 1
        elif c["answer"]:
            want[site, "HIGH", "AI search / assistant crawlers are refused at the edge"] += 1
        elif c["train"]:
            want[site, "MEDIUM", "AI training crawlers are refused at the edge"] += 1
    got = probes.agent_findings(spark, small).select("site", "severity", "title").collect()
    assert Counter(map(tuple, got)) == want


def _shingle_set(text, k=5):
    """Runs of words or, in scripts without spaces, characters; a shorter text's words; the text itself if it has none."""
    words, word = [], ""
    for c in (text or "").lower() + " ":
        alone = any(unicodedata.name(c, "").startswith(x) for x in ("CJK UNIFIED", "HIRAGANA LETTER", "KATAKANA LETTER", "IDEOGRAPHIC ITERATION", "THAI"))
        if alone or not (unicodedata.category(c)[0] in "LMN" or c == "'"):
            words += [word] * bool(word) + [c] * alone
            word = ""
        else:
            word += c
    if len(words) >= k:
        return frozenset(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    return frozenset(words) or frozenset(filter(None, [" ".join((text or "").split())]))


def _near(docs):
    """doc_id, class_id, n_links of every document, and the similar classes."""
    groups = defaultdict(lambda: defaultdict(list))
    for i, text, lang, source in docs:
        groups[source or "", lang or ""][_shingle_set(text)].append(i)
    classes, pairs = Counter(), Counter()
    for (site, lang), sets in groups.items():
        ids, links = {s: min(x) for s, x in sets.items()}, Counter()
        for a, b in itertools.combinations(sorted(filter(None, ids), key=ids.get), 2):
            if (similarity := len(a & b) / len(a | b)) >= 0.8:
                pairs[site, lang, ids[a], ids[b], round(similarity, 6)] += 1
                links.update([a, b])
        classes.update((i, ids[s], links[s]) for s, x in sets.items() for i in x)
    return classes, pairs


DOCS = [
    (1, "Open daily from nine", "en", "a.test"), (2, "Open daily from nine!", "en", "a.test"), (3, "Open daily from nine please", "en", "a.test"), (4, None, "en", "a.test"), (5, " ", "en", "a.test"), (6, "?!", "en", "a.test"),
    (7, "Geöffnet über Ostern", "de", None), (8, "geöffnet über ostern", "de", None), (9, "Geschlossen über Ostern", "de", None), (10, "当店は毎日午前九時から午後六時まで営業しております。", "ja", "a.test"), (11, "当店は毎日午前九時から午後六時まで営業しております", "ja", "a.test"),
    (12, "当店は毎日午前九時から午後六時まで営業しておりますよ", "ja", "a.test"), (13, "定休日", "ja", None), (14, "定休日です", "ja", None), (15, None, None, None),
]


def test_every_document_has_a_class(spark, small, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in texts.near_duplicate_classes(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (3, 0), 4: (4, 0), 5: (4, 0), 6: (6, 0), 7: (7, 0), 8: (7, 0), 9: (9, 0), 10: (10, 1), 11: (10, 1), 12: (12, 1), 13: (13, 0), 14: (14, 0), 15: (15, 0)}
    for d in (str(tmp_path), small):
        classes, pairs = _near(column(spark, d, "documents", "doc_id", "text", "lang", "source"))
        assert Counter(map(tuple, texts.near_duplicate_classes(spark, d).select("doc_id", "class_id", "n_links").collect())) == classes
        assert Counter(map(tuple, texts.near_duplicate_pairs(spark, d).select("site", "lang", "a", "b", "similarity").collect())) == pairs


def test_affiliate_share_reads_every_link(spark, small):
    pages, tracked = defaultdict(set), defaultdict(lambda: defaultdict(set))
    for supplier, order, part in column(spark, small, "lineitem", "l_suppkey", "l_orderkey", "l_partkey"):
        pages[supplier].add(order)
        if part % 7 < 4:
            tracked[supplier]["network" if part % 7 == 1 else part].add(order)
    want = Counter((s, len(n), len(set().union(*(o for o in tracked[s].values() if len(o) <= len(n) * 0.5)))) for s, n in pages.items())
    got = site.affiliate_share(spark, small).select("site", "analysed", "affiliate_pages").collect()
    assert Counter(map(tuple, got)) == want


def test_head_parity_reads_every_capture(spark, small):
    worst = defaultdict(lambda: [0, 0])
    for order, line, part in column(spark, small, "lineitem", "l_orderkey", "l_linenumber", "l_partkey"):
        w = worst[order]
        w[line % 2 == 0] = max(w[line % 2 == 0], (200, 200, 405, 404)[part % 4])
    want = Counter()
    for order, (get, head) in worst.items():
        want[order % 200] += get == 200 and head >= 400
    assert {r["site"]: r["head_failures"] for r in probes.head_parity(spark, small).collect()} == dict(want)
