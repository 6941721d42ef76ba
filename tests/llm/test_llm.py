import datetime
import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sitelode.llm import capping, copies, frequency, packing, personal, queries, residue, tokens
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, small, name):
    same(spark, small, queries.QUERIES[name], queries.SQL[name])


def _rows(spark, small, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, small).collect()]


def test_queries_without_sql(spark, small):
    """What holds of their rows whatever the tables are."""
    documents = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    pages = {r["page_id"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    held, clean = ([r["page_id"] for r in _rows(spark, small, n)] for n in ("p5_found", "p5_clean_pages"))
    assert len(held) + len(clean) == len(pages) and set(held) | set(clean) == pages and held
    ids = {r["doc_id"]: r for r in _rows(spark, small, "p7_offsets")}
    assert set(ids) == set(documents) and all(len(r["ids"]) == len(r["starts"]) and r["starts"] == sorted(r["starts"]) and (r["starts"][:1] or [0]) == [0] for r in ids.values())
    assert {r["doc_id"]: r["ids"] for r in _rows(spark, small, "p7_ids")} == {i: r["ids"] for i, r in ids.items()}
    packed, fill = _rows(spark, small, "p8_containers"), {r["profile_id"]: r for r in _rows(spark, small, "p8_fill")}
    for profile in {r["profile_id"] for r in packed}:
        own = [r for r in packed if r["profile_id"] == profile]
        load, size = Counter(), Counter()
        for r in own:
            load[r["container_id"]] += r["n_tokens"]
            size[r["doc_id"]] += r["n_tokens"]
        assert size == {i: len(r["ids"]) for i, r in ids.items()} and max(load.values()) <= own[0]["capacity_tokens"]
        assert fill[profile]["n_containers"] == len(load) and fill[profile]["n_tokens"] == sum(load.values()) and fill[profile]["used_share"] > 0.6
    spans = defaultdict(list)
    for r in _rows(spark, small, "p9_found"):
        spans[r["doc_id"]].append((r["start_char"], r["end_char"], r["kind"]))
    for r in _rows(spark, small, "p9_redacted"):
        text, at, want = documents[r["doc_id"]], 0, ""
        for a, b, kind in sorted(spans[r["doc_id"]]):
            assert a >= at and b > a
            want, at = want + text[at:a] + f"[{kind.upper()}]", b
        assert r["text"] == (None if text is None else want + text[at:])
    assert set(queries.QUERIES) - set(queries.SQL) == {"p5_found", "p5_clean_pages", "p7_ids", "p7_offsets", "p8_containers", "p8_fill", "p9_found", "p9_redacted"}


# -- frequency


def brute_counts(rows, max_n):
    occ, rec = Counter(), defaultdict(set)
    for i, (g, terms) in enumerate(rows):
        for a in range(len(terms or [])):
            for n in range(1, max_n + 1):
                gram = tuple(terms[a : a + n])
                if len(gram) == n and None not in gram:
                    occ[g, gram] += 1
                    rec[g, gram].add(i)
    return {k: (c, len(rec[k])) for k, c in occ.items()}


@pytest.mark.parametrize("max_n", [1, 2, 4])
def test_ngrams_match_brute_force(spark, max_n):
    random.seed(max_n)
    rows = [(random.choice("xy"), [random.choice(["a", "b", "a b", "", None, "ä"]) for _ in range(random.randint(0, 7))]) for _ in range(300)] + [("x", None), ("x", ["a"] * 40), ("y", ["a"])]
    df = spark.createDataFrame(rows, "g string, terms array<string>").withColumn("t1", F.lit("clash"))
    got = {(r["group_name"], tuple(r[f"t{i + 1}"] for i in range(r["n"]))): (r["occurrences"], r["records"]) for r in frequency.ngram_counts(df, "terms", group="g", max_n=max_n).collect()}
    assert got == brute_counts(rows, max_n)


def test_ngrams_of_nothing_and_of_one_hot_term(spark):
    empty = spark.createDataFrame([], "terms array<string>")
    assert frequency.ngram_counts(empty, "terms").count() == 0
    hot = spark.range(20_000).select(F.array(F.lit("h"), F.col("id").cast("string")).alias("terms"))
    got = frequency.ngram_counts(hot, "terms", max_n=2).where("t1 = 'h'").groupBy("n").agg(F.count("*").alias("k"), F.sum("records").alias("r")).collect()
    assert {r["n"]: (r["k"], r["r"]) for r in got} == {1: (1, 20_000), 2: (20_000, 20_000)}


def test_long_records_and_small_combines(spark, monkeypatch):
    monkeypatch.setattr(frequency, "COMBINE_ROWS", 50)
    random.seed(8)
    rows = [("x", [random.choice("abcde") for _ in range(3_000)]), ("x", ["a"] * 2_000 + [None] + ["b"] * 500)] + [("x", [random.choice("ab")]) for _ in range(300)]
    got = {("x", tuple(r[f"t{i + 1}"] for i in range(r["n"]))): (r["occurrences"], r["records"]) for r in frequency.ngram_counts(spark.createDataFrame(rows, "g string, terms array<string>"), "terms", max_n=3).collect()}
    assert got == brute_counts(rows, 3)
    # A record of very many terms takes one sort, not a comparison of each with each.
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: (i % 1_000).cast("string")).alias("terms"))
    assert frequency.ngram_counts(long, "terms", max_n=2).where("n = 1 AND occurrences = 200 AND records = 1").count() == 1_000
    plan = frequency.ngram_counts(long, "terms")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_domain_key(spark):
    cases = {' "A.test"/ ': "a.test", "..": None, "": None, None: None, "ÄB.test.": "äb.test"}
    df = spark.createDataFrame([(c,) for c in cases], "d string")
    assert [r["k"] for r in df.select(frequency.domain_key("d").alias("k")).collect()] == list(cases.values())


# -- copies


def test_copies(spark):
    rows = [
        (1, 1, "https://www.a.test/X?b=2&a=1", "a.test"), (2, 1, "HTTPS://WWW.A.test/x/?a=1&b=2&", "A.test."), (3, 1, "https://a.test/x?a=1&b=2", "a.test"), (4, 2, "https://www.a.test/X?b=2&a=1", "a.test"), (5, 1, "https://www.a.test/x?a=1&b=2&c=3", "a.test"),
        (6, 1, "https://www.a.test/x?a=1&b=2?", "a.test"), (7, 1, "", "a.test"), (8, 1, "", "a.test"), (9, 1, "http://www.a.test/x?a=1&b=2", "a.test"),
    ]
    df = spark.createDataFrame(rows, "id int, serp int, url string, domain string")
    text = F.concat_ws("\x01", copies.canonical_text(F.col("domain")), copies.canonical_url(F.col("url")))
    hashed = copies.hashed(df, "id", [F.col("serp")], text)
    assert sorted((r["kept_id"], r["copy_id"]) for r in copies.copies_of(hashed, 9).collect()) == [(1, 2), (1, 6), (7, 8)]
    assert copies.collisions(copies.copy_groups(hashed)).count() == 0 and copies.copies_of(hashed.limit(0), 0).count() == 0


def test_a_hot_group_of_copies(spark):
    df = spark.range(30_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("x"), F.col("id"))).alias("t"))
    got = copies.copies_of(copies.hashed(df, "id", [], F.col("t")), 30_000)
    assert got.count() == 9_999 and got.select("kept_id").distinct().count() == 1


# -- capping


def beyond_caps(rows, cap, best="low"):
    """Brute force over (id, contributor, score): null scores last, NaN before them, ties by id."""
    out = set()
    for k in {k for _, k, _ in rows} - {None}:
        rank = lambda p: (2, 0) if p is None else (1, 0) if p != p else (0, p + 0.0 if isinstance(p, float) else p)
        own = sorted(((rank(p), i) for i, kk, p in rows if kk == k), key=lambda x: x[1])
        own.sort(key=lambda x: x[0] if best == "low" or x[0][0] else (0, -x[0][1]))
        out |= {i for _, i in own[cap:]}
    return out


@pytest.mark.parametrize("few,cap", [(10_000, 1), (10_000, 40), (4, 7), (1, 7)])
def test_caps_match_brute_force(spark, monkeypatch, few, cap):
    """Few: contributors above a quarter of the rows are hot, or none is."""
    monkeypatch.setattr(capping, "BROADCAST_KEYS", few)
    random.seed(cap)
    rows = [(i * 7919 - 1_000_000, random.choice(["a", "a", "a", "b", "c", None]), random.choice([None, 1, 2, 3, 300, 70_000])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, position int").withColumn("w0", F.lit("clash"))
    assert {r["id"] for r in capping.over_cap(df, F.col("k"), F.col("position"), "id", max_rows=cap).collect()} == beyond_caps(rows, cap)


SCORES = {
    "double": [0.93, 0.12, -0.5, 1e300, -1e-300, 0.0, -0.0, float("inf"), float("-inf"), float("nan"), None, 2.0**31, 2.0**32], "float": [0.5, -0.25, None, float("nan")], "long": [2**63 - 1, -(2**63), 0, 2**31, 2**32, -1, None],
    "decimal(38,10)": [Decimal("1.5"), Decimal("-1.5"), Decimal("12345678901234567890123456.0000000001"), Decimal("-0.0000000001"), Decimal("0.0000000001"), None], "decimal(5,2)": [Decimal("0.93"), Decimal("0.12"), Decimal("-9.99")],
    "date": [datetime.date(2024, 1, 2), datetime.date(1950, 5, 5), None],
}


@pytest.mark.parametrize("kind,best", [("double", "high"), ("double", "low"), ("float", "low"), ("long", "high"), ("decimal(38,10)", "low"), ("decimal(5,2)", "high"), ("date", "low")])
def test_scores_of_any_type(spark, kind, best):
    random.seed(3)
    rows = [(i, random.choice("aab"), random.choice(SCORES[kind])) for i in range(120)]
    df = spark.createDataFrame(rows, f"id int, k string, s {kind}").coalesce(1)
    assert {r["id"] for r in capping.over_cap(df, F.col("k"), F.col("s"), "id", max_rows=20, best=best).collect()} == beyond_caps(rows, 20, best)


def test_ids_of_text(spark):
    random.seed(4)
    ids = {"".join(random.choice("ab\0é😀") for _ in range(random.choice([0, 1, 3, 7, 8, 9]))) for _ in range(200)}
    rows = [(i, "k", 1) for i in sorted(ids, key=lambda x: x.encode())]
    df = spark.createDataFrame(random.sample(rows, len(rows)), "id string, k string, s int").coalesce(1)
    for cap in (5, 100):
        assert {r["id"] for r in capping.over_cap(df, F.col("k"), F.col("s"), "id", max_rows=cap).collect()} == {i for i, _, _ in rows[cap:]}
    # Beyond the compared bytes a hash decides; the number that is kept is exact.
    long = spark.range(50).select(F.concat(F.lit("x" * 200), F.col("id")).alias("id"), F.lit("k").alias("k"), F.lit(1).alias("s"))
    assert capping.over_cap(long, F.col("k"), F.col("s"), "id", max_rows=20).distinct().count() == 30


def test_small_caps_with_a_contributor_of_a_third(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("x"), F.col("id") % 5_000)).alias("k"), (F.xxhash64("id") % 100 / 7.0).alias("s"))
    out = capping.over_cap(df, F.col("k"), F.col("s"), "id", max_rows=3, best="high")
    df.createOrReplaceTempView("capped")
    want = spark.sql("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY k ORDER BY s DESC, id) AS rn FROM capped) WHERE rn > 3")
    assert out.exceptAll(want).count() == 0 and want.exceptAll(out).count() == 0


def test_caps_of_ties_empty_tables_and_shares(spark):
    df = spark.createDataFrame([(i, "a", 1) for i in range(10)], "id long, k string, p int")
    left = lambda **x: {r["id"] for r in capping.over_cap(df, F.col("k"), F.col("p"), "id", **x).collect()}
    assert left(max_rows=3) == set(range(3, 10)) and left(max_rows=0) == set(range(10)) and left(max_share=0.5) == set(range(5, 10)) and left(max_rows=99) == set()
    assert capping.over_cap(df.limit(0), F.col("k"), F.col("p"), "id", max_share=0.1).count() == 0


# -- residue

HOLD = [
    "{{title}} | X", "Visit ${city} in Y for the best z.", "X - [%brand%]", "%s", "%1$s | X", "[Your headline]", "Discover undefined near undefined.", "N/A | N/A", "[object Object] | X", "lorem sit elit dolor commodo dolor.", "LOREM IPSUM | X",
    "asdf asdf", "xxx summary xxx", "Hier title eintragen", "VOTRE TITLE ICI", "ESCRIBA AQUÍ SU TITLE", "TODO: write title", "404 - Page not found", "X - Error 404", "Fehler 404 - die Seite existiert nicht (ref 3)", "PÁGINA NO ENCONTRADA",
    "Just a moment...", "503 Service Unavailable | X", "Please enable JavaScript to view this page", "Bitte aktivieren Sie JavaScript. X", "Loading, please wait… (scripts must be on)", "A good sentence. Access Denied | X", "  site name  ", "ページが見つかりません",
]
FINE = [
    None, "", "   ", "What a stray {{title}} costs you in search | X", "Replace [square brackets] and {curly} tokens in your templates: a worked example from X.", "{Curly} Hair Studio", "[New] X winter hours", "100% Wool & 50% Linen | X", "%PROMO weeks at X: save 20%",
    "Room 404 - Escape Game in X", "404 steps to the X lighthouse", "Why a 404 page loses bookings: notes from X", "How X fixed “page not found” after a move", "Access denied? X explains robots rules", "JavaScript for beginners: a course at X", "Lorem & Ipsum Tattoo Parlour, X",
    "We printed “Lorem ipsum” on 12 tote bags.", "Null Point Kayak | X", "Undefined Gallery: opening night in X", "Just a Moment Café | X", "Under maintenance: how to announce a closure", "If the form says “session expired”, call us.", "Gateway Time-Out Spa X", "Error Bars Brewery - Tap Room X",
    "Our checklist covers JavaScript rendering, noscript notices and what a crawler sees when scripts are off.", "Use `{{name}}` where the name goes, as the manual of the tool says.",
]


def test_residue(spark):
    df = spark.createDataFrame([(t, True) for t in HOLD] + [(t, False) for t in FINE], "t string, hold boolean")
    got = df.select("t", "hold", residue.residue_kind(F.col("t")).alias("k")).collect()
    assert not [(r["t"], r["k"]) for r in got if (r["k"] is not None) != r["hold"]]
    assert residue.without_residue(df.limit(0), ["t"]).count() == 0
    inside = [o + ("field name " * n).strip() + c for n in (20, 500) for o, c in (("{{", "}}"), ("{{ a {b} ", "}}"), ("${", "}"), ("<%= ", " %>"), ("[[ a [b] ", "]]"), ("{% if a == '{' ", " %}"), ("*|", "|*"), ("%%", "%%"), ("[your ", "]"))]
    said = ["Fatal error: " + "module loader could not resolve path " * 9 + "on line 3", "JavaScript is required to " + "see the map and " * 20 + "book", "placeholdertexts placeholdertexts placeholdertexts"]
    code = ["Guide\n```\nHello {{title}}\n```\nand more about it", "How to print a name:\n    Dear {{first_name}},\nas the manual says", "<pre>" + "{{x}} and text " * 60 + "</pre> is how templates look", "Write `" + "{{a}} " * 40 + "` in the field"]
    got = spark.createDataFrame([(t,) for t in inside + said + code], "t string").select("t", residue.residue_kind(F.col("t")).alias("k")).collect()
    kinds = {r["t"]: r["k"] for r in got}
    assert all(kinds[t] == "placeholder" or t.startswith("[your") and kinds[t] == "filler" for t in inside) and all(kinds[t] for t in said) and not any(kinds[t] for t in code)
    long = spark.createDataFrame([("plain words " * 20_000 + "{{title}}",), ("plain words and other ones " * 20_000,)], "t string")
    assert [r["k"] for r in long.select(residue.residue_kind(F.col("t")).alias("k")).collect()] == ["placeholder", None]


# -- tokens


@pytest.fixture(scope="module")
def encoder():
    with open(tokens.VOCABULARY, "rb") as f:
        return tokens.Encoder(f.read())


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_tokens_equal_the_public_tokenizer(encoder, reference):
    random.seed(5)
    parts = ["'", "s", "t", "re", "ve", "ll", " ", "  ", "\n", "\t", "a", "Z", "1", "２", "!", "é", "　", "\xa0", "\x1c", "​", "日", "😀", "'s", "'ll", "\0", "\x85", "²", "Ⅷ", "<|endoftext|>"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(20_000)] + ["", " ", "x" * 5_000, "ab" * 3_000, "1" * 999, " " * 999]
    assert encoder.encode(texts) == reference(texts)


def test_tokens_of_every_code_point(encoder, reference):
    texts = [f"a{chr(c)}a {chr(c)}1" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    assert encoder.encode(texts) == reference(texts)


def test_offsets_and_round_trip(encoder):
    for t in ("", "don't  stop\n日本語 ok", "🏔️ x"):
        ids, offsets = encoder.encode_with_offsets(t)
        assert encoder.decode(ids) == t and len(ids) == len(offsets)
        assert all(t.encode()[a : a + len(encoder.bytes_of[i])] == encoder.bytes_of[i] for i, a in zip(ids, offsets))


def test_offsets_of_a_corpus(spark, encoder):
    texts = ["don't  stop\n日本語 ok", None, "", "🏔️ x", "a" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in tokens.encode_corpus(df, "id", "text", offsets=True).collect():
        assert (r["ids"], r["starts"]) == encoder.encode_with_offsets(texts[r["id"]] or "")
    assert {r["id"]: r["text"] for r in tokens.decode_corpus(tokens.encode_corpus(df, "id", "text"), "id").collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "id int, text string").withColumn("ids", F.lit("clash"))
    assert {r["id"]: len(r["ids"]) for r in tokens.encode_corpus(df, "id", "text").collect()} == {1: 0, 2: 0, 3: 2}
    assert tokens.token_counts(df.limit(0), "id", "text").count() == 0


# -- packing


def test_packing(spark):
    random.seed(6)
    rows = [(i, random.choice([0, None, 1, 5, 40, 99, 100, 101, 250, 1000])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, n long")
    out = packing.pack(df, "id", "n", {1: 100, 2: 1000}).collect()
    for profile, cap in ((1, 100), (2, 1000)):
        own = [r for r in out if r["profile_id"] == profile]
        load = Counter()
        pieces = defaultdict(list)
        for r in own:
            load[r["container_id"]] += r["n_tokens"]
            pieces[r["item_id"]].append((r["start_token"], r["n_tokens"]))
        assert max(load.values()) <= cap
        for i, n in rows:
            got = sorted(pieces[i])
            assert sum(x for _, x in got) == (n or 0) and (len(got) == 1 or (n or 0) > cap)
            assert [a for a, _ in got] == [sum(x for _, x in got[:k]) for k in range(len(got))]
        total = sum(n or 0 for _, n in rows)
        assert len(load) <= -(-total // cap) * 1.08 + 1
    assert packing.pack(df.limit(0), "id", "n", {1: 10}).count() == 0 and packing.pack(df, "id", "n", {}).count() == 0


def test_items_without_size_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 100)
    df = spark.range(5_000).select("id", F.when(F.col("id") % 1_000 == 1, 7).when(F.col("id") % 2 == 0, None).otherwise(0).cast("long").alias("n"))
    out = packing.pack(df, "id", "n", {1: 10})
    assert out.count() == 5_000 and out.where("n_tokens = 7").count() == 5 and out.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).where("n > 10").count() == 0
    assert out.select("container_id").distinct().count() > 40


def test_windows_of_a_block():
    random.seed(2)
    sizes = [random.randint(1, 60) for _ in range(300)]
    windows = packing.pack_block(sizes, 100)
    assert sorted(i for w in windows for i in w) == list(range(300)) and max(sum(sizes[i] for i in w) for w in windows) <= 100
    assert len(windows) <= -(-sum(sizes) // 100) * 1.1


def test_differencing_is_near_equal():
    windows = packing.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(i for w in windows for i in w) == list(range(5)) and abs(sum([8, 7, 6, 5, 4][i] for i in windows[0]) - 15) <= 1
    assert packing.differencing([3], 3) == [[0], [], []]


# -- personal information

NAMES = [(f"{a}{b}", "given") for a in ("Fen", "Zor", "Vik", "Nel") for b in ("mir", "lo", "sa", "wyn")] + [(f"{a}{b}", "family") for a in ("Hol", "Arn", "Bex", "Tav") for b in ("hagen", "rick", "ley", "wick")]


def spans(text):
    gazetteer = personal.Gazetteer(NAMES)
    return {(k, text[a:b]) for k, a, b, _, _ in personal.candidates(text, gazetteer)}


@pytest.mark.parametrize(
    "text,want",
    [
        ("Write to a.b+c@mail.x.test.", ("email", "a.b+c@mail.x.test")), ("Courriel : marez [at] x-y.co [dot] test", ("email", "marez [at] x-y.co [dot] test")), ("Q AT X DOT TEST now", ("email", "Q AT X DOT TEST")), ("邮箱：s＠l.test。", ("email", "s＠l.test")),
        ("Call +44 (0)7700 900172.", ("phone", "+44 (0)7700 900172")), ("(303) 555-0152 x", ("phone", "(303) 555-0152")), ("Tel. 030/23125227", ("phone", "030/23125227")), ("電話：＋1 303‑555‑0164。", ("phone", "＋1 303‑555‑0164")), ("Phone: 0049 30 23125-160 ext. 12.", ("phone", "0049 30 23125-160")),
        ("ID card #43-6959-137-KHi", ("id_number", "43-6959-137-K")), ("n° de sécurité sociale 9 15 13 00 496 719.", ("id_number", "9 15 13 00 496 719")), ("DNI 92064825O画像", ("id_number", "92064825O")), ("passport ZZ 924318.", ("id_number", "ZZ 924318")),
        ("Find us at Flat 2, 67 Sluice Terrace, Kestrel Bay ZX12 6ZT.", ("address", "Flat 2, 67 Sluice Terrace, Kestrel Bay ZX12 6ZT")), ("Address: 85 Tannery Lane\nLisseval\nXZ16 6QX\n", ("address", "85 Tannery Lane\nLisseval\nXZ16 6QX")),
        ("go to 580 W Tannery Street, Suite 40, Corvane, ZZ 00572.", ("address", "580 W Tannery Street, Suite 40, Corvane, ZZ 00572")), ("Adresse: Ziegelplatz 79b, 00217 Niederfurt.", ("address", "Ziegelplatz 79b, 00217 Niederfurt")),
        ("Adresse : 109 bis rue des Tilleuls, 00467 Saint-Orbin.", ("address", "109 bis rue des Tilleuls, 00467 Saint-Orbin")), ("Dirección: Plaza del Molino núm. 68, bajo, 00492 Arenales del Sur.", ("address", "Plaza del Molino núm. 68, bajo, 00492 Arenales del Sur")),
        ("Thanks to Dr. Zorlo van Holrick for", ("person", "Zorlo van Holrick")), ("cc: Bexley, Nelsa; x", ("person", "Bexley, Nelsa")), ("作者C. Arnwick，x", ("person", "C. Arnwick")), ("Dear Fenmir!", ("person", "Fenmir")), ("ASK VIKWYN B. TAVLEY-ARNRICK ABOUT", ("person", "VIKWYN B. TAVLEY-ARNRICK")),
    ],
)
def test_spans(text, want):
    assert want in spans(text)


@pytest.mark.parametrize("text", ["Meet at the corner of Quarry Street, by the fountain.", "Coordinates 6.190, -38.1835.", "Follow us as @x_y for times.", "The test server answers at 192.0.2.4, port 8026.", "Open 4:00-41:30, last entry 2015-01.", "user@{{domain}}", "SKU 62-2900-15, batch 30563323."])
def test_no_spans(text):
    assert not spans(text)


def test_found_spans_are_true_and_texts_are_redacted(spark):
    random.seed(7)
    given, family = [n for n, p in NAMES if p == "given"], [n for n, p in NAMES if p == "family"]
    rows, truth = [], set()
    for i in range(400):
        g, f = random.choice(given), random.choice(family)
        t, pieces = random.choice(
            [
                (f"Author: {g} {f} | updated weekly. Call +44 20 7946 {i:04d}.", [("person", f"{g} {f}"), ("phone", f"+44 20 7946 {i:04d}")]), (f"The {f} Award went to X in 2020.", []), (f"Order no. 2{i % 10}1-728-3703 was placed.", []), (f"Dear {g},\nthe page is slow.", [("person", g)]),
                (f"{f} & Sons Carpets rank above {f} Optics.", []), (f"Contact: {g.lower()}.{f.lower()}@x.test or SSN 000-41-{i:04d}.", [("email", f"{g.lower()}.{f.lower()}@x.test"), ("id_number", f"000-41-{i:04d}")]),
            ]
        )
        rows.append((i, t))
        truth |= {(i, k, t.index(p), t.index(p) + len(p)) for k, p in pieces}
    rows += [(1000, None), (1001, ""), (1002, "   "), (1003, "plain")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("kind", F.lit("clash"))
    names = spark.createDataFrame(NAMES, "name string, name_part string")
    found = personal.find(df, "id", "text", names)
    got = {tuple(r) for r in found.collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got & truth) >= 0.97 * len(got)
    clean = {r["id"]: r["text"] for r in personal.redact(df, "id", "text", names).collect()}
    assert len(clean) == len(rows) and clean[1000] is None and clean[1003] == "plain"
    for i, t in rows:
        want, at = "", 0
        for a, b, kind in sorted((a, b, k) for j, k, a, b in got if j == i):
            want += t[at:a] + f"[{kind.upper()}]"
            at = b
        assert clean[i] == (None if t is None else want + t[at:])


def test_estimation_finds_the_bad_labelers():
    """Three informative labelers are the least that tell their own reliabilities; two of five guess."""
    import numpy as np

    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) * 2 - 1 for p in (0.92, 0.88, 0.85, 0.5, 0.5)], 1)
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = personal.estimate(patterns.astype(float), counts.astype(float))[back.ravel()]
    majority = ((votes.sum(1) > 0) == truth).mean()
    assert ((p > 0.5) == truth).mean() > majority + 0.05


def test_no_texts_no_names(spark):
    df = spark.createDataFrame([], "id int, text string")
    none = spark.createDataFrame([], "name string, name_part string")
    assert personal.find(df, "id", "text", none).count() == 0 and personal.redact(df, "id", "text", none).count() == 0


def found(spark, rows, names=()):
    """The pieces that are found in (text, ...) rows: Counter of (kind, piece)."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, text string").coalesce(2)
    got = personal.find(df, "id", "text", spark.createDataFrame(list(names), "name string, name_part string")).collect()
    return {(r["id"], r["kind"], rows[r["id"]][r["start_char"] : r["end_char"]]) for r in got}


def test_mostly_false_candidates(spark):
    """Of each kind one candidate in ten is true; the others are samples, places spoken of, numbers of other kinds and prizes."""
    random.seed(9)
    rows, want = [], set()
    for i in range(600):
        kind, n = i % 5, f"{random.randint(100, 999)}"
        g, f = (random.choice([x for x, p in NAMES if p == part]) for part in ("given", "family"))
        if i % 50 < 5:
            piece, text = (
                ("email", f"{g.lower()}.{f.lower()}@mail{n}.test", "Contact: {}"), ("id_number", f"{n}-45-6{n}", "my SSN: {}."), ("address", f"{n} Mill Lane, Oldport ZX1 2AB", "Address: {}\n"),
                ("phone", f"+44 20 7946 0{n}", "Call {} today"), ("person", f"{g} {f}", "Author: {} | notes"),
            )[kind][1:]
            want.add((len(rows), ("email", "id_number", "address", "phone", "person")[kind], piece))
            rows.append(text.format(piece))
        else:
            rows.append(
                (
                    f"the remote is ssh://user@build{n}.test/x", f"Example of the order tax number 11111{n[0] * 4} EUR", f"photo near the corner of {n} Mill Street, Oldport", f"SKU {n} 555 0{n}, batch 4", f"The {f} Award of {n}",
                )[kind]
            )
    got = found(spark, rows, NAMES)
    for kind in personal.KINDS:
        mine, true = {x for x in got if x[1] == kind}, {x for x in want if x[1] == kind}
        assert len(mine & true) >= 0.97 * len(true) and len(mine & true) >= 0.97 * len(mine), (kind, sorted(mine - true)[:3], sorted(true - mine)[:3])


def test_names_without_a_gazetteer_and_in_other_scripts(spark):
    rows = ["Dear Xandria Quent,\nthe page", "Author: Wulfgang Tripp | x", "联系人：王小明，电话", "李娜女士您好", "担当：山田 太郎\n", "田中太郎さんが担当します", "Автор: Иван Петрович Сидоров", "Уважаемый Николай, спасибо", "お客様へ。皆様", "联系人：客服部", "The harbour opens at nine."] * 5
    got = {(k, p) for _, k, p in found(spark, rows)}
    assert got == {("person", p) for p in ("Xandria Quent", "Wulfgang Tripp", "王小明", "李娜", "山田 太郎", "田中太郎", "Иван Петрович Сидоров", "Николай")}


def test_a_gazetteer_of_any_size(spark, monkeypatch):
    rows = [f"Author: {g} {f} | notes on {f} Optics" for g in ("Fenmir", "Zorlo") for f in ("Holhagen", "Arnwick")] * 4 + ["", None]
    few = found(spark, [r or "" for r in rows], NAMES)
    monkeypatch.setattr(personal, "MOST_NAMES", 20)
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    names = spark.createDataFrame(NAMES, "name string, name_part string")
    got = {(r["id"], r["kind"], rows[r["id"]][r["start_char"] : r["end_char"]]) for r in personal.find(df, "id", "text", names).collect()}
    assert got == few and len(got) == 16
    assert personal.redact(df, "id", "text", names).where("text like 'Author: [PERSON] | notes on %'").count() == 16


#: Names of each part by affixes, with letters that lower case and case folding tell apart, apostrophes and other scripts.
MANY_NAMES = [*NAMES, ("Groß", "family"), ("Weißmann", "family"), ("D'angelo", "family"), ("王小明", "family"), ("Straß", None), ("Fenmir", "given"), ("Fenmir", "family"), ("", "given"), (None, "family")]
ODD_TEXTS = [
    "Author: Fenwyn Holley | x", "Author: Zorsa Tavwick-Bexrick, said", "FENMIR GROSS and Fenmir GROß, Fenmir GROẞ", "Dear Nelhagen,\nthanks", "Dr. D'angelo said", "Dr. O'Dall'a'Monte", "Dr. D'angelo'S", "Weissmann, Viklo (N. Arnley)", "联系人：王小明，电话",
    "Fenlo d'Arnhagen wrote", "NELſA HOLRICK", "Vikmir de la Bexhagen; M. Weißmann", "Owner: Velmir Sonwick", "Dear Strass,\n", "İzorlo Holley ŉ Zorlo", "Автор: Иван Петрович Сидоров", "", "   ", None,
]


def test_words_asked_of_the_gazetteer():
    class Heard(personal.Gazetteer):
        heard = set()

        def kind(self, word):
            self.heard.add(word.casefold())
            return super().kind(word)

    names = [(n, p) for n, p in MANY_NAMES if n]
    for text in filter(None, ODD_TEXTS):
        whole, told = Heard(names), personal.Gazetteer([])
        whole.heard = set()
        want = personal.candidates(text, whole)
        assert whole.heard <= personal.asked(text)
        told.tell({w: bits for w in personal.asked(text) if (bits := personal.Gazetteer(names).kind(w))})
        assert personal.candidates(text, told) == want


def test_a_joined_gazetteer_is_known_whole(spark, monkeypatch):
    """Names, and what they are made of, from all entries, whether they are sent or joined; under repeated ids and without one."""
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(ODD_TEXTS * 2)]
    df = spark.createDataFrame(rows, "id int, text string")
    names = spark.createDataFrame(MANY_NAMES * 2, "name string, name_part string")

    def proposed():
        return Counter((r["_id"], r["kind"], r["start_char"], r["end_char"], r["pattern"], tuple(r["features"])) for r in personal._found(df, "id", "text", names)[1].collect())

    sent = proposed()
    assert sum(sent.values()) > 20
    for most in (3, 20):
        monkeypatch.setattr(personal, "MOST_NAMES", most)
        assert proposed() == sent


def test_the_classifier_is_trained_on_all_spans(spark, monkeypatch):
    import numpy as np

    n = 30_000
    codes = [personal._code("phone", form, v) for form, v in (("abroad", (1, 1, 1, 1, 0)), ("pairs", (0, 0, -1, 0, -1)), ("national", (0, 0, 1, 0, 0)))]
    features = [F.pmod(F.xxhash64("id", F.lit(j)), F.lit(7 + 40 * j)).cast("int") for j in range(personal.N_FEATURES)]
    pattern = F.element_at(F.array(*map(F.lit, codes)), (F.pmod(F.xxhash64("id"), F.lit(3)) + 1).cast("int"))
    spans = spark.range(n).select(F.col("id").alias("_id"), F.lit("phone").alias("kind"), F.lit(0).alias("start_char"), F.lit(5).alias("end_char"), pattern.alias("pattern"), F.array(*features).alias("features"))
    spans = personal.cut(spans, "spans")
    rows = spans.select("pattern", "features").collect()

    def brute(rounds):
        odds = personal.pattern_odds({"phone": dict(Counter(r[0] for r in rows))})["phone"]
        x, y = np.array([r[1] for r in rows]), 1 / (1 + np.exp(-np.array([odds[r[0]] for r in rows])))
        w, scale, base = np.zeros(personal.WEIGHTS), np.full(personal.WEIGHTS, 1e-6), np.log(y.mean() / (1 - y.mean()))
        for _ in range(rounds):
            grad = np.bincount(x.ravel(), np.repeat(1 / (1 + np.exp(-base - w[x].sum(1))) - y, x.shape[1]), personal.WEIGHTS) / n + 2.0 / n * w
            scale += grad**2
            w -= 0.3 * grad / np.sqrt(scale)
        return w

    assert np.allclose(personal._decision(spans).weights["phone"], brute(150), atol=1e-6)
    monkeypatch.setattr(personal, "HELD_SPANS", 0)
    monkeypatch.setattr(personal, "ROUNDS", 5)
    assert np.allclose(personal._decision(spans).weights["phone"], brute(5), atol=1e-6)


def test_halves_of_the_texts_decide_alike(spark, small):
    """A span has the same decision from the whole, and from one half of the texts."""
    d = small.replace("sf0.001", "sf0.01")
    df, names = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/name_lexicon.parquet")
    whole = {tuple(r) for r in personal.find(df, "doc_id", "text", names).collect()}
    half = {tuple(r) for r in personal.find(df.where("doc_id % 2 = 0"), "doc_id", "text", names).collect()}
    flips = {x for x in whole if x[0] % 2 == 0} ^ half
    assert len(half) > 200 and len(flips) <= 0.005 * len(half)


def test_long_texts_with_many_spans():
    text = "Author: Fenmir Holhagen, call +44 20 7946 0123 or a@b.test; " * 4_000
    got = personal.candidates(text, personal.Gazetteer(NAMES))
    assert Counter(k for k, *_ in got) == {"person": 4_000, "phone": 4_000, "email": 4_000}
