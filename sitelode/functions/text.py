"""Text, number and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verbs that call to action, fixed values.
CTA_VERBS = (
    "book", "try", "get", "shop", "learn", "download", "explore", "compare", "start", "discover", "find", "create", "build", "join", "buy", "order", "read", "see", "watch", "request", "claim",
    "save", "grow", "boost", "sign up", "subscribe",
)

#: Words that no key phrase holds, fixed values.
STOPWORDS = tuple(
    """a an and are as at be been being but by for from had has have he her here hers him his how i if in into is it its just me my no nor not now of off on once only or other our ours out over own re s same
    she should so some such t than that the their theirs them then there these they this those through to too under until up us very was we were what when where which while who whom why will with you your
    yours about above after again against all am any because before below between both did do does doing down during each few more most can cannot could would get got also may might must shall etc via per vs
    com www http https i'm it's we're you're don't your you they're new use using used make makes made one two three set let see way ways thing things lot like want need know""".split()
)

#: Scripts that write words without spaces, as a character class.
SPACELESS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: str | Column) -> Column:
    """White space runs as one space, trimmed; Unicode white space counts."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def word_count(c: str | Column) -> Column:
    t = collapse(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def trunc(c: str | Column, n: int) -> Column:
    """The trimmed text, cut to n characters with an ellipsis."""
    t = F.trim(_col(c))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, n)), F.lit("…")))


def has_cta(c: str | Column) -> Column:
    """Whether a verb of action stands in the text as a word, or begins it."""
    t = F.lower(_col(c))
    spaced = F.concat(F.lit(" "), t, F.lit(" "))
    out = F.lit(False)
    for verb in CTA_VERBS:
        out = out | spaced.contains(f" {verb} ") | t.startswith(f"{verb} ")
    return out


def tokens(c: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("([a-z0-9][a-z0-9'+-]*)"), 1)


def bind(value: Column, f) -> Column:
    """``f(value)`` with the value computed once: inside a lambda an unbound expression is computed for every element."""
    return F.transform(F.array(value), f)[0]


def _grams(words: Column, n: int, kind: str) -> Column:
    size = F.size(words)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.slice(words, i, n))).otherwise(F.array().cast(f"array<array<{kind}>>"))


def keyphrases(c: str | Column) -> Column:
    """Runs of one to three tokens without stop words: unigrams longer than two that aren't numbers, others of tokens longer than one."""
    stop = F.array(*map(F.lit, STOPWORDS))
    flagged = F.transform(tokens(c), lambda w: F.struct(w.alias("w"), (~F.array_contains(stop, w)).alias("ok"), w.rlike("^[0-9]+$").alias("num"), F.length(w).alias("len")))
    kind = "struct<w:string,ok:boolean,num:boolean,len:int>"

    def of(words: Column) -> Column:
        longer = lambda g, n: F.forall(g, lambda x: x["ok"] & (x["len"] > n))
        one = F.filter(_grams(words, 1, kind), lambda g: longer(g, 2) & ~g[0]["num"])
        two = F.filter(_grams(words, 2, kind), lambda g: longer(g, 1) & ~F.forall(g, lambda x: x["num"]))
        three = F.filter(_grams(words, 3, kind), lambda g: longer(g, 1))
        return F.transform(F.concat(one, two, three), lambda g: F.array_join(F.transform(g, lambda x: x["w"]), " "))

    return bind(flagged, of)


def counted(values: Column) -> Column:
    """(value, n) of each distinct value of an array, by one sort of it."""

    def of(s: Column) -> Column:
        size = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), size), lambda i: (i == 0) | (i == size) | (F.get(s, i - 1) != F.get(s, i)))
        pairs = bind(starts, lambda at: F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda j: F.struct(F.get(s, F.get(at, j)).alias("value"), (F.get(at, j + 1) - F.get(at, j)).alias("n"))))
        return F.when(size > 0, pairs)

    return bind(F.array_sort(values), of)


def shingles(c: str | Column, k: int = 6) -> Column:
    """Distinct runs of k words."""
    words = F.regexp_extract_all(F.lower(_col(c)), F.lit("([a-z0-9']+)"), 1)
    return F.array_distinct(bind(words, lambda w: F.transform(_grams(w, k, "string"), lambda g: F.array_join(g, " "))))


def any_shingles(c: str | Column, k: int = 6) -> Column:
    """Distinct runs of k words of any script, characters where a script has no spaces; a shorter text's words, or the text itself if it has none. Empty for null and blank."""
    t = collapse(c)
    words = F.regexp_extract_all(F.lower(_col(c)), F.lit(rf"([{SPACELESS}]|[\p{{L}}\p{{M}}\p{{N}}'&&[^{SPACELESS}]]+)"), 1)
    runs = lambda w: F.transform(_grams(w, k, "string"), lambda g: F.array_join(g, " "))
    return F.array_distinct(bind(words, lambda w: F.when(F.size(w) >= k, runs(w)).when(F.size(w) > 0, w).when(t != "", F.array(t)).otherwise(F.array().cast("array<string>"))))


def sentences(c: str | Column, least_words: int = 12) -> Column:
    """Sentences of so many words at least."""
    return F.filter(F.split(_col(c), r"(?<=[.!?])\s+"), lambda s: F.size(F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), " ")) >= least_words)


def finding_key(title: str | Column) -> Column:
    """A finding's title with its numbers masked."""
    return F.regexp_replace(_col(title), r"\d+(?:\.\d+)?", "#")


def visibility(position: str | Column) -> Column:
    """What one position adds to a visibility score, as an exact decimal so that sums don't depend on order."""
    p = _col(position)
    return F.when(p > 0, (F.lit(1.0) / p).cast("decimal(20,12)")).otherwise(F.lit(0).cast("decimal(20,12)"))


def round_even(c: Column) -> Column:
    """Half to even, to an integer."""
    return F.rint(c).cast("int")


def py_round(c: Column, digits: int) -> Column:
    """Rounds the exact binary value half to even, as a decimal expansion would show it."""
    exact = F.pandas_udf(lambda s: s.map(lambda x: None if x != x else round(x, digits)), "double")
    return exact(c.cast("double"))


def parse_time(c: str | Column) -> Column:
    """An ISO time in UTC; null if it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(_col(c), r"Z$", "+00:00"))


def date_windows(days: int, today: Column) -> tuple[Column, Column, Column, Column]:
    """(first, last) day of the window that ends yesterday, and of the one before it."""
    return F.date_sub(today, days), F.date_sub(today, 1), F.date_sub(today, 2 * days), F.date_sub(today, days + 1)


def health_flag(c: str | Column) -> Column:
    """True, false or null for yes, no or unknown in free text."""
    t = F.lower(F.trim(F.coalesce(_col(c), F.lit(""))))
    return F.when(t.rlike(r"^(not checked|unknown|n/?a|\?|-|–|)$") | t.startswith("not checked") | t.startswith("unknown"), None).when(t.rlike(r"^(no|none|missing|absent|not |✗|expired|off)"), False).otherwise(True)
