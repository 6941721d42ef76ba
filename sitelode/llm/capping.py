"""Caps the records of each contributor, the best ones by score kept.

Radix selection. Score and identifier are encoded as order-preserving bytes, in words of eight. For each
contributor above the cap, records are counted by contributor and byte, the byte that holds the cap-th record is
fixed, only the records that have it are looked at again, and their next byte is counted, until the remaining
records are all kept; every record is then kept or left out by comparing its words with its contributor's cutoff.
No contributor is ever sorted or gathered: each round is one map-side combined count of at most 256 rows a
contributor, over the records that agree so far. A byte that all of a contributor's records share needs no round.

Contributors with more than a ``BROADCAST_KEYS``-th of all rows number less than that: their cutoffs are broadcast,
so the records of a contributor that holds a third of the table stay where they are. The others, if the cap is below
that share, meet their cutoffs by a join on the contributor, each of them being bounded by that share.

Defined cases: records without contributor (null) are never left out; scores that are null come last, NaN right
before them; -0.0 is 0.0; ties go to the smaller id; ids may be numbers, dates, times, strings or binaries, texts
being ordered by their UTF-8 bytes, and by a 128-bit hash where their first ``TEXT_BYTES`` agree; repeated rows with
unique ids each count; an empty table gives no rows; a cap of 0 leaves out all records with a contributor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sitelode.session import cut

#: Cutoffs of contributors above this share of the rows (one in so many) are broadcast, at most as many (some 200 bytes each).
BROADCAST_KEYS = 10_000
#: Bytes of a text that are compared one by one.
TEXT_BYTES = 64
_SIGN = -(2**63)


def _unsigned(ordered: Column) -> Column:
    """The bits of a long, so that the order of longs is the order of their unsigned bytes."""
    return ordered.cast("long").bitwiseXOR(F.lit(_SIGN))


def words(value: Column, kind: T.DataType) -> list[Column]:
    """Longs whose unsigned bytes, one after the other, have the value's order; null is encoded as its type's zero."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        # The bits of a double have its order, those of negative ones the reverse. Adding 0.0 makes -0.0 the same as 0.0.
        bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(value.cast("double") + F.lit(0.0), F.lit(0.0))).cast("long")
        return [_unsigned(F.when(bits < 0, F.bitwise_not(bits).bitwiseXOR(F.lit(_SIGN))).otherwise(bits))]
    if isinstance(kind, T.DecimalType):
        # All digits, scale included, as 2 + 18 + 18 of them.
        digits = F.lpad(F.replace(F.abs(value).cast(T.DecimalType(38, kind.scale)).cast("string"), F.lit("."), F.lit("")), 38, "0")
        parts = [F.coalesce(F.substring(digits, a, n).cast("long"), F.lit(0)) for a, n in ((1, 2), (3, 18), (21, 18))]
        return [_unsigned(F.when(value < 0, -p).otherwise(p)) for p in parts]
    if isinstance(kind, (T.StringType, T.BinaryType)):
        data = F.coalesce(value.cast("binary"), F.lit(b""))
        word = lambda i: F.conv(F.rpad(F.hex(F.substring(data, 8 * i + 1, 8)), 16, "0"), 16, -10).cast("long")
        beyond = F.when(F.octet_length(data) > TEXT_BYTES, F.xxhash64(data)), F.when(F.octet_length(data) > TEXT_BYTES, F.xxhash64(F.lit(0x5EED), data))
        return [*(word(i) for i in range(TEXT_BYTES // 8)), _unsigned(F.least(F.octet_length(data), F.lit(TEXT_BYTES + 1))), *(F.coalesce(h, F.lit(0).cast("long")) for h in beyond)]
    if isinstance(kind, T.TimestampType):
        return [_unsigned(F.coalesce(F.unix_micros(value), F.lit(0)))]
    if isinstance(kind, T.DateType):
        return [_unsigned(F.coalesce(F.unix_date(value), F.lit(0)))]
    return [_unsigned(F.coalesce(value.cast("long"), F.lit(0)))]


#: Types whose null scores are the value after the last one, which takes no word of its own.
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def encoded(df: DataFrame, key: Column, score: Column, id_col: str, *, best: str = "low", ends: tuple | None = None) -> tuple[DataFrame, int]:
    """(k, w0, w1, ..., id) of each record, and the number of words: null scores last, then the score, then the id.

    ``ends`` are the least and the greatest score of all, if known.
    """
    kinds = df.select(score.alias("s"), F.col(id_col).alias("i")).schema
    own = df.select(key.alias("k"), score.alias("_s"), F.col(id_col).alias("id"))
    beyond = None if ends is None or ends[0] is None or not isinstance(kinds["s"].dataType, _WHOLE) else ends[1] + 1 if best == "low" else ends[0] - 1
    if beyond is not None and -(2**63) <= beyond < 2**63:
        (value,) = words(F.coalesce(F.col("_s").cast("long"), F.lit(beyond)), T.LongType())
        last = [F.bitwise_not(value) if best == "high" else value, *words(F.col("id"), kinds["i"].dataType)]
        return own.select("k", *(w.alias(f"w{i}") for i, w in enumerate(last)), "id"), len(last)
    value = [F.bitwise_not(w) if best == "high" else w for w in words(F.col("_s"), kinds["s"].dataType)]
    if best == "high" and isinstance(kinds["s"].dataType, (T.FloatType, T.DoubleType)):
        missing = F.when(F.col("_s").isNull(), 2).when(F.isnan("_s"), 1).otherwise(0)
    else:
        missing = F.when(F.col("_s").isNull(), 2).otherwise(0)
    last = [missing.cast("long"), *value, *words(F.col("id"), kinds["i"].dataType)]
    return own.select("k", *(w.alias(f"w{i}") for i, w in enumerate(last)), "id"), len(last)


def _byte(word: Column, b: int) -> Column:
    return F.shiftrightunsigned(word, 8 * (7 - b)).bitwiseAND(F.lit(255))


class _State:
    """What is known of each contributor's cutoff: a local relation of at most ``BROADCAST_KEYS`` rows, or a written table."""

    def __init__(self, df: DataFrame, *, few: bool) -> None:
        self.few = few
        self.table = df.toArrow() if few else None
        self.df = F.broadcast(df.sparkSession.createDataFrame(self.table, df.schema)) if few else cut(df, "cap-state")

    def with_column(self, name: str, value: Column) -> None:
        df = self.df.withColumn(name, value)
        self.df = F.broadcast(df) if self.few else df

    def varying(self, w: int, b: int) -> tuple[int, int]:
        """How many open contributors have records that differ in a byte, and how many are open."""
        if not self.few:
            differs = _byte(F.col(f"or{w}").bitwiseXOR(F.col(f"and{w}")), b) != 0
            return tuple(self.df.where("open").agg(F.count_if(differs), F.count("*")).first())
        is_open = self.table.column("open").to_numpy()
        bits = self.table.column(f"or{w}").to_numpy() ^ self.table.column(f"and{w}").to_numpy()
        return int(((bits >> 8 * (7 - b) & 255 != 0) & is_open).sum()), int(is_open.sum())


def cutoffs(rows: DataFrame, sizes: DataFrame, n_words: int, cap: int, *, few: bool) -> DataFrame:
    """k, c0, c1, ...: the last record kept of each contributor in ``sizes`` (k and the bits its words have in common)."""
    masks = [f"{m}{i}" for i in range(n_words) for m in ("or", "and")]
    fixed = [f"c{i}" for i in range(n_words)]
    zero = F.lit(0).cast("long")
    state = _State(sizes.select("k", F.lit(cap).cast("long").alias("need"), *(zero.alias(c) for c in fixed), F.lit(True).alias("open"), *masks), few=few)
    own = rows.drop("id").join(state.df.select("k"), "k")
    for w, b in ((w, b) for w in range(n_words) for b in range(8)):
        differ, is_open = state.varying(w, b)
        if not is_open:
            break
        place = lambda d: F.col(f"c{w}").bitwiseOR(F.call_function("shiftleft", d.cast("long"), F.lit(8 * (7 - b))))  # noqa: B023, E731
        if not differ:
            state.with_column(f"c{w}", F.when(F.col("open"), place(_byte(F.col(f"and{w}"), b))).otherwise(F.col(f"c{w}")))
            continue
        counts = own.groupBy("k", _byte(F.col(f"w{w}"), b).alias("d")).agg(F.count("*").alias("c"))
        up = Window.partitionBy("k").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
        chosen = counts.withColumn("upto", F.sum("c").over(up)).join(state.df.where("open"), "k").where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("c") < F.col("need")))
        need = F.col("need") - (F.col("upto") - F.col("c"))
        # All records of the byte are kept: the cutoff is the largest record that may have it.
        full = need == F.col("c")
        below = (1 << 8 * (7 - b)) - 1
        new = [
            F.col(c) if i < w else F.when(full, place(F.col("d")).bitwiseOR(F.lit(below))).otherwise(place(F.col("d"))) if i == w else F.when(full, F.lit(-1).cast("long")).otherwise(F.col(c))
            for i, c in enumerate(fixed)
        ]
        done = chosen.select("k", need.alias("need"), *(x.alias(c) for x, c in zip(new, fixed)), (~full).alias("open"), *masks)
        state = _State(state.df.where("not open").unionByName(done), few=few)
        if not state.varying(w, b)[1]:
            break
        agreeing = state.df.where("open").select("k", _byte(F.col(f"c{w}"), b).alias("_d"))
        own = cut(own.join(F.broadcast(agreeing) if few else agreeing, "k").where(_byte(F.col(f"w{w}"), b) == F.col("_d")).drop("_d"), "cap-rows")
    return state.df.select("k", *fixed)


def over_cap(df: DataFrame, key: Column, score: Column, id_col: str, *, max_rows: int | None = None, max_share: float | None = None, best: str = "low") -> DataFrame:
    """The ids of the records left out, as column ``id``.

    The best score is the lowest one, or the highest for ``best="high"``; it may be any number, a date, a time or a
    text. Give ``max_rows``, or ``max_share`` of all rows (rounded down).
    """
    n_rows, *ends = df.agg(F.count("*"), F.min(score), F.max(score)).first()
    cap = max_rows if max_rows is not None else int(n_rows * max_share + 1e-9)
    rows, n_words = encoded(df, key, score, id_col, best=best, ends=ends)
    if n_rows == 0:
        return rows.select("id").limit(0)
    if cap <= 0:
        return rows.where("k is not null").select("id")
    named = rows.where("k is not null")
    sizes = named.groupBy("k").agg(F.count("*").alias("n"), *(f(f"w{i}").alias(f"{m}{i}") for i in range(n_words) for m, f in (("or", F.bit_or), ("and", F.bit_and)))).where(F.col("n") > cap)
    signed = lambda prefix: F.struct(*(F.col(f"{prefix}{i}").bitwiseXOR(F.lit(_SIGN)).alias(f"x{i}") for i in range(n_words)))
    later = signed("w") > signed("c")
    hot = max(cap, n_rows // BROADCAST_KEYS)
    limits = F.broadcast(cutoffs(named, sizes.where(F.col("n") > hot), n_words, cap, few=True))
    if hot == cap:
        return named.join(limits, "k").where(later).select("id")
    # Contributors between the cap and the broadcast share.
    told = named.join(limits, "k", "left")
    rest = cut(sizes.where(F.col("n") <= hot), "cap-sizes")
    cold = told.where("c0 is null").drop(*(f"c{i}" for i in range(n_words)))
    of_rest = cold.join(cutoffs(cold, rest, n_words, cap, few=False), "k").where(later).select("id")
    return told.where(F.col("c0").isNotNull() & later).select("id").unionByName(of_rest)
