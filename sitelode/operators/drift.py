"""Schema drift between the files of a feed: one consistent table and a list of changes.

1. Each payload's fields are read where the payload is read (in parallel) and folded there, over all batches of
   the task, into one summary for each file: how often each field has each type, and a coordinated sample of
   (entity, value) pairs, the ``SAMPLE`` ones whose entities hash lowest. A task hands on what it has folded when
   that reaches ``FLUSH`` pairs.
2. Summaries merge by sums and by keeping the lowest again, whatever their order. They meet in one exchange: a
   feed's files go to blocks of consecutive numbers, sorted, and a pass over the sorted rows merges a file's
   summaries as they come and compares it with the file before it. Only the last file of a block goes to two
   blocks. A file or a feed that holds most rows is streamed, never gathered.
3. The type of a field in a file is the one most of its values have; across files types are folded through the
   promotion lattice (:func:`promoted`).
4. A field that is gone and one that is new are one renamed field if they have one type and their content goes on:
   the same entities carry the same values more often than the values' frequencies alone would make them, or, where
   no entity is in both files, the values are the same. Values that differ by nature from file to file, such as
   times, are taken up again if both fields have one fixed shape, stand in the same share of records, and no other
   field of that shape is gone or new.

Defined cases: null, broken and foreign payloads hold no field, yet their file exists; null members and null
elements don't count; a tie between types goes to the more general one; a change is reported only where the file
before it exists; files without a number have no place in the order; repeated deliveries change nothing but
counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelode.session import cut
from sitelode.sources.json_payloads import whole_value

#: Types from the most general one down; ties between counts go to the first.
GENERALITY = ("string", "array", "object", "number", "boolean")
#: Pairs in the sample of a field, and values in that of its values.
SAMPLE, VALUES = 24, 8
#: A renamed field's values agree at least so much more often than by chance, as a share of what chance leaves.
AGREEMENT = 0.3
#: Where no entity is in both files, so many of the values are the same.
VALUE_SHARE = 0.5
#: A fixed shape tells a field if it has this many characters, and this many digits.
SHAPE_CHARS, SHAPE_DIGITS = 10, 6
#: ... and this share of the strings; and fields of one shape stand in shares of the records that differ by no more than this.
SHAPE_SHARE, RECORD_SHARE = 0.5, 0.25
#: Pairs that a task folds before it hands its summaries on.
FLUSH = 500_000
#: Consecutive files of a feed in a block.
BLOCK_FILES = 32


def type_of(value) -> str:
    """string, boolean, array, object, or a number's kind: integer (64 bits), big or number."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer" if -(2**63) <= value < 2**63 else "big"
    if isinstance(value, float):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"


NUMBERS = ("integer", "big", "number")


def promoted(types: Iterable[str]) -> str:
    """The least type that holds all of them: integer below number, all else below string; digits of a big number only a string keeps."""
    return reduce(lambda a, b: a if a == b else "number" if {a, b} == {"integer", "number"} else "string", types)


def leaves(node: dict, prefix: str) -> Iterator[tuple[str, object]]:
    """(dotted name, value) of the non-null members that are not objects, those of objects included."""
    stack = [(node, prefix)]
    while stack:
        at, pre = stack.pop()
        for name, value in at.items():
            if isinstance(value, dict):
                stack.append((value, f"{pre}{name}."))
            elif value is not None:
                yield f"{pre}{name}", value


def report_records(value) -> Iterator[tuple[str, str, dict]]:
    """(prefix, entity, record) of an audit report: the report itself."""
    if isinstance(value, dict):
        yield "report.", str(value.get("domain") or value.get("url") or ""), value


def place_records(value) -> Iterator[tuple[str, str, dict]]:
    """(prefix, entity, record) of ``local_results`` and of each place in it.

    ``local_results`` is a list of places or an object with such a list; it counts as a record of its own,
    whose one member holds its type.
    """
    for result in value if isinstance(value, list) else [value]:
        if not isinstance(result, dict):
            continue
        held = result.get("local_results")
        if not isinstance(held, (list, dict)):
            continue
        yield "", "", {"local_results": held}
        if isinstance(held, list):
            places = held
        elif isinstance(held.get("places"), list):
            places = held["places"]
        else:
            places = [p for v in held.values() if isinstance(v, list) for p in v]
        for place in places:
            if isinstance(place, dict):
                yield "place.", str(place.get("place_id") or place.get("title") or ""), place


RECORDS = {"report": report_records, "place": place_records}


_DIGIT, _LETTER = re.compile(r"\d"), re.compile(r"[^\W\d_]")


def _hash(text: str) -> int:
    """31 bits."""
    return xxhash.xxh32_intdigest(text) >> 1


def _shape(value: str) -> int:
    """A hash of the value's pattern (digits as 9, letters as a); 0 if it is too plain to tell a field."""
    if len(value) < SHAPE_CHARS:
        return 0
    pattern, digits = _DIGIT.subn("9", value)
    return _hash(_LETTER.sub("a", pattern)) + 1 if digits >= SHAPE_DIGITS else 0


def _value_hash(kind: str, value) -> int:
    if kind == "string":
        return _hash(value)
    if kind == "number" and value.is_integer():
        value = int(value)
    return _hash(json.dumps(value, sort_keys=True) if kind == "array" else repr(value))


def _lowest(pairs: set, n: int) -> set:
    return pairs if len(pairs) <= n else set(heapq.nsmallest(n, pairs))


class _Field:
    """What is known of one field of one file. All of it merges in any order."""

    __slots__ = ("types", "pairs", "values", "shape", "lead")

    def __init__(self, types=None, pairs=(), values=(), shape: int = 0, lead: int = 0) -> None:
        self.types: Counter[str] = Counter(types or {})
        self.pairs: set[tuple[int, int]] = set(pairs)
        self.values: set[int] = set(values)
        # The shape that leads a majority vote, and by how much.
        self.shape, self.lead = shape, lead

    def vote(self, shape: int, lead: int) -> None:
        if shape == self.shape:
            self.lead += lead
        elif lead > self.lead:
            self.shape, self.lead = shape, lead - self.lead
        else:
            self.lead -= lead

    def add(self, entity: int | None, value) -> int:
        """Takes up one value; how many pairs came with it."""
        kind = type_of(value)
        self.types[kind] += 1
        if kind == "object":
            return 0
        own = _value_hash(kind, value)
        if kind == "string":
            self.vote(_shape(value), 1)
        self.values.add(own)
        if len(self.values) > 8 * VALUES:
            self.values = _lowest(self.values, VALUES)
        if entity is None:
            return 1
        self.pairs.add((entity, own))
        if len(self.pairs) > 4 * SAMPLE:
            self.pairs = _lowest(self.pairs, SAMPLE)
        return 1

    def merge(self, other: _Field) -> None:
        self.types.update(other.types)
        self.pairs = _lowest(self.pairs | other.pairs, SAMPLE)
        self.values = _lowest(self.values | other.values, VALUES)
        self.vote(other.shape, other.lead)

    def packed(self) -> tuple:
        pairs, values = _lowest(self.pairs, SAMPLE), _lowest(self.values, VALUES)
        # Values that the pairs show anyway aren't written.
        known = _lowest({v for _, v in pairs}, VALUES) if len(self.pairs) <= SAMPLE else None
        return dict(self.types), sorted(pairs), None if known == values else sorted(values), self.shape, self.lead

    @classmethod
    def unpacked(cls, types, pairs, values, shape, lead) -> _Field:
        return cls(types, pairs, _lowest({v for _, v in pairs}, VALUES) if values is None else values, shape, lead)

    @property
    def type(self) -> str:
        counts = Counter({k: n for k, n in self.types.items() if k not in NUMBERS})
        if number := sum(self.types[k] for k in NUMBERS):
            counts["number"] = number
        return min(counts, key=lambda k: (-counts[k], GENERALITY.index(k)))

    @property
    def fixed_shape(self) -> int:
        return self.shape if self.lead >= SHAPE_SHARE * self.types["string"] else 0


class _File:
    """The fields of one file, and its records by prefix."""

    def __init__(self) -> None:
        self.records: Counter[str] = Counter()
        self.fields: dict[str, _Field] = {}

    def add(self, prefix: str, entity: str, record: dict) -> int:
        self.records[prefix] += 1
        if not prefix:
            for name, value in record.items():
                self.fields.setdefault(name, _Field()).types[type_of(value)] += 1
            return 1
        at, pairs = _hash(entity) if entity else None, 0
        for name, value in leaves(record, prefix):
            field = self.fields.get(name)
            if field is None:
                field = self.fields[name] = _Field()
            pairs += field.add(at, value)
        return pairs

    def merge(self, packed: bytes) -> None:
        records, fields = pickle.loads(packed)
        self.records.update(records)
        for name, own in fields.items():
            field = _Field.unpacked(*own)
            if name in self.fields:
                self.fields[name].merge(field)
            else:
                self.fields[name] = field

    def packed(self) -> bytes:
        return pickle.dumps((dict(self.records), {n: f.packed() for n, f in self.fields.items()}), protocol=5)

    def held(self, name: str) -> tuple[int, int]:
        """How many of its records a field stands in, and how many there are."""
        prefix = name[: name.index(".") + 1] if "." in name else ""
        return sum(self.fields[name].types.values()), max(1, self.records[prefix])


def _alike(old: tuple[int, int], new: tuple[int, int]) -> bool:
    """Whether two shares of records may be one: within ``RECORD_SHARE``, or two standard errors where the records are few."""
    (a, n), (b, m) = old, new
    pooled = (a + b) / (n + m)
    return abs(a / n - b / m) <= max(RECORD_SHARE, 2 * (max(0.0, pooled * (1 - pooled)) * (1 / n + 1 / m)) ** 0.5)


def file_summaries(df: DataFrame, kind: str, payload_col: str = "payload") -> DataFrame:
    """(feed, file_no, summary): what each task knows of each file it reads; kind: report or place."""
    records = RECORDS[kind]
    schema = T.StructType([T.StructField("feed", T.StringType()), T.StructField("file_no", T.LongType()), T.StructField("summary", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[tuple, _File] = {}
        held = 0

        def out() -> pa.RecordBatch:
            feeds, numbers = zip(*files)
            return pa.RecordBatch.from_arrays([pa.array(feeds, pa.string()), pa.array(numbers, pa.int64()), pa.array([f.packed() for f in files.values()], pa.binary())], schema.names)

        for batch in batches:
            for feed, no, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                file = files.get((feed, no)) or files.setdefault((feed, no), _File())
                held += 1
                ok, value = whole_value(text)
                if ok:
                    for prefix, entity, record in records(value):
                        held += file.add(prefix, entity, record)
                if held >= FLUSH:
                    yield out()
                    files, held = {}, 0
        if files:
            yield out()

    return df.select("feed", F.col("file_no").cast("long").alias("file_no"), payload_col).where("file_no is not null").mapInArrow(read, schema)


def _agreement(old: _Field, new: _Field) -> float | None:
    """How much more often the entities of both carry the same value than by chance, up to 1; null if no entity is in both."""
    before, after = {}, {}
    for side, pairs in ((before, old.pairs), (after, new.pairs)):
        for e, v in pairs:
            side.setdefault(e, set()).add(v)
    both = before.keys() & after.keys()
    if not both:
        return None
    same = sum(bool(before[e] & after[e]) for e in both) / len(both)
    olds, news = (Counter(v for e in both for v in side[e]) for side in (before, after))
    chance = sum(n * news[v] for v, n in olds.items()) / (olds.total() * news.total())
    # Values that never vary agree by chance alone; the same one on both sides is all that can be asked of them.
    return same if chance == 1 else (same - chance) / (1 - chance)


def _content(old: _Field, new: _Field) -> float:
    """How far the content of one field goes on in the other, 0 if it doesn't."""
    agreed = _agreement(old, new)
    if agreed is not None:
        return 1 + agreed if agreed >= AGREEMENT else 0.0
    union = _lowest(old.values | new.values, VALUES)
    shared = len(union & old.values & new.values) / len(union) if union else 0.0
    return shared if shared >= VALUE_SHARE else 0.0


def _differences(old: _File, new: _File) -> Iterator[tuple[str, str, str]]:
    """(old_field, new_field, change) from one file to the next."""
    for name, field in sorted(old.fields.items()):
        if name in new.fields and field.type != new.fields[name].type:
            yield name, name, "retyped"
    gone, come = sorted(old.fields.keys() - new.fields.keys()), sorted(new.fields.keys() - old.fields.keys())
    likely = [(-s, a, b) for a in gone for b in come if old.fields[a].type == new.fields[b].type and (s := _content(old.fields[a], new.fields[b]))]
    renamed: dict[str, str] = {}
    for _, a, b in sorted(likely):
        if a not in renamed and b not in renamed.values():
            renamed[a] = b
    # One field of a shape is gone and one is new, in as many of the records.
    shapes = [{}, {}]
    for side, (names, file) in zip(shapes, (([a for a in gone if a not in renamed], old), ([b for b in come if b not in renamed.values()], new))):
        for name in names:
            if shape := file.fields[name].fixed_shape:
                side.setdefault((shape, file.fields[name].type), []).append(name)
    for key in shapes[0].keys() & shapes[1].keys():
        if len(shapes[0][key]) == len(shapes[1][key]) == 1:
            (a,), (b,) = shapes[0][key], shapes[1][key]
            if _alike(old.held(a), new.held(b)):
                renamed[a] = b
    yield from ((a, b, "renamed") for a, b in renamed.items())
    yield from ((a, "", "removed") for a in gone if a not in renamed)
    yield from (("", b, "added") for b in come if b not in renamed.values())


COMPARED = "feed string, file_no long, field string, types map<string,long>, old_field string, new_field string, change string"


def compared(summaries: DataFrame, *, fields: bool = False) -> DataFrame:
    """The changes of each file and, if asked for, its fields, in one pass: rows with ``change`` or rows with ``field``.

    Each file is in the block of its number; the last file of a block goes to the next one too, as what comes before it.
    """
    block = F.floor(F.col("file_no") / BLOCK_FILES)
    last = F.pmod("file_no", F.lit(BLOCK_FILES)) == BLOCK_FILES - 1
    routed = summaries.withColumn("block", F.explode(F.when(last, F.array(block, block + 1)).otherwise(F.array(block))))
    ordered = routed.repartition("feed", "block").sortWithinPartitions("feed", "block", "file_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None
        at: tuple | None = None
        file = _File()
        rows: list[tuple] = []

        def close() -> None:
            feed, home, no = at
            if home != no // BLOCK_FILES:
                return
            if fields:
                rows.extend((feed, no, name, list(f.types.items()), None, None, None) for name, f in file.fields.items())
            if before and before[0] == (feed, home, no - 1):
                rows.extend((feed, no, None, None, *change) for change in _differences(before[1], file))

        def out() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.int64()), *[pa.string()] * 3]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["feed", "file_no", "field", "types", "old_field", "new_field", "change"])
            rows.clear()
            return made

        for batch in batches:
            for feed, no, packed, home in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (feed, home, no) != at:
                    if at:
                        close()
                        before = at, file
                    at, file = (feed, home, no), _File()
                file.merge(packed)
            if rows:
                yield out()
        if at:
            close()
        if rows:
            yield out()

    return ordered.select("feed", "file_no", "summary", F.col("block").cast("long").alias("block")).mapInArrow(run, COMPARED)


def changes(seen: DataFrame) -> DataFrame:
    """The changes from each file to the next one: feed, file_no, old_field, new_field, change (from :func:`compared`)."""
    return seen.where("change is not null").select("feed", F.col("file_no").cast("int").alias("file_no"), "old_field", "new_field", "change")


class UnionSchema:
    """One schema of all files: ``columns`` maps each column to its type, ``moves`` says where a feed has it under another name.

    Names that a feed's renames link are one column of that feed, called by the name that most files of all
    feeds use; in other feeds they stay what they are. ``columns`` and ``names`` (column to the names it has
    anywhere) grow with the distinct field names; ``moves`` (feed, name, column) grows with the feeds and
    stays a table.
    """

    def __init__(self, columns: dict[str, str], names: dict[str, list[str]], moves: DataFrame) -> None:
        self.columns, self.names, self.moves = columns, names, moves


def union_schema(seen: DataFrame) -> UnionSchema:
    """Of a written table of :func:`compared` with fields."""
    spark = seen.sparkSession
    own = seen.where("field is not null")
    weight = {r["field"]: r["n"] for r in own.groupBy("field").agg(F.count("*").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(weight)
    links = seen.where("change = 'renamed'").select("feed", "old_field", "new_field").distinct()

    def classes(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict[str, str] = {}

        def find(x: str) -> str:
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        rank = lambda x: (-shared.value.get(x, 0), x)
        for a, b in zip(pdf["old_field"], pdf["new_field"]):
            a, b = sorted((find(a), find(b)), key=rank)
            root[b] = a
        moved = [(x, find(x)) for x in root if find(x) != x]
        return pd.DataFrame({"feed": [pdf["feed"].iloc[0]] * len(moved), "name": [x for x, _ in moved], "column": [c for _, c in moved]})

    # A feed's distinct renames are bounded by its field names.
    moves = cut(links.groupBy("feed").applyInPandas(classes, "feed string, name string, column string"), "moves")
    types = own.select("feed", "field", F.explode(F.map_keys("types")).alias("type")).distinct()
    told = types.join(moves, types["feed"].eqNullSafe(moves["feed"]) & (types["field"] == moves["name"]), "left").select(F.coalesce("column", "field").alias("column"), "field", "type").distinct().collect()
    kinds: dict[str, set[str]] = {}
    names: dict[str, set[str]] = {}
    for r in told:
        kinds.setdefault(r["column"], set()).add(r["type"])
        names.setdefault(r["column"], set()).add(r["field"])
    return UnionSchema({c: promoted(sorted(k)) for c, k in sorted(kinds.items())}, {c: sorted(n) for c, n in names.items()}, moves)


#: Feeds whose moves are sent to all tasks (some 100 bytes each); beyond, they meet their rows by a join on the feed.
BROADCAST_FEEDS = 50_000


def consistent_table(df: DataFrame, kind: str, schema: UnionSchema, id_col: str, payload_col: str = "payload") -> DataFrame:
    """Every record of every readable payload under the union schema: id, feed, file_no, record_no, columns, others.

    A value that its promoted type does not admit becomes null; arrays are JSON text. Where a record has a renamed
    field under two of its names at once, the second value is kept in the map ``others``.
    """
    records = RECORDS[kind]
    id_type = df.schema[id_col].dataType
    out_schema = T.StructType([T.StructField("record_id", id_type), T.StructField("feed", T.StringType()), T.StructField("file_no", T.LongType()), T.StructField("record_no", T.IntegerType()), T.StructField("members", T.MapType(T.StringType(), T.StringType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (feed, no, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                ok, value = whole_value(text)
                if ok:
                    for k, (prefix, record) in enumerate((p, r) for p, _, r in records(value) if p):
                        at.append(i)
                        rows.append((feed, no, k, [(n, v if isinstance(v, str) else json.dumps(v)) for n, v in dict(leaves(record, prefix)).items()]))
            cols = list(zip(*rows)) or [[]] * 4
            types = [pa.string(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), t) for c, t in zip(cols, types))], out_schema.names)

    rows = df.select(F.col(id_col).alias("record_id"), "feed", F.col("file_no").cast("long").alias("file_no"), payload_col).mapInArrow(read, out_schema)
    moves = schema.moves.groupBy("feed").agg(F.map_from_entries(F.collect_list(F.struct("name", "column"))).alias("moved"))
    if schema.moves.count() <= BROADCAST_FEEDS:
        moves = F.broadcast(moves)
    met = rows.join(moves.withColumnRenamed("feed", "_feed"), F.col("feed").eqNullSafe(F.col("_feed")), "left")

    def sources(column: str) -> Column:
        """The names under which a record holds a column, its own first."""
        others = [n for n in schema.names[column] if n != column]
        return F.array_compact(F.array(F.when(F.col("members")[column].isNotNull() & F.col("moved")[column].isNull(), column), *(F.when((F.col("moved")[n] == column) & F.col("members")[n].isNotNull(), n) for n in others)))

    sql = {"integer": "bigint", "number": "double", "boolean": "boolean"}
    wide = [(c, t) for c, t in schema.columns.items() if "." in c]
    held = met.withColumn("held", F.array(*(sources(c) for c, _ in wide)) if wide else F.array().cast("array<array<string>>"))
    picked = [F.col("members")[F.get(F.col("held")[i], F.lit(0))].try_cast(sql.get(t, "string")).alias(c) for i, (c, t) in enumerate(wide)]
    second = F.flatten(F.transform("held", lambda h: F.slice(h, F.lit(2), F.greatest(F.size(h), F.lit(1)))))
    others = F.map_filter("members", lambda k, _: F.array_contains(second, k)).alias("others")
    return held.select("record_id", "feed", F.col("file_no").cast("int").alias("file_no"), "record_no", *picked, others)
