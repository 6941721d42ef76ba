"""Encodes a corpus with a public byte-level BPE vocabulary, without regular expressions.

Vectorised pre-tokenisation. The texts of an Arrow batch become one array of code points, a table maps code
points to classes, and one look-ahead turns classes into symbols of a small automaton. Where pieces begin is
found by an associative scan: each symbol is a function from state to state, functions are composed along
blocks (all blocks at once), block results are chained, and a second pass gives every position its state.
The slices between piece starts are merged by rank, each distinct piece once, through a cache.

Pieces are those of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

Defined cases: a null or empty text has no ids (an empty list); strings that look like special tokens are
ordinary text; texts are encoded whole, however long.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Where the vocabularies are, unless the caller says otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces kept with their ids in a worker; the cache starts anew beyond.
CACHE_PIECES = 200_000
#: Code points encoded at once; bounds a worker's memory.
CHUNK_CHARS = 1_000_000
#: Blocks that a scan goes along in parallel.
BLOCKS = 4096

# Symbols. A space that a piece may take up, another white space before a piece, white space before more of it
# or the end, an apostrophe that begins a short ending of one or of two letters, the break between texts.
_LETTER, _NUMBER, _OTHER, _SPACE, _WHITE, _RUN, _END1, _END2, _BREAK = range(9)
# States. In a run of white space, after a space to take up, in letters, numbers, others, one or two more
# letters of a short ending to come, at a piece's end.
_IN_RUN, _TAKE, _IN_LETTERS, _IN_NUMBERS, _IN_OTHERS, _ONE_MORE, _TWO_MORE, _AT_END = range(8)

#: White_Space of Unicode, fixed values.
_WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece begins) by symbol and state."""
    to, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    into = {_LETTER: _IN_LETTERS, _NUMBER: _IN_NUMBERS, _OTHER: _IN_OTHERS, _SPACE: _TAKE, _WHITE: _AT_END, _RUN: _IN_RUN, _END1: _ONE_MORE, _END2: _TWO_MORE, _BREAK: _AT_END}
    for symbol, state in into.items():
        to[symbol] = state
    for symbol, state in ((_LETTER, _IN_LETTERS), (_NUMBER, _IN_NUMBERS), (_OTHER, _IN_OTHERS), (_RUN, _IN_RUN)):
        begins[symbol, state] = False
    begins[[_LETTER, _NUMBER, _OTHER], _TAKE] = False
    for symbol in (_END1, _END2):  # after a space to take up or in others, an apostrophe is one of the others
        for state in (_TAKE, _IN_OTHERS):
            to[symbol, state], begins[symbol, state] = _IN_OTHERS, False
    for symbol in (_LETTER,):
        to[symbol, _ONE_MORE], begins[symbol, _ONE_MORE] = _AT_END, False
        to[symbol, _TWO_MORE], begins[symbol, _TWO_MORE] = _ONE_MORE, False
    return to, begins


_TO, _BEGINS = _automaton()


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point: letter, number, white space (as _RUN) or other."""
    kind = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    for cp in range(sys.maxunicode + 1):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            kind[cp] = _LETTER
        elif c == "N":
            kind[cp] = _NUMBER
    kind[list(_WHITE_SPACE)] = _RUN
    return kind


def _symbols(cps: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``breaks`` are positions that hold no character but end a text."""
    kind = _classes()[cps]
    kind[breaks] = _BREAK
    out = kind.copy()
    white = kind == _RUN
    after = np.ones(len(cps), bool)  # the next one is white space, a break or nothing
    after[:-1] = (kind[1:] == _RUN) | (kind[1:] == _BREAK)
    before_piece = white & ~after
    out[before_piece] = np.where(cps[before_piece] == 0x20, _SPACE, _WHITE)
    quotes = np.flatnonzero((cps == 0x27) & (kind == _OTHER))
    if len(quotes):
        padded = np.concatenate([cps, np.zeros(2, cps.dtype)])
        hidden = np.concatenate([kind == _BREAK, np.ones(2, bool)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        first, both = ~hidden[quotes + 1], ~hidden[quotes + 1] & ~hidden[quotes + 2]
        e1 = first & np.isin(one, [ord(c) for c in "stmd"])
        e2 = both & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        out[quotes[e1]], out[quotes[e2]] = _END1, _END2
    return out


def _states_before(symbols: np.ndarray) -> np.ndarray:
    """The state before each symbol, by composing transition functions along blocks."""
    n = len(symbols)
    blocks = max(1, min(BLOCKS, n // 64))
    length = -(-n // blocks)
    padded = np.full(blocks * length, _BREAK, np.uint8)
    padded[:n] = symbols
    grid = np.ascontiguousarray(padded.reshape(blocks, length).T)
    # What each block makes of every state it may be entered in.
    made = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    flat = _TO.ravel()
    for row in grid:
        made = flat[(row[:, None].astype(np.uint16) << 3) | made]
    entered = np.empty(blocks, np.uint8)
    state = _AT_END
    for b in range(blocks):
        entered[b] = state
        state = made[b, state]
    before = np.empty((length, blocks), np.uint8)
    at = entered
    for i, row in enumerate(grid):
        before[i] = at
        at = flat[(row.astype(np.uint16) << 3) | at]
    return before.T.ravel()[:n]


def piece_starts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """(the texts joined with a break after each, piece starts, positions of the breaks)."""
    joined = "\0".join(texts) + "\0"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.cumsum([len(t) + 1 for t in texts]) - 1
    symbols = _symbols(cps, breaks)
    begins = _BEGINS.ravel()[(symbols.astype(np.uint16) << 3) | _states_before(symbols)]
    return joined, np.flatnonzero(begins), breaks


class Encoder:
    """Merges pieces by rank, with a cache."""

    def __init__(self, vocabulary: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self._lengths: np.ndarray | None = None
        self.cache: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the adjacent pair of least rank is merged first, the left one on ties."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that begins here
        prev = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def piece_ids(self, piece: str) -> list[int]:
        got = self.cache.get(piece)
        if got is None:
            got = self.merge(piece.encode())
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            if len(piece) <= 64:
                self.cache[piece] = got
        return got

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        if not texts:
            return []
        joined, starts, breaks = piece_starts(texts)
        edges = starts.tolist()
        first = np.searchsorted(starts, np.concatenate([[0], breaks[:-1] + 1])).tolist()
        last = np.searchsorted(starts, breaks).tolist()
        cached, ids_of = self.cache.get, self.piece_ids
        out = []
        for a, b in zip(first, last):
            ids: list[int] = []
            for i in range(a, b):
                piece = joined[edges[i] : edges[i + 1]]
                ids += cached(piece) or ids_of(piece)
            out.append(ids)
        return out

    def encode_with_offsets(self, text: str) -> tuple[list[int], list[int]]:
        """(ids, byte offset of each id in the text's UTF-8 form)."""
        (ids,) = self.encode([text])
        sizes = [len(self.bytes_of[i]) for i in ids]
        return ids, [0, *np.cumsum(sizes).tolist()][:-1] if ids else []

    @property
    def byte_lengths(self) -> np.ndarray:
        """How many bytes each id stands for."""
        if self._lengths is None:
            self._lengths = np.zeros(max(self.bytes_of, default=-1) + 1, np.int64)
            for i, b in self.bytes_of.items():
                self._lengths[i] = len(b)
        return self._lengths

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary) -> Encoder:
    """One encoder in a worker, for all its tasks."""
    key = hash(vocabulary.value)  # bytes keep their hash
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary.value)
    return _encoders[key]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some CHUNK_CHARS characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def read_vocabulary(spark: SparkSession, path: str = VOCABULARY):
    """The rank file (under 1 MB), read by the driver and sent to the executors once."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, *, offsets: bool = False) -> DataFrame:
    """(id, ids) of every text, in one pass without a shuffle; with ``offsets`` also ``starts``, where each id begins in the text's UTF-8 form."""
    shared = read_vocabulary(df.sparkSession, vocabulary)
    names = ["ids", "starts"] if offsets else ["ids"]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(n, T.ArrayType(T.IntegerType(), False)) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _chunks(texts):
                ids = encoder.encode(texts[a:b])
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((x for own in ids for x in own), np.int32, int(sizes.sum()))
                edges = np.concatenate([[0], np.cumsum(sizes)])
                columns = [flat]
                if offsets:
                    # Ids are laid out one after the other, so a text's offsets are running sums from its first id on.
                    before = np.concatenate([[0], np.cumsum(encoder.byte_lengths[flat])])
                    columns.append((before[:-1] - np.repeat(before[edges[:-1]], sizes)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], [id_col, *names])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode_corpus(df: DataFrame, id_col: str, ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text) of the texts that ids stand for; null ids are the empty text."""
    shared = read_vocabulary(df.sparkSession, vocabulary)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoder.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())], schema.names)

    return df.select(id_col, ids_col).mapInArrow(run, schema)


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens) of every text."""
    shared = read_vocabulary(df.sparkSession, vocabulary)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [len(ids) for a, b in _chunks(texts) for ids in encoder.encode(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], [id_col, "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(run, schema)
