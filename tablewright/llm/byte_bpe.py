"""Byte-level BPE: ids with their byte offsets, and back.

Pre-tokenisation knows no regular expression.  The texts of a batch become one array of code
points, each of them a class: letter, number, other sign, white space, an apostrophe that opens
a contraction.  A class is a transition function over the eight states of a token in progress;
the functions these classes generate under composition are a small monoid, so a prefix scan with
its multiplication table gives the state before every code point, and state and class say
where a token begins.  The scan is associative: it runs over many blocks side by side.

The slices between two beginnings are told apart as numbers and each looked up once; those that are no entry of the vocabulary are merged
pair by pair, lowest rank first, and remembered.  Every token keeps the offset of its first byte in its text, so
decoding places each token's bytes directly, for a whole text or a range of its tokens.

Defined results
* null and empty texts have no tokens and decode to no bytes; bytes that are not UTF-8 are read as U+FFFD
* rows are independent: null ids, repeated rows and ties are encoded one by one; an empty table
  gives an empty result; other columns are not read
* strings of special tokens are ordinary text
* memory grows with the longest single text, by some forty bytes a code point
"""

from __future__ import annotations

import base64
import gc
import heapq
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.slices import Memory, told
from tablewright.llm.work import chunks

RANKS = "byte_bpe_50k.tiktoken"
CHUNK = 1 << 20  # bytes of text in one scan
REMEMBERED = 1 << 18  # slices, in each half of the memory of a worker: some 12 MB
SHORT = 64  # bytes; longer slices are merged with a heap
NEVER = 1 << 60
ROWS = 512  # rows taken from a batch at once

LETTER, NUMBER, OTHER, BLANK, SPACE, BREAK, SHORT_FORM, LONG_FORM, END = range(9)  # classes
NEW, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_BLANKS, ONE_MORE, TWO_MORE = range(8)  # states

# Contractions of the pattern: an apostrophe and one of these.
SHORT_FORMS = "stmd"
LONG_FORMS = ("re", "ve", "ll")


def vocabulary(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _moves() -> np.ndarray:
    """Next state by class and state.

    SPACE and BREAK are white space before a sign that is none: a space joins the run after it, another kind
    stands alone.  BLANK is white space before more of it, or before the end.
    """
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, BLANK: IN_BLANKS, SPACE: AFTER_SPACE, BREAK: NEW, SHORT_FORM: ONE_MORE, LONG_FORM: TWO_MORE, END: NEW}
    moves = np.array([[run[c]] * 8 for c in range(9)], np.uint8)
    moves[LETTER, ONE_MORE], moves[LETTER, TWO_MORE] = NEW, ONE_MORE
    for c in (SHORT_FORM, LONG_FORM):  # inside a run of signs, or after the space that opens one, an apostrophe is a sign
        moves[c, IN_OTHERS] = moves[c, AFTER_SPACE] = IN_OTHERS
    return moves


def _begins() -> np.ndarray:
    """Whether a token begins at a code point, by class and by the state before it."""
    begins = np.ones((9, 8), bool)
    begins[LETTER, [IN_LETTERS, AFTER_SPACE, ONE_MORE, TWO_MORE]] = False
    begins[NUMBER, [IN_NUMBERS, AFTER_SPACE]] = False
    begins[OTHER, [IN_OTHERS, AFTER_SPACE]] = False
    begins[SHORT_FORM, [IN_OTHERS, AFTER_SPACE]] = False
    begins[LONG_FORM, [IN_OTHERS, AFTER_SPACE]] = False
    begins[BLANK, IN_BLANKS] = False
    return begins


@lru_cache(maxsize=1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, product table, state that each element reaches from NEW) of the transition functions."""
    generators = [tuple(int(s) for s in row) for row in _moves()]
    known = {g: i for i, g in enumerate(dict.fromkeys([tuple(range(8)), *generators]))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in generators:
            h = tuple(g[s] for s in f)  # f first, then g
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    elements = list(known)
    product = np.zeros((16, 16), np.uint8)  # fifteen elements
    product[: len(elements), : len(elements)] = [[known[tuple(g[s] for s in f)] for g in elements] for f in elements]
    return np.array([known[g] for g in generators], np.uint8), product, np.array([f[NEW] for f in elements], np.uint8)


def scan(elements: np.ndarray) -> np.ndarray:
    """All prefix products; blocks are scanned side by side, their totals by the same function."""
    _, product, _ = monoid()
    n = len(elements)
    if n <= 64:
        out = np.empty(n, np.uint8)
        held = 0  # the identity
        for i, e in enumerate(elements):
            out[i] = held = product[held, e]
        return out
    flat = product.ravel()
    steps = max(2, int(n**0.5) // 4)
    blocks = -(-n // steps)
    table = np.zeros((blocks, steps), np.uint8)
    table.ravel()[:n] = elements
    table = np.ascontiguousarray(table.T)
    held = table[0]
    for t in range(1, steps):
        held = flat.take((held << 4) | table[t])
        table[t] = held
    carry = np.zeros(blocks, np.uint8)
    carry[1:] = scan(held)[:-1]
    carry <<= 4
    for t in range(steps):
        table[t] = flat.take(carry | table[t])
    return np.ascontiguousarray(table.T).ravel()[:n]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, told by the library itself: so its version of Unicode decides, not Python's."""
    import tiktoken

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
    every, single = points.tobytes().decode("utf-32-le"), {bytes([i]): i for i in range(256)}
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        found = tiktoken.Encoding("signs", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        table[np.frombuffer(bytes(found).decode().encode("utf-32-le"), "<u4")] = kind
    return table


def beginnings(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of every token in the texts put together, number of tokens of every text)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), "<u4")
    kinds = classes().take(points)
    kinds[ends] = END
    after = np.append(kinds[1:], END)
    last = (kinds == BLANK) & (after != BLANK) & (after != END)
    kinds[last] = np.where(points[last] == ord(" "), SPACE, BREAK)
    marks = np.flatnonzero((points == ord("'")) & (after == LETTER))
    one, two = points[marks + 1], points[np.minimum(marks + 2, len(points) - 1)]
    kinds[marks[np.isin(one, [ord(c) for c in SHORT_FORMS])]] = SHORT_FORM
    long = np.zeros(len(marks), bool)
    for a, b in LONG_FORMS:
        long |= (one == ord(a)) & (two == ord(b)) & (kinds[np.minimum(marks + 2, len(points) - 1)] == LETTER)
    kinds[marks[long]] = LONG_FORM
    of_class, _, reached = monoid()
    before = np.empty(len(kinds), np.uint8)
    before[0] = NEW
    before[1:] = reached.take(scan(of_class.take(kinds))[:-1])
    begins = _begins().ravel().take(kinds * np.uint8(8) + before)
    begins[ends] = False
    at = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(at, np.append(0, ends + 1)))
    return byte_places(points, ends)[at], counts


def byte_places(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The byte of every code point in the UTF-8 of the texts put together; the signs at ``ends`` are not part of them."""
    width = (points > 0x7F).view(np.uint8) + (points > 0x7FF) + (points > 0xFFFF) + np.uint8(1)
    width[ends] = 0
    return np.cumsum(width, dtype=np.int64) - width


class Vocabulary:
    """Ranks of byte strings; ``of`` keeps one for each worker process."""

    _open: dict[str, "Vocabulary"] = {}

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        size = max(self.ranks.values()) + 1
        self.lengths = np.zeros(size, np.int64)
        words = [b""] * size
        for word, rank in self.ranks.items():
            words[rank], self.lengths[rank] = word, len(word)
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.memory = Memory(REMEMBERED)

    @classmethod
    def of(cls, path: str) -> "Vocabulary":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    @cached_property
    def single(self) -> np.ndarray:
        """The id of every byte."""
        return np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)

    @cached_property
    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """(two ids as one number, the id of their bytes put together), sorted, for all pairs that make an entry."""
        size = len(self.lengths)
        made = [
            (self.ranks[a] * size + self.ranks[b], r) for w, r in self.ranks.items() for i in range(1, len(w)) if (a := w[:i]) in self.ranks and (b := w[i:]) in self.ranks
        ]
        pairs, ids = np.array(made, np.int64).reshape(-1, 2).T
        order = np.argsort(pairs)
        return pairs[order], ids[order]

    @cached_property
    def two(self) -> np.ndarray:
        """The rank of every pair of bytes."""
        letters = np.arange(256)
        return self.pair(self.single[np.repeat(letters, 256)], self.single[np.tile(letters, 256)]).reshape(256, 256)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of slices: in each the adjacent pair of lowest rank is merged, the leftmost of equals, until none has a rank.

        Slices of equal length are the rows of one matrix; every step merges one pair of each row, and the rows
        join the slices that are shorter by one.
        """
        out: list = [None] * len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        for i in np.flatnonzero(sizes > SHORT).tolist():
            out[i] = self._merge_long(pieces[i])
        width = int(sizes[sizes <= SHORT].max(initial=0))
        rows, parts, ranks = np.zeros(0, np.int64), np.zeros((0, width), np.int64), np.zeros((0, max(0, width - 1)), np.int64)
        for n in range(width, 0, -1):
            new = np.flatnonzero(sizes == n)
            if len(new):
                letters = np.frombuffer(b"".join([pieces[i] for i in new.tolist()]), np.uint8).reshape(-1, n)
                rows, parts = np.concatenate([rows, new]), np.concatenate([parts, self.single[letters]])
                ranks = np.concatenate([ranks, self.two[letters[:, :-1], letters[:, 1:]]])
            if n == 1:
                break
            low = ranks.argmin(axis=1)
            open_ = ranks[np.arange(len(rows)), low] < NEVER
            for i, ids in zip(rows[~open_].tolist(), parts[~open_].tolist()):
                out[i] = ids
            rows, parts, ranks, low = rows[open_], parts[open_], ranks[open_], low[open_]
            at = np.arange(len(rows))
            parts[at, low] = ranks[at, low]  # the rank of a pair is the id of the token it makes
            stays = np.ones(parts.shape, bool)
            stays[at, low + 1] = False
            parts = parts[stays].reshape(len(rows), n - 1)
            stays = np.ones(ranks.shape, bool)
            stays[at, low] = False
            ranks = ranks[stays].reshape(len(rows), n - 2)
            for here in (low - 1, low):  # the pairs on both sides of the new token
                on = (here >= 0) & (here < n - 2)
                r, c = at[on], here[on]
                ranks[r, c] = self.pair(parts[r, c], parts[r, c + 1])
        for i, ids in zip(rows.tolist(), parts.tolist()):
            out[i] = ids
        return out

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the bytes of two ids put together, or NEVER."""
        pairs, made = self.joined
        wanted = left * len(self.lengths) + right
        at = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
        return np.where(pairs[at] == wanted, made[at], NEVER)

    def _merge_long(self, piece: bytes) -> list[int]:
        rank, n = self.ranks.get, len(piece)
        stop, left = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i: its end, the start before
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\x01") * n
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = stop[i]
            if not alive[i] or middle >= n or stop[middle] != end:
                continue  # one of both parts has changed since
            alive[middle], stop[i] = 0, end
            if end < n:
                left[end] = i
                if (r := rank(piece[i : stop[end]])) is not None:
                    heapq.heappush(heap, (r, i, stop[end]))
            if (h := left[i]) >= 0 and (r := rank(piece[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : stop[i]]])
            i = stop[i]
        return ids

    def ask(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all slices, number of ids of each): an entry of the vocabulary is one id, other slices are merged."""
        single = list(map(self.ranks.get, pieces))
        many = iter(self.merge([p for p, s in zip(pieces, single) if s is None]))
        lists = [next(many) if s is None else (s,) for s in single]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int32, int(lengths.sum())), lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, offset of every id in its text, number of ids of every text)."""
        raws = [t.encode() for t in texts]
        data = b"".join(raws)
        first, counts = beginnings(texts)
        ids, sizes = told(data, first, np.append(first[1:], len(data)), self.memory, self.ask) if len(first) else (first, first)
        of_text = np.repeat(np.arange(len(texts)), counts)
        per_text = np.bincount(of_text, sizes, len(texts)).astype(np.int64) if len(first) else np.zeros(len(texts), np.int64)
        lengths = self.lengths[ids]
        text_start = np.cumsum([0, *(len(r) for r in raws)])[:-1]
        return ids, np.cumsum(lengths) - lengths - np.repeat(text_start, per_text), per_text

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Bytes of ids; each token is placed at its offset, counted from the first one."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        at = offsets.astype(np.int64) - int(offsets[0])
        out = np.zeros(int(at[-1] + lengths[-1]), np.uint8)
        inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(at, lengths) + inside] = self.bytes[np.repeat(self.starts[ids], lengths) + inside]
        return out.tobytes()


def _texts(column) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary.of(path)
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            texts = _texts(batch.column(1))
            for a, b in chunks(texts, CHUNK):
                gc.disable()  # many short lists, none of them in a cycle
                ids, offsets, counts = words.encode(texts[a:b])
                gc.enable()
                bounds = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (ids, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *lists], names=["id", "ids", "offsets"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary.of(path)
        for whole in batches:
            for start in range(0, max(1, whole.num_rows), ROWS):
                batch = whole.slice(start, ROWS)
                ids, offsets = (batch.column(batch.schema.get_field_index(c)) for c in ("ids", "offsets"))
                bounds = np.asarray(ids.offsets)
                i, o = (np.asarray(x.values) for x in (ids, offsets))
                texts = [words.decode(i[a:b], o[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, id_col="doc_id", text_col="text", ranks: str | None = None) -> DataFrame:
    """(id, ids, offsets) of every row: the token ids of its whole text and the first byte of each."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInArrow(_encode(ranks or vocabulary()), f"id {kind}, ids array<int>, offsets array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, ranks: str | None = None) -> DataFrame:
    """The rows of ``tokens`` (which has ids and offsets) with the bytes these ids stand for, as ``decoded``.

    Lists cut to the same range of tokens give the bytes of that range.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(_decode(ranks or vocabulary()), f"{schema}, decoded binary")
