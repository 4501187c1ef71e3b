"""Repair of conversations: the cheapest edits that make the roles read (system, then) user, assistant, user, …

A turn is kept (K, free), given another role (R, 3), deleted (D, 4; blank and repeated ones must go) or an empty
turn is inserted before it (I, 3); a turn that breaks off and stays costs 3 more.  Of the cheapest edits those
whose letters come first in ASCII order are taken.

One integer decides both.  Its high digits are the cost; below them stands, in a fixed width, one octal digit for each letter,
the first letter highest, zeros at the end.  An ordinary minimum over these integers, from the last turn
to the first over the turns and the four states of the role pattern, is the cheapest and least
audit.  Prefixing an edit adds its cost, moves the digits down by one and sets the highest.

Long conversations are cut into blocks.  A block's costs from state to state are a small matrix, the products of the matrices
behind a block tell what each of its end states costs, and with that every block is decided by itself: the letters
of two ways through a block never begin with one another (both end with the letter of its last turn), so what
follows cannot turn them round.  A conversation's blocks are then chained by their states.  Only one row for each block
meets in a task; turns are ordered by ranges and texts travel once, for the digest.

Defined results
* null roles and texts are read as one space; null turns come first; turns of one number follow by role, then by a
  digest; a null conversation is a conversation like any other
* a turn is blank without a sign other than white space, a repetition if role and text stood before, broken off if its
  last such sign is none of . ! ?; the first of these counts
* roles are told by their first letter; an empty role has none and is never in place
* an id without turns has zeros, an empty audit and no repaired turns; an empty table gives an empty result; other
  columns are not read, whatever their names
* role and text are compared by 128 bits of their SHA-256
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.work import Work

BLOCK = 512  # turns decided at once
BLANK_SIGNS = " \t\n\x0b\x0c\r"
SENTENCE_ENDS = ".!?"
LETTERS = "DIKR"
DELETE, INSERT, KEEP, REROLE = range(1, 5)  # their digits, in ASCII order; zero is padding
COSTS = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
BROKEN_OFF = 3

NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # states: what the repaired turns so far end with
INITIALS = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}
ROLES = {USER: "user", ASSISTANT: "assistant"}
NEXT = (USER, USER, ASSISTANT, USER)  # the role an inserted or changed turn takes
TO_END = (0, 2 * COSTS[INSERT], COSTS[INSERT], 0)  # turns inserted at the end
FOLLOWS = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
FINE, TRUNCATED, EMPTY, REPEATED = range(4)  # faults; a turn is one byte: 4 * initial + fault
FAR = 1 << 40


def _edits(state: int, turn: int) -> Iterator[tuple[int, int, int]]:
    """(letter, cost, next state) of the edits of one turn."""
    initial, fault = divmod(turn, 4)
    yield DELETE, COSTS[DELETE], state
    if fault in (EMPTY, REPEATED):
        return
    more = BROKEN_OFF if fault == TRUNCATED else 0
    if initial == NEXT[state] or (initial == SYSTEM and state == NOTHING):
        yield KEEP, COSTS[KEEP] + more, initial
    yield REROLE, COSTS[REROLE] + more, NEXT[state]


@lru_cache(maxsize=1 << 12)
def _table(turn: int) -> tuple[tuple[tuple[int, int, int], ...], ...]:
    return tuple(tuple(_edits(q, turn)) for q in range(4))


@lru_cache(maxsize=1 << 15)
def costs(turns: bytes) -> tuple[int, ...]:
    """Least cost from each state before the turns (four rows) to each state after them."""
    best = [[0 if p == q else FAR for p in range(4)] for q in range(4)]
    for turn in reversed(turns):
        moves = _table(turn)
        plain = [[min(c + best[to][p] for _, c, to in moves[q]) for p in range(4)] for q in range(4)]
        one = [[min(plain[q][p], COSTS[INSERT] + plain[NEXT[q]][p]) for p in range(4)] for q in range(4)]
        best = [[min(plain[q][p], COSTS[INSERT] + one[NEXT[q]][p]) for p in range(4)] for q in range(4)]
    return tuple(c for row in best for c in row)


@lru_cache(maxsize=1 << 15)
def decided(turns: bytes, to_go: tuple[int, ...]) -> tuple[tuple[str, int], ...]:
    """(letters, state after) for each state before the turns, if the states after them cost ``to_go``."""
    width = 3 * (3 * len(turns))  # bits: at most two insertions and one edit a turn
    top, low = width - 3, (1 << width) - 1

    def before(letter: int, cost: int, rest: int) -> int:
        return (((rest >> width) + cost) << width) + (letter << top) + ((rest & low) >> 3)

    best = [c << width for c in to_go]
    for turn in reversed(turns):
        moves = _table(turn)
        plain = [min(before(letter, c, best[to]) for letter, c, to in moves[q]) for q in range(4)]
        one = [min(plain[q], before(INSERT, COSTS[INSERT], plain[NEXT[q]])) for q in range(4)]
        best = [min(plain[q], before(INSERT, COSTS[INSERT], one[NEXT[q]])) for q in range(4)]
    return tuple(_told(turns, b & low, width, q) for q, b in enumerate(best))


def _told(turns: bytes, digits: int, width: int, state: int) -> tuple[str, int]:
    octal = f"{digits:0{width // 3}o}".rstrip("0") if width else ""
    place = 0
    for digit in map(int, octal):
        if digit == INSERT:
            state = NEXT[state]
        else:
            state = next(to for letter, _, to in _table(turns[place])[state] if letter == digit)
            place += 1
    return "".join(LETTERS[int(d) - 1] for d in octal), state


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bool]]:
    """Rows one by one, each with whether another conversation begins."""
    last: tuple = ()
    for batch in batches:
        for row in batch.to_pylist():
            yield row, last != (row["conv"],)
            last = (row["conv"],)


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _rows(held, schema)
            held = []
    yield _rows(held, schema)


def _blocks(schema: pa.Schema, block: int):
    """Sorted turns to blocks: consecutive turns of one conversation and range, at most ``block``."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, out = None, None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "part", "at", "turn", "sign", "digest")]
            for conv, part, at, turn, sign, digest in zip(*columns):
                if key != (conv, part) or len(out["turns"]) >= block:
                    if out:
                        yield done(out)
                    key, out = (conv, part), {"conv": conv, "at": at, "turns": bytearray(), "digests": bytearray(), "first": turn, "last": None, "numbers": 0}
                out["turns"].append(sign)
                out["digests"] += digest
                if turn is not None:
                    out["first"] = turn if out["first"] is None else out["first"]
                    out["numbers"] += out["last"] != turn
                    out["last"] = turn
        if out:
            yield done(out)

    def done(out: dict) -> dict:
        turns = bytes(out["turns"])
        return {**out, "turns": turns, "digests": bytes(out["digests"]), "costs": list(costs(turns))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(told(batches), schema)

    return run


def _costed(schema: pa.Schema):
    """Blocks of a conversation from the last to the first: what each state after the block costs to the end."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        to_go = TO_END
        for row, new in _groups(batches):
            if new:
                to_go = TO_END
            matrix = row.pop("costs")
            yield {**row, "to_go": list(to_go)}
            to_go = tuple(min(matrix[4 * q + p] + to_go[p] for p in range(4)) for q in range(4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(told(batches), schema)

    return run


def _solved(schema: pa.Schema):
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row, _ in _groups(batches):
            to_go = row["to_go"]
            least = min(to_go)
            ways = decided(row["turns"], tuple(c - least for c in to_go))
            yield {**row, "letters": [w[0] for w in ways], "after": [w[1] for w in ways]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(told(batches), schema)

    return run


def _chained(schema: pa.Schema):
    """Blocks of a conversation in order: one row of letters for each, with the state it begins in, and one for the end."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        state, place, open_ = NOTHING, 0, None
        for row, new in _groups(batches):
            if new:
                if open_ is not None:
                    yield end(open_, state, place)
                state, place, open_ = NOTHING, 0, row
            yield {**{c: row[c] for c in ("conv", "at", "turns", "digests", "first", "last", "numbers")}, "letters": row["letters"][state], "state": state, "place": place}
            place += len(row["letters"][state])
            state, open_ = row["after"][state], row
        if open_ is not None:
            yield end(open_, state, place)

    def end(row: dict, state: int, place: int) -> dict:
        letters = "I" * (TO_END[state] // COSTS[INSERT])
        return {"conv": row["conv"], "at": row["at"] + 1, "turns": b"", "digests": b"", "first": None, "last": None, "numbers": 0, "letters": letters, "state": state, "place": place}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(told(batches), schema)

    return run


def _counted(schema: pa.Schema):
    """The audit and the counts of every conversation, from its rows of letters in order."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out: dict | None = None
        for row, new in _groups(batches):
            if new:
                if out is not None:
                    yield done(out)
                out = {"conv": row["conv"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "role": None, "first": None, "last": None, "numbers": 0}
            turns = row["turns"]
            faults, initials = [t % 4 for t in turns], [t // 4 for t in turns]
            for name, fault in (("blank", EMPTY), ("duplicate", REPEATED), ("truncated", TRUNCATED)):
                out[name] += faults.count(fault)
            pairs = zip(([out["role"]] if out["role"] is not None else []) + initials, initials[0 if out["role"] is not None else 1 :])
            out["illegal"] += sum(p not in FOLLOWS for p in pairs)
            out["role"] = initials[-1] if initials else out["role"]
            edits = iter(faults)
            for letter in row["letters"]:
                digit = LETTERS.index(letter) + 1
                stays = digit != INSERT and next(edits) == TRUNCATED and digit != DELETE
                out["cost"] += COSTS[digit] + BROKEN_OFF * stays
            out["audit"].append(row["letters"])
            if row["last"] is not None:
                out["numbers"] += row["numbers"] - (out["last"] == row["first"])
                out["first"] = row["first"] if out["first"] is None else out["first"]
                out["last"] = row["last"]
        if out is not None:
            yield done(out)

    def done(out: dict) -> dict:
        gaps = out["last"] - out["first"] + 1 - out["numbers"] if out["last"] is not None else 0
        return {**{c: out[c] for c in ("conv", "blank", "duplicate", "truncated", "illegal", "cost")}, "gaps": gaps, "audit": "".join(out["audit"])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(told(batches), schema)

    return run


def _edited(schema: pa.Schema):
    """The turns that stay or are inserted: their place, the role if it changes, the digest that finds the text."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row, _ in _groups(batches):
            state, at, digests = row["state"], 0, row["digests"]
            for place, letter in enumerate(row["letters"], row["place"]):
                if letter == "I":
                    state = NEXT[state]
                    yield {"conv": row["conv"], "place": place, "role": ROLES[state], "digest": None}
                    continue
                turn, digest = row["turns"][at], digests[16 * at : 16 * at + 16]
                at += 1
                if letter == "D":
                    continue
                state = NEXT[state] if letter == "R" else turn // 4
                yield {"conv": row["conv"], "place": place, "role": ROLES[state] if letter == "R" else None, "digest": digest}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(told(batches), schema)

    return run


def _hashed(schema: pa.Schema):
    """SHA-256 of the turns of a conversation, one after the other as they come; no conversation is held."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv, sha = None, None
        for batch in batches:
            text = (batch.column(batch.schema.get_field_index(c)).cast(pa.binary()).to_pylist() for c in ("role", "text"))
            for now, role, said in zip(batch.column(0).to_pylist(), *text):
                if sha is None or now != conv:
                    if sha is not None:
                        yield {"conv": conv, "sha256": sha.hexdigest()}
                    conv, sha = now, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(role + b":" + said)
        if sha is not None:
            yield {"conv": conv, "sha256": sha.hexdigest()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(told(batches), schema)

    return run


@dataclass(frozen=True)
class Repair:
    """``counts``: a row for every conversation with turns; ``edits``: the letters of its blocks; ``turns``: the turns read."""

    counts: DataFrame
    edits: DataFrame
    turns: DataFrame
    work: Work
    kind: str


def _read(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    said, by = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (text, role))
    plain = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), by.alias("role"), said.alias("text"))
    return plain.withColumn("digest", F.substring(F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, 16))


def _sign(repeated: Column) -> Column:
    """The byte of a turn."""
    cut = F.rtrim("text", F.lit(BLANK_SIGNS))
    initial = F.lit(0)
    for state, letter in INITIALS.items():
        initial = F.when(F.substring("role", 1, 1) == letter, state).otherwise(initial)
    fault = F.when(cut == "", EMPTY).when(repeated, REPEATED).when(~F.right(cut, F.lit(1)).isin(*SENTENCE_ENDS), TRUNCATED).otherwise(FINE)
    return 4 * initial + fault


def _fields(kind, *more: tuple[str, pa.DataType]) -> tuple[pa.Schema, str]:
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

    schema = pa.schema([("conv", to_arrow_type(kind)), *more])
    return schema, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in from_arrow_schema(schema).fields)


def repair(rows: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", block=BLOCK) -> Repair:
    """Decide the edits of every conversation of ``rows``."""
    work = Work(rows.sparkSession, "conversations")
    kind = rows.schema[conv_col].dataType
    turns = _read(rows, conv_col, turn_col, role_col, text_col)
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("read")]
    slim = turns.select("conv", "turn", "role", "digest", _sign(F.lit(False)).cast("int").alias("sign"), F.monotonically_increasing_id().alias("read"))
    slim = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "digest", "sign", F.monotonically_increasing_id().alias("at"))
    slim = work.save(slim, "slim")
    again = slim.groupBy("conv", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("c"), F.col("digest").alias("d"), "first")
    met = slim.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    repeated = (F.col("at") > F.col("first")) & (F.col("sign") % 4 != EMPTY)
    signed = met.select("conv", "turn", "digest", F.when(repeated, F.col("sign") - F.col("sign") % 4 + REPEATED).otherwise(F.col("sign")).alias("sign"), "at", F.shiftright("at", 33).alias("part"))

    facts = (("at", pa.int64()), ("turns", pa.binary()), ("digests", pa.binary()), ("first", pa.int64()), ("last", pa.int64()), ("numbers", pa.int64()))
    many = pa.list_(pa.int64())

    def step(df: DataFrame, make, *more) -> DataFrame:
        schema, line = _fields(kind, *more)
        return df.mapInArrow(make(schema), line)

    blocks = step(signed.repartition("part").sortWithinPartitions("at"), lambda s: _blocks(s, block), *facts, ("costs", many))
    conv = F.col("conv").asc_nulls_first()
    costed = work.save(step(blocks.repartition("conv").sortWithinPartitions(conv, F.desc("at")), _costed, *facts, ("to_go", many)), "costed")
    solved = step(costed, _solved, *facts, ("to_go", many), ("letters", pa.list_(pa.string())), ("after", many))
    chained = step(solved.drop("to_go").repartition("conv").sortWithinPartitions(conv, "at"), _chained, *facts, ("letters", pa.string()), ("state", pa.int64()), ("place", pa.int64()))
    edits = work.save(chained, "edits")
    ordered = edits.drop("digests", "state").repartition("conv").sortWithinPartitions(conv, "at")
    numbers = [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    counts = work.save(step(ordered, _counted, *numbers, ("audit", pa.string())), "counts")
    work.drop("slim", "costed")
    return Repair(counts, edits, turns, work, kind)


def repaired(done: Repair) -> DataFrame:
    """(conv, place, role, text) of every repaired turn, the rows of a conversation in one partition and in order."""
    schema, line = _fields(done.kind, ("place", pa.int64()), ("role", pa.string()), ("digest", pa.binary()))
    found = done.edits.mapInArrow(_edited(schema), line).select("conv", "digest", "place", "role", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("said_by"))
    texts = done.turns.select("conv", "digest", F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), "text", F.col("role").alias("said_by"))
    both = found.unionByName(texts).repartition("conv")
    key = Window.partitionBy("conv", "digest").orderBy(F.col("place").asc_nulls_last())
    # a turn that stays: its edit comes first, the first text after it belongs to it; repetitions and deleted turns are left over
    met = both.withColumn("n", F.row_number().over(key)).withColumn("edit", F.lag(F.struct("place", "role")).over(key))
    stays = met.where("digest IS NULL OR (n = 2 AND edit.place IS NOT NULL)")
    whole = stays.select("conv", F.coalesce("place", "edit.place").alias("place"), F.coalesce("role", "edit.role", "said_by").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return whole.sortWithinPartitions(F.col("conv").asc_nulls_first(), "place")


def digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256) over the ``role:text`` of the turns of :func:`repaired`, joined by line breaks."""
    schema, line = _fields(turns.schema["conv"].dataType, ("sha256", pa.string()))
    return turns.select("conv", "role", "text").mapInArrow(_hashed(schema), line)
