"""Byte-level BPE, the Merkle manifest and the repair of conversations against brute force; candidates of near-copies."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.llm import byte_bpe, conversations, decontamination, language, manifest, near_copies, queries, simhash, slices, tokens
from tablewright.llm.bits import bit_map, marked
from tablewright.llm.graph import components
from tablewright.llm.work import BATCH_BYTES, Work, small_batches

WHITE = " \t\n\x0b\x0c\r"
SIGNS = ["'", "s", "t", "re", "ve", "'ll", "d", " ", "  ", "\n", "\t", "\xa0", "\x1c", "1", "²", "é", "漢", "a", "B", "!", "-", "😀", "<|endoftext|>", "\r\n", "×", "\x00", "ÿ"]
TEXTS = st.lists(st.lists(st.one_of(st.sampled_from(SIGNS), st.characters(exclude_categories=["Cs"])), max_size=14).map("".join), min_size=1, max_size=5)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.vocabulary(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# ---------------------------------------------------------------- slices, byte-level BPE, token files


@given(st.lists(st.binary(max_size=40), min_size=1, max_size=40))
@settings(max_examples=150, deadline=None)
def test_equal_slices(parts):
    bounds = np.cumsum([0, *map(len, parts)])
    which, places, keys = slices.distinct(b"".join(parts), bounds[:-1], bounds[1:])
    assert [int(n) for n in keys[3]] == [len(parts[w]) for w in which[: len(keys[3])]] and (np.diff(keys[0].astype(object)) >= 0).all()
    assert [parts[which[p]] for p in places] == parts
    short = [p for p in parts if len(p) <= slices.EXACT]
    assert len(which) == len(set(short)) + len(parts) - len(short)


def test_scan_is_a_prefix_product():
    rng = np.random.default_rng(3)
    of_class, product, _ = byte_bpe.monoid()
    for n in (0, 1, 63, 65, 1000, 20_001):
        elements = of_class[rng.integers(0, len(of_class), n)]
        held, want = 0, []
        for e in elements:
            held = product[held, e]
            want.append(held)
        assert byte_bpe.scan(elements).tolist() == want


@given(TEXTS)
@settings(max_examples=250, deadline=None)
def test_ids_of_the_library(library, texts):
    words = byte_bpe.Vocabulary.of(byte_bpe.vocabulary())
    ids, offsets, counts = words.encode(texts)
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends):
        assert ids[a:b].tolist() == library.encode_ordinary(text)
        assert words.decode(ids[a:b], offsets[a:b]) == text.encode()
        assert offsets[a:b].tolist() == np.cumsum([0, *(len(library.decode_single_token_bytes(i)) for i in ids[a:b])])[:-1].tolist()


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_token_files_agree_with_the_library(texts):
    encoder = tokens.Encoder.of(tokens.vocabulary())
    ids, counts = encoder.encode(texts)
    ends = np.cumsum(counts)
    assert [ids[a:b].tolist() for a, b in zip(ends - counts, ends)] == [encoder.model.encode(t, add_special_tokens=False).ids for t in texts]


def test_small_memories(library, monkeypatch):
    """What the memory has given up is encoded again, with the same ids."""
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 20), monkeypatch.setattr(tokens, "REMEMBERED", 20)
    rng = random.Random(8)
    words, encoder = byte_bpe.Vocabulary(byte_bpe.vocabulary()), tokens.Encoder(tokens.vocabulary())
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("aeioxz") for _ in range(9)) + str(rng.randrange(9)) for _ in range(8))]
        assert words.encode(texts)[0].tolist() == library.encode_ordinary(texts[0]) == encoder.encode(texts)[0].tolist()


def test_long_runs(library):
    words = byte_bpe.Vocabulary.of(byte_bpe.vocabulary())
    for text in ("a" * 5000, "ab" * 3000 + "'s" + " " * 3000 + "x", "thequick" * 500, "!?" * 900, "é" * 3000):
        assert words.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_byte_bpe_rows(spark, library):
    rows = [(1, "Hello there's  a\n\nword", 5), (1, "Hello there's  a\n\nword", 5), (None, None, 6), (2, "", 7), (None, "née <|endoftext|>", 8), (3, "x y " * 30000, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int").repartition(3)
    coded = byte_bpe.encode(docs)
    got = [(r.doc_id, r.ids, bytes(r.decoded)) for r in byte_bpe.decode(coded).collect()]
    assert sorted(got, key=str) == sorted([(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows], key=str)
    part = coded.where("doc_id = 2 OR size(ids) > 4").select("doc_id", F.slice("ids", 2, 3).alias("ids"), F.slice("offsets", 2, 3).alias("offsets"))
    for r in byte_bpe.decode(part).collect():
        assert bytes(r.decoded) == library.decode_bytes(r.ids)
    assert byte_bpe.decode(byte_bpe.encode(docs.where("false"))).count() == 0


def test_parts_of_token_files(spark, tmp_path):
    """Row groups, page indexes and encodings in the footers; some documents, and sizes alone, read without the rest."""
    import glob

    import pyarrow.parquet as pq

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id"), F.lit("some text of a document"), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    for encoding, want in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        path = f"{tmp_path}/{encoding}"
        tokens.write(docs.repartition(3), path, encoding=encoding, row_group=64 << 10)
        groups = 0
        for file in glob.glob(f"{path}/*.parquet"):
            meta = pq.ParquetFile(file).metadata
            groups += meta.num_row_groups
            names = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
            ids = next(c for n, c in names.items() if n.startswith("ids"))
            assert want in str(ids.encodings) and ids.has_column_index and ids.has_offset_index
        assert groups > 3
        plan = tokens.read(spark, path).where("doc_id between 10 and 19").select("doc_id", "n_tokens")._jdf.queryExecution().toString()
        assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,10)" in plan and "ids:array" not in plan.split("ReadSchema")[1].split("\n")[0]
        assert tokens.read(spark, path).where("doc_id between 10 and 19").count() == 10


# ---------------------------------------------------------------- manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        a = i - i % 3
        yield level[a:i], level[i + 1 : a + 3]
        i //= 3


def manifest_of(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by_source[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = {s: levels([leaf(r, r["text"]) for r in by_source[s]]) for s in names}
    over = levels([trees[s][-1][0] for s in names])
    for j, s in enumerate(names):
        for i, r in enumerate(by_source[s]):
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded, beside = leaf(r, text), []
            for left, right in (*siblings(trees[s], i), *siblings(over, j)):
                beside += left + right
                folded = digest(*left, folded, *right)
            yield r["doc_id"], leaf(r, r["text"]), trees[s][-1][0], over[-1][0], digest(*beside), folded, folded == over[-1][0]


MANIFEST = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, kid int, `a.b` int"


def verify(spark, rows, path):
    docs = spark.createDataFrame(rows, MANIFEST)
    docs.repartition(4).write.parquet(f"{path}/documents.parquet")
    return sorted([tuple(r) for r in queries.op12_merkle_manifest(spark, path).collect()], key=str)


@pytest.mark.parametrize("sizes", [[], [1], [1, 1], [4, 1, 10], [27, 28, 3, 2], [731, 5, 1, 1, 1]])
def test_manifest(spark, tmp_path, sizes):
    rng = random.Random(sum(sizes))
    names = [None, "", "z", "é", "a", "src"]
    rows = [(rng.choice([None, *range(9999)]), rng.choice([None, "", "a\nb", f"line\n{i}", "plain"]), rng.choice([None, "en"]), names[j], rng.choice([None, 3]), "x", 1, 2) for j, n in enumerate(sizes) for i in range(n)]
    rows += rows[:2]  # rows that are there twice
    want = sorted(manifest_of([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]), key=str)
    assert verify(spark, rows, str(tmp_path)) == want


def test_two_steps_of_node_rows(spark, tmp_path, monkeypatch):
    """Small node rows, so that several are stored one above the other, in a source and over the sources."""
    monkeypatch.setattr(manifest, "DEPTH", 1), monkeypatch.setattr(manifest, "SPAN", 3)
    rows = [(i, f"t\n{i}", "en", f"s{i % 11 if i > 40 else 0}", i, "x", 1, 2) for i in range(90)]
    want = sorted(manifest_of([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]), key=str)
    assert verify(spark, rows, str(tmp_path)) == want


# ---------------------------------------------------------------- conversations


def best_repair(turns):
    """(faults, cost, audit, repaired turns) by plain recursion over (turn, role before, insertions in a row)."""
    seen, faults = set(), []
    for role, text in turns:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    following, known = {"": "u", "s": "u", "u": "a", "a": "u"}, {}
    names = {"u": "user", "a": "assistant"}

    def ways(i, last, inserted):
        new = following[last]
        if i == len(turns) and last in ("", "a"):
            yield 0, "", ()
        if inserted < 3:
            cost, audit, out = best(i, new, inserted + 1)
            yield cost + 3, "I" + audit, ((names[new], ""), *out)
        if i < len(turns):
            role, text = turns[i]
            cost, audit, out = best(i + 1, last, 0)
            yield cost + 4, "D" + audit, out
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                if role[:1] == new or (role[:1] == "s" and last == ""):
                    cost, audit, out = best(i + 1, role[:1], 0)
                    yield cost + more, "K" + audit, ((role, text), *out)
                cost, audit, out = best(i + 1, new, 0)
                yield cost + 3 + more, "R" + audit, ((names[new], text), *out)

    def best(*at):
        if at not in known:
            known[at] = (10**9, "~", ())
            known[at] = min(ways(*at), key=lambda w: w[:2], default=known[at])
        return known[at]

    for i in range(len(turns), 0, -1):  # from the end, so that no recursion is deep
        for last in following:
            best(i, last, 0)
    return faults, *best(0, "", 0)


def told(turns):
    """The expected row of a conversation, from its (turn, role, text) in order."""
    faults, cost, audit, out = best_repair([t[1:] for t in turns])
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
    numbers = [t[0] for t in turns if t[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def conversations_of(rows, seed=1):
    """The expected result of the query for (conv, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        role, text, kept = " " if role is None else role, " " if text is None else text, out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, turns in out.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).digest()[:16]))
        yield conv, *told(turns)


TALK = "conv_id bigint, turn bigint, role string, text string, digest string, place int, conv int"


def test_conversations(spark, tmp_path):
    rng = random.Random(4)
    said = [None, "", " \n", "Yes.", "No!", "so\nwhat?", "it breaks", "end. ", "é…"]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(said)) for c in [None, *range(60)] for _ in range(rng.randrange(1, 9))]
    rows += [(77, 5, "user", "Yes.")] * 40 + [(78, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(700)]
    spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TALK).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted([tuple(r) for r in queries.op13_repair_conversations(spark, str(tmp_path)).collect()], key=str)
    assert got == sorted(conversations_of(rows), key=str)
    spark.createDataFrame([], TALK).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.op13_repair_conversations(spark, f"{tmp_path}/none").count() == 0


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool"]), st.sampled_from(["a.", "b.", "", "c", "d"])), max_size=9), st.sampled_from([1, 2, 3, 512]))
@settings(max_examples=300, deadline=None)
def test_blocks_decide_like_the_whole(turns, block):
    """Least cost and least audit, whatever the size of the blocks."""
    faults, cost, audit, _ = best_repair(turns)
    code = {"": conversations.FINE, "truncated": conversations.TRUNCATED, "blank": conversations.EMPTY, "duplicate": conversations.REPEATED}
    letters = {v: k for k, v in conversations.INITIALS.items()}
    signs = bytes(4 * letters.get(role[0], 0) + code[f] for (role, _), f in zip(turns, faults))
    parts = [signs[i : i + block] for i in range(0, len(signs), block)]
    to_go, ends = conversations.TO_END, []
    for part in reversed(parts):
        ends.append(to_go)
        matrix = conversations.costs(part)
        to_go = tuple(min(matrix[4 * q + p] + to_go[p] for p in range(4)) for q in range(4))
    state, out = conversations.NOTHING, ""
    for part, end in zip(parts, reversed(ends)):
        more, state = conversations.decided(part, end)[state]
        out += more
    assert (to_go[conversations.NOTHING], out + "I" * (conversations.TO_END[state] // 3)) == (cost, audit)


def test_a_long_conversation_in_many_blocks(spark):
    """One conversation over several ranges and blocks, and its repaired turns in order."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"{rng.randrange(60)}{rng.choice(['.', ''])}") for t in range(400)]
    done = conversations.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6), block=16)
    want = told([r[1:] for r in rows])
    (row,) = done.counts.collect()
    assert (row.gaps, row.blank, row.duplicate, row.truncated, row.illegal, row.cost, row.audit) == want[:-1]
    turns = conversations.repaired(done)
    assert conversations.digests(turns).first().sha256 == want[-1]
    out = [r.role for r in turns.orderBy("place").collect()]
    assert out == (["user", "assistant"] * len(out))[: len(out)]


# ---------------------------------------------------------------- near-copies


@pytest.mark.parametrize("tile", [512, 16])
def test_shared_headers_are_no_candidates(spark, tile):
    """Texts with a common header of forty words and eight of their own: no candidates, no links, whatever their number."""
    rng = random.Random(6)
    header = " ".join(f"h{i}" for i in range(40))
    texts = [f"{header} {' '.join(f'r{rng.randrange(10**9)}' for _ in range(8))}" for _ in range(600)] + [f"{header} {' '.join('abcdefgh')} {x}" for x in "xyz"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    seen = {}

    class Kept(Work):
        def save(self, df, name):
            out = super().save(df, name)
            seen[name] = out.count()
            return out

    groups = near_copies.similar_groups(docs, Kept(spark, "test-near"), tile=tile)
    assert groups.count() == 3 and sum(n for name, n in seen.items() if name.startswith("tried")) < 50


@pytest.mark.parametrize("tile", [4096, 8])
def test_large_groups_in_few_candidates(spark, tile):
    """Three hundred edited copies of one text: one component, far fewer candidates than pairs; and chains of copies stay together."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(300)]
    copies = [[f"e{rng.randrange(10**9)}" if rng.random() < 0.01 else w for w in base] for _ in range(300)]
    chain = [[f"c{i}" for i in range(k * 12, k * 12 + 200)] for k in range(25)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(copies + chain)], "doc_id bigint, text string").repartition(4)
    seen = {}

    class Kept(Work):
        def save(self, df, name):
            out = super().save(df, name)
            seen[name] = out.count()
            return out

    groups = near_copies.similar_groups(docs, Kept(spark, "test-near"), tile=tile)
    sizes = sorted(r["n"] for r in groups.groupBy("component").agg(F.count("*").alias("n")).collect())
    sets = list({frozenset(zip(*(t[i:] for i in range(5)))) for t in map(tuple, copies + chain)})
    near = [[j for j, y in enumerate(sets) if len(x & y) >= 0.8 * len(x | y)] for x in sets]
    left, want = set(range(len(sets))), []
    while left:
        todo, part = [left.pop()], 1
        while todo:
            new = left.intersection(near[todo.pop()])
            left -= new
            todo += new
            part += len(new)
        want.append(part)
    assert sizes == sorted(n for n in want if n > 1) and max(sizes) > 200 and 25 in sizes
    if tile == 4096:
        assert sum(n for name, n in seen.items() if name.startswith("tried")) < 300 * 299 / 4


def test_edges_of_large_groups_in_few_candidates(spark):
    """Copies of which many are too far from most others: all links are found, without a look at all pairs."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(240)]
    copies = [[f"e{rng.randrange(10**9)}" if rng.random() < 0.012 else w for w in base] for _ in range(400)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(copies)], "doc_id bigint, text string").repartition(4)
    seen = {}

    class Kept(Work):
        def save(self, df, name):
            out = super().save(df, name)
            seen[name] = out.count()
            return out

    groups = near_copies.similar_groups(docs, Kept(spark, "test-near"))
    sets = list({frozenset(zip(*(t[i:] for i in range(5)))) for t in map(tuple, copies)})
    label = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                label = [label[j] if k == label[i] else k for k in label]
    assert sorted(Counter(r.component for r in groups.collect()).values()) == sorted(n for n in Counter(label).values() if n > 1)
    assert sum(n for name, n in seen.items() if name.startswith("tried")) < 400 * 399 / 8


def test_entries_are_kept_exactly_when_two_nodes_share_them():
    rng = random.Random(4)
    rows = sorted((rng.randrange(60), rng.randrange(5), 9, 7) for _ in range(120))
    batches, at = [], 0
    while at < len(rows):
        part = rows[at : at + rng.randrange(0, 4)]
        batches.append(pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int64()) for i in range(4)], names=near_copies.ENTRY))
        at += len(part)
    out = [tuple(r.values()) for b in near_copies._shared(iter(batches)) for r in b.to_pylist()]
    nodes = {s: {r[1] for r in rows if r[0] == s} for s, *_ in rows}
    assert out == sorted({r for r in rows if len(nodes[r[0]]) > 1}) and len(out) < len(set(rows))


def test_small_graphs_take_few_tasks(spark, tmp_path):
    """Small tables are not written by one task for every shuffle partition, a bit map is no job for each of them, and stars take no more rounds."""
    import glob

    files = {}

    class Kept(Work):
        def save(self, df, name):
            out = super().save(df, name)
            files[name] = len(glob.glob(self.path(name).removeprefix("file:") + "/part-*"))
            return out

    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64"), spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        links = spark.range(1, 4000).select(F.col("id").alias("a"), (F.col("id") % 7 * 10_000).alias("b"))
        groups = dict(components(links, Kept(spark, "test-few"), rows=4000).collect())
        spark.sparkContext.setJobGroup("test-bits", "")
        marks = bit_map(spark.range(500).select(F.xxhash64("id").alias("hash")), 20)
        spark.sparkContext._jsc.clearJobGroup()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert groups == {n: min(x % 7 * 10_000, *range(x % 7 or 7, 8)) for x in range(1, 4000) for n in (x, x % 7 * 10_000)}
    assert set(files) <= {f"components-{x}" for x in ("0", "1", "large-0", "larged-0", "small-0")}
    assert 0 < max(files.values()) <= spark.sparkContext.defaultParallelism < 64
    assert marked(np.frombuffer(marks, np.uint8), np.array([r[0] for r in spark.range(500).select(F.xxhash64("id")).collect()]), 20).all()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("test-bits")) < 8


# ---------------------------------------------------------------- batches of whole texts


def test_small_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("text"))
    names = [f"spark.sql.execution.arrow.max{what}PerBatch" for what in ("Records", "Bytes")]
    before = [spark.conf.get(n) for n in names]
    with small_batches(spark):
        rows = [r.n for r in texts.mapInArrow(sizes, "n bigint").collect()]
    assert sum(rows) == 3000 and max(rows) * 20_000 < 1.1 * BATCH_BYTES
    assert [spark.conf.get(n) for n in names] == before


@pytest.fixture
def records(spark, monkeypatch):
    """Rows of a batch by the name of the stored table that its Python step makes."""
    seen, save = {}, Work.save

    def noted(self, df, name):
        seen[name] = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        return save(self, df, name)

    monkeypatch.setattr(Work, "save", noted)
    return seen


def test_simhash_takes_small_batches(spark, records):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.classes(docs).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [1, 3]
    assert records["rows"] == records["tiles"] == records["prints"] == "1024"


def test_decontamination_takes_small_batches(spark, records):
    docs = spark.createDataFrame([(1, "x a b c d e y"), (2, "else")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "A b c d e")], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.every_item(docs, items).collect()] == [(1, 7)]
    assert records["items"] == records["found"] == "1024"


def test_decontamination_hashes_little_text_at_once(monkeypatch):
    texts, taken, shingled = ["a b c d e f " * 5000] * 64, [], decontamination.shingled

    def noted(part, width):
        taken.append(sum(map(len, part)))
        return shingled(part, width)

    monkeypatch.setattr(decontamination, "shingled", noted)
    none = bytes(1 << decontamination.MAP_BITS >> 3)
    batch = pa.RecordBatch.from_arrays([pa.array(range(64)), pa.array(range(64)), pa.array(texts)], names=["id", "key", "text"])
    assert not list(decontamination._hits(none, none, [5], decontamination.MAP_BITS, ("id", "key"))(iter([batch])))
    assert sum(taken) == 64 * 60_000 and max(taken) <= 1 << 18


def test_language_sends_a_text_once(spark):
    rows = [(i, f"{w} " * 40, lang, None) for i, (w, lang) in enumerate([("lorem ipsum", "xx"), ("tam tam", "yy")] * 8)] + [(90, None, "xx", None), (91, "12", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, `odd.name` int")
    out = language.accepted(docs, language.learn(docs))
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(rows[:16])
    sent = re.search(r"MapInArrow.*\n\s*\+- Project \[(.*)\]", out._jdf.queryExecution().analyzed().toString()).group(1)
    assert len(re.findall(r"\btext#", sent)) == 1
