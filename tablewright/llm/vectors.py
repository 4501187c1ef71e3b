"""Embedding near-duplicates by sorted projection passes.

Equal vectors of a label are one class, however many they are.  Each class has a
sketch of random projection signs.  A pass orders the sketches of a label lexicographically
by the concatenated signs, taken in an order of its own, and compares every vector
with its next neighbours; sketches that agree well enough become candidates, and the
cosine in double precision decides.  The links of all passes are united into components.

A window is bounded.  A vector that still agrees with the last row of its window, in any
pass and on either side, has an exhausted window: it is compared exactly with all vectors
of its label, tile by tile.  Tiles are cut from the order of the first pass, so those of
one direction lie close together, and pairs of tiles whose directions are too far apart
are left out by the triangle inequality of angles.  A task gives a spanning forest
of the links it found, never all of them.

A component may hold more links than those that built it: its members are
compared once more, tile by tile and exactly, and only counts of links leave a task.

Defined results
* a null label, a null or zero vector, or one with null, NaN or infinite components
  links with nothing: no links, its own component, kept
* vectors of different length never link; equal vectors do
* rows with a null id count as links of others; a component's name is its smallest
  id that is not null; kept is false where the id is null
* rows of one id are judged one by one; an empty table gives an empty result
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.graph import components, spanning
from tablewright.llm.work import Work, small_batches

COSINE = 0.98
BITS = 128
PASSES = 24
NEIGHBOURS = 16
BLOCK = 2048  # rows of one comparison task; the next block's first neighbours are added to it
DIFFERING = 30  # sketch bits; at cosine 0.98 the mean is 8 and the deviation 3
TILE = 512
WIDE = 1 << 23  # bytes of the vectors of a tile of all vectors; exhausted ones come to it in small tiles
SALTS = 16  # tasks that share the directions of one label's tiles
SLACK = 1e-6  # radians, far above the rounding of an angle in double precision
SEED = 7


@lru_cache(maxsize=8)
def directions(dim: int, bits: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, bits))


@lru_cache(maxsize=1)
def orders(bits: int, passes: int) -> np.ndarray:
    """For every pass the 64 signs, in their order, that make up its key."""
    rng = np.random.default_rng(SEED + 1)
    return np.array([rng.permutation(bits)[:64] for _ in range(passes)])


def _usable(vector) -> np.ndarray | None:
    if vector is None or None in vector:
        return None
    x = np.array(vector, np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def _prepared(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, vectors = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            digests, sketches, raws = [], [], []
            for label, vector in zip(labels, vectors):
                x = _usable(vector) if label is not None else None
                if x is None:
                    digests.append(None), sketches.append(None), raws.append(None)
                    continue
                raw = x.tobytes()
                digests.append(hashlib.blake2b(raw + repr(label).encode(), digest_size=16).digest())
                x = x / np.abs(x).max()  # no square of a very large or very small number
                sketches.append(np.packbits(x @ directions(len(x), bits) > 0).tobytes())
                raws.append(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(raws, pa.binary())],
                names=["id", "label", "class", "sketch", "vector"],
            )

    return run


def _keys(passes: int, bits: int):
    """One row per pass: the key is the sketch's signs in the order of the pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            signs = np.unpackbits(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, bits // 8), axis=1)
            for p, order in enumerate(orders(bits, passes)):
                key = np.ascontiguousarray(np.packbits(signs[:, order], axis=1)).view(">u8")[:, 0].astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.array(np.full(n, p, np.int32)), pa.array((key ^ np.uint64(1 << 63)).view(np.int64))],
                    names=["node", "kind", "sketch", "pass", "key"],
                )

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(row, row + n))], names=[*batch.schema.names, "row"])
        row += n


def _neighbours(width: int, differing: int):
    """Candidate pairs; a pair of a node with itself tells that its window is exhausted."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("rank")
        turn, kind, node = (table.column(c).to_numpy() for c in ("pass", "kind", "node"))
        n = len(node)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(n, -1) if n else np.zeros((0, 1), np.uint64)
        left, right = [], []
        for d in range(1, min(width, n - 1) + 1):
            near = (turn[d:] == turn[:-d]) & (kind[d:] == kind[:-d]) & (np.bitwise_count(sketch[d:] ^ sketch[:-d]).sum(axis=1) <= differing)
            i = np.flatnonzero(near)
            left.append(node[i]), right.append(node[i + d])
            if d == width:
                full = np.unique(np.concatenate([node[i], node[i + d]]))
                left.append(full), right.append(full)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _ranked(rows: DataFrame, work: Work, order: list, name: str = "ordered") -> DataFrame:
    """``rank`` of every row in the global order: its place in its range plus the sizes of the ranges before."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    stored = work.save(dealt.mapInArrow(_numbered, f"{schema}, row bigint"), name)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = stored.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return stored.join(work.save(sizes, f"{name}-ranges"), "part").withColumn("rank", F.col("row") + F.col("before")).drop("part", "row", "before")


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return (x @ y.T) / np.sqrt((x * x).sum(axis=1))[:, None] / np.sqrt((y * y).sum(axis=1))[None, :]


def _verify(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for u, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(u, np.float64), np.frombuffer(v, np.float64)
                good.append(len(x) == len(y) and _cosines(x[None], y[None])[0, 0] >= cosine)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _packed(rows: DataFrame, kinds: list[str], tile) -> DataFrame:
    """One row per tile: its nodes and vectors as bytes, one after the other."""
    grouped = rows.groupBy(*kinds, tile.alias("tile")).agg(F.collect_list(F.struct("node", "vector")).alias("rows"))
    kinds_of = ", ".join(f"{k} bigint" for k in [*kinds, "tile"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, vectors, centres, radii = [], [], [], []
            for rows in batch.column(batch.num_columns - 1).to_pylist():
                x = np.array([np.frombuffer(r["vector"], np.float64) for r in rows])
                nodes.append(np.array([r["node"] for r in rows], np.int64).tobytes()), vectors.append(x.tobytes())
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                centre = x.mean(axis=0)
                if not np.linalg.norm(centre) > 1e-9:
                    centre = x[0]
                centre = centre / np.linalg.norm(centre)
                centres.append(centre.tobytes()), radii.append(float(np.arccos(np.clip(x @ centre, -1, 1)).max()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(nodes, pa.binary()), pa.array(vectors, pa.binary()), pa.array(centres, pa.binary()), pa.array(radii, pa.float64())],
                names=[*batch.schema.names[:-1], "nodes", "vectors", "centre", "radius"],
            )

    return grouped.mapInArrow(run, f"{kinds_of}, nodes binary, vectors binary, centre binary, radius double")


def _close(cosine: float):
    """Pairs of tiles that may hold a link: their directions are no farther apart than both radii and the angle of a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8) for i in (3, 5)]
            lengths = np.array([len(c) for c in batch.column(3).to_pylist()])
            good, ends = np.zeros(batch.num_rows, bool), np.cumsum(lengths)
            radii = batch.column(4).to_numpy() + batch.column(6).to_numpy()
            for i, (end, size) in enumerate(zip(ends, lengths)):
                x, y = (a[end - size : end].view(np.float64) for a in at)
                good[i] = np.arccos(np.clip(x @ y, -1, 1)) <= radii[i] + np.arccos(cosine) + SLACK
            yield pa.RecordBatch.from_arrays(batch.columns[:3], names=["kind", "tile", "wide"]).filter(pa.array(good))

    return run


def _join_tiles(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                node, x, other, y = (np.frombuffer(batch.column(i)[row].as_buffer(), t) for i, t in enumerate((np.int64, np.float64) * 2))
                near = _cosines(x.reshape(len(node), -1), y.reshape(len(other), -1)) >= cosine
                near &= node[:, None] != other[None, :]
                a, b = np.nonzero(near)
                both = np.concatenate([node, other])
                a, b = (both[i] for i in spanning(len(both), a, b + len(node)))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _exhausted_links(exhausted: DataFrame, places: DataFrame, classes: DataFrame, work: Work, cosine: float) -> DataFrame:
    """Links of vectors with an exhausted window, against all vectors of their label and length.

    ``places`` holds every node with its kind and its rank in the first pass.
    """
    named = exhausted.join(places, "node")
    small = _ranked(named, work, ["kind", "rank_of", "node"], "exhausted").withColumn("tile", F.floor(F.col("rank") / TILE)).select("node", "kind", "tile")
    vectors = classes.select("node", "vector")
    with small_batches(work.spark, 16):
        tiles = work.save(_packed(small.join(vectors, "node"), ["kind"], F.col("tile")), "small-tiles")
        met = places.join(tiles.select("kind").distinct(), "kind", "left_semi").join(vectors, "node")
        # about WIDE bytes a tile, whatever the length of the vectors
        room = F.greatest(F.lit(1), F.floor(F.lit(WIDE) / F.length("vector")))
        wides = work.save(_packed(met, ["kind"], F.floor(F.col("rank_of") / room)), "wide-tiles")
    salt = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    x = tiles.select("kind", "tile", "centre", "radius", salt)
    y = wides.select("kind", F.col("tile").alias("wide"), F.col("centre").alias("to"), F.col("radius").alias("to_radius"), F.pmod("tile", F.lit(SALTS)).cast("int").alias("salt"))
    with small_batches(work.spark):
        both = x.join(y, ["kind", "salt"]).select("kind", "tile", "wide", "centre", "radius", "to", "to_radius")
        pairs = work.save(both.mapInArrow(_close(cosine), "kind bigint, tile bigint, wide bigint"), "tile-pairs")
    with small_batches(work.spark, 4):
        # the small tiles travel, a wide one stays where its key is
        sent = pairs.join(tiles.select("kind", "tile", "nodes", "vectors"), ["kind", "tile"])
        there = wides.select("kind", F.col("tile").alias("wide"), F.col("nodes").alias("others"), F.col("vectors").alias("to"))
        meeting = sent.join(there, ["kind", "wide"]).select("nodes", "vectors", "others", "to")
        links = work.save(meeting.mapInArrow(_join_tiles(cosine), "a bigint, b bigint").distinct(), "dense-links")
    work.drop("small-tiles", "wide-tiles", "tile-pairs")
    return links


def _count(cosine: float):
    """Links between two tiles of one component: for each vector, how many rows of the other tile link with it."""

    def side(rows):
        return (np.array([r["node"] for r in rows]), np.array([r["n"] for r in rows]), np.array([np.frombuffer(r["vector"], np.float64) for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, same in zip(batch.column(0), batch.column(1), batch.column(2)):
                node, n, x = side(left.as_py())
                other, m, y = (node, n, x) if same.as_py() else side(right.as_py())
                near = _cosines(x, y) >= cosine
                if same.as_py():
                    np.fill_diagonal(near, False)
                    nodes, links = node, near @ n
                else:
                    nodes, links = np.concatenate([node, other]), np.concatenate([near @ m, near.T @ n])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links.astype(np.int64))], names=["node", "links"])

    return run


def duplicates(rows: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", cosine=COSINE, passes=PASSES, neighbours=NEIGHBOURS) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector."""
    work = Work(rows.sparkSession, "vectors")
    id_kind, label_kind = (rows.schema[c].dataType.simpleString() for c in (id_col, label_col))
    slim = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    prepared = work.save(slim.mapInArrow(_prepared(BITS), f"id {id_kind}, label {label_kind}, class binary, sketch binary, vector binary"), "rows")
    classes = prepared.where("class is not null").groupBy("class").agg(
        F.min("id").alias("least"), F.count("*").alias("n"), F.min("sketch").alias("sketch"), F.min("vector").alias("vector"), F.min("label").alias("label")
    )
    classes = work.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    kind = F.xxhash64("label", F.length("vector"))
    keyed = classes.select("node", kind.alias("kind"), "sketch").mapInArrow(_keys(passes, BITS), "node bigint, kind bigint, sketch binary, pass int, key bigint")
    ranked = _ranked(keyed, work, ["pass", "kind", "key", "sketch", "node"])
    block, inside = F.floor(F.col("rank") / BLOCK), F.col("rank") % BLOCK
    blocks = F.when((inside < neighbours) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    dealt = ranked.select("node", "kind", "sketch", "pass", "rank", F.explode(blocks).alias("block"))
    candidates = work.save(dealt.groupBy("block").applyInArrow(_neighbours(neighbours, DIFFERING), "a bigint, b bigint").distinct(), "candidates")
    vectors = classes.select("node", "vector")
    both = candidates.where("a < b").join(vectors.select(F.col("node").alias("a"), F.col("vector").alias("u")), "a").join(vectors.select(F.col("node").alias("b"), F.col("vector").alias("v")), "b")
    links = work.save(both.select("a", "b", "u", "v").mapInArrow(_verify(cosine), "a bigint, b bigint"), "links")
    exhausted = candidates.where("a = b").select(F.col("a").alias("node"))
    if not exhausted.isEmpty():  # nothing would be added otherwise
        places = ranked.where("pass = 0").select("node", "kind", F.col("rank").alias("rank_of"))
        links = links.unionByName(_exhausted_links(exhausted, places, classes, work, cosine))
    work.drop("candidates", "ordered")

    groups = work.save(components(links, work), "groups")
    sizes = work.save(groups.groupBy("component").agg(F.count("*").alias("members")), "group-sizes")
    of = F.ceil(F.col("members") / TILE)
    tiles = groups.join(sizes, "component").join(classes.select("node", "n", "vector"), "node").groupBy("component", of.alias("of"), F.pmod(F.xxhash64("node"), of).alias("tile")).agg(
        F.collect_list(F.struct("node", "n", "vector")).alias("rows")
    )
    tiles = work.save(tiles, "tiles")
    # every tile goes to the next half of the ring of tiles, so each pair meets once and all tiles get alike many
    steps = F.floor(F.col("of") / 2) - F.when((F.col("of") % 2 == 0) & (F.col("tile") >= F.col("of") / 2), 1).otherwise(0)
    sent = tiles.withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), steps.cast("bigint"))))
    sent = sent.select("component", F.pmod(F.col("tile") + F.col("step"), F.col("of")).alias("tile"), F.col("rows").alias("left"), (F.col("step") == 0).alias("same"))
    with small_batches(work.spark, 16):
        counted = sent.join(tiles, ["component", "tile"]).select("left", F.col("rows").alias("right"), "same").mapInArrow(_count(cosine), "node bigint, links bigint")
        counts = work.save(counted.groupBy("node").agg(F.sum("links").alias("links")), "counts")
    work.drop("links", "dense-links", "tiles")

    named = classes.select("class", "node", "n", "least").join(groups, "node", "left").join(counts, "node", "left")
    named = work.save(named.select("class", F.coalesce("component", "node").alias("component"), "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "named")
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = work.save(named.join(names, "component").select("class", "n_links", "component_id"), "by-class")
    out = prepared.select("id", "class").join(by_class, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
