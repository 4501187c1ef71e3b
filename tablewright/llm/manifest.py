"""Merkle manifest of a dataset: leaves, subroots by source, one root, and a proof for every row.

A row's leaf is the hash of its fields.  The leaves of a source, in order of id, are hashed in
runs of three until one node is left, its subroot; the subroots, in order of source, give the root.

Built levels are stored as node rows, each with a link to its parent: a row stands for one node six levels
up and holds the hashes of the (at most 729, 243, … and 3) nodes below it.  A recursive query
ascends from every leaf along these links.  Each step appends the siblings of these levels to the
proof and folds the leaf that was computed anew, so what it ends with is the root if and only if nothing was changed.
Six levels a step, as Spark stores the rows of every step: with one level a row would be stored a dozen times.

Rows are numbered by ranges: their place in a range plus the sizes of the ranges before; no task sees a whole
source.  Texts stay where they are read; what travels are ids and hashes.

Defined results
* a field that is null counts as ``-``, so it differs from an empty one; texts are hashed whole
* null sources come first and are a source of their own; null ids come first in theirs
* rows of one id are leaves of their own, ordered by hash; which of two equal rows stands first changes nothing
* a source of one row has that leaf as subroot, one source alone gives the root; a proof without
  siblings is the hash of the empty string; an empty table gives an empty result
* other columns are not read, whatever their names
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.work import Work

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 3
DEPTH = 6  # levels in one stored node row
SPAN = RUN**DEPTH  # nodes below it
ROOTS = -1  # the tree over the subroots
ROW = (1 << 33) - 1  # monotonically_increasing_id: row in the lower 33 bits, partition above


@dataclass(frozen=True)
class Manifest:
    """``leaves`` at the first step of their ascent, and the stored node rows above them."""

    leaves: DataFrame
    nodes: DataFrame
    work: Work


def digest(fields: list[Column]) -> Column:
    """Hash of values, each as its size in bytes and itself, or as a dash."""
    told = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*told), 256)


def _numbered(rows: DataFrame, order: list[Column], work: Work, name: str) -> DataFrame:
    """``place`` of every row in the order."""
    stored = work.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), name)
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit(ROW))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    sizes = work.save(sizes, f"{name}-ranges")
    return stored.withColumn("part", part).join(sizes, "part").withColumn("place", F.col("before") + row).drop("part", "before", "at")


def _up(hashes: Column) -> Column:
    """The level above: a hash of every run."""
    runs = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / RUN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(hashes, i * RUN + 1, F.lit(RUN)), ""), 256))


def _blocks(rows: DataFrame, hashed: Column) -> DataFrame:
    """Node rows over (tree, place, total, kid): the hashes of each level, the top and the number of levels.

    ``total`` counts the nodes of the tree on the level of the kids; a tree ends where one node is left.
    """
    whole = rows.groupBy("tree", F.floor(F.col("place") / SPAN).alias("block")).agg(
        F.first("total").alias("total"), F.transform(F.sort_array(F.collect_list(F.struct("place", "kid"))), lambda k: k["kid"]).alias("kids")
    )
    levels = F.lit(DEPTH)
    for j in reversed(range(DEPTH)):
        levels = F.when(F.col("total") <= RUN**j, j).otherwise(levels)
    whole = whole.withColumn("levels", levels)
    steps = F.when(F.col("levels") > 0, F.sequence(F.lit(1), F.col("levels"))).otherwise(F.array().cast("array<int>"))
    grown = F.aggregate(steps, F.array(hashed), lambda built, _: F.concat(built, F.array(_up(F.element_at(built, -1)))))
    return whole.withColumn("hashes", grown).withColumn("top", F.element_at("hashes", -1)[0])


def _linked(blocks: DataFrame, step: int) -> DataFrame:
    """The parent's address: one step up in the tree, or the tree over the subroots, or none above the root."""
    more, sub = F.col("total") > SPAN, F.col("tree") >= 0
    own = F.when(more, F.col("block")).when(sub, F.col("tree"))
    return blocks.withColumn("step", F.lit(step)).withColumn("up_tree", F.when(more, F.col("tree")).when(sub, F.lit(ROOTS).cast("long"))).withColumn(
        "up_step", F.when(more, F.lit(step + 1)).when(sub, F.lit(0))
    ).withColumn("up_block", F.floor(own / SPAN)).withColumn("up_index", (own % SPAN).cast("int"))


def _rounds(total: int) -> int:
    rounds = 1
    while SPAN**rounds < total:
        rounds += 1
    return rounds


def build(docs: DataFrame, fields=FIELDS, id_col="doc_id", group_col="source", changed: dict[str, Column] | None = None) -> Manifest:
    """Store the manifest of ``docs``.

    ``changed`` gives the fields whose value is another one where the leaf is computed anew.
    """
    work = Work(docs.sparkSession, "manifest")
    plain = {c: F.col(f"`{c}`") for c in fields}
    rows = docs.select(
        F.col(f"`{group_col}`").cast("string").alias("grouping"), F.col(f"`{id_col}`").alias("id"), F.unhex(digest(list(plain.values()))).alias("leaf"),
        F.unhex(digest([(changed or {}).get(c, plain[c]) for c in fields])).alias("anew"), F.monotonically_increasing_id().alias("read"),
    )
    rows = rows.withColumn("anew", F.when(F.col("anew") != F.col("leaf"), F.col("anew")))
    order = [F.col("grouping").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("read")]
    placed = _numbered(rows, order, work, "leaves")
    groups = work.save(placed.groupBy("grouping").agg(F.min("place").alias("from"), F.count("*").alias("total")), "groups")
    trees = _numbered(groups, [F.col("from")], work, "groups-in-order").withColumnRenamed("place", "tree")
    trees = work.save(trees, "trees")
    most, n_trees = trees.agg(F.coalesce(F.max("total"), F.lit(0)), F.count("*")).first()
    g = trees.select(F.col("grouping").alias("g"), "from", "total", "tree")
    kid = F.struct("id", "leaf", "anew").alias("kid")
    kids = placed.join(g, F.col("grouping").eqNullSafe(F.col("g"))).select("tree", "total", (F.col("place") - F.col("from")).alias("place"), kid)
    hashes = F.transform("kids", lambda k: F.lower(F.hex(k["leaf"])))
    low = work.save(_linked(_blocks(kids, hashes), 0), "blocks")

    stored: list[DataFrame] = []

    def climb(blocks: DataFrame, total: int, name: str) -> DataFrame:
        """Store the steps above the first one; the tops of trees that end are returned."""
        ends = [blocks.where(F.col("total") <= SPAN).select("tree", "top")]
        for step in range(1, _rounds(total)):
            above = blocks.where(F.col("total") > SPAN).select("tree", F.col("block").alias("place"), F.ceil(F.col("total") / SPAN).alias("total"), F.col("top").alias("kid"))
            blocks = work.save(_linked(_blocks(above, F.col("kids")), step).drop("kids"), f"{name}-{step}")
            stored.append(blocks)
            ends.append(blocks.where(F.col("total") <= SPAN).select("tree", "top"))
        out = ends[0]
        for e in ends[1:]:
            out = out.unionByName(e)
        return out

    subroots = climb(low, most, "steps")
    over = subroots.select(F.lit(ROOTS).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(n_trees).cast("long").alias("total"), F.col("top").alias("kid"))
    first = work.save(_linked(_blocks(over, F.col("kids")), 0).drop("kids"), "roots-0")
    stored.append(first)
    climb(first, n_trees, "roots")
    nodes = stored[0]
    for s in stored[1:]:
        nodes = nodes.unionByName(s)
    return Manifest(low, work.save(nodes, "nodes"), work)


def _ascent(proof: str, folded: str, index: str) -> str:
    """SQL for the siblings of a node row's levels appended to ``proof``, and for ``folded`` hashed with them; all are bytes."""
    place = f"({index} div bigint(pow({RUN}, j)))"
    left = f"array_join(slice(hashes[j], int({place} - {place} % {RUN} + 1), int({place} % {RUN})), '')"
    right = f"array_join(slice(hashes[j], int({place} + 2), int({RUN - 1} - {place} % {RUN})), '')"
    steps = "CASE WHEN levels > 0 THEN sequence(0, levels - 1) ELSE CAST(array() AS array<int>) END"
    return (
        f"concat({proof}, unhex(array_join(transform({steps}, j -> concat({left}, {right})), ''))) AS proof, "
        f"aggregate({steps}, {folded}, (x, j) -> unhex(sha2(concat({left}, lower(hex(x)), {right}), 256))) AS folded"
    )


def proofs(manifest: Manifest) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded) of every leaf, as bytes; proof holds the siblings from leaf to root.

    ``folded`` is what the leaf computed anew gives with the siblings as stored.
    """
    spark, work = manifest.leaves.sparkSession, manifest.work
    tag = work.root.rsplit("-", 1)[1]
    manifest.leaves.createOrReplaceTempView(f"leaves_{tag}")
    manifest.nodes.createOrReplaceTempView(f"nodes_{tag}")
    root = manifest.nodes.where("up_tree IS NULL").select("top").first()
    ends = f"CASE WHEN up_tree = {ROOTS} AND {{tree}} >= 0 THEN unhex(top) END"
    at_leaf = _ascent("X''", "coalesce(k.anew, k.leaf)", "i").replace(" AS proof, ", ", 'folded', ").removesuffix(" AS folded")
    climb = f"""
WITH RECURSIVE climb AS (
  SELECT kid.id, kid.leaf, {ends.format(tree='tree')} AS subroot, kid.proof, kid.folded, up_tree AS tree, up_step AS step, up_block AS block, kid.index
  FROM (SELECT tree, top, up_tree, up_step, up_block, explode(transform(kids, (k, i) -> named_struct('id', k.id, 'leaf', k.leaf, 'index', up_index, 'proof', {at_leaf}))) AS kid
        FROM leaves_{tag})
  UNION ALL
  SELECT c.id, c.leaf, coalesce(c.subroot, {ends.format(tree='n.tree')}), {_ascent("c.proof", "c.folded", "c.index")}, n.up_tree, n.up_step, n.up_block, n.up_index
  FROM climb c JOIN nodes_{tag} n ON c.tree = n.tree AND c.step = n.step AND c.block = n.block
)
SELECT id, leaf, subroot, unhex('{root.top if root else ""}') AS root, proof, folded FROM climb WHERE tree IS NULL"""
    limit = "spark.sql.cteRecursionRowLimit"
    held = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # rows grow with the leaves; the depth is what bounds the recursion
    try:
        return work.save(spark.sql(climb), "proofs")
    finally:
        spark.conf.set(limit, held)
        spark.catalog.dropTempView(f"leaves_{tag}"), spark.catalog.dropTempView(f"nodes_{tag}")


def verified(docs: DataFrame, fields=FIELDS, id_col="doc_id", group_col="source", changed: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    manifest = build(docs, fields, id_col, group_col, changed)
    rows = proofs(manifest)
    manifest.work.drop("leaves", "leaves-ranges", "groups", "groups-in-order", "groups-in-order-ranges", "trees", "blocks")
    told = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return rows.select(
        F.col("id").alias(id_col), *told, F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), F.lower(F.hex("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified")
    )
