"""One query for every operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import byte_bpe, conversations, decontamination, language, licenses, manifest, mixing, pages, simhash, substrings, tokens, vectors
from tablewright.llm.work import Work

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.every_item(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_found", "containment")


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.without_repeats(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.classes(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predict(docs, language.learn(docs))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(_table(spark, sf_dir, "pages"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.without_later_copies(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.duplicates(_table(spark, sf_dir, "embeddings"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Work(spark, "op10").path("ids")
    tokens.write(_table(spark, sf_dir, "documents"), path)
    return tokens.digest(spark, path)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents")))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(chosen, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest.verified(_table(spark, sf_dir, "documents"), changed={"text": tampered})


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with the faults that the repair is to find."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(told[0], F.lit(":"), told[1]).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", told[2].alias("role"), told[3].alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    done = conversations.repair(damaged(turns))
    sums = conversations.digests(conversations.repaired(done)).withColumnRenamed("conv", "c")
    counts = done.counts.join(sums, F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")
    every = turns.select("conv_id").distinct().join(counts, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_mix_sources, op2_decontaminate, op3_repeated_passages, op4_simhash, op5_language, op6_licenses, op7_main_text, op8_suffix_dedup, op9_vector_duplicates, op10_token_files, op11_byte_bpe, op12_merkle_manifest, op13_repair_conversations)
}

SHINGLES_SQL = """
  SELECT {id} AS id, list_distinct(CASE WHEN len(w) >= 5 THEN
      [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] ELSE [array_to_string(w, ' ')] END) AS s
  FROM (SELECT {id}, [x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM {table}) WHERE len(w) > 0"""

FIELD_SQL = "coalesce(octet_length(encode({x}))::VARCHAR || ':' || {x}, '-')"
LEAF_SQL = "sha256(" + " || ".join(FIELD_SQL.format(x=x) for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "({text})")) + ")"
# bit by bit: a digit of the number is taken in, then seven zeros
CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split({x}, '')])),
  lambda a, b: (xor(a, b) >> 1) * (1 - (xor(a, b) & 1)) + xor(xor(a, b) >> 1, 3988292384) * (xor(a, b) & 1)))"""

SQL: dict[str, str] = {
    "op2_decontaminate": f"""
WITH d AS ({SHINGLES_SQL.format(id='doc_id', table='documents')}),
     i AS ({SHINGLES_SQL.format(id='item_id', table='benchmark')}),
     ds AS (SELECT id, unnest(s) AS x FROM d), s AS (SELECT id, len(s) AS q, unnest(s) AS x FROM i)
SELECT ds.id AS doc_id, s.id AS item_id, any_value(q) AS n_shingles, count(*) AS n_found, count(*) / any_value(q) AS containment
FROM ds JOIN s USING (x) GROUP BY ALL HAVING count(*) >= 0.8 * any_value(q)""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE
d AS (SELECT doc_id, source, {LEAF_SQL.format(text='text')} AS leaf,
        {LEAF_SQL.format(text=f"CASE WHEN {CRC_SQL.format(x='doc_id::VARCHAR')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS anew FROM documents),
l AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS rid, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
nodes AS (SELECT tree, 0 AS level, pos, leaf AS h, n FROM l
  UNION ALL SELECT tree, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 3, n),
subroots AS (SELECT tree, h FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, tree AS pos, h, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, pos // 3, n),
runs AS (SELECT tree, level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM (FROM nodes UNION ALL SELECT -1, level, pos, h, n FROM tops) GROUP BY ALL),
up AS (SELECT rid, tree, 0 AS level, pos, n, anew AS folded, '' AS proof FROM l
  UNION ALL SELECT rid, up.tree, up.level + 1, pos // 3, (n + 2) // 3,
    sha256(array_to_string(hs[:pos % 3], '') || folded || array_to_string(hs[pos % 3 + 2:], '')), proof || array_to_string(hs[:pos % 3], '') || array_to_string(hs[pos % 3 + 2:], '')
  FROM up JOIN runs r ON r.tree = up.tree AND r.level = up.level AND r.run = up.pos // 3 WHERE n > 1),
over AS (SELECT rid, 0 AS level, tree AS pos, (SELECT count(*) FROM subroots) AS n, folded, proof FROM up WHERE n = 1
  UNION ALL SELECT rid, over.level + 1, pos // 3, (n + 2) // 3,
    sha256(array_to_string(hs[:pos % 3], '') || folded || array_to_string(hs[pos % 3 + 2:], '')), proof || array_to_string(hs[:pos % 3], '') || array_to_string(hs[pos % 3 + 2:], '')
  FROM over JOIN runs r ON r.tree = -1 AND r.level = over.level AND r.run = over.pos // 3 WHERE n > 1)
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.h AS verified
FROM l JOIN over USING (rid) JOIN subroots s USING (tree), (SELECT h FROM tops WHERE n = 1) t WHERE over.n = 1""",
}
