"""Language identification by compression.

A bounded sample of labelled texts gives each language a raw-content zstandard
dictionary.  Of a text the letters count,
lower-cased; it is cut into blocks, so that the dictionary counts in a long
text as much as in a short one; all blocks are compressed with every dictionary,
and the language with the fewest bytes wins.  The score is the share of bytes it saves
against the runner-up; a narrow margin is a rejection.

Defined results
* null text, or one without a letter: ``und``, score 0, rejected
* rows without a language or a letter teach nothing, repeated rows once; a null id is in the learning part, and
  held_out is false
* one learned language: score 1; none (empty table): ``und``; equal sizes: the first in code point order
* rows are judged one by one, so repeats and null ids get what their text gets;
  other columns are left alone
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.work import Work, text_key

UNKNOWN = "und"
SAMPLE_DOCS = 256  # bound of the learning sample: documents for each language …
SAMPLE_CHARS = 2000  # … and characters of each
BLOCK = 4096
MARGIN = 0.002
# short matches count here, so the matcher looks for four bytes and tries several places
CODER = {"window_log": 20, "chain_log": 17, "hash_log": 18, "search_log": 3, "min_match": 4, "target_length": 16, "strategy": zstandard.STRATEGY_GREEDY}
LEAD = bytes(128)  # before every block: a coder stores a tiny block as it is unless it can save some bytes
NO_LETTER = re.compile(r"[\W\d_]+")


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of the documents that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", sample_docs=SAMPLE_DOCS, sample_chars=SAMPLE_CHARS) -> dict[str, bytes]:
    """A dictionary for every language of the learning part.

    The sample is chosen by a hash of the id and the text, among the distinct ones whose text has a letter:
    a scan counts them for each label, a threshold for each label leaves about twice the sample, the lowest hashes of
    those are taken.  What comes to the driver is bounded by languages x documents x characters.
    """
    usable = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    labelled = usable.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(lang_col), text_key(text_col)).alias("h"))
    # stored, so that the join knows its size and need not shuffle texts by language
    counts = Work(docs.sparkSession, "languages").save(labelled.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")), "counts")
    part = F.shiftrightunsigned("h", 24)  # 0 … 2^40 - 1
    near = labelled.join(counts, "lang").where(part * F.col("n") < F.lit(float(2 * sample_docs * (1 << 40))))
    letter = rf"(?s)\p{{L}}.{{0,{sample_chars - 1}}}"  # from the first letter on, or a text may teach nothing
    excerpt = near.groupBy("lang", "h").agg(F.min(F.regexp_extract("text", letter, 0)).alias("text"))  # repeated rows teach once
    first = excerpt.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample_docs)
    found: dict[str, list] = {}
    for lang, r, text in first.select("lang", "r", "text").collect():
        found.setdefault(lang, []).append((r, text))
    return {lang: b"".join(letters(t) for _, t in sorted(found[lang])) for lang in sorted(found)}


def letters(text: str) -> bytes:
    """Words of lower-case letters, one space before and after each; empty if there is no letter."""
    words = f" {NO_LETTER.sub(' ', text.lower()).strip()} "
    return words.encode("utf-8", "replace") if words != "  " else b""


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], block: int = BLOCK):
        self.langs, self.block = list(dictionaries), block
        self.coders = []
        coder = zstandard.ZstdCompressionParameters(**CODER, write_content_size=False)
        for raw in dictionaries.values():
            words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=coder)
            self.coders.append(zstandard.ZstdCompressor(dict_data=words, compression_params=coder).compress)

    def __call__(self, text: str | None) -> tuple[str, float]:
        raw = letters(text) if text and self.langs else b""
        if not raw:
            return UNKNOWN, 0.0
        blocks = [LEAD + raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        sizes = [sum([len(coder(b)) for b in blocks]) for coder in self.coders]
        best = min(sizes)
        lang = self.langs[sizes.index(best)]
        sizes.remove(best)
        second = min(sizes, default=0)
        return lang, (second - best) / second if second else 1.0


def _judged(dictionaries: dict[str, bytes], texts: Callable[[pa.RecordBatch], pa.Array], keep: int):
    """The first ``keep`` columns of every batch, with the language and the score of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(dictionaries)
        for batch in batches:
            got = [judge(t.as_py()) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:keep], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=[*batch.schema.names[:keep], "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col="doc_id", text_col="text", margin=MARGIN) -> DataFrame:
    """(id, held_out, lang_pred, score, rejected) of every document."""
    slim = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = slim.mapInArrow(_judged(dictionaries, lambda batch: batch.column(2), 2), f"id {kind}, held_out boolean, lang_pred string, score double")
    rejected = (F.col("lang_pred") == UNKNOWN) | (F.col("score") < margin)
    return rows.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score", rejected.alias("rejected"))


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], text_col="text", margin=MARGIN) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose language is told clearly.

    A text travels to Python once, in its row.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([*whole.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = docs.columns.index(text_col)
    rows = whole.mapInArrow(_judged(dictionaries, lambda batch: batch.column(0).field(at), 1), schema)
    return rows.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= margin)).select("row.*")
