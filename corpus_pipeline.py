"""A corpus pipeline: toxic documents go, repeated lines go, one of each group of near copies stays,
sources are mixed by weight, and what is left is packed into sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``docs``. A stage's input is what the one before it wrote.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewash.llm import line_dedup, minhash, mixing, packing, toxicity
from tidewash.llm.common import Leftovers, numbered, small_batches, staged, table

#: Groups of near copies and documents by shuffled order: no stage of these can be said in SQL.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """:func:`numbered` rows with ``key``, which tells rows with one identifier apart and orders by
    identifier, nulls last, then by place in the input."""
    return numbered(docs).withColumn("key", F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("id"), "file", "row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5. Labels of every fifth identifier (by CRC-32) are
    not learned from."""
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn)
    return toxicity.score(docs, model).where("score < 0.5").select("doc.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line equals or, from 16 characters, misses by one edit.
    Blank lines stay."""
    return line_dedup.dedup_lines(docs, exact_chars=1)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest identifier of each group that links of near copies connect:
    Jaccard similarity of 0.8 or more by five-word shingles, confirmed on whole sets. SimHash fingerprints
    in the vantage-point tree find those that differ in three bits or fewer, min-max hashing the
    others. Of documents without words one stays."""
    rows = _keyed(docs)
    found = minhash.near_duplicates(rows.select("key", F.col("doc.text").alias("text")), "key", width=5, percent=80, within=3)
    found = staged(found)
    wordless = found.where("n_shingles = 0").agg(F.min("id").alias("id")).where("id IS NOT NULL")
    kept = found.where("kept AND n_shingles > 0").select("id").union(wordless).select("id.file", "id.row")
    return rows.join(kept, ["file", "row"], "left_semi").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each time it takes them."""
    rows = numbered(docs)
    flat = rows.select("doc.doc_id", "doc.source", mixing.word_count(F.col("doc.text")).alias("words"), "file", "row")
    taken = mixing.mix(flat, F.col("words"), carry=("file", "row")).where("taken > 0")
    times = taken.select("file", "row", (F.col("taken") / F.col("size")).cast("int").alias("times"))
    mixed = rows.join(times, ["file", "row"])
    return mixed.select("doc", F.explode(F.sequence(F.lit(1), "times"))).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens."""
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), words=120_000)  # workers also serve other stages
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


_leftovers = Leftovers()


def _stage(work):
    """The stage, which first deletes what the one before it staged for itself: its result is written.
    The session's Arrow batches are bounded from then on, as whole documents go through workers."""

    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _leftovers.begin(docs)
        small_batches(spark)
        out = work(spark, docs, sf_dir)
        _leftovers.end()
        return out

    return stage


STAGES = [
    ("toxicity", _stage(drop_toxic)), ("line_dedup", _stage(drop_repeated_lines)), ("near_copies", _stage(drop_near_copies)),
    ("mixing", _stage(mix_sources)), ("packing", _stage(pack)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
