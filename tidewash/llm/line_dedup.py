"""Line deduplication within an edit distance of one, by a deletion-neighbourhood join.

Built-in functions only. Lines are compared without outer white space and in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, staged

#: Shorter lines (in characters) have no neighbours by edits: brackets, headings, blank lines.
MIN_CHARS = 16
#: Characters of a window in which deletions are tried; longer lines have at most LONG windows.
WINDOW, LONG = 16, 256
#: Words of 64 bits of the filter that spares texts without a candidate line the shuffle.
FILTER_WORDS = 1 << 17


def _lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``file, row, id, pos, norm`` of every line long enough, with ``h, g``: 128 bits that name its text."""
    rows = docs.select("file", "row", F.col("doc")[id_column].alias("id"), F.col("doc")[text_column].alias("text"))
    rows = rows.select("file", "row", "id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    rows = rows.select("file", "row", "id", "pos", F.lower(F.btrim("line", F.lit(" \t\r\v\f"))).alias("norm"))
    return rows.withColumn("h", F.xxhash64("norm")).withColumn("g", F.xxhash64(F.lit(1), "norm"))


def _order() -> Column:
    return F.struct(F.col("id").isNull().alias("none"), "id", "file", "row", "pos")


def _half_keys(text: Column, length: Column) -> Column:
    """Two lines within one edit share one of these keys: with m the shorter length, an edit in the
    first half of m leaves the rest alike, a later one the start. A line is the shorter of a
    pair (m is its length) or the longer (one less)."""
    keys = []
    for m in (length, length - 1):
        half = F.floor(m / 2).cast("int") + 1
        tail = F.greatest(m - half, F.lit(0))
        keys += [F.xxhash64(m, F.lit(0), F.substring(text, length - tail + 1, tail)), F.xxhash64(m, F.lit(1), F.substring(text, F.lit(1), half))]
    return F.array(*keys)


def _shared(keyed: DataFrame, key: str) -> DataFrame:
    """Rows whose key another line has too. Keys are counted after partial aggregation, so a key
    of a third of all lines is one row per task; rows are only streamed past the keys found,
    in a join that can be split."""
    found = staged(keyed.groupBy(key).agg(F.min("h").alias("_a"), F.max("h").alias("_b")).where("_a <> _b").select(key))
    return keyed.join(found, key, "left_semi")


def _passing(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines whose hash may be among those wanted. The filter is a table of FILTER_WORDS rows at
    most, of fixed size, so it is broadcast; on huge inputs it fills up and lets more pass."""
    slot = F.pmod(F.shiftright("h", 6), F.lit(FILTER_WORDS))
    bit = F.expr("shiftleft(1L, CAST(h & 63 AS INT))")
    words = wanted.groupBy(slot.alias("_slot")).agg(F.bit_or(bit).alias("_bits"))
    return lines.withColumn("_slot", slot).join(F.broadcast(words), "_slot").where(F.col("_bits").bitwiseAND(bit) != 0).drop("_slot", "_bits")


def _windowed(candidates: DataFrame) -> DataFrame:
    """``m, key, middle`` of every window of each candidate line, as the shorter and as the longer
    of a pair: the key covers what lies before and behind the window."""
    rows = candidates.withColumn("length", F.length("norm")).withColumn("m", F.explode(F.array(F.col("length"), F.col("length") - 1)))
    rows = rows.withColumn("_w", F.greatest(F.lit(WINDOW), F.ceil(F.col("m") / LONG).cast("int")))
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / F.col("_w")).cast("int"))))
    tail = F.greatest(F.col("m") - (F.col("_i") + 1) * F.col("_w"), F.lit(0))
    start, text = F.col("_i") * F.col("_w"), F.col("norm")
    key = F.xxhash64("m", "_i", F.substring(text, F.lit(1), start), F.lit(0), F.substring(text, F.col("length") - tail + 1, tail))
    return rows.select("h", "g", "first", "m", (F.col("length") == F.col("m")).alias("shorter"), key.alias("key"), F.substring(text, start + 1, F.col("length") - tail - start).alias("middle"))


def _variants(windows: DataFrame) -> DataFrame:
    """``a, b``: 128 bits for each variant of a window. The longer line of a pair, less one letter, is
    the shorter as it stands; two of one length are alike without the letter at one place."""
    middle = F.col("middle")
    places = F.when(F.length(middle) > 0, F.sequence(F.lit(1), F.length(middle))).otherwise(F.array().cast("array<int>"))
    deleted = F.transform(places, lambda i: F.struct(F.when(F.col("shorter"), i).otherwise(0).alias("at"), F.concat(F.substring(middle, F.lit(1), i - 1), F.substring(middle, i + 1, F.length(middle))).alias("text")))
    as_is = F.when(F.col("shorter"), F.array(F.struct(F.lit(0).alias("at"), middle.alias("text")))).otherwise(F.array().cast("array<struct<at:int,text:string>>"))
    rows = windows.select("h", "g", "first", "shorter", "key", F.explode(F.concat(as_is, deleted)).alias("v"))
    return rows.select("h", "g", "first", "shorter", (F.col("v.at") > 0).alias("replaced"), F.xxhash64("key", "v.at", "v.text").alias("a"), F.xxhash64("v.text", "v.at", "key").alias("b"))


def _links(variants: DataFrame) -> DataFrame:
    """``h, g`` of lines with the ``h, g`` of an earlier line (``eh, eg``) that shares a variant: the
    earliest of those the variant makes neighbours. No pairs within a group are made: each
    member meets at most the earliest line of either role."""
    me = F.struct("first", "h", "g")
    earliest = variants.groupBy("a", "b").agg(F.min(F.when(F.col("shorter"), me)).alias("s"), F.min(F.when(~F.col("shorter"), me)).alias("l"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = variants.join(staged(earliest), ["a", "b"])
    partner = F.when(F.col("replaced") | ~F.col("shorter"), F.col("s")).otherwise(F.col("l"))
    met = met.withColumn("p", partner).where(F.col("p").isNotNull() & (F.col("p.first") < F.col("first")))
    return met.select("h", "g", F.col("p.h").alias("eh"), F.col("p.g").alias("eg")).distinct()


def dropped_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """``file, row, dropped`` (sorted positions) of :func:`~.common.numbered` documents that lose lines.

    A line is dropped if an earlier one (by identifier, null last, then place in the input, then
    position; kept or not) is equal or one edit away: a character inserted, removed or replaced.

    Equal lines meet by hash. Of the distinct lines, those that share a half with another are
    candidates; of these, windows whose surroundings are shared; of these windows all single
    deletions are emitted as hashed keys. Lines that share one are verified by their edit
    distance. Both filters keep every pair within one edit, so nothing is lost to them.
    Only lines of ``min_chars`` have near neighbours; equal lines are dropped from ``exact_chars``
    on (``min_chars`` if None).
    """
    near_ones = F.length("norm") >= min_chars
    lines = _lines(docs, id_column, text_column).where(F.length("norm") >= min(min_chars, min_chars if exact_chars is None else exact_chars))
    keys = F.when(near_ones, _half_keys(F.col("norm"), F.length("norm"))).otherwise(F.array().cast("array<bigint>"))
    found = lines.select("h", "g", _order().alias("first"), keys.alias("keys")).groupBy("h", "g")
    texts = staged(found.agg(F.min("first").alias("first"), F.first("keys").alias("keys"), F.count("*").alias("copies")))
    wanted = staged(_shared(texts.select("h", "g", F.explode("keys").alias("key")), "key").select("h", "g").distinct())
    candidates = _passing(lines.where(near_ones), wanted).groupBy("h", "g").agg(F.min(_order()).alias("first"), F.first("norm").alias("norm")).join(wanted, ["h", "g"], "left_semi")
    candidates = staged(candidates)
    windows = _shared(_windowed(candidates), "key")
    links = _links(staged(_variants(windows)))
    near = (
        links.join(candidates.select("h", "g", "norm"), ["h", "g"])
        .join(candidates.select(F.col("h").alias("eh"), F.col("g").alias("eg"), F.col("norm").alias("earlier")), ["eh", "eg"])
        .where(F.levenshtein("norm", "earlier", 1) >= 0).select("h", "g").distinct().withColumn("near", F.lit(True))
    )
    # Only lines with copies or a near neighbour lose any; a line of a third of all documents is one row here.
    decided = staged(texts.select("h", "g", "first", "copies").join(near, ["h", "g"], "left").where("near OR copies > 1").drop("copies"))
    places = lines.select("h", "g", "file", "row", "pos").join(decided, ["h", "g"])
    gone = places.where(F.col("near") | (F.col("first.file") != F.col("file")) | (F.col("first.row") != F.col("row")) | (F.col("first.pos") != F.col("pos")))
    # A document's own lines, so no longer than the document.
    return gone.groupBy("file", "row").agg(F.sort_array(F.collect_list("pos")).alias("dropped"))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """The documents without the lines of :func:`dropped_lines`; other columns stay as they are.

    A document may lose all lines and keeps an empty text. Null texts stay null. No rows give
    no rows. Lines shorter than ``exact_chars`` (``min_chars`` if None) stay.
    """
    rows = numbered(docs)
    rows = rows.join(dropped_lines(rows, id_column, text_column, min_chars, exact_chars), ["file", "row"], "left")
    text = F.col("doc")[text_column]
    # One pass over the lines and one over the positions, also where a text loses very many.
    parts = F.array(F.struct(F.split(text, "\n").alias("lines"), F.col("dropped")))
    kept = F.transform(parts, lambda p: F.transform(F.array_except(F.sequence(F.lit(0), F.size(p["lines"]) - 1), p["dropped"]), lambda i: F.get(p["lines"], i)))
    text = F.when(F.col("dropped").isNull(), text).otherwise(F.array_join(F.get(kept, F.lit(0)), "\n"))
    return rows.select(F.col("doc").withField(text_column, text).alias("doc")).select("doc.*")
