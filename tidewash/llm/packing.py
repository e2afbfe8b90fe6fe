"""Packing documents into sequences: tokens, pieces and hierarchical best-fit."""

from __future__ import annotations

import json
import re
import sys
import types
from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, parts_for, slices, staged

#: Items a first-level part packs; parts that one part of the next level takes over.
LEAF_ITEMS, FAN_IN = 16_384, 8
#: Bins with no more free tokens than this wait for the last round. A part hands on its emptiest bins, this many.
SLACK, HAND_ON = 16, 1024
#: Words a worker remembers.
WORDS = 200_000

# Scripts whose word boundaries and lower case need no more than the classes below; other texts go
# through the tokenizer whole. Letters, numerals and white space of these blocks:
LETTERS, NUMERALS, BLANKS = "a-zªµºß-öø-ÿĀ-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
PLAIN = re.compile("[\x00-\x1b\x20-įı-ɏ‐-‧‰-⁞]*")
UNITS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[{NUMERALS}]|[^{LETTERS}{NUMERALS}{BLANKS}]+")
GAP = re.compile("[\t-\r ]")
# The settings of the tokenizer for which the above holds.
NORMALIZER = ["NFC", ("Replace", "\\s+", " "), "Lowercase"]
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, … of every range, one after the other."""
    until = np.cumsum(counts)
    return np.arange(until[-1] if len(until) else 0) + np.repeat(starts - (until - counts), counts)


def splits_at_blanks(tokenizer) -> bool:
    """Whether a tokenizer has the normalising, the splitting and the word ends that ``WordIds`` counts on."""

    def settings(part) -> dict:
        return json.loads(part.__getstate__()) if part is not None else {}

    steps = settings(tokenizer.normalizer).get("normalizers", [])
    steps = [(s["type"], s["pattern"].get("Regex"), s["content"]) if s["type"] == "Replace" else s["type"] for s in steps]
    split = settings(tokenizer.pre_tokenizer).get("pretokenizers", [])
    model = tokenizer.model
    return (
        steps == NORMALIZER and [s["type"] for s in split] == ["Split", "ByteLevel"] and split[0]["pattern"].get("Regex") == SPLITTER
        and split[0].get("behavior") == "Removed" and bool(split[0].get("invert")) and not split[1]["add_prefix_space"] and not split[1]["use_regex"]
        and getattr(model, "end_of_word_suffix", None) == "</w>" and not getattr(model, "ignore_merges", True)
        and all(t.content.startswith("<|") for t in tokenizer.get_added_tokens_decoder().values())
    )


class WordIds:
    """Token ids of texts. Where the tokenizer splits at blanks, a word between them always gives the
    same ids, so each is tokenized once and looked up afterwards; the result is that of encoding the
    text as a whole, which is what other tokenizers do."""

    def __init__(self, vocabulary: str, words: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(vocabulary), words or WORDS
        ends = [t.endswith("</w>") for t, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])]
        self.ends = np.array(ends)
        self.by_words = splits_at_blanks(self.tokenizer)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.counts = array("I"), array("q"), array("q")
        self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keeps the half of the words that were looked up most."""
        words, ids = list(self.place), np.frombuffer(self.ids, np.uint32).copy()
        starts, counts = np.frombuffer(self.starts, np.int64).copy(), np.frombuffer(self.counts, np.int64).copy()
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: self.most // 2])
        starts, counts, uses = starts[kept], counts[kept], self.uses[kept]
        self.clear()
        self.place = dict(zip([words[i] for i in kept.tolist()], range(len(kept))))
        self.ids.frombytes(ids[_ranges(starts, counts)].tobytes())
        self.starts.frombytes((np.cumsum(counts) - counts).tobytes())
        self.counts.frombytes(counts.tobytes())
        self.uses = uses // 2

    def _learn(self, words: list[str]) -> None:
        """Tokenizes new words, many on a line. A unit of the tokenizer ends in a token that says so, and a
        word of letters only is one unit."""
        units = np.array([1 if w.isalpha() else len(UNITS.findall(w)) for w in words], np.int64)
        lines = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))
        ends = np.flatnonzero(self.ends[ids])[np.cumsum(units) - 1] + 1
        counts = np.diff(ends, prepend=0)
        self.place.update(zip(words, range(len(self.starts), len(self.starts) + len(words))))
        self.starts.frombytes((ends - counts + len(self.ids)).astype(np.int64).tobytes())
        self.counts.frombytes(counts.astype(np.int64).tobytes())
        self.ids.frombytes(ids.tobytes())

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts in the scripts of ``PLAIN``: their distinct words are looked up, then put in order."""
        split = pc.utf8_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        words = split.flatten()
        # A blank at either end of a text makes an empty word there.
        full = pc.not_equal(words, "")
        sizes = np.add.reduceat(np.append(full.to_numpy(zero_copy_only=False), False).astype(np.int64), split.offsets.to_numpy()[:-1]) if len(texts) else np.zeros(0, np.int64)
        coded = words.filter(full).dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.place.get, known))
        if None in found:
            self._learn([w for w, at in zip(known, found) if at is None])
            found = list(map(self.place.__getitem__, known))
        where, order = np.array(found, np.int64), coded.indices.to_numpy()
        at = where[order]
        counts = np.frombuffer(self.counts, np.int64)[at]
        ids = np.frombuffer(self.ids, np.uint32)[_ranges(np.frombuffer(self.starts, np.int64)[at], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(sizes)]
        self.uses = np.append(self.uses, np.zeros(len(self.place) - len(self.uses), np.int64))
        self.uses[where] += np.bincount(order, minlength=len(known))
        if len(self.place) > self.most:
            self._forget()
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; long texts are taken in portions that end before a blank."""
        if not self.by_words:
            return [self.whole(t) for t in texts]
        portions, owner = [], []
        for i, text in enumerate(texts):
            start = 0
            while start < len(text):
                end = start + (1 << 18)
                if end < len(text):
                    gap = GAP.search(text, end)
                    end = gap.start() if gap else len(text)
                portions.append(text[start:end])
                owner.append(i)
                start = end
        out: list[list[np.ndarray]] = [[] for _ in texts]
        plain = [PLAIN.fullmatch(p) is not None and "<|" not in p for p in portions]
        quick = iter(self.plain([p for p, ok in zip(portions, plain) if ok]))
        for i, p, ok in zip(owner, portions, plain):
            out[i].append(next(quick) if ok else self.whole(p))
        return [np.concatenate(x) if x else np.zeros(0, np.uint32) for x in out]


def _word_ids(vocabulary: str, words: int | None) -> WordIds:
    """The worker's own, kept between its tasks, but for the words."""
    kept = sys.modules.setdefault("_tidewash_words", types.ModuleType("_tidewash_words"))
    if getattr(kept, "asked", None) != (vocabulary, words):
        kept.words, kept.asked = WordIds(vocabulary, words), (vocabulary, words)
    return kept.words


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text", words: int | None = None) -> DataFrame:
    """``id, piece, start, length, ids, ids_crc32, item`` of every document, staged.

    A document is its token ids and then ``end_id``. Longer ones than ``capacity`` are cut into
    pieces of that length, the last may be shorter. ``ids`` holds little-endian 32-bit numbers.
    ``item`` numbers the pieces. A null or empty text is ``end_id`` alone.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _word_ids(vocabulary, words)
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                rows, number, start, length, ids = [], [], [], [], []
                for row, found in enumerate(known.encode([t or "" for t in part.column(1).to_pylist()])):
                    found = np.append(found, np.uint32(end_id)).astype("<u4")
                    for n, at in enumerate(range(0, len(found), capacity)):
                        some = found[at : at + capacity]
                        rows.append(row), number.append(n), start.append(at), length.append(len(some)), ids.append(some.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=names)
        known.clear()
        give_back()

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    cuts = rows.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids binary")
    return staged(cuts.withColumn("ids_crc32", F.crc32("ids")).withColumn("item", F.monotonically_increasing_id()))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin: longest items first, each into the
    open bin that it fills best."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_at, fill = 0, []  # bit f of open_at: some bin has f free
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = open_at >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            chosen = free[room].pop()
            if not free[room]:
                open_at ^= 1 << room
        else:
            chosen, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = chosen, fill[chosen]
        fill[chosen] += n
        if room > n:
            if not free[room - n]:
                open_at ^= 1 << (room - n)
            free[room - n].append(chosen)
    return bins, offsets, np.array(fill, np.int64)


def _packed(items: DataFrame, level: int, parts: int, capacity: int) -> DataFrame:
    """``item, bin, offset, fill, carried, part``: each part's items in bins of their own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        item, length = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(item)
        item, length, part = item[order], length[order], TaskContext.get().partitionId()
        bins, offsets, fill = best_fit(length, capacity)
        emptiest = np.argsort(fill, kind="stable")[:HAND_ON]
        carried = np.zeros(len(fill), bool)
        carried[emptiest] = capacity - fill[emptiest] > SLACK
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(bins + (level << 56) + (part << 32)), pa.array(offsets), pa.array(fill[bins]), pa.array(carried[bins]), pa.array(np.full(len(item), part, np.int32))],
            names=["item", "bin", "offset", "fill", "carried", "part"])

    return items.select("item", "length").mapInArrow(pack, "item long, bin long, offset long, fill long, carried boolean, part int")


def merged_counts(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of bins as items, by their fills alone: patterns of fills with the number of bins made so.

    Fullest first, each into the open bins that it fills best; bins of one fill are alike, so all that
    fit the same open bins go there at once.
    """
    free: list[list[list]] = [[] for _ in range(capacity + 1)]
    open_at = 0

    def put(pattern: tuple[int, ...], n: int) -> None:
        nonlocal open_at
        if n:
            room = capacity - sum(pattern)
            free[room].append([pattern, n])
            open_at |= 1 << room

    for fill in sorted(counts, reverse=True):
        left = counts[fill]
        while left:
            fitting = open_at >> fill
            if not fitting:  # bins of this fill alone, as many together as fit
                each = capacity // fill
                put((fill,) * each, left // each)
                put((fill,) * (left % each), 1 if left % each else 0)
                break
            room = fill + (fitting & -fitting).bit_length() - 1
            pattern, n = free[room][-1]
            some = min(left, n)
            free[room][-1][1] -= some
            if n == some:
                free[room].pop()
                if not free[room]:
                    open_at ^= 1 << room
            put((*pattern, fill), some)
            left -= some
    return [(pattern, n) for some in free for pattern, n in some]


def _last_round(bins: DataFrame, level: int, capacity: int) -> DataFrame | None:
    """``bin, up, shift``: the ``bin, fill`` rows that go into common bins, None if no two fit.

    All bins take part, however many: only their number for each fill is looked at, and bins of
    one fill are numbered part by part.
    """
    counts = {r["fill"]: r["count"] for r in bins.where(F.col("fill") < capacity).groupBy("fill").count().collect()}  # at most one for each fill
    ranges, taken, made = [], dict.fromkeys(counts, 0), 0
    for pattern, n in merged_counts(counts, capacity):
        if len(pattern) > 1:
            shift = 0
            for fill in pattern:
                ranges.append((fill, taken[fill], taken[fill] + n, (level << 56) + made - taken[fill], shift))
                taken[fill] += n
                shift += fill
            made += n
    if not ranges:
        return None
    places = bins.sparkSession.createDataFrame(ranges, "fill long, since long, until long, base long, shift long")
    part = F.shiftright("bin", 32)
    some = bins.join(F.broadcast(places.select("fill").distinct()), "fill").withColumn("_part", part)  # bounded by the fills
    sizes = some.groupBy("fill", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("fill").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("fill", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("fill", "_part").orderBy("bin")) - 1
    numbered = some.join(starts, ["fill", "_part"]).select("fill", "bin", (F.col("_start") + inside).alias("_place"))
    found = numbered.join(F.broadcast(places), "fill").where("_place >= since AND _place < until")
    return found.select("bin", (F.col("base") + F.col("_place")).alias("up"), "shift")


def pack(items: DataFrame, capacity: int = 4096) -> DataFrame:
    """``item, sequence_id, offset`` from ``item`` (long, distinct), ``length`` (1 to capacity).

    Parts of about ``LEAF_ITEMS`` items pack by best fit, longest first. A part's ``HAND_ON`` emptiest
    bins become items of the next level, where ``FAN_IN`` parts meet, and so on up to one part. A
    last round takes all bins that are not full, also those that no part handed on, by their numbers
    for each fill. Nothing is left out. Offsets have no gaps. No items give no rows.
    """
    parts = parts_for(items.count(), LEAF_ITEMS)
    placed = [staged(_packed(items.repartition(parts, F.xxhash64("item")), 1, parts, capacity))]
    while parts > 1 or len(placed) == 1:
        below, parts = placed[-1], parts_for(parts, FAN_IN)
        rest = below.where("carried AND offset = 0").select(F.col("bin").alias("item"), F.col("fill").alias("length"), F.floor(F.col("part") / FAN_IN).alias("node"))
        placed.append(staged(_packed(rest.repartition(parts, "node"), len(placed) + 1, parts, capacity)))
    ended = [level.where("offset = 0" if level is placed[-1] else "offset = 0 AND NOT carried").select("bin", "fill") for level in placed]
    last = _last_round(staged(reduce(DataFrame.union, ended)), len(placed) + 1, capacity)
    ups = [level.select(F.col("item").alias("bin"), F.col("bin").alias("up"), F.col("offset").alias("shift")) for level in placed[1:]]
    out = placed[0].select("item", "bin", "offset")
    for up in [*ups, *([] if last is None else [staged(last)])]:
        out = out.join(up, "bin", "left").select("item", F.coalesce("up", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    return out.withColumnRenamed("bin", "sequence_id")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text", words: int | None = None) -> DataFrame:
    """One row per piece: ``id, piece, start, length, ids, ids_crc32, sequence_id, offset``.

    The token ids of a sequence are its pieces' ``ids`` in order of ``offset``. A worker remembers ``words`` words. Repeated rows and
    identifiers give pieces of their own; a null identifier is kept. No rows give no rows.
    """
    cut = pieces(docs, vocabulary, capacity, end_id, id_column, text_column, words)
    return cut.join(pack(cut.select("item", "length"), capacity), "item").drop("item")
