"""Near-duplicate detection by min-max hashing: banded sketches, links confirmed on whole sets."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import discard, numbered, slices, staged
from .components import components

#: Hashes that one band joins: the smallest and the largest under each of half as many permutations.
ROWS = 6
#: Chance that two documents exactly at the threshold share no band, which sets the number of bands.
MISS = 1e-9
#: Pairs of one set that a task tests against a pivot; sets that a task compares with each other, on either side,
#: and the hashes they hold together, at most (but for a longer single set).
PORTION, BLOCK, HASHES = 256, 512, 1 << 20
SEED = 42
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def shingle_set(text: bytes, width: int = 3, chunk: int = 1 << 20) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles, ASCII letters lower-cased. Fewer words than
    ``width`` are one shingle, none give none. Long texts are read in chunks, whole."""
    found, words, start = [], [], 0
    while start < len(text):
        end = start + chunk
        if end < len(text):
            space = SPACE.search(text, end)
            end = space.start() if space else len(text)
        words += text[start:end].lower().split()
        start = end
        if len(words) >= width:
            joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
            starts = [0, *ends[: len(words) - width].tolist()]
            hashes = (xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :].tolist()))
            found.append(np.unique(np.fromiter(hashes, np.uint64, len(words) - width + 1)))
            words = words[len(words) - width + 1 :] if width > 1 else []
    if not found:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    return np.unique(np.concatenate(found))


class Sketch:
    """Band keys of sets. A permutation is an exclusive or and a multiplication by an odd number; its
    smallest and its largest value over the set both agree with the chance that is the sets'
    Jaccard similarity, so each permutation serves twice."""

    def __init__(self, bands: int):
        n = bands * ROWS // 2
        words = np.array([xxhash.xxh64_intdigest(b"permutation %d" % i, SEED) for i in range(2 * n)], np.uint64)
        self.bands, self.mask, self.factor = bands, words[:n, None], words[n:, None] | np.uint64(1)

    def keys(self, hashes: np.ndarray) -> list[int]:
        low, high = np.full(len(self.mask), 2**64 - 1, np.uint64), np.zeros(len(self.mask), np.uint64)
        for i in range(0, len(hashes), 512):
            mixed = (hashes[None, i : i + 512] ^ self.mask) * self.factor
            np.minimum(low, mixed.min(axis=1), out=low)
            np.maximum(high, mixed.max(axis=1), out=high)
        rows = np.stack([low, high], axis=1).reshape(self.bands, ROWS)
        return [xxhash.xxh64_intdigest(row.tobytes(), band) - 2**63 for band, row in enumerate(rows)]


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS)) if percent < 100 else 1


def _sketches(rows: DataFrame, width: int, bands: int, prints: bool) -> DataFrame:
    """``file, row, id, n, digest, keys, fp``; digest (128 bits of the whole set), keys and fp (the set's SimHash
    fingerprint, if ``prints``) are null for no words."""
    kind = rows.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Sketch(bands)
        for batch in batches:
            for part in slices(batch, 3):
                sets = [shingle_set(t or b"", width) for t in part.column(3).to_pylist()]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                keys = [made.keys(s) if len(s) else None for s in sets]
                fps = [simhash.majority(s) if prints and len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(fps, pa.int64())],
                    names=["file", "row", "id", "n", "digest", "keys", "fp"])

    return rows.select("file", "row", "id", "text").mapInArrow(sketch, f"file long, row long, id {kind}, n long, digest binary, keys array<long>, fp long")


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """``node, set``, the whole shingle sets (signed, in the order of the unsigned numbers)."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                sets = [shingle_set(t or b"", width).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    return rows.select("node", "text").mapInArrow(whole, "node long, set array<long>")


def _star_links(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``u, v`` pairs that are links. A ``v`` of many pairs is sent in as many copies as its pairs make
    portions, so no task takes all of them."""
    sizes = stars.groupBy("v").agg(F.ceil(F.count("*") / PORTION).alias("portions"))
    portion = F.pmod(F.xxhash64("u"), F.col("portions"))
    left = stars.join(sizes, "v").select("u", "v", portion.alias("portion")).join(sets.select(F.col("node").alias("u"), F.col("set").alias("_u")), "u")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1))
    right = sizes.select("v", each.alias("portion")).join(sets.select(F.col("node").alias("v"), F.col("set").alias("_v")), "v")
    common = F.size(F.array_intersect("_u", "_v"))
    return left.join(right, ["v", "portion"]).where(common * (100 + percent) >= percent * (F.size("_u") + F.size("_v"))).select("u", "v")


def _linked(table: pa.Table, percent: int) -> pa.Table:
    """Links between queries and members of one bucket that join different components. A pair with several
    buckets in common is tested in the first of them only."""
    cells = {n: table.column(n).to_numpy(zero_copy_only=False) for n in ("node", "root", "n", "query")}
    keys, key = np.array(table.column("keys").to_pylist(), np.int64), table.column("key")[0].as_py()
    sets = [np.asarray(s) for s in table.column("set").to_numpy(zero_copy_only=False)]
    _, label = np.unique(cells["root"], return_inverse=True)
    n, found = cells["n"], []
    members = np.flatnonzero(~cells["query"])
    for q in np.flatnonzero(cells["query"]).tolist():
        fits = (100 * np.minimum(n[q], n[members]) >= percent * np.maximum(n[q], n[members])) & (label[members] != label[q])
        some = members[fits]
        same = keys[some] == keys[q]
        some = some[keys[q][same.argmax(axis=1)] == key] if len(some) else some
        for m in some.tolist():
            if label[m] != label[q]:
                common = len(np.intersect1d(sets[q], sets[m], assume_unique=True))
                if common * (100 + percent) >= percent * (n[q] + n[m]):
                    found.append((cells["node"][q], cells["node"][m]))
                    label[label == label[m]] = label[q]
    u, v = zip(*found) if found else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _fits(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can be links."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _close_classes(nodes: DataFrame, within: int) -> DataFrame:
    """``node, n, class``: the class of a node is the least fingerprint that chains of fingerprints reach, each
    ``within`` bits of the next, by the vantage-point tree. So all pairs that close share a class."""
    prints = staged(nodes.select("fp").distinct())
    roots = components(simhash.links(prints, within)).select(F.col("node").alias("fp"), "root")
    return nodes.join(roots, "fp", "left").select("node", "n", F.coalesce("root", "fp").alias("class"))


def _in_classes(classed: DataFrame) -> DataFrame:
    """``key, node, n, pivot`` of the classes of several nodes, like :func:`_central`: the pivot is the first node."""
    firsts = classed.groupBy("class").agg(F.count("*").alias("_m"), F.min(F.struct("node", "n")).alias("pivot")).where("_m > 1")
    return classed.join(firsts, "class").select(F.col("class").alias("key"), "node", "n", "pivot")


def _central(members: DataFrame) -> DataFrame:
    """``key, node, n, pivot``: the pivot of a bucket is its node that meets the most nodes in all of its
    buckets, as ``node, n``. Near copies of one text share the pivot that is nearest to all of them."""
    sizes = members.groupBy("key").agg(F.count("*").alias("_m"))
    weights = members.join(sizes, "key").groupBy("node").agg(F.sum("_m").alias("_w"))
    weighted = members.join(weights, "node")
    pivots = weighted.groupBy("key").agg(F.max(F.struct("_w", "node", "n")).alias("_top"))
    return members.join(pivots, "key").select("key", "node", "n", F.struct("_top.node", "_top.n").alias("pivot"))


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, i, j, node, root, query``: buckets that hold several components, dealt into blocks where each node
    outside the bucket's largest component meets all nodes of the bucket."""
    rooted = staged(members.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")))
    counted = rooted.groupBy("key", "root").agg(F.count("*").alias("_c"), F.sum("n").alias("_h"))
    top = F.max(F.struct("_c", "_h", "root"))
    sizes = counted.groupBy("key").agg(top.alias("_top"), F.sum("_c").alias("m"), F.sum("_h").alias("mh")).where("_top._c < m")
    sizes = sizes.withColumns({"q": F.col("m") - F.col("_top._c"), "qh": F.col("mh") - F.col("_top._h")})

    def blocks(rows: str, hashes: str):
        return F.greatest(F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(hashes) / HASHES))

    cut = sizes.select("key", F.col("_top.root").alias("main"), blocks("m", "mh").alias("mb"), blocks("q", "qh").alias("qb"))
    apart = staged(rooted.join(cut, "key").select("key", "node", "root", (F.col("root") != F.col("main")).alias("asks"), "mb", "qb"))
    h = F.xxhash64("node")

    def each(blocks: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))

    as_member = apart.select("key", F.pmod(h, F.col("mb")).alias("i"), each("qb").alias("j"), "node", "root", F.lit(False).alias("query"))
    as_query = apart.where("asks").select("key", each("mb").alias("i"), F.pmod(h, F.col("qb")).alias("j"), "node", "root", F.lit(True).alias("query"))
    return as_member.unionByName(as_query)


def _rest(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside buckets that still hold several components, found in blocks of bounded size."""
    met = _apart(members, roots).join(sets, "node").select("key", "i", "j", "node", "root", "query", "n", "keys", "set")
    return met.groupBy("key", "i", "j").applyInArrow(lambda t: _linked(t, percent), "u long, v long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, percent: int = 85, within: int | None = None) -> DataFrame:
    """One row per document: ``id, n_shingles, component_id, kept``.

    A document is its set of ``width``-word shingles (ASCII lower case). Documents are linked if
    their Jaccard similarity is ``percent`` or more, and the component of a document is the smallest
    identifier that links reach from it; that one is ``kept``.

    Equal sets are one node. Nodes that agree in a band of min-max hashes share a bucket. Each node
    of a bucket is tested against its most central one, on whole sets; where that leaves several
    components in a bucket, all nodes outside the largest are tested in blocks. So a group of near copies makes few
    pairs, no bucket is held by one task, and none is cut. Two documents exactly at the threshold
    share no band with a chance of ``MISS``.

    With ``within``, the tree of :func:`simhash.links` puts sets into classes by their SimHash fingerprints,
    and each class is a bucket too, ahead of the others: all pairs that differ in so many bits or fewer are tested,
    but for those that links connect already. Blocks of other buckets test pairs of different classes.

    Null and empty texts and those without words have no shingles and link with nothing. Rows that
    repeat an identifier keep a row each. Null identifiers never name a component that has others;
    alone they are kept, with a null component. No rows give no rows.
    """
    source = numbered(docs).select("file", "row", F.col(f"doc.`{id_column}`").alias("id"), F.col(f"doc.`{text_column}`").cast("binary").alias("text"))
    rows = staged(_sketches(source, width, bands_for(percent), within is not None))
    same = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("low"), F.min(F.struct("file", "row")).alias("place"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("fp").alias("fp"))
    nodes = staged(same.withColumn("node", F.monotonically_increasing_id()))
    light = staged(rows.select("id", "n", "digest"))
    discard(rows)
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("_first"), F.max("node").alias("_last")).where("_first < _last").select("key")
    shared = staged(keyed.join(buckets, "key").select("key", "node", "n"))
    members = staged(_central(shared))
    discard(shared)
    buckets_of = nodes.select("node", "keys")
    if within is not None:
        classed = staged(_close_classes(nodes.select("node", "n", "fp"), within))
        members = members.unionByName(staged(_in_classes(classed)))
        buckets_of = classed.join(buckets_of, "node").select("node", F.concat(F.array("class"), "keys").alias("keys"))
    pairs = members.where(_fits("n", "pivot.n", percent) & (F.col("node") != F.col("pivot.node"))).select(F.col("node").alias("u"), F.col("pivot.node").alias("v"))
    stars = staged(pairs.distinct())
    asked = members.select("node").union(stars.select("u")).union(stars.select("v"))
    used = asked.distinct().join(nodes.drop("keys"), "node").join(buckets_of, "node").select("node", "n", "keys", F.col("place.file").alias("file"), F.col("place.row").alias("row"))
    used = staged(used)
    if within is not None:
        discard(classed)
    sets = _sets(source.join(used.select("node", "file", "row"), ["file", "row"]), width)
    sets = staged(sets.join(used.select("node", "n", "keys"), "node"))
    discard(used)
    links = staged(_star_links(stars, sets, percent))
    discard(stars)
    rest = staged(_rest(members.select("key", "node", "n"), components(links), sets, percent))
    discard(members, sets)
    links = links.union(rest)
    named = nodes.select("node", "digest", "low").join(components(links), "node", "left").select("digest", "low", F.coalesce("root", "node").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    with_words = light.where("digest IS NOT NULL").join(named.join(lows, "root").select("digest", "component_id"), "digest").select("id", "n", "component_id")
    every = with_words.union(light.where("digest IS NULL").select("id", "n", F.col("id").alias("component_id")))
    return every.select("id", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
