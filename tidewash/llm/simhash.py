"""SimHash near-deduplication: fingerprints, exact close pairs by vantage points, components."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged
from .components import components

#: Distinct fingerprints of a leaf of the tree; members and queries of one comparison task.
LEAF, MEMBERS, QUERIES = 4096, 8192, 65_536
SEED = 42
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def fingerprint(text: bytes, width: int = 3, chunk: int = 1 << 20) -> int:
    """Signed 64-bit fingerprint of a text: bit set where over half of the hashes of its word
    shingles (repeats included) have it. Fewer words than ``width`` are one shingle, none
    give zero. Long texts are read in chunks, whole."""
    counts, total, start, carried = np.zeros(64, np.int64), 0, 0, []
    while start < len(text):
        end = start + chunk
        if end < len(text):
            found = SPACE.search(text, end)
            end = found.start() if found else len(text)
        words = carried + text[start:end].lower().split()
        start, last = end, end >= len(text)
        if len(words) < width:
            if not last:
                carried = words
                continue
            if total or not words:
                break
            shingles = [b" ".join(words)]
        else:
            joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
            starts = [0, *ends[: len(words) - width].tolist()]
            shingles = [joined[a : b - 1] for a, b in zip(starts, ends[width - 1 :].tolist())]
        carried = words[len(words) - width + 1 :] if width > 1 else []
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), ">u8", len(shingles))
        for i in range(0, len(hashes), 8192):
            counts += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * counts > total).view(">i8")[0]) if total else 0


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint of unsigned hashes: bit set where over half of them have it, zero for none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """``id, fingerprint`` (long) of every row; a null text has no words."""
    kind = docs.schema[id_column].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                prints = [fingerprint(t or b"", width) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.int64())], names=["id", "fingerprint"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"))
    return rows.mapInArrow(hashed, f"id {kind}, fingerprint long")


def vantage_points(levels: int) -> np.ndarray:
    """One point per level of the tree, the same on every branch of a level: spread hash values."""
    return np.array([xxhash.xxh64_intdigest(b"vantage %d" % i, SEED) for i in range(levels)], np.uint64)


def _radii(prints: DataFrame, points: np.ndarray) -> list[int]:
    """Median distance of all fingerprints to each point, from 65 counts per level."""

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(points), 65), np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for i, p in enumerate(points):
                counts[i] += np.bincount(np.bitwise_count(values ^ p), minlength=65)
        level, distance = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(distance), pa.array(counts[level, distance])], names=["level", "distance", "n"])

    found = prints.mapInArrow(distances, "level long, distance long, n long").groupBy("level", "distance").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(points), 65), np.int64)
    for level, distance, n in found:
        counts[level, distance] = n
    return [int(np.searchsorted(np.cumsum(c), c.sum() / 2)) for c in counts]


def _routed(prints: DataFrame, points: np.ndarray, radii: list[int], within: int) -> DataFrame:
    """``leaf, fp, home``: every fingerprint in its own leaf, and as a query in each earlier leaf
    that the triangle inequality leaves open: a point at distance d of the vantage point has
    no neighbour inside the radius if d - within exceeds it, none outside if d + within doesn't."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                values = batch.column(0).slice(at, 4096).to_numpy()
                who, leaf, home = np.arange(len(values)), np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
                for point, radius in zip(points, radii):
                    d = np.bitwise_count(values.view(np.uint64) ^ point).astype(np.int64)
                    side = (d > radius).astype(np.int64)
                    near = (d - within <= radius) & (d + within > radius)
                    home = home * 2 + side
                    both = near[who]
                    leaf = np.concatenate([leaf * 2 + side[who], leaf[both] * 2 + 1 - side[who][both]])
                    who = np.concatenate([who, who[both]])
                kept = leaf <= home[who]
                who, leaf = who[kept], leaf[kept]
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(values[who]), pa.array(leaf == home[who])], names=["leaf", "fp", "home"])

    return prints.mapInArrow(route, "leaf long, fp long, home boolean")


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of all pairs a, b; ``label`` names the least member of each class."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def close_classes(members: np.ndarray, queries: np.ndarray, within: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever a chain of member-query pairs within the distance connects.
    Members lie in order of their distance to zero, which bounds the slice a query can reach."""
    values = np.unique(np.concatenate([members, queries])).view(np.uint64)
    label, weight = np.arange(len(values)), np.bitwise_count(values)
    m, q = (np.searchsorted(values.view(np.int64), np.unique(x)) for x in (members, queries))
    m, q = m[np.argsort(weight[m], kind="stable")], q[np.argsort(weight[q], kind="stable")]
    for w in range(65):
        reach = m[np.searchsorted(weight[m], w - within if w > within else 0) : np.searchsorted(weight[m], w + within, side="right")]
        same = q[np.searchsorted(weight[q], w) : np.searchsorted(weight[q], w, side="right")]
        for i in range(0, len(same), block):
            some = same[i : i + block]
            x, y = np.nonzero(np.bitwise_count(values[some][:, None] ^ values[reach][None, :]) <= within)
            _joined(label, some[x], reach[y])
    linked = np.flatnonzero(label != np.arange(len(values)))
    signed = values.view(np.int64)
    return signed[linked], signed[label[linked]]


def links(prints: DataFrame, within: int = 3, leaf: int = LEAF) -> DataFrame:
    """``u, v`` edges that connect exactly the fingerprints (``fp``, distinct) which chains of
    pairs at ``within`` or fewer differing bits connect; never all pairs of a cluster.

    A vantage-point tree deals the fingerprints to leaves. Each is compared in its own leaf and
    in the leaves over the boundaries it is close to. Leaves above ``MEMBERS`` members or
    ``QUERIES`` queries are cut into blocks that are all compared, each in a task of its own.
    """
    levels = max(0, math.ceil(math.log2(max(1, prints.count()) / leaf)))
    points = vantage_points(levels)
    routed = _routed(prints, points, _radii(prints, points) if levels else [], within)
    sizes = routed.groupBy("leaf").agg(F.count_if("home").alias("m"), F.count("*").alias("q"))
    cut = routed.join(sizes, "leaf").select(
        "leaf", "fp", "home", F.ceil(F.col("m") / MEMBERS).alias("mb"), F.ceil(F.col("q") / QUERIES).alias("qb"), F.abs(F.xxhash64("fp") % 1_000_003).alias("h"),
    )
    as_member = cut.where("home").select("leaf", (F.col("h") % F.col("mb")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("j"), "fp", F.lit(True).alias("member"))
    as_query = cut.where("mb > 0").select("leaf", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("i"), (F.col("h") % F.col("qb")).alias("j"), "fp", F.lit(False).alias("member"))

    def compare(rows: pa.Table) -> pa.Table:
        fp, member = rows.column("fp").to_numpy(), rows.column("member").to_numpy()
        u, v = close_classes(fp[member], fp[~member], within)
        return pa.table({"u": u, "v": v})

    return as_member.unionByName(as_query).groupBy("leaf", "i", "j").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, within: int = 3) -> DataFrame:
    """One row per document: ``id, fingerprint, component_id``.

    Documents whose fingerprints differ in ``within`` bits or fewer are linked; the component of
    a document is the smallest identifier that links reach from it. Texts without words (null,
    empty) have fingerprint zero and link like any other. Rows that repeat an identifier keep a
    row each. Null identifiers never name a component that has others; one of null identifiers
    alone is null. No rows give no rows.
    """
    rows = staged(fingerprints(docs, id_column, text_column, width))
    prints = staged(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("id").alias("low")))
    roots = components(links(prints.select("fp"), within))
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select(F.col("fp").alias("fingerprint"), "component_id")
    return rows.join(named, "fingerprint").select("id", "fingerprint", "component_id")
