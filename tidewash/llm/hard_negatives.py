"""Hard negatives for contrastive training: exact, by bounds along a spanning tree of the anchors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Block, blocks, meet, whole_vector
from .common import staged

#: Anchors of a block; their spanning tree is built anew for every group of candidates.
ANCHORS = 256
#: A score that no row has.
NONE = -(2**63)


def spanning_tree(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """``child, parent, distance`` in an order that has parents first (the root's parent is itself), of the
    minimum spanning tree over rows whose inner products are ``scores``."""
    norms = np.diag(scores).astype(float)
    apart = norms[:, None] + norms[None, :] - 2.0 * scores.astype(float)
    root = int(np.argmin(apart.sum(axis=1)))
    out, reach, via = [(root, root, 0.0)], apart[root].copy(), np.full(len(norms), root)
    reach[root] = np.inf
    inside = np.zeros(len(norms), bool)
    inside[root] = True
    for _ in range(len(norms) - 1):
        child = int(np.argmin(np.where(inside, np.inf, reach)))
        out.append((child, int(via[child]), float(np.sqrt(max(apart[via[child], child], 0.0)))))
        inside[child] = True
        closer = apart[child] < reach
        reach, via = np.where(closer, apart[child], reach), np.where(closer, child, via)
    return out


def rescored(anchors: Block, tree: list[tuple[int, int, float]], rows: Block, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``anchor, places, scores`` of each anchor's candidates among ``rows``, parents first.

    The score of a row at a child lies within the edge's length times the row's norm of its score at
    the parent. ``wanted(anchor, low, high)`` tells from these bounds which rows can matter; only those
    are scored anew, and the others pass their bounds on.
    """
    norms = np.sqrt((rows.vectors**2).sum(axis=1)) * (1 + 1e-12)
    least: dict[int, np.ndarray] = {}
    most: dict[int, np.ndarray] = {}
    children = np.bincount([p for c, p, _ in tree if c != p], minlength=len(tree))
    for child, parent, distance in tree:
        if child == parent:
            places = np.arange(len(norms))
            low, high = np.zeros(len(norms)), np.zeros(len(norms))
        else:
            reach = distance * (1 + 1e-12) * norms + 1
            low, high = least[parent] - reach, most[parent] + reach
            children[parent] -= 1
            if not children[parent]:
                del least[parent], most[parent]
            places = np.flatnonzero(wanted(child, low, high))
        one = Block(anchors.vectors[child : child + 1], {})
        found = Block(rows.vectors[places], {}).scores(one)[:, 0]
        if children[child]:
            near = found.astype(float)
            spare = np.where(np.abs(near) < 2.0**53, 0.0, 2048.0)  # what a 64-bit number loses as a double
            low[places], high[places] = near - spare, near + spare
            least[child], most[child] = low, high
        yield child, places, found


def _best(places: np.ndarray, scores: np.ndarray, rows: Block, k: int) -> np.ndarray:
    """Positions of the k highest scores; ties go to the smaller identifier, then row."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= kth)
    else:
        some = np.arange(len(scores))
    at = places[some]
    return some[np.lexsort((rows.numbers["row"][at], rows.numbers["id"][at], -scores[some]))][:k]


OUT = "row long, place long, other long, other_id long, score long"


def _table(found: list[tuple[int, int, int, int, int]], keys: int, k: int) -> pa.Table:
    """The k best rows of each key (the first ``keys`` columns)."""
    row, place, other, other_id, score = np.array(found, np.int64).reshape(-1, 5).T
    order = np.lexsort((other, other_id, -score, *([place] if keys > 1 else []), row))
    group = np.stack([row, place if keys > 1 else np.zeros_like(place)])[:, order]
    starts = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(axis=0)])) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff([*starts.tolist(), len(order)]))
    best = order[rank < k]
    return pa.table([pa.array(c[best]) for c in (row, place, other, other_id, score)], names=[c.split()[0] for c in OUT.split(", ")])


def _ranked(pairs: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each key. Each task passes on its own k best only."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "other_id", "other")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` marks the anchors among ``rows``; ``label`` (a whole number, else ``label_column``) may be an
    expression of the columns. Each component x counts as floor(scale * x); a score is the integer inner
    product with the anchor, higher ones come first, ties by smaller identifier. An anchor's positives
    are its first ``positives`` other rows of its label. Of the rows of other labels whose score is
    from ``low`` to ``high`` percent of a positive's, the first ``negatives`` are returned.

    Anchors lie in blocks, each with its minimum spanning tree; every block meets all rows in
    blocks. Scores at an anchor bound those at its children in the tree, so a row is scored again
    only where its bounds overlap what is wanted: for positives, scores above the worst of the
    first among the block's own anchors; for negatives, the windows below the positives.

    Rows with a null label, vector, component or identifier, or a component that is not finite,
    take no part. Vectors of other lengths than the anchor's are no candidates. Rows that repeat an
    identifier are rows of their own, as anchors as well. No rows or anchors give no rows. Scores
    outside 64 bits fail.
    """
    label = F.col(label_column) if label is None else label
    cells = [F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), whole_vector(F.col(vector_column), scale).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor")]
    used = rows.select(*cells).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    used = staged(used.withColumn("row", F.monotonically_increasing_id()))
    candidates = blocks(used, ["row", "id", "label"])
    anchors = used.where("anchor").drop("anchor")
    # Anchors of one label that agree in the signs of their components lie together.
    close = ["label", "signs", "row"]
    signs = F.array_join(F.transform(F.slice("vector", 1, 16), lambda x: F.when(x < 0, "0").otherwise("1")), "")
    anchors = staged(anchors.withColumn("signs", signs))

    def first(tiles: list[Block], shards: list[Block]) -> pa.Table:
        out = []
        for tile in tiles:
            own = tile.scores(tile)
            tree, n = spanning_tree(own), tile.numbers
            same = (n["label"][:, None] == n["label"][None, :]) & (n["row"][:, None] != n["row"][None, :])
            within = np.sort(np.where(same, own, NONE), axis=1)
            worst = within[:, -positives].astype(float) - 2048 if within.shape[1] >= positives else np.full(len(own), float(NONE))
            for shard in shards:
                labels = shard.numbers["label"]
                for a, places, scores in rescored(tile, tree, shard, lambda a, lo, hi: (labels == n["label"][a]) & (hi >= worst[a])):
                    mine = (labels[places] == n["label"][a]) & (shard.numbers["row"][places] != n["row"][a])
                    places, scores = places[mine], scores[mine]
                    best = _best(places, scores, shard, positives)
                    out += [(n["row"][a], n["id"][a], shard.numbers["row"][p], shard.numbers["id"][p], s) for p, s in zip(places[best], scores[best])]
        return _table(out, 1, positives)

    found = meet(blocks(anchors, ["row", "id", "label"], ANCHORS, close), candidates, first, OUT)
    found = staged(_ranked(found, ["row"], positives).withColumnRenamed("place", "anchor_id"))

    # An anchor with its windows, lowest and highest score of each; missing positives have an empty one.
    windows = found.groupBy("row").agg(F.collect_list(F.struct("rank", "score")).alias("found"))
    met = anchors.join(windows, "row")
    empty = F.lit(NONE)
    names = []
    for i in range(1, positives + 1):
        score = F.get(F.filter("found", lambda x: x["rank"] == i), F.lit(0))["score"].cast("decimal(38,0)")
        met = met.withColumn(f"low{i}", F.coalesce(F.ceil(score * low / 100).cast("long"), F.lit(0))).withColumn(f"high{i}", F.coalesce(F.floor(score * high / 100).cast("long"), empty))
        names += [f"low{i}", f"high{i}"]

    def second(tiles: list[Block], shards: list[Block]) -> pa.Table:
        out = []
        for tile in tiles:
            tree, n = spanning_tree(tile.scores(tile)), tile.numbers
            lows, highs = (np.stack([n[f"{x}{i}"] for i in range(1, positives + 1)], axis=1) for x in ("low", "high"))
            for shard in shards:
                labels = shard.numbers["label"]

                def overlaps(a: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
                    other = np.zeros(len(lo), bool)
                    for least, most in zip(lows[a], highs[a]):
                        if least <= most:
                            spare = 2048.0 if max(abs(int(least)), abs(int(most))) >= 2**53 else 0.0
                            other |= (hi >= float(least) - spare) & (lo <= float(most) + spare)
                    return other & (labels != n["label"][a])

                for a, places, scores in rescored(tile, tree, shard, overlaps):
                    mine = labels[places] != n["label"][a]
                    places, scores = places[mine], scores[mine]
                    for i, (least, most) in enumerate(zip(lows[a], highs[a])):
                        inside = (scores >= least) & (scores <= most)
                        at, some = places[inside], scores[inside]
                        best = _best(at, some, shard, negatives)
                        out += [(n["row"][a], i + 1, shard.numbers["row"][p], shard.numbers["id"][p], s) for p, s in zip(at[best], some[best])]
        return _table(out, 2, negatives)

    mined = _ranked(meet(blocks(met, ["row", "id", "label", *names], ANCHORS, close), candidates, second, OUT), ["row", "place"], negatives)
    pairs = found.select("row", "anchor_id", F.col("rank").cast("long").alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(mined, ["row", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
