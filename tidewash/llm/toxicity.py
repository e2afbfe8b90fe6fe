"""Toxicity: class-conditional Kneser-Ney models of words, letter by letter."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, parts_for, slices, staged

#: Letters of an n-gram, and the discount.
ORDER, DISCOUNT = 5, 0.75
#: Labelled rows of each class that the fit takes (the first by hash), and those that calibrate it.
FIT_ROWS, CALIBRATION_ROWS = 20_000, 4_000
#: Letters of distinct words that one task turns into n-grams, and of what counts as one word.
LETTERS_PER_PART, LONGEST = 200_000, 256
#: Distinct words that a task counts or scores before it lets go of them.
WORDS_HELD = 60_000
NO_LETTER = re.compile(r"[\W\d_]+")
CLASSES = ("toxic_0", "toxic_1", "plain_0", "plain_1")


def letters(token: str) -> str:
    return NO_LETTER.sub("", token)


def tokens(text: str | None) -> list[str]:
    """What lies between blanks, in lower case. Texts without blanks are cut, so no word is longer than
    ``LONGEST`` characters."""
    found = (text or "").lower().split()
    if any(len(t) > LONGEST for t in found):
        found = [t[i : i + LONGEST] for t in found for i in range(0, len(t), LONGEST)]
    return found


class Grams:
    """n-grams of words between a start and an end mark, as hashes over all words at once.

    ``ends[k]`` holds the hash of the k+1 letters that end at each place; ``place`` is the
    number of letters of the word before it.
    """

    def __init__(self, words: list[str]):
        codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.lengths = np.array([len(w) + 2 for w in words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(len(codes)) - np.repeat(self.starts, self.lengths)
        mixed = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        self.ends = [mixed ^ (mixed >> np.uint64(31))]
        for k in range(1, ORDER):
            before = np.zeros_like(mixed)
            before[k:] = mixed[:-k] if k < len(mixed) else 0
            h = (self.ends[-1] * np.uint64(0xC2B2AE3D27D4EB4F) + before) ^ np.uint64(k)
            self.ends.append(h ^ (h >> np.uint64(29)))

    def at(self, order: int, where: np.ndarray) -> np.ndarray:
        """Whole 64-bit hashes of the n-grams of ``order`` letters that end at ``where``."""
        return self.ends[order - 1][where].view(np.int64)

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """For each letter and end mark: its longest n-gram and that n-gram's context."""
        gram, context = np.zeros(len(self.place), np.int64), np.zeros(len(self.place), np.int64)
        for order in range(2, ORDER + 1):
            where = np.flatnonzero(self.place >= 1 if order == 2 else self.place >= order - 1)
            gram[where], context[where] = self.at(order, where), self.at(order - 1, where - 1)
        return gram, context


@dataclass(frozen=True)
class Model:
    """Per n-gram log(P_toxic / P_plain); where neither class has the n-gram, the ratio of the
    weights that its context leaves to the shared backoff (1 for a context without labels). Keys are
    sorted hashes of what occurs in the labelled sample. ``weights`` calibrate the features."""

    grams: np.ndarray
    ratios: np.ndarray
    contexts: np.ndarray
    rests: np.ndarray
    weights: np.ndarray | None = None

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihood ratio of each word."""
        if not words:
            return np.zeros(0)
        grams = Grams(words)
        gram, context = grams.longest()
        value = found(self.grams, self.ratios, gram, np.nan)
        value = np.where(np.isnan(value), found(self.contexts, self.rests, context, 0.0), value)
        value[grams.place == 0] = 0
        return np.add.reduceat(value, grams.starts)


def found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    """Value of each wanted key among the sorted ``keys``."""
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at].astype(np.float64), default)


def features(ratios: np.ndarray, lengths: np.ndarray) -> list[float]:
    """Of a document's words: the log-likelihood ratio per letter, that of its most toxic word and
    its most toxic three (per word and per letter), and the log of its length."""
    some = lengths > 0
    r, n = ratios[some], lengths[some] + 1.0
    if not len(r):
        return [0.0] * 5
    top = np.sort(r)[-3:]
    return [r.sum() / n.sum(), top[-1], top.mean(), (r / n).max(), float(np.log1p(len(r)))]


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, total`` and the counts of ``CLASSES`` from ``text, class`` rows (class null: none)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: dict[int, Counter]) -> pa.RecordBatch:
            words: dict[str, list[int]] = {}
            for c, counts in held.items():
                for token, n in counts.items():
                    row = words.setdefault(letters(token), [0] * 5)
                    row[0] += n
                    if c >= 0:
                        row[c + 1] += n
            words.pop("", None)
            columns = np.array(list(words.values()), np.int64).reshape(-1, 5).T
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *map(pa.array, columns)], names=["word", "total", *CLASSES])

        held: dict[int, Counter] = {}
        for batch in batches:
            for part in slices(batch, 0):
                for text, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    held.setdefault(-1 if c is None else c, Counter()).update(tokens(text))
                if sum(map(len, held.values())) > WORDS_HELD:
                    yield rows(held)
                    held = {}
        yield rows(held)
        held = {}
        give_back()

    counts = docs.mapInArrow(counted, "word string, total long, " + ", ".join(f"{c} long" for c in CLASSES))
    return counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("total", *CLASSES)])


def gram_counts(words: DataFrame) -> DataFrame:
    """``k, gram, context, suffix, first, total`` and class counts (of longest n-grams) per n-gram of k letters."""
    names = ["k", "gram", "context", "suffix", "first", "total", *CLASSES]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        counts = np.stack([rows.column(c).to_numpy() for c in names[5:]])
        grams = Grams(rows.column("word").to_pylist())
        owner = np.repeat(np.arange(rows.num_rows), grams.lengths)
        for k in range(1, ORDER + 1):
            where = np.flatnonzero(grams.place >= max(1, k - 1))
            gram = grams.at(k, where)
            first = grams.place[where] == k - 1
            longest = (first if k < ORDER else np.ones(len(where), bool)) if k > 1 else np.zeros(len(where), bool)
            _, one, inverse = np.unique(gram, return_index=True, return_inverse=True)
            sums = [np.bincount(inverse, counts[0][owner[where]]).astype(np.int64)]
            sums += [np.bincount(inverse, c[owner[where]] * longest).astype(np.int64) for c in counts[1:]]
            at = where[one]
            context, suffix = (grams.at(k - 1, at - 1), grams.at(k - 1, at)) if k > 1 else (np.zeros(len(at), np.int64), np.zeros(len(at), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), *map(pa.array, (gram[one], context, suffix, first[one], *sums))], names=names)

    found = words.mapInArrow(counted, "k int, gram long, context long, suffix long, first boolean, " + ", ".join(f"{c} long" for c in names[5:]))
    sums = [F.sum(c).alias(c) for c in names[5:]]
    return found.groupBy("k", "gram").agg(F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.max("first").alias("first"), *sums)


def _backoffs(grams: DataFrame) -> DataFrame:
    """``k, suffix, lower``: the shared probability of every n-gram of k-1 letters, as the backoff of
    those of k that end in it. An n-gram counts by the number of different letters before it (by its
    occurrences at the start of a word)."""
    before = grams.where("k > 1").groupBy((F.col("k") - 1).alias("k"), F.col("suffix").alias("gram")).agg(F.count("*").alias("before"))
    counted = grams.where(F.col("k") < ORDER).join(before, ["k", "gram"], "left")
    n = F.when(F.col("first"), F.col("total")).otherwise(F.coalesce("before", F.lit(0)))
    counted = staged(counted.select("k", "gram", "context", "suffix", n.alias("n")))
    contexts = counted.groupBy("k", "context").agg(F.greatest(F.sum("n"), F.lit(1)).alias("total"), F.count("*").alias("kinds"))
    counted = staged(counted.join(contexts, ["k", "context"]))
    levels = [counted.where("k = 1").select(F.lit(2).alias("k"), F.col("gram").alias("suffix"), (F.col("n") / F.col("total")).alias("lower"))]
    for k in range(2, ORDER):
        value = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("lower")) / F.col("total")
        level = counted.where(F.col("k") == k).drop("k").join(levels[-1].drop("k"), "suffix")
        levels.append(staged(level.select(F.lit(k + 1).alias("k"), F.col("gram").alias("suffix"), value.alias("lower"))))
    return reduce(DataFrame.unionByName, levels)


def models(grams: DataFrame) -> tuple[Model, Model]:
    """The model of the rows of fold 0, and that of all rows.

    The shared backoff is a Kneser-Ney model of all documents, counted and joined by Spark. Each
    class puts its own discounted counts of the longest n-grams on top. The driver and the tasks
    get only n-grams and contexts of the labelled sample, which ``fit`` bounds.
    """
    labelled = grams.where(reduce(Column.__or__, [F.col(c) > 0 for c in CLASSES])).select("k", "gram", "context", "suffix", *CLASSES)
    # Class counts are those of longest n-grams. An n-gram of k letters always has its suffix in the corpus.
    known = labelled.join(_backoffs(grams), ["k", "suffix"]).withColumn("lower", F.greatest("lower", F.lit(1e-12)))
    sides = {"0": ("toxic_0", "plain_0"), "1": ("toxic_0 + toxic_1", "plain_0 + plain_1")}
    for m, pair in sides.items():
        known = known.withColumns({f"n{m}{c}": F.expr(x) for c, x in enumerate(pair)})
    names = [f"{m}{c}" for m in sides for c in range(2)]
    known = staged(known.select("k", "gram", "context", "lower", *[f"n{x}" for x in names]))
    sums = [e for x in names for e in (F.sum(f"n{x}").alias(f"t{x}"), F.count_if(F.col(f"n{x}") > 0).alias(f"d{x}"))]
    contexts = known.groupBy("k", "context").agg(*sums)
    left = [F.when(F.col(f"t{x}") > 0, DISCOUNT * F.col(f"d{x}") / F.col(f"t{x}")).otherwise(1.0).alias(f"left{x}") for x in names]
    contexts = staged(contexts.select("k", "context", *[f"t{x}" for x in names], *left))
    joined = known.join(contexts, ["k", "context"])

    def model(m: str) -> Model:
        def share(c: int) -> Column:
            n, total = F.col(f"n{m}{c}"), F.greatest(F.col(f"t{m}{c}"), F.lit(1))
            return F.log(F.greatest(n - DISCOUNT, F.lit(0.0)) / total + F.col(f"left{m}{c}") * F.col("lower"))

        seen = (F.col(f"n{m}0") > 0) | (F.col(f"n{m}1") > 0)
        rest = F.log(F.col(f"left{m}0")) - F.log(F.col(f"left{m}1"))
        sides = []
        for rows, value, key in ((joined.where(seen), share(0) - share(1), "gram"), (contexts, rest, "context")):
            table = rows.select(F.col(key).alias("key"), value.cast("float").alias("value")).toArrow()
            keys, values = table.column("key").to_numpy(), table.column("value").to_numpy()
            order = np.argsort(keys)
            sides += [keys[order], values[order]]
        return Model(*sides)

    return model("0"), model("1")


def _scored(rows: DataFrame, model: Model, text_column: str) -> DataFrame:
    """``doc`` rows as ``doc`` with ``features`` of its text, or with ``score`` if the model is calibrated."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled sample
    calibrated = model.weights is not None
    at_text = rows.schema["doc"].dataType.names.index(text_column)
    out = T.StructType([rows.schema["doc"], T.StructField("score", T.DoubleType()) if calibrated else T.StructField("features", T.ArrayType(T.DoubleType()))])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, place, ratio, length = shared.value, {}, np.zeros(0), np.zeros(0)
        for batch in batches:
            for part in slices(batch, 0, field=at_text):
                split = [tokens(t) for t in part.column(0).field(at_text).to_pylist()]
                new = list({w for s in split for w in s}.difference(place))
                if len(place) + len(new) > WORDS_HELD:  # bounded memory of the task
                    place, ratio, length = {}, np.zeros(0), np.zeros(0)
                    new = list({w for s in split for w in s})
                clean = [letters(w) for w in new]
                place.update(zip(new, range(len(place), len(place) + len(new))))
                ratio, length = np.concatenate([ratio, model.words(clean)]), np.concatenate([length, [len(w) for w in clean]])
                found = []
                for s in split:
                    where = np.fromiter(map(place.__getitem__, s), np.int64, len(s))
                    found.append(features(ratio[where], length[where]))
                if calibrated:
                    z = np.array(found).reshape(-1, 5) @ model.weights[1:] + model.weights[0]
                    last = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                else:
                    last = pa.array(found, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), last], names=out.names)
        del model, place, ratio, length
        give_back()

    return rows.mapInArrow(scored, out)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Intercept and weights of a logistic regression, by Newton steps on standardised columns."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z, w = np.column_stack([np.ones(len(x)), (x - mean) / spread]), np.zeros(x.shape[1] + 1)
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([[w[0] - (w[1:] * mean / spread).sum()], w[1:] / spread])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
        fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Model from all texts and the labels of rows where ``learn`` holds.

    Class counts come from up to ``fit_rows`` labelled rows of each class, the first by a hash of
    the identifier; shared counts from every document. Half the labelled rows (fold 0) make a
    model whose features on the other half calibrate the scores. An identifier labelled twice
    is toxic if any of its labels is; null labels are ignored. If a class has no
    labelled rows, every score is the smoothed share of toxic rows.
    """
    known = labels.where(learn & F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label_column).cast("int")).alias("label"))
    order = F.xxhash64(F.lit("fit"), F.col("id").cast("string"))
    taken = [known.where(F.col("label") == c).orderBy(order, "id").limit(fit_rows) for c in (1, 0)]
    taken = staged(taken[0].union(taken[1]).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), F.col("id").cast("string")), F.lit(2)).cast("int")))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    # At most two classes of fit_rows rows: bounded, so broadcast.
    place = F.when(F.col("label") == 1, F.col("fold")).otherwise(F.col("fold") + 2).alias("class")
    words = staged(word_counts(texts.join(F.broadcast(taken.select("id", place)), "id", "left").select("text", "class")))
    size = words.agg(F.sum(F.length("word") + 2)).first()[0] or 0
    half, whole = models(staged(gram_counts(words.repartition(parts_for(size, LETTERS_PER_PART), F.xxhash64("word")))))
    sample = [taken.where((F.col("label") == c) & (F.col("fold") == 1)).orderBy(order, "id").limit(calibration_rows) for c in (1, 0)]
    rows = texts.join(F.broadcast(sample[0].union(sample[1]).select("id", "label")), "id")
    found = _scored(rows.select(F.struct("label", "text").alias("doc")), half, "text").select("doc.label", "features").toArrow()
    y = found.column("label").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        n, toxic = taken.agg(F.count("*"), F.sum("label")).first()
        share = ((toxic or 0) + 0.5) / (n + 1)
        return replace(whole, weights=np.array([np.log(share / (1 - share)), 0, 0, 0, 0, 0]))
    x = np.array(found.column("features").to_pylist(), float)
    weights = logistic(x, y)
    # Classes were taken in equal numbers at most; the intercept goes back to their true shares.
    n, toxic = known.agg(F.count("*"), F.sum("label")).first()
    weights[0] += np.log(toxic / (n - toxic)) - np.log(y.sum() / (len(y) - y.sum()))
    return replace(whole, weights=weights)


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``doc`` (all columns of the row) and ``score``: the probability that the document is toxic,
    from its text alone. Null and empty texts score like a text without any evidence."""
    return _scored(docs.select(F.struct("*").alias("doc")), model, text_column)
