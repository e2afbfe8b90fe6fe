import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewash.llm import toxicity
from tidewash.llm.queries import QUERIES
from tidewash.llm.toxicity import ORDER, Grams, fit, gram_counts, models, score, word_counts


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL")
    rows = QUERIES["op9_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    right = (rows.predicted == rows.toxic).mean()
    positive, negative = rows.score[rows.toxic == 1], rows.score[rows.toxic == 0]
    order = np.mean([(p > negative).mean() + (p == negative).mean() / 2 for p in positive])
    assert right >= 0.95 and order >= 0.97


def plain_models(words):
    """Kneser-Ney by dictionaries: words are (text, total, toxic, plain)."""
    grams = {k: {} for k in range(1, ORDER + 1)}
    for word, total, toxic, plain in words:
        w = f"\x02{word}\x03"
        for p in range(1, len(w)):
            for k in range(1, min(ORDER, p + 1) + 1):
                row = grams[k].setdefault(w[p - k + 1 : p + 1], [0, 0, 0])
                row[0] += total
                if k == min(ORDER, p + 1):
                    row[1] += toxic
                    row[2] += plain
    d = toxicity.DISCOUNT

    def count(g):
        if g[0] == "\x02":
            return grams[len(g)][g][0]
        return sum(x[1:] == g for x in grams[len(g) + 1])

    def shared(g):
        if len(g) == 1:
            return count(g) / sum(count(x) for x in grams[1])
        after = [x for x in grams[len(g)] if x[:-1] == g[:-1]]
        total = sum(count(x) for x in after)
        return (max(count(g) - d, 0) + d * len(after) * shared(g[1:])) / total

    def ratio(g):
        out = []
        for c in (1, 2):
            after = [x for x in grams[len(g)] if x[:-1] == g[:-1] and grams[len(x)][x][c] > 0]
            total, n = sum(grams[len(x)][x][c] for x in after), grams[len(g)].get(g, [0] * 3)[c]
            left = d * len(after) / total if total else 1.0
            seen = any(grams[len(g)].get(g, [0] * 3)[1:])
            out.append(np.log(max(n - d, 0) / max(total, 1) + left * shared(g[1:])) if seen else np.log(left))
        return out[0] - out[1]

    return lambda word: sum(ratio(f"\x02{word}\x03"[max(0, p - ORDER + 1) : p + 1]) for p in range(1, len(word) + 2))


def test_ratios_equal_a_plain_model(spark):
    words = [("scum", 9, 4, 0), ("scarf", 5, 0, 3), ("the", 90, 20, 40), ("then", 12, 2, 6), ("hero", 3, 0, 0), ("a", 50, 9, 30), ("schön", 4, 1, 1)]
    rows = spark.createDataFrame([(w, n, t, 0, p, 0) for w, n, t, p in words], "word string, total long, toxic_0 long, toxic_1 long, plain_0 long, plain_1 long")
    _, model = models(gram_counts(rows.repartition(3)))
    plain = plain_models(words)
    names = [w for w, *_ in words] + ["schema", "zzz", ""]
    assert model.words(names).tolist() == pytest.approx([plain(w) for w in names if w[:3] != "zzz"][:8] + [model.words(["zzz"])[0]] + [plain("")], abs=1e-4)


def test_words_do_not_depend_on_their_neighbours():
    alone = Grams(["scum"]).longest()[0]
    assert Grams(["a", "scum", "b"]).longest()[0][3:9].tolist() == alone.tolist()


def test_counts(spark):
    docs = spark.createDataFrame([("A bad, bad dog", 0), ("good dog", 2), (None, 1), ("12 !", None), ("Dog", None)], "text string, class int")
    got = {r.word: tuple(r)[1:] for r in word_counts(docs).collect()}
    assert got == {"a": (1, 1, 0, 0, 0), "bad": (2, 2, 0, 0, 0), "dog": (3, 1, 0, 1, 0), "good": (1, 0, 0, 1, 0)}


def test_odd_rows_and_missing_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, None), (1, 1, None), (2, None, 1), (None, 1, 1), (4, 0, 1)], "doc_id long, toxic int, label int")
    for known in (labels, labels.where("toxic = 1"), labels.limit(0)):
        model = fit(odd_docs, known, F.lit(True))
        rows = score(odd_docs, model).select("doc.doc_id", F.col("score").alias("p")).collect()
        assert len(rows) == 10 and all(0 <= r.p <= 1 for r in rows)
        assert score(no_docs, model).count() == 0
    assert fit(no_docs, labels, F.lit(True)).weights is not None


def test_grams_that_share_leading_hash_bits_stay_apart(spark):
    rng = np.random.default_rng(1)
    texts = sorted({"".join(chr(97 + c) for c in x) for x in rng.integers(0, 26, (20_000, 5))})
    grams = Grams(texts)
    last = grams.starts + 5
    assert len(np.unique(grams.at(5, last))) == len(texts)
    seen, pair = {}, None
    for text, place in zip(texts, (grams.at(5, last).view(np.uint64) >> np.uint64(42)).tolist()):
        pair = pair or ((seen[place], text) if place in seen else None)
        seen[place] = text
    words = [(pair[0], 9, 6, 0), (pair[1], 8, 0, 5), ("the", 50, 9, 9)]
    rows = spark.createDataFrame([(w, n, t, 0, p, 0) for w, n, t, p in words], "word string, total long, toxic_0 long, toxic_1 long, plain_0 long, plain_1 long")
    _, model = models(gram_counts(rows))
    plain = plain_models(words)
    assert model.words(list(pair)).tolist() == pytest.approx([plain(w) for w in pair], abs=1e-4)


def test_texts_without_blanks_are_cut_into_words(spark):
    from tidewash.llm.toxicity import LONGEST, tokens

    assert tokens("A bc\x0b" + "d" * (2 * LONGEST + 1)) == ["a", "bc", "d" * LONGEST, "d" * LONGEST, "d"] and tokens(None) == []
    docs = spark.createDataFrame([("abcdefgh" * 250_000, None), ("plain words", 1)], "text string, class int")
    counts = {r["word"]: r["total"] for r in toxicity.word_counts(docs).collect()}
    want = {"abcdefgh" * (LONGEST // 8): 2_000_000 // LONGEST, "plain": 1, "words": 1}
    rest = "abcdefgh" * (2_000_000 % LONGEST // 8)
    assert counts == want | ({rest: 1} if rest else {})
