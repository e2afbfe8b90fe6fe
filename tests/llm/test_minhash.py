import random

import numpy as np
import pytest

from tidewash.llm import minhash, simhash
from tidewash.llm.minhash import Sketch, near_duplicates, shingle_set

WORD = __import__("re").compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, width=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < width:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(texts, percent=85, width=3):
    """Least position that links reach, over all pairs."""
    sets, root = [plain_set(t, width) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def found(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sorted(near_duplicates(docs, **options).collect(), key=lambda r: r.id)
    assert all(r.kept == (r.id == r.component_id) for r in rows)
    return [(r.n_shingles, r.component_id) for r in rows]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [256, 4])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(7)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 12, 60, 150]))] for _ in range(12)]
    texts = [edited(rng, b, rng.randrange(0, 1 + len(b) // 25)) for b in base for _ in range(18)]
    # A form letter: alike, but not alike enough, in one bucket with each other; and pairs of them that are.
    form = [f"f{i}" for i in range(80)]
    letters = [" ".join(form + [f"own{k}_{i}" for i in range(18)]) for k in range(40)]
    texts += letters + [x + " end" for x in letters[::4]]
    assert found(spark, texts) == brute(texts)


def test_threshold_is_exact(spark):
    # 17 of 20 shingles in common are exactly 85 %; 16 of 19 are less.
    a = [f"a{i}" for i in range(20)]
    texts = [" ".join(a[:19]), " ".join(a[:20] + ["b", "c"]), " ".join(["q"] + a[2:18]), "one two", "ONE two", "One", "two"]
    assert found(spark, texts) == brute(texts)


def test_long_text_in_chunks_and_estimates():
    text = " ".join(f"w{i % 977}" for i in range(20_000)).encode()
    assert (shingle_set(text, chunk=1000) == shingle_set(text)).all() and len(shingle_set(text)) == 977
    assert len(shingle_set(b"\t ")) == 0 and len(shingle_set(b"a b")) == 1
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 3000).astype(np.uint64)
    made = Sketch(400)
    same = np.mean(np.array(made.keys(h[:2800])) == np.array(made.keys(h[200:])))  # J = 2600/3000
    assert abs(same - (2600 / 3000) ** 6) < 0.08


def test_odd_documents(spark, odd_docs, no_docs):
    rows = sorted((r.id is None, r.id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(odd_docs).collect())
    got = [(r[1] if not r[0] else None, *r[2:]) for r in rows]
    assert got[:3] == [(1, 6, 1, True), (2, 6, 1, False), (2, 6, 1, False)]
    assert got[3:5] == [(3, 0, 3, True), (4, 0, 4, True)] and got[5][:2] == (5, 1)
    assert [x[3] for x in got if x[0] is None] == [True, True]
    assert near_duplicates(no_docs).count() == 0


def test_copies_make_no_pairs(spark, monkeypatch):
    stars, asked = [], minhash._star_links
    monkeypatch.setattr(minhash, "_star_links", lambda s, *rest: stars.append(s.count()) or asked(s, *rest))
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words)] * 300 + [" ".join(words + [f"n{k}"]) for k in range(300)]
    assert {c for _, c in found(spark, texts)} == {0}
    assert stars[0] <= 301 * 3


def test_blocks_ask_for_the_fewest_nodes(spark, monkeypatch):
    """A bucket's largest component asks nothing, also where its first node stands alone; blocks are bounded by hashes too."""
    n = 600
    members = spark.range(1, n + 1).selectExpr("7L AS key", "id AS node", "100L AS n")
    roots = spark.range(3, n + 1).selectExpr("id AS node", "2L AS root")  # node 1 has no links
    assert minhash._apart(members, roots).where("query").select("node").distinct().collect() == [(1,)]
    assert minhash._apart(members, roots).count() == n + 2  # two blocks of members
    monkeypatch.setattr(minhash, "HASHES", 100 * 100)
    assert minhash._apart(members, roots).select("i").distinct().count() == 6


def test_pivot_is_the_most_central_node(spark):
    """Node 9 meets all others in one bucket or another; the first nodes of the buckets only some."""
    buckets = {1: [1, 2, 9], 2: [3, 4, 9], 3: [5, 6, 9], 4: [1, 2]}
    members = spark.createDataFrame([(k, v, 10) for k, some in buckets.items() for v in some], "key long, node long, n long")
    rows = minhash._central(members).select("key", "node", "pivot.node").collect()
    assert len(rows) == 11 and {r[2] for r in rows if r[0] < 4} == {9}


def test_close_fingerprints_are_found_without_buckets(spark, monkeypatch):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(9000)}" for _ in range(400)] for _ in range(8)]
    texts = [" ".join(b + [f"e{k}"] * (k > 0)) for b in base for k in range(4)]
    prints = [simhash.majority(shingle_set(t.encode(), 5)) for t in texts]
    assert sum((a ^ b) & (2**64 - 1) != 0 and ((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in zip(prints, prints[1:])) > 4
    expected = brute(texts, percent=80, width=5)
    assert found(spark, texts, width=5, percent=80, within=3) == expected
    central = minhash._central
    monkeypatch.setattr(minhash, "_central", lambda members: central(members.where("false")))
    assert found(spark, texts, width=5, percent=80, within=12) == expected
    assert {c for _, c in found(spark, texts, width=5, percent=80)} == set(range(32))


def test_close_fingerprints_of_other_sets_are_no_links(spark):
    # Within 64 bits all fingerprints meet; only whole sets decide.
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[:i] + ["x"] + words[i + 1 :]) for i in range(0, 40, 7)] + ["", "one", "ONE"]
    assert found(spark, texts, width=3, percent=95, within=64) == brute(texts, percent=95)


def test_every_close_pair_of_a_chain_is_tested(spark, monkeypatch):
    """Windows of one text: fingerprints chain within three bits, and no window is like all the others, so links to
    one of them, or only the edges that connect the chain, are not enough."""
    words = [f"z{i}" for i in range(520)]
    texts = [" ".join(words[k : k + 400]) for k in range(0, 120, 2)] + ["other " * 9, ""]
    expected = brute(texts, percent=80, width=5)
    assert {c for _, c in expected} == {0, 60, 61}
    ends = [plain_set(texts[i], 5) for i in (0, 30, 59)]
    assert all(100 * len(a & b) < 80 * len(a | b) for a, b in zip(ends, ends[1:]))
    central = minhash._central
    monkeypatch.setattr(minhash, "_central", lambda members: central(members.where("false")))
    assert found(spark, texts, width=5, percent=80, within=3) == expected
    monkeypatch.setattr(minhash, "BLOCK", 7)
    assert found(spark, texts, width=5, percent=80, within=64) == expected


def test_classes_and_buckets_share_their_pairs(spark, monkeypatch):
    """Each set is alone at first, so that blocks find all links: those of one class, and those of several."""
    monkeypatch.setattr(minhash, "_star_links", lambda stars, *rest: stars.where("false").select("u", "v"))
    rng = random.Random(11)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 40, 150]))] for _ in range(8)]
    texts = [edited(rng, b, rng.randrange(0, 1 + len(b) // 30)) + " end" * (k % 2) for b in base for k in range(8)]
    assert found(spark, texts, width=5, percent=80, within=10) == brute(texts, percent=80, width=5)
