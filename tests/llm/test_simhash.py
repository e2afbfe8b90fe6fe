import random

import numpy as np
import xxhash

from tidewash.llm.components import components
from tidewash.llm.simhash import close_classes, fingerprint, links, near_duplicates

from .conftest import ODD_DOCS


def plain_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, within=3):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= within:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_fingerprint_in_chunks():
    text = " ".join(random.Random(1).choices("alpha Beta\n gamma\t delta x yy zzz".split(" "), k=400))
    for chunk in (1, 7, 50, 1 << 20):
        assert fingerprint(text.encode(), chunk=chunk) & (2**64 - 1) == plain_fingerprint(text)
    assert fingerprint(b"") == fingerprint(b" \n ") == 0
    assert fingerprint(b"One two") & (2**64 - 1) == xxhash.xxh64_intdigest(b"one two", 42)


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(300)}
    for v in list(values)[:60]:  # chains and clusters
        for _ in range(rng.randint(1, 8)):
            for _ in range(rng.randint(1, 3)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    edges = links(spark.createDataFrame([(v,) for v in signed], "fp long"), leaf=16)
    got = {v: v for v in signed} | {r.node: r.root for r in components(edges).collect()}
    assert got == classes(signed)


def test_large_leaves_are_cut_into_blocks(spark, monkeypatch):
    from tidewash.llm import simhash

    monkeypatch.setattr(simhash, "MEMBERS", 8)
    monkeypatch.setattr(simhash, "QUERIES", 16)
    values = [i * 37 for i in range(120)]
    got = {v: v for v in values} | {r.node: r.root for r in components(links(spark.createDataFrame([(v,) for v in values], "fp long"))).collect()}
    assert got == classes(values)


def test_close_classes_alone():
    a = np.array([0, 1, 3, 1 << 40], np.int64)
    u, v = close_classes(a, a, 1)
    assert sorted(zip(u.tolist(), v.tolist())) == [(1, 0), (3, 0), (1 << 40, 0)]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(3, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 7 for i in range(8, 30)}}


def test_documents(odd_docs):
    rows = [(r.id, r.fingerprint & (2**64 - 1), r.component_id) for r in near_duplicates(odd_docs).collect()]
    want = []
    for doc_id, text, *_ in ODD_DOCS:
        same = [d for d, t, *_ in ODD_DOCS if (plain_fingerprint(t or "") ^ plain_fingerprint(text or "")).bit_count() <= 3]
        want.append((doc_id, plain_fingerprint(text or ""), min((d for d in same if d is not None), default=None)))
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_no_rows(no_docs):
    assert near_duplicates(no_docs).count() == 0
