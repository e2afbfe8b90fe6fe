import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewash.llm.packing import WordIds, best_fit, merged_counts, pack, pack_documents, splits_at_blanks

from .conftest import ODD_DOCS

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER, WORDS = Tokenizer.from_file(VOCABULARY), WordIds(VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aB'ſsSt ré dll\n\x85\xa0\x1c ½²7٣İıςΣ<|>-_—…é"), st.characters(codec="utf-8"))), max_size=4))
def test_ids_are_the_tokenizers(texts):
    assert [x.tolist() for x in WORDS.encode(texts)] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("text", ["It's we'll 'tis x'y ''s!!'s", "<|endoftext|> in a text", "a" * 1000, "d'été L'Été ÉTÉ", "1,234.5 ½"])
def test_ids_of_single_texts(text):
    assert WORDS.encode([text])[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_ids_after_words_were_forgotten(monkeypatch):
    from tidewash.llm import packing

    monkeypatch.setattr(packing, "WORDS", 20)
    words = WordIds(VOCABULARY)
    texts = [" ".join(f"w{i % 7} word{i * k}x, the" for i in range(30)) for k in range(12)]
    for text in texts + texts[::-1]:
        assert words.encode([text])[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
        assert len(words.place) <= 20


def check(rows, capacity):
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_fills_bins(lengths):
    bins, offsets, fill = best_fit(np.array(lengths, np.int64), 64)
    assert sum(fill) == sum(lengths) and all(f <= 64 for f in fill)
    assert sum(f <= 32 for f in fill) <= 1
    seen = np.zeros(len(fill), np.int64)
    for i in np.argsort(bins, kind="stable"):
        seen[bins[i]] += lengths[i]
    assert (seen == fill).all()


def test_levels_use_few_sequences(spark, monkeypatch):
    from tidewash.llm import packing

    monkeypatch.setattr(packing, "LEAF_ITEMS", 200)
    items = spark.range(8000).selectExpr("id AS item", "1 + id * 7919 % 3000 AS length")
    rows = pack(items).join(items, "item").collect()
    assert len(rows) == 8000
    total = sum(r.length for r in rows)
    assert check(rows, 4096) <= 1.01 * -(-total // 4096)


def test_last_round_takes_bins_that_no_part_handed_on(spark, monkeypatch):
    from tidewash.llm import packing

    monkeypatch.setattr(packing, "LEAF_ITEMS", 50)
    monkeypatch.setattr(packing, "HAND_ON", 0)
    # Each part ends with bins of 60 and of 3 free tokens, which fit into each other only across parts.
    items = spark.createDataFrame([(i, 37 if i % 3 else 100 - i % 5) for i in range(1000)], "item long, length long")
    rows = pack(items, 100).join(items, "item").collect()
    assert len(rows) == 1000
    singles = sum(r.length > 63 for r in rows)
    assert check(rows, 100) == singles + -(-(1000 - singles) // 2)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_counts_pack_like_single_bins(counts):
    found = merged_counts(counts, 40)
    assert all(sum(pattern) <= 40 and n > 0 for pattern, n in found)
    used = defaultdict(int)
    for pattern, n in found:
        for fill in pattern:
            used[fill] += n
    assert used == counts
    lengths = np.array([fill for fill, n in counts.items() for _ in range(n)], np.int64)
    assert abs(sum(n for _, n in found) - len(best_fit(lengths, 40)[2])) <= 1


def test_other_tokenizers_take_texts_whole(tmp_path):
    import json

    made = json.loads(TOKENIZER.to_str())
    assert splits_at_blanks(TOKENIZER)
    made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[^\r\n]+"
    other = tmp_path / "other.json"
    other.write_text(json.dumps(made))
    words, plain = WordIds(str(other)), Tokenizer.from_file(str(other))
    assert not words.by_words
    for text in ("two words", "It's  a\nlong text", ""):
        assert words.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_documents_round_trip(odd_docs):
    rows = pack_documents(odd_docs, VOCABULARY, capacity=100).collect()
    check(rows, 100)
    texts = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.piece):
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length and r.start == 100 * r.piece
        texts[r.id].append(r)
    for doc_id, text, *_ in ODD_DOCS:
        want = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]
        assert all(r.length == 100 for r in texts[doc_id] if r.start + 100 <= len(want)) or doc_id in (2, None)
        if doc_id not in (2, None):
            assert np.frombuffer(b"".join(r.ids for r in texts[doc_id]), "<u4").tolist() == want
    assert len(texts[2]) == 2 and len(texts[None]) == 2


def test_no_rows(no_docs):
    assert pack_documents(no_docs, VOCABULARY).count() == 0
