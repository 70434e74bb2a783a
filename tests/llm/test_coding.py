import math
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rosterspark.llm import packing, queries, sentencepiece_codec

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids(table, text):
    return np.frombuffer(table.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=40))
def test_encoding_of_any_text(text):
    table = sentencepiece_codec.prefix_table(MODEL)
    assert ids(table, text) == [1, *table.model.encode(text), 2]


def test_encoding_of_piecewise_texts(library):
    table, rng = sentencepiece_codec.prefix_table(MODEL), random.Random(0)
    pieces = list(table.score)
    for _ in range(3000):
        text = "".join(rng.choice((rng.choice(pieces), " ", "▁", "  ", "\n", "é", "漢", "😀", "a")) for _ in range(rng.randint(0, 12)))
        assert ids(table, text) == [1, *library.encode(text), 2]


def test_long_texts(library):
    table = sentencepiece_codec.prefix_table(MODEL)
    for text in ("x" * 20_000, " " * 5_000, "ab" * 20_000, "word " * 20_000, "é漢" * 3_000):
        assert ids(table, text) == [1, *library.encode(text), 2]


def test_memo_forgets(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "MEMO_ENTRIES", 5)
    monkeypatch.setattr(sentencepiece_codec, "PAIR_ENTRIES", 5)
    table = sentencepiece_codec.PrefixTable(MODEL)
    text = " ".join(f"word{i} thing" for i in range(40))
    assert ids(table, text) == [1, *table.model.encode(text), 2] and len(table.memo) <= 5 and len(table.pairs) <= 5


def test_documents_round_trip(odd_docs, no_docs, small, library):
    for docs in (odd_docs, small("documents")):
        rows = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, MODEL), MODEL)
        found = sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in rows.collect()), key=repr)
        expected = []
        for r in docs.select("doc_id", "text").collect():
            e = [1, *library.encode(r.text or ""), 2]
            expected.append((r.doc_id, np.array(e, "<u4").tobytes(), library.decode(e)))
        assert found == sorted(expected, key=repr)
    assert sentencepiece_codec.encode(no_docs, MODEL).isEmpty()


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=40))
def test_ranks_give_the_same_ids(text):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")) if not hasattr(test_ranks_give_the_same_ids, "kept") else test_ranks_give_the_same_ids.kept
    test_ranks_give_the_same_ids.kept = reference
    own = packing.tokenizer(queries.RANKS, queries.PATTERN, queries.VOCABULARY)
    assert own.encode(text).tolist() == reference.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext", "  <|endoftext|>  <|ENDOFTEXT|> "])
def test_special_strings_give_the_same_ids(spark, reference, text):
    row = packing.tokenize(spark.createDataFrame([(1, text)], "doc_id long, text string"), queries.RANKS, queries.PATTERN, queries.VOCABULARY).first()
    assert np.frombuffer(row.ids, "<u2").tolist() == [*reference.encode(text, add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a <|endoftext|>" + " " * 900_000 + "b"])
def test_very_long_runs_give_the_same_ids(spark, reference, text):
    row = packing.tokenize(spark.createDataFrame([(1, text)], "doc_id long, text string"), queries.RANKS, queries.PATTERN, queries.VOCABULARY).first()
    assert np.frombuffer(row.ids, "<u2").tolist() == [*reference.encode(text, add_special_tokens=False).ids, 0]


def test_related_documents_meet(spark):
    """Two hundred documents of four topics in shards for fifty: with terms of its own, a topic fills its shards."""
    rng = random.Random(1)
    topics = [[f"{a}{b}" for b in ("tion", "ment", "ness", "ship", "hood")] for a in ("quartz", "magnet", "violet", "walrus")]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(topics[i % 4]) for _ in range(60))) for i in range(200)], "doc_id long, text string")
    tokens = packing.tokenize(docs, queries.RANKS, queries.PATTERN, queries.VOCABULARY).withColumn("row", F.col("doc_id"))
    total = tokens.agg(F.sum("n")).first()[0]
    shards: dict = {}
    for r in packing.deal(tokens, total // 4).collect():
        shards.setdefault(r.shard, []).append((r.lead, r.doc_id % 4))
    leads = [[lead for lead, _ in shards[s]] for s in sorted(shards)]
    assert 3 <= len(shards) <= 6 and all(max(a) <= min(b) for a, b in zip(leads, leads[1:]))  # one line, cut
    same = sum(max(sum(t == k for _, t in s) for k in range(4)) for s in shards.values())
    assert same > 0.5 * 200  # dealt at random it is about 0.3


def check_packing(docs, reference, window, **kw):
    rows = packing.pack(docs, queries.RANKS, queries.PATTERN, queries.VOCABULARY, window, **kw).collect()
    expected = sorted(((r.doc_id, tuple(reference.encode(r.text or "", add_special_tokens=False).ids) + (0,)) for r in docs.select("doc_id", "text").collect()), key=repr)
    by_sequence, by_doc = {}, {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by_sequence.get(r.sequence_id, 0) and len(r.ids) == 4 * r.length and r.length > 0
        by_sequence[r.sequence_id] = r.offset + r.length
        by_doc.setdefault(r.doc_id, []).append((r.start, r.sequence_id, r.offset, r.doc_tokens, np.frombuffer(r.ids, "<u4").tolist()))
    assert all(0 < n <= window for n in by_sequence.values())
    found = []
    for doc, pieces in by_doc.items():  # rows that repeat an id follow each other in their shards' sequences
        for start in [p for p in pieces if p[0] == 0]:
            text, at, where = [], 0, start
            rest = sorted((p for p in pieces if p[1:3] >= start[1:3]), key=lambda p: p[1:3])
            for where in rest:
                if where[0] == at and (at == 0) == (where is start):
                    text += where[4]
                    at += len(where[4])
                    if at == where[3]:
                        break
            found.append((doc, tuple(text)))
    assert sorted(found, key=repr) == expected
    return by_sequence


@pytest.mark.parametrize(("window", "kw"), [(1024, {}), (64, {"shard_tokens": 4000}), (8, {"shard_tokens": 500})])
def test_packing_covers_each_id_once(odd_docs, small, reference, window, kw):
    check_packing(small("documents"), reference, window, **kw)
    check_packing(odd_docs, reference, window, **kw)


def test_packing_wastes_little(small, reference):
    used = check_packing(small("documents"), reference, 1024)
    assert sum(1024 - n for n in used.values()) / (1024 * len(used)) < 0.02


def test_packing_empty(no_docs):
    assert packing.pack(no_docs, queries.RANKS, queries.PATTERN, queries.VOCABULARY).isEmpty()


def test_neighbours_share_terms():
    docs = [np.array(d) for d in ([1, 2, 3, 0], [9, 8, 7, 0], [1, 2, 4, 0], [7, 8, 5, 0])]
    idf = np.zeros(1 << 16)
    idf[1:10] = 1.0
    index = packing.Index(docs, idf, 4.0)
    assert index.neighbours(0, np.array([False, True, True, True])) == [2]
    assert index.neighbours(1, np.array([True, False, True, True])) == [3]
    assert list(packing._order(index, [4] * 4, 8)) == [0, 2, 1, 3]


def test_seed_asks_until_it_has_no_neighbours():
    """Forty documents of one topic dealt between others: a window for 40 holds no other, though one answer is 16."""
    docs = [np.array([1, 2, i + 10, 0] if i % 2 == 0 else [3, 4, i + 10, 0]) for i in range(80)]
    idf = np.zeros(1 << 16)
    idf[1:100] = 1.0
    order = list(packing._order(packing.Index(docs, idf, 4.0), [4] * 80, 160))
    assert sorted(order) == list(range(80)) and [{d % 2 for d in order[i : i + 40]} for i in (0, 40)] == [{0}, {1}]


def test_neighbours_equal_plain_bm25():
    """The 16 best of a shard and their order, by BM25 term by term; the end id counts for the length alone."""
    draw = np.random.default_rng(3)
    docs = [np.append(draw.zipf(1.3, draw.integers(0, 60)) % 500 + 1, 0) for _ in range(150)]
    idf = np.zeros(1 << 16)
    for t in range(501):
        idf[t] = math.log1p((len(docs) - (n := sum(t in d for d in docs)) + 0.5) / (n + 0.5))
    mean = sum(map(len, docs)) / len(docs)
    index, unused = packing.Index(docs, idf, mean), draw.random(150) < 0.8
    for seed in range(0, 150, 5):
        scores = {}
        for i, d in enumerate(docs):
            for t in set(docs[seed][:-1].tolist()):
                if unused[i] and (tf := d[:-1].tolist().count(t)):
                    scores[i] = scores.get(i, 0) + idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        wanted = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[: packing.NEIGHBOURS]
        found = index.neighbours(seed, unused)
        assert [round(scores[i], 8) for i in found] == [round(scores[i], 8) for i in wanted]


def test_documents_without_terms_take_no_search():
    began = time.time()
    docs = [np.array([0])] * 200_000 + [np.array([5, 0])] * 3
    assert list(packing._order(packing.Index(docs, np.ones(1 << 16), 1.0), [len(d) for d in docs], 1024)) == list(range(200_003))
    assert time.time() - began < 20
