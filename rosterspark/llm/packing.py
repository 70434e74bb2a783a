"""Lexical retrieval packing: each window is filled with the BM25 neighbours of the document that starts it.

Documents are laid on a line in the order of their two heaviest terms, and the line is cut into shards of about
``SHARD_TOKENS`` tokens. So documents with the same heavy terms meet, a shard is small however large the corpus, and a
group of documents that holds a third of all rows is spread over as many shards as it fills. Document frequencies are
counted over the whole corpus (a table no longer than the vocabulary). Each shard builds an inverted index of BM25
weights; a seed's heaviest terms are its query, and its best unused neighbours follow it until the window is full; it is
asked again whenever those of one answer are used up, then with the terms that its query left out, and a new seed is taken
only when it has none left. A document that the window cuts goes on in the next window and is its seed. Only the last
window of a shard is short.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import in_parts, materialize

WINDOW, SHARD_TOKENS, END_ID = 1024, 1 << 19, 0
#: Added tokens of byte_bpe_50k.json: their strings are one id wherever a text holds them.
SPECIAL = {"<|endoftext|>": 50256}
#: Parts into which the documents of one heaviest term are ordered by their second.
LEADS = 8
#: BM25's constants; the terms of a query; the neighbours that one query returns (a seed may ask again).
K1, B, QUERY_TERMS, NEIGHBOURS = 1.2, 0.75, 64, 16


class Coder:
    """Ids as the tokenizers library gives them: by the same vocabulary's ranks, which is faster, and by the library itself for texts that the ranks' pattern can't take (very long runs of blanks)."""

    def __init__(self, ranks: str, pattern: str, vocabulary: str):
        with open(ranks, "rb") as lines:
            pairs = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=pairs, special_tokens=SPECIAL)
        self.vocabulary, self.largest = vocabulary, self.fast.max_token_value

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # the pattern's stack is full
            return np.array(_library(self.vocabulary).encode(text, add_special_tokens=False).ids, np.uint32)


@cache
def _library(vocabulary: str) -> Tokenizer:
    return Tokenizer.from_file(vocabulary)


@cache
def tokenizer(ranks: str, pattern: str, vocabulary: str) -> Coder:
    return Coder(ranks, pattern, vocabulary)


def lead(ids: np.ndarray) -> int:
    """The heaviest term of a document and the part of its second: terms weigh their count times the logarithm of their id, as ids follow rarity."""
    terms, count = np.unique(ids, return_counts=True)
    weight = count * np.log1p(terms)
    first = int(weight.argmax())
    weight[first] = -1
    return int(terms[first]) * LEADS + int(terms[weight.argmax()]) * LEADS // (1 << 16)


def tokenize(docs: DataFrame, ranks: str, pattern: str, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids, n, lead): the ids of each row's text as little-endian unsigned 16-bit integers, ``end_id`` last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(ranks, pattern, vocabulary)
        if coder.largest >= 1 << 16:
            raise ValueError("the vocabulary has over 65536 ids")
        for b in in_parts(batches):
            ids = [np.append(coder.encode(t.as_py() or ""), end_id).astype("<u2") for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array(map(len, ids), pa.int64()), pa.array(map(lead, ids), pa.int32())], names=["doc_id", "ids", "n", "lead"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, n long, lead int")


def document_frequencies(tokens: DataFrame) -> DataFrame:
    """(id, df): in how many documents each token id occurs; no more rows than the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 16, np.int64)
        for b in batches:
            for ids in b.column(0):
                seen[np.unique(np.frombuffer(ids.as_py(), "<u2"))] += 1
        found = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(found.astype(np.int32)), pa.array(seen[found])], names=["id", "df"])

    return tokens.select("ids").mapInArrow(run, "id int, df long").groupBy("id").agg(F.sum("df").alias("df"))


class Index:
    """BM25 weights of one shard: by document (for queries) and by term (for postings)."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        size = np.array([len(d) for d in docs])
        whole = size - 1  # the end id, which all have, is no term
        keys, tf = np.unique(np.repeat(np.arange(len(docs)), whole) << 16 | np.concatenate([d[:-1] for d in docs]), return_counts=True)
        doc, term = keys >> 16, keys & 0xFFFF
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean_length))
        self.count, self.terms, self.weight, self.starts = len(docs), term, weight, np.searchsorted(doc, np.arange(len(docs) + 1))
        by_term = np.argsort(term, kind="stable")
        self.posted, self.posted_weight, self.ends = doc[by_term], weight[by_term], np.searchsorted(term[by_term], np.arange((1 << 16) + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> list[int]:
        """The best unused documents for a seed, best first, ties by position; those that share no term are left out.

        The heaviest terms are the query; where they find nothing any more, the others are. A document without terms,
        which has the end id alone, has no neighbours, so any number of them takes no search.
        """
        own = slice(self.starts[seed], self.starts[seed + 1])
        terms = self.terms[own]
        if len(terms) > QUERY_TERMS:
            heavy = np.argpartition(-self.weight[own], QUERY_TERMS)
            return self._best(terms[heavy[:QUERY_TERMS]], unused) or self._best(terms[heavy[QUERY_TERMS:]], unused)
        return self._best(terms, unused)

    def _best(self, terms: np.ndarray, unused: np.ndarray) -> list[int]:
        if not len(terms):
            return []
        at = [slice(self.ends[t], self.ends[t + 1]) for t in terms]
        scores = np.bincount(np.concatenate([self.posted[s] for s in at]), np.concatenate([self.posted_weight[s] for s in at]), self.count)
        scores[~unused] = 0
        best = np.argpartition(-scores, NEIGHBOURS)[:NEIGHBOURS] if self.count > NEIGHBOURS else np.arange(self.count)
        best = best[scores[best] > 0]
        return best[np.lexsort((best, -scores[best]))].tolist()


def _order(index: Index, sizes: list[int], window: int) -> Iterator[int]:
    """Documents in the order in which they fill windows."""
    unused, room, following, first, seed = np.ones(len(sizes), bool), window, [], 0, None
    for _ in sizes:
        doc = next((d for d in following if unused[d]), None)
        if doc is None and seed is not None:  # the seed's next best, until it has none
            following = index.neighbours(seed, unused)
            doc = following[0] if following else None
        if doc is None:  # a new seed
            while not unused[first]:
                first += 1
            doc = seed = first
        unused[doc] = False
        yield doc
        over = sizes[doc] - room
        room = window - over % window if over >= 0 else -over
        if over >= 0:  # this document starts the next window
            seed, following = doc, []


def _pack_shard(table: pa.Table, idf: np.ndarray, mean_length: float, window: int) -> pa.Table:
    shard = table["shard"][0].as_py()
    table = table.sort_by("row")
    docs = [np.frombuffer(i.as_py(), "<u2").astype(np.int64) for i in table["ids"]]
    doc_id, sizes = table["doc_id"], [len(d) for d in docs]
    rows, at = [], 0
    for d in _order(Index(docs, idf, mean_length), sizes, window):
        start = 0
        while start < sizes[d]:
            take = min(window - at % window, sizes[d] - start)
            rows.append((d, start, take, sizes[d], shard << 32 | at // window, at % window, docs[d][start : start + take].astype("<u4").tobytes()))
            start, at = start + take, at + take
    picked, *cols = zip(*rows, strict=True)
    names = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    return pa.table({"doc_id": doc_id.take(pa.array(picked)), **{k: pa.array(c, pa.int64()) for k, c in zip(names, cols, strict=False)}, "ids": pa.array(cols[-1], pa.binary())})


def deal(tokens: DataFrame, shard_tokens: int) -> DataFrame:
    """``tokens`` with ``shard``: rows in the order of ``lead`` on a line as long as their tokens, those of one lead at even distances by a hash.

    There are at most ``LEADS`` leads for each id of the vocabulary, however many rows, so their table is broadcast.
    """
    sums = tokens.groupBy("lead").agg(F.sum("n").alias("long"))
    starts = sums.select("lead", "long", (F.sum("long").over(Window.orderBy("lead")) - F.col("long")).alias("begin"))
    share = F.pmod(F.xxhash64("row"), F.lit(1 << 20)) / (1 << 20)
    return tokens.join(F.broadcast(starts), "lead").withColumn("shard", F.floor((F.col("begin") + share * F.col("long")) / shard_tokens))


def pack(docs: DataFrame, ranks: str, pattern: str, vocabulary: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all rows of ``docs(doc_id, text)``: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers. A null or empty text is its end id alone.
    A text of any length is cut into as many pieces as it fills windows. Neighbours of equal weight follow by position. Repeated rows are packed each, and ids need not differ or be set. Other columns are ignored. An empty table gives
    an empty result. ``vocabulary`` is a file of the tokenizers library, ``ranks`` and ``pattern`` the same as ranks.
    """
    tokens = materialize(tokenize(docs, ranks, pattern, vocabulary).withColumn("row", F.monotonically_increasing_id()), "tokens")
    count, total = tokens.agg(F.count(F.lit(1)), F.sum("n")).first()
    idf = np.zeros(1 << 16)
    for id_, df in document_frequencies(tokens).collect():  # at most a row for each id of the vocabulary
        idf[id_] = np.log1p((count - df + 0.5) / (df + 0.5))
    dealt = deal(tokens, shard_tokens).select("shard", "row", "doc_id", "ids")
    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    mean_length = (total or 1) / max(count, 1)

    def run(table: pa.Table) -> pa.Table:
        return _pack_shard(table, idf, mean_length, window)

    return dealt.groupBy("shard").applyInArrow(run, shape)
