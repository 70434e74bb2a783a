"""Toxicity by compression distance: a text is cut in windows, and each is compressed with a dictionary learnt from toxic
text and one learnt from ordinary text; the bytes that the first saves over the second are the evidence.

A dictionary holds the word starts that mark its class, those whose document frequency there is several times that in the
other class. What is common to both classes would help both dictionaries alike and add only noise. Every window begins with a fixed primer that both dictionaries hold, so that each
window compresses, and one marked word already shows in its length; windows are so short that literals stay raw.
Savings are calibrated to a probability by logistic regression on labelled rows, each under dictionaries that have not
seen it; the dictionaries in use are then learnt from all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_sample, fold, pieces_over, text_or_empty

#: Folds of the label split; the held-out one. Labelled rows of each class that are learnt from; pieces of a long text, evenly spread, that are, and characters of a piece.
FOLDS, HELD_OUT, TOXIC_ROWS, ORDINARY_ROWS, TRAIN_PIECES, PIECE_CHARS = 5, 0, 2000, 4000, 10, 2000
#: Parts of the training rows for calibration.
PARTS = 3
#: Bytes of a window; of a word start (its blank included); how much commoner it must be in its class; least documents (count, share); bytes of a dictionary.
WINDOW, SHORTEST, LONGEST, ODDS, LEAST, LEAST_SHARE, DICTIONARY = 56, 6, 14, 20.0, 4, 0.008, 8192
#: Bytes that a window must save to count as strong evidence: a chance match saves less.
STRONG = 3
#: Text that both dictionaries and every window hold.
PRIMER = b"Lorem ipsum dolor sit amet, consectetur adipisici elit, sed eiusmod tempor "
PUNCTUATION = b".,;:!?\"'()"


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    bias: float


def _starts(text: str) -> set[bytes]:
    """The words of a text with a blank on either side, and their beginnings."""
    words = {b" " + w.strip(PUNCTUATION) + b" " for w in text.lower().encode().split()}
    return {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


class Sample:
    """A training text and the hashes of its word starts, sorted, so that the texts are gone through once."""

    def __init__(self, text: str):
        self.text = text
        self.starts = np.unique(np.array([xxhash.xxh64_intdigest(w) for w in _starts(text)], np.uint64))


def _found(marks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the sorted ``marks`` are in ``starts``, as places."""
    at = np.searchsorted(marks, starts)
    return at[(at < len(marks)) & (marks[np.minimum(at, len(marks) - 1)] == starts)] if len(marks) else at[:0]


def _counts(marks: np.ndarray, texts: list[Sample]) -> np.ndarray:
    """In how many texts each mark is."""
    out = np.zeros(len(marks), np.int64)
    for t in texts:
        out[_found(marks, t.starts)] += 1
    return out


def learn_dictionary(own: list[Sample], other: list[Sample]) -> bytes:
    """Word starts that mark ``own`` texts, the strongest last, where zstd finds them cheapest.

    They are taken greedily by the texts that they mark; a text that has marks already counts half as much for each, so
    that many copies of one text do not bring in all of its words.
    """
    least, bar = max(LEAST, LEAST_SHARE * len(own)), ODDS * (len(own) + 1) / (len(other) + 1)
    seen, df = np.unique(np.concatenate([t.starts for t in own]), return_counts=True)
    seen, df = seen[df >= least], df[df >= least]
    chosen = df + 0.5 >= bar * (_counts(seen, other) + 0.5)
    seen, wanted, names = seen[chosen], set(seen[chosen].tolist()), {}
    for t in own:
        if len(names) == len(wanted):
            break
        names |= {h: w for w in _starts(t.text) if (h := xxhash.xxh64_intdigest(w)) in wanted and h not in names}
    marks = sorted(names.values(), key=lambda w: (-len(w), w))
    place = {w: i for i, w in enumerate(marks)}
    rank = np.array([place[names[h]] for h in seen.tolist()], np.int64)
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *(np.c_[rank[found], np.full(len(found), k)] for k, t in enumerate(own) if len(found := _found(seen, t.starts)))])
    share, taken, open_ = np.ones(len(own)), [], np.ones(len(marks), bool)
    while marks and sum(map(len, taken)) < DICTIONARY:
        gain = np.where(open_, np.bincount(pairs[:, 0], share[pairs[:, 1]], len(marks)), 0)
        best = int(gain.argmax())
        if gain[best] < least / 2:
            break
        taken.append(marks[best])
        share[pairs[pairs[:, 0] == best, 1]] /= 2
        for n in range(SHORTEST, len(marks[best]) + 1):
            open_[place.get(marks[best][:n], best)] = False
    return b"\n".join(reversed(taken))


@cache
def _compressors(toxic: bytes, ordinary: bytes) -> list[zstandard.ZstdCompressor]:
    shape = zstandard.ZstdCompressionParameters.from_level(3, min_match=SHORTEST, strategy=zstandard.STRATEGY_GREEDY, window_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)
    return [zstandard.ZstdCompressor(compression_params=shape, dict_data=zstandard.ZstdCompressionDict(d + b"\n" + PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for d in (toxic, ordinary)]


def windows(text: str) -> Iterator[bytes]:
    """The whole text in windows of at most ``WINDOW`` bytes, cut at blanks where there are any in the second half."""
    data, at = b" ".join(text.lower().encode().split()), 0
    while at < len(data):
        end = at + WINDOW
        if end < len(data):
            blank = data.rfind(b" ", at + WINDOW // 2, end)
            end = blank if blank > 0 else end
        yield b" " + data[at:end].strip() + b" "
        at = end


def savings(text: str, toxic: bytes, ordinary: bytes) -> tuple[float, ...]:
    """Features of a text, on a log scale: bytes saved over its windows (mean, largest, sum), and their strong part (mean, sum); zeros for an empty one."""
    a, b = _compressors(toxic, ordinary)
    total = most = count = strong = 0
    for w in windows(text):
        saved = len(b.compress(PRIMER + w)) - len(a.compress(PRIMER + w))
        count += 1
        if saved > 0:
            total += saved
            most = max(most, saved)
            strong += max(saved - STRONG, 0)
    count = max(count, 1)
    return tuple(np.log1p([20 * total / count, most, total, 20 * strong / count, strong]).tolist())


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method."""
    design, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T * (weight * p * (1 - p)) @ design + penalty, design.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from a bounded sample of the labelled rows outside the held-out fold.

    A document with several labels is toxic if any of them says so; of several texts of one id the smallest is learnt from.
    Of a long text, pieces over its whole length are. Without labelled rows of both classes nothing can be
    told apart: then every text scores the share of toxic labels.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = [known.where(F.col("toxic") == value).count() for value in (1, 0)]
    drawn = [bounded_sample(known.where(F.col("toxic") == value), "doc_id", rows) for value, rows in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))]
    ids = F.broadcast(drawn[0].union(drawn[1]))  # at most twice both bounds
    found = docs.select("doc_id", pieces_over(text_or_empty(), TRAIN_PIECES, PIECE_CHARS).alias("text")).join(ids, "doc_id")
    found = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # ids may repeat
    rows = found.orderBy("doc_id").collect()
    texts = [[Sample(r.text) for r in rows if r.toxic == value] for value in (1, 0)]
    toxic, ordinary = texts
    prior = totals[0] / max(sum(totals), 1)
    if min(len(toxic), len(ordinary)) < 3:
        return Model(b"", b"", (0.0,) * 5, float(np.log((prior + 1e-3) / (1 - prior + 1e-3))))
    x, y, weight = [], [], []
    for part in range(PARTS):  # texts are calibrated under dictionaries that have not seen them
        seen = [[t for i, t in enumerate(c) if i % PARTS != part] for c in texts]
        rest = [[t for i, t in enumerate(c) if i % PARTS == part] for c in texts]
        dictionaries = [learn_dictionary(seen[k], seen[1 - k]) for k in (0, 1)]
        for c, value, total in zip(rest, (1.0, 0.0), totals, strict=True):
            x += [savings(t.text, *dictionaries) for t in c]
            y += [value] * len(c)
            weight += [total / max(len(c), 1)] * len(c)
    x, y, weight = map(np.array, (x, y, weight))
    dictionaries = [learn_dictionary(texts[k], texts[1 - k]) for k in (0, 1)]
    w, bias = fit_logistic(x, y, weight * len(y) / weight.sum())
    return Model(*dictionaries, tuple(w.tolist()), bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and ``score`` (0 to 1) of each row of ``docs(doc_id, text)``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([savings(t.as_py() or "", model.toxic, model.ordinary) for t in b.column(1)]).reshape(-1, len(model.weights))
            yield pa.record_batch([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(x @ np.array(model.weights) + model.bias, -30, 30))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs(doc_id, text)``; ``labels(doc_id, toxic)``.

    A null text is empty, and an empty one scores like a text without any evidence. Repeated rows are scored each; other
    columns are ignored; an empty table gives an empty result.
    """
    return score(docs, train(docs, labels)).select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under 0.5.

    Null and empty texts are scored like any other, equal texts alike; repeated rows stay or go together. Columns of any
    names pass unchanged. An empty table gives an empty result.
    """
    model, at = train(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([savings(t.as_py() or "", model.toxic, model.ordinary) for t in b.column(0).field(at)]).reshape(-1, len(model.weights))
            yield b.filter(pa.array(x @ np.array(model.weights) + model.bias < 0))

    rows = docs.select(F.struct("*").alias("row"))  # one column, so that any names pass
    return rows.mapInArrow(run, T.StructType([T.StructField("row", docs.schema)])).select("row.*")
