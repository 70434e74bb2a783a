"""Language identification by a byte convolutional network, written and trained in numpy.

A window is ``WINDOW`` bytes of lower-cased UTF-8. Filters of several widths run over its bytes, each keeps its largest
response, and a softmax layer gives the probability of each language. A text is cut into windows over its whole length;
its languages' probabilities are the means over its windows, weighted by their bytes.

A filter of width w is w tables of a weight per byte value, so a response is a sum of lookups. For use, the tables of
adjacent positions are joined into tables over byte pairs, which halves the lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, fold, pieces_over

#: Folds of the split and the held-out one; documents that are learnt from and windows of each; pieces of a long text, evenly spread, that these come from, and characters of a piece.
FOLDS, HELD_OUT, TRAIN_ROWS, TRAIN_WINDOWS, TRAIN_PIECES, PIECE_CHARS = 4, 2, 4000, 3, 8, 1024
#: Bytes of a window; widths of filters and how many of each; epochs, windows in a step, learning rate; windows at once in use, and windows of several texts that are put together.
WINDOW, WIDTHS, FILTERS, EPOCHS, STEP, RATE, AT_ONCE, TOGETHER = 256, (2, 3, 4), 8, 12, 64, 0.01, 64, 4096


class Network(NamedTuple):
    langs: tuple[str, ...]
    tables: np.ndarray  # position, byte, filter
    bias: np.ndarray
    dense: np.ndarray  # filter, language
    dense_bias: np.ndarray


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Windows (n, WINDOW) over the whole text, the last padded with zeros, and the bytes that each holds."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = data
    size = np.full(n, WINDOW)
    size[-1] = len(data) - (n - 1) * WINDOW
    return out.reshape(n, WINDOW), size


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train_network(x: np.ndarray, y: np.ndarray, langs: tuple[str, ...], seed: int = 0) -> Network:
    """Fit by Adam on cross-entropy; only the position of each filter's largest response has a gradient."""
    rng, wide, k = np.random.default_rng(seed), max(WIDTHS), len(WIDTHS) * FILTERS
    width = np.repeat(WIDTHS, FILTERS)
    used = (np.arange(wide)[:, None] < width[None, :]).astype(np.float32)
    params = [rng.normal(0, 0.3, (wide, 256, k)).astype(np.float32) * used[:, None, :], np.zeros(k, np.float32), rng.normal(0, 0.3, (k, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)]
    moments, squares, steps = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    span = WINDOW - wide + 1
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), STEP):
            rows = order[at : at + STEP]
            b, n = x[rows], len(rows)
            response = sum(params[0][j][b[:, j : j + span]] for j in range(wide))
            best = response.argmax(axis=1)
            top = np.take_along_axis(response, best[:, None, :], 1)[:, 0] + params[1]
            hidden = np.maximum(top, 0)
            delta = _softmax(hidden @ params[2] + params[3])
            delta[np.arange(n), y[rows]] -= 1
            delta /= n
            back = (delta @ params[2].T) * (top > 0)
            tables = np.zeros_like(params[0])
            for j in range(wide):
                np.add.at(tables[j], (b[np.arange(n)[:, None], best + j], np.arange(k)[None, :]), back * used[j])
            steps += 1
            for i, g in enumerate((tables, back.sum(0), hidden.T @ delta, delta.sum(0))):
                moments[i] = 0.9 * moments[i] + 0.1 * g
                squares[i] = 0.999 * squares[i] + 0.001 * g * g
                params[i] -= (RATE * moments[i] / (1 - 0.9**steps) / (np.sqrt(squares[i] / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
    return Network(langs, *params)


def train(docs: DataFrame) -> Network | None:
    """Learn from a bounded sample of the rows outside the held-out fold that have a language; None if there are none.

    Up to ``TRAIN_WINDOWS`` windows, evenly spread over its whole length, are taken from each.
    """
    known = docs.where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & (F.trim("text") != "")).select("doc_id", "lang", pieces_over(F.col("text"), TRAIN_PIECES, PIECE_CHARS).alias("text"))
    rows = sorted(((r[1], r[2]) for r in bounded_sample(known, "doc_id", TRAIN_ROWS).collect()))
    langs = tuple(sorted({lang for lang, _ in rows}))
    if not langs:
        return None
    x, y = [], []
    for lang, text in rows:
        w = windows(text)[0]
        picked = w[np.unique(np.linspace(0, len(w) - 1, TRAIN_WINDOWS).round().astype(int))]
        x.append(picked)
        y += [langs.index(lang)] * len(picked)
    return train_network(np.concatenate(x), np.array(y), langs)


class Predictor:
    """A network with its tables joined for byte pairs."""

    def __init__(self, net: Network):
        t = net.tables
        if len(t) % 2:
            t = np.concatenate([t, np.zeros_like(t[:1])])
        self.net, self.pairs = net, [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, len(t), 2)]

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (window, language)."""
        out = []
        span = WINDOW - max(WIDTHS) + 1
        for at in range(0, len(x), AT_ONCE):
            b = x[at : at + AT_ONCE].astype(np.int32)
            pair = b[:, :-1] * 256 + b[:, 1:]
            response = self.pairs[0].take(pair[:, :span], axis=0)
            for j, table in enumerate(self.pairs[1:], 1):
                response += table.take(pair[:, 2 * j : 2 * j + span], axis=0)
            out.append(_softmax(np.maximum(response.max(axis=1) + self.net.bias, 0) @ self.net.dense + self.net.dense_bias))
        return np.concatenate(out)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score for each row; ``und`` with score 0 for a text that is null or has no letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = Predictor(net) if net else None
        for b in batches:
            langs, scores, held, count = ["und"] * b.num_rows, [0.0] * b.num_rows, [], 0

            def settle() -> None:
                """Run the held windows through the network together, and give each text the mean over its own."""
                if not held:
                    return
                size = np.concatenate([s for _, _, s in held]).astype(np.float64)
                starts = np.cumsum([0, *(len(s) for _, _, s in held[:-1])])
                mean = np.add.reduceat(use.windows(np.concatenate([x for _, x, _ in held])) * size[:, None], starts) / np.add.reduceat(size, starts)[:, None]
                for (i, _, _), m in zip(held, mean, strict=True):
                    langs[i], scores[i] = use.net.langs[int(m.argmax())], min(1.0, float(m.max()))
                held.clear()

            for i, t in enumerate(b.column(1)):
                text = t.as_py()
                if use is None or not text or not any(map(str.isalpha, text)):
                    continue
                held.append((i, *windows(text)))
                count += len(held[-1][2])
                if count >= TOGETHER:
                    settle()
                    count = 0
            settle()
            yield pa.record_batch([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs(doc_id, text, lang)``.

    Texts are scored from their bytes alone, long ones in windows over their whole length. A text that is null or has no
    letters is ``und``. Repeated rows are scored each; other columns are ignored. An empty table gives an empty result,
    and where no row can be learnt from every prediction is ``und``.
    """
    return predict(docs, train(docs)).select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
