"""SentencePiece (BPE) encoding by a merge-type prefix table, and decoding.

For byte-pair merges each prefix of a text has one encoding, so one last token. A sequence of tokens is that encoding
exactly if every adjacent pair in it is compatible, that is, if merging the pair's joined string gives the pair again.
So one pass of an automaton over the text finds every token that ends at each position, the pair test leaves the one
that can follow the last token of the prefix before it, and the table of last tokens is read backwards for the ids.
Characters outside the vocabulary join with nothing and become byte tokens. The pass is linear in the text.

No piece has a word mark behind another character, so encodings never cross the start of a run of word marks; the
table is built for one such segment at a time and short segments are remembered within a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

MARK = "▁"
SEGMENTS = re.compile(f"{MARK}+[^{MARK}]*")
#: Bounds of what a Python worker remembers (words, their length, pairs), and of the bytes in one output batch.
MEMO_ENTRIES, MEMO_LENGTH, PAIR_ENTRIES, BATCH_BYTES = 300_000, 48, 700_000, 4 << 20


class PrefixTable:
    """The merges of one model: pieces, the pair test and the table of last tokens."""

    def __init__(self, model: str):
        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.piece = {i: sp.id_to_piece(i) for i in plain}
        self.score = {self.piece[i]: sp.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("the model has pieces with a word mark behind another character")
        self.byte_ids = [np.uint32(sp.piece_to_id(f"<0x{b:02X}>")).tobytes() for b in range(256)]
        self.bos, self.eos = (np.uint32(i).tobytes() for i in (sp.bos_id(), sp.eos_id()))
        self.tokens = ahocorasick.Automaton()
        for i, p in self.piece.items():
            if self.merge(p) == [p]:  # other pieces never arise
                self.tokens.add_word(p, (i, len(p)))
        self.tokens.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.memo = Memo(self)

    def merge(self, text: str) -> list[str]:
        """The merges themselves, on a short string: the best score first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            options = [(-s, k) for k in range(len(parts) - 1) if (s := self.score.get(parts[k] + parts[k + 1])) is not None]
            if not options:
                break
            k = min(options)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            a, b = self.piece[left], self.piece[right]
            known = self.pairs[key] = self.merge(a + b) == [a, b]
        return known

    def segment(self, text: str) -> bytes:
        """Ids of one segment as little-endian unsigned 32-bit integers."""
        last: list[tuple[int, int] | None] = [None] * (len(text) + 1)
        pairs = self.pairs
        for end, token in self.tokens.iter(text):
            if last[end + 1] is None:
                before = last[end + 1 - token[1]]
                if before is None:  # the start, or a character outside the vocabulary
                    last[end + 1] = token
                else:
                    fits = pairs.get(before[0] << 32 | token[0])
                    if fits or fits is None and self.compatible(before[0], token[0]):
                        last[end + 1] = token
        out, at = [], len(text)
        while at:
            token = last[at]
            if token is None:
                at -= 1
                out += [self.byte_ids[b] for b in reversed(text[at].encode())]
            else:
                out.append(token[0].to_bytes(4, "little"))
                at -= token[1]
        out.reverse()
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, begin and end ids included."""
        if not text:
            return self.bos + self.eos
        words, memo = text.replace(MARK, " ").split(" "), self.memo
        if "" in words:  # runs of blanks, or blanks at an end
            ids = b"".join(map(memo.segment, SEGMENTS.findall(MARK + MARK.join(words))))
        else:
            ids = b"".join(map(memo.__getitem__, words))
        return self.bos + ids + self.eos

    def decode(self, ids: bytes) -> str:
        return self.model.decode(np.frombuffer(ids, "<u4").tolist())


class Memo(dict):
    """Word (without its mark) to ids; forgets all when full, and never keeps long words."""

    def __init__(self, table: PrefixTable):
        super().__init__()
        self.table = table

    def __missing__(self, word: str) -> bytes:
        ids = self.table.segment(MARK + word)
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[word] = ids
        return ids

    def segment(self, marked: str) -> bytes:
        return self.table.segment(marked) if marked.startswith(MARK * 2) else self[marked[1:]]


@cache
def prefix_table(model: str) -> PrefixTable:
    return PrefixTable(model)


def _batches(keys: pa.Array, values: Iterator[tuple[bytes | str, ...]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size: the keys and what was made for each."""
    rows, size, start = [], 0, 0
    for row in values:
        rows.append(row)
        size += sum(map(len, row))
        if size >= BATCH_BYTES:
            yield pa.record_batch([keys.slice(start, len(rows)), *(pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True))], names=names)
            start, rows, size = start + len(rows), [], 0
    if rows:
        yield pa.record_batch([keys.slice(start, len(rows)), *(pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True))], names=names)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ``ids`` (binary: little-endian unsigned 32-bit ids, begin and end ids included) of each row.

    A null or empty text has the begin and the end id only. A text of any length is encoded whole, in time in proportion
    to it. Repeated rows are encoded each. Other columns are ignored. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(model)
        for b in batches:
            yield from _batches(b.column(0), ((table.encode(t.as_py() or ""),) for t in b.column(1)), ["doc_id", "ids"], [pa.binary()])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and ``decoded``, the model's own decoding of ``ids``; null ids decode to the empty text.

    Repeated rows are decoded each. Other columns are ignored. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(model)
        for b in batches:
            values = ((i.as_py() or b"", table.decode(i.as_py() or b"")) for i in b.column(1))
            yield from _batches(b.column(0), values, ["doc_id", "ids", "decoded"], [pa.binary(), pa.string()])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")
