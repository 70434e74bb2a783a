"""Near copies by confirmed Jaccard similarity of word shingles, found through SimHash and bands of minima.

The pipeline's near-dedup stage takes as candidates what SimHash links: components of fingerprints over the same shingles,
by the covering masks of ``simhash_dedup``. At a similarity of 0.8 some 10 of 64 bits differ, too many for masks, so bands
of minima add candidates. All are confirmed on whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import close_pairs, grouped, whole_groups
from .graph import connected_components
from .shared import in_parts, materialize, split_by_slots, text_or_empty
from .simhash_dedup import SEED, fingerprint, near_edges

#: Near copies (``keep_one``): words of a shingle, similarity, bands of minima and minima of each; shingles hashed at once; most rounds of stars, nodes in a bucket above which there are any, and share of the rows of such buckets that a round must drop to be followed by another.
NEAR_WORDS, SIMILAR, BANDS, BAND_ROWS, MINIMA_AT_ONCE, STAR_ROUNDS, STAR_FROM, STAR_WORTH = 5, 0.8, 16, 6, 4096, 16, 64, 0.015
#: Nodes in a bucket up to which likely pairs leave their task to be confirmed; in larger ones sets are compared inside the tasks, in blocks of so many nodes.
PAIRS_MOST, SET_BLOCK = 16, 128
#: Share of minima that a pair's sketches have in common at least to be confirmed: two and a half deviations below ``SIMILAR``.
SKETCH_SHARE = SIMILAR - 2.5 * (SIMILAR * (1 - SIMILAR) / (BANDS * BAND_ROWS)) ** 0.5


def shingle_set(text: str) -> np.ndarray:
    """The 64-bit hashes of a text's different shingles of ``NEAR_WORDS`` words, sorted; of all its words if there are fewer."""
    words = text.encode().lower().split()
    if len(words) < NEAR_WORDS:
        shingles = iter([b" ".join(words)] if words else [])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(NEAR_WORDS)), strict=False))
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), ">u8").astype(np.uint64))


@cache
def _orders(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and terms modulo 2**64 that put hashes in ``n`` orders."""
    drawn = np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(2 * n)], np.uint64)
    return drawn[:n] | np.uint64(1), drawn[n:]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least hash of a set in each of ``BANDS * BAND_ROWS`` orders; two sets agree in each with the probability of their similarity."""
    factors, terms = _orders(BANDS * BAND_ROWS)
    least = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), MINIMA_AT_ONCE):
        np.minimum(least, (shingles[at : at + MINIMA_AT_ONCE, None] * factors + terms).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """A key for each band of minima; texts of Jaccard similarity s share one with probability 1 - (1 - s ** BAND_ROWS) ** BANDS."""
    keys = [xxhash.xxh64_intdigest(m.tobytes(), i) for i, m in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, blob, keys, sketch, fp) of each row with words: its text's digest, band keys, the last 16 bits of its minima, and its fingerprint."""
    rows = docs.select("doc_id", F.sha2(text_or_empty(), 256).alias("blob"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            sets = [shingle_set(t.as_py() or "") for t in b.column(2)]
            full = np.flatnonzero([len(s) > 0 for s in sets])
            least = [minima(sets[i]) for i in full]
            yield pa.record_batch([b.column(0).take(full), b.column(1).take(full), pa.array(map(band_keys, least), pa.list_(pa.int64())), pa.array([m.astype("<u2").tobytes() for m in least], pa.binary()), pa.array((fingerprint(b.column(2)[i].as_py(), NEAR_WORDS) for i in full), pa.int64())], names=["doc_id", "blob", "keys", "sketch", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, blob string, keys array<long>, sketch binary, fp long")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(node, shingles) of ``rows(node, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            found = pa.array([shingle_set(t.as_py() or "").view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))
            yield pa.record_batch([b.column(0), found], names=["node", "shingles"])

    return rows.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a group whose sketches agree in at least ``SKETCH_SHARE`` of their places, in the first band where the two meet."""
    for table in whole_groups(batches):
        node, band, sketch = table["node"].to_numpy(), table["band"].to_numpy(), np.stack([np.frombuffer(x.as_py(), "<u2") for x in table["sketch"]])
        bar = SKETCH_SHARE * sketch.shape[1]

        def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            same = sketch[a] == sketch[b]
            met = same.reshape(len(a), BANDS, BAND_ROWS).all(axis=2) & (np.arange(BANDS) < band[a][:, None])
            return (same.sum(axis=1) >= bar) & ~met.any(axis=1)

        a, b = close_pairs(table["g"].to_numpy(), table["side"].to_numpy(), close)
        yield pa.record_batch([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], names=["a", "b"])


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) for each node of a group that is a near copy of one before it that no other covers: ``a`` is covered by ``b``.

    Nodes come in the order of a hash. Sets are compared whole, one node's with all others at once.
    """
    for table in whole_groups(batches):
        g, found = table["g"].to_numpy(), [np.zeros((2, 0), np.int64)]
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        for at, end in zip(starts, np.r_[starts[1:], len(g)], strict=True):
            group = table.slice(at, end - at)
            node, at_hash = group["node"].to_numpy(), group["order"].to_numpy()
            lists = group["shingles"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            sizes = np.diff(lists.offsets.to_numpy())
            used, ids = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            begins, mark = np.r_[0, np.cumsum(sizes)[:-1]], np.zeros(len(used), np.int64)
            by = np.lexsort((node, at_hash))
            rank, free = np.argsort(by), np.ones(len(node), bool)
            for i in by:
                if not free[i]:
                    continue
                own = ids[begins[i] : begins[i] + sizes[i]]
                mark[own] = 1
                both = np.add.reduceat(mark[ids], begins)
                mark[own] = 0
                near = free & (rank > rank[i]) & (both >= SIMILAR * (sizes + sizes[i] - both))
                free &= ~near
                found.append(np.stack([node[near], np.full(near.sum(), node[i])]))
        a, b = np.concatenate(found, axis=1)
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def simhash_buckets(nodes: DataFrame) -> DataFrame:
    """(node, band, key) of ``nodes(node, fp)``: a bucket for each component of fingerprints that SimHash links, numbered after the bands."""
    prints = nodes.select("fp").distinct()
    linked = materialize(connected_components(near_edges(prints)).withColumnRenamed("node", "fp"), "near-linked")
    return nodes.join(linked, "fp", "left").select("node", F.lit(BANDS).alias("band"), F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp")).alias("key"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs(a, b)``, a written table, whose shingle sets have a Jaccard similarity of at least ``SIMILAR``; only their own sets move."""
    left, right = (split_by_slots(sets, pairs.select(F.col(c).alias("node")))[1].select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}"), F.size("shingles").alias(f"n_{c}")) for c in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    near = F.greatest("n_a", "n_b") * SIMILAR <= F.least("n_a", "n_b")
    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b", "n_a", "n_b", both.alias("both")).where(F.col("both") >= SIMILAR * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def near_copies(docs: DataFrame) -> DataFrame:
    """(blob): digests of the texts of ``docs(doc_id, text)`` that are near copies of a text that stays.

    A text goes only if its similarity to one that stays is confirmed, so neither chance nor a chain of links drops it.
    Candidates share a component of SimHash fingerprints or a band. While there are large buckets, in each round a text that is the smallest of
    all its buckets stays, and every other text of those buckets is compared with it (with one a band at most). That is
    linear in a bucket; it is repeated while it drops many rows of large buckets, as it does in groups of near copies; a
    round that only says what stays saves the tasks little and costs the driver some eight jobs' plans. What is left is compared in whole inside the tasks: in buckets of up to ``PAIRS_MOST`` sketches
    say which pairs may be alike, and only those are confirmed; in larger ones sets are compared there, and a text comes
    out with one that covers it, never with all it is like. Of linked texts some stay in order of a hash.
    """
    found = signatures(docs).groupBy("blob").agg(F.min("doc_id").alias("least"), F.min(F.struct("keys", "sketch", "fp")).alias("s"))
    nodes = materialize(found.orderBy("least", "blob").select(F.monotonically_increasing_id().alias("node"), "blob", "least", "s.keys", "s.sketch", "s.fp"), "near-nodes")
    rows = nodes.select("node", F.posexplode("keys").alias("band", "key")).union(simhash_buckets(nodes))
    sizes = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "near-sizes")
    alive = materialize(rows.join(sizes, "key").select("node", "band", "key"), "near-buckets")
    met = materialize(nodes.join(alive.select("node").distinct(), "node", "left_semi").select("node", "blob"), "near-met")
    _, texts = split_by_slots(docs.select(F.sha2(text_or_empty(), 256).alias("blob"), "text"), met.select("blob"))
    sets = materialize(shingle_sets(texts.join(met.hint("merge"), "blob")), "near-sets")
    if sets.count() > met.count():  # rows that repeat a text
        sets = materialize(sets.dropDuplicates(["node"]), "near-sets")

    gone = []
    for _ in range(STAR_ROUNDS):
        lows = materialize(alive.groupBy("key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1"), "near-lows")
        large = lows.where(F.col("n") > STAR_FROM)
        rows_before = large.agg(F.sum("n")).first()[0]
        if not rows_before:
            break
        here = materialize(alive.join(lows.drop("n"), "key").select("node", "b").distinct(), "near-here")  # at most a row for each band
        stay = materialize(here.groupBy("node").agg(F.min("b").alias("b")).where("node = b").select("b"), "near-stay")
        pairs = materialize(here.where("node != b").join(stay, "b", "left_semi").select(F.col("node").alias("a"), "b"), "near-pairs")
        gone.append(materialize(_confirmed(pairs, sets).select(F.col("a").alias("node")).distinct(), "near-gone"))
        dropped = alive.join(large.select("key"), "key", "left_semi").join(gone[-1], "node", "left_semi").count()
        alive = materialize(alive.join(stay.select(F.col("b").alias("node")).union(gone[-1]), "node", "left_anti"), "near-buckets")
        if dropped < STAR_WORTH * rows_before:
            break
    sizes = materialize(alive.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-sizes")
    few = alive.join(sizes.where(F.col("n") <= PAIRS_MOST).select("key"), "key")
    many = materialize(alive.join(sizes.where(F.col("n") > PAIRS_MOST).select("key"), "key").select("node", "key"), "near-many")
    likely = grouped(few.join(nodes.select("node", "sketch"), "node"), ["key"], "node").select("g", "side", "node", "band", "sketch").mapInArrow(_likely, "a long, b long")
    links = _confirmed(materialize(likely.distinct(), "near-pairs"), sets)
    first = F.struct(F.xxhash64("a"), F.col("a")) < F.struct(F.xxhash64("b"), F.col("b"))
    links = materialize(links.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("b")), "near-confirmed")
    while True:  # about the logarithm of the links in rounds, since a hash orders them
        covered = grouped(many.join(sets.hint("merge"), "node"), ["key"], "node", SET_BLOCK).select("g", "node", F.xxhash64("node").alias("order"), "shingles").mapInArrow(_covered, "a long, b long")
        edges = materialize(links.union(covered).distinct(), "near-links")
        if edges.isEmpty():
            break
        # What nothing covers stays, and among the rest, so that those it is like still meet it.
        stay = edges.select("b").join(edges.select(F.col("a").alias("b")), "b", "left_anti").distinct()
        gone.append(materialize(edges.join(stay, "b", "left_semi").select(F.col("a").alias("node")).distinct(), "near-gone"))
        links = materialize(links.join(gone[-1].withColumnRenamed("node", "a"), "a", "left_anti").join(gone[-1].withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"), "near-links")
        many = materialize(many.join(gone[-1], "node", "left_anti"), "near-many")
    if not gone:
        return nodes.limit(0).select("blob")
    return nodes.join(materialize(reduce(DataFrame.union, gone).distinct(), "near-gone"), "node", "left_semi").select("blob")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, but near copies: texts whose five-word shingles have a Jaccard similarity of at least ``SIMILAR`` with a text that stays.

    Equal texts stay or go together. A null or wordless text stays. Of pairs at 0.8 a share of ``BANDS`` and
    ``BAND_ROWS`` (0.992) is found, more of closer ones; what goes is confirmed on all shingles. Columns of any names
    pass unchanged. An empty table gives an empty result. Digests of texts that go are anti-joined; texts move
    only where a slot says that they may go.
    """
    gone = materialize(near_copies(docs), "near-copies")
    clear, others = split_by_slots(docs.select(F.struct("*").alias("row"), F.sha2(text_or_empty(), 256).alias("blob")), gone)
    return clear.unionByName(others.join(gone.hint("merge"), "blob", "left_anti")).select("row.*")
