"""SimHash near-deduplication by covering locality-sensitive hashing.

A fingerprint has 64 bits, each the majority of that bit over the hashes of a text's word shingles. Each bit position is
given a nonzero vector of ``radius + 1`` bits, and table ``v`` keeps the positions whose vector has an odd product with
``v``. The vectors of the at most ``radius`` positions in which two fingerprints differ leave some ``v`` orthogonal to
them all, so the two agree in table ``v``: no pair within the radius is missed.

Equal fingerprints are one node, however many texts share them. A bucket with up to ``BUCKET_MOST`` nodes is compared
in a task, what is tied already with nothing but the rest, and emits a spanning forest, never its pairs. For a larger bucket, each node names every value within half
the radius of it over the positions that the table leaves free; two nodes name a common value exactly if they are within
the radius, so joining on those values is exact, linear in the bucket, and spread over the cluster.

A stage of the pipeline drops near copies by confirmed Jaccard similarity instead (``near_dedup``): at 0.8 some 10 of 64
bits differ, too many for masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import close_pairs, smallest_reached, whole_groups
from .graph import connected_components
from .shared import in_parts, join_least, materialize

BITS, SEED, SHINGLE_WORDS, RADIUS = 64, 42, 4, 4
#: Nodes in a bucket up to which it is compared in whole; and shingles hashed at once.
BUCKET_MOST, SHINGLES_AT_ONCE = 1 << 15, 1 << 18
#: Nodes of a bucket from which on it is compared by itself, node by node, instead of along with others.
ALONE = 64


def fingerprint(text: str, words_in_shingle: int = SHINGLE_WORDS) -> int:
    """The fingerprint as a signed 64-bit integer; zero for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < words_in_shingle:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_in_shingle)), strict=False))
    total, ones = 0, np.zeros(BITS, np.int64)
    digests = map(xxhash.xxh64_digest, shingles, repeat(SEED))
    while block := b"".join(d for _, d in zip(range(SHINGLES_AT_ONCE), digests, strict=False)):
        bits = np.unpackbits(np.frombuffer(block, np.uint8)).reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(bits)
    return int(np.packbits(ones * 2 > total).view(">u8")[0].astype(np.int64))


def fingerprints(docs: DataFrame, words_in_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of each row of ``docs(doc_id, text)``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array((fingerprint(t.as_py() or "", words_in_shingle) for t in b.column(1)), pa.int64())
            yield pa.record_batch([b.column(0), found], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The positions that each table keeps, as signed 64-bit integers."""
    size = 2 ** (radius + 1) - 1
    vector = [i % size + 1 for i in range(BITS)]
    masks = (sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2) for v in range(1, size + 1))
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def roots_of(bits: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of a bucket a place of one that it is tied to, the same for all that are tied.

    What has been reached is compared with nothing but what has not, so a bucket of near copies needs about one
    comparison a node, and no pairs are kept.
    """
    root, left, rest = np.arange(len(bits)), np.arange(len(bits)), bits
    while len(left):
        seed, reached, left, rest = left[0], [bits[left[0]]], left[1:], rest[1:]
        while reached and len(left):
            near = np.bitwise_count(rest ^ reached.pop()) <= radius
            if near.any():
                root[left[near]] = seed
                reached.extend(rest[near])
                left, rest = left[~near], rest[~near]
    return root


def _forest(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges that span the linked nodes of each bucket; rows come sorted by group, a bucket has bounded size."""
    for table in whole_groups(batches):
        g, fp = table["g"].to_numpy(), table["fp"].to_numpy()
        bits = fp.view(np.uint64)
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        sizes = np.diff(np.r_[starts, len(g)])
        root, few = np.arange(len(fp)), np.flatnonzero(np.repeat(sizes < ALONE, sizes))
        own = bits[few]
        root[few] = few[smallest_reached(len(few), *close_pairs(g[few], None, lambda a, b, own=own: np.bitwise_count(own[a] ^ own[b]) <= radius))]
        for at, size in zip(starts[sizes >= ALONE], sizes[sizes >= ALONE], strict=True):
            root[at : at + size] = at + roots_of(bits[at : at + size], radius)
        tied = root != np.arange(len(fp))
        yield pa.record_batch([pa.array(fp[tied]), pa.array(fp[root[tied]])], names=["a", "b"])


@cache
def _flips(mask: int, radius: int) -> np.ndarray:
    """All flips of at most half the radius of the positions that a mask leaves free."""
    free = [i for i in range(BITS) if not (mask >> i) & 1]
    return np.array([sum(1 << i for i in c) for n in range(radius // 2 + 1) for c in combinations(free, n)], np.uint64).view(np.int64)


def _near_values(batches: Iterator[pa.RecordBatch], masks: list[int], radius: int) -> Iterator[pa.RecordBatch]:
    """(tab, fp, value) for every value within half the radius of ``fp`` over the positions that table ``tab`` leaves free.

    The flips are made in the tasks: as some 15,000 literals they made the driver's plans large.
    """
    for b in in_parts(batches):
        tab, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
        for t in np.unique(tab):
            own, flips = fp[tab == t], _flips(masks[t - 1], radius)
            values = (own[:, None] ^ flips).ravel()
            yield pa.record_batch([pa.array(np.full(len(values), t, np.int16)), pa.array(np.repeat(own, len(flips))), pa.array(values)], names=["tab", "fp", "value"])


def near_edges(nodes: DataFrame, radius: int = RADIUS, bucket_most: int = BUCKET_MOST) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``nodes(fp)`` within ``radius`` bits, an even number.

    (Two nodes within an odd number of bits need not share a value within half of it, so odd ones are refused.)
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be an even number of bits")
    masks = covering_masks(radius)
    tables = F.array(*(F.struct(F.lit(t).cast("short").alias("tab"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks, 1)))
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A row becomes one for each table, so few small partitions would become few large ones.
    rows = nodes.repartition(n, "fp").select("fp", F.explode(tables).alias("t")).select("t.tab", "t.key", "fp")
    sizes = rows.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark's guess of a size knows nothing of rows that explode, so it must not choose to broadcast what comes of them.
    shared = materialize(rows.join(sizes.hint("merge"), ["tab", "key"]), "buckets")
    small = shared.where(F.col("n") <= bucket_most).select(F.xxhash64("tab", "key").alias("g"), "fp").repartition(n, "g").sortWithinPartitions("g", "fp")  # so that a bucket hangs on its smallest
    forest = small.mapInArrow(lambda batches: _forest(batches, radius), "a long, b long")
    large = shared.where(F.col("n") > bucket_most)
    named = large.select("tab", "fp").mapInArrow(lambda batches: _near_values(batches, masks, radius), "tab short, fp long, value long")
    hubs = named.groupBy("tab", "value").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return forest.union(named.join(hubs.hint("merge"), ["tab", "value"]).where("fp != b").select(F.col("fp").alias("a"), "b"))


def simhash_dedup(docs: DataFrame, words_in_shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for each row of ``docs(doc_id, text)``: fingerprints link within ``radius`` bits.

    ``component_id`` is the smallest ``doc_id`` that links reach. A null or wordless text has fingerprint zero and links
    like any other. Repeated rows come out once each; a null ``doc_id`` is ignored as a component's smallest, so a
    component of null ids alone has a null one. Other columns are ignored. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, words_in_shingle), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = materialize(connected_components(near_edges(nodes.select("fp"), radius)).withColumnRenamed("node", "fp"), "roots")
    linked = join_least(roots.join(nodes, "fp"), "component", "least", "component_id").select("fp", "component_id")
    classes = nodes.join(linked, "fp", "left").select("fp", F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return prints.join(materialize(classes, "classes"), "fp").select("doc_id", "fp", "component_id")  # a table, so that a hot fingerprint can be split
