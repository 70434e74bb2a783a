"""Embedding near-deduplication by iterative quantisation and multi-index Hamming tables.

A rotation is learnt on a bounded sample so that the signs of the rotated, centred unit vectors are balanced codes that
keep angles. The code's bits are cut into pieces; each piece is a table. Pairs made
at the threshold from sampled vectors are coded with each rotation, and tables (of as many rotations as needed) are added
until they find such a pair with probability ``recall``, closer pairs more surely; centred angles can be much wider than
those of the vectors, so no formula is relied on. The bits of a piece grow with the
logarithm of the number of vectors, so a bucket's expected size does not grow with the table.

Only node numbers and codes of some 128 bits go to the buckets. There the Hamming distance tells which nodes have a
partner that may be near (every made pair is within the distance allowed); only those fetch their vectors, once for each
bucket, and are compared by the cosine of the original vectors.

Equal vectors of one label are one node with a weight. A pair that meets in several tables is counted in the first one.
A bucket is cut into blocks, each pair of blocks a group of its own, so no bucket needs one task. A group emits nodes,
then counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import BLOCK, close_pairs, grouped, smallest_reached, whole_groups
from .graph import connected_components
from .shared import bounded_sample, join_least, materialize

THRESHOLD, RECALL = 0.93, 0.98
#: Vectors on which rotations are learnt; rounds of learning; expected nodes in a bucket; least bits of a code (all, if there are fewer).
SAMPLE, ROUNDS, BUCKET, CODE_BITS = 10_000, 30, 64, 128
#: Sampled vectors from which pairs at the threshold are made; and tables that are tried at most before pieces get shorter.
PROBES, MOST_TABLES = 2000, 512


def learn_rotation(sample: np.ndarray, seed: int, centre: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Mean (none without ``centre``) and rotation of iterative quantisation: signs and rotation are fitted to each other in turn."""
    mean = sample.mean(axis=0) if centre else np.zeros(sample.shape[1])
    centred, d = sample - mean, sample.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    for _ in range(ROUNDS):
        signs = np.where(centred @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(centred.T @ signs)
        rotation = left @ right
    return mean, rotation


def table_shape(rows: int, dims: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a piece, and how many tables there are."""
    bits = max(min(8, dims), min(dims, 30, round(math.log2(max(rows, 1) / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def partners(unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each unit vector two at cosine ``threshold``: in a random direction, and towards another vector."""
    rng, out = np.random.default_rng(0), []
    for away in (rng.standard_normal(unit.shape), unit[rng.permutation(len(unit))] - unit + 1e-9 * rng.standard_normal(unit.shape)):
        away -= (away * unit).sum(axis=1, keepdims=True) * unit
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
        out.append(threshold * unit + math.sqrt(1 - threshold**2) * away)
    return out[0], out[1]


def plan(unit: np.ndarray, rows: int, threshold: float, recall: float) -> tuple[int, list[tuple[np.ndarray, np.ndarray]], int]:
    """Bits of a piece, rotations, and tables: as many as find pairs made at the threshold with probability ``recall``.

    Centring widens angles where vectors share a component, so the tables are counted by trying them on pairs of both
    kinds of ``partners``, never fewer than ``table_shape`` says. Where ``MOST_TABLES`` are too few, as with a handful of
    vectors that lie on all sides of their mean, codes are of vectors that are not centred, which agree in a bit by their
    own angle, and pieces get a bit less until the tables do.
    """
    most, least = table_shape(rows, unit.shape[1], threshold, recall)
    probes = _probes(unit)
    near = partners(probes, threshold)
    for bits, centre in ((most, True), *((b, False) for b in range(most, 0, -1))):
        found, rotations, tables = np.zeros((2, len(probes)), bool), [], 0
        per = unit.shape[1] // bits
        while tables < MOST_TABLES:
            rotations.append(learn_rotation(unit, len(rotations), centre))
            own, *others = (pieces(v, rotations[-1:], bits, per) for v in (probes, *near))
            for t in range(per):
                found |= np.stack([own[:, t] == o[:, t] for o in others])
                tables += 1
                if tables >= least and found.mean(axis=1).min() >= recall:
                    return bits, rotations, tables
    return bits, rotations, tables


def _probes(unit: np.ndarray) -> np.ndarray:
    """``PROBES`` of the sampled vectors, each several times if there are fewer."""
    return unit[np.arange(PROBES) % len(unit)]


def pieces(vectors: np.ndarray, rotations: list[tuple[np.ndarray, np.ndarray]], bits: int, tables: int) -> np.ndarray:
    """The pieces of each unit vector's codes, an integer for each table."""
    weights, out = 1 << np.arange(bits, dtype=np.int64), []
    for mean, rotation in rotations:
        code = ((vectors - mean) @ rotation >= 0).astype(np.int64)
        out += [code[:, at : at + bits] @ weights for at in range(0, code.shape[1] - bits + 1, bits)]
    return np.stack(out[:tables], axis=1)


class Code:
    """The first pieces of a vector, in 64-bit words: for Hamming distances, and for which tables a pair meets in."""

    def __init__(self, bits: int, tables: int):
        self.bits, self.pieces = bits, min(tables, -(-CODE_BITS // bits))
        self.per_word = 64 // bits

    def pack(self, found: np.ndarray) -> np.ndarray:
        words = np.zeros((len(found), max(1, -(-self.pieces // self.per_word))), np.uint64)
        for k in range(self.pieces):
            words[:, k // self.per_word] |= found[:, k].astype(np.uint64) << np.uint64(k % self.per_word * self.bits)
        return words

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a ^ b).sum(axis=1)

    def met_before(self, a: np.ndarray, b: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Whether pairs agree in a piece before that of ``table``, as far as the code tells."""
        other, out = a ^ b, np.zeros(len(a), bool)
        for k in range(self.pieces):
            piece = other[:, k // self.per_word] >> np.uint64(k % self.per_word * self.bits) & np.uint64((1 << self.bits) - 1)
            out |= (piece == 0) & (k < table)
        return out


def widest(unit: np.ndarray, rotations: list[tuple[np.ndarray, np.ndarray]], bits: int, tables: int, threshold: float) -> int:
    """The largest Hamming distance between the codes of pairs made at the threshold."""
    code, probes = Code(bits, tables), _probes(unit)
    own, *near = (code.pack(pieces(v, rotations, bits, tables)) for v in (probes, *partners(probes, threshold)))
    return int(max(code.distance(own, n).max() for n in near))


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    rows = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that squares of very large or small numbers are in range
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """The rows that can link: a label, and a vector of finite components that are not all zero."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))


def _may_link(batches: Iterator[pa.RecordBatch], code: Code, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of nodes with a partner in their group within the Hamming distance ``most``, in the first table where the two meet."""
    for table in whole_groups(batches):
        words = np.stack([np.frombuffer(x.as_py(), np.uint64) for x in table["code"]])
        tab = table["tab"].to_numpy()

        def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            near = code.distance(words[a], words[b]) <= most
            near[near] = ~code.met_before(words[a[near]], words[b[near]], tab[a[near]])
            return near

        found = np.unique(np.concatenate(close_pairs(table["g"].to_numpy(), table["side"].to_numpy(), close)))
        yield from table.take(found).select(["label", "tab", "piece", "i", "j", "side", "node"]).to_batches()


def _compare(rows: pa.Table, dims: int, threshold: float) -> pa.Table:
    """Of one pair of blocks of one bucket: for each node its link count here and the smallest node it ties to."""
    table = rows["tab"][0].as_py()
    node, weight, side = (rows[c].to_numpy() for c in ("node", "weight", "side"))
    unit = _unit(rows["embedding"].combine_chunks(), dims)
    codes = np.asarray(rows["pieces"].combine_chunks().flatten()).reshape(len(node), -1)[:, :table]
    a, b = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))  # side 2: both blocks are the same one
    near = unit[a] @ unit[b].T >= threshold
    i, j = np.nonzero(near)
    i, j = a[i], b[j]
    fresh = (node[i] != node[j]) & ~(codes[i] == codes[j]).any(axis=1)  # else an earlier table has counted it
    i, j = i[fresh], j[fresh]
    links = np.bincount(i, weight[j], len(node))
    if not (side == 2).any():
        links += np.bincount(j, weight[i], len(node))
    root = smallest_reached(len(node), i, j)
    kept = links > 0
    return pa.table({"node": node[kept], "links": links[kept].astype(np.int64), "other": node[root[kept]]})


def links_of(nodes: DataFrame, dims: int, count: int, threshold: float, recall: float, sample: int) -> DataFrame:
    """(node, links, other) of ``nodes(node, label, embedding, least, weight)``, all of ``dims`` components: links counted here or there, and a node tied to."""
    drawn = bounded_sample(nodes.select("least", "embedding"), "least", sample).select("embedding").toArrow()
    unit = _unit(drawn["embedding"].combine_chunks(), dims)
    bits, rotations, tables = plan(unit, count, threshold, recall)
    code, most = Code(bits, tables), widest(unit, rotations, bits, tables, threshold)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = pieces(_unit(b.column(1), dims), rotations, bits, tables)
                words = [w.tobytes() for w in code.pack(found)]
                yield pa.record_batch([*b.columns, pa.array(found.tolist(), pa.list_(pa.int64())), pa.array(words, pa.binary())], names=[*b.schema.names, "pieces", "code"])

    label = nodes.schema["label"].dataType.simpleString()
    coded = nodes.select("node", "embedding", "label", "weight").mapInArrow(encode, f"node long, embedding array<double>, label {label}, weight long, pieces array<long>, code binary")
    coded = materialize(coded, "codes")
    keys = coded.select("node", "label", F.posexplode("pieces").alias("tab", "piece"), "code")
    near = grouped(keys, ["label", "tab", "piece"], "node", BLOCK).mapInArrow(lambda batches: _may_link(batches, code, most), f"label {label}, tab int, piece long, i int, j int, side long, node long")
    work = materialize(near, "near").join(coded.select("node", "weight", "embedding", "pieces"), "node")
    return work.groupBy("label", "tab", "piece", "i", "j").applyInArrow(lambda t: _compare(t, dims, threshold), "node long, links long, other long")


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors(vec_id, embedding, label)``.

    Links join vectors of one label and one length whose cosine in double precision is at least ``threshold``. A null
    label, or a vector that is null, empty, zero, or holds null or non-finite components links with nothing. Rows of
    equal vectors (by 128 bits of hashes) and labels link with each other. Each length that occurs has codes and tables of its own.
    ``component_id`` is the smallest ``vec_id`` that links reach, itself included; rows that repeat a ``vec_id`` are
    kept alike. Other columns are ignored. An empty table gives an empty result.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    same = ["label", "d1", "d2"]
    fine = usable(rows).select("*", F.xxhash64("embedding").alias("d1"), F.xxhash64(F.lit(1), "embedding").alias("d2"))
    nodes = fine.groupBy(*same).agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    lengths = nodes.groupBy(F.size("embedding").alias("dims")).count().where("count > 1").collect()
    found = [links_of(nodes.where(F.size("embedding") == dims), dims, count, threshold, recall, sample) for dims, count in sorted(lengths)]
    none = nodes.limit(0).select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("other"))
    found = materialize(reduce(DataFrame.union, found, none), "links")
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = join_least(counts.join(roots, "node", "left").withColumn("root", F.coalesce("component", "node")).join(nodes.select("node", "least"), "node"), "root", "least", "smallest")
    classes = nodes.select(*same, "node", "least", "weight").join(linked.select("node", "links", "smallest"), "node", "left")
    classes = materialize(classes.select(*same, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("smallest", "least").alias("smallest")), "classes")
    keyed = rows.select("vec_id", "label", F.xxhash64("embedding").alias("d1"), F.xxhash64(F.lit(1), "embedding").alias("d2"))
    out = keyed.join(classes, same, "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("smallest", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
