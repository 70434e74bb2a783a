"""Merkle manifest of a dataset: a leaf for each row, a subtree for each language, one root, and a proof for each row.

Leaves of a language ascend by id; every two consecutive nodes of a level become one, a last one alone becomes one too.
So the nodes over ``2 ** BLOCK_BITS`` aligned leaves depend on those leaves alone: blocks are reduced on the cluster,
each a row of bounded size, and block roots again in blocks until few enough are left for the driver (``TOP_MOST``, which
is checked by a count). The driver builds this top, and its suffix paths are broadcast to the tasks, which finish the
proof of each row and fold it. Subroots of the languages are the leaves of one more tree of the same kind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_parts, materialize

#: Levels of a block, so a block has at most 256 nodes; and nodes that the driver takes at most.
BLOCK_BITS, TOP_MOST = 8, 1 << 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATHS = "tree long, at long, path array<string>, top string"


def node_hash(inputs: str) -> str:
    return hashlib.sha256(inputs.encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(changed: dict[str, Column] | None = None) -> Column:
    """A row's leaf; ``changed`` gives columns other values."""
    return F.sha2(F.concat(*(_field((changed or {}).get(c, F.col(c))) for c in FIELDS)), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, the 0-based place of each by ``order`` (nulls first).

    Rows are dealt by range and sorted in each range; a range starts where those before it end, so no task sorts all.
    The table of starts has a row for each range. ``order`` should tell all rows apart, so that no range is hot.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    ranges = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(ranges.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")), "ranges")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    return placed.join(F.broadcast(starts), "_range").select(*rows.columns, (F.col("_start") + F.col("_place")).alias("at"))


def levels(digests: list[str], most: int | None) -> list[list[str]]:
    """The levels of a tree over ``digests``: ``most`` of them above, or without it until one node remains."""
    built = [digests]
    while len(built) <= most if most is not None else len(built[-1]) > 1:
        below = built[-1]
        built.append([node_hash("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return built


def siblings(built: list[list[str]], at: int) -> list[str]:
    """The sibling of node ``at`` and of each node above it but the last; empty where there is none."""
    path = []
    for level in built[:-1]:
        path.append(level[at ^ 1] if at ^ 1 < len(level) else "")
        at >>= 1
    return path


def fold(digest: str, at: int, path: list[str]) -> str:
    """The root that ``digest`` at place ``at`` gives with the siblings of ``path``."""
    for s in path:
        digest = node_hash(s + digest if at & 1 else digest + s)
        at >>= 1
    return digest


def _block_levels(row: dict, bits: int) -> list[list[str]]:
    """The levels of a block: one that is a whole tree ends with its one node, others fill all ``bits`` levels."""
    return levels([m["digest"] for m in row["members"]], None if row["size"] <= 1 << bits else bits)


def _in_blocks(nodes: DataFrame, bits: int, *carried: str) -> DataFrame:
    """``nodes(tree, at, size, digest)`` as a row for each block, its members in order; partial lists meet before the shuffle."""
    members = F.sort_array(F.collect_list(F.struct("at", "digest", *carried)))
    block = F.shiftright("at", bits).alias("block")
    return materialize(nodes.groupBy("tree", block, "size").agg(members.alias("members")).select("tree", "block", "size", "members"), "blocks")


def _block_roots(blocks: DataFrame, bits: int) -> DataFrame:
    """The nodes above ``blocks``, again as (tree, at, size, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches, 64):
            rows = b.to_pylist()
            made = [_block_levels(r, bits)[-1][0] for r in rows]
            sizes = [-(-r["size"] >> bits) for r in rows]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(made)], names=["tree", "at", "size", "digest"])

    sized = blocks.select("tree", "block", "size", F.transform("members", lambda m: F.struct(m["digest"].alias("digest"))).alias("members"))
    return sized.mapInArrow(run, "tree long, at long, size long, digest string")


def _top_paths(nodes: DataFrame) -> DataFrame:
    """Suffix paths of at most ``TOP_MOST`` nodes, built on the driver, to be broadcast."""
    trees: dict[int, list[str]] = {}
    for r in nodes.orderBy("tree", "at").collect():
        trees.setdefault(r["tree"], []).append(r["digest"])
    rows = []
    for tree, digests in trees.items():
        built = levels(digests, None)
        rows += [(tree, at, siblings(built, at), built[-1][0]) for at in range(len(digests))]
    return F.broadcast(nodes.sparkSession.createDataFrame(rows, PATHS))


def suffix_paths(nodes: DataFrame, bits: int, most: int) -> DataFrame:
    """(tree, at, path, top) for each of ``nodes(tree, at, size, digest)``: the siblings up to its tree's top, and the top."""
    nodes = materialize(nodes, "nodes")
    if nodes.count() <= most:
        return _top_paths(nodes)
    if nodes.where("size > 1").isEmpty():  # very many trees, each of one node
        return nodes.select("tree", "at", F.array().cast("array<string>").alias("path"), F.col("digest").alias("top"))
    blocks = _in_blocks(nodes, bits)
    upper = suffix_paths(_block_roots(blocks, bits), bits, most).withColumnRenamed("at", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches, 64):
            rows = []
            for r in b.to_pylist():
                built = _block_levels(r, bits)
                rows += [{"tree": r["tree"], "at": m["at"], "path": siblings(built, i) + r["path"], "top": r["top"]} for i, m in enumerate(r["members"])]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("tree", pa.int64()), ("at", pa.int64()), ("path", pa.list_(pa.string())), ("top", pa.string())]))

    return blocks.join(upper, ["tree", "block"]).mapInArrow(run, PATHS)


def merkle_manifest(docs: DataFrame, found: dict[str, Column] | None = None, bits: int = BLOCK_BITS, most: int = TOP_MOST) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, path, folded_root and verified for each row of ``docs`` (columns ``FIELDS``).

    ``path`` has the siblings from the leaf to the root, empty strings where a node has none. ``found`` gives columns as
    they are when a row is verified (by default as they were); ``folded_root`` is what the row's leaf of then gives with
    the siblings of before, and ``verified`` whether that is the root.

    Any column may be null: it then counts as ``-``. Null languages are a subtree of their own, before the others; null
    ids stand before others. Rows that share an id are ordered by their leaves, and equal rows are leaves each. Other
    columns are ignored. A table of one row has that row's leaf as its root. An empty table gives an empty result.
    """
    made = docs.select("doc_id", "lang", leaf().alias("digest"), (leaf(found) if found else F.lit(None).cast("string")).alias("then"))
    made = materialize(made.select("*", F.monotonically_increasing_id().alias("tie")), "leaves")
    rows = numbered(made, ["lang", "doc_id", "digest", "tie"])
    trees = rows.groupBy("lang").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("size"))
    trees = materialize(numbered(trees, ["lang"]).withColumnRenamed("at", "tree"), "trees")
    named = trees.select(F.col("lang").alias("of"), "start", "size", "tree")
    nodes = rows.join(named, F.col("lang").eqNullSafe(F.col("of"))).select("tree", (F.col("at") - F.col("start")).alias("at"), "size", "digest", "doc_id", "then")
    blocks = _in_blocks(nodes, bits, "doc_id", "then")
    upper = suffix_paths(_block_roots(blocks, bits), bits, most)
    subroots = upper.where("at = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("top").alias("digest"))
    tops = suffix_paths(subroots.select("tree", "at", F.lit(trees.count()).cast("long").alias("size"), "digest"), bits, most)
    last = tops.select(F.col("at").alias("tree"), F.col("path").alias("last"), F.col("top").alias("root"))
    joined = blocks.join(upper.withColumnRenamed("at", "block"), ["tree", "block"]).join(last, "tree").join(trees.select("tree", "lang"), "tree")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, lang string, leaf string, subroot string, root string, path array<string>, folded_root string, verified boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches, 8):
            ids = b.column(b.schema.get_field_index("members")).flatten().field("doc_id")
            cols: dict[str, list] = {c: [] for c in ("lang", "leaf", "subroot", "root", "path", "folded_root")}
            for r in b.to_pylist():
                built = _block_levels(r, bits)
                for i, m in enumerate(r["members"]):
                    path = siblings(built, i) + r["path"]
                    subroot = fold(m["then"] or m["digest"], m["at"], path)
                    for c, v in (("lang", r["lang"]), ("leaf", m["digest"]), ("subroot", r["top"]), ("root", r["root"]), ("path", path + r["last"]), ("folded_root", fold(subroot, r["tree"], r["last"]))):
                        cols[c].append(v)
            verified = [f == r for f, r in zip(cols["folded_root"], cols["root"], strict=True)]
            made = [pa.array(v, pa.list_(pa.string()) if c == "path" else pa.string()) for c, v in cols.items()]
            yield pa.record_batch([ids, *made, pa.array(verified, pa.bool_())], names=["doc_id", *cols, "verified"])

    return joined.mapInArrow(run, out)


def tampered(folds: int = 7) -> dict[str, Column]:
    """``n_chars`` plus one where ``folds`` divides the checksum of the decimal id; a null stays, and so do rows without an id."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0
    n = F.col("n_chars").cast("decimal(38,0)")
    return {"n_chars": F.when(hit, n + 1).otherwise(n)}


def proof(path: Column) -> Column:
    """The siblings that there are, concatenated."""
    return F.array_join(path, "")
