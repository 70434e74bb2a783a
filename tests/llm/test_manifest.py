import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from rosterspark.llm import merkle_manifest, queries


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, add=0):
    values = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + add, row["text"]]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grow(nodes):
    """Levels of one tree, and for each leaf its (sibling on the left, sibling on the right) level by level."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[i : i + 2] for i in range(0, len(nodes), 2)]
        kept = [owners[i : i + 2] for i in range(0, len(nodes), 2)]
        for run, own in zip(runs, kept):
            for side, leaves in enumerate(own):
                for i in leaves:
                    paths[i].append((run[0] if side else "", run[1] if not side and len(run) == 2 else ""))
        nodes, owners = ["".join(r) for r in runs], [sum(o, []) for o in kept]
        nodes = list(map(h, nodes))
    return nodes[0], paths


def brute(rows, tamper):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[lang] = grow([leaf(r) for r in groups[lang]])
    root, tops = grow([trees[lang][0] for lang in langs])
    out = []
    for top, lang in zip(tops, langs):
        for r, path in zip(groups[lang], trees[lang][1]):
            hit = tamper and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            digest, proof = leaf(r, int(hit)), ""
            for left, right in path + top:
                digest, proof = h(left + digest + right), proof + left + right
            out.append((r["doc_id"], leaf(r), trees[lang][0], root, h(proof), digest, digest == root))
    return sorted(out, key=repr)


def found(docs, tamper=True, **blocks):
    made = merkle_manifest.merkle_manifest(docs, merkle_manifest.tampered() if tamper else None, **blocks)
    return sorted(map(tuple, made.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle_manifest.proof(F.col("path")), 256), "folded_root", "verified").collect()), key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("bits, most", [(8, 4096), (1, 2), (2, 5)])
def test_manifest_equals_brute_force(spark, small, bits, most):
    """With small blocks the top takes several distributed reductions, and more languages than the driver takes."""
    docs = small("documents").limit(90) if bits == 1 else small("documents")
    rows = [r.asDict() for r in docs.collect()]
    docs = spark.createDataFrame([[r[c] for c in merkle_manifest.FIELDS] for r in rows], SCHEMA)
    assert found(docs, bits=bits, most=most) == brute(rows, True)


@pytest.mark.parametrize("most", [4096, 3])
def test_manifest_odd_rows(spark, most):
    texts = ["a", "", None, "é漢", "x" * 200_000]
    rows = [dict(zip(merkle_manifest.FIELDS, r)) for r in [(i, None if i % 3 else "s", lang, None if i == 4 else i, texts[i % 5]) for i in range(30) for lang in (None, "", "é", "en")]]
    rows += [dict(zip(merkle_manifest.FIELDS, r)) for r in [(None, None, None, None, None)] * 3 + [(7, "s", "en", 7, "a")] * 4 + [(-5, "s", "zz", -5, "neg"), (2**63 - 1, "s", "zz", 2**63 - 1, "top")]]
    docs = spark.createDataFrame([[r[c] for c in merkle_manifest.FIELDS] for r in rows], SCHEMA).withColumns({c: F.lit("extra") for c in ("at", "tree", "digest", "then", "tie", "start", "size", "block", "path", "root", "range", "place", "members", "a.b")})
    assert found(docs, bits=2 if most == 3 else 8, most=most) == brute(rows, True)
    assert all(r[-1] for r in found(docs, False))


def test_manifest_small_tables(spark):
    assert merkle_manifest.merkle_manifest(spark.createDataFrame([], SCHEMA)).isEmpty()
    one = merkle_manifest.merkle_manifest(spark.createDataFrame([(1, "s", "en", 3, "abc")], SCHEMA)).first()
    assert one.leaf == one.subroot == one.root and one.path == [] and one.verified


def test_manifest_query_finds_the_tampered(spark):
    rows = queries.op11_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in rows)


def test_manifest_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    wanted = con.execute(queries.ORACLE_SQL["op11_merkle_manifest"])
    names = [d[0] for d in wanted.description]
    rows = queries.op11_merkle_manifest(spark, "/root/testdata/sf0.001").select(*names).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(wanted.fetchall(), key=repr)
