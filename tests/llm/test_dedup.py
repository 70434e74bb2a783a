import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rosterspark.llm import embedding_dedup, exact_dedup, graph, near_dedup, simhash_dedup


def roots(count, links):
    """Smallest index that each index reaches."""
    parent = list(range(count))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(count)]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(1, 2), (2, 1), (4, 3), (3, 9), (7, 7)]])
def test_components(spark, edges):
    found = graph.connected_components(spark.createDataFrame(edges, "a long, b long"))
    nodes = sorted({n for e in edges if e[0] != e[1] for n in e})
    place = {n: i for i, n in enumerate(nodes)}
    expected = roots(len(nodes), [(place[a], place[b]) for a, b in edges if a != b])
    assert sorted(map(tuple, found.collect())) == [(n, nodes[r]) for n, r in zip(nodes, expected)]


def brute_exact(rows):
    groups, found = defaultdict(list), []
    for i, t in rows:
        groups[t or ""].append(i)
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        found.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(found, key=repr)


@pytest.mark.parametrize("sizes", [(1024, 8192), (4, 16)])
def test_exact_dedup(spark, odd_docs, no_docs, small, sizes):
    for docs in (odd_docs, no_docs, small("documents")):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        found = [tuple(r) for r in exact_dedup.exact_dedup(docs, *sizes).collect()]
        assert sorted(found, key=repr) == brute_exact(rows)


def test_exact_dedup_keeps_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "REPEATS", 3)
    rows = [(1, "same")] * 8 + [(1, "other"), (2, "q"), (3, "same"), (3, "same"), (None, "q"), (None, "q")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    assert sorted((tuple(r) for r in exact_dedup.exact_dedup(docs).collect()), key=repr) == brute_exact(rows)
    assert sorted(map(tuple, exact_dedup.keep_one(docs).collect())) == [(1, "other"), (2, "q"), (3, "same")]


def test_an_inserted_character_moves_few_cuts():
    rng = np.random.default_rng(0)
    for letters, gap in (("abcdefghijklmnopqrstuvwxyz", " "), ("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "")):
        text = gap.join("".join(rng.choice(list(letters), 5)) for _ in range(20_000))
        pattern = exact_dedup.chunk_pattern()
        before, after = ([m.group(0) for m in re.finditer(pattern, t)] for t in (text, "x" + text))
        assert len(before) > 10 and len(set(before) & set(after)) > 0.8 * len(before)


def test_exact_dedup_keeps_one_row(odd_docs, no_docs, unchanged):
    kept = exact_dedup.keep_one(odd_docs)
    assert unchanged(kept)
    rows = [(r.doc_id, r.text or "") for r in kept.collect()]
    assert sorted(r[0] for r in rows if r[1].startswith("A first")) == [2] and len({t for _, t in rows}) == len(rows)
    assert exact_dedup.keep_one(no_docs).isEmpty()


def test_chunks_rejoin():
    for t in ("", "a" * 5000, "Some. Text\nmore! " * 500, "é漢😀. " * 999):
        pattern = exact_dedup.chunk_pattern(64, 512)
        assert "".join(m.group(0) for m in re.finditer(pattern, t)) == t


def test_chunk_clash_is_told_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id int, text string")
    occurrences = exact_dedup.chunk_occurrences(docs).withColumn("hash", F.lit(7).cast("long"))  # as if all hashes were equal
    monkeypatch.setattr(exact_dedup, "chunk_occurrences", lambda *a: occurrences)
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(docs).collect()) == [(1, 3), (2, 2), (3, 3)]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash(odd_docs, small):
    for docs in (odd_docs, small("documents")):
        rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
        links = [(i, j) for j in range(len(rows)) for i in range(j) if (rows[i][1] ^ rows[j][1]).bit_count() <= 4]
        groups = defaultdict(list)
        for i, r in enumerate(roots(len(rows), links)):
            groups[r].append(rows[i][0])
        least = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
        expected = [(*rows[i], least[r]) for i, r in enumerate(roots(len(rows), links))]
        found = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash_dedup.simhash_dedup(docs).collect()]
        assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_simhash_empty(no_docs, odd_docs, unchanged):
    assert simhash_dedup.simhash_dedup(no_docs).isEmpty() and near_dedup.keep_one(no_docs).isEmpty()
    kept = near_dedup.keep_one(odd_docs)
    assert unchanged(kept) and {1, 6, 7} <= {r.doc_id for r in kept.collect()}


def test_odd_radius_is_refused(odd_docs):
    with pytest.raises(ValueError, match="even"):
        simhash_dedup.simhash_dedup(odd_docs, radius=3)


def test_every_pair_within_the_radius_shares_a_table():
    rng, masks = np.random.default_rng(0), simhash_dedup.covering_masks(4)
    assert len(masks) == 31
    for _ in range(3000):
        a = int(rng.integers(0, 1 << 63))
        b = a ^ sum(1 << int(i) for i in rng.choice(64, 4, replace=False))
        assert any(a & m & (1 << 64) - 1 == b & m & (1 << 64) - 1 for m in masks)


@pytest.mark.parametrize("most", [1, 1024])
def test_near_edges_of_large_and_small_buckets(spark, most):
    rng = np.random.default_rng(1)
    fps = {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 30)}
    for centre in list(fps)[:6]:
        for n in (1, 2, 4, 5, 7):
            fps.add(centre ^ sum(1 << int(i) for i in rng.choice(62, n, replace=False)))
    fps = sorted(fps)
    links = [(i, j) for j in range(len(fps)) for i in range(j) if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 4]
    expected = {(fps[i], fps[r]) for i, r in enumerate(roots(len(fps), links)) if any(i in e for e in links)}
    edges = simhash_dedup.near_edges(spark.createDataFrame([(f,) for f in fps], "fp long"), bucket_most=most)
    assert set(map(tuple, graph.connected_components(edges).collect())) == expected


def brute_embeddings(rows):
    def fine(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if fine(v) else None for _, v, _ in rows]
    links = [(i, j) for j in range(len(rows)) for i in range(j) if unit[i] is not None and unit[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]
    ids = [r[0] for r in rows]
    order = sorted(range(len(rows)), key=lambda i: ids[i])
    place = {i: k for k, i in enumerate(order)}
    found = roots(len(rows), [(place[a], place[b]) for a, b in links])
    return sorted((ids[i], sum(i in e for e in links), ids[order[found[place[i]]]], ids[i] == ids[order[found[place[i]]]]) for i in range(len(rows)))


@pytest.mark.parametrize("block", [3, 512])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist(), i % 3) for i in range(40)]
    for i in range(40, 100):
        near = np.array(rows[i % 5][1]) + rng.normal(size=16) * 0.12
        rows.append((i, near.tolist(), rows[i % 5][2]))
    rows += [(100, rows[3][1], 0), (101, rows[3][1], 0), (102, None, 0), (103, [0.0] * 16, 0), (104, [float("nan")] + [1.0] * 15, 0), (105, [None] + [1.0] * 15, 0), (106, rows[3][1], None), (107, [], 0), (108, [float("inf")] * 16, 0), (109, [1e300] * 16, 1), (110, [2e300] * 16, 1)]
    rows += [(111, [1.0, 0.0], 0), (112, [1.0, 0.1], 0), (113, [1.0, 0.1], 1), (114, [-0.0, 1.0, 2.0], 0), (115, [0.0, 1.0, 2.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("extra") for c in ("node", "weight", "links", "pieces", "tab", "root", "least", "d1", "d2", "code", "smallest")})
    with np.errstate(over="ignore", invalid="ignore"):
        expected = brute_embeddings([(i, [x / 1e300 if x and x >= 1e300 else x for x in v] if v and i in (109, 110) else v, c) for i, v, c in rows])
    assert sorted(map(tuple, embedding_dedup.embedding_dedup(vectors, recall=0.99999).collect())) == expected
    assert embedding_dedup.embedding_dedup(vectors.limit(0)).isEmpty()


def test_embedding_recall(spark):
    """Links of pairs at and above the threshold, against brute force, with production parameters."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(600, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.normal(size=(600, 64))
    away -= (away * base).sum(1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cosine = np.linspace(0.931, 0.999, 600)[:, None]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.r_[base, base * cosine + away * np.sqrt(1 - cosine**2)])]
    found = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert found.agg(F.sum("n_links")).first()[0] / 1200 >= 0.97


def five_words(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def test_near_copies_go_and_others_stay(spark):
    """Edited copies above 0.8 go, those below stay, also in chains; wordless and short texts stay."""
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 1 << 40, n)]
    texts = []
    for i in range(90):
        base = word(400)
        copy = base.copy()
        for at in rng.choice(400, (2, 4, 6, 8, 14, 20)[i % 6], replace=False):
            copy[at] = word(1)[0]
        texts += [" ".join(base), " ".join(copy)]
    chain = word(400)
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = chain[40:] + word(40)
    texts += [" ".join([*word(3), *["same"] * 300, *word(60)]) for _ in range(10)] + ["", " ", "\n", None, "one", "two", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stay = {r.doc_id for r in near_dedup.keep_one(docs).collect()}
    full = [five_words(t) for t in texts]
    near = [(a, b) for b in range(len(full)) for a in range(b) if jaccard(full[a], full[b]) >= 0.8]
    linked = {i for e in near for i in e}
    assert set(range(len(full))) - linked <= stay
    assert all(any(i in e and (set(e) - {i}) <= stay for e in near) for i in linked - stay)  # what goes is near one that stays
    assert sum(a in stay and b in stay for a, b in near) <= 0.02 * len(near) and len(near) > 45


def test_near_group_beyond_the_star_rounds(spark, monkeypatch):
    texts = [" ".join(f"w{j}" for j in range(i * 5, i * 5 + 100)) for i in range(24)]
    docs, sets = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [five_words(t) for t in texts]
    monkeypatch.setattr(near_dedup, "STAR_FROM", 1)
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 1)
    stay = {r.doc_id for r in near_dedup.keep_one(docs).collect()}
    assert all(i in stay or any(k in stay and jaccard(sets[i], sets[k]) >= 0.8 for k in range(24)) for i in range(24))
    assert len(stay) < 16


def test_exploded_buckets_are_not_broadcast(spark, monkeypatch):
    """A row for each table and node has to stay with the executors, however small the nodes look before they explode."""
    plans, write = {}, simhash_dedup.materialize

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(simhash_dedup, "materialize", seen)
    edges = simhash_dedup.near_edges(spark.range(200).select(F.col("id").alias("fp")), bucket_most=1)
    assert "SortMergeJoin" in plans["buckets"]
    assert not any("Broadcast" in plan for plan in (plans["buckets"], edges._jdf.queryExecution().executedPlan().toString()))


def test_near_pairs_do_not_grow_with_the_square(spark, monkeypatch):
    """A large group just below the similarity, and one above it that no star settles: pairs to confirm stay few, and results are right."""
    rng = np.random.default_rng(5)
    confirm, seen = near_dedup._confirmed, []

    def counted(pairs, sets):
        seen.append(pairs.count())
        return confirm(pairs, sets)

    monkeypatch.setattr(near_dedup, "_confirmed", counted)
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 0)
    texts = []
    for n, edits in ((150, 7), (150, 3)):
        base = [f"w{i}" for i in rng.integers(0, 1 << 40, 400)]
        for _ in range(n):
            copy = base.copy()
            for at in rng.choice(400, edits, replace=False):
                copy[at] = f"x{rng.integers(0, 1 << 40)}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stay = {r.doc_id for r in near_dedup.keep_one(docs).collect()}
    full = [five_words(t) for t in texts]
    near = [(a, b) for b in range(len(full)) for a in range(b) if jaccard(full[a], full[b]) >= 0.8]
    assert all(any(i in e and (set(e) - {i}) <= stay for e in near) for i in set(range(len(full))) - stay)
    assert sum(a in stay and b in stay for a, b in near) <= 0.02 * len(near) and 1 < len(stay) < 300
    assert sum(seen) <= near_dedup.PAIRS_MOST * near_dedup.BANDS * len(texts) / 8


def test_near_candidates_come_from_simhash(spark):
    """Texts whose fingerprints SimHash links share a bucket after the bands, whatever their minima."""
    prints = spark.createDataFrame([(0, 0), (1, 15), (2, 255), (3, -1), (4, -1), (5, 1 << 40 | 0xFFF00000)], "node long, fp long")
    keys = {r.node: r.key for r in near_dedup.simhash_buckets(prints).where(F.col("band") == near_dedup.BANDS).collect()}
    assert keys[0] == keys[1] == keys[2] and keys[3] == keys[4] and len(set(keys.values())) == 3


def test_near_edges_plan_is_small(spark, monkeypatch):
    """The values near a fingerprint are made in the tasks: as literals they filled the driver's memory."""
    literal, seen = F.lit, []

    def counted(value):
        seen.append(value)
        return literal(value)

    monkeypatch.setattr(F, "lit", counted)
    simhash_dedup.near_edges(spark.range(10).select(F.col("id").alias("fp")))
    assert len(seen) < 200


def test_star_rounds_end_where_they_drop_nothing(spark, monkeypatch):
    """Texts that share buckets and are no near copies are left to the tasks at once: each round costs the driver's memory."""
    rng = np.random.default_rng(6)
    base, texts, rounds, write = [f"w{i}" for i in rng.integers(0, 1 << 40, 400)], [], [], near_dedup.materialize
    for _ in range(60):
        copy = base.copy()
        for at in rng.choice(400, 9, replace=False):
            copy[at] = f"x{rng.integers(0, 1 << 40)}"
        texts.append(" ".join(copy))

    def counted(df, name):
        rounds.append(name == "near-stay")
        return write(df, name)

    monkeypatch.setattr(near_dedup, "materialize", counted)
    monkeypatch.setattr(near_dedup, "STAR_FROM", 8)
    stay = {r.doc_id for r in near_dedup.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    full = [five_words(t) for t in texts]
    near = [(a, b) for b in range(60) for a in range(b) if jaccard(full[a], full[b]) >= 0.8]
    assert all(any(i in e and (set(e) - {i}) <= stay for e in near) for i in set(range(60)) - stay)
    assert not any(a in stay and b in stay for a, b in near) and len(stay) > 50
    assert 1 <= sum(rounds) <= 3


def test_component_plans_are_small(spark, monkeypatch):
    """Each half of a round is a plan of its own: a whole round in one joined 16 times, which filled the driver's memory."""
    write, joins = graph.materialize, []

    def counted(df, name):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(df, name)

    monkeypatch.setattr(graph, "materialize", counted)
    found = graph.connected_components(spark.range(30).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(31)}
    assert len(joins) > 2 and max(joins) <= 2
