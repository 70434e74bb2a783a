"""Recall of embedding tables where vectors share a strong component, outside Spark."""

import numpy as np
import pytest

from rosterspark.llm import embedding_dedup


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("mean_cosine", "rows"), [(0.0, 1_000_000), (0.5, 2000), (0.5, 1_000_000), (0.69, 1_000_000)])
def test_recall_with_a_common_component(mean_cosine, rows):
    rng = np.random.default_rng(5)
    common = unit(rng.normal(size=(1, 64)))
    draw = lambda n: unit(np.sqrt(mean_cosine) * common + np.sqrt(1 - mean_cosine) * unit(rng.normal(size=(n, 64))))
    bits, rotations, tables = embedding_dedup.plan(draw(4000), rows, 0.93, 0.98)
    base = draw(2000)
    away = rng.normal(size=base.shape)
    away = unit(away - (away * base).sum(1, keepdims=True) * base)
    cosine = rng.uniform(0.93, 0.95, (len(base), 1))
    a, b = (embedding_dedup.pieces(v, rotations, bits, tables) for v in (base, cosine * base + np.sqrt(1 - cosine**2) * away))
    recall = (a == b).any(axis=1).mean()
    old_bits, old_tables = embedding_dedup.table_shape(rows, 64)
    old = [embedding_dedup.learn_rotation(draw(4000), i) for i in range(-(-old_tables // (64 // old_bits)))]
    a, b = (embedding_dedup.pieces(v, old, old_bits, old_tables) for v in (base, cosine * base + np.sqrt(1 - cosine**2) * away))
    print(f"mean cosine {mean_cosine}, {rows} rows: {old_tables} tables by the formula find {(a == b).any(axis=1).mean():.3f}, {tables} tables of {bits} bits find {recall:.3f}")
    assert recall >= 0.97


@pytest.mark.parametrize("rows", [2, 10, 500, 2000, 100_000])
@pytest.mark.parametrize("dims", [1, 3, 64])
def test_codes_at_every_size(rows, dims):
    """However few rows there are, candidates come from codes."""
    sample = unit(np.random.default_rng(6).normal(size=(min(rows, 2000), dims)))
    bits, rotations, tables = embedding_dedup.plan(sample, rows, 0.93, 0.98)
    assert bits > 0 and tables == len(embedding_dedup.pieces(sample[:1], rotations, bits, tables)[0]) <= embedding_dedup.MOST_TABLES + dims


@pytest.mark.parametrize("rows", [500, 2000])
def test_recall_against_brute_force(spark, rows, monkeypatch):
    """With production parameters, on vectors with a partner at cosine 0.93 to 0.96 each; no link that brute force lacks."""
    plans, whole = [], embedding_dedup.plan
    monkeypatch.setattr(embedding_dedup, "plan", lambda *a: plans.append(whole(*a)) or plans[-1])
    rng = np.random.default_rng(rows)
    base = unit(rng.normal(size=(rows // 2, 64)))
    away = rng.normal(size=base.shape)
    away = unit(away - (away * base).sum(1, keepdims=True) * base)
    cosine = rng.uniform(0.93, 0.96, (len(base), 1))
    vectors = np.vstack([base, cosine * base + np.sqrt(1 - cosine**2) * away])
    found = {r.vec_id: r.n_links for r in embedding_dedup.embedding_dedup(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")).collect()}
    near = unit(vectors) @ unit(vectors).T >= 0.93
    exact = near.sum(axis=1) - 1
    assert all(bits > 0 for bits, _, _ in plans) and len(plans) == 1
    assert all(found[i] <= n for i, n in enumerate(exact)) and sum(found.values()) >= 0.98 * exact.sum() > 0


def test_recall_of_a_large_table_outside_spark():
    """100,000 rows, a stated query set of 2000, brute force over all."""
    rng = np.random.default_rng(9)
    vectors = unit(rng.normal(size=(100_000, 64)))
    away = rng.normal(size=(2000, 64))
    own = vectors[:2000]
    away = unit(away - (away * own).sum(1, keepdims=True) * own)
    cosine = rng.uniform(0.93, 0.96, (2000, 1))
    vectors[2000:4000] = cosine * own + np.sqrt(1 - cosine**2) * away
    bits, rotations, tables = embedding_dedup.plan(vectors[:: len(vectors) // 10_000], len(vectors), 0.93, 0.98)
    i, j = np.nonzero(own @ vectors.T >= 0.93)
    i, j = i[i != j], j[i != j]
    codes = embedding_dedup.pieces(vectors, rotations, bits, tables)
    assert (codes[i] == codes[j]).any(axis=1).mean() >= 0.98 and len(i) >= 1900
