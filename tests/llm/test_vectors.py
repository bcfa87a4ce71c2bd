import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fairline.llm.centroids import assign, cluster_vectors, decode, encode, sums
from fairline.llm.topk import best_in_block, choose_pivots, distances, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, score int, query_id int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3, 4) for i, v in rows], SCHEMA)


def whole(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * float(np.float32(x))) for x in v]


def model_nearest(rows, every, k):
    held = [(i, w) for i, v in rows if (w := whole(v, 256)) is not None]
    out = Counter()
    for n, (q, a) in enumerate(held):
        if q is None or q % every:
            continue
        others = [(-sum(x * y for x, y in zip(a, b, strict=True)), c is None, c or 0, c) for m, (c, b) in enumerate(held) if m != n and len(a) == len(b)]
        for rank, (minus, _, _, c) in enumerate(sorted(others, key=lambda t: t[:3])[:k], 1):
            out[q, rank, c, -minus] += 1
    return out


def found_nearest(rows, spark, every, k, **how):
    return Counter(tuple(r) for r in nearest(table(spark, rows), F.col("vec_id") % every == 0, k=k, **how).select("query_id", "rank", "vec_id", "score").collect())


def points(n, seed=3, dims=8):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [c + r.gauss(0, 0.1) for c in centres[i % 5]]) for i in range(n)]


AWKWARD = [(500, None), (505, [None] * 8), (510, [math.nan] * 8), (515, [math.inf] + [0.0] * 7), (520, [0.25] * 3), (525, [0.5] * 3), (530, []), (535, []), (None, [0.25] * 8), (None, [9.0] * 8), (540, [0.0] * 8), (540, [0.0] * 8), (540, [1.0] * 8), (-5, [-1.0] * 8)]


def test_nearest_agrees_with_all_pairs_and_gives_awkward_rows_their_defined_results(spark):
    copies = [(1000 + i, [0.5] * 8) for i in range(40)]  # a passage of ties: a class far larger than k
    rows = points(300) + AWKWARD + copies
    random.Random(1).shuffle(rows)
    expected = model_nearest(rows, 5, 3)
    assert found_nearest(rows, spark, 5, 3) == expected
    assert found_nearest(rows, spark, 5, 3, pivots=1) == expected


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, [1.0]), (0, [1.0])], [(5, None)]])
def test_nearest_of_few_rows(spark, rows):
    assert found_nearest(rows, spark, 5, 3) == model_nearest(rows, 5, 3)


def test_nearest_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr("fairline.llm.topk.BLOCK", 16)
    monkeypatch.setattr("fairline.llm.topk.ASKED", 4)
    rows = points(200, seed=5)
    assert found_nearest(rows, spark, 7, 5) == model_nearest(rows, 7, 5)


def test_scores_that_do_not_fit_are_errors(spark):
    with pytest.raises(Exception, match="64 bits"):
        nearest(table(spark, [(0, [1e20]), (1, [1.0])]), F.lit(True)).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 6), st.integers(1, 5))
def test_best_in_block_is_exact(seed, rows, dims, k):
    r = np.random.RandomState(seed)
    held = r.randint(-4, 5, (rows, dims))
    many = r.randint(1, 3, rows)
    query = r.randint(-4, 5, dims)
    pivots = choose_pivots(held.tolist(), 4)[dims]
    scores = held @ query
    best, met = best_in_block(query, int(query @ query), distances(query[None], pivots)[0], held, (held * held).sum(1), distances(held, pivots), many, k, -(1 << 63))
    order = sorted(range(rows), key=lambda i: (-scores[i], i))
    needed, seen = [], 0
    for i in order:
        if seen >= k and scores[i] < scores[needed[-1]]:
            break
        if len(needed) == k:
            break
        needed.append(i)
        seen += int(many[i])
    assert best[: len(needed)] == [(int(scores[i]), i) for i in needed] and met <= rows


def test_bounds_spare_most_candidates_of_a_clustered_table():
    r = np.random.RandomState(0)
    held = np.floor(256 * (np.repeat(r.normal(size=(20, 16)), 100, axis=0) + 0.02 * r.normal(size=(2000, 16)))).astype(np.int64)
    pivots = choose_pivots(held.tolist(), 32)[16]
    square, table_ = (held * held).sum(1), distances(held, pivots)
    met = [best_in_block(held[i], int(square[i]), table_[i], held, square, table_, np.ones(2000, int), 6, -(1 << 63))[1] for i in range(0, 2000, 50)]
    assert np.mean(met) < 1000


def model_clusters(rows, k, rounds, dims):
    held = [(i, w) for i, v in rows if v is not None and len(v) == dims and (w := whole(v, 64)) is not None]
    digest = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    centroids = [w for _, w in sorted(held, key=lambda t: (digest(t[0]), t[1]))[:k]]
    for step in range(rounds + 1):
        where = [min(range(len(centroids)), key=lambda c: (sum((x - y) ** 2 for x, y in zip(w, centroids[c], strict=True)), c)) for _, w in held]
        if step < rounds:
            for c in range(len(centroids)):
                own = [w for (_, w), g in zip(held, where, strict=True) if g == c]
                if own:
                    centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    away = [sum((x - y) ** 2 for x, y in zip(w, centroids[g], strict=True)) for (_, w), g in zip(held, where, strict=True)]
    inertia = Counter()
    for g, d in zip(where, away, strict=True):
        inertia[g] += d
    return Counter((i, g, d, inertia[g], sum(away), hashlib.sha256(",".join(map(str, centroids[g])).encode()).hexdigest()) for (i, _), g, d in zip(held, where, away, strict=True))


@pytest.mark.parametrize("rows", [points(300) + AWKWARD + [(2000 + i, [0.1] * 8) for i in range(150)], points(5), [], [(1, None)], [(3, [0.5] * 8)] * 4])
def test_clusters_agree_with_the_model(spark, rows):
    found = cluster_vectors(table(spark, rows), k=6, rounds=3, dims=8)
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert found.columns == columns
    assert Counter(tuple(r) for r in found.collect()) == model_clusters(rows, 6, 3, 8)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 30), st.integers(1, 7), st.integers(1, 4))
def test_dictionaries_lose_nothing_and_sum_exactly(seed, rows, dims, width):
    r = np.random.RandomState(seed)
    vectors, centroids = r.randint(-5, 6, (rows, dims)), r.randint(-5, 6, (3, dims))
    codes, books = encode(vectors, width)
    assert (decode(codes, books) == vectors).all()
    apart = ((vectors[:, None] - centroids[None]) ** 2).sum(2)
    cluster, distance = assign(codes, books, centroids)
    assert (cluster == apart.argmin(1)).all() and (distance == apart.min(1)).all()
    assert (sums(codes, books, cluster, 3) == np.stack([vectors[cluster == c].sum(0) for c in range(3)])).all()
