import math
from collections import Counter

import numpy as np
import pytest

from callsheet.llm import embeddings
from callsheet.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm.test_common import brute as brute_components


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, threshold=0.95):
    units = [np.array(v, float) / np.linalg.norm(np.array(v, float) / max(map(abs, v))) / max(map(abs, v)) if usable(v) else None for _, v in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i)
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j])
            and units[i] @ units[j] >= threshold]
    roots = {i: i for i in range(len(rows))} | brute_components(near)
    ids = {}
    for i, r in roots.items():
        ids.setdefault(r, []).append(rows[i][0])
    degree = Counter(x for pair in near for x in pair)
    out = []
    for i, (name, _) in enumerate(rows):
        lowest = min((x for x in ids[roots[i]] if x is not None), default=None)
        out.append((name, degree[i], lowest, name == lowest))
    return out


def groups(rng, n_groups, size, noise, dimension=64):
    """Vectors around centres whose cosines to each other stay clear of the threshold."""
    rows = []
    for _ in range(n_groups):
        centre = rng.standard_normal(dimension)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            v = centre + noise * rng.standard_normal(dimension) / np.sqrt(dimension)
            rows.append((v * rng.choice([0.01, 1, 300])).tolist())
    return rows


def run(spark, rows, kind="double", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    df = df.selectExpr("*", "1 AS row", "2 AS id", "3 AS bucket")
    return Counter(map(tuple, embeddings.near_duplicates(df, **options).collect()))


@pytest.mark.parametrize("chunk", [embeddings.CHUNK, 3])
@pytest.mark.parametrize("kind", ["double", "float"])
def test_groups(spark, chunk, kind):
    rng = np.random.default_rng(1)
    vectors = groups(rng, 12, 9, 0.1) + groups(rng, 1, 40, 0.02) + groups(rng, 60, 1, 0)
    rng.shuffle(vectors)
    rows = list(enumerate(vectors))
    if kind == "float":
        rows = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    want = brute(rows)
    assert sum(w[1] for w in want) > 2000
    assert run(spark, rows, kind, chunk=chunk) == Counter(want)


def test_many_equal_vectors_are_one_with_a_count(spark):
    rng = np.random.default_rng(5)
    base, other = (rng.standard_normal(64) for _ in range(2))
    near = base + 0.01 * rng.standard_normal(64)
    rows = [(n, base.tolist()) for n in range(100, 15_100)] + [(n, near.tolist()) for n in range(4_000)[-3:]]
    rows += [(None, base.tolist()), (7, other.tolist()), (8, (-base).tolist()), (9, [0.0] * 64)]
    got = run(spark, rows)
    linked = 15_004
    assert got == Counter({
        **{(n, linked - 1, 100, n == 100): 1 for n in range(100, 15_100) if n not in (3997, 3998, 3999)},
        **{(n, linked - 1, 100, False): 2 for n in (3997, 3998, 3999)},
        (None, linked - 1, 100, False): 1, (7, 0, 7, True): 1, (8, 0, 8, True): 1, (9, 0, 9, True): 1})


def test_classes_of_different_sizes_against_brute_force(spark):
    rng = np.random.default_rng(7)
    vectors = [v for v in groups(rng, 8, 6, 0.05) for _ in range(int(rng.integers(1, 9)))]
    vectors += [[-0.0, 1.0], [0.0, 1.0], [0.0, 2.0], None, None, [0.0, 0.0]]
    rng.shuffle(vectors := [v for v in vectors])
    ids = rng.permutation(len(vectors)).tolist()
    rows = [(None if n % 17 == 3 else n, v) for n, v in zip(ids, vectors)]
    for chunk in (embeddings.CHUNK, 2):
        assert run(spark, rows, chunk=chunk) == Counter(brute(rows))


@pytest.mark.parametrize("dimension", [384, 1024])
def test_recall_at_other_dimensions(spark, dimension):
    rng = np.random.default_rng(dimension)
    rows = list(enumerate(groups(rng, 60, 4, 0.2, dimension)))
    want, found = brute(rows), run(spark, rows)
    assert sum(f[1] * n for f, n in found.items()) >= 0.9 * sum(w[1] for w in want) > 300


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(2)
    rows = list(enumerate(groups(rng, 150, 4, 0.2)))  # cosines from about 0.94 to 0.98
    want = brute(rows)
    found = run(spark, rows)
    links = sum(n * k for (_, n, _, _), k in found.items())
    assert sum(w[1] for w in want) > 500
    assert 0.97 * sum(w[1] for w in want) <= links <= sum(w[1] for w in want)


def test_a_block_larger_than_what_is_flushed_at_a_time(spark):
    rng = np.random.default_rng(3)
    rows = list(enumerate(groups(rng, 1, 2300, 0.01, dimension=16)))
    assert run(spark, rows, chunk=700) == Counter(
        (i, 2299, 0, i == 0) for i in range(2300))


def test_unusable_vectors_ties_and_equal_rows(spark):
    v = [1.0, 2.0, -3.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [1.0, float("nan"), 1.0]),
            (6, [float("inf"), 1.0, 1.0]), (7, v), (7, v), (None, v), (9, [x * 1e300 for x in v]), (8, [x * 1e-300 for x in v]),
            (10, [1.0, 2.0]), (11, [1.0, 2.0]), (None, [0.0, 0.0, 1.0]), (12, [-1.0, -2.0, 3.0])]
    got = run(spark, rows)
    assert got == Counter(
        [(n, 0, n, True) for n in (1, 2, 3, 4, 5, 6, 12)]
        + [(7, 4, 7, True)] * 2 + [(None, 4, 7, False), (9, 4, 7, False), (8, 4, 7, False)]
        + [(10, 1, 10, True), (11, 1, 10, False), (None, 0, None, True)]
    )


def test_empty_table(spark):
    assert run(spark, []) == Counter()


def test_the_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = QUERIES["op9_embedding_near_dedup"](spark, SMALL)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows))
