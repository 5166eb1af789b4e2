import math
import random
from hashlib import sha256

import numpy as np
import pytest

from wattframe.llm import clustering


def plain(rows, k=8, rounds=10):
    """The contract word by word, in Python's integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v]))
    centroids = [v for _, v in sorted(kept, key=lambda r: (sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        placed = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, placed, strict=True) if c == n]
            if own:
                centroids[n] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    placed = assign()
    fits = lambda x: x if x < 2**63 else None
    inertia = [sum(d for d, c in placed if c == n) for n in range(len(centroids))]
    return sorted(
        (
            (i, c, fits(d), fits(inertia[c]), fits(sum(inertia)), sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
            for (i, _), (d, c) in zip(kept, placed, strict=True)
        ),
        key=repr,
    )


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, id string, v double")


def got(df):
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def vectors(n=300, seed=1, spread=0.2):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, spread) for _ in range(64)]) for i in range(n)]


def test_rows_as_by_the_contract(spark):
    rows = vectors()
    assert got(clustering.cluster(table(spark, rows).repartition(5))) == plain(rows)


def test_copies_ties_and_odd_vectors(spark):
    rows = vectors(60)
    rows += [(500 + i, rows[3][1]) for i in range(90)] + [(3, rows[3][1])] * 5 + [(None, rows[4][1])] * 3
    rows += [(900, None), (901, []), (902, [0.1] * 63), (903, [None] + [0.0] * 63), (904, [math.nan] * 64), (905, [math.inf] + [0.0] * 63)]
    rows += [(906, [-0.0] * 64), (907, [0.0] * 64)]
    assert got(clustering.cluster(table(spark, rows).repartition(3))) == plain(rows)


@pytest.mark.parametrize("size", [1e5, 1e6, 1e11])
def test_large_components_stay_exact(spark, size):
    rows = vectors(40, 2, size) + vectors(40, 3)
    rows = [(n, v) for n, (_, v) in enumerate(rows)]
    assert got(clustering.cluster(table(spark, rows), clusters=3, rounds=3)) == plain(rows, 3, 3)


def test_few_and_none(spark):
    rows = vectors(3)
    assert got(clustering.cluster(table(spark, rows))) == plain(rows)
    assert got(clustering.cluster(table(spark, rows).where("vec_id < 0"))) == []
    assert got(clustering.cluster(table(spark, [(1, None)]))) == []


def test_blocks_lose_nothing_and_share_copies():
    draw = np.random.default_rng(1)
    mixed = np.concatenate([np.repeat(draw.integers(-9, 9, (3, 16)), 200, 0), draw.integers(-9, 9, (40, 16))]).astype(float)
    loose = draw.integers(-500, 500, (900, 13)).astype(float)
    for data, widest in ((mixed, 8), (loose, 8), (loose, 5), (loose[:1], 8)):
        back = np.full(data.shape, np.nan)
        blocks = clustering.dictionary_blocks(data, widest)
        for first, width, codes, words in blocks:
            assert len(np.unique(words, axis=0)) == len(words)
            back[:, first : first + width] = words[codes]
        assert (back == data).all()
    assert {b[1] for b in clustering.dictionary_blocks(mixed, 8)} == {8}


def test_sums_by_word_are_sums():
    draw = np.random.default_rng(2)
    data = draw.integers(-50, 50, (500, 8)).astype(float)
    blocks = [
        {"first": f, "width": w, "codes": c.tobytes(), "words": x.tobytes()} for f, w, c, x in clustering.dictionary_blocks(data)
    ]
    chunk = clustering.Chunk(blocks, [[0] * 8, [20] * 8])
    cluster, distance = chunk.nearest()
    exact = ((data[:, None] - np.array([[0] * 8, [20] * 8])) ** 2).sum(2)
    assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert chunk.sums(cluster) == [data[cluster == c].sum(0).astype(int).tolist() for c in (0, 1)]
