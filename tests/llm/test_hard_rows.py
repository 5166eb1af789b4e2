"""Repeated rows, clashing names, very long lines, odd vectors and large groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.llm import lines, mixing, near, simhash, topk

NAMES = "_row _hash _id _of _doc _gone _size _taken _copy _number _source _key _first _last _bucket root node key n size fp h g".split()


def test_repeated_rows_take_no_more_than_the_budget(spark, documents):
    docs = documents(*[(7, "ten words are here in this text of ten words", "a")] * 400, *[(i, "one two three", "b") for i in range(50)])
    plan = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken")).collect()
    made = mixing.mixed_documents(docs)
    got = {r["source"]: r["n"] for r in made.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect()}
    assert got == {r["source"]: r["taken"] for r in plan}
    assert made.columns == docs.columns


@pytest.mark.parametrize("step", [mixing.mixed_documents, lines.dedup_lines, near.keep_one, simhash.keep_one], ids=["mix", "lines", "near", "simhash"])
def test_columns_of_any_name_keep_their_values(spark, documents, step):
    docs = documents((1, "a line that stands here twice\nand more of it", "a"), (2, "a line that stands here twice\nelse", "a"), (3, "x y z", "b"))
    plain = step(docs).select("doc_id", "text", "source")
    named = docs.select("doc_id", "text", "source", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in NAMES])
    got = step(named)
    assert set(named.columns) <= set(got.columns)
    rows = got.collect()
    assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in NAMES)
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in rows) == sorted(tuple(r) for r in plain.collect())


def near_lines(rng, n):
    line = "".join(rng.choice("abcdé日") for _ in range(n))
    i = rng.randrange(n)
    return [line, line[:i] + "X" + line[i + 1 :], line[:i] + line[i + 1 :], line[:i] + "YY" + line[i:], "Z" + line, line + "Z", line[1:]]


def test_long_lines_as_short_ones(spark, documents, monkeypatch):
    """The same verdicts whichever way variants are made, also where both meet."""
    rng = random.Random(8)
    texts = [t for n in (30, 31, 40, 41, 60) for t in near_lines(rng, n)]
    docs = documents(*[(i, t, "a") for i, t in enumerate(texts)])
    wanted = sorted((r["doc_id"], r["text"], r["n_near"]) for r in lines.dedup_lines(docs).collect())
    assert sum(n for *_, n in wanted) >= 20
    for long in (10, 30, 40):
        monkeypatch.setattr(lines, "LONG", long)
        assert sorted((r["doc_id"], r["text"], r["n_near"]) for r in lines.dedup_lines(docs).collect()) == wanted


def test_a_line_of_a_million_characters(spark, documents):
    line = "".join(random.Random(9).choices("abcdefgh ", k=1_000_000))
    docs = documents((1, line, "a"), (2, line[:400_000] + "X" + line[400_001:], "a"), (3, line[:-1], "a"), (4, line[::-1], "a"))
    assert sorted((r["doc_id"], r["n_near"]) for r in lines.dedup_lines(docs).collect()) == [(1, 0), (2, 1), (3, 1), (4, 0)]


def brute(rows, k):
    out = []
    for q, v in rows:
        if q % 100 == 0:
            scored = [(min(max(sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), -(2**63)), 2**63 - 1), i) for i, w in rows if i != q and len(w) == len(v)]
            out += [(q, r, i, s) for r, (s, i) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [3e6, 3e9, 1e30])
def test_scores_of_large_components_are_exact(spark, size):
    rng = np.random.default_rng(int(size) % 97)
    rows = [(i, [float(np.floor(x)) for x in rng.normal(0, size, 9)]) for i in range(250)]
    rows += [(300 + i, []) for i in range(3)] + [(400, []), (500, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = topk.top_inner_products(df, "id", "v", F.col("id") % 100 == 0, scale=1).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, 10)


def varied(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), max(1, int(len(out) * share))):
        out[i] = str(rng.randrange(10**6))
    return out


def groups(texts):
    sets = [near.shingle_set(t.encode()) for t in texts]
    label = np.arange(len(texts))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and near.similar(sets[i], sets[j]):
                label[label == label[i]] = label[j]
    return [min(np.flatnonzero(label == x)) for x in label]


@pytest.mark.parametrize(("block", "words"), [(2048, 1 << 22), (16, 1 << 22), (2048, 2000)])
def test_groups_in_blocks_are_the_same(spark, documents, monkeypatch, block, words):
    monkeypatch.setattr(near.similar_links, "__defaults__", (5, 0.8, block, words))
    rng = random.Random(2)
    texts = []
    for _ in range(4):
        base = [str(rng.randrange(10**6)) for _ in range(250)]
        texts.append(" ".join(base))
        texts += [" ".join(varied(rng, base, rng.choice([0.004, 0.02, 0.04, 0.06]))) for _ in range(40)]
    rng.shuffle(texts)
    kept = {r["doc_id"] for r in near.keep_one(documents(*[(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert kept == set(groups(texts))


def test_two_thousand_near_copies_are_one_group(spark, documents):
    rng = random.Random(5)
    base = [str(rng.randrange(10**6)) for _ in range(200)]
    texts = [" ".join(base), *[" ".join(varied(rng, base, 0.01)) for _ in range(2000)]]
    assert [r["doc_id"] for r in near.keep_one(documents(*[(i, t, "a") for i, t in enumerate(texts)])).collect()] == [0]


def test_links_among_sets_join_what_is_linked():
    rng = np.random.default_rng(3)
    for trial in range(30):
        base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(20, 60)), replace=False), rng.integers(0, 1 << 62, 3).astype(np.uint64)])) for _ in range(40)]
        side = rng.integers(0, 2, 40) if trial % 2 else None
        start = rng.integers(0, 12, 40)
        label = start.copy()
        for i in range(40):
            for j in range(40):
                if (side is None or side[i] != side[j]) and near.similar(sets[i], sets[j]):
                    label[label == label[i]] = label[j]
        got = start.copy()
        for i, j in near.links_among(sets, start, side):
            assert near.similar(sets[i], sets[j]) and got[i] != got[j]
            got[got == got[i]] = got[j]
        assert (np.equal.outer(label, label) == np.equal.outer(got, got)).all()
