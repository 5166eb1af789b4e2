import math
import random
import re
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from wattframe.llm import resampling


def plain(docs, target, grams=(1, 1), buckets=10_000, percent=10, least=20):
    """The contract word by word: docs are (doc_id, text)."""

    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        runs = [" ".join(words[i : i + n]) for n in range(grams[0], grams[1] + 1) for i in range(len(words) - n + 1)]
        return len(words), [crc32(r.encode()) % buckets for r in runs]

    own, there = [0] * buckets, [0] * buckets
    for _, text in docs:
        for b in features(text)[1]:
            own[b] += 1
    for text in target:
        for b in features(text)[1]:
            there[b] += 1
    s, t = sum(own), sum(there)
    gains = [math.floor(1000 * math.log((x + 1) * (s + buckets) / ((y + 1) * (t + buckets)))) for x, y in zip(there, own, strict=True)]
    rows = []
    for i, text in docs:
        n, found = features(text)
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gains[b] for b in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n, None])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = place
    return sorted((tuple(r[:4] + r[5:]) for r in rows), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def corpus(n=400, seed=1):
    draw = random.Random(seed)
    letters = ["alpha", "Beta", "gamma9", "ÄÖ", "日本", "x", "delta", "İ", "K"]
    return [(i, " ,".join(draw.choice(letters) + str(draw.randrange(30)) for _ in range(draw.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize("grams", [(1, 1), (1, 2), (2, 3)])
def test_rows_as_by_the_contract(spark, documents, grams):
    docs = corpus()
    target = [t for _, t in corpus(20, 2)] + [None, ""]
    made = resampling.resample(
        documents(*[(i, t, "a") for i, t in docs]), spark.createDataFrame([(t,) for t in target], "text string"), grams, 1000, 30
    )
    assert got(made) == plain(docs, target, grams, 1000, 30)


def test_parts_of_many_runs_and_copies(spark, documents):
    """Several runs, with a third of the rows one repeated document."""
    docs = corpus(300) + [(7, corpus(300)[7][1] + " more" * 30)] * 150
    rows = documents(*[(i, t, "a") for i, t in docs]).repartition(7)
    target = spark.createDataFrame([("alpha1 more beta2",)], "text string")
    made = resampling.resample(rows, target, percent=50, run_rows=40)
    assert got(made) == plain(docs, ["alpha1 more beta2"], percent=50)


def test_ranks_are_those_of_a_sort(spark):
    draw = np.random.default_rng(3)
    rows = [(int(a), int(b)) for a, b in draw.integers(-3, 4, (2000, 2))]
    df = spark.createDataFrame(rows, "a long, b long").repartition(9)
    for first in (0, 1, 777, 2000, 5000):
        ranked = resampling.first_ranks(df, ["a", "b"], first, run_rows=50).collect()
        assert len(ranked) == 2000
        placed = sorted((r["rank"], r["a"], r["b"]) for r in ranked if r["rank"] is not None)
        assert [p[0] for p in placed] == list(range(1, min(first, 2000) + 1))
        assert [p[1:] for p in placed] == sorted(rows)[:first]


def test_odd_rows(spark, odd, empty):
    target = spark.createDataFrame([("one two",), (None,)], "text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(resampling.resample(odd, target, least_words=1, percent=60)) == plain(rows, ["one two"], percent=60, least=1)
    assert got(resampling.resample(empty, target)) == []
    assert got(resampling.resample(odd, target.where("text = ''"))) == plain(rows, [])


def test_blocks_end_between_words():
    text = b"aa bb " * 5000 + b"c" * 9000 + b" " + "é日 ".encode() * 3000
    whole = [w for block in resampling.word_blocks(text, 64) for w in block]
    assert whole == re.findall(rb"[0-9a-z\x80-\xff]+", text)
    for grams in ((1, 1), (1, 3), (2, 2)):
        known = resampling.Buckets(97)
        parts = [b.tolist() for _, b in resampling.feature_buckets(text, known, grams)]
        words = whole
        runs = [b" ".join(words[i : i + n]) for n in range(grams[0], grams[1] + 1) for i in range(len(words) - n + 1)]
        assert sorted(sum(parts, [])) == sorted(crc32(r) % 97 for r in runs)


def test_runs_cross_blocks(monkeypatch):
    monkeypatch.setattr(resampling, "word_blocks", lambda text: iter([text.split()[:1], [], text.split()[1:2], text.split()[2:]]))
    found = [b for _, part in resampling.feature_buckets(b"a b c d", resampling.Buckets(1 << 32), (2, 3)) for b in part]
    assert sorted(found) == sorted(crc32(r) for r in (b"a b", b"b c", b"c d", b"a b c", b"b c d"))
