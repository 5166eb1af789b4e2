import random

import numpy as np
import xxhash

from wattframe.llm import lines as N
from wattframe.llm import simhash as S
from wattframe.llm.graph import components


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    c = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[c + 1 :] == b[c + 1 :] if len(a) == len(b) else a[c:] == b[c + 1 :]


def test_lines_match_brute_force(documents):
    rng = random.Random(4)
    base = ["".join(rng.choice("abé ") for _ in range(n)) for n in (20, 21, 25, 30, 60)]
    texts = []
    for _ in range(120):
        own = []
        for _ in range(rng.randrange(1, 5)):
            x = rng.choice(base)
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(x))
                x = x[:i] + rng.choice(["", "a", "é", x[i] + "b"]) + x[i + 1 :]
            own.append(x)
        texts.append("\n".join(own))
    from pyspark.sql import functions as F

    docs = documents(*[(i, t, "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in N.dedup_lines(docs).collect()}
    assert docs.select(F.count("doc_id")).first()[0] == len(got)
    seen, removed = [], 0
    for i, t in enumerate(texts):
        kept, equal, near = [], 0, 0
        for x in t.split("\n"):
            if len(x) >= N.MIN_CHARS and x in seen:
                equal += 1
            elif len(x) >= N.MIN_CHARS and any(one_edit(x, y) for y in seen):
                near += 1
                seen.append(x)
            else:
                kept.append(x)
                if len(x) >= N.MIN_CHARS:
                    seen.append(x)
        assert (got[i].text, got[i].n_equal, got[i].n_near, got[i].n_chars) == ("\n".join(kept), equal, near, len("\n".join(kept)))
        removed += near
    assert removed > 20


def test_lines_of_odd_rows(odd, empty, documents):
    got = N.dedup_lines(odd).collect()
    assert len(got) == 9 and N.dedup_lines(empty).count() == 0
    assert sum(r.text is None for r in got) == 1 and all(r.n_equal == 0 for r in got)
    again = {r.doc_id: r.text for r in N.dedup_lines(documents((2, "x" * 30, "a"), (1, "x" * 30 + "\ny", None))).collect()}
    assert again == {1: "x" * 30 + "\ny", 2: ""}


def test_codewords_cover_two_errors():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 23, 500)
    a = S.codewords(x)
    for i in range(23):
        for j in range(i, 23):
            b = S.codewords(x ^ (1 << i | 1 << j))
            assert ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any((1, 2)).all()


def test_keys_meet_within_three_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 62, 400)
    for k in range(4):
        turned = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for _ in x], np.uint64).view(np.int64)
        one, two = (set(zip(*(v.tolist() for v in S.keys(y)), strict=True)) for y in (x, x ^ turned))
        assert {r for r, _ in one & two} == set(range(len(x)))


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    """Smallest index reachable over links of three bits or fewer."""
    label = list(range(len(fps)))
    while True:
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]
        if new == label:
            return label
        label = new


def test_groups_match_brute_force(documents):
    rng = random.Random(8)
    texts = []
    for _ in range(25):
        words = [str(rng.randrange(10**6)) for _ in range(rng.choice([2, 5, 60, 300]))]
        for _ in range(rng.randrange(1, 6)):
            texts.append(" ".join(words))
            words[rng.randrange(len(words))] = str(rng.randrange(10**6))
    texts += ["", None, "  "]
    rng.shuffle(texts)
    got = {r.doc_id: r for r in S.near_groups(documents(*[(i, t, "s") for i, t in enumerate(texts)])).collect()}
    fps = [plain(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == groups(fps)


def test_blocks_of_a_hot_key_give_the_same_groups(spark):
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 1 << 8, 60) << 30)
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    label = lambda hot: {r.node: r.root for r in components(S.near_links(df, hot)).collect()}
    assert label(4) == label(1000)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_groups_of_odd_rows(odd, empty):
    got = S.near_groups(odd).collect()
    assert len(got) == 9 and S.near_groups(empty).count() == 0
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    kept = S.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 4, 6, 7, None} and kept.count() == 5


def test_every_group_keeps_a_document(documents):
    far, other = "alpha beta gamma delta " * 9, "quite another text of words " * 9
    docs = documents((None, far, "a"), (None, far, "a"), (5, other, "a"), (5, "one more, unlike the rest " * 9, "a"), (8, other, "b"))
    kept = S.keep_one(docs).collect()
    assert sorted(r.text[:5] for r in kept) == ["alpha", "one m", "quite"] and [r.doc_id for r in kept].count(5) == 2
