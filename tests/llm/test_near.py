import random

import numpy as np

import corpus_pipeline as C
from wattframe.llm import near as N
from wattframe.llm import simhash as H


def jaccard(a, b):
    def grams(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def kept(texts):
    """Least index of each group linked at 0.8 or more, by brute force."""
    label = list(range(len(texts)))
    near = [[j for j in range(len(texts)) if jaccard(texts[i], texts[j]) >= 0.8] for i in range(len(texts))]
    while True:
        new = [min(label[j] for j in near[i]) for i in range(len(texts))]
        if new == label:
            return set(label)
        label = new


def varied(rng, words, share):
    """A copy in which a share of the words is replaced one after the other."""
    out = list(words)
    lo = rng.randrange(len(out) - int(len(out) * share) + 1)
    for i in range(lo, lo + int(len(out) * share)):
        out[i] = str(rng.randrange(10**6))
    return out


def test_the_stage_keeps_one_of_each_group_of_similarity_0_8(spark, documents):
    rng = random.Random(12)
    texts = []
    for _ in range(12):
        words = [str(rng.randrange(10**6)) for _ in range(rng.choice([60, 200, 500]))]
        texts.append(" ".join(words))
        for share in (0.02, 0.05, 0.08, 0.15, 0.3):
            texts.append(" ".join(varied(rng, words, share)))
    texts += ["", None, " ", "one two", "One  two", "one two three", "a b c d e", "a b c d e f"]
    rng.shuffle(texts)
    want = kept(texts)
    got = {r.doc_id for r in C.dedup_near(spark, documents(*[(i, t, "s") for i, t in enumerate(texts)]), "").collect()}
    assert got == want and 15 < len(want) < len(texts) - 30


def test_texts_that_only_share_a_passage_all_stay(spark, documents):
    rng = random.Random(3)
    passage = [str(rng.randrange(10**6)) for _ in range(200)]
    texts = [" ".join(passage + [str(rng.randrange(10**6)) for _ in range(60)]) for _ in range(30)]
    assert kept(texts) == set(range(30))
    assert C.dedup_near(spark, documents(*[(i, t, "s") for i, t in enumerate(texts)]), "").count() == 30


def test_a_group_hidden_among_others_of_its_keys_is_found(spark, documents):
    # Texts of similarity 0.7 share many keys without being linked; pairs of them are similar.
    rng = random.Random(6)
    passage = [str(rng.randrange(10**6)) for _ in range(300)]
    texts = []
    for _ in range(15):
        words = passage + [str(rng.randrange(10**6)) for _ in range(50)]
        texts += [" ".join(words), " ".join(varied(rng, words, 0.05))]
    want = kept(texts)
    got = {r.doc_id for r in N.keep_one(documents(*[(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got == want


def test_links_found_at_first_are_not_joined_up_again(spark, documents, monkeypatch):
    rng, given = random.Random(21), []
    monkeypatch.setattr(N, "components", lambda links, own=N.components: given.append(links.count()) or own(links))
    words = [str(rng.randrange(10**6)) for _ in range(300)]
    copies = [" ".join(words[:k] + ["x"] + words[k:]) for k in range(0, 300, 12)]
    assert N.keep_one(documents(*[(i, t, "s") for i, t in enumerate(copies)])).count() == 1
    assert len(given) == 1

    # Links found later join stars, of which there is an edge for each node and not for each link.
    found = N._links_in_keys
    monkeypatch.setattr(N, "_links_in_keys", lambda *a: found(*a).unionByName(spark.createDataFrame([(-5, -6)], "a long, b long")))
    docs = documents(*[(i, t, "s") for i, t in enumerate(copies)])
    nodes = N.marked_sets(docs.select("doc_id", "text")).dropDuplicates(["node"])
    given.clear()
    roots = {r.node: r.root for r in N.similar_links(nodes, docs.select("text")).collect()}
    assert roots.pop(-5) == roots.pop(-6) == -6
    assert set(roots.values()) == {min(roots)} and len(roots) == len(copies)
    assert given[1] <= len(copies) + 1 < given[0]


def test_odd_rows(spark, odd, empty):
    got = N.keep_one(odd)
    assert got.columns == odd.columns and {r.doc_id for r in got.collect()} == {1, 4, 6, 7, None} and got.count() == 5
    assert N.keep_one(empty).count() == 0


def test_the_codebook_is_the_golay_code():
    book = H.codebook()
    apart = (H.LENGTH - book @ book.T) / 2
    assert book.shape == (4096, H.LENGTH) and apart[~np.eye(4096, dtype=bool)].min() == 7
    segments = (book > 0) @ (1 << np.arange(H.LENGTH))
    assert (H.codewords(segments).max(1) == np.arange(4096)).all()


def test_codewords_are_the_nearest_to_simhash_bits():
    rng = np.random.default_rng(5)
    for size in (1, 2, 7, 300):
        own = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        totals, words = N.totals(own), N.nearest_codewords(own)
        assert np.abs(totals).max() <= size and (totals % 2 == size % 2).all()
        for scores, found in zip(totals @ H.codebook().T, words, strict=True):
            assert len(set(found)) == N.NEAREST and sorted(scores[found]) == sorted(scores)[-N.NEAREST :]
        assert len(set(N.golay_keys(own).tolist())) == N.SEGMENTS * N.NEAREST


def test_similar_sets_share_keys_and_others_none():
    rng = np.random.default_rng(8)
    for _ in range(300):
        a, b = (rng.integers(0, 1 << 63, 270, np.uint64) for _ in range(2))
        near = np.concatenate([a[:240], b[:30]])
        assert len(np.intersect1d(N.golay_keys(a), N.golay_keys(near))) > 0
        assert len(np.intersect1d(N.golay_keys(a), N.golay_keys(b))) == 0
