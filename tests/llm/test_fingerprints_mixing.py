import hashlib
import re

from pyspark.sql import functions as F

from wattframe.llm import fingerprints as P
from wattframe.llm import mixing as M


def plain_syncmers(spark, data: bytes) -> set[int]:
    """Positions by the definition, with the hash the column uses."""
    n = len(data) - P.S + 1
    if len(data) < P.K:
        return set()
    h = [r[0] for r in spark.createDataFrame([(i, bytearray(data[i : i + P.S])) for i in range(n)], "i int, b binary").orderBy("i").select(F.xxhash64("b")).collect()]
    w = P.K - P.S + 1
    return {i + 1 for i in range(n - w + 1) if min(h[i : i + w]) in (h[i], h[i + w - 1])}


def test_syncmers_follow_the_definition(spark):
    texts = ["the quick brown fox jumps over the lazy dog " * 3, "a" * 40, "short", "", "exactly16bytes!!"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.syncmers(F.col("t").cast("binary")).alias("s")).collect()
    for r in got:
        assert {x["pos"] for x in r["s"]} == plain_syncmers(spark, r["t"].encode())


def test_blocks_do_not_change_syncmers(spark, monkeypatch):
    df = spark.createDataFrame([("some words that go on " * 9,)], "t string")
    whole = df.select(P.syncmers(F.col("t").cast("binary"))).first()[0]
    monkeypatch.setattr(P, "BLOCK", 7)
    assert df.select(P.syncmers(F.col("t").cast("binary"))).first()[0] == whole


def test_edited_text_and_likeness(documents):
    texts = {i: f"document {i} " + " ".join(str(i * 7919 % 1000 + j * j) for j in range(i % 90)) for i in range(0, 400, 2)}
    rows = {r.doc_id: r for r in P.fingerprints(documents(*[(i, t, "a") for i, t in texts.items()])).collect()}
    ids = sorted(texts)
    assert len(rows) == len(ids)
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        t, cut = texts[a], len(texts[a]) // 4
        edited = t[: len(t) - cut] + texts[b][:cut]
        assert rows[a].n_chars == len(t)
        assert rows[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[a].near_next <= 1 and 0 <= rows[a].near_edited <= 1
    long = [rows[i] for i in ids if len(texts[i]) > 200]
    assert min(r.near_edited for r in long) > 0.2


def test_equal_texts_have_equal_fingerprints(documents):
    """The edited text that equals a document has its fingerprint, though its anchors are found in two parts."""
    a, b = "alpha beta gamma delta epsilon zeta eta theta " * 4, "iota kappa lambda mu nu xi omicron pi rho sigma " * 4
    cut = len(a) // 4
    made = a[: len(a) - cut] + b[:cut]
    got = {r.doc_id: r for r in P.fingerprints(documents((1, a, "s"), (2, b, "s"), (3, made, "s"))).collect()}
    assert got[1].edited_fingerprint == got[3].fingerprint


def test_fingerprints_of_odd_rows(odd, empty):
    got = P.fingerprints(odd).collect()
    assert len(got) == 9 and P.fingerprints(empty).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].fingerprint == "" and by[1][0].n_chars == 0 and by[2][0].near_edited == 1.0
    assert by[4][0].fingerprint == by[5][0].fingerprint == by[5][1].fingerprint


def targets(sizes: dict, share=1.5):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mix_meets_targets(documents):
    rows = [(i, "w " * (i * 37 % 50), ("x", "y", "z", None)[0 if i % 3 == 0 else i % 4]) for i in range(900)]
    docs = documents(*rows)
    got = M.mix(docs).collect()
    size, taken, target = {}, {}, {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.size == rows[r.doc_id][0] * 37 % 50
    want = targets(size)
    for s, n in size.items():
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 0.5
    assert sorted(map(repr, got)) == sorted(map(repr, M.mix(docs.repartition(3)).collect()))
    copies = M.mixed_documents(docs).groupBy("source").agg(F.sum(M.words(F.col("text"))).alias("n")).collect()
    assert {r.source: r.n for r in copies} == taken


def test_leading_words_keep_white_space(spark):
    df = spark.createDataFrame([("  a\n b\tc  ",)], "t string")
    assert df.select(M.leading_words(F.col("t"), F.lit(2))).first()[0] == "  a\n b"


def test_mix_of_odd_rows(odd, empty):
    got = M.mix(odd).collect()
    assert len(got) == 9 and M.mix(empty).count() == 0 and M.mixed_documents(empty).count() == 0
    assert M.mixed_documents(odd).columns == odd.columns
    sizes = sorted(r.size for r in got)
    assert sizes == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in [r.text for r in odd.collect()])
