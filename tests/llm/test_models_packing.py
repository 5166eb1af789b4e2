import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wattframe.llm import language as G
from wattframe.llm import packing as P
from wattframe.llm import quality as Q
from wattframe.llm import topk as K

PATH = public_tokenizers.path("byte_bpe_50k.json")


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    sounds = {"en": "th er ing on at ed", "fr": "eau ou é ment que ç", "de": "sch ei ung ü er ß"}
    for i in range(n):
        lang = rng.choice(list(sounds))
        yield i, " ".join("".join(rng.choices(sounds[lang].split(), k=3)) for _ in range(30)), lang


def test_code_lengths_are_probabilities():
    """With frozen counts the codes of all bytes after a context sum to at most one, in every language."""
    data = np.frombuffer(b"abracadabra, abracadabra. " * 30, np.uint8)
    gram = (G._grams(data, np.array([0, len(data)])).astype(np.uint64) << np.uint64(8)) | data
    gram, n = np.unique(gram, return_counts=True)
    model = G.fit(["x"], np.zeros(len(gram), int), gram, n.astype(float))
    total = np.exp(-model.cost[:, model.symbol, 0]).sum(1)
    assert (total <= 1 + 1e-6).all() and len(model.order) > 10
    lengths = G.code_lengths(model, G.transitions(model), data, np.array([0, len(data)]))
    plain = 0.0
    for i in range(len(data)):
        before = bytes(3 - min(i, 3)) + data[max(0, i - 3) : i].tobytes()
        plain += model.cost[G._state(model.order, model.context, int.from_bytes(before, "big"), 3), model.symbol[data[i]], 0]
    assert abs(lengths[0, 0] - plain) < 1e-2


def test_language_of_held_out_rows(spark, odd, empty):
    docs = spark.createDataFrame(list(corpus()), "doc_id long, text string, lang string")
    model = G.train(docs)
    got = G.identify(docs.drop("lang"), model).join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 30 and all(r.lang_pred == r.lang and 0.9 < r.score <= 1 for r in got)
    rows = {r.doc_id: r for r in G.identify(odd, model).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und" and rows[1].score == 0
    assert rows[7].lang_pred == "en" and G.identify(empty, model).count() == 0
    nothing = G.train(docs.where("doc_id < 0"))
    assert {r.lang_pred for r in G.identify(docs, nothing).collect()} == {"und"}


def test_quality_separates_and_is_deterministic(spark, odd, empty):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["the", "of", "and", "in"], k=40)) if i % 2 else "WIN!! " * rng.randrange(20, 40)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(1, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model, again = Q.train(docs, labels), Q.train(docs.repartition(5), labels)
    assert (model.weights == again.weights).all() and model.bias == again.bias
    got = Q.score_documents(docs, model).collect()
    assert all(r.predicted == r.doc_id % 2 and 0 <= r.score <= 1 for r in got)
    assert Q.score_documents(odd, model).count() == 9 and Q.score_documents(empty, model).count() == 0
    assert Q.train(docs.where("doc_id < 0"), labels).bias == 0.0


def test_features_do_not_depend_on_neighbours():
    texts = [b"a b  c", b"", b" \n", b"A b!! 12", b"a b  c"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    index, n = Q.features(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    parts = np.split(index, np.cumsum(n)[:-1])
    for t, p in zip(texts, parts, strict=True):
        assert sorted(Q.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tolist()) == sorted(p.tolist())


def test_encoder_agrees_with_the_library():
    texts = ["", None, " ", "  ", "a  b", " a b ", "a b\n", "a\n b", "don't stop 's", "a\x1c b c", "é 日本 語", "<|endoftext|> a", "\x85 q w", "tab\t x", "b b b b"]
    encoder = P.Encoder(PATH)
    for _ in range(2):
        ids, at = encoder.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, P.END]


def test_shortest_pack_first_places_everything():
    rng = random.Random(6)
    histogram = {rng.randrange(1, 1024): rng.randrange(1, 500) for _ in range(200)}
    packs = P.shortest_pack_first(histogram)
    back = {}
    for pattern, n in packs:
        assert sum(pattern) <= 1024 and n > 0
        for size in pattern:
            back[size] = back.get(size, 0) + n
    tokens = sum(s * n for s, n in histogram.items())
    assert back == histogram and tokens / (1024 * sum(n for _, n in packs)) > 0.9
    assert P.shortest_pack_first({}) == []


def test_pieces_rebuild_documents(odd, empty):
    got = P.pack(odd, PATH).toPandas()
    tokenizer = Tokenizer.from_file(PATH)
    for i, text in ((7, "long text of words, " * 4000), (2, ""), (1, "")):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        own = got[got.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    own = got.sort_values(["sequence_id", "offset"])
    ends = own.groupby("sequence_id")["length"].cumsum()
    assert (ends - own["length"] == own["offset"]).all() and ends.max() <= 1024
    assert P.pack(empty, PATH).count() == 0


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(700, 16)).round(2)
    v[5], v[6], v[300:330] = v[0], v[0], v[1]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(900, None), (1000, [float("nan")] * 16), (1100, [None] * 16), (None, [0.0] * 16), (1200, [float("inf")] * 16), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = K.top_inner_products(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0).toPandas()
    w = np.floor(1024 * v)
    for q in range(0, 700, 100):
        score = w @ w[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(700), -score))[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own.vec_id.tolist() == best.tolist() and own.score.tolist() == score[best].astype(int).tolist()
    assert len(got) == 70 and K.top_inner_products(df.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0


@pytest.mark.parametrize("n", [3, 10, 200])
def test_search_of_small_blocks(n):
    rng = np.random.default_rng(n)
    data = rng.integers(-900, 900, (n, 5)).astype(float)
    for ids, scores in K.ImpactIndex(data).search(np.arange(n), data[:2], np.arange(2), 10):
        assert len(ids) == min(10, n - 1) and (np.diff(scores) <= 0).all()
