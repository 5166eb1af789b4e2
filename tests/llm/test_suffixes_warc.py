import base64
import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from wattframe.llm import suffixes as X
from wattframe.llm import warc as W
from wattframe.llm.induced import sorted_suffixes


@pytest.mark.parametrize("limit,dense", [(1 << 20, 32), (4, 1), (4, 32), (1 << 20, 1)])
def test_suffixes_and_common_prefixes(limit, dense):
    """Also with queues that spill after four tuples, and with the recursion in place of its base."""
    rng = np.random.default_rng(0)
    for trial in range(80):
        symbols = int(rng.integers(1, 5))
        text = rng.integers(1, symbols + 1, int(rng.integers(1, 60)))
        if trial % 3 == 0:
            text = np.tile(text[:4], int(rng.integers(1, 20)))
        text = np.append(text, 0).astype(np.int16)
        order, common = sorted_suffixes(text, 200, limit, dense)
        s = text.tolist()
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert order.tolist() == want
        for a, b, n in zip(want, want[1:], common[1:].tolist(), strict=False):
            assert s[a : a + n] == s[b : b + n] and s[a + n : a + n + 1] != s[b + n : b + n + 1]


def removed(texts, span):
    seen = Counter(b[i : i + span] for b in texts for i in range(len(b) - span + 1))
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = True
        yield gone


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats_match_brute_force(documents, hot):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    texts = ["a" * 201, "b" * 200, "c" * 3000, "xy" * 150, None, "", base[:500] + "Q" + base[500:900], base[100:450], base[301:501]]
    texts += [base[302:501] + "é", "é" * 150 + "z" + "é" * 101, "abc" * 70, base[900:1300], base[900:1300]]
    texts += [base[1300:1400] + str(i) * 9 + base[1400:1400 + 200 + i] for i in range(12)]
    got = {r.doc_id: r for r in X.without_repeats(documents(*[(i, t, "s") for i, t in enumerate(texts)]), hot=hot).collect()}
    data = [(t or "").encode() for t in texts]
    for i, (b, gone) in enumerate(zip(data, removed(data, X.SPAN), strict=True)):
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(b), int(gone.sum()), spans, kept)
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_runs_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("ab") for _ in range(3000)).encode()
    data, at = np.frombuffer(text, np.uint8), np.array([0, 1000, 1100, 3000])

    def anchors():
        row, start, n, anchor, _, _ = X.window_runs(data, at)
        return {(r, s + j): a for r, s, m, a in zip(row.tolist(), start.tolist(), n.tolist(), anchor.tolist(), strict=True) for j in range(m)}

    whole = anchors()
    assert set(whole) == {(0, i) for i in range(801)} | {(2, i) for i in range(1701)}
    monkeypatch.setattr(X, "CHUNK", 300)
    X._tables.cache_clear()
    assert anchors() == whole
    X._tables.cache_clear()


def test_repeats_of_odd_rows(odd, empty):
    got = X.without_repeats(odd).collect()
    assert len(got) == 9 and X.without_repeats(empty).count() == 0
    assert {r.doc_id: r.n_removed for r in got}[7] > 70_000


PAGES = [(1, "u\nv", "same"), (2, None, "same"), (3, "w", None), (4, "w", ""), (5, "w", "é\r\n\r\nWARC/1.1"), (None, "w", "same"), (6, "w", "x" * 3_000_000)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip(spark):
    folder = W.new_folder(spark, "warc")
    got = {r.page_id: r for r in W.archived(pages(spark), folder=folder).collect()}
    assert len(got) == len(PAGES)
    for i, url, html in PAGES:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data)
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert got[i].payload is None or bytes(got[i].payload) == data
    refers = {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"}
    assert refers == {1: 2, None: 2, 3: 4}
    assert W.read_index(spark, folder).count() == len(PAGES)


def test_members_and_whole_streams(spark, tmp_path):
    """Each index row is one gzip member, members add up to the file, and small payloads stay responses."""
    folder = f"file://{tmp_path}"
    files = W.write_streams(W.with_revisits(pages(spark), min_bytes=5), folder, file_bytes=4)
    index = W.normalise(files, folder).collect()
    assert len(index) == len(PAGES) and {r.record_type for r in index} == {"response"}
    for r in index:
        data = (tmp_path / r.file).read_bytes()[r.offset : r.offset + r.length]
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n") and gzip.decompress(data).endswith(b"\r\n\r\n")
    for name in {r.file for r in index}:
        assert (tmp_path / name).stat().st_size == sum(r.length for r in index if r.file == name)


def test_a_cut_stream_is_noticed(tmp_path):
    whole = W.record(1, "u", b"payload", W.payload_digest(b"payload"), None, False)
    (tmp_path / "x.gz").write_bytes(gzip.compress(whole[:-9]))
    store, path = W.opened(f"file://{tmp_path}")
    with store.open_input_stream(f"{path}/x.gz", compression=None) as source:
        stream = W.Inflated(source)
        head = stream.until(b"\r\n\r\n")
        with pytest.raises(ValueError):
            list(stream.take(int(W.headers(head)["content-length"])))


def test_empty_pages(spark):
    assert W.archived(pages(spark).where("page_id = -1")).count() == 0
