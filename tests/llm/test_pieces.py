import random

import public_tokenizers
import pytest
import sentencepiece

from wattframe.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "   ", "▁", " ▁ a", "\n\n\t x", "é日本語 🎉 \x00 z", "a" * 3000, " " * 100, "▁" * 33 + "ab", "<s> <unk> <0x0A>", "Ünï ﬁ Å", "Hello, world. Hello"]


@pytest.fixture(scope="module")
def own():
    return pieces.Agenda(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def drawn(n):
    draw = random.Random(5)
    return ["".join(draw.choice(" ▁ab\n.é日thein12") for _ in range(draw.randrange(80))) for _ in range(n)]


def listed(ids, ends):
    return [ids[lo:hi].tolist() for lo, hi in zip(ends, ends[1:], strict=False)]


def encoded(own, texts):
    ids, ends, agrees = own.encode_all(texts)
    return listed(ids, ends), agrees.tolist()


def together(own, texts):
    ids, counts = own.together(texts)
    return [tuple(i) for i in listed(ids, [0, *counts.cumsum()])]


def plain(scores, text):
    """Merge the best adjacent pair, the leftmost of equals, until none is a piece."""
    symbols = list(text)
    while True:
        pairs = [(-scores[symbols[i] + symbols[i + 1]], i) for i in range(len(symbols) - 1) if symbols[i] + symbols[i + 1] in scores]
        if not pairs:
            return symbols
        _, i = min(pairs)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def test_agenda_merges_as_a_plain_search(own):
    for text in drawn(300) + ["thethethe", "aaaaaaa"]:
        whole = own.library.normalize(text)
        assert own.merged(whole) == plain(own.scores, whole)


def test_ids_are_the_library_s(own, library):
    texts = TEXTS + drawn(3000)
    assert encoded(own, texts)[0] == library.encode(texts)
    assert encoded(own, texts[::-1])[0] == library.encode(texts[::-1])


def test_stretches_together_and_alone(own):
    texts = [t for t in map(own.library.normalize, drawn(500)) if t] + ["🎉a🎉", "\x00", "é\n\n日"]
    assert together(own, texts) == [own.segment_ids(t) for t in texts]
    assert together(own, ["a"]) == [own.segment_ids("a")]


def test_a_full_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    own = pieces.Agenda(PATH)
    for lo in range(0, 400, 40):
        texts = drawn(400)[lo : lo + 40]
        assert encoded(own, texts)[0] == library.encode(texts)
        assert len(own.known) < 2000


def test_whole_texts_give_the_same_as_segments(library):
    whole = pieces.Agenda(PATH)
    whole.stretches = None
    texts = TEXTS + drawn(500)
    assert encoded(whole, texts) == (library.encode(texts), [True] * len(texts))


def test_unknown_symbols_without_byte_fallback(own):
    lame = pieces.Agenda(PATH)
    lame.bytes = None
    assert together(lame, ["a𓀀𓁀▁𓂀"]) == [(*together(own, ["a"])[0], lame.unknown, lame.unknown, own.ids["▁"], lame.unknown)]


def test_other_vocabularies_are_refused():
    with pytest.raises(Exception):  # noqa: B017, PT011
        pieces.Agenda(public_tokenizers.path("byte_bpe_50k.json"))


def test_round_trip_of_odd_rows(spark, odd, empty, library):
    rows = odd.collect()
    made = pieces.decode(pieces.encode(odd, PATH), PATH).collect()
    want = [library.encode(r["text"] or "") for r in rows]
    assert sorted(((r["doc_id"], r["ids"], r["text"]) for r in made), key=repr) == sorted(
        ((r["doc_id"], i, library.decode(i)) for r, i in zip(rows, want, strict=True)), key=repr
    )
    assert all(r["agrees"] for r in made)
    assert pieces.decode(pieces.encode(empty, PATH), PATH).count() == 0
    assert pieces.decode(pieces.encode(empty, PATH), PATH).columns == ["doc_id", "ids", "agrees", "text"]


def test_a_disagreement_is_told_and_mended(library, monkeypatch):
    own = pieces.Agenda(PATH)
    right = own.together

    def wrong(stretches):
        ids, counts = right(stretches)
        if "▁cat" in stretches:
            ids[counts[: stretches.index("▁cat")].sum()] = 5
        return ids, counts

    monkeypatch.setattr(own, "together", wrong)
    texts = ["the cat", "", "a dog", "the dog ", " "]
    assert encoded(own, texts) == (library.encode(texts), [False, True, True, True, True])
    assert encoded(own, ["cat cat"]) == (library.encode(["cat cat"]), [False])


def test_unknown_symbols_side_by_side_are_one(own):
    lame = pieces.Agenda(PATH)
    lame.bytes = None
    ids, agrees = encoded(lame, ["a𓀀𓁀b", "", "𓀀"])
    unknown, mark = lame.unknown, own.ids["▁"]
    # The library spells bytes here, so whole texts are compared and its ids stand.
    assert ids == own.library.encode(["a𓀀𓁀b", "", "𓀀"]) and agrees == [False, True, False]
    assert unknown not in ids[0] and mark == ids[2][0]


def test_long_stretches_are_not_remembered(own, library):
    fresh = pieces.Agenda(PATH)
    texts = ["x" * 500 + " the cat " + "日本" * 400, "the " + "ab" * 200, "the"]
    for _ in range(2):
        assert encoded(fresh, texts) == (library.encode(texts), [True] * 3)
        assert max(map(len, fresh.known)) <= pieces.LONGEST
        assert len(fresh.known) == len(fresh.counts) == len(fresh.doubted) and len(fresh.ids_of) == fresh.counts.sum()
