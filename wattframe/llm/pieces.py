"""Encoding with merge-type SentencePiece vocabularies by an agenda of adjacent pairs, and decoding."""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from wattframe.llm.common import slices

SPACE = "▁"
#: Stretches whose ids a task remembers before it starts anew, and the longest (in characters) it does.
REMEMBERED, LONGEST = 1 << 19, 64
#: Characters of a stretch up to which stretches share one agenda.
TOGETHER = 32
#: Stretches of one agenda, few enough for a processor's cache.
AGENDA = 4096
#: Bytes of text worked on at a time.
BLOCK = 1 << 21

_NEVER = np.iinfo(np.int32).max


class Agenda:
    """A merge-type vocabulary: pieces with scores, merged pair by pair from the highest score, leftmost first.

    Normalising is left to the library. If no piece holds a space mark behind another character, no merge crosses the
    start of a run of marks: a text is cut there and each distinct stretch worked on once; otherwise the whole
    text is one stretch. Stretches of a batch share one agenda, which takes the best pair of each of them at a time;
    a long one has a queue of its own.
    """

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto.FromString(self.library.serialized_model_proto())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        held = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE:
            raise ValueError("not a merge-type vocabulary")
        if kinds.USER_DEFINED in held or kinds.UNUSED in held:
            raise ValueError("user-defined and unused pieces are not supported")
        self.scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if model.trainer_spec.byte_fallback else None
        self.unknown = self.library.unk_id()
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.scores)
        self.stretches = None if crossing else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.forget()
        # What two ids side by side merge to, and its place by score.
        self.size = len(model.pieces) + 1
        places = {score: place for place, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        pairs = sorted(
            (self.ids[p[:i]] * self.size + self.ids[p[i:]], places[score], self.ids[p])
            for p, score in self.scores.items()
            for i in range(1, len(p))
            if p[:i] in self.ids and p[i:] in self.ids
        )
        self.keys, self.places, self.into = (np.array(c, np.int64) for c in (zip(*pairs, strict=True) if pairs else ([-1], [0], [0])))
        # A character that is no piece has the last number, which merges with nothing.
        self.characters = np.full(0x110000, self.size - 1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.characters[ord(piece)] = i

    def forget(self) -> None:
        """Remember no stretch: where each stands in `ids_of`, how many ids it has there, and if the library sees it otherwise."""
        self.known: dict[str, int] = {}
        self.ids_of, self.counts, self.doubted = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, bool)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ids side by side the place of what they merge to, and which table row says so."""
        key = left * self.size + right
        row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[row] == key, self.places[row], _NEVER), row

    def together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stretches, one after the other, and how many each has: in each step every stretch merges its best pair."""
        symbols = self.characters[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)].astype(np.int64)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
        place, row = self._pairs(symbols, np.append(symbols[1:], 0))
        place[np.append(owner[1:] != owner[:-1], True)] = _NEVER
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(starts, len(owner)))
            best = np.repeat(np.minimum.reduceat(place, starts), lengths)
            live = best != _NEVER
            if not live.all():
                done.append((owner[~live], symbols[~live]))
                symbols, owner, place, row, best = symbols[live], owner[live], place[live], row[live], best[live]
            if len(symbols) == 0:
                break
            at = np.flatnonzero(place == best)
            at = at[np.append(True, owner[at][1:] != owner[at][:-1])]
            symbols[at] = self.into[row[at]]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            symbols, owner, place, row = symbols[stays], owner[stays], place[stays], row[stays]
            at -= np.arange(len(at))
            changed = np.concatenate([at, at[at > 0] - 1])
            after = np.minimum(changed + 1, len(symbols) - 1)
            place[changed], row[changed] = self._pairs(symbols[changed], symbols[after])
            place[changed[(owner[changed] != owner[after]) | (changed == after)]] = _NEVER
        owner, symbols = (np.concatenate(c) for c in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        owner, symbols = owner[order], symbols[order]
        lone = symbols == self.size - 1
        if lone.any():
            spelt = [self.spelt(c) for k in np.unique(owner[lone]).tolist() for c in texts[k] if c not in self.ids]
            widths = np.ones(len(symbols), np.int64)
            widths[lone] = [len(ids) for ids in spelt]
            owner, symbols, lone = (np.repeat(c, widths) for c in (owner, symbols, lone))
            symbols[lone] = list(chain.from_iterable(spelt))
        return symbols.astype(np.int32), np.bincount(owner, minlength=len(texts))

    def spelt(self, symbol: str) -> list[int]:
        """What stands for a symbol that is no piece: its bytes, or the unknown id."""
        return [self.bytes[b] for b in symbol.encode()] if self.bytes else [self.unknown]

    def merged(self, text: str) -> list[str]:
        """The symbols left when no adjacent pair is a piece."""
        symbols, scores = list(text), self.scores
        end = len(symbols)
        before, after = list(range(-1, end - 1)), list(range(1, end + 1))
        agenda = []
        for left in range(end - 1):
            score = scores.get(text[left : left + 2])
            if score is not None:
                agenda.append((-score, left, left + 1, 2))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            # A side that has been merged since is empty or longer than when the pair was offered.
            if not a or not b or len(a) + len(b) != size:
                continue
            symbols[left] = a = a + b
            symbols[right] = ""
            after[left] = right = after[right]
            if right < end:
                before[right] = left
                score = scores.get(a + symbols[right])
                if score is not None:
                    heapq.heappush(agenda, (-score, left, right, size + len(symbols[right])))
            right, left = left, before[left]
            if left >= 0:
                score = scores.get(symbols[left] + a)
                if score is not None:
                    heapq.heappush(agenda, (-score, left, right, size + len(symbols[left])))
        return [s for s in symbols if s]

    def segment_ids(self, text: str) -> tuple[int, ...]:
        """The ids of a stretch by a queue of its own; a symbol that is no piece falls back to its bytes, or is unknown."""
        out: list[int] = []
        for symbol in self.merged(text):
            own = self.ids.get(symbol)
            if own is not None:
                out.append(own)
            else:
                out += self.spelt(symbol)
        return tuple(out)

    def learn(self, stretches: list[str]) -> None:
        """Remember the ids of stretches not met before, the shortest first, and if the library agrees."""
        stretches = sorted(stretches, key=len)
        short = sum(len(t) <= TOGETHER for t in stretches)
        done = [self.together(stretches[lo : min(lo + AGENDA, short)]) for lo in range(0, short, AGENDA)]
        alone = [self.segment_ids(t) for t in stretches[short:]]
        done.append((np.array([i for ids in alone for i in ids], np.int32), np.array([len(ids) for ids in alone], np.int64)))
        ids, counts = (np.concatenate(c) for c in zip(*done, strict=True))

        asked = self.library.encode([t[1:] for t in stretches], num_threads=1)
        theirs = np.fromiter(map(len, asked), np.int64, len(asked))
        other = np.fromiter(chain.from_iterable(asked), np.int32, theirs.sum())
        doubted = theirs != counts
        alike = np.flatnonzero(~doubted)
        differs = ids[np.repeat(~doubted, counts)] != other[np.repeat(~doubted, theirs)]
        doubted[np.repeat(alike, counts[alike])[differs]] = True
        doubted |= np.fromiter((t[0] != SPACE for t in stretches), bool, len(stretches))
        self.known.update(zip(stretches, range(len(self.counts), len(self.counts) + len(stretches)), strict=True))
        self.ids_of = np.concatenate([self.ids_of, ids])
        self.counts = np.concatenate([self.counts, counts])
        self.doubted = np.concatenate([self.doubted, doubted])

    def keep(self, stretches: list[str]) -> None:
        """Remember these stretches alone."""
        places = np.fromiter(map(self.known.__getitem__, stretches), np.int64, len(stretches))
        self.ids_of, self.counts, self.doubted = self.ids_at(places), self.counts[places], self.doubted[places]
        self.known = dict(zip(stretches, range(len(stretches)), strict=True))

    def ids_at(self, places: np.ndarray) -> np.ndarray:
        """The ids of remembered stretches, one after the other."""
        counts = self.counts[places]
        starts = (np.cumsum(self.counts) - self.counts)[places]
        return self.ids_of[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]

    def cut(self, text: str) -> list[str]:
        """A text's stretches after normalising."""
        whole = self.library.normalize(text)
        return self.stretches.findall(whole) if self.stretches else [whole] if whole else []

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts, without begin or end ids, where those of each end (from 0), and whether the library agrees.

        Every stretch not met before is also encoded by the library, which takes it as a text without its first
        mark. A text with a stretch that the library sees otherwise or can't take so is compared as a whole; if its
        ids differ, the library's stand and it is said to disagree.
        """
        cut = [self.cut(t) for t in texts]
        stretches = list(chain.from_iterable(cut))
        met = set(stretches)
        new = met.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.keep(list(met - new))
        if new:
            self.learn(list(new))
        places = np.fromiter(map(self.known.__getitem__, stretches), np.int64, len(stretches))
        held = np.array([len(c) for c in cut], np.int64)
        ids = self.ids_at(places)
        ends = np.append(0, np.cumsum(self.counts[places]))[np.append(0, np.cumsum(held))]
        agrees = np.ones(len(texts), bool)
        doubted = np.unique(np.repeat(np.arange(len(texts)), held)[self.doubted[places]]).tolist()
        if doubted or not self.bytes:
            own = np.split(ids, ends[1:-1])
            if not self.bytes:
                # Unknown symbols side by side are one.
                own = [i[np.append(True, (i[1:] != self.unknown) | (i[:-1] != self.unknown))[: len(i)]] for i in own]
            for k in doubted:
                whole = np.array(self.library.encode(texts[k]), np.int32)
                agrees[k], own[k] = np.array_equal(whole, own[k]), whole
            ids, ends = np.concatenate(own), np.append(0, np.cumsum([len(i) for i in own]))
        long = sum(len(t) > LONGEST for t in new)
        if long:
            # They were learnt last.
            left = len(self.counts) - long
            for t in new:
                if len(t) > LONGEST:
                    del self.known[t]
            self.counts, self.doubted = self.counts[:left], self.doubted[:left]
            self.ids_of = self.ids_of[: self.counts.sum()]
        return ids, ends, agrees


@functools.lru_cache(maxsize=2)
def agenda(path: str) -> Agenda:
    return Agenda(path)


@functools.lru_cache(maxsize=2)
def library(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, agrees) for each document: the ids of its whole text by the vocabulary file at `path`.

    The ids come from the agenda. Each distinct stretch of a task's batches is checked against the sentencepiece library;
    where a text's ids differ, `agrees` is false and the library's ids stand. Null and empty texts have no ids. Rows are worked on one by
    one, so repeated rows, null ids and other columns make no difference; an empty table gives an empty one.
    The file must be readable by every executor.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = agenda(path)
        for batch in slices(batches, "text", BLOCK):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if not texts:
                continue
            ids, ends, agrees = own.encode_all(texts)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            columns = [batch.column("doc_id"), lists, pa.array(agrees)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "agrees"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(made, f"doc_id {kind}, ids array<int>, agrees boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` with the column text: its ids decoded by the library. Null ids count as none."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = library(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column("ids").fill_null([])
                flat, ends = lists.flatten().to_numpy().tolist(), np.append(0, np.cumsum(lists.value_lengths().to_numpy())).tolist()
                ids = [flat[lo:hi] for lo, hi in zip(ends, ends[1:], strict=False)]
                texts = pa.array(own.decode(ids, num_threads=1) if ids else [], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "text"])

    rest = encoded.drop("text")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(made, f"{shape}, text string")
