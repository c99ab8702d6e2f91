"""SentencePiece encoding and decoding by shared-prefix Viterbi.

White space is marked and the text cut into marked words, a run of marks and what follows; no piece reaches over the end of one, so words are encoded on their own. The distinct words of
a slice of the texts are sorted, which lays them out as a trie, and the trie is walked depth first: the forward states of
a common prefix are computed once and reused by every word that shares it.

The forward state of a prefix is the last piece of its best segmentation. For a unigram model, that is the piece with the best sum
of scores (Viterbi). For a model of merges (BPE) scores don't add up; there, the piece ``t`` ends the segmentation of a prefix if the prefix before it ends in a piece ``u`` such
that merging ``u + t`` leaves just these two, which holds for one ``t`` only. So both kinds have a state that depends on the prefix alone, and both give
exactly what the model prescribes.

The model file is read on the driver, from a path that is a parameter, and broadcast: its size is that of the vocabulary.

Defined results: null and empty texts have no pieces and decode to an empty text. Characters without a piece become bytes where the
model has byte pieces, else the unknown piece. Texts are taken whole; a worker's table of words it has met is bounded. Repeated rows are encoded
alike; null ids are kept; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from veinwork.llm.scratch import map_arrow, table
from veinwork.llm.words import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose pieces a worker keeps from slice to slice; beyond that it starts afresh. A worker that sends on all ids has less room.
MAX_WORDS, FEWER_WORDS = 1_000_000, 300_000
MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """The fields of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        elif key & 7 == 2:
            n = number()
            at += n
            yield key >> 3, raw[at - n : at]
        else:
            n = 4 if key & 7 == 5 else 8
            at += n
            yield key >> 3, raw[at - n : at]


class Pieces:
    """The pieces of a model file and the encoder over them."""

    def __init__(self, raw: bytes, max_words: int = MAX_WORDS):
        self.max_words = max_words
        self.text: list[str] = []
        self.score: list[float] = []
        self.kind: list[int] = []
        self.merges, self.prefix, self.squeeze, rule = False, True, False, "identity"
        for field, value in _fields(raw):
            if field == 1:
                got = dict(_fields(value))
                self.text.append(got[1].decode())
                self.score.append(float(np.frombuffer(got.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kind.append(got.get(3, NORMAL))
            elif field == 2:
                self.merges = dict(_fields(value)).get(3, 1) == 2
            elif field == 3:
                got = dict(_fields(value))
                rule = got.get(1, b"identity").decode()
                self.prefix, self.squeeze = bool(got.get(3, 1)), bool(got.get(4, 1))
        if rule != "identity":
            raise ValueError(f"the model normalises by {rule}; only identity is supported")
        self.ids = {t: i for i, t in enumerate(self.text) if self.kind[i] in (NORMAL, DEFINED)}
        self.byte = {int(t[3:5], 16): i for i, t in enumerate(self.text) if self.kind[i] == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kind) if k == UNKNOWN), 0)
        #: Pieces that merging their own characters gives; others can't end a segmentation.
        usable = {t: i for t, i in self.ids.items() if not self.merges or len(t) == 1 or self.merge(t) == [t]}
        #: Every beginning of a piece: the piece's id + 1, or 0 where it is a beginning only.
        self.begins = {t[:n]: 0 for t in usable for n in range(1, len(t))} | {t: i + 1 for t, i in usable.items()}
        self.floor = min(self.score, default=0.0) - 10.0
        self.is_byte = np.array([k == BYTE for k in self.kind])
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def marked(self, text: str | None) -> str:
        if not text:
            return ""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        text = text.replace(" ", MARK)
        return MARK + text if self.prefix and text else text

    def merge(self, word: str) -> list[str]:
        """Merging by the best piece, leftmost first, until nothing merges; characters that start out alone may lack a piece."""
        parts = list(word)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                one = self.ids.get(parts[i] + parts[i + 1])
                if one is not None and (best is None or self.score[one] > best[0]):
                    best = (self.score[one], i)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def stays(self, u: int, t: int) -> bool:
        """Whether merging the pieces' characters together leaves just these two."""
        key = (u << 32) | t
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            a, b = self.text[u], self.text[t]
            got = self.fits[key] = self.merge(a + b) == [a, b]
        return got

    def segment(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """The pieces of each distinct word, as ids or -1 for a character without a piece. The words are walked in order, so as the branches of
        their trie; ``last``, ``start``, ``live`` and ``sums`` hold the states of the prefixes down to where the walk stands."""
        begins, fits, stays, score, merges = self.begins, self.fits, self.stays, self.score, self.merges
        before, last, start, sums = "", [-1], [0], [0.0]
        live: list[list[int]] = [[]]  # where the beginnings of pieces that go on up to here start
        for word in sorted(words):
            same, n = 0, min(len(before), len(word))
            while same < n and before[same] == word[same]:
                same += 1
            del last[same + 1 :], start[same + 1 :], sums[same + 1 :], live[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                going, best, at, value = [], -1, end - 1, None
                for a in (*live[end - 1], end - 1):
                    i = begins.get(word[a:end])
                    if i is None:
                        continue
                    going.append(a)
                    if not i:
                        continue
                    i -= 1
                    if merges:  # the first that stays is the only one
                        if best < 0:
                            u = last[a]
                            if u < 0 or (got := fits.get((u << 32) | i)) or got is None and stays(u, i):
                                best, at = i, a
                    elif value is None or sums[a] + score[i] > value:
                        best, at, value = i, a, sums[a] + score[i]
                last.append(best)
                start.append(at)
                live.append(going)
                sums.append(value if value is not None else sums[end - 1] + self.floor)
            parts, at = [], len(word)
            while at:
                parts.append(last[at])
                at = start[at]
            yield word, parts[::-1]
            before = word

    def numbers(self, word: str, parts: list[int]) -> list[int]:
        """The ids with bytes, or else the unknown piece, in place of characters without a piece."""
        if -1 not in parts:
            return parts
        got, at = [], 0
        for i in parts:
            n = len(self.text[i]) if i >= 0 else 1
            if i >= 0:
                got.append(i)
            elif self.byte:
                got.extend(self.byte[b] for b in word[at].encode("utf-8", "surrogatepass"))
            elif not got or got[-1] != self.unknown:
                got.append(self.unknown)
            at += n
        return got

    def cut(self, text: str | None) -> list[str]:
        """The marked words."""
        marked = self.marked(text)
        if self.prefix and MARK * 2 not in marked and "\0" not in marked:
            return marked.split(MARK)[1:] if marked else []  # one mark each, left out for brevity
        return [f"\0{w}" for w in _WORD.findall(marked)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.cut(t) for t in texts]
        known = self.known
        if len(known) > self.max_words:
            known.clear()
        fresh = {w for c in cut for w in c}.difference(known)
        whole = {w: w[1:] if w[:1] == "\0" else MARK + w for w in fresh}
        done = {word: array("i", self.numbers(word, parts)).tobytes() for word, parts in self.segment(set(whole.values()))}
        known.update((w, done[x]) for w, x in whole.items())
        return [np.frombuffer(b"".join(map(known.__getitem__, c)), np.int32) for c in cut]

    def decode(self, numbers: np.ndarray) -> str:
        if not len(numbers):
            return ""
        mask = self.is_byte[numbers]
        if not mask.any():
            out = "".join(map(self.text.__getitem__, numbers.tolist()))
        else:
            cuts = np.flatnonzero(np.diff(mask.astype(np.int8))) + 1
            runs = []
            for run in np.split(numbers, cuts):
                if self.is_byte[run[0]]:
                    runs.append(bytes(int(self.text[i][3:5], 16) for i in run.tolist()).decode("utf-8", "replace"))
                else:
                    runs.append("".join(self.text[i] for i in run.tolist() if self.kind[i] != CONTROL))
            out = "".join(runs)
        out = out.replace(MARK, " ")
        return out[1:] if self.prefix and out.startswith(" ") else out


def _load(spark: SparkSession, model: str, max_words: int = MAX_WORDS):
    with open(model, "rb") as f:  # the vocabulary: on the driver only
        return spark.sparkContext.broadcast(Pieces(f.read(), max_words))


def encode(docs: DataFrame, *, model: str = MODEL, max_words: int = FEWER_WORDS) -> DataFrame:
    """The documents' columns, ``piece_ids`` array<int>, ``n_pieces`` and ``round_trip``: whether decoding gives the text
    again (marks in a text come back as spaces). Columns of these names are replaced."""
    made = ("piece_ids", "n_pieces", "round_trip")
    shared, names = _load(docs.sparkSession, model, max_words), [c for c in docs.columns if c not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            got = shared.value.encode(texts)
            ends = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got)))
            back = pa.array([shared.value.decode(g) == (t or "").replace(MARK, " ") for g, t in zip(got, texts)])
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array(np.diff(ends), pa.int32()), back], names=[*names, *made])

    schema = docs.select(*names).schema.add("piece_ids", T.ArrayType(T.IntegerType())).add("n_pieces", "integer").add("round_trip", "boolean")
    return map_arrow(docs.select(*names), run, schema)


def decode(docs: DataFrame, *, model: str = MODEL, column: str = "piece_ids") -> DataFrame:
    """The columns and ``decoded``: the text that the pieces stand for."""
    shared, names = _load(docs.sparkSession, model), [c for c in docs.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.decode(np.array(x or [], np.int32)) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*names, "decoded"])

    return map_arrow(docs.select(*names), run, docs.select(*names).schema.add("decoded", "string"))


def digests(docs: DataFrame, *, model: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, pieces_sha256, round_trip): the ids as little-endian 32-bit numbers are hashed; round_trip says
    whether decoding them gives the text again (marks in a text come back as spaces)."""
    shared, id_type = _load(docs.sparkSession, model), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            got = shared.value.encode(texts)
            back = [shared.value.decode(g) == (t or "").replace(MARK, " ") for g, t in zip(got, texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(g) for g in got], pa.int64()), pa.array([hashlib.sha256(g.astype("<i4").tobytes()).hexdigest() for g in got]), pa.array(back)], names=["doc_id", "n_pieces", "pieces_sha256", "round_trip"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {id_type}, n_pieces bigint, pieces_sha256 string, round_trip boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    return digests(table(spark, sf_dir, "documents"))
