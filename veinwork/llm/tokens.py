"""Edit-aware token counts.

A text is cut into pre-tokens by the tokenizer's pattern, each is encoded on its own, and the counts are kept in a segment tree: its leaves are short runs of
pre-tokens with their text, its inner nodes hold the sums of characters and tokens below. An edit is found by descending the tree, and only what it touches is cut and encoded again:
from the pre-token that could have looked at the edited characters, up to the first new boundary that is an old one behind the edit, since from there on the pattern, which looks back nowhere,
does what it did before. Then the sums on the paths to the root are set anew.

The pattern looks at most one character beyond the end of a match before it decides, so a pre-token that ends two characters or more before the edit stays.

Edits are made from the front; those between which no old boundary holds are one region. Time grows with the text and the edits, also where edits let one pre-token grow long. ``keep_trees`` gives the trees as a table, ``edit_trees`` counts later versions from it.

Defined results: null and empty texts have no tokens. Edits are (start, end, text) in code points of the text as it was, in order and without overlap, else an error is raised; positions beyond the
text count as its end; null edits are none, a null replacement is empty; an empty table gives an empty one. Each row is counted alone: repeated rows and null ids stay. Columns other than doc_id, text and edits are ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from veinwork.llm.scratch import map_arrow, table
from veinwork.llm.words import slices

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens of a leaf; how many pre-tokens an encoder remembers, and how long they may be.
LEAF, MAX_WORDS, MAX_CHARS = 64, 500_000, 64


class Encoder:
    """Counts the tokens of single pre-tokens; remembers a bounded number of them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.pattern = ranks, pattern
        self._ready()

    def _ready(self) -> None:
        import tiktoken

        self.cut = regex.compile(self.pattern)
        self.coder = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def __getstate__(self):
        return self.ranks, self.pattern

    def __setstate__(self, state):
        self.ranks, self.pattern = state
        self._ready()

    def pieces(self, text: str) -> list[str]:
        return self.cut.findall(text)

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > MAX_WORDS:
            known.clear()
        once: dict[str, int] = {}
        for p in set(pieces).difference(known):
            (known if len(p) <= MAX_CHARS else once)[p] = len(self.coder.encode_ordinary(p))
        return [once[p] if len(p) > MAX_CHARS else known[p] for p in pieces]


class Tree:
    """The segment tree over one text."""

    def __init__(self, text: str, encoder: Encoder, leaf: int = LEAF):
        self.encoder, self.leaf, self.encoded = encoder, leaf, 0
        self._build(encoder.pieces(text))

    def _build(self, pieces: list[str], counts: list[int] | None = None) -> None:
        n = max(1, -(-len(pieces) // self.leaf))
        self.most = max(8 * self.leaf, math.isqrt(len(pieces)))  # a leaf's size at which all are cut anew
        self.size = 1 << (n - 1).bit_length()
        self.pieces = [pieces[i * self.leaf : (i + 1) * self.leaf] for i in range(n)]
        counts = self.encoder.counts(pieces) if counts is None else counts
        self.counts = [counts[i * self.leaf : (i + 1) * self.leaf] for i in range(n)]
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i in range(n):
            self.chars[self.size + i] = sum(map(len, self.pieces[i]))
            self.tokens[self.size + i] = sum(self.counts[i])
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @classmethod
    def kept(cls, leaves: list[dict], encoder: Encoder, leaf: int = LEAF) -> Tree:
        """The tree of a table's leaves; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.encoder, tree.leaf, tree.encoded = encoder, leaf, 0
        pieces, counts = [], []
        for x in leaves:
            at = 0
            for n in x["chars"]:
                pieces.append(x["text"][at : at + n])
                at += n
            counts += x["tokens"]
        tree._build(pieces, counts)
        return tree

    def leaves(self) -> list[dict]:
        """The leaves as a table keeps them: text, and each pre-token's characters and tokens."""
        return [{"text": "".join(p), "chars": list(map(len, p)), "tokens": c} for p, c in zip(self.pieces, self.counts) if p]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join("".join(p) for p in self.pieces)

    def _find(self, at: int) -> tuple[int, int, int]:
        """The leaf, the pre-token in it and its start, of the character ``at``; at the end, behind the last."""
        node, start = 1, 0
        if at >= self.chars[1]:
            last = len(self.pieces) - 1
            return last, len(self.pieces[last]), self.chars[1]
        while node < self.size:
            node *= 2
            if at >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        leaf = node - self.size
        for i, p in enumerate(self.pieces[leaf]):
            if at < start + len(p):
                return leaf, i, start
            start += len(p)
        raise AssertionError("the sums are wrong")

    def _set(self, leaf: int, pieces: list[str], counts: list[int]) -> None:
        self.pieces[leaf], self.counts[leaf] = pieces, counts
        node = self.size + leaf
        self.chars[node], self.tokens[node] = sum(map(len, pieces)), sum(counts)
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _next(self, leaf: int) -> int | None:
        """The first leaf behind this one that holds characters, found by the sums: empty leaves cost nothing."""
        node = self.size + leaf
        while node > 1:
            if node % 2 == 0 and self.chars[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node + (not self.chars[2 * node])
                return node - self.size
            node //= 2
        return None

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from ``start`` to ``end`` by ``new``."""
        self.apply([(start, end, new)])

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Makes edits, which give places in the text as it is now, in order and without overlap. Edits between which no old boundary holds are one region, cut once."""
        edits, moved, size = in_order(edits), 0, self.chars[1]
        edits = [(min(a, size), min(b, size), new) for a, b, new in edits]
        done = 0
        while done < len(edits):
            start = edits[done][0] + moved
            leaf, first, begin = self._find(max(0, start - 2))
            # the old pre-tokens from there on, leaf by leaf as far as they are needed: all up to the edit's end, then in steps that double
            touched, old, at, wanted, upto = [leaf], list(self.pieces[leaf][first:]), begin + sum(map(len, self.pieces[leaf][first:])), edits[done][1] + moved, done + 1
            following = self._next(leaf)
            while True:
                while True:
                    while following is not None and at < wanted:
                        touched.append(following)
                        old += self.pieces[following]
                        at += self.chars[self.size + following]
                        following = self._next(following)
                    while upto < len(edits) and edits[upto][0] + moved <= at:
                        wanted = max(wanted, edits[upto][1] + moved)
                        upto += 1
                    if following is None or at >= wanted:
                        break
                found = self._recut(old, [(a + moved - begin, b + moved - begin, new) for a, b, new in edits[done:upto]], following is None)
                if found:
                    break
                wanted = at + max(1, at - begin)
            pieces, keep, made = found
            self.encoded += len(pieces)
            for i, k in enumerate(touched):  # old pre-tokens before the boundary go, the others stay in their leaves
                skip = first if i == 0 else 0
                gone = min(keep, len(self.pieces[k]) - skip)
                keep -= gone
                rest, counts = self.pieces[k][skip + gone :], self.counts[k][skip + gone :]
                if i == 0:
                    rest, counts = self.pieces[k][:first] + pieces + rest, self.counts[k][:first] + self.encoder.counts(pieces) + counts
                if gone or i == 0:
                    self._set(k, rest, counts)
            if len(self.pieces[leaf]) > self.most:
                self._build([p for ps in self.pieces for p in ps], [c for cs in self.counts for c in cs])
            moved += sum(len(new) - (b - a) for a, b, new in edits[done : done + made])
            done += made

    def _recut(self, old: list[str], edits: list[tuple[int, int, str]], whole: bool) -> tuple[list[str], int, int] | None:
        """The new pre-tokens up to the first boundary behind an edit that is an old one too, how many old ones they replace, and how many edits they hold; None if the text given (all there is, if ``whole``) ends before."""
        joined, parts, kept, at, i, shift = "".join(old), [], {}, 0, 0, 0
        for k, (start, end, new) in enumerate(edits):
            parts += joined[edits[k - 1][1] if k else 0 : start], new
            shift += len(new) - (end - start)
            until = edits[k + 1][0] if k + 1 < len(edits) else len(joined)
            while at < end and i < len(old):
                at += len(old[i])
                i += 1
            while end <= at <= until:
                kept[at + shift] = i, k + 1
                if i == len(old):
                    break
                at += len(old[i])
                i += 1
        buffer = "".join((*parts, joined[edits[-1][1] :]))
        if whole:
            kept[len(buffer)] = len(old), len(edits)
        pieces = []
        for p in self.encoder.cut.finditer(buffer):
            if not whole and p.end() + 1 >= len(buffer):
                return None
            pieces.append(p[0])
            if p.end() in kept:
                return pieces, *kept[p.end()]
        return ([], len(old), len(edits)) if whole and not buffer else None


def in_order(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The edits, if they are in order and don't overlap; an error if not. Positions count from 0, and an end before its start is the start."""
    out, last = [], 0
    for start, end, new in edits:
        start = max(0, start or 0)
        end = max(start, end or 0)
        if start < last:
            raise ValueError(f"edits overlap or are out of order at {start}")
        out.append((start, end, new))
        last = end
    return out


def recount(text: str | None, edits: list[tuple[int, int, str]], encoder: Encoder) -> tuple[int, int, int]:
    """Tokens before and after the edits, and how many pre-tokens were encoded again."""
    tree = Tree(text or "", encoder)
    before = tree.total
    tree.apply(edits)
    return before, tree.total, tree.encoded


_NUMBER = regex.compile(r"[0-9]{6,}")


def cleaning_edits(text: str | None) -> list[tuple[int, int, str]]:
    """What cleaning does to a text: lines that came before go, with their line feed, and numbers of six digits or more are masked."""
    out, seen, at = [], set(), 0
    for line in (text or "").split("\n"):
        end = at + len(line)
        if line.strip() and line in seen:
            out.append((max(0, at - 1), end, ""))
        else:
            seen.add(line)
            out += [(at + m.start(), at + m.end(), "<NUM>") for m in _NUMBER.finditer(line)]
        at = end + 1
    return out


def _encoder(ranks: str) -> Encoder:
    with open(ranks, "rb") as f:  # the vocabulary: on the driver only
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def _edits(column: pa.Array) -> list[list[tuple[int, int, str]]]:
    return [[(e["start"], e["end"], e["text"] or "") for e in x or [] if e] for x in column.to_pylist()]


def count_tokens(docs: DataFrame, *, ranks: str = RANKS, edits: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_edited, n_reencoded): ``edits`` names a column array<struct<start, end, text>>; without it, the cleaning edits are made."""
    shared, id_type = docs.sparkSession.sparkContext.broadcast(_encoder(ranks)), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            made = _edits(batch.column(edits)) if edits else [cleaning_edits(t) for t in texts]
            got = [recount(t, e, shared.value) for t, e in zip(texts, made)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([len(e) for e in made], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], names=["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_reencoded"])

    return map_arrow(docs.select("doc_id", "text", *[edits] * bool(edits)), run, f"doc_id {id_type}, n_tokens bigint, n_edits bigint, n_tokens_edited bigint, n_reencoded bigint")


_LEAVES = pa.list_(pa.struct([("text", pa.string()), ("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))]))
_LEAVES_SQL = "leaves array<struct<text: string, chars: array<int>, tokens: array<int>>>"


def keep_trees(docs: DataFrame, *, ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens, leaves): each document's tree as its leaves, to be written as a table from which later versions are counted. A narrow pass; null and empty texts have no leaves."""
    shared, id_type = docs.sparkSession.sparkContext.broadcast(_encoder(ranks)), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            trees = [Tree(t or "", shared.value) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.total for t in trees], pa.int64()), pa.array([t.leaves() for t in trees], _LEAVES)], names=["doc_id", "n_tokens", "leaves"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {id_type}, n_tokens bigint, {_LEAVES_SQL}")


def edit_trees(trees: DataFrame, edits: str, *, ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens_before, n_edits, n_tokens, n_reencoded, leaves): the next version of ``keep_trees``' rows, joined with a column of edits; only what the edits touch is encoded, a document at a time."""
    shared, id_type = trees.sparkSession.sparkContext.broadcast(_encoder(ranks)), trees.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                made = _edits(row.column(edits))[0]
                tree = Tree.kept(row.column("leaves")[0].as_py() or [], shared.value)
                before = tree.total
                tree.apply(made)
                numbers = [pa.array([n], pa.int64()) for n in (before, len(made), tree.total, tree.encoded)]
                yield pa.RecordBatch.from_arrays([row.column("doc_id"), *numbers, pa.array([tree.leaves()], _LEAVES)], names=["doc_id", "n_tokens_before", "n_edits", "n_tokens", "n_reencoded", "leaves"])

    return map_arrow(trees.select("doc_id", "leaves", edits), run, f"doc_id {id_type}, n_tokens_before bigint, n_edits bigint, n_tokens bigint, n_reencoded bigint, {_LEAVES_SQL}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, before and after cleaning."""
    return count_tokens(table(spark, sf_dir, "documents"))
