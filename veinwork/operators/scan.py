"""Which terms and fragments of a block of questions many texts hold, a slice of texts at a time.

All that is looked for goes into one trie, kept by length: a level has the substrings of that length, each named by the one a character shorter and its last character. A slice of texts is one array of characters, and all places of it
go down the trie at once, a level a step; those that fall out are left behind. Hits become a table (text, term) of bits, and coverages are grouped sums over the questions' postings of the bits that are set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Lengths of fragments, and the length from which a question's parts count.
LEAST, MOST, PARTS_FROM = 4, 12, 6
#: Entries that the levels' tables have together; levels beyond are searched. Bytes that a level's bits of questions may have, where nodes have ``CROWDED`` questions or more on the whole.
TABLES, BITS, CROWDED = 1 << 24, 1 << 25, 1.5
#: No text of Spark's can hold it.
GAP = "\ud800"


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' characters in one array, each text followed by a gap, and the place of each text's first."""
    n = np.array([len(t) + 1 for t in texts], np.int64)
    data = np.frombuffer((GAP.join(texts) + GAP).encode("utf-32-le", "surrogatepass"), np.uint32) if texts else np.zeros(0, np.uint32)
    return data, np.cumsum(n) - n


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places first .. first + n - 1 of each."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Trie:
    """``terms``, and of each of ``asked`` all parts of ``LEAST`` to ``MOST`` characters; one of under ``PARTS_FROM`` counts as a whole only."""

    def __init__(self, terms: list[str], asked: list[str] = ()):
        self.upper = np.array([min(MOST, len(c)) if len(c) >= LEAST else 0 for c in asked], np.int64)
        data, first = _characters([*terms, *asked])
        known = np.unique(data[data != ord(GAP)])
        self.top = int(known[-1]) + 1 if len(known) else 0
        self.code = np.zeros(self.top + 1, np.int64)  # 0: in none of the words
        self.code[known] = np.arange(1, len(known) + 1)
        self.width = len(known) + 1
        data = self.code[np.minimum(data, self.top)]
        size = np.array([len(t) for t in terms] + [len(c) for c in asked], np.int64)
        parts = np.where(size[len(terms) :] >= PARTS_FROM, size[len(terms) :], np.minimum(1, self.upper))  # places that parts begin at
        of = np.repeat(np.arange(len(asked)), parts)
        begin = _ranges(first[len(terms) :], parts)
        at = np.concatenate([first[: len(terms)], begin])
        left = np.concatenate([size[: len(terms)], np.minimum(self.upper[of], first[len(terms) :][of] + size[len(terms) :][of] - begin)])
        least = np.where(size[len(terms) :] >= PARTS_FROM, LEAST, size[len(terms) :])  # from this length on a part counts
        who = np.concatenate([np.arange(len(terms)), of])
        is_term = np.arange(len(at)) < len(terms)
        node, self.levels = np.zeros(len(at), np.int64), []
        for d in range(1, int(left.max(initial=0)) + 1):
            on = left >= d
            at, left, who, is_term, node = at[on], left[on], who[on], is_term[on], node[on]
            keys, node = np.unique(node * self.width + data[at + d - 1], return_inverse=True)
            term = np.full(len(keys), -1)
            ends = is_term & (left == d)
            term[node[ends]] = who[ends]
            part = ~is_term & (d >= (least[np.where(is_term, 0, who)] if len(asked) else 0))
            pairs = np.unique(node[part] * max(1, len(asked)) + who[part])
            owned = np.bincount(pairs // max(1, len(asked)), minlength=len(keys))
            self.levels.append((keys, term, owned, np.cumsum(owned) - owned, pairs % max(1, len(asked))))
        self.tables = self.sets = None

    def __getstate__(self):
        return self.__dict__ | {"tables": None, "sets": None}

    def _ready(self) -> None:
        self.tables, self.sets, room, before = [], [], TABLES, 1
        for keys, _, owned, _, owner in self.levels:
            size = before * self.width
            got = None
            if size <= room:
                room -= size
                got = np.full(size, -1, np.int32)
                got[keys] = np.arange(len(keys))
            self.tables.append(got)
            bits = None
            words = -(-len(self.upper) // 64)
            if len(owner) >= CROWDED * len(keys) and len(keys) * words * 8 <= BITS:  # the questions of a node as bits
                bits = np.zeros((len(keys), words * 64), bool)
                bits[np.repeat(np.arange(len(keys)), owned), owner] = True
                bits = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
            self.sets.append(bits)
            before = len(keys)

    def walk(self, data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, nodes) of all substrings of the characters that are on a level."""
        if self.tables is None:
            self._ready()
        code = self.code[np.minimum(data, self.top)]
        code = np.concatenate([code, np.zeros(len(self.levels) + 1, np.int64)])
        at, node = np.flatnonzero(code), 0
        for d, ((keys, *_), table) in enumerate(zip(self.levels, self.tables), 1):
            key = node * self.width + code[at + d - 1]
            if table is not None:
                node = table[key].astype(np.int64)
                on = np.flatnonzero(node >= 0)
            else:
                node = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                on = np.flatnonzero(keys[node] == key)
            at, node = at[on], node[on]
            if not len(at):
                return
            yield d, at, node


class Asked:
    """One block of questions: terms, phrases, their weights and what else is looked for."""

    def __init__(self, ids: list, terms: list[list[str]], phrases: list[list[str]], compact: list[str], articles: list[str]):
        self.ids, self.articles = ids, articles
        self.all = sorted({t for ts in (*terms, *phrases) for t in ts})
        place = {t: i for i, t in enumerate(self.all)}
        self.terms, self.phrases = self._posted(terms, place), self._posted(phrases, place)
        self.words, self.trie = Trie(self.all), Trie(self.all, compact)
        self.longest = max(map(len, self.all), default=0)
        self.idf = np.ones(len(self.all))

    @staticmethod
    def _posted(lists: list[list[str]], place: dict[str, int]) -> tuple[np.ndarray, ...]:
        """By term: its questions."""
        term = np.array([place[t] for ts in lists for t in ts], np.int64)
        who = np.repeat(np.arange(len(lists)), [len(ts) for ts in lists])
        order = np.argsort(term, kind="stable")
        n = np.bincount(term, minlength=len(place))
        return term[order], who[order], np.cumsum(n) - n, n

    def weigh(self, df: dict[int, int], n: int) -> None:
        self.idf = np.array([math.log((n + 1.0) / (df.get(i, 0) + 0.5)) + 1.0 for i in range(len(self.all))])

    def coverage(self, which: tuple[np.ndarray, ...], hit: np.ndarray) -> np.ndarray:
        """(text, question): the share of the weight of a question's terms that a row of ``hit`` has."""
        terms, who, first, n = which
        total = np.bincount(who, weights=self.idf[terms], minlength=len(self.ids))
        text, term = np.divmod(np.flatnonzero(hit), max(1, hit.shape[1]))
        many = n[term]
        at = _ranges(first[term], many)
        got = np.bincount(np.repeat(text * len(self.ids), many) + who[at], weights=np.repeat(self.idf[term], many), minlength=len(hit) * len(self.ids)).reshape(len(hit), len(self.ids))
        return np.divide(got, total, out=np.zeros(got.shape), where=total > 0)

    def hits(self, texts: list[str]) -> np.ndarray:
        """(text, term): whether the text holds the term. What several texts have in common is read once."""
        of = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        return self.read(list(of), np.zeros(len(of), np.int64), self.words)[0][0][[of[t] for t in texts]]

    def read(self, texts: list[str], skip: np.ndarray, trie: Trie) -> tuple[np.ndarray, np.ndarray]:
        """Of each text behind its first ``skip`` characters the terms, and besides those that begin before; and (text, question) the length of the longest part of the question behind there."""
        data, first = _characters(texts)
        text = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(data))))
        hit = np.zeros((2, len(texts), len(self.all)), bool)
        longest = np.zeros((len(texts), len(trie.upper)), np.int8)
        bits, spots, behind = hit.reshape(-1), longest.reshape(-1), first + skip
        early = (np.arange(len(data)) < behind[text]) if skip.any() else None
        base = text * len(self.all) + (0 if early is None else early * (len(texts) * len(self.all)))
        for d, at, node in trie.walk(data):
            _, term, owned, begin, owner = trie.levels[d - 1]
            found = term[node]
            on = np.flatnonzero(found >= 0)
            bits[base[at[on]] + found[on]] = True
            if len(owner) and early is not None:
                on = np.flatnonzero(~early[at])
                at, node = at[on], node[on]
            if not len(owner) or not len(at):
                continue
            if (bits_of := trie.sets[d - 1]) is not None:
                of = text[at]
                new = np.flatnonzero(np.diff(of, prepend=-1))
                some = np.unpackbits(np.bitwise_or.reduceat(bits_of[node], new).view(np.uint8), axis=1, bitorder="little")[:, : longest.shape[1]]
                rows = longest[of[new]]
                rows[some > 0] = d
                longest[of[new]] = rows
            else:
                on = np.flatnonzero(owned[node])
                n = owned[node[on]]
                spots[np.repeat(text[at[on]] * longest.shape[1], n) + owner[_ranges(begin[node[on]], n)]] = d
        return hit, longest
