"""Evaluation texts inside training text, found with a generalised suffix automaton over words."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_rows

#: Words in a row that make a leak, and words of items that one automaton takes (about 1 KB each); more items mean more passes.
MIN_WORDS = 13
BLOCK_WORDS = 200_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Unbroken runs of letters or digits, case folded."""
    return _WORD.findall(text.casefold())


class SuffixAutomaton:
    """All word runs of a set of texts. Each state knows, through its suffix links, the texts its runs come from."""

    def __init__(self, least: int):
        self.least = least
        self.vocab: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.texts: list[set] = [set()]

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.texts.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """q reached from p by w holds longer runs, too: part the runs that end here from them."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def add(self, name: int, text: str) -> None:
        last = 0
        for word in words(text):
            w = self.vocab.setdefault(word, len(self.vocab))
            q = self.next[last].get(w)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
            else:
                new, p = self._state(self.length[last] + 1, {}, -1), last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                if p < 0:
                    self.link[new] = 0
                else:
                    q = self.next[p][w]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
                last = new
            self.texts[last].add(name)

    def close(self) -> SuffixAutomaton:
        """Pass the texts up the links: a state then has all texts that hold its runs."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for v in reversed(order):
            if self.link[v] > 0:
                self.texts[self.link[v]] |= self.texts[v]
        return self

    def runs(self, doc: list[str]) -> Iterator[tuple[int, int, int]]:
        """(end word, longest matching length, state) at every word where the last `least` words match."""
        get, n, k, least = self.vocab.get, len(doc), self.least - 1, self.least
        while k < n:
            if get(doc[k]) is None:  # every window of `least` words holds one of these words
                k += least
                continue
            a = b = k
            while a > 0 and get(doc[a - 1]) is not None and k - a < least:
                a -= 1
            while b + 1 < n and get(doc[b + 1]) is not None:
                b += 1
            if b - a + 1 >= least:
                yield from self._walk(doc, a, b)
            k = b + 1 + least

    def _walk(self, doc: list[str], a: int, b: int) -> Iterator[tuple[int, int, int]]:
        state, length = 0, 0
        for i in range(a, b + 1):
            w = self.vocab[doc[i]]
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            if length >= self.least:
                yield i, length, state


def _blocks(items: DataFrame, item_id: str, text: str, least: int) -> Iterator[SuffixAutomaton]:
    a, held = SuffixAutomaton(least), 0
    for name, t in items.select(item_id, text).filter(F.col(text).isNotNull() & F.col(item_id).isNotNull()).toLocalIterator():
        n = len(words(t))
        if held and held + n > BLOCK_WORDS:
            yield a.close()
            a, held = SuffixAutomaton(least), 0
        a.add(name, t)
        held += n
    if held:
        yield a.close()


def _per_block(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, least: int, one, schema: str) -> DataFrame:
    spark, out = docs.sparkSession, None
    for automaton in _blocks(items, item_id, item_text, least):
        shared = spark.sparkContext.broadcast(automaton)
        part = map_rows(docs, lambda i, t, shared=shared: one(shared.value, i, t), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, longest) for every document that holds at least `least` consecutive words of an item.

    longest is the longest run of words of the item found in the document. Whole texts are read, every copy of a
    document is reported and so is every item of equal text. Null or wordless texts leak nothing; items shorter than
    `least` words cannot leak. The automaton is broadcast: items go into blocks of at most BLOCK_WORDS words, each one
    pass over the documents.
    """

    def one(a, doc, t):
        if not t:
            return
        best: dict[int, int] = {}
        for _, length, state in a.runs(words(t)):
            while length >= a.least:  # shorter suffixes of the run may stand in further items
                for item in a.texts[state]:
                    if best.get(item, 0) < length:
                        best[item] = length
                state = a.link[state]
                length = a.length[state]
        yield from ((doc, item, n) for item, n in best.items())

    schema = "doc_id bigint, item_id bigint, longest int"
    return _per_block(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items, item_id, item_text, least, one, schema)


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = MIN_WORDS, coverage: float = 0.5) -> DataFrame:
    """(doc_id, clean_text, n_spans, removed_words, dropped) of every document that leaks.

    Maximal leaking spans are cut out of the text; where they hold more than the share `coverage` of its words the
    document counts as dropped and clean_text is empty. Repeated rows count once. Every block of items is a pass over
    the documents that finds spans; only the leaking documents, with their texts, are gathered to join the spans of all
    blocks, so any number of items gives what one block would.
    """

    def find(a, doc, t):
        if not t:
            return
        spans = merged([end - length + 1, end] for end, length, _ in a.runs(words(t)))
        if spans:
            yield doc, t, [x for s in spans for x in s]

    def cut(doc, t, found):
        spans = merged(sorted([a, b] for own in found for a, b in zip(own[::2], own[1::2])))
        at = [m.span() for m in _WORD.finditer(t)]
        gone = sum(y - x + 1 for x, y in spans)
        if gone > coverage * len(at):
            yield doc, "", len(spans), gone, True
            return
        parts, last = [], 0
        for x, y in spans:
            parts.append(t[last : at[x][0]])
            last = at[y][1]
        yield doc, "".join(parts) + t[last:], len(spans), gone, False

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = _per_block(texts, items, item_id, item_text, least, find, "doc_id bigint, text string, spans array<int>")
    whole = found.groupBy("doc_id", "text").agg(F.collect_set("spans").alias("found"))
    return map_rows(whole, cut, "doc_id bigint, clean_text string, n_spans int, removed_words int, dropped boolean")


def merged(spans) -> list[list[int]]:
    """Spans in order of their ends or starts, those that meet or overlap joined."""
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1] + 1:
            out[-1] = [min(out[-1][0], a), max(out[-1][1], b)]
            while len(out) > 1 and out[-1][0] <= out[-2][1] + 1:
                last = out.pop()
                out[-1] = [min(out[-1][0], last[0]), max(out[-1][1], last[1])]
        else:
            out.append([a, b])
    return out
