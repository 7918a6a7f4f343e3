"""Text that was decoded with the wrong character encoding: found, and restored where the bytes still tell.

Garbled sequences of all encoding pairs are computed beforehand from a rule: a letter written in one encoding and
read in another. All of them, of one character and of several, go into one multi-pattern automaton, and only matched
spans are replaced, so correct text beside them stays. A sequence of one character says little by itself, so one-byte
pairs count where they cover all foreign letters of a word. A repair counts if the repaired value is clearly more
usual, by the letter pairs of the whole column.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import or_

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_lists

# Encodings that text was written in, and those that it was wrongly read in.
READ_AS = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859-2", "iso8859-15", "iso8859-9", "koi8-r", "cp437", "cp850", "cp852", "cp866", "mac-roman")
ONE_BYTE = (*READ_AS, "iso8859-5", "iso8859-7", "mac-cyrillic", "mac-latin2")
MANY_BYTE = ("gbk", "big5", "shift_jis", "euc_jp", "euc_kr")
#: Letters and marks that names and notes are made of, as ranges of code points; beyond them, the letters of the column's sound values.
RANGES = ((0x80, 0x24F), (0x2B0, 0x36F), (0x370, 0x3FF), (0x400, 0x4FF), (0x1E00, 0x1EFF), (0x2018, 0x201F))
#: Log of how many times more usual a repaired value must be, beyond what every replaced character brings by itself.
MARGIN = 4.0

_LOST = re.compile("[\ufffd\x80-\x9f]")
_ODD = re.compile(r"[^\w\s'’ʼ.,()/&\u0300-\u036f-]")
_WORD = re.compile(r"[^ \t\r\n]+")
#: Families of sequences: UTF-8 read in one-byte encodings, lead bytes left alone, bytes that are lost; the encoding pairs follow.
UTF8, LEAD, LOST, PAIRS = 0, 1, 2, 3


def fold(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _read(c: str, written: str, read: str) -> str | None:
    """c as it looks when its bytes in one encoding are read in another; bytes without a character stay as controls."""
    try:
        raw = c.encode(written)
    except UnicodeEncodeError:
        return None
    if read in MANY_BYTE:
        try:
            return raw.decode(read)
        except UnicodeDecodeError:
            return None
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(read))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@lru_cache(2)
def _automaton(seen: frozenset[str]) -> tuple[ahocorasick.Automaton, dict[tuple[str, str], int], dict[str, dict[str, int]]]:
    """Folded garbled sequences of all encoding pairs, each with (family, letter, sequence as it is) of what it can come from.

    seen are the letters beyond ASCII of sound values. Every pair of encodings has its own family, but for UTF-8 the
    second result gives the encodings, as bits, that read a letter as a sequence, and sequences of one character of the
    one-byte pairs are one family, for which the third result gives the letters of a character and, as bits, their pairs.
    """
    found: dict[str, list[tuple[int, str, str]]] = {}
    reads: dict[tuple[str, str], int] = {}
    single: dict[str, dict[str, int]] = {}

    def add(family: int, c: str, g: str) -> None:
        if (family, c, g) not in (own := found.setdefault(fold(g), [])):
            own.append((family, c, g))

    letters = {chr(p) for low, high in RANGES for p in range(low, high + 1)} | seen
    letters |= {c for read in READ_AS for c in bytes(range(128, 256)).decode(read, "ignore")}  # for text garbled twice
    for c in sorted(letters):
        for k, read in enumerate(READ_AS):
            g = _read(c, "utf-8", read) or ""
            for s in {g, "".join(x for x in g if not "\x80" <= x <= "\x9f")}:  # controls may have been dropped on the way
                if len(s) > 1:
                    add(UTF8, c, s)
                    reads[c, s] = reads.get((c, s), 0) | 1 << k
        if fold(c) in seen and c.isalpha() and ord(c) < 0x180:  # the second byte was a control, or had no character, and was dropped
            lead, second = c.encode()
            if second < 0xA0:
                add(LEAD, c, chr(lead))
    for c in ("\ufffd", *map(chr, range(0x80, 0xA0))):
        add(LOST, c, c)
    usual = sorted(c for c in seen if c.isalpha())
    usual += [x for c in usual if len(x := c.upper()) == 1 and x != c]
    family = PAIRS
    for written, read in [(w, r) for w in ONE_BYTE for r in READ_AS] + [(w, r) for w in MANY_BYTE for r in READ_AS] + [("utf-8", r) for r in MANY_BYTE]:
        table = [(c, g) for c in usual if (g := _read(c, written, read))]
        if all(c == g for c, g in table):
            continue
        family += 1
        for c, g in table:
            if written not in ONE_BYTE:
                add(family, c, g)
            elif ord(g) > 127:  # letters that stay as they are belong to it, too: they are no sign against the pair
                add(PAIRS, "", g)
                letters_of = single.setdefault(g, {})
                letters_of[c] = letters_of.get(c, 0) | 1 << (family - PAIRS)
    a = ahocorasick.Automaton()
    for g, own in found.items():
        a.add_word(g, (len(g), own))
    a.make_automaton()
    return a, reads, single


def pairs(text: str) -> list[str]:
    t = text if text.isascii() else unicodedata.normalize("NFC", text)
    t = f" {fold(t)} "
    return [t[i : i + 2] for i in range(len(t) - 1)]


class Repairer:
    """Restores values by the letter pairs (counts over a whole column) given."""

    def __init__(self, counts: dict[str, int]):
        self.counts, self.total = counts, math.log(sum(counts.values()) + 1.0)
        self.weight = {p: math.log(n + 0.05) - self.total for p, n in counts.items()}
        self.none = math.log(0.05) - self.total
        seen: Counter = Counter()
        for p, n in counts.items():
            seen[p[0]] += n
        self.seen = {c for c, n in seen.items() if n > 1 and not unicodedata.decomposition(c).startswith("<")}
        self.automaton, self.reads, self.single = _automaton(frozenset(c for c in self.seen if ord(c) > 127))

    def score(self, text: str) -> float:
        get, none = self.weight.get, self.none
        return sum(get(p, none) for p in pairs(text))

    def _hits(self, v: str) -> dict[int, dict[int, list[tuple[int, str, str]]]]:
        """family -> place -> [(length, letter, sequence)], the longest sequences of the family at that place."""
        hits: dict[int, dict[int, list[tuple[int, str, str]]]] = {}
        for end, (n, own) in self.automaton.iter(fold(v)):
            i = end - n + 1
            for family, c, g in own:
                if family >= PAIRS and n == 1 and g != v[i]:  # cases differ
                    continue
                at = hits.setdefault(family, {})
                if i not in at or n > at[i][0][0]:
                    at[i] = [(n, c, g)]
                elif n == at[i][0][0]:
                    at[i].append((n, c, g))
        return hits

    def _usual(self, before: str, c: str) -> int:
        """How often c follows the text before, a mark counting as one with its letter."""
        if unicodedata.combining(c) and len(one := unicodedata.normalize("NFC", before[-1:] + c)) == 1:
            before, c = before[:-1] or " ", one
        return self.counts.get(fold(before[-1:] + c), 0)

    def _replace(self, v: str, at: dict[int, list[tuple[int, str, str]]], exact: bool = True) -> tuple[str, tuple]:
        """(v with the spans at these places replaced, the spans); cases follow the word.

        Of several letters the one whose sequence stands there as it is (exact), else the one more usual after what
        precedes; the other test breaks ties.
        """
        plain = [x for x in v if "A" <= x <= "Z" or "a" <= x <= "z"]
        caps = len(plain) > 1 and all(x.isupper() for x in plain)
        small = v.islower()
        out, spans, i = [], [], 0
        while i < len(v):
            if i in at:
                own = at[i]
                n, before = own[0][0], "".join(out[-2:])[-2:] or " "
                same = lambda x: x[2] == v[i : i + n]  # noqa: E731, B023
                best = max(own, key=lambda x: (same(x), self._usual(before, x[1])) if exact else (self._usual(before, x[1]), same(x)))  # noqa: B023
                c = best[1]
                if n > 1:
                    if caps:
                        c = c.upper() if len(c.upper()) == 1 else c
                    elif before[-1].isalpha() and before[-1].islower() or small and not same(best):
                        c = c.lower()
                out.append(c)
                if c != v[i : i + n]:
                    spans.append((i, i + n))
                i += n
            else:
                out.append(v[i])
                i += 1
        return "".join(out), tuple(spans)

    def _undone(self, v: str, at: dict) -> Iterator[tuple[str, tuple]]:
        """v with all its sequences of UTF-8 read in one encoding, then perhaps in another, and so on: each layer is shorter."""
        todo, known = [(v, at, ())], {v}
        while todo:
            text, at, first = todo.pop()
            seen = reduce(or_, (self.reads[x[1], x[2]] for own in at.values() for x in own), 0)
            for k in range(len(READ_AS)):
                if seen >> k & 1:
                    c, spans = self._replace(text, {i: alike for i, own in at.items() if (alike := [x for x in own if self.reads[x[1], x[2]] >> k & 1])})
                    if c not in known:
                        known.add(c)
                        if all(x in self.seen for x in fold(unicodedata.normalize("NFC", c)) if ord(x) > 127):
                            yield c, first or spans
                        todo.append((c, self._hits(c).get(UTF8, {}), first or spans))

    def _candidates(self, v: str, hits: dict) -> Iterator[tuple[str, tuple]]:
        foreign = [(m.start(), m.end(), [i for i in range(m.start(), m.end()) if ord(v[i]) > 127]) for m in _WORD.finditer(v)]
        for family, at in hits.items():
            if family == UTF8:
                yield self._replace(v, at, False)  # every place for itself
                yield from self._undone(v, at)
            elif family == LEAD:
                for lead in {own[0][2] for own in at.values()}:
                    places = [i for i, own in at.items() if own[0][2] == lead and v[i] == lead]
                    for c in {x[1] for i in places for x in at[i]}:
                        yield self._replace(v, {i: [(1, c, lead)] for i in places})
            elif family == PAIRS:
                for a, b, odd in foreign:
                    yield from self._words(v, [i for i in odd if i in at] if set(odd) <= at.keys() else [])
            elif family > PAIRS:
                kept: dict = {}
                for a, b, odd in foreign:  # whole words only: what the pair doesn't cover was not read that way
                    inside = {i: at[i] for i in range(a, b) if i in at}
                    if inside and {j for i, own in inside.items() for j in range(i, i + own[0][0])}.issuperset(odd):
                        kept |= inside
                if kept:
                    yield self._replace(v, kept)

    def _words(self, v: str, odd: list[int]) -> Iterator[tuple[str, tuple]]:
        """v with the foreign letters of a word, at these places, read back by every one-byte pair that has all of them."""
        ways = {"": -1} if odd else {}
        for i in odd:
            own = self.single[v[i]].items()
            ways = {w + c: m for w, old in ways.items() for c, new in own if (m := old & new)}
        for w in ways:
            changed = tuple((i, i + 1) for i, c in zip(odd, w) if c != v[i])
            if changed:
                out = list(v)
                for i, c in zip(odd, w):
                    out[i] = c
                yield "".join(out), changed

    def repair(self, v: str) -> tuple[bool, str | None, str]:
        """(garbled, restored, spans): restored is None where the original can't be told; spans are places in v as `from-to`.

        Repaired as long as a repair makes the value clearly more usual, so text may have been garbled any number of times.
        """
        now, first = v, ()
        hits = self._hits(v)
        lost = sorted(hits.get(LOST, ()))
        while hits:
            old = self.score(now)
            best, gain, where = now, (0.0, 0), ()
            for c, spans in sorted(set(self._candidates(now, hits))):
                # equal but for capitals: whole words in one case or with a capital first are more usual
                if c != now and (g := (round(self.score(c) - old - MARGIN, 6), c.istitle() or c.isupper() or c.islower())) > gain and g[0] > 0:
                    best, gain, where = c, g, spans
            if best == now:
                break
            now, first = best, first or where
            hits = self._hits(now)
        spans = ",".join(f"{a}-{b}" for a, b in sorted({*first, *((i, i + 1) for i in lost if not any(a <= i < b for a, b in first))}))
        if now == v:
            return bool(lost), None, spans
        return True, None if _LOST.search(now) or (_ODD.search(now) and lost) else now, spans


def letter_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(pair, n): counts of letter pairs of all values that hold nothing but letters, marks and name punctuation; equal values are read once."""

    def count(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        n: Counter = Counter()
        for b in batches:
            for v, times in zip(b["v"], b["times"]):
                for p in pairs(v):
                    n[p] += times
        yield {"pair": list(n), "n": list(n.values())}

    values = df.select(F.explode(F.array(*columns)).alias("v")).filter(F.col("v").rlike(r"\A[\p{L}\p{M} '’.-]+\z"))
    return map_lists(values.groupBy("v").agg(F.count(F.lit(1)).alias("times")), count, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


#: Most letter pairs that are shipped to the executors; 32 bytes each on the wire. Alphabets bound them (1,119 on sf0.1), Han names by their square.
MOST_PAIRS = 4_000_000


def shipped_pairs(df: DataFrame, columns: list[str]):
    """The letter pairs as a broadcast, its size checked: an error beyond MOST_PAIRS rather than a driver that runs out of memory."""
    spark = df.sparkSession
    rows = letter_pairs(df, columns).limit(MOST_PAIRS + 1)
    counts = {r.pair: r.n for r in rows.toLocalIterator()}
    if len(counts) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} letter pairs: these columns hold no names")
    return spark.sparkContext.broadcast(counts)


def garbled_values(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, field_name, value, restored, spans) of every value that went through a wrong decoding.

    restored is null where bytes were lost; spans are the garbled places of value, code points `from-to`. Nulls, empty
    texts and plain ASCII values are never cases. Statistics cover all rows; they are letter pairs, whose number is
    bounded by the alphabets in use and not by the rows. Repeated rows come out as often as they come in.
    """
    shared = shipped_pairs(df, columns)
    cell = lambda c: F.struct(F.lit(c).alias("field_name"), F.col(f"`{c}`").cast("string").alias("value"))
    long = df.select(F.col(id_col).alias("id"), F.explode(F.array(*[cell(c) for c in columns])).alias("x")).select("id", "x.*").filter(F.col("value").rlike(r"[^\x00-\x7F]"))
    names = ("id", "field_name", "value", "restored", "spans")

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        repair = lru_cache(50_000)(Repairer(shared.value).repair)
        for b in batches:
            rows = [(i, f, v, *r[1:]) for i, f, v in zip(b["id"], b["field_name"], b["value"]) if (r := repair(v))[0]]
            yield dict(zip(names, zip(*rows))) if rows else {k: [] for k in names}

    return map_lists(long, run, "id bigint, field_name string, value string, restored string, spans string")
