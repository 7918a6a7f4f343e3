"""Sentence boundaries across languages and scripts, by a pushdown automaton.

A text falls into blocks (headings, list items, paragraphs), each of which ends a sentence. Within a block the
automaton reads quotes, brackets and terminators only; its stack holds the open quotes and brackets, inside of which
nothing ends a sentence. At depth zero a terminator of the script ends one, unless an abbreviation trie, read
backwards from the period, or what follows says otherwise.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_rows

# Abbreviations that go on after their period, those that can also end a sentence, and those before numbers only.
ON = """dr prof mr mrs ms messrs st mt ft rev hon gen col capt lt sgt sr sra dra srta dott sig sigg mme mlle mm me hr fr fig figs sec sect ch chap vol vols pp pg ed eds cf vs viz approx ca circa e.g i.e eg ie resp
incl excl est al et.al op.cit ibid abb abs kap bd bsp bzw ggf evtl usf vgl z.b d.h u.a s.o s.u i.d.r o.ä nr tel str hrsg p.ej ej pág págs cap art núm av avda p.ex ex janv févr avr juill sept oct nov déc éd
ad.es es pag pagg cap n.b np por rys tzw tj ul im zob wg см рис табл стр ул просп пл обл руб тыс млн млрд т.е т.к т.н напр проф акад гл ср π.χ κ δρ σελ βλ αρ डॉ श्री प्रो पं""".split()
MAY_END = "a.m p.m am pm etc usw ltd inc co corp bros jr u.s u.k m.in itp itd т.д т.п и.др др г гг r w к.λπ κ.λπ κτλ ecc ss".split()
BEFORE_NUMBER = "no nos p s n nr art §".split()
ORDINAL_AFTER = set("am des der dem den im zum vom beim das die".split())
MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
OPEN = {"“": "”", "„": "“", "«": "»", "‘": "’", "‚": "‘", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "［": "］", "{": "}", "《": "》", "〈": "〉", "【": "】", "〔": "〕", '"': '"'}
BRACKETS = "(（[［{【〔"
CLOSE = "”“»’‘」』)）]］}》〉】〕\""
FULL = "。！？｡।॥۔؟։።።"
ENDS = ".!?…‼⁇⁈⁉" + FULL

_EVENT = re.compile("[" + re.escape("".join(OPEN) + CLOSE + ENDS + ";;") + "]")
_RUN = re.compile("[" + re.escape(ENDS) + r"]+(?:[   ][!?]+)*")
_LINE = re.compile(r"([^\r\n]*)(\r\n|\r|\n|\Z)")
_HEADING = re.compile(r"﻿?[ \t]*(?:#{1,6}|={1,6})[ \t]+(?=\S)")
_BULLET = re.compile(r"﻿?[ \t]*[*•‣◦·–+-][ \t　]+(?=\S)")
_NUMBER = re.compile(r"﻿?[ \t]*(?:\d{1,3}[.)]|[a-z]\))[ \t]+(?=\S)")
_THAI = re.compile("[ก-๛]")
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
_GAP = re.compile(r"(?<=\S)\s+(?=\S)")
_LATIN = re.compile("[0-9A-Za-zÀ-ɏ๐-๙]")
_CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿]")
_SKIP = re.compile(r"[\s\"“”„«»‘’‚「『(（\[{《【¿¡*•#-]*")
_TOKEN = re.compile(r"\S+")


def _trie(entries: list[str], kind: str, into: dict) -> None:
    for e in entries:
        node = into
        for c in reversed(e):
            node = node.setdefault(c, {})
        node["kind"] = kind


@lru_cache(1)
def trie() -> dict:
    root: dict = {}
    _trie(ON, "on", root)
    _trie(MAY_END, "may", root)
    _trie(BEFORE_NUMBER, "number", root)
    return root


def _wordy(c: str) -> bool:
    return c.isalnum() or c == "_" or "̀" <= c <= "ͯ" or "ऺ" <= c <= "ॏ"


def abbreviation(text: str, at: int, start: int) -> tuple[str, int]:
    """(kind, where it begins) of the longest abbreviation that the period at `at` ends; spaces inside don't count."""
    node, i, kind, begin = trie(), at - 1, "", at
    while i >= start:
        c = text[i].lower()
        if c.isspace():
            # a blank may stand after an inner period: z. B.
            if i > start and "." in node:
                i -= 1
                continue
            break
        node = node.get(c)
        if node is None:
            break
        if "kind" in node and (i == start or not (_wordy(text[i - 1]) or text[i - 1] == "." and i > start + 1 and _wordy(text[i - 2]))):
            kind, begin = node["kind"], i
        i -= 1
    return kind, begin


def blocks(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end of the leading marks, end) of headings, list items and paragraphs, outer blanks left out of the end."""
    start = mark = end = -1
    listed = False
    for m in _LINE.finditer(text):
        a, b = m.span(1)
        line = m[1]
        if not line.strip().strip("﻿"):
            if start >= 0:
                yield start, mark, end
            start, listed = -1, False
        else:
            head = _HEADING.match(line)
            item = None if head else _BULLET.match(line) or ((start < 0 or listed) and _NUMBER.match(line) or None)
            if head or item:
                if start >= 0:
                    yield start, mark, end
                start, mark, listed = a, a + (head or item).end(), bool(item)
            elif start < 0:
                start, mark = a, a
            end = a + len(line.rstrip())
            if head:
                yield start, mark, end
                start, listed = -1, False
        if m.end() >= len(text):
            break
    if start >= 0:
        yield start, mark, end


def _next(text: str, k: int, end: int) -> str:
    """What begins at k: end, upper, lower (a plain small word), name (small, but no plain word), other script, digit, none."""
    k = _SKIP.match(text, k, end).end()
    if k >= end:
        return "end"
    c = text[k]
    if c.isdigit():
        return "digit"
    if not c.isalpha():
        return "none"
    if c.isupper() or c.istitle():
        return "upper"
    if not c.islower():
        return "caseless"
    token = _TOKEN.match(text, k, end)[0].rstrip(".,;:!?)”»’\"")
    if token.lower() in ON or token.lower() in MAY_END:
        return "lower"
    return "name" if re.search(r"[_()/\d]|\.\w", token) else "lower"


def _period_ends(text: str, at: int, k: int, start: int, end: int) -> bool:
    """Whether the single period at `at`, followed by a blank and what begins at k, ends a sentence."""
    follows = _next(text, k, end)
    kind, begin = abbreviation(text, at, start)
    if kind == "on" or (kind == "number" and follows == "digit"):
        return False
    if kind == "may":
        return follows in ("upper", "caseless", "name")
    c = text[at - 1] if at > start else ""
    inside = at - 2 >= start and _wordy(text[at - 2])
    if kind != "number" and c.isalpha() and not inside and at - 2 >= start:
        i = at - 2
        while i > start and text[i].isspace():
            i -= 1
        if not (c.islower() and text[i].isdigit()):  # a unit may end a sentence, an initial doesn't
            return False
    elif kind != "number" and c.isalpha() and not inside:
        return False
    if kind == "number" and at - 2 >= start and c.isupper() and not inside:
        return False
    i = at
    while i > start and text[i - 1].isdecimal():
        i -= 1
    if i < at:
        j = i
        while j > start and text[j - 1].isspace():
            j -= 1
        w = j
        while w > start and (text[w - 1].isalnum() or text[w - 1] == "_"):
            w -= 1
        word = _TOKEN.match(text, k, end)
        if (text[w:j].lower() if j < i else "") in ORDINAL_AFTER or (word and word[0].strip(".,;:!?").lower() in MONTHS):
            return False
    return follows != "lower"


def _opens(text: str, at: int, start: int, end: int) -> bool:
    """Whether a straight quote can open: not as a sign of inches or seconds after a digit, nor after a word, nor before a blank."""
    return (at == start or not text[at - 1].isalnum()) and at + 1 < end and not text[at + 1].isspace()


def _block_ends(text: str, start: int, mark: int, end: int) -> Iterator[int]:
    stack: list[tuple[str, int, bool, bool]] = []  # closing sign, its opening place, whether it begins a sentence, whether a colon led to it
    begin = i = mark
    thai = _THAI.search(text, mark, end) is not None
    gaps = [m.span() for m in _GAP.finditer(text, mark, end)] if thai else []
    g = 0
    closing: dict[str, int] = {}  # where each closing sign was found last, so that long lines are searched once
    greek = [m.start() for m in _GREEK.finditer(text, mark, end)]

    def blank_to(j: int) -> int:
        while j < end and text[j].isspace():
            j += 1
        return j

    while True:
        m = _EVENT.search(text, i, end)
        stop = m.start() if m else end
        while g < len(gaps) and gaps[g][0] <= stop:
            a, b = gaps[g]
            g += 1
            if not stack and a > begin and not _LATIN.match(text[a - 1]) and not _LATIN.match(text[b]):
                yield a
                begin = b
        if not m:
            return
        i, c = m.end(), m[0]
        if stack and c == stack[-1][0]:
            if c == "’" and i < end and text[i].isalpha():
                continue  # an apostrophe
            _, opened, first, colon = stack.pop()
            if stack:
                continue
            inner = text[opened + 1 : i - 1].rstrip()
            if not inner or inner[-1] not in ENDS:
                continue
            k = blank_to(i)
            if k >= end:
                return
            if text[opened] in BRACKETS:
                over = first and _next(text, k, end) != "lower"
            elif k == i:  # no blank: only scripts without blanks, and only after a colon
                over = colon and _CJK.match(text[k]) is not None
            else:
                follows = _next(text, k, end)
                over = follows in ("upper", "name", "digit") or (follows == "caseless" and colon) or (follows == "caseless" and text[k] in OPEN and colon)
            if over and text[k] not in ",;:.，、":
                yield i
                begin = i
            continue
        if c == '"' and not _opens(text, i - 1, begin, end):
            continue
        if c in OPEN and not (c == '"' and stack and stack[-1][0] == '"'):
            close = OPEN[c]
            if closing.get(close, -1) < i:
                found = text.find(close, i, end)
                closing[close] = found if found >= 0 else end
            if closing[close] < end:
                j = i - 1
                while j > begin and text[j - 1].isspace():
                    j -= 1
                stack.append((close, i - 1, j <= begin, j > begin and text[j - 1] in ":："))
            continue
        if c in CLOSE:
            continue
        if c in ";;":
            if not stack and bisect_left(greek, begin) < bisect_left(greek, i) and i < end and text[i].isspace() and _next(text, blank_to(i), end) != "lower":
                yield i
                begin = i
            continue
        run = _RUN.match(text, i - 1, end)
        at, i = i - 1, run.end()
        if stack:
            continue
        j = i
        while j < end and text[j] in "”»’」』)）]］":
            j += 1
        k = blank_to(j)
        if k >= end:
            return
        signs = run[0]
        if k == j:
            over = (signs[-1] in FULL or (signs[-1] in "!?" and _CJK.match(text[k]) is not None)) and text[k] not in ",;:，、；："
        elif signs[-1] in FULL:
            over = True
        elif signs == ".":
            over = _period_ends(text, at, k, mark, end)
        else:
            over = _next(text, k, end) not in ("lower",)
        if over:
            yield j
            begin = i = j


def sentence_ends(text: str) -> list[int]:
    """Code points from the start of the text through the last character of each sentence."""
    out: list[int] = []
    for start, mark, end in blocks(text):
        for e in _block_ends(text, start, mark, end):
            if e < end and (not out or e > out[-1]):
                out.append(e)
        out.append(end)
    return out


def sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sentence_no, start_pos, end_pos, sentence) of every sentence; positions count code points.

    Whole texts are read; a null, empty or blank text has no sentence. Repeated rows come out as often as they come in.
    No shuffle: every document is read where it lies.
    """

    def one(i, t):
        at = 0
        for n, e in enumerate(sentence_ends(t) if t else ()):
            while at < e - 1 and (t[at].isspace() or t[at] == "﻿"):
                at += 1
            yield i, n, at, e, t[at:e]
            at = e

    return map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), one, "doc_id bigint, sentence_no int, start_pos bigint, end_pos bigint, sentence string")


def sentence_places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, end_pos) alone, as sentences() gives them."""
    return map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), lambda i, t: ((i, e) for e in sentence_ends(t)) if t else (), "doc_id bigint, end_pos bigint")
