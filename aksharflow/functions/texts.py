"""Texts rewritten and measured in a worker, over lists of texts.

Rewriting takes many texts at once, joined by a character that no rule knows. The patterns are those of the built-in
expressions, put so that a search starts from few characters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

#: White space of patterns.WS, in the syntax of Python.
_SPACES = " \t-\r\x1c-\x1f\x85\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WS = f"[{_SPACES}]"
#: Rows of a batch that are Python objects at once.
SLICE = 256
#: Characters of the texts that are rewritten at once.
_CHUNK = 1 << 18


def python(regex: str) -> str:
    """A pattern in Java syntax, as these modules use it, in the syntax of Python."""
    return regex.replace(P.WS, WS)


def _stranger(text: str) -> str:
    """A private character that the text does not hold; no rule knows any of them."""
    return next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in text)


def rewrite(texts: list[str], run: Callable[[str, str], str]) -> Iterator[str]:
    """Each text rewritten. ``run`` gets texts that stand between separators, and the separator."""
    now: list[str] = []

    def done() -> list[str]:
        joined = "".join(now)
        sep = _stranger(joined)
        out = run(sep + sep.join(now) + sep, sep)[1:-1].split(sep)
        now.clear()
        return out

    size = 0
    for t in texts:
        now.append(t)
        size += len(t) + 1
        if size >= _CHUNK:
            yield from done()
            size = 0
    if now:
        yield from done()


def slices(text: pa.Array) -> Iterator[pa.Array]:
    """Parts of so many rows that few texts are held as Python objects at once; one part at least."""
    for i in range(0, max(len(text), 1), SLICE):
        yield text.slice(i, SLICE)


def each(text: pa.Array, run: Callable[[str, str], str]) -> pa.Array:
    """Rewrites the texts that are not null."""
    out = []
    for part in slices(text):
        rows = part.to_pylist()
        at = [i for i, t in enumerate(rows) if t is not None]
        for i, x in zip(at, rewrite([rows[i] for i in at], run)):
            rows[i] = x
        out.append(pa.array(rows, pa.string()))
    return pa.concat_arrays(out)


# conversion


def _alternatives(keys: list[str]) -> str:
    """Literals, the longest first, by their first character."""
    firsts: dict[str, list[str]] = {}
    for k in sorted(keys, key=lambda k: (-len(k), k)):
        firsts.setdefault(k[0], []).append(re.escape(k[1:]))
    return "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in firsts.items())


class Substitution:
    """Greedy longest-match substitution of a glyph table, then short i behind its cluster where that is asked for."""

    #: First of the private characters that stand for longer glyphs in transit, so that one translation gives all values.
    _MARK = 0xF0000

    def __init__(self, table: dict[str, str], reorder: bool) -> None:
        self.table, self.reorder = table, reorder
        self.whole = re.compile(_alternatives(list(table)))
        self.marks = {k: chr(self._MARK + i) for i, k in enumerate(k for k in table if len(k) > 1)}
        self.longer = re.compile(_alternatives(list(self.marks)))
        self.single = {i: chr(i) for i in (*range(0x100), *range(0x900, 0x980))}
        self.single |= {ord(k): v for k, v in table.items() if len(k) == 1} | {ord(m): table[k] for k, m in self.marks.items()}
        self.transit = re.compile(f"[{chr(self._MARK)}-{chr(self._MARK + len(self.marks))}]")
        self.short_i = re.compile(f"{P.I_SIGN}(ं?)({P.CLUSTER})")

    def __call__(self, text: str, sep: str = "") -> str:
        if self.transit.search(text):
            out = self.whole.sub(lambda m: self.table[m.group()], text)
        else:
            marks = self.marks
            out = self.longer.sub(lambda m: marks[m.group()], text).translate(self.single)
        return self.short_i.sub(f"\\2{P.I_SIGN}\\1", out) if self.reorder else out


# repair


class Repair:
    """The rewrite chain of repair.steps()."""

    def __init__(self, steps: list[tuple[str, str]]) -> None:
        doubled = [(m + m, m) for m in P.SINGLE_MARKS]
        joining = [f"([{P.CP}]){P.WS}+([{P.MARKS}]){P.WS}+", f"([{P.CP}]){P.WS}+([{P.MARKS}])"]
        self.steps: list[Callable[[str, str], str]] = []
        for regex, to in steps:
            if (regex, to) in doubled[1:] or regex == joining[1]:
                continue
            if (regex, to) == doubled[0]:
                run = self._step(f"([{P.SINGLE_MARKS}])\\1", "$1")  # what one pass for each mark gives
            elif regex == joining[0]:
                run = self._joined  # both steps: what the first one leaves behind a sign begins no match of the second
            elif regex.startswith(f"(^|{P.WS})"):
                run = self._leading
            elif re.search(r"[\[\](){}\\.|?*+^$]", regex) is None:
                run = self._literal(regex, to)
            else:
                run = self._step(regex, to, self._needed(regex))
            self.steps.append(run)
        self.gap = re.compile(f"([{P.CP}]){WS}+([{P.MARKS}])({WS}+)?")
        self.stray: dict[str, re.Pattern] = {}

    @staticmethod
    def _needed(regex: str) -> tuple[str, ...]:
        """Literals of which a text holds one where a pattern matches, none if they aren't known."""
        if regex == P.STRAY_ZWJ:
            return (P.ZWJ,)
        if regex == P.DUP_HALANT:
            return (P.HALANT * 2,)
        if all(a in regex for a in P.AUXILIARIES):
            return tuple(a + a for a in P.AUXILIARIES)
        return ()

    @staticmethod
    def _literal(part: str, to: str) -> Callable[[str, str], str]:
        return lambda s, sep: s.replace(part, to)

    @staticmethod
    def _step(regex: str, to: str, needed: tuple[str, ...] = ()) -> Callable[[str, str], str]:
        pattern, template = re.compile(python(regex)), re.sub(r"\$(\d)", r"\\\1", to)
        return lambda s, sep: pattern.sub(template, s) if not needed or any(x in s for x in needed) else s

    def _joined(self, text: str, sep: str) -> str:
        return self.gap.sub(lambda m: m[1] + m[2] + " " if m[3] else m[1] + m[2], text)

    def _leading(self, text: str, sep: str) -> str:
        if sep not in self.stray:
            self.stray[sep] = re.compile(f"([{sep}{_SPACES}])[{P.MARKS}](?=[{P.C}])")
        return self.stray[sep].sub(r"\1", text)

    def __call__(self, text: str, sep: str) -> str:
        for step in self.steps:
            text = step(text, sep)
        return text


# measures


def _number(regex: str) -> Callable[[str], int]:
    find = re.compile(python(regex)).findall
    return lambda text: len(find(text))


def _over_gaps(char_class: str) -> Callable[[str], int]:
    """Matches of a character of the class, white space and a sign, found from the white space."""
    first = frozenset(c for c in map(chr, range(0x900, 0x980)) if re.match(f"[{char_class}]", c))
    ahead, space = re.compile(f"{WS}(?=[{P.MARKS}])").finditer, re.compile(WS).match

    def number(text: str) -> int:
        n = free = 0
        for m in ahead(text):
            i = m.start() - 1
            while i >= free and text[i] not in first and space(text, i):
                i -= 1
            if i >= free and text[i] in first:
                n, free = n + 1, m.end() + 1
        return n

    return number


def _leading(text: str) -> int:
    return len(_LEADING.findall("\n" + text))


_LEADING = re.compile(f"{WS}[{P.MARKS}](?=[{P.C}])")
_TOKENS = re.compile(f"[{P.TOKEN}]{{3,}}").findall


def matches(regex: str) -> Callable[[str], int]:
    """Number of matches in a text, what regexp_count() gives."""
    if regex.startswith(f"(^|{P.WS})([{P.MARKS}])"):
        return _leading
    for c in (P.CP, P.DEVA):
        if regex in (f"([{c}]){P.WS}+([{P.MARKS}])", f"[{c}]{P.WS}+[{P.MARKS}]"):
            return _over_gaps(c)
    if regex == P.STRAY_ZWJ:
        some = _number(regex)
        return lambda text: some(text) if P.ZWJ in text else 0
    return _number(regex)


class Measure:
    """Counts over texts, by name: characters of ``classes`` (without white space), matches of ``regexes``, occurrences
    of each of several ``literals``, "tokens" of three letters or more, "hits" of them among ``words``, and "visible" and
    "length", characters without white space and without that at the ends."""

    def __init__(self, classes: dict[str, str], regexes: dict[str, str], words: frozenset[str] | None, literals: dict[str, tuple[str, ...]]) -> None:
        self.classes, self.regexes, self.words, self.literals = list(classes), {n: matches(r) for n, r in regexes.items()}, words, literals
        low = "".join(map(chr, range(0xD800)))
        self.bits = np.zeros(0xD801, np.uint16)
        self.bits[[m.start() for m in re.finditer(WS, low)]] = 1
        for i, c in enumerate(classes.values()):
            inside = np.array([m.start() for m in re.finditer(c, low)], int)
            self.bits[inside[self.bits[inside] & 1 == 0]] |= 2 << i

    def __call__(self, texts: list[str]) -> dict[str, np.ndarray]:
        out = {n: np.zeros(len(texts), np.int32) for n in (*self.classes, *self.regexes, *self.literals, "tokens", "hits", "visible", "length")}
        now, size = [], 0
        for i, t in enumerate(texts):
            for n, number in self.regexes.items():
                out[n][i] = number(t)
            for n, parts in self.literals.items():
                out[n][i] = sum(map(t.count, parts))
            out["length"][i] = len(t.strip())
            if self.words is not None:
                tokens = _TOKENS(t)
                out["tokens"][i], out["hits"][i] = len(tokens), sum(map(self.words.__contains__, tokens))
            now.append(i)
            size += len(t) + 1
            if size >= _CHUNK or i == len(texts) - 1:
                self._count(texts, now, out)
                now, size = [], 0
        return out

    def _count(self, texts: list[str], at: list[int], out: dict[str, np.ndarray]) -> None:
        code = np.frombuffer("\n".join([*(texts[i] for i in at), ""]).encode("utf-32-le"), np.uint32)
        bits = self.bits[np.minimum(code, 0xD800)]
        starts = np.r_[0, np.cumsum([len(texts[i]) + 1 for i in at])[:-1]]
        sums = lambda x: np.add.reduceat(x, starts, dtype=np.int32)
        out["visible"][at] = sums((bits & 1) == 0)
        for i, n in enumerate(self.classes):
            out[n][at] = sums((bits & (2 << i)) != 0)


@cache
def _measure(classes: tuple, regexes: tuple, words: frozenset[str] | None, literals: tuple) -> Measure:
    return Measure(dict(classes), dict(regexes), words, dict(literals))


def measured(text: Column, classes: dict[str, str], regexes: dict[str, str], names: list[str], words: frozenset[str] | None = None, literals: dict[str, tuple[str, ...]] | None = None) -> Column:
    """struct of the counts of these names; its fields are null for a null text."""
    asked = (tuple(classes.items()), tuple(regexes.items()), words, tuple((literals or {}).items()))

    def run(text: pa.Array) -> pa.Array:
        columns, start = {n: np.zeros(len(text), np.int32) for n in names}, 0
        for part in slices(text):
            rows = part.to_pylist()
            at = [i for i, t in enumerate(rows) if t is not None]
            counts = _measure(*asked)([rows[i] for i in at])
            for n, column in columns.items():
                column[[start + i for i in at]] = counts[n]
            start += len(rows)
        found = [pa.array(c) for c in columns.values()]
        return pa.StructArray.from_arrays(found, fields=[pa.field(n, pa.int32()) for n in names], mask=pc.is_null(text))

    return F.arrow_udf(run, f"struct<{','.join(f'{n}:int' for n in names)}>")(text)
