"""Matching a catalogue of number rules against a whole batch of texts at once.

The batch is one string, its texts parted by a character that no pattern matches. It is tokenised into arrays, each rule's anchors become
sorted arrays of token numbers, and all matches of a rule are bound to them by binary search. Patterns are tried only where one can begin (at a number, or at
one of the words that it begins with) and only in texts that hold one of the rule's anchors, as a match far from any can't count.
"""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np

try:
    import re._constants as sre
    import re._parser as sre_parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as sre_parser

REACH, NEGATION_REACH = 8, 5
BREAK = "\x00"
DIGIT = "0"

#: What re.IGNORECASE takes for ASCII letters besides their capitals.
_LOWER = {i: i + 32 for i in range(65, 91)} | {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}
_NUMBER_RUN = re.compile(r"\d[\d,]*")
_AFTER = re.compile(r"\d[\d,]*(?:\.\d+)?[\s\-]*(..?)?", re.S)


def _beginnings(items: list) -> tuple[set[str], bool] | None:
    """What a sequence can begin with, blanks and hyphens aside: lower-case strings, DIGIT for a number; and whether all of it may be empty. None if that isn't known."""
    out: set[str] = set()
    for k, (kind, what) in enumerate(items):
        if kind is sre.AT or _is_gap(kind, what):
            continue
        if kind is sre.LITERAL:
            run = ""
            for kind2, what2 in items[k:]:
                if kind2 is not sre.LITERAL:
                    break
                run += chr(what2).lower()
            rest = items[k + len(run) :]
            joined = rest and rest[0][0] is sre.BRANCH and all(b and b[0][0] is sre.LITERAL and not _is_gap(*b[0]) for b in rest[0][1][1])
            if joined and (more := _beginnings(rest)) and not more[1] and DIGIT not in more[0]:  # a prefix that all branches share
                return out | {run + m for m in more[0]}, False
            return out | {DIGIT if run[0].isdigit() else run}, False
        if kind is sre.IN:
            return (out | {DIGIT}, False) if what == [(sre.CATEGORY, sre.CATEGORY_DIGIT)] else None
        if kind is sre.SUBPATTERN:
            got = _beginnings(list(what[3]))
        elif kind is sre.BRANCH:
            parts = [_beginnings(list(b)) for b in what[1]]
            got = None if None in parts else (set().union(*(p[0] for p in parts)), any(p[1] for p in parts))
        elif kind is sre.MAX_REPEAT:
            got = _beginnings(list(what[2]))
            got = got and (got[0], got[1] or what[0] == 0)
        else:
            return None
        if got is None:
            return None
        out |= got[0]
        if not got[1]:
            return out, False
    return out, True


def _is_gap(kind, what) -> bool:
    """Blanks or hyphens."""
    if kind is sre.MAX_REPEAT:
        return all(_is_gap(*x) for x in what[2])
    if kind is sre.IN:
        return all(x in ((sre.CATEGORY, sre.CATEGORY_SPACE), (sre.LITERAL, 32), (sre.LITERAL, 45)) for x in what)
    return kind is sre.LITERAL and what in (32, 45)


def _is_number(kind, what) -> bool:
    """A part of a number: digits, commas, decimals."""
    if kind is sre.SUBPATTERN:
        return all(_is_number(*x) for x in what[3])
    if kind is sre.MAX_REPEAT:
        return all(_is_number(*x) for x in what[2])
    if kind is sre.IN:
        return all(x in ((sre.CATEGORY, sre.CATEGORY_DIGIT), (sre.LITERAL, 44)) for x in what)
    return kind is sre.LITERAL and what in (44, 46)


def heads(pattern: str) -> set[str] | None:
    """What a match begins with; None if that isn't known."""
    found = _beginnings([x for x in sre_parser.parse(pattern, re.I)])
    return None if found is None or found[1] else found[0]


def followers(pattern: str) -> set[str] | None:
    """What follows the number that a pattern begins with; None if it doesn't begin with one or that isn't known."""
    items = [x for x in sre_parser.parse(pattern, re.I)]
    while items and items[0][0] is sre.SUBPATTERN:
        items = [*items[0][1][3], *items[1:]]
    rest = items
    while rest and _is_number(*rest[0]):
        rest = rest[1:]
    found = _beginnings(rest) if len(rest) < len(items) else None
    return None if found is None or found[1] or DIGIT in found[0] else found[0]


class Batch:
    """Texts (without runs of white space) as one string with its tokens."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        clean = [t.replace(BREAK, "\x01") if BREAK in t else t for t in texts]
        self.whole = BREAK.join(clean)
        sizes = np.fromiter(map(len, clean), dtype=np.int64, count=len(clean))
        self.begin = np.cumsum(sizes + 1) - sizes - 1  # of each text
        self.end = self.begin + sizes
        self.low = self.whole.lower() if self.whole.isascii() else self.whole.translate(_LOWER)
        self._cues: dict[tuple[str, ...], np.ndarray] = {}
        self._tokens()

    def _tokens(self) -> None:
        """Maximal runs of word characters and slashes, without slashes at their ends."""
        codes = np.frombuffer(self.low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        word = np.zeros(len(codes), dtype=bool)
        small = codes < 128
        table = np.zeros(128, dtype=bool)
        table[[*range(48, 58), 95, *range(97, 123)]] = True
        word[small] = table[codes[small]]
        if not small.all():
            for c in np.unique(codes[~small]):
                if re.match(r"\w", chr(c)):
                    word[codes == c] = True
        inside = np.append(word | (codes == 47), False)
        edges = np.diff(np.concatenate([[False], inside]).astype(np.int8))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        at = np.append(np.flatnonzero(word), len(codes) + 1)
        first = at[np.searchsorted(at, starts)]
        last = at[np.searchsorted(at, ends) - 1] if len(at) > 1 else np.full(len(ends), -1)
        some = (first < ends) & (last >= starts)
        self.start, self.stop = first[some], last[some] + 1
        source = self.low if self.whole.isascii() else self.whole
        self.words = [source[a:b] for a, b in zip(self.start.tolist(), self.stop.tolist())]
        if source is not self.low:
            self.words = [w.lower() for w in self.words]
        numbers: dict[str, int] = {}
        self.ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in self.words), dtype=np.int64, count=len(self.words))
        self.numbers = numbers
        self.from_token = np.searchsorted(self.start, self.begin)  # of each text
        self.to_token = np.searchsorted(self.start, self.end)

    @cached_property
    def number_starts(self) -> np.ndarray:
        """Where a number can begin: a number that begins within a run of digits and commas could begin at its first digit as well."""
        return np.array([m.start() for m in _NUMBER_RUN.finditer(self.whole)], dtype=np.int64)

    @cached_property
    def after_numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """The first character after each number that isn't a blank or hyphen, and it with the next one, as numbers."""
        low, match = self.low, _AFTER.match
        pairs = [match(low, at)[1] or BREAK for at in self.number_starts.tolist()]
        one = np.fromiter((ord(p[0]) for p in pairs), dtype=np.int64, count=len(pairs))
        two = np.fromiter((ord(p[1]) if len(p) > 1 else 0 for p in pairs), dtype=np.int64, count=len(pairs))
        return one, one << 21 | two

    def literal_starts(self, literal: str) -> list[int]:
        out, at, low = [], 0, self.low
        while (at := low.find(literal, at)) >= 0:
            out.append(at)
            at += 1
        return out

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, places, "right") - 1

    def tokens_named(self, names: list[str]) -> np.ndarray:
        """The numbers of all tokens that are one of the names."""
        wanted = [self.numbers[n] for n in names if n in self.numbers]
        return np.flatnonzero(np.isin(self.ids, wanted)) if wanted else np.zeros(0, dtype=np.int64)

    @cached_property
    def line(self) -> tuple[str, np.ndarray]:
        """The tokens parted by blanks (texts by BREAK), and where each begins in it."""
        sizes = np.fromiter(map(len, self.words), dtype=np.int64, count=len(self.words))
        spans = zip(self.from_token.tolist(), self.to_token.tolist())
        return BREAK.join(" ".join(self.words[a:b]) for a, b in spans if b > a), np.cumsum(sizes + 1) - sizes - 1

    def phrase(self, phrase: str) -> tuple[np.ndarray, int]:
        """The tokens at which a phrase begins, and how many more it takes."""
        line, begins = self.line
        found, at = [], 0
        while (at := line.find(phrase, at)) >= 0:
            found.append(at)
            at += 1
        return np.searchsorted(begins, np.array(found, dtype=np.int64), "right") - 1, phrase.count(" ")

    def cue_tokens(self, cues: tuple[str, ...]) -> np.ndarray:
        """The tokens that are a cue, or hold one between slashes."""
        if cues not in self._cues:
            wanted = [n for w, n in self.numbers.items() if w in cues or "/" in w and any(p in cues for p in w.split("/"))]
            self._cues[cues] = np.flatnonzero(np.isin(self.ids, wanted)) if wanted else np.zeros(0, dtype=np.int64)
        return self._cues[cues]

    def token_at(self, places: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """The token at a place; for a place in no token the text's last one, or its first one before that."""
        first, last = self.from_token[texts], self.to_token[texts] - 1
        k = np.searchsorted(self.start, places, "right") - 1
        return np.where(k < first, first, np.where(places < self.stop[np.maximum(k, 0)], k, last))


class Matcher:
    """One pattern, and where it can begin."""

    def __init__(self, pattern: str):
        self.pattern = re.compile(pattern, re.I)
        self.heads = heads(pattern)
        after = followers(pattern)
        self.after = after and ([ord(w) for w in after if len(w) == 1], [ord(w[0]) << 21 | ord(w[1]) for w in after if len(w) > 1])

    def places(self, batch: Batch, starts: dict[str, np.ndarray]) -> np.ndarray:
        if self.heads is None:
            return np.arange(len(batch.whole))
        if self.heads == {DIGIT} and self.after:
            one, two = batch.after_numbers
            return batch.number_starts[np.isin(one, self.after[0]) | np.isin(two, self.after[1])]
        for h in self.heads:
            if h not in starts:
                starts[h] = batch.number_starts if h == DIGIT else np.array(batch.literal_starts(h), dtype=np.int64)
        return np.unique(np.concatenate([starts[h] for h in self.heads]))

    def matches(self, batch: Batch, allowed: np.ndarray, starts: dict[str, np.ndarray]) -> list[tuple[int, re.Match]]:
        """(text, match) of all matches in the allowed texts. starts keeps the places of each beginning between calls."""
        places = self.places(batch, starts)
        if not len(places):
            return []
        owner = batch.text_of(places)
        chosen = allowed[owner]
        out, free, match, whole = [], 0, self.pattern.match, batch.whole
        numeric = self.heads is not None and DIGIT in self.heads
        for text, at in zip(owner[chosen].tolist(), places[chosen].tolist()):
            if at >= free:
                m = match(whole, at)
                while m is not None:
                    out.append((text, m))
                    free = m.end()
                    # what follows within a run of digits is a number of its own
                    m = match(whole, free) if numeric and free < len(whole) and whole[free].isdigit() and whole[free - 1].isdigit() else None
        return out


def bindings(batch: Batch, texts: np.ndarray, first: np.ndarray, last: np.ndarray, anchors: tuple[str, ...]) -> np.ndarray:
    """How well matches, from one token to another, are bound to anchors within REACH tokens around them."""
    lo = np.maximum(batch.from_token[texts], first - REACH)
    hi = np.minimum(batch.to_token[texts] - 1, last + REACH)
    own = batch.tokens_named([a for a in anchors if " " not in a])
    a, b = np.searchsorted(own, lo), np.searchsorted(own, hi, "right")
    count = np.maximum(b - a, 0)
    gap = np.full(len(first), 1 << 30)
    if len(own):
        for place in (first, last):
            after = np.searchsorted(own, place)
            for k in (after - 1, after):
                inside = (k >= a) & (k < b)
                near = np.abs(own[np.clip(k, 0, len(own) - 1)] - place)
                gap = np.where(inside, np.minimum(gap, near), gap)
    for phrase in (x for x in anchors if " " in x):
        begins, more = batch.phrase(phrase)
        if not len(begins):
            continue
        k = np.searchsorted(begins, lo)
        found = (k < len(begins)) & (begins[np.minimum(k, len(begins) - 1)] + more <= hi)
        count = count + found
        gap = np.where(found, np.minimum(gap, 1), gap)
    score = np.minimum(1.0, 0.42 + 0.12 * np.minimum(count, 3) + np.maximum(0.0, 0.26 - 0.03 * np.minimum(gap, 1 << 20)))
    return np.where(count > 0, score, 0.08)


def negated(batch: Batch, texts: np.ndarray, first: np.ndarray, last: np.ndarray, cues: tuple[str, ...]) -> np.ndarray:
    lo = np.maximum(batch.from_token[texts], first - NEGATION_REACH)
    hi = np.minimum(batch.to_token[texts] - 1, last + NEGATION_REACH)
    own = batch.cue_tokens(cues)
    return np.searchsorted(own, hi, "right") > np.searchsorted(own, lo)


def with_anchors(batch: Batch, anchors: tuple[str, ...]) -> np.ndarray:
    """Which texts hold an anchor."""
    tokens = batch.tokens_named([a for a in anchors if " " not in a])
    for phrase in (x for x in anchors if " " in x):
        tokens = np.concatenate([tokens, batch.phrase(phrase)[0]])
    out = np.zeros(len(batch.texts), dtype=bool)
    if len(tokens):
        out[batch.text_of(batch.start[tokens])] = True
    return out
