"""Names of a gazetteer in texts: a token trie, sent to all tasks while the index is small; one pass a text, and no phrase is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hazmill.durable import spread

#: Names that an index may have to be sent whole to the tasks; a larger one is joined.
MOST_NAMES = 200_000
END = ""

_NOT_WORD = regex.compile(r"[^\p{L}\p{N}.'\-]+")
_EDGES = regex.compile(r"^[.'\-]+|['\-]+$|(?<![A-Z]\.[A-Z])(?<!^[A-Z])\.$|'s$")
_CAPITAL = regex.compile(r"\p{Lu}")
_DOTS = regex.compile(r"^\.+|\.+$")


def trie(index: DataFrame, value: str | None = None) -> dict | None:
    """Names (lower case) as a trie of their words, with a value at each end; None if the index is larger than MOST_NAMES."""
    rows = index.select("name", *([value] if value else [])).limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        return None
    root: dict = {}
    for row in rows:
        node = root
        for word in row[0].split(" "):
            node = node.setdefault(word, {})
        node[END] = row[1] if value else True
    return root


def entities(parts: list[dict], dateline: str, root: dict, longest: int) -> list[str]:
    """The names in an article's parts (rank, part, text) that the trie knows, in order of relevance, once each: those that begin and end with a
    capital; short ones in capitals only; none inside a longer one that starts no later."""
    first: dict[str, tuple] = {}
    for p in parts:
        words = [w for w in _NOT_WORD.sub(" ", p["text"]).strip(" ").split(" ") if w]
        clean = [_EDGES.sub("", w) for w in words]
        low = [w.lower() for w in clean]
        for i in range(len(clean)):
            node = root
            for n in range(1, min(longest, len(clean) - i) + 1):
                node = node.get(low[i + n - 1])
                if node is None:
                    break
                if END not in node or not _CAPITAL.match(clean[i]) or n > 1 and not _CAPITAL.match(clean[i + n - 1]):
                    continue
                phrase, name = " ".join(clean[i : i + n]), " ".join(low[i : i + n])
                if len(phrase) <= 3 and phrase != phrase.upper() or p["rank"] != 0 and name == dateline:
                    continue
                at = (p["rank"], p["part"], i + 1, -n)
                if name not in first or (at, phrase) < first[name]:
                    first[name] = at, phrase
    found = sorted(first.values())
    covers = lambda a, b: a[:2] == b[:2] and a[2] <= b[2] and a[2] - a[3] >= b[2] - b[3] and a[3] < b[3]
    return [phrase for at, phrase in found if not any(covers(other, at) for other, _ in found)]


def longest_name(place: str, root: dict, longest: int):
    """The value of the longest run of a place's words that is a name, the first among equals."""
    low = [w.lower() for w in place.replace(",", " ").split()]
    for n in range(min(longest, len(low)), 0, -1):
        for i in range(len(low) - n + 1):
            node = root
            for word in _DOTS.sub("", " ".join(low[i : i + n])).split(" "):
                node = node.get(word)
                if node is None:
                    break
            if node is not None and END in node:
                return node[END]
    return None


def looked_up(df: DataFrame, root: dict, find: Callable, inputs: list[str], out: str) -> DataFrame:
    """The first column and what find(*inputs, trie) gives, as the last one of the schema `out`."""
    shared = df.sparkSession.sparkContext.broadcast(root)  # MOST_NAMES names at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in inputs))
            names = [f.split(" ")[0] for f in out.split(", ")]
            kind = pa.list_(pa.string()) if "array" in out else pa.string()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([find(*r, shared.value) for r in rows], kind)], names)

    return spread(df).mapInArrow(work, out)
