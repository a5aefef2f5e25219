"""Exact URL filtering by a cascade of Bloom filters.

Keys are a rule's host and path joined. The complete key universe is every key that any URL of
the corpus could match: the last labels of its host, as many as some listed host has, each with the prefix of its path that is
as long as some path listed with so many labels. Level 0 holds the listed keys, level 1 those keys of the universe that
level 0 wrongly admits, level 2 the listed keys that level 1 wrongly admits, and so on until none
is left; a key's membership is read from the first level that rejects it, with no join.

Level 0 has log2(universe / listed) bits a key (rounded up, two at least), so that about as many
false positives as listed keys are left to the driver and to the later levels, at any size of the corpus. Keys stand for themselves by two 64-bit
hashes; whether a key that level 0 admits is listed is told by a join of these few with the rules, by the key's string. The corpus is read three times for
any number of verdicts: to estimate the universe, to find the false positives, to judge.

Rules are a table of any size: up to MOST_RULES the filters (some bits a rule) are broadcast; more rules than that are joined with the URLs' keys, which gives the same.

Defined results: a null URL, or one without ``://``, has empty host and path. Without a rule the
verdict is the method's: allow, as the key is in no list. Of rules that fit, the longest key wins; among equally long ones the verdict
that is first in alphabetical order, then the longer host. Null page ids, repeated rows and empty tables pass through. A URL of any length and a host of any number of
labels have as many keys as there are shapes (labels and path length) of rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazmill.llm.common import mix, released

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: Rules whose filters are broadcast: a few bytes each.
MOST_RULES = 5_000_000


def shapes_of(rules: DataFrame) -> list[tuple[int, int]]:
    """The numbers of host labels and lengths of path that listed keys have together."""
    host, path = F.substring_index("key", "/", 1), F.expr("length(key) - instr(key, '/') + 1")
    return sorted((r.labels, r.n) for r in rules.select(F.size(F.split(host, r"\.")).alias("labels"), path.alias("n")).distinct().collect())  # a few numbers for each shape


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """All keys that a rule fitting this URL can have, longest hosts first."""
    if not shapes:
        return F.array().cast("array<string>")
    labels = F.split(host, r"\.")
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in sorted(shapes, reverse=True)])
    fits = F.filter(wanted, lambda s: (s["k"] <= F.size(labels)) & (s["n"] <= F.length(path)))
    keys = F.transform(fits, lambda s: F.concat(F.array_join(F.slice(labels, F.size(labels) - s["k"] + 1, s["k"]), "."), path.substr(F.lit(1), s["n"])))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


def hashes_of(key: Column) -> Column:
    """Two 64-bit hashes of a key."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray = field(repr=False, default=None)

    def positions(self, keys: np.ndarray, seed: int) -> Iterator[np.ndarray]:
        """keys: two hashes each."""
        h = mix(keys[:, 0] ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        step = mix(h + keys[:, 1]) | np.uint64(1)
        h = h ^ mix(keys[:, 1])
        for _ in range(self.hashes):
            yield (h % np.uint64(self.bits)).astype(np.int64)
            h = h + step

    def add(self, keys: np.ndarray, seed: int) -> None:
        self.words = np.zeros((self.bits + 7) // 8, dtype=np.uint8) if self.words is None else self.words
        for at in self.positions(keys, seed):
            np.bitwise_or.at(self.words, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(self, keys: np.ndarray, seed: int) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for at in self.positions(keys, seed):
            out &= (self.words[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


@dataclass
class Cascade:
    """Alternating levels; even ones hold listed keys, odd ones keys of the universe that aren't listed."""

    levels: list[Level]

    def has(self, keys: np.ndarray) -> np.ndarray:
        member = np.zeros(len(keys), dtype=bool)
        alive = np.arange(len(keys))
        for i, level in enumerate(self.levels):
            passed = level.has(keys[alive], i)
            alive = alive[passed]
            member[alive] = i % 2 == 0
        return member


def first_level(listed: np.ndarray, universe: int) -> Level:
    n = max(1, len(listed))
    hashes = max(2, math.ceil(math.log2(max(2, universe / n))))
    level = Level(max(64, math.ceil(n * hashes / math.log(2))), hashes)
    level.add(listed, 0)
    return level


def cascade(listed: np.ndarray, false: np.ndarray, first: Level) -> Cascade:
    """The levels above the first, from its false positives in the whole universe."""
    levels, yes, no = [first], listed, false
    while len(no):
        if len(levels) > 200:
            raise RuntimeError("two keys share both hashes")
        level = Level(max(64, math.ceil(2 * len(no) / math.log(2))), 2)
        level.add(no, len(levels))
        levels.append(level)
        yes, no = no, yes[level.has(yes, len(levels) - 1)]
    return Cascade(levels)


def _pairs(rows: list) -> np.ndarray:
    return np.array([(r.a, r.b) for r in rows], dtype=np.int64).reshape(-1, 2).astype(np.uint64)


def build(keys: DataFrame, rules: DataFrame) -> dict[str, Cascade]:
    """A cascade for each verdict of the rules (key, verdict) over the universe in the columns key, a and b (its hashes). The driver gets the rules' hashes, MOST_RULES at most, and
    those of the false positives of the levels 0, which are about as many."""
    universe = keys.agg(F.approx_count_distinct("a")).first()[0]
    listed: dict[str, list] = {}
    for r in rules.select("verdict", hashes_of(F.col("key")).alias("h")).select("verdict", "h.*").distinct().collect():
        listed.setdefault(r.verdict, []).append(r)
    hashes = {name: _pairs(rows) for name, rows in sorted(listed.items())}
    firsts = {name: first_level(h, universe) for name, h in hashes.items()}
    shared = keys.sparkSession.sparkContext.broadcast(firsts)

    def admitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")], axis=1).astype(np.uint64)
            for name, level in shared.value.items():
                passed = pa.array(np.flatnonzero(level.has(h, 0)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(passed), pa.string()), *(batch.column(c).take(passed) for c in ("key", "a", "b"))], ["verdict", "key", "a", "b"])

    passed = keys.select("key", "a", "b").mapInArrow(released(admitted), "verdict string, key string, a long, b long").distinct()
    false: dict[str, list] = {name: [] for name in hashes}
    for r in passed.join(rules.select("verdict", "key").distinct(), ["verdict", "key"], "left_anti").select("verdict", "a", "b").distinct().collect():
        false[r.verdict].append(r)
    return {name: cascade(hashes[name], _pairs(false[name]), firsts[name]) for name in hashes}


def judge(pages: DataFrame, rules: DataFrame | list[tuple[str, str]], url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """The columns to keep with host, path, the longest fitting rule and its verdict. rules: (key, verdict), the key being host and path joined."""
    spark = pages.sparkSession
    rules = spark.createDataFrame(rules, "key string, verdict string") if isinstance(rules, list) else rules.select("key", "verdict")
    shapes = shapes_of(rules)
    keyed = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    keyed = keyed.withColumn("cand", candidate_keys(F.col("host"), F.col("path"), shapes))
    names = [*keep, "host", "path"]
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        return _joined(keyed, rules, names, default)
    keyed = keyed.withColumn("hashes", F.transform("cand", hashes_of))
    universe = keyed.select(F.explode(F.arrays_zip("cand", "hashes")).alias("k")).select(F.col("k.cand").alias("key"), "k.hashes.a", "k.hashes.b")
    shared = spark.sparkContext.broadcast(build(universe, rules))
    schema = keyed.select(*names).schema.add("rule", "string").add("verdict", "string")

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lists = batch.column("hashes")
            sizes = np.diff(lists.offsets.to_numpy())
            both = lists.flatten()
            flat = np.stack([both.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b")], axis=1).astype(np.uint64)
            keys = batch.column("cand").flatten().to_pylist()
            owner = np.repeat(np.arange(n), sizes)
            rule, said = [None] * n, [default] * n
            for verdict, cascade_ in shared.value.items():
                for i in np.flatnonzero(cascade_.has(flat)):
                    o = owner[i]
                    if rule[o] is None or len(keys[i]) > len(rule[o]):
                        rule[o], said[o] = keys[i], verdict
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rule, pa.string()), pa.array(said, pa.string())], [*names, "rule", "verdict"])

    return keyed.mapInArrow(released(decided), schema)


def _joined(keyed: DataFrame, rules: DataFrame, names: list[str], default: str) -> DataFrame:
    """The same by a join of the URLs' distinct keys with the rules, for lists of any size: each distinct (host, path) is looked up once."""
    once = keyed.select("host", "path", "cand").distinct()
    each = once.select("host", "path", F.posexplode("cand").alias("at", "key"))
    found = each.join(rules, "key").groupBy("host", "path").agg(F.min(F.struct((-F.length("key")).alias("less"), F.col("verdict"), F.col("at"), F.col("key"))).alias("f"))
    out = keyed.join(found, ["host", "path"], "left")
    return out.select(*names, F.col("f.key").alias("rule"), F.coalesce("f.verdict", F.lit(default)).alias("verdict"))
