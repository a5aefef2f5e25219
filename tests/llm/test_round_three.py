"""Operators 11 to 13 against brute force, SQL and their laws."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hazmill.llm import merkle, negatives, shards
from hazmill.llm.common import ranked

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, shard string, link string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "clash", "clash", "clash") for i, t, lang in rows], DOCS)


def test_ranked(spark):
    rows = [(None, 3), ("a", 1), (None, 1), ("b", 5), ("a", 0), ("a", 9), ("a", 1)] * 30
    df = spark.createDataFrame(rows, "g string, v int")
    got, counts = ranked(df, ["g"], ["v"], "test", parts=5)
    assert {r.g: r.n for r in counts.collect()} == Counter(g for g, _ in rows)
    for g in (None, "a", "b"):
        mine = sorted((r.pos, r.v) for r in got.collect() if r.g == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for x, v in rows if x == g)


# 11: shards


def check_laws(got, rows, n_shards):
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and all(0 <= r.shard < n_shards for r in got)
    assert max(sizes.get(j, 0) for j in range(n_shards)) - min(sizes.get(j, 0) for j in range(n_shards)) <= 1
    for j in sizes:
        assert sorted(r.slot for r in got if r.shard == j) == list(range(sizes[j]))
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want and all(r.law == "rows" and r.grown_shard is None for r in got)


def test_shards_keep_copies_together(spark):
    rng, rows = random.Random(4), []
    for size in [2] * 40 + [3] * 15 + [7] * 6 + [12] * 3:
        rows += [f"text {len(rows)} é"] * size
    rows += [f"alone {i}" for i in range(150)] + [None, None, ""]
    rng.shuffle(rows)
    rows = [(i, t, "en") for i, t in enumerate(rows)]
    got = shards.shard_documents(docs(spark, rows), 16).collect()
    check_laws(got, rows, 16)
    at = {r.doc_id: r.shard for r in got}
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t].append(at[i])
    split = [g for t, g in groups.items() if t is not None and len(set(g)) > 1]
    assert len(split) <= 3  # shards of 22 or 23 rows leave little room for groups of 12


def test_shards_of_a_hot_text(spark):
    """A third of the rows are equal: they fill as few shards as can hold them, near the least number of cut pairs."""
    rows = [(i % 50 if i % 7 else None, "hot" if i % 3 == 0 else f"t{i // 4}" if i % 2 else f"u{i}", "en") for i in range(600)]
    got = shards.shard_documents(docs(spark, rows), 10).collect()
    check_laws(got, rows, 10)
    hot = Counter(r.shard for r in got if r.text_crc32 == zlib.crc32(b"hot"))
    pairs = sum(n * (n - 1) // 2 for n in hot.values())
    best = sum(n * (n - 1) // 2 for n in [60, 60, 60, 20])
    assert len(hot) <= math.ceil(200 / 60) + 1 and pairs >= 0.75 * best


def test_shards_edges(spark):
    assert shards.shard_documents(docs(spark, []), 5).count() == 0
    rows = [(1, "x" * 300_000, "en"), (1, "x" * 300_000, "en"), (None, None, None)]
    check_laws(shards.shard_documents(docs(spark, rows), 5).collect(), rows, 5)
    with pytest.raises(ValueError):
        shards.balance(spark.range(1).withColumnRenamed("id", "row"), spark.range(0), 0)


def test_shards_of_links_between_several(spark):
    """Rows in several links each: two dense communities joined by one link end up apart, with few links cut."""
    members = [(r, f"l{k}") for k, pair in enumerate([(a, b) for c in (range(0, 20), range(20, 40)) for a in c for b in c if a < b and (a * 7 + b) % 3 == 0] + [(0, 20)]) for r in pair]
    nodes = spark.range(40).withColumnRenamed("id", "row").repartition(2)
    got = {r.row: r.shard for r in shards.balance(nodes, spark.createDataFrame(members, "row long, link string"), 2).collect()}
    assert Counter(got.values()) == {0: 20, 1: 20}
    ends = defaultdict(set)
    for r, link in members:
        ends[link].add(got[r])
    cut = sum(len(s) > 1 for s in ends.values())
    assert cut <= 0.6 * len(ends)  # a random halving cuts about half; capacity swaps alone may not separate communities


def test_accepted_never_overfills():
    rng = np.random.default_rng(1)
    for _ in range(50):
        wants, room = rng.integers(0, 30, (6, 6)).astype(float), rng.integers(-3, 20, 6)
        np.fill_diagonal(wants, 0)
        may = shards.accepted(wants, room)
        assert (may <= wants + 1e-9).all() and (may.sum(axis=0) <= np.maximum(room, 0) + may.sum(axis=1) + 1e-6).all()


# 12: hard negatives


def brute_negatives(rows, positives=5, negatives_=5):
    ready = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ready[i, tuple(v), label] = (i, math.fmod(label + 1, 10) if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
    out = set()
    for a, la, va in [r for r in ready.values() if r[0] % 100 == 0]:
        scored = [(-sum(x * y for x, y in zip(va, v)), i, label) for i, label, v in ready.values()]
        same = sorted({(s, i) for s, i, label in scored if label == la and i != a})[:positives]
        for p, pid in same:
            fits = sorted({(s, i) for s, i, label in scored if label != la and 80 * -p <= 100 * -s <= 100 * -p})[:negatives_]
            out |= {(a, pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(fits)}
    return out


VECTORS = "vec_id long, embedding array<float>, label int, id string, rank string"


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, v, label, "clash", "clash") for i, v, label in rows], VECTORS)
    return negatives.mine(negatives.prepare(df), "id % 100 = 0", "if(id % 7 = 0, (label + 1) % 10, label)", **more)


def test_negatives_against_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, [rng.choice([0.5, 0.25, -0.125, rng.random()]) for _ in range(6)], rng.randint(0, 3)) for i in range(700)]
    rows += [(i, [0.5] * 6, i % 3) for i in range(700, 1000)]  # many equal vectors
    rows += [(1001, None, 1), (1002, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (1003, [float("nan")] * 6, 1), (1004, [float("inf")] * 6, 0), (1005, [1.0] * 6, None), (None, [1.0] * 6, 1), (1006, [0.75] * 3, 2), (1007, [], 0), *rows[:20]]
    monkeypatch.setattr(negatives, "BLOCK", 4)  # several blocks of anchors and streams of rows
    monkeypatch.setattr(negatives, "CHUNK", 100)
    got = [tuple(r) for r in mined(spark, rows, parts=6).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows)


def test_negatives_edges(spark):
    assert mined(spark, []).count() == 0 and mined(spark, [(5, [1.0], 1)]).count() == 0 and mined(spark, [(0, [1.0], 1)]).count() == 0
    got = mined(spark, [(0, [3e4], 3), (1, [1e6], 4), (2, [9e5], 4), (3, [1e30], 4), (4, [8e5], 2), (100, [3e4], 4)]).collect()  # beyond 2**53; 1e30 takes no part
    assert {r.anchor_id for r in got} == {0, 100} or {r.anchor_id for r in got} == {100}
    assert all(r.negative_score <= r.positive_score and 5 * r.negative_score >= 4 * r.positive_score for r in got) and all(3 not in (r.negative_id, r.positive_id) for r in got)
    zero = negatives._scores(np.array([[1 << 30]]), np.array([[(1 << 30) + 1]]))
    assert zero.tolist() == [[(1 << 60) + (1 << 30)]]


# 13: Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    langs = defaultdict(list)
    for i, t, lang in rows:
        n = None if t is None else len(t)
        leaf = h(*map(enc, (i, "s", lang, n, t)))
        low = None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        changed = h(*map(enc, (i, "s", lang, n, low))) if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else leaf
        langs[lang].append(((i is not None, i or 0, leaf), i, leaf, changed))

    def tree(nodes):
        paths, at = [[] for _ in nodes], [[k] for k in range(len(nodes))]
        while len(nodes) > 1:
            runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
            for k, own in enumerate(at):
                for leaf in own:
                    paths[leaf].append(("".join(runs[k // 8][: k % 8]), "".join(runs[k // 8][k % 8 + 1 :])))
            at = [sum(at[k : k + 8], []) for k in range(0, len(at), 8)]
            nodes = [h(*r) for r in runs]
        return nodes[0], paths

    tops = {}
    for lang, found in langs.items():
        found.sort(key=lambda f: f[0])
        tops[lang] = tree([f[2] for f in found])
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    root, upper = tree([tops[x][0] for x in order])
    out = []
    for k, lang in enumerate(order):
        for (_, i, leaf, folded), path in zip(langs[lang], tops[lang][1]):
            path = path + upper[k]
            for a, b in path:
                folded = h(a, folded, b)
            out.append((i, leaf, tops[lang][0], root, h(*(a + b for a, b in path)), folded, folded == root))
    return out


@pytest.mark.parametrize("size", [1, 9, 700])
def test_manifest_against_brute_force(spark, size, monkeypatch):
    rng = random.Random(size)
    rows = [(rng.choice([None, i, i, i, 7]) if size > 9 else i, rng.choice([None, "", "ABC É", f"Text {i}", "same", "Z" * 50_000 if i % 100 == 0 else "q"]), rng.choice(["en", "en", "en", "fr", None, "é", "z"]) if size > 1 else None) for i in range(size)]
    rows += rows[: size // 10]  # repeated rows
    if size > 9:
        monkeypatch.setattr(merkle, "LEVELS", 1)
        monkeypatch.setattr(merkle, "BUCKET", 8)  # many buckets, several outer levels
    key = lambda r: tuple(map(str, r))
    got = [tuple(r) for r in merkle.manifest(docs(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(brute_manifest(rows), key=key)


def test_manifest_of_many_leaves(spark):
    """More than one whole bucket of 4,096, and languages without end."""
    rows = [(i, f"T{i}", "en" if i % 4 else f"l{i % 60}") for i in range(7000)]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in merkle.manifest(docs(spark, rows)).collect()), key=key) == sorted(brute_manifest(rows), key=key)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(docs(spark, [])).collect() == []


def test_links_of_many_members_are_dealt_in_parts(spark, monkeypatch):
    rows = [(i, "hot" if i % 2 else f"t{i // 6}", "en") for i in range(240)]
    df = docs(spark, rows).coalesce(1)
    whole = sorted(map(tuple, shards.shard_documents(df, 6).collect()))
    monkeypatch.setattr(shards, "BIG", 7)
    got = shards.shard_documents(df, 6).collect()
    check_laws(got, rows, 6)
    assert sorted(map(tuple, got)) == whole
