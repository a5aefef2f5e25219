"""Benchmark decontamination by latent semantic retrieval, confirmed by weighted longest common subsequences.

1. The terms are the benchmark's words; every document is cut into blocks of 32 words. Pass one counts the blocks
   that hold each term, over all documents. Items are dealt to groups of at most GROUP blocks (a longer item is a group of its own), and each group
   has a latent space of its own, so that its rank is bounded by RANK + GROUP whatever the benchmark's size, and memory
   grows in proportion to the items. A group's features are its terms in at most COMMON of the blocks and each of its items' RAREST rarest ones.
2. Pass two sketches the covariance of the TF-IDF blocks of all documents for every group, C = A'A, as Y = C W with a random W, block by block on
   the executors (A is never held; Y has features x rank numbers, whatever the corpus). The items' passages
   join A with the weight of the whole corpus, so that the leading space holds them. The randomised
   decomposition C ~ Y (W'Y)^-1 Y' gives the leading right singular vectors.
3. Pass three projects all passages (two neighbouring blocks) with two of a group's features or more (one, if some item has but one) and the items' passages into its space and takes
   pairs of cosine COSINE or more, a passage's length being that of all its features, so that what the space
   doesn't hold lowers it. Each is confirmed in the words around the passage: the longest common subsequence with
   the item, weighted by inverse document frequency, must cover FULL of the item's weight, or PART of it while
   the item's answer (its last ANSWER words) is covered to FULL as well. The bag overlap, an upper bound, is tried first.

Benchmarks of more than ITEMS items are searched in turns, each with its own passes.

Defined results: one row for each pair of a document and an item found in it (documents without any have
none); score is the best coverage. Null texts, ids and items, items without words and empty tables give no rows;
repeated rows give one. Columns other than ids and texts play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazmill.llm.common import Words, blocks_of, gathered, released, slices, sum_blocks, texts_of

HALF, RANK, GROUP, COSINE, FULL, PART, ANSWER, ITEMS = 32, 64, 128, 0.35, 0.75, 0.5, 8, 2000
COMMON, RAREST = 0.002, 6
_SLICE = 1 << 20
_PARTS = 64


@dataclass
class Group:
    """Some items: their ids and words, each term's feature (-1: none), the singular vectors, and the items' passages in the latent space."""

    ids: list[int]
    items: list[np.ndarray]
    feature: np.ndarray
    vectors: np.ndarray | None = None
    passages: np.ndarray | None = None
    passage_item: np.ndarray | None = None
    least: int = 1

    @property
    def size(self) -> int:
        return int(self.feature.max()) + 1


@dataclass
class Space:
    """Terms (ascending word hashes), their weights and the groups."""

    terms: np.ndarray
    idf: np.ndarray
    groups: list[Group]


def term_of(h: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Each word's term, -1 for none."""
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    return np.where(terms[at] == h, at, -1)


def choose_features(terms: np.ndarray, share: np.ndarray, items: list[np.ndarray]) -> np.ndarray:
    """Each term's feature among those of the items, -1 for none."""
    kept = np.zeros(len(terms), dtype=bool)
    for item in items:
        own = np.unique(term_of(item, terms))
        kept[own[share[own] <= COMMON]] = True
        kept[own[np.argsort(share[own], kind="stable")[:RAREST]]] = True
    return np.where(kept, np.cumsum(kept) - 1, -1)


def blocks(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each word's block, and each block's text."""
    counts = np.diff(words.first)
    per = -(-counts // HALF)
    base = np.cumsum(per) - per
    place = np.arange(len(words.hash)) - np.repeat(words.first[:-1], counts)
    return np.repeat(base, counts) + place // HALF, np.repeat(np.arange(len(counts)), per)


class Slice:
    """A slice's words, the block of each, the text of each block, and the words that are terms."""

    def __init__(self, texts: pa.Array, space: Space):
        self.words = Words(texts)
        self.block, self.text_of = blocks(self.words)
        term = term_of(self.words.hash, space.terms)
        hit = np.flatnonzero(term >= 0)
        self.term, self.term_block, self.term_weight = term[hit], self.block[hit], space.idf[term[hit]].astype(np.float32)

    def rows(self, group: Group) -> Rows:
        f = group.feature[self.term]
        own = np.flatnonzero(f >= 0)
        return Rows(self.text_of, f[own], self.term_block[own], self.term_weight[own])


@dataclass
class Rows:
    """For the words that are features of a group: feature, block and weight; and the text of each block."""

    text_of: np.ndarray
    f: np.ndarray
    b: np.ndarray
    w: np.ndarray


def block_frequencies(docs: DataFrame, terms) -> np.ndarray:
    """How many blocks hold each term, then how many blocks there are."""
    d = len(terms.value)
    width = -(-(d + 1) // _PARTS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * _PARTS, dtype=np.int64)
        for batch in slices(batches, "text", _SLICE):
            words = Words(texts_of(batch.column("text")))
            block, text_of = blocks(words)
            f = term_of(words.hash, terms.value)
            hit = np.flatnonzero(f >= 0)
            pairs = np.unique(block[hit] * d + f[hit])
            total[:d] += np.bincount(pairs % d, minlength=d)
            total[d] += len(text_of)
        yield blocks_of(total, _PARTS)

    return gathered(sum_blocks(docs.mapInArrow(released(counted), "block int, data binary"), "<i8"), "<i8", _PARTS, width)[: d + 1]


def _sums(f: np.ndarray, block: np.ndarray, weight: np.ndarray, table: np.ndarray, count: int) -> np.ndarray:
    """For each block the sum of its words' weighted table rows; words in order of block."""
    out = np.zeros((count, table.shape[1]), dtype=np.float32)
    if len(f):
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        out[block[first]] = np.add.reduceat(table[f] * weight[:, None], first, axis=0)
    return out


def _apply(rows: Rows, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, their rows of A'(A W)) for a slice's blocks, each of unit length."""
    count = len(rows.text_of)
    length = np.sqrt(np.bincount(rows.b, weights=rows.w * rows.w, minlength=count))
    w = (rows.w / np.maximum(length[rows.b], 1e-9)).astype(np.float32)
    image = _sums(rows.f, rows.b, w, test, count)
    order = np.argsort(rows.f, kind="stable")
    f = rows.f[order]
    first = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
    return f[first], np.add.reduceat(image[rows.b[order]] * w[order][:, None], first, axis=0)


def random_test(seed: int, d: int, rank: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((d, rank)).astype(np.float32)


def group_rank(group: Group, blocks_: int, rank: int) -> int:
    """Room for all of a group's blocks beside the corpus's leading directions."""
    return min(group.size, rank + blocks_)


def covariance_sketch(docs: DataFrame, space, seeds: list[int], ranks: list[int]) -> list[np.ndarray]:
    """C W of each group, for the TF-IDF blocks of all documents."""
    sizes = [g.size for g in space.value.groups]
    widths = [-(-d // _PARTS) for d in sizes]

    @released
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = [random_test(s, d, r) for s, d, r in zip(seeds, sizes, ranks)]
        totals = [np.zeros((w * _PARTS, r)) for w, r in zip(widths, ranks)]
        for batch in slices(batches, "text", _SLICE):
            cut = Slice(texts_of(batch.column("text")), space.value)
            for group, test, total in zip(space.value.groups, tests, totals):
                rows = cut.rows(group)
                if len(rows.f):
                    f, more = _apply(rows, test)
                    total[f] += more
        for k, total in enumerate(totals):
            part = blocks_of(total.astype("<f4").reshape(-1), _PARTS)
            yield pa.RecordBatch.from_arrays([pc.add(part.column(0), pa.scalar(k * _PARTS, pa.int32())), part.column(1)], ["block", "data"])

    out = [np.zeros((_PARTS, w * r), dtype=np.float64) for w, r in zip(widths, ranks)]
    for block, data in sum_blocks(docs.mapInArrow(sketched, "block int, data binary"), "<f4").collect():
        out[block // _PARTS][block % _PARTS] = np.frombuffer(bytes(data), dtype="<f4")
    return [y.reshape(-1, r)[:d] for y, r, d in zip(out, ranks, sizes)]


def leading_vectors(w: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Eigenvectors of C from the sketch Y = C W: C ~ Y (W'Y)^-1 Y'."""
    shift = np.sqrt(len(y)) * np.finfo(float).eps * np.linalg.norm(y, 2)
    y = y + shift * w
    core = w.T @ y
    values, basis = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-12
    root = basis[:, good] / np.sqrt(values[good])
    vectors, sizes, _ = np.linalg.svd(y @ root, full_matrices=False)
    return vectors[:, sizes > sizes[0] * 1e-6].astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def passages_of(sums: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Each block with the next one of its text."""
    out = sums.copy()
    same = np.flatnonzero(text_of[1:] == text_of[:-1])
    out[same] += sums[same + 1]
    return out


def coverage(item: np.ndarray, weight: np.ndarray, region: np.ndarray) -> float:
    """The share of the item's weight in its heaviest common subsequence with the region."""
    best = np.zeros(len(region) + 1)
    for h, w in zip(item, weight):
        better = best[:-1] + np.where(region == h, w, 0)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], better))
    return float(best[-1] / weight.sum())


def bag_overlap(item: np.ndarray, weight: np.ndarray, region: np.ndarray) -> float:
    return float(weight[np.isin(item, region)].sum() / weight.sum())


def confirm(item: np.ndarray, weight: np.ndarray, region: np.ndarray) -> float:
    """The coverage if it or, for less, the answer's confirms the find, else 0."""
    if bag_overlap(item, weight, region) < PART:
        return 0.0
    got = coverage(item, weight, region)
    if got >= FULL or got >= PART and coverage(item[-ANSWER:], weight[-ANSWER:], region) >= FULL:
        return got
    return 0.0


def _found_in(cut: Slice, group: Group, idf: np.ndarray, weights: list[np.ndarray], best: dict) -> None:
    """Puts the confirmed pairs (text, item id) of a slice and a group into best, with their coverage."""
    rows, words, text_of = cut.rows(group), cut.words, cut.text_of
    held = passages_of(np.bincount(rows.b, minlength=len(text_of))[:, None], text_of)[:, 0]
    near = np.flatnonzero(held >= group.least)
    if not len(near):
        return
    use = np.zeros(len(text_of) + 1, dtype=bool)
    use[near], use[near + 1] = True, True
    use = use[rows.b]
    sums = passages_of(_sums(rows.f[use], rows.b[use], rows.w[use], group.vectors, len(text_of)), text_of)
    length = np.sqrt(passages_of(np.bincount(rows.b, weights=rows.w * rows.w, minlength=len(text_of))[:, None], text_of))
    opened = np.searchsorted(cut.block, np.arange(len(text_of)))
    for at in range(0, len(near), 1 << 14):
        some = near[at : at + (1 << 14)]
        cosine = sums[some] @ group.passages.T / np.maximum(length[some], 1e-9)
        p, q = np.nonzero(cosine >= COSINE)
        for i, k in {(int(i), int(k)) for i, k in zip(some[p], group.passage_item[q])}:
            t, item, name = text_of[i], group.items[k], group.ids[k]
            if best.get((t, name), 0) >= 0.999:
                continue
            lo = max(words.first[t], opened[i] - len(item))
            hi = min(words.first[t + 1], opened[i] + 2 * HALF + len(item))
            if (score := confirm(item, weights[k], words.hash[lo:hi])) > best.get((t, name), 0):
                best[t, name] = score


def _search(docs: DataFrame, space) -> DataFrame:
    @released
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        weights = [[s.idf[term_of(x, s.terms)] for x in g.items] for g in s.groups]
        for batch in slices(batches, "text", _SLICE):
            cut, best = Slice(texts_of(batch.column("text")), s), {}
            for group, own in zip(s.groups, weights):
                _found_in(cut, group, s.idf, own, best)
            if best:
                ids = batch.column("doc_id").to_pylist()
                out = [(ids[t], name, min(1.0, v)) for (t, name), v in best.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "score"])

    return docs.mapInArrow(found, "doc_id long, item_id long, score double")


def fit_group(group: Group, cut: Slice, y: np.ndarray, test: np.ndarray, corpus: int) -> None:
    """Complete a group: vectors from the sketch with its items joined to it, then the items' passages. cut: the items' texts."""
    rows = cut.rows(group)
    if len(rows.f):
        f, more = _apply(rows, test)
        y[f] += more * max(1.0, corpus / len(rows.text_of))
    group.vectors = leading_vectors(test.astype(np.float64), y)
    sums = passages_of(_sums(rows.f, rows.b, rows.w, group.vectors, len(rows.text_of)), rows.text_of)
    place: dict[int, int] = {}
    owner = np.array([place.setdefault(int(t), len(place)) for t in rows.text_of])
    whole = np.append(rows.text_of[1:] == rows.text_of[:-1], False)  # a last block counts alone only if it is the only one
    whole |= np.append(True, rows.text_of[1:] != rows.text_of[:-1])
    group.passages, group.passage_item = _unit(sums)[whole], owner[whole]
    held = passages_of(np.bincount(rows.b, minlength=len(rows.text_of))[:, None], rows.text_of)[whole, 0]
    group.least = max(1, min(2, int(held.min())))


def dealt(sizes: list[int], most: int = GROUP) -> list[list[int]]:
    """Items, by their numbers of blocks, in groups of at most so many blocks."""
    out: list[list[int]] = []
    room = 0
    for k, n in enumerate(sizes):
        if not out or n > room:
            out.append([])
            room = most
        out[-1].append(k)
        room -= n
    return out


def find_leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", rank: int = RANK, seed: int = 7) -> DataFrame:
    """doc_id, item_id, score."""
    spark = df.sparkSession
    share = spark.sparkContext.broadcast
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    turns = -(-items.count() // ITEMS)
    out = spark.createDataFrame([], "doc_id long, item_id long, score double")
    for turn in range(turns):
        some = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == turn).orderBy("item_id", "text").collect()
        words = Words(texts_of(pa.array([r.text for r in some], pa.large_string())))
        held = [(r.item_id, r.text, words.hash[a:b]) for r, a, b in zip(some, words.first[:-1], words.first[1:]) if b > a]
        if not held:
            continue
        terms = np.unique(words.hash)
        n = block_frequencies(docs, share(terms))
        if not n[-1]:
            continue
        seen = n[:-1] / n[-1]
        parts = [[held[k] for k in part] for part in dealt([-(-len(h) // HALF) for _, _, h in held])]
        groups = [Group([i for i, _, _ in part], own, choose_features(terms, seen, own)) for part in parts for own in [[h for _, _, h in part]]]
        space = Space(terms, np.log((2 + n[-1]) / (1 + n[:-1])), groups)
        cuts = [Slice(texts_of(pa.array([t for _, t, _ in part], pa.large_string())), space) for part in parts]
        ranks, seeds = [group_rank(g, len(c.text_of), rank) for g, c in zip(groups, cuts)], [seed + k for k in range(len(groups))]
        sketches = covariance_sketch(docs, share(space), seeds, ranks)
        for group, cut, y, s, r in zip(groups, cuts, sketches, seeds, ranks):
            fit_group(group, cut, y, random_test(s, group.size, r), int(n[-1]))
        out = out.union(_search(docs, share(space)))
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))
