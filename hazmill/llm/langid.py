"""Language identification with bit-sliced Bloom filters over character n-grams.

For each language of the training rows, the letter trigrams (with word edges) that make up at
least ``min_share`` of its trigrams are kept: at most 1/min_share of them, whatever the corpus.
One bit-sliced Bloom filter holds all languages: each slot has a bit for every language, so that
the slots of one trigram, and-ed, are the mask of all languages that may contain it. A text's
trigrams are popcounted for each language, the counts are corrected for the false positives
that the slice's fill rate predicts, and the largest decides.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Ties go to the
language with more training trigrams, then to the first name. Rows with a null language, null
ids and repeated rows are predicted like any other; without any training row all texts are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazmill.llm.common import checkpoint, free, mix, released, slices, texts_of

UNKNOWN = "und"
_FLUSH = 1 << 20
_alpha = None


def _letters(codes: np.ndarray) -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = np.array([chr(i).isalpha() for i in range(1 << 16)])
    inside = _alpha[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        inside[high] = [chr(c).isalpha() for c in codes[high]]
    return inside


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of letters and word edges (0), 21 bits a letter, and how many each text has. Those with an edge amid are left out."""
    low = [t.lower() for t in texts]
    joined = "\0" + "\0".join(low) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    owner = np.append(owner, len(low) - 1)
    inside = _letters(codes)
    codes = np.where(inside, codes, 0).astype(np.uint64)
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    keep[0] = True
    codes, owner = codes[keep], owner[keep]
    if len(codes) < 3:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    middle = codes[1:-1]
    full = middle != 0
    grams = (codes[:-2] << np.uint64(42)) | (middle << np.uint64(21)) | codes[2:]
    return grams[full], np.bincount(owner[1:-1][full], minlength=len(texts))


@dataclass
class LanguageFilters:
    """Languages in order of preference, the sliced filter (slots x 64-bit words) and each slice's false-positive rate."""

    languages: list[str]
    slots: np.ndarray
    hashes: int
    false_rate: np.ndarray

    def positions(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        h = mix(grams)
        step = (h >> np.uint64(32)) | np.uint64(1)
        for _ in range(self.hashes):
            yield (h & np.uint64(len(self.slots) - 1)).astype(np.int64)
            h = h + step

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that may contain it, as bits."""
        out = None
        for at in self.positions(grams):
            out = self.slots[at] if out is None else out & self.slots[at]
        return out

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        grams, counts = trigrams(texts)
        n = len(self.languages)
        if not n:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        masks = self.masks(grams)
        ends = np.append(0, np.cumsum(counts))
        found = np.zeros((len(texts), n))
        for k in range(n):
            bits = (masks[:, k >> 6] >> np.uint64(k & 63)) & np.uint64(1)
            sums = np.append(0, np.cumsum(bits, dtype=np.int64))
            hits = sums[ends[1:]] - sums[ends[:-1]]
            found[:, k] = (hits - counts * self.false_rate[k]) / (1 - self.false_rate[k])
        best = found.argmax(axis=1)
        score = np.clip(found.max(axis=1) / np.maximum(counts, 1), 0, 1)
        return [self.languages[b] if c else UNKNOWN for b, c in zip(best, counts)], np.where(counts > 0, score, 0.0)


def count_trigrams(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, gram, n over all rows; gram -1 carries a language's total."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(pairs):
            grams = np.concatenate([p[0] for p in pairs])
            order = np.argsort(grams, kind="stable")
            grams, n = grams[order], np.concatenate([p[1] for p in pairs])[order]
            at = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
            return grams[at], np.add.reduceat(n, at) if len(at) else n

        def out(name):
            grams, n = merged(held.pop(name))
            rows = [pa.array([name] * (len(grams) + 1)), pa.array(np.append(grams.astype(np.int64), -1)), pa.array(np.append(n, n.sum()))]
            return pa.RecordBatch.from_arrays(rows, ["lang", "gram", "n"])

        for batch in slices(batches, text):
            names, texts = batch.column(lang).to_pylist(), texts_of(batch.column(text)).to_pylist()
            for name in dict.fromkeys(names):
                grams, _ = trigrams([t for t, x in zip(texts, names) if x == name])
                held.setdefault(name, []).append(np.unique(grams, return_counts=True))
                if len(held[name]) >= 16:
                    held[name] = [merged(held[name])]
            if sum(len(p[0]) for pairs in held.values() for p in pairs) > _FLUSH:
                for name in list(held):
                    yield out(name)
        for name in list(held):
            yield out(name)

    rows = df.select(F.col(text).cast("string").alias(text), F.col(lang).cast("string").alias(lang)).filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    return rows.mapInArrow(released(counted), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text: str = "text", lang: str = "lang", min_share: float = 2e-5, hashes: int = 4, bits_per_gram: int = 16) -> LanguageFilters:
    """Learn from all rows whose text and language are given. What reaches the driver is at most 1/min_share trigrams a language."""
    counts = checkpoint(count_trigrams(df, text, lang))
    totals = {r.lang: r.n for r in counts.filter("gram = -1").collect()}
    languages = sorted(totals, key=lambda x: (-totals[x], x))
    total = F.broadcast(counts.filter("gram = -1").select("lang", F.col("n").alias("total")))
    kept = counts.filter("gram >= 0").join(total, "lang").filter(F.col("n") >= F.lit(min_share) * F.col("total")).select("lang", "gram")
    grams: dict[str, list[int]] = {x: [] for x in languages}
    for name, gram in kept.collect():
        grams[name].append(gram)
    most = max([1, *map(len, grams.values())])
    size = 1 << max(10, (bits_per_gram * most - 1).bit_length())
    model = LanguageFilters(languages, np.zeros((size, (len(languages) + 63) // 64 or 1), dtype=np.uint64), hashes, np.zeros(len(languages)))
    for k, name in enumerate(languages):
        own = np.array(grams[name], dtype=np.int64).astype(np.uint64)
        slot, bit = k >> 6, np.uint64(1 << (k & 63))
        for at in model.positions(own):
            model.slots[at, slot] |= bit
        fill = np.count_nonzero(model.slots[:, slot] & bit) / size
        model.false_rate[k] = fill**hashes
    return model


def predict(df: DataFrame, model: LanguageFilters, keep: list[str], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns to keep, with lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    inner = free("__text", keep)
    rows = df.select(*keep, F.col(text).cast("string").alias(inner))
    schema = df.select(*keep).schema.add(names[0], "string").add(names[1], "double")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, inner):
            languages, scores = shared.value.judge(texts_of(batch.column(inner)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(languages, pa.string()), pa.array(scores)], [*keep, *names])

    return rows.mapInArrow(released(judged), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the id's checksum puts the row among the held-out ones."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all rows, learnt from those that aren't held out."""
    model = fit(df.filter(~held_out()), **options)
    return predict(df.select("doc_id", held_out().alias("held_out"), "text"), model, ["doc_id", "held_out"])
