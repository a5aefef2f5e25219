"""Token counts under a byte-level BPE of the tokenizers library, with overlap resynchronisation for huge documents.

A document of more than ``chunk`` characters is encoded as overlapping chunks with offsets. Two neighbours are spliced at a
stable position of their overlap: one where (1) a pre-token ends whatever surrounds it: white space after another character, or
after a letter or digit a character that is plainly neither its like nor white space (the splitting pattern takes letters with letters and
digits with digits only); (2) both encodings have a token boundary there; and (3) both give the same tokens from
there to the next such position. If no position qualifies, the overlap is widened (doubled) until one does; if it has come to
cover all of the left chunk that isn't counted yet, the chunk is doubled instead. Widenings look for stable positions before anything is encoded, so that a
text without any costs a few times its length, not its square.

A document of up to ``chunk`` characters is one chunk. Its pieces between white space (the same proof) are counted by the
library once each and remembered; the memo is emptied when it holds MEMO_BYTES, and when the worker turns to another operator. Texts
whose white space the proof doesn't cover go to the library whole. The proof is checked when the tokenizer is loaded: byte-level
splitting by its default pattern, no normaliser, no prefix space, added tokens without white space.

Defined results: a null text counts as empty (0 bytes, 0 tokens); special strings inside texts are
handled as the library does by default. Null ids and repeated rows pass through; other columns play no part; an empty table gives none.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazmill.llm.common import holds, released, slices, texts_of

CHUNK, OVERLAP, MEMO_BYTES, LONG = 8_192, 512, 64 << 20, 64
_UNPROVEN = re.compile(r"\s (?:\s|\Z)")
#: Letters that every version of Unicode in use knows as such, and what is neither letter nor digit nor white space to all of them.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u05d0-\u05ea\u0620-\u063a\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_MARK = "!-/:-@\\[-`{-~\u3001\u3002\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f"
_STABLE = re.compile(rf"(?<=\S)(?=[ \t\n\r])|(?<=[{_LETTER}])(?=[0-9{_MARK}])|(?<=[0-9])(?=[{_LETTER}{_MARK}])")
_loaded: dict[str, BpeCounter] = {}


class BpeCounter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        made = json.loads(self.lib.to_str())
        split = made["pre_tokenizer"] or {}
        if made["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in made["added_tokens"]):
            raise ValueError("boundaries aren't proven for this tokenizer")
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.held = 0

    def encode(self, texts: list[str]):
        return self.lib.encode_batch_fast(texts, add_special_tokens=False)

    def learn(self, missing: list[str]) -> dict[str, int]:
        """The tokens of a space followed by each piece. Of those that don't begin or end with white space many share a call."""
        out: dict[str, int] = {}
        plain = [p for p in missing if p and not p[0].isspace() and not p[-1].isspace()]
        single = [p for p in missing if not p or p[0].isspace() or p[-1].isspace()]
        for i in range(0, len(plain), 1000):
            some = plain[i : i + 1000]
            ids = np.array(self.encode([" " + " ".join(some)])[0].ids)
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(some) and at[0] == 0:
                out.update(zip(some, np.diff(np.append(at, len(ids))).tolist()))
            else:
                single += some
        if single:
            out.update((p, len(e.ids)) for p, e in zip(single, self.encode([" " + p for p in single])))
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, through the memo where cuts are proven."""
        if self.held > MEMO_BYTES:
            self.clear()
        out = np.zeros(len(texts), dtype=np.int64)
        plain = [i for i, t in enumerate(texts) if t and not _UNPROVEN.search(t)]
        rest = sorted({*range(len(texts))} - {*plain})
        if rest:
            out[rest] = [len(e.ids) for e in self.encode([texts[i] for i in rest])]
        cut = [texts[i].split(" ") for i in plain]
        heads = list(dict.fromkeys(c[0] for c in cut))  # these have no space before them
        head = {h: len(e.ids) for h, e in zip(heads, self.encode(heads))}
        tails = [p for c in cut for p in c[1:]]
        found = self.memo
        if missing := set(tails) - self.memo.keys():
            new = self.learn(list(missing))
            short = {p: n for p, n in new.items() if len(p) <= LONG}
            self.memo.update(short)
            self.held += sum(map(len, short)) + 110 * len(short)
            if len(short) < len(new):
                found = {p: self.memo[p] if p in self.memo else new[p] for p in set(tails)}
        counts = np.fromiter(map(found.__getitem__, tails), dtype=np.int64, count=len(tails))
        sums = np.append(0, np.cumsum(counts))
        ends = np.append(0, np.cumsum([len(c) - 1 for c in cut], dtype=np.int64))
        if plain:
            out[plain] = sums[ends[1:]] - sums[ends[:-1]] + np.array([head[c[0]] for c in cut])
        return out

    def count_huge(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        return splice(text, lambda parts: self.lib.encode_batch(parts, add_special_tokens=False), chunk, overlap)[0]


def counter(path: str) -> BpeCounter:
    if path not in _loaded:
        _loaded[path] = BpeCounter(path)
    holds("tokencount", _loaded.clear)
    return _loaded[path]


def _part(text: str, encode, a: int, b: int):
    e = encode([text[a:b]])[0]
    return a, b, np.array(e.ids, dtype=np.int64), np.array([o[0] for o in e.offsets], dtype=np.int64) + a


def _stable(text: str, lo: int, hi: int) -> list[int]:
    """The stable positions between two places."""
    base = max(0, lo - 1)
    return [base + m.start() for m in _STABLE.finditer(text[base : hi + 1]) if lo < base + m.start() < hi]


def _seam(text: str, left, right) -> int | None:
    """A stable common boundary in the overlap, nearest to its middle."""
    lo, hi = right[0], left[1]
    both = [p for p in _stable(text, lo, hi) if all(len(s) > (k := np.searchsorted(s, p)) and s[k] == p for s in (left[3], right[3]))]
    for k in sorted(range(len(both) - 1), key=lambda k: abs(both[k] - (lo + hi) / 2)):
        p, q = both[k], both[k + 1]
        (li, lj), (ri, rj) = np.searchsorted(left[3], (p, q)), np.searchsorted(right[3], (p, q))
        if np.array_equal(left[2][li:lj], right[2][ri:rj]):
            return p
    return None


def splice(text: str, encode, chunk: int, overlap: int) -> tuple[int, int]:
    """Token count of a text encoded as overlapping chunks, and how often an overlap or chunk was widened. encode: texts to encodings with offsets."""
    total, widened, n = 0, 0, len(text)
    left, begin = _part(text, encode, 0, min(chunk, n)), 0
    while left[1] < n:
        room, seam = overlap, None
        while room < left[1] - begin:
            if len(_stable(text, left[1] - room, left[1])) > 1:
                right = _part(text, encode, left[1] - room, min(n, left[1] - room + max(chunk, 2 * room)))
                if (seam := _seam(text, left, right)) is not None:
                    break
            room, widened = room * 2, widened + 1
        if seam is None:
            left, widened = _part(text, encode, left[0], min(n, 2 * left[1] - left[0])), widened + 1
            continue
        total += int(np.searchsorted(left[3], seam) - np.searchsorted(left[3], begin))
        left, begin = right, seam
    return total + int(len(left[3]) - np.searchsorted(left[3], begin)), widened


def count_tokens(df: DataFrame, tokenizer: str, limit: int = 512, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = counter(tokenizer)
        for batch in slices(batches, "text", 1 << 20):
            texts = texts_of(batch.column("text"))
            values = texts.to_pylist()
            huge = [i for i, t in enumerate(values) if len(t) > chunk]
            n = bpe.count(["" if len(t) > chunk else t for t in values])
            for i in huge:
                n[i] = bpe.count_huge(values[i], chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n), pa.array(n > limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = rows.select("key").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return rows.mapInArrow(released(counted, "tokencount"), schema).withColumnRenamed("key", key)
