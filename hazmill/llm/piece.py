"""SentencePiece BPE encoding by a score-ordered agenda of adjacent symbol pairs, checked against the library.

A text gets a space in front, spaces become U+2581, and its characters are the first symbols. Of all
adjacent pairs whose join is a piece, the agenda takes the one with the highest score (the
leftmost among equals), joins it and enters the pairs that it makes, until none is left; characters
outside the vocabulary become byte pieces. As no piece holds U+2581 after another character (checked when
the model is loaded), words are independent: the agenda runs for each distinct word of a batch once, in
lock-step over all short words as arrays, and with a heap for those of over ``LONG`` symbols. Arrow cuts and numbers the words.
A memo of words serves the batches of a query; it is emptied when it holds MEMO_BYTES, and when the worker turns to another operator.
Every batch is encoded by the sentencepiece library too, and a document whose ids differ ends the job with its text's digest
(``strict=False`` returns it, with ``agrees`` false).

Defined results: a null text is empty (begin and end ids only). Null ids and repeated rows pass through; other columns play no part; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazmill.llm.common import gather, holds, released, slices, texts_of

SPACE, LONG, MEMO_BYTES = "▁", 48, 64 << 20
_NONE = 1 << 40
_RUNS = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")
_loaded: dict[str, PieceBpe] = {}


class PieceBpe:
    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.lib, self.lib.get_piece_size()
        normal = [i for i in range(n) if not (lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.pieces = {lib.id_to_piece(i): i for i in normal}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces):
            raise ValueError("a piece holds a space after another character: words depend on each other")
        symbols = dict(self.pieces)
        for p in self.pieces:
            for c in p:
                symbols.setdefault(c, n + len(symbols))
        self.symbol_of = symbols
        self.symbol_at = np.full(0x110000, -1, dtype=np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.symbol_at[ord(c)] = i
        score = {p: lib.get_score(i) for p, i in self.pieces.items()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.width = np.int64(max(symbols.values()) + 2)
        self.joins = {}
        for p, i in self.pieces.items():
            for k in range(1, len(p)):
                if p[:k] in symbols and p[k:] in symbols:
                    self.joins[symbols[p[:k]] * int(self.width) + symbols[p[k:]]] = (order[score[p]], i)
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = lib.unk_id()
        self.falls_back = min(self.bytes) >= 0 and self.bytes[0] != self.unknown
        self.piece_ids = np.zeros(int(self.width), dtype=bool)
        self.piece_ids[[*self.pieces.values()]] = True
        size = 1 << (4 * len(self.joins)).bit_length()
        self.table = np.full((size, 3), -1, dtype=np.int64)
        for key, (r, i) in self.joins.items():
            at = self._place(key, size)
            while self.table[at, 0] >= 0:
                at = (at + 1) % size
            self.table[at] = (key, r, i)
        self.clear()

    def clear(self) -> None:
        """Forget all words. A word of the memo is named without its leading U+2581, if it holds no other."""
        self.memo: dict[str, int] = {}
        self.ids, self.ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        self.count, self.total, self.held = 0, 0, 0

    @staticmethod
    def _place(key, size):
        return ((key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 20) % size

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair the rank of its join (a large number if there is none) and the join's id."""
        key = np.where((left >= 0) & (right >= 0), left * self.width + right, -2)
        size = len(self.table)
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) % size
        rank, made = np.full(len(key), 1 << 40, dtype=np.int64), np.full(len(key), -1, dtype=np.int64)
        todo = np.flatnonzero(key >= 0)
        while len(todo):
            got = self.table[at[todo]]
            hit = got[:, 0] == key[todo]
            rank[todo[hit]], made[todo[hit]] = got[hit, 1], got[hit, 2]
            todo = todo[~hit & (got[:, 0] >= 0)]
            at[todo] = (at[todo] + 1) % size
        return rank, made

    def finish(self, symbols: list[tuple[int, str]]) -> list[int]:
        """Ids of the final symbols: those outside the vocabulary as bytes."""
        out = []
        for s, c in symbols:
            if s >= 0 and self.piece_ids[s]:
                out.append(s)
            elif self.falls_back:
                out += [self.bytes[b] for b in c.encode("utf-8", "replace")]
            else:
                out.append(self.unknown)
        return out

    def heap_agenda(self, word: str) -> list[int]:
        """One word, with a heap of (rank, place)."""
        sym = [self.symbol_of.get(c, -1) for c in word]
        text, n = list(word), len(word)
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        alive, heap, width = [True] * n, [], int(self.width)

        def enter(i: int) -> None:
            j = nxt[i] if i >= 0 else -1
            if j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (got := self.joins.get(sym[i] * width + sym[j])):
                heapq.heappush(heap, (got[0], i, sym[i], j, sym[j], got[1]))

        for i in range(n - 1):
            enter(i)
        while heap:
            _, i, a, j, b, made = heapq.heappop(heap)
            if not (alive[i] and alive[j] and sym[i] == a and sym[j] == b and nxt[i] == j):
                continue
            sym[i], text[i], alive[j] = made, text[i] + text[j], False
            nxt[i] = nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            enter(prv[i])
            enter(i)
        return self.finish([(sym[i], text[i]) for i in range(n) if alive[i]])

    def lock_step_arrays(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many words at once: in each round every word's agenda gives its best pair. All ids, and each word's number of them."""
        flat = "".join(words)
        sym = self.symbol_at[np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int64)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        char = np.arange(len(flat))
        rank, made = np.full(len(sym), _NONE, dtype=np.int64), np.full(len(sym), -1, dtype=np.int64)

        def refresh(at: np.ndarray) -> None:
            rank[at], made[at] = _NONE, -1
            at = at[at + 1 < len(sym)]
            at = at[owner[at] == owner[at + 1]]
            rank[at], made[at] = self.look_up(sym[at], sym[at + 1])

        refresh(char)
        done: list[tuple[np.ndarray, ...]] = []
        while len(sym):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            counts = np.diff(np.append(first, len(sym)))
            best = np.minimum.reduceat(rank, first)
            stay = np.repeat(best < _NONE, counts)
            if not stay.all():
                done.append((sym[~stay], owner[~stay], char[~stay]))
            where = np.flatnonzero(stay & (rank == np.repeat(best, counts)))
            where = where[np.append(True, owner[where][1:] != owner[where][:-1])] if len(where) else where
            sym[where] = made[where]
            stay[where + 1] = False
            moved = (np.cumsum(stay) - 1)[where]
            sym, owner, char, rank, made = sym[stay], owner[stay], char[stay], rank[stay], made[stay]
            before = moved[moved > 0] - 1
            refresh(np.concatenate([moved, before[owner[before] == owner[before + 1]]]))
        sym, owner, char = (np.concatenate(x) for x in zip(*done)) if done else (sym, owner, char)
        order = np.argsort(owner, kind="stable")
        sym, owner, char = sym[order], owner[order], char[order]
        odd = np.unique(owner[(sym < 0) | ~self.piece_ids[np.maximum(sym, 0)]])
        if len(odd):  # words with characters outside the vocabulary
            lo, hi = np.searchsorted(owner, odd), np.searchsorted(owner, odd + 1)
            news = [self.finish([(int(sym[k]), flat[char[k]]) for k in range(a, b)]) for a, b in zip(lo, hi)]
            keep = ~np.isin(owner, odd)
            sym = np.concatenate([sym[keep], *(np.array(x, dtype=np.int64) for x in news)])
            owner = np.concatenate([owner[keep], np.repeat(odd, [len(x) for x in news])])
            order = np.argsort(owner, kind="stable")
            sym, owner = sym[order], owner[order]
        return sym.astype(np.int32), np.bincount(owner, minlength=len(words))

    def lock_step(self, words: list[str]) -> list[list[int]]:
        ids, sizes = self.lock_step_arrays(words)
        ends = np.cumsum(sizes)
        return [ids[e - n : e].tolist() for e, n in zip(ends, sizes)]

    def _keep(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> range:
        at = range(self.count, self.count + len(names))
        self.ids.append(ids)
        self.ends.append(self.total + np.cumsum(sizes))
        self.count, self.total, self.held = self.count + len(names), self.total + len(ids), self.held + 4 * len(ids) + 8 * len(names)
        return at

    def find(self, names: list[str]) -> np.ndarray:
        """The place of each named word's ids; words that are new are encoded. Long ones aren't remembered."""
        long: dict[str, int] = {}
        missing = [n for n in names if n not in self.memo]
        spelt = [n if SPACE in n else SPACE + n for n in missing]
        short = [k for k, w in enumerate(spelt) if len(w) <= LONG]
        for i in range(0, len(short), 50_000):
            some = short[i : i + 50_000]
            own = [missing[k] for k in some]
            self.memo.update(zip(own, self._keep(own, *self.lock_step_arrays([spelt[k] for k in some]))))
            self.held += sum(map(len, own)) + 110 * len(own)
        for n, w in zip(missing, spelt):
            if len(w) > LONG:
                ids = np.array(self.heap_agenda(w), dtype=np.int32)
                long[n] = self._keep([n], ids, np.array([len(ids)]))[0]
        if long:
            return np.array([self.memo[n] if n in self.memo else long[n] for n in names], dtype=np.int64)
        return np.fromiter(map(self.memo.__getitem__, names), dtype=np.int64, count=len(names))

    def _joined(self, at: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
        """The ids of texts, from the places of their words' ids and each text's number of words."""
        if len(self.ids) > 1:
            self.ids, self.ends = [np.concatenate(self.ids)], [np.concatenate(self.ends)]
        ends = self.ends[0]
        sizes = ends[at + 1] - ends[at]
        ids = gather(self.ids[0], ends[at], sizes)
        bounds = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(words))]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, without begin and end."""
        if self.held > MEMO_BYTES:
            self.clear()
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE)), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        odd = np.asarray(pc.or_(odd, pc.equal(pc.binary_length(texts), 0)))
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        plain = np.flatnonzero(~odd)
        if len(plain):
            cut = pc.split_pattern(texts.take(pa.array(plain)), " ")
            words = cut.flatten().dictionary_encode()
            got = self._joined(self.find(words.dictionary.to_pylist())[np.asarray(words.indices)], np.asarray(pc.list_value_length(cut)))
            for i, ids in zip(plain, got):
                out[i] = ids
        for i in np.flatnonzero(odd):
            if text := texts[i].as_py():
                parts = _RUNS.split(SPACE + text.replace(" ", SPACE))
                names = [p[1:] if SPACE not in p[1:] and p[0] == SPACE else p for p in parts]
                out[i] = self._joined(self.find(list(dict.fromkeys(names)))[list(map({n: k for k, n in enumerate(dict.fromkeys(names))}.__getitem__, names))], np.array([len(names)]))[0]
        return out


def model(path: str) -> PieceBpe:
    if path not in _loaded:
        _loaded[path] = PieceBpe(path)
    holds("piece", _loaded.clear)
    return _loaded[path]


def encode_texts(df: DataFrame, path: str, keep: list[str], text: str = "text", with_ids: bool = True, strict: bool = True) -> DataFrame:
    """The columns to keep, with ids (array, if asked for), n_tokens, ids_sha256, decoded, decoded_sha256 and agrees."""
    rows = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = df.select(*keep).schema
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    schema = schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string").add("agrees", "boolean")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        ends = [bpe.lib.bos_id()], [bpe.lib.eos_id()]
        for batch in slices(batches, "__text", 2 << 20):
            column = texts_of(batch.column("__text"))
            texts = column.to_pylist()
            ids = [np.concatenate([ends[0], x, ends[1]]).astype("<u4") for x in bpe.encode(column)]
            lists = [x.tolist() for x in ids]
            agrees = [a == b for a, b in zip(lists, bpe.lib.encode(texts, add_bos=True, add_eos=True, num_threads=1))]
            if strict and not all(agrees):
                wrong = hashlib.sha256(texts[agrees.index(False)].encode("utf-8", "surrogatepass")).hexdigest()
                raise ValueError(f"the agenda and the library differ on the text with SHA-256 {wrong}")
            decoded = bpe.lib.decode(lists, num_threads=1)
            digest = [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
            more = [pa.array(lists, pa.list_(pa.int32())), pa.array(decoded, pa.string())] if with_ids else []
            more += [pa.array([len(x) for x in lists], pa.int64()), pa.array(digest), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]), pa.array(agrees)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], schema.fieldNames())

    return rows.mapInArrow(released(coded, "piece"), schema)
