"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are ranked by how often the corpus uses them (most frequent first, ties by id). A document's record is its
control bytes (one bit an id for vocabularies of up to 65,536 ids, else two: the number of data bytes
less one; eight or four ids a byte, first id in the low bits) and its data bytes (the rank, little-endian). A
control byte is decoded by table lookup: lengths and offsets of its ids come from arrays.

File (little-endian): ``HMTB``, version, control bits and a zero (1, 1 and 2 bytes), the number of ids and the ids in order of
rank (uint32 each), then blocks. A block is its number of documents, of control bytes and of data bytes (3 x uint64), for each document its id,
whether that isn't null, its ids and its data bytes (int64, uint8, uint32, uint32 arrays), then all control bytes and all data bytes. So each
file can be decoded by itself.

A folder holds `files`, one for each range of doc_id in ascending order, and `manifest`, a Parquet table of the files' names in that order and
their numbers of documents and ids. Each task attempt writes a name of its own, and the manifest lists only what successful attempts wrote, so lost
executors leave nothing half read. read_files needs the folder alone. A folder that the caller names is kept; else it is deleted when the driver ends.

Defined results: a null text is empty (its record holds the end id only); null ids come first; rows that repeat
an id follow each other, in order of a checksum of their ids, and an id of very many rows is dealt to several files by it; no rows give no files.
"""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazmill.llm.common import gather, holds, new_path, released, slices, stored, texts_of

MAGIC = b"HMTB"
BLOCK_IDS = 1 << 20
MEMO_BYTES, LONG = 96 << 20, 64
#: Words of printable ASCII (no apostrophe, which begins contractions, and no <, which begins special tokens) and Latin-1 letters, and
#: the runs that the tokenizer's splitter makes of them in lower case. The normaliser changes nothing else in them.
SIMPLE = "^[!-&(-;=-~À-ÖØ-öø-ÿ]+$"
_RUNS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
#: Those letters' bytes as the tokenizer's byte level writes them: what Latin-1 can't print comes after U+0100.
_HIDDEN = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
_SHOWN = {c: c.encode().decode("latin-1").translate(_HIDDEN) for c in map(chr, range(0xDF, 0x100)) if c != "÷"}
_loaded: dict[str, WordEncoder] = {}


class WordEncoder:
    """The tokenizers library behind a memo of words.

    This tokenizer drops white space and never joins across it, so words are encoded once each; a word of letters is
    one pre-token and ends with its only end-of-word token, so that many such words share one call. A simple word (SIMPLE) is
    cut into its pre-tokens here, and each different one goes to the library's model at once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.closes = np.zeros(self.size, dtype=bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {"": 0}  # what precedes leading white space
        self.ids, self.ends = [np.zeros(0, np.uint32)], [np.zeros(2, np.int64)]
        self.count, self.total, self.held = 1, 0, 0

    def _keep(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        self.memo.update(zip(words, range(self.count, self.count + len(words))))
        self.ids.append(flat.astype(np.uint32))
        self.ends.append(self.total + np.cumsum(sizes))
        self.count, self.total = self.count + len(words), self.total + len(flat)
        self.held += sum(map(len, words)) + 120 * len(words) + 4 * len(flat)

    def _arrays(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ids) > 1:
            self.ids, self.ends = [np.concatenate(self.ids)], [np.concatenate(self.ends)]
        return self.ids[0], self.ends[0]

    @staticmethod
    def _plain(word: str) -> str | None:
        low = word.lower()
        return low if low.isalpha() and (low.isascii() or "Σ" not in word and unicodedata.is_normalized("NFC", word)) else None

    def _one_by_one(self, words: list[str]) -> None:
        got = [e.ids for e in self.lib.encode_batch_fast(words, add_special_tokens=False)]
        self._keep(words, np.array([i for x in got for i in x], dtype=np.uint32), np.array([len(x) for x in got]))

    def _join(self, words: list[str], parts: np.ndarray, counts: np.ndarray) -> None:
        """Keep words that are made of known ones: the places of all their parts, and each word's number of them."""
        flat, ends = self._arrays()
        sizes = ends[parts + 1] - ends[parts]
        total = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        self._keep(words, gather(flat, ends[parts], sizes), np.diff(total))

    def _simple(self, words: list[str]) -> None:
        runs = list(map(_RUNS.findall, map(str.lower, words)))
        parts, counts = list(chain.from_iterable(runs)), np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
        new = [p for p in dict.fromkeys(parts) if p not in self.memo]
        tokenize = self.lib.model.tokenize  # what normaliser and splitters would leave as it is goes to the model
        shown = "\n".join(new)
        for letter, own in _SHOWN.items():
            shown = shown.replace(letter, own)
        found = [[t.id for t in tokenize(p)] for p in shown.split("\n")] if new else []
        self._keep(new, np.fromiter(chain.from_iterable(found), dtype=np.uint32), np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
        at, one = np.fromiter(map(self.memo.__getitem__, parts), dtype=np.int64, count=len(parts)), counts == 1
        like = [words[i] for i in np.flatnonzero(one).tolist()]
        before = len(self.memo)
        self.memo.update(zip(like, at[np.repeat(one, counts)].tolist()))
        self.held += 170 * (len(self.memo) - before)
        self._join([words[i] for i in np.flatnonzero(~one).tolist()], at[np.repeat(~one, counts)], counts[~one])

    def learn(self, missing: list[str]) -> None:
        simple = np.asarray(pc.match_substring_regex(pa.array(missing, pa.large_string()), SIMPLE))
        self._simple([missing[i] for i in np.flatnonzero(simple).tolist()])
        letters: dict[str, None] = {}
        like, tailed, rest = [], [], []
        for w in (missing[i] for i in np.flatnonzero(~simple).tolist()):
            if (low := self._plain(w)) is not None:
                letters[low] = None
                if low != w:
                    like.append((w, low))
            elif w[-1] in ".,;:!?" and (low := self._plain(w[:-1])) is not None:
                letters[low] = None
                tailed.append((w, low, w[-1]))
            else:
                rest.append(w)
        new = [w for w in letters if w not in self.memo]
        for i in range(0, len(new), 1000):
            some = new[i : i + 1000]
            ids = np.array(self.lib.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids)
            at = np.flatnonzero(self.closes[ids]) + 1
            if len(at) == len(some) and at[-1] == len(ids):
                self._keep(some, ids, np.diff(at, prepend=0))
            else:
                self._one_by_one(some)
        marks = {m: None for _, _, m in tailed if m not in self.memo}
        self._one_by_one([*rest, *marks]) if rest or marks else None
        self.memo.update((w, self.memo[low]) for w, low in like)
        self.held += sum(len(w) + 110 for w, _ in like)
        if tailed:
            parts = np.array([self.memo[x] for _, low, mark in tailed for x in (low, mark)])
            self._join([w for w, _, _ in tailed], parts, np.full(len(tailed), 2))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and each text's number of them.

        Arrow cuts at ASCII white space and numbers the distinct words; only these become Python strings. A word that
        holds other white space isn't of letters alone and goes to the library by itself.
        """
        if self.held > MEMO_BYTES:
            self.clear()
        cut = pc.ascii_split_whitespace(texts)
        words = cut.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.memo.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        unknown = np.flatnonzero(at < 0)
        if missing := [distinct[i] for i in unknown.tolist()]:
            self.learn(missing)
            at[unknown] = np.fromiter(map(self.memo.__getitem__, missing), dtype=np.int64, count=len(missing))
        flat, ends = self._arrays()
        for w in missing:  # over-long words aren't remembered
            if len(w) > LONG:
                self.memo.pop(w, None)
        at = at[np.asarray(words.indices)]
        sizes = ends[at + 1] - ends[at]
        total = np.append(0, np.cumsum(sizes))
        bounds = total[np.append(0, np.cumsum(np.asarray(pc.list_value_length(cut)), dtype=np.int64))]
        return gather(flat, ends[at], sizes), np.diff(bounds)


def encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    holds("tokenbin", _loaded.clear)
    return _loaded[path]


def encode_records(ranks: np.ndarray, sizes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Control and data bytes of documents' ranks, one document after the other, and each one's number of data bytes."""
    r = ranks.astype("<u4")
    extra = (r > 0xFF).astype(np.uint8)
    if bits == 2:
        extra += (r > 0xFFFF).astype(np.uint8) + (r > 0xFFFFFF)
    per = 8 // bits
    padded = np.zeros(int(control_bytes(sizes, bits).sum()) * per, dtype=np.uint8)
    padded[_places(sizes, bits)] = extra
    control = (padded.reshape(-1, per) << (np.arange(per, dtype=np.uint8) * bits)).sum(axis=1, dtype=np.uint8)
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    more = np.append(0, np.cumsum(extra, dtype=np.int64))
    ends = np.cumsum(sizes)
    return control, data, sizes + more[ends] - more[ends - sizes]


def _places(sizes: np.ndarray, bits: int) -> np.ndarray:
    """Where documents' ids are among the fields of their control bytes."""
    per = 8 // bits
    own, fields = np.cumsum(sizes) - sizes, control_bytes(sizes, bits) * per
    return np.arange(int(sizes.sum())) + np.repeat(np.cumsum(fields) - fields - own, sizes)


_LENGTHS = {b: ((np.arange(256)[:, None] >> (np.arange(8 // b) * b)) & ((1 << b) - 1)) + 1 for b in (1, 2)}


def decode_records(control: np.ndarray, data: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """The ranks of documents, one after the other: lengths by table lookup of the control bytes, offsets as their running sum."""
    lengths = _LENGTHS[bits][control].ravel()[_places(sizes, bits)]
    start = np.cumsum(lengths) - lengths
    out = data[start].astype(np.uint32)
    for k in range(1, 2 if bits == 1 else 4):
        more = np.flatnonzero(lengths > k)
        out[more] |= data[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def control_bytes(n: np.ndarray, bits: int) -> np.ndarray:
    return (n * bits + 7) // 8


def encode_documents(df: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian uint16 or uint32 by the vocabulary's size), the end id last."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        kind = "<u2" if bpe.size <= 1 << 16 else "<u4"
        for batch in slices(batches, "text", 8 << 20):
            ids, sizes = bpe.encode(texts_of(batch.column("text")))
            ends = np.cumsum(sizes)
            whole = np.insert(ids, ends, end_id).astype(kind)
            ends = ends + np.arange(1, len(ends) + 1)
            raw, width = whole.tobytes(), whole.itemsize
            parts = [raw[a * width : b * width] for a, b in zip(np.append(0, ends[:-1]), ends)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(parts, pa.binary())], ["doc_id", "ids"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(released(coded, "tokenbin"), "doc_id long, ids binary")


def ranking(encoded: DataFrame, size: int, kind: str) -> np.ndarray:
    """The ids, most frequent first. What reaches the driver is one count for each id of the vocabulary."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                n += np.bincount(np.frombuffer(value.as_buffer(), dtype=kind), minlength=size) if len(value.as_buffer()) > size else 0
            small = b"".join(v.as_py() for v in batch.column(0) if len(v.as_buffer()) <= size)
            n += np.bincount(np.frombuffer(small, dtype=kind), minlength=size)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], ["id", "n"])

    total = np.zeros(size, dtype=np.int64)
    for i, n in encoded.select("ids").mapInArrow(released(counted), "id int, n long").groupBy("id").agg(F.sum("n")).collect():
        total[i] = n
    return np.lexsort((np.arange(size), -total)).astype(np.uint32)


def _pack(docs: list[tuple[int | None, int, bytes, bytes]]) -> bytes:
    control, data = b"".join(d[2] for d in docs), b"".join(d[3] for d in docs)
    head = np.array([len(docs), len(control), len(data)], dtype="<u8").tobytes()
    ids = np.array([d[0] or 0 for d in docs], dtype="<i8").tobytes()
    given = np.array([d[0] is not None for d in docs], dtype="u1").tobytes()
    sizes = np.array([[d[1] for d in docs], [len(d[3]) for d in docs]], dtype="<u4").tobytes()
    return head + ids + given + sizes + control + data


def _few(column: pa.Array, width: int) -> Iterator[tuple[int, int]]:
    """Bounds of successive rows whose ids are few together."""
    ends = np.cumsum(np.asarray(pc.binary_length(column), dtype=np.int64)) // width
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + BLOCK_IDS, "right")))
        yield at, to
        at = to


def _slices(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of a byte array as binary values."""
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


#: What a null id counts as when ranges are cut.
LOWEST = -(1 << 63)


def write_files(encoded: DataFrame, order: np.ndarray, kind: str, folder: str, files: int) -> None:
    """Write one file for each range of doc_id and the manifest: name, part, n_docs, n_ids, n_bytes."""
    bits, width = 1 if len(order) <= 1 << 16 else 2, np.dtype(kind).itemsize
    rank = np.empty(len(order), dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    shared = encoded.sparkSession.sparkContext.broadcast((rank, order.astype("<u4")))  # as large as the vocabulary
    # Bounds from the ids alone: a range partitioner would draw its sample by ranking all documents once more.
    shares = [k / files for k in range(1, files)]
    key = F.coalesce("doc_id", F.lit(LOWEST))
    bounds = encoded.agg(F.percentile_approx(key, shares, max(10_000, 20 * files))).first()[0] if shares else None
    cuts = np.array(bounds or [], dtype=np.int64)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value[0]
        for whole in batches:
            for at, to in _few(whole.column("ids"), width):
                batch = whole.slice(at, to - at)
                column = batch.column("ids")
                n = np.asarray(pc.binary_length(column), dtype=np.int64) // width
                raw = column.buffers()[2]
                begin = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset]
                ids = np.frombuffer(raw, dtype=np.uint8)[begin : begin + int(n.sum()) * width].view(kind)
                control, data, lengths = encode_records(rank[ids], n, bits)
                mix = np.fromiter((zlib.crc32(v.as_buffer()) for v in column), dtype=np.int64, count=len(n))
                names = np.asarray(batch.column("doc_id").fill_null(LOWEST))
                # An id that is several bounds has the ranges between them, dealt by the checksum.
                low, high = np.searchsorted(cuts, names), np.searchsorted(cuts, names, "right")
                part = (low + np.where(high - low > 1, mix * (high - low) >> 32, 0)).astype(np.int32)
                columns = [pa.array(part), batch.column("doc_id"), pa.array(mix), pa.array(n), _slices(control, control_bytes(n, bits)), _slices(data, lengths)]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "mix", "n", "control", "data"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        part, out, name, held, waiting = TaskContext.get().partitionId(), None, "", [], 0
        n_docs = n_ids = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "control", "data"))):
                if out is None:
                    store, base = fs.FileSystem.from_uri(f"{folder}/files")
                    store.create_dir(base, recursive=True)
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.hmtb"
                    out = store.open_output_stream(f"{base}/{name}")
                    ids = shared.value[1]
                    out.write(MAGIC + bytes([2, bits, 0, 0]) + np.array([len(ids)], "<u4").tobytes() + ids.tobytes())
                held.append(row)
                n_docs, n_ids, waiting = n_docs + 1, n_ids + row[1], waiting + row[1]
                if waiting >= BLOCK_IDS:
                    out.write(_pack(held))
                    held, waiting = [], 0
        if held:
            out.write(_pack(held))
        if out is not None:
            n_bytes = out.tell()
            out.close()
            yield pa.RecordBatch.from_pylist([{"name": name, "part": part, "n_docs": n_docs, "n_ids": n_ids, "n_bytes": n_bytes}], schema=pa.schema([("name", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    rows = encoded.mapInArrow(released(ranked), "part int, doc_id long, mix long, n long, control binary, data binary")
    ordered = rows.repartitionById(files, F.col("part")).drop("part").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "mix", "n", "control", "data")
    ordered.mapInArrow(released(written), MANIFEST).write.parquet(f"{folder}/manifest")


MANIFEST = "name string, part int, n_docs long, n_ids long, n_bytes long"


def decoded_blocks(f) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, whether they aren't null, numbers of ids, all ids) of each block of an open file."""
    head = f.read(12)
    if head[:5] != MAGIC + b"\x02":
        raise ValueError("no token file")
    bits, size = head[5], int(np.frombuffer(head[8:], "<u4")[0])
    order = np.frombuffer(f.read(4 * size), dtype="<u4")
    while head := f.read(24):
        n, n_control, n_data = (int(x) for x in np.frombuffer(head, dtype="<u8"))
        ids, given = np.frombuffer(f.read(8 * n), dtype="<i8"), np.frombuffer(f.read(n), dtype="u1")
        sizes, _ = np.frombuffer(f.read(8 * n), dtype="<u4").reshape(2, n).astype(np.int64)
        control, data = np.frombuffer(f.read(n_control), dtype=np.uint8), np.frombuffer(f.read(n_data), dtype=np.uint8)
        yield ids, given, sizes, order[decode_records(control, data, sizes, bits)]


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the folder alone."""
    start, rows = 0, []
    for name, n_ids in spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("part").select("name", "n_ids").collect():  # a short row for each file
        rows.append((name, start))
        start += n_ids

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(f"{folder}/files")
        for batch in batches:
            for name, begin in zip(batch.column("name").to_pylist(), batch.column("begin").to_pylist()):
                with store.open_input_stream(f"{base}/{name}") as f:
                    for ids, given, sizes, tokens in decoded_blocks(f):
                        ends = np.cumsum(sizes)
                        raw = memoryview(tokens.astype("<u4").tobytes())
                        crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes.tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=given == 0), pa.array(begin + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        begin += int(sizes.sum())

    names = spark.createDataFrame(rows, "name string, begin long")
    return names.repartition(max(1, len(rows))).mapInArrow(released(decoded), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_to_files(df: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, file_bytes: int = 32 << 20, key: str = "doc_id", text: str = "text") -> str:
    """Encode, rank and write; gives the folder (a URI that all executors share), a fresh one that the driver deletes at its end unless one is named."""
    spark = df.sparkSession
    size = encoder(tokenizer).size
    kind = "<u2" if size <= 1 << 16 else "<u4"
    encoded = stored(encode_documents(df, tokenizer, end_id, key, text), "tokens")
    order = ranking(encoded, size, kind)
    total = encoded.agg(F.sum(F.length("ids"))).first()[0] or 0
    files = max(1, -(-total // file_bytes), min(spark.sparkContext.defaultParallelism, total >> 20))
    folder = (folder or new_path(spark, "token-files")).rstrip("/")
    write_files(encoded, order, kind, folder, int(files))
    return folder
