"""Hard negatives: for each anchor and each of its best positives, rows of other labels that score just below the positive.

Components become floor(256 * x), scores are integer inner products. A task holds one block of anchors, and rows stream past it in chunks. A
chunk's scores are sorted for each anchor by score and id; a positive's upper limit is found by binary search, and what follows down to the
lower limit is read. A task keeps the best few for each anchor and positive, and Spark merges those of all tasks. The first pass finds positives
likewise. Every anchor meets every row once a pass: a stated query set against all rows, in blocks of bounded size.

Rows with a null id, label or vector, with a null or non-finite component, or with a squared integer length of 2**62 or more (their scores might leave a long) take no part. Shorter vectors count as if zeros followed. Repeated rows count
once; rows that share an id but differ stand for themselves, and never are each other's positives. Ties go to the smaller id. An empty table, and one without anchors, give an empty result. Only the three named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazmill.llm.common import released, stored

#: Anchors of a block, rows that stream past a block in one task, rows scored at once, and scores held at once.
BLOCK, STREAM, CHUNK, HELD = 1 << 15, 1 << 20, 1 << 13, 1 << 22
SCALE = 256
EXACT = 1 << 53


def prepare(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, label and integer vector of the rows that take part."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    given = df.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).filter(finite)
    whole = given.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label"), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return whole.filter(length < float(1 << 62))


def _matrix(column: pa.Array) -> np.ndarray:
    """List vectors as rows, shorter ones filled with zeros."""
    flat, sizes = np.asarray(column.flatten()), np.diff(np.asarray(column.offsets))
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: floating-point where no sum can pass 2**53, else 64-bit integers."""
    width = min(anchors.shape[1], rows.shape[1])
    a, b = anchors[:, :width], rows[:, :width]
    longest = [float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max(initial=0))) for m in (a, b)]
    if longest[0] * longest[1] < EXACT / 2:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _sorted(scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores descending with their ids ascending within ties, equal pairs once."""
    order = np.lexsort((ids, -scores))
    s, i = scores[order], ids[order]
    fresh = np.ones(len(s), dtype=bool)
    fresh[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])
    return (s, i) if fresh.all() else (s[fresh], i[fresh])


def _streamed(batches: Iterator[pa.RecordBatch], see: Callable, width: int = HELD) -> dict | None:
    """Read a part: its anchors, then its rows, of which see(anchors, chosen, scores, ids, labels) gets a chunk at a time; gives the anchors."""
    held: list[pa.RecordBatch] = []
    anchors: dict | None = None
    for batch in batches:
        is_row = np.asarray(batch.column("is_row"))
        split = int(np.searchsorted(is_row, 1))
        if split:
            held.append(batch.slice(0, split))
        if split == batch.num_rows:
            continue
        if anchors is None:
            if not held:
                return None
            whole = pa.Table.from_batches(held).combine_chunks()
            anchors = {c: whole[c].combine_chunks() for c in ("anchor", "id", "label", "v", "positives")}
            anchors |= {c: np.asarray(anchors[c]) for c in ("anchor", "id", "label")} | {"v": _matrix(anchors["v"])}
        for at in range(split, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            ids, labels, vectors = np.asarray(part.column("id")), np.asarray(part.column("label")), _matrix(part.column("v"))
            step = max(1, width // len(ids))
            for a in range(0, len(anchors["id"]), step):
                see(anchors, np.arange(a, min(a + step, len(anchors["id"]))), _scores(anchors["v"][a : a + step], vectors), ids, labels)
    return anchors


def _positives(count: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def see(anchors: dict, chosen: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
            for label in np.unique(anchors["label"][chosen]):
                same = np.flatnonzero(labels == label)
                for k in np.flatnonzero(anchors["label"][chosen] == label):
                    n = int(chosen[k])
                    s, i = _sorted(scores[k, same], ids[same])
                    other = i != anchors["id"][n]
                    s, i = s[other][:count], i[other][:count]
                    if n in best:
                        s, i = _sorted(np.concatenate([best[n][0], s]), np.concatenate([best[n][1], i]))
                    best[n] = s[:count].copy(), i[:count].copy()

        anchors = _streamed(batches, see)
        if anchors is None or not best:
            return
        sizes = [len(best[n][0]) for n in best]
        names = np.repeat(anchors["anchor"][list(best)], sizes)
        yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(np.concatenate([b[k] for b in best.values()])) for k in (0, 1))], ["anchor", "score", "id"])

    return work


def _negatives(count: int, low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        limits: list[list[tuple[int, int, int]]] = []

        def see(anchors: dict, chosen: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
            if not limits:  # of each anchor, its positives' scores and lower limits
                limits.extend([(p["score"], -(-low * p["score"] // high), k) for k, p in enumerate(own or [])] for own in anchors["positives"].to_pylist())
            for label in np.unique(anchors["label"][chosen]):
                other = np.flatnonzero(labels != label)
                for k in np.flatnonzero(anchors["label"][chosen] == label):
                    n = int(chosen[k])
                    s, i = _sorted(scores[k, other], ids[other])
                    down = -s
                    for upper, lower, p in limits[n]:
                        a = int(np.searchsorted(down, -upper))
                        b = min(a + count, int(np.searchsorted(down, -lower, "right")))
                        if b <= a:
                            continue
                        got = s[a:b], i[a:b]
                        if (n, p) in best:
                            got = _sorted(np.concatenate([best[n, p][0], got[0]]), np.concatenate([best[n, p][1], got[1]]))
                        best[n, p] = got[0][:count].copy(), got[1][:count].copy()

        anchors = _streamed(batches, see)
        if anchors is None or not best:
            return
        keys, own = list(best), anchors["positives"].to_pylist()
        sizes = [len(best[k][0]) for k in keys]
        columns = [anchors["anchor"][[n for n, _ in keys]], anchors["id"][[n for n, _ in keys]], np.array([own[n][p]["id"] for n, p in keys], dtype=np.int64), np.array([own[n][p]["score"] for n, p in keys], dtype=np.int64)]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(np.repeat(c, sizes)) for c in columns), *(pa.array(np.concatenate([best[q][k] for q in keys])) for k in (0, 1))],
            ["anchor", "anchor_id", "positive_id", "positive_score", "negative_score", "negative_id"],
        )

    return work


def _met(anchors: DataFrame, rows: DataFrame, blocks: int, streams: int) -> DataFrame:
    """Every block of anchors with every stream of rows: one partition each, anchors first."""
    left = anchors.select(F.explode(F.expr(f"transform(sequence(0, {streams - 1}), s -> cast(pmod(xxhash64(anchor), {blocks}) * {streams} + s as int))")).alias("part"), F.lit(0).alias("is_row"), "anchor", "id", "label", "v", "positives")
    right = rows.select(F.explode(F.expr(f"transform(sequence(0, {blocks - 1}), b -> cast(b * {streams} + stream as int))")).alias("part"), F.lit(1).alias("is_row"), F.lit(0).cast("long").alias("anchor"), "id", "label", "v", F.lit(None).cast("array<struct<score:bigint,id:bigint>>").alias("positives"))
    return left.union(right).repartitionById(blocks * streams, F.col("part")).sortWithinPartitions("part", "is_row").drop("part")


def _first(df: DataFrame, by: list[str], order: list, count: int) -> DataFrame:
    """The first rows of each group and their rank; equal rows once. Spark applies the limit before the shuffle as well."""
    ranked = df.withColumn("rank", F.dense_rank().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= count).distinct()


def mine(df: DataFrame, is_anchor: str = "id % 100 = 0", label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, parts: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of a prepared table (id, label, v).

    is_anchor and label are SQL over its columns. A negative's score is at most the positive's and at least low / high of it.
    """
    spark = df.sparkSession
    rows = stored(df.withColumn("label", F.expr(label)).withColumn("stream", F.xxhash64(F.monotonically_increasing_id())), "vectors")
    heads = stored(rows.filter(is_anchor).select("id", "label", "v").distinct().withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    n_rows, n_heads = rows.count(), heads.count()
    blocks = max(1, -(-n_heads // BLOCK))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    streams = max(1, -(-n_rows // STREAM), min(-(-parts // blocks), -(-n_rows // CHUNK)))
    rows = rows.withColumn("stream", F.pmod("stream", F.lit(streams)))
    plain = heads.withColumn("positives", F.lit(None).cast("array<struct<score:bigint,id:bigint>>"))
    found = _met(plain, rows, blocks, streams).mapInArrow(released(_positives(positives)), "anchor long, score long, id long")
    best = _first(found, ["anchor"], [F.desc("score"), "id"], positives)
    lists = best.groupBy("anchor").agg(F.collect_list(F.struct("score", "id")).alias("positives"))  # the few of each anchor
    ready = stored(heads.join(lists, "anchor"), "positives")
    found = _met(ready, rows, blocks, streams).mapInArrow(released(_negatives(negatives, low, high)), "anchor long, anchor_id long, positive_id long, positive_score long, negative_score long, negative_id long")
    out = _first(found, ["anchor", "positive_id", "positive_score"], [F.desc("negative_score"), "negative_id"], negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
