"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF word shingles, banded, verified.

1. Equal texts become one node (named by two 64-bit hashes of the text, never by the id).
2. Each distinct five-word shingle of a text weighs its frequency times 1 + DAMP * idf, where idf falls from 1 for shingles in
   at most RARE of the texts to 0 for one in all of them: damped, so that copies that make up much of the corpus
   stay alike. The share of texts that hold a shingle comes from a count sketch of fixed width over all documents, from which
   the mean load of a slot is taken off. That load is a fixed share of the texts whatever the corpus (shingles a text / WIDTH), and
   what is left of its noise falls with the root of their number, so the weights don't fade as the corpus grows. A rare shingle that
   shares its slot with a common one (a chance of common shingles / WIDTH) is weighed like that one, in all texts alike.
3. Improved consistent weighted sampling draws 64 samples a text; 16 bands of 4 give bucket keys. A pair with
   weighted Jaccard similarity 0.8 shares a bucket with probability 0.9998.
4. Buckets are worked off without all pairs: first each text is compared with the least of the first members of its buckets, which
   connects most groups; then in each round every bucket names a hub (of its smallest component), and the members
   that aren't yet connected to it are compared with it; links become connected components; members of buckets with
   more than one component stay. When few pairs of different components are left (four a text), or a round no
   longer removes a third of them, all that are left are compared, bucket by bucket, those outside a bucket's largest component with
   all members, in blocks, as arrays: by samples first if they are few, else by exact similarity in the blocks themselves, which
   hold their members' shingles. Pairs within one component need no check: they wouldn't change a class. To compare two texts, their
   weights (the ratio bounds the similarity) and samples are tried first: a pair of similarity 0.8 has fewer than
   LEAST_EQUAL of 64 samples equal with probability 3e-6. The exact weighted Jaccard similarity of the texts decides.

Only node numbers and keys go through the shuffles of the rounds; samples are fetched once for each candidate pair, a hub's text
once for each PART members. The folders of a round are deleted when the next one's are written.

Defined results: class_id is the class's least doc_id. A null text, or one without a word that no other text
equals, is a class of its own; equal texts without words are one class. A null doc_id has a null class. Repeated rows fall into
their text's class, and different texts of one id into the classes of their own texts. Columns other than id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazmill.llm.common import Folders, Words, blocks_of, gathered, mix, released, shingles, slices, sum_blocks, texts_of

SIZE, THRESHOLD, SAMPLES, BANDS, DAMP, LEAST_EQUAL, BLOCK, PART = 5, 0.8, 64, 16, 0.1, 36, 512, 256
WIDTH, BLOCKS, RARE = 1 << 20, 256, 1 / 1024
_DRAWS = 1 << 16
_SLICE = 1 << 20
_SLACK = 1 - 1e-6
_tables: list[np.ndarray] = []


def _draws() -> list[np.ndarray]:
    """Gamma(2,1), ln Gamma(2,1) and uniform draws, looked up by shingle and sample number."""
    if not _tables:
        rng = np.random.default_rng(20240501)
        r, c, b = rng.gamma(2, 1, _DRAWS), rng.gamma(2, 1, _DRAWS), rng.random(_DRAWS)
        _tables.extend(x.astype(np.float32) for x in (r, np.log(c), b, 1 / r))
    return _tables


def document_frequencies(df: DataFrame, text: str = "text", size: int = SIZE) -> np.ndarray:
    """A count sketch of WIDTH shingle document frequencies, then the number of texts."""

    @released
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(WIDTH, dtype=np.int64), 0
        for batch in slices(batches, text, _SLICE):
            _, h, _ = shingles(Words(texts_of(batch.column(0))), size)
            at, times = np.unique((h & np.uint64(WIDTH - 1)).astype(np.int32), return_counts=True)
            total[at] += times
            n += batch.num_rows
        more = np.zeros(WIDTH // BLOCKS, dtype=np.int64)
        more[0] = n
        yield blocks_of(np.append(total, more), BLOCKS + 1)

    parts = df.select(F.col(text).cast("string").alias(text)).filter(F.col(text).isNotNull()).mapInArrow(counted, "block int, data binary")
    out = gathered(sum_blocks(parts, "<i8"), "<i8", BLOCKS + 1, WIDTH // BLOCKS)
    return out[: WIDTH + 1]


def idf_table(frequencies: np.ndarray, damp: float = DAMP) -> np.ndarray:
    """The weight of each slot's shingles."""
    n, counts = max(1, int(frequencies[WIDTH])), frequencies[:WIDTH].astype(np.float64)
    alone = (counts - counts.sum() / WIDTH) * (WIDTH / (WIDTH - 1))
    share = np.clip(alone / n, RARE, 1)
    return (1 + damp * np.log(share) / np.log(RARE)).astype(np.float32)


def weighted_shingles(texts: pa.Array, idf: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, shingle and weight, ascending."""
    owner, h, times = shingles(Words(texts), size)
    return owner, h, times * idf[(h & np.uint64(WIDTH - 1)).astype(np.int64)]


def samples(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, count: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and their samples: improved consistent weighted sampling."""
    r, ln_c, beta, inverse = _draws()
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    out = np.zeros((len(first), count), dtype=np.uint64)
    if not len(first):
        return owner[first], out
    sizes = np.diff(np.append(first, len(owner)))
    ln_w = np.log(weight).astype(np.float32)
    mixed = mix(h)
    at, step = (mixed & np.uint64(_DRAWS - 1)).astype(np.uint16), ((mixed >> np.uint64(16)) & np.uint64(_DRAWS - 1)).astype(np.uint16) | np.uint16(1)
    group = np.repeat(np.arange(len(first)), sizes)
    for k in range(count):
        rk, bk = r[at], beta[at]
        t = np.floor(ln_w * inverse[at] + bk)
        ln_a = ln_c[at] - rk * (t - bk + np.float32(1))
        least = np.minimum.reduceat(ln_a, first)
        hit = np.flatnonzero(ln_a == least[group])
        hit = hit[np.append(True, group[hit[1:]] != group[hit[:-1]])]
        out[:, k] = mix(h[hit] ^ mix(t[hit].astype(np.int64).astype(np.uint64)))
        at = at + step
    return owner[first], out


def _sketches(df: DataFrame, idf, size: int) -> DataFrame:
    """doc_id, k1, k2, weight (of all shingles) and samples (32 bits each; null without a word) of each row."""

    @released
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE // 2):
            owner, h, w = weighted_shingles(texts_of(batch.column("text")), idf.value, size)
            which, sig = samples(owner, h, w)
            weight = np.bincount(owner, weights=w, minlength=batch.num_rows).astype(np.float64)  # without words it would count
            held: list[bytes | None] = [None] * batch.num_rows
            for i, row in zip(which.tolist(), sig.astype("<u4")):
                held[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(weight), pa.array(held, pa.binary())], ["doc_id", "k1", "k2", "weight", "sig"])

    return df.mapInArrow(sketched, "doc_id long, k1 long, k2 long, weight double, sig binary")


def bands(sig: Column) -> Column:
    """The keys of all bands of binary samples."""
    wide = SAMPLES // BANDS * 4
    return F.array(*(F.xxhash64(F.lit(b), F.substring(sig, b * wide + 1, wide)) for b in range(BANDS)))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two ascending shingle lists with weights."""
    total = a[1].sum() + b[1].sum()
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return float(common / (total - common)) if total > common else 1.0


def likely_pairs(pairs: DataFrame, profiles: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (node, hub, n) those whose weights and samples allow the similarity. profiles: node, weight, sig."""

    @released
    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u4").reshape(-1, SAMPLES) for c in ("sig", "hub_sig"))
            w, v = batch.column("weight").to_numpy(), batch.column("hub_weight").to_numpy()
            good = ((a == b).sum(axis=1) >= LEAST_EQUAL) & (np.minimum(w, v) >= threshold * _SLACK * np.maximum(w, v))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("node", "hub", "n")], ["node", "hub", "n"]).filter(pa.array(good))

    hubs = profiles.select(F.col("node").alias("hub"), F.col("weight").alias("hub_weight"), F.col("sig").alias("hub_sig"))
    return pairs.join(profiles, "node").join(hubs, "hub").select("node", "hub", "n", "weight", "hub_weight", "sig", "hub_sig").mapInArrow(tried, "node long, hub long, n long")


def verify(pairs: DataFrame, texts: DataFrame, idf, threshold: float, size: int) -> DataFrame:
    """The pairs (node, hub) whose texts are similar enough. pairs: node, hub, n (members of the hub's bucket); texts: node, text.

    A hub's members are dealt to parts of about PART, and each part gets the hub's text once, ahead of them.
    """
    parted = pairs.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / PART)).cast("int"))
    members = parted.join(texts, "node").select("hub", "part", "node", "text")
    hubs = parted.select("hub", "part").distinct().join(texts.withColumnRenamed("node", "hub"), "hub").select("hub", "part", F.lit(None).cast("long").alias("node"), "text")

    @released
    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theirs = None
        for batch in slices(batches, "text", _SLICE):
            owner, h, w = weighted_shingles(texts_of(batch.column("text")), idf.value, size)
            bounds, good = np.searchsorted(owner, np.arange(batch.num_rows + 1)), []
            for i, node in enumerate(batch.column("node").to_pylist()):
                mine = h[bounds[i] : bounds[i + 1]], w[bounds[i] : bounds[i + 1]]
                if node is None:
                    theirs = mine[0].copy(), mine[1].copy()
                good.append(node is not None and similarity(mine, theirs) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("hub")], ["node", "hub"]).filter(pa.array(good, pa.bool_()))

    return members.union(hubs).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("node").asc_nulls_first()).mapInArrow(checked, "node long, hub long")


def _dealt(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows for groups (key, i, j) in which block i of a bucket's members meets block j of its visitors, those outside its largest component.

    rows: key, own (blocks of members), other (blocks of visitors), visits (boolean), node, comp and the columns. As a rule there is one
    block of visitors, so that members aren't copied. A row's places are one list, so that what makes the rows runs once.
    """
    i, j = F.pmod(F.xxhash64("node"), "own").cast("int"), F.pmod(F.xxhash64("node"), "other").cast("int")
    place = lambda i, j, visitor: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(visitor).alias("visitor"))
    member = F.transform(F.sequence(F.lit(0), F.col("other") - 1), lambda k: place(i, k, False))
    visitor = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda k: place(k, j, True))
    places = F.when(F.col("visits"), F.concat(member, visitor)).otherwise(member)
    return rows.select("key", "node", "comp", *columns, F.explode(places).alias("at")).select("key", "at.*", "node", "comp", *columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _grouped(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """Apply work to the table of each group of rows sorted by (key, i, j)."""
    held, now = [], None
    for batch in batches:
        names = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
        starts = np.flatnonzero(np.append(True, (names[1:] != names[:-1]).any(axis=1))) if len(names) else []
        for a, b in zip(starts, [*starts[1:], len(names)]):
            name = tuple(names[a])
            if name != now and held:
                yield work(pa.Table.from_batches(held).combine_chunks())
                held = []
            now = name
            held.append(batch.slice(a, b - a))
    if held:
        yield work(pa.Table.from_batches(held).combine_chunks())


def _pairs(out: list) -> pa.RecordBatch:
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1) if len(pairs) else pairs[:, 0]), pa.array(pairs.min(axis=1) if len(pairs) else pairs[:, 1])], ["node", "hub"])


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(c).to_numpy() for c in names]


def block_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """The pairs (node, hub, n) of one bucket but different components that may be similar enough. rows: as for _dealt, with n, weight and sig."""

    def work(t: pa.Table) -> pa.RecordBatch:
        node, comp, weight = _columns(t, "node", "comp", "weight")
        visitor = t.column("visitor").to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype="<u4").reshape(-1, SAMPLES)
        left, right, out = np.flatnonzero(visitor), np.flatnonzero(~visitor), []
        for at in range(0, len(left), 64):
            a = left[at : at + 64]
            x, y = np.nonzero((comp[a][:, None] != comp[right]) & (np.minimum(weight[a][:, None], weight[right]) >= threshold * _SLACK * np.maximum(weight[a][:, None], weight[right])))
            for k in range(0, len(x), 1 << 16):
                xs, ys = a[x[k : k + (1 << 16)]], right[y[k : k + (1 << 16)]]
                good = (sig[xs] == sig[ys]).sum(axis=1) >= LEAST_EQUAL
                out += zip(node[xs[good]].tolist(), node[ys[good]].tolist())
        got = _pairs(out)
        return got.append_column("n", pa.array([t.column("n")[0].as_py()] * got.num_rows, pa.int64()))

    @released
    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _grouped(batches, work)

    pairs = _dealt(rows, ["n", "weight", "sig"]).mapInArrow(paired, "node long, hub long, n long")
    return pairs.groupBy("node", "hub").agg(F.max("n").alias("n"))


def block_links(rows: DataFrame, texts: DataFrame, idf, threshold: float, size: int) -> DataFrame:
    """Links (node, hub) that join different components, of all similar pairs of each bucket. rows: as for _dealt, with weight; texts: node, text.

    A block has few members and little weight, so that a group's shingles fit in memory; of a group's links a spanning forest is enough.
    """

    @released
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            owner, h, w = weighted_shingles(texts_of(batch.column("text")), idf.value, size)
            ends = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(h.astype(np.int64))), pa.ListArray.from_arrays(ends, pa.array(w.astype(np.float32)))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), *lists], ["node", "h", "w"])

    def work(t: pa.Table) -> pa.RecordBatch:
        node, comp, weight = _columns(t, "node", "comp", "weight")
        visitor = t.column("visitor").to_numpy(zero_copy_only=False)
        lists = t.column("h").combine_chunks()
        first = np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy())))
        _, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        w = t.column("w").combine_chunks().flatten().to_numpy()
        root = {int(c): int(c) for c in comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        dense = np.zeros(int(code.max()) + 1 if len(code) else 0, dtype=np.float32)
        right, out = np.flatnonzero(~visitor), []
        spans = [(first[r], first[r + 1]) for r in right]
        flat = np.concatenate([np.arange(a, b) for a, b in spans]) if spans else np.zeros(0, np.int64)
        code_r, w_r, at = code[flat], w[flat], np.append(0, np.cumsum([b - a for a, b in spans]))
        for x in np.flatnonzero(visitor):
            some = (comp[right] != comp[x]) & (np.minimum(weight[x], weight[right]) >= threshold * _SLACK * np.maximum(weight[x], weight[right]))
            if not some.any():
                continue
            mine = slice(first[x], first[x + 1])
            dense[code[mine]] = w[mine]
            common = np.add.reduceat(np.minimum(dense[code_r], w_r), at[:-1])
            dense[code[mine]] = 0
            for y in np.flatnonzero(some & (common >= threshold * _SLACK * (weight[x] + weight[right] - common))):
                a, b = find(int(comp[x])), find(int(comp[right[y]]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((int(node[x]), int(node[right[y]])))
        return _pairs(out)

    @released
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _grouped(batches, work)

    own = rows.select("node").distinct()
    arrays = texts.join(own, "node", "left_semi").mapInArrow(vectors, "node long, h array<long>, w array<float>")
    return _dealt(rows.join(arrays, "node"), ["weight", "h", "w"]).mapInArrow(linked, "node long, hub long")


def components(links: DataFrame, folders: Folders) -> DataFrame:
    """node, comp for every node of the links (node, hub): comp is the least node that it is connected to.

    Alternately each node's greater neighbours are linked to its least one, and its lesser neighbours to the least of them, until all
    links are stars. A round has as many links as the one before, or fewer.
    """
    edges = links.select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).filter("u <> v").distinct().withColumn("moved", F.lit(True))
    while True:
        edges = folders.stored(edges, "edges")
        if not edges.filter("moved").head(1):
            break
        up = edges.groupBy("u").agg(F.min("v").alias("up")).withColumnRenamed("u", "v")
        large = edges.join(up, "v", "left").select("u", F.coalesce("up", "v").alias("v"), F.col("up").isNotNull().alias("moved"))
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        edges = small.select(F.when(F.expr("v <> m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"), F.expr("moved or v <> m").alias("moved")).groupBy("u", "v").agg(F.max("moved").alias("moved"))
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return folders.stored(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots), "comp")


def _named(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, text, k1, k2 of the rows that have an id and a text."""
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    return docs.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("second"), "text")})


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = SIZE, damp: float = DAMP) -> DataFrame:
    """k1, k2, least (doc_id), class_id and head of each different text; head: whether it stands for its class."""
    spark, named = df.sparkSession, _named(df, key, text)
    folders = Folders(spark)
    idf = spark.sparkContext.broadcast(idf_table(document_frequencies(named, "text", size), damp))
    nodes = _sketches(named, idf, size).groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.first(F.struct("weight", "sig")).alias("s"))
    nodes = folders.stored(nodes.select(F.monotonically_increasing_id().alias("node"), "least", "k1", "k2", "s.weight", "s.sig"), "nodes")
    keys = nodes.filter("sig is not null").select("node", "weight", F.explode(bands(F.col("sig"))).alias("key"))
    crowds = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).filter("n > 1")
    rows = folders.stored(keys.join(crowds, "key").select("key", "node", "weight", "n", "hub"), "rows")
    alone = nodes.select("k1", "k2", "least", F.col("least").alias("class_id"), F.lit(True).alias("head"))
    if not rows.head(1):
        return alone
    profiles = folders.stored(nodes.join(rows.select("node").distinct(), "node", "left_semi"), "profiles")
    whole = named.dropDuplicates(["doc_id", "k1", "k2"]).join(profiles.select("node", F.col("least").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"])
    texts = folders.stored(whole.select("node", "text"), "texts")
    profiles = profiles.select("node", "weight", "sig")
    room, before, links, turn = 4 * nodes.count(), None, None, 0
    pairs = rows.filter("node <> hub").groupBy("node").agg(F.min(F.struct("hub", "n")).alias("h")).select("node", "h.hub", "h.n")
    while True:
        likely = folders.stored(likely_pairs(pairs, profiles, threshold), "likely")
        found = verify(likely, texts, idf, threshold, size)
        links = folders.stored(found if links is None else links.union(found), "links")
        comp = components(links, folders)
        done = rows.filter("node <> hub") if turn else rows  # after the first round, in which a node meets one hub, hubs aren't done with
        turn += 1
        rest = done.select("key", "node", "weight").join(comp, "node", "left").select("key", "node", "weight", F.coalesce("comp", "node").alias("comp"))
        of = rest.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("weight").alias("load"), F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("rank"), "node")).alias("first"))
        of = of.groupBy("key").agg(F.sum("n").alias("n"), F.sum("load").alias("load"), F.sum(F.col("n") * F.col("n")).alias("same"), F.min(F.struct("n", "first", "comp")).alias("s"), F.max(F.struct("n", "comp")).alias("g")).filter("same < n * n")
        of = of.select("key", "n", "load", F.expr("(n * n - same) / 2").alias("pairs"), F.col("s.first.node").alias("hub"), F.col("s.comp").alias("hub_comp"), F.col("g.comp").alias("main"), F.expr("n - g.n").alias("visitors"))
        buckets = folders.stored(of, "buckets")
        left = buckets.agg(F.sum("pairs")).first()[0]
        if not left:
            break
        rows = folders.stored(rest.join(buckets, "key"), "rows")
        if left <= room or before is not None and left > before * 2 / 3:
            dealt = rows.select("key", "node", "weight", "comp", "n", F.ceil(F.col("n") / BLOCK).alias("own"), F.ceil(F.col("visitors") / BLOCK).alias("other"), F.ceil(F.col("load") / (1 << 20)).alias("most"), F.expr("comp <> main").alias("visits"))
            if left <= room:
                likely = folders.stored(block_pairs(dealt.join(profiles.select("node", "sig"), "node"), threshold), "likely")
                found = verify(likely, texts, idf, threshold, size)
            else:
                found = block_links(dealt.withColumns({"own": F.greatest("own", "most"), "other": F.greatest("other", "most")}), texts, idf, threshold, size)
            links = folders.stored(links.union(found), "links")
            comp = components(links, folders)
            break
        before = left
        pairs = rows.filter("comp <> hub_comp").groupBy("node", "hub").agg(F.max("n").alias("n"))
    heads = comp.join(nodes.select("node", "least"), "node").groupBy("comp").agg(F.min(F.struct("least", "node")).alias("h"))
    heads = comp.join(heads, "comp").select("node", F.col("h.least").alias("class_id"), F.expr("node = h.node").alias("head"))
    out = nodes.join(heads, "node", "left").select("k1", "k2", "least", F.coalesce("class_id", "least").alias("class_id"), F.coalesce("head", F.lit(True)).alias("head"))
    out = folders.stored(out, "classes")
    folders.clear("classes")
    return out


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, class_id: one row for each row of the table."""
    of = classes(df, key, text, **options).select("k1", "k2", "class_id")
    members = _named(df, key, text).select("doc_id", "k1", "k2").join(of, ["k1", "k2"]).select("doc_id", "class_id")
    rest = df.filter(F.col(key).isNull() | F.col(text).isNull()).select(F.col(key).cast("long").alias("doc_id"))
    return members.union(rest.select("doc_id", F.col("doc_id").alias("class_id")))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The table's rows with one row for each class, that of the class's least id; of rows equal in id and text one stays.

    Rows without an id or a text belong to no class and stay as they are.
    """
    a, b, c = ("__near_" + x for x in ("id", "k1", "k2"))
    heads = classes(df, key, text, **options).filter("head").select(F.col("least").alias(a), F.col("k1").alias(b), F.col("k2").alias(c))
    named = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull())
    named = named.withColumns({a: F.col(key).cast("long"), b: F.xxhash64(F.col(text).cast("string")), c: F.xxhash64(F.lit("second"), F.col(text).cast("string"))})
    kept = named.join(heads, [a, b, c], "left_semi").dropDuplicates([a, b, c]).select(*df.columns)
    return kept.union(df.filter(F.col(key).isNull() | F.col(text).isNull()))
