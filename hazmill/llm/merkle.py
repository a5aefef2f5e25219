"""Merkle manifest of a table: 8-ary hash trees by language, their roots under one root, and a proof for each row.

A leaf is the SHA-256 (lower-case hex) of a row's fields, each as its UTF-8 byte count, `:` and value, or `-` for null. A language's leaves
ascend by doc_id; runs of 8 nodes become the hash of their hex digests until one node remains. The languages' subroots (null first) go on likewise.

Leaves are dealt into aligned buckets of 8**4 positions. Executors hand whole buckets as Arrow tables to DuckDB, whose level queries
(string_agg in order, then sha256) give the buckets' roots. Spark combines these, 8 at a time, joins each bucket's outer path back, and a
second pass of DuckDB gives proofs and folded roots. A task holds some buckets at a time, whatever a language's share of the rows.

Null doc_ids come first, rows of one doc_id by their leaves; equal rows have equal leaves, so which one stands first doesn't matter. A null text
can't be tampered with, nor can a row with a null doc_id. An empty table gives an empty result. Only the named columns are read. Texts of any length are hashed by Spark, as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazmill.llm.common import ranked, released, stored

FANOUT, LEVELS = 8, 4
BUCKET = FANOUT**LEVELS
#: Hex characters of a digest.
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_of(values: list[Column]) -> Column:
    """The digest of a row's fields."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, changed (the tampered leaf; null where nothing is tampered with) and a number that tells rows apart."""
    lowered = [F.translate("text", UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf_of([F.col(f) for f in FIELDS]).alias("leaf"), F.when(tampered, leaf_of(lowered)).alias("changed"), F.monotonically_increasing_id().alias("row"))


def _whole_buckets(batches: Iterator[pa.RecordBatch], most: int = 4 * BUCKET) -> Iterator[pa.Table]:
    """Tables of whole buckets from rows in order of bucket and position."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        begins = np.flatnonzero(np.asarray(part["pos"]) % BUCKET == 0)
        if rows >= most and len(begins):
            yield pa.concat_tables([*held, part.slice(0, begins[0])])
            part, held, rows = part.slice(begins[0]), [], 0
            begins = begins[1:] - begins[0]
            while len(begins) and part.num_rows >= most and begins[-1] >= most:
                cut = int(begins[np.searchsorted(begins, most)])
                yield part.slice(0, cut)
                part, begins = part.slice(cut), begins[begins > cut] - cut
        held.append(part)
        rows += part.num_rows
    if rows:
        yield pa.concat_tables(held)


def _engine():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    con.execute("set preserve_insertion_order = false")
    return con


def _climb(con) -> None:
    """Level queries over l0 (bucket, depth, i, h): r1 to r4 hold each run's digests in order, l1 to l4 its hash."""
    for k in range(LEVELS):
        con.execute(f"create or replace temp table r{k + 1} as select bucket, depth, i // {FANOUT} as i, string_agg(h, '' order by i) as run from l{k} where depth > {k} group by all")
        con.execute(f"create or replace temp table l{k + 1} as select bucket, depth, i, sha256(run) as h from r{k + 1}")


def _depth(n: np.ndarray) -> np.ndarray:
    """Levels that a language of n leaves climbs within its bucket."""
    out = np.zeros(len(n), dtype=np.int32)
    for k in range(LEVELS):
        out += n > FANOUT**k
    return out


def bucket_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket: lang, bucket, depth, ids, leaves, changed and its root."""
    con = _engine()
    for table in _whole_buckets(batches):
        pos = np.asarray(table["pos"])
        begins = np.flatnonzero(pos % BUCKET == 0)
        ends = np.append(begins[1:], len(pos)).astype(np.int32)
        bucket = np.repeat(np.arange(len(begins)), ends - begins)
        depth = _depth(np.asarray(table["total"]))
        con.register("given", pa.table({"bucket": bucket, "depth": depth, "i": pos % BUCKET, "h": table["leaf"]}))
        con.execute("create or replace temp table l0 as from given")
        _climb(con)
        roots = con.sql(" union all ".join(f"select bucket, h from l{k} where depth = {k}" for k in range(LEVELS + 1)) + " order by bucket").to_arrow_table()
        con.unregister("given")
        offsets = pa.array(np.append(begins, len(pos)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, table[c].combine_chunks()) for c in ("doc_id", "leaf", "changed")]
        yield pa.RecordBatch.from_arrays(
            [table["lang"].combine_chunks().take(pa.array(begins)), pa.array(pos[begins] // BUCKET), pa.array(depth[begins]), *lists, roots["h"].combine_chunks().cast(pa.string())],
            ["lang", "bucket", "depth", "ids", "leaves", "changed", "h"],
        )
    con.close()


def _proofs(con, part: pa.RecordBatch) -> pa.Table:
    """doc_id, leaf, subroot, proof_sha256, folded_root of some buckets' rows."""
    sizes = np.asarray(pc.list_value_length(part.column("ids")))
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    i = np.arange(len(bucket)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows = {c: part.column(c).flatten() for c in ("ids", "leaves", "changed")}
    con.register("given", pa.table({"bucket": bucket, "depth": np.asarray(part.column("depth"))[bucket], "i": i, "doc_id": rows["ids"], "h": rows["leaves"], "folded": pc.coalesce(rows["changed"], rows["leaves"])}))
    con.register("outer_paths", pa.table({"bucket": np.arange(len(sizes)), "path": part.column("path"), "subroot": part.column("subroot")}))
    con.execute("create or replace temp table l0 as select bucket, depth, i, h from given")
    con.execute("create or replace temp table f0 as select bucket, i, doc_id, h as leaf, folded, '' as siblings from given")
    _climb(con)
    for k in range(LEVELS):
        at = f"{HEX} * ((f.i // {FANOUT**k}) % {FANOUT})"
        con.execute(f"""
            create or replace temp table f{k + 1} as select f.bucket, f.i, doc_id, leaf,
              case when run is null then folded else sha256(left(run, {at}) || folded || substr(run, {at} + {HEX + 1})) end as folded,
              case when run is null then siblings else siblings || left(run, {at}) || substr(run, {at} + {HEX + 1}) end as siblings
            from f{k} f left join r{k + 1} r on f.bucket = r.bucket and f.i // {FANOUT ** (k + 1)} = r.i""")
    con.execute(f"create or replace temp table folding as select doc_id, leaf, subroot, sha256(siblings || coalesce(list_aggregate(list_transform(path, lambda x: x.before || x.behind), 'string_agg', ''), '')) as proof_sha256, folded, path from f{LEVELS} join outer_paths using (bucket)")
    highest = pc.max(pc.list_value_length(part.column("path"))).as_py() or 0
    for k in range(1, highest + 1):
        con.execute(f"create or replace temp table folding as select * replace (case when len(path) >= {k} then sha256(path[{k}].before || folded || path[{k}].behind) else folded end as folded) from folding")
    out = con.sql("select doc_id, leaf, subroot, proof_sha256, folded as folded_root from folding").to_arrow_table()
    con.unregister("given")
    con.unregister("outer_paths")
    return out


def bucket_proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _engine()
    for batch in batches:
        for at in range(0, batch.num_rows, 2):
            part = batch.slice(at, 2)
            got = _proofs(con, part).cast(pa.schema([("doc_id", part.column("ids").type.value_type), *((c, pa.string()) for c in ("leaf", "subroot", "proof_sha256", "folded_root"))]))
            yield from got.to_batches()
    con.close()


def combined(nodes: DataFrame, by: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Runs of 8 of (by, i from 0, h) become one node until each group has one: (by, i, path from each node upwards) and (by, h) of the tops."""
    top = nodes.select(*by, "i", "h")
    paths = nodes.select(*by, "i", F.col("i").alias("now"), F.array().cast("array<struct<before:string,behind:string>>").alias("path"))
    level = 0
    while (top.agg(F.max("i")).first()[0] or 0) > 0:  # one number
        level += 1
        runs = top.groupBy(*by, F.expr(f"i div {FANOUT}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("held"))  # 8 at most
        several = top.groupBy(*by).agg((F.max("i") > 0).alias("several"))
        runs = _joined(runs, several, by).withColumn("run", F.concat_ws("", F.col("held.h"))).select(*by, "up", "several", "run", F.col("held")[0].h.alias("lone"))
        runs = stored(runs, f"{name}-{level}")
        at = F.col("now") % FANOUT * HEX
        step = F.struct(F.expr(f"substring(run, 1, cast(now % {FANOUT} * {HEX} as int))").alias("before"), F.expr(f"substring(run, cast(now % {FANOUT} * {HEX} as int) + {HEX + 1}, {FANOUT * HEX})").alias("behind"))
        paths = _joined(paths.withColumn("up", F.expr(f"now div {FANOUT}")), runs.drop("lone"), [*by, "up"])
        paths = stored(paths.select(*by, "i", F.col("up").alias("now"), F.when(F.col("several"), F.concat("path", F.array(step))).otherwise(F.col("path")).alias("path")), f"{name}-paths-{level}")
        top = runs.select(*by, F.col("up").alias("i"), F.when(F.col("several"), F.sha2("run", 256)).otherwise(F.col("lone")).alias("h"))
    return paths.drop("now"), top.drop("i")


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which nulls are equal."""
    if not keys:
        return left.crossJoin(right)  # one row on the right
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.alias("l").join(right.alias("r"), on).select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in keys])


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = stored(leaves(docs), "merkle-hashes")  # the texts are read once: dealing leaves by range draws a sample first
    placed, counts = ranked(hashed, ["lang"], ["doc_id", "leaf", "row"], "merkle-leaves")
    rows = _joined(placed, stored(counts.withColumnRenamed("n", "total"), "merkle-counts"), ["lang"])
    rows = rows.select("lang", "doc_id", "leaf", "changed", F.col("pos").cast("long").alias("pos"), F.col("total").cast("long").alias("total"))
    dealt = rows.repartition(F.col("lang"), F.expr(f"pos div {BUCKET}")).sortWithinPartitions("lang", "pos")
    buckets = stored(dealt.mapInArrow(released(bucket_roots), f"lang string, bucket long, depth int, ids array<{kind}>, leaves array<string>, changed array<string>, h string"), "merkle-buckets")
    inner, tops = combined(buckets.select("lang", F.col("bucket").alias("i"), "h"), ["lang"], "merkle-lang")
    subroots, _ = ranked(tops, [], ["lang"], "merkle-subroots")
    upper, root = combined(subroots.select(F.col("pos").alias("i"), "h"), [], "merkle-root")
    first = root.first()
    if first is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    above = subroots.withColumnRenamed("pos", "i").join(upper, "i").select("lang", F.col("h").alias("subroot"), F.col("path").alias("upper"))
    outer = _joined(inner, above, ["lang"]).select("lang", F.col("i").alias("bucket"), "subroot", F.concat("path", "upper").alias("path"))
    given = _joined(buckets.drop("h"), stored(outer, "merkle-outer"), ["lang", "bucket"]).select("depth", "ids", "leaves", "changed", "subroot", "path")
    out = given.mapInArrow(released(bucket_proofs), f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")
    root_of = F.lit(first[0])
    return out.select("doc_id", "leaf", "subroot", root_of.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root_of).alias("verified"))


def oracle(levels: int = 9) -> str:
    """The same in SQL for a table `documents` of up to 8**levels rows a language, level by level."""
    enc = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    concat = lambda text: " || ".join(enc(text) if f == "text" else enc(f) for f in FIELDS)
    # CRC-32 bit by bit over the decimal's characters, in the reflected polynomial 0xEDB88320.
    bits = "list_reduce(range(8)::bigint[], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, xor(a, x))"
    crc = f"xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda a, x: {bits}, 4294967295::bigint), 4294967295)"
    steps = [
        f"t0 as (select doc_id, lang, sha256({concat('text')}) as leaf, case when doc_id is not null and {crc} % 3 = 0 then sha256({concat(low)}) end as changed from documents)",
        "a0 as (select doc_id, lang, leaf, coalesce(changed, leaf) as folded, '' as proof, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as m, leaf as h from t0)",
    ]

    def climb(name: str, group: str, keep: str) -> None:
        for k in range(levels):
            # A level's nodes once each; the run's digests, cut around the own node, are the siblings.
            steps.append(f"{name}n{k} as (select distinct {group} as g, i, h from {name}{k} where m > 1)")
            steps.append(f"{name}r{k} as (select g, i // 8 as i, string_agg(h, '' order by i) as run from {name}n{k} group by 1, 2)")
            steps.append(
                f"{name}{k + 1} as (select {keep}, case when run is null then folded else sha256(run[:64 * (s.i % 8)] || folded || run[64 * (s.i % 8) + 65:]) end as folded, "
                f"case when run is null then proof else proof || run[:64 * (s.i % 8)] || run[64 * (s.i % 8) + 65:] end as proof, s.i // 8 as i, (m + 7) // 8 as m, case when run is null then h else sha256(run) end as h "
                f"from {name}{k} s left join {name}r{k} r on r.g is not distinct from {group} and r.i = s.i // 8)"
            )

    climb("a", "lang", "doc_id, lang, leaf")
    steps.append(f"langs as (select lang, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as m from (select distinct lang from a{levels}))")
    steps.append(f"b0 as (select doc_id, leaf, folded, proof, h as subroot, h, l.i, l.m from a{levels} a join langs l on a.lang is not distinct from l.lang)")
    climb("b", "0", "doc_id, leaf, subroot")
    return "with " + ",\n".join(steps) + f"\nselect doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, folded as folded_root, folded = h as verified from b{levels}"
