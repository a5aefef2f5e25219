"""Sharding by balanced label propagation.

Documents that share a link (equal texts, or any membership table) are neighbours. A document's label is its shard. In each round every link
proposes the shards that hold most of its members and have room for the rest; a document in none of them asks to move to one; what moves from
shard i to shard j is what moves back, plus the room that j has. Documents without a neighbour fill the shards up at the end.

Law `rows`: the shards' numbers of rows differ by one at most. Each round is a few joins on links and rows; the driver sees counts for pairs of
shards only. What a link proposes is joined with its members by salted parts of BIG rows, so that a link of any size goes to many tasks.

Null texts have no neighbours and count 0 bytes, crc32 0. Empty texts are equal texts. Repeated rows and ids are rows of their own. An empty
table gives an empty result. Only doc_id and text are read, so further columns may have any name. Text length doesn't matter: digests move.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazmill.llm.common import Folders, ranked, stored

#: Bytes that a document takes besides its text.
HEADER = 16
ROUNDS = 12
#: Members of a link that meet its proposals in one task.
BIG = 1000
#: The table of moves between shards passes through the driver.
MOST_SHARDS = 2000


def documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row (unique), doc_id, size, text_crc32 and link, a digest of the text."""
    body = F.col(text).cast("string")
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), (F.coalesce(F.octet_length(body), F.lit(0)) + HEADER).cast("long").alias("size"),
        F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("text_crc32"), F.substring(F.unhex(F.sha2(body, 256)), 1, 16).alias("link"),
    )


def quotas(rows: int, shards: int) -> list[int]:
    """The rows of each shard, at most one apart."""
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def _share(*what: Column) -> Column:
    """A number in [0, 1) that follows from the columns."""
    return F.shiftrightunsigned(F.xxhash64(*what), 11) / F.lit(float(1 << 53))


def proposals(state: DataFrame, room: list[int], turn: int) -> DataFrame:
    """row, shard, link, n, target from (row, link, n, shard): of a row's links the one with most members decides. n: the link's members.

    A link keeps the shard with most of its members among those with room for all of it (one shard without members, drawn by room, is
    a candidate as well). Where none has, it keeps the fewest shards, those with most members first, whose members and room hold it.
    """
    cells = state.groupBy("link", "shard").agg(F.count("*").alias("here"))
    rooms, ends = F.array(*[F.lit(int(r)).cast("long") for r in room]), np.cumsum(room)
    entry = F.struct((-F.col("here")).alias("less"), F.xxhash64("link", "shard").alias("tie"), F.col("shard"), F.get(rooms, F.col("shard")).alias("room"))
    lists = cells.groupBy("link").agg(F.sum("here").alias("n"), F.collect_list(entry).alias("held"))  # an entry for each shard at most
    drawn = _share(F.col("link"), F.lit(turn)) * F.lit(int(ends[-1]))
    other = F.size(F.filter(F.array(*[F.lit(int(e)).cast("long") for e in ends]), lambda e: e <= drawn))
    more = F.struct(F.lit(0).cast("long").alias("less"), F.xxhash64("link", other).alias("tie"), other.alias("shard"), F.get(rooms, other).alias("room"))
    new = (other < len(room)) & ~F.array_contains(F.transform("held", lambda x: x.shard), other)
    lists = lists.withColumn("held", F.when(new, F.concat("held", F.array(more))).otherwise(F.col("held")))
    lists = lists.select("link", "n", F.array_sort(F.transform("held", lambda x: F.struct((x.room - x.less < F.col("n")).alias("tight"), x.less.alias("less"), x.tie.alias("tie"), x.shard.alias("shard"), x.room.alias("room")))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).cast("long").alias("inside"), F.lit(0).cast("long").alias("room"), F.array().cast("array<struct<shard:int,upto:bigint>>").alias("kept"))
    grown = lambda acc, x: F.struct((acc.held - x.less + x.room).alias("held"), (acc.inside - x.less).alias("inside"), (acc.room + x.room).alias("room"), F.concat(acc.kept, F.array(F.struct(x.shard.alias("shard"), (acc.room + x.room).alias("upto")))).alias("kept"))
    kept = lists.select("link", "n", F.aggregate("all", start, lambda acc, x: F.when(acc.held >= F.col("n"), acc).otherwise(grown(acc, x))).alias("to"))
    kept = kept.select("link", "n", F.col("to.kept").alias("kept"), (F.col("n") - F.col("to.inside")).alias("outside"))
    u = _share(F.col("row"), F.lit(turn)) * F.col("outside")  # those outside fill one shard's room after the other
    drawn = F.get(F.filter("kept", lambda x: x.upto > u), F.lit(0)).shard
    stays = F.array_contains(F.transform("kept", lambda x: x.shard), F.col("shard"))
    kept = kept.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {BIG}"))))
    asked = state.withColumn("salt", F.pmod(F.xxhash64("row"), F.expr(f"n div {BIG} + 1"))).drop("n").join(kept, ["link", "salt"]).select("row", "shard", "link", "n", F.when(stays, F.col("shard")).otherwise(F.coalesce(drawn, F.col("shard"))).alias("target"))
    return asked.groupBy("row").agg(F.max(F.struct("n", "link", "target", "shard")).alias("best")).select("row", "best.shard", "best.link", "best.n", "best.target")


def accepted(wants: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many of those who want to move from i to j may: as many as move from j to i, and what finds room, counting room that others leave.

    The sum of a shard's arrivals never exceeds its room and its departures.
    """
    swap = np.minimum(wants, wants.T)
    rest = wants - swap
    share = np.zeros(len(room))
    for _ in range(len(room) + 50):
        leaves = (rest * share).sum(axis=1)
        asked = rest.sum(axis=0)
        new = np.where(asked > 0, np.clip((np.maximum(room, 0) + leaves) / np.maximum(asked, 1), 0, 1), 0)
        if np.abs(new - share).max() < 1e-9:
            break
        share = new
    return swap + rest * share


def propagate(members: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame | None:
    """row, shard, link, n of all rows of members (row, link; n, the link's members, is counted if it isn't there), with about the quota of rows in each shard at most; None without members."""
    members = members if "n" in members.columns else stored(sized(members), "shard-members")
    spark, shards, folders = members.sparkSession, len(quota), Folders(members.sparkSession, collect=False)
    labels = members.select("row").distinct().select("row", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"))
    sizes = np.zeros(shards, dtype=np.int64)
    for shard, n in labels.groupBy("shard").count().collect():  # a row for each shard
        sizes[shard] = n
    if not sizes.sum():
        return None
    for turn in range(rounds):
        room = np.array(quota, dtype=np.int64) - sizes
        asked = folders.stored(proposals(members.join(labels, "row"), np.maximum(room, 0).tolist(), turn), f"asked-{turn}")
        wants = np.zeros((shards, shards))
        for i, j, n in asked.groupBy("shard", "target").count().collect():  # a row for each pair of shards
            wants[i, j] = n
        np.fill_diagonal(wants, 0)
        may = accepted(wants, room)
        moves = [(int(i), int(j), float(may[i, j] / wants[i, j])) for i, j in zip(*np.nonzero(may))]
        folders.clear(f"asked-{turn}")
        chosen = asked
        if moves:
            table = spark.createDataFrame(moves, "shard int, target int, part double")  # shards * shards rows at most
            # Small links move as a whole, large ones in part.
            goes = _share(F.when(F.col("n") * 2 <= max(quota), F.col("link").cast("binary")).otherwise(F.col("row").cast("string").cast("binary")), F.lit(turn), F.lit("go")) < F.coalesce("part", F.lit(0.0))
            chosen = asked.join(F.broadcast(table), ["shard", "target"], "left").withColumn("shard", F.when(goes, F.col("target")).otherwise(F.col("shard"))).select("row", "shard", "link", "n")
        labels = chosen.select("row", "shard")
        if may.sum() < 1:
            break
        sizes[:] = 0
        for shard, n in labels.groupBy("shard").count().collect():
            sizes[shard] = n
    return chosen.select("row", "shard", "link", "n")


def sized(members: DataFrame, least: int = 1) -> DataFrame:
    """row, link, n of links with so many members. The counts are written first: as a table, they are a side of a join that Spark can split by skew."""
    counts = members.filter("link is not null").groupBy("link").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return members.select("row", "link").join(stored(counts, "shard-counts"), "link")


def neighbours(nodes: DataFrame) -> DataFrame:
    """row, link, n of the rows that share their link with another one."""
    return sized(nodes, 2)


def balance(nodes: DataFrame, members: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """The columns of nodes (row and others, not shard, slot, link, n or pos) with shard and slot; rows of members (row, link) that share a link are neighbours.

    Slots count from 0 in each shard, neighbours next to each other.
    """
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"1 to {MOST_SHARDS} shards")
    total = nodes.count()
    quota = quotas(total, shards)
    got = propagate(members, quota, rounds)
    out = [F.col(c) for c in nodes.columns]
    if got is None:
        placed = nodes.withColumns({"shard": F.lit(None).cast("int"), "link": F.lit(None).cast("binary"), "n": F.lit(None).cast("long")})
    else:
        placed = nodes.join(got.withColumn("link", F.col("link").cast("binary")), "row", "left")
    mixed = placed.withColumn("mixed", F.xxhash64("row"))
    # Members of small links come first in a shard: what exceeds the quota belongs to large ones, which are split anyway.
    table, counts = ranked(mixed, ["shard"], ["n", "link", "mixed", "row"], "shards")
    held = {shard: n for shard, n in counts.collect()}  # a row for each shard
    over = [max(0, held.get(j, 0) - quota[j]) for j in range(shards)]
    kept = [min(held.get(j, 0), quota[j]) for j in range(shards)]
    ends, base, loose = np.cumsum([q - k for q, k in zip(quota, kept)]), np.cumsum([0, *over]), held.get(None, 0)
    of = lambda values, index: F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), index)
    stays = F.col("shard").isNotNull() & (F.col("pos") < of(quota, F.col("shard")))
    turn = F.when(F.col("shard").isNull(), F.col("pos")).otherwise(F.lit(loose) + of(base, F.col("shard")) + F.col("pos") - of(quota, F.col("shard")))
    free = table.withColumn("stays", stays).withColumn("turn", F.when(~F.col("stays"), turn))
    ends_of = F.array(*[F.lit(int(v)).cast("long") for v in ends])
    filled = F.size(F.filter(ends_of, lambda e: e <= F.col("turn")))
    free = free.withColumn("to", F.when(F.col("stays"), F.col("shard")).otherwise(filled))
    begin = [int(k) - int(e) + (q - k) for k, e, q in zip(kept, ends, quota)]
    slot = F.when(F.col("stays"), F.col("pos")).otherwise(F.col("turn") + of(begin, F.col("to")))
    return free.select(*out, F.col("to").cast("int").alias("shard"), slot.cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40, rounds: int = ROUNDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law isn't `key`); equal texts are neighbours."""
    nodes = stored(documents(docs, key, text), "shard-rows")
    members = stored(neighbours(nodes), "shard-links")
    got = balance(nodes.drop("link"), members, shards, rounds)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
