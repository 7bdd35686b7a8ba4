"""Sharding by balanced label propagation, law ``rows``: shard counts differ by one row at most.

Documents of equal text are linked.  Every document starts in a shard by the hash of its id.  Each round,
Spark joins and aggregations count for every group how many members each shard holds; members outside the group's
fullest shard ask to move there (equal ones to a shard drawn anew each round, so that requests run all ways), and quotas grant
the moves: pairs and longer cycles of shards exchange rows, and paths of requests end in free room. Requests are summed by pair and
hash bucket, and whole buckets are granted while their running sum fits the quota.  A granted move leaves its group in one shard
less, so rounds end: when less than ``LEAST`` of the linked rows move ``IDLE`` times in a row.  A group above a shard's capacity is dealt by
hash into parts that fit one shard.  Then shards are made even: each keeps its first
quota of rows, large groups before small ones and those before single rows, and what is above goes to the holes of shards
below theirs; a small group's rows are neighbours, so it goes whole but where a shard's quota or holes end.

No task holds a shard or a group: places in a shard are counted by hash buckets (sizes summed, offsets
added), and quotas by sums of buckets.
"""

from __future__ import annotations

from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS = 40
SETTLING = 6          # times quotas are fitted to whole buckets
IDLE = 4              # rounds that move too little, each with ties drawn anew, that end the propagation
LEAST = 0.003         # share of the linked rows that a round must move
BUCKETS = 256         # hash buckets of the requests of a pair of shards
ROWS_A_BUCKET = 2000  # rows a numbering bucket holds on average
OVERHEAD = 16


def _hash(of: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), of)


def _pick(values: list[int], at: Column) -> Column:
    """The number of a shard, from a short list: one text literal, as a literal a number takes the driver long to build."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ","), (at + 1).cast("int")).cast("long")


def _of_pairs(spark: SparkSession, values: dict[tuple[int, int], int], name: str) -> DataFrame:
    """(shard, target, name): one row a pair of shards, so at most ``shards`` squared, broadcast."""
    columns = [[k[0] for k in values], [k[1] for k in values], list(values.values())]
    return F.broadcast(spark.createDataFrame(pa.table(
        [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], ["shard", "target", name])))


def _quotas(asked: dict[tuple[int, int], int], free: list[int], shards: int) -> list[int]:
    """Rows that may move from s to t, at s * shards + t, so that no load grows by more than its free room.

    Requests are edges; a node ``shards`` stands for free room.  Pairs, then longer cycles, are granted their least edge."""
    left: list[dict[int, int]] = [{} for _ in range(shards + 1)]
    for (s, t), n in sorted(asked.items()):
        left[s][t] = n
        left[shards][s] = sum(asked.values()) + sum(free)
    for t in range(shards):
        if free[t]:
            left[t][shards] = free[t]
    out = [0] * (shards * shards)

    def grant(cycle: list[int]) -> None:
        edges = list(zip(cycle, [*cycle[1:], cycle[0]]))
        n = min(left[s][t] for s, t in edges)
        for s, t in edges:
            if s < shards and t < shards:
                out[s * shards + t] += n
            left[s][t] -= n
            if not left[s][t]:
                del left[s][t]

    for s in range(shards):
        for t in range(s):
            if t in left[s] and s in left[t]:
                grant([s, t])
    for start in range(shards):
        walk = [start]
        while walk:
            at = walk[-1]
            if not left[at]:  # on no cycle
                walk.pop()
                if walk:
                    del left[walk[-1]][at]
                continue
            to = max(left[at], key=lambda t: (left[at][t], -t))
            if to in walk:
                cycle = walk[walk.index(to):]
                grant(cycle)
                del walk[walk.index(to) + 1:]
            else:
                walk.append(to)
    return out


def _pairs(flat: list[int], shards: int) -> dict[tuple[int, int], int]:
    return {(k // shards, k % shards): n for k, n in enumerate(flat) if n}


def propagate(linked: DataFrame, room: list[int], shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """(doc_id, text_id, size, grp, shard): labels after balanced propagation.

    ``linked``: rows (.., grp, mark, shard) of documents in groups of two and more; ``room``: rows each shard may hold.
    Cells (group, shard) move whole; the driver sees one load a shard and one sum a pair of shards each round."""
    spark = linked.sparkSession
    cells = cut(linked.groupBy("grp", "shard").agg(F.count("*").alias("n")).withColumn("home", F.col("shard")), "cells")
    idle = 0
    for step in count() if rounds is None else range(rounds):
        loads = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        free = [max(0, room[s] - loads.get(s, 0)) for s in range(shards)]
        now = cells.groupBy("grp", "shard").agg(F.sum("n").alias("n"))
        # a group's target is its fullest shard, in every other round its fullest shard with room
        open_ = F.lit(True) if step % 2 == 0 else _pick(free, F.col("shard")) > 0
        tie = _hash(F.concat_ws(" ", "grp", "shard", F.lit(step)), 1)
        rank = F.struct(open_.alias("open"), F.col("n"), tie.alias("h"), F.col("shard"))
        target = now.groupBy("grp").agg(F.max(rank).alias("t"), F.count("*").alias("shards")).filter("shards > 1 AND t.open").select(
            "grp", F.col("t.shard").alias("target"), F.col("t.n").alias("there"))
        asked = (now.join(target, "grp").filter("shard <> target" if step % 2 else "shard <> target AND n <= there")
                 .withColumn("bucket", F.pmod(_hash(F.concat_ws(" ", "grp", "shard", F.lit(step)), 2), F.lit(BUCKETS)).cast("int"))
                 # large cells first: they find room only while much is exchanged
                 .withColumn("bucket", F.col("bucket") + BUCKETS * (63 - F.floor(F.log2("n"))).cast("int")))
        asked = cut(asked.select("grp", "shard", "target", "n", "bucket"), "asked")
        wish = {(r["shard"], r["target"]): r["n"] for r in asked.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect()}
        if not wish and step % 2 == 0:  # every group is whole: its lesser shards would ask
            break
        quota = _pairs(_quotas(wish, free, shards), shards)
        # a cell above its quota would hold up all behind it
        asked = asked.join(_of_pairs(spark, quota, "quota"), ["shard", "target"]).filter("n <= quota").drop("quota")
        sums = asked.groupBy("shard", "target", "bucket").agg(F.sum("n").alias("n"))
        upto = cut(sums.withColumn("upto", F.sum("n").over(Window.partitionBy("shard", "target").orderBy("bucket"))), "upto")
        for settling in range(SETTLING + 1):  # whole buckets may stay under a quota; then what runs against them is taken back
            fits = upto.join(_of_pairs(spark, quota, "quota"), ["shard", "target"]).filter("upto <= quota").groupBy(
                "shard", "target").agg(F.max("bucket").alias("last"), F.max("upto").alias("n")).collect()  # one row a pair of shards
            moved = sum(r["n"] for r in fits)
            if moved == sum(quota.values()) or settling == SETTLING:
                break
            granted = {(r["shard"], r["target"]): r["n"] for r in fits}
            if settling < SETTLING - 1:
                quota = _pairs(_quotas(granted, free, shards), shards)
            else:  # not settled: into free room alone, which holds whatever part of it moves
                quota, room_left = {}, list(free)
                for (s, t), n in sorted(granted.items()):
                    if n <= room_left[t]:
                        quota[s, t] = n
                        room_left[t] -= n
        idle = idle + 1 if moved <= LEAST * sum(loads.values()) else 0
        if idle == IDLE:
            break
        if not fits:
            continue
        limits = _of_pairs(spark, {(r["shard"], r["target"]): r["last"] for r in fits}, "last")
        moves = asked.join(limits, ["shard", "target"]).filter(F.col("bucket") <= F.col("last")).select("grp", "shard", "target")
        cells = cut(cells.join(moves, ["grp", "shard"], "left").select(
            "grp", "n", "home", F.coalesce("target", "shard").alias("shard")), "cells")
    moved = cells.filter("home <> shard").select("grp", F.col("home").alias("shard"), F.col("shard").alias("to"))
    return linked.join(moved, ["grp", "shard"], "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")


def _numbered(rows: DataFrame, n_rows: int, shards: int) -> DataFrame:
    """``rows`` with ``place``: gapless from 0 within each shard; large groups, small ones each in one run, single rows."""
    buckets = max(1, n_rows // (shards * ROWS_A_BUCKET))
    key = F.when(F.col("single") == 1, _hash(F.col("grp"), 5)).otherwise(F.col("mark"))
    keyed = rows.withColumn("key", key).withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    sums = keyed.groupBy("shard", "single", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("single", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("shard", "single", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "single", "bucket").orderBy("key", "grp", "mark", "doc_id", "text_id")
    numbered = keyed.withColumn("at", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["shard", "single", "bucket"]).withColumn("place", F.col("offset") + F.col("at")).drop(
        "offset", "at", "bucket", "key")


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    Null and empty texts are equal (size 16, crc32 0); repeated rows are rows of their own; null ids are hashed as empty
    text; other columns are not read; an empty table gives an empty result."""
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    slim = cut(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(data) + OVERHEAD).cast("long").alias("size"),
                           F.crc32(data).alias("text_crc32"), F.md5(data).alias("text_id"), _hash(key, 0).alias("mark"))
               .withColumn("shard", F.pmod(_hash(F.col("mark"), 3), F.lit(shards)).cast("int")), "slim")
    n_rows = slim.count()
    quota = [n_rows // shards + (s < n_rows % shards) for s in range(shards)]
    capacity = max(1, n_rows // shards * 9 // 10)
    groups = slim.groupBy("text_id").agg(F.count("*").alias("members")).filter("members > 1")
    parts = F.ceil(F.col("members") / capacity)
    tied = slim.join(groups, "text_id", "left").withColumn(
        "single", F.when(F.col("members") > min(ROWS_A_BUCKET, max(2, capacity // 10)), 0).when(F.col("members") > 1, 1).otherwise(2))
    tied = cut(tied.withColumn("grp", F.when(F.col("members") > 1, F.concat_ws(
        ":", "text_id", F.pmod(_hash(F.col("mark"), 4), parts).cast("string")))).drop("members"), "tied")
    linked = propagate(tied.filter("single < 2"), quota, shards, rounds)
    rows = cut(linked.select(*tied.columns).union(tied.filter("single = 2")), "labelled")
    placed = cut(_numbered(rows, n_rows, shards).select("doc_id", "size", "text_crc32", "shard", "place"), "placed")

    loads = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    load = [loads.get(s, 0) for s in range(shards)]
    extra_before, holes_before, extra, holes = [], [], 0, 0
    for s in range(shards):  # ``shards`` numbers, all on the driver
        extra_before.append(extra)
        holes_before.append(holes)
        extra += max(0, load[s] - quota[s])
        holes += max(0, quota[s] - load[s])
    over = F.col("place") - _pick(quota, F.col("shard"))
    nth = _pick(extra_before, F.col("shard")) + over  # of the rows that must go, which takes the nth hole
    to = F.size(F.filter(F.array(*(F.lit(h).cast("long") for h in holes_before)), lambda h: h <= F.col("nth"))) - 1
    out = placed.withColumn("nth", F.when(over >= 0, nth)).withColumn("to", to.cast("int"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.when(F.col("nth").isNull(), F.col("shard")).otherwise(F.col("to")).cast("int").alias("shard"),
        F.when(F.col("nth").isNull(), F.col("place")).otherwise(
            _pick(load, F.col("to")) + F.col("nth") - _pick(holes_before, F.col("to"))).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
