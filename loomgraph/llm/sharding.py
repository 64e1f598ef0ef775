"""Sharding by balanced label propagation: equal counts, with linked documents together where they fit.

Documents with equal texts are linked. Every document starts in a shard that its id's hash gives. In each
round the linked documents look at where the documents that they are linked with are, by one join through
their common text, and move towards the shards that hold most of them, as far as the quotas allow. Quotas
come from a matrix of shards by shards, whose size doesn't depend on the data. At last the counts are made
even: what a shard holds beyond its share, unlinked documents first, fills up the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import written


@dataclass(frozen=True)
class Settings:
    """buckets: parts into which a shard's documents are split to number them."""

    shards: int = 24
    rounds: int = 5
    seed: int = 11
    buckets: int = 1024


def admitted(load: list[int], room: list[int], wish: dict[tuple[int, int], int]) -> list[float]:
    """For each shard the share of those who wish to enter that may, so that no load passes its room.

    wish: documents by (from, to). Who leaves makes room, so the shares are found by repetition from
    the most generous ones down.
    """
    k = len(load)
    share = [1.0] * k
    asked = [sum(n for (_, t), n in wish.items() if t == s) for s in range(k)]
    for _ in range(100):
        out = [sum(n * share[t] for (f, t), n in wish.items() if f == s) for s in range(k)]
        new = [min(share[s], max(0.0, (room[s] - load[s] + out[s]) / asked[s])) if asked[s] else 1.0 for s in range(k)]
        if new == share:
            break
        share = new
    return share


def _round(linked: DataFrame, room: list[int], s: Settings, turn: int) -> tuple[DataFrame, int]:
    """One round over the linked documents: rows with new shards, and how many wished to move."""
    held = linked.groupBy("text_key", "group_size", "shard").agg(F.count(F.lit(1)).alias("n"))
    fits = F.ceil(F.col("group_size") / F.lit(max(1, min(room)))).cast("int")
    ranked = held.withColumn("nth", F.row_number().over(Window.partitionBy("text_key").orderBy(F.desc("n"), "shard")))
    homes = ranked.filter(F.col("nth") <= fits).groupBy("text_key").agg(F.array_sort(F.collect_set("shard")).alias("homes"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(s.seed), F.lit(turn)), F.lit(1 << 40))
    target = F.when(F.array_contains("homes", F.col("shard")), F.col("shard")).otherwise(F.element_at("homes", (drawn % F.size("homes")).cast("int") + 1))
    wishing = written(linked.join(homes, "text_key").withColumn("to", target).drop("homes"), "shard-round")
    flows = {(r["shard"], r["to"]): r["n"] for r in wishing.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n")).collect()}
    load = [sum(n for (f, _), n in flows.items() if f == k) for k in range(s.shards)]
    wish = {ft: n for ft, n in flows.items() if ft[0] != ft[1]}
    share = F.element_at(F.array(*map(F.lit, admitted(load, room, wish))), F.col("to") + 1)
    together = F.when(F.col("group_size") > min(room), F.xxhash64("doc_id")).otherwise(F.xxhash64("text_key"))
    lucky = F.pmod(F.xxhash64(together, F.lit(s.seed + 1), F.lit(turn)), F.lit(1_000_003)) / F.lit(1_000_003)
    return wishing.withColumn("shard", F.when(lucky < share, F.col("to")).otherwise(F.col("shard"))).drop("to"), sum(wish.values())


def _by_shard(values: list[int]):
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col("shard") + 1)


def sharded(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard and group_size for each row of docs.

    Counts of the shards differ by one at most; the first shards have the one more. Slots run from 0
    without gaps. size is the text's UTF-8 bytes and 8, text_crc32 is over those bytes; grown_shard is
    null under this law. A group larger than a shard keeps as many shards as it needs. Within a shard slots
    follow buckets, which follow the ids, and rows without an id are spread over all of them.

    Edge cases: a null text is empty, and empty texts are linked with each other; null ids are placed
    like others; repeated rows are placed one by one, in either order, as they can't be told apart; with
    fewer rows than shards some stay empty; an empty table gives no rows. Other columns aren't looked at.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.md5(raw)).alias("text_key"))
    # Where each row starts and is put in order: by its id, and without one by its place, so that no task gets all of those.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text_key", F.monotonically_increasing_id(), F.lit(s.seed))).otherwise(F.xxhash64("doc_id", F.lit(s.seed)))
    rows = rows.withColumn("spread", spread)
    rows = written(rows.withColumn("shard", F.pmod("spread", F.lit(s.shards)).cast("int")), "shard-rows")
    total = rows.count()
    room = [total // s.shards + (k < total % s.shards) for k in range(s.shards)]
    groups = rows.groupBy(F.col("text_key").alias("of")).agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    grouped = written(rows.join(groups, F.col("text_key") == F.col("of"), "left").drop("of"), "shard-groups")
    linked, alone = grouped.filter("group_size > 1"), grouped.filter("group_size IS NULL")
    for turn in range(s.rounds):
        linked, wished = _round(linked, room, s, turn)
        if not wished:
            break
    return _even(linked.unionByName(alone), room, s)


def _even(placed: DataFrame, room: list[int], s: Settings) -> DataFrame:
    bucket = F.when(F.col("group_size").isNull(), s.buckets).otherwise(0) + F.pmod(F.xxhash64("spread", F.lit(s.seed + 2)), F.lit(s.buckets))
    placed = written(placed.withColumn("bucket", bucket.cast("int")), "shard-placed")
    sizes = placed.groupBy(F.col("shard").alias("of"), F.col("bucket").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("of").orderBy("at")) - F.col("n")).drop("n")
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_key"))
    numbered = placed.withColumn("nth", nth).join(before, (F.col("shard") == F.col("of")) & (F.col("bucket") == F.col("at")))
    numbered = numbered.withColumn("rank", F.col("before") + F.col("nth") - 1)
    load = [0] * len(room)
    for r in sizes.groupBy("of").agg(F.sum("n").alias("n")).collect():
        load[r["of"]] = r["n"]
    over, under = ([max(0, x - y) for x, y in zip(a, b)] for a, b in ((load, room), (room, load)))
    ahead = [sum(over[:k]) for k in range(len(room))]
    spare = F.col("rank") - _by_shard(room) + _by_shard(ahead)  # the number of a document that has to go
    to, slot, at = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for k, n in enumerate(under):
        if n:
            mine = (F.col("spare") >= at) & (F.col("spare") < at + n)
            to, slot = F.when(mine, F.lit(k)).otherwise(to), F.when(mine, F.col("spare") - at + load[k]).otherwise(slot)
            at += n
    stays = F.col("rank") < _by_shard(room)
    return numbered.withColumn("spare", spare).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.when(stays, F.col("shard")).otherwise(to).alias("shard"),
        F.when(stays, F.col("rank")).otherwise(slot).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
    )
