"""Even shards that keep linked documents together: balanced label propagation by iterative joins.

Documents are linked through hubs: the default hub is the text, so equal texts are linked. Each
round counts, for every hub, how many of its documents are in each shard, joins the counts back to
the documents, and lets each wish for the shard of most neighbours (its own vote included; ties
fall the same way for all documents of a hub). Wishes are granted within quotas: from each shard to
each other, as many as find room below an equal share of all rows. Which ones is decided by a hash
of the hub, so documents of a hub move together. Rounds end when no wish is granted, or after ``ROUNDS``;
groups still apart then stay so, the law holds either way.

Then counts are made even exactly: documents are ranked within their shard, linked ones first, and
what exceeds a shard's share fills the others. Unlinked documents can go anywhere at no cost, so
they make room for linked ones. The law is ``rows``: counts are at most one apart.

Only tables of narrow rows are joined and only a shards x shards matrix of counts reaches the
driver. A hub of any size is one row of counts, made by partial sums.

Defined results: a null text has no bytes, like an empty one, and null and empty texts are linked;
rows that repeat an id and text are linked and each take a slot; a null id is an id like any other;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import Workspace

ROUNDS = 6
_PART_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def equal_text_links(docs: DataFrame) -> Column:
    """The hub of each document: a digest of its text."""
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def _start(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def _votes(placed: DataFrame, shards: int) -> DataFrame:
    """(hub, wish): the shard where most of the hub's documents are."""
    counts = placed.groupBy("hub").agg(*[F.sum((F.col("shard") == k).cast("long")).alias(f"n{k}") for k in range(shards)])
    # Count, then a draw that all of the hub's documents share, then the shard, in one number.
    ballots = [(F.col(f"n{k}") * 64 + F.pmod(F.xxhash64("hub", F.lit(k)), F.lit(64))) * shards + k for k in range(shards)]
    return counts.select("hub", F.pmod(F.greatest(*ballots), F.lit(shards)).cast("int").alias("wish"))


def grant(wishes: dict[tuple[int, int], int], held: list[int], share: int) -> dict[tuple[int, int], float]:
    """The part of the wishes from shard to shard that keeps all shards at or below their share."""
    left, granted = dict(wishes), dict.fromkeys(wishes, 0)
    held = list(held)
    for (s, t), n in wishes.items():  # swaps first: they change no count
        back = left.get((t, s), 0)
        if s < t and back:
            both = min(n, back)
            for pair in ((s, t), (t, s)):
                left[pair] -= both
                granted[pair] += both
    moved = True
    while moved:
        moved = False
        for (s, t), n in sorted(left.items()):
            some = min(n, max(share - held[t], 0))
            if some:
                left[(s, t)] -= some
                granted[(s, t)] += some
                held[t] += some
                held[s] -= some
                moved = True
    return {pair: granted[pair] / n for pair, n in wishes.items() if granted[pair]}


def propagate(linked: DataFrame, share: int, shards: int, work: Workspace, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, hub, size, text_crc32, shard) after the last round."""
    placed = work.write(linked.withColumn("shard", _start(F.struct("hub", "doc_id"), shards)), "round-0")
    for turn in range(1, rounds + 1):
        wished = placed.join(_votes(placed, shards), "hub")
        flows = {(r.shard, r.wish): r.n for r in wished.groupBy("shard", "wish").agg(F.count(F.lit(1)).alias("n")).collect()}  # shards ** 2 rows
        held = [sum(n for (s, _), n in flows.items() if s == k) for k in range(shards)]
        parts = grant({p: n for p, n in flows.items() if p[0] != p[1]}, held, share)
        if not parts:
            break
        draw = F.pmod(F.xxhash64("hub", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        allowed = F.coalesce(*[F.when((F.col("shard") == s) & (F.col("wish") == t), F.lit(part)) for (s, t), part in parts.items()], F.lit(0.0))
        placed = work.write(wished.withColumn("shard", F.when(draw < allowed, F.col("wish")).otherwise(F.col("shard"))).drop("wish"), f"round-{turn}")
    return placed


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, linked."""
    work = Workspace(docs.sparkSession, "shards")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    nodes = docs.select("doc_id", equal_text_links(docs).alias("hub"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    nodes = work.write(nodes, "nodes")
    hubs = nodes.groupBy("hub").agg(F.count(F.lit(1)).alias("members"))
    nodes = work.write(nodes.join(hubs, "hub").withColumn("linked", F.col("members") > 1).drop("members"), "linked")
    total = nodes.count()
    shares = [total // shards + (k < total % shards) for k in range(shards)]
    placed = propagate(nodes.where("linked").drop("linked"), shares[-1], shards, work, rounds).withColumn("linked", F.lit(True))
    alone = nodes.where(~F.col("linked")).withColumn("shard", _start(F.struct("hub", "doc_id"), shards))
    return _even(placed.unionByName(alone), shares, work)


def _even(placed: DataFrame, shares: list[int], work: Workspace) -> DataFrame:
    """Exact shares: rows beyond a shard's share, unlinked ones first, fill the shards below theirs."""
    order = [F.col("shard"), F.col("linked").desc(), F.col("hub"), F.col("doc_id"), F.col("text_crc32")]
    lined = work.write(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "lined")
    part = F.shiftright("at", _PART_BITS).alias("part")
    runs = lined.groupBy(part, "shard").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("part", "shard", "first", "before")
    ranked = lined.withColumn("part", part).join(runs, ["part", "shard"]).withColumn("rank", F.col("at") - F.col("first") + F.col("before"))

    held = dict.fromkeys(range(len(shares)), 0) | {r.shard: r.n for r in lined.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per shard
    kept = [min(held[k], s) for k, s in enumerate(shares)]
    over = [held[k] - kept[k] for k in range(len(shares))]
    room = [s - kept[k] for k, s in enumerate(shares)]

    def by_shard(values: list[int]) -> Column:
        return F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("shard"))

    spare = F.col("rank") - by_shard(kept) + by_shard([sum(over[:k]) for k in range(len(shares))])
    to_shard, to_slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k in reversed(range(len(shares))):  # the k-th stretch of the spare rows fills the room of shard k
        low, high = sum(room[:k]), sum(room[: k + 1])
        to_shard = F.when(spare < high, F.lit(k)).otherwise(to_shard)
        to_slot = F.when(spare < high, spare - low + kept[k]).otherwise(to_slot)
    stays = F.col("rank") < by_shard(kept)
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.when(stays, F.col("shard")).otherwise(to_shard).alias("shard"),
        F.when(stays, F.col("rank")).otherwise(to_slot).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "linked",
    )
