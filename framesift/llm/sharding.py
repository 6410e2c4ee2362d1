"""Shards of even size by balanced label propagation.

Every document starts in a shard by hash.  In each round, documents that share a link (a key, such as
the hash of their text) look where the others with it are: counts per (key, shard) are
pre-aggregated, so no pair of linked documents is ever formed, and a key that holds a third of all rows
is a row of counts like any other.  A document wants to move to the shard where most of its
neighbours are.  Moves between shards get quotas from an 8 by 8 table of wishes, so that no shard is
filled past its capacity with linked documents; a shard that one key has filled no longer attracts
that key.  Documents without links cost nothing to move: they are dealt out last and make the row counts exact.

Only DataFrame functions; what reaches the driver are tables of shards by shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.common import join_hot
from framesift.session import cut_lineage

SHARDS, ROUNDS = 8, 20
#: Rows that one task numbers at most, about.
NUMBERED = 100_000
#: A shard counts as filled by a key that holds this share of its capacity, and as closed where fewer wishes than
#: the second share can be granted.
FILLED, CLOSED = 0.98, 0.05


def _numbered(rows: DataFrame, group: str, total: int, name: str) -> DataFrame:
    """Gapless numbers from 0 inside each value of ``group``, in an order of hashes.

    Rows are cut into buckets by hash; bucket sizes give offsets, so that a window never sees more
    than one bucket of a group.
    """
    buckets = max(1, -(-total // NUMBERED))
    cut = rows.withColumn("__b", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    sizes = cut.groupBy(group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy(group, "__b").orderBy(F.xxhash64("row"), "row")
    local = cut.withColumn("__l", F.row_number().over(inside) - 1)
    return local.join(offsets, [group, "__b"], "left").withColumn(name, F.col("__o") + F.col("__l")).drop("__b", "__o", "__l")


def _wishes(linked: DataFrame, shards: int, capacity: int, total: int, closed: set[int]) -> DataFrame:
    """(row, shard, wish) of linked rows: the shard with most neighbours.

    A row may have several keys; each votes with the share of its rows in every shard.  A shard that
    the key has filled, or that is ``closed`` as it had no room, attracts no row from elsewhere.
    """
    here = [F.count_if(F.col("shard") == s) for s in range(shards)]
    counts = linked.groupBy("key").agg(F.array(*here).alias("in_shard"), F.count(F.lit(1)).alias("n"))
    met = join_hot(linked, counts, "key", "n", total)
    full = F.lit(int(FILLED * capacity))

    def vote(c: Column, s: Column) -> Column:
        share = c.cast("double") / F.col("n")
        own = s == F.col("shard")
        return F.when(own, share).when((c >= full) | s.isin(sorted(closed)), F.lit(0.0)).otherwise(share)

    votes = met.select("row", "shard", F.transform("in_shard", vote).alias("v"), F.xxhash64("key").alias("h"))
    summed = votes.groupBy("row", "shard").agg(*[F.sum(F.col("v")[s]).alias(f"v{s}") for s in range(shards)], F.min("h").alias("h"))
    # Equal counts are settled alike for all rows of a key: by a shard order of its own.
    score = lambda s: F.struct(F.round(f"v{s}", 9).alias("v"), F.pmod(F.xxhash64("h", F.lit(s)), F.lit(1 << 20)).alias("o"), F.lit(s).alias("s"))
    best = F.greatest(*[score(s) for s in range(shards)])
    return summed.select("row", "shard", best["s"].alias("wish"))


def _quotas(wanted: dict[tuple[int, int], int], sizes: list[int], capacity: int) -> dict[int, float]:
    """Share of the wishes into each shard that is granted, so that none is filled past its capacity."""
    share = {s: 1.0 for s in range(len(sizes))}
    for _ in range(20):
        for s in share:
            coming = sum(n for (a, b), n in wanted.items() if b == s)
            going = sum(n * share[b] for (a, b), n in wanted.items() if a == s)
            room = max(0.0, capacity - sizes[s] + going)
            share[s] = min(1.0, room / coming) if coming else 1.0
    return share


def assign(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(row, shard, slot) for ``rows`` (row long, keys array<binary or string>).

    Row counts of the shards are at most one apart and slots are gapless from 0.  ``row`` must be
    unique and never null; null or empty ``keys`` mean no link, and so does a key that only one row has.
    """
    total = rows.count()
    capacity = -(-total // shards)
    keyed = rows.select("row", F.explode(F.array_distinct("keys")).alias("key")).where(F.col("key").isNotNull())
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    start = F.pmod(F.xxhash64("row", F.lit(7)), F.lit(shards)).cast("int")
    linked = cut_lineage(join_hot(keyed, sizes, "key", "__n", total).select("row", "key", start.alias("shard")), "linked")
    closed: set[int] = set()
    for turn in range(rounds):
        wishes = cut_lineage(_wishes(linked, shards, capacity, total, closed), "wishes")
        table = wishes.groupBy("shard", "wish").agg(F.count(F.lit(1)).alias("n")).collect()
        filled = [sum(r.n for r in table if r.shard == s) for s in range(shards)]
        wanted = {(r.shard, r.wish): r.n for r in table if r.shard != r.wish}
        share = _quotas(wanted, filled, capacity)
        full = {s for s, x in share.items() if x < CLOSED} - closed
        if full:
            # The rows that want to go there look for the next best shard at once.
            closed |= full
            continue
        # Settled only where not one linked row has a move granted, however many rows there are.
        if sum(n * share[b] for (_, b), n in wanted.items()) < 1:
            break
        granted = F.element_at(F.array(*[F.lit(share[s]) for s in range(shards)]), F.col("wish") + 1)
        drawn = F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
        now = wishes.select("row", F.when(drawn < granted, F.col("wish")).otherwise(F.col("shard")).alias("shard"))
        linked = cut_lineage(linked.drop("shard").join(now, "row"), "linked")
    placed = linked.select("row", "shard").distinct()
    # Rows without links wait in pool -1, and what a shard holds past its capacity joins them.
    pool = rows.select("row").join(placed, "row", "left").select("row", F.coalesce("shard", F.lit(-1)).alias("pool"))
    numbered = cut_lineage(_numbered(pool, "pool", total, "at"), "numbered")
    counts = {r.pool: r.n for r in numbered.groupBy("pool").agg(F.count(F.lit(1)).alias("n")).collect()}
    target = [total // shards + (s < total % shards) for s in range(shards)]
    kept = [min(counts.get(s, 0), target[s]) for s in range(shards)]
    room, free = [target[s] - kept[s] for s in range(shards)], counts.get(-1, 0)
    over, ends, first = {}, [], free
    for s in range(shards):
        over[s] = first - kept[s]
        first += counts.get(s, 0) - kept[s]
        ends.append(sum(room[: s + 1]))
    pick = lambda values, index: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), index + 1)
    index = F.greatest(F.col("pool"), F.lit(0))
    stays = (F.col("pool") >= 0) & (F.col("at") < pick(kept, index))
    queue = F.when(F.col("pool") < 0, F.col("at")).otherwise(F.col("at") + pick([over[s] for s in range(shards)], index))
    to = F.size(F.filter(F.array(*[F.lit(int(e)).cast("long") for e in ends]), lambda e: e <= F.col("queue")))
    dealt = numbered.withColumn("queue", queue).withColumn("to", F.least(to, F.lit(shards - 1)))
    slot = F.when(stays, F.col("at")).otherwise(F.col("queue") - pick([e - r for e, r in zip(ends, room)], F.col("to")) + pick(kept, F.col("to")))
    return dealt.select("row", F.when(stays, F.col("pool")).otherwise(F.col("to")).cast("int").alias("shard"), slot.cast("long").alias("slot"))


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, linked.

    Documents with equal texts are linked.  The law is ``rows``: row counts of the shards are at most
    one apart; ``grown_shard`` is null under it.  ``size`` is the UTF-8 bytes of the text plus 1 (a null
    text has none, links to nothing and has CRC 0); empty texts are equal texts.  Null and repeated doc_ids
    are rows like any other, an empty table gives no rows, other columns are not read.
    """
    narrow = docs.select(
        F.col("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), F.monotonically_increasing_id().alias("row"))
    # Written once: the row numbers are then fixed.
    fixed = cut_lineage(narrow, "documents")
    found = assign(fixed.select("row", F.when(F.col("key").isNotNull(), F.array("key")).alias("keys")), shards, rounds)
    return fixed.join(found, "row").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
