"""Balanced label propagation of documents into shards, in DataFrame operations only.

Documents with equal texts are linked. The law is ``rows``: shard sizes differ by one document at most. Every document
starts in the shard of its id's hash. Unlinked documents gain nothing from any place, so the quotas bind the linked ones while
labels propagate, and unlinked ones fill up the shards at the end. In each round a linked document wants the shard that holds
most of its group among those with room left and its own; documents that share group, shard and one of ``PARTS`` parts decide
together. Two shards exchange as many documents as both directions want, and more go where there is room; if not all
requests fit, which are granted is drawn by a hash with the probability that the quotas allow. A group that is larger than a
shard fills one shard after the other. Rounds go on until two in a row leave the cut edges (pairs of linked documents in different
shards) as they were, ``ROUNDS`` at most. At the end, documents beyond a shard's quota, unlinked ones first, fill the
shards below it, so the sizes are exact.

Places in a shard are numbered by counts of hash buckets and a row number inside a bucket, so no task orders a shard.

Defined results: a null text has no bytes, links with nothing but other null texts and has the checksum of no bytes;
repeated rows are placed each; a null doc_id counts like any other value; ties go to the smaller shard; texts of any length
count by their whole bytes; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import derived, drop, materialize

SHARDS = 40
ROUNDS = 60
PARTS = 64
PER_BUCKET = 20_000


def _draw(*cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _lookup(values: dict, key: Column, default) -> Column:
    """Literal map of at most shards * shards entries."""
    if not values:
        return F.lit(default)
    flat = [F.lit(x) for kv in sorted(values.items()) for x in kv]
    return F.coalesce(F.element_at(F.create_map(*flat), key), F.lit(default))


def _probabilities(demand: dict[tuple[int, int], int], size: dict[int, int], quota: list[int]) -> dict[int, float]:
    """Share of the requests from s to t that is granted; keyed by s * shards + t. Input is bounded by shards squared."""
    n = len(quota)
    room = [quota[t] - size.get(t, 0) for t in range(n)]
    out: dict[int, float] = {}
    for t in range(n):
        swapped = {s: min(demand.get((s, t), 0), demand.get((t, s), 0)) for s in range(n) if s != t}
        rest = {s: demand.get((s, t), 0) - swapped[s] for s in swapped}
        wanted = sum(rest.values())
        extra = min(1.0, max(room[t], 0) / wanted) if wanted else 0.0
        for s, d in swapped.items():
            if demand.get((s, t), 0):
                out[s * n + t] = (d + rest[s] * extra) / demand[s, t]
    return out


def _cut(state: DataFrame) -> float:
    """Cut edges: pairs of linked documents that lie in different shards."""
    held = state.groupBy("g", "s").agg(F.sum("c").cast("double").alias("n"))
    return held.groupBy("g").agg((F.pow(F.sum("n"), F.lit(2)) - F.sum(F.col("n") * F.col("n"))).alias("cut")).agg(F.coalesce(F.sum("cut"), F.lit(0.0)) / 2).first()[0]


def propagate(groups: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(g, s0, part, s): the shard of each linked piece; groups(g, s0, part, c) has the documents of groups of two or more."""
    n = len(quota)
    state = groups.withColumn("s", F.col("s0"))
    sizes = {r.s: r.c for r in state.groupBy("s").agg(F.sum("c").alias("c")).collect()}  # at most ``shards`` rows
    least, still = None, 0
    for k in range(rounds):
        open_shards = [t for t in range(n) if quota[t] - sizes.get(t, 0) > quota[t] // 50]
        held = state.groupBy("g", "s").agg(F.sum("c").alias("n"))
        fullest = F.max_by("s", F.struct("n", -F.col("s")))
        most = F.struct("n", -F.col("s"))
        best = held.groupBy("g").agg(fullest.alias("first"), F.max(most).alias("top"), F.max(F.when(F.col("s").isin(open_shards), most)).alias("room"))
        # A piece moves to the fullest shard of its group, or, if that is full, to the fullest with room, if that holds more than its own.
        joined = state.join(best, "g").join(held, ["g", "s"])
        own = F.struct("n", -F.col("s"))
        goal = F.when(~F.col("first").isin(open_shards) & (F.col("room") > own), F.col("room")).otherwise(F.col("top"))
        target = F.when(goal > own, -goal.getItem("col2")).otherwise(F.col("s"))
        wants = materialize(joined.select("g", "s0", "part", "c", "s", target.cast("int").alias("t")), "wants")
        rows = wants.filter("s <> t").groupBy("s", "t").agg(F.sum("c").alias("c")).collect()  # at most shards squared
        demand = {(r.s, r.t): r.c for r in rows}
        if not demand:
            return derived(wants.select("g", "s0", "part", "s"), wants)
        chance = _lookup(_probabilities(demand, sizes, quota), F.col("s") * n + F.col("t"), 0.0)
        moved = F.when((F.col("s") != F.col("t")) & (_draw(F.col("g"), F.col("s0"), F.col("part"), F.lit(k)) < chance), F.col("t")).otherwise(F.col("s"))
        old, state = state, materialize(wants.withColumn("s", moved).select("g", "s0", "part", "c", "s"), "state")
        drop(wants, old)
        sizes = {r.s: r.c for r in state.groupBy("s").agg(F.sum("c").alias("c")).collect()}
        cut = _cut(state)
        still = still + 1 if least is not None and cut >= least else 0
        least = cut if least is None else min(least, cut)
        if still == 2 or not cut:
            break
    return derived(state.select("g", "s0", "part", "s"), state)


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs(doc_id, text)."""
    raw = F.col("text").cast("string")
    data = F.encode(F.coalesce(raw, F.lit("")), "UTF-8")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(data).cast("long").alias("bytes"), F.crc32(data).alias("text_crc32"), F.concat(F.hex(F.xxhash64(raw)), F.substring(F.sha1(data), 1, 16), F.when(raw.isNull(), "-").otherwise("")).alias("g"))
    base = base.select("doc_id", (F.col("bytes") + 16).alias("size"), "text_crc32", "g", F.pmod(F.xxhash64("doc_id", "g"), F.lit(shards)).cast("int").alias("s0"), F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)).cast("int").alias("part"))
    base = materialize(base, "documents")
    total = base.count()
    quota = [total // shards + (k < total % shards) for k in range(shards)]

    counts = base.groupBy("g", "s0", "part").agg(F.count(F.lit(1)).alias("c"))
    linked = counts.groupBy("g").agg(F.sum("c").alias("all")).filter("all > 1").select("g")
    groups = materialize(counts.join(linked, "g"), "groups")
    settled = propagate(groups, quota, rounds)
    state = materialize(settled.select(F.concat_ws(":", "g", "s0", "part").alias("place"), "s"), "places")
    drop(groups, settled)

    n_buckets = max(16, -(-total // (shards * PER_BUCKET)))
    placed = (
        base.withColumn("place", F.concat_ws(":", "g", "s0", "part")).join(state, "place", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("s", "s0").alias("s"), F.when(F.col("s").isNull(), 1).otherwise(0).alias("free"))
        .withColumn("b", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_buckets)).cast("int"))
    )
    placed = materialize(placed, "placed")
    held = placed.groupBy("s", "free", "b").agg(F.count(F.lit(1)).alias("c"))
    # A shard's counts: 2 * n_buckets rows, one for every PER_BUCKET documents.
    before = F.sum("c").over(Window.partitionBy("s").orderBy("free", "b").rowsBetween(Window.unboundedPreceding, -1))
    held = materialize(held.select(F.concat_ws(":", "s", "free", "b").alias("at"), F.coalesce(before, F.lit(0)).alias("before"), "s", "c"), "offsets")
    size = {r.s: r.c for r in held.groupBy("s").agg(F.sum("c").alias("c")).collect()}

    number = F.row_number().over(Window.partitionBy("s", "free", "b").orderBy("doc_id", "text_crc32", "size")) - 1
    ranked = placed.withColumn("r", number).withColumn("at", F.concat_ws(":", "s", "free", "b")).join(held.select("at", "before"), "at").withColumn("r", F.col("r") + F.col("before"))

    # Documents beyond the quota are numbered over all shards and dealt to the places that are missing.
    surplus, missing, taken, given = {}, [], 0, 0
    for k in range(shards):
        surplus[k] = taken
        taken += max(0, size.get(k, 0) - quota[k])
        if (d := quota[k] - size.get(k, 0)) > 0:
            missing.append((given, k, size.get(k, 0)))
            given += d
    over = F.col("r") >= _lookup(dict(enumerate(quota)), F.col("s"), 0)
    index = F.col("r") - _lookup(dict(enumerate(quota)), F.col("s"), 0) + _lookup(surplus, F.col("s"), 0)
    shard, slot = F.col("s"), F.col("r").cast("long")
    if missing:
        target = F.array(*[F.struct(F.lit(a).cast("long").alias("from"), F.lit(k).alias("s"), F.lit(n).cast("long").alias("n")) for a, k, n in missing])
        pick = F.element_at(F.filter(target, lambda x: x["from"] <= F.col("i")), -1)
        ranked = ranked.withColumn("i", F.when(over, index.cast("long")).otherwise(F.lit(0).cast("long"))).withColumn("p", F.when(over, pick))
        shard, slot = F.coalesce(F.col("p.s"), F.col("s")), F.coalesce(F.col("p.n") + F.col("i") - F.col("p.from"), F.col("r")).cast("long")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_edges(placed: DataFrame) -> DataFrame:
    """One row: copies outside the fullest shard of their group, and all copies; placed(text_crc32, size, shard)."""
    held = placed.groupBy("text_crc32", "size", "shard").agg(F.count(F.lit(1)).alias("n"))
    per = held.groupBy("text_crc32", "size").agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter("n > 1")
    return per.agg(F.sum(F.col("n") - F.col("most")).alias("cut"), F.sum("n").alias("copies"))
