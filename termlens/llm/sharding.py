"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under capacity quotas.

Documents with equal texts are linked. Every document starts in the shard of a hash. In a round each group of linked
documents counts its members by shard (combined map-side), its members outside the fullest shard that it does not fill alone
want to move there, and a quota per pair of shards decides: demands are summed in at most shards^2 x SIZE_CLASSES x PRIORITIES
buckets, demands that go around (a to b and b to a, or a longer cycle) are swapped whatever the load, the others use free
room; whole buckets are let in, small groups first, and the bucket that overflows is let in by a share of its rows. So a group
larger than a shard fills one shard, then the next. Every move joins the larger part of its group, so each round that
moves a row lowers the cut edges; rounds end when two in a row move nothing (ties and draws differ by round). A last step makes the counts
exact: documents without links (and what exceeds a shard's target) are dealt by a distributed rank into the room left,
so the counts of all shards differ by at most one (law `rows`).

Edge cases: null text = empty text for links and checksum, its size is 1; an empty table gives no rows; fewer rows than shards
leave shards empty; repeated rows are linked and placed each; ties between shards are broken by a hash of the group; very long
texts count with their bytes and are never copied; only doc_id and text are read, so other columns of any name do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.llm.common import ranked, text_or_empty, written

SHARDS = 8
STILL = 2                    # rounds in a row without a move that end the propagation
PRIORITIES = 32
SIZE_CLASSES = 64
GROUP = ["g1", "g2"]


def _cycle(left: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """Edges of a shortest cycle of unmet demands, or none: two-cycles come first."""
    after: dict[int, list[int]] = {}
    for a, b in left:
        after.setdefault(a, []).append(b)
    best: list[int] = []
    for a in after:
        back, todo = {a: a}, [a]
        for x in todo:
            if a in after.get(x, ()):
                path = [x]
                while path[-1] != a:
                    path.append(back[path[-1]])
                if not best or len(path) < len(best):
                    best = path[::-1]
                break
            for y in after.get(x, ()):
                if y not in back:
                    back[y] = x
                    todo.append(y)
        if len(best) == 2:
            break
    return list(zip(best, best[1:] + best[:1]))


def _quotas(need: dict[tuple[int, int], int], room: dict[int, int]) -> dict[tuple[int, int], int]:
    """(from, to) -> rows that may move: cycles of demands swap, what is left uses free room."""
    left = {k: v for k, v in need.items() if v > 0}
    out: dict[tuple[int, int], int] = {}
    while edges := _cycle(left):
        least = min(left[e] for e in edges)
        for e in edges:
            out[e] = out.get(e, 0) + least
            left[e] -= least
            if not left[e]:
                del left[e]
    free = dict(room)
    while left:                                       # without cycles: the last shards first, as those before them then have room
        e = next(((a, b) for a, b in sorted(left) if not any(x == b for x, _ in left)))
        n = min(left.pop(e), max(0, free.get(e[1], 0)))
        out[e] = out.get(e, 0) + n
        free[e[0]] = free.get(e[0], 0) + n
        free[e[1]] = free.get(e[1], 0) - n
    return out


def _quota_table(demand: list, room: dict[int, int]) -> dict[tuple[int, int, int, int], float]:
    """(from, target, size class, priority) -> share let in, small groups first."""
    need: dict[tuple[int, int], int] = {}
    for r in demand:
        need[r["shard"], r["want"]] = need.get((r["shard"], r["want"]), 0) + r["need"]
    left = _quotas(need, room)
    out = {}
    for r in sorted(demand, key=lambda r: (r["cls"], r["pri"], r["shard"], r["want"])):
        pair, n = (r["shard"], r["want"]), r["need"]
        have = left.get(pair, 0)
        if have > 0:
            out[(*pair, r["cls"], r["pri"])] = min(1.0, have / n)
            left[pair] = have - min(n, have)
    return out


def _by_shard(values: dict[int, int], shard: Column) -> Column:
    out = F.lit(0)
    for k, v in values.items():
        out = F.when(shard == k, F.lit(int(v))).otherwise(out)
    return out


def propagate(linked: DataFrame, shards: int, capacity: int) -> DataFrame:
    """Move the rows of `linked` (uid, g1, g2, shard) between shards; at most about `capacity` linked rows a shard."""
    spark = linked.sparkSession
    turn = still = 0
    while still < STILL:
        turn += 1
        load = {r["shard"]: r["count"] for r in linked.groupBy("shard").count().collect()}      # one row a shard
        room = {b: capacity - load.get(b, 0) for b in range(shards)}
        votes = linked.groupBy(*GROUP, "shard").agg(F.count(F.lit(1)).alias("n"))
        # the group's fullest shard that it does not fill alone; members in those it fills stay there
        open_ = F.col("n") < capacity
        pref = votes.groupBy(*GROUP).agg(
            F.max_by(F.col("shard"), F.when(open_, F.struct("n", F.xxhash64(*GROUP, "shard", F.lit(turn))))).alias("want"),
            F.sum("n").alias("size"), F.collect_list(F.when(open_, F.struct("shard", "n"))).alias("votes"))     # at most one a shard
        pref = written(pref.where(F.size("votes") > 1).select(
            *[F.col(g).alias(f"_{g}") for g in GROUP], "want", "votes",
            F.least(F.floor(F.log2("size")), F.lit(SIZE_CLASSES - 1)).cast("int").alias("cls"),
            F.pmod(F.xxhash64(*GROUP), F.lit(PRIORITIES)).cast("int").alias("pri")), "wants")
        demand = pref.select("want", "cls", "pri", F.inline("votes")).where("shard <> want").groupBy(
            "shard", "want", "cls", "pri").agg(F.sum("n").alias("need")).collect()               # bounded by the buckets
        shares = _quota_table(demand, room)
        if not demand:
            break
        if not shares:
            still += 1
            continue
        gate = spark.createDataFrame([(*k, v) for k, v in shares.items()], "q_from int, q_want int, q_cls int, q_pri int, share double")
        moves = pref.select("_g1", "_g2", "want", "cls", "pri", F.inline("votes")).where("shard <> want").join(
            F.broadcast(gate), (F.col("shard") == F.col("q_from")) & (F.col("want") == F.col("q_want")) & (F.col("cls") == F.col("q_cls"))
            & (F.col("pri") == F.col("q_pri"))).select("_g1", "_g2", F.col("shard").alias("_from"), "want", "share")
        draw = F.pmod(F.xxhash64("uid", F.lit(13), F.lit(turn)), F.lit(1_000_000)) / 1e6
        moved = linked.join(moves, (F.col("g1") == F.col("_g1")) & (F.col("g2") == F.col("_g2")) & (F.col("shard") == F.col("_from")), "left")
        go = F.coalesce(draw < F.col("share"), F.lit(False))
        linked = written(moved.select("uid", *GROUP, F.when(go, F.col("want")).otherwise(F.col("shard")).alias("shard"), go.alias("_went")), "labels")
        still = still + 1 if linked.where("_went").isEmpty() else 0
        linked = linked.drop("_went")
    return linked


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: counts of the shards at most one apart."""
    t = text_or_empty()
    rows = docs.select("doc_id", F.when(F.col("text").isNull(), F.lit(1)).otherwise(F.octet_length(t) + 1).cast("long").alias("size"),
                       F.crc32(t).alias("text_crc32"), F.xxhash64(t).alias("g1"), F.hash(t, F.lit(17)).alias("g2"))
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    n = rows.count()
    groups = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        F.col("g1").alias("_g1"), F.col("g2").alias("_g2"))
    same = (F.col("g1") == F.col("_g1")) & (F.col("g2") == F.col("_g2"))
    start = F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")
    linked = written(rows.select("uid", *GROUP).join(groups, same, "left_semi").withColumn("shard", start), "labels")
    target = {b: n // shards + (b < n % shards) for b in range(shards)}
    linked = propagate(linked, shards, n // shards)
    load = {r["shard"]: r["count"] for r in linked.groupBy("shard").count().collect()}
    over = [b for b in range(shards) if load.get(b, 0) > target[b]]
    kept = linked.select("uid", "shard")
    if over:                                   # quotas let in shares by hash: give back what exceeds the target
        spill = ranked(linked.where(F.col("shard").isin(over)).select("uid", "shard"), ["shard"], ["uid"], ["uid"], n, "_rank")
        kept = kept.where(~F.col("shard").isin(over)).unionByName(
            spill.where(F.col("_rank") < _by_shard(target, F.col("shard"))).select("uid", "shard"))
    kept = written(kept, "kept")
    pool = written(rows.select("uid").join(kept, "uid", "left_anti").withColumn("_one", F.lit(0)), "pool")
    dealt = ranked(pool, ["_one"], ["uid"], ["uid"], n, "_rank")
    ends, edge = [], 0
    for b in range(shards):
        edge += target[b] - min(load.get(b, 0), target[b])
        ends.append(edge)
    place = F.lit(shards - 1)
    for b in reversed(range(shards - 1)):
        place = F.when(F.col("_rank") < ends[b], F.lit(b)).otherwise(place)
    placed = kept.unionByName(dealt.select("uid", place.cast("int").alias("shard")))
    placed = written(placed.withColumnRenamed("uid", "_uid"), "placed")
    out = written(rows.join(placed, F.col("uid") == F.col("_uid")).select("doc_id", "size", "text_crc32", "shard", "uid"), "sharded")
    return ranked(out, ["shard"], ["uid"], ["uid"], n, "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
