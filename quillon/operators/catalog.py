"""The catalog's relational operators: search pages, queues, leases, promotion, retention and lineage.

Tables are named by role: sessions, runs, jobs (with edges), events.  Locking is left to the store that holds them; what
is here selects and orders, so a claim is the rows that a worker would take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.shared import ensure_checkpoint_dir


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows with total, the number of rows before paging."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row of each key, by the order columns descending; the last of them is an id."""
    own = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r")


def claimable(jobs: DataFrame, edges: DataFrame, capacity: DataFrame, now: int) -> DataFrame:
    """Jobs in the order in which workers take them, as many of each class as it has room for.

    jobs: job, class, state, available_at, lease_until, attempts_left, priority, created; edges: job, needs; capacity: class, slots.
    A job is ready if it is pending and due, has attempts left, and all that it needs has succeeded.
    """
    ensure_checkpoint_dir(jobs.sparkSession)
    jobs = jobs.checkpoint()  # read four times here
    done = jobs.where("state = 'succeeded'").select(F.col("job").alias("needs"))
    waiting = edges.join(done, "needs", "left_anti").select("job").distinct()
    ready = jobs.where((F.col("state") == "pending") & (F.col("available_at") <= now) & (F.col("attempts_left") > 0)).join(waiting, "job", "left_anti")
    live = jobs.where((F.col("state") == "running") & (F.col("lease_until") > now)).groupBy("class").agg(F.count("*").alias("live"))
    room = capacity.join(live, "class", "left").select("class", (F.col("slots") - F.coalesce("live", F.lit(0))).alias("room")).checkpoint()
    # the greatest room as a number: each task then hands on that many of a class at most
    most = room.agg(F.max("room")).first()[0] or 0
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("priority"), "created", "job"))
    placed = ready.withColumn("place", place).where(F.col("place") <= int(most))
    return placed.join(room, "class").where("place <= room").select("job", "class", "priority", "place")


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their place, from 1, among those of their key, whatever the number of keys: rows are dealt in ranges of (keys, order), counted
    within a range, and a range adds what its key has in the ranges before.  Order columns ascend.  The dealt rows are kept in the checkpoint folder."""
    ensure_checkpoint_dir(rows.sparkSession)
    dealt = rows.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()).checkpoint()
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_p", *keys).orderBy(*order)))
    # a row for each key of a range
    counts = dealt.groupBy("_p", *keys).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return inside.join(counts.select("_p", *keys, before.alias("_before")), ["_p", *keys]).withColumn(name, F.col("_in") + F.col("_before")).drop("_p", "_in", "_before")


def retention(sessions: DataFrame, used: int, total: int, start: float = 0.70, target: float = 0.65) -> DataFrame:
    """Sessions to purge, oldest first, until what is left is at most the target; none below the start share.

    sessions: id, created, bytes, eligible.  A session goes while all before it leave more than the target; the running
    sum has one partial per partition of time, so that no task holds all sessions.
    """
    goal = int(total * target)
    rows = sessions.where("eligible and bytes > 0").select("id", "created", "bytes")
    if used / total < start:
        rows = rows.where("false")
    freed = running_sum(rows, ["created", "id"], "bytes", "freed")
    return freed.where(F.lit(used) - F.col("freed") + F.col("bytes") > goal).select("id", "created", "bytes", "freed", (F.lit(used) - F.col("freed")).alias("predicted"))


def running_sum(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """A running sum over all rows in order, without one task for all: sums within ranges, plus the sums of ranges before.

    The dealt rows are kept in the checkpoint folder: ranges come from a sample, and both uses must see the same ones.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    dealt = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).checkpoint()
    within = F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    inside = dealt.withColumn("_in", within)
    # one row a range
    before = dealt.groupBy("_p").agg(F.sum(value).alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn(name, F.col("_in") + F.col("_before")).drop("_p", "_in", "_before")


def lineage(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth) of all that roots reach over edges (node, parent), however deep, each node at its least depth.

    A round goes as far ahead of what is known as the hops are long; hops double in length as long as they don't
    outgrow the edges, so that chains take rounds as the logarithm of their length.  Ends when a round finds nothing new.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    hops = edges.select("node", "parent").where("node is not null and parent is not null").distinct().checkpoint()
    most = 2 * hops.count()
    reach = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct().checkpoint()
    stride = known = 1  # depths below known are complete
    rounds, growing = 0, True
    while True:
        ahead = reach.where(F.col("depth") >= known - stride).join(hops, "node").select("root", F.col("parent").alias("node"), (F.col("depth") + stride).alias("depth"))
        ahead = ahead.groupBy("root", "node").agg(F.min("depth").alias("depth")).join(reach.select("root", "node"), ["root", "node"], "left_anti").checkpoint()
        if ahead.isEmpty():
            return reach
        rounds += 1
        reach = reach.union(ahead)
        if rounds % 16 == 0:
            reach = reach.checkpoint()
        known += stride
        if growing and known >= 2 * stride:
            longer = hops.join(hops.select(F.col("node").alias("parent"), F.col("parent").alias("_p")), "parent").select("node", F.col("_p").alias("parent")).distinct().checkpoint()
            growing = longer.count() <= most
            hops, stride = (longer, 2 * stride) if growing else (hops, stride)


def topological(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, level (the longest way from a node without needs) and cyclic, for nodes (node) and edges (node, needs).

    Rounds take the nodes all of whose needs were taken before; what is left when a round takes nothing is on a cycle or
    behind one, and has no level.  An edge to a node that isn't there is an error.  Rounds are kept in the checkpoint folder.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    # a round's sides may be small, and rounds are many: none is sent through the driver to be broadcast
    without = lambda rows, gone, key: rows.join(gone.hint("merge"), key, "left_anti")
    edges = edges.select("node", "needs").distinct().checkpoint()
    missing = without(edges, nodes.select(F.col("node").alias("needs")), "needs").head(1)
    if missing:
        raise ValueError(f"node {missing[0]['node']} needs {missing[0]['needs']}, which isn't there")
    rest, open_edges, level = nodes.select("node").distinct().checkpoint(), edges, 0
    done = None
    while True:
        free = without(rest, open_edges.select("node").distinct(), "node").checkpoint()
        if free.isEmpty():
            break
        now = free.select("node", F.lit(level).alias("level"), F.lit(False).alias("cyclic"))
        done = now if done is None else done.union(now)
        if level % 16 == 15:
            done = done.checkpoint()
        rest = without(rest, free, "node").checkpoint()
        open_edges = without(open_edges, free.select(F.col("node").alias("needs")), "needs").checkpoint()
        level += 1
    left = rest.select("node", F.lit(None).cast("int").alias("level"), F.lit(True).alias("cyclic"))
    return left if done is None else done.union(left)


def outcome(events: DataFrame, keys: list[str], order: list[str], transitions: dict[str, str]) -> DataFrame:
    """Current state of each key: that of its last event, and how many events led there."""
    state = F.coalesce(*[F.when(F.col("event") == e, F.lit(s)) for e, s in transitions.items()])
    return events.withColumn("state", state).groupBy(*keys).agg(F.max_by("state", F.struct(*order)).alias("state"), F.count("*").alias("events"))


def state_intervals(events: DataFrame, keys: list[str], order: list[str], at: str, transitions: dict[str, str]) -> DataFrame:
    """keys, state, since and until of each stretch in which a key was in one state: [since, until), until null for the last.

    events: keys, event, the time ``at`` and what orders events of one time.  An event that leads to no state, or to the one that is there, changes nothing.
    """
    state = F.coalesce(*[F.when(F.col("event") == e, F.lit(s)) for e, s in transitions.items()])
    w = Window.partitionBy(*keys).orderBy(at, *order)
    rows = events.withColumn("state", state).where("state is not null").withColumn("_before", F.lag("state").over(w))
    rows = rows.where("_before is null or _before <> state")
    spans = rows.select(*keys, "state", F.col(at).alias("since"), F.lead(at).over(w).alias("until"))
    return spans.where("until is null or until > since")  # what was left at once was never seen


def as_of(spans: DataFrame, instants: list[int]) -> DataFrame:
    """The stretches of ``state_intervals`` that hold at each of the instants: instant, then the stretch's columns."""
    held = lambda t: (F.col("since") <= t) & (F.col("until").isNull() | (F.col("until") > t))
    found = F.explode(F.array_compact(F.array(*[F.when(held(t), F.lit(t).cast("long")) for t in instants]))).alias("instant")
    return spans.select(found, *spans.columns)


def stage_prefix(nodes: DataFrame, edges: DataFrame, tiers: list[str], tier: str, budget: int) -> DataFrame:
    """The stages that a tier and a budget allow: graph, node, place (from 1) and spent, the cost of all stages up to it.

    nodes: graph, node, tier and cost; edges: node, needs.  Stages come in topological order, by level and node, so each prefix has all that it needs, and shared needs
    are counted once.  The tier's prefix ends with its graph's last stage of that tier or a lower one; of it stay the stages that the
    budget pays for without a gap.
    """
    rank = F.coalesce(*[F.when(F.col("tier") == t, F.lit(i)) for i, t in enumerate(tiers)])
    levels = topological(nodes, edges)
    order = Window.partitionBy("graph").orderBy("level", "node")
    rows = nodes.join(levels.where("not cyclic").select("node", "level"), "node").withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("spent", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.when(rank <= tiers.index(tier), F.col("place"))).over(Window.partitionBy("graph"))
    fits = F.max(F.when(F.col("spent") > budget, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 0
    return rows.withColumns({"_last": last, "_fits": fits}).where("place <= _last and _fits").select("graph", "node", "place", "spent")


def reconcile(left: DataFrame, right: DataFrame, key: str, digest: str) -> DataFrame:
    """Differences of two inventories: only left, only right, or other digests."""
    both = left.select(key, F.col(digest).alias("_l")).join(right.select(key, F.col(digest).alias("_r")), key, "full")
    issue = F.when(F.col("_r").isNull(), "missing_right").when(F.col("_l").isNull(), "missing_left").when(F.col("_l") != F.col("_r"), "digest")
    return both.select(key, issue.alias("issue")).where("issue is not null")
