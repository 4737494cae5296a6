"""Banks of tracks: alias maps, lifted replays, seeded assignment, merging, alternate and residual lines, accounting and selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import acquisition, blocks, fitting, tracks
from quillon.plans.acquisition_queries import _MAP, PERIOD as FRAME, _vectors, best_basins, confirmed
from quillon.plans.association_queries import lift_classification
from quillon.plans.interval_queries import _days
from quillon.plans.registry import query
from quillon.plans.track_queries import _SLOPES, PERIOD, _points
from quillon.session import ship
from quillon.sources.shared import ensure_checkpoint_dir, kept
from quillon.sources.tables import OBSERVATIONS_SQL, observations, table

HOUR = 3_600_000_000
KEYS = ["path", "week"]


def alias_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the equivalent pairs that ``j09_overlap_alias_pairs`` lists, what says the same: of each two blocks the edges from components' least tracks, and one that
    contradicts these if there is any (wrong).  sure: a scope and day's only block, with its components whole and a row for each track in them."""
    tracks = kept(_days(ensure_checkpoint_dir(ship(spark)), sf_dir).selectExpr("path % 15 as scope", "day", "track", "a", "b", "fa", "fb"))
    period = int(PERIOD)

    def work(one, other):
        nodes, at = np.unique(np.concatenate([one["track"], other["track"]]), return_index=True)
        ends = {c: np.concatenate([one[c], other[c]])[at] for c in ("a", "b", "fa", "fb")}

        def links(i, j):
            (xa, xb, xfa, xfb), (ya, yb, yfa, yfb) = (ends[c][i][:, None] for c in ends), (ends[c][j] for c in ends)
            over = (nodes[i][:, None] != nodes[j]) & (xa < yb) & (ya < xb)
            u, v = np.maximum(xa, ya), np.minimum(xb, yb)

            def d(k):
                t = u + k * (v - u) / 15.0
                return (xfa + (xfb - xfa) * (t - xa) / (xb - xa)) - (yfa + (yfb - yfa) * (t - ya) / (yb - ya))

            multiple = np.rint((d(7) + d(8)) / 2 / period)
            worst = np.maximum(np.abs(d(0) - multiple * period), np.abs(d(15) - multiple * period))
            return over & (worst <= 2500), -multiple.astype(np.int64)

        root, potential, (a, b, delta) = fitting.forest(len(nodes), links)
        own = np.flatnonzero(np.bincount(root, minlength=len(nodes))[root] > 1)
        sure = int(one["_nx"][0]) == 1
        wrong = np.isin(root[own], root[a]) if sure else np.zeros(len(own), bool)
        if sure:
            a, b, delta = a[:0], b[:0], delta[:0]
        n = len(own) + len(a)
        return nodes[np.concatenate([root[own], a])], nodes[np.concatenate([own, b])], np.concatenate([potential[own], delta]), np.concatenate([wrong, a == a]).astype(np.int32), np.full(n, sure, np.int32)

    return blocks.each(tracks, tracks, ["scope", "day"], ("track", "track"), "a long, b long, delta long, wrong int, sure int", work, blocks.WHOLE, once=True)


@query("k19_alias_map")
def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks that are one but for whole multiples of the period: their component's least track, the multiple to it, and whether the component agrees.
    In a component that doesn't, the multiple is that of one way to the least track."""
    found = kept(alias_edges(spark, sf_dir))
    whole = found.where("sure = 1").selectExpr("b as node", "a as root", "delta as potential", "wrong = 1 as contradictory")
    parts = found.where("sure = 0 and a <> b")
    return whole if parts.isEmpty() else whole.unionByName(fitting.potentials(parts))


@query("k20_dealiased_bank")
def dealiased_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each component of the alias map through its tracks' ends, brought to the component's own multiple; contradictory ones have none."""
    held = alias_map(spark, sf_dir).where("not contradictory").select(F.col("node").alias("track"), "root", "potential")
    ends = _days(spark, sf_dir).join(held, "track").selectExpr("root", "track", "explode(array(struct(a as t, fa as f), struct(b as t, fb as f))) as x", "potential")
    rows = ends.select("root", "track", ((F.col("x.t") - 1_704_067_200_000_000) / float(HOUR)).alias("t"), (F.col("x.f") - F.col("potential") * PERIOD).alias("v"))
    lines = rows.groupBy("root").agg(F.count_distinct("track").alias("tracks"), F.regr_slope("v", "t").alias("slope"), F.regr_intercept("v", "t").alias("intercept"), F.sqrt(F.regr_syy("v", "t") / F.count("*") * (1 - F.coalesce(F.regr_r2("v", "t"), F.lit(0.0)))).alias("rms"))
    return lines.select("root", "tracks", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("rms", 3).alias("rms"))


@query("k22_final_selection")
def final_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each component the track whose path has the best tier (then the longest, then the least number) stands for it; paths without
    a tier come last, so every component has one."""
    order = F.expr("case tier when 'improved' then 0 when 'stable' then 1 when 'geometry_only' then 2 when 'rejected' then 3 else 4 end")
    rows = alias_map(spark, sf_dir).select(F.col("node").alias("track"), "root").join(_days(spark, sf_dir).select("track", "path", (F.col("b") - F.col("a")).alias("span")), "track").join(lift_classification(spark, sf_dir).select("path", "tier"), "path", "left")
    best = rows.groupBy("root").agg(F.min(F.struct(order.alias("o"), (-F.col("span")).alias("s"), "track", "tier")).alias("x"), F.count("*").alias("members"))
    return best.select("root", F.col("x.track").alias("track"), F.col("x.tier").alias("tier"), "members")


@query("k21_lift_replay", f"""WITH {_MAP}, rep AS (SELECT vec_id, lift, k, sum(x * cos(a) - y * sin(a)) AS re, sum(x * sin(a) + y * cos(a)) AS im, sum(et) AS et, sum(ex) AS ex FROM (SELECT w.*, lift, -2 * pi() * (c.b / 64.0::DOUBLE + lift / 8.0::DOUBLE) * n AS a FROM whl w JOIN cel c ON c.vec_id = w.vec_id AND c.e = w.e, range(-2, 3) AS r(lift)) GROUP BY 1, 2, 3),
s AS (SELECT vec_id, lift, avg(sqrt((re * re + im * im) / (et * ex))) AS s FROM rep GROUP BY 1, 2), z AS (SELECT vec_id, s AS zero FROM s WHERE lift = 0)
SELECT vec_id, lift::INT AS lift, round(s, 6) AS score, round(s - zero, 6) + 0.0 AS delta FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, abs(lift), lift) AS r FROM s) JOIN z USING (vec_id) WHERE r = 1""")
def lift_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector run again at the best cell for each lift (a whole multiple of an eighth of a cycle): the best lift, and what it gains over none."""
    lifts = np.arange(-2, 3)

    def work(frames, x, t, scores):
        e, b = acquisition.best_cell(scores)
        s = frames.scores(x[None], t[None], (b - acquisition.BINS) * acquisition.WIDTH + lifts / 8, frames.of(e))[0].mean(axis=0)
        k = min(range(len(lifts)), key=lambda i: (-round(s[i], 9), abs(lifts[i]), lifts[i]))
        return [(int(lifts[k]), float(s[k]), float(s[k] - s[2]))]

    found = acquisition.each(_vectors(spark, sf_dir), "vec_id long, lift int, score double, delta double", work, FRAME)
    return found.select("vec_id", "lift", F.round("score", 6).alias("score"), (F.round("delta", 6) + 0.0).alias("delta"))


@query("k18_seeded_assignment")
def seeded_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines seeded from votes, each taking one candidate of every probe (an hour) within the gate, refitted until no choice changes."""
    points = _points(ensure_checkpoint_dir(ship(spark)), sf_dir).withColumn("probe", F.floor("t"))
    seeds = tracks.voted_lines(points, KEYS, _SLOPES, PERIOD, 16, 2)
    lines, own = tracks.seeded(points, seeds, KEYS, PERIOD, 400.0)
    counts = own.groupBy(*KEYS, "track").agg(F.count("*").alias("probes"), F.min("id").alias("first_id"))
    return lines.join(counts, [*KEYS, "track"]).where("probes > 2").select(*KEYS, "track", "probes", "first_id", F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"))


_PTS = f"{OBSERVATIONS_SQL}, pts AS (SELECT path, (t_us - 1704067200000000) // 604800000000 AS week, id, (t_us - 1704067200000000) / 3.6e9 AS t, cents::DOUBLE AS v, (k + 1)::DOUBLE AS w FROM obs)"
_CELLS = "SELECT path, week, s::INT AS slope_index, floor((v - (s * 10.0::DOUBLE - 30) * t - 2273 * floor((v - (s * 10.0::DOUBLE - 30) * t) / 2273)) * 16 / 2273)::INT AS bin, sum(w) AS votes, count(*) AS support FROM {0}, range(7) AS r(s) GROUP BY 1, 2, 3, 4"


@query("k35_line_banks", f"""WITH {_PTS}, c AS ({_CELLS.format('pts')}), a AS (SELECT *, row_number() OVER (PARTITION BY path, week ORDER BY votes DESC, support DESC, slope_index, bin) AS r FROM c), b AS (SELECT path, week, slope_index AS bs, bin AS bb FROM a WHERE r = 1),
alt AS (SELECT c.*, row_number() OVER (PARTITION BY c.path, c.week ORDER BY votes DESC, support DESC, slope_index, bin) AS r FROM c JOIN b ON b.path = c.path AND b.week = c.week WHERE abs(slope_index - bs) >= 2),
res AS (SELECT p.* FROM pts p JOIN b ON b.path = p.path AND b.week = p.week WHERE abs(v - (bs * 10.0::DOUBLE - 30) * t - (bb + 0.5) * 2273 / 16 + 1136.5 - 2273 * floor((v - (bs * 10.0::DOUBLE - 30) * t - (bb + 0.5) * 2273 / 16 + 1136.5) / 2273) - 1136.5) > 300),
rc AS (SELECT *, row_number() OVER (PARTITION BY path, week ORDER BY votes DESC, support DESC, slope_index, bin) AS r FROM ({_CELLS.format('res')}))
SELECT path, week, 'ranked' AS bank, r::INT AS rank, slope_index, bin, votes, support FROM a WHERE r <= 3 UNION ALL SELECT path, week, 'alternate', 1, slope_index, bin, votes, support FROM alt WHERE r = 1 UNION ALL SELECT path, week, 'residual', 1, slope_index, bin, votes, support FROM rc WHERE r = 1""")
def line_banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three banks of lines by path and week: the first three by votes; the best whose slope is another; and the best through what the first line leaves."""
    return fitting.hough_banks(_points(ship(spark), sf_dir), KEYS, "t", "v", "w", _SLOPES, PERIOD, 16, 3, 2, 300.0)


@query("k34_track_accounting", f"""WITH {OBSERVATIONS_SQL}, r AS (SELECT path, (t_us - 1704067200000000) // 604800000000 AS week, cents >= 5000 AS baseline, cents - 40 * (k - 50) >= 5000 AS replay FROM obs),
t AS (SELECT path, week, count_if(baseline AND replay) AS kept, count_if(baseline AND NOT replay) AS lost, count_if(NOT baseline AND replay) AS gained, count_if(NOT baseline AND NOT replay) AS absent FROM r GROUP BY 1, 2)
SELECT path::BIGINT AS path, week, kept::BIGINT AS kept, lost::BIGINT AS lost, gained::BIGINT AS gained, absent::BIGINT AS absent, round((gained - lost)::DOUBLE / (kept + lost + gained + absent), 6) + 0.0 AS net FROM t
UNION ALL SELECT NULL, NULL, sum(kept)::BIGINT, sum(lost)::BIGINT, sum(gained)::BIGINT, sum(absent)::BIGINT, round((sum(gained) - sum(lost))::DOUBLE / (sum(kept) + sum(lost) + sum(gained) + sum(absent)), 6) + 0.0 FROM t""")
def track_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a replay keeps, loses and gains of each track's decisions, and of all (path and week null)."""
    from quillon.operators import aggregates

    rows = observations(spark, sf_dir).selectExpr("path", "(t_us - 1704067200000000) div 604800000000 as week", "cents >= 5000 as baseline", "cents - 40 * (k - 50) >= 5000 as replay")
    each = aggregates.transitions(rows, KEYS, F.col("baseline"), F.col("replay"))
    names = ["kept", "lost", "gained", "absent"]
    whole = each.agg(*[F.sum(c).alias(c) for c in names]).selectExpr("cast(null as bigint) as path", "cast(null as bigint) as week", *names)
    net = F.round((F.col("gained") - F.col("lost")) / (F.col("kept") + F.col("lost") + F.col("gained") + F.col("absent")), 6) + 0.0
    return each.union(whole).withColumn("net", net)


@query("k14_merged_groups")
def merged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily tracks of a path merged to groups, the cheapest pairs first."""
    rows = _days(ensure_checkpoint_dir(spark), sf_dir).selectExpr("path", "track", "a", "b", "cast(fa as double) as fa", "cast(fb as double) as fb")
    return tracks.merged(rows, 36 * HOUR, 4000.0).select("path", "track", "members", "a", "b", F.round("fa", 3).alias("fa"), F.round("fb", 3).alias("fb"))


@query("k16_trajectory_bank")
def trajectory_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories of a label's best basins by method and degree: rows over the method's gate (three scaled deviations of its negative margins)
    fitted by a line and a parabola, the better by criterion marked."""
    rows = best_basins(spark, sf_dir)
    noise = rows.where("margin < 0").groupBy("method").agg(F.median(F.abs("margin")).alias("mad"))
    over = rows.join(noise, "method", "left").where("margin > 3 * 1.4826D * coalesce(mad, 0D)")
    points = over.join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id").selectExpr("label", "method", "cast(vec_id as double) / 100 as t", "frequency * 1000 as v")
    keys = ["label", "method"]
    line = points.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("v", "t").alias("slope"), (F.regr_syy("v", "t") * (1 - F.coalesce(F.regr_r2("v", "t"), F.lit(0.0))) / F.count("*")).alias("mse")).where("n > 3")
    bic = lambda mse, p: F.col("n") * F.log(F.greatest(mse, F.lit(1e-12))) + p * F.log(F.col("n").cast("double"))
    curve = fitting.quadratic_fit(points, keys, "t", "v").select(*keys, F.col("c2").alias("bend"), F.col("bic").alias("bic2"))
    both = line.join(curve, keys, "left").withColumn("bic1", bic(F.col("mse"), 2))
    return both.select(*keys, "n", F.round("slope", 4).alias("slope"), F.round("bend", 6).alias("bend"), F.round("bic1", 3).alias("bic1"), F.round("bic2", 3).alias("bic2"), F.when(F.col("bic2") < F.col("bic1"), 2).otherwise(1).alias("degree"))


@query("k32_scan_chain")
def scan_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the scan on: confirmed hits, the label's line through their frequencies, and what lifts gain at them in replay."""
    basins = best_basins(spark, sf_dir)
    hits = confirmed(spark, sf_dir, basins).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    best = basins.where("method = 'glrt'").select("vec_id", "frequency", "margin")
    rows = hits.join(best, "vec_id").join(lift_replay(spark, sf_dir).select("vec_id", "lift", "delta"), "vec_id")
    found = rows.groupBy("label").agg(F.count("*").alias("hits"), F.regr_slope("frequency", F.col("vec_id").cast("double")).alias("slope"), F.avg("margin").alias("margin"), F.avg("delta").alias("gain"), F.count_if(F.col("lift") != 0).alias("lifted"))
    return found.select("label", "hits", F.round("slope", 9).alias("slope"), F.round("margin", 5).alias("margin"), F.round("gain", 5).alias("gain"), "lifted")


@query("k08_residual_partition")
def residual_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines proposed by votes, each through what the ones before left, and put together by the least description length."""
    points = _points(ensure_checkpoint_dir(ship(spark)), sf_dir)
    lines = kept(tracks.peeled(points, KEYS, _SLOPES, PERIOD, 16, 300.0, 4, 4))
    found = tracks.best_partition(points, lines, KEYS, PERIOD, 300.0, 72.0, 4)
    return found.select(*KEYS, "blocks", "n", F.round("mdl", 4).alias("mdl"), F.round("deviations", 3).alias("deviations"))
