"""Queries of inference: ranks, calibration, baselines, placebos, bootstraps, folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import features as fx
from ..operators import linear
from ..operators.draws import smallest_draws
from ..operators.labels import fixed_horizon
from ..operators.ranks import with_counts_before
from ..operators.selection import exact_quantiles
from ..sources.readers import staged
from .registry import query
from .views import VIEW_SQL

R6 = lambda c, name: F.round(c, 6).alias(name)
R8 = lambda c, name: F.round(c, 8).alias(name)
R9 = lambda c, name: F.round(c, 9).alias(name)

PRED = "pd AS (SELECT o.instrument_id, o.sidx, o.session, o.excess_pct, o.net_pct, b.close AS f1, b.volume AS f2, b.high - b.low AS f3, (o.sidx * 37 + o.instrument_id * 11) % 101 / 100.0::DOUBLE AS score FROM outcomes o LEFT JOIN bars_w b USING (instrument_id, session) WHERE o.status = 'RESOLVED')"


def predictions(v):
    """Resolved outcomes with three features of the decision session and an arithmetic score."""
    b = v.bars_w.select("instrument_id", "session", F.col("close").alias("f1"), F.col("volume").alias("f2"), (F.col("high") - F.col("low")).alias("f3"))
    o = v.outcomes.where("status = 'RESOLVED'").join(b, ["instrument_id", "session"], "left")
    return o.select("instrument_id", "sidx", "session", "excess_pct", "net_pct", "f1", "f2", "f3", ((F.col("sidx") * 37 + F.col("instrument_id") * 11) % 101 / 100.0).alias("score"))


def average_rank(x, *by):
    """Ranks from 1, ties sharing their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2.0


def avg_rank_sql(x, by):
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)"


IC = f"{PRED}, ic0 AS (SELECT sidx, {avg_rank_sql('score', 'sidx')} AS a, {avg_rank_sql('excess_pct', 'sidx')} AS b FROM pd), ic AS (SELECT sidx, count(*) AS n, corr(a, b) AS ic FROM ic0 GROUP BY sidx HAVING count(*) >= 3 AND stddev_samp(a) > 0 AND stddev_samp(b) > 0)"


@query("ag_rank_ic", f"WITH {IC} SELECT count(*) AS dates, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS std_ic FROM ic")
def ag_rank_ic(v):
    r = predictions(v).select("sidx", average_rank(F.col("score"), "sidx").alias("a"), average_rank(F.col("excess_pct"), "sidx").alias("b"))
    ic = r.groupBy("sidx").agg(F.count("*").alias("n"), F.stddev_samp("a").alias("sa"), F.stddev_samp("b").alias("sb"), F.corr("a", "b").alias("ic")).where("n >= 3 and sa > 0 and sb > 0")
    return ic.agg(F.count("*").alias("dates"), R6(F.avg("ic"), "mean_ic"), R6(F.stddev_samp("ic"), "std_ic"))


BUCKET = f"""{PRED}, q AS (SELECT quantile_cont(score, 0.2) AS a, quantile_cont(score, 0.4) AS b, quantile_cont(score, 0.6) AS c, quantile_cont(score, 0.8) AS d FROM pd),
bk AS (SELECT CASE WHEN score <= a THEN 1 WHEN score <= b THEN 2 WHEN score <= c THEN 3 WHEN score <= d THEN 4 ELSE 5 END AS bucket, count(*) AS n, avg(excess_pct) AS e, avg(net_pct) AS m FROM pd, q GROUP BY 1)"""


@query("ag_quintile_buckets", f"WITH {BUCKET} SELECT bucket, n, round(e, 8) AS mean_excess, round(m, 8) AS mean_net, e > coalesce(lag(e) OVER (ORDER BY bucket), -1e300) AS above_previous FROM bk")
def ag_quintile_buckets(v):
    p = staged(predictions(v))
    q = exact_quantiles(p, "score", [0.2, 0.4, 0.6, 0.8])
    b = F.when(F.expr("score <= q_0"), 1).when(F.expr("score <= q_1"), 2).when(F.expr("score <= q_2"), 3).when(F.expr("score <= q_3"), 4).otherwise(5)
    g = p.crossJoin(F.broadcast(q)).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.avg("excess_pct").alias("e"), F.avg("net_pct").alias("m"))
    return g.select("bucket", "n", R8(F.col("e"), "mean_excess"), R8(F.col("m"), "mean_net"), (F.col("e") > F.coalesce(F.lag("e").over(Window.orderBy("bucket")), F.lit(-1e300))).alias("above_previous"))


LONG = f"{PRED}, lf AS (SELECT instrument_id, sidx, excess_pct, f AS feature, x FROM pd CROSS JOIN LATERAL (VALUES ('f1', f1), ('f2', f2), ('f3', f3)) t(f, x))"


def long_features(v):
    return predictions(v).unpivot(["instrument_id", "sidx", "excess_pct"], ["f1", "f2", "f3"], "feature", "x")


@query("ag_component_evidence", f"WITH {LONG}, r AS (SELECT feature, excess_pct, {avg_rank_sql('x', 'feature')} AS a, {avg_rank_sql('excess_pct', 'feature')} AS b FROM lf WHERE x IS NOT NULL) SELECT feature, count(*) AS n, (SELECT count(*) FROM lf WHERE lf.feature = r.feature AND x IS NULL) AS missing, round(avg(excess_pct), 6) AS mean_outcome, round(corr(a, b), 6) AS rank_ic FROM r GROUP BY feature")
def ag_component_evidence(v):
    lf = staged(long_features(v))
    r = linear.with_average_rank(linear.with_average_rank(lf.where("x is not null"), ["feature"], "x", "a"), ["feature"], "excess_pct", "b")
    seen = r.groupBy("feature").agg(F.count("*").alias("n"), R6(F.avg("excess_pct"), "mean_outcome"), R6(F.corr("a", "b"), "rank_ic"))
    return seen.join(lf.groupBy("feature").agg(F.count_if(F.col("x").isNull()).alias("missing")), "feature")


WIDE = f"{PRED}, wd AS (SELECT p.*, b.open AS f4, b.turnover AS f5, p.f1 * 2 + 1 AS f6 FROM pd p LEFT JOIN bars_w b USING (instrument_id, session))"
FEATURES = ["f1", "f2", "f3", "f4", "f5", "f6"]
WIDE_LONG = f"{WIDE}, wl AS (SELECT instrument_id, sidx, f, x FROM wd CROSS JOIN LATERAL (VALUES {', '.join(f"('{f}', {f})" for f in FEATURES)}) t(f, x) WHERE x IS NOT NULL)"


def wide_features(v):
    """Six features of the decision session; the last is a line of the first."""
    b = v.bars_w.select("instrument_id", "session", F.col("open").alias("f4"), F.col("turnover").alias("f5"))
    return staged(predictions(v).join(b, ["instrument_id", "session"], "left").withColumn("f6", F.col("f1") * 2 + 1))


@query("ag_corr_matrix", f"WITH {WIDE_LONG}, r AS (SELECT *, {avg_rank_sql('x', 'f')} AS k FROM wl) SELECT a.f AS a, b.f AS b, round(corr(a.x, b.x), 6) AS r, round(corr(a.k, b.k), 6) AS rho FROM r a JOIN r b ON a.instrument_id = b.instrument_id AND a.sidx = b.sidx AND a.f < b.f GROUP BY 1, 2")
def ag_corr_matrix(v):
    m = linear.correlation_matrix(wide_features(v), ["instrument_id", "sidx"], FEATURES)
    return m.select("a", "b", R6(F.col("r"), "r"), R6(F.col("rho"), "rho"))


SPLIT = "sidx <= 200"


@query("ag_percentile_calibration", f"WITH {PRED}, tr AS (SELECT f1 FROM pd WHERE {SPLIT} AND f1 IS NOT NULL), n AS (SELECT count(*) AS n FROM tr) SELECT p.instrument_id, p.sidx, round(100.0 * ((SELECT count(*) FROM tr WHERE tr.f1 < p.f1) + 0.5 * (SELECT count(*) FROM tr WHERE tr.f1 = p.f1)) / n.n, 6) AS score FROM pd p, n WHERE NOT ({SPLIT}) AND p.f1 IS NOT NULL")
def ag_percentile_calibration(v):
    """Scores against the training ECDF: training counts per value and asked values are merged and summed in order of
    value, by range partitions, so no row is compared with all training rows and no task holds all values."""
    p = predictions(v).where("f1 is not null")
    train = p.where(SPLIT).groupBy("f1").agg(F.count("*").alias("c"))
    asked = p.where(f"not ({SPLIT})").select("f1").distinct().join(train, "f1", "full_outer").na.fill(0, ["c"])
    ecdf = with_counts_before(asked, ["f1"], F.col("c"))
    q = p.where(f"not ({SPLIT})").join(ecdf, "f1")
    return q.select("instrument_id", "sidx", R6((F.col("before") + F.col("c") * 0.5) * 100.0 / F.col("total"), "score"))


@query("ag_winsor_zscore", f"WITH {PRED}, b AS (SELECT quantile_cont(f1, 0.05) AS lo, quantile_cont(f1, 0.95) AS hi FROM pd WHERE {SPLIT}), m AS (SELECT lo, hi, avg(least(greatest(f1, lo), hi)) AS mu, stddev_pop(least(greatest(f1, lo), hi)) AS sd FROM pd, b WHERE {SPLIT} AND f1 IS NOT NULL GROUP BY lo, hi) SELECT instrument_id, sidx, round((least(greatest(f1, lo), hi) - mu) / sd, 6) AS z FROM pd, m WHERE f1 IS NOT NULL")
def ag_winsor_zscore(v):
    p = staged(predictions(v).where("f1 is not null"))
    b = exact_quantiles(p.where(SPLIT), "f1", [0.05, 0.95]).select(F.col("q_0").alias("lo"), F.col("q_1").alias("hi"))
    clip = F.least(F.greatest("f1", "lo"), "hi")
    m = p.where(SPLIT).crossJoin(F.broadcast(b)).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.avg(clip).alias("mu"), F.stddev_pop(clip).alias("sd"))
    return p.crossJoin(F.broadcast(m)).select("instrument_id", "sidx", R6((clip - F.col("mu")) / F.col("sd"), "z"))


NB = 20


NBR = f"{PRED}, g AS (SELECT DISTINCT score FROM pd WHERE NOT ({SPLIT})), k AS (SELECT g.score, t.net_pct, row_number() OVER (PARTITION BY g.score ORDER BY abs(t.score - g.score), t.score, t.instrument_id, t.sidx) AS r FROM g, (SELECT * FROM pd WHERE {SPLIT}) t)"


@query("ag_neighbor_calibration", f"WITH {NBR} SELECT score, round(avg(net_pct), 8) AS mean, round(stddev_samp(net_pct) / sqrt({NB}), 6) AS se, round(avg(net_pct) - 1.96::DOUBLE * stddev_samp(net_pct) / sqrt({NB}), 6) AS lo95, round(avg(net_pct) + 1.96::DOUBLE * stddev_samp(net_pct) / sqrt({NB}), 6) AS hi95, round(100.0 * avg((net_pct > 0)::INT), 6) AS positive_pct FROM k WHERE r <= {NB} GROUP BY score")
def ag_neighbor_calibration(v):
    """The k nearest training rows of each asked score, and their mean's 95 % band. Training and asked values are ranked
    together by range partitions; an asked value then meets the k training rows on either side by their ranks."""
    p = predictions(v)
    train = p.where(SPLIT).select("score", "instrument_id", "sidx", "net_pct")
    asked = p.where(f"not ({SPLIT})").select("score").distinct()
    # ranks of training rows from below, and from above with the same order among equal scores
    up = with_counts_before(train, ["score", "instrument_id", "sidx"], F.lit(1)).withColumn("up", F.col("before")).drop("before", "total")
    size = F.count("*").over(Window.partitionBy("score"))
    place = F.row_number().over(Window.partitionBy("score").orderBy("instrument_id", "sidx")) - 1
    both = up.withColumns({"size": size, "place": place})
    # the rows of a lower score are taken in ascending order too: mirror a row's place among its equals
    both = both.withColumn("down", F.col("up") - F.col("place") + F.col("size") - 1 - F.col("place"))
    values = train.groupBy("score").agg(F.count("*").alias("c")).join(asked.withColumn("asked", F.lit(True)), "score", "full_outer").na.fill(0, ["c"])
    at = with_counts_before(values, ["score"], F.col("c")).where("asked").select("score", F.col("before").alias("at"))
    at = at.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(NB - 1))))
    above = at.withColumn("up", F.col("at") + F.col("step")).join(both.select("up", F.col("score").alias("ts"), "instrument_id", "sidx", "net_pct"), "up").drop("up")
    below = at.withColumn("down", F.col("at") - 1 - F.col("step")).join(both.select("down", F.col("score").alias("ts"), "instrument_id", "sidx", "net_pct"), "down").drop("down")
    w = Window.partitionBy("score").orderBy(F.abs(F.col("ts") - F.col("score")), "ts", "instrument_id", "sidx")
    k = above.unionByName(below).withColumn("r", F.row_number().over(w)).where(F.col("r") <= NB)
    mean, se = F.avg("net_pct"), F.stddev_samp("net_pct") / F.sqrt(F.lit(NB))
    return k.groupBy("score").agg(R8(mean, "mean"), R6(se, "se"), R6(mean - F.lit(1.96) * se, "lo95"), R6(mean + F.lit(1.96) * se, "hi95"), R6(F.avg((F.col("net_pct") > 0).cast("double")) * 100, "positive_pct"))


#: Columns that correlate with an earlier one by 0.999999 are left out; the rest is solved by elimination on z scores.
LINE = """us AS (SELECT * FROM wd WHERE f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL AND f4 IS NOT NULL AND f5 IS NOT NULL AND excess_pct IS NOT NULL),
al AS (SELECT instrument_id, sidx, f, x FROM us CROSS JOIN LATERAL (VALUES ('f1', f1), ('f2', f2), ('f3', f3), ('f4', f4), ('f5', f5), ('f6', f6), ('y', excess_pct)) t(f, x)),
zs AS (SELECT *, (x - avg(x) OVER (PARTITION BY f)) / stddev_pop(x) OVER (PARTITION BY f) AS z FROM al),
co AS (SELECT a.f AS a, b.f AS b, avg(a.z * b.z) AS r FROM zs a JOIN zs b USING (instrument_id, sidx) GROUP BY 1, 2),
ke AS (SELECT DISTINCT a AS f FROM co WHERE a <> 'y' AND a NOT IN (SELECT a FROM co WHERE b < a AND b <> 'y' AND abs(r) >= 0.999999)),
rw AS (SELECT a, list(r ORDER BY b) AS m FROM co WHERE a IN (SELECT f FROM ke) AND (b = 'y' OR b IN (SELECT f FROM ke)) GROUP BY a),
ge AS (SELECT 1 AS s, list(m ORDER BY a) AS m FROM rw
  UNION ALL SELECT s + 1, [[CASE WHEN i = s THEN m[s][j] / m[s][s] ELSE m[i][j] - m[i][s] * m[s][j] / m[s][s] END for j in range(1, len(m) + 2)] for i in range(1, len(m) + 1)] FROM ge WHERE s <= len(m)),
be AS (SELECT f, m[row_number() OVER (ORDER BY f)][len(m) + 1] AS b FROM ke, (SELECT m FROM ge ORDER BY s DESC LIMIT 1)),
ft AS (SELECT z.instrument_id, z.sidx, sum(z.z * be.b) AS z FROM zs z JOIN be USING (f) GROUP BY 1, 2)"""


@query("ag_linear_fit", f"WITH RECURSIVE {WIDE}, {LINE} SELECT instrument_id, sidx, round((SELECT avg(excess_pct) FROM us) + (SELECT stddev_pop(excess_pct) FROM us) * z, 4) AS fitted FROM ft")
def ag_linear_fit(v):
    """Least squares on any number of features, from one row of moments a partition."""
    return linear.least_squares(wide_features(v), FEATURES, "excess_pct").select("instrument_id", "sidx", F.round("fitted", 4).alias("fitted"))


PV = """pv AS (SELECT instrument_id AS id, round(CASE WHEN t > 0 THEN exp(-t * t / 2) ELSE 1 END, 9) AS p FROM (
  SELECT instrument_id, avg(net_pct) / nullif(stddev_samp(net_pct) / sqrt(count(net_pct)), 0) AS t FROM trades GROUP BY 1))"""


@query("ag_holm", f"WITH {PV}, o AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS i, count(*) OVER () AS m FROM pv), t AS (SELECT *, p <= 0.05 / (m - i + 1) AS pass FROM o) SELECT id, p::DOUBLE AS p, i, bool_and(pass) OVER (ORDER BY i) AS rejected FROM t")
def ag_holm(v):
    """Step-down over a table of hypotheses (one row each): the first failure ends the rejections. A hypothesis is that
    an instrument's mean net outcome is not above 0; its p is the bound exp(-t * t / 2) of the normal tail beyond its t,
    and 1 where t is missing or not above 0."""
    t = F.try_divide(F.avg("net_pct"), F.stddev_samp("net_pct") / F.sqrt(F.count("net_pct")))
    pv = v.trades.groupBy(F.col("instrument_id").alias("id")).agg(t.alias("t"))
    pv = pv.select("id", R9(F.when(F.col("t") > 0, F.exp(-F.col("t") * F.col("t") / 2)).otherwise(1.0), "p"))
    o = pv.withColumns({"i": F.row_number().over(Window.orderBy("p", "id")), "m": F.count("*").over(Window.partitionBy())})
    o = o.withColumn("pass", F.col("p") <= 0.05 / (F.col("m") - F.col("i") + 1))
    return o.select("id", "p", "i", F.bool_and("pass").over(Window.orderBy("i")).alias("rejected"))


@query("ag_attempt_ledger", "SELECT DISTINCT p.instrument_id FROM (SELECT instrument_id FROM bars_w) p ANTI JOIN (SELECT instrument_id FROM picks WHERE sidx < 100) a USING (instrument_id)")
def ag_attempt_ledger(v):
    return v.bars_w.select("instrument_id").distinct().join(v.picks.where("sidx < 100"), "instrument_id", "left_anti")


def arithmetic_draw(seed, *keys):
    """A draw that any engine repeats."""
    total = seed * 40503
    for i, k in enumerate(keys):
        total = total + k.cast("long") * (2654435761 + 97 * i)
    return total % 1000003


UNIVERSE = "uv AS (SELECT instrument_id, session, sidx FROM grid_w WHERE close IS NOT NULL AND sidx IN (SELECT sidx FROM picks)), uo AS (" + VIEW_SQL["outcomes"].replace("FROM picks p", "FROM uv p") + ")"
DRAW_SQL = "(seed * 40503 + r.instrument_id::BIGINT * 2654435761 + r.sidx::BIGINT * 2654435858) % 1000003"
MATCHED = f"""{UNIVERSE}, rs AS (SELECT * FROM uo WHERE status = 'RESOLVED'),
k AS (SELECT sidx, count(*) AS k FROM rs JOIN picks USING (instrument_id, sidx) GROUP BY 1),
dw AS (SELECT seed, r.sidx, net_pct, excess_pct, k, row_number() OVER (PARTITION BY seed, r.sidx ORDER BY {DRAW_SQL}, r.instrument_id) AS n FROM rs r JOIN k USING (sidx), (SELECT range AS seed FROM range(1, 61))),
ds AS (SELECT seed, avg(m) AS m FROM (SELECT seed, sidx, CASE WHEN seed <= 30 THEN avg(net_pct) ELSE avg(excess_pct) END AS m FROM dw WHERE n <= k GROUP BY 1, 2) GROUP BY 1),
qs AS (SELECT seed <= 30 AS random, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.5) AS mid, quantile_cont(m, 0.975) AS hi FROM ds GROUP BY 1)"""


@query("ag_baselines", f"""WITH {MATCHED} SELECT round((SELECT avg(bench_pct) FROM rs), 6) AS benchmark, round((SELECT avg(m) FROM (SELECT avg(net_pct) AS m FROM rs GROUP BY sidx)), 6) AS universe,
  round(a.lo, 6) AS random_lo, round(a.mid, 6) AS random_mid, round(a.hi, 6) AS random_hi, round(b.lo, 6) AS placebo_lo, round(b.mid, 6) AS placebo_mid, round(b.hi, 6) AS placebo_hi
FROM qs a, qs b WHERE a.random AND NOT b.random""")
def ag_baselines(v):
    """Against all priced names of the decision dates: the benchmark's mean, the mean of the dates' means, and bands over
    30 seeds each of as many random names a date as were selected, and of ranks permuted within the date."""
    priced = v.grid_w.where("close is not null").select("instrument_id", "session", "sidx").join(v.picks.select("sidx").distinct(), "sidx", "left_semi")
    r = staged(fixed_horizon(priced, v.grid_w, v.bench_w, horizon=4).where("status = 'RESOLVED'").select("instrument_id", "sidx", "net_pct", "excess_pct", "bench_pct"))
    sizes = r.join(v.picks.select("instrument_id", "sidx"), ["instrument_id", "sidx"]).groupBy("sidx").agg(F.count("*").alias("n"))
    drawn = smallest_draws(r, sizes, "sidx", "instrument_id", 60, lambda seed: arithmetic_draw(seed, F.col("instrument_id"), F.col("sidx")), 1000003)
    by_date = drawn.groupBy("seed", "sidx").agg(F.when(F.col("seed") <= 30, F.avg("net_pct")).otherwise(F.avg("excess_pct")).alias("m"))
    means = by_date.groupBy("seed").agg(F.avg("m").alias("m"))  # one row per seed
    bands = means.agg(*[R6(F.percentile(F.when((F.col("seed") <= 30) == random, F.col("m")), F.lit(p)), f"{kind}_{at}") for random, kind in ((True, "random"), (False, "placebo")) for p, at in ((0.025, "lo"), (0.5, "mid"), (0.975, "hi"))])
    dates = r.groupBy("sidx").agg(F.avg("net_pct").alias("m")).agg(R6(F.avg("m"), "universe"))
    return r.agg(R6(F.avg("bench_pct"), "benchmark")).crossJoin(F.broadcast(dates)).crossJoin(F.broadcast(bands))  # one row each


PLACEBO = """sd AS (SELECT range AS seed FROM range(1, 31)), k AS (SELECT sidx, count(*) AS k FROM picks GROUP BY sidx),
dr AS (SELECT seed, g.instrument_id, g.sidx, k, row_number() OVER (PARTITION BY seed, g.sidx ORDER BY (seed * 40503 + g.instrument_id::BIGINT * 2654435761 + g.sidx::BIGINT * 2654435858) % 1000003, g.instrument_id) AS r FROM grid_w g JOIN k USING (sidx) CROSS JOIN sd WHERE g.close IS NOT NULL),
pb AS (SELECT seed, instrument_id, sidx FROM dr WHERE r <= k)"""


def placebos(v, seeds=30):
    """The same number of random priced names on the same dates, for all seeds in one job."""
    k = v.picks.groupBy("sidx").agg(F.count("*").alias("k"))
    g = v.grid_w.where("close is not null").select("instrument_id", "sidx").join(k, "sidx").withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))
    w = Window.partitionBy("seed", "sidx").orderBy(arithmetic_draw(F.col("seed").cast("long"), F.col("instrument_id"), F.col("sidx")), "instrument_id")
    return g.withColumn("r", F.row_number().over(w)).where("r <= k").select("seed", "instrument_id", "sidx")


@query("ag_placebo_signals", f"WITH {PLACEBO} SELECT seed, instrument_id, sidx FROM pb")
def ag_placebo_signals(v):
    return placebos(v)


BAND = f"""{PLACEBO}, pr AS (SELECT p.seed, avg((x.open / e.open - 1) * 100) AS m FROM pb p JOIN grid_w e ON e.instrument_id = p.instrument_id AND e.sidx = p.sidx + 1 JOIN grid_w x ON x.instrument_id = p.instrument_id AND x.sidx = p.sidx + 5 WHERE e.open > 0 AND x.open > 0 GROUP BY 1),
re AS (SELECT avg((x.open / e.open - 1) * 100) AS m FROM picks p JOIN grid_w e ON e.instrument_id = p.instrument_id AND e.sidx = p.sidx + 1 JOIN grid_w x ON x.instrument_id = p.instrument_id AND x.sidx = p.sidx + 5 WHERE e.open > 0 AND x.open > 0)"""


def gross(v, picks, *keys):
    """Both prices come from one window over an instrument's sessions, which are dense, and one join."""
    ahead = lambda k: F.lead("open", k).over(Window.partitionBy("instrument_id").orderBy("sidx"))
    g = v.grid_w.select("instrument_id", "sidx", ahead(1).alias("o0"), ahead(5).alias("o1")).where("o0 > 0 and o1 > 0")
    return picks.join(g, ["instrument_id", "sidx"]).groupBy(*keys).agg(F.avg((F.col("o1") / F.col("o0") - 1) * 100).alias("m"))


def band(v):
    p = gross(v, placebos(v), "seed")
    return p.crossJoin(F.broadcast(gross(v, v.picks).withColumnRenamed("m", "real")))


@query("ag_placebo_band", f"WITH {BAND} SELECT round(min(p.m), 6) AS lo, round(avg(p.m), 6) AS mean, round(max(p.m), 6) AS hi, round(any_value(re.m), 6) AS real, any_value(re.m) > max(p.m) AS beats_best, round(100.0 * avg((p.m < re.m)::INT), 6) AS percentile FROM pr p, re")
def ag_placebo_band(v):
    return band(v).agg(R6(F.min("m"), "lo"), R6(F.avg("m"), "mean"), R6(F.max("m"), "hi"), R6(F.first("real"), "real"), (F.first("real") > F.max("m")).alias("beats_best"), R6(F.avg((F.col("m") < F.col("real")).cast("double")) * 100, "percentile"))


@query("ag_decision_rule", f"WITH {BAND}, w AS (SELECT date_trunc('week', entry_session) AS b, avg(net_pct) AS m FROM trades WHERE net_pct IS NOT NULL GROUP BY 1), t AS (SELECT avg(m) / (stddev_samp(m) / sqrt(count(*))) AS t FROM w) SELECT (SELECT m FROM re) > (SELECT max(m) FROM pr) AS beats_placebo, (SELECT m FROM re) > 0 AS positive, (SELECT t FROM t) > 2 AS significant, (SELECT m FROM re) > (SELECT max(m) FROM pr) AND (SELECT m FROM re) > 0 AND (SELECT t FROM t) > 2 AS accepted")
def ag_decision_rule(v):
    from .outcomes import t_of_means

    b = band(v).agg((F.first("real") > F.max("m")).alias("beats_placebo"), (F.first("real") > 0).alias("positive"))
    t = t_of_means(v.trades, "net_pct", F.date_trunc("week", "entry_session")).select((F.col("t") > 2).alias("significant"))
    return b.crossJoin(t).withColumn("accepted", F.col("beats_placebo") & F.col("positive") & F.col("significant"))


def block_draws(v, replications, block, circular):
    """replications x blocks of consecutive dates, by arithmetic draws: joined on the date's ordinal."""
    d = v.outcomes.where("status = 'RESOLVED'").groupBy("sidx").agg(F.avg("net_pct").alias("m"))
    d = d.withColumn("i", F.row_number().over(Window.orderBy("sidx")) - 1)  # one row per decision date
    n = d.agg(F.count("*").alias("n"))
    reps = v.spark.range(replications).withColumnRenamed("id", "rep").crossJoin(F.broadcast(n)).where("n > 0")
    b = reps.withColumn("b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block) - 1)))
    starts = arithmetic_draw(F.lit(11).cast("long"), F.col("rep"), F.col("b")) % (F.col("n") if circular else F.greatest(F.col("n") - block + 1, F.lit(1)))
    b = b.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).withColumn("i", (starts + F.col("k")) % F.col("n"))
    return b.where(F.col("b") * block + F.col("k") < F.col("n")).join(d.select("i", "m"), "i")


def draws_sql(replications, block, circular):
    span = "n" if circular else f"greatest(n - {block} + 1, 1)"
    return f"""dd AS (SELECT sidx, avg(net_pct) AS m, row_number() OVER (ORDER BY sidx) - 1 AS i FROM outcomes WHERE status = 'RESOLVED' GROUP BY sidx), nn AS (SELECT count(*) AS n FROM dd),
bl AS (SELECT rep, b, k, n, ((11 * 40503 + rep * 2654435761 + b * 2654435858) % 1000003 % {span} + k) % n AS i FROM nn, range({replications}) r(rep), range({block}) kk(k), range(0, 100000) bb(b) WHERE b <= ceil(n / {block}.0) - 1 AND b * {block} + k < n)"""


@query("ag_block_bootstrap", f"WITH {draws_sql(2000, 2, False)}, me AS (SELECT rep, avg(m) AS m FROM bl JOIN dd USING (i) GROUP BY rep) SELECT count(*) AS replications, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM me")
def ag_block_bootstrap(v):
    means = block_draws(v, 2000, 2, False).groupBy("rep").agg(F.avg("m").alias("m"))
    return means.agg(F.count("*").alias("replications"), R6(F.avg("m"), "mean"), R6(F.percentile("m", F.lit(0.025)), "lo"), R6(F.percentile("m", F.lit(0.975)), "hi"))


@query("ag_circular_bootstrap", f"WITH {draws_sql(2000, 4, True)}, me AS (SELECT rep, avg(m) AS m, sum(CASE WHEN m > -100 THEN ln(1 + m / 100) END) AS g FROM bl JOIN dd USING (i) GROUP BY rep) SELECT round(avg((m > 0)::INT), 6) AS p_positive, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, round(median(g), 6) AS median_log_growth FROM me")
def ag_circular_bootstrap(v):
    reps = block_draws(v, 2000, 4, True).groupBy("rep").agg(F.avg("m").alias("m"), F.sum(F.when(F.col("m") > -100, F.ln(1 + F.col("m") / 100))).alias("g"))
    return reps.agg(R6(F.avg((F.col("m") > 0).cast("double")), "p_positive"), R6(F.percentile("m", F.lit(0.025)), "lo"), R6(F.percentile("m", F.lit(0.975)), "hi"), R6(F.median("g"), "median_log_growth"))


FOLDS = "fo AS (SELECT k AS fold, 1 AS train_from, 100 + (k - 1) * 50 - 6 AS train_to, 100 + (k - 1) * 50 AS valid_from, least(100 + k * 50 - 1, z) AS valid_to FROM (SELECT max(sidx) AS z FROM cal_w), range(1, 10000) r(k) WHERE 100 + (k - 1) * 50 <= z)"


def folds(v, start=100, step=50, purge=5):
    """Expanding folds by session ordinal, up to the calendar's end, where the last may be shorter: training ends
    `purge` + 1 sessions before validation starts."""
    z = v.cal_w.agg(F.max("sidx").alias("z")).where(F.col("z") >= start)
    k = z.select("z", F.explode(F.sequence(F.lit(0), F.floor((F.col("z") - start) / step).cast("int"))).alias("k"))
    frm = F.lit(start) + F.col("k") * step
    return k.select((F.col("k") + 1).alias("fold"), F.lit(1).alias("train_from"), (frm - purge - 1).alias("train_to"), frm.alias("valid_from"), F.least(frm + step - 1, "z").alias("valid_to"))


@query("wn_walk_forward", f"WITH {FOLDS} SELECT fold, a.session AS train_to, b.session AS valid_from, c.session AS valid_to FROM fo JOIN cal_w a ON a.sidx = fo.train_to JOIN cal_w b ON b.sidx = fo.valid_from JOIN cal_w c ON c.sidx = fo.valid_to")
def wn_walk_forward(v):
    f = folds(v)
    for c in ("train_to", "valid_from", "valid_to"):
        f = f.join(v.cal_w.select(F.col("sidx").alias(c), F.col("session").alias(f"_{c}")), c)
    return f.select("fold", *[F.col(f"_{c}").alias(c) for c in ("train_to", "valid_from", "valid_to")])


def in_folds(v, df):
    """Rows of df in each fold's validation span (a row may be in several): folds are few and known by number."""
    f = folds(v).select("fold", F.explode(F.sequence("valid_from", "valid_to")).alias("sidx"))
    return df.join(f, "sidx")


@query("so_oos_union", f"WITH {FOLDS} SELECT fold, instrument_id, sidx, excess_pct FROM outcomes JOIN fo ON sidx BETWEEN valid_from AND valid_to WHERE status = 'RESOLVED'")
def so_oos_union(v):
    return in_folds(v, v.outcomes.where("status = 'RESOLVED'")).select("fold", "instrument_id", "sidx", "excess_pct")


@query("ag_fold_summary", f"WITH {FOLDS} SELECT fold, count(*) AS n, round(avg(excess_pct), 8) AS mean_excess FROM outcomes JOIN fo ON sidx BETWEEN valid_from AND valid_to WHERE status = 'RESOLVED' GROUP BY fold")
def ag_fold_summary(v):
    return in_folds(v, v.outcomes.where("status = 'RESOLVED'")).groupBy("fold").agg(F.count("*").alias("n"), R8(F.avg("excess_pct"), "mean_excess"))


@query("wn_fold_checks", f"WITH {FOLDS} SELECT fold, count(*) FILTER (WHERE sidx <= train_to AND sidx + 5 >= valid_from) AS label_overlaps, count(*) FILTER (WHERE sidx BETWEEN valid_from AND valid_to) AS in_oos FROM outcomes CROSS JOIN fo GROUP BY fold")
def wn_fold_checks(v):
    by = v.outcomes.groupBy("sidx").agg(F.count("*").alias("c")).crossJoin(F.broadcast(folds(v)))  # dates x folds
    part = lambda cond: F.coalesce(F.sum(F.when(F.expr(cond), F.col("c"))), F.lit(0))
    return by.groupBy("fold").agg(part("sidx <= train_to and sidx + 5 >= valid_from").alias("label_overlaps"), part("sidx between valid_from and valid_to").alias("in_oos"))


#: shares of the calendar
SPLITS = {"train": 0.45, "validation": 0.3, "holdout": 0.25}
SPLIT_SQL = "sp AS (SELECT name, n, floor(n * before)::INT + 1 AS a, floor(n * upto)::INT AS b FROM (VALUES ('train', 0, 0.45), ('validation', 0.45, 0.75), ('holdout', 0.75, 1)) t(name, before, upto), (SELECT count(*) AS n FROM cal_w))"


@query("wn_split_window", f"WITH {SPLIT_SQL} SELECT name, x.session AS opens, y.session AS closes FROM sp JOIN cal_w x ON x.sidx = a + CASE WHEN a > 1 THEN 12 ELSE 0 END JOIN cal_w y ON y.sidx = b - 5")
def wn_split_window(v):
    """Shares of the whole calendar, one after another; but for the first, a window opens 12 sessions late (what the
    features before it have seen), and all close 5 early (what their outcomes need)."""
    upto = [round(sum(list(SPLITS.values())[:i]), 6) for i in range(len(SPLITS) + 1)]
    s = v.spark.createDataFrame([(name, float(upto[i]), float(upto[i + 1])) for i, name in enumerate(SPLITS)], "name string, before double, upto double")
    c = v.cal_w
    s = s.crossJoin(F.broadcast(c.agg(F.count("*").alias("n"))))
    at = lambda share: F.floor(F.col("n") * F.col(share).cast("decimal(4,2)")).cast("int")
    s = s.select("name", (at("before") + 1).alias("a"), at("upto").alias("b"))
    s = s.select("name", (F.col("a") + F.when(F.col("a") > 1, 12).otherwise(0)).alias("a"), (F.col("b") - 5).alias("b"))
    return s.join(c.select(F.col("sidx").alias("a"), F.col("session").alias("opens")), "a").join(c.select(F.col("sidx").alias("b"), F.col("session").alias("closes")), "b").select("name", "opens", "closes")


@query("ag_gate_results", f"WITH {IC}, {FOLDS}, f AS (SELECT fold, avg(excess_pct) AS m FROM outcomes JOIN fo ON sidx BETWEEN valid_from AND valid_to WHERE status = 'RESOLVED' GROUP BY fold) SELECT (SELECT count(*) FROM ic) >= 24 AS enough_dates, (SELECT avg(ic) FROM ic) > 0 AS ic_positive, (SELECT avg((m > 0)::INT) FROM f) >= 0.6 AS folds_positive, (SELECT avg((status <> 'RESOLVED')::INT) FROM outcomes) <= 0.1 AS few_unresolved")
def ag_gate_results(v):
    ic = ag_rank_ic(v).select((F.col("dates") >= 24).alias("enough_dates"), (F.col("mean_ic") > 0).alias("ic_positive"))
    f = in_folds(v, v.outcomes.where("status = 'RESOLVED'")).groupBy("fold").agg(F.avg("excess_pct").alias("m")).agg((F.avg((F.col("m") > 0).cast("double")) >= 0.6).alias("folds_positive"))
    u = v.outcomes.agg((F.avg((F.col("status") != "RESOLVED").cast("double")) <= 0.1).alias("few_unresolved"))
    return ic.crossJoin(f).crossJoin(u)  # one row each


@query("ag_outcome_accounting", "SELECT count(*) FILTER (WHERE p.sidx IS NULL) AS without_prediction, count(*) FILTER (WHERE o.sidx IS NULL) AS without_outcome, count(*) FILTER (WHERE o.status IS NULL) AS unlabelled FROM picks p FULL JOIN outcomes o ON p.instrument_id = o.instrument_id AND p.sidx = o.sidx")
def ag_outcome_accounting(v):
    p = v.picks.select("instrument_id", "sidx", F.lit(1).alias("p"))
    o = v.outcomes.select("instrument_id", "sidx", F.lit(1).alias("o"), "status")
    j = p.join(o, ["instrument_id", "sidx"], "full_outer")
    return j.agg(F.count_if(F.col("p").isNull()).alias("without_prediction"), F.count_if(F.col("o").isNull()).alias("without_outcome"), F.count_if(F.col("status").isNull()).alias("unlabelled"))


@query("wn_feature_materialize", "SELECT instrument_id, sidx, CASE WHEN close IS NULL AND stale THEN 'STALE' WHEN close IS NULL THEN 'MISSING' ELSE 'AVAILABLE' END AS state, CASE WHEN close > 0 THEN round(-ln(close), 8) END AS oriented FROM (SELECT *, sidx - last_value(CASE WHEN close IS NOT NULL THEN sidx END IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY sidx) <= 5 AS stale FROM grid_w)")
def wn_feature_materialize(v):
    last = F.last(F.when(F.col("close").isNotNull(), F.col("sidx")), True).over(fx.BY())
    state = F.when(F.col("close").isNull() & (F.col("sidx") - last <= 5), "STALE").when(F.col("close").isNull(), "MISSING").otherwise("AVAILABLE")
    return v.grid_w.select("instrument_id", "sidx", state.alias("state"), F.when(F.col("close") > 0, F.round(-F.ln("close"), 8)).alias("oriented"))


@query("px_row_hash", "SELECT instrument_id, session, sha256(concat_ws('|', instrument_id::VARCHAR, session::VARCHAR, floor(close * 1000000 + 0.5)::BIGINT::VARCHAR, floor(volume * 1000000 + 0.5)::BIGINT::VARCHAR)) AS row_hash FROM bars_w")
def px_row_hash(v):
    """SHA-256 of a row's canonical text: numbers in millionths, so that it does not hang on how doubles are printed."""
    unit = lambda c: F.floor(F.col(c) * 1000000 + 0.5).cast("long").cast("string")
    return v.bars_w.select("instrument_id", "session", F.sha2(F.concat_ws("|", F.col("instrument_id").cast("string"), F.col("session").cast("string"), unit("close"), unit("volume")), 256).alias("row_hash"))


CONFIDENCE = """re AS (SELECT * FROM outcomes WHERE status = 'RESOLVED'), ld AS (SELECT max(sidx) AS last FROM cal_w),
hy AS (SELECT o.instrument_id, count(*) AS n, stddev_samp(net_pct) AS sd, avg(net_pct) AS m, avg(gross_pct) AS g, count(DISTINCT year(session)) AS years, max(sidx) AS latest, avg(net_pct) FILTER (WHERE sidx > last - 100) AS recent FROM re o, ld GROUP BY 1),
fm AS (SELECT instrument_id, avg((m > 0)::INT) AS share FROM (SELECT instrument_id, sidx // 50 AS f, avg(net_pct) AS m FROM re GROUP BY 1, 2) GROUP BY 1),
lf AS (SELECT instrument_id, concat_ws('|', CASE WHEN NOT n >= 30 THEN 'SMALL_EFFECTIVE_SAMPLE' END, CASE WHEN NOT coalesce(3.92 * sd / sqrt(n) <= 1.0, false) THEN 'WIDE_UNCERTAINTY_INTERVAL' END, CASE WHEN NOT share >= 0.6 THEN 'FOLD_INSTABILITY' END, CASE WHEN NOT years >= 4 THEN 'NARROW_COVERAGE' END,
  CASE WHEN NOT latest > last - 30 THEN 'STALE_OR_INCOMPLETE_DATA' END, CASE WHEN NOT m - 0.25 > 0 THEN 'COST_SENSITIVITY' END, CASE WHEN NOT (m > 0) = (g > 0.5) THEN 'PARAMETER_SENSITIVITY' END,
  CASE WHEN NOT coalesce(m / (sd / sqrt(n)) > 0 AND exp(-power(m / (sd / sqrt(n)), 2) / 2) <= 0.05 / (SELECT count(*) FROM hy), false) THEN 'MULTIPLE_TESTING_BURDEN' END, CASE WHEN NOT coalesce(recent >= 0, false) THEN 'RECENT_DECAY' END) AS factors FROM hy JOIN fm USING (instrument_id), ld)"""


@query("px_confidence_band", f"WITH {CONFIDENCE} SELECT instrument_id, factors, CASE WHEN factors = '' THEN 'HIGH' WHEN len(factors) - len(replace(factors, '|', '')) <= 1 THEN 'MODERATE' ELSE 'LOW' END AS band FROM lf")
def px_confidence_band(v):
    """A hypothesis is that an instrument's decisions gain: what limits the confidence in it, from its outcomes."""
    re = v.outcomes.where("status = 'RESOLVED'")
    last = v.cal_w.agg(F.max("sidx").alias("last"))
    h = re.crossJoin(F.broadcast(last)).groupBy("instrument_id", "last").agg(
        F.count("*").alias("n"), F.stddev_samp("net_pct").alias("sd"), F.avg("net_pct").alias("m"), F.avg("gross_pct").alias("g"), F.countDistinct(F.year("session")).alias("years"),
        F.max("sidx").alias("latest"), F.avg(F.when(F.col("sidx") > F.col("last") - 100, F.col("net_pct"))).alias("recent"),
    )
    by_fold = re.groupBy("instrument_id", F.expr("sidx div 50").alias("f")).agg(F.avg("net_pct").alias("m"))
    share = by_fold.groupBy("instrument_id").agg(F.avg((F.col("m") > 0).cast("double")).alias("share"))
    tests = h.agg(F.count("*").alias("tests"))
    j = h.join(share, "instrument_id").crossJoin(F.broadcast(tests))
    t = F.try_divide("m", F.col("sd") / F.sqrt("n"))
    factors = rules.limiting_factors(
        F.col("n"), F.col("sd") * 3.92 / F.sqrt("n"), F.col("share") >= 0.6, F.col("years") >= 4, F.col("latest") > F.col("last") - 30, F.col("m") - 0.25 > 0,
        (F.col("m") > 0) == (F.col("g") > 0.5), (t > 0) & (F.exp(-t * t / 2) <= F.lit(0.05) / F.col("tests")), F.col("recent") >= 0,
    )
    return j.select("instrument_id", factors.alias("f")).select("instrument_id", F.array_join("f", "|").alias("factors"), rules.confidence_band(F.col("f")).alias("band"))
