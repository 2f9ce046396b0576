"""Statistics over entities: paired contrasts, tests, resampling.

Moments are relational. Resampling draws by hash (replicate, position), so replicates are rows that
Spark distributes, and a rerun agrees. Distribution functions are expressions too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import hash01
from ..functions.special import normal_two_tails, t_cdf, t_central
from ..storage import stored


def paired(metrics: DataFrame, value: str, models: list[str], entity: str = "entity") -> DataFrame:
    """A row per entity with a column per model: means over seeds, entities with all models only."""
    per = metrics.groupBy(entity, "model", "seed").agg(F.avg(value).alias("v")).groupBy(entity).pivot("model", models).agg(F.avg("v"))
    return per.dropna(subset=models)


def factorial(cells: DataFrame, a: str, b: str, c: str, e: str, entity: str = "entity") -> DataFrame:
    """(entity, family, contrast, d) for a 2 x 2 design with cells a (1, 1), b (1, 2), c (2, 1), e (2, 2)."""
    A, B, C, E = (F.col(f"`{k}`") for k in (a, b, c, e))
    rows = [
        ("primary", "first factor", 0.5 * ((A - C) + (B - E))),
        ("primary", "second factor", 0.5 * ((A - B) + (C - E))),
        ("primary", "interaction", (A - B) - (C - E)),
        ("simple", "first | level 1", A - C),
        ("simple", "first | level 2", B - E),
        ("simple", "second | level 1", A - B),
        ("simple", "second | level 2", C - E),
    ]
    made = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).alias("contrast"), d.alias("d")) for f, n, d in rows])
    return cells.select(entity, F.inline(made))


def moments(d: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, estimate, sd, t, wins, losses) of one-sample t statistics against 0."""
    m = d.groupBy(*keys).agg(
        F.count("d").alias("n"), F.avg("d").alias("estimate"), F.stddev_samp("d").alias("sd"), F.count(F.when(F.col("d") > 0, 1)).alias("wins"), F.count(F.when(F.col("d") < 0, 1)).alias("losses")
    )
    return m.withColumn("t", F.when(F.col("sd") > 0, F.col("estimate") / (F.col("sd") / F.sqrt("n"))))


def t_tests(m: DataFrame, margin: float = 0.03, level: float = 0.95) -> DataFrame:
    """Adds p_t (two-sided), the confidence interval, and the TOST p value and interval for
    equivalence within ``margin``; null for fewer than two values and for those that don't vary."""
    n, est, sd, df = F.col("n"), F.col("estimate"), F.col("sd"), F.col("n") - 1
    good, se = (n >= 2) & (sd > 0), sd / F.sqrt(n)
    # one expression each, over the values to test and over the levels
    tails = F.transform(F.array(-F.abs(est / se), -(est + margin) / se, (est - margin) / se), lambda t: t_cdf(t, df))
    central = F.transform(F.array(F.lit(level), F.lit(2 * level - 1)), lambda share: t_central(share, df) * se)
    p, q = F.col("__p"), F.col("__q")
    out = m.withColumns({"__p": F.when(good, tails), "__q": F.when(good, central)})
    return out.withColumns({
        "p_t": 2 * p[0], "ci_lo": est - q[0], "ci_hi": est + q[0], "p_tost": F.greatest(p[1], p[2]), "tost_lo": est - q[1], "tost_hi": est + q[1]
    }).drop("__p", "__q")


def pairs(cells: DataFrame, models: list[str], entity: str = "entity") -> DataFrame:
    """(entity, family, contrast, d): the difference of each two models, earlier less later, all in one family."""
    two = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    made = F.array(*[F.struct(F.lit("pairs").alias("family"), F.lit(f"{a} - {b}").alias("contrast"), (F.col(f"`{a}`") - F.col(f"`{b}`")).alias("d")) for a, b in two])
    return cells.select(entity, F.inline(made))


def holm(p: DataFrame, family: list[str], value: str = "p", name: str = "contrast", out: str = "holm_p") -> DataFrame:
    """Adds Holm's step-down adjustment within families; ties by name."""
    w = Window.partitionBy(*family).orderBy(value, name)
    n = F.count("*").over(Window.partitionBy(*family))
    step = F.least((n - F.row_number().over(w) + 1) * F.col(value), F.lit(1.0))
    return p.withColumn("__s", step).withColumn(out, F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def _replicates(d: DataFrame, n: int) -> DataFrame:
    return d.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def sign_flip(d: DataFrame, keys: list[str], entity: str = "entity", n: int = 10_000) -> DataFrame:
    """(keys, p_perm): sign-flip permutation p values, (1 + hits) / (n + 1)."""
    obs = d.groupBy(*keys).agg(F.abs(F.avg("d")).alias("obs"))
    sign = F.when(hash01(F.lit("flip"), F.col(entity), F.col("rep")) < 0.5, -1.0).otherwise(1.0)
    null = _replicates(d, n).groupBy(*keys, "rep").agg(F.abs(F.avg(sign * F.col("d"))).alias("m"))
    hits = null.join(obs, keys).groupBy(*keys).agg(F.count(F.when(F.col("m") >= F.col("obs") - 1e-15, 1)).alias("k"))
    return hits.select(*keys, ((1 + F.col("k")) / (n + 1)).alias("p_perm"))


def bootstrap(d: DataFrame, keys: list[str], unit: str = "entity", n: int = 2000, level: float = 0.95) -> DataFrame:
    """(keys, boot_lo, boot_hi): percentile intervals of the mean of d, resampling ``unit`` (entities, or
    sites for the cluster bootstrap; a site brings all its rows)."""
    u = d.groupBy(*keys, unit).agg(F.sum("d").alias("s"), F.count("d").alias("c"))
    u = u.withColumns({"i": F.row_number().over(Window.partitionBy(*keys).orderBy(unit)) - 1, "m": F.count("*").over(Window.partitionBy(*keys))})
    draws = _replicates(u, n).withColumn("pick", F.floor(hash01(F.lit("boot"), F.col("rep"), F.col("i")) * F.col("m")).cast("int")).select(*keys, "rep", "pick")
    got = draws.join(u.select(*keys, F.col("i").alias("pick"), "s", "c"), [*keys, "pick"])
    means = got.groupBy(*keys, "rep").agg((F.sum("s") / F.sum("c")).alias("mean"))
    a = (1 - level) / 2
    return means.groupBy(*keys).agg(F.percentile("mean", F.lit(a)).alias("boot_lo"), F.percentile("mean", F.lit(1 - a)).alias("boot_hi"))


def _drawn_units(units: DataFrame, keys: list[str], unit: str, n: int) -> DataFrame:
    """(keys, unit, rep, times): how often each of n replicates draws a unit (those it doesn't draw are left out), and a replicate -1
    that has each unit once. Units get their numbers by ranges, so no task sees all units of a key."""
    at = mid_ranks(units, keys, unit).select(*keys, unit, (F.col("mid") - 1).cast("long").alias("i"), F.round(2 * (F.col("mid") - F.col("off")) - 1).cast("long").alias("m"))
    pick = F.floor(hash01(F.lit("boot"), F.col("rep"), F.col("i")) * F.col("m")).cast("long")
    times = _replicates(at, n).select(*keys, "rep", pick.alias("i")).groupBy(*keys, "rep", "i").agg(F.count("*").alias("times"))
    drawn = _same(times, at.drop("m"), [*keys, "i"]).select(*keys, unit, "rep", "times")
    return drawn.unionByName(at.select(*keys, unit, F.lit(-1).alias("rep"), F.lit(1).cast("long").alias("times")))


def ratio_bootstrap(ops: DataFrame, keys: list[str], unit: str = "entity", n: int = 2000, block: int = 1024) -> DataFrame:
    """Waste errors over entities with positive truth, each with a percentile interval from resampled units (entities, or sites, which
    bring all their entities): bias (sum of estimates over sum of truths, less 1), gross error of the totals' parts, gross error of the
    entities' parts, and the median relative error. Long format: (keys, stat, value, lo, hi).

    A replicate is rows of (unit, how often it is drawn). Sums are weighted by that; a median is found among blocks of about ``block``
    neighbouring values by the blocks' weights, then by prefix sums within the one or two blocks that hold the middle. No task
    holds all entities of a key. Entities whose truth is null or not positive are left out."""
    parts = ["est_kwh", "true_kwh", "matched_err_kwh", "false_add_kwh", "missed_kwh"]
    own = ["entity"] if unit == "entity" else ["entity", unit]
    per = ops.groupBy(*keys, *own).agg(*[F.sum(c).alias(c) for c in parts]).where("true_kwh > 0")
    per = stored(per.select(*keys, *own, *parts, F.abs(F.col("est_kwh") / F.col("true_kwh") - 1).alias("rel")), "ratios")
    per = _same(per, mid_ranks(per, keys, "rel").select(*keys, "rel", F.floor(F.col("mid") / block).alias("block")), [*keys, "rel"])
    rows = _same(per, _drawn_units(per.select(*keys, unit).distinct(), keys, unit, n), [*keys, unit])

    k, alone = F.col("times"), F.abs("matched_err_kwh") + F.abs("false_add_kwh") + F.abs("missed_kwh")
    sums = [F.sum(k * F.col(c)).alias(c) for c in parts] + [F.sum(k * alone).alias("alone"), F.sum(k).alias("w")]
    blocks = stored(rows.groupBy(*keys, "rep", "block").agg(*sums), "blocks")
    one = Window.partitionBy(*keys, "rep")
    total, before = F.sum("w").over(one), F.coalesce(F.sum("w").over(one.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the two middle places of the weighted values (one and the same for odd weights)
    held = blocks.select(*keys, "rep", "block", "w", before.alias("before"), F.floor((total + 1) / 2).alias("low"), (F.floor(total / 2) + 1).alias("high"))
    held = held.where("before < high and before + w >= low").drop("w")
    near = _same(rows, held, [*keys, "rep", "block"]).groupBy(*keys, "rep", "block", "before", "low", "high", "rel").agg(F.sum(k).alias("w"))
    upto = F.col("before") + F.sum("w").over(Window.partitionBy(*keys, "rep", "block").orderBy("rel").rowsBetween(Window.unboundedPreceding, 0))
    holds = lambda place: F.min(F.when((F.col("upto") - F.col("w") < F.col(place)) & (F.col("upto") >= F.col(place)), F.col("rel")))
    middle = near.withColumn("upto", upto).groupBy(*keys, "rep").agg(((holds("low") + holds("high")) / 2).alias("median"))

    whole = blocks.groupBy(*keys, "rep").agg(*[F.sum(c).alias(c) for c in [*parts, "alone"]])
    stats = {
        "agg_bias": F.col("est_kwh") / F.col("true_kwh") - 1, "agg_gross_rel": alone / F.col("true_kwh"), "pb_gross_rel": F.col("alone") / F.col("true_kwh"), "median_abs_rel_err": F.col("median")
    }
    made = F.array(*[F.struct(F.lit(name).alias("stat"), c.alias("v")) for name, c in stats.items()])
    each = _same(whole, middle, [*keys, "rep"]).select(*keys, "rep", F.inline(made))
    drawn = F.when(F.col("rep") >= 0, F.col("v"))
    return each.groupBy(*keys, "stat").agg(
        F.max(F.when(F.col("rep") < 0, F.col("v"))).alias("value"), F.percentile(drawn, F.lit(0.025)).alias("lo"), F.percentile(drawn, F.lit(0.975)).alias("hi")
    )


def random_intercept(d: DataFrame, keys: list[str], group: str = "site", rounds: int = 5, points: int = 64) -> DataFrame:
    """(keys, mixed_est, p_mixed): the mean of d with a random intercept per group, by REML; null for fewer than two values and for
    values that don't vary.

    The ratio of the two variances is the one free parameter. Its profile likelihood needs four sums over groups of a group's count,
    mean and sum of squares, so the candidates are rows: a logarithmic grid (and 0), then ``rounds`` grids of ``points`` between the neighbours of the best
    so far, each one aggregation over groups times candidates. Group summaries are stored; no task holds all groups of a key."""
    groups = d.where("d is not null").groupBy(*keys, group).agg(F.count("d").alias("n"), F.avg("d").alias("mean"), (F.var_pop("d") * F.count("d")).alias("ss"))
    groups = stored(groups, "groups")
    whole = groups.groupBy(*keys).agg(F.sum("n").alias("all"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("centre"), F.sum("ss").alias("within"))
    rows = _same(groups.drop(group), whole, keys).withColumn("c", F.col("mean") - F.col("centre"))

    def likeliest(grid: DataFrame) -> DataFrame:
        """(keys, best): of the candidates (keys, j, lam, below, above) the one of the greatest likelihood, the first of equals."""
        lam, n, c = F.col("lam"), F.col("n"), F.col("c")
        w = n / (1 + lam * n)
        at = _same(rows, grid, keys).groupBy(*keys, "j", "lam", "below", "above", "all", "centre", "within").agg(
            F.sum(w).alias("w"), F.sum(w * c).alias("wc"), F.sum(w * c * c).alias("wcc"), F.sum(F.log1p(lam * n)).alias("logs")
        )
        q, df = F.col("within") + F.greatest(F.col("wcc") - F.col("wc") * F.col("wc") / F.col("w"), F.lit(0.0)), F.col("all") - 1
        like = -0.5 * (df * F.log(q / df) + F.col("logs") + F.log("w"))
        est, se = F.col("centre") + F.col("wc") / F.col("w"), F.sqrt(q / df / F.col("w"))
        return at.where((F.col("all") >= 2) & (q > 1e-24)).groupBy(*keys).agg(F.max(F.struct(like.alias("like"), (-F.col("j")).alias("first"), "below", "above", est.alias("est"), se.alias("se"))).alias("best"))

    def candidates(frame: DataFrame, last: int, value) -> DataFrame:
        near = lambda j: F.struct(j.alias("j"), value(j).alias("lam"), value(F.greatest(j - 1, F.lit(0))).alias("below"), value(F.least(j + 1, F.lit(last))).alias("above"))
        return frame.select(*keys, F.inline(F.transform(F.sequence(F.lit(0), F.lit(last)), near)))

    best = likeliest(candidates(whole, 201, lambda j: F.when(j == 0, 0.0).otherwise(F.pow(F.lit(10.0), -6 + (j - 1) / 20))))
    for _ in range(rounds):
        lo, hi = F.col("best.below"), F.col("best.above")
        best = likeliest(candidates(best, points, lambda j: lo + (hi - lo) * j / points))  # noqa: B023
    est, se = F.col("best.est"), F.col("best.se")
    return _same(whole.select(*keys), best.select(*keys, est.alias("mixed_est"), normal_two_tails(est / se).alias("p_mixed")), keys, "left")


def _same(a: DataFrame, b: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of one name, nulls equal to nulls."""
    other = b.withColumnsRenamed({c: f"__{c}" for c in cols})
    on = None
    for c in cols:
        one = a[c].eqNullSafe(other[f"__{c}"])
        on = one if on is None else on & one
    return a.join(other, on, how).drop(*[f"__{c}" for c in cols])


def mid_ranks(df: DataFrame, keys: list[str], x: str, **more: Column) -> DataFrame:
    """(keys, x, n, mid, off, ...): each distinct value of x in a key, how many rows have it, their mid-rank in the key, how far that
    is from the key's middle, and what ``more`` aggregates over them.

    No task sees a whole key. Equal values become one row first; the rows are sorted by ranges of (keys, x), over all keys, and
    stored; a rank is what the key has in earlier ranges (a few counts for each range), plus what comes before the value in its own."""
    values = df.groupBy(*keys, x).agg(F.count("*").alias("n"), *[c.alias(name) for name, c in more.items()])
    line = stored(values.repartitionByRange(*keys, x).withColumn("__range", F.spark_partition_id()), "ranks")
    sizes = line.groupBy(*keys, "__range").agg(F.sum("n").alias("__own"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"__before": F.coalesce(F.sum("__own").over(earlier), F.lit(0)), "__total": F.sum("__own").over(Window.partitionBy(*keys))}).drop("__own")
    inside = Window.partitionBy(*keys, "__range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("__inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    mid = F.col("__before") + F.col("__inside") + (F.col("n") + 1) / 2
    return _same(line, sizes, [*keys, "__range"]).select(*keys, x, "n", mid.alias("mid"), (mid - (F.col("__total") + 1) / 2).alias("off"), *more)


def signed_rank(d: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, w_plus, z): Wilcoxon's signed-rank statistic of non-zero differences, mid-ranks for
    ties, and its normal score (variance less the ties' part)."""
    r = mid_ranks(d.where(F.col("d") != 0).withColumn("__a", F.abs("d")), keys, "__a", __plus=F.count(F.when(F.col("d") > 0, 1)))
    s = r.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("mid") * F.col("__plus")).alias("w_plus"), F.sum(F.col("n") * (F.col("n") * F.col("n") - 1) / 48).alias("tied"))
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tied")
    return s.select(*keys, "n", "w_plus", F.when(var > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var)).alias("z"))


def correlation(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """(keys, n, pearson, spearman, slope, intercept); null where x or y is constant."""
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("__x"), F.col(y).alias("__y"))
    rx = mid_ranks(r, keys, "__x")
    # the ranks of x join the rows; those of y needn't, as a value of y asks for the sum of its rows' ranks only
    both = _same(r, rx.select(*keys, "__x", F.col("off").alias("__off")), [*keys, "__x"])
    ry = mid_ranks(both, keys, "__y", __sum=F.sum("__off"))
    squares = F.sum(F.col("n") * F.col("off") * F.col("off"))
    ranks = _same(ry.groupBy(*keys).agg(F.sum(F.col("off") * F.col("__sum")).alias("__xy"), squares.alias("__yy")), rx.groupBy(*keys).agg(squares.alias("__xx")), keys)
    plain = r.groupBy(*keys).agg(
        F.count("*").alias("n"), F.try_divide(F.covar_pop("__x", "__y"), F.stddev_pop("__x") * F.stddev_pop("__y")).alias("pearson"), F.regr_slope("__y", "__x").alias("slope"), F.regr_intercept("__y", "__x").alias("intercept")
    )
    spearman = F.try_divide(F.col("__xy"), F.sqrt("__xx") * F.sqrt("__yy"))
    return _same(plain, ranks, keys).select(*keys, "n", "pearson", spearman.alias("spearman"), "slope", "intercept")


def best(df: DataFrame, keys: list[str], value: str, order: list[str], largest: bool = True) -> DataFrame:
    """The row of each group with the best value; ties: the first by ``order``."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w = w.orderBy(F.desc(value) if largest else F.asc(value), *order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def mode(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """The most frequent value of each group; ties: the smallest."""
    return best(df.groupBy(*keys, x).agg(F.count("*").alias("n")), keys, "n", [x])
