"""Statistics for research tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.scalars import correlation, ratio
from ..shipping import ship_package
from ..sources.sinks import settle
from .buckets import cells
from .evaluate import place, sharpe
from .quantiles import with_quantiles
from .reshape import to_wide

#: Groups whose sums a task holds at a time.
HELD = 256


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, least, largest, deviation, count, median per group."""
    out = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("largest"),
        F.stddev_samp(value).alias("std"), F.count(value).alias("n"),
    )
    out = with_quantiles(out, keys, value, [0.5], "__q", of=df)
    return out.select(*keys, "mean", "least", "largest", "std", "n", F.col("__q")[0].alias("median"))


def missing_rate(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Share of nulls per group and column, as rows."""
    rates = df.groupBy(*keys).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return rates.unpivot(keys, columns, "field", "missing")


def correlation_pairs(df: DataFrame, row: list[str], field: str = "field", value: str = "value", groups: list[str] | None = None) -> DataFrame:
    """(groups, a, b, corr, n) of each pair of fields a < b over the ``n`` rows that
    have both; null where one of them is constant there. A row has a field once.

    Rows are brought together once; tasks add up products under masks of what is
    known, so each pair counts its own rows, and pass one cell per pair on.
    """
    groups = groups or []
    means = df.filter(F.col(field).isNotNull()).groupBy(field).agg(F.avg(value).alias("m")).orderBy(field).collect()  # the fields
    fields, center = [r[field] for r in means], np.array([r["m"] or 0.0 for r in means])
    keys = [*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], *[F.col(r).alias(f"__r{i}") for i, r in enumerate(row)]]
    names, of = [f"__f{i}" for i in range(len(fields))], [f"__g{i}" for i in range(len(groups))]
    wide = to_wide(df.select(*keys, F.col(field).alias("__field"), F.col(value).cast("double").alias("__v")), [*of, *[f"__r{i}" for i in range(len(row))]], fields, "__field", "__v")
    wide = wide.toDF(*wide.columns[: len(groups) + len(row)], *names)
    sums = masked_moments(wide, of, names, center)
    table = df.sparkSession.createDataFrame(list(enumerate(fields)), StructType([StructField("i", IntegerType()), df.select(field).schema[0]])) if fields else None
    if table is None:
        return df.select(*groups, F.col(field).alias("a"), F.col(field).alias("b"), F.lit(0.0).alias("corr"), F.lit(0).cast("long").alias("n")).limit(0)
    a, b = table.toDF("i", "a"), table.toDF("j", "b")
    both = F.sqrt(spread("a", "aa") * spread("b", "bb"))
    corr = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("n") * F.col("ab") - F.col("a") * F.col("b")) / both))
    vary = (spread("a", "aa") > FLAT * F.col("n") * F.col("aa")) & (spread("b", "bb") > FLAT * F.col("n") * F.col("bb"))
    told = sums.select(*of, "i", "j", F.when(vary, corr).alias("corr"), F.col("n").cast("long").alias("n"))
    told = told.join(F.broadcast(a), "i").join(F.broadcast(b), "j")  # the fields
    return told.select(*[F.col(x).alias(g) for x, g in zip(of, groups)], "a", "b", "corr", "n")


#: Below this share of their squares values differ by rounding only.
FLAT = 1e-12


def spread(s: str, q: str) -> Column:
    return F.col("n") * F.col(q) - F.col(s) * F.col(s)


def masked_moments(wide: DataFrame, groups: list[str], fields: list[str], center: np.ndarray) -> DataFrame:
    """(groups, i, j, n, a, b, aa, bb, ab) for each pair of columns i < j: over the
    rows that have both, count, sums, squares and products, less ``center``."""
    ship_package(wide.sparkSession)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in wide.select(*groups).schema)
    cells = ["n", "a", "b", "aa", "bb", "ab"]
    left, right = np.triu_indices(len(fields), 1)

    def tables(sums: dict) -> pd.DataFrame:
        out = []
        for k, g in sums.items():
            n, a, aa, ab = g
            t = pd.DataFrame({"i": left, "j": right, "n": n[left, right], "a": a[left, right], "b": a[right, left], "aa": aa[left, right], "bb": aa[right, left], "ab": ab[left, right]})
            out.append(t[t["n"] > 0].assign(**dict(zip(groups, k)))[[*groups, "i", "j", *cells]])
        return pd.concat(out)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for f in frames:
            for k, part in f.groupby(groups, dropna=False) if groups else [((), f)]:
                x = part[fields].to_numpy(float) - center
                m = ~np.isnan(x)
                x, m = np.where(m, x, 0.0), m.astype(float)
                sums[k] = sums.get(k, 0.0) + np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
            if len(sums) > HELD:
                yield tables(sums)
                sums = {}
        if sums:
            yield tables(sums)

    rows = wide.select(*groups, *fields).mapInPandas(run, schema + "i int, j int, " + ", ".join(f"{c} double" for c in cells))
    return rows.groupBy(*groups, "i", "j").agg(*[F.sum(c).alias(c) for c in cells])


def strongest_partner(pairs: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """For each field the partner with the largest absolute correlation."""
    groups = groups or []
    swapped = pairs.select(*[F.col({"a": "b", "b": "a"}.get(c, c)).alias(c) for c in pairs.columns])
    both = pairs.unionByName(swapped)
    w = Window.partitionBy(*groups, "a").orderBy(F.abs("corr").desc_nulls_last(), "b")
    return both.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def grouped_correlation(df: DataFrame, keys: list[str], target: str, columns: list[str]) -> DataFrame:
    """Correlation of the target with each column per group, as rows; null where one
    of them is constant."""
    out = df.groupBy(*keys).agg(*[correlation(target, c).alias(c) for c in columns])
    return out.unpivot(keys, columns, "field", "corr")


def sharpe_by(df: DataFrame, keys: list[str], ret: str) -> DataFrame:
    return df.groupBy(*keys).agg(sharpe(ret).alias("sharpe"), F.count(ret).alias("n"))


def mean_over_years(df: DataFrame, keys: list[str], day: str, value: str, as_of: str, years: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Mean and mean absolute value over trailing windows of years."""
    recent = {n: F.col(day) >= F.add_months(F.lit(as_of).cast("date"), -12 * n) for n in years}
    return df.groupBy(*keys).agg(
        *[F.avg(F.when(c, F.col(value))).alias(f"mean_{n}y") for n, c in recent.items()],
        *[F.avg(F.when(c, F.abs(value))).alias(f"abs_{n}y") for n, c in recent.items()],
    )


def distribution(df: DataFrame, keys: list[str], value: str, threshold: float) -> DataFrame:
    """Box-plot numbers and the share above a threshold."""
    out = df.groupBy(*keys).agg(F.avg((F.col(value) > threshold).cast("double")).alias("share_above"))
    out = with_quantiles(out, keys, value, [0.0, 0.25, 0.5, 0.75, 1.0], "q", of=df)
    return out.select(*keys, *[F.col("q")[i].alias(n) for i, n in enumerate(("least", "q1", "median", "q3", "largest"))], "share_above")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per bin of equal width (0 and bins + 1 are outside)."""
    bin_ = F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins))
    return df.filter(F.col(value).isNotNull()).groupBy(bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def config_sensitivity(df: DataFrame, configs: list[str], metric: str) -> DataFrame:
    """Mean of a metric by each value of each configuration column."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("config"), F.col(c).cast("string").alias("setting")) for c in configs]))
    out = df.select(F.col(metric).alias("m"), rows.alias("c"))
    return out.groupBy("c.config", "c.setting").agg(F.avg("m").alias("mean"), F.count("m").alias("n"), F.avg((F.coalesce(F.col("m"), F.lit(0.0)) < 1e-5).cast("double")).alias("share_tiny"))


def best_trial(df: DataFrame, run: str, metric: str, trial: str) -> DataFrame:
    """The trial with the least metric of each run; ties to the smaller name."""
    best = F.min(F.struct(F.col(metric).alias("m"), F.col(trial).alias("t"))).alias("b")
    return df.groupBy(run).agg(best).select(run, F.col("b.t").alias(trial), F.col("b.m").alias(metric))


def confusion_score(df: DataFrame, pred: str, actual: str) -> DataFrame:
    """+1 where both are in the same outer tercile, -1 in opposite ones, else 0
    (columns hold 0, 1, 2)."""
    p, a = F.col(pred) - 1, F.col(actual) - 1
    return df.withColumn("confusion", (p * a).cast("int"))


def moving_average_rule(df: DataFrame, keys: list[str], day: str, value: str, lookbacks: list[int]) -> DataFrame:
    """Mean of value * sign(mean of the previous i) per lookback i."""
    span = lambda i: Window.partitionBy(*keys).orderBy(day).rowsBetween(-i, -1)
    gains = {i: F.when(F.count(value).over(span(i)) == i, F.col(value) * F.signum(F.avg(value).over(span(i)))) for i in lookbacks}
    out = df.select(*keys, *[g.alias(str(i)) for i, g in gains.items()])
    out = out.unpivot(keys, [str(i) for i in lookbacks], "lookback", "gain")
    return out.groupBy(*keys, F.col("lookback").cast("int").alias("lookback")).agg(F.avg("gain").alias("gain"))


def sign_backtest(df: DataFrame, keys: list[str], day: str, value: str, lookbacks: list[int]) -> DataFrame:
    """The sign of each value forecast by the mean of the values before it:
    accuracy, precision and recall of rises, the gap of mean values between
    forecast rises and falls, and the shares of rises, true and forecast."""
    w = Window.partitionBy(*keys).orderBy(day)
    means = []
    for n in lookbacks:
        before = w.rowsBetween(-n, -1)
        mean = F.when(F.count(value).over(before) == n, F.avg(value).over(before))
        means.append(F.struct(F.lit(n).alias("lookback"), mean.alias("mean")))
    rows = df.select(*keys, value, F.array(*means).alias("m")).select(*keys, value, F.explode("m").alias("x"))
    rows = rows.filter(F.col("x.mean").isNotNull() & F.col(value).isNotNull())
    p, a = F.col("x.mean") > 0, F.col(value) > 0
    share = lambda c: F.avg(c.cast("double"))
    n = lambda c: F.sum(c.cast("double"))
    return rows.groupBy(*keys, F.col("x.lookback").alias("lookback")).agg(
        share(p == a).alias("accuracy"),
        ratio(n(p & a), n(p)).alias("precision"),
        ratio(n(p & a), n(a)).alias("recall"),
        (F.avg(F.when(p, F.col(value))) - F.avg(F.when(~p, F.col(value)))).alias("avg_diff"),
        share(a).alias("actual_up"),
        share(p).alias("pred_up"),
    )


def best_lookback(gains: DataFrame, keys: list[str]) -> DataFrame:
    best = F.max(F.struct(F.col("gain"), (-F.col("lookback")).alias("l"))).alias("b")
    return gains.groupBy(*keys).agg(best).select(*keys, (-F.col("b.l")).alias("lookback"), F.col("b.gain").alias("gain"))


def threshold_rule_accuracy(df: DataFrame, feature: str, outcome: str, thresholds: list[float]) -> DataFrame:
    """How often "feature above t" equals the outcome, for each threshold."""
    tried = df.select(feature, outcome, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    right = ((F.col(feature) > F.col("threshold")) == F.col(outcome)).cast("double")
    return tried.groupBy("threshold").agg(F.avg(right).alias("accuracy"))


#: How a value is held against a threshold: above, below, or within a deviation of it.
PREDICATES = (">", "<", "~")


def nested_rule_accuracy(df: DataFrame, features: dict[str, list[tuple[float, float]]], best: str) -> DataFrame:
    """Accuracy of every rule "if x1 then x2 decides, else x3" against ``best``.

    ``features`` lists the (threshold, deviation) pairs of each; all three predicates
    of a rule are alike (``op``). ``best`` is 0 to 3: 1 for the first choice, 2 for
    the second, 3 for both. x1 decides the first choice and the others the second
    (``first`` is true), or the other way round. What isn't known meets no predicate.

    Rows are counted once, by the cells between the thresholds that they lie in for
    each pair of features; running sums over the cells tell how many rows meet any
    two predicates, and a rule joins two of these: no row meets the grid.
    Returns (op, first, x1, t1, x2, t2, x3, t3, accuracy).
    """
    ship_package(df.sparkSession)
    names = list(features)
    cuts = [sorted({c for t, d in features[f] for c in (t, t - d, t + d)}) for f in names]
    # odd cells are on a cut, even ones between; the last one is for what isn't known
    width = max(2 * len(c) + 2 for c in cuts)
    pairs = [(i, j) for i in range(len(names)) for j in range(len(names)) if i != j]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(pairs), width, width, 4), np.int64)
        for f in frames:
            cells = []
            for i, c in enumerate(cuts):
                x = f[f"x{i}"].to_numpy(float)
                below, upto = np.searchsorted(c, x, "left"), np.searchsorted(c, x, "right")
                cells.append(np.where(np.isnan(x), width - 1, below + upto))
            for k, (i, j) in enumerate(pairs):
                np.add.at(total[k], (cells[i], cells[j], f["best"].to_numpy(int)), 1)
        k, i, j, b = np.nonzero(total)
        yield pd.DataFrame({"pair": k, "i": i, "j": j, "b": b, "n": total[k, i, j, b]})

    columns = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(names)]
    known = df.filter(F.col(best).between(0, 3)).select(F.col(best).cast("int").alias("best"), *columns)
    counted = known.mapInPandas(count, "pair int, i int, j int, b int, n bigint").groupBy("pair", "i", "j", "b").agg(F.sum("n").alias("n"))

    def reach(f: int, op: str, t: float, d: float) -> tuple[int, int]:
        """The cells, from and before, whose values meet the predicate."""
        on = lambda v: 2 * cuts[f].index(v) + 1
        return {">": (on(t) + 1, 2 * len(cuts[f]) + 1), "<": (0, on(t)), "~": (on(t - d) + 1, on(t + d))}[op]

    def meet(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        i, j = pairs[key[0]]
        run = np.zeros((width + 1, width + 1, 4), np.int64)
        run[f["i"] + 1, f["j"] + 1, f["b"]] = f["n"]
        run = run.cumsum(axis=0).cumsum(axis=1)
        box = lambda a, b: run[a[1], b[1]] - run[a[0], b[1]] - run[a[1], b[0]] + run[a[0], b[0]]
        every, out = (0, width), []
        for op in PREDICATES:
            for t, d in features[names[i]]:
                for u, e in features[names[j]]:
                    p, q = reach(i, op, t, d), reach(j, op, u, e)
                    p, q = ((a, max(a, b)) for a, b in (p, q))
                    yes, yes_no = box(p, q), box(p, every) - box(p, q)
                    no_yes = box(every, q) - yes
                    no = box(every, every) - yes - yes_no - no_yes
                    out.append((op, names[i], t, names[j], u, *map(int, (yes[3], yes_no[1], yes_no[2], no_yes[1], no_yes[2], no[0], run[-1, -1].sum()))))
        return pd.DataFrame(out, columns=["op", "x", "t", "y", "u", "both", "one", "two", "not_one", "not_two", "none", "n"])

    schema = "op string, x string, t double, y string, u double, both bigint, one bigint, two bigint, not_one bigint, not_two bigint, none bigint, n bigint"
    met = settle(counted.groupBy("pair").applyInPandas(meet, schema), "rules")  # features x thresholds squared
    a = met.select("op", F.col("x").alias("x1"), F.col("t").alias("t1"), F.col("y").alias("x2"), F.col("u").alias("t2"), "both", "one", "two", "n")
    b = met.select("op", F.col("x").alias("x1"), F.col("t").alias("t1"), F.col("y").alias("x3"), F.col("u").alias("t3"), "not_one", "not_two", "none")
    rules = a.join(b, ["op", "x1", "t1"]).filter("x2 <> x3")
    right = lambda yes, no: (F.col("both") + F.col(yes) + F.col(no) + F.col("none")) / F.col("n")
    order = F.explode(F.array(F.struct(F.lit(True).alias("first"), right("one", "not_two").alias("accuracy")), F.struct(F.lit(False).alias("first"), right("two", "not_one").alias("accuracy"))))
    return rules.select("op", "x1", "t1", "x2", "t2", "x3", "t3", order.alias("r")).select("op", "r.first", "x1", "t1", "x2", "t2", "x3", "t3", "r.accuracy")


def change_report(current: DataFrame, history: DataFrame, key: str, score: str, day: str) -> DataFrame:
    """Current score less the last of history and less its mean."""
    past = history.groupBy(key).agg(F.max_by(score, day).alias("last"), F.avg(score).alias("usual"))
    out = current.join(past, key)
    return out.select(key, score, (F.col(score) - F.col("last")).alias("change"), (F.col(score) - F.col("usual")).alias("drift"))


def extremes(df: DataFrame, column: str, tie: str, n: int = 20) -> DataFrame:
    """The n largest and the n smallest known values (a report), by ``side``."""
    known = df.filter(F.col(column).isNotNull())
    top = known.orderBy(F.desc(column), tie).limit(n).withColumn("side", F.lit("largest"))
    return top.unionByName(known.orderBy(F.asc(column), tie).limit(n).withColumn("side", F.lit("smallest")))


def hit_rate(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Mean tercile label of rows (S) and of their sign-flipped twins (L)."""
    short = df.withColumn("side", F.lit("S"))
    long = df.withColumn(label, 2 - F.col(label)).withColumn("side", F.lit("L"))
    return short.unionByName(long).groupBy(*keys, "side").agg(F.avg(label).alias("rate"), F.count(label).alias("n"))


def return_mix(df: DataFrame, group: str, base: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns of each group beside those of the base group."""
    usd = df.filter(F.col(group) == base).select(*keys, *[F.col(c).alias(f"{c}_base") for c in columns])
    out = df.join(usd, keys)
    return out.select(group, *keys, *columns, *[(F.col(c) - F.col(f"{c}_base")).alias(f"{c}_spread") for c in columns])


def grid_backtest(df: DataFrame, group: list[str], config: list[str], period: str, metric: str, ret: str, lengths: list[int], shares: list[float]) -> DataFrame:
    """Mean return of the configurations in the top ``share`` by their mean
    metric of the previous n periods, for each n and share."""
    from .evaluate import past_mean

    past = df.withColumns({f"__{n}": past_mean(metric, [*group, *config], period, n) for n in lengths})
    long = past.unpivot([*group, *config, period, ret], [f"__{n}" for n in lengths], "n", "past").filter("past IS NOT NULL")
    ranked = long.withColumn("n", F.substring("n", 3, 9).cast("int"))
    w = Window.partitionBy(*group, period, "n")
    limits = F.percentile("past", F.array(*[F.lit(1 - s) for s in shares])).over(w)
    tried = ranked.withColumn("__l", limits).select("*", F.posexplode(F.array(*map(F.lit, shares))).alias("i", "share"))
    kept = tried.filter(F.col("past") >= F.element_at("__l", F.col("i") + 1))
    return kept.groupBy(*group, "n", "share").agg(F.avg(ret).alias("ret"), F.count(ret).alias("picks"))


def industry_table(df: DataFrame, industries: DataFrame, key: str, industry: str, columns: list[str]) -> DataFrame:
    return df.join(industries, key).groupBy(industry).agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("n"))


def relative(column: str, other: str):
    return ratio(F.col(column), F.col(other))


def expost_premium(df: DataFrame, keys: list[str], score: str, ret: str, share: float = 1 / 3) -> DataFrame:
    """Mean return of the upper less that of the lower tercile of a group, in
    hindsight; one shuffle by the group."""
    from .buckets import tercile

    cut = df.withColumn("__t", tercile(score, keys, share))
    mean = lambda t: F.avg(F.when(F.col("__t") == t, F.col(ret)))
    return cut.groupBy(*keys).agg((mean(2) - mean(0)).alias("premium"), F.count("*").alias("n"))


def error_statistics(df: DataFrame, keys: list[str], row: list[str], pred: str, actual: str, ranked: bool = False, tie: str | None = None) -> DataFrame:
    """Mean and median absolute error per group, of values or of their ranks
    within a row."""
    if ranked:
        number = lambda c: F.row_number().over(Window.partitionBy(*row).orderBy(c, *([tie] if tie else []))).cast("double")
        df = df.withColumns({pred: number(pred), actual: number(actual)})
    e = cells(df.select(*keys, F.abs(F.col(pred) - F.col(actual)).alias("__e")), keys, "__e")
    e = settle(e.withColumn("n", F.when(F.col("__e").isNotNull(), F.col("n")).otherwise(F.lit(0).cast("long"))), "errors")
    out = e.groupBy(*keys).agg(ratio(F.sum(F.col("__e") * F.col("n")), F.sum("n")).alias("mae"), F.sum("n").alias("n"))
    out = with_quantiles(out, keys, "__e", [0.5], "__q", of=e, count="n")
    return out.select(*keys, "mae", F.col("__q")[0].alias("median"), "n")


def reprice_picks(picks: DataFrame, returns: DataFrame, keys: list[str], tickers: str, ticker: str, day: str, ret: str) -> DataFrame:
    """Picks (a list of tickers per row) with the tickers' returns: mean,
    Sharpe ratio and count per group."""
    rows = picks.select(*keys, day, F.explode(tickers).alias(ticker)).join(returns.select(ticker, day, ret), [ticker, day])
    return rows.groupBy(*keys).agg(F.avg(ret).alias("ret"), sharpe(ret).alias("sharpe"), F.count(ret).alias("n"))


def pick_summary(df: DataFrame, keys: list[str], pivot: str, values: list, metric: str) -> DataFrame:
    """Mean of a metric per group, one column for each listed value."""
    return df.groupBy(*keys).pivot(pivot, values).agg(F.avg(metric))


def score_evaluation(df: DataFrame, keys: list[str], score: str, ret: str, n: int) -> DataFrame:
    """Mean return of the n best, the n worst and all rows of each group."""
    ranked = cells(df, keys, score, sum=ret).withColumns({"__top": place(keys, F.col(score).desc_nulls_last()), "__low": place(keys, F.col(score).asc_nulls_last())})
    mean = lambda c: ratio(*[F.sum(F.when(c, F.col(x))) for x in ("sum", "sum_n")])
    return ranked.groupBy(*keys).agg(mean(F.col("__top") <= n).alias("best"), mean(F.col("__low") <= n).alias("worst"), mean(F.lit(True)).alias("all"))
