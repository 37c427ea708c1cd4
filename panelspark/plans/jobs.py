"""Ratio, premium, selection and scoring jobs, each one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formula import Formula, apply_formulas
from ..functions.scalars import ratio, zero_to_null
from ..operators.buckets import day_cells, premium_buckets, premium_of_cells, quantile_premium
from ..operators.calendar import as_of, forward_return, over, past_return, run_days
from ..operators.clean import winsorize
from ..operators.evaluate import combine_pillars, good_and_bad, group_summary, one_per_subpillar, portfolio_stats, top_configs, vote
from ..operators.reshape import to_long
from ..operators.scores import fundamental_score

# fixed values: horizons, lags and names that results are known by
#: Weeks ahead of each label, with the days that its levels are averaged over.
LABELS = {2: [-7], 4: [-7], 8: [-7], 26: [-7, -28], 52: [-7, -28]}
#: Past returns: (recent lag, old lag) in weeks.
PAST = {"ww1_0": (0, 1), "ww2_1": (1, 2), "ww4_2": (2, 4), "r1_0": (0, 4), "r6_2": (8, 26), "r12_7": (30, 52)}


EVENT, LEAVE, SUNDAY = 0, 1, 2
#: Columns that the next days carry on.
CARRIED = ("market_cap", "tri", "close", "volume")


def week_points(daily: DataFrame, key: str, day: str, days: DataFrame | None = None) -> DataFrame:
    """The rows of ``daily``, a mark a week after each, and every key's Sundays over
    the days of all (one more at the end), with those days (a, b), which are the first
    and last of ``days``, if it's told; ``kind`` orders them within a day. A key's first
    row makes its Sundays, so ``daily`` is read once."""
    span = (daily if days is None else days).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    values = [c for c in daily.columns if c not in (key, day)]
    df = daily.withColumn("__rn", F.row_number().over(over([key], day))).join(F.broadcast(span))  # one row of dates
    first = F.date_add("a", (8 - F.dayofweek("a")) % 7)
    count = F.floor(F.date_diff(F.date_add("b", 1), first) / 7).cast("int")
    mark = lambda d, kind: F.struct(d.alias("day"), F.lit(kind).alias("kind"))
    sundays = F.transform(F.sequence(F.lit(0), count), lambda i: mark(F.date_add(first, i * 7), SUNDAY))
    marks = F.array(mark(F.col(day), EVENT), mark(F.date_add(day, 7), LEAVE))
    marks = F.when((F.col("__rn") == 1) & (first <= F.date_add("b", 1)), F.concat(marks, sundays)).otherwise(marks)
    df = df.withColumn("__m", F.explode(marks))
    own = [F.when(F.col("__m.kind") == EVENT, F.col(c)).alias(c) for c in values]
    return df.select(key, F.col("__m.day").alias(day), *own, F.col("__m.kind").alias("kind"), "a", "b")


def price_features(daily: DataFrame, key: str = "ticker", day: str = "trading_day", days: DataFrame | None = None) -> DataFrame:
    """Weekly rows (Sundays) with volatility, skewness, volume ratio, labels and past
    returns, of daily tri, open, high, low, close, volume, market_cap.

    No row is made for a day without one: a value holds until the next row, so the
    sum over days up to a Sunday is one of values times lengths, and the mean of any
    number of weeks is the difference of two such sums. Windows over what happened
    within days look back by the day, over the rows alone that have a term of theirs and
    the Sundays. One exchange by key, none if the rows lie by it; ``days`` as in
    ``week_points``.
    """
    values = [c for c in daily.columns if c not in (key, day)]
    df = daily.withColumns({c: zero_to_null(F.col(c)) for c in ("tri", "open", "high", "low", "close")})
    df = week_points(df, key, day, days).withColumn("__day", F.unix_date(day))
    w = Window.partitionBy(key).orderBy("__day", "kind")
    before, upto, all_ = (w.rowsBetween(Window.unboundedPreceding, n) for n in (-1, 0, Window.unboundedFollowing))
    within = lambda n: Window.partitionBy(key).orderBy("__day").rangeBetween(-(n - 1), 0)
    event = F.col("kind") == EVENT
    df = df.withColumns({
        "__last": F.last(F.when(event, F.struct("__day", *values)), ignorenulls=True).over(before),
        "__length": F.coalesce(F.lead("__day").over(w) - F.col("__day"), F.lit(0)),
        "__end": F.last("tri", ignorenulls=True).over(all_),
        **{f"__{c}": F.last(c, ignorenulls=True).over(upto) for c in CARRIED},
    })
    ln = lambda x, y: F.ln(ratio(F.col(x), F.col(y)))
    yesterday = event & (F.col("__last.__day") == F.col("__day") - 1)
    df = df.withColumns({
        "__r": F.when(yesterday, ratio(F.col("tri"), F.col("__last.tri")) - 1),
        "__term": ln("high", "close") * ln("high", "open") + ln("low", "close") * ln("low", "open"),
        "__short": F.avg("volume").over(within(7)),
    })
    df = df.withColumns({
        **{f"__s_{c}": F.coalesce(F.sum(F.col(f"__{c}") * F.col("__length")).over(before), F.lit(0.0)) for c in ("short", "tri")},
        **{f"__c_{c}": F.coalesce(F.sum(F.when(F.col(f"__{c}").isNotNull(), F.col("__length"))).over(before), F.lit(0)) for c in ("short", "tri")},
    })
    sunday = F.col("kind") == SUNDAY
    df = df.filter(sunday | F.col("__r").isNotNull() | F.col("__term").isNotNull()).withColumn("__vol", F.avg("__term").over(within(30)))
    df = df.filter(sunday | F.col("__r").isNotNull())  # a frame is gone through for each row that has one
    df = df.withColumns({"__n": F.count("__r").over(within(365)), "__skew": F.skewness("__r").over(within(365))}).filter(sunday)
    # weekly rows: sums up to the day before, and with the day; they are in order
    v = over([key], "__day")

    def through(c: str) -> tuple:
        known = F.col(f"__{c}").isNotNull().cast("int")
        return F.col(f"__s_{c}") + F.coalesce(F.col(f"__{c}"), F.lit(0.0)), F.col(f"__c_{c}") + known

    def behind(c: str, weeks: int):
        s, count = through(c)
        back = lambda x: x - F.coalesce(F.lag(x, weeks).over(v), F.lit(0))
        return ratio(back(s), back(count))

    def ahead(c: str, weeks: int):
        more = lambda x: F.lead(x, weeks).over(v) - F.col(x)
        return F.when(F.date_add(day, 7 * weeks - 1) <= F.col("b"), ratio(more(f"__s_{c}"), more(f"__c_{c}")))

    since = F.date_diff(day, "a")
    skew = F.when((F.col("__n") >= 3) & (since >= 364), F.col("__skew") * F.sqrt(F.col("__n") * (F.col("__n") - 1)) / (F.col("__n") - 2))
    today = lambda c: F.when(F.col("__last.__day") == F.col("__day"), F.col(f"__last.{c}"))
    df = df.select(
        key, day, "__day", "b", *[(F.col(f"__{c}") if c in CARRIED else today(c)).alias(c) for c in values if c != "market_cap"],
        (ratio(F.col("__market_cap"), F.col("__end")) * F.col("__tri")).alias("market_cap"),
        skew.alias("skew"), F.when(since >= 29, F.sqrt(F.col("__vol") * 256)).alias("volatility"),
        ratio(F.col("__short"), behind("short", 13)).alias("volume_ratio"),
        behind("tri", 1).alias("tri_avg_7"), ahead("tri", 1).alias("tri_avg_m7"), ahead("tri", 4).alias("tri_avg_m28"),
    )
    df = df.filter(F.col(day) <= F.col("b")).drop("b")
    labels = {f"stock_return_y_w{w}_d{d}": forward_return(f"tri_avg_m{-d}", [key], "__day", w) for w, days in LABELS.items() for d in days}
    past = {f"stock_return_{n}": past_return("tri_avg_7", [key], "__day", a, b) for n, (a, b) in PAST.items()}
    return df.withColumns({**labels, **past}).drop("__day")


def merge_statements(prices: DataFrame, *statements: DataFrame, key: str = "ticker", day: str = "trading_day") -> DataFrame:
    """Price rows with the last known statement values, by column; names that
    prices have already get a suffix."""
    events, columns = None, []
    for i, s in enumerate(statements):
        names = [c for c in s.columns if c not in (key, day)]
        s = s.withColumnsRenamed({c: f"{c}_{i}" for c in names if c in prices.columns or c in columns})
        columns += [c for c in s.columns if c not in (key, day)]
        events = s if events is None else events.unionByName(s, allowMissingColumns=True)
    known = as_of(prices.select(key, day), events, [key], day, columns)
    return prices.join(known, [key, day], "left")


def ratio_job(panel: DataFrame, formulas: list[Formula], key: str = "ticker", day: str = "trading_day") -> DataFrame:
    """Long ratios (key, day, field, value) of a weekly panel."""
    wide = apply_formulas(panel, formulas, over([key], day), [key, day])
    return to_long(wide, [key, day], [f.name for f in formulas if f.name in wide.columns])


def premium_job(panel: DataFrame, group: str, day: str, factors: list[str], labels: list[str], trim: float | None = None, step: int | None = None) -> DataFrame:
    """Premiums of all factors and labels at once: both are unpivoted, and one
    aggregate by (group, day, factor, label) does the rest. With ``step`` the rows are
    runs of days (from, to), so many apart, and are counted before days are made and
    unpivoted after they have moved."""
    if step is not None and trim is None:
        known = panel.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in [*factors, *labels]})
        days = day_cells(known, [group], day, factors, step, **{f"__y{i}": c for i, c in enumerate(labels)})
        ys = F.array(*[F.struct(F.lit(c).alias("y"), F.col(f"__y{i}").alias("sum"), F.col(f"__y{i}_n").alias("n")) for i, c in enumerate(labels)])
        fs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("factor")) for c in factors])
        long = days.select(group, day, ys.alias("__y"), F.explode(fs).alias("__f")).filter("__f.factor IS NOT NULL")
        long = long.select(group, day, "__f.*", F.explode("__y").alias("__y")).select(group, day, "field", "factor", "__y.*").filter("n > 0")
        keys = [day, group, "field", "y"]  # the day first, as numbers sort faster than names
        return premium_of_cells(premium_buckets(long, keys, "factor", count="n"), keys).select(group, day, "field", "y", "value", "n")
    if step is not None:
        panel = run_days(panel, day, step)
    long = panel.unpivot([group, day, *labels], factors, "field", "factor")
    long = long.unpivot([group, day, "field", "factor"], labels, "y", "label")
    keys = [group, day, "field", "y"]
    if trim is not None:
        long = winsorize(winsorize(long, keys, "factor", trim), keys, "label", trim)
        long = long.withColumn("field", F.concat(F.lit("trim_"), F.col("field")))
    return quantile_premium(long, keys)


def evaluation_job(predictions: DataFrame, config: list[str], share: float = 0.33) -> DataFrame:
    """Per configuration: good and bad factors, their returns, accuracy."""
    marked = good_and_bad(predictions, config, share=share)
    return group_summary(predictions, one_per_subpillar(marked, config), config)


def selection_job(evaluated: DataFrame, group: list[str], config: list[str], period: str, metric: str, n: int, share: float) -> tuple[DataFrame, DataFrame]:
    """Votes for (max, min) factors of the best configurations per group and
    period."""
    merged = combine_pillars(evaluated, [*group, *config, period])
    best = top_configs(merged, group, config, period, metric, n, share)
    return vote(best, [*group, period], "max_factor"), vote(best, [*group, period], "min_factor")


def score_job(ratios: DataFrame, reversed_fields: list[str], group: str = "currency_code", day: str = "trading_day") -> DataFrame:
    """Scores 0..10 of long ratios; reversed factors are turned first."""
    sign = F.when(F.col("field").isin(reversed_fields), -F.col("value")).otherwise(F.col("value"))
    return fundamental_score(ratios.withColumn("value", sign), [group, day, "field"])


def portfolio_job(scored: DataFrame, keys: list[str], sizes: tuple[int, ...] = (-10, -50, 50, 10, 3), **columns: str) -> DataFrame:
    return portfolio_stats(scored, keys, list(sizes), **columns)


def last_weeks(df: DataFrame, key: str, day: str, level: str) -> DataFrame:
    """The returns of the last four weeks on daily rows, one row per key."""
    w = over([key], day)
    out = df.withColumns({f"w{i}": F.try_divide(F.lag(level, 7 * (i - 1)).over(w), F.nullif(F.lag(level, 7 * i).over(w), F.lit(0.0))) - 1 for i in range(1, 5)})
    last = Window.partitionBy(key).orderBy(F.col(day).desc())
    return out.withColumn("__rn", F.row_number().over(last)).filter("__rn = 1").select(key, day, *[f"w{i}" for i in range(1, 5)])
