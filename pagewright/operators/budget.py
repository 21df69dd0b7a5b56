"""Budget crossings (W06, T03) by hierarchical prefix sums.

A month is a tree of two levels: month -> hour -> rows.  One aggregation makes
exact decimal sums per hour; a running sum over the few hundred hours of a
month gives the spend before each hour.  From it follows, per rule, whether an
hour *can* hold the first crossing (spend before plus all positive costs of the
hour, over the smallest elapsed share for forecasts) and whether one *surely*
has happened by its end.  Only hours that can hold it, up to the first sure
one, are opened: their rows alone are sorted for exact running sums.  All other
rows are summed and never sorted, moved or checkpointed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .ordering import running_sum

#: Slack of the two bounds: a double comparison may differ from the decimal one in the last places.
SLACK = 1e-9
LEAST_SHARE = 1e-9


def rules_of(actual, forecast, monthly_budget: float) -> list[tuple[str, float, float]]:
    """(kind, threshold, spend limit) of every rule."""
    return [(kind, float(t), float(t) * float(monthly_budget)) for kind, ts in (("actual", actual), ("forecast", forecast)) for t in ts]


def prepared(costs: DataFrame, ts: str, cost: str, tiebreak: str) -> DataFrame:
    """Rows without a time or a cost don't count."""
    known = costs.where(F.col(ts).isNotNull() & F.col(cost).isNotNull())
    return known.select(F.col(ts).alias("ts"), F.col(tiebreak).alias("id"), F.col(cost).cast("decimal(28,10)").alias("cost"),
                        F.date_trunc("month", F.col(ts)).alias("month"), F.date_trunc("hour", F.col(ts)).alias("hour"))


def hour_sums(base: DataFrame, by=("month", "hour")) -> DataFrame:
    """Level 1 of the tree: spend and positive spend per hour."""
    return base.groupBy(*by).agg(F.sum("cost").alias("s"), F.sum(F.greatest(F.col("cost"), F.lit(0).cast("decimal(28,10)"))).alias("p"))


def elapsed_share(month: Column, at: Column) -> Column:
    """Share of the month that has passed at a time."""
    whole = F.unix_timestamp(F.add_months(month, 1)) - F.unix_timestamp(month)
    passed = (F.unix_micros(at) - F.unix_micros(month)).cast("double") / F.lit(1e6)
    return F.greatest(passed / whole.cast("double"), F.lit(LEAST_SHARE))


def bounds(kind: str, before: Column, s: Column, p: Column, month: Column, hour: Column) -> tuple[Column, Column]:
    """(largest value the rule's quantity can take in the hour, value it has
    passed by the hour's end at least)."""
    upper, sure = (before + p).cast("double"), (before + s).cast("double")
    if kind == "forecast":
        end = hour + F.make_dt_interval(hours=F.lit(1))
        upper = upper / F.when(upper > 0, elapsed_share(month, hour)).otherwise(elapsed_share(month, end))
        sure = sure / F.when(sure > 0, elapsed_share(month, end)).otherwise(elapsed_share(month, hour))
    pad = lambda x: F.abs(x) * F.lit(SLACK) + F.lit(SLACK)
    return upper + pad(upper), sure - pad(sure)


def open_hours(sums: DataFrame, rules) -> DataFrame:
    """(month, hour, s, before): hours that can hold a rule's first crossing."""
    past = Window.partitionBy("month").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)  # at most 744 rows a month
    h = sums.withColumn("before", F.coalesce(F.sum("s").over(past), F.lit(0)).cast("decimal(38,10)"))
    wanted = []
    for i, (kind, _, limit) in enumerate(rules):
        upper, sure = bounds(kind, F.col("before"), F.col("s"), F.col("p"), F.col("month"), F.col("hour"))
        h = h.withColumn(f"_may{i}", upper > limit).withColumn(f"_sure{i}", sure > limit)
        wanted.append(f"_may{i} and not coalesce(_done{i}, false)")
    h = h.withColumns({f"_done{i}": F.bool_or(f"_sure{i}").over(past) for i in range(len(rules))})
    return h.where(F.expr(" or ".join(f"({w})" for w in wanted))).select("month", "hour", "s", "before")


def spend_in(rows: DataFrame, opened: DataFrame) -> DataFrame:
    """Exact month-to-date spend and forecast at every row of the opened hours."""
    w = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)  # opened hours only
    shift = opened.select("hour", (F.col("before") - F.coalesce(F.sum("s").over(w), F.lit(0))).alias("_shift"))
    mine = rows.join(shift.select("hour"), "hour", "left_semi")
    run = running_sum(mine, ["ts", "id"], "cost", "_run").join(F.broadcast(shift), "hour")
    at = run.withColumn("month_to_date", (F.col("_run") + F.col("_shift")).cast("double"))
    return at.withColumn("forecast_spend", F.col("month_to_date") / elapsed_share(F.col("month"), F.col("ts")))


def first_rows(at: DataFrame, rules, strict: bool = True) -> DataFrame:
    """(month, kind, threshold, crossed_at, event_id, month_to_date,
    compared_value) of each month's first row past each rule: one pass, a
    ``min_by`` per rule whose ordering is null on rows that do not pass it."""
    row = F.struct("ts", "id", "month_to_date", "forecast_spend")
    value = {"actual": "month_to_date", "forecast": "forecast_spend"}
    past = lambda c, limit: c > limit if strict else c >= limit
    found = at.groupBy("month").agg(*[F.min_by(row, F.when(past(F.col(value[kind]), limit), F.struct("ts", "id"))).alias(f"_h{i}")
                                      for i, (kind, _, limit) in enumerate(rules)])
    hits = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(thr).alias("threshold"), F.col(f"_h{i}.ts").alias("crossed_at"),
                              F.col(f"_h{i}.id").alias("event_id"), F.col(f"_h{i}.month_to_date").alias("month_to_date"),
                              F.col(f"_h{i}.{value[kind]}").alias("compared_value")) for i, (kind, thr, _) in enumerate(rules)])
    return found.select("month", F.explode(hits).alias("h")).where(F.col("h.crossed_at").isNotNull()).select("month", "h.*")


def budget_crossings(costs: DataFrame, monthly_budget: float, ts: str = "ts", cost: str = "cost", tiebreak: str = "event_id",
                     actual=K.BUDGET_ACTUAL_THRESHOLDS, forecast=K.BUDGET_FORECAST_THRESHOLDS, strict: bool = True) -> DataFrame:
    """First row of each month whose running spend passes a share of
    the monthly budget ('actual'), or whose forecast does ('forecast': spend /
    elapsed share of the month).  Strict ``>`` by default.  Sums are decimal."""
    rules = rules_of(actual, forecast, monthly_budget)
    base = prepared(costs, ts, cost, tiebreak)
    opened = open_hours(hour_sums(base), rules if strict else [(k, t, limit - SLACK * (abs(limit) + 1)) for k, t, limit in rules])
    return first_rows(spend_in(base, opened), rules, strict)
