"""Cost and report operators.

Reports are small by construction (a handful of rows), but their inputs are
the full result tables: every number is an aggregate computed on Spark.  Rule
tables are array literals applied to the single KPI row with ``filter`` +
``explode`` — narrow, no join at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K

TOTAL_LABEL = "TOTAL"


def cost_breakdown(costs: DataFrame, provider: str = "provider", cost: str = "cost",
                   infrastructure: float | None = K.INFRASTRUCTURE_COST_INR) -> DataFrame:
    """Sum per provider plus the grand total (``rollup``), with the fixed
    infrastructure line.  A provider appears only if it has cost rows."""
    c = costs.select(F.col(provider).alias("provider"), F.col(cost).cast("double").alias("cost"))
    if infrastructure is not None:
        infra = c.sparkSession.range(1).select(F.lit("infrastructure").alias("provider"),
                                               F.lit(float(infrastructure)).alias("cost"))
        c = c.unionByName(infra)
    g = c.rollup("provider").agg(F.sum("cost").alias("total_cost_inr"), F.grouping_id().alias("_gid"),
                                 F.count(F.lit(1)).cast("bigint").alias("items"))
    return g.select(F.when(F.col("_gid") == 1, F.lit(TOTAL_LABEL)).otherwise(F.col("provider")).alias("provider"),
                    "total_cost_inr", "items")


def cost_band(cost_per_query: Column) -> Column:
    return (F.when(cost_per_query < F.lit(K.COST_BAND_EXCELLENT_BELOW), F.lit("Excellent"))
            .when(cost_per_query < F.lit(K.COST_BAND_GOOD_BELOW), F.lit("Good"))
            .otherwise(F.lit("Needs optimization")))


def cost_kpis(breakdown: DataFrame, total_queries: DataFrame, budget: float = K.BUDGET_INR) -> DataFrame:
    """A08 from the A07 total row and a one-row query count.

    ``total_queries``: one row with column ``total_queries`` (a global count).
    The two one-row frames are combined by a union + aggregate, not a join.
    """
    tot = breakdown.where(F.col("provider") == TOTAL_LABEL).select(
        F.col("total_cost_inr").alias("t"), F.lit(None).cast("bigint").alias("q"))
    q = total_queries.select(F.lit(None).cast("double").alias("t"), F.col("total_queries").cast("bigint").alias("q"))
    one = tot.unionByName(q).agg(F.coalesce(F.max("t"), F.lit(0.0)).alias("total_cost_inr"),
                                 F.coalesce(F.max("q"), F.lit(0)).cast("bigint").alias("total_queries"))
    cpq = F.when(F.col("total_queries") > 0, F.col("total_cost_inr") / F.col("total_queries").cast("double")) \
        .otherwise(F.lit(0.0))
    return one.select("total_cost_inr", "total_queries", cpq.alias("cost_per_query"),
                      (F.col("total_cost_inr") / F.lit(float(budget)) * F.lit(100.0)).alias("budget_utilization"),
                      cost_band(cpq).alias("cost_efficiency"))


def kpis_of(breakdown: DataFrame, budget: float = K.BUDGET_INR, infrastructure: bool = True) -> DataFrame:
    """A08 from the A07 rows alone: the total row counts its items, of which the
    infrastructure line is none of the queries.  The costs are evaluated once."""
    one = breakdown.where(F.col("provider") == TOTAL_LABEL).select("total_cost_inr", (F.col("items") - int(infrastructure)).alias("total_queries"))
    one = one.agg(F.coalesce(F.max("total_cost_inr"), F.lit(0.0)).alias("total_cost_inr"), F.coalesce(F.max("total_queries"), F.lit(0)).cast("bigint").alias("total_queries"))
    per = F.when(F.col("total_queries") > 0, F.col("total_cost_inr") / F.col("total_queries").cast("double")).otherwise(F.lit(0.0))
    return one.select("total_cost_inr", "total_queries", per.alias("cost_per_query"),
                      (F.col("total_cost_inr") / F.lit(float(budget)) * F.lit(100.0)).alias("budget_utilization"), cost_band(per).alias("cost_efficiency"))


def _rec(i: int, cat: str, prio: str, text: str, note: str) -> Column:
    return F.struct(F.lit(i).alias("ord"), F.lit(cat).alias("category"), F.lit(prio).alias("priority"),
                    F.lit(text).alias("recommendation"), F.lit(note).alias("note"))


def recommendations(kpis: DataFrame) -> DataFrame:
    """X04 over one KPI row with ``total_cost_inr``, ``avg_chat_confidence``
    (NULL -> 0, so the confidence rule also fires with no chat rows) and
    ``avg_processing_time`` (NULL when there are no document rows: the rule
    does not fire).  Three fixed rows follow; ``ord`` keeps the order."""
    conf = F.coalesce(F.col("avg_chat_confidence"), F.lit(0.0))
    cond = [F.col("total_cost_inr") > F.lit(K.RECOMMEND_COST_OVER),
            conf < F.lit(K.RECOMMEND_CONFIDENCE_BELOW),
            F.coalesce(F.col("avg_processing_time") > F.lit(K.RECOMMEND_PROCESSING_OVER), F.lit(False))]
    items = []
    for i, (rec, c) in enumerate(zip(K.RULE_RECOMMENDATIONS, cond)):
        items.append(F.when(c, _rec(i, *rec)))
    n = len(items)
    for j, rec in enumerate(K.FIXED_RECOMMENDATIONS):
        items.append(_rec(n + j, *rec))
    arr = F.filter(F.array(*items), lambda x: x.isNotNull())
    return kpis.select(F.explode(arr).alias("r")).select(
        F.col("r.ord").cast("bigint").alias("ord"), "r.category", "r.priority", "r.recommendation", "r.note")


def section_rows(df: DataFrame, section: str, prefix: str | None = None) -> DataFrame:
    """(section, metric, value_num, value_text) of a small frame: one row per
    column, in one pass.  ``prefix``: a column whose value leads the metric name,
    for frames of several rows."""
    lead = F.concat(F.col(prefix).cast("string"), F.lit(".")) if prefix else F.lit("")
    items = [F.struct(F.concat(lead, F.lit(c)).alias("metric"),
                      (F.lit(None) if t == "string" else F.col(c)).cast("double").alias("value_num"),
                      (F.col(c) if t == "string" else F.lit(None)).cast("string").alias("value_text"))
             for c, t in df.dtypes if c != prefix]
    return df.select(F.explode(F.array(*items)).alias("r")).select(F.lit(section).alias("section"), "r.*")


def samples(df: DataFrame, section: str, order, text: str = "sample", limits: dict = K.REPORT_SAMPLES) -> DataFrame:
    """(section, place, sample): the first rows of a frame in a stated
    order, as many as ``limits`` has for the section.  A limit behind an order keeps so many rows per task, then of all."""
    if section not in limits:
        raise ValueError(f"no number of samples is stated for {section}")
    first = df.orderBy(*order).limit(int(limits[section]))
    place = F.row_number().over(Window.orderBy(*order)).cast("bigint")  # the shown rows only
    return first.select(F.lit(section).alias("section"), place.alias("place"), F.col(text).alias("sample"))


def run_phases(phases: dict, spark) -> DataFrame:
    """Run the phases in order, each on its own.  A phase is a function
    that returns its section rows (a few, by nature: aggregates); a phase that
    fails becomes an ``error`` row and the next one still runs."""
    rows = []
    for name, phase in phases.items():
        try:
            rows += [(name, r.metric, r.value_num, r.value_text) for r in phase().collect()]
        except Exception as e:  # noqa: BLE001 - recorded, as the guards of the phases do
            rows.append((name, "error", None, str(e).splitlines()[0][:200]))
    return spark.createDataFrame(rows, "section string, metric string, value_num double, value_text string")


def report_document(rows: DataFrame) -> DataFrame:
    """The report as one nested document, ``{section: {metric: value}}``, in
    one JSON text; a report has a few rows per section."""
    value = F.coalesce("value_text", F.col("value_num").cast("string"))
    section = rows.groupBy("section").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", value)))).alias("m"))
    return section.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("section", "m")))).alias("report"))


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> str:
    """The report as JSON lines; one document row via ``to_json`` when
    ``report`` has a single struct column, else one line per row."""
    report.coalesce(1).write.mode(mode).json(path)
    return path


def combine_rows(*frames: DataFrame) -> DataFrame:
    """Merge one-row frames with disjoint columns into one row, by a union and
    a global aggregate (no join)."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.agg(*[F.max(c).alias(c) for c in u.columns])
