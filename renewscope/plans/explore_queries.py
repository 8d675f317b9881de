"""Descriptive queries over the labelled events and their features."""

from pyspark.sql import functions as F

from renewscope.config import MODEL_CLASSES, ORDERS_STUDY
from renewscope.functions.scalar import clip, finite
from renewscope.operators import explore as X
from renewscope.operators.cohort import distinct_transactions
from renewscope.operators.labels import core
from renewscope.operators.members import with_demographics
from renewscope.operators.panel import daily_panel
from renewscope.operators.quantiles import exact_quantiles, quantile_columns
from renewscope.operators.usage import usage_near
from renewscope.plans.catalog import query
from renewscope.plans.labelled import labelled_events
from renewscope.session import through_table

_RATES = ("pre_rate", "post_rate", "vol_ratio")


@query("missing_fraction_by_class", "label feature missing:f", " UNION ALL ".join(
    f"SELECT * FROM (SELECT label, '{c}' AS feature, avg(CAST({c} IS NULL AS INT)) AS missing FROM ev GROUP BY 1) "
    f"WHERE (SELECT count(*) FROM ev WHERE {c} IS NULL) > 0"
    for c in (*_RATES, "obs_secs_per_active_day", "first_renewal_date", "renewed")))
def missing_fraction_by_class(inp):
    cols = [*_RATES, "obs_secs_per_active_day", "first_renewal_date", "renewed"]
    return X.missing_fractions(labelled_events(inp), "label", cols).withColumnRenamed("column", "feature")


@query("describe_usage", "feature count:i mean:g std:g min:g q25:g q50:g q75:g max:g", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, "
    f"quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, "
    f"max({c}) AS max FROM ev" for c in ("pre_n_days", "post_n_days", *_RATES)))
def describe_usage(inp):
    return X.describe_exact(labelled_events(inp), ["pre_n_days", "post_n_days", *_RATES]).withColumnRenamed(
        "column", "feature")


@query("class_means", "label mean_pre_rate:g mean_vol_ratio:f mean_renewed:f",
       "SELECT label, avg(pre_rate) AS mean_pre_rate, avg(vol_ratio) AS mean_vol_ratio, avg(renewed) AS mean_renewed "
       "FROM core GROUP BY 1")
def class_means(inp):
    return X.grouped_means(core(labelled_events(inp)), "label", ["pre_rate", "vol_ratio", "renewed"])


@query("class_medians", "label feature median:f", " UNION ALL ".join(
    f"SELECT label, '{c}' AS feature, median({c}) AS median FROM core GROUP BY 1 HAVING median({c}) IS NOT NULL"
    for c in ("obs_secs_per_active_day", "recent_vs_life_ratio", "h30_rate")))
def class_medians(inp):
    cols = ["obs_secs_per_active_day", "recent_vs_life_ratio", "h30_rate"]
    return X.grouped_medians(core(labelled_events(inp)), "label", cols).withColumnRenamed("column", "feature")


@query("below_99th_percentile", "msno E:d vol_ratio:f",
       "SELECT msno, E, vol_ratio FROM ev WHERE vol_ratio < (SELECT quantile_cont(vol_ratio, 0.99) FROM ev)")
def below_99th_percentile(inp):
    events = labelled_events(inp).select("msno", "E", "vol_ratio")
    return X.below_quantile(through_table(events, "ratios"), "vol_ratio", 0.99)


@query("price_quantiles_by_method", "payment_method_id:i prob:f quantile:g n:i", """
SELECT payment_method_id, prob, quantile, n FROM (
  SELECT payment_method_id, count(*) AS n, unnest([0.05, 0.5, 0.95]) AS prob,
    unnest([quantile_cont(plan_list_price, 0.05), quantile_cont(plan_list_price, 0.5),
            quantile_cont(plan_list_price, 0.95)]) AS quantile FROM txn GROUP BY 1)""")
def price_quantiles_by_method(inp):
    return exact_quantiles(distinct_transactions(inp.transactions), ["payment_method_id"], "plan_list_price",
                           [0.05, 0.5, 0.95])


@query("distinct_totals", "n_rows:i n_msno:i n_expiry_month:i n_keys:i",
       "SELECT count(*) AS n_rows, count(DISTINCT msno) AS n_msno, count(DISTINCT expiry_month) AS n_expiry_month, "
       "count(DISTINCT (msno, E)) AS n_keys FROM cohort")
def distinct_totals(inp):
    from renewscope.operators.cohort import expiry_events

    events = expiry_events(distinct_transactions(inp.transactions), inp.cfg)
    return X.distinct_totals(events, ["msno", "expiry_month"], ["msno", "E"])


@query("events_per_user", "mean_events:f max_events:i n_users:i",
       "SELECT avg(n) AS mean_events, max(n) AS max_events, count(*) AS n_users FROM "
       "(SELECT msno, count(*) AS n FROM cohort GROUP BY 1)")
def events_per_user(inp):
    from renewscope.operators.cohort import expiry_events

    return X.events_per_user(expiry_events(distinct_transactions(inp.transactions), inp.cfg))


@query("ratio_histogram_by_class", "label bin:i n:i left_edge:f", """
SELECT label, CAST(least(floor(least(greatest(vol_ratio, 0), 5) / (5.0 / 60)), 59) AS INT) AS bin, count(*) AS n,
  CAST(least(floor(least(greatest(vol_ratio, 0), 5) / (5.0 / 60)), 59) AS INT) * (5.0 / 60) AS left_edge
FROM core WHERE vol_ratio IS NOT NULL GROUP BY 1, 2, 4""".replace("5.0 / 60", "CAST(5 AS DOUBLE) / 60"))
def ratio_histogram_by_class(inp):
    return X.histogram(core(labelled_events(inp)), "vol_ratio", 0.0, 5.0, 60, ["label"], clip_values=True).withColumnRenamed(
        "left", "left_edge")


@query("active_days_histogram", "bin:i n:i",
       f"SELECT CAST(post_n_days - 1 AS INT) AS bin, count(*) AS n FROM ev WHERE post_n_days BETWEEN 1 AND {ORDERS_STUDY.window_days} GROUP BY 1")
def active_days_histogram(inp):
    days = inp.cfg.window_days
    return X.histogram(labelled_events(inp), "post_n_days", 1, days + 1, days)


@query("box_statistics_by_class", "label q1:g median:g q3:g whisker_low:g whisker_high:g", """
SELECT label, min(q1) AS q1, min(q2) AS median, min(q3) AS q3,
  min(pre_rate) FILTER (WHERE pre_rate BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(pre_rate) FILTER (WHERE pre_rate BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high
FROM core JOIN (SELECT label, quantile_cont(pre_rate, 0.25) AS q1, quantile_cont(pre_rate, 0.5) AS q2,
  quantile_cont(pre_rate, 0.75) AS q3 FROM core GROUP BY 1) q USING (label) GROUP BY 1""")
def box_statistics_by_class(inp):
    events = core(labelled_events(inp)).select("label", "pre_rate")
    return X.box_statistics(through_table(events, "rates"), "label", "pre_rate")


_RANKED = ["pre_rate", "post_rate", "vol_ratio", "pre_n_days", "h30_rate"]


def _rank(c):
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"


@query("spearman_correlation", "a b rho:f", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS rho FROM (SELECT {', '.join(_rank(c) for c in _RANKED)} "
    f"FROM core WHERE {' AND '.join(c + ' IS NOT NULL' for c in _RANKED)})"
    for i, a in enumerate(_RANKED) for b in _RANKED[i:]))
def spearman_correlation(inp):
    events = core(labelled_events(inp)).select("msno", "E", *_RANKED)
    # Ranks and the rows that receive them both read the events: write them once.
    return X.spearman(through_table(events, "ranked"), _RANKED, ["msno", "E"])


_PANEL_SQL = ("SELECT * FROM (SELECT msno, E, off AS \"offset\", total_secs, num_100, num_unq, num_25 FROM fanned) "
              "WHERE \"offset\" BETWEEN -60 AND -1")


@query("usage_profile_by_offset", "offset_day:i n:i mean:g median:g",
       f"SELECT \"offset\" AS offset_day, count(*) AS n, avg(total_secs) AS mean, median(total_secs) AS median "
       f"FROM ({_PANEL_SQL}) GROUP BY 1")
def usage_profile_by_offset(inp):
    from renewscope.operators.cohort import expiry_events

    events = expiry_events(distinct_transactions(inp.transactions), inp.cfg)
    return X.offset_profile(daily_panel(events, usage_near(inp.usage, inp.cfg, inp.cfg.seq_window, 0), inp.cfg)).withColumnRenamed("offset", "offset_day")


@query("active_days_per_event", "panel_rows:i n_events:i mean_days:f max_days:i",
       f"SELECT sum(n) AS panel_rows, count(*) AS n_events, avg(n) AS mean_days, max(n) AS max_days FROM "
       f"(SELECT msno, E, count(*) AS n FROM ({_PANEL_SQL}) GROUP BY 1, 2)")
def active_days_per_event(inp):
    from renewscope.operators.cohort import expiry_events

    events = expiry_events(distinct_transactions(inp.transactions), inp.cfg)
    return X.active_days_per_event(daily_panel(events, usage_near(inp.usage, inp.cfg, inp.cfg.seq_window, 0), inp.cfg))


@query("coverage_by_horizon", "h1_active:f h1_any:f h60_active:f h60_any:f baseline:f", """
SELECT avg(h1_active) AS h1_active, avg(CAST(h1_ndays > 0 AS INT)) AS h1_any, avg(h60_active) AS h60_active,
  avg(CAST(h60_ndays > 0 AS INT)) AS h60_any, avg(CAST(obs_secs_per_active_day IS NOT NULL AS INT)) AS baseline
FROM core""")
def coverage_by_horizon(inp):
    has = lambda c: F.avg((F.col(c) > 0).cast("int"))
    return core(labelled_events(inp)).agg(
        F.avg("h1_active").alias("h1_active"), has("h1_ndays").alias("h1_any"),
        F.avg("h60_active").alias("h60_active"), has("h60_ndays").alias("h60_any"),
        F.avg(F.col("obs_secs_per_active_day").isNotNull().cast("int")).alias("baseline"))


@query("subgroup_volume_share", "n:i n_sub:i share:f volume_share:f", """
SELECT count(*) AS n, count(*) FILTER (WHERE label = 'CHURN') AS n_sub,
  count(*) FILTER (WHERE label = 'CHURN') / count(*) AS share,
  sum(post_total_secs) FILTER (WHERE label = 'CHURN') / sum(post_total_secs) AS volume_share FROM ev""")
def subgroup_volume_share(inp):
    return X.share_of(labelled_events(inp), F.col("label") == "CHURN", "post_total_secs")


@query("value_frequencies", "payment_plan_days:i n:i", "SELECT payment_plan_days, count(*) AS n FROM txn GROUP BY 1")
def value_frequencies(inp):
    return X.counts_by(distinct_transactions(inp.transactions), "payment_plan_days")


@query("label_by_plan_crosstab", "payment_plan_days:i " + " ".join(f"{c}:i" for c in MODEL_CLASSES),
       "SELECT payment_plan_days, " + ", ".join(f"count(*) FILTER (WHERE label = '{c}') AS {c}" for c in MODEL_CLASSES)
       + " FROM core GROUP BY 1")
def label_by_plan_crosstab(inp):
    return X.crosstab_wide(core(labelled_events(inp)), "payment_plan_days", "label", MODEL_CLASSES)


@query("row_totals_by_method", "payment_method_id:i label n:i row_total:i", """
SELECT payment_method_id, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY payment_method_id) AS row_total
FROM ev GROUP BY 1, 2""")
def row_totals_by_method(inp):
    return X.row_totals(labelled_events(inp), "payment_method_id", "label")


_TOP_CITIES = "SELECT city, count(*) AS n FROM core JOIN members USING (msno) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"


@query("top_cities", "city:i n:i", _TOP_CITIES)
def top_cities(inp):
    return X.top_levels(with_demographics(core(labelled_events(inp)), inp.members, inp.cfg), "city", 8)


@query("class_mix_in_top_cities", "city:i label n:i share:f", f"""
SELECT city, label, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY city) AS share
FROM core JOIN members USING (msno) WHERE city IN (SELECT city FROM ({_TOP_CITIES})) GROUP BY 1, 2""")
def class_mix_in_top_cities(inp):
    return X.mix_in_top_levels(with_demographics(core(labelled_events(inp)), inp.members, inp.cfg), "city", "label")


@query("clipped_usage_seconds", "msno date:d secs:g",
       "SELECT msno, date, least(total_secs, 40000) AS secs FROM logs")
def clipped_usage_seconds(inp):
    secs = clip(clip(F.col("total_secs"), inp.cfg.min_secs, inp.cfg.max_secs), 0.0, 40_000.0)
    return inp.usage.select("msno", "date", secs.alias("secs"))


@query("finite_ratios", "msno E:d ratio:f",
       "SELECT msno, E, post_total_secs / pre_total_secs AS ratio FROM ev WHERE pre_total_secs > 0")
def finite_ratios(inp):
    raw = F.try_divide(F.col("post_total_secs"), F.col("pre_total_secs"))
    return labelled_events(inp).select("msno", "E", finite(raw).alias("ratio")).dropna(subset=["ratio"])


@query("price_median_and_p90", "median:g p90:g",
       "SELECT quantile_cont(plan_list_price, 0.5) AS median, quantile_cont(plan_list_price, 0.9) AS p90 FROM txn")
def price_median_and_p90(inp):
    return quantile_columns(distinct_transactions(inp.transactions), [], "plan_list_price",
                            {"median": 0.5, "p90": 0.9})
