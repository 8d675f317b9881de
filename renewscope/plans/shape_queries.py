"""Queries over splits, sequences and model inputs."""

from pyspark.sql import functions as F

from renewscope.config import PANEL_CHANNELS
from renewscope.functions.scalar import category_text, day_number, md5_mod, numeric_or
from renewscope.operators import features as E
from renewscope.operators import panel as Q
from renewscope.operators import splits as S
from renewscope.operators.cohort import distinct_transactions, expiry_events
from renewscope.operators.explore import crosstab_shares, counts_by
from renewscope.operators.members import with_demographics
from renewscope.operators.usage import usage_days, usage_near
from renewscope.plans.catalog import _CTES as CTES
from renewscope.plans.catalog import query, table_query
from renewscope.plans.labelled import labelled_events
from renewscope.plans.sqltext import md5_mod_sql
from renewscope.session import through_table
from renewscope.sources.adapters import table

_U1000, _U5 = md5_mod_sql("msno", 1000), md5_mod_sql("msno", 5)
CTES["orders"]["split"] = f"""
SELECT ev.*, dense_rank() OVER (ORDER BY expiry_month) - 1 AS month_idx,
  CAST({_U1000} < 150 AS INT) AS is_holdout, CASE WHEN {_U1000} < 150 THEN -1 ELSE {_U5} END AS user_fold,
  CAST(label <> 'INSUFFICIENT_DATA' AS INT) AS is_modellable FROM ev"""
_HO = md5_mod_sql("'ho:' || seed || ':' || msno", 1_000_000)
_FO = md5_mod_sql("'fold:' || seed || ':' || msno", 1_000_000)
CTES["orders"]["run_split"] = f"""
SELECT *, CAST({_HO} / CAST(1000000 AS DOUBLE) < 0.15 AS INT) AS is_holdout,
  CASE WHEN {_HO} / CAST(1000000 AS DOUBLE) < 0.15 THEN -1
    ELSE CAST(floor({_FO} / CAST(1000000 AS DOUBLE) * 5) AS INT) END AS user_fold
FROM cohort, (SELECT unnest(range(42, 47)) AS seed)"""
CTES["orders"]["panel"] = ("SELECT msno, E, off AS \"offset\", total_secs, num_100, num_unq, num_25 FROM fanned "
                           "WHERE off BETWEEN -60 AND -1")


def _cohort(inp):
    return expiry_events(distinct_transactions(inp.transactions), inp.cfg)


def _split(inp):
    return S.with_fixed_split(labelled_events(inp), inp.cfg)


def _split_table(inp, *columns):
    """Written once, because the fit and the rows it is applied to both read it."""
    return through_table(_split(inp).select("msno", "E", "is_holdout", *columns), "split")


@table_query("md5_buckets", "o_orderkey:i m5:i m1000:i m1000000:i",
             "SELECT o_orderkey, " + ", ".join(
                 f"{md5_mod_sql('CAST(o_orderkey AS VARCHAR)', m)} AS m{m}" for m in (5, 1000, 1_000_000)) + " FROM orders")
def md5_buckets(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key, *[md5_mod(key.cast("string"), m).alias(f"m{m}") for m in (5, 1000, 1_000_000)])


@query("fixed_user_split", "msno E:d month_idx:i is_holdout:i user_fold:i is_modellable:i", "SELECT * FROM split")
def fixed_user_split(inp):
    return _split(inp)


@query("run_splits_all_seeds", "msno E:d seed:i is_holdout:i user_fold:i", "SELECT * FROM run_split")
def run_splits_all_seeds(inp):
    return S.assign_all_run_splits(_cohort(inp), inp.cfg)


@query("run_split_one_seed", "msno E:d is_holdout:i user_fold:i", "SELECT * FROM run_split WHERE seed = 44")
def run_split_one_seed(inp):
    return S.assign_run_split(_cohort(inp), 44, inp.cfg)


@query("development_and_holdout", "side n:i n_users:i",
       "SELECT CASE WHEN is_holdout = 1 THEN 'holdout' ELSE 'development' END AS side, count(*) AS n, "
       "count(DISTINCT msno) AS n_users FROM run_split WHERE seed = 42 GROUP BY 1")
def development_and_holdout(inp):
    run = S.assign_run_split(_cohort(inp), 42, inp.cfg)
    both = S.development(run).withColumn("side", F.lit("development")).unionByName(
        S.holdout(run).withColumn("side", F.lit("holdout")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("msno").alias("n_users"))


@query("fold_roles", "fold:i role n:i", """
SELECT k AS fold, CASE WHEN user_fold = k THEN 'validation' ELSE 'train' END AS role, count(*) AS n
FROM run_split, (SELECT unnest(range(5)) AS k) WHERE seed = 42 AND is_holdout = 0 GROUP BY 1, 2""")
def fold_roles(inp):
    return counts_by(S.fold_roles(S.assign_run_split(_cohort(inp), 42, inp.cfg), inp.cfg), "fold", "role")


@query("validation_set_difference", "msno E:d",
       "SELECT msno, E FROM run_split WHERE seed = 42 AND is_holdout = 0 EXCEPT "
       "SELECT msno, E FROM run_split WHERE seed = 42 AND user_fold = 0")
def validation_set_difference(inp):
    run = S.assign_run_split(_cohort(inp), 42, inp.cfg)
    _, val = S.fold_parts(run, 0)
    return S.development(run).join(val.select("msno", "E"), ["msno", "E"], "left_anti")


@query("walk_forward_steps", "step:i role n:i", """
SELECT t AS step, CASE WHEN month_idx <= t THEN 'train' ELSE 'test' END AS role, count(*) AS n
FROM split, (SELECT unnest(range(35)) AS t) WHERE is_holdout = 0 AND month_idx <= t + 1 GROUP BY 1, 2""")
def walk_forward_steps(inp):
    return counts_by(S.walk_forward_roles(_split_table(inp, "month_idx")), "step", "role")


@query("split_diagnostics", "user_fold:i label n:i share:f", """
SELECT user_fold, label, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY user_fold) AS share
FROM split WHERE is_modellable = 1 AND user_fold >= 0 GROUP BY 1, 2""")
def split_diagnostics(inp):
    kept = _split(inp).where((F.col("is_modellable") == 1) & (F.col("user_fold") >= 0))
    return crosstab_shares(kept, "user_fold", "label")


@query("split_month_diagnostics", "month_idx:i expiry_month n:i held_users:i",
       "SELECT month_idx, expiry_month, count(*) AS n, count(DISTINCT CASE WHEN is_holdout = 1 THEN msno END) AS held_users "
       "FROM split GROUP BY 1, 2")
def split_month_diagnostics(inp):
    return _split(inp).groupBy("month_idx", "expiry_month").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(F.when(F.col("is_holdout") == 1, F.col("msno"))).alias("held_users"))


@query("users_in_two_folds", "msno folds:i",
       "SELECT msno, count(DISTINCT user_fold) AS folds FROM split GROUP BY 1 HAVING count(DISTINCT user_fold) > 1")
def users_in_two_folds(inp):
    return S.split_leaks(_split(inp))


@query("stratified_subsample_sizes", "label n:i", """
SELECT label, greatest(1, least(count(*), CAST(round_even(count(*) * 1000 / CAST((SELECT count(*) FROM core) AS DOUBLE), 0) AS BIGINT))) AS n
FROM core GROUP BY 1""")
def stratified_subsample_sizes(inp):
    core = labelled_events(inp).where("label <> 'INSUFFICIENT_DATA'").select("msno", "E", "label")
    core = through_table(core, "core")
    return counts_by(S.stratified_subsample(core, "label", 1000, ["msno", "E"], 42), "label")


@query("hash_sample_size", "n:i n_keys:i", "SELECT 500 AS n, 500 AS n_keys")
def hash_sample_size(inp):
    kept = S.hash_sample(_cohort(inp), 500, ["msno", "E"], 42)
    return kept.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("msno", "E").alias("n_keys"))


_TEXT_ORDER = "CAST('0x' || left(md5('42:' || msno || ':' || CAST(E AS VARCHAR)), 15) AS BIGINT)"


@query("stratified_subsample_rows", "msno E:d label", f"""
WITH sized AS (SELECT label, greatest(1, least(count(*), CAST(round_even(count(*) * 1000 / CAST((SELECT count(*) FROM core) AS DOUBLE), 0) AS BIGINT))) AS take
  FROM core GROUP BY 1),
ranked AS (SELECT msno, E, label, row_number() OVER (PARTITION BY label ORDER BY {_TEXT_ORDER}, msno, E) AS place FROM core)
SELECT msno, E, label FROM ranked JOIN sized USING (label) WHERE place <= take""")
def stratified_subsample_rows(inp):
    core = labelled_events(inp).where("label <> 'INSUFFICIENT_DATA'").select("msno", "E", "label")
    return S.stratified_subsample(through_table(core, "core"), "label", 1000, ["msno", "E"], 42, S.text_order)


@query("hash_sample_rows", "msno E:d", f"SELECT msno, E FROM cohort ORDER BY {_TEXT_ORDER}, msno, E LIMIT 500")
def hash_sample_rows(inp):
    return S.hash_sample(_cohort(inp).select("msno", "E"), 500, ["msno", "E"], 42, S.text_order)


@query("daily_panel", "msno E:d offset_day:i total_secs:g num_100:i num_unq:i num_25:i",
       "SELECT *, \"offset\" AS offset_day FROM panel")
def daily_panel(inp):
    return Q.daily_panel(_cohort(inp), usage_near(inp.usage, inp.cfg, inp.cfg.seq_window, 0), inp.cfg).withColumnRenamed("offset", "offset_day")


@query("daily_panel_dense_study", "msno E:d offset_day:i total_secs:g num_100:i num_unq:i num_25:i",
       "SELECT msno, E, off AS offset_day, total_secs, num_100, num_unq, num_25 FROM fanned WHERE off BETWEEN -6 AND -1",
       study="events")
def daily_panel_dense_study(inp):
    return daily_panel(inp)


def _dense(inp, window):
    events = _cohort(inp)
    return Q.dense_sequence(Q.daily_panel(events, usage_near(inp.usage, inp.cfg, window, 0), inp.cfg, window), events, window)


def _dense_sql(window, shift=0, size=None):
    """Text of the seconds and count channels, day by day."""
    size = size or window
    days = f"(SELECT unnest(range({-window}, 0)) AS d)"
    return f"""
SELECT c.msno, c.E, string_agg(CAST(CAST(coalesce(f.total_secs, 0) AS INT) AS VARCHAR) || '/' || coalesce(f.num_unq, 0), ',' ORDER BY d) AS seq,
  CAST(count(f.off) > 0 AS INT) AS active
FROM cohort c CROSS JOIN {days} LEFT JOIN fanned f ON f.msno = c.msno AND f.E = c.E AND f.off = d
WHERE d BETWEEN {-(size + shift)} AND {-(1 + shift)} GROUP BY 1, 2"""


def _as_text(df):
    day = lambda v: F.concat_ws("/", F.round(v[0]).cast("int"), v[2].cast("int"))
    return df.select("msno", "E", F.array_join(F.transform("seq", day), ",").alias("seq"),
                     Q.has_activity(F.col("seq")).cast("int").alias("active"))


@query("dense_sequences", "msno E:d seq active:i", _dense_sql(60))
def dense_sequences(inp):
    return _as_text(_dense(inp, inp.cfg.seq_window))


@query("deep_sequences", "msno E:d seq active:i", _dense_sql(12), study="events")
def deep_sequences(inp):
    return _as_text(_dense(inp, inp.cfg.deep_window))


@query("slid_sequences", "msno E:d seq active:i", _dense_sql(12, shift=3, size=6), study="events")
def slid_sequences(inp):
    deep = _dense(inp, inp.cfg.deep_window)
    return _as_text(deep.withColumn("seq", Q.slide(F.col("seq"), inp.cfg.deep_window, inp.cfg.seq_window, 3)))


@query("sequence_coverage", "cutoff_days:i coverage:f", " UNION ALL ".join(
    f"SELECT {c} AS cutoff_days, avg(active) AS coverage FROM ({_dense_sql(12, shift=c, size=6)})" for c in (0, 1, 3)),
       study="events")
def sequence_coverage(inp):
    deep = _dense(inp, inp.cfg.deep_window)
    slices = F.array(*[
        F.struct(F.lit(c).alias("cutoff_days"),
                 Q.has_activity(Q.slide(F.col("seq"), inp.cfg.deep_window, inp.cfg.seq_window, c)).alias("on"))
        for c in inp.cfg.cutoffs])
    return deep.select(F.explode(slices).alias("s")).groupBy("s.cutoff_days").agg(
        F.avg(F.col("s.on").cast("int")).alias("coverage"))


@query("deep_sequence_consistency", "max_diff:f n:i", "SELECT 0.0 AS max_diff, count(*) AS n FROM cohort")
def deep_sequence_consistency(inp):
    deep, window = inp.cfg.deep_window, inp.cfg.seq_window
    recent = _dense(inp, deep).withColumn("seq", Q.slide(F.col("seq"), deep, window, 0))
    return Q.sequence_difference(recent, _dense(inp, window))


_BUSY = "(total_secs <> 0 OR num_100 <> 0 OR num_unq <> 0 OR num_25 <> 0)"
_LOGGED = {c: f"ln(1 + least(greatest({c}, 0), 60000))" for c in PANEL_CHANNELS}


@query("sequence_channel_statistics", "channel mean:f std:f", " UNION ALL ".join(
    f"SELECT '{c}' AS channel, avg({e}) AS mean, stddev_pop({e}) + 1e-6 AS std FROM panel "
    f"WHERE {_BUSY}" for c, e in _LOGGED.items()))
def sequence_channel_statistics(inp):
    return Q.channel_statistics(_dense(inp, inp.cfg.seq_window), inp.cfg)


@query("normalised_sequence_totals", "channel total:g", " UNION ALL ".join(
    f"SELECT '{c}' AS channel, (sum({e}) - (SELECT count(*) FROM cohort) * 60 * (SELECT avg({e}) FROM panel WHERE {_BUSY})) "
    f"/ ((SELECT stddev_pop({e}) FROM panel WHERE {_BUSY}) + 1e-6) AS total FROM panel" for c, e in _LOGGED.items()))
def normalised_sequence_totals(inp):
    dense = through_table(_dense(inp, inp.cfg.seq_window), "dense")
    return Q.channel_totals(Q.normalise_sequences(dense, Q.channel_statistics(dense, inp.cfg), inp.cfg))


_NUMS = ("pre_rate", "vol_ratio", "recent_vs_life_ratio")


CTES["orders"]["medians"] = "SELECT " + ", ".join(f"median({c}) AS {c}" for c in _NUMS) + " FROM split WHERE is_holdout = 0"
CTES["orders"]["imputed"] = ("SELECT s.msno, s.E, s.is_holdout, " + ", ".join(
    f"coalesce(s.{c}, m.{c}) AS {c}" for c in _NUMS) + " FROM split s, medians m")
CTES["orders"]["scaling"] = "SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) + 1e-6 AS s_{c}" for c in _NUMS) + " FROM imputed WHERE is_holdout = 0"


@query("median_imputation", "msno E:d " + " ".join(f"{c}:g" for c in _NUMS), "SELECT * FROM imputed")
def median_imputation(inp):
    split = _split_table(inp, *_NUMS)
    return E.impute_medians(split, E.fit_medians(S.development(split), _NUMS), _NUMS)


@query("standardised_features", "msno E:d " + " ".join(f"{c}:g" for c in _NUMS),
       "SELECT i.msno, i.E, " + ", ".join(f"(i.{c} - m_{c}) / s_{c} AS {c}" for c in _NUMS) + " FROM imputed i, scaling")
def standardised_features(inp):
    split = _split_table(inp, *_NUMS)
    filled = E.impute_medians(split, E.fit_medians(S.development(split), _NUMS), _NUMS)
    return E.standardise(filled, E.fit_scaling(S.development(filled), _NUMS), _NUMS)


def _with_members(inp):
    return with_demographics(_cohort(inp), inp.members, inp.cfg)


CTES["orders"]["gender_levels"] = ("SELECT gender, row_number() OVER (ORDER BY gender) - 1 AS code FROM "
                                   "(SELECT DISTINCT gender FROM members WHERE gender <> 'MACHINERY')")


@query("category_codes", "msno E:d code:i", """
SELECT c.msno, c.E, coalesce(l.code, (SELECT max(code) + 1 FROM gender_levels)) AS code
FROM cohort c LEFT JOIN members m USING (msno) LEFT JOIN gender_levels l ON l.gender = m.gender""")
def category_codes(inp):
    demo = _with_members(inp)
    seen = E.level_table(inp.members.where("gender <> 'MACHINERY'"), "gender")
    return E.encode_levels(demo, "gender", seen, "code")


@query("fixed_category_levels", "feature levels",
       "SELECT 'gender' AS feature, string_agg(g, ',' ORDER BY g) AS levels FROM (SELECT DISTINCT coalesce(gender, 'NA') AS g "
       "FROM cohort LEFT JOIN members USING (msno)) UNION ALL SELECT 'bd', string_agg(g, ',' ORDER BY g) FROM "
       "(SELECT DISTINCT coalesce(CAST(bd AS VARCHAR), 'NA') AS g FROM cohort LEFT JOIN members USING (msno))")
def fixed_category_levels(inp):
    levels = E.fixed_levels(_with_members(inp), ["gender", "bd"])
    return levels.select(F.col("column").alias("feature"), F.array_join("levels", ",").alias("levels"))


@query("rare_levels_grouped", "level n:i",
       "SELECT CASE WHEN n >= 60 THEN lv ELSE 'infrequent' END AS level, sum(n) AS n FROM "
       "(SELECT coalesce(CAST(bd AS VARCHAR), 'NA') AS lv, count(*) AS n FROM cohort LEFT JOIN members USING (msno) GROUP BY 1) "
       "GROUP BY 1")
def rare_levels_grouped(inp):
    return counts_by(E.group_rare_levels(_with_members(inp), "bd", "level", 60), "level")


@query("balanced_class_weights", "label weight:f",
       "SELECT label, (SELECT count(*) FROM ev) / ((SELECT count(DISTINCT label) FROM ev) * CAST(count(*) AS DOUBLE)) AS weight "
       "FROM ev GROUP BY 1")
def balanced_class_weights(inp):
    return E.balanced_weights(labelled_events(inp), "label")


@query("registration_day_numbers", "msno days:f plausible_age:f via gender_text", """
SELECT msno, date_diff('day', DATE '1970-01-01', registration_init_time) AS days,
  CASE WHEN bd BETWEEN 0 AND 100 THEN bd END AS plausible_age, CAST(registered_via AS VARCHAR) AS via,
  coalesce(gender, 'NA') AS gender_text FROM members""")
def registration_day_numbers(inp):
    from renewscope.operators.members import clean_members

    m = clean_members(inp.members, inp.cfg)
    return m.select("msno", day_number(F.col("registration_init_time")).cast("double").alias("days"),
                    F.when(F.col("bd").between(*inp.cfg.age_use), F.col("bd")).alias("plausible_age"),
                    category_text(F.col("registered_via")).alias("via"),
                    category_text(F.col("gender")).alias("gender_text"))


@table_query("coerced_numbers", "event_id:i number:f",
             "SELECT event_id, CASE WHEN regexp_full_match(raw, '[+-]?[0-9]+([.][0-9]+)?') THEN CAST(raw AS DOUBLE) ELSE -1 END AS number "
             "FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN event_type WHEN event_type = 'click' THEN CAST(value AS VARCHAR) "
             "ELSE json_extract_string(props, '$.k') END AS raw FROM events)")
def coerced_numbers(spark, sf_dir):
    kind = F.col("event_type")
    raw = F.when(kind == "error", kind).when(kind == "click", F.col("value").cast("string")).otherwise(F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select("event_id", numeric_or(F.when(raw.rlike("^[+-]?[0-9]+([.][0-9]+)?$"), raw), -1.0).alias("number"))


@query("usage_channel_totals", "msno date:d num_25:i num_100:i num_unq:i", "SELECT * FROM logs", study="events")
def usage_channel_totals(inp):
    return usage_days(inp.usage, inp.cfg)
