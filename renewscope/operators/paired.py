"""Paired comparisons over a long table (contrast, pair_id, a, b).

All tests are grouped aggregates, so any number of contrasts is computed at once. A
contrast is a handful of matched runs; exact enumeration is refused above MAX_PAIRS.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_PAIRS = 16


def pair_runs(runs: DataFrame, contrasts: Sequence[tuple[str, str, str]], key: str = "seed",
              metric: str = "macro_f1") -> DataFrame:
    """(contrast, pair_id, a, b): two models' scores matched on the run key."""
    wanted = F.explode(F.array(*[
        F.struct(F.lit(n).alias("contrast"), F.lit(a).alias("ma"), F.lit(b).alias("mb"))
        for n, a, b in contrasts])).alias("c")
    scored = runs.select(key, "model", metric, wanted)
    model = F.col("model")
    return scored.groupBy(F.col("c.contrast").alias("contrast"), F.col(key).alias("pair_id")).agg(
        F.max(F.when(model == F.col("c.ma"), F.col(metric))).alias("a"),
        F.max(F.when(model == F.col("c.mb"), F.col(metric))).alias("b")).dropna(subset=["a", "b"])


def run_table_problems(runs: DataFrame, models: Sequence[str], seeds: Sequence[int],
                       metric: str = "macro_f1") -> DataFrame:
    """(model, problem) for models without exactly the expected seeds and scores."""
    one = runs.sparkSession.range(1)
    expected = one.select(F.explode(F.array(*[F.lit(m) for m in models])).alias("model")).select(
        "model", F.explode(F.array(*[F.lit(int(s)).cast("long") for s in seeds])).alias("seed"))
    found = runs.where(F.col(metric).isNotNull()).groupBy("model", F.col("seed").cast("long").alias("seed")).agg(
        F.count(F.lit(1)).alias("n"))
    missing = expected.join(found, ["model", "seed"], "left_anti").select("model", F.lit("missing seed").alias("problem"))
    extra = found.join(expected, ["model", "seed"], "left_anti").select("model", F.lit("unexpected seed").alias("problem"))
    twice = found.where(F.col("n") > 1).select("model", F.lit("repeated seed").alias("problem"))
    empty = runs.where(F.col(metric).isNull()).select("model", F.lit("missing score").alias("problem"))
    return missing.unionByName(extra).unionByName(twice).unionByName(empty).distinct()


def first_per_seed(runs: DataFrame, order: str, key: Sequence[str] = ("model", "seed")) -> DataFrame:
    """One row per model and seed: the first by `order`."""
    w = W.partitionBy(*key).orderBy(order)
    return runs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def summary_check(runs: DataFrame, published: DataFrame, metric: str = "macro_f1", tol: float = 1e-4) -> DataFrame:
    """Recomputed mean, SD, SE, min and max next to published mean and SE."""
    sd = F.stddev_samp(metric)
    calc = runs.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.avg(metric).alias("mean"), sd.alias("sd"),
        (sd / F.sqrt(F.count(F.lit(1)))).alias("se"), F.min(metric).alias("min"), F.max(metric).alias("max"))
    pub = published.select("model", F.col(f"{metric}_mean").alias("published_mean"),
                           F.col(f"{metric}_se").alias("published_se"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= tol
    return calc.join(pub, "model", "left").withColumn(
        "reproduced", F.coalesce(near("mean", "published_mean") & near("se", "published_se"), F.lit(False)).cast("int"))


def differences(pairs: DataFrame) -> DataFrame:
    """Mean, median, spread and win/tie/loss counts of a - b per contrast."""
    d = F.col("a") - F.col("b")
    sd = F.stddev_samp(d)
    n = F.count(F.lit(1))
    return pairs.groupBy("contrast").agg(
        n.alias("n"), F.avg(d).alias("mean_diff"), F.median(d).alias("median_diff"), sd.alias("sd_diff"),
        (sd / F.sqrt(n)).alias("se_diff"), F.count_if(d > 0).alias("wins_a"), F.count_if(d == 0).alias("ties"),
        F.count_if(d < 0).alias("wins_b"))


def t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom, by the finite series in
    the angle atan(t / sqrt(df))."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    c, s = F.cos(theta), F.sin(theta)
    # Odd df: A = 2/pi * (theta + sin*(cos + 2/3 cos^3 + 2*4/(3*5) cos^5 + ...)).
    # Even df: A = sin * (1 + 1/2 cos^2 + 1*3/(2*4) cos^4 + ...).
    odd = F.pmod(df, F.lit(2)) == 1
    terms = F.floor(F.when(odd, (df - 1) / 2).otherwise(df / 2)).cast("int")
    start = F.struct(F.when(odd, c).otherwise(F.lit(1.0)).alias("term"), F.lit(0.0).alias("sum"))

    def step(acc, k):
        ratio = F.when(odd, (2 * k) / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        return F.struct((acc["term"] * ratio * c * c).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))

    ks = F.when(terms >= 1, F.sequence(F.lit(1), F.greatest(terms, F.lit(1)))).otherwise(
        F.array().cast("array<int>"))
    total = F.aggregate(ks, start, step)["sum"]
    inside = F.when(odd, (theta + s * total) * (2 / math.pi)).otherwise(s * total)
    return F.greatest(F.lit(0.0), 1 - inside)


def paired_t(pairs: DataFrame) -> DataFrame:
    """differences() with the t statistic, its degrees of freedom and two-sided p."""
    d = differences(pairs)
    t = F.try_divide(F.col("mean_diff"), F.col("se_diff"))
    return d.withColumn("t_stat", t).withColumn("df", (F.col("n") - 1).cast("int")).withColumn(
        "p_t", t_two_sided_p(F.col("t_stat"), F.col("df")))


def extreme_differences(pairs: DataFrame, limit: float = 2.5) -> DataFrame:
    """Pairs whose difference lies more than `limit` standard deviations from the mean."""
    w = W.partitionBy("contrast")
    d = F.col("a") - F.col("b")
    z = F.try_divide(d - F.avg(d).over(w), F.stddev_samp(d).over(w))
    return pairs.withColumn("z", z).where(F.abs("z") > limit)


def _numbered(pairs: DataFrame) -> DataFrame:
    w = W.partitionBy("contrast")
    d = pairs.select("contrast", "pair_id", (F.col("a") - F.col("b")).alias("d"))
    return (
        d.withColumn("i", F.row_number().over(w.orderBy("pair_id")) - 1)
        .withColumn("n", F.count(F.lit(1)).over(w))
        .withColumn("n", F.when(F.col("n") <= MAX_PAIRS, F.col("n")).otherwise(
            F.raise_error(F.lit(f"exact enumeration needs at most {MAX_PAIRS} pairs")).cast("long")))
    )


def _assignments(numbered: DataFrame) -> DataFrame:
    """Each pair once per sign assignment, numbered 0 … 2^n - 1; bit i set means minus."""
    masks = F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), F.col("n")).cast("long") - 1))
    bits = numbered.withColumn("mask", masks)
    bit = F.floor(F.col("mask") / F.pow(F.lit(2), F.col("i"))) % 2
    return bits.withColumn("sign", 1 - 2 * bit)


def sign_flip_p(pairs: DataFrame) -> DataFrame:
    """(contrast, p_perm, n_perm): exact two-sided permutation test on |mean|."""
    flipped = _assignments(_numbered(pairs)).groupBy("contrast", "mask").agg(
        F.abs(F.avg(F.col("sign") * F.col("d"))).alias("stat"))
    w = W.partitionBy("contrast")
    observed = F.max(F.when(F.col("mask") == 0, F.col("stat"))).over(w)
    return flipped.withColumn("obs", observed).groupBy("contrast").agg(
        F.avg((F.col("stat") >= F.col("obs") - 1e-15).cast("int")).alias("p_perm"),
        F.count(F.lit(1)).alias("n_perm"))


def wilcoxon_p(pairs: DataFrame) -> DataFrame:
    """(contrast, w_stat, p_wilcoxon, n_zero): exact signed-rank test, zeros dropped,
    average ranks on ties."""
    zeros = pairs.groupBy("contrast").agg(F.count_if(F.col("a") == F.col("b")).alias("n_zero"))
    kept = _numbered(pairs.where(F.col("a") != F.col("b"))).withColumn("size", F.abs("d"))
    by_size = W.partitionBy("contrast").orderBy("size")
    same = W.partitionBy("contrast", "size")
    rank = F.rank().over(by_size) + (F.count(F.lit(1)).over(same) - 1) / 2
    ranked = kept.withColumn("r", rank)
    positive = ranked.groupBy("contrast").agg(
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("plus"), F.sum("r").alias("all"))
    flips = _assignments(ranked).groupBy("contrast", "mask").agg(
        F.sum(F.when(F.col("sign") > 0, F.col("r")).otherwise(0.0)).alias("t"))
    low = F.least("plus", F.col("all") - F.col("plus"))
    tested = flips.join(positive, "contrast").groupBy("contrast").agg(
        F.first(low).alias("w_stat"),
        F.least(F.lit(1.0), 2 * F.avg((F.col("t") <= low).cast("int"))).alias("p_wilcoxon"))
    return zeros.join(tested, "contrast", "left").fillna(1.0, ["p_wilcoxon"])


def holm(df: DataFrame, p: str, out: str, family: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p within each family, capped at 1."""
    whole = W.partitionBy(*family, F.lit(0))
    order = whole.orderBy(p, "contrast")
    step = F.count(F.lit(1)).over(whole) - F.row_number().over(order) + 1
    scaled = df.withColumn("_s", step * F.col(p))
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return scaled.withColumn(out, F.least(F.lit(1.0), F.max("_s").over(upto))).drop("_s")


def t_quantile(prob: float, df: Column) -> Column:
    """Quantile of Student's t by bisection on the closed form."""
    target = 2 * (1 - prob)
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1e4).alias("hi"))

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        above = t_two_sided_p(mid, df) > target
        return F.struct(F.when(above, mid).otherwise(acc["lo"]).alias("lo"),
                        F.when(above, acc["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, halve)
    return (found["lo"] + found["hi"]) / 2


def t_interval(tested: DataFrame, level: float = 0.95) -> DataFrame:
    half = t_quantile(1 - (1 - level) / 2, F.col("df")) * F.col("se_diff")
    return tested.withColumn("ci_lo", F.col("mean_diff") - half).withColumn("ci_hi", F.col("mean_diff") + half)


def bootstrap_interval(pairs: DataFrame, draws: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(contrast, boot_lo, boot_hi): percentile interval of resampled mean differences.

    Draws are picked by md5 of seed, contrast, draw and place, so the result does not depend on
    partitioning or engine. Each contrast holds one array of its few differences.
    """
    held = pairs.groupBy("contrast").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pair_id", (F.col("a") - F.col("b")).alias("d")))),
        lambda s: s["d"]).alias("ds"))
    drawn = held.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    n = F.size("ds")

    def pick(i):
        text = F.concat_ws(":", F.lit(str(seed)), F.col("contrast"), F.col("draw").cast("string"), i.cast("string"))
        h = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
        return F.get(F.col("ds"), F.pmod(h, n.cast("long")).cast("int"))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), pick), F.lit(0.0), lambda acc, x: acc + x)
    tail = (1 - level) / 2
    means = drawn.select("contrast", (total / n).alias("m"))
    return means.groupBy("contrast").agg(
        F.percentile("m", tail).alias("boot_lo"), F.percentile("m", 1 - tail).alias("boot_hi"))


#: How far a difference holds up: not at all, taken alone, and among all contrasts of its family.
STRENGTH = ("none", "alone", "in_family")


def strength(p_holm: Column, p_raw: Column, alpha: float = 0.05) -> Column:
    """One step up for each of the two p-values below alpha; an adjusted one is never the smaller."""
    passed = [F.coalesce(p < alpha, F.lit(False)).cast("int") for p in (p_raw, p_holm)]
    return F.element_at(F.array(*[F.lit(x) for x in STRENGTH]), passed[0] + passed[1] + 1)


def paired_tests(pairs: DataFrame) -> DataFrame:
    """The final table: difference, interval, wins and all three tests with Holm."""
    t = t_interval(paired_t(pairs))
    table = t.join(sign_flip_p(pairs), "contrast").join(wilcoxon_p(pairs), "contrast")
    table = holm(holm(table, "p_t", "p_t_holm"), "p_perm", "p_perm_holm")
    return table.withColumns({
        "ci_text": F.format_string("[%.4f, %.4f]", "ci_lo", "ci_hi"),
        "wins_text": F.format_string("%d/%d", "wins_a", "n"),
        "strength": strength(F.col("p_t_holm"), F.col("p_t")),
    })
