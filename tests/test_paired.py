"""Paired tests against published values of a five-run comparison of models."""

import pytest
from pyspark.sql import functions as F

from renewscope.operators import paired as P

# Published macro-F1 per seed.
SEEDS = (42, 43, 44, 45, 46)
RUNS = {
    "ensemble": (0.5122292910751345, 0.5103099499950021, 0.5165337986210636, 0.5141018757046798, 0.5110243786550689),
    "xgb": (0.4362523733615384, 0.4406496276684835, 0.4415926559543877, 0.4392039181581806, 0.4386442514188072),
    "lgbm": (0.434924553259484, 0.4389050334339501, 0.4398485689075474, 0.4383569900098223, 0.4376983013193413),
    "tuned": (0.4347018984168718, 0.4440854984556817, 0.4343105526343427, 0.4458463391681125, 0.4344491037516306),
}
CONTRASTS = [("e-x", "ensemble", "xgb"), ("e-t", "ensemble", "tuned"), ("x-t", "xgb", "tuned"), ("x-l", "xgb", "lgbm")]
# Mean difference, t, p, Holm p, permutation p and its Holm p, Wilcoxon p, wins.
PUBLISHED = {
    "e-x": (0.07357129349791032, 64.35557529025711, 3.4922698611205207e-07, 1.3969079444482083e-06, 0.0625, 0.25, 0.0625, 5),
    "e-t": (0.07416118032486194, 24.718715838381218, 1.5897320400206407e-05, 4.769196120061922e-05, 0.0625, 0.25, 0.0625, 5),
    "x-t": (0.0005898868269516133, 0.2338875086367278, 0.8265552066467439, 0.8265552066467439, 0.8125, 0.8125, 0.8125, 3),
    "x-l": (0.0013218759262504487, 6.948182502907967, 0.0022539977269521727, 0.004507995453904345, 0.0625, 0.25, 0.0625, 5),
}


@pytest.fixture(scope="module")
def runs(spark):
    rows = [(m, s, v) for m, vs in RUNS.items() for s, v in zip(SEEDS, vs)]
    return spark.createDataFrame(rows, "model string, seed long, macro_f1 double")


@pytest.fixture(scope="module")
def pairs(runs):
    return P.pair_runs(runs, CONTRASTS)


def test_published_table(pairs):
    found = {r["contrast"]: r for r in P.paired_tests(pairs).collect()}
    assert set(found) == set(PUBLISHED)
    for name, want in PUBLISHED.items():
        r = found[name]
        got = (r["mean_diff"], r["t_stat"], r["p_t"], r["p_t_holm"], r["p_perm"], r["p_perm_holm"], r["p_wilcoxon"], r["wins_a"])
        assert got == pytest.approx(want, rel=1e-6)
        assert r["df"] == 4 and r["n_perm"] == 32
    assert found["e-x"]["ci_text"] == "[0.0704, 0.0767]"
    assert found["x-t"]["ci_text"] == "[-0.0064, 0.0076]"
    assert found["x-t"]["wins_text"] == "3/5"


def test_t_distribution_matches_known_values(spark):
    # Textbook two-sided critical points at 5 %.
    known = [(1, 12.706204736), (2, 4.302652730), (3, 3.182446305), (4, 2.776445105), (9, 2.262157163), (30, 2.042272456)]
    df = spark.createDataFrame(known, "df int, t double")
    for r in df.select("df", "t", P.t_two_sided_p(F.col("t"), F.col("df")).alias("p"),
                       P.t_quantile(0.975, F.col("df")).alias("q")).collect():
        assert r["p"] == pytest.approx(0.05, abs=1e-8)
        assert r["q"] == pytest.approx(r["t"], abs=1e-6)


def test_bootstrap_is_repeatable_and_brackets_the_mean(pairs):
    a = {r[0]: (r[1], r[2]) for r in P.bootstrap_interval(pairs, draws=2000).collect()}
    b = {r[0]: (r[1], r[2]) for r in P.bootstrap_interval(pairs.repartition(3), draws=2000).collect()}
    assert a == b
    for name, (lo, hi) in a.items():
        assert lo <= PUBLISHED[name][0] <= hi


def test_run_table_problems(runs):
    assert P.run_table_problems(runs, list(RUNS), SEEDS).count() == 0
    broken = runs.where("not (model = 'xgb' and seed = 44)").unionByName(runs.where("model = 'lgbm' and seed = 42"))
    found = {tuple(r) for r in P.run_table_problems(broken, list(RUNS), SEEDS).collect()}
    assert found == {("xgb", "missing seed"), ("lgbm", "repeated seed")}
    assert P.first_per_seed(broken, "macro_f1").count() == 19


def test_summary_check(runs, spark):
    pub = spark.createDataFrame([("ensemble", 0.5128398588101898, 0.0011248794987515), ("xgb", 0.44, 0.0009)],
                                "model string, macro_f1_mean double, macro_f1_se double")
    got = {r["model"]: r["reproduced"] for r in P.summary_check(runs, pub).collect()}
    assert got == {"ensemble": 1, "xgb": 0, "lgbm": 0, "tuned": 0}


def test_too_many_pairs_are_refused(spark):
    many = spark.range(20).select(F.lit("c").alias("contrast"), F.col("id").alias("pair_id"),
                                  F.rand(1).alias("a"), F.rand(2).alias("b"))
    with pytest.raises(Exception, match="at most 16 pairs"):
        P.sign_flip_p(many).collect()


def test_wilcoxon_zeros_and_ties(spark):
    rows = [("c", i, d, 0.0) for i, d in enumerate([0.0, 1.0, 1.0, -2.0, 3.0])]
    pairs = spark.createDataFrame(rows, "contrast string, pair_id int, a double, b double")
    r = P.wilcoxon_p(pairs).first()
    # Ranks 1.5, 1.5, 3, 4: minus sum 3; assignments with minus sum <= 3 are 5 of 16, doubled.
    assert (r["n_zero"], r["w_stat"]) == (1, 3.0)
    assert r["p_wilcoxon"] == pytest.approx(10 / 16)
    same = spark.createDataFrame([("z", 1, 1.0, 1.0)], pairs.schema)
    assert P.wilcoxon_p(same).first()["p_wilcoxon"] == 1.0
