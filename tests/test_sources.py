"""Raw conversion, optional parts, stages, caches, sweeps and the contract."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from renewscope.config import StudyConfig
from renewscope.operators.features import project_features
from renewscope.plans.engineered import engineered_events, rebuilt_at_cutoffs
from renewscope.sources import adapters, raw
from renewscope.sources.contract import FeatureContract
from renewscope.sources.raw import stored_bytes
from renewscope.sources.schemas import DATASETS, TRANSACTIONS, USER_LOGS
from renewscope.sources.stores import SweepStore, cached_by_keys, read_report, stage, write_report

CFG = StudyConfig()

TXN_HEAD = ",".join(TRANSACTIONS.names)
LOG_HEAD = ",".join(USER_LOGS.names)


@pytest.fixture()
def raw_dir(tmp_path):
    # The columns of this file come in another order than the schema's.
    head = ["is_cancel", *[c for c in TRANSACTIONS.names if c != "is_cancel"]]
    rows = ["0,a,41,30,149,149,1,20161101,20161201", "0,a,41,30,149,149,1,20161130,20161230"]
    (tmp_path / "transactions.csv").write_text("\n".join([",".join(head), *rows]) + "\n")
    (tmp_path / "transactions_v2.csv").write_text(f"{TXN_HEAD}\na,41,30,149,149,1,20161101,20161201,0\n")
    logs = [f"a,201611{d:02d},1,0,0,0,{d},2,{100.5 + d}" for d in range(5, 30)] + ["a,20161210,1,0,0,0,3,2,60.25"]
    (tmp_path / "user_logs.csv").write_text("\n".join([LOG_HEAD, *logs]) + "\n")
    (tmp_path / "members_v3.csv").write_text("msno,city,bd,gender,registered_via,registration_init_time\na,13,,,7,20150101\n")
    return str(tmp_path)


def test_conversion_and_whole_study(spark, raw_dir):
    report = raw.convert_all(spark, raw_dir)
    assert report == {"members_v3": "converted", "transactions": "converted", "transactions_v2": "converted",
                      "user_logs": "converted", "user_logs_v2": "missing"}
    t = spark.read.parquet(f"{raw_dir}/transactions.parquet")
    assert [(f.name, f.dataType) for f in t.schema] == [(f.name, f.dataType) for f in TRANSACTIONS]
    assert t.orderBy("transaction_date").first()["is_cancel"] == 0
    assert raw.convert_all(spark, raw_dir, only=["transactions"]) == {"transactions": "skipped"}
    assert raw.convert_all(spark, raw_dir, only=["transactions"], force=True) == {"transactions": "converted"}
    raw.remove_path(spark, f"{raw_dir}/transactions.parquet/_SUCCESS")  # as a lost conversion leaves it
    assert raw.convert_all(spark, raw_dir, only=["transactions"]) == {"transactions": "converted"}
    with pytest.raises(ValueError):
        raw.convert_all(spark, raw_dir, only=["other"])
    study = raw.raw_study(spark, raw_dir, CFG)
    assert study.transactions.count() == 3
    events = {str(r["E"]): r for r in engineered_events(study).collect()}
    first = events["2016-12-01"]
    assert first["renewed"] == 1 and first["pre_n_days"] == 25 and first["label"] == "CONTRACTION"
    assert first["post_total_secs"] == 60.25 and first["city"] == 13 and first["bd"] is None
    assert {r["cutoff_days"] for r in rebuilt_at_cutoffs(study).collect()} == set(CFG.cutoffs)


def test_header_only_and_bad_csv(spark, tmp_path):
    (tmp_path / "transactions.csv").write_text(TXN_HEAD + "\n")
    (tmp_path / "user_logs.csv").write_text("msno,date\nx,1\n")
    report = raw.convert_all(spark, str(tmp_path), only=["transactions", "user_logs"])
    assert report["transactions"] == "converted" and report["user_logs"].startswith("failed")
    empty = spark.read.parquet(f"{tmp_path}/transactions.parquet")
    assert empty.count() == 0 and empty.columns == DATASETS["transactions"].names
    with pytest.raises(FileNotFoundError):
        raw.read_parts(spark, [f"{tmp_path}/none.parquet"], ["msno"])
    assert raw.read_truth(spark, f"{tmp_path}/none.csv") is None


def test_stage_and_key_cache(spark, tmp_path):
    built = []

    def build(n):
        def go():
            built.append(n)
            return spark.range(n).withColumn("part", F.col("id") % 2)
        return go

    path = f"{tmp_path}/stage"
    assert stage(spark, path, build(4), ["part"]).count() == 4
    assert stage(spark, path, build(9)).count() == 4
    (tmp_path / "stage" / "_SUCCESS").unlink()                     # an unfinished table is rebuilt
    assert stage(spark, path, build(9)).count() == 9
    keyed = spark.range(5)
    where = f"{tmp_path}/cache"
    assert [cached_by_keys(spark, where, k, ["id"], build(5))[1] for k in (keyed, keyed.repartition(3), spark.range(1, 6))] == [
        False, True, False]
    assert built == [4, 9, 5, 5]


def test_sweep_store_and_reports(spark, tmp_path):
    store = SweepStore(spark, str(tmp_path))
    assert not store.has("s") and store.load("s") is None
    trials = spark.createDataFrame([("0", 3, 0.5), ("1", 9, 0.7), ("2", 6, 0.7)], "trial string, depth int, macro_f1 double")
    store.save("s", trials, ["depth"], seed=42)
    assert store.load("s") == {"name": "s", "best_score": 0.7, "best_params": {"depth": 9}, "meta": {"seed": 42}}
    assert store.trials("s").count() == 3
    write_report(trials, f"{tmp_path}/report")
    assert read_report(spark, f"{tmp_path}/report", trials.schema.simpleString()[7:-1].replace(":", " ")).count() == 3


def test_contract(spark, tmp_path, sf_dir):
    from renewscope.sources.adapters import orders_study

    study = orders_study(spark, sf_dir)
    events = engineered_events(study)
    contract = FeatureContract.of(events.columns, study.cfg)
    assert len(contract.base_features) == 29 and len(contract.feature_list("horizon")) == 20
    assert len(contract.leakage_cols) == 15
    contract.save(f"{tmp_path}/contract.json", n_events=3)
    assert FeatureContract.load(f"{tmp_path}/contract.json") == contract
    need = contract.needed_columns("base+horizon", ["msno", "post_rate"])
    assert len(need) == len(set(need)) and need[:3] == ["msno", "E", "expiry_month"] and need[-1] == "post_rate"
    x = project_features(events, contract, study.cfg, "base")
    assert x.columns == contract.base_features and dict(x.dtypes)["registration_init_time"] == "double"
    with pytest.raises(ValueError, match="leaking"):
        contract.assert_no_leak(["pre_rate", "vol_ratio"])
    with pytest.raises(ValueError):
        contract.feature_list("all")


def test_stale_mark_does_not_outlive_its_table(spark, tmp_path):
    """A rebuild that breaks off, then a return to the old keys: the table is built again."""
    path = f"{tmp_path}/cache"
    one, two = (spark.createDataFrame([(i,)], "k int") for i in (1, 2))
    assert not cached_by_keys(spark, path, one, ["k"], lambda: one)[1]

    def breaks():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        cached_by_keys(spark, path, two, ["k"], breaks)
    table, reused = cached_by_keys(spark, path, one, ["k"], lambda: one)
    assert not reused and table.first()["k"] == 1


def test_usage_view_is_dealt_by_size(spark, tmp_path, monkeypatch):
    """A large view is joined and aggregated in partitions by its stored size, not in the few that
    Spark merges them into; the rows are the same."""
    orders = spark.createDataFrame([(k, k % 5 if k % 7 else None) for k in range(40)], "o_orderkey long, o_custkey long")
    day = "timestamp'1997-01-01' + make_dt_interval(id % 3)"
    lines = spark.range(400).selectExpr(
        "id % 45 AS l_orderkey", f"IF(id % 11 = 0, NULL, {day}) AS l_shipdate", "CAST(id % 4 AS double) AS l_quantity",
        "IF(id % 2 = 0, 'A', 'N') AS l_returnflag", "id % 6 AS l_partkey")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    paths = [f"{tmp_path}/orders.parquet", f"{tmp_path}/lineitem.parquet"]
    stored = sum(f.stat().st_size for p in paths for f in Path(p).iterdir() if not f.name.endswith(".crc"))
    assert stored_bytes(spark, *paths) == stored
    assert adapters.usage_pieces(spark, *paths) is None
    monkeypatch.setattr(adapters, "PIECE_BYTES", stored // 30)
    pieces = adapters.usage_pieces(spark, *paths)
    assert 30 <= pieces <= 32
    tables = [spark.read.parquet(p) for p in paths]
    small, large = adapters.orders_usage(*tables), adapters.orders_usage(*tables, pieces)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert large.rdd.getNumPartitions() == pieces > small.rdd.getNumPartitions()
