from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from renewscope.llm.mixing import pareto_mix
from renewscope.llm.toxicity import toxicity, train
from renewscope.llm.toxicity_query import known_labels
from renewscope.session import through_table
from tests.llm.test_secrets import brute
from tests.llm.test_simhash import fingerprint, groups
from tests.llm.test_tokens import check_pieces

pipeline = pytest.importorskip("corpus_pipeline")
FUNCTIONS = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark, sf_dir, documents):
    """The rows after each stage."""
    out, docs = [documents], documents
    for name, stage in pipeline.STAGES:
        docs = through_table(stage(spark, docs, sf_dir), f"test-{name}")
        out.append(docs)
    return out


def test_stages(stages, documents):
    assert [n for n, _ in pipeline.STAGES] == ["drop_toxic", "deduplicate", "mask_secrets", "mix_sources", "pack"]
    assert all(df.columns == documents.columns for df in stages[:-1])


def test_toxic_documents_go(spark):
    sf_dir = "/root/testdata/sf0.01"
    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    score = toxicity(spark, train(before, known_labels(spark, sf_dir)), F.col("text"))
    want = {r["doc_id"] for r in before.where(score < 0.5).select("doc_id").collect()}
    assert {r["doc_id"] for r in FUNCTIONS["drop_toxic"](spark, before, sf_dir).collect()} == want
    assert 0.8 * before.count() < len(want) < before.count()


def test_one_of_each_group_stays(stages):
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in stages[1].collect()}
    ids = sorted(prints)
    root = groups([(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2], ids)
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(set(root.values()))


def test_secrets_go_and_documents_stay(stages):
    before, after = ({r["doc_id"]: r for r in df.collect()} for df in stages[2:4])
    assert before.keys() == after.keys()
    assert all(not brute(r["text"]) for r in after.values())
    assert all(r["text"] == before[d]["text"] for d, r in after.items() if not brute(before[d]["text"]))


def test_mix_takes_what_it_says(stages):
    want = Counter({r["doc_id"]: r["copies"] for r in pareto_mix(stages[3]).collect()})
    assert Counter(r["doc_id"] for r in stages[4].collect()) == +want


def test_pieces(stages):
    rows = stages[5].collect()
    check_pieces(rows)
    tokens, times = Counter(), Counter(r["doc_id"] for r in stages[4].collect())
    sizes = defaultdict(set)
    for r in rows:
        tokens[r["doc_id"]] += r["length"]
        sizes[r["doc_id"]].add(r["doc_tokens"])
    assert {d: n * next(iter(sizes[d])) for d, n in times.items()} == dict(tokens)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_odd_rows_pass_every_stage(spark, sf_dir, odd_docs, no_docs, name):
    stage = FUNCTIONS[name]
    out = stage(spark, odd_docs, sf_dir)
    assert out.count() > 0 and stage(spark, no_docs, sf_dir).count() == 0
    if name != "pack":
        assert out.columns == odd_docs.columns


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    rows = pipeline.run(spark, sf_dir)
    assert rows.columns == stages[-1].columns and rows.agg(F.sum("length")).first()[0] == stages[-1].agg(F.sum("length")).first()[0]
