"""The registered queries next to their SQL, and the pipeline stage by stage."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from checks.compare import duck, normal
from tidewash.llm.queries import ORACLES, QUERIES

from .conftest import SF


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = normal(df.columns, df.collect())
    assert got[1]
    if name in ORACLES:
        cursor = duck(SF).execute(ORACLES[name])
        assert got == normal([d[0] for d in cursor.description], cursor.fetchall())


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert {*QUERIES, "pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_no_python_on_the_native_paths(spark):
    for name in ("op3_line_dedup", "op5_secrets"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


@pytest.fixture(scope="module")
def stages(spark):
    from tidewash.llm.common import staged

    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        kept.append((docs, staged(stage(spark, docs, SF))))
        docs = kept[-1][1]
    return kept


def test_stages_keep_columns_and_take_effect(stages):
    for before, after in stages[:-1]:
        assert before.columns == after.columns and before.dtypes == after.dtypes
    toxic, lines, near, mixed, packed = ([before.count(), after.count()] for before, after in stages)
    assert toxic[1] < toxic[0] and lines[1] == lines[0] and near[1] < near[0]


def test_toxic_documents_go(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = stages[0]
    left = after.join(labels, "doc_id").groupBy("toxic").count().collect()
    all_ = before.join(labels, "doc_id").groupBy("toxic").count().collect()
    left, all_ = ({r.toxic: r["count"] for r in x} for x in (left, all_))
    assert left.get(1, 0) <= 0.3 * all_[1] and left[0] >= 0.97 * all_[0]


def test_one_of_each_group_stays(stages):
    from .test_minhash import brute, plain_set

    before, after = stages[2]
    docs = sorted((r.doc_id, r.text or "") for r in before.collect())
    want = [i for k, ((i, _), (_, least)) in enumerate(zip(docs, brute([t for _, t in docs], 80, 5))) if k == least]
    empty = [i for i, t in docs if not plain_set(t, 5)]
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(want) - set(empty[1:]))


def test_mix_repeats_documents(stages):
    before, after = stages[3]
    times = Counter(r.doc_id for r in after.collect())
    assert max(times.values()) <= 3 and set(times) <= {r.doc_id for r in before.collect()}
    words = lambda df: df.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(words(after) - words(before)) <= 0.02 * words(before)


def test_every_document_is_packed(stages):
    before, after = stages[4]
    assert Counter(r.doc_id for r in after.where("piece = 0").collect()) == Counter(r.doc_id for r in before.collect())


def test_run_equals_the_stages(spark, stages):
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect())
    assert got == Counter(r.doc_id for r in stages[4][1].collect())


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_stage_deletes_what_the_last_one_staged(spark, tmp_path):
    from tidewash.llm import common

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, second = (stage for _, stage in corpus_pipeline.STAGES[1:3])
    lazy = first(spark, docs, SF)
    held = list(corpus_pipeline._leftovers.held)
    assert held and second(spark, lazy, SF).count() > 0  # not written: what it reads stays
    assert any(path in common._written for path in held)
    first(spark, docs, SF).write.parquet(str(tmp_path / "one"))
    held = list(corpus_pipeline._leftovers.held)
    second(spark, spark.read.parquet(str(tmp_path / "one")), SF)
    assert held and not any(path in common._written for path in held)


def test_near_copies_go_through_the_tree_of_fingerprints(spark, monkeypatch):
    from tidewash.llm import simhash

    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda prints, within=3, **options: asked.append((prints.count(), within)) or links(prints, within, **options))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    corpus_pipeline.drop_near_copies(spark, docs, SF).count()
    assert len(asked) == 1 and asked[0][0] > 50 and asked[0][1] == 3
