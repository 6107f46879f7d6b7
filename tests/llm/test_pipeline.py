import corpus_pipeline
import pytest
from compare_llm import duck

from leafmill.llm import bpe, decontaminate, line_dup, near_dup, quality, queries
from leafmill.llm._store import written


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage was given and gave."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        got = written(stage(spark, docs, sf_dir))
        out.append((docs, got))
        docs = got
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_order_and_columns(stages):
    assert [int(n.split()[0]) for n, _ in corpus_pipeline.STAGES] == [1, 3, 10, 6, 7]
    for given, got in stages[:-1]:
        assert got.columns == given.columns and got.dtypes == given.dtypes


def test_each_stage_takes_effect(spark, sf_dir, stages):
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    (a, b), (_, c), (_, d), (_, e), (_, f) = stages
    assert ids(b) == sorted(r.doc_id for r in quality.selected(a, labels).collect()) and len(ids(b)) < len(ids(a))
    texts = {r.doc_id: r.text for r in line_dup.drop_boilerplate(b).collect()}
    assert {r.doc_id: r.text for r in c.collect()} == texts
    assert all(r.n_chars == len(r.text) for r in c.collect())
    gone = {r.doc_id for r in near_dup.near_duplicates(c).collect() if r.doc_id != r.group_id}
    assert ids(d) == [i for i in ids(c) if i not in gone]
    leaks = {r.doc_id for r in decontaminate.leaks(d, bench).collect()}
    assert ids(e) == [i for i in ids(d) if i not in leaks]
    own, text = bpe.codec(bpe.VOCABULARY), {r.doc_id: r.text for r in e.collect()}
    assert ids(f) == ids(e)
    for r in f.collect():
        assert r.exact and r.tokens == own.whole(text[r.doc_id]).tolist() and r.n_tokens == len(r.tokens)


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    key = lambda df: sorted((r.doc_id, r.tokens) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(stages[-1][1])


def test_queries_that_sql_expresses(spark, sf_dir):
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf_dir)
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(duck(sql, sf_dir, df.columns), key=repr)


def test_scratch_folder_is_the_sessions(spark):
    from leafmill.llm import _store

    assert _store.folder(spark) == spark.conf.get("spark.checkpoint.dir")
