"""What a Python worker holds doesn't grow with the table or the number of rows in a batch."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill import batches
from leafmill.operators import models, provenance
from leafmill.plans import adapters

MOST = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_slices_are_bounded_and_whole():
    texts = ["x" * (k * 37 % 900) for k in range(3000)] + ["y" * 50_000, None, ""]
    given = [pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([[t, "z"] if t else None for t in texts])], ["k", "s", "l"]), pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.list_(pa.string()))], ["k", "s", "l"])]
    made = list(batches.slices(iter(given), 10_000))
    assert [x for b in made for x in b.to_pylist()] == given[0].to_pylist()
    assert len(made) > 100 and max(b.nbytes for b in made if len(b) > 1) <= 10_000


def test_setting_comes_back(spark):
    default = spark.conf.get(MOST)
    with pytest.raises(ValueError), batches.small(spark, 5):
        assert spark.conf.get(MOST) == "5"
        raise ValueError
    assert spark.conf.get(MOST) == default and MOST not in spark.conf.getAll
    spark.conf.set(MOST, "12345678")
    with batches.small(spark):
        pass
    assert spark.conf.get(MOST) == "12345678"
    spark.conf.unset(MOST)


def test_workers_get_small_batches(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")

    def spied(given):
        for b in given:
            with open(log, "a") as f:
                f.write(f"{b.nbytes}\n")
            yield from batches.slices(iter([b]))

    monkeypatch.setattr(models, "slices", spied)
    monkeypatch.setattr(provenance, "slices", spied)
    d = spark.range(400, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(". ")), 5000), F.lit("the passage it holds")).alias("text"))
    d.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "the passage it holds")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    raw = adapters.table(spark, str(tmp_path), "documents").select("doc_id", F.col("text").alias("raw_text"))
    found = provenance.node_counts(provenance.provenance(adapters.document_nodes(spark, str(tmp_path)), adapters.asked_pairs(spark, str(tmp_path)), raw))
    assert sorted((r.doc_id, r.item_id, r.n_nodes) for r in found.collect()) == sorted([(k, 7, 1) for k in range(400)] + [(k, -1, 0) for k in range(400)])
    sizes = [int(x) for x in open(log)]
    assert sum(sizes) > 40_000_000 and max(sizes) < batches.BATCH + 200_000
