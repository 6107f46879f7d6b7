"""What one task holds doesn't grow with the table."""

import pyarrow.parquet as pq
import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from leafmill.operators import tables
from leafmill.plans import adapters, catalogue

LINES = "doc_id bigint, self_ref string, row int, texts array<string>, column_header boolean"
ORDER_QUERIES = ["bbox_iou", "best_spatial_match", "phrase_merge", "table_cells", "table_label_counts", "table_plain_text", "table_positional_text"]


def test_row_cells_are_those_of_cell_rows(spark):
    rows = [(d, "#/tables/0", r, [None, " 　", f" a{r} ", "", f"b{d}"][d % 3 :][: 1 + (r or 7) % 5], None if r is None else r == 0) for d in range(40) for r in [0, 2, 1, 9, 5, None]]
    lines = spark.createDataFrame(rows + [(99, "#/tables/0", 0, ["", None], True), (None, "#/tables/0", 3, ["x", "y"], False)], LINES)
    c = lines.select("doc_id", "self_ref", "row", "column_header", F.posexplode("texts").alias("col", "text"))
    cells = c.select(
        "doc_id", "self_ref", (F.col("row") * 9 + F.col("col")).alias("pos"), "text", "column_header", ((F.col("col") == 0) & ~F.col("column_header")).alias("row_header"), F.lit(False).alias("row_section"),
        F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), "row", "col", (-F.col("row")).cast("double").alias("t"), F.col("col").cast("double").alias("l"),
    )
    made = tables.row_cells(lines)
    assert spark_rows(made) == spark_rows(tables.cell_rows(cells)) and made.dtypes == tables.cell_rows(cells).dtypes


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_orders_get_more_partitions_as_they_grow(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(adapters, "TASK_BYTES", 4000)
    found = adapters.order_lines(spark, sf_dir)
    assert found.rdd.getNumPartitions() > 10
    monkeypatch.setattr(adapters, "TASK_BYTES", 2000)
    assert adapters.order_lines(spark, sf_dir).rdd.getNumPartitions() > 1.8 * found.rdd.getNumPartitions()


def test_cells_are_not_sorted(spark, sf_dir):
    plan = _plan(catalogue.table_cells(spark, sf_dir))
    assert plan.count("Sort [") == 1 and plan.count("Exchange ") == 1  # of rows, for their aggregation
    assert plan.index("Generate ") < plan.index("Window ")  # the plan's last step first


@pytest.mark.parametrize("name", ORDER_QUERIES)
def test_orders_in_many_partitions(spark, sf_dir, tmp_path, name, monkeypatch):
    monkeypatch.setattr(adapters, "TASK_BYTES", 10_000)
    t = pq.read_table(f"{sf_dir}/lineitem.parquet")
    pq.write_table(t.slice(0, 3000), tmp_path / "lineitem.parquet")
    assert spark_rows(catalogue.queries()[name](spark, str(tmp_path))) == duck_rows(catalogue.oracle_sql()[name], str(tmp_path))
