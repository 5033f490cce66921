"""Where intermediates go."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from bitext import ship, storage


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_the_setting_comes_first():
    assert storage.shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"


def test_local_mode_gets_one_folder_of_its_own():
    assert storage.shared_dir(session("local[4]")).startswith("file:///")
    assert storage.shared_dir(session("local[4]")) == storage.shared_dir(session("local[4]"))


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_the_setting(master):
    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(session(master))


def test_materialize_and_ship(spark):
    ship(spark)
    ship(spark)
    df = storage.materialize(spark.range(3), "numbers")
    assert df.count() == 3
    assert "numbers-" in df.inputFiles()[0]


def test_tables_in_buckets_are_grouped_and_joined_without_a_shuffle(spark):
    rows = spark.range(200).selectExpr("id % 20 AS doc_id", "id % 3 AS batch", "id AS pos")
    a, b = (storage.materialize_by(rows, name, "doc_id") for name in ("a-1", "b-1"))
    with storage.settings(spark, {**storage.BUCKETED, "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        joined = a.join(b.groupBy("doc_id", "batch").count(), ["doc_id", "batch"])
        assert joined.count() == 200
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("a_1", "b_1"))]
