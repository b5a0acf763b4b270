"""Tables of an embedded database, on executors that are processes of their own."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest
from comparing import SF

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CLUSTER = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate()
rows = e.queries()["ext_database_table"](spark, sys.argv[2])
wanted = spark.read.parquet(sys.argv[2] + "/supplier.parquet").where("s_suppkey > 3").select("s_suppkey", "s_name")
print("rows", rows.count() - wanted.count(), wanted.exceptAll(rows).count())
spark.stop()
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_database_table_on_executors(tmp_path):
    import pyspark

    home = tmp_path / "home"  # the executors' logs go to work in Spark's home
    home.mkdir()
    for name in os.listdir(at := os.path.dirname(pyspark.__file__)):
        if name != "work":
            (home / name).symlink_to(os.path.join(at, name))
    (tmp_path / "shared").mkdir()
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    env = {k: v for k, v in env.items() if k != "PYSPARK_GATEWAY_PORT" and k != "PYSPARK_GATEWAY_SECRET"}
    ran = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path / "shared"), SF], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 0 0" in ran.stdout, ran.stderr[-2000:]


def test_odd_values(spark, tmp_path):
    from cartulary.sources import jdbc

    values = [(1, None, 1.5), (2, "", None), (None, ' a,"b"\n c ', 0.0), (4, "é€\U0001f600", -1.0), (5, "NULL", 2.0)]
    rows = spark.createDataFrame(values, "k bigint, t string, d double")
    url = jdbc.embedded(rows.repartition(3), f"file://{tmp_path}/b", "prova")
    got = jdbc.read_table(spark, url, "prova", jdbc.EMBEDDED, "k", 2)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, values))
    none = jdbc.embedded(rows.where("k > 9"), f"file://{tmp_path}/c", "prova")
    assert jdbc.read_table(spark, none, "prova", jdbc.EMBEDDED, "k", 2).count() == 0
    with pytest.raises(ValueError):
        jdbc.embedded(rows, "hdfs://x/y", "prova")
