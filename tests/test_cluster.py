"""Queries on a local cluster, where the driver and each executor are processes of their own."""

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from loomframe.plans import catalogue, catalogue_io  # noqa: F401  the second adds its queries to the first

SF = "/root/testdata/sf0.001"
RUN = """
import sys
from pyspark.sql import SparkSession
from loomframe.plans import catalogue, catalogue_io
name, sf, at = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.warehouse.dir": f"{at}/warehouse", "spark.checkpoint.dir": f"file://{at}/shared"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
try:
    catalogue.QUERIES[name](spark, sf).write.parquet(f"{at}/out")
finally:  # else what the cluster says of its end hides the error
    spark.stop()
"""


def on_cluster(name, sf, at):
    (at / "home" / "work").mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():  # the executors' folders go to work in Spark's home
        if p.name != "work":
            (at / "home" / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": f"{at}/home", "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": f"{at}/local", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    done = subprocess.run([sys.executable, "-c", RUN, name, str(sf), str(at)], env=env, cwd=at, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, "\n".join(x for x in done.stderr.splitlines() if not x.lstrip().startswith(("at ", "...")))[-3000:]
    return f"{at}/out/*.parquet"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_executors_read_the_database_that_the_driver_has_open(tmp_path):
    db, odd = duckdb.connect(), ["it's", 'a "b", c', "two\nlines", "two\r\nlines", " ", "", "é漢", "\\n"]
    (tmp_path / "in").mkdir()
    db.execute("create table odd as select unnest(?) as s_name, unnest(range(-8, 0)) as s_suppkey", [odd])
    db.sql(f"copy (select s_suppkey, s_name, s_nationkey, s_acctbal from '{SF}/supplier.parquet' union all select s_suppkey, s_name, 7::integer, s_suppkey / 3.0::double from odd) to '{tmp_path}/in/supplier.parquet' (format parquet)")
    db.sql(f"create view supplier as from '{tmp_path}/in/supplier.parquet'")
    want = db.sql(f"select label, s_name, input from ({catalogue.ORACLE['read_jdbc']}) order by label").fetchall()
    got = db.sql(f"select label, s_name, input from '{on_cluster('read_jdbc', tmp_path / 'in', tmp_path)}' order by label").fetchall()
    assert len(want) > len(odd) and got == want
