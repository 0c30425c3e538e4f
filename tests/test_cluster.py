"""What holds on executors that are processes of their own, with a driver that is none of them."""

import subprocess
import sys

import pytest

STATIC = """
import sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from shiori.operators import embedding
from shiori.plans.catalog import made_up_model

conf = {"spark.master": "local-cluster[2,1,1024]", "spark.ui.enabled": "false", "spark.checkpoint.dir": "file://" + sys.argv[1], "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
models = [embedding.StaticEmbedder.shipped(spark, made_up_model(spark)) for _ in range(2)]
names = spark.createDataFrame([("small cold",), ("widget",)], "t string").repartition(2)
got = [sorted((r.t, tuple(r.v)) for r in names.select("t", embedding.embed(F.col("t"), m).alias("v")).collect()) for m in models]
assert got[0] == got[1] and len(got[0]) == 2 and got[0][0][1] != got[0][1][1]
print("embedded")
spark.stop()
"""


@pytest.mark.parametrize("program", [STATIC])
def test_on_executors_of_their_own(program, tmp_path):
    run = subprocess.run([sys.executable, "-c", program, str(tmp_path)], capture_output=True, text=True, timeout=240)
    assert "embedded" in run.stdout, run.stderr[-2000:]
