import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from talweg.session import clear_cuts, cut, spread


def test_cuts_keep_rows_and_types_and_can_be_cleared(spark):
    df = spark.range(5).select(F.col("id"), F.array(F.lit("x")).alias("a"), F.lit(None).cast("string").alias("n"))
    kept = cut(df)
    assert kept.dtypes == df.dtypes and sorted(kept.collect()) == sorted(df.collect())
    assert cut(df.limit(0)).count() == 0
    assert clear_cuts(spark) >= 2 and clear_cuts(spark) == 0


def test_spread_only_small_inputs(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == cores
    many = spark.range(100, numPartitions=cores * 3)
    assert spread(many) is many


def test_what_is_shuffled_already_is_not_run_to_count_its_partitions(spark):
    shuffled = spark.range(100).groupBy("id").count()
    assert spread(shuffled) is shuffled


PLAIN = """
from talweg.session import cut, local_session
spark = local_session(cores="1", shuffle_partitions=1)
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert cut(spark.range(3)).count() == 3
"""
NO_FOLDER = """
from talweg.session import shared_folder
class Conf:
    get = staticmethod(lambda *a: None)
class Context:
    master = "spark://somewhere:7077"
class Session:
    conf, sparkContext = Conf, Context
shared_folder(Session)
"""


@pytest.mark.parametrize("script, error", [(PLAIN, ""), (NO_FOLDER, "set spark.checkpoint.dir")])
def test_without_any_configuration(tmp_path, script, error):
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK")} | {"SPARK_CONF_DIR": str(tmp_path)}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", script], env=env, cwd=root, capture_output=True, text=True, timeout=200)
    assert (run.returncode != 0 and error in run.stderr) if error else run.returncode == 0, run.stderr
