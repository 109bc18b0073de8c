"""The folder of intermediate tables, in sessions of their own."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
WITHOUT_THE_SETTING = """
    from pyspark.sql import SparkSession
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    assert spark.conf.get("spark.checkpoint.dir", None) is None
    from pairlattice.llm import common, mixing, sharding
    docs = spark.createDataFrame([(i, f"some text {i}", "a") for i in range(20)], "doc_id long, text string, source string")
    assert mixing.plan_copies(docs).count() == sharding.plan_slots(docs).count() == 20
    folder = common.shared_folder(spark)
    assert folder == common.shared_folder(spark) and folder.startswith("file:///")
    with common.scope(spark):
        inner = common.written(docs)
        assert inner.count() == 20 and common.tables_folder(spark) != folder
        held = common.tables_folder(spark).removeprefix("file://")
    import os
    assert not os.path.exists(held)
    common.drop_written(spark)
    assert not os.path.exists(common.tables_folder(spark).removeprefix("file://"))
"""


def test_a_session_that_names_no_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(WITHOUT_THE_SETTING)], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert out.returncode == 0, out.stderr[-3000:]
