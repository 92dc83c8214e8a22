"""Executors need no installed package: queries run where only the driver can import the library."""

from __future__ import annotations

import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from panelloom.llm.queries import QUERIES
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
for name, query in QUERIES.items():
    print(name, query(spark, "/root/testdata/sf0.001").count())
"""


def test_every_query_from_another_folder(tmp_path):
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(done.stdout.split()) >= 20
