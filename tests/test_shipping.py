"""Python workers find the package when the session starts outside the repository."""

import os
import subprocess
import sys
from pathlib import Path

PROGRAM = """
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("contract", {entry!r})
contract = importlib.util.module_from_spec(spec)
spec.loader.exec_module(contract)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("neighbors_in_class", "csv_header_union", "boosted_attributions"):
    print(name, contract.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_run_from_another_folder(tmp_path):
    entry = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
    done = subprocess.run([sys.executable, "-c", PROGRAM.format(entry=str(entry))], cwd=tmp_path, capture_output=True,
                          text=True, timeout=300, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr[-2000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line)
    assert counts["neighbors_in_class"] == "2500" and counts["csv_header_union"] == "5"
