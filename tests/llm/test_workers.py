"""All operators from an empty folder, with workers that can't import the package."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def importable(batches):
    import importlib.util
    import pandas as pd
    for _ in batches:
        yield pd.DataFrame({"found": [importlib.util.find_spec("antipode") is not None]})

assert not any(r.found for r in spark.range(2).mapInPandas(importable, "found boolean").collect())
import __spark_entry__
queries = __spark_entry__.queries()
for name in sorted(n for n in queries if n.startswith("op") or n == "pipeline"):
    print(name, queries[name](spark, sys.argv[2]).count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path, sf):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    empty = tmp_path / "empty"
    empty.mkdir()
    done = subprocess.run([sys.executable, str(script), str(REPO), sf], cwd=empty, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split()) == 22 and all(int(n) > 0 for n in done.stdout.split()[1::2])
