"""A session without any Spark defaults: the working folder, and that nothing of it stays."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import os, sys
import __spark_entry__ as entry
from formline.session import LOCAL_CONF, release, shared_dir
from pyspark.sql import SparkSession
builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
for k, v in LOCAL_CONF.items():
    builder = builder.config(k, v)
spark = builder.getOrCreate()
spark.sparkContext.setLogLevel("OFF")
base = os.path.dirname(shared_dir(spark, "x"))
rows = [entry.queries()[n](spark, sys.argv[1]).count() for n in ("error_scores", "stream_rollup")]
print("RESULT", min(rows) > 0, release(spark) > 0, len(os.listdir(base)) if os.path.isdir(base) else 0, base)
"""


def test_queries_without_a_configured_folder(sf, tmp_path):
    repo = Path(__file__).resolve().parent.parent
    (tmp_path / "conf").mkdir()
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK")} | {"PYTHONPATH": str(repo), "SPARK_CONF_DIR": str(tmp_path / "conf"), "TMPDIR": str(tmp_path)}
    said = subprocess.run([sys.executable, "-c", SCRIPT, sf], cwd=repo, env=env, capture_output=True, text=True, timeout=600)
    result = next((x for x in said.stdout.splitlines() if x.startswith("RESULT")), said.stderr[-2000:])
    assert result.startswith("RESULT True True 0 "), result
    if str(tmp_path) in result:
        assert not os.path.exists(result.split()[-1])  # an own folder goes with the process


BLOCKED = """
import sys, warnings
sys.modules["xxhash"] = None
warnings.simplefilter("ignore")
import __spark_entry__ as entry
print("RESULT", len(entry.queries()) >= 123, any(n.startswith("op") for n in entry.queries()))
"""


def test_a_missing_library_of_the_add_on_leaves_the_other_queries(tmp_path):
    """Also right where the add-on itself is missing: then there are no op queries in any case."""
    repo = Path(__file__).resolve().parent.parent
    said = subprocess.run([sys.executable, "-c", BLOCKED], cwd=repo, env=os.environ | {"PYTHONPATH": str(repo)}, capture_output=True, text=True, timeout=300)
    assert "RESULT True False" in said.stdout, said.stderr[-2000:]
