"""What the pipeline's stages leave of an executor's memory, on a cluster of one executor in a process of its own."""

from __future__ import annotations

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

RUN = """
import sys
from pathlib import Path
from pyspark.sql import SparkSession
import corpus_pipeline

home = sys.argv[1]
conf = {"spark.master": "local-cluster[1,1,1200]", "spark.executor.memory": "1000m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{home}/shared"}
spark = SparkSession.builder.config(map=conf).getOrCreate()

def executor_mb():
    for p in Path("/proc").glob("[0-9]*"):
        try:
            command = (p / "cmdline").read_text().split("\\0")
            if command[0].endswith("java") and any("CoarseGrainedExecutorBackend" in x for x in command) and home in (p / "environ").read_text():
                return int((p / "status").read_text().split("VmRSS:")[1].split()[0]) // 1024
        except OSError:
            pass

rows = spark.range(0, 3_000_000, 1, 4).selectExpr("id % 1000003 AS k", "repeat(cast(id AS string), 20) AS s")
rows.groupBy("k").agg({"s": "max"}).write.format("noop").mode("overwrite").save()
before = executor_mb()
docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
corpus_pipeline.mix_sources(spark, docs, "")
print("MB", before, executor_mb())
"""


def test_stage_begins_with_less_memory(tmp_path):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():  # executors' logs go to work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"PYTHONPATH": str(ROOT), "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYSPARK_PYTHON": sys.executable}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    run = subprocess.run([sys.executable, "-c", RUN, str(home)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "MB" in run.stdout, run.stderr[-2000:]
    before, after = map(int, run.stdout.split("MB")[1].split()[:2])
    assert after < before - 200, (before, after)
