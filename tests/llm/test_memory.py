"""What executors hold between tasks: Python workers hand back what they freed, and a full collection reaches executors."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

REPO = Path(__file__).parents[2]
BEGIN = """
import os, time
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession, functions as F

from redactory.llm import substrings
from redactory.llm.session import settled


def held(pid):  # MB of anonymous memory
    return int(Path(f"/proc/{pid}/status").read_text().split("RssAnon:")[1].split()[0]) / 1024


def session(**conf):
    conf = {"spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1"} | {k.replace("_", "."): v for k, v in conf.items()}
    return SparkSession.builder.config(map=conf).getOrCreate()
"""


def told(script, folder):
    """The numbers that a session of its own prints behind HELD."""
    home = folder / "home"  # executors keep their folders under Spark's home
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"PYTHONPATH": str(REPO), "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "MARK": folder.name}
    done = subprocess.run([sys.executable, "-c", BEGIN + script], env=env, cwd=folder, capture_output=True, text=True, timeout=240)
    assert "HELD " in done.stdout, done.stderr[-2000:]
    return [float(x) for x in done.stdout.split("HELD ")[1].split("\n")[0].split()]


def test_workers_hand_memory_back(tmp_path):
    """A chunk of 22 MB is read; the workers that stay for the next task hold little of it."""
    (most,) = told(
        """
substrings.LEAST_CHUNKS, substrings.CHUNK_BYTES = 1, 64 << 20
spark = session(spark_master="local[4]", spark_sql_shuffle_partitions="4")
rng, words = np.random.default_rng(5), np.array([f"w{k}" for k in range(50_000)])
docs = spark.createDataFrame([(k, " ".join(words[rng.integers(0, len(words), 400)])) for k in range(9000)], "doc_id long, text string")
assert substrings.deduplicated(docs).where("length(text) > 0").count() == 9000
pids = spark.range(0, 64, 1, 16).select(F.udf(lambda _: os.getpid(), "int")("id").alias("pid")).distinct().collect()
print("HELD", max(held(r.pid) for r in pids))
""",
        tmp_path,
    )
    assert most < 150


def test_executors_are_collected(tmp_path):
    """A job leaves garbage in an executor's heap; settled() has it given back."""
    before, after = told(
        """
spark = session(spark_master="local-cluster[1,1,1024]", spark_executor_memory="1g", spark_sql_shuffle_partitions="1", spark_executor_extraJavaOptions="-XX:+UseG1GC -Dmark=" + os.environ["MARK"])
held_ids = F.collect_list(F.sha2(F.col("id").cast("string"), 256)).alias("h")
spark.range(0, 3_000_000, 1, 2).groupBy((F.col("id") % 8).alias("k")).agg(held_ids).select(F.size("h")).collect()
line = lambda p: (p / "cmdline").read_bytes()
(pid,) = [int(p.name) for p in Path("/proc").glob("[0-9]*") if b"/java\\0" in line(p) and b"CoarseGrainedExecutorBackend" in line(p) and ("-Dmark=" + os.environ["MARK"]).encode() in line(p)]
before = held(pid)
settled(spark)
time.sleep(1)
print("HELD", before, held(pid))
""",
        tmp_path,
    )
    assert before > 400 and after < 0.7 * before
