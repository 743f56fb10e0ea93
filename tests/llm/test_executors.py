"""On executors of their own, as on a cluster."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

ROOT = Path(__file__).resolve().parents[2]
SESSION = """
from pathlib import Path
import os, re, sys
from pyspark.sql import SparkSession
builder = SparkSession.builder.master("local-cluster[1,2,1800]").config("spark.executor.memory", "1800m")
builder = builder.config("spark.executor.extraJavaOptions", "-XX:ActiveProcessorCount=2").config("spark.ui.enabled", "false")
spark = builder.config("spark.driver.memory", "1g").config("spark.checkpoint.dir", sys.argv[1]).config("spark.ui.showConsoleProgress", "false").getOrCreate()
def of_executor(_):
    p = os.getpid()
    while "CoarseGrained" not in Path(f"/proc/{p}/cmdline").read_text():
        p = int(Path(f"/proc/{p}/stat").read_text().rsplit(")", 1)[1].split()[1])
    yield int(re.search("Pss_Anon: +([0-9]+)", Path(f"/proc/{p}/smaps_rollup").read_text())[1]) // 1024
def held():
    return spark.sparkContext.parallelize([0], 1).mapPartitions(of_executor).collect()[0]
"""


def on_executor(script: str, folder: Path) -> str:
    env = os.environ | {"PYTHONPATH": str(ROOT), "SPARK_HOME": str(Path(pyspark.__file__).parent), "SPARK_SCALA_VERSION": "2.13", "SPARK_WORKER_DIR": str(folder / "work"), "PYSPARK_PYTHON": sys.executable}
    got = subprocess.run([sys.executable, "-c", SESSION + script, f"file://{folder}/shared"], env=env, cwd=folder, capture_output=True, text=True, timeout=180)
    assert got.returncode == 0, got.stderr[-2000:]
    return got.stdout


def test_a_stage_begins_with_small_heaps(tmp_path):
    """What a stage grew the executors' heaps to isn't held beside the Python workers of the next."""
    script = """
import corpus_pipeline
spark.range(6_000_000).selectExpr("id", "sha2(string(id), 256) h").repartition(4, "h").sortWithinPartitions("h").selectExpr("min(h)", "collect_list(substr(h, 1, 3))[0]").collect()
grown = held()
docs = spark.createDataFrame([(1, "some text", "en", "a", 9)], "doc_id long, text string, lang string, source string, n_chars long")
corpus_pipeline.pack_sequences(spark, docs, "")
print(grown, held())
"""
    grown, after = map(int, on_executor(script, tmp_path).split()[-2:])
    assert grown > 1000 and after < grown / 2
