"""Every operator runs where workers cannot import this package (functions and broadcasts carry what they need)."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]

# The driver knows the package by sys.path alone, which workers do not inherit.
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", sys.argv[1])
         .config("spark.sql.warehouse.dir", sys.argv[1] + "/warehouse").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
def importable(_):
    import importlib.util
    return [importlib.util.find_spec("ticketlens") is not None]
assert spark.sparkContext.parallelize([0], 1).mapPartitions(importable).collect() == [False]
sys.path.insert(0, sys.argv[2])
import __spark_entry__ as entry
for name, query in entry.queries().items():
    if name in sys.argv[3].split(","):
        query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        print("ran", name, flush=True)
"""


@pytest.mark.parametrize("names", [
    ("op1_sentencepiece", "op2_quality_rules", "op4_line_dedup", "op5_quality_classifier", "op6_sharding", "op8_chat_format",
     "op9_benchmark_decontamination", "op10_html_extraction"),
    ("op3_suffix_array_dedup", "op7_simhash_near_dedup", "op11_prefix_trie", "op12_ngram_jaccard_join", "op13_phrase_collocations",
     "pipeline"),
])
def test_workers_without_the_package(tmp_path, names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env["PYTHONDONTWRITEBYTECODE"] = "1"
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(tmp_path), str(ROOT), ",".join(names)], cwd=tmp_path, env=env, capture_output=True,
        text=True, timeout=900,
    )
    ran = {line.split()[1] for line in done.stdout.splitlines() if line.startswith("ran ")}
    assert ran == set(names), done.stderr[-3000:]
