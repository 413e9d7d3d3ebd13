"""Files and processes of what is written between steps, and what workers keep after it."""

import os
import subprocess
import sys

from strandline.llm import bpe, queries

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

RUN = """
import sys
from pyspark.sql import SparkSession
from strandline.llm.shared import settle

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).config("spark.sql.adaptive.coalescePartitions.enabled", "false").config("spark.sql.shuffle.partitions", "60").getOrCreate()
out = settle(spark.range(3000).selectExpr("id * 7 % 3000 as id").groupBy("id").count())
assert out.count() == 3000 and out.selectExpr("sum(id)").first()[0] == 3000 * 2999 // 2
"""


def test_few_processes_for_a_settled_table(tmp_path):
    """Each file of a local folder starts processes, which share the executor's memory until
    they run: 60 parts on two cores are written as 16 files, each with two (its folder, itself)."""
    log, own, shared = tmp_path / "log", tmp_path / "bin", tmp_path / "shared"
    own.mkdir()
    (own / "chmod").write_text(f'#!/bin/sh\necho "$@" >> {log}\nPATH=/usr/bin:/bin exec chmod "$@"\n')
    (own / "chmod").chmod(0o755)
    env = os.environ | {"PATH": f"{own}{os.pathsep}{os.environ['PATH']}", "PYTHONPATH": ROOT}
    subprocess.run([sys.executable, "-c", RUN, str(shared)], env=env, check=True, timeout=120)
    files = [f for _, _, names in os.walk(shared) for f in names if "part-" in f]
    assert 1 <= len(files) <= 16
    assert len(log.read_text().splitlines()) <= 2 * 16 + 10  # and some for the folders above and the mark of success


def test_digests_can_give_the_vocabulary_back(spark, data):
    path = queries.vocabulary("word_bpe_49k.json")
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40).coalesce(1)
    got = bpe.digests(docs, path, with_ids=True, keep=False)
    assert sorted(map(str, got.collect())) == sorted(map(str, bpe.digests(docs, path, with_ids=True).collect()))
    held = docs.select("doc_id", "text").toArrow().to_batches()
    run = {}

    class Frame:  # stands in for a DataFrame: keeps the function that workers run
        dtypes = [("doc_id", "bigint"), ("text", "string")]

        def selectExpr(self, *_):
            return self

        def mapInArrow(self, f, _):
            run["f"] = f
            return self

        def withColumnRenamed(self, *_):
            return self

    bpe.digests(Frame(), path, keep=False)
    assert sum(b.num_rows for b in run["f"](iter(held))) == sum(b.num_rows for b in held)
    assert path not in bpe._state
