"""What lies on disk while tables and corpora are written and read."""

import glob
import os
import time

from pyspark.sql import functions as F

from treeq.queries import QUERIES
from treeq.sources import conllu
from treeq.sources.stored import dropped, stored


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {f for f in files.mkString("\n").split("\n") if "shuffle_" in f}


def test_stored_tables_leave_no_shuffle_files(spark, tmp_path):
    before, name = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    df = spark.range(1000).repartition(3, "id").withColumn("text", F.col("id").cast("string"))
    back = stored(df, str(tmp_path / "t"))
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert spark.conf.get(name) == "false"
    assert sorted(back.collect()) == sorted(df.collect())
    dropped(spark, str(tmp_path / "t"))
    assert not (tmp_path / "t").exists()


def test_compressed_corpora(spark, tmp_path):
    """Lines written in compressed files read back as what they were, in order, and nothing else is left."""
    block = "# sent_id = {0}\n1\tw{0}\t_\tX\t_\t_\t0\troot\t_\t_"
    lines = spark.createDataFrame([(block.format(i), f"s{i % 2}", i) for i in range(300)], "value string, source string, at long")
    path = str(tmp_path / "out")
    conllu.write_blocks(lines.orderBy(F.xxhash64("at")), path, position="at", per_file=50, compression="gzip")
    files = glob.glob(f"{path}/source=*/*.txt*")
    assert len(files) > 4 and all(f.endswith(".txt.gz") for f in files) and os.listdir(tmp_path) == ["out"]
    back = conllu.read_corpus(spark, path, strict=True).select("source", "sent_no", "sent_id").collect()
    assert sorted(map(tuple, back)) == sorted((f"s{i % 2}", i // 2, str(i)) for i in range(300))


def test_texts_are_not_exchanged_to_be_numbered(spark, small):
    """Only counts of splits are exchanged when a corpus is read."""
    text = QUERIES["sink_corpus"](spark, small)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_tables_of_tokens_leave_no_shuffle_files(spark, small):
    """By the time a table of tokens is asked, what dealt its sentences is gone."""
    before = shuffle_files(spark)
    QUERIES["table_values"](spark, small)
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
