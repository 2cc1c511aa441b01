"""Cutting the lineage of iterative operators, and dealing rows to tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """The rows as a reliable checkpoint in the folder of ``spark.checkpoint.dir``, so that a round's plan stays short and
    a lost executor costs no earlier round. Only a local session without that setting gets a folder of its own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="gritmill-rounds-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over as many tasks as the session shuffles into, and no fewer than keep all cores busy: a small file is
    read by few tasks, in which rows that take long would wait for each other."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)
