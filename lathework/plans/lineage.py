"""Cutting lineage in storage that all executors share.

Iterative operators (connected components, closures) would otherwise build a
plan that doubles with every round.  ``cut`` writes the rows to the folder the
cluster names in ``spark.checkpoint.dir``; executors can be lost afterwards and
nothing has to be computed again.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    The setting of the session wins.  Only where it is unset, as in tests on one
    machine, a temporary folder is taken and removed at the end; on a cluster
    that is an error, because a folder of one machine is out of reach for the
    executors.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lathework-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return named


def cut(frame: DataFrame) -> DataFrame:
    """``frame``, computed once and read back from the shared folder."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)
