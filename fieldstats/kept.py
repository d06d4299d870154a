"""Tables that are computed once and read by several jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder of ``spark.checkpoint.dir``.

    Every executor can read that folder, so a lost executor costs no more than a second
    reading. The files go when nothing uses the table any longer, if the session says so
    (``spark.cleaner.referenceTracking.cleanCheckpoints``, as ``get_session`` does). Where the
    session names no folder (one machine, as in tests) a temporary one is set.
    """
    context = df.sparkSession.sparkContext
    if context.getConf().get("spark.checkpoint.dir") is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="kept-"))
    return df.checkpoint()
