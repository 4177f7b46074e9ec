"""Incremental corpus append with Structured Streaming (K4-K6 as a stream).

The reference appends generated rows to a file and, on the next run, re-reads the file to
skip cases already done.  Here raw response files land in a folder; a streaming query with
a checkpoint picks up only files it has not processed (exactly-once per file, resumable
after a crash or a lost executor), normalises them into rows (fences, header line, field
count) and appends them to a Parquet sink in ``foreachBatch``.  The remaining queue is
then the batch anti join of the queue with the sink (``plans.corpus.queue_remaining``).
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from upkeep.plans.corpus import response_lines
from upkeep.session import checkpoint_dir


def response_stream(spark: SparkSession, raw_dir: str) -> DataFrame:
    """One row per raw response file: (batch_id = file path, response_text)."""
    return (spark.readStream.option("wholetext", True).text(raw_dir)
            .select(F.input_file_name().alias("batch_id"), F.col("value").alias("response_text")))


def _short(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()[:12]


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system; none if it does not exist."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def start_append(spark: SparkSession, raw_dir: str, sink_dir: str,
                 checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Normalise new response files and append their rows to ``sink_dir`` (Parquet).

    The checkpoint defaults to a folder of the sink's own under the session's
    ``spark.checkpoint.dir``.  Rows go to one folder per checkpoint and epoch; a replayed epoch
    overwrites its own folder only.  A sink that another checkpoint has written is refused: that
    stream would read all files again."""
    if checkpoint is None:
        checkpoint = os.path.join(checkpoint_dir(spark), "corpus_append", _short(sink_dir))
    run = f"run={_short(checkpoint)}"
    others = [f for f in _folders(spark, sink_dir) if f.startswith("run=") and f != run]
    if others:
        raise ValueError(f"{sink_dir} was written under another checkpoint ({others})")

    def write(batch: DataFrame, epoch: int) -> None:
        rows = response_lines(batch)
        rows.write.mode("overwrite").parquet(os.path.join(sink_dir, run, f"epoch={epoch}"))

    w = (response_stream(spark, raw_dir).writeStream.foreachBatch(write)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
