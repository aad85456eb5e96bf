"""File arrival and deletion messages as streams."""

from __future__ import annotations

import hashlib
import queue
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.jobs import deleted_keys
from factloom.plans.ingest import ingest
from factloom.sources.headers import ParseError
from factloom.sources.tables import committed_versions, drop_versions, purge_version

TRIES = 3
# The message of a file that kept failing, and the columns of a listed file.
FAILED = "Processing failed unexpectedly. Try uploading the file again."
LISTING = "path string, modificationTime timestamp, length long, content binary"
OUTCOME = "dataset_id string, path string, status string, attempts int, message string"


def dataset_key(path: str) -> str:
    """A stable id per file, so that a repeated batch overwrites its own output."""
    return hashlib.sha256(path.encode()).hexdigest()[:24]


def ingest_one(spark: SparkSession, path: str, folder: str, run: Callable = ingest) -> tuple:
    """One file with up to three tries. A problem with the file itself is final."""
    key = dataset_key(path)
    for attempt in range(1, TRIES + 1):
        try:
            run(spark, path, folder, key)
            return key, path, "ready", attempt, None
        except ParseError as error:
            return key, path, "failed", attempt, str(error)
        except Exception:
            if attempt == TRIES:
                return key, path, "failed", attempt, FAILED
    raise AssertionError("unreachable")


def ingest_stream(
    spark: SparkSession,
    incoming: str,
    folder: str,
    checkpoint: str,
    files_per_batch: int = 16,
    run: Callable = ingest,
    workers: int = 4,
) -> StreamingQuery:
    """Every new raw file is ingested once; a bad file does not stop the others.

    The stream carries file names only: the content column is pruned, so no file is
    read to notice it. Files of other types are left alone. At most ``workers`` files of a batch are ingested at a time,
    each under a scheduler pool of its own, so that jobs of small files do not queue behind those of a large one where the
    cluster schedules fairly. Outcomes are kept under ``<folder>/outcomes``, each written as soon as its file is done;
    a repeated batch overwrites its own.
    """
    names = (
        spark.readStream.format("binaryFile")
        .schema(LISTING)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(incoming)
        .select("path")
        .filter(F.lower("path").rlike(r"\.(csv|xlsx)$"))
    )

    def handle(batch: DataFrame, epoch: int) -> None:
        slots: queue.SimpleQueue[int] = queue.SimpleQueue()
        for slot in range(workers):
            slots.put(slot)

        def one(path: str) -> None:
            slot = slots.get()
            try:
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"ingest-{slot}")
                outcome = ingest_one(spark, path, folder, run)
                table = spark.createDataFrame([outcome], OUTCOME).coalesce(1)
                table.write.mode("overwrite").parquet(f"{folder}/outcomes/batch={epoch}/file={outcome[0]}")
            finally:
                slots.put(slot)

        # At most ``files_per_batch`` names. A failed write of an outcome fails the batch, once the other files are done.
        with ThreadPoolExecutor(workers) as pool:
            done = [pool.submit(one, r["path"]) for r in batch.orderBy("path").collect()]
        for future in done:
            future.result()

    return (
        names.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def purge_stream(
    messages: DataFrame, folder: str, column: str, checkpoint: str, payload: str = "data"
) -> StreamingQuery:
    """E6 on a stream: each batch of deletion messages gives the table under
    ``folder`` a version without the deleted keys, in which only the files that held
    any are new, and removes what older versions alone need.

    The newest version written to the end is the table. A batch writes a version of
    its own name, so a batch that stopped anywhere and runs again finds either its
    version complete, and only removes the others, or the table as it was.
    """
    spark = messages.sparkSession

    def handle(batch: DataFrame, epoch: int) -> None:
        keys = deleted_keys(batch, payload).persist()
        try:
            if not keys.isEmpty():
                query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "purge"
                own, versions = f"{query}-{epoch}", committed_versions(spark, folder)
                done = next((v for v in versions if v.endswith(f"/version={own}")), None)
                if done is None:
                    done = purge_version(spark, folder, column, keys, own)
                if done:
                    drop_versions(spark, folder, done)
        finally:
            keys.unpersist()

    return (
        messages.select(F.col(payload))
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
