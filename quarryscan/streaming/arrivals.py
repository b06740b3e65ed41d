"""Files that arrive in a folder, scanned batch by batch. An extension: the survey's engine has no stream of data.

Each micro-batch goes through the rule engine; its findings replace the folder of its batch number, so that a batch that is
run again after a failure leaves one copy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quarryscan.operators import rules

FILES = "artifact_id string, file_ord int, path string, content string, language string, is_decompiled boolean"


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, book: Sequence[rules.Rule] = rules.RULES, available_now: bool = True, most_files: int = 100) -> StreamingQuery:
    """Scan Parquet files of FILES as they arrive in `folder`; findings go to `out`/batch=N."""
    arriving = spark.readStream.schema(FILES).option("maxFilesPerTrigger", most_files).parquet(folder)

    def scanned(batch: DataFrame, number: int) -> None:
        rules.findings(batch, book).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = arriving.writeStream.foreachBatch(scanned).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
