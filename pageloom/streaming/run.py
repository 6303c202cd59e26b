"""Run a stream over what its source holds now, into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pageloom.session import DEFAULTS, scratch_path


def stream_table(spark: SparkSession, path: str, schema, files_per_batch: int | None = None,
                 bytes_per_batch: int = 1 << 30) -> DataFrame:
    """Stream of the Parquet files of a folder (a glob works too), in batches of bounded size.

    The bound also limits the rows of one key that are put in order at a time.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    else:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(path)


STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_available(stream: DataFrame, name: str, close: Callable[[], None] | None = None) -> DataFrame:
    """Process all available input once, then read the result back.

    ``close`` adds the last input, such as a row that moves the watermark past all others; the
    stream then goes on from its checkpoint. Output and stream checkpoint go to the shared
    folder. Keyed state needs the RocksDB provider, which is set for the session.
    """
    spark = stream.sparkSession
    spark.conf.set(STATE_PROVIDER, DEFAULTS[STATE_PROVIDER])
    out = scratch_path(spark, name)

    def run() -> None:
        query = (
            stream.writeStream.format("parquet").outputMode("append")
            .option("path", out).option("checkpointLocation", out + "-state")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()

    run()
    if close:
        close()
        run()
    return spark.read.schema(stream.schema).parquet(out)
