"""Pipeline stages on streams: preparation is map-only, collapsing keeps bounded state by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairloom.config import PipelineConfig
from pairloom.operators.primers import Primers
from pairloom.plans.pipelines import prepare


def read_stream(spark: SparkSession, folder: str, schema: StructType, files: int = 16) -> DataFrame:
    """Parquet files of read pairs as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def prepared(pairs: DataFrame, found: Primers, config: PipelineConfig | None = None) -> DataFrame:
    """The preparation of a batch, on a stream: no state at all."""
    return prepare(pairs, found, config or PipelineConfig())


def first_deliveries(pairs: DataFrame, time: str = "received_at", delay: str = "7 days") -> DataFrame:
    """Each cluster of a job once, however often it is delivered within ``delay``: state is dropped beyond it."""
    named = pairs.withColumn("cluster", F.substring_index("read_name_first", " ", 1)).where("job_id is not null and cluster is not null")
    return named.withWatermark(time, delay).dropDuplicatesWithinWatermark(["job_id", "cluster"])


def window_counts(pairs: DataFrame, keys: list[str], time: str = "received_at", size: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Rows of each key in each window of time; late rows count up to ``delay``."""
    return pairs.withWatermark(time, delay).groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n_rows"))
