"""The stateless operators over streams: the same expressions under ``readStream``, with re-deliveries dropped by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from primeloom.functions import text as X
from primeloom.sources import storage
from primeloom.sources.schemas import SCHEMAS


def explication_stream(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(SCHEMAS["explications"]).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def legality_stream(explications: DataFrame, delay: str = "30 days") -> DataFrame:
    """Counts of each explication once: a re-delivery within ``delay`` of the first is dropped, older keys leave the state."""
    once = explications.where("expl_id IS NOT NULL").withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["expl_id"])
    counts = X.legality(F.col("toks"))
    return once.withColumn("toks", X.tokens(F.col("text"))).select("expl_id", F.lower(F.trim("model")).alias("model"), *[c.alias(n) for n, c in counts.items()])


def run_available(stream: DataFrame) -> DataFrame:
    """All input there is, run as a stream into a table of the shared folder, with its state and progress beside it, and read."""
    spark = stream.sparkSession
    path = storage.new_path(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
