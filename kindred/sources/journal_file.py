"""An append-only journal of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("sequence", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("track", T.StringType()), T.StructField("payload", T.StringType())])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All events by sequence; none where there is no journal. A broken line is an error."""
    return _lines(spark, path).orderBy("sequence") if _exists(spark, path) else spark.createDataFrame([], SCHEMA)


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The journal as a stream; the checkpoint of the query is the watermark."""
    return spark.readStream.schema(SCHEMA).json(path)


def append_pending(events: DataFrame, path: str) -> int:
    """Appends the events behind the journal's last sequence and returns how many these are."""
    spark = events.sparkSession
    mark = (_lines(spark, path).agg(F.max("sequence")).first()[0] or 0) if _exists(spark, path) else 0
    pending = events.select(*SCHEMA.names).where(F.col("sequence") > mark)
    n = pending.count()
    if n:
        pending.orderBy("sequence").write.mode("append").json(path)
    return n
