"""The usage roll-up run as a stream over table files."""

from pyspark.sql import functions as F

from renewscope.config import EVENTS_STUDY
from renewscope.plans.catalog import table_query
from renewscope.session import shared_dir
from renewscope.sources.adapters import table
from renewscope.streaming.rollup import current_totals, start_rollup

#: Files in which the table arrives: enough to fill a level of the roll-up.
FILES = 6


@table_query("streamed_usage_rollup", "msno date:d secs:g d_rows:i", """
SELECT CAST(user_id AS VARCHAR) AS msno, CAST(ts AS DATE) AS date,
  sum(least(greatest(value * 120, 0), 86400)) AS secs, count(*) AS d_rows
FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2""")
def streamed_usage_rollup(spark, sf_dir):
    """The table arrives in several files, by ranges of time; each is a micro-batch of its own, and full levels are merged."""
    events = table(spark, sf_dir, "events")
    arrived = shared_dir(spark, "arriving")
    events.repartitionByRange(FILES, "ts").write.parquet(arrived)
    arriving = (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(arrived)
        .where(F.col("event_type").isin("view", "click"))
        .select(F.col("user_id").cast("string").alias("msno"), F.to_date("ts").alias("date"),
                (F.col("value") * 120).alias("total_secs"))
    )
    target = shared_dir(spark, "rollup")
    start_rollup(arriving, target, shared_dir(spark, "rollup-progress"), EVENTS_STUDY).awaitTermination()
    return current_totals(spark, target).withColumn("secs", F.col("d_micros") / 1_000_000)
