"""Queries that replay a table as a stream and compare with what a batch says."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroborate.operators.lineage import new_folder
from corroborate.plans import bindings as B
from corroborate.streaming.items import running_scores


def replayed_scores(spark, d):
    """Evidence as a stream of files out of order, some of them twice: the last scores of each claim."""
    at = new_folder(spark, "stream")
    e = B.evidence(spark, d)
    # files by a hash of the item: early and late items of a claim mix; a quarter comes again
    e.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(4))).repartition("part").drop("part").write.parquet(f"{at}/in")
    e.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == 0).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    keep = lambda rows, n: rows.write.mode("overwrite").parquet(f"{at}/out/batch={n}")
    query = running_scores(stream, B.registry(spark)).writeStream.outputMode("update").foreachBatch(keep)
    query.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{at}/out").groupBy("claim_id").agg(F.max_by(F.struct("n", "support", "refute", "verdict"), "n").alias("x"))
    return last.select("claim_id", "x.*")


QUERIES = {
    "replayed_scores": (replayed_scores, f"WITH {B.SCORES}, k AS (SELECT claim_id, count(*) AS n FROM items GROUP BY 1) SELECT claim_id, n, support, refute, {B.VERDICT} AS verdict FROM scores JOIN k USING (claim_id)"),
}
