"""Duplicates kept up to date as documents come: what a batch touches is read, replaced and checked again, and no more.

Two tables in buckets: the values of claims by claim, and by (field, norm), each with the findings of its values. A
claim's new values replace those it had, so a batch touches the buckets of its claims, and of the values that these had
and now have. A bucket is written anew below the batch's number and is current from the moment that the batch's list of
buckets is written, which is last. A batch that is done again reads what was current before it and writes the same
folders again, so nothing is lost or doubled, and a reader never sees half a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import duplicates as U

BUCKETS = 64
VALUE = "claim long, document long, page int, field string, value string, norm string"
FINDING = "claim long, document long, page int, code string, severity string, value string, others array<bigint>, n_others long"


class Buckets:
    """A table in numbered buckets, each with versions; root holds v=<batch>/bucket=<n> and the lists of batches."""

    def __init__(self, spark: SparkSession, root: str, schema: str, buckets: int):
        self.spark, self.root, self.schema, self.buckets = spark, root.rstrip("/"), schema, buckets

    def versions(self, before: int | None = None) -> dict[int, tuple[int, int]]:
        """Of each bucket its latest version before a batch and the rows in it; as many entries as buckets at most."""
        lists = self.spark.read.schema("bucket int, n long, batch long").option("basePath", f"{self.root}/lists").option("recursiveFileLookup", "false")
        try:
            rows = lists.parquet(f"{self.root}/lists")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return {}
            raise
        rows = rows if before is None else rows.where(F.col("batch") < before)
        last = rows.groupBy("bucket").agg(F.max_by(F.struct("batch", "n"), "batch").alias("v"))
        return {r["bucket"]: (r["v"]["batch"], r["v"]["n"]) for r in last.collect()}

    def read(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """Rows of some buckets, or all, as they were before a batch, or are now."""
        now = self.versions(before)
        paths = [f"{self.root}/v={v}/bucket={b}" for b, (v, n) in sorted(now.items()) if n and (buckets is None or b in set(buckets))]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, bucket: Column, touched: list[int], batch: int) -> None:
        """Rows are all that the touched buckets have from this batch on. Spreads each bucket over tasks by size."""
        out = rows.withColumn("bucket", bucket).hint("rebalance", "bucket")
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/v={batch}")
        have = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.root}/v={batch}").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        all_ = self.spark.createDataFrame([(b,) for b in touched], "bucket int").join(have, "bucket", "left")
        all_.select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/lists/batch={batch}")


def _distinct(rows: DataFrame, bucket: Column) -> list[int]:
    return sorted(r[0] for r in rows.select(bucket.alias("b")).distinct().collect())  # as many as buckets at most


class LiveDuplicates:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.n = buckets
        self.of_claim = F.pmod(F.xxhash64("claim"), F.lit(buckets)).cast("int")
        self.of_value = F.pmod(F.xxhash64("field", "norm"), F.lit(buckets)).cast("int")
        self.by_claim = Buckets(spark, f"{root}/claims", VALUE, buckets)
        self.by_value = Buckets(spark, f"{root}/values", VALUE, buckets)
        self.found = Buckets(spark, f"{root}/findings", f"{FINDING}, field string, norm string", buckets)

    def apply(self, values: DataFrame, claims: DataFrame, batch: int) -> None:
        """Values (as duplicates.page_values gives them) of some claims replace what is known of these claims.

        claims (claim, scope, status) has all claims. A claim whose last value goes is sent as a row with a null field.
        """
        spark = values.sparkSession
        fresh = values.select("claim", "document", "page", "field", "value", "norm").persist()
        came = fresh.select("claim").distinct()
        homes = _distinct(came, self.of_claim)
        known = self.by_claim.read(homes, batch)
        gone = known.join(came, "claim", "left_semi")
        real = fresh.where("field is not null")
        touched = _distinct(real.unionByName(gone), self.of_value)
        self.by_claim.write(known.join(came, "claim", "left_anti").unionByName(real), self.of_claim, homes, batch)
        kept = self.by_value.read(touched, batch).join(came, "claim", "left_anti")
        self.by_value.write(kept.unionByName(real.where(self.of_value.isin(touched)) if touched else real), self.of_value, touched, batch)
        now = self.by_value.read(touched, batch + 1) if touched else spark.createDataFrame([], VALUE)
        found = U.value_findings(now, claims)
        self.found.write(found.select("claim", "document", F.col("page").cast("int").alias("page"), "code", "severity", "value", "others", "n_others", "field", "norm"), self.of_value, touched, batch)
        fresh.unpersist()

    def findings(self) -> DataFrame:
        return self.found.read().drop("field", "norm")


def duplicate_stream(spark, source: str, root: str, checkpoint: str, claims: DataFrame, files_per_batch: int = 1000, buckets: int = BUCKETS) -> StreamingQuery:  # noqa: ANN001
    """Files of read values (Parquet) as they come; findings stand in root and are those of all values so far."""
    live = LiveDuplicates(spark, root, buckets)
    rows = spark.readStream.schema(VALUE).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return rows.writeStream.foreachBatch(lambda df, n: live.apply(df, claims, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
