"""A table of leads keyed by (job_id, row_index): keyed merge, lookup of a run, leads of the newest runs.

Files lie under `job_id=.../bucketN=.../`, where the bucket is a hash of the row index and N the number of buckets. The number is
part of the column's name, so that a table written with another one is an error and not a second home for the same row.

A merge reads the partitions its rows fall in, and no others: their (job_id, bucket) pairs reach the scan by dynamic partition
pruning. What those hold and the rows do not replace is joined to the rows, written as a stage, and copied over the partitions from
there. A merge that is lost half way is run again by `merge`, or, where the copy itself was cut off, finished by `replace` from the
stage, whose path the error names.

Defined results: rows without `row_index` replace nothing and are never replaced, so merging them twice keeps both; of rows that
share a key within one merge the greatest by `newest` stays, nulls first, ties by a hash of the row; a null or empty `job_id` is an
error; an empty merge changes nothing; a table never written reads as empty; columns other than the schema's are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from leadloom.operators.stages import new_path, stage_table

KEY = ("job_id", "row_index")
#: A list of partitions up to this length (some MB) is broadcast; a longer one is left to Spark.
MAX_LISTED = 50_000


class LeadTable:
    """`schema` is that of the leads and holds `job_id` (text) and `row_index`."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int = 16):
        if buckets < 1 or not set(KEY) <= set(schema.names):
            raise ValueError("a lead table needs job_id, row_index and at least one bucket")
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.bucket = f"bucket{buckets}"
        self.columns = schema.names
        data = [f for f in schema.fields if f.name != "job_id"]
        self.schema = StructType([*data, schema["job_id"], StructField(self.bucket, IntegerType())])

    def _bucket_of(self, row_index: str) -> str:
        return f"CAST(pmod(xxhash64({row_index}), {self.buckets}) AS INT)"

    def _stored(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._stored().select(*self.columns)

    def of_run(self, job_id: str, row_index: int | None = None) -> DataFrame:
        """Leads of one run, or one of them: only the files of that run, or of one of its buckets, are read."""
        found = self._stored().where(F.col("job_id") == job_id)
        if row_index is not None:
            index = f"CAST({int(row_index)} AS {self.schema['row_index'].dataType.simpleString()})"
            found = found.where(f"row_index = {index} AND {self.bucket} = {self._bucket_of(index)}")
        return found.select(*self.columns)

    def of_runs(self, runs: DataFrame) -> DataFrame:
        """Leads of the runs in `runs` (job_id), each once; where those are few, only their files are read."""
        return self._stored().join(runs.select("job_id").distinct(), "job_id", "left_semi").select(*self.columns)

    def _keyed(self, rows: DataFrame, newest: Sequence[str]) -> DataFrame:
        """One row per key, with its bucket. Rows without an index are spread by a hash of the whole row."""
        kept = sorted({*self.columns, *newest}, key=rows.columns.index)
        whole = f"xxhash64({', '.join(f'`{c}`' for c in kept)})"
        checked = "CASE WHEN job_id <> '' THEN job_id ELSE raise_error('a lead has no job_id') END"
        named = rows.select(*kept).withColumn("job_id", F.expr(checked))
        index_type = self.schema["row_index"].dataType.simpleString()
        named = named.withColumn("row_index", F.col("row_index").cast(index_type)).withColumn("_hash", F.expr(whole))
        order = f"struct({', '.join([*newest, '_hash'])})"
        fields = ", ".join(f"`{c}`" for c in self.columns)
        numbered = named.where("row_index IS NOT NULL").groupBy(*KEY).agg(F.expr(f"max_by(struct({fields}), {order})").alias("_row"))
        out = numbered.select("_row.*", F.expr(f"{self._bucket_of('row_index')} AS {self.bucket}"))
        loose = named.where("row_index IS NULL").select(*self.columns, F.expr(f"CAST(pmod(_hash, {self.buckets}) AS INT) AS {self.bucket}"))
        return out.unionByName(loose)

    def touched_rows(self, rows: DataFrame) -> DataFrame:
        """What the partitions that `rows` (with buckets) fall in hold now."""
        place = f"concat({self.bucket}, '/', job_id)"  # one key, because Spark prunes by one key of a join
        touched = stage_table(rows.selectExpr(f"{place} AS _place").distinct(), "lead-partitions")
        few = touched.count() <= MAX_LISTED
        touched = touched.where("_place <> ''")  # always true; a filter is what lets Spark prune by this list
        return self._stored().join(F.broadcast(touched) if few else touched, F.expr(f"{place} = _place"), "left_semi")

    def merge(self, rows: DataFrame, newest: Sequence[str] = ()) -> None:
        """Put `rows` in place of those of the same (job_id, row_index), and add the others."""
        rows = stage_table(self._keyed(rows, newest), "lead-rows")
        same = [*KEY, self.bucket]
        kept = self.touched_rows(rows).join(rows.select(*same), same, "left_anti")
        merged = new_path(self.spark, "lead-merge")
        kept.unionByName(rows).write.option("compression", "zstd").parquet(merged)
        try:
            self.replace(merged)
        except Exception as error:
            error.add_note(f"merged rows are complete in {merged}; finish with replace({merged!r})")
            raise

    def replace(self, merged: str) -> None:
        """Copy the partitions of a stage over those of the table. Partitions are rebalanced, so that a hot run takes many tasks."""
        rows = self.spark.read.schema(self.schema).parquet(merged).hint("rebalance", "job_id", self.bucket)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id", self.bucket).parquet(self.path)
