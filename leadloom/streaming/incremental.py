"""Leads processed as files arrive, each batch stored when it is done.

A batch is a Structured Streaming micro-batch. Its output partition carries the batch id, so a batch that is replayed after a failure
rewrites exactly its own rows. Files hold columns (parquet) or text: JSON Lines, CSV with a header of its own in each file, or JSON and
listing exports. Rows of text are mapped once per batch and kept as a table, for rejects and leads read them both. Page and place lookups are
built once for all batches and calls of a flow; newer snapshots take a new flow over the same folder.

Identities that an earlier batch has stored are dropped, in one of two ways:

* `known="state"` (default): each batch first keeps the first row of every identity by a grouped minimum, which a hot identity passes as
  one row per task. These rows are themselves the input of a second stream, `dropDuplicates` on the identity, whose state holds nothing but
  identities, on disk in RocksDB, dealt by hash. A batch reads its own rows and touches the state of its own identities; no earlier batch
  is read. Resuming is safe at any point: rows rewritten by a replayed batch meet their identities in the state or are admitted anew.
  With `stop_on_error=False` a failed batch keeps the identities it was first to hold, and `retry_failed` finishes just those rows.
* `known="tables"`: identities of all finished batches are read again for each batch. A failed batch holds none, so a later batch may
  store its identities first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom import constants as K
from leadloom.operators.dedup import dedup_key
from leadloom.operators.mapping import map_columns, map_headed_rows, map_records, rejected_rows, tag_rejects
from leadloom.operators.stages import in_plan, stage_table
from leadloom.plans.lead_run import LEAD_COLUMNS, Lookups, clean_leads, finish_leads, page_lookups, staged_leads
from leadloom.settings import RunOptions
from leadloom.sinks import write_leads_table
from leadloom.sources.files import csv_rows, json_roots, map_roots
from leadloom.sources.split import placed
from leadloom.sources.tables import Snapshots

DONE = "done"
FAILED = "failed"
#: A row id of a text row is batch, task and place in the task, so that it is unique and ordered over all batches.
PLACE_BITS, TASK_BITS, LOCAL_BITS = 28, 16, 33
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
NOTES = "state string, error string, batch_id bigint"


def batch_row_id(batch_id: int) -> str:
    """SQL of the row id, from `row_id` as `monotonically_increasing_id` gives it."""
    task, place = f"shiftright(row_id, {LOCAL_BITS})", f"(row_id & {(1 << LOCAL_BITS) - 1}L)"
    fits = f"{task} < {1 << TASK_BITS} AND {place} < {1 << PLACE_BITS}"
    made = f"{batch_id << (PLACE_BITS + TASK_BITS)}L + shiftleft({task}, {PLACE_BITS}) + {place}"
    return f"CASE WHEN row_id IS NULL THEN NULL WHEN {fits} THEN {made} ELSE CAST(raise_error('batch too large for its row ids') AS BIGINT) END"


class IncrementalLeads:
    """Tables under `folder`, each partitioned by batch_id: clean leads with their identity, final leads,
    rejects, batches, and the rows of failed batches."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        options: RunOptions = RunOptions(),
        snapshots: Snapshots = Snapshots(),
        stop_on_error: bool = True,
        known: str = "state",
    ):
        if known not in ("state", "tables"):
            raise ValueError(f"unknown way to tell known identities: {known}")
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.options = options
        self.snapshots = snapshots
        self.stop_on_error = stop_on_error
        self.known = known
        self._lookups: Lookups | None = None
        self._prepared: set[str] = set()

    def process(self, landing: str, schema: T.StructType | None = None, files_per_batch: int = 1, fmt: str = "parquet") -> None:
        """Work off everything that has landed and not been processed yet, then return.

        fmt: parquet (rows carry a `row_id` that is unique over all files, and `schema` is theirs), or jsonl, csv, json or listing, whose
        rows get one. Calling it again resumes: finished batches are not repeated.
        """
        kind = fmt.strip().lower()
        keep = in_plan if kind == "parquet" else stage_table  # a filter on the reject reason would parse text again for every field it asks for
        stream = self.spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        if kind == "parquet":
            arrived = stream.schema(schema).parquet(landing)
        elif kind in ("jsonl", "csv"):
            arrived = stream.option("lineSep", "\n").text(landing).select("value", "_metadata.file_path", "_metadata.file_block_start")
        elif kind in ("json", "listing"):
            arrived = stream.option("wholetext", True).text(landing)
        else:
            raise ValueError(f"unsupported input format: {fmt}")
        self._prepare("batches", NOTES)
        query = (
            arrived.writeStream.foreachBatch(lambda raw, batch_id: self._batch(self._tagged(raw, batch_id, kind), batch_id, keep))
            .option("checkpointLocation", f"{self.folder}/progress")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def _tagged(self, raw: DataFrame, batch_id: int, kind: str) -> DataFrame:
        """Mapped rows of a batch with their reject reason."""
        mapping = self.options.mapping
        if kind == "parquet":
            return tag_rejects(map_columns(raw, mapping), mapping)
        if kind == "csv":
            rows, headers = csv_rows(placed(raw))
            mapped = map_headed_rows(rows, headers, mapping)
        elif kind == "jsonl":
            lines = raw.where(F.trim("value") != "").withColumn("row_id", F.monotonically_increasing_id())
            mapped = map_records(lines.select("row_id", F.try_parse_json("value").alias("record")), mapping)
        else:
            listing = kind == "listing"
            roots = json_roots(raw, K.LISTING_LIST_KEYS if listing else K.JSON_LIST_KEYS)
            mapped = map_roots(roots, mapping, listing)
        return tag_rejects(mapped.withColumn("row_id", F.expr(batch_row_id(batch_id))), mapping)

    def retry_failed(self) -> None:
        """Process the batches again that were passed over with `stop_on_error=False`."""
        failed = self._read("batches", NOTES).where(F.col("state") == FAILED).select("batch_id").orderBy("batch_id")
        for row in failed.toLocalIterator():  # numbers of batches, one at a time
            if self.known == "state":
                self._finish(self._read("clean").where(F.col("batch_id") == row["batch_id"]), row["batch_id"])
                self._note(row["batch_id"], DONE, None)
            else:
                self._batch(self._read("failed").where(F.col("batch_id") == row["batch_id"]).drop("batch_id"), row["batch_id"])

    def _batch(self, tagged: DataFrame, batch_id: int, keep: Callable[[DataFrame, str], DataFrame] = in_plan) -> None:
        try:
            self._store(keep(tagged, "tagged"), batch_id)
        except Exception as error:
            if self.known == "tables" and not self.stop_on_error:
                self._write(stage_table(tagged, "failed-batch"), "failed", batch_id)
            self._note(batch_id, FAILED, str(error))
            if self.stop_on_error:
                raise
        else:
            self._note(batch_id, DONE, None)

    def _store(self, tagged: DataFrame, batch_id: int) -> None:
        self._write(rejected_rows(tagged), "rejects", batch_id)
        first = clean_leads(tagged, self.options).withColumn("identity", F.expr(dedup_key(self.options.normalize)))
        schema = T.StructType([*first.schema.fields, T.StructField("batch_id", T.LongType())])
        # clean leads are written before enrichment changes the fields the identity is made of
        self._prepare("clean", schema)
        if self.known == "state":
            self._prepare("candidates", schema)
            self._write(first, "candidates", batch_id)
            self._admit(schema)
        else:
            self._write(self._unknown(first, schema, batch_id), "clean", batch_id)
        self._finish(self._read("clean", schema).where(F.col("batch_id") == batch_id), batch_id)

    def _admit(self, schema: T.StructType) -> None:
        """Pass the candidates that are new in the folder through the state, and store those of unknown identity as clean."""
        before = self.spark.conf.get(STATE_STORE[0], None)
        self.spark.conf.set(*STATE_STORE)
        try:
            # a replayed batch has rewritten its files; what was to be read of the old ones is read from the new ones
            arrived = self.spark.readStream.schema(schema).option("ignoreMissingFiles", True).parquet(f"{self.folder}/candidates")
            query = (
                arrived.dropDuplicates(["identity"]).writeStream.foreachBatch(lambda fresh, _: write_leads_table(fresh, f"{self.folder}/clean", ("batch_id",)))
                .option("checkpointLocation", f"{self.folder}/identities").trigger(availableNow=True).start()
            )
            query.awaitTermination()
        finally:
            self.spark.conf.set(STATE_STORE[0], before) if before else self.spark.conf.unset(STATE_STORE[0])

    def _finish(self, clean: DataFrame, batch_id: int) -> None:
        """Enrich, resolve, grade and score the clean leads of one batch."""
        if self._lookups is None:
            self._lookups = page_lookups(self.snapshots, self.options)
        staged = staged_leads(clean.drop("batch_id", "identity"), self.snapshots, self.options, self._lookups)
        self._write(finish_leads(staged, self.options).select(*LEAD_COLUMNS), "leads", batch_id)

    def _unknown(self, batch: DataFrame, schema: T.StructType, batch_id: int) -> DataFrame:
        """Leads of the batch whose identity no other finished batch holds."""
        batch = stage_table(batch, "batch")
        known = self._finished("clean", schema).where(F.col("batch_id") != batch_id).select("identity")
        met = known.join(batch.select("identity"), "identity", "left_semi")
        return batch.join(met, "identity", "left_anti")

    def _finished(self, name: str, schema: T.StructType | str | None = None) -> DataFrame:
        """Rows of finished batches: what a failed batch left behind does not count."""
        done = self._read("batches", NOTES).where(F.col("state") == DONE).select("batch_id")
        return self._read(name, schema).join(done, "batch_id", "left_semi")

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        write_leads_table(df.withColumn("batch_id", F.lit(batch_id).cast("long")), f"{self.folder}/{name}", ("batch_id",))

    def _note(self, batch_id: int, state: str, error: str | None) -> None:
        row = self.spark.range(1).select(F.lit(state).alias("state"), F.lit(error).cast("string").alias("error"))
        self._write(row, "batches", batch_id)

    def _prepare(self, name: str, schema: T.StructType | str) -> None:
        """Make the table's folder where it is not there yet, so that an empty table can be read."""
        if name in self._prepared:
            return
        self._prepared.add(name)
        self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self._fields(schema)]).write.mode("append").partitionBy("batch_id").parquet(f"{self.folder}/{name}")

    def _fields(self, schema: T.StructType | str) -> list[T.StructField]:
        return (schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)).fields

    def _read(self, name: str, schema: T.StructType | str | None = None) -> DataFrame:
        """A table of the folder. One that may have no rows yet needs its schema."""
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.folder}/{name}").withColumn("batch_id", F.col("batch_id").cast("long"))

    def stored(self) -> DataFrame:
        return self._finished("leads")

    def rejects(self) -> DataFrame:
        return self._finished("rejects")

    def batches(self) -> DataFrame:
        """State of every batch that was tried; failed ones stay visible here."""
        return self._read("batches", NOTES)
