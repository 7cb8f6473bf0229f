"""Revalidation of documents as they change, by Structured Streaming.

Writers drop versions (path, raw, and a version that grows) as files into a
folder; an empty raw of a null text is a removal. Each micro-batch takes the
last version of each path, validates those documents against the ids of all,
and merges both tables, which are kept as numbered snapshots in shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import parse_documents
from ..operators.validate import validate
from ..plans.schema import Schema
from ..plans.users import Users

VERSIONS = "path string, raw string, version long"


class Watch:
    """State of a watched set: documents (path, raw, version) and their diagnostics."""

    def __init__(self, spark: SparkSession, schema: Schema, state: str, users: Users | None = None):
        self.spark, self.schema, self.users, self.state = spark, schema, users, state.rstrip("/")

    def _paths(self, batch: int) -> tuple[str, str]:
        return f"{self.state}/documents/{batch}", f"{self.state}/diagnostics/{batch}"

    def _last(self) -> int | None:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.state}/done")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return max((int(s.getPath().getName()) for s in fs.listStatus(root)), default=None) if fs.exists(root) else None

    def documents(self) -> DataFrame:
        last = self._last()
        return self.spark.read.schema(VERSIONS).parquet(self._paths(last)[0]) if last is not None else self.spark.createDataFrame([], VERSIONS)

    def diagnostics(self) -> DataFrame:
        return self.spark.read.parquet(self._paths(self._last())[1])

    def step(self, changes: DataFrame, batch: int) -> None:
        """One micro-batch; a repeated one writes over what it left before."""
        last = self._last()
        if last is not None and batch <= last:
            return
        new = changes.groupBy("path").agg(F.max_by(F.struct("raw", "version"), "version").alias("v")).select("path", "v.*")
        documents, found = self._paths(batch)
        old = self.documents()
        whole = old.join(new.select("path"), "path", "left_anti").unionByName(new.filter("raw is not null"))
        whole.write.mode("overwrite").parquet(documents)
        all_docs = self.spark.read.schema(VERSIONS).parquet(documents)
        some = all_docs.join(new.select("path"), "path", "left_semi")
        checked = validate(parse_documents(some), self.schema, self.users, files=all_docs)
        if last is not None:
            kept = self.diagnostics().join(new.select("path"), "path", "left_anti").filter("code not in ('T010', 'T020')")
            checked = checked.filter("code not in ('T010', 'T020')").unionByName(kept)
        checked.write.mode("overwrite").parquet(found)
        jvm = self.spark.sparkContext._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{self.state}/done/{batch}")
        mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(mark, True).close()

    def start(self, drops: str, debounce: str = "300 milliseconds", once: bool = False):
        """A query over the folder of versions (Parquet)."""
        stream = self.spark.readStream.schema(VERSIONS).parquet(drops)
        writer = stream.writeStream.foreachBatch(lambda df, i: self.step(df, i)).option("checkpointLocation", f"{self.state}/stream")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=debounce)).start()
