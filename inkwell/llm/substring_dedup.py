"""Substring dedup with a log-structured fingerprint index.

Fingerprints are the anchors of ``spans``. The index is a list of immutable
runs: of a batch's fingerprints the first occurrences, one row for each hash,
bucketed and sorted by hash. A batch becomes a run itself, by an aggregation with
partial minima, so that a hash that very many documents hold is one row before it
is shuffled. The new run is merge-joined, bucket by bucket and without a shuffle,
with every run of history, oldest first; the hashes that are known by then, or
are in several places of the batch, are joined with the batch's occurrences.
Matches are verified word by word and extended; spans of at least ``LEAST``
words that an earlier document holds are the duplicates. When ``FANOUT`` runs
of one level are there, they are compacted to one of the next, so a
fingerprint is rewritten a logarithmic number of times. All occurrences are kept
beside the runs, as they were found; they are read only for hashes whose first
occurrence shares too little.

Every passage of LEAST words that a document shares with an earlier one
makes the document known: see ``spans.resolve`` for partners that share less.

Defined cases: null text is empty; rows that share a doc_id are one document
(the least text stands); rows without doc_id, or with one that is no whole
number, are left out; repeats within one
document are no duplicates; texts of fewer than LEAST words give nothing; of
documents that tie, the one with the least doc_id in the oldest batch is the
first; an empty batch changes nothing. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ids_and_text, keep, new_path, remove_path, scratch, sized, store
from .spans import K, LEAST, W, anchors, resolve

#: Production parameters.
BATCHES, FANOUT = 4, 3

RESULT = "doc_id long, word_start long, n_words long, first_doc_id long, first_word_start long"


_RUN = "h BIGINT, doc_id BIGINT, pos INT, n BIGINT"


@dataclass
class Run:
    level: int
    table: str
    path: str
    anchors: list[str]  # paths of all occurrences


class FingerprintIndex:
    """Runs of (h, doc_id, pos, n): the first occurrence of each hash, and how many there are.
    ``manifest`` and ``manifest=`` carry the index between sessions."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, k: int = K, w: int = W, fanout: int = FANOUT, manifest: dict | None = None):
        self.spark, self.fanout = spark, fanout
        kept = manifest or {}
        self.k, self.w = kept.get("k", k), kept.get("w", w)
        self.buckets = kept.get("buckets", buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.runs: list[Run] = []  # oldest first
        for level, path, anchors_at in kept.get("runs", []):
            name = "inkwell_run_" + uuid.uuid4().hex
            spark.sql(f"CREATE TABLE {name} ({_RUN}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{path}'")
            self.runs.append(Run(level, name, path, list(anchors_at)))

    def manifest(self) -> dict:
        return {"k": self.k, "w": self.w, "buckets": self.buckets, "runs": [(r.level, r.path, r.anchors) for r in self.runs]}

    def _write(self, firsts: DataFrame, level: int, anchors_at: list[str]) -> Run:
        name, path = "inkwell_run_" + uuid.uuid4().hex, new_path(self.spark, "run")
        firsts.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).format("parquet").saveAsTable(name)
        return Run(level, name, path, anchors_at)

    def _compact(self) -> None:
        while len(self.runs) >= self.fanout and len({r.level for r in self.runs[-self.fanout :]}) == 1:
            old = self.runs[-self.fanout :]
            whole = reduce(DataFrame.unionByName, (self.spark.table(r.table).withColumn("age", F.lit(i)) for i, r in enumerate(old)))
            first = F.min(F.struct("age", "doc_id", "pos")).alias("f")
            whole = whole.groupBy("h").agg(first, F.sum("n").alias("n")).select("h", "f.doc_id", "f.pos", "n")
            self.runs[-self.fanout :] = [self._write(whole, old[0].level + 1, [p for r in old for p in r.anchors])]
            for r in old:
                self._drop(r)

    def _drop(self, run: Run) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run.table}")
        remove_path(self.spark, run.path)

    def add(self, batch: DataFrame, corpus: DataFrame) -> DataFrame:
        """Index a batch (doc_id, text); the spans of it that history or the batch holds
        before. corpus: texts of history and batch, for verification."""
        spark, least = self.spark, self.k + self.w - 1
        read = spark.read.schema("h long, doc_id long, pos int").parquet
        path = new_path(spark, "anchors")
        anchors(batch, self.k, self.w).write.parquet(path)
        here = read(path)
        firsts = here.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.count(F.lit(1)).alias("n"))
        run = self._write(firsts.select("h", "f.doc_id", "f.pos", "n"), 0, [path])
        with scratch(spark):
            met = spark.table(run.table).select("h", F.struct("doc_id", "pos").alias("own"), "n")
            for i, r in enumerate(self.runs):
                met = met.join(spark.table(r.table).select("h", F.struct("doc_id", "pos").alias(f"f{i}")), "h", "left")
            old = F.coalesce(*(F.col(f"f{i}") for i in range(len(self.runs))), F.lit(None).cast("struct<doc_id:bigint,pos:int>"))
            known = store(met.select("h", F.coalesce(old, "own").alias("f"), (old.isNotNull() | (F.col("n") > 1)).alias("again")).filter("again").select("h", "f"), "known")
            pairs = here.join(sized(known), "h").filter("f.doc_id <> doc_id").select("h", "doc_id", "pos", F.col("f.doc_id").alias("other_doc_id"), F.col("f.pos").alias("other_pos"))
            everything = read(*(p for r in [*self.runs, run] for p in r.anchors))
            new = store(batch.select("doc_id"), "batch-ids")

            def choose(runs: DataFrame) -> DataFrame:
                runs = store(runs, "windows")
                mine = new.withColumn("mine", F.lit(1))
                marked = runs.join(mine, "doc_id", "left")
                first = marked.groupBy("h").agg(F.min(F.struct(F.coalesce("mine", F.lit(0)).alias("mine"), "doc_id", "pos")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
                both = marked.filter("mine = 1").join(first, "h").filter("f.doc_id <> doc_id")
                return both.select("h", "doc_id", "pos", F.col("f.doc_id").alias("other_doc_id"), F.col("f.pos").alias("other_pos"))

            spans = resolve(corpus, pairs, everything, choose, self.k, least)
            out = keep(spans.select("doc_id", "word_start", "n_words", F.col("other_doc_id").alias("first_doc_id"), F.col("other_word_start").alias("first_word_start")), "duplicates")
        self.runs.append(run)
        self._compact()
        return out

    def close(self) -> None:
        """Removes the index."""
        for r in self.runs:
            self._drop(r)
            for p in r.anchors:
                remove_path(self.spark, p)
        self.runs = []


def dedup_substrings(docs: DataFrame, batches: int = BATCHES, **index) -> DataFrame:
    """All documents, in batches by ranges of doc_id: RESULT rows, one for each span
    that an earlier document holds."""
    spark = docs.sparkSession
    texts = ids_and_text(docs)
    low, high = texts.agg(F.min("doc_id"), F.max("doc_id")).first()
    out = spark.createDataFrame([], T._parse_datatype_string(RESULT))
    if low is None:
        return out
    ids = FingerprintIndex(spark, **index)
    width = (high - low) // batches + 1
    for i in range(batches):
        batch = texts.filter((F.col("doc_id") >= low + i * width) & (F.col("doc_id") < low + (i + 1) * width))
        out = out.unionByName(ids.add(batch, texts.filter(F.col("doc_id") < low + (i + 1) * width)))
    ids.close()
    return out
