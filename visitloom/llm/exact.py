"""Exact deduplication against a persistent digest index.

The index holds SHA-256 digests in tables that are bucketed and sorted by digest, one file for each bucket: a base and, since it
was made, one table for each committed batch. New rows are first reduced to one row per digest, dealt and sorted in the same
way; sort-merge anti-joins, for which the index is neither shuffled nor sorted, leave the digests that are new, and these become
the table of the batch. Texts never move: only digests, ids and lengths do.

**Batches.** ``add`` decides a batch and writes its digests and its decisions, but the index doesn't count them yet. The caller
writes what stays and then calls ``commit``. A batch whose result was lost before that is simply added again: it is decided
anew, against committed batches alone, and loses nothing. A commit appends to the log of the index; the log has one entry for
each number, so of two writers that decided at the same state one is refused (:class:`IndexConflict`) and adds its batch again,
and no text stays twice. After ``MOST_PARTS`` batches a commit merges all tables into a new base.

Defined results: null text is empty, and empty texts equal each other and all-blank ones; ties in length go to the smallest
id, null ids last; of rows equal in id and text one is kept; adding a committed batch again keeps nothing of it; texts may have any
length; an empty table adds nothing; extra columns are only hashed.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.llm.common import keep_rows, row_hash, whole_text
from visitloom.sources.workspace import materialize, new_path

#: Characters that don't count, as a class of a regular expression.
BLANK = r"[\x20\x09-\x0D]"
#: Tables that a reader joins with, one after the other, before they are merged.
MOST_PARTS = 8
_ENTRY = "digest BINARY, keep_id BIGINT, keep_chars BIGINT"


class IndexConflict(RuntimeError):
    """Another batch was committed since this one was decided: add it again."""


def text_digest(text: Column) -> Column:
    """SHA-256, as bytes, of the text in UTF-8 without the characters of ``BLANK``."""
    return F.unhex(F.sha2(F.regexp_replace(text, f"{BLANK}+", ""), 256))


class DigestIndex:
    """Digests met so far, with the id and length of the row that stays for each."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        """Opens the index at ``path`` (a shared folder) or makes it there. A new index has ``buckets`` buckets, by default as
        many as the session has shuffle partitions; an index that exists keeps its number, the first entry of its log."""
        self.spark = spark
        self.path = path or new_path(spark, "digest-index")
        self._pending: tuple[int, str] | None = None
        if not self._log():
            with contextlib.suppress(IndexConflict):  # someone else has just made it
                self._append(0, {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))})
        self.buckets = self._log()[0]["buckets"]

    # ---- Log: one small file for each commit

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _log(self) -> list[dict]:
        """All entries by number, one for each commit; an entry whose writer died while writing it is empty."""
        system, folder = self._file(".")
        names = sorted(s.getPath().getName() for s in system.listStatus(folder)) if system.exists(folder) else []
        if not names:
            return []
        read = self.spark.read.text([f"{self.path}/log/{n}" for n in names], wholetext=True).select("value", F.input_file_name())
        found = {r[1].rsplit("/", 1)[1]: json.loads(r[0]) for r in read.collect() if r[0]}
        return [found.get(n, {}) for n in names]

    def _append(self, number: int, entry: dict) -> None:
        """Writes an entry that must not exist yet; file systems create a file once."""
        system, path = self._file(f"{number:012d}")
        try:
            out = system.create(path, False)
        except Py4JJavaError as error:
            if "AlreadyExists" not in str(error.java_exception):
                raise
            raise IndexConflict(f"{self.path}: entry {number} was written by someone else") from None
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()

    def _parts(self, log: list[dict]) -> list[str]:
        """Folders of the base and of the batches after it."""
        folders: list[str] = []
        for entry in filter(None, log[1:]):
            folders = [entry["folder"]] if entry["base"] else [*folders, entry["folder"]]
        return folders

    # ---- Tables

    @contextlib.contextmanager
    def _tables(self, folders: list[str]) -> Iterator[list[DataFrame]]:
        """The tables in the folders, read in the order they are stored in; the catalog forgets them afterwards."""
        ordering, names = "spark.sql.legacy.bucketedTableScan.outputOrdering", []
        before = self.spark.conf.get(ordering, None)
        self.spark.conf.set(ordering, "true")
        try:
            for folder in folders:
                names.append("digests_" + uuid.uuid4().hex)
                kind = _ENTRY if "/best-" not in folder else f"{_ENTRY}, keep_row BIGINT, group_size BIGINT"
                self.spark.sql(f"CREATE TABLE {names[-1]} ({kind}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
                               f"INTO {self.buckets} BUCKETS LOCATION '{folder}'")
            yield [self.spark.table(n) for n in names]
        finally:
            for name in names:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.spark.conf.set(ordering, before) if before is not None else self.spark.conf.unset(ordering)

    def _write(self, rows: DataFrame, kind: str) -> str:
        """One sorted file for each bucket, in a folder of its own."""
        folder, name = f"{self.path}/{kind}-{uuid.uuid4().hex}", "digests_" + uuid.uuid4().hex
        try:
            (rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest")
             .option("path", folder).format("parquet").saveAsTable(name))
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        return folder

    def rows(self) -> DataFrame:
        """All committed entries."""
        parts = self._parts(self._log())
        return self.spark.read.schema(_ENTRY).parquet(*parts) if parts else self.spark.createDataFrame([], _ENTRY)

    # ---- Batches

    def add(self, docs: DataFrame) -> DataFrame:
        """Decides a batch; one row per row of ``docs``: doc_id, row_hash, chars, digest, keep_id, group_size (rows of this batch
        with the digest), kept (this row stays, and no committed batch has its digest). Counts after :meth:`commit`."""
        log, text = self._log(), whole_text(docs)
        rows = materialize(docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row_hash"),
            F.char_length(text).cast("long").alias("chars"), text_digest(text).alias("digest"),
            F.monotonically_increasing_id().alias("row")), "digests")
        best = self._write(rows.groupBy("digest").agg(
            F.min(F.struct((-F.col("chars")).alias("c"), F.isnull("doc_id").alias("u"), "doc_id", "row")).alias("first"),
            F.count(F.lit(1)).alias("group_size")).select(
                "digest", F.col("first.doc_id").alias("keep_id"), (-F.col("first.c")).alias("keep_chars"),
                F.col("first.row").alias("keep_row"), "group_size"), "best")
        with self._tables([best, *self._parts(log)]) as (mine, *parts):
            new = reduce(lambda left, part: left.join(part.hint("merge"), "digest", "left_anti"), parts, mine)
            batch = self._write(new.select("digest", "keep_id", "keep_chars"), "batch")
            met = [mine.select("digest", "group_size").join(p.select("digest", "keep_id").hint("merge"), "digest").select(
                "digest", "keep_id", "group_size", F.lit(None).cast("long").alias("keep_row")) for p in parts]
            # Stored, so that both sides of the join with the rows are dealt anew and a digest of very many rows can be split.
            decided = materialize(reduce(DataFrame.unionByName, met, new.select("digest", "keep_id", "group_size", "keep_row")), "decided")
            decisions = materialize(rows.join(decided, "digest").select(
                "doc_id", "row_hash", "chars", "digest", "keep_id", "group_size",
                (F.col("row") == F.coalesce("keep_row", F.lit(-1))).alias("kept")), "decisions")
        self._pending = len(log), batch
        return decisions

    def commit(self) -> None:
        """From now on the batch added last counts; raises :class:`IndexConflict`, and counts nothing, if another was committed
        since it was decided."""
        if self._pending is None:
            raise ValueError("no batch to commit")
        (number, folder), self._pending = self._pending, None
        self._append(number, {"base": False, "folder": folder})
        if len(self._parts(self._log())) > MOST_PARTS:
            self.compact()

    def compact(self) -> None:
        """Merges all tables into one. If another batch is committed meanwhile the merged table is left unused."""
        log = self._log()
        folder = self._write(self.rows(), "base")
        with contextlib.suppress(IndexConflict):
            self._append(len(log), {"base": True, "folder": folder})


def distinct_documents(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` whose text is new to the index (a new one by default) and stays, with all their columns. Write them,
    then commit the index."""
    decided = (index or DigestIndex(docs.sparkSession)).add(docs)
    return keep_rows(docs, decided.where("kept"))


def append_distinct(docs: DataFrame, index: DigestIndex, path: str) -> None:
    """Writes the new documents under ``path`` as the batch of the index's next entry, then commits. Run again after any failure,
    it replaces what the failed run wrote and loses nothing."""
    kept = distinct_documents(docs, index)
    number, _ = index._pending
    kept.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")
    index.commit()
