"""An audited store by kind: writes that commit as a whole or not at all, scans that read one kind, undo.

Rows of a transaction are written to folders of their own, one a kind, and a manifest names them. The manifest comes last, by a
rename that fails if the number is taken: it is the commit. Folders that no manifest names are never read, so a write that is
killed, or whose audit fails, leaves nothing behind that a scan could see. Rows have an `id`; a scan shows the newest version
of each. A row may be a tombstone, which hides its id. Undo commits what was there before.

Locations are paths of any file system that Hadoop reads; nothing is read or written past Spark but the manifests' names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another transaction took the number first."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # -- manifests

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def last(self) -> int:
        """The number of the newest transaction; 0 before the first."""
        return max((int(n.removesuffix(".json")) for n in self._names("_commits") if n.endswith(".json")), default=0)

    def manifests(self) -> DataFrame:
        """txn, kind, path, note of what is committed."""
        schema = "txn long, kind string, path string, note string"
        if not self.last():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.root}/_commits/*.json")

    def _publish(self, txn: int, entries: list[dict], mine: str) -> None:
        """Writes the manifest aside and renames it into place; only one writer of a number succeeds."""
        jvm, aside, place = self.spark._jvm, f"{self.root}/_staging/{txn:012d}-{mine}.json", f"{self.root}/_commits/{txn:012d}.json"
        self._fs.mkdirs(self._path(f"{self.root}/_commits"))
        out = self._fs.create(self._path(aside), True)
        try:
            out.write(bytearray("".join(json.dumps(e) + "\n" for e in entries).encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        never_over = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._path(aside), self._path(place), never_over)
        except Exception as e:
            self._fs.delete(self._path(aside), False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(txn) from None
            raise

    # -- writes

    def put(self, rows: dict[str, DataFrame], audit: Callable[[int, dict[str, int]], None] | None = None, note: str = "", deleted: dict[str, DataFrame] | None = None) -> int:
        """Commits rows by kind, each frame with a unique `id`, and tombstones by kind; returns the transaction's number.

        `audit(number, rows a kind)` runs when all rows are written and before they can be seen. If it or a write fails, what
        was written is removed and nothing was changed.
        """
        txn, written, mine = self.last() + 1, [], uuid.uuid4().hex
        try:
            for kind in sorted({*rows, *(deleted or {})}):
                path = f"{self.root}/data/kind={kind}/txn={txn:012d}-{mine}"
                written.append({"txn": txn, "kind": kind, "path": path, "note": note})
                parts = [rows[kind].withColumn("_deleted", F.lit(False))] if kind in rows else []
                if deleted and kind in deleted:
                    parts.append(deleted[kind].select("id").withColumn("_deleted", F.lit(True)))
                both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
                both.withColumn("_txn", F.lit(txn).cast("long")).write.parquet(path)
            if audit is not None:
                audit(txn, {e["kind"]: self.spark.read.parquet(e["path"]).count() for e in written})
            self._publish(txn, written, mine)
        except BaseException:
            for e in written:
                self._fs.delete(self._path(e["path"]), True)
            raise
        return txn

    # -- reads

    def versions(self, kind: str, upto: int | None = None) -> DataFrame | None:
        """All rows of a kind with `_txn` and `_deleted`; only the folders of that kind's commits are read. None before its first commit."""
        m = self.manifests().filter(F.col("kind") == kind)
        paths = [r.path for r in (m.filter(F.col("txn") <= upto) if upto is not None else m).orderBy("txn").collect()]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def scan(self, kind: str, upto: int | None = None) -> DataFrame | None:
        """The newest version of each id of a kind, as of transaction `upto`; tombstones hide their ids."""
        rows = self.versions(kind, upto)
        if rows is None:
            return None
        body = [c for c in rows.columns if c not in ("id", "_txn")]
        newest = rows.groupBy("id").agg(F.max_by(F.struct(*body), "_txn").alias("r"), F.max("_txn").alias("_txn"))
        return newest.filter(~F.col("r._deleted")).select("id", *(F.col(f"r.`{c}`").alias(c) for c in body if c != "_deleted"))

    def before(self, txn: int, kind: str) -> tuple[DataFrame | None, DataFrame]:
        """What a transaction replaced: the rows that stood before under its ids, and the ids that it made."""
        touched = self.versions(kind).filter(F.col("_txn") == txn).select("id")
        old = self.scan(kind, txn - 1)
        if old is None:
            return None, touched
        return old.join(touched, "id", "left_semi"), touched.join(old.select("id"), "id", "left_anti")

    def undo(self, txn: int, audit: Callable[[int, dict[str, int]], None] | None = None) -> int:
        """Commits the state of the transaction's ids before it; what later transactions did to them is undone first, newest first, by calling this for each."""
        kinds = [r.kind for r in self.manifests().filter(F.col("txn") == txn).select("kind").distinct().collect()]
        old = {k: self.before(txn, k) for k in kinds}
        return self.put({k: r for k, (r, _) in old.items() if r is not None}, audit, f"undo {txn}", {k: made for k, (_, made) in old.items()})

    def compact(self, kind: str) -> None:
        """Commits the newest versions of a kind as one folder and drops the older ones from the manifests' view by a note; readers of `upto` before it keep the old folders."""
        newest = self.scan(kind)
        if newest is not None:
            self.put({kind: newest}, note="compact")


def steps(store: Store, work: list[Callable[[Store], int]]) -> list[int]:
    """Runs transactions one after another; if one fails, those before are undone, newest first, and its error is raised."""
    done: list[int] = []
    try:
        for do in work:
            done.append(do(store))
    except BaseException:
        for txn in reversed(done):
            store.undo(txn)
        raise
    return done


def publish_sources(store: Store, documents: DataFrame, validations: DataFrame, audit: Callable[[int, dict[str, int]], None] | None = None) -> int:
    """Hands parsed sources to the case inputs in one transaction: documents, their validation and an index row each."""
    index = documents.select("id", F.lit("published").alias("status"))
    return store.put({"source_document": documents, "confidence_validation": validations, "sources": index}, audit)
