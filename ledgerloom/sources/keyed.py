"""Keyed tables on plain files: upserts that write only their own rows.

::

    path/deltas/writer=<name>/batch=<n>/   the rows of one batch
    path/base/version=<v>/                 one row per key, all folded batches
    path/folds/version=<v>/                per writer the last batch in that base

An upsert adds one folder.  A reader takes the newest complete base and every
later batch and keeps the newest row per key: one aggregate whose filters on
keys reach the files.  ``fold`` writes the next base from such a reading, at
any time and beside readers and writers; nothing that a planned reading uses
is touched until ``clean`` removes what two versions have replaced.

A folder counts once Spark has marked it complete, so a write that broke off
is invisible and is written again.  A batch that is already stored or folded
is a replay and writes nothing.  Batch numbers of one writer must rise.

A deletion is a row whose ``deleted`` is true; it stays as a marker, so an
older row that comes late does not bring the key back.  With a table format
that supports MERGE use ``DataFrame.mergeInto`` instead.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DONE = "_SUCCESS"
_AT = "_at_"


class Folder:
    """A folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._new(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        return self._files.exists(self._new(f"{self.path}/{name}"))

    def values(self, name: str, prefix: str) -> list[str]:
        """For folders ``prefix=value`` below ``name`` their values."""
        if not self.has(name):
            return []
        found = (s.getPath().getName() for s in self._files.listStatus(self._new(f"{self.path}/{name}")))
        return [f.removeprefix(prefix + "=") for f in found if f.startswith(prefix + "=")]

    def remove(self, name: str) -> None:
        self._files.delete(self._new(f"{self.path}/{name}"), True)


class KeyedTable:
    """Rows by ``keys``; of two rows of a key the one later in ``order`` counts.

    ``keep`` columns take their newest non-null value; all others are replaced
    whole.  The three lists are stored with the table by its first upsert.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None, order: list[str] | None = None,
                 keep: list[str] | None = None):
        self.spark, self.folder = spark, Folder(spark, path)
        self.path = self.folder.path
        wanted = {"keys": keys, "order": order, "keep": sorted(keep or [])} if keys else None
        stored = self._settings()
        if stored and wanted and stored != wanted:
            raise ValueError(f"{path} is stored with {stored}, not with {wanted}")
        self.is_new = stored is None
        self.settings = stored or wanted
        if self.settings is None:
            raise ValueError(f"{path} holds no keyed table")
        self.keys, self.order, self.keep = (self.settings[k] for k in ("keys", "order", "keep"))

    def _settings(self) -> dict | None:
        if not self.folder.has(f"settings/{DONE}"):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/settings").first()[0])

    # --- what is stored ---

    def base(self) -> tuple[int, dict[str, int]]:
        """Version of the newest base (0: none) and the batches it holds: a last number for each writer."""
        versions = [int(v) for v in self.folder.values("folds", "version") if self.folder.has(f"folds/version={v}/{DONE}")]
        if not versions:
            return 0, {}
        marks = self.spark.read.schema("writer string, batch long").json(f"{self.path}/folds/version={max(versions)}")
        return max(versions), {r.writer: r.batch for r in marks.collect()}  # one row per writer

    def batches(self, writer: str) -> list[int]:
        """Numbers of a writer's complete batches that are still stored as such."""
        name = f"deltas/writer={writer}"
        return sorted(int(n) for n in self.folder.values(name, "batch") if self.folder.has(f"{name}/batch={n}/{DONE}"))

    def pending(self) -> tuple[int, dict[str, int], list[tuple[str, int]]]:
        """The newest base, and the complete batches after it."""
        version, marks = self.base()
        later = [(w, n) for w in sorted(self.folder.values("deltas", "writer")) for n in self.batches(w) if n > marks.get(w, -1)]
        return version, marks, later

    # --- writing ---

    def holds(self, batch: int, writer: str = "main") -> bool:
        return batch <= self.base()[1].get(writer, -1) or self.folder.has(f"deltas/writer={writer}/batch={batch}/{DONE}")

    def upsert(self, updates: DataFrame, batch: int | None = None, writer: str = "main") -> bool:
        """Store a batch (the writer's next number if none is given); False if it was stored before."""
        if self.is_new:
            text = self.spark.createDataFrame([(json.dumps(self.settings),)], "value string")
            text.coalesce(1).write.mode("overwrite").text(f"{self.path}/settings")
            self.is_new = False
        if batch is None:
            batch = max([self.base()[1].get(writer, -1), *self.batches(writer)]) + 1
        elif self.holds(batch, writer):
            return False
        updates.write.mode("overwrite").parquet(f"{self.path}/deltas/writer={writer}/batch={batch}")
        return True

    def fold(self, least: int = 1) -> int | None:
        """Write the next base if at least ``least`` batches came since the last; its version."""
        _, marks, later = self.pending()
        if len(later) < least:
            return None
        tried = [int(v) for kind in ("base", "folds") for v in self.folder.values(kind, "version")]
        version = max(tried, default=0) + 1  # a broken fold's number is not used again
        for writer, n in later:
            marks[writer] = max(n, marks.get(writer, -1))
        self._newest(hidden=True).write.mode("errorifexists").parquet(f"{self.path}/base/version={version}")
        rows = self.spark.createDataFrame(sorted(marks.items()), "writer string, batch long")
        rows.coalesce(1).write.mode("errorifexists").json(f"{self.path}/folds/version={version}")
        return version

    def clean(self, versions: int = 2) -> None:
        """Remove bases older than the newest ``versions``, and the batches that the oldest one left holds."""
        done = sorted(int(v) for v in self.folder.values("folds", "version") if self.folder.has(f"folds/version={v}/{DONE}"))
        if len(done) < versions:
            return
        oldest = done[-versions]
        for v in map(int, self.folder.values("base", "version")):
            if v < oldest:
                self.folder.remove(f"folds/version={v}")
                self.folder.remove(f"base/version={v}")
        marks = self.spark.read.schema("writer string, batch long").json(f"{self.path}/folds/version={oldest}")
        for mark in marks.collect():
            for n in self.batches(mark.writer):
                if n <= mark.batch:
                    self.folder.remove(f"deltas/writer={mark.writer}/batch={n}")

    # --- reading ---

    def _newest(self, hidden: bool) -> DataFrame | None:
        version, _, later = self.pending()
        at = F.struct(*self.order)
        parts = []
        if version:
            parts.append(self.spark.read.parquet(f"{self.path}/base/version={version}"))
        if later:
            folders = [f"{self.path}/deltas/writer={w}/batch={n}" for w, n in later]
            rows = self.spark.read.option("mergeSchema", "true").parquet(*folders)
            known = [c for c in self.keep if c in rows.columns]
            # when a kept value was given: it must outlive the fold, or a late row would be weighed against the wrong time
            parts.append(rows.withColumns({_AT + c: F.when(F.col(c).isNotNull(), at) for c in known}))
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        kept = [c for c in self.keep if c in rows.columns]
        shadows = [_AT + c for c in kept]
        if later:  # else the base has one row per key already
            rest = [c for c in rows.columns if c not in (*self.keys, *kept, *shadows)]
            held = [F.max_by(c, _AT + c).alias(c) for c in kept] + [F.max(s).alias(s) for s in shadows]
            rows = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), at).alias("_r"), *held).select(*self.keys, *kept, *shadows, "_r.*")
        return rows if hidden else rows.drop(*shadows)

    def read(self) -> DataFrame | None:
        """The newest row of every key, markers of deletions included; None before the first batch."""
        return self._newest(hidden=False)

    def live(self) -> DataFrame | None:
        """Rows that are not deleted."""
        rows = self.read()
        if rows is None or "deleted" not in rows.columns:
            return rows
        return rows.where(~F.coalesce("deleted", F.lit(False))).drop("deleted")
