"""The inbox store: immutable parquet folders, and a log of which of them are in force.

``content`` holds the records by source type and day of fetching, ``ids`` the id, day and stamp of every
record under a prefix of the id's hash, sorted and with bloom filters, ``state`` what was marked processed.
Every change writes folders of its own that nobody sees, and then publishes the next version of
the log: a small file that names all folders in force. A version can be published once only. Who
comes second starts again from the version that was first, so no change is lost, and a lost executor
or driver leaves the last version in force.

* ``add`` reads only the id folders whose prefixes the batch has.
* ``mark_processed`` writes ids and dates, no content.
* ``clear_old`` drops days by naming the day after which a folder counts, and rewrites the one day
  that the cutoff falls into.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.model import RECORD_DDL
from weir.operators import inbox


@dataclass(frozen=True)
class Snapshot:
    """A version of the log: folders of records, each with the day that it must be later than, and of changes of state."""

    version: int = 0
    entries: list[dict] = field(default_factory=list)
    state: list[str] = field(default_factory=list)
    prefix: int = 1


class InboxStore:
    SCHEMA = f"seq bigint, {RECORD_DDL}"
    FIELDS = [part.split()[0] for part in SCHEMA.split(", ")]
    #: How often a change starts again because another one was published first.
    ATTEMPTS = 20

    def __init__(self, spark: SparkSession, path: str, prefix: int = 1):
        """``prefix``: hex digits of the id's hash that lay out the ids of a new store (16 ** prefix folders)."""
        self.spark, self.path, self.prefix = spark, path.rstrip("/"), prefix

    # The log.

    def _hadoop(self, path: str):
        made = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return made, made.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Published versions; the listing is a folder of small files, which ``retire`` keeps short."""
        root, fs = self._hadoop(f"{self.path}/log")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A published version, the last one unless named."""
        versions = self.versions()
        if not versions:
            return Snapshot(prefix=self.prefix)
        version = versions[-1] if version is None else version
        file, fs = self._hadoop(f"{self.path}/log/{version:08d}.json")
        stream = fs.open(file)
        try:
            return Snapshot(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _publish(self, new: Snapshot) -> bool:
        """Make ``new`` the next version; False if that version is there already."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        part, fs = self._hadoop(f"{self.path}/log/.{uuid.uuid4().hex}")
        file, _ = self._hadoop(f"{self.path}/log/{new.version:08d}.json")
        stream = fs.create(part, False)
        stream.write(json.dumps(new.__dict__).encode())
        stream.close()
        files = hadoop.FileContext.getFileContext(part.toUri(), self.spark._jsc.hadoopConfiguration())
        try:  # a rename that must not replace: whole files only, and one winner
            files.rename(files.makeQualified(part), files.makeQualified(file), self.spark._sc._gateway.new_array(hadoop.Options.Rename, 0))
        except Exception as refused:
            fs.delete(part, False)
            if fs.exists(file):
                return False
            raise refused
        return True

    def _change(self, make: Callable[[Snapshot, str], Snapshot | None]) -> None:
        """Publish what ``make`` returns for the last version and a folder name of its own; None changes nothing."""
        for _ in range(self.ATTEMPTS):
            base = self.snapshot()
            name = f"{base.version + 1:08d}-{uuid.uuid4().hex}"
            new = make(base, name)
            if new is not None and self._publish(replace(new, version=base.version + 1)):
                return
            for kind in ("content/batch", "ids/batch", "state/change"):  # nobody has seen them
                folder, fs = self._hadoop(f"{self.path}/{kind}={name}")
                fs.delete(folder, True)
            if new is None:
                return
        raise RuntimeError(f"{self.path}: other changes came first {self.ATTEMPTS} times")

    # Folders.

    def _read(self, base: Snapshot, kind: str, schema: str) -> DataFrame:
        """All records or ids in force. Days are folders of the content, and a column of the ids."""
        found = self.spark.createDataFrame([], schema)
        by_day: dict[str | None, list[str]] = {}
        for e in base.entries:
            by_day.setdefault(e["after"], []).append(f"{self.path}/{kind}/batch={e['folder']}")
        for i, (after, folders) in enumerate(by_day.items()):
            rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*folders)
            rows = rows if after is None else rows.where(F.col("day") > F.lit(after))
            found = rows if i == 0 else found.unionByName(rows)
        return found

    def _content(self, base: Snapshot) -> DataFrame:
        """Records with ``batch`` and ``day``; state changes are not applied."""
        return self._read(base, "content", f"{self.SCHEMA}, batch string, day string")

    def ids(self, base: Snapshot | None = None) -> DataFrame:
        """(prefix, id, day, batch) of all records in force; no content is read."""
        return self._read(base or self.snapshot(), "ids", "id string, day string, batch string, prefix string")

    def _prefix(self, base: Snapshot) -> Column:
        return F.left(F.md5("id"), F.lit(base.prefix))

    def known(self, batch: DataFrame, base: Snapshot | None = None) -> DataFrame:
        """The ids in force among those folders whose prefixes ``batch`` (id) has: at most 16 ** prefix names are gathered."""
        base = base or self.snapshot()
        wanted = [r[0] for r in batch.select(self._prefix(base)).distinct().collect()]
        return self.ids(base).where(F.col("prefix").isin(wanted)).select("id")

    def _write(self, rows: DataFrame, name: str, base: Snapshot) -> bool:
        """Records to a folder of their own, then their ids; False if there are none."""
        content, ids = f"{self.path}/content/batch={name}", f"{self.path}/ids/batch={name}"
        days = rows.select(*self.FIELDS).withColumn("day", F.left("fetched_at", F.lit(10)))
        # Rebalancing gives few, well-sized files; the adaptive planner splits what is large.
        days.hint("rebalance", F.col("source_type"), F.col("day")).write.partitionBy("source_type", "day").parquet(content)
        folder, fs = self._hadoop(content)
        if not any(s.isDirectory() for s in fs.listStatus(folder)):
            return False
        slim = self.spark.read.schema(f"{self.SCHEMA}, day string").parquet(content).select("id", "day", self._prefix(base).alias("prefix"))
        (slim.hint("rebalance", F.col("prefix")).sortWithinPartitions("prefix", "id").write.partitionBy("prefix")
         .option("parquet.bloom.filter.enabled#id", "true").parquet(ids))
        return True

    # What users do.

    def load(self, version: int | None = None) -> DataFrame:
        """All records in force, with their state."""
        base = self.snapshot(version)
        rows = self._content(base)
        if base.state:
            marks = self.spark.read.schema("id string, digest_date string, change string").option("basePath", f"{self.path}/state").parquet(
                *[f"{self.path}/state/change={s}" for s in base.state])
            # A mark holds for the record that was there then, not for one that came later under the same id.
            slim = self.ids(base).select("id", "batch")
            marks = marks.join(slim, "id").where(F.left("change", F.lit(8)) >= F.left("batch", F.lit(8))).groupBy("id").agg(
                F.max(F.when(F.col("digest_date").isNotNull(), F.struct("change", "digest_date")))["digest_date"].alias("_date"), F.lit(True).alias("_hit"))
            rows = rows.join(marks, "id", "left").withColumn("processed", F.col("processed") | F.coalesce("_hit", F.lit(False))).withColumn(
                "digest_date", F.coalesce("_date", "digest_date"))
        return rows.select(*self.FIELDS)

    def add(self, batch: DataFrame) -> None:
        """Append the batch's records that are new; running it again adds nothing."""

        def make(base: Snapshot, name: str) -> Snapshot | None:
            fresh = inbox.new_records(batch, self.known(batch, base) if base.entries else self.ids(base))
            return replace(base, entries=[*base.entries, {"folder": name, "after": None}]) if self._write(fresh, name, base) else None

        self._change(make)

    def mark_processed(self, updates: DataFrame) -> None:
        """Apply (id, digest_date, update_seq) updates to the records in force; the last given date stays."""

        def make(base: Snapshot, name: str) -> Snapshot | None:
            if not base.entries:
                return None
            marks = inbox.last_marks(updates)
            marks = marks.join(self.known(updates.select("id"), base).distinct(), "id", "left_semi")
            marks.write.parquet(f"{self.path}/state/change={name}")
            return replace(base, state=[*base.state, name])

        self._change(make)

    def clear_old(self, as_of: str, days: int = 7) -> None:
        """Drop records fetched at or before the cutoff."""
        cutoff = inbox.cutoff(as_of, days)
        day = cutoff[:10]  # ISO texts compare like their days, except on the cutoff's own day

        def make(base: Snapshot, name: str) -> Snapshot | None:
            if not base.entries:
                return None
            edge = self.load(base.version or None).where(F.left("fetched_at", F.lit(10)) == day)
            rest = [{"folder": e["folder"], "after": max(e["after"] or day, day)} for e in base.entries]
            if self._write(inbox.keep_recent(edge, as_of, days), name, base):
                rest.append({"folder": name, "after": None})
            return replace(base, entries=rest) if rest != base.entries else None

        self._change(make)

    # Upkeep.

    def compact(self) -> None:
        """All records in force as one folder, with their state; the next versions read that one alone."""

        def make(base: Snapshot, name: str) -> Snapshot | None:
            rows = self.load(base.version or None)
            return replace(base, entries=[{"folder": name, "after": None}] if self._write(rows, name, base) else [], state=[])

        self._change(make)

    def retire(self, keep: int = 1) -> None:
        """Delete all versions but the last ``keep``, and the folders that none of those names.

        Not to be run beside changes: the folders of one that is not yet published look the same.
        """
        versions = self.versions()
        kept = [self.snapshot(v) for v in versions[-max(1, keep):]]
        folders = {e["folder"] for s in kept for e in s.entries}
        states = {x for s in kept for x in s.state}
        for kind, key, named in (("content", "batch=", folders), ("ids", "batch=", folders), ("state", "change=", states)):
            root, fs = self._hadoop(f"{self.path}/{kind}")
            for status in fs.listStatus(root) if fs.exists(root) else []:
                if status.getPath().getName().removeprefix(key) not in named:
                    fs.delete(status.getPath(), True)
        for v in versions[:-max(1, keep)]:
            file, fs = self._hadoop(f"{self.path}/log/{v:08d}.json")
            fs.delete(file, False)
