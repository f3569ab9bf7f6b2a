"""The newest records as JSON files: every append is a file of its own, the last ``keep`` records count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.model import RECORD_DDL
from weir.operators import inbox
from weir.sinks.exports import with_json
from weir.sources.records import load_arrays


class RecentRecords:
    """Appends of JSON arrays. A file that cannot be decoded counts as empty; the others keep their records.

    No append holds more than ``keep`` records, since older ones could never count: one file of
    bounded size is written by one task, however large the batch.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 500):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _appends(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("append="))

    def next_folder(self) -> str:
        return f"{self.path}/append={(self._appends() or [0])[-1] + 1:08d}"

    def append(self, batch: DataFrame, order: str = "seq") -> None:
        """The batch's last ``keep`` records in ``order``; a number that is taken already is an error."""
        tail = with_json(inbox.last_added(batch, self.keep, order), order)
        items = F.array_sort(F.collect_list(F.struct(order, "json")))["json"]
        tail.agg(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias("value")).coalesce(1).write.mode("error").text(self.next_folder())

    def load(self, as_of: str) -> DataFrame:
        """(append, pos, error, record columns) of the last ``keep`` records; ``error`` marks rows that are no record."""
        if not self._appends():
            return self.spark.createDataFrame([], f"append int, pos int, error string, {RECORD_DDL}")
        files = self.spark.read.option("basePath", self.path).text(self.path, wholetext=True)
        rows = load_arrays(files.select("append", "value"), "value", as_of, ["append"])
        return rows.orderBy(F.desc("append"), F.desc("pos")).limit(self.keep)

    def trim(self) -> None:
        """Delete the appends behind the newest ``keep`` records."""
        files = self.spark.read.option("basePath", self.path).text(self.path, wholetext=True)
        sizes = files.select("append", F.size(F.from_json("value", "array<string>")).alias("n")).where("n > 0")
        held = 0
        for append, n in sizes.orderBy(F.desc("append")).limit(self.keep).collect():  # each has a record, so more cannot count
            held += n
            if held >= self.keep:
                for old in [x for x in self._appends() if x < append]:
                    folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/append={old:08d}")
                    folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
                return
