"""Stored model results: scores per (model, label, text) and vectors per (model, text).

A text is known by its 32-byte digest: with one row per label, the text itself
would be stored as often as there are labels. Writing a key again replaces its
value: every append takes the next number of the table, ``seq``, and readers keep
the value of the largest.

A table is a folder of data folders, one per append, and a commit log. A writer
first takes a number by creating its claim, which only one writer can; then it writes its
rows into a folder of its own; then it commits by putting an entry under the
number. Readers list the log and read the folders of committed entries, so a
half-written append is never seen, writers never wait for each other, and neither
needs to look at stored rows. Small appends are merged now and then into one; the
merged commit names those it replaces.

Rows lie sorted by (label, text) within files, with statistics of every page and Bloom
filters of the digests, so that probing a large table for few texts reads few of its pages.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Live appends of a model before the newer ones are merged.
MAX_APPENDS = 8
#: Rows that a merge puts into one file.
FILE_ROWS = 4_000_000
#: Texts up to which a probe names them to the scan, instead of joining with it.
PROBE_TEXTS = 1_000


class CommitLog:
    """Numbered entries in a folder; numbers are claimed one by one, entries appear whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark.sparkContext._jvm, path
        root = self._at("")
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._known: dict[int, dict] = {}

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self) -> list[str]:
        if not self._fs.exists(self._at("")):
            return []
        return [status.getPath().getName() for status in self._fs.listStatus(self._at(""))]

    def _put(self, name: str, content: str) -> bool:
        """Create a file that does not exist yet; false if it does."""
        try:
            stream = self._fs.create(self._at(name), False)
        except Py4JJavaError as error:
            if "AlreadyExists" in str(error.java_exception.getClass().getName()):
                return False
            raise
        try:
            stream.write(content.encode())
        finally:
            stream.close()
        return True

    def claim(self) -> int:
        """The next number, which no other writer gets."""
        number = 1 + max((int(name.split(".")[0]) for name in self._names() if name[0].isdigit()), default=0)
        while not self._put(f"{number:020d}.claim", ""):
            number += 1
        return number

    def lease(self, number: int) -> bool:
        """Take an entry for a merge; false if another merge has. One that dies leaves its entries live and unmerged."""
        return self._put(f"{number:020d}.merging", "")

    def commit(self, number: int, entry: dict) -> None:
        """Publish the entry of a claimed number: written aside, then renamed."""
        aside = f".{number:020d}.{uuid.uuid4().hex}"
        self._put(aside, json.dumps(entry))
        if not self._fs.rename(self._at(aside), self._at(f"{number:020d}.json")):
            raise FileExistsError(f"{self.path}: commit {number} is there already")

    def entries(self) -> dict[int, dict]:
        """All committed entries by number; each is read once."""
        numbers = {int(name.split(".")[0]) for name in self._names() if name.endswith(".json") and name[0].isdigit()}
        for number in numbers - self._known.keys():
            stream = self._fs.open(self._at(f"{number:020d}.json"))
            try:
                self._known[number] = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        return {number: self._known[number] for number in sorted(numbers)}

    def live(self) -> dict[int, dict]:
        """Entries that no commit replaces."""
        entries = self.entries()
        replaced = {n for entry in entries.values() for n in entry.get("replaces", [])}
        return {number: entry for number, entry in entries.items() if number not in replaced}

    def drop(self, folder: str) -> None:
        self._fs.delete(self._at(folder), True)


class _Table:
    columns: list[T.StructField]
    keys: list[str]
    value: str

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.log = CommitLog(spark, f"{path}/log")

    @property
    def schema(self) -> T.StructType:
        keys = [T.StructField("text_key", T.BinaryType())]
        tail = [T.StructField("run_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("model", T.StringType())]
        return T.StructType(keys + self.columns + tail)

    def read(self, model: str | None = None) -> DataFrame:
        """All stored rows, of one model if named; none if there are none yet. Other models' files are not opened."""
        live = self.log.live().values()
        folders = [f"{self.path}/{entry['folder']}" for entry in live if model in (None, entry["model"])]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def probe(self, rows: DataFrame, texts: DataFrame | None) -> DataFrame:
        """Rows of the given texts (``text_key``; all if None).

        A few texts are named to the scan, which skips pages by their statistics and Bloom
        filters; more of them are joined.
        """
        if texts is None:
            return rows
        few = [bytes(row[0]) for row in texts.select("text_key").limit(PROBE_TEXTS + 1).collect()]
        if len(few) > PROBE_TEXTS:
            return rows.join(texts.select("text_key"), "text_key", "left_semi")
        return rows.where(F.col("text_key").isin(few) if few else F.lit(False))

    def _write(self, rows: DataFrame, folder: str) -> int:
        """Store rows, sorted within each task; returns how many there are, by the new files' footers."""
        path = f"{self.path}/{folder}"
        ordered = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).sortWithinPartitions(*reversed(self.keys))
        ordered.write.option("parquet.bloom.filter.enabled#text_key", "true").parquet(path)
        return self.spark.read.schema(self.schema).parquet(path).count()

    def _append(self, fresh: DataFrame, model: str, run_id: str) -> int:
        """Write straight from the tasks that made the rows, so that a lost one repeats its own work only."""
        seq, folder = self.log.claim(), f"data/{uuid.uuid4().hex}"
        rows = self._write(fresh.withColumns({"model": F.lit(model), "run_id": F.lit(run_id), "seq": F.lit(seq)}), folder)
        self.log.commit(seq, {"folder": folder, "model": model, "rows": rows})
        if sum(entry["model"] == model for entry in self.log.live().values()) > MAX_APPENDS:
            self.compact(model)
        return rows

    def compact(self, model: str) -> int:
        """Merge the newer appends of a model into one; returns how many were merged.

        Taken are the newest ones and older ones as long as these have at most twice the
        rows of those already taken: a row is merged as often as the logarithm of the table's size
        says, and so many appends are left. Replaced values are dropped.
        """
        live = [(n, entry) for n, entry in self.log.live().items() if entry["model"] == model]
        taken, rows = [], 0
        for number, entry in reversed(live):
            if (len(taken) > 1 and entry["rows"] > 2 * rows) or not self.log.lease(number):
                break
            taken.append((number, entry))
            rows += entry["rows"]
        if len(taken) < 2:
            return 0
        number, folder = self.log.claim(), f"data/{uuid.uuid4().hex}"
        stored = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{entry['folder']}" for _, entry in taken])
        newest = F.max_by(F.struct(*[f.name for f in self.schema if f.name not in self.keys]), "seq").alias("newest")
        merged = stored.groupBy(*self.keys).agg(newest).select(*self.keys, "newest.*")
        ranged = merged.repartitionByRange(max(1, -(-rows // FILE_ROWS)), "text_key")
        kept = self._write(ranged, folder)
        self.log.commit(number, {"folder": folder, "model": model, "rows": kept, "replaces": sorted(n for n, _ in taken)})
        return len(taken)

    def vacuum(self) -> int:
        """Delete the folders of replaced appends, once no reader uses them any more; returns how many."""
        live = {entry["folder"] for entry in self.log.live().values()}
        gone = [entry["folder"] for entry in self.log.entries().values() if entry["folder"] not in live]
        for folder in gone:
            self.log.drop(f"../{folder}")
        return len(gone)

    def _latest(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(F.max_by(self.value, "seq").alias(self.value))


class ScoreTable(_Table):
    """``scores(model, label, text_key, score)``."""

    columns = [T.StructField("label", T.StringType()), T.StructField("score", T.FloatType())]
    keys = ["text_key", "label"]
    value = "score"

    def entries(self, model: str, labels: list[str], texts: DataFrame | None = None) -> DataFrame:
        """Stored rows of a model and some labels, of all texts or the given ones."""
        return self.probe(self.read(model).where(F.col("label").isin(labels)), texts)

    def latest(self, model: str, labels: list[str], texts: DataFrame | None = None) -> DataFrame:
        """One row per (label, text): ``label, text_key, score``."""
        return self._latest(self.entries(model, labels, texts)).select("label", "text_key", "score")

    def append(self, fresh: DataFrame, model: str, run_id: str) -> int:
        """Store ``text_key, label, score`` rows under a model; returns how many this run stored."""
        return self._append(fresh.select("text_key", "score", "label"), model, run_id)


class VectorTable(_Table):
    """``vectors(model, text_key, embedding)``."""

    columns = [T.StructField("embedding", T.ArrayType(T.FloatType()))]
    keys = ["text_key"]
    value = "embedding"

    def entries(self, model: str, texts: DataFrame | None = None) -> DataFrame:
        return self.probe(self.read(model), texts)

    def latest(self, model: str, texts: DataFrame | None = None) -> DataFrame:
        """One row per text: ``text_key, embedding``."""
        return self._latest(self.entries(model, texts))

    def append(self, fresh: DataFrame, model: str, run_id: str) -> int:
        return self._append(fresh.select("text_key", "embedding"), model, run_id)
