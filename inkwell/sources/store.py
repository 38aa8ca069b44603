"""A store of artifact versions as Parquet, with a log of commits: writes are atomic, repeated batches change nothing.

A commit stages its rows in a folder of its own, then creates the next numbered file of the log, which names the folder
and the batch; creating fails where the file is there already, so of two writers one takes the next number. Readers see
what the log names: what a killed attempt staged is never read. Versions are never overwritten: the last one written for
a key in a root is current, the earlier ones are superseded. compact() stages all of them anew in few files, in one
commit that also drops the old folders. vacuum() removes folders that the log doesn't name.

Driver work is the log alone: some hundred bytes a commit, whatever the size of the data.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns that the store adds: the commit's number, its batch, and whether the version says that its key is deleted.
COMMIT, BATCH, DELETED = "commit_no", "batch_id", "deleted"
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir; without one a local session uses a temporary folder, a cluster can't."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _OWN[app] = _OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="inkwell-")
    return f"{root.rstrip('/')}/inkwell/{what}-{uuid.uuid4().hex}"


class Store:
    """Versions of artifacts below a path of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(conf)
        self._files = self._hadoop.FileContext.getFileContext(self._fs.getUri(), conf)
        self._plain = spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def log(self) -> list[dict]:
        """Committed entries in order: no, batch, add and drop (folders), schema."""
        out = []
        for name in self._names("_log"):
            if name.endswith(".json"):
                stream = self._fs.open(self._at(f"_log/{name}"))
                try:
                    out.append(json.loads(bytes(stream.readAllBytes()).decode("utf-8")) | {"no": int(name[:-5])})
                finally:
                    stream.close()
        return out

    def _publish(self, entry: dict) -> int:
        """Creates the log's next file. It is written under another name first, so it is whole once it has its name."""
        raw = json.dumps(entry).encode("utf-8")
        while True:
            no = max([int(n[:-5]) for n in self._names("_log") if n.endswith(".json")], default=-1) + 1
            if entry["batch"] is not None and any(e["batch"] == entry["batch"] for e in self.log()):
                raise FileExistsError(entry["batch"])  # another attempt of this batch was faster
            draft = self._at(f"_log/.draft-{uuid.uuid4().hex}")
            stream = self._fs.create(draft, False)
            stream.write(raw)
            stream.close()
            try:
                # This rename fails where the number is taken, and is atomic where the file system's is.
                self._files.rename(draft, self._at(f"_log/{no:020d}.json"), self._plain)
                return no
            except Py4JJavaError as e:
                self._fs.delete(draft, False)
                if "AlreadyExists" not in e.java_exception.getClass().getName():
                    raise

    def delete(self, keys: DataFrame, batch: str | None = None) -> bool:
        """Marks keys (root_rank, cache_key) as deleted; False where the batch is in the log already. Their versions stay
        in the history until a compaction purges them, and a later commit brings a key back."""
        gone = keys.select("root_rank", "cache_key").distinct().withColumns({DELETED: F.lit(True), "validated_at": F.lit(None).cast("timestamp"), "content_hash": F.lit(None).cast("string")})
        return self.commit(gone, batch)

    def commit(self, rows: DataFrame, batch: str | None = None) -> bool:
        """Adds versions; False where the batch is in the log already. Of equal keys in one batch the newest is kept."""
        if batch is not None and any(e["batch"] == batch for e in self.log()):
            return False
        folder = f"data/{uuid.uuid4().hex}"
        newest(rows).write.parquet(f"{self.path}/{folder}")
        try:
            self._publish({"batch": batch, "add": [folder], "drop": [], "schema": rows.schema.jsonValue()})
        except FileExistsError:
            self._fs.delete(self._at(folder), True)
            return False
        return True

    def versions(self) -> DataFrame | None:
        """Every committed version with its commit's number and batch; None where nothing is committed."""
        log = self.log()
        gone = {f for e in log for f in e["drop"]}
        out = None
        for e in log:
            for folder in e["add"]:
                if folder not in gone:
                    part = self.spark.read.parquet(f"{self.path}/{folder}")
                    part = part if DELETED in part.columns else part.withColumn(DELETED, F.lit(False))
                    if COMMIT not in part.columns:
                        part = part.withColumns({COMMIT: F.lit(e["no"]).cast("long"), BATCH: F.lit(e["batch"]).cast("string")})
                    out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def history(self) -> DataFrame | None:
        """Every version, with `superseded_by`: the commit that wrote the key anew, null for the current one."""
        rows = self.versions()
        w = Window.partitionBy("root_rank", "cache_key").orderBy(COMMIT)
        return None if rows is None else rows.withColumn("superseded_by", F.lead(COMMIT).over(w))

    def current(self) -> DataFrame | None:
        """The last version written for each key in each root."""
        rows = self.versions()
        if rows is None:
            return None
        last = rows.groupBy("root_rank", "cache_key").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), COMMIT).alias("r"))
        return last.select("r.*").where(~F.col(DELETED)).drop(DELETED)

    def compact(self, files: int = 1, purge: bool = False) -> None:
        """All versions in few files; what readers see stays the same. purge: without those of deleted keys."""
        rows, log = self.versions(), self.log()
        if rows is None:
            return
        if purge:
            rows = rows.join(self.current().select("root_rank", "cache_key"), ["root_rank", "cache_key"], "left_semi")
        old = [f for e in log for f in e["add"]]
        folder = f"data/{uuid.uuid4().hex}"
        rows.repartition(files, "root_rank", "cache_key").write.parquet(f"{self.path}/{folder}")
        self._publish({"batch": None, "add": [folder], "drop": old, "schema": rows.schema.jsonValue()})

    def vacuum(self) -> int:
        """Removes staged folders that no entry names, and those that were dropped; no writer may be at work."""
        log = self.log()
        live = {f for e in log for f in e["add"]} - {f for e in log for f in e["drop"]}
        dead = [n for n in self._names("data") if f"data/{n}" not in live]
        for name in dead:
            self._fs.delete(self._at(f"data/{name}"), True)
        return len(dead)


def newest(rows: DataFrame) -> DataFrame:
    """One row for each key and root: the newest validated, of equally new ones that of the largest content hash or, where
    they are the same, of the largest text of the row."""
    order = F.struct(F.coalesce(F.col("validated_at"), F.timestamp_millis(F.lit(0))), F.coalesce(F.col("content_hash"), F.lit("")), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))
    last = rows.groupBy("root_rank", "cache_key").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), order).alias("r"))
    return last.select("r.*")
