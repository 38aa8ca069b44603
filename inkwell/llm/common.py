"""What the operators of this subpackage share: tables, the shared folder, words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of plain words: ``[^\x20\x09-\x0D]+``; the set on which ``bytes.split()`` cuts.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Alphanumeric words of text whose A-Z are lower-cased: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


_OWN: dict[str, str] = {}
_CACHES: list[dict] = []
_OWNER: list[str] = [""]


def keep(cache: dict) -> dict:
    """Registers a cache of Python workers; see claim()."""
    _CACHES.append(cache)
    return cache


def claim(owner: str) -> None:
    """Workers outlive tasks: the first task of another operator lets go of what the last one kept."""
    if _OWNER[0] != owner:
        _OWNER[0] = owner
        for cache in _CACHES:
            cache.clear()
        trim()


def trim() -> None:
    """Gives freed memory back to the system: a worker that waits beside a later stage should hold little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if release := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        release(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """URI of a new folder under spark.checkpoint.dir, which driver and executors share.

    Where a local session has no such setting (tests, a laptop), a temporary folder of the driver takes its place; the
    setting itself can't be changed in a running session. Executors of a cluster don't see such a folder: an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _OWN.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="inkwell-")
        _OWN[spark.sparkContext.applicationId] = root
    if "://" not in root:
        # A bare path lies in the cluster's default file system, for Spark's writers and for ours.
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        root = root.replace("file:/", "file:///", 1) if root.startswith("file:/") and not root.startswith("file://") else root
    return f"{root.rstrip('/')}/inkwell/{what}-{uuid.uuid4().hex}"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{uri}"
    return pafs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)


def remove(uri: str) -> None:
    fs, path = open_fs(uri)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


def materialized(df: DataFrame, uri: str) -> DataFrame:
    """Writes df as Parquet and reads it back: cuts the lineage, survives lost executors."""
    df.write.mode("overwrite").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def small(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table of one column of ids, to be broadcast if it is proven small, and else to be joined by shuffle."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bounds what a Python worker holds at once; long texts make default batches very large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a part's texts have about `most` bytes; one text is never cut, and empty batches go."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts, at = np.cumsum(sizes) // most, 0
        while at < len(sizes):
            end = int(np.searchsorted(parts, parts[at], "right"))
            yield batch.slice(at, end - at)
            at = end


def to_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def space_words(text: str | None) -> list[bytes]:
    """Whitespace-separated words, A-Z lower-cased (other letters stay as they are)."""
    return to_bytes(text).lower().split()


def alnum_words(text: str | None) -> list[bytes]:
    """Alphanumeric words, A-Z lower-cased; every non-ASCII character belongs to a word."""
    return to_bytes(text).translate(_ALNUM_TABLE).split()


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, so that sums of mixed values hash sequences and sets well."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def planes(x: np.ndarray) -> bytes:
    """32-bit integers by planes of bytes, which compress better."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def hash_runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words, from the words' hashes; order counts."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = mix(hashes[:count] + np.uint64(n))
    for k in range(1, n):
        out = mix(out * np.uint64(3) + hashes[k : k + count])
    return out
