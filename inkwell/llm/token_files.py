"""Token-ID output: flat unsigned integer files with 64-bit document offsets, memory-mapped.

A dataset is a folder of shards. ``<name>.bin`` holds the ids of its documents end to end, as little-endian
16-bit integers where the vocabulary allows it and 32-bit ones elsewhere; ``<name>.idx`` (an Arrow file) holds for
each document its key and the 64-bit offset of its end in the shard. The place of a shard in the whole follows from
the prefix sum of the shards' token counts, so shards are written independently and never rewritten.

Rows: a null or empty text is a document of the end id alone. A null key is kept and sorts first; rows with equal
keys are all kept, ordered by text. An empty table gives a dataset without shards. Columns other than the key and
the text are ignored.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import common, tokens

_MANIFEST = "part int, name string, n_docs long, n_tokens long, itemsize int"
_IDX = pa.schema([("key", pa.int64()), ("end", pa.int64())])


@dataclass(frozen=True)
class TokenDataset:
    """folder: its URI; shards: (name, n_docs, n_tokens, itemsize, base) in key order, one entry for each written shard."""

    folder: str
    shards: list[tuple[str, int, int, int, int]]

    def frame(self, spark: SparkSession) -> DataFrame:
        """A row for each shard, each in a task of its own."""
        rows = [(self.folder, *s) for s in self.shards]
        schema = "folder string, name string, n_docs long, n_tokens long, itemsize int, base long"
        return spark.createDataFrame(rows, schema).repartition(max(1, len(rows)))


def map_ids(fs: pafs.FileSystem, path: str, itemsize: int) -> np.ndarray:
    """The ids of a shard: mapped where the file is local, fetched elsewhere."""
    dtype = np.dtype(f"<u{itemsize}")
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if fs.get_file_info(path).size else np.empty(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, fs_path, bin_file = TaskContext.get().partitionId(), None, None
        name, n_docs, n_tokens, size = f"shard-{part:06d}-{uuid.uuid4().hex}", 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            enc = tokens.encoder(tokenizer)
            if bin_file is None:
                fs, path = fs_path = common.open_fs(folder)
                bin_file, raw = fs.open_output_stream(f"{path}/{name}.bin"), fs.open_output_stream(f"{path}/{name}.idx")
                idx, dtype = pa.ipc.new_file(raw, _IDX), np.dtype("<u2" if max(enc.max_id, end_id) < 1 << 16 else "<u4")
            ids, sizes = enc.encode_array(batch.column(1))
            bin_file.write(np.insert(ids.astype(dtype, copy=False), np.cumsum(sizes), end_id).tobytes())
            ends = n_tokens + np.cumsum(sizes + 1)
            idx.write_batch(pa.record_batch([batch.column(0), pa.array(ends, pa.int64())], schema=_IDX))
            n_docs, n_tokens, size = n_docs + len(sizes), int(ends[-1]), dtype.itemsize
        if bin_file is not None:
            bin_file.close()
            idx.close()
            raw.close()
            rows = [[part], [name], [n_docs], [n_tokens], [size]]
            types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32())
            yield pa.record_batch([pa.array(v, t) for v, t in zip(rows, types)], ["part", "name", "n_docs", "n_tokens", "itemsize"])

    return write


def write_tokens(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = 0,
    folder: str | None = None,
    ordered: bool = True,
) -> TokenDataset:
    """Encodes every whole text and writes the dataset, each document followed by end_id.

    ordered: shards are key ranges and ascending inside. Without it the rows stay in the input's partitions and order,
    which needs no shuffle. Only one row for each shard comes to the driver. A shard's name is its attempt's own, so a
    repeated task never touches another attempt's file; what unfinished attempts left is removed.
    """
    spark = docs.sparkSession
    common.small_batches(spark, 3000)
    folder = folder or common.shared_dir(spark, "tokens")
    common.make_dir(folder)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    if ordered:
        rows = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    found = rows.mapInArrow(_writer(folder, tokenizer or tokens.default_tokenizer(), end_id), _MANIFEST).collect()
    found.sort()
    fs, path = common.open_fs(folder)
    names = {r.name for r in found}
    for info in fs.get_file_info(pafs.FileSelector(path)):
        if info.is_file and info.base_name.rsplit(".", 1)[0] not in names:
            fs.delete_file(info.path)
    bases = itertools.accumulate((r.n_tokens for r in found), initial=0)
    return TokenDataset(folder, [(r.name, r.n_docs, r.n_tokens, r.itemsize, b) for r, b in zip(found, bases)])


def read_tokens(spark: SparkSession, dataset: TokenDataset, *, with_ids: bool = True) -> DataFrame:
    """A row for each document: key, start (in the whole dataset), n_tokens, ids as little-endian 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = common.open_fs(row["folder"])
                ids = map_ids(fs, f"{path}/{row['name']}.bin", row["itemsize"])
                with fs.open_input_file(f"{path}/{row['name']}.idx") as f:
                    index, at = pa.ipc.open_file(f), 0
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        ends = part.column(1).to_numpy()
                        starts = np.concatenate(([at], ends[:-1]))
                        at = int(ends[-1])
                        raw = [ids[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends)] if with_ids else [None] * len(ends)
                        yield pa.record_batch(
                            [part.column(0), pa.array(starts + row["base"], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(raw, pa.binary())],
                            ["key", "start", "n_tokens", "ids"],
                        )

    return dataset.frame(spark).mapInArrow(read, "key long, start long, n_tokens long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: documents written as token files with end id 0 and read back; see the module."""
    dataset = write_tokens(common.table(spark, sf_dir, "documents"), end_id=0)
    return read_tokens(spark, dataset).select(
        F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian 32-bit integers, as tests compute it."""
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
