"""Token counts: separator scan of flat token files that have no index.

Each file is cut into blocks of a fixed number of ids, whatever documents lie there. A vectorised search finds the
end-of-document ids of a block; what lies before its first and after its last one belongs to documents that reach
into other blocks. A prefix scan over the blocks of a file (a window of the blocks' few figures) gives each block the
number of documents ended before it and the ids carried into it, and a second pass counts the ids of each document.

Rows: ids after the last end id of a file form an open document (closed = false). A file without ids has no
documents. Every end id ends a document, so two in a row give a document of one id. Counts include the end id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm import common, token_files


def _block(row: dict) -> np.ndarray:
    fs, path = common.open_fs(row["uri"])
    size, start = row["itemsize"], row["block"] * row["block_ids"]
    with fs.open_input_file(path) as f:
        f.seek(start * size)
        return np.frombuffer(f.read(row["block_ids"] * size), f"<u{size}")


def count_tokens(files: DataFrame, *, end_id: int = 0, block_ids: int = 4 << 20) -> DataFrame:
    """files: uri string, itemsize int, n_ids long. A row for each document: uri, doc_no (from 0 in its file), start, n_tokens, closed."""
    blocks = files.where("n_ids > 0").select(
        "uri",
        "itemsize",
        F.lit(block_ids).cast("long").alias("block_ids"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_ids") - 1) / block_ids))).alias("block"),
    )
    blocks = blocks.repartition(F.hash("uri", "block"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for row in rows:
                ids = _block(row)
                ends = np.flatnonzero(ids == end_id)
                out.append((len(ends), int(len(ids) - 1 - ends[-1]) if len(ends) else len(ids)))
            figures = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(figures[:, 0]), pa.array(figures[:, 1])], [*batch.schema.names, "ended", "tail"])

    found = blocks.mapInArrow(first, "uri string, itemsize int, block_ids long, block long, ended long, tail long")
    before = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Ids carried in: the tail of the last block with an end, and the whole blocks since.
    tails = F.coalesce(F.sum("tail").over(before), F.lit(0))
    last_end = F.max(F.when(F.col("ended") > 0, F.col("block"))).over(before)
    scanned = (
        found.withColumn("doc_no", F.coalesce(F.sum("ended").over(before), F.lit(0)))
        .withColumn("tails", tails)
        .withColumn("last_end", last_end)
        .withColumn("before_end", F.when(F.col("ended") > 0, F.col("tails")))
    )
    scanned = scanned.withColumn(
        "carried", F.col("tails") - F.coalesce(F.max("before_end").over(before), F.lit(0))
    ).withColumn("is_last", F.lead("block").over(Window.partitionBy("uri").orderBy("block")).isNull())
    keep = ["uri", "itemsize", "block_ids", "block", "doc_no", "carried", "is_last"]

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _block(row)
                ends = np.flatnonzero(ids == end_id)
                at = row["block"] * row["block_ids"]
                open_ids = row["is_last"] and (len(ids) - 1 - ends[-1] if len(ends) else row["carried"] + len(ids))
                stops = np.append(ends, len(ids) - 1) if open_ids else ends
                starts = np.concatenate(([-row["carried"]], ends + 1))[: len(stops)]
                n = len(stops)
                yield pa.record_batch(
                    [
                        pa.array([row["uri"]] * n, pa.string()),
                        pa.array(np.arange(n) + row["doc_no"], pa.int64()),
                        pa.array(starts + at, pa.int64()),
                        pa.array(stops - starts + 1, pa.int64()),
                        pa.array(np.arange(n) < len(ends)),
                    ],
                    ["uri", "doc_no", "start", "n_tokens", "closed"],
                )

    return (
        scanned.select(keep)
        .repartition(F.hash("uri", "block"))
        .mapInArrow(second, "uri string, doc_no long, start long, n_tokens long, closed boolean")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: tokens of each document of `documents`, counted in flat files of their ids (end id 50257, which no text encodes to).

    The files are written in the order of the input, without a shuffle. The scan reads the ids alone; the documents'
    keys, which the writer keeps beside each file, name its results by their position.
    """
    data = token_files.write_tokens(common.table(spark, sf_dir, "documents"), end_id=END_ID, ordered=False)
    files = spark.createDataFrame(
        [(f"{data.folder}/{name}.bin", size, n) for name, _, n, size, _ in data.shards], "uri string, itemsize int, n_ids long"
    )
    counted = count_tokens(files, end_id=END_ID)
    keys = token_files.read_tokens(spark, data, with_ids=False).select("key", "start", "n_tokens")
    bases = spark.createDataFrame([(f"{data.folder}/{name}.bin", base) for name, _, _, _, base in data.shards], "uri string, base long")
    placed = counted.join(F.broadcast(bases), "uri").withColumn("start", F.col("start") + F.col("base"))
    # Statistics of either side come from the short list of files; without the hint one would be broadcast whole.
    names = keys.select("start", F.col("key").alias("doc_id")).hint("merge")
    return placed.join(names, "start", "left").select(
        "doc_id", "start", "n_tokens", F.regexp_extract("uri", r"shard-(\d+)", 1).cast("long").alias("file_no"), "doc_no", "closed"
    )


#: One past the vocabulary: no text encodes to it, whatever it spells.
END_ID = 50257
