"""Artifact files: one Markdown file for each artifact, read in parallel, the broken ones told apart and moved aside."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import frontmatter
from inkwell.operators import catalog as C


def read_artifacts(spark: SparkSession, roots: list[str], *, shallow: bool = False) -> DataFrame:
    """Rows of all roots in rank order: path, file_name, root_rank, error (null for artifacts), all fields and bodies.

    Files that aren't artifacts by name (drafts, superseded and corrupt ones) are never opened: names come from the
    listing. A shallow read has neither the detailed nor the provenance body, and cuts them off before it parses.
    """
    out = None
    for rank, root in enumerate(roots):
        files = spark.read.option("pathGlobFilter", "*.md").text(root, wholetext=True)
        named = files.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.lit(rank).alias("root_rank"))
        out = named if out is None else out.unionByName(named)
    if out is None:
        raise ValueError("a read needs a root")
    out = out.where(C.is_research_file(F.col("file_name"))).withColumn("value", F.replace(F.col("value"), F.lit("\r\n"), F.lit("\n")))
    return frontmatter.parse(out, "value", shallow=shallow)


def split_quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable artifacts, and the names of those to set aside."""
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL").select("path", "file_name", "root_rank", "error")


def quarantine(bad: DataFrame, stamp: str) -> DataFrame:
    """Moves files aside, where they lie, as <name>.corrupt.<stamp>: a row (path, moved_to) each.

    The tasks move what they are given. A file that is gone already was moved by an attempt before; its row comes again.
    """

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            for path in paths:
                fs, local = pafs.FileSystem.from_uri(path)
                local = unquote(local)
                if fs.get_file_info(local).type == pafs.FileType.File:
                    fs.move(local, f"{local}.corrupt.{stamp}")
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array([f"{p}.corrupt.{stamp}" for p in paths], pa.string())], ["path", "moved_to"])

    return bad.select("path").mapInArrow(move, "path string, moved_to string")
