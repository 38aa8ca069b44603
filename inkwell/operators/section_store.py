"""Section artifacts of long pages, reconciled with those of the version before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.functions import urls as U
from inkwell.operators import catalog as C
from inkwell.operators import ingest as G

#: Pages of more estimated tokens are split.
THRESHOLD = 6000
#: Fields of a section besides those of its page.
OWN = {"parent_cache_key": "string", "section_anchor": "string", "section_heading_path": "string"}


def build_sections(pages: DataFrame, *, compress=X.compress_markdown) -> DataFrame:
    """Artifacts of the sections of each long page, with its metadata; of equal anchors in a page the last one.

    pages: versions with the columns of ingest.FIELDS. Pages with fewer than two sections, short ones and those without
    a text have none. Sections are cut within the page's row; a shuffle by child key is only for equal anchors.
    """
    own = ("source_url", "source_urls", "content_hash", "compressed_tokens", "detailed_tokens", "summary", "compressed", "detailed", "provenance", "artifact_type", "cache_key", "file_name")
    kept = [n for n in G.FIELDS if n not in own]
    long = pages.where(X.estimate_tokens(F.col("detailed")) > THRESHOLD).select("cache_key", "detailed", "source_url", *kept)
    found = C.sections(long, key="cache_key", text="detailed", keep=("source_url", *kept))
    found = found.withColumn("child_key", U.child_key(F.col("key"), F.col("anchor")))
    last = found.groupBy("child_key").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in found.columns if c != "child_key"]), "section").alias("s")).select("child_key", "s.*")
    last = last.withColumns({"short": compress(F.col("content")), "at": F.concat("source_url", F.lit("#"), "anchor")})
    new = {
        "artifact_type": F.lit("section"), "source_url": F.col("at"), "source_urls": F.array("at"), "cache_key": F.col("child_key"), "content_hash": F.sha2("content", 256),
        "compressed_tokens": X.estimate_tokens(F.col("short")), "detailed_tokens": X.estimate_tokens(F.col("content")), "summary": F.col("heading_path"), "compressed": F.col("short"), "detailed": F.col("content"),
        "provenance": F.concat(F.lit('Section "'), "heading_path", F.lit('" of '), "source_url", F.lit(" (parent "), "key", F.lit(")")), "file_name": F.concat("child_key", F.lit(".md")),
    }
    columns = [(new[n] if n in new else F.col(n)).cast(t).alias(n) for n, t in G.FIELDS.items()]
    return last.select(*columns, F.col("key").alias("parent_cache_key"), F.col("anchor").alias("section_anchor"), F.col("heading_path").alias("section_heading_path"))


def refresh_sections(pages: DataFrame, current: DataFrame | None, *, compress=X.compress_markdown) -> DataFrame:
    """The section versions to write after pages were written: fresh ones, and prior ones that are gone, archived.

    current: versions of the store with OWN. A prior section is gone where it is active, of one of these pages in the
    same root, and its key isn't among the fresh ones: its heading went, or the page is short now. Sections of other
    pages stay as they are.
    """
    fresh = build_sections(pages, compress=compress)
    if current is None or any(n not in current.columns for n in OWN):
        return fresh
    prior = current.where("artifact_type = 'section' AND status = 'active'").select(*fresh.columns)
    of_these = prior.join(pages.select(F.col("cache_key").alias("parent_cache_key"), "root_rank").distinct(), ["parent_cache_key", "root_rank"], "left_semi")
    gone = of_these.join(fresh.select("cache_key", "root_rank"), ["cache_key", "root_rank"], "left_anti")
    return fresh.unionByName(gone.withColumn("status", F.lit("archived")))
