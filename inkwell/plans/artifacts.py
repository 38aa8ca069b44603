"""Derived relations: the artifact catalog over the raw tables. Times are functions of ids and of AS_OF, never of the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import temporal as T
from inkwell.functions import text as X
from inkwell.functions import urls as U

AS_OF = "2024-08-01 00:00:00"


def as_of_ms() -> Column:
    return F.unix_millis(F.lit(AS_OF).cast("timestamp"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page: keys, tier, ttl, times and root, without the body unless it is asked for."""
    pages = table(spark, sf_dir, "pages").withColumn("normalized_url", U.normalize_url(F.col("url")))
    day = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.pmod("page_id", F.lit(200)).cast("int"))
    third, fourth = F.pmod("page_id", F.lit(3)), F.pmod("page_id", F.lit(4))
    return pages.where("normalized_url IS NOT NULL").select(
        "page_id",
        F.lit("source").alias("artifact_type"),
        F.col("url").alias("source_url"),
        F.array("url").alias("source_urls"),
        "normalized_url",
        U.cache_key(F.col("normalized_url")).alias("cache_key"),
        F.concat(F.lit("topic "), F.pmod("page_id", F.lit(5)).cast("string")).alias("topic"),
        F.array(F.concat(F.lit("Tag"), third.cast("string")), F.concat(F.lit("kind"), fourth.cast("string"))).alias("tags"),
        F.when(third == 0, "stable").when(third == 1, "standard").otherwise("volatile").alias("tier"),
        F.when(fourth == 1, "2h").when(fourth == 2, "7d").when(fourth == 3, "6m").alias("ttl"),
        day.alias("fetched_at"),
        F.when(F.pmod("page_id", F.lit(7)) != 0, day + F.make_dt_interval(F.pmod("page_id", F.lit(11)).cast("int"))).alias("validated_at"),
        F.when(F.pmod("page_id", F.lit(2)) == 0, "static").otherwise("rendered").alias("capture_method"),
        F.when(F.pmod("page_id", F.lit(13)) == 0, "superseded").otherwise("active").alias("status"),
        F.pmod("page_id", F.lit(2)).cast("int").alias("root_rank"),
        F.concat(F.lpad(F.col("page_id").cast("string"), 12, "0"), F.lit(".md")).alias("file_name"),
        "html",
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The artifacts, and for a third of them an earlier copy in the other root."""
    now = artifacts(spark, sf_dir).drop("html")
    old = now.where("page_id % 3 = 0").withColumns(
        {
            "validated_at": F.col("fetched_at") - F.make_dt_interval(F.lit(5)),
            "root_rank": 1 - F.col("root_rank"),
            "file_name": F.concat(F.lit("v0-"), F.col("file_name")),
        }
    )
    return now.unionByName(old)


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown with headings, a fence, a table, a list, links and an image at fixed places."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    body = F.concat(
        F.lit("# "), F.col("source"), F.lit("\n\nIntro of [the page](https://x.test/a).\n\n## Part `one` of "), F.col("lang"),
        F.lit("\n\n"), F.col("text"),
        F.lit("\n\n```sh\n## not a heading\nmkdir my-projectcd my-project\n```\n\n### Detail [more](https://x.test/b_(c))\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n- item\n1. step\n\n"),
        F.when(F.pmod("doc_id", F.lit(2)) == 0, "![pic](data:image/png;base64,AA==)\n\n").otherwise(""),
        F.lit("## Notes & more!\n\nSee "), F.col("source"), F.lit(".\n"),
    )
    return docs.select("doc_id", "source", "lang", "text", body.alias("markdown"))


def with_age(rows: DataFrame, ttl_override: Column | None = None) -> DataFrame:
    """Adds age_ms, fresh_ms, grace_ms, freshness and stale_after."""
    ttl = F.col("ttl") if ttl_override is None else F.coalesce(F.nullif(ttl_override, F.lit("")), F.col("ttl"))
    fresh, grace = T.windows(F.col("tier"), ttl)
    out = rows.withColumns({"age_ms": as_of_ms() - T.base_ms(F.col("fetched_at"), F.col("validated_at")), "fresh_ms": fresh, "grace_ms": grace})
    return out.withColumns(
        {
            "freshness": T.freshness(F.col("age_ms"), F.col("fresh_ms"), F.col("grace_ms")),
            "stale_after_ms": as_of_ms() + F.col("fresh_ms"),
        }
    )


def word_terms(text: Column) -> Column:
    return X.content_tokens(X.tokenize(X.clean_noise(text)))
