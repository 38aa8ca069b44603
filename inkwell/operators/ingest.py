"""Read-through ingest: requests are answered from the catalog, and only what is missing or stale is taken from responses.

The plan is two joins by cache key, each side reduced to one row a key before: requests with the catalog's newest
version, then those that need a page with its response. A key asked for twice is fetched once. What changes is one row
for each key, to be committed to a store; a second run over the result fetches nothing that is fresh.

Each key ends in one of these outcomes: `hit` (fresh, and no older than max_age), `miss` (fetched for the first time, or
by force), `revalidated` (304: dates move, the content stays; or fresh but older than max_age: nothing moves), `refreshed`
(200: new content, the user's metadata carried over), `stale` (the fetch failed within the grace period), `failed` (it
failed otherwise), `rejected` (the address is no target).
A page that says that it was not found becomes a marker of its own, with extraction_status failed, so it isn't asked for
again before it goes stale; the extraction of a page counts as failed where its markdown is null, as 304 does on a miss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import temporal as T
from inkwell.functions import text as X
from inkwell.functions import urls as U
from inkwell.operators import catalog as C
from inkwell.plans import artifacts as A

#: Metadata that a refresh carries over from the version before.
CARRIED = ("topic", "tags", "site_module_id", "docs_engine", "docs_framework", "search_provider", "source_doc_url", "tier", "ttl")
#: Fields of a version that ingest writes, with their types.
FIELDS = {
    "artifact_type": "string", "source_url": "string", "source_urls": "array<string>", "normalized_url": "string", "cache_key": "string",
    "topic": "string", "tags": "array<string>", "tier": "string", "ttl": "string", "fetched_at": "timestamp", "validated_at": "timestamp",
    "stale_after": "timestamp", "capture_method": "string", "extraction_status": "string", "extraction_confidence": "string",
    "quality_notes": "array<string>", "supplied_at": "timestamp", "supplied_by": "string", "etag": "string", "last_modified": "string", "content_hash": "string", "compressed_tokens": "long",
    "detailed_tokens": "long", "status": "string", "site_module_id": "string", "docs_engine": "string", "docs_framework": "string",
    "search_provider": "string", "source_doc_url": "string", "summary": "string", "compressed": "string", "detailed": "string",
    "provenance": "string", "root_rank": "int", "file_name": "string",
}
# An error page's marker, and the note of tags taken from the text.
AUTO_TAGS = "auto-generated tags via keyword extraction"
_REASON = "page reported an error or was not found"


def columns_of(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """rows with every field, null where it has none."""
    return rows.select(*[(F.col(f"`{n}`") if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields.items()])


def _marker(url: Column) -> Column:
    return F.concat(F.lit("Error: "), url, F.lit(f" could not be cached — {_REASON}. The page returned an error, so its content was not stored; it will be re-fetched when this entry goes stale."))


def read_through(
    requests: DataFrame,
    catalog: DataFrame | None,
    responses: DataFrame,
    *,
    compress=X.compress_markdown,
    max_age: str | None = None,
    allow_stale: bool = False,
    write_root: int = 0,
    global_root: int = 1,
    keywords: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Answers (a row for each request) and changes (a row for each key to write, with FIELDS).

    requests: request_id, url, and if they are there topic, tags, tier, ttl and force. catalog: versions with the columns
    of FIELDS, missing ones null. responses: normalized_url, http_status (null: the request failed), error, and of the
    extraction title, markdown (null: it failed), confidence, notes; etag, last_modified and capture_method if they are
    there; of several for one address the first by content is taken. compress: a column function for the short form.
    Requests of one key with different metadata take that of the smallest request_id. Null addresses are rejected.
    """
    asked = columns_of(requests, dict(requests.dtypes) | {"topic": "string", "tags": "array<string>", "tier": "string", "ttl": "string", "force": "boolean"})
    asked = asked.withColumns({"normalized_url": U.normalize_url(F.col("url")), "reject": U.url_error(F.col("url"))})
    asked = asked.withColumn("reject", F.when(F.col("normalized_url").isNull(), F.coalesce("reject", F.lit("invalid address"))))
    asked = asked.withColumn("cache_key", F.when(F.col("reject").isNull(), U.cache_key(F.col("normalized_url"))))
    own = F.struct("url", "normalized_url", "topic", "tags", F.coalesce("tier", F.lit("standard")).alias("tier"), "ttl")
    wanted = asked.where("cache_key IS NOT NULL").groupBy("cache_key").agg(F.min_by(own, "request_id").alias("own"), F.bool_or(F.coalesce("force", F.lit(False))).alias("force"))

    empty = requests.sparkSession.createDataFrame([], ", ".join(f"{n} {t}" for n, t in FIELDS.items()))
    known = A.with_age(C.locate(columns_of(empty if catalog is None else catalog, FIELDS)))
    known = known.select("cache_key", "freshness", "age_ms", F.struct(*FIELDS).alias("old"))
    # What is forced is looked up nowhere.
    keys = wanted.join(known, (known["cache_key"] == wanted["cache_key"]) & ~wanted["force"], "left").drop(known["cache_key"])
    keys = keys.withColumn("need", F.coalesce(F.col("freshness") != "fresh", F.lit(True)))
    keys = keys.withColumn("aged", T.max_age_expired(F.col("age_ms"), max_age)).withColumn("place", F.when(F.col("need"), F.col("own.normalized_url")))

    fetched = {"normalized_url": "string", "http_status": "int", "error": "string", "title": "string", "markdown": "string", "confidence": "string", "notes": "array<string>", "etag": "string", "last_modified": "string", "capture_method": "string"}
    pages = columns_of(responses, fetched)
    first = F.struct(*[F.col(n) for n in fetched if n != "normalized_url"])
    # Only pages that are asked for travel whole; where there are several of one address the first by content counts.
    places = keys.where("need").select(F.col("place").alias("normalized_url")).distinct()
    pages = pages.join(places, "normalized_url", "left_semi").groupBy(F.col("normalized_url").alias("place")).agg(F.min(first).alias("new"))
    keys = keys.join(pages, "place", "left")

    got = (F.col("new.http_status") == 200) & F.col("new.markdown").isNotNull() & F.col("new.error").isNull()
    same = (F.col("new.http_status") == 304) & F.col("new.error").isNull() & F.col("freshness").isNotNull()
    outcome = (
        F.when(~F.col("need"), F.when(F.col("aged"), "revalidated").otherwise("hit"))
        .when(F.coalesce(got, F.lit(False)), F.when(F.col("freshness").isNull(), "miss").otherwise("refreshed"))
        .when(F.coalesce(same, F.lit(False)), "revalidated")
        .when(F.col("freshness") == "stale_grace", "stale")
        .otherwise("failed")
    )
    why = F.coalesce("new.error", F.when(F.col("new").isNull(), "no response").when(F.col("new.http_status") == 200, "Content extraction failed").otherwise(F.concat(F.lit("Fetch failed with status "), F.coalesce(F.col("new.http_status").cast("string"), F.lit("unknown")))))
    keys = keys.withColumn("outcome", outcome).withColumn("error", F.when(F.col("outcome").isin("stale", "failed"), why))
    changed = _changed(keys.where("need AND outcome IN ('miss', 'refreshed', 'revalidated')"), compress, write_root, global_root)
    if keywords:
        changed = tagged(changed)

    state = F.when(F.col("freshness").isNull(), "none").when(F.col("aged"), "stale_expired").otherwise(F.col("freshness"))
    code = F.when(F.col("outcome") == "failed", 1).when(F.col("outcome") == "stale", 0 if allow_stale else 5).otherwise(0)
    told = keys.select("cache_key", "outcome", state.alias("freshness"), "error", code.alias("exit_code"))
    answers = asked.where("cache_key IS NOT NULL").select("request_id", "url", "cache_key").join(told, "cache_key")
    # Rejected requests have no key to be joined by.
    none = F.lit(None).cast("string")
    rejected = asked.where("cache_key IS NULL").select("request_id", "url", none.alias("cache_key"), F.lit("rejected").alias("outcome"), none.alias("freshness"), F.col("reject").alias("error"), F.lit(2).alias("exit_code"))
    return answers.select(rejected.columns).unionByName(rejected), changed


def _changed(keys: DataFrame, compress, write_root: int, global_root: int) -> DataFrame:
    """The version that each key gets: the old one with new dates, or a new one."""
    now, same = F.lit(A.AS_OF).cast("timestamp"), F.col("outcome") == "revalidated"
    failed = X.looks_like_error_page(F.col("new.markdown"))
    url = F.coalesce("old.source_url", "own.normalized_url")
    body = F.when(failed, _marker(url)).otherwise(F.col("new.markdown"))
    rows = keys.withColumns({"body": body, "bad": F.coalesce(failed, F.lit(False)), "had": F.col("old").isNotNull(), "at": url})
    rows = rows.withColumn("short", F.when(F.col("bad"), F.col("body")).otherwise(compress(F.col("body"))))
    carried = {n: F.when(F.col("had"), F.col(f"old.{n}")).otherwise(F.col(f"own.{n}") if n in ("topic", "tags", "tier", "ttl") else F.lit(None)) for n in CARRIED}
    rows = rows.withColumns({f"kept_{n}": c.cast(FIELDS[n]) for n, c in carried.items()})
    fresh, _ = T.windows(F.col("kept_tier"), F.col("kept_ttl"))
    secret = X.secret_label(F.concat_ws("\n", "new.title", "body"))
    # A page that is new goes to the project unless it holds a secret; one that is known stays where it is.
    root = F.when(F.col("had"), F.col("old.root_rank")).otherwise(F.when(secret.isNotNull(), global_root).otherwise(write_root))
    when = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    new = {
        "artifact_type": F.lit("source"), "source_url": F.col("at"), "source_urls": F.array("at"), "normalized_url": F.coalesce("old.normalized_url", "own.normalized_url"),
        "cache_key": F.col("cache_key"), "fetched_at": now, "capture_method": F.coalesce("new.capture_method", F.lit("static_fetch")),
        "extraction_status": F.when(F.col("bad"), "failed").otherwise("extracted"), "extraction_confidence": F.when(~F.col("bad"), F.col("new.confidence")),
        "quality_notes": F.when(F.col("bad"), F.array(F.lit(f"error: {_REASON}"))).otherwise(F.coalesce("new.notes", F.array().cast("array<string>"))),
        "etag": F.col("new.etag"), "last_modified": F.col("new.last_modified"), "content_hash": F.sha2("body", 256),
        "compressed_tokens": X.estimate_tokens(F.col("short")), "detailed_tokens": X.estimate_tokens(F.col("body")), "status": F.lit("active"),
        "summary": F.when(F.col("bad"), f"Error: {_REASON}").otherwise(F.col("new.title")), "compressed": F.col("short"), "detailed": F.col("body"),
        "provenance": F.concat(F.lit("Fetched from "), F.col("at"), F.lit(" on "), when, F.when(F.col("bad"), " (error page; content not cached)").otherwise("")),
        "root_rank": root, "file_name": F.concat("cache_key", F.lit(".md")), "supplied_at": F.lit(None), "supplied_by": F.lit(None),
    } | {n: F.col(f"kept_{n}") for n in CARRIED}
    out = {n: F.when(same, F.col(f"old.{n}")).otherwise(new[n]) if n in new else None for n in FIELDS}
    out |= {"validated_at": now, "stale_after": F.timestamp_millis(A.as_of_ms() + fresh)}
    return rows.select(*[out[n].cast(t).alias(n) for n, t in FIELDS.items()], "outcome", F.when(~F.col("had") & (root != write_root), secret).alias("secret"))


def tagged(changed: DataFrame) -> DataFrame:
    """Tags of new content without blanks and repeats; where none is left its five keywords, and a note of it."""
    changed = changed.withColumn("tags", F.when(F.col("outcome") == "revalidated", F.col("tags")).otherwise(X.dedupe_tags(F.coalesce("tags", F.array().cast("array<string>")))))
    bare = (F.col("outcome") != "revalidated") & (F.size("tags") == 0)
    found = C.keywords(changed.where(bare).select("cache_key", "detailed"), key="cache_key", text="detailed")
    found = found.groupBy(F.col("key").alias("cache_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("found"))
    out = changed.join(found, "cache_key", "left")
    noted = F.when(F.col("found").isNotNull(), F.array_append("quality_notes", F.lit(AUTO_TAGS))).otherwise(F.col("quality_notes"))
    return out.withColumns({"tags": F.coalesce("found", "tags"), "quality_notes": noted}).drop("found")
