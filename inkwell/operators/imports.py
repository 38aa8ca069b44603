"""Import of research notes that are supplied as text, with one source or several."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import safety as R
from inkwell.functions import temporal as T
from inkwell.functions import text as X
from inkwell.functions import urls as U
from inkwell.operators import ingest as G
from inkwell.plans import artifacts as A

LIMIT = 1 << 20
# The note on supplied texts.
SUPPLIED = "agent-supplied research import"


def import_notes(inputs: DataFrame, *, compress=X.compress_markdown, redact=R.redact_column, write_root: int = 0, global_root: int = 1, keywords: bool = True) -> tuple[DataFrame, DataFrame]:
    """Answers (note_id, code, exit_code, cache_key, target_root, secret) and the versions to write.

    inputs: note_id, body, and if they are there url (the one source), source_urls (several), topic, tags, tier, ttl,
    compressed (true: the body is the short form already, and is trusted as it is). A note is refused, in this order, for
    a malformed ttl, for both kinds of sources, for none, for several without a topic, for a blank body, for one above
    1 MiB, and for an address that is none. Its key is its address's, or that of its topic and sorted addresses; of notes
    of one key the one with the largest id is written. Notes with a secret go to the global root. Nulls count as missing.
    """
    kinds = dict(inputs.dtypes)
    want = {"note_id": kinds["note_id"], "body": "string", "url": "string", "source_urls": "array<string>", "topic": "string", "tags": "array<string>", "tier": "string", "ttl": "string", "compressed": "boolean"}
    n = G.columns_of(inputs, want)
    many = F.coalesce(F.size("source_urls"), F.lit(0)) > 0
    n = n.withColumns({"many": many, "single": F.coalesce(F.col("url") != "", F.lit(False))})
    given = F.when(F.col("many"), F.col("source_urls")).otherwise(F.array("url"))
    n = n.withColumn("places", F.transform(given, U.normalize_url))
    first = F.get(F.filter(given, lambda u: U.url_error(u).isNotNull() | U.normalize_url(u).isNull()), F.lit(0))
    n = n.withColumn("bad", first).withColumn("bad", F.when(F.exists("places", lambda u: u.isNull()), F.coalesce(U.url_error(F.col("bad")), F.lit("unparsable"))))
    blank = F.coalesce(U.trim_all(F.col("body")), F.lit("")) == ""
    code = (
        F.when(T.duration_error("--ttl", F.coalesce("ttl", F.lit("1d"))).isNotNull(), "INVALID_DURATION")
        .when(F.col("single") & F.col("many"), "CONFLICTING_FLAGS")
        .when(~F.col("single") & ~F.col("many"), "MISSING_URL")
        .when(F.col("many") & (F.coalesce("topic", F.lit("")) == ""), "MISSING_TOPIC")
        .when(blank, "EMPTY_INPUT")
        .when(F.octet_length("body") > LIMIT, "FILE_TOO_LARGE")
        .when(F.col("bad") == "missing_scheme", "MISSING_URL_SCHEME")
        .when(F.col("bad").isNotNull(), "INVALID_URL")
    )
    n = n.withColumn("code", code)
    good = n.where("code IS NULL").withColumn("places", F.when(F.col("many"), F.array_sort("places")).otherwise(F.col("places")))
    good = good.withColumns({"cache_key": F.when(F.col("many"), U.import_key(F.col("topic"), F.col("places"))).otherwise(U.cache_key(F.get("places", F.lit(0)))), "detailed": redact(F.col("body"))})
    good = good.withColumns({"short": F.when(F.coalesce("compressed", F.lit(False)), F.col("body")).otherwise(compress(F.col("detailed"))), "secret": X.secret_label(F.col("detailed"))})
    good = good.withColumn("root", F.when(F.col("secret").isNotNull(), global_root).otherwise(write_root))

    now, one = F.lit(A.AS_OF).cast("timestamp"), F.when(~F.col("many"), F.get("places", F.lit(0)))
    fresh, _ = T.windows(F.coalesce("tier", F.lit("standard")), F.col("ttl"))
    when = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    new = {
        "artifact_type": F.when(F.col("many"), "research_note").otherwise("source"), "source_url": F.when(F.col("many"), "").otherwise(F.col("url")), "source_urls": F.col("places"), "normalized_url": F.coalesce(one, F.lit("")),
        "cache_key": F.col("cache_key"), "topic": F.nullif(F.col("topic"), F.lit("")), "tags": F.col("tags"), "tier": F.coalesce("tier", F.lit("standard")), "ttl": F.nullif(F.col("ttl"), F.lit("")), "validated_at": now, "stale_after": F.timestamp_millis(A.as_of_ms() + fresh),
        "capture_method": F.lit("agent_supplied"), "extraction_status": F.lit("agent_supplied"), "extraction_confidence": F.lit("high"), "quality_notes": F.array(F.lit(SUPPLIED)), "supplied_at": now, "content_hash": F.sha2("detailed", 256),
        "compressed_tokens": X.estimate_tokens(F.col("short")), "detailed_tokens": X.estimate_tokens(F.col("detailed")), "status": F.lit("active"), "summary": F.concat(F.lit("Synthesized research for "), F.coalesce(one, "topic")),
        "compressed": F.col("short"), "detailed": F.col("detailed"), "provenance": F.concat(F.lit("Imported via agent-supplied research at "), when), "root_rank": F.col("root"), "file_name": F.concat("cache_key", F.lit(".md")),
    }
    rows = good.select("note_id", *[new.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in G.FIELDS.items()], F.lit("imported").alias("outcome"), "secret")
    last = rows.groupBy("cache_key", "root_rank").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "note_id"]), "note_id").alias("r")).select("r.*")
    answers = n.where("code IS NOT NULL").select("note_id", "code", F.when(F.col("code") == "FILE_TOO_LARGE", 1).otherwise(2).alias("exit_code"), F.lit(None).cast("string").alias("cache_key"), F.lit(None).cast("int").alias("target_root"), F.lit(None).cast("string").alias("secret"))
    done = good.select("note_id", F.lit(None).cast("string").alias("code"), F.lit(0).alias("exit_code"), "cache_key", F.col("root").cast("int").alias("target_root"), "secret")
    return answers.unionByName(done), G.tagged(last) if keywords else last
