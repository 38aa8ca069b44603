"""Queries over the artifact catalog: lookup, list, status, inspect, prune, revalidation, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import temporal as T
from inkwell.functions import text as X
from inkwell.functions import urls as U
from inkwell.plans.artifacts import as_of_ms, with_age
from inkwell.sources.store import Store


def is_research_file(name: Column) -> Column:
    return name.endswith(".md") & ~name.contains(".tmp") & ~name.contains(".corrupt") & ~name.contains(".superseded")


def first_per_key(rows: DataFrame) -> DataFrame:
    """Union of roots in which the first root shadows the others, by key; before any other filter."""
    w = Window.partitionBy("cache_key").orderBy("root_rank", "file_name")
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def latest(rows: DataFrame, *by: str) -> DataFrame:
    """Newest active version of each key (and of each root, if that is in `by`); the first file wins ties."""
    validated = F.coalesce(T.to_ms(F.col("validated_at")), F.lit(0).cast("long"))
    w = Window.partitionBy("cache_key", *by).orderBy(validated.desc(), "file_name")
    return rows.where("status = 'active'").withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def locate(rows: DataFrame) -> DataFrame:
    """Newest version in the first root that holds the key at all."""
    w = Window.partitionBy("cache_key").orderBy("root_rank")
    return latest(rows, "root_rank").withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def list_artifacts(
    rows: DataFrame,
    *,
    topic: str | None = None,
    tags: list[str] | None = None,
    url: str | None = None,
    artifact_type: str | None = None,
    capture_method: str | None = None,
    freshness: str | None = None,
    limit: int = 50,
) -> DataFrame:
    """Active artifacts that pass the filters, newest first, with how many there are; cheap predicates come first."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must lie in 1..100")
    out = with_age(first_per_key(rows)).where("status = 'active' AND artifact_type <> 'section'")
    if topic is not None:
        out = out.where(F.lower(U.trim_all(F.col("topic"))) == topic.strip().lower())
    for tag in tags or []:
        out = out.where(F.array_contains(F.transform("tags", F.lower), tag.lower()))
    for name, value in (("artifact_type", artifact_type), ("capture_method", capture_method), ("freshness", freshness)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if url is not None:
        out = out.where(U.any_glob_match(F.col("source_urls"), url))
    when = F.coalesce(T.to_ms(F.col("validated_at")), T.to_ms(F.col("fetched_at")), F.lit(0).cast("long"))
    out = out.withColumn("sort_ms", when)
    total = out.agg(F.count("*").alias("matched"))
    top = out.orderBy(F.desc("sort_ms"), "root_rank", "file_name").limit(limit)
    return top.crossJoin(F.broadcast(total)).select(
        "cache_key", "normalized_url", "topic", "tier", "capture_method", "freshness", "sort_ms", "root_rank", "matched"
    )


def status(requests: DataFrame, catalog: DataFrame, max_age: str | None = None) -> DataFrame:
    """What a fetch of each request would do."""
    asked = requests.withColumns({"normalized_url": U.normalize_url(F.col("url")), "error": U.url_error(F.col("url"))})
    asked = asked.withColumn("cache_key", U.cache_key(F.col("normalized_url")))
    known = with_age(locate(catalog)).select("cache_key", "freshness", "age_ms")
    out = asked.join(known, "cache_key", "left")
    state = F.when(T.max_age_expired(F.col("age_ms"), max_age), "stale_expired").otherwise(F.col("freshness"))
    out = out.withColumn("state", F.when(F.col("freshness").isNull(), "none").otherwise(state))
    action = F.when(F.col("state") == "none", "would_fetch").when(F.col("state") == "fresh", "would_return_cached").otherwise("would_revalidate")
    return out.select(
        "request_id",
        "url",
        "error",
        "cache_key",
        F.when(F.col("state") == "none", "miss").otherwise("hit").alias("cache"),
        "state",
        F.when(F.col("error").isNotNull(), "reject").otherwise(action).alias("action"),
        F.when(F.col("error").isNotNull(), 2).when(F.col("state") == "none", 1).otherwise(0).alias("exit_code"),
    )


def prune(
    rows: DataFrame, *, older_than: str | None = None, inactive: str | None = None, url: str | None = None, artifact_type: str | None = None
) -> DataFrame:
    """Every version in every root that a prune would remove; an age on the boundary is removed."""
    if not any((older_than, inactive, url, artifact_type)):
        raise ValueError("prune needs a filter")
    out = with_age(rows)
    if artifact_type:
        out = out.where(F.col("artifact_type") == artifact_type)
    for limit in filter(None, (older_than, inactive)):
        out = out.where(F.col("age_ms") >= T.literal_ms(limit))
    if url:
        out = out.where(U.any_glob_match(F.col("source_urls"), url))
    return out


def prune_store(
    store: Store, *, dry_run: bool = False, yes: bool = False, batch: str | None = None, older_than: str | None = None, inactive: str | None = None, url: str | None = None, artifact_type: str | None = None
) -> DataFrame:
    """The current versions that the filters match, in every root, deleted if `yes`; either a dry run or `yes` is asked for.

    The rows are those of the store as it was. A batch that is in the store's log already deletes nothing more.
    """
    if not any((older_than, inactive, artifact_type, url)):
        raise ValueError("Must specify at least one pruning filter: --older-than, --inactive, --artifact-type, or --url.")
    if dry_run and yes:
        raise ValueError("--dry-run and --yes are mutually exclusive: --dry-run previews without deleting, --yes confirms deletion. Choose one.")
    if not dry_run and not yes:
        raise ValueError("Safety check: use --yes to confirm pruning, or --dry-run to preview files that would be deleted.")
    rows = store.current()
    if rows is None:
        raise ValueError("nothing was committed to this store")
    found = prune(rows, older_than=older_than, inactive=inactive, url=url, artifact_type=artifact_type)
    if yes:
        store.delete(found, batch)
    return found.select("root_rank", "cache_key", "file_name", "topic", "source_url", "age_ms")


def revalidate(rows: DataFrame, probes: DataFrame, *, allow_stale: bool = False) -> DataFrame:
    """State after a probe of each artifact: probes have cache_key, http_status (null: error), body."""
    out = with_age(locate(rows)).join(probes, "cache_key", "left")
    out = out.withColumn("outcome", T.revalidation(F.col("freshness"), F.col("http_status")))
    touched = (F.col("outcome") == "refreshed") | ((F.col("outcome") == "revalidated") & (F.col("freshness") != "fresh"))
    new_hash = F.when(F.col("outcome") == "refreshed", F.sha2("body", 256))
    stale_code = 0 if allow_stale else 5
    return out.select(
        "cache_key",
        "freshness",
        "outcome",
        F.when(touched, as_of_ms()).otherwise(T.to_ms(F.col("validated_at"))).alias("validated_ms"),
        F.when(touched, F.col("stale_after_ms")).alias("stale_after_ms"),
        new_hash.alias("content_hash"),
        "topic",
        "tags",
        F.when(F.col("outcome") == "error", 1).when(F.col("outcome") == "stale", stale_code).otherwise(0).alias("exit_code"),
    )


def sections(docs: DataFrame, key: str = "doc_id", text: str = "markdown", keep: tuple[str, ...] = ()) -> DataFrame:
    """H2 and H3 sections of each document that has two or more, with anchor, breadcrumb, content and the columns to keep.

    Fences and headings are folded in order within the row, and each section is cut from the row's own lines: nothing is
    shuffled, and lines never travel.
    """
    base = docs.select(F.col(key).alias("key"), *keep, F.split(F.col(text), "\n").alias("lines"))
    pattern = r"^(#{1,6})\s+(.+?)\s*#*\s*$"

    def mark(line: Column, at: Column) -> Column:
        heading = F.struct(at.alias("at"), F.length(F.regexp_extract(line, pattern, 1)).alias("level"), X.heading_plain_text(F.regexp_extract(line, pattern, 2)).alias("title"))
        fence = F.struct(at.alias("at"), F.lit(0).alias("level"), F.lit("").alias("title"))
        return F.when(line.rlike(r"^\s*```"), fence).when(line.rlike(pattern), heading)

    def step(s: Column, m: Column) -> Column:
        live = ~s["fenced"] & (m["level"] > 0)
        # The H2 before an H3 carries the H1 that it saw itself.
        path = F.when(m["level"] == 2, F.concat_ws(" > ", s["h1"], m["title"])).otherwise(F.concat_ws(" > ", s["h2_h1"], s["h2"], m["title"]))
        found = F.struct(m["at"].alias("at"), m["level"].alias("level"), m["title"].alias("title"), path.alias("path"))
        is_h2 = live & (m["level"] == 2)
        return F.struct(
            F.when(m["level"] == 0, ~s["fenced"]).otherwise(s["fenced"]).alias("fenced"),
            F.when(live & (m["level"] == 1), m["title"]).otherwise(s["h1"]).alias("h1"),
            F.when(is_h2, m["title"]).otherwise(s["h2"]).alias("h2"),
            F.when(is_h2, s["h1"]).otherwise(s["h2_h1"]).alias("h2_h1"),
            F.when(live & m["level"].isin(2, 3), F.array_append(s["found"], found)).otherwise(s["found"]).alias("found"),
        )

    none = F.lit(None).cast("string")
    start = F.struct(F.lit(False).alias("fenced"), none.alias("h1"), none.alias("h2"), none.alias("h2_h1"), F.array().cast("array<struct<at:int,level:int,title:string,path:string>>").alias("found"))
    marks = F.filter(F.transform("lines", mark), lambda m: m.isNotNull())
    base = base.select("key", *keep, "lines", F.aggregate(marks, start, step, lambda s: s["found"]).alias("found")).where(F.size("found") >= 2)

    def cut(x: Column, place: Column) -> Column:
        end = F.coalesce(F.get("found", place + 1)["at"], F.size("lines"))
        content = U.trim_all(F.array_join(F.slice("lines", x["at"] + 1, end - x["at"]), "\n"))
        return F.struct(x["level"].alias("level"), X.slugify(x["title"]).alias("anchor"), x["path"].alias("heading_path"), content.alias("content"))

    out = base.select("key", *keep, F.posexplode(F.transform("found", cut)).alias("place", "s"))
    return out.select("key", *keep, (F.col("place") + 1).cast("long").alias("section"), "s.*")


def section_children(rows: DataFrame) -> DataFrame:
    """Child artifacts of sections: parent_cache_key, key; of equal anchors the last one stays."""
    keyed = rows.withColumn("child_key", U.child_key(F.col("parent_cache_key"), F.col("anchor")))
    last = keyed.groupBy("parent_cache_key", "child_key").agg(F.max_by(F.struct("anchor", "heading_path", "content"), "section").alias("s"))
    return last.select("parent_cache_key", "child_key", "s.*")


def archive_children(old: DataFrame, new: DataFrame) -> DataFrame:
    """Prior active children that the new set lacks become archived; the rest keep their state."""
    gone = old.join(new.select("child_key"), "child_key", "left_anti").withColumn("status", F.lit("archived"))
    return gone.unionByName(old.join(new.select("child_key"), "child_key", "left_semi"))


def keywords(docs: DataFrame, key: str = "doc_id", text: str = "markdown", k: int = 5) -> DataFrame:
    """The k most frequent terms of each text; terms of a heading count three more. Ties go by alphabet."""
    base = docs.select(F.col(key).alias("key"), X.clean_noise(F.col(text)).alias("clean"))
    # A heading's term stands with a sign behind it, so it sorts right after its equals in the text.
    marked = F.transform(F.flatten(F.transform(X.heading_lines(F.col("clean")), X.tokenize)), lambda h: F.concat(h, F.lit("\0")))
    base = base.select("key", F.array_sort(F.concat(X.content_tokens(X.tokenize(F.col("clean"))), marked)).alias("terms"))
    # A sorted list counts each term by where it begins and where the next one does; nothing leaves the row.
    starts = F.filter(F.transform("terms", lambda t, i: F.when((i == 0) | (t != F.get("terms", i - 1)), i)), lambda i: i.isNotNull())
    base = base.select("key", "terms", starts.alias("starts"))

    def count(at: Column, j: Column) -> Column:
        term, next_ = F.get("terms", at), F.get("starts", j + 1)
        n = F.coalesce(next_, F.size("terms")) - at
        return F.struct((n + F.when(F.get("terms", next_) == F.concat(term, F.lit("\0")), 3).otherwise(0)).alias("score"), term.alias("term"))

    base = base.select("key", F.filter(F.transform("starts", count), lambda x: ~x["term"].endswith("\0")).alias("scored"))
    # Only terms of a score that may reach the first k are put in the order of the collation. The least such score is
    # bound before the filter: an expression inside of its lambda would be evaluated for every term.
    floor = F.coalesce(F.get(F.reverse(F.array_sort(F.transform("scored", lambda x: x["score"]))), F.lit(k - 1)), F.lit(0))
    base = base.select("key", F.get(F.transform(F.array(floor), lambda f: F.filter("scored", lambda x: x["score"] >= f)), F.lit(0)).alias("scored"))
    ranked = F.array_sort(F.transform("scored", lambda x: F.struct((-x["score"]).alias("rank"), F.collate(x["term"], "UNICODE").alias("collated"), x["term"].alias("term"))))
    out = base.select("key", F.posexplode(F.slice(ranked, 1, k)).alias("pos", "x"))
    return out.select("key", (F.col("pos") + 1).alias("place"), "x.term", (-F.col("x.rank")).cast("long").alias("score"))


def closest(inputs: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each input the nearest candidate within its edit limit, the first of equally near ones.

    candidates is a small vocabulary of commands, keys or names: its size is checked before it is broadcast.
    """
    if candidates.count() > 10_000:
        raise ValueError("closest() compares with a vocabulary of 10,000 entries at most")
    pairs = inputs.crossJoin(F.broadcast(candidates)).withColumn("distance", F.levenshtein("input", "candidate"))
    w = Window.partitionBy("input").orderBy("distance", "ord")
    near = pairs.where(F.col("distance") <= X.fuzzy_limit(F.col("input"))).withColumn("_place", F.row_number().over(w))
    return near.where("_place = 1").select("input", "candidate", "distance")


def serialize(rows: DataFrame, fields: list[str], bodies: tuple[str, ...] = ("summary", "compressed", "detailed", "provenance")) -> Column:
    """Artifact text: frontmatter of `fields` in order, then a section for each body. Arrays are lists of items."""
    kinds = dict(rows.dtypes)
    lines = []
    for f in fields:
        if kinds[f].startswith("array"):
            items = F.array_join(F.transform(f, lambda x: F.concat(F.lit("\n  - "), x)), "")
            lines.append(F.concat(F.lit(f"{f}:"), F.coalesce(items, F.lit(""))))
        else:
            lines.append(F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit(""))))
    head = F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---"))
    parts = [p for b in bodies for p in (F.lit(f"## {b.capitalize()}"), U.trim_all(F.coalesce(F.col(b), F.lit(""))))]
    return F.concat_ws("\n\n", head, *parts)


def parse_section(text: Column, name: str, following: str | None) -> Column:
    """A body: from its heading to the next known one."""
    rest = F.regexp_extract(text, rf"(?s)\n\n## {name}\n\n(.*)$", 1)
    return rest if following is None else F.regexp_extract(F.concat(rest, F.lit(f"\n\n## {following}")), rf"(?s)^(.*?)\n\n## {following}", 1)


def parse_scalar(text: Column, name: str) -> Column:
    head = F.substring_index(text, "\n---", 1)
    return F.nullif(F.regexp_extract(head, rf"(?m)^{name}: ?(.*)$", 1), F.lit(""))


def parse_items(text: Column, name: str) -> Column:
    head = F.substring_index(text, "\n---", 1)
    block = F.regexp_extract(head, rf"(?m)^{name}:((?:\n  - .*)*)", 1)
    return F.filter(F.split(block, "\n  - "), lambda x: x != "")
