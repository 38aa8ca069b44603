"""Rules of the documentation sites that have some of their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import content_metrics
from inkwell.functions.urls import host, part, trim_all

#: Site of each host.
SITES = {"help.salesforce.com": "salesforce", "developer.salesforce.com": "salesforce-developer", "tanstack.com": "tanstack"}
_HELP = "help.salesforce.com"


def site_of(url: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, site in SITES.items():
        out = F.when(host(url) == name, F.lit(site)).otherwise(out)
    return out


def is_allowed_host(name: Column) -> Column:
    return F.lower(name).isin([h for h, s in SITES.items() if s.startswith("salesforce")])


def help_article_url(url: Column) -> Column:
    """Internal addresses of articles as the public ones; others unchanged."""

    def parameter(name: str) -> Column:
        return F.regexp_extract(part(url, 4), rf"[?&]{name}=([^&]*)", 1)

    i = parameter("id")
    out = F.concat(F.lit(f"https://{_HELP}/s/articleView?id="), i, F.when(i.endswith(".htm"), "").otherwise(".htm"), F.lit("&type=5"))
    for key in ("release", "language"):
        out = F.concat(out, F.when(parameter(key) != "", F.concat(F.lit(f"&{key}="), parameter(key))).otherwise(""))
    inner = (host(url) == _HELP) & F.lower(part(url, 3)).startswith("/help_doccontent") & (i != "")
    return F.when(inner, out).otherwise(url)


def is_error_text(text: Column) -> Column:
    return text.rlike(r"(?i)page\s*(not\s*found|doesn'?t\s*exist|can'?t\s*be\s*found)|we\s*couldn'?t\s*find|we looked high and low|sorry to interrupt")


def strip_boilerplate(text: Column) -> Column:
    lines = F.filter(
        F.split(text, "\n"),
        lambda x: ~x.rlike(r"(?i)did this article solve your issue|let us know so we can improve|share your feedback") & ~trim_all(x).rlike(r"^\[\]\([^)]*\)$"),
    )
    return trim_all(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def api_payload(raw: Column) -> Column:
    """Struct of content and title (or id), null without content."""
    p = F.from_json(raw, "content string, title string, id string")
    title = F.coalesce(F.nullif(p["title"], F.lit("")), p["id"], F.lit(""))
    return F.when(F.coalesce(p["content"], F.lit("")) != "", F.struct(p["content"].alias("content"), title.alias("title")))


def prefer_richer(a: Column, b: Column) -> Column:
    """The text with more structure; a where they are alike."""
    keys = ("tables", "code_blocks", "headings", "images", "ordered_steps", "chars")
    ra, rb = (F.struct(*[content_metrics(x)[k].alias(k) for k in keys]) for x in (a, b))
    return F.when(b.isNotNull() & (a.isNull() | (rb > ra)), b).otherwise(a)
