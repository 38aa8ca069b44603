"""Rules for responses, as Spark expressions: acceptance, failure guidance, and the settings' precedence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.functions.urls import trim_all

BODY_LIMIT = 2 * 1024 * 1024


def rejection(status: Column, content_type: Column, size: Column, body: Column, *, html: bool = True, limit: int = BODY_LIMIT) -> Column:
    """Why a response is refused, or null; 304 passes without a body. html: only pages are wanted, else any text.

    A null status is a failed request. The messages are fixed values: failure_class() reads them.
    """
    kind = F.lower(trim_all(F.substring_index(content_type, ";", 1)))
    out = F.when(status.isNull(), "Fetch failed").when(status == 304, F.lit(None).cast("string"))
    out = out.when((status < 200) | (status >= 300), F.concat(F.lit("Fetch failed with status "), status.cast("string")))
    if html:
        named = F.coalesce(F.length(content_type) > 0, F.lit(False))
        out = out.when(named & ~kind.isin("text/html", "application/xhtml+xml"), F.concat(F.lit('Rejected content type "'), content_type, F.lit('". Only HTML is supported.')))
        unnamed = ~named & ~F.coalesce(X.looks_like_html(body), F.lit(False))
        out = out.when(size > limit, "Response body exceeds the limit").when(unnamed, "Rejected response: missing Content-Type and body does not look like HTML.")
        return out
    return out.when(size > limit, "Response body exceeds the limit")


#: Classes of failures by message, asked in order: name, pattern, and whether importing a saved page helps.
FAILURES = (
    ("access", r"failed with status 40[13](?![A-Za-z0-9_])", True),
    ("missing", r"failed with status 404(?![A-Za-z0-9_])", False),
    ("server", r"failed with status 5[0-9][0-9](?![A-Za-z0-9_])", False),
    ("not_html", r"Rejected content type|does not look like HTML", True),
    ("dns", r"DNS resolution failed", False),
    ("private_target", r"blocked local or private target", False),
)


def failure_class(message: Column) -> Column:
    """The first class whose pattern the message holds, or null."""
    out = F.lit(None).cast("string")
    for name, pattern, _ in reversed(FAILURES):
        out = F.when(message.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def import_helps(message: Column) -> Column:
    """Whether a page saved by hand and imported gets round the failure."""
    return F.coalesce(failure_class(message).isin([name for name, _, helps in FAILURES if helps]), F.lit(False))


def setting(flag: Column, env: Column, project: Column, user: Column, default: str, values: tuple[str, ...]) -> Column:
    """The effective value: flag, environment, project file, user file, default. Values are told by case; others count as
    not set."""

    def known(c: Column) -> Column:
        return F.when(c.isin(*values), c)

    return F.coalesce(flag, known(trim_all(env)), known(project), known(user), F.lit(default))


def override_ignored(env: Column, values: tuple[str, ...]) -> Column:
    """Whether an environment value is set but unknown, which calls for a warning."""
    return F.coalesce((F.length(trim_all(env)) > 0) & ~trim_all(env).isin(*values), F.lit(False))


def suggested_key(name: Column, keys: tuple[str, ...]) -> Column:
    """The first key that holds the name, or that the name holds; null without one."""
    low = F.lower(name)
    return F.coalesce(*[F.when(F.lit(k).contains(low) | low.contains(k), F.lit(k)) for k in keys])


def listing_heading(total: Column, shown: Column, noun: str, order: str) -> Column:
    """Heading of a result list, which says so where it was cut. The words are fixed values."""
    head = F.concat(F.lit("Found "), total.cast("string"), F.lit(f" {noun} "), F.when(total == 1, "entry").otherwise("entries"))
    cut = F.concat(F.lit(f" (showing {order} "), shown.cast("string"), F.lit("; raise --limit to see more):"))
    return F.concat(head, F.when(total > shown, cut).otherwise(":"))
