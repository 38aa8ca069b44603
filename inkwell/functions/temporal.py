"""Durations, freshness tiers and revalidation outcomes as Spark expressions. Times are epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000
#: Fresh and grace windows of each tier, in days.
TIERS = {"stable": (180, 60), "standard": (30, 14), "volatile": (7, 5)}
#: Milliseconds of each unit of a duration; m is a month of 30 days.
UNITS = {"h": DAY // 24, "d": DAY, "w": 7 * DAY, "m": 30 * DAY, "y": 365 * DAY}
_DURATION = r"^(\d+)([hdwmy])$"


def to_ms(timestamp: Column) -> Column:
    return F.unix_millis(timestamp)


def duration_ms(text: Column) -> Column:
    """Milliseconds of a duration such as 7d, null if it isn't one."""
    unit = F.regexp_extract(text, _DURATION, 2)
    factor = F.lit(None).cast("long")
    for name, ms in UNITS.items():
        factor = F.when(unit == name, F.lit(ms).cast("long")).otherwise(factor)
    return F.when(text.rlike(_DURATION), F.regexp_extract(text, _DURATION, 1).cast("long") * factor)


def duration_error(flag: str, text: Column) -> Column:
    message = F.concat(F.lit(f'Invalid {flag}: Duration "'), text, F.lit('" is not a valid format.'))
    return F.when((text != "") & ~text.rlike(_DURATION), message)


def literal_ms(text: str) -> int:
    """The same for a Python string; raises ValueError."""
    if not text[:-1].isdigit() or text[-1:] not in UNITS:
        raise ValueError(f'Duration "{text}" is not a valid format.')
    return int(text[:-1]) * UNITS[text[-1]]


def _by_tier(tier: Column, place: int) -> Column:
    out = F.lit(TIERS["standard"][place])
    for name, days in TIERS.items():
        out = F.when(tier == name, F.lit(days[place])).otherwise(out)
    return out.cast("long") * DAY


def windows(tier: Column, ttl: Column) -> tuple[Column, Column]:
    """Fresh and grace milliseconds; a TTL scales the grace of its tier."""
    own = duration_ms(F.nullif(ttl, F.lit("")))
    fresh, grace = _by_tier(tier, 0), _by_tier(tier, 1)
    scaled = F.floor(own * (grace.cast("double") / fresh.cast("double"))).cast("long")
    return F.coalesce(own, fresh), F.coalesce(scaled, grace)


def base_ms(fetched: Column, validated: Column) -> Column:
    zero = F.lit(0).cast("long")
    return F.greatest(F.coalesce(to_ms(fetched), zero), F.coalesce(to_ms(validated), zero))


def freshness(age: Column, fresh: Column, grace: Column) -> Column:
    return F.when(age <= fresh, "fresh").when(age <= fresh + grace, "stale_grace").otherwise("stale_expired")


def max_age_expired(age: Column, max_age: str | None) -> Column:
    return age > literal_ms(max_age) if max_age else F.lit(False)


def revalidation(state: Column, status: Column) -> Column:
    """Outcome of a probe: state is the freshness, status the HTTP status or null for an error."""
    return (
        F.when(state == "fresh", "revalidated")
        .when(status == 304, "revalidated")
        .when(status == 200, "refreshed")
        .when(state == "stale_grace", "stale")
        .otherwise("error")
    )


def timing_delta(current: Column, baseline: Column) -> Column:
    """Slowdown in percent to two decimals, null without a baseline."""
    return F.when(baseline > 0, F.round((current - baseline) / baseline * 100, 2))
