"""Artifact files as text: front matter of 33 fields and four bodies, written and parsed by column functions.

A field is a line `name: value`; lists follow their name as lines of two blanks, a dash and a blank, token counts as
indented `name: number` lines. Parsing lays what is found over the defaults; of a repeated name the last one counts.
Indented lines belong to the last name line before them, blank lines and lines without a colon to none. A list's name
with a value on its line is that one item. Numbers that aren't any are null. Names that aren't fields come as a map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.urls import trim_all

# The fields in the order of a file, their defaults, and the bodies.
ORDER = (
    "schema_version artifact_type source_url source_urls normalized_url cache_key topic tags format_available tier ttl fetched_at validated_at "
    "stale_after capture_method extraction_status extraction_confidence quality_notes supplied_at supplied_by etag last_modified content_hash "
    "token_estimate status site_module_id docs_engine docs_framework source_doc_url search_provider parent_cache_key section_anchor section_heading_path"
).split()
LISTS = ("source_urls", "tags", "format_available", "quality_notes")
DEFAULTS = {"schema_version": "1", "artifact_type": "source", "source_url": "", "normalized_url": "", "cache_key": "", "tier": "standard", "content_hash": "", "status": "active"}
COUNTS = ("compressed", "detailed")
BODIES = ("Summary", "Compressed", "Detailed", "Provenance")
NO_START, NO_END = "Malformed artifact: Frontmatter missing starting boundary.", "Malformed artifact: Frontmatter missing ending boundary."


def _number(value: Column) -> Column:
    """As text: whole numbers without a point."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def write(rows: DataFrame) -> Column:
    """The text of each row's artifact; missing columns and nulls are empty. Columns: ORDER, and the bodies in lower case.

    token_estimate is a struct of COUNTS; lists are arrays of strings, the rest is cast to strings.
    """
    have, empty = set(rows.columns), F.lit("")
    lines = []
    for name in ORDER:
        if name in LISTS:
            items = F.array_join(F.transform(name, lambda x: F.concat(F.lit("\n  - "), x)), "") if name in have else empty
            lines.append(F.concat(F.lit(f"{name}:"), F.coalesce(items, empty)))
        elif name == "token_estimate":
            counts = [F.concat(F.lit(f"  {c}: "), F.coalesce(_number(F.col(f"{name}.{c}").cast("double")) if name in have else empty, empty)) for c in COUNTS]
            lines.append(F.concat_ws("\n", F.lit(f"{name}:"), *counts))
        else:
            value = _number(F.col(name).cast("double")) if name in have and name == "schema_version" else F.col(name).cast("string") if name in have else empty
            lines.append(F.concat(F.lit(f"{name}: "), F.coalesce(value, empty)))
    bodies = [p for b in BODIES for p in (F.lit(f"## {b}"), trim_all(F.coalesce(F.col(b.lower()), empty)) if b.lower() in have else empty)]
    return F.concat_ws("\n\n", F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---")), *bodies)


def _value(line: Column) -> Column:
    """What follows the first colon of a line."""
    return trim_all(F.substr(line, F.instr(line, ":") + 1))


def _last(items: Column | str, named, name: str) -> Column:
    """The last item of a name, or null."""
    return F.get(F.reverse(F.filter(items, lambda x: named(x) == name)), F.lit(0))


def parse(rows: DataFrame, text: str = "value", *, shallow: bool = False) -> DataFrame:
    """rows without `text`, with error, all fields, unknown and the bodies (of shallow reads the first two).

    error is null or says what is malformed; then the fields are null. Null texts are malformed. A shallow read cuts
    what follows the second body off before anything else is looked at.
    """
    kept = [c for c in rows.columns if c != text]
    whole = F.coalesce(F.col(text), F.lit(""))
    ends = F.instr(F.substr(whole, F.lit(4)), "\n---\n")
    # The last line may be the closing one.
    closed = F.when(ends > 0, ends).when(whole.endswith("\n---") & (F.length(whole) > 4), F.length(whole) - 6)
    error = F.when(~(whole.startswith("---\n") | (whole == "---")), NO_START).when(closed.isNull(), NO_END)
    out = rows.select(*kept, whole.alias("_w"), error.alias("error"), closed.alias("_end"))
    out = out.select(*kept, "error", F.when(F.col("error").isNull(), F.substr("_w", F.lit(5), F.col("_end") - 2)).alias("_head"), F.when(F.col("error").isNull(), F.substr("_w", F.col("_end") + 7)).alias("_body"))
    lines = F.filter(F.transform(F.split("_head", "\n"), lambda x: F.regexp_replace(x, r"[\s ﻿]+$", "")), lambda x: (x != "") & (x.startswith("  ") | x.contains(":")))
    # A name line opens a block that its indented lines follow.
    blocks = F.filter(F.split(F.array_join(lines, "\n"), "\n(?!  )"), lambda b: (b != "") & ~b.startswith("  "))
    out = out.select(*kept, "error", "_body", F.transform(blocks, lambda b: F.split(b, "\n")).alias("_blocks"))
    made = F.transform(
        "_blocks",
        lambda b: F.struct(
            trim_all(F.substring_index(b[0], ":", 1)).alias("name"), _value(b[0]).alias("value"),
            F.transform(F.filter(b, lambda x: x.startswith("  - ")), lambda x: trim_all(F.substr(x, F.lit(5)))).alias("items"),
            F.filter(b, lambda x: x.startswith("  ") & ~x.startswith("  - ") & x.contains(":")).alias("inner"),
        ),
    )
    out = out.select(*kept, "error", "_body", made.alias("_blocks"))
    fields = []
    for name in ORDER:
        block = _last("_blocks", lambda b: b["name"], name)
        if name in LISTS:
            value = F.when(block.isNull(), F.array().cast("array<string>")).when(block["value"] != "", F.array(block["value"])).otherwise(block["items"])
        elif name == "token_estimate":
            lines = [_last(block["inner"], lambda x: trim_all(F.substring_index(x, ":", 1)), c) for c in COUNTS]
            value = F.struct(*[F.when(block["value"] == "", _value(x).try_cast("double")).alias(c) for x, c in zip(lines, COUNTS)])
        else:
            value = F.when(block.isNull(), F.lit(DEFAULTS.get(name)).cast("string")).otherwise(F.nullif(block["value"], F.lit("")))
            value = value.try_cast("double") if name == "schema_version" else value
        fields.append(F.when(F.col("error").isNull(), value).alias(name))
    known = F.array(*map(F.lit, ORDER))
    last = F.filter("_blocks", lambda b, i: ~F.array_contains(known, b["name"]) & ~F.exists(F.slice(F.col("_blocks"), i + 2, F.size("_blocks")), lambda later: later["name"] == b["name"]))
    unknown = F.map_from_entries(F.transform(last, lambda b: F.struct(b["name"], F.nullif(b["value"], F.lit("")))))
    body = F.substring_index("_body", "\n\n## Detailed", 1) if shallow else F.col("_body")
    bodies = [_section(body, b, (*BODIES, None)[i + 1]).alias(b.lower()) for i, b in enumerate(BODIES[:2] if shallow else BODIES)]
    return out.select(*kept, "error", *fields, unknown.alias("unknown"), *bodies)


def _section(body: Column, name: str, following: str | None) -> Column:
    """From the first heading of the name to the next body's heading; headings within a body don't end it."""
    at = F.instr(body, f"## {name}")
    rest = F.substr(body, at + len(name) + 3)
    return F.when(at > 0, trim_all(rest if following is None else F.substring_index(rest, f"\n\n## {following}", 1))).when(body.isNotNull(), "")
