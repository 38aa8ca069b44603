"""License scans: ordered signature rules with a keyword prefilter, priorities and interval containment.

A text is lower-cased (A-Z only) and reduced to its words, joined by single spaces; rules are regexes over that line.
Families of licenses are written by hand as name patterns; a few sentence forms around each name give the rules. A
text without any of the gate words gets no further than a search for them. In a gated text each rule first looks for
its keyword, then for its pattern. A detection whose interval of words lies inside another one of the same or a
higher priority is suppressed; of equal intervals the higher priority stays.

Everything is a Spark expression in the row: no user functions, no join, no shuffle.

Rows: a null text is empty. An empty text has no words and no labels. Repeated rows are scanned alike, each for itself.
An empty table gives no rows. Other columns are kept by scan() (in a struct, so no name clashes) and ignored by the query.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import common

#: Fixed by contract: phrases whose places are counted, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Label, keyword, name pattern (over words), SPDX identifier as words.
FAMILIES = (
    ("mit", "mit|expat", "(?:mit|expat)(?: x11)?", "mit"),
    ("mit-0", "mit", "mit (?:0|no attribution)", "mit 0"),
    ("apache-2.0", "apache", "apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?", "apache 2 0"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version)? 1 1", "apache 1 1"),
    ("apache", "apache", "apache(?: software)?", "apache"),
    ("gpl-1.0", "general public|gpl", "(?:gnu )?(?:general public|gpl)(?: license)?(?: version| v)? ?1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "general public|gpl", "(?:gnu )?(?:general public|gpl)(?: license)?(?: version| v)? ?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "general public|gpl", "(?:gnu )?(?:general public|gpl)(?: license)?(?: version| v)? ?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl", "general public|gpl", "(?:gnu )?(?:general public|gpl)", "gpl"),
    ("lgpl-2.1", "lesser|lgpl", "(?:gnu )?(?:lesser general public|lgpl)(?: license)?(?: version| v)? ?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser|lgpl", "(?:gnu )?(?:lesser general public|lgpl)(?: license)?(?: version| v)? ?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl", "lesser|library general|lgpl", "(?:gnu )?(?:(?:lesser|library) general public|lgpl)", "lgpl"),
    ("agpl-3.0", "affero|agpl", "(?:gnu )?(?:affero general public|agpl)(?: license)?(?: version| v)? ?3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("agpl", "affero|agpl", "(?:gnu )?(?:affero general public|agpl)", "agpl"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation", "gfdl 1 [123]"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:original bsd|old bsd|bsd 4 clause|4 clause bsd|four clause bsd)", "bsd 4 clause"),
    ("0bsd", "bsd", "(?:zero clause bsd|bsd zero clause|0bsd)", "0bsd"),
    ("bsd", "bsd|berkeley software", "(?:berkeley software distribution|bsd)", "bsd"),
    ("isc", "isc|internet systems consortium", "(?:isc|internet systems consortium)", "isc"),
    ("mpl-1.1", "mozilla|mpl", "(?:mozilla public|mpl)(?: license)?(?: version| v)? ?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla|mpl", "(?:mozilla public|mpl)(?: license)?(?: version| v)? ?2 0", "mpl 2 0"),
    ("mpl", "mozilla|mpl", "(?:mozilla public|mpl)", "mpl"),
    ("epl-1.0", "eclipse|epl", "(?:eclipse public|epl)(?: license)?(?: version| v)? ?1 0", "epl 1 0"),
    ("epl-2.0", "eclipse|epl", "(?:eclipse public|epl)(?: license)?(?: version| v)? ?2 0", "epl 2 0"),
    ("edl-1.0", "eclipse", "eclipse distribution", "edl 1 0"),
    ("cddl-1.0", "common development|cddl", "(?:common development and distribution|cddl)", "cddl 1 [01]"),
    ("cpl-1.0", "common public", "common public", "cpl 1 0"),
    ("cc0-1.0", "cc0|creative commons", "(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-sa", "creative commons|cc by", "(?:creative commons attribution share ?alike|cc by sa)(?: [1234] 0)?(?: international| unported)?", "cc by sa [1234] 0"),
    ("cc-by-nc", "creative commons|cc by", "(?:creative commons attribution non ?commercial|cc by nc)(?: [1234] 0)?(?: international| unported)?", "cc by nc [1234] 0"),
    ("cc-by-nd", "creative commons|cc by", "(?:creative commons attribution no ?derivatives|cc by nd)(?: [1234] 0)?(?: international| unported)?", "cc by nd [1234] 0"),
    ("cc-by", "creative commons|cc by", "(?:creative commons attribution|cc by)(?: [1234] 0)?(?: international| unported)?", "cc by [1234] 0"),
    ("creative-commons", "creative commons", "creative commons", "cc"),
    ("boost-1.0", "boost", "boost software", "bsl 1 0"),
    ("busl-1.1", "business source", "business source", "busl 1 1"),
    ("sspl-1.0", "server side public|sspl", "(?:server side public|sspl)", "sspl 1 0"),
    ("elastic-2.0", "elastic", "elastic(?: license)? 2(?: 0)?", "elastic 2 0"),
    ("artistic-1.0", "artistic", "artistic(?: license)? 1(?: 0)?", "artistic 1 0"),
    ("artistic-2.0", "artistic", "artistic(?: license)? 2(?: 0)?", "artistic 2 0"),
    ("artistic", "artistic", "artistic", "artistic"),
    ("zlib", "zlib", "(?:zlib libpng|zlib)", "zlib"),
    ("libpng", "libpng", "libpng", "libpng"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("python-2.0", "python", "python software foundation", "(?:psf|python) 2 0"),
    ("ruby", "ruby", "ruby", "ruby"),
    ("php-3.01", "php", "php", "php 3 01?"),
    ("w3c", "w3c", "w3c(?: software)?", "w3c"),
    ("wtfpl", "wtfpl|do what the", "(?:wtfpl|do what the f u c k you want to public)", "wtfpl"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("ofl-1.1", "open font|ofl", "(?:sil )?(?:open font|ofl)", "ofl 1 1"),
    ("eupl-1.2", "european union public|eupl", "(?:european union public|eupl)", "eupl 1 [12]"),
    ("ms-pl", "microsoft public|ms pl", "(?:microsoft public|ms pl)", "ms pl"),
    ("odbl-1.0", "open database|odbl", "(?:open database|odbl)", "odbl 1 0"),
)

# Forms around a name: pattern, priority, relevance. {n} is the name, {s} the SPDX words.
FORMS = (
    ("spdx license identifier {s}", 4, 1.0),
    ("(?:is |are )?(?:licen[cs]ed|released|distributed|published|provided|made available|available) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{n}(?: (?:public )?licen[cs]e)?", 3, 0.95),
    ("{n} licen[cs]e(?: (?:version|v) ?[0-9]+(?: [0-9]+)?)?(?: or (?:any )?later(?: version)?)?", 2, 0.9),
    ("(?:see|read) (?:the )?{n} licen[cs]e for (?:more )?details", 3, 0.8),
)

# Sentences that are a license's own: label, keyword, pattern, priority, relevance.
CLAUSES = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 4, 1.0),
    ("mit", "shall be included in all copies", "the above copyright notice and this permission notice shall be included in all copies", 4, 0.9),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee", 4, 1.0),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 4, 1.0),
    ("bsd-3-clause", "endorse or promote", "may be used to endorse or promote products derived from this software", 4, 0.9),
    ("apache-2.0", "you may not use this file", "you may not use this file except in compliance with the license", 4, 0.95),
    ("gpl", "free software you can redistribute", "is free software you can redistribute it and or modify it", 4, 0.95),
    ("mpl-2.0", "subject to the terms of the mozilla", "this source code form is subject to the terms of the mozilla public license", 4, 1.0),
    ("unlicense", "free and unencumbered", "this is free and unencumbered software released into the public domain", 4, 1.0),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such", 4, 0.9),
    ("boost-1.0", "boost software license", "distributed under the boost software license", 4, 1.0),
    ("wtfpl", "what the fuck you want", "do what the fuck you want to public license", 4, 1.0),
    ("public-domain", "public domain", "(?:released|placed|dedicated|is|are) (?:in|into|to) the public domain", 3, 0.8),
    ("public-domain", "public domain", "public domain", 1, 0.5),
    ("proprietary", "all rights reserved", "all rights reserved", 1, 0.4),
    ("proprietary", "proprietary", "proprietary and confidential", 3, 0.9),
    ("proprietary", "unauthorized copying", "unauthorized copying of this (?:file|software|work)", 3, 0.9),
    ("warranty-disclaimer", "without warrant", "(?:provided )?(?:as is )?without warrant(?:y|ies)(?: of any kind)?", 1, 0.3),
    ("copyright-notice", "copyright", "copyright (?:c )?(?:by )?(?:19|20)[0-9]{2}", 1, 0.3),
)

#: A text without all of these has no detection: each rule's pattern holds one of them.
GATES = ("licen", "permission", "redistribut", "endorse or promote", "altered source", "public domain", "rights reserved", "proprietary", "unauthorized", "warrant", "copyright", "unencumbered", "released under", "distributed under", "published under", "provided under", "available under", "terms", "fuck")


class LicenseRule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    priority: int
    relevance: float


def rules() -> list[LicenseRule]:
    """Every rule; a keyword with alternatives gives a rule for each."""
    out = []
    for label, keywords, name, spdx in FAMILIES:
        for form, priority, relevance in FORMS:
            pattern = form.replace("{n}", name).replace("{s}", f"(?:{spdx})")
            for keyword in ["spdx"] if "{s}" in form else keywords.split("|"):
                out.append(LicenseRule(label, keyword, pattern, priority, relevance))
    out += [LicenseRule(*c) for c in CLAUSES]
    return list(dict.fromkeys(out))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input's row as struct l_in, l_n_words, l_starts (start of each base phrase, as (start, label)), l_found (detections that stay, as
    (label, start, end, priority, relevance), in words) in order of start, and l_labels of all detections that stay."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rough = F.lower(F.col("l_raw"))  # only to gate: other letters than A-Z may change here, A-Z change alike
    gate = F.lit(False)
    for word in GATES:
        gate = gate | rough.contains(word.split(" ")[0])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("l_in")
    one = docs.select(row, raw.alias("l_raw")).withColumns(
        {
            "l_n_words": F.regexp_count("l_raw", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")).cast("long"),
            "l_words": F.when(gate, F.array_remove(F.split(_lower(F.col("l_raw")), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")),
        }
    )
    two = one.withColumn("l_line", F.concat(F.lit(" "), F.array_join("l_words", " "), F.lit(" ")))

    def places(phrase: str, label: str) -> Column:
        first, *rest = phrase.split(" ")

        def here(w: Column, i: Column) -> Column:
            out = w == first
            for k, x in enumerate(rest, 1):
                out = out & F.coalesce(F.get("l_words", i + k) == x, F.lit(False))
            return F.when(out, i)

        starts = F.array_compact(F.transform("l_words", here))
        spans = F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))
        return F.when(F.col("l_line").contains(f" {phrase} "), spans)

    table = F.array(
        *[
            F.struct(
                F.lit(r.keyword).alias("keyword"),
                F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern"),
                F.lit(r.label).alias("label"),
                F.lit(r.priority).alias("priority"),
                F.lit(r.relevance).alias("relevance"),
            )
            for r in rules()
        ]
    )

    def spans(r: Column) -> Column:
        # A mark before each match tells its word's place; matches hold their own lengths.
        marked = F.split(F.regexp_replace("l_line", r["pattern"], F.lit("\u0001$0")), F.lit(" "))
        starts = F.filter(F.transform(marked, lambda w, i: F.when(w.startswith("\u0001"), i - 1)), lambda x: x.isNotNull())
        lengths = F.transform(
            F.regexp_extract_all("l_line", r["pattern"], F.lit(0)),
            lambda m: F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))) + 1,
        )
        return F.zip_with(
            starts,
            lengths,
            lambda s, n: F.struct(
                s.alias("start"), (-(s + n)).alias("rank"), (-r["priority"]).alias("order"), r["label"].alias("label"), r["relevance"].alias("relevance")
            ),
        )

    hits = F.filter(table, lambda r: F.col("l_line").contains(r["keyword"]) & F.rlike("l_line", r["pattern"]))
    three = two.withColumns(
        {
            "l_starts": F.flatten(F.array_compact(F.array(*[places(p, x) for p, x in BASE]))),
            # By start, then the longer, then the higher priority: what contains a detection comes before it.
            "l_all": F.when(F.col("l_line").isNotNull(), F.array_distinct(F.sort_array(F.flatten(F.transform(hits, spans))))),
        }
    )
    levels = sorted({r.priority for r in rules()})
    nothing = [F.lit(0).alias(f"e{p}") for p in levels]
    kind = "array<struct<label:string,start:int,end:int,priority:int,relevance:double>>"

    def step(acc: Column, d: Column) -> Column:
        end = -d["rank"]
        inside = F.lit(False)
        for p in levels:
            inside = inside | ((-d["order"] == p) & (acc[f"e{p}"] >= end))
        reach = [F.when(-d["order"] >= p, F.greatest(acc[f"e{p}"], end)).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in levels]
        span = F.struct(d["label"].alias("label"), d["start"].alias("start"), end.alias("end"), (-d["order"]).alias("priority"), d["relevance"].alias("relevance"))
        return F.struct(*reach, F.when(inside, acc["found"]).otherwise(F.array_append(acc["found"], span)).alias("found"))

    start = F.struct(*nothing, F.array().cast(kind).alias("found"))
    found = F.when(F.size("l_all") > 0, F.aggregate("l_all", start, step, lambda acc: acc["found"]))
    four = three.withColumns({"l_found": F.coalesce(found, F.array().cast(kind)), "l_starts": F.coalesce("l_starts", F.array().cast("array<struct<start:int,label:string>>"))})
    return four.drop("l_raw", "l_words", "l_line", "l_all")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every text of `documents` scanned; see the module. score: the highest relevance of a detection that stays."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    starts = F.transform("l_starts", lambda s: s["start"])
    base = F.array_distinct(F.transform("l_starts", lambda s: s["label"]))
    own = F.transform("l_found", lambda d: d["label"])
    return scan(docs).select(
        "l_in.doc_id",
        F.col("l_n_words").alias("n_words"),
        F.size("l_starts").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("l_found", lambda d: d["relevance"])), F.lit(0.0)).alias("score"),
    )
