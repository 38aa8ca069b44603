"""Extractive summaries of Markdown: whole sentences kept by rank, structure kept as it is.

Per-document algorithms without a built-in counterpart; they run as Arrow-batched pandas functions.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import stop_words

#: The share of prose that each level keeps, the window of the graph ranking and its damping.
LEVELS = {"conservative": 0.65, "balanced": 0.5, "aggressive": 0.35}
GRAPH_WINDOW, DAMPING, ITERATIONS, FLOOR_TOKENS, CAUTION_BOOST = (10, 500), 0.85, 30, 200, 1.6
#: Words whose period ends no sentence.
ABBREVIATIONS = set("e.g i.e etc vs mr mrs dr prof fig no al inc ltd co vol pp eq ref cf approx est dept st jr sr".split())

_STOPS = set(stop_words())
_HEADING = re.compile(r"\s{0,3}#{1,6}\s")
# Lines that are no prose.
_VERBATIM = re.compile(r"\s*$|\s{0,3}#{1,6}\s|\s*(?:[-*+]|[0-9]+\.)\s|\s*>|\s*([-*_])(?:\s*\1){2,}\s*$|\s*<!--|\s*</?[a-zA-Z]|\s{2,}\S")
# Sentences with these words are always kept, or preferred.
_CRITICAL = re.compile(r"\b(must not|mustn't|cannot|can't|do not|don't|should not|shouldn't|never|deprecat\w*|unsafe|security|secret|corrupt\w*|data loss|overwrit\w*|irreversible|not permitted|warning|caution|danger\w*)\b", re.I | re.A)
_CAUTION = re.compile(r"\b(must|required?|requires?|throws?|fails?|failure|invalid|important|only if|note that|otherwise)\b", re.I | re.A)
_STARTS = re.compile(r"\s+[\"'(\[]?[A-Z0-9]")


def tokens(text: str) -> list[str]:
    found = (t.strip(".-") for t in re.findall(r"[a-z0-9][a-z0-9+#.-]*", text.lower()))
    return [t for t in found if t]


def content_tokens(text: str) -> list[str]:
    plain = re.sub(r"https?://\S+", " ", re.sub(r"`[^`]*`", " ", text))
    return [t for t in tokens(plain) if len(t) >= 3 and t not in _STOPS and not re.fullmatch("[0-9]+", t)]


def split_sentences(paragraph: str) -> list[str]:
    """Sentences end at runs of .!? before white space and a capital or digit; never in code or after an abbreviation."""
    code: list[str] = []

    def mask(m: re.Match) -> str:
        code.append(m[0])
        return f"\0{len(code) - 1}\0"

    text = re.sub(r"`[^`]*`", mask, paragraph.replace("\0", ""))
    out, start = [], 0
    for m in re.finditer(r"[.!?]+", text):
        if not _STARTS.match(text, m.end()):
            continue
        word = re.split(r"\s", text[: m.start()])[-1].lower().rstrip(".")
        if m[0][0] == "." and (word in ABBREVIATIONS or len(word) == 1):
            continue
        out.append(text[start : m.end()])
        start = m.end()
    parts = [s.strip() for s in [*out, text[start:]]]
    return [re.sub("\0(\\d+)\0", lambda m: code[int(m[1])], s) for s in parts if s]


def blocks(markdown: str) -> list[tuple[bool, list[str]]]:
    """Runs of lines, (is prose, lines): code fences, comments, lists, tables and the like are not prose."""
    out: list[tuple[bool, list[str]]] = []
    fence, comment = "", False
    for line in markdown.split("\n"):
        opened = re.match(r"\s*(```+|~~~+)", line)
        if comment:
            prose, comment = False, "-->" not in line
        elif fence:
            prose = False
            if opened and line.strip().startswith(fence):
                fence = ""
        elif opened:
            prose, fence = False, opened[1]
        elif line.lstrip().startswith("<!--") and "-->" not in line:
            prose, comment = False, True
        else:
            prose = not (_VERBATIM.match(line) or "|" in line)
        if out and out[-1][0] == prose:
            out[-1][1].append(line)
        else:
            out.append((prose, [line]))
    return out


def rank_graph(sets: list[set[str]]) -> np.ndarray:
    """Centrality of sentences whose token sets overlap, normalised by the logarithms of their sizes."""
    n = len(sets)
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for s in sets for t in sorted(s)))}
    has = np.zeros((n, max(1, len(vocabulary))), np.float32)
    for i, s in enumerate(sets):
        has[i, [vocabulary[t] for t in s]] = 1
    common = has @ has.T
    logs = np.array([math.log(len(s) + 1) for s in sets])
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.where(common > 0, common / (logs[:, None] + logs[None, :]), 0.0)
    np.fill_diagonal(weight, 0.0)
    sums = np.cumsum(weight, axis=1)[:, -1]  # in index order, so that the result is the same everywhere
    share = np.divide(weight, sums, out=np.zeros_like(weight), where=sums > 0)  # column j: what j hands on
    share *= DAMPING
    score = np.full(n, 1 / n)
    for _ in range(ITERATIONS):
        score = np.cumsum(np.column_stack([np.full(n, (1 - DAMPING) / n), share * score]), axis=1)[:, -1]
    return score


class Ranked:
    """Sentences of a text with their scores, from which every level takes its share."""

    def __init__(self, markdown: str, short: int = 2):
        self.parts, self.rows = blocks(markdown), []  # rows: (block, is first, text)
        for b, (prose, lines) in enumerate(self.parts):
            if prose:
                found = split_sentences(re.sub(r"\s+", " ", " ".join(lines)).strip())
                self.rows += [(b, i == 0, s) for i, s in enumerate(found)]
        texts = [t for _, _, t in self.rows]
        bags = [content_tokens(t) for t in texts]
        if GRAPH_WINDOW[0] <= len(texts) <= GRAPH_WINDOW[1]:
            score = rank_graph([set(bag) for bag in bags]).tolist()
        else:
            score = self._by_frequency(bags)
        self.score = [s * CAUTION_BOOST if _CAUTION.search(t) else s for s, t in zip(score, texts)]
        size = Counter(b for b, _, _ in self.rows)
        self.forced = {i for i, (b, first, t) in enumerate(self.rows) if first or size[b] < short or _CRITICAL.search(t)}

    def _by_frequency(self, bags: list[list[str]]) -> list[float]:
        count = Counter(t for bag in bags for t in bag)
        headings = (x for prose, lines in self.parts if not prose for x in lines if _HEADING.match(x))
        for t in {t for x in headings for t in tokens(x)} & count.keys():
            count[t] += 3
        return [sum(count[t] for t in bag) / len(bag) if bag else 0.0 for bag in bags]

    def summary(self, level: str) -> str:
        sizes = [len(t) for _, _, t in self.rows]
        kept = set(self.forced)
        budget = sum(sizes) * LEVELS[level] - sum(sizes[i] for i in kept)
        for i in sorted(set(range(len(sizes))) - kept, key=lambda i: (-self.score[i], i)):
            if budget <= 0:
                break
            kept.add(i)
            budget -= sizes[i]
        text: dict[int, list[str]] = {}
        for i in sorted(kept):
            text.setdefault(self.rows[i][0], []).append(self.rows[i][2])
        out = "\n".join(" ".join(text.get(b, [])) if prose else "\n".join(lines) for b, (prose, lines) in enumerate(self.parts))
        return re.sub(r"\n{3,}", "\n\n", out).strip()


def _summaries(markdown: str | None, levels: Iterable[str], floor: int, short: int) -> list[str | None]:
    levels = list(levels)
    if not markdown or not markdown.strip() or math.ceil(len(markdown) / 4) < floor:
        return [markdown] * len(levels)
    ranked = Ranked(markdown, short)
    return [ranked.summary(level) if ranked.rows else markdown for level in levels]


def summarize(markdown: str | None, level: str = "conservative", floor: int = FLOOR_TOKENS, short: int = 2) -> str | None:
    return _summaries(markdown, [level], floor, short)[0]


def structural(markdown: str) -> str:
    out = re.sub(r"\[(.*?)\]\(.*?\)", r"[\1]", re.sub(r"!\[.*?\]\(.*?\)", "", markdown))
    return re.sub(r"\n{3,}", "\n\n", out).strip()


def compressed_forms(detailed: str | None, levels: Iterable[str] = tuple(LEVELS)) -> list[str]:
    """For each level the summary, or the structural form, or the text: the first that is neither larger nor emptied."""
    detailed = detailed or ""
    plain, out = structural(detailed), []
    for summary in _summaries(plain, levels, FLOOR_TOKENS, 2):
        fit = (c for c in (summary or "", plain) if len(c) <= len(detailed) and (c.strip() or not detailed.strip()))
        out.append(next(fit, detailed))
    return out


def compressed(detailed: str | None, level: str = "conservative") -> str:
    return compressed_forms(detailed, [level])[0]


def compressed_column(text: Column, level: str = "conservative") -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: compressed(t, level))

    return run(text)


def compressed_columns(text: Column) -> Column:
    """A struct of the forms of all levels, from one ranking of the text."""

    @F.pandas_udf(", ".join(f"{level} string" for level in LEVELS))
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compressed_forms(t) for t in texts], columns=list(LEVELS))

    return run(text)


def sentences_column(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_sentences(t) if t else [])

    return run(text)
