"""The main article of an HTML page as Markdown, with its title, confidence and notes."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import article as A
from inkwell.functions import dom as D
from inkwell.functions.safety import redact

# The notes of an extraction.
FOUND, SHORT = "readability extracted main article", "warning: extracted content is very short (less than 500 characters)"


_MARKS = {"b": "**", "strong": "**", "i": "_", "em": "_"}


class _Writer:
    """Writes Markdown of elements, without those whose ids are in `gone`."""

    def __init__(self, base: str, gone: set[int]):
        self.base, self.gone = base, gone
        self.pre = 0
        self.out: list[str] = []
        self.lists: list[list] = []
        self.spans: list[int] = []

    def write(self, root: D.Node) -> None:
        """Depth first, without recursion: pages may be nested deeply."""
        stack: list[tuple[D.Node | str, bool]] = [(root, True)]
        while stack:
            node, opens = stack.pop()
            if isinstance(node, str):
                self.out.append(node if self.pre else re.sub(r"\s+", " ", node))
            elif not opens:
                self._close(node)
            elif id(node) in self.gone:
                pass
            elif node.tag == "table":
                self.out.append(f"\n\n{self._table(node)}\n\n")
            else:
                self._open(node)
                stack.append((node, False))
                stack += [(c, True) for c in reversed(node.children)]

    def _open(self, node: D.Node) -> None:
        tag = node.tag
        if tag in ("br", "hr"):
            self.out.append("\n" if tag == "br" else "\n\n---\n\n")
        elif tag == "img":
            self.out.append(f"![{node.get('alt')}]({urljoin(self.base, node.get('src'))})")
        elif re.fullmatch("h[1-6]", tag):
            # The first level is the title's own.
            self.out.append("\n\n" + "#" * max(2, int(tag[1])) + " ")
        elif tag in ("ul", "ol"):
            self.out.append("\n" if self.lists else "\n\n")
            self.lists.append([tag, 0])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + ("- " if kind[0] == "ul" else f"{kind[1]}. "))
        elif tag == "pre":
            self.pre += 1
            named = next((m for n in (*node.nodes(), node) if (m := re.search(r"lang(?:uage)?-([\w+#-]+)", n.get("class")))), None)
            self.out.append(f"\n\n```{named[1] if named else ''}\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in _MARKS or tag == "a":
            self.spans.append(len(self.out))
        elif tag in D.BLOCK:
            self.out.append("\n\n")

    def _table(self, table: D.Node) -> str:
        """Its own rows, not those of tables within its cells; a cell is its text, blanks run together and bars escaped."""
        live = lambda node: [c for c in node.children if isinstance(c, D.Node) and id(c) not in self.gone]
        rows = [r for c in live(table) for r in (live(c) if c.tag in ("thead", "tbody", "tfoot") else [c]) if r.tag == "tr"]
        cells = [[re.sub(r"\s+", " ", self._text(c)).strip().replace("|", "\\|") for c in live(r)] for r in rows]
        cells = [r for r in cells if r]
        width = max(map(len, cells), default=0)
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in cells]
        return "\n".join(lines[:1] + ["| " + " | ".join(["---"] * width) + " |"] * bool(lines) + lines[1:])

    def _text(self, node: D.Node) -> str:
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif id(x) not in self.gone:
                stack += reversed(x.children)
        return "".join(out)

    def _since(self, at: int) -> str:
        text = "".join(self.out[at:])
        del self.out[at:]
        return text

    def _close(self, node: D.Node) -> None:
        tag = node.tag
        if tag in _MARKS:
            # The marks stand at the words, blanks outside of them.
            text = self._since(self.spans.pop())
            inner = text.strip()
            self.out.append(text.replace(inner, f"{_MARKS[tag]}{inner}{_MARKS[tag]}", 1) if inner else text)
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag in ("ul", "ol"):
            self.lists.pop()
            self.out.append("\n" if self.lists else "\n\n")
        elif tag == "a":
            text, href = self._since(self.spans.pop()).strip(), node.get("href")
            linked = text and href and not href.strip().lower().startswith("javascript:")
            self.out.append(f"[{text}]({_resolved(self.base, href)})" if linked else text)
        elif tag in D.BLOCK or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def markdown(self) -> str:
        text = drop_empty_links("".join(self.out))
        parts = re.split(r"(\n```[^\n]*\n.*?\n```\n)", text, flags=re.S)
        parts = [p if i % 2 else re.sub(r" *\n *(?=\S)", "\n", re.sub(r"[ \t]+\n", "\n", p)) for i, p in enumerate(parts)]
        return re.sub(r"\n{3,}", "\n\n", "".join(parts)).strip()


def drop_empty_links(markdown: str) -> str:
    return re.sub(r"(?<!!)\[\s*\]\([^)]*\)", "", markdown)


def to_markdown(html: str, base: str = "") -> str:
    """A part of a page as Markdown, all of it."""
    root = D.parse(html)
    D.clean(root)
    writer = _Writer(base, set())
    writer.write(root)
    return writer.markdown()


def _resolved(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:  # as it stands where it can't be resolved
        return href


def _repeats(title: str, head: str) -> bool:
    """Whether a heading says what the title says: at most a quarter of its letters are other words."""
    words = [w for w in re.split(r"\W+", head.lower()) if w]
    known = set(re.split(r"\W+", title.lower()))
    other = " ".join(w for w in words if w not in known)
    return bool(words) and 1 - len(other) / len(" ".join(words)) > 0.75


def extract(html: str | None, url: str | None) -> tuple[str, str | None, str | None, list[str]]:
    """Title, Markdown, confidence and notes. A page without text has a title only: its extraction has failed."""
    root = D.parse(html or "")
    # The title is looked for first: cleaning may drop it.
    title = A.title_of(root)
    D.clean(root)
    D.normalize_code(root)
    found = A.find_article(root)
    if found is None:
        return title or "Untitled", None, None, []
    for part in found.parts:
        for node in [part, *found.below(part)]:
            if node.tag in ("h1", "h2") and (found.weight(node) < 0 or _repeats(title, found.text(node))):
                found.gone.add(id(node))
    length = found.length()
    writer = _Writer(url or "", found.gone)
    for part in found.parts:
        writer.write(part)
        writer.out.append("\n\n")
    confidence = "low" if length < 500 else "medium" if length < 2000 else "high"
    return title or "Untitled", redact(writer.markdown()) or "", confidence, [FOUND, *([SHORT] if length < 500 else [])]


def extract_column(html: Column, url: Column) -> Column:
    """A struct for each page; markdown and confidence are null where nothing can be extracted."""

    @F.pandas_udf("title string, markdown string, confidence string, notes array<string>")
    def run(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(h, u) for h, u in zip(pages, urls)], columns=["title", "markdown", "confidence", "notes"])

    return run(html, url)
