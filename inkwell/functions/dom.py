"""A small tree of an HTML page, and what is done to it before its article is looked for."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table tr ul".split())
#: What an opening tag closes before it.
CLOSES = {"li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}} | {b: {"p"} for b in BLOCK - {"tr"}}
#: A closing rule looks no further than the next of these.
_HOLDS = {"ul", "ol", "table", "div", "section", "article", "main", "td", "th", "dl", "blockquote", "body"}
UNSAFE = {"script", "style", "iframe", "noscript", "template", "svg"}
# Parts of class names, and of aria labels, of decoration around a page's text.
CHROME_CLASS = ("contributor", "avatar", "sponsor", "customizer", "theme-toggle", "edit-link")
CHROME_LABEL = "theme"
# Names that count as a language without a prefix.
LANGUAGES = (
    "bash shell sh zsh console ts tsx typescript js jsx javascript json jsonc html xml css scss less python py go golang rust rs java kotlin "
    "ruby rb php sql yaml yml toml diff graphql vue svelte astro md mdx dockerfile c cpp csharp cs"
)
_LANGUAGE = re.compile(rf"\b(?:{'|'.join(LANGUAGES.split())})\b", re.I)


class Node:
    """An element; children are elements and strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def nodes(self) -> Iterator[Node]:
        """The elements below this one, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += reversed(node.children)
        return "".join(out)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        shuts = CLOSES.get(tag, ())
        node = self.at
        while shuts and node.parent is not None and (node.tag in shuts or node.tag not in _HOLDS):
            if node.tag in shuts:
                self.at = node.parent
            node = node.parent
        child = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(child)
        if tag not in VOID:
            self.at = child

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    """The tree of a page, however broken; elements left open end where their parent does."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def clean(root: Node) -> None:
    """Drops unsafe elements, decoration of documentation pages, and images that carry their data in the address."""
    for node in list(root.nodes()):
        classes, data_image = node.get("class").lower(), node.tag == "img" and node.get("src").strip().lower().startswith("data:")
        chrome = "data-pagefind-ignore" in node.attrs or CHROME_LABEL in node.get("aria-label").lower() or any(c in classes for c in CHROME_CLASS)
        if node.tag in UNSAFE or data_image or chrome:
            node.remove()


def language(pre: Node, code: Node | None) -> str | None:
    """Of language-x in five attributes the first; else a bare name in a data attribute."""
    inner = code or Node("code", {}, None)
    for value in (inner.get("class"), pre.get("class"), pre.get("data-language"), inner.get("data-language"), pre.get("data-lang")):
        if found := re.search(r"language-([\w-]+)", value, re.I | re.A):
            return found[1].lower()
    for name in ("data-language", "data-lang"):
        value = pre.get(name) or inner.get(name)
        if _LANGUAGE.search(value):
            return value.lower()
    return None


def _is_copy_button(node: Node) -> bool:
    if any(x.tag == "pre" for x in node.nodes()):
        return False
    copies = "copy" in node.get("class").lower() or "copy" in node.get("aria-label").lower()
    return copies or node.tag == "button" and node.text().strip().lower() == "copy"


def _is_line(node: Node) -> bool:
    return "data-line" in node.attrs or bool({"line", "token-line"} & set(node.get("class").split()))


def normalize_code(root: Node) -> None:
    """Code blocks hold one code element with plain lines, tagged with their language; copy buttons go."""
    for node in list(root.nodes()):
        if _is_copy_button(node):
            node.remove()
    for pre in [n for n in root.nodes() if n.tag == "pre"]:
        code = next((n for n in pre.nodes() if n.tag == "code"), None)
        named, block = language(pre, code), code or pre
        lines = [n for n in block.nodes() if _is_line(n)]
        if lines:
            block.children = ["\n".join(n.text() for n in lines).rstrip("\n")]
        if named:
            rest = re.sub(r"language-[\w-]+", "", block.get("class"), flags=re.I | re.A).strip()
            block.attrs["class"] = f"{rest} language-{named}".strip()
        if code is not None:
            raw = next((n.text() for n in code.nodes() if n.tag in ("xmp", "plaintext")), "")
            if raw:
                code.children = [raw]
            pre.children, code.parent = [code], pre
