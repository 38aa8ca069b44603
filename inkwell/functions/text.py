"""Text functions as Spark expressions: tokens, compression, metrics, quality codes, detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.urls import trim_all

# Words that carry no topic, as the ranking of keywords needs them.
STOP_WORDS = (
    "the a an and or but if then else when while for of to in on at by with from into onto as is are was were be been "
    "being am do does did doing have has had having this that these those it its they them their there here we you your "
    "our us i me my he she his her not no nor so than too very can will just should would could may might must shall "
    "about above after again against all any because before below between both down during each few further how more "
    "most other over own same some such only out up off where which who whom why what whose also use used using via per "
    "e.g i.e etc get set see note example one two three new like within without"
)

FENCE = "```"


def stop_words() -> list[str]:
    return STOP_WORDS.split()


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def compress_markdown(text: Column) -> Column:
    """Images dropped, links reduced to their text, blank runs to one, trimmed."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"!\[.*?\]\(.*?\)", "")
    out = F.regexp_replace(out, r"\[(.*?)\]\(.*?\)", r"[$1]")
    return trim_all(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def clean_noise(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?s)```.*?```", " ")
    out = F.regexp_replace(out, r"`[^`]*`", " ")
    return F.regexp_replace(out, r"https?://\S+", " ")


def tokenize(text: Column) -> Column:
    """Lower-cased ASCII tokens with inner + # . -, without . and - at their ends."""
    raw = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9+#.-]*"), F.lit(0))
    return F.filter(F.transform(raw, lambda t: F.btrim(t, F.lit(".-"))), lambda t: t != "")


def content_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(stop_words()) & ~t.rlike(r"^[0-9]+$"))


def dedupe_tags(tags: Column) -> Column:
    """Trimmed tags without blanks; of those that differ by case alone the first stays."""
    plain = F.filter(F.transform(tags, trim_all), lambda t: t != "")
    return F.filter(plain, lambda t, i: F.array_position(F.transform(plain, F.lower), F.lower(t)) == i + 1)


def heading_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s{0,3}#{1,6}\s"))


def heading_plain_text(raw: Column) -> Column:
    # The marks that a heading may hold.
    target = r"\([^()]*(?:\([^()]*\)[^()]*)*\)"
    out = F.regexp_replace(raw, rf"!\[([^\]]*)\]{target}", "$1")
    out = F.regexp_replace(out, rf"\[([^\]]*)\]{target}", "$1")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\[[^\]]*\]", "$1")
    out = F.regexp_replace(out, r"`([^`]*)`", "$1")
    out = F.regexp_replace(out, r"[*_~]", "")
    return trim_all(F.regexp_replace(out, r"\s+", " "))


def slugify(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "`", ""), r"[^A-Za-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(trim_all(out), r"\s+", "-"), "-+", "-")


def confidence(text: Column) -> Column:
    n = F.length(text)
    return F.when(n < 500, "low").when(n < 2000, "medium").otherwise("high")


def looks_like_html(text: Column) -> Column:
    start = F.lower(F.regexp_replace(text, r"^\s+", ""))
    return start.startswith("<!doctype html") | start.startswith("<html") | start.startswith("<head") | start.startswith("<body")


# What error pages say. Word edges are ASCII, whatever \b means to the engine.
ERROR_PATTERNS = (
    r"(?<![A-Za-z0-9_])404(?![A-Za-z0-9_])",
    r"(?i)page\s*(?:not\s*found|doesn'?t\s*exist|can'?t\s*be\s*found)",
    r"(?i)does(?:n'?t| not)\s*exist",
    r"(?i)(?<![A-Za-z0-9_])not\s*found(?![A-Za-z0-9_])",
    r"(?i)there\s*isn'?t\s*a\s*github\s*pages\s*site\s*here",
    r"(?i)site\s*not\s*found",
    r"(?i)something\s+went\s+wrong",
    r"(?i)an?\s+error\s+occurred",
)


def looks_like_error_page(text: Column) -> Column:
    body, out = trim_all(text), F.lit(False)
    for p in ERROR_PATTERNS:
        out = out | body.rlike(p)
    return (F.length(body) <= 1500) & out


def text_artifact_reason(text: Column) -> Column:
    """Why a text body is no usable artifact, or null."""
    body = trim_all(text)
    return (
        F.when(F.length(body) < 10, "empty or near-empty body")
        .when(looks_like_html(body), "body is HTML, not text/markdown")
        .when(looks_like_error_page(body), "body looks like an error page")
    )


METRICS = ("chars", "code_blocks", "tables", "images", "ordered_steps", "bullets", "headings")
#: The order in which metrics decide which of two texts is richer.
RICHNESS = ("tables", "code_blocks", "headings", "images", "ordered_steps", "chars")


def content_metrics(text: Column) -> dict[str, Column]:
    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("long")

    return {
        "chars": F.length(text).cast("long"),
        "code_blocks": F.floor(count(FENCE) / 2).cast("long"),
        "tables": count(r"(?m)^\|(?:\s*---\s*\|)+\s*$"),
        "images": count(r"!\[[^\]]*\]\("),
        "ordered_steps": count(r"(?m)^[0-9]+\.\s+"),
        "bullets": count(r"(?m)^[-*]\s+"),
        "headings": count(r"(?m)^#{1,6}\s+"),
    }


def richer(prefix_a: str, prefix_b: str) -> Column:
    """Lexicographic comparison of two sets of metric columns."""
    a, b = (F.struct(*[F.col(f"{p}{k}").alias(k) for k in RICHNESS]) for p in (prefix_a, prefix_b))
    return a > b


# Signs of page chrome in extracted text, in the order of their labels.
LEAKAGE = (
    ("raw-html", r"(?i)<(?:nav|header|footer|aside|svg|path)(?![A-Za-z0-9_])|<[a-z][a-z0-9]*\s[^>]*(?<![A-Za-z0-9_])(?:class|id|role|aria-[a-z]+)\s*="),
    ("base64-image", r"(?i)data:image/[a-z]+;base64,"),
    ("skip-to-content", r"(?i)skip to (?:main )?content"),
    ("on-this-page", r"(?im)^on this page$"),
    ("theme-toggle", r"(?i)(?:toggle|switch to) (?:dark|light|the)? ?(?:mode|theme)"),
    ("cookie-consent", r"(?i)(?:accept all cookies|we use cookies|cookie (?:policy|preferences|settings))"),
    ("loading-shell", r"(?im)^\s*loading[.…]*\s*$"),
    ("search-placeholder", r"(?im)^\s*search(?:\.{3}|…|\s+docs)?\s*$"),
    ("empty-link", r"(?<!!)\[\s*\]\([^)]*\)"),
    ("template-macro", r"\{\{\s*[A-Za-z][A-Za-z0-9_]*\s*\("),
)


def leakage_signals(text: Column) -> Column:
    fenced = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", ""), r"(?s)~~~.*?~~~", "")
    bare = F.regexp_replace(fenced, r"`[^`]*`", "")
    return F.array_compact(F.array(*[F.when((fenced if k == "empty-link" else bare).rlike(p), F.lit(k)) for k, p in LEAKAGE]))


# Images and links of Markdown.
_IMAGE, _LINK = r"!\[[^\]]*\]\([^)]*\)", r"\[[^\]]*\]\([^)]*\)"


def quality_codes(text: Column, title: Column) -> tuple[Column, Column]:
    """Codes of what is wrong with extracted Markdown, and whether the page is a navigation hub."""
    lines = F.split(text, "\n")
    headings = F.size(F.filter(lines, lambda x: trim_all(x).rlike(r"^#{1,6}\s+")))
    prose = F.size(
        F.filter(
            lines,
            lambda x: ~trim_all(x).rlike(r"^#{1,6}\s+")
            & (F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, _IMAGE, ""), _LINK, ""), r"[-*>!\s]", "")) > 0),
        )
    )
    images, links = F.regexp_count(text, F.lit(_IMAGE)), F.regexp_count(text, F.lit(_LINK))
    # Text between an odd and the next fence line is code. Commands that ran together.
    inside = F.transform(F.split(text, r"(?m)^\s*```.*$"), lambda x, i: F.when(i % 2 == 1, x).otherwise(""))
    collapsed = F.exists(inside, lambda x: x.rlike(r"""[a-z0-9)"'](?:cd|npm|yarn|pnpm|npx|import|export|git)\s"""))
    hub = (links >= 10) & (links > prose * 2)
    codes = F.array(
        F.when(text.rlike(r"!\[[^\]]*\]\(\s*data:"), "quality:base64-image"),
        F.when((images > 0) & (images > headings + prose), "quality:high-image-ratio"),
        F.when(collapsed, "quality:collapsed-code"),
        F.when(estimate_tokens(text) > 8000, "quality:oversized"),
        F.when(looks_like_error_page(F.concat(title, F.lit("\n"), text)), "quality:error-page"),
        F.when(hub, "quality:index-hub"),
    )
    return F.array_compact(codes), hub


def markdown_title(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1), F.lit("")), F.lit("Untitled"))


def sanitize_source(text: Column) -> Column:
    """Scripts, styles, widgets, event handlers and javascript: removed from untrusted Markdown. The names are fixed values."""
    out = text
    for tag in ("script", "style", "iframe", "svg", "audio", "video", "button"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    out = F.regexp_replace(out, r"(?i)<use\b[^>]*/?>", "")
    out = F.regexp_replace(out, r"""(?i)\son[a-z]+\s*=\s*"[^"]*\"""", "")
    out = F.regexp_replace(out, r"(?i)\son[a-z]+\s*=\s*'[^']*'", "")
    return F.regexp_replace(out, r"(?i)javascript:", "")


def normalize_regression(text: Column) -> Column:
    out = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?m)[ \t]+$", "")
    return trim_all(F.regexp_replace(out, r"\n{3,}", "\n\n"))


# Secrets are told by shape: label and pattern, the first that matches names the artifact.
SECRETS = (
    ("GitHub token", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}"),
    ("AWS access key", r"(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])"),
    ("private key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("bearer credential", r"(?i)(?:api[_-]?key|secret|token|password)\s*[:=]\s*[\"'][A-Za-z0-9_\-]{20,}[\"']"),
)


def secret_label(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, pattern in reversed(SECRETS):
        out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
    return out


# Documentation engines in the order in which they are asked: pattern in the page, word in the generator,
# engine, framework, capture. The order is part of the result, as patterns overlap.
_NEXT = r"__NEXT_DATA__|/_next/static/|self\.__next_f"
DETECTORS = (
    (r'__VP_HASH_MAP__|__VP_SITE_DATA__|class="[^"]*\bVPDoc\b', None, "vitepress", None, "static"),
    (r"(?i)data-pagefind-body|sl-(?:doc-search|markdown-content|container)|starlight", None, "starlight", None, "static"),
    (r"(?i)docusaurus|theme-doc-", "docusaurus", "docusaurus", None, "static"),
    (None, "material&mkdocs", "generated-static", "material-mkdocs", "static"),
    (r"(?i)mkdocs", "mkdocs", "generated-static", "mkdocs", "static"),
    (r'DOCUMENTATION_OPTIONS|searchindex\.js|documentation_options\.js|class="sphinxsidebar"', "sphinx", "generated-static", "sphinx", "static"),
    (r"(?i)\$docsify|docsify(?:\.min)?\.js", None, "spa", "docsify", "rendered"),
    (r"(?i)mintlify", "mintlify", "next", "mintlify", "static"),
    (r"(?i)nextra", None, "next", "nextra", "static"),
    (r"(?i)fumadocs|fd-", None, "next", "fumadocs", "static"),
    (_NEXT, None, "next", None, "static"),
    (r"(?i)gitbook", "gitbook", None, "gitbook", "static"),
    (r"(?i)readme(?:\.io|\.com)|data-rm-|\brm-Guides\b", "readme", None, "readme", "static"),
    (r"(?i)redocly|redoc", "redocly", None, "redocly", "static"),
    (r"(?i)rspress", "rspress", "generated-static", "rspress", "static"),
    (r"(?i)vuepress", "vuepress", "generated-static", "vuepress", "static"),
    (r"(?i)just-the-docs|search-data\.json", "just-the-docs", "generated-static", "just-the-docs", "static"),
    (r"(?i)td-(?:sidebar|content)|docsy", "docsy", "generated-static", "docsy", "static"),
)


def generator(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, r"""(?is)<meta[^>]*name=["']generator["'][^>]*content=["']([^"']*)["']""", 1))


def body_text(html: Column) -> Column:
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*)", 1)
    return trim_all(F.regexp_replace(F.regexp_replace(body, r"(?is)<!--.*?-->", ""), r"<[^>]*>", ""))


def detect_engine(html: Column) -> Column:
    """Struct of engine, framework and capture: the first detector that matches, else the page's general shape."""

    def label(engine: str | None, framework: str | None, capture: str) -> Column:
        return F.struct(F.lit(engine).cast("string").alias("engine"), F.lit(framework).cast("string").alias("framework"), F.lit(capture).alias("capture"))

    scripts = F.regexp_count(html, F.lit(r"(?i)<script[\s>]"))
    headings = F.regexp_count(html, F.lit(r"(?i)<h[123][\s>]"))
    out = (
        F.when((F.length(body_text(html)) < 400) & (scripts >= 3), label("spa", None, "rendered"))
        .when(headings >= 8, label("generated-static", None, "static"))
        .otherwise(label(None, None, "static"))
    )
    made = generator(html)
    for pattern, word, engine, framework, capture in reversed(DETECTORS):
        hit = html.rlike(pattern) if pattern else F.lit(False)
        if word and "&" in word:
            first, second = word.split("&")
            hit = made.contains(first) & (made.contains(second) | html.rlike(f"(?i){second}"))
        elif word:
            hit = hit | made.contains(word)
        out = F.when(hit, label(engine, framework, capture)).otherwise(out)
    return out


def fuzzy_limit(text: Column) -> Column:
    n = F.length(text)
    return F.when(n <= 3, 1).when(n <= 5, 2).otherwise(3)
