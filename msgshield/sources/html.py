"""Message extraction from raw HTML pages.

One page in, many messages out: a ``mapInPandas`` over the pages table. Each
task parses its own pages with the standard-library HTML tokenizer, builds a
light element tree (implied end tags for ``p``/``li``, scopes and void
elements as HTML has them) and matches descendant selectors of the form
``tag.class[attr="value"] tag[attr]``. Rules apply in rule order, then
document order; an element matched by an earlier rule is not emitted again
(the reference marks scanned elements), while a matching element nested in
another matching element is emitted as well.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import DataFrame, functions as F

from .. import schemas as S

# The reference's message selectors, in its rule order.
REFERENCE_RULES = (
    '.message-in span[data-testid="selectable-text"]',
    '.message-out span[data-testid="selectable-text"]',
    '[data-testid="tweetText"]',
    'div[role="row"] div[dir="auto"]',
)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset(("script", "style", "template", "noscript"))
# Start tags that close an open <p> (HTML's "close a p element" rule).
CLOSES_P = frozenset(("address article aside blockquote details div dl fieldset figcaption figure "
                      "footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section "
                      "table ul").split())
# Scope boundaries and special elements of the HTML standard (fixed values).
SCOPE = frozenset("applet caption html table td th marquee object template".split())
BUTTON_SCOPE = SCOPE | {"button"}
LIST_SCOPE = SCOPE | {"ol", "ul"}
SPECIAL = SCOPE | CLOSES_P | VOID | frozenset((
    "body button center colgroup dd dir dt frame frameset head iframe li listing noembed noframes noscript "
    "plaintext script search select style summary tbody textarea tfoot thead title tr xmp").split())
ITEM_STOPS = SPECIAL - {"address", "div", "p", "li"}
BLOCK = CLOSES_P | frozenset(("li", "tr", "td", "th", "dd", "dt", "body", "html", "caption"))

_SIMPLE = re.compile(r"""
    (?P<tag>[a-zA-Z][a-zA-Z0-9-]*|\*)?
    (?P<rest>(?:\.[\w-]+|\[[^\]]+\])*)
""", re.X)
_PART = re.compile(r"""\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:=\s*(?P<q>["']?)(?P<val>.*?)(?P=q))?\s*\]""")


def parse_selector(sel: str):
    """``'div[role="row"] div.x'`` → list of (tag, classes, attrs) compound parts."""
    parts = []
    for token in re.findall(r'(?:[^\s"\[\]]+|\[[^\]]*\])+', sel.strip()):
        m = _SIMPLE.fullmatch(token)
        if not m:
            raise ValueError(f"unsupported selector part: {token!r}")
        tag = (m.group("tag") or "*").lower()
        classes, attrs = [], []
        for p in _PART.finditer(m.group("rest") or ""):
            if p.group("cls"):
                classes.append(p.group("cls"))
            else:
                attrs.append((p.group("attr").lower(), p.group("val")))
        parts.append((tag, tuple(classes), tuple(attrs)))
    return parts


class _Node:
    """An element: ``tokens[start:end]`` is its rendered text, in order."""

    __slots__ = ("tag", "attrs", "classes", "parent", "order", "tokens", "start", "end")

    def __init__(self, tag, attrs, parent, order, tokens):
        self.tag = tag
        self.attrs = attrs
        self.classes = set((attrs.get("class") or "").split())
        self.parent = parent
        self.order = order
        self.tokens = tokens
        self.start = self.end = len(tokens)


class _TreeBuilder(HTMLParser):
    """Open elements as a stack; text, ``<br>`` and block boundaries as one token list.

    End tags and implied ends stop at the boundaries the HTML standard sets, so a
    list inside a list item, or a stray end tag, closes nothing outside its scope.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tokens = []
        self.root = _Node("#root", {}, None, -1, self.tokens)
        self.stack = [self.root]
        self.open_tags = Counter()       # tells at once that nothing of a tag is open
        self.raw = 0                     # open elements whose text is not rendered
        self.nodes = []

    def _open(self, tag, attrs):
        if tag in BLOCK:
            self.tokens.append("\n")
        node = _Node(tag, attrs, self.stack[-1], len(self.nodes), self.tokens)
        self.nodes.append(node)
        return node

    def _pop_to(self, depth):
        for node in reversed(self.stack[depth:]):
            node.end = len(self.tokens)
            if node.tag in BLOCK:
                self.tokens.append("\n")
            self.open_tags[node.tag] -= 1
            self.raw -= node.tag in RAW_TEXT
        del self.stack[depth:]

    def _close(self, tag, stops):
        """Close the innermost open ``tag`` unless an element of ``stops`` is inside it."""
        if not self.open_tags[tag]:
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag == tag:
                self._pop_to(depth)
                return
            if self.stack[depth].tag in stops:
                return

    def handle_starttag(self, tag, attrs):
        a = {k.lower(): (v if v is not None else "") for k, v in attrs}
        if tag in CLOSES_P or tag in ("li", "dd", "dt"):
            if tag == "li":
                self._close("li", ITEM_STOPS)
            self._close("p", BUTTON_SCOPE)
        if tag == "br":
            self.tokens.append("\n")
        node = self._open(tag, a)
        if tag not in VOID:
            self.stack.append(node)
            self.open_tags[tag] += 1
            self.raw += tag in RAW_TEXT

    def handle_startendtag(self, tag, attrs):
        # HTML ignores the slash of an element that may have content.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag == "li":
            self._close("li", LIST_SCOPE)
        elif tag == "p":
            self._close("p", BUTTON_SCOPE)
        elif tag in SPECIAL:
            self._close(tag, SCOPE)
        else:
            self._close(tag, SPECIAL)

    def handle_data(self, data):
        if not self.raw:
            self.tokens.append(data)

    def close(self):
        super().close()
        self._pop_to(1)


def _matches(node, part):
    tag, classes, attrs = part
    if tag != "*" and node.tag != tag:
        return False
    if any(c not in node.classes for c in classes):
        return False
    for k, v in attrs:
        if k not in node.attrs or (v is not None and node.attrs[k] != v):
            return False
    return True


def _select(node, parts):
    """Descendant combinator: last part on the node, earlier parts on ancestors in order."""
    if not _matches(node, parts[-1]):
        return False
    i = len(parts) - 2
    anc = node.parent
    while i >= 0 and anc is not None:
        if anc.tag != "#root" and _matches(anc, parts[i]):
            i -= 1
        anc = anc.parent
    return i < 0


def inner_text(node) -> str:
    """Rendered-text approximation: text in order, scripts/styles left out,
    ``<br>`` and block boundaries as line breaks, runs of blanks collapsed
    inside each line."""
    lines = [re.sub(r"[ \t\r\f\v]+", " ", ln).strip(" ")
             for ln in "".join(node.tokens[node.start:node.end]).split("\n")]
    return "\n".join(ln for ln in lines if ln)


def extract_from_html(html: str, rules):
    """All matches of ``rules`` (parsed selectors) in one page:
    ``[(rule_idx, node_idx, text)]`` in rule order then document order."""
    b = _TreeBuilder()
    b.feed(html or "")
    b.close()
    seen, rows = set(), []
    for r_idx, parts in enumerate(rules):
        for node in b.nodes:
            if node.order in seen or not _select(node, parts):
                continue
            text = inner_text(node)
            rows.append((r_idx, node.order, text))
            seen.add(node.order)
    return rows


def url_host(url):
    """``location.hostname``: the host of the URL's authority in lower case, without user
    and port; null where there is none. Odd characters elsewhere do not matter."""
    host = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.when(host != "", host)


OUT_SCHEMA = "page_id long, url string, rule_idx int, node_idx int, text string"


def extract_messages(pages: DataFrame, rules=REFERENCE_RULES, id_col: str = "page_id",
                     url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, source, rule_idx, node_idx, text)`` per matched element.

    ``source`` is the page host (``window.location.hostname``). Selector
    parsing happens once on the driver; the parsed rules travel in the
    closure (a few bytes). Each Arrow batch of pages is parsed in a Python
    worker; no page crosses a task boundary.
    """
    parsed = [parse_selector(r) for r in rules]

    def run(batches):
        import pandas as pd
        for pdf in batches:
            out = []
            for pid, url, html in zip(pdf[id_col], pdf[url_col], pdf[html_col]):
                for r_idx, n_idx, text in extract_from_html(html, parsed):
                    out.append((int(pid), url, r_idx, n_idx, text))
            yield pd.DataFrame(out, columns=["page_id", "url", "rule_idx", "node_idx", "text"])

    raw = pages.select(F.col(id_col).cast("long").alias(id_col), url_col, html_col)
    found = raw.mapInPandas(run, OUT_SCHEMA)
    return found.select("page_id", url_host(F.col("url")).alias("source"),
                        "rule_idx", "node_idx", "text")


def register_udtf(spark, name: str = "extract_messages", rules=REFERENCE_RULES) -> None:
    """Make extraction a table function of SQL: ``SELECT p.page_id, m.* FROM pages p, LATERAL
    extract_messages(p.html) m`` gives ``(rule_idx, node_idx, text)`` per matched element; a null page gives none."""
    from pyspark.sql.functions import udtf
    parsed = [parse_selector(r) for r in rules]

    class Extract:
        def eval(self, html):
            yield from extract_from_html(html, parsed)

    spark.udtf.register(name, udtf(Extract, returnType="rule_idx int, node_idx int, text string", useArrow=True))


def page_messages(pages: DataFrame, rules=REFERENCE_RULES) -> DataFrame:
    """Extraction followed by the message filter (trim, >= 5 UTF-16 units),
    shaped as MESSAGE rows: scope = page, ord = (rule, node) order."""
    from ..operators.detect import filter_messages
    m = extract_messages(pages, rules)
    m = m.select(F.col("page_id").cast("string").alias("scope"), "source", "text",
                 (F.col("rule_idx").cast("long") * F.lit(1 << 32) + F.col("node_idx")).alias("ord"))
    return filter_messages(m, min_len=S.MIN_MESSAGE_UNITS)
