"""HTML articles to markdown: the one part of ingestion that no column expression can say.

A page becomes a tree, and rules by tag say what a node is in running text and what it is as a block. A paper's page has
an article with a title, an abstract and nested sections, all of which are headed ``##``; what lacks them is an error.
Other pages are rendered as they come, their headings at the same level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

#: Elements without content, elements and classes that are no part of a text, heading tags, and class names
#: of the converter that made a paper's page.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("script style nav footer noscript template form button head".split())
UNSEEN_CLASSES = frozenset(("ltx_TOC", "ltx_page_footer", "ltx_ERROR", "ltx_note_mark", "ltx_note_type", "ad"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
ARTICLE, TITLE, ABSTRACT, NOTE, NOTE_TEXT, LABEL = "ltx_document", "ltx_title_document", "ltx_abstract", "ltx_note", "ltx_note_content", "ltx_tag"
TEX = "application/x-tex"


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    kids: list = field(default_factory=list)

    @property
    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    @property
    def unseen(self) -> bool:
        return self.tag in UNSEEN or not self.classes.isdisjoint(UNSEEN_CLASSES)

    def nodes(self) -> Iterator[Node]:
        return (k for k in self.kids if isinstance(k, Node))

    def inside(self) -> Iterator[Node]:
        for k in self.nodes():
            yield k
            yield from k.inside()

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node("")]

    def handle_starttag(self, tag: str, attrs) -> None:
        node = Node(tag, dict(attrs))
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.open[-1].kids.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.open[-1].kids.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.open[0]


def squeezed(text: str) -> str:
    return " ".join(text.split())


@dataclass
class Page:
    """Where a page's links start from, and the files of its figures; without files no figure is shown."""

    base: str = ""
    figures: dict[str, str] = field(default_factory=dict)


INLINE: dict[str, Callable[[Node, Page], str]] = {}
BLOCK: dict[str, Callable[[Node, Page], str]] = {}


def _says(rules: dict, *tags: str):
    def add(rule):
        rules.update(dict.fromkeys(tags, rule))
        return rule

    return add


def inline(node: Node | str, page: Page) -> str:
    """A node in running text."""
    if isinstance(node, str):
        return node
    if node.unseen:
        return ""
    if NOTE in node.classes:
        body = next((n for n in node.inside() if NOTE_TEXT in n.classes), node)
        said = squeezed(running(body, page))
        return f" ({said})" if said else ""
    return INLINE.get(node.tag, running)(node, page)


def running(node: Node, page: Page) -> str:
    return "".join(inline(k, page) for k in node.kids)


@_says(INLINE, "math")
def _math(node: Node, page: Page) -> str:
    tex = next((n.text().strip() for n in node.inside() if n.tag == "annotation" and n.attrs.get("encoding") == TEX), "")
    mark = "$$" if node.attrs.get("display") == "block" else "$"
    return f"{mark}{tex}{mark}" if tex else squeezed(node.attrs.get("alttext") or "") or squeezed(node.text())


@_says(INLINE, "img", "object")
@_says(BLOCK, "img", "object")
def _figure(node: Node, page: Page) -> str:
    file = page.figures.get(urljoin(page.base, node.attrs.get("src" if node.tag == "img" else "data") or ""))
    alt = squeezed(node.attrs.get("alt") or "").translate({ord("["): None, ord("]"): None})
    return f"![{alt or 'Figure'}]({file})" if file else ""


@_says(INLINE, "a")
def _link(node: Node, page: Page) -> str:
    said, to = squeezed(running(node, page)), node.attrs.get("href") or ""
    return said if not said or not to or to.startswith(("#", "javascript:")) else f"[{said}]({urljoin(page.base, to)})"


INLINE["br"] = lambda node, page: "\n"
INLINE["code"] = lambda node, page: f"`{node.text()}`"
for _tags, _form in ((("strong", "b"), "**{}**"), (("em", "i"), "*{}*"), (("sup",), "^({})"), (("sub",), "_({})")):
    INLINE.update(dict.fromkeys(_tags, lambda node, page, form=_form: form.format(squeezed(running(node, page)))))


def block(node: Node | str, page: Page) -> str:
    """A node on lines of its own; what has no rule is what its parts are, a blank line between them."""
    if isinstance(node, str):
        return squeezed(node)
    if node.unseen:
        return ""
    if node.tag in BLOCK:
        return BLOCK[node.tag](node, page)
    return "\n\n".join(filter(None, (block(k, page) for k in node.kids)))


BLOCK["section"] = lambda node, page: ""  # sections are told by ``sections``
for _tag in ("p", "figcaption"):
    BLOCK[_tag] = lambda node, page: squeezed(running(node, page))
for _tag in HEADINGS:
    BLOCK[_tag] = lambda node, page: f"**{said}**" if (said := heading(node, page)) else ""
BLOCK["pre"] = lambda node, page: f"```\n{node.text().strip()}\n```"


def heading(node: Node, page: Page) -> str:
    """A heading's text, which never shows figures."""
    return squeezed(running(node, Page(page.base)))


@_says(BLOCK, "ul", "ol")
def _list(node: Node, page: Page) -> str:
    out = []
    for n, item in enumerate((k for k in node.nodes() if k.tag == "li"), 1):
        said = squeezed("".join(inline(k, page) for k in item.kids if isinstance(k, str) or LABEL not in k.classes))
        out += [f"{n}. {said}" if node.tag == "ol" else f"- {said}"] if said else []
    return "\n".join(out)


@_says(BLOCK, "table")
def _table(node: Node, page: Page) -> str:
    """Rows as lines of cells, as many in each as in the widest, and a rule below the first; equations as paragraphs."""
    rows = [n for n in node.inside() if n.tag == "tr"]
    cells = lambda row: [n for n in row.nodes() if n.tag in ("th", "td")]
    if any("equation" in c for c in node.classes):
        every = lambda row: [n for n in row.inside() if n.tag in ("th", "td")]
        return "\n\n".join(filter(None, (squeezed(" ".join(inline(c, page) for c in every(row))) for row in rows)))
    grid = [[squeezed(running(c, page)).replace("|", "\\|") for c in cells(row)] for row in rows if cells(row)]
    if not grid:
        return ""
    columns = range(max(map(len, grid)))
    line = lambda get: "| " + " | ".join(map(get, columns)) + " |"
    told = [line(lambda i, row=row: row[i] if i < len(row) else "") for row in grid]
    return "\n".join([told[0], line(lambda i: "---"), *told[1:]])


def sections(node: Node, page: Page) -> Iterator[str]:
    """A section's heading, its blocks, and then the sections inside it, all as blocks of the same level."""
    own = next((k for k in node.nodes() if k.tag in HEADINGS), None)
    if own is not None and (said := heading(own, page)):
        yield f"## {said}"
    yield from filter(None, (block(k, page) for k in node.nodes() if k is not own and k.tag != "section"))
    for k in node.nodes():
        if k.tag == "section":
            yield from sections(k, page)


def _paper(article: Node, page: Page) -> tuple[list[str], str | None]:
    title = next((n for n in article.inside() if n.tag == "h1" and TITLE in n.classes), None)
    if title is None or not (said := heading(title, page)):
        return [], "no title" if title is None else "empty title"
    parts = [f"## {said}"]
    abstract = next((n for n in article.inside() if ABSTRACT in n.classes), None)
    if abstract is not None and (body := "\n\n".join(filter(None, (block(k, page) for k in abstract.nodes() if k.tag not in HEADINGS)))):
        parts += ["## Abstract", body]
    if page.figures:
        parts += filter(None, (block(k, page) for k in article.nodes() if k not in (title, abstract) and k.tag not in ("section", "nav")))
    own = [k for k in article.nodes() if k.tag == "section"]
    for k in own:
        parts += sections(k, page)
    return parts, None if own and any(not p.startswith("## ") for p in parts) else "no body" if own else "no sections"


def _any_page(root: Node, page: Page) -> tuple[list[str], str | None]:
    """Blocks in order, headings as such, wherever they stand; lists, tables and paragraphs by the same rules."""

    def flat(node: Node) -> Iterator[str]:
        line: list[str] = []
        for k in node.kids:
            own = isinstance(k, Node) and (k.tag in BLOCK or k.tag in ("html", "body", "main", "article", "div", "header", "aside", "figure", "blockquote") or k.tag in UNSEEN or k.tag == "title")
            if not own:
                line.append(inline(k, page))
                continue
            yield squeezed("".join(line))
            line = []
            if k.tag in HEADINGS:
                yield f"## {said}" if (said := heading(k, page)) else ""
            elif k.tag in BLOCK and k.tag != "section":
                yield block(k, page)
            elif not k.unseen and k.tag != "title":
                yield from flat(k)
        yield squeezed("".join(line))

    parts = [p for p in flat(root) if p]
    heads = sum(p.startswith("## ") for p in parts)
    return parts, "no title" if not heads else "no body" if heads == len(parts) else None


def to_markdown(html: str, base: str = "", figures: dict[str, str] | None = None, paper: bool = False) -> tuple[str, int, str | None]:
    """Markdown, the number of conversion errors that the page marks, and what is missing, if it is no article.

    With ``paper``, a page without a paper's article is an error, and an error has no markdown.
    """
    root, page = parse(html), Page(base, figures or {})
    article = next((n for n in root.inside() if n.tag == "article" and ARTICLE in n.classes), None)
    errors = sum("ltx_ERROR" in n.classes for n in (article or root).inside())
    if article is not None:
        parts, error = _paper(article, page)
    elif paper:
        return "", 0, "no article"
    else:
        parts, error = _any_page(root, page)
    whole = "\n\n".join(parts)
    while "\n\n\n" in whole:
        whole = whole.replace("\n\n\n", "\n\n")
    return "" if error and (paper or article is not None) else whole.strip(), errors, error


def render(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", paper: bool = False) -> DataFrame:
    """page_id, markdown, n_errors, error: one row for each page, in Arrow batches; a null page is empty."""
    p = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([to_markdown(h or "", u or "", paper=paper) for h, u in zip(b["html"], b["url"])], columns=["markdown", "n_errors", "error"])
            out.insert(0, "page_id", b["page_id"].array)
            yield out

    return p.mapInPandas(run, "page_id long, markdown string, n_errors long, error string")
