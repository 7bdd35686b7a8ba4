"""Main text of web pages by composite text density (after Sun, Song and Liao 2011).

For every node of the page's tree: C characters, T tags, LC characters inside links, LT link tags.
    density = C / T * ln(1 + C * T / (LC * LT)) / ln(C / (C - LC) * LC + (body's LC / body's C) * C + e),
so much text in few tags scores high and link lists score low.  The density sum of a node is the sum of its children's
densities.  The smallest density on the path from the body to the node of highest density sum is the threshold.  The content is
the enclosing article or main element of that node, with all other articles of the page that reach the threshold and are no
teasers (headed by a link); articles within an article that has text of its own, or within a block named as responses, are reader
comments.  Without an article, the highest node of the path with a further branch
not below the threshold (or with text in links for at most a third, and a quarter of the node's characters a tag), so that
sections side by side are taken together, without branches that are links for more than half.
Its text is written block by block without the subtrees that are no article text by their tag, role or name.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the HTML standard: elements without content, with raw text, and that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of these closes an open paragraph; of the pairs, an open element of the same group.
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SAME_GROUP = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
              "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th")}
GROUP_ROOT = frozenset("ul ol menu dl table body html div section article".split())
#: Never article text: by element, and by whole words of class, id and role.
SKIP = frozenset("script style noscript template nav header footer aside form button select option textarea input iframe "
                 "object embed svg canvas annotation annotation-xml head title noembed noframes dialog menu audio video map".split())
SKIP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside complementary footer header masthead contentinfo "
    "comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr notice notices notification popup "
    "alert alerts modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget toolbar "
    "pagination pager search form copyright legal disclaimer hidden".split())
#: Of these, words that name a subject as well: they drop no dense block inside the content.
SUBJECTS = frozenset(
    "sponsor promotion discussion notice notices notification consent alert alerts share sharing social related recommended search "
    "form copyright legal disclaimer".split())
#: An id on any other element is an anchor.
CONTAINERS = frozenset("center details div dl fieldset ol section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Names of blocks of reader comments where they hold articles, and of quotations from the article in an aside.
RESPONSES = frozenset("response responses remark remarks feedback thread talkback".split())
QUOTES = frozenset("pullquote quote quotation pull".split())
FIGURES = frozenset("figure figcaption blockquote".split())
#: Words that turn a name's meaning (with-sidebar, no-ads), and that make a header one of the article's own.
TURNING = frozenset("with has no without".split())
ARTICLE_WORDS = frozenset("article entry post story".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                  r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
                  r"|<([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
                  r"|<([a-zA-Z][^\s/>]*)([^>]*)>", re.S)  # last: a quote that nothing closes ends with its tag
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")
_MAY_RESPOND = re.compile("respon|remark|feedback|thread|talkback", re.I)


#: The content grows to an enclosing element that states it is the article.
ARTICLE = ("article", "main")
#: A branch beside the densest node: text if links are at most 1 / LINK_POOR of it, and characters a tag 1 / THIN of that node's.
LINK_POOR, THIN = 3, 4
#: Characters beside headings and inner articles from which an article has text of its own.
OWN_TEXT = 80


class Node:
    __slots__ = ("tag", "attrs", "parts", "parent", "chars", "tags", "link_chars", "link_tags", "density", "density_sum", "dropped",
                 "kept", "article", "responses", "reply")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list[Node | str] = []
        self.dropped = self.kept = self.reply = False
        # the outermost article and the nearest block named as responses around this node
        self.article = parent and (parent.article or (parent if parent.tag == "article" else None))
        self.responses = parent and (parent if parent.attrs and _names_responses(parent) else parent.responses)


def tree(page: str) -> Node:
    """Elements and texts in page order; unclosed and misplaced tags are mended as browsers mostly do."""
    root = at = Node("#root", "", None)
    articles: list[Node] = []
    pos, n = 0, len(page)
    while pos < n:
        m = _TAG.search(page, pos)
        if not m:
            at.parts.append(page[pos:])
            break
        if m.start() > pos:
            at.parts.append(page[pos:m.start()])
        pos = m.end()
        end, start = m.group(1), m.group(2) or m.group(4)
        if end:
            end = end.lower()
            up = at
            while up is not None and up.tag != end:
                up = up.parent
            if up is not None and up.parent is not None:
                at = up.parent
        elif start:
            tag, attrs = start.lower(), m.group(3) or m.group(5) or ""
            if tag in CLOSES_P:
                up = at
                while up.parent is not None and up.tag != "p" and up.tag not in GROUP_ROOT:
                    up = up.parent
                if up.tag == "p":
                    at = up.parent
            if tag in SAME_GROUP:
                up, last = at, None
                while up.parent is not None and up.tag not in GROUP_ROOT:
                    if up.tag in SAME_GROUP[tag]:
                        last = up
                    up = up.parent
                if last is not None:
                    at = last.parent
            node = Node(tag, attrs, at)
            at.parts.append(node)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, pos)
                if close:
                    node.parts.append(page[pos:close.start()])
                    pos = close.end()
                else:
                    node.parts.append(page[pos:])
                    pos = n
            elif tag not in VOID and not attrs.rstrip().endswith("/"):
                at = node
            if tag == "article":
                articles.append(node)
    _mark_replies(articles)
    return root


def _mark_replies(articles: list[Node]) -> None:
    """Mark reader comments: articles in an article with text of its own, and blocks of responses beside an article."""
    outer: dict[int, Node] = {id(x.article): x.article for x in articles if x.article is not None}
    own = {k: _own_chars(x) >= OWN_TEXT for k, x in outer.items()}
    for x in articles:
        if x.article is not None and own[id(x.article)]:
            x.reply = True
    apart = [x for x in articles if x.article is None and x.responses is None]
    for x in articles:
        block = x.responses
        if block is not None and (x.article is not None and block.article is x.article and own[id(x.article)] or apart and x.article is None):
            block.reply = True


def _own_chars(article: Node) -> int:
    """Characters of an article outside its headings, inner articles and elements that hold no text."""
    chars, todo = 0, [article]
    while todo:
        for p in todo.pop().parts:
            if isinstance(p, str):
                chars += len(_SPACE.sub("", p))
            elif p.tag != "article" and p.tag not in HEADINGS and p.tag not in SKIP:
                todo.append(p)
    return chars


def _names_responses(node: Node) -> bool:
    if not _MAY_RESPOND.search(node.attrs):
        return False
    attrs = _attributes(node)
    return any(RESPONSES.intersection(w.lower() for w in _WORD.findall(attrs.get(k, ""))) for k in ("class", "id"))


def _attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(node.attrs)} if node.attrs else {}


def _within(node: Node, tags: tuple[str, ...]) -> bool:
    up = node.parent
    while up is not None and up.tag not in tags:
        up = up.parent
    return up is not None


def skipped(node: Node) -> bool:
    """Whether a subtree is no article text by its element, role or names."""
    if node.reply:
        return True
    if node.kept:
        return False
    if node.tag == "aside" and node.article is not None and QUOTES.intersection(
            w.lower() for w in _WORD.findall(_attributes(node).get("class", ""))):
        return False
    if node.tag in SKIP:
        # a heading block inside an article belongs to it
        return node.tag != "header" or not _within(node, ARTICLE)
    if node.tag == "label" and _within(node, ("form",)):
        return True
    if not node.attrs or node.tag in ("body", "html", "article", "main"):
        return False
    attrs = _attributes(node)
    return _hidden(attrs) or bool(_naming(node, attrs)) and not (node.tag in FIGURES and node.article is not None)


def _hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")


def _naming(node: Node, attrs: dict[str, str]) -> list[tuple[str, str]]:
    """The classes, ids and roles that name something beside the article; a heading's class and id name its subject."""
    return [(k, token) for k in (("role",) if node.tag in HEADINGS else ("class", "id", "role"))
            for token in attrs.get(k, "").split() if _names_no_text(token)]


def _names_no_text(token: str) -> bool:
    """Whether one class, id or role names something beside the article."""
    words = [w.lower() for w in _WORD.findall(token)]
    found = SKIP_WORDS.intersection([*words, "".join(words)])
    if not found or TURNING.intersection(words):
        return False
    return found != {"header"} or not ARTICLE_WORDS.intersection(words)


def _names_subject(token: str) -> bool:
    """Whether all that such a class or id names may be a subject of the article."""
    words = [w.lower() for w in _WORD.findall(token)]
    return SKIP_WORDS.intersection([*words, "".join(words)]) <= SUBJECTS


def _walk(root: Node) -> list[Node]:
    """All nodes that may hold article text, parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [p for p in reversed(node.parts) if not isinstance(p, str) and not skipped(p)]
    return order


def content_node(root: Node) -> Node | None:
    """The node that holds all of the content; None without text."""
    _open_most(root)
    order = _walk(root)
    _count(order)
    body = next((x for x in order if x.tag == "body"), root)
    if not body.chars:
        return None
    share = body.link_chars / body.chars
    for node in order:
        _set_density(node, share)
    inside = [x for x in order if hasattr(x, "density")]
    for node in inside:
        node.density_sum = sum(p.density for p in node.parts if not isinstance(p, str) and hasattr(p, "density"))
        node.density_sum += node.density if any(isinstance(p, str) and p.strip() for p in node.parts) else 0.0
    best = max(inside, key=lambda x: x.density_sum)
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    content = _with_articles(_holding_all(best, path, threshold), inside, best, threshold)
    _keep_blocks(content, best, threshold, share)
    return content


def _count(order: list[Node]) -> None:
    """Characters and tags of each node, of ``order`` alone (parents first)."""
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for p in node.parts:
            if isinstance(p, str):
                node.chars += len(_SPACE.sub("", p))
            elif (p.kept or p.tag not in SKIP) and hasattr(p, "chars"):
                node.chars += p.chars
                node.tags += p.tags + 1
                node.link_chars += p.link_chars
                node.link_tags += p.link_tags + (p.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars


def _set_density(node: Node, share: float) -> None:
    c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
    if not c:
        node.density = 0.0
        return
    base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
    node.density = max(0.0, c / t * math.log(c / max(1, lc) * t / lt + 1) / base)


def _open_most(root: Node) -> None:
    """Keep forms, and blocks named by subjects, that hold more than half of the page's text."""
    order, todo, may_open = [], [root], []
    while todo:
        node = todo.pop()
        order.append(node)
        for p in node.parts:
            if isinstance(p, str):
                continue
            if skipped(p):
                if not _may_open(p):
                    continue
                may_open.append(p)
            todo.append(p)
    if not may_open:
        return
    chars: dict[int, int] = {}
    for node in reversed(order):
        chars[id(node)] = sum(len(_SPACE.sub("", p)) if isinstance(p, str) else chars.get(id(p), 0) for p in node.parts)
    body = next((x for x in order if x.tag == "body"), root)
    for node in may_open:
        node.kept = 2 * chars[id(node)] > chars[id(body)]


def _may_open(node: Node) -> bool:
    if node.tag in SKIP and node.tag != "form" or node.tag == "label" or node.reply:
        return False
    attrs = _attributes(node)
    return not _hidden(attrs) and all(k != "role" and _names_subject(token) for k, token in _naming(node, attrs))


def _keep_blocks(content: Node, best: Node, threshold: float, share: float) -> None:
    """Keep blocks inside the content that only their names would drop, if they are text and not links."""
    todo = [content]
    while todo:
        node = todo.pop()
        for p in node.parts:
            if isinstance(p, str) or p.dropped:
                continue
            if skipped(p):
                if p.tag in SKIP or p.tag == "label" or p.reply:
                    continue
                attrs = _attributes(p)
                naming = _naming(p, attrs)
                subject = all(k != "role" and _names_subject(token) for k, token in naming)
                anchor = content.tag == "article" and all(k == "id" for k, _ in naming)
                if _hidden(attrs) or not (subject or anchor):
                    continue
                order = _walk(p)
                _count(order)
                _set_density(p, share)
                if LINK_POOR * p.link_chars > p.chars or not (
                        _is_text(p, best, threshold) or anchor and p.tag not in CONTAINERS
                        or p.tag == "section" and any(x.tag in HEADINGS for x in order)):
                    continue
                p.kept = True
            todo.append(p)


def _holding_all(best: Node, path: list[Node], threshold: float) -> Node:
    own = next((x for x in path if x.tag in ARTICLE), None)
    if own is not None:
        return own
    for node, taken in zip(reversed(path[1:]), reversed(path[:-1])):
        beside = [p for p in node.parts if not isinstance(p, str) and p is not taken and hasattr(p, "density") and p.chars]
        if any(_is_text(p, best, threshold) for p in beside):
            for p in beside:
                p.dropped = 2 * p.link_chars > p.chars
            return node
    return best


def _with_articles(content: Node, inside: list[Node], best: Node, threshold: float) -> Node:
    """The node that holds the content and every further article of the page, without what lies between them."""
    if content.tag != "article":
        return content
    if content.article is not None and not content.article.dropped:  # an inner article is no page of its own
        content = content.article
    taken = [x for x in inside if x.tag == "article" and x.article is None and x is not content and x.chars
             and LINK_POOR * x.link_chars <= x.chars and _is_text(x, best, threshold) and not _teaser(x)]
    if not taken:
        return content
    taken.append(content)
    around: dict[int, int] = {}
    for x in taken:
        while x is not None:
            around[id(x)] = around.get(id(x), 0) + 1
            x = x.parent
    while around[id(content)] < len(taken):
        content = content.parent
    chosen, todo = {id(x) for x in taken}, [content]
    while todo:
        node = todo.pop()
        node.parts = [p for p in node.parts if not isinstance(p, str) and id(p) in around]
        todo += [p for p in node.parts if id(p) not in chosen]
    return content


def _teaser(article: Node) -> bool:
    """Whether a link is all of the article's first heading: the text itself is elsewhere."""
    heading = next((x for x in _walk(article) if x.tag in HEADINGS and x.chars), None)
    return heading is not None and (heading.link_chars == heading.chars or _within(heading, ("a",)))


def _is_text(node: Node, best: Node, threshold: float) -> bool:
    """Whether a branch beside the densest node is content as well."""
    if node.density >= threshold:
        return True
    return (LINK_POOR * node.link_chars <= node.chars
            and THIN * node.chars * max(1, best.tags) >= best.chars * max(1, node.tags))


def block_texts(node: Node) -> Iterator[str]:
    """Texts of the blocks under ``node``: references decoded, white space runs one space, trimmed, none empty."""
    held: list[str] = []

    def flush() -> Iterator[str]:
        text = _SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            yield text

    todo: list[Node | str | None] = list(reversed(node.parts))
    while todo:
        part = todo.pop()
        if part is None:
            yield from flush()
        elif isinstance(part, str):
            held.append(entities.unescape(part))
        elif part.tag == "br":
            held.append(" ")
        elif not part.dropped and not skipped(part):
            block = part.tag in BLOCK
            if block:
                yield from flush()
                todo.append(None)
            todo += reversed(part.parts)
    yield from flush()


def main_text(page: str) -> str:
    """Main text of one page, blocks joined by line ends; no text: empty."""
    node = content_node(tree(page))
    return "" if node is None else "\n".join(block_texts(node))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Null and empty pages give the empty text; repeated rows give repeated results; pages of any length are
    taken whole; other columns are not read; an empty table gives an empty result."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            text = [main_text(h) for h in pdf.pop("html")]
            yield pdf.assign(text=text, n_chars=[len(t) for t in text])

    kinds = dict(pages.dtypes)
    return pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html")).mapInPandas(
        run, f"page_id string, url {kinds[url_col]}, text string, n_chars bigint").withColumn(
        "page_id", F.col("page_id").cast(kinds[id_col]))
