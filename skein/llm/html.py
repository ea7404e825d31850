"""Main text of web pages by tag-path ratios.

Every block of text has a root-to-leaf tag path. Text length, punctuation and link text are added up per path; the ratios of
text and of punctuation to the path's nodes are smoothed over the paths in page order, fused by their geometric mean and
weighted by the share of text that isn't links and by priors: little is expected of menus, adverts, forms and the like, and of what
stands outside a marked article. The ratios are then smoothed over the page's tree, where the paths of one article share their mean,
and so do, where none is marked, the paths of much text and the short headings, items and cells beside them. Paths within a share
of the best ratio are the content nodes. Blocks of these paths, in page order, are the main text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without an end tag, elements that hold no page text, elements that stand inside a line,
# and which open element a start tag ends where its end tag was left out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title textarea select option svg iframe object canvas audio video annotation annotation-xml".split())
MATH = frozenset("annotation annotation-xml math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")),
    "option": frozenset(("option",)), "thead": frozenset(("tr", "td", "th")), "tbody": frozenset(("thead", "tbody", "tr", "td", "th")), "tfoot": frozenset(("tbody", "tr", "td", "th")),
}
ENDS_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that aren't the article.
ASIDE = frozenset("nav header footer aside menu dialog".split())
#: Class, id or role tokens that name boilerplate as a whole; an article's own parts have compound names, such as entry-header.
BOILERPLATE = frozenset(
    (
        "ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer cookie cookies consent notice notices popup modal newsletter subscribe signup login "
        "share sharing social related recommended comment comments commentlist reply replies respond discussion disqus pagination pager search skip hidden contentinfo complementary "
        "ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper banner-ad google-ad sponsored-content sponsored-links promo-box nav-links nav-menu post-navigation sidebar-widget site-header site-footer page-footer site-nav skip-link skip-links "
        "cookie-banner cookie-bar cookie-consent cookie-notice newsletter-form newsletter-signup share-bar share-buttons share-links sharing-buttons social-buttons social-icons social-links social-media social-share "
        "related-articles related-content related-links related-posts related-stories recommended-articles recommended-posts comment-form comment-list comment-respond comments-area comments-section disqus-thread search-box search-form"
    ).split()
)
#: Names of menus: they name one where most of its text is links, and else a list like others.
MENUS = frozenset("menu nav navbar navigation nav-menu nav-links pager pagination".split())
FORMS = frozenset(("form", "fieldset"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
SPACES = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？«»“”]")


#: Elements of content that may be short: beside content nodes they belong to them.
PARTS = HEADINGS | frozenset("p li dt dd td th caption figcaption blockquote pre summary".split())
#: Steps of a path that end an open p, or hide open list items and cells from a start tag.
_P_BARRIER = (ENDS_P - {"p"}) | {"td", "th", "li"}
_LISTS = frozenset("ul ol dl table select".split())


@dataclass(frozen=True)
class Settings:
    """`threshold` is the share of the best smoothed ratio that a path must reach; `smooth` neighbours on each side count. `prior` weighs
    asides, forms and paths outside a marked article, and is the least weight of links. Where no article is marked, paths of `much` of the mean
    ratio are content, and lists of which `link_share` or more is links aren't parts of it; so much of a menu is links."""

    threshold: float = 0.8
    smooth: int = 1
    prior: float = 0.02
    much: float = 0.3
    link_share: float = 0.6


@dataclass
class Path:
    """A step of the tree of paths, with the sums over the blocks that stand right under it."""

    parent: int
    tag: str
    aside: bool
    mark: str = ""  # article or main, if the path lies in one
    form: bool = False
    menu: bool = False  # a menu by its name
    nodes: int = 0
    chars: int = 0
    marks: int = 0
    linked: int = 0


@dataclass
class _Frame:
    tag: str
    path: int
    block: bool
    silent: bool
    heading: bool


_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: What follows a tag's name, to the `>` that no quoted value holds; and one attribute. Neither goes back over what it read.
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style", "title", "textarea")}


def attributes(rest: str) -> list[tuple[str, str]]:
    return [(m[1].lower(), entities.unescape(next((v for v in m.group(2, 3, 4) if v is not None), ""))) for m in _ATTRIBUTE.finditer(rest)]


class Blocks:
    """Blocks of text with the path that each stands under; markup that isn't closed, or not opened, is taken as browsers do.

    Paths are numbers, parents before children, and open elements are found by tag, so time and memory follow the page's
    size however deep it nests. What is looked for and missing once (the end of a comment, of a quoted value, of a script) is not looked for
    again: such constructs end with the page, or are read as if they weren't there.
    """

    def __init__(self) -> None:
        self.paths = [Path(-1, "", False)]
        self.known: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str]] = []
        self.stack = [_Frame("", 0, True, False, False)]
        self.open: dict[str, list[int]] = {"#block": [0]}  # places in the stack of each tag, and of kinds of tags
        self.part: list[str] = []
        self.part_linked = self.part_control = self.part_own = 0

    def feed(self, page: str) -> None:
        at, quotes, unclosed = 0, True, set()
        while at < len(page):
            here = page.find("<", at)
            if here < 0 or here > at:
                self.handle_data(entities.unescape(page[at : here if here >= 0 else len(page)]))
                if here < 0:
                    return
            name = _NAME.match(page, here + 1)
            if name:
                tag, end = name[0].lower(), -1
                rest = _REST.match(page, name.end()) if quotes else None
                if rest:
                    end = rest.end() - 1
                else:
                    quotes, end = False, page.find(">", name.end())
                if end < 0:
                    return
                found = attributes(page[name.end() : end]) if end > name.end() else []
                self.handle_starttag(tag, found)
                if page[end - 1] == "/" and (tag in MATH or tag in ("svg", "path")):
                    self.handle_endtag(tag)
                at = end + 1
                if tag in _RAW and tag not in unclosed:
                    close = _RAW[tag].search(page, at)
                    if close:
                        at = close.start()
                    elif tag in ("script", "style"):
                        return
                    else:
                        unclosed.add(tag)
            elif page.startswith("</", here) and (name := _NAME.match(page, here + 2)):
                end = page.find(">", name.end())
                if end < 0:
                    return
                self.handle_endtag(name[0].lower())
                at = end + 1
            elif page.startswith(("<!", "<?", "</"), here):
                mark = "-->" if page.startswith("<!--", here) else ">"
                end = page.find(mark, here + 2)
                if end < 0:
                    return
                at = end + len(mark)
            else:
                self.handle_data("<")
                at = here + 1

    @staticmethod
    def _kinds(frame: _Frame) -> list[str]:
        return [frame.tag, *["#block"] * frame.block, *["#barrier"] * (frame.tag in _P_BARRIER), *["#list"] * (frame.tag in _LISTS)]

    def _last(self, tag: str) -> int:
        at = self.open.get(tag)
        return at[-1] if at else -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag == "br" or tag == "hr":
                self._end_block()
            return
        if tag == "body" or tag == "html":
            if self._last("head") >= 0:
                self._pop_to(self._last("head"))
            return  # a second body or html opens nothing
        if tag in ENDS_P and self._last("p") > self._last("#barrier"):
            self._pop_to(self._last("p"))
        if tag in CLOSED_BY:
            while (k := max(map(self._last, CLOSED_BY[tag]))) > self._last("#list"):
                self._pop_to(k)
        top = self.stack[-1]
        path = self.paths[top.path]
        names = [(a, v) for a, v in attrs if v and a in ("class", "id", "role")]
        unseen = any(a in ("hidden", "aria-hidden") and v != "false" for a, v in attrs)
        own = unseen and tag not in ("article", "main")
        own = own or (tag in ASIDE and not (tag == "header" and (path.mark or tag == "article")))  # an article's own header holds its title
        own = own or _named_aside(tag, names, bool(path.mark), top.heading)
        own = own or (tag == "article" and path.mark == "article")  # an article in an article is a comment on it, or another
        menu = not own and tag not in ("html", "body", "article", "main") and any(t in MENUS for a, v in names if a != "id" for t in _tokens(v))
        form = tag in FORMS or (path.form and tag not in ("article", "main"))
        block = tag not in INLINE or own  # an advert or notice in a line is a block of its own
        number = top.path
        if block:
            self._end_block()
            step = tag + "".join(f".{v}" for _, v in names) + " hidden" * unseen
            number = self.known.get((top.path, step), -1)
            if number < 0:
                number = self.known[top.path, step] = len(self.paths)
                mark = path.mark if path.mark == "article" or tag not in ("article", "main") else tag
                self.paths.append(Path(top.path, tag, path.aside or own, mark, form, path.menu or menu))
        frame = _Frame(tag, number, block, top.silent or tag in SILENT, top.heading or tag in HEADINGS)
        for kind in self._kinds(frame):
            self.open.setdefault(kind, []).append(len(self.stack))
        self.stack.append(frame)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        k = self._last(tag)
        if tag == "br" or (tag == "p" and k < 0):
            self._end_block()
        elif k > 0 and not (tag in INLINE and self._last("#block") > k):  # an inline end tag doesn't close blocks
            self._pop_to(k)

    def _pop_to(self, k: int) -> None:
        if self._last("#block") >= k:
            self._end_block()
        while len(self.stack) > k:
            for kind in self._kinds(self.stack.pop()):
                self.open[kind].pop()

    def handle_data(self, data: str) -> None:
        if self.stack[-1].silent:
            return
        self.part.append(data)
        size = len(data.strip())
        self.part_own += size
        if self.open.get("a"):
            self.part_linked += size
        if self.open.get("button") or self.open.get("label"):
            self.part_control += size

    def _end_block(self) -> None:
        if not self.part:
            return
        text = SPACES.sub(" ", "".join(self.part)).strip()
        linked, control = self.part_linked, self.part_control == self.part_own
        self.part, self.part_linked, self.part_control, self.part_own = [], 0, 0, 0
        if not text or control:  # a button or label in a sentence is its words, but one alone is no text
            return
        number = self.stack[self._last("#block")].path
        path = self.paths[number]
        path.nodes += 1
        path.chars += len(text)
        path.marks += len(PUNCTUATION.findall(text))
        path.linked += min(linked, len(text))
        self.blocks.append((number, text))

    def close(self) -> None:
        self._end_block()


def _tokens(value: str) -> list[str]:
    return value.lower().replace("_", "-").split()


def _names_boilerplate(token: str) -> bool:
    return (token in BOILERPLATE and token not in MENUS) or token.endswith(("-comment", "-comments", "-reply", "-replies"))


def _named_aside(tag: str, names: list[tuple[str, str]], inside: bool, in_heading: bool) -> bool:
    """Whether an element's class, id and role (attribute, value) name it as not of the article. Inside one, headings and headers
    never are, and ids of sections, links and what stands in headings are targets of links."""
    if tag in ("html", "body", "main") or (tag == "article" and not inside and not any(_names_boilerplate(t) for _, v in names for t in _tokens(v))) or (inside and (in_heading or tag in HEADINGS or tag == "header")):
        return False
    target = inside and tag in ("section", "a")
    return any(_names_boilerplate(t) for a, v in names if not (target and a == "id") for t in _tokens(v))


def smoothed(values: np.ndarray, reach: int) -> np.ndarray:
    """Mean of each value and `reach` neighbours on each side."""
    if reach < 1 or len(values) < 2:
        return values
    total = np.concatenate([[0.0], np.cumsum(values)])
    at = np.arange(len(values))
    lo, hi = np.maximum(at - reach, 0), np.minimum(at + reach + 1, len(values))
    return (total[hi] - total[lo]) / (hi - lo)


def path_ratios(paths: list[Path], order: list[int], settings: Settings) -> np.ndarray:
    """The ratio of each path in `order`, as they come in the page: the geometric mean of text and punctuation per node, by themselves
    and smoothed, times the share that isn't links."""
    own = [paths[k] for k in order]
    text = np.array([p.chars / p.nodes for p in own])
    marks = np.array([(p.marks + 0.5) / p.nodes for p in own])
    fused = (text * marks * smoothed(text, settings.smooth) * smoothed(marks, settings.smooth)) ** 0.25
    return fused * np.maximum([1 - p.linked / p.chars for p in own], settings.prior)


def _beside(paths: list[Path], order: list[int], nodes: np.ndarray, settings: Settings) -> np.ndarray:
    """Which paths in `order` are parts of content that stand under the parent of a content node, and in no list of links."""
    # text and links of each path with all below it; parents have lower numbers
    chars, linked = np.array([p.chars for p in paths]), np.array([p.linked for p in paths])
    under = np.zeros(len(paths), bool)  # under the parent of a content node
    under[[max(paths[order[i]].parent, 0) for i in np.flatnonzero(nodes)]] = True
    for k in range(len(paths) - 1, 0, -1):
        chars[paths[k].parent] += chars[k]
        linked[paths[k].parent] += linked[k]
    listed = np.zeros(len(paths), bool)
    for k in range(1, len(paths)):
        up = paths[k].parent
        listed[k] = listed[up] or (under[up] and linked[k] >= settings.link_share * max(chars[k], 1))
        under[k] |= under[up]
    return np.array([bool(under[paths[k].parent]) and not listed[k] and paths[k].tag in PARTS for k in order])


def fused_ratios(paths: list[Path], order: list[int], settings: Settings) -> np.ndarray:
    """The ratios of the paths in `order`, weighted by priors and smoothed over the tree.

    The paths of the marked article but its asides share their mean ratio, and what stands outside has a prior; a path outside that is
    better all the same shows that the article isn't the page's, and then no article counts. Without an article the paths of much text, and the
    parts of content beside them, share the mean ratio of the former.
    """
    own = [paths[k] for k in order]
    chars = np.array([p.chars for p in own], float)
    ratio = path_ratios(paths, order, settings)
    linked: dict[bool, float] = {m: sum(p.linked for p in own if p.menu == m) / max(1, sum(p.chars for p in own if p.menu == m)) for m in (True, False)}
    aside = np.array([p.aside or (p.menu and linked[True] >= settings.link_share) for p in own])
    form = np.array([p.form for p in own])
    if 2 * chars[form & ~aside].sum() > chars[~aside].sum():
        form[:] = False  # a form around the page is none of its parts
    low = aside | form
    weighted = ratio * np.where(aside, settings.prior, 1.0) * np.where(form, settings.prior, 1.0)
    mean = lambda mask, values: float((values * chars)[mask].sum() / chars[mask].sum())
    for mark in ("article", "main"):
        inside = np.array([p.mark == mark for p in own])
        if not (inside & ~low).any():
            continue
        out = np.where(inside, weighted, weighted * settings.prior)
        shared = mean(inside & ~low, ratio)
        if shared >= out[~inside].max(initial=0.0):
            out[inside & ~low] = shared
            return out
    nodes = ~low & (weighted >= settings.much * mean(np.ones(len(own), bool), weighted))
    if not nodes.any():
        return weighted
    weighted[nodes | (_beside(paths, order, nodes, settings) & ~low)] = mean(nodes, weighted)
    return weighted


def content_paths(paths: list[Path], order: list[int], settings: Settings) -> set[int]:
    """Content nodes: the paths whose fused ratio is within the threshold's share of the best."""
    if not order:
        return set()
    fused = fused_ratios(paths, order, settings)
    return {k for k, f in zip(order, fused) if f >= settings.threshold * fused.max()}


def main_text(page: str | None, settings: Settings = Settings()) -> str:
    """The article of a page; empty if there is none. Markup of any kind is read, never rejected."""
    if not page:
        return ""
    parser = Blocks()
    parser.feed(page)
    parser.close()
    good = content_paths(parser.paths, list(dict.fromkeys(k for k, _ in parser.blocks)), settings)
    return " ".join(text for k, text in parser.blocks if k in good)


def extract_pages(pages: DataFrame, settings: Settings | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row of `pages`, in no order.

    Null or empty html, and pages without an article, give an empty text; null ids and urls stay null; repeated
    rows give a row each; an empty table gives none. Pages are read whole, however long.
    """
    settings = settings or Settings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), settings) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    named = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    return named.mapInArrow(run, f"page_id {kinds[page_id]}, url {kinds[url]}, text string, n_chars long")
