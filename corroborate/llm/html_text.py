"""HTML extraction by composite text density (characters per tag, adjusted for links)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import map_batches, read, text_of

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes template svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of an article's text.
DROPPED = frozenset(
    "head nav footer aside form button select option input script style noscript iframe noframes template textarea svg "
    "object embed canvas audio video dialog title annotation annotation-xml".split()
)
#: Elements that authors mark as texts: the first two raise their density sum, all of them are siblings of one text.
SECTIONS = ("article", "main", "section")
#: Elements that hold a part of a text, never all of it.
PARTS = frozenset(
    "p h1 h2 h3 h4 h5 h6 header blockquote pre ul ol li dl dt dd figure figcaption address hr br a b i u s em strong small big span font code sub sup "
    "q cite mark abbr time label kbd samp var img".split()
)
#: Bounded bonuses: of the density sum of an <article> or <main>, and of the density of sibling sections.
MARKED, SIBLING = 1.25, 2.0
#: Words in the class, id or role of elements that surround an article.
AROUND = re.compile(
    r"(?:^|[\s_\-])(ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|comment-?\w*|disqus|cookies?|consent|gdpr|copyright|footer|foot|"
    r"header|masthead|menu\w*|nav\w*|navigation|newsletter|notices?|alert|popup|modal|overlay|promo\w*|related|recommend\w*|replies|reply|respond|"
    r"share|sharing|social|sidebar\w*|side|sponsor\w*|subscribe\w*|subscription|toolbar|widget\w*|login|signup|search|skip|legal|disclaimer|"
    r"complementary|contentinfo|reader-?\w*|discussion|pagination|pager|tags?|tracking)(?:$|[\s_\-])",
    re.IGNORECASE,
)
#: Of those, the ones that an <article> or <main> can be: a comment, or a pointer to another page.
BESIDE = re.compile(r"comment|repl(?:y|ies)|related|recommend|promo|sponsor|advert", re.IGNORECASE)
#: Of those, the ones that mean a discussion of the text, which can be longer than the text.
COMMENT = re.compile(r"comment|repl(?:y|ies)|disqus|discussion|respond", re.IGNORECASE)
HINTS = ("", "weak", "around", "beside", "comment")
#: Of those, the ones that are ordinary words too: inside an <article> or <main> they need a link or a form control as proof.
WEAK = frozenset("search side foot header legal disclaimer tag tags skip share sharing social tracking alert menu".split())
#: Elements that a reader fills in or presses.
CONTROLS = frozenset("form button input select textarea".split())
#: Elements whose class never makes them surroundings, and words that mean a region of a page, which a paragraph isn't.
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
REGION = re.compile(r"header|masthead|foot|footer|side|sidebar|legal|disclaimer|tags?|search", re.IGNORECASE)
#: Classes that tell what an element has, lacks or wraps.
MODIFIES = re.compile(r"(?:has|have|with|without|no|not|is|show|hide|hides)[-_]|.*[-_](?:open|opened|closed|enabled|disabled|layout)$", re.IGNORECASE)
WRAPS = re.compile(r"(.+?)[-_]?(?:wrap|wrapper|wrapping)", re.IGNORECASE)
#: Words that make a header the article's own.
WITHIN = re.compile(r"(?:^|[\s_\-])(?:article\w*|content|entry|main|post|story|text|body)(?:$|[\s_\-])", re.IGNORECASE)
#: Elements that a start tag of these kinds closes, if open, and the elements that stop the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
_P_STOPS = {"table", "td", "th", "button", "html", "body", "caption"}

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*)?|[^>=]+)*)(?:>|\Z)""", re.DOTALL)
#: An attribute and its value; a quote only opens a value right after the equals sign.
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>]+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
SPACES = re.compile(r"\s+")
#: The end tags of RAW elements: in either case, which for ASCII letters means no other letter.
_END = {tag: re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.IGNORECASE | re.ASCII) for tag in RAW}


@dataclass(slots=True)
class Node:
    """An element: its children (nodes and strings), what its class, id or role hints at, the
    characters of its own strings, and the counts of its subtree."""

    tag: str
    parent: Node | None = None
    around: bool = False
    hint: str = ""
    own: int = -1
    children: list = field(default_factory=list)
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    density_sum: float = 0.0


def _is_around(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether an element surrounds the article by its kind or is hidden; and what its class, id or
    role hints at: "" (nothing), "weak", "around", "beside" or "comment"."""
    if tag in DROPPED:
        return True, ""
    if not attributes or tag in ("html", "body"):
        return False, ""
    hint = ""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), m.group(2) or ""
        value = value[1:].removesuffix(value[0]) if value[:1] in ("'", '"') else value
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return True, ""
        if name in ("class", "id", "role") and tag not in HEADINGS and AROUND.search(value):
            value = " ".join(w for w in value.split() if not _modifies(w) and not (tag == "p" and REGION.fullmatch(w)))
            found = AROUND.search(value)
            if tag in ("article", "main") and not BESIDE.search(value):
                continue
            if found and (tag in ("article", "main") or not (found.group(1).lower() == "header" and WITHIN.search(value))):
                weak = all(w.lower() in WEAK for w in AROUND.findall(value))
                this = "comment" if COMMENT.search(value) else "beside" if BESIDE.search(value) else "weak" if weak else "around"
                hint = max(hint, this, key=HINTS.index)
    return False, hint


def _modifies(word: str) -> bool:
    """Whether a class says what an element has or wraps, not what it is; sidebar-wrap is still a sidebar."""
    if wraps := WRAPS.fullmatch(word):
        return not AROUND.fullmatch(wraps.group(1)) and not MODIFIES.match(wraps.group(1)) or bool(MODIFIES.match(word))
    return bool(MODIFIES.match(word))


def parse(html: str) -> Node:
    """The DOM as far as extraction needs it; never fails: unclosed and stray tags are tolerated."""
    root = Node("html")
    now, at = root, 0
    opened: Counter[str] = Counter()  # so that a deep page isn't searched for what it doesn't have

    def close_to(node: Node) -> None:
        nonlocal now
        while now is not node:
            opened[now.tag] -= 1
            now = now.parent
        opened[node.tag] -= 1
        now = node.parent or root

    def open_element(names: set[str], stops: set[str]) -> Node | None:
        if not any(opened[x] for x in names):
            return None
        n = now
        while n is not root and n.tag not in stops:
            if n.tag in names:
                return n
            n = n.parent
        return None

    for m in iter(lambda: _TOKEN.search(html, at), None):
        if m.start() > at:
            now.children.append(html[at : m.start()])
        at = m.end()
        if m.end() == m.start():
            at += 1
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        if m.group(1):  # an end tag closes the nearest open element of its name
            if tag == "br":
                now.children.append(Node("br", now))
            elif n := open_element({tag}, {"td", "th"} if tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "table", "body", "html", "article", "main", "div", "section") else set()):
                close_to(n)
            continue
        if tag in ("html", "body"):
            if tag == "body" and (n := open_element({"head"}, set())):
                close_to(n)
            continue
        if tag in BLOCKS and (n := open_element({"p"}, _P_STOPS)):
            close_to(n)  # a block ends an open paragraph and what is open inside it
        if tag in CLOSES and (n := open_element(*CLOSES[tag])):
            close_to(n)
        if tag in BLOCKS and tag != "p" and (n := open_element({"head"}, set())):
            close_to(n)
        if tag[:1] == "h" and tag[1:].isdigit() and now.tag[:1] == "h" and now.tag[1:].isdigit():
            close_to(now)
        attributes = m.group(3)
        inside = tag in ("header", "menu") and open_element({"article", "main"}, set()) is not None
        around, hint = _is_around(tag, attributes)
        hint = "weak" if tag == "menu" and inside and not hint else hint  # an article's list, unless of links or buttons
        node = Node(tag, now, around or tag in ("header", "menu") and not inside, hint)
        now.children.append(node)
        if tag in VOID or attributes.endswith("/") and tag in RAW:
            continue
        if tag in RAW:  # its content is text up to its own end tag
            ended = _END[tag].search(html, at)
            end = ended.start() if ended else len(html)
            close = html.find(">", end)
            node.children.append(html[at:end])
            at = len(html) if close < 0 else close + 1
            continue
        opened[tag] += 1
        now = node
    if at < len(html):
        now.children.append(html[at:])
    _settle(root)
    return root


def _walk(root: Node) -> list[Node]:
    """All nodes, parents first, without what surrounds the article."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node) and not c.around)
    return out


def _count(nodes: list[Node]) -> None:
    """The characters, tags and link counts of the subtrees of nodes, which come parents first."""
    for n in nodes:
        if n.own < 0:
            n.own = sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        n.chars, n.tags, n.link_chars, n.link_tags = n.own, 0, 0, 0
    for n in reversed(nodes):
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
        if n.parent is not None:
            p = n.parent
            p.chars += n.chars
            p.tags += n.tags + 1
            p.link_chars += n.link_chars
            p.link_tags += n.link_tags


def _settle(root: Node) -> None:
    """Decide which of the elements with a hint surround the article.

    The words are evidence, not proof: an element goes if it holds at most half of the page's text,
    or more link text than other text, and no <article> or <main> without a hint; never if it holds
    all of the page's text. Ordinary words (WEAK) mean nothing inside an <article> or <main> without
    a link or control. Two kinds go further. Of elements beside the text, such as lists of
    related pages, <article>s don't protect if a larger one stands elsewhere. Discussions also go
    when they are longer than the text: with an <article> outside, or up to nine tenths of the page.
    """
    for kinds in (HINTS[4:], HINTS[1:4]):  # what is left of the page without its discussion counts for the rest
        nodes = _walk(root)
        if not any(n.hint in kinds for n in nodes if n.hint):
            continue
        _count(nodes)
        at = {id(n): i for i, n in enumerate(nodes)}
        size = [1] * len(nodes)
        inner = [0] * len(nodes)  # characters of the largest marked element inside, without what goes
        enclosed = [0] * len(nodes)  # characters of the largest <article> around
        held = [False] * len(nodes)  # whether an <article> or <main> is around
        for i, n in enumerate(nodes[1:], 1):
            p = n.parent
            held[i] = held[at[id(p)]] or p.tag in SECTIONS[:2] and not p.hint
            enclosed[i] = max(enclosed[at[id(p)]], p.chars if p.tag == "article" and not p.hint else 0)
        for i in range(len(nodes) - 1, 0, -1):
            size[at[id(nodes[i].parent)]] += size[i]
        marked = sorted((i for i, n in enumerate(nodes) if n.tag in SECTIONS[:2] and not n.hint and n.chars), key=lambda i: -nodes[i].chars)
        for i in range(len(nodes) - 1, 0, -1):
            n = nodes[i]
            if n.hint in kinds:
                apart = next((m for m in marked if not m < i < m + size[m]), None)  # the largest that isn't around n
                outside = apart is not None and not i < apart < i + size[i]
                proven = n.hint != "weak" or not held[i] or _has_controls(n)
                n.around = proven and _goes(n, root.chars, inner[i], outside, enclosed[i] > n.chars)
            if not n.around:
                p = at[id(n.parent)]
                inner[p] = max(inner[p], inner[i], n.chars if n.tag in SECTIONS[:2] and not n.hint else 0)


def _has_controls(n: Node) -> bool:
    """Whether an element has a link or something to fill in or press."""
    stack = [n]
    while stack:
        x = stack.pop()
        if x.tag == "a" or x.tag in CONTROLS:
            return True
        stack.extend(c for c in x.children if isinstance(c, Node))
    return False


def _goes(n: Node, total: int, inner: int, outside: bool, enclosed: bool) -> bool:
    """Whether an element with a hint surrounds the article. inner: characters of the largest marked
    element in it; outside: whether a larger one stands apart; enclosed: whether it is in an <article> with more text."""
    if n.chars == total:
        return False
    if inner and (n.hint in ("weak", "around") or not outside and not enclosed):
        return False
    if n.hint == "comment" and (outside or enclosed or n.chars * 10 <= total * 9):
        return True
    return n.chars * 2 <= total or n.link_chars * 2 > n.chars


def _adjusted(c: int, t: int, lc: int, lt: int, body: float) -> float:
    """What the links of c characters and t tags leave of their density."""
    base = math.log(c / max(c - lc, 1) * lc + body * c + math.e)
    ratio = c / max(lc, 1) * t / lt
    return math.log(max(ratio, 1.0)) / math.log(base) if base > 1 else math.log(max(ratio, 1.0))


def measure(root: Node) -> list[Node]:
    """Composite text density of every node, and the sum of its children's."""
    nodes = _walk(root)
    _count(nodes)
    body = root.link_chars / max(root.chars, 1)
    for n in nodes:
        if n.chars:
            t = max(n.tags, 1)
            n.density = n.chars / t * _adjusted(n.chars, t, n.link_chars, max(n.link_tags, 1), body)
    for n in nodes:
        n.density_sum = sum(c.density for c in n.children if isinstance(c, Node) and not c.around)
        # a node's own words count as a child without tags
        n.density_sum += n.own if n.tag == "a" else n.own * _adjusted(n.own, 1, 0, 1, body)
    return nodes


def main_nodes(root: Node) -> list[Node]:
    """The subtree with the largest density sum, or the siblings over which its text is spread.

    An <article> or <main> has its sum raised by MARKED. One that encloses the subtree is taken in
    its place if the densities confirm it: the subtree is half of its text at least, or it isn't
    much sparser than the page. The threshold is the least density on the path from the body to
    the subtree. Where siblings reach it, the parent is taken; of a marked element the siblings
    that reach it, <article>s with a density raised by SIBLING, and the headings before them.
    """
    nodes = measure(root)
    best = max(nodes, key=lambda n: (n.density_sum * (MARKED if n.tag in SECTIONS[:2] else 1), n.tag in SECTIONS[:2]))
    while best.tag in PARTS and best.parent is not None:  # a paragraph is never all of an article
        best = best.parent
    best = _confirmed(_narrowed(best), root)
    if best.tag == "main":  # one article in a main: what stands beside it there is not part of it
        inner = [n for n in nodes if n.tag == "article" and _inside(n, best)]
        if len(inner) == 1 and inner[0].chars * 2 > best.chars:
            best = inner[0]
    threshold = min(n.density for n in _path(best))
    marked = best.tag in SECTIONS[:2]
    while best.parent is not None:
        beside = [c for c in best.parent.children if isinstance(c, Node) and not c.around and c.chars and c is not best]
        also = [c for c in beside if c.link_chars * 2 < c.chars and _reaches(c, best, threshold, marked)]
        if also and marked:
            return _with_headings(best.parent, [best, *also])
        if not also and best.parent.chars > best.chars:
            break
        best = best.parent  # the siblings belong to it, or it has no other text
    return [best]


def _reaches(c: Node, best: Node, threshold: float, marked: bool) -> bool:
    """Whether a sibling of the main node is dense enough to be a part of the same text."""
    if _sectioned(c) and (marked or c.tag == best.tag):
        return c.density * SIBLING >= threshold
    return c.density >= threshold and (not marked or c.chars * 2 >= best.chars)


def _sectioned(n: Node) -> bool:
    """Whether n is an <article>, <main> or <section>, or has no text but that of one."""
    while n.tag not in SECTIONS:
        inner = [c for c in n.children if isinstance(c, Node) and not c.around and c.chars]
        if len(inner) != 1 or inner[0].chars < n.chars:
            return False
        n = inner[0]
    return True


def _with_headings(parent: Node, chosen: list[Node]) -> list[Node]:
    """The chosen children in page order, each after the headings that stand right before it."""
    out, waiting, ids = [], [], {id(c) for c in chosen}
    for c in parent.children:
        if isinstance(c, str) or c.around or not c.chars:
            continue
        if id(c) in ids:
            out += [*waiting, c]
            waiting = []
        elif c.tag[:1] == "h" and c.tag[1:].isdigit() and c.link_chars * 2 < c.chars:
            waiting.append(c)
        else:
            waiting = []
    return out


def _narrowed(best: Node) -> Node:
    """Descend to a container with most of the text, while what stands beside it are only sparser
    containers of another kind: a single child has its parent's density, so that sums don't tell."""
    while True:
        inner = [c for c in best.children if isinstance(c, Node) and not c.around and c.chars]
        if not inner:
            return best
        most = max(inner, key=lambda c: c.chars)
        beside = [c for c in inner if c is not most]
        alone = sum(c.chars for c in inner) == best.chars  # no words of its own
        if most.tag in PARTS or not beside or not alone or most.chars * 4 < best.chars * 3 or best.tag in SECTIONS[:2]:
            return best
        threshold = min(most.density, *(n.density for n in _path(best)))
        if any(c.tag in PARTS or c.tag == most.tag or c.density >= threshold and c.link_chars * 2 < c.chars for c in beside):
            return best
        best = most


def _confirmed(best: Node, root: Node) -> Node:
    """The nearest <article> or <main> around the node if the densities confirm it, or else the node."""
    for n in _path(best):
        if n.tag in SECTIONS[:2]:
            return n if best.chars * 2 >= n.chars or n.density * SIBLING >= root.density else best
    return best


def _path(n: Node | None) -> Iterator[Node]:
    """The node and all around it."""
    while n is not None:
        yield n
        n = n.parent


def _inside(n: Node, outer: Node) -> bool:
    while n is not None:
        if n is outer:
            return True
        n = n.parent
    return False


def blocks(node: Node) -> list[str]:
    """The texts of a subtree's blocks in page order, references decoded, white space in one piece."""
    found: list[str] = []
    now: list[str] = []

    def end() -> None:
        text = SPACES.sub(" ", unescape("".join(now))).strip()
        if text:
            found.append(text)
        now.clear()

    stack: list = [(node, iter(node.children))]
    while stack:
        n, rest = stack[-1]
        for c in rest:
            if isinstance(c, str):
                now.append(c)
            elif c.around:
                if c.tag in BLOCKS:
                    end()
            elif c.tag == "br":
                now.append(" ")
            else:
                if c.tag in BLOCKS:
                    end()
                stack.append((c, iter(c.children)))
                break
        else:
            stack.pop()
            if n.tag in BLOCKS:
                end()
    end()
    return found


def main_text(html: str) -> str:
    """The article's blocks, joined by line feeds; empty if there are none."""
    return "\n".join(b for n in main_nodes(parse(html)) for b in blocks(n)) if html else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, *keep, text) for each row: the main text of the whole page.

    Each page is parsed where it is read, without a shuffle. Every element gets its composite text
    density: characters per tag, lowered by the share of characters and tags in links. Elements
    that surround an article by kind, class, id or role (menus, headers, footers, sidebars,
    notices, adverts, forms, comments, scripts, styles) are left out of all counts; a class, id or
    role is evidence that the element's share of the text must bear out (see _settle). The main node
    is the marked article, or else the subtree with the largest sum of its children's densities,
    widened to siblings above the body-path threshold.

    Null, empty or tag-only html gives an empty text. Of equal densities the first in page order
    wins. Repeated rows are extracted each; other columns are not read; an empty table gives an
    empty result.
    """
    whole = [pages.schema[c] for c in (id_col, *keep)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.columns[-1].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "text"])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in whole), "text string"])
    return map_batches(pages.select(id_col, *keep, text_of(html_col).alias("_html")), each, kinds)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
