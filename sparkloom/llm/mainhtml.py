"""Main text of web pages by composite text density.

Every node gets its characters per tag, adjusted for links, and the sum of its
children's densities. The node with the largest sum, and the least density on
the path from body to it as a threshold, tell which subtrees are content. Names
(menu, footer, an advert's class, article ...) only add to this: text under a
name that speaks against it counts for less in the densities, unless the part
holds the article or most of the text, and such parts are left out of a
content subtree; an article element around chosen text is taken whole if most
of it is no link.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import fold, lean

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|=(?!\s*[\"'])|[^>=])*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")
_NAME = re.compile(r"[a-z0-9]+")

# Fixed names of elements, from the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - frozenset("body html caption tbody td tfoot th thead tr legend option optgroup".split())
#: Elements that a new element of the kind ends, and the elements that such a search stays inside.
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup")}
_SCOPE = frozenset("ul ol dl table select html body article section div aside nav main td th".split())
#: The elements that such a search looks at.
_STOPS = _SCOPE | {"p"} | {x for ended in _SAME.values() for x in ended}
#: Elements that show no text of the page, or a form's controls.
_DROP_TAG = frozenset("button select datalist input textarea script style noscript noembed noframes template iframe object embed svg canvas audio video head title xmp".split())
# Names by which parts of a page say that they aren't its article.
_OTHER_TAG = frozenset("nav footer aside dialog menu form".split())
_OTHER_NAME = frozenset(
    "ad ads advert adverts advertisement adsense adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe sidebar aside widget widgets related recommended share sharing social breadcrumb breadcrumbs menu menubar nav navbar navigation footer comment comments disqus respond replies login signup pagination pager".split()
)
_OTHER_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words that make a name tell of a state (has-sidebar, no-share) or of a frame around something (sidebar-wrap).
_STATE = frozenset("has no with without is not open enabled disabled wrap wrapper container layout page".split())
#: Names of parts whose own articles aren't the page's if another article stands outside.
_OTHERS = frozenset("comment comments disqus respond replies related recommended".split())


#: What a character counts for under a name that speaks against it, and outside the article elements of a page that has some.
NAMED, OUTSIDE = 1 / 32, 1 / 4


class Node:
    __slots__ = ("chars", "density", "kids", "link_chars", "link_tags", "named", "near", "other", "parent", "parts", "plain", "tag", "tags", "total", "under", "weight")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.parts, self.kids = tag, parent, [], []
        self.under = tag in ("article", "main") or bool(parent and parent.under)
        self.near: Node | None = self if tag in _STOPS else parent and parent.near  # itself or the nearest node around it that ends a search
        self.named: set | None = None  # the words that name the node something else
        self.other, self.weight = False, 1.0


def unwanted(tag: str, attributes: str) -> bool:
    """Whether a node is dropped whatever it holds, as it isn't shown."""
    if tag in _DROP_TAG:
        return True
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or m[5]).lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return tag not in ("html", "body")
    return False


def named(tag: str, attributes: str, inside: bool) -> set | None:
    """The words by which a node calls itself something else; null without one."""
    if tag in ("html", "body", "article", "main"):
        return None
    words = {tag} if tag in _OTHER_TAG or tag == "header" and not inside else set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or m[5]).lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            for one in value.split():
                parts = _NAME.findall(one)
                if not _STATE.intersection(parts):
                    words |= _OTHER_NAME.intersection(parts)
        elif name == "role" and value in _OTHER_ROLE:
            words.add(value)
    return words or None


def weigh(root: Node, names: bool = True) -> list[Node]:
    """What a character of each node counts for; the nodes, children first. Without ``names`` all count alike.

    A named part keeps its weight if it holds an article or main element, or most of the text outside links
    (of its article, or of a page without one), but for comments and related articles beside an article.
    """
    order = postorder(root)
    landmark: dict[int, bool] = {}
    for n in order:
        own = sum(len("".join(p.split())) for p in n.parts if p.__class__ is str)
        n.plain = 0 if n.tag == "a" else own + sum(k.plain for k in n.kids)
        landmark[id(n)] = n.tag in ("article", "main") and n.plain > 0 or any(landmark[id(k)] for k in n.kids)
    if not names:
        return order
    post = main = False
    todo = [root]
    while todo:
        n = todo.pop()
        post = post or n.tag == "article" and n.plain > 0
        main = main or n.tag == "main" and n.plain > 0
        todo += [k for k in n.kids if not k.named]
    half = root.plain / 2
    for n in reversed(order):  # parents first
        n.weight = n.parent.weight if n.parent else OUTSIDE if post or main else 1.0
        if n.tag == "article" and post or n.tag == "main" and not post and main:
            n.weight = max(n.weight, 1.0) if not n.other else n.weight
        n.other = bool(n.parent and n.parent.other)
        if n.named:
            most = n.plain > half and (n.under or not (post or main))
            if not (landmark[id(n)] or most) or post and n.named & _OTHERS:
                n.weight *= NAMED
                n.other = True
        elif n.other and n.tag in ("article", "main"):
            n.weight = n.parent.weight
    return order


def parse(page: str) -> Node:
    """Tree of the wanted nodes; text stands in ``parts`` between the children, in page order.

    The time is linear in the page, whatever its tags: open elements are counted by name, so an end tag without a partner costs
    nothing, and each element is left once.
    """
    root = node = Node("#root", None)
    opened: Counter = Counter()  # names of the nodes around the place, itself included
    skipped: list[str] = []  # open elements inside an unwanted one
    inside: Counter = Counter()  # their names
    at, for_end = 0, {}

    def leave(to: Node) -> Node:
        nonlocal node
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent
        return node

    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not skipped:
            node.parts.append(html.unescape(text) if "&" in text else text)
        if not m:
            return root
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if skipped:
                if inside[tag]:
                    while True:
                        last = skipped.pop()
                        inside[last] -= 1
                        if last == tag:
                            break
                    continue
                if tag not in ("body", "html", "article", "main"):
                    continue
                skipped.clear()  # the element around the unwanted one ends
                inside.clear()
            if tag in ("body", "html"):
                continue  # what follows still belongs to the body
            if opened[tag]:
                while node.tag != tag:
                    leave(node.parent)
                leave(node.parent)
            continue
        void = tag in _VOID or m[3].rstrip().endswith("/") and tag not in _BLOCK
        if skipped:
            if tag in _RAW:
                at = raw_end(page, tag, at, for_end)
            elif not void and not ends(skipped, tag):
                skipped.append(tag)
                inside[tag] += 1
            continue
        if tag in _ENDS_P or tag in _SAME:
            ended = ("p",) if tag not in _SAME else _SAME[tag]
            up, last = node.near, None
            while up and (up.tag not in _SCOPE or up.tag in ended):
                if up.tag in ended:
                    last = up
                    if tag not in ("tr", "optgroup"):
                        break
                up = up.parent.near
            if last:
                leave(last.parent)
        if tag in ("html", "body") and opened[tag]:
            continue
        if tag == "body":
            while node.tag not in ("html", "#root"):
                leave(node.parent)
        drop = unwanted(tag, m[3])
        if tag in _RAW:
            end = raw_end(page, tag, at, for_end)
            if not drop:
                node.parts.append(page[at : page.rfind("<", at, end) if end < len(page) or page[at:end].lower().endswith("</" + tag + ">") else end])
            at = end
        elif void:
            if tag in ("br", "hr", "wbr"):
                node.parts.append(" " if tag != "wbr" else "")
        elif drop:
            if tag == "head":
                head = None if "head" in for_end else re.compile(r"</head\s*>|<body[\s>]", re.I).search(page, at)
                if head:
                    at = head.end() if head[0][1] == "/" else head.start()
                else:
                    for_end["head"] = -1
            else:
                skipped.append(tag)
                inside[tag] += 1
        else:
            child = Node(tag, node)
            child.named = named(tag, m[3], node.under)
            node.kids.append(child)
            node.parts.append(child)
            node = child
            opened[tag] += 1


def ends(skipped: list[str], tag: str) -> bool:
    """Whether the element only takes the place of an equal open one that needs no end tag."""
    return tag in ("p", "li", "option", "dt", "dd", "tr", "td", "th") and skipped[-1] == tag


def raw_end(page: str, tag: str, at: int, known: dict) -> int:
    """Place after the end tag of a raw-text element; the page's end if there is none."""
    if known.get(tag) == -1:
        return len(page)
    m = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
    known[tag] = m.end() if m else -1
    return m.end() if m else len(page)


def lineage(node: Node):
    while node:
        yield node
        node = node.parent


def postorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += n.kids
    return out[::-1]


def measure(root: Node, names: bool = True) -> list[Node]:
    """Weighted characters, tags and densities of every node; the nodes, children first."""
    order = weigh(root, names)
    for n in order:
        own = sum(len("".join(p.split())) for p in n.parts if p.__class__ is str)
        n.chars = own * n.weight + sum(k.chars for k in n.kids)
        n.tags = sum(k.tags + 1 for k in n.kids)
        n.link_chars = n.chars if n.tag == "a" else sum(k.link_chars for k in n.kids)
        n.link_tags = sum(k.link_tags + (k.tag == "a") for k in n.kids)
    share = root.link_chars / (root.chars or 1)
    for n in order:
        n.density = density(n.chars, n.tags, n.link_chars, n.link_tags, share)
        n.total = sum(k.density for k in n.kids)
    return order


def density(chars: float, tags: int, link_chars: float, link_tags: int, share: float) -> float:
    """Characters per tag, times the logarithm of (characters per link character times tags per link) to a base that
    grows with the links among the characters; ``share`` is that of links in the whole page.

    The least base is the logarithm of e squared: with e itself it would be near 1 for short parts, and their density without bounds.
    """
    if not chars:
        return 0.0
    tags, link_tags = tags or 1, link_tags or 1
    rest = chars - link_chars
    base = math.log(math.log(chars / (rest if rest >= 1 else 1) * link_chars + share * chars + math.e**2))
    ratio = chars / (link_chars or 1) * tags / link_tags
    return chars / tags * math.log(max(1.0, ratio)) / base


def content(root: Node, names: bool = True) -> set[int]:
    """Ids of the top nodes of the content: the subtree with the largest sum, and others of some structure that
    reach the threshold with their density and with their sum."""
    order = measure(root, names)
    if not root.chars:
        return set()
    body = next((n for n in reversed(order) if n.tag == "body"), root)
    inside = postorder(body)
    best = max((n for n in reversed(inside) if not n.other), key=lambda n: n.total, default=body)
    if not best.total:
        best = max((n for n in reversed(inside) if not n.other), key=lambda n: n.density, default=body)
    threshold = min(n.density for n in path_to(best, body))
    top: dict[int, Node] = {}
    for n in inside:  # best subtree at or below each node
        top[id(n)] = max([n, *(top[id(k)] for k in n.kids if not k.other)], key=lambda x: x.total)
    whole = wholes(order) if names else {}
    wide = lambda n: id(whole.get(id(n), n))
    chosen = {wide(best)}
    for n in inside:
        if n.density >= threshold and top[id(n)].total >= threshold and n.chars and not n.other:
            chosen.add(wide(top[id(n)]))
    return chosen


def wholes(order: list[Node]) -> dict[int, Node]:
    """For each node in one the nearest article element around it, else the nearest main element, of those whose text is mostly no link."""
    out: dict[int, Node] = {}
    for tag in ("main", "article"):
        found: dict[int, Node] = {}
        for n in reversed(order):  # parents first
            own = n if n.tag == tag and 2 * n.link_chars < n.chars else found.get(id(n.parent))
            if own:
                found[id(n)] = own
        out |= found
    return out


def path_to(node: Node, body: Node):
    for n in lineage(node):
        yield n
        if n is body:
            return


def main_text(page: str | None, names: bool = True) -> str:
    """Blocks of the content in page order, white space single, joined by one space. ``names``: whether names add to the densities."""
    if not page:
        return ""
    root = parse(page)
    chosen = content(root, names)
    out: list[str] = []
    todo: list = [(root, False)]
    while todo:  # depth first with a stack of our own, as pages nest deeply
        x, on = todo.pop()
        if x.__class__ is str:
            if on:
                out.append(x)
            continue
        on = not x.other and (on or id(x) in chosen)
        edge = [(" ", on)] if x.tag in _BLOCK else []
        todo += [*edge, *((p, on) for p in reversed(x.parts)), *edge]
    return " ".join("".join(out).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row. A null or empty page, or one without content, gives an empty text; repeated rows and null ids stay. An empty table gives no rows."""

    @lean
    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return fold(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op5_main_text": op5_main_text}
ORACLES = {}
