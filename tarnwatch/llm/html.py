"""Main text of web pages by consensus of host paths.

1. Every page is parsed once, its containers are scored by the ordinary text below them, and the
   best one votes for its generalised path (tags with their classes, digits as ``#``).
2. Votes are summed per host and path in Spark; each host elects the path with the largest sum.
3. Pages are extracted again from the container at the elected path of their host, or from their own
   best container if they have no such path.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.session import stage

#: Elements that never hold main text. Fixed values.
DROPPED = frozenset("head script style noscript template iframe object svg math canvas nav header footer aside form button select textarea input dialog menu".split())
#: Elements whose content is not markup up to their end tag. Fixed values.
RAW = frozenset("script style noscript template iframe textarea title xmp".split())
#: Elements without content. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that separate blocks of text. Fixed values.
BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption "
    "address details summary fieldset hr center hgroup".split()
)
CONTAINERS = frozenset("body article main section div td".split())
#: Classes, ids and roles of what surrounds an article. Fixed values.
NOISE = re.compile(
    r"(?:ad|ads|advert|adverts|advertisement|advertising|adbox|adsbox|adsbygoogle|adslot|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|alert|warning-bar"
    r"|newsletter|subscribe|subscription|signup|popup|modal|overlay|sidebar|side|aside|menu|menubar|nav|navbar|navigation|breadcrumb|breadcrumbs|pagination|pager"
    r"|footer|header|masthead|topbar|toolbar|share|sharing|social|related|recommended|recommendations|comment|comments|commentlist|comment-list|disqus|replies|reply|respond|discussion"
    r"|widget|login|search|searchbox|search-form|form|hidden|sr-only|visually-hidden|contentinfo|complementary|dialog|copyright)"
)
#: Elements whose classes, ids and roles tell of the layout and not of what they hold. Fixed values.
NEVER_NAMED = frozenset("html body article main".split())
SPLIT_CLASS = re.compile(r"[-_]+")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
DIGITS = re.compile(r"\d+")
#: Open tags that end an open element of the same kind. Fixed values.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Node:
    __slots__ = ("tag", "parent", "depth", "label", "noise", "named", "children", "own")

    def __init__(self, tag: str, parent: Node | None, attrs: dict[str, str]):
        self.tag, self.parent, self.children, self.own = tag, parent, [], 0
        self.depth = parent.depth + 1 if parent else 0
        classes = attrs.get("class", "").lower().split()
        self.label = ".".join([tag, *sorted(DIGITS.sub("#", c) for c in classes)])
        self.noise = tag in DROPPED or bool(attrs) and _is_hidden(attrs)
        #: Noise by its names only, which is reconsidered once the page is known.
        self.named = _noise_name(classes, attrs) if attrs and not self.noise and tag not in NEVER_NAMED else ""
        self.noise = self.noise or bool(self.named)


def _is_hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()


def _noise_name(classes: list[str], attrs: dict[str, str]) -> str:
    """How names say that an element is noise: a ``whole`` name, a ``part`` of one, or not at all."""
    names = [*classes, attrs.get("id", "").lower(), attrs.get("role", "").lower()]
    for name in names:
        if NOISE.fullmatch(name):
            return "whole"
        # compound names: every part but a leading "site", "page", "post" ... must say what it is
        parts = SPLIT_CLASS.split(name)
        if len(parts) > 1 and NOISE.fullmatch(parts[0]) and parts[0] not in ("header", "footer", "side", "notice", "form", "search", "alert"):
            return "part"
        if len(parts) > 1 and NOISE.fullmatch(parts[-1]) and parts[0] not in ("article", "entry", "post", "content", "story", "main", "no", "with", "has"):
            return "part"
    return ""


def parse(page: str) -> Node:
    """A tree of nodes; children are nodes and texts in page order. Any input gives a tree.

    End tags without an open element are ignored; elements left open end with their parent; raw
    elements run to their end tag or the end of the page.
    """
    root = Node("html", None, {})
    node, at, size, opened = root, 0, len(page), Counter(["html"])
    while at < size:
        begin = page.find("<", at)
        if begin != at:
            node.children.append(page[at:begin if begin > 0 else size])
            if begin < 0:
                break
        found = TOKEN.match(page, begin)
        if found is None:
            node.children.append("<")
            at = begin + 1
            continue
        at = found.end()
        tag = found["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if found["close"]:
            if opened[tag] and tag != "html":
                while node.tag != tag:
                    opened[node.tag] -= 1
                    node = node.parent
                opened[tag] -= 1
                node = node.parent
            continue
        attrs = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(found["attrs"])} if found["attrs"].strip("/ \n\t") else {}
        if tag == "html" or tag == "body" and opened[tag]:
            continue
        while node.tag in CLOSES.get(tag, ()) or node.tag == "p" and tag in BLOCKS:
            opened[node.tag] -= 1
            node = node.parent
        new = Node(tag, node, attrs)
        node.children.append(new)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not found["attrs"].endswith("/"):
            node = new
            opened[tag] += 1
    _clear_wrappers(root)
    return root


def _clear_wrappers(root: Node) -> None:
    """Takes the mark from elements that are noise by name only but hold most of the page's ordinary
    text: their names tell of the layout. It stays if an article or main with text stands beside them,
    or a main heading when the whole name is one of noise: then they are long comments to a short text."""
    order, stack, named = [], [(root, False)], False
    while stack:
        node, linked = stack.pop()
        linked = linked or node.tag == "a"
        node.own = 0
        order.append(node)
        named = named or node.named
        for child in node.children:
            if isinstance(child, str):
                if not linked:
                    node.own += len(child.strip())
            elif not child.noise or child.named:
                stack.append((child, linked))
    if not named:
        return
    for node in reversed(order):
        if node.parent is not None:
            node.parent.own += node.own
    # no two of these stand beside each other, so each holds those after it
    wrappers = [n for n in order if n.named and 2 * n.own > root.own]
    if not wrappers:
        return
    anchors = [n for n in order if n.tag in ("article", "main", "h1") and n.own]
    around = [(n.tag, {n, *_ancestors(n)}) for n in anchors]
    for wrapper in wrappers:
        above = _ancestors(wrapper)
        if not any(
            wrapper not in held and anchor not in above and (tag != "h1" or wrapper.named == "whole") and not any(h.named and h not in wrappers for h in held)
            for anchor, (tag, held) in zip(anchors, around)
        ):
            wrapper.noise, wrapper.named = False, ""


def _ancestors(node: Node) -> list[Node]:
    found = []
    while node.parent is not None:
        node = node.parent
        found.append(node)
    return found


def path(node: Node) -> str:
    parts = []
    while node is not None:
        parts.append(node.label)
        node = node.parent
    return "/".join(reversed(parts))


def measure(root: Node) -> tuple[list[Node], int]:
    """All containers outside noise, with ``own`` set to the ordinary characters below each.

    Walks without recursion, so nesting depth does not matter. Text in links does not count.
    """
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        linked = linked or node.tag == "a"
        order.append(node)
        node.own = 0
        for child in node.children:
            if isinstance(child, str):
                if not linked:
                    node.own += len(child.strip())
            elif not child.noise:
                stack.append((child, linked))
    for node in reversed(order):
        if node.parent is not None:
            node.parent.own += node.own
    return [n for n in order if n.tag in CONTAINERS], root.own


def best_container(root: Node) -> Node:
    """The deepest container with all of the page's ordinary text, else the page.

    So it climbs from the densest container as long as anything is added; where less than that is the
    main text, the votes of the host say so. An ``article`` or ``main`` that holds all of it beats a
    deeper container that adds nothing.
    """
    containers, total = measure(root)
    full = [n for n in containers if n.own == total and n.own]
    if not full:
        return root
    named = [n for n in full if n.tag == "article"] or [n for n in full if n.tag == "main"]
    return (named or full)[-1]


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a container in page order, without noise."""
    out: list[str] = []
    current: list[str] = []

    def flush() -> None:
        line = " ".join(entities.unescape("".join(current)).split())
        if line:
            out.append(line)
        current.clear()

    stack: list = [node]
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            current.append(item)
        elif item.tag == "br":
            current.append(" ")
        elif item is node or not item.noise:
            block = item.tag in BLOCKS
            if block:
                flush()
                stack.append(None)
            stack.extend(reversed(item.children))
    flush()
    return out


def host_of(url) -> Column:
    """Lower-case host of a URL; null or no host: empty."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, scores = [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            best = best_container(parse(page or ""))
            if best.own:
                hosts.append(host)
                paths.append(path(best))
                scores.append(best.own)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], ["host", "path", "score"])


def elect(pages: DataFrame) -> DataFrame:
    """One row per host: ``host, path``; most votes by text, then pages, then the first path."""
    votes = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string")).mapInArrow(_votes, "host string, path string, score long")
    counted = votes.groupBy("host", "path").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("pages"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("score"), F.desc("pages"), "path"))
    return counted.withColumn("place", place).where("place = 1").select("host", "path")


def main_text(page: str | None, wanted: str | None) -> tuple[str, bool]:
    """Main text of a page, and whether it came from the wanted path."""
    root = parse(page or "")
    best = best_container(root)
    if wanted and path(best) != wanted:
        containers, _ = measure(root)
        depth, last = wanted.count("/"), wanted.rpartition("/")[2]
        there = [n for n in containers if n.depth == depth and n.label == last and path(n) == wanted]
        lines = blocks(max(there, key=lambda n: n.own)) if there else []
        if lines:
            return "\n".join(lines), True
        return "\n".join(blocks(best)), False
    return "\n".join(blocks(best)), bool(wanted)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(page, wanted) for page, wanted in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([c for _, c in found], pa.bool_())],
            ["page_id", "url", "text", "by_consensus"],
        )


#: Elected paths that may be sent to every task; with more hosts the join is shuffled.
MOST_SHARED_HOSTS = 20_000


def extract(pages: DataFrame) -> DataFrame:
    """One row per input row: ``page_id, url, text, by_consensus``.

    Defined cases: null html is an empty page with empty text; a null url belongs to the host "";
    rows repeating a ``page_id`` are separate pages; broken markup gives the text that is there; an
    empty table gives an empty result; other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    elected = stage(elect(rows), "html-paths")
    if elected.count() <= MOST_SHARED_HOSTS:
        elected = F.broadcast(elected)
    joined = rows.withColumn("host", host_of(F.col("url"))).join(elected, "host", "left")
    return joined.select("page_id", "url", "html", "path").mapInArrow(_texts, "page_id long, url string, text string, by_consensus boolean")
