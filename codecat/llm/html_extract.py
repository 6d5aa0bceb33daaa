"""HTML extraction by consensus host paths.

Every page's containers are scored by the text of their paragraphs, and the
page votes for the generalised path (tags with their classes, numbers left out) of its
best one.  Votes are counted per host in Spark, and pages are extracted from the
articles that the elements on their host's winning path are in; a page without
such an element is extracted around its own best container.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stages import stage
from .url_filter import host_of

# Above these sizes the winners are joined by a shuffle, not broadcast.
BROADCAST_HOSTS, BROADCAST_BYTES = 50_000, 8 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
# They hold no blocks: where one is left open, the next block ends it.
CONTROLS = ("button", "select")
BLOCKS = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
                    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table "
                    "tbody tfoot thead tr ul").split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body main article section div td blockquote center".split())
BOILERPLATE_TAGS = frozenset("head nav header footer aside form dialog menu button select".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
# Words in a class or id that mark what is not the article.
BOILERPLATE_WORDS = frozenset(("ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent "
                               "cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice "
                               "notification pager pagination popup promo promotion recommended related replies reply share sharing sidebar "
                               "signup skip social sponsor sponsored subscribe subscription toolbar widget").split())
# Those that name what is by others or for sale, never a page's layout.
OTHERS = BOILERPLATE_WORDS - frozenset(("alert banner breadcrumb breadcrumbs footer header masthead menu modal nav navbar navigation notice notification "
                                        "pager pagination sidebar skip social toolbar widget").split())
LAYOUT_WORDS = frozenset(("area bar block box button buttons col column container content holder inner item items left links list outer panel post posts "
                          "primary right secondary section site slot top bottom global page wrap wrapper").split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A paragraph ends at the start of a block; a list item or table part at the start of its like.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
             "option": ("option",)}
_FENCE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^>]*)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w\-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?![\w\-])""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Element:
    __slots__ = ("tag", "parent", "step", "path", "out", "named", "score", "order")

    def __init__(self, tag: str, parent: Element | None, step: str, path: str, out: bool, named: int, order: int):
        self.tag, self.parent, self.step, self.path = tag, parent, step, path
        self.out, self.named, self.order, self.score = out, named, order, 0.0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text else {}


def _words(name: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(name)]


def _is_boilerplate(tag: str, attributes: dict[str, str]) -> bool:
    """Whether tag, role or visibility say that an element is not the article."""
    return (tag in BOILERPLATE_TAGS or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
            or bool(re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I)) or attributes.get("role", "").lower() in BOILERPLATE_ROLES)


def _named(tag: str, attributes: dict[str, str]) -> int:
    """Whether a class or id names boilerplate: 0 no, 1 in its first or last word (as a layout's name may), 2 by itself.

    Words of ids are those of headlines as often as not: an id counts if it has no
    other words than boilerplate and layout, and not on a heading.
    """
    if tag in ("html", "body", "main", "article"):
        return 0
    found = 0
    for name in attributes.get("class", "").split():
        words = _words(name)
        ends = [w for w, before in zip(words, ["", *words[:-1]], strict=True) if before not in ("has", "no", "with", "without")]
        if words and words[0] not in ("has", "no", "with", "without") and BOILERPLATE_WORDS.intersection(w for w in (words[0], words[-1]) if w in ends):
            found = max(found, 1 + (BOILERPLATE_WORDS.issuperset(words) or bool(OTHERS.intersection((words[0], words[-1])))))
    for name in attributes.get("id", "").split() if tag not in HEADINGS else ():
        words = _words(name)
        if BOILERPLATE_WORDS.intersection(words) and all(w in BOILERPLATE_WORDS or w in LAYOUT_WORDS for w in words):
            found = 2
    return found


def _step(tag: str, attributes: dict[str, str]) -> str:
    names = sorted({"-".join(w) for c in attributes.get("class", "").split() if (w := _words(c))})
    return ".".join([tag, *names])


def _digest(above: str, step: str) -> str:
    """A path of any length as a string of one length, from that of the element above."""
    return hashlib.blake2b(f"{above}>{step}".encode(), digest_size=12).hexdigest()


def path_of(e: Element) -> str:
    """The path of an element in words, from the outside in."""
    steps = [a.step for a in _above(e) if a.step]
    return ">".join(["", *reversed(steps)])


def path_digest(path: str) -> str:
    """What ``Element.path`` is for elements on ``path``."""
    out = ""
    for step in path.split(">")[1:]:
        out = _digest(out, step)
    return out


def _above(e: Element) -> Iterator[Element]:
    """The element and what holds it, from the inside out."""
    node: Element | None = e
    while node is not None:
        yield node
        node = node.parent


def _judge(elements: list[Element], blocks: list[tuple[Element, str, int]]) -> None:
    """Mark as out what a class or id names boilerplate, unless the page's article is in it.

    The article is in an element that holds a main, or an article or most of the
    page's text, if no other article or main has text outside named elements.  What
    is boilerplate by its whole name, or by others, must hold an article and more
    text than is outside.
    """
    named = [e for e in elements if e.named and not e.out]
    if named:
        # Elements come after those around them: sums go up in reverse order, marks down in order.
        n = len(elements)
        under = [False] * n
        for e in elements:
            under[e.order] = bool(e.named) or (e.parent is not None and under[e.parent.order])
        inside, clear, seen = [0] * n, [0] * n, 0
        for holder, _, own in blocks:
            inside[holder.order] += own
            if not under[holder.order]:
                seen += own
                clear[holder.order] += 1
        holds: list[set[str]] = [set()] * n
        for e in reversed(elements):
            if e.tag in ("article", "main") and not e.out and inside[e.order]:
                holds[e.order] = holds[e.order] | {e.tag}
            if e.parent is not None:
                up = e.parent.order
                inside[up] += inside[e.order]
                clear[up] += clear[e.order]
                if not holds[e.order] <= holds[up]:
                    holds[up] = holds[up] | holds[e.order]
        total = inside[0]
        # Articles and mains with clear text: those around an element are no rivals of it.
        free, free_around = 0, [0] * n
        for e in elements:
            mine = e.tag in ("article", "main") and clear[e.order] > 0
            free += mine
            free_around[e.order] = mine + (free_around[e.parent.order] if e.parent is not None else 0)
        for e in named:
            tags = holds[e.order]
            rival = free > free_around[e.order]
            most = 2 * inside[e.order] > total
            if "main" in tags or (not rival and (inside[e.order] > seen if e.named == 2 and tags else e.named == 1 and (tags or most))):
                e.named = 0
    for e in elements[1:]:
        e.out = e.out or bool(e.named) or e.parent.out


def parse(page: str) -> tuple[list[Element], list[tuple[Element, str]]]:
    """The elements, and the text blocks outside boilerplate with the innermost element that holds each."""
    root = Element("", None, "", "", False, 0, 0)
    elements, stack = [root], [root]
    blocks: list[tuple[Element, str, int]] = []
    piece: list[str] = []
    linked = in_link = 0
    # Where the open elements of each tag, and the open blocks, stand in the stack.
    open_at: dict[str, list[int]] = {}
    blocks_at: list[int] = []

    def innermost(tags: tuple[str, ...]) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(piece).split())
        piece.clear()
        holder = stack[-1]
        if text and not holder.out:
            blocks.append((holder, text, max(len(text) - linked, 0)))
        linked = 0

    def write(text: str) -> None:
        nonlocal linked
        text = html.unescape(text) if "&" in text else text
        piece.append(text)
        if in_link:
            linked += len(text)

    def close(depth: int) -> None:
        nonlocal in_link
        for e in stack[depth:]:
            in_link -= e.tag == "a"
            open_at[e.tag].pop()
        del stack[depth:]
        while blocks_at and blocks_at[-1] >= depth:
            blocks_at.pop()

    at, end = 0, page.rfind(">") + 1
    while True:
        m = _TOKEN.search(page, at, end)
        write(page[at: m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if page.startswith("<!--", m.start()) and not m[0].endswith("-->"):
                at = len(page)
            continue
        if m[1] or m[4]:
            depth = innermost((tag,))
            if tag in BLOCKS or tag in ("td", "th"):
                flush() if tag in BLOCKS else piece.append(" ")
            if depth and (tag in BLOCKS or tag in ("td", "th") or not (blocks_at and blocks_at[-1] >= depth)):
                close(depth)
            continue
        attributes = _attributes(m[3] if m[2] else m[6])
        if tag in RAW:
            if not (m[3] if m[2] else m[6]).endswith("/"):
                last = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = last.end() if last else len(page)
            piece.append(" ")
            continue
        if tag in VOID:
            flush() if tag == "hr" else piece.append(" " if tag in ("br", "img", "wbr") else "")
            continue
        if tag in BLOCKS or tag in ("td", "th"):
            flush() if tag in BLOCKS else piece.append(" ")
            if tag in BLOCKS:  # a block ends an open paragraph, with the inline elements in it
                control = innermost(CONTROLS)
                if control and tag != "div":
                    close(control)
                if blocks_at and stack[blocks_at[-1]].tag == "p":
                    close(blocks_at[-1])
            if tag in CLOSED_BY:
                like = innermost(CLOSED_BY[tag])
                if like > innermost(_FENCE.get(tag, ())):
                    close(like)
        above = stack[-1]
        step = _step(tag, attributes) if tag in CONTAINERS else ""
        element = Element(tag, above, step, _digest(above.path, step) if step else above.path, above.out or _is_boilerplate(tag, attributes), _named(tag, attributes), len(elements))
        in_link += tag == "a"
        elements.append(element)
        open_at.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            blocks_at.append(len(stack))
        stack.append(element)
    flush()
    _judge(elements, blocks)
    got = [0.0] * len(elements)
    for holder, _, own in blocks:
        got[holder.order] += 0 if holder.out else own
    for e in reversed(elements):
        share = got[e.order]
        if e.tag in CONTAINERS or e is root:
            e.score = share
            share *= 0.6
        if e.parent is not None:
            got[e.parent.order] += share
    return elements, [(holder, text) for holder, text, _ in blocks if not holder.out]


def best(elements: list[Element]) -> Element:
    """The container with the highest score; of equal ones the first."""
    weight = {"article": 1.25, "main": 1.25, "": 0.9, "html": 0.9, "body": 0.95}
    return max((e for e in elements if e.parent is None or (e.tag in CONTAINERS and not e.out)),
               key=lambda e: (e.score * weight.get(e.tag, 1.0), -e.order))


def whole(elements: list[Element], chosen: list[Element], blocks: list[tuple[Element, str]]) -> list[str]:
    """The texts of the article that the chosen containers are in, or are.

    That is the outermost article or main around a container, with page headlines
    beside it.  Without one it is the outermost element around it, short of the
    page's body, that adds paragraphs or headings; of the body itself only
    paragraphs and headings that are in no other container.
    """
    marked = [next((a for a in reversed(list(_above(e))) if a.tag in ("article", "main")), None) for e in chosen]
    tops = {(m or e).order for e, m in zip(chosen, marked, strict=True)}
    around = {a.order: m is not None for e, m in zip(chosen, marked, strict=True) for a in _above(m or e)}
    # Of each element: the nearest one around a container, and what lies between, marked from the outside in.
    node_of, kind_of, boxed_in = {}, {}, {}
    for e in elements:
        if e.order in around:
            node_of[e.order], kind_of[e.order], boxed_in[e.order] = e, None, False
        elif e.parent is not None and e.parent.order in node_of:
            up = e.parent.order
            node_of[e.order] = node_of[up]
            kind_of[e.order] = e.tag if e.tag in PARAGRAPHS else kind_of[up]
            boxed_in[e.order] = boxed_in[up] or e.tag in CONTAINERS
    beside = set()
    for k, (holder, _) in enumerate(blocks):
        node, kind, boxed = node_of[holder.order], kind_of[holder.order], boxed_in[holder.order]
        if node.order in tops:
            continue
        if kind is None or (around[node.order] and (boxed or kind != "h1")):
            continue
        if around[node.order] or node.tag in ("", "html", "body"):
            if not boxed:
                beside.add(k)
        else:
            tops.add(node.order)
    inside = _under(elements, tops)
    return [text for k, (holder, text) in enumerate(blocks) if k in beside or inside[holder.order]]


def _under(elements: list[Element], orders: set[int]) -> list[bool]:
    """Whether each element is one of ``orders`` or in one."""
    out = [False] * len(elements)
    for e in elements:
        out[e.order] = e.order in orders or (e.parent is not None and out[e.parent.order])
    return out


def extract(page: str, path: str | None) -> str:
    """The text of the articles on ``path``, or around the page's best container if it has none there."""
    elements, blocks = parse(page)
    want = None if path is None else path_digest(path)
    chosen = [e for e in elements if want is not None and e.path == want and (e.tag in CONTAINERS or e.parent is None) and not e.out]
    inside = _under(elements, {e.order for e in chosen})
    if not any(inside[holder.order] for holder, _ in blocks):
        chosen = [best(elements)]
    return "\n\n".join(whole(elements, chosen, blocks))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = []
        for page in batch.column(1):
            elements, blocks = parse(page.as_py() or "")
            paths.append(path_of(best(elements)) if blocks else None)
        yield pa.record_batch([batch.column(0), pa.array(paths, pa.string())], names=["host", "path"])


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes): the path with the most votes of each host, of equal ones the last in order."""
    rows = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`")).where("host <> ''")
    votes = rows.mapInArrow(_votes, "host string, path string").where("path IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("votes"))
    return votes.groupBy("host").agg(F.max(F.struct("votes", "path")).alias("m")).select("host", "m.path", "m.votes")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) per row of ``pages``: the article's blocks, joined by empty lines.

    A null or empty page, or one without text outside menus and the like, has an empty
    text; an element named like boilerplate that the article is in is none.  Pages without a host do not vote and are extracted by themselves.  Rows that
    repeat give equal rows, ids may repeat or be null, other columns are not read.  An
    empty table gives an empty result.
    """
    winners = stage(host_paths(pages, url_col, html_col), "paths")
    n, size = winners.agg(F.count("*"), F.sum(F.length("host") + F.length("path"))).first()
    side = F.broadcast(winners) if n <= BROADCAST_HOSTS and (size or 0) <= BROADCAST_BYTES else winners
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"),
                        host_of(F.col(f"`{url_col}`")).alias("host"))
    joined = rows.join(side.select("host", "path"), "host", "left").select("id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py() or "", path.as_py()) for page, path in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, url string, text string")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))
