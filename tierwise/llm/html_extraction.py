"""HTML extraction by wrapper induction.

Pages become small trees of block elements. Pages of one host are aligned by simple tree matching, one
after another, with the host's template: a matched slot counts its pages, its text, the text of its links, and
its text stays constant as long as all pages agree. Pages of equal content count once, so copies make no
template. Slots that stay constant over enough different pages are template. Of the varying slots, those make the
content that carry the text of the host's pages: menus, adverts and footers whose words change are slots of the
frame as well. A slot is of the frame by two votes: elements and roles that say menu, header, footer, sidebar, form
and the like have two, and so have names of reader comments; other class and id names have one for each word that says so
(never for headings; of an article's parts with prose in them, only for whole names), a slot that
holds less than half of its parent's text on the host's pages has one, a slot beside the page's article one, and a
slot that recurs and whose text is links for the most part one. Without a template, elements, roles and names vote alone.

Templates are built by host and a hash of the content, in the order of these hashes, then merged in order by host:
the result depends neither on the order nor the partitions of the input, and a host with a third of all pages is
spread over ``BUCKETS`` tasks. Slots that occur on fewer than one page in ``RARE`` are forgotten as a template grows.

Trees have any depth; chains of elements without text of their own are one node. Null or empty html gives
an empty text; truncated or ill-nested pages are repaired as browsers do for block elements; script and the like
without an end tag end with the block they are in; repeated rows give equal results; pages without a host share
one template.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written
from .url_filters import host_of

TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[A-Za-z][^<>]*>|</?[A-Za-z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW = {t: re.compile(rf"</{t}\s*>?", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "select", "object", "canvas", "audio", "video", "button")}
RAW_AGAIN = {t: re.compile(rf"<{t}[\s/>]", re.I) for t in RAW}
FOREIGN = frozenset(("svg", "math"))  # their elements may be closed by a slash
CODE = frozenset(("script", "style", "textarea", "title"))
BLOCKS = frozenset("html head body nav header footer aside main article section div ul ol li menu dl dt dd p h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th caption form fieldset blockquote pre figure figcaption address details summary dialog hgroup center hr".split())
BLOCK_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in BLOCKS}
ENDS_P = BLOCKS - {"html", "head", "body"}
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
ASIDE_TAGS = frozenset("head nav header footer aside form menu dialog fieldset".split())
ASIDE_NAMES = re.compile(r"^(?:ads?|advert\w*|banner\w*|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|sidebar\w*|aside|widget\w*|related\w*|share\w*|sharing|social\w*|comments?|commentlist|replies|respond|disqus\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|newsletter|subscribe|subscription|login|search|skip|pagination|pager|toolbar|tags|copyright|legal)$", re.I)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
COMMENT_NAMES = re.compile(r"^(?:comments?|commentlist|replies|respond|disqus\w*)$", re.I)
CONTAINERS = frozenset("div section article ul ol li dl table details".split())
CONTENT_NAMES = re.compile(r"^(?:main|content|article|post|entry|story|body|text)$", re.I)
MAIN_ROLES = frozenset(("main", "article"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
TEXT_TAGS = HEADINGS | frozenset("# p li dt dd td th caption figcaption pre blockquote address".split())
OUTSIDE, INSIDE, SHARE = 3, 20, 0.5  # pages that make a constant slot template, outside and inside of an article, and their share
RARE = 50
PROSE = 100  # code points of a text block, for the most part no link, that is more than a label or a slogan
BUCKETS = 256


class Node:
    """An element with children, or (label '#') a block of text; ``votes`` of its element, role and names for the frame."""

    __slots__ = ("article", "chars", "digest", "holds", "kids", "label", "linked", "main", "prose", "spare", "tag", "text", "votes", "whole")

    def __init__(self, tag: str, label: str, text: str = "", votes: int = 0, main: bool = False, linked: int = 0, whole: int = 0, article: bool = False):
        self.tag, self.label, self.text, self.main, self.article, self.kids = tag, label, text, main, article, []
        self.votes, self.spare, self.whole = 0 if main else votes, votes, whole
        self.chars, self.linked, self.holds, self.digest = len(text), linked, False, 0
        self.prose = len(text) >= PROSE and 2 * linked <= len(text)


@functools.lru_cache(maxsize=8192)
def _traits(tag: str, attributes: str) -> tuple[str, int, bool, int, bool]:
    """Label, votes, whether it may be main, votes of whole names, and whether it is an article; the same few tags recur on all pages."""
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)} if attributes else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    role = found.get("role", "").lower()
    article = tag == "article" or role == "article"
    main = article or tag == "main" or role == "main"
    words = {w.lower() for n in names for w in (n, *re.split(r"[-_]", n))}
    votes = whole = 0
    if tag in ASIDE_TAGS or role in ASIDE_ROLES:
        votes = whole = 2
    elif tag in CONTAINERS and any(COMMENT_NAMES.match(w) for w in words):
        votes, whole, main = 2, 2, False
    elif names and tag not in HEADINGS and tag not in ("body", "html"):
        content_ = any(CONTENT_NAMES.match(w) for w in words)
        votes, whole = (max(0, min(2, sum(1 for w in some if ASIDE_NAMES.match(w))) - content_) for some in (words, {n.lower() for n in names}))
    return tag + ("." + re.sub(r"\d+", "0", names[0].lower()) if names else ""), votes, main, whole, article


def _element(tag: str, attributes: str) -> Node:
    label, votes, main, whole, article = _traits(tag, attributes)
    return Node(tag, label, "", votes, main, 0, whole, article)


def tree(html: str) -> Node:
    """The block tree of a page; inline elements are transparent, white space in a block is one space."""
    root = Node("page", "page")
    stack: list[tuple[str, Node]] = [("page", root)]
    pending: list[str] = []
    at = linked = 0
    in_link = False

    def flush() -> None:
        nonlocal linked, in_link
        if pending:
            text = " ".join(unescape("".join(pending)).split())
            if text:
                stack[-1][1].kids.append(Node("#", "#", text, linked=min(linked, len(text))))
            pending.clear()
        linked, in_link = 0, False

    def close(names, fence=()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in fence:
                return
            if stack[k][0] in names:
                flush()
                del stack[k:]
                return

    found: dict[str, re.Match | None] = {}  # the next end tag by name

    def ahead(pattern: re.Pattern, name: str) -> re.Match | None:
        if name not in found or (found[name] and found[name].start() < at):
            found[name] = pattern.search(html, at)
        return found[name]

    def raw_end(tag: str, slashed: bool) -> int:
        """Where a raw element ends: at once if it is closed by a slash, else with its end tag or an open block's."""
        if slashed and tag in FOREIGN:
            return at
        end = ahead(RAW[tag], tag)
        if slashed and tag not in CODE and (not end or RAW_AGAIN[tag].search(html, at, end.start())):
            return at
        if end:
            return end.end()
        ends = [x.start() for name in {name for name, _ in stack[1:]} if (x := ahead(BLOCK_END[name], "/" + name))]
        return min(ends, default=len(html))

    while m := TAG.search(html, at):
        start, end = m.span()
        if start > at:
            pending.append(html[at:start])
            if in_link:
                linked += start - at
        at = end
        closing, tag, attributes = m.groups()
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag in BLOCKS:
                if pending:
                    flush()
                linked, in_link = 0, False
                if stack[-1][0] == tag:
                    del stack[-1]
                else:
                    close((tag,))
            elif tag == "a":
                in_link = False
            elif tag in ("option", "label"):
                pending.append(" ")
            continue
        if tag in RAW:
            at = raw_end(tag, attributes.endswith("/"))
            pending.append(" ")
        elif tag in BLOCKS:
            if pending:
                flush()
            linked, in_link = 0, False
            if tag in ENDS_P:
                close(("p",), ("td", "th", "li", "article", "section", "div", "body"))
            if tag in CLOSES:
                names, fence = CLOSES[tag]
                close(names, fence)
            node = _element(tag, attributes)
            stack[-1][1].kids.append(node)
            if tag != "hr" and not attributes.endswith("/"):
                stack.append((tag, node))
        elif tag in ("br", "img", "wbr", "input"):
            pending.append(" ")
        elif tag == "a":
            in_link = "href" in attributes.lower()
    if at < len(html):
        pending.append(html[at:])
        if in_link:
            linked += len(html) - at
    flush()
    return _finished(root)


def _finished(root: Node) -> Node:
    """The tree with chains of elements joined, the text, link text and digest of all nodes, and which nodes hold a main
    element that is no part of a menu or the like.

    An article inside an article, inside an element whose names vote for the frame, or beside others of its label is a
    comment, a card of another story or an entry of a list, and no main element.
    """
    order, todo, depth = [], [(root, 1, False, False)], 1
    while todo:
        node, level, framed, nested = todo.pop()
        if not node.kids:
            order.append(node)
            depth = max(depth, level)
            continue
        framed |= node.votes > 0 and node.tag != "header"
        nested |= node.article and node.main
        articles = [k for k in node.kids if k.article and k.main]
        if articles:
            alike = Counter([k.label for k in articles])
            for k in articles:
                if framed or nested or alike[k.label] > 1:
                    k.main, k.votes = False, k.spare
        while len(node.kids) == 1 and node.kids[0].label == node.label and not (node.main or node.kids[0].main) and node.label[0] != "#":
            node.votes, node.kids = max(node.votes, node.kids[0].votes), node.kids[0].kids
        order.append(node)
        todo += [(k, level + 1, framed, nested) for k in node.kids]
    for node in reversed(order):
        node.digest = digest = zlib.crc32((node.text if node.label == "#" else node.label).encode("utf-8", "replace"))
        if not node.kids:
            if node.votes < 2 or node.tag in ("header", "heading"):
                node.holds = node.main
            continue
        chars, linked = node.chars, node.linked
        for k in node.kids:
            chars += k.chars
            node.prose |= k.prose
            linked += k.linked
            digest = zlib.crc32(k.digest.to_bytes(4), digest)
        node.chars, node.linked, node.digest = chars, linked, digest
        if node.tag == "header" and any(k.tag in HEADINGS for k in node.kids):
            node.tag = "heading"
        if node.votes < 2 or node.tag in ("header", "heading"):
            node.holds = node.main or any([k.holds for k in node.kids])
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * depth + 1000))
    return root


def slots_of(node: Node, most: int = 4) -> list[tuple[str, list[Node]]]:
    """Children as labelled slots. Neighbours whose labels occur more than ``most`` times each are one slot, a list of any length."""
    if len(node.kids) <= most:
        return [(kid.label, [kid]) for kid in node.kids]
    often: dict[str, int] = {}
    for kid in node.kids:
        often[kid.label] = often.get(kid.label, 0) + 1
    out: list[tuple[str, list[Node]]] = []
    run: list[Node] = []
    for kid in node.kids:
        if often[kid.label] > most:
            run.append(kid)
            continue
        if run:
            out.append(("|".join(sorted({k.label for k in run})) + "+", run))
            run = []
        out.append((kid.label, [kid]))
    if run:
        out.append(("|".join(sorted({k.label for k in run})) + "+", run))
    return out


def summary(label: str, nodes: list[Node]) -> list:
    """A page's slot as a template node: [label, pages, digest or None if it varies, slots, text, link text]."""
    slots: list[list] = []
    digest, chars, linked = 0, 0, 0
    for node in nodes:
        digest = zlib.crc32(node.digest.to_bytes(4), digest)
        chars += node.chars
        linked += node.linked
        if not node.kids:
            continue
        own = []
        for name, kids in slots_of(node):
            if len(kids) == 1 and not kids[0].kids:
                kid = kids[0]
                own.append([name, 1, zlib.crc32(kid.digest.to_bytes(4)), [], kid.chars, kid.linked])
            else:
                own.append(summary(name, kids))
        slots = own if not slots else merged_slots(slots, own, within=True)
    return [label, 1, digest, slots, chars, linked]


def matched(a: list, b: list, known: dict | None = None) -> int:
    """Simple tree matching: the largest number of nodes of equal label that can be paired in order."""
    if a[0] != b[0]:
        return 0
    known = {} if known is None else known
    key = (id(a), id(b))
    if key not in known:
        known[key] = 1 + _pairs(a[3], b[3], known)[0]
    return known[key]


def _plain_pairs(a: list, b: list) -> list[tuple[int, int]] | None:
    """The pairing where it is plain without weights: of a list with itself, or where no label is there twice in ``a`` or in ``b``
    and those of both come in one order, since each pair of equal labels adds to the chain. Else None."""
    if a is b:
        return [(i, i) for i in range(len(a))]
    first, second = [x[0] for x in a], [x[0] for x in b]
    where = dict(zip(second, range(len(b))))
    if len(where) < len(b) or len(set(first)) < len(a):
        return None
    if first == second:
        return [(i, i) for i in range(len(a))]
    out, last = [], -1
    for i, label in enumerate(first):
        j = where.get(label)
        if j is not None:
            if j < last:
                return None
            out.append((i, j))
            last = j
    return out


def paired(a: list, b: list, known: dict) -> list[tuple[int, int]]:
    """The pairing of ``_pairs``, without weights where it takes none."""
    if not a or not b:
        return []
    plain = _plain_pairs(a, b)
    return _pairs(a, b, known)[1] if plain is None else plain


def _pairs(a: list, b: list, known: dict) -> tuple[int, list[tuple[int, int]]]:
    """The pairing in order of slots of equal label with the most matched nodes: a heaviest chain among all such pairs."""
    if not a or not b:
        return 0, []
    plain = _plain_pairs(a, b)
    if plain is not None:
        total = 0
        for i, j in plain:
            total += matched(a[i], b[j], known)
        return total, plain
    where: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j][0], []).append(j)
    top: list[tuple | None] = [None] * (len(b) + 1)  # Fenwick tree: heaviest chain whose last pair lies in a stretch of b
    best = None  # (weight, -i, -j, chain before)
    for i, slot in enumerate(a):
        for j in where.get(slot[0], ()):  # the last first, so that chains take one pair of a slot
            before, k = None, j
            while k:
                if top[k] and (before is None or top[k][0] > before[0]):
                    before = top[k]
                k -= k & -k
            chain = ((before[0] if before else 0) + matched(slot, b[j], known), i, j, before)
            k = j + 1
            while k < len(top):
                if top[k] is None or chain[0] > top[k][0]:
                    top[k] = chain
                k += k & -k
            if best is None or chain[0] > best[0]:
                best = chain
    total, pairs = best[0] if best else 0, []
    while best:
        pairs.append((best[1], best[2]))
        best = best[3]
    return total, pairs[::-1]


def merged_slots(a: list, b: list, within: bool = False, known: dict | None = None) -> list:
    known = {} if known is None else known
    out, i, j = [], 0, 0
    for x, y in [*paired(a, b, known), (len(a), len(b))]:
        out += a[i:x] + b[j:y]
        if x < len(a):
            out.append(merged(a[x], b[y], within, known))
        i, j = x + 1, y + 1
    return out


def merged(a: list, b: list, within: bool = False, known: dict | None = None) -> list:
    """Two templates of equal label aligned into one; ``within``: both of one page, which counts once."""
    pages = max(a[1], b[1]) if within else a[1] + b[1]
    slots = merged_slots(a[3], b[3], within, known)
    return [a[0], pages, a[2] if a[2] == b[2] else None, [x for x in slots if RARE * x[1] >= pages], *(x + y for x, y in zip(a[4:], b[4:]))]


def packed(template: list) -> str:
    """A template as text, whatever its depth: its nodes in order, each with its number of slots."""
    out, todo = [], [template]
    while todo:
        node = todo.pop()
        out.append([node[0], node[1], node[2], len(node[3]), *node[4:]])
        todo += reversed(node[3])
    return json.dumps(out)


def unpacked(text: str) -> list:
    root: list = []
    open_: list[tuple[list, int]] = [(root, 1)]
    depth = 1
    for label, pages, digest, slots, *rest in json.loads(text):
        while not open_[-1][1]:
            open_.pop()
        into, left = open_[-1]
        open_[-1] = (into, left - 1)
        node = [label, pages, digest, [], *rest]
        into.append(node)
        open_.append((node[3], slots))
        depth = max(depth, len(open_))
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * depth + 1000))
    return root[0]


def content(page: Node, template: list | None, own: list | None = None) -> list[str]:
    """The text blocks in page order that are neither template nor frame.

    ``template`` is the host's, or the page's summary ``own``. A slot is template if at least ``SHARE`` of the host's different pages have it, and all of
    them with equal text: ``OUTSIDE`` pages suffice, ``INSIDE`` an article more are asked for. A slot that holds a
    main element is neither template nor frame, nor is all that a page has to say.
    """
    pages = template[1] if template else 0
    known: dict = {}

    def framed(kid: Node, t: list | None, mass: int, main: bool) -> bool:
        votes = kid.whole if main and kid.prose else kid.votes
        if kid.tag == "heading":
            votes = 0 if main else votes
        if votes < 2 and t is not None:
            small = 2 * t[4] < mass
            beside = page.holds and not main
            votes += small and (beside or kid.tag not in TEXT_TAGS)
            votes += beside
            votes += not main and t[1] >= OUTSIDE and 2 * t[5] > t[4]
        return votes >= 2

    made = []  # summaries stay alive, as pairs are known by identity

    def walk(node: Node, slot: list | None, same: bool, main: bool, strict: bool, kept: list[str]) -> list[str]:
        """``same``: ``slot`` is the node's own summary."""
        twin: dict[int, list] = {}
        groups = slots_of(node)
        if same:
            twin = dict(enumerate(slot[3]))
        elif slot is not None and slot[3] and groups:
            pairs = _plain_pairs(groups, slot[3])
            if pairs is None:
                made.append([summary(label, group) for label, group in groups])
                pairs = _pairs(made[-1], slot[3], known)[1]
            twin = {i: slot[3][j] for i, j in pairs}
        mass = sum([t[4] for t in twin.values()])
        for i, (label, group) in enumerate(groups):
            t = twin.get(i)
            constant = strict and t is not None and t[2] is not None and t[1] >= (INSIDE if main else OUTSIDE) and t[1] >= SHARE * pages
            for kid in group:
                if not kid.holds and (constant or framed(kid, t if strict else None, mass, main)):
                    continue
                if kid.label == "#":
                    kept.append(kid.text)
                elif kid.kids:
                    walk(kid, t, same and len(group) == 1, main or kid.main, strict, kept)
        return kept

    same = own is not None and own is template
    return walk(page, template, same, False, True, []) or walk(page, None, False, False, False, [])


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, template: one row per host, of its different pages.

    Pages that say the same outside of frame and template (copies, mirrors, one article under several menus)
    count as one page, since what is equal on them tells nothing of what is template.
    """
    names = ["host", "part", "template"]
    schema = "host string, part long, template string"

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=names)

    def parse(batches: Iterator[pa.RecordBatch]):
        seen: set[tuple[str | None, int]] = set()
        for batch in batches:
            rows = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = tree(html.as_py() or "")
                own = summary("page", [page])
                says = int.from_bytes(hashlib.blake2b("\n".join(content(page, own, own)).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
                if (host, says) not in seen:
                    seen.add((host, says))
                    rows.append((host, says, packed(own)))
                if len(seen) > 1_000_000:
                    seen.clear()  # copies that are sent again are told apart by the next step
            yield out(rows)

    def joined(part_of):
        """One template for each host and part of it; rows come sorted, equal keys of one page once."""

        def run(batches: Iterator[pa.RecordBatch]):
            now, last, template = None, None, None
            for batch in batches:
                for host, part, one in zip(*(c.to_pylist() for c in batch.columns)):
                    key = (host, part_of(part))
                    if key != now:
                        if now is not None:
                            yield out([(*now, packed(template))])
                        now, last, template = key, part, unpacked(one)
                    elif part != last:
                        last, template = part, merged(template, unpacked(one))
            if now is not None:
                yield out([(*now, packed(template))])

        return run

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(parse, schema)
    bucket = F.pmod("part", F.lit(BUCKETS))
    rows = rows.repartition("host", bucket).sortWithinPartitions("host", bucket, "part", "template").mapInArrow(joined(lambda part: part % BUCKETS), schema)
    rows = rows.repartition("host").sortWithinPartitions("host", "part").mapInArrow(joined(lambda part: 0), schema)
    return rows.select("host", "template")


def html_extraction(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars. Templates are written once; Spark broadcasts them if it measures them as small."""
    known = written(templates(pages, url_col, html_col), "templates")
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]):
        loaded: dict[str, list] = {}
        for batch in batches:
            texts = []
            for html, one in zip(batch.column("html"), batch.column("template").to_pylist()):
                if one is not None and one not in loaded:
                    if len(loaded) > 1000:
                        loaded.clear()
                    loaded[one] = unpacked(one)
                texts.append("\n".join(content(tree(html.as_py() or ""), loaded.get(one))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return rows.join(known, "host", "left").select("id", "url", "html", "template").mapInArrow(run, f"{id_col} {kind}, {url_col} string, text string, n_chars long")
