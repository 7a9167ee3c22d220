"""Main-text extraction from web pages by wrapper induction.

Pages of one host share a template.  A few pages of every host are parsed and
their DOM trees aligned by tree matching (of the children of two nodes the
order-preserving match of equal labels that shares most texts).  A node that all these independent pages have, with the same
text, is constant: template.  Varying slots are content, unless their place
marks them as menus, headers, footers, sidebars, notices, adverts, forms,
scripts or comments.  Every page is then aligned with its host's wrapper, its
template nodes go, and the text blocks of the article are joined.
"""

from __future__ import annotations

import html as entities
import itertools
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, stored

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {  # a start tag that ends an open element of the same kind, and where the search for it stops
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"})}
SCOPE = frozenset("article aside blockquote body div fieldset figure footer form header li main nav section table td th".split())
#: Elements, roles and name parts whose content is never main text.
ASIDE = frozenset("nav header footer aside form script style noscript template head title button select textarea iframe svg "
                  "dialog menu object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side-?bar|footer|"
                   r"header|masthead|comments?|commentlist|disqus|replies|cookies?|consent|notice|notification|popup|modal|"
                   r"newsletter|subscribe|subscription|social|share|sharing|related|recommended|widget|toolbar|pagination|pager)(?=$|[\s_-])", re.I)
#: An article element so named is a reader's comment, a teaser or an advert.
NO_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|related|teaser|promo\w*|sponsor\w*|ads?|advert\w*)(?=$|[\s_-])", re.I)
ALIGNED_DEPTH = 200   # wrappers reach so deep; below, no node is template and all text is kept


@dataclass(slots=True)
class Node:
    tag: str
    label: str
    aside: bool
    depth: int = 0
    children: list = field(default_factory=list)     # Node or text


def parse(page: str) -> Node:
    """A tolerant DOM: unclosed and unopened tags are mended as browsers do for text."""
    root = Node("#root", "#root", False)
    stack, at, size = [root], 0, len(page)
    opened: Counter = Counter()

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(entities.unescape(piece))

    def close(tags: frozenset | set, stop: frozenset | set) -> None:
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                opened.subtract(n.tag for n in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    while at < size:
        m = MARKUP.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in VOID:
                close({tag}, frozenset())
            continue
        if tag in CLOSES:
            close(*CLOSES[tag])
        elif tag not in INLINE:
            close({"p"}, SCOPE)
        given = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3] else {}
        name = f"{given.get('class', '')} {given.get('id', '')}".strip()
        off = (tag in ASIDE or given.get("role", "").lower() in ROLES or "hidden" in given
               or given.get("aria-hidden", "").lower() == "true" or tag not in ("body", "html", "main") and bool(
                   name and (NO_ARTICLE if tag == "article" else NAMES).search(name)))
        node = Node(tag, f"{tag}.{' '.join(sorted(re.sub(r'[0-9]+', '', given.get('class', '')).split()))}", off, len(stack))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
            node.children.append(entities.unescape(page[at:end.start() if end else size]))
            at = end.end() if end else size
        elif tag not in VOID and not (m[3] and m[3].rstrip().endswith("/") and tag in ("svg", "path")):
            stack.append(node)
            opened[tag] += 1
    return root


def own_text(node: Node) -> str:
    return " ".join(" ".join(c for c in node.children if isinstance(c, str)).split())


def digest(node: Node) -> int:
    """A hash of the node's own text, 0 for none; texts that a browser would not show count as well."""
    text = own_text(node)
    return xxhash.xxh64_intdigest(text) | 1 if text else 0


def elements(node: Node) -> list[Node]:
    """The child elements that a wrapper may reach."""
    return [c for c in node.children if not isinstance(c, str)] if node.depth < ALIGNED_DEPTH else []


class Slot:
    """A wrapper node: its label, the hash of its constant text (0 for none), its
    children with a constant part, and the ``(label, hash)`` pairs at and below it."""
    __slots__ = ("label", "const", "children", "texts")

    def __init__(self, label: str, const: int, children: list[Slot]):
        self.label, self.const, self.children = label, const, [c for c in children if c.texts]
        self.texts = {(label, const)} if const else set()
        for c in self.children:
            self.texts |= c.texts

    @classmethod
    def of(cls, node: Node) -> Slot:
        return cls(node.label, digest(node), [cls.of(c) for c in elements(node)])

    def plain(self) -> list:
        """Nested lists of label, constant and children; ``read`` takes them without empty ends."""
        return [self.label, self.const, [c.plain() for c in self.children]] if self.children else [self.label, self.const]

    @classmethod
    def read(cls, plain: list) -> Slot:
        label, const, children = [*plain, 0, []] if len(plain) == 1 else [*plain, []][:3]
        return cls(label, const, [cls.read(c) for c in children])


def shared(node: Node, known: set[tuple[str, int]], out: dict[int, set]) -> set[tuple[str, int]]:
    """The ``known`` pairs at and below ``node``, and in ``out`` those of every node by its id."""
    own = (node.label, digest(node))
    found = {own} if own in known else set()
    for c in elements(node):
        found |= shared(c, known, out)
    out[id(node)] = found
    return found


def matched(a: list[tuple[str, set]], b: list[tuple[str, set]]) -> list[tuple[int, int]]:
    """Of two lists of (label, texts): the order-preserving pairs of equal labels
    that share most texts in total, as the heaviest chain of pairs (a prefix
    maximum over the places of ``b``); equal ends always belong to one."""
    head, n, m = 0, len(a), len(b)
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    while min(n, m) > head and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    places: dict[tuple, list[int]] = {}
    for j in range(head, m):
        for text in b[j][1]:
            places.setdefault((b[j][0], text), []).append(j - head + 1)
    best: list[tuple] = [(0, None)] * (m - head + 1)

    def before(j: int) -> tuple:
        top = best[0]
        while j > 0:
            if best[j][0] > top[0]:
                top = best[j]
            j &= j - 1
        return top

    for i in range(head, n):
        gains: dict[int, int] = {}
        for text in a[i][1]:
            for j in places.get((a[i][0], text), ()):
                gains[j] = gains.get(j, 0) + 1
        for j in sorted(gains, reverse=True):
            weight, chain = before(j - 1)
            entry = (weight + gains[j], (i, j + head - 1, chain))
            while j < len(best):
                if best[j][0] < entry[0]:
                    best[j] = entry
                j += j & -j
    middle, chain = [], before(m - head)[1]
    while chain:
        middle.append(chain[:2])
        chain = chain[2]
    return [(i, i) for i in range(head)] + middle[::-1] + [(n + k, m + k) for k in range(len(a) - n)]


def pairs(slot: Slot, node: Node, texts: dict[int, set]) -> list[tuple[Slot, Node]]:
    """The aligned children of a wrapper node and a page's node that share a text."""
    own = [c for c in elements(node) if texts[id(c)]]
    return [(slot.children[i], own[j]) for i, j in matched([(s.label, s.texts) for s in slot.children], [(c.label, texts[id(c)]) for c in own])]


def common(slot: Slot, node: Node, texts: dict[int, set]) -> Slot:
    """What of the wrapper ``slot`` the page's ``node`` has as well."""
    return Slot(slot.label, slot.const if slot.const == digest(node) else 0, [common(s, c, texts) for s, c in pairs(slot, node, texts)])


def blocks(node: Node, skip: set[int]) -> list[str]:
    """Text blocks below ``node``: runs of text between block elements; nodes whose
    id is in ``skip`` give no own text."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        line = " ".join("".join(held).split())
        if line:
            out.append(line)
        held.clear()

    def enter(n: Node) -> tuple[Node, Iterator]:
        if n.tag not in INLINE:
            flush()
        if n.tag == "br":
            held.append(" ")
        return n, iter(n.children)

    stack = [enter(node)]       # pages may nest deeper than calls can
    while stack:
        n, rest = stack[-1]
        for c in rest:
            if isinstance(c, str):
                if id(n) not in skip:
                    held.append(c)
            elif not c.aside:
                stack.append(enter(c))
                break
        else:
            stack.pop()
            if n.tag not in INLINE:
                flush()
    flush()
    return out


def articles(root: Node) -> list[Node]:
    """The outermost article elements, else main elements, outside what is aside; else the page."""
    for tag in ("article", "main"):
        found: list[Node] = []
        stack = [root]
        while stack:
            n = stack.pop()
            if n.tag == tag:
                found.append(n)
            else:
                stack.extend(c for c in reversed(n.children) if isinstance(c, Node) and not c.aside)
        if found:
            return found
    return [root]


def lines_of(root: Node) -> set[str]:
    return {b for a in articles(root) for b in blocks(a, set()) if len(b) > 20}


def differs(lines: set[str], others: list[set[str]]) -> bool:
    """Whether ``lines`` are an article of their own beside ``others``: no copy, near copy or empty page."""
    return bool(lines) and all(2 * len(lines & other) <= min(len(lines), len(other)) for other in others)


def induce(pages: list[str], least: int = 4) -> str | None:
    """The wrapper of a host from a few of its pages, as JSON; None without
    ``least`` pages of different articles (copies of one article say nothing
    about what is constant) or without a constant node."""
    chosen: list[Node] = []
    seen: list[set[str]] = []
    for page in pages:
        root = parse(page)
        lines = lines_of(root)
        if differs(lines, seen):
            chosen.append(root)
            seen.append(lines)
    if len(chosen) < least:
        return None
    wrapper = Slot.of(chosen[0])
    for root in chosen[1:]:
        texts: dict[int, set] = {}
        shared(root, wrapper.texts, texts)
        wrapper = common(wrapper, root, texts)
    return json.dumps(wrapper.plain(), separators=(",", ":")) if wrapper.texts else None


#: Wrappers parsed by this task's process (a decorated cache could not be pickled by value).
LOADED: dict[str, Slot] = {}


def loaded(wrapper: str) -> Slot:
    if wrapper not in LOADED:
        if len(LOADED) >= 1024:
            LOADED.clear()
        LOADED[wrapper] = Slot.read(json.loads(wrapper))
    return LOADED[wrapper]


def template_nodes(slot: Slot, node: Node, texts: dict[int, set], out: set[int]) -> None:
    if slot.const and slot.const == digest(node):
        out.add(id(node))
    for s, c in pairs(slot, node, texts):
        template_nodes(s, c, texts, out)


def main_text(page: str | None, wrapper: str | None) -> str:
    if not page:
        return ""
    root, skip = parse(page), set()
    if wrapper:
        slot, texts = loaded(wrapper), {}
        shared(root, slot.texts, texts)
        template_nodes(slot, root, texts, skip)
    return "\n".join(b for a in articles(root) for b in blocks(a, skip))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1))


def wrappers(pages: DataFrame, per_host: int = 16) -> DataFrame:
    """``host, wrapper``: induced from at most ``per_host`` pages of each host:
    by content hash the first ones with different articles, however many copies
    and near copies stand between them.

    Each partition chooses first, so at most ``per_host`` pages of a host leave it."""
    rows = (pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).where("html IS NOT NULL")
            .select("host", F.xxhash64("html").alias("h"), "html"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """The chosen rows of a stream in order of host and hash."""
        host, last, seen = None, None, []
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                if row[0] != host:
                    host, last, seen = row[0], None, []
                if len(seen) == per_host or row[1] == last:
                    continue
                last, lines = row[1], lines_of(parse(row[2]))
                if differs(lines, seen):
                    seen.append(lines)
                    yield row

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = choose(batches)
        while part := list(itertools.islice(found, 200)):
            yield pd.DataFrame(part, columns=["host", "h", "html"])

    def of_hosts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for host, own in itertools.groupby(choose(batches), key=lambda row: row[0]):
            found = induce(sorted(row[2] for row in own))
            if found:
                yield pd.DataFrame({"host": [host], "wrapper": [found]})

    chosen = rows.sortWithinPartitions("host", "h").mapInPandas(some, "host string, h long, html string")
    return chosen.repartition("host").sortWithinPartitions("host", "h").mapInPandas(of_hosts, "host string, wrapper string")


def extract(pages: DataFrame, per_host: int = 16) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages``.

    The wrapper table is joined by host: broadcast while its files are small,
    else by a join that splits a host with many pages.  Null or empty pages have
    empty text; a null or odd url falls to the host '' like any other; repeated
    rows repeat; a page without article and main element gives all text that is
    neither template nor aside; no rows give none."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    found = stored(wrappers(pages, per_host), "html-wrappers")
    joined = rows.join(small_side(found), "host", "left")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [main_text(h, w) for h, w in zip(batch["html"], batch["wrapper"])]
            yield pd.DataFrame({"page_id": batch["page_id"].array, "url": batch["url"].array, "text": out, "n_chars": [len(t) for t in out]})

    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "wrapper").mapInPandas(texts, f"page_id {kind}, url string, text string, n_chars long")
