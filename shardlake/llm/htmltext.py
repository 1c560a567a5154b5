"""Main text of web pages by wrappers that are inferred for each host.

A page becomes a tree of block elements with text slots; neighbours that repeat become one
repeated item. The trees of a host's pages are aligned one after another: what one lacks becomes
optional, what recurs becomes repeated, text becomes a slot that is constant or varies. The
wrapper, a regular expression without unions, then tells where the article is: in the elements
that the page itself marks as one, else in the block that holds nearly all prose that varies
from page to page. That block stays whole; what is around it goes.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OUT_ROWS, column, cut, fresh, scalars, schema_of, table

# Names of HTML elements and words that mark page furniture.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg audio video canvas select datalist".split())
UNWANTED = frozenset("head nav footer aside form button fieldset menu dialog legend option".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "body": {"head", "p"}}
BARRIERS = frozenset("ul ol dl table article section div main body html nav aside footer header form blockquote".split())
UNWANTED_WORDS = frozenset(
    "nav navigation navbar menu sidebar footer ad ads advert adverts advertisement advertising sponsor sponsored banner cookie cookies consent gdpr notice "
    "notification alert promo promotion popup modal overlay comment comments disqus reply replies respond share sharing social related recommended "
    "newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager toolbar widget widgets skip complementary contentinfo search".split()
)
HEADER_WORDS = frozenset("header masthead topbar".split())
#: Elements that may hold an article among other things.
SECTIONS = frozenset("html body div section main article center table tbody tr td span".split())
PAGE_LEVEL = frozenset("root html body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Beginnings of class names that tell how a page is laid out, not what an element is.
LAYOUT = ("with-", "has-", "no-", "is-", "js-")

#: Elements nested deeper than this are taken as part of the one at this depth; their text stays.
DEEPEST = 48
#: Share of the varying prose that a block must hold for the article to be inside it.
MOST_PROSE = 0.6
#: Pairs of kids that an alignment compares; of longer sequences each kid takes the next that fits.
MOST_PAIRS = 4_000_000
#: Wrappers that are sent to all executors at once are no larger than this; larger sets travel with their hosts' pages.
SENT_BYTES = 32 << 20
#: Trees of shapes that a task holds before it passes them on; shares of a host's shapes aligned first.
HELD_SHAPES, SHARES = 20_000, 64
#: Pages of a host that one task should take where wrappers travel with pages, and hosts that may have more at most.
HOST_PAGES, HOT_HOSTS = 5_000, 10_000
#: Hosts whose wrappers a worker keeps ready.
READY_HOSTS = 256

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_HOST = re.compile(r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


@dataclass
class Node:
    """An element (key, kids), a slot (key "#") or a repeated group (key "()"), perhaps optional or repeated.

    A slot's digest is that of its text, or of its texts in turn where it repeats; None where pages differ.
    ``chars`` counts the characters of its texts outside links.
    """

    key: str
    kids: list[Node] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False
    digest: int | None = None
    pages: int = 1
    chars: int = 0
    texts: list[int] = field(default_factory=list)
    shape: str = ""

    def mark(self) -> Node:
        """Write the shape down."""
        inside = "".join(k.shape for k in self.kids)
        self.shape = ("#" if self.key == "#" else f"<{self.key}:{inside}>") + "+" * self.repeated + "?" * self.optional
        return self

    def close(self) -> Node:
        """Fold repeats among the kids and write the shape down."""
        self.kids = fold(self.kids)
        return self.mark()

    def slots(self) -> Iterator[Node]:
        if self.key == "#":
            yield self
        for k in self.kids:
            yield from k.slots()

    @property
    def name(self) -> str:
        return self.key.partition(".")[0]

    @property
    def words(self) -> set[str]:
        return set(self.key.split(".")[1:])

    @property
    def fit(self) -> str:
        """What must be equal for two nodes to stand for each other."""
        return self.key if self.key != "()" else "(" + " ".join(k.key for k in self.kids) + ")"


def slot(digest: int, text: int, chars: int) -> Node:
    return Node("#", digest=digest, texts=[text], chars=chars, shape="#")


def absorb(a: Node, b: Node) -> None:
    """Add b, the next of the same shape on the page, to a."""
    for x, y in zip(a.slots(), b.slots(), strict=True):
        x.digest = None if x.digest is None or y.digest is None else (x.digest * 1_000_003 ^ y.digest) & (1 << 62) - 1
        x.chars += y.chars
        x.texts += y.texts


def _repeated(node: Node) -> Node:
    if not node.repeated:
        node.repeated = True
        node.shape += "+"
    return node


def _core(node: Node) -> str:
    return node.shape.rstrip("+?")


def fold(seq: list[Node]) -> list[Node]:
    """Neighbours that repeat, one by one or in groups of two or three, as one repeated item."""
    for period in (1, 2, 3):
        out: list[Node] = []
        i = 0
        while i < len(seq):
            unit = [_core(n) for n in seq[i : i + period]]
            j = i + period
            while len(unit) == period and [_core(n) for n in seq[j : j + period]] == unit:
                j += period
            if j == i + period:
                out.append(seq[i])
                i += 1
                continue
            head = seq[i : i + period]
            for k in range(i + period, j):
                absorb(head[(k - i) % period], seq[k])
            out.append(_repeated(head[0] if period == 1 else Node("()", head).close()))
            i = j
        seq = out
    return seq


def _pairs(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Places of the nodes that stand for each other, in order: a longest common subsequence."""
    x, y = [n.fit for n in a], [n.fit for n in b]
    head, tail, short = 0, 0, min(len(x), len(y))
    while head < short and x[head] == y[head]:
        head += 1
    while tail < short - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    n, m = len(x) - head - tail, len(y) - head - tail
    x, y = x[head : head + n], y[head : head + m]
    out = [(i, i) for i in range(head)]
    if n * m > MOST_PAIRS:
        places: dict[str, list[int]] = {}
        for j, key in enumerate(y):
            places.setdefault(key, []).append(j)
        j = 0
        for i, key in enumerate(x):
            of = places.get(key, [])
            k = bisect_left(of, j)
            if k < len(of):
                out.append((head + i, head + of[k]))
                j = of[k] + 1
    elif n and m:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            row, below, key = best[i], best[i + 1], x[i]
            for j in range(m - 1, -1, -1):
                row[j] = below[j + 1] + 1 if key == y[j] else max(below[j], row[j + 1])
        i = j = 0
        while i < n and j < m:
            if x[i] == y[j]:
                out.append((head + i, head + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return out + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """One sequence that covers both: nodes that stand for each other merged, the rest optional."""
    out, i, j = [], 0, 0
    for p, q in [*_pairs(a, b), (len(a), len(b))]:
        for node in (*a[i:p], *b[j:q]):
            node.optional = True
            out.append(node.mark())
        if p < len(a):
            out.append(merge(a[p], b[q]))
        i, j = p + 1, q + 1
    return out


def merge(a: Node, b: Node) -> Node:
    a.kids = align(a.kids, b.kids)
    a.optional |= b.optional
    a.repeated |= b.repeated
    a.digest = a.digest if a.digest == b.digest else None
    a.pages += b.pages
    a.chars += b.chars
    return a.mark()


def dump(node: Node) -> list:
    return [node.key, int(node.optional), int(node.repeated), node.digest, node.pages, node.chars, [dump(k) for k in node.kids]]


def load(x: list) -> Node:
    return Node(x[0], [load(k) for k in x[6]], bool(x[1]), bool(x[2]), x[3], x[4], x[5]).mark()


def _key(name: str, attributes: str) -> str:
    """The element's name and the words of its class, id and role that tell furniture from article."""
    words = set()
    if "=" in attributes and name not in ("html", "body"):
        for _, a, b, c in _ATTRIBUTE.findall(attributes):
            words |= {w.lower() for token in (a or b or c).split() if not token.lower().startswith(LAYOUT) for w in _WORD.findall(token)}
    words &= UNWANTED_WORDS | HEADER_WORDS | {"main"}
    return ".".join([name, *sorted(words)])


def parse(page: str) -> tuple[Node, list[str]]:
    """The folded tree of a page and its texts, one for each run between block boundaries, in page order."""
    root = Node("root")
    stack, texts, run = [root], [], []
    at, size, links, linked = 0, len(page), 0, 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                digest = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 2
                stack[-1].kids.append(slot(digest, len(texts), max(0, len(text) - linked)))
                texts.append(text)
        linked = 0

    def pop() -> None:
        node = stack.pop().close()
        if node.kids:
            stack[-1].kids.append(node)

    depth: list[str] = []  # names of the open elements; those beyond DEEPEST have no node
    match = _TOKEN.match
    while at < size:
        token = match(page, at)
        at = token.end()
        name = token[2]
        if name is None:
            text = token[0]
            if text.startswith("<![CDATA["):
                text = text[9:-3] if text.endswith("]]>") else text[9:]
            elif text[0] == "<" and text != "<":
                continue
            run.append(text)
            linked += len(text) if links else 0
            continue
        name = name.lower()
        if name == "a":
            links = 0 if token[1] else 1
        if token[1]:
            if name in INLINE:
                continue
            flush()
            if name in depth:
                while depth.pop() != name:
                    if len(depth) < DEEPEST:
                        pop()
                if len(depth) < DEEPEST:
                    pop()
            continue
        if name in RAW:
            if not token[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                at = end.start() if end else size
                if end:
                    at = page.find(">", end.start()) + 1 or size
            continue
        if name in INLINE:
            if name in ("br", "wbr", "img"):
                run.append(" ")
            continue
        flush()
        if name in VOID:
            continue
        closes = CLOSES.get(name) or ({"p"} if name in BARRIERS or name[:1] == "h" else set())
        while depth and depth[-1] in closes:
            depth.pop()
            if len(depth) < DEEPEST:
                pop()
        if not token[3].endswith("/"):
            if len(depth) < DEEPEST:
                stack.append(Node(_key(name, token[3])))
            depth.append(name)
    flush()
    while len(stack) > 1:
        pop()
    return root.close(), texts


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def infer(shapes: list[Node]) -> Node:
    """The wrapper of trees of different shapes: the most frequent first, the others aligned to it in turn."""
    shapes = sorted(shapes, key=lambda n: (-n.pages, n.shape))
    wrapper = shapes[0]
    for s in shapes[1:]:
        wrapper = merge(wrapper, s)
    return wrapper


def is_template(node: Node, total: int) -> bool:
    """Whether a slot has the same text on most of a host's pages, which are several."""
    return node.digest is not None and total > 1 and 2 * node.pages > total


def expression(node: Node, total: int | None = None) -> str:
    """The wrapper as a regular expression over tags."""
    total = node.pages if total is None else total
    inside = "".join(expression(k, total) for k in node.kids)
    body = {"#": "#TEMPLATE" if is_template(node, total) else "#TEXT", "root": inside, "()": inside}.get(node.key, f"<{node.key}>{inside}</{node.name}>")
    return f"({body}){'+' * node.repeated}{'?' * node.optional}" if node.repeated or node.optional else body


class Choice:
    """Which slots of a tree are the article's: a set of the ids of those nodes.

    ``templates`` are the ids of slots that are the same on most pages of the host. Menus, forms and
    the like, told by their element or by a word of their class, id or role, are never the article's.
    """

    def __init__(self, root: Node, templates: set[int], by_words: bool = True) -> None:
        self.templates, self.by_words = templates, by_words
        self.prose: dict[int, int] = {}
        self.furniture: set[int] = set()
        self.some: dict[int, int] = {}
        self._survey(root, False)
        self.kept: set[int] = set()
        regions = list(self._topmost(root, lambda n: n.name == "article")) or list(self._topmost(root, lambda n: n.name == "main" or "main" in n.words))
        if regions:
            for r in regions:
                self._keep(r)
        else:
            self._keep_prose(root)

    def _survey(self, node: Node, below: bool) -> None:
        """For every node the varying prose and the number of slots below it that are no furniture."""
        below |= node.name in UNWANTED or self.by_words and bool(node.words & UNWANTED_WORDS)
        if below:
            self.furniture.add(id(node))
        prose, some = 0, 0
        if node.key == "#" and not below:
            prose, some = 0 if id(node) in self.templates else node.chars, 1
        for k in node.kids:
            self._survey(k, below)
            prose, some = prose + self.prose[id(k)], some + self.some[id(k)]
        self.prose[id(node)], self.some[id(node)] = prose, some

    def _topmost(self, node: Node, wanted) -> Iterator[Node]:
        if not self.some[id(node)]:
            return
        if wanted(node):
            yield node
            return
        for k in node.kids:
            yield from self._topmost(k, wanted)

    def _keep(self, node: Node, headers: bool = True) -> None:
        if id(node) in self.furniture or not headers and (node.name == "header" or self.by_words and node.words & HEADER_WORDS):
            return
        if node.key == "#":
            self.kept.add(id(node))
        for k in node.kids:
            self._keep(k, headers)

    def _keep_prose(self, node: Node) -> None:
        """Go down to the block that holds the varying prose; without any that is constant there is nothing to tell it by."""
        evidence = bool(self.templates) and self.prose[id(node)] > 0
        while evidence:
            inner = max((k for k in node.kids if k.name in SECTIONS and not k.repeated), key=lambda k: self.prose[id(k)], default=None)
            if inner is None or self.prose[id(inner)] < MOST_PROSE * self.prose[id(node)]:
                break
            for k in node.kids[: node.kids.index(inner)]:  # a heading that varies is the article's, wherever it stands
                if k.name in HEADINGS and self.prose[id(k)]:
                    self._keep(k)
            node = inner
        kids = node.kids
        if node.key not in PAGE_LEVEL:
            return self._keep(node)
        if evidence:
            # No block of its own: what is constant before and after all that varies is around the article.
            stays = [self.prose[id(k)] > 0 or k.name in HEADINGS for k in kids]
            if any(stays):
                kids = kids[stays.index(True) : len(kids) - stays[::-1].index(True)]
        for k in kids:
            self._keep(k, headers=False)
        return None


def article_slots(root: Node, templates: set[int]) -> set[int]:
    """Ids of the article's slots. Where a word says that all is furniture, it says nothing."""
    kept = Choice(root, templates).kept
    return kept or Choice(root, templates, by_words=False).kept


def _matched(page: Node, wrapper: Node, out: dict[int, Node]) -> None:
    """For every slot of a page's tree the slot of the wrapper that stands for it."""
    if page.key == "#":
        out[id(page)] = wrapper
    for i, j in _pairs(page.kids, wrapper.kids):
        _matched(page.kids[i], wrapper.kids[j], out)


class Extractor:
    """Which slots of a page of one host are the article's, remembered for each shape."""

    def __init__(self, wrapper: str | None) -> None:
        self.wrapper = load(json.loads(wrapper)) if wrapper else None
        self.templates: set[int] = set()
        self.kept: set[int] = set()
        if self.wrapper:
            self.templates = {id(s) for s in self.wrapper.slots() if is_template(s, self.wrapper.pages)}
            self.kept = article_slots(self.wrapper, self.templates)
        self.known: dict[str, list[bool]] = {}

    def _choose(self, tree: Node) -> list[bool]:
        found: dict[int, Node] = {}
        if self.wrapper:
            _matched(tree, self.wrapper, found)
        keep = [id(found.get(id(s))) in self.kept for s in tree.slots()]
        if not any(keep):  # a page that lacks what the others have is judged by itself
            kept = article_slots(tree, {i for i, s in found.items() if id(s) in self.templates})
            keep = [id(s) in kept for s in tree.slots()]
        return keep

    def text(self, page: str) -> str:
        tree, texts = parse(page)
        keep = self.known.get(tree.shape)
        if keep is None:
            if len(self.known) > HELD_SHAPES:
                self.known.clear()
            keep = self.known[tree.shape] = self._choose(tree)
        chosen = sorted(t for s, k in zip(tree.slots(), keep, strict=True) if k for t in s.texts)
        return "\n\n".join(texts[t] for t in chosen)


_SHAPE = pa.schema([("host", pa.string()), ("share", pa.int32()), ("shape", pa.string()), ("tree", pa.string())])


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each host and shape of a task, with what the texts of its pages have in common."""
    held: dict[tuple[str, str], Node] = {}

    def out() -> pa.RecordBatch:
        rows = [(h, xxhash.xxh32_intdigest(f"{h}{s}") % SHARES, s, json.dumps(dump(n))) for (h, s), n in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SHAPE)], schema=_SHAPE)

    for b in batches:
        for url, page in zip(column(b, "url").to_pylist(), column(b, "html"), strict=True):
            tree, _ = parse(page.as_py() or "")
            key = (host_of(url), tree.shape)
            if key in held:
                _same(held[key], tree)
            else:
                held[key] = tree
            if len(held) >= HELD_SHAPES:
                yield out()
    if held:
        yield out()


def _same(a: Node, b: Node) -> None:
    """Add the pages of b, of the same shape, to a."""
    a.pages += b.pages
    a.chars += b.chars
    a.digest = a.digest if a.digest == b.digest else None
    a.texts = []
    for x, y in zip(a.kids, b.kids, strict=True):
        _same(x, y)


def _together(rows: pa.Table) -> list[Node]:
    held: dict[str, Node] = {}
    for shape, tree in zip(rows["shape"].to_pylist(), rows["tree"].to_pylist(), strict=True):
        node = load(json.loads(tree))
        if shape in held:
            _same(held[shape], node)
        else:
            held[shape] = node
    return list(held.values())


def _share(rows: pa.Table) -> pa.Table:
    """The wrapper of one share of a host's shapes."""
    node = infer(_together(rows))
    return pa.table({"host": rows["host"][:1], "share": pa.array([0], pa.int32()), "shape": [node.shape], "tree": [json.dumps(dump(node))]})


def _wrapper(rows: pa.Table) -> pa.Table:
    node = infer(_together(rows))
    return pa.table({"host": rows["host"][:1], "pages": pa.array([node.pages], pa.int64()), "expression": [expression(node)], "wrapper": [json.dumps(dump(node))]})


def wrappers(pages: DataFrame) -> DataFrame:
    """host, pages, expression and wrapper (as JSON) for every host of ``pages`` (url, html).

    All pages count. Tasks first reduce their pages to distinct shapes; a host's shapes are aligned in
    shares, then the shares' wrappers, so that a host with very many pages or shapes has many tasks. A
    null url has the empty host, a null html the empty page.
    """
    shapes = pages.select("url", "html").mapInArrow(_shapes, "host string, share int, shape string, tree string")
    shares = shapes.groupBy("host", "share").applyInArrow(_share, "host string, share int, shape string, tree string")
    return shares.groupBy("host").applyInArrow(_wrapper, "host string, pages long, expression string, wrapper string")


def _answers(names: list[str], extractor_of, batch: pa.RecordBatch, hosts: list[str]) -> pa.RecordBatch:
    """The batch with its texts, those of one host after another so that its extractor stays at hand."""
    html, texts = column(batch, "html"), [""] * batch.num_rows
    for i in sorted(range(len(hosts)), key=hosts.__getitem__):
        texts[i] = extractor_of(hosts[i]).text(html[i].as_py() or "")
    own = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
    return pa.RecordBatch.from_arrays([own[n] if n in own else column(batch, n) for n in names], names=names)


def _sent(wrapper_of: dict[str, str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: OrderedDict[str, Extractor] = OrderedDict()

        def extractor_of(host: str) -> Extractor:
            found = ready.get(host)
            if found is None:
                if len(ready) >= READY_HOSTS:
                    ready.popitem(last=False)
                found = ready[host] = Extractor(wrapper_of.get(host))
            ready.move_to_end(host)
            return found

        for whole in batches:
            for b in (whole.slice(i, OUT_ROWS // 8) for i in range(0, whole.num_rows, OUT_ROWS // 8)):
                yield _answers(names, extractor_of, b, [host_of(u) for u in column(b, "url").to_pylist()])

    return run


def _with_host(salts_of: dict[str, int], host: str, salt: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts = [host_of(u) for u in column(b, "url").to_pylist()]
            salts = [xxhash.xxh32_intdigest(p.as_buffer() if p.is_valid else b"") % salts_of.get(h, 1) for h, p in zip(hosts, column(b, "html"), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hosts, pa.string()), pa.array(salts, pa.int32())], names=[*b.schema.names, host, salt])

    return run


def _travelling(names: list[str], host: str, wrapper: str):
    """Rows come sorted by host, its wrapper before its pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, extractor = None, Extractor(None)
        for whole in batches:
            for b in (whole.slice(i, OUT_ROWS // 8) for i in range(0, whole.num_rows, OUT_ROWS // 8)):
                hosts, is_wrapper = column(b, host).to_pylist(), column(b, wrapper).is_valid().to_pylist()
                starts = [i for i in range(len(hosts)) if is_wrapper[i] or (i and is_wrapper[i - 1])]
                for i, z in zip([0, *starts], [*starts, len(hosts)], strict=True):
                    if i < z and is_wrapper[i]:
                        now, extractor = hosts[i], Extractor(column(b, wrapper)[i].as_py())
                    elif i < z:
                        assert set(hosts[i:z]) == {now}
                        yield _answers(names, lambda _, e=extractor: e, b.slice(i, z - i), hosts[i:z])

    return run


def main_text(pages: DataFrame, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``pages`` less html, with text (the article's blocks joined by two \\n) and n_chars.

    Blocks are runs of text between block elements, character references decoded, white space
    turned into one blank. A null html gives an empty text. Every row gives a row, repeated ones too;
    columns text and n_chars of the input are replaced, others pass through. A host with one page, or
    whose pages are all alike, has nothing that tells its template from an article: without a marked
    article only what is named as furniture goes.
    """
    pages = pages.drop("text", "n_chars")
    found = cut(wrappers(pages).select("host", "pages", "wrapper"))
    size, total = scalars(found, F.coalesce(F.sum(F.length("wrapper") + F.length("host")), F.lit(0)), F.coalesce(F.sum("pages"), F.lit(0)))
    schema = schema_of(pages, {"html"}, "text string, n_chars long")
    if size <= sent_bytes:
        return pages.mapInArrow(_sent({r["host"]: r["wrapper"] for r in found.select("host", "wrapper").collect()}, schema.names), schema)
    # A host with more pages than this is dealt to several tasks; no more than HOT_HOSTS can have so many.
    most = max(HOST_PAGES, -(-total // HOT_HOSTS))
    salts_of = {r["host"]: -(-r["pages"] // most) for r in found.where(F.col("pages") > most).select("host", "pages").collect()}
    host, salt, wrapper = fresh(pages, "host", "salt", "wrapper")
    hosted = pages.mapInArrow(_with_host(salts_of, host, salt), schema_of(pages, set(), f"{host} string, {salt} int")).withColumn(wrapper, F.lit(None).cast("string"))
    salts = F.greatest(F.lit(1), F.ceil(F.col("pages") / most).cast("int"))
    first = found.select(F.col("host").alias(host), F.explode(F.sequence(F.lit(0), salts - 1)).alias(salt), F.col("wrapper").alias(wrapper))
    both = hosted.unionByName(first, allowMissingColumns=True)
    dealt = both.repartition(host, salt).sortWithinPartitions(F.col(host), F.col(salt), F.col(wrapper).isNull())
    return dealt.mapInArrow(_travelling(schema.names, host, wrapper), schema)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
