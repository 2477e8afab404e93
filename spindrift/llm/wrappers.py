"""HTML extraction by inferred wrappers (union-free regular expressions).

A page is a tree of elements and text slots. Within a page, neighbouring
siblings of one kind become a repeated part, and runs of siblings that come
again become a repeated group. The pages of one host are then aligned one after
another into the host's wrapper: parts on one side only become optional, parts
that one side has several times become repeated, kinds that come in any order
become a repeated group of optional parts, and texts that differ between pages
make a slot variable. So a wrapper has at most some parts of each kind inside
each element, however many pages there are.

What the pages of a host have at a slot decides whether it is read: how many
distinct pages it is on, whether its text ever differs, how much text it holds
and whether it is a link. Element names and class words are features besides.

Wrappers are merged inside the tasks before the shuffle, then in a tree of 64
at a time, so a host with very many pages is spread.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Siblings of one kind, and of one label, that stay apart at most; beyond that
#: they and what is between them become a repeated group.
APART, LABELS = 3, 8
#: Content of elements nested deeper belongs to the element of this depth.
DEPTH = 60
#: Distinct streams that a task holds at most, and wrappers merged at once.
HELD, FAN = 2000, 64
#: Wrappers of so many characters in all are broadcast at most.
BROADCAST_CHARS = 32 << 20
SALTS = 16
#: Distinct contents of pages that a text must repeat on to be template.
REPEATS = 3

# Element names and class words by their role.
_SKIPPED = frozenset("script style template noscript textarea select svg iframe object canvas math audio video title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_BOILER = frozenset("nav header footer aside form button menu dialog head fieldset".split())
_MAIN = frozenset("article main".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_SCOPES = frozenset("ul ol dl table body html article div section td".split())
_WORDS = frozenset("ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice notices pagination popup promo related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Boilerplate that an article inside does not end: navigation, asides, footers, comments.
_DEEP = frozenset("nav aside footer menu navbar navigation breadcrumb breadcrumbs pagination sidebar related comment comments disqus replies respond complementary contentinfo".split())
#: A class with such a part tells of a state, as in "no-sidebar".
_STATES = frozenset("has hide is no non not one show two with without".split())
#: Elements that may stand in a head.
_HEADED = frozenset("base link meta".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLASS = re.compile(r"""(?:^|[\s"'])class\s*=\s*["']?\s*([^\s"'>]+)""", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PART = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s+")


@lru_cache(maxsize=20000)
def _kind(name: str, attributes: str) -> str:
    """m: starts an article, b: starts boilerplate, d: starts boilerplate that
    articles inside belong to, else empty. Class words don't count on the
    elements that hold a page or its article."""
    if name in _BOILER:
        return "d" if name in _DEEP else "b"
    named = {key.lower(): "".join(values) for key, *values in reversed(_NAMED.findall(attributes))}
    role = set(named.get("role", "").lower().split())
    if "main" in role:
        return "m"
    if name in ("html", "body"):
        return ""
    words = role & _ROLES
    if name not in _MAIN:
        words |= {w for key in ("class", "id") for token in named.get(key, "").split() if (w := _head_word(token)) in _WORDS}
    if words:
        return "d" if words & _DEEP else "b"
    return "m" if name in _MAIN else ""


def _head_word(token: str) -> str:
    """Last word of a class or id (site-footer: footer, sidebar-2: sidebar,
    page-header-fixed: fixed), empty for states (no-sidebar)."""
    parts = [p.lower() for p in _PART.findall(_HUMP.sub("-", token.partition("--")[0]))]
    return "" if not parts or _STATES.intersection(parts[:-1]) else parts[-1]


@lru_cache(maxsize=20000)
def _label(name: str, attributes: str) -> str:
    """Element name, with the letters of its first class."""
    found = _CLASS.search(attributes)
    own = "-".join(_PART.findall(found[1].lower())) if found else ""
    return f"{name}.{own}" if own else name


class Block:
    """A text block of a page: region (c article, b boilerplate, o other)."""

    __slots__ = ("text", "link", "region", "number")

    def __init__(self, region: str, number: int) -> None:
        self.text: list[str] = []
        self.link, self.region, self.number = 0, region, number


class _Node:
    __slots__ = ("name", "label", "region", "items", "parent", "deep", "depth")

    def __init__(self, name: str, label: str, region: str, parent: _Node | None, deep: bool = False) -> None:
        self.name, self.label, self.region, self.parent, self.deep = name, label, region, parent, deep
        self.depth = parent.depth + 1 if parent is not None else 0
        self.items: list[_Node | Block] = []


def parse(page: str) -> _Node:
    """Block tree of a page; its texts are numbered in page order."""
    root = node = _Node("", "", "o", None)
    current: Block | None = None
    anchor = at = count = 0

    def said(text: str) -> None:
        nonlocal current, count, node
        if current is None:
            if not text or text.isspace():
                return
            if node.name == "head":
                node = node.parent
            current = Block(node.region, count)
            node.items.append(current)
            count += 1
        current.text.append(text)
        if anchor:
            current.link += len(text)

    while True:
        found = _TAG.search(page, at)
        if found is None:
            said(page[at:])
            return root
        said(page[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        ending, attributes = bool(found[1] or found[4]), found[3] or found[6] or ""
        if name in _SKIPPED:
            if not ending and not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = close.end() if close else len(page)
            continue
        if node.name == "head" and not ending and name not in _HEADED:
            node = node.parent
        if name in _INLINE:
            if name == "a":
                anchor = 0 if ending else 1
            elif name == "br" and current is not None:
                current.text.append(" ")
            continue
        current, anchor = None, 0
        if ending:
            up = node
            while up.parent is not None and up.name != name:
                up = up.parent
            if up.parent is not None:
                node = up.parent
            continue
        if name in _CLOSES_P or name in _SIBLINGS:
            shut = set(_SIBLINGS.get(name, "p").split()) if name in _SIBLINGS else {"p"}
            up = node
            while up.parent is not None and up.name not in shut and up.name not in _SCOPES:
                up = up.parent
            if up.parent is not None and up.name in shut:
                node = up.parent
        if name in _VOID:
            continue
        kind = _kind(name, attributes)
        deep = node.deep or kind == "d"
        if kind == "m":
            region = "b" if deep else "c"
        else:
            region = "b" if kind else node.region
        child = _Node(name, _label(name, attributes), region, node, deep)
        node.items.append(child)
        node = child


def flat(items: list[Part]) -> list[Part]:
    """Parts with those of groups in their groups' place."""
    return [j for i in items for j in (flat(i.items) if i.label == "()" else [i])]


class Part:
    """Part of a page or wrapper: an element by its label, a group of siblings
    ("()"), or a text slot ("#", region, and "a" where most is a link). A slot
    of a wrapper has ``stats``: pages, code points, least and most text hash (15
    hex digits), and the least ``REPEATS`` distinct digests of these pages'
    contents, so that copies of a page count once; one of a page has blocks."""

    __slots__ = ("label", "optional", "repeated", "items", "stats", "blocks", "kinds", "shape", "role")

    def __init__(self, label: str, items: list[Part], optional: bool = False, repeated: bool = False, stats: list | None = None, blocks: list[Block] | None = None) -> None:
        self.label, self.items, self.optional, self.repeated, self.stats, self.blocks, self.role = label, items, optional, repeated, stats, blocks, ""
        # groups don't count as a level: a page may have their parts singly
        self.kinds = frozenset(x for i in flat(items) for x in (i.label, *(f"{i.label}/{j.label}" for j in flat(i.items))))
        self.shape = label + "?" * optional + "+" * repeated + (f"[{' '.join(i.shape for i in items)}]" if label[:1] != "#" else "")

    def slots(self) -> list[Part]:
        out: list[Part] = []
        todo = [self]
        while todo:
            part = todo.pop()
            if part.label[:1] == "#":
                out.append(part)
            todo.extend(reversed(part.items))
        return out


def _leaf(part: Part) -> bool:
    return all(i.label[0] == "#" for i in part.items)


def _overlap(a: Part, b: Part) -> float:
    if a.shape == b.shape or (_leaf(a) and _leaf(b)):
        return 1.0
    return len(a.kinds & b.kinds) / max(1, len(a.kinds | b.kinds))


def twins(a: Part, b: Part) -> bool:
    """Whether two siblings are of one kind: the same label, and much the same inside."""
    return a.label == b.label != "()" and _overlap(a, b) >= 0.4


def _least(digests: set[str]) -> list[str]:
    return sorted(digests)[:REPEATS]


def joined(a: list | None, b: list | None) -> list | None:
    """Stats of two slots as one."""
    if a is None or b is None:
        return a or b
    return [a[0] + b[0], a[1] + b[1], min(a[2], b[2]), max(a[3], b[3]), *_least({*a[4:], *b[4:]})]


def merge(a: Part, b: Part, repeated: bool = False) -> Part:
    """One part of two of the same label; groups take other parts in."""
    flags = a.optional or b.optional, repeated or a.repeated or b.repeated
    if a.label[:1] == "#":
        blocks = a.blocks + b.blocks if a.blocks is not None and b.blocks is not None else None
        return Part(a.label, [], *flags, joined(a.stats, b.stats), blocks)
    if a.label == "()" or b.label == "()":
        items: list[Part] = []
        for x in (a.items if a.label == "()" else [a]) + (b.items if b.label == "()" else [b]):
            _take_in(items, x)
        return Part("()", items, flags[0], True)
    return Part(a.label, merge_lists(a.items, b.items), *flags)


def _take_in(items: list[Part], x: Part) -> None:
    """Put a part into the kinds of a repeated group."""
    same = [k for k, i in enumerate(items) if i.label == x.label]
    near = [k for k in same if twins(items[k], x)] or (same if len(same) >= LABELS else [])
    if near:
        items[near[0]] = merge(items[near[0]], x, True)
    else:
        items.append(Part(x.label, x.items, True, x.repeated, x.stats, x.blocks))


def _score(x: Part, y: Part, alone: bool) -> float:
    """How well two parts go together, 0 not at all; ``alone``: no sibling of
    either has the label, so it decides."""
    if x.label == "()" or y.label == "()":
        mine, other = {i.label for i in x.items} if x.label == "()" else {x.label}, {i.label for i in y.items} if y.label == "()" else {y.label}
        return (1 + len(mine & other) / len(mine | other)) if mine & other else 0.0
    if x.label != y.label:
        return 0.0
    near = _overlap(x, y)
    return 1 + near if near >= 0.4 or alone else 0.0


def align(xs: list[Part], ys: list[Part]) -> list[tuple[int, int]]:
    """Pairs of parts of two lists in order, of the greatest total score; a
    repeated part may go with several."""
    if [x.shape for x in xs] == [y.shape for y in ys]:
        return [(i, i) for i in range(len(xs))]
    labels = [p.label for p in xs], [p.label for p in ys]
    score = [[_score(x, y, labels[0].count(x.label) == labels[1].count(x.label) == 1) for y in ys] for x in xs]
    best = [[0.0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    step = [[(1, 1)] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i in range(len(xs) - 1, -1, -1):
        for j in range(len(ys) - 1, -1, -1):
            options = [(best[i + 1][j], (1, 0)), (best[i][j + 1], (0, 1))]
            if own := score[i][j]:
                options.append((own + best[i + 1][j + 1], (1, 1)))
                if ys[j].repeated:
                    options.append((own + best[i + 1][j], (2, 0)))
                if xs[i].repeated:
                    options.append((own + best[i][j + 1], (0, 2)))
            best[i][j], step[i][j] = max(options)
    out = []
    i = j = 0
    while i < len(xs) and j < len(ys):
        a, b = step[i][j]
        if score[i][j] and (a, b) not in ((1, 0), (0, 1)):
            out.append((i, j))
        i, j = i + min(a, 1), j + min(b, 1)
    return out


def merge_lists(xs: list[Part], ys: list[Part]) -> list[Part]:
    """Siblings of two pages as one list."""
    out: list[Part] = []
    i = j = 0
    last = (-1, -1, -1)
    for a, b in align(xs, ys):
        out += [Part(x.label, x.items, True, x.repeated, x.stats, x.blocks) for x in xs[i:a] + ys[j:b]]
        if a == last[0]:
            out[last[2]] = merge(out[last[2]], ys[b], True)
        elif b == last[1]:
            out[last[2]] = merge(out[last[2]], xs[a], True)
        else:
            out.append(merge(xs[a], ys[b]))
            last = (a, b, len(out) - 1)
        last = (a, b, last[2])
        i, j = a + 1, b + 1
    out += [Part(x.label, x.items, True, x.repeated, x.stats, x.blocks) for x in xs[i:] + ys[j:]]
    return squeeze(out)


def squeeze(items: list[Part]) -> list[Part]:
    """Siblings with what repeats as repeated parts and groups."""
    out: list[Part] = []
    for item in items:
        out.append(item)
        again = True
        while again:
            again = False
            if len(out) > 1 and twins(out[-2], out[-1]):
                out[-2:] = [merge(out[-2], out[-1], True)]
                again = True
                continue
            for width in (2, 3):
                back = out[-width:]
                group = out[-width - 1] if len(out) > width else None
                if group is not None and group.label == "()" and len(group.items) == width and all(map(twins, group.items, back)):
                    out[-width - 1 :] = [Part("()", [merge(x, y) for x, y in zip(group.items, back, strict=True)], group.optional, True)]
                    again = True
                    break
                if len(out) >= 2 * width and all(map(twins, out[-2 * width : -width], back)):
                    out[-2 * width :] = [Part("()", [merge(x, y) for x, y in zip(out[-2 * width : -width], back, strict=True)], False, True)]
                    again = True
                    break
    while (span := _crowd(out)) is not None:
        first, last = span
        kinds: list[Part] = []
        for p in out[first:last]:
            for x in p.items if p.label == "()" else [p]:
                _take_in(kinds, x)
        # neighbours of these kinds belong to the group
        while last < len(out) and any(twins(k, out[last]) for k in kinds):
            _take_in(kinds, out[last])
            last += 1
        while first and any(twins(k, out[first - 1]) for k in kinds):
            first -= 1
            _take_in(kinds, out[first])
        out[first:last] = [Part("()", kinds, False, True)]
    return out


def _crowd(items: list[Part]) -> tuple[int, int] | None:
    """Where siblings of one kind are too many to stay apart."""
    if len(items) <= APART:
        return None
    for i, item in enumerate(items):
        same = [j for j in range(i, len(items)) if items[j].label == item.label]
        if item.label != "()" and len(same) <= LABELS:
            same = [j for j in same if twins(item, items[j])] if len(same) > APART else []
            if len(same) <= APART:
                continue
        if len(same) > 1:
            return i, same[-1] + 1
    return None


def page_parts(root: _Node) -> Part:
    """The parts of a page; its slots hold their blocks."""
    done: dict[int, list[Part]] = {}
    stack: list[tuple[_Node, bool]] = [(root, False)]
    while stack:
        node, ready = stack.pop()
        if not ready:
            stack.append((node, True))
            stack.extend((x, False) for x in node.items if isinstance(x, _Node))
            continue
        items: list[Part] = []
        for item in node.items:
            if isinstance(item, Block):
                items.append(Part("#" + item.region + "a" * (2 * item.link > sum(map(len, item.text))), [], blocks=[item]))
            else:
                items += done.pop(id(item))
        if node.depth > DEPTH:
            done[id(node)] = items
        else:
            items = squeeze(items)
            done[id(node)] = [Part(node.label, items)] if items or node is root else []
    return done[id(root)][0]


def shown(block: Block) -> str:
    return _SPACE.sub(" ", html.unescape("".join(block.text))).strip()


def host() -> F.Column:
    """Host of a url, empty if it has none."""
    return F.coalesce(F.lower(F.regexp_extract("url", r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def to_json(part: Part) -> str:
    def plain(p: Part) -> list:
        flags = p.optional + 2 * p.repeated
        return [p.label, flags, *p.stats] if p.label[:1] == "#" else [p.label, flags, [plain(i) for i in p.items]]

    return json.dumps(plain(part), separators=(",", ":"), ensure_ascii=False)


def from_json(text: str) -> Part:
    def built(x: list) -> Part:
        flags = bool(x[1] & 1), bool(x[1] & 2)
        return Part(x[0], [], *flags, x[2:]) if x[0][:1] == "#" else Part(x[0], [built(i) for i in x[2]], *flags)

    return built(json.loads(text))


def _page_stats(slots: list[Part]) -> list[list]:
    """Stats of the slots of one page."""
    texts = [[shown(b) for b in slot.blocks] for slot in slots]
    hashes = [[f"{xxhash.xxh64_intdigest(t) >> 4:015x}" for t in own] for own in texts]
    # the content of a page is its texts outside boilerplate
    content = sorted(h for slot, own in zip(slots, hashes, strict=True) if slot.label[1] != "b" for h in own)
    digest = f"{xxhash.xxh64_intdigest(' '.join(content)) >> 4:015x}"
    return [[1, sum(map(len, t)), min(h), max(h), digest] for t, h in zip(texts, hashes, strict=True)]


def merged(parts: list[Part]) -> Part:
    """The wrapper of parts, aligned one after another: small ones first."""
    parts = sorted(parts, key=lambda p: (len(p.shape), p.shape))
    wrapper = parts[0]
    for part in parts[1:]:
        wrapper = merge(wrapper, part)
    return wrapper


_INFERRED = "host string, part long, pages long, wrapper string"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    hosts, parts, pages, wrappers = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(parts, pa.int64()), pa.array(pages, pa.int64()), pa.array(wrappers, pa.string())], names=["host", "part", "pages", "wrapper"])


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, task, pages, wrapper) of the pages of a task."""
    held: dict[str, dict[str, list]] = {}  # by host and shape: pages, part, stats of its slots
    number, task = 0, TaskContext.get().partitionId()

    def taken() -> pa.RecordBatch:
        rows = []
        for name, shapes in held.items():
            for _, part, stats in shapes.values():
                for slot, own in zip(part.slots(), stats, strict=True):
                    slot.stats, slot.blocks = own, None
            rows.append((name, task, sum(x[0] for x in shapes.values()), to_json(merged([x[1] for x in shapes.values()]))))
        held.clear()
        return _rows(rows)

    for batch in batches:
        for name, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            part = page_parts(parse(page.as_py() or ""))
            stats = _page_stats(part.slots())
            shapes = held.setdefault(name, {})
            if (old := shapes.get(part.shape)) is None:
                for slot in part.slots():
                    slot.blocks = None
                shapes[part.shape] = [1, part, stats]
                number += 1
            else:
                old[0] += 1
                old[2] = list(map(joined, old[2], stats))
            if number >= HELD:
                yield taken()
                number = 0
    if held:
        yield taken()


def _merged(group: pa.Table) -> pa.Table:
    wrapper = merged([from_json(x) for x in group.column("wrapper").to_pylist()])
    return pa.Table.from_batches([_rows([(group.column("host")[0].as_py(), group.column("part")[0].as_py(), sum(group.column("pages").to_pylist()), to_json(wrapper))])])


def infer(pages: DataFrame) -> DataFrame:
    """One wrapper per host of ``pages`` (url, html): host, pages, wrapper
    (JSON). A null html is a page without parts; no rows in, no rows out."""
    from spindrift.llm.workspace import cut

    found = cut(pages.select(host().alias("host"), "html").mapInArrow(_streams, _INFERRED), "streams")
    most = found.agg(F.max("part")).first()[0] or 0
    while most >= FAN:
        found = found.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("host", "part").applyInArrow(_merged, _INFERRED)
        most //= FAN
    return found.groupBy("host").applyInArrow(_merged, _INFERRED).drop("part")


def expression(wrapper: str) -> str:
    """The wrapper as a readable union-free expression."""

    def told(p: Part) -> str:
        inside = " ".join(map(told, p.items))
        own = "#text" if p.label[:1] == "#" else f"({inside})" if p.label == "()" else f"<{p.label}> {inside} </{p.label.partition('.')[0]}>" if p.label else inside
        flags = "+" * p.repeated + "?" * p.optional
        return f"({own}){flags}" if flags and p.items and p.label != "()" else own + flags

    return told(from_json(wrapper))


def assign(wrapper: Part, pages: int) -> Part:
    """Give each slot of a host's wrapper its role: article, maybe (read on
    pages without an article) or none.

    A slot in boilerplate is none, and so is one whose text is the same on
    ``REPEATS`` distinct pages (in an article: and on half the host's pages, and
    no heading). Of the slots outside articles, those with links only are none.
    The others are maybe if they lie in the innermost element that holds two
    thirds of the text of them all, or are a first heading.
    """
    mass: dict[int, int] = {}

    def weigh(part: Part, inside: str) -> int:
        if part.label[:1] != "#":
            name = inside if part.label == "()" else part.label.partition(".")[0]
            mass[id(part)] = sum(weigh(i, name) for i in part.items)
            return mass[id(part)]
        n, chars, low, high, *digests = part.stats
        fixed = len(digests) >= REPEATS and low == high
        region = part.label[1]
        if region == "c":
            part.role = "none" if fixed and 2 * n >= pages and inside not in _HEADINGS else "article"
        elif region == "b" or fixed or part.label == "#oa":
            part.role = "none"
        else:
            part.role = "first" if inside == "h1" else "maybe"
            return chars
        return 0

    total = weigh(wrapper, "")
    node = wrapper
    while True:
        inner = next((i for i in flat(node.items) if i.label[:1] != "#" and not _leaf(i) and 3 * mass[id(i)] >= 2 * total), None) if total else None
        if inner is None:
            break
        node = inner
    within = {id(s) for s in node.slots()}
    for slot in wrapper.slots():
        if slot.role == "first" or (slot.role == "maybe" and id(slot) not in within):
            slot.role = "maybe" if slot.role == "first" else "none"
    return wrapper


def _fit(own: list[Part], theirs: list[Part]) -> None:
    """Give the slots of a page the roles of the wrapper's slots that they go with."""
    for i, j in align(own, theirs):
        for x in own[i].items if own[i].label == "()" else [own[i]]:
            y = theirs[j] if theirs[j].label != "()" else max(theirs[j].items, key=lambda t, x=x: _score(x, t, True))
            if x.label == y.label and not x.role:
                x.role = y.role
                _fit(x.items, y.items)


def roles(wrapper: Part | None, page: Part) -> list[str]:
    """Role of each slot of a page; slots that the wrapper lacks go by their region."""
    if wrapper is not None:
        _fit(page.items, wrapper.items)
    return [s.role or {"#c": "article", "#ca": "article", "#o": "maybe"}.get(s.label, "none") for s in page.slots()]


def extract(page: str, wrapper: Part | None, cache: dict) -> str:
    """Main text of a page by its host's wrapper (see ``assign``)."""
    part = page_parts(parse(page))
    if part.shape not in cache:
        if len(cache) > 5000:
            cache.clear()
        cache[part.shape] = roles(wrapper, part)
    found = cache[part.shape]
    wanted = "article" if "article" in found else "maybe"
    blocks = sorted((b for role, slot in zip(found, part.slots(), strict=True) if role == wanted for b in slot.blocks), key=lambda b: b.number)
    return "\n".join(filter(None, map(shown, blocks)))


_TYPES = "page_id long, url string, text string, n_chars long"


def _apply(known: dict[str, tuple[int, str]] | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers: dict[str, Part | None] = {}
        caches: dict[str, dict] = {}
        for batch in batches:
            given = zip(batch.column("pages").to_pylist(), batch.column("wrapper").to_pylist(), strict=True) if known is None else [None] * batch.num_rows
            out = []
            for name, page, own in zip(batch.column("host").to_pylist(), batch.column("html"), given, strict=True):
                if name not in wrappers:
                    if len(wrappers) > 500:
                        wrappers.clear()
                        caches.clear()
                    pages, source = own if known is None else known.get(name, (0, None))
                    wrappers[name], caches[name] = assign(from_json(source), pages) if source else None, {}
                out.append(extract(page.as_py() or "", wrappers[name], caches[name]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text
    (blocks joined by a line feed, empty if none), n_chars.

    A null or empty html has no text. A null url, or one without a host, counts
    as the host "". Pages of equal texts count as one towards what repeats on a
    host. Rows that repeat a page_id or have none get a row each; no rows in, no
    rows out; other columns are ignored.
    """
    from spindrift.llm.workspace import cut

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    wrappers = cut(infer(pages), "wrappers")
    pages = pages.withColumn("host", host())
    if (wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0) <= BROADCAST_CHARS:
        known = {r["host"]: (r["pages"], r["wrapper"]) for r in wrappers.collect()}
        shared = pages.sparkSession.sparkContext.broadcast(known)
        return pages.mapInArrow(lambda batches: _apply(shared.value)(batches), _TYPES)
    many = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return salted.join(many, ["host", "salt"], "left").select("page_id", "url", "html", "host", "pages", "wrapper").mapInArrow(_apply(None), _TYPES)
