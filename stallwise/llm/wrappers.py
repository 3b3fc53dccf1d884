"""Main text of web pages by wrappers inferred from the pages of each host.

A page is parsed into a tree of blocks and text runs; neighbouring blocks of one shape fold into a
repeated group.  Trees of one host are aligned into a wrapper, a union-free regular
expression over blocks: what all pages have in a place is required, what only some have becomes an
optional item, and a text that differs between pages becomes a slot; one that never does stays a constant.

Pages of one shape align place by place, which no order of pages, copy or partition changes:
that is done where pages are read.  The shapes of a host, of which there are few, are then aligned in a fixed
order, in two rounds, so a host of any size meets in one task only as a few small wrappers.  The wrapper says
which of its text items are main text; each page is then matched with its host's
wrapper and gives up the texts in those places.
"""

from __future__ import annotations

import functools
import hashlib
import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

# HTML elements by their role in the tree.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("button canvas datalist head iframe math noscript object script select style svg template textarea title".split())
RAW = frozenset("iframe noscript script style textarea title".split())
#: An element's start ends open ones of these kinds, up to an element that holds them.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HOLDS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "thead", "tbody", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table")}

MAIN = frozenset(("article", "main"))
ASIDE = frozenset(("nav", "footer", "aside", "form", "menu", "dialog"))
# Words in class, id and role that mark what isn't main text.
MARKS = frozenset(
    "ad ads advert advertise advertisement advertisements advertising advertorial adverts alert banner breadcrumb breadcrumbs comment commentform commenting commentlist comments "
    "complementary consent contentinfo cookie cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination "
    "paywall popup promo promos recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe tags toolbar topbar widget widgets".split()
)
COMMENTS = frozenset("comment commentform commenting commentlist comments".split())
# Words that say nothing beside a mark in a name such as "ad-slot"; those of them that speak of text; marks that blocks of an article may bear too.
NEUTRAL = frozenset(
    "area bar block blocks body bottom box button buttons container content entry group header holder inner item items left link links list main "
    "outer page panel post posts right row section site slot story text title top unit wrap wrapper".split()
)
SPOKEN = frozenset("body content entry story text title".split())
AMBIGUOUS = frozenset("alert banner copyright disclaimer menu modal notice notices popup related replies reply respond search share sharing social tags widget widgets".split())
PLAIN = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
HEADER = frozenset(("header", "head"))
#: Deeper blocks become neighbours of those at this depth.
DEPTH = 100

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[a-z0-9]+")


class Block:
    """A block: its label (tag, hint and words of class, id and role), children (blocks, or (text, characters in links))."""

    __slots__ = ("children", "label", "tag")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.children = tag, label, []


def _label(tag: str, attributes: str) -> str:
    """The tag, with "!" if its names say that it isn't main text, and their words.

    A name does if it is made of marks and neutral words; marks beside other words say nothing.
    On a block of plain text, or beside a word that speaks of text, ambiguous marks say nothing either: "?".
    """
    parts, hint = set(), ""
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        value = "".join(values).lower()
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            hint = "!"
        elif name in ("class", "id", "role"):
            for token in value.split():
                words = _PART.findall(re.sub(r"\d+", " ", token))
                parts.update(words)
                marks = [w for w in words if w in MARKS]
                if marks and all(w in MARKS or w in NEUTRAL for w in words):
                    doubtful = all(w in AMBIGUOUS for w in marks) and (tag in PLAIN or not SPOKEN.isdisjoint(words))
                    hint = "!" if hint == "!" or not doubtful else "?"
    return " ".join([tag + hint, *sorted(parts)])


class _Open:
    """The open blocks, innermost last, and where each tag's are among them, so that no walk over them is needed."""

    def __init__(self, root: Block):
        self.stack, self.places = [root], {}

    def push(self, block: Block) -> None:
        self.places.setdefault(block.tag, []).append(len(self.stack))
        self.stack.append(block)

    def last(self, tags: tuple[str, ...]) -> int:
        """The innermost place of any of the tags; 0, the page's, if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()


class _Ends:
    """Searches of a page for the next of some pattern that never look at the same part twice."""

    def __init__(self, page: str):
        self.page, self.found = page, {}

    def next(self, pattern: str, position: int) -> re.Match | None:
        known = self.found.get(pattern, position - 1)
        if known is not None and (isinstance(known, int) or known.start() < position):
            self.found[pattern] = re.compile(pattern, re.I).search(self.page, position)
        return self.found[pattern]


def parse(page: str) -> Block:
    """A page's tree; markup that isn't closed, nested wrongly or cut off is read as browsers mostly do.

    The time goes with the page's length, whatever is unclosed in it.  Blocks deeper than ``DEPTH`` become neighbours of those at that depth.
    """
    root = Block("#page", "#page")
    open_, ends = _Open(root), _Ends(page)
    stack, run, links, in_link, position, n = open_.stack, [], 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal links
        if run:
            text = " ".join("".join(run).split())
            if text:
                holder = stack[-1]
                if len(stack) > DEPTH + 1:  # a run of its own among the blocks of that depth
                    holder = Block(holder.tag, holder.label)
                    stack[DEPTH].children.append(holder)
                holder.children.append((text, links))
            run.clear()
        links = 0

    while position < n:
        found = _TOKEN.search(page, position)
        text = html.unescape(page[position : found.start() if found else n])
        if text:
            run.append(text)
            links += len(text) * (in_link > 0)
        if not found:
            break
        position = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in BLOCKS:
                flush()
                if place := open_.last((tag,)):
                    open_.close(place)
            continue
        if tag in HIDDEN:
            end = ends.next(rf"</{tag}\s*>", position)
            if tag == "head":  # if it isn't closed, it ends where the body starts
                body = ends.next(r"<body\b", position)
                position = body.start() if body and (not end or body.start() < end.start()) else end.end() if end else position
            else:
                position = end.end() if end else n if tag in RAW else position
            continue
        if tag == "a":
            in_link = 1
        elif tag in ("br", "hr"):
            flush()
        elif tag in BLOCKS:
            flush()
            in_link = 0
            if stack[-1].tag == "p":
                open_.close(len(stack) - 1)
            if tag in CLOSES:
                place = open_.last(CLOSES[tag])
                if place > open_.last(HOLDS[tag]):
                    open_.close(place)
            block = Block(tag, _label(tag, found[3] or ""))
            if len(stack) > DEPTH:  # what isn't main text there keeps what is nested in it from being so
                if _is_aside(stack[-1].label, False):
                    block.label = stack[-1].label
                stack[DEPTH].children.append(block)
            else:
                stack[-1].children.append(block)
            open_.push(block)
    flush()
    return root


# A wrapper's item is a list: [key, least, most, seen, constant or None, characters, read, children].
# least and most are 0 or 1 and 1 or 2 (repeated); texts have the key "#text" and no children.
# seen has the least signatures of the pages with the item, EVIDENCE at most: copies of a page have one signature, so
# they count once wherever they are read and merged.  characters are the most that a page has there, and
# read is 1 if on some page most of them aren't in links.
KEY, LEAST, MOST, SEEN, CONSTANT, CHARS, READ, CHILDREN = range(8)
TEXT = "#text"
#: A text that is the same on so many different pages is a constant of its host; in an article it takes more.
EVIDENCE_AROUND, EVIDENCE = 3, 8
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _signature(tree: Block) -> int:
    """48 bits of a page's blocks and texts; what doesn't show isn't in it."""
    parts = []

    def walk(block: Block) -> None:
        for child in block.children:
            if isinstance(child, tuple):
                parts.append(child[0])
            else:
                parts.append(f"<{child.label}")
                walk(child)
                parts.append(">")

    walk(tree)
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=6).digest())


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _item(node, page: int) -> list:
    """The item of a block or text of the page with this signature."""
    if isinstance(node, tuple):
        text, links = node
        return [TEXT, 1, 1, [page], text if len(text) <= 16 else _digest(text), len(text), int(links * 2 <= len(text)), []]
    return [node.label, 1, 1, [page], None, 0, 0, fold([_item(c, page) for c in node.children])]


def _page(tree: Block) -> list:
    return _item(tree, _signature(tree))


def _merge(a: list, b: list, within: bool = False) -> list:
    """One item for two of the same key.

    Texts of different pages stay constant if they are equal; those of neighbours
    ``within`` the same pages, if each is and the pages are the same, as the run of both.
    """
    x, y = a[CONSTANT], b[CONSTANT]
    if within and x is not None and y is not None and a[SEEN] == b[SEEN]:
        constant = _digest(f"{x}|{y}")
    else:
        constant = x if x == y and not within else None
    seen = a[SEEN] if a[SEEN] == b[SEEN] else sorted({*a[SEEN], *b[SEEN]})[:EVIDENCE]
    out = [a[KEY], min(a[LEAST], b[LEAST]), max(a[MOST], b[MOST]), seen, constant, max(a[CHARS], b[CHARS]), a[READ] | b[READ], []]
    out[CHILDREN] = fold(align(a[CHILDREN], b[CHILDREN], within))
    return out


def _overlay(a: list, b: list) -> None:
    """Merge the wrapper ``b`` into ``a``, both of one shape, place by place: the same in any order, however often."""
    if a[CONSTANT] != b[CONSTANT]:
        a[CONSTANT] = None
    if a[SEEN] != b[SEEN]:
        a[SEEN] = sorted({*a[SEEN], *b[SEEN]})[:EVIDENCE]
    a[CHARS], a[READ] = max(a[CHARS], b[CHARS]), a[READ] | b[READ]
    for x, y in zip(a[CHILDREN], b[CHILDREN]):
        _overlay(x, y)


def _shape(item: list) -> str:
    """What an item looks like, without its texts: its key, whether it repeats, and its children's shapes."""
    children = ",".join([_shape(x) for x in item[CHILDREN]])
    return f"{item[KEY]}{'+' * (item[MOST] > 1)}({children})"


def _look(item: list) -> str:
    """The shape of one of a run's items, which may itself be a run already."""
    return f"{item[KEY]}({','.join([_shape(x) for x in item[CHILDREN]])})"


def fold(items: list[list]) -> list[list]:
    """Turn neighbouring runs of one shape, one to three items long, into one repeated group of items."""
    return _fold(items, _look)


def _fold(items: list[list], look) -> list[list]:
    for period in (1, 2, 3):
        if len(items) < 2 * period:
            break
        out, looks = [], []
        for item in items:
            out.append(item)
            looks.append(look(item))
            if looks[-period:] == looks[-2 * period : -period] and len(set(looks[-period:])) == period:
                for k in range(period):
                    old, new = out[k - 2 * period], out[k - period]
                    merged = _merge(old, new, True)
                    merged[MOST] = 2
                    out[k - 2 * period] = merged
                del out[-period:], looks[-period:]
        items = out
    return items


def align(a: list[list], b: list[list], within: bool = False) -> list[list]:
    """The items of two sequences, aligned by their keys in order; the rest become optional.

    The n-th item of a key in one may go with the n-th in the other; the longest sequence
    of such pairs that is in order in both is taken, which costs hardly more than the items themselves.
    """
    if [x[KEY] for x in a] == [x[KEY] for x in b]:
        return [_merge(x, y, within) for x, y in zip(a, b)]
    places: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x[KEY], []).append(j)
    met: dict[str, int] = {}
    tails: list[int] = []  # the least last place in b of an ordered sequence of each length, and that pair's number
    pairs: list[tuple[int, int, int]] = []  # (i, j, the pair before)
    last: list[int] = []
    for i, x in enumerate(a):
        k = met.get(x[KEY], 0)
        met[x[KEY]] = k + 1
        if k < len(places.get(x[KEY], ())):
            j = places[x[KEY]][k]
            at = bisect_left(tails, j)
            pairs.append((i, j, last[at - 1] if at else -1))
            tails[at : at + 1], last[at : at + 1] = [j], [len(pairs) - 1]
    taken, at = [], last[-1] if last else -1
    while at >= 0:
        i, j, at = pairs[at]
        taken.append((i, j))
    out, i, j = [], 0, 0
    for x, y in [*reversed(taken), (len(a), len(b))]:
        out += [[item[KEY], 0, *item[2:]] for item in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append(_merge(a[x], b[y], within))
        i, j = x + 1, y + 1
    return out


def infer(trees: Iterator[Block]) -> list | None:
    """The wrapper of some pages: one of each shape, then all of those in a fixed order."""
    shapes: dict[str, list] = {}
    for tree in trees:
        item = _page(tree)
        shape = _shape(item)
        if shape in shapes:
            _overlay(shapes[shape], item)
        else:
            shapes[shape] = item
    return merged([shapes[k] for k in sorted(shapes)])


def merged(wrappers: list[list]) -> list | None:
    """One wrapper of some, aligned one after the other."""
    return functools.reduce(_merge, wrappers) if wrappers else None


def mark(wrapper: list, least_around: int = EVIDENCE_AROUND, least_inside: int = EVIDENCE) -> dict:
    """Which of a wrapper's texts are main text: ``{"k": key, "c": children}``, and for texts ``{"k", "m", "n", "o"}``; ``r`` if repeated.

    Slots are main text.  Constants are texts that are the same over ``least_around`` different pages, or ``least_inside`` in an
    article; the place of one tells whether it belongs to the story.

    ``m`` holds for pages with an article or main block: what is in it and no tag or mark sets aside, but for constants alone in a division (or other block that isn't of plain text)
    that holds no slot; constant headings, paragraphs and items stay.  ``n`` holds for pages whose articles are all in blocks that only their marks set aside: an
    article or main block lifts those around it.

    ``o`` holds for pages without one: what is not mostly links on every page, but for constants outside of the story.  The story's are those among a
    block's slots, between the first and the last of its parts that hold slots, and headings before, paragraphs and items beside such parts.

    Where constants that aren't the story's make up most of the characters, in an article or around it, the pages are all but copies of each other, and being constant says nothing there.
    """
    total = {True: [0, 0], False: [0, 0]}

    def constant(item: list, in_main: bool) -> bool:
        return item[CONSTANT] is not None and len(item[SEEN]) >= (least_inside if in_main else least_around)

    def holds_slots(item: list, in_main: bool) -> bool:
        if item[KEY] == TEXT:
            return not constant(item, in_main) and bool(item[READ])
        in_main = in_main or _tag(item[KEY]) in MAIN
        return not _is_aside(item[KEY], in_main) and any(holds_slots(x, in_main) for x in item[CHILDREN])

    def marked(item: list, aside: bool, in_main: bool, doubtful: bool, around: str | None, told: bool) -> dict:
        """``told``: whether constants here belong to the story."""
        key = item[KEY]
        if key == TEXT:
            furniture = constant(item, in_main) and not told
            if weighing:
                total[in_main][furniture] += 0 if aside else item[CHARS]
            slots, constants = total[in_main]
            content = not (doubtful and not item[READ]) and not (furniture and slots > constants)
            return {"k": key, "r": item[MOST] > 1, "m": in_main and content and not aside, "n": in_main and content and not around, "o": bool(content and not aside and item[READ])}
        here, tag = _is_aside(key, in_main), _tag(key)
        around, in_main, doubtful = _lifted(around, here, key), in_main or tag in MAIN, doubtful or "?" in key.split(" ")[0]
        slots = [k for k, x in enumerate(item[CHILDREN]) if holds_slots(x, in_main)]
        children = []
        for k, x in enumerate(item[CHILDREN]):
            plain = _tag(x[KEY]) in PLAIN
            if in_main:
                mine = plain or bool(slots) and x[KEY] == TEXT or told and not slots
            elif slots:  # a part with slots of its own tells for itself what in it is the story's
                mine = k not in slots and (x[KEY] == TEXT or slots[0] < k < slots[-1] or plain and (k < slots[0] or _tag(x[KEY]) not in HEADINGS))
            else:
                mine = told
            children.append(marked(x, aside or here, in_main, doubtful, around, mine))
        return {"k": key, "r": item[MOST] > 1, "c": children}

    weighing = True
    marked(wrapper, False, False, False, None, False)
    weighing = False
    return marked(wrapper, False, False, False, None, False)


def _tag(label: str) -> str:
    return label.split(" ", 1)[0].rstrip("!?")


def _is_aside(label: str, in_main: bool) -> bool:
    """Whether a block's tag or names say that it isn't main text."""
    tag = _tag(label)
    if tag in ASIDE:
        return True
    if tag in ("html", "body", "#page", *MAIN):
        return False
    if not in_main and (tag == "header" or not HEADER.isdisjoint(label.split(" ")[1:])):
        return True
    return "!" in label.split(" ", 1)[0]


def _lifted(around: str | None, here: bool, label: str) -> str | None:
    """How the blocks around and this one set aside what is inside: None if not, "marked" if an article or main block lifts it, "kept" if none does.

    Navigation, footers, forms and comments keep what they hold.
    """
    tag = _tag(label)
    if around == "kept" or (here and (tag in ASIDE or not COMMENTS.isdisjoint(label.split(" ")[1:]))):
        return "kept"
    return "marked" if here else None if tag in MAIN else around


def has_main(block: Block, inside: bool = False, tags: frozenset = MAIN) -> bool:
    """Whether a page has an article or main block (one of ``tags``) with text, outside of navigation and the like."""
    for child in block.children:
        if isinstance(child, tuple):
            if inside:
                return True
        elif not _is_aside(child.label, inside) and has_main(child, inside or child.tag in tags, tags):
            return True
    return False


def has_marked(block: Block, tags: frozenset, in_main: bool = False, inside: bool = False, around: str | None = None) -> bool:
    """Whether a page has a block of ``tags`` with text that only marks of blocks around it set aside."""
    for child in block.children:
        if isinstance(child, tuple):
            if inside and not around:
                return True
            continue
        at = _lifted(around, _is_aside(child.label, in_main), child.label)
        if at != "kept" and has_marked(child, tags, in_main or child.tag in MAIN, inside or child.tag in tags, at):
            return True
    return False


def _flag(tree: Block) -> str:
    """Which mark of a wrapper's texts holds for a page; articles come before main blocks."""
    for tags in (frozenset(("article",)), MAIN):
        if has_main(tree, tags=tags):
            return "m"
        if has_marked(tree, tags):
            return "n"
    return "o"


def _accepts(items: list[dict], block: Block) -> bool:
    """Whether a wrapper's items have a place for everything in a block."""
    places: dict[str, list[dict]] = {}
    for x in items:
        places.setdefault(x["k"], []).append(x)
    for child in block.children:
        if isinstance(child, tuple):
            if TEXT not in places:
                return False
        elif not any(_accepts(x["c"], child) for x in places.get(child.label, ())):
            return False
    return True


def extract(tree: Block, plan: dict) -> str:
    """The main text of a page by its host's marked wrapper: its blocks' texts in page order.

    A child matches the wrapper's same item again if that is repeated, else the next one of its key that
    has a place for all it holds, else an earlier one, of a repeated group.  Some item always
    has, as the page is one of those that the wrapper was inferred from.
    """
    out: list[str] = []
    flag = _flag(tree)

    def walk(block: Block, items: list[dict]) -> None:
        places: dict[str, list[int]] = {}
        for k, x in enumerate(items):
            places.setdefault(x["k"], []).append(k)
        at = -1
        for child in block.children:
            key = TEXT if isinstance(child, tuple) else child.label
            found = places[key]
            # The places from here on, then the earlier ones; the first that the child fits.
            first = bisect_left(found, at + (at >= 0 and not items[at].get("r")))
            order = chain(islice(found, first, None), islice(found, first))
            at = next(k for k in order if key == TEXT or len(found) == 1 or _accepts(items[k]["c"], child))
            if key != TEXT:
                walk(child, items[at]["c"])
            elif items[at][flag]:
                out.append(child[0])

    walk(tree, plan["c"])
    return "\n".join(out)


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1))


#: Plans of so many hosts and characters at most are sent to every task; others are joined to the pages.
SMALL_HOSTS, SMALL_PLANS = 100_000, 32_000_000


def _dump(wrapper: list | dict) -> str:
    return json.dumps(wrapper, separators=(",", ":"))


def plans(pages: DataFrame, salt: int = 64, held: int = 20_000) -> DataFrame:
    """``host, plan``: each host's wrapper, marked, from ``host, html``.

    A task holds at most ``held`` partial wrappers at a time, one a host and shape; the rest of
    its pages begin new ones.  Those of one shape are overlaid, in ``salt`` parts first; a host's
    shapes are then merged in ``salt`` parts by their hashes, and those as one.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = TaskContext.get().partitionId() % salt, {}

        def rows() -> pa.RecordBatch:
            columns = [pa.array([k[0] for k in found], pa.string()), pa.array([_digest(k[1]) for k in found], pa.string())]
            columns += [pa.array([part] * len(found), pa.int32()), pa.array([_dump(x) for x in found.values()], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["host", "shape", "part", "plan"])

        for batch in batches:
            for host, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
                item = _page(parse(page or ""))
                key = (host, _shape(item))
                if key in found:
                    _overlay(found[key], item)
                else:
                    found[key] = item
            if len(found) > held:
                yield rows()
                found.clear()
        yield rows()

    def overlaid(table: pa.Table) -> pa.Table:
        whole, *others = map(json.loads, table["plan"].to_pylist())
        for x in others:
            _overlay(whole, x)
        return table.slice(0, 1).set_column(3, "plan", pa.array([_dump(whole)], pa.string()))

    def merger(finish: bool):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("shape")  # the same wrapper whatever the order of rows
            whole = merged([json.loads(x) for x in table["plan"].to_pylist()])
            return table.slice(0, 1).set_column(3, "plan", pa.array([_dump(mark(whole) if finish else whole)], pa.string()))

        return run

    schema = "host string, shape string, part int, plan string"
    some = pages.select("host", "html").mapInArrow(partial, schema)
    for keys in (("host", "shape", "part"), ("host", "shape")):
        some = some.groupBy(*keys).applyInArrow(overlaid, schema)
    by_hash = F.pmod(F.crc32("shape"), F.lit(salt)).cast("int").alias("part")
    some = some.select("host", "shape", by_hash, "plan").groupBy("host", "part").applyInArrow(merger(False), schema)
    return some.groupBy("host").applyInArrow(merger(True), schema).select("host", "plan")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: ``page_id, url, text, n_chars``.

    Character references are decoded, white space in a block becomes one space, blocks are
    trimmed and joined in page order by newlines; empty ones go.

    Defined cases: a null or empty page has an empty text; pages without a host, or with a null URL,
    are one host's; a host with a single page is its own wrapper; repeated rows get a result each; very long pages are parsed whole, in time
    that goes with their length; blocks deeper than ``DEPTH`` become neighbours of those at that depth; an empty table gives an empty result; other columns are ignored.
    """
    rows = small_batches(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")))
    kind = rows.schema["page_id"].dataType.simpleString()
    found = cut(plans(rows))
    n, size = found.agg(F.count("*"), F.coalesce(F.sum(F.length("plan")), F.lit(0))).first()
    small = n <= SMALL_HOSTS and size <= SMALL_PLANS
    shipped = rows.sparkSession.sparkContext.broadcast({x["host"]: x["plan"] for x in found.collect()}) if small else None

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, dict] = {}
        for batch in batches:
            texts = []
            of_host = shipped.value if shipped else None
            given = [of_host[h] for h in batch["host"].to_pylist()] if shipped else batch["plan"].to_pylist()
            for page, plan in zip(batch["html"].to_pylist(), given):
                if plan not in loaded:
                    if len(loaded) >= 500:
                        loaded.clear()
                    loaded[plan] = json.loads(plan)
                texts.append(extract(parse(page or ""), loaded[plan]))
            columns = [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    if not small:
        # A host's pages go to several tasks, each with the host's plan.
        parts = 64
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(parts)).cast("int"))
        rows = salted.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), ["host", "salt"])
    return rows.drop("salt").mapInArrow(extracted, f"page_id {kind}, url string, text string, n_chars long")
