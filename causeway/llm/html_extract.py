"""Main text of web pages by wrappers inferred for each host.

A page is a stream of tokens, tags and texts.  For every host a union-free regular
expression over such streams, its *wrapper*, is inferred from all its different pages:
starting from one page, the others are aligned to it one by one.  Equal tags match; texts
that differ become slots; an element that one side has and the other lacks becomes
optional; like siblings are folded into repeated groups.  The pages of a large host are
dealt to leaves by the hash of their html; each leaf is aligned in the order of the hashes,
then the leaves' wrappers are, ``FAN`` at a time, so the result does not depend on how rows
are partitioned.  An element with more than ``WIDE`` different ones inside tells these apart
by their names only, so a wrapper grows with the ways a host builds its pages and not with
their number.

The wrapper then says what is what.  Its *content* is the article or main element, else
the deepest element that holds most of the varying prose (links and constants weigh
nothing).  Inside it, blocks whose whole text stayed constant over ``CONSTANT`` pages or
more while most of the rest varied are no article text, nor are repeated groups in the shape of
reader comments, nor elements that are menus, asides, footers or forms by their nature.
Only where this leaves a tie -- a block of its own whose text varies -- the whole class
or id decides, if it is one of the plain names of adverts, notices, comments and the
like; a word inside a longer name never does.

Every whole page is matched against the wrapper of its host: its tokens walk along the
expression, in one pass, and the texts that fall into slots of the content go out.  A
page that the wrapper doesn't fit (another template) is read by the expression of that
page alone.  A text is constant if it stands on 0.95 or more of the pages that have its
place, and never if on less than ``STEADY`` of them: a vote keeps one text for each place.

White space inside a block becomes one space, blocks are joined by one space, character
references are decoded; nothing else is dropped.

Defined results: null or empty html gives an empty text; null urls (or urls without a host)
share one wrapper; markup that is cut off or not closed is read as far as it goes; rows that
repeat are treated alike; extra columns are ignored.  Pages are read in time linear in their
length, whatever their nesting.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy

CONSTANT, STEADY = 3, 0.9
#: Pages of a host in one leaf, about; leaves aligned at a time, as a power of two; different elements in one.
LEAF, FAN, WIDE = 512, 6, 256
#: Pages that a task remembers to pass over copies.
MET = 100_000
#: Elements that nest deeper hang on to the last one; a key that occurs oftener among siblings is one group.
DEEPEST, OFTEN = 120, 8

# Element names by how they are read.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
_SILENT = frozenset("script style noscript template iframe button select textarea object svg canvas input option audio video map".split())
_DROPPED = _SILENT | frozenset("head nav footer aside form dialog menu title".split())
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
_WITHIN = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
# Elements that hold blocks: only these are told apart by their inside or by a name.
_HOLDERS = frozenset("div section article main ul ol dl table figure details blockquote header span center".split())
# Whole names of what is no article text.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising ad-banner ad-block ad-box ad-container ad-slot ad-unit ad-wrapper adsbygoogle banner-ad sponsor "
    "sponsored promo promotion nav navbar navigation main-nav site-nav top-nav menu main-menu breadcrumb breadcrumbs sidebar side-bar left-sidebar "
    "right-sidebar page-header site-header masthead page-footer site-footer footer cookie cookies cookie-banner cookie-bar cookie-consent cookie-notice "
    "consent notice notices site-notice popup modal newsletter newsletter-box newsletter-signup subscribe signup comments comment-list comments-area "
    "comments-list comment-section comments-section reader-comments user-comments replies disqus disqus-thread respond share-bar share-buttons "
    "sharing social social-share social-links related related-articles related-links related-posts recommended widget pagination pager toolbar".split()
)

#: Element names that wide elements tell apart.
_KNOWN = _VOID | _RAW | _INLINE | _SILENT | _DROPPED | _CLOSES_P | _HOLDERS | frozenset("html body caption thead tbody tfoot figcaption summary".split()).union(
    _WITHIN
)
# Beginnings of longer names that say the same.
_BEGINNINGS = tuple(f"{x}-" for x in sorted(_NAMES) if x.startswith(("cookie-", "comment-", "comments-")))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Characters in paragraphs from which on a form is a wrapper of the page and not a form to fill in.
FORM_PROSE = 400

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[A-Za-z/][^<]*(?:>|\Z)", re.S
)
_ATTR = re.compile(r"(?<![^\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("open", name, attributes), ("close", name, "") and ("text", text, "") of a page."""
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            yield "text", unescape(html[at:]), ""
            return
        if m.start() > at:
            yield "text", unescape(html[at : m.start()]), ""
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        yield ("close" if m["close"] else "open"), name, m["rest"] or ""
        if not m["close"] and name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(html, at)
            if end is None:
                yield "close", name, ""
                return
            yield "text", html[at : end.start()], ""
            yield "close", name, ""
            tail = html.find(">", end.start())
            at = tail + 1 if tail >= 0 else n


def signature(name: str, rest: str) -> tuple[str, int]:
    """Name with its class, id and role (digits as #), and what the element says of itself:
    2 no article text by its nature, 1 by its whole name, 0 nothing."""
    if not rest or "=" not in rest:
        return name, 2 * (name in _DROPPED)
    attrs = {a.lower(): " ".join((b or c or d or "").split()) for a, b, c, d in _ATTR.findall(rest)}
    role = attrs.get("role", "").lower()
    names = [re.sub(r"(?<=[a-z])(?=[A-Z])|_", "-", x).lower() for x in f"{attrs.get('class', '')} {attrs.get('id', '')}".split()]
    # a part of a named block says what the block says
    told_by = name in _HOLDERS and any(x in _NAMES or x.split("--")[0] in _NAMES or x.startswith(_BEGINNINGS) for x in names)
    says = 2 if name in _DROPPED or role in _ROLES else int(told_by)
    shown = ".".join(x for x in (attrs.get("class", ""), attrs.get("id", ""), role) if x)
    return (re.sub("[0-9]+", "#", f"{name}.{shown}") if shown else name), says


def walk(html: str) -> Iterator[tuple[str, str, str, int]]:
    """Balanced events of a page: (kind, text or signature, name, what it says of itself).

    Missing end tags are supplied: a block ends a paragraph, a list item or cell its like,
    an end tag all that is open inside its element; stray end tags are passed over.
    """
    stack: list[tuple[str, str, int]] = []
    open_at: defaultdict[str, list[int]] = defaultdict(list)  # depths of the open elements of a name
    walls: list[int] = []  # depths of open blocks but paragraphs, which inline end tags don't reach through

    def last(name: str) -> int:
        return open_at[name][-1] if open_at[name] else -1

    def shut(depth: int) -> Iterator[tuple[str, str, str, int]]:
        while len(stack) > depth:
            name, sig, says = stack.pop()
            open_at[name].pop()
            if walls and walls[-1] == len(stack):
                walls.pop()
            yield "close", sig, name, says

    for kind, name, rest in tokens(html):
        if kind == "text":
            yield "text", name, "", 0
        elif kind == "open":
            wall = walls[-1] if walls else -1
            if name in _CLOSES_P and last("p") > wall:
                yield from shut(last("p"))
            elif name in _WITHIN and last(name) > max(map(last, _WITHIN[name])):
                yield from shut(last(name))
            sig, says = signature(name, rest)
            yield "open", sig, name, says
            if name in _VOID or rest.endswith("/") and name not in _RAW:
                yield "close", sig, name, says
            else:
                if name not in _INLINE and name != "p":
                    walls.append(len(stack))
                open_at[name].append(len(stack))
                stack.append((name, sig, says))
        elif (at := last(name)) >= 0 and (name not in _INLINE or not walls or walls[-1] < at):
            yield from shut(at)
    yield from shut(0)


def read_page(html: str) -> list[tuple[str, str, str, int]]:
    """The events of a page, in which a form round an article is an element like others.

    Such a form holds an article, a main part, a first heading or much text in paragraphs.
    """
    events = list(walk(html))
    forms: list[list] = []  # place, characters in paragraphs, whether it is round an article
    ends: dict[int, int] = {}
    paragraphs = hidden = 0
    for i, (kind, value, name, says) in enumerate(events):
        if kind == "text":
            if forms and paragraphs and not hidden:
                forms[-1][1] += len(value)
            continue
        step = 1 if kind == "open" else -1
        if name == "p":
            paragraphs += step
        elif name == "form" and kind == "open":
            forms.append([i, 0, False])
        elif name == "form" and forms:
            at, n, around = forms.pop()
            around = around or n >= FORM_PROSE
            if around:
                ends[at] = i
            if forms:
                forms[-1][1] += n
                forms[-1][2] |= around
        elif says:
            hidden += step
        elif forms and not hidden and name in ("article", "main", "h1"):
            forms[-1][2] = True
    for at, end in ends.items():
        for i in (at, end):
            kind, sig, name, _ = events[i]
            events[i] = kind, sig, name, 0
    return events


# --- wrappers --------------------------------------------------------------
# A node is a dict: {"sig", "name", "says", "kids", "opt", "rep", "wide", "seen"} for an element,
# {"text", "size", "opt", "rep", "seen", "same"} for a text.  "seen" counts the pages that have the
# node, "size" sums their characters; "text" stands on at least "same" of them, None on none.
# The elements in a "wide" one are told apart by name.


def told(text: str) -> str:
    """A text with white space folded, shortened to what tells it from others."""
    text = " ".join(text.split())
    return text if len(text) <= 80 else f"{text[:40]}...{zlib.crc32(text.encode('utf-8', 'surrogatepass')):08x}:{len(text)}"


def _element(sig: str, name: str, says: int) -> dict:
    return {"sig": sig, "name": name, "says": says, "kids": [], "opt": False, "rep": False, "wide": False, "seen": 1}


def tree(html: str) -> dict:
    """The element tree of a page, like siblings folded."""
    root = _element("#page", "", 0)
    path, below = [root], 0
    for kind, value, name, says in read_page(html):
        if kind == "text":
            if size := len(" ".join(value.split())):
                path[-1]["kids"].append({"text": told(value), "size": size, "opt": False, "rep": False, "seen": 1, "same": 1})
        elif kind == "open":
            if len(path) > DEEPEST:
                below += 1
            else:
                node = _element(value, name, says)
                path[-1]["kids"].append(node)
                path.append(node)
        elif below:
            below -= 1
        else:
            node = path.pop()
            node["kids"] = _fold(node["kids"])
    root["kids"] = _fold(root["kids"])
    return root


def _key(node: dict) -> str:
    return node.get("sig", "#text")


def _alike(a: dict, b: dict) -> bool:
    """Whether siblings of one key repeat each other: holders of blocks only if built alike."""
    return "sig" not in a or a["name"] not in _HOLDERS or set(map(_key, a["kids"])) == set(map(_key, b["kids"]))


def _fold(kids: list[dict]) -> list[dict]:
    """Like siblings as one repeated group: neighbours, and any of a key that occurs often."""
    keys = list(map(_key, kids))
    if len(set(keys)) == len(keys):
        return kids
    times = Counter(keys)
    out: list[dict] = []
    at: dict[str, int] = {}
    for node, key in zip(kids, keys):
        if out and _key(out[-1]) == key and _alike(out[-1], node):
            place = len(out) - 1
        elif times[key] > OFTEN and key in at:
            place = at[key]
        else:
            at.setdefault(key, len(out))
            out.append(node)
            continue
        out[place] = align(out[place], node, False)
        out[place]["rep"] = True
    return out


def by_name(name: str, says: int) -> str:
    """What tells an element in a wide one from others."""
    return f"{name if name in _KNOWN else '#'}~{says}"


def _widened(kids: list[dict]) -> list[dict]:
    return _fold([{**k, "sig": by_name(k["name"], k["says"])} if "sig" in k else k for k in kids])


def _matched(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Pairs of places with equal keys, in order on both sides: a longest such list in
    which the n-th of a key meets the n-th."""
    if left == right:
        return [(i, i) for i in range(len(left))]
    def numbered(keys: list[str]) -> list[tuple[str, int]]:
        count: Counter = Counter()
        out = []
        for k in keys:
            out.append((k, count[k]))
            count[k] += 1
        return out

    places = {k: i for i, k in enumerate(numbered(right))}
    both = [(i, places[k]) for i, k in enumerate(numbered(left)) if k in places]
    tails: list[int] = []  # right places that end the shortest-ending runs
    ends: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(both):
        at = bisect_left(tails, j)
        before.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [j], [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(both[n])
        n = before[n]
    return out[::-1]


def align(a: dict, b: dict, pages: bool = True) -> dict:
    """The wrapper of two nodes of one key: slots, optional and repeated parts resolved.
    The nodes are of different ``pages``, or siblings in one."""
    common = {"opt": a["opt"] or b["opt"], "rep": a["rep"] or b["rep"], "seen": a["seen"] + b["seen"] if pages else max(a["seen"], b["seen"])}
    if "sig" not in a:
        text, same = a["text"], max(a["same"], b["same"])
        if text != b["text"] and pages:  # the text that has more votes keeps what it has more
            text, same = (a if a["same"] >= b["same"] else b)["text"], abs(a["same"] - b["same"])
        elif text != b["text"]:
            same = 0
        elif pages:
            same = a["same"] + b["same"]
        return {"text": text if same else None, "size": a["size"] + b["size"], "same": same, **common}
    left, right = a["kids"], b["kids"]
    wide = a["wide"] or b["wide"]
    if wide:
        left, right = (k["kids"] if k["wide"] else _widened(k["kids"]) for k in (a, b))
    kids: list[dict] = []
    i = j = 0
    for x, y in [*_matched(list(map(_key, left)), list(map(_key, right))), (len(left), len(right))]:
        kids += [{**k, "opt": True} for k in left[i:x] + right[j:y]]
        if x < len(left):
            kids.append(align(left[x], right[y], pages))
        i, j = x + 1, y + 1
    kids = _fold(kids)
    if pages and not wide and len(kids) > WIDE:
        kids, wide = _widened(kids), True
    return {**a, "kids": kids, "wide": wide, **common}


def infer(pages: list[str]) -> dict:
    """The wrapper of the pages of a host."""
    return aligned([tree(p) for p in pages if p])


def aligned(trees: list[dict]) -> dict:
    if not trees:
        return _element("#page", "", 0)
    out = trees[0]
    for t in trees[1:]:
        out = align(out, t)
    return out


def packed(node: dict) -> str:
    """A wrapper as a short text; :func:`unpacked` takes it back."""

    def row(n: dict) -> list:
        how = n["opt"] + 2 * n["rep"]
        if "sig" not in n:
            return [n["text"], n["size"], how, n["seen"], n["same"]]
        return [n["sig"], n["name"], n["says"], how + 4 * n["wide"], n["seen"], [row(k) for k in n["kids"]]]

    return json.dumps(row(node), separators=(",", ":"))


def unpacked(text: str) -> dict:
    def node(row: list) -> dict:
        if len(row) == 5:
            held, size, how, seen, same = row
            return {"text": held, "size": size, "opt": how & 1 > 0, "rep": how & 2 > 0, "seen": seen, "same": same}
        sig, name, says, how, seen, kids = row
        return {
            "sig": sig, "name": name, "says": says, "kids": [node(k) for k in kids], "opt": how & 1 > 0, "rep": how & 2 > 0, "wide": how & 4 > 0, "seen": seen,
        }

    return node(json.loads(text))


def expression(node: dict) -> str:
    """The wrapper written as a regular expression over tokens."""
    if "sig" not in node:
        body = "#TEXT" if node["same"] < node["seen"] else json.dumps(node["text"], ensure_ascii=False)
    else:
        body = f"<{node['sig']}>" + "".join(map(expression, node["kids"])) + f"</{node['sig'].split('.')[0]}>"
    return f"({body})+" if node["rep"] else f"({body})?" if node["opt"] else body


def _constant(node: dict) -> bool:
    return node["same"] >= max(CONSTANT, STEADY * node["seen"])


def _prose(node: dict, least: int = 1) -> float:
    """Characters a page of text below a node that may be prose: no links, no constants,
    nothing from elements that say ``least`` or more of themselves."""
    if "sig" not in node:
        return 0.0 if _constant(node) else node["size"] / node["seen"]
    if node["says"] >= least or node["name"] in ("a", "header"):
        return 0.0
    return sum(_prose(k, least) * (k["seen"] / max(1, node["seen"])) for k in node["kids"])


def content(root: dict) -> dict:
    """The node whose inside is the article."""

    def named(node: dict) -> list[tuple[float, dict]]:
        if "sig" not in node or node["says"] == 2:
            return []
        inner = [x for k in node["kids"] for x in named(k)]
        if node["name"] not in ("article", "main") and not node["sig"].endswith(".main"):
            return inner
        own = sum(_prose(k, 2) for k in node["kids"])
        best = max(inner, key=lambda x: x[0], default=(0.0, node))
        return [best if best[0] > own / 2 else (own, node)]

    def heads(node: dict) -> bool:
        return "sig" in node and (node["name"] == "h1" or any(map(heads, node["kids"])))

    found = named(root)
    if found:  # the article has the page's heading, cards beside it have none
        return max(found, key=lambda x: (heads(x[1]), x[0]))[1]
    least = 1 if _prose(root) else 2
    node, whole = root, _prose(root, least)
    while whole:
        inner = max((k for k in node["kids"] if "sig" in k and k["name"] not in _INLINE), key=lambda k: _prose(k, least), default=None)
        if inner is None or inner["rep"] or _prose(inner, least) < 0.7 * whole or inner["name"] not in _HOLDERS | {"html", "body", "td", "tr", "tbody", "form"}:
            break
        node = inner
    return node


def _comments(node: dict) -> bool:
    """Whether a holder has nothing but repeated records with a time, no headings and no long texts."""
    kids = [k for k in node["kids"] if "sig" in k]
    if len(kids) != 1 or len(kids) != len(node["kids"]) or not kids[0]["rep"] or kids[0]["name"] not in ("div", "li", "section", "article"):
        return False
    names, todo = set(), [kids[0]]
    while todo:
        n = todo.pop()
        names.add(n["name"])
        todo += [k for k in n["kids"] if "sig" in k]
    return "time" in names and not names & {"h1", "h2", "h3", "h4", "h5", "h6", "table"} and len(names) > 2


def plan(root: dict) -> dict:
    """What applying the wrapper takes: the way to the content ("c"), elements ("k") by
    signature ("s"), whether they repeat ("r"), and elements ("d") and constants ("t") to
    leave out; "keep" has the wrapper overrule a name."""
    chosen = content(root)
    whole = sum(_prose(k, 2) for k in chosen["kids"])

    def constants(node: dict) -> float:
        if "sig" not in node:
            return node["size"] / node["seen"] if _constant(node) else 0.0
        return sum(map(constants, node["kids"])) if node["says"] < 2 else 0.0

    # pages that are copies of each other show nothing by what they have in common
    fixed = constants(chosen)
    tell = fixed <= whole
    sure = chosen["name"] in ("article", "main")  # what it holds is article text, if its surroundings there don't say otherwise

    def varies(node: dict) -> bool:
        return any(map(varies, node["kids"])) if "sig" in node else not _constant(node)

    def bare(node: dict) -> dict:
        return {"s": node["sig"], "r": 1} if node["rep"] else {"s": node["sig"]}

    def inside(node: dict, top: bool, alone: bool = False) -> dict:
        """``alone``: the block around has no text that varies."""
        out = bare(node)
        listed = sure and node["name"] in ("ol", "ul", "dl", "table")
        if not top and (node["says"] == 2 or not listed and _comments(node) or node["says"] == 1 and sum(_prose(k, 2) for k in node["kids"]) <= whole / 2):
            return {**out, "d": 1}
        if node["says"] == 1:
            out["keep"] = 1
        if node["name"] not in _INLINE and not (sure and not alone and node["name"] in _HEADINGS):
            alone = tell and not top and not varies(node)
        kids = [inside(k, False, alone) for k in node["kids"] if "sig" in k]
        fixed_here = [k["text"] for k in node["kids"] if "sig" not in k] if alone else []
        return {**out, **({"k": kids} if kids else {}), **({"t": fixed_here} if fixed_here else {}), **({"c": 1} if top else {})}

    def way(node: dict) -> dict | None:
        if node is chosen:
            return inside(node, True)
        kids = [way(k) if "sig" in k else None for k in node["kids"]]
        keys = {k["s"] for k in kids if k}
        if not keys:
            return None
        # siblings of the same key hold its place
        return {**bare(node), "k": [x or bare(k) for k, x in zip(node["kids"], kids) if _key(k) in keys]}

    return way(root) or {"s": "#page", "c": 1}


OUT, IN, GONE = 0, 1, 2


def read(events: list[tuple[str, str, str, int]], wrapper: dict) -> str:
    """The text of a page that falls into slots of the content, walking along the wrapper."""
    out: list[str] = []
    # frames: wrapper node or None, place among its kids, state
    frames: list[list] = [[wrapper, 0, IN if wrapper.get("c") else OUT]]
    for kind, value, name, says in events:
        if kind == "text":
            node, _, state = frames[-1]
            if state == IN and not (node and "t" in node and told(value) in node["t"]):
                out.append(value)
            continue
        if kind == "open":
            node, place, state = frames[-1]
            found = None
            if node and state != GONE:
                if "at" not in node:
                    node["at"] = defaultdict(list)
                    for i, k in enumerate(node.get("k", ())):
                        node["at"][k["s"]].append(i)
                key = value if value in node["at"] else by_name(name, says)
                if key in node["at"]:
                    places = node["at"][key]
                    at = places[min(bisect_left(places, place), len(places) - 1)]
                    found = node["k"][at]
                    # a repeated element stays at its place, another gives way to the next
                    frames[-1][1] = at + ("r" not in found)
            if state == OUT and found and found.get("c"):
                state = IN
            elif state == IN and (says == 2 or (found["d"] if found and "d" in found else says == 1 and not (found and "keep" in found))):
                state = GONE
            frames.append([found, 0, state])
        else:
            state = frames.pop()[2]
        if name not in _INLINE and name not in _SILENT and (state == IN or frames[-1][2] == IN):
            out.append(" ")
    return " ".join("".join(out).split())


def main_text(html: str | None, wrapper: dict | None = None) -> str:
    """The article text of a page, by the wrapper of its host, else by its own expression."""
    if not html:
        return ""
    events = read_page(html)
    return (read(events, wrapper) if wrapper else "") or read(events, plan(tree(html)))


# --- on Spark --------------------------------------------------------------


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))


def _rows(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))


_LEAF = {"host": pa.string(), "bucket": pa.int32(), "tree": pa.string()}


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The folded tree of every page, of most copies once."""
    met: set[tuple[str, int]] = set()
    for batch in batches:
        rows = []
        for at, (h, bucket, dice) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
            if (h, dice) not in met:
                if len(met) >= MET:
                    met.clear()
                met.add((h, dice))
                rows.append((h, bucket, packed(tree(batch.column(3)[at].as_py())), dice))
        yield _rows(rows, {**_LEAF, "dice": pa.int64()})


def _align_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrapper of each (host, bucket) from its trees, sorted by hash; equal hashes are copies."""
    here = last = wrapper = None
    for batch in batches:
        done = []
        for h, bucket, text, dice in zip(*(c.to_pylist() for c in batch.columns)):
            if (h, bucket) != here:
                if here:
                    done.append((*here, packed(wrapper)))
                here, wrapper = (h, bucket), unpacked(text)
            elif dice != last:
                wrapper = align(wrapper, unpacked(text))
            last = dice
        yield _rows(done, _LEAF)
    if here:
        yield _rows([(*here, packed(wrapper))], _LEAF)


def _align_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for h, bucket, trees in zip(*(b.column(i) for i in range(3))):
            held = [t["tree"] for t in trees.as_py()]
            yield _rows([(h.as_py(), bucket.as_py(), held[0] if len(held) == 1 else packed(aligned(list(map(unpacked, held)))))], _LEAF)


def large_hosts(pages: DataFrame, leaf: int = LEAF) -> DataFrame:
    """``host, parts``: hosts of more than ``leaf`` pages and into how many leaves, a power of two,
    they are dealt.  There is at most one such host for every ``leaf`` pages."""
    n = pages.groupBy(host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    return n.where(F.col("n") > leaf).select("host", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / leaf))).cast("int").alias("parts"))


def _dealt(rows: DataFrame, large: DataFrame, by: Column) -> DataFrame:
    """``rows`` with ``host`` and ``bucket``, a leaf of the host."""
    met = rows.withColumn("host", host(F.col("url"))).join(F.broadcast(large), "host", "left")
    return met.withColumn("bucket", F.pmod(by, F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def wrappers(pages: DataFrame, leaf: int = LEAF, large: DataFrame | None = None) -> DataFrame:
    """``host, wrapper, plan``: the expression inferred from all pages of each host, and what
    applying it takes.

    Copies of a page (by the hash of its html) count once.  Only folded trees are shuffled, not
    the pages; a task aligns about ``leaf`` pages of a host and holds their wrapper.
    """
    large = large_hosts(pages, leaf) if large is None else large
    keyed = _dealt(pages.where("html <> ''").withColumn("dice", F.xxhash64("html")), large, F.col("dice"))
    trees = keyed.select("host", "bucket", "dice", "html").mapInArrow(_trees, "host string, bucket int, tree string, dice long")
    kind = "host string, bucket int, tree string"
    held = trees.repartition("host", "bucket").sortWithinPartitions("host", "bucket", "dice").mapInArrow(_align_leaves, kind)
    most = large.agg(F.max("parts")).head()[0] or 1
    for _ in range(-(-(most.bit_length() - 1) // FAN)):
        lists = held.groupBy("host", F.shiftright("bucket", FAN).alias("above")).agg(F.sort_array(F.collect_list(F.struct("bucket", "tree"))).alias("trees"))
        held = lists.mapInArrow(_align_wrappers, kind)

    def told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(map(unpacked, b.column(1).to_pylist()))
            yield _rows(
                [(h, expression(w), json.dumps(plan(w))) for h, w in zip(b.column(0).to_pylist(), found)],
                {"host": pa.string(), "wrapper": pa.string(), "plan": pa.string()},
            )

    return held.select("host", "tree").mapInArrow(told_apart, "host string, wrapper string, plan string")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of pages that are sorted by leaf, each leaf's after a row with its host's plan."""
    here = wrapper = None
    for b in batches:
        rows = []
        for at, (key, text) in enumerate(zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(2).to_pylist())):
            if text is not None:
                here, wrapper = key, json.loads(text)
                continue
            found = main_text(b.column(5)[at].as_py(), wrapper if key == here else None)
            rows.append((b.column(3)[at].as_py(), b.column(4)[at].as_py(), found, len(found)))
        yield _rows(rows, {"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_chars": pa.int64()})


def extract(pages: DataFrame, leaf: int = LEAF) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    Pages meet their host's plan in leaves, into each of which a copy of the plan is dealt.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    large = large_hosts(pages, leaf)
    known = wrappers(pages, leaf, large).select("host", "plan").join(F.broadcast(large), "host", "left")
    plans = known.select("host", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)")).alias("bucket"), "plan")
    rows = _dealt(pages, large, F.xxhash64("page_id", "html")).unionByName(plans, allowMissingColumns=True)
    ready = rows.repartition("host", "bucket").sortWithinPartitions("host", "bucket", F.col("plan").desc_nulls_last())
    return ready.select("host", "bucket", "plan", "page_id", "url", "html").mapInArrow(lambda it: tidy(_extract(it)), "page_id long, url string, text string, n_chars long")
