"""Main text of web pages by scoring the element tree.

Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments go first (by element, role, and words in class and id). Every remaining block of text
is worth one point, one for each comma and up to three for its length; its container gets them
whole, the next ancestor half, and further ones a third by distance. An element's points are
discounted by the share of its text that is in links. Inside an article or main element,
all of that element is kept. Else containers nearly as good as the best share a frame with it;
what they are in is kept, and every sibling there and beside the frame is judged on its whole, a
heading by what follows it, and a title before the text stays.

White space inside a block becomes one space, blocks follow each other by one line end, and
nothing else is dropped or cut. Null pages, and pages without text, have an empty one. Repeated
rows and null ids are kept as they are.
"""

from __future__ import annotations

import html
import re

#: Element names of the HTML standard.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br picture source".split()
)
DROPPED = set(
    "nav footer aside form script style noscript template iframe object embed svg math canvas audio video select option button input textarea "
    "fieldset dialog menu head title datalist map applet noembed noframes xmp".split()
)
PARAGRAPH_ENDS = set(
    "address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li "
    "main menu nav ol p pre section summary table ul".split()
)
#: An opening tag ends open ones of these names, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar tablist".split())
UNWANTED = set(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside ad ads adv advert adverts advertisement advertising adsense "
    "sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "newsletter subscribe subscription signup login register share sharing social related recommended recommendations comment comments "
    "commentlist disqus respond reply replies discussion widget widgets toolbar pagination pager form search".split()
)
COMMENTS = set("comment comments commentlist disqus respond reply replies discussion".split())
AROUND = {"has", "with", "no", "without"}  # "has-sidebar" names a layout, not a sidebar
CONTAINERS = {"html", "body", "main"}
WHOLE = {"article", "main", "body", "html", "#root"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?=[^a-zA-Z])[^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)[^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?+")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    __slots__ = ("tag", "parent", "drop", "link", "points", "chars", "linked", "article")

    def __init__(self, tag: str, parent: Element | None, drop: bool):
        self.tag, self.parent, self.drop = tag, parent, drop
        self.link = tag == "a" or bool(parent and parent.link)
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        self.points, self.chars, self.linked = 0.0, 0, 0


def unwanted(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no part of an article; ``inside``: it is in an article or main."""
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if not attributes or tag in CONTAINERS:
        return False
    found = {}
    for name, value in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    if found.get("role", "").lower() in ROLES and tag != "article":
        return True
    for value in (found.get("class", ""), found.get("id", "")):
        for word in value.split():
            parts = [x.lower() for x in NAME.findall(word)]
            names = {word.lower(), *parts}
            if tag == "article":
                names &= COMMENTS
            if not inside and "header" in parts and not names & {"article", "entry", "post"}:
                return True
            if names & UNWANTED and not names & AROUND:
                return True
    return False


def blocks_of(page: str) -> list[tuple[Element, str]]:
    """The blocks of a page in order, without unwanted elements: container and text."""
    here = Element("#root", None, False)
    stack, blocks, buffer, linked = [here], [], [], 0

    def text(part: str) -> None:
        nonlocal linked
        if part and not here.drop:
            part = html.unescape(part)
            buffer.append(part)
            if here.link:
                linked += len("".join(part.split()))

    def flush() -> None:
        nonlocal linked
        if buffer:
            line = " ".join("".join(buffer).split())
            buffer.clear()
            if line:
                at = here
                while at.tag in INLINE and at.parent:
                    at = at.parent
                blocks.append((at, line))
                size = len(line) - line.count(" ")
                owner = at
                while owner:
                    owner.chars += size
                    owner.linked += linked
                    owner = owner.parent
        linked = 0

    def close(upto: int) -> None:
        nonlocal here
        if any(x.tag not in INLINE for x in stack[upto:]):
            flush()
        del stack[upto:]
        here = stack[-1]

    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    close(i)
                    break
                if name in INLINE and stack[i].tag not in INLINE:
                    break
            else:
                if name == "p":
                    flush()
            continue
        if name == "br":
            text(" ")
            continue
        if name in PARAGRAPH_ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        if name in ENDS:
            ended, barrier = ENDS[name]
            lowest = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in barrier:
                    break
                if stack[i].tag in ended:
                    lowest = i
            if lowest:
                close(lowest)
        if name not in INLINE:
            flush()
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            at = (page.find(">", at) + 1 or len(page)) if end else at
            continue
        if m[3].endswith("/") and name not in INLINE and name in ("svg", "math", "path", "use"):
            continue
        here = Element(name, here, here.drop or unwanted(name, m[3], here.article))
        stack.append(here)
    flush()
    return blocks


def within(x: Element | None, ancestor: Element) -> bool:
    while x and x is not ancestor:
        x = x.parent
    return x is ancestor


def main_blocks(blocks: list[tuple[Element, str]]) -> list[str]:
    """The texts of the blocks that belong to the best container."""
    touched: list[Element] = []
    holders: dict[int, Element] = {}
    single = {"p", "pre", "li", "td", "th", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "figcaption", "address", "summary"}
    for owner, line in blocks:
        points, level = 1 + line.count(",") + min(len(line) / 100, 3), 0
        at = owner.parent if owner.tag in single and owner.parent else owner
        holders[id(at)] = at
        while at:
            if not at.points:
                touched.append(at)
            at.points += points / (1, 2)[level] if level < 2 else points / (3 * level)
            at, level = at.parent, level + 1
    if not touched:
        return []

    def worth(x: Element) -> float:
        return x.points * (1 - min(1.0, x.linked / x.chars if x.chars else 0.0))

    best = max(touched, key=worth)
    top, at = best, best
    while at:
        if at.tag in ("article", "main"):
            top = at
            break
        at = at.parent
    if top.tag in WHOLE:
        return [line for owner, line in blocks if within(owner, top)]

    def dense(x: Element) -> float:
        return x.linked / x.chars if x.chars else 0.0

    # other containers nearly as good: what they share with the best is the frame of the text
    high = [x for x in holders.values() if worth(x) >= worth(best) / 2 and dense(x) < 0.25 and not x.article]
    core = [best, *(x for x in high if not within(x, best) and not within(best, x))]
    above: dict[int, int] = {}  # how many of them an element holds
    for x in core:
        while x:
            above[id(x)] = above.get(id(x), 0) + 1
            x = x.parent
    while above.get(id(top), 0) < len(core):
        top = top.parent
    frames = {id(top): top} if len(core) > 1 else {}
    while top.tag not in WHOLE and top.parent.tag not in WHOLE and top.parent.chars == top.chars:
        top = top.parent  # wrappers of nothing else
    if top.tag not in WHOLE:
        frames[id(top.parent)] = top.parent

    units: dict[int, list] = {}  # children of the frames: element, lines, whether headings only
    homes: list[int | None] = []
    titles: set[int] = set()
    for owner, line in blocks:
        at, home = owner, None
        while at and at.parent and id(at.parent) not in frames and id(at) not in frames:
            at = at.parent
        if at and at.parent and id(at) not in frames:
            home = id(at)
            unit = units.setdefault(home, [at, [], True])
            unit[1].append(line)
            unit[2] = unit[2] and owner.tag in HEADINGS
            if owner.tag == "h1":
                titles.add(home)
        homes.append(home)
    least, kept, after, ahead = max(1.0, worth(best) * 0.2), {}, {}, False
    for key, (at, lines, headings) in reversed(units.items()):
        parent = id(at.parent)
        if key in above:
            kept[key] = ahead = True
        elif at.tag in ("article", "main"):
            kept[key] = False
        elif headings:  # a title before the text; others go with what follows them
            kept[key] = dense(at) < 0.25 and (after.get(parent, False) or ahead and key in titles)
            continue
        else:
            kept[key] = worth(at) >= least or dense(at) < 0.25 and any(len(x) > 80 or x[-1:] in ".!?" for x in lines)
        after[parent] = kept[key]
    return [line for (_, line), home in zip(blocks, homes) if kept.get(home, False)]


def main_text(page: str | None) -> str:
    return "\n".join(main_blocks(blocks_of(page or "")))
