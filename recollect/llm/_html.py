"""Text blocks and containers of an HTML page, in one pass over its tags."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

#: Fixed values of HTML: elements that end a block of text, and those without an end tag.
BLOCK = frozenset("address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base basefont br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Elements that are never part of an article.
DROPPED = frozenset("head nav footer aside form script style noscript template iframe noembed noframes svg canvas object button select textarea dialog menu search title datalist audio video map".split())
#: Elements whose paths are voted on.
CONTAINERS = frozenset("body main article section div td th blockquote center details table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element that a start tag closes, looked for up to the given outer elements.
CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words of a class or id that tell what is not the article.
DROPPED_WORDS = frozenset("nav navbar navigation menu menubar header masthead topbar footer colophon sidebar aside ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox newsletter subscribe subscription signup login paywall share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies discussion breadcrumb breadcrumbs pagination pager toolbar widget widgets skip hidden logo brand branding".split())
#: Words beside which the others only describe a layout ("has-sidebar").
LAYOUT_WORDS = frozenset("has with no without layout page wrap wrapper container content main body".split())
STEPS = 6  # innermost steps that a path keeps
STEP_CHARS = 60

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_MARK = re.compile(r"<(?=[a-zA-Z/!?])")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block(NamedTuple):
    container: int  # number of the innermost container
    tag: str  # of the innermost block element
    text: str
    linked: int  # its characters inside links


class Page(NamedTuple):
    blocks: list[Block]
    parents: list[int]  # of the containers; -1 above the first
    tags: list[str]
    paths: list[str]


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): unescape(next((v for v in m.groups()[1:] if v is not None), "")) for m in _ATTRIBUTE.finditer(source)}


def generalised(tag: str, have: dict[str, str]) -> str:
    """A path's step: the tag and its classes (else its id) in order, digits as ``#``."""
    names = sorted(set(have.get("class", "").lower().split())) or have.get("id", "").lower().split()[:1]
    step = ".".join([tag, *(re.sub(r"\d+", "#", n).replace(">", "_") for n in names)])
    return step if len(step) <= STEP_CHARS else step[:STEP_CHARS]


def dropped(tag: str, have: dict[str, str]) -> bool:
    """Whether an element is a menu, notice, advert or other such part by its tag, role, class or id."""
    if tag in DROPPED:
        return True
    if not have:
        return False
    if "hidden" in have or have.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", have.get("style", "")):
        return True
    if have.get("role", "").lower() in DROPPED_ROLES:
        return True
    if tag in ("body", "html", "main") or tag in HEADINGS:
        return False
    for name in [*have.get("class", "").split(), have.get("id", "")]:
        words = [w.lower() for w in _WORD.findall(name)]
        if any(w in DROPPED_WORDS for w in words) and not any(w in LAYOUT_WORDS for w in words[:-1]) and words[-1] not in LAYOUT_WORDS:
            return True
    return False


def parse(html: str | None) -> Page:
    """Blocks of text with the container of each, without dropped elements.

    White space in a block is one space; empty blocks are left out.  The tree is
    built as browsers do in the common cases: paragraphs, list items and cells end by
    themselves, stray end tags are ignored, what is open at the end is closed.  A
    ``header`` is dropped but for its headings when it is inside an article.
    """
    html = html or ""
    blocks: list[Block] = []
    parents, tags, paths = [-1], ["body"], ["body"]
    steps = [["body"]]
    # open block elements: (tag, container, dropped, is it a header inside an article)
    stack: list[tuple[str, int, bool, bool]] = [("body", 0, False, False)]
    pieces: list[str] = []
    links: list[str] = []
    state = {"link": False}

    def flush() -> None:
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                linked = len(" ".join(unescape("".join(links)).split())) if links else 0
                blocks.append(Block(stack[-1][1], stack[-1][0], text, linked))
            pieces.clear()
            links.clear()

    def words(text: str) -> None:
        if not stack[-1][2] and not (stack[-1][3] and stack[-1][0] not in HEADINGS):
            pieces.append(text)
            if state["link"]:
                links.append(text)

    def close(depth: int) -> None:
        flush()
        del stack[depth:]
        state["link"] = False

    at, size, quoted = 0, len(html), True
    while at < size:
        mark = _MARK.search(html, at)
        if mark is None:
            words(html[at:])
            break
        if mark.start() > at:
            words(html[at : mark.start()])
        at = mark.start()
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            if html.startswith(("<!-->", "<!--->"), at):
                end = html.index(">", at) - 2
            at = size if end < 0 else end + 3
            continue
        tag = _TAG.match(html, at) if quoted else _PLAIN_TAG.match(html, at)
        if tag is None and html[at + 1] in "!?/" and not (html[at + 1] == "/" and html[at + 2 : at + 3].isalpha()):
            end = html.find(">", at)
            at = size if end < 0 else end + 1
            continue
        if tag is None and quoted:
            quoted = False  # a quote is open to the end: from here on tags end at the next >
            tag = _PLAIN_TAG.match(html, at)
        if tag is None:
            break  # a tag that never ends
        at = tag.end()
        name, ending = tag[2].lower(), bool(tag[1])
        inside_dropped = stack[-1][2]
        if ending:
            if name == "a":
                state["link"] = False
            if name == "br":
                flush()
            elif name in ("body", "html"):
                flush()
            elif name in BLOCK or inside_dropped:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == name:
                        close(depth)
                        break
                    if inside_dropped and not stack[depth][2]:
                        break
                else:
                    flush()
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            if end is None:
                at = size
            else:
                stop = html.find(">", end.end())
                at = size if stop < 0 else stop + 1
            continue
        if name == "html" or name == "body":
            continue
        if name in VOID:
            if name in ("br", "hr"):
                flush()
            continue
        have = attributes(tag[3]) if tag[3] and not inside_dropped else {}
        goes = inside_dropped or dropped(name, have)
        if not goes and name not in BLOCK:
            if name == "a":
                state["link"] = True
            continue
        if name in BLOCK:
            flush()
            if stack[-1][0] == "p":
                close(len(stack) - 1)
            if name in CLOSES:
                ended, outer = CLOSES[name]
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in ended:
                        close(depth)
                        goes = stack[-1][2] or dropped(name, have)
                        break
                    if stack[depth][0] in outer:
                        break
        elif not inside_dropped and tag[3].endswith("/"):
            continue
        within = stack[-1][1]
        heading = stack[-1][3]
        if name == "header":
            heading = any(t == "article" for t, _, _, _ in stack)
            goes = goes or not heading
        if name in CONTAINERS and not goes:
            steps.append([*steps[within], generalised(name, have)][-STEPS:])
            parents.append(within)
            tags.append(name)
            paths.append(">".join(steps[-1]))
            within = len(parents) - 1
        stack.append((name, within, goes, heading))
    flush()
    return Page(blocks, parents, tags, paths)


_SENTENCE = re.compile(r"[.!?…。！？;:,]")


def scores(page: Page) -> list[int]:
    """Of each container: characters of its blocks that read as text less those that do not.

    A block of mostly linked words counts against its containers, and so does
    a short one without punctuation unless it is a heading.  Where articles (or, without
    any, ``main``) hold at least half of the text, text outside them counts against too.
    """
    parents, tags = page.parents, page.tags
    weights = []
    for b in page.blocks:
        n = len(b.text)
        if 2 * b.linked > n or (n < 25 and b.tag not in HEADINGS and b.tag != "p" and not _SENTENCE.search(b.text)):
            weights.append(-n)
        else:
            weights.append(n - b.linked)
    for kind in ("article", "main"):
        inside = [tags[i] == kind for i in range(len(tags))]
        for i in range(1, len(tags)):
            inside[i] = inside[i] or inside[parents[i]]
        good = sum(w for w in weights if w > 0)
        held = sum(w for w, b in zip(weights, page.blocks, strict=True) if w > 0 and inside[b.container])
        if held and 2 * held >= good:
            weights = [w if inside[b.container] or b.tag in HEADINGS else -abs(w) for w, b in zip(weights, page.blocks, strict=True)]
            break
    total = [0] * len(parents)
    for w, b in zip(weights, page.blocks, strict=True):
        total[b.container] += w
    for i in range(len(parents) - 1, 0, -1):
        total[parents[i]] += total[i]
    return total


def best_container(page: Page) -> int:
    """From the body inwards, as long as one container has two thirds of the score; an article is not entered further.

    Of equal containers the first counts.
    """
    total = scores(page)
    inner = [-1] * len(total)
    for i in range(len(total) - 1, 0, -1):
        have = inner[page.parents[i]]
        if have < 0 or total[i] >= total[have]:
            inner[page.parents[i]] = i
    at = 0
    while page.tags[at] != "article" and inner[at] >= 0 and total[inner[at]] > 0 and 3 * total[inner[at]] >= 2 * total[at]:
        at = inner[at]
    return at


def text_under(page: Page, chosen: set[int]) -> str:
    """The blocks under the chosen containers, in page order, joined by one space.

    Where none of them is a first-level heading, the last one before them is their title.
    """
    under = [i in chosen for i in range(len(page.parents))]
    for i in range(1, len(under)):
        under[i] = under[i] or under[page.parents[i]]
    taken = [n for n, b in enumerate(page.blocks) if under[b.container]]
    if taken and not any(page.blocks[n].tag == "h1" for n in taken):
        taken = [n for n in range(taken[0]) if page.blocks[n].tag == "h1"][-1:] + taken
    return " ".join(page.blocks[n].text for n in taken)
