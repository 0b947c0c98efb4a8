"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. The first pass decides blocks by
link density, stop-word density and length, and by evidence of what holds them.
Navigation, adverts, forms and the like are bad; so, on a page with an article,
is what lies outside it. Blocks of links are bad (an article's own prose may be
a link). A long block with many stop words is good, one with few is bad, or,
inside an article, undecided; short ones, and middling ones, are undecided. The
second pass gives an undecided block the label of its nearest neighbours that
the words have decided and that the same kind of container holds: theirs where
both sides agree, else that of the nearer one, the one before on a tie. Where
there is none, an article's block is good and another by its length.

Edge cases: a null or empty page, and one without kept blocks, has an empty
text; class names never drop html, body, main, an article or what holds one
(comments that are articles, and articles in a marked part of another, go with
that part), nor a paragraph or heading unless all its names say so; an anchor
without href is no link, and one that is not closed ends with its block;
unclosed and misnested tags end with their container; a "<" that opens no tag
is text; repeated rows give equal texts; an empty table yields an empty one;
pages of any length are read whole; null page_id and url are kept; extra
columns, whatever their names, are not read.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_LINKS = 0.33
SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH = 0.15, 0.25

#: Elements that end a block where they open and close.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
#: Elements whose text is never part of an article.
DROPPED = frozenset("head title nav aside footer form menu dialog noscript button select option textarea iframe fieldset template object svg".split())
#: Elements whose content is not markup.
RAW = "script|style|textarea|title|template|svg|noframes|xmp"
#: Parts of class, id and role that mark what is not the article.
BOILER = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus reply replies footer copyright pagination pager toolbar complementary contentinfo search skip widget".split())
#: Parts of class, id and role that mark the article.
ARTICLE = frozenset("article articlebody post entry story main content".split())
#: Parts of names that say where something is or of what kind, beside parts that say what it is.
GENERIC = frozenset("box container wrapper wrap list bar section block area link links button buttons unit slot top bottom left right inner outer item items module panel form text body header heading title site page blog global primary secondary mobile desktop js col row group zone holder inline small large the new my article articlebody post entry story main content".split())
#: First parts of names that say what an element has around it, not what it is.
BESIDE = frozenset("has with no without".split())
#: Elements that no class, id or role makes boilerplate.
NEVER = frozenset("html body main article".split())
#: Elements whose text is prose, however much of it is links.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption td th dt dd li address summary".split())
#: Elements that are boilerplate by name only if all their names say so.
WORDED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
STOP_WORDS = frozenset(
    "the of and to in is it that was for on are as with they be at this have from or by not but what all were when we there can an your which their if will do "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an er hat aus bei nach wie dem im einer um am sind noch nur "
    "le la les de des et un une est en que qui dans pour pas au sur par ce se plus avec il ne sont du son ou mais "
    "el los las y del se por con para su al lo como más pero sus una no es".split()
)

_token = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>(?:.*?</(?P=raw)\s*>|.*\Z)|<!\[CDATA\[|<[!?][^>]*>|<(?P<end>/?)(?P<name>[A-Za-z][\w:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_marks = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_quoted = re.compile(r"""\"[^"]*"|'[^']*'""")
_hidden = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)""", re.I)
_unseen = re.compile(r"""aria-hidden\s*=\s*["']?true|\bstyle\s*=\s*(?:"[^"]*|'[^']*)display\s*:\s*none""", re.I)
_href = re.compile(r"""(?:^|\s)href\s*=""", re.I)
_anchor = re.compile(r"<(/?)a(?=[\s>/])", re.I)
_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_word = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    inside: str  # "boiler", "article" or ""
    label: str = ""  # "good" or "bad"; empty: undecided
    by_words: bool = False  # decided by its words
    n_links: int = 0
    of: str = ""  # the nearest element around it that holds blocks
    in_list: int = -1  # place of the nearest list around it


@dataclass(eq=False)
class Marked:
    """Boilerplate by class, id or role alone, until an article opens in it."""

    otherwise: str | Marked
    opened: bool = False


def _settled(inside: str | Marked) -> str:
    while isinstance(inside, Marked):
        if not inside.opened:
            return "boiler"
        inside = inside.otherwise
    return inside


def _names(rest: str) -> list[set[str]]:
    """The parts of each class, id and role of a tag, without names that say what an element has around it."""
    if "=" not in rest:
        return []
    found = [{p.lower() for p in _parts.findall(w)} for m in _marks.finditer(rest) for w in (m[2] or m[3] or m[4] or "").split() if (_parts.findall(w) or ["has"])[0].lower() not in BESIDE]
    return [f for f in found if f]


def _container(name: str, rest: str, inside: str | Marked, nested: bool = False) -> str | Marked:
    """What an element's content is inside of; nested: whether an article element is around it."""
    if inside == "boiler":
        return inside
    if name in DROPPED or rest and (_hidden.search(_quoted.sub("''", rest)) or _unseen.search(rest)):
        return "boiler"
    if name == "header" and _settled(inside) != "article":
        return "boiler"
    names = _names(rest)
    says = [bool(f & BOILER) and all(p in BOILER or p in GENERIC or p.isdigit() for p in f) for f in names]
    boiler = bool(says) and (all(says) if name in WORDED else any(says))
    article = any(f & ARTICLE for f in names)
    if name in ("article", "main"):
        if _settled(inside) == "boiler":
            if name == "article" and (nested or boiler and not article):
                return inside
            while isinstance(inside, Marked):
                inside.opened, inside = True, inside.otherwise
        return "article"
    own = "article" if article and name in ("div", "section", "td") and _settled(inside) != "boiler" else inside
    return Marked(own) if boiler and name not in NEVER else own


def _unclosed(page: str) -> set[int]:
    """Places of anchors that another one, or the page's end, comes before the end tag of."""
    out, last = set(), None
    for m in _anchor.finditer(page):
        if last is not None and not m[1]:
            out.add(last)
        last = None if m[1] else m.start()
    return out | ({last} if last is not None else set())


def blocks(page: str | None) -> list[Block]:
    """The page's blocks with text, in order, undecided."""
    out: list[Block] = []
    stack: list[tuple[str, str | Marked, int]] = []
    parts: list[tuple[str, int]] = []  # text and the place of the link that it is in, or 0
    states: list[str | Marked] = []
    inside, in_link = "", 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
            if text:
                links = sum(len("".join(html.unescape(p).split())) for p, link in parts if link)
                of = next((n for n, _, _ in reversed(stack) if n in BLOCKS), "")
                in_list = next((at for n, _, at in reversed(stack) if n in ("ul", "ol")), -1)
                out.append(Block(text, links, "", n_links=len({link for p, link in parts if link and not p.isspace()}), of=of, in_list=in_list))
                states.append(inside)
            parts.clear()

    page, at = page or "", 0
    unclosed, until_block = _unclosed(page), False
    for m in _token.finditer(page):
        if m.start() > at:
            parts.append((page[at : m.start()], in_link))
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append((" ", 0))
        if name == "a":
            in_link = m.end() if not m["end"] and _href.search(m["rest"]) else 0
            until_block = m.start() in unclosed
        if name in BLOCKS:
            flush()
            if until_block:
                in_link, until_block = 0, False
        if name in VOID:
            continue
        if not m["end"]:
            if m["rest"].endswith("/"):
                continue
            if name == "p" and stack and stack[-1][0] == "p":
                inside = stack.pop()[1]
            new = _container(name, m["rest"], inside, name == "article" and any(n == name for n, _, _ in stack))
            stack.append((name, inside, m.start()))
            if new != inside and parts:
                flush()
            inside = new
        else:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                if stack[depth][1] != inside:
                    flush()
                inside = stack[depth][1]
                del stack[depth:]
    if at < len(page):
        parts.append((page[at:], in_link))
    flush()
    for b, state in zip(out, states):
        b.inside = _settled(state)
    return out


def stop_words(text: str) -> float:
    """Share of a text's words that are stop words."""
    words = _word.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def link_blocks(found: list[Block], article: bool) -> list[bool]:
    """Which blocks are navigation by their links."""
    linked = [b.links / max(1, len(b.text) - b.text.count(" ")) > MOST_LINKS for b in found]
    if not article:
        return linked
    lists: dict[int, list[bool]] = {}
    for b, much in zip(found, linked):
        if b.in_list >= 0:
            lists.setdefault(b.in_list, []).append(much)
    # an article's prose may be links; a list of nothing else, and bare links in a row, are navigation
    return [much and (all(lists[b.in_list]) and len(lists[b.in_list]) > 1 if b.in_list >= 0 else b.of not in PROSE and b.n_links > 1) for b, much in zip(found, linked)]


def decide(found: list[Block]) -> list[Block]:
    """Sets the label of each block: good or bad."""
    article = any(b.inside == "article" for b in found)
    for b, much in zip(found, link_blocks(found, article)):
        stops = stop_words(b.text)
        if b.inside == "boiler" or article and b.inside != "article":
            b.label = "bad"
        elif much:
            b.label, b.by_words = "bad", not article
        elif len(b.text) >= LONG and stops >= STOPS_HIGH:
            b.label, b.by_words = "good", True
        elif not article and ("\xa9" in b.text or len(b.text) >= SHORT and stops < STOPS_LOW):
            b.label, b.by_words = "bad", True
    decided = [i for i, b in enumerate(found) if b.by_words]
    after, inherited = 0, {}
    for i, b in enumerate(found):
        while after < len(decided) and decided[after] < i:
            after += 1
        if not b.label:
            before = decided[after - 1] if after else None
            behind = decided[after] if after < len(decided) else None
            if before is None and behind is None:
                inherited[i] = "good" if article or len(b.text) >= SHORT else "bad"
            else:
                inherited[i] = found[before if behind is None or before is not None and i - before <= behind - i else behind].label
    for i, label in inherited.items():
        found[i].label = label
    return found


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in decide(blocks(page)) if b.label == "good")


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                texts = [main_text(x) for x in rows.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
