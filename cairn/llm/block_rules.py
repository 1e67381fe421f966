"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. First pass: each block is decided by where it stands
(menus, headers, footers, sidebars, notices, adverts, forms, reader comments are boilerplate by tag,
role or class), by its link density, and by its length with its density of stop words; inside an article
length alone makes a block good, and outside low density makes none bad in a language the stop words don't
cover (another script, or a page with next to none of them). Second pass: blocks too short to decide take
the label of the nearest blocks decided by links, length or density, those in the same section or `div`
before those of the same article before any other; boilerplate by place is a neighbour only outside
articles, to a section or `div` with no other. Between a good and a bad neighbour at the same distance the
good one wins inside an article, the bad one outside. Good blocks, whole, are the text.

Character references are decoded, white space inside a block (line breaks and <br> too) is one space,
and blocks follow in page order, joined by one line feed. Scripts, styles, markup and comments in the
markup are never text. A tag cut off by the end of the page is dropped.

Defined cases: null and empty html give the empty text with 0 characters; null page_id or url are kept;
repeated rows are extracted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_module
import re
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Tags whose content is no text, that are boilerplate wherever they stand, and that end a block.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea".split())
BOILERPLATE = frozenset("nav footer aside form dialog menu select button fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id attributes that mark boilerplate, as a name's last word or followed by words of `PARTS` only.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner sidebar sidebars menu navbar nav navigation breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent gdpr notice notices alert comment comments disqus respond replies related recommended share sharing social newsletter "
    "subscribe subscription popup modal overlay widget widgets toolbar pagination pager skip login signup search".split()
)
PARTS = frozenset(
    "area bar block body bottom box btn button buttons col column container content cta form grid group head heading holder icon icons inner item items left link links list main "
    "message outer page panel policy post posts primary region right root row secondary section slot text title top unit wrap wrapper zone".split()
)
#: The same, but not inside an article, where a header is its own.
OUTER_MARKS = frozenset("header topbar".split())
#: Frequent function words of the languages the rules know.
STOP_WORDS = frozenset(
    "the of and to in a is that it for on with as was are be by this from or an at which have not has had they we you he she his her its their but were been will would can "
    "der die das und ist in den von zu mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war "
    "le la les de des et est un une en que qui dans pour pas sur au par plus ne se ce avec sont il elle ou du aux son sa ses nous vous mais comme leur cette être fait "
    "el los las de y en que un una es por con para no se su al lo como más del o sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había".split()
)
#: Link density from which a block is boilerplate; words from which a block is long; least stop-word density of a good long block; words of a short one.
LINKS, LONG, DENSITY, SHORT = 0.5, 25, 0.2, 10

_TAGS = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<(?=[a-zA-Z/!?])[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_OTHER_SCRIPT = re.compile("[^\\W\\d_A-Za-zªº\u00c0-\u024f\u1e00-\u1eff]")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_WORDS = re.compile(r"[-_\s]+|(?<=[a-z])(?=[A-Z])")


def _marked(attributes: str, inside: bool) -> bool:
    """Whether role, class or id say boilerplate; a name like has-sidebar says something about what it isn't in."""
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        name = name.lower()
        if name == "hidden" and not value:
            return True
        if name not in ("class", "id", "role"):
            continue
        if name == "role":
            if value.lower() in ROLES:
                return True
            continue
        if any(_names_boilerplate([w.lower() for w in _WORDS.split(token) if w], inside) for token in value.split()):
            return True
    return False


def _names_boilerplate(words: list[str], inside: bool) -> bool:
    """Whether the words of a name end in a mark, or are a mark and words for parts of a page: share-buttons, not share-of-profits."""
    if not words or words[0] in ("has", "with", "no", "without"):
        return False
    marks = MARKS if inside else MARKS | OUTER_MARKS
    return words[-1] in marks or words[0] in marks and all(w in PARTS or w in marks or not w.isalpha() for w in words[1:])


class _Pages:
    """Cuts one page into blocks: (text, characters inside links, boilerplate by place, number of the container, of the article or 0)."""

    def __init__(self, page: str):
        self.blocks: list[tuple[str, int, bool, int, int]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.stack: list[tuple[str, bool, int, int]] = [("", False, 0, 0)]
        #: By tag, and for articles as a whole, where it stands in the stack.
        self.opened: dict[str, list[int]] = defaultdict(list)
        self.containers, self.in_link = 0, 0
        at, n = 0, len(page)
        find = _TAGS.search
        while at < n:
            m = find(page, at)
            self.text(page[at : m.start() if m else n])
            if not m:
                break
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                self.close(tag)
            elif tag in HIDDEN:
                if not m[3].rstrip().endswith("/"):
                    end = re.compile(rf"</{tag}\s*>|\Z" if tag != "head" else r"</head\s*>|(?=<body[\s>])|\Z", re.I).search(page, at)
                    at = end.end()
            else:
                self.open(tag, m[3])
        self.flush()

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(raw)
            if self.in_link:
                self.linked += len(raw.strip())

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html_module.unescape("".join(self.parts)).split())
            if text:
                _, bad, container, inside = self.stack[-1]
                self.blocks.append((text, min(self.linked, len(text)), bad, container, inside))
            self.parts = []
        self.linked = 0

    def open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag == "a":
            self.in_link = 1
            return
        if tag not in BLOCK and tag != "button":
            return
        self.flush()
        self.in_link = 0
        if tag in VOID or tag in ("p", "li", "dt", "dd", "option") and not attributes or attributes.endswith("/"):
            return
        if tag in ("html", "body"):
            return
        _, bad, container, inside = self.stack[-1]
        if tag in MAIN or tag in ("section", "div"):
            self.containers += 1
            container = self.containers
        main = inside or (container if tag in MAIN and not bad else 0)
        bad = bad or tag in BOILERPLATE or (tag == "header" and not inside) or _marked(attributes, main > 0)
        for name in (tag, *("MAIN",) * (tag in MAIN)):
            self.opened[name].append(len(self.stack))
        self.stack.append((tag, bad, container, main))

    def close(self, tag: str) -> None:
        if tag == "a":
            self.in_link = 0
            return
        if tag not in BLOCK and tag != "button":
            return
        self.flush()
        if not self.opened[tag]:
            return
        k = self.opened[tag][-1]
        if tag not in MAIN and tag not in BOILERPLATE and self.opened["MAIN"] and self.opened["MAIN"][-1] > k:
            return  # an end tag that has no start in the article doesn't end the article
        for name, *_ in self.stack[k:]:
            self.opened[name].pop()
            if name in MAIN:
                self.opened["MAIN"].pop()
        del self.stack[k:]


def _measure(text: str) -> tuple[int, int, str]:
    """Words (two characters each in scripts without spaces), stop words, and the script: latin, other, or none where few characters are letters."""
    words = text.split()
    n, other = len(words), 0
    if not text.isascii():
        n, other = max(n, len(_UNSPACED.findall(text)) // 2), len(_OTHER_SCRIPT.findall(text))
    letters = sum(map(str.isalpha, text))
    script = "none" if 2 * letters < len(text) else "other" if 2 * other > letters else "latin"
    return n, sum(w.lower().strip(".,;:!?\"'()") in STOP_WORDS for w in words), script


def _first_pass(measure: tuple[int, int, str], inside: int, covered: bool) -> bool | None:
    """Good, bad, or undecided, of a block that is boilerplate neither by place nor by links."""
    words, stops, script = measure
    if words < SHORT:
        return None
    foreign = script == "other" or script == "latin" and not covered
    if inside or words >= LONG and (foreign or stops >= DENSITY * words):
        return True
    if words >= LONG and stops < DENSITY / 4 * words:
        return False
    return None


def extract(page: str | None) -> str:
    """The main text of a page."""
    blocks = _Pages(page or "").blocks
    if not blocks:
        return ""
    measures = [None if bad or linked > LINKS * len(text) else _measure(text) for text, linked, bad, _, _ in blocks]
    latin = [m for m in measures if m and m[2] == "latin"]
    covered = sum(m[1] for m in latin) >= DENSITY / 4 * sum(m[0] for m in latin)
    first = [_first_pass(m, block[4], covered) if m else False for m, block in zip(measures, blocks, strict=True)]
    verdicts = _second_pass(first, blocks)
    return "\n".join(block[0] for block, good in zip(blocks, verdicts, strict=True) if good)


def _second_pass(first: list[bool | None], blocks: list[tuple[str, int, bool, int, int]]) -> list[bool]:
    """Verdicts of all blocks. Decided blocks are listed by article and container once, and neighbours found by bisection."""
    # places of decided blocks: of the page (0) or of an article, all or without those bad by place; and of a container in these
    own, judged, near = defaultdict(list), defaultdict(list), defaultdict(list)
    some_good: set[int] = set()
    for k, v in enumerate(first):
        if v is None:
            continue
        _, _, by_place, container, inside = blocks[k]
        for article in {0, inside}:
            own[article].append(k)
            if not by_place:
                judged[article].append(k)
                near[article, container].append(k)
            if v:
                some_good.add(article)
    out = []
    for k, v in enumerate(first):
        if v is None:
            _, _, _, container, inside = blocks[k]
            if inside and inside not in some_good:
                # nothing good to inherit in this article: what isn't links or boilerplate is its text
                v = True
            else:
                v = _inherited(k, near[inside, container] or (judged if inside else own)[inside], first, inside > 0)
        out.append(v)
    return out


def _inherited(k: int, places: list[int], first: list[bool | None], tie: bool) -> bool:
    """The label of the nearest of the places, ``tie`` between different ones at one distance, bad without any."""
    j = bisect_left(places, k)
    around = places[max(j - 1, 0) : j + 1]
    if not around:
        return False
    least = min(abs(d - k) for d in around)
    labels = {first[d] for d in around if abs(d - k) == least}
    return bool(labels.pop()) if len(labels) == 1 else tie


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def compute(part: pa.RecordBatch) -> list:
        texts = [extract(page) for page in part.column("html").to_pylist()]
        return [texts, [len(t) for t in texts]]

    return common.add_columns(common.pick(pages, "page_id", "url", "html"), "text string, n_chars long", compute, ["page_id", "url"], "html")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the main text of every page."""
    return extract_pages(common.table(spark, sf_dir, "pages").withColumn("page_id", F.col("page_id").cast("long")))
