"""Main-text extraction with two-pass block rules.

A page is cut into text blocks at block-level tags.  Pass one labels each block from its own
features: stop-word density, length and link density, and beside them the containers it lies in: an article
speaks for it, names of boilerplate against it, and only names that mean nothing else decide alone.  Pass two
lets ambiguous blocks inherit the label of their nearest decided neighbours.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillshift.llm.common import table

#: Common function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which "
    "der die das und ist in den von zu mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat "
    "le la les de des et en un une que qui dans du est pour pas sur au par il plus ne se ce avec son "
    "el los las y una es por con no su para lo como más o pero sus al del".split()
)
#: Elements whose content is never main text.
DROP_TAGS = frozenset("nav header footer aside form button select option fieldset dialog menu noscript template svg canvas object audio video map".split())
#: Elements whose content is not markup.
RAW_TAGS = "script|style|title|textarea|iframe|xmp|noembed|noframes"
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Class or id parts that name boilerplate.
HINTS = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay sidebar widget related recommended recommendations share sharing social breadcrumb breadcrumbs nav navbar navigation menu footer header masthead comment comments disqus reply replies pagination pager toolbar skip login paywall teaser".split()
)
#: Of these the ones that also begin or end names of content (share-price, alert-levels): there the text decides.
DOUBTFUL = frozenset("alert banner footer header login masthead menu modal notice notices overlay popup promotion recommended recommendations share sharing skip social teaser toolbar widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW_TAGS})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>",
    re.S | re.I,
)
OPEN_TAG = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")
WORD = re.compile(r"[^\W\d_]+")
#: How the small print of a page begins.
NOTICE = re.compile(r"(?i)(?:©|\(c\)\s|copyright\b)")


@dataclass(slots=True)
class Block:
    text: str
    link_chars: int
    boiler: bool
    depth_article: int
    depth_main: int
    heading: bool
    doubtful: bool = False
    label: str = ""

    @property
    def link_density(self) -> float:
        return self.link_chars / max(1, len(self.text))

    @property
    def stop_density(self) -> float:
        words = WORD.findall(self.text.lower())
        return sum(w in STOP_WORDS for w in words) / max(1, len(words))


@dataclass(frozen=True)
class Rules:
    """Thresholds of the first pass, in characters and shares."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.12
    stop_high: float = 0.2
    links: float = 0.5


def _boiler(tag: str, attrs: str) -> str:
    """``sure`` for boilerplate by its tag, state or name; ``doubtful`` if only part of a name says so."""
    if tag in DROP_TAGS:
        return "sure"
    if not attrs or tag in ("html", "body"):
        return ""
    found = ""
    for m in ATTR.finditer(attrs):
        name, value = (m[1] or m[5]).lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return "sure"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "sure"
        if name in ("class", "id"):
            for one in value.split():
                parts = [x for x in re.split(r"[-_:]+", one) if x]
                if not parts or parts[0] in ("has", "with", "no", "is"):
                    continue
                if tag in ("article", "main"):
                    if parts[0] in ("comment", "comments", "reply", "teaser", "related", "promo", "ad"):
                        return "sure"
                elif parts[0] in HINTS or parts[-1] in HINTS:
                    if any(x in HINTS and (x not in DOUBTFUL or len(parts) == 1) for x in (parts[0], parts[-1])):
                        return "sure"
                    found = "doubtful"
    return found


def blocks(html: str) -> list[Block]:
    """Text blocks in page order with the features of the first pass."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    boiler = doubts = article = main = links = 0
    text: list[str] = []
    link_chars, heading = 0, False

    def flush() -> None:
        nonlocal link_chars, heading
        if text:
            whole = " ".join("".join(text).split())
            text.clear()
            if whole:
                out.append(Block(whole, min(link_chars, len(whole)), boiler > 0, article, main, heading, doubts > 0))
        link_chars, heading = 0, False

    def add(raw: str) -> None:
        nonlocal link_chars
        if raw:
            said = unescape(raw) if "&" in raw else raw
            text.append(said)
            if links:
                link_chars += len(" ".join(said.split()))

    def pop(to: int) -> None:
        nonlocal boiler, doubts, article, main, links
        while len(stack) > to:
            tag, said = stack.pop()
            bad = said == "sure"
            boiler -= bad
            doubts -= said == "doubtful"
            article -= tag == "article" and not bad
            main -= tag == "main" and not bad
            links -= tag == "a"

    at = 0
    for m in TOKEN.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            if not m[2]:
                # a block that begins ends an open paragraph and what hangs open in it
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        pop(i)
                        break
                    if stack[i][0] in BLOCK_TAGS:
                        break
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in BLOCK_TAGS or not any(t in BLOCK_TAGS for t, _ in stack[i:]):
                        pop(i)
                    break
        elif tag not in VOID_TAGS and not m[4].rstrip().endswith("/"):
            said = _boiler(tag, m[4])
            bad = said == "sure"
            stack.append((tag, said))
            boiler += bad
            doubts += said == "doubtful"
            article += tag == "article" and not bad
            main += tag == "main" and not bad
            links += tag == "a"
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = True
    # a tag that the page's end cuts off is no text
    add(OPEN_TAG.sub("", html[at:]))
    flush()
    return out


def classify(found: list[Block], rules: Rules = Rules()) -> list[Block]:
    """Label blocks ``good`` or ``bad`` in place, by their own features and then by context.

    In an article prose of some length is good by its stop words; short blocks, those without stop words, and a
    paragraph that is one link are left to their neighbours; runs of links are bad.  Under a doubtful name
    only prose is left to its neighbours.  Elsewhere prose must be long and dense.
    """
    live = [b for b in found if not b.boiler]
    by_article = any(b.depth_article for b in live)
    by_main = not by_article and any(b.depth_main for b in live)
    rooted = by_article or by_main
    linked = [b.link_density > rules.links for b in found]
    for i, b in enumerate(found):
        inside = b.depth_article > 0 if by_article else b.depth_main > 0
        if b.boiler or (rooted and not inside):
            b.label = "bad"
        elif linked[i]:
            alone = not any(linked[max(0, i - 1) : i] + linked[i + 1 : i + 2])
            b.label = "short" if rooted and (b.heading or alone) and not b.doubtful else "bad"
        elif b.doubtful:
            b.label = "short" if rooted and b.stop_density >= rules.stop_high else "bad"
        elif not rooted and NOTICE.match(b.text):
            b.label = "bad"
        elif len(b.text) < rules.short:
            b.label = "short"
        elif b.stop_density >= (rules.stop_low if rooted else rules.stop_high) and (rooted or len(b.text) >= rules.long):
            b.label = "good"
        elif not rooted and b.stop_density >= rules.stop_low:
            b.label = "near"
        else:
            # no prose of a known language, but no links either: its neighbours decide
            b.label = "short"
    # context: boilerplate containers do not border the text around them
    flow = [b for b in found if not (b.boiler or (rooted and not (b.depth_article if by_article else b.depth_main)))]
    before: list[tuple[str, int]] = []
    seen, far = "", 0
    for b in flow:
        before.append((seen, far))
        seen, far = (b.label, 0) if b.label in ("good", "bad") else (seen, far + 1)
    after: list[tuple[str, int]] = []
    seen, far = "", 0
    for b in reversed(flow):
        after.append((seen, far))
        seen, far = (b.label, 0) if b.label in ("good", "bad") else (seen, far + 1)
    decided: list[str] = []
    for b, (left, dl), (right, dr) in zip(flow, before, reversed(after), strict=True):
        if b.label in ("good", "bad"):
            decided.append(b.label)
        elif left and right:
            tie = "good" if rooted or b.label == "near" or b.heading else "bad"
            decided.append(left if left == right else tie if dl == dr or b.label == "near" else left if dl < dr else right)
            if rooted and "good" in (left, right):
                decided[-1] = "good"
        else:
            one = left or right
            decided.append("good" if rooted and one != "bad" or b.label == "near" else one or "bad")
            if rooted and not any(x.label == "good" or x.label == "near" for x in flow):
                decided[-1] = "good"
    if not rooted and "good" not in decided:
        # a page of nothing but short lines: what is not a link is its text
        decided = ["good" if b.label == "short" and not b.link_chars else d for b, d in zip(flow, decided, strict=True)]
    for b, label in zip(flow, decided, strict=True):
        b.label = label
    return found


def main_text(html: str | None, rules: Rules = Rules()) -> str:
    if not html:
        return ""
    return " ".join(b.text for b in classify(blocks(html), rules) if b.label == "good")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: Rules = Rules()) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of ``pages``.

    Null or empty html, and pages without main text, give an empty text and 0.  Repeated rows
    give repeated results; an empty table gives an empty table; other columns are ignored.
    Whole pages are read, however long.
    """

    @F.pandas_udf("string")
    def text_of(html: pd.Series) -> pd.Series:
        return html.map(lambda h: main_text(h, rules))

    found = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(text_of(F.col(html_col)), F.lit("")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extract_pages(table(spark, sf_dir, "pages"))
