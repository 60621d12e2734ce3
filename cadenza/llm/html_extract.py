"""Operator 3, main-text extraction from HTML by block classification.

A page is read once into flat text blocks: the text between two block-level
tags, with white space collapsed and character references decoded.  Every
block gets its word count, its link density (share of its words inside
links), the same two of the block before and after, the longest running text
within ``NEAR`` blocks of it, whether it is a heading or an item of a list or
table, whether running text elsewhere on the page is marked as the article, and its region: inside a part marked as page furniture (navigation, header,
footer, aside, advert, comments ...), inside a part marked as the article,
inside a form or a part whose name only suggests furniture (a page may be
wrapped in one: an article or main element in it is the article again, and
long running text stays), or none of these.  All of an article is kept, lists
of links too: what does not belong to it there says so by its tag or name.  Where
a page has nothing to keep, its unmarked blocks are kept that are not mostly links.
Decision trees, trained by Spark ML on the small
labelled table below, one for each region, keep or drop each block.  The fitted trees (a few
dozen numbers) travel to the tasks, and pages are handled one by one: one
pass over the table, no shuffle.

Edge cases: null or empty html gives an empty text; unclosed comments and
scripts run to the end of the page, as does a tag with no '>' behind it; stray
quotes in a tag do not hold it open; the end tag of a head may be missing;
repeated pages give repeated rows;
an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import small_arrow, small_batches

FEATURES = ["words", "density", "prev_words", "prev_density", "next_words", "next_density", "region", "heading",
            "near", "item", "marked"]
NEAR = 6
NEUTRAL, ARTICLE, FURNITURE, DOUBTFUL = 0.0, 1.0, 2.0, 3.0

# The labelled blocks.  The features in the order above, then 1 to keep.  Rows of nine values leave out
# near (the longer of the neighbours that are not links) and item (0); those without marked hold for both of its values.
LABELLED = [
    # in the article: headings, paragraphs of any length, list items, quotes, captions
    (8, 0.0, 6, 1.0, 40, 0.0, 1, 1, 1), (5, 0.0, 12, 0.0, 60, 0.0, 1, 1, 1), (3, 0.0, 80, 0.0, 30, 0.0, 1, 1, 1),
    (1, 0.0, 40, 0.0, 55, 0.0, 1, 0, 1), (2, 0.0, 3, 0.0, 2, 0.0, 1, 0, 1), (14, 0.0, 90, 0.0, 2, 0.0, 1, 0, 1),
    (60, 0.0, 8, 0.0, 75, 0.0, 1, 0, 1), (120, 0.05, 60, 0.0, 80, 0.1, 1, 0, 1), (30, 0.3, 50, 0.0, 1, 0.0, 1, 0, 1),
    (9, 0.5, 70, 0.0, 66, 0.0, 1, 0, 1), (4, 1.0, 50, 0.0, 45, 0.0, 1, 0, 1), (250, 0.0, 30, 0.0, 9, 0.2, 1, 0, 1),
    (40, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (6, 0.0, 6, 0.0, 6, 0.0, 1, 0, 1), (1, 0.0, 0, 0.0, 8, 0.2, 1, 0, 1),
    (12, 0.9, 40, 0.0, 30, 0.0, 1, 0, 1), (2, 0.0, 4, 1.0, 15, 0.0, 1, 0, 1), (20, 0.0, 10, 0.1, 5, 0.0, 1, 0, 1),
    # link lists inside the article part
    (3, 1.0, 3, 1.0, 3, 1.0, 1, 0, 1), (5, 1.0, 4, 1.0, 6, 1.0, 1, 0, 1), (2, 1.0, 2, 1.0, 2, 1.0, 1, 0, 1),
    # page furniture, whatever it says
    (1, 1.0, 1, 1.0, 1, 1.0, 2, 0, 0), (2, 1.0, 0, 0.0, 1, 1.0, 2, 0, 0), (9, 0.0, 1, 1.0, 8, 0.0, 2, 0, 0),
    (9, 0.1, 60, 0.0, 0, 0.0, 2, 0, 0), (45, 0.0, 9, 0.0, 50, 0.0, 2, 0, 0), (120, 0.0, 100, 0.0, 80, 0.0, 2, 0, 0),
    (14, 0.0, 30, 0.0, 20, 0.0, 2, 1, 0), (3, 0.0, 90, 0.0, 25, 0.0, 2, 1, 0), (25, 0.4, 14, 0.5, 11, 0.6, 2, 0, 0),
    (6, 0.0, 80, 0.0, 8, 0.0, 2, 0, 0), (18, 0.0, 2, 0.0, 16, 0.0, 2, 0, 0), (1, 0.0, 3, 0.0, 2, 0.0, 2, 0, 0),
    (70, 0.0, 30, 0.0, 20, 0.0, 2, 0, 0), (2, 0.0, 6, 0.0, 6, 0.0, 2, 1, 0), (200, 0.0, 0, 0.0, 0, 0.0, 2, 0, 0),
    # a form, or a part with a name like furniture: labels, notices, link lists
    (1, 1.0, 1, 1.0, 1, 1.0, 3, 0, 0), (9, 0.0, 1, 1.0, 8, 0.0, 3, 0, 0), (45, 0.0, 9, 0.0, 3, 0.5, 3, 0, 0),
    (3, 0.0, 0, 0.0, 0, 0.0, 3, 0, 0), (25, 0.4, 14, 0.5, 11, 0.6, 3, 0, 0), (14, 0.0, 30, 0.0, 20, 0.0, 3, 1, 0),
    (18, 0.0, 2, 0.0, 16, 0.0, 3, 0, 0), (2, 0.0, 6, 0.0, 6, 0.0, 3, 1, 0), (40, 0.95, 3, 1.0, 5, 1.0, 3, 0, 0),
    (6, 0.0, 80, 0.0, 8, 0.0, 3, 0, 0), (70, 0.9, 30, 0.0, 20, 0.0, 3, 0, 0), (5, 1.0, 70, 0.0, 60, 0.0, 3, 0, 0),
    (30, 0.0, 0, 0.0, 2, 1.0, 3, 0, 0), (3, 0.0, 2, 0.0, 90, 0.0, 3, 0, 0), (120, 0.8, 3, 1.0, 2, 0.0, 3, 0, 0),
    (4, 0.0, 3, 1.0, 5, 1.0, 3, 1, 0), (2, 0.0, 1, 1.0, 2, 1.0, 3, 1, 0), (3, 0.0, 0, 0.0, 12, 0.0, 3, 1, 0),
    # ... but long running text there, its headings, short lines between it
    (60, 0.0, 8, 0.0, 75, 0.0, 3, 0, 1), (120, 0.05, 60, 0.0, 80, 0.1, 3, 0, 1), (250, 0.0, 30, 0.0, 9, 0.2, 3, 0, 1),
    (150, 0.1, 8, 0.0, 3, 0.5, 3, 0, 1), (90, 0.0, 0, 0.0, 0, 0.0, 3, 0, 1), (65, 0.0, 4, 0.0, 2, 1.0, 3, 0, 1),
    (12, 0.0, 70, 0.0, 90, 0.0, 3, 0, 1), (25, 0.1, 80, 0.0, 75, 0.0, 3, 0, 1), (5, 0.0, 70, 0.0, 95, 0.0, 3, 1, 1),
    (7, 0.0, 2, 0.0, 85, 0.0, 3, 1, 1), (4, 0.0, 1, 1.0, 120, 0.0, 3, 1, 1), (30, 0.0, 90, 0.0, 70, 0.0, 3, 0, 1),
    (2, 0.0, 1, 1.0, 90, 0.0, 3, 1, 1), (3, 0.0, 5, 1.0, 70, 0.0, 3, 1, 1), (9, 0.0, 0, 0.0, 60, 0.0, 3, 1, 1),
    (2, 0.0, 3, 1.0, 80, 0.1, 3, 1, 1), (6, 0.0, 9, 0.2, 110, 0.0, 3, 1, 1), (4, 0.0, 20, 0.0, 75, 0.0, 3, 1, 1),
    # ... where nothing else is the article, shorter running text too
    (48, 0.0, 0, 0.0, 48, 0.0, 3, 0, 48, 0, 0, 1), (48, 0.0, 48, 0.0, 6, 0.0, 3, 0, 48, 0, 0, 1), (3, 0.0, 48, 0.0, 48, 0.0, 3, 0, 48, 0, 0, 1),
    (45, 0.0, 40, 0.0, 0, 0.0, 3, 0, 40, 0, 0, 1), (42, 0.0, 3, 0.0, 55, 0.0, 3, 0, 55, 0, 0, 1), (8, 0.0, 48, 0.0, 50, 0.0, 3, 0, 50, 0, 0, 1),
    (48, 0.0, 0, 0.0, 48, 0.0, 3, 0, 48, 0, 1, 0), (48, 0.0, 48, 0.0, 6, 0.0, 3, 0, 48, 0, 1, 0), (3, 0.0, 48, 0.0, 48, 0.0, 3, 0, 48, 0, 1, 0),
    (45, 0.0, 40, 0.0, 0, 0.0, 3, 0, 40, 0, 1, 0), (42, 0.0, 3, 0.0, 55, 0.0, 3, 0, 55, 0, 1, 0), (8, 0.0, 48, 0.0, 50, 0.0, 3, 0, 50, 0, 1, 0),
    # no marked part: running text, its headings, short lines between running text
    (40, 0.0, 1, 1.0, 60, 0.0, 0, 0, 1), (80, 0.05, 40, 0.0, 30, 0.0, 0, 0, 1), (25, 0.1, 60, 0.0, 4, 1.0, 0, 0, 1),
    (150, 0.1, 8, 0.0, 3, 0.5, 0, 0, 1), (18, 0.0, 30, 0.0, 25, 0.0, 0, 0, 1), (6, 0.0, 40, 0.0, 50, 0.0, 0, 0, 1),
    (5, 0.0, 70, 0.0, 45, 0.0, 0, 1, 1), (7, 0.0, 2, 1.0, 55, 0.0, 0, 1, 1), (30, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1),
    (12, 0.0, 45, 0.0, 35, 0.0, 0, 0, 1), (16, 0.2, 50, 0.0, 40, 0.0, 0, 0, 1), (4, 0.0, 20, 0.0, 60, 0.0, 0, 1, 1),
    # ... items of lists and tables near running text, and the headings over them
    (2, 0.0, 1, 0.0, 2, 0.0, 0, 0, 40, 1, 1), (1, 0.0, 3, 0.0, 2, 0.0, 0, 0, 60, 1, 1), (3, 0.0, 2, 0.0, 4, 0.0, 0, 0, 25, 1, 1),
    (2, 0.0, 45, 0.0, 1, 0.0, 0, 0, 45, 1, 1), (9, 0.0, 8, 0.0, 12, 0.0, 0, 0, 30, 1, 1), (1, 0.0, 2, 0.0, 1, 0.0, 0, 0, 120, 1, 1),
    (2, 0.0, 1, 0.0, 3, 0.0, 0, 0, 20, 1, 1), (5, 0.0, 3, 0.0, 30, 0.0, 0, 0, 30, 1, 1), (3, 0.0, 1, 0.0, 1, 0.0, 0, 0, 22, 1, 1),
    (1, 0.0, 40, 0.0, 2, 0.0, 0, 1, 60, 0, 1), (2, 0.0, 50, 0.0, 3, 0.0, 0, 1, 50, 0, 1), (1, 0.0, 2, 0.0, 25, 0.0, 0, 1, 40, 0, 1),
    (1, 0.0, 4, 0.0, 2, 0.0, 0, 1, 30, 0, 1),
    # ... but not where no running text is near, nor lists of links
    (3, 0.0, 2, 0.0, 4, 0.0, 0, 0, 4, 1, 0), (2, 0.0, 1, 0.0, 2, 0.0, 0, 0, 6, 1, 0), (1, 0.0, 2, 1.0, 3, 1.0, 0, 0, 2, 1, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 50, 1, 0), (4, 1.0, 3, 1.0, 5, 1.0, 0, 0, 60, 1, 0), (2, 1.0, 30, 0.0, 2, 1.0, 0, 0, 30, 1, 0),
    (6, 0.9, 4, 1.0, 40, 0.0, 0, 0, 40, 1, 0), (3, 0.0, 0, 0.0, 3, 0.0, 0, 0, 3, 1, 0), (1, 0.0, 1, 0.0, 1, 0.0, 0, 0, 1, 1, 0),
    # no marked part: menus, link lists, dates, credits, labels
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), (4, 1.0, 3, 1.0, 5, 1.0, 0, 0, 0), (2, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0),
    (8, 0.8, 5, 0.9, 7, 0.9, 0, 0, 0), (22, 0.9, 20, 0.9, 18, 0.9, 0, 0, 0), (5, 0.0, 60, 0.0, 3, 1.0, 0, 0, 0),
    (3, 0.0, 2, 0.0, 4, 0.0, 0, 0, 0), (9, 0.4, 4, 1.0, 6, 1.0, 0, 0, 0), (6, 0.2, 50, 0.0, 0, 0.0, 0, 0, 0),
    (12, 0.6, 30, 0.0, 10, 0.8, 0, 0, 0), (2, 0.0, 5, 0.0, 3, 0.0, 0, 1, 0), (40, 0.95, 3, 1.0, 5, 1.0, 0, 0, 0),
]

# Built by rule: links go wherever no article is marked, as do labels and lone short lines with no running text near
LABELLED += [(n, density, *prev, *after, region, 0, near, item, 0)
             for region in (NEUTRAL, DOUBTFUL) for n in (1, 2, 4, 9, 30) for density in (0.8, 1.0) for item in (0, 1)
             for near, prev, after in ((2, (2, 1.0), (3, 1.0)), (60, (60, 0.0), (2, 1.0)), (90, (3, 1.0), (90, 0.0)),
                                       (0, (0, 0.0), (0, 0.0)), (48, (48, 0.0), (48, 0.0)))]
LABELLED += [(n, 0.0, *prev, *after, region, 0, near, item, 0)
             for region in (NEUTRAL, DOUBTFUL) for n in (1, 2, 4, 7) for item in (0, 1)
             for near, prev, after in ((2, (2, 0.0), (2, 0.0)), (3, (0, 0.0), (3, 0.0)), (8, (8, 0.0), (2, 1.0)),
                                       (5, (2, 1.0), (5, 0.0)), (0, (2, 1.0), (3, 1.0)))]
# ... a label behind running text in a form or a part named like furniture
LABELLED += [(n, 0.0, before, 0.0, 0, 0.0, DOUBTFUL, 0, before, 0, 0) for n in (1, 2, 3) for before in (48, 70, 120)]

# Tags that end a block, and those whose text is never shown (head is not one: what it may hold is,
# and any other tag or text ends it, with or without its end tag)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_ITEM = frozenset("li td th dt dd".split())
_HIDDEN = frozenset("script style noscript noframes template svg math iframe object canvas title textarea select "
                    "audio video map".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE_TAGS = frozenset("nav aside footer menu dialog button".split())
_DOUBTFUL_TAGS = frozenset("form fieldset".split())
_ROLES = {"navigation": FURNITURE, "banner": FURNITURE, "contentinfo": FURNITURE, "complementary": FURNITURE,
          "search": FURNITURE, "form": DOUBTFUL, "dialog": FURNITURE, "alert": FURNITURE, "menu": FURNITURE,
          "main": ARTICLE, "article": ARTICLE}
# names are matched whole: one word of furniture, or several with words of place and kind; other readers' words and
# links to other pages are furniture for certain, in nested articles too
_CERTAIN_NAME = (r"(?:ads?|advert\w*|sponsor\w*|comments?|commentlist|disqus|respond|repl(?:y|ies)|related|recommend\w*|"
                 r"outbrain|taboola|teasers?|breadcrumbs?|pagination|pager|nav|navbar|navigation|footer|masthead|topbar)")
_FURNITURE_NAME = (
    rf"(?:{_CERTAIN_NAME}|promo\w*|banner\w*|nav\w*|menu\w*|side-?bar\w*|cookies?|consent|gdpr|notices?|disclaimer|"
    r"legal|copyright|discussion|share|sharing|social|newsletter|subscri\w+|signup|login|search|popup|modal|overlay|"
    r"widgets?|toolbar|alert|toast|skip)")
_PLACE = (r"(?:site|page|global|main|top|bottom|left|right|primary|secondary|first|second|wrapper|wrap|inner|outer|"
          r"container|box|bar|area|section|block|region|list|items?|links?|posts?|article|entry|the|header|head|form|"
          r"panel|group|row|title|text|body|content|meta|message|buttons?|icons?|[a-z]|\d+)")
_CERTAIN, _FURNITURE_NAMES = (re.compile(rf"(?:{_PLACE}[-_]+)*{n}(?:[-_]+(?:{_FURNITURE_NAME}|{_PLACE}))*")
                              for n in (_CERTAIN_NAME, _FURNITURE_NAME))
_ARTICLE_NAMES = re.compile(r"(?:article|post|entry|story|content|main)(?:body|content|text)?")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s"'>]+))?""")
# quotes count only around a value; a quoted value with a '>' must be followed by what may follow one, else its
# quote was never closed, is read as a plain character, and the tag ends at its next '>'
_TAG = re.compile(
    r"""</?([a-zA-Z][^\s/>]*+)((?>[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+"""
    r"""(?>"[^">]*+"|"[^"]*+"(?=[\s/>])|'[^'>]*+'|'[^']*+'(?=[\s/>])|[^\s"'>][^\s>]*+))?)*+)>""")
_BROKEN_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)>")


def _region(tag: str, attributes: str, around: float) -> float | None:
    """The region that an element opens, if it opens one."""
    if around == FURNITURE:
        return None
    if tag in _FURNITURE_TAGS or tag == "header" and around != ARTICLE:
        return FURNITURE
    found = ARTICLE if tag in ("article", "main") else DOUBTFUL if tag in _DOUBTFUL_TAGS else None
    if not attributes or tag in ("html", "head", "body"):
        return found
    given = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        given.setdefault(name.lower(), value.strip("\"'").lower())
    if "hidden" in given or given.get("aria-hidden") == "true":
        return FURNITURE
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "")):
        return FURNITURE
    role = _ROLES.get(given.get("role", ""))
    if role == FURNITURE:
        return FURNITURE
    found = found if role is None else role
    # an article in an article is a comment or a link to another page if its name says so
    exempt = found == ARTICLE and (tag != "article" or around != ARTICLE)
    names = [(word, re.split(r"[-_]+", word)) for word in f"{given.get('class', '')} {given.get('id', '')}".split()]
    names = [(word, parts) for word, parts in names if parts[0] not in ("has", "with", "no", "is")]
    if not exempt:
        if any(_CERTAIN.fullmatch(word) for word, _ in names):
            return FURNITURE
        if found is None and any(_FURNITURE_NAMES.fullmatch(word) for word, _ in names):
            found = DOUBTFUL
        if any("header" in parts and "article" not in parts for _, parts in names) and ARTICLE not in (around, found):
            return FURNITURE
    if found is None:
        for word, parts in names:
            if _ARTICLE_NAMES.fullmatch(word) or around != DOUBTFUL and _ARTICLE_NAMES.fullmatch(parts[-1]) \
                    or _ARTICLE_NAMES.fullmatch("".join(parts)):
                return ARTICLE
    return found


def blocks(page: str) -> list[tuple[str, int, float, float, float, float]]:
    """(text, words, link density, region, heading, item) of each block, in page order."""
    out: list[tuple] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, float]] = []  # open elements with the region inside each
    links = headings = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
            if text:
                linked = len(html.unescape(" ".join(p for p, inside in parts if inside)).split())
                n = len(text.split(" "))
                out.append((text, n, min(1.0, linked / n), stack[-1][1] if stack else NEUTRAL, float(headings > 0),
                            float(any(t in _ITEM for t, _ in stack[-3:]))))
            parts.clear()

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            parts.append((page[at:lt], links > 0))
        if lt == end:
            break
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page[lt + 1:lt + 2] in ("!", "?"):
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        m = _TAG.match(page, lt)
        if not m and re.match(r"</?[a-zA-Z]", page[lt:lt + 3]):
            m = _BROKEN_TAG.match(page, lt)
            if not m:
                break  # a tag cut off by the end of the page
        if not m:
            parts.append(("<", links > 0))
            at = lt + 1
            continue
        at = m.end()
        tag, closing = m[1].lower(), page[lt + 1] == "/"
        if tag in _HIDDEN and not closing:
            if not m[2].rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag == "br":
            parts.append((" ", links > 0))
            continue
        if tag in _BLOCK:
            flush()
        if closing:
            if any(t == tag for t, _ in stack):
                while True:
                    t, _ = stack.pop()
                    if t in _BLOCK:
                        flush()
                    links -= t == "a"
                    headings -= t in _HEADING
                    if t == tag:
                        break
            continue
        if tag in _VOID or m[2].rstrip().endswith("/"):
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            # these end an open element of their kind, or a paragraph
            for k in range(len(stack) - 1, -1, -1):
                t = stack[k][0]
                if t == tag or t == "p" and tag != "p":
                    for gone, _ in stack[k:]:
                        links -= gone == "a"
                        headings -= gone in _HEADING
                    del stack[k:]
                    break
                if t in _BLOCK and t != "p":
                    break
        around = stack[-1][1] if stack else NEUTRAL
        inside = _region(tag, m[2], around)
        if inside is not None and tag not in _BLOCK and inside != around:
            flush()
        stack.append((tag, around if inside is None else inside))
        links += tag == "a"
        headings += tag in _HEADING
    flush()
    return out


def block_features(found: list[tuple]) -> list[tuple[float, ...]]:
    rows = []
    running = [n if density < 0.3 and region != FURNITURE else 0 for _, n, density, region, *_ in found]
    marked = float(any(n >= 20 and b[3] == ARTICLE for n, b in zip(running, found)))
    for i, (_, n, density, region, heading, item) in enumerate(found):
        prev = found[i - 1][1:3] if i else (0, 0.0)
        after = found[i + 1][1:3] if i + 1 < len(found) else (0, 0.0)
        near = max(running[max(0, i - NEAR):i] + running[i + 1:i + 1 + NEAR], default=0)
        rows.append((n, density, *prev, *after, region, heading, near, item, marked))
    return rows


def _labelled(row: tuple) -> list[tuple[float, ...]]:
    """A labelled block with all its features."""
    *x, label = row
    if len(x) == 8:
        x += [max(x[2] if x[3] < 0.3 else 0, x[4] if x[5] < 0.3 else 0), 0]
    return [(*x, label)] if len(x) == len(FEATURES) else [(*x, 0, label), (*x, 1, label)]


def fit_tree(spark: SparkSession, depth: int = 8) -> list[tuple[int, float, int, int, int]]:
    """Train on the labelled table; the nodes as (feature or -1, threshold,
    left, right, label), the root first."""
    nodes: list[tuple] = []

    def learn(labelled: list[tuple]) -> int:
        labels = {r[-1] for r in labelled}
        if len(labels) == 1:
            nodes.append((-1, 0.0, 0, 0, labels.pop()))
            return len(nodes) - 1
        rows = spark.createDataFrame([tuple(map(float, r)) for r in labelled], [*FEATURES, "label"]).coalesce(1)
        data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
        model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, seed=1).fit(data)
        return walk(model._java_obj.rootNode())

    def walk(node) -> int:
        at = len(nodes)
        nodes.append(())
        if node.subtreeDepth() == 0:
            nodes[at] = (-1, 0.0, 0, 0, int(node.prediction()))
        else:
            split = node.split()
            left, right = walk(node.leftChild()), walk(node.rightChild())
            nodes[at] = (split.featureIndex(), split.threshold(), left, right, 0)
        return at

    # each region has a tree of its own, so that its rows do not move the thresholds of the others
    at, regions = FEATURES.index("region"), [NEUTRAL, ARTICLE, FURNITURE, DOUBTFUL]
    nodes.extend([()] * (len(regions) - 1))
    roots = [learn([x for r in LABELLED for x in _labelled(r) if x[at] == region]) for region in regions]
    for i in range(len(regions) - 1):
        nodes[i] = (at, regions[i] + 0.5, roots[i], i + 1 if i + 2 < len(regions) else roots[-1], 0)
    return nodes


def classify(tree: list[tuple], x: tuple[float, ...]) -> int:
    at = 0
    while tree[at][0] >= 0:
        feature, threshold, left, right, _ = tree[at]
        at = left if x[feature] <= threshold else right
    return tree[at][4]


def main_text(page: str | None, tree: list[tuple]) -> tuple[str, int, int]:
    """Kept blocks joined by line ends, and how many were kept and found."""
    found = blocks(page or "")
    kept = [b[0] for b, x in zip(found, block_features(found)) if classify(tree, x)]
    if not kept:
        kept = [b[0] for b in found if b[3] == NEUTRAL and b[2] < 0.5]
    return "\n".join(kept), len(kept), len(found)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, kept_blocks and all_blocks per page."""
    tree = fit_tree(pages.sparkSession)

    def run(batches):
        for batch in small_batches(batches, 2):
            got = [main_text(h, tree) for h in batch.column(2).to_pylist()]
            text, kept, found = zip(*got)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()),
                 pa.array([len(t) for t in text], pa.int64()), pa.array(kept, pa.int32()), pa.array(found, pa.int32())],
                names=["page_id", "url", "text", "n_chars", "kept_blocks", "all_blocks"])

    rows = small_arrow(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, kept_blocks int, all_blocks int")
