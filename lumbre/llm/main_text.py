"""Main text of web pages as the contiguous region with the greatest score.

A page is a sequence of tags and words.  Words score positive, tags negative, all inside menus and the like slightly negative; one linear
scan finds the contiguous region with the greatest sum.  What lies in the region but in a menu, advert, form or comment is left out: elements that
HTML or a whole class, id or role name calls so, unless hardly a word of content lies around them.  Such an element is the page itself.

The weights come from labelled pages: pages that mark their content with exactly one ``article`` (or ``main``) element, of which a bounded sample by
hash is read.  A tag costs the more the more often it stood outside the content; how much is the value that rebuilds the labelled
contents best.  Extraction itself gives no credit for that element: pages without it are read the same way.

Text: character references are decoded, white space in a block becomes one space, blocks are joined by line breaks; a ``br`` is white space.

Defined cases: a null or empty page, or one without content, gives an empty text; markup that breaks off is read to its end; tags that are
never closed end with the element around them; without labelled pages every tag costs DEFAULT_COST; of equal regions the first, and of
those the longest, is taken; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled pages that weights are fitted on.
MAX_LABELLED = 2_000
DEFAULT_COST = 2.0
LEAST_COST = 0.05
SCALES = (1.0, 2.0, 4.0, 8.0, 16.0)
#: A tag or word inside a menu, advert, form or comment.  It is left out of the text in any case, so it hardly parts what stands around it.
ASIDE_COST = 0.01
SPACE = re.compile("[ \t\n\x0b\x0c\r]+")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title|select)\b.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>"
    # A quoted value may hold ">"; a quote that never ends is a character like others.
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
# Elements of HTML by what they do.
ASIDE_TAGS = frozenset("head nav header footer aside form button label fieldset dialog menu".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_TAGS = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
LABEL_TAGS = ("article", "main")
# Words in class, id or role attributes that name what is not content.
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer form gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices"
    " notification notifications popup promo promoted related replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
# What a box around such things is called, as the last part of a name like ``ad-slot``.
BOX_NAMES = frozenset("area bar block body box col column container content frame group holder inner item items link links list outer panel row section slot unit wrap wrapper zone".split())
# First parts of names that say the contrary, or something about the page.
OTHER_NAMES = frozenset("has hide is no non not with without".split())
#: An element with so few other words of content around it, as a share of its own, is the page and not an aside, whatever it is called.
LEAST_AROUND = 0.05
ATTRIBUTE = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
PARTS = re.compile(r"[-_]+")


def _names_an_aside(name: str) -> bool:
    """Whole names, names that end in one (``site-footer``), and boxes of one (``ad-slot``); not ``no-sidebar`` or ``comment-on-law``."""
    if name in ASIDE_NAMES:
        return True
    parts = [p.rstrip("0123456789") for p in PARTS.split(name)]
    parts = [p for p in parts if p]
    if not parts or parts[0] in OTHER_NAMES:
        return False
    return parts[-1] in ASIDE_NAMES or (parts[0] in ASIDE_NAMES and all(p in BOX_NAMES or p in ASIDE_NAMES for p in parts[1:]))


def _is_aside(tag: str, attrs: str) -> bool:
    if tag in ASIDE_TAGS:
        return True
    if tag in ("html", "body", "article", "main") or "=" not in attrs:
        return False
    return any(_names_an_aside(name) for found in ATTRIBUTE.findall(attrs) for name in "".join(found).lower().split())


def tokens(page: str) -> list[tuple[str, str, bool, bool]]:
    """(tag or empty, text, inside an aside, inside the labelling element) in page order."""
    out: list[tuple[str, str, bool, bool]] = []
    #: Name and, for asides, where each open element begins in ``out``; (begin, end) of the asides that are over.
    open_tags: list[tuple[str, int]] = []
    asides: list[tuple[int, int]] = []
    labelled = 0

    def close(aside: int) -> None:
        if aside >= 0:
            asides.append((aside, len(out)))

    for m in TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            out.append(("", html.unescape(text), False, labelled > 0))
            continue
        if m["raw"]:
            out.append((m["raw"].lower(), "", True, labelled > 0))
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        attrs = m["attrs"]
        if m["close"]:
            ended = []
            if any(t == tag for t, _ in open_tags):
                while open_tags:
                    name, aside = open_tags.pop()
                    ended.append(aside)
                    labelled -= name in LABEL_TAGS
                    if name == tag:
                        break
            out.append((tag, "", False, labelled > 0))
            for aside in ended:
                close(aside)
            continue
        if tag == "body":  # a head that was never closed ends here
            for _, aside in open_tags:
                close(aside)
            labelled = 0
            open_tags.clear()
        aside = -1
        if tag not in VOID_TAGS and not attrs.endswith("/"):
            if tag == "p" and open_tags and open_tags[-1][0] == "p":
                close(open_tags.pop()[1])
            aside = len(out) if _is_aside(tag, attrs) else -1
            open_tags.append((tag, aside))
            labelled += tag in LABEL_TAGS
        out.append((tag, "", False, labelled > 0 and tag not in LABEL_TAGS))
    for _, aside in open_tags:
        close(aside)
    return _marked(out, asides) if asides else out


def _marked(out: list[tuple[str, str, bool, bool]], asides: list[tuple[int, int]]) -> list[tuple[str, str, bool, bool]]:
    """Tokens with the marks of ``asides``, which lie in each other or apart.

    Each word belongs to the innermost aside around it.  If the aside with the most words of its own leaves hardly a word free of asides, it holds the
    page's content: neither it nor what lies around it is an aside.
    """
    spans = sorted(asides, key=lambda s: (s[0], -s[1]))
    around, own, free = [-1] * len(spans), [0] * len(spans), 0
    inside, following = [], 0
    depth = []
    for k, (tag, text, _, _) in enumerate(out):
        while inside and spans[inside[-1]][1] <= k:
            inside.pop()
        while following < len(spans) and spans[following][0] <= k:
            if spans[following][1] > k:
                around[following] = inside[-1] if inside else -1
                inside.append(following)
            following += 1
        depth.append(inside[-1] if inside else -1)
        if not tag:
            if inside:
                own[inside[-1]] += len(text.split())
            else:
                free += len(text.split())
    largest = max(range(len(spans)), key=own.__getitem__)
    page = set()
    if free < LEAST_AROUND * own[largest]:
        while largest >= 0:
            page.add(largest)
            largest = around[largest]
    # An aside inside the page is still one; what is left of the page is free.
    return [(tag, text, aside or (d >= 0 and d not in page), label) for (tag, text, aside, label), d in zip(out, depth)]


def best_region(page: list, costs: dict[str, float], other: float) -> tuple[int, int]:
    """[begin, end) of the contiguous tokens with the greatest sum; empty if no sum is above 0."""
    best = run = 0.0
    begin, found = 0, (0, 0)
    for k, (tag, text, aside, _) in enumerate(page):
        if aside:
            run -= ASIDE_COST * (1 if tag else len(text.split()))
        elif tag:
            run -= costs.get(tag, other)
        else:
            run += len(text.split())
        if run <= 0:
            run, begin = 0.0, k + 1
        elif run > best or (run == best and begin == found[0]):
            best, found = run, (begin, k + 1)
    return found


def region_text(page: list, begin: int, end: int) -> str:
    blocks, now = [], []
    for tag, text, aside, _ in page[begin:end]:
        if not tag:
            if not aside:
                now.append(text)
        elif tag == "br":
            now.append(" ")
        elif tag not in INLINE_TAGS:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    return "\n".join(b for b in (SPACE.sub(" ", x).strip(" ") for x in blocks) if b)


def main_text(page: str | None, costs: dict[str, float], other: float = DEFAULT_COST) -> str:
    parts = tokens(page or "")
    return region_text(parts, *best_region(parts, costs, other))


def _is_labelled(page: str) -> bool:
    low = page.lower()
    return any(low.count(f"<{t}") == 1 for t in LABEL_TAGS)


def _labelled_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tag, seen, outside) over the labelled pages of a task."""
    seen, outside = Counter(), Counter()
    for batch in batches:
        for page in batch["page"].to_pylist():
            if _is_labelled(page):
                for tag, _, _, inside in tokens(page):
                    if tag:
                        seen[tag] += 1
                        outside[tag] += not inside
    tags = list(seen)
    yield pa.RecordBatch.from_arrays([pa.array(tags, pa.string()), pa.array([seen[t] for t in tags], pa.int64()), pa.array([outside[t] for t in tags], pa.int64())], ["tag", "seen", "outside"])


def _overlaps(choices: list[tuple[float, dict[str, float], float]]):
    """(scale, shared, found, true) words over the labelled pages of a task, for each choice of costs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {scale: [0, 0, 0] for scale, _, _ in choices}
        for batch in batches:
            for page in batch["page"].to_pylist():
                if not _is_labelled(page):
                    continue
                parts = tokens(page)
                words = [0 if t or aside else len(x.split()) for t, x, aside, _ in parts]
                true = sum(n for n, p in zip(words, parts) if p[3])
                for scale, costs, other in choices:
                    a, b = best_region(parts, costs, other)
                    sums = total[scale]
                    sums[0] += sum(n for n, p in zip(words[a:b], parts[a:b]) if p[3])
                    sums[1] += sum(words[a:b])
                    sums[2] += true
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.float64()), *(pa.array([v[k] for v in total.values()], pa.int64()) for k in range(3))], ["scale", "shared", "found", "true"])

    return run


def fit_costs(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", most: int = MAX_LABELLED) -> tuple[dict[str, float], float]:
    """Cost of each tag, and of a tag that no labelled page has."""
    marked = pages.filter(F.lower(html_col).rlike("<(article|main)"))
    share = min(1.0, most / max(1, marked.count()))
    sample = marked.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < math.ceil(share * 1_000_000)).select(F.col(html_col).alias("page"))
    # The names of tags are few; a page with odd names adds a row each, of which the most frequent thousand are read.
    events = sample.mapInArrow(_labelled_events, "tag string, seen long, outside long").groupBy("tag").agg(F.sum("seen").alias("seen"), F.sum("outside").alias("outside")).orderBy(F.desc("seen"), "tag").limit(1000).collect()
    if not events:
        return {}, DEFAULT_COST
    part = {r["tag"]: (r["outside"] + 0.5) / (r["seen"] + 1) for r in events}
    choices = [(s, {t: LEAST_COST + s * p for t, p in part.items()}, LEAST_COST + s / 2) for s in SCALES]
    sums = {r["scale"]: r for r in sample.mapInArrow(_overlaps(choices), "scale double, shared long, found long, true long").groupBy("scale").agg(F.sum("shared").alias("shared"), F.sum("found").alias("found"), F.sum("true").alias("true")).collect()}
    score = lambda r: 2 * r["shared"] / max(1, r["found"] + r["true"])
    _, costs, other = max(choices, key=lambda c: (score(sums[c[0]]), -c[0]))
    return costs, other


def _extract(costs: dict[str, float], other: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pa.array([main_text(x.as_py(), costs, other) for x in part["page"]], pa.string())
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], texts], ["page_id", "url", "text"])

    return run


def extract_main_text(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``."""
    costs, other = fit_costs(pages, html_col, id_col)
    plain = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("page"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[:2])
    return plain.mapInArrow(_extract(costs, other), f"{kinds}, text string").withColumn("n_chars", F.length("text").cast("long"))
