"""Main text of web pages by tag-path ratios.

A page is read once, tag by tag. Text between two block boundaries is a block; inline elements belong to
the block around them. Every block has a root-to-leaf path of block elements with their class words. Per
path the characters outside links and the punctuation marks of all its blocks are added up; characters to
blocks, times the logarithm of the marks to blocks, is the path's ratio: articles have paths with much
punctuated text in few blocks, menus many short linked ones. Two features weigh a ratio: a block inside
``article`` or ``main`` counts ``INSIDE`` times, one under names of noise (class, id) ``NAMED`` or, where
the name says something else besides, ``HINTED`` times. Ratios are smoothed along the page and fused with
the plain ones by the geometric mean; paths' blocks that reach the page's threshold are content.

Headings, list items, table cells and short paragraphs have low ratios by nature. They follow the blocks
chosen around them: what lies in the same innermost article or main, textual blocks of the same container
that are not mostly links, and headings right before a chosen block. Blocks named as noise never follow.

Elements that are no text of an article by the meaning of HTML (nav, footer, form, script, a true hidden
attribute, such roles) are taken out before any ratio is formed. Block elements and line breaks become
white space; inline elements become nothing.

Defined cases: a null html is empty, with an empty text; a page without markup is all content; an
unfinished tag or comment at the end is dropped; a null id or url stays as it is; repeated rows
stay rows; an empty table gives no rows. The work is linear in the page, however deep it nests.
"""

from __future__ import annotations

import html
import math
import re
import statistics
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.llm.common import quoted, text_of

ROWS_OUT = 256
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
CLASS_WORD = re.compile(r"[a-z]+")
INSIDE, NAMED, HINTED, FLOOR = 4.0, 1 / 512, 0.25, 0.15      # weights of the features; lowest threshold as a part of the highest score
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")

# Elements by what they are in a page, and words of class names.
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg math object".split())
UNSEEN = frozenset("script style template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt rtc ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head nav footer aside form button select option optgroup fieldset dialog menu audio video canvas map".split())
CONTENT = frozenset("article main".split())
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 hgroup section p".split())     # inside CONTENT their ids are anchors
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FOLLOWS = HEADINGS | frozenset("hgroup p ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",)}
SCOPE = frozenset("html body article main section div ul ol dl table tbody thead tfoot tr td th blockquote nav aside header footer form".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr main menu nav ol p pre section table ul".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent "
    "copyright disqus discussion footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager "
    "pagination popup promo promoted promotion recommended related respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription toolbar widget".split())
PLAIN_WORDS = frozenset(                  # say nothing about what a part of the page holds
    "a area bar body bottom box btn button buttons card center col column container content count custom entry feed fixed form group head header "
    "heading id inner item items js large left link links list main mobile module new outer page panel post posts primary right row secondary "
    "section site slot small sticky text title top unit ui wrap wrapper".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
BLOCK = " "


class Run:
    """Text between two tags: its path and element, where it stands and the features of its path."""

    __slots__ = ("path", "name", "text", "link", "article", "container", "weight")

    def __init__(self, text: str, at: tuple):
        self.text = text
        _, self.name, self.path, _, self.link, self.article, self.container, self.weight = at


def named(value: str, word: str) -> bool:
    """Whether a class name that holds this word says nothing else."""
    return all(w == word or w in NOISE_WORDS or w in PLAIN_WORDS for w in CLASS_WORD.findall(value))


def describe(name: str, attributes: str, inside: bool) -> tuple[str, bool, float]:
    """The element's part of a path, whether nothing below it is content, and the weight of its names."""
    never = name in NEVER or name == "header" and not inside
    if not attributes or attributes.isspace():
        return name, never, 1.0
    words: list[str] = []
    weight = 1.0
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden":
            never = True
        elif key == "role":
            never = never or value.strip() in NOISE_ROLES
        elif key in ("class", "id"):
            words += CLASS_WORD.findall(value)
            if name in ("html", "body") or name in CONTENT or key == "id" and inside and name in TEXTUAL:
                continue
            for one in value.split():
                for word in NOISE_WORDS.intersection(CLASS_WORD.findall(one)):
                    weight = min(weight, NAMED if named(one, word) else HINTED)
    return ".".join([name, *words]), never, weight


def runs(page: str) -> Iterator[Run | None]:
    """The page's runs in order, without those that are never content; None where a block begins or ends."""
    # element, block element, path, never, in a link, article or main, container, weight
    stack: list[tuple] = [("", "", 0, False, False, 0, 0, 1.0)]
    paths: dict[tuple[int, str], int] = {}
    opened: Counter = Counter()
    at, end, elements = 0, len(page), 0
    lower = None
    while at < end:
        match = TOKEN.search(page, at)
        stop = match.start() if match else end
        if stop > at and not stack[-1][3]:
            yield Run(html.unescape(page[at:stop]), stack[-1])
        if not match:
            break
        at, name = match.end(), match[2]
        if not name:
            continue
        name = name.lower()
        if match[1]:
            if opened[name]:
                close(stack, opened, (name,), frozenset())
            if name not in INLINE:
                yield None
            continue
        if name not in INLINE and name not in UNSEEN:
            yield None
        if name in RAW:
            lower = lower or page.lower()
            stop = lower.find("</" + name, at) if len(lower) == end else -1
            if stop < 0:
                found = re.compile("</" + re.escape(name), re.I).search(page, at)
                stop = found.start() if found else end
            if match[3].rstrip().endswith("/") and name in ("svg", "math"):
                stop = at
            at = page.find(">", stop) + 1 if stop < end and stop != at else stop
            at = at or end
            continue
        if name in VOID:
            continue
        if name in ENDS_P and opened["p"]:
            close(stack, opened, ("p",), SCOPE)
        if name in CLOSES and any(opened[n] for n in CLOSES[name]):
            close(stack, opened, CLOSES[name], SCOPE)
        elements += 1
        opened[name] += 1
        _, block, path, never, link, article, container, weight = stack[-1]
        part, own, worth = describe(name, match[3], article > 0)
        if name not in INLINE or worth < 1:
            path = paths.setdefault((path, part), len(paths) + 1)
        if name not in INLINE:
            block = name
            container = container if name in FOLLOWS else elements
        if name in CONTENT:
            article = elements
        stack.append((name, block, path, never or own, link or name == "a", article, container, min(weight, worth)))


def close(stack: list[tuple], opened: Counter, names: tuple[str, ...], scope: frozenset) -> None:
    """Ends the innermost open element of these names and all below it, unless one of the scope lies between."""
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth][0] in names:
            opened.subtract(s[0] for s in stack[depth:])
            del stack[depth:]
            return
        if stack[depth][0] in scope:
            return


def scores(blocks: list[list[Run]]) -> list[float]:
    """The fused ratio of each block: its path's, weighted, and the smoothed one, by the geometric mean."""
    totals: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])
    for block in blocks:
        t = totals[block[0].path]
        t[0] += 1
        t[1] += sum(len(r.text.strip()) for r in block if not r.link)
        t[2] += sum(len(PUNCTUATION.findall(r.text)) for r in block if not r.link)
    ratio = {path: n / k * math.log2(2 + marks / k) for path, (k, n, marks) in totals.items()}
    raw = [ratio[b[0].path] * b[0].weight * (INSIDE if b[0].article else 1) for b in blocks]
    padded = [raw[0], *raw, raw[-1]] if raw else []
    return [math.sqrt(r * (a + 2 * r + b) / 4) for a, r, b in zip(padded, raw, padded[2:])]


def select(blocks: list[list[Run]]) -> list[bool]:
    """Whether each block is content: its fused score reaches the threshold, or it follows blocks that do."""
    if not blocks:
        return []
    fused = scores(blocks)
    top = max(fused)
    threshold = min(max(statistics.pstdev(fused), FLOOR * top), top)
    keep = [score >= threshold for score in fused]
    chosen = [b[0] for b, k in zip(blocks, keep) if k and b[0].weight > NAMED]
    articles = {r.article for r in chosen if r.article}
    containers = {r.container for r in chosen if r.name in FOLLOWS}
    for i in range(len(blocks) - 1, -1, -1):
        first = blocks[i][0]
        if keep[i] or first.weight <= NAMED:
            continue
        links = sum(len(r.text) * r.link for r in blocks[i])
        alike = first.name in FOLLOWS and first.container in containers and 2 * links < sum(len(r.text) for r in blocks[i])
        leads = first.name in HEADINGS and i + 1 < len(blocks) and keep[i + 1]
        keep[i] = first.article in articles or alike or leads
    return keep


def main_text(page: str) -> str:
    everything = list(runs(page))
    blocks: list[list[Run]] = []
    last = None
    for run in everything:
        if run is not None and not run.text.isspace():
            if last is not None and last.path == run.path:
                blocks[-1].append(run)
            else:
                blocks.append([run])
        if run is None or not run.text.isspace():
            last = run
    content = {id(run) for block, keep in zip(blocks, select(blocks)) if keep for run in block}
    out = [run.text if run is not None and id(run) in content else BLOCK for run in everything]
    return " ".join("".join(out).split())


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars per page."""
    rows = pages.select(quoted(page_id).alias("page_id"), quoted(url).alias("url"), text_of(page).alias("html"))
    schema = rows.drop("html").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(start, ROWS_OUT)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def op3_html_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
