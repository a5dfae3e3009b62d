"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: opening tags of structural elements and the words of each block, taken together, both told apart
by their path (enclosing elements with class and id, but for numbered ones, which are a page's own). Pages of a host with equal
layout (the same elements where the page first branches) have one template. In it, tokens with equal occurrence vectors over its
different pages (how often on which page) form an equivalence class. A class is valid if it occurs on at least ``SHARE`` of the
pages; of its tokens, those count that come in one order on the pages, as their first, last and mean places tell. Valid classes
nest by their paths into the template; a block whose words are template (on ``REPEATED`` different pages at least) is no slot and is left out, unless its
page has nothing else. What is not template is slots, the texts below each path; the element whose slots hold the article
is the deepest valid one with most of the slot text outside menus, headers, footers and the like. A page is then read through
its template: the blocks in that element, in page order.

Vectors are compared as sums of hashes over (page, count), which add up before the shuffle, so a host of any
size is fine; a template has one row per path. Where a page lacks its template's element (or there is no template, as with
a single page) the same choice is made on the page's own elements.

Null or empty html gives an empty text. Host is the part of url between // and the next / (null: one host of its own). Character references are decoded,
white space within a block is one blank, blocks are joined by a line feed; whole blocks in unwanted elements are left out and nothing
else is dropped. An element is unwanted by its tag, or by a class, id or role that says so as a whole, unless it holds most of the page's
slot text; html, body, main and article are never judged by their names. A heading inside the element is a block. Repeated rows give equal rows; other columns are ignored.
"""
from __future__ import annotations

import functools
import hashlib
import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidebars.session import stage

SHARE = 0.5     # of a host's pages
REPEATED = 3    # different pages that a text is on before it can be template
MOST = 0.6      # of the slot text that the chosen element holds

# Fixed values of HTML: elements without text of their own, elements that never close, inline elements.
RAW = ("script", "style", "noscript", "template", "iframe", "object", "textarea", "select", "svg", "math", "canvas", "audio", "video", "title")
EMPTY = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
          "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
#: Blocks that a following block closes.
LEAF = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "option", "pre", "blockquote", "figcaption", "caption", "summary")
UNWANTED = ("nav", "footer", "aside", "form", "button", "dialog", "menu", "head")
# A class, id or role says so as a whole: its parts are names of what is unwanted, or of places, one of the first at least.
_NAMES = re.compile(
    r"(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|notification|alert|menu|nav\w*|sidebar|side|"
    r"comments?|replies|reply|discussion|disqus|respond|share|sharing|social|related|recommend\w*|subscribe|newsletter|signup|login|popup|modal|"
    r"breadcrumbs?|footer|header|masthead|toolbar|pagination|pager|widget)\d*", re.I)
_PLACES = re.compile(r"(?:\d+|site|main|global|top|bottom|left|right|primary|secondary|list|box|bar|area|block|section|form|wrap|wrapper|container|inner|"
                     r"buttons?|links?|items?|posts|articles|thread|slot|unit)?\d*", re.I)
NEVER = ("html", "body", "main", "article")     # their names say what else is on the page

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?P<rattr>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>.*?(?P<end></(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[/!?a-zA-Z][^<>]*>", re.S | re.I)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_BLANK = re.compile(r"\s+")
_HIDDEN = re.compile(r"<!--|<!\[CDATA\[")
DEEPEST = 512     # elements around a block, as browsers have it; those below share its path


def _rest(page: str, at: int, end: int, last: re.Match | None) -> str:
    """The text behind the last token: none behind an open raw element or comment, none from an open comment on."""
    if last is not None and at == end:
        text = last.group()
        if (last["raw"] and not last["end"]) or (text.startswith("<!--") and not text.endswith("-->")) or (
                text.startswith("<![CDATA[") and not text.endswith("]]>")):
            return ""
    hidden = _HIDDEN.search(page, end)
    return page[at:hidden.start() if hidden else len(page)]


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str]]:
    """(path, text) of each block in page order, and (path, "") for each element that opens."""
    path: list[str] = []
    held: list[str] = []
    leaf = ""

    def flush() -> Iterator[tuple[tuple[str, ...], str]]:
        text = _BLANK.sub(" ", references.unescape("".join(held))).strip()
        held.clear()
        if text:
            yield (*path, leaf) if leaf else tuple(path), text

    # nothing ends behind the last ">", so no tag is looked for there
    at, deeper, m, end = 0, 0, None, page.rfind(">") + 1
    for m in _TOKEN.finditer(page, 0, end):
        held.append(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if m["raw"] or not tag or tag in INLINE:
            if m["raw"] and m["raw"].lower() == "title":
                yield from flush()
            continue
        yield from flush()
        if tag in EMPTY:
            continue
        if tag in LEAF:
            leaf = "" if m["close"] else tag
            continue
        leaf = ""
        if m["close"]:
            if deeper:
                deeper -= 1
                continue
            names = [p.split(".")[0] for p in path]
            if tag in names:
                del path[len(names) - 1 - names[::-1].index(tag):]
            continue
        if len(path) == DEEPEST:
            deeper += 1
            continue
        named = {a.lower(): b or c or d for a, b, c, d in _NAMED.findall(m["attr"] or "")}
        path.append(".".join([tag, *_BLANK.sub(" ", " ".join(named[k] for k in ("class", "id", "role") if named.get(k))).split(" ")]).rstrip("."))
        yield tuple(path), ""
    held.append(_rest(page, at, end, m))
    yield from flush()


@functools.lru_cache(1 << 14)
def named_unwanted(step: str) -> bool:
    tag, _, names = step.partition(".")
    if not names or tag in NEVER:
        return False
    for name in names.split("."):
        parts = re.split(r"[-_]", name)
        if any(map(_NAMES.fullmatch, parts)) and all(_NAMES.fullmatch(x) or _PLACES.fullmatch(x) for x in parts):
            return True
    return False


def unwanted(path: tuple[str, ...], spared: set[tuple[str, ...]] = frozenset()) -> bool:
    """Whether an element of the path is no place for main text; elements in ``spared`` are not judged by their names."""
    inside = False      # a header in the article is its heading
    for k, step in enumerate(path):
        tag = step.partition(".")[0]
        if tag in UNWANTED or (tag == "header" and not inside) or (named_unwanted(step) and path[:k + 1] not in spared):
            return True
        inside = inside or tag in ("article", "main")
    return False


def spare(found: list[tuple[tuple[str, ...], str]]) -> set[tuple[str, ...]]:
    """Elements with an unwanted name that hold most of the page's slot text all the same."""
    sizes: Counter = Counter()
    total = 0
    for path, text in found:
        if text:
            named = {path[:k + 1] for k, step in enumerate(path) if named_unwanted(step)}
            if not unwanted(path, named):
                total += len(text)
                sizes.update(dict.fromkeys(named, len(text)))
    return {path for path, n in sizes.items() if 2 * n > total}


_OWN = re.compile(r"\d{3}|[-_]\d")      # a number that a page or an entry has for itself


@functools.lru_cache(1 << 14)
def general(path: tuple[str, ...]) -> tuple[str, ...]:
    """A path without what only one page may have."""
    out = []
    for step in path:
        tag, _, names = step.partition(".")
        kept = [] if tag in NEVER else [x for x in names.split(".") if x and not _OWN.search(x)]
        out.append(".".join([tag, *kept]))
    return tuple(out)


def layout(found: list[tuple[tuple[str, ...], str]]) -> int:
    """A number for the set of a page's elements where it first branches (below html and body)."""
    by_depth: dict[int, set[tuple[str, ...]]] = {}
    for path, text in found:
        if not text:
            steps = tuple(s for s in general(path) if s not in ("html", "body"))
            if steps:
                by_depth.setdefault(len(steps), set()).add(steps)
    for _, paths in sorted(by_depth.items()):
        if len(paths) > 1:
            return mark("\x1e".join(sorted(map(_PATH.join, paths))))
    return mark("\x1e".join(map(_PATH.join, by_depth.get(1, ()))))


def mark(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def text_mark(path: tuple[str, ...], text: str) -> int:
    return mark(_PATH.join((*general(path), "", text)))


def slots(found: list[tuple[tuple[str, ...], str]], fixed: set[int] = frozenset(), spared: set[tuple[str, ...]] | None = None) -> Counter:
    """Characters of wanted slot text of each element of a page, texts marked in ``fixed`` left out."""
    out: Counter = Counter()
    spared = spare(found) if spared is None else spared
    for path, text in found:
        if text and not unwanted(path, spared) and not (fixed and text_mark(path, text) in fixed):
            steps = [s for s in path if s not in LEAF]
            for k in range(1, len(steps) + 1):
                out[general(tuple(steps[:k]))] += len(text)
    return out


def choose(slots: dict[tuple[str, ...], float]) -> tuple[str, ...] | None:
    """The deepest wanted element with at least ``MOST`` of the slot text; an article element comes first."""
    total = max(slots.values(), default=0)
    best = None
    for path, size in slots.items():
        if not size:      # only wanted text counts
            continue
        named = path[-1].partition(".")[0] in ("article", "main")
        if named or size >= MOST * total:
            rank = (named, size if named else len(path), size, path)
            if best is None or rank > best[0]:
                best = (rank, path)
    return best[1] if best else None


def main_text(page: str, chosen: tuple[str, ...] | None, fixed: set[int] = frozenset()) -> str:
    """The blocks of a page within the chosen element, without the template's texts."""
    found = list(blocks(page))
    spared = spare(found)
    wanted = [(general(path), text) for path, text in found if text and not unwanted(path, spared)]
    slot = [(path, text) for path, text in wanted if text_mark(path, text) not in fixed] if fixed else wanted
    if not slot:      # a page is not all template
        slot, fixed = wanted, frozenset()
    if chosen is None or not any(path[:len(chosen)] == chosen for path, _ in slot):
        chosen = choose(slots(found, fixed, spared)) or ()
    return "\n".join(text for path, text in slot if path[:len(chosen)] == chosen)


_PATH = "\x1f"
_TOKENS = "host string, layout long, page_key long, token long, path string, parent long, n long, first long, last long, chars long"


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens of pages: elements with their path and the wanted text in them, texts with the mark of their element, and for the page a token 0."""
    for batch in batches:
        rows = []
        for host, key, page in zip(batch.host, batch.page_key, batch.html, strict=True):
            found = list(blocks(page or ""))
            own, spared = layout(found), spare(found)
            sizes = slots(found, spared=spared)
            counts: dict[int, list] = {0: [None, 0, 1, 0, 0, 0]}
            for place, (path, text) in enumerate(found):
                plain = general(path)
                joined = _PATH.join(x for x in plain if x not in LEAF)
                token = text_mark(path, text) if text else mark(joined)
                seen = counts.setdefault(token, [None, mark(joined), 0, place, place, 0] if text else [joined, 0, 0, place, place, sizes.get(plain, 0)])
                seen[2], seen[4] = seen[2] + 1, place
                if text and not unwanted(path, spared):
                    seen[5] += len(text)
            rows += [(host, own, key, token, *seen) for token, seen in counts.items()]
        yield pd.DataFrame(rows, columns=["host", "layout", "page_key", "token", "path", "parent", "n", "first", "last", "chars"])


def in_order(tokens: list[dict]) -> list[dict]:
    """The tokens of a class that come one after another on its pages: of two neighbours that cross, both by their places, the later goes."""
    out: list[dict] = []
    for t in sorted(tokens, key=lambda t: (t["mean"], t["low"], t["high"], t["token"])):
        if not out or (out[-1]["low"] <= t["low"] and out[-1]["high"] <= t["high"]):
            out.append(t)
    return out


def templates(pages: DataFrame) -> DataFrame:
    """Of each host and layout (host, layout, chosen, fixed): the path of the element that holds the main text, the marks of its texts."""
    rows = pages.mapInPandas(_vectors, _TOKENS)
    # copies of a page count once
    once = rows.groupBy("host", "layout", "page_key", "token", "path", "parent").agg(*(F.max(c).alias(c) for c in ("n", "first", "last", "chars")))
    # an occurrence vector as a sum of hashes over pages; wide decimals keep the sum whole
    vector = F.xxhash64("page_key", "n").cast("decimal(38,0)")
    found = once.groupBy("host", "layout", "token", "path", "parent").agg(
        F.count(F.lit(1)).alias("support"), F.sum(vector).cast("string").alias("vector"), F.sum("chars").alias("chars"),
        F.avg("first").alias("mean"), F.min("first").alias("low"), F.max("last").alias("high"))
    found = stage(found.where("support >= 2"), "tokens")
    sizes = found.where("token = 0").select("host", "layout", F.col("support").alias("pages"))
    found = found.where("token <> 0").join(sizes, ["host", "layout"]).where(F.col("support") >= F.col("pages") * SHARE)

    def nest(group: pd.DataFrame) -> pd.DataFrame:
        """A layout's valid classes, nested by path, and the element chosen in them."""
        valid: dict[tuple[str, ...], float] = {}
        paths, texts = {}, []
        for _, own in group.groupby(["support", "vector"], sort=True):
            for t in in_order(own.to_dict("records")):
                if t["path"] is not None:
                    paths[t["token"]] = path = tuple(t["path"].split(_PATH))
                    valid[path] = float(t["chars"])
                elif t["support"] >= REPEATED:
                    texts.append(t)
        for t in texts:      # template, so in no slot
            path = paths.get(t["parent"], ())
            for k in range(1, len(path) + 1):
                if path[:k] in valid:
                    valid[path[:k]] -= t["chars"]
        # an element counts if those around it are in the template as well
        nested = {p: max(n, 0.0) for p, n in valid.items() if all(p[:k] in valid for k in range(1, len(p)))}
        chosen = choose(nested)
        return pd.DataFrame({"host": group.host.iloc[:1], "layout": group["layout"].iloc[:1], "chosen": [None if chosen is None else _PATH.join(chosen)],
                             "fixed": [sorted(t["token"] for t in texts)]})

    return found.groupBy("host", "layout").applyInPandas(nest, "host string, layout long, chosen string, fixed array<long>")


@F.pandas_udf(LongType())
def _layout(pages: pd.Series) -> pd.Series:
    return pd.Series([layout(list(blocks(page or ""))) for page in pages], dtype="int64")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    keyed = pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64("html").alias("page_key"))
    # staged, so that Spark knows its size: where it is small, pages are not moved for it
    chosen = stage(templates(keyed.select("host", "page_key", "html")), "templates")
    kind = dict(pages.dtypes)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(page or "", tuple(c.split(_PATH)) if c else None, frozenset() if fixed is None else frozenset(map(int, fixed)))
                     for page, c, fixed in zip(batch.html, batch.chosen, batch.fixed, strict=True)]
            yield pd.DataFrame({"page_id": batch.page_id.astype("Int64") if kind["page_id"] in ("bigint", "int") else batch.page_id,
                                "url": batch.url, "text": texts, "n_chars": [len(t) for t in texts]})

    keyed = keyed.withColumn("layout", _layout("html"))
    joined = keyed.join(chosen, ["host", "layout"], "left").select("page_id", "url", "html", "chosen", "fixed")
    return joined.mapInPandas(read, f"page_id {kind['page_id']}, url string, text string, n_chars long")


def report(pages: DataFrame) -> DataFrame:
    return extract(pages)
