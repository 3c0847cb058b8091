"""HTML extraction by nearest-URL page differencing."""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm import common

#: Elements that HTML defines as something else than the text of a page.
CHROME = frozenset("nav header footer aside form button select textarea menu dialog iframe object svg canvas noscript template head title".split())
RAW = "script|style|xmp|noembed|noframes"
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a class, id or role can mark as chrome. Headings and inline text are content.
BOXED = frozenset("div section p ul ol dl table span li center details fieldset figure".split())
#: Words of class, id or role for what the method can't see on a page that has nothing like it beside it.
MARKS = frozenset("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer header menu nav navbar navigation newsletter notice popup promo related share sharing sidebar social sponsor sponsored subscribe widget".split())
#: What a mark's box is called, and first words of class tokens that tell of a page's layout.
BOXES = frozenset("area bar block bottom box button buttons column container content form group inner item items left link links list modal panel posts right row section slot top unit wrap wrapper".split())
STATES = frozenset("has have hide is no not show with without".split())
#: Which open elements a start tag ends, and the elements that it doesn't look beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "optgroup"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})),
}

_GONE = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)|[^>=]|=)*+)>|<[!?][^>]*>""")
_MARK = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

Line = tuple[str, str]  # text, and "main", "chrome" or "other"


def _named(token: str, marks: frozenset[str], inside: bool) -> bool:
    """A class token, id or role that is a mark (sidebar), ends in one (site-header), or is the box of one (ad-slot).
    Inside an article, a header is the article's own."""
    words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", token).lower()) if w]
    if not words or words[0] in STATES or inside and "header" in words:
        return False
    return words[-1] in marks or words[0] in marks and all(w in BOXES or w.isdigit() for w in words[1:])


def lines(page: str | None, marks: frozenset[str] = MARKS) -> list[Line]:
    """The text lines of a page, in page order: one for each block, with references decoded and white space folded.

    "main" is what stands in an article or main element, "chrome" what stands in an element of CHROME, or in one of BOXED
    that has one of the marks, unless that holds an article or main element (other than one inside another, or inside
    chrome): it lays out the page. A header inside an article is the article's own.
    """
    out: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # text, in chrome, in main, and the open marked elements
    parts: list[str] = []
    held: list[tuple[str, str, int]] = []  # name, "chrome", "main", "mark" or "", and a number of each open element
    wraps: set[int] = set()  # marked elements that hold an article
    open_: dict[str, int] = {}
    kinds = {"chrome": 0, "main": 0, "mark": 0, "": 0}

    def flush() -> None:
        if parts:
            if text := " ".join(entities.unescape("".join(parts)).split()):
                out.append((text, kinds["chrome"] > 0, kinds["main"] > 0, tuple(n for _, k, n in held if k == "mark") if kinds["mark"] else ()))
            parts.clear()

    def end(k: int) -> None:
        if any(kind for _, kind, _ in held[k:]):
            flush()
        for name, kind, _ in held[k:]:
            open_[name] -= 1
            kinds[kind] -= 1
        del held[k:]

    page, at = _GONE.sub(" ", page or ""), 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name == "br":
            parts.append(" ")
        if name in BLOCKS or name in CHROME:
            flush()
        if name in VOID:
            continue
        if m[1]:
            if open_.get(name):
                end(max(k for k, x in enumerate(held) if x[0] == name))
            continue
        if name in BLOCKS and open_.get("p"):
            k = max(k for k, x in enumerate(held) if x[0] in BLOCKS)
            if held[k][0] == "p":
                end(k)
        if name in ENDS:
            ended, walls = ENDS[name]
            for k in range(len(held) - 1, -1, -1):
                if held[k][0] in walls or held[k][0] in ("article", "main", "body"):
                    break
                if held[k][0] in ended:
                    end(k)
        inside = kinds["main"] > 0
        if name in ("article", "main"):
            kind = "main"
            if not inside and not kinds["chrome"]:
                wraps.update(n for _, k, n in held if k == "mark")
        elif name in CHROME and not (name == "header" and inside):
            kind = "mark" if name == "form" else "chrome"
        elif name in BOXED and m[3] and any(_named(t, marks, inside) for x in _MARK.finditer(m[3]) for t in (x[1] or x[2] or x[3] or "").split()):
            kind = "mark"
        else:
            kind = ""
        if kind:
            flush()
        if not m[3].endswith("/"):
            held.append((name, kind, m.start()))
            open_[name] = open_.get(name, 0) + 1
            kinds[kind] += 1
    parts.append(page[at:])
    flush()
    return [(text, "chrome" if chrome or any(n not in wraps for n in marked) else "main" if main else "other") for text, chrome, main, marked in out]


def shared(a: list[Line], b: list[Line]) -> set[int]:
    """Positions in a of a longest common subsequence of lines: a longest increasing run of the matches' positions in b."""
    where: dict[str, list[int]] = {}
    for j, (text, _) in enumerate(b):
        where.setdefault(text, []).append(j)
    tails: list[int] = []
    ends: list[tuple] = []
    for i, (text, _) in enumerate(a):
        for j in reversed(where.get(text, ())):
            k = bisect_left(tails, j)
            node = (i, ends[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                ends.append(node)
            else:
                tails[k], ends[k] = j, node
    out, node = set(), ends[-1] if ends else None
    while node:
        out.add(node[0])
        node = node[1]
    return out


def main_text(own: list[Line], beside: list[Line] | None) -> tuple[str, int, int]:
    """The lines that are left, how many were deleted since the page beside shares them, and how many more by their
    elements. Lines inside an article or main element are the page's own even if another article repeats them; a page of
    which all lines are shared (a copy) keeps them."""
    gone = shared(own, beside) if beside else set()
    if len(gone) == len(own):
        gone = set()
    cut = [kind != "main" and i in gone for i, (_, kind) in enumerate(own)]
    kept = [text for (text, kind), c in zip(own, cut, strict=True) if not c and kind != "chrome"]
    n_shared = sum(cut)
    return "\n\n".join(kept), n_shared, len(own) - n_shared - len(kept)


ADDRESS = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"
#: The first text of the body.
OPENING = r">\s*([^<>\s][^<]{0,99})"
KEY = ["host", "opening", "path", "page_id"]
PLACES = "host string, opening long, path string"


def _place(host: str, opening: int, path: str, page_id: int | None) -> tuple:
    """A key as Spark orders it: text by code points, null ids first."""
    return host, opening, path, page_id is not None, page_id or 0


def ranges(keyed: DataFrame) -> list[tuple[tuple, tuple]]:
    """The first and last key of each range that keyed is dealt by, in order: two rows for each task, from the keys alone."""
    dealt = keyed.select(*KEY).repartitionByRange(common.tasks(keyed.sparkSession), *KEY)
    edges = dealt.groupBy(F.spark_partition_id().alias("task")).agg(F.min(F.struct(*KEY)).alias("first"), F.max(F.struct(*KEY)).alias("last"))
    return sorted(((tuple(r["first"]), tuple(r["last"])) for r in edges.collect()), key=lambda r: _place(*r[0]))


def dealt(keyed: DataFrame) -> DataFrame:
    """keyed with the range of each row and guest = false, dealt out by range and sorted, and with guest = true, once
    more, the last rows of the range before and the first of the next, if of the same host."""
    spark = keyed.sparkSession
    found = ranges(keyed)
    # binary search, of the starts as one literal
    starts = F.from_json(F.lit(json.dumps([dict(zip(KEY, first)) for first, _ in found])), "array<struct<host: string, opening: long, path: string, page_id: long>>")
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(len(found).bit_length())))) if found else F.array().cast("array<int>")
    passed = lambda k: (k <= len(found)) & (F.get(starts, k - 1) <= F.struct(*KEY))
    of = F.greatest(F.aggregate(halves, F.lit(0), lambda k, x: F.when(passed(k + x), k + x).otherwise(k)) - 1, F.lit(0))

    steps = [(i, *x) for i, x in enumerate(zip(found, found[1:])) if x[0][1][0] == x[1][0][0]]
    visits = [(*ends[1], i + 1) for i, ends, _ in steps] + [(*ends[0], i) for i, _, ends in steps]
    visits = spark.createDataFrame(visits, f"{PLACES}, id string, range int")
    same = [*(keyed[c] == visits[c] for c in KEY[:3]), F.col("page_id").cast("string").eqNullSafe(visits["id"])]
    # at most two rows for each task
    guests = keyed.join(F.broadcast(visits), same).select(*(keyed[c] for c in keyed.columns), "range", F.lit(True).alias("guest"))
    own = keyed.withColumn("range", of).withColumn("guest", F.lit(False))
    both = own.unionByName(guests).repartitionById(max(1, len(found)), F.col("range"))
    return both.sortWithinPartitions("range", *KEY, F.xxhash64("url", "html"))


def extract(pages: DataFrame, marks: frozenset[str] = MARKS) -> DataFrame:
    """(page_id, url, text, n_shared, n_named) for each row of pages: the main text of its whole html, how many lines
    were deleted since a page beside it shares them, and how many more by the names of their elements.

    Pages are dealt by ranges of (host, opening, URL path, page_id) and sorted, where pages of one opening begin with the
    same text (up to 100 characters): a host of many layouts has the nearest URL of a layout side by side, and a host of one
    layout the nearest URL. So a host with any share of the pages is spread over tasks and each task holds three pages
    at a time. The pages at the ends of a range are sent to the range
    beside it too, so that the text doesn't depend on the number of ranges. A page is compared with the page before or
    after it of its host: one of its opening if there is any, then that with the longer common start of the path (the one
    before, if equal). Lines outside of articles that both pages hold, aligned, are deleted. A line that no page beside
    shares is judged by its elements alone: see lines(). A null html is empty and gives an empty text; a null url counts as
    an empty host and path, and is returned as null. Repeated rows and ids give a row each. Other columns aren't read.
    """
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_shared", pa.int64()), ("n_named", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple | None]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield tuple(batch.column(k)[i].as_py() for k in range(7))
            yield None

        before = now = None
        out: list[tuple] = []
        for row in rows():
            following = row and (row[2], row[3], row[4], lines(row[5], marks), row[0], row[1], row[6])
            if now and not now[6]:
                near = [x for x in (before, following) if x and x[0] == now[0]]
                best = max(near, key=lambda x: (x[1] == now[1], len(commonprefix([x[2], now[2]]))), default=None)
                out.append((now[4], now[5], *main_text(now[3], best and best[3])))
            before, now = now, following
            if len(out) == 64 or row is None and out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(kind)], schema=kind)
                out = []

    html = F.col("html").cast("string")
    body = F.substr(html, F.greatest(F.lit(1), F.locate("<body", F.lower(html))))
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.lower(F.coalesce(F.regexp_extract("url", ADDRESS, 1), F.lit(""))).alias("host"),
        F.xxhash64(F.coalesce(F.regexp_extract(body, OPENING, 1), F.lit(""))).alias("opening"),
        F.coalesce(F.regexp_extract("url", ADDRESS, 2), F.lit("")).alias("path"),
        html.alias("html"),
    )
    return dealt(keyed).select("page_id", "url", "host", "opening", "path", "html", "guest").mapInArrow(run, "page_id long, url string, text string, n_shared long, n_named long")
