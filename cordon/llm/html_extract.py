"""HTML extraction by nearest-URL page differencing.

Pages of a host are put in order of their URL path and each is paired with its neighbours
there. A page's text lines are aligned with a neighbour's by longest common subsequence;
lines that both have are template and go. Neighbours may also share article text (copies),
and a template may differ from page to page (rotating adverts and menus), which differencing
alone gets wrong. So markup decides where it is plain: lines in menus, footers, adverts,
forms and the like go in any case, and if the page names its article (<article>, <main>, or
role main), lines inside it stay and lines outside it go. Differencing decides what markup
leaves open: all lines of pages that name no article, and inside an article lines of elements
whose names only hint at page furniture ("related-work", "legal"). Those go if a neighbour
has them too, unless it shares most of the article, as a copy does.

Neighbours that are equal line by line are one run, and runs are what is aligned: each with
the nearest pages of its host that differ from it, for all its pages at once.

Only hashes of lines travel to find and align neighbours. A host with a third of all pages
is no single group: runs are numbered over all hosts, range-partitioned, and neighbours meet
by an equi-join on that number. A run's result reaches its pages by its pieces, one a
partition.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordon.llm.common import partitions, written

#: Elements whose content is no text of the page, elements of page chrome,
#: elements that end a line, elements without an end tag.
NO_TEXT = set("script style noscript template iframe object embed canvas audio video select option datalist textarea button head title annotation annotation-xml".split())
CHROME = set("nav footer aside form menu dialog".split())
BLOCKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of class and id names that name page furniture, in an article only some of them; words that may stand beside these.
FURNITURE = set(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promoted banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar side widget related "
    "recommended recommendations share sharing social cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond replies reply pagination "
    "pager toolbar skip legal copyright".split()
)
NOT_IN_ARTICLE = {"banner", "header", "legal", "side", "copyright"}
BESIDE = set(
    "site page main top bottom left right upper lower primary secondary global mobile desktop box boxes container wrapper wrap inner outer block section area region bar list item items link links button buttons icon icons "
    "content text form field title heading label group row col column panel module unit slot placeholder footer header thread user reader readers count post posts article articles stories story more to us policy media the".split()
)
#: End tags that may be left out: an opening tag ends these open elements.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PARTS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")

IN_ARTICLE, IN_CHROME, UNSURE = 1, 2, 4


@lru_cache(20_000)
def by_attributes(attributes: str, inside: bool) -> int:
    """IN_CHROME if roles or names say that an element is page furniture, UNSURE if a name hints at it.

    A name says so if all its words, as in "ad-banner" or "cookie-notice", are of furniture
    or such as may stand beside it; "market-share" only hints.
    """
    flag = 0
    for k, a, b, c in ATTRIBUTE.findall(attributes):
        k, v = k.lower(), (a or b or c).lower()
        if k == "role" and v in CHROME_ROLES or k == "hidden" and v != "until-found" or k == "aria-hidden" and v == "true":
            return IN_CHROME
        if k in ("class", "id"):
            for name in v.split():
                words = set(PARTS.findall(name))
                some = words & FURNITURE
                if some - NOT_IN_ARTICLE if inside else some:
                    if words <= FURNITURE | BESIDE:
                        return IN_CHROME
                if some:
                    flag = UNSURE
    return flag


def furniture(tag: str, attributes: str, inside: bool) -> int:
    """IN_CHROME, UNSURE or 0 for an element. A <header> inside the article is the article's."""
    if tag in CHROME or (tag == "header" and not inside):
        return IN_CHROME
    if tag in ("html", "body", "article", "main") or not any(x in attributes for x in ("class", "id", "role", "hidden", "CLASS", "ID", "ROLE", "HIDDEN")):
        return 0
    return by_attributes(attributes, inside)


def lines(page: str) -> list[tuple[str, int]]:
    """Text lines of a page in order, each with flags: in the article, in chrome, unsure.

    Tags are read with tolerance: end tags close the nearest open element of that name and
    all within it; stray ones do nothing; what is open at the end of the page ends there.
    """
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool, int, bool]] = []  # tag, article, chrome or unsure, no text
    article, chrome, mute = False, 0, False
    at = 0

    def flush():
        text = SPACE.sub(" ", "".join(buffer)).strip()
        buffer.clear()
        if text:
            out.append((text, IN_ARTICLE * article | chrome))

    def reset():
        nonlocal article, chrome, mute
        _, article, chrome, mute = stack[-1] if stack else ("", False, 0, False)

    def text(chunk: str):
        if chunk and not mute:
            buffer.append(entities.unescape(chunk) if "&" in chunk else chunk)

    while m := TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            text(m[1])
            continue
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag in BLOCKS:
            flush()
        if m[2]:
            if any(s[0] == tag for s in stack):
                while stack:
                    if stack[-1][0] in BLOCKS:
                        flush()
                    if stack.pop()[0] == tag:
                        break
                reset()
            continue
        if tag in VOID:
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ENDS.get(tag, ()):
                del stack[k:]
                reset()
                break
            if stack[k][0] in ("ul", "ol", "dl", "table", "select", "article", "main", "nav"):
                break
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "p" and stack and stack[-1][0] == "p":
            stack.pop()
            reset()
        named = tag in ("article", "main") or 'role="main"' in (m[4] or "")
        inside = article or named
        state = (tag, inside, chrome | furniture(tag, m[4] or "", inside), mute or tag in NO_TEXT)
        if not (m[4] or "").rstrip().endswith("/") or tag in BLOCKS:
            stack.append(state)
            reset()
    text(page[at:])
    flush()
    return out


def line_hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def row_lengths(a: list[int], b: list[int]) -> list[int]:
    """LCS length of a with each beginning of b, bit-parallel: bit j of the row is 0 where the length grows."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    out, n = [0], 0
    for j in range(len(b)):
        n += not row >> j & 1
        out.append(n)
    return out


def shared(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence with b.

    Equal ends are taken first. What remains is halved (Hirschberg), so that memory grows
    with the lines, not with their product.
    """
    lo, hi_a, hi_b = 0, len(a), len(b)
    while lo < hi_a and lo < hi_b and a[lo] == b[lo]:
        lo += 1
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
    ends = [*range(lo), *range(hi_a, len(a))]
    in_b, in_a = set(b[lo:hi_b]), set(a[lo:hi_a])
    left = [i for i in range(lo, hi_a) if a[i] in in_b]
    right = [x for x in b[lo:hi_b] if x in in_a]
    found: list[int] = []
    todo = [(left, right)]
    while todo:
        x, y = todo.pop()
        if not x or not y:
            continue
        if len(x) == 1:
            if a[x[0]] in y:
                found.append(x[0])
            continue
        mid = len(x) // 2
        up = row_lengths([a[i] for i in x[:mid]], y)
        down = row_lengths([a[i] for i in reversed(x[mid:])], y[::-1])
        cut = max(range(len(y) + 1), key=lambda j: up[j] + down[len(y) - j])
        todo += [(x[:mid], y[:cut]), (x[mid:], y[cut:])]
    return sorted(ends + found)


def pieces(batches):
    """Sorted rows (host, i, v, at, lines) of a partition with `piece`, which grows where host or lines differ from the row before, and `lead`, whether they do."""
    before, n = None, -1
    for batch in batches:
        piece, lead = [], []
        for host, found in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
            lead.append((host, found) != before)
            n += lead[-1]
            piece.append(n)
            before = (host, found)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(piece, pa.int64()), pa.array(lead, pa.bool_())], [*batch.schema.names, "piece", "lead"])


def alignment(batches):
    """Rows (run, lines, lines2) of neighbouring runs to (run, gone): for each of the two, the numbers of the lines it shares."""
    for batch in batches:
        run, gone = [], []
        for r, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            run += [r, r + 1]
            gone += [shared(a, b), shared(b, a)]
        yield pa.RecordBatch.from_arrays([pa.array(run, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["run", "gone"])


def main_text(parsed: list[tuple[str, int]], gone: set[int], markup: bool = True) -> str:
    """The page's lines that stay, joined by a space. markup=False leaves all to differencing."""
    if not markup:
        return " ".join(t for k, (t, _) in enumerate(parsed) if k not in gone)
    if not any(f & IN_ARTICLE for _, f in parsed):
        return " ".join(t for k, (t, f) in enumerate(parsed) if not f & IN_CHROME and k not in gone)
    body = [k for k, (_, f) in enumerate(parsed) if f & IN_ARTICLE and not f & IN_CHROME]
    sure = [k for k in body if not parsed[k][1] & UNSURE]
    copied = 2 * sum(k in gone for k in sure) > len(sure)
    return " ".join(parsed[k][0] for k in body if copied or not (parsed[k][1] & UNSURE and k in gone))


def extract(pages: DataFrame, markup: bool = True, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: id, url, text ("" if none), n_chars.

    Null html counts as empty; a null URL as host and path "". Pages of equal URL are ordered
    by identifier; a page without a neighbour on its host keeps all lines that markup leaves;
    neighbours that are equal line by line say nothing and are passed over. Very long pages are
    read whole. Repeated rows get equal rows. An empty table gives none; other columns are ignored.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    path = F.regexp_replace(F.coalesce(url_col, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(path, "^[^/?#]*", 0))
    rows = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.coalesce(html_col, F.lit("")).alias("h"), host.alias("host"), F.regexp_extract(path, "^[^/?#]*([^?#]*)", 1).alias("path")).withColumn("v", F.xxhash64("u", "h"))

    def hashes(batches):
        for batch in batches:
            found = [[line_hash(t) for t, _ in lines(h)] for h in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names[1:], "lines"])

    # written before the range partitioning, which reads it twice: for splitters and for rows
    slim = written(rows.select("h", "host", "path", "i", "v").mapInArrow(hashes, f"host string, path string, i {kind}, v long, lines array<long>"), "page-hashes")
    slim = slim.repartitionByRange(partitions(spark), "host", "path", "i", "v").sortWithinPartitions("host", "path", "i", "v").withColumn("at", F.monotonically_increasing_id())
    slim = slim.select("host", "i", "v", "at", "lines").mapInArrow(pieces, f"host string, i {kind}, v long, at long, lines array<long>, piece long, lead boolean")
    slim = written(slim.withColumn("part", F.shiftright("at", 33)), "page-lines")
    # numbers of runs over all partitions: a piece's number in its partition and the runs before; a partition may begin within a run
    page = F.struct("host", F.size("lines").alias("size"), F.xxhash64("lines").alias("hash"))
    ends = slim.groupBy("part").agg(F.min_by(page, "at").alias("first"), F.max_by(page, "at").alias("last"), F.max("piece").alias("top")).orderBy("part").collect()  # a row a partition
    firsts, run, last = [], -1, None
    for r in ends:
        goes_on = r["first"] == last
        firsts.append((r["part"], run if goes_on else run + 1, goes_on))
        run, last = firsts[-1][1] + r["top"], r["last"]
    firsts = F.broadcast(spark.createDataFrame(firsts, "part long, first long, goes_on boolean"))
    run = (F.col("first") + F.col("piece")).alias("run")
    leads = slim.where("lead").join(firsts, "part")
    runs = leads.where("piece > 0 or not goes_on").select(run, "host", "lines")
    after = runs.select((F.col("run") - 1).alias("run"), F.col("host").alias("host2"), F.col("lines").alias("lines2"))
    met = runs.join(after, "run").where(F.col("host") == F.col("host2")).select("run", "lines", "lines2")
    gone = met.mapInArrow(alignment, "run long, gone array<int>").groupBy("run").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    gone = leads.select("part", "piece", run).join(gone, "run").select("part", "piece", "gone")
    gone = slim.select(F.col("i").alias("i2"), F.col("v").alias("v2"), "part", "piece").join(gone, ["part", "piece"]).groupBy("i2", "v2").agg(F.first("gone").alias("gone"))

    def texts(batches):
        for batch in batches:
            out = [main_text(lines(h), set(gone or ()), markup) for h, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], [id_col, url_col, "text", "n_chars"])

    full = rows.join(gone, F.col("i").eqNullSafe(F.col("i2")) & (F.col("v") == F.col("v2")), "left").select("i", "u", "h", "gone")
    return full.mapInArrow(texts, f"{id_col} {kind}, {url_col} string, text string, n_chars long")
