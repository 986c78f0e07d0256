"""Main text of web pages by site style trees.

Every page is parsed into blocks of text, each with its style node: the path of block elements, with their classes,
that leads to it, and its role. The DOMs of one host merge into a style tree: for each node the pages that show it, the texts
that stand there, and the orders of children that occur. A node's importance joins the diversity of what it contains (a text
on one page only counts 1, on all pages 0: the entropy of its spread over the pages, to the base of their number) with
the diversity of its parent's presentation. Every page is pruned by it: nodes below ``THRESHOLD`` go, and within the others
each text that is itself spread so widely that it falls below. Pages of a host with the same blocks count as one.

Roles that HTML states are priors that shift the importance by ``SHIFT``: down for navigation, forms, advertisements, comments
and the like, by element, role or class, and up in an article (or main element). Where class words say both, neither
counts. Class words of an element that holds all articles of the page (without articles: its headings of the first rank) say
nothing about what it holds, and neither do words about its layout (``has-sidebar``). In an article, words that
may name a section of it (``SOFT``) leave it undecided. A node on fewer than ``LEAST_PAGES`` pages has the importance of single texts, shifted. What browsers do not show is
no text of the page. Counts per (host, node, text) are aggregated with map-side partial counts, so that neither a large
host nor a common text gathers in one task, and joins on nodes are salted. Pages meet the exceptions of their host: nodes and
texts on which the tree decides against the role alone. While they are few (counted) they are sent to all executors and the
pages are parsed a second time, which costs less than to store their texts; beyond that, blocks are joined with them. A style node is the hash of its path, so that memory is
proportional to a page however deep it is.

Null and empty html: empty text. Null url: a host of its own. Repeated rows get a row each. Broken markup is read as
browsers do: unclosed elements end with their parents, an unfinished tag at the end is dropped. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, shared_dir, slices, stored

THRESHOLD, LEAST_PAGES, CONTENT = 0.4, 3, 0.9
#: Tasks over which the texts of one node are dealt in a join.
SALTS = 16
#: What the roles -1 and 1 add to a node's importance.
SHIFT = {-1: -0.58, 1: 0.25}

TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Elements that hold no main text.
DROPPED = frozenset(
    "head title script style noscript template iframe svg math canvas object audio video nav footer aside form menu dialog "
    "button select option textarea label datalist fieldset".split()
)
#: Those of them that are not shown as text.
UNSEEN = frozenset("head title script style noscript template iframe svg math canvas object audio video select option datalist".split())
#: Class, id and role words of what is not the article.
OTHER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login comment comments disqus respond reply replies share sharing social related recommended "
    "recommendations trending widget widgets toolbar pagination pager banner contentinfo complementary search "
    "disclaimer paywall".split()
)
MAIN = frozenset("article content main post entry story".split())
#: Words that, within the article, may also name a section of it; and words that say how a page is laid out.
SOFT = frozenset("related recommended recommendations search trending reply respond widget widgets".split())
LAYOUT = frozenset("has with no without off on hide hides show shows open closed".split())
#: Elements that an opening tag ends, if they are open in the same container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPE = frozenset("ul ol dl table body article section div html".split())
WORDS = re.compile("[A-Z]?[a-z]+|[A-Z]+")
#: Own roles of elements: not shown, not the article by element, not the article by class, undecided, the article.
UNSHOWN, NOT_BY_TAG, NOT_BY_CLASS, OPEN, ARTICLE = -3, -2, -1, 0, 1


def role(tag: str, attributes: str, in_main: bool) -> tuple[int, str]:
    """The role of an element by itself, and its classes."""
    if tag in UNSEEN:
        return UNSHOWN, ""
    if tag in DROPPED or tag == "header" and not in_main:
        return NOT_BY_TAG, ""
    if not attributes or tag in ("html", "body"):
        return (ARTICLE if tag in ("article", "main") else OPEN), ""
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    css = " ".join(sorted(found.get("class", "").lower().split()))
    if "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")) or found.get("aria-hidden") == "true":
        return UNSHOWN, css
    named = [{w.lower() for w in WORDS.findall(x)} for k in ("class", "id", "role") for x in found.get(k, "").split()]
    named = [w for w in named if not w & LAYOUT]
    main = tag in ("article", "main") or any(w & MAIN and not w & OTHER for w in named)
    other = [w for w in named if w & OTHER]
    if other:
        return (OPEN if main or in_main and all(w & OTHER <= SOFT for w in other) else NOT_BY_CLASS), css
    if any("header" in w and not w & MAIN for w in named) and not (in_main or main):
        return NOT_BY_CLASS, css
    return (ARTICLE if main or any(w & MAIN for w in named) else OPEN), css


def parse(page: str) -> tuple[list[tuple[int, int, int, str]], dict[int, str]]:
    """Blocks (style node, its parent, role, text) in page order, and each style node's order of children.

    Roles: -2 not shown, -1 not the article, 0 undecided, 1 the article.
    """
    blocks: list[tuple[int, int, int, int, str]] = []  # node, parent, role without classes, claim, text
    children: dict[int, list[str]] = {}
    # tag, node, parent, role without classes, in main, claim: the innermost element whose class says that it is no article
    stack: list[tuple[str, int, int, int, bool, int]] = [("", ROOT, 0, 0, False, -1)]
    claims: list[int] = []  # each claim's own outer claim
    held: dict[str, list[int]] = {"article": [], "h1": []}  # the claims that articles and headings stand in
    open_: Counter[str] = Counter()
    text: list[str] = []

    def flush() -> None:
        if text:
            joined = "".join(text)
            clean = " ".join((html.unescape(joined) if "&" in joined else joined).split())
            if clean:
                _, node, parent, own, _, claim = stack[-1]
                blocks.append((node, parent, own, claim, clean))
            text.clear()

    def close(i: int) -> None:
        for x in stack[i:]:
            open_[x[0]] -= 1
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        next_ = page.find("<", at)
        if next_ < 0:
            text.append(page[at:])
            break
        if next_ > at:
            text.append(page[at:next_])
        m = TOKEN.match(page, next_)
        if not m:
            text.append("<")
            at = next_ + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK or tag in DROPPED:
                flush()
                if open_[tag]:
                    close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in RAW:
            end_tag = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            end = page.find(">", end_tag.start()) if end_tag else -1
            at = end + 1 if end >= 0 else n
            continue
        if tag in BLOCK or tag in DROPPED:
            flush()
            if tag in VOID:
                continue
            ends = ENDS.get(tag) or ({"p"} if tag in BLOCK else set())
            if any(open_[e] for e in ends):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in ends:
                        close(i)
                        break
                    if stack[i][0] in SCOPE or stack[i][0] in DROPPED:
                        break
            _, node, _, above, in_main, claim = stack[-1]
            own, css = role(tag, m[3], in_main)
            if own == NOT_BY_CLASS:
                claims.append(claim)
                claim = len(claims) - 1
            elif tag in ("article", "main"):
                held["article"].append(claim)
            elif tag == "h1":
                held["h1"].append(claim)
            name = f"{tag}.{css}" if css else tag
            children.setdefault(node, []).append(name)
            plain = {UNSHOWN: -2, NOT_BY_TAG: -1, ARTICLE: 1}.get(own, 0)
            stack.append((tag, _hash(f"{node} {name}"), node, min(above, plain) if above < 0 or plain < 0 else max(above, plain), in_main or own == ARTICLE, claim))
            open_[tag] += 1
    flush()
    inside = [0] * len(claims)
    marks = held["article"] or held["h1"]
    for c in marks:
        if c >= 0:
            inside[c] += 1
    for c in range(len(claims) - 1, -1, -1):
        if claims[c] >= 0:
            inside[claims[c]] += inside[c]
    no_article: list[bool] = []
    for c, outer in enumerate(claims):
        no_article.append(not (marks and inside[c] == len(marks)) or outer >= 0 and no_article[outer])
    out = [(node, parent, min(own, -1) if claim >= 0 and no_article[claim] else own, t) for node, parent, own, claim, t in blocks]
    return out, {k: ">".join(x for i, x in enumerate(v) if not i or v[i - 1] != x) for k, v in children.items()}


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


#: The style node above all.
ROOT = _hash("")


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


_BLOCKS = "array<struct<node:bigint,role:int,h:bigint,text:string>>"
_FEATURES = "array<struct<node:bigint,parent:bigint,kind:int,h:bigint>>"
#: The kind of a feature that is an order of children; that of a text is its role.
ORDER = 2


def blocks_of(page: str | None) -> tuple[list[tuple[int, int, int, int, str]], dict[int, str]]:
    """Blocks that are shown: (node and role, its parent, role, hash of the text, text); and the orders of children."""
    blocks, children = parse(page or "")
    return [(_hash(f"{r} {node}"), parent, r, _hash(text), text) for node, parent, r, text in blocks if r > -2], children


def parsed(pages: DataFrame, texts: bool = False) -> DataFrame:
    """host, mark (of the blocks) and features of the tree; with texts also page_id, url and the blocks."""
    feature = pa.struct([("node", pa.int64()), ("parent", pa.int64()), ("kind", pa.int32()), ("h", pa.int64())])
    block = pa.struct([("node", pa.int64()), ("role", pa.int32()), ("h", pa.int64()), ("text", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 22):
                out = {"host": [], "mark": [], "blocks": [], "features": []}
                for url, page in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                    mine, children = blocks_of(page)
                    tree = {(node, parent, r, h) for node, parent, r, h, _ in mine} | {(node, 0, ORDER, _hash(order)) for node, order in children.items()}
                    out["host"].append(host_of(url))
                    out["mark"].append(_hash(" ".join(f"{node} {h}" for node, _, _, h, _ in mine)))
                    out["features"].append([{"node": node, "parent": parent, "kind": k, "h": h} for node, parent, k, h in tree])
                    if texts:
                        out["blocks"].append([{"node": node, "role": r, "h": h, "text": t} for node, _, r, h, t in mine])
                columns = {"host": pa.array(out["host"], pa.string()), "mark": pa.array(out["mark"], pa.int64()), "features": pa.array(out["features"], pa.list_(feature))}
                if texts:
                    columns |= {"page_id": part.column("page_id"), "url": part.column("url"), "blocks": pa.array(out["blocks"], pa.list_(block))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = f"host string, mark long, features {_FEATURES}" + (f", page_id long, url string, blocks {_BLOCKS}" if texts else "")
    return _rows(pages).mapInArrow(task, schema)


def _rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")


def exceptions(rows: DataFrame, threshold: float) -> DataFrame:
    """host, node, h: nodes (h null) of a role of -1 that stay, other nodes that go, and texts that go from nodes that stay."""
    distinct = rows.dropDuplicates(["host", "mark"])
    each = distinct.select("host", F.explode("features").alias("f")).select("host", "f.node", "f.parent", "f.kind", "f.h")
    spread = each.groupBy("host", "node", "parent", "kind", "h").agg(F.count("*").alias("n"))
    pages = distinct.select("host", F.explode(F.array_distinct(F.transform("features", lambda f: f["node"]))).alias("node")).groupBy("host", "node").agg(F.count("*").alias("pages"))
    base = F.log(F.greatest(F.col("pages"), F.lit(2)))
    known = F.col("pages") >= LEAST_PAGES
    # a node that many texts stand at is dealt over SALTS tasks
    salted = pages.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    with_pages = spread.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted, ["host", "node", "salt"]).withColumn("own", F.when(known, 1 - F.log("n") / base).otherwise(1.0))
    shift = F.when(F.col("kind") < 0, SHIFT[-1]).when(F.col("kind") > 0, SHIFT[1]).otherwise(0.0)
    share = F.col("n") / F.col("pages")
    shown = with_pages.where(F.col("kind") == ORDER).groupBy("host", F.col("node").alias("parent")).agg(F.sum(-share * F.log(share) / base).alias("shown"))
    texts = with_pages.where(F.col("kind") < ORDER)
    nodes = texts.groupBy("host", "node", "parent", "kind", "pages").agg(F.avg("own").alias("content")).join(shown, ["host", "parent"], "left")
    prior = F.when(known, (1 - CONTENT) * F.coalesce("shown", F.lit(0.0))).otherwise(0.0) + shift
    nodes = nodes.select("host", "node", "kind", prior.alias("prior"), (CONTENT * F.col("content") + prior >= threshold).alias("stays"))
    against = nodes.where(F.col("stays") == (F.col("kind") < 0)).select("host", "node", F.lit(None).cast("long").alias("h"))
    wide = texts.where(known & (F.col("n") > 1) & (CONTENT * F.col("own") + shift < threshold)).select("host", "node", "h", "own")
    gone = wide.join(nodes.where("stays").select("host", "node", "prior"), ["host", "node"]).where(CONTENT * F.col("own") + F.col("prior") < threshold)
    return against.union(gone.select("host", "node", "h"))


def _by_broadcast(spark: SparkSession, pages: DataFrame, keys: DataFrame) -> DataFrame:
    """Few exceptions: they go to all executors, and the pages are parsed once more, so that no text is stored or shuffled."""
    listed: dict[str, set] = {}
    for r in keys.collect():  # counted
        listed.setdefault(r["host"], set()).add((r["node"], r["h"]))
    known = spark.sparkContext.broadcast(listed)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 22):
                out = []
                for url, page in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                    own = known.value.get(host_of(url), ())
                    out.append("\n\n".join(t for node, _, r, h, t in blocks_of(page)[0] if (r < 0) == ((node, None) in own) and (node, h) not in own))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return _rows(pages).mapInArrow(task, "page_id long, url string, text string")


def _by_join(pages: DataFrame, keys: DataFrame, folder: str) -> DataFrame:
    """Any number of exceptions: places of blocks, without their texts, meet them by host, node and text."""
    rows = stored(parsed(pages, True).withColumn("row", F.monotonically_increasing_id()), f"{folder}/blocks")
    each = rows.select("row", "host", F.posexplode("blocks").alias("place", "b")).select(
        "row", "host", "place", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("b.node").alias("node"), F.lit(None).cast("long").alias("h")), F.struct(F.lit(1).alias("kind"), F.col("b.node").alias("node"), F.col("b.h").alias("h")))).alias("x")
    )
    each, keys = each.select("row", "host", "place", "x.*").alias("e"), keys.distinct().alias("k")
    met = each.join(keys, (F.col("e.host") == F.col("k.host")) & (F.col("e.node") == F.col("k.node")) & F.col("e.h").eqNullSafe(F.col("k.h")), "left_semi")
    places = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("place")))
    hit = met.groupBy("row").agg(places(0).alias("nodes"), places(1).alias("texts"))
    listed = lambda name, i: F.coalesce(F.array_contains(name, i), F.lit(False))
    keep = lambda b, i: ((b["role"] < 0) == listed("nodes", i)) & ~listed("texts", i)
    kept = rows.select("row", "page_id", "url", "blocks").join(hit, "row", "left").select("page_id", "url", F.filter("blocks", keep).alias("blocks"))
    return kept.select("page_id", "url", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n").alias("text"))


def extract(spark: SparkSession, pages: DataFrame, threshold: float = THRESHOLD, most_keys: int = MOST_BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars."""
    folder = shared_dir(spark)
    keys = stored(exceptions(stored(parsed(pages), f"{folder}/parsed"), threshold), f"{folder}/keys")
    text = _by_broadcast(spark, pages, keys) if keys.count() <= most_keys else _by_join(pages, keys, folder)
    return text.withColumn("n_chars", F.length("text").cast("long"))
