"""Main text of pages by a site style tree.

The pages of a host are merged into one tree.  A node is an element's path with class, id and role names (digits aside);
it holds the pages that have it, the ways its children follow one another there (its presentation), and the contents of
its blocks.  Pages of equal blocks count as one, so copies do not make their own text common.  All elements are in the tree but those
that hold no text for readers (head, script, style, ...).

- A content in n of the m pages that have its node has importance 1 - log(n) / log(m): 1 if one page has it, 0 if all do.
- A node's presentation has importance -sum of p log p to the base m over its child sequences, each in a share p of them.
- A branch (a node and all below it) has the composite importance (1 - g^l) x presentation + g^l x contents, where l is
  the number of child sequences, g is DAMPING, and contents is the mean importance of all contents in the branch; times the share
  of its text that is not link text outside articles.
- The same is counted over the pages of all hosts together.  A host's importance, known from m pages, and that of all hosts
  are averaged with weights m - 1 (one page tells nothing of what repeats) and SHARED, so a small host is judged by the styles it shares.
- Names are a prior: the importance of a leaf below an element of the navigation, footer, form, ... kind, or below a class,
  id or role that is a name of such, counts PRIOR times.

Leaves below a branch of low importance go from every page of the host, and so do contents of low importance.

Pages are parsed once.  Nodes are counted by Spark aggregates, so no host's tree is gathered in one place, and the blocks
meet a short list of what goes from their host; no html is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import chunks, discard, materialize
from .url_filter import host_of

#: What is below this importance is noise; weight of a leaf that is noise by its names, and of all hosts' tree in pages.
MIN_IMPORTANCE, PRIOR, SHARED = 0.2, 0.15, 2.0
#: Weight of the contents against the presentation for each child sequence.
DAMPING = 0.9
#: Elements below this depth are counted with their ancestor at it, which bounds the path of a page nested without end.
DEPTH = 64
#: The host of the tree of all hosts; no url has it.
ALL = "*"

#: Elements of HTML.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_NO_TEXT = {"head", "title", "script", "style", "noscript", "template", "iframe", "object", "svg", "select", "textarea"}
_APART = {"nav", "footer", "aside", "form", "button", "menu", "dialog"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NOISE_NAME = r"(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|popup|modal|newsletter|subscribe|sidebar|side-bar|widget|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|comments?|comment-list|disqus|share|social|related|recommended|login|search)"
#: A class, id or role made of such names only: "cookie-banner", but not "no-sidebar" or "article-header".
_NOISE = re.compile(rf"(?i)(?<!\S){_NOISE_NAME}(?:[_-]+{_NOISE_NAME})*(?!\S)")


class _Element:
    __slots__ = ("tag", "dropped", "noise", "inside", "node", "up", "style", "last")

    def __init__(self, tag: str, dropped: bool, noise: bool, inside: bool, node: int, up: tuple[int, ...]):
        self.tag, self.dropped, self.noise, self.inside, self.node, self.up = tag, dropped, noise, inside, node, up
        self.style, self.last = 0, ""


class _Blocks(HTMLParser):
    """Blocks of text in page order as (node, text, size, size of link text), their nodes, and the style of each node."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_Element("", False, False, False, 0, ())]
        self.open: Counter = Counter()
        self.out: list[tuple[int, str, int, int]] = []
        self.leaves: dict[int, _Element] = {}
        self.styles: set[tuple[int, int]] = set()
        self.text: list[str] = []
        self.linked = 0

    def parse_html_declaration(self, i):
        if self.rawdata.startswith("<![", i):  # any marked section counts as a comment up to the next >
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else len(self.rawdata)
        return super().parse_html_declaration(i)

    def flush(self):
        if self.text:
            text, linked = " ".join("".join(self.text).split()), self.linked
            self.text, self.linked = [], 0
            top = self.stack[-1]
            if text and not top.dropped:
                self.leaves[top.node] = top
                size = len(text) - text.count(" ")
                self.out.append((top.node, text, size, 0 if top.inside else min(linked, size)))

    def _pop(self, n: int):
        self.flush()
        for e in self.stack[n:]:
            self.open[e.tag] -= 1
            if not e.dropped and e.tag not in _INLINE:
                self.styles.add((e.node, e.style))
        del self.stack[n:]

    def _push(self, e: _Element):
        self.stack.append(e)
        self.open[e.tag] += 1

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            if tag == "br":
                self.text.append(" ")
            elif tag == "hr":
                self.flush()
            return
        top = self.stack[-1]
        names = _DIGITS.sub("0", " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)) if attrs else ""
        noise = bool(names) and bool(_NOISE.search(names))
        if tag in _INLINE and not noise:
            self._push(_Element(tag, top.dropped, top.noise, top.inside, top.node, top.up))
            return
        self.flush()
        if tag in _CLOSES_P and self.open["p"]:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag == "p":
                    self._pop(i)
                    break
                if self.stack[i].tag not in _INLINE:
                    break
        elif tag in _SIBLINGS:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in _SIBLINGS[tag]:
                    self._pop(i)
                    break
                if self.stack[i].tag in _HOLDERS:
                    break
        top = self.stack[-1]
        main = tag == "main" or (tag == "article" and not top.inside)
        apart = tag in _APART or (tag == "header" and not top.inside) or (noise and not main and tag not in ("html", "body"))
        dropped, noise = top.dropped or tag in _NO_TEXT, top.noise or apart
        node, up = top.node, top.up
        if not dropped and len(up) < DEPTH:
            label = f"{tag}.{names}" if names else tag
            node = xxhash.xxh3_64_intdigest(label, top.node)
            up = (*up, node)
            if label != top.last:  # equal neighbours count once
                top.style, top.last = xxhash.xxh3_64_intdigest(label, top.style), label
        self._push(_Element(tag, dropped, noise, top.inside or tag == "article", node, up))

    def handle_endtag(self, tag):
        if tag in _VOID or not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            e = self.stack[i]
            if e.tag == tag:
                if tag in _INLINE and not e.dropped:
                    del self.stack[i]  # the text goes on
                    self.open[tag] -= 1
                else:
                    self._pop(i)
                return
            if tag in _INLINE and e.tag not in _INLINE:
                return

    def handle_data(self, data):
        if not self.stack[-1].dropped:
            self.text.append(data)
            if self.open["a"]:
                self.linked += sum(map(len, data.split()))


#: Elements that a list item or a cell does not reach beyond.
_HOLDERS = {"ul", "ol", "dl", "table", "article", "section", "div", "body"}
_DIGITS = re.compile(r"\d+")


def blocks_of(html: str) -> _Blocks:
    """Blocks, leaves and styles of a page.  Should the parser give up on a malformed page, the blocks before that place stand."""
    p = _Blocks()
    try:
        p.feed(html)
        p.close()
    except AssertionError:
        pass
    p.flush()
    p._pop(1)
    return p


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _hash(x: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(x))


_PARSED = "page_id long, url string, host string, same long, blocks array<struct<node:long,content:long,size:int,linked:int,text:string>>, leaves array<struct<node:long,noise:boolean,up:array<long>>>, styles array<struct<node:long,style:long>>"
_TYPES = [
    ("page_id", pa.int64()),
    ("url", pa.string()),
    ("host", pa.string()),
    ("same", pa.int64()),
    ("blocks", pa.list_(pa.struct([("node", pa.int64()), ("content", pa.int64()), ("size", pa.int32()), ("linked", pa.int32()), ("text", pa.string())]))),
    ("leaves", pa.list_(pa.struct([("node", pa.int64()), ("noise", pa.bool_()), ("up", pa.list_(pa.int64()))]))),
    ("styles", pa.list_(pa.struct([("node", pa.int64()), ("style", pa.int64())]))),
]


def _row(html: str, prior: float) -> tuple:
    """same, blocks, leaves, styles of a page.  Blocks that the prior alone brings below MIN_IMPORTANCE count for no branch and go
    from every page, so they are left out."""
    p = blocks_of(html)
    seen = {n for e in p.leaves.values() for n in e.up}
    gone = {node for node, e in p.leaves.items() if prior < MIN_IMPORTANCE and e.noise}
    return (
        _hash("\0".join(f"{node} {t}" for node, t, _, _ in p.out)),
        [{"node": _signed(node), "content": _hash(t), "size": size, "linked": linked, "text": t} for node, t, size, linked in p.out if node not in gone],
        [{"node": _signed(node), "noise": e.noise, "up": [_signed(x) for x in e.up]} for node, e in p.leaves.items()],
        [{"node": _signed(node), "style": _signed(style)} for node, style in p.styles if node in seen],
    )


def parse(pages: DataFrame, prior: float = PRIOR) -> DataFrame:
    """A row for each page: its blocks, the nodes above their own, and the styles of those, as _PARSED says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                rows = [(page_id, url, host, *_row(html or "", prior)) for page_id, url, host, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "host", "html")))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _TYPES)], [n for n, _ in _TYPES])

    return pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html").mapInArrow(run, _PARSED)


def importances(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of contents (host, node, content, n, m, importance) and of branches (host, node, m, importance), for each host and
    for ALL of them, and of what lies where (host, leaf, noise, node); parsed is a table."""
    share = lambda n, m: F.when(m > 1, F.log(n) / F.log(m)).otherwise(F.lit(0.0))
    exploded = lambda column, *fields: parsed.select("host", "same", F.explode(column).alias("x")).select("host", "same", *[F.col(f"x.{f}") for f in fields])
    # pages of each host, and the sums of all hosts
    everywhere = lambda rows, *keys: rows.unionByName(rows.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("host", F.lit(ALL)))
    counted = lambda rows, *keys: everywhere(rows.distinct().groupBy("host", *keys).agg(F.count("*").alias("n")), *keys)
    leaves = exploded("leaves", "node", "noise", "up")
    own = leaves.select("host", "node", "noise", F.explode("up").alias("branch")).distinct()
    above = materialize(own.unionByName(own.withColumn("host", F.lit(ALL)).distinct()))
    held = materialize(counted(leaves.select("host", "same", F.explode("up").alias("node")), "node").withColumnRenamed("n", "m"))
    contents = counted(exploded("blocks", "node", "content"), "node", "content").join(held, ["host", "node"])
    contents = materialize(contents.withColumn("importance", F.when(F.col("m") > 1, 1 - share(F.col("n"), F.col("m"))).otherwise(1.0)))
    # what a leaf holds counts for all branches that it is in
    sums = contents.groupBy("host", "node").agg(F.sum(F.col("n") * F.col("importance")).alias("weighed"), F.sum("n").alias("weight"))
    sizes = exploded("blocks", "node", "size", "linked").groupBy("host", "node").agg(F.sum("size").alias("size"), F.sum("linked").alias("linked"))
    sizes = sizes.unionByName(sizes.groupBy("node").agg(F.sum("size").alias("size"), F.sum("linked").alias("linked")).withColumn("host", F.lit(ALL)))
    inner = above.join(sums, ["host", "node"]).join(sizes, ["host", "node"]).groupBy("host", F.col("branch").alias("node")).agg((F.sum("weighed") / F.sum("weight")).alias("inner"), (1 - F.sum("linked") / F.sum("size")).alias("plain"))
    styles = counted(exploded("styles", "node", "style"), "node", "style")
    total = styles.groupBy("host", "node").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    shown = styles.join(total, ["host", "node"]).groupBy("host", "node").agg((-F.sum(p * F.log(p))).alias("nats"), F.count("*").alias("l"))
    both = inner.join(held, ["host", "node"]).join(shown, ["host", "node"], "left")
    shape = F.when(F.col("m") > 1, F.coalesce("nats", F.lit(0.0)) / F.log("m")).otherwise(1.0)
    weight = F.pow(F.lit(DAMPING), F.coalesce("l", F.lit(0)))
    branches = materialize(both.select("host", "node", "m", (((1 - weight) * F.least(shape, F.lit(1.0)) + weight * F.col("inner")) * F.col("plain")).alias("importance")))
    discard(held)
    return contents, branches, above.select("host", F.col("node").alias("leaf"), "noise", F.col("branch").alias("node"))


def settled(table: DataFrame, *keys: str) -> DataFrame:
    """The rows of hosts, their importance averaged with that of ALL by the pages that speak for each."""
    shared = table.where(F.col("host") == ALL).select(*keys, F.col("importance").alias("all"))
    others = F.col("m") - 1
    mean = (others * F.col("importance") + SHARED * F.col("all")) / (others + SHARED)
    return table.where(F.col("host") != ALL).join(shared, list(keys)).withColumn("importance", mean).drop("all")


def noise(parsed: DataFrame, prior: float = PRIOR) -> DataFrame:
    """host, nodes (leaves in branches of low importance), contents (hashes of node and content of low importance)."""
    contents, branches, above = importances(parsed)
    low = F.col("importance") < MIN_IMPORTANCE
    judged = above.where(F.col("host") != ALL).join(settled(branches, "node"), ["host", "node"])
    weight = F.when(F.col("noise"), F.lit(prior)).otherwise(F.lit(1.0))
    gone = judged.groupBy("host", "leaf").agg(F.min(F.col("importance") * weight).alias("importance")).where(low)
    nodes = gone.groupBy("host").agg(F.collect_list("leaf").alias("nodes"))
    common = settled(contents, "node", "content").where(low).groupBy("host").agg(F.collect_list(F.xxhash64("node", "content")).alias("contents"))
    return materialize(nodes.join(common, "host", "full"))


def extract(pages: DataFrame, prior: float = PRIOR) -> DataFrame:
    """page_id, url, text, n_chars for every row.

    Null html is empty, null urls form one host.  Blocks are joined by a blank line, white space inside a block is one
    space.  A page of nothing but what nearly all pages of its host have, or of nothing but links outside articles, is empty.
    Repeated rows give repeated rows, an empty table none; other columns are not looked at.  With a prior of 1 names say nothing.
    """
    parsed = materialize(parse(pages, prior))
    # a written table: Spark sends it out if it is small, and can split a hot host if not
    gone = noise(parsed, prior)
    none = F.array().cast("array<long>")
    rows = parsed.select("page_id", "url", "host", "blocks").join(gone, "host", "left")
    rows = rows.select("page_id", "url", "blocks", F.coalesce("nodes", none).alias("nodes"), F.coalesce("contents", none).alias("contents"))
    kept = F.filter("blocks", lambda b: ~F.array_contains("nodes", b["node"]) & ~F.array_contains("contents", F.xxhash64(b["node"], b["content"])))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
