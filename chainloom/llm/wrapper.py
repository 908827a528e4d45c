"""Main text of web pages by wrapper induction.

Each page becomes a tree of its block elements, without the parts whose element or name
says that they are menus, forms, adverts, comments and the like.  The pages of one host are
aligned by simple tree matching with one page of that host, the pivot: among two nodes of
one tag, the best order-preserving matching of their children counts, and equal text counts
once more.  A block that most distinct pages of the host have at the same node of the pivot
with the same text is template; blocks that vary are content.

Every page is aligned for itself, wherever it lies, and the counts are of all pages; no
host's pages meet in one task.
"""

from __future__ import annotations

import functools
import html as html_module
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from chainloom.llm import common

# A block is template if this share of its host's distinct pages have it, and so many.
TEMPLATE_SHARE = 0.8
TEMPLATE_PAGES = 5
# Blocks of so many words, and headings, tell contents apart; dates and links do not.
CONTENT_WORDS = 8
# Text outside article and main is left if one of these holds this share of the varying text.
REGION_SHARE = 0.8
# Pages up to this length are preferred as pivots.
PIVOT_CHARS = 16_384

# HTML elements and what is known of them.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("iframe noembed noframes script style textarea title xmp".split())
LEFT_OUT = set(
    "applet aside audio button canvas datalist dialog footer head iframe input map menu nav noembed noframes noscript object option select "
    "svg template textarea video math".split()
)
NOT_IN_P = BLOCKS - {"option", "optgroup"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
          "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"})}
# Words of class, id and role that name parts beside the main text.
ASIDE = set(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs captcha comment comments commentlist complementary consent "
    "contentinfo cookie cookies dialog discussion disqus donate gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "outbrain overlay pager pagination paywall popup promo promoted promotion recommended related replies respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription taboola toolbar widget widgets".split()
)
ON_TOP = {"header", "footer", "top", "bottom"}
# A name with one of these means a part that has, or lacks, such a thing.
ABOUT = {"with", "has", "no", "without", "main", "article", "content", "body", "wrapper", "container", "page"}
SURE = {"ad", "ads", "advert", "adverts", "advertisement", "comment", "comments", "sidebar", "related", "newsletter", "share", "cookie", "promo", "sponsored"}
# Ids are often made from headings; of those in or of main text only these name a part beside it.
BESIDE_IDS = {"comments", "comment-list", "commentlist", "respond", "disqus_thread"}
# Whole names of classes that may just as well stand on main text.
UNSURE = {"dialog", "discussion", "notice", "notices", "search", "share"}
# Words that say nothing on what a part holds; behind a sure name also those for other articles.
LAYOUT = set(
    "area bar block box center col column desktop element frame global group holder inline inner item items label layer left line link links list "
    "mobile module outer pane panel parent part placeholder primary region responsive right row secondary section side single site slot small sticky "
    "strip sub tab table title unit units view wrap zone".split()
)
OTHERS = set("articles headlines latest more news popular post posts read stories story topics".split())
# What makes a form the frame of a page: one of these, or so many paragraphs.
FRAMED, FRAMED_PARAGRAPHS = {"article", "main", "h1"}, 3
HEADED = {"section", "h1", "h2", "h3", "h4", "h5", "h6"}
KEPT = {"html", "body", "article", "main"}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "out", "kids", "pieces", "text", "index", "region", "form", "framed", "full")

    def __init__(self, tag: str, out: bool, region: int | None, form: Node | None = None):
        self.tag, self.out, self.region = tag, out, region
        self.kids: list[Node] = []
        self.pieces: list[str] = []
        self.text = ""
        self.index = -1
        self.form = form  # the outermost form around it
        self.framed = 0  # of a form: paragraphs, and many for what only a page has
        self.full = 0  # the weight of matching the tree with an equal one


def names_aside(tag: str, attributes: str, in_region: bool) -> bool:
    """Whether class, id, role or style say that an element isn't main text.  Within article
    or main, and for sections and headings, only a whole class or role does."""
    found = {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    if tag in KEPT:
        return tag == "article" and not {"comment", "comments"}.isdisjoint(NAME.findall(found.get("class", "").lower()))
    classes = found.get("class", "").lower().split()
    if in_region or tag in HEADED or "section" in classes:
        roles = found.get("role", "").lower().split()
        return not (ASIDE - UNSURE).isdisjoint(classes) or not ASIDE.isdisjoint(roles) or found.get("id", "").strip().lower() in BESIDE_IDS
    for attribute in ("class", "id", "role"):
        for name in found.get(attribute, "").lower().split():
            parts = set(NAME.findall(name))
            wrong = parts & (ASIDE | ON_TOP)
            if attribute == "id" and name in UNSURE:
                continue  # made from a heading perhaps
            rest = {w for w in parts - wrong - ABOUT - LAYOUT if len(w) > 1}
            if rest - (OTHERS if parts & SURE else set()):
                continue  # what it is about is a matter of the alignment
            if wrong and (parts.isdisjoint(ABOUT) or (parts & SURE and parts.isdisjoint({"with", "has", "no", "without"}))):
                return True
    return False


def parse(page: str) -> tuple[Node, list[tuple[str, Node]]]:
    """The tree of block elements, and the blocks of text in page order."""
    root = Node("#", False, None)
    stack, blocks, buffer, regions = [root], [], [], 0

    def flush() -> None:
        if buffer:
            top = stack[-1]
            if not top.out:
                text = " ".join(html_module.unescape("".join(buffer)).split())
                if text:
                    blocks.append((text, top))
                    top.pieces.append(text)
            buffer.clear()

    def pop_to(depth: int) -> None:
        flush()
        del stack[depth:]

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                buffer.append(html_module.escape(m[0][9:-3]))
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    pop_to(depth)
                    break
                if stack[depth].tag in ("article", "main", "body") and tag not in BLOCKS:
                    break
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            if tag == "textarea":
                flush()
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        top = stack[-1]
        region = top.region  # the number of the outermost article or main
        if region is None and (tag in ("article", "main") or "main" in m[3] and re.search(r"""role\s*=\s*["']?main""", m[3])):
            region = regions = regions + 1
        out = top.out or tag in LEFT_OUT or (tag == "header" and top.region is None) or (m[3] != "" and names_aside(tag, m[3], top.region is not None))
        if tag not in BLOCKS and out == top.out:
            continue  # an inline element only carries text
        if tag in BLOCKS:
            flush()
            if tag in NOT_IN_P:
                if stack[-1].tag == "p":
                    stack.pop()
            if tag in CLOSES:
                ends, stops = CLOSES[tag]
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in stops:
                        break
                    if stack[depth].tag in ends:
                        del stack[depth:]
            if tag == "hr":
                continue
            top = stack[-1]
            out = out or top.out
        else:  # an inline part to leave out: what stands before it goes on behind it
            held = buffer[:]
            buffer.clear()
            node = Node(tag, True, region)
            stack.append(node)
            depth = 1
            # Skip to its end tag.
            for n in TAG.finditer(page, at):
                if n[2] is not None and n[2].lower() == tag:
                    depth += -1 if n[1] else 1
                    if not depth:
                        at = n.end()
                        break
                elif n[1] and n[2].lower() in BLOCKS:
                    at = n.start()
                    break
            else:
                at = end
            stack.pop()
            buffer += held
            continue
        node = Node(tag, out, region, top.form)
        if node.form is not None:
            node.form.framed += FRAMED_PARAGRAPHS if tag in FRAMED else tag == "p"
        elif tag == "form":
            node.form = node
        if not out:
            top.kids.append(node)
        stack.append(node)
    flush()
    nodes = [root]
    for node in nodes:
        nodes += node.kids
    for i, node in enumerate(nodes):
        node.index = i
        node.text, node.pieces = "\n".join(node.pieces), []
    for node in reversed(nodes):
        node.full = 1 + (node.text != "") + sum(k.full for k in node.kids)
    # A form is left out unless it frames the page.
    return root, [(t, n) for t, n in blocks if n.form is None or n.form.framed >= FRAMED_PARAGRAPHS]


def region(node: Node) -> int:
    """The number of a block's article or main; -1 for a main heading elsewhere, 0 for others."""
    return node.region or (-1 if node.tag == "h1" else 0)


def content(blocks: list[tuple[str, Node]]) -> int:
    """A number for what a page says, equal for copies that differ in short blocks only."""
    told = [t for t, n in blocks if n.tag in HEADED or len(t.split()) >= CONTENT_WORDS] or [t for t, _ in blocks]
    return xxhash.xxh3_64_intdigest("\n".join(told)) - (1 << 63)


def kinds_of(*trees: Node) -> dict[int, int]:
    """A number for each node of the trees, by ``id``: equal for equal trees."""
    numbers: dict[tuple, int] = {}
    out: dict[int, int] = {}
    for tree in trees:
        nodes = [tree]
        for node in nodes:
            nodes += node.kids
        for node in reversed(nodes):
            key = (node.tag, node.text, *(out[id(k)] for k in node.kids))
            out[id(node)] = numbers.setdefault(key, len(numbers))
    return out


class Matching:
    """Simple tree matching of two trees: the best order-preserving matching of children, for
    each pair of nodes that can meet.

    Equal trees match node by node, which no other matching betters; so equal children at
    both ends of two lists match each other, and only what lies between is compared.  Pairs
    wait on a stack, so that depth is no limit.
    """

    def __init__(self, page: Node, pivot: Node):
        self.kind = kinds_of(page, pivot)
        self.found: dict[tuple[int, int], tuple[int, list[tuple[Node, Node]]]] = {}
        stack = [(page, pivot)] if self.open(page, pivot) else []
        while stack:
            a, b = stack[-1]
            if (a.index, b.index) in self.found:
                stack.pop()
                continue
            head, tail = self.ends(a.kids, b.kids)
            x, y = a.kids[head : len(a.kids) - tail], b.kids[head : len(b.kids) - tail]
            waiting = [(p, q) for p in x for q in y if self.open(p, q) and (p.index, q.index) not in self.found]
            if waiting:
                stack += waiting
                continue
            same = [*zip(a.kids[:head], b.kids[:head]), *zip(a.kids[len(a.kids) - tail :], b.kids[len(b.kids) - tail :])]
            weight, pairs = self.best(x, y)
            self.found[a.index, b.index] = own_weight(a, b) + weight + sum(p.full for p, _ in same), same + pairs
            stack.pop()

    def equal(self, a: Node, b: Node) -> bool:
        return self.kind[id(a)] == self.kind[id(b)]

    def open(self, a: Node, b: Node) -> bool:
        """Whether the weight of two nodes has to be found by matching their children."""
        return a.tag == b.tag and bool(a.kids and b.kids) and not self.equal(a, b)

    def weight(self, a: Node, b: Node) -> int:
        if a.tag != b.tag:
            return 0
        if self.equal(a, b):
            return a.full
        return self.found[a.index, b.index][0] if a.kids and b.kids else own_weight(a, b)

    def ends(self, x: list[Node], y: list[Node]) -> tuple[int, int]:
        """How many children at the beginning and at the end are equal."""
        most = min(len(x), len(y))
        head = next((i for i in range(most) if not self.equal(x[i], y[i])), most)
        most -= head
        return head, next((i for i in range(most) if not self.equal(x[-1 - i], y[-1 - i])), most)

    def best(self, x: list[Node], y: list[Node]) -> tuple[int, list[tuple[Node, Node]]]:
        if not x or not y:
            return 0, []
        weights = [[self.weight(p, q) for q in y] for p in x]
        best = [[0] * (len(y) + 1)]
        for row in weights:
            above, line, left = best[-1], [0], 0
            for j, w in enumerate(row):
                left = max(left, above[j + 1], above[j] + w) if w else max(left, above[j + 1])
                line.append(left)
            best.append(line)
        pairs, i, j = [], len(x), len(y)
        while i and j:
            if weights[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + weights[i - 1][j - 1]:
                pairs.append((x[i - 1], y[j - 1]))
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return best[-1][-1], pairs

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """The matched children of two matched nodes."""
        return list(zip(a.kids, b.kids)) if self.equal(a, b) else self.found.get((a.index, b.index), (0, []))[1]


def own_weight(a: Node, b: Node) -> int:
    return 1 + (a.text == b.text and a.text != "")


def aligned(page: Node, pivot: Node) -> dict[int, int]:
    """Nodes of the page that match a node of the pivot."""
    if page.tag != pivot.tag:
        return {}
    found = Matching(page, pivot)
    out, work = {}, [(page, pivot)]
    while work:
        a, b = work.pop()
        out[a.index] = b.index
        work += found.pairs(a, b)
    return out


@functools.lru_cache(maxsize=128)
def pivot_tree(page: str) -> Node:
    return parse(page)[0]


def host(url: str):
    """Lower-case host name; null if there is none."""
    name = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(name != "", name)


def pivots(pages: DataFrame) -> DataFrame:
    """One page of each host: the one of least id among those of moderate length."""
    order = F.struct((F.length("html") > PIVOT_CHARS).alias("long"), F.col("page_id").isNull().alias("lost"), "page_id", F.xxhash64("html").alias("sig"))
    chosen = pages.where("host IS NOT NULL AND html <> ''").groupBy("host").agg(F.min(order).alias("best")).select("host", F.col("best.sig").alias("sig"))
    chosen = common.written(chosen, "wrapper-pivots")
    size = chosen.agg(F.coalesce(F.sum(F.octet_length("host") + 64), F.lit(0))).first()[0]
    found = common.join_sized(pages.select("host", "html", F.xxhash64("html").alias("sig")), chosen, ["host", "sig"], "inner", size)
    return found.groupBy("host").agg(F.min("html").alias("pivot"))


def few(batches: Iterator[pa.RecordBatch], rows: int = 100) -> Iterator[pa.RecordBatch]:
    """Pages are large, so that few of them are taken apart at a time."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)


def extract(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row; ``df`` has page_id, url and html.

    A null or empty html gives an empty text.  Pages without a host are not compared with
    others.  Copies, also with another date, link or markup, count as one page of their host,
    so that copying a page makes nothing template.  Equal rows give equal rows; an empty table gives none; other columns
    are ignored.
    """
    pages = df.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), host("url").alias("host"))
    models = common.written(pivots(pages), "wrapper-models")
    size = models.agg(F.coalesce(F.sum(F.octet_length("pivot") + F.octet_length("host") + 64), F.lit(0))).first()[0]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            texts, nodes, regions, contents, hashes = [], [], [], [], []
            for page, pivot in zip(batch.column("html").to_pylist(), batch.column("pivot").to_pylist()):
                tree, blocks = parse(page)
                match = aligned(tree, pivot_tree(pivot)) if pivot else {}
                texts.append([t for t, _ in blocks])
                hashes.append([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _ in blocks])
                nodes.append([match.get(n.index, -1) if not n.out else -1 for _, n in blocks])
                contents.append(content(blocks))
                regions.append([region(n) for _, n in blocks])
            keep = [batch.column(c) for c in ("page_id", "url", "host")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(texts, pa.list_(pa.string())), pa.array(nodes, pa.list_(pa.int32())), pa.array(regions, pa.list_(pa.int32())), pa.array(contents, pa.int64()),
                 pa.array(hashes, pa.list_(pa.int64()))],
                ["page_id", "url", "host", "texts", "nodes", "regions", "content", "hashes"]
            )

    with_pivot = common.join_sized(pages, models, ["host"], "left", size)
    types = dict(pages.dtypes)
    blocks = common.written(
        with_pivot.select("page_id", "url", "host", "html", "pivot").mapInArrow(
            align, f"page_id {types['page_id']}, url string, host string, texts array<string>, nodes array<int>, regions array<int>, content bigint, hashes array<bigint>"
        ), "wrapper-blocks",
    )

    # How many distinct contents of a host have a text at a node of the pivot.
    seen = blocks.where("host IS NOT NULL").select("host", "content", F.explode(F.arrays_zip("hashes", "nodes")).alias("b"))
    seen = seen.where("b.nodes >= 0").select("host", "content", F.col("b.nodes").alias("node"), F.col("b.hashes").alias("h"))
    counts = seen.distinct().groupBy("host", "node", "h").agg(F.count("*").alias("n")).where(F.col("n") >= TEMPLATE_PAGES)
    of_host = blocks.where("host IS NOT NULL").select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    template = counts.join(of_host, "host").where(F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    # At most one text of a node can reach the share, so a list is no longer than a pivot.
    lists = common.written(template.groupBy("host").agg(F.collect_list(F.struct("node", "h")).alias("template")), "wrapper-template")
    size = lists.agg(F.coalesce(F.sum(F.size("template") * 32 + 64), F.lit(0))).first()[0]
    judged = common.join_sized(blocks, lists, ["host"], "left", size)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What varies, in page order; where one article or main holds most of it, only that and
        the main heading."""
        known: tuple[str | None, dict[int, int]] = (None, {})
        for batch in few(batches):
            out = []
            columns = [batch.column(c) for c in ("host", "texts", "nodes", "regions", "hashes", "template")]
            for row in range(len(batch)):
                name, texts, nodes, regions, hashes = (c[row].as_py() for c in columns[:5])
                if name != known[0]:
                    known = name, {t["node"]: t["h"] for t in columns[5][row].as_py() or []}
                of_node = known[1]
                varying = [(t, r) for t, n, r, h in zip(texts, nodes, regions, hashes) if of_node.get(n) != h]
                chars = Counter()
                for t, r in varying:
                    chars[r] += len(t)
                largest = max((n for r, n in chars.items() if r > 0), default=-1)
                inside = largest >= REGION_SHARE * chars.total()
                out.append("\n".join(t for t, r in varying if not inside or r != 0))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    judged = judged.select("page_id", "url", "host", "texts", "nodes", "regions", "hashes", "template").mapInArrow(told, f"page_id {types['page_id']}, url string, text string")
    return judged.withColumn("n_chars", F.length("text").cast("bigint"))
