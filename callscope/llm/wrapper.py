"""Main text of web pages by wrapper induction.

1. Every page becomes a tree of its block elements, in which runs of like siblings are one repeated node, with
   a hash of each node's own text.
2. A host's pivot is the smallest page of its commonest tree shape.
3. Each page is aligned with its host's pivot by simple tree matching; over all pages of a host with different
   candidate texts, the share of pages whose node says the same as the pivot's is counted.
4. Nodes that stay constant are template; the varying slots are content, unless they lie in an element that
   HTML marks as something else than the article (navigation, forms and so on).
5. Class and id names (notices, adverts, comments and so on) decide only for elements that do not hold the article:
   never around `main` or the page's only article, nor around the largest varying slot or most of the varying text.
   A name that is a whole class or id stands against size where an article lies outside.
6. If article elements hold at least half of what is left, only they are content.

Pages with equal candidate texts count once, so copies of one article don't make it template, and a host
needs `MIN_PAGES` different pages before anything counts as constant.

A null page is empty and gives an empty text; a page without a host, or whose tree matches its pivot badly, is
judged by its own markup alone.  Repeated rows are extracted once each.  Pages of many thousand blocks are
aligned like others: see `match` for what that takes.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.session import scratch_dir

MIN_PAGES = 4
CONSTANT = 0.8
MIN_MATCH = 0.3
#: Blocks nested deeper than this become part of the one at this depth.
MAX_DEPTH = 200
#: Sums of one alignment that are kept at a time.
CELLS = 1 << 21
#: Wrappers of up to this many bytes in all are broadcast; more are joined to the pages by host.
BROADCAST_BYTES = 8 << 20

# Fixed names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes iframe".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output "
    "progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
NOT_TEXT = set(
    "head script style noscript template nav aside form button select option textarea input iframe svg canvas object "
    "embed audio video dialog menu title map applet".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split()
)
ENDED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Words of class and id names.
OTHER_WORDS = (
    r"(?:ads?|adverts?|advertisement|advertising|banners?|promos?|promoted|sponsor(?:s|ed)?|cookies?|consent|gdpr|notices?|alerts?|popup|"
    r"modal|overlay|menus?|nav|navbar|navigation|breadcrumbs?|sidebar|comments?|commentlist|disqus|repl(?:y|ies)|respond|shar(?:e|ing)|social|"
    r"related|recommend(?:ed|ations)?|newsletter|subscribe|subscription|signup|login|search|pagination|pager|widgets?)"
)
EDGE_WORDS = r"(?:header|masthead|footer|copyright|legal)"
OTHER_PARTS, EDGE_PARTS = (re.compile(rf"(?:^|[\s_-]){words}(?:$|[\s_\d-])", re.I) for words in (OTHER_WORDS, EDGE_WORDS))
OTHER_NAME, EDGE_NAME = (re.compile(rf"(?:^|\s){words}(?:$|\s)", re.I) for words in (OTHER_WORDS, EDGE_WORDS))
#: Names that say what else a page has.
STATES = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without)[_-]\S*", re.I)
OTHER_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """A block element: children in order, and own texts as (place on the page, text).

    `named` is what `named_other` says of it; `articles` and `main` tell of the outermost article and main elements in it.
    """

    __slots__ = ("label", "tag", "children", "texts", "skip", "article", "named", "articles", "main", "form")

    def __init__(self, label: str, tag: str, skip: bool, article: bool, named: int = 0):
        self.label, self.tag, self.skip, self.article, self.named = label, tag, skip, article, named
        self.articles, self.main, self.form = 0, False, -1
        self.children: list[Node] = []
        self.texts: list[tuple[int, str]] = []


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def marked_other(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether HTML itself says that this is no part of an article."""
    if tag in NOT_TEXT or (tag in ("header", "footer") and not (in_article and tag == "header")):
        return True
    if not attrs:
        return False
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    return hidden or attrs.get("role", "").lower() in OTHER_ROLES


def named_other(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    """Whether class or id name something else than an article: 2 if one of them is such a word, 1 if it has one as a part."""
    if not attrs or tag in ("html", "body"):
        return 0
    names = STATES.sub("", f"{attrs.get('class', '')} {attrs.get('id', '')}")
    if OTHER_NAME.search(names) or (not in_article and EDGE_NAME.search(names)):
        return 2
    return int(bool(OTHER_PARTS.search(names) or (not in_article and EDGE_PARTS.search(names))))


def parse(page: str, names: bool = True) -> Node:
    """The page's tree of blocks.  Names of inline elements count unless more text lies in those than in all others."""
    root = Node("", "", False, False)
    # Open elements: tag, block that texts go to, whether an inline element is marked as no article, and how it is named.
    stack: list[tuple[str, Node, bool, int]] = [("", root, False, 0)]
    said = {True: 0, False: 0}
    run: list[str] = []
    deeper: dict[str, int] = {}
    places = 0
    at = 0

    def flush() -> None:
        nonlocal places
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            stack[-1][1].texts.append((places, text))
            places += 1

    def close(to: int) -> None:
        if any(tag not in INLINE for tag, *_ in stack[to:]):
            flush()
        del stack[to:]

    def say(text: str) -> None:
        inline = stack[-1][0] in INLINE
        if text and not stack[-1][2]:
            named = inline and stack[-1][3] > 0
            if not stack[-1][1].skip:
                said[named] += len(text.strip())
            if not named:
                run.append(text)

    while True:
        found = _TAG.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            if deeper.get(tag):
                deeper[tag] -= 1
                flush()
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] in ("article", "body", "table") and tag in INLINE | {"p", "li"}:
                    break
            continue
        if tag == "br" or tag == "hr":
            say(" ")
        if tag == "hr":
            flush()
        if tag in VOID:
            continue
        attrs = attributes(found[3] or found[6] or "")
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        if tag in ENDED_BY:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in HOLDS[tag]:
                    break
                if stack[i][0] in ENDED_BY[tag]:
                    close(i)
                    break
        if tag == "body":
            for i in range(1, len(stack)):
                if stack[i][0] == "head":
                    close(i)
                    break
        block = stack[-1][1]
        if len(stack) > MAX_DEPTH and tag not in RAW:
            flush()
            deeper[tag] = deeper.get(tag, 0) + 1
            continue
        if tag in INLINE:
            around = stack[-1][3] if stack[-1][0] in INLINE else 0
            named = max(around, named_other(tag, attrs, block.article)) if names else 0
            stack.append((tag, block, stack[-1][2] or (bool(attrs) and marked_other(tag, attrs, block.article)), named))
        else:
            flush()
            article = block.article or tag in ("article", "main") or attrs.get("role") == "main"
            skip = block.skip or stack[-1][2] or marked_other(tag, attrs, block.article)
            around = stack[-1][3] if stack[-1][0] in INLINE else 0
            classes = " ".join(sorted(attrs.get("class", "").split())) if attrs else ""
            node = Node(f"{tag}.{classes}" if classes else tag, tag, skip, article, max(around, named_other(tag, attrs, block.article)))
            block.children.append(node)
            stack.append((tag, node, False, 0))
            if article and not block.article and not skip:
                main = tag == "main" or attrs.get("role") == "main"
                for holder in {id(open_node): open_node for _, open_node, _, _ in stack}.values():
                    holder.articles += 1
                    holder.main |= main
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            run.append(page[at : end.start() if end else len(page)]) if tag in ("title", "textarea") else None
            at = end.end() if end else len(page)
            close(len(stack) - 1)
    flush()
    return parse(page, False) if said[True] > said[False] else root


def fold(node: Node, forms: dict[tuple, int] | None = None) -> Node:
    """Runs of siblings with equal label, and equal labels below, become one node.  Equal trees of labels have one `form`."""
    forms = {} if forms is None else forms
    kept: list[Node] = []
    for child in node.children:
        fold(child, forms)
        if kept and kept[-1].form == child.form:
            join(kept[-1], child)
        else:
            kept.append(child)
    node.children = kept
    node.form = forms.setdefault((node.label, *(c.form for c in kept)), len(forms))
    return node


def shape(node: Node) -> tuple:
    return node.label, tuple(shape(c) for c in node.children)


def join(node: Node, other: Node) -> None:
    node.texts += other.texts
    node.named = min(node.named, other.named)
    node.articles += other.articles
    node.main |= other.main
    for mine, theirs in zip(node.children, other.children, strict=True):
        join(mine, theirs)


def walk(node: Node) -> Iterator[Node]:
    """Nodes in the order in which they are numbered."""
    yield node
    for child in node.children:
        yield from walk(child)


def digest(texts: list[str]) -> str:
    return blake2b("\n".join(texts).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def outline(node: Node) -> list:
    """[label, text hash, [children]], which is all that aligning takes."""
    return [node.label, digest([t for _, t in node.texts]) if node.texts else "", [outline(c) for c in node.children]]


class Forms:
    """Trees of labels by number, and the sizes of the largest matches of two of them."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.labels: list[str] = []
        self.below: list[list[int]] = []
        self.sizes: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def read(self, x: list, number: Iterator[int]) -> tuple[int, int, list]:
        """An outline as (form, node number, children)."""
        mine = next(number)
        children = [self.read(c, number) for c in x[2]]
        forms = [c[0] for c in children]
        form = self.numbers.setdefault((x[0], *forms), len(self.numbers))
        if form == len(self.labels):
            self.labels.append(x[0])
            self.below.append(forms)
            self.sizes.append(1 + sum(self.sizes[f] for f in forms))
        return form, mine, children

    def weight(self, f: int, g: int) -> int:
        if f == g:
            return self.sizes[f]
        if self.labels[f] != self.labels[g]:
            return 0
        if not (self.below[f] and self.below[g]):
            return 1
        if (f, g) not in self.known:
            xs, ys = self.below[f], self.below[g]
            start, end = ends(xs, ys)
            same = sum(self.sizes[x] for x in xs[:start]) + sum(self.sizes[x] for x in xs[len(xs) - end :])
            xs, ys = xs[start : len(xs) - end], ys[start : len(ys) - end]
            self.known[f, g] = 1 + same + (int(self.table(xs, ys).last(xs, ys)[-1]) if xs and ys else 0)
        return self.known[f, g]

    def table(self, xs: list[int], ys: list[int]) -> Weights:
        kinds = sorted(set(ys))
        return Weights({x: np.array([self.weight(x, y) for y in kinds], np.int32) for x in set(xs)}, {y: i for i, y in enumerate(kinds)})


def ends(xs: list[int], ys: list[int]) -> tuple[int, int]:
    """Lengths of the equal start and end of two lists.  Matching these loses nothing, as no node can match more than itself."""
    most = min(len(xs), len(ys))
    end = next((i for i in range(most) if xs[-1 - i] != ys[-1 - i]), most)
    start = next((i for i in range(most - end) if xs[i] != ys[i]), most - end)
    return start, end


class Weights:
    """Alignment of two lists of siblings with the largest sum of weights."""

    def __init__(self, table: dict[int, np.ndarray], kinds: dict[int, int]):
        self.table, self.kinds = table, kinds
        self.ones = all(w.max() <= 1 for w in table.values())

    def codes(self, ys: list[int]) -> np.ndarray:
        return np.fromiter((self.kinds[y] for y in ys), np.int64, len(ys))

    def rows(self, xs: list[int], ys: list[int]) -> Iterator[np.ndarray]:
        """After each of xs, the best sum for every start of ys."""
        codes, row = self.codes(ys), np.zeros(len(ys) + 1, np.int32)
        for x in xs:
            new = row.copy()
            np.maximum(row[1:], row[:-1] + self.table[x][codes], out=new[1:])
            row = np.maximum.accumulate(new, out=new)
            yield row

    def last(self, xs: list[int], ys: list[int]) -> np.ndarray:
        """The last of `rows`.  Weights of 0 and 1 are steps: one bit for each of ys, cleared where the row rises."""
        if not self.ones or len(ys) < 64:
            row = np.zeros(len(ys) + 1, np.int32)
            for row in self.rows(xs, ys):  # noqa: B007 - the last one counts
                pass
            return row
        codes, masks = self.codes(ys), {}
        for x, weights in self.table.items():
            masks[x] = int.from_bytes(np.packbits(weights[codes].astype(bool), bitorder="little").tobytes(), "little")
        every = (1 << len(ys)) - 1
        flat = every
        for x in xs:
            hit = flat & masks[x]
            flat = ((flat + hit) | (flat - hit)) & every
        bits = np.unpackbits(np.frombuffer(flat.to_bytes((len(ys) + 7) // 8, "little"), np.uint8), bitorder="little")[: len(ys)]
        return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int32)))).astype(np.int32)

    def align(self, xs: list[int], ys: list[int], at: tuple[int, int]) -> Iterator[tuple[int, int]]:
        """Places that are matched.  Lists too long for a table of all sums are cut where two halves add up best."""
        if len(xs) > 1 and len(xs) * len(ys) > CELLS:
            half = len(xs) // 2
            sums = self.last(xs[:half], ys) + self.last(xs[half:][::-1], ys[::-1])[::-1]
            cut = int(sums.argmax())
            yield from self.align(xs[:half], ys[:cut], at)
            yield from self.align(xs[half:], ys[cut:], (at[0] + half, at[1] + cut))
            return
        rows = [np.zeros(len(ys) + 1, np.int32), *self.rows(xs, ys)]
        i, j = len(xs), len(ys)
        while i and j:
            w = self.table[xs[i - 1]][self.kinds[ys[j - 1]]]
            if w and rows[i][j] == rows[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                yield at[0] + i, at[1] + j
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1


def match(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two outlines: size of the largest match, and its pairs of node numbers.

    Two trees of labels are compared once however often they occur, equal starts and ends of two lists of siblings
    are matched at once, and what lies between takes memory in proportion to the lists, not to their product.
    """
    forms = Forms()
    x, y = (forms.read(tree, iter(range(1 << 62))) for tree in (a, b))
    total = forms.weight(x[0], y[0])
    pairs: list[tuple[int, int]] = []
    open_pairs = [(x, y)] if total else []
    while open_pairs:
        (_, nx, left), (_, ny, right) = open_pairs.pop()
        pairs.append((nx, ny))
        xs, ys = [c[0] for c in left], [c[0] for c in right]
        start, end = ends(xs, ys)
        open_pairs += zip(left[:start], right[:start], strict=True)
        open_pairs += zip(left[len(xs) - end :], right[len(ys) - end :], strict=True)
        xs, ys = xs[start : len(xs) - end], ys[start : len(ys) - end]
        if xs and ys:
            open_pairs += ((left[i], right[j]) for i, j in forms.table(xs, ys).align(xs, ys, (start, start)))
    return total, pairs


def alike(total: int, a: int, b: int) -> bool:
    return total >= MIN_MATCH * (a + b) / 2


def candidates(root: Node, template: set[int] | frozenset[int] = frozenset()) -> list[tuple[int, Node]]:
    """Numbered nodes whose texts are content, and constant ones beside them."""
    slots: list[tuple[int, Node, tuple[Node, ...], int]] = []
    numbers = iter(range(1 << 62))

    def visit(node: Node, around: tuple[Node, ...]) -> None:
        n = next(numbers)
        around = (*around, node) if node.named else around
        if node.texts and not node.skip:
            slots.append((n, node, around, 0 if n in template else sum(len(t) for _, t in node.texts)))
        for child in node.children:
            visit(child, around)

    visit(root, ())

    for strength in (2, 1):
        total = sum(x[3] for x in slots)
        in_articles = sum(x[3] for x in slots if x[1].article)
        largest = {id(a) for a in max(slots, key=lambda x: x[3])[2]} if total else set()
        named = {id(a): a for x in slots for a in x[2] if a.named == strength}
        # Texts below each named element: all, and those in articles.
        within, articles = dict.fromkeys(named, 0), dict.fromkeys(named, 0)
        for _, node, around, size in slots:
            for key in {id(a) for a in around} & named.keys():
                within[key] += size
                articles[key] += size if node.article else 0
        out = set()
        for key, node in named.items():
            if node.main or (node.articles and root.articles == 1):
                continue
            much = 2 * within[key] > total or key in largest
            if not much or (strength == 2 and in_articles > articles[key]):
                out.add(key)
        slots = [x for x in slots if not any(id(a) in out for a in x[2])]
    inside = sum(x[3] for x in slots if x[1].article)
    if inside and 2 * inside >= sum(x[3] for x in slots):
        slots = [x for x in slots if x[1].article]
    return [(n, node) for n, node, _, _ in slots]


def content(root: Node, template: set[int]) -> str:
    """Texts of the varying slots in page order; within article elements if these hold the larger share."""
    texts = sorted(t for n, node in candidates(root, template) if n not in template for t in node.texts)
    return "\n".join(t for _, t in texts)


def count_nodes(x: list) -> int:
    return 1 + sum(map(count_nodes, x[2]))


def flat(x: list) -> Iterator[str]:
    yield x[1]
    for child in x[2]:
        yield from flat(child)


_OUTLINES = "host string, page_id long, shape string, text string, outline string"


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page in batch.column(2).to_pylist():
            root = fold(parse(page or ""))
            lines = json.dumps(outline(root), separators=(",", ":"))
            rows.append((digest([repr(shape(root))]), digest([t for _, node in candidates(root) for _, t in node.texts]), lines))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), *(pa.array([r[i] for r in rows], pa.string()) for i in range(3))], [f.split()[0] for f in _OUTLINES.split(", ")])


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page and matched node of the pivot: whether it says the same."""
    for batch in batches:
        hosts, nodes, same = [], [], []
        loaded: dict[str, list] = {}
        for host, mine, pivot in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if pivot not in loaded:
                loaded[pivot] = json.loads(pivot)
            a, b = json.loads(mine), loaded[pivot]
            total, pairs = match(a, b)
            if not alike(total, count_nodes(a), count_nodes(b)):
                continue
            texts_a, texts_b = list(flat(a)), list(flat(b))
            for i, j in pairs:
                hosts.append(host)
                nodes.append(j)
                same.append(int(texts_a[i] == texts_b[j]))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(nodes, pa.int32()), pa.array(same, pa.int64())], ["host", "node", "same"])


def host_of(url: str | Column) -> Column:
    column = F.col(url) if isinstance(url, str) else url
    return F.nullif(F.lower(F.regexp_extract(column, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def induce(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """host, pivot (outline), template (numbers of its constant nodes), of every host."""
    spark = pages.sparkSession
    root = scratch_dir(spark, "wrappers")
    source = pages.select(host_of(url).alias("host"), F.col(page_id).alias("page_id"), F.col(page).alias("html")).where("host is not null")
    source.mapInArrow(_outline, _OUTLINES).write.parquet(f"{root}/outlines")
    outlines = spark.read.parquet(f"{root}/outlines")
    shapes = outlines.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("page_id"), F.col("outline"))).alias("first"))
    pivots = shapes.groupBy("host").agg(F.max_by("first.outline", F.struct("n", F.col("shape"))).alias("pivot"))
    different = outlines.groupBy("host", "text").agg(F.min(F.struct("page_id", "outline")).alias("x")).select("host", F.col("x.outline").alias("outline"))
    agreed = different.join(pivots, "host").select("host", "outline", "pivot").mapInArrow(_agree, "host string, node int, same long")
    constant = (
        agreed.groupBy("host", "node").agg(F.sum("same").alias("same"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") >= MIN_PAGES) & (F.col("same") >= F.col("n") * CONSTANT))
        .groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("template"))
    )
    pivots.join(constant, "host").write.parquet(f"{root}/wrappers")
    return spark.read.parquet(f"{root}/wrappers")


def extract_text(page: str, pivot: str | None, template: list[int] | None) -> str:
    root = fold(parse(page))
    drop: set[int] = set()
    if pivot and template:
        mine, other = outline(root), json.loads(pivot)
        total, pairs = match(mine, other)
        if alike(total, count_nodes(mine), count_nodes(other)):
            fixed, texts, theirs = set(template), list(flat(mine)), list(flat(other))
            drop = {i for i, j in pairs if j in fixed and texts[i] == theirs[j]}
    return content(root, drop)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    wrappers = induce(pages, page_id, url, page)
    size = wrappers.agg(F.sum(F.length("pivot") + 8 * F.size("template") + 64)).first()[0] or 0
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"), host_of(url).alias("_host"))
    wrappers = wrappers.withColumnRenamed("host", "_of")
    rows = rows.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, F.col("_host") == F.col("_of"), "left")
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in ("page_id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_text(p or "", v, t) for p, v, t in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "pivot", "template").mapInArrow(run, f"{kinds}, text string, n_chars long")
