"""Main text of web pages by wrapper induction.

Each page is parsed into a DOM tree whose elements are labelled with tag and class; siblings of one label are one
repeating slot that holds a bag of texts. Pages of one host are aligned by simple tree matching: the best order-keeping
match of the children lists, level by level. What matches is merged and counted, so every host gets one template
tree that says for each slot on how many pages it stands and which texts it repeats there. A text that a slot repeats
on at least `SHARE` of a host's different pages is template and goes, wherever it stands; what varies is content.

What varies is then judged by what a page says about itself: menus, page headers, footers, asides, forms, scripts and elements whose class,
id or role names a menu, sidebar, notice, advert or reader comment are never content, and where a page has an article (or main)
element, content lies within it. A name rules out neither the body nor the page's articles and main elements, nor what contains these;
a word like `has-sidebar` or `comments-open` tells a state and names nothing; and where names rule out all text of a page, they
rule out none. Within an article a text is template on `MIN_INSIDE` pages or more only, and while repeated text is the smaller part of the
page's article text; otherwise the host's pages are copies of each other, and copies keep their text.

Hosts of any size: equal pages of a host are one; pages are dealt into parts of about `GROUP` pages of a host, each makes a partial
template of slots without texts, and partial templates merge in rounds of `GROUP` until each host has one. Then every page is aligned with
its host's template and its texts are counted as rows (host, slot, text), summed in tasks first: shares are exact, and a slot
may hold any number of texts. Nothing recurses, so nesting of any depth is fine. Templates then meet the pages again: broadcast
if all of them together are under `BROADCAST_BYTES`, by a join on the host otherwise, with the same results.

Defined results: null or empty html gives an empty text; a page cut off in mid-markup gives the text up to there; a null url is a host
of its own; repeated rows are each extracted, equal pages of a host count once for its template; a host of one page has no
template; very long and very deep pages are taken whole; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import pickle
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_PAGES = 2
MIN_INSIDE = 6
SHARE = 0.8
GROUP = 48
BROADCAST_BYTES = 16_000_000

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|([^\s=/\"'>]+)")
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[a-z]+")

# Fixed values of HTML and of common usage.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var".split()
)
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = {"ul", "ol", "dl", "table", "select", "body", "html", "article", "section", "div", "main"}
NEVER = {"head", "nav", "footer", "aside", "form", "menu", "button", "select", "option", "template", "svg", "canvas", "object", "dialog", "audio", "video"}
CONTENT = {"article", "main"}
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion breadcrumb breadcrumbs comment comments "
    "commentlist disqus consent cookie cookies footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination "
    "pager popup popover related replies reply respond share sharing sidebar signup social subscribe subscription toolbar widget".split()
)
STATE = re.compile(r"(?:has|with|without|no|is|show|hide)[-_].*|.*[-_](?:open|closed|enabled|disabled|on|off|page|layout)")
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search"}


class Node:
    """A slot: label, pages it stands on, hashes of its texts (on a page's tree; none on a template), child slots in order."""

    __slots__ = ("label", "pages", "texts", "kids")

    def __init__(self, label: str, pages: int = 1, texts: dict | None = None):
        self.label, self.pages, self.texts, self.kids = label, pages, texts or {}, []

    def walk(self):
        """(depth, slot) in the order of the page."""
        stack = [(0, self)]
        while stack:
            depth, node = stack.pop()
            yield depth, node
            stack.extend((depth + 1, kid) for kid in reversed(node.kids))


def dump(root: Node) -> bytes:
    return pickle.dumps([(depth, x.label, x.pages, x.texts) for depth, x in root.walk()], 5)


def load(data: bytes) -> Node:
    path: list[Node] = []
    for depth, *fields in pickle.loads(data):
        del path[depth:]
        node = Node(*fields)
        if path:
            path[-1].kids.append(node)
        path.append(node)
    return path[0]


def text_hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[3]).lower(): entities.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(raw)}


def _named(raw: str) -> tuple[str, bool, bool]:
    """(class for the label, whether class or id rule the element out, whether role or visibility do)."""
    if "=" not in raw and "hidden" not in raw:
        return "", False, False
    a = attributes(raw)
    kind = a.get("class", "")
    words = {w for name in f"{kind} {a.get('id', '')}".lower().split() if not STATE.fullmatch(name) for w in NAME.findall(name)}
    style = a.get("style", "").replace(" ", "").lower()
    out = a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in style
    return " ".join(sorted(kind.lower().split())), bool(words & NAMES), out


def parse(page: str | None) -> tuple[Node, list[tuple[Node, str, bool, bool, bool]]]:
    """The page's tree of slots, and its text blocks in order: (slot, text, ruled out, within an article, ruled out by names only)."""
    root = Node("")
    blocks: list[tuple[Node, str, bool, bool, tuple]] = []
    # tag, slot, ruled out, within an article, named elements around as [whether the name rules out]
    stack: list[tuple[str, Node, bool, bool, tuple]] = [("", root, False, False, ())]
    held: list[str] = []
    page = page or ""

    def flush():
        if held:
            text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text:
                _, slot, out, inside, names = stack[-1]
                blocks.append((slot, text, out, inside, names))
                slot.texts[text_hash(text)] = 1

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            cut = page.find("<", at)
            while cut >= 0 and not page[cut + 1 : cut + 2].isalpha() and page[cut + 1 : cut + 2] not in ("/", "!"):
                cut = page.find("<", cut + 1)
            held.append(page[at:] if cut < 0 else page[at:cut])  # an unfinished tag at the end is no text
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, raw = m[2].lower(), m[3]
        if m[1]:
            if tag in INLINE:
                if any(t == tag for t, *_ in stack[-2:]):  # an inline element that was ruled out by name
                    flush()
                    while stack[-1][0] != tag:
                        stack.pop()
                    stack.pop()
                continue
            if any(t == tag for t, *_ in stack):
                flush()
                while stack[-1][0] != tag:
                    stack.pop()
                stack.pop()
            elif tag == "p":
                flush()
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at) if tag else None
            at = close.end() if close else end
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr"):
                held.append(" " if tag == "br" else "")
            continue
        kind, named, out = _named(raw)
        if tag in INLINE and not (named or out):
            continue
        flush()
        if tag in ENDS_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    del stack[depth:]
                    break
                if stack[depth][0] in BARRIER:
                    break
        if tag in SELF_CLOSING:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in SELF_CLOSING[tag]:
                    del stack[depth:]
                    break
                if stack[depth][0] in BARRIER:
                    break
        _, parent, ruled, inside, names = stack[-1]
        out = ruled or (out and tag not in ("html", "body")) or tag in NEVER or (tag == "header" and not inside)
        content = tag in CONTENT or ("role" in raw and attributes(raw).get("role", "").lower() == "main")
        if tag in ("html", "body") or (content and not inside and not (tag == "article" and named and names)):
            for name in names:
                name[0] = False
        elif named:  # an article within an article may be a reader's comment
            names = (*names, [True])
        label = f"{tag}.{kind}" if kind else tag
        slot = next((k for k in parent.kids if k.label == label), None)
        if slot is None:
            slot = Node(label)
            parent.kids.append(slot)
        stack.append((tag, slot, out, inside or content, names))
    flush()
    by_name = [not out and any(n[0] for n in names) for _, _, out, _, names in blocks]
    return root, [(slot, text, out or b, inside, b) for (slot, text, out, inside, _), b in zip(blocks, by_name)]


def _best(a: list[Node], b: list[Node], found: dict) -> tuple[int, list[tuple[int, int]]]:
    """Size of the best order-keeping match of two child lists, whose own children's matches are `found`, and its pairs."""
    if [x.label for x in a] == [y.label for y in b]:
        return sum(1 + found[id(x), id(y)][0] for x, y in zip(a, b)), [(i, i) for i in range(len(a))]
    score = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best = max(score[i + 1][j], score[i][j + 1])
            if a[i].label == b[j].label:
                best = max(best, score[i + 1][j + 1] + 1 + found[id(a[i]), id(b[j])][0])
            score[i][j] = best
    pairs, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if score[i][j] == score[i + 1][j]:
            i += 1
        elif score[i][j] == score[i][j + 1]:
            j += 1
        else:
            pairs.append((i, j))
            i, j = i + 1, j + 1
    return score[0][0], pairs


def match(a: Node, b: Node) -> dict[tuple[int, int], tuple[int, list[tuple[int, int]]]]:
    """Simple tree matching of two trees: for each pair of slots, by id(), that could match: size and pairs of the best match of their children."""
    found: dict = {}
    stack = [(a, b, False)]
    while stack:
        x, y, ready = stack.pop()
        if ready:
            found[id(x), id(y)] = _best(x.kids, y.kids, found)
        elif (id(x), id(y)) not in found:
            if not x.kids or not y.kids:
                found[id(x), id(y)] = (0, [])
                continue
            stack.append((x, y, True))
            labels: dict[str, list[Node]] = {}
            for kid in y.kids:
                labels.setdefault(kid.label, []).append(kid)
            stack.extend((kid, other, False) for kid in x.kids for other in labels.get(kid.label, ()))
    return found


def merge(into: Node, other: Node) -> None:
    """Add `other`'s pages to `into`: matched slots are merged, the rest of `other` is inserted in its order."""
    found = match(into, other)
    stack = [(into, other)]
    while stack:
        x, y = stack.pop()
        x.pages += y.pages
        partner = {j: i for i, j in found[id(x), id(y)][1]}
        stack.extend((x.kids[i], y.kids[j]) for j, i in partner.items())
        kids, last, offset = list(x.kids), 0, 0
        for j, kid in enumerate(y.kids):
            if j in partner:
                last = partner[j] + offset + 1
            else:
                kids.insert(last, kid)
                last += 1
                offset += 1
        x.kids = kids


class Template:
    """A host's template: slots by number in the order of the tree, pages, and the (slot, text) pairs that repeat."""

    def __init__(self, tree: bytes, constant=()):
        self.root = load(tree)
        self.slots = [node for _, node in self.root.walk()]
        self.number = {id(node): i for i, node in enumerate(self.slots)}
        self.pages, self.constant = self.root.pages, set(constant)

    def align(self, page: Node) -> dict[int, int]:
        """The template's slot number of each of the page's slots, by id()."""
        found = match(page, self.root)
        out, stack = {}, [(page, self.root)]
        while stack:
            x, y = stack.pop()
            out[id(x)] = self.number[id(y)]
            stack.extend((x.kids[i], y.kids[j]) for i, j in found[id(x), id(y)][1])
        return out

    def texts(self, page: Node) -> list[tuple[int, int]]:
        """The (slot, text) pairs of a page."""
        slots = self.align(page)
        return [(slots[id(node)], h) for _, node in page.walk() if id(node) in slots for h in node.texts]


def extract(page: str | None, template: Template | None) -> str:
    root, blocks = parse(page)
    repeated = [False] * len(blocks)
    if template is not None and template.pages >= MIN_PAGES:
        slots = template.align(root)
        repeated = [(slots.get(id(slot), -1), text_hash(text)) in template.constant for slot, text, *_ in blocks]
        if template.pages < MIN_INSIDE:
            repeated = [r and not inside for r, (_, _, _, inside, _) in zip(repeated, blocks)]
    if all(out for _, _, out, _, _ in blocks):
        blocks = [(slot, text, not b, inside, b) for slot, text, _, inside, b in blocks]
    inside_only = any(inside and not out for _, _, out, inside, _ in blocks)
    kept = [(text, r) for (_, text, out, inside, _), r in zip(blocks, repeated) if not out and (inside or not inside_only)]
    if not inside_only or 2 * sum(len(t) for t, r in kept if r) < sum(len(t) for t, _ in kept):
        kept = [k for k in kept if not k[1]]
    return "\n".join(text for text, _ in kept)


def _trees(batches):
    """Pages as (host, page's hash, tree of slots)."""
    import pyarrow as pa
    import xxhash

    for b in batches:
        for s in range(0, b.num_rows, 512):
            part = b.slice(s, 512)
            pages = part.column("html").to_pylist()
            trees = [dump(parse(p)[0]) for p in pages]
            marks = [xxhash.xxh3_64_intdigest(t) - 2**63 for t in trees]
            yield pa.RecordBatch.from_arrays([part.column("host"), pa.array(marks, pa.int64()), pa.array(trees, pa.binary())], ["host", "mark", "tree"])


def _merge(batches):
    """Rows sorted by (host, part) to one partial template for each."""
    import pyarrow as pa

    at, template = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([dump(template)], pa.binary())], ["host", "mark", "tree"])

    for b in batches:
        for host, part, tree in zip(*(b.column(k).to_pylist() for k in ("host", "part", "tree"))):
            node = load(tree)
            for _, slot in node.walk():
                slot.texts = {}
            if (host, part) != at:
                if at is not None:
                    yield row()
                at, template = (host, part), node
            else:
                merge(template, node)
    if at is not None:
        yield row()


TEMPLATE = "host string, tree binary, constant array<struct<slot:long,text:long>>"


def _template(cell, known: dict, host: str) -> Template | None:
    """The host's template through a bounded memo; `cell`: (tree, constant) or None."""
    if host not in known:
        if len(known) > 500:
            known.clear()
        known[host] = Template(cell[0], [(c["slot"], c["text"]) for c in cell[1] or ()]) if cell and cell[0] is not None else None
    return known[host]


def _count(sent):
    """How many of a task's pages have each text in each slot of their host's template."""

    def run(batches):
        import pyarrow as pa

        known, times = {}, Counter()

        def rows():
            keys = list(times)
            columns = [pa.array([k[0] for k in keys]), *(pa.array([k[i] for k in keys], pa.int64()) for i in (1, 2)), pa.array([times[k] for k in keys], pa.int64())]
            times.clear()
            return pa.RecordBatch.from_arrays(columns, ["host", "slot", "text", "n"])

        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                for i, (host, page) in enumerate(zip(part.column("host").to_pylist(), part.column("page"))):
                    cell = sent.value.get(host) if sent else (part.column("tree")[i].as_py(), ())
                    template = _template(cell, known, host)
                    if template is not None and template.pages >= MIN_PAGES:
                        times.update((host, *c) for c in template.texts(load(page.as_py())))
                if len(times) > 200_000:
                    yield rows()
        if times:
            yield rows()

    return run


def _meet(pages: DataFrame, known: DataFrame, run, schema: str) -> DataFrame:
    """`run`(sent) over `pages` with the templates `known` of their hosts: broadcast, or joined and `sent` None."""
    total = known.agg(F.sum(F.octet_length("tree") + F.octet_length("host") + 16 * F.coalesce(F.size("constant"), F.lit(0)))).first()[0] or 0
    if total <= BROADCAST_BYTES:
        cells = {r.host: (bytes(r.tree), [{"slot": c.slot, "text": c.text} for c in r.constant or ()]) for r in known.toLocalIterator()}
        return pages.mapInArrow(run(pages.sparkSession.sparkContext.broadcast(cells)), schema)
    return pages.join(known, "host", "left").mapInArrow(run(None), schema)


def templates(pages: DataFrame) -> DataFrame:
    """(host, tree, constant): one template per `host` of pages (host, html), with the (slot, text) pairs that are constant on it."""
    common.ship(pages.sparkSession)
    trees = pages.select("host", "html").mapInArrow(_trees, "host string, mark long, tree binary")
    trees = common.materialise(trees.groupBy("host", "mark").agg(F.first("tree").alias("tree")), "trees")
    most = trees.groupBy("host").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    level, parts = trees, -(-most // GROUP) or 1
    while True:
        dealt = level.selectExpr("host", f"pmod(mark, {parts}L) as part", "mark", "tree").repartition("host", "part").sortWithinPartitions("host", "part", "mark")
        level = common.materialise(dealt.select("host", "part", "tree").mapInArrow(_merge, "host string, mark long, tree binary"), "templates")
        if parts == 1:
            break
        parts = -(-parts // GROUP)
    merged = level.select("host", "tree", F.expr("cast(null as array<struct<slot:long,text:long>>) as constant"))
    told = _meet(trees.select("host", F.col("tree").alias("page")), merged, _count, "host string, slot long, text long, n long")
    sizes = trees.groupBy("host").agg(F.count("*").alias("pages"))
    told = told.groupBy("host", "slot", "text").agg(F.sum("n").alias("n")).join(sizes, "host").where(F.col("n") >= SHARE * F.col("pages"))
    constant = told.groupBy("host").agg(F.collect_list(F.struct("slot", "text")).alias("constant"))
    out = common.materialise(merged.select("host", "tree").join(constant, "host", "left"), "templates")
    common.drop(trees)
    return out


def _extract(sent):
    def run(batches):
        import pyarrow as pa

        held: dict = {}
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                hosts, pages = part.column("host").to_pylist(), part.column("html").to_pylist()
                if sent is None:
                    cells = zip(part.column("tree").to_pylist(), part.column("constant").to_pylist())
                else:
                    cells = (sent.value.get(h) for h in hosts)
                out = [extract(page, _template(cell, held, host)) for host, page, cell in zip(hosts, pages, cells)]
                columns = [part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages` (page_id, url, html)."""
    common.ship(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.lower(F.regexp_extract("url", r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    keyed = pages.withColumn("host", F.coalesce(host, F.lit("")))
    return _meet(keyed, templates(keyed), _extract, "page_id long, url string, text string, n_chars long")
