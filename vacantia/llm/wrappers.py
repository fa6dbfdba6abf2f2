"""Main text of web pages by wrapper induction over the pages of a host."""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.shared import written
from vacantia.operators.lookup import lookup

# Elements that start a block, that are never content, and that hold raw text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p "
    "pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("head nav aside footer form menu dialog fieldset".split())
_RAW = "script|style|noscript|template|textarea|title|iframe|svg|select|button|object|canvas|math"
# Which open elements a new element closes.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
    "body": {"head"},
}
_SCOPE = frozenset("ul ol menu dl table div article section body".split())
_VOID = frozenset(["hr"])
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Odd multipliers: each puts 64-bit hashes in another order.
_ORDERS = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_CONTAINERS = frozenset("html body div section center table tbody tr td".split())
# Words in class, id or role that mark what is not the article.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|adslot|adbox|sponsor|sponsored|promo|promos|"
    r"promotion|banner|cookie|cookies|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|"
    r"subscribe|subscription|signup|sidebar|sidebars|side|rail|menu|menus|nav|navbar|navigation|breadcrumb|breadcrumbs|"
    r"footer|footers|comment|comments|commentlist|discussion|disqus|replies|responses|share|sharing|social|related|"
    r"recommended|widget|widgets|toolbar|pagination|pager|login|search|skip|masthead|topbar|"
    r"complementary|contentinfo|alertdialog)(?:$|[\s_-])"
)
_PAGE_HEADER = re.compile(r"(?:^|[\s_-])(?:header|site|branding|logo)(?:$|[\s_-])")

_PARTS = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:{_RAW})\b[^>]*/>|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<[!?][^>]*>|</?[a-z][^>]*>",
    re.I | re.S,
)
# Numbers in ids, and long ones in classes, count the page or the item, not the kind of element.
_DIGITS, _SERIAL = re.compile(r"\d+"), re.compile(r"\d{3,}")
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def parse(page: str) -> tuple[list[tuple[int, str, str]], list[tuple[int, str]]]:
    """The page's skeleton and its text blocks.

    The skeleton is a tree of block elements in page order: ``(parent, tag, marks)``, marks being class,
    id and role in lower case without serial numbers. Siblings of one kind are one node, as the items
    of a list or the paragraphs of an article differ only in content. A block is ``(node, text)`` with
    character references decoded and white space made single; inline markup belongs to its
    block. Unclosed, stray and misnested tags are taken as browsers do, more or less; nothing raises.
    """
    nodes: list[tuple[int, str, str]] = [(-1, "html", "")]
    children: list[dict[tuple[str, str], int]] = [{}]
    stack: list[tuple[str, int]] = [("html", 0)]
    opened: Counter[str] = Counter()
    blocks: list[tuple[int, str]] = []
    texts: list[str] = []

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop()[0]] -= 1

    def flush() -> None:
        if texts:
            text = "".join(texts)
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                blocks.append((stack[-1][1], text))
            texts.clear()

    at = 0
    for part in _PARTS.finditer(page):
        if part.start() > at:
            texts.append(page[at:part.start()])
        at = part.end()
        tag = part.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            texts.append(" ")
            continue
        if tag not in BLOCKS:
            continue
        flush()
        if part.group(2):
            if opened[tag]:
                while stack[-1][0] != tag:
                    close_to(len(stack) - 1)
                close_to(len(stack) - 1)
            continue
        closes = CLOSES.get(tag)
        if len(stack) > 1 and stack[-1][0] == "p":
            close_to(len(stack) - 1)
        if closes and any(opened[t] for t in closes):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in closes:
                    close_to(depth)
                    break
                if stack[depth][0] in _SCOPE:
                    break
        if tag == "html":
            continue
        attributes = part.group(4)
        marks = ""
        if attributes and "=" in attributes:
            marks = " ".join(
                (_SERIAL if name.lower() == "class" else _DIGITS).sub("", a or b or c).lower()
                for name, a, b, c in _MARKS.findall(attributes)
            ).strip()
        parent = stack[-1][1]
        node = children[parent].get((tag, marks))
        if node is None:
            node = children[parent][tag, marks] = len(nodes)
            nodes.append((parent, tag, marks))
            children.append({})
        if tag not in _VOID:
            stack.append((tag, node))
            opened[tag] += 1
    if at < len(page):
        texts.append(page[at:])
    flush()
    return nodes, blocks


def _below(nodes: list) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in nodes]
    for i, (parent, _, _) in enumerate(nodes):
        if parent >= 0:
            out[parent].append(i)
    return out


def tree_match(left: list, right: list) -> dict[int, int]:
    """Simple tree matching of two skeletons: node of ``left`` → node of ``right``.

    The heaviest set of pairs that keeps parents and the order of siblings; equal tags may pair, and
    equal marks count double. Equal subtrees at the ends of two lists of siblings belong to a heaviest
    set, so they are paired without a table: the work is that of the places where the trees differ,
    quadratic only in the unlike children of two paired nodes, and depth alone costs nothing.
    """
    below = _below(left), _below(right)
    numbers: dict[tuple, int] = {}
    shapes: tuple[list[int], list[int]] = ([0] * len(left), [0] * len(right))
    sizes = [1] * len(left)
    # Children come after their parents, so a pass from the end meets them first.
    for nodes, kids, shape in zip((left, right), below, shapes):
        for i in range(len(nodes) - 1, -1, -1):
            key = (nodes[i][1], nodes[i][2], tuple(shape[k] for k in kids[i]))
            shape[i] = numbers.setdefault(key, len(numbers))
    for i in range(len(left) - 1, 0, -1):
        sizes[left[i][0]] += sizes[i]

    def unlike(a: int, b: int) -> tuple[list[tuple[int, int]], list[int], list[int]]:
        """The equal pairs at both ends of the children, and the children between them."""
        xs, ys = below[0][a], below[1][b]
        low, high = 0, min(len(xs), len(ys))
        while low < high and shapes[0][xs[low]] == shapes[1][ys[low]]:
            low += 1
        tail = 0
        while tail < high - low and shapes[0][xs[-1 - tail]] == shapes[1][ys[-1 - tail]]:
            tail += 1
        ends = list(zip(xs[:low], ys[:low])) + [(xs[-1 - i], ys[-1 - i]) for i in range(tail)]
        return ends, xs[low:len(xs) - tail], ys[low:len(ys) - tail]

    def weight(a: int, b: int) -> int:
        if shapes[0][a] == shapes[1][b]:
            return 2 * sizes[a]
        return weights.get((a, b), 0)

    def table(xs: list[int], ys: list[int]) -> list[list[int]]:
        best = [[0] * (len(ys) + 1)]
        for x in xs:
            row, above = [0], best[-1]
            for j, y in enumerate(ys):
                row.append(max(above[j + 1], row[j], above[j] + weight(x, y)))
            best.append(row)
        return best

    # Only nodes with paired parents can pair: they are met from the roots down, weighed from the leaves up.
    met = [(0, 0)]
    weights: dict[tuple[int, int], int] = {(0, 0): 0}
    for a, b in met:
        if shapes[0][a] == shapes[1][b]:
            continue
        _, xs, ys = unlike(a, b)
        for x in xs:
            for y in ys:
                if left[x][1] == right[y][1]:
                    weights[x, y] = 0
                    met.append((x, y))
    for a, b in reversed(met):
        ends, xs, ys = unlike(a, b)
        inner = table(xs, ys)[-1][-1] if xs and ys else 0
        weights[a, b] = 1 + (left[a][2] == right[b][2]) + 2 * sum(sizes[x] for x, _ in ends) + inner
    matched: dict[int, int] = {}
    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        matched[a] = b
        ends, xs, ys = unlike(a, b)
        todo.extend(ends)
        if not (xs and ys):
            continue
        best = table(xs, ys)
        i, j = len(xs), len(ys)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((xs[i], ys[j]))
    return matched


def slots(skeleton: list, wrapper: list) -> list[str]:
    """A name for every node: its place in the host's wrapper, or a digest of its own path where it has none."""
    import xxhash

    matched = tree_match(skeleton, wrapper)
    names: list[str] = []
    for i, (parent, tag, marks) in enumerate(skeleton):
        path = f"{names[parent] if parent >= 0 else ''}/{tag}.{marks}"
        names.append(str(matched[i]) if i in matched else "/" + xxhash.xxh128_hexdigest(path.encode("utf-8", "surrogatepass")))
    return names


def content_nodes(skeleton: list, template: set[int], mass: list[int] | None = None) -> list[int]:
    """The nodes whose text is the article.

    What the template holds is never content, inside an article element or outside. Of the
    varying nodes, navigation, headers, footers, sidebars, forms and what its marks call an advert, notice or
    comment go, with all below: these vary from page to page, so no template can show them. Where
    an article or main element has varying nodes, they are the content. Else the content is the region
    with the most varying text (``mass``, a number of characters per node, summed over the host's pages):
    from the root down, the child that holds more than half of its parent's, as long as it is a plain
    container and no heading stands beside it. Where nothing varies, the template is all there is,
    and the unbanned nodes (those of the article, if there is one) stay.
    """
    banned, inside = [], []
    for parent, tag, marks in skeleton:
        above = parent >= 0
        within = (above and inside[parent]) or tag in ("article", "main") or re.search(r"\bmain\b", marks) is not None
        noise = tag in NEVER or bool(NOISE.search(marks))
        if not (above and inside[parent]):
            noise = noise or tag == "header" or bool(_PAGE_HEADER.search(marks))
        if tag in ("body", "html"):
            noise = False
        inside.append(within)
        banned.append((above and banned[parent]) or noise)
    free = [i for i, b in enumerate(banned) if not b]
    core = [i for i in free if inside[i]]
    varying = [i for i in core or free if i not in template]
    weights = [0] * len(skeleton)
    for i in varying:
        weights[i] = 1 if mass is None else mass[i]
    if not any(weights):
        return core or free
    if core:
        return varying
    for i in range(len(skeleton) - 1, 0, -1):
        weights[skeleton[i][0]] += weights[i]
    below = _below(skeleton)
    at = 0
    while below[at] and not any(skeleton[k][1] in _HEADINGS and weights[k] for k in below[at]):
        heaviest = max(below[at], key=lambda k: (weights[k], -k))
        if skeleton[heaviest][1] not in _CONTAINERS or 2 * weights[heaviest] <= weights[at]:
            break
        at = heaviest
    within = {at}
    for i, (parent, _, _) in enumerate(skeleton):
        if parent in within:
            within.add(i)
    return [i for i in varying if i in within]


def likeness(texts: list[str], words: int = 5) -> list[int]:
    """Three least hashes, under independent orders, of the runs of five words (of all words, if fewer).

    Copies of a page share all three; near copies share each one with the probability of their similarity.
    """
    import numpy as np
    import xxhash

    found = " ".join(texts).split()
    runs = np.array([
        xxhash.xxh64_intdigest(" ".join(found[i:i + words]).encode("utf-8", "surrogatepass"))
        for i in range(max(1, len(found) - words + 1))
    ], dtype=np.uint64)
    orders = np.array(_ORDERS, dtype=np.uint64)
    return [int((runs * order).min()) - (1 << 63) for order in orders]


def extract(pages: DataFrame, least_pages: int = 3, common: float = 0.5, few: float = 0.2) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page; the whole html is read.

    1. Pages are parsed into skeletons and blocks. Of a host's pages that are alike one counts, so
       that copies of an article are no evidence that it is template: one page stays for each first
       hash of :func:`likeness`, of these one for each second and third. The most frequent skeleton of
       those left is the host's wrapper.
    2. Each of a host's distinct skeletons is aligned with the wrapper by simple tree matching, which
       gives the nodes of all its pages common names (slots).
    3. A slot is template if one text fills it on ``least_pages`` unlike pages or more and on ``common`` of those
       that have it, or if all its texts are at most ``few`` of them; else it varies, and the text that
       it holds on all of them is its mass. With fewer unlike pages than that nothing is known
       to be constant, and structure and mass decide.
    4. Content nodes are decided per skeleton (:func:`content_nodes`) and applied to its pages.

    Counts are combined before they are shuffled; skeletons, not pages, are aligned; the joins
    by host and by skeleton split the keys that are found to be hot. NULL or empty html gives an
    empty text; pages without a host in their url are taken as one host. Repeated rows and ids are
    kept; columns other than ``page_id``, ``url`` and ``html`` are left out.
    """
    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            for at in range(0, len(batch), 500):
                out = []
                part = batch.iloc[at:at + 500]
                for page_id, url, host, page in zip(part["page_id"], part["url"], part["host"], part["html"]):
                    skeleton, blocks = parse(page or "")
                    by_node: dict[int, list[str]] = {}
                    for node, text in blocks:
                        by_node.setdefault(node, []).append(text)
                    out.append((
                        page_id, url, host, json.dumps(skeleton), likeness([t for _, t in blocks]),
                        [n for n, _ in blocks], [t for _, t in blocks],
                        list(by_node), [
                            xxhash.xxh64_intdigest("\n".join(t).encode("utf-8", "surrogatepass")) - (1 << 63)
                            for t in by_node.values()
                        ], [sum(map(len, t)) for t in by_node.values()],
                    ))
                yield pd.DataFrame(out, columns=[
                    "page_id", "url", "host", "skeleton", "like", "nodes", "texts", "filled", "hashes", "sizes"])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    read = written(
        # NULL ids would become floats in pandas, so ids travel as text.
        pages.select(F.col("page_id").cast("string"), "url", host.alias("host"), "html").mapInPandas(
            parsed,
            "page_id string, url string, host string, skeleton string, like array<long>, nodes array<int>, texts array<string>, "
            "filled array<int>, hashes array<long>, sizes array<long>",
        ).withColumn("kind", F.xxhash64("skeleton")),
        "parsed",
    )
    kinds = written(
        read.groupBy("host", "kind").agg(F.count(F.lit(1)).alias("pages"), F.min("skeleton").alias("skeleton")),
        "skeletons",
    )
    unlike = read.select("host", "like", "kind", "filled", "hashes", "sizes")
    for order in range(len(_ORDERS)):
        page = F.min(F.struct("like", "kind", "filled", "hashes", "sizes")).alias("page")
        unlike = unlike.groupBy("host", F.col("like")[order].alias("one")).agg(page).select("host", "page.*")
    unlike = written(unlike, "unlike")
    wrappers = (
        unlike.groupBy("host", "kind").agg(F.count(F.lit(1)).alias("pages"))
        .groupBy("host").agg(F.max(F.struct("pages", "kind")).alias("w"))
        .select("host", F.col("w.kind").alias("kind"))
        .join(kinds.select("host", "kind", F.col("skeleton").alias("wrapper")), ["host", "kind"]).drop("kind")
    )

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "host": batch["host"], "kind": batch["kind"],
                "slots": [slots(json.loads(s), json.loads(w)) for s, w in zip(batch["skeleton"], batch["wrapper"])],
            })

    named = written(
        lookup(kinds, wrappers, "host", "inner", spread_by="kind").select("host", "kind", "skeleton", "wrapper")
        .mapInPandas(aligned, "host string, kind long, slots array<string>"),
        "slots",
    )
    # Texts are counted per skeleton first: few rows are left to be named and counted per slot.
    texts = (
        unlike.select("host", "kind", F.explode(F.arrays_zip("filled", "hashes", "sizes")).alias("x"))
        .groupBy("host", "kind", F.col("x.filled").alias("node"), F.col("x.hashes").alias("hash"))
        .agg(F.count(F.lit(1)).alias("pages"), F.sum("x.sizes").alias("mass"))
    )
    counted = (
        lookup(texts, named, ["host", "kind"], "inner", spread_by=["node", "hash"])
        .groupBy("host", F.expr("slots[node]").alias("slot"), "hash")
        .agg(F.sum("pages").alias("pages"), F.sum("mass").alias("mass"))
        .groupBy("host", "slot").agg(
            F.sum("pages").alias("pages"), F.max("pages").alias("top"), F.count(F.lit(1)).alias("texts"),
            F.sum("mass").alias("mass"))
    )
    fixed = (
        ((F.col("top") >= least_pages) & (F.col("top") >= common * F.col("pages")))
        | (F.col("texts") <= few * F.col("pages"))
    )
    known = (
        named.select("host", "kind", F.posexplode("slots").alias("node", "slot"))
        .join(counted.select("host", "slot", fixed.alias("fixed"), "mass"), ["host", "slot"])
        .groupBy("host", "kind").agg(F.collect_list(F.struct("node", "fixed", "mass")).alias("known"))
    )

    def decided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = []
            for text, known in zip(batch["skeleton"], batch["known"]):
                skeleton = json.loads(text)
                mass, template = [0] * len(skeleton), set()
                for slot in [] if known is None else known:
                    mass[slot["node"]] = int(slot["mass"])
                    if slot["fixed"]:
                        template.add(slot["node"])
                kept.append(content_nodes(skeleton, template, mass))
            yield pd.DataFrame({"host": batch["host"], "kind": batch["kind"], "kept": kept})

    content = written(
        kinds.join(known, ["host", "kind"], "left").select("host", "kind", "skeleton", "known")
        .mapInPandas(decided, "host string, kind long, kept array<int>"),
        "content",
    )
    chosen = F.expr("array_join(filter(texts, (t, i) -> array_contains(kept, nodes[i])), '\\n')")
    rows = read.select("page_id", "url", "host", "kind", "nodes", "texts").withColumn("row", F.monotonically_increasing_id())
    return (
        lookup(rows, content, ["host", "kind"], "inner", spread_by="row")
        .select(F.col("page_id").cast("long").alias("page_id"), "url", chosen.alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
