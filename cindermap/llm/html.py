"""Main text of web pages by paths that the pages of a host agree on."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindermap.session import materialize

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset("head script style noscript template svg math canvas iframe object embed audio video title select option button textarea label input".split())
FRAME = frozenset("nav header footer aside menu dialog fieldset search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id and role names of what is around an article.
AROUND = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus dialog footer "
    "form gdpr header login masthead menu menubar modal nav navbar navigation navlinks newsletter notice notices notification overlay pager pagination popup "
    "promo promoted promotion recommended related remark remarks replies reply respond search share sharing shoutbox sidebar signup skip skyscraper social "
    "sponsor sponsored subscribe subscription supplemental toolbar widget alert contentinfo complementary discussion responses".split()
)
REMARKS = frozenset("comment comments remark remarks reply replies respond response responses".split())
_CLOSES_P = BLOCKS - {"br", "body", "html", "option", "optgroup", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
# Elements whose content reads on as one sentence or cell.
SENTENCES = HEADINGS | frozenset("p li td th dd dt blockquote figcaption caption pre".split())
DEPTH = 200  # elements nested deeper are read as part of the one at this depth
ROOT = "/"  # path of what stands in no element
PATH_CHARS = 2_000  # a longer path goes on as a digest
_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>\x00]*)|(!--)|[!?/])")
_STEP = re.compile(r"[>\"'<]")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z]+")
_VALUE_END = re.compile(r"=\s*[^\s\"'>]+/\Z")  # a slash that belongs to a value without quotes


class _Node:
    """An open element; ``kind`` says what its names tell, ``named`` holds it and the elements around it that have a kind."""

    __slots__ = ("tag", "path", "around", "kind", "named", "sentence")

    def __init__(self, tag: str, path: str, around: bool, kind: str = "", named: tuple[_Node, ...] = (), sentence: bool = False):
        self.tag, self.path, self.around, self.kind, self.sentence = tag, path, around, kind, sentence
        self.named = (*named, self) if kind else named


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMES.finditer(text)} if text and not text.isspace() else {}


class _Tags:
    """The tags of a page one after the other; each character is looked at a bounded number of times, whatever stands open."""

    def __init__(self, html: str):
        self.html, self.ended = html, {}  # ended: what has no end any more from here on

    def _find(self, what: str, at: int) -> int:
        if what in self.ended:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.ended[what] = True
        return found

    def after(self, place: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, name, attributes) of the next tag, comment or declaration; the last two have no name."""
        tag = _OPEN.search(self.html, place)
        if not tag:
            return None
        end = len(self.html)
        if tag[3]:
            found = self._find("-->", tag.end() - 2)
            return tag.start(), end if found < 0 else found + 3, False, "", ""
        if not tag[2]:
            found = self._find(">", tag.end())
            return tag.start(), end if found < 0 else found + 1, False, "", ""
        at = tag.end()
        while True:
            step = _STEP.search(self.html, at)
            if not step or step[0] == "<":
                # a tag that is not closed ends where the next one begins
                at = step.start() if step else end
                return tag.start(), at, bool(tag[1]), tag[2], self.html[tag.end() : at]
            if step[0] == ">":
                return tag.start(), step.end(), bool(tag[1]), tag[2], self.html[tag.end() : step.start()]
            closing = self._find(step[0], step.end())
            at = step.end() if closing < 0 else closing + 1


def _kind(tag: str, names: dict[str, str], in_article: bool, in_sentence: bool) -> str:
    """``hidden`` for what is never read, ``remark``, ``word`` and ``header`` for what its names (or, for a form, its tag) put around an article unless it holds the article,
    ``section`` for a section that its id alone puts there, which is often its title; else empty. No name hides a part of a sentence."""
    if tag in HIDDEN:
        return "hidden"
    if tag in FRAME and not (tag == "header" and in_article):
        return "hidden"
    if not names:
        return "word" if tag == "form" else ""
    if "hidden" in names or names.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", names.get("style", ""), re.I):
        return "hidden"
    if tag in ("html", "body", "header") or tag in HEADINGS:
        return ""
    kinds = REMARKS if tag in ("article", "main") else AROUND - {"header"} if in_article else AROUND
    words, by_id = ({w for n in which for w in _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", names.get(n, "")).lower())} & kinds for which in (("class", "role"), ("id",)))
    if not words and not by_id:
        return "word" if tag == "form" else ""
    if not REMARKS.isdisjoint(words | by_id):
        kind = "remark"
    elif words | by_id == {"header"}:
        kind = "header"
    elif words or tag != "section":
        kind = "word"
    else:
        kind = "" if in_article else "section"
    if kind and tag not in BLOCKS and "-" not in tag:
        return "" if in_sentence else "hidden"
    return kind


def _general(tag: str, names: dict[str, str]) -> str:
    """Tag and classes without their digits, which count pages and posts."""
    classes = sorted({re.sub(r"\d+", "", c) for c in names.get("class", "").split()} - {""})
    return ".".join([tag, *classes])


def _all_blocks(html: str) -> Iterator[tuple[tuple[_Node, ...], str, int]]:
    """(open elements, text, length of linked text) of every block of text in page order; what is hidden is left out."""
    stack: list[_Node] = [_Node("body", ROOT, False)]  # the page, which may have no body tag
    words: list[str] = []
    linked = depth_a = 0
    place, end = 0, len(html)
    tags, articles, drawings, held_back = _Tags(html), 0, 0, 0

    def close(at: int) -> None:
        nonlocal depth_a, articles, drawings
        for n in stack[at:]:
            depth_a -= n.tag == "a"
            articles -= n.tag in ("article", "main")
            drawings -= n.tag in ("svg", "math")
        del stack[at:]

    def flush():
        nonlocal words, linked
        text = " ".join("".join(words).split()) if words else ""
        out = (tuple(stack), text, min(linked, len(text))) if text else None
        words, linked = [], 0
        return out

    while place < end:
        tag = tags.after(place)
        start = tag[0] if tag else end
        if start > place and not stack[-1].around:
            piece = html[place:start]
            piece = unescape(piece) if "&" in piece else piece
            words.append(piece)
            if depth_a:
                linked += len(piece)
        if not tag:
            break
        _, place, closing, name, attributes = tag
        if not name:
            continue
        name = name.lower()
        if closing:
            if held_back and name not in VOID:
                held_back -= 1  # the end of an element that was nested too deep
                if name in BLOCKS and (found := flush()):
                    yield found
                continue
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name), 0)
            if at:
                if any(n.tag in BLOCKS or n.kind for n in stack[at:]) and (found := flush()):
                    yield found
                close(at)
            continue
        if name in BLOCKS:
            if found := flush():
                yield found
        if name in VOID:
            continue
        if attributes.endswith("/") and (name in ("svg", "math") or drawings) and not _VALUE_END.search(attributes[-1000:]):
            continue
        names = _attributes(attributes)
        # an element that cannot hold this one ends
        closes = ()
        if name in _CLOSES_P:
            closes = ("p",) + (("li",) if name == "li" else ("dt", "dd") if name in ("dt", "dd") else ())
        elif name in ("td", "th", "tr", "option"):
            closes = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}[name]
        for i in range(len(stack) - 1, 0, -1):
            open_tag = stack[i].tag
            if open_tag in closes:
                close(i)
                if open_tag == "p" and len(closes) > 1:
                    continue
                break
            if open_tag in BLOCKS and open_tag not in ("p",):
                break
        if len(stack) > DEPTH and name not in RAW:
            held_back += 1
            continue
        parent = stack[-1]
        sentence = parent.sentence if name not in BLOCKS else name in SENTENCES
        kind = "hidden" if parent.around else _kind(name, names, articles > 0, parent.sentence)
        if kind not in ("", "hidden") and name not in BLOCKS and (found := flush()):
            yield found
        path = parent.path
        if name in BLOCKS:
            path = f"{'' if parent is stack[0] else path}>{_general(name, names)}"
            if len(path) > PATH_CHARS:
                path = "#" + md5(path.encode("utf-8", "surrogatepass")).hexdigest()
        stack.append(_Node(name, path, True) if kind == "hidden" else _Node(name, path, False, kind, parent.named, sentence))
        depth_a += name == "a"
        articles += name in ("article", "main")
        drawings += name in ("svg", "math")
        if name in RAW:
            ending = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, place)
            place = ending.end() if ending else end
            close(len(stack) - 1)
    if found := flush():
        yield found


def blocks_of(html: str) -> list[tuple[tuple[_Node, ...], str, int]]:
    """The blocks of a page without those around its article.

    Names decide only for elements that hold neither a main element nor the longest article of the page, nor more than half of the
    text without links (of the whole page if it has no article or main element, else only inside these). What is named after remarks, or is only called a header, holds the article
    if it has a first-order heading, the latter where the page has no other one. Sections that only an id names are left to ``text_at``.
    """
    blocks = list(_all_blocks(html))
    if not any(nodes[-1].named for nodes, _, _ in blocks):
        return blocks
    worth: dict[int, int] = {}
    first_order: set[int] = set()
    mains: set[int] = set()
    articles: dict[int, int] = {}
    total = 0
    for nodes, text, linked in blocks:
        size = len(text) - linked
        remark = any(n.kind == "remark" for n in nodes[-1].named)
        total += 0 if remark else size
        for n in nodes:
            if n.kind:
                worth[id(n)] = worth.get(id(n), 0) + size
                if any(x.tag == "h1" for x in nodes):
                    first_order.add(id(n))
            elif n.tag == "main":
                mains.add(id(n))
            elif n.tag == "article" and not remark:
                articles[id(n)] = articles.get(id(n), 0) + size
    if articles:
        mains.add(max(articles, key=articles.__getitem__))
    holds = {id(n) for nodes, _, _ in blocks for i, n in enumerate(nodes) if n.kind and any(id(x) in mains for x in nodes[i + 1 :])}
    inside = {id(n) for nodes, _, _ in blocks for i, n in enumerate(nodes) if n.kind and any(id(x) in mains for x in nodes[:i])}
    # the only first-order headings of a page are its title, even in a box that is called a header
    titled = any(x.tag == "h1" for nodes, _, _ in blocks if not nodes[-1].named for x in nodes)
    for n in {id(n): n for nodes, _, _ in blocks for n in nodes[-1].named}.values():
        if n.kind == "remark" or (n.kind == "header" and not titled):
            kept = id(n) in holds or id(n) in first_order
        else:
            kept = id(n) in holds or (2 * worth[id(n)] > total and (not mains or id(n) in inside))
        n.around = not kept and n.kind != "section"
        n.kind = "" if kept else n.kind
    return [block for block in blocks if not any(n.around for n in block[0][-1].named)]


def _holders(open_nodes: tuple[_Node, ...]) -> list[_Node]:
    return [n for n in open_nodes if n.tag in BLOCKS and n.tag not in ("p", "br", "html") and n.tag not in HEADINGS and n.tag not in ("li", "td", "th", "tr", "dd", "dt")]


def _best(blocks: list[tuple[tuple[_Node, ...], str, int]]) -> tuple[float, _Node, list[_Node]] | None:
    scores: dict[int, list] = {}
    for open_nodes, text, linked in blocks:
        if any(n.kind == "section" for n in open_nodes[-1].named):
            continue
        share = float(len(text) - linked)
        holders = _holders(open_nodes)
        for i in range(len(holders) - 1, -1, -1):
            node = holders[i]
            held = scores.get(id(node))
            if held is None:
                held = scores[id(node)] = [0.0, node, holders[:i]]
            held[0] += share * (2.0 if node.tag in ("article", "main") else 1.0)
            share /= 2
    return max(scores.values(), key=lambda s: s[0]) if scores else None


def best_path(blocks: list[tuple[tuple[_Node, ...], str, int]]) -> tuple[str, float, list[tuple[str, str | None, bool]]] | None:
    """The container of a page with the best score, as a general path, its score, and what the containers around it add.

    Every block of text gives its length without links to the nearest container, and half as much to each one around the one before, so that the
    element right around the paragraphs comes out ahead of the page. Article and main elements count twice. For each container
    from the best one outwards, up to an article or main element or else the body: (general path, digest of the text that it adds or
    None, whether it adds a first-order heading). A block counts as added if less than half of it is linked.
    """
    best = _best(blocks)
    if not best:
        return None
    score, node, outer = best
    levels: list[tuple[str, str | None, bool]] = []
    # each block belongs to the nearest container of the chain that holds it
    place = {id(n): k for k, n in enumerate([*outer, node])}
    of: dict[int, list[tuple[tuple[_Node, ...], str, int]]] = {}
    for block in blocks:
        of.setdefault(next((place[id(n)] for n in reversed(block[0]) if id(n) in place), -1), []).append(block)
    inner, headed = node, any(n.tag == "h1" for nodes, _, _ in of.get(len(outer), ()) for n in nodes)
    for k in range(len(outer) - 1, -1, -1):
        up = outer[k]
        if inner.tag in ("article", "main", "body"):
            break
        added = [(nodes, text) for nodes, text, linked in of.get(k, ()) if 2 * linked < len(text) and not any(n.kind == "section" for n in nodes[-1].named)]
        heading = any(n.tag == "h1" for nodes, _ in added for n in nodes)
        if up.tag == "body" and (headed or not heading):
            break
        levels.append((up.path, md5("\n".join(text for _, text in added).encode("utf-8", "surrogatepass")).hexdigest() if added else None, heading))
        inner, headed = up, headed or heading
    return node.path, score, levels


def _climbed(found: tuple[str, float, list[tuple[str, str | None, bool]]]) -> str:
    """The path of a page that stands alone: the outermost container that adds text."""
    return next((path for path, digest, _ in reversed(found[2]) if digest), found[0])


def text_at(blocks: list[tuple[tuple[_Node, ...], str, int]], path: str | None) -> str:
    """The blocks below elements of a general path, one on a line; a section that its id alone puts around the article is read inside such an element, but the body."""
    texts = []
    for open_nodes, text, _ in blocks:
        at = next((i for i, n in enumerate(open_nodes) if n.path == path), -1)
        if at >= 0 and not any(n.kind == "section" and (open_nodes[at].tag == "body" or n in open_nodes[:at]) for n in open_nodes[-1].named):
            texts.append(text)
    return "\n".join(texts)


def host_of(url: str | Column) -> Column:
    """Host of an address in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def vote(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path): the path on which the most pages of a host agree, each page with its best container.

    Votes are counted per host and path before they are compared; ties go to the higher sum of scores, then the smaller path. From the
    path that wins, the host climbs to the containers around it as long as what they add belongs to the article: it has a first-order heading,
    or it is not the same on all pages that voted for the path, or these pages are all the same.
    """

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [blocks_of(h.as_py() or "") for h in batch.column(1)]
            found = [best_path(blocks) for blocks in read]
            body = [f and md5(text_at(blocks, f[0]).encode("utf-8", "surrogatepass")).hexdigest() for f, blocks in zip(found, read)]
            levels = [f and [{"path": p, "added": d, "heading": h} for p, d, h in f[2]] for f in found]
            yield pa.RecordBatch.from_pydict(
                {
                    "host": batch.column(0),
                    "path": pa.array([f and f[0] for f in found], pa.string()),
                    "score": pa.array([f and int(f[1]) for f in found], pa.int64()),
                    "body": pa.array(body, pa.string()),
                    "levels": pa.array(levels, pa.list_(pa.struct([("path", pa.string()), ("added", pa.string()), ("heading", pa.bool_())]))),
                }
            )

    kinds = "host string, path string, score long, body string, levels array<struct<path string, added string, heading boolean>>"
    named = materialize(pages.select(host_of(url).alias("host"), F.col(html).alias("html")).mapInArrow(candidates, kinds).filter(F.col("path").isNotNull()), "candidates")
    counted = named.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"), (F.min("body") == F.max("body")).alias("alike")
    )
    won = counted.groupBy("host").agg(F.min_by(F.struct("path", "alike"), F.struct(-F.col("votes"), -F.col("score"), "path")).alias("won")).select("host", "won.path", "won.alike")
    added = named.select("host", "path", F.posexplode("levels").alias("at", "level")).groupBy("host", "path", "at").agg(
        F.min("level.path").alias("up"), F.min("level.added").alias("low"), F.max("level.added").alias("high"), F.max("level.heading").alias("heading")
    )
    # a path has as many levels as it has elements
    steps = added.groupBy("host", "path").agg(F.collect_list(F.struct("at", "up", "low", "high", "heading")).alias("steps"))
    steps = steps.select(F.col("host").alias("h"), F.col("path").alias("p"), "steps")
    joined = won.join(steps, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    adds = F.filter("steps", lambda s: s["low"].isNotNull())
    ours = lambda s: F.col("alike") | s["heading"] | (s["low"] != s["high"])
    end = F.array_min(F.transform(F.filter(adds, lambda s: ~ours(s)), lambda s: s["at"]))
    up = F.array_max(F.filter(adds, lambda s: ours(s) & (end.isNull() | (s["at"] < end))))
    return joined.select("host", F.coalesce(up["up"], F.col("path")).alias("path"))


def extract(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url"), url: str = "url", html: str = "html") -> DataFrame:
    """``carry`` columns, text and n_chars (code points) of every page.

    First each page scores its containers, and the pages of a host vote on the general path (tags and classes without
    digits) of the best one; then every page is read again at its host's path. A page that has nothing there is read at its own
    best container. Elements around an article (menus, headers, footers, forms, notices, adverts, comments) are left out wherever
    they stand, unless they hold the article itself (see ``blocks_of``); headings and the header of an article stay whatever their names. Character references are decoded, white space in a block is one space, blocks follow each other on lines.

    A null, empty or textless page has the empty text; a page without host votes with the others that have none. Whole pages
    are read, cut-off ones to their end. Votes are rows per host and path; pages are not regrouped, and a host with any part of the
    pages is split by AQE or met by a broadcast, as its table's size allows. Repeated rows each count and each return.
    """
    paths = materialize(vote(pages, url, html), "paths").select(F.col("host").alias("__h"), F.col("path").alias("__path"))
    marked = pages.select(*carry, host_of(url).alias("__host"), F.col(html).alias("__html"))
    joined = marked.join(paths, F.col("__host") == F.col("__h"), "left").select(*carry, "__path", "__html")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema[:-2])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for path, page in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1)):
                blocks = blocks_of(page.as_py() or "")
                text = text_at(blocks, path) if path is not None else ""
                if not text and (own := best_path(blocks)):
                    text = text_at(blocks, _climbed(own))
                texts.append(text)
            out = {name: batch.column(i) for i, name in enumerate(batch.schema.names[:-2])}
            yield pa.RecordBatch.from_pydict(out | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return joined.mapInArrow(read, f"{kinds}, text string, n_chars long")
