"""Main text of web pages by consensus of their hosts.

Each page's containers are scored, the scores are summed in Spark by host and generalised path (tags and classes from
the root, digits masked), and each host's winning paths decide what is extracted from its pages: the best one, and its
siblings of the same tag that hold a good share of text. A page without those paths falls back on its own best container.

Names are a weak sign of what is not main text. An element all of whose names say so is left out. Where only some do, the
host's pages vote: an element whose text repeats from page to page goes, one whose text varies stays.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmnet.storage import materialize

# Elements of HTML by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title select option button svg iframe object canvas head".split())
NO_MARKUP = frozenset("script style textarea title iframe noscript".split())
CONTAINERS = frozenset("html body main article section div td table aside nav header footer form ul ol dl fieldset figure dialog center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr th caption blockquote pre address figcaption details summary hr br".split())
BOILERPLATE = frozenset("nav aside footer form dialog menu".split())
ENDS_PARAGRAPH = BLOCKS - {"br", "td", "th", "tr", "caption"}
BOILERPLATE_NAMES = re.compile(
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|cookies?|consent|"
    r"notices?|popup|modal|newsletter|subscribe|subscription|social|share|sharing|related|comments?|commentlist|disqus|respond|reply|replies|"
    r"widgets?|pagination|pager|toolbar|login|search)")
WEIGHT = {"article": 1.5, "main": 1.4, "body": 0.9, "html": 0.8}
KEPT_ABOVE = 0.8  # of a container's score, that its parent gets
SIBLING = 0.2  # of the best container's score, that a sibling of the same tag needs on average
REPEATED = (3, 0.5)  # pages at least, and share of different texts at most, of an element that repeats
LEAST_VOTE = 1e-6

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[^a-z0-9]+")


class Paths:
    """Generalised paths of a page by number: a path is its parent's number and its last label."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, str], int] = {}
        self.last: list[tuple[int, str]] = [(-1, "")]

    def below(self, parent: int, label: str) -> int:
        key = (parent, label)
        n = self.numbers.get(key)
        if n is None:
            n = self.numbers[key] = len(self.last)
            self.last.append(key)
        return n

    def written(self, number: int) -> str:
        out = []
        while number > 0:
            number, label = self.last[number]
            out.append(label)
        return "".join(f"/{label}" for label in reversed(out))

    def find(self, path: str) -> int | None:
        """Number of a written path, where the page has it."""
        number: int | None = 0
        for label in path.split("/")[1:]:
            number = self.numbers.get((number, label))
            if number is None:
                return None
        return number


class Node:
    __slots__ = ("tag", "path", "hard", "named", "weak", "box", "above", "link")

    def __init__(self, tag: str, path: int, parent: Node | None):
        self.tag, self.path = tag, path
        self.hard = parent.hard if parent else False  # never main text, nor is anything below
        self.named = parent.named if parent else False  # inside an element all of whose names say it is not main text
        self.weak: Node | None = parent.weak if parent else None  # outermost element around that some names speak against
        self.link = parent.link if parent else False
        self.box: Node = self  # nearest container
        self.above: Node | None = parent.box if parent else None  # the container around that


class Page:
    """Blocks of a page in order: (node, text, how many of its characters stand in links)."""

    def __init__(self, html: str):
        self.paths, self.blocks, self.boxes = Paths(), [], []
        self._read(html)
        if not any(self.shown(n) for n, _, _ in self.blocks):  # then names decide nothing
            for n in {b[0] for b in self.blocks}:
                n.named = False

    @staticmethod
    def shown(node: Node, repeated: frozenset[int] | set[int] = frozenset()) -> bool:
        return not node.named and not (node.weak is not None and node.weak.path in repeated)

    def _opened(self, tag: str, attributes: str, parent: Node, inside: bool) -> Node:
        names = {k.lower(): (a or b or c).lower() for k, a, b, c in _NAMES.findall(attributes)} if attributes else {}
        kind = ".".join(sorted(set(_DIGITS.sub("#", names.get("class", "")).replace("/", "|").split())))
        node = Node(tag, self.paths.below(parent.path, f"{tag}.{kind}" if kind else tag), parent)
        if tag in CONTAINERS:
            self.boxes.append(node)
        else:
            node.box, node.above = parent.box, None
        node.link = node.link or tag == "a"
        if tag in BOILERPLATE or (tag == "header" and not inside) or tag in RAW or (
                ("hid" in attributes.lower() or "none" in attributes.lower()) and bool(_HIDDEN.search(attributes))):
            node.hard = True
        elif names and tag not in ("html", "body", "article", "main"):
            words = [w for v in names.values() for w in _PARTS.split(v) if w]
            against = sum(bool(BOILERPLATE_NAMES.fullmatch(w)) for w in words)
            if against and against == len(words):
                node.named = True
            elif against and node.weak is None:
                node.weak = node
        return node

    def _read(self, html: str) -> None:
        root = Node("#", 0, None)
        self.boxes.append(root)
        stack, opened, text, linked = [root], Counter(), [], 0

        def flush() -> None:
            nonlocal linked
            if text:
                line = " ".join(unescape("".join(text)).split())
                if line:
                    self.blocks.append((stack[-1], line, min(linked, len(line))))
                text.clear()
            linked = 0

        def close_to(depth: int) -> None:
            for n in stack[depth:]:
                opened[n.tag] -= 1
            del stack[depth:]

        def close_nearest(tags: tuple[str, ...], stops: frozenset[str]) -> None:
            """Close the nearest open element of these tags, unless one of ``stops`` is nearer."""
            k = len(stack) - 1
            while k > 0 and stack[k].tag not in tags and stack[k].tag not in stops:
                k -= 1
            if k > 0 and stack[k].tag in tags:
                close_to(k)

        at = 0
        while True:
            m = _TOKEN.search(html, at)
            piece = html[at:m.start() if m else len(html)]
            if piece and not stack[-1].hard:
                text.append(piece)
                if stack[-1].link:
                    linked += len(piece.strip())
            if m is None:
                break
            at = m.end()
            name = m.group(2) or m.group(5)
            if not name:
                continue
            tag, closing, attributes = name.lower(), m.group(1) or m.group(4), m.group(3) or m.group(6) or ""
            if tag in BLOCKS:
                flush()
            if closing:
                if opened[tag]:
                    close_nearest((tag,), frozenset() if tag in CONTAINERS else CONTAINERS)
                continue
            if tag in ENDS_PARAGRAPH and opened["p"]:
                close_nearest(("p",), CONTAINERS)
            elif tag == "li" and opened["li"]:
                close_nearest(("li",), _LISTS)
            if tag in VOID or attributes.endswith("/") and tag not in CONTAINERS:
                continue
            stack.append(self._opened(tag, attributes, stack[-1], bool(opened["article"] or opened["main"])))
            opened[tag] += 1
            if tag in NO_MARKUP:
                end = _ENDS[tag].search(html, at)
                at = end.end() if end else len(html)
                close_to(len(stack) - 1)
        flush()

    def scores(self) -> dict[int, float]:
        """Score of each path: text outside links, long blocks first, passed up to parents in part."""
        own: dict[Node, float] = defaultdict(float)
        for node, text, linked in self.blocks:
            if self.shown(node):
                own[node.box] += (len(text) - linked) * (1 - linked / max(len(text), 1)) * min(2.0, 0.5 + len(text) / 200)
        paths: dict[int, float] = defaultdict(float)
        for b in reversed(self.boxes):  # children come after their parents
            if own[b]:
                paths[b.path] += own[b] * WEIGHT.get(b.tag, 1.0)
                if b.above is not None:
                    own[b.above] += KEPT_ABOVE * own[b]
        return {p: s for p, s in paths.items() if s > 0}

    def best(self) -> set[int]:
        """The path of the page's own best container; equal scores go to the path last in order."""
        scores = self.scores()
        if not scores:
            return set()
        most = max(scores.values())
        return {max((p for p, s in scores.items() if s == most), key=self.paths.written)}

    def text(self, paths: set[int], repeated: set[int] = frozenset()) -> str:
        """Blocks inside the containers of these paths, in page order."""
        inside: dict[Node, bool] = {}
        for b in self.boxes:  # parents come before their children
            inside[b] = b.path in paths or (b.above is not None and inside[b.above])
        return "\n".join(text for node, text, _ in self.blocks if inside[node.box] and self.shown(node, repeated))

    def weak_texts(self) -> dict[int, int]:
        """Checksum of the text of each path that some names speak against."""
        sums: dict[int, int] = {}
        for node, text, _ in self.blocks:
            if node.weak is not None and not node.named:
                sums[node.weak.path] = crc32(text.encode(), sums.get(node.weak.path, 0))
        return sums


_LISTS = frozenset(("ul", "ol"))
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in NO_MARKUP}
_VOTE = pa.schema([("host", pa.string()), ("path", pa.string()), ("votes", pa.float64()), ("share", pa.float64()), ("pages", pa.int64()),
                   ("sum", pa.int64())])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes of containers, summed by batch (``sum`` is NULL), the pages of a host (path ``""``), and the checksum of each
    element that names speak against in part."""
    for batch in batches:
        sums: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.0, 0.0, 0])
        weak: list[tuple] = []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = Page(html)
            scores = page.scores()
            best = max(scores.values(), default=1.0)
            sums[host, ""][2] += 1
            for path, score in scores.items():
                vote = (score / best) ** 4  # a page's best container has one vote, others far less
                if vote >= LEAST_VOTE:
                    entry = sums[host, page.paths.written(path)]
                    entry[0] += vote
                    entry[1] += score / best
                    entry[2] += 1
            weak += [(host, page.paths.written(p), 0.0, 0.0, 1, c) for p, c in page.weak_texts().items()]
        rows = [(h, p, *v, None) for (h, p), v in sums.items()] + weak
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_VOTE), _VOTE)], schema=_VOTE)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, paths, repeated in zip(*(batch.column(c).to_pylist() for c in ("_html", "_paths", "_repeated"))):
            page = Page(html)
            find = lambda written: {n for p in written or () if (n := page.paths.find(p)) is not None}  # noqa: E731, B023
            gone = find(repeated)
            texts.append(page.text(find(paths), gone) or page.text(page.best(), gone) or page.text(page.best()))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, kind, votes, share, pages, texts): summed votes of containers (kind ``box``), elements that names speak
    against in part (``weak``) with their number of different texts, and the pages of each host (``host``)."""
    rows = pages.select(host_of(url).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("_html"))
    votes = rows.mapInArrow(_votes, "host string, path string, votes double, share double, pages long, sum long")
    kind = F.when(F.col("sum").isNotNull(), "weak").when(F.col("path") == "", "host").otherwise("box")
    return votes.withColumn("kind", kind).groupBy("host", "path", "kind").agg(
        F.round(F.sum("votes"), 6).alias("votes"), F.round(F.sum("share"), 6).alias("share"), F.sum("pages").alias("pages"),
        F.count_distinct("sum").alias("texts"))


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, votes): each host's winning container path; equal votes go to the path last in order."""
    return _winners(host_votes(pages, url, html))


def _winners(votes: DataFrame) -> DataFrame:
    best = votes.where("kind = 'box'").groupBy("host").agg(F.max(F.struct("votes", "path")).alias("_best"))
    return best.select("host", F.col("_best.path").alias("path"), F.col("_best.votes").alias("votes"))


def host_rules(votes: DataFrame) -> DataFrame:
    """(host, paths, repeated): paths to extract, and paths of elements that repeat over the host's pages.

    A list holds few paths: an extracted one has a share of all pages' scores, a repeated one is on several pages.
    """
    parent, tag = r"^(.*)/[^/]*$", r"^.*/([^./]*)[^/]*$"
    won = _winners(votes).select("host", F.col("path").alias("_won"))
    n = votes.where("kind = 'host'").select("host", F.col("pages").alias("_pages"))
    near = votes.where("kind = 'box'").join(won, "host").join(n, "host").where(
        (F.regexp_extract("path", parent, 1) == F.regexp_extract("_won", parent, 1))
        & (F.regexp_extract("path", tag, 1) == F.regexp_extract("_won", tag, 1))
        & ((F.col("path") == F.col("_won")) | (F.col("share") >= F.col("_pages") * SIBLING)))
    paths = near.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    least, most = REPEATED
    gone = votes.where((F.col("kind") == "weak") & (F.col("pages") >= least) & (F.col("texts") <= F.col("pages") * most))
    return paths.join(gone.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("repeated")), "host", "full_outer")


def host_of(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    NULL html gives an empty text; pages without a host (NULL or odd URLs) vote together; repeated rows stay repeated; an
    empty table gives no rows, and other columns take no part. Work and memory grow with the length of a page, however
    deeply it is nested. The table of hosts is joined by Spark's own choice; votes are summed before the shuffle, so a hot
    host is no burden.
    """
    rules = materialize(host_rules(materialize(host_votes(pages, url, html), "votes")).select(
        F.col("host").alias("_host"), F.col("paths").alias("_paths"), F.col("repeated").alias("_repeated")), "hosts")
    rows = pages.select(F.col(page_id).cast("long").alias("_id"), F.col(url).alias("_url"),
                        F.coalesce(F.col(html), F.lit("")).alias("_html"), host_of(url).alias("_host"))
    return rows.join(rules, "_host", "left").select("_id", "_url", "_html", "_paths", "_repeated").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
