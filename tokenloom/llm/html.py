"""HTML extraction (7) by minimum-cut labelling.

A page is cut into blocks of text in page order.  A classifier gives each block a cost of being called content and one of
being called boilerplate; they are the capacities of its edges to the two terminals.  Neighbouring blocks, and blocks
of the same container, are joined by smoothness edges whose capacity falls with their distance in the document tree.
The minimum cut, found by maximum flow, separates the article from the rest.

The classifier is a naive Bayes model of a block's shape (length, share of link text, punctuation, tag), learned on the
blocks of a bounded sample of pages (of the ``PAGES`` ids with the smallest digest) that lie in elements whose
meaning is plain, plus fixed evidence from those elements themselves.  Before it has learned much, or where no page has such
elements, it goes by what is usual of text (``PRIOR``).

Defined cases: a null page counts as empty; a page without article text gives an empty text; an unfinished tag at the end
of a page is dropped, an unfinished comment, script or style too; a script or style never counts as text; end tags
without a start are ignored; elements left open end with the one around them; repeated rows are rows of their own; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = 1000                # the bound of the training sample
SCALE = 16                  # capacities are whole numbers of 1/SCALE
# Evidence of article elements, of others, of class and id words, and the most that shape may say.  Shape and neighbours
# together (at most CLIP + 3 NEAR) outweigh any of it, shape alone that of a word.
PLAIN, OUTSIDE, WORD, CLIP = 6.0, 6.5, 3.0, 4.0
NEAR = 2.0                  # capacity between blocks of one container
# What shape says before anything is learned (long text, few links, whole sentences), and the blocks that it stands for.
PRIOR = {"words0": -1.5, "words1": -1.2, "words2": -0.8, "words3": 0.2, "words4": 1.0, "words5": 1.6, "words6": 2.0, "words7": 2.0,
         "words8": 2.0, "links0": 0.8, "links1": 0.0, "links2": -1.0, "links3": -2.0, "links4": -2.5, "stop": 0.8, "no stop": -0.6,
         "comma": 0.5, "no comma": -0.2}
DOUBT = 20

# Elements by meaning.
BREAKING = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt "
                     "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
                     "li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th "
                     "thead title tr ul".split())
CONTAINERS = BREAKING - frozenset("br hr p h1 h2 h3 h4 h5 h6 dt dd li option pre".split()) | {"li"}
SILENT = frozenset("script style noscript template textarea select iframe object svg math canvas audio video title xmp "
                   "noembed noframes datalist button".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
ENDS_ITSELF = frozenset("li tr td th thead tbody tfoot".split())
ARTICLE = frozenset("article main".split())
AROUND = frozenset("nav footer aside form menu dialog search head".split())
# Words of class and id names that say what an element is for.
AROUND_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
                         "consent cookie cookies copyright disqus footer gdpr header login masthead menu menus modal nav "
                         "navbar navigation newsletter notice notices notification outbrain pagination pager paywall popup "
                         "promo promotion promoted recommended related replies reply search share sharing sidebar signup "
                         "social sponsor sponsored subscribe subscription taboola toolbar widget".split())
STATE_WORDS = frozenset("has have hide hides hidden no not show shows with without".split())    # what follows is of something else
ARTICLE_WORDS = frozenset("article articlebody content entry main post story".split())

TAG = re.compile(r"""<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*>""")
UNFINISHED = re.compile(r"<(?:[a-zA-Z/!?][^>]*)?$")
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))?)?""")


def name_words(names: str) -> set[str]:
    """The words of class and id names, of each name up to a word that negates or tells a state (has-sidebar, no-header)."""
    out: set[str] = set()
    for name in names.split():
        for word in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()):
            if word in STATE_WORDS:
                break
            out.add(word)
    return out


class Element:
    """An open container: what it says about the text in it."""

    __slots__ = ("name", "parent", "depth", "evidence", "silent", "doubted")

    def __init__(self, name: str, parent: Element | None, attributes: str):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        self.silent = bool(parent and parent.silent) or name in SILENT
        outside = parent.evidence < 0 if parent else False
        in_article = parent.evidence > 0 if parent else False
        if attributes:
            found: dict[str, str] = {}                      # names and values in order; the first of a name counts
            for m in ATTRIBUTE.finditer(attributes):
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            words = name_words(f"{found.get('class', '')} {found.get('id', '')}")
            role = found.get("role", "").lower()
            if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
                self.silent = True
        else:
            words, role = frozenset(), ""
        # In an article a <header> or a class word "header" is the article's own.
        around = name in AROUND or (name == "header" and not in_article) or role in (
            "navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form")
        named = words & AROUND_WORDS - (frozenset(["header"]) if in_article else frozenset())
        plain = name in ARTICLE or role in ("main", "article")
        # A word outside any article is doubted: an article within is one, but a named one (a list of comments) stays out.
        reset = outside and parent.doubted and plain and (not named or name == "main" or role == "main")
        self.doubted = False
        if (outside and not reset) or around or (named and not (plain or name in ("body", "html"))):
            by_word = not around and (not outside or parent.evidence == -WORD)
            self.evidence = -WORD if by_word else -OUTSIDE
            self.doubted = by_word and not in_article and (not outside or parent.doubted)
        elif plain:
            self.evidence = PLAIN
        elif in_article:
            self.evidence = parent.evidence
        else:
            self.evidence = WORD if words & ARTICLE_WORDS and name not in ("body", "html") else 0.0


class Block:
    __slots__ = ("text", "element", "tag", "links")

    def __init__(self, text: str, element: Element, tag: str, links: int):
        self.text, self.element, self.tag, self.links = text, element, tag, links


def blocks(html: str) -> list[Block]:
    """The text blocks of a page, in order."""
    out: list[Block] = []
    current = Element("html", None, "")
    parts: list[tuple[str, bool]] = []
    tag, link, at = "", 0, 0
    hidden: list[str] = []              # open inline elements without text
    opened: Counter[str] = Counter()    # names of open containers

    def end() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                links = len(" ".join("".join(p for p, linked in parts if linked).split()))
                out.append(Block(text, current, tag, links))
            parts = []

    unfinished = UNFINISHED.search(html, html.rfind(">") + 1)
    size = unfinished.start() if unfinished else len(html)
    while at < size:
        found = TAG.search(html, at, size)
        upto = found.start() if found else size
        if upto > at and not current.silent and not hidden:
            parts.append((unescape(html[at:upto]), link > 0))
        if not found:
            break
        at = found.end()
        if found[0] == "<!--":
            close = html.find("-->", max(at - 2, 0) if html.startswith(">", at) else at, size)
            at = close + 3 if close >= 0 else size
            continue
        if not found[2]:
            continue
        name, closing, attributes = found[2].lower(), bool(found[1]), found[3]
        if not closing and name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at, size)
            at = close.end() if close else size
            if name in BREAKING:
                end()
            continue
        if name == "a":
            link = max(0, link + (-1 if closing else 1))
        elif name in CONTAINERS:
            end()
            link, hidden = 0, []
            if not closing:
                if name in ENDS_ITSELF and current.name == name and current.parent:
                    opened[name] -= 1
                    current = current.parent
                opened[name] += 1
                current, tag = Element(name, current, attributes), name
            elif opened[name]:                          # one that isn't open ends nothing; each element is left once
                while current.name != name:
                    opened[current.name] -= 1
                    current = current.parent
                opened[name] -= 1
                current = current.parent
                tag = current.name
        elif name in BREAKING:
            end()
            if not closing:
                tag = name
        elif name in SILENT and not attributes.endswith("/"):
            if not closing:
                hidden.append(name)
            elif name in hidden:
                while hidden.pop() != name:
                    pass
    end()
    return out


def shape(block: Block) -> tuple[str, ...]:
    words = block.text.count(" ") + 1
    share = block.links / len(block.text)
    return (f"words{min(8, int(math.log2(words)))}", f"links{min(4, int(4 * share + 0.5))}", f"tag {block.tag}",
            "stop" if block.text[-1] in ".!?…。" else "no stop", "comma" if "," in block.text else "no comma")


def count_shapes(html: str, counts: Counter) -> None:
    for block in blocks(html):
        if block.element.evidence:
            own = "content" if block.element.evidence > 0 else "around"
            counts[own, ""] += 1
            counts.update((own, feature) for feature in shape(block))


def weights_of(counts: dict[tuple[str, str], int]) -> dict[str, float]:
    """Log-odds of content for each feature, add-one smoothed, and mixed with ``PRIOR`` as if ``DOUBT`` more blocks had shown it."""
    content, around = counts.get(("content", ""), 0), counts.get(("around", ""), 0)
    out = {}
    for feature in sorted({f for _, f in counts if f} | set(PRIOR)):
        own, other = counts.get(("content", feature), 0), counts.get(("around", feature), 0)
        learned = math.log((own + 1) / (content + 2)) - math.log((other + 1) / (around + 2)) if content and around else 0.0
        seen = own + other if content and around else 0
        out[feature] = (seen * learned + DOUBT * PRIOR.get(feature, 0.0)) / (seen + DOUBT)
    return out


def distance(a: Element, b: Element) -> int:
    """Steps between two elements of the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth and a.parent:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def minimum_cut(gains: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the side of the source.  ``gains``: capacity from the source, or to the sink if negative;
    ``edges``: capacities in both directions.

    A node whose terminal capacity is no less than those of all its other edges lies on that side in some minimum cut.  It is
    contracted into the terminal before the flow begins; what is left is mostly small.
    """
    n = len(gains)
    around = [[] for _ in range(n)]
    for a, b, c in edges:
        around[a].append((b, c))
        around[b].append((a, c))
    gains, side = list(gains), [0] * n
    waiting = deque(range(n))
    while waiting:
        a = waiting.popleft()
        if side[a]:
            continue
        loose = sum(c for b, c in around[a] if not side[b])
        if gains[a] and abs(gains[a]) >= loose:
            side[a] = 1 if gains[a] > 0 else -1
            for b, c in around[a]:
                if not side[b]:
                    gains[b] += side[a] * c
                    waiting.append(b)
    free = [i for i in range(n) if not side[i]]
    if free:
        place = {x: i + 2 for i, x in enumerate(free)}
        left: list[dict[int, int]] = [{} for _ in range(len(free) + 2)]      # 0 is the source, 1 the sink
        for a in free:
            i = place[a]
            if gains[a] > 0:
                left[0][i], left[i][0] = gains[a], 0
            elif gains[a] < 0:
                left[i][1], left[1][i] = -gains[a], 0
            for b, c in around[a]:
                if b in place:
                    left[i][place[b]] = left[i].get(place[b], 0) + c
        while True:                                                            # shortest augmenting paths
            came = {0: 0}
            queue = deque([0])
            while queue and 1 not in came:
                u = queue.popleft()
                for v, c in left[u].items():
                    if c > 0 and v not in came:
                        came[v] = u
                        queue.append(v)
            if 1 not in came:
                break
            path = [1]
            while path[-1]:
                path.append(came[path[-1]])
            steps = list(zip(path[1:], path))
            flow = min(left[u][v] for u, v in steps)
            for u, v in steps:
                left[u][v] -= flow
                left[v][u] = left[v].get(u, 0) + flow
        for a in free:
            side[a] = 1 if place[a] in came else -1
    return [s > 0 for s in side]


def main_text(html: str | None, weights: dict[str, float]) -> str:
    found = blocks(html or "")
    if not found:
        return ""
    gains, edges, latest = [], [], {}
    for i, block in enumerate(found):
        own = sum(weights.get(f, 0.0) for f in shape(block))
        gains.append(round(SCALE * (block.element.evidence + max(-CLIP, min(CLIP, own)))))
        if i:
            edges.append((i - 1, i, round(SCALE * NEAR / (1 + distance(found[i - 1].element, block.element)))))
        before = latest.get(id(block.element))
        if before is not None and before < i - 1:
            edges.append((before, i, round(SCALE * NEAR / 2)))
        latest[id(block.element)] = i
    kept = minimum_cut(gains, edges)
    return "\n".join(b.text for b, keep in zip(found, kept) if keep)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for html in batch.column(0).to_pylist():
            count_shapes(html or "", counts)
        keys = sorted(counts)
        yield pa.record_batch({"label": pa.array([k[0] for k in keys], pa.string()), "feature": pa.array([k[1] for k in keys], pa.string()),
                               "n": pa.array([counts[k] for k in keys], pa.int64())})


def learned(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> dict[str, float]:
    """The classifier; what reaches the driver is one number per feature, of which there are fewer than a hundred."""
    digest = F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("null")))
    rows = pages.select(F.col(html_column).cast("string").alias("html"), digest.alias("digest"))
    # Digests alone are put in order, and of them only a few times as many as are needed; pages are read where they lie.
    place = F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / float(1 << 32)
    ids = rows.select("digest").where(place < 4 * PAGES / max(1, pages.count())).distinct().orderBy("digest").limit(PAGES)
    sample = rows.join(F.broadcast(ids), "digest", "left_semi")
    counts = sample.select("html").mapInArrow(_count, "label string, feature string, n bigint").groupBy("label", "feature").agg(F.sum("n").alias("n"))
    return weights_of({(r["label"], r["feature"]): r["n"] for r in counts.collect()})


def _extract(weights: dict[str, float]):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html, weights) for html in batch.column(2).to_pylist()]
            yield pa.record_batch({"_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()),
                                   "n_chars": pa.array([len(t) for t in texts], pa.int64())})
    return extract


def extracted(spark: SparkSession, pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
              html_column: str = "html") -> DataFrame:
    """One row per page: ``_id``, ``url``, ``text``, ``n_chars``."""
    weights = learned(pages, id_column, html_column)
    rows = pages.select(F.col(id_column).alias("_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(_extract(weights), f"_id {kind}, url string, text string, n_chars bigint")
