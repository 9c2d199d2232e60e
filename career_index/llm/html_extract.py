"""Main-text extraction from HTML with gradient-boosted trees over DOM nodes (operator 4).

A page is parsed into blocks and the elements that hold them. An inline element that holds blocks counts as one, and loose text and inline elements
beside blocks form a node of their own, so every piece of text has one node that decides on it. Each node has features: its tag's kind, attribute
tokens, depth, density of text, links, punctuation and tags in its subtree, what its siblings and its parent hold. Gradient-boosted trees score how
likely a node belongs to the main text.

The trees are fitted by Spark on a bounded sample of pages (the ``sample_pages`` pages with the least hash). Labels come from the sample itself: elements below the
markup that HTML gives a meaning (``article``, ``main`` against ``nav``, ``footer``, ``form`` ...) are labelled by it. So that markup without such
meaning is learnt too, every sampled page is seen a second time with generic tags (``div``) that carry attribute tokens in place of the
meaningful ones, with misleading words in the names of the main text, and with the kinds of boilerplate that the page itself lacks; both are seen once more with all tags' meanings and
attribute tokens hidden, so that density, links and siblings alone must decide; and the page is seen with a main text of a few words.

Decoding is hierarchical. Below a dropped node nothing is kept; among the choices that obey this, the one with the highest sum of scores is taken. A node that the trees
reject is still kept if what it holds outweighs it, and no word in an attribute decides by itself.

Defined results: null or empty html has empty text. Broken or cut markup is read as far as it goes. Every row is extracted by itself, so repeated rows
and null ids need no care. An empty table gives an empty result. If the sample holds only one label, no trees are fitted and a fixed rule on the same features scores the nodes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from career_index.llm.common import materialize, scratch_path, text_or_empty

# Elements of HTML by what they mean for a reader.
SILENT = frozenset("script style template noscript head title meta link svg iframe object select option textarea button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
MAIN_TAGS = frozenset("article main".split())
OTHER_TAGS = frozenset("nav header footer aside form menu dialog".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
#: Words within class, id and role that mark boilerplate, or the main text.
OTHER_TOKENS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer form header login "
    "masthead menu modal nav navbar navigation newsletter notice pagination pager popup popular promo promoted recommended related reply replies search "
    "share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget".split())
MAIN_TOKENS = frozenset("article body content entry main post story text".split())
#: What boilerplate of each kind looks like when it is set into a sampled page: attribute, number of blocks, share of the blocks that are links.
PLANTED = (("comments", 3, 0.0), ("comment", 1, 0.0), ("sidebar", 3, 0.5), ("cookie-notice", 1, 0.2), ("ad", 1, 0.3), ("newsletter", 1, 0.1), ("related", 3, 0.9), ("menu", 4, 1.0),
           ("site-header", 2, 0.7), ("footer", 1, 0.2), ("login-form", 2, 0.2), ("share", 2, 1.0), ("breadcrumb", 3, 1.0), ("copyright", 1, 0.0))
#: Elements that hold the whole page: kept whatever they score.
FRAME = frozenset(("#root", "html", "body"))
RUN = "#run"
#: Marks the main text of a second look for its labels; the features don't see it.
TRUTH = "zzmain"

_TOKEN = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
FEATURES = ("main_tag", "other_tag", "main_tokens", "other_tokens", "main_above", "other_above", "main_near", "other_near", "text_tag", "leaf", "loose", "depth", "log_chars", "link_share",
            "tag_density", "stop_density", "share_of_page", "place", "siblings", "same_tag_siblings", "sibling_chars", "like_chars", "parent_direct", "parent_share",
            "parent_links", "block_children", "log_longest", "capital_share")
#: The features that a hidden look blanks: what tags and attribute tokens mean.
MEANING = 8


@dataclass
class Node:
    tag: str
    tokens: frozenset
    parent: Node | None
    place: int = 0
    children: list = field(default_factory=list)  # nodes and strings in page order
    block: bool = False  # decides on text: a block, an inline element that holds blocks, or loose content beside blocks
    chars: int = 0
    link_chars: int = 0
    stops: int = 0
    capitals: int = 0
    tags: int = 0
    blocks: int = 0  # block children
    longest: int = 0  # characters of the longest leaf


#: A comment, a declaration, a tag, or a tag that the page breaks off in.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)>|</?[a-zA-Z!?][^>]*\Z", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements whose content is not markup.
_RAW = {t: re.compile(rf"</{t}[^>]*>", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe")}
#: A start tag ends an open element of these tags, unless one of the others stands between: what browsers do with omitted end tags.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}),
         "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"})}
_PARAGRAPH = ({"p"}, {"article", "body", "td", "th", "li", "div", "section", "blockquote"})


def _close(at: Node, tags: set, stop: set) -> Node:
    """Where reading goes on after the nearest open element of ``tags`` ends; ``at`` if a ``stop`` element stands before it."""
    node = at
    while node.parent is not None and node.tag not in stop:
        if node.tag in tags:
            return node.parent
        node = node.parent
    return at


def _end(at: Node, tag: str) -> Node:
    node = at
    while node.parent is not None and node.tag != tag:
        if tag in INLINE and node.tag not in INLINE:
            return at  # an inline end tag closes no block
        node = node.parent
    return node.parent or at


def parse(html: str) -> Node:
    """The elements and texts of a page; missing, surplus and broken tags are tolerated."""
    root = at = Node("#root", frozenset(), None)
    text_from, pos, n = 0, 0, len(html)
    while pos < n:
        m = _MARKUP.search(html, pos)
        stop = m.start() if m else n
        if stop > text_from:
            text = html[text_from:stop]
            at.children.append(unescape(text) if "&" in text else text)
        if not m:
            break
        text_from = pos = m.end()
        if m[2] is None:
            continue
        tag, attrs = m[2].lower(), m[3]
        if m[1]:
            at = _end(at, tag)
            continue
        if tag not in INLINE and tag not in VOID:
            at = _close(at, *_PARAGRAPH)
            if tag in _ENDS:
                at = _close(at, *_ENDS[tag])
        if tag in VOID:
            if tag == "br":
                at.children.append("\n")
            elif tag not in INLINE:
                at.children.append(Node(tag, frozenset(), at))
            continue
        if tag in _RAW:
            closed = _RAW[tag].search(html, pos)
            text_from = pos = closed.end() if closed else n
            continue
        words = frozenset(w for v in _NAMES.findall(attrs) for w in _TOKEN.findall("".join(v).lower())) if "=" in attrs else frozenset()
        node = Node(tag, words, at)
        at.children.append(node)
        if not attrs.endswith("/"):
            at = node
    _arrange(root)
    _measure(root)
    return root


def _walk(root: Node):
    """Elements in page order, parents first, without recursion: pages may be nested deeply."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))


def _arrange(root: Node) -> None:
    """Mark the nodes that decide on text, and gather loose content beside blocks."""
    for node in reversed(list(_walk(root))):
        if node.tag in SILENT:
            continue
        inner = [isinstance(c, Node) and c.block for c in node.children]
        node.block = node.tag not in INLINE or any(inner)
        if not any(inner):
            continue
        arranged: list = []
        loose: list = []

        def gather():
            if any(isinstance(c, Node) or c.strip() for c in loose):
                run = Node(RUN, frozenset(), node, block=True, children=list(loose))
                for c in loose:
                    if isinstance(c, Node):
                        c.parent = run
                arranged.append(run)
            else:
                arranged.extend(loose)
            loose.clear()

        for c, is_block in zip(node.children, inner, strict=True):
            if is_block or isinstance(c, Node) and c.tag in SILENT:
                gather()
                arranged.append(c)
            else:
                loose.append(c)
        gather()
        node.children = arranged


def _measure(root: Node) -> None:
    for node in reversed(list(_walk(root))):
        if node.tag in SILENT:
            continue
        k = 0
        for c in node.children:
            if isinstance(c, str):
                n = len(c.strip())
                node.chars += n
                node.link_chars += n if node.tag == "a" else 0
                node.stops += sum(map(c.count, ".,;:!?"))
                node.capitals += sum(map(str.isupper, c))
            else:
                c.place = k
                k += 1
                node.chars += c.chars
                node.link_chars += c.chars if node.tag == "a" else c.link_chars
                node.stops += c.stops
                node.capitals += c.capitals
                node.tags += c.tags + 1
                node.blocks += c.block
                node.longest = max(node.longest, c.longest)
        if node.block and not node.blocks:
            node.longest = node.chars


def _breaks(node: Node) -> bool:
    """Whether the node begins and ends a paragraph of text."""
    return node.tag not in INLINE and node.tag not in SILENT and node.tag != RUN


def features(root: Node) -> tuple[list[Node], np.ndarray]:
    """Nodes that decide on text, in page order, and their features."""
    nodes, rows = [], []
    above: dict[int, tuple[int, int, int, int, int]] = {id(root): (0, 0, 0, 0, 0)}
    total = max(root.chars, 1)
    held: dict[int, tuple[dict, dict, int, int]] = {}
    for node in _walk(root):
        if node.parent is None or not node.block or id(node.parent) not in above:
            continue
        up = node.parent
        main, other, main_near, other_near, depth = above[id(up)]  # near: the nearest element above that has a meaning
        own_main = int(node.tag in MAIN_TAGS) + len(node.tokens & MAIN_TOKENS)
        own_other = int(node.tag in OTHER_TAGS) + len(node.tokens & OTHER_TOKENS)
        near = (own_main, own_other) if own_main or own_other else (main_near, other_near)
        above[id(node)] = (main + own_main, other + own_other, *near, depth + 1)
        if id(up) not in held:
            number: dict[tuple, int] = {}
            chars: dict[tuple, int] = {}
            for c in up.children:
                if isinstance(c, Node) and c.block:
                    kind = (c.tag, c.blocks > 0)
                    number[kind] = number.get(kind, 0) + 1
                    chars[kind] = chars.get(kind, 0) + c.chars
            direct = sum(n for (_, holds), n in chars.items() if not holds)
            held[id(up)] = (number, chars, direct, sum(number.values()))
        number, chars, direct, siblings = held[id(up)]
        kind = (node.tag, node.blocks > 0)
        size = max(node.chars, 1)
        nodes.append(node)
        rows.append((node.tag in MAIN_TAGS, node.tag in OTHER_TAGS, len(node.tokens & MAIN_TOKENS), len(node.tokens & OTHER_TOKENS), main, other, main_near, other_near,
                     node.tag in TEXT_TAGS, node.blocks == 0, node.tag == RUN, depth, np.log1p(node.chars), node.link_chars / size, (node.tags + 1) / (node.chars + 1),
                     node.stops / (node.chars + 1), node.chars / total, node.place / max(siblings, 1), siblings, number[kind], np.log1p(max(up.chars - node.chars, 0)),
                     np.log1p(chars[kind] - node.chars), direct / max(up.chars, 1), direct / total, up.link_chars / max(up.chars, 1), node.blocks,
                     np.log1p(node.longest), node.capitals / size))
    return nodes, np.array(rows or np.zeros((0, len(FEATURES))), np.float64).reshape(-1, len(FEATURES))


def label(node: Node) -> int | None:
    """1 below article or main, 0 below boilerplate, None where the markup says nothing. The nearest ancestor with a clear meaning decides; names that
    hold words of both kinds are not clear."""
    while node is not None:
        if node.tag in MAIN_TAGS or TRUTH in node.tokens:
            return 1
        if node.tag in OTHER_TAGS:
            return 0
        if bool(node.tokens & OTHER_TOKENS) != bool(node.tokens & MAIN_TOKENS):
            return int(not node.tokens & OTHER_TOKENS)
        node = node.parent
    return None


def _second_look(html: str, rng) -> str:
    """The page with generic tags, planted boilerplate, names that mislead and inline elements around blocks."""
    root = parse(html)
    texts = [c.strip() for n in _walk(root) for c in n.children if isinstance(c, str) and n.tag not in SILENT and c.strip()][:200] or ["text"]
    words = " ".join(texts).split() or ["text"]

    def some(n):
        at = int(rng.integers(0, len(words)))
        return " ".join((words + words)[at:at + n])

    def planted(kind, blocks, links):
        tag, inner = str(rng.choice(["div", "section", "ul", "font", "ins"])), str(rng.choice(["p", "div", "span"]))
        inner = "li" if tag == "ul" else inner
        many = blocks + int(rng.integers(0, 3)) if blocks > 1 else 1

        def piece():
            if rng.random() < links:
                return f"<a href=x>{some(int(rng.integers(1, 6)))}</a>"
            return some(int(rng.integers(2, 60))) if kind != "copyright" else f"&copy; {int(rng.integers(1990, 2030))} {some(3)}"

        loose = links == 1.0 and rng.random() < 0.3
        body = "".join(piece() + " " if loose else f"<{inner}>{piece()}</{inner}>" for _ in range(many))
        if loose and rng.random() < 0.5:
            return body
        around = str(rng.choice(["", "", "ins", "a", "span"]))
        out = f'<{tag} class="{kind}">{body}</{tag}>'
        return f"<{around}>{out}</{around}>" if around else out

    second = html
    for tag, kind in (("nav", "menu"), ("footer", "footer"), ("header", "site-header"), ("aside", "sidebar"), ("form", "login-form")):
        second = re.sub(rf"<{tag}\b", f'<div class="{kind}"', second, flags=re.I)
        second = re.sub(rf"</{tag}\s*>", "</div>", second, flags=re.I)
    # The main text's element may be named after its subject, in words that elsewhere mark boilerplate.
    name = str(rng.choice(["article", "post", "story", "main"]))
    if rng.random() < 0.5:
        name += " " + "-".join(str(w) for w in rng.choice(sorted(OTHER_TOKENS), int(rng.integers(1, 3)))) + "-" + str(rng.choice(sorted(MAIN_TOKENS)))
    if rng.random() < 0.7:
        second = re.sub(r"<(article|main)\b", f'<div class="{name} {TRUTH}"', second, flags=re.I)
        second = re.sub(r"</(article|main)\s*>", "</div>", second, flags=re.I)
    if rng.random() < 0.3:
        wrap = str(rng.choice(["post-header", "entry-header", "story-header"]))
        second = re.sub(r"(<h1\b.*?</h1>)", lambda m: f'<div class="{wrap}">{m[1]}</div>', second, count=1, flags=re.I | re.S)
    chosen = [PLANTED[int(k)] for k in rng.choice(len(PLANTED), 4, replace=False)]
    at = re.search(r"<body[^>]*>", second, re.I)
    cut = at.end() if at else 0
    end = second.lower().rfind("</body")
    end = max(len(second) if end < 0 else end, cut)
    body = planted(*chosen[0]) + planted(*chosen[1]) + second[cut:end] + planted(*chosen[2]) + planted(*chosen[3])
    for m in list(re.finditer(r"</p>", body, re.I))[-int(rng.integers(0, 3)):][::-1]:  # boilerplate also stands within the main text
        body = body[:m.end()] + planted(*PLANTED[int(rng.integers(0, len(PLANTED)))]) + body[m.end():]
    wrap = str(rng.choice(["", "", "span", "font", "div"]))
    body = f"<{wrap}>{body}</{wrap}>" if wrap else body
    return second[:cut] + body + second[end:]


def hidden(x: np.ndarray) -> np.ndarray:
    """Features without the meaning of tags and attribute tokens."""
    out = x.copy()
    out[:, :MEANING] = 0
    return out


def _short_look(html: str, rng) -> str:
    """The page with a main text of a few words, as notes and stubs have."""
    words = _SPACE.sub(" ", re.sub(r"<[^>]*>", " ", html)).split()[-400:] or ["text"]
    few = lambda: " ".join(str(w) for w in rng.choice(words, int(rng.integers(1, 9))))
    inner = "".join(f"<{t}>{few()}</{t}>" for t in (["h1"] if rng.random() < 0.7 else []) + ["p"] * int(rng.integers(1, 3)))
    return re.sub(r"(<(article|main)\b[^>]*>).*?(</\2\s*>)", lambda m: m[1] + inner + m[3], html, flags=re.I | re.S)


def _examples(html: str, seed: int):
    """(label, features) of a page as it is and of its second look, each also with the meaning hidden, and of the page with a short text."""
    rng = np.random.default_rng(seed)
    for page, hides in ((html, True), (_second_look(html, rng), True), (_short_look(html, rng), False)):
        nodes, x = features(parse(page))
        labels = [None if node.tag in FRAME else label(node) for node in nodes]
        for look in (x, hidden(x)) if hides else (x,):
            for y, row in zip(labels, look, strict=True):
                if y is not None:
                    yield y, row


class Trees:
    """Fitted trees as flat arrays: split feature (-1: leaf), threshold, children, and leaf value times the tree's weight."""

    def __init__(self, rows: list, weights: list[float]):
        per: dict[int, list] = {}
        for r in rows:
            per.setdefault(r["treeID"], []).append(r)
        self.trees = []
        for members in per.values():
            n = max(r["id"] for r in members) + 1
            feature, threshold, lo, hi, value = np.full(n, -1), np.zeros(n), np.zeros(n, int), np.zeros(n, int), np.zeros(n)
            for r in members:
                value[r["id"]] = r["prediction"] * weights[r["treeID"]]
                if r["left"] >= 0:
                    feature[r["id"]], threshold[r["id"]], lo[r["id"]], hi[r["id"]] = r["feature"], r["threshold"], r["left"], r["right"]
            self.trees.append((feature, threshold, lo, hi, value))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The margin of each row; above 0 means main text."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, threshold, lo, hi, value in self.trees:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                go_left = x[every, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(go_left, lo[at], hi[at]), at)
            total += value[at]
        return total


def fit(pages: DataFrame, html_col: str = "html", sample_pages: int = 200, rounds: int = 20, depth: int = 5, seed: int = 7) -> Trees | None:
    """Trees fitted on the ``sample_pages`` pages of the table with the least hash; the sample and the node table don't grow with it."""
    spark = pages.sparkSession

    def run(batches):
        for b in batches:
            for text in b.column("body"):
                page = text.as_py()
                found = list(_examples(page, seed + len(page)))
                yield pa.RecordBatch.from_arrays([pa.array([float(y) for y, _ in found], pa.float64()),
                                                  pa.array([r.tolist() for _, r in found], pa.list_(pa.float64()))], ["label", "x"])

    sample = pages.select(text_or_empty(html_col).alias("body")).orderBy(F.xxhash64("body"), "body").limit(sample_pages)
    seen = materialize(sample.repartition(8).mapInArrow(run, "label double, x array<double>"), "html-examples")
    if seen.select("label").distinct().count() < 2:
        return None
    data = seen.select("label", array_to_vector("x").alias("features"))
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed, maxBins=32).fit(data)
    path = scratch_path(spark, "html-trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    rows = nodes.select("treeID", "id", "prediction", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
                        F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"))
    return Trees(rows.collect(), model.treeWeights)  # rounds * 2 ** (depth + 1) rows at most


def fixed_score(x: np.ndarray) -> np.ndarray:
    """Margins by rule, where there are no trees: text with few links, unless only boilerplate is named at or above it."""
    f = {name: x[:, k] for k, name in enumerate(FEATURES)}
    other = (f["other_tag"] + f["other_tokens"] + f["other_above"] > 0) & (f["main_tag"] + f["main_tokens"] + f["main_above"] == 0)
    return 1 - 3 * f["link_share"] - 3 * other


def decide(nodes: list[Node], score: np.ndarray) -> dict[int, bool]:
    """Hierarchical decoding: whether each node is kept, by id of the node.

    A child is kept only if its parent is. Of all such choices the one with the greatest sum of kept scores is taken: from the leaves up, a node is worth its score and
    what its children are worth at best; from the root down, a node stays if it is worth something and its parent stays.
    """
    worth: dict[int, float] = {}
    for node, s in zip(reversed(nodes), score[::-1], strict=True):
        own = worth.get(id(node), 0.0) + s
        worth[id(node)] = own
        worth[id(node.parent)] = worth.get(id(node.parent), 0.0) + max(own, 0.0)
    out: dict[int, bool] = {}
    for node in nodes:
        out[id(node)] = out.get(id(node.parent), True) and (node.tag in FRAME or worth[id(node)] > 0)
    return out


def blocks(root: Node, keep: dict[int, bool]) -> list[str]:
    """Texts of kept blocks in page order, white space inside a block as one space."""
    done: list[str] = []
    run: list[str] = []

    def flush():
        text = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            done.append(text)

    stack: list = [(root, True, 0)]
    while stack:
        node, kept, at = stack.pop()
        if at == 0 and _breaks(node):
            flush()
        for k in range(at, len(node.children)):
            c = node.children[k]
            if isinstance(c, str):
                if kept:
                    run.append(c)
            elif c.tag not in SILENT:
                stack.append((node, kept, k + 1))
                stack.append((c, keep.get(id(c), kept) if c.block else kept, 0))
                break
        else:
            if _breaks(node):
                flush()
    return done


def main_texts(pages: list[str], trees: Trees | None) -> list[str]:
    """Main text of each page; the trees score the elements of all pages at once."""
    roots = [parse(p) for p in pages]
    found = [features(r) for r in roots]
    x = np.concatenate([x for _, x in found])
    score = fixed_score(x) if trees is None else trees.score(x)
    out, at = [], 0
    for root, (nodes, _) in zip(roots, found, strict=True):
        out.append("\n\n".join(blocks(root, decide(nodes, score[at:at + len(nodes)]))))
        at += len(nodes)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", trees: Trees | None = None, **fitting) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars. Trees are fitted on a sample of ``pages`` unless given."""
    trees = trees or fit(pages, html_col, **fitting)

    def run(batches):
        for b in batches:
            html = b.column("body")
            texts = [t for at in range(0, len(html), 64) for t in main_texts(html.slice(at, 64).to_pylist(), trees)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("body"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
