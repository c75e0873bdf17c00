"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Each block element is a node with two states, content or not. Its own evidence comes from tag, class and id
words and the text it holds; parent and child are tied by a pairwise potential. Messages run from the leaves
up and from the root down (sum-product), and the text of nodes whose content marginal is over one half is
kept. Counts for evidence and potentials come from pages that label themselves: those that mark their article
with a tag of its own.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import small_batches

#: Pages that the model is trained on, at most, and cues it keeps.
SAMPLE, CUES = 2000, 5000
#: Elements without end tag, with raw text, and inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe xmp noembed noframes template svg math select object".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that end an open one of the same group.
ENDS = {
    "p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option",
    "thead": "thead tbody tfoot tr td th", "tbody": "thead tbody tfoot tr td th", "tfoot": "thead tbody tfoot tr td th",
}
SCOPE = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "table", "th": "table", "thead": "table", "tbody": "table", "tfoot": "table"}
_ENDS = {k: frozenset(v.split()) for k, v in ENDS.items()}
_SCOPE = {k: frozenset(v.split()) for k, v in SCOPE.items()}
#: Tags, and words in class, id or role, that speak for and against content by themselves.
FOR_TAGS, AGAINST_TAGS = "article main", "nav header footer aside form fieldset button label input menu dialog address legend head"
FOR_WORDS = "article articlebody post entry story"
AGAINST_WORDS = (
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promoted promotion sidebar comment comments"
    " commentlist reply replies discussion disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter"
    " subscribe subscription signup share sharing social nav navbar navigation menu breadcrumb breadcrumbs footer header masthead related"
    " recommended widget toolbar pagination pager login search searchbox copyright legal disclaimer skip hidden contentinfo complementary"
    " navigation banner form tags"
)
#: A class name that begins or ends with one of these tells the state of a page (no-sidebar,
#: has-comments, header-fixed), not what its element is.
STATE_FIRST, STATE_LAST = "no not non has have with without hide", "fixed sticky enabled disabled collapsed closed off"
LABELLED = frozenset(FOR_TAGS.split())
_STATE_FIRST, _STATE_LAST = frozenset(STATE_FIRST.split()), frozenset(STATE_LAST.split())
_AGAINST = frozenset(AGAINST_TAGS.split())
_AGAINST_WORDS = frozenset(AGAINST_WORDS.split())
_ROOTS = frozenset(["", "html", "body"])

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)",
    re.DOTALL,
)
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Tree:
    """Nodes in page order, a parent before its children. texts: (node, text, letters in links)."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    words: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    texts: list[tuple[int, str, int]] = field(default_factory=list)


def _names(attrs: str) -> tuple[str, ...]:
    """Words of class, id and role. Those of a name of state are marked by ~: no fixed word speaks for or
    against content there, only what the labelled pages show, and the text inside decides."""
    found: list[str] = []
    if "=" in attrs:
        for m in _NAMED.finditer(attrs):
            for name in (m[2] or m[3] or m[4] or "").split():
                words = _WORD.findall(_CAMEL.sub(" ", name).lower())
                state = len(words) > 1 and (words[0] in _STATE_FIRST or words[-1] in _STATE_LAST)
                found += [f"~{w}" for w in words] if state else words
    if attrs and _HIDDEN.search(attrs):
        found.append("hidden")
    return tuple(dict.fromkeys(found))


def parse(page: str) -> Tree:
    """The tree of block elements. Unclosed, wrongly nested and cut off tags are put up with."""
    tree = Tree()
    stack, parts = [0], []
    open_tags: Counter[str] = Counter()
    state = {"linked": 0, "in_link": 0}

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                tree.texts.append((stack[-1], text, state["linked"]))
            parts.clear()
        state["linked"] = 0

    def close(depth: int) -> None:
        open_tags.subtract(tree.tag[node] for node in stack[depth:])
        del stack[depth:]

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if state["in_link"]:
                state["linked"] += len(text)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in RAW:
            if not m["end"]:
                flush()
                closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = closing.end() if closing else end
            continue
        if tag in INLINE:
            if tag == "a":
                state["in_link"] = 0 if m["end"] else 1
            elif tag in ("br", "img"):
                parts.append(" ")
            continue
        flush()
        if m["end"]:
            if open_tags[tag]:
                close(next(d for d in range(len(stack) - 1, 0, -1) if tree.tag[stack[d]] == tag))
                state["in_link"] = 0
            continue
        closes, within = _ENDS.get(tag, frozenset()), _SCOPE.get(tag, frozenset())
        for depth in range(len(stack) - 1, 0, -1):
            open_ = tree.tag[stack[depth]]
            if open_ in closes or open_ == "p":
                close(depth)
                if open_ in closes and tag not in ("td", "th", "tr", "thead", "tbody", "tfoot"):
                    break
            elif open_ in within or open_ not in ("td", "th", "tr", "thead", "tbody", "tfoot"):
                break
        tree.parent.append(stack[-1])
        tree.tag.append(tag)
        tree.words.append(_names(m["attrs"] or ""))
        if tag not in VOID:
            stack.append(len(tree.tag) - 1)
            open_tags[tag] += 1
    flush()
    return tree


def cues(tree: Tree) -> tuple[list[list[str]], list[list[str]]]:
    """Cues of each node: of its tag and names, and of the text it holds itself."""
    size, linked, marks = [0] * len(tree.tag), [0] * len(tree.tag), [0] * len(tree.tag)
    for node, text, in_links in tree.texts:
        size[node] += len(text)
        linked[node] += in_links
        marks[node] += sum(text.count(c) for c in ".,;:!?")
    named = [[f"t:{t}"] + [f"w:{w}" for w in words] for t, words in zip(tree.tag, tree.words)]
    own = [
        [f"n:{min(6, int(math.log2(n + 1)) // 2)}", f"l:{min(4, 4 * x // n)}", f"m:{min(3, 40 * k // n)}"] if n else []
        for n, x, k in zip(size, linked, marks)
    ]
    return named, own


def markup_labels(tree: Tree) -> list[bool] | None:
    """Content is what an article element holds, but for parts with tags or names against it; None if the page
    has no article element."""
    if not LABELLED & set(tree.tag):
        return None
    out = [False] * len(tree.tag)
    for i in range(1, len(out)):
        against = tree.tag[i] in _AGAINST or not _AGAINST_WORDS.isdisjoint(tree.words[i])
        out[i] = not against and (tree.tag[i] in LABELLED or out[tree.parent[i]])
    return out


@dataclass
class Model:
    """Log odds of cues, log odds of content as such, and log potentials [parent][child] of the states."""

    cue: dict[str, float]
    prior: float
    pair: tuple[tuple[float, float], tuple[float, float]]

    def evidence(self, named: list[str], own: list[str]) -> float:
        strong = sum(self.cue.get(c, 0.0) for c in named)
        # many weak hints from text must not outvote what tags and names say
        weak = 0.2 * (self.prior + sum(self.cue.get(c, 0.0) for c in own)) if own else 0.0
        return max(-40.0, min(40.0, strong)) + max(-0.7, min(0.7, weak))


def _prior_counts() -> dict[str, tuple[float, float]]:
    """Counts (content, other) that the fixed tags and words start with."""
    out = {}
    for kind, words, count in (("t", FOR_TAGS, (1e9, 0.0)), ("w", FOR_WORDS, (20.0, 0.0)), ("t", AGAINST_TAGS, (0.0, 1e9)), ("w", AGAINST_WORDS, (0.0, 1e9))):
        out |= {f"{kind}:{w}": count for w in words.split()}
    return out


def build(counts: dict[tuple[str, bool], int]) -> Model:
    """The model of counts (cue, content) -> nodes; pairs are counted as p:parent state, child state."""
    start = _prior_counts()
    names = sorted({c for c, _ in counts} | set(start), key=lambda c: (-(counts.get((c, True), 0) + counts.get((c, False), 0)), c))
    content, other = counts.get(("*", True), 0) + 1.0, counts.get(("*", False), 0) + 1.0
    cue = {}
    for c in names:
        if c[:2] in ("p:", "*") or (len(cue) >= CUES and c not in start):
            continue
        a, b = start.get(c, (0.0, 0.0))
        a, b = counts.get((c, True), 0) + a, counts.get((c, False), 0) + b
        if c in ("t:", "t:html", "t:body", "t:div", "t:section", "t:span") or a + b < 5:
            continue
        odds = math.log((a + 0.5) / (content + 1)) - math.log((b + 0.5) / (other + 1)) if a + b < 1e8 else math.log((a + 0.5) / (b + 0.5))
        # a tag that holds text anywhere says little by itself
        limit = 30.0 if c in start and a + b >= 1e8 else 6.0 if c[0] == "w" else 0.2
        cue[c] = max(-limit, min(limit, odds))
    pair = []
    for parent in (False, True):
        a, b = (counts.get((f"p:{int(parent)}", s), 0) + (200 if s == parent else 1) for s in (False, True))
        # content holds parts that are none more often than pages with a plain article show
        least = 0.05 if parent else 0.002
        share = min(1 - least, max(least, b / (a + b)))
        pair.append((math.log(1 - share), math.log(share)))
    return Model(cue, math.log(content / other), (pair[0], pair[1]))


def _add(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


def marginals(parent: list[int], evidence: list[float], free: list[bool], pair) -> list[float]:
    """Content probability of each node: messages up from the leaves, then down from the root. `free`: nodes
    that their parent says nothing about."""
    n = len(parent)
    (s00, s01), (s10, s11) = pair
    in0, in1 = [0.0] * n, list(evidence)  # own evidence and messages from children
    up: list[tuple[float, float]] = [(0.0, 0.0)] * n
    for i in range(n - 1, 0, -1):
        a, b = in0[i], in1[i]
        message = (0.0, 0.0) if free[i] else (_add(s00 + a, s01 + b), _add(s10 + a, s11 + b))
        up[i] = message
        in0[parent[i]] += message[0]
        in1[parent[i]] += message[1]
    out = [0.0] * n
    all0, all1 = in0, in1
    for i in range(n):
        if i and not free[i]:
            p = parent[i]
            a, b = all0[p] - up[i][0], all1[p] - up[i][1]
            all0[i] += _add(a + s00, b + s10)
            all1[i] += _add(a + s01, b + s11)
        gap = all0[i] - all1[i]
        out[i] = 1 / (1 + math.exp(gap)) if gap < 700 else 0.0
    return out


def main_text(page: str | None, model: Model) -> str:
    tree = parse(page or "")
    evidence = [model.evidence(a, b) for a, b in zip(*cues(tree))]
    # the root's parts stand alone, and a menu or advert inside an article says nothing about the article
    free = [p < 0 or tree.tag[p] in _ROOTS or e < -10 for p, e in zip(tree.parent, evidence)]
    content = marginals(tree.parent, evidence, free, model.pair)
    return "\n".join(text for node, text, _ in tree.texts if content[node] > 0.5)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[tuple[str, bool]] = Counter()
    for batch in batches:
        for page in batch.column("html").to_pylist():
            tree = parse(page or "")
            labels = markup_labels(tree)
            if labels is None:
                continue
            for i, (named, own, label) in enumerate(zip(*cues(tree), labels)):
                counts.update((c, label) for c in (*named, *own))
                if own:
                    counts["*", label] += 1
                if i and tree.tag[tree.parent[i]] not in _ROOTS:
                    counts[f"p:{int(labels[tree.parent[i]])}", label] += 1
    yield pa.RecordBatch.from_arrays(
        [pa.array([c for c, _ in counts], pa.string()), pa.array([s for _, s in counts], pa.bool_()), pa.array(list(counts.values()), pa.int64())],
        names=["cue", "content", "n"],
    )


def learn(pages: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of at most `sample` pages, the first by a hash of page_id. Ids are chosen first; only the
    more frequent cues come to the driver."""
    key = F.col("page_id").cast("long")
    chosen = pages.select(key.alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = pages.select(key.alias("_id"), F.col("html").cast("string").alias("html")).join(F.broadcast(chosen), "_id")
    counts = (
        texts.select("html").mapInArrow(_count, "cue string, content boolean, n long")
        .groupBy("cue", "content").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "cue", "content").limit(4 * CUES)
    )
    return build({(r["cue"], r["content"]): r["n"] for r in counts.collect()})


def _extract(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, model.value) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars for each row of `pages` (page_id, url, html).

    Blocks of main text stand in page order, one on a line; character references are decoded and white space
    inside a block is one blank. A null or empty html, and a page without main text, give an empty text. Null
    and repeated page_ids are rows like others. Where no page labels itself the fixed tags and words decide.
    No pages give no rows.
    """
    spark = pages.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(learn(pages, sample))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(model), "page_id long, url string, text string, n_chars long")
