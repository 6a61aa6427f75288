"""Main text of web pages by a tree-structured graphical model over the page's elements.

Every element is content or not. Its own evidence (tag, words of class, id and role, share of linked text, length and
punctuation of the text below it) gives a node potential, parent and child are tied by an edge potential that depends on
the kind of child, and sum-product messages up and then down the tree give each element's marginal exactly, in time
linear in the elements. Both kinds of potentials are counted, with smoothing, from labelled pages. The text of elements
whose marginal is at least one half is the main text.

Defined cases: null and empty pages, and pages without content, give empty text; unclosed and stray tags are repaired
as browsers do for paragraphs, list items and table cells; the content of scripts, styles, form controls and comments
is never text; ``br`` is white space inside its block. Repeated rows give repeated rows, other columns are kept. A page
is one row of one task and the work on it is linear in its length.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from threadloom.llm.common import map_batches, schema_with, with_columns
from threadloom.llm.labelled_pages import LABELLED_PAGES

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset(("td", "th", "br"))
NEVER_TEXT = frozenset(
    "head title script style noscript template iframe object svg math canvas audio video select option optgroup textarea button datalist".split()
)
# What an opening tag ends, up to the elements named after it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = BLOCKS - {"body", "html", "tbody", "tfoot", "thead", "tr"}
HOLDS_P = {"td", "th", "table", "button", "body", "html", "object"}

ATTRIBUTES = ("class", "id", "role")
WHITE = re.compile(r"\s+")


class Page(HTMLParser):
    """Elements in page order with their parents, and the texts between tags with the element each stands in."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.words, self.marks, self.parents = ["#page"], [()], [None], [-1]
        self.events: list[tuple[int, str | None]] = []  # (element, text), or None for the border of a block
        self.open = [0]
        self.feed(html)
        self.close()

    def _pop_to(self, tags: set[str], stop: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[i]]
            if tag in tags:
                del self.open[i:]
                return
            if tag in stop:
                return

    def _border(self, tag: str) -> None:
        if tag in BLOCKS:
            self.events.append((self.open[-1], None))
        elif tag in CELLS:
            self.events.append((self.open[-1], " "))

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._pop_to({"p"}, HOLDS_P)
        if tag in ENDS:
            self._pop_to(*ENDS[tag])
        self._border(tag)
        named = dict(attrs)
        words = " ".join(v for a in ATTRIBUTES if (v := named.get(a)))
        self.tags.append(tag)
        self.words.append(tuple(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", words).lower())) if words else ())
        self.marks.append(named.get("k"))
        self.parents.append(self.open[-1])
        if tag not in VOID:
            self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._border(tag)
        for i in range(len(self.open) - 1, 0, -1):
            if self.tags[self.open[i]] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.events.append((self.open[-1], data))

    def unknown_decl(self, data):
        pass


def evidence(page: Page) -> list[list[str]]:
    """Features of each element."""
    n = len(page.tags)
    chars, linked, stops = [0] * n, [0] * n, [0] * n
    hidden, in_link = [False] * n, [False] * n
    for i in range(1, n):
        p = page.parents[i]
        hidden[i] = hidden[p] or page.tags[i] in NEVER_TEXT
        in_link[i] = in_link[p] or page.tags[i] == "a"
    for i, text in page.events:
        if text and not hidden[i]:
            size = len(text.strip())
            chars[i] += size
            linked[i] += size if in_link[i] else 0
            stops[i] += text.count(".") + text.count(",")
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
    out = []
    for i in range(n):
        share = linked[i] / chars[i] if chars[i] else 0.0
        size = 0 if not chars[i] else 1 if chars[i] < 40 else 2 if chars[i] < 150 else 3
        found = [f"tag {page.tags[i]}", f"links {0 if share < 0.1 else 1 if share < 0.6 else 2}", f"size {size} {min(2, stops[i])}"]
        out.append(found + [f"word {w}" for w in page.words[i]])
    return out


# Elements that may begin or end an article; others mostly go with what they stand in.
CARRIERS = frozenset("article main section div aside nav header footer form ul ol table body td".split())


def edge_kind(tag: str) -> int:
    return 1 if tag in CARRIERS else 0


class ContentModel:
    """Log potentials of elements and edges."""

    def __init__(self, nodes: dict[str, tuple[float, float]], edges: dict[tuple[int, int, int], float]):
        self.nodes, self.edges = nodes, edges

    @classmethod
    def trained(cls, pages: tuple[str, ...], smoothing: float = 0.5) -> ContentModel:
        seen, edges, totals = (Counter(), Counter()), Counter(), Counter()
        kinds: dict[str, set[str]] = {}
        for html in pages:
            page = Page(html)
            labels = [0]
            for i in range(1, len(page.tags)):
                mark = page.marks[i]
                labels.append(int(mark) if mark else labels[page.parents[i]])
                edges[labels[page.parents[i]], labels[i], edge_kind(page.tags[i])] += 1
            for label, found in zip(labels, evidence(page), strict=True):
                for f in found:
                    seen[label][f] += 1
                    kinds.setdefault(f.split()[0], set()).add(f)
                    totals[label, f.split()[0]] += 1
        nodes = {
            f: tuple(math.log((seen[c][f] + smoothing) / (totals[c, kind] + smoothing * (len(known) + 1))) for c in (0, 1))
            for kind, known in kinds.items()
            for f in known
        }
        table = {
            (p, c, k): math.log((edges[p, c, k] + smoothing) / (edges[p, 0, k] + edges[p, 1, k] + 2 * smoothing))
            for p in (0, 1) for c in (0, 1) for k in (0, 1)
        }
        return cls(nodes, table)

    def marginals(self, page: Page) -> list[float]:
        """Probability of content for each element, by sum-product: messages from the leaves up, then from the root down.

        Children come after their parents, so one pass over the elements backwards and one forwards carry all messages.
        """
        n, unseen = len(page.tags), (0.0, 0.0)
        odds = []  # of each element's own evidence, as log potentials of the two labels
        for found in evidence(page):
            zero = one = 0.0
            for f in found:
                a, b = self.nodes.get(f, unseen)
                zero, one = zero + a, one + b
            odds.append((zero, one))
        edge = self.edges
        belief = [list(o) for o in odds]
        up: list[tuple[float, float]] = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):
            zero, one = belief[i]
            k = edge_kind(page.tags[i])
            up[i] = (log_sum(edge[0, 0, k] + zero, edge[0, 1, k] + one), log_sum(edge[1, 0, k] + zero, edge[1, 1, k] + one))
            parent = belief[page.parents[i]]
            parent[0] += up[i][0]
            parent[1] += up[i][1]
        belief[0][1] -= 50.0  # the page as a whole is no content
        out = [0.0] * n
        for i in range(n):
            if i:
                k = edge_kind(page.tags[i])
                parent = belief[page.parents[i]]
                zero, one = parent[0] - up[i][0], parent[1] - up[i][1]
                belief[i][0] += log_sum(edge[0, 0, k] + zero, edge[1, 0, k] + one)
                belief[i][1] += log_sum(edge[0, 1, k] + zero, edge[1, 1, k] + one)
            top = max(belief[i])
            belief[i] = [belief[i][0] - top, belief[i][1] - top]
            out[i] = math.exp(belief[i][1] - log_sum(*belief[i]))
        return out


def log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


@functools.lru_cache(maxsize=2)
def model(pages: tuple[str, ...] = LABELLED_PAGES) -> ContentModel:
    return ContentModel.trained(pages)


def main_text(html: str | None, content: ContentModel) -> str:
    """Blocks of the content elements in page order, one line each."""
    if not html:
        return ""
    page = Page(html)
    likely = content.marginals(page)
    hidden = [False] * len(page.tags)
    for i in range(1, len(page.tags)):
        hidden[i] = hidden[page.parents[i]] or page.tags[i] in NEVER_TEXT
    blocks, block = [], []
    for i, text in [*page.events, (0, None)]:
        if text is None:
            if block and (line := WHITE.sub(" ", "".join(block)).strip()):
                blocks.append(line)
            block = []
        elif likely[i] >= 0.5 and not hidden[i]:
            block.append(text)
    return "\n".join(blocks)


def extract(df: DataFrame, html: str = "html", text: str = "text", pages: tuple[str, ...] = LABELLED_PAGES) -> DataFrame:
    """``df`` with the main text of each page as ``text`` and its length in code points as ``n_chars``. No shuffle."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        content = model(pages)
        found = [main_text(h.as_py(), content) for h in batch.column(html)]
        return with_columns(batch, **{text: pa.array(found, pa.string()), "n_chars": pa.array([len(t) for t in found], pa.int64())})

    return map_batches(df, schema_with(df, **{text: "string", "n_chars": "long"}), rows)
