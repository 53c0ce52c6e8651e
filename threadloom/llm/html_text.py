"""Main text of web pages from flat text blocks.

A page is cut into flat blocks of text at its block-level tags. Each block is
described by its words and link density, those of the blocks before and after
it, and where it stands (innermost container that says something: article or
surroundings; whether the page marks an article at all; heading). A decision
tree learned from the small labelled table of `LABELLED_PAGES` says which blocks
are main text. The tree is learned on the driver from some dozens of rows; pages
are worked off where they are, without a shuffle.

Defined results: a null or empty page has an empty text; character references
are decoded, unknown ones stay; white space in a block is one space, blocks are
joined by one line end in page order; unclosed tags end with what encloses them;
an unclosed comment, script or style reaches to the end; a tag cut off by the
end of the page is dropped; a "<" that opens no tag is text; repeated rows give
repeated result rows; ids and urls may be null; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches
from .registry import query, table

# Element names by role.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul option select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
AROUND = frozenset("nav header footer aside form menu dialog select button label fieldset".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id or role that mark surroundings or main text.
AROUND_WORDS = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer login masthead menu menubar modal nav navbar navigation newsletter popup promo promoted related replies respond sharing sidebar signup sponsored subscribe subscription toolbar widget complementary contentinfo".split())
# Words that do so only at the end of a name: a site-header is one, a header-image is not.
AROUND_LAST = frozenset("header notice notices promotion reader search share social sponsor dialog alert".split())
MAIN_WORDS = frozenset("article articlebody story post entry maintext bodytext".split())
# A name that begins with one of these says what goes with the element, not what it is.
SAYS_NOTHING = frozenset("has no not with without is hide show".split())

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*|[^>]*)(?P<close>>|\Z)",
    re.DOTALL,
)
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none""", re.IGNORECASE)
_PARTS = re.compile(r"[a-zA-Z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    hint: int  # of the innermost container that gives one: 1 main text, -1 surroundings, 0 none
    heading: int
    container: int  # which container that is
    by_name: bool  # whether it is an article or main element


def _says(name: str) -> int:
    """What one class, id or role says: 1 main text, -1 surroundings, 0 nothing."""
    parts = [p.lower() for p in _PARTS.findall(_CAMEL.sub(" ", name))]
    if not parts or len(parts) > 1 and parts[0] in SAYS_NOTHING:
        return 0
    if not AROUND_WORDS.isdisjoint(parts) or parts[-1] in AROUND_LAST:
        return -1
    return int(not MAIN_WORDS.isdisjoint(parts))


def _hint(name: str, attrs: str) -> int:
    if name in AROUND:
        return -1
    said = 0
    if attrs:
        if "hid" in attrs.lower() and _HIDDEN.search(attrs) or "none" in attrs and _HIDDEN.search(attrs):
            return -1
        for value in _MARKS.findall(attrs):
            for one in value.strip("\"'").split():
                says = _says(one)
                if says < 0:
                    return -1
                said |= says
    return 1 if said or name in MAIN else 0


def blocks_of(page: str) -> list[Block]:
    """The flat blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, int, bool]]] = []  # open elements with the hint that holds inside, and whose it is
    containers = 0
    opened: Counter = Counter()  # how many of each name are open, so that an end tag of none costs nothing
    parts: list[tuple[str, bool]] = []
    links = 0
    at = 0

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                linked = sum(len(p.split()) for p, inside in parts if inside)
                heading = int(any(name in HEADINGS for name, _ in stack[-3:]))
                hint, container, by_name = stack[-1][1] if stack else (0, 0, False)
                out.append(Block(text, len(text.split()), linked, hint, heading, container, by_name))
            parts = []

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            lt = len(page)
        if lt > at:
            parts.append((references.unescape(page[at:lt]), links > 0))
        if lt == len(page):
            break
        token = _TOKEN.match(page, lt)
        if token is None:
            parts.append(("<", links > 0))
            at = lt + 1
            continue
        at = token.end()
        if token["name"] is None or not token["close"]:
            continue
        name = token["name"].lower()
        if token["end"]:
            if name in BLOCK:
                flush()
            if opened[name]:
                while True:
                    n, _ = stack.pop()
                    opened[n] -= 1
                    links -= n == "a"
                    if n == name:
                        break
            continue
        if name == "br":
            parts.append((" ", False))
            continue
        if name in BLOCK:
            flush()
            while stack and stack[-1][0] == "p" or name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                opened[stack.pop()[0]] -= 1
        if name in RAW:
            if not token["attrs"].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name not in VOID:
            own = _hint(name, token["attrs"])
            containers += own != 0
            stack.append((name, (own, containers, name in MAIN) if own else stack[-1][1] if stack else (0, 0, False)))
            opened[name] += 1
            links += name == "a"
    flush()
    return out


FEATURES = ("hint", "page has an article", "heading", "words", "link density", "words before", "link density before", "words after", "link density after")


def features_of(blocks: list[Block]) -> np.ndarray:
    """One row of `FEATURES` for each block; beyond the ends of a page are no words."""
    # A page marks its article by an element, or by a name of what holds several blocks.
    several = {c for c, n in Counter(b.container for b in blocks).items() if n > 1}
    marked = float(any(b.hint > 0 and (b.by_name or b.container in several) for b in blocks))
    own = [(float(b.words), b.linked / b.words) for b in blocks]
    around = [(0.0, 0.0), *own, (0.0, 0.0)]
    return np.array([[b.hint, marked, b.heading, *own[i], *around[i], *around[i + 2]] for i, b in enumerate(blocks)]).reshape(-1, len(FEATURES))


# Labelled table ----------------------------------------------------------------------------------------------------------

#: Pages written for this purpose. {n} stands for n words, [n] for n words in a link; a block that begins with + is main text.
LABELLED_PAGES = (
    "<title>{4}</title><nav><ul><li>[1]<li>[2]<li>[1]</ul></nav><div class=ad>{9}</div><article><h1>+{6}</h1><p>+{60}<p>+{3}<p>+{25}[3]</article><footer>{8}</footer>",
    "<header><h1>{3}</h1>[1] [1]</header><main><h2>+{5}</h2><p>+{90}<p>+{12}<div class='related-posts'><h3>{2}</h3><ul><li>[6]<li>[8]</ul></div><p>+{40}</main><aside>{30}</aside>",
    "<div id=menu>[1] [1] [2]</div><div class='post'><p>+{1}<p>+{2}<p>+{140}<ul><li>+{7}<li>+{9}</ul></div><div id='comments'><p>{35}<p>{20}</div>",
    "<div>[1] [1] [1] [1]</div><div>{4}</div><h1>+{7}</h1><p>+{55}</p><p>+{80}</p><p>+{15}[2]</p><div>[3] [4] [3]</div><div>{6}</div>",
    "<table><tr><td>[2]<td>[1]<td>[1]</table><p>+{35}<p>+{11}<p>+{48}<hr><p>{5}[2]",
    "<article><h1>+{2}</h1><p>+{1}</article><form><label>{2}</label><p>{25}</p></form><div class=cookie-notice><p>{28}[1]</div>",
    "<section class=sidebar><p>{40}<p>{22}</section><article><p>+[4]<p>+{18}<section class=comments><p>{50}</section><p>+{2}</article>",
    "<div>[2]</div><div>[3]</div><div>[2]</div><h2>+{4}</h2><div>+{70}</div><div>+{33}[5]</div><div>[2]</div><div>[1]</div><div>{3}</div>",
    "<article><p>+{8}<blockquote>+{14}</blockquote><pre>+{5}</pre><footer>{9}</footer><p>+{21}</article><div>{45}</div><div>{12}</div>",
    "<h1>+{8}</h1><p>+{30}<p>+{12}<p>+{6}<p>+{44}<ul><li>[2]<li>[3]</ul>",
    "<div>[1] [2]</div><p>+{15}<p>+{9}[1]<p>+{27}<p>+{70}<div>{3}</div><div>[3]</div>",
    "<div>{2}</div><h1>+{5}</h1><p>+{10}<p>+{120}<p>+{8}<p>+{16}<div>[2] [2] [2]</div><div>{4}</div>",
    "<p>[5]</p><div>+{20}</div><div>+{10}</div><div>+{13}</div><div>[1]</div>",
    "<p>{60}</p><p>{15}</p><article><p>+{4}<p>+{30}</article><p>{50}</p><p>{20}</p>",
    "<p>{18}[1]</p><main><p>+{150}<p>+[2]</main><p>{80}</p><p>{9}</p>",
    "<p>{2}</p><article><h1>+{9}</h1><h2>+{3}</h2><p>+[1]<p>+{200}</article><p>{30}</p><p>[4]</p>",
    "<nav>[1] [1]</nav><p>+{60}<p>+{45}<div id=comments><p>{30}<p>{40}</div><footer>{30}</footer><div class=cookie-notice>{30}</div>",
    "<aside class=sidebar><p>{30}</aside><h1>+{5}</h1><p>+{80}<form><p>{30}</form><p>+{30}<footer><p>{12}[1]</footer>",
    "<header>{6}</header><div class=cookie-banner><p>{22}<p>{4}</div><div><p>+{25}<p>+{50}<p>+{9}</div><section class=comments><h3>{1}</h3><p>{60}<p>{18}</section>",
    "<nav>[1] [1] [1]</nav><article><h1>+{11}</h1><p>+{17}<p>+{143}<p>+{31}<p>+{189}<p>+{43}<p>+{51}<p>+{22}<p>+{11}</article><footer>{11}</footer>",
    "<div>{9}</div><main><h1>+{7}</h1><p>+{968}<p>+{9}<p>+{400}<p>+{5}<p>+{240}<p>+[6]<p>+{75}<p>+{300}<p>+{2}<p>+{62}</main><div>{38}</div><footer>{7}</footer>",
    "<p>{33}<article><p>+{600}<p>+{13}<h2>+{2}</h2><p>+{38}<p>+{96}<p>+{1}<p>+{170}<p>+{29}<p>+{220}[9]</article><p>{70}",
    "<div>[1] [2] [1]</div><h1>+{6}</h1><p>+{24}<p>+{90}<p>+{31}", "<ul><li>[1]<li>[2]</ul><div>+{64}</div><div>+{18}</div><div>+{52}</div>",
    "<div class=newsletter>{15}</div><h2>+{6}</h2><p>+{33}<aside>{45}</aside><p>+{70}<div class=related><p>{14}<p>{25}</div>",
)


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of `LABELLED_PAGES`."""
    rows, labels = [], []
    for page in LABELLED_PAGES:
        page = re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), page)
        page = re.sub(r"\[(\d+)\]", lambda m: " <a href=x>" + " ".join(["word"] * int(m[1])) + "</a>", page)
        blocks = blocks_of(page.replace("+", "+ "))
        for b in blocks:
            main = b.text.startswith("+")
            labels.append(main)
            b.words -= main
            b.words = max(b.words, 1)
        rows.append(features_of(blocks))
    return np.concatenate(rows), np.array(labels)


# Decision tree -----------------------------------------------------------------------------------------------------------


def learn_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 8) -> tuple | bool:
    """Binary tree by Gini impurity: (feature, threshold, tree up to it, tree above it), or the label of a leaf.

    Of equal splits the first feature and the lowest threshold are taken.
    """
    if depth == 0 or labels.all() or not labels.any():
        return bool(2 * labels.sum() >= len(labels))
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = rows[:, f] <= cut
            impurity = sum(part.sum() * (1 - part.mean()) for part in (labels[low], labels[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, float(cut)
    if best is None:
        return bool(2 * labels.sum() >= len(labels))
    _, f, cut = best
    low = rows[:, f] <= cut
    return f, cut, learn_tree(rows[low], labels[low], depth - 1), learn_tree(rows[~low], labels[~low], depth - 1)


def decide(tree: tuple | bool, row: np.ndarray) -> bool:
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree


def main_text(page: str | None, tree: tuple | bool) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, row in zip(blocks, features_of(blocks)) if decide(tree, row))


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns as struct `row`, `text` and its length `n_chars` of every page."""
    tree = learn_tree(*labelled_table())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p, tree) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["row", "text", "n_chars"])

    packed = pages.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(html).cast("string").alias("html"))
    return map_batches(packed, work, f"row {packed.schema['row'].dataType.simpleString()}, text string, n_chars long")


@query("op3_html_text")
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages")).select(F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), "text", "n_chars")
