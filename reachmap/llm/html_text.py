"""Main text of web pages by a linear-chain conditional random field over the DOM's leaf blocks.

A page is read once, in linear time, with a stack of open elements. Its leaf blocks are the
stretches of text between block-level tags; each has the features of its ancestors (tag names, words
of class, id and role) and of its text (length, link density, ending, words). A field with one
weight a feature and four for neighbouring labels tells main text from the rest; it is trained by
gradient ascent on the log-likelihood of labelled pages, and Viterbi picks the labels of a page.

The labelled pages are made here by ``labelled_pages``: page layouts filled with random words, whose
article paragraphs are marked. They stand for the common ways to write menus, headers, sidebars,
notices, adverts, forms, comments and footers around or within an article. Training takes a few
seconds on the driver and is the same in every run.

Text is decoded (character references), its white space becomes single spaces within a block, and
main blocks are joined by a line end in page order. Comments, scripts, styles, templates, frames and
what stands for missing scripts are no text and end no block. A comment or one of these that never ends goes to the end of the page.
Formulas are text within their block; media, drawings and embedded objects are elements like others, so the field judges what they hold.

Defined results: a null or empty page, and one without main blocks, has the empty text; repeated
rows are read alike; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by their role in the tree.
RAW = frozenset("script style noscript template iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup "
    "msup mtable mtd mtext mtr munder munderover semantics annotation annotation-xml".split()
)
CLOSES = {  # a start tag ends an open element of these names, unless one of the bounds is nearer
    "li": ("li", "ul ol menu"), "p": ("p", "article aside section div main td th li body"), "tr": ("tr", "table"), "td": ("td th", "tr table"),
    "th": ("td th", "tr table"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"),
}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_COMMENT_END = re.compile(r"(?<=<!--)-?>|--!?>")  # ``<!-->`` and ``<!--->`` are whole comments
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


@dataclass
class Block:
    """A leaf block: its text, the names and words of its ancestors, and how much of it is linked."""

    text: str
    path: tuple[tuple[str, str], ...]
    linked: int


def leaf_blocks(page: str) -> list[Block]:
    """The page's leaf blocks with visible text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    held: list[str] = []
    state = {"linked": 0, "path": ()}
    never = {'"': False, "'": False}  # this quote is known not to occur any more

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append(Block(text, state["path"], state["linked"]))
        held.clear()
        state["linked"] = 0

    def add(text: str) -> None:
        if not text:
            return
        text = html.unescape(text)
        if not text.isspace():
            if not any(not h.isspace() for h in held):
                state["path"] = tuple(stack)
            if any(name == "a" for name, _ in stack):
                state["linked"] += len(text)
        held.append(text)

    def end_of_tag(at: int) -> int:
        """The place of the tag's closing bracket, quoted values skipped; -1 if there is none."""
        while True:
            found = _STOP.search(page, at)
            if not found:
                return -1
            if found[0] == ">":
                return found.start()
            quote = found[0]
            closing = -1 if never[quote] else page.find(quote, found.end())
            never[quote] |= closing < 0
            at = found.end() if closing < 0 else closing + 1

    def close(names: str, bounds: str) -> None:
        wanted, limits = names.split(), bounds.split()
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in wanted:
                del stack[depth:]
                return
            if stack[depth][0] in limits:
                return

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        at = start + 1
        if page.startswith("!--", at):
            found = _COMMENT_END.search(page, at + 3)
            at = found.end() if found else size
            continue
        if at < size and page[at] in "!?":
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        closing = page.startswith("/", at)
        name = _NAME.match(page, at + closing)
        if not name:
            add("<")
            continue
        end = end_of_tag(name.end())
        if end < 0:  # a tag cut off by the end of the page
            break
        tag, attributes = name[0].lower(), page[name.end() : end]
        at = end + 1
        if tag in INLINE or tag == "br":
            if tag == "br":
                held.append(" ")
            elif closing:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == tag:
                        del stack[depth]
                        break
                    if stack[depth][0] not in INLINE:
                        break
            elif tag not in VOID:
                stack.append((tag, _labels(attributes)))
            continue
        if tag in RAW and not attributes.endswith("/"):  # neither its text nor its tags end a block
            if not closing:
                found = _raw_end(tag).search(page, at)
                at = found.end() if found else size
            continue
        flush()
        if closing:
            if any(open_tag == tag for open_tag, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in ENDS_P:
            close(*CLOSES["p"])
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag not in VOID:  # a slash at its end doesn't close an element
            stack.append((tag, _labels(attributes)))
    flush()
    return out


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def _labels(attributes: str) -> str:
    if "=" not in attributes:
        return ""
    return " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(attributes))


def path_features(path: tuple[tuple[str, str], ...]) -> set[str]:
    found = set()
    for tag, labels in path:
        found.add(f"tag {tag}")
        for word in _WORDS.findall(labels) if labels else ():
            found.add(f"label {word.lower()}")
    blocks = [tag for tag, _ in path if tag not in INLINE]
    found.add(f"own {blocks[-1] if blocks else 'none'}")
    return found


# Words that stand in notices, menus and footers more often than in articles.
SIGNS = frozenset("cookie cookies copyright subscribe newsletter login comments reply privacy advertisement sponsored menu share".split())


def text_features(block: Block) -> set[str]:
    n, text = len(block.text), block.text
    found = {f"length {min(int(math.log2(n)), 9)}", f"linked {min(4 * block.linked // n, 4)}", f"ends {text[-1] in '.!?:;' + chr(8221) + chr(34)}"}
    if "©" in text:
        found.add("sign (c)")
    if n < 400:
        found |= {f"sign {w}" for w in set(re.findall(r"[a-z]+", text.lower())) & SIGNS}
    return found


@dataclass
class Chain:
    """A field with two labels: weights of features for label 1 over 0, and of label pairs."""

    weights: dict[str, float] = field(default_factory=dict)
    pairs: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])
    paths: dict = field(default_factory=dict)

    def scores(self, blocks: list[Block]) -> list[float]:
        get, out = self.weights.get, []
        for block in blocks:
            of_path = self.paths.get(block.path)
            if of_path is None:
                if len(self.paths) > 20_000:
                    self.paths.clear()
                of_path = self.paths[block.path] = sum(get(f, 0.0) for f in path_features(block.path))
            out.append(of_path + sum(get(f, 0.0) for f in text_features(block)))
        return out

    def viterbi(self, scores: list[float]) -> list[int]:
        """The most likely labels."""
        (a, b), (c, d) = self.pairs
        zero, one, back = 0.0, 0.0, []
        for i, s in enumerate(scores):
            if i == 0:
                zero, one = 0.0, s
                continue
            to_zero, to_one = (zero + a, 0) if zero + a >= one + c else (one + c, 1), (zero + b, 0) if zero + b > one + d else (one + d, 1)
            back.append((to_zero[1], to_one[1]))
            zero, one = to_zero[0], to_one[0] + s
        labels = [int(one > zero)] if scores else []
        for came in reversed(back):
            labels.append(came[labels[-1]])
        return labels[::-1]


def _log_add(x: float, y: float) -> float:
    top = max(x, y)
    return top + math.log(math.exp(x - top) + math.exp(y - top))


def _marginals(chain: Chain, scores: list[float]) -> tuple[list[float], list[list[float]]]:
    """(probability of label 1 of each block, expected counts of label pairs)."""
    p, n = chain.pairs, len(scores)
    forward = [[0.0, scores[0]]]
    for s in scores[1:]:
        f = forward[-1]
        forward.append([_log_add(f[0] + p[0][0], f[1] + p[1][0]), _log_add(f[0] + p[0][1], f[1] + p[1][1]) + s])
    backward = [[0.0, 0.0]]
    for s in reversed(scores[1:]):
        g = backward[-1]
        backward.append([_log_add(p[0][0] + g[0], p[0][1] + s + g[1]), _log_add(p[1][0] + g[0], p[1][1] + s + g[1])])
    backward.reverse()
    total = _log_add(*forward[-1])
    ones = [math.exp(forward[i][1] + backward[i][1] - total) for i in range(n)]
    pairs = [[0.0, 0.0], [0.0, 0.0]]
    for i in range(1, n):
        for x in (0, 1):
            for y in (0, 1):
                pairs[x][y] += math.exp(forward[i - 1][x] + p[x][y] + (scores[i] if y else 0.0) + backward[i][y] - total)
    return ones, pairs


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = 12, rate: float = 0.25, decay: float = 1e-3) -> Chain:
    """Stochastic gradient ascent on the regularized log-likelihood, one page at a time, with per-weight steps."""
    chain = Chain()
    squares: dict[str, float] = {}
    order = random.Random(5)
    data = [([path_features(b.path) | text_features(b) for b in blocks], labels) for blocks, labels in pages if blocks]
    pair_squares = [[1e-6] * 2 for _ in range(2)]
    for _ in range(epochs):
        order.shuffle(data)
        for found, labels in data:
            ones, expected = _marginals(chain, [sum(chain.weights.get(f, 0.0) for f in fs) for fs in found])
            slope: dict[str, float] = {}
            for fs, label, one in zip(found, labels, ones, strict=True):
                for f in fs:
                    slope[f] = slope.get(f, 0.0) + label - one
            for f, g in slope.items():
                w = chain.weights.get(f, 0.0)
                g -= decay * w
                squares[f] = squares.get(f, 1e-6) + g * g
                chain.weights[f] = w + rate * g / math.sqrt(squares[f])
            for before, after in zip(labels, labels[1:], strict=False):
                expected[before][after] -= 1
            for x in (0, 1):
                for y in (0, 1):
                    g = -expected[x][y] - decay * chain.pairs[x][y]
                    pair_squares[x][y] += g * g
                    chain.pairs[x][y] += rate * g / math.sqrt(pair_squares[x][y])
    return chain


_MARK = "\ue000"  # begins each main block of a labelled page


def labelled_pages(n: int = 500, seed: int = 11) -> Iterator[tuple[list[Block], list[int]]]:
    """Pages in common layouts: blocks and their labels, 1 for main text."""
    r = random.Random(seed)
    for _ in range(n):
        blocks = leaf_blocks(_page(r))
        labels = [int(b.text.startswith(_MARK)) for b in blocks]
        yield [Block(b.text.removeprefix(_MARK), b.path, b.linked) for b in blocks], labels


def _page(r: random.Random) -> str:
    def words(low: int, high: int) -> str:
        made = ["".join(r.choice("ba de ri mo tu sen lar kop ing the an er".split()) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        return " ".join(made).capitalize()

    def sentence(low: int = 3, high: int = 25) -> str:
        return words(low, high) + r.choice(". . . . ! ? , %%% !! |".split(" "))

    def links(low: int = 2, high: int = 8, item: str = "li") -> str:
        return "".join(f'<{item}><a href="/{i}">{words(1, 3)}</a></{item}>' for i in range(r.randint(low, high)))

    def labelled(tag: str, names: str, inside: str) -> str:
        kind = r.choice(["class", "class", "id"])
        return f'<{tag} {kind}="{r.choice(names.split())}">{inside}</{tag}>'

    def p(low: int = 1, high: int = 5) -> str:
        return "".join(f"<p>{sentence()}</p>" for _ in range(r.randint(low, high)))

    menu = lambda: r.choice([f"<nav><ul>{links()}</ul></nav>", labelled("div", "menu nav navbar top-menu breadcrumbs breadcrumb navigation", f"<ul>{links()}</ul>"), f'<div role="navigation">{links(2, 6, "span")}</div>'])
    head = lambda: r.choice(["", f"<header><div>{words(1, 4)}</div>{menu()}</header>", labelled("div", "header masthead site-header topbar banner", f"<p>{words(1, 6)}</p>"), f"<header><h1>{words(1, 3)}</h1><p>{sentence()}</p></header>"])
    advert = lambda: r.choice(["", labelled("div", "ad ads advert advertisement sponsored promo banner-ad ad-slot", sentence()), labelled("aside", "ad promo sponsor", p(1, 2)), f"<ins class='adsbygoogle'>{sentence()}</ins>"])
    notice = lambda: r.choice(["", labelled("div", "cookie-notice cookies consent gdpr notice alert banner modal popup cookie-banner", f"<p>{sentence()} cookies {sentence()}</p><button>{words(1, 2)}</button>"), f'<div role="alert">{sentence()}</div>', f'<div class="notice"><p>{sentence()}</p></div>'])
    side = lambda: r.choice(["", f"<aside><h3>{words(1, 3)}</h3><ul>{links()}</ul></aside>", f"<aside>{p(1, 3)}</aside>", labelled("div", "sidebar side widget related recommended related-posts sidebar-left rail", f"<h3>{words(1, 3)}</h3>{r.choice([p(1, 3), f'<ul>{links()}</ul>'])}")])
    form = lambda: r.choice(["", f"<form><label>{words(1, 4)}</label><input name=x><button>{words(1, 2)}</button></form>", f"<form class='newsletter'><p>{sentence()}</p><select><option>{words(1, 2)}<option>{words(1, 2)}</select></form>", f"<form id='search'><p>{sentence()}</p><textarea>{words(1, 5)}</textarea></form>"])
    share = lambda: r.choice(["", labelled("div", "share social sharing share-buttons social-links", links(2, 5, "span"))])
    one = lambda: r.choice([f"<p>{sentence(3, 40)}</p>", f"<div class='comment'><p>{sentence(3, 40)}</p><span>{words(1, 3)}</span></div>", f"<li class='comment'><div>{sentence(3, 40)}</div>"])
    comments = lambda: r.choice(["", "", labelled(r.choice(["div", "section", "ol", "ul"]), "comments comment-list discussion responses commentlist reader-comments disqus replies", f"<h3>{words(1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 6))))])
    foot = lambda: r.choice([f"<footer>&copy; {words(1, 3)} &middot; {sentence()} {sentence(1, 6)}</footer>", f"<footer><p>{sentence()}</p><ul>{links()}</ul></footer>", labelled("div", "footer site-footer bottom copyright colophon legal", f"<p>{sentence()}</p>"), ""])

    def main_block() -> str:
        text = _MARK + r.choice([sentence(1, 3), sentence(5, 60), " ".join(sentence() for _ in range(r.randint(2, 12)))])
        if r.random() < 0.1:
            text += r.choice([" All rights reserved.", " Released under the License.", " &copy; 2020", " privacy and cookies", ' <a href="/x">more</a>', f' <a href="/y">{words(2, 12)}</a>'])
        return r.choice(
            [f"<p>{text}</p>"] * 12 + [f"<p><b>{text}<br>", f"<h2>{text}</h2>", f"<ul><li>{text}</li><li>{_MARK}{sentence()}</li></ul>", f"<blockquote>{text}</blockquote>", f"<div>{text}</div>", f"<pre>{text}</pre>", f"<figure><img src=x><figcaption>{text}</figcaption></figure>", f"<table><tr><td>{text}</td></tr></table>"]
        )

    inner = f"<h1>{_MARK}{r.choice([words(2, 8), sentence()])}</h1>" if r.random() < 0.8 else ""
    for _ in range(r.randint(1, 14)):
        inner += main_block()
        if r.random() < 0.12:
            inner += r.choice([advert, side, form, share, notice, menu])()
    if r.random() < 0.2:
        inner += r.choice([share(), comments(), foot() if r.random() < 0.3 else ""])
    holder = r.choice(["article"] * 5 + ["main", "div id=content", "div class=post-body", "div class=entry-content", "div class=article-body", "section class=story", "div id=main-content", "div class='article content'", "main><article"])
    ends = "".join(f"</{part.split()[0]}>" for part in reversed(holder.split("><")))
    body = notice() + head() + r.choice(["", menu()]) + advert() + r.choice(["", side()]) + f"<{holder}>{inner}{ends}" + r.choice(["", side()]) + advert() + form() + comments() + notice() + foot()
    if r.random() < 0.3:
        body = f"<div class='{r.choice(['wrapper', 'container', 'page', 'site', 'layout'])}'>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><script>var a='</p>';</script><style>p{{}}</style></head><body>{body}" + r.choice(["</body></html>", ""])


@lru_cache(maxsize=1)
def trained() -> Chain:
    """The field learned from the labelled pages."""
    return train(list(labelled_pages()))


def main_text(page: str | None, chain: Chain) -> str:
    blocks = leaf_blocks(page or "")
    labels = chain.viterbi(chain.scores(blocks))
    return "\n".join(block.text for block, label in zip(blocks, labels, strict=True) if label)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    field_ = chain or trained()

    @F.arrow_udf("string")
    def text_of(column: pa.Array) -> pa.Array:
        return pa.array([main_text(page, field_) for page in column.to_pylist()], pa.string())

    rows = pages.select("page_id", "url", text_of(F.col("html").cast("string")).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
