"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree.

A page is read into its leaf blocks: stretches of text between the borders of block elements, with the elements around
them. A block has features of its ancestors (tags, and words of their classes, ids and roles by kind) and of its text
(length, links, punctuation, tell-tale words, place). The field has two labels, main text and the rest; the weights of
transitions depend on how two neighbours lie in the tree. It is fitted on the driver on pages that `html_pages` makes
with known labels, in many layouts and made-up languages, by gradient ascent on the likelihood (forward and backward
sums), and blocks are labelled by Viterbi's algorithm. Each page is one row's work; nothing is shuffled.

What is never text is not a block at all: head, scripts, styles, comments and form fields. Character references are
decoded, white space within a block is one space, and blocks that are kept are joined by newlines.

Reading is linear in a page's length, whatever it holds. A tag without an end runs to the end of the page; a quote that
doesn't end in an attribute ends with the tag. Elements left open are closed as their parents are.

Defined results: null and empty pages, and pages without main text, give an empty text; rows of the same id are rows like
others; an empty table gives an empty table; columns other than id, url and html are left behind.
"""

from __future__ import annotations

import functools
import html as entities
import itertools
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm._shared import in_batches, rows
from formloom.llm.html_pages import MARK, made_pages

# Names of elements by what they do to text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head script style noscript template textarea title xmp iframe noembed noframes object svg math canvas audio video select datalist".split())
#: Of these nothing is markup until their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes these, if they are open nearer than those.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")),
}
#: Tags whose presence among the ancestors is a feature.
ANCESTORS = ("article", "main", "section", "aside", "nav", "header", "footer", "form", "ul", "ol", "dl", "table", "blockquote", "pre", "figure", "figcaption", "details", "dialog", "address", "button", "label", "menu", "h1", "h2", "h3", "p", "li")
#: Words in classes, ids and roles, by what they tell.
WORDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs skip toplinks sitemap links",
    "head": "header masthead topbar branding logo hero contentinfo",
    "foot": "footer foot colophon bottom copyright legal imprint disclaimer",
    "side": "sidebar side aside rail widget widgets complementary related recommended recommendations trending popular more teaser teasers promoted suggestions",
    "ad": "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion adsense dfp outbrain taboola",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay dialog toast announcement warning paywall privacy notification",
    "form": "form subscribe subscription newsletter signup signin login register search searchbox contact field input",
    "comment": "comment comments commentlist reply replies respond discussion disqus thread reviews feedback responses",
    "share": "share sharing social follow addthis toolbar tools print rating",
    "about": "meta byline author tags tag date time info bio credit",
    "text": "article post entry story content main body text maincontent articlebody postcontent entrycontent prose richtext hentry page document",
}
#: Words and, with blanks, phrases of short texts, by what they tell.
TELLING = {
    "legal": ("©", "copyright", "imprint", "impressum", "all rights reserved", "terms of", "privacy policy"),
    "consent": ("cookie", "cookies", "consent", "gdpr"),
    "join": ("subscribe", "newsletter", "signup", "login", "register", "password", "sign up", "sign in", "log in", "your email", "your e-mail"),
    "share": ("share", "tweet", "facebook", "twitter", "pinterest", "follow us"),
    "reply": ("comment", "comments", "reply", "replies", "says:", "said:", "wrote:", "hours ago", "days ago", "minutes ago"),
    "ad": ("advertisement", "advertise", "advertising", "sponsored", "promoted", "buy now", "% off", "special offer"),
    "menu": ("home", "contact", "sitemap", "menu", "previous", "next", "skip to", "about us"),
    "more": ("related", "popular", "trending", "read more", "see also", "you may also"),
}
_KIND = {w: k for k, ws in WORDS.items() for w in ws.split()}
_KINDS = tuple(WORDS)
_BIT = {t: 1 << i for i, t in enumerate(ANCESTORS)}
_WORD_BIT = {w: 1 << (len(ANCESTORS) + _KINDS.index(k)) for w, k in _KIND.items()}
#: What tells that text isn't main text, whole pages in forms aside.
_APART = _BIT["aside"] | _BIT["nav"] | _BIT["footer"] | _BIT["dialog"] | sum({_WORD_BIT[w] for w, k in _KIND.items() if k not in ("form", "about", "text")})
_HIDDEN = 1 << (len(ANCESTORS) + len(_KINDS))
_PARENTS = tuple(sorted(BLOCKS))

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTRIBUTES = re.compile(r"(?:^|[\s/\"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPLIT = re.compile(r"[a-z]+|[A-Z][a-z]*")
_PLAIN = re.compile(r"[a-z]+|©")
_SAYS = {w: k for k, ws in TELLING.items() for w in ws if _PLAIN.fullmatch(w)}
_SAYS_WORDS = frozenset(_SAYS)
_PHRASES = tuple((w, k) for k, ws in TELLING.items() for w in ws if not _PLAIN.fullmatch(w))
_SENTENCE = re.compile(r"[.!?…。！？؟][\"'”’»)]*(?:\s|$)|[。！？]")
_DIGIT = re.compile(r"\d")
_END = re.compile(r"[.!?…:;。！？؟][\"'”’»)]*$")
#: Only texts of up to so many characters are searched for tell-tale words.
SHORT = 400


@dataclass(slots=True)
class Block:
    text: str
    ancestors: int
    parent: str
    #: which element the text is in, and which that is in
    home: int
    around: int
    linked: int


@functools.lru_cache(maxsize=1 << 14)
def _own_bits(name: str, attributes: str) -> int:
    """Bits of an element: its tag, and the kinds of the words in its class, id and role."""
    bits = _BIT.get(name, 0)
    for found in _ATTRIBUTES.finditer(attributes):
        key, value = found[1].lower(), found[2] or found[3] or found[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            bits |= _HIDDEN
        elif key in ("class", "id", "role"):
            for w in _SPLIT.findall(value):
                bits |= _WORD_BIT.get(w.lower(), 0)
            for w in value.lower().split():
                bits |= _WORD_BIT.get(w, 0)
    return bits


def _decoded(text: str) -> str:
    return " ".join((entities.unescape(text) if "&" in text else text).split())


def read(page: str) -> tuple[list[Block], str]:
    """The page's leaf blocks in order, and its title."""
    blocks: list[Block] = []
    title = ""
    # open elements: name, bits with those of its ancestors, nearest block element, its number, the number of that around it
    stack: list[tuple[str, int, str, int, int]] = [("", 0, "", 0, 0)]
    places: dict[str, list[int]] = {}
    pieces: list[str] = []
    linked, silent, number, lenient = 0, 0, 0, False
    at, end = 0, len(page)

    def border() -> None:
        nonlocal linked
        if pieces:
            text = _decoded("".join(pieces))
            if text:
                _, bits, parent, home, around = stack[-1]
                blocks.append(Block(text, bits, parent, home, around, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def close(to: int) -> None:
        """Closes open elements down to a place in the stack."""
        nonlocal silent
        if any(x[0] in BLOCKS for x in stack[to:]):
            border()
        for name, *_ in reversed(stack[to:]):
            places[name].pop()
            silent -= name in DROPPED
        del stack[to:]

    def last(*names: str) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    while at < end:
        tag = page.find("<", at)
        if tag < 0:
            tag = end
        if tag > at and not silent:
            pieces.append(page[at:tag])
            if places.get("a"):
                linked += tag - at
        if tag == end:
            break
        if page.startswith("<!--", tag):
            # <!--> and <!---> are whole
            closing = page.find("-->", tag + 2)
            at = end if closing < 0 else closing + 3
            continue
        found = _NAME.match(page, tag + 1)
        if not found:
            if page[tag + 1 : tag + 2] in ("!", "?", "/"):
                closing = page.find(">", tag)
                at = end if closing < 0 else closing + 1
            else:
                if not silent:
                    pieces.append("<")
                at = tag + 1
            continue
        rest = None if lenient else _REST.match(page, found.end())
        if rest:
            at = rest.end()
        else:
            lenient = True
            closing = page.find(">", found.end())
            if closing < 0:
                break
            at = closing + 1
        name = found[0].lower()
        if name[0] == "/":
            name = name[1:]
            if places.get(name):
                close(places[name][-1])
            elif name in BLOCKS:
                border()
            continue
        if name == "br":
            pieces.append(" ")
            continue
        block = name in BLOCKS
        if block:
            border()
            if places.get("p"):
                close(places["p"][-1])
            if name in IMPLIED:
                nearer, than = IMPLIED[name]
                open_ = [n for n in nearer if places.get(n) and places[n][-1] > last(*than)]
                if open_:
                    close(min(places[n][-1] for n in open_))
            if name != "html" and places.get("head"):
                close(places["head"][-1])
        if name in VOID:
            continue
        attributes = page[found.end() : at - 1]
        if name in RAW:
            closing = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if name == "title" and not title and not places.get("svg"):
                title = _decoded(page[at : closing.start() if closing else end])
            if not closing:
                break
            at = page.find(">", closing.end())
            at = end if at < 0 else at + 1
            continue
        if attributes.endswith("/") and name in ("svg", "math", "object", "canvas", "iframe", "template"):
            continue
        _, bits, parent, home, around = stack[-1]
        number += 1
        own = bits | _own_bits(name, attributes)
        stack.append((name, own, name, number, home) if block else (name, own, parent, home, around))
        places.setdefault(name, []).append(len(stack) - 1)
        silent += name in DROPPED
    border()
    return blocks, title


_TEXT = (
    [f"length{i}" for i in range(14)] + [f"links{i}" for i in range(4)] + [f"sentences{i}" for i in range(4)] + [f"commas{i}" for i in range(3)]
    + ["ends", "digits", "lower", "capitals", "separators", "title", "heading", "prose", "short link", "most around", "most alike", "most within"] + [f"tell {k}" for k in TELLING] + [f"place{i}" for i in range(8)] + [f"in {t}" for t in _PARENTS] + ["in other", "any"]
)
_AT = {n: i for i, n in enumerate(_TEXT)}
_ANCESTOR_BITS = len(ANCESTORS) + len(_KINDS) + 1
FEATURES = len(_TEXT) + _ANCESTOR_BITS
#: How a block lies to the one before it: in the same element; under like ancestors; under some that are alike; else.
EDGES = 3


def most_text(blocks: list[Block]) -> tuple[int, int]:
    """The element, and the ancestors, around most of a page's characters outside links and outside what is told apart."""
    around, alike = Counter(), Counter()
    for b in [b for b in blocks if not b.ancestors & _APART] or blocks:
        around[b.around] += len(b.text) - b.linked
        alike[b.ancestors] += len(b.text) - b.linked
    return max(around, key=around.__getitem__, default=0), max(alike, key=alike.__getitem__, default=0)


def text_features(b: Block, i: int, n: int, title: str, most: tuple[int, int]) -> list[int]:
    """The features of the i-th of n blocks that depend on its text and place; most: as most_text has it."""
    text = b.text
    size = len(text)
    link = b.linked / size
    found = [_AT["any"], _AT["length0"] + min(13, size.bit_length()), _AT["links0"] + (0 if not b.linked else 1 if link < 0.3 else 2 if link < 0.8 else 3)]
    sentences = sum(1 for _ in itertools.islice(_SENTENCE.finditer(text), 3))
    found.append(_AT["sentences0"] + sentences)
    found.append(_AT["commas0"] + min(2, text.count(",")))
    ends = _END.search(text[-8:]) is not None
    if ends:
        found.append(_AT["ends"])
    if sentences and size >= 60 and link < 0.3:
        found.append(_AT["prose"])
    if size < 30 and link >= 0.8:
        found.append(_AT["short link"])
    if size <= SHORT:
        low = text.lower()
        found += {_AT[f"tell {k}"] for k in [_SAYS[w] for w in _SAYS_WORDS.intersection(_PLAIN.findall(low))] + [k for w, k in _PHRASES if w in low]}
        if len(_DIGIT.findall(text)) * 5 > size:
            found.append(_AT["digits"])
        if text[0].islower():
            found.append(_AT["lower"])
        if text.isupper():
            found.append(_AT["capitals"])
        if any(c in text for c in "|»›·•→"):
            found.append(_AT["separators"])
        if title and size > 3 and (title.startswith(text) or text.startswith(title)):
            found.append(_AT["title"])
    if b.around == most[0]:
        found.append(_AT["most around"])
    if b.ancestors == most[1]:
        found.append(_AT["most alike"])
    elif b.ancestors & most[1] == most[1]:
        found.append(_AT["most within"])
    if b.parent[:1] == "h" and b.parent[1:].isdigit():
        found.append(_AT["heading"])
    found.append(_AT["place0"] + (0 if i == 0 else 7 if i == n - 1 else 1 + 6 * i // n))
    found.append(_AT.get(f"in {b.parent}", _AT["in other"]))
    return found


def edge(a: Block, b: Block) -> int:
    return 0 if a.home == b.home or a.ancestors == b.ancestors else 1 if a.ancestors & b.ancestors else 2


@dataclass
class Field:
    """Weights of the features for main text (the rest's are nought), and of transitions by edge, from and to a label."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((EDGES, 2, 2)))

    def __post_init__(self):
        self.text, self.bits = self.weights[: len(_TEXT)].tolist(), self.weights[len(_TEXT) :].tolist()
        self.steps = self.moves.tolist()
        self.known: dict[int, float] = {}

    def of_ancestors(self, mask: int) -> float:
        found = self.known.get(mask)
        if found is None:
            found = sum(w for i, w in enumerate(self.bits) if mask >> i & 1)
            if len(self.known) < 1 << 16:
                self.known[mask] = found
        return found

    def labels(self, blocks: list[Block], title: str) -> list[int]:
        """The likeliest labels of a page's blocks together."""
        n, text, most = len(blocks), self.text, most_text(blocks)
        back: list[tuple[int, int]] = []
        off = on = 0.0
        for i, b in enumerate(blocks):
            own = self.of_ancestors(b.ancestors) + sum([text[f] for f in text_features(b, i, n, title, most)])
            if i:
                (a00, a01), (a10, a11) = self.steps[edge(blocks[i - 1], b)]
                from_off, from_on = off + a01 > on + a11, off + a00 >= on + a10
                back.append((0 if from_on else 1, 0 if from_off else 1))
                off, on = max(off + a00, on + a10), max(off + a01, on + a11) + own
            else:
                on = own
        out = [int(on > off)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1][:n] if n else []

    def main_text(self, page: str) -> str:
        blocks, title = read(page)
        return "\n".join(b.text for b, kept in zip(blocks, self.labels(blocks, title), strict=True) if kept)


def labelled(page: str) -> tuple[list[list[int]], list[int], list[int]]:
    """(features of each block, edges, labels) of a training page."""
    blocks, title = read(page)
    labels = [int(MARK in b.text) for b in blocks]
    for b in blocks:
        b.text = b.text.replace(MARK, "").strip() or "."
        b.linked = min(b.linked, len(b.text))
    most = most_text(blocks)
    x = [[*text_features(b, i, len(blocks), title.replace(MARK, ""), most), *(len(_TEXT) + k for k in range(_ANCESTOR_BITS) if b.ancestors >> k & 1)] for i, b in enumerate(blocks)]
    return x, [0, *(edge(a, b) for a, b in zip(blocks, blocks[1:], strict=False))], labels


def likelihood(weights: np.ndarray, moves: np.ndarray, x: np.ndarray, edges: np.ndarray, labels: np.ndarray, there: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The log likelihood of pages' labels, and its gradients. x: pages x blocks x features; there: which blocks are."""
    pages, most = labels.shape
    own = np.stack([np.zeros(labels.shape), x @ weights], 2)
    step = moves[edges]  # pages x blocks x from x to
    a, b = np.zeros((pages, most, 2)), np.zeros((pages, most, 2))
    a[:, 0] = own[:, 0]
    for t in range(1, most):
        new = np.logaddexp(a[:, t - 1, 0, None] + step[:, t, 0], a[:, t - 1, 1, None] + step[:, t, 1]) + own[:, t]
        a[:, t] = np.where(there[:, t, None], new, a[:, t - 1])
    total = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
    for t in range(most - 2, -1, -1):
        ahead = own[:, t + 1] + b[:, t + 1]
        new = np.logaddexp(step[:, t + 1, :, 0] + ahead[:, 0, None], step[:, t + 1, :, 1] + ahead[:, 1, None])
        b[:, t] = np.where(there[:, t + 1, None], new, b[:, t + 1])
    on = np.exp(a[:, :, 1] + b[:, :, 1] - total[:, None]) * there
    right = np.take_along_axis(own, labels[:, :, None], 2)[:, :, 0] * there
    value = float(right.sum() - total.sum())
    by_feature = np.einsum("pt,ptf->f", labels * there - on, x)
    by_move = np.zeros_like(moves)
    both = there[:, 1:]
    joint = np.exp(a[:, :-1, :, None] + step[:, 1:] + (own + b)[:, 1:, None, :] - total[:, None, None, None])
    index = np.arange(pages)[:, None], np.arange(1, most)[None]
    value += float((step[index[0], index[1], labels[:, :-1], labels[:, 1:]] * both).sum())
    for e in range(EDGES):
        here = (edges[:, 1:] == e) & both
        for f in range(2):
            for g in range(2):
                by_move[e, f, g] = (here & (labels[:, :-1] == f) & (labels[:, 1:] == g)).sum() - (joint[:, :, f, g] * here).sum()
    return value, by_feature, by_move


def fit(pages: list[str], rounds: int = 100, penalty: float = 0.002, rate: float = 0.3) -> Field:
    """A field fitted to training pages by Adam on the penalised likelihood of all of them."""
    read_ = [p for p in map(labelled, pages) if p[2]]
    read_.sort(key=lambda p: len(p[2]))
    groups = []
    for i in range(0, len(read_), 64):
        some = read_[i : i + 64]
        most = max(2, max(len(p[2]) for p in some))
        x, edges = np.zeros((len(some), most, FEATURES), np.float32), np.zeros((len(some), most), np.int64)
        labels, there = np.zeros((len(some), most), np.int64), np.zeros((len(some), most), bool)
        for k, (fs, es, ls) in enumerate(some):
            for t, own in enumerate(fs):
                x[k, t, own] = 1
            edges[k, : len(es)], labels[k, : len(ls)], there[k, : len(ls)] = es, ls, True
        groups.append((x, edges, labels, there))
    made = Field()
    w, size = np.concatenate([made.weights, made.moves.ravel()]), FEATURES
    m, v = np.zeros_like(w), np.zeros_like(w)
    for r in range(1, rounds + 1):
        g = -penalty * len(read_) * w
        for group in groups:
            _, by_feature, by_move = likelihood(w[:size], w[size:].reshape(EDGES, 2, 2), *group)
            g[:size] += by_feature
            g[size:] += by_move.ravel()
        g /= max(1, len(read_))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * (1 - r / (rounds + 1)) * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Field(w[:size], w[size:].reshape(EDGES, 2, 2))


#: Pages that the field is fitted on; they are made, not read, so their number doesn't grow with the table.
TRAINING, SEED = 600, 20_100


@functools.lru_cache(maxsize=2)
def trained(pages: int = TRAINING, seed: int = SEED) -> Field:
    return fit(made_pages(pages, seed))


def extract(df: DataFrame, model: Field, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page."""
    weights, moves = model.weights, model.moves
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def made(batches):
        field_ = Field(weights, moves)
        found = ((i, url, field_.main_text(page)) for i, url, page in rows(batches))
        return in_batches(((i, url, text, len(text)) for i, url, text in found), schema, lambda r: 64 + len(r[2]))

    given = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    return given.mapInArrow(made, "page_id long, url string, text string, n_chars long")


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main texts of the whole table `pages`."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), trained())


QUERIES = {"op13_html": op13_html}
SQL: dict[str, str] = {}
