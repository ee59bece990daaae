"""Main text of web pages by a linear-chain conditional random field.

A page becomes the sequence of its DOM leaf blocks.  Features of a block are
its ancestors' tags and class words and the look of its text; the field is
trained on labelled pages and decoded by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow

# A tag without angle brackets in quotes; possessive, so that no text is gone over twice.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"']*+)((?:[^<>\"']++|\"[^\"<>]*\"|'[^'<>]*')*+)>")
NAME = re.compile(r"</?([a-zA-Z][^\s/<>\"']*+)")
MARKS = re.compile("[>\"']")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style")}
#: Elements that are skipped with all they hold, if they have an end tag.
SKIPPED = frozenset("template noscript svg select iframe title".split())
IN_HEAD = frozenset("head title base basefont bgsound link meta template noscript noframes script style".split())
LONG_NUMBER = re.compile(r"&#0*([0-9]*);?")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# The elements of HTML that start a block, and those that have no end tag.
BLOCKS = frozenset("address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Class words by what they usually mark.
SIGNS = {
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toolbar tabs pagination pager",
    "edge": "header masthead topbar footer bottom copyright legal imprint",
    "side": "sidebar aside widget related recommended teaser popular trending",
    "notice": "cookie cookies consent notice gdpr popup modal overlay alert newsletter subscribe signup login",
    "reader": "comment comments comment-list disqus reply replies discussion feedback",
    "share": "share sharing social follow tags meta byline",
    "body": "content article post entry story main text body",
}
SIGN_OF = {word: sign for sign, words in SIGNS.items() for word in words.split()}


@dataclass
class Block:
    """A leaf: its innermost block tag, the features that its ancestors give it, and its text."""

    tag: str
    around: frozenset[str]
    text: str
    linked: int


@lru_cache(maxsize=4096)
def _signs(attributes: str) -> tuple[str, ...]:
    words = " ".join("".join(m) for m in NAMES.findall(attributes)).lower()
    return tuple(sorted({SIGN_OF[w] for w in re.split(r"[^a-z]+", words) if w in SIGN_OF}))


@dataclass(slots=True)
class Tag:
    """Markup from ``start`` to ``end``: comments and the like have no name; script and style reach to their end tags."""

    start: int
    end: int
    name: str = ""
    closing: bool = False
    attributes: str = ""


class TagEnds:
    """Where tags end that have angle brackets or odd quotes inside: at the first ``>`` outside of quotes.

    A quote without a partner stands for itself.  Marks from which no end can
    be reached are remembered, so all searches together are linear.
    """

    def __init__(self, page: str):
        self.page, self.dead = page, set()
        self.marks: list[int] | None = None

    def after(self, at: int) -> int | None:
        if self.marks is None:
            self.marks, last, self.partner = [m.start() for m in MARKS.finditer(self.page)], {}, {}
            for i in range(len(self.marks) - 1, -1, -1):
                mark = self.page[self.marks[i]]
                self.partner[i] = last.get(mark)
                last[mark] = i
        seen, i = [], bisect_left(self.marks, at)
        while i < len(self.marks) and i not in self.dead:
            seen.append(i)
            if self.page[self.marks[i]] == ">":
                return self.marks[i] + 1
            i = i + 1 if self.partner[i] is None else self.partner[i] + 1
        self.dead.update(seen)
        return None


def tags_of(page: str) -> list[Tag]:
    """All markup in page order, in one pass; a ``<`` that starts none is text."""
    out: list[Tag] = []
    ends, last, at = TagEnds(page), page.rfind(">"), 0
    while 0 <= (at := page.find("<", at)):
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            end = len(page) if end < 0 else end + 3
            out.append(Tag(at, end))
        elif at > last:
            at += 1
            continue
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.index(">", at) + 1
            out.append(Tag(at, end))
        else:
            if found := TAG.match(page, at):
                closing, name, attributes, end = found[1], found[2].lower(), found[3], found.end()
            elif (found := NAME.match(page, at)) and (end := ends.after(found.end())):
                closing, name, attributes = page[at + 1] == "/", found[1].lower(), page[found.end() : end - 1]
            else:
                at += 1
                continue
            if name in RAW_END and not closing:
                shut = RAW_END[name].search(page, end)
                end = page.find(">", shut.end()) + 1 if shut else 0
                end = end or len(page)
            out.append(Tag(at, end, name, bool(closing), attributes))
        at = end
    return out


def _partners(tags: list[Tag]) -> dict[int, int]:
    """The end tag of each skipped element that has one of its own."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for i, tag in enumerate(tags):
        if tag.name in SKIPPED:
            held = open_.setdefault(tag.name, [])
            if tag.closing:
                if held:
                    out[held.pop()] = i
            elif not tag.attributes.endswith("/"):
                held.append(i)
    return out


def _head_end(page: str, tags: list[Tag], partners: dict[int, int], i: int) -> int:
    """The last tag of the head that starts with tag ``i``: its end tag, or the last one before text or a tag of the body."""
    while i + 1 < len(tags):
        following = tags[i + 1]
        if page[tags[i].end : following.start].strip():
            break
        if following.closing and following.name == "head":
            return i + 1
        if following.name and following.name not in IN_HEAD and not following.closing:
            break
        i = partners.get(i + 1, i + 1)
    return i


class Path:
    """The open blocks, innermost last, and where those of each tag stand."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.around: list[frozenset[str]] = [frozenset()]
        self.places: dict[str, list[int]] = {}

    def last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def open(self, tag: str, signs: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        new = {f"in:{tag}", *(f"sign:{s}" for s in signs)}
        self.around.append(self.around[-1] if new <= self.around[-1] else self.around[-1] | new)

    def close(self, tags: tuple[str, ...], walls: tuple[str, ...] = ()) -> None:
        """Close the innermost of ``tags`` and all inside it, unless a wall stands between."""
        place = self.last(tags)
        if place < 0 or place < self.last(walls):
            return
        while len(self.tags) > place:
            self.places[self.tags.pop()].pop()
            self.around.pop()


#: Elements without text of their own that part the words round them.
SPACES = SKIPPED | {"head", "script", "style"}
WALLS = ("div", "article", "section", "li", "td", "aside", "footer", "header", "nav", "form", "main")


def decoded(text: str) -> str:
    """Character references decoded; a number of more digits than Python reads is no character."""
    try:
        return html.unescape(text)
    except ValueError:
        return html.unescape(LONG_NUMBER.sub(lambda m: f"&#{m[1]};" if 0 < len(m[1]) < 8 else "\ufffd" if m[1] else m[0], text))


def leaf_blocks(page: str) -> list[Block]:
    """The runs of text between block tags, in page order, with their ancestors.

    Character references are decoded and white space is one space.  Missing
    end tags are closed as browsers do; nothing is cut from a text.  A skipped
    element without an end tag skips nothing but its start tag; comments,
    scripts and styles without an end go to the end of the page, as in
    browsers.  The work grows with the page, whatever it holds.
    """
    blocks: list[Block] = []
    path, pieces, linked, anchors, at = Path(), [], 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(decoded("".join(pieces)).split())
            if text:
                blocks.append(Block(path.tags[-1] if path.tags else "-", path.around[-1], text, linked))
            pieces.clear()
        linked = 0

    tags = tags_of(page)
    partners = _partners(tags)
    i = 0
    while i < len(tags):
        tag = tags[i]
        if tag.start > at:
            pieces.append(page[at : tag.start])
            linked += tag.start - at if anchors else 0
        name = tag.name
        if name == "head" and not tag.closing:
            i = _head_end(page, tags, partners, i)
        elif i in partners:
            i = partners[i]
        at, i = tags[i].end, i + 1
        if name in SPACES or name in VOID:
            if name in ("br", "hr") or name in SPACES and not tag.closing:
                pieces.append(" ")
            continue
        if name == "a":
            anchors = 0 if tag.closing else 1
        if name not in BLOCKS:
            continue
        flush()
        if tag.closing:
            path.close((name,))
            continue
        path.close(("p",), WALLS)
        if name in CLOSES:
            path.close(CLOSES[name], ("ul", "ol", "dl", "table", "select"))
        path.open(name, _signs(tag.attributes))
    if at < len(page):
        pieces.append(page[at:])
        linked += len(page) - at if anchors else 0
    flush()
    return blocks


def features(blocks: list[Block]) -> list[list[str]]:
    out, last = [], max(1, len(blocks) - 1)
    for i, block in enumerate(blocks):
        names = {"always", f"tag:{block.tag}", f"place:{i * 4 // (last + 1)}", *block.around}
        words = block.text.count(" ") + 1
        names.add(f"words:{min(words, 128).bit_length()}")
        names.add(f"links:{min(3, 4 * block.linked // max(1, len(block.text)))}")
        if block.text[-1] in ".!?:;\"'»”":
            names.add("ends")
        if "©" in block.text or "|" in block.text:
            names.add("mark")
        out.append(sorted(names))
    return out


class Field:
    """A conditional random field over chains with the labels 0 (other) and 1 (main text)."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.index, self.weights, self.steps = index, weights, steps

    @classmethod
    def train(cls, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Field:
        """Adam on the mean log-likelihood of the label chains, all pages at once."""
        index = {name: i for i, name in enumerate(sorted({n for f, _ in pages for names in f for n in names}))}
        longest, widest = max(len(y) for _, y in pages), max(len(n) for f, _ in pages for n in f)
        ids = np.full((len(pages), longest, widest), len(index))
        gold, real = np.zeros((len(pages), longest), int), np.zeros((len(pages), longest), bool)
        for p, (f, y) in enumerate(pages):
            gold[p, : len(y)], real[p, : len(y)] = y, True
            for i, names in enumerate(f):
                ids[p, i, : len(names)] = [index[n] for n in names]
        values = np.zeros((len(index) + 3) * 2)
        first, second = np.zeros_like(values), np.zeros_like(values)
        for t in range(1, rounds + 1):
            weights, steps = values[:-4].reshape(-1, 2), values[-4:].reshape(2, 2)
            wide = np.vstack([weights[: len(index)], np.zeros(2)])
            emit = wide[ids].sum(axis=2)
            ahead, back = np.zeros_like(emit), np.zeros_like(emit)
            ahead[:, 0] = emit[:, 0]
            for i in range(1, longest):
                new = np.logaddexp(ahead[:, i - 1, :1] + steps[0], ahead[:, i - 1, 1:] + steps[1]) + emit[:, i]
                ahead[:, i] = np.where(real[:, i, None], new, ahead[:, i - 1])
            for i in range(longest - 2, -1, -1):
                then = back[:, i + 1] + emit[:, i + 1]
                new = np.logaddexp(then[:, :1] + steps[:, 0], then[:, 1:] + steps[:, 1])
                back[:, i] = np.where(real[:, i + 1, None], new, 0)
            total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
            wrong = (np.exp(ahead + back - total[:, None, None]) - np.eye(2)[gold]) * real[..., None]
            down = np.zeros_like(wide)
            np.add.at(down, ids, wrong[:, :, None, :])
            pair = ahead[:, :-1, :, None] + steps + (emit + back)[:, 1:, None, :] - total[:, None, None, None]
            both = real[:, 1:]
            turn = np.exp(pair[both]).sum(axis=0)
            np.subtract.at(turn, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            slope = np.concatenate([down[:-1].ravel(), np.zeros(2), turn.ravel()]) / len(pages)
            slope = slope[: len(values)] + decay * values
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            values = values - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        return cls(index, values[:-4].reshape(-1, 2)[: len(index)], values[-4:].reshape(2, 2))

    def viterbi(self, chain: list[list[str]]) -> list[int]:
        if not chain:
            return []
        rows = [[self.index[n] for n in names if n in self.index] for names in chain]
        scores = [self.weights[r].sum(axis=0).tolist() for r in rows]
        (a, b), (c, d) = self.steps.tolist()
        other, main = scores[0]
        came = []
        for no, yes in scores[1:]:
            stay, leave = other + a >= main + c, main + d > other + b
            came.append((0 if stay else 1, 1 if leave else 0))
            other, main = max(other + a, main + c) + no, max(other + b, main + d) + yes
        labels = [int(main > other)]
        for step in reversed(came):
            labels.append(step[labels[-1]])
        return labels[::-1]


MAIN = "\x02"


def labelled_pages(count: int = 240, seed: int = 9) -> list[str]:
    """Pages in many layouts whose main blocks carry a mark: the training set when none is given."""
    rng = random.Random(seed)
    syllables = "an ba ce do el fi go ha in jo ka lu me no or pa que re st ti un ver wo xi ys zo".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    line = lambda low, high: " ".join(word() for _ in range(rng.randint(low, high))).capitalize()
    prose = lambda: MAIN + ". ".join(line(1, 14) for _ in range(rng.randint(1, 5))) + rng.choice(["", ".", ".", "!"])
    item = lambda: f'<li><a href="/{word()}">{line(1, 3)}</a></li>'
    few = lambda make, low, high: "".join(make() for _ in range(rng.randint(low, high)))
    classed = lambda sign: rng.choice(SIGNS[sign].split())

    def body() -> str:
        kinds = [lambda: f"<p>{prose()}</p>"] * 6 + [
            lambda: f"<p>{prose()}", lambda: f"<h2>{MAIN}{line(1, 5)}</h2>", lambda: f"<ul>{few(lambda: f'<li>{prose()}</li>', 1, 4)}</ul>", lambda: f"<blockquote>{prose()}</blockquote>", lambda: f"<p><b>{prose()}<br>",
            lambda: f"<table><tr><td>{MAIN}{word()}</td><td>{MAIN}{word()}</td></tr></table>", lambda: f"<p>{prose()} <a href='/x'>{line(1, 3)}</a> {line(2, 6)}.</p>",
            lambda: f'<div class="{classed("advert")}">{line(2, 12)}.</div>', lambda: f'<aside class="{classed("side")}"><p>{line(2, 12)}.</p></aside>', lambda: f'<div class="{classed("share")}"><a href="/s">{line(1, 2)}</a></div>',
        ]
        return "".join(rng.choice(kinds)() for _ in range(rng.randint(1, 14)))

    pages = []
    for _ in range(count):
        nav = rng.choice([f"<nav><ul>{few(item, 2, 8)}</ul></nav>", f'<div class="{classed("menu")}"><ul>{few(item, 2, 8)}</ul></div>', f"<header><h1>{line(1, 4)}</h1><nav>{few(item, 2, 5)}</nav></header>", ""])
        advert = rng.choice([f'<div class="{classed("advert")}">{line(2, 20)}.</div>', f'<div class="{classed("notice")}"><p>{line(4, 16)}.</p><button>{word()}</button></div>', "", ""])
        title = f"<h1>{MAIN}{line(2, 9)}</h1>"
        inside = rng.choice(["", "", f'<section class="{classed("reader")}"><h3>{line(1, 2)}</h3>{few(lambda: f"<p>{line(3, 30)}.</p>", 1, 5)}</section>'])
        text = title + body() + inside
        main = rng.choice([f"<article>{text}</article>", f"<article>{text}</article>", f"<main>{text}</main>", f'<div class="{classed("body")}">{text}</div>', f'<div id="{word()}">{text}</div>', text])
        after = rng.choice(["", f'<div class="{classed("reader")}">{few(lambda: f"<div><p>{line(3, 30)}.</p></div>", 1, 5)}</div>', f"<form><label>{line(1, 3)}</label><p>{line(2, 9)}.</p><button>{word()}</button></form>", f'<aside><h3>{line(1, 3)}</h3><ul>{few(item, 2, 6)}</ul></aside>', f'<div class="{classed("side")}"><p>{line(3, 20)}.</p></div>'])
        foot = rng.choice([f"<footer>&copy; {word()}.example &middot; {line(2, 14)}.</footer>", f'<div class="{classed("edge")}"><p>&copy; {line(2, 9)}</p></div>', f"<footer><p>{line(3, 20)}.</p></footer>", ""])
        pages.append(f"<!DOCTYPE html><html><head><title>{line(2, 6)}</title></head><body>{nav}{advert}{main}{after}{foot}</body></html>")
    return pages


def train_field(pages: Iterable[str]) -> Field:
    """Train on pages whose main blocks carry the mark ``MAIN``."""
    chains = []
    for page in pages:
        blocks = leaf_blocks(page)
        gold = [int(MAIN in b.text) for b in blocks]
        for block in blocks:
            block.text = block.text.replace(MAIN, "").strip() or "-"
        if blocks:
            chains.append((features(blocks), gold))
    return Field.train(chains)


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train_field(labelled_pages())


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, keep in zip(blocks, field.viterbi(features(blocks)), strict=True) if keep)


def extract_main_text(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", field: Field | None = None) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars`` (code points).

    A null or empty page, and one without main text, has the empty text.  Null
    ids and urls stay; repeated rows each keep a row; an empty table gives an
    empty one; other columns are left out.
    """
    model = df.sparkSession.sparkContext.broadcast(field or default_field())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page, model.value) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    return map_arrow(rows, task, f"page_id {kind}, url string, text string, n_chars long")
