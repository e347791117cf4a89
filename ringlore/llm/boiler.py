"""Problem 5: page boilerplate mixed with main content.

Method: a tree-structured graphical model.  Every block element of a page, and every line of text within one, is a node
with two states, content or boilerplate.  A line's own potential comes from a logistic model of its form and words; the
potential between a parent and a child says how often their states agree.  Sum-product messages pass upward to the root
and downward again; the marginals at the lines decide.  All potentials were trained from labelled pages (train_boiler.py).

Defined results: null or empty texts, pages of an error status and pages on which nothing but a heading looks like content
have no article; lines of markup only are never part of one; pages are read whole, whatever their length; rows that are
equal come out alike; extra columns are untouched.
"""

from __future__ import annotations

import json
import math
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import portions, python_udf
from .pages import Leaf, Page, read_page
from .pii import fold

MODEL = Path(__file__).with_name("boiler_model.json")
_WORDS = re.compile(r"[^\W\d_]+|©")
_DATE_END = re.compile(r"\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}( \d{1,2}[:h]\d{2})?$")
_BULLET = re.compile(r"^[*•\-–] ")
MARKS = ("path", "bars", "dashes", "bullet")


def load_model(path: str | Path = MODEL) -> dict:
    return json.loads(Path(path).read_text())


def _ending(text: str) -> str:
    last = text[-1]
    return "stop" if last in ".?!…" else "date" if last.isdigit() and _DATE_END.search(text) else "open"


def form_features(page: Page) -> list[list[str]]:
    """For each leaf the names of what holds for its form, its elements, its place and its neighbours."""
    heading, _, site = page.title.rpartition(" | ")
    site = site.lower() if heading else ""
    heading, plain_site = heading or page.title, fold(site)
    leaves = page.leaves
    last = max(1, leaves[-1].line) if leaves else 1
    ends = [_ending(leaf.text) for leaf in leaves]
    trail = next((leaf.text.rpartition(" > ")[2] for leaf in leaves if " > " in leaf.text and "title" not in leaf.tags), "")
    rows = []
    for i, leaf in enumerate(leaves):
        text, tags, end = leaf.text, leaf.tags, ends[i]
        n = text.count(" ") + 1
        out = ["n0" if n < 4 else "n4" if n < 9 else "n9" if n < 16 else "n16" if n < 25 else "n25", end]
        if end == "stop" and n > 5:
            out.append("sentence")
        for t in tags:
            if t in _NAMED:
                out.append(_NAMED[t])
        if text == heading:
            out.append("heading")
        elif trail and text.startswith(trail):
            out.append("trailed")
        share = leaf.line / last
        out.append("first" if share < 0.2 else "last" if share > 0.8 else "middle")
        out.append(_AFTER[ends[i - 1] if i else "none", i > 0 and leaves[i - 1].node == leaf.node])
        out.append(_BEFORE[ends[i + 1] if i + 1 < len(leaves) else "none", i + 1 < len(leaves) and leaves[i + 1].node == leaf.node])
        if not page.markup:
            out.append("plain")
        if site:
            low = text.lower()
            if site in low or plain_site in low:
                out.append("site")
        rows.append(out)
    return rows


_AFTER, _BEFORE = ({(e, s): f"{w}:{e}" + ":same" * s for e in ("stop", "date", "open", "none") for s in (False, True)} for w in ("after", "before"))
_NAMED = {t: f"<{t}" for t in ("title", "p", "li", "b", "small", "em", "i", "span", "font")} | {"a": "link", "h1": "<h", "h2": "<h", "h3": "<h"}


def _marks(text: str) -> list[str]:
    """The marks that part a line."""
    out = []
    if " > " in text:
        out.append("path")
    if " | " in text:
        out.append("bars")
    if text.count(" - ") > 1:
        out.append("dashes")
    if _BULLET.match(text):
        out.append("bullet")
    return out


def word_features(text: str) -> set[str]:
    """The words and word pairs of a line, whatever its length, names as one word, and the marks that part it."""
    out = set(_marks(text))
    words: list[str] = []
    for w in _WORDS.findall(text):
        if not words or not w[0].isupper():
            words.append(w.lower())
        elif words[-1] != "Name":
            words.append("Name")
    out.update(words)
    out.update(map(" ".join, zip(words, words[1:])))
    return out


class Numbers(dict):
    """The words of every blank-parted piece met so far, each as its number with names as one word and as its own number."""

    def __init__(self, ids: dict[str, int]):
        self.ids = ids

    def __missing__(self, piece: str) -> bytes:
        if len(self) > 100_000:
            self.clear()
        out, ids = array("i"), self.ids
        for w in _WORDS.findall(piece):
            own = ids.get(w.lower(), 0)
            out.extend((ids["Name"] if w[0].isupper() else own, own))
        found = self[piece] = out.tobytes()
        return found


class Said:
    """What the words of lines say: for each line the sum of the weights of its ``word_features``.

    No feature is spelled out.  The pieces between blanks are read once and kept as numbers of words; all lines are one array
    of these, words and pairs are looked up in tables, and only those that have a weight are told apart.
    """

    def __init__(self, model: dict):
        pairs = {tuple(f.split(" ")): w for f, w in model["weights"].items() if " " in f}
        words = {f: w for f, w in model["weights"].items() if " " not in f}
        self.ids = {w: k for k, w in enumerate(sorted({"Name", *MARKS, *words, *(w for p in pairs for w in p)}), 2)}  # 0: any other word, 1: the end of a line
        size = self.size = len(self.ids) + 2
        self.weights = np.array([*(words.get(w, 0.0) for w in (0, 1, *self.ids)), *pairs.values()])
        self.has = self.weights[:size] != 0
        self.at = np.zeros(size * size, np.min_scalar_type(len(self.weights)))  # where the weight of a pair stands
        self.at[[self.ids[x] * size + self.ids[y] for x, y in pairs]] = range(size, len(self.weights))
        self.known = Numbers(self.ids)

    def __call__(self, texts: list[str]) -> list[float]:
        end, size, name, known = array("i", (1, 1)).tobytes(), self.size, self.ids["Name"], self.known.__getitem__
        read, marked = [], []
        for n, text in enumerate(texts):
            read += map(known, text.split())
            read.append(end)
            if not text[:1].isalnum() or " > " in text or " | " in text or " - " in text:
                marked += [n * len(self.weights) + self.ids[m] for m in _marks(text)]
        both = np.frombuffer(b"".join(read), np.int32).reshape(-1, 2)
        ids = both[:, 0].copy()
        stops = np.flatnonzero(ids == 1)
        firsts = stops[:-1] + 1
        ids[firsts] = both[firsts, 1]  # the first word of a line tells no name
        ids[:1] = both[:1, 1]
        names = ids == name
        again = np.flatnonzero(names[1:] & names[:-1]) + 1
        if len(again):
            ids = np.delete(ids, again)
            stops = np.flatnonzero(ids == 1)
        one = np.flatnonzero(self.has[ids])
        at = self.at[ids[:-1] * np.int32(size) + ids[1:]]
        two = np.flatnonzero(at)
        keys = np.searchsorted(stops, np.concatenate((one, two))) * len(self.weights) + np.concatenate((ids[one], at[two]))
        if marked:
            keys = np.concatenate((keys, marked))
        keys.sort()
        if len(keys):
            keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
        lines, features = np.divmod(keys, len(self.weights))
        return np.bincount(lines, self.weights[features], len(texts)).tolist()


def page_features(page: Page) -> list[list[str]]:
    """All features of each leaf."""
    return [[*form, *word_features(leaf.text)] for form, leaf in zip(form_features(page), page.leaves)]


def _softplus(x: float) -> float:
    return x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))


def marginals(page: Page, unary: list[float], model: dict) -> list[float]:
    """The log-odds of content at each leaf, by one upward and one downward pass of sum-product."""
    (n00, n01), (n10, n11) = model["node"]  # log P(child state | parent state)
    (l00, l01), (l10, l11) = model["leaf"]
    prior = model["names"]
    names, parents = page.names, page.parents
    up = [prior.get(x, 0.0) for x in names]
    said = []
    for leaf, own in zip(page.leaves, unary):
        m = (l10 + _softplus(own + l11 - l10)) - (l00 + _softplus(own + l01 - l00))
        said.append(m)
        up[leaf.node] += m
    told = [0.0] * len(names)
    for k in range(len(names) - 1, 0, -1):  # children stand after their parents
        own = up[k]
        told[k] = m = (n10 + _softplus(own + n11 - n10)) - (n00 + _softplus(own + n01 - n00))
        up[parents[k]] += m
    total = up[:]
    for k in range(1, len(names)):
        rest = total[parents[k]] - told[k]
        total[k] = up[k] + (n01 + _softplus(rest + n11 - n01)) - (n00 + _softplus(rest + n10 - n00))
    out = []
    for leaf, own, m in zip(page.leaves, unary, said):
        rest = total[leaf.node] - m
        out.append(own + (l01 + _softplus(rest + l11 - l01)) - (l00 + _softplus(rest + l10 - l00)))
    return out


def page_unary(page: Page, model: dict, words: list[float] | None = None) -> list[float]:
    """Each line's own log-likelihood ratio, without the share of content that the edges already carry; ``words``: what its words say."""
    weights, bias, out = model["weights"], model["bias"], []
    for said, form in zip(words or Said(model)([leaf.text for leaf in page.leaves]), form_features(page)):
        score = bias + said
        for f in form:
            if f in weights:
                score += weights[f]
        out.append(12.0 if score > 12 else -12.0 if score < -12 else score)
    return out


def _article(page: Page, odds: list[float]) -> list[Leaf]:
    kept = [leaf for leaf, o in zip(page.leaves, odds) if o > 0 and "title" not in leaf.tags]
    return kept if any(leaf.text[-1] in ".?!…" and leaf.text.count(" ") > 3 for leaf in kept) else []


def articles(texts: list[str], model: dict, said: Said) -> list[list[Leaf]]:
    """The lines of each page that are its article; none if only a heading is left."""
    pages, at, out = [read_page(text) for text in texts], 0, []
    words = said([leaf.text for page in pages for leaf in page.leaves])
    for page in pages:
        n = len(page.leaves)
        out.append(_article(page, marginals(page, page_unary(page, model, words[at : at + n]), model)) if n else [])
        at += n
    return out


def article_leaves(text: str | None, model: dict) -> list[Leaf]:
    """The article of one page."""
    return articles([text or ""], model, Said(model))[0]


def _numbers(leaves: list[Leaf]) -> list[int]:
    return sorted({leaf.line for leaf in leaves})


def _lines(text: str | None, model: dict) -> list[int]:
    return _numbers(article_leaves(text, model))


def _line_batches(batches: Iterator[pd.Series], model: dict) -> Iterator[pd.Series]:
    said = Said(model)
    for texts in batches:
        yield pd.Series([_numbers(leaves) for part in portions(texts) for leaves in articles(part, model, said)])


def article_lines(text: Column, model: dict | None = None) -> Column:
    """The numbers, from 1, of the lines that belong to the page's article."""
    model = model or load_model()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _line_batches(batches, model)

    return python_udf(run, "array<int>")(text)


def with_article(df: DataFrame, text: str, out: str = "article_lines", status: str | None = None) -> DataFrame:
    """``df`` and the array column ``out``; pages whose ``status`` is an error are not read at all."""
    source = F.col(f"`{text}`")
    if status:
        source = F.when(F.coalesce(F.col(f"`{status}`"), F.lit(200)) < 400, source)
    return df.withColumn(out, F.coalesce(article_lines(source), F.array().cast("array<int>")))


def with_body(df: DataFrame, text: str, out: str = "article", status: str | None = None, model: dict | None = None) -> DataFrame:
    """``df`` and the string column ``out``: what a reader sees of the page's article, line by line; empty where there is none."""
    model = model or load_model()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        said = Said(model)
        for texts in batches:
            yield pd.Series(["\n".join(leaf.text for leaf in leaves) for part in portions(texts) for leaves in articles(part, model, said)])

    source = F.col(f"`{text}`")
    if status:
        source = F.when(F.coalesce(F.col(f"`{status}`"), F.lit(200)) < 400, source)
    return df.withColumn(out, F.coalesce(python_udf(run, "string")(source), F.lit("")))
