"""Trains the potentials of boiler.py: ``python -m ringlore.llm.train_boiler SF_DIR``.

label_pages.py labels the pages of raw_documents under SF_DIR, of which at most PAGES are fitted.  Two thirds of the sites train; the
pages of the others are held out and its accuracy is printed.
"""

from __future__ import annotations

import json
import sys
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from . import boiler, label_pages
from .pages import Page, read_page

#: Bounds of the training: labelled pages, words kept, sites that must show a word, passes, and the weight of the penalty
#: on large weights.
PAGES, WORDS, SITES, PASSES, PENALTY, STEP = 2000, 2500, 1, 700, 1e-5, 0.04


def _fit(rows: list[set[str]], y: np.ndarray, names: list[str]) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch Adam, whose step does not shrink with a word's rarity."""
    at = {n: i for i, n in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(rows):
        for f in r:
            if f in at:
                x[i, at[f]] = 1
    w = np.zeros(len(names) + 1, np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    shrink = np.full_like(w, PENALTY)
    shrink[-1] = 0
    for k in range(1, PASSES + 1):
        g = x.T @ (1 / (1 + np.exp(-(x @ w))) - y) / len(y) + shrink * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - STEP * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w[:-1], float(w[-1])


def train(pages: list[Page], truth: list[set[int]], sites: list[str]) -> dict:
    feats, y, rows = [[set(r) for r in boiler.page_features(p)] for p in pages], [], []
    for p, f, t in zip(pages, feats, truth):
        rows += f
        y += [leaf.line in t and "title" not in leaf.tags for leaf in p.leaves]
    y = np.array(y, np.float32)
    seen = Counter(f for r in rows for f in r)
    spread = Counter(f for f, _ in {(f, site) for rs, site in zip(feats, sites) for r in rs for f in r})
    shape = [f for f in seen if f in FORM or f[:6] in ("after:", "before")]
    names = shape + [f for f, n in seen.items() if n >= 4 and spread[f] >= SITES and f not in shape]
    w, _ = _fit(rows, y, names)
    words = sorted(range(len(shape), len(names)), key=lambda i: -abs(w[i]) * min(seen[names[i]], 30) ** 0.5)[:WORDS]
    names = shape + [names[i] for i in words]
    w, b = _fit(rows, y, names)
    node, leaf, by_name = np.ones((2, 2)), np.ones((2, 2)), {}
    for p, t in zip(pages, truth):
        inside, whole = [0] * len(p.names), [0] * len(p.names)
        state = [x.line in t and "title" not in x.tags for x in p.leaves]
        for x, s in zip(p.leaves, state):
            k = x.node
            while k >= 0:
                inside[k] += s * len(x.text)
                whole[k] += len(x.text)
                k = p.parents[k]
        of = [2 * a > b for a, b in zip(inside, whole)]
        for k in range(1, len(p.names)):
            node[int(of[p.parents[k]]), int(of[k])] += 1
        for k, n in enumerate(p.names):
            by_name.setdefault(n, [1, 1])[int(of[k])] += 1
        for x, s in zip(p.leaves, state):
            leaf[int(of[x.node]), int(s)] += 1
    share = float(np.log(y.mean() / (1 - y.mean())))
    log = lambda m: np.log(m / m.sum(1, keepdims=True)).round(4).tolist()
    base = np.log(sum(v[1] for v in by_name.values()) / sum(v[0] for v in by_name.values()))
    kept = {n: round(float(np.log(v[1] / v[0]) - base), 3) for n, v in by_name.items() if n in ("nav", "header", "footer", "aside", "main", "article", "blockquote", "center")}
    return {"bias": round(b - share, 4), "weights": {n: round(float(v), 3) for n, v in zip(names, w) if abs(v) > 0.02}, "node": log(node), "leaf": log(leaf), "names": kept}


FORM = frozenset("n0 n4 n9 n16 n25 stop date open sentence link heading trailed path bars dashes bullet site first middle last plain <title <p <li <b <small <em <i <span <font <h".split())


def main(sf_dir: str) -> None:
    t = pq.read_table(f"{sf_dir}/raw_documents.parquet", columns=["id", "source_id", "raw_content", "http_status"]).to_pydict()
    rows = sorted(zip(t["id"], t["source_id"], t["raw_content"], t["http_status"]))
    text, site = {i: x or "" for i, _, x, _ in rows}, {i: s for i, s, _, _ in rows}
    labels = label_pages.labelled(rows)
    ids = label_pages.sample(labels, site)[:PAGES]
    pages, truth = [read_page(text[i]) for i in ids], [labels[i] for i in ids]
    order = {x: n for n, x in enumerate(sorted(set(site.values())))}
    fit = [k for k in range(len(ids)) if order[site[ids[k]]] % 3]
    model = train([pages[k] for k in fit], [truth[k] for k in fit], [site[ids[k]] for k in fit])
    wrong = [(ids[k], set(boiler._lines(text[ids[k]], model)) ^ truth[k]) for k in range(len(ids)) if k not in set(fit)]
    print(f"{len(fit)} pages trained; held out {len(wrong)} pages: {sum(not w for _, w in wrong)} without a wrong line, {sum(len(w) for _, w in wrong)} wrong lines of {sum(len(pages[k].leaves) for k in range(len(ids)) if k not in set(fit))}")
    boiler.MODEL.write_text(json.dumps(train(pages, truth, [site[i] for i in ids]), ensure_ascii=False, indent=0))


if __name__ == "__main__":
    main(sys.argv[1])
