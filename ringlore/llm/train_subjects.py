"""Makes subject_terms.json: ``python -m ringlore.llm.train_subjects SF_DIR``.

The terms of subject_lexicon.txt are curated.  Others are word sequences that keep to one subject: first within the labelled
subject_examples (at most EXAMPLES rows), then within all documents that the terms known so far give one subject; what any
document may say stands in documents of every subject.  Of sequences within one another the shortest stands.  A curated term
that the corpus uses for other subjects too weighs less, by its purity, or is left out.  The threshold of a subject is set by
the scores of its own examples' sentences.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow.parquet as pq

from . import subjects

LEXICON = Path(__file__).with_name("subject_lexicon.txt")
#: Bounds and measures: labelled rows, words of a sequence, texts or sentences that must hold it, and how purely.
EXAMPLES, LONGEST, TEXTS, LEAST, PURE, ROUNDS = 2_000, 6, 5, 30, 0.75, 2
#: The least purity of a curated term, the share of documents that stands for one never seen, and where a threshold is put.
KEPT, UNSEEN, QUANTILE, SLACK = 0.6, 1e-4, 0.005, 0.8
#: The least share of a document's known terms that one subject needs, and how many terms a document needs.
ONE, KNOWN = 0.75, 3


def lexicon(names: list[str]) -> dict[str, int]:
    """Curated terms and the index of the subject of each; a term of several subjects has none."""
    of: dict[str, set[int]] = defaultdict(set)
    for line in LEXICON.read_text(encoding="utf-8").splitlines():
        if line and not line.startswith("#"):
            subject, _, terms = line.partition(":")
            for t in terms.split(","):
                of[subjects.plain(t).strip()].add(names.index(subject.strip()))
    return {t: next(iter(s)) for t, s in of.items() if len(s) == 1}


def frequent(lines: list[list[str]], least: int) -> set[str]:
    """The sequences of up to LONGEST words, none with a digit, that at least so many lines hold; built up from shorter ones."""
    known: set[str] = set()
    for n in range(1, LONGEST + 1):
        seen: Counter = Counter()
        for words in lines:
            seen.update({g for i in range(len(words) - n + 1) if (g := " ".join(words[i : i + n])) and (n == 1 or g.rpartition(" ")[0] in known and g.partition(" ")[2] in known)})
        known |= {g for g, c in seen.items() if c >= least and not re.search(r"\d", g)}
    return known


def inside(words: list[str], terms) -> list[tuple[int, int, str]]:
    """(first word, end, sequence) of the sequences of ``terms`` in a line."""
    return [(i, i + n, g) for n in range(1, LONGEST + 1) for i in range(len(words) - n + 1) if (g := " ".join(words[i : i + n])) in terms]


def purity(documents: list[list[list[str]]], labels: dict[str, int], asked: set[str]) -> dict[str, Counter]:
    """For each asked sequence in how many documents of one subject it stands, by that subject."""
    votes: dict[str, Counter] = defaultdict(Counter)
    for lines in documents:
        known = Counter(labels[t] for words in lines for *_, t in inside(words, labels))
        if not known:
            continue
        s, n = known.most_common(1)[0]
        if n >= KNOWN and n >= ONE * sum(known.values()):
            for g in {g for words in lines for *_, g in inside(words, asked)}:
                votes[g][s] += 1
    return votes


def shortest(labels: dict[str, int]) -> dict[str, int]:
    """``labels`` without sequences that hold a shorter one of the same subject."""
    return {t: s for t, s in labels.items() if not any(labels.get(g) == s for i, j, g in inside(t.split(), labels) if g != t)}


def main(sf_dir: str) -> None:
    names = pq.read_table(f"{sf_dir}/subject_areas.parquet").to_pydict()["subject"]
    t = pq.read_table(f"{sf_dir}/subject_examples.parquet").to_pydict()
    examples = [(names.index(s), [subjects.plain(x).split() for x in subjects.sentences(text)]) for s, text in list(zip(t["subject"], t["text"]))[:EXAMPLES]]
    texts = [x for x in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).to_pydict()["text"] if x]
    documents = [[subjects.plain(x).split() for x in subjects.sentences(text)] for text in texts]
    curated = lexicon(names)
    often = frequent([list(w) for w in {tuple(w) for d in documents for w in d}], LEAST)
    held: dict[str, Counter] = defaultdict(Counter)
    for s, parts in examples:
        for g in {g for words in parts for *_, g in inside(words, often)}:
            held[g][s] += 1
    labels = {g: c.most_common(1)[0][0] for g, c in held.items() if sum(c.values()) >= TEXTS and c.most_common(1)[0][1] >= PURE * sum(c.values())}
    print(len(often), "sequences,", len(labels), "from examples,", len(curated), "curated")
    for _ in range(ROUNDS):
        votes = purity(documents, labels, often)
        labels = {g: s for g, c in votes.items() for s, n in c.most_common(1) if n >= LEAST and n >= PURE * sum(c.values())}
        print(len(labels), "pure")
    labels = shortest(labels)
    votes = purity(documents, labels, set(labels) | set(curated))
    terms: dict[str, tuple[int, float]] = {g: (s, votes[g][s] / sum(votes[g].values())) for g, s in labels.items() if votes[g]}
    for g, s in curated.items():
        n = sum(votes[g].values()) if g in votes else 0
        part = votes[g][s] / n if n >= LEAST else 1.0
        if part >= KEPT:
            terms[g] = (s, part)
        elif g in terms and terms[g][0] == s:
            del terms[g]
    docs: Counter = Counter()
    for lines in documents:
        docs.update({g for words in lines for *_, g in inside(words, terms)})
    model = {"subjects": names, "thresholds": [0.0] * len(names), "terms": [[g, s, round(p, 3), max(UNSEEN, round(docs[g] / len(texts), 5))] for g, (s, p) in sorted(terms.items())]}
    m = subjects.Matcher(model)
    scores: dict[int, list[float]] = defaultdict(list)
    for s, parts in examples:
        for words in parts:
            got = m.scores(*m.found(" ".join(words)))
            if got and max(got, key=got.get) == s:
                scores[s].append(got[s])
    model["thresholds"] = [round(sorted(scores[s])[int(len(scores[s]) * QUANTILE)] * SLACK, 4) if scores[s] else 0.0 for s in range(len(names))]
    m, good = subjects.Matcher(model), Counter()
    for s, parts in examples:
        for words in parts:
            got = m.treats(*m.found(" ".join(words)))
            good["none" if not got else "right" if got == [s] else "more" if s in got else "wrong"] += 1
    print("sentences of the examples:", dict(good), "terms:", Counter(names[x[1]] for x in model["terms"]), "thresholds", model["thresholds"])
    subjects.MODEL.write_text(json.dumps(model, ensure_ascii=False, indent=0).replace("[\n", "[").replace(",\n", ", ").replace("\n]", "]").replace("], [", "],\n["))


if __name__ == "__main__":
    main(sys.argv[1])
