"""Problem 10: subject area of each document.

Method: curated, weighted terms of each subject (subject_lexicon.txt, and those that labelled examples and the corpus add to
them, see train_subjects.py) are matched by one multi-pattern automaton; where matches overlap the longest stands.  A term
weighs its purity times its rarity, the share of all documents that hold it being counted over the whole table.  A
sentence's score for a subject is the sum of its terms' weights, normalized by the length of the sentence; it treats every
subject whose calibrated threshold its score exceeds and that is not far behind the best.  A document has every subject that
at least a share of its treating sentences treat.

Defined results: null and empty texts have no subject; texts are read whole; equal rows come out alike; languages may mix
within a text; extra columns are untouched.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, python_udf
from .pii import fold

MODEL = Path(__file__).with_name("subject_terms.json")
#: Least share of the treating sentences, and of the best score for a second subject in one sentence.
SHARE, RIVAL = 0.25, 0.65
#: Documents that the training corpus's shares count for beside the table's own, and the share at which a term weighs its purity.
PRIOR, RARE = 1000, 1e-4

_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_SPACE = re.compile(r"[^\w]+", re.UNICODE)


def load_model(path: str | Path = MODEL) -> dict:
    return json.loads(Path(path).read_text())


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s]


def plain(sentence: str) -> str:
    """Lower case without accents, which writers leave out at will; words parted by single blanks, a blank at either end."""
    return f" {_SPACE.sub(' ', fold(sentence)).strip()} "


def rarity(share: float) -> float:
    """1 for a term of one document in ten thousand, less for commoner ones, more for rarer ones."""
    return math.log(share) / math.log(RARE)


class Matcher:
    """The automaton over all terms, and the scoring of sentences by the terms found in them.

    ``model``: subjects, a threshold for each, and terms (term, index of its subject, purity, share of the training documents).
    """

    def __init__(self, model: dict) -> None:
        self.names, self.least, self.terms = model["subjects"], model["thresholds"], model["terms"]
        self.automaton = ahocorasick.Automaton()
        for k, (term, *_) in enumerate(self.terms):
            self.automaton.add_word(f" {term} ", (len(term) + 2, k))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.weigh(0, {})

    def weigh(self, documents: int, held: dict[int, int]) -> None:
        """Sets the terms' weights by the documents of the table at hand and how many of them hold each term."""
        self.weights = [purity * rarity((held.get(k, 0) + PRIOR * share) / (documents + PRIOR)) for k, (_, _, purity, share) in enumerate(self.terms)]

    def found(self, sentence: str) -> tuple[int, list[int]]:
        """How many words the sentence has, and the indices of its terms, the longest standing where they overlap."""
        line = plain(sentence)
        hits = [(last - n + 1, last, k) for last, (n, k) in self.automaton.iter(line)] if len(self.automaton) else []
        if len(hits) > 1:
            hits.sort(key=lambda h: (h[0] - h[1], h[0]))
            taken, kept = bytearray(len(line)), []
            for h in hits:  # the blanks at the ends may be shared
                if not any(taken[h[0] + 1 : h[1]]):
                    taken[h[0] + 1 : h[1]] = b"\x01" * (h[1] - h[0] - 1)
                    kept.append(h)
            hits = kept
        return line.count(" ") - 1, [k for *_, k in hits]

    def scores(self, words: int, terms: list[int]) -> dict[int, float]:
        score: dict[int, float] = {}
        for k in terms:
            s = self.terms[k][1]
            score[s] = score.get(s, 0.0) + self.weights[k]
        return {s: v / words**0.5 for s, v in score.items()}

    def treats(self, words: int, terms: list[int]) -> list[int]:
        """The indices of the subjects that a sentence treats."""
        if not terms:
            return []
        score = self.scores(words, terms)
        best = max(score.values())
        return [s for s, v in score.items() if v >= self.least[s] and v >= RIVAL * best]

    def subjects(self, sentence: str) -> list[str]:
        return [self.names[s] for s in sorted(self.treats(*self.found(sentence)))]

    def of_document(self, read: list[tuple[int, list[int]]], share: float = SHARE) -> list[str]:
        """The subjects of a document out of its sentences as ``found``."""
        counts, n = Counter(), 0
        for words, terms in read:
            if got := self.treats(words, terms):
                n += 1
                counts.update(got)
        return [self.names[s] for s, c in sorted(counts.items()) if c >= share * n - 1e-9]


FOUND = "struct<words:array<int>,ends:array<int>,terms:array<smallint>>"


def _found_batches(batches: Iterator[pd.Series], model: dict) -> Iterator[pd.DataFrame]:
    m = Matcher(model)
    for texts in batches:
        out = []
        for text in texts:
            words, ends, terms = [], [], []
            for s in sentences(text) if text else ():
                n, got = m.found(s)
                if got:
                    words.append(n)
                    terms += got
                    ends.append(len(terms))
            out.append((words, ends, terms))
        yield pd.DataFrame(out, columns=["words", "ends", "terms"])


def with_subjects(df: DataFrame, text: str, out: str = "subjects", model: dict | None = None, share: float = SHARE, keep: list[str] | None = None) -> DataFrame:
    """``df`` and the array column ``out``: texts are read once, the terms' documents counted, and the sentences scored.

    ``keep`` names the columns that are wanted beside ``out``; all of these are written once on the way, so texts may be left out.
    """
    model = model or load_model()
    own = [c for c in (df.columns if keep is None else keep) if c != out]

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _found_batches(batches, model)

    rows = checkpointed(df.select(*[F.col(f"`{c}`") for c in own], python_udf(read, FOUND)(F.col(f"`{text}`")).alias("_found")))
    held = rows.select(F.explode(F.array_distinct("_found.terms")).alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()  # at most one row a term
    documents, counts = rows.count(), {r["k"]: r["n"] for r in held}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        m = Matcher(model)
        m.weigh(documents, counts)
        for found in batches:
            done = []
            for words, ends, terms in zip(found["words"], found["ends"], found["terms"]):
                at, parts = 0, []
                for n, end in zip(words, ends):
                    parts.append((int(n), [int(k) for k in terms[at:end]]))
                    at = end
                done.append(m.of_document(parts, share))
            yield pd.Series(done)

    return rows.withColumn(out, python_udf(score, "array<string>")("_found")).drop("_found")
