"""Labels for training the article model.

Labels come from repetition, not from what lines say.  A page's furniture stands beside many articles, an article's lines
beside no other: a line that is shaped like a sentence counts as the article's unless its text stands, on the same site, beside
REPEATED articles or more, or names the site and stands, but for the name, on REPEATED sites.  Pages that show one article again (fetched once more, or with small changes) are told apart
by their longest line that is nobody else's.  The line that repeats the title, or in plain text the first line of its own above
the first sentence, is the heading.  Counts cover all pages under SF_DIR; of each site that shows LEAST articles, since repetition says
nothing of a smaller one, a bounded sample of pages is kept as labels.
"""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from .pages import Page, read_page
from .pii import fold

#: Labelled pages of each source at most; from how many articles on a line is furniture; words that a sentence needs.
EACH, SEED, REPEATED, WORDS, LEAST = 80, 7, 3, 5, 30


def is_sentence(text: str) -> bool:
    return text[-1] in ".?!…" and text.count(" ") + 1 >= WORDS


def article_of(page: Page) -> str:
    """What stands for a page's article: its longest line, digits set aside."""
    longest = max((leaf.text for leaf in page.leaves), key=len, default="")
    return "".join("0" if c.isdigit() else c for c in longest)


def site_names(pages: dict[str, Page], sites: dict[str, str]) -> dict[str, str]:
    """What each site calls itself: the most common end of its titles."""
    ends: dict[str, Counter] = defaultdict(Counter)
    for i, page in pages.items():
        if " | " in page.title:
            ends[sites[i]][page.title.rpartition(" | ")[2].strip().lower()] += 1
    return {site: c.most_common(1)[0][0] for site, c in ends.items()}


class Repetition:
    """How often lines stand beside different articles of their site, and how many sites say them of themselves."""

    def __init__(self, pages: dict[str, Page], sites: dict[str, str]) -> None:
        self.names = site_names(pages, sites)
        beside: dict[tuple[str, str], set[str]] = defaultdict(set)
        said: dict[str, set[str]] = defaultdict(set)
        articles: dict[str, set[str]] = defaultdict(set)
        for i, page in pages.items():
            site, article = sites[i], article_of(page)
            articles[site].add(article)
            for text in {leaf.text for leaf in page.leaves}:
                beside[site, text].add(article)
                if shape := self.shape(site, text):
                    said[shape].add(site)
        self.beside, self.said, self.articles = ({k: len(v) for k, v in x.items()} for x in (beside, said, articles))

    def shape(self, site: str, text: str) -> str:
        """The line without the name of its site; empty where it does not name it."""
        name, low = self.names.get(site, ""), text.lower()
        for said in (name, fold(name)):
            if said and said in low:
                return low.replace(said, "*")
        return ""

    def furniture(self, site: str, text: str) -> bool:
        return self.beside.get((site, text), 0) >= REPEATED or self.said.get(self.shape(site, text), 0) >= REPEATED


def label(page: Page, site: str, repeated: Repetition) -> list[bool]:
    """For each leaf whether it counts as the article's."""

    heading = page.title.rpartition(" | ")[0] or page.title
    out = ["title" not in leaf.tags and (is_sentence(leaf.text) and not repeated.furniture(site, leaf.text) or bool(heading) and leaf.text == heading) for leaf in page.leaves]
    first = next((k for k, leaf in enumerate(page.leaves) if out[k] and is_sentence(leaf.text)), -1)
    if first < 0:
        return [False] * len(out)
    if not page.markup:
        above = [k for k in range(first) if page.leaves[k].node == page.leaves[first].node]
        own = [k for k in above if not repeated.furniture(site, page.leaves[k].text) and " > " not in page.leaves[k].text and not page.leaves[k].text[-1].isdigit()]
        for k in own[:1]:
            out[k] = True
    return out


def labelled(rows: list[tuple[str, str, str, int]]) -> dict[str, set[int]]:
    """The article's lines of the pages of (id, site, text, status) whose sites show enough; pages of an error status have none."""
    pages, sites = {i: read_page(text or "") for i, _, text, _ in rows}, {i: site for i, site, _, _ in rows}
    repeated = Repetition(pages, sites)
    good = [(i, site, status) for i, site, _, status in rows if repeated.articles[site] >= LEAST]
    return {i: {leaf.line for leaf, own in zip(pages[i].leaves, label(pages[i], site, repeated)) if own} if (status or 200) < 400 else set() for i, site, status in good}


def sample(truth: dict[str, set[int]], sites: dict[str, str]) -> list[str]:
    """The pages of a bounded sample, EACH of a site at most."""
    rng, by = random.Random(SEED), defaultdict(list)
    for i in sorted(truth):
        by[sites[i]].append(i)
    return [i for site in sorted(by) for i in rng.sample(by[site], min(len(by[site]), EACH))]
