"""Problem 4: variant spellings of names typed by people.

Method: suffix blocking.  A name is read as a core of accent-folded tokens (titles, kinds of organization and trades set
aside); since parts come reordered or run together, the suffixes are those of every order of its units, and the least is of
two units.  Suffixes are indexed within other fields that must agree (person or organization, kind of organization); one that
is still too common is refined by the slips of a third unit before it is given up.  The cores that ``likeness`` accepts with
fewer equal units have keys of their own, so every pair that it accepts shares a key, however common.

Cores that share a key are aligned and compared by their longest-common-subsequence ratio.  Links on a shared telephone
number, and between the same words in another order, are sure.  Any other link is followed only from one group of surely
linked names to the best of those of more whole words or more records whose fullest names are alike too, and not at all if
two strangers fit equally well: a cut or shortened name is no bridge.  A slip that turns one common word of the corpus into another counts only on a shared number.

Defined results: null names take no part; a name of one token links to equal cores of its kind alone; equal strings
are one node, so repeated rows add no comparisons; a null party agrees with null alone, a null number is shared with none;
extra columns are untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, paired_sides, python_udf
from .graph import components
from .pii import fold
from .textforms import skeleton

#: Least longest-common-subsequence ratio of two cores, and the largest block compared as it is.
RATIO, BLOCK = 0.8, 40
#: A word is common in the corpus if at least this share of the cores, and at least so many, hold it.
COMMON_SHARE, COMMON_LEAST = 0.002, 20
#: Two fits are equally good within this difference of their ratios.
EVEN = 0.02

#: Kinds of organization and how they are written.
KINDS = {
    "limited": ("cong ty trach nhiem huu han", "cty trach nhiem huu han", "cong ty tnhh", "cty tnhh", "c ty tnhh", "ct tnhh", "tnhh", "co ltd", "ltd"),
    "joint stock": ("cong ty co phan", "cty co phan", "c ty co phan", "cong ty cp", "cty cp", "c ty cp", "ctcp", "jsc"),
    "bank": ("ngan hang thuong mai co phan", "nhtmcp", "ngan hang tmcp", "n hang tmcp", "nh tmcp", "ngan hang", "n hang", "nh", "tmcp", "bank"),
    "hospital": ("bvien", "benh vien", "b vien", "bv", "hospital"),
    "clinic": ("pkham", "phong kham", "phong mach", "p kham", "p mach", "pk", "clinic"),
    "center": ("tr tam", "ttam", "trung tam", "t tam", "tt", "center", "centre"),
    "cooperative": ("hop tac xa", "h tac xa", "htx", "coop", "cooperative"),
    "private": ("doanh nghiep tu nhan", "doanh nghiep tn", "d nghiep tu nhan", "d nghiep tn", "dn tu nhan", "dntn", "dn", "private enterprise"),
    "": ("cong ty", "cty", "c ty", "company"),
}
#: Trades and their short forms.
TRADES = {
    "thuong mai": "tm", "xay dung": "xd", "quang cao": "qc", "thuy san": "ts", "bat dong san": "bds", "giao nhan": "gn", "in an": "ia", "may mac": "mm", "dien may": "dm",
    "noi that": "nt", "vien thong": "vt", "bao hiem": "bh", "duoc pham": "dp", "van tai": "vt", "du lich": "dl", "phan mem": "pm",
}
TITLES = frozenset("ong ba anh chi co chu bac be em di cau mo thim mr mrs ms miss dr bs ts ths thay chau a c".split())
#: Titles that a family name written with its accents cannot be mistaken for.
ACCENTED_TITLES = frozenset("ông bà anh chị cô chú bác bé em dì cậu mợ thím thầy mr mrs ms miss dr".split())
#: Titles that, without accents, may be a family name; such a core is compared with and without its first token.
FAMILY_TOO = frozenset(("be", "chu", "an", "di", "a", "c"))
#: The value of ``party`` that stands for a person: such a name has no kind and no trade.
PERSON = "PERSON"


def _words(words) -> re.Pattern:
    return re.compile(r"(?<![a-z0-9])(?:" + "|".join(sorted(words, key=len, reverse=True)) + r")(?![a-z0-9])")


_KIND_OF = {w: kind for kind, words in KINDS.items() for w in words}
_KIND = _words(_KIND_OF)
#: Trades of two words with the first cut to its initial, such as "v.thông", and what each way of writing stands for.
_SHORT_TRADES = {f"{t[0]} {t.split()[1]}": t for t in TRADES if t.count(" ") == 1}
_SHORT_TRADE = _words(_SHORT_TRADES)
_TRADE = _words([*TRADES, *TRADES.values()])


def parts(name: str, person: bool = False) -> tuple[tuple[str, ...], str, str]:
    """The tokens by which a name is known, its kind of organization and its trade as its initials, both "" if not said."""
    seen = skeleton(name)
    text = re.sub(r"[^a-z0-9]+", " ", fold(seen)).strip()
    kind = None if person else _KIND.search(text)
    trade = ""
    bare = _cut(_KIND, text)[0] if kind else text
    if not person:
        if kind or len(bare.split()) > 4:
            bare, trade = _cut(_TRADE, bare)
        if len(bare.split()) > 4:
            bare, short = _cut(_SHORT_TRADE, bare)
            trade = trade or short
    tokens = bare.split()
    first = re.match(r"\W*(\w*)", seen)[1]
    if not kind and (len(tokens) > 4 and tokens[0] in TITLES or len(tokens) == 4 and (first in ACCENTED_TITLES or first in TITLES - FAMILY_TOO)):
        tokens = tokens[1:]
    trade = _SHORT_TRADES.get(trade, trade)
    return tuple(tokens), _KIND_OF[kind[0]] if kind else "", TRADES.get(trade, trade)


def core(name: str) -> tuple[str, ...]:
    """The tokens by which a name is known."""
    return parts(name)[0]


def _cut(rx: re.Pattern, text: str) -> tuple[str, str]:
    """``text`` without the first match, if at least two tokens remain, and the match."""
    m = rx.search(text)
    rest = f"{text[: m.start()]} {text[m.end() :]}" if m else text
    return (rest, m[0]) if m and len(rest.split()) >= 2 else (text, "")


#: What a key's rows may meet (all but those run together alike, whole words only prefixes of others), as ``role``.
BOTH, WHOLE, PART = 0, 1, 2


def forms(tokens: tuple[str, ...]) -> list[tuple[str, ...]]:
    """A core as it is and, where its first token may be a title, without it."""
    return [tokens, tokens[1:]] if len(tokens) == 4 and tokens[0] in FAMILY_TOO else [tokens]


def units(tokens: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """(text, tokens covered as bits, whether run together): every token, and of three or more every two neighbours as one."""
    n = len(tokens)
    joined = [(tokens[i] + tokens[(i + 1) % n], 1 << i | 1 << (i + 1) % n, 1) for i in range(n)] if n > 2 else []
    return [(t, 1 << i, 0) for i, t in enumerate(tokens)] + joined


def slip_keys(unit: str) -> set[tuple[str, int]]:
    """(key, role): two units of which ``one_slip`` holds share a key, as BOTH or as WHOLE and PART."""
    cut = {("~" + unit[:i] + unit[i + 1 :], BOTH) for i in range(len(unit))}
    return cut | {("~" + unit, BOTH), ("<" + unit, WHOLE)} | {("<" + unit[:i], PART) for i in range(1, len(unit))}


def least_turn(text: str) -> str:
    return min(text[i:] + text[:i] for i in range(len(text)))


def whole_keys(tokens: tuple[str, ...]) -> set[tuple[str, int, int]]:
    """(key, joined, role) for the pairs of cores that are alike without two equal units: the same tokens or letters in
    another order, one core within the other, and one slip beside a single token and initials."""
    if len(tokens) < 2:
        return set()
    out: set[tuple[str, int, int]] = set()
    for form in forms(tokens):
        n, ordered = len(form), sorted(form)
        out |= {("s:" + " ".join(ordered), 0, BOTH), ("r:" + least_turn("".join(form)), 0, BOTH)}
        if n >= 4:
            longest = sorted(form, key=lambda t: (-len(t), t))
            out |= {(f"{k}:" + " ".join(sorted(longest[:k])), 0, WHOLE) for k in (2, 4)}
        if n >= 5:
            k = 4 if n <= 12 else 2
            out |= {(f"{k}:" + " ".join(c), 0, PART) for c in combinations(ordered, k)}
        for text, bits, joined in units(form):
            last = max(i for i in range(n) if bits >> i & 1 and not bits >> (i + 1) % n & 1)
            rest = [form[(last + k) % n] for k in range(1, n - bits.bit_count() + 1)]
            if sum(len(t) > 1 for t in rest) == 1:
                out |= {("1:" + " ".join(rest) + key, 2 * joined, role) for key, role in slip_keys(text)}
    return out


def pair_keys(tokens: tuple[str, ...]) -> set[tuple[str, int]]:
    """(key, joined): the least suffixes, two units of which at most one is run together."""
    out = set()
    for form in forms(tokens) if len(tokens) > 1 else ():
        for (x, p, i), (y, q, j) in combinations(units(form), 2):
            if not p & q and not (i and j):
                out.add((f"{x} {y}" if x <= y else f"{y} {x}", i | j))
    return out


def finer_keys(tokens: tuple[str, ...], pair: str, joined: int) -> set[tuple[str, int, int]]:
    """(key, joined, role): ``pair`` with the slips of every other unit.  A pair of cores that are alike by two equal
    units has another equal or nearly equal one, unless one is run together and all that is left is a missing token."""
    x, y = pair.split()
    out = set()
    for form in forms(tokens):
        n, own = len(form), units(form)
        for (s, p, i), (t, q, j) in combinations(own, 2):
            if p & q or i + j != joined or (s, t) not in ((x, y), (y, x)):
                continue
            for u, r, k in own:
                if not r & (p | q):
                    out |= {(f"{pair}{key}", joined + 2 * k, role) for key, role in slip_keys(u)}
            if n - (p | q).bit_count() <= 1:
                out.add((pair, 0, WHOLE if joined else PART))
    return out


def packed_key(key: str, joined: int = 0, role: int = BOTH) -> int:
    """A key as a signed 64-bit number whose last four bits are ``joined`` and ``role``; a hash in common only adds a comparison."""
    h = xxhash.xxh3_64_intdigest(key) & ~15 | joined << 2 | role
    return h - (1 << 64) if h >> 63 else h


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def one_slip(a: str, b: str) -> bool:
    """Whether two tokens differ by one letter, by two neighbours swapped, or one is cut short to an initial or more."""
    if a == b or a and b and (a.startswith(b) or b.startswith(a)):
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:]


def _aligned(a: tuple[str, ...], b: tuple[str, ...], most: int) -> list[tuple[str, str]] | None:
    """The units that meet where ``a`` becomes ``b`` by at most ``most`` slips, and at most one token missing or run together
    with the next; None where it doesn't."""

    def walk(i: int, j: int, equal: int, slips: int, gaps: int, sure: bool) -> list[tuple[str, str]] | None:
        if slips > most or gaps > 1 or slips + gaps > 2:
            return None
        if i == len(a) or j == len(b):
            gaps += len(a) - i + len(b) - j
            if gaps == 1:
                return [] if equal >= 3 or equal == 2 and slips == 1 and sure and most == 2 else None
            return [] if gaps == 0 and (equal >= 2 and equal + slips >= 3 or equal >= 1 and slips <= 1) else None
        x, y = a[i], b[j]
        if x == y:
            rest = walk(i + 1, j + 1, equal + (len(x) > 1), slips, gaps, sure)
            return None if rest is None else [(x, y), *rest]
        if one_slip(x, y) and (rest := walk(i + 1, j + 1, equal, slips + 1, gaps, sure and min(len(x), len(y)) >= 3)) is not None:
            return [(x, y), *rest]
        if i + 1 < len(a) and one_slip(xx := x + a[i + 1], y) and len(y) > max(len(x), 2) and (rest := walk(i + 2, j + 1, equal + (xx == y), slips + 1, gaps, sure)) is not None:
            return [(xx, y), *rest]
        if j + 1 < len(b) and one_slip(yy := y + b[j + 1], x) and len(x) > max(len(y), 2) and (rest := walk(i + 1, j + 2, equal + (yy == x), slips + 1, gaps, sure)) is not None:
            return [(x, yy), *rest]
        return walk(i + 1, j, equal, slips, gaps + 1, sure) if len(a) > len(b) else walk(i, j + 1, equal, slips, gaps + 1, sure) if len(b) > len(a) else None

    return walk(0, 0, 0, 0, 0, True)


def likeness(a: tuple[str, ...], b: tuple[str, ...]) -> float | None:
    """The ratio of two cores that name one entity, with their first tokens or, where these may be titles, without; or None."""
    found = (_likeness(x, y) for x in forms(a) for y in forms(b) if len(x) > 3 or len(y) > 3 or x == a and y == b)
    return max((r for r in found if r is not None), default=None)


def same(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    return likeness(a, b) is not None


def _likeness(a: tuple[str, ...], b: tuple[str, ...]) -> float | None:
    """The longest-common-subsequence ratio of the best alignment of two rotations, if that is at least RATIO.

    What one side leaves out, or cuts to an initial, is taken from the other before the ratio is asked, and lowers the result.
    """
    if sorted(a) == sorted(b) or "".join(a) == "".join(b):
        return 1.0
    if min(len(a), len(b)) < 2:
        return None
    left, right = _left(a, b), _left(b, a)
    if len(a) + len(b) - len(left) - len(right) >= 8 and not (left and right):  # one core stands in the other, beside unknown words
        return RATIO
    whole = "".join(a)
    for i in range(len(b)):
        turned = b[i:] + b[:i]
        if whole == "".join(turned):
            return 1.0
        # a family name is put last or a given name first; what is turned otherwise must not differ in letters too
        met = _aligned(a, turned, 2 if i == 0 else 1 if i in (1, len(b) - 1) else 0)
        if met is None:
            continue
        full = [(y, y) if len(x) <= 2 and y.startswith(x) else (x, x) if len(y) <= 2 and x.startswith(y) else (x, y) for x, y in met]
        got = ratio("".join(x for x, _ in full), "".join(y for _, y in full))
        if got >= RATIO:
            short = sum(x != p or y != q for (x, y), (p, q) in zip(met, full))
            return got - 0.2 * short if sum(map(len, a)) - sum(map(len, b)) == sum(len(x) - len(y) for x, y in met) else got - 0.4
    return None


def _left(a: tuple[str, ...], b: tuple[str, ...]) -> list[str]:
    """The tokens of ``a`` without those of ``b``, each counted."""
    rest, left = list(b), []
    for t in a:
        if t in rest:
            rest.remove(t)
        else:
            left.append(t)
    return left


def judged(node_a: str, node_b: str, common: frozenset[str]) -> tuple[float, bool, bool] | None:
    """(ratio, whether all is the same but the order, whether only common words differ) of two nodes whose cores are alike."""
    (side_a, a), (side_b, b) = ((x[0], tuple(x[2].split())) for x in (node_a.rpartition("|"), node_b.rpartition("|")))
    got = likeness(a, b)
    if got is None:
        return None
    left, right = _left(a, b), _left(b, a)
    turned = not left and not right or least_turn("".join(a)) == least_turn("".join(b))
    return got, turned and side_a == side_b, bool(left and right) and not turned and common.issuperset(left) and common.issuperset(right)


def _part_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for names, parties in batches:
        done = [parts(n, p == PERSON) for n, p in zip(names, parties)]
        yield pd.DataFrame([(" ".join(c), k, t) for c, k, t in done], columns=["core", "kind", "trade"])


def _key_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for cores in batches:
        split = [tuple(c.split()) for c in cores]
        yield pd.DataFrame({"whole": [[packed_key(*k) for k in whole_keys(t)] for t in split], "pair": [[packed_key(*k) for k in pair_keys(t)] for t in split]})


def _finer_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for cores, asked in batches:
        out = []
        for c, keys in zip(cores, asked):
            tokens, keys = tuple(c.split()), set(keys)
            out.append([packed_key(*f) for k, j in pair_keys(tokens) if packed_key(k, j) in keys for f in finer_keys(tokens, k, j)])
        yield pd.Series(out)


def _judge(common: frozenset[str]):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in batches:
            done = [judged(a, b, common) or (None, None, None) for a, b in zip(left, right)]
            yield pd.DataFrame(done, columns=["ratio", "turned", "strange"])

    return python_udf(run, "struct<ratio:double,turned:boolean,strange:boolean>")


def blocks(nodes: DataFrame) -> DataFrame:
    """(node, block, joined, role): the keys of every core within its fields, a suffix that more than BLOCK cores share being
    refined.  ``nodes``: (node, core, scopes), a scope being a combination of fields in which the name may be met."""
    keys = checkpointed(nodes.select("node", "core", "scopes", python_udf(_key_batches, "struct<whole:array<bigint>,pair:array<bigint>>")("core").alias("k")))

    def within(rows: DataFrame, kind: int) -> DataFrame:
        at = F.xxhash64(F.lit(kind), F.col("key").bitwiseAND(F.lit(-16).cast("bigint")), "scope")
        bits = [F.shiftright("key", 2).bitwiseAND(F.lit(3)).cast("byte").alias("joined"), F.col("key").bitwiseAND(F.lit(3)).cast("byte").alias("role")]
        return rows.withColumn("scope", F.explode("scopes")).select("node", "key", at.alias("block"), *bits)

    pairs = within(keys.select("node", "scopes", F.explode("k.pair").alias("key")), 1)
    met = pairs.groupBy("block").agg(F.count("*").alias("n"), F.min("joined").alias("plain")).where("n > 1 AND plain = 0").select("block", "n")
    pairs = pairs.join(met, "block")
    often = pairs.where(F.col("n") > BLOCK).groupBy("node").agg(F.collect_set("key").alias("keys"))  # at most the keys of one name
    finer = keys.select("node", "core", "scopes").join(often, "node").select("node", "scopes", F.explode(python_udf(_finer_batches, "array<bigint>")("core", "keys")).alias("key"))
    whole = within(keys.select("node", "scopes", F.explode("k.whole").alias("key")), 0)
    return pairs.where(F.col("n") <= BLOCK).drop("n").select(*whole.columns).unionByName(whole).unionByName(within(finer, 2)).drop("key")


def common_words(nodes: DataFrame) -> frozenset[str]:
    """The words of at least two letters that a share of all cores hold: by that share a few hundred at most reach the driver."""
    least = max(COMMON_LEAST, COMMON_SHARE * nodes.count())
    words = nodes.select(F.explode(F.array_distinct(F.split("core", " "))).alias("word")).where(F.length("word") > 1)
    return frozenset(r["word"] for r in words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect())


def name_links(nodes: DataFrame) -> DataFrame:
    """(a, b, ratio, turned, strange), a < b: pairs of distinct nodes whose cores are alike."""
    if "scopes" not in nodes.columns:
        nodes = nodes.select(F.col("core").alias("node"), "core", F.array(F.lit("")).alias("scopes"))
    keyed = checkpointed(blocks(nodes))
    left = keyed.where(F.col("role") != PART).withColumnRenamed("node", "a")
    right = keyed.where(F.col("role") != WHOLE).select(F.col("node").alias("b"), "block", F.col("joined").alias("joined_b"), F.col("role").alias("role_b"))
    met = left.join(right, "block").where("(a < b OR a > b AND (role <> 0 OR joined <> joined_b)) AND (joined & joined_b) = 0 AND (role = 0) = (role_b = 0)")
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    judged_pairs = pairs.withColumn("j", _judge(common_words(nodes))("a", "b"))
    return judged_pairs.where("j.ratio IS NOT NULL").select("a", "b", "j.*")


def _with_shared(links: DataFrame, numbers: DataFrame) -> DataFrame:
    """``links`` with ``shared``: whether both nodes stand on one number.  The node on fewer numbers is the one looked up by."""
    many = numbers.groupBy("node").agg(F.count("*").alias("m"))
    sized = links.join(many.withColumnsRenamed({"node": "a", "m": "m_a"}), "a", "left").join(many.withColumnsRenamed({"node": "b", "m": "m_b"}), "b", "left")
    less = F.coalesce("m_a", F.lit(0)) <= F.coalesce("m_b", F.lit(0))
    sides = sized.select("a", "b", F.when(less, F.col("a")).otherwise(F.col("b")).alias("node"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("other"))
    on = sides.join(numbers, "node").join(numbers.withColumnRenamed("node", "other"), ["other", "number"], "left_semi").select("a", "b").distinct()
    return links.join(on.withColumn("shared", F.lit(True)), ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(False)))


def _overlap(x: str, y: str) -> Column:
    """Whether two sets of said values have one in common, or one of them is empty."""
    return (F.size(x) == 0) | (F.size(y) == 0) | F.arrays_overlap(x, y)


def node_groups(nodes: DataFrame, numbers: DataFrame) -> DataFrame:
    """(node, entity): nodes (node, core, scopes, trades, n) joined by sure links, and by those of the others that lead to one
    fuller group alone."""
    said = nodes.select(F.col("node").alias("a"), F.col("trades").alias("t"))
    links = name_links(nodes).join(said, "a").join(said.withColumnsRenamed({"a": "b", "t": "u"}), "b").where(_overlap("t", "u")).drop("t", "u")
    links = checkpointed(_with_shared(checkpointed(links), numbers).where("shared OR NOT strange"))
    first = components(links.where("shared OR turned"), "a", "b")
    grouped = checkpointed(nodes.join(first, "node", "left").select("node", F.coalesce("component", "node").alias("group"), "n", F.size(F.filter(F.split("core", " "), lambda t: F.length(t) > 1)).alias("words")))
    lead = F.max_by("node", F.struct("words", "n", "node"))  # the fullest name stands for its group
    sizes = grouped.groupBy("group").agg(F.max("words").alias("words"), F.sum("n").alias("n"), lead.alias("lead"))
    own = grouped.join(sizes, "group", "left_semi").select("node", "group")
    loose = links.where("NOT (shared OR turned)").select("a", "b", "ratio")
    loose = loose.join(own.withColumnsRenamed({"node": "a", "group": "x"}), "a").join(own.withColumnsRenamed({"node": "b", "group": "y"}), "b").where("x <> y")
    loose = loose.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.max("ratio").alias("ratio"))
    side = F.struct("words", "n", F.col("group").alias("g"), "lead")
    loose = loose.join(sizes.select(F.col("group").alias("x"), side.alias("s")), "x").join(sizes.select(F.col("group").alias("y"), side.alias("t")), "y")
    loose = checkpointed(loose.where(_judge(frozenset())(F.col("s.lead"), F.col("t.lead"))["ratio"].isNotNull()))
    x, y = F.col("s"), F.col("t")
    up = loose.select(F.when(x < y, F.col("x")).otherwise(F.col("y")).alias("group"), F.greatest(x, y).alias("to"), "ratio")
    best = up.groupBy("group").agg(F.max("ratio").alias("best"))
    top = up.join(best, "group").where(F.col("ratio") >= F.col("best") - EVEN)
    top = top.groupBy("group").agg(F.count("*").alias("fits"), F.max("to")["g"].alias("to"), F.least(F.min("to.g"), F.max("to.g")).alias("x"), F.max("to.g").alias("y"))
    known = loose.select("x", "y", F.lit(True).alias("linked"))
    top = top.join(known, ["x", "y"], "left").where("fits = 1 OR fits = 2 AND linked")
    second = components(top.select("group", "to"), "group", "to").withColumnRenamed("node", "group")
    return grouped.join(second, "group", "left").select("node", F.coalesce("component", "group").alias("entity"))


def entities(df: DataFrame, record: str, name: str, party: str | None = None, number: str | None = None) -> DataFrame:
    """(record, name, entity): one row a record with a name; ``entity`` is the least node of its group.

    ``party`` names the field that tells persons (PERSON) from organizations (all else), ``number`` the telephone number's.
    """
    found = _entities(df, record, name, party, number)
    return found.select(F.col("_record").alias(record), F.col("_name").alias(name), F.col("_entity").alias("entity"))


def _entities(df: DataFrame, record: str, name: str, party: str | None, number: str | None) -> DataFrame:
    side = F.coalesce((F.col(f"`{party}`") == PERSON).cast("int"), F.lit(2)) if party else F.lit(2)
    where = F.col(f"`{number}`").cast("string") if number else F.lit(None).cast("string")
    rows = df.select(F.col(f"`{record}`").alias("_record"), F.col(f"`{name}`").alias("_name"), side.alias("_side"), where.alias("_number")).where("_name IS NOT NULL").dropDuplicates()
    spelled = rows.select("_name", "_side").distinct()
    read = python_udf(_part_batches, "struct<core:string,kind:string,trade:string>")("_name", F.when(F.col("_side") == 1, PERSON))
    spelled = spelled.withColumn("p", read).select("_name", "_side", "p.*").where("core <> ''")
    spelled = checkpointed(spelled.withColumn("node", F.concat_ws("|", F.col("_side").cast("string"), "kind", "core")))
    placed = checkpointed(rows.join(spelled, ["_name", "_side"]).select("_record", "_name", "_number", "node"))
    counted = placed.groupBy("node").agg(F.count("*").alias("n"))
    own = F.when((F.col("side") == 1) | (F.col("kind") != ""), F.array("kind")).otherwise(F.array(*[F.lit(k) for k in KINDS]))
    scopes = F.transform(own, lambda k: F.concat_ws("|", F.col("side").cast("string"), k))
    nodes = spelled.groupBy("node", F.col("_side").alias("side"), "kind", "core").agg(F.collect_set(F.when(F.col("trade") != "", F.col("trade"))).alias("trades"))
    nodes = checkpointed(nodes.withColumn("scopes", scopes).join(counted, "node").select("node", "core", "scopes", "trades", "n"))
    numbers = placed.where("_number IS NOT NULL").select("node", F.col("_number").alias("number")).distinct()
    found = node_groups(nodes, numbers)
    return placed.join(found, "node").select("_record", "_name", F.col("entity").alias("_entity")).distinct()


def variant_pairs(df: DataFrame, record: str, name: str, party: str | None = None, number: str | None = None) -> DataFrame:
    """(identity_a, identity_b), a < b: records of one entity whose names differ as strings; a large entity is paired in parts."""
    e = checkpointed(_entities(df, record, name, party, number))
    left, right = paired_sides(e, "_entity")
    a = left.select("_entity", "_part", F.col("_record").alias("identity_a"), F.col("_name").alias("name_a"))
    b = right.select("_entity", "_part", F.col("_record").alias("identity_b"), F.col("_name").alias("name_b"))
    return a.join(b, ["_entity", "_part"]).where("identity_a < identity_b AND name_a <> name_b").select("identity_a", "identity_b").distinct()
