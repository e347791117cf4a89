"""Problem 3: visually identical text with different characters.

Method: script-aware repair.  Characters come to one form first (wide forms, blanks, invisible characters, accents);
then the dominant script of each token of mixed script is found by counting its letters, and those of other scripts that
look alike are replaced, towards the dominant script first, then towards Latin, and only when the result is a word of the
corpus vocabulary.  The vocabulary alone tells a Latin word whose letters have all been replaced from a word of another script.

Defined results: null stays null, empty stays empty; emoji keep their joiners and selectors; words wholly of another
script that read as no word of the corpus, typographic quotes and dashes stay; repeated rows come out alike; extra columns
are untouched.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, checkpointed, prefixed, python_udf

#: Letters of other scripts that look like Latin ones, in the order of the Latin letter.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ү": "y", "п": "n",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "ё": "ë", "ї": "ï",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "η": "n", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    "օ": "o", "ս": "u", "ո": "n", "ց": "g", "հ": "h", "ѡ": "w",
}
#: Latin letters of other languages that look like Vietnamese or English ones.
FOREIGN_LATIN = {"Ð": "Đ", "ð": "đ", "Ɖ": "Đ", "ɖ": "đ", "ı": "i", "ɑ": "a", "ɡ": "g", "ȷ": "j", "ſ": "s", "ᴏ": "o"}
_ALIKE = str.maketrans(LOOK_ALIKES | FOREIGN_LATIN)
#: Look-alikes of the shape of small capitals or of a loose likeness: no word of these and others alone passes for a Latin one.
LOOSE = frozenset("вкмтпαειηκρτυχ")
#: The scripts towards which a token may be repaired, and each one's look-alikes of Latin letters (the first of several).
_TOWARDS: dict[str, dict[int, str]] = {"CYRILLIC": {}, "GREEK": {}}
for _other, _latin in LOOK_ALIKES.items():
    for _name, _table in _TOWARDS.items():
        if unicodedata.name(_other).startswith(_name):
            _table.setdefault(ord(_latin), _other)

#: Precomposed letters of Vietnamese beyond ASCII, both cases.
VIETNAMESE = "".join(
    sorted({c for base in "aăâeêioôơuưy" for tone in ("", "\u0300", "\u0301", "\u0303", "\u0309", "\u0323") for x in (base,) for c in (unicodedata.normalize("NFC", x + tone), unicodedata.normalize("NFC", x + tone).upper()) if ord(c) > 127} | {"đ", "Đ"})
)


def ranges(chars: str) -> str:
    """A character class's inside with runs of code points as ranges: an engine tests a few ranges, not every letter."""
    runs: list[list[int]] = []
    for c in sorted(set(map(ord, chars))):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\u{a:04X}-\\u{b:04X}" if b > a else f"\\u{a:04X}" for a, b in runs)


#: The inside of a class of capital letters.
UPPER = "A-Z" + ranges("".join(c for c in VIETNAMESE if c.isupper()))
#: Characters that need no look: a text of these alone is in the one form already.
PLAIN = r"\x20-\x7E" + ranges(VIETNAMESE + "\u201c\u201d\u2018\u2019\u2013\u2014\u2026\u00ab\u00bb")
SUSPECT = f"[^{PLAIN}]"

_INVISIBLE = re.compile(r"[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁪-⁯︀-️﻿￹-￻\U000e0000-\U000e007f]")
_BLANK = re.compile(r"[\t\x0b\x0c\r\u0085   -     　]")
_WIDE = re.compile(r"[！-￮\U0001d400-\U0001d7ff]+")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*", re.UNICODE)


def _emoji(c: str) -> bool:
    return bool(c) and ("\U0001f000" <= c <= "\U0001faff" or c in "‍️⃣" or unicodedata.category(c) == "So")


def _joining(c: str) -> bool:
    """Letters of scripts in which joiners change how words are read."""
    return bool(c) and "֐" <= c <= "႟"


def char_form(text: str) -> str:
    """Wide forms, blanks, invisible characters and accents in one form; letters of other scripts stay."""
    if _INVISIBLE.search(text):
        out = []
        for i, c in enumerate(text):
            if _INVISIBLE.match(c):
                before, after = text[i - 1] if i else "", text[i + 1] if i + 1 < len(text) else ""
                if c == "‍" and _emoji(before) and _emoji(after) or "︀" <= c <= "️" and before and not before.isalpha() and ord(before) > 127:
                    out.append(c)
                elif c in "‌‍" and _joining(before):
                    out.append(c)
                continue
            out.append(c)
        text = "".join(out)
    text = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), _BLANK.sub(" ", text))
    return unicodedata.normalize("NFC", text)


def _script(c: str) -> str:
    if c < "\u0250":
        return "LATIN"
    if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
        return "GREEK"
    if "Ѐ" <= c <= "ԯ":
        return "CYRILLIC"
    if "Ḁ" <= c <= "ỿ":
        return "LATIN"
    return unicodedata.name(c, "?").partition(" ")[0]


def towards(word: str, script: str) -> str:
    """``word`` with every look-alike letter of another script in ``script``, marks staying on their letters."""
    table = _ALIKE if script == "LATIN" else _TOWARDS.get(script, {})
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", word).translate(table))


def odd_words(text: str) -> list[tuple[int, int, list[str], bool]]:
    """(start, end, candidates for repair, whether of mixed script) of what may be repaired in ``text`` (in char_form).

    A word with letters of a second script or language is tried towards the script of most of its letters (Latin among
    equals), then towards Latin.  Words without a Latin letter are tried towards Latin if all of their letters are close
    look-alikes, neighbours of one script together: a word among others of its own script is read as one of that script.
    """
    found: list[tuple[int, int, list[str], bool]] = []
    runs: list[list[int]] = []
    last = ""
    for m in _WORD.finditer(text):
        word = m[0]
        if word.isascii():
            last = ""
            continue
        scripts: dict[str, int] = {}
        foreign = False
        for c in word:
            if c.isalpha():
                if ord(c) > 127:
                    foreign |= c in FOREIGN_LATIN
                s = _script(c)
                scripts[s] = scripts.get(s, 0) + 1
        own = "" if "LATIN" in scripts else " ".join(sorted(scripts))
        if own and own == last:
            runs[-1][1] = m.end()
        elif own:
            runs.append([m.start(), m.end()])
        elif len(scripts) > 1 or foreign:
            dominant = max(scripts, key=lambda s: (scripts[s], s == "LATIN"))
            tried = {script: towards(word, script) for script in (dominant, "LATIN")}
            good = [r for script, r in tried.items() if all(_script(c) == script for c in r if c.isalpha())]
            if good:
                found.append((m.start(), m.end(), good, True))
        last = own
    for start, end in runs:
        latin = towards(text[start:end], "LATIN")
        if LOOSE.isdisjoint(unicodedata.normalize("NFD", text[start:end])) and all(_script(c) == "LATIN" for c in latin if c.isalpha()):
            found.append((start, end, [latin], False))
    return sorted(found)


def skeleton(text: str) -> str:
    """What a reader sees, for keys: char_form with every look-alike letter replaced, in lower case."""
    return towards(char_form(text), "LATIN").lower()


FORM = "struct<form:string,words:array<struct<word:string,repaired:array<string>,mixed:boolean>>>"


def _form_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        forms = [None if t is None else char_form(t) for t in texts]
        words = [[] if f is None else [{"word": w, "repaired": r, "mixed": x} for w, (r, x) in {f[a:b]: (r, x) for a, b, r, x in odd_words(f)}.items()] for f in forms]
        yield pd.DataFrame({"form": forms, "words": words})


def _replaced(form: str, known: dict[str, str]) -> str:
    out, at = [], 0
    for a, b, *_ in odd_words(form):
        out += [form[at:a], known.get(form[a:b], form[a:b])]
        at = b
    return "".join([*out, form[at:]])


def _replace_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for forms, repairs in batches:
        yield pd.Series([form if form is None or rows is None else _replaced(form, {r["word"]: r["repaired"] for r in rows}) for form, rows in zip(forms, repairs)])


def skeleton_column(text: Column) -> Column:
    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: None if t is None else skeleton(t))

    return F.when(~text.rlike(SUSPECT), F.lower(text)).otherwise(python_udf(batches, "string")(text))


ODD = "struct<odd:boolean,words:array<struct<word:string,repaired:array<string>>>>"


def _irregular_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        odd, words = [], []
        for t in texts:
            f = char_form(t)
            met = odd_words(f)
            odd.append(f != t or any(mixed for *_, mixed in met))
            words.append([] if odd[-1] else [{"word": f[a:b], "repaired": r} for a, b, r, _ in met])
        yield pd.DataFrame({"odd": odd, "words": words})


#: What parts the words of the vocabulary.
_APART = r"[^\p{L}\p{M}\p{Cf}]+"


def vocabulary(df: DataFrame, text: str, asked: DataFrame) -> DataFrame:
    """The words (column ``word``, in lower case) of ``asked`` that stand as whole words of one script somewhere in the texts.

    Words are looked up while texts are split, so what is shuffled is only what was asked for.
    """
    words = F.split(F.lower(F.col(text)), _APART)
    asked = checkpointed(asked.select("word").distinct())
    return df.select(F.explode(words).alias("word")).join(bounded_broadcast(asked, asked.count(), 64), "word", "left_semi").distinct()


def confirmed(df: DataFrame, text: str, met: DataFrame) -> DataFrame:
    """(word, repaired): for each met word (or neighbours tried together) the first candidate made of words of the vocabulary."""
    tried = met.select("word", F.posexplode("repaired").alias("turn", "repaired")).distinct()
    parts = tried.withColumn("_parts", F.array_distinct(F.filter(F.split(F.lower("repaired"), _APART), lambda p: p != "")))
    parts = parts.select("*", F.size("_parts").alias("_n"), F.explode("_parts").alias("lower")).drop("_parts")
    stand = parts.join(vocabulary(df, text, parts.select(F.col("lower").alias("word"))).withColumnRenamed("word", "lower"), "lower", "left_semi")
    good = stand.groupBy("word", "turn", "repaired", "_n").agg(F.count("*").alias("_known")).where("_known = _n")
    return good.groupBy("word").agg(F.min_by("repaired", "turn").alias("repaired"))


def unified(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``df`` with ``form`` (the text in the one form), ``changed`` and ``odd_words``: how many words of mixed script it holds.

    ``keys`` name a row; rows that share them must hold the same text.  Only texts with a character outside the plain
    alphabet go to Python; the vocabulary and the confirmation of candidates are relational.
    """
    if {*keys, text} & {"form", "changed", "odd_words", "words", "repairs"}:
        raise ValueError("keys and text must not be named like the operator's own columns")
    rows = prefixed(df, [*keys, text])
    done = unified_suspects(df, rows.select(*keys, text).where(F.col(text).rlike(SUSPECT)), keys, text).drop(text)
    return (
        rows.join(done.withColumnRenamed("form", "_form"), keys, "left")
        .withColumn("form", F.coalesce("_form", F.col(text)))
        .withColumn("changed", F.coalesce(F.col("form") != F.col(text), F.lit(False)))
        .withColumn("odd_words", F.coalesce("odd_words", F.lit(0)))
        .drop("_form")
    )


def irregular(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The keys, once each, of texts that come to another form, hold words of mixed script, repaired or not, or hold words
    without a Latin letter that read as words of the vocabulary.

    A word that the vocabulary repairs towards its own script is of mixed script already, so only words of the last kind are looked up.
    """
    rows = df.select(*keys, text).where(F.col(text).rlike(SUSPECT)).select(*keys, python_udf(_irregular_batches, ODD)(F.col(text)).alias("_f"))
    rows = checkpointed(rows.where("_f.odd OR size(_f.words) > 0"))
    met = rows.select(*keys, F.explode("_f.words").alias("_w"))
    known = confirmed(df, text, met.select("_w.word", "_w.repaired"))
    read = met.join(known.select(F.col("word").alias("_known")), F.col("_w.word") == F.col("_known"), "left_semi")
    return rows.where("_f.odd").select(*keys).unionByName(read.select(*keys)).distinct()


def unified_suspects(df: DataFrame, rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """As ``unified``, for the rows with a suspect character alone; the vocabulary is that of all of ``df``."""
    formed = rows.dropDuplicates(keys).withColumn("_f", python_udf(_form_batches, FORM)(F.col(text)))
    formed = checkpointed(formed.select(*keys, text, F.col("_f.form").alias("form"), F.col("_f.words").alias("words")))
    met = formed.select(*keys, F.explode("words").alias("w")).select(*keys, "w.word", "w.repaired")
    repairs = met.select(*keys, "word").join(confirmed(df, text, met), "word").groupBy(*keys).agg(F.collect_list(F.struct("word", "repaired")).alias("repairs"))
    odd_words = F.size(F.filter("words", lambda w: w["mixed"])).alias("odd_words")
    return formed.join(repairs, keys, "left").select(*keys, text, python_udf(_replace_batches, "string")("form", "repairs").alias("form"), odd_words)
