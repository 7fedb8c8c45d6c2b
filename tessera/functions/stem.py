"""English stems by the published Porter algorithm, as built-in expressions over arrays of words.

Each step is one ``transform``, so an expression names its word once and does not grow from step to step. Words are
lower-cased runs of letters and digits; those of fewer than 3 or more than 64 characters stay as they are. Apply it to
a vocabulary, not to every word of a corpus.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST, MOST = 3, 64

# The algorithm's measures and suffix tables.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
MEASURED = f"^(?:{_C})?{_V}{_C}"
TWICE = f"^(?:{_C})?{_V}{_C}{_V}{_C}"
ONCE = f"^(?:{_C})?{_V}{_C}(?:{_V})?$"
VOWEL = f"^(?:{_C})?[aeiouy]"
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _less(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _plural(word: Column) -> Column:
    return F.when(word.rlike("(?:ss|i)es$"), _less(word, 2)).when(word.rlike("[^s]s$"), _less(word, 1)).otherwise(word)


def _past(word: Column) -> Column:
    """Cuts -ed and -ing and marks the rest with a plus sign, which no word holds."""
    long, ed, ing = _less(word, 3), _less(word, 2), _less(word, 3)
    eed = F.when(long.rlike(MEASURED), _less(word, 1)).otherwise(word)
    return F.when(word.endswith("eed"), eed).when(word.endswith("ed") & ed.rlike(VOWEL), F.concat(ed, F.lit("+"))).when(word.endswith("ing") & ing.rlike(VOWEL), F.concat(ing, F.lit("+"))).otherwise(word)


def _mend(marked: Column) -> Column:
    bare = _less(marked, 1)
    twin = bare.rlike("[^aeiouylsz]$") & (F.right(bare, F.lit(1)) == F.substring(bare, F.length(bare) - 1, F.lit(1))) & (F.length(bare) > 1)
    with_e = bare.rlike("(?:at|bl|iz)$") | (~twin & bare.rlike(ONCE) & bare.rlike(SHORT))
    return F.when(~marked.endswith("+"), marked).when(with_e, F.concat(bare, F.lit("e"))).when(twin, _less(marked, 2)).otherwise(bare)


def _last_y(word: Column) -> Column:
    return F.when(word.endswith("y") & _less(word, 1).rlike(VOWEL), F.concat(_less(word, 1), F.lit("i"))).otherwise(word)


def any_of(suffixes: object) -> str:
    """A pattern whose groups are the rest and the longest of the suffixes."""
    return f"^(.+?)({'|'.join(suffixes)})$"


def _swap(word: Column, table: dict[str, str]) -> Column:
    rest, suffix = F.regexp_extract(word, any_of(table), 1), F.regexp_extract(word, any_of(table), 2)
    new = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), suffix)
    return F.when(rest.rlike(MEASURED), F.concat(rest, new)).otherwise(word)


def _fourth(word: Column) -> Column:
    rest, ion = F.regexp_extract(word, any_of(FOURTH), 1), F.regexp_extract(word, "^(.*[st])ion$", 1)
    return F.when(rest.rlike(TWICE), rest).when(ion.rlike(TWICE), ion).otherwise(word)


def _last_e(word: Column) -> Column:
    bare = _less(word, 1)
    return F.when(word.endswith("e") & (bare.rlike(TWICE) | (bare.rlike(ONCE) & ~bare.rlike(SHORT))), bare).otherwise(word)


def _last_l(word: Column) -> Column:
    return F.when(word.endswith("ll") & word.rlike(TWICE), _less(word, 1)).otherwise(word)


def stems(words: Column) -> Column:
    """The stem of each word of an array; a null array gives null."""
    out = words
    for step in (_plural, _past, _mend, _last_y, lambda w: _swap(w, SECOND), lambda w: _swap(w, THIRD), _fourth, _last_e, _last_l):
        out = F.transform(out, step)
    fits = lambda w: F.length(w).between(LEAST, MOST)
    return F.transform(F.arrays_zip(words.alias("word"), out.alias("stem")), lambda x: F.when(fits(x["word"]), x["stem"]).otherwise(x["word"]))


def forms(stem: str) -> str:
    """A pattern that every word of this stem matches: a stem begins its words, but for its last letter where that is
    an e or i or the l of -bl."""
    begins = stem[:-1] if stem.endswith(("e", "i", "bl")) else stem
    return rf"{begins}[\p{{L}}\p{{N}}]*"
