"""Letters without their diacritics, as an expression: "café" and "cafe" become one word."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks of Latin letters, and of the marks that may follow a letter.
LATIN = ((0x00C0, 0x024F), (0x1E00, 0x1EFF))
MARKS = (0x0300, 0x036F)


@functools.cache
def _table() -> tuple[str, str]:
    """Letters that decompose into a letter and marks, with the letters they become; marks come last and become nothing."""
    plain = {}
    for first, last in LATIN:
        for c in map(chr, range(first, last + 1)):
            base, *marks = unicodedata.normalize("NFD", c)
            if marks and all(unicodedata.category(m) == "Mn" for m in marks):
                plain[c] = base
    return "".join(plain) + "".join(map(chr, range(MARKS[0], MARKS[1] + 1))), "".join(plain.values())


def folded(text: Column) -> Column:
    """Letters of the Latin script lose their diacritics, written as one character or as several. Letters that are no
    composition (such as ø, ł, ß or æ) and other scripts stay; plain ASCII texts are not touched."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(text, *_table())).otherwise(text)
