"""What of a source text is code: comments and literals blanked out, and the extent of blocks.

A text is cut into tokens by one pattern for each family of languages, tried from left to right as a lexer does, so a
quote within a comment or a comment mark within a string means nothing. Tokens that are no code become blanks of the
same length; line breaks stay, so every line and column keeps its place. All quantifiers that span a literal are
possessive: nothing is tried twice, and literals of any length need no stack. Templates are looked into: what stands
in ``${...}`` is code, down to TEMPLATES templates within each other.

Blocks are found by one fold over the lines, with a stack of the declarations that are open: a declaration ends with
the bracket that closes the block it opened, on whatever line, or with its semicolon if it opens none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TEMPLATES = 2

_DOUBLE = r'"(?:[^"\\\n]++|\\.)*+"'
_SINGLE = r"'(?:[^'\\\n]++|\\.)*+'"
_CHAR = r"'(?:[^'\\\n]|\\[^\n][^'\n]{0,8}+)'"
_TRIPLE = r'"""(?:[^"\\]++|\\.|"(?!""))*+"""'
_TRIPLE_SINGLE = r"'''(?:[^'\\]++|\\.|'(?!''))*+'''"
_LINE = r"//[^\n]*+"
_HASH = r"#[^\n]*+"
_BLOCK = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)"
_REGEX = r"(?<=[(,=:\[!&|?{};]\s{0,4}|\breturn\s{1,4})/(?![*/])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*+"
_WORD, _PLAIN = r"\w++", r"[^\w\"'`/#<=@$]++"


def _nested(depth: int) -> str:
    """Block comments that may hold others, ``depth`` deep."""
    inner = "".join(["|", _nested(depth - 1)]) if depth else ""
    return rf"/\*(?:[^*/]++|\*(?!/)|/(?!\*){inner})*+\*/"


def _template(depth: int) -> str:
    """A JavaScript template; in its ``${...}`` brackets, strings and further templates are taken as a whole."""
    inner = "".join(["|", _template(depth - 1)]) if depth else ""
    braces = r"\{(?:[^{}\"'`]++|" + _DOUBLE + "|" + _SINGLE + inner + r"|\{[^{}`]*+\})*+\}"
    return rf"`(?:[^`\\$]++|\\.|\$(?!\{{)|\${braces})*+`"


_RUST_RAW = r'b?r(?<rust>#*+)"(?:[^"]++|"(?!\k<rust>))*+"\k<rust>'
_CPP_RAW = r'R"(?<cpp>[^()\\\s]{0,16}+)\((?:[^)]++|\)(?!\k<cpp>"))*+\)\k<cpp>"'
_VERBATIM = r'\$?@\$?"(?:[^"]++|"")*+"'
_PHP_DOC = r"<<<[ \t]*+['\"]?(?<php>\w++)['\"]?\n(?:(?![ \t]*+\k<php>\b)[^\n]*+\n)*+[ \t]*+\k<php>"
_RUBY_DOC = r"<<[~-]?(?<quote>['\"`]?)(?<ruby>[A-Z_]\w*+)\k<quote>[^\n]*+\n(?:(?![ \t]*+\k<ruby>[ \t]*+(?:\n|\z))[^\n]*+\n)*+[ \t]*+\k<ruby>"
_RUBY_BLOCK = r"(?<=\n|\A)=begin\b(?:(?!\n=end).)*+\n=end[^\n]*+"

#: Literals and comments of each family, in the order in which they are tried.
FAMILIES = {
    ("typescript", "javascript"): (_BLOCK, _LINE, _REGEX, _template(TEMPLATES), _DOUBLE, _SINGLE),
    ("python",): (_TRIPLE, _TRIPLE_SINGLE, _HASH, _DOUBLE, _SINGLE),
    ("go",): (_BLOCK, _LINE, r"`[^`]*+`", _DOUBLE, _CHAR),
    ("rust",): (_nested(3), _LINE, _RUST_RAW, r'"(?:[^"\\]++|\\.)*+"', _CHAR),
    ("java", "c"): (_BLOCK, _LINE, _TRIPLE, _DOUBLE, _CHAR),
    ("cpp",): (_BLOCK, _LINE, _CPP_RAW, _DOUBLE, _CHAR),
    ("csharp",): (_BLOCK, _LINE, _VERBATIM, _TRIPLE, _DOUBLE, _CHAR),
    ("kotlin", "swift"): (_nested(3), _LINE, _TRIPLE, _DOUBLE, _CHAR),
    ("dart",): (_nested(3), _LINE, _TRIPLE, _TRIPLE_SINGLE, _DOUBLE, _SINGLE),
    ("php",): (_BLOCK, _LINE, r"#(?!\[)[^\n]*+", _PHP_DOC, r'"(?:[^"\\]++|\\.)*+"', r"'(?:[^'\\]++|\\.)*+'"),
    ("ruby",): (_RUBY_BLOCK, _HASH, _RUBY_DOC, r'"(?:[^"\\]++|\\.)*+"', r"'(?:[^'\\]++|\\.)*+'"),
}
#: Languages whose blocks stand in braces.
BRACES = ("typescript", "javascript", "go", "rust", "java", "c", "cpp", "csharp", "kotlin", "swift", "dart", "php")
_NO_CODE = r"""^(?:[/"'`#]|<<|=begin|[bBrRuUfF]{1,3}#*["']|\$?@\$?")"""


def _blank(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\n]", " ")


def _masked(text: Column, parts: tuple[str, ...], templates: int) -> Column:
    pattern = "(?s)" + "|".join([*parts, _WORD, _PLAIN, "."])

    def token(t: Column) -> Column:
        blank = _blank(t)
        if templates:
            pieces = F.regexp_extract_all(t, F.lit(r"(?s)\$\{(?:[^{}]++|\{[^{}]*+\})*+\}|\\.|[^$\\]++|."), F.lit(0))
            inner = lambda p: F.when(p.startswith("${"), F.concat(F.lit("  "), _masked(F.substring(p, F.lit(3), F.length(p) - 3), parts, templates - 1), F.lit(" "))).otherwise(_blank(p))
            blank = F.when(t.startswith("`") & t.contains("${"), F.array_join(F.transform(pieces, inner), "")).otherwise(blank)
        return F.when((F.length(t) > 1) & t.rlike(_NO_CODE), blank).otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), token), "")


def code_only(text: Column, language: Column) -> Column:
    """The text with comments and literals as blanks. Of a language that has no family here nothing is blanked."""
    cases = [(names, _masked(text, parts, TEMPLATES if _template(TEMPLATES) in parts else 0)) for names, parts in FAMILIES.items()]
    return reduce(lambda out, case: out.when(language.isin(*case[0]), case[1]), cases[1:], F.when(language.isin(*cases[0][0]), cases[0][1])).otherwise(text)


def braces(line: Column) -> Column:
    """Of a line of code: delta (opened less closed braces), and the least and greatest count on the way through it."""
    only = F.regexp_replace(line, r"[^{}]", "")
    start = F.struct(F.lit(0).alias("delta"), F.lit(1 << 20).alias("low"), F.lit(0).alias("high"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["delta"] + F.when(c == "{", 1).otherwise(-1)
        return F.struct(now.alias("delta"), F.least(acc["low"], now).alias("low"), F.greatest(acc["high"], now).alias("high"))

    return F.when(only == "", start).otherwise(F.aggregate(F.filter(F.split(only, ""), lambda c: c != ""), start, step))


_OPEN = "array<struct<k:int,depth:int,opened:boolean,tentative:boolean,holds:boolean,parent:int>>"
_DONE = "array<struct<k:int,end:int,parent:int>>"


def extents(outline: Column) -> Column:
    """For the declarations of an outline: place in the outline (k), last line (end) and place of the parent, or -1.

    An entry of the outline has line, delta, low, high (see :func:`braces`), stops (ends with a semicolon), name (what
    it declares, else empty), method (what it declares if it stands right within a type, else empty), plain (what it
    declares if it stands in no block, else empty), and holds (declares a type, which methods stand in). What only
    looks like a method or function, and opens no block, is none.
    """
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("depth"), F.lit(0).alias("last"), F.array().cast(_OPEN).alias("open"), F.array().cast(_DONE).alias("done"))
    ended = lambda e, line: F.struct(e["k"].alias("k"), line.alias("end"), e["parent"].alias("parent"))

    def step(acc: Column, x: Column) -> Column:
        depth, top = acc["depth"], F.try_element_at(acc["open"], F.lit(-1))
        within = F.coalesce(top["holds"] & top["opened"] & (depth == top["depth"] + 1), F.lit(False))
        tentative = (x["name"] == "") & (((x["method"] != "") & within) | ((x["plain"] != "") & (F.size(acc["open"]) == 0) & (depth == 0)))
        declares = (x["name"] != "") | tentative
        # what has opened no block by now is over if this declares something
        over = F.filter(acc["open"], lambda e: declares & ~e["opened"] & ~e["tentative"])
        held = F.filter(acc["open"], lambda e: ~declares | e["opened"])
        parent = F.coalesce(F.try_element_at(held, F.lit(-1))["k"], F.lit(-1))
        own = F.struct(acc["k"].alias("k"), depth.alias("depth"), F.lit(False).alias("opened"), tentative.alias("tentative"), x["holds"].alias("holds"), parent.alias("parent"))
        now = F.transform(F.when(declares, F.concat(held, F.array(own))).otherwise(held), lambda e: e.withField("opened", e["opened"] | (depth + x["high"] > e["depth"])))
        closes = lambda e: F.when(e["opened"], depth + x["low"] <= e["depth"]).otherwise(x["stops"] & (depth + x["delta"] == e["depth"]))
        closed = F.filter(now, lambda e: closes(e) & (e["opened"] | ~e["tentative"]))
        done = F.concat(acc["done"], F.transform(over, lambda e: ended(e, acc["last"])), F.transform(closed, lambda e: ended(e, x["line"])))
        return F.struct((acc["k"] + 1).alias("k"), (depth + x["delta"]).alias("depth"), x["line"].alias("last"), F.filter(now, lambda e: ~closes(e)).cast(_OPEN).alias("open"), done.cast(_DONE).alias("done"))

    def finish(acc: Column) -> Column:
        rest = F.filter(acc["open"], lambda e: e["opened"] | ~e["tentative"])
        return F.array_sort(F.concat(acc["done"], F.transform(rest, lambda e: ended(e, acc["last"])).cast(_DONE)))

    return F.aggregate(outline, start, step, finish)
