"""Secret scans (operator 3): fixed shapes, and sliding-window entropy. Built-in functions only.

Base spans are the leftmost, non-overlapping matches of three shapes that are long enough. The method adds spans:
candidate strings are runs of one character class; a window of a fixed number of characters slides over each. The
window's Shannon entropy is kept up by counts: a string holds how often each character of the class is in the window,
and as a character enters or leaves, one count and one term of the sum of c * log2(c) change. A stretch of windows
above the class's threshold is a span, unless the allow-list matches the whole candidate or a base span already covers
the stretch. A repetition or a placeholder word that is only a piece of a candidate allows nothing else in it: base64
keys hold padding, and values follow paths.

Places are code points, ends exclusive. A row's spans are found within the row, so a hot source moves no data. Long
runs are cut into pieces that overlap by a window less a character, and stretches that meet at a cut are joined, so
the time grows with the length of a run and not with its square; no pattern here goes back over a run or recurses.
Which spans cover which is found in one pass over a text's sorted spans, however many it has.

Defined results: a null text counts as empty and has no span; repeated rows are scanned one by one; an empty table
gives an empty result; a text or run of any length is read whole; of spans that start together the kind listed first
is written first; other columns, whatever their names, pass through ``redact`` untouched and are not read by ``scan``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (kind, pattern, group whose length counts, least length), in the order that spans of one start take.
SHAPES = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: (kind, characters of the class, least length of a candidate, what it must hold besides, least bits a character).
CLASSES = (
    ("entropy_base64", "A-Za-z0-9+/_=-", 24, r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])", 3.7),
    ("entropy_hex", "0-9A-Fa-f", 24, r"^(?=[^0-9]*[0-9])(?=[^A-Fa-f]*[A-Fa-f])", 3.0),
)
#: Characters of the sliding window.
WINDOW = 20
#: Windows of one piece of a candidate, and matches that are placed by one fold.
PIECE, BLOCK = 512, 256
#: Words, numbers and camel-case names, as placeholders are made of; not the mixed runs that keys are made of.
_NAME = r"(?:[A-Z]?[a-z]{1,15}(?:[A-Z][a-z]{2,15}){0,3}[0-9]{0,4}|[A-Z]{1,15}[0-9]{0,4}|[0-9]{1,4})(?=[+/_=-]|$)"
#: Whole candidates of these shapes are no secrets: UUIDs, placeholders, repetitions of one character, paths of words.
#: Loops are possessive: they neither go back nor use the stack, however long the candidate is.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    rf"^(?=.*(?i:example|placeholder|dummy|changeme|redacted|lorem))[+/_=-]*+{_NAME}(?:[+/_=-]++{_NAME})*+[+/_=-]*+$",
    r"^(?:(.)\1{7,}+)++$",
    r"^/?(?:[A-Za-z]++[/_-])++[A-Za-z]*+[0-9]{0,4}$",
)
REDACTED = "[REDACTED]"

_KINDS = [s[0] for s in SHAPES] + [c[0] for c in CLASSES]
_C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]
#: Characters of all classes lie between these; a window's counts are a string with one place for each.
_FIRST, _LAST = ord("+"), ord("z")
_PLACES, _STRETCHES = "array<struct<start:int,end:int,found:string>>", "array<struct<start:int,end:int>>"
_SPANS = "array<struct<start:int,kind:int,end:int>>"

# The expressions below are SQL text: they are large, and text is parsed much faster than columns are composed.


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, then: str) -> str:
    """``then``, in which ``name`` stands for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {then}), 0)"


def _blocks(xs: str) -> str:
    """The array, which is not empty, cut into blocks: a fold over blocks copies no array that grows with the text."""
    return f"transform(sequence(0, cast(floor((size({xs}) - 1) / {BLOCK}) AS int)), k -> slice({xs}, k * {BLOCK} + 1, {BLOCK}))"


def _finds(text: str, pattern: str, one: str) -> str:
    """Array of (start, end, found) of all matches of ``pattern``; ``one`` is a pattern that some match needs.

    Each element that the extraction gives is what lies before a match, and the match. ``\\G`` ties it to the end of
    the last, so the rest behind the last match is read once and not again from each of its characters. Matches are
    placed by blocks, so that no step copies all that were placed before it.
    """
    none = f"cast(array() AS {_PLACES})"
    found = f"transform(regexp_extract_all({text}, {_quoted(rf'(?s)\G.*?(?:{pattern})')}, 0), p -> named_struct('n', length(p), 'found', regexp_extract(p, {_quoted(pattern)}, 0)))"
    place = "(a, x) -> named_struct('at', a.at + x.n, 'out', concat(a.out, array(named_struct('start', a.at + x.n - length(x.found), 'end', a.at + x.n, 'found', x.found))))"
    block = f"(acc, b) -> aggregate(b, named_struct('at', acc.at, 'out', {none}), {place}, d -> named_struct('at', d.at, 'out', concat(acc.out, array(d.out))))"
    folded = f"aggregate({_blocks('xs')}, named_struct('at', 0, 'out', cast(array() AS array<{_PLACES}>)), {block}, acc -> flatten(acc.out))"
    return f"CASE WHEN rlike({text}, {_quoted(one)}) THEN {_let('xs', found, f'CASE WHEN size(xs) > 0 THEN {folded} ELSE {none} END')} ELSE {none} END"


def _spans(found: str, kind: str) -> str:
    return f"transform({found}, x -> named_struct('start', x.start, 'kind', {_KINDS.index(kind)}, 'end', x.end))"


def _shape(text: str, kind: str, pattern: str, group: int, least: int) -> str:
    if group:
        found = _finds(text, pattern, r"(?i)password|passwd|secret|token|api_?key")
        return _spans(f"filter({found}, x -> length(regexp_extract(x.found, {_quoted(pattern)}, {group})) >= {least})", kind)
    # without a group: asking for the least length leaves out the matches that are too short, and changes no other
    stem, chars = pattern[: pattern.index("[")], pattern[pattern.index("[") : -1]
    long = f"{stem}{chars}{{{least - len(stem)},}}"
    return _spans(_finds(text, long, long), kind)


def base_spans(text: str) -> list[Column]:
    """For each shape the array of (start, kind, end) in the column ``text``."""
    return [F.expr(_shape(text, *s)) for s in SHAPES]


def _grown(out: str, start: str, end: str) -> str:
    """``out`` with a stretch, joined to the last one if the two touch."""
    last = f"get({out}, size({out}) - 1)"
    return f"""CASE WHEN size({out}) > 0 AND {last}.end >= {start} THEN concat(slice({out}, 1, size({out}) - 1), array(named_struct('start', {last}.start, 'end', {end})))
        ELSE concat({out}, array(named_struct('start', {start}, 'end', {end}))) END"""


def _moved(state: str, code: str, by: int) -> str:
    """The sum and the counts after a character enters (1) or leaves (-1): its own count changes, and two terms."""
    terms = f"array({', '.join(f'{x!r}D' for x in _C_LOG_C)})"
    n = f"ascii(substring({state}.counts, {code}, 1)) - {ord('A')}"
    return _let("n", n, f"named_struct('s', {state}.s + get({terms}, n + {by}) - get({terms}, n), 'counts', overlay({state}.counts PLACING char(n + {by} + {ord('A')}) FROM {code} FOR 1))")


def _entropy_stretches(candidate: str, threshold: float) -> str:
    """Array of (start, end) within a candidate: merged windows with at least ``threshold`` bits a character.

    The sum S of c * log2(c) over the counts of the window gives its entropy, log2(W) - S / W.
    """
    most = WINDOW * (math.log2(WINDOW) - threshold) + 1e-9
    none = f"cast(array() AS {_STRETCHES})"
    left = f"CASE WHEN i > {WINDOW} THEN {_moved('acc', f'get(xs, i - {WINDOW + 1})', -1)} ELSE named_struct('s', acc.s, 'counts', acc.counts) END"
    seen = f"named_struct('s', t.s, 'counts', t.counts, 'out', CASE WHEN i >= {WINDOW} AND t.s <= {most!r}D THEN {_grown('acc.out', f'k * {PIECE} + i - {WINDOW}', f'k * {PIECE} + i')} ELSE acc.out END)"
    step = _let("o", left, _let("t", _moved("o", "get(xs, i - 1)", 1), seen))
    zero = f"named_struct('s', 0D, 'counts', '{'A' * (_LAST - _FIRST + 1)}', 'out', {none})"
    codes = f"transform(split(w, ''), c -> ascii(c) - {_FIRST - 1})"
    piece = _let("xs", codes, f"aggregate(sequence(1, length(w)), {zero}, (acc, i) -> {step}, acc -> acc.out)")
    whole = f"concat(p, substring(coalesce(get(ps, k + 1), ''), 1, {WINDOW - 1}))"
    pieces = f"transform(ps, (p, k) -> {_let('w', whole, f'CASE WHEN length(w) >= {WINDOW} THEN {piece} ELSE {none} END')})"
    cuts = f"regexp_extract_all({candidate}, '.{{1,{PIECE}}}', 0)"
    return f"aggregate(flatten({_let('ps', cuts, pieces)}), {none}, (out, z) -> {_grown('out', 'z.start', 'z.end')})"


def _class(text: str, kind: str, chars: str, least: int, must: str, threshold: float) -> str:
    run, allowed = f"[{chars}]{{{least},}}", "|".join(f"(?:{a})" for a in ALLOWED)
    good = f"filter({_finds(text, run, run)}, x -> rlike(x.found, {_quoted(must)}) AND NOT rlike(x.found, {_quoted(allowed)}))"
    place = f"named_struct('start', g.start + h.start, 'kind', {_KINDS.index(kind)}, 'end', g.start + h.end)"
    return f"flatten(transform({good}, g -> transform({_entropy_stretches('g.found', threshold)}, h -> {place})))"


def entropy_spans(text: str) -> list[Column]:
    """For each class the array of (start, kind, end) in the column ``text``."""
    return [F.expr(_class(text, *c)) for c in CLASSES]


def _uncovered(base: str, more: str) -> str:
    """All base spans, and of the method's own those that no span of a kind listed before covers, sorted.

    One pass by start: a span is covered if one of a kind before has begun and ends no sooner, so the farthest end of
    each kind says it.
    """
    none = f"cast(array() AS {_SPANS})"
    covered = f"x.kind >= {len(SHAPES)} AND exists(slice(a.far, 1, x.kind), e -> e >= x.end)"
    far = "transform(a.far, (e, k) -> CASE WHEN k = x.kind THEN greatest(e, x.end) ELSE e END)"
    step = f"(a, x) -> named_struct('far', {far}, 'out', CASE WHEN {covered} THEN a.out ELSE concat(a.out, array(x)) END)"
    block = f"(acc, b) -> aggregate(b, named_struct('far', acc.far, 'out', {none}), {step}, d -> named_struct('far', d.far, 'out', concat(acc.out, array(d.out))))"
    zero = f"named_struct('far', array({', '.join('-1' for _ in _KINDS)}), 'out', cast(array() AS array<{_SPANS}>))"
    folded = f"aggregate({_blocks('xs')}, {zero}, {block}, acc -> flatten(acc.out))"
    return f"CASE WHEN size({more}) = 0 THEN {base} ELSE {_let('xs', f'array_sort(concat({base}, {more}))', folded)} END"


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in _KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _found(docs: DataFrame, text: Column, **kept: Column) -> DataFrame:
    """``kept`` with text, base (one array a shape), base_spans and spans; no other column of ``docs``."""
    own = docs.select(*[c.alias(name) for name, c in kept.items()], F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    shaped = own.withColumn("base", F.struct(*[c.alias(f"s{k}") for k, c in enumerate(base_spans("text"))]))
    shaped = shaped.withColumn("base_spans", F.concat(*[F.col(f"base.s{k}") for k in range(len(SHAPES))]))
    more = shaped.withColumn("more", F.concat(*entropy_spans("text")))
    return more.withColumn("spans", F.expr(_uncovered("base_spans", "more")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy) of every row."""
    found = _found(docs, F.col(f"`{text_col}`"), id=F.col(f"`{id_col}`"))
    counts = [F.size(f"base.s{k}").cast("long").alias(f"n_{s[0]}") for k, s in enumerate(SHAPES)]
    extra = (F.size("spans") - F.size("base_spans")).cast("long").alias("n_entropy")
    return found.select("id", *counts, F.sha2(_written(F.col("base_spans")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), extra)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of every text replaced by a mark; overlapping spans by one. Null texts stay null."""
    found = _found(docs, F.col(f"`{text_col}`"), row=F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    text = F.col("text")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(REDACTED)))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(F.array_sort("spans"), begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    done = found.withColumn("clean", F.when(F.size("spans") > 0, clean).otherwise(F.col(f"row.`{text_col}`").cast("string")))
    return done.select(*[F.col("clean").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
