"""Text expressions: secret scrubbing, snippets, chunks, lint checks and name parts."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.patterns import ALWAYS_FROM, COUNTS_FROM, HARMLESS_MARKS, HARMLESS_WORDS, PATTERNS
from tessera.schema import chunk_id
from tessera.sources.files import line_range

MOST_CHUNK = 2000


def _java(ignore_case: bool, pattern: str) -> str:
    return f"(?i){pattern}" if ignore_case else pattern


def last_segment(qualified_name: Column) -> Column:
    return F.substring_index(qualified_name, ".", -1)


def parent_symbol(qualified_name: Column) -> Column:
    """The qualified name without its last part; null where it has one part only."""
    parts = F.split(qualified_name, r"\.")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "."))


def has_secrets(text: Column) -> Column:
    """Whether a pattern matches whose matches are always redacted."""
    out = F.lit(False)
    for _, confidence, ignore_case, pattern in PATTERNS:
        if confidence >= ALWAYS_FROM:
            out = out | text.rlike(_java(ignore_case, pattern))
    return out


def secret_matches(text: Column) -> Column:
    """Array of (category, n): matches of each category of patterns that count, before any context is looked at."""
    counts: dict[str, Column] = {}
    for category, confidence, ignore_case, pattern in PATTERNS:
        if confidence >= COUNTS_FROM:
            n = F.regexp_count(text, F.lit(_java(ignore_case, pattern)))
            counts[category] = counts[category] + n if category in counts else n
    return F.filter(F.array(*[F.struct(F.lit(c).alias("category"), n.alias("n")) for c, n in counts.items()]), lambda x: x["n"] > 0)


# What every match of a pattern that counts has in it: a literal, a word in any case, or a shape.
_LITERALS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "k_live_", "AIza", "googleusercontent", "xox", "hooks.slack", "SK", "SG.", "eyJ", "PRIVATE KEY", "key-", "-us", "npm_", "pypi-", "dckr_pat_", "glpat-", "ATBB", "AccountKey=", "sq0", "access_token$")
_WORDS = ("aws_secret", "api_key", "api-key", "apikey", "secret", "token", "password", "postgres:", "mysql:", "mongodb:", "bearer", "basic")
_SHAPES = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-|[MN][A-Za-z0-9]{23}|[0-9]{8}:"
#: Letters that Python takes for an i or s of another case, and lower-casing does not give.
_OTHER_CASES = ("\u0131", "\u0130", "\u017f")


def may_hold_secrets(text: Column) -> Column:
    """Whether the text has what any pattern that counts needs. Every text that the helper of :func:`scrub` would
    change passes, and some others; plain searches, so it costs a fraction of the patterns."""
    low = F.lower(text)
    tests = [text.contains(x) for x in (*_LITERALS, *_OTHER_CASES)] + [low.contains(x) for x in _WORDS] + [text.rlike(_SHAPES)]
    return reduce(Column.__or__, tests)


def _harmless(line: str) -> bool:
    return any(w in line.lower() for w in HARMLESS_WORDS) or any(w in line for w in HARMLESS_MARKS)


def _needle(pattern: str) -> str:
    """The longest literal that every match of a pattern of PATTERNS has in it."""
    bare = re.sub(r"\[[^\]]*\](?:\{[^}]*\}|[+*?]+)?|\([^)]*\)[?*+]*|\\[sS][*+?]*", "\0", pattern)
    return max(bare.replace("\\", "").split("\0"), key=len)


def _rules() -> list[tuple[str, float, re.Pattern, str]]:
    """(category, confidence, pattern, needle) of those that count, the surest first; the needle of a pattern for any
    case is in lower case."""
    counted = [(c, conf, re.compile(p, re.I if i else 0), _needle(p).lower() if i else _needle(p)) for c, conf, i, p in PATTERNS if conf >= COUNTS_FROM]
    return sorted(counted, key=lambda r: -r[1])


def _found(text: str, rules: list[tuple[str, float, re.Pattern, str]]) -> list[tuple[str, float, int, str]]:
    """Accepted matches as (category, confidence, line, literal), in the order of the rules.

    ``ends`` and ``starts`` are the sorted bounds of what is accepted, which is disjoint: a match overlaps something
    unless as many accepted spans end at or before its start as start before its end.
    """
    starts, ends, out = [], [], []
    low = text.lower()
    odd = any(c in text for c in _OTHER_CASES)
    possible = [r for r in rules if r[3] in (low if r[2].flags & re.I else text) or (odd and r[2].flags & re.I)]
    breaks = [m.start() for m in re.finditer("\n", text)] if possible else []
    for category, confidence, rule, _ in possible:
        for m in rule.finditer(text):
            free = bisect.bisect_right(ends, m.start()) == bisect.bisect_left(starts, m.end())
            row = bisect.bisect_left(breaks, m.start())
            line = text[breaks[row - 1] + 1 if row else 0 : breaks[row] if row < len(breaks) else len(text)]
            if free and (confidence >= ALWAYS_FROM or not _harmless(line)):
                bisect.insort(starts, m.start())
                bisect.insort(ends, m.end())
                out.append((category, confidence, row + 1, m[0]))
    return out


def scrub(text: Column) -> Column:
    """(scrubbed, detected) of a text: secrets redacted, and what they were.

    Patterns run on the original text, the surest first; a match that overlaps an accepted one is passed over, and one
    below ALWAYS_FROM too where its line looks harmless. An accepted literal is redacted everywhere. Which match counts
    depends on the ones accepted before, so this is a Python helper over Arrow batches; only texts that a pattern may
    match are sent to it. Null stays null.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rules = _rules()
        for batch in batches:
            rows = []
            for given in batch:
                found = [] if pd.isna(given) else _found(given, rules)
                clean = None if pd.isna(given) else given
                for category, _, _, literal in found:
                    clean = clean.replace(literal, f"[REDACTED:{category}]")
                rows.append((clean, [{"category": c, "line": n, "confidence": conf} for c, conf, n, _ in found]))
            yield pd.DataFrame(rows, columns=["scrubbed", "detected"])

    kind = "scrubbed string, detected array<struct<category:string,line:int,confidence:double>>"
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    # the helper gives null for what it was not sent, so the test is made once; a filter on the result would have the
    # helper run for itself if it counted as deterministic, and each mention of it would
    done = F.pandas_udf(run, kind).asNondeterministic()(F.when(may_hold_secrets(text), text))
    whole = lambda d: F.struct(F.coalesce(d["scrubbed"], text).alias("scrubbed"), d["detected"].alias("detected"))
    return F.get(F.transform(F.array(done), whole), F.lit(0))


def pack_lines(content: Column, most: int = MOST_CHUNK, keep_tail: bool = False) -> Column:
    """Chunks of at most ``most`` characters: one if the text fits, else lines packed in order; of a line that is
    longer by itself the first ``most`` are a chunk, and with ``keep_tail`` the rest are chunks too, so that nothing
    of the text is lost but line breaks between chunks."""
    parts = lambda line: F.transform(F.sequence(F.lit(0), F.floor((F.length(line) - 1) / most).cast("int")), lambda i: F.substring(line, i * most + 1, F.lit(most)))
    cut = parts if keep_tail else lambda line: F.array(F.substring(line, 1, most))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, line: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(line) + 1 <= most
        flushed = F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        too_long = F.length(line) > most
        done = F.when(fits, acc["done"]).when(too_long, F.concat(flushed, cut(line))).otherwise(flushed)
        rest = F.when(fits, F.concat(acc["open"], F.when(acc["open"] != "", "\n").otherwise(""), line)).when(too_long, "").otherwise(line)
        return F.struct(done.alias("done"), rest.alias("open"))

    packed = F.aggregate(F.split(content, "\n"), empty, step, lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))
    return F.when(content == "", F.array().cast("array<string>")).when(F.length(content) <= most, F.array(content)).otherwise(packed)


def chunks(with_bodies: DataFrame, keep_tail: bool = False) -> DataFrame:
    """Chunks to embed: each node but imports and exports, with the lines it spans; ``keep_tail`` as in :func:`pack_lines`."""
    own = with_bodies.where(~F.col("kind").isin("import", "export"))
    parts = own.select("*", pack_lines(F.col("body"), keep_tail=keep_tail).alias("parts")).select("*", F.posexplode("parts").alias("part", "content_part"))
    part = F.when(F.size("parts") > 1, F.col("part"))
    return parts.select(chunk_id(F.col("id"), part).alias("id"), F.col("id").alias("node_id"), "file_path", "repository_id", F.col("content_part").alias("content"), F.col("line_start").alias("start_line"), F.col("line_end").alias("end_line"), "language", F.concat_ws(":", "file_path", "qualified_name").alias("symbol_context"))


def snippet(content: Column, first: Column, last: Column, around: int = 2, most_lines: int = 10, most_chars: int = 500) -> Column:
    """The lines with some around them; of more than ``most_lines`` the first and last five; cut to ``most_chars``."""
    whole = line_range(content, F.greatest(first - around, F.lit(1)), last + around)
    rows = F.split(whole, "\n")
    short = F.when(F.size(rows) > most_lines, F.concat_ws("\n", F.slice(rows, 1, 5), F.array(F.lit("...")), F.slice(rows, -5, 5))).otherwise(whole)
    return F.when(F.length(short) > most_chars, F.concat(F.substring(short, 1, most_chars), F.lit("..."))).otherwise(short)


def with_snippets(results: DataFrame, files: DataFrame) -> DataFrame:
    """Results keep their row without a snippet where the file is missing."""
    text = files.select(F.col("path").alias("s_path"), "content")
    return results.join(text, results["file_path"] == F.col("s_path"), "left").withColumn("snippet", snippet(F.col("content"), F.col("line_start"), F.col("line_end"))).drop("s_path", "content")


def lint(change: Column, language: Column) -> Column:
    """Array of (rule, message) that a proposed change breaks; it passes if there is none."""
    low = F.lower(change)
    # Rules and what they say.
    rules = (
        (low.contains("any") & (language == "typescript"), "no_explicit_any", 'TypeScript: Avoid using explicit "any" type'),
        (low.contains("console.log") | low.contains("print("), "no_debug_statements", "Remove debug statements before committing"),
        (low.contains("todo") | low.contains("fixme"), "no_todos", "Resolve TODO/FIXME comments before committing"),
    )
    return F.filter(F.array(*[F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(says).alias("message"))) for test, rule, says in rules]), lambda x: x.isNotNull())


def lint_context(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``changes`` (repository_id, file_path, change) with the broken rules; a file that is not indexed breaks one."""
    known = nodes.groupBy("repository_id", "file_path").agg(F.min_by("language", "seq").alias("file_language"))
    joined = changes.join(known, ["repository_id", "file_path"], "left")
    missing = F.array(F.struct(F.lit("file_exists").alias("rule"), F.lit("File not found in indexed repository").alias("message")))
    checks = F.when(F.col("file_language").isNull(), missing).otherwise(lint(F.col("change"), F.col("file_language")))
    return joined.withColumn("checks", checks).withColumn("passed", F.size("checks") == 0).drop("file_language")


def cyclomatic(body: Column) -> Column:
    """1 and a branch for each decision word or operator."""
    return (F.regexp_count(body, F.lit(r"\b(if|elif|for|while|case|catch|except)\b|&&|\|\||\?[^.?:]")) + 1).cast("int")
