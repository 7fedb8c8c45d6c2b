"""Text operators over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import compact, ignore, text
from tessera.functions.patterns import ALWAYS_FROM, COUNTS_FROM, HARMLESS_MARKS, HARMLESS_WORDS, PATTERNS
from tessera.operators import lookup
from tessera.plans.bindings import GRAPH_SQL, nodes
from tessera.sources import files
from tessera.storage import read


def secret_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "documents").select("doc_id", F.explode(text.secret_matches(F.col("text"))).alias("x"))
    return found.groupBy(F.col("x.category").alias("category")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("x.n").cast("long")).alias("n"))


_HELD = "CASE WHEN doc_id % 4 = 0 THEN ' AKIA' || lpad(CAST(doc_id AS STRING), 16, 'Q') WHEN doc_id % 4 = 1 THEN ' npm_' || lpad(CAST(doc_id AS STRING), 36, 'b') WHEN doc_id % 4 = 2 THEN ' AKIA' || lpad(CAST(doc_id AS STRING), 15, 'Q') ELSE '' END"


def has_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.concat(F.col("text"), F.expr(_HELD))  # texts of the table hold no secret that no context suppresses
    return read(spark, sf_dir, "documents").where(text.has_secrets(held)).select("doc_id")


# lines that hold secrets, overlapping ones, harmless ones, and one literal twice
_ID = "lpad(CAST(doc_id AS STRING), 24, 'Zb7')"
_PLANTED = f"""CASE doc_id % 5 WHEN 0 THEN 'password = "' || {_ID} || '"' || chr(10) || '# token: ' || {_ID}
  WHEN 1 THEN 'api_key = AKIA' || upper(lpad(CAST(doc_id AS STRING), 16, 'Q')) || chr(10) || 'secret: ' || {_ID}
  WHEN 2 THEN 'password = "test' || {_ID} || '"' || chr(10) || 'Bearer ' || {_ID} || ' for example'
  WHEN 3 THEN 'token = ' || {_ID} || ' ' || 'token = ' || {_ID} || chr(10) || 'mongodb://a:' || {_ID} || '@host/x' ELSE 'no more' END"""


def scrubbed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.concat(F.col("text"), F.lit("\n"), F.expr(_PLANTED))  # texts of the table hold hardly any that no line suppresses
    done = read(spark, sf_dir, "documents").select("doc_id", text.scrub(held).alias("s"))
    return done.where(F.size("s.detected") > 0).select("doc_id", F.sha2("s.scrubbed", 256).alias("scrubbed_sha256"), F.array_join(F.transform("s.detected", lambda d: F.concat_ws(":", d["category"], d["line"].cast("string"))), ",").alias("detected"))


def chunked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.pack_lines(F.col("text"))).alias("part", "content"))
    return parts.select("doc_id", "part", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("content_sha256"))


def whole_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.pack_lines(F.col("text"), keep_tail=True)).alias("part", "content"))
    return parts.select("doc_id", "part", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("content_sha256"))


def called_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "pages").select("page_id", F.explode(files.called_names(F.col("html"))).alias("callee"))
    return own.groupBy("callee").agg(F.count(F.lit(1)).alias("n"))


def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(files.line_range(F.col("text"), F.lit(2), F.lit(4)), 256).alias("lines_sha256"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.snippet(F.col("text"), F.lit(3), F.lit(12)), 256).alias("snippet_sha256"))


def lint_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "pages").select("page_id", F.explode_outer(text.lint(F.col("html"), F.when(F.col("page_id") % 2 == 0, "typescript").otherwise("go"))).alias("c"))
    return own.groupBy(F.coalesce("c.rule", F.lit("passed")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def node_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", files.node_kind(F.concat("p_type", F.lit(" "), F.when(F.col("p_size") % 3 == 0, "Method").when(F.col("p_size") % 3 == 1, "constructor").otherwise("struct"))).alias("kind"))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("file_path", "regions", "regions.test")
    return nodes(spark, sf_dir).select(files.language(path).alias("detected"), text.parent_symbol(F.col("qualified_name")).alias("parent")).groupBy("detected", "parent").agg(F.count(F.lit(1)).alias("n"))


def not_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = ("orders/", "*.go", "!world/n3/*.go", "world/n1?/")
    own = nodes(spark, sf_dir).where(~ignore.ignored(F.col("file_path"), patterns))
    return own.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


def compact_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = nodes(spark, sf_dir).where("kind = 'class'").select(*[c for c in lookup.SYMBOL_COLUMNS if c not in ("line_end", "qualified_name")], "complexity")
    return own.select("name", compact.compact_rows(own).alias("payload"))


def hoisted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact.hoisted(nodes(spark, sf_dir).where("kind = 'class'"))


def _flag(ignore_case: bool) -> str:
    return "(?i)" if ignore_case else ""


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


_SECRETS = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, len(regexp_extract_all(text, '{_flag(i)}{_quoted(p)}')) AS n FROM documents" for c, conf, i, p in PATTERNS if conf >= COUNTS_FROM)
# every match that its line does not suppress, in the order in which matches are tried; what lies between the matches
# of a pattern says where they stand
_TRIED = sorted(((conf, c, f"{_flag(i)}{_quoted(p)}") for c, conf, i, p in PATTERNS if conf >= COUNTS_FROM), key=lambda r: -r[0])
_RULES = " UNION ALL ".join(f"SELECT doc_id, text, {k} AS rule, '{c}' AS category, {conf} AS confidence, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM held WHERE regexp_matches(text, '{p}')" for k, (conf, c, p) in enumerate(_TRIED))
_LINE_OK = " AND ".join([f"NOT contains(lower(line), '{w}')" for w in HARMLESS_WORDS] + [f"NOT contains(line, '{w}')" for w in HARMLESS_MARKS])
_SCRUBBED = f"""WITH RECURSIVE held AS (SELECT doc_id, text || chr(10) || {_PLANTED} AS text FROM documents),
rules AS ({_RULES}),
each AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM rules),
placed AS (SELECT doc_id, text, rule, category, confidence, hits[k] AS literal, length(array_to_string(gaps[1:k], '')) + length(array_to_string(hits[1:k - 1], '')) AS first FROM each),
lined AS (SELECT *, first + length(literal) AS past, len(string_split(substr(text, 1, first), chr(10))) AS n_line FROM placed),
shown AS (SELECT *, string_split(text, chr(10))[n_line] AS line FROM lined),
cand AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rule, first) AS n FROM shown WHERE confidence >= {ALWAYS_FROM} OR ({_LINE_OK})),
step(doc_id, n, taken, clean, detected) AS (
  SELECT doc_id, 0::BIGINT, []::STRUCT(a BIGINT, b BIGINT)[], text, []::VARCHAR[] FROM held WHERE doc_id IN (SELECT doc_id FROM cand)
  UNION ALL
  SELECT doc_id, n, CASE WHEN free THEN list_append(taken, {{'a': first, 'b': past}}) ELSE taken END, CASE WHEN free THEN replace(clean, literal, '[REDACTED:' || category || ']') ELSE clean END, CASE WHEN free THEN list_append(detected, category || ':' || n_line) ELSE detected END
  FROM (SELECT s.doc_id, c.n, taken, clean, detected, first, past, literal, category, n_line, len(list_filter(taken, lambda t: t.a < past AND first < t.b)) = 0 AS free FROM step s JOIN cand c ON c.doc_id = s.doc_id AND c.n = s.n + 1))
SELECT doc_id, sha256(arg_max(clean, n)) AS scrubbed_sha256, array_to_string(arg_max(detected, n), ',') AS detected FROM step GROUP BY doc_id HAVING len(arg_max(detected, n)) > 0"""

# lines are joined in order while they fit; a line that is too long by itself is a cut chunk
_CHUNKED = f"""WITH RECURSIVE split AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text <> ''),
pack(doc_id, l, k, done, open) AS (
  SELECT doc_id, l, 0, []::VARCHAR[], '' FROM split WHERE length(text) > {text.MOST_CHUNK}
  UNION ALL
  SELECT doc_id, l, k + 1,
    CASE WHEN length(open) + length(l[k + 1]) + 1 <= {text.MOST_CHUNK} THEN done WHEN length(l[k + 1]) > {text.MOST_CHUNK} THEN list_concat(done, list_filter([open], lambda x: x <> ''), [l[k + 1][1:{text.MOST_CHUNK}]]) ELSE list_concat(done, list_filter([open], lambda x: x <> '')) END,
    CASE WHEN length(open) + length(l[k + 1]) + 1 <= {text.MOST_CHUNK} THEN CASE WHEN open = '' THEN l[k + 1] ELSE open || chr(10) || l[k + 1] END WHEN length(l[k + 1]) > {text.MOST_CHUNK} THEN '' ELSE l[k + 1] END
  FROM pack WHERE k < len(l)),
parts AS (SELECT doc_id, [text] AS p FROM split WHERE length(text) <= {text.MOST_CHUNK} UNION ALL SELECT doc_id, list_concat(done, list_filter([open], lambda x: x <> '')) FROM pack WHERE k = len(l))
SELECT doc_id, CAST(part - 1 AS INT) AS part, CAST(length(p[part]) AS INT) AS n_chars, sha256(p[part]) AS content_sha256 FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS part FROM parts)"""
_ALWAYS = " OR ".join(f"regexp_matches(text, '{_flag(i)}{_quoted(p)}')" for _, conf, i, p in PATTERNS if conf >= ALWAYS_FROM)

QUERIES = {
    "secret_matches": (secret_matches, f"SELECT category, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n FROM (SELECT doc_id, category, sum(n) AS n FROM ({_SECRETS}) GROUP BY doc_id, category) WHERE n > 0 GROUP BY category"),
    "has_secrets": (has_secrets, f"SELECT doc_id FROM (SELECT doc_id, text || {_HELD.replace('STRING', 'VARCHAR')} AS text FROM documents) WHERE {_ALWAYS}"),
    "scrubbed_documents": (scrubbed_documents, _SCRUBBED),
    "chunked_documents": (chunked_documents, _CHUNKED),
    "whole_chunks": (whole_chunks, _CHUNKED.replace(f"[l[k + 1][1:{text.MOST_CHUNK}]]", f"list_transform(range(0, length(l[k + 1]), {text.MOST_CHUNK}), lambda i: l[k + 1][i + 1:i + {text.MOST_CHUNK}])")),
    "called_names": (called_names, r"""WITH found AS (SELECT page_id, list_filter(regexp_extract_all(html, '\b([a-zA-Z_$][\w$]*)\s*\(', 1), lambda x: NOT list_contains([KEYWORDS], x)) AS a, regexp_extract_all(html, '\.([a-zA-Z_$][\w$]*)\s*\(', 1) AS b FROM pages) SELECT callee, count(*) AS n FROM (SELECT unnest(list_distinct(list_concat(a, b))) AS callee FROM found) GROUP BY callee""".replace("KEYWORDS", ", ".join(f"'{w}'" for w in files.CALL_KEYWORDS))),
    "line_ranges": (line_ranges, "SELECT doc_id, sha256(array_to_string(string_split(text, chr(10))[2:4], chr(10))) AS lines_sha256 FROM documents"),
    "snippets": (snippets, "WITH r AS (SELECT doc_id, string_split(text, chr(10))[1:14] AS l FROM documents), s AS (SELECT doc_id, CASE WHEN len(l) > 10 THEN array_to_string(list_concat(l[1:5], ['...'], l[len(l) - 4:len(l)]), chr(10)) ELSE array_to_string(l, chr(10)) END AS t FROM r) SELECT doc_id, sha256(CASE WHEN length(t) > 500 THEN substr(t, 1, 500) || '...' ELSE t END) AS snippet_sha256 FROM s"),
    "lint_checks": (lint_checks, "WITH c AS (SELECT page_id, contains(lower(html), 'any') AND page_id % 2 = 0 AS a, contains(lower(html), 'console.log') OR contains(lower(html), 'print(') AS b, contains(lower(html), 'todo') OR contains(lower(html), 'fixme') AS t FROM pages) SELECT * FROM (SELECT 'no_explicit_any' AS rule, count(*) FILTER (WHERE a) AS n FROM c UNION ALL SELECT 'no_debug_statements', count(*) FILTER (WHERE b) FROM c UNION ALL SELECT 'no_todos', count(*) FILTER (WHERE t) FROM c UNION ALL SELECT 'passed', count(*) FILTER (WHERE NOT a AND NOT b AND NOT t) FROM c) WHERE n > 0"),
    "node_kinds": (node_kinds, "SELECT p_partkey, CASE WHEN contains(k, 'function') THEN 'function' WHEN contains(k, 'method') THEN 'method' WHEN contains(k, 'class') THEN 'class' WHEN contains(k, 'interface') THEN 'interface' WHEN contains(k, 'type') THEN 'type' WHEN contains(k, 'var') THEN 'variable' WHEN contains(k, 'const') THEN 'constant' WHEN contains(k, 'import') THEN 'import' WHEN contains(k, 'export') THEN 'export' WHEN contains(k, 'module') THEN 'module' WHEN contains(k, 'namespace') THEN 'namespace' ELSE 'function' END AS kind FROM (SELECT p_partkey, lower(p_type || ' ' || CASE p_size % 3 WHEN 0 THEN 'Method' WHEN 1 THEN 'constructor' ELSE 'struct' END) AS k FROM part)"),
    "page_languages": (page_languages, f"WITH {GRAPH_SQL} SELECT CASE string_split(file_path, '.')[-1] WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' END AS detected, repository_id AS parent, count(*) AS n FROM nodes GROUP BY 1, 2"),
    "not_ignored": (not_ignored, f"WITH {GRAPH_SQL} SELECT file_path, count(*) AS n FROM nodes WHERE NOT starts_with(file_path, 'orders/') AND (NOT ends_with(file_path, '.go') OR starts_with(file_path, 'world/n3/')) AND NOT regexp_matches(file_path, '^world/n1[^/]/') GROUP BY file_path"),
    "compact_nodes": (compact_nodes, f"""WITH {GRAPH_SQL} SELECT name, '{{"n":"' || name || '","k":"' || kind || '","fp":"' || file_path || '","ls":' || line_start || ',"x":' || is_exported || ',"rid":"' || repository_id || '","lang":"' || language || '","cx":' || complexity || '}}' AS payload FROM nodes WHERE kind = 'class'"""),
    "hoisted_fields": (hoisted_fields, f"WITH {GRAPH_SQL} SELECT CASE WHEN min(repository_id) = max(repository_id) THEN min(repository_id) END AS rid, CASE WHEN min(language) = max(language) THEN min(language) END AS lang FROM nodes WHERE kind = 'class'"),
}
