"""The queries of this subpackage, one for each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, language, periodic, quality, scan_sql, secrets, simhash, spelling, substrings, token_counts, topk, toxicity, urls
from tessera.llm.tables import read, scratch, settle


#: The public vocabulary that token counts and encodings use unless told otherwise.
VOCABULARY = "byte_bpe_50k"
#: Places that the copies of one text are dealt over.
COPY_SALTS = 16


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


def rollup_of_curation(spark: SparkSession, sf_dir: str, tokenizers: dict[str, token_counts.Counter]) -> DataFrame:
    """Totals after three batches: all documents come; those with repeated lines are revised to each line once; exact
    copies, but that of the smallest id, are deleted. The last batch comes twice, and counts once."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    store = token_counts.Rollup(spark, scratch(spark, "token-counts"), tokenizers)
    store.apply(1, docs.withColumn("op", F.lit("insert")))
    once = token_counts.distinct_lines(F.col("text"))
    store.apply(2, docs.withColumn("op", F.lit("revise")).withColumn("new", once).where("new <> text").drop("text").withColumnRenamed("new", "text"))
    marked = docs.select("doc_id", F.sha2("text", 256).alias("mark"), F.pmod(F.xxhash64("doc_id"), F.lit(COPY_SALTS)).alias("salt"))
    copied = marked.groupBy("mark").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = copied.select("mark", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COPY_SALTS - 1).cast("long"))).alias("salt"))
    gone = marked.join(first, ["mark", "salt"]).where("doc_id <> first").select("doc_id", F.lit("delete").alias("op"), *[F.lit(None).cast("string").alias(c) for c in ("source", "lang", "text")])
    for _ in range(2):
        store.apply(3, gone)
    return store.totals()


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_of_curation(spark, sf_dir, {VOCABULARY: token_counts.count_bpe(vocabulary_path()), "words": token_counts.count_words})


def token_counts_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 with the tokenizer that SQL can express."""
    return rollup_of_curation(spark, sf_dir, {"words": token_counts.count_words})


TOKEN_COUNTS_WORDS_SQL = r"""
WITH kept AS (
  SELECT *, array_to_string(list_filter(list_transform(list_zip(string_split(text, chr(10)), range(1, 1 + len(string_split(text, chr(10))))),
      lambda z: CASE WHEN list_position(string_split(text, chr(10)), z[1]) = z[2] THEN z[1] END), lambda l: l IS NOT NULL), chr(10)) AS lines
  FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text))
SELECT source, lang, 'words' AS tokenizer, count(*) AS n_docs,
  CAST(sum(len(regexp_extract_all(lines, '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n_tokens, CAST(sum(length(lines)) AS BIGINT) AS n_chars
FROM kept GROUP BY source, lang
"""


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), with_short_lines=True)
    return found.withColumnRenamed("id", "doc_id")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())
    return done.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    judged = quality.quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text"), target)
    return judged.withColumnRenamed("id", "doc_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).withColumnRenamed("id", "doc_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first_id").alias("component_id"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, settle(urls.crawl_traps(pages), "crawl-traps")).withColumnRenamed("id", "page_id")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.profiles(docs)).withColumnRenamed("id", "doc_id")


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP11_SQL = r"""
WITH usable AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY q.row ORDER BY list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) DESC, c.vec_id) AS rank
  FROM usable q JOIN usable c ON q.row <> c.row WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def planted_repeats(doc_id: Column, text: Column) -> Column:
    """The text with its tail repeated, for the ids whose crc32 h is divisible by 10: from word a = g % n on, where
    g = h / 10, the next p words over and over, p = 1 + (n - a) / (3 + g % 8) in whole numbers. A null id has no h."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(words, a + i % p))
        return F.when(n > 0, F.concat_ws(" ", F.slice(words, F.lit(1), a), tail)).otherwise(F.lit(""))

    # bound once by the lambda, so that the words of a text are found once
    words = F.array(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    return F.when(h % 10 == 0, F.get(F.transform(words, repeated), F.lit(0))).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", planted_repeats(F.col("doc_id"), F.col("text")).alias("text"))
    return digest_of_runs(periodic.find(docs))


def digest_of_runs(found: DataFrame) -> DataFrame:
    """n_runs, the greatest run (of equal ones that of the smallest start, then period) and digests of runs and text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    greatest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    out = found.select("id", "runs", "collapsed", greatest.alias("g"), F.concat_ws("", lines).alias("said"))
    return out.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("g.start").alias("start"), (-F.col("g.less")).alias("length"), F.col("g.period").alias("period"),
        F.expr("(-1000 * g.less) div g.period").alias("exponent_milli"), F.sha2("said", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = spelling.count_words(read(spark, sf_dir, "documents").select("doc_id", "text"), slip=spelling.deleted_letter(199))
    return spelling.variants(counted)


OP9_SQL = r"""
WITH parsed AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT list_contains(['ref', 'utm_source', 'utm_medium', 'utm_campaign', 'fbclid', 'gclid'], string_split(p, '=')[1]))) AS query
  FROM pages),
named AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '')
      || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS canonical,
    CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
         WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM parsed),
traps AS (SELECT canonical FROM named WHERE canonical IS NOT NULL GROUP BY canonical HAVING min(url) <> max(url))
SELECT page_id, host, path, rule, canonical, canonical IS NOT NULL AND canonical IN (SELECT canonical FROM traps) AS listed,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN canonical IS NOT NULL AND canonical IN (SELECT canonical FROM traps) THEN 'block' ELSE 'allow' END AS verdict
FROM named
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "token_counts_words": token_counts_words,
        "op2_decontaminate": op2_decontaminate,
        "op3_secrets": op3_secrets,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_quality_rules": op5_quality_rules,
        "op6_toxicity": op6_toxicity,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_simhash": op8_simhash,
        "op9_url_filter": op9_url_filter,
        "op10_language": op10_language,
        "op11_exact_topk": op11_exact_topk,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "token_counts_words": TOKEN_COUNTS_WORDS_SQL.replace("\\\\", "\\"),
        "op9_url_filter": OP9_SQL.replace("\\\\", "\\"),
        "op11_exact_topk": OP11_SQL,
        "op12_periodic_runs": scan_sql.OP12_SQL,
        "op13_spelling_variants": scan_sql.OP13_SQL,
    }
