"""Queries of maintenance, counting and rolling figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import aggregate, lookup, merge
from tessera.plans.bindings import GRAPH_SQL, edges, nodes
from tessera.storage import read

_CURRENT = "SELECT c_custkey AS path, 'h' || c_nationkey AS hash, c_custkey * 10 AS mtime FROM customer WHERE c_mktsegment <> 'BUILDING'"
_STORED = "SELECT c_custkey AS path, CASE WHEN c_custkey % 7 = 0 THEN 'old' ELSE 'h' || c_nationkey END AS hash, c_custkey * 10 AS mtime, CASE WHEN c_custkey % 5 = 0 THEN 'error' ELSE 'indexed' END AS status FROM customer WHERE c_mktsegment <> 'MACHINERY'"
_REQUESTS = "SELECT event_id, ts, event_type AS tool, value AS duration, event_type = 'error' AS error, user_id AS ip FROM events"


def _table(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    read(spark, sf_dir, table).createOrReplaceTempView(f"__{table}")
    return spark.sql(sql.replace(f"FROM {table}", f"FROM __{table}"))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.snapshot_diff(_table(spark, sf_dir, "customer", _CURRENT), _table(spark, sf_dir, "customer", _STORED))


def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_diff(spark, sf_dir).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = nodes(spark, sf_dir).select("id", "name", "repository_id", "language", "seq")
    new = own.where("seq % 2 = 0").selectExpr("id", "name || '!' AS name", "'other' AS repository_id", "'zig' AS language", "seq + 1 AS seq").unionByName(own.where("seq % 5 = 0").selectExpr("id || '+' AS id", "name", "repository_id", "language", "seq"))
    return merge.upsert(own, new, preserve=("repository_id", "language"))


def newest_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "events").selectExpr("user_id AS path", "event_id AS seq", "event_type AS change")
    return merge.newest(own, "path", "seq")


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    kept_nodes, kept_edges = merge.delete_nodes(n, e, n.where("repository_id = 'repo1'"))
    return aggregate.table_counts({"nodes": kept_nodes, "edges": kept_edges})


def valid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    return merge.valid_edges(e, n.where("is_exported")).select("source_id", "target_id")


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.table_counts({t: read(spark, sf_dir, t) for t in ("nation", "customer", "orders", "events")})


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.status_counts(_table(spark, sf_dir, "customer", _STORED))


def list_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    repositories = read(spark, sf_dir, "region").selectExpr("'repo' || r_regionkey AS id", "'/src/' || lower(r_name) AS path", "r_name AS name", "CAST('2024-01-01' AS TIMESTAMP) + make_interval(0, 0, 0, r_regionkey) AS created_at")
    found = lookup.list_repositories(repositories, nodes(spark, sf_dir), ["/src/a", "/src/europe"])
    return found.select("id", "path", "node_count", "status", F.coalesce(F.size("languages"), F.lit(0)).alias("n_languages")).replace(-1, 0, ["n_languages"])


def summed_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    repositories = read(spark, sf_dir, "region").selectExpr("'repo' || r_regionkey AS id")
    return aggregate.summed_languages(lookup.with_languages(repositories, nodes(spark, sf_dir)))


def rolling_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate.rolling(_table(spark, sf_dir, "events", _REQUESTS), ["tool"], 3600)
    return out.select("event_id", "n", F.round("avg_duration", 6).alias("avg_duration"), F.round("error_rate", 6).alias("error_rate"))


def over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.over_limit(_table(spark, sf_dir, "events", _REQUESTS), "ip", 86_400, 4)


def debounced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "events").selectExpr("user_id AS path", "ts", "event_id AS seq", "CASE WHEN event_type = 'error' THEN 'unlink' ELSE 'change' END AS change")
    return aggregate.debounced(own, F.expr("INTERVAL 2 HOURS"))


def limited_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.limited(read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", 12 * 3600, 2)


def queue_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as texts to embed: those of even turns failed, of every fourth conversation too often."""
    tasks = read(spark, sf_dir, "conversations").selectExpr("CASE turn % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'done' END AS status", "conv_id % 4 AS tries", "text AS content")
    return aggregate.waiting_tokens(tasks)


def all_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = nodes(spark, sf_dir).selectExpr("file_path AS path", "repository_id", "CASE WHEN repository_id = 'repo1' THEN 'pending' ELSE 'indexed' END AS status").distinct()
    repositories = read(spark, sf_dir, "region").selectExpr("'repo' || r_regionkey AS id", "r_regionkey % 2 = 0 AS is_watched")
    return aggregate.stats(nodes(spark, sf_dir), edges(spark, sf_dir), files, repositories)


def payload_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "documents").selectExpr("lang AS scenario", "text AS payload", "doc_id % 2 = 0 AS new", "source")
    return aggregate.payload_deltas(own.where("new"), own.where("NOT new"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w"))
    return own.agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event")).select("user_id", F.col("w.start").alias("session_start"), "n", "last_event")


def payload_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.payload_sizes(read(spark, sf_dir, "conversations"), "text")


def new_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "orders").selectExpr("o_orderpriority AS scenario", "'c' || o_custkey AS name", "o_orderstatus")
    return aggregate.new_names(own.where("o_orderstatus = 'F'").drop("o_orderstatus"), own.where("o_orderstatus <> 'F'").drop("o_orderstatus"))


def top_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("scenario"), F.expr("o_orderstatus = 'F'").alias("new"), F.expr("'n' || (o_custkey % 40)").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    ranked = own.withColumn("place", F.row_number().over(Window.partitionBy("scenario", "new").orderBy(F.desc("n"), "name")))
    return aggregate.top_overlap(ranked.where("new"), ranked.where("not new"), 10)


def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = read(spark, sf_dir, "orders").selectExpr("CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'done' ELSE 'failed' END END AS status", "CAST(o_orderkey % 5 AS INT) AS tries")
    return aggregate.queue_stats(tasks)


def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes(spark, sf_dir).selectExpr("file_path AS path", "repository_id", "CASE WHEN kind = 'function' THEN 'indexed' ELSE 'pending' END AS status").distinct()
    return lookup.list_files(found, "repo1", "indexed")


def repository_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    repositories = read(spark, sf_dir, "region").selectExpr("'repo' || r_regionkey AS id", "'/src/' || lower(r_name) AS path")
    return lookup.repository_at(repositories, "asia")


def upsert_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding")
    changes = own.selectExpr("CASE WHEN id % 2 = 0 THEN id ELSE -1 - id END AS id", "transform(embedding, x -> CAST(2 * x AS FLOAT)) AS embedding")
    done = merge.upsert_vectors(own, changes)
    return done.select("id", F.size("embedding").alias("dim"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


def delete_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    repositories = read(spark, sf_dir, "region").selectExpr("'repo' || r_regionkey AS id")
    left = merge.delete_repository({"nodes": nodes(spark, sf_dir), "edges": edges(spark, sf_dir), "repositories": repositories}, "repo1")
    return aggregate.table_counts(left)


def delete_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = merge.delete_file(nodes(spark, sf_dir), edges(spark, sf_dir), "world/n3/suppliers.go")
    return aggregate.table_counts({"nodes": left[0], "edges": left[1]})


_DIFF_SQL = f"""SELECT coalesce(c.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed'
  WHEN s.status = 'indexed' AND c.hash = s.hash AND c.mtime = s.mtime THEN 'unchanged' ELSE 'changed' END AS change
FROM ({_CURRENT}) c FULL OUTER JOIN ({_STORED}) s ON c.path = s.path"""

QUERIES = {
    "snapshot_diff": (snapshot_diff, _DIFF_SQL),
    "snapshot_changes": (snapshot_changes, f"SELECT change, count(*) AS n FROM ({_DIFF_SQL}) GROUP BY change"),
    "upsert_nodes": (upsert_nodes, f"WITH {GRAPH_SQL}, own AS (SELECT id, name, repository_id, language, seq FROM nodes) SELECT id, CASE WHEN seq % 2 = 0 THEN name || '!' ELSE name END AS name, repository_id, language, CASE WHEN seq % 2 = 0 THEN seq + 1 ELSE seq END AS seq FROM own UNION ALL SELECT id || '+', name, repository_id, language, seq FROM own WHERE seq % 5 = 0"),
    "newest_change": (newest_change, "SELECT user_id AS path, max(event_id) AS seq, arg_max(event_type, event_id) AS change FROM events GROUP BY user_id"),
    "delete_cascade": (delete_cascade, f"WITH {GRAPH_SQL}, kept AS (SELECT id FROM nodes WHERE repository_id <> 'repo1') SELECT 'nodes' AS \"table\", count(*) AS n FROM kept UNION ALL SELECT 'edges', count(*) FROM edges WHERE source_id IN (SELECT id FROM kept) AND target_id IN (SELECT id FROM kept)"),
    "valid_edges": (valid_edges, f"WITH {GRAPH_SQL}, kept AS (SELECT id FROM nodes WHERE is_exported) SELECT source_id, target_id FROM edges WHERE source_id IN (SELECT id FROM kept) AND target_id IN (SELECT id FROM kept)"),
    "table_counts": (table_counts, " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in ("nation", "customer", "orders", "events"))),
    "status_counts": (status_counts, f"SELECT count(*) FILTER (WHERE status = 'pending') AS files_pending, count(*) FILTER (WHERE status = 'indexing') AS files_indexing, count(*) FILTER (WHERE status = 'indexed') AS files_indexed, count(*) FILTER (WHERE status = 'error') AS files_error FROM ({_STORED})"),
    "list_repositories": (list_repositories, f"WITH {GRAPH_SQL} SELECT 'repo' || r_regionkey AS id, '/src/' || lower(r_name) AS path, coalesce(n, 0) AS node_count, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN starts_with(lower(r_name), 'a') OR r_name = 'EUROPE' THEN 'indexed, watching' ELSE 'indexed' END AS status, CAST(coalesce(l, 0) AS INT) AS n_languages FROM region LEFT JOIN (SELECT repository_id, count(*) AS n, count(DISTINCT language) AS l FROM nodes GROUP BY 1) ON repository_id = 'repo' || r_regionkey"),
    "summed_languages": (summed_languages, f"WITH {GRAPH_SQL} SELECT language, count(*) AS n FROM nodes WHERE repository_id IN (SELECT 'repo' || r_regionkey FROM region) GROUP BY language"),
    "rolling_requests": (rolling_requests, f"SELECT event_id, count(*) OVER w AS n, round(avg(duration) OVER w, 6) AS avg_duration, round(avg(CAST(error AS DOUBLE)) OVER w, 6) AS error_rate FROM ({_REQUESTS}) WINDOW w AS (PARTITION BY tool ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)"),
    "over_limit": (over_limit, f"SELECT ip, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n FROM ({_REQUESTS}) GROUP BY 1, 2 HAVING count(*) > 4"),
    "debounced_changes": (debounced_changes, "SELECT path, ts, change FROM (SELECT *, lead(ts) OVER (PARTITION BY path ORDER BY ts, seq) AS next_ts FROM (SELECT user_id AS path, ts, event_id AS seq, CASE WHEN event_type = 'error' THEN 'unlink' ELSE 'change' END AS change FROM events)) WHERE change = 'unlink' OR next_ts IS NULL OR next_ts - ts >= INTERVAL 2 HOURS"),
    "limited_requests": (limited_requests, "WITH RECURSIVE starts(user_id, began) AS (SELECT user_id, min(ts) FROM events GROUP BY user_id UNION ALL SELECT s.user_id, min(e.ts) FROM starts s JOIN events e ON e.user_id = s.user_id AND e.ts >= s.began + INTERVAL 12 HOURS GROUP BY s.user_id), placed AS (SELECT e.user_id, e.ts, max(s.began) AS began FROM events e JOIN starts s ON s.user_id = e.user_id AND s.began <= e.ts GROUP BY e.user_id, e.ts, e.event_id) SELECT user_id, ts, row_number() OVER (PARTITION BY user_id, began ORDER BY ts) <= 2 AS allowed FROM placed"),
    "queue_tokens": (queue_tokens, "SELECT count(*) AS waiting, CAST(coalesce(sum(ceil(length(text) / 4)), 0) AS BIGINT) AS tokens FROM conversations WHERE turn % 3 = 0 OR (turn % 3 = 1 AND conv_id % 4 < 3)"),
    "all_stats": (all_stats, f"WITH {GRAPH_SQL}, files AS (SELECT DISTINCT file_path, repository_id FROM nodes) SELECT 'nodes' AS figure, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'files', count(*) FROM files UNION ALL SELECT 'repositories', count(*) FROM region UNION ALL SELECT 'files:' || CASE WHEN repository_id = 'repo1' THEN 'pending' ELSE 'indexed' END, count(*) FROM files GROUP BY 1 UNION ALL SELECT 'language:' || language, count(*) FROM nodes GROUP BY 1 UNION ALL SELECT 'watched', count(*) FROM region WHERE r_regionkey % 2 = 0"),
    "payload_deltas": (payload_deltas, "WITH s AS (SELECT lang AS scenario, doc_id % 2 = 0 AS new, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(ceil(strlen(text) / 4)) AS BIGINT) AS tokens FROM documents GROUP BY 1, 2) SELECT c.scenario, c.bytes, c.tokens, c.bytes - b.bytes AS bytes_delta, c.tokens - b.tokens AS tokens_delta, round(100.0 * (c.bytes - b.bytes) / b.bytes, 3) AS bytes_percent FROM (SELECT * FROM s WHERE new) c JOIN (SELECT * FROM s WHERE NOT new) b ON b.scenario = c.scenario"),
    "sessions": (sessions, "SELECT user_id, min(ts) AS session_start, count(*) AS n, max(event_id) AS last_event FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"),
    "payload_sizes": (payload_sizes, "SELECT CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(ceil(strlen(text) / 4)) AS BIGINT) AS tokens FROM conversations"),
    "new_names": (new_names, "WITH own AS (SELECT o_orderpriority AS scenario, 'c' || o_custkey AS name, o_orderstatus FROM orders) SELECT DISTINCT scenario, name FROM own WHERE o_orderstatus = 'F' AND (scenario, name) NOT IN (SELECT (scenario, name) FROM own WHERE o_orderstatus <> 'F')"),
    "top_overlap": (top_overlap, "WITH own AS (SELECT o_orderpriority AS scenario, o_orderstatus = 'F' AS new, 'n' || (o_custkey % 40) AS name, count(*) AS n FROM orders GROUP BY 1, 2, 3), first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario, new ORDER BY n DESC, name) AS place FROM own) WHERE place <= 10) SELECT b.scenario, count(c.name) / count(*) AS overlap FROM (SELECT * FROM first WHERE NOT new) b LEFT JOIN (SELECT * FROM first WHERE new) c ON c.scenario = b.scenario AND c.name = b.name GROUP BY b.scenario"),
    "queue_stats": (queue_stats, "SELECT count(*) FILTER (WHERE s = 'pending' OR (s = 'failed' AND t < 3)) AS pending, count(*) FILTER (WHERE s = 'running') AS running, count(*) FILTER (WHERE s = 'done') AS done, count(*) FILTER (WHERE s = 'failed' AND t >= 3) AS failed, count(*) AS total FROM (SELECT CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'done' ELSE 'failed' END END AS s, o_orderkey % 5 AS t FROM orders)"),
    "list_files": (list_files, f"WITH {GRAPH_SQL} SELECT DISTINCT file_path AS path, repository_id, 'indexed' AS status FROM nodes WHERE repository_id = 'repo1' AND kind = 'function'"),
    "repository_at": (repository_at, "SELECT 'repo' || r_regionkey AS id, '/src/' || lower(r_name) AS path FROM region WHERE ends_with(lower(r_name), 'asia')"),
    "upsert_vectors": (upsert_vectors, "SELECT vec_id AS id, CAST(len(embedding) AS INT) AS dim, round(CAST(CASE WHEN vec_id % 2 = 0 THEN 2 * embedding[1] ELSE embedding[1] END AS DOUBLE), 5) AS first FROM embeddings UNION ALL SELECT -1 - vec_id, CAST(len(embedding) AS INT), round(CAST(2 * embedding[1] AS DOUBLE), 5) FROM embeddings WHERE vec_id % 2 <> 0"),
    "delete_repository": (delete_repository, f"WITH {GRAPH_SQL}, kept AS (SELECT id FROM nodes WHERE repository_id <> 'repo1') SELECT 'nodes' AS \"table\", count(*) AS n FROM kept UNION ALL SELECT 'edges', count(*) FROM edges WHERE source_id IN (SELECT id FROM kept) AND target_id IN (SELECT id FROM kept) UNION ALL SELECT 'repositories', count(*) FROM region WHERE r_regionkey <> 1"),
    "delete_file": (delete_file, f"WITH {GRAPH_SQL}, kept AS (SELECT id FROM nodes WHERE file_path <> 'world/n3/suppliers.go') SELECT 'nodes' AS \"table\", count(*) AS n FROM kept UNION ALL SELECT 'edges', count(*) FROM edges WHERE source_id IN (SELECT id FROM kept) AND target_id IN (SELECT id FROM kept)"),
}
