"""Imports are made distinct before the paths that they can stand for are listed."""

from __future__ import annotations

from tessera.operators import resolve


def test_imports_are_distinct_before_their_paths_are_listed(spark):
    nodes = spark.createDataFrame([("f", "f", "function", "a/x.ts", "r", 1), ("g", "g", "function", "a/y.ts", "r", 2), ("h", "g", "function", "a/y/index.js", "r", 3)], "id string, name string, kind string, file_path string, repository_id string, seq long")
    given = [("a/x.ts", "./y", "g", "r"), ("a/x.ts", "./y", "g", "r"), ("a/x.ts", "././y", "g", "r"), ("a/x.ts", "y", "g", "r"), ("a/y.ts", "./y", "g", "r"), ("a/x.ts", None, "g", "r")]
    imports = spark.createDataFrame(given, "file_path string, source string, imported string, repository_id string")
    found = resolve.import_edges(imports, nodes)
    assert sorted((r["source_id"], r["target_id"]) for r in found.collect()) == [("f", "g"), ("f", "h"), ("g", "h")]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    listed = next(k for k, line in enumerate(plan) if "Generate explode" in line and "base" in "".join(plan[k : k + 3]))
    assert "Aggregate" in plan[listed + 1] + plan[listed + 2]
