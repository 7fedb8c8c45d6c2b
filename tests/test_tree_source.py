"""Changes of a folder as a stream, with restarts."""

from __future__ import annotations

import os

import pytest

from tessera.streaming import tree_source


def _write(folder, **files):
    for name, text in files.items():
        target = folder / name.replace("__", "/")
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)


def test_files_that_come_change_and_go(spark, tmp_path):
    tree, out = tmp_path / "tree", str(tmp_path / "out")

    def run():
        stream = tree_source.tree_changes(spark, str(tree), str(tmp_path / "snapshots"), 3)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["seq"], r["path"], r["change"], r["size"]) for r in spark.read.parquet(out).collect())

    _write(tree, a="1", b="22", sub__c="333")
    first = [(1, "a", "add", 1), (1, "b", "add", 2), (1, "sub/c", "add", 3)]
    assert run() == first
    assert run() == first  # nothing new
    os.remove(tree / "a")
    _write(tree, b="changed", d="")
    assert run() == [*first, (2, "a", "unlink", None), (2, "b", "change", 7), (2, "d", "add", 0)]
    _write(tree, a="again")
    assert run()[-1] == (3, "a", "add", 5)


def test_the_same_offsets_give_the_same_rows(tmp_path):
    def reader():
        return tree_source.source()({"path": str(tmp_path / "tree"), "snapshots": str(tmp_path / "snapshots")}).streamReader(None)

    rows = lambda r, a, b: sorted((row[:3] for p in r.partitions(a, b) for row in r.read(p)), key=str)
    one = reader()
    start = one.initialOffset()
    assert one.latestOffset() == start  # a folder that is not there yet has no files
    _write(tmp_path / "tree", a="1", b="2")
    first = one.latestOffset()
    seen = rows(one, start, first)
    _write(tmp_path / "tree", a="other")
    os.remove(tmp_path / "tree" / "b")
    second = one.latestOffset()
    changes = rows(one, first, second)
    assert [r[1] for r in seen] == ["add", "add"] and {(r[0], r[1]) for r in changes} == {("a", "change"), ("b", "unlink")}
    os.remove(tmp_path / "tree" / "a")
    again = reader()  # as after a restart
    (tmp_path / "snapshots" / "3").mkdir()  # a snapshot that was not finished
    assert rows(again, start, first) == seen and rows(again, first, second) == changes and rows(again, first, first) == []
    assert {(r[0], r[1]) for r in rows(again, start, again.latestOffset())} == set()
    again.commit({"snapshot": 3})
    with pytest.raises(FileNotFoundError):
        rows(again, start, first)
    assert rows(again, second, {"snapshot": 3}) == [("a", "unlink", None)]
