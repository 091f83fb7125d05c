"""The tree source: what it opens, what it gives, and what a stream of it gives after a restart."""

import hashlib
import os
import time

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files, tree

TEXTS = {"a.php": "<?php é", "src/b.module": "", "src/deep/x/y/z/u/v/w/c.yml": "k: v", "src/vendor/no.php": "x", "vendor/no.php": "x", "node_modules/p/q.js": "x", "core/lib/big.php": "x", "d.md": "text"}


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "tree"
    for path, text in TEXTS.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text(text)
    return base


def test_pruned_folders_are_never_opened(spark, root):
    for name in ("vendor", "src/vendor", "node_modules"):
        os.chmod(root / name, 0)  # who lists or opens it fails, unless it is root's
    listed = []
    reader = tree.Tree({"path": str(root), "dropped": "core/"})
    entries = reader.entries
    reader.entries = lambda fs, base, folder: (listed.append(folder), entries(fs, base, folder))[1]
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert not any("vendor" in f or "node_modules" in f or f.startswith("core/lib") for f in listed)
    assert sorted(r[0] for r in rows) == ["a.php", "d.md", "src/b.module", "src/deep/x/y/z/u/v/w/c.yml"]
    found = {r.file_path: r for r in tree.source_tree(spark, str(root), dropped="core/").collect()}
    for name in ("vendor", "src/vendor", "node_modules"):
        os.chmod(root / name, 0o755)
    assert set(found) == {r[0] for r in rows}
    assert all((r.text, r.byte_size, r.file_hash) == (TEXTS[p], len(TEXTS[p].encode()), hashlib.sha256(TEXTS[p].encode()).hexdigest()) for p, r in found.items())


def test_options_and_odd_trees(spark, root, tmp_path):
    assert {r.file_path for r in tree.source_tree(spark, str(root), endings=".php,.yml", pruned="src").collect()} == {"a.php", "vendor/no.php", "core/lib/big.php"}
    (tmp_path / "empty").mkdir()
    assert tree.source_tree(spark, str(tmp_path / "empty")).count() == 0
    (root / "raw.bin").write_bytes(b"\xff\xfe\x00")
    row = tree.source_tree(spark, f"file://{root}", endings=".bin").first()
    assert (row.file_path, row.byte_size, row.file_hash) == ("raw.bin", 3, hashlib.sha256(b"\xff\xfe\x00").hexdigest())


def test_partitions_follow_folders(root, monkeypatch):
    monkeypatch.setattr(tree, "FOLDERS", 2)
    reader = tree.Tree({"path": str(root)})
    parts = reader.partitions()
    assert {p.path for p in parts if p.deep} == {"core", "src"} and sorted(r[0] for p in parts for r in reader.read(p)) == ["a.php", "core/lib/big.php", "d.md", "src/b.module", "src/deep/x/y/z/u/v/w/c.yml"]


def test_a_stream_gives_changes_alone(spark, root, tmp_path):
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")

    def run():
        stream = tree.changed_files(spark, str(root), dropped="core/", settled="0").writeStream.format("parquet").option("checkpointLocation", offsets).trigger(once=True).start(out)
        stream.awaitTermination()
        return sorted((r.file_path, r.text) for r in spark.read.parquet(out).collect())

    first = run()
    assert [p for p, _ in first] == ["a.php", "d.md", "src/b.module", "src/deep/x/y/z/u/v/w/c.yml"]
    time.sleep(0.05)
    (root / "src/new.php").write_text("new")
    (root / "a.php").write_text("changed")
    os.utime(root / "d.md")  # touched alone
    second = run()
    assert sorted(set(second) - set(first)) == [("a.php", "changed"), ("src/new.php", "new")] and len(second) == 7
    assert run() == second
    # What was only touched is left out by its hash.
    last = spark.read.parquet(out).groupBy("file_path", "file_hash").agg(F.count("*").alias("n"))
    assert files.unseen(tree.source_tree(spark, str(root), dropped="core/"), last).count() == 0
