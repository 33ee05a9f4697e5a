"""Folder trees as rows."""

import hashlib

from scriptorium.sources import files


def test_ordinary_folder(spark, tmp_path):
    (tmp_path / "sub" / "deep er").mkdir(parents=True)
    (tmp_path / "a.md").write_text("  # A +1\n\n")
    (tmp_path / "sub" / "b.HTML").write_text("<html><body><p>hello</p></body></html>")
    (tmp_path / "sub" / "deep er" / "c.bin").write_bytes(b"\xff\x00\x01")
    (tmp_path / "sub" / "d.txt").write_text(" \n\t")
    got = {r.path: r for r in files.load_files(files.read_tree(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.md", "sub/b.HTML", "sub/deep er/c.bin", "sub/d.txt"}
    assert got["a.md"].body == "# A +1" and got["sub/b.HTML"].body == "hello" and got["a.md"].length == 10
    assert {p: r.skipped for p, r in got.items() if r.skipped} == {"sub/deep er/c.bin": "unsupported: bin", "sub/d.txt": "empty"}
    scan = {r.path: r for r in files.scanned_files(files.read_tree(spark, str(tmp_path)), {"plus": "\\+[0-9]"}, ["bin"]).collect()}
    assert scan["sub/deep er/c.bin"].sha256 == hashlib.sha256(b"\xff\x00\x01").hexdigest()
    assert {p: r.found for p, r in scan.items() if r.found} == {"a.md": "plus", "sub/deep er/c.bin": "media"}


def test_saved_rows_come_back(spark, tmp_path):
    rows = [("x/y z.md", "one\ntwo"), ("100%+a.txt", "ü"), ("n.txt", None)]
    files.save_tree(spark.createDataFrame(rows, "path string, content string"), "path", "content", str(tmp_path / "tree"))
    got = {r.path: bytes(r.content).decode() for r in files.read_tree(spark, str(tmp_path / "tree")).collect()}
    assert got == {"x/y z.md": "one\ntwo\n", "100%+a.txt": "ü\n", "n.txt": "\n"}


def test_saved_files_lie_in_a_fixed_number_of_folders(spark, tmp_path):
    rows = spark.range(600).selectExpr("concat(id, '.txt') AS path", "'x' AS content")
    files.save_tree(rows, "path", "content", str(tmp_path / "tree"))
    assert len([p for p in (tmp_path / "tree").iterdir() if p.is_dir()]) <= files.PARTS
    assert files.read_tree(spark, str(tmp_path / "tree")).select("path").distinct().count() == 600


def test_files_are_written_by_their_task_and_whole_parts_come_once(spark, tmp_path):
    import pyarrow as pa

    rows = [(f"{i}.txt", f"x{i}") for i in range(50)] + [("0.txt", "again"), ("a{b}=[c]^.md", "odd"), (None, "none")]
    files.save_tree(spark.createDataFrame(rows, "path string, content string"), "path", "content", str(tmp_path / "tree"))
    names = [p.name for p in (tmp_path / "tree").rglob("*") if p.is_file()]
    assert len(names) == 53 and not [n for n in names if n.endswith(".crc")] and not list((tmp_path / "tree").glob("_*"))
    got = sorted((r.path, bytes(r.content).decode()) for r in files.read_tree(spark, str(tmp_path / "tree")).collect())
    assert got == sorted((p or "__HIVE_DEFAULT_PARTITION__", f"{c}\n") for p, c in rows)
    (tmp_path / "twice").mkdir()
    batch = pa.RecordBatch.from_pylist([{"part": 1, "file": "a.md", "value": b"a"}, {"part": 2, "file": "b.md", "value": b"b"}])
    for _ in range(2):  # a task that is tried again
        assert next(files._saved(iter([batch]), str(tmp_path / "twice")))["files"].to_pylist() == [2]
    assert sorted(str(p.relative_to(tmp_path / "twice")) for p in (tmp_path / "twice").rglob("*") if p.is_file()) == ["part=1/file=a.md/0.txt", "part=2/file=b.md/1.txt"]


def test_many_small_files_are_few_tasks(spark, tmp_path):
    (tmp_path / "sub" / "_temporary").mkdir(parents=True)
    for i in range(1500):
        (tmp_path / "sub" / f"{i}.txt").write_text("x")
    (tmp_path / "sub" / "_temporary" / "y.txt").write_text("no file of the tree")
    (tmp_path / "sub" / ".hidden").write_text("nor this")
    found = files.read_tree(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= 8
    assert sorted(r.path for r in found.select("path").collect()) == sorted(f"sub/{i}.txt" for i in range(1500))
