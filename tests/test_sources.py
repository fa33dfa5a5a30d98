"""File sources and sinks."""

from __future__ import annotations

import hashlib

from corpusloom.sources import files


def test_catalog_round_trip_and_malformed_lines(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x.md", "md", "h1"), ("a", "y.md", "md", None), ("b", None, "txt", "h2")], "document_id string, path string, format string, sha256 string")
    files.write_jsonl(rows, str(tmp_path / "catalog"))
    (tmp_path / "more.jsonl").write_text('{"document_id": "c", "extra": 1}\nnot json\n')
    back = files.read_catalog(spark, str(tmp_path / "catalog"), str(tmp_path / "more.jsonl")).cache()
    assert sorted(r.document_id for r in back.collect() if r.document_id) == ["a", "a", "b", "c"]
    assert [r.malformed for r in back.where("malformed is not null").collect()] == ["not json"]
    assert [tuple(r) for r in files.duplicate_ids(back).collect()] == [("a", 2)]


def test_texts_and_integrity(spark, tmp_path):
    folder = tmp_path / "docs" / "deep"
    folder.mkdir(parents=True)
    (folder / "good.md").write_text("# 标题\n正文", encoding="utf-8")
    (folder / "bad.md").write_bytes(b"\xff\xfe broken")
    (folder / "skip.txt").write_text("no")
    texts = files.read_texts(spark, str(tmp_path / "docs")).cache()
    found = {r.path.rsplit("/", 1)[1]: r for r in texts.collect()}
    assert set(found) == {"good.md", "bad.md"} and found["good.md"].text == "# 标题\n正文" and found["bad.md"].text is None and not found["bad.md"].valid
    assert found["bad.md"].sha256 == hashlib.sha256(b"\xff\xfe broken").hexdigest()
    path = found["good.md"].path
    stated = spark.createDataFrame([(path, "0" * 64), ("gone.md", "1")], "path string, sha256 string")
    assert {tuple(r) for r in files.integrity(stated, texts).collect()} == {(path, "hash_mismatch"), ("gone.md", "file_missing"), (found["bad.md"].path, "file_unlisted")}
