"""Growing files: resumed by offset, torn lines left, rewritten files read anew, ranges cut anywhere."""

from tessera.sources import lines
from tessera.streaming import jobs


def _drain(spark, folder, out, **options):
    spark.dataSource.register(lines.LineSource)
    stream = spark.readStream.format("growing_lines").option("path", folder)
    for k, v in options.items():
        stream = stream.option(k, v)
    return sorted((r["path"].rsplit("/", 1)[-1], r["line"]) for r in jobs.drained(stream.load(), out).collect())


def test_grows_tears_and_rewrites(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    a, b = folder / "a.jsonl", folder / "b.jsonl"
    a.write_bytes(b'{"n": 1}\n{"n": 2}\n{"n": 3')
    b.write_bytes("ž\r\n".encode())
    (folder / ".hidden").write_bytes(b"x\n")
    assert _drain(spark, str(folder), out) == [("a.jsonl", '{"n": 1}'), ("a.jsonl", '{"n": 2}'), ("b.jsonl", "ž")]
    with a.open("ab") as f:
        f.write(b'}\n{"n": 4}\n')
    assert len(_drain(spark, str(folder), out)) == 5 and ("a.jsonl", '{"n": 3}') in _drain(spark, str(folder), out)
    b.write_bytes(b"new 1\nnew 2\nnew 3\n")  # rewritten: what was read of it is forgotten
    assert [x for x in _drain(spark, str(folder), out) if x[0] == "b.jsonl"] == [("b.jsonl", "new 1"), ("b.jsonl", "new 2"), ("b.jsonl", "new 3"), ("b.jsonl", "ž")]


def test_ranges_and_long_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "CHUNK", 7)
    text = [f"line {i} " + "x" * (i % 23) for i in range(40)]
    (tmp_path / "f.txt").write_text("\n".join(text) + "\ntorn")
    reader = lines.LineReader({"path": str(tmp_path), "maxLine": 25})
    end = reader.latestOffset()
    got = [line for p in reader.partitions(reader.initialOffset(), end) for _, _, line in reader.read(p)]
    assert got == [t for t in text if len(t) <= 25] and len(got) < 40
    assert reader.partitions(end, reader.latestOffset()) == []


def test_nothing_there(spark, tmp_path):
    assert lines.LineReader({"path": str(tmp_path)}).latestOffset() == {"files": "{}"}
