"""File sources and sinks: ranges of blocks, damaged files, commits and aborts."""

import json
import subprocess
import sys
from pathlib import Path

import pytest

from quern.sources import container
from quern.sources.files import Paged, library_rows, numbered, read_entry_folder, read_libraries, write_entry_folder

ROOT = Path(__file__).resolve().parents[1]
ENTRIES = [(f"w_{i:04d}.win", bytes([i % 256]) * (i * 7 % 1500)) for i in range(400)]


def test_ranges_give_each_entry_once(spark, tmp_path):
    data = container.build_library(ENTRIES)
    (tmp_path / "a.pbd").write_bytes(data)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.pbd").write_bytes(container.build_library([("app.apl", b"x" * 21)], base=2048))
    found = read_libraries(spark, str(tmp_path), split_bytes=4096)
    assert found.rdd.getNumPartitions() > len(data) // 4096 > 2
    rows = numbered(found).where("library LIKE '%a.pbd'").orderBy("entry_index").collect()
    assert [(r.name, bytes(r.data)) for r in rows] == ENTRIES
    assert [r.entry_index for r in rows] == list(range(400))
    old = {r.name: r for r in container.entries(container.parse_libraries(container.libraries(spark, str(tmp_path)))).collect()}
    for r in numbered(found).collect():
        o = old[r.name]
        assert (r.object_type, r["size"], r.offset, r.entry_index, r.data_blocks) == (o.object_type, o["size"], o.offset, o.entry_index, o.data_blocks)


def test_errors_are_rows_whatever_the_ranges(tmp_path):
    data = bytearray(container.build_library(ENTRIES[:60]))
    nodes = [i for i in range(0, len(data), 512) if data[i : i + 4] == b"NOD*"]
    data[nodes[-1] + 20 : nodes[-1] + 22] = (3000).to_bytes(2, "little")
    first = data.index(b"DAT*")
    data[first + 8 : first + 10] = (600).to_bytes(2, "little")
    whole = list(library_rows(bytes(data)))
    parts = [r for a in range(0, len(data), 2048) for r in library_rows(bytes(data), a, a + 2048)]
    assert parts == whole and {r["name"] for r in whole if r["error"]} >= {"<node>"}
    assert [r["error"] for r in library_rows(b"x" * 5000)] == ["no library header; the file starts with b'xxxx'"]
    assert [r["name"] for r in library_rows(b"")] == ["<header>"]
    bare = container.build_library([])
    assert [r["name"] for r in library_rows(bare)] == ["<directory>"] == [r["name"] for a in range(0, len(bare), 1024) for r in library_rows(bare, a, a + 1024)]


def test_pages(tmp_path, monkeypatch):
    import pyarrow.fs as pafs

    from quern.sources import files

    monkeypatch.setattr(files, "PAGE", 16)
    monkeypatch.setattr(files, "PAGES", 2)
    data = bytes(range(256))
    (tmp_path / "f").write_bytes(data)
    paged = Paged(pafs.LocalFileSystem().open_input_file(str(tmp_path / "f")))
    assert len(paged) == 256
    for a in range(0, 260, 7):
        for n in (0, 1, 15, 16, 50, 300):
            assert paged[a : a + n] == data[a : a + n]


def test_folder_round_trip(spark, tmp_path):
    rows = [(i, f'a<{i}>"?.txt', bytes([i]) * i, i / 2, None if i % 2 else [i]) for i in range(50)]
    table = spark.createDataFrame(rows, "entry_index int, name string, data binary, share double, marks array<int>").repartition(7)
    folder = str(tmp_path / "out")
    write_entry_folder(table, folder)
    manifest = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert manifest["entries"] == 50 and manifest["bytes"] == sum(range(50)) and len(manifest["parts"]) == 7
    found = {json.loads(r.entry)["entry_index"]: r for r in read_entry_folder(spark, folder).collect()}
    for i, name, data, share, marks in rows:
        line = json.loads(found[i].entry)
        assert (bytes(found[i].content), line["name"], line["share"], line["marks"]) == (data, name, share, marks)
        assert Path(found[i].file).read_bytes() == data and Path(found[i].file).name.endswith(f"-{i:04d}_a_{i}___.txt.bin")
    with pytest.raises(Exception, match="is not empty"):
        write_entry_folder(table, folder)
    next(Path(folder).rglob("*0049_*.bin")).write_bytes(b"other")
    with pytest.raises(Exception, match="is not what was written"):
        read_entry_folder(spark, folder).collect()


def test_empty_table_is_a_whole_manifest(spark, tmp_path):
    write_entry_folder(spark.createDataFrame([], "entry_index int, name string, data binary"), str(tmp_path / "out"))
    assert read_entry_folder(spark, str(tmp_path / "out")).collect() == []


def test_aborted_job_leaves_nothing(spark, tmp_path):
    table = spark.range(20).selectExpr("int(id) AS entry_index", "concat('n', id) AS name", "CASE WHEN id = 13 THEN cast(raise_error('stop') AS binary) ELSE cast('x' AS binary) END AS data").repartition(4)
    with pytest.raises(Exception, match="stop"):
        write_entry_folder(table, str(tmp_path / "out"))
    assert not (tmp_path / "out" / "manifest.json").exists()
    assert not list((tmp_path / "out").rglob("*.bin"))


KILLED = """
import os, sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from quern.sources.files import read_entry_folder, write_entry_folder

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
out, mark = sys.argv[1:]

@F.udf("binary")
def once(i):
    if i == 30 and not os.path.exists(mark):
        open(mark, "w").close()
        os._exit(1)  # the worker dies in the middle of its task
    return b"x" * i

write_entry_folder(spark.range(40).repartition(2).select(F.col("id").cast("int").alias("entry_index"), F.lit("n").alias("name"), once("id").alias("data")), out)
assert os.path.exists(mark)
print(sorted(r.size for r in read_entry_folder(spark, out).select("size").collect()) == list(range(40)), len(os.listdir(out + "/objects")))
"""


def test_manifest_is_whole_after_a_task_was_killed(tmp_path):
    import os

    done = subprocess.run([sys.executable, "-c", KILLED, str(tmp_path / "out"), str(tmp_path / "mark")], capture_output=True, text=True, timeout=180, env=os.environ | {"PYTHONPATH": str(ROOT)}, check=False)
    assert done.stdout.strip().splitlines()[-1:] == ["True 2"], done.stderr[-2000:]
