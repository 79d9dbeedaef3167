"""Discovery and intake of artifacts: what is found, packed and read, and that bad ones are rows."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from strataforge.sources import intake as I
from strataforge.sources import readers as R


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def tarred(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, body in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "tool" / "src" / "deep").mkdir(parents=True)
    (tmp_path / "tool" / "README.md").write_text("# Tool\n")
    (tmp_path / "tool" / "src" / "deep" / "main.py").write_text("x = 1\n")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "empty").mkdir()
    (tmp_path / "a.zip").write_bytes(zipped({"README.md": b"hello", "in.tgz": tarred({"d/notes.md": b"notes"})}))
    (tmp_path / "b.tar.gz").write_bytes(tarred({"x.md": b"x", "y.bin": b"12345678"}))
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    (tmp_path / "loose.txt").write_text("not an artifact")
    return tmp_path


def rows(df):
    return {(r["artifact"], r["path"]): r for r in df.collect()}


def test_found_and_read(spark, folder):
    assert [(a.name, a.kind) for a in I.discover(str(folder))] == [("a", "archive"), ("b.tar", "archive"), ("bad", "archive"), ("empty", "directory"), ("tool", "directory")]
    got = rows(I.artifacts(spark, str(folder)))
    assert {k: bytes(r["content"]) for k, r in got.items() if r["status"] == "ok"} == {
        ("a", "README.md"): b"hello", ("a", "in.tgz/d/notes.md"): b"notes", ("b.tar", "x.md"): b"x", ("b.tar", "y.bin"): b"12345678",
        ("tool", "README.md"): b"# Tool\n", ("tool", "src/deep/main.py"): b"x = 1\n",
    }
    assert got["bad", "bad.zip"]["status"].startswith("broken: ")
    assert rows(I.artifacts(spark, folder.as_uri())).keys() == got.keys()


def test_nested_names(tmp_path):
    for name, inside in (("one", ("p.zip", "q.tar.gz")), ("two", ("README.md",)), ("three", ())):
        (tmp_path / name).mkdir()
        for file in inside:
            (tmp_path / name / file).write_bytes(b"")
    (tmp_path / "top.zip").write_bytes(b"")
    assert [(a.name, a.kind) for a in I.discover(str(tmp_path), nested=True)] == [("one_p", "archive"), ("one_q.tar", "archive"), ("two", "directory")]


def test_filters_reach_the_source(spark, folder):
    df = I.artifacts(spark, str(folder)).filter(F.col("path").endswith(".md") & (F.col("size") > 1))
    assert set(rows(df)) == {("a", "README.md"), ("a", "in.tgz/d/notes.md"), ("tool", "README.md")}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EndsWith" not in plan and "> 1" not in plan  # the source applies both
    kept = I.artifacts(spark, str(folder), suffix=".py", content="false")
    assert {(k, r["status"], r["content"]) for k, r in rows(kept).items()} == {(("tool", "src/deep/main.py"), "ok", None), (("bad", "bad.zip"), "broken: ArrowInvalid", None)}


def test_packing():
    a = I.Artifact("a", "a", "directory", 0)
    units = [I.Unit(a, str(i), "file", n) for i, n in enumerate((4, 5, 20, 1, 9, 1))]
    assert [[u.size for u in g] for g in I.packed(units, 10)] == [[4, 5], [20], [1, 9], [1]]
    assert I.packed([], 10) == []


def test_partitions_by_size(spark, folder):
    whole, split = (I.artifacts(spark, str(folder), groupBytes=str(n)) for n in (1 << 40, 1))
    assert whole.rdd.getNumPartitions() == 1 and split.rdd.getNumPartitions() == 5
    assert rows(whole).keys() == rows(split).keys()


def test_intake_and_report(spark, folder):
    taken = I.intake(I.artifacts(spark, str(folder)))
    got = {r["artifact"]: tuple(r)[2:] for r in taken.collect()}
    assert got == {"a": (2, 10, 0, True, None), "b.tar": (2, 9, 0, True, None), "bad": (0, 0, 1, False, "broken: ArrowInvalid"), "tool": (2, 13, 0, True, None)}
    assert tuple(I.batch_report(taken).first()) == (4, 3, 1, 75.0, 32)
    assert tuple(I.batch_report(taken.limit(0)).first()) == (0, 0, 0, 0.0, 0)


def test_a_list_of_artifacts(spark, folder):
    listing = json.dumps([{"path": f"{folder}/a.zip", "name": "first"}, {"path": f"{folder}/a.zip"}, {"path": f"{folder}/tool"}, {"path": f"{folder}/gone.zip"}])
    taken = {r["artifact"]: (r["kind"], r["n_files"], r["error"]) for r in I.intake(I.artifacts(spark, listing=listing)).collect()}
    assert taken == {"first": ("archive", 2, None), "tool": ("directory", 2, None), "gone": ("missing", 0, "missing")}
    with pytest.raises(Exception, match="path or a listing"):
        I.artifacts(spark).collect()


def test_empty_folder(spark, tmp_path):
    assert I.artifacts(spark, str(tmp_path)).collect() == []


def test_validated_and_texts(spark, tmp_path):
    for name, body in (("a.md", "x"), ("b.txt", "yy"), ("c.md", ""), ("d.md", " \n"), ("e.py", "z")):
        (tmp_path / name).write_text(body)
    assert sorted((r["path"].rpartition("/")[2], r["size"]) for r in R.validated(spark, str(tmp_path)).collect()) == [("a.md", 1), ("b.txt", 2), ("d.md", 2)]
    assert sorted(tuple(r) for r in R.texts(spark, [f"{tmp_path}/{n}" for n in ("a.md", "c.md", "d.md")]).collect()) == [("a.md", "x")]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no .md or .txt"):
        R.validated(spark, str(tmp_path / "none"))
