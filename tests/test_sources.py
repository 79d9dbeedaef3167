import io
import json
import tarfile
import zipfile

from pyspark.sql import functions as F

from strataforge.operators import graph as G
from strataforge.plans import agents as A
from strataforge.plans import artifact_graph as AG
from strataforge.sources import readers as R
from strataforge.sources import sinks as S


def test_guidelines(spark, tmp_path):
    for name, text in (("13_icse_2025.md", "a"), ("2_asia_ccs_2024.md", "b"), ("99_icse_2025.md", "c"), ("notes.md", "d"), ("x.txt", "e")):
        (tmp_path / name).write_text(text)
    rows = R.guidelines(spark, str(tmp_path))
    assert sorted((r["name"] or "", r["year"] or 0, r["size"]) for r in rows.collect()) == [("", 0, 1), ("ASIA CCS", 2024, 1), ("ICSE", 2025, 1), ("ICSE", 2025, 1)]
    assert {r["name"]: r["text"] for r in R.last_of_each(rows).collect()} == {"ICSE": "c", "ASIA CCS": "b"}


def test_archives(spark, tmp_path):
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w:gz") as t:
        info = tarfile.TarInfo("deep/README.md")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "README.md"
        t.addfile(link)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/a.md", "# A")
        z.writestr("../evil.md", "no")
        z.writestr("in.tar.gz", inner.getvalue())
    (tmp_path / "broken.zip").write_bytes(b"junk")
    (tmp_path / "b.7z").write_bytes(b"7z")
    rows = {(r["artifact"], r["path"]): (r["status"], bytes(r["content"]) if r["content"] is not None else None) for r in R.archives(spark, str(tmp_path)).collect()}
    assert rows["a.zip", "x/a.md"] == ("ok", b"# A") and rows["a.zip", "in.tar.gz/deep/README.md"] == ("ok", b"hi") and rows["a.zip", "in.tar.gz/link"] == ("ok", b"README.md")
    assert rows["a.zip", "../evil.md"] == ("unsafe path", None) and rows["broken.zip", "broken.zip"][0].startswith("broken") and rows["b.7z", "b.7z"][0] == "unsupported"
    only = [r["path"] for r in R.archives(spark, str(tmp_path), ".md").filter("status = 'ok'").collect()]
    assert sorted(only) == ["in.tar.gz/deep/README.md", "x/a.md"]


def test_bombs_are_rows(spark, tmp_path):
    import bz2
    import gzip
    import lzma

    size = R.MEMBER_BYTES + 1000
    for name, pack in (("a.gz", gzip.compress), ("b.bz2", bz2.compress), ("c.xz", lzma.compress)):
        (tmp_path / name).write_bytes(pack(bytes(size)))  # small files of 50 MB of zeros
    (tmp_path / "d.txt.gz").write_bytes(gzip.compress(b"small"))
    rows = {r["artifact"]: (r["status"], r["size"], r["content"]) for r in R.archives(spark, str(tmp_path)).collect()}
    assert all(rows[n] == ("too large", R.MEMBER_BYTES + 1, None) for n in ("a.gz", "b.bz2", "c.xz"))
    assert rows["d.txt.gz"][0] == "ok" and bytes(rows["d.txt.gz"][2]) == b"small"


def test_repository_and_sampling(spark, tmp_path):
    for k in range(14):
        (tmp_path / f"f{k:02}.py").write_text("x")
    for k in range(5):
        (tmp_path / f"g{k}.bin2").write_text("x")
    (tmp_path / "zz_README.md").write_text("r")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "a.py").write_text("x")
    rows = R.repository(spark, str(tmp_path))
    assert rows.count() == 20
    names = {r["path"].rpartition("/")[2] for r in R.sampled(rows).collect()}
    assert len(names) == 14 and "zz_README.md" in names
    assert "zz_README.md" not in {r["path"].rpartition("/")[2] for r in R.sampled(rows, compat=True).collect()}


def test_bytes_to_text(spark):
    rows = spark.createDataFrame([(bytearray(b"a\n\nb\xff\n"),), (bytearray("é".encode()),), (None,)], "c binary").select(R.text_of("c").alias("t"), R.lines_of("c").alias("l")).collect()
    assert [r["t"] for r in rows] == ["a\n\nbÿ\n", "é", ""] and rows[0]["l"] == ["a", "b"]


ART = {
    "artifact_name": "art",
    "repository_structure": [{"name": "README.md", "path": "README.md", "size_kb": 1.0}, {"name": "m.py", "path": "src/a/m.py", "size_kb": 2.0}],
    "documentation_files": [{"path": "README.md", "content": ["# Title", "text", "## Installation", "pip install x", "## Results and more", "good", "```", "x", "```"]}],
    "docker_files": [{"path": "Dockerfile", "content": ["FROM a"]}],
    "code_files": [{"path": "requirements.txt", "content": ["numpy>=1", "pandas==2"]}],
}


def test_documents_graph_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "art.json").write_text(json.dumps(ART))
    (tmp_path / "in" / "bad.json").write_text("{not json")
    docs, failures = R.analysis_documents(spark, str(tmp_path / "in"))
    assert [r["artifact_name"] for r in docs.collect()] == ["art"] and failures.count() == 1
    heads = AG.sections(AG.all_files(docs)).orderBy("idx").collect()
    assert [(h["heading"], h["level"], h["type"], h["line_no"], h["body"]) for h in heads] == [("Title", 1, "general", 1, "text"), ("Installation", 2, "installation", 3, "pip install x"), ("Results and more", 2, "results", 5, "good\n```\nx\n```")]
    nodes, edges = AG.nodes_edges(docs)
    counts = {r["label"]: r["n"] for r in G.type_counts(nodes, "label").collect()}
    assert counts == {"Artifact": 1, "Directory": 2, "Documentation": 1, "CodeFile": 1, "File": 1, "DependencyFile": 1, "Section": 3, "Dependency": 2}
    assert G.endpoints(edges, nodes).count() == edges.count()
    root = nodes.filter("label = 'Artifact'").first()["id"]
    assert G.closure(edges, "CONTAINS", 3).filter(F.col("src") == root).count() == 6
    rich = AG.enriched(AG.sections(AG.all_files(docs)))
    q = AG.readme_quality(rich).first()
    assert (q["score"], q["grade"], q["instruction"], q["n_sections"]) == (20 + 10 + 15, "F", "low", 3)  # installation, results, a code fence
    assert AG.archetypes(rich).first()["archetype"] == "summary-only"
    assert AG.section_patterns(AG.sections(AG.all_files(docs))).count() == 3
    assert AG.motifs(rich, AG.all_files(docs)).first()["motifs"] == ["installation", "results"]
    scores = A.agent_scores(A.component_scores(docs))
    wide = S.merged_scores(scores, A.decisions(scores))
    S.table(wide, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1
    S.graph(nodes, edges, str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph" / "edges")).count() == edges.count()


def test_bibliography(spark, tmp_path):
    (tmp_path / "a.bib").write_text("@software{k1,\nauthor = {A B},\ntitle = {T},\nyear = {2020},\n}\n@software{k2,\ntitle = {U},\n}\n")
    rows = R.bibliography(spark, str(tmp_path / "a.bib")).orderBy("key").collect()
    assert [(r["key"], r["author"], r["title"], r["year"]) for r in rows] == [("k1", "A B", "T", "2020"), ("k2", None, "U", None)]
