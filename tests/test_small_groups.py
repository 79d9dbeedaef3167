from strataforge.operators import communities as C
from strataforge.operators import files_in_python as P


def test_near_duplicate_files(spark):
    text = "line of text number %d\n"
    base = "".join(text % i for i in range(40))
    rows = [("a", "1", base), ("a", "2", base), ("a", "3", base.replace("39", "xx")), ("a", "4", base[: len(base) // 2]), ("a", "5", None), ("b", "1", base)]
    got = {(r["artifact"], r["path"]) for r in P.distinct_files(spark.createDataFrame(rows, "artifact string, path string, text string")).collect()}
    assert got == {("a", "1"), ("a", "4"), ("a", "5"), ("b", "1")}


def test_syntax_facts(spark):
    rows = [("a", "m.py", "import os\nfrom x.y import z\nfrom . import q\nclass C:\n  def f(self): pass\nasync def g(): pass\n"), ("a", "bad.py", "def ("), ("a", "n.txt", "import os"), ("a", "e.py", None)]
    got = {(r["kind"], r["name"], r["line"]) for r in P.syntax_facts(spark.createDataFrame(rows, "artifact string, path string, text string")).collect()}
    assert got == {("Import", "os", 1), ("Import", "x.y", 2), ("Class", "C", 4), ("Function", "f", 5)}


def test_tree(spark):
    rows = spark.createDataFrame([("a", "src/m.py"), ("a", "README.md"), ("a", "src/n.py")], "artifact string, path string")
    assert P.rendered_tree(rows).first()["tree"] == "├── README.md\n└── src\n    ├── m.py\n    └── n.py"


def test_communities(spark):
    two = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]
    links = spark.createDataFrame(two, "a int, b int")
    assert C.modularity_communities(links, "a", "b") == [[1, 2, 3], [4, 5, 6]]
    top = C.betweenness(links, "a", "b", 2)
    assert [n for n, _ in top] == [3, 4] and abs(top[0][1] - 0.6) < 1e-9


def test_priority_clusters(spark):
    rows = [(v, d, w) for v, ws in {"a": (0.9, 0.1), "b": (0.88, 0.12), "c": (0.1, 0.9), "d": (0.5, 0.5)}.items() for d, w in zip(("x", "y"), ws, strict=True)]
    got = {r["venue"]: r["cluster"] for r in C.priority_clusters(spark.createDataFrame(rows, "venue string, dimension string, weight double"), "venue", "dimension", "weight").collect()}
    assert got["a"] == got["b"] and len(set(got.values())) == 3
