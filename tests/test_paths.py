import re

import pytest

from palisade.functions import paths as P
from palisade.sources import corpus, tree


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_extension_and_stem(rows):
    cases = {
        ".bashrc": ("", ".bashrc"), "a.tar.gz": (".gz", "a.tar"), "x/.a.py": (".py", ".a"), "a.": ("", "a."),
        "x": ("", "x"), "d.x/readme": ("", "readme"), "d/Main.PY": (".py", "Main"),
    }
    df = rows("path string", [(p,) for p in cases])
    got = values(df, "path", P.extension("path"), P.stem("path"))
    assert {p: (e, s) for p, e, s in got} == cases


def test_languages(rows):
    df = rows("ext string", [(".inc",), (".ts",), (".zig",), ("",)])
    assert values(df, P.grammar_language("ext"), P.display_language("ext")) == [
        ("php", "PHP"), ("javascript", "TypeScript"), (None, "Unknown"), (None, "Unknown"),
    ]


def test_entry_points(rows):
    cases = [
        ("src/main.rb", "", True), ("src/Main.tar.py", "", False), ("a/INDEX", "", True),
        ("a.py", 'x\nif __name__ == "__main__":', True), ("a.js", 'if __name__ == "__main__":', False),
        ("a.js", "window.addEventListener('load', f)", True), ("a.php", "x" * 96 + "<?php", False),
        ("a.php", "x" * 95 + "<?php", True), ("a.PHP", "<?php", False), ("b.php", "function rcmail", True),
        ("A.java", "public static void main(String[] a)", True), ("a.go", "func main() {", True), ("c.go", "func main", False),
    ]
    df = rows("path string, content string, want boolean", cases)
    assert all(g == w for g, w in values(df, P.is_entry_point("path", "content"), "want"))


def test_ignored(rows):
    cases = {
        "a/.git/x": (True, True), "a/b.pyc": (True, True), "lib.so/x.c": (True, True), "src/a.min.js": (False, True),
        "dist/a.js": (False, True), "dist": (False, False), "env.py": (False, False), "env/x.py": (True, True),
        "a.tar.gz": (False, True), ".tar.gz": (True, True), "vendor/x.py": (False, True),
    }
    df = rows("path string", [(p,) for p in cases])
    got = values(df, "path", P.is_ignored("path"), P.is_ignored("path", strict_globs=True))
    assert {p: (a, b) for p, a, b in got} == cases


def test_test_paths_are_substring_matches(rows):
    df = rows("path string", [("src/latest.py",), ("Test/x.py",), ("tes/t.py",)])
    assert [r[0] for r in values(df, P.is_test_path("path"))] == [True, True, False]


def test_search_patterns(rows):
    df = rows("path string", [("src/auth/a.py",), ("AUTH.py",), ("x/auth",)])
    assert [r[0] for r in values(df, P.path_matches("path", "*auth*"))] == [True, False, True]
    assert [r[0] for r in values(df, P.path_matches("path", "*.p?"))] == [True, True, False]
    assert [r[0] for r in values(df, P.path_matches("path", "auth/a"))] == [True, False, False]
    assert [r[0] for r in values(df, P.path_matches("path", "[!A]*"))] == [True, False, True]


def test_scan_filter(rows):
    big = 10 * 1024 * 1024
    df = rows(
        "repo_id string, path string, content string, length long, ord long",
        [("r", "a.py", "x", big, 1), ("r", "b.py", "x", big + 1, 2), ("r", "test/c.py", "x", 1, 3), ("r", "venv/d.py", "x", 1, 4)],
    )
    assert [r.path for r in corpus.filter_files(df).collect()] == ["a.py", "b.py"]
    assert [r.path for r in corpus.filter_files(df, max_bytes=big).collect()] == ["a.py"]


@pytest.mark.parametrize("name", ["stack_entries", "dominant_language", "architecture_pattern", "top_extensions", "path_search", "extension_boundaries"])
def test_queries_over_paths_read_no_texts(spark, name):
    from palisade.plans import catalog

    built = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    schemas = re.findall(r"ReadSchema: (struct<.*?>)\n", built._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    assert schemas and not any("text:" in s for s in schemas)


def test_decode_replaces_invalid_bytes(rows):
    df = rows("content binary", [(b"ok",), (b"a\xffb",)])
    assert [r[0] for r in values(df, corpus.decode("content"))] == ["ok", "a\ufffdb"]


def test_document_ingest(rows):
    meta = "struct<file_path: string, language: string, extension: string, is_entry_point: boolean>"
    df = rows(
        f"repo_id string, file_path string, content string, metadata {meta}, ord long",
        [
            ("r", "a.py", "x", None, 1), ("r", None, "x", ("m.py", None, None, None), 2), ("r", None, "x", None, 3),
            ("r", "b.py", "", None, 4), ("r", "TESTS/b.py", "x", None, 5), ("r", "c.py", None, None, 6),
        ],
    )
    assert sorted(r.path for r in corpus.ingest_documents(df).collect()) == ["a.py", "m.py"]


def test_binary_scan(spark, tmp_path):
    for name, data in {
        "r1/src/a b.py": b"hello", "r1/.git/x": b"no", "r1/.env": b"a=1\r\n", "r1/pkg/__init__.py": b"", "r1/pkg/_a.py": b"a", "r1/pkg/_posts/x.md": b"p", "r1/bad.py": b"\xff\xfe", "r2/é.js": "ü".encode(),
        "r2/unit_test.py": b"no", "latest/a.py": b"l", "env/b+c%20.py": b"e", "r1/tree/r1/deep.py": b"d", "top.py": b"no",
    }.items():
        f = tmp_path / "tree" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)
    got = {(r.repo_id, r.path, r.content, r.length) for r in corpus.scan_files(spark, str(tmp_path / "tree")).collect()}
    assert got == {
        ("r1", "src/a b.py", "hello", 5), ("r2", "é.js", "ü", 2), ("latest", "a.py", "l", 1), ("env", "b+c%20.py", "e", 1),
        ("r1", "tree/r1/deep.py", "d", 1), ("r1", ".env", "a=1\r\n", 5), ("r1", "pkg/__init__.py", "", 0), ("r1", "pkg/_a.py", "a", 1),
        ("r1", "pkg/_posts/x.md", "p", 1),
    }
    why = {(r.repo_id, r.path, r.reason) for r in corpus.skipped_files(spark, str(tmp_path / "tree"), max_bytes=4).collect()}
    assert why == {
        ("r1", "bad.py", "not text"), ("r2", "unit_test.py", "test"), ("r1", "src/a b.py", "too large"), ("r1", ".git/x", "ignored"), ("r1", ".env", "too large"),
    }
    order = corpus.numbered(corpus.scan_files(spark, str(tmp_path / "tree"))).orderBy("ord").collect()
    assert [(r.repo_id, r.path) for r in order] == sorted((g[0], g[1]) for g in got)


def test_binary_scan_opens_only_what_it_keeps(spark, tmp_path, monkeypatch):
    for name in ("r/a.py", "r/node_modules/x/b.py", "r/large.py", "s/.git/deep/c", "s/link.py"):
        f = tmp_path / "tree" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x" * (100 if "large" in name else 1))
    (tmp_path / "tree/r/again").symlink_to(tmp_path / "tree/r")  # a link that leads back
    listed = {(r.repo_id, r.path) for r in tree.list_files(spark, str(tmp_path / "tree"), corpus.keep_path("path")).collect()}
    assert listed == {("r", "a.py"), ("r", "large.py"), ("s", "link.py")}  # ignored directories are not entered
    kept = corpus.scan_files(spark, f"file://{tmp_path}/tree", max_bytes=10)
    (tmp_path / "tree/s/link.py").unlink()
    assert [(r.repo_id, r.path) for r in kept.collect()] == [("r", "a.py")]
    text = kept._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("MapInArrow") < text.index("too large")  # sizes are asked below the step that reads bytes
    assert tree.list_files(spark, str(tmp_path)).filter("path LIKE '%again%'").count() == 0


def test_written_files_come_back(spark, tmp_path):
    rows = [("r", "a/b.py", "x\r\ny\x00é"), ("r", "_c/.d", ""), ("q", "e f+%.py", "1"), ("q", None, "no"), (None, "p", "no"), ("q", "n", None)]
    root = str(tmp_path / "out")
    for _ in range(2):  # a task that runs again
        assert tree.write_files(spark.createDataFrame(rows, "repo_id string, path string, content string"), root) == 3
    back = tree.read_files(tree.list_files(spark, root), root).collect()
    assert {(r.repo_id, r.path, r.content.decode()) for r in back} == set(rows[:3]) and all(r.length == len(r.content) for r in back)
