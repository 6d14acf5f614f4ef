"""Parent classes by scope, and ancestors against a plain search."""

import random

from palisade.operators import inheritance as I

FILES = "repo_id string, path string, ord long, content string"


def test_class_statements(spark):
    python = "class A(B, pkg.C[int], metaclass=M):\n    class Inner(X): pass\nclass D:\nclass E (  F ) :\nclass G(\n  class_of(x)\n"
    script = "export default class A extends lib.B {\nclass C{\n  class D extends E {\nfinal class F extends \\N\\G implements H, I {\n"
    files = spark.createDataFrame([("r", "a.py", 1, python), ("r", "b.js", 2, script), ("r", "c.txt", 3, python), ("r", "d.php", 4, ""), ("r", "e.py", 5, None)], FILES)
    got = [(r.path, r.seq, r.class_name, r.bases) for r in I.class_statements(files).orderBy("path", "seq").collect()]
    assert got == [
        ("a.py", 0, "A", ["B", "C"]), ("a.py", 1, "D", []), ("a.py", 2, "E", ["F"]), ("a.py", 3, "G", []),
        ("b.js", 0, "A", ["B"]), ("b.js", 1, "C", []), ("b.js", 2, "F", ["G", "H", "I"]),
    ]
    assert I.class_statements(files.limit(0)).collect() == []


def test_scopes(spark):
    classes = spark.createDataFrame(
        [
            ("r", "a.py", 5, 0, "A", ["Own", "Imported", "Far", "Gone", "A"]), ("r", "a.py", 5, 1, "Own", ["Own"]),
            ("r", "b.py", 1, 0, "Own", []), ("r", "b.py", 1, 1, "Far", []), ("r", "b.py", 1, 2, "Imported", []),
            ("r", "c.py", 9, 0, "Imported", []), ("r", "c.py", 9, 1, "Far", []), ("q", "a.py", 0, 0, "Gone", ["Far"]), ("r", "d.py", 2, 0, "A", ["Own", "A"]),
        ],
        "repo_id string, path string, ord long, seq int, class_name string, bases array<string>",
    )
    imports = spark.createDataFrame([("r", "a.py", "c.py"), ("r", "a.py", "c.py"), ("q", "a.py", "b.py")], "repo_id string, src_path string, dst_path string")
    got = {(r.repo_id, r.path, r.seq, r.base): (r.scope, r.parent_path, r.parent_seq) for r in I.inheritance_edges(classes, imports).collect()}
    assert got == {
        ("r", "a.py", 0, "Own"): ("file", "a.py", 1), ("r", "a.py", 0, "Imported"): ("import", "c.py", 0), ("r", "a.py", 0, "Far"): ("import", "c.py", 1),
        ("r", "a.py", 0, "Gone"): ("external", None, None), ("r", "a.py", 0, "A"): ("repository", "d.py", 0), ("r", "a.py", 1, "Own"): ("repository", "b.py", 0),
        ("q", "a.py", 0, "Far"): ("external", None, None), ("r", "d.py", 0, "Own"): ("repository", "b.py", 0), ("r", "d.py", 0, "A"): ("repository", "a.py", 0),
    }
    assert [r.line for r in I.inheritance_lines(I.inheritance_edges(classes, imports)).filter("path = 'd.py'").orderBy("pos").collect()] == [
        "    Own <|-- A : inherits", "    A <|-- A : inherits"
    ]


def test_ancestors(spark):
    draw = random.Random(1)
    links = {k: {draw.randrange(60) for _ in range(draw.randint(0, 2))} for k in range(60)}
    links |= {100 + k: {101 + k} for k in range(40)}  # a chain, and a cycle of three
    links |= {200: {201}, 201: {202}, 202: {200, 200}}
    rows = [("r", f"f{a}", 0, "C", p, "x", "file", f"f{b}", 0) for a, to in links.items() for p, b in enumerate(to)]
    rows += [("r", "f100", 0, "C", 9, "x", "external", None, None), ("s", "f100", 0, "C", 0, "x", "file", "f7", 0)]
    edges = spark.createDataFrame(rows, "repo_id string, path string, seq int, class_name string, pos int, base string, scope string, parent_path string, parent_seq int")
    want = {("s", "f100", "f7", 1)}
    for a in links:
        depth, level = {}, {a}
        for k in range(1, 200):
            level = {b for x in level for b in links.get(x, ())} - set(depth)
            depth |= dict.fromkeys(level, k)
        want |= {("r", f"f{a}", f"f{b}", d) for b, d in depth.items() if a != b}
    got = [(r.repo_id, r.path, r.ancestor_path, r.depth) for r in I.ancestors(edges).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert I.ancestors(edges.limit(0)).collect() == []
