import random

from palisade.operators import structure as T

PY = '''import os.path
from  odd import x
from pkg.mod import (
    a,
    b,
)
@decorated
class Base(object):
    """Doc."""
    attr = 1

    def first(self, a, b=1, *args):
        def inner(q):
            pass

    async def second(self):
        pass

def top(x, y: int, z):
    pass

def spread(
    a,
    b,
):
    pass
'''
JS = '''import thing from './lib/thing.js';
const a = require('left-pad'), b = require("./lib/b");
const plain = 5;
class View extends Base {
  constructor(el) {
    if (el) {
    }
  }
  static async load(id, opts = {}) {
  }
}
async function run(a, b) {
}
'''
PHP = '''<?php
include 'lib/a.php';
require_once("conf.php");
final class Shop
{
    public function buy(string $item, &$qty = 1) {
    }
}
function helper($x)
{
}
'''


def parsed(rows, path, content):
    df = rows("repo_id string, path string, content string, length long, ord long", [("r", path, content, 1, 1)])
    return T.components(df).first()


def shape(fs):
    return [(f.name, list(f.parameters)) for f in fs]


def test_python(rows):
    c = parsed(rows, "a/m.py", PY)
    assert [k.name for k in c.classes] == ["Base"]
    assert shape(c.classes[0].methods) == [("first", ["self", "a"]), ("second", ["self"])]
    assert shape(c.functions) == [("top", ["x", "z"]), ("spread", ["a", "b"])]
    assert c.imports == ["import os.path", "from  odd import x", "from pkg.mod import (\n    a,\n    b,\n)"]
    assert c.dependencies == ["os", "pkg"]  # the empty name of the double space is dropped


def test_javascript(rows):
    c = parsed(rows, "m.js", JS)
    assert shape(c.classes[0].methods) == [("constructor", ["el"]), ("load", ["id"])]
    assert shape(c.functions) == [("run", ["a", "b"])]
    assert c.dependencies == ["thing", "left-pad", "./lib/b"]


def test_php(rows):
    c = parsed(rows, "m.php", PHP)
    assert [k.name for k in c.classes] == ["Shop"]
    assert shape(c.classes[0].methods) == [("buy", ["$item", "$qty"])]
    assert shape(c.functions) == [("helper", ["$x"])]
    assert c.imports == ["include 'lib/a.php'", 'include "conf.php"']
    assert c.dependencies == ["lib/a.php", "conf.php"]


def test_other_languages_are_components_without_structure(rows):
    c = parsed(rows, "M.java", "class X {}\nimport y;")
    assert (c.type, c.classes, c.functions, c.imports, c.dependencies) == ("Java", [], [], [], [])


def test_primary_only(rows):
    df = rows("repo_id string, path string, content string, length long, ord long",
              [("r", "a.py", "", 1, 1), ("r", "b.js", "", 1, 2)])
    only = rows("repo_id string, primary_language string", [("r", "python")])
    assert [c.path for c in T.components(df, only).collect()] == ["a.py"]


def test_data_flows(rows):
    df = rows("repo_id string, path string, content string, length long, ord long", [("r", "a/m.py", PY, 1, 1)])
    got = {(f.source, f.function) for f in T.data_flows(T.components(df)).collect()}
    assert got == {("m.py", "top"), ("m.py", "spread"), ("m.py.Base", "first"), ("m.py.Base", "second")}


def comps(rows, data):
    return rows("repo_id string, path string, imports array<string>, dependencies array<string>, ord long", data)


def test_import_edges_one_hit_per_directory(rows):
    c = comps(rows, [("r", "src/a.py", ["import lib/util", "import util", r"include win\util.js"], [], 1)])
    files = rows("repo_id string, path string, ord long",
                 [("r", "x/util", 1), ("r", "x/util.py", 2), ("r", "y/util.js", 3), ("q", "z/util.py", 4), ("r", "util.js", 5)])
    got = {(e.import_pos, e.dst_path) for e in T.import_edges(c, files).collect()}
    assert got == {(0, "x/util"), (0, "y/util.js"), (0, "util.js"), (2, "y/util.js"), (2, "util.js")}


def test_dependency_edges_equal_nested_loop(rows):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abc/.") for _ in range(n))
    data = [
        (f"r{i % 2}", f"{word(rng.randint(1, 9))}{i}", [], [word(rng.choice([1, 2, 3, 4])) for _ in range(rng.randint(0, 4))], i)
        for i in range(60)
    ]
    want = sorted(
        (r, p, pos, dep, q)
        for r, p, _, deps, _ in data for pos, dep in enumerate(deps)
        for r2, q, *_ in data if r2 == r and q != p and dep in q
    )
    got = sorted((e.repo_id, e.src_path, e.dep_pos, e.dep, e.dst_path) for e in T.dependency_edges(comps(rows, data)).collect())
    assert got == want and len(want) > 50


def test_dependency_edges_have_no_nested_loop(rows, plan):
    text = plan(T.dependency_edges(comps(rows, [("r", "a", [], ["b"], 1)])))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_relationships_keep_lonely_files(rows):
    c = comps(rows, [("r", "a", [], ["b"], 1), ("r", "b", [], [], 2)])
    got = {(x.src_path, x.dst_path) for x in T.relationships(c, T.dependency_edges(c)).collect()}
    assert got == {("a", "b"), ("b", None)}


def test_structure_is_a_narrow_map_without_python(rows, plan):
    df = rows("repo_id string, path string, content string, length long, ord long", [("r", "a.py", PY, 1, 1)])
    text = plan(T.components(df))
    assert "Exchange" not in text and "EvalPython" not in text


def test_dependencies_by_module_name(rows):
    df = rows(
        "repo_id string, path string, dependencies array<string>, module_name string",
        [("r", "a.py", ["core", "other"], ""), ("r", "b.py", [], "core"), ("r", "core/c.py", [], "core"), ("q", "d.py", [], "core")],
    )
    got = {(e.src_path, e.dep, e.dst_path) for e in T.dependency_edges(df).collect()}
    assert got == {("a.py", "core", "b.py"), ("a.py", "core", "core/c.py")}
