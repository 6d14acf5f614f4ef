import random

import pytest
from pyspark.sql import functions as F

from palisade.functions.ordering import first_per_group, with_position
from palisade.operators import prompts as Q, rollups as R, select as S, structure as T

FILES = "repo_id string, path string, ord long"


def test_with_position_equals_row_number(rows):
    rng = random.Random(1)
    ords = rng.sample(range(-500, 100_000), 400)
    data = [(rng.choice("ab"), rng.randint(0, 3), o) for o in ords]
    got = with_position(rows("k string, tier int, o long", data), ["k"], "o", "pos", tier="tier", width=100).collect()
    for key in "ab":
        mine = sorted((r.tier, r.o, r.pos) for r in got if r.k == key)
        assert [p for *_, p in mine] == list(range(1, len(mine) + 1))


def test_group_limit_is_pushed_below_the_shuffle(rows, plan):
    df = first_per_group(rows(FILES, [("r", "a", 1)]), ["repo_id"], [F.asc("ord")], 5)
    assert "WindowGroupLimit" in plan(df)


def test_path_search_numbers_distinct_paths(rows):
    df = rows(FILES, [("r", f"auth{i}", 100 - i) for i in range(15)] + [("r", "auth3", 500), ("q", "x/auth", 1), ("q", "none", 2)])
    got = {(r.repo_id, r.path, r["rank"]) for r in S.path_search(df, "auth").collect()}
    assert got == {("r", f"auth{i}", 15 - i) for i in range(15)} | {("q", "x/auth", 1)}
    assert {r.path for r in S.path_search(df, "auth", 10).collect()} == {f"auth{i}" for i in range(5, 15)} | {"x/auth"}


def flagged(rows, data):
    return rows("repo_id string, path string, name string, is_entry_point boolean, ord long", data)


def test_all_critical_files(rows):
    data = [("r", f"jwt/{i:02d}.py", f"{i:02d}.py", False, i) for i in range(12)] + [("r", "z.py", "z.py", True, 99), ("r", "SQL.py", "SQL.py", False, 100)]
    got = {r.path for r in S.critical_files(flagged(rows, data)).collect()}
    assert got == {f"jwt/{i:02d}.py" for i in range(12)} | {"z.py"}
    marked = S.flag_critical(flagged(rows, data))
    assert marked.filter("is_critical").count() == 13 and marked.count() == len(data)


def test_priority_components(rows):
    data = [("r", f"p{i}.rb", f"p{i}.rb", False, i) for i in range(600)] + [("r", "AuthX.rb", "AuthX.rb", False, 900), ("r", "e.rb", "e.rb", True, 901)]
    data += [("small", f"p{i}.rb", f"p{i}.rb", False, i) for i in range(50)]
    got = S.priority_components(flagged(rows, data)).collect()
    big = sorted((r.position, r.path) for r in got if r.repo_id == "r")
    assert [n for n, _ in big] == list(range(1, 603)) and [p for _, p in big[:3]] == ["AuthX.rb", "e.rb", "p0.rb"]
    assert S.priority_components(flagged(rows, data), cap=7).count() == 14
    assert sum(r.repo_id == "small" for r in got) == 50


def test_tiers_and_cap(rows):
    data = [("r", "z/plain.rb", "", False, 0), ("r", "route.rb", "", False, 1), ("r", "user_route.rb", "", False, 2),
            ("r", "go.rb", "", True, 3), ("r", "schema.rb", "", False, 4)]
    tiered = S.tiered_files(flagged(rows, data))
    order = [r.path for r in tiered.orderBy("tier", "ord").collect()]
    assert order == ["go.rb", "user_route.rb", "schema.rb", "route.rb", "z/plain.rb"]
    kept = S.capped_files(tiered, cap=10).orderBy("position").collect()
    assert [r.path for r in kept] == order
    assert [r.path for r in S.capped_files(tiered).orderBy("position").collect()] == order
    assert [r.path for r in S.capped_files(tiered, cap=3).orderBy("position").collect()] == order[:3]


def test_restricted_edges(rows):
    edges = rows("repo_id string, src_path string, dst_path string", [("r", "a", "b"), ("r", "a", "c"), ("r", "a", "latest"), ("q", "a", "b")])
    files = rows("repo_id string, path string", [("r", "a"), ("r", "b"), ("r", "latest")])
    assert [(e.src_path, e.dst_path) for e in S.restricted_edges(edges, files).collect()] == [("a", "b")]


def test_not_indexed_normalises_both_sides(rows):
    files = rows(FILES, [("r", "a\\b.py", 1), ("r", "c.py", 2), ("q", "a/b.py", 3)])
    indexed = rows("repo_id string, path string", [("r", "a/b.py")])
    assert sorted(r.ord for r in S.not_indexed(files, indexed).collect()) == [2, 3]


def test_best_related(rows):
    edges = rows("repo_id string, src_path string, dst_path string, ord long",
                 [("r", "a.py", "x.js", 1), ("r", "a.py", "y.py", 2), ("r", "b.rb", "q.js", 5), ("r", "b.rb", "p.js", 4)])
    assert {(r.src_path, r.dst_path) for r in S.best_related(edges).collect()} == {("a.py", "y.py"), ("b.rb", "p.js")}


def test_best_of_dependencies_is_that_of_the_pairs(rows):
    """Against the pairs of files, over paths that name themselves, ties of order, empty names and several extensions."""
    rng = random.Random(5)
    names = ["a", "ab", "abc", "core", "core_a", "x"]
    for with_modules in (False, True):
        files = []
        for n in range(60):
            path = f"{rng.choice(names)}/{rng.choice(names)}{n}{rng.choice(['.py', '.js', '.go', ''])}"
            deps = [rng.choice([*names, "core/a", "none", "", path]) for _ in range(rng.randrange(4))]
            files.append((rng.choice("rs"), path, n // 3, deps, rng.choice([*names, "mod", ""])))
        comps = rows("repo_id string, path string, ord long, dependencies array<string>, module_name string", files)
        comps = comps if with_modules else comps.drop("module_name")
        deps, hits = T.dependency_tables(comps)
        pairs = T.related_files(deps, hits).join(comps.select("repo_id", F.col("path").alias("dst_path"), "ord"), ["repo_id", "dst_path"])
        wanted = {(x.repo_id, x.src_path, x.dst_path, x.related) for x in S.best_related(pairs).collect()}
        got = {(x.repo_id, x.src_path, x.dst_path, x.related) for x in S.best_of_dependencies(deps, hits, comps).collect()}
        assert got == wanted and len(wanted) > 10


def test_languages_and_stack(rows):
    df = rows(FILES, [("r", "a.zig", 1), ("r", "b.zig", 2), ("r", "c.go", 3), ("r", ".hidden.py", 4), ("r", "build/x.py", 5),
                      ("r", "venvs/y.py", 6), ("e", "README", 1)])
    assert {(r.repo_id, r.primary_language) for r in R.primary_language(df).collect()} == {("r", "go"), ("e", "python")}
    assert {(r.repo_id, r.dominant_language) for r in R.dominant_language(df).collect()} == {("r", "Python"), ("e", None)}
    stack = {r.repo_id: r.tech_stack for r in R.tech_stack(df, top=2).collect()}
    assert stack == {"r": ".py (3 files), .zig (2 files)", "e": "Unknown technology stack"}
    hist = {r.ext: (r.files, round(r.percentage, 3)) for r in R.extension_histogram(df.filter("repo_id = 'r'")).collect()}
    assert hist == {".zig": (2, 66.667), ".go": (1, 33.333)}


def test_repo_validity(rows):
    df = rows(FILES, [("a", ".git/config", 1), ("b", "Makefile", 1), ("c", "stuff/x", 1)])
    got = {r.repo_id: (r.files, r.is_valid, r.has_indicator) for r in R.repo_validity(df).collect()}
    assert got == {"a": (0, False, True), "b": (1, True, True), "c": (1, True, False)}


def test_key_directories(rows):
    df = rows("repo_id string, path string, type string, is_entry_point boolean",
              [("r", "SRC/a", "Go", False), ("r", "SRC/b", "PHP", False), ("r", "zz/a", "Go", True), ("r", "zz/b", "Go", False),
               ("r", "qq/a", "Go", False), ("r", "qq/b", "Go", False), ("r", "api/a", "Go", True)])
    got = {r.directory: (r.file_count, r.languages, r.contains_entry_point) for r in R.key_directories(df).collect()}
    assert got == {"SRC": (2, ["Go", "PHP"], False), "zz": (2, ["Go"], True)}


def test_boundary_lines_stay_rows(rows, spark):
    flows = rows("repo_id string, source string, crosses_boundary boolean", [("r", "a", True), ("r", "a", True), ("r", "b", False), ("s", "lone", True)])
    many = spark.range(70_000).select(F.lit("a").alias("member"), F.concat(F.lit("B"), "id").alias("boundary"), F.col("id").alias("ord"))
    members = many.unionByName(rows("member string, boundary string, ord long", [("b", "B1", 0)]))
    named = many.select("boundary", F.when(F.col("ord") > 0, F.lit("d")).alias("description"))
    got = Q.boundary_context_lines(flows, members, named)
    first = {(x.repo_id, x.source, x.line_no, x.line) for x in got.filter("line_no < 3").collect()}
    warning = "WARNING: This data flow crosses security boundaries!"
    assert first == {("s", "lone", 1, warning), ("r", "a", 1, "Source is within security boundary: B0 - "), ("r", "a", 2, "Source is within security boundary: B1 - d")}
    assert got.count() == 70_002 and got.filter("line_no = 70001").first().line == warning
