"""Classes and what they inherit from: parent classes out of class statements, resolved by scope, and all ancestors.

A parent's name means, in this order, a class of its own file, one of a file that the file imports, the first one of the
repository, or something outside. Every scope is an equi-join of its own, the last one with at most two candidates a name, so a
name that a third of all files define or inherit from never multiplies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import paths as P
from ..functions.nested import items
from ..session import stage

SCOPES = ("file", "import", "repository", "external")

_CLASS = r"(?m)^(?:export[ \t]+|default[ \t]+|abstract[ \t]+|final[ \t]+)*class[ \t]+([A-Za-z_$][A-Za-z0-9_$]*)([^\n:{]*)"
_LISTED = r"^[ \t]*\(([^()]*)\)"
_EXTENDS, _IMPLEMENTS = r"[ \t]extends[ \t]+([^ \t\r]+)", r"[ \t]implements[ \t]+(.*)$"
_LAST_NAME = r"([A-Za-z_$][A-Za-z0-9_$]*)$"
_KEY = ["repo_id", "path", "seq"]


def class_statements(files: DataFrame) -> DataFrame:
    """Top-level class statements in order: ``repo_id, path, ord, seq, class_name, bases``, ``bases`` as they are named, in order.

    Of a qualified name the last part counts; keyword arguments and type arguments of a Python class are no parents.
    """
    family = P.grammar_language(P.extension("path"))
    found = F.arrays_zip(F.regexp_extract_all("content", F.lit(_CLASS), 1).alias("name"), F.regexp_extract_all("content", F.lit(_CLASS), 2).alias("head"))
    cut = files.filter(family.isin("python", "php", "javascript")).select("repo_id", "path", "ord", family.alias("family"), F.posexplode(found).alias("seq", "c"))
    head = F.col("c.head")
    named = F.when(F.col("family") == "python", F.split(F.regexp_extract(head, _LISTED, 1), ",")).otherwise(
        F.concat(F.array(F.regexp_extract(head, _EXTENDS, 1)), F.split(F.regexp_extract(head, _IMPLEMENTS, 1), ","))
    )
    plain = F.transform(F.filter(named, lambda b: ~F.contains(b, F.lit("="))), lambda b: F.regexp_extract(F.trim(F.regexp_replace(b, r"\[.*$", "")), _LAST_NAME, 1))
    return cut.select("repo_id", "path", "ord", "seq", F.col("c.name").alias("class_name"), F.filter(plain, lambda b: b != "").alias("bases"))


def inheritance_edges(classes: DataFrame, imports: DataFrame) -> DataFrame:
    """``repo_id, path, seq, class_name, pos, base, scope, parent_path, parent_seq`` for every named parent of every class.

    ``classes`` are :func:`class_statements`, ``imports`` has ``repo_id, src_path, dst_path``. Of several classes of one name in a scope
    the first by file and place is taken, never the class itself; a parent that no file defines is ``external``.
    """
    bases = classes.select(*_KEY, "class_name", F.posexplode(items("bases")).alias("pos", "base"))
    defined = classes.select(
        "repo_id", F.col("class_name").alias("base"), F.col("path").alias("parent_path"), F.col("seq").alias("parent_seq"), F.col("ord").alias("parent_ord")
    )
    other = (F.col("path") != F.col("parent_path")) | (F.col("seq") != F.col("parent_seq"))
    own = bases.join(defined.withColumn("path", F.col("parent_path")), ["repo_id", "path", "base"]).filter(other)
    linked = imports.select("repo_id", F.col("src_path").alias("path"), F.col("dst_path").alias("parent_path")).distinct()
    imported = bases.join(linked, ["repo_id", "path"]).join(defined, ["repo_id", "parent_path", "base"]).filter(other)
    first = Window.partitionBy("repo_id", "base").orderBy("parent_ord", "parent_path", "parent_seq")
    two = defined.withColumn("rank", F.row_number().over(first)).filter("rank <= 2").drop("rank")
    anywhere = bases.join(two, ["repo_id", "base"]).filter(other)
    found = None
    for scope, rows in enumerate((own, imported, anywhere)):
        part = rows.select(*_KEY, "pos", F.struct(F.lit(scope).alias("scope"), "parent_ord", "parent_path", "parent_seq").alias("parent"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy(*_KEY, "pos").agg(F.min("parent").alias("parent"))
    scope = F.element_at(F.array(*map(F.lit, SCOPES)), F.coalesce(F.col("parent.scope"), F.lit(len(SCOPES) - 1)) + 1)
    return bases.join(best, [*_KEY, "pos"], "left").select(
        *_KEY, "class_name", "pos", "base", scope.alias("scope"), F.col("parent.parent_path").alias("parent_path"), F.col("parent.parent_seq").alias("parent_seq")
    )


def ancestors(edges: DataFrame) -> DataFrame:
    """``repo_id, path, seq, ancestor_path, ancestor_seq, depth``: all classes that a class inherits from, by the shortest way.

    Ways double in every round, so a chain of n classes takes log n of them; rounds end when nothing gets shorter, whatever cycles
    there are. No class is its own ancestor. Each round is written.
    """
    steps = edges.filter("parent_path IS NOT NULL").select(
        *_KEY, F.col("parent_path").alias("ancestor_path"), F.col("parent_seq").alias("ancestor_seq"), F.lit(1).alias("depth")
    )
    pair = [*_KEY, "ancestor_path", "ancestor_seq"]
    shortest = lambda ways: ways.filter("path <> ancestor_path OR seq <> ancestor_seq").groupBy(*pair).agg(F.min("depth").alias("depth"))
    known, size = stage(shortest(steps), "ancestors"), None
    while True:
        grown = known.agg(F.count(F.lit(1)).alias("n"), F.sum("depth").alias("depth")).head()
        if grown == size:
            return known
        size = grown
        further = known.select("repo_id", F.col("path").alias("ancestor_path"), F.col("seq").alias("ancestor_seq"), F.col("ancestor_path").alias("to_path"),
                               F.col("ancestor_seq").alias("to_seq"), F.col("depth").alias("more"))
        longer = known.join(further, ["repo_id", "ancestor_path", "ancestor_seq"]).select(
            *_KEY, F.col("to_path").alias("ancestor_path"), F.col("to_seq").alias("ancestor_seq"), (F.col("depth") + F.col("more")).alias("depth")
        )
        known = stage(shortest(known.unionByName(longer)), "ancestors")


def inheritance_lines(edges: DataFrame) -> DataFrame:
    """Diagram lines, one per parent: ``repo_id, path, seq, pos, line``."""
    line = F.concat(F.lit("    "), F.col("base"), F.lit(" <|-- "), F.col("class_name"), F.lit(" : inherits"))
    return edges.select(*_KEY, "pos", line.alias("line"))
