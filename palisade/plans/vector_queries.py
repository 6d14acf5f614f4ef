"""Registered queries over vectors: encoding, exact and LSH neighbours, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.nested import items
from ..operators import chunks as C, pivots, select as S, vectors as V
from ..session import stage
from .corpus_queries import CHOSEN, comps, flat_comps
from .oracle_text import over_symbols
from .text_queries import DOC_CHUNKS, FILE_CHUNK_CTES, asked, documents, question_ctes
from .views import table

K_NEAREST = 10
CHUNK_STRIDE = 1 << 20  # more chunks than any accepted file can have
CONTEXT_TOKENS = 1500
QUESTION_STRIDE = 64  # more questions than are asked about a component


def embeddings(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def label_queries(spark, d):
    return V.centroids(embeddings(spark, d))


def chunk_id(ord_: str = "ord"):
    return F.col(ord_) * CHUNK_STRIDE + F.col("chunk_idx")


def document_chunks(spark, d):
    chunked = V.encode(C.chunks(documents(spark, d)), "content").select(
        chunk_id().alias("id"), "repo_id", F.concat(F.lit("doc/"), "ord").alias("path"),
        F.lit(None).cast("string").alias("language"), "content", "embedding",
    )
    return stage(chunked, "document-chunks")


def code_chunks(spark, d):
    """The chunk/vector table of the corpus, written once like the persisted index."""
    chunked = V.encode(C.chunk_rows(comps(spark, d)), "content").select(
        chunk_id().alias("id"), "repo_id", "path", "language", "extension", "content", "embedding"
    )
    return stage(chunked, "code-chunks")


def neighbours(df):
    return df.select("query_id", "id", "distance", F.col("rank").cast("long").alias("rank"))


def hashed_vectors(spark, d):
    encoded = V.encode(documents(spark, d), "content")
    return (
        encoded.select("ord", F.posexplode(items("embedding")).alias("pos", "x"))
        .filter("x <> 0")
        .select("ord", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))
    )


def vector_repair(spark, d):
    """Every embedding with its smallest element replaced by NaN, repaired and rescaled."""
    broken = embeddings(spark, d).withColumn(
        "embedding",
        F.transform(
            "embedding", lambda x: F.when(x == F.array_min("embedding"), float("nan")).otherwise(x.cast("double"))
        ),
    )
    return broken.select("id", F.posexplode(items(V.l2_normalise("embedding"))).alias("pos", "x")).select(
        "id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x")
    )


def knn_exact(spark, d):
    return neighbours(V.knn(label_queries(spark, d), embeddings(spark, d), K_NEAREST))


def knn_pivots(spark, d):
    """Every row whose id is divisible by 100 against all rows."""
    rows = embeddings(spark, d).select("id", "embedding")
    asked_rows = rows.filter(F.col("id") % 100 == 0).withColumnRenamed("id", "query_id")
    return neighbours(pivots.knn_pivots(asked_rows, rows, K_NEAREST))


def knn_filtered(spark, d):
    return neighbours(
        V.knn_filtered(label_queries(spark, d), embeddings(spark, d), K_NEAREST, match={"query_id": "label"})
    )


def knn_prefiltered(spark, d):
    corpus = embeddings(spark, d)
    keep = V.matches_metadata(F.create_map(F.lit("label"), F.col("label").cast("string")), {"label": [1, 3, 5]})
    return neighbours(V.knn_filtered(label_queries(spark, d), corpus, K_NEAREST, keep))


def context_retrieval(spark, d):
    """Every benchmark text against all chunks of all documents."""
    queries = V.encode(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "text")
    found = V.retrieve(queries.select("query_id", "embedding"), document_chunks(spark, d), 3)
    return found.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "distance", "id", F.md5("context").alias("context_md5")
    )


def path_context(spark, d):
    """Context of each selected component's own path: same repository and extension, twice as many for PHP."""
    wanted = V.encode(S.priority_components(flat_comps(spark, d)), "path").select(
        "repo_id", F.col("ord").alias("query_id"), "embedding", P.extension("path").alias("wanted_ext")
    )
    queries = V.with_adaptive_k(stage(wanted, "path-queries"), 1, F.col("wanted_ext") == ".php")
    found = V.retrieve(
        queries, code_chunks(spark, d), 1, scope="repo_id", match={"wanted_ext": "extension"}
    )
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "distance", "id", "path")


def asked_vectors(spark, d):
    texts = asked(spark, d).select(
        "repo_id", (F.col("ord") * QUESTION_STRIDE + F.col("pos")).alias("query_id"), F.concat("path", F.lit(" "), "question").alias("q")
    )
    return stage(V.encode(texts, "q").select("repo_id", "query_id", "embedding"), "questions")


def question_retrieval(spark, d):
    """Five chunks of the same repository for every exploration question, in one batch."""
    return neighbours(V.knn(asked_vectors(spark, d), code_chunks(spark, d).drop("content"), 5, scope="repo_id"))


def component_contexts(spark, d):
    """What the questions about a component found, as parts of a prompt, with the checksum of every part."""
    chunks = code_chunks(spark, d)
    found = V.knn(asked_vectors(spark, d), chunks.drop("content"), 5, scope="repo_id").select(
        F.floor(F.col("query_id") / QUESTION_STRIDE).alias("component"), (F.col("query_id") % QUESTION_STRIDE).alias("pos"), "rank", "id"
    )
    parts = V.component_contexts(found, chunks, CONTEXT_TOKENS)
    return parts.select("component", "part", "contexts", "tokens", F.md5("text").alias("text_md5"))


def knn_lsh(spark, d):
    return neighbours(V.knn_lsh(label_queries(spark, d), embeddings(spark, d), K_NEAREST))


QUERIES = {
    "hashed_vectors": hashed_vectors,
    "vector_repair": vector_repair,
    "knn_exact": knn_exact,
    "knn_pivots": knn_pivots,
    "knn_filtered": knn_filtered,
    "knn_prefiltered": knn_prefiltered,
    "knn_lsh": knn_lsh,
    "context_retrieval": context_retrieval,
    "path_context": path_context,
    "question_retrieval": question_retrieval,
    "component_contexts": component_contexts,
}


def vectors_of(name: str, source: str, key: str, text: str) -> str:
    """Dense unit vectors ``name(id, v)`` of the texts of ``source``."""
    return f"""{name}_toks AS (SELECT {key} AS id, unnest(regexp_extract_all(lower({text}), '[\\pL\\pN_]+')) AS tok FROM {source}),
    {name}_n AS (SELECT id, CAST(('0x' || substr(md5(tok), 1, 7)) AS BIGINT) % 64 AS pos, CAST(count(*) AS DOUBLE) AS n FROM {name}_toks GROUP BY ALL),
    {name}_len AS (SELECT id, sqrt(sum(n * n)) AS len FROM {name}_n GROUP BY 1),
    {name} AS (SELECT g.id, list(coalesce(n / len, 0.0) ORDER BY g.pos) AS v FROM
      (SELECT s.id, pos FROM (SELECT DISTINCT {key} AS id FROM {source}) s, (SELECT unnest(range(64)) AS pos) p) g
      LEFT JOIN {name}_n c ON c.id = g.id AND c.pos = g.pos LEFT JOIN {name}_len l ON l.id = g.id GROUP BY 1)"""


_CENTROIDS = """elems AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT label, pos, avg(x) AS x FROM elems GROUP BY 1, 2),
norms AS (SELECT label, sqrt(sum(x * x)) AS len FROM means GROUP BY 1),
q AS (SELECT label AS query_id, list(x / len ORDER BY pos) AS v FROM means JOIN norms USING (label) GROUP BY 1),
c AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
d AS (SELECT query_id, id, label, round(list_distance(q.v, c.v) * list_distance(q.v, c.v), 6) AS distance FROM q, c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)"""


def _distance(a: str, b: str) -> str:
    return f"round(list_distance({a}, {b}) * list_distance({a}, {b}), 6)"


_CODE_VECTORS = FILE_CHUNK_CTES + ", " + vectors_of("cv", f"(SELECT id * {CHUNK_STRIDE} + idx AS cid, content FROM chunk_texts) t", "cid", "content")

_FOUND = (
    vectors_of("qv", "(SELECT ord * 64 + pos AS qid, path || ' ' || question AS q FROM asked) t", "qid", "q")
    + f""", found AS (SELECT query_id, id, distance, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
          SELECT qv.id AS query_id, cv.id AS id, {_distance('qv.v', 'cv.v')} AS distance
          FROM qv JOIN comps q ON q.ord = qv.id // {QUESTION_STRIDE} JOIN comps c ON c.repo_id = q.repo_id JOIN cv ON cv.id // {CHUNK_STRIDE} = c.ord))
        WHERE rank <= 5)"""
)

ORACLE = {
    "hashed_vectors": f"""WITH {vectors_of('dv', 'documents', 'doc_id', 'text')}
      SELECT id AS ord, pos - 1 AS pos, round(x, 6) AS x FROM (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM dv) WHERE x <> 0""",
    "vector_repair": """WITH elems AS (SELECT vec_id AS id, unnest(embedding) AS raw, generate_subscripts(embedding, 1) - 1 AS pos, list_min(embedding) AS low FROM embeddings),
      fixed AS (SELECT id, pos, CASE WHEN raw = low THEN 0.0::DOUBLE ELSE raw::DOUBLE END AS x FROM elems)
      SELECT id, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS x FROM fixed""",
    "knn_exact": f"WITH {_CENTROIDS} SELECT query_id, id, distance, rank FROM r WHERE rank <= {K_NEAREST}",
    "knn_pivots": f"""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
      r AS (SELECT q.id AS query_id, c.id, {_distance('q.v', 'c.v')} AS distance FROM v q, v c WHERE q.id % 100 = 0)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM r) WHERE rank <= {K_NEAREST}""",
    "knn_filtered": f"""WITH {_CENTROIDS} SELECT query_id, id, distance, again AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS again FROM r WHERE label = query_id)
      WHERE again <= {K_NEAREST}""",
    "knn_lsh": f"""WITH {_CENTROIDS},
      planes AS (SELECT (n - 1) // 64 AS plane, (n - 1) % 64 AS pos, (n * n * 1103515245 + n * 12345) % 2147483647 / 1073741823.5 - 1 AS w
        FROM (SELECT unnest(range(1, {V.BANDS * V.BAND_BITS} * 64 + 1)) AS n)),
      vs AS (SELECT 0 AS side, query_id AS vid, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM q
        UNION ALL SELECT 1, id, unnest(v), generate_subscripts(v, 1) - 1 FROM c),
      sides AS (SELECT side, vid, plane, sum(x * w) > 0 AS up FROM vs JOIN planes USING (pos) GROUP BY 1, 2, 3),
      sigs AS (SELECT side, vid, plane // {V.BAND_BITS} AS band, sum(CASE WHEN up THEN 1 << (plane % {V.BAND_BITS})::INT ELSE 0 END) AS signature FROM sides GROUP BY 1, 2, 3),
      met AS (SELECT DISTINCT a.vid AS query_id, b.vid AS id FROM sigs a JOIN sigs b ON a.side = 0 AND b.side = 1 AND a.band = b.band AND a.signature = b.signature)
      SELECT query_id, id, distance, rank FROM (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
        FROM d JOIN met USING (query_id, id)) WHERE rank <= {K_NEAREST}""",
    "knn_prefiltered": f"""WITH {_CENTROIDS} SELECT query_id, id, distance, again AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS again FROM d WHERE label IN (1, 3, 5))
      WHERE again <= {K_NEAREST}""",
    "context_retrieval": f"""WITH RECURSIVE {DOC_CHUNKS}, {vectors_of('cv', f'(SELECT id * {CHUNK_STRIDE} + idx AS cid, content FROM chunk_texts) t', 'cid', 'content')},
      {vectors_of('qv', 'benchmark', 'item_id', 'text')},
      r AS (SELECT qv.id AS query_id, cv.id AS id, {_distance('qv.v', 'cv.v')} AS distance FROM qv, cv),
      top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM r) WHERE rank <= 3)
      SELECT query_id, rank, distance, t.id, md5('File: doc/' || x.id || chr(10) || chr(10) || content) AS context_md5
      FROM top t JOIN chunk_texts x ON x.id * {CHUNK_STRIDE} + x.idx = t.id""",
    "path_context": over_symbols(
        f"""SELECT query_id, again AS rank, distance, id, path FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS again FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
            SELECT q.ord AS query_id, q.ext AS want, CASE WHEN q.ext = '.php' THEN 2 ELSE 1 END AS k, cv.id AS id, c.ext AS have, c.path,
              {_distance('qv.v', 'cv.v')} AS distance
            FROM chosen q JOIN qv ON qv.id = q.ord JOIN comps c ON c.repo_id = q.repo_id JOIN cv ON cv.id // {CHUNK_STRIDE} = c.ord))
        WHERE want = have) WHERE again <= k""",
        _CODE_VECTORS, f"chosen AS ({CHOSEN})", vectors_of("qv", "chosen", "ord", "path"),
    ),
    "question_retrieval": over_symbols(
        "SELECT query_id, id, distance, rank FROM found", _CODE_VECTORS, question_ctes(), _FOUND
    ),
    "component_contexts": over_symbols(
        f"""SELECT component, row_number() OVER (PARTITION BY component ORDER BY cut) AS part, count(*) AS contexts, CAST(sum(tokens) AS BIGINT) AS tokens,
          md5(string_agg(ctx, chr(10) || chr(10) ORDER BY pos, rank, id)) AS text_md5
        FROM (SELECT *, CAST(floor(coalesce(sum(tokens) OVER (PARTITION BY component ORDER BY pos, rank, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            / {CONTEXT_TOKENS}) AS BIGINT) AS cut
          FROM (SELECT * FROM (SELECT f.query_id // {QUESTION_STRIDE} AS component, f.query_id % {QUESTION_STRIDE} AS pos, rank, id, ctx, length(ctx) // 4 AS tokens,
              row_number() OVER (PARTITION BY f.query_id // {QUESTION_STRIDE}, md5(content) ORDER BY f.query_id % {QUESTION_STRIDE}, rank, id) AS nth
            FROM found f JOIN (SELECT t.id * {CHUNK_STRIDE} + t.idx AS id, content, 'File: ' || path || ' (Language: ' || type || ')' || chr(10) || chr(10) || t.content AS ctx
              FROM (SELECT id, idx, content FROM chunk_texts) t JOIN (SELECT ord, path, type FROM comps) c ON c.ord = t.id) x USING (id)) WHERE nth = 1))
        GROUP BY component, cut""",
        _CODE_VECTORS, question_ctes(), _FOUND,
    ),
}
