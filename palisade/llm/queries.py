"""The operators over their whole tables with production parameters, and the checking SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, decontaminate, hard_negatives, html_text, jaccard, language, language_model, packing, pii, sharding, token_counts, turn_repair, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).withColumn("terms", F.array_join("terms", ","))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, base = F.col("personal_data"), F.filter("personal_data", pii.of_kinds([k.name for k in pii.KINDS if k.base]))
    counts = [F.size(F.filter(spans, pii.of_kinds([k]))).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return pii.personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id", *counts, F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(spans).alias("spans")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"), vec_col="embedding")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), jaccard.Rule(words=3, part=90, base=100))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), whole_words=True)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turn_repair.with_every_conversation(turn_repair.repair(turn_repair.damaged(conversations)), conversations)


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def _url_sql() -> str:
    rules = ", ".join(f"('{rule}', split_part('{rule}', '/', 1), substr('{rule}', strpos('{rule}', '/')), '{verdict}')" for verdict, rule in url_filter.RULES)
    terms = ", ".join(f"('{t}', {'true' if t in url_filter.STRICT_TERMS else 'false'})" for t in sorted({*url_filter.STRICT_TERMS, *url_filter.SOFT_TERMS}))
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH rules(rule, rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
terms(term, strict) AS (VALUES {terms}),
parts AS (
  SELECT page_id, row_number() OVER () AS row_no, coalesce({lower.format('url')}, '') AS url,
    {lower.format("coalesce(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)([^?#]*)', 1) , '')")} AS host,
    coalesce(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)([^?#]*)', 2), '') AS path,
    coalesce(strpos(url, '://') > 0, false) AS has_host
  FROM pages),
clean AS (
  SELECT page_id, row_no, url, CASE WHEN has_host THEN host ELSE '' END AS host, CASE WHEN has_host THEN path ELSE '' END AS path FROM parts),
ruled AS (
  SELECT row_no, rule, rule_verdict FROM clean JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY length(rule) DESC, length(rule_host) DESC) = 1),
hits AS (
  SELECT row_no, term, strict FROM clean JOIN terms ON regexp_matches(url, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])')),
counts AS (
  SELECT row_no, count(*) FILTER (strict) AS n_strict, count(*) FILTER (NOT strict) AS n_soft, list(term ORDER BY term) AS terms
  FROM hits GROUP BY row_no)
SELECT page_id, host, path, rule,
  coalesce(rule_verdict, CASE WHEN n_strict > 0 OR n_soft >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(n_strict, 0) AS n_strict, coalesce(n_soft, 0) AS n_soft, array_to_string(coalesce(terms, []), ',') AS terms
FROM clean LEFT JOIN ruled USING (row_no) LEFT JOIN counts USING (row_no)"""


def _pii_sql() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    moved = "substr(replace(hit, ' ', ''), 5) || substr(replace(hit, ' ', ''), 1, 4)"
    valid = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(hit, '.'), lambda p: CAST('0' || right(ltrim(p, '0'), 4) AS INT) + CASE WHEN length(ltrim(p, '0')) > 3 THEN 999 ELSE 0 END)) <= 255",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda k: CASE WHEN k % 2 = 1 "
        f"THEN CAST({digits}[-k] AS INT) ELSE (CAST({digits}[-k] AS INT) * 2) // 10 + (CAST({digits}[-k] AS INT) * 2) % 10 END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"list_reduce(list_prepend(0, list_transform(string_split({moved}, ''), lambda c: CASE WHEN c >= 'A' THEN ord(c) - 55 ELSE ord(c) - 48 END)), "
        "lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1",
        "tel": "true",
    }
    parts = []
    for no, kind in enumerate(pii.KINDS):
        pattern = plain.get(kind.name, kind.pattern.removeprefix(pii.AHEAD))
        parts.append(f"""
  SELECT row_no, text, {no} AS no, '{kind.name}' AS kind, {kind.base} AS base, hit, first, first + length(hit) AS last FROM (
    SELECT row_no, text, unnest(hits) AS hit, unnest(list_transform(range(1, len(hits) + 1), lambda k:
      CAST(list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0) AS INT))) AS first
    FROM (SELECT row_no, text, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM docs) WHERE len(hits) > 0)
  WHERE {valid[kind.name]} AND ({kind.base} OR {kind.score} + CASE WHEN regexp_matches(
    lower(substr(text, greatest(first - {pii.CONTEXT_CHARS}, 0) + 1, least(first, {pii.CONTEXT_CHARS}))), '{kind.context}') THEN {pii.CONTEXT_BONUS} ELSE 0 END >= {pii.MIN_SCORE})""")
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_no FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
kept AS (
  SELECT * FROM spans s WHERE base OR NOT EXISTS (
    SELECT 1 FROM spans b WHERE b.base AND b.row_no = s.row_no AND s.first < b.last AND b.first < s.last)),
rolled AS (
  SELECT row_no, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
    count(*) FILTER (kind = 'phone') AS n_phone, string_agg(kind || ':' || first || ':' || last, ',' ORDER BY no, first) FILTER (base) AS base_spans,
    string_agg(kind || ':' || first || ':' || last, ',' ORDER BY no, first) AS spans
  FROM kept GROUP BY row_no)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN rolled USING (row_no)"""


def _turn_repair_sql() -> str:
    """One fold over a conversation's turns. ``st`` holds for each end of the text so far (nothing, s, u, pairs) the least {cost, audit, text}."""

    def bound(value: str, name: str, body: str) -> str:
        return f"list_transform([{value}], lambda {name}: {body})[1]"

    def go(state: str, cost: str, letter: str, line: str = "''") -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}}"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"

    def inserted(st: str) -> str:
        after_insert = [go(f"{st}[{k}]", "5", "I", user) for k in (1, 2, 4)]
        return f"[{st}[1], {st}[2], {least(f'{st}[3]', *after_insert)}, {least(f'{st}[4]', go(f'{st}[3]', '5', 'I', assistant))}]"

    dead = "1000000000000"
    stays = "CASE WHEN r.gone THEN " + dead + " WHEN r.cut THEN 5 ELSE 0 END"
    keeps = f"{stays} + CASE WHEN r.initial <> '{{}}' THEN {dead} ELSE 0 END"
    kept = "chr(10) || r.role || ':' || r.text"
    deleted = [go(f"q[{k}]", "2", "D") for k in (1, 2, 3, 4)]
    shifted = "[" + ", ".join([
        deleted[0],
        least(deleted[1], go("q[1]", keeps.format("s"), "K", kept)),
        least(deleted[2], *(way for k in (1, 2, 4) for way in (go(f"q[{k}]", keeps.format("u"), "K", kept), go(f"q[{k}]", f"1 + {stays}", "R", user + " || r.text")))),
        least(deleted[3], go("q[3]", keeps.format("a"), "K", kept), go("q[3]", f"1 + {stays}", "R", assistant + " || r.text")),
    ]) + "]"
    step = bound(inserted("acc"), "p", bound(inserted("p"), "q", shifted))
    start = f"[{{'c': 0::BIGINT, 'a': '', 't': ''}}, " + ", ".join([f"{{'c': {dead}::BIGINT, 'a': '', 't': ''}}"] * 3) + "]"
    finish = bound(inserted("folded"), "p", bound(inserted("p"), "q", least("q[1]", "q[4]")))
    checksum = (
        "xor(4294967295, list_reduce(list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT), "
        "lambda crc, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b)), 4294967295))"
    )
    return f"""
WITH named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
dealt AS (SELECT *, {checksum} % 20 AS way FROM named),
turns AS (
  SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN way = 1 THEN '' WHEN way = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN way = 0 THEN 0 WHEN way = 3 THEN 2 ELSE 1 END)) AS copy FROM dealt),
keyed AS (SELECT *, md5(coalesce(CAST(conv_id AS VARCHAR), '') || ':' || role || ':' || md5(text)) AS key FROM turns),
judged AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS empty,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS open,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key, copy) || left(role, 1) AS pair
  FROM keyed),
rolled AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (empty) AS blank,
    count(*) FILTER (again AND NOT empty) AS duplicate, count(*) FILTER (open AND NOT again AND NOT empty) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'role': role, 'text': text, 'initial': initial, 'gone': empty OR again, 'cut': open}} ORDER BY turn NULLS FIRST, role, key, copy) AS rows
  FROM judged GROUP BY conv_id),
parsed AS (SELECT * EXCLUDE (rows), list_reduce(rows, lambda acc, r: {step}, {start}) AS folded FROM rolled),
ended AS (SELECT * EXCLUDE (folded), {finish} AS best FROM parsed),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM every e LEFT JOIN ended d ON e.conv_id IS NOT DISTINCT FROM d.conv_id"""


HARD_NEGATIVES_SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS row_no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.row_no, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.row_no <> b.row_no AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT row_no, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS no
  FROM scored WHERE same QUALIFY no <= 5),
negatives AS (
  SELECT p.row_no, no, anchor_id, positive_id, positive_score, n.vec_id AS negative_id, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.row_no, no ORDER BY n.score DESC, n.vec_id) AS INT) AS rank
  FROM positives p JOIN scored n USING (row_no, anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5"""


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_language": op2_language,
    "op3_pii": op3_pii,
    "op4_ann": op4_ann,
    "op5_token_counts": op5_token_counts,
    "op6_sharding": op6_sharding,
    "op7_packing": op7_packing,
    "op8_html_text": op8_html_text,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_decontamination": op10_decontamination,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_turn_repair": op12_turn_repair,
    "op13_language_model": op13_language_model,
}

ORACLE = {
    "op1_url_filter": _url_sql(),
    "op3_pii": _pii_sql(),
    "op11_hard_negatives": HARD_NEGATIVES_SQL,
    "op12_turn_repair": _turn_repair_sql(),
}
