"""The queries of this package: name -> (spark, sf_dir) -> DataFrame, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chains, common, decontam, jaccard, maxent, mixing, pii, quality, secrets, urls, wavelet


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), urls.train(urls.labelled_urls(spark)), urls.RULES, keep=("page_id",))


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encode_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op3_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(read(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(quality.BASE)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"))


def ledger_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablation(quality.ledger(read(spark, sf_dir, "documents")))


def op4_maxent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 10 != 0)


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.passages(read(spark, sf_dir, "documents"))


def op6_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(read(spark, sf_dir, "documents"))[0]


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secrets.Ledger(spark, common.new_path(spark, "ledger"))
    paths = ledger.scan(read(spark, sf_dir, "documents"))
    return secrets.digest(secrets.per_path(paths, ledger.findings(secrets.RULES)))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.surrogates(read(spark, sf_dir, "documents").select("doc_id", "text"), key="quire")
    count = lambda k: F.size(F.filter("__entities", lambda e: e["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return out.select("doc_id", "text", *map(count, pii.TYPES))


def op10_benchmark_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_wavelet_tokens": op2_wavelet_tokens,
    "op3_quality_ledger": op3_quality_ledger,
    "ledger_ablation": ledger_ablation,
    "op4_maxent_score": op4_maxent_score,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_jaccard_components": op6_jaccard_components,
    "op7_secret_ledger": op7_secret_ledger,
    "op8_source_mix": op8_source_mix,
    "op9_surrogates": op9_surrogates,
    "op10_benchmark_overlaps": op10_benchmark_overlaps,
}

_MEASURES = r"""
t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^ \t-\r]+') AS ws,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM t),
g AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
d AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, i AS p FROM d UNION ALL SELECT k, i + 1 FROM d UNION ALL SELECT k, i + 2 FROM d) GROUP BY k),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[ \t-\r]', '', 'g'))::BIGINT AS word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
      len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_capitals FROM w LEFT JOIN r USING (k)),
f AS (SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
      + 8 * (100 * n_dup_lines > 45 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 18 * n_words)::INT
      + 64 * (100 * n_capitals > 40 * word_chars)::INT AS failed FROM m)
"""

#: (kind, RE2 pattern, group before the span, group that is measured, its least length), each pattern by itself: the rules' look-behinds are a group that is left out of the span.
_SECRETS = (
    ("assign", r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\x20*[:=]\x20*[\"'']?)([A-Za-z0-9+/_.=-]+)", 0, 2, 6),
    ("access", r"()(AKIA[A-Z0-9]{16,})", 1, 2, 20),
    ("hex", r"()([0-9a-f]{24,})", 1, 2, 24),
    ("upper_hex", r"()([0-9]+[A-F][0-9A-F]*|[A-F]+[0-9][0-9A-F]*)", 1, 2, 32),
    ("private_key", r"()(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)", 1, 2, 1),
    ("jwt", r"(^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 2, 1),
    ("url_login", r"()([a-z0-9+.-]+://[^ \t-\r/:@]+:[^ \t-\r/@]{4,}@)", 1, 2, 1),
)


def _secrets_sql() -> str:
    """Spans from the lengths of what a pattern matches and what lies between."""
    parts = ["t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents)"]
    for n, (kind, pattern, lead, group, least) in enumerate(_SECRETS):
        parts.append(
            f"""m{n} AS (SELECT k, unnest(range(1, len(ms) + 1)) AS i, ms, ls, vs, ps FROM (SELECT k, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {lead}) AS ls,
regexp_extract_all(text, '{pattern}', {group}) AS vs, string_split_regex(text, '{pattern}') AS ps FROM t WHERE regexp_matches(text, '{pattern}'))),
s{n} AS (SELECT k, {n} AS number, '{kind}' AS kind, length(ms[i]) AS size, {f'length(ls[i])' if lead else 0} AS lead, length(vs[i]) AS measured,
sum(length(ps[i]) + CASE WHEN i > 1 THEN length(ms[i - 1]) ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS begins FROM m{n}),
f{n} AS (SELECT k, number, kind, (begins + lead)::BIGINT AS b, (begins + size)::BIGINT AS e FROM s{n} WHERE measured >= {least})"""
        )
    every = " UNION ALL ".join(f"SELECT * FROM f{n}" for n in range(len(_SECRETS)))
    text = "string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, number)"
    return f"""WITH {', '.join(parts)}, f AS ({every}),
g AS (SELECT k, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex, {text} FILTER (number < 3) AS base, {text} AS spans FROM f GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (k)"""


ORACLES = {
    "op7_secret_ledger": _secrets_sql(),
    "op3_quality_ledger": f"WITH {_MEASURES} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed & 127 = 0 AS kept FROM f",
    "ledger_ablation": f"""WITH {_MEASURES},
p AS (SELECT * FROM (VALUES ('base', 1, 3), ('default', 1, 63), ('default', 2, 127)) AS x(policy, version, mask)),
b AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('duplicate_lines', 8), ('short_words', 16), ('long_words', 32), ('capitals', 64)) AS x(rule, bit))
SELECT policy, version, rule, count(*) FILTER (failed & bit <> 0) AS fails, count(*) FILTER (failed & mask = bit) AS fails_alone, count(*) FILTER (failed & mask <> 0) AS rejected
FROM f, p, b WHERE mask & bit <> 0 GROUP BY ALL""",
    "op6_jaccard_components": r"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
c AS (SELECT a AS node, a AS reached FROM (SELECT DISTINCT a FROM e) UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.reached)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce((SELECT min(reached) FROM c WHERE c.node = w.doc_id), w.doc_id)::BIGINT AS component_id FROM w LEFT JOIN n USING (doc_id)""",
    "op8_source_mix": r"""WITH
t AS (SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::BIGINT AS size FROM documents),
k AS (SELECT *, -ln((('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE)
      / greatest(0.1::DOUBLE, 1 - len(regexp_extract_all(text, '[#*$%&|<>]')) / greatest(size, 1)::DOUBLE) AS key FROM t),
z AS (SELECT source, sum(size)::BIGINT AS source_size FROM t GROUP BY source),
o AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM z),
r AS (SELECT *, 3 * source_size AS most, sum(source_size) OVER () AS everything,
      coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
      sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM o),
l AS (SELECT *, (everything - capped)::DOUBLE / open AS level FROM r),
h AS (SELECT arg_min(level, most / weight) AS fill FROM l WHERE level * weight <= most),
q AS (SELECT source, source_size, CASE WHEN fill * weight > most THEN most::DOUBLE ELSE fill * weight END AS target FROM l, h),
u AS (SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
      sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (size * (epochs + (size > 0 AND upto - size / 2 <= target - epochs * source_size)::INT))::BIGINT AS taken FROM u""",
}
