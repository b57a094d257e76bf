"""Queries of the numbered operators, over whole tables, and the SQL some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder
from . import (
    decontaminate,
    fingerprints,
    hard_negatives,
    html_extract,
    licenses,
    mixing,
    quality,
    sentencepiece_fst,
    simhash,
    token_rollups,
    toxicity,
    url_reputation,
    vector_codes,
)
from .common import stored, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)


@query
def op1_decontamination(spark, folder):
    found = decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op2_simhash(spark, folder):
    return simhash.near_duplicate_components(table(spark, folder, "documents"))


@query
def op3_html_extraction(spark, folder):
    return html_extract.extract_main_text(table(spark, folder, "pages"))


@query
def op4_fingerprints(spark, folder):
    return fingerprints.fingerprint_documents(table(spark, folder, "documents"))


@query
def op5_toxicity(spark, folder):
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op7_quality(spark, folder):
    return quality.score_quality(table(spark, folder, "documents"))


@query
def op8_sentencepiece(spark, folder):
    """Digests of the ids and of the decoded text; ids of a null text are none."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = sentencepiece_fst.round_trip(docs, sentencepiece_fst.read_model())
    return done.select(
        F.col("doc_id").cast("long"),
        "n_pieces",
        F.lower(F.lpad(F.hex(F.xxhash64("ids")), 16, "0")).alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "round_trip",
    )


@query
def op6_url_reputation(spark, folder):
    pages, labels = table(spark, folder, "pages"), table(spark, folder, "labels")
    judged = url_reputation.judge_urls(pages, url_reputation.outcomes_by_document(pages, labels))
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_labelled")


@query
def op9_token_rollups(spark, folder):
    """Four batches over all documents: counts under a byte-pair vocabulary, counts in bytes, the
    byte-pair counts revised by an end mark each, and all but the first of equal texts deleted from
    both; the third comes twice and counts once."""
    docs, root = table(spark, folder, "documents"), scratch_folder(spark, "rollup")
    pieces = stored(token_rollups.count_tokens(docs, token_rollups.read_ranks(), "byte_bpe_50k"), "counts")
    plain = docs.select(
        token_rollups.doc_key(docs).alias("doc_key"),
        F.lit("utf8_bytes").alias("tokenizer"),
        "source",
        "lang",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_tokens"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_key"),
    )
    plain = stored(plain, "counts")
    marked = pieces.withColumn("n_tokens", F.col("n_tokens") + 1)
    first = plain.groupBy("text_key").agg(F.min("doc_key").alias("doc_key"))
    copies = plain.join(first, ["text_key", "doc_key"], "left_anti")
    both = copies.unionByName(copies.withColumn("tokenizer", F.lit("byte_bpe_50k")))
    token_rollups.commit_batch(root, 1, token_rollups.changes(pieces, "insert"))
    token_rollups.commit_batch(root, 2, token_rollups.changes(plain, "insert"))
    token_rollups.commit_batch(root, 3, token_rollups.changes(marked, "revise"))
    token_rollups.commit_batch(root, 4, token_rollups.changes(both, "delete"))
    token_rollups.commit_batch(root, 3, token_rollups.changes(marked, "revise"))
    return token_rollups.totals(spark, root)


@query
def op10_licenses(spark, folder):
    return licenses.scan_licenses(table(spark, folder, "documents"))


@query
def op11_vector_codes(spark, folder):
    codes = vector_codes.compress(table(spark, folder, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@query
def op12_hard_negatives(spark, folder):
    return hard_negatives.mine(table(spark, folder, "embeddings"))


@query
def op13_mixing(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


WORDS_SQL = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_ORACLES["op1_decontamination"] = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS k, least(len(w), 10) AS n
       FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM d, (SELECT DISTINCT n FROM bw), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (k, n)),
nh AS (SELECT doc_id, count(DISTINCT p) AS n_hit
       FROM hit, LATERAL (SELECT unnest(range(i, i + n)) AS p) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)"""


def _reputation_sql() -> str:
    """The levels of ``url_reputation``, spelled out."""
    s = url_reputation.Settings()
    hosting, exceptions = (", ".join(f"'{name}'" for name in names) for names in (url_reputation.HOSTING, url_reputation.EXCEPTIONS))
    special = f"(two IN ({hosting}) OR regexp_matches(two, '{url_reputation.SUFFIX_PATTERN}') AND two NOT IN ({exceptions}))"

    def strength(groups: str) -> str:
        return f"""(SELECT 1 / least(greatest(coalesce(
            (sum(pow(g - n * parent, 2) / n) - sum(parent * (1 - parent)))
              / nullif(sum(parent * (1 - parent) * (n - 1)), 0), 0),
            1 / (1 + {s.strongest})), 1 / (1 + {s.weakest})) - 1 AS s FROM {groups} WHERE n > 0)"""

    rules = sorted(url_reputation.RULES, key=lambda rule: -len(rule.text))
    fits = [
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{{}}'"
        for r in rules
    ]
    rule = "CASE " + " ".join(f.format(r.text) for f, r in zip(fits, rules)) + " END"
    verdict = "CASE " + " ".join(f.format(r.verdict) for f, r in zip(fits, rules))
    return rf"""
WITH split AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', ['h', 'p']) AS x FROM pages),
p AS (SELECT page_id, translate(x.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, x.p AS path FROM split),
good AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
outcome AS (SELECT host, good FROM p JOIN good ON doc_id = try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1), '') AS BIGINT)),
seen AS (SELECT host, count(good) AS n, sum(good) AS g FROM outcome GROUP BY host),
named AS (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM p),
parts AS (SELECT host, bare, array_to_string(string_split(bare, '.')[-2:], '.') AS two,
          array_to_string(string_split(bare, '.')[-3:], '.') AS three, regexp_matches(bare, '^[0-9.]+$|^\[') AS address FROM named),
h AS (SELECT host, CASE WHEN address THEN bare WHEN {special} THEN three ELSE two END AS domain,
      CASE WHEN address THEN bare WHEN {special} THEN two ELSE string_split(bare, '.')[-1] END AS suffix,
      coalesce(n, 0) AS n, coalesce(g, 0) AS g FROM parts LEFT JOIN seen USING (host)),
d AS (SELECT domain, min(suffix) AS suffix, sum(n) AS n, sum(g) AS g FROM h GROUP BY domain),
s0 AS (SELECT suffix, sum(n) AS n, sum(g) AS g FROM d GROUP BY suffix),
s1 AS (SELECT *, (SELECT (sum(g) + 1) / (sum(n) + 2) FROM s0) AS parent FROM s0),
s2 AS (SELECT suffix, (g + s * parent) / (n + s) AS parent FROM s1, {strength('s1')}),
d1 AS (SELECT * FROM d JOIN s2 USING (suffix)),
d2 AS (SELECT domain, (g + s * parent) / (n + s) AS parent FROM d1, {strength('d1')}),
h1 AS (SELECT * FROM h JOIN d2 USING (domain)),
h2 AS (SELECT host, n, s, (g + s * parent) / (n + s) AS mean FROM h1, {strength('h1')}),
r AS (SELECT host, n, mean - {s.deviations} * sqrt(mean * (1 - mean) / (n + s + 1)) AS bound FROM h2)
SELECT page_id, host, path, {rule} AS rule,
       {verdict} ELSE CASE WHEN bound >= {s.least} THEN 'allow' ELSE 'block' END END AS verdict,
       CAST(n AS BIGINT) AS n_labelled
FROM p JOIN r USING (host)"""


_ORACLES["op6_url_reputation"] = _reputation_sql()


def _vector_codes_sql(rounds: int = 4) -> str:
    """Every distance of every part in every round: a full search."""
    apart = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT r, part, min(CAST(coalesce({apart}, 0) AS BIGINT) * 256 + entry) AS m FROM p JOIN book{k} c USING (part) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""mean{k} AS (
  SELECT part, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS x FROM (
    SELECT part, m % 256 AS entry, i, sum(x[i]) AS total, count(*) AS n
    FROM near{k} JOIN p USING (r, part), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY ALL) GROUP BY ALL),
book{k + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM book{k} c LEFT JOIN mean{k} m USING (part, entry))""")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS r, * FROM kept),
p AS MATERIALIZED (SELECT r, part, x[len(x) * part // 4 + 1 : len(x) * (part + 1) // 4] AS x FROM v, range(4) t(part)),
book0 AS MATERIALIZED (SELECT part, r AS entry, x FROM p WHERE r < 256),
{", ".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', m % 256), '' ORDER BY part) AS code, sum(m // 256) AS error FROM near{rounds} GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS d FROM book{rounds})
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       d AS codebooks_sha256
FROM v JOIN coded USING (r), digest"""


_ORACLES["op11_vector_codes"] = _vector_codes_sql()


_ORACLES["op12_hard_negatives"] = """
WITH r AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS slot
  FROM s WHERE same AND other <> r QUALIFY slot <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
       CAST(row_number() OVER (PARTITION BY p.r, slot ORDER BY n.score DESC, n.vec_id NULLS LAST) AS INTEGER) AS rank
FROM p JOIN s n ON n.r = p.r AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5"""
