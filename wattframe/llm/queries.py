"""The registered queries of this package and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.llm import (
    clustering,
    fingerprints,
    language,
    lines,
    mixing,
    packing,
    pieces,
    quality,
    resampling,
    simhash,
    suffixes,
    topk,
    warc,
)
from wattframe.llm.common import held_out, table
from wattframe.session import tune

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(tune(spark), sf_dir, "documents")


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_documents(spark, sf_dir))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(tune(spark), sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op4_language_by_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return language.identify(docs, language.train(docs))


def op5_pack_shortest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op6_impact_ordered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(tune(spark), sf_dir, "embeddings")
    return topk.top_inner_products(rows, "vec_id", "embedding", F.col("vec_id") % 100 == 0)


def op7_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(_documents(spark, sf_dir)).drop("kept")


def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return done.select("doc_id", "n_lines", "n_equal", "n_near", digest.alias("kept_sha256"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_subvector_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(tune(spark), sf_dir, "embeddings"))


def op13_sentencepiece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECES)
    done = pieces.decode(pieces.encode(_documents(spark, sf_dir), path), path)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
        "agrees",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_syncmer_fingerprints,
        op2_mix_sources,
        op3_warc_members,
        op4_language_by_ppm,
        op5_pack_shortest_first,
        op6_impact_ordered_topk,
        op7_quality_ftrl,
        op8_suffix_dedup,
        op9_simhash_golay,
        op10_line_dedup,
        op11_importance_resampling,
        op12_subvector_kmeans,
        op13_sentencepiece_agenda,
    )
}

_MIX = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS key
    FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT *, ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w,
        (2 * source_size)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5 AS budget FROM sources),
filled AS (
    SELECT *, sum(cap) OVER o AS caps, sum(w) OVER o AS ws, sum(w) OVER () AS whole FROM weighed
    WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
judged AS (SELECT *, caps + (cap / w) * (whole - ws) <= budget AS filled FROM filled),
level AS (
    SELECT (max(budget) - sum(CASE WHEN filled THEN cap ELSE 0 END))
        / nullif(sum(CASE WHEN filled THEN 0 ELSE w END), 0) AS level FROM judged),
targets AS (
    SELECT source, source_size, CASE WHEN filled THEN cap ELSE least(w * coalesce(level, 0), cap) END AS target
    FROM judged, level),
placed AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
        sum(s.size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - s.size AS begins
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    CASE WHEN source_size = 0 THEN 0
        ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - begins)) END::BIGINT AS taken
FROM placed"""

_WARC = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
d AS (
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + (((('0x' || substr(x, 1 + (5 * i // 4)::INT, 2))::INT) >> (3 - (5 * i) % 4)::INT) & 31), 1)), '') AS payload_digest
    FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS largest FROM d)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM largest THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM m"""

_TOPK = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.v, r.v)::BIGINT AS score
    FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v) WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10"""

_SUFFIXES = """
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT r, p, hash(substr(x, 2 * p + 1, 400)) AS h FROM (SELECT r, x, unnest(range(0, n - 199)) AS p FROM d)),
hit AS (
    SELECT r, p, p > coalesce(lag(p) OVER (PARTITION BY r ORDER BY p) + 200, -1) AS opens
    FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
part AS (SELECT r, p, sum(opens::INT) OVER (PARTITION BY r ORDER BY p) AS k FROM hit),
span AS (SELECT r, min(p) AS s, max(p) + 200 AS e FROM part GROUP BY r, k),
gap AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS f FROM span),
cut AS (
    SELECT d.r, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last,
        string_agg(substr(x, 2 * f + 1, 2 * (s - f)), '' ORDER BY s) AS kept
    FROM gap JOIN d ON gap.r = d.r GROUP BY d.r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept || substr(x, 2 * last + 1), x))) AS kept_sha256
FROM d LEFT JOIN cut ON d.r = cut.r"""

_RESAMPLING = r"""
WITH words AS (
    SELECT rowid_ AS r, unnest(regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
    FROM (SELECT text, 'd' || row_number() OVER () AS rowid_ FROM documents
        UNION ALL SELECT text, 'b' || row_number() OVER () FROM benchmark)),
crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8),
        lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
vocabulary AS (
    SELECT w, xor(list_reduce(
        list_transform(range(strlen(w)), lambda j: ('0x' || substr(hex(encode(w)), 2 * j::INT + 1, 2))::BIGINT),
        lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), 4294967295), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT w FROM words), crc),
held AS (SELECT r, bucket, count(*) AS n FROM words JOIN vocabulary USING (w) GROUP BY ALL),
counts AS (
    SELECT bucket, sum(n) FILTER (r[1] = 'd') AS s, sum(n) FILTER (r[1] = 'b') AS t FROM held GROUP BY bucket),
every AS (
    SELECT bucket, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t
    FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN counts USING (bucket)),
gains AS (
    SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain
    FROM every),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM held JOIN gains USING (bucket) GROUP BY r),
scored AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((
            ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM (SELECT doc_id, 'd' || row_number() OVER () AS r FROM documents) LEFT JOIN weights USING (r)),
ranked AS (
    SELECT *, n_features >= 20 AS able,
        row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
    CASE WHEN able AND place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank
FROM ranked"""


def _kmeans(rounds: int = 10) -> str:
    """A round is one table of assigned vectors and one of moved centroids."""
    near = """
a{i} AS MATERIALIZED (
    SELECT r, min_by(c, (d, c)) AS c, min(d) AS d FROM (
        SELECT r, c, list_sum(list_transform(list_zip(x.v, y.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM x, c{i} y) GROUP BY r),"""
    move = """
s{i} AS (
    SELECT c, p, sum(e)::BIGINT AS s, count(*) AS n
    FROM (SELECT c, unnest(v) AS e, unnest(range(64)) AS p FROM a{i} JOIN x USING (r)) GROUP BY c, p),
m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS v FROM s{i} GROUP BY c),
c{j} AS MATERIALIZED (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c)),"""
    steps = "".join(near.format(i=i) + move.format(i=i, j=i + 1) for i in range(rounds)) + near.format(i=rounds)
    return f"""
WITH x AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM x
    QUALIFY c < 8),{steps}
f AS (SELECT c, array_to_string(v, ',') AS centroid FROM c{rounds})
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
    sum(d) OVER ()::BIGINT AS inertia, sha256(centroid) AS centroid_sha256
FROM a{rounds} JOIN x USING (r) JOIN f USING (c)"""


ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": _MIX,
    "op3_warc_members": _WARC,
    "op6_impact_ordered_topk": _TOPK,
    "op8_suffix_dedup": _SUFFIXES,
    "op11_importance_resampling": _RESAMPLING,
    "op12_subvector_kmeans": _kmeans(),
}
