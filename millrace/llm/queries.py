"""The registered queries of the subpackage, with production parameters, over whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from .clusters import clusters
from .codes import vector_codes
from .common import Scratch, drop_folder, shared_dir, table
from .decontamination import contaminated
from .jaccard import jaccard_components
from .language import languages
from .line_dedup import dedup_lines
from .lm import lm_scores
from .packing import pack
from .quality import quality
from .token_counts import token_counts
from .topk import top_k
from .toxicity import toxicity
from . import wavelet

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark, d):
    return toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op2_quality(spark, d):
    return quality(table(spark, d, "documents"), table(spark, d, "labels"))


def op3_lm_scores(spark, d):
    return lm_scores(table(spark, d, "documents"))


def op4_token_counts(spark, d):
    return token_counts(table(spark, d, "documents"), BYTE_BPE)


def op5_top_k(spark, d):
    return top_k(table(spark, d, "embeddings"))


def op6_decontamination(spark, d):
    return contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op7_language(spark, d):
    return languages(table(spark, d, "documents"))


def op8_line_dedup(spark, d):
    return dedup_lines(table(spark, d, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op9_jaccard_join(spark, d):
    return jaccard_components(table(spark, d, "documents"), words=3, num=90, den=100)


def op10_packing(spark, d):
    pieces = pack(table(spark, d, "documents"), WORD_BPE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_token_ids(spark, d):
    folder = wavelet.write_ids(table(spark, d, "documents"), BYTE_BPE, f"{shared_dir(spark)}/millrace-ids-{uuid.uuid4().hex}")
    found = Scratch(spark).stored(wavelet.documents(spark, folder))
    drop_folder(spark, folder)
    return wavelet.with_starts(found).select("doc_id", "start", "n_tokens", "ids_crc32")


def op12_vector_codes(spark, d):
    return vector_codes(table(spark, d, "embeddings"))


def op13_clusters(spark, d):
    return clusters(table(spark, d, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality, op3_lm_scores, op4_token_counts, op5_top_k, op6_decontamination, op7_language, op8_line_dedup, op9_jaccard_join, op10_packing, op11_token_ids, op12_vector_codes, op13_clusters)}


def _integers_sql(scale: int) -> str:
    """(vec_id, label, v): integer vectors of the rows that take part."""
    return f"""SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0"""


def _square_sql(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"


#: The floor of the mean of x, exactly.
_MEAN_SQL = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"


def _codes_sql() -> str:
    """Codebooks by round: r0 the first ones, aN the nearest entries, rN what they become."""
    steps = [
        f"v AS MATERIALIZED ({_integers_sql(256)})",
        "s AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS s FROM v, range(16) t(p))",
        "f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v QUALIFY e < 64)",
        "r0 AS MATERIALIZED (SELECT p, e, s AS c FROM s JOIN f ON s.vec_id = f.vec_id)",
    ]
    for n in range(3):
        steps.append(f"a{n} AS MATERIALIZED (SELECT vec_id, label, s.p, any_value(s) AS s, min({{'d': {_square_sql('s', 'c')}, 'e': e}}) AS m FROM s JOIN r{n} r ON s.p = r.p GROUP BY vec_id, label, s.p)")
        if n < 2:
            steps.append(f"u{n} AS (SELECT p, e, list(x ORDER BY i) AS c FROM (SELECT p, m.e AS e, i, {_MEAN_SQL} AS x FROM (SELECT p, m, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM a{n}) GROUP BY p, m.e, i) GROUP BY p, e)")
            steps.append(f"r{n + 1} AS MATERIALIZED (SELECT r.p, r.e, coalesce(u.c, r.c) AS c FROM r{n} r LEFT JOIN u{n} u ON u.p = r.p AND u.e = r.e)")
    steps.append("b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS sha FROM r2)")
    steps.append("k AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY vec_id)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM k, b"


def _clusters_sql() -> str:
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, v FROM ({_integers_sql(1024)}) WHERE len(v) = 64)",
        "r0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v AS m FROM v QUALIFY c < 8)",
    ]
    for n in range(11):
        steps.append(f"a{n} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min({{'d': {_square_sql('v', 'm')}, 'c': c}}) AS b FROM v, r{n} GROUP BY vec_id)")
        if n < 10:
            steps.append(f"u{n} AS (SELECT c, list(x ORDER BY i) AS m FROM (SELECT b.c AS c, i, {_MEAN_SQL} AS x FROM (SELECT b, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY b.c, i) GROUP BY c)")
            steps.append(f"r{n + 1} AS MATERIALIZED (SELECT r.c, coalesce(u.m, r.m) AS m FROM r{n} r LEFT JOIN u{n} u ON u.c = r.c)")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a10 JOIN r10 ON r10.c = b.c"""


ORACLES: dict[str, str] = {
    "op12_vector_codes": _codes_sql(),
    "op13_clusters": _clusters_sql(),
    "op5_top_k": """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5""",
    "op9_jaccard_join": r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
reach(doc_id, other) AS (SELECT x, y FROM links UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other),
least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.other, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id""",
}
