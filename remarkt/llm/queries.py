"""One query for each operator: its production parameters over whole tables, and the digest columns of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import alignment_report
from .byte_cnn import language_report
from .chosen_path import near_duplicates
from .compression import compression_rules
from .histogram_sort import shard_report
from .hmm import language_model_report
from .latent_votes import quality_report
from .licenses import license_report
from .nnls_packing import packing_report
from .ranked_search import search
from .sanitise import personal_data_report
from .suffix_leaks import leak_report
from .warc import archive_report


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(table(spark, sf_dir, "documents"))


def op2_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(table(spark, sf_dir, "documents"))


def op3_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffix_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules(table(spark, sf_dir, "documents"))


def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_report(table(spark, sf_dir, "documents"))


def op9_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_report(table(spark, sf_dir, "documents"))


def op10_latent_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_report(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_histogram_sort, op2_nnls_packing, op3_chosen_path, op4_suffix_leaks, op5_compression, op6_byte_cnn, op7_licenses, op8_hmm, op9_sanitise, op10_latent_votes, op11_alignment, op12_ranked_search, op13_warc)
    return {f.__name__: f for f in own}


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)), l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.other = l.x), c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id"""

LEAKS_SQL = f"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + 9], ' ') AS g FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k) WHERE len(w) > 0),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM iw) AS z, unnest(range(1, len(w) - n + 2)) AS t(k) WHERE len(w) >= n),
m AS (SELECT dw.doc_id, k, dw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n), h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(k, k + n)) AS t(p) GROUP BY doc_id),
il AS (SELECT CAST(item_id AS VARCHAR) AS item, k AS j, least(10, len(w)) AS n, array_to_string(w[k:k + 9], ' ') AS g FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k) WHERE len(w) > 0),
ml AS (SELECT doc_id, item, dw.n, k, k - j AS diagonal, k - row_number() OVER (PARTITION BY doc_id, item, dw.n, k - j ORDER BY k) AS run FROM dw JOIN il ON dw.g = il.g AND dw.n = il.n),
lm AS (SELECT doc_id, item, min(k) AS k, min(k) - diagonal AS j, count(*) + n - 1 AS n FROM ml GROUP BY doc_id, item, n, diagonal, run),
top AS (SELECT * FROM lm QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k, item, j) = 1),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
coalesce(top.n, 0) AS longest_match, coalesce(top.k - 1, 0) AS longest_at, item AS longest_item, j - 1 AS longest_item_at FROM d LEFT JOIN top ON top.doc_id = d.doc_id LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN o ON o.doc_id = d.doc_id"""

SEARCH_SQL = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d), c AS (SELECT row, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
s AS (SELECT count(*) AS nn, sum(len(w)) AS l FROM d WHERE len(w) > 0), f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
x AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, s),
p AS (SELECT item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // l)))) AS BIGINT) AS score FROM q JOIN c ON q.term = c.term JOIN x ON x.term = q.term, s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0 QUALIFY rank <= 20"""

ARCHIVE_SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM f"""


def oracle_sql() -> dict[str, str]:
    """Of those that SQL can express. The others learn, iterate, compress or choose among many right results; tests/llm holds each against a brute-force version."""
    return {"op3_chosen_path": NEAR_SQL, "op4_suffix_leaks": LEAKS_SQL, "op12_ranked_search": SEARCH_SQL, "op13_warc": ARCHIVE_SQL}
