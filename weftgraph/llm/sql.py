r"""DuckDB SQL for the rows of text operators, and side queries for the parts of others that SQL can express.

near-dedup and chat formatting are expressed whole. Of quality rules, url filters, mixing and fingerprints SQL has the
statistics, the rules, the targets and the edited texts; what they learn, draw or hash is held by tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import mixing, quality, simhash, urls
from .common import WORD, table


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base statistics of every document, and whether they rule it out."""
    counted = quality.statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.base_failed().alias("base_failed"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, and the rule that fits, of every page."""
    found = urls.found_in(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("row.page_id", "host", "path", "found.rule", F.col("found.verdict").alias("ruled"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and target of every source."""
    sources = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).sources
    name = F.when(F.col("src") != "n", F.substring("src", 2, 1 << 30))
    return sources.select(name.alias("source"), "source_size", F.round("target", 3).alias("target"))


def _edited(doc_id, text: str, following: str) -> tuple:
    return doc_id, len(text), simhash.edited_text(text, following)[1]


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of every document, and the hash of its text with the last third replaced from the next one."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return simhash.with_next(docs, _edited, T._parse_datatype_string("doc_id long, n_chars long, edited_sha256 string"))


_NEAR = f"""
WITH RECURSIVE W AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '{WORD}') AS w FROM documents),
S AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM W),
N AS (SELECT doc_id, count(*) AS n FROM S GROUP BY doc_id),
P AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM S x JOIN S y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
L AS (SELECT a, b FROM P JOIN N x ON x.doc_id = a JOIN N y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
E AS (SELECT a, b FROM L UNION ALL SELECT b, a FROM L),
R AS (SELECT a AS node, a AS top FROM E UNION SELECT E.b, R.top FROM R JOIN E ON E.a = R.node),
C AS (SELECT node, min(top) AS top FROM R GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(top, d.doc_id) AS component_id, coalesce(top, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN N USING (doc_id) LEFT JOIN C ON C.node = d.doc_id
"""

_CHAT = r"""
WITH T AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, CASE WHEN k = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(k)),
B AS (SELECT *, replace(replace(text, '</turn>', '<\/turn>'), '### ', '#\## ') AS broken, replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ') AS strict,
  CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System'
    ELSE '@' || replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## '), ':', '\:') END AS head FROM T),
F AS (SELECT *, CASE WHEN NOT contains(text, '</turn>') AND NOT contains(text, '### ') AND regexp_replace(text, '\\([\\/#:])', '\1', 'g') = text THEN text
  WHEN NOT contains(broken, '</turn>') AND NOT contains(broken, '### ') AND regexp_replace(broken, '\\([\\/#:])', '\1', 'g') = text THEN broken ELSE strict END AS body FROM B)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length('### ' || head || ': ' || body || '</turn>') + 1) AS BIGINT) AS formatted_chars FROM F GROUP BY conv_id
"""

_STATISTICS = f"""
WITH W AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
X AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM W),
G AS (SELECT doc_id, i, (x, lead(x) OVER k, lead(x, 2) OVER k) AS g, lead(x, 2) OVER k AS last FROM X WINDOW k AS (PARTITION BY doc_id ORDER BY i)),
A AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM G WHERE last IS NOT NULL) WHERE n > 1),
V AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS i FROM A, range(3) r(k)) GROUP BY doc_id),
L AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM W) WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id),
R AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(L.n, 0) AS n_dup_lines, coalesce(V.n, 0) AS n_repeat_words FROM W LEFT JOIN L USING (doc_id) LEFT JOIN V USING (doc_id))
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM R
"""

_RULES = r"""
WITH H AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
R(rule, name, start, ruled) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
M AS (SELECT page_id, max_by((rule, ruled), length(rule)) AS m FROM H, R WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id)
SELECT page_id, host, path, m[1] AS rule, m[2] AS ruled FROM H LEFT JOIN M USING (page_id)
"""

_TARGETS = f"""
WITH S AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{WORD}'))) AS BIGINT) AS source_size FROM documents GROUP BY source),
K AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM S),
O AS (SELECT *, sum(3 * source_size) OVER k AS capped, sum(weight) OVER k AS light, sum(source_size) OVER () AS whole, sum(weight) OVER () AS weights
  FROM K WINDOW k AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
-- a source is full if, with all fuller ones at three times their size, its share of the rest is over three times its own
F AS (SELECT *, (whole - (capped - 3 * source_size)) * weight / (weights - (light - weight)) > 3 * source_size AS is_full FROM O),
B AS (SELECT max(whole) - coalesce(sum(3 * source_size) FILTER (is_full), 0) AS rest, sum(weight) FILTER (NOT is_full) AS open FROM F)
SELECT source, source_size, round(CASE WHEN is_full THEN 3 * source_size ELSE rest * weight / open END::DOUBLE, 3) AS target FROM F, B
"""

_EDITED = """
WITH D AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(text) OVER k, CASE WHEN doc_id = min(doc_id) OVER () THEN first_value(text) OVER k END, '') AS f FROM documents WINDOW k AS (ORDER BY doc_id DESC))
SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - length(t) // 3) || left(f, length(t) // 3)) AS edited_sha256 FROM D
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"quality_statistics": quality_statistics, "url_rules": url_rules, "mix_targets": mix_targets, "edited_texts": edited_texts}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": _NEAR, "op3_chat_format": _CHAT, "quality_statistics": _STATISTICS, "url_rules": _RULES, "mix_targets": _TARGETS, "edited_texts": _EDITED}
