"""Queries opN_<name>: each operator of this package over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bpe import token_digests
from quern.llm.decontaminate import find_items
from quern.llm.embedding_dedup import near_duplicate_embeddings
from quern.llm.html_text import extract_text
from quern.llm.line_dedup import dedup_lines
from quern.llm.ngram_join import ngram_groups
from quern.llm.passage_dedup import remove_passages
from quern.llm.shared import shared_path
from quern.llm.spelling import spelling_variants
from quern.llm.substring_dedup import remove_repeats
from quern.llm.token_files import read_token_files, write_token_files
from quern.llm.toxicity import score_toxicity
from quern.llm.url_filter import Rule, filter_urls
from quern.llm.whitening import whitened_components

URL_RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_embeddings(table(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), word_tokenizer())


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), word_tokenizer(), folder, end_id=1)
    return read_token_files(spark, folder)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that stays; null for a null text)."""
    clean = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, one row for each item."""
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings"))


def op12_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(table(spark, sf_dir, "documents")).drop("n_spans")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_embedding_dedup, op3_bpe, op4_token_files, op5_html_text, op6_url_filter, op7_line_dedup, op8_ngram_join, op9_substring_dedup, op10_decontamination,
        op11_whitening, op12_passage_dedup, op13_spelling_variants,
    )
}

_RULES_SQL = ", ".join(f"('{r.host}', '{r.path}', '{r.key}', '{r.verdict}')" for r in URL_RULES)

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
        FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op5_html_text": r"""
        WITH main AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*?)(</article>|<footer|$)', 1, 's') AS h FROM pages),
        plain AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM main),
        decoded AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&#x27;?', '''', 'g'), '&amp;?', '&', 'g') AS t FROM plain),
        words AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM decoded)
        SELECT page_id, url, text, length(text) AS n_chars FROM words""",
    "op6_url_filter": f"""
        WITH rules(h, p, k, v) AS (VALUES {_RULES_SQL}),
        parts AS (
            SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)
        SELECT page_id, host, path, k AS rule, coalesce(v, 'allow') AS verdict FROM (
            SELECT parts.*, k, v, row_number() OVER (PARTITION BY page_id ORDER BY length(k) DESC NULLS LAST, length(h) DESC) AS n
            FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        WHERE n = 1""",
    "op7_line_dedup": r"""
        WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
        every AS (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS pos FROM split),
        solid AS (SELECT doc_id, pos, l, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM every WHERE regexp_matches(l, '[^\t\n\x0B\f\r ]')),
        next AS (SELECT doc_id, pos, seq, l, lead(l) OVER (PARTITION BY doc_id ORDER BY seq) AS l2, lead(pos) OVER (PARTITION BY doc_id ORDER BY seq) AS pos2 FROM solid),
        ones AS (SELECT doc_id, pos, length(l) >= 40 AND row_number() OVER (PARTITION BY l ORDER BY doc_id, seq) > 1 AS again FROM next),
        twos AS (SELECT doc_id, pos, pos2, row_number() OVER (PARTITION BY l, l2 ORDER BY doc_id, seq) > 1 AS again FROM next WHERE l2 IS NOT NULL),
        gone AS (SELECT doc_id, pos FROM ones WHERE again UNION SELECT doc_id, pos FROM twos WHERE again UNION SELECT doc_id, pos2 FROM twos WHERE again),
        kept AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY pos) AS t FROM every ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n FROM solid GROUP BY doc_id), g AS (SELECT doc_id, count(*) AS g FROM gone GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(g, 0) AS n_removed, CASE WHEN text IS NOT NULL THEN sha256(coalesce(t, '')) END AS kept_sha256
        FROM documents LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)""",
    "op8_ngram_join": r"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
        runs AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS s FROM words),
        shingles AS (SELECT DISTINCT doc_id, unnest(s) AS s FROM runs),
        n AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 75 * (p.n + q.n - o)),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, least(documents.doc_id, coalesce(b, documents.doc_id)) AS component_id
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = documents.doc_id""",
    "op9_substring_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
        w AS (SELECT doc_id, i, t[i:i + 49] AS s FROM (SELECT doc_id, t, unnest(range(1, octet_length(t) - 48)) AS i FROM d WHERE octet_length(t) >= 50)),
        hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM w) WHERE m < doc_id),
        isles AS (SELECT doc_id, i, sum(CASE WHEN i <= p + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, lag(i, 1, -100) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM hits)),
        spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM isles GROUP BY doc_id, k),
        holes AS (SELECT doc_id, a, z, lag(z, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
        parts AS (SELECT doc_id, sum(z - a) AS n, count(*) AS k, string_agg(hex(t[before:a - 1]), '' ORDER BY a) AS kept, max(z) AS last FROM holes JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, octet_length(t) AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0) AS n_spans,
            CASE WHEN n IS NULL THEN sha256(t) ELSE sha256(unhex(kept || hex(t[last:]))) END AS kept_sha256 FROM d LEFT JOIN parts USING (doc_id)""",
    "op12_passage_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
        spots AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
        hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM spots) WHERE m < doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hits),
        every AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM every ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op13_spelling_variants": r"""
        WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
        runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
        each_one AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
        bytes AS (SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 | (unicode(c) >> 6))::BIGINT, (128 | (unicode(c) & 63))::BIGINT] END)) AS b FROM each_one),
        hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
        cut AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
        words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
        without AS (SELECT word, i, substring(word, 1, i - 1) AS a, substring(word, i + 1) AS z FROM places),
        pairs AS (
            SELECT x.word AS word, y.word AS other FROM without x JOIN without y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
            UNION SELECT x.word, y.word FROM without x JOIN words y ON x.a || x.z = y.word
            UNION SELECT y.word, x.word FROM without x JOIN words y ON x.a || x.z = y.word),
        ranked AS (SELECT pairs.word, other, n, row_number() OVER (PARTITION BY pairs.word ORDER BY n DESC, encode(other)) AS k, count(*) OVER (PARTITION BY pairs.word) AS n_near FROM pairs JOIN words ON words.word = other),
        best AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN ranked.n >= 10 * words.n THEN other END AS form, CASE WHEN ranked.n >= 10 * words.n THEN ranked.n END AS form_n
            FROM words LEFT JOIN ranked ON ranked.word = words.word AND k = 1),
        chain(word, root) AS (SELECT word, word FROM best UNION ALL SELECT chain.word, best.form FROM chain JOIN best ON best.word = chain.root WHERE best.form IS NOT NULL)
        SELECT best.word, best.form, chain.root, best.n, best.n_near, best.form_n FROM best JOIN chain ON chain.word = best.word JOIN best e ON e.word = chain.root AND e.form IS NULL""",
}
