"""The queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from .common import table
from .exact_dedup import exact_dedup
from .fm_decontam import contamination
from .html_extract import html_extract
from .huffman_ids import encode_documents
from .jaccard_join import similar_components
from .langid import language
from .lexical_search import search
from .periodic_runs import digests, periodic_runs, with_repeats
from .quality import quality
from .quality_rules import quality_rules
from .sentencepiece_viterbi import encode_decode
from .sharding import shard
from .suffix_dedup import remove_repeats

#: Vocabulary files of public tokenizers.
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_token_ids(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op3_sentencepiece(spark, sf_dir):
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op4_html_extract(spark, sf_dir):
    return html_extract(table(spark, sf_dir, "pages"))


def op5_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language(spark, sf_dir):
    return language(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op7_jaccard_join(spark, sf_dir):
    return similar_components(table(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("starts", "ends")


def op9_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_sharding(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"))


def op11_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lexical_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark, sf_dir):
    return digests(periodic_runs(with_repeats(table(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_ids": op2_token_ids,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_html_extract": op4_html_extract,
    "op5_quality": op5_quality,
    "op6_language": op6_language,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_decontamination": op8_decontamination,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_sharding": op10_sharding,
    "op11_quality_rules": op11_quality_rules,
    "op12_lexical_search": op12_lexical_search,
    "op13_periodic_runs": op13_periodic_runs,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op7_jaccard_join": rf"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[p : p + least(4, len(ws)) - 1], ' ') AS g
                           FROM w, unnest(range(1, len(ws) - least(4, len(ws)) + 2)) t(p) WHERE len(ws) > 0),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
        r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
        SELECT r.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY 1
    """,
    "op8_decontamination": rf"""
        WITH w AS MATERIALIZED (SELECT doc_id, {_ALNUM} AS ws FROM documents),
        b AS (SELECT item_id, {_ALNUM} AS ws FROM benchmark),
        i AS MATERIALIZED (SELECT DISTINCT item_id, least(13, len(ws)) AS k, array_to_string(ws[p : p + least(13, len(ws)) - 1], ' ') AS g
                           FROM b, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) t(p) WHERE len(ws) > 0),
        d AS (SELECT doc_id, k, p, array_to_string(ws[p : p + k - 1], ' ') AS g
              FROM w, (SELECT DISTINCT k FROM i) kinds, unnest(range(1, len(ws) - k + 2)) t(p)),
        h AS MATERIALIZED (SELECT doc_id, p, d.k, item_id FROM d JOIN i ON d.g = i.g AND d.k = i.k),
        x AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM h, unnest(range(p, p + k)) t(q) GROUP BY 1),
        y AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM h GROUP BY 1)
        SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM w LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
    """,
    # bytes as hexadecimal digits, so that a place is found without decoding
    "op9_suffix_dedup": r"""
        WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        w AS MATERIALIZED (SELECT doc_id, p, substr(x, CAST(2 * p + 1 AS BIGINT), 200) AS s FROM d, unnest(range(0, n - 99)) t(p)),
        f AS (SELECT s, min(row(doc_id, p)) AS one FROM w GROUP BY s HAVING count(*) > 1),
        r AS MATERIALIZED (SELECT w.doc_id, w.p FROM w JOIN f USING (s) WHERE row(w.doc_id, w.p) <> one),
        i AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS brk FROM r),
        j AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM i),
        g AS MATERIALIZED (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS z FROM j GROUP BY 1, 2),
        k AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM g UNION ALL SELECT doc_id, max(z), CAST(NULL AS BIGINT) FROM g GROUP BY 1),
        y AS (SELECT k.doc_id, string_agg(substr(x, CAST(2 * lo + 1 AS BIGINT), CAST(2 * (coalesce(hi, n) - lo) AS BIGINT)), '' ORDER BY lo) AS kept FROM k JOIN d USING (doc_id) GROUP BY 1),
        c AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM g GROUP BY 1)
        SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN y USING (doc_id)
    """,
    "op12_lexical_search": rf"""
        WITH d AS MATERIALIZED (SELECT doc_id, {_ALNUM} AS ws FROM documents),
        s AS (SELECT count(*) AS docs, CAST(sum(len(ws)) AS BIGINT) AS terms FROM d WHERE len(ws) > 0),
        p AS MATERIALIZED (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS t FROM d) GROUP BY 1, 2, 3),
        w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY 1), s),
        q AS (SELECT DISTINCT item_id, unnest({_ALNUM}) AS t FROM benchmark),
        r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms))))) AS BIGINT) AS score
              FROM q JOIN p USING (t) JOIN w USING (t), s GROUP BY 1, 2)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM r WHERE score > 0 QUALIFY rank <= 10
    """,
    "op1_exact_dedup": r"""
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        WINDOW w AS (PARTITION BY body)
    """,
}
