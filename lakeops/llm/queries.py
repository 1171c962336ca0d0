"""The registered queries of the operators and their SQL checks."""

from __future__ import annotations

from lakeops.llm import (
    bpe,
    burst_trie,
    decontaminate,
    exact_index,
    licenses,
    lines,
    minhash,
    pii,
    pll,
    suffixes,
    toxicity,
    trie_bpe,
    whitening,
)

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({WORDS.format("text")}, []) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS.format("text")} AS w FROM benchmark
      WHERE text IS NOT NULL AND item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, m, array_to_string(w[k : k + m - 1], ' ') AS win
       FROM (SELECT item, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k
             FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, s.m, k, array_to_string(w[k : k + s.m - 1], ' ') AS win
       FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d) p, (SELECT DISTINCT m FROM iw) s
       WHERE k + s.m - 1 <= len(w)),
hits AS (SELECT doc_id, dw.m, k, iw.item FROM dw JOIN iw ON dw.m = iw.m AND dw.win = iw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS found FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(found), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(found, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS raw
           FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
t AS (SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
d AS (SELECT line, length(line) AS n, min({'doc_id': doc_id, 'line_no': line_no}) AS place
      FROM t WHERE length(line) >= 20 GROUP BY line),
v AS (SELECT line, place, i, hash(substr(line, 1, i - 1) || substr(line, i + 1)) AS k, n - 1 AS m
      FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM d)),
near AS (SELECT v.line FROM v JOIN (SELECT k, i, m, min(place) AS p FROM v GROUP BY ALL) f USING (k, i, m) WHERE p < place
         UNION SELECT v.line FROM v JOIN d ON hash(d.line) = v.k AND d.n = v.m WHERE d.place < v.place
         UNION SELECT d.line FROM v JOIN d ON hash(d.line) = v.k AND d.n = v.m WHERE v.place < d.place),
s AS (SELECT t.*, length(t.line) < 20 OR (d.place = {'doc_id': doc_id, 'line_no': line_no}
             AND t.line NOT IN (SELECT line FROM near)) AS stays
      FROM t LEFT JOIN d USING (line)),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
             coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (stays), '') AS text
      FROM s GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(g.text, '')) AS text_sha256
FROM documents LEFT JOIN g USING (doc_id)
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
           FROM documents),
w AS (SELECT *, first_value(doc_id) OVER g AS keep_id, first_value(n) OVER g AS keep_n,
             count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND n = keep_n AS kept, text_sha256 FROM w
"""


def op5_exact_dedup(spark, sf_dir: str):
    return exact_index.exact_dedup(exact_index.table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontamination": (decontaminate.op1_decontamination, OP1_SQL),
    "op2_toxicity": (toxicity.op2_toxicity, None),
    "op3_lm_scoring": (pll.op3_lm_scoring, None),
    "op4_line_dedup": (lines.op4_line_dedup, OP4_SQL),
    "op5_exact_dedup": (op5_exact_dedup, OP5_SQL),
    "op6_byte_bpe": (bpe.op6_byte_bpe, None),
    "op7_personal_data": (pii.op7_personal_data, None),
    "op8_license_scan": (licenses.op8_license_scan, licenses.op8_sql()),
    "op9_repeated_passages": (suffixes.op9_repeated_passages, None),
    "op10_near_dedup": (minhash.op10_near_dedup, None),
    "op11_embedding_whitening": (whitening.op11_embedding_whitening, None),
    "op12_trie_bpe": (trie_bpe.op12_trie_bpe, None),
    "op13_conversation_trie": (burst_trie.op13_conversation_trie, burst_trie.OP13_SQL),
}


def queries() -> dict:
    return {name: build for name, (build, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
