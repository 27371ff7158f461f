"""The numbered operators as queries over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from loadproof.llm import bpe, decontaminate, html, jaccard, langid, licenses, minhash, pii, planes, secrets, topk, toxicity, whitening

QUERIES = {
    "op2_html_extraction": html.op2_html_extraction,
    "op4_language_id": langid.op4_language_id,
    "op7_pii_surrogates": pii.op7_pii_surrogates,
    "op1_license_scans": licenses.op1_license_scans,
    "op6_exact_top_k": topk.op6_exact_top_k,
    "op3_toxicity": toxicity.op3_toxicity,
    "op10_ngram_jaccard_join": jaccard.op10_ngram_jaccard_join,
    "op5_bpe_encoding": bpe.op5_bpe_encoding,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op8_secret_scans": secrets.op8_secret_scans,
    "op11_minhash_near_dedup": minhash.op11_minhash_near_dedup,
    "op12_centroid_clustering": planes.op12_centroid_clustering,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}



def _near_sql(need: int, more: str = "") -> str:
    """All pairs of distinct sets that share a shingle, and what links reach; for tables of a few thousand documents."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () r, doc_id, {words} w FROM documents),
t AS MATERIALIZED (SELECT w, min(r) r, min(doc_id) low FROM d WHERE len(w) > 0 GROUP BY w),
s AS MATERIALIZED (SELECT DISTINCT r, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) h FROM t),
n AS MATERIALIZED (SELECT r, count(*) n FROM s GROUP BY r),
p AS (SELECT a.r a, b.r b, count(*) c FROM s a JOIN s b ON a.h = b.h AND a.r < b.r GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= {need} * (x.n + y.n - c)),
g AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
q AS (SELECT r src, r dst FROM t UNION SELECT q.src, g.b FROM q JOIN g ON g.a = q.dst),
c AS (SELECT src r, min(low) least FROM q JOIN t ON t.r = q.dst GROUP BY src)
SELECT d.doc_id, coalesce(n.n, 0) n_shingles, coalesce(c.least, d.doc_id) component_id{more} FROM d LEFT JOIN t USING (w) LEFT JOIN n ON n.r = t.r LEFT JOIN c ON c.r = t.r"""


ORACLES = {
    "op10_ngram_jaccard_join": _near_sql(75),
    "op11_minhash_near_dedup": _near_sql(85, ", d.doc_id = coalesce(c.least, d.doc_id) kept"),
    "op1_license_scans": licenses.OP1_SQL,
    "op6_exact_top_k": topk.OP6_SQL,
    "op9_benchmark_decontamination": decontaminate.OP9_SQL,
    "op8_secret_scans": secrets.OP8_SQL,
    "op12_centroid_clustering": planes.OP12_SQL,
}
