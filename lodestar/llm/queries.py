"""The numbered queries of this subpackage and SQL for those that SQL can express."""

from __future__ import annotations

from lodestar.llm.alignment import op13_cross_tokenizer_alignment
from lodestar.llm.decontaminate import op9_benchmark_decontamination
from lodestar.llm.hmm import op2_hmm_language_model
from lodestar.llm.langid import op6_language_id
from lodestar.llm.mixing import op7_source_mixing
from lodestar.llm.packed import op11_packed_token_ids
from lodestar.llm.pii import op4_pii_spans
from lodestar.llm.secrets import op1_secret_scan
from lodestar.llm.simhash import op8_simhash_near_dedup
from lodestar.llm.substrings import op5_substring_dedup
from lodestar.llm.syncmers import op10_document_fingerprints
from lodestar.llm.urls import op3_url_filters
from lodestar.llm.whitening import op12_embedding_whitening

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_hmm_language_model": op2_hmm_language_model,
    "op3_url_filters": op3_url_filters,
    "op4_pii_spans": op4_pii_spans,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_language_id": op6_language_id,
    "op7_source_mixing": op7_source_mixing,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_document_fingerprints": op10_document_fingerprints,
    "op11_packed_token_ids": op11_packed_token_ids,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}
WORDS = r"list_filter(string_split_regex({x}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {WORDS.format(x="coalesce(text, '')")} AS l FROM documents),
p AS (SELECT doc_id, l, unnest(range(1, len(l) - 33)) AS i FROM w WHERE len(l) >= 35),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY md5(array_to_string(l[i:i + 34], ' '))) AS n FROM p),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS place FROM r WHERE n > 1),
each AS (SELECT doc_id, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS place FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS s FROM each ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT w.doc_id, len(l) AS n_words, len(l) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {WORDS.format(x="lower(coalesce(text, ''))")} AS w FROM documents),
b AS (SELECT item_id, {WORDS.format(x="lower(coalesce(text, ''))")} AS v FROM benchmark),
masks(m, o) AS (VALUES (0, [0, 1, 2, 3, 4, 5]), (1, [0, 2, 3, 5, 7, 8]), (2, [0, 1, 4, 6, 7, 9]), (3, [0]), (4, [0, 1]), (5, [0, 1, 2]), (6, [0, 1, 2, 3]), (7, [0, 1, 2, 3, 4])),
bs AS (SELECT item_id, q, m, q + o[-1] + 1 AS until, array_to_string(list_transform(o, lambda x: v[q + x + 1]), ' ') AS s FROM (SELECT item_id, v, unnest(range(len(v))) AS q FROM b), masks
  WHERE q + o[-1] < len(v) AND CASE WHEN len(v) < 6 THEN q = 0 AND m = len(v) + 2 ELSE m < 3 OR m = 5 AND q % 3 = 0 AND len(v) * 0.8 <= 10 END),
ds AS (SELECT doc_id, p, m, array_to_string(list_transform(o, lambda x: w[p + x + 1]), ' ') AS s FROM (SELECT doc_id, w, unnest(range(len(w))) AS p FROM d), masks WHERE p + o[-1] < len(w) AND m IN (SELECT m FROM bs)),
h AS (SELECT doc_id, item_id, p - q AS shift, min(q) AS low, max(until) AS high FROM ds JOIN bs ON ds.m = bs.m AND ds.s = bs.s GROUP BY ALL),
c AS (SELECT h.*, len(v) AS length, len(list_filter(range(low, high), lambda i: v[i + 1] = w[i + shift + 1])) AS matched FROM h JOIN d USING (doc_id) JOIN b USING (item_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, high - low, low + shift, low) AS n FROM c WHERE matched >= least(10, length) AND matched >= 0.8 * (high - low))
SELECT doc_id, item_id, matched, high - low AS compared, low + shift AS start, low AS item_start FROM g WHERE n = 1"""

ORACLES: dict[str, str] = {
    "op5_substring_dedup": SUBSTRINGS,
    "op9_benchmark_decontamination": DECONTAMINATION,
}
