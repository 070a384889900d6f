"""DuckDB SQL for the operators that SQL can express over whole tables."""

QUALITY_RULES = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), p AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM p
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM g WHERE c > 1) GROUP BY doc_id
), m AS (
  SELECT w.doc_id,
         len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines,
         len(list_filter(ws, lambda x: lower(x) IN (
           'the','of','and','to','in','is','that','for','it','with','as','on','be','by','this','are','was','from','at','or',
           'der','die','und','das','nicht','ist','den','von','zu','mit','auf','ein','eine','als',
           'le','la','les','de','des','du','et','un','une','est','pour','que','dans','par','pas','sur','qui','en',
           'el','los','las','y','se','del','por','con','para','lo','su','al')))::BIGINT AS n_stop_words
  FROM w LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m
)
SELECT *,
       (NOT base_failed
        AND 100 * word_chars BETWEEN 200 * n_words AND 1500 * n_words
        AND 100 * n_symbols <= 30 * n_words
        AND 100 * n_stop_words >= 4 * n_words
        AND 100 * n_dup_lines <= 40 * n_lines) AS kept
FROM b
"""

DECONTAMINATE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL
), bg AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i
        FROM bw WHERE len(ws) > 0)
), dp AS (
  SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
  FROM dw, (SELECT DISTINCT n FROM bg) WHERE len(ws) >= n
), hits AS (
  SELECT dp.doc_id, dp.i, dp.n, bg.item_id FROM dp JOIN bg ON bg.n = dp.n AND bg.g = array_to_string(dp.ws[dp.i:dp.i + dp.n - 1], ' ')
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), it AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits GROUP BY doc_id
), j AS (
  SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
         coalesce(len(items), 0)::BIGINT AS n_items,
         sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256
  FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
)
SELECT *, (n_hit > 0 AND 20 * n_hit >= n_words) AS contaminated FROM j
"""

SUBSTRING_DEDUP = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM p
), g AS (
  SELECT doc_id, list(DISTINCT q) AS gone
  FROM (SELECT doc_id, unnest(range(i, i + 20)) AS q FROM r WHERE k > 1) GROUP BY doc_id
), k AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY q) AS kept
  FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS q FROM d)
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id AS gd, unnest(gone) AS gq FROM g) WHERE gd = doc_id AND gq = q)
  GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""

MINHASH = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 3], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), u AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r(node, seen) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT u.y, r.seen FROM r JOIN u ON u.x = r.node
), c AS (
  SELECT node, min(seen) AS component_id FROM r GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON c.node = d.doc_id LEFT JOIN n USING (doc_id)
"""

FILTER_AUDIT = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part,
         (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > first_id, FALSE)::INT AS mask,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
), v AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM v a, v b, v c, v d, v e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step - 1]) AS before
  FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)
), r AS (
  SELECT part, filter_order, step::INT AS step, bit,
         sum(CASE WHEN mask & (coalesce(before, 0)::BIGINT | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0)::BIGINT = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0)::BIGINT > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0)::BIGINT = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0)::BIGINT = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM r
"""

LEXICAL_SEARCH = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents WHERE text IS NOT NULL
), q AS (
  SELECT item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ts
  FROM benchmark WHERE text IS NOT NULL
), s AS (
  SELECT count(*) AS n_docs, sum(len(ws)) AS n_terms FROM d WHERE len(ws) > 0
), p AS (
  SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d
), tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, n_docs
), i AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs::BIGINT) // n_terms::BIGINT))) AS impact
  FROM tf JOIN w USING (term), s
), r AS (
  SELECT item_id, doc_id, sum(impact)::BIGINT AS score
  FROM (SELECT item_id, unnest(ts) AS term FROM q) JOIN i USING (term) GROUP BY item_id, doc_id HAVING sum(impact) > 0
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM r QUALIFY rank <= 50
"""

ORACLES = {
    "op12_lexical_search": LEXICAL_SEARCH,
    "op13_filter_audit": FILTER_AUDIT,
    "op6_minhash": MINHASH,
    "op5_substring_dedup": SUBSTRING_DEDUP,
    "op3_quality_rules": QUALITY_RULES,
    "op9_decontaminate": DECONTAMINATE,
}
