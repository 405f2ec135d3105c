"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP1 = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT len(e) AS n FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1
), u AS (
  SELECT vec_id, e FROM v WHERE len(e) = (SELECT n FROM d)
), p AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e) AS score
  FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP3 = r"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), n AS (
  SELECT row_number() OVER () AS row, doc_id, source, len(w)::BIGINT AS n_words, w,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines
  FROM t
), g AS (
  SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM n WHERE len(w) >= 3)
), m AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, gram) AS c FROM g) WHERE c > 1
), r AS (
  SELECT row, count(DISTINCT j)::BIGINT AS n_repeat_words
  FROM (SELECT row, unnest([i, i + 1, i + 2]) AS j FROM m) GROUP BY row
), b AS (
  SELECT doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM n LEFT JOIN r USING (row)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
), h AS (
  SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INTEGER)::DOUBLE AS f FROM f GROUP BY source
), p AS (
  SELECT sum(f) / sum(n) AS p, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)) AS var FROM h
), s AS (
  SELECT p, least(greatest(CASE WHEN var > 1e-12 THEN p * (1 - p) / var - 1 ELSE 10000.0 END, 1.0), 10000.0) AS k FROM p
), v AS (
  SELECT source, (f + p * k) / (n + k) > 0.5 AS host_failed FROM h, s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 3 * source_size AS cap,
         [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::BIGINT AS weight FROM s
), o AS (
  SELECT *, sum(source_size) OVER () AS total, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w
), l AS (
  SELECT coalesce(arg_min((total - fixed)::DOUBLE / free::DOUBLE, k) FILTER (WHERE cap >= (total - fixed)::DOUBLE / free::DOUBLE * weight), 0) AS level FROM o
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target FROM w, l
), b AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget FROM t
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b
), x AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM x
"""

OP7 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM g GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
), k AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, t.doc_id) AS component_id, coalesce(component_id, t.doc_id) = t.doc_id AS kept
FROM t LEFT JOIN n ON t.doc_id = n.doc_id LEFT JOIN k ON t.doc_id = k.doc_id
"""

OP10 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), l AS (
  SELECT row, doc_id, text, unnest(range(1, len(lines) + 1)) AS k, unnest(lines) AS line FROM d
), p AS (
  SELECT row, doc_id, text, k, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line,
         row_number() OVER (PARTITION BY row ORDER BY k) AS i
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), q AS (
  SELECT *, count(*) OVER (PARTITION BY row) AS n, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS m FROM p
), w AS (
  SELECT row, doc_id, text, i, 1 AS size, line AS run FROM q WHERE n = 1 OR m >= 50
  UNION ALL
  SELECT a.row, a.doc_id, a.text, a.i, 2, a.line || chr(10) || b.line FROM q a JOIN q b ON a.row = b.row AND b.i = a.i + 1 WHERE a.n = 2 OR a.m + b.m >= 50
  UNION ALL
  SELECT a.row, a.doc_id, a.text, a.i, 3, a.line || chr(10) || b.line || chr(10) || c.line
  FROM p a JOIN p b ON a.row = b.row AND b.i = a.i + 1 JOIN p c ON a.row = c.row AND c.i = a.i + 2
), f AS (
  SELECT *, row_number() OVER (PARTITION BY size, run ORDER BY doc_id NULLS FIRST, text, i) AS nth FROM w
), g AS (
  SELECT DISTINCT p.row, p.k FROM f JOIN p ON f.row = p.row AND p.i BETWEEN f.i AND f.i + f.size - 1 WHERE f.nth > 1
), k AS (
  SELECT l.row, string_agg(l.line, chr(10) ORDER BY l.k) AS text FROM l LEFT JOIN g ON l.row = g.row AND l.k = g.k WHERE g.k IS NULL GROUP BY l.row
), n AS (
  SELECT row, count(*)::BIGINT AS n FROM g GROUP BY row
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(len(d.lines), 0)::BIGINT AS n_lines, coalesce(n.n, 0)::BIGINT AS n_deleted
FROM d LEFT JOIN k ON d.row = k.row LEFT JOIN n ON d.row = n.row
"""

OP11 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, source, lang, n_chars, text FROM documents
), c AS (
  SELECT *, coalesce(doc_id IS NOT NULL AND list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT), lambda crc, x:
      list_reduce(list_transform(range(8), lambda i: i::UBIGINT), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END), xor(crc, x)), 4294967295::UBIGINT) & 1 = 1, false) AS even FROM d
), f AS (
  SELECT row, doc_id, source,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
           || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         text, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS other FROM c
), l AS (
  SELECT row, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS changed FROM f
), p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l
), node AS (
  SELECT source, 0 AS level, pos, leaf AS h, n FROM p
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM node WHERE n > 1 GROUP BY source, level, pos // 3, n
), sub AS (
  SELECT source, level AS height, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, subroot AS h, n FROM sub
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, pos // 3, n
), step AS (
  SELECT p.row, g.level, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS after
  FROM p JOIN sub ON p.source IS NOT DISTINCT FROM sub.source, unnest(range(sub.height)) AS g(level)
  JOIN node a ON a.source IS NOT DISTINCT FROM p.source AND a.level = g.level AND a.pos = p.pos // (3 ** g.level)::BIGINT
  JOIN node b ON b.source IS NOT DISTINCT FROM p.source AND b.level = g.level AND b.pos // 3 = a.pos // 3
  GROUP BY p.row, g.level
), peak AS (
  SELECT max(level) AS height FROM top
), over AS (
  SELECT sub.source, sub.height + a.level AS level, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS after
  FROM sub, peak, unnest(range(peak.height)) AS g(level) JOIN top a ON a.level = g.level AND a.pos = sub.pos // (3 ** g.level)::BIGINT JOIN top b ON b.level = g.level AND b.pos // 3 = a.pos // 3
  GROUP BY sub.source, sub.height, a.level
), steps AS (
  SELECT * FROM step UNION ALL SELECT p.row, over.level, before, after FROM p JOIN over ON p.source IS NOT DISTINCT FROM over.source
), proof AS (
  SELECT row, string_agg(before || after, '' ORDER BY level) AS siblings FROM steps GROUP BY row
), fold AS (
  SELECT row, 0 AS level, changed AS h FROM p
  UNION ALL
  SELECT fold.row, fold.level + 1, sha256(before || h || after) FROM fold JOIN steps ON steps.row = fold.row AND steps.level = fold.level
), folded AS (
  SELECT row, arg_max(h, level) AS folded_root FROM fold GROUP BY row
), root AS (
  SELECT h AS root FROM top WHERE n = 1
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN sub ON p.source IS NOT DISTINCT FROM sub.source JOIN folded USING (row) LEFT JOIN proof USING (row), root
"""

OP13_ROUND = """, near{n} AS (
  SELECT p.row, p.part, min({{'d': list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': b.entry}}) AS m FROM part p JOIN book{n} b ON p.part = b.part GROUP BY p.row, p.part
), sums{n} AS (
  SELECT part, entry, place, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT p.part, m.e AS entry, unnest(range(len(p.v))) AS place, unnest(p.v) AS x FROM part p JOIN near{n} USING (row, part)) GROUP BY 1, 2, 3
), mean{n} AS (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS v FROM sums{n} GROUP BY part, entry
), book{m} AS (
  SELECT part, entry, coalesce(mean{n}.v, b.v) AS v FROM book{n} b LEFT JOIN mean{n} USING (part, entry)
)"""

OP13 = (
    """
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), size AS (
  SELECT ((max(len(v)) + 15) // 16)::BIGINT AS w FROM kept
), padded AS (
  SELECT row, vec_id, label, list_resize(v, 16 * w, 0) AS v, w FROM kept, size
), part AS (
  SELECT row, vec_id, g.part, v[g.part * w + 1:g.part * w + w] AS v FROM padded, unnest(range(16)) AS g(part)
), first AS (
  SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM padded
), book0 AS (
  SELECT part, entry, v FROM part JOIN first USING (row) WHERE entry < 64
)"""
    + OP13_ROUND.format(n=0, m=1)
    + OP13_ROUND.format(n=1, m=2)
    + """, last AS (
  SELECT p.row, p.part, min({'d': list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': b.entry}) AS m FROM part p JOIN book2 b ON p.part = b.part GROUP BY p.row, p.part
), coded AS (
  SELECT row, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM last GROUP BY row
), hash AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM padded JOIN coded USING (row), hash
"""
)

ORACLE_SQL: dict[str, str] = {"op1_neighbours": OP1, "op3_host_rules": OP3, "op5_mixing": OP5, "op7_near_duplicates": OP7, "op10_line_dedup": OP10, "op11_merkle_manifest": OP11, "op13_vector_codes": OP13}
