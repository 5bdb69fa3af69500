"""DuckDB SQL for the queries of this package, put together from common table expressions."""

from __future__ import annotations

_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')".format
_ONE = r"trim(regexp_replace({0}, '[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', ' ', 'g'))".format

_DOC_POSTS = f"""
posts AS (
  SELECT doc_id AS k, len(t) AS length, u.token, count(*) AS tf
  FROM (SELECT doc_id, {_TOKENS("text")} AS t FROM documents) d, unnest(t) AS u(token) GROUP BY ALL
)"""

_IDF = """
raw AS (SELECT token, count(*) AS df, ln({n} - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM posts GROUP BY token),
idf AS (SELECT token, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""

_PIECES = """
lines AS (
  SELECT source, doc_id, u.n, trim(u.line) AS text
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents) d, unnest(l) WITH ORDINALITY AS u(line, n) WHERE trim(u.line) <> ''
), cut AS (
  WITH RECURSIVE walk AS (
    SELECT source, doc_id, n, 0 AS part, text AS rest, NULL::VARCHAR AS text FROM lines
    UNION ALL
    SELECT source, doc_id, n, part + 1, CASE WHEN length(rest) > 3600 THEN ltrim(substr(rest, at_ + 1)) ELSE '' END,
           CASE WHEN length(rest) > 3600 THEN trim(substr(rest, 1, at_)) ELSE rest END
    FROM (SELECT *, CASE WHEN strpos(reverse(substr(rest, 1, 3600)), ' ') BETWEEN 1 AND 1800 THEN 3600 - strpos(reverse(substr(rest, 1, 3600)), ' ') ELSE 3600 END AS at_
          FROM walk WHERE rest <> '')
  ) SELECT * FROM walk WHERE text <> ''
), pieces AS (
  SELECT source AS book_id, doc_id, 'doc-' || doc_id AS chapter, text, length(text) AS chars, row_number() OVER (PARTITION BY doc_id ORDER BY n, part) - 1 AS piece
  FROM cut
), placed AS (
  SELECT *, coalesce(sum(chars + 2) OVER (PARTITION BY book_id ORDER BY doc_id, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start
  FROM pieces
)"""

#: The packer as a recursion over (chapter, piece, first piece): sums[i + 1] is the size of the first i pieces.
_CHUNKS = (
    _PIECES
    + """,
whole AS (
  SELECT book_id, doc_id, chapter, list(chars ORDER BY piece) AS c, list(text ORDER BY piece) AS t, list(char_start ORDER BY piece) AS s
  FROM placed GROUP BY ALL
), summed AS (
  SELECT *, list_transform(range(0, len(c) + 1), lambda i: coalesce(list_sum(c[1:i]), 0)::BIGINT + 2 * i) AS sums FROM whole
), steps AS (
  WITH RECURSIVE walk AS (
    SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS lo, NULL::BIGINT AS a1, NULL::BIGINT AS b1, NULL::BIGINT AS a2, NULL::BIGINT AS b2 FROM summed
    UNION ALL
    SELECT doc_id, i + 1,
           CASE WHEN sums[i + 2] - sums[mid + 1] >= 1800 THEN coalesce(list_filter(range(mid, i + 1), lambda k: sums[i + 2] - sums[k + 1] <= 250)[1], i + 1) ELSE mid END,
           CASE WHEN mid <> lo OR out1 THEN lo END, CASE WHEN mid <> lo OR out1 THEN i - 1 END,
           CASE WHEN sums[i + 2] - sums[mid + 1] >= 1800 THEN mid END, CASE WHEN sums[i + 2] - sums[mid + 1] >= 1800 THEN i END
    FROM (
      SELECT *, CASE WHEN out1 THEN coalesce(list_filter(range(lo, i), lambda k: sums[i + 1] - sums[k + 1] <= least(250, 3600 - c[i + 1] - 2))[1], i) ELSE lo END AS mid
      FROM (SELECT w.doc_id, w.i, w.lo, s.sums, s.c, w.i > w.lo AND s.sums[w.i + 1] - s.sums[w.lo + 1] + s.c[w.i + 1] + 2 > 3600 AS out1
            FROM walk w JOIN summed s USING (doc_id) WHERE w.i < len(s.c))
    )
  ) SELECT * FROM walk
), ranges AS (
  SELECT doc_id, a1 AS a, b1 AS b FROM steps WHERE a1 IS NOT NULL
  UNION ALL SELECT doc_id, a2, b2 FROM steps WHERE a2 IS NOT NULL
  UNION ALL SELECT doc_id, lo, i - 1 FROM steps JOIN summed USING (doc_id) WHERE i = len(c) AND lo < i
), chunked AS (
  SELECT book_id, doc_id, chapter, a, b, array_to_string(t[a + 1:b + 1], chr(10) || chr(10)) AS text,
         s[a + 1] AS char_start, s[b + 1] + c[b + 1] AS char_end,
         (row_number() OVER (PARTITION BY book_id ORDER BY doc_id, b, a) - 1)::INT AS ordinal
  FROM ranges JOIN summed USING (doc_id)
), chunks AS (
  SELECT *, length(text)::INT AS char_count, format('{}:{:04d}:{}', book_id, ordinal, substr(sha256(text), 1, 10)) AS chunk_id FROM chunked
)"""
)

_HASHED = """
{0}_b AS (
  SELECT k, (('0x' || substr(sha256(token), 1, 16))::UBIGINT % 512)::INT AS bucket, sum(CASE WHEN substr(sha256(token), 1, 1) >= '8' THEN tf ELSE -tf END)::BIGINT AS v
  FROM {1} GROUP BY ALL HAVING v <> 0
), {0} AS (SELECT k, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY k)) AS w FROM {0}_b)""".format

_HITS = f"""{_CHUNKS},
posts AS (
  SELECT chunk_id AS k, len(t) AS length, u.token, count(*) AS tf
  FROM (SELECT chunk_id, {_TOKENS("text")} AS t FROM chunks) d, unnest(t) AS u(token) GROUP BY ALL
), asked AS (
  SELECT item_id AS k, u.token, count(*) AS tf FROM (SELECT item_id, {_TOKENS("text")} AS t FROM benchmark) q, unnest(t) AS u(token) GROUP BY ALL
), {_IDF.format(n="(SELECT count(*) FROM chunks)")},
mean AS (SELECT avg(len({_TOKENS("text")})) AS m FROM chunks),
sparse AS (
  SELECT question_id, chunk_id, score, (row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id))::INT AS rank
  FROM (SELECT a.k AS question_id, p.k AS chunk_id, sum(a.tf * i.idf * p.tf * 2.5::DOUBLE / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.length / (SELECT m FROM mean)))) AS score
        FROM posts p JOIN idf i USING (token) JOIN asked a USING (token) GROUP BY ALL HAVING score > 0)
  QUALIFY rank <= 20
), {_HASHED("cv", "posts")}, {_HASHED("qv", "asked")},
dense AS (
  SELECT question_id, chunk_id, score, (row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id))::INT AS rank
  FROM (SELECT q.k AS question_id, c.k AS chunk_id, sum(c.w * q.w) AS score FROM cv c JOIN qv q USING (bucket) GROUP BY ALL)
  QUALIFY rank <= 20
), hits AS (
  SELECT question_id, chunk_id, score, (row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, d NULLS LAST, s))::INT AS rank
  FROM (SELECT question_id, chunk_id, d.rank AS d, s.rank AS s, coalesce(1::DOUBLE / (60 + d.rank), 0) + coalesce(1::DOUBLE / (60 + s.rank), 0) AS score
        FROM dense d FULL JOIN sparse s USING (question_id, chunk_id))
  QUALIFY rank <= 8
)"""

_ANSWERS = f"""{_HITS},
ks AS (SELECT * FROM (VALUES (8), (4)) AS v(k)),
ctx AS (
  SELECT k, question_id, list(text ORDER BY rank) AS t, list_distinct(list(chapter)) AS chapters,
         string_agg('<doc id="' || rank || '" chapter="' || chapter || '">' || chr(10) || text || chr(10) || '</doc>', chr(10) || chr(10) ORDER BY rank) AS documents
  FROM hits JOIN chunks USING (chunk_id) JOIN ks ON rank <= k GROUP BY ALL
), said AS (
  SELECT k, item_id AS question_id, b.text AS question, t[1] AS first, coalesce(documents, '') AS documents, coalesce(chapters, []) AS chapters, len(t) AS n, {_ONE("t[1]")} AS one
  FROM benchmark b CROSS JOIN ks LEFT JOIN ctx USING (k) WHERE ctx.question_id IS NULL OR ctx.question_id = item_id
), answers AS (
  SELECT *, CASE WHEN one IS NULL THEN 'I couldn''t find that in the book.'
                 ELSE 'According to the book: "' || CASE WHEN length(one) > 240 THEN regexp_replace(substr(one, 1, 240), ' [^ ]*$', '') || '…' ELSE one END || '" [1]' END AS text
  FROM (SELECT DISTINCT ON (k, question_id) * FROM said ORDER BY k, question_id, one NULLS LAST)
), cited AS (
  SELECT *, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\\[([0-9]{{1,3}})\\]', 1), lambda x: x::INT), lambda x: x BETWEEN 1 AND coalesce(n, 0)))) AS citations
  FROM answers
), finished AS (
  SELECT *, len(citations) = 0 AND (contains(lower(substr(text, 1, 200)), 'couldn''t find') OR contains(text, 'I couldn''t find that in the book.')) AS refused FROM cited
)"""

_GOLDEN = """
golden AS (
  SELECT item_id AS question_id, b.text AS question, count(d.doc_id) > 0 AS answerable,
         coalesce(list_sort(list('doc-' || d.doc_id) FILTER (d.doc_id IS NOT NULL)), []) AS expected
  FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY ALL
)"""

_ITEMS = f"""{_ANSWERS}, {_GOLDEN},
items AS (
  SELECT 'top' || k AS variant, answerable, refused, len(citations) AS c,
         CASE WHEN answerable THEN len(list_filter(expected, lambda e: len(list_filter(chapters, lambda x: contains(x, e))) > 0)) > 0 END AS hit,
         CASE WHEN answerable THEN contains(lower({_ONE("f.text")}), lower({_ONE("substr(g.question, 1, 40)")}))::INT::DOUBLE END AS contains_rate
  FROM finished f JOIN golden g USING (question_id)
), metrics AS (
  SELECT variant, count(*) AS item_count, count(*) FILTER (answerable) AS answerable_count, count(*) FILTER (NOT answerable) AS unanswerable_count,
         avg(hit::INT) AS retrieval_hit_rate, avg((NOT refused)::INT) FILTER (answerable) AS answer_rate, avg((answerable <> refused)::INT) AS refusal_accuracy,
         avg(refused::INT) FILTER (NOT answerable) AS unanswerable_refusal_rate, avg(contains_rate) AS contains_rate,
         avg((c > 0)::INT) FILTER (NOT refused) AS citation_coverage, avg(c) FILTER (NOT refused) AS average_citations
  FROM items GROUP BY variant
)"""

_METRICS = ("retrieval_hit_rate", "answer_rate", "refusal_accuracy", "contains_rate", "citation_coverage", "average_citations")

_PAIRS = f"""{_CHUNKS},
sampled AS (SELECT *, {_ONE("text")} AS one FROM chunks QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY md5('13|' || chunk_id), chunk_id) <= 100),
pairs AS (
  SELECT book_id, chunk_id, ordinal, text AS source, pos, CASE pos WHEN 0 THEN 'What does the passage say about ' || substr(one, 1, 30) || '?' ELSE 'Why does the passage mention ' || substr(one, 1, 30) || '?' END AS question,
         trim('According to the passage: ' || substr(one, 1, 60)) AS answer, trim(substr(one, 1, 60)) AS quote
  FROM sampled, (VALUES (0), (1)) AS v(pos)
), named AS (SELECT *, chunk_id || ':' || substr(sha256(question), 1, 12) AS pair_id FROM pairs),
judged AS (
  SELECT *, length(quote) >= 15 AND contains(lower({_ONE("source")}), lower(quote)) AS verified, length(question) < 12 OR length(answer) < 20 AS short FROM named
), reasoned AS (
  SELECT *, CASE WHEN NOT verified THEN 'no_verified_quotes' WHEN short THEN 'too_short'
                 WHEN row(book_id, ordinal, pos, pair_id) > min(CASE WHEN verified AND NOT short THEN row(book_id, ordinal, pos, pair_id) END) OVER (PARTITION BY book_id, lower({_ONE("question")})) THEN 'duplicate_question'
            END AS reason
  FROM judged
)"""

_RAFT = f"""{_PAIRS},
kept AS (SELECT * FROM reasoned WHERE reason IS NULL),
ring AS (SELECT book_id, chunk_id, row_number() OVER (PARTITION BY book_id ORDER BY md5('13|' || chunk_id), chunk_id) - 1 AS place, count(*) OVER (PARTITION BY book_id) AS n FROM chunks),
picked AS (
  SELECT pair_id, ring.chunk_id, false AS is_golden
  FROM (SELECT pair_id, book_id, chunk_id AS golden, ('0x' || substr(md5('13|' || pair_id), 1, 8))::BIGINT AS b, u.step
        FROM kept, unnest(range(0, 5)) AS u(step)) k
  JOIN ring ON ring.book_id = k.book_id AND ring.place = (b + step) % n
  WHERE step < n AND ring.chunk_id <> golden
  QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY step) <= 4
), drawn AS (SELECT *, ('0x' || substr(md5('coin|13|' || pair_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= 0.15::DOUBLE AS answerable FROM kept),
contexts AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY md5('13|' || pair_id || '|' || chunk_id), chunk_id) AS at_
  FROM (SELECT * FROM picked UNION ALL SELECT pair_id, chunk_id, true FROM drawn WHERE answerable)
), shown AS (
  SELECT pair_id, count(*)::INT AS n_contexts, count(*) FILTER (is_golden)::INT AS n_golden, max(CASE WHEN is_golden THEN at_ END) AS golden_at,
         string_agg('<doc id="' || at_ || '" chapter="' || chapter || '">' || chr(10) || text || chr(10) || '</doc>', chr(10) || chr(10) ORDER BY at_) AS documents
  FROM contexts JOIN chunks USING (chunk_id) GROUP BY pair_id
), raft AS (
  SELECT pair_id || ':raft' AS example_id, book_id, question, answerable, coalesce(n_contexts, 0) AS n_contexts, coalesce(n_golden, 0) AS n_golden, golden_at, coalesce(documents, '') AS documents,
         CASE WHEN answerable THEN 'The relevant passage says: "' || quote || '" [' || golden_at || ']' || chr(10) || chr(10) || answer ELSE 'I couldn''t find that in the book.' END AS target
  FROM drawn LEFT JOIN shown USING (pair_id)
), split AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY book_id ORDER BY md5('13|' || example_id), example_id) <= least(greatest(1, floor(count(*) OVER (PARTITION BY book_id) * 0.1)), count(*) OVER (PARTITION BY book_id))
                 THEN 'validation' ELSE 'train' END AS split
  FROM raft
)"""

_SYSTEM = "'Answer questions about \"the book\" from the documents only, cite them as [n], and else reply: I couldn''t find that in the book.'"

_OUTLINE = f"""
b AS (
  SELECT 'doc-' || doc_id AS book_id, (u.n - 1)::INT AS block_no, trim(u.line) AS text, CASE WHEN length(trim(u.line)) <= 60 THEN length(trim(u.line)) % 3 + 1 END AS level
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents) d, unnest(l) WITH ORDINALITY AS u(line, n) WHERE trim(u.line) <> ''
), leveled AS (
  SELECT *, CASE WHEN bool_or(coalesce(level = 1, false)) OVER p THEN 1 WHEN bool_or(coalesce(level = 2, false)) OVER p THEN 2 ELSE 0 END AS brk FROM b WINDOW p AS (PARTITION BY book_id)
), opened AS (
  SELECT *, coalesce(level = brk, false) AS breaks, sum(coalesce(level = brk, false)::INT) OVER w AS no, coalesce(last_value(CASE WHEN level = brk THEN text END IGNORE NULLS) OVER w, 'Untitled') AS chapter
  FROM leveled WINDOW w AS (PARTITION BY book_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), inside AS (SELECT *, row_number() OVER (PARTITION BY book_id, no ORDER BY block_no) AS rn FROM opened WHERE NOT breaks),
outline AS (
  SELECT *, dense_rank() OVER (PARTITION BY book_id ORDER BY no)::INT AS chapter_no FROM inside
  WHERE NOT (level IS NOT NULL AND rn = 1 AND lower({_ONE("text")}) = lower({_ONE("chapter")}))
), last AS (
  SELECT *, {", ".join(f"last_value(CASE WHEN level = {n} THEN text END IGNORE NULLS) OVER w AS t{n}, coalesce(max(CASE WHEN level = {n} THEN block_no END) OVER w, -1) AS p{n}" for n in (1, 2, 3))}
  FROM outline WINDOW w AS (PARTITION BY book_id, chapter_no ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""

_TREE = f"""{_CHUNKS},
level1 AS (
  SELECT book_id, chapter AS title, row_number() OVER (PARTITION BY book_id ORDER BY doc_id) AS n, count(*) AS n_chunks,
         'This part of the book covers: ' || regexp_replace(substr({_ONE("substr(string_agg(text, chr(10) || chr(10) ORDER BY ordinal), 1, 6000)")}, 1, 160), '[ .]+$', '') || '.' AS summary
  FROM chunks GROUP BY book_id, doc_id, chapter
), nodes1 AS (SELECT book_id || ':chapter:' || n AS node_id, book_id, 1 AS level, n, title, 0 AS n_children, n_chunks, summary FROM level1),
nodes2 AS (
  SELECT book_id || ':window:' || min(n) || '-' || max(n) AS node_id, book_id, 2 AS level, min(n) AS n, 'Chapters ' || min(n) || '-' || max(n) AS title, count(*) AS n_children, sum(n_chunks) AS n_chunks,
         'This part of the book covers: ' || regexp_replace(substr({_ONE("substr(string_agg(title || ': ' || summary, chr(10) || chr(10) ORDER BY n), 1, 6000)")}, 1, 160), '[ .]+$', '') || '.' AS summary
  FROM (SELECT *, count(*) OVER (PARTITION BY book_id) AS a FROM nodes1) WHERE a > 4 GROUP BY book_id, (n - 1) // 4
), below AS (SELECT * FROM nodes2 UNION ALL SELECT * FROM nodes1 WHERE book_id NOT IN (SELECT book_id FROM nodes2)),
nodes3 AS (
  SELECT book_id || ':root' AS node_id, book_id, 3 AS level, 1 AS n, book_id AS title, count(*) AS n_children, sum(n_chunks) AS n_chunks,
         'This part of the book covers: ' || regexp_replace(substr({_ONE("substr(string_agg(title || ': ' || summary, chr(10) || chr(10) ORDER BY n), 1, 6000)")}, 1, 160), '[ .]+$', '') || '.' AS summary
  FROM below GROUP BY book_id
), nodes AS (SELECT * FROM nodes1 UNION ALL SELECT * FROM nodes2 UNION ALL SELECT * FROM nodes3)"""

#: One digest of rows (book_id, level, pos, d): of runs of 256, of runs of those, and of all.
_MERKLE = """
{name}_1 AS (SELECT book_id, level, pos // 256 AS pos, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM ({rows}) GROUP BY book_id, level, pos // 256),
{name}_2 AS (SELECT book_id, level, pos // 256 AS pos, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM {name}_1 GROUP BY book_id, level, pos // 256),
{name} AS (SELECT book_id, substr(sha256(string_agg(d, '' ORDER BY level, pos)), 1, 40) AS digest FROM {name}_2 GROUP BY book_id)"""
_TREE_HASH = _MERKLE.format(name="digests", rows="SELECT book_id, level, n - 1 AS pos, sha256(node_id || chr(31) || coalesce(summary, '')) AS d FROM nodes") + """,
tree_hash AS (SELECT book_id, count(*) AS node_count, digest AS tree_hash FROM nodes JOIN digests USING (book_id) GROUP BY ALL)"""

#: What lies below the nodes of trees.
_BELOW = """children AS (
  SELECT a.book_id, b.node_id, a.node_id AS child, a.n FROM nodes1 a JOIN nodes2 b ON a.book_id = b.book_id AND (a.n - 1) // 4 = (b.n - 1) // 4
  UNION ALL SELECT below.book_id, r.node_id, below.node_id, below.n FROM below JOIN nodes3 r USING (book_id)
), own AS (
  SELECT c.book_id, l.node_id, l.n, chunk_id, ordinal FROM chunks c JOIN nodes1 l ON l.book_id = c.book_id AND l.title = c.chapter
), members AS (
  SELECT book_id, node_id, chunk_id, ordinal FROM own
  UNION ALL SELECT o.book_id, w.node_id, chunk_id, ordinal FROM own o JOIN nodes2 w ON o.book_id = w.book_id AND (o.n - 1) // 4 = (w.n - 1) // 4
  UNION ALL SELECT o.book_id, r.node_id, chunk_id, ordinal FROM own o JOIN nodes3 r USING (book_id)
)"""

#: Questions about whole books, and the nodes of each by the cosine of hashed vectors.
_GLOBAL = f"""{_TREE}, book_asked AS (
  SELECT book_id || '|' || item_id AS question_id, book_id, b.text AS question FROM benchmark b
  JOIN (SELECT DISTINCT source AS book_id, ('0x' || substr(md5(source), 1, 8))::BIGINT AS crc FROM documents) s ON crc % 8 = item_id % 8
), node_posts AS (
  SELECT node_id AS k, u.token, count(*) AS tf FROM (SELECT node_id, {_TOKENS("summary")} AS t FROM nodes) d, unnest(t) AS u(token) GROUP BY ALL
), asked_posts AS (
  SELECT question_id AS k, u.token, count(*) AS tf FROM (SELECT question_id, {_TOKENS("question")} AS t FROM book_asked) d, unnest(t) AS u(token) GROUP BY ALL
), {_HASHED("nv", "node_posts")}, {_HASHED("av", "asked_posts")},
close AS (
  SELECT a.k AS question_id, n.k AS node_id, sum(a.w * n.w) AS score FROM av a JOIN nv n USING (bucket)
  JOIN book_asked q ON q.question_id = a.k JOIN nodes m ON m.node_id = n.k AND m.book_id = q.book_id GROUP BY ALL
), chosen AS (
  SELECT question_id, question, node_id, level, n, title, summary, round(coalesce(score, 0), 9) AS score,
         (row_number() OVER (PARTITION BY question_id ORDER BY round(coalesce(score, 0), 9) DESC, level, n))::INT AS rank
  FROM book_asked JOIN nodes USING (book_id) LEFT JOIN close USING (question_id, node_id) QUALIFY rank <= 6
)"""

_MATRIX_HITS = f"""{_HITS.replace("QUALIFY rank <= 8", "QUALIFY rank <= 40")}, shared AS (
  SELECT question_id, chunk_id, rank AS was, coalesce(len(list_intersect({_TOKENS("b.text")}, {_TOKENS("c.text")}))::DOUBLE / nullif(len(list_distinct({_TOKENS("b.text")})), 0), 0) AS score
  FROM hits JOIN chunks c USING (chunk_id) JOIN benchmark b ON item_id = question_id
), ranked AS (
  SELECT kind || '-k' || v.n AS k, question_id, chunk_id, rank
  FROM (SELECT 'hybrid' AS kind, question_id, chunk_id, rank FROM hits
        UNION ALL SELECT 'hybrid+rerank', question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, was) FROM shared QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, was) <= 8) r
  JOIN (VALUES (4), (8)) AS v(n) ON rank <= v.n
)"""
_MATRIX = (
    _ITEMS.replace(_HITS, _MATRIX_HITS)
    .replace("ks AS (SELECT * FROM (VALUES (8), (4)) AS v(k))", "ks AS (SELECT DISTINCT k FROM ranked)")
    .replace("FROM hits JOIN chunks USING (chunk_id) JOIN ks ON rank <= k GROUP BY ALL", "FROM ranked JOIN chunks USING (chunk_id) GROUP BY ALL")
    .replace("'top' || k AS variant", "k AS variant")
)
_PLAIN = "'According to the book: \"' || CASE WHEN length(one) > 240 THEN regexp_replace(substr(one, 1, 240), ' [^ ]*$', '') || '…' ELSE one END || '\" [1]'"
_GENERATED = _ITEMS.replace("(VALUES (8), (4))", "(VALUES (8))")
_BRIEF = _GENERATED.replace(_PLAIN, "trim('In the book: ' || substr(split_part(first, chr(10), 1), 1, 60) || ' [1]')")
_COUNTS = "item_count, answerable_count, unanswerable_count, round(unanswerable_refusal_rate, 6) AS unanswerable_refusal_rate"

ORACLE_SQL = {
    "ablation_matrix": f"WITH {_MATRIX} SELECT variant, {_COUNTS}, {', '.join(f'round({m}, 6) AS {m}' for m in _METRICS)} FROM metrics",
    "generator_comparison": f"""
        WITH made AS (SELECT 'plain' AS variant, * EXCLUDE (variant) FROM (WITH {_GENERATED} SELECT * FROM metrics) UNION ALL SELECT 'brief', * EXCLUDE (variant) FROM (WITH {_BRIEF} SELECT * FROM metrics)),
        kinds AS (SELECT * FROM (VALUES ('plain', 'base'), ('brief', 'adapter'), ('absent', 'file')) AS v(variant, kind))
        SELECT variant, kind, coalesce(m.item_count, 0) AS item_count, {', '.join(f'round(m.{x}, 6) AS {x}, round(m.{x} - b.{x}, 6) AS {x}_delta' for x in _METRICS)}
        FROM kinds LEFT JOIN made m USING (variant), (SELECT * FROM made WHERE variant = 'plain') b""",
    "conversation_errors": """
        WITH c AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS t FROM conversations GROUP BY conv_id), d AS (
          SELECT conv_id % 2 = 0 AS answerable, t, t[-1] AS target, len(string_split(t[2], '<doc ')) - 1 AS n_docs, list_transform(regexp_extract_all(t[-1], '\\[([0-9]{1,3})\\]', 1), lambda x: x::INT) AS cites FROM c)
        SELECT error, count(*) AS n FROM (
          SELECT 'blank content' AS error FROM d WHERE len(list_filter(t, lambda x: trim(x) = '')) > 0
          UNION ALL SELECT 'no documents' FROM d WHERE n_docs = 0
          UNION ALL SELECT 'bad citations' FROM d WHERE answerable AND (len(cites) = 0 OR len(list_filter(cites, lambda x: x < 1 OR x > n_docs)) > 0)
          UNION ALL SELECT 'not the refusal' FROM d WHERE NOT answerable AND target <> 'I couldn''t find that in the book.') GROUP BY error""",
    "raft_examples": f"WITH {_RAFT} SELECT example_id, book_id, answerable, target AS answer, n_contexts, n_golden FROM raft",
    "chat_split": f"WITH {_RAFT} SELECT example_id, split, answerable, 3 AS n_messages FROM split",
    "chat_errors": f"WITH {_RAFT} SELECT example_id, CASE WHEN n_contexts = 0 THEN 'no documents' ELSE 'bad citations' END AS error FROM raft WHERE n_contexts = 0 OR (answerable AND (golden_at IS NULL OR golden_at > n_contexts))",
    "synthesis_manifest": f"""WITH {_RAFT}, c AS (SELECT book_id, count(*) AS chunk_count FROM chunks GROUP BY 1), s AS (SELECT book_id, count(*) AS sampled_chunks FROM sampled GROUP BY 1),
        p AS (SELECT book_id, count(*) AS generated_pairs, count(*) FILTER (reason IS NULL) AS kept_pairs, {', '.join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in ("no_verified_quotes", "too_short", "duplicate_question", "question_echoes_answer"))} FROM reasoned GROUP BY 1),
        e AS (SELECT book_id, count(*) AS example_count, count(*) FILTER (answerable) AS answerable_examples, count(*) FILTER (NOT answerable) AS unanswerable_examples FROM raft GROUP BY 1)
        SELECT * FROM c LEFT JOIN s USING (book_id) LEFT JOIN p USING (book_id) LEFT JOIN e USING (book_id)""",
    "training_manifest": f"""WITH {_RAFT}, rows_ AS (SELECT *, ('0x' || substr(md5(concat_ws(chr(31), example_id, split, {_SYSTEM}, 'Documents:' || chr(10) || documents || chr(10) || chr(10) || 'Question: ' || question, target)), 1, 15))::UBIGINT AS h FROM split)
        SELECT book_id, count(*) AS source_count, count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'validation') AS validation_count, count(*) FILTER (answerable) AS answerable_count, count(*) FILTER (NOT answerable) AS unanswerable_count,
               substr(sha256(count(*) || ':' || sum(h)), 1, 40) AS dataset_hash, substr(sha256({_SYSTEM} || chr(10) || chr(10) || 'Documents:' || chr(10) || chr(10) || chr(10) || 'Question: '), 1, 40) AS prompt_hash FROM rows_ GROUP BY book_id""",
    "chapter_assignment": f"WITH {_OUTLINE} SELECT book_id, block_no, chapter_no, chapter, coalesce(level, 0)::INT AS level FROM outline",
    "heading_paths": f"WITH {_OUTLINE} SELECT book_id, block_no, concat_ws(' / ', t1, CASE WHEN p2 > p1 THEN t2 END, CASE WHEN p3 > greatest(p1, p2) THEN t3 END) AS path FROM last",
    "tree_manifest": f"""WITH {_TREE}, l AS (SELECT DISTINCT 'doc-' || doc_id AS title FROM labels)
        SELECT book_id, count(*) FILTER (level = 1) AS chapter_count, count(*) FILTER (level = 2) AS window_count, count(*) AS node_count, count(*) FILTER (NOT known) AS generated_summaries, count(*) FILTER (known) AS reused_summaries, 0::BIGINT AS failed_summaries
        FROM (SELECT *, level = 1 AND title IN (SELECT title FROM l) AS known FROM nodes) GROUP BY book_id""",
    "summary_keys": f"WITH {_CHUNKS} SELECT book_id, chapter, sha256(concat_ws(chr(31), '1', 'deterministic', chapter, '6000', '1200', substr(string_agg(text, chr(10) || chr(10) ORDER BY ordinal), 1, 6000))) AS key FROM chunks GROUP BY book_id, doc_id, chapter",
    "contextual_bm25": f"""WITH {_HITS.replace("), chunks AS (", "), plain AS (", 1).replace("),\nposts AS (", f"), chunks AS (SELECT p.* EXCLUDE (text), 'A passage about: ' || regexp_replace(substr({_ONE('substr(d.text, 1, 6000)')}, 1, 80), '[ .]+$', '') || '.' || chr(10) || chr(10) || p.text AS text FROM plain p JOIN documents d USING (doc_id)),{chr(10)}posts AS (", 1)}
        SELECT question_id, chunk_id, rank, round(score, 6) AS score FROM sparse WHERE rank <= 5""",
    "truncated_vectors": """
        WITH h AS (SELECT vec_id, embedding[1:16]::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM h)
        SELECT vec_id, len(v)::INT AS dim, round(list_min(v), 6) AS least, round(list_max(v), 6) AS greatest FROM u""",
    "wrapped_lines": f"""
        WITH w AS (SELECT doc_id, list_filter(string_split({_ONE("text")}, ' '), lambda x: x <> '') AS w FROM documents),
        l AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN '' ELSE list_reduce(w, lambda a, x: a || CASE WHEN length(split_part(a, chr(10), -1)) + 1 + length(x) > 88 THEN chr(10) ELSE ' ' END || x) END AS t FROM w)
        SELECT doc_id, (length(t) - length(replace(t, chr(10), '')) + 1)::INT AS n_lines, md5(t) AS md5 FROM l""",
    "global_answers": f"""WITH {_TREE}, asked AS (
          SELECT book_id || '|' || item_id AS question_id, book_id, list_distinct({_TOKENS("b.text")}) AS q FROM benchmark b JOIN (SELECT DISTINCT source AS book_id, crc FROM (SELECT source, ('0x' || substr(md5(source), 1, 8))::BIGINT AS crc FROM documents)) s ON crc % 8 = item_id % 8
        ), best AS (
          SELECT question_id, node_id, summary, row_number() OVER (PARTITION BY question_id ORDER BY len(list_intersect(q, {_TOKENS("summary")})) DESC, level, n) AS rank
          FROM nodes JOIN asked USING (book_id) QUALIFY rank <= 6)
        SELECT question_id, string_agg(node_id, ',' ORDER BY rank) AS nodes, 'According to the book: "' || trim(regexp_replace('According to the book: "' || min(CASE WHEN rank = 1 THEN summary END) || '" [1]', ' ?\\[[0-9]{{1,3}}\\]', '', 'g')) || '" [1]' AS text
        FROM best GROUP BY question_id""",
    "global_selection": f"WITH {_GLOBAL} SELECT question_id, rank, node_id, round(score, 6) + 0.0::DOUBLE AS score FROM chosen",
    "global_prompts": f"""WITH {_GLOBAL}, partial AS (
          SELECT *, trim(regexp_replace('According to the book: "' || summary || '" [1]', ' ?\\[[0-9]{{1,3}}\\]', '', 'g')) AS p FROM chosen
        ), put AS (
          SELECT question_id, question, string_agg(node_id, ',' ORDER BY rank) AS nodes, min(CASE WHEN rank = 1 THEN p END) AS first,
                 string_agg('<doc id="' || rank || '" node="' || node_id || '" level="' || level || '" title="' || title || '">' || chr(10) || p || chr(10) || '</doc>', chr(10) || chr(10) ORDER BY rank) AS docs
          FROM partial GROUP BY question_id, question)
        SELECT question_id, nodes, md5('Put the partial answers together into one, citing them as [n].' || chr(10) || chr(10) || docs || chr(10) || chr(10) || 'Question: ' || question) AS prompt_md5,
               'According to the book: "' || first || '" [1]' AS text, '1' AS citations, false AS refused FROM put""",
    "global_chapters": f"""WITH {_GLOBAL}
        SELECT question_id, count(*) AS chapters, count(*)::INT AS last_rank, max_by(node_id, n) AS last_node,
               max(md5('Answer from the summary only, citing it as [1].' || chr(10) || chr(10) || '<doc id="1" node="' || node_id || '" level="1" title="' || title || '">' || chr(10) || summary || chr(10) || '</doc>' || chr(10) || chr(10) || 'Question: ' || question)) AS greatest_md5
        FROM book_asked JOIN nodes USING (book_id) WHERE level = 1 GROUP BY question_id""",
    "tokenize_stats": f"SELECT doc_id, len({_TOKENS('text')})::BIGINT AS n_tokens, len(list_distinct({_TOKENS('text')}))::BIGINT AS n_distinct FROM documents",
    "doc_term_stats": f"WITH {_DOC_POSTS} SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf FROM posts GROUP BY token",
    "idf_table": f"WITH {_DOC_POSTS}, {_IDF.format(n='(SELECT count(*) FROM documents)')} SELECT token, df, round(idf, 6) AS idf FROM idf",
    "char_offsets": f"WITH {_PIECES} SELECT book_id, doc_id, piece::INT AS piece, char_start, char_start + chars AS char_end FROM placed",
    "chunk_packing": f"WITH {_CHUNKS} SELECT chunk_id, book_id, doc_id, ordinal, char_start, char_end, char_count FROM chunks",
    "index_metadata": f"WITH {_CHUNKS} SELECT book_id, count(*) AS chunk_count, round(avg(char_count), 6) AS average_chunk_chars, count(DISTINCT doc_id) AS chapter_count FROM chunks GROUP BY book_id",
    "hash_buckets": f"WITH {_DOC_POSTS}, {_HASHED('vec', 'posts')} SELECT k AS doc_id, bucket, round(w, 6) AS w FROM vec",
    "bm25_topk": f"WITH {_HITS} SELECT question_id, chunk_id, rank, round(score, 6) AS score FROM sparse",
    "dense_topk_hash": f"WITH {_HITS} SELECT question_id, chunk_id, rank, round(score, 6) AS score FROM dense",
    "hybrid_rrf": f"WITH {_HITS} SELECT question_id, chunk_id, rank, round(score, 9) AS score FROM hits",
    "rrf_chapter_filter": f"WITH {_HITS}, {_GOLDEN} SELECT question_id, chunk_id, rank FROM hits JOIN chunks USING (chunk_id) JOIN golden USING (question_id) WHERE chapter = expected[1]",
    "reranked_topk": f"""WITH {_HITS.replace("QUALIFY rank <= 8", "QUALIFY rank <= 40")}, scored AS (
          SELECT question_id, chunk_id, rank AS was, coalesce(len(list_intersect({_TOKENS("b.text")}, {_TOKENS("c.text")}))::DOUBLE / nullif(len(list_distinct({_TOKENS("b.text")})), 0), 0) AS score
          FROM hits JOIN chunks c USING (chunk_id) JOIN benchmark b ON item_id = question_id)
        SELECT question_id, chunk_id, (row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, was))::INT AS rank, round(score, 6) AS score FROM scored QUALIFY rank <= 8""",
    "summary_cache": """
        WITH k AS (SELECT doc_id, sha256(text) AS key FROM documents), c AS (SELECT key, max(doc_id) AS value FROM k WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY key)
        SELECT doc_id, value::VARCHAR AS value FROM k LEFT JOIN c USING (key)""",
    "chapter_markdown": f"WITH {_PIECES} SELECT book_id, doc_id, '## ' || chapter || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY piece) || chr(10) AS markdown FROM pieces GROUP BY book_id, doc_id, chapter",
    "page_headings": "SELECT page_id, coalesce(" + ", ".join(
        "nullif(" + _ONE(f"regexp_replace(regexp_extract(html, '(?is)<h{n}(?:\\s[^>]*)?>(.*?)</h{n}>', 1), '<[^>]*>', '', 'g')") + ", '')" for n in (1, 2, 3)
    ) + ", regexp_replace(regexp_extract(url, '([^/.?#]*)[^/]*$', 1), '[-_]+', ' ', 'g')) AS heading FROM pages",
    "label_topk": """
        WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND v.label = 3)
        SELECT query_id, vec_id, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id))::INT AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 10""",
    "cited_answers": f"WITH {_ANSWERS} SELECT question_id, text, array_to_string(citations, ',') AS citations, refused, md5(documents) AS prompt_md5 FROM finished WHERE k = 8",
    "golden_items": f"WITH {_GOLDEN} SELECT question_id, answerable, array_to_string(expected, ',') AS expected_chapters FROM golden",
    "stored_hybrid": f"WITH {_HITS} SELECT question_id, chunk_id, rank, round(score, 9) AS score FROM hits",
    "snippet_rates": f"""WITH {_ANSWERS}, {_GOLDEN}, parts AS (
          SELECT question_id, answerable, lower({_ONE("f.text")}) AS t, list_filter([lower({_ONE("substr(g.question, 1, 15)")}), lower({_ONE("substr(g.question, 16, 15)")}), lower({_ONE("substr(g.question, 31, 15)")}), 'no such words'], lambda x: x <> '') AS s
          FROM finished f JOIN golden g USING (question_id) WHERE k = 8)
        SELECT question_id, CASE WHEN answerable THEN round(len(list_filter(s, lambda x: contains(t, x)))::DOUBLE / len(s), 6) END AS contains_rate FROM parts""",
    "ablation_skipped": f"""WITH {_ITEMS}, v AS (SELECT * FROM (VALUES ('reranked', 0, false, 'no reranker is set'), ('top8', 1, true, NULL), ('judged', 2, false, 'the judge is gone'), ('top4', 3, false, NULL)) AS x(variant, position, baseline, skipped))
        SELECT v.variant, position::INT AS position, baseline, coalesce(m.item_count, 0) AS item_count, {', '.join(f'round(m.{x}, 6) AS {x}, round(m.{x} - b.{x}, 6) AS {x}_delta' for x in _METRICS)}, skipped
        FROM v LEFT JOIN metrics m USING (variant), (SELECT * FROM metrics WHERE variant = 'top8') b""",
    "eval_summary": f"WITH {_ITEMS} SELECT variant, item_count, answerable_count, unanswerable_count, round(unanswerable_refusal_rate, 6) AS unanswerable_refusal_rate, {', '.join(f'round({m}, 6) AS {m}' for m in _METRICS)} FROM metrics",
    "ablation_deltas": f"WITH {_ITEMS} SELECT m.variant, {', '.join(f'round(m.{x} - b.{x}, 6) AS {x}_delta' for x in _METRICS)} FROM metrics m, metrics b WHERE b.variant = 'top8'",
    "qa_pairs": f"WITH {_PAIRS} SELECT pair_id, book_id, chunk_id, question, answer, quote AS quotes FROM named",
    "qa_filter_reasons": f"WITH {_PAIRS} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM reasoned GROUP BY ALL",
    "conversation_split": """
        WITH c AS (SELECT conv_id, count(*) AS turns, md5('13|' || conv_id) AS h FROM conversations GROUP BY conv_id)
        SELECT conv_id, turns, CASE WHEN row_number() OVER (PARTITION BY h[1] ORDER BY h, conv_id) <= least(greatest(1, floor(count(*) OVER (PARTITION BY h[1]) * 0.1)), count(*) OVER (PARTITION BY h[1])) THEN 'validation' ELSE 'train' END AS split FROM c""",
    "tree_nodes": f"WITH {_TREE} SELECT node_id, book_id, level::INT AS level, title, n_children::INT AS n_children, n_chunks::INT AS n_chunks, summary FROM nodes",
    "tree_hash": f"WITH {_TREE}, {_TREE_HASH} SELECT * FROM tree_hash",
    "tree_identity": f"""WITH {_TREE}, {_TREE_HASH}, {_MERKLE.format(name="source_hash", rows="SELECT book_id, 0 AS level, ordinal AS pos, sha256(chunk_id) AS d FROM chunks")}
        SELECT t.book_id, node_count, tree_hash, s.digest AS source_hash, count(*) FILTER (level = 1) AS chapter_count, count(*) FILTER (level = 2) AS window_count, 'deterministic' AS model
        FROM tree_hash t JOIN source_hash s USING (book_id) JOIN nodes USING (book_id) GROUP BY ALL""",
    "tree_members": f"""WITH {_TREE}, {_BELOW}
        SELECT node_id, c.chunks, first_chunk, last_chunk, coalesce(children, 0) AS children, first_child, last_child
        FROM (SELECT node_id, count(*) AS chunks, min_by(chunk_id, ordinal) AS first_chunk, max_by(chunk_id, ordinal) AS last_chunk FROM members GROUP BY 1) c
        LEFT JOIN (SELECT node_id, count(*) AS children, min_by(child, n) AS first_child, max_by(child, n) AS last_child FROM children GROUP BY 1) b USING (node_id)""",
    "tree_faults": f"""WITH {_TREE}, {_BELOW}, damaged AS (SELECT * FROM nodes WHERE n <> 7 UNION ALL SELECT * FROM nodes WHERE n = 5 AND level = 1), faults AS (
          SELECT book_id, 'repeated node' AS reason, node_id AS what FROM damaged GROUP BY ALL HAVING count(*) > 1
          UNION SELECT book_id, 'unknown child', child FROM children WHERE child NOT IN (SELECT node_id FROM damaged)
          UNION SELECT book_id, 'unknown parent', node_id FROM children WHERE node_id NOT IN (SELECT node_id FROM damaged)
          UNION SELECT m.book_id, 'unknown chunk', chunk_id FROM members m WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE doc_id % 9 = 0)
        ) SELECT book_id, reason, count(*) AS n, min(what) AS least FROM faults GROUP BY ALL""",
    "context_prefixes": f"WITH {_CHUNKS} SELECT chunk_id, 'A passage about: ' || regexp_replace(substr({_ONE('substr(d.text, 1, 6000)')}, 1, 80), '[ .]+$', '') || '.' AS context FROM chunks c JOIN documents d ON d.doc_id = c.doc_id AND d.source = c.book_id",
    "enriched_chunks": f"""WITH {_CHUNKS}, titles AS (
          SELECT source AS book_id, 'part-' || substr(doc_id::VARCHAR, 1, 1) AS title, max_by(substr(text, 1, 6000), doc_id) AS excerpt FROM documents GROUP BY ALL
        ), sent AS (
          SELECT chunk_id, ordinal, title, length('Say in one sentence where this passage stands in its chapter.' || chr(10) || chr(10) || 'Chapter:' || chr(10) || excerpt || chr(10) || chr(10) || 'Passage:' || chr(10) || text) AS n
          FROM chunks c JOIN titles t ON t.book_id = c.book_id AND t.title = 'part-' || substr(c.doc_id::VARCHAR, 1, 1))
        SELECT chunk_id, title AS chapter, CASE WHEN ordinal % 5 = 0 THEN CASE WHEN length(chunk_id) % 2 = 0 THEN 'kept 10' ELSE 'kept 2' END WHEN n % 3 = 2 AND length('In part ' || n) >= 10 THEN 'In part ' || n END AS context FROM sent""",
    "reply_log": """
        WITH t AS (SELECT conv_id || '/' || role AS key, turn AS pos, md5(text) AS value, length(text) % 2 = 1 OR contains(text, '!') AS torn FROM conversations WHERE text IS NOT NULL)
        SELECT key, max(pos) AS pos, max_by(value, pos) AS value FROM t WHERE NOT torn GROUP BY key
        UNION ALL SELECT 'set aside', count(*), NULL FROM t WHERE torn""",
    "markdown_blocks": """
        WITH l AS (SELECT doc_id, u.n - 1 AS n, u.line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d, unnest(l) WITH ORDINALITY AS u(line, n)),
        m AS (SELECT doc_id, n, CASE WHEN n % 17 = 0 THEN '## ' || line WHEN n % 11 = 3 THEN ' - ' || line WHEN n % 11 = 4 THEN '12. ' || line WHEN n % 13 = 5 THEN '> ' || line WHEN n % 19 = 7 THEN '```'
                                WHEN n % 23 = 1 THEN '' WHEN n % 29 = 2 THEN '|' || line || '|' WHEN n % 31 = 4 THEN ' ---' ELSE line END AS line FROM l),
        b AS (SELECT *, trim(line) AS t, ltrim(line) AS o, length(line) - length(ltrim(line, '#')) AS h, length(ltrim(line)) - length(ltrim(ltrim(line), '0123456789')) AS d, count(*) FILTER (starts_with(trim(line), '```')) OVER (PARTITION BY doc_id ORDER BY n) AS fences FROM m),
        k AS (SELECT *, CASE WHEN starts_with(t, '```') THEN 'fence' WHEN fences % 2 = 1 THEN 'code' WHEN t = '' THEN 'blank' WHEN h BETWEEN 1 AND 6 AND line[h + 1] = ' ' THEN 'heading'
                               WHEN length(line) - length(o) <= 3 AND length(t) >= 3 AND t[1] IN ('-', '*', '_') AND replace(t, t[1], '') = '' THEN 'rule'
                               WHEN length(t) >= 2 AND t[1] = '|' AND t[-1] = '|' THEN 'table' WHEN length(line) - length(o) <= 3 AND t[1] = '>' THEN 'quote'
                               WHEN length(line) - length(o) <= 3 AND (o[1] IN ('-', '*', '+') AND o[2] = ' ' OR d BETWEEN 1 AND 3 AND o[d + 1] IN ('.', ')') AND o[d + 2] = ' ') THEN 'list' ELSE 'paragraph' END AS kind FROM b),
        g AS (SELECT *, CASE WHEN kind IN ('list', 'paragraph') THEN 'text' ELSE kind END AS g FROM k),
        r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM (SELECT *, CASE WHEN g IN ('heading', 'fence') OR g IS DISTINCT FROM lag(g) OVER (PARTITION BY doc_id ORDER BY n) THEN 1 ELSE 0 END AS new FROM g)),
        y AS (SELECT *, CASE WHEN g <> 'text' THEN g WHEN bool_or(kind = 'list') OVER (PARTITION BY doc_id, run ORDER BY n) THEN 'list' ELSE 'paragraph' END AS type FROM r WHERE g NOT IN ('fence', 'blank', 'rule')),
        p AS (SELECT *, CASE type WHEN 'heading' THEN trim(rtrim(trim(ltrim(line, '#')), '#')) WHEN 'code' THEN line WHEN 'quote' THEN rtrim(CASE WHEN o[2] = ' ' THEN o[3:] ELSE o[2:] END) ELSE t END AS part FROM y),
        j AS (SELECT doc_id, min(n) AS n, type, trim(CASE WHEN type = 'paragraph' THEN string_agg(part, ' ' ORDER BY n) ELSE string_agg(part, chr(10) ORDER BY n) END, ' ' || chr(10)) AS text, max(CASE WHEN type = 'heading' THEN h ELSE 0 END) AS level FROM p GROUP BY doc_id, run, type)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS block_no, type, md5(text) AS md5, level::INT AS level FROM j WHERE text <> ''""",
    "location_labels": f"""WITH {_CHUNKS}, paged AS (SELECT *, char_start // 2000 AS p, char_end // 2000 AS q FROM chunks)
        SELECT chunk_id, chapter || ' — ' || book_id || CASE WHEN p = 0 THEN '' WHEN p = q THEN ' (p. ' || p || ')' ELSE ' (pp. ' || p || '-' || q || ')' END AS label FROM paged""",
    "library_listing": f"WITH {_CHUNKS} SELECT b.book_id, documents, chunk_count, chunk_count IS NOT NULL AS indexed FROM (SELECT source AS book_id, count(*) AS documents FROM documents GROUP BY 1) b LEFT JOIN (SELECT book_id, count(*) AS chunk_count FROM chunks GROUP BY 1) c USING (book_id)",
}
