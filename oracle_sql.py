"""Independent SQL (DuckDB dialect) for each registered query.

The driver's tables are views named after the parquet files.  Every
statement rebuilds its inputs from those views with the recipes of
FIXTURES.md, then computes the operator the plain relational way.
"""

from __future__ import annotations

CHUNK_SIZE = 1024
CHUNK_OVERLAP = 512
STEP = CHUNK_SIZE - CHUNK_OVERLAP
K = 8
TOKEN = r"'[\p{L}\p{N}]+'"

PARSED = """
parsed AS (
  SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, doc_id, lang,
         text AS parsed_content
  FROM documents)"""

# parse and quality queries: every 97th document fails to parse
PARSED_FAILING = PARSED.replace("text AS parsed_content", "CASE WHEN doc_id % 97 = 0 THEN NULL ELSE text END AS parsed_content")

WINDOWS = f"""
windows AS (
  SELECT path, (s - 1) // {STEP} AS chunk_index, substring(parsed_content, s, {CHUNK_SIZE}) AS chunked_text
  FROM (SELECT path, parsed_content,
               unnest(generate_series(1, greatest(length(parsed_content) - {CHUNK_OVERLAP}, 1), {STEP})) AS s
        FROM parsed WHERE length(parsed_content) > 0)),
chunk_rows AS (SELECT path, chunk_index, chunked_text, md5(chunked_text) AS chunk_id FROM windows),
chunk_index AS (
  SELECT chunk_id, min(path) AS path, min(chunked_text) AS chunked_text FROM chunk_rows GROUP BY chunk_id)"""

BM25 = f"""
doc_tokens AS (SELECT chunk_id, regexp_extract_all(lower(chunked_text), {TOKEN}) AS toks FROM chunk_index),
stats AS (SELECT count(*) AS n, sum(len(toks)) / count(*) AS avgdl FROM doc_tokens),
qterms AS (SELECT DISTINCT q, term FROM (
  SELECT q, unnest(regexp_extract_all(lower(qtext), {TOKEN})) AS term FROM qsrc)),
postings AS (
  SELECT term, chunk_id, dl, count(*) AS tf
  FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS term FROM doc_tokens)
  WHERE term IN (SELECT term FROM qterms)
  GROUP BY term, chunk_id, dl),
dfreq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scored AS (
  SELECT q, chunk_id,
         round(sum(ln(1 + (stats.n - df + 0.5) / (df + 0.5)) * tf * (1.2 + 1.0)
                   / (tf + 1.2 * ((1 - 0.75) + 0.75 * dl / stats.avgdl))), 9) AS score
  FROM postings JOIN dfreq USING (term) JOIN qterms USING (term) CROSS JOIN stats
  GROUP BY q, chunk_id),
keyword_all AS (
  SELECT q, chunk_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE score > 0),
keyword_hits AS (
  SELECT r.q AS item_id, r.rank, r.chunk_id, c.path, c.chunked_text
  FROM keyword_all r
  JOIN chunk_index c USING (chunk_id)
  WHERE r.rank <= {K})"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n"


BENCH_QUESTIONS = "\nqsrc AS (SELECT item_id AS q, text AS qtext FROM benchmark)"

SQL: dict[str, str] = {}

SQL["chunk_windows"] = _with(PARSED, WINDOWS) + """
SELECT path, chunk_index, chunk_id, CAST(length(chunked_text) AS BIGINT) AS chunk_chars FROM chunk_rows"""

SQL["chunk_rows"] = _with(PARSED, WINDOWS) + "SELECT path, chunked_text, chunk_id FROM chunk_rows"

SQL["dedup_chunks"] = _with(PARSED, WINDOWS) + "SELECT chunk_id, path, chunked_text FROM chunk_index"

SQL["topk_keyword"] = _with(PARSED, WINDOWS, BENCH_QUESTIONS, BM25) + """
SELECT item_id, CAST(rank AS BIGINT) AS rank, chunk_id, path FROM keyword_hits"""

SQL["keyword_postings"] = _with(PARSED, WINDOWS, BENCH_QUESTIONS, BM25) + """
SELECT item_id, CAST(rank AS BIGINT) AS rank, chunk_id FROM keyword_hits"""

SQL["build_context"] = _with(PARSED, WINDOWS, BENCH_QUESTIONS, BM25) + """
SELECT item_id, string_agg('Passage: ' || chunked_text || chr(10), '' ORDER BY rank) AS context
FROM keyword_hits GROUP BY item_id"""

SQL["source_list"] = _with(PARSED, WINDOWS, BENCH_QUESTIONS, BM25) + """
SELECT item_id, string_agg(path, '|' ORDER BY best_rank, path) AS sources
FROM (SELECT item_id, path, min(rank) AS best_rank FROM keyword_hits GROUP BY item_id, path)
GROUP BY item_id"""


# ---------------------------------------------------------------------------
# feedback -> evaluation set

ALOG = """
n_conv AS (SELECT max(conv_id) + 1 AS n FROM conversations),
users AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth, count(*) OVER (PARTITION BY conv_id) AS n_users
  FROM conversations WHERE role = 'user'),
picked AS (
  SELECT e.*, CASE WHEN (event_id % n) % 3 = 0 THEN (event_id % n + 1) % n ELSE event_id % n END AS conv_id, event_id // n AS round
  FROM events e CROSS JOIN n_conv),
alog AS (
  SELECT 'r' || CAST(u.conv_id AS VARCHAR) || '_' || CAST(u.turn AS VARCHAR) AS request_id, ts AS timestamp,
         'u' || CAST(user_id % 3 AS VARCHAR) AS source_id, 's' || CAST(event_id % 2 AS VARCHAR) AS step_id,
         CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'error' THEN 'negative' WHEN 'view' THEN 'unknown' END AS answer,
         CASE WHEN value > 35 THEN 'edit ' || CAST(event_id AS VARCHAR) ELSE '' END AS suggested_output,
         CASE event_type WHEN 'click' THEN 'true' WHEN 'signup' THEN 'false' END AS chunk_rating,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 AS position,
         event_id
  FROM picked p JOIN users u ON u.conv_id = p.conv_id AND u.nth = p.round % u.n_users),
dedup_text AS (
  SELECT * FROM alog WHERE answer IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY request_id, source_id ORDER BY timestamp DESC, event_id DESC) = 1),
dedup_ret AS (
  SELECT * FROM alog WHERE chunk_rating IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY request_id, source_id, position, step_id ORDER BY timestamp DESC, event_id DESC) = 1),
nested AS (
  SELECT request_id, source_id, step_id, max(timestamp) AS timestamp,
         list({'position': position, 'value': chunk_rating} ORDER BY position) AS ratings
  FROM dedup_ret GROUP BY request_id, source_id, step_id),
merged AS (
  SELECT coalesce(a.request_id, b.request_id) AS request_id, coalesce(a.step_id, b.step_id) AS step_id,
         coalesce(a.timestamp, b.timestamp) AS timestamp, coalesce(a.source_id, b.source_id) AS source_id,
         a.answer AS is_correct, a.suggested_output, b.ratings
  FROM dedup_text a FULL OUTER JOIN nested b ON a.request_id = b.request_id AND a.source_id = b.source_id)"""

REQLOG = """
reqlog AS (
  SELECT 'r' || CAST(c.conv_id AS VARCHAR) || '_' || CAST(c.turn AS VARCHAR) AS request_id, c.text AS request, n.text AS response, c.conv_id
  FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1
  WHERE c.role = 'user'),
attached AS (
  SELECT r.request_id, r.request, r.response, r.conv_id, m.is_correct,
         CASE WHEN m.suggested_output = '' THEN NULL ELSE m.suggested_output END AS suggested_output,
         m.source_id AS source_user, m.ratings
  FROM reqlog r LEFT JOIN merged m ON r.request_id = m.request_id),
classified AS (
  SELECT *,
         CASE WHEN is_correct = 'positive' THEN coalesce(suggested_output, response)
              WHEN is_correct = 'negative' THEN suggested_output END AS expected_response,
         CASE WHEN is_correct = 'positive' THEN 'thumbs_up' WHEN is_correct = 'negative' THEN 'thumbs_down_edited'
              ELSE 'no_feedback_provided' END AS source_tag,
         CASE WHEN ratings IS NULL THEN NULL ELSE nullif(array_to_string(list_transform(
             list_filter(generate_series(0, 7), lambda i: list_contains(
                 list_transform(list_filter(ratings, lambda r: r.value = 'true'), lambda r: r.position), i)),
             lambda i: 'd' || CAST((conv_id + i) % 20 AS VARCHAR)), '|'), '') END AS expected_uris
  FROM attached)"""

RATINGS_TEXT = "array_to_string(list_transform({col}, lambda r: CAST(r.position AS VARCHAR) || ':' || r.value), '|')"

SQL["dedup_latest"] = """
SELECT user_id, event_id, event_type, ts FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""

SQL["dedup_text"] = _with(ALOG) + """
SELECT request_id, source_id, step_id, timestamp, answer AS is_correct, suggested_output, event_id FROM dedup_text"""

SQL["dedup_retrieval"] = _with(ALOG) + """
SELECT request_id, source_id, step_id, CAST(position AS BIGINT) AS position, chunk_rating AS rating, event_id
FROM dedup_ret"""

SQL["nest_retrieval"] = _with(ALOG) + f"""
SELECT request_id, source_id, step_id, timestamp, {RATINGS_TEXT.format(col='ratings')} AS ratings FROM nested"""

SQL["merge_assessments"] = _with(ALOG) + f"""
SELECT request_id, step_id, timestamp, source_id, is_correct, suggested_output,
       {RATINGS_TEXT.format(col='ratings')} AS ratings FROM merged"""

SQL["attach_feedback"] = _with(ALOG, REQLOG) + f"""
SELECT request_id, request, response, is_correct, suggested_output, source_user,
       {RATINGS_TEXT.format(col='ratings')} AS ratings FROM attached"""

SQL["feedback_class"] = _with(ALOG, REQLOG) + """
SELECT request_id, source_user, is_correct, expected_response, source_tag FROM classified"""

SQL["chunk_ratings"] = _with(ALOG, REQLOG) + """
SELECT request_id, source_user, array_to_string(list_transform(ratings, lambda r: r.value), '|') AS chunk_at_i_relevance
FROM attached"""

SQL["trace_chunks"] = _with(ALOG, REQLOG) + """
SELECT request_id, array_to_string(list_transform(generate_series(0, 7), lambda i: 'd' || CAST((conv_id + i) % 20 AS VARCHAR)), '|') AS doc_uris,
       CAST(8 AS BIGINT) AS n_chunks
FROM reqlog"""

SQL["expected_context"] = _with(ALOG, REQLOG) + """
SELECT request_id, source_user, expected_uris FROM classified"""

SQL["eval_set_table"] = _with(ALOG, REQLOG) + """
SELECT request_id, expected_response, expected_uris, source_user, source_tag FROM classified"""

SQL["eval_set"] = _with(ALOG, REQLOG) + """
SELECT request, request_id, expected_response, expected_uris AS expected_retrieved_context, source_user, source_tag
FROM classified"""


# ---------------------------------------------------------------------------
# conversations

CONV = """
msgs AS (
  SELECT conv_id, list({'turn': turn, 'role': role, 'content': text} ORDER BY turn) AS messages
  FROM conversations GROUP BY conv_id),
view AS (
  SELECT conv_id,
         list_filter(messages, lambda m: m.role = 'user')[-1].content AS question,
         messages[1:len(messages) - 1] AS hist
  FROM msgs),
view2 AS (
  SELECT conv_id, question, hist,
         array_to_string(list_transform(hist, lambda m: CASE WHEN m.role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || m.content), chr(10)) AS history_text,
         list_filter(hist, lambda m: m.role IN ('user', 'assistant')) AS history_messages,
         len(hist) AS history_size
  FROM view),
searches AS (
  SELECT *, CASE WHEN history_size > 0 THEN 'Rewrite the last question as a standalone search query, using the conversation for context. Reply with the query only.' || chr(10) || '' || chr(10) || 'Conversation:' || chr(10) || '' || history_text || '' || chr(10) || '' || chr(10) || 'Question: ' || question END AS rewrite_prompt
  FROM view2)"""

MESSAGES_TEXT = "array_to_string(list_transform({col}, lambda m: m.role || ': ' || m.content), chr(10) || '---' || chr(10))"

CONV_QUESTIONS = "\nqsrc AS (SELECT conv_id AS q, question AS qtext FROM searches WHERE question IS NOT NULL)"

SQL["current_question"] = """
SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS question, arg_max(text, turn) AS last_message
FROM conversations GROUP BY conv_id"""

SQL["history_rows"] = """
SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c
JOIN (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) l USING (conv_id)
WHERE c.turn < l.last"""

SQL["format_history"] = _with(CONV) + """
SELECT conv_id, history_text,
       array_to_string(list_transform(list_filter(hist, lambda m: m.role IN ('user', 'assistant')),
           lambda m: CASE WHEN m.role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || m.content), chr(10)) AS history_chat_roles
FROM view2"""

SQL["history_messages"] = _with(CONV) + f"""
SELECT conv_id, {MESSAGES_TEXT.format(col='history_messages')} AS history_messages, CAST(len(history_messages) AS BIGINT) AS n_messages
FROM view2"""

SQL["search_text"] = _with(CONV) + """
SELECT conv_id, question, rewrite_prompt,
       CASE WHEN question IS NOT NULL AND rewrite_prompt IS NOT NULL THEN concat_ws(' ', question, history_messages[-1].content)
            ELSE question END AS search_text
FROM searches"""

# defined below, after the hashed-vector CTEs



# ---------------------------------------------------------------------------
# vectors

DIMS = 256

HASHED = f"""
cvec AS (
  SELECT chunk_id, b, CAST(count(*) AS DOUBLE) AS c FROM (
    SELECT chunk_id, ('0x' || substr(md5(t), 1, 7))::BIGINT % {DIMS} AS b
    FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(chunked_text), {TOKEN})) AS t FROM chunk_index))
  GROUP BY chunk_id, b),
cnorm AS (SELECT chunk_id, sqrt(sum(c * c)) AS n FROM cvec GROUP BY chunk_id),
qvec AS (
  SELECT q, b, CAST(count(*) AS DOUBLE) AS c FROM (
    SELECT q, ('0x' || substr(md5(t), 1, 7))::BIGINT % {DIMS} AS b
    FROM (SELECT q, unnest(regexp_extract_all(lower(qtext), {TOKEN})) AS t FROM qsrc))
  GROUP BY q, b),
qnorm AS (SELECT q, sqrt(sum(c * c)) AS n FROM qvec GROUP BY q),
sem_scored AS (
  SELECT q, chunk_id, round(sum(qvec.c * cvec.c) / (any_value(qnorm.n) * any_value(cnorm.n)), 9) AS score
  FROM qvec JOIN cvec USING (b) JOIN qnorm USING (q) JOIN cnorm USING (chunk_id)
  GROUP BY q, chunk_id),
sem_all AS (
  SELECT q, chunk_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, chunk_id) AS rank FROM sem_scored WHERE score > 0),
sem_hits AS (SELECT q AS item_id, chunk_id, rank FROM sem_all WHERE rank <= {K})"""

# rank fusion over the whole lists, cut only at the end
FUSED = """
fused AS (
  SELECT q AS item_id, chunk_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (
      SELECT q, chunk_id, rank FROM sem_all UNION ALL SELECT q, chunk_id, rank FROM keyword_all)
    GROUP BY q, chunk_id))"""

SQL["embed_chunks"] = _with(PARSED, WINDOWS, BENCH_QUESTIONS, HASHED) + """
SELECT chunk_id, CAST(sum(c) AS BIGINT) AS n_tokens, CAST(count(*) AS BIGINT) AS n_buckets,
       CAST(sum(c * c) AS BIGINT) AS sq_norm
FROM cvec GROUP BY chunk_id
UNION ALL
SELECT chunk_id, 0, 0, 0 FROM chunk_index WHERE chunk_id NOT IN (SELECT chunk_id FROM cvec)"""

SQL["embed_tfidf"] = _with(PARSED, WINDOWS, BENCH_QUESTIONS, HASHED) + """
, idf AS (SELECT b, ln((1 + (SELECT count(*) FROM chunk_index)) / (1.0 + count(*))) + 1 AS w FROM cvec GROUP BY b),
weighed AS (SELECT chunk_id, c * w AS x FROM cvec JOIN idf USING (b)),
normed AS (SELECT chunk_id, x / sqrt(sum(x * x) OVER (PARTITION BY chunk_id)) AS x FROM weighed)
SELECT chunk_id, CAST(count(*) AS BIGINT) AS n_buckets, round(sum(x), 9) AS weight_sum, round(max(x), 9) AS weight_max
FROM normed GROUP BY chunk_id
UNION ALL
SELECT chunk_id, 0, 0.0, 0.0 FROM chunk_index WHERE chunk_id NOT IN (SELECT chunk_id FROM cvec)"""

SQL["semantic_search"] = _with(PARSED, WINDOWS, BENCH_QUESTIONS, HASHED) + """
SELECT item_id, CAST(rank AS BIGINT) AS rank, chunk_id FROM sem_hits"""

SQL["topk_hybrid"] = _with(PARSED, WINDOWS, BENCH_QUESTIONS, BM25, HASHED, FUSED) + f"""
SELECT item_id, CAST(rank AS BIGINT) AS rank, chunk_id FROM fused WHERE rank <= {K}"""

SQL["topk_semantic"] = f"""
WITH ex AS (
  SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(generate_series(1, len(embedding))) AS i
  FROM embeddings),
cent AS (SELECT label, i, avg(x) AS c FROM ex GROUP BY label, i),
cn AS (SELECT label, sqrt(sum(c * c)) AS n FROM cent GROUP BY label),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM ex GROUP BY vec_id),
dots AS (SELECT cent.label, ex.vec_id, sum(cent.c * ex.x) AS d FROM cent JOIN ex ON cent.i = ex.i GROUP BY cent.label, ex.vec_id),
scored AS (SELECT dots.label, dots.vec_id, round(d / (cn.n * vn.n), 9) AS score
           FROM dots JOIN cn ON dots.label = cn.label JOIN vn ON dots.vec_id = vn.vec_id)
SELECT CAST(label AS BIGINT) AS label, CAST(rank AS BIGINT) AS rank, vec_id FROM (
  SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= {K}"""


SQL["topk_ann"] = SQL["topk_semantic"]  # the query probes all cells


# ---------------------------------------------------------------------------
# files, parsing, quality

RAW = """
raw AS (
  SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, doc_id, text,
         CASE WHEN doc_id % 97 = 0 THEN 3 ELSE strlen(text) END AS length,
         doc_id % 97 = 0 AS bad
  FROM documents)"""

HTML_TEXT = """trim(regexp_replace(
  replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace({col},
      '(?is)<!--.*?-->', ' ', 'g'),
      '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'),
      '(?is)<[^>]+>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'),
  '[ \\t\\r\\n]+', ' ', 'g'))"""

PARSE_ERROR = "'ERROR: content is not valid UTF-8 text'"

SQL["land_pages"] = """
SELECT '/landing/pages/page_' || CAST(page_id AS VARCHAR) || '.pdf' AS path, page_id,
       CASE WHEN strlen(html) > 0 THEN CAST(strlen(html) AS BIGINT) END AS length,
       CASE WHEN strlen(html) > 0 THEN 'SUCCESS' ELSE 'ERROR: page ' || CAST(page_id AS VARCHAR) || ' is empty' END AS status
FROM pages"""

SQL["parse_text"] = _with(RAW) + f"""
SELECT path,
       CASE WHEN bad THEN '' ELSE CAST(len(string_split(text, chr(12))) AS VARCHAR) END AS num_pages,
       CASE WHEN bad THEN '' ELSE replace(text, chr(12), chr(10)) END AS parsed_content,
       CASE WHEN bad THEN {PARSE_ERROR} ELSE 'SUCCESS' END AS parser_status
FROM raw"""

SQL["parse_html"] = f"""
SELECT page_id, {HTML_TEXT.format(col='html')} AS text, 'SUCCESS' AS parser_status FROM pages"""

SQL["parse_nullable"] = _with(RAW) + """
SELECT path, CASE WHEN bad THEN NULL ELSE replace(text, chr(12), chr(10)) END AS parsed_content FROM raw"""

SQL["parse_split"] = _with(RAW) + """
SELECT path, CAST(length AS BIGINT) AS length, CAST(length(text) AS BIGINT) AS n_chars FROM raw WHERE NOT bad"""

SQL["parse_errors"] = _with(RAW) + f"""
SELECT CASE WHEN bad THEN {PARSE_ERROR} ELSE 'SUCCESS' END AS status, count(*) AS n FROM raw GROUP BY 1"""

SQL["chunk_errors"] = _with(PARSED) + "SELECT 'SUCCESS' AS status, count(*) AS n FROM parsed"  # the window chunker rejects no text

SQL["chunk_words"] = _with(PARSED) + """
, words AS (
  SELECT path, list_filter(string_split_regex(parsed_content, '\\s+'), lambda w: w <> '') AS w
  FROM parsed WHERE parsed_content IS NOT NULL)
SELECT path, CAST((s - 1) // 150 AS BIGINT) AS chunk_index, md5(array_to_string(w[s:s + 199], ' ')) AS chunk_id
FROM (SELECT path, w, unnest(generate_series(1, greatest(len(w) - 50, 1), 150)) AS s FROM words WHERE len(w) > 0)"""

SQL["quality_metrics"] = _with(PARSED_FAILING, WINDOWS) + """
SELECT 'raw_files' AS table_name, count(*) AS total_records,
       count(*) FILTER (WHERE text IS NULL AND doc_id % 97 <> 0) AS null_content_count FROM documents
UNION ALL
SELECT 'parsed_docs', count(*), count(*) FILTER (WHERE parsed_content IS NULL) FROM parsed
UNION ALL
SELECT 'chunked_docs', count(*), count(*) FILTER (WHERE chunked_text IS NULL) FROM chunk_rows"""

SQL["expectations"] = _with(PARSED_FAILING, WINDOWS) + """
SELECT 'parsed_docs' AS table_name, 'valid_content' AS rule, count(*) FILTER (WHERE parsed_content IS NULL) AS failed,
       count(*) FILTER (WHERE parsed_content IS NOT NULL) AS passed, count(*) AS total FROM parsed
UNION ALL
SELECT 'parsed_docs', 'valid_path', count(*) FILTER (WHERE path IS NULL), count(*) FILTER (WHERE path IS NOT NULL), count(*) FROM parsed
UNION ALL
SELECT 'chunked_docs', 'valid_chunk', count(*) FILTER (WHERE chunked_text IS NULL), count(*) FILTER (WHERE chunked_text IS NOT NULL), count(*)
FROM chunk_rows
UNION ALL
SELECT 'chunked_docs', 'valid_chunk_id', count(*) FILTER (WHERE chunk_id IS NULL), count(*) FILTER (WHERE chunk_id IS NOT NULL), count(*)
FROM chunk_rows"""

SQL["stage_counts"] = _with(PARSED_FAILING, WINDOWS) + """
SELECT 'raw_files' AS stage, count(*) AS rows FROM documents
UNION ALL SELECT 'parsed_docs', count(*) FROM parsed WHERE parsed_content IS NOT NULL
UNION ALL SELECT 'chunked_docs', count(*) FROM chunk_rows"""

SQL["flatten_columns"] = _with(ALOG) + """
SELECT request_id, timestamp, source_id AS source__id, step_id,
       CASE WHEN answer IS NOT NULL THEN '{"answer_correct":{"value":"' || answer || '"}}' END AS text_assessment__ratings,
       CASE WHEN answer IS NOT NULL THEN suggested_output END AS text_assessment__suggested_output,
       CASE WHEN chunk_rating IS NOT NULL THEN position END AS retrieval_assessment__position,
       CASE WHEN chunk_rating IS NOT NULL THEN step_id END AS retrieval_assessment__step_id,
       CASE WHEN chunk_rating IS NOT NULL THEN '{"answer_correct":{"value":"' || chunk_rating || '"}}' END AS retrieval_assessment__ratings,
       event_id
FROM alog"""

SQL["user_key"] = """
SELECT conv_id, turn, substring(lower(replace(split_part('Rev.' || role || '.No' || CAST(conv_id AS VARCHAR) || '@Example.org', '@', 1), '.', '')), 1, 35) AS user_key
FROM conversations"""


# ---------------------------------------------------------------------------
# change sets and streaming

SNAPSHOTS = f"""
snap_rows AS (
  SELECT p.lang, w.path, w.chunked_text, md5(w.chunked_text) AS chunk_id
  FROM (SELECT path, substring(parsed_content, s, {CHUNK_SIZE}) AS chunked_text FROM (
          SELECT path, parsed_content,
                 unnest(generate_series(1, greatest(length(parsed_content) - {CHUNK_OVERLAP}, 1), {STEP})) AS s
          FROM parsed WHERE length(parsed_content) > 0)) w
  JOIN parsed p USING (path)),
old_index AS (SELECT chunk_id, min(path) AS path FROM snap_rows WHERE lang <> 'de' GROUP BY chunk_id),
new_index AS (SELECT chunk_id, min(path) AS path FROM snap_rows WHERE lang <> 'fr' GROUP BY chunk_id)"""

SQL["table_changes"] = _with(PARSED, SNAPSHOTS) + """
SELECT coalesce(n.chunk_id, o.chunk_id) AS chunk_id,
       CASE WHEN o.chunk_id IS NULL THEN 'insert' WHEN n.chunk_id IS NULL THEN 'delete' ELSE 'update' END AS change_type,
       CASE WHEN n.chunk_id IS NULL THEN o.path ELSE n.path END AS path
FROM old_index o FULL OUTER JOIN new_index n ON o.chunk_id = n.chunk_id
WHERE o.chunk_id IS NULL OR n.chunk_id IS NULL OR o.path IS DISTINCT FROM n.path"""

SQL["apply_changes"] = _with(PARSED, SNAPSHOTS) + "SELECT chunk_id, path FROM new_index"

SQL["stream_parsed"] = SQL["parse_nullable"]
SQL["stream_chunks"] = SQL["chunk_rows"]
SQL["stream_expectations"] = SQL["expectations"]
SQL["stream_sync"] = f"""
SELECT e.chunk_id, c.path, n_tokens, n_buckets, sq_norm
FROM ({SQL["embed_chunks"]}) e JOIN ({SQL["dedup_chunks"]}) c ON e.chunk_id = c.chunk_id"""
TOKS = "regexp_extract_all(lower({col}), " + TOKEN.replace("{", "{{").replace("}", "}}") + ")"

LANDINGS = f"""
landed AS (
  SELECT 1 AS landing, path, parsed_content AS text FROM parsed WHERE lang <> 'de'
  UNION ALL
  SELECT 2, path, CASE WHEN lang = 'es' THEN 'Second edition. ' || parsed_content ELSE parsed_content END FROM parsed WHERE lang <> 'fr'),
landed_rows AS (
  SELECT DISTINCT landing, path, substring(text, s, {CHUNK_SIZE}) AS chunked_text FROM (
    SELECT landing, path, text, unnest(generate_series(1, greatest(length(text) - {CHUNK_OVERLAP}, 1), {STEP})) AS s
    FROM landed WHERE length(text) > 0)),
landed_keys AS (
  SELECT landing, md5(chunked_text) AS chunk_id, any_value(chunked_text) AS chunked_text, min(path) AS path, count(*) AS n_refs
  FROM landed_rows GROUP BY landing, md5(chunked_text))"""

SQL["stream_resync"] = _with(PARSED, LANDINGS) + f"""
SELECT chunk_id, path, n_refs, CAST(len({TOKS.format(col='chunked_text')}) AS BIGINT) AS n_tokens FROM landed_keys WHERE landing = 2"""
SQL["change_feed"] = _with(PARSED, LANDINGS) + """
SELECT coalesce(n.chunk_id, o.chunk_id) AS chunk_id,
       CASE WHEN o.chunk_id IS NULL THEN 'insert' WHEN n.chunk_id IS NULL THEN 'delete' ELSE 'update' END AS change_type,
       coalesce(n.path, o.path) AS path, coalesce(n.n_refs, o.n_refs) AS n_refs
FROM (SELECT * FROM landed_keys WHERE landing = 1) o FULL OUTER JOIN (SELECT * FROM landed_keys WHERE landing = 2) n ON o.chunk_id = n.chunk_id
WHERE o.chunk_id IS NULL OR n.chunk_id IS NULL OR o.path <> n.path OR o.n_refs <> n.n_refs"""
SQL["scan_files"] = """
SELECT doc_id % (SELECT count(*) // 64 + 1 FROM documents) AS bucket, md5(coalesce(text, '')) AS text_md5 FROM documents"""
SQL["stream_files"] = SQL["scan_files"]


# ---------------------------------------------------------------------------
# evaluation and monitoring

GOLD = """
gold AS (
  SELECT DISTINCT d.doc_id, b.item_id, d.source || '/' || CAST(d.doc_id AS VARCHAR) || '.txt' AS path
  FROM documents d JOIN benchmark b ON contains(d.text, b.text))"""

RETRIEVAL = """
paths AS (SELECT DISTINCT chunk_id, path FROM chunk_rows),
hit_paths AS (SELECT h.item_id, h.rank, p.path FROM keyword_hits h JOIN paths p USING (chunk_id)),
per_q AS (
  SELECT g.item_id, count(*) AS n_expected,
         count(*) FILTER (WHERE h.path IS NOT NULL) AS n_found
  FROM (SELECT DISTINCT item_id, path FROM gold) g
  LEFT JOIN (SELECT DISTINCT item_id, path FROM hit_paths) h USING (item_id, path)
  GROUP BY g.item_id),
rel AS (
  SELECT h.item_id, count(DISTINCT h.rank) AS n_rel, min(h.rank) AS first_rank
  FROM hit_paths h JOIN (SELECT DISTINCT item_id, path FROM gold) g USING (item_id, path)
  GROUP BY h.item_id),
metrics AS (
  SELECT p.item_id, p.n_expected, p.n_found, p.n_found / p.n_expected AS recall,
         coalesce(r.n_rel, 0) / 8.0::DOUBLE AS precision_at_k,
         CAST(coalesce(r.n_rel, 0) > 0 AS INTEGER) AS hit,
         coalesce(1.0::DOUBLE / r.first_rank, 0.0) AS reciprocal_rank
  FROM per_q p LEFT JOIN rel r USING (item_id))"""

SQL["gold_pairs"] = _with(GOLD) + "SELECT doc_id, item_id FROM gold"

SQL["retrieval_metrics"] = _with(PARSED, WINDOWS, BENCH_QUESTIONS, BM25, GOLD, RETRIEVAL) + "SELECT * FROM metrics"

SQL["eval_summary"] = _with(PARSED, WINDOWS, BENCH_QUESTIONS, BM25, GOLD, RETRIEVAL) + """
SELECT count(*) AS n_questions, round(avg(recall), 9) AS mean_recall, round(avg(precision_at_k), 9) AS mean_precision_at_k,
       round(avg(hit), 9) AS mean_hit, round(avg(reciprocal_rank), 9) AS mean_reciprocal_rank
FROM metrics"""


SQL["answer_match"] = _with(ALOG, REQLOG) + f"""
, toks AS (
  SELECT request_id, source_user, {TOKS.format(col='response')} AS a, {TOKS.format(col='expected_response')} AS e
  FROM classified WHERE expected_response IS NOT NULL),
common AS (
  SELECT request_id, source_user, a, e,
         list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)),
                                                                 len(list_filter(e, lambda x: x = t))))) AS c
  FROM toks)
SELECT request_id, source_user,
       CAST(array_to_string(a, ' ') = array_to_string(e, ' ') AS INTEGER) AS exact_match,
       CASE WHEN len(a) + len(e) > 0 THEN 2.0::DOUBLE * coalesce(c, 0) / (len(a) + len(e)) ELSE 0.0 END AS token_f1
FROM common"""

SAMPLE = "('0x' || substr(md5({col}), 1, 7))::BIGINT % 10000 < 8000"

SQL["sample_requests"] = _with(REQLOG.split("attached AS")[0].rstrip().rstrip(",")) + f"""
SELECT request_id FROM reqlog WHERE {SAMPLE.format(col='request_id')}"""

TRAFFIC = f"""
served AS (SELECT * FROM reqlog WHERE response IS NOT NULL),
qsrc AS (SELECT request_id AS q, request AS qtext FROM served)"""

TRAFFIC_CTX = f"""
contexts AS (
  SELECT item_id AS request_id, string_agg('Passage: ' || chunked_text || chr(10), '' ORDER BY rank) AS context
  FROM keyword_hits GROUP BY item_id),
traffic AS (SELECT s.*, c.context FROM served s LEFT JOIN contexts c USING (request_id))"""

def share(part_of, whole):
    return (f"CASE WHEN len(list_distinct({whole})) > 0 THEN "
            f"len(list_intersect(list_distinct({part_of}), list_distinct({whole}))) / len(list_distinct({whole})) END")

GROUNDED = share(TOKS.format(col='context'), TOKS.format(col='response'))
RELEVANT = share(TOKS.format(col='response'), TOKS.format(col='request'))

REQLOG_ONLY = REQLOG.split("attached AS")[0].rstrip().rstrip(",")

SQL["groundedness"] = _with(PARSED, WINDOWS, REQLOG_ONLY, TRAFFIC, BM25, TRAFFIC_CTX) + f"""
SELECT request_id, {GROUNDED} AS groundedness FROM traffic"""

SQL["relevance"] = _with(REQLOG_ONLY) + f"SELECT request_id, {RELEVANT} AS relevance FROM reqlog"

STOP_WORDS = {
    'en': ['the', 'and', 'of', 'to', 'in', 'is', 'that', 'it', 'for', 'with', 'as', 'on', 'was', 'this', 'by'],
    'fr': ['le', 'la', 'les', 'de', 'des', 'et', 'un', 'une', 'est', 'en', 'du', 'que', 'qui', 'dans', 'pour'],
    'de': ['der', 'die', 'das', 'und', 'ist', 'nicht', 'ein', 'eine', 'zu', 'den', 'von', 'mit', 'sich', 'auf', 'für'],
    'es': ['el', 'la', 'los', 'las', 'de', 'y', 'en', 'que', 'un', 'una', 'es', 'por', 'con', 'para', 'del'],
}
SAFETY_PATTERNS = [
    '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}',
    '\\+\\d{1,3} \\(\\d{3}\\) \\d{3}-\\d{4}',
    '\\b\\d{16}\\b',
    '(?i)(api[_-]?key|secret|password|token)\\s*[=:]\\s*\\"?[A-Za-z0-9]{16,}',
    '\\b\\d{1,3}(\\.\\d{1,3}){3}\\b',
]


def _lang(col):
    counts = {l: f"len(list_filter({TOKS.format(col=col)}, lambda t: t IN ({', '.join(repr(w) for w in ws)})))"
              for l, ws in STOP_WORDS.items()}
    m = "greatest(" + ", ".join(counts.values()) + ")"
    return (f"CASE WHEN {m} = 0 THEN NULL WHEN {counts['en']} = {m} THEN 'en' WHEN {counts['fr']} = {m} THEN 'fr' "
            f"WHEN {counts['de']} = {m} THEN 'de' ELSE 'es' END")


def _safety(col):
    return "coalesce(" + " + ".join(f"len(regexp_extract_all({col}, '{p}'))" for p in SAFETY_PATTERNS) + ", 0)"


SQL["language_rule"] = f"""
SELECT doc_id, lang, detected_lang, coalesce(detected_lang = lang, false) AS language_ok
FROM (SELECT doc_id, lang, {_lang('text')} AS detected_lang FROM documents)"""

SQL["language_model_rule"] = """
WITH cleaned AS (
  SELECT doc_id, lang, trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) AS t FROM documents),
chars AS (
  SELECT doc_id, lang, list_transform(string_split(' ' || t || ' ', ''), lambda x: unicode(x)) AS c FROM cleaned WHERE length(t) > 0),
grams AS (
  SELECT doc_id, lang, unnest(list_transform(range(1, len(c) - 1), lambda i: (c[i] * 961 + c[i + 1] * 31 + c[i + 2]) % 16384)) AS bucket
  FROM chars),
per_doc AS (SELECT doc_id, lang, bucket, count(*) AS n FROM grams GROUP BY ALL),
counts AS (SELECT lang, bucket, sum(n) AS n FROM per_doc WHERE lang IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS total FROM counts GROUP BY lang),
weights AS (
  SELECT b.bucket, t.lang AS detected, round_even(1000 * ln((coalesce(c.n, 0) + 1) / (t.total + 16384)), 0)::BIGINT AS w
  FROM (SELECT DISTINCT bucket FROM per_doc) b CROSS JOIN totals t
  LEFT JOIN counts c ON c.lang = t.lang AND c.bucket = b.bucket),
scores AS (SELECT doc_id, detected, sum(p.n * w) AS score FROM per_doc p JOIN weights USING (bucket) GROUP BY ALL),
best AS (
  SELECT doc_id, detected FROM scores
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, detected) = 1)
SELECT d.doc_id, d.lang, b.detected AS detected_lang, coalesce(b.detected = d.lang, false) AS language_ok
FROM documents d LEFT JOIN best b USING (doc_id)"""

SQL["safety_rule"] = f"""
SELECT doc_id, safety_hits, safety_hits = 0 AS safety_ok FROM (SELECT doc_id, {_safety('text')} AS safety_hits FROM documents)"""

SQL["monitor_summary"] = _with(PARSED, WINDOWS, REQLOG_ONLY, TRAFFIC, BM25, TRAFFIC_CTX) + f"""
, monitored AS (
  SELECT {GROUNDED} AS g, {RELEVANT} AS r, {_lang('response')} AS lang, {_safety('response')} AS hits
  FROM traffic WHERE {SAMPLE.format(col='request_id')})
SELECT count(*) AS n_requests,
       avg(CASE WHEN coalesce(g >= 0.5, false) THEN 1.0 ELSE 0.0 END) AS groundedness_pass,
       avg(CASE WHEN coalesce(r >= 0.2, false) THEN 1.0 ELSE 0.0 END) AS relevance_pass,
       avg(CASE WHEN coalesce(lang = 'es', false) THEN 1.0 ELSE 0.0 END) AS language_pass,
       avg(CASE WHEN hits = 0 THEN 1.0 ELSE 0.0 END) AS safety_pass
FROM monitored"""

SQL["stream_monitor"] = SQL["monitor_summary"]


# ---------------------------------------------------------------------------
# end-to-end plans

SQL["ingest_gold"] = SQL["chunk_rows"]

SQL["layout_lookup"] = f"SELECT * FROM ({SQL['chunk_rows']}) WHERE chunk_id BETWEEN '80' AND '8f'"

SQL["ingest_counts"] = _with(PARSED_FAILING, WINDOWS) + """
SELECT 'raw_files' AS stage, count(*) AS rows FROM documents
UNION ALL SELECT 'parsed_docs', count(*) FROM parsed WHERE parsed_content IS NOT NULL
UNION ALL SELECT 'parse_errors', count(*) FROM parsed WHERE parsed_content IS NULL
UNION ALL SELECT 'chunk_errors', 0
UNION ALL SELECT 'chunked_docs', count(*) FROM chunk_rows"""


def _cut_pieces(source: str, sep: str) -> str:
    """Pieces (path, pos, t) longer than a chunk cut before every ``sep``; the others as they are."""
    return f"""
  SELECT path, pos, t FROM {source} WHERE length(t) <= {CHUNK_SIZE}
  UNION ALL
  SELECT path, pos + coalesce(sum(length(piece)) OVER (PARTITION BY path, pos ORDER BY i
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT, piece
  FROM (SELECT path, pos, i, CASE WHEN i = 1 THEN part ELSE {sep} || part END AS piece
        FROM (SELECT path, pos, unnest(string_split(t, {sep})) AS part,
                     generate_subscripts(string_split(t, {sep}), 1) AS i
              FROM {source} WHERE length(t) > {CHUNK_SIZE}))"""


SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# A chunk runs from a piece's start to the last piece end within the size.  The next one starts pos
# the first piece that leaves at most the overlap behind and room for the piece that did not fit.
SQL["chunk_recursive"] = f"""
WITH RECURSIVE {PARSED},
whole AS (SELECT path, 0::BIGINT AS pos, parsed_content AS t FROM parsed WHERE length(parsed_content) > 0),
paragraphs AS ({_cut_pieces("whole", "chr(10) || chr(10)")}),
lines AS ({_cut_pieces("paragraphs", "chr(10)")}),
parts AS ({_cut_pieces("lines", "' '")}),
starts AS (
  SELECT path, pos FROM parts WHERE length(t) BETWEEN 1 AND {CHUNK_SIZE}
  UNION ALL
  SELECT path, pos + unnest(range(length(t))) FROM parts WHERE length(t) > {CHUNK_SIZE}),
edges AS (
  SELECT s.path, list(s.pos ORDER BY s.pos) AS starts, list(s.pos ORDER BY s.pos)[2:] || [any_value(length(w.t))] AS ends,
         any_value(length(w.t)) AS n
  FROM starts s JOIN whole w USING (path) GROUP BY s.path),
chunks AS (
  SELECT path, 0 AS k, 0::BIGINT AS s, list_max(list_filter(ends, lambda x: x <= {CHUNK_SIZE})) AS e FROM edges
  UNION ALL
  SELECT path, k + 1, s2, list_max(list_filter(ends, lambda x: x <= s2 + {CHUNK_SIZE}))
  FROM (SELECT path, k, ends,
               list_min(list_filter(starts, lambda x: x >= e - {CHUNK_OVERLAP} AND x >= after - {CHUNK_SIZE})) AS s2
        FROM (SELECT c.path, c.k, c.e, d.starts, d.ends, list_min(list_filter(d.ends, lambda x: x > c.e)) AS after
              FROM chunks c JOIN edges d USING (path) WHERE c.e < d.n))),
texts AS (
  SELECT path, k, regexp_replace(substring(parsed_content, s + 1, e - s), '^{SPACES}+|{SPACES}+$', '', 'g') AS chunked_text
  FROM chunks JOIN parsed USING (path))
SELECT path, (row_number() OVER (PARTITION BY path ORDER BY k) - 1)::INTEGER AS chunk_index,
       md5(chunked_text) AS chunk_id, length(chunked_text)::BIGINT AS chunk_chars
FROM texts WHERE chunked_text <> ''"""

PROMPTS = _with(PARSED, WINDOWS, CONV, CONV_QUESTIONS, BM25, HASHED, FUSED) + f"""
, contexts AS (
  SELECT f.item_id AS conv_id, string_agg('Passage: ' || c.chunked_text || chr(10), '' ORDER BY f.rank) AS context
  FROM fused f JOIN chunk_index c USING (chunk_id) WHERE f.rank <= 8 GROUP BY f.item_id),
prompts AS (
  SELECT s.conv_id,
         list_concat([{{'role': 'system', 'content': 'Answer the question using only the passages below. If they do not contain the answer, say so.' || chr(10) || '' || chr(10) || 'Context: ' || coalesce(context, '')}}],
                     list_transform(s.history_messages, lambda m: {{'role': m.role, 'content': m.content}}),
                     [{{'role': 'user', 'content': s.question}}]) AS prompt
  FROM searches s LEFT JOIN contexts c USING (conv_id) WHERE s.question IS NOT NULL)"""

SQL["build_prompt"] = PROMPTS + f"""
SELECT conv_id, {MESSAGES_TEXT.format(col='prompt')} AS prompt, CAST(len(prompt) AS BIGINT) AS n_messages FROM prompts"""

WORDS = r"'[\p{L}\p{N}_]+'"

# the sentence of the passages that shares the most words with the question; the earliest of equals
SQL["batch_answer"] = PROMPTS + f"""
, answer_asks AS (
  SELECT conv_id, list_distinct(regexp_extract_all(lower(prompt[-1].content), {WORDS})) AS words,
         string_split_regex(regexp_replace(string_split(prompt[1].content, 'Context:')[-1],
                                           '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+') AS sentences
  FROM prompts),
answers_scored AS (
  SELECT conv_id, i, regexp_replace(sentence, '^{SPACES}+|{SPACES}+$', '', 'g') AS sentence,
         len(list_intersect(words, list_distinct(regexp_extract_all(lower(sentence), {WORDS})))) AS shared
  FROM (SELECT conv_id, words, unnest(sentences) AS sentence, generate_subscripts(sentences, 1) AS i FROM answer_asks))
SELECT a.conv_id, coalesce(b.answer, '') AS answer
FROM answer_asks a LEFT JOIN (SELECT conv_id, arg_max(sentence, shared * 1000000 - i) AS answer
                        FROM answers_scored WHERE sentence <> '' GROUP BY conv_id) b USING (conv_id)"""
