"""The registered queries as ANSI SQL over the given tables, written independently of the Spark code."""

from __future__ import annotations

# Whitespace of a Unicode-aware \s, as a character class of the checking engine's regex dialect.
_WS = r"[\t-\r\x1c-\x20\x85\p{Z}]+"


def ws(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_WS}', ' ', 'g'))"


MAIL = """
f AS (SELECT 0 AS i, 'INBOX' AS folder UNION ALL SELECT 1, 'Archive' UNION ALL SELECT 2, 'Receipts'),
mail AS (
SELECT d.doc_id, d.doc_id * 4 + f.i AS seq, f.i AS folder_ord,
       CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE concat('<', cast(d.doc_id AS varchar), '@example.com>') END AS message_id,
       concat('Note ', cast(d.doc_id AS varchar), ' from ', d.source) AS subject,
       concat(d.source, '@example.com') AS sender,
       concat('team-', d.lang, '@example.com, all@example.com') AS to_raw,
       CASE WHEN d.doc_id % 13 = 0 THEN 'not-a-real-email-date'
            ELSE concat(cast(d.doc_id % 28 + 1 AS varchar), ' Apr 2026 09:15:00 ',
                        CASE WHEN d.doc_id % 2 = 0 THEN '+0000' ELSE '-0500' END) END AS date_raw,
       d.text AS body, f.folder AS folder, d.doc_id * 4 + f.i + 1 AS imap_uid,
       concat('FLAGS (', chr(92), 'Seen',
              CASE WHEN l.quality = 1 AND f.i = 0 THEN concat(' ', chr(92), 'Flagged') ELSE '' END,
              CASE WHEN l.toxic = 1 THEN ' junk' ELSE '' END,
              CASE WHEN d.doc_id % 5 = 0 THEN concat(' lang-', d.lang) ELSE '' END, ')') AS flags_raw,
       DATE '2026-04-01' + cast(d.doc_id % 28 AS integer) AS received_date
FROM documents d CROSS JOIN f LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE f.i <= d.doc_id % 3)"""

NORM = f"""{MAIL},
cleaned AS (
SELECT *, {ws("coalesce(message_id, '')")} AS mid, {ws("subject")} AS subj, {ws("sender")} AS sndr, {ws("body")} AS txt,
       string_split(regexp_extract(flags_raw, 'FLAGS \\(([^)]*)\\)', 1), ' ') AS flags,
       [trim(r) for r in string_split(to_raw, ',') if trim(r) <> ''] AS recipients,
       regexp_extract(date_raw, '([+-][0-9]{{4}})$', 1) AS tz,
       try_strptime(regexp_extract(date_raw, '^(.*) [+-][0-9]{{4}}$', 1), '%d %b %Y %H:%M:%S') AS local_at
FROM mail),
searchable AS (
SELECT *, CASE WHEN subj <> '' AND txt <> '' THEN subj || chr(10) || chr(10) || txt ELSE subj || txt END AS searchable_text,
       [k for k in flags if left(k, 1) <> chr(92)] AS keywords,
       local_at - to_hours(cast(tz[1:3] AS integer)) AS sent_at,
       strftime(local_at, '%Y-%m-%dT%H:%M:%S') || tz[1:3] || ':' || tz[4:5] AS sent_at_iso
FROM (SELECT * REPLACE (CASE WHEN local_at IS NULL THEN '+0000' ELSE tz END AS tz) FROM cleaned)),
norm AS (
SELECT *, sha256(CASE WHEN mid <> '' THEN mid
                 ELSE concat_ws('|', sndr, {ws("date_raw")}, subj, searchable_text) END) AS fingerprint,
       sha256(searchable_text) AS content_checksum, nullif(mid, '') AS source_message_id
FROM searchable)"""

MERGED = f"""{NORM},
merged AS (
SELECT fingerprint, min(seq) AS first_seq, count(*) AS copies,
       arg_min(source_message_id, seq) AS source_message_id, arg_min(subj, seq) AS subject, arg_min(sndr, seq) AS sender,
       arg_min(sent_at, seq) AS sent_at, arg_min(content_checksum, seq) AS content_checksum,
       arg_min(searchable_text, seq) AS searchable_text, arg_min(array_to_string(recipients, ','), seq) AS recipients,
       string_agg(folder, '|' ORDER BY seq) AS folders,
       string_agg(folder || '=' || imap_uid, '|' ORDER BY seq) AS folder_uids,
       string_agg(folder || ':' || array_to_string(flags, ','), '|' ORDER BY seq) AS folder_flags,
       coalesce(string_agg(CASE WHEN len(keywords) > 0 THEN folder || ':' || array_to_string(keywords, ',') END, '|' ORDER BY seq), '') AS folder_keywords
FROM norm GROUP BY fingerprint)"""

TERMS = f"""{NORM},
terms AS (
SELECT fingerprint AS document_key, coalesce(source_message_id, fingerprint) AS message_ref, folder AS folder_name,
       'flag' AS term_type, unnest(flags) AS term, sent_at FROM norm
UNION ALL
SELECT fingerprint, coalesce(source_message_id, fingerprint), folder, 'keyword', unnest(keywords), sent_at FROM norm)"""

_COUNTS = """count(*) AS {n}, count(DISTINCT document_key) AS message_count,
       count(DISTINCT message_ref) AS unique_message_refs"""
_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"

WINDOW = ("2026-04-05 00:00:00", "2026-04-20 00:00:00")
LOOKBACK_DAYS = 14
CHUNK_LIMIT = 1500
HASH_DIMENSIONS = 256

# The fetch of one incremental run over the mailbox fixture; the server has lost every UID divisible by 11.
SYNC = f"""{NORM},
server AS (SELECT folder, imap_uid AS uid FROM mail WHERE imap_uid % 11 <> 0),
status AS (SELECT folder, count(*) AS message_count, 999 AS uidvalidity, max(uid) + 1 AS uidnext FROM server GROUP BY folder),
stored_state AS (SELECT folder, CASE WHEN folder = 'Receipts' THEN 998 ELSE 999 END AS uidvalidity,
                        max(imap_uid) - 400 AS last_synced_uid FROM mail GROUP BY folder),
plan AS (
SELECT s.folder, f.i AS folder_ord, s.message_count, s.uidvalidity, s.uidnext, st.last_synced_uid,
       CASE WHEN st.uidvalidity = s.uidvalidity AND st.last_synced_uid IS NOT NULL THEN 'incremental' ELSE 'full' END AS sync_mode
FROM status s JOIN f ON f.folder = s.folder LEFT JOIN stored_state st ON st.folder = s.folder),
fetched AS (
SELECT n.*, p.sync_mode FROM norm n JOIN plan p ON p.folder = n.folder JOIN server s ON s.folder = n.folder AND s.uid = n.imap_uid
WHERE (p.sync_mode = 'full' AND n.received_date >= DATE '2026-04-28' - 30)
   OR (p.sync_mode = 'incremental' AND n.imap_uid BETWEEN p.last_synced_uid + 1 AND p.uidnext - 1)),
after_upsert AS (
SELECT fingerprint, folder, folder_ord, CASE WHEN sync_mode = 'incremental' THEN imap_uid END AS uid, true AS refetched FROM fetched
UNION ALL
SELECT fingerprint, folder, folder_ord, imap_uid, false FROM norm WHERE fingerprint NOT IN (SELECT fingerprint FROM fetched)),
missing AS (
SELECT a.* FROM after_upsert a WHERE a.uid IS NOT NULL
   AND NOT EXISTS (SELECT 1 FROM server s WHERE s.folder = a.folder AND s.uid = a.uid)),
kept AS (SELECT a.* FROM after_upsert a
         WHERE NOT EXISTS (SELECT 1 FROM missing m WHERE m.fingerprint = a.fingerprint AND m.folder = a.folder)),
gone AS (SELECT DISTINCT fingerprint FROM after_upsert WHERE fingerprint NOT IN (SELECT fingerprint FROM kept))"""

AREAS = "areas AS (SELECT concat('area-', cast(r_regionkey AS varchar)) AS uuid, r_name AS title FROM region)"
PROJECTS = """projects AS (
SELECT concat('project-', cast(c.c_custkey AS varchar)) AS uuid, c.c_name AS title,
       concat('area-', cast(n.n_regionkey AS varchar)) AS area_uuid,
       CASE WHEN c.c_custkey % 4 = 0 THEN '   ' WHEN c.c_custkey % 4 = 1 THEN NULL ELSE c.c_mktsegment END AS notes,
       CASE WHEN c.c_acctbal < 0 THEN 'completed' ELSE 'incomplete' END AS status, c.c_custkey % 17 = 0 AS trashed
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey),
open_projects AS (SELECT uuid, title, area_uuid, notes, status FROM projects WHERE status = 'incomplete' AND NOT trashed)"""
HEADINGS = """headings AS (
SELECT DISTINCT concat('heading-', cast(o.o_custkey AS varchar), '-', substr(o.o_orderpriority, 1, 1)) AS uuid,
       o.o_orderpriority AS title, concat('project-', cast(o.o_custkey AS varchar)) AS project_uuid, 'incomplete' AS status
FROM orders o)"""
TODOS = """raw_todos AS (
SELECT concat('todo-', cast(o.o_orderkey AS varchar)) AS uuid,
       CASE WHEN o.o_orderkey % 50 = 0 THEN '(untitled to-do)' ELSE concat('Order ', cast(o.o_orderkey AS varchar)) END AS title,
       concat('project-', cast(o.o_custkey AS varchar)) AS project_uuid,
       concat('heading-', cast(o.o_custkey AS varchar), '-', substr(o.o_orderpriority, 1, 1)) AS heading_uuid,
       CASE WHEN o.o_orderkey % 3 = 0 THEN concat('Total ', cast(cast(floor(o.o_totalprice) AS bigint) AS varchar)) ELSE '' END AS notes,
       CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'canceled' ELSE 'incomplete' END AS status,
       o.o_orderkey % 29 = 0 AS trashed, o.o_orderkey % 2 = 0 AS has_checklist
FROM orders o),
open_todos AS (SELECT * FROM raw_todos WHERE status = 'incomplete' AND NOT trashed),
items AS (
SELECT concat('check-', cast(l_orderkey AS varchar), '-', cast(l_linenumber AS varchar), '-', cast(l_partkey AS varchar),
              '-', cast(l_suppkey AS varchar)) AS uuid,
       concat('todo-', cast(l_orderkey AS varchar)) AS todo_uuid, l_linenumber AS pos,
       concat('Part ', cast(l_partkey AS varchar)) AS title,
       CASE l_linestatus WHEN 'F' THEN 'completed' ELSE 'incomplete' END AS status
FROM lineitem),
checklist AS (SELECT i.* FROM items i WHERE i.todo_uuid IN (SELECT uuid FROM open_todos WHERE has_checklist))"""
NOTES = f"""{PROJECTS}, {TODOS},
notes AS (
SELECT uuid AS item_uuid, 'project' AS item_type, title, notes AS content, NULL AS project_uuid, area_uuid
FROM open_projects WHERE trim(notes) <> ''
UNION ALL
SELECT uuid, 'to-do', title, notes, project_uuid, NULL FROM open_todos WHERE trim(notes) <> '')"""

SUMMARIES = f"""base AS (SELECT conv_id, turn, role, {ws("text")} AS t FROM conversations),
parts AS (SELECT *, regexp_extract(t, '^(.*?[.!?]) ', 1) AS head, string_split(t, ' ') AS words FROM base),
summaries AS (
SELECT conv_id, turn, role,
       CASE WHEN t = '' THEN NULL
            WHEN head <> '' AND length(head) <= 240 THEN head
            WHEN head = '' AND length(t) <= 240 THEN t
            WHEN len(words) <= 48 THEN t
            ELSE array_to_string(words[1:48], ' ') || '...' END AS summary
FROM parts)"""

# Two states of the documents table; the second one has other text for every fifth document.
VERSIONS = f"""
old_docs AS (SELECT doc_id, 'doc-' || doc_id AS document_key, sha256({ws("text")}) AS checksum, lang FROM documents WHERE doc_id % 3 <> 0),
new_docs AS (SELECT doc_id, 'doc-' || doc_id AS document_key,
                    sha256(CASE WHEN doc_id % 5 = 0 THEN {ws("text || ' changed'")} ELSE {ws("text")} END) AS checksum, lang
             FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)"""

HASHED = """
tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS token FROM documents),
digests AS (SELECT doc_id, sha256(token) AS h FROM tokens),
cells AS (
SELECT doc_id, cast((('0x' || substr(h, 1, 8))::bigint) % 256 AS integer) AS bucket,
       sum(CASE WHEN ('0x' || substr(h, 9, 2))::bigint % 2 = 0 THEN 1 ELSE -1 END) AS weight
FROM digests GROUP BY 1, 2),
norms AS (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM cells GROUP BY 1)"""


# The split tree of every text: halved at the last space before the middle, else the first after, else the middle.
TREE = f"""
tree AS (
SELECT doc_id, '' AS path, {ws("text")} AS chunk FROM documents
UNION ALL
SELECT doc_id, path || s.side, trim(CASE WHEN s.side = 'L' THEN substr(chunk, 1, cut) ELSE substr(chunk, cut + 1) END)
FROM (SELECT doc_id, path, chunk,
        CASE WHEN strpos(reverse(substr(chunk, 1, length(chunk) // 2)), ' ') > 0
             THEN length(chunk) // 2 - strpos(reverse(substr(chunk, 1, length(chunk) // 2)), ' ') + 1
             WHEN strpos(substr(chunk, length(chunk) // 2 + 1), ' ') > 0
             THEN length(chunk) // 2 + strpos(substr(chunk, length(chunk) // 2 + 1), ' ')
             ELSE length(chunk) // 2 END AS cut
      FROM tree WHERE length(chunk) > {CHUNK_LIMIT}) t CROSS JOIN (SELECT 'L' AS side UNION ALL SELECT 'R') s)"""


def _pooled(levels: int = 20) -> str:
    """Level-wise pooling of the tree's leaf vectors (length, spaces, 1), one common table per level."""
    spaces = "length(chunk) - length(replace(chunk, ' ', ''))"
    leaf = lambda v: f"CASE WHEN length(chunk) <= {CHUNK_LIMIT} THEN cast({v} AS double) END"
    ctes = [
        f"l{levels} AS MATERIALIZED (SELECT doc_id, path, length(chunk) AS n, {leaf('length(chunk)')} AS v0, "
        f"{leaf(spaces)} AS v1, {leaf('1')} AS v2 FROM tree)"
    ]
    for d in range(levels, 0, -1):
        ctes.append(
            f"""m{d} AS MATERIALIZED (SELECT doc_id, left(path, {d - 1}) AS path, sum(v0 * n) / sum(n) AS a, sum(v1 * n) / sum(n) AS b,
sum(v2 * n) / sum(n) AS c FROM l{d} WHERE length(path) = {d} GROUP BY 1, 2)"""
        )
        ctes.append(
            f"""l{d - 1} AS MATERIALIZED (SELECT t.doc_id, t.path, t.n, coalesce(t.v0, m.a / sqrt(m.a * m.a + m.b * m.b + m.c * m.c)) AS v0,
coalesce(t.v1, m.b / sqrt(m.a * m.a + m.b * m.b + m.c * m.c)) AS v1, coalesce(t.v2, m.c / sqrt(m.a * m.a + m.b * m.b + m.c * m.c)) AS v2
FROM l{d} t LEFT JOIN m{d} m ON m.doc_id = t.doc_id AND m.path = t.path WHERE length(t.path) < {d})"""
        )
    tops = f"""tops AS (SELECT doc_id, count(*) AS chunk_count, string_agg(cast(n AS varchar), ',' ORDER BY path) AS chunk_lengths
FROM l{levels} WHERE length(path) = 1 GROUP BY 1)"""
    return f"WITH RECURSIVE {TREE}, " + ", ".join(ctes) + f", {tops}"


def oracle_sql() -> dict[str, str]:
    counts = lambda n: _COUNTS.format(n=n)
    stamp = _STAMP.format
    label = "coalesce(folder_name, 'ALL_FOLDERS') AS folder_name"
    q: dict[str, str] = {}

    q["scan_lookback"] = f"""WITH {MAIL}
SELECT folder_ord, seq AS pos, folder, message_id, cast(NULL AS bigint) AS imap_uid, sha256(body) AS body_hash
FROM mail WHERE folder IN ('INBOX', 'Archive') AND received_date >= DATE '2026-04-28' - {LOOKBACK_DAYS}"""
    q["scan_uid_range"] = f"""WITH {MAIL}
SELECT seq, imap_uid, message_id FROM mail WHERE folder = 'Archive' AND imap_uid >= 101 AND imap_uid <= 100000"""
    q["folder_status"] = f"""WITH {MAIL}
SELECT folder, count(*) AS message_count, cast(999 AS bigint) AS uidvalidity, max(imap_uid) + 1 AS uidnext, max(imap_uid) AS max_uid
FROM mail WHERE imap_uid % 11 <> 0 GROUP BY folder"""
    q["parse_flags"] = f"""WITH {NORM}
SELECT seq, array_to_string(flags, ' ') AS flags, array_to_string(keywords, ' ') AS keywords FROM norm"""
    q["split_recipients"] = f"""WITH {NORM} SELECT seq, array_to_string(recipients, ';') AS recipients FROM norm"""
    q["build_recipients"] = f"""WITH {NORM}
SELECT seq, array_to_string(list_concat(recipients, [sender]), ';') AS recipients FROM norm"""
    q["parse_int"] = f"""WITH w AS (SELECT doc_id, [x for x in string_split({ws("text")}, ' ') if regexp_full_match(x, '[+-]?[0-9]+') and try_cast(x AS bigint) IS NOT NULL] AS n FROM documents)
SELECT doc_id, len(n) AS n_integers, coalesce(list_sum([try_cast(x AS bigint) % 1000003 for x in n]), 0)::bigint AS digest FROM w"""
    q["parse_dates"] = f"""WITH {NORM}
SELECT seq, {stamp("sent_at")} AS sent_at, sent_at_iso FROM norm"""
    q["parse_rfc822"] = f"""WITH {MAIL}
SELECT seq, coalesce(message_id, '') AS message_id, subject, sender, replace(to_raw, ', ', ';') AS recipients, date_raw,
       sha256(body) AS body_hash, 6 AS n_headers, array_to_string(string_split(regexp_extract(flags_raw, 'FLAGS \\(([^)]*)\\)', 1), ' '), ' ') AS flags
FROM mail"""
    latin = r"regexp_replace(text, '[^\x00-\xFF]', '?', 'g')"
    mailed = "mailed AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
    q["extract_body"] = f"""WITH {mailed},
bodies AS (SELECT doc_id, CASE doc_id % 6 WHEN 3 THEN {latin} WHEN 4 THEN '' ELSE text END AS body FROM mailed)
SELECT doc_id, sha256(body) AS body_hash, cast(length(body) AS integer) AS n_chars, cast(NULL AS varchar) AS error FROM bodies"""
    q["decode_headers"] = f"""WITH {mailed},
subjects AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'Re: ' || text WHEN 2 THEN {latin} ELSE text || ' and ' || {latin} END AS subject FROM mailed)
SELECT doc_id, sha256(subject) AS subject_hash, cast(length(subject) AS integer) AS n_chars, true AS same_in_map, cast(NULL AS varchar) AS error FROM subjects"""
    q["normalize_messages"] = f"""WITH {NORM}
SELECT seq, fingerprint, source_message_id, subj AS subject, sndr AS sender, array_to_string(recipients, ';') AS recipients,
       date_raw AS raw_date, {stamp("sent_at")} AS sent_at, sent_at_iso, folder || '=' || imap_uid AS folder_uids,
       folder || ':' || array_to_string(flags, ',') AS folder_flags,
       CASE WHEN len(keywords) > 0 THEN folder || ':' || array_to_string(keywords, ',') ELSE '' END AS folder_keywords,
       sha256(txt) AS body_hash, content_checksum, length(searchable_text) AS n_chars FROM norm"""
    q["merge_duplicates"] = f"""WITH {MERGED}
SELECT fingerprint, first_seq, copies, source_message_id, subject, sender, recipients, {stamp("sent_at")} AS sent_at,
       content_checksum, folders, folder_uids, folder_flags, folder_keywords FROM merged"""
    q["merge_conflicts"] = f"""WITH {NORM}
SELECT sha256(sndr) AS fingerprint, count(*) AS copies, 'different content' AS conflict
FROM norm GROUP BY sndr HAVING count(DISTINCT content_checksum) > 1"""
    q["merge_uid_conflicts"] = f"""WITH {NORM},
keyed AS (SELECT sha256(txt) AS k, folder, count(DISTINCT imap_uid) AS n, count(*) AS c FROM norm GROUP BY 1, 2)
SELECT sha256(k) AS fingerprint, cast(sum(c) AS bigint) AS copies,
       CASE WHEN max(n) > 1 THEN 'two UIDs in one folder' END AS conflict FROM keyed GROUP BY k"""
    q["dedup_ratio"] = f"""WITH {NORM} SELECT count(*) AS messages, count(DISTINCT fingerprint) AS documents FROM norm"""
    q["to_document"] = f"""WITH {MERGED}
SELECT fingerprint AS document_key, 'email' AS source_type, source_message_id AS source_id, subject AS title, content_checksum,
       sha256(searchable_text) AS text_hash, string_split(folders, '|')[1] AS folder, folders, folder_uids FROM merged"""
    q["term_pairs"] = f"""WITH {TERMS} SELECT document_key, message_ref, folder_name, term_type, term FROM terms"""
    q["report_flags_detail"] = f"""WITH {NORM}
SELECT fingerprint AS document_id, coalesce(source_message_id, fingerprint) AS message_ref, subj AS title, sndr AS sender,
       {stamp("sent_at")} AS sent_at, folder AS folder_name, array_to_string(flags, ',') AS flags, array_to_string(keywords, ',') AS keywords
FROM norm"""
    q["report_terms_summary"] = f"""WITH {TERMS}
SELECT term_type, {label}, term, {counts("term_occurrences")}
FROM terms GROUP BY GROUPING SETS ((term_type, folder_name, term), (term_type, term))
ORDER BY term_type, folder_name, message_count DESC, term"""
    q["report_terms_summary_filtered"] = f"""WITH {TERMS}
SELECT term_type, {label}, term, {counts("term_occurrences")},
       {stamp("min(sent_at)")} AS first_seen_sent_at, {stamp("max(sent_at)")} AS last_seen_sent_at
FROM terms WHERE sent_at >= TIMESTAMP '{WINDOW[0]}' AND sent_at < TIMESTAMP '{WINDOW[1]}' AND folder_name = 'Archive'
GROUP BY GROUPING SETS ((term_type, folder_name, term), (term_type, term))"""
    q["report_terms_summary_unbounded"] = f"""WITH {TERMS}
SELECT term_type, {label}, term, {counts("term_occurrences")},
       {stamp("min(sent_at)")} AS first_seen_sent_at, {stamp("max(sent_at)")} AS last_seen_sent_at
FROM terms GROUP BY GROUPING SETS ((term_type, folder_name, term), (term_type, term))"""
    q["report_from_json"] = q["report_terms_summary_filtered"]
    q["report_system_flags"] = f"""WITH {TERMS}
SELECT {label}, term AS flag_name, {counts("flag_occurrences")}
FROM terms WHERE term_type = 'flag' AND left(term, 1) = chr(92)
GROUP BY GROUPING SETS ((folder_name, term), (term))"""

    q["word_tokens"] = """SELECT doc_id, len(t) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_hash
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS t FROM documents)"""
    q["hash_cells"] = f"""WITH {HASHED} SELECT doc_id, bucket, cast(weight AS bigint) AS weight FROM cells
UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE NOT regexp_matches(text, '[A-Za-z0-9'']')"""
    q["hash_embed"] = f"""WITH {HASHED}
SELECT d.doc_id, 256 AS dimensions, 'hashing' AS provider, 'hashing-v1' AS model_name,
       coalesce(count(*) FILTER (c.weight <> 0), 0) AS n_nonzero,
       round(coalesce(sum(c.weight * (c.bucket + 1) / n.norm), 0), 6) AS weighted_sum,
       round(coalesce(sum(abs(c.weight) / n.norm), 0), 6) AS l1
FROM documents d LEFT JOIN cells c ON c.doc_id = d.doc_id LEFT JOIN norms n ON n.doc_id = d.doc_id
GROUP BY d.doc_id"""
    q["l2_normalize"] = """WITH n AS (SELECT vec_id, embedding, sqrt(list_sum([cast(v AS double) * cast(v AS double) for v in embedding])) AS norm FROM embeddings)
SELECT vec_id, len(embedding) AS dimensions, round(norm, 6) AS norm,
       round(list_sum([cast(v AS double) / norm for v in embedding]), 6) AS unit_sum FROM n"""
    q["vector_literal"] = """SELECT vec_id, '[' || array_to_string([printf('%.8f', cast(v AS double)) for v in embedding], ',') || ']' AS literal FROM embeddings"""
    q["chunk_text"] = f"""WITH RECURSIVE {TREE}
SELECT doc_id, path, length(chunk) AS chunk_length, sha256(chunk) AS chunk_hash FROM tree WHERE length(chunk) <= {CHUNK_LIMIT}"""
    q["pool_chunks"] = f"""{_pooled()}
SELECT r.doc_id, coalesce(chunk_count, 0) AS chunk_count, coalesce(chunk_lengths, '') AS chunk_lengths,
       round(v0, 6) AS v0, round(v1, 6) AS v1 FROM l0 r LEFT JOIN tops ON tops.doc_id = r.doc_id"""
    q["embed_long_texts"] = f"""{_pooled()}
SELECT r.doc_id, 3 AS dimensions, chunk_count, round(v0, 6) AS v0, round(v1, 6) AS v1, cast(NULL AS varchar) AS error
FROM l0 r LEFT JOIN tops ON tops.doc_id = r.doc_id"""
    q["model_embed"] = f"""SELECT doc_id, CASE WHEN n <= 4000 THEN 3 END AS dimensions, 'demo' AS provider, 'lengths' AS model_name,
       CASE WHEN n <= 4000 THEN round(cast(n + 2 * e + 3 * s AS double), 6) END AS weighted_sum,
       CASE WHEN n > 4000 THEN 'text is too long' END AS error
FROM (SELECT doc_id, length(t) AS n, length(t) - length(replace(t, 'e', '')) AS e, length(t) - length(replace(t, ' ', '')) AS s
      FROM (SELECT doc_id, {ws("text")} AS t FROM documents))"""
    q["embed_with_fallback"] = f"""SELECT doc_id, CASE WHEN n <= 4000 THEN 3 ELSE 256 END AS dimensions,
       CASE WHEN n <= 4000 THEN 'demo' ELSE 'hashing' END AS provider, n > 4000 AS used_fallback,
       CASE WHEN n > 4000 THEN 'text is too long' END AS fallback_reason
FROM (SELECT doc_id, length({ws("text")}) AS n FROM documents)"""

    q["refresh_stale_embeddings"] = f"""WITH {VERSIONS}
SELECT n.document_key, n.checksum AS content_checksum FROM new_docs n
WHERE NOT EXISTS (SELECT 1 FROM old_docs o WHERE o.document_key = n.document_key AND o.checksum = n.checksum AND o.doc_id % 7 <> 0)"""
    q["upsert_documents"] = f"""WITH {VERSIONS}
SELECT coalesce(n.document_key, o.document_key) AS document_key, coalesce(n.checksum, o.checksum) AS content_checksum,
       coalesce('title ' || n.lang, 'old ' || o.lang) AS title,
       CASE WHEN o.document_key IS NULL THEN '2026-04-28' ELSE '2026-04-10' END AS created_on,
       CASE WHEN n.document_key IS NULL THEN '2026-04-10' ELSE '2026-04-28' END AS updated_on,
       CASE WHEN n.document_key IS NOT NULL THEN o.document_key IS NULL END AS inserted
FROM old_docs o FULL OUTER JOIN new_docs n ON n.document_key = o.document_key"""
    q["upsert_embeddings"] = f"""WITH {VERSIONS},
old_e AS (SELECT document_key, checksum, CASE WHEN doc_id % 7 = 0 THEN 128 ELSE 256 END AS dims FROM old_docs),
j AS (SELECT coalesce(n.document_key, o.document_key) AS document_key, o.checksum AS oc, n.checksum AS nc, o.dims,
             n.document_key IS NOT NULL AS given, o.document_key IS NOT NULL AS had
      FROM old_e o FULL OUTER JOIN new_docs n ON n.document_key = o.document_key),
w AS (SELECT *, given AND (NOT had OR oc IS DISTINCT FROM nc OR dims IS DISTINCT FROM 256) AS write FROM j)
SELECT document_key, 'hashing' AS provider, 'hashing-v1' AS model_name, CASE WHEN write THEN 256 ELSE dims END AS dimensions,
       CASE WHEN write THEN nc ELSE oc END AS content_checksum,
       CASE WHEN had THEN '2026-04-10' ELSE '2026-04-28' END AS created_on,
       CASE WHEN write THEN '2026-04-28' ELSE '2026-04-10' END AS updated_on, CASE WHEN given THEN write END AS updated FROM w"""
    q["upsert_sync_state"] = f"""WITH {SYNC}
SELECT coalesce(n.folder, o.folder) AS imap_folder, cast(coalesce(n.uidvalidity, o.uidvalidity) AS bigint) AS uidvalidity,
       coalesce(n.uidnext - 1, o.last_synced_uid) AS last_synced_uid,
       CASE WHEN n.folder IS NULL THEN 'run-previous' ELSE 'run-now' END AS sync_run_id,
       coalesce(n.message_count, 0) AS total_emails_in_folder,
       CASE WHEN o.folder IS NULL THEN '2026-04-28' ELSE '2026-04-10' END AS created_on
FROM stored_state o FULL OUTER JOIN status n ON n.folder = o.folder AND n.uidvalidity = o.uidvalidity"""
    q["record_document_sync"] = f"""WITH {SYNC},
obs AS (
SELECT fingerprint, 0 AS phase, 0 AS ord, true AS present,
       string_agg(folder, '|' ORDER BY seq) AS folder_names FROM norm GROUP BY fingerprint
UNION ALL
SELECT n.fingerprint, 1, n.folder_ord, false, n.folder FROM norm n
WHERE NOT EXISTS (SELECT 1 FROM server s WHERE s.folder = n.folder AND s.uid = n.imap_uid)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY phase DESC, ord DESC) AS rn FROM obs)
SELECT fingerprint AS document_key, 'run-now' AS sync_run_id, present AS was_present_in_mailbox, folder_names FROM ranked WHERE rn = 1"""
    q["lookup_document"] = f"""WITH {MERGED}
SELECT m.fingerprint AS document_key, m.subject AS title, n.folder FROM norm n JOIN merged m ON m.fingerprint = n.fingerprint"""
    q["latest_sync_state"] = """WITH states AS (
SELECT 'user-' || user_id AS imap_user, event_type AS imap_folder, cast(event_id % 3 AS bigint) AS uidvalidity, event_id AS last_synced_uid, ts FROM events)
SELECT imap_user, imap_folder, uidvalidity, last_synced_uid, strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_sync_time FROM (
SELECT *, row_number() OVER (PARTITION BY imap_user, imap_folder ORDER BY ts DESC, uidvalidity DESC) AS rn FROM states) WHERE rn = 1"""
    q["cursor_join"] = f"""WITH {SYNC}
SELECT folder, cast(folder_ord AS integer) AS folder_ord, sync_mode, message_count, uidnext,
       CASE WHEN sync_mode = 'incremental' AND last_synced_uid + 1 < uidnext THEN last_synced_uid + 1 END AS start_uid,
       CASE WHEN sync_mode = 'incremental' AND last_synced_uid + 1 < uidnext THEN uidnext - 1 END AS end_uid FROM plan"""
    q["range_fetch"] = f"""WITH {SYNC}
SELECT folder, folder_ord, seq AS pos, sync_mode, CASE WHEN sync_mode = 'incremental' THEN imap_uid END AS imap_uid, message_id FROM fetched"""
    q["current_folder_uids"] = f"""WITH {NORM}
SELECT fingerprint AS document_key, folder, imap_uid AS uid FROM norm WHERE folder IN ('INBOX', 'Receipts')"""
    q["reconcile_folders"] = f"""WITH {SYNC}
SELECT fingerprint AS document_key, folder, folder_ord, imap_uid AS uid FROM norm n
WHERE NOT EXISTS (SELECT 1 FROM server s WHERE s.folder = n.folder AND s.uid = n.imap_uid)"""
    q["remove_folder_membership"] = f"""WITH {SYNC}
SELECT fingerprint AS document_key, coalesce(string_agg(CASE WHEN here THEN folder END, '|' ORDER BY folder_ord), '') AS folders,
       coalesce(string_agg(CASE WHEN here THEN folder || '=' || imap_uid END, '|' ORDER BY folder_ord), '') AS folder_uids,
       coalesce(string_agg(CASE WHEN here THEN folder || ':' || array_to_string(flags, ',') END, '|' ORDER BY folder_ord), '') AS folder_flags
FROM (SELECT n.*, EXISTS (SELECT 1 FROM server s WHERE s.folder = n.folder AND s.uid = n.imap_uid) AS here FROM norm n) GROUP BY fingerprint"""
    q["purge_orphan_documents"] = f"""WITH {SYNC}
SELECT DISTINCT n.fingerprint AS document_key FROM norm n JOIN server s ON s.folder = n.folder AND s.uid = n.imap_uid"""
    q["deleted_count"] = f"""WITH {SYNC}
SELECT count(DISTINCT n.fingerprint) - count(DISTINCT CASE WHEN s.uid IS NOT NULL THEN n.fingerprint END) AS deleted
FROM norm n LEFT JOIN server s ON s.folder = n.folder AND s.uid = n.imap_uid"""
    q["cascade_delete"] = f"""WITH {SYNC}
SELECT n.fingerprint AS document_key, n.folder FROM norm n WHERE n.fingerprint IN
(SELECT x.fingerprint FROM norm x JOIN server s ON s.folder = x.folder AND s.uid = x.imap_uid)"""
    q["schema_backfill"] = """SELECT 'vec-' || vec_id AS document_key, 'legacy' AS provider, 'label-' || label AS model_name,
       len(embedding) AS dimensions FROM embeddings"""
    q["provider_model_space"] = """SELECT 'vec-' || vec_id AS document_key, provider FROM embeddings CROSS JOIN
(SELECT 'hashing' AS provider UNION ALL SELECT 'demo') WHERE provider = 'demo'"""

    q["incremental_ingest"] = f"""WITH {SYNC}
SELECT fingerprint AS document_key, string_agg(folder, '|' ORDER BY folder_ord) AS folders,
       coalesce(string_agg(folder || '=' || uid, '|' ORDER BY folder_ord), '') AS folder_uids,
       CASE WHEN bool_or(refetched) THEN '2026-04-28' ELSE '2026-04-10' END AS updated_on
FROM kept GROUP BY fingerprint"""
    q["ingest_report"] = f"""WITH {SYNC}
SELECT (SELECT count(*) FROM fetched) AS total_fetched, (SELECT count(*) FROM fetched) AS total_normalized,
       (SELECT count(DISTINCT fingerprint) FROM fetched) AS total_deduped, (SELECT count(*) FROM missing) AS reconciled_missing,
       (SELECT count(*) FROM gone) AS deleted_stale_documents"""
    q["ingest_folders"] = f"""WITH {SYNC}
SELECT folder, sync_mode, message_count, cast(uidvalidity AS bigint) AS uidvalidity, uidnext FROM plan"""
    q["ingest_embeddings"] = f"""WITH {SYNC}
SELECT DISTINCT fingerprint AS document_key, 'hashing' AS provider, 'hashing-v1' AS model_name, 256 AS dimensions FROM kept"""
    q["ingest_sync_runs"] = f"""WITH {SYNC},
obs AS (
SELECT fingerprint, 0 AS phase, 0 AS ord, true AS present, string_agg(folder, '|' ORDER BY folder_ord, seq) AS folder_names FROM fetched GROUP BY 1
UNION ALL SELECT fingerprint, 1, folder_ord, false, folder FROM missing),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY phase DESC, ord DESC) AS rn FROM obs)
SELECT fingerprint AS document_key, present AS was_present_in_mailbox, folder_names FROM ranked
WHERE rn = 1 AND fingerprint NOT IN (SELECT fingerprint FROM gone)"""
    q["ingest_sync_state"] = f"""WITH {SYNC}
SELECT folder AS imap_folder, cast(uidvalidity AS bigint) AS uidvalidity, uidnext - 1 AS last_synced_uid, 'run-now' AS sync_run_id,
       message_count AS total_emails_in_folder FROM status
UNION ALL
SELECT o.folder, cast(o.uidvalidity AS bigint), o.last_synced_uid, 'run-previous', 0 FROM stored_state o
WHERE NOT EXISTS (SELECT 1 FROM status s WHERE s.folder = o.folder AND s.uidvalidity = o.uidvalidity)"""
    q["dry_run"] = f"""WITH {SYNC}
SELECT count(DISTINCT fingerprint) AS fetched, cast(0 AS bigint) AS inserted, cast(0 AS bigint) AS embedding_updates, count(DISTINCT fingerprint) AS skipped FROM fetched"""
    q["idempotent_rerun"] = f"""WITH {SYNC}
SELECT (SELECT count(DISTINCT fingerprint) FROM kept) AS documents, (SELECT count(DISTINCT fingerprint) FROM kept) AS embeddings,
       cast(0 AS bigint) AS inserted, cast(0 AS bigint) AS embedding_updates"""
    q["stream_ingest"] = f"""WITH {MERGED}
SELECT fingerprint AS document_key, source_message_id AS source_id, subject AS title, content_checksum, folders, folder_uids FROM merged"""

    q["map_area"] = f"WITH {AREAS} SELECT uuid, title FROM areas"
    q["map_project"] = f"WITH {PROJECTS} SELECT * FROM open_projects"
    q["map_heading"] = f"""WITH {HEADINGS}
SELECT uuid, title, project_uuid, cast(NULL AS varchar) AS project_title, cast(NULL AS varchar) AS notes, status, cast(NULL AS varchar) AS start_value FROM headings"""
    q["map_todo"] = f"""WITH {TODOS}
SELECT uuid, title, project_uuid, heading_uuid, notes, status FROM open_todos"""
    q["map_checklist_item"] = f"WITH {TODOS} SELECT uuid, todo_uuid, title, status, cast(pos AS bigint) AS pos FROM items"
    q["require_nonblank"] = f"""WITH {PROJECTS}
SELECT uuid, 'project without notes' AS reason FROM open_projects WHERE notes IS NULL OR trim(notes) = ''"""
    q["checklist_hydrate"] = f"""WITH {TODOS}
SELECT t.uuid, t.title, cast(coalesce(c.pos, -1) AS bigint) AS pos, c.uuid AS item_uuid, c.title AS item_title, c.status AS item_status
FROM open_todos t LEFT JOIN checklist c ON c.todo_uuid = t.uuid"""
    q["checklist_inline"] = f"""WITH {TODOS},
places AS (SELECT *, row_number() OVER (PARTITION BY todo_uuid ORDER BY pos, uuid, title, status) - 1 AS place FROM items),
third AS (SELECT *, cast(substr(uuid, 6) AS bigint) % 3 = 0 AS carries FROM open_todos)
SELECT t.uuid, t.title, cast(coalesce(CASE WHEN t.carries THEN c.place ELSE c.pos END, -1) AS bigint) AS pos,
       c.uuid AS item_uuid, c.title AS item_title, c.status AS item_status
FROM third t LEFT JOIN places c ON c.todo_uuid = t.uuid AND (t.carries OR t.has_checklist)"""
    q["snapshot_of_export"] = q["checklist_inline"]
    q["scan_tasks"] = """SELECT 'to-do' AS type, concat('todo-', o_orderkey) AS uuid,
       CASE WHEN o_orderkey % 50 = 0 THEN ' ' ELSE concat('Order ', o_orderkey) END AS title, 'incomplete' AS status, false AS trashed,
       concat('project-', o_custkey) AS project, concat('heading-', o_custkey, '-', left(o_orderpriority, 1)) AS heading,
       CASE WHEN o_orderkey % 3 = 0 THEN concat('Total ', cast(floor(o_totalprice) AS bigint)) ELSE '' END AS notes
FROM orders WHERE o_orderstatus NOT IN ('F', 'P') AND o_orderkey % 29 <> 0"""
    q["checklist_flatten"] = f"WITH {TODOS} SELECT uuid, todo_uuid, title, status FROM checklist"
    q["collect_notes"] = f"WITH {NOTES} SELECT * FROM notes"
    q["replace_snapshot"] = f"""WITH {AREAS}, {HEADINGS}, {NOTES}
SELECT 'task_areas' AS table_name, uuid AS row_key, title, cast(NULL AS varchar) AS parent FROM areas
UNION ALL SELECT 'task_projects', uuid, title, area_uuid FROM open_projects
UNION ALL SELECT 'task_headings', uuid, title, project_uuid FROM headings
UNION ALL SELECT 'task_todos', uuid, title, project_uuid FROM open_todos
UNION ALL SELECT 'task_checklist_items', uuid, title, todo_uuid FROM checklist
UNION ALL SELECT 'task_notes', item_uuid || '/' || item_type, title, content FROM notes"""
    q["snapshot_json"] = f"""WITH {AREAS}, {HEADINGS}, {NOTES}
SELECT 'areas' AS slice, '{{"title":"' || title || '","uuid":"' || uuid || '"}}' AS json FROM areas
UNION ALL SELECT 'projects', '{{"area_uuid":"' || area_uuid || '","notes":' || coalesce('"' || notes || '"', 'null') || ',"status":"' || status || '","title":"' || title || '","uuid":"' || uuid || '"}}' FROM open_projects
UNION ALL SELECT 'headings', '{{"notes":null,"project_title":null,"project_uuid":"' || project_uuid || '","start":null,"status":"' || status || '","title":"' || title || '","uuid":"' || uuid || '"}}' FROM headings
UNION ALL SELECT 'todos', '{{"area_uuid":null,"heading_title":null,"heading_uuid":"' || heading_uuid || '","notes":"' || notes || '","project_title":null,"project_uuid":"' || project_uuid || '","start":null,"status":"' || status || '","title":"' || title || '","uuid":"' || t.uuid || '"}}' FROM open_todos t
UNION ALL SELECT 'checklist_items', '{{"pos":' || pos || ',"status":"' || status || '","title":"' || title || '","todo_uuid":"' || todo_uuid || '","uuid":"' || uuid || '"}}' FROM checklist
UNION ALL SELECT 'notes', '{{"area_uuid":' || coalesce('"' || area_uuid || '"', 'null') || ',"content":"' || content || '","item_type":"' || item_type || '","item_uuid":"' || item_uuid || '","project_uuid":' || coalesce('"' || project_uuid || '"', 'null') || ',"title":"' || title || '"}}' FROM notes"""

    q["extractive_summary"] = f"WITH {SUMMARIES} SELECT conv_id, turn, summary FROM summaries"
    q["split_words"] = f"""SELECT conv_id, turn, CASE WHEN {ws("text")} = '' THEN 0 ELSE len(string_split({ws("text")}, ' ')) END AS n_words FROM conversations"""
    q["digest_lines"] = f"""WITH {SUMMARIES}, kept AS (SELECT * FROM summaries WHERE summary IS NOT NULL)
SELECT role AS audience, 2 AS section, conv_id, turn, '- ' || summary AS line FROM kept
UNION ALL SELECT DISTINCT role, 0, cast(NULL AS bigint), cast(NULL AS bigint), '## Daily Digest for ' || upper(substr(role, 1, 1)) || lower(substr(role, 2)) FROM kept
UNION ALL SELECT DISTINCT role, 1, cast(NULL AS bigint), cast(NULL AS bigint), '' FROM kept"""
    q["digest_build"] = f"""WITH {SUMMARIES},
kept AS (SELECT 'reader-' || conv_id AS audience, conv_id, turn, summary FROM summaries WHERE summary IS NOT NULL)
SELECT audience, 2 + row_number() OVER (PARTITION BY audience ORDER BY turn, '- ' || summary) AS line_no, '- ' || summary AS line FROM kept
UNION ALL SELECT DISTINCT audience, 1, '## Daily Digest for Reader-' || conv_id FROM kept
UNION ALL SELECT DISTINCT audience, 2, '' FROM kept"""
    return q
