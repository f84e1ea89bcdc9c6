"""DuckDB SQL for the registered queries, written apart from the operators."""

from __future__ import annotations

# fixed values, in DuckDB's regular expressions, where \b is ASCII
_WS = r"[\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_NO_WS = _WS.replace("[", "[^&#", 1)
# fixed values: keys whose values are redacted
REDACT_KEYS = ("email", "phone", "name", "address", "token", "password", "secret", "cookie", "session", "auth", "ssn", "dob", "user")
AS_OF, N, WINDOW = 1_706_745_600_000, 3, 6 * 3_600_000


def redact(x: str) -> str:
    for pattern, put, flags in (
        (r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[REDACTED]", "gi"),
        (rf"\bBearer{_WS}+[A-Za-z0-9._-]+\b", "Bearer [REDACTED]", "gi"),
        (r"\b[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "[REDACTED]", "g"),
        (r"\b[0-9]{9,}\b", "[REDACTED]", "g"),
        (rf"([?&](?:token|email|phone|name|user|auth|session|password)=){_NO_WS}*", r"\1[REDACTED]", "gi"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{put}', '{flags}')"
    return x


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def single(x: str, most: int) -> str:
    x = rf"regexp_replace(coalesce({x}, ''), '[\x00-\x1f\x7f-\x{{9f}}]', ' ', 'g')"
    return f"substring({redact(f'''trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))''')}, 1, {most})"


def multi(x: str, most: int) -> str:
    x = redact(rf"regexp_replace(coalesce({x}, ''), '\r\n?', chr(10), 'g')")
    return f"substring(array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda x: {trim('x')}), lambda x: length(x) > 0), chr(10)), 1, {most})"


def hashed(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 5381 ELSE list_reduce(list_prepend(5381::BIGINT, list_transform(string_split({x}, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: xor((a * 33) & 4294967295, c)) END"


def hexed(x: str) -> str:
    return f"printf('%x', ({hashed(x)})::BIGINT)"


def or_else(x: str, default: str) -> str:
    return f"coalesce(nullif({x}, ''), {default})"


def distinct(x: str) -> str:
    """Of a list, in order of first appearance."""
    return f"list_filter({x}, lambda y, i: list_position({x}, y) = i)"


def sensitive(x: str) -> str:
    return "(" + " OR ".join(f"contains(lower(trim({x})), '{k}')" for k in REDACT_KEYS) + ")"


EVENTS = """e AS (SELECT event_id AS seq, 'event_' || event_id AS id, 'session_' || user_id AS session_id, 'c' || (user_id % 10) AS component, event_type AS action,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'interaction' END AS kind, CASE WHEN user_id % 2 = 0 THEN 'backend' ELSE 'frontend' END AS channel,
  epoch_us(ts) // 1000 AS timestamp, props AS context, json_extract_string(props, '$.k')::BIGINT AS k, user_id FROM events)"""
REPORTS = EVENTS + """, r AS (SELECT *, component AS boundary, 'E' || (k % 3) AS name, 'failed for user' || user_id || '@example.com in step ' || (k % 2) AS message FROM e WHERE kind = 'error')"""


def _injected(context: str, channel: str) -> str:
    return f"""substring({context}, 1, length({context}) - 1) || ',"analyticsChannel":"' || {channel} || '","analyticsRuntime":"server"}}'"""


def _report_mark(stack: str = "''") -> str:
    base = f"boundary || '|' || name || '|' || {single('message', 240)} || '|' || {stack} || '|error'"
    return f"'err_' || {hexed('(' + base + ')')}"


_MANY = ",".join(f'"z{i:02d}":"{i}"' for i in range(25))
#: the flat contexts: key and value lists in order, cut at 20
CONTEXTS = EVENTS + f""", f AS (SELECT id, list_concat([
    {{'k': 'userId', 'v': 'u' || user_id}}, {{'k': 'feature', 'v': ' f' || chr(9) || k}}, {{'k': 'contact', 'v': 'mail me at a' || k || '@b.example'}}, {{'k': 'Authorization', 'v': 'key' || (k % 5)}}],
    list_concat(CASE WHEN k % 2 = 0 THEN [{", ".join(f"{{'k': 'z{i:02d}', 'v': '{i}'}}" for i in range(25))}] ELSE [] END, [{{'k': 'last', 'v': NULL}}]))[1:20] AS entries FROM e)"""


def _clean(key: str) -> str:
    return f"list_filter(entries, lambda x: x.k = '{key}')"


def _context_redact() -> str:
    columns = []
    for key in ("userId", "feature", "contact", "Authorization", "z03", "z20", "last"):
        entry = f"{_clean(key)}[1].v"
        value = "'[REDACTED]'" if key in ("userId", "Authorization") else single(entry, 240)
        columns.append(f"CASE WHEN len({_clean(key)}) = 0 OR {entry} IS NULL THEN NULL ELSE {value} END AS {key.lower()}")
    return f"WITH {CONTEXTS} SELECT id, {', '.join(columns)} FROM f"


ERRORS = EVENTS + """, x AS (SELECT seq, component AS fingerprint, timestamp, 'E' || (k % 3) AS name, CASE WHEN k % 7 = 0 THEN 'fatal' ELSE 'error' END AS severity FROM e WHERE kind = 'error')"""
COUNTED = f"""c AS (SELECT seq, fingerprint, timestamp,
    count(*) OVER (PARTITION BY fingerprint ORDER BY timestamp RANGE BETWEEN {WINDOW} PRECEDING AND CURRENT ROW)
    - count(*) OVER (PARTITION BY fingerprint, timestamp ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS cnt FROM x)"""


#: arrivals in another order than of time: an error ends with the first later arrival that is more than a window younger
LATE = f"""{ERRORS}, y AS (SELECT (seq * 7919) % 100003 AS seq, fingerprint, timestamp FROM x),
    o AS (SELECT a.seq, a.fingerprint, a.timestamp, min(b.seq) AS ended FROM y a LEFT JOIN y b ON a.fingerprint = b.fingerprint AND b.seq > a.seq AND b.timestamp > a.timestamp + {WINDOW} GROUP BY ALL),
    c AS (SELECT y.seq, y.fingerprint, y.timestamp, count(*) AS cnt FROM y JOIN o ON y.fingerprint = o.fingerprint AND o.seq <= y.seq AND (o.ended IS NULL OR o.ended > y.seq) GROUP BY ALL)"""


def fired(source: str) -> str:
    """Recursive: from each row that fired to the next one, a window later, of its fingerprint."""
    return f"""q AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY seq) AS n FROM {source} WHERE cnt >= {N}),
t AS (SELECT * FROM q WHERE n = 1 UNION ALL
  SELECT seq, fingerprint, timestamp, cnt, n FROM (SELECT q.*, row_number() OVER (PARTITION BY q.fingerprint ORDER BY q.seq) AS first
    FROM t JOIN q ON q.fingerprint = t.fingerprint AND q.n > t.n AND q.timestamp - t.timestamp >= {WINDOW}) WHERE first = 1)"""


INSIDE = f"timestamp >= {AS_OF - 86_400_000 - 7 * 86_400_000}"
ISSUES = f"""i AS (SELECT fingerprint, count(*) FILTER ({INSIDE}) AS count, min(timestamp) FILTER ({INSIDE}) AS first_seen, max(timestamp) FILTER ({INSIDE}) AS last_seen,
  arg_max(severity, seq) AS severity, arg_max(name, seq) AS sample_name, min(seq) FILTER ({INSIDE}) AS first_seq FROM x GROUP BY fingerprint)"""

_TURNS = "c AS (SELECT conv_id AS queue_key, turn AS seq, role AS kind, 't_' || conv_id || '_' || turn AS id FROM conversations)"
_BATCHES = "b AS (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1) // {size} AS batch_no FROM e)"

#: a record in an envelope
_EVENT_JSON = """'{"id":"' || id || '","component":"' || component || '","action":"' || action || '","kind":"' || kind || '","channel":"' || b.channel || '","sessionId":"' || session_id || '","timestamp":' || timestamp || ',"context":' || context || '}'"""

_TAGS = f"list_filter(list_transform(list_concat(regexp_split_to_array(text, '[ \\n]'), [' ', 'last']), lambda x: {single('x', 240)}), lambda x: length(x) > 0)"
_WORD_TAGS = f"list_filter(list_transform(string_split(text, ' '), lambda x: {single('x', 240)}), lambda x: length(x) > 0)"

_ERRORS_NORMALIZE = f"""
WITH d AS (SELECT doc_id, text, {or_else(single('source', 100), "'UnknownErrorBoundary'")} AS boundary,
    CASE WHEN doc_id % 5 IN (0, 1) THEN 'Error' ELSE 'Name' || (doc_id % 7) END AS name,
    {or_else(single('text', 240), "'Unknown error'")} AS message,
    CASE WHEN doc_id % 2 = 0 AND text <> '' THEN {multi('text', 1800)} END AS stack, CASE WHEN text <> '' THEN {multi('text', 1800)} END AS component_stack,
    CASE WHEN doc_id % 4 = 0 THEN 'fatal' ELSE 'error' END AS severity, doc_id % 3 <> 1 AS handled, {_WORD_TAGS} AS t FROM documents),
b AS (SELECT *, boundary || '|' || name || '|' || message || '|' || coalesce(string_split(stack, chr(10))[1], '') || '|' || severity AS base FROM d)
SELECT doc_id, boundary, name, message, 'err_' || {hexed('base')} AS fingerprint, handled, severity, stack, component_stack,
    CASE WHEN len(t) > 0 THEN array_to_string(({distinct('t')})[1:10], '|') END AS tags FROM b
"""

_EVENTS_NORMALIZE = f"""
WITH {EVENTS}, n AS (SELECT *, CASE WHEN seq % 4 = 0 THEN 'backend' ELSE channel END AS ch FROM e)
SELECT id, seq, CASE WHEN seq % 5 IN (0, 1) THEN 'interaction' ELSE kind END AS kind, component, action, ch AS channel, 'server' AS runtime,
  CASE WHEN seq % 2 = 0 THEN 'label ' || k END AS label, '/p?token=x&k=' || k AS href, NULL::VARCHAR AS variant, CASE WHEN seq % 3 = 0 THEN 'req_' || seq END AS request_id,
  'Check App' AS source, session_id, CASE WHEN seq % 11 = 0 THEN {AS_OF} ELSE timestamp END AS timestamp, {_injected('context', 'ch')} AS context FROM n
"""

_EVENTS_WITH_ERROR = f"""
WITH {EVENTS}, n AS (SELECT *, kind = 'error' AND seq % 3 <> 0 AS ok, 'box ' || (k % 4) AS b, {single("'user' || k || '@mail.example.org failed'", 240)} AS m, CASE WHEN k % 2 = 0 THEN 'fatal' ELSE 'error' END AS sev,
  {multi("'a@b.co line' || chr(10) || chr(10) || '  at f '", 1800)} AS st FROM e)
SELECT id, kind, CASE WHEN ok THEN b END AS error_boundary, CASE WHEN ok THEN 'TypeError' END AS error_name, CASE WHEN ok THEN m END AS error_message,
  CASE WHEN ok THEN CASE WHEN seq % 2 = 0 THEN 'err_known' ELSE 'err_' || {hexed("(b || '|TypeError|' || m || '|' || string_split(st, chr(10))[1] || '|' || sev)")} END END AS error_fingerprint,
  CASE WHEN ok THEN true END AS error_handled, CASE WHEN ok THEN sev END AS error_severity, CASE WHEN ok THEN st END AS error_stack, CASE WHEN ok THEN 'x' END AS error_tags FROM n
"""

_ERRORS_EXTRACT = f"""
SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'Named' ELSE 'Error' END WHEN doc_id % 4 = 2 AND text IS NOT NULL THEN 'Error' ELSE 'UnknownError' END AS name,
  CASE WHEN doc_id % 4 < 2 THEN CASE WHEN doc_id % 8 < 4 THEN source WHEN doc_id % 8 = 4 THEN 'Unknown error' ELSE {single('''('{"name":"' || CASE WHEN doc_id % 2 = 0 THEN 'Named' ELSE '  ' END || '","message":"","stack":"s"}')''', 240)} END
    WHEN doc_id % 4 = 2 AND text IS NOT NULL THEN text WHEN doc_id % 16 = 7 THEN {or_else(single('text', 240), "'Unknown error'")} ELSE 'Unknown error' END AS message, CASE WHEN doc_id % 4 < 2 THEN 's' END AS stack FROM documents
"""

_QUEUE_RESTORE = f"""
WITH {EVENTS} SELECT seq AS queue, id, component, action, session_id, CASE WHEN seq % 2 = 0 THEN 'error' ELSE 'interaction' END AS kind,
  CASE WHEN seq % 3 = 0 THEN 'backend' ELSE channel END AS channel, 'server' AS runtime, timestamp, CASE WHEN seq % 5 = 0 THEN '{{}}' ELSE '{{"k":' || k || '}}' END AS context,
  CASE WHEN seq % 2 = 0 THEN 'fp 1' END AS fingerprint, CASE WHEN seq % 2 = 0 THEN 'error' END AS severity
FROM e WHERE seq % 13 <> 0 AND seq % 17 <> 0 AND seq % 11 <> 0 AND seq % 7 <> 0
"""

_ENDPOINT = """
SELECT page_id, CASE page_id % 8 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN true
  ELSE starts_with(url, 'https://') OR regexp_matches(url, '^http://(localhost|127\\.0\\.0\\.1)(:[0-9]+)?(/|$)') END AS secure FROM pages
"""


def oracle_sql() -> dict[str, str]:
    return {
        "events_normalize": _EVENTS_NORMALIZE,
        "events_mixed_channels": f"WITH {EVENTS}, n AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 'frontend' ELSE 'backend' END AS ch FROM e) SELECT seq, ch AS channel, 'server' AS runtime, {_injected('context', 'ch')} AS context FROM n",
        "events_component_bound": f"""WITH {EVENTS} SELECT id, 'interaction' AS kind, 'panel' AS component, action, '{{"area":"main","k":' || k || ',"analyticsChannel":"backend","analyticsRuntime":"server"}}' AS context FROM e""",
        "events_disabled": f"WITH {EVENTS} SELECT id, component, action FROM e WHERE false",
        "events_with_error": _EVENTS_WITH_ERROR,
        "errors_normalize": _ERRORS_NORMALIZE,
        "errors_extract": _ERRORS_EXTRACT,
        "errors_to_records": f"WITH {REPORTS} SELECT id, seq, 'error' AS kind, boundary AS component, 'error_boundary_caught' AS action, channel, 'server' AS runtime, {_report_mark()} AS label, 'Check App' AS source, session_id, timestamp FROM r",
        "errors_context": f"WITH {REPORTS} SELECT id, {_report_mark()} AS fingerprint, boundary, 'error' AS severity, 'true' AS handled, '[REDACTED]' AS user, 'a b' AS step, 'hash_' || {hexed('session_id')} AS session_hash, 'userId' AS identifier, 'hash_' || {hexed('user_id::VARCHAR')} AS value_hash, channel FROM r",
        "errors_gated": f"WITH {REPORTS} SELECT seq, boundary, 'open' AS endpoint FROM r",
        "context_merge": f"WITH {EVENTS} SELECT id, k::VARCHAR AS k, 'check' AS app, 2 AS n_keys FROM e",
        "context_inject": f"""WITH {EVENTS} SELECT id, CASE WHEN seq % 3 = 0 THEN '{{"analyticsChannel":null,"analyticsRuntime":"server"}}' WHEN seq % 3 = 1 THEN '{{"analyticsChannel":"' || channel || '","analyticsRuntime":"server"}}' ELSE {_injected('context', 'channel')} END AS context FROM e""",
        "context_redact": _context_redact(),
        "context_breadth": f"WITH {CONTEXTS} SELECT id, len(entries)::INTEGER AS n_entries, array_to_string(list_transform(entries, lambda x: x.k), ',') AS entry_keys FROM f",
        "context_tree": f"""WITH {EVENTS} SELECT id, '{{"a":{{"b":{{"c":{{"d":"[truncated]"}},"email":"[REDACTED]"}}}},"list":[{{"token":"[REDACTED]"}},[1,2.5,null]],"n":' || k || '}}' AS context,
            '[{{"key":"[REDACTED]","value":"[REDACTED]"}},{{"key":"list[].token","value":"t' || seq || '"}}]' AS identifiers FROM e""",
        "context_tree_native": f"""WITH {EVENTS} SELECT id, '{{"a":{{"b":{{"c":{{"d":"[truncated]"}},"email":"[REDACTED]"}}}},"list":[{{"token":"[REDACTED]"}},[1,2.5,null]],"n":' || k || '}}' AS context,
            '[{{"key":"[REDACTED]","value":"[REDACTED]"}},{{"key":"list[].token","value":"t' || seq || '"}}]' AS identifiers FROM e""",
        "identifiers_explode": f"""WITH {CONTEXTS}, g AS (SELECT id, list_filter(entries, lambda x: {sensitive('x.k')}) AS s FROM f), u AS (SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM g)
            SELECT id AS record_id, (i - 1)::INTEGER AS pos, s[i].k AS key, {single('s[i].v', 240)} AS value, 'hash_' || {hexed(f"({single('s[i].v', 240)})")} AS value_hash FROM u""",
        "endpoint_secure": _ENDPOINT,
        "batch_admission": f"""WITH {EVENTS}, {_BATCHES.format(size=2)} SELECT session_id AS queue_key, batch_no, count(*) AS n_events, bool_or(kind = 'error') AS has_error,
            CASE batch_no % 3 WHEN 0 THEN 'http://remote.example.com/in' WHEN 1 THEN 'https://remote.example.com/in' ELSE '' END AS endpoint, batch_no % 3 <> 0 OR NOT bool_or(kind = 'error') AS admitted FROM b GROUP BY session_id, batch_no""",
        "queue_cap": f"WITH {_TURNS} SELECT queue_key, seq, id FROM (SELECT *, row_number() OVER (PARTITION BY queue_key ORDER BY seq DESC) AS n FROM c) WHERE n <= 2",
        "flush_batches": f"WITH {_TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY queue_key ORDER BY seq) - 1 AS n FROM c) SELECT queue_key, seq, n // 3 AS batch_no, (n % 3)::INTEGER AS batch_pos FROM n",
        "flush_envelopes": f"""WITH {EVENTS}, {_BATCHES.format(size=20)} SELECT session_id AS queue_key, batch_no, 'Check App' AS source, 'backend' AS channel, 'server' AS runtime, {AS_OF}::BIGINT AS sent_at, count(*)::INTEGER AS n_events, min(seq) AS first_seq, max(seq) AS last_seq, 
            '{{\"source\":\"Check App\",\"channel\":\"backend\",\"runtime\":\"server\",\"sentAt\":{AS_OF},\"events\":[' || string_agg({_EVENT_JSON}, ',' ORDER BY seq) || ']}}' AS body FROM b GROUP BY session_id, batch_no""",
        "queue_restore": _QUEUE_RESTORE,
        "redact_text": f"SELECT doc_id, {redact('text')} AS redacted FROM documents",
        "sanitize_single_line": f"SELECT doc_id, {single('text', 240)} AS line FROM documents",
        "sanitize_multiline": f"SELECT doc_id, {multi('text', 1800)} AS lines FROM documents",
        "tags_normalize": f"WITH d AS (SELECT doc_id, {_TAGS} AS t FROM documents), u AS (SELECT doc_id, ({distinct('t')})[1:10] AS t FROM d) SELECT doc_id, array_to_string(t, '|') AS tags, len(t)::INTEGER AS n_tags FROM u",
        "storage_key": f"SELECT doc_id, 'emberlog.queue.backend.' || CASE WHEN doc_id % 9 = 0 THEN 'unknown-source' ELSE regexp_replace(lower({trim("' My App/' || text")}), '[^a-z0-9._-]+', '-', 'g') END AS storage_key FROM documents",
        "string_hash": f"SELECT doc_id, {hashed('text')} AS hash FROM documents",
        "storage_hash": f"WITH {EVENTS}, n AS (SELECT id, session_id, CASE WHEN seq % 4 = 0 THEN '' ELSE context END AS c FROM e) SELECT id, 'hash_' || {hexed('session_id')} AS session_hash, 'hash_' || {hexed('c')} AS context_hash FROM n",
        "fingerprint": f"WITH {REPORTS} SELECT id, 'err_' || {hexed('''(boundary || '|' || name || '|' || message || '|' || CASE WHEN seq % 2 = 0 THEN 'at f' || k ELSE '' END || '|error')''')} AS fingerprint FROM r",
        "crash_identity": f"WITH {EVENTS} SELECT id, 'Check App' AS source, 'frontend' AS channel, 'hash_' || {hexed('session_id')} AS session_hash, 'hash_' || {hexed('''('agent/' || k)''')} AS agent_hash, 'hash_' || {hexed('''(CASE WHEN k % 2 = 0 THEN 'de' ELSE 'en' END)''')} AS language_hash, (k * 10)::INTEGER AS screen_width FROM e",
        "issue_reports": f"WITH {ERRORS}, {ISSUES} SELECT fingerprint, fingerprint AS boundary, count, first_seen, last_seen, severity, sample_name FROM i WHERE count > 0",
        "issue_reports_panes": f"WITH {ERRORS}, {ISSUES} SELECT fingerprint, fingerprint AS boundary, count, first_seen, last_seen, severity, sample_name FROM i WHERE count > 0",
        "issue_reports_ranked": f"WITH {ERRORS}, {ISSUES} SELECT row_number() OVER (ORDER BY count DESC, last_seen DESC, first_seq)AS place, fingerprint, count, last_seen FROM i WHERE count > 0",
        "issue_reports_ranked_all": f"WITH {ERRORS.replace('component AS fingerprint', "'f' || (seq * 7919 % 1009) AS fingerprint")}, {ISSUES} SELECT row_number() OVER (ORDER BY count DESC, last_seen DESC, first_seq) AS place, fingerprint, count, last_seen FROM i WHERE count > 0",
        "issue_reports_of_errors": f"""WITH {REPORTS}, x AS (SELECT *, {_report_mark()} AS mark, {single('message', 240)} AS shown FROM r) SELECT mark AS fingerprint, arg_max(boundary, seq) AS boundary, count(*) FILTER ({INSIDE}) AS count,
            min(timestamp) FILTER ({INSIDE}) AS first_seen, max(timestamp) FILTER ({INSIDE}) AS last_seen, 'error' AS severity, arg_max(shown, seq) AS message FROM x GROUP BY mark HAVING count(*) FILTER ({INSIDE}) > 0""",
        "issue_window_count_late": f"WITH {LATE} SELECT seq, fingerprint, timestamp, cnt FROM c",
        "issue_triggers_late": f"WITH RECURSIVE {LATE}, {fired('c')} SELECT seq, timestamp AS fired_at, fingerprint, cnt AS count FROM t",
        "issue_window_count": f"WITH {ERRORS}, {COUNTED} SELECT seq, fingerprint, timestamp, cnt FROM c",
        "issue_triggers": f"WITH RECURSIVE {ERRORS}, {COUNTED}, {fired('c')} SELECT 'Check App' AS source, 'backend' AS channel, 'server' AS runtime, {N} AS threshold_count, {WINDOW} AS window_ms, t.seq, t.timestamp AS fired_at, t.fingerprint, cnt AS count, severity FROM t JOIN x USING (seq)",
        "issue_seeded": f"WITH RECURSIVE {ERRORS}, {COUNTED}, n AS (SELECT * FROM c WHERE timestamp >= 1704672000000), {fired('n')} SELECT seq, fingerprint, timestamp, cnt FROM t",
    }
