"""The same queries as DuckDB SQL, written independently of the Spark plans.

`CTES` holds named building blocks; `_sql` puts the ones a query needs in front.
"""

from __future__ import annotations

import re

from cueweave.plans.bindings import (
    CACHE_CEILING, INSTALLED, MODEL_NAMES, STDERR, TYPES,
)
from cueweave.functions.catalogue import MODELS, VAD_MODEL
from cueweave.functions.errors import AUTH_NEEDLES, EXIT_CODES, LIVE_NEEDLES, UNAVAILABLE_NEEDLES
from cueweave.operators.events import NOTICES, OTHER_TYPES, PHASES, SILENT_EVENTS

_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def _strip(x: str) -> str:
    out = f"replace(regexp_replace({x}, '<[^>]*(>|$)', '', 'g'), '>', '')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _time(ms: str, sep: str) -> str:
    t = f"greatest({ms}, 0)"
    return f"printf('%02d:%02d:%02d{sep}%03d', {t} // 3600000, {t} // 60000 % 60, {t} // 1000 % 60, {t} % 1000)"


def _str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(_str(x) for x in items) + "]"


def _wrap(text: str, w: int) -> str:
    """Greedy wrap as a fold over words, long words cut beforehand."""
    cut = (
        f"flatten(list_transform(string_split({text}, ' '), lambda x: CASE WHEN length(x) <= {w} THEN [x] "
        f"ELSE list_transform(range(0, (length(x) - 1) // {w} + 1), lambda k: substr(x, k * {w} + 1, {w})) END))"
    )
    return (
        f"list_reduce(list_transform({cut}, lambda x: [x]), lambda acc, x: "
        f"CASE WHEN length(acc[-1]) + 1 + length(x[1]) <= {w} "
        f"THEN list_concat(acc[1:len(acc)-1], [acc[-1] || ' ' || x[1]]) ELSE list_concat(acc, x) END)"
    )


def _any(column: str, needles) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {_str(n)})" for n in needles) + ")"


_US2024 = 1_704_067_200_000_000
_TRACK = "{{'ext': {0}, 'url': {1}}}"


def _tracks(*pairs: tuple[str, str]) -> str:
    return "[" + ", ".join(_TRACK.format(e, u) for e, u in pairs) + "]"


def _at(name: str) -> str:
    return f"'t/{name}/' || doc_id"


CTES: dict[str, str] = {
    "lines": """SELECT doc_id, i, ls[i] AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), UNNEST(range(1, len(ls) + 1)) AS t(i)""",
    "segs": f"""SELECT media_id, segment_id, 60 * (upto - length(text)) + 200 * segment_id AS start_ms,
            60 * upto + 200 * segment_id AS end_ms, text
        FROM (SELECT doc_id AS media_id, text, row_number() OVER w - 1 AS segment_id,
                CAST(sum(length(text)) OVER w AS BIGINT) AS upto
            FROM (SELECT doc_id, i, {_collapse('line')} AS text FROM lines) WHERE text <> ''
            WINDOW w AS (PARTITION BY doc_id ORDER BY i))""",
    "media": """SELECT doc_id AS media_id, n_chars * 66 AS duration_ms, CASE WHEN doc_id % 7 <> 0 THEN lang END AS language,
            CASE WHEN doc_id % 10 = 3 THEN 'xx' ELSE lang END AS detected FROM documents""",
    "cues": f"""SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY segment_id, g) AS cue_index, segment_id,
            st, lead(st) OVER (PARTITION BY media_id ORDER BY segment_id, g) AS nxt, en, gl
        FROM (SELECT media_id, segment_id, g, gl,
                start_ms + (end_ms - start_ms) * (CAST(upto - chars AS DOUBLE) / total) AS st,
                CASE WHEN upto = total THEN CAST(end_ms AS DOUBLE)
                    ELSE start_ms + (end_ms - start_ms) * (CAST(upto AS DOUBLE) / total) END AS en
            FROM (SELECT *, sum(chars) OVER (PARTITION BY media_id, segment_id ORDER BY g) AS upto,
                    sum(chars) OVER (PARTITION BY media_id, segment_id) AS total
                FROM (SELECT *, lines[2 * g + 1 : 2 * g + 2] AS gl,
                        list_sum(list_transform(lines[2 * g + 1 : 2 * g + 2], lambda l: length(l))) AS chars
                    FROM (SELECT *, {_wrap('text', 42)} AS lines FROM segs), UNNEST(range(0, (len(lines) + 1) // 2)) AS t(g))))""",
    "cut": """SELECT media_id, cue_index, segment_id, gl, st, nxt, CASE WHEN en - st > 7000 THEN st + 7000 ELSE en END AS en FROM cues""",
    "final_cues": """SELECT media_id, cue_index, segment_id, CAST(floor(st + 0.5) AS BIGINT) AS start_ms,
            CAST(floor(CASE WHEN en - st >= 1000 THEN en WHEN nxt IS NULL THEN st + 1000
                ELSE greatest(least(st + 1000, nxt), en) END + 0.5) AS BIGINT) AS end_ms, gl FROM cut""",
    "caps": f"""SELECT d.doc_id AS media_id, 'WEBVTT' || chr(10) || 'Kind: captions' || chr(10) || 'Language: ' || d.lang
            || repeat(chr(10), 2) || 'NOTE made' || repeat(chr(10), 2) || coalesce(body, '') AS text
        FROM documents d LEFT JOIN (
            SELECT media_id, string_agg({_time('start_ms', '.')} || ' --> ' || {_time('end_ms', '.')}
                || ' align:start position:0%' || chr(10) || coalesce(prev || chr(10), '') || ' ' || chr(10)
                || '<00:00:00.500><c>' || text || '</c>' || chr(10) || chr(10), '' ORDER BY segment_id) AS body
            FROM (SELECT *, lag(text) OVER (PARTITION BY media_id ORDER BY segment_id) AS prev FROM segs)
            GROUP BY media_id) b ON b.media_id = d.doc_id""",
    "cap_lines": """SELECT media_id, i - 1 AS line_no, ls[i] AS line
        FROM (SELECT media_id, string_split(text, chr(10)) AS ls FROM caps), UNNEST(range(1, len(ls) + 1)) AS t(i)""",
    "cap_times": r"""SELECT media_id, line_no, line, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY line_no) AS blk,
            CASE WHEN regexp_matches(line, '^\d+:\d\d:\d\d\.\d{3} --> \d+:\d\d:\d\d\.\d{3}( |$)') THEN string_split(line, ' ') END AS f
        FROM cap_lines""",
    "cap_cues": f"""SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY blk) AS n, f, body
        FROM (SELECT o.media_id, o.blk, o.f,
                coalesce(list(t ORDER BY l.line_no) FILTER (WHERE t <> ''), []) AS body
            FROM (SELECT media_id, blk, min(line_no) AS line_no, arg_min(f, line_no) AS f FROM cap_times WHERE f IS NOT NULL GROUP BY ALL) o
            LEFT JOIN (SELECT media_id, blk, line_no, {_trim(_strip('line'))} AS t FROM cap_times WHERE line <> '') l
                ON l.media_id = o.media_id AND l.blk = o.blk AND l.line_no > o.line_no
            GROUP BY o.media_id, o.blk, o.f)""",
    "fold": """SELECT DISTINCT media_id, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS recent, CAST([] AS VARCHAR[]) AS fresh,
            CAST(NULL AS VARCHAR[]) AS f FROM cap_cues
        UNION ALL
        SELECT c.media_id, c.n,
            list_slice(list_concat(p.recent, list_filter(c.body, lambda l: NOT list_contains(p.recent, l))), -8, -1),
            list_filter(c.body, lambda l: NOT list_contains(p.recent, l)), c.f
        FROM fold p JOIN cap_cues c ON c.media_id = p.media_id AND c.n = p.n + 1""",
    "kept_cues": """SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY n) - 1 AS n, fresh, f FROM fold WHERE len(fresh) > 0""",
    "pieces": """SELECT media_id, segment_id, start_ms // 10 AS st, (end_ms - start_ms) // 10 AS span,
            row_number() OVER (PARTITION BY media_id, segment_id ORDER BY wi, k) - 1 AS i,
            count(*) OVER (PARTITION BY media_id, segment_id) AS n,
            (CASE WHEN k = 0 THEN ' ' ELSE '' END) || substr(w, k * 4 + 1, 4) AS text
        FROM (SELECT *, ws[wi] AS w FROM (SELECT *, string_split(text, ' ') AS ws FROM segs), UNNEST(range(1, len(ws) + 1)) AS t(wi)),
            UNNEST(range(0, (length(w) - 1) // 4 + 1)) AS u(k)""",
    "tokens": """SELECT media_id, segment_id, i + i // 6 AS token_index, i AS token_id, text, st + span * i // n AS t0,
            st + span * (i + 1) // n AS t1, (i * 37 % 100) / 100.0 AS probability FROM pieces
        UNION ALL
        SELECT media_id, segment_id, i + i // 6 + 1, i + 50257, '[_TT_]', st, st, 0.5 FROM pieces WHERE i % 6 = 5""",
    "text_tokens": f"SELECT * FROM tokens WHERE token_id < 50257 AND {_trim('text')} <> ''",
    "words": """SELECT media_id, segment_id, min(token_index) AS word_id, ltrim(string_agg(text, '' ORDER BY token_index)) AS word,
            arg_min(t0, token_index) AS start, arg_max(t1, token_index) AS "end", round(avg(probability), 6) AS probability
        FROM (SELECT *, sum(opens) OVER (PARTITION BY media_id, segment_id ORDER BY token_index) AS wn
            FROM (SELECT *, CASE WHEN text LIKE ' %' OR row_number() OVER (PARTITION BY media_id, segment_id ORDER BY token_index) = 1
                THEN 1 ELSE 0 END AS opens FROM text_tokens))
        GROUP BY media_id, segment_id, wn""",
    "spans": f"""SELECT user_id % 5 AS media_id, (epoch_us(ts) - {_US2024}) // 1000000 AS start,
            (epoch_us(ts) - {_US2024}) // 1000000 + CAST(floor(value * 20) AS BIGINT) AS "end" FROM events""",
    "clipped": """SELECT media_id, start, least("end" + 1, max("end") OVER (PARTITION BY media_id)) AS "end" FROM spans WHERE "end" > start""",
    "merged": """SELECT media_id, min(start) AS start, max("end") AS "end"
        FROM (SELECT *, sum(opens) OVER (PARTITION BY media_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island
            FROM (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY media_id ORDER BY start, "end"
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM clipped))
        GROUP BY media_id, island""",
    "laid": """SELECT media_id, start, "end", gap, least(gap, 1600) AS pause,
            CAST(coalesce(sum("end" - start + coalesce(least(gap, 1600), 0)) OVER (PARTITION BY media_id ORDER BY start
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
        FROM (SELECT *, lead(start) OVER (PARTITION BY media_id ORDER BY start) - "end" AS gap FROM merged)""",
    "timemap": """SELECT media_id, 'speech' AS kind, pos AS processed, start AS original, "end" - start AS processed_len, "end" - start AS original_len FROM laid
        UNION ALL
        SELECT media_id,  'silence', pos + "end" - start, "end", pause, gap FROM laid WHERE gap IS NOT NULL""",
    "msgs": f"""SELECT user_id % 5 AS task_id, event_id AS seq, (epoch_us(ts) - {_US2024}) // 60000000 AS ts_ms,
            CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items())} END AS type,
            'm' || (CAST(regexp_extract(props, '\\d+') AS BIGINT) % 3) AS item, CAST(floor(value) AS BIGINT) AS amount FROM events""",
    "chained": """SELECT *, lag(label) OVER w AS before, lead(label) OVER w AS after
        FROM (SELECT *, ts_ms // 100 * 100 AS batch_ms,
                CASE WHEN type IN ('progress', 'segments') THEN type WHEN type = 'download' THEN type || item ELSE 'x' || seq END AS label FROM msgs)
        WINDOW w AS (PARTITION BY task_id, batch_ms ORDER BY seq)""",
    "merged_msgs": """SELECT task_id, seq, ts_ms, type, item, amount, batch_ms, message_seq
        FROM (SELECT *, max(CASE WHEN before IS DISTINCT FROM label THEN seq END) OVER (PARTITION BY task_id, batch_ms ORDER BY seq) AS message_seq FROM chained)
        WHERE NOT (type IN ('progress', 'download') AND after IS NOT DISTINCT FROM label)""",
    "moments": "SELECT DISTINCT task_id, ts_ms FROM msgs",
    "jumps": "SELECT task_id, ts_ms, min(ts_ms) OVER (PARTITION BY task_id ORDER BY ts_ms RANGE BETWEEN 100 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM moments",
    "openings": """SELECT task_id, min(ts_ms) AS opened_ms FROM moments GROUP BY task_id
        UNION ALL SELECT o.task_id, j.nxt FROM openings o JOIN jumps j ON j.task_id = o.task_id AND j.ts_ms = o.opened_ms WHERE j.nxt IS NOT NULL""",
    "checks": "SELECT DISTINCT user_id AS task_id, epoch_us(ts) // 1000 AS ts_ms FROM events",
    "due_next": "SELECT task_id, ts_ms, min(ts_ms) OVER (PARTITION BY task_id ORDER BY ts_ms RANGE BETWEEN 86400000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM checks",
    "due": """SELECT task_id, min(ts_ms) AS opened_ms FROM checks GROUP BY task_id
        UNION ALL SELECT o.task_id, j.nxt FROM due o JOIN due_next j ON j.task_id = o.task_id AND j.ts_ms = o.opened_ms WHERE j.nxt IS NOT NULL""",
    "urls": r"""SELECT page_id, v, CASE
            WHEN page_id % 8 = 0 THEN 'https://www.youtube.com/watch?v=' || v
            WHEN page_id % 8 = 1 THEN 'https://youtu.be/' || v
            WHEN page_id % 8 = 2 THEN 'https://m.youtube.com/watch?list=PL1&v=' || v
            WHEN page_id % 8 = 3 THEN 'https://www.youtube.com/shorts/' || v || '?feature=share'
            WHEN page_id % 8 = 4 THEN 'http://www.youtube.com/watch?v=' || v
            WHEN page_id % 8 = 5 THEN 'https://youtube.com.evil.tld/watch?v=' || v
            WHEN page_id % 16 = 6 THEN 'https://youtu.be/short'
            WHEN page_id % 16 = 14 THEN ' HTTPS://Music.YouTube.com//embed/' || v || '/ '
            WHEN page_id % 16 = 7 THEN url ELSE 'https://user@www.youtube.com/watch?v=' || v END AS url
        FROM (SELECT page_id, url, substr(sha256('v' || (CASE WHEN page_id % 3 = 0 THEN 8 WHEN page_id % 13 = 1 THEN page_id + 1000000000
            ELSE page_id * 4 END)), 1, 11) AS v FROM pages)""",
    "url_parts": r"""SELECT page_id, regexp_extract(u, '^([A-Za-z]+)://', 1) AS scheme, regexp_extract(u, '^[A-Za-z]+://([^/?#@]*)@', 1) AS user,
            lower(regexp_extract(u, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
            list_filter(string_split(regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS segs,
            string_split(regexp_extract(u, '\?([^#]*)', 1), '&') AS qs FROM (SELECT page_id, trim(url) AS u FROM urls)""",
    "canon": r"""SELECT page_id, CASE WHEN ok THEN c END AS video_id, CASE WHEN ok THEN listed END AS had_playlist,
            CASE WHEN ok THEN 'https://www.youtube.com/watch?v=' || c END AS canonical_url, CASE WHEN NOT ok THEN 10 END AS error_code
        FROM (SELECT page_id, c, len(list_filter(qs, lambda q: split_part(q, '=', 1) = 'list')) > 0 AS listed,
                coalesce(lower(scheme) = 'https' AND user = '' AND regexp_matches(c, '^[A-Za-z0-9_-]{11}$')
                    AND host IN ('youtube.com', 'www.youtube.com', 'm.youtube.com', 'music.youtube.com', 'youtu.be'), false) AS ok
            FROM (SELECT *, CASE WHEN host = 'youtu.be' THEN segs[1] WHEN segs = ['watch'] THEN substr(list_filter(qs, lambda q: q LIKE 'v=%')[1], 3)
                WHEN segs[1] IN ('shorts', 'embed', 'live', 'v') THEN segs[2] END AS c FROM url_parts))""",
    "reqs": f"""SELECT page_id AS request_id, url,
            CASE WHEN page_id % 9 = 7 THEN 'auto' ELSE {_list(MODEL_NAMES)}[page_id % 9 + 1] END AS model,
            CASE WHEN page_id % 29 = 5 THEN '/models/custom-q5.bin' END AS model_path, page_id % 5 <> 0 AS vad,
            CASE page_id % 4 WHEN 1 THEN 'fr' WHEN 3 THEN 'en' END AS lang, page_id % 6 = 0 AS translate,
            CASE WHEN page_id % 10 = 3 THEN 'Bonjour' END AS initial_prompt, page_id % 12 = 5 AS word_timestamps,
            CASE WHEN page_id % 11 = 2 THEN CAST(0.6 AS DOUBLE) END AS no_speech_thold, CASE WHEN page_id % 11 = 3 THEN CAST(2.4 AS DOUBLE) END AS entropy_thold,
            page_id // 8 % 2 = 1 AS prefer_subs, page_id % 7 <> 6 AS use_cache,
            CASE WHEN page_id % 5 = 1 THEN 5 ELSE 720 END AS max_duration_min,
            CASE WHEN page_id % 12 = 5 THEN 'json' ELSE 'txt' END AS format,
            CASE WHEN page_id // 4 % 3 = 1 THEN 1300000000 END AS available_bytes FROM urls""",
    "models": "SELECT * FROM (VALUES " + ", ".join(
        "(" + ", ".join(_str(str(x)) if isinstance(x, str) else str(x) for x in m) + ")" for m in (*MODELS, VAD_MODEL)
    ) + ") AS t(alias, file, repo, revision, sha256, size)",
    "named": """SELECT r.*, regexp_replace(coalesce(regexp_extract(model_path, '[^/]+$'), m.file), '\\.[^.]*$', '') AS model_id,
            coalesce(model_path, m.file) AS model_file
        FROM reqs r LEFT JOIN models m ON m.alias = CASE WHEN r.model = 'auto' THEN 'base' ELSE r.model END AND m.alias <> 'silero'""",
    "keyed": r"""SELECT n.*, c.video_id, CASE WHEN c.error_code = 10 THEN 10 WHEN model_id IS NULL THEN 30
            WHEN translate AND contains(lower(model_id), 'turbo') THEN 40 END AS early_code FROM named n JOIN canon c ON c.page_id = n.request_id""",
    "digests": r"""SELECT *, CASE WHEN early_code IS NULL THEN sha256(
            encode(video_id || chr(31) || model_id || chr(31) || coalesce(lang, 'auto') || chr(31))
            || CASE WHEN translate THEN '\x01'::BLOB ELSE '\x00'::BLOB END || CASE WHEN vad THEN '\x01'::BLOB ELSE '\x00'::BLOB END
            || CASE WHEN word_timestamps THEN '\x01'::BLOB ELSE '\x00'::BLOB END
            || CASE WHEN vad THEN encode('vad:j2' || chr(31)) ELSE ''::BLOB END
            || CASE WHEN initial_prompt IS NOT NULL THEN encode('prompt' || chr(31) || initial_prompt || chr(31)) ELSE ''::BLOB END
            || CASE WHEN no_speech_thold IS NOT NULL THEN encode('no_speech_thold' || chr(31)) || '\x9A\x99\x19\x3F'::BLOB ELSE ''::BLOB END
            || CASE WHEN entropy_thold IS NOT NULL THEN encode('entropy_thold' || chr(31)) || '\x9A\x99\x19\x40'::BLOB ELSE ''::BLOB END) END AS digest
        FROM keyed""",
    "stored": "SELECT digest, min('title ' || video_id) AS title FROM digests WHERE digest IS NOT NULL AND request_id % 5 = 1 GROUP BY digest",
    "probes": f"""SELECT doc_id, substr(sha256('v' || doc_id), 1, 11) AS video_id, {_collapse("string_split(text, chr(10))[1]")} AS title,
            source AS channel, CASE WHEN doc_id % 19 <> 0 THEN n_chars / 15.0 END AS duration, '20240131' AS upload_date,
            CASE WHEN doc_id % 7 <> 0 THEN lang END AS language, doc_id % 23 = 0 AS is_live,
            CASE WHEN doc_id % 17 = 0 THEN 'is_upcoming' ELSE 'not_live' END AS live_status, lang AS spoken
        FROM documents WHERE doc_id % 31 <> 30""",
    "tracks": f"""SELECT video_id, l.lang AS lang, l.auto AS auto, p - 1 AS position, l.t[p].ext AS ext, l.t[p].url AS url FROM (
            SELECT video_id, unnest(CASE
                WHEN doc_id % 5 = 1 THEN [{{'lang': spoken, 'auto': false, 't': {_tracks(("'json3'", _at('a')), ("'vtt'", _at('b')))}}}]
                WHEN doc_id % 5 = 2 THEN [{{'lang': 'aa', 'auto': true, 't': {_tracks(("'vtt'", _at('f')))}}},
                    {{'lang': spoken, 'auto': true, 't': {_tracks(("'vtt'", _at('g')))}}}, {{'lang': 'zz', 'auto': true, 't': {_tracks(("'vtt'", _at('h')))}}}]
                WHEN doc_id % 5 = 3 THEN [{{'lang': spoken || '-XX', 'auto': false, 't': {_tracks(("'json3'", _at('c')), ('NULL', _at('d')))}}},
                    {{'lang': spoken, 'auto': true, 't': {_tracks(("'json3'", _at('i')))}}}]
                WHEN doc_id % 5 = 4 THEN [{{'lang': spoken, 'auto': false, 't': {_tracks(("'vtt'", 'NULL'), ("'json3'", _at('e')))}}},
                    {{'lang': spoken, 'auto': true, 't': {_tracks(("'json3'", _at('i')))}}}] END) AS l FROM probes), UNNEST(range(1, len(l.t) + 1)) AS u(p)""",
    "runs": f"""SELECT doc_id AS media_id, {_list(m[0] for m in MODELS)}[doc_id % 6 + 1] AS model, doc_id % 2 = 0 AS vad, n_chars * 66 AS audio_ms,
            coalesce(segments, 0) AS segments, backend, CASE backend WHEN 'cpu' THEN doc_id * 131 % 5000 ELSE doc_id * 131 % 5000 // 3 END AS elapsed_ms
        FROM documents LEFT JOIN (SELECT media_id, count(*) AS segments FROM segs GROUP BY 1) s ON s.media_id = doc_id, (VALUES ('cpu'), ('vulkan')) AS b(backend)""",
    "timed_runs": "SELECT *, 600 + elapsed_ms % 977 AS peak_mb, CASE WHEN elapsed_ms > 0 THEN floor(CAST(audio_ms AS DOUBLE) / elapsed_ms * 10 + 0.5) / 10 ELSE 0.0 END AS speed FROM runs",
    "stderr": f"SELECT event_id, {_list(STDERR)}[CAST(regexp_extract(props, '\\d+') AS BIGINT) % 12 + 1] AS message FROM events WHERE event_type = 'error'",
    "classified": f"""SELECT event_id, message, CASE WHEN {_any('message', AUTH_NEEDLES)} THEN 12 WHEN {_any('message', UNAVAILABLE_NEEDLES)} THEN 11
            WHEN {_any('message', LIVE_NEEDLES)} THEN 13 ELSE 20 END AS code FROM stderr""",
    "codes": "SELECT * FROM (VALUES " + ", ".join(f"({c}, '{v}')" for c, v in EXIT_CODES) + ") AS t(code, variant)",
    "entries": """SELECT doc_id AS entry_id, sha256(text) AS digest, n_chars AS bytes, doc_id * 7919 % 61 AS accessed,
            doc_id * 7919 % 1000003 AS written_at, 'title ' || doc_id AS title FROM documents""",
    "latest": "SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY digest ORDER BY written_at DESC, entry_id DESC) = 1",
    "pairs": """SELECT doc_id AS left_id, nxt AS right_id FROM (SELECT doc_id, lead(doc_id) OVER (PARTITION BY lang ORDER BY doc_id) AS nxt FROM documents)
        WHERE nxt IS NOT NULL""",
    "looped": "SELECT media_id, arg_min(text, segment_id) AS text, count(*) AS n FROM segs GROUP BY media_id, lower(text) HAVING count(*) > 3",
    "cut_lists": r"""SELECT doc_id AS media_id, list_distinct(list_filter(string_split_regex(lower(string_split(text, '.')[1]), '[^\p{L}\p{N}]+'), lambda w: length(w) > 3)) AS ws
        FROM documents WHERE doc_id % 3 = 0""",
    "wordlists": r"""SELECT doc_id AS media_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) > 3)) AS ws FROM documents""",
    "vocab": r"""SELECT DISTINCT doc_id AS media_id, w AS word FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS w FROM documents)
        WHERE length(w) > 3""",
    "runs_of_text": """SELECT media_id, text, count(*) AS n, min(segment_id) AS first_segment, min(start_ms) AS start_ms, max(end_ms) AS end_ms
        FROM (SELECT *, segment_id - row_number() OVER (PARTITION BY media_id, text ORDER BY segment_id) AS isle FROM segs) GROUP BY media_id, text, isle""",
    "watch_runs": """SELECT user_id AS target_id, epoch_us(ts) // 1000 AS ts_ms, event_id AS seq, epoch_us(ts) // 86400000000 AS day,
            CASE WHEN event_type IN ('view', 'signup') THEN 'success' ELSE 'failure' END AS state FROM events WHERE event_type <> 'click'""",
    "actions": """SELECT target_id, ts_ms, seq, day, action FROM (
            SELECT *, CASE WHEN state = 'failure' AND prev = 'failure' THEN 'append' WHEN state = 'failure' THEN 'open'
                WHEN prev = 'failure' THEN 'close' END AS action
            FROM (SELECT *, lag(state) OVER (PARTITION BY target_id ORDER BY ts_ms, seq) AS prev FROM watch_runs))
        WHERE action IS NOT NULL""",
}


def _sql(body: str) -> str:
    """Put the building blocks that `body` mentions, and theirs, in front."""
    order: list[str] = []

    def need(sql: str) -> None:
        found = set(re.findall(r"(?:FROM|JOIN|,)\s+\(?([a-z_]+)\b", sql))
        for name in CTES:
            if name in found and name not in order and name not in active:
                active.append(name)
                need(CTES[name])
                order.append(name)

    active: list[str] = []
    need(body)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + body


def _round6(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


def _render(piece: str) -> str:
    return f"SELECT media_id, 0 AS part, string_agg({piece}, '' ORDER BY cue_index) AS content FROM final_cues GROUP BY media_id"


_SRT = (f"cue_index || chr(10) || {_time('start_ms', ',')} || ' --> ' || {_time('end_ms', ',')} || chr(10) "
        "|| array_to_string(gl, chr(10)) || repeat(chr(10), 2)")
_VTT = (f"(CASE WHEN cue_index = 1 THEN 'WEBVTT' || repeat(chr(10), 2) ELSE '' END) || {_time('start_ms', '.')} || ' --> ' || {_time('end_ms', '.')} || chr(10) "
        "|| replace(replace(replace(array_to_string(gl, chr(10)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || repeat(chr(10), 2)")
_TXT = "SELECT media_id, 0 AS part, string_agg(text, ' ' ORDER BY segment_id) || chr(10) AS content FROM segs GROUP BY media_id"
_FILENAME = (
    "coalesce(nullif(regexp_replace(substr({c}, 1, 80), '[. ]+$', ''), ''), 'transcription') || '.'"
)


def _filename(title: str) -> str:
    spaced = f"regexp_replace({title}, '[\\x00-\\x1f\\x7f-\\x{{9f}}<>:\"/\\\\|?*]', ' ', 'g')"
    return _FILENAME.format(c=_collapse(spaced))


_CHECKED = """SELECT m.media_id, m.duration_ms, s.segment_id, s.start_ms, s.end_ms,
    s.start_ms < lag(s.start_ms) OVER (PARTITION BY s.media_id ORDER BY s.segment_id) - 10 AS backward"""
_KINDS = [*SILENT_EVENTS, *PHASES, *NOTICES, *OTHER_TYPES]


def _case(table: dict[str, str], column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {_str(v)}" for k, v in table.items()) + " END"


def _samples(x: str) -> str:
    return f"CAST(floor(CAST(CAST({x} AS FLOAT) AS DOUBLE) * 160 + 0.5) AS BIGINT)"


_NEED = "1073741824 + CAST(ceil(duration * {0}.0) AS BIGINT)"
_MAX_MIN = "CASE WHEN ({0}) IS NOT NULL THEN greatest(({0}) // 100 * 85 - 1073741824, 0) // {1} // 60 END"
_BEST = """SELECT p.video_id, t.lang, t.auto, t.url FROM (SELECT video_id, {0} AS wanted FROM probes) p LEFT JOIN (
    SELECT video_id, lang, auto, url, asked FROM (
        SELECT *, row_number() OVER (PARTITION BY video_id, asked ORDER BY auto) AS r FROM (
            SELECT * FROM (SELECT t.*, w.asked,
                    row_number() OVER (PARTITION BY t.video_id, w.asked, t.auto ORDER BY t.lang, coalesce(t.ext = 'vtt', false) DESC, t.position) AS k
                FROM (SELECT *, (SELECT count(DISTINCT lang) FROM tracks o WHERE o.video_id = tracks.video_id AND o.auto = tracks.auto) AS n_langs FROM tracks) t
                JOIN (SELECT video_id, {0} AS asked FROM probes) w ON w.video_id = t.video_id
                WHERE t.lang = w.asked OR split_part(t.lang, '-', 1) = w.asked OR (w.asked IS NULL AND n_langs = 1))
            WHERE k = 1 AND url IS NOT NULL)) WHERE r = 1) t ON t.video_id = p.video_id"""


def _best(requested: str) -> str:
    return _BEST.format(f"coalesce({requested}, language)")


_INST = ", ".join(_str(f) for f in INSTALLED)

_PLAN = f"""SELECT request_id, CASE WHEN early_code IS NULL OR early_code <> 10 THEN video_id END AS video_id, digest, split_part(o, ' ', 1) AS outcome,
    CAST(nullif(split_part(o, ' ', 2), '') AS INTEGER) AS code,
    CASE WHEN o = 'subtitles' THEN tlang END AS track_lang, CASE WHEN o = 'subtitles' THEN tauto END AS track_auto,
    CASE WHEN o = 'inference' THEN 1073741824 + CAST(ceil(coalesce(duration, 0) * (CASE WHEN word_timestamps THEN 224000.0 ELSE 160000.0 END)) AS BIGINT) END AS est_bytes
FROM (SELECT *, CASE WHEN early_code IS NOT NULL THEN 'refused ' || early_code WHEN use_cache AND hit THEN 'cache'
        WHEN NOT prefer_subs AND no_model THEN 'refused 30' WHEN probed IS NULL THEN 'refused 20'
        WHEN is_live OR live_status = 'is_upcoming' THEN 'refused 13' WHEN NOT prefer_subs AND long THEN 'refused 14'
        WHEN prefer_subs AND turl IS NOT NULL THEN 'subtitles' WHEN long THEN 'refused 14' WHEN no_model THEN 'refused 30'
        WHEN duration IS NOT NULL AND 1073741824 + ceil(duration * (CASE WHEN word_timestamps THEN 224000.0 ELSE 160000.0 END)) > available_bytes // 100 * 85 THEN 'refused 15'
        ELSE 'inference' END AS o
    FROM (SELECT d.*, s.digest IS NOT NULL AS hit, model_file NOT IN ({_INST}) AS no_model, p.video_id AS probed, p.duration, p.is_live, p.live_status,
            coalesce(ceil(p.duration / 60) > max_duration_min, false) AS long, b.lang AS tlang, b.auto AS tauto, b.url AS turl
        FROM digests d LEFT JOIN stored s ON s.digest = d.digest LEFT JOIN probes p ON p.video_id = d.video_id
        LEFT JOIN (SELECT video_id, asked, arg_min(lang, auto) AS lang, min(auto) AS auto, arg_min(url, auto) AS url FROM (
                SELECT t.video_id, w.asked, t.auto, arg_min(t.lang, (t.lang, coalesce(t.ext <> 'vtt', true), t.position)) AS lang,
                    arg_min_null(t.url, (t.lang, coalesce(t.ext <> 'vtt', true), t.position)) AS url
                FROM tracks t JOIN (SELECT p.video_id, l.asked AS raw, coalesce(l.asked, p.language) AS want, l.asked AS asked
                    FROM probes p, (VALUES ('fr'), ('en'), (NULL)) AS l(asked)) w ON w.video_id = t.video_id
                JOIN (SELECT video_id, auto, count(DISTINCT lang) AS n FROM tracks GROUP BY ALL) c ON c.video_id = t.video_id AND c.auto = t.auto
                WHERE t.lang = w.want OR split_part(t.lang, '-', 1) = w.want OR (w.want IS NULL AND c.n = 1)
                GROUP BY t.video_id, w.asked, t.auto) WHERE url IS NOT NULL GROUP BY video_id, asked) b
            ON b.video_id = d.video_id AND b.asked IS NOT DISTINCT FROM d.lang))"""

_DETAIL = f"""CASE code WHEN 13 THEN NULL WHEN 20 THEN {_trim('message')} ELSE
    CASE WHEN octet_length(encode({_trim('message')})) <= 400 THEN {_trim('message')} ELSE '…' || right({_trim('message')}, 401) END END"""

_BODIES: dict[str, str] = {
    "read_requests": """SELECT request_id, url, model, model_path, vad, lang, translate, initial_prompt, word_timestamps, no_speech_thold, entropy_thold,
        prefer_subs, use_cache, max_duration_min, 42 AS max_line_width, 2 AS max_line_count, format, available_bytes FROM reqs""",
    "read_probe_json": f"""SELECT d.doc_id, p.video_id, coalesce(p.title, '') AS title, p.channel, {_round6('p.duration', 'duration')}, p.upload_date, p.language,
        p.is_live, p.live_status, CASE WHEN p.video_id IS NOT NULL THEN 0 END AS age_limit, CASE WHEN p.video_id IS NULL THEN 20 END AS error_code,
        CASE WHEN p.video_id IS NOT NULL AND d.doc_id % 5 IN (1, 3, 4) THEN 1 ELSE 0 END AS n_subtitles,
        CASE WHEN p.video_id IS NULL THEN 0 WHEN d.doc_id % 5 = 2 THEN 3 WHEN d.doc_id % 5 >= 3 THEN 1 ELSE 0 END AS n_automatic
        FROM documents d LEFT JOIN probes p ON p.doc_id = d.doc_id""",
    "read_caption_files": """SELECT c.media_id, coalesce(n, 0) AS n_cues, CASE WHEN coalesce(k, 0) = 0 THEN 20 END AS error_code
        FROM caps c LEFT JOIN (SELECT media_id, count(*) AS n, count(*) FILTER (WHERE len(body) > 0) AS k FROM cap_cues GROUP BY media_id) x ON x.media_id = c.media_id""",
    "parse_vtt": """SELECT k.media_id, n AS segment_id, {0} AS start_ms, {1} AS end_ms, array_to_string(fresh, ' ') AS text FROM kept_cues k""".format(*[
        f"CAST(split_part(f[{i}], ':', 1) AS BIGINT) * 3600000 + CAST(split_part(f[{i}], ':', 2) AS BIGINT) * 60000 + CAST(replace(split_part(f[{i}], ':', 3), '.', '') AS BIGINT)"
        for i in (1, 3)]),
    "read_transcript_json": "SELECT substr(sha256('v' || media_id), 1, 11) AS media_id, segment_id, start_ms, end_ms, text FROM segs WHERE media_id % 10 <> 9",
    "read_bench_json": f"""SELECT model, backend, 8 AS threads, vad, {_round6('audio_ms / 1000.0', 'audio_s')}, {_round6('elapsed_ms / 1000.0', 'inference_s')},
        {_round6('speed', 'speed')}, segments FROM timed_runs""",
    "read_checksums": """SELECT page_id, 'page-' || page_id AS name, sha256(url) AS sum FROM pages
        UNION ALL SELECT page_id, 'page-' || page_id || '.exe', sha256(html) FROM pages""",
    "model_catalogue": """SELECT m.*, coalesce(n, 0) AS requests FROM models m LEFT JOIN (
        SELECT CASE WHEN model = 'auto' THEN 'base' ELSE model END AS a, count(*) AS n FROM reqs GROUP BY 1) r ON r.a = m.alias""",
    "render_txt": _TXT,
    "render_srt": _render(_SRT),
    "render_vtt": _render(_VTT),
    "render": f"""SELECT media_id, 'txt' AS format, length(content) AS chars FROM ({_TXT})
        UNION ALL SELECT media_id, 'srt', length(content) FROM ({_render(_SRT)}) UNION ALL SELECT media_id, 'vtt', length(content) FROM ({_render(_VTT)})""",
    "render_json": f"""SELECT p.doc_id AS media_id, 0 AS part, 1 AS schema_version, p.video_id, p.title, {_round6('p.duration', 'duration_s')}, 'whisper.cpp' AS engine,
        r.model, r.elapsed_ms AS duration_ms, {_round6('r.speed', 'speed_realtime')}, coalesce(s.n, 0) AS segments, {_round6('s.last_end', 'last_end')},
        md5(coalesce(s.txt, '')) AS text_md5, false AS shows_absent
        FROM probes p JOIN timed_runs r ON r.media_id = p.doc_id AND r.backend = 'cpu'
        LEFT JOIN (SELECT media_id, count(*) AS n, arg_max(end_ms, segment_id) / 1000.0 AS last_end, string_agg(text, chr(10) ORDER BY segment_id) AS txt
            FROM segs GROUP BY media_id) s ON s.media_id = p.doc_id""",
    "safe_filename": "SELECT doc_id, " + _filename(
        """CASE WHEN doc_id % 9 = 4 THEN ' ?? ' ELSE (CASE WHEN doc_id % 3 = 0 THEN 'a/b: "c" ? ' ELSE '' END)
        || string_split(text, chr(10))[1] END""") + " || 'srt' AS filename FROM documents",
    "write_documents": f"""SELECT media_id, format, {_filename('d.source')} || format AS filename, part, md5(content) AS md5 FROM (
        SELECT *, 'txt' AS format FROM ({_TXT}) UNION ALL SELECT *, 'vtt' FROM ({_render(_VTT)})) x JOIN documents d ON d.doc_id = x.media_id""",
    "cache_put": """SELECT digest, entry_id, bytes, written_at, title FROM (
        SELECT * FROM entries UNION ALL SELECT * REPLACE (written_at - 5000 AS written_at) FROM entries WHERE entry_id % 3 = 0)
        QUALIFY row_number() OVER (PARTITION BY digest ORDER BY written_at DESC, entry_id DESC) = 1""",
    "canonical_url": "SELECT page_id, video_id, had_playlist, canonical_url, error_code FROM canon",
    "had_playlist": "SELECT had_playlist, count(*) AS n FROM canon WHERE error_code IS NULL GROUP BY 1",
    "classify_error": f"SELECT event_id, code, {_DETAIL} AS detail FROM classified",
    "error_code": "SELECT c.code, variant, coalesce(n, 0) AS n FROM codes c LEFT JOIN (SELECT code, count(*) AS n FROM classified GROUP BY 1) x ON x.code = c.code",
    "collapse_ws": f"SELECT doc_id, {_collapse('text')} AS text FROM documents",
    "strip_tags": f"SELECT page_id, {_strip('html')} AS text FROM pages",
    "vtt_escape": "SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS md5 FROM pages",
    "parse_timestamp": r"""SELECT media_id, line_no, round(CASE
            WHEN regexp_matches(t, '^\d+:\d+:\d+(\.\d*)?$') THEN CAST(split_part(t, ':', 1) AS DOUBLE) * 3600 + CAST(split_part(t, ':', 2) AS DOUBLE) * 60 + CAST(split_part(t, ':', 3) AS DOUBLE)
            WHEN regexp_matches(t, '^\d+:\d+(\.\d*)?$') THEN CAST(split_part(t, ':', 1) AS DOUBLE) * 60 + CAST(split_part(t, ':', 2) AS DOUBLE) END, 6) AS seconds
        FROM (SELECT media_id, line_no, trim(replace(CASE line_no % 3 WHEN 1 THEN substr(l, 4, 20) ELSE l END, ',', '.')) AS t
            FROM (SELECT media_id, line_no, split_part(line, '-->', 1) AS l FROM cap_lines))""",
    "parse_cue_timing": """SELECT media_id, line_no, {0} AS start_ms, {1} AS end_ms FROM cap_times WHERE f IS NOT NULL""".format(*[
        f"CAST(split_part(f[{i}], ':', 1) AS BIGINT) * 3600000 + CAST(split_part(f[{i}], ':', 2) AS BIGINT) * 60000 + CAST(replace(split_part(f[{i}], ':', 3), '.', '') AS BIGINT)"
        for i in (1, 3)]),
    "format_timestamp": f"SELECT media_id, segment_id, {_time('(start_ms * 997 - 1000)', ',')} AS srt, {_time('(start_ms * 997 - 1000)', '.')} AS vtt FROM segs",
    "lang_primary": "SELECT split_part(lang, '-', 1) AS primary_lang, auto, count(*) AS n FROM tracks GROUP BY ALL",
    "is_live": "SELECT video_id, is_live OR live_status IN ('is_live', 'is_upcoming', 'post_live') AS live FROM probes",
    "duration_min": "SELECT video_id, CAST(ceil(duration / 60) AS BIGINT) AS minutes FROM probes",
    "memory_required": f"SELECT video_id, {_NEED.format(160000)} AS bytes, {_NEED.format(224000)} AS bytes_with_words FROM probes",
    "memory_budget": "SELECT request_id, (available_bytes + request_id * 7919) // 100 * 85 AS budget FROM reqs",
    "max_minutes": f"""SELECT request_id, {_MAX_MIN.format('available_bytes + request_id * 7919000', 160000)} AS minutes,
        {_MAX_MIN.format('available_bytes + request_id * 7919000', 224000)} AS minutes_with_words FROM reqs""",
    "normalise_prompt": "SELECT request_id, initial_prompt AS prompt FROM reqs",
    "model_id": "SELECT request_id, model_id FROM named",
    "translate_supported": """SELECT request_id, NOT (translate AND (CASE WHEN model = 'auto' AND model_path IS NULL THEN true ELSE contains(lower(model_id), 'turbo') END)) AS supported
        FROM named""",
    "config_digest": "SELECT request_id, early_code, digest FROM digests",
    "speed_realtime": f"SELECT media_id, backend, {_round6('speed', 'speed')} FROM timed_runs",
    "cs_to_samples": f"SELECT event_id, CASE WHEN event_id % 50 IN (0, 1) THEN 0 ELSE {_samples('value')} END AS samples FROM events",
    "admit_requests": f"""SELECT request_id, code, CASE WHEN code IN (14, 15) THEN CAST(ceil(duration / 60) AS BIGINT) END AS actual_min,
        CASE code WHEN 14 THEN max_duration_min WHEN 15 THEN CASE WHEN word_timestamps THEN {_MAX_MIN.format('available_bytes', 224000)} ELSE {_MAX_MIN.format('available_bytes', 160000)} END END AS limit_min,
        CASE WHEN code = 15 THEN available_bytes // 1048576 END AS available_mb,
        CASE WHEN code = 15 AND word_timestamps THEN {_MAX_MIN.format('available_bytes', 160000)} END AS limit_without_words_min
        FROM (SELECT r.*, p.duration, CASE WHEN is_live OR live_status = 'is_upcoming' THEN 13 WHEN ceil(duration / 60) > max_duration_min THEN 14
            WHEN 1073741824 + ceil(duration * (CASE WHEN word_timestamps THEN 224000.0 ELSE 160000.0 END)) > available_bytes // 100 * 85 THEN 15 END AS code
            FROM reqs r JOIN urls u ON u.page_id = r.request_id LEFT JOIN probes p ON p.video_id = u.v)""",
    "drop_empty_segments": "SELECT media_id, count(*) AS segments FROM segs GROUP BY media_id",
    "filter_no_speech": """SELECT media_id, segment_id, CASE WHEN segment_id % 10 <> 9 THEN (segment_id * 37 % 100) / 100.0 END AS no_speech_prob
        FROM segs WHERE segment_id % 10 = 9 OR (segment_id * 37 % 100) / 100.0 <= 0.6""",
    "short_cues": "SELECT media_id, cue_index, start_ms, end_ms FROM final_cues WHERE end_ms - start_ms < 400",
    "project_events": f"""SELECT event_id, kind, event_type AS text, coalesce(CASE WHEN phase IS NOT NULL THEN 'phase' WHEN message IS NOT NULL THEN 'notice' END,
            {_case(OTHER_TYPES, 'kind')}) AS type, phase, message
        FROM (SELECT *, {_case(PHASES, 'kind')} AS phase, {_case(NOTICES, 'kind')} AS message
            FROM (SELECT event_id, event_type, {_list(_KINDS)}[CAST(regexp_extract(props, '\\d+') AS BIGINT) % {len(_KINDS)} + 1] AS kind FROM events))
        WHERE kind NOT IN ({', '.join(_str(k) for k in SILENT_EVENTS)})""",
    "transcribable_tokens": "SELECT media_id, count(*) AS tokens, CAST(sum(token_index) AS BIGINT) AS index_sum FROM text_tokens GROUP BY media_id",
    "cache_lookup": """SELECT d.digest, d.request_id, s.title AS cached_title, s.digest IS NOT NULL AS cached FROM digests d LEFT JOIN stored s ON s.digest = d.digest
        WHERE d.digest IS NOT NULL""",
    "cache_misses": "SELECT request_id, digest FROM digests WHERE digest IS NOT NULL AND digest NOT IN (SELECT digest FROM stored)",
    "select_track": _best("CASE doc_id % 3 WHEN 0 THEN 'fr' WHEN 2 THEN language END"),
    "is_translation": f"""SELECT b.video_id, b.lang, coalesce(split_part(b.lang, '-', 1) <> p.language, false) AS translation
        FROM ({_best("CASE WHEN doc_id % 2 = 0 THEN 'zz' END")}) b JOIN probes p ON p.video_id = b.video_id WHERE b.url IS NOT NULL""",
    "remap_timeline": f"""SELECT point_id, q.media_id, q.processed, CASE WHEN m.media_id IS NULL THEN q.processed
            WHEN q.processed - m.processed >= m.processed_len THEN m.original + m.original_len + (q.processed - m.processed - m.processed_len)
            ELSE m.original + (q.processed - m.processed) * m.original_len // m.processed_len END AS original
        FROM (SELECT event_id AS point_id, user_id % 6 AS media_id, (epoch_us(ts) - {_US2024}) // 1000000 AS processed FROM events) q
        ASOF LEFT JOIN timemap m ON m.media_id = q.media_id AND m.processed <= q.processed""",
    "words_outside_segment": """SELECT w.media_id, w.segment_id, w.word_id, w.a AS start_ms, w.b AS end_ms FROM (
            SELECT *, start * 10 + (CASE WHEN segment_id % 13 = 0 THEN 200 ELSE 0 END) AS a, "end" * 10 + (CASE WHEN segment_id % 13 = 0 THEN 200 ELSE 0 END) AS b FROM words) w
        JOIN segs s ON s.media_id = w.media_id AND s.segment_id = w.segment_id WHERE w.a < s.start_ms - 50 OR w.b > s.end_ms + 50""",
    "resolve_model": """SELECT request_id, a AS alias, m.file, m.size, CASE WHEN m.file IS NULL THEN 30 END AS error_code FROM (
            SELECT request_id, CASE WHEN model <> 'auto' THEN model WHEN request_id % 2 = 0 THEN 'turbo' ELSE 'base' END AS a FROM reqs) r
        LEFT JOIN models m ON m.alias = r.a AND m.alias <> 'silero'""",
    "verify_files": """SELECT 'page-' || page_id AS name, CASE WHEN page_id % 11 = 0 THEN 'missing' WHEN page_id % 7 = 0 THEN 'corrupt' ELSE 'installed' END AS quick,
        CASE WHEN page_id % 11 = 0 THEN 'missing' WHEN page_id % 7 = 0 OR page_id % 5 = 0 THEN 'corrupt' ELSE 'installed' END AS "full" FROM pages""",
    "language_mismatch": "SELECT media_id, detected, language AS declared FROM media WHERE language IS NOT NULL AND detected <> language",
    "compare_paths": r"""SELECT coalesce(a.media_id, b.media_id) AS media_id, a.n AS left_segments, a.c AS left_covered_ms, b.n AS right_segments, b.c AS right_covered_ms,
            v.overlap
        FROM (SELECT media_id, count(*) AS n, arg_max(end_ms, segment_id) AS c FROM segs WHERE media_id % 6 <> 0 GROUP BY 1) a
        FULL JOIN (SELECT media_id, count(*) AS n, arg_max(end_ms, segment_id) AS c FROM segs WHERE media_id % 4 <> 0 AND segment_id % 3 <> 1 GROUP BY 1) b ON a.media_id = b.media_id
        LEFT JOIN (SELECT media_id, round(CAST(count(*) FILTER (WHERE l AND r) AS DOUBLE) / greatest(least(count(*) FILTER (WHERE l), count(*) FILTER (WHERE r)), 1), 6) AS overlap
            FROM (SELECT media_id, w, bool_or(media_id % 6 <> 0) AS l, bool_or(media_id % 4 <> 0 AND segment_id % 3 <> 1) AS r
                FROM (SELECT media_id, segment_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS w FROM segs) WHERE length(w) > 3 GROUP BY media_id, w)
            WHERE l OR r GROUP BY media_id) v ON v.media_id = coalesce(a.media_id, b.media_id)""",
    "assemble_words": 'SELECT media_id, segment_id, word_id, word, start, "end", probability FROM words',
    "assemble_words_mapped": """SELECT media_id, segment_id, word_id, word, probability,
            start * 10 + (segment_id + 1) * 3000 AS start_ms, "end" * 10 + (segment_id + 1) * 3000 AS end_ms FROM words""",
    "coverage": """SELECT m.media_id, c AS covered_ms, duration_ms, round(CAST(c AS DOUBLE) / duration_ms, 6) AS coverage, c > duration_ms * 0.9 AS sufficient
        FROM media m JOIN (SELECT media_id, arg_max(end_ms, segment_id) AS c FROM segs GROUP BY 1) s ON s.media_id = m.media_id""",
    "repeated_segments": "SELECT media_id, text, n FROM looped",
    "top_repeats": """SELECT media_id, r AS rank, n, CASE WHEN length(text) > 55 THEN substr(text, 1, 55) || '...' ELSE text END AS label
        FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY n DESC, text) AS r FROM (
            SELECT * FROM looped)) WHERE r <= 5""",
    "vocab_overlap": """SELECT left_id, right_id, coalesce(a.n, 0) AS left_words, coalesce(b.n, 0) AS right_words, coalesce(s.n, 0) AS shared,
            round(CAST(coalesce(s.n, 0) AS DOUBLE) / greatest(least(coalesce(a.n, 0), coalesce(b.n, 0)), 1), 6) AS overlap,
            CAST(coalesce(s.n, 0) AS DOUBLE) / greatest(least(coalesce(a.n, 0), coalesce(b.n, 0)), 1) > 0.55 AS agrees
        FROM pairs p LEFT JOIN (SELECT media_id, count(*) AS n FROM vocab GROUP BY 1) a ON a.media_id = left_id
        LEFT JOIN (SELECT media_id, count(*) AS n FROM vocab GROUP BY 1) b ON b.media_id = right_id
        LEFT JOIN (SELECT left_id AS l, count(*) AS n FROM pairs q JOIN vocab x ON x.media_id = q.left_id JOIN vocab y ON y.media_id = q.right_id AND y.word = x.word GROUP BY 1) s ON s.l = left_id""",
    "vocab_intersect": """SELECT left_id, right_id, unnest(list_intersect(x.ws, y.ws)) AS word
        FROM pairs q JOIN wordlists x ON x.media_id = q.left_id JOIN wordlists y ON y.media_id = q.right_id""",
    "caption_langs": """SELECT video_id, CASE WHEN doc_id % 5 = 1 THEN spoken WHEN doc_id % 5 = 2 THEN 'aa,' || spoken || ',zz'
        WHEN doc_id % 5 = 3 THEN spoken || '-XX,' || spoken WHEN doc_id % 5 = 4 THEN spoken ELSE '' END AS langs FROM probes""",
    "auto_caption_origin": "SELECT video_id, CASE WHEN doc_id % 5 >= 2 THEN language END AS origin FROM probes",
    "cache_stats": """SELECT count(*) AS entries, CAST(sum(bytes) AS BIGINT) AS total_bytes, max(accessed) AS last_access,
        arg_max(title, (accessed, digest)) AS last_title FROM latest""",
    "bench_summary": """SELECT model, backend, vad, count(*) AS runs, round(avg(speed), 4) AS mean_speed, round(min(speed), 6) AS min_speed, round(max(speed), 6) AS max_speed,
        CAST(sum(segments) AS BIGINT) AS segments, max(peak_mb) AS max_peak_mb, quantile_disc(speed, 0.5) AS speed_p50, quantile_disc(speed, 0.95) AS speed_p95,
        CAST(quantile_disc(peak_mb, 0.5) AS DOUBLE) AS peak_mb_p50, CAST(quantile_disc(peak_mb, 0.95) AS DOUBLE) AS peak_mb_p95 FROM timed_runs GROUP BY ALL""",
    "bench_by_backend": """SELECT backend, count(*) AS runs, max(peak_mb) AS max_peak_mb, round(avg(speed), 4) AS mean_speed,
        quantile_disc(speed, 0.5) AS speed_p50, quantile_disc(speed, 0.95) AS speed_p95,
        CAST(quantile_disc(peak_mb, 0.5) AS DOUBLE) AS peak_mb_p50, CAST(quantile_disc(peak_mb, 0.95) AS DOUBLE) AS peak_mb_p95 FROM timed_runs GROUP BY ALL""",
    "quality_report": f"""SELECT * REPLACE (round(overlap, 6) AS overlap), anomalies = 0 AS passed FROM (SELECT *, (CASE WHEN covered THEN 0 ELSE 1 END) + (CASE WHEN language_ok THEN 0 ELSE 1 END)
            + (CASE WHEN short_cues > 0 THEN 1 ELSE 0 END) + (CASE WHEN order_faults > 0 THEN 1 ELSE 0 END) + (CASE WHEN overlap <= 0.55 THEN 1 ELSE 0 END) AS anomalies
        FROM (SELECT m.media_id, coalesce(x.n, 0) AS segments, x.c AS covered_ms, coalesce(x.c > m.duration_ms * 0.95, false) AS covered, coalesce(x.s, 0) AS short_cues,
                coalesce(x.f, 0) AS order_faults, coalesce(l.n, 0) AS loops, m.language IS NULL OR m.language IS NOT DISTINCT FROM m.detected AS language_ok
            FROM media m LEFT JOIN (SELECT media_id, count(*) AS n, arg_max(end_ms, segment_id) AS c, count(*) FILTER (WHERE end_ms - start_ms < 100) AS s,
                    count(*) FILTER (WHERE start_ms < 0 OR end_ms < start_ms OR backward OR end_ms > duration_ms + 1000) AS f
                FROM ({_CHECKED} FROM segs s JOIN media m ON m.media_id = s.media_id) GROUP BY media_id) x ON x.media_id = m.media_id
            LEFT JOIN (SELECT media_id, count(*) AS n FROM looped GROUP BY 1) l ON l.media_id = m.media_id)
            LEFT JOIN (SELECT x.media_id, len(list_intersect(x.ws, y.ws)) / greatest(least(len(x.ws), len(y.ws)), 1) AS overlap
                FROM cut_lists x JOIN wordlists y ON y.media_id = x.media_id) v USING (media_id))""",
    "error_summary": """SELECT x.code, variant, x.n FROM (SELECT coalesce(c.code, 0) AS code, count(*) AS n FROM events e LEFT JOIN classified c ON c.event_id = e.event_id GROUP BY 1) x
        JOIN codes k ON k.code = x.code""",
    "pcm_decode": r"""SELECT media_id, chunk_no, len(v) AS n_samples, CAST(coalesce(list_sum(v), 0) AS BIGINT) AS sample_sum, CAST(list_max(list_transform(v, lambda x: abs(x))) AS BIGINT) AS peak
        FROM (SELECT media_id, chunk_no, list_transform(range(0, length(h) // 4), lambda k: CASE WHEN u[k + 1] >= 32768 THEN u[k + 1] - 65536 ELSE u[k + 1] END) AS v
            FROM (SELECT *, list_transform(range(0, length(h) // 4), lambda k: CAST('0x' || substr(h, CAST(k * 4 + 3 AS BIGINT), 2) || substr(h, CAST(k * 4 + 1 AS BIGINT), 2) AS BIGINT)) AS u
                FROM (SELECT media_id, chunk_no, (CASE WHEN before % 2 = 1 THEN low ELSE '' END) || hx AS h
                    FROM (SELECT doc_id AS media_id, i - 1 AS chunk_no, hex(encode(line)) AS hx,
                            coalesce(sum(length(hex(encode(line))) // 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                            last_value(CASE WHEN line <> '' THEN right(hex(encode(line)), 2) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low
                        FROM lines))))""",
    "pcm_summary": """SELECT media_id, b // 2 AS n_samples, round(b // 2 / 16000.0, 7) AS duration_s, b % 2 = 1 AS pending_byte, CASE WHEN b // 2 = 0 THEN 20 END AS error_code
        FROM (SELECT doc_id AS media_id, CAST(sum(octet_length(encode(line))) AS BIGINT) AS b FROM lines GROUP BY doc_id)""",
    "wrap_lines": f"SELECT media_id, segment_id, array_to_string({_wrap('text', 42)}, chr(10)) AS wide, array_to_string({_wrap('text', 6)}, chr(10)) AS narrow FROM segs",
    "build_cues": "SELECT media_id, cue_index, segment_id, start_ms, end_ms, array_to_string(gl, chr(10)) AS lines FROM final_cues",
    "clamp_cue_durations": """SELECT media_id, cue_index, start_ms, CASE WHEN c - start_ms >= 1000 THEN c WHEN nxt IS NULL THEN start_ms + 1000 ELSE greatest(least(start_ms + 1000, nxt), c) END AS end_ms
        FROM (SELECT media_id, segment_id AS cue_index, start_ms, lead(start_ms) OVER (PARTITION BY media_id ORDER BY segment_id) AS nxt,
            least(CASE WHEN segment_id % 4 = 0 THEN start_ms + 40 ELSE end_ms END, start_ms + 7000) AS c FROM segs)""",
    "dedup_rolling": "SELECT media_id, n, array_to_string(fresh, '|') AS lines FROM kept_cues",
    "merge_spans": 'SELECT media_id, start, "end" FROM merged',
    "compact_timeline": "SELECT media_id, kind, processed, original, processed_len, original_len FROM timemap",
    "repeat_runs": """SELECT media_id, text, n, first_segment, start_ms, end_ms FROM runs_of_text
        QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY n DESC, first_segment) = 1""",
    "repeat_runs_turns": """SELECT conv_id AS media_id, text, count(*) AS n, min(turn) AS first_segment, min(turn) * 1000 AS start_ms, max(turn) * 1000 + 900 AS end_ms
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) AS isle FROM conversations)
        GROUP BY conv_id, text, isle QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, min(turn)) = 1""",
    "render_txt_turns": f"""SELECT conv_id AS media_id, 0 AS part, string_agg(t, ' ' ORDER BY turn) || chr(10) AS content
        FROM (SELECT conv_id, turn, {_collapse('text')} AS t FROM conversations) WHERE t <> '' GROUP BY conv_id""",
    "monotonic_check": """SELECT media_id, segment_id, a AS start_ms, b AS end_ms, faults FROM (SELECT *, array_to_string(list_filter([
            CASE WHEN a < 0 THEN 'negative_start' END, CASE WHEN b < a THEN 'negative_length' END, CASE WHEN a < p - 10 THEN 'backward' END,
            CASE WHEN b > duration_ms + 1000 THEN 'overrun' END], lambda x: x IS NOT NULL), ',') AS faults
        FROM (SELECT s.*, m.duration_ms, lag(a) OVER (PARTITION BY s.media_id ORDER BY segment_id) AS p FROM (
            SELECT media_id, segment_id, CASE WHEN segment_id % 17 = 16 THEN start_ms - 30000 ELSE start_ms END AS a,
                CASE WHEN segment_id % 23 = 22 THEN (start_ms) - 5 ELSE end_ms END AS b FROM segs) s LEFT JOIN media m ON m.media_id = s.media_id)) WHERE faults <> ''""",
    "cache_evict": f"SELECT digest, bytes, accessed, sum(bytes) OVER (ORDER BY accessed DESC, digest ROWS UNBOUNDED PRECEDING) <= {CACHE_CEILING} AS kept FROM latest",
    "cache_evict_micros": f"""SELECT digest, bytes, accessed,
            sum(bytes) OVER (ORDER BY accessed DESC NULLS LAST, digest ROWS UNBOUNDED PRECEDING) <= {CACHE_CEILING} AS kept
        FROM (SELECT digest, bytes, CASE WHEN entry_id % 97 <> 5 THEN {_US2024} + entry_id * 3 % 1009 END AS accessed FROM latest)""",
    "progress_highwater": """SELECT task_id, seq, percent FROM (SELECT user_id AS task_id, event_id AS seq, CAST(floor(value) AS INTEGER) AS percent,
            coalesce(max(floor(value)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS h FROM events) WHERE percent > h""",
    "coalesce_events": "SELECT task_id, seq, ts_ms, type, item, amount, batch_ms, message_seq FROM merged_msgs",
    "chunk_contiguity": """SELECT download_id, seq, CASE WHEN whole THEN 0 ELSE pos END AS start, CASE WHEN whole THEN 0 ELSE got END AS received_before,
            CASE WHEN NOT whole AND seq % 2 = 0 THEN 999999 END AS total, whole OR pos = got AS contiguous
        FROM (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY download_id, era ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS got
            FROM (SELECT *, count(*) FILTER (WHERE whole) OVER (PARTITION BY download_id ORDER BY seq) AS era
                FROM (SELECT doc_id AS download_id, i - 1 AS seq, (i - 1) % 17 = 16 AS whole, octet_length(encode(line)) AS n,
                    CAST(coalesce(sum(octet_length(encode(line))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
                        + (CASE WHEN (i - 1) % 11 = 10 THEN 1 ELSE 0 END) AS pos FROM lines)))""",
    "latest_entry": "SELECT digest, entry_id, bytes, accessed, title FROM latest",
    "cache_touch": """SELECT l.digest, entry_id, bytes, greatest(accessed, coalesce(h.a, accessed)) AS accessed, title
        FROM latest l LEFT JOIN (SELECT sha256(text) AS digest, max(doc_id % 7 + 30) AS a FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) h ON h.digest = l.digest""",
    "cache_list": "SELECT digest, accessed, bytes, title FROM latest ORDER BY accessed DESC, digest",
    "track_union": "SELECT video_id, lang, auto, position, ext, url FROM tracks",
    "plan_requests": _PLAN,
    "build_documents": f"""SELECT p.doc_id AS media_id, 'https://www.youtube.com/watch?v=' || p.video_id AS url, p.video_id, p.title, p.channel, {_round6('p.duration', 'duration_s')},
        p.upload_date, 'whisper.cpp' AS engine, r.model, r.backend, 'fr' AS language, false AS translated, r.vad, r.elapsed_ms AS duration_ms, {_round6('r.speed', 'speed_realtime')}
        FROM probes p JOIN timed_runs r ON r.media_id = p.doc_id AND r.backend = 'cpu'""",
    "sql_functions": f"""SELECT doc_id, md5({_collapse('text')}) AS collapsed_md5,
        len(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 3))) AS words, lang,
        printf('%02d:%02d:%02d,%03d', n_chars * 66 // 3600000, n_chars * 66 // 60000 % 60, n_chars * 66 // 1000 % 60, n_chars * 66 % 1000) AS ends,
        CAST(ceil(n_chars * CAST(0.066 AS DOUBLE) / 60) AS BIGINT) AS minutes, substr(sha256(text), 1, 11) AS video_id,
        CASE WHEN doc_id % 2 = 0 THEN 11 ELSE 20 END AS code FROM documents""",
    "stream_coalesce": "SELECT task_id, seq, ts_ms, type, item, amount, batch_ms, message_seq FROM merged_msgs",
    "stream_batches": "SELECT m.task_id, seq, ts_ms, o.opened_ms AS batch_ms FROM msgs m ASOF JOIN openings o ON o.task_id = m.task_id AND o.opened_ms <= m.ts_ms",
    "stream_status": """SELECT task_id, percent, position_ms, elapsed_ms, CASE WHEN elapsed_ms >= 1000 THEN floor(CAST(position_ms AS DOUBLE) / elapsed_ms * 10 + 0.5) / 10 END AS speed
        FROM (SELECT task_id, greatest(coalesce(max(amount) FILTER (WHERE type = 'progress'), -1), 0) AS percent, arg_max(ts_ms * 7, seq) FILTER (WHERE type = 'segments') AS position_ms,
            max(ts_ms) - min(ts_ms) AS elapsed_ms FROM msgs GROUP BY task_id)""",
    "stream_segments": """SELECT media_id, segment_id, segment_id % 5 <> 4 AS final, media_id * 1000000 + segment_id + (CASE WHEN segment_id % 5 <> 4 THEN 1 ELSE 0 END) AS seq,
        CASE WHEN segment_id % 5 <> 4 THEN '= ' || text ELSE text END AS text, CASE WHEN segment_id % 5 <> 4 AND segment_id % 10 <> 9 THEN (segment_id * 37 % 100) / 100.0 END AS probability FROM segs""",
    "stream_daily_check": "SELECT task_id, opened_ms FROM due",
    "stream_watch": "SELECT target_id, ts_ms, seq, day, action FROM actions",
    "stream_flush": """SELECT task_id, max(batch_ms) AS batch_ms, arg_max(n, batch_ms) AS n, count(*) AS batches
        FROM (SELECT task_id, ts_ms // 100 * 100 AS batch_ms, count(*) AS n FROM msgs GROUP BY ALL) GROUP BY task_id""",
    "watch_incidents": """SELECT target_id, CAST(k AS BIGINT) AS incident, min(day) AS opened, count(*) FILTER (WHERE action <> 'close') AS failures,
            max(CASE WHEN action = 'close' THEN day END) AS closed
        FROM (SELECT *, sum(CASE WHEN action = 'open' THEN 1 ELSE 0 END) OVER (PARTITION BY target_id ORDER BY ts_ms, seq) AS k FROM actions) GROUP BY target_id, k""",
}
_BODIES["stream_progress"] = _BODIES["progress_highwater"]

# Columns that literals would leave as 32-bit integers.
_WIDE = {
    "read_requests": ("available_bytes", "max_duration_min"), "model_catalogue": ("size",), "resolve_model": ("size",),
    "admit_requests": ("available_mb", "limit_without_words_min", "limit_min"), "quality_report": ("anomalies",),
    "chunk_contiguity": ("total",),
    **{n: ("part",) for n in ("render_txt", "render_srt", "render_vtt", "render_json", "write_documents", "render_txt_turns")},
}


def _widened(name: str, body: str) -> str:
    if name not in _WIDE:
        return body
    casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _WIDE[name])
    return f"SELECT * REPLACE ({casts}) FROM ({body})"


ORACLE: dict[str, str] = {name: _sql(_widened(name, body)) for name, body in _BODIES.items()}
