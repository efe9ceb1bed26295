"""SQL that computes the registered queries another way, straight from their definitions."""

from __future__ import annotations

from alertfold_checks.inputs import with_views

_DAY_TICK = "epoch_us(ts) // 86400000000 * 86400"
_BOX = "chat_id, tick, box"


def _boxed(view: str) -> str:
    return f"""
        SELECT chat_id, tick, (rn - 1) // 50 AS box, CAST((rn - 1) % 50 AS INTEGER) AS pos, seq, text,
               octet_length(encode(text)) AS bytes
        FROM (SELECT *, {_DAY_TICK} AS tick,
                     row_number() OVER (PARTITION BY chat_id, {_DAY_TICK} ORDER BY ts, seq) AS rn
              FROM {view})"""


def _pairs(test: str) -> str:
    """All pairs of a box, the earlier one first; the gap in length is only a shortcut."""
    gap = f"CAST(abs(a.bytes - b.bytes) AS DOUBLE) / greatest(a.bytes, b.bytes) {test}"
    return f"""
        SELECT *, CAST(lev AS DOUBLE) / longer AS dist FROM (
            SELECT a.chat_id, a.tick, a.box, a.pos AS head, b.pos AS member, a.seq AS head_seq,
                   b.seq AS member_seq, a.bytes AS head_bytes, b.bytes AS member_bytes,
                   greatest(a.bytes, b.bytes) AS longer,
                   CASE WHEN greatest(a.bytes, b.bytes) > 0 AND {gap} THEN levenshtein(a.text, b.text) END AS lev
            FROM boxed a JOIN boxed b ON a.chat_id = b.chat_id AND a.tick = b.tick AND a.box = b.box AND a.pos < b.pos)
        WHERE CAST(lev AS DOUBLE) / longer {test}"""


_GROUPS = f"""
    links AS (
        SELECT {_BOX}, member,
               list_reduce(list({{'head': head, 'dist': dist}} ORDER BY head),
                           lambda a, z: CASE WHEN a.dist - z.dist > CAST(0.1 AS DOUBLE) THEN z ELSE a END) AS l
        FROM pairs GROUP BY {_BOX}, member),
    own AS (SELECT {_BOX}, l.head AS pos, min(l.dist) AS nearest FROM links GROUP BY {_BOX}, l.head),
    parents AS (
        SELECT b.*, CASE WHEN l IS NULL OR l.dist - nearest >= CAST(0.1 AS DOUBLE) THEN b.pos ELSE l.head END AS parent
        FROM boxed b
        LEFT JOIN links k ON b.chat_id = k.chat_id AND b.tick = k.tick AND b.box = k.box AND b.pos = k.member
        LEFT JOIN own o ON b.chat_id = o.chat_id AND b.tick = o.tick AND b.box = o.box AND b.pos = o.pos),
    up AS (
        SELECT {_BOX}, pos, seq, pos AS root, seq AS root_seq FROM parents WHERE parent = pos
        UNION ALL
        SELECT p.chat_id, p.tick, p.box, p.pos, p.seq, u.root, u.root_seq
        FROM parents p JOIN up u ON p.chat_id = u.chat_id AND p.tick = u.tick AND p.box = u.box AND p.parent = u.pos
        WHERE p.parent <> p.pos),
    roots AS (
        SELECT *, CAST(count(*) OVER (PARTITION BY {_BOX}, root) AS INTEGER) AS group_size FROM up)"""


def _grouped(select: str, accuracy: str) -> str:
    """Query over the groups of the alerts' boxes."""
    return (
        f"WITH RECURSIVE {with_views('alerts')}, boxed AS ({_boxed('alerts')}), pairs AS ("
        f"{_pairs(f'< CAST({accuracy} AS DOUBLE)')}), {_GROUPS} {select}"
    )


def _paired(select: str, test: str, view: str = "alerts") -> str:
    return f"WITH {with_views(view)}, boxed AS ({_boxed(view)}), pairs AS ({_pairs(test)}) {select}"


def _over(select: str, *views: str) -> str:
    return f"WITH {with_views(*views)}{select if select.startswith(',') else ' ' + select}"


_FLAT_PAIRS = f"SELECT {_BOX}, head_seq, member_seq, CAST(lev AS INTEGER) AS lev, dist FROM pairs"

_MUTED = """
    own AS (SELECT CAST(scope AS BIGINT) AS chat_id, ts, arg_max(muted, seq) AS muted FROM mute_log
            WHERE scope <> '*' GROUP BY ALL),
    everyone AS (SELECT ts, arg_max(muted, seq) AS muted FROM mute_log WHERE scope = '*' GROUP BY ALL),
    heard AS (
        SELECT a.* FROM alerts a
        ASOF LEFT JOIN own o ON a.chat_id = o.chat_id AND a.ts >= o.ts
        ASOF LEFT JOIN everyone e ON a.ts >= e.ts
        WHERE NOT coalesce(o.muted, false) AND NOT coalesce(e.muted, false))"""

# a run of wildcards takes digits, or at most as many characters as it is long
_BODY = (
    "regexp_replace(regexp_replace(regexp_replace({0}, '([\\\\.^$|()\\[\\]{{}}*+])', '\\\\\\1', 'g'),"
    " '\\?', '[\\\\s\\\\S]?', 'g'), '((?:\\[\\\\s\\\\S\\]\\?)+)', '(?:[0-9]+|\\1)', 'g')"
)


def _full_match(template: str, text: str) -> str:
    return f"regexp_full_match({text}, {_BODY.format(template)})"


_HISTORY = """
    ranked AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY ts, seq) AS rn FROM {0}),
    seen AS (
        SELECT a.*, a.rn - b.rn AS hist_rank, b.seq AS hist_seq, {1}
               (epoch_us(a.ts) - epoch_us(b.ts)) // 60000000 AS age_minutes
        FROM ranked a JOIN ranked b ON a.chat_id = b.chat_id AND b.rn BETWEEN a.rn - 20 AND a.rn - 1
        WHERE (epoch_us(a.ts) - epoch_us(b.ts)) // 60000000 <= 60)"""

_ENTRY_HISTORY = _HISTORY.format("entries", "b.pattern AS hist_pattern, b.cnt AS hist_cnt,")
_MATCHED = f"""matched AS (
    SELECT chat_id, seq, text, hist_rank, hist_seq, hist_pattern, hist_cnt FROM seen
    WHERE hist_pattern IS NOT NULL AND {_full_match('hist_pattern', 'text')})"""

_LATEST = """
    latest AS (SELECT * FROM trigger_events
               QUALIFY row_number() OVER (PARTITION BY objectid ORDER BY clock DESC, eventid DESC) = 1)"""
_PROBLEMS = f"""{_LATEST},
    problems AS (
        SELECT triggerid, groupid, description FROM triggers JOIN latest ON triggerid = objectid
        WHERE monitored AND severity >= 3 AND clock >= TIMESTAMP '2001-08-02' - INTERVAL 60 DAY
          AND value = 1 AND NOT acknowledged)"""

_PARSED = """
    parsed AS (
        SELECT *, string_split(data, ' ')[1] AS verb, string_split(data, ' ')[2:] AS args,
               data IN ('main', 'action.stopall', 'action.startall', 'action.stopchat', 'action.startchat',
                        'action.enable', 'action.disable')
               OR regexp_matches(data,
                    '^(action\\.(enable|disable)|maintenance\\.(renew|delete|create\\.select\\.grp)|problems\\.select) |'
                    '^problems\\.select\\.page [^ ]* ') AS known
        FROM commands)"""

_PAIRED_REPLIES = """
    SELECT p.chat_id, p.username, p.seq, p.text, r.seq AS reply_seq, r.text AS reply_text
    FROM prompts p ASOF LEFT JOIN replies r
      ON p.chat_id = r.chat_id AND p.username = r.username AND p.seq < r.seq"""

_AUDIT = f"""{_PARSED},
    audit AS (
        SELECT c.chat_id, c.seq,
               concat('User @', username,
                      CASE WHEN verb LIKE 'action.stop%' OR verb = 'action.disable' THEN ' disabled' ELSE ' enabled' END,
                      CASE WHEN verb LIKE 'action.%all' THEN ' sending messages for all chats.'
                           WHEN verb LIKE 'action.%chat' THEN concat(' sending messages for chat: ', chat_name)
                           ELSE concat(' action: "', coalesce(name, ''), '"') END) AS audit_text
        FROM parsed c
        LEFT JOIN actions a ON verb IN ('action.enable', 'action.disable') AND TRY_CAST(args[1] AS BIGINT) = actionid
        LEFT JOIN chats h ON c.chat_id = h.chat_id
        WHERE username IN (SELECT username FROM admins)
          AND (verb IN ('action.stopall', 'action.startall', 'action.stopchat', 'action.startchat')
               OR (verb IN ('action.enable', 'action.disable') AND len(args) > 0)))"""


_MAINTAINED = _over(
    """, created AS (SELECT maintenanceid, max((ts, seq)) AS at, arg_max(name, (ts, seq)) AS name,
                            arg_max(groupid, (ts, seq)) AS groupid
                     FROM maintenance_log WHERE op = 'create' GROUP BY ALL),
         deleted AS (SELECT maintenanceid, max((ts, seq)) AS at FROM maintenance_log WHERE op = 'delete' GROUP BY ALL),
         renewed AS (SELECT maintenanceid, max((ts, seq)) AS at FROM maintenance_log WHERE op = 'renew' GROUP BY ALL),
         alive AS (
             SELECT c.maintenanceid, c.name, c.groupid, c.at AS at, NULL AS since, NULL AS till
             FROM created c LEFT JOIN deleted d USING (maintenanceid) WHERE d.at IS NULL OR d.at < c.at
             UNION ALL
             SELECT m.maintenanceid, m.name, m.groupid, NULL, active_since, active_till FROM maintenances m
             WHERE maintenanceid NOT IN (SELECT maintenanceid FROM deleted)
               AND maintenanceid NOT IN (SELECT maintenanceid FROM created)),
         started AS (
             SELECT a.*, CASE WHEN r.at IS NOT NULL AND (a.at IS NULL OR r.at > a.at) THEN r.at[1]
                              ELSE a.at[1] END AS start
             FROM alive a LEFT JOIN renewed r USING (maintenanceid))
       SELECT maintenanceid, name, coalesce(start, since) AS active_since,
              coalesce(start + INTERVAL 1 DAY, till) AS active_till, groupid,
              CASE WHEN start IS NOT NULL THEN 3600 END AS period, start AS period_start
       FROM started""",
    "maintenances",
    "maintenance_log",
)

ORACLES = {
    "assign_boxes": _over(f"SELECT {_BOX}, pos, seq FROM ({_boxed('alerts')})", "alerts"),
    "batch_gate": _over(
        f"SELECT {_BOX}, seq, count(*) OVER (PARTITION BY {_BOX}) > 35 AS compacted FROM ({_boxed('alerts')})",
        "alerts",
    ),
    "apply_mutes": f"WITH {with_views('alerts', 'mute_log')}, {_MUTED} SELECT chat_id, seq, text FROM heard",
    "byte_distance": _over(
        f"SELECT chat_id, seq, CAST(levenshtein(text, reply_text) AS INTEGER) AS lev FROM ({_PAIRED_REPLIES})"
        " WHERE reply_text IS NOT NULL",
        "prompts",
        "replies",
    ),
    "similarity_pairs": _paired(_FLAT_PAIRS, "< CAST(0.4 AS DOUBLE)"),
    "similarity_pairs_left": _paired(
        f"""SELECT * FROM (
                SELECT {_BOX}, head_seq, member_seq, CAST(lev AS INTEGER) AS lev,
                       CAST(lev AS DOUBLE) / head_bytes AS dist FROM pairs
                UNION ALL
                SELECT {_BOX}, member_seq, head_seq, CAST(lev AS INTEGER),
                       CAST(lev AS DOUBLE) / member_bytes FROM pairs)
            WHERE dist < CAST(0.4 AS DOUBLE)""",
        "< 1",
    ),
    "similarity_pairs_inclusive": _paired(_FLAT_PAIRS, "<= CAST(0.1 AS DOUBLE)"),
    "similarity_pairs_notes": _paired(_FLAT_PAIRS, "< CAST(0.1 AS DOUBLE)", "notes"),
    "assign_heads": _grouped(
        f"""SELECT {', '.join('k.' + c for c in _BOX.split(', '))}, m.seq AS member_seq, h.seq AS head_seq,
                   l.dist AS dist
            FROM links k
            JOIN boxed m ON k.chat_id = m.chat_id AND k.tick = m.tick AND k.box = m.box AND k.member = m.pos
            JOIN boxed h ON k.chat_id = h.chat_id AND k.tick = h.tick AND k.box = h.box AND k.l.head = h.pos""",
        "0.1",
    ),
    "resolve_roots": _grouped(f"SELECT {_BOX}, seq, root_seq, group_size FROM roots", "0.1"),
    "group_sizes": _grouped(
        f"SELECT DISTINCT {_BOX}, root_seq, group_size AS cnt FROM roots WHERE group_size > 1", "0.1"
    ),
    "group_sizes_wide": _grouped(
        f"SELECT DISTINCT {_BOX}, root_seq, group_size AS cnt FROM roots WHERE group_size > 1", "0.4"
    ),
    "singles": _grouped(
        f"SELECT {_BOX}, seq, text FROM roots JOIN (SELECT seq, text FROM alerts) USING (seq) WHERE group_size = 1",
        "0.1",
    ),
    "edit_script": _paired(
        """SELECT head_seq, member_seq, CAST(lev AS INTEGER) AS cost,
                  CAST(member_bytes - head_bytes AS INTEGER) AS growth FROM pairs""",
        "< CAST(0.1 AS DOUBLE)",
    ),
    "fold_groups": _grouped(
        f"""SELECT DISTINCT {_BOX}, root_seq, group_size AS cnt, group_size AS covered FROM roots
            WHERE group_size > 1""",
        "0.1",
    ),
    "send_directly": _over(
        """SELECT chat_id, seq, 'SEND' AS action, CAST(NULL AS INTEGER) AS message_id, text, false AS is_group,
                  CAST(NULL AS VARCHAR) AS pattern, 1 AS cnt FROM alerts""",
        "alerts",
    ),
    "compact_counts": f"""
        WITH {with_views('alerts', 'mute_log')}, {_MUTED}, boxed AS ({_boxed('alerts')})
        SELECT {_BOX}, count(*) AS messages FROM boxed WHERE seq IN (SELECT seq FROM heard) GROUP BY ALL""",
    "match_templates": f"WITH {with_views('entries')}, {_ENTRY_HISTORY}, {_MATCHED} SELECT * FROM matched",
    "merged_counts": f"""
        WITH {with_views('entries')}, {_ENTRY_HISTORY}, {_MATCHED}
        SELECT chat_id, seq, CAST(sum(hist_cnt) + 1 AS BIGINT) AS cnt FROM matched GROUP BY ALL""",
    "equivalent": _over(
        f"SELECT seq, {_full_match('a', 'b')} AND {_full_match('b', 'a')} AS same FROM template_pairs",
        "template_pairs",
    ),
    "merge_template": _over(
        """SELECT seq, true AS takes_a, true AS takes_b FROM template_pairs
           WHERE CAST(levenshtein(a, b) AS DOUBLE) / greatest(octet_length(encode(a)), octet_length(encode(b)))
                 <= CAST(0.4 AS DOUBLE)""",
        "template_pairs",
    ),
    "parse_header": _over(
        """SELECT seq,
                  CASE WHEN place > 0 THEN CAST(substr(text, 1, place - 1) AS BIGINT) ELSE 0 END AS cnt,
                  CASE WHEN place > 0 THEN substr(text, place + 32 + 1) ELSE text END AS template
           FROM (SELECT *, strpos(text, concat(' similar messages were received:', chr(10))) AS place FROM headed)""",
        "headed",
    ),
    "format_texts": _over(
        """SELECT seq, concat(cnt, ' similar messages were received:', chr(10), pattern) AS batch,
                  concat(pattern, chr(10), chr(10), 'Similar messages received: ', cnt) AS online
           FROM entries WHERE pattern IS NOT NULL""",
        "entries",
    ),
    "recent_history": f"""
        WITH {with_views('alerts')}, {_HISTORY.format('alerts', '')}
        SELECT chat_id, seq, hist_rank, hist_seq, age_minutes FROM seen""",
    "maintenance_status": _over(
        """SELECT maintenanceid,
                  concat(CASE WHEN active_since < TIMESTAMP '1998-01-15' AND TIMESTAMP '1998-01-15' < active_till
                              THEN '🛠 ' WHEN TIMESTAMP '1998-01-15' < active_since THEN '⏰ ' ELSE '❌ ' END,
                         name) AS label
           FROM maintenances""",
        "maintenances",
    ),
    "list_actions": _over("SELECT actionid, name FROM actions WHERE status = 0", "actions"),
    "list_screens": _over("SELECT screenid, name FROM screens", "screens"),
    "host_groups": _over("SELECT groupid, name FROM hostgroups WHERE monitored_hosts", "hostgroups"),
    "open_problems": f"WITH {with_views('triggers', 'trigger_events')}, {_PROBLEMS} SELECT * FROM problems",
    "groups_with_problems": f"""
        WITH {with_views('triggers', 'trigger_events', 'hostgroups')}, {_PROBLEMS}
        SELECT groupid, name FROM hostgroups WHERE monitored_hosts AND groupid IN (SELECT groupid FROM problems)""",
    "latest_event": f"""
        WITH {with_views('trigger_events')}, {_LATEST}
        SELECT objectid, eventid, clock, value, acknowledged FROM latest""",
    "screen_graphs": _over(
        """SELECT screenid, resourceid FROM screen_items
           WHERE resourcetype = 0 AND screenid IN (SELECT screenid FROM screens)""",
        "screens",
        "screen_items",
    ),
    "with_names": _over(
        """SELECT screenid, name, count(*) AS items FROM screen_items LEFT JOIN screens USING (screenid)
           GROUP BY ALL""",
        "screens",
        "screen_items",
    ),
    "apply_maintenance_log": _MAINTAINED,
    "update_table": _MAINTAINED,
    "apply_ack_log": _over(
        """SELECT eventid, objectid, clock, value,
                  acknowledged OR eventid IN (SELECT eventid FROM acks WHERE mask & 2 <> 0) AS acknowledged
           FROM trigger_events""",
        "trigger_events",
        "acks",
    ),
    "apply_action_log": _over(
        """SELECT actionid, name, coalesce(s, status) AS status FROM actions
           LEFT JOIN (SELECT actionid, arg_max(status, (ts, seq)) AS s FROM action_log GROUP BY ALL) USING (actionid)""",
        "actions",
        "action_log",
    ),
    "parse_commands": _over(
        f", {_PARSED} SELECT seq, verb, array_to_string(args, ',') AS args, known FROM parsed", "commands"
    ),
    "authorize": _over(
        "SELECT seq, username, data FROM commands WHERE username IN (SELECT username FROM admins)",
        "commands",
        "admins",
    ),
    "refused": _over(
        "SELECT seq, username, data FROM commands WHERE username NOT IN (SELECT username FROM admins)",
        "commands",
        "admins",
    ),
    "start_commands": _over(
        "SELECT seq, text FROM start_texts WHERE regexp_full_match(text, '/start(@foldbot)?')", "start_texts"
    ),
    "split_lists": _over(
        """SELECT seq, entry FROM (SELECT seq, unnest(regexp_split_to_array(list, '[;, ]')) AS entry FROM id_lists)
           WHERE entry <> ''""",
        "id_lists",
    ),
    "user_list": _over("SELECT row_number() OVER (ORDER BY username) AS line, username FROM admins", "admins"),
    "audit_log": _over(f", {_AUDIT} SELECT * FROM audit", "commands", "admins", "actions", "chats"),
    "fan_out": _over(
        f", {_AUDIT} SELECT n.chat_id AS notify_chat_id, seq, audit_text FROM audit, notify_chats n",
        "commands",
        "admins",
        "actions",
        "chats",
        "notify_chats",
    ),
    "mute_log_from_commands": _over("SELECT ts, seq, scope, muted FROM mute_log", "mute_log"),
    "action_log_from_commands": _over("SELECT ts, seq, actionid, status FROM action_log", "action_log"),
    "maintenance_log_from_commands": """
        SELECT event_id AS seq, CASE WHEN value < 30 THEN 'renew' ELSE 'delete' END AS op, user_id AS maintenanceid
        FROM events WHERE event_type = 'purchase'""",
    "pair_replies": _over(_PAIRED_REPLIES, "prompts", "replies"),
    "acks_from_replies": f"""
        WITH {with_views('commands', 'trigger_events')}, {_LATEST},
             answers AS (SELECT * FROM commands WHERE data NOT LIKE 'problems.select %')
        SELECT eventid, 6 AS mask, r.data AS message
        FROM commands p ASOF JOIN answers r ON p.chat_id = r.chat_id AND p.username = r.username AND p.seq < r.seq
        JOIN latest ON objectid = CAST(string_split(p.data, ' ')[2] AS BIGINT)
        WHERE p.data LIKE 'problems.select %'""",
    "creates_from_replies": f"""
        WITH {with_views('commands')},
             answers AS (SELECT * FROM commands WHERE data NOT LIKE 'maintenance.create.select.grp %'),
             named AS (SELECT p.ts, p.seq, r.ts AS at, r.seq AS reply_seq, r.data AS name,
                              CAST(string_split(p.data, ' ')[2] AS BIGINT) AS groupid
                       FROM commands p ASOF JOIN answers r
                         ON p.chat_id = r.chat_id AND p.username = r.username AND p.seq < r.seq
                       WHERE p.data LIKE 'maintenance.create.select.grp %')
        SELECT reply_seq AS seq, 'create' AS op, 999999 + row_number() OVER (ORDER BY reply_seq, seq) AS maintenanceid,
               name, groupid
        FROM named""",
    "paginate": _over(
        """SELECT screenid, name, row_number() OVER (ORDER BY name) AS rn,
                  (row_number() OVER (ORDER BY name) - 1) // 5 AS page,
                  CAST(ceil(count(*) OVER () / 5) AS BIGINT) AS pages
           FROM screens""",
        "screens",
    ),
    "paginate_problems": f"""
        WITH {with_views('triggers', 'trigger_events')}, {_PROBLEMS}
        SELECT *, row_number() OVER w AS rn, (row_number() OVER w - 1) // 5 AS page,
               CAST(ceil(count(*) OVER (PARTITION BY groupid) / 5) AS BIGINT) AS pages
        FROM problems WINDOW w AS (PARTITION BY groupid ORDER BY description, triggerid)""",
    "chunk": _over(
        """SELECT owner, chunk, string_agg(screenid, ',' ORDER BY rn) AS items FROM (
               SELECT resourceid % 100 AS owner, screenid, rn, (rn - 1) // 10 AS chunk FROM (
                   SELECT *, row_number() OVER (PARTITION BY resourceid % 100 ORDER BY resourceid, screenid) AS rn
                   FROM screen_items WHERE resourcetype = 0 AND screenid IN (SELECT screenid FROM screens)))
           GROUP BY ALL""",
        "screens",
        "screen_items",
    ),
    "message_ids": _over("SELECT seq, sha256(concat_ws('|', chat_id, ts, seq, text)) AS msg_id FROM alerts", "alerts"),
    "enqueue": _over(
        "SELECT chat_id, seq, text, sha256(concat_ws('|', chat_id, ts, seq, text)) AS msg_id FROM alerts", "alerts"
    ),
    "read_spool": _over("SELECT chat_id, coalesce(text, '') AS text FROM page_messages", "page_messages"),
    "stream_spool": _over("SELECT chat_id, coalesce(text, '') AS text FROM page_messages", "page_messages"),
    "parse_api_dump": _over("SELECT triggerid, description FROM triggers", "triggers"),
    "api_errors": _over(
        "SELECT concat('No permissions to ', name) AS error FROM hostgroups WHERE NOT monitored_hosts", "hostgroups"
    ),
    "compact_stream_balance": _over(
        "SELECT chat_id, count(*) AS sent, count(*) AS told FROM alerts GROUP BY ALL", "alerts"
    ),
    "compact_backlog": _over(
        "SELECT chat_id, count(*) AS sent, count(*) AS told FROM alerts GROUP BY ALL", "alerts"
    ),
    "live_mutes": f"WITH {with_views('alerts', 'mute_log')}, {_MUTED} SELECT chat_id, seq, text FROM heard",
    "compact_stream_muted": f"""
        WITH {with_views('alerts', 'mute_log')}, {_MUTED}
        SELECT chat_id, count(*) AS sent, count(*) AS told FROM heard GROUP BY ALL""",
    "write_outbox": _over(
        "SELECT seq, sha256(concat_ws('|', chat_id, ts, seq, text)) AS msg_id FROM alerts", "alerts"
    ),
    "send_batches": """
        SELECT chat_id, CAST(0 AS BIGINT) AS tick, box, count(*) AS messages
        FROM (SELECT user_id % 10 AS chat_id,
                     (row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1) // 50 AS box FROM events)
        GROUP BY ALL""",
    "pair_replies_stream": _over(
        f"SELECT * FROM ({_PAIRED_REPLIES}) WHERE reply_seq IS NOT NULL", "prompts", "replies"
    ),
}
