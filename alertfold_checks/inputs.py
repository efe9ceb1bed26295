"""Inputs of the operators, derived from the driver's tables.

One SQL text per view, read by Spark and by the checking SQL alike. Every view covers its whole tables and
whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEWS = {
    # messages: about 33 per chat and day at sf0.01
    "alerts": """
        SELECT user_id % 10 AS chat_id, event_id AS seq, ts,
               concat(event_type, ' value ', cast(cast(floor(value) AS bigint) AS string), ' on user ',
                      cast(user_id AS string)) AS text
        FROM events""",
    # whole documents as messages of one chat: multibyte texts, near copies, very unequal lengths
    "notes": """
        SELECT cast(0 AS bigint) AS chat_id, doc_id AS seq, cast('2024-01-01 00:00:00' AS timestamp) AS ts, text
        FROM documents""",
    # sent messages of a chat, some of them groups
    "entries": """
        SELECT a.chat_id, a.ts, a.seq, a.text,
               CASE WHEN user_id % 3 > 0 THEN translate(text, '0123456789', '??????????') END AS pattern,
               user_id % 7 + 1 AS cnt
        FROM alerts a JOIN events e ON e.event_id = a.seq""",
    "template_pairs": """
        SELECT event_id AS seq, translate(text, '0123456789', '??????????') AS a,
               CASE event_type WHEN 'click' THEN replace(translate(text, '0123456789', '??????????'), '??', '?')
                               WHEN 'view' THEN concat(translate(text, '0123456789', '??????????'), '?')
                               ELSE text END AS b
        FROM alerts JOIN events ON event_id = seq""",
    "headed": """
        SELECT seq, CASE WHEN event_type = 'click'
                         THEN concat(cast(user_id AS string), ' similar messages were received:', chr(10), text)
                         ELSE concat(cast(user_id AS string), ' similar messages: ', text) END AS text
        FROM alerts JOIN events ON event_id = seq""",
    "hostgroups": """
        SELECT n_nationkey AS groupid, n_name AS name, n_regionkey <> 4 AS monitored_hosts FROM nation""",
    "triggers": """
        SELECT c_custkey AS triggerid, c_nationkey AS groupid, concat('Disk low on ', c_name) AS description,
               cast(c_custkey % 6 AS int) AS severity, c_acctbal >= 0 AS monitored
        FROM customer""",
    "trigger_events": """
        SELECT o_orderkey AS eventid, o_custkey AS objectid, o_orderdate AS clock,
               CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END AS value, o_orderstatus = 'P' AS acknowledged
        FROM orders""",
    "maintenances": """
        SELECT o_orderkey AS maintenanceid, concat('Maintenance ', cast(o_orderkey AS string)) AS name,
               o_orderdate AS active_since, o_orderdate + interval '30' day AS active_till,
               o_custkey AS groupid
        FROM orders""",
    "maintenance_log": """
        SELECT ts, event_id AS seq,
               CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'renew' ELSE 'delete' END AS op,
               CASE WHEN event_type = 'signup' OR value > 10 THEN 100000000 ELSE 0 END
                 + cast(floor(event_id / 4) AS bigint) AS maintenanceid,
               CASE WHEN event_type = 'signup' THEN concat('Window of user ', cast(user_id AS string)) END AS name,
               CASE WHEN event_type = 'signup' THEN user_id END AS groupid
        FROM events WHERE event_type IN ('signup', 'purchase', 'error')""",
    "acks": """
        SELECT cast(floor(event_id / 2) AS bigint) AS eventid, CASE WHEN value < 10 THEN 4 ELSE 6 END AS mask
        FROM events""",
    "actions": """
        SELECT p_partkey AS actionid, p_name AS name, cast(p_size % 2 AS int) AS status FROM part""",
    "screens": """
        SELECT o_orderkey AS screenid, concat('Screen ', cast(o_orderkey AS string)) AS name FROM orders""",
    "screen_items": """
        SELECT l_orderkey AS screenid, l_partkey AS resourceid, l_linenumber - 1 AS resourcetype FROM lineitem""",
    # pressed buttons; the unaddressed ones are no commands
    "commands": """
        SELECT ts, event_id AS seq, user_id % 10 AS chat_id, concat('user', cast(user_id AS string)) AS username,
               CASE WHEN event_type = 'click' THEN concat('problems.select ', cast(user_id AS string))
                    WHEN event_type = 'view' AND value < 10 THEN 'problems.select.page 3 1'
                    WHEN event_type = 'view' AND value < 20 THEN 'main'
                    WHEN event_type = 'view' AND value < 30 THEN 'main menu'
                    WHEN event_type = 'view' AND value < 50
                      THEN concat('maintenance.create.select.grp ', cast(user_id % 25 AS string))
                    WHEN event_type = 'view' THEN 'button.empty'
                    WHEN event_type = 'signup' AND value < 20 THEN concat('action.disable ', cast(user_id AS string))
                    WHEN event_type = 'signup' AND value < 40 THEN concat('action.enable ', cast(user_id AS string))
                    WHEN event_type = 'signup' THEN 'action.enable'
                    WHEN event_type = 'purchase' AND value < 30
                      THEN concat('maintenance.renew ', cast(user_id AS string))
                    WHEN event_type = 'purchase' THEN concat('maintenance.delete ', cast(user_id AS string))
                    WHEN value < 1 THEN 'action.stopall'
                    WHEN value < 8 THEN 'action.startall'
                    WHEN value < 20 THEN 'action.stopchat'
                    ELSE 'action.startchat' END AS data
        FROM events""",
    "admins": """
        SELECT DISTINCT concat('user', cast(user_id AS string)) AS username FROM events
        WHERE event_type = 'purchase' AND value > 150""",
    "notify_chats": """
        SELECT cast(r_regionkey AS bigint) AS chat_id FROM region""",
    "chats": """
        SELECT DISTINCT user_id % 10 AS chat_id, concat('chat ', cast(user_id % 10 AS string)) AS chat_name
        FROM events""",
    "mute_log": """
        SELECT ts, seq,
               CASE WHEN data IN ('action.stopall', 'action.startall') THEN '*' ELSE cast(chat_id AS string) END AS scope,
               data IN ('action.stopall', 'action.stopchat') AS muted
        FROM commands
        WHERE data IN ('action.stopall', 'action.startall', 'action.stopchat', 'action.startchat')""",
    "action_log": """
        SELECT ts, event_id AS seq, user_id AS actionid, CASE WHEN value < 20 THEN 1 ELSE 0 END AS status
        FROM events WHERE event_type = 'signup' AND value < 40""",
    "start_texts": """
        SELECT event_id AS seq,
               CASE event_type WHEN 'click' THEN '/start' WHEN 'view' THEN '/start@foldbot'
                               WHEN 'signup' THEN '/start@otherbot' WHEN 'error' THEN '/start now'
                               ELSE concat('/start', cast(user_id AS string)) END AS text
        FROM events""",
    "id_lists": """
        SELECT event_id AS seq,
               concat(cast(user_id AS string), ';', event_type, ', ,', cast(event_id AS string), ' ') AS list
        FROM events""",
    # prompt and reply by turn order within a conversation
    "prompts": """
        SELECT conv_id AS chat_id, concat('user', cast(conv_id AS string)) AS username, turn AS seq, text
        FROM conversations WHERE role = 'user'""",
    "replies": """
        SELECT conv_id AS chat_id, concat('user', cast(conv_id AS string)) AS username, turn AS seq, text
        FROM conversations WHERE role = 'assistant'""",
    # every page is a message, and an empty one follows it
    "page_messages": """
        SELECT page_id % 10 AS chat_id, html AS text FROM pages
        UNION ALL SELECT page_id % 10 AS chat_id, '' AS text FROM pages""",
}


class Inputs:
    """The views of one data directory as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._done: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._done:
            if name in TABLES:
                self._done[name] = self.table(name)
            else:
                used = [n for n in (*TABLES, *VIEWS) if n != name and n in VIEWS[name].replace(",", " ").split()]
                for other in used:
                    getattr(self, other).createOrReplaceTempView(other)
                self._done[name] = self.spark.sql(VIEWS[name])
        return self._done[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, table: str, expressions: list[str]) -> DataFrame:
        """A table, one file or a folder of files, as a stream of its files."""
        return Streams(self.spark, self.sf_dir).table(table).selectExpr(*expressions)


class Streams(Inputs):
    """The same views, of tables that are streams of their files."""

    def table(self, name: str) -> DataFrame:
        reader = self.spark.readStream.schema(super().table(name).schema).option("maxBytesPerTrigger", 1 << 30)
        return reader.parquet(f"{self.sf_dir}/{name}.parquet*")


def with_views(*names: str) -> str:
    """The named views, and those they need, as common table expressions."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS:
            if other != name and other in VIEWS[name].replace(",", " ").split():
                add(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    return ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
