"""The command log: parse, authorise, audit, and what commands do to other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertfold.operators.changelog import ACKNOWLEDGE, MESSAGE
from alertfold.operators.monitoring import DISABLED, ENABLED, with_names
from alertfold.operators.mutes import ALL_CHATS
from alertfold.plans.ordered import HOT_ROWS, numbered

# Verbs that take no argument.
BARE_VERBS = [
    "main", "info", "actions", "screen", "maintenance", "getchatid", "userlist", "createmaintenance",
    "problems", "action.stopall", "action.stopchat", "action.startall", "action.startchat",
]
# Verbs with the number of arguments they need.
ARGUMENT_VERBS = {
    "action.enable.page": 1,
    "action.disable.page": 1,
    "maintenance.create.select.grp": 1,
    "maintenance.create.select.grp.page": 1,
    "screen.select": 1,
    "screen.select.refresh": 1,
    "screen.select.page": 1,
    "maintenance.select": 1,
    "maintenance.select.page": 1,
    "maintenance.renew": 1,
    "maintenance.delete": 1,
    "problems.select.grp": 1,
    "problems.select.grp.page": 1,
    "problems.select.page": 2,
    "problems.select": 1,
}
# Verbs that open a menu when bare and act on an id otherwise.
EITHER_VERBS = ["action.enable", "action.disable"]
# Verbs that switch sending.
SENDING_VERBS = ["action.stopall", "action.startall", "action.stopchat", "action.startchat"]

NOTIFY_SLOTS, FEW_CHATS = 64, 500


def _known(verb: Column, count: Column) -> Column:
    known = (verb.isin(BARE_VERBS) & (count == 0)) | verb.isin(EITHER_VERBS)
    for needed in sorted(set(ARGUMENT_VERBS.values())):
        names = [v for v, n in ARGUMENT_VERBS.items() if n == needed]
        known = known | (verb.isin(names) & (count >= needed))
    return known


def parse_commands(commands: DataFrame) -> DataFrame:
    """Add ``verb``, ``args`` and ``known`` to commands(ts, seq, chat_id, username, data)."""
    words = F.split("data", " ")
    args = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    parsed = commands.withColumn("verb", F.get(words, F.lit(0))).withColumn("args", args)
    return parsed.withColumn("known", _known(F.col("verb"), F.size("args")))


def authorize(commands: DataFrame, admins: DataFrame) -> DataFrame:
    """Commands of administrators. Empty names are no administrators."""
    return commands.join(_named(admins), "username", "left_semi")


def refused(commands: DataFrame, admins: DataFrame) -> DataFrame:
    """Commands of everybody else."""
    return commands.join(_named(admins), "username", "left_anti")


def _named(admins: DataFrame) -> DataFrame:
    return admins.select("username").filter(F.col("username") != "")


def is_start_command(text: Column, botname: str) -> Column:
    """Whether the text is the start command, bare or addressed to this bot."""
    return text.isin("/start", f"/start@{botname}")


def split_list(text: Column) -> Column:
    """Entries of a list written with ``;``, ``,`` or blanks; empty ones dropped."""
    return F.filter(F.split(text, "[;, ]"), lambda entry: entry != "")


def audit_log(commands: DataFrame, actions: DataFrame, chats: DataFrame) -> DataFrame:
    """Texts that tell who switched what: chat_id, seq, ts, audit_text.

    ``commands`` are parsed; ``actions(actionid, name)`` and ``chats(chat_id, chat_name)`` give the names.
    """
    verb = F.col("verb")
    switches = verb.isin(EITHER_VERBS) & (F.size("args") > 0)
    told = commands.filter(F.col("known") & (switches | verb.isin(SENDING_VERBS)))
    acting = told.withColumn("actionid", F.when(switches, F.get("args", F.lit(0)).try_cast("bigint")))
    named = with_names(with_names(acting, actions, "actionid"), chats, "chat_id", "chat_name")

    who = F.concat(F.lit("User @"), "username")

    def switched(state: str) -> Column:
        return F.concat(who, F.lit(f' {state} action: "'), F.coalesce("name", F.lit("")), F.lit('"'))

    def chat_sending(state: str) -> Column:
        return F.concat(who, F.lit(f" {state} sending messages for chat: "), F.coalesce("chat_name", F.lit("")))

    def all_sending(state: str) -> Column:
        return F.concat(who, F.lit(f" {state} sending messages for all chats."))

    text = (
        F.when(verb == "action.disable", switched("disabled"))
        .when(verb == "action.enable", switched("enabled"))
        .when(verb == "action.stopall", all_sending("disabled"))
        .when(verb == "action.startall", all_sending("enabled"))
        .when(verb == "action.stopchat", chat_sending("disabled"))
        .when(verb == "action.startchat", chat_sending("enabled"))
    )
    return named.select("chat_id", "seq", "ts", text.alias("audit_text"))


def fan_out(audit: DataFrame, notify_chats: DataFrame) -> DataFrame:
    """Every audit text once for each chat to notify: notify_chat_id, seq, audit_text.

    Up to FEW_CHATS chats are a list that every text is multiplied with where it is. More are dealt to slots, and
    each text goes once to every slot: that is little beside the rows it then gives.
    """
    chat = F.col("chat_id").cast("long")
    chats = notify_chats.select(chat.alias("notify_chat_id")).distinct()
    few = [r[0] for r in chats.limit(FEW_CHATS + 1).collect()]
    if len(few) <= FEW_CHATS:
        each = F.explode(F.array(*[F.lit(c) for c in few]).cast("array<bigint>")).alias("notify_chat_id")
        return audit.select(each, "seq", "audit_text")
    placed = chats.withColumn("_slot", F.pmod(F.xxhash64("notify_chat_id"), F.lit(NOTIFY_SLOTS)).cast("int"))
    slots = F.sequence(F.lit(0), F.lit(NOTIFY_SLOTS - 1))
    texts = audit.select("seq", "audit_text", F.explode(slots).alias("_slot"))
    return texts.join(placed, "_slot").select("notify_chat_id", "seq", "audit_text")


def user_list(admins: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """The administrators as numbered lines in order of their names: line, username."""
    return numbered(_named(admins).distinct(), [], ["username"], "line", hot_rows).select("line", "username")


def mute_log_from_commands(commands: DataFrame) -> DataFrame:
    """Mutes and unmutes in parsed commands: ts, seq, scope, muted.

    Verbs that switch sending are known without arguments only, so they are all of the text. (Spark would put all that
    ``verb`` and ``known`` stand for into the filter, many times over: more than the JVM compiles.)
    """
    text = F.col("data")
    scope = F.when(text.isin("action.stopall", "action.startall"), F.lit(ALL_CHATS)).otherwise(
        F.col("chat_id").cast("string")
    )
    return commands.filter(text.isin(SENDING_VERBS)).select(
        "ts", "seq", scope.alias("scope"), text.startswith("action.stop").alias("muted")
    )


def action_log_from_commands(commands: DataFrame) -> DataFrame:
    """Switched actions in parsed commands: ts, seq, actionid, status."""
    switch = F.col("verb").isin(EITHER_VERBS) & (F.size("args") > 0)
    status = F.when(F.col("verb") == "action.disable", F.lit(DISABLED)).otherwise(F.lit(ENABLED))
    return commands.filter(F.col("known") & switch).select(
        "ts", "seq", F.get("args", F.lit(0)).try_cast("bigint").alias("actionid"), status.alias("status")
    )


def maintenance_log_from_commands(commands: DataFrame) -> DataFrame:
    """Renewals and deletes in parsed commands, as rows of a maintenance log."""
    op = F.when(F.col("verb") == "maintenance.renew", "renew").when(F.col("verb") == "maintenance.delete", "delete")
    found = commands.filter("known").withColumn("op", op).filter(F.col("op").isNotNull())
    return found.select(
        "ts",
        "seq",
        "op",
        F.get("args", F.lit(0)).try_cast("bigint").alias("maintenanceid"),
        F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("bigint").alias("groupid"),
    )


def acks_from_replies(paired: DataFrame, latest: DataFrame) -> DataFrame:
    """Acknowledgements from answered ``problems.select`` prompts: eventid, mask, message.

    ``paired`` are parsed prompts with ``reply_text``; ``latest`` gives the newest event per trigger.
    """
    answered = paired.filter((F.col("verb") == "problems.select") & F.col("reply_text").isNotNull())
    aimed = answered.withColumn("objectid", F.get("args", F.lit(0)).try_cast("bigint"))
    return aimed.join(latest.select("objectid", "eventid"), "objectid").select(
        "eventid", F.lit(ACKNOWLEDGE | MESSAGE).alias("mask"), F.col("reply_text").alias("message")
    )


def creates_from_replies(paired: DataFrame, first_id: int, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Creations from answered ``maintenance.create.select.grp`` prompts, as rows of a maintenance log.

    The reply is the name. Ids count on from ``first_id`` in the order of the replies. ``paired`` are parsed
    prompts with ``reply_seq`` and ``reply_text``.
    """
    answered = (F.col("verb") == "maintenance.create.select.grp") & F.col("reply_text").isNotNull()
    placed = numbered(paired.filter(answered), [], ["reply_seq", "seq"], "_rn", hot_rows)
    return placed.select(
        "ts",
        F.col("reply_seq").alias("seq"),
        F.lit("create").alias("op"),
        (F.col("_rn") + (first_id - 1)).alias("maintenanceid"),
        F.col("reply_text").alias("name"),
        F.get("args", F.lit(0)).try_cast("bigint").alias("groupid"),
    )
