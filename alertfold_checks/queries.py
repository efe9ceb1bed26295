"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertfold.functions import templates
from alertfold.functions.distance import byte_levenshtein
from alertfold.functions.script import edit_script as script_of
from alertfold.functions.script import fold_template
from alertfold.functions.templates import format_batch, format_online, matches
from alertfold.operators import boxes, changelog, commands, folding, grouping, history, monitoring, mutes
from alertfold.operators import paging, replies, similarity
from alertfold.options import Options
from alertfold.plans.storage import scratch_path
from alertfold.sources import api_dump, queue, spool, tables
from alertfold.sources.outbox import write_outbox as write_outbox_of
from alertfold.streaming import mutes as live
from alertfold.streaming import online, run, sender
from alertfold.streaming.replies import pair_replies_stream as reply_stream
from alertfold_checks.inputs import Inputs, Streams

DAY = 86_400
NEAR = Options(wait=DAY, accuracy=0.1)
WIDE = Options(wait=DAY, accuracy=0.4)
MAINTENANCE_NOW = datetime(1998, 1, 15)
PROBLEMS_NOW = datetime(2001, 8, 2)
PROBLEM_AGE = 60 * DAY

Query = Callable[[Inputs], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(Inputs(spark, sf_dir))

    return {name: bind(build) for name, build in QUERIES.items()}


def boxed_alerts(i: Inputs) -> DataFrame:
    return boxes.assign_boxes(i.alerts, DAY)


def boxed_notes(i: Inputs) -> DataFrame:
    return boxes.assign_boxes(i.notes, DAY)


# compaction


@query
def assign_boxes(i: Inputs) -> DataFrame:
    return boxed_alerts(i).select("chat_id", "tick", "box", "pos", "seq")


@query
def batch_gate(i: Inputs) -> DataFrame:
    gated = boxes.batch_gate(boxed_alerts(i), min_approx=35)
    return gated.select("chat_id", "tick", "box", "seq", "compacted")


@query
def apply_mutes(i: Inputs) -> DataFrame:
    return mutes.apply_mutes(i.alerts, i.mute_log).select("chat_id", "seq", "text")


@query
def byte_distance(i: Inputs) -> DataFrame:
    paired = replies.pair_replies(i.prompts, i.replies).filter(F.col("reply_text").isNotNull())
    return paired.select("chat_id", "seq", byte_levenshtein(F.col("text"), F.col("reply_text")).alias("lev"))


@query
def similarity_pairs(i: Inputs) -> DataFrame:
    return similarity.similarity_pairs(boxed_alerts(i), 0.4)


@query
def similarity_pairs_left(i: Inputs) -> DataFrame:
    return similarity.similarity_pairs(boxed_alerts(i), 0.4, norm="left")


@query
def similarity_pairs_inclusive(i: Inputs) -> DataFrame:
    return similarity.similarity_pairs(boxed_alerts(i), 0.1, inclusive=True)


@query
def similarity_pairs_notes(i: Inputs) -> DataFrame:
    return similarity.similarity_pairs(boxed_notes(i), 0.1)


@query
def multibyte_guard(i: Inputs) -> DataFrame:
    return similarity.multibyte_guard(boxed_notes(i), 0.1)


@query
def assign_heads(i: Inputs) -> DataFrame:
    return grouping.assign_heads(boxed_alerts(i), NEAR)


@query
def resolve_roots(i: Inputs) -> DataFrame:
    return grouping.resolve_roots(boxed_alerts(i), NEAR).drop("text")


@query
def group_sizes(i: Inputs) -> DataFrame:
    return grouping.group_sizes(boxed_alerts(i), NEAR)


@query
def group_sizes_wide(i: Inputs) -> DataFrame:
    return grouping.group_sizes(boxed_alerts(i), WIDE)


@query
def singles(i: Inputs) -> DataFrame:
    return grouping.singles(boxed_alerts(i), NEAR)


@query
def edit_script(i: Inputs) -> DataFrame:
    """Scripts of near pairs, with what any cheapest script must have: its cost and its balance."""
    found = similarity.similarity_pairs(boxed_alerts(i), 0.1)
    texts = i.alerts.select("seq", "text")
    head = texts.select(F.col("seq").alias("head_seq"), F.col("text").alias("a"))
    member = texts.select(F.col("seq").alias("member_seq"), F.col("text").alias("b"))
    ops = found.join(head, "head_seq").join(member, "member_seq").withColumn("ops", script_of("a", "b"))
    count = lambda chars: F.length(F.regexp_replace("ops", f"[^{chars}]", ""))
    return ops.select(
        "head_seq", "member_seq", count("+!-").alias("cost"), (count("+") - count("-")).alias("growth")
    )


@query
def fold_groups(i: Inputs) -> DataFrame:
    """Groups with the number of members their template matches, which must be all."""
    folded = folding.fold_groups(boxed_alerts(i), NEAR)
    covered = F.filter("texts", lambda text: matches(F.col("template"), text))
    return folded.withColumn("covered", F.size(covered)).drop("texts", "template")


@query
def compact(i: Inputs) -> DataFrame:
    return folding.to_outbox(folding.compact(i.alerts, WIDE, i.mute_log))


@query
def send_directly(i: Inputs) -> DataFrame:
    return folding.send_directly(i.alerts)


@query
def compact_notes(i: Inputs) -> DataFrame:
    return folding.compact(i.notes, NEAR)


@query
def compact_counts(i: Inputs) -> DataFrame:
    """Messages in and out of compaction with mutes: nothing is lost or doubled."""
    sent = folding.compact(i.alerts, WIDE, i.mute_log)
    return sent.groupBy("chat_id", "tick", "box").agg(F.sum("cnt").alias("messages"))


# templates


@query
def match_templates(i: Inputs) -> DataFrame:
    return history.match_templates(i.entries)


@query
def merged_counts(i: Inputs) -> DataFrame:
    return history.merged_counts(history.match_templates(i.entries))


@query
def equivalent(i: Inputs) -> DataFrame:
    return i.template_pairs.select("seq", templates.equivalent(F.col("a"), F.col("b")).alias("same"))


@query
def merge_template(i: Inputs) -> DataFrame:
    """Template and text within the accuracy, limit included, merge into a template that matches both."""
    a, b = F.col("a"), F.col("b")
    ratio = byte_levenshtein(a, b) / F.greatest(F.octet_length(a), F.octet_length(b))
    merged = i.template_pairs.filter(ratio <= 0.4).withColumn("merged", fold_template(F.array(a, b)))
    takes = {f"takes_{c}": matches(F.col("merged"), F.col(c)) for c in "ab"}
    return merged.withColumns(takes).select("seq", *takes)


@query
def parse_header(i: Inputs) -> DataFrame:
    count, template = templates.parse_header(F.col("text"))
    return i.headed.select("seq", count.alias("cnt"), template.alias("template"))


@query
def format_texts(i: Inputs) -> DataFrame:
    cnt, pattern = F.col("cnt"), F.col("pattern")
    groups = i.entries.filter(pattern.isNotNull())
    return groups.select("seq", format_batch(cnt, pattern).alias("batch"), format_online(cnt, pattern).alias("online"))


@query
def recent_history(i: Inputs) -> DataFrame:
    return history.recent_history(i.alerts).select("chat_id", "seq", "hist_rank", "hist_seq", "age_minutes")


# monitoring


@query
def maintenance_status(i: Inputs) -> DataFrame:
    return monitoring.maintenance_status(i.maintenances, MAINTENANCE_NOW)


@query
def list_actions(i: Inputs) -> DataFrame:
    return monitoring.list_actions(i.actions, monitoring.ENABLED)


@query
def list_screens(i: Inputs) -> DataFrame:
    return monitoring.list_screens(i.screens)


@query
def host_groups(i: Inputs) -> DataFrame:
    return monitoring.host_groups(i.hostgroups)


def problems_of(i: Inputs) -> DataFrame:
    return monitoring.open_problems(
        i.triggers, i.trigger_events, PROBLEMS_NOW, min_severity=3, within_seconds=PROBLEM_AGE
    )


@query
def open_problems(i: Inputs) -> DataFrame:
    return problems_of(i)


@query
def groups_with_problems(i: Inputs) -> DataFrame:
    return monitoring.groups_with_problems(i.hostgroups, problems_of(i))


@query
def latest_event(i: Inputs) -> DataFrame:
    return monitoring.latest_event(i.trigger_events)


@query
def screen_graphs(i: Inputs) -> DataFrame:
    return monitoring.screen_graphs(i.screens, i.screen_items)


@query
def with_names(i: Inputs) -> DataFrame:
    items = i.screen_items.groupBy("screenid").agg(F.count(F.lit(1)).alias("items"))
    return monitoring.with_names(items, i.screens, "screenid")


# state changes


def maintenances_of(i: Inputs) -> DataFrame:
    return i.maintenances.select("maintenanceid", "name", "active_since", "active_till", F.array("groupid").alias("groupids")).withColumn(
        "timeperiods", F.array().cast("array<struct<timeperiod_type:int,period:int,start_date:timestamp_ntz>>")
    )


@query
def apply_maintenance_log(i: Inputs) -> DataFrame:
    return maintained(changelog.apply_maintenance_log(maintenances_of(i), i.maintenance_log))


@query
def update_table(i: Inputs) -> DataFrame:
    """The same through a table in buckets, the log in two parts."""
    path = scratch_path(i.spark, "maintenances")
    tables.write_table(maintenances_of(i), path, "maintenanceid", buckets=16)
    first = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    for part in (first, ~first):
        tables.update_table(i.spark, path, i.maintenance_log.filter(part), changelog.apply_maintenance_log)
    return maintained(tables.read_table(i.spark, path))


def maintained(now: DataFrame) -> DataFrame:
    period = F.get("timeperiods", F.lit(0))
    return now.select(
        "maintenanceid",
        "name",
        "active_since",
        "active_till",
        F.get("groupids", F.lit(0)).alias("groupid"),
        period["period"].alias("period"),
        period["start_date"].alias("period_start"),
    )


@query
def apply_ack_log(i: Inputs) -> DataFrame:
    return changelog.apply_ack_log(i.trigger_events, i.acks)


@query
def apply_action_log(i: Inputs) -> DataFrame:
    return changelog.apply_action_log(i.actions, i.action_log)


# command log


def parsed(i: Inputs) -> DataFrame:
    return commands.parse_commands(i.commands)


@query
def parse_commands(i: Inputs) -> DataFrame:
    return parsed(i).select("seq", "verb", F.array_join("args", ",").alias("args"), "known")


@query
def authorize(i: Inputs) -> DataFrame:
    return commands.authorize(i.commands, i.admins).select("seq", "username", "data")


@query
def refused(i: Inputs) -> DataFrame:
    return commands.refused(i.commands, i.admins).select("seq", "username", "data")


@query
def start_commands(i: Inputs) -> DataFrame:
    return i.start_texts.filter(commands.is_start_command(F.col("text"), "foldbot"))


@query
def split_lists(i: Inputs) -> DataFrame:
    return i.id_lists.select("seq", F.explode(commands.split_list(F.col("list"))).alias("entry"))


@query
def user_list(i: Inputs) -> DataFrame:
    return commands.user_list(i.admins)


def audit_of(i: Inputs) -> DataFrame:
    return commands.audit_log(commands.authorize(parsed(i), i.admins), i.actions, i.chats)


@query
def audit_log(i: Inputs) -> DataFrame:
    return audit_of(i).select("chat_id", "seq", "audit_text")


@query
def fan_out(i: Inputs) -> DataFrame:
    return commands.fan_out(audit_of(i), i.notify_chats)


@query
def mute_log_from_commands(i: Inputs) -> DataFrame:
    return commands.mute_log_from_commands(parsed(i))


@query
def action_log_from_commands(i: Inputs) -> DataFrame:
    return commands.action_log_from_commands(parsed(i))


@query
def maintenance_log_from_commands(i: Inputs) -> DataFrame:
    return commands.maintenance_log_from_commands(parsed(i)).select("seq", "op", "maintenanceid")


@query
def pair_replies(i: Inputs) -> DataFrame:
    return replies.pair_replies(i.prompts, i.replies)


@query
def acks_from_replies(i: Inputs) -> DataFrame:
    """Prompts are the presses of a problem button; the user's next press of another kind stands for the reply."""
    pressed = parsed(i).withColumn("text", F.col("data"))
    is_prompt = F.col("known") & (F.col("verb") == "problems.select")
    paired = replies.pair_replies(pressed.filter(is_prompt), pressed.filter(~is_prompt))
    return commands.acks_from_replies(paired, monitoring.latest_event(i.trigger_events))


@query
def creates_from_replies(i: Inputs) -> DataFrame:
    """Named maintenances, ids counted on from a free one."""
    pressed = parsed(i).withColumn("text", F.col("data"))
    is_prompt = F.col("known") & (F.col("verb") == "maintenance.create.select.grp")
    paired = replies.pair_replies(pressed.filter(is_prompt), pressed.filter(~is_prompt))
    return commands.creates_from_replies(paired, first_id=1_000_000).drop("ts")


@query
def paginate(i: Inputs) -> DataFrame:
    return paging.paginate(i.screens, [], ["name"])


@query
def paginate_problems(i: Inputs) -> DataFrame:
    return paging.paginate(problems_of(i), ["groupid"], ["description", "triggerid"])


@query
def chunk(i: Inputs) -> DataFrame:
    graphs = monitoring.screen_graphs(i.screens, i.screen_items).withColumn("owner", F.col("resourceid") % 100)
    chunks = paging.chunk(graphs, ["owner"], ["resourceid", "screenid"], "screenid")
    return chunks.select("owner", "chunk", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


# sources and streams


@query
def message_ids(i: Inputs) -> DataFrame:
    return queue.with_message_id(i.alerts).select("seq", "msg_id")


@query
def enqueue(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "queue")
    queue.enqueue(i.alerts, path)
    return queue.read_queue(i.spark, path).select("chat_id", "seq", "text", "msg_id")


@query
def read_spool(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "spool")
    spool.write_spool(i.page_messages, path)
    return spool.read_spool(i.spark, path).select("chat_id", "text")


@query
def stream_spool(i: Inputs) -> DataFrame:
    """Messages through a spool and its query to the outbox, and what the spool still holds when that starts again."""
    path, outbox, checkpoint = (scratch_path(i.spark, n) for n in ("spool", "outbox", "checkpoint"))
    spool.write_spool(i.page_messages, path)
    for _ in range(2):
        stream = spool.stream_spool(i.spark, path, max_files_per_trigger=1 << 30)
        write_outbox_of(stream, outbox, checkpoint).awaitTermination()
    handled = i.spark.read.schema("chat_id bigint, text string").parquet(outbox)
    return handled.select("chat_id", "text").unionAll(spool.read_spool(i.spark, path).select("chat_id", "text"))


def api_bodies(i: Inputs) -> DataFrame:
    """Responses of at most 100 triggers each, and a failed call per unmonitored group."""
    item = F.struct(F.col("triggerid").cast("string").alias("triggerid"), "description")
    pages = i.triggers.groupBy(F.floor(F.col("triggerid") / 100).alias("id")).agg(F.collect_list(item).alias("result"))
    bodies = pages.select(F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), "id", "result")).alias("body"))
    error = F.struct(F.lit(-32602).alias("code"), F.concat(F.lit("No permissions to "), "name").alias("data"))
    failures = i.hostgroups.filter(~F.col("monitored_hosts")).select(
        F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), error.alias("error"))).alias("body")
    )
    return bodies.unionByName(failures)


@query
def parse_api_dump(i: Inputs) -> DataFrame:
    items, _ = api_dump.parse_api_dump(api_bodies(i), "triggerid STRING, description STRING")
    return items.withColumn("triggerid", F.col("triggerid").cast("bigint"))


@query
def api_errors(i: Inputs) -> DataFrame:
    return api_dump.parse_api_dump(api_bodies(i), "triggerid STRING, description STRING")[1]


_ALERT_STREAM = [
    "user_id % 10 AS chat_id",
    "event_id AS seq",
    "ts",
    "concat(event_type, ' value ', cast(cast(floor(value) AS bigint) AS string), ' on user ', user_id) AS text",
]


def online_outbox(i: Inputs) -> DataFrame:
    stream = i.stream("events", _ALERT_STREAM)
    return run.run_to_outbox(online.compact_stream(stream))


@query
def compact_stream(i: Inputs) -> DataFrame:
    return online_outbox(i)


@query
def compact_stream_balance(i: Inputs) -> DataFrame:
    """Messages sent, and messages told by what is left after deletions: both are the messages that came."""
    return told(online_outbox(i))


@query
def compact_backlog(i: Inputs) -> DataFrame:
    """The same, with the first half of the messages as a table and the others as a stream that goes on from it."""
    first = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    done, state = online.compact_backlog(i.alerts.filter(first))
    rest = online.compact_stream(Streams(i.spark, i.sf_dir).alerts.filter(~first), state=state)
    return told(done.unionByName(run.run_to_outbox(rest)))


def told(rows: DataFrame) -> DataFrame:
    sent = rows.filter("action = 'SEND'")
    deleted = rows.filter("action = 'DELETE'").select("chat_id", "message_id", F.lit(True).alias("gone"))
    kept = sent.join(deleted, ["chat_id", "message_id"], "left")
    live = F.sum(F.when(F.col("gone").isNull(), F.col("cnt")))
    return kept.groupBy("chat_id").agg(F.count(F.lit(1)).alias("sent"), live.alias("told"))


def muted_streams(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """Alerts, and the mutes among the commands, as streams."""
    streams = Streams(i.spark, i.sf_dir)
    return streams.alerts, commands.mute_log_from_commands(commands.parse_commands(streams.commands))


@query
def live_mutes(i: Inputs) -> DataFrame:
    alerts, log = muted_streams(i)
    return run.run_to_outbox(live.hear(alerts, log).select("chat_id", "seq", "text"))


@query
def compact_stream_muted(i: Inputs) -> DataFrame:
    """Messages told per chat by online compaction under live mutes."""
    alerts, log = muted_streams(i)
    return told(run.run_to_outbox(online.compact_stream(alerts, mute_log=log)))


@query
def write_outbox(i: Inputs) -> DataFrame:
    """Alerts as a stream through the outbox, each delivered twice."""
    twice = i.stream("events", [*_ALERT_STREAM, "explode(array(1, 2)) AS delivery"])
    keyed = queue.with_message_id(twice).select("seq", "msg_id")
    return run.run_to_outbox(keyed, "msg_id")


@query
def send_batches(i: Inputs) -> DataFrame:
    """Messages told per box by a sender that takes all alerts as one tick."""
    path, checkpoint = scratch_path(i.spark, "sent"), scratch_path(i.spark, "checkpoint")
    sender.send_batches(i.stream("events", _ALERT_STREAM), path, checkpoint, WIDE).awaitTermination()
    sent = i.spark.read.parquet(path)
    return sent.groupBy("chat_id", "tick", "box").agg(F.sum("cnt").alias("messages"))


@query
def pair_replies_stream(i: Inputs) -> DataFrame:
    stream = i.stream(
        "conversations",
        [
            "conv_id AS chat_id",
            "concat('user', conv_id) AS username",
            "turn AS seq",
            "role = 'user' AS is_prompt",
            "role = 'system' AS is_system",
            "text",
        ],
    ).filter("NOT is_system")
    return run.run_to_outbox(reply_stream(stream))
