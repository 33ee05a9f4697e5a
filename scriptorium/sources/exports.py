"""Chat exports as rows: the person's own messages, with their dates, projects and origins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLANK = "\\A\\s+|\\s+\\z"
_ATTRIBUTES = "uuid string, name string, created_at string, project struct<name:string>, project_uuid string"
_MESSAGE = "array<struct<uuid:string,sender:string,text:string,content:array<struct<type:string,text:string>>,created_at:string>>"


def stripped(text: Column | str) -> Column:
    return F.regexp_replace(text, _BLANK, "")


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _origin(export: Column, label: Column, conversation: Column, message: Column) -> Column:
    return F.concat(export, F.lit('#conv:"'), label, F.lit('"('), F.substring(conversation, 1, 8), F.lit(")#msg:"), F.substring(message, 1, 8))


def flat_messages(conversations: DataFrame, export_col: str, json_col: str, projects: DataFrame) -> DataFrame:
    """export, conversation, position, text, date, project, origin of each message by a human in conversations (JSON, one
    a row, with a list of messages).

    The text is the message's own or else its text blocks, a blank line between them; the date that of the message or
    else of the conversation; the project the one named in the conversation or else that of its id in
    `projects` (uuid, name). Messages without a text, and JSON that can't be read, give no row."""
    fields = _ATTRIBUTES.replace(" s", ":s").replace(", ", ",")
    c = conversations.select(F.col(export_col).alias("export"), F.from_json(json_col, f"struct<{fields},chat_messages:{_MESSAGE}>").alias("c"))
    known = projects.select(F.col("uuid").alias("_uuid"), F.col("name").alias("_name"))
    c = c.join(known, F.col("c.project_uuid") == F.col("_uuid"), "left")
    m = c.select("export", F.col("c.uuid").alias("conversation"), F.coalesce(_some(stripped("c.name")), F.substring("c.uuid", 1, 8)).alias("label"), F.coalesce("c.project.name", "_name").alias("project"), F.col("c.created_at").alias("_at"), F.posexplode("c.chat_messages").alias("position", "m"))
    own = F.filter("m.content", lambda b: (b["type"] == "text") & (b["text"] != ""))
    blocks = stripped(F.array_join(F.transform(own, lambda b: stripped(b["text"])), "\n\n"))
    text = F.coalesce(_some(stripped("m.text")), blocks)
    rows = m.where("m.sender = 'human'").select("export", "conversation", F.col("position").cast("long").alias("position"), text.alias("text"), F.coalesce("m.created_at", "_at").alias("date"), "project", _origin(F.col("export"), F.col("label"), F.col("conversation"), F.col("m.uuid")).alias("origin"))
    return rows.where("text <> ''")


def export_stats(conversations: DataFrame, json_col: str, projects: DataFrame) -> DataFrame:
    """One row: conversations, messages by humans and by assistants (with and without a text), and projects."""
    c = conversations.select(F.from_json(json_col, "struct<chat_messages:array<struct<sender:string>>>").alias("c"))
    by = lambda who: F.sum(F.size(F.filter(F.coalesce("c.chat_messages", F.expr("cast(array() as array<struct<sender:string>>)")), lambda m: m["sender"] == who)))
    counts = c.agg(F.count("*").alias("conversations"), by("human").alias("human"), by("assistant").alias("assistant"))
    return counts.join(F.broadcast(projects.agg(F.count_distinct("uuid").alias("projects"))))  # one row each


def tree_messages(conversations: DataFrame, export_col: str, json_col: str) -> DataFrame:
    """export, conversation, message, text, date, origin of each message by a user in conversations (JSON, one a row, with
    a map of nodes).

    Nodes are read as VARIANT, as their parts are strings and objects side by side: the strings are kept, a blank line
    between them. Hidden messages don't count; of those with one id the first by the node's key does, whatever
    its text. The date is the message's or else the conversation's; a time of 0 is none."""
    c = conversations.select(F.col(export_col).alias("export"), F.try_parse_json(json_col).alias("c"))
    get = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    own = c.select("export", F.coalesce(get("c", "$.conversation_id"), get("c", "$.id"), F.lit("unknown")).alias("conversation"), get("c", "$.title").alias("title"), get("c", "$.create_time", "double").alias("started"), get("c", "$.mapping", "variant").alias("mapping"))
    spark = conversations.sparkSession
    nodes = own.lateralJoin(spark.tvf.variant_explode(F.col("mapping").outer())).drop("mapping", "pos")
    role, hidden = get("value", "$.message.author.role"), get("value", "$.message.metadata.is_visually_hidden_from_conversation", "boolean")
    users = nodes.where((role == "user") & ~F.coalesce(hidden, F.lit(False)))
    message = _some(F.coalesce(get("value", "$.message.id"), get("value", "$.id"), F.lit("")))
    at = get("value", "$.message.create_time", "double")
    users = users.select("export", "conversation", "title", "started", "key", message.alias("message"), at.alias("at"), get("value", "$.message.content.parts", "array<variant>").alias("parts")).where("message is not null")
    first = F.row_number().over(Window.partitionBy("export", "conversation", "message").orderBy("key"))
    users = users.withColumn("_r", first).where("_r = 1")
    strings = F.transform(F.filter("parts", lambda p: F.schema_of_variant(p) == "STRING"), lambda p: stripped(F.variant_get(p, "$", "string")))
    text = stripped(F.array_join(F.filter(strings, lambda s: s != ""), "\n\n"))
    when = F.coalesce(F.nullif("at", F.lit(0.0)), F.nullif("started", F.lit(0.0)))
    date = F.date_format(F.timestamp_micros((when * 1_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    label = F.coalesce(_some(stripped("title")), F.substring("conversation", 1, 8))
    rows = users.select("export", "conversation", "message", text.alias("text"), date.alias("date"), _origin(F.col("export"), label, F.col("conversation"), F.col("message")).alias("origin"))
    return rows.where("text <> ''")
