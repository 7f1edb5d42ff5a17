"""Conversations as exports of each chat format, read back as transcripts, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.operators import messages
from tessera.plans import model as M
from tessera.sources import chats


def _said(spark: SparkSession, sf: str) -> DataFrame:
    """Messages (role, text) in order of each session with two or more."""
    rows = messages.dialogue(M.messages(spark, sf)).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    return rows.filter(F.size("said") >= 2)


def _each(make: Callable[[Column], Column]) -> Column:
    return F.transform("said", make)


def _lines(make: Callable[[Column], Column], head: str | None = None) -> Column:
    lines = _each(lambda m: F.to_json(make(m)))
    return F.array_join(F.concat(F.array(F.lit(head)), lines) if head else lines, "\n")


def _kind(m: Column, user: str, other: str) -> Column:
    return F.when(m["role"] == "user", user).otherwise(other)


def _tree() -> Column:
    """Nodes of a chain below a root without a message."""
    name = lambda i: F.concat(F.lit("n"), F.lpad(i.cast("string"), 9, "0"))
    last = F.size("said") - 1

    def node(m: Column, i: Column) -> Column:
        said = F.struct(F.struct(m["role"].alias("role")).alias("author"), F.struct(F.array(m["text"]).alias("parts")).alias("content"))
        kids = F.when(i < last, F.array(name(i + 1))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.when(i == 0, "root").otherwise(name(i - 1)).alias("parent"), said.alias("message"), kids.alias("children"))

    nodes = F.array_join(F.transform("said", lambda m, i: F.concat(F.lit('"'), name(i), F.lit('":'), F.to_json(node(m, i)))), ",")
    return F.concat(F.lit('{"mapping":{"root":{"parent":null,"message":null,"children":["n000000000"]},'), nodes, F.lit("}}"))


FORMATS: dict[str, Callable[[], Column]] = {
    "claude_code": lambda: _lines(lambda m: F.struct(_kind(m, "human", "assistant").alias("type"), F.struct(F.array(F.struct(F.lit("text").alias("type"), m["text"].alias("text"))).alias("content")).alias("message"))),
    "codex": lambda: _lines(lambda m: F.struct(F.lit("event_msg").alias("type"), F.struct(_kind(m, "user_message", "agent_message").alias("type"), m["text"].alias("message")).alias("payload")), '{"type":"session_meta"}'),
    "gemini": lambda: _lines(lambda m: F.struct(_kind(m, "user", "gemini").alias("type"), F.array(F.struct(m["text"].alias("text"))).alias("content")), '{"type":"session_metadata"}'),
    "claude_ai": lambda: F.to_json(_each(lambda m: F.struct(_kind(m, "human", "ai").alias("sender"), m["text"].alias("text")))),
    "chatgpt": _tree,
    "slack": lambda: F.to_json(_each(lambda m: F.struct(F.lit("message").alias("type"), F.concat(F.lit("U-"), m["role"]).alias("user"), m["text"].alias("text")))),
}


def _query(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return chats.normalized(_said(spark, sf).select("session", FORMATS[kind]().alias("content"))).select("session", "transcript")

    run.__name__, run.__doc__ = f"chat_{kind}", f"Transcripts of all conversations from their {kind} exports."
    return run


def _sql(role: str, text: str, foot: str = "") -> str:
    return f"""WITH {M.MESSAGES}, d AS (SELECT session, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM messages WHERE role IN ('user', 'assistant') AND trim(text) <> ''),
f AS (SELECT *, first_value(role) OVER o AS opener, count(*) OVER (PARTITION BY session) AS said FROM d WINDOW o AS (PARTITION BY session ORDER BY turn)),
r AS (SELECT session, turn, said, {role} AS role, {text} AS text FROM f),
n AS (SELECT *, lead(role) OVER (PARTITION BY session ORDER BY turn) AS after FROM r WHERE said >= 2),
t AS (SELECT session, string_agg(CASE WHEN role = 'user' THEN '> ' ELSE '' END || text || CASE WHEN role = 'user' AND after = 'assistant' THEN chr(10) ELSE chr(10) || chr(10) END, '' ORDER BY turn) AS t FROM n GROUP BY session)
SELECT session, substr(t, 1, length(t) - 1){foot} AS transcript FROM t"""


_FOOT = " || chr(10) || '" + chats.FOOTER.strip() + "'"
ORACLE_SQL = {f"chat_{k}": _sql("role", "text") for k in FORMATS if k not in ("slack", "chatgpt")}
#: A tree of one role only isn't a conversation, so its export stays as it is; no session here has one role.
ORACLE_SQL["chat_chatgpt"] = _sql("role", "text")
ORACLE_SQL["chat_slack"] = _sql("CASE WHEN role = opener THEN 'user' ELSE 'assistant' END", "'[U-' || role || '] ' || text", _FOOT)
QUERIES = {f"chat_{k}": _query(k) for k in FORMATS}
