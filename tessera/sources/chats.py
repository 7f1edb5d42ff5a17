"""Chat exports as transcripts.

Every parser takes the parsed lines or the parsed whole of a file and gives an
array of (role, text), null where the file is of another format.  JSON is read as variants, so fields
may be of any kind without a fixed schema.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.functions.text import trimmed

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
#: What tools add to messages.
NOISE_TAGS = ("system-reminder", "command-message", "command-name", "task-notification", "user-prompt-submit-hook", "hook_output")
NOISE_LINES = ("CURRENT TIME:", "VERIFIED FACTS (do not contradict)", "AGENT SPECIALIZATION:", "Checking verified facts...", "Injecting timestamp...", "Starting background pipeline...", "Checking emotional weights...", "Auto-save reminder...", "Checking pipeline...")
HOOKS = ("Stop", "PreCompact", "PreToolUse", "PostToolUse", "UserPromptSubmit", "Notification", "SessionStart", "SessionEnd")
#: Fixed value: the last line of a transcript of several speakers.
FOOTER = "\n[source: slack-export | multi-party chat — speaker roles are positional, not verified]"


def _variant(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _string(v: Column, path: str) -> Column:
    """The string at a path; null if it is missing or of another kind."""
    return F.when(_kind(_variant(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def _kind(v: Column) -> Column:
    """STRING, ARRAY, OBJECT or another kind; null for no value."""
    return F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)


def _items(v: Column, path: str = "$") -> Column:
    """The items of the array at a path; null if there is none."""
    return F.when(_kind(_variant(v, path)) == "ARRAY", F.try_variant_get(v, path, "array<variant>"))


def _joined(parts: Column, by: str) -> Column:
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), by)


def content_text(c: Column, objects: bool = False) -> Column:
    """The text of a content: a string, or the text blocks of an array."""
    block = lambda b: F.when(_kind(b) == "STRING", F.try_variant_get(b, "$", "string")).when(_string(b, "$.type") == "text", _string(b, "$.text"))
    out = F.when(_kind(c) == "STRING", F.try_variant_get(c, "$", "string")).when(_kind(c) == "ARRAY", _joined(F.transform(_items(c), block), " "))
    out = out.when(_kind(c) == "OBJECT", F.coalesce(_string(c, "$.text"), F.lit(""))) if objects else out
    return trimmed(F.coalesce(out, F.lit("")))


def strip_noise(text: Column) -> Column:
    """A message without the blocks, lines and marks that tools add."""
    out = text
    for tag in NOISE_TAGS:
        out = F.regexp_replace(out, rf"(?sm)^(?:> )?<{tag}(?:\s[^>]*)?>.*?</{tag}>[ \t]*\n?", "")
    for line in NOISE_LINES:
        out = F.regexp_replace(out, rf"(?m)^(?:> )?\Q{line}\E.*\n?", "")
    out = F.regexp_replace(out, rf"(?m)^(?:> )?Ran \d+ (?:{'|'.join(HOOKS)}) hooks?.*\n?", "")
    out = F.regexp_replace(out, r"(?m)^(?:> )?…\s*\+\d+ lines.*\n?", "")
    out = F.regexp_replace(out, r"(?m)^(?:> )?\s*\[\d+\s+tokens?\]\s*\(ctrl\+o to expand\)\s*\n?|\s*\[\d+\s+tokens?\]\s*\(ctrl\+o to expand\)", "")
    return trimmed(F.regexp_replace(out, r"\n{4,}", "\n\n\n"))


def _lines(content: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(content, F.lit("")), r"\r?\n"), trimmed)
    return F.transform(F.filter(lines, lambda s: s != ""), lambda s: F.try_parse_json(s))


def _message(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _kept(messages: Column) -> Column:
    """Messages of the two roles that have a text."""
    return F.filter(messages, lambda m: m["role"].isNotNull() & (m["text"] != ""))


def _of_two(messages: Column, right: Column) -> Column:
    return F.when(right & (F.size(messages) >= 2), messages)


def claude_code(lines: Column) -> Column:
    """JSON lines with type and message; one line of another form rejects the file."""
    sound = F.forall(lines, lambda v: _string(v, "$.type").isNotNull() & (_kind(_variant(v, "$.message")) == "OBJECT") & _variant(v, "$.message.content").isNotNull())
    role = lambda v: F.when(_string(v, "$.type").isin("human", "user"), "user").when(_string(v, "$.type") == "assistant", "assistant")
    found = F.transform(lines, lambda v: _message(role(v), strip_noise(content_text(_variant(v, "$.message.content"), objects=True))))
    return _of_two(_kept(found), F.coalesce(sound, F.lit(False)))


def codex(lines: Column) -> Column:
    """JSON lines with a session_meta line; other lines that don't parse are skipped."""
    lines = F.filter(lines, lambda v: v.isNotNull())
    meta = F.exists(lines, lambda v: F.coalesce(_string(v, "$.type") == "session_meta", F.lit(False)))
    kind = lambda v: _string(v, "$.payload.type")
    role = lambda v: F.when(_string(v, "$.type") == "event_msg", F.when(kind(v) == "user_message", "user").when(kind(v) == "agent_message", "assistant"))
    return _of_two(_kept(F.transform(lines, lambda v: _message(role(v), trimmed(F.coalesce(_string(v, "$.payload.message"), F.lit("")))))), meta)


def gemini(lines: Column) -> Column:
    """JSON lines; only those after the session_metadata line count."""
    lines = F.filter(lines, lambda v: v.isNotNull())
    at = F.array_position(F.transform(lines, lambda v: F.coalesce(_string(v, "$.type"), F.lit(""))), "session_metadata")
    later = F.when(at > 0, F.slice(lines, at.cast("int") + 1, F.size(lines)))
    text = lambda v: _joined(F.filter(F.transform(F.coalesce(_items(v, "$.content"), F.array().cast("array<variant>")), lambda b: _string(b, "$.text")), lambda t: trimmed(t) != ""), "\n")
    role = lambda v: F.when(_string(v, "$.type") == "user", "user").when(_string(v, "$.type") == "gemini", "assistant")
    return _of_two(_kept(F.transform(later, lambda v: _message(role(v), text(v)))), at > 0)


def _plain_messages(items: Column) -> Column:
    who = lambda v: F.coalesce(_string(v, "$.role"), F.when(_variant(v, "$.role").isNull(), _string(v, "$.sender")), F.lit(""))
    role = lambda v: F.when(who(v).isin("user", "human"), "user").when(who(v).isin("assistant", "ai"), "assistant")

    def text(v: Column) -> Column:
        body = content_text(_variant(v, "$.content"))
        return F.when(body != "", body).otherwise(trimmed(F.coalesce(_string(v, "$.text"), F.lit(""))))

    found = _kept(F.transform(items, lambda v: _message(role(v), text(v))))
    return F.when(F.size(found) >= 2, found)


def claude_ai(v: Column) -> Column:
    """An array of messages, or an object that holds one."""
    return _plain_messages(F.coalesce(_items(v), _items(v, "$.messages"), _items(v, "$.chat_messages")))


def claude_ai_export(v: Column) -> Column:
    """An array of conversations: an array of their messages."""
    convs = _items(v)
    of = lambda c: F.coalesce(_items(c, "$.chat_messages"), _items(c, "$.messages"))
    found = F.filter(F.transform(convs, lambda c: _plain_messages(of(c))), lambda m: m.isNotNull())
    return F.when(of(F.get(convs, F.lit(0))).isNotNull(), found)


def _walk(text: str | None) -> list[dict] | None:
    try:
        mapping = json.loads(text or "")["mapping"]
        roots = [k for k, n in mapping.items() if "parent" in n and n["parent"] is None]
        at = next((k for k in roots if mapping[k].get("message") is None), roots[0] if roots else None)
        seen, out = set(), []
        while at is not None and at not in seen:
            seen.add(at)
            node = mapping[at]
            if (m := node.get("message")) is not None:
                role, parts = m["author"]["role"], (m["content"] or {}).get("parts") or []
                said = " ".join(p for p in parts if isinstance(p, str)).strip()
                if said and role in ("user", "assistant"):
                    out.append({"role": role, "text": said})
            kids = node.get("children") or []
            at = kids[0] if kids and isinstance(kids[0], str) else None
    except (ValueError, KeyError, TypeError, AttributeError):
        return None
    return out if {m["role"] for m in out} == {"user", "assistant"} else None


@F.pandas_udf(MESSAGES)
def chatgpt(contents: pd.Series) -> pd.Series:
    """A tree of messages; the path of first children from the root counts.

    A walk from node to node has no column form within one row.
    """
    return contents.map(_walk)


def slack(v: Column) -> Column:
    """An array of messages of several speakers.

    The first speaker is the user, and each new one has the other role than the
    new one before.  Texts begin with the speaker.
    """
    items = F.filter(_items(v), lambda v: F.coalesce(_string(v, "$.type") == "message", F.lit(False)))
    who = lambda v: F.coalesce(_string(v, "$.user"), F.when(_variant(v, "$.user").isNull(), _string(v, "$.username")), F.lit(""))
    named = F.transform(items, lambda v: F.struct(trimmed(F.regexp_replace(who(v), r"[\[\]\x00-\x1F]", "_")).alias("who"), trimmed(F.coalesce(_string(v, "$.text"), F.lit(""))).alias("text")))
    said = F.filter(named, lambda m: (m["who"] != "") & (m["text"] != ""))
    speakers = F.array_distinct(F.transform(said, lambda m: m["who"]))
    role = lambda m: F.when(F.array_position(speakers, m["who"]) % 2 == 1, "user").otherwise("assistant")
    found = F.transform(said, lambda m: _message(role(m), F.concat(F.lit("["), m["who"], F.lit("] "), m["text"])))
    return F.when(F.size(found) >= 2, found)


def transcript(messages: Column) -> Column:
    """User lines after ``> ``, an answer right below, a blank line after each exchange."""
    def piece(m: Column, i: Column) -> Column:
        after = F.get(messages, i + 1)["role"]
        pair = (m["role"] == "user") & F.coalesce(after == "assistant", F.lit(False))
        return F.concat(F.when(m["role"] == "user", "> ").otherwise(""), m["text"], F.when(pair, "\n").otherwise("\n\n"))

    whole = F.array_join(F.transform(messages, piece), "")
    return F.when(messages.isNotNull(), F.substring(whole, 1, F.length(whole) - 1))


def normalized(files: DataFrame, text: str = "content") -> DataFrame:
    """Add ``transcript`` to ``files``: that of a file of any format; else its text.

    A text with three lines or more that begin with ``>`` is one already.  The
    formats are tried in a fixed order; each step is a column of its own, so a
    file is parsed once for all of them.
    """
    c = F.col(text)
    step = files.withColumns({"_lines": _lines(c), "_json": F.try_parse_json(c)})
    step = step.withColumns({"_1": claude_code(F.col("_lines")), "_2": codex(F.col("_lines")), "_3": gemini(F.col("_lines")), "_4": claude_ai_export(F.col("_json")), "_5": claude_ai(F.col("_json")), "_6": chatgpt(c), "_7": slack(F.col("_json"))})
    step = step.withColumns({"_one": F.coalesce("_1", "_2", "_3", "_5", "_6", "_7"), "_foot": F.coalesce("_1", "_2", "_3", "_5", "_6").isNull() & F.col("_7").isNotNull(), "_many": F.when(F.coalesce("_1", "_2", "_3").isNull() & (F.size("_4") > 0), F.col("_4"))})
    single = F.concat(transcript(F.col("_one")), F.when(F.col("_foot"), FOOTER).otherwise(""))
    parsed = F.coalesce(F.array_join(F.transform("_many", transcript), "\n\n"), single)
    quoted = F.size(F.filter(F.split(c, "\n"), lambda s: F.startswith(trimmed(s), F.lit(">")))) >= 3
    return step.withColumn("transcript", F.when(quoted, c).otherwise(F.coalesce(parsed, c))).select(*files.columns, "transcript")


def block_text(v: Column) -> Column:
    """One block of a swept message as text."""
    kind = F.coalesce(_string(v, "$.type"), F.lit(""))
    tool = F.concat(F.lit("[tool_use: "), F.coalesce(_string(v, "$.name"), F.lit("?")), F.lit(" input="), F.coalesce(F.to_json(_variant(v, "$.input")), F.lit("{}")), F.lit("]"))
    result = F.concat(F.lit("[tool_result: "), F.coalesce(F.to_json(_variant(v, "$.content")), F.lit("")), F.lit("]"))
    return F.when(kind == "text", F.coalesce(_string(v, "$.text"), F.lit(""))).when(kind == "tool_use", tool).when(kind == "tool_result", result).otherwise(F.concat(F.lit("["), kind, F.lit(": "), F.to_json(v), F.lit("]")))


def swept(line: Column) -> Column:
    """struct (session, uuid, ts, role, text) of a record line; null for other lines."""
    v = F.try_parse_json(line)
    c = _variant(v, "$.message.content")
    flat = F.when(_kind(c) == "STRING", F.try_variant_get(c, "$", "string")).when(_kind(c) == "ARRAY", F.array_join(F.filter(F.transform(F.filter(_items(c), lambda b: _kind(b) == "OBJECT"), block_text), lambda t: t != ""), "\n"))
    kind = _string(v, "$.type")
    row = F.struct(_string(v, "$.sessionId").alias("session"), _string(v, "$.uuid").alias("uuid"), _string(v, "$.timestamp").alias("ts"), kind.alias("role"), trimmed(flat).alias("text"))
    return F.when(kind.isin("user", "assistant") & _string(v, "$.sessionId").isNotNull() & _string(v, "$.uuid").isNotNull() & (trimmed(flat) != ""), row)


def diary_sections(text: Column) -> Column:
    """Sections (title, body) that ``## `` lines open; text before the first has no title."""
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), r"\n##\s+")
    row = lambda p, i: F.struct(F.when(i > 0, trimmed(F.split_part(p, F.lit("\n"), F.lit(1)))).otherwise("").alias("title"), trimmed(F.when(i > 0, F.regexp_replace(p, r"^[^\n]*\n?", "")).otherwise(p)).alias("body"))
    return F.filter(F.transform(parts, row), lambda s: (s["title"] != "") | (s["body"] != ""))


