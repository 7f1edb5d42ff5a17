import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import chats


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def normalized(spark, text):
    return chats.normalized(spark.createDataFrame([(text,)], "content string")).first().transcript


def parsed(f, by_line=True):
    return lambda t: f(chats._lines(t) if by_line else F.try_parse_json(t))


def lines(*rows):
    return "\n".join(json.dumps(r) for r in rows)


def test_claude_code(spark):
    rows = [{"type": "human", "message": {"content": "What is Rust?"}}, {"type": "assistant", "message": {"content": [{"type": "text", "text": "A language."}, {"type": "image"}, "ok"]}}]
    assert normalized(spark, lines(*rows)) == "> What is Rust?\nA language. ok\n"
    assert one(spark, parsed(chats.claude_code), lines(*rows) + "\nnot json") is None
    assert one(spark, parsed(chats.claude_code), lines(rows[0], {"type": "user"})) is None
    assert one(spark, parsed(chats.claude_code), lines(rows[0])) is None


def test_noise(spark):
    text = "keep\n<system-reminder>\nx\n</system-reminder>\nRan 2 Stop hooks\nCURRENT TIME: now\nmy <system-reminder> inline\n[12 tokens] (ctrl+o to expand)\nend"
    assert one(spark, chats.strip_noise, text) == "keep\nmy <system-reminder> inline\nend"


def test_codex_and_gemini(spark):
    event = lambda kind, m: {"type": "event_msg", "payload": {"type": kind, "message": m}}
    text = lines({"type": "session_meta"}, event("user_message", "hello codex")) + "\nbroken\n" + lines(event("agent_message", "hi there"))
    assert normalized(spark, text) == "> hello codex\nhi there\n"
    assert one(spark, parsed(chats.codex), lines(event("user_message", "a"), event("agent_message", "b"))) is None
    turn = lambda kind, m: {"type": kind, "content": [{"text": m}]}
    text = lines(turn("user", "early"), {"type": "session_metadata"}, turn("user", "q"), turn("gemini", "a"))
    assert normalized(spark, text) == "> q\na\n"


def test_claude_ai(spark):
    flat = [{"role": "user", "content": "q"}, {"sender": "assistant", "text": "a"}, {"role": "human", "content": [{"type": "text", "text": "again"}]}]
    assert normalized(spark, json.dumps(flat)) == "> q\na\n\n> again\n"
    assert normalized(spark, json.dumps({"chat_messages": flat[:2]})) == "> q\na\n"
    assert normalized(spark, json.dumps([{"chat_messages": flat[:2]}, {"messages": flat[:2]}])) == "> q\na\n\n\n> q\na\n"


def test_chatgpt(spark):
    node = lambda parent, role, text, kids: {"parent": parent, "message": role and {"author": {"role": role}, "content": {"parts": [text]}}, "children": kids}
    tree = {"mapping": {"root": node(None, None, None, ["m1"]), "m1": node("root", "user", "q", ["m2", "m3"]), "m2": node("m1", "assistant", "a", ["m1"]), "m3": node("m1", "assistant", "other", [])}}
    assert normalized(spark, json.dumps(tree)) == "> q\na\n"


def test_slack(spark):
    said = [{"type": "message", "user": u, "text": f"from {u}"} for u in ("U1", "U2", "U3", "U1", "U2")]
    got = one(spark, parsed(chats.slack, False), json.dumps(said + [{"type": "join", "user": "U9"}]))
    assert [m.role for m in got] == ["user", "assistant", "user", "user", "assistant"] and got[0].text == "[U1] from U1"
    assert normalized(spark, json.dumps(said)).endswith("not verified]")


@pytest.mark.parametrize("text", ["", "just text", "{", "[]", "> a\nb\n> c\n> d", "[1, 2]", "null"])
def test_other_texts_pass_through(spark, text):
    assert normalized(spark, text) == text


def test_swept_records(spark):
    record = {"type": "assistant", "sessionId": "s", "uuid": "u", "timestamp": "t", "message": {"role": "assistant", "content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "ls", "input": {"a": 1}}, {"type": "tool_result", "content": "x"}]}}
    got = one(spark, chats.swept, json.dumps(record))
    assert (got.session, got.uuid, got.role) == ("s", "u", "assistant") and got.text == 'hi\n[tool_use: ls input={"a":1}]\n[tool_result: "x"]'
    assert one(spark, chats.swept, json.dumps(record | {"type": "summary"})) is None and one(spark, chats.swept, "x") is None


def test_diary(spark):
    got = one(spark, chats.diary_sections, "# Day\n\n## Morning\nwoke up\n## Evening\nslept\n")
    assert [(s.title, s.body) for s in got] == [("", "# Day"), ("Morning", "woke up"), ("Evening", "slept")]
