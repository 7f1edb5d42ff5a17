"""Messages of sessions: pairing, ids for idempotent ingest, and themes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

#: Messages between saves, recent ones looked at, themes and their least length.
EVERY, RECENT, THEMES, THEME_LENGTH = 15, 30, 3, 4
#: Words that are no themes.
NO_THEMES = (
    "the and for are but not you all any can had her was one our out day get has him his how man new now old see two way who boy did "
    "its let put say she too use from that this with have been will your when more into just also like here some what make time know "
    "take them then they well were which there their about would these those think could first after where while being every going "
    "other still thing things doing using need want look file files code work sure okay yeah"
).split()


def dialogue(messages: DataFrame) -> DataFrame:
    """Turns of the two roles that have a text."""
    return messages.filter(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))


def exchanges(messages: DataFrame) -> DataFrame:
    """(session, turn, question, answer): each user turn and the answer right after it."""
    order = W.partitionBy("session").orderBy("turn")
    after = dialogue(messages).withColumns({"next_role": F.lead("role").over(order), "next_text": F.lead("text").over(order)})
    return after.filter("role = 'user'").select("session", "turn", F.col("text").alias("question"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("answer"))


def sweep_drawers(messages: DataFrame) -> DataFrame:
    """Messages as drawers with ids that a second ingest finds again."""
    return dialogue(messages).select(F.concat_ws("_", F.lit("sweep"), "session", "uuid").alias("id"), F.col("session").cast("string").alias("session"), "role", F.col("text").alias("content"))


def only_new(drawers: DataFrame, stored: DataFrame) -> DataFrame:
    """The drawers whose id isn't stored, each once."""
    return drawers.dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti")


def saves(messages: DataFrame) -> DataFrame:
    """(session, saves): how often a session of user messages is saved."""
    return messages.filter("role = 'user'").groupBy("session").agg(F.floor(F.count("*") / EVERY).alias("saves"))


def themes(messages: DataFrame) -> DataFrame:
    """(session, rank, theme, n): the most frequent words of the recent messages.

    Words are letters only, once other characters are taken off their ends; ties
    go to the word.
    """
    last = F.row_number().over(W.partitionBy("session").orderBy(F.desc("turn")))
    recent = dialogue(messages).withColumn("_at", last).filter(F.col("_at") <= RECENT)
    word = F.lower(F.regexp_replace("w", r"^[^\p{IsAlphabetic}]+|[^\p{IsAlphabetic}]+$", ""))
    words = recent.select("session", F.explode(F.split("text", r"(?U)\s+")).alias("w")).select("session", word.alias("theme"))
    kept = words.filter((F.octet_length("theme") >= THEME_LENGTH) & F.col("theme").rlike(r"^\p{IsAlphabetic}+$") & ~F.col("theme").isin(NO_THEMES))
    counted = kept.groupBy("session", "theme").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("session").orderBy(F.desc("n"), "theme"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= THEMES)
