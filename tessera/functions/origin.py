"""Whether a corpus is dialogue with an assistant, by brand terms and turn marks."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

#: Terms that speak for themselves, and terms that need another sign.
SURE_TERMS = ("Anthropic", "Claude Code", "Claude 3", "Claude 4", "claude mcp", "CLAUDE.md", ".claude/", "ChatGPT", "GPT-4", "GPT-3", "GPT-5", "OpenAI", "gpt-4o", "gpt-4-turbo", "o1-preview", "o3", "gemini-pro", "gemini-1.5", "Google AI", "Mixtral", "Cohere", "MCP", "LLM", "RAG", "fine-tune", "context window", "embedding")
AMBIGUOUS_TERMS = ("Claude", "Opus", "Sonnet", "Haiku", "Gemini", "Bard", "Llama", "Mistral")
TURN_MARKS = (r"\buser\s*:\s*", r"\bassistant\s*:\s*", r"\bhuman\s*:\s*", r"\bai\s*:\s*", r"\b>>>\s*User\b", r"\b>>>\s*Assistant\b")
#: Densities a thousand bytes, and bytes from which silence means something.
BRAND_DENSITY, TURN_DENSITY, FLOOR = 0.5, 2.0, 150


def _term(term: str) -> str:
    edge = lambda c: r"\b" if c.isalnum() or c == "_" else ""
    return f"(?i){edge(term[0])}" + r"\Q" + term + r"\E" + edge(term[-1])


def corpus_origin(samples: DataFrame, key: str = "corpus", text: str = "text") -> DataFrame:
    """One row a corpus of ``samples``: brand hits, turn hits, verdict and confidence.

    Hits are counted in each text and summed, so a corpus is never put together;
    bytes count the two line ends between texts.
    """
    c = F.coalesce(F.col(text), F.lit(""))
    # a pattern is only looked for in texts that hold what every match of it holds
    rows = samples.select(key, c.alias("_c"), F.lower(c).alias("_low"))
    held = lambda words: reduce(and_, (F.contains("_low", F.lit(w.lower())) for w in words))
    count = lambda ps: sum((F.when(held(words), F.regexp_count("_c", F.lit(p))).otherwise(0) for p, words in ps), F.lit(0))
    terms = lambda ts: [(_term(t), [t]) for t in ts]
    marks = [(f"(?i){p}", [re.search("[A-Za-z]{2,}", p.replace(r"\b", ""))[0], ">>>" if ">>>" in p else ":"]) for p in TURN_MARKS]
    per = rows.select(key, F.octet_length("_c").alias("b"), count(terms(SURE_TERMS)).alias("sure"), count(terms(AMBIGUOUS_TERMS)).alias("maybe"), count(marks).alias("turns"))
    sums = per.groupBy(key).agg((F.sum("b") + 2 * (F.count("*") - 1)).alias("bytes"), F.sum("sure").alias("sure"), F.sum("maybe").alias("maybe"), F.sum("turns").alias("turns"))
    context = (F.col("sure") > 0) | (F.col("turns") > 0)
    hits = F.col("sure") + F.when(context, F.col("maybe")).otherwise(0)
    rows = sums.withColumn("brands", hits).withColumns({"d": F.col("brands") / (F.greatest(F.col("bytes"), F.lit(1)) / 1000.0), "t": F.col("turns") / (F.greatest(F.col("bytes"), F.lit(1)) / 1000.0)})
    dialogue = (F.col("d") >= BRAND_DENSITY) | (F.col("t") >= TURN_DENSITY)
    silent = (F.col("brands") == 0) & (F.col("turns") == 0) & (F.col("bytes") >= FLOOR)
    confidence = F.when(dialogue, F.least(F.lit(0.95), 0.6 + 0.1 * (F.col("d") + F.col("t")))).when(silent, 0.9).otherwise(0.4)
    return rows.select(key, "brands", "turns", (dialogue | ~silent).alias("ai_dialogue"), confidence.alias("confidence"))
