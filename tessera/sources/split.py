"""Cutting files of many sessions into one text a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.operators.chunk import lines_of

#: The line that opens a session, marks of a resumed one, the line of a time, and prompts that are no subject.
OPENS, RESUMED = "Claude Code v", ("Ctrl+E", "previous messages")
TIME = r"⏺\s+(\d{1,2}):(\d{2})\s+([AP]M)\s+\w+,\s+(\w+)\s+(\d{1,2}),\s+(\d{4})"
NO_SUBJECT = r"^(\./|cd |ls |python|bash|git |cat |source |export |claude|./activate)"
MONTHS = "January February March April May June July August September October November December".split()
NAME_BYTES = 255


def sessions(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """(path, session, name, content) of the sessions of each file.

    A session runs from an opening line to the next; one that resumes another
    within six lines opens none.  Lines before the first are left out.  The name
    is made of the file's, the time in the first 50 lines or a number, and the
    first prompt that isn't a command.
    """
    lines = lines_of(F.col(text))
    near = lambda i: F.array_join(F.slice(F.col("_lines"), i + 1, 6), "")
    opens = lambda s, i: F.contains(s, F.lit(OPENS)) & ~F.contains(near(i), F.lit(RESUMED[0])) & ~F.contains(near(i), F.lit(RESUMED[1]))
    row = files.select(path, lines.alias("_lines"))
    row = row.select(path, F.posexplode(F.transform("_lines", lambda s, i: F.struct(s.alias("line"), opens(s, i).alias("opens")))).alias("n", "x")).select(path, "n", "x.line", "x.opens")
    at = W.partitionBy(path).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    numbered = row.withColumn("session", F.sum(F.col("opens").cast("int")).over(at)).filter("session > 0")
    grouped = numbered.groupBy(path, "session").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("_s"))
    head = F.array_join(F.slice("_s", 1, 50), "\n")
    part = lambda g: F.regexp_extract(head, TIME, g)
    month = F.lpad(F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part(4)), F.lit(0)), F.lit(0)).cast("string"), 2, "0")
    time = F.when(part(6) != "", F.concat(part(6), F.lit("-"), month, F.lit("-"), F.lpad(part(5), 2, "0"), F.lit("_"), part(1), part(2), part(3))).otherwise(F.concat(F.lit("part"), F.lpad(F.col("session").cast("string"), 2, "0")))
    prompts = F.filter(F.transform(F.filter("_s", lambda s: F.startswith(s, F.lit("> "))), lambda s: F.trim(F.substring(s, 3, 1 << 20))), lambda p: (F.octet_length(p) > 5) & ~F.lower(p).rlike(NO_SUBJECT))
    subject = F.regexp_replace(F.trim(F.regexp_replace(F.get(prompts, F.lit(0)), r"[^\w\s-]", "")), r"\s+", "-")
    stem = F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), r"(?<=.)\.[^.]*$", "")
    room = F.lit(NAME_BYTES - 7) - F.octet_length(stem) - F.octet_length(time)
    name = F.concat(stem, F.lit("__"), time, F.lit("_"), F.substring(F.coalesce(subject, F.lit("session")), F.lit(1), room), F.lit(".txt"))
    safe = F.regexp_replace(F.regexp_replace(name, r"[^\w.-]", "_"), "_+", "_")
    return grouped.select(path, "session", safe.alias("name"), F.array_join("_s", "\n").alias("content"))
