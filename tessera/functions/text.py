"""Column forms of the store's text rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Words that the index leaves out.
STOP_WORDS = (
    "the and for are but not you all can had her was one our out has have from they been said each which their will other "
    "about many then them these some would make like into time very when come could more than that this with what just "
    "also there where after back only most over such here should because does did get how its may let new now old see way "
    "who use being well"
).split()
#: Fixed value: anything that ends a token.
BOUNDARY = r"[^\p{L}\p{N}_]+"
#: Fixed values of the store: separator of hashed parts and mark of a link's two ends.
UNIT, LINK = "\u001f", "↔"


def tokens(text: Column) -> Column:
    """Tokens of at least 3 bytes, in small letters, without stop words.

    Bytes are counted before letters are made small.  Null gives no token.
    """
    long = F.filter(F.split(F.coalesce(text, F.lit("")), BOUNDARY), lambda w: F.octet_length(w) >= 3)
    small = F.transform(long, F.lower)
    return F.filter(small, lambda w: ~w.isin(STOP_WORDS))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def run_starts(items: str, field: str | None = None) -> Column:
    """Places, from 0, at which runs of equal items of a sorted array column begin; ``field`` is what is compared."""
    key = lambda i: F.get(items, i) if field is None else F.get(items, i)[field]
    places = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: (i == 0) | (key(i) != key(F.greatest(i - 1, F.lit(0)))))


def query_tokens(query: str) -> list[str]:
    """The tokens of a literal, repeated ones kept."""
    import regex

    return [w.lower() for w in regex.split(BOUNDARY, query) if len(w.encode()) >= 3 and w.lower() not in STOP_WORDS]


def repeats(docs: DataFrame, ident: str) -> bool:
    """Whether some ``ident`` comes more than once; only that column is read."""
    return not docs.groupBy(ident).count().filter("count > 1").isEmpty()


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def entity_id(name: Column) -> Column:
    """Identifier of an entity: small letters, spaces to ``_``, no apostrophe."""
    return F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))


def predicate_id(name: Column) -> Column:
    """Identifier of a predicate: small letters, spaces to ``_``."""
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def wing_name(name: Column) -> Column:
    """Normal form of a wing: small letters, spaces and ``-`` to ``_``."""
    return F.translate(F.lower(name), " -", "__")


def is_date(value: Column) -> Column:
    """Whether a temporal literal has a date only."""
    return (F.length(value) == 10) & (F.substring(value, 5, 1) == "-") & (F.substring(value, 8, 1) == "-")


def start_key(value: Column) -> Column:
    """Comparison key of a start: a date is its first second."""
    return F.when(is_date(value), F.concat(value, F.lit("T00:00:00Z"))).otherwise(value)


def end_key(value: Column) -> Column:
    """Comparison key of an end: a date is its last second."""
    return F.when(is_date(value), F.concat(value, F.lit("T23:59:59Z"))).otherwise(value)


def canonical_time(value: str) -> str:
    """A temporal literal in the stored form; anything else is a ValueError."""
    import datetime
    import re

    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        datetime.date.fromisoformat(value)
        return value
    if m := re.fullmatch(r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(Z|\+00:00)", value):
        datetime.datetime.fromisoformat(m[1])
        return f"{m[1]}Z"
    raise ValueError(f"not a date or UTC time: {value!r}")


def basename(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def snippet(text: Column, n: int) -> Column:
    """The first ``n`` characters, with dots if the text has more than ``n`` bytes."""
    return F.concat(F.substring(text, 1, n), F.when(F.octet_length(text) > n, "...").otherwise(""))


def preview(text: Column, n: int = 200) -> Column:
    """The first ``n`` characters, with dots if there are more."""
    return F.concat(F.substring(text, 1, n), F.when(F.length(text) > n, "...").otherwise(""))


def content_id(wing: Column, room: Column, content: Column) -> Column:
    """Identifier of a drawer by what it holds."""
    return F.concat(F.lit("drawer_"), wing, F.lit("_"), room, F.lit("_"), F.substring(F.sha2(F.concat_ws(UNIT, wing, room, content).cast("binary"), 256), 1, 24))


def tunnel_id(source_wing: Column, source_room: Column, target_wing: Column, target_room: Column) -> Column:
    """Identifier of a link, the same from either end."""
    a, b = F.concat_ws("/", source_wing, source_room), F.concat_ws("/", target_wing, target_room)
    return F.substring(F.sha2(F.concat(F.least(a, b), F.lit(LINK), F.greatest(a, b)).cast("binary"), 256), 1, 16)


def token_estimate(text: Column) -> Column:
    """Tokens that a text may take: 1.3 for each word, 1 at least."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.floor((words * 13 + 5) / 10)).cast("int")


def quoted(pattern: Column) -> Column:
    """A regular expression that matches the text itself."""
    return F.concat(F.lit("\\Q"), pattern, F.lit("\\E"))
