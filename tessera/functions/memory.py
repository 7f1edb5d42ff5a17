"""Memory types of text segments, by markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.text import trimmed
from tessera.operators.chunk import lines_of

#: The markers of each type, in the order in which types are tried.
MARKERS = {
    "decision": (
        r"\blet'?s (use|go with|try|pick|choose|switch to)\b", r"\bwe (should|decided|chose|went with|picked|settled on)\b", r"\bi'?m going (to|with)\b",
        r"\bbetter (to|than|approach|option|choice)\b", r"\binstead of\b", r"\brather than\b", r"\bthe reason (is|was|being)\b", r"\bbecause\b", r"\btrade-?off\b",
        r"\bpros and cons\b", r"\bover\b.*\bbecause\b", r"\barchitecture\b", r"\bapproach\b", r"\bstrategy\b", r"\bpattern\b", r"\bstack\b", r"\bframework\b",
        r"\binfrastructure\b", r"\bset (it |this )?to\b", r"\bconfigure\b", r"\bdefault\b",
    ),
    "preference": (
        r"\bi prefer\b", r"\balways use\b", r"\bnever use\b", r"\bdon'?t (ever |like to )?(use|do|mock|stub|import)\b", r"\bi like (to|when|how)\b",
        r"\bi hate (when|how|it when)\b", r"\bplease (always|never|don'?t)\b", r"\bmy (rule|preference|style|convention) is\b", r"\bwe (always|never)\b",
        r"\bfunctional\b.*\bstyle\b", r"\bimperative\b", r"\bsnake_?case\b", r"\bcamel_?case\b", r"\btabs\b.*\bspaces\b", r"\bspaces\b.*\btabs\b", r"\buse\b.*\binstead of\b",
    ),
    "milestone": (
        r"\bit works\b", r"\bit worked\b", r"\bgot it working\b", r"\bfixed\b", r"\bsolved\b", r"\bbreakthrough\b", r"\bfigured (it )?out\b", r"\bnailed it\b",
        r"\bcracked (it|the)\b", r"\bfinally\b", r"\bfirst time\b", r"\bfirst ever\b", r"\bnever (done|been|had) before\b", r"\bdiscovered\b", r"\brealized\b",
        r"\bfound (out|that)\b", r"\bturns out\b", r"\bthe key (is|was|insight)\b", r"\bthe trick (is|was)\b", r"\bnow i (understand|see|get it)\b", r"\bbuilt\b",
        r"\bcreated\b", r"\bimplemented\b", r"\bshipped\b", r"\blaunched\b", r"\bdeployed\b", r"\breleased\b", r"\bprototype\b", r"\bproof of concept\b", r"\bdemo\b",
        r"\bversion \d", r"\bv\d+\.\d+", r"\d+x (compression|faster|slower|better|improvement|reduction)", r"\d+% (reduction|improvement|faster|better|smaller)",
    ),
    "problem": (
        r"\b(bug|error|crash|fail|broke|broken|issue|problem)\b", r"\bdoesn'?t work\b", r"\bnot working\b", r"\bwon'?t\b.*\bwork\b",
        r"\bkeeps? (failing|crashing|breaking|erroring)\b", r"\broot cause\b", r"\bthe (problem|issue|bug) (is|was)\b", r"\bturns out\b.*\b(was|because|due to)\b",
        r"\bthe fix (is|was)\b", r"\bworkaround\b", r"\bthat'?s why\b", r"\bthe reason it\b", r"\bfixed (it |the |by )\b", r"\bsolution (is|was)\b", r"\bresolved\b",
        r"\bpatched\b", r"\bthe answer (is|was)\b", r"\b(had|need) to\b.*\binstead\b",
    ),
    "emotional": (
        r"\blove\b", r"\bscared\b", r"\bafraid\b", r"\bproud\b", r"\bhurt\b", r"\bhappy\b", r"\bsad\b", r"\bcry\b", r"\bcrying\b", r"\bmiss\b", r"\bsorry\b",
        r"\bgrateful\b", r"\bangry\b", r"\bworried\b", r"\blonely\b", r"\bbeautiful\b", r"\bamazing\b", r"\bwonderful\b", r"i feel", r"i'm scared", r"i love you",
        r"i'm sorry", r"i can't", r"i wish", r"i miss", r"i need", r"never told anyone", r"nobody knows", r"\*[^*]+\*",
    ),
}
#: Words of moods, phrases of resolution, lines of code and of turns.
POSITIVE = "pride proud joy happy love loving beautiful amazing wonderful incredible fantastic brilliant perfect excited thrilled grateful warm breakthrough success works working solved fixed nailed heart hug precious adore".split()
NEGATIVE = "bug error crash crashing crashed fail failed failing failure broken broke".split()
RESOLUTION = (r"\bfixed\b", r"\bsolved\b", r"\bresolved\b", r"\bpatched\b", r"\bgot it working\b", r"\bit works\b", r"\bnailed it\b", r"\bfigured (it )?out\b", r"\bthe (fix|answer|solution)\b")
CODE_LINE = (
    r"^\s*[\$#]\s", r"^\s*(cd|source|echo|export|pip|npm|git|python|bash|curl|wget|mkdir|rm|cp|mv|ls|cat|grep|find|chmod|sudo|brew|docker)\s", r"^\s*```",
    r"^\s*(import|from|def|class|function|const|let|var|return)\s", r"^\s*[A-Z_]{2,}=", r"^\s*\|", r"^\s*[-]{2,}", r"^\s*[\{\}\[\]]\s*$",
    r"^\s*(if|for|while|try|except|elif|else)\b:", r"^\s*\w+\.\w+\(", r"^\s*\w+ = \w+\.\w+",
)
TURNS = (r"^>\s", r"(?i)^(Human|User|Q)\s*:", r"(?i)^(Assistant|AI|A|Claude|ChatGPT)\s*:")


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def prose(text: Column) -> Column:
    """A text without fenced code and lines like code, or as it is if nothing is left."""
    def step(acc: Column, line: Column) -> Column:
        s = trimmed(line)
        fence = F.startswith(s, F.lit("```"))
        keep = ~fence & ~acc["code"] & (s != "") & ~_any(s, CODE_LINE)
        return F.struct((acc["code"] != fence).alias("code"), F.concat(acc["rows"], F.when(keep, F.array(line)).otherwise(F.array().cast("array<string>"))).alias("rows"))

    start = F.struct(F.lit(False).alias("code"), F.array().cast("array<string>").alias("rows"))
    out = F.aggregate(lines_of(text), start, step, lambda a: trimmed(F.array_join(a["rows"], "\n")))
    return F.when(out == "", text).otherwise(out)


def segments(text: Column) -> Column:
    """Turns if three lines or more begin one, else paragraphs, else groups of 25 lines."""
    lines = lines_of(text)
    turn = lambda line: _any(trimmed(line), TURNS)
    empty = F.array().cast("array<string>")

    def step(acc: Column, line: Column) -> Column:
        new = turn(line) & (F.size(acc["now"]) > 0)
        return F.struct(F.when(new, F.concat(acc["done"], F.array(F.array_join(acc["now"], "\n")))).otherwise(acc["done"]).alias("done"), F.when(new, F.array(line)).otherwise(F.concat(acc["now"], F.array(line))).alias("now"))

    turns = F.aggregate(lines, F.struct(empty.alias("done"), empty.alias("now")), step, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(F.array_join(a["now"], "\n")))).otherwise(a["done"]))
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), trimmed), lambda p: p != "")
    groups = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(lines) - 1) / 25).cast("int"))), lambda g: F.array_join(F.slice(lines, g * 25 + 1, 25), "\n")), lambda g: trimmed(g) != "")
    return F.when(F.size(F.filter(lines, turn)) >= 3, turns).when((F.size(paragraphs) <= 1) & (F.size(lines) > 20), groups).otherwise(paragraphs)


def classified(segments_: DataFrame, segment: str = "segment") -> DataFrame:
    """Add ``kind`` and ``confidence`` to segments; short ones and those without a marker go.

    The type with most marker hits wins, the last on ties; long segments gain up
    to 2.  A problem with a resolution or a good mood becomes a milestone or an
    emotional memory.  The prose is a column of its own, so it is made once.
    """
    seg = F.col(segment)
    rows = segments_.filter(F.octet_length(trimmed(seg)) >= 20).withColumn("_low", F.lower(prose(seg)))
    low = F.col("_low")
    rows = rows.withColumns({f"_{k}": sum((F.regexp_count(low, F.lit(p)) for p in ps), F.lit(0)) for k, ps in MARKERS.items()})
    best = F.array_max(F.array(*[F.struct(F.col(f"_{k}").alias("score"), F.lit(i).alias("at"), F.lit(k).alias("kind")) for i, k in enumerate(MARKERS)]))
    words = F.array_distinct(F.split(low, r"[^\p{L}\p{N}]+"))
    hits = lambda ws: F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in ws])))
    rows = rows.withColumns({"_best": best, "_good": hits(POSITIVE) > hits(NEGATIVE), "_done": _any(low, RESOLUTION)}).filter("_best.score > 0")
    bonus = F.when(F.octet_length(seg) > 500, 2).when(F.octet_length(seg) > 200, 1).otherwise(0)
    good, moved, felt = F.col("_good"), F.col("_milestone") > 0, F.col("_emotional") > 0
    solved = F.when(F.col("_done"), F.when(felt & good, "emotional").otherwise("milestone")).when(good & moved, "milestone").when(good & felt, "emotional").otherwise("problem")
    kind = F.when(F.col("_best.kind") == "problem", solved).otherwise(F.col("_best.kind"))
    return rows.select(*segments_.columns, kind.alias("kind"), F.least(F.lit(1.0), (F.col("_best.score") + bonus) / 5.0).alias("confidence"))
