"""Language identification by compression.

Each language has a raw-content zstandard dictionary, the most frequent words of
a bounded sample of labelled texts.  A text goes in segments through one
compressor per language; the language whose dictionary leaves the fewest bytes
wins, and a narrow margin to the second is a rejection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tessera.llm.arrow import claim, slices, small_batches
from tessera.llm.tables import unused

#: Prediction for a text that is null or has no letter.
UNDETERMINED = "und"
OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language, the most frequent language of the labels first."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    segment_bytes: int = 512
    #: Share of the best size by which the second must exceed it, a byte at least.  Of texts in a language that no
    #: dictionary knows, nine tenths and more stay below 3 %; of texts in a known one, one in two hundred does.
    min_margin: float = 0.03


def letters(text: Column) -> Column:
    """Small letters of the text with one space for each run of anything else."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))


def train(labelled: DataFrame, dict_bytes: int = 32 << 10, docs_per_language: int = 256, **settings) -> LanguageModel:
    """Fit dictionaries on ``labelled`` (doc_id, text, lang).

    The sample is bounded in rows: about ``docs_per_language`` of each language,
    those with the lowest hash of doc_id and text, with their whole texts.  A
    dictionary holds the words of the language's sample up to ``dict_bytes``
    bytes, the most frequent ones, the commonest last; runs of over 24 letters
    count in pieces.  Rows whose text or lang is null or whose text has no letter
    teach nothing; an empty table gives a model without languages.  Equal texts
    of the sample count once.  The driver holds one dictionary a language.
    """
    usable = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel((), (), **settings)
    order = sorted(counts, key=lambda k: (-counts[k], k))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, docs_per_language / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    drawn = usable.filter(draw < share[F.col("lang")]).select("lang", letters(F.col("text")).alias("t")).distinct()
    words = drawn.select("lang", F.explode(F.regexp_extract_all("t", F.lit(r"\S{1,24}"), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    common = W.partitionBy("lang").orderBy(F.desc("n"), "word")
    held = words.withColumn("bytes", F.sum(F.octet_length("word") + 1).over(common.rowsBetween(W.unboundedPreceding, 0))).filter(F.col("bytes") <= dict_bytes)
    found: dict[str, list] = {k: [] for k in order}
    for r in held.select("lang", "n", "word").collect():
        found[r["lang"]].append((r["n"], r["word"]))
    known = [k for k in order if found[k]]
    content = [(" " + "".join(f"{w} " for n, w in sorted(found[k], key=lambda x: (x[0], x[1])))).encode() for k in known]
    return LanguageModel(tuple(known), tuple(content), **settings)


_COMPRESSORS: dict[tuple, list] = {}


def _compressors(model: LanguageModel) -> list:
    import zstandard as z

    claim("language", _COMPRESSORS.clear)
    key = (model.languages, model.dictionaries)
    if key not in _COMPRESSORS:
        made = []
        for content in model.dictionaries:
            params = z.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=3, strategy=z.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
            raw = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=params)
            made.append(z.ZstdCompressor(dict_data=raw, compression_params=params))
        _COMPRESSORS.clear()
        _COMPRESSORS[key] = made
    return _COMPRESSORS[key]


def sizes(model: LanguageModel, data: bytes) -> np.ndarray:
    """Bytes that each language's dictionary leaves of a text, summed over its segments."""
    total = np.zeros(len(model.languages), np.int64)
    for at in range(0, len(data), model.segment_bytes):
        part = data[at : at + model.segment_bytes]
        total += [len(c.compress(part)) for c in _compressors(model)]
    return total


def classify(model: LanguageModel, text: str) -> tuple[str, float, float, bool]:
    """Language, score, margin and rejection of one text that ``letters`` made.

    Sizes are of the whole text.  Equal sizes go to the language with more
    labels.  The score is the share of the best language when each byte more
    halves the weight of the others; the margin is the bytes the second takes
    beyond the best, as a share of the best.  A text is rejected when the margin
    is under ``min_margin`` or no byte, whatever its length.
    """
    data = text.encode()
    if not data or not model.languages:
        return UNDETERMINED, 0.0, 0.0, True
    found = sizes(model, data)
    best = int(found.argmin())
    over = found - found[best]
    second = int(np.sort(over)[1]) if len(over) > 1 else int(found[best])
    margin = second / float(found[best])
    score = 1.0 / float(np.exp2(-np.minimum(over, 60)).sum())
    return model.languages[best], score, margin, second < 1 or margin < model.min_margin


def judged(docs: DataFrame, model: LanguageModel, name: str, text: str = "text") -> DataFrame:
    """Add one column ``name`` to ``docs``, a struct of what ``classify`` finds.

    Null, empty and letterless texts are ``und`` with score 0 and are rejected.
    Other columns, rows and repeated rows stay as they are.
    """

    small_batches(docs.sparkSession)

    @F.arrow_udf(OUT)
    def predict(texts: pa.Array) -> pa.Array:
        found = [classify(model, t) for a, b in slices(texts) for t in texts.slice(a, b - a).to_pylist()]
        kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=[f.name for f in OUT])

    return docs.withColumn(name, predict(letters(F.col(text))))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add lang_pred, score, margin and rejected to ``docs``, as ``judged`` finds them.

    Columns of these names that ``docs`` has are replaced; to keep them, use
    ``judged``.
    """
    name = unused(docs, "found")
    found = judged(docs, model, name, text)
    return found.withColumns({f.name: F.col(name)[f.name] for f in OUT}).drop(name)
