import zlib

from tessera.llm import op1
from pyspark.sql import functions as F

from tessera.llm.language import LanguageModel, classify, identify, judged, letters, train

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op1.op1_language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in test) / len(test) > 0.97
    assert sum(r.rejected for r in got) < 0.02 * len(got)


def test_an_unlearned_language_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for lang in ("de", "en", "fr", "es"):
        model = train(docs.filter(~op1.held_out() & (F.col("lang") != lang)).select("doc_id", "text", "lang"))
        got = identify(docs.filter(F.col("lang") == lang).select("doc_id", "text"), model)
        assert lang not in model.languages
        assert got.filter("rejected").count() > 0.85 * got.count()


def test_edges(spark):
    docs = spark.createDataFrame([(1, "der die das und nicht", "de"), (2, "the and of with", "en"), (2, "the and of with", "en"), (3, None, "en"), (4, "12 34 !!", "en"), (5, "the", None), (6, "", None)], "doc_id long, text string, lang string")
    docs = docs.selectExpr("*", "'x' as score", "1 as extra")
    model = train(docs)
    assert model.languages == ("en", "de")
    got = identify(docs, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["de", "en", "en", "und", "und", "en", "und"]
    assert got[3].score == 0.0 and got[3].rejected and got[0].extra == 1
    assert identify(docs.limit(0), model).count() == 0
    none = train(docs.limit(0))
    assert none.languages == () and {r.lang_pred for r in identify(docs, none).collect()} == {"und"}


def test_ties_long_texts_and_margin(spark):
    same = LanguageModel(("b", "a"), (b"abc def " * 50, b"abc def " * 50))
    assert classify(same, "abc def")[0] == "b"
    assert classify(same, "abc def " * 2000)[3] and classify(same, "abc")[3]
    model = LanguageModel(("en", "de"), (b"the quick brown fox jumps over the lazy dog " * 20, "der schnelle braune fuchs springt über den faulen hund ".encode() * 20))
    lang, score, margin, rejected = classify(model, "the lazy fox jumps over the brown dog " * 30_000)
    assert lang == "en" and score > 0.9 and margin > 0.1 and not rejected


def test_letters(spark):
    rows = spark.createDataFrame([("Ab1c--É!",), (None,)], "t string").select(letters(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["ab c é", ""]


def test_sizes_match_plain_zstandard(spark):
    import zstandard as z

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = op1.model_of(docs)
    made = []
    for content in model.dictionaries:
        params = z.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=3, strategy=z.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        made.append(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params))
    texts = {r.doc_id: r.t.encode() for r in docs.select("doc_id", letters(F.col("text")).alias("t")).collect()}
    for r in identify(docs, model).collect():
        data = texts[r.doc_id]
        total = [sum(len(c.compress(data[i : i + 512])) for i in range(0, len(data), 512)) for c in made]
        if not data:
            assert r.lang_pred == "und" and r.rejected
            continue
        best, second = sorted(total)[:2]
        assert r.lang_pred == model.languages[total.index(best)] and r.rejected == (second == best or second - best < 0.03 * best)


def test_dictionaries_hold_frequent_words_of_whole_texts(spark):
    rows = [(i, "start " * 300 + "endword " * 400 + "rare" + "x" * 60, "en") for i in range(3)] + [(9, None, "en"), (None, "solo", "xx")]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dict_bytes=64)
    assert model.languages == ("en", "xx") and model.dictionaries[0].endswith(b" start endword ") and len(model.dictionaries[0]) <= 65
    assert b"x" * 12 in model.dictionaries[0] and model.dictionaries[1] == b" solo "


def test_null_ids_and_clashing_names(spark):
    docs = spark.createDataFrame([(None, "the and of with", "en", 7.5, True, "a")], "doc_id long, text string, lang string, score double, rejected boolean, found string")
    assert docs.select(op1.held_out()).first()[0] is False
    got = judged(docs, train(docs), "verdict").first()
    assert (got.score, got.rejected, got.found) == (7.5, True, "a") and got.verdict.lang_pred == "en"
    assert identify(docs, train(docs)).first().found == "a"
