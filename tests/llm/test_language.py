"""Language identification at all lengths, and against a loop of its own over the same dictionaries."""
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import language


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")


def test_long_texts_keep_their_language(spark, labelled):
    rng = random.Random(3)
    words = {}
    for r in labelled.filter("lang is not null").collect():
        words.setdefault(r["lang"], []).extend(r["text"].split())
    rows = [(-1 - i, " ".join(rng.choice(w) for _ in range(n)), lang)
            for i, (lang, n, w) in enumerate((lang, n, w) for lang, w in words.items() for n in (200, 20_000, 200_000))]
    # Scripts that were not learned, short and long, are told by no dictionary.
    other = ["Съешь же ещё этих мягких французских булок, да выпей чаю. ", "敏捷的棕色狐狸跳过懒狗。这是一个测试。"]
    rows += [(-100 - i, text * n, "none") for i, (text, n) in enumerate((t, n) for t in other for n in (1, 3000))]
    made = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    both = labelled.withColumn("kind", F.lit(None).cast("string")).unionByName(made.withColumn("lang", F.lit(None).cast("string")))
    got = {r["doc_id"]: r for r in language.languages(both).filter("doc_id < 0").collect()}
    for doc_id, text, kind in rows:
        r = got[doc_id]
        assert r["rejected"] if kind == "none" else (r["lang_pred"], r["rejected"]) == (kind, False), (doc_id, kind, len(text), r)
        assert kind == "none" or r["score"] > 0.05


def test_languages_against_a_loop(spark, labelled):
    import zstandard
    learned = language.dictionaries(labelled)
    assert len({len(d) for d in learned.values()}) == 1
    params = zstandard.ZstdCompressionParameters.from_level(9, source_size=(1 << 18) + (1 << 14), write_content_size=False, write_dict_id=False)

    def size(text, lang):
        left, total = text, 0
        while left:
            block, left = left[:1 << 14], left[1 << 14:]
            given = zstandard.ZstdCompressionDict(learned[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            total += len(zstandard.ZstdCompressor(dict_data=given, compression_params=params).compress(block))
        return total

    rows = labelled.filter("doc_id % 20 = 0").collect()
    got = {r["doc_id"]: r for r in language.languages(labelled).collect()}
    for r in rows:
        letters = " ".join(w for w in "".join(c if c.isalpha() else " " for c in r["text"].lower()).split(" ") if w)
        text = language.plain(r["text"]).encode()
        assert text.decode().split() == letters.split()
        sizes = {lang: size(text, lang) for lang in learned}
        least = min(sizes.values())
        assert sizes[got[r["doc_id"]]["lang_pred"]] <= least * 1.002 + 1


def test_too_many_languages_are_refused(spark):
    rows = spark.range(2000).selectExpr("id as doc_id", "'some text' as text", "concat('l', id) as lang")
    with pytest.raises(ValueError):
        language.languages(rows)
