"""Language identification by compression.

Each language has a zstandard raw-content dictionary of its own, made of a bounded sample of labelled documents. A text is cut into
blocks of `BLOCK_BYTES`; each is compressed with every dictionary, and the language whose blocks come to the least bytes is the
text's. So the whole text counts, no block is out of a dictionary's reach, and a text ten times as long has the same shares. All
languages have the same parameters (window, tables, strategy), whatever the size of their dictionaries. Case, digits and punctuation
are left out on both sides. The score is the share that the least saves against the second.

Bounds, of the fit only: `SAMPLE_ROWS` documents a language, drawn by hash, `SAMPLE_CHARS` characters of each, `DICTIONARY_BYTES` of
those together, and dictionaries of one size: that of the smallest, or `LEAST_BYTES` if that is more. More than `LANGUAGES` labels are
refused, as a text's cost grows with them.

Defined results: `und`, score 0 and rejected for null or empty texts and those without a letter, and for all texts when no row is
labelled; equal sizes go to the language that is first in order and are rejected, at any length. A text is rejected too if the least
is less than `MARGIN` of the second below it; where that is under a byte, any byte will do. Repeated rows and null ids each give a
row; a null id is neither held out nor learned from. Only doc_id, text and lang are read, and lang only to learn.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .rows import KEY, decided, kind, named
from .tokens import raw
from .words import slices

SAMPLE_ROWS = 256
SAMPLE_CHARS = 2048
DICTIONARY_BYTES = 1 << 18
LEAST_BYTES = 1 << 15
BLOCK_BYTES = 1 << 14
LANGUAGES = 256
LEVEL = 9
MARGIN = 0.002
UNKNOWN = "und"
FOLDS = 5

_OTHER = re.compile(r"[\W\d_]+").sub


def plain(text: str) -> str:
    """Letters in lower case, and one blank for whatever stands between them."""
    return _OTHER(" ", text.lower())


def fold(docs: DataFrame):
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """What each language's sample holds, all of one size; the sample is all that reaches the driver.

    Rows are drawn by hash, twice as many as wanted by the language's count, before the first of them are ranked: what is ranked
    does not grow with the table.
    """
    labelled = (docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
                .filter(F.col("lang").isNotNull() & (fold(docs) != 0)))
    counts = {r["lang"]: r["rows"] for r in
              labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).limit(LANGUAGES + 1).collect()}
    if not counts:
        return {}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    rows = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])[F.col("lang")]
    drawn = (labelled.withColumn("hash", F.xxhash64("doc_id", "text"))
             .filter((F.pmod("hash", F.lit(1 << 40)) / float(1 << 40)) * rows <= 2 * SAMPLE_ROWS)
             .filter(F.col("text").rlike(r"\p{L}"))
             .select("lang", "hash", "doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")))
    first = Window.partitionBy("lang").orderBy("hash", "doc_id")
    sample = (drawn.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= SAMPLE_ROWS)
              .select("lang", "place", "text").collect())
    texts: dict[str, list[str]] = {}
    for row in sorted(sample, key=lambda r: (r["lang"], r["place"])):
        texts.setdefault(row["lang"], []).append(plain(row["text"]))
    joined = {lang: " ".join(t).encode("utf-8", "replace")[:DICTIONARY_BYTES] for lang, t in texts.items()}
    size = max(LEAST_BYTES, min(map(len, joined.values()), default=0))
    return {lang: content[:size] for lang, content in joined.items()}


def _compressors(learned: dict[str, bytes]):
    import zstandard
    # Of the largest dictionary and a block: left to the library, these follow from each dictionary's own size.
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=DICTIONARY_BYTES + BLOCK_BYTES, write_content_size=False,
                                                            write_dict_id=False)
    made = []
    for lang in sorted(learned):
        content = zstandard.ZstdCompressionDict(learned[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=params)
        made.append((lang, zstandard.ZstdCompressor(dict_data=content, compression_params=params)))
    return made


def _told(text: bytes, compressors) -> tuple[str, float, bool]:
    """(language, score, rejected) of one text."""
    letters = plain(text.decode("utf-8", "replace"))
    if not compressors or not any(map(str.isalpha, letters)):
        return UNKNOWN, 0.0, True
    letters = letters.encode("utf-8", "replace")
    blocks = [letters[i: i + BLOCK_BYTES] for i in range(0, len(letters), BLOCK_BYTES)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in compressors)
    if len(sizes) == 1:
        return sizes[0][1], 1.0, False
    (best, lang), (second, _) = sizes[:2]
    return lang, 1 - best / second, second - best < max(1, MARGIN * second)


def languages(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs`: doc_id, text_hash, held_out, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries(docs))
    held = F.coalesce(fold(docs) == 0, F.lit(False))

    def tell(batches):
        compressors = _compressors(shared.value)
        for batch in batches:
            for part in slices(batch):
                told = [_told(t, compressors) for t in raw(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array([x[0] for x in told], pa.string()),
                     pa.array([x[1] for x in told], pa.float64()), pa.array([x[2] for x in told], pa.bool_())],
                    [*KEY, "lang_pred", "score", "rejected"])

    rows = named(docs).mapInArrow(tell, f"doc_id {kind(docs)}, text_hash long, lang_pred string, score double, rejected boolean")
    return rows.select(*KEY, held.alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose language can be told, as they are."""
    rejected = languages(docs).filter("rejected").select(*KEY).distinct().withColumn("unclear", F.lit(True))
    return decided(docs, rejected).filter("unclear is null").select("row.*")
