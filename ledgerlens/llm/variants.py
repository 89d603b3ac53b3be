"""Spelling variant grouping by asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced character turns one into the other. The shorter word of a pair (the lesser
of two of one length) is the chunk word: it gives two disjoint chunks, its first and its last half. The other gives positional
grams of the chunk's length. One edit leaves one of the two chunks whole, and moves it by one place at most: the first stands at
place 0 or else the last is whole too, the last stands where both words end. So grams are made at those places only, which is the
join within shift one with its other rows left out. A chunk alone is shared by too many words (a common prefix is a hot key), so
the rest of the word is chunked once more by the same argument: the key of a row is the whole chunk and the whole half of the
rest, three quarters of the word. Pairs that meet are verified inside the join, under the first key they share only, so that no
unverified pair leaves it and none leaves it twice. All joins merge sorted rows: a word's eight rows and their keys are many times
the table that they come from, by whose size Spark would broadcast them through the driver.

A word's form is its near word of largest count, if that is `RATIO` times its own; counts grow along forms, so that following them
ends, and roots are found by pointer doubling in a number of rounds that the logarithm of the largest chain bounds.

Defined results: null and empty texts have no words; a word that is near to none is its own root with a null form; equal counts
go to the word that is first in code-point order; repeated rows count again; only the columns asked for are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.files import stored

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH = 5
LEAST_COUNT = 3
RATIO = 2


def counted(docs: DataFrame, misspelt: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
            id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """word, n: runs of Latin letters of `least_length` characters or more, A-Z lower-cased, that occur `least_count` times.

    `misspelt` plants slips to be found again: where it divides h, the crc32 of `<id>:<run>` (a null id is empty), the run loses its
    character h % length. Runs are counted before the shuffle, so a word that all documents hold arrives once a task.
    """
    run, size = F.col("run"), F.length("run")
    runs = (docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"),
                        F.translate(F.col(text_column).cast("string"), UPPER, LOWER).alias("lower"))
            .select("id", F.explode(F.regexp_extract_all("lower", F.lit(RUN), F.lit(0))).alias("run"))
            .filter(size >= least_length))
    if misspelt is not None:
        h = F.crc32(F.concat("id", F.lit(":"), run).cast("binary"))
        at = (h % size).cast("int")
        lost = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, size))
        runs = runs.select(F.when(h % misspelt == 0, lost).otherwise(run).alias("run")).filter(size >= least_length)
    return runs.groupBy(run.alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _keys(word: str, size: Column, of: Column) -> Column:
    """The four keys of `word` for a chunk word of `of` characters: what stands before and after the quarter with the edit."""
    size, of, half = size.cast("int"), of.cast("int"), (of.cast("int") / 2).cast("int")
    quarter = ((of - half) / 2).cast("int")
    first = lambda n: F.substring(word, F.lit(1), n)
    last = lambda n: F.substring(word, size - n + 1, n)
    none = F.lit("")
    keys = [(first(half + quarter), none), (first(half), last(of - half - quarter)),
            (first(quarter), last(half)), (none, last(of - quarter))]
    return F.array(*[F.struct(F.lit(i).alias("which"), a.alias("head"), b.alias("tail")) for i, (a, b) in enumerate(keys)])


def near_pairs(counts: DataFrame) -> DataFrame:
    """Each pair of near words once, as a, a_n, b, b_n; `counts` holds each word once, with its n."""
    size = F.length("word")
    words = counts.select("word", "n", size.alias("size")).filter(size > 0)

    def keyed(name: str, of: Column) -> DataFrame:
        """Four rows for each word and each length in `of` that its chunk word may have."""
        longs = words.select("*", F.explode(of).alias("of")).filter("of > 0")
        return (longs.select("*", F.explode(_keys("word", F.col("size"), F.col("of"))).alias("key"))
                .select("of", "key.*", F.col("word").alias(name), F.col("n").alias(f"{name}_n"), F.col("size").alias(f"{name}_size")))

    c, g = keyed("a", F.array("size")).alias("c"), keyed("b", F.array(F.col("size"), F.col("size") - 1)).alias("g")
    a, b = (_keys(w, F.col(f"{w}_size"), F.col("c.of")) for w in ("a", "b"))
    # A pair may share several keys: it is told under the first.
    earlier = F.lit(False)
    for i in range(3):
        earlier = earlier | ((F.col("c.which") > i) & (a[i]["head"] == b[i]["head"]) & (a[i]["tail"] == b[i]["tail"]))
    once = (F.col("b_size") > F.col("a_size")) | (F.col("a") < F.col("b"))
    near = F.levenshtein("a", "b", 1) == 1
    together = once & near & ~earlier
    for k in ("of", "which", "head", "tail"):
        together = (F.col(f"c.{k}") == F.col(f"g.{k}")) & together
    return c.join(g.hint("merge"), together).select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for every row of `forms` (word, form): the last word that following forms leads to. Forms must not turn back."""
    jumps = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumps = stored(jumps.join(ahead.hint("merge"), "root", "left")
                       .select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if jumps.filter("moved").isEmpty():
            return jumps.select("word", "root")
        jumps = jumps.drop("moved")


def grouped(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of `counts` (word, n), which holds each word once. `ratio` is over 1."""
    if ratio <= 1:
        raise ValueError("forms must be more frequent than their variants")
    counts = stored(counts)
    pairs = near_pairs(counts).select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("p")).select("p.*")
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    formed = stored(counts.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
