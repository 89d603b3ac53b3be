"""Line dedup: a suffix array over the documents' line sequences by prefix doubling.

Blank lines aside, a document is a sequence of lines. Equal lines get one name, the place of their first copy; names of runs of 2h
lines follow from the pairs of names of h lines at i and i + h, grouped again. Only lines that occur twice or more go into the
doubling; a run that is unique loses its name and takes no part from there on. Places of one name are an interval of the suffix
array in which the longest common prefix is h lines or more, and two overlapping names make a name of any length between.

A repeated run counts from `least_words` words on: what white space parts, and in scripts that set none between words two letters more
count as a word. Each place looks at the shortest run of that size that begins there, and the
shortest that ends there; if the same run occurs at an earlier place (by doc_id, then by line), its lines are deleted. The union of
those is exactly the maximal repeated runs' later copies. As every line has a word, runs of `least_words` lines are the longest that
need names, so the number of doublings does not depend on the data. The first copy of any line always stays.

Defined results: null text stays null and empty text empty; blank lines stay unless all other lines go, which leaves an empty text;
rows that repeat doc_id and text count as one document, and each gets its result; null ids come first in order; lines are compared
without the white space around them. Names are grouped before they are joined, so a line that a third of all documents hold is one
row of the table of names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.files import stored
from .rows import KEY, decided, named

LEAST_WORDS = 8
#: Letters of scripts without blanks between words, and how many of them weigh as much as a word.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
UNSPACED_A_WORD = 2


def _doc():
    return Window.partitionBy(*KEY).orderBy("at")


def sequences(docs: DataFrame, least_words: int) -> DataFrame:
    """Every line that is not blank: key, number of the line, at (its place among them), words and a 128-bit hash."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(
        i.alias("number"), F.btrim(x, F.lit(" \t\n\x0b\f\r")).alias("line")))
    lines = named(docs).select(*KEY, F.posexplode(F.filter(numbered, lambda x: x["line"] != "")).alias("at", "line"))
    spaced = F.size(F.split("line.line", r"\s+"))
    # A line of one byte a letter has none of them, and one of `least_words` words needs none.
    unspaced = F.when((F.octet_length("line.line") > F.length("line.line")) & (spaced < least_words), F.floor(
        F.regexp_count("line.line", F.lit(UNSPACED)) / UNSPACED_A_WORD).cast("int")).otherwise(0)
    return lines.select(*KEY, "at", "line.number", (spaced + unspaced).alias("words"),
                        F.xxhash64("line.line").alias("h1"), F.xxhash64("line.line", F.lit(1)).alias("h2"))


def _place() -> Column:
    return F.struct(*KEY, "at").alias("place")


def _named(rows: DataFrame, parts: list[str], name: str) -> DataFrame:
    """`rows`, written once more, with a column `name`: the first place of the class that `parts` make, null where the class has
    one place. Rows that lack a part are spread over all tasks of the join; by their nulls they would meet in one."""
    whole = " and ".join(f"{p} is not null" for p in parts)
    rows = rows.withColumn("apart", F.when(F.expr(whole), F.lit(0).cast("long")).otherwise(F.xxhash64(*KEY, "at")))
    # The classes' own `apart` is 0 as well, but as an aggregate: the optimizer would take a literal out of the join's key.
    classes = (rows.filter(whole).select(*parts, "apart", _place()).groupBy(*parts)
               .agg(F.min("place").alias(name), F.max("place").alias("last"), F.min("apart").alias("apart"))
               .filter(F.col(name) != F.col("last")).drop("last"))
    return stored(rows.join(classes, [*parts, "apart"], "left").drop("apart"))


def _ahead(column: str, n: int) -> Column:
    """The value n lines further on, if all lines between take part too."""
    return F.when(F.lead("at", n).over(_doc()) == F.col("at") + n, F.lead(column, n).over(_doc())) if n else F.col(column)


def later_copies(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """key and number of every line that belongs to a later copy of a repeated run."""
    lines = stored(sequences(docs, least_words))
    often = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    # A repeated row brings each of its lines twice: once is enough.
    active = stored(lines.join(often, ["h1", "h2"]).dropDuplicates([*KEY, "at"]))
    rows, sizes = _named(active, ["h1", "h2"], "run1").drop("h1", "h2"), [1]
    while 2 * sizes[-1] <= least_words:
        size = sizes[-1]
        beyond = stored(rows.withColumn("beyond", _ahead(f"run{size}", size)))
        rows = _named(beyond, [f"run{size}", "beyond"], f"run{2 * size}").drop("beyond")
        sizes.append(2 * size)
    # The shortest runs of enough words that begin and that end at each line.
    begin = end = F.lit(None).cast("int")
    for n in range(least_words, 0, -1):
        ahead, behind = (F.sum("words").over(_doc().rowsBetween(*r)) >= least_words for r in ((0, n - 1), (1 - n, 0)))
        begin = F.when(ahead & (_ahead("at", n - 1) == F.col("at") + (n - 1)), n).otherwise(begin)
        end = F.when(behind & (F.lag("at", n - 1).over(_doc()) == F.col("at") - (n - 1)), n).otherwise(end)
    rows = rows.withColumns({"begin": begin, "end": end})
    runs = []
    for n in range(1, least_words + 1):
        half = max(s for s in sizes if s <= n)
        wanted = (F.col("begin") == n) | (_ahead("end", n - 1) == n)
        runs.append(F.when(wanted, F.struct(F.lit(n).alias("length"), F.col(f"run{half}").alias("left"),
                                            _ahead(f"run{half}", n - half).alias("right"))))
    spelled = stored(rows.select(*KEY, "at", F.array_compact(F.array(*runs)).alias("runs"))
                     .select(*KEY, "at", F.explode("runs").alias("run")).select(*KEY, "at", "run.*"))
    found = (_named(spelled, ["length", "left", "right"], "first")
             .filter(F.col("first").isNotNull() & (F.col("first") < F.struct(*KEY, "at"))))
    gone = (found.select(*KEY, F.explode(F.sequence("at", F.col("at") + F.col("length") - 1)).alias("at")).distinct()
            .select(F.struct(*KEY, "at").alias("place")))
    return active.withColumn("place", _place()).join(gone, "place", "left_semi").select(*KEY, "number")


def deduplicated(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every row of `docs` as `row`, with n_lines, n_deleted and the text that is left as `left_text`."""
    gone = later_copies(docs, least_words).groupBy(*KEY).agg(F.collect_list("number").alias("gone"))
    lines = F.split("row.text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    rest = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    left = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.when(rest.rlike(r"\S"), rest).otherwise(""))
    return decided(docs, gone).select(
        "row", F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"), left.alias("left_text"))
