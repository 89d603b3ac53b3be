"""Spelling variants, ranked search and source mix against brute force, on small tables with odd rows."""
import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor, log

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import curriculum, ranked, variants

UPPER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def rows(spark, sf):
    """Real documents and odd ones: (doc_id, text, source)."""
    found = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect()]
    top = max(r[0] for r in found) + 1
    odd = [None, "", " \n\t ", "!?;", "Ünïcödé ça ÉTÉ été", "tie one", "tie one", "<|endoftext|> in it's text", "7 8 9", "中文 ½   x",
           "long " * 40_000, "gradient gradients gradient gradiant gradent", "Gradient GRADIENT gradients gradients gradient",
           "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaa"]
    found += [(top + i, t, None if i % 3 else "odd") for i, t in enumerate(odd)]
    return found + [(None, "a row without an id", "odd"), (None, None, None), (None, "a row without an id", "odd")] + found[:3]


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    clashing = ("row", "word", "n", "run", "size", "target", "slice", "item", "terms", "term", "tid", "rank", "score", "mark", "copy")
    return frame.withColumns({c: F.lit("x") for c in clashing})


def spelled(rows, misspelt=97):
    counts = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % misspelt == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def test_variants_of_documents(docs, rows):
    got = variants.grouped(variants.counted(docs, misspelt=97)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == grouped(spelled(rows))
    assert variants.grouped(variants.counted(docs.limit(0))).count() == 0


def test_variants_of_random_words(spark):
    """Few letters, so that words share chunks and have several edits between them; chains of forms."""
    rng = random.Random(4)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))): rng.choice([1, 2, 3, 5, 10, 10, 40, 200]) for _ in range(600)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = {tuple(sorted((r["a"], r["b"]))) for r in variants.near_pairs(frame).collect()}
    assert pairs == {(a, b) for a in counts for b in counts if a < b and one_edit(a, b)}
    assert variants.near_pairs(frame).count() == len(pairs)
    assert set(map(tuple, variants.grouped(frame).collect())) == grouped(counts)
    with pytest.raises(ValueError):
        variants.grouped(frame, ratio=1)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def ranking(rows, items, best=10):
    held = [(doc_id, Counter(terms(text))) for doc_id, text, _ in rows]
    held = [(doc_id, c) for doc_id, c in held if c]
    n, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item_id, text in items:
        scores = []
        for doc_id, c in held:
            m = 10 + 90 * sum(c.values()) * n // words
            s = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) & c.keys())
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        for rank, (s, unnamed, doc_id) in enumerate(sorted(scores)[:best], 1):
            out[item_id, rank, None if unnamed else doc_id, -s] += 1
    return out


def test_ranked_search(spark, sf, docs, rows, monkeypatch):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(12).collect()]
    rare = [t for t, n in Counter(t for r in rows for t in set(terms(r[1]))).items() if n == 1]
    items += [(900, None), (901, "... !"), (902, "nowhere-to-be-found"), (903, "tie one tie"), (None, "row without an id"), (903, "7 8"),
              (904, "gradient " * 500 + "the"), (905, " ".join(rare[:40])), (906, " ".join(r[1] or "" for r in rows[:30]))]
    queries = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "n": F.lit("x"), "row": F.lit(2)})
    want = ranking(rows, items)
    got = lambda: Counter(map(tuple, ranked.search(docs, queries).select("item_id", "rank", "doc_id", "score").collect()))
    assert got() == want
    # All pairs listed, and next to no champions: other bounds, the same answers.
    monkeypatch.setattr(ranked, "PAIR_SHARE", 1.0)
    assert got() == want
    monkeypatch.setattr(ranked, "CHAMPIONS", 1)
    assert got() == want
    assert ranked.search(docs, queries.limit(0)).count() == 0 and ranked.search(docs.limit(0), queries).count() == 0


def test_pair_bounds_skip_more_than_single_ones(spark):
    """Two terms that never meet in a document: together they cannot add more than the greater, so neither is essential."""
    wanted = spark.createDataFrame([(0, 1, 5, 60), (0, 2, 5, 70), (0, 3, 5, 500)], "item long, tid long, df long, most long")
    postings = spark.createDataFrame([(1, 1, 60), (2, 2, 70), (3, 3, 500), (4, 1, 10), (4, 2, 20)], "row long, tid long, impact long")
    thresholds = spark.createDataFrame([(0, 160)], "item long, threshold long")
    told = lambda df: {r["tid"]: (r["essential"], r["last"], r["need"]) for r in ranked.plan(wanted, thresholds, postings, df).collect()}
    assert told(100) == {1: (False, True, 90), 2: (False, True, 90), 3: (True, False, 90)}
    assert told(0) == {1: (False, True, 100), 2: (False, False, 100), 3: (True, False, 100)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Fill and share again, by definition."""
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    out, rest, open_ = {}, share * sum(sizes.values()), set(sources)
    while open_:
        total = sum(weigh[s] for s in open_)
        full = {s for s in open_ if rest * weigh[s] / total >= most * sizes[s]}
        if not full:
            return out | {s: rest * weigh[s] / total for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
        rest, open_ = rest - sum(out[s] for s in full), open_ - full
    return out


def test_source_mix(docs, rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(words(text))
    want = targets(sizes)
    source_of = {(r[0], len(words(r[1]))): r[2] for r in rows}
    got = curriculum.shares(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    taken = defaultdict(int)
    for r in got:
        source = source_of[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(want[source])
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["taken"] == 0) == (r["first_position"] is None)
        taken[source] += r["taken"]
    assert {s: taken[s] for s in sizes} == {s: floor(want[s] + 1e-9) for s in sizes}
    assert Counter(map(tuple, got)) == Counter(map(tuple, curriculum.shares(docs.repartition(7)).collect()))


def test_positions_follow_the_schedules(spark):
    """At every time each source has given what its schedule's integral asks for, to within a document."""
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), "abc"[rng.randrange(3)]) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = curriculum.sized(frame)
    sources, copies = curriculum.placed(sized)
    goal = {r["source"]: (r["turn"], floor(r["target"])) for r in sources.collect()}
    source = {r["row"]: r["source"] for r in sized.collect()}
    placed = sorted((r["position"], r["words"], source[r["row"]], r["starts_at"]) for r in copies.collect())
    assert sorted(p[3] for p in placed) == [p[3] for p in placed] and placed[0][3] == 0

    def integral(knots, upto):
        parts = [(min(b, upto) - a, ra, ra + (rb - ra) * (min(b, upto) - a) / (b - a)) for (a, ra), (b, rb) in zip(knots, knots[1:]) if a < upto]
        return sum(w * (x + y) / 2 for w, x, y in parts)

    for time in (0.1, 0.35, 0.5, 0.8, 1.0):
        for name, (turn, words_) in goal.items():
            knots = curriculum.SCHEDULES[turn]
            given = sum(w for at, w, s, _ in placed if s == name and at <= time)
            assert abs(given - words_ * integral(knots, time) / integral(knots, 1)) <= 40


def test_the_stream_is_sorted_and_cut_at_the_target(spark):
    frame = spark.createDataFrame([(1, "a b  c d e f", "x"), (2, None, "x"), (3, "g h\ti", "y"), (4, "k", None)], "doc_id long, text string, source string")
    frame = frame.withColumns({"words": F.lit(0), "position": F.lit("p"), "whole": F.lit(1), "doc": F.lit(2)})
    got = curriculum.mixed(frame).collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    assert all(len(words(r["text"])) == r["words"] and (r["doc"]["text"]).startswith(r["text"]) for r in got)
    assert sum(r["words"] for r in got) == sum(floor(15 * w / 8) for w in (5, 2, 1)) and {r["doc"]["whole"] for r in got} == {1}
    assert curriculum.mixed(frame.limit(0)).count() == 0 and curriculum.shares(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        curriculum.shares(frame, share=3)
    assert all(r["taken"] == 2 * r["size"] for r in curriculum.shares(frame, share=2).collect())
