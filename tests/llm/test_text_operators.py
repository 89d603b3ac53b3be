"""The text operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import language, leaks, lines, nearcopies, neighbours, notices, packing, suffixes, tokens, wrappers
from ledgerlens.llm.queries import ORACLE, QUERIES, vocabulary

FIND = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def words(text):
    return FIND("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def texts(spark, sf):
    """Real documents and odd ones: (doc_id, text, lang)."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    top = max(r[0] for r in rows) + 1
    shared = " ".join(f"passage{i}" for i in range(60))
    odd = [None, "", " \n\t ", "!?;", "Ünïcödé ça été", "cc by cc by, CC-BY all rights reserved", "a\n\nb\n", "tie", "tie",
           f"before it {shared} after", f"{shared} other words", "<|endoftext|> in it's text", "7 8 9", "中文 ½",
           "long " * 30_000]
    rows += [(top + i, t, None if i % 2 else "en") for i, t in enumerate(odd)]
    return rows + [(None, "a row without an id", "en"), (None, None, None)] + rows[:3]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With columns whose names the operators use for their own ends."""
    frame = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3)
    clashing = ("text_hash", "row", "start", "stop", "at", "label", "node", "bands", "piece", "gone", "keeps", "hits", "n_words")
    return frame.withColumns({c: F.lit("x") for c in clashing})


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def same_rows(got, want):
    assert Counter(got) == Counter(want)


def test_repeats(docs, texts, nothing):
    at = defaultdict(list)
    for doc_id, text in {(r[0], r[1]) for r in texts}:
        w = words(text)
        for i in range(len(w) - 49):
            at[tuple(w[i:i + 50])].append((doc_id is not None, doc_id or 0, i))
    everywhere, later = defaultdict(set), defaultdict(set)
    twice = {r for r, n in Counter((r[0], r[1]) for r in texts).items() if n > 1}
    again = {r[0] for r in twice}
    for places in at.values():
        for known, doc_id, i in places:
            if len(places) > 1 or doc_id in again:
                everywhere[doc_id if known else None].update(range(i, i + 50))
            if (known, doc_id, i) != min(places):
                later[doc_id if known else None].update(range(i, i + 50))
    found = defaultdict(set), defaultdict(set)
    for r in suffixes.repeated(docs).collect():
        found[r["later"]][r["doc_id"]].update(range(r["start"], r["stop"]))
    assert found[0] == everywhere and found[1] == later and len(later) > 5
    assert suffixes.repeated(nothing).count() == 0


def deleted_lines(rows, least=8):
    """Lines of later copies of any run of enough words, by doc_id."""
    first, gone = {}, defaultdict(set)
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        held = [(i, x.strip()) for i, x in enumerate((text or "").split("\n")) if x.strip()]
        for a in range(len(held)):
            for b in range(a, min(len(held), a + 40)):
                run = tuple(x for _, x in held[a:b + 1])
                if sum(len(x.split()) for x in run) >= least and first.setdefault(run, (doc_id, a)) != (doc_id, a):
                    gone[doc_id].update(i for i, _ in held[a:b + 1])
    return gone


def test_lines(spark, docs, texts, nothing):
    rng = random.Random(4)
    bag = ["a b", "c", "d e f g", "x y z w v u t s", "a line of more than eight words is this one", "", "  ", "q"]
    small = [(i, "\n".join(rng.choice(bag) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(90, None)]
    frame = spark.createDataFrame(small, "doc_id long, text string")
    for rows, table in ((small, frame), ([(r[0], r[1]) for r in texts], docs)):
        gone = deleted_lines(set(rows))
        want = []
        for doc_id, text in rows:
            held = (text or "").split("\n")
            left = None if text is None else "\n".join(x for i, x in enumerate(held) if i not in gone[doc_id])
            if gone[doc_id] and not left.strip():
                left = ""
            want.append((doc_id, left, len(gone[doc_id]), len(held) if text is not None else 0))
        got = [(r["row"]["doc_id"], r["left_text"], r["n_deleted"], r["n_lines"]) for r in lines.deduplicated(table).collect()]
        same_rows([g for g in got if g[0] is not None], [w for w in want if w[0] is not None])
        assert len(got) == len(rows)
    assert lines.deduplicated(nothing).count() == 0


def test_neighbours(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r[0], list(r[1])) for r in table.collect()]
    width = len(rows[0][1])
    top = max(r[0] for r in rows)
    nan = [float("nan")] + [1.0] * (width - 1)
    rows += [(top + 1 + i, v) for i, v in enumerate([None, [], [0.0] * width, [None] * width, nan, [1.0, 2.0], [2.0, 1.0]])]
    rows += [(top + 100 + i, rows[0][1]) for i in range(40)] + [rows[1], (None, rows[2][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    good = {}
    for vec_id, v in rows:
        if vec_id is not None and v and None not in v and all(x == x for x in v) and any(v):
            good[vec_id] = v
    usable = neighbours.usable(frame)
    got = defaultdict(list)
    for r in neighbours.nearest(usable.filter("vec_id % 7 = 0 or vec_id > 100"), usable, block=30).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    length = {k: sum(x * x for x in v) ** 0.5 for k, v in good.items()}
    for q, v in good.items():
        if q % 7 and q <= 100:
            assert q not in got
            continue
        scored = [(sum(x * y for x, y in zip(v, w)) / length[q] / length[k], k) for k, w in good.items() if k != q and len(w) == len(v)]
        best = sorted(scored, key=lambda x: (-round(x[0], 12), x[1]))[:5]
        found = sorted(got[q])
        assert [f[1] for f in found] == [k for _, k in best] and [f[0] for f in found] == list(range(1, len(best) + 1))
        assert all(abs(f[2] - s) < 1e-12 for f, (s, _) in zip(found, best))
    empty = usable.limit(0)
    assert neighbours.nearest(empty, usable).count() == 0 and neighbours.nearest(usable.limit(3), empty).count() == 0


def encoded(texts):
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(vocabulary())
    return [e.ids for e in model.encode_batch([r[1] or "" for r in texts], add_special_tokens=False)]


def test_packing(docs, texts, nothing):
    rows = packing.packed(docs, vocabulary(), limit=20).collect()
    want = Counter()
    for (doc_id, _, _), ids in zip(texts, encoded(texts)):
        ids = ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want[doc_id, k, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= 1.05 * sum(r["length"] for r in rows) / 4096 + 2
    assert packing.packed(nothing, vocabulary()).count() == 0


def test_best_fit_closes_the_fullest():
    bins = packing.Bins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert [bins.place(n) for n in (5, 6, 9, 5)] == [(2, 0), (3, 0), (4, 0), (2, 5)]  # 3 was fuller than 2 and closed for 4


def test_notices(docs, texts, nothing):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    want = []
    for doc_id, text, _ in texts:
        w = words(text)
        found = [(i, label) for phrase, label in phrases.items() for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
        want.append((doc_id, len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None),
                     ",".join(sorted({x for _, x in found}))))
    rows = notices.scanned(docs).collect()
    same_rows([tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in rows], want)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)
    assert notices.scanned(nothing).count() == 0


def test_fuzzy_notices_are_those_of_the_whole_text():
    """The seeds lose no match that the pattern finds in the whole text."""
    search, rng = notices.Notices(), random.Random(3)
    for label, phrase, edits in notices.NOTICES * 6:
        changed = list(phrase)
        for _ in range(edits):
            changed[rng.randrange(2, len(changed) - 2)] = rng.choice("abcxyz")
        text = f"some words here {''.join(changed)} and more of them"
        found = [s for s in search.spans(text) if s[0] == label]
        assert found and any(s[1] <= 18 and s[2] >= len(text) - 20 for s in found)
    assert not list(search.spans("nothing of that sort is in this text"))


def test_near_copies(spark, docs, texts, nothing):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(3000)]
    base, made = [rng.choice(vocab) for _ in range(90)], []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(90)] = rng.choice(vocab)
        made.append((i, " ".join(copy)))
    made += [(200 + i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 6, 9, 60])))) for i in range(40)]
    made += [(300, "A, b"), (301, "a b"), (302, "..."), (303, None)]
    small = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    for rows, table in ((made, small), ([(r[0], r[1]) for r in texts if r[0] is not None], docs.filter("doc_id is not null"))):
        got = {r["doc_id"]: r["class_id"] for r in nearcopies.classes(table).collect()}
        assert got == near_classes(dict(rows))
    assert nearcopies.classes(nothing).count() == 0 and nearcopies.deduplicated(nothing).count() == 0
    kept = nearcopies.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    want = near_classes({r[0]: r[1] for r in texts if r[0] is not None})
    assert {k for k in ids if k is not None} == {d for d, c in want.items() if d == c} and max(v for k, v in ids.items() if k is not None) == 1


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(line[j] + 1, new[-1] + 1, line[j - 1] + (x != y)))
        line = new
    return line[-1]


def near_pairs(rows):
    """All pairs of an edit similarity of 0.8 or more, by alignment; pairs whose words alone differ by more are left out before."""
    held = {i: words(t) for i, t in rows.items() if words(t)}
    counts = {i: Counter(w) for i, w in held.items()}
    ordered = sorted(held, key=lambda i: len(held[i]))
    for k, b in enumerate(ordered):
        for a in reversed(ordered[:k]):
            most = int(0.2 * len(held[b]) + 1e-9)
            if len(held[b]) - len(held[a]) > most:
                break
            if len(held[b]) - sum((counts[a] & counts[b]).values()) <= most and \
                    (held[a] == held[b] or distance(held[a], held[b]) <= most):
                yield a, b


def near_classes(rows):
    parent = {i: i for i in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near_pairs(rows):
        parent[root(a)] = root(b)
    least = {}
    for i in sorted(rows):
        least.setdefault(root(i), i)
    return {i: least[root(i)] for i in rows}


def test_near_copies_of_the_given_documents(spark):
    """Recall by edit similarity over the whole small table, and no pair that an alignment does not bear out."""
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    pairs = list(near_pairs(rows))
    table = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in nearcopies.classes(table).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs) > 9
    want = near_classes(rows)
    assert all(want[i] == want[c] for i, c in got.items())


def test_leaks(spark, docs, texts, nothing, sf):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(900, "passage3 passage4"), (901, None), (902, "..."), (903, "été"), (904, items[0][1]), (None, "a row without an id")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("mark", F.lit(0))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(item)
    sizes, want = {len(w) for w in windows}, []
    for doc_id, text, _ in texts:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        named = sorted(str(x) for x in found if x is not None)
        want.append((doc_id, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    same_rows([tuple(r[c] for c in columns) for r in leaks.contamination(docs, bench).collect()], want)
    clean = leaks.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    same_rows([r["doc_id"] for r in clean.collect()], [w[0] for w in want if not w[-1]])
    assert leaks.contamination(nothing, bench).count() == 0
    assert not leaks.contamination(docs, bench.limit(0)).filter("contaminated").count()


def test_token_counts(docs, texts, nothing):
    want = [(r[0], len((r[1] or "").encode()), len(i), len(i) > 2048) for r, i in zip(texts, encoded(texts))]
    columns = ("doc_id", "n_bytes", "n_tokens", "over_limit")
    same_rows([tuple(r[c] for c in columns) for r in tokens.token_counts(docs, vocabulary()).collect()], want)
    assert tokens.token_counts(nothing, vocabulary()).count() == 0
    import sentencepiece
    path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    few = docs.filter("doc_id < 20 or text = ''")
    same_rows([(r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(few, path).collect()],
              [(r["doc_id"], len(model.encode(r["text"]))) for r in few.collect()])


def test_pieces_are_the_library_s():
    from tokenizers import Tokenizer
    model, lookup, rng = Tokenizer.from_file(vocabulary()), tokens.Pieces(vocabulary(), False), random.Random(5)
    parts = list("ab cT'\t\n\x0b\x1c\x85\xa0 　é́İΣςſ½²Ⅷ漢!?‍\U0001f600")
    parts += ["<|endoftext|>", "'s", "'re", "'LL", "ΑΣ ", "123", "ÄÖß"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for text, found, want in zip(made, lookup.texts([t.encode() for t in made]), model.encode_batch(made, add_special_tokens=False)):
        assert b"".join(found) == b"".join(i.to_bytes(4, "little") for i in want.ids), text


def test_languages(spark, docs, texts, nothing):
    rows = language.languages(docs).collect()
    assert len(rows) == len(texts)
    langs = {r[2] for r in texts if r[2]}
    text_of = {r[0]: r for r in texts if r[0] is not None}
    right = held = 0
    for r in rows:
        if r["doc_id"] is None:
            assert not r["held_out"]
            continue
        text, lang = text_of[r["doc_id"]][1:]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")) and r["lang_pred"] in langs | {"und"}
        assert 0 <= r["score"] <= 1
        if r["held_out"] and lang and len(text or "") > 100:
            held, right = held + 1, right + (r["lang_pred"] == lang)
    assert right >= 0.9 * held > 9
    kept = language.accepted(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in rows if not r["rejected"])
    assert language.languages(nothing).count() == 0
    assert {r["lang_pred"] for r in language.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header>Site name</header>
<nav><ul><li>Home<li>News {0}</ul></nav><div class="cookie-notice">We use cookies</div>
<div id="main"><article><h1>Title {0}</h1><p>First &amp; <b>bold</b>{1}<p>Second<br>line &lt;{0}&gt;<p>Read more on our site
<form>Name <input></form><aside>Related</aside></article></div>
<section class="comments"><p>Nice post {0}</section><footer>&copy; 2024</footer><script>var p = "<p>no</p>";</script></body></html>"""


def test_main_text(spark, nothing):
    rows = [(i, f"http://One.example.org/{i}", PAGE.format(i, " text" * (i % 5))) for i in range(12)]
    rows += [(20, "http://one.example.org/x", None), (21, None, ""), (None, "nonsense", "<p>alone &am"), rows[0],
             (22, "https://two.example.org", "plain  text &eacute;<br>x</div></p></b>"),
             (23, "https://u@three.example.org:80/a", "<div>" * 3000 + "deep" + "</div>" * 3000),
             (24, "http://four.example.org", "<article>" + "<p>para</p>" * 2000 + "</article><nav>menu")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("same", F.lit(0))
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in wrappers.main_texts(frame).collect())
    def article(i):  # the same line in all pages of a host is its template's
        return f"Title {i}\nFirst & bold{' text' * (i % 5)}\nSecond line <{i}>"
    want = [(i, article(i)) for i in range(12)] + [(20, ""), (21, ""), (None, "alone &am"), (0, article(0)), (22, "plain text é x"),
                                                   (23, "deep"), (24, "\n".join(["para"] * 2000))]
    assert got == Counter((i, t, len(t)) for i, t in want)
    assert wrappers.main_texts(frame.limit(0)).count() == 0


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)
