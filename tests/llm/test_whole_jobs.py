"""Cases that the text operators once cut short."""
import random

import numpy as np
import pyarrow as pa

from ledgerlens.llm import nearcopies, notices, trees, wrappers

from test_text_operators import distance, near_classes

def test_near_copies_of_moved_and_repeated_passages(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    pick = lambda n: [rng.choice(vocab) for _ in range(n)]
    text, one, two = pick(900), pick(50), pick(50)
    moved = [text[:400] + one + two + text[400:], text[:400] + two + one + text[400:]]
    passages = [pick(25) for _ in range(12)]
    order = [i % 12 for i in range(36)]
    other = order[:5] + [9] + order[6:20] + [0] + order[21:]  # every passage still stands somewhere
    repeated = [[w for i in o for w in passages[i]] for o in (order, other)]
    turned = pick(300)
    rows = {i: " ".join(w) for i, w in enumerate([*moved, *repeated, turned, turned[150:] + turned[:150]])}
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in nearcopies.classes(frame).collect()}
    assert got == near_classes(rows) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}

def test_edits_are_exact_on_both_ways():
    rng = random.Random(6)
    for _ in range(400):
        a = [rng.randrange(rng.choice([2, 9, 400])) for _ in range(rng.randrange(160))]
        b = list(a)
        for _ in range(rng.randrange(60)):
            at = rng.randrange(len(b) + 1)
            b[at: at + rng.randrange(3)] = [rng.randrange(9) for _ in range(rng.randrange(3))]
        true = distance(a, b)
        for most in {0, max(0, true - 1), true, true + 1, rng.randrange(160), 400}:
            assert nearcopies.edits(np.array(a, np.uint32), np.array(b, np.uint32), most) == (true if true <= most else None)


def test_texts_whose_words_are_too_far_apart_are_not_aligned(monkeypatch):
    """A bucket of texts that share runs but are no copies: of 3,160 pairs only those are aligned that can be copies, and none is lost."""
    rng = random.Random(9)
    base = [rng.randrange(9000) for _ in range(80)]
    texts = []
    for i in range(80):
        words = list(base)
        for at in range(45, 80) if i % 10 else rng.sample(range(80), 6):
            words[at] = rng.randrange(9000, 99_000)
        texts.append(np.array(words, np.uint32))
    near = [(i, j) for i in range(80) for j in range(i + 1, 80) if nearcopies.edits(texts[i], texts[j], 16) is not None]
    aligned = []
    plain = nearcopies.edits
    monkeypatch.setattr(nearcopies, "edits", lambda a, b, most: aligned.append(1) or plain(a, b, most))
    tile = pa.table({"node": range(80), "label": range(80), "block": [0] * 80, "words": [t.tobytes() for t in texts]})
    links = nearcopies._tile(tile).to_pylist()
    parent = list(range(80))

    def root(x):
        return x if parent[x] == x else root(parent[x])
    for a, b in near:
        parent[root(a)] = root(b)
    assert 20 < len(near) and len(links) == 80 - len({root(i) for i in range(80)})
    assert {root(link["a"]) == root(link["b"]) for link in links} == {True}
    assert len(aligned) <= len(near)


def test_very_short_near_copies_share_a_band():
    """Four and five k-mers at Jaccard 0.8 exactly."""
    rng = np.random.default_rng(7)
    lost = 0
    for kmers in rng.integers(0, 1 << 64, (12_000, 5), dtype=np.uint64):
        lost += not (nearcopies.sketch(kmers)[:, None] == nearcopies.sketch(kmers[1:])[None, :]).any()
    assert lost == 0


def test_long_lists_of_blocks_are_matched_as_short_ones(monkeypatch):
    rng = random.Random(8)

    def made(depth, number):
        number[0] += 1
        return [number[0], rng.choice("pqd"), rng.choice([0, 1, 2, 3]), [made(depth - 1, number) for _ in range(rng.randrange(7))] if depth else []]

    for _ in range(60):
        a, b = made(3, [0]), made(3, [0])
        b[1] = a[1]
        want = trees.matching(a, b)
        for cells, choices in ((0, 1 << 24), (0, 12), (6, 12)):
            with monkeypatch.context() as m:
                m.setattr(trees, "CELLS", cells)
                m.setattr(trees, "CHOICES", choices, raising=False)
                assert trees.matching(a, b) == want


def test_template_behind_a_long_text(spark):
    """The sixth block after a list of 700 paragraphs, more or fewer, is the same on every page."""
    box = "".join(f"<div class=b{i}>Same box {i}</div>" for i in range(6))
    rows = [(i, f"http://long.example.org/{i}", "<html><body>" + "".join(f"<p>{i} par {n}</p>" for n in range(700 + i)) + box + "</body></html>")
            for i in range(9)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.main_texts(frame).collect()}
    assert got == {i: "\n".join(f"{i} par {n}" for n in range(700 + i)) for i in range(9)}


def test_boilerplate_longer_than_the_articles_is_template(spark):
    """Neutral names, 400 characters of template around shorter articles; copies of one article do not make it template."""
    words = "".join(f"<div class=b{i}>{f'Same words {i} ' * 8}</div>" for i in range(4))
    page = "<html><body>" + words + "<div class=x><p>{0} first words of it<p>{0} second and last words</div></body></html>"
    rows = [(i, f"http://short.example.org/{i}", page.format(i)) for i in range(12)]
    rows += [(100 + i, f"http://short.example.org/copy{i}", page.format(i // 30) + f"<nav>{i}</nav>") for i in range(60)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    text = "{0} first words of it\n{0} second and last words".format
    got = {r["page_id"]: r["text"] for r in wrappers.main_texts(frame).collect()}
    assert got == {i: text(i if i < 100 else (i - 100) // 30) for i, _, _ in rows}


def test_notices_with_letters_more_at_either_end():
    search = notices.Notices()
    for label, phrase, edits in notices.NOTICES:
        for n in range(edits + 1):
            for changed in ("x" * n + phrase, phrase + "x" * n, "x" * (n // 2) + phrase + "x" * (n - n // 2)):
                text = f"some words here {changed} and more of them"
                assert (label, 16, 16 + len(changed), n) in list(search.spans(text)), text
    assert not [s for s in search.spans("creative commons attributionsxx") if s[0] == "cc-by"]
