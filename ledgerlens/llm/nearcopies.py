"""Near duplicates by order MinHash.

A text's k-mers are its runs of five words, labelled with their occurrence so that repeats count. Each of `BANDS` hash functions
picks the `PICKS` least of them and keeps those k-mers in the order of the text: two texts agree there only if they share the
k-mers and their order. Texts of the same words are one from the start. Texts that agree in a band are candidates, and a pair is
verified on its words by an exact alignment alone: an edit similarity of 0.8 or more. A paragraph that moved is edits as any other.
Pairs that share less than `SHARED` of their five-word runs are not aligned, nor are those whose words, whatever their order, differ
by more than the edits that a copy may have: each edit makes up for one word at most.

No pairs of a whole group are emitted. First every text of a bucket is verified with one, that which agrees most with others
anywhere; linked texts are one class by then. Where a bucket still holds several classes, its texts are compared block by block in
tiles of bounded size, by one product of incidence matrices a tile, and only pairs that join two classes are aligned and emitted.

Edits take five-word runs with them: texts of edit similarity 0.95 share 0.6 of their runs or more, and miss all bands in 4 of 10,000
cases; where edits are spread as evenly as at 0.9 (0.42 shared), in one of 12. Short texts, for which the picks use up the k-mers,
have more bands of fewer picks, so that texts of four and five k-mers are lost in fewer than one of a million cases.

Defined results: texts without words (null and empty ones too) are a class each; texts of fewer than five words are one run; case
and punctuation make no difference; repeated rows share a class; the class id is the smallest doc_id in it (null if all are null);
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.files import stored
from .graph import components
from .rows import KEY, decided, kind, named
from .words import Words, mixed, runs, slices

SHINGLE = 5
SIMILAR = 0.8
BANDS, PICKS = 32, 3
#: Jaccard similarity of five-word runs under which no pair is aligned: what edits of 0.8 leave when they are spread (0.8^5 of the runs).
SHARED = 0.2
#: Texts of at most so many k-mers have further bands.
SHORT, SHORT_BANDS, SHORT_PICKS = 80, 8, 2
#: And texts of at most so many, more of these: where one of two texts has fewer k-mers than PICKS, only such bands can agree.
TINY, TINY_BANDS = 10, 8
#: Texts of one block of a bucket's tiles, and columns of a product.
BLOCK, COLUMNS = 256, 4096
#: So many edits are looked for along diagonals before whole columns are worked out.
FEW = 24
#: Bytes of word masks that are kept at once.
MASKS = 1 << 24

_SEEDS = mixed(np.arange(1, BANDS + SHORT_BANDS + TINY_BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_ODD = _SEEDS | np.uint64(1)
_ORDER = np.array([pow(0xE7037ED1A0B428DB, i, 1 << 64) for i in range(PICKS)], np.uint64)


def shingled(hashes: np.ndarray) -> np.ndarray:
    """Hashes of a text's five-word runs, in order; a shorter text is one run."""
    k = min(SHINGLE, len(hashes))
    at = np.arange(len(hashes) - k + 1)
    return runs(hashes, at, at + k)


def occurrence(values: np.ndarray) -> np.ndarray:
    """How many equal values come before each."""
    order = np.argsort(values, kind="stable")
    sorted_ = values[order]
    opens = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    number = np.empty(len(values), np.uint64)
    number[order] = np.arange(len(values)) - np.repeat(opens, np.diff(np.append(opens, len(values))))
    return number


def sketch(kmers: np.ndarray) -> np.ndarray:
    """One number a band: the picked k-mers in the order of the text."""
    labelled = mixed(kmers + occurrence(kmers) * np.uint64(0x9FB21C651E98DF25))
    out = []
    short = BANDS + SHORT_BANDS
    for first, last, picks, most in ((0, BANDS, PICKS, None), (BANDS, short, SHORT_PICKS, SHORT), (short, short + TINY_BANDS, SHORT_PICKS, TINY)):
        if most and len(kmers) > most:
            break
        step = max(1, (1 << 20) // len(kmers))
        for low in range(first, last, step):
            bands = slice(low, min(last, low + step))
            values = (labelled[None, :] ^ _SEEDS[bands, None]) * _ODD[bands, None]
            n = min(picks, len(kmers))
            chosen = np.argpartition(values, n - 1, axis=1)[:, :n] if n < len(kmers) else np.tile(np.arange(n), (len(values), 1))
            chosen.sort(axis=1)
            out.append(mixed((kmers[chosen] * _ORDER[:n]).sum(axis=1, dtype=np.uint64) ^ _SEEDS[bands]))
    return np.concatenate(out)


def _sketches(batches):
    for batch in batches:
        for part in slices(batch):
            w = Words(part.column("text"))
            low, high = w.first[:-1], w.first[1:]
            one, two = runs(w.hash, low, high), runs(mixed(w.hash ^ np.uint64(0x5851F42D4C957F2D)), low, high)
            bands = [sketch(shingled(w.hash[a:b])).view(np.int64) if b > a else None for a, b in zip(low, high, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(w.counts, pa.int64()), pa.array(one.view(np.int64)),
                 pa.array(two.view(np.int64)), pa.array(bands, pa.list_(pa.int64()))],
                [*KEY, "n_words", "same1", "same2", "bands"])


def _texts_words(batches):
    """The words of a text, four bytes of hash each."""
    for batch in batches:
        for part in slices(batch):
            w = Words(part.column("text"))
            short = w.hash.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), pa.array([short[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:], strict=True)], pa.binary())],
                ["node", "words"])


def read_words(words: bytes) -> np.ndarray:
    return np.frombuffer(words, np.uint32)


def shingle_set(words: np.ndarray) -> np.ndarray:
    return np.unique(shingled(mixed(words.astype(np.uint64))))


def word_set(words: np.ndarray) -> np.ndarray:
    """The words of a text, each time a word occurs as a value of its own."""
    return np.sort(words.astype(np.uint64) | occurrence(words) << np.uint64(32))


def most_edits(longer):
    """How many edits a copy may have, by the length of the longer text."""
    return np.floor((1 - SIMILAR) * longer + 1e-9)


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two sequences if it is at most `most`. Both ways below are exact: one is fast for few edits, and the other's
    cost does not grow with the square of their number."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    short -= head
    differ = np.flatnonzero(a[len(a) - short:][::-1] != b[len(b) - short:][::-1])
    tail = int(differ[0]) if len(differ) else short
    x, y = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    if not x or not y:
        return max(len(x), len(y))
    found = few_edits(x, y, min(most, FEW))
    return found if found is not None or most <= FEW else _many_edits(x, y, most)


def few_edits(x: list, y: list, most: int) -> int | None:
    """Furthest places on the diagonals of a band that widens by one with each edit."""
    n, m = len(x), len(y)
    reach = {0: 0}  # furthest place in x on diagonal (place in y - place in x)
    for e in range(most + 1):
        now = {}
        for d in range(-min(e, n), min(e, m) + 1):
            if e:
                i = max(reach.get(d, -2) + 1, reach.get(d + 1, -2) + 1, reach.get(d - 1, -1))
            else:
                i = 0
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            while i < n and i + d < m and x[i] == y[i + d]:
                i += 1
            if i == n and i + d == m:
                return e
            now[d] = i
        reach = now
    return None


def _many_edits(x: list, y: list, most: int) -> int | None:
    """Myers' columns in Hyyro's form: the steps down a column of the edit table, up or down by one, are the bits of two numbers. It
    ends early once the columns left cannot bring the distance down to `most`."""
    n, m = len(x), len(y)
    places: dict[int, list[int]] = {}
    for i, word in enumerate(x):
        places.setdefault(word, []).append(i)
    full, last, held = (1 << n) - 1, n - 1, MASKS // (n // 8 + 1)
    masks: dict[int, int] = {}
    rises, falls, score = full, 0, n
    for left, word in zip(range(m - 1, -1, -1), y, strict=True):
        equal = masks.get(word)
        if equal is None:
            bits = bytearray(n // 8 + 1)
            for i in places.get(word, ()):
                bits[i >> 3] |= 1 << (i & 7)
            if len(masks) >= held:
                masks.clear()
            equal = masks[word] = int.from_bytes(bits, "little")
        across = ((((equal & rises) + rises) ^ rises) | equal) & full
        up, down = falls | (full ^ (across | rises)), rises & across
        score += (up >> last) - (down >> last)
        if score - left > most:
            return None
        up, down = (up << 1 | 1) & full, (down << 1) & full
        rises, falls = down | (full ^ (equal | falls | up)), up & (equal | falls)
    return score if score <= most else None


def near(a: np.ndarray, b: np.ndarray, shared: int, a_set: int, b_set: int) -> bool:
    """Whether two texts' words are near copies, given how many five-word runs they share of how many."""
    if shared < SHARED * (a_set + b_set - shared) - 1e-9:
        return False
    return edits(a, b, int(most_edits(max(len(a), len(b))))) is not None


def _verified(batches):
    kept: dict[int, tuple] = {}

    def of(node: int, words: bytes):
        if node not in kept:
            if len(kept) > 500:
                kept.clear()
            array = read_words(words)
            kept[node] = array, shingle_set(array), word_set(array)
        return kept[node]

    for batch in batches:
        good = []
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "a_words", "b_words")), strict=True):
            (xw, xs, xb), (yw, ys, yb) = of(a, x), of(b, y)
            longer = max(len(xw), len(yw))
            alike = longer - len(np.intersect1d(xb, yb, assume_unique=True)) <= most_edits(longer)
            shared = len(np.intersect1d(xs, ys, assume_unique=True)) if alike else 0
            good.append(alike and near(xw, yw, shared, len(xs), len(ys)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets have in common."""
    _, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = counts[which] > 1
    which, owner = np.unique(which[often], return_inverse=True)[1], owner[often]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(which, kind="stable")
    which, owner = which[order], owner[order]
    for low in range(0, int(which.max(initial=-1)) + 1, COLUMNS):
        own = slice(*np.searchsorted(which, (low, low + COLUMNS)))
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[own], which[own] - low] = 1
        common += held @ held.T
    return common


def _candidates(words: list[np.ndarray], shared: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs to align: enough runs in common, and not more words apart than a copy has edits."""
    good = np.triu(shared >= SHARED * total - 1e-4, 1)
    if good.any():
        lengths = np.array([len(w) for w in words])
        longer = np.maximum(lengths[:, None], lengths[None, :])
        good &= longer - _common([word_set(w) for w in words]) <= most_edits(longer)
    return np.nonzero(good)


def _tile(table: pa.Table) -> pa.Table:
    """Links between classes in one tile: two blocks of a bucket's texts, or one with itself."""
    nodes, labels, blocks = (table.column(c).to_pylist() for c in ("node", "label", "block"))
    words = [read_words(w) for w in table.column("words").to_pylist()]
    sets = [shingle_set(w) for w in words]
    sizes = np.array([len(s) for s in sets])
    shared = _common(sets)
    total = sizes[:, None] + sizes[None, :] - shared
    i, j = _candidates(words, shared, total)
    best = np.argsort(-(shared[i, j] / total[i, j]), kind="stable")
    cross = len(set(blocks)) > 1
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    found = []
    for p, q in zip(i[best].tolist(), j[best].tolist(), strict=True):
        if (cross and blocks[p] == blocks[q]) or root(labels[p]) == root(labels[q]):
            continue
        if near(words[p], words[q], int(shared[p, q]), int(sizes[p]), int(sizes[q])):
            found.append((nodes[p], nodes[q]))
            parent[root(labels[p])] = root(labels[q])
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def classes(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs`: doc_id, text_hash, n_words, class_id, class_size, and keeps: whether its doc_id and text are
    the first of the class."""
    id_kind, rows = kind(docs), named(docs)
    sketches = stored(rows.mapInArrow(
        _sketches, f"doc_id {id_kind}, text_hash long, n_words long, same1 long, same2 long, bands array<long>"))
    # One node for all texts of the same words, with a number of its own.
    texts = stored(sketches.filter("n_words > 0").groupBy("same1", "same2")
                   .agg(F.min(F.struct(*KEY)).alias("key"), F.first("bands").alias("bands"))
                   .withColumn("node", F.monotonically_increasing_id()))
    members = texts.select("node", "key", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stored(members.join(shared, "bucket"))
    central = members.groupBy("node").agg(F.sum("size").alias("central"), F.min("key").alias("key"))
    hubs = (members.select("bucket", "node").join(central.select("node", "central"), "node")
            .groupBy("bucket").agg(F.max(F.struct("central", "node")).alias("hub")).select("bucket", "hub.node")
            .withColumnRenamed("node", "hub"))
    words = stored(rows.withColumn("key", F.struct(*KEY)).join(central.select("node", "key"), "key").select("node", "text")
                   .dropDuplicates(["node"]).mapInArrow(_texts_words, "node long, words binary"))
    pairs = (members.join(hubs, "bucket").filter("node <> hub")
             .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
    with_words = (pairs.join(words.withColumnsRenamed({"node": "a", "words": "a_words"}), "a")
                  .join(words.withColumnsRenamed({"node": "b", "words": "b_words"}), "b"))
    links = stored(with_words.mapInArrow(_verified, "a long, b long"))
    labels = components(links)

    # Buckets that hold several classes still, but for those of one pair, which was verified.
    placed = members.filter("size > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed_ = (placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"),
                                           F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"))
              .filter("low <> high").dropDuplicates(["n", "who"]).select("bucket"))
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node", "bucket"), parts).cast("int")
    tiles = (placed.join(mixed_, "bucket").withColumn("block", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
             .select("bucket", "node", "label", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
             .join(words, "node").groupBy("bucket", "low", "high").applyInArrow(_tile, "a long, b long"))
    more = stored(tiles.distinct())
    # The stars of the first labels hold together what its links did, and need no steps again.
    labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
    named_ = texts.select("same1", "same2", "node").join(labels, "node", "left").select("same1", "same2", F.coalesce("label", "node").alias("label"))
    labelled = sketches.drop("bands").join(named_, ["same1", "same2"], "left")
    worded = labelled.filter("n_words > 0")
    groups = worded.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"),
                                         F.min(F.struct(*KEY)).alias("first"))
    found = worded.join(groups, "label").select(*KEY, "n_words", "class_id", "class_size", (F.struct(*KEY) == F.col("first")).alias("keeps"))
    alone = labelled.filter("n_words = 0").select(*KEY, "n_words", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"),
                                                  F.lit(True).alias("keeps"))
    return found.unionByName(alone)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near copies: of each class its first document stays, once; texts without words all stay."""
    found = (classes(docs).groupBy(*KEY).agg(F.first("keeps").alias("keeps"), F.count(F.lit(1)).alias("copies"),
                                             F.first("n_words").alias("n_words")))
    chosen = stored(found.filter("keeps"))
    kept = decided(docs, chosen).filter("keeps")
    once = (F.col("copies") == 1) | (F.col("n_words") == 0)
    same = kept.filter(~once).withColumn("same", F.struct("row.doc_id", "row.text")).dropDuplicates(["same"]).drop("same")
    return kept.filter(once).unionByName(same).select("row.*")
