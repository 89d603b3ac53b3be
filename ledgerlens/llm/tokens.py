"""Token counts of whole texts by a map-side lookup in two tiers, without a shuffle of pre-tokens.

A tokenizer that drops white space and never joins across it gives a text the ids of its pieces between ASCII white space, one
after another. So pieces are looked up: first in a broadcast table of the corpus's frequent pieces, bounded by `TABLE_ENTRIES`,
then in the worker's own caches, of pieces and of the pre-tokens in them; what neither knows is encoded by the library and cached,
special strings included (they hold no white space). The table comes from bounded summaries of all documents, one a task; it decides speed, never results.
Other vocabularies are encoded by the library as whole texts.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids each give a row; bytes that are not
UTF-8 count as replacement characters; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .rows import KEY, kind, named
from .words import slices

#: Entries of the broadcast table, entries a task reports, and entries a worker's cache may hold before it starts anew.
TABLE_ENTRIES = 1 << 15
TASK_ENTRIES = 1 << 12
CACHE_ENTRIES = 500_000

LIMIT = 2048

_WORKER: dict[tuple, "Pieces"] = {}


def _library(path: str):
    """Texts to lists of ids, by the library that the file is for."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]


# The steps of the vocabularies that treat pieces on their own, as their files state them.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = ["NFC", "Replace", "Lowercase"]
#: Letters of Latin-1 and printable ASCII: lower case, composition and classes are the same in every library.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall


def by_pieces(path: str) -> bool:
    """Whether the vocabulary treats the pieces between white space on their own: white space is made one blank, no pre-token
    matches it, and no special string holds it."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    steps = (whole.get("normalizer") or {}).get("normalizers", [])
    parts = (whole.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return ([s["type"] for s in steps] == _NORMAL and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
            and [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": _PATTERN}
            and parts[0]["behavior"] == "Removed" and parts[0]["invert"] is True
            and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
            and all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] and not t["single_word"]
                    and not re.search(r"\s", t["content"]) for t in whole["added_tokens"]))


def _as_bytes_alphabet() -> dict[int, str]:
    """How a byte-level vocabulary writes each plain character: its UTF-8 bytes, those without a printable form as 256 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    letter = {b: chr(b if b in shown else next(other)) for b in range(256)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(33, 256)}


class Parts(dict):
    """Ids (little-endian, 32 bits each) of pre-tokens that the library's model has merged, in lower case."""

    def __init__(self, model):
        super().__init__()
        self.model, self.alphabet = model, _as_bytes_alphabet()

    def __missing__(self, part: str) -> bytes:
        found = self[part] = array("I", [t.id for t in self.model.tokenize(part.translate(self.alphabet))]).tobytes()
        return found


class Pieces:
    """One worker's lookup from a piece (bytes) to its ids (little-endian, 32 bits each), or to their number."""

    def __init__(self, path: str, lengths: bool, table: dict[bytes, object] | None = None):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.encode, self.lengths, self.table = _library(path), lengths, table or {}
        self.known, self.parts = dict(self.table), Parts(Tokenizer.from_file(path).model)

    def ids(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Pieces of plain characters go to the model by pre-token, through a cache; any other, and any that may hold a special
        string, to the library as they are."""
        if len(self.parts) > CACHE_ENTRIES:
            self.parts.clear()
        found, odd, part = {}, [], self.parts
        for p in pieces:
            text = p.decode("utf-8", "replace")
            if _PLAIN(text) and "<|" not in text:
                found[p] = b"".join([part[x] for x in _PARTS(text.lower())])
            else:
                odd.append((p, text))
        for at in range(0, len(odd), 20_000):
            some = odd[at: at + 20_000]
            found.update((p, array("I", i).tobytes()) for (p, _), i in zip(some, self.encode([t for _, t in some]), strict=True))
        return found

    def learn(self, pieces) -> None:
        if len(self.known) > len(self.table) + CACHE_ENTRIES:
            self.known = dict(self.table)
        known = self.known
        found = self.ids([p for p in pieces if p not in known])
        known.update((p, len(i) // 4) for p, i in found.items()) if self.lengths else known.update(found)

    def texts(self, texts: list[bytes]):
        """For each text, what its pieces have."""
        split = [t.split() for t in texts]
        self.learn(set().union(*split))
        look = self.known.__getitem__
        return [map(look, s) for s in split]


def worker(path: str, lengths: bool, table: dict | None = None, mark: str = "") -> Pieces:
    """This worker's lookup; it stays from task to task."""
    name = (path, lengths, mark)
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = Pieces(path, lengths, table)
    return _WORKER[name]


def raw(texts: pa.Array) -> list[bytes]:
    return pc.fill_null(texts, "").cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()).to_pylist()


def _frequent(batches, entries: int):
    """A bounded summary: pieces that are frequent in this task, and how often they were seen since they were last dropped."""
    seen: Counter = Counter()
    for batch in batches:
        for part in slices(batch):
            for text in raw(part.column("text")):
                seen.update(text.split())
            if len(seen) > 50 * entries:
                seen = Counter(dict(seen.most_common(10 * entries)))
    top = [(p, n) for p, n in seen.most_common(entries) if n > 1 and len(p) <= 64]
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())],
                                     ["piece", "seen"])


def frequent_lengths(docs: DataFrame, path: str) -> dict[bytes, int]:
    """The table: at most TABLE_ENTRIES pieces of at most 64 bytes, with their numbers of tokens."""
    tasks = docs.select("text").mapInArrow(lambda batches: _frequent(batches, TASK_ENTRIES), "piece binary, seen long")
    top = (tasks.groupBy("piece").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "piece").limit(TABLE_ENTRIES).collect())
    return {p: len(i) // 4 for p, i in Pieces(path, True).ids([bytes(r["piece"]) for r in top]).items()}


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row for each row of `docs`: doc_id, text_hash, n_bytes, n_tokens, over_limit (more than `limit` tokens)."""
    rows, id_kind = named(docs), kind(docs)
    pieces = by_pieces(path)
    table = frequent_lengths(rows, path) if pieces else {}
    shared, mark = docs.sparkSession.sparkContext.broadcast(table), str(id(table))

    def count(batches):
        lookup = worker(path, True, shared.value, mark) if pieces else None
        library = None if pieces else _library(path)
        for batch in batches:
            for part in slices(batch):
                texts = raw(part.column("text"))
                sizes = ([sum(t) for t in lookup.texts(texts)] if pieces
                         else [len(i) for i in library([t.decode("utf-8", "replace") for t in texts])])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array([n > limit for n in sizes], pa.bool_())],
                    [*KEY, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, f"doc_id {id_kind}, text_hash long, n_bytes long, n_tokens long, over_limit boolean")
