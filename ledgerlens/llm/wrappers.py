"""Main text of pages by wrapper induction.

Of each host one page, the least by a hash, is its wrapper's skeleton. Every page is aligned with its host's skeleton by simple tree
matching, and the votes of all pages are added up by host and skeleton node: how often the node's text stayed the same, and how
much text that changes it held. Pages of the same possible content (all text but that of blocks named as something else) are copies
and vote once a host; those of the skeleton's own content do not vote. Nodes that stay the same are template; of the varying slots the deepest one that holds most of the
varying text is the host's content. Pages are then read through the wrapper: inside the content slot, without template nodes and
without menus, adverts, forms, notices or reader comments, whose element names and classes give them away. A host of few pages has
no template, and a page that does not match its wrapper falls back on its own article element or its largest text.

A page's votes are one row of eight bytes a node, dealt by host and content, and are summed before they are shuffled by host, so a
host with a third of all pages costs one row for each node and batch there. Skeletons
hold hashes of texts, never texts. A table of skeletons is joined by host; Spark broadcasts it only while its file is small.

Defined results: null and empty pages have empty text; a null url or one without a host is a host of its own name, empty; repeated
rows and null ids each give a row; broken markup is read as far as it goes; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..ship import ship
from ..sources.files import stored
from .trees import Node, matching, nodes, tree
from .words import slices

#: A node is template if it stays the same in this share of its host's pages, of at least so many.
SAME_SHARE, LEAST_PAGES = 0.6, 5
#: The content slot holds this share of a host's varying text.
SLOT_SHARE = 0.6

ASIDE_TAGS = frozenset("aside dialog footer form head menu nav".split())
# Words that classes and ids of such blocks use.
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "header masthead menu nav navbar navigation newsletter notice notices popup promo promoted related respond share sharing "
    "sidebar social sponsor sponsored subscribe toolbar".split())
#: Words that only say what kind of box stands there.
PART_WORDS = frozenset("area bar block body bottom box button buttons container content count group inner item items left link links "
                       "list main module outer page pane panel primary right row secondary section site slot top unit widget wrap "
                       "wrapper".split())
ASIDE_ROLES = frozenset("banner complementary contentinfo dialog form navigation search".split())
MAIN_TAGS = ("article", "main")

_WORDS = re.compile(r"[a-z]+").findall


@lru_cache(maxsize=4096)
def _named_aside(mark: str) -> bool:
    """Whether one of an element's names (its classes, id and role) says that it is not the article's: all words of a name must be
    such words or those of a box, so that neither `related-work` nor `ad-hoc-networks` is one."""
    for name in mark.split():
        words = _WORDS(name)
        if any(w in ASIDE_WORDS or w in ASIDE_ROLES for w in words) and all(w in ASIDE_WORDS or w in ASIDE_ROLES or w in PART_WORDS for w in words):
            return True
    return False


def aside(node: Node, inside: bool) -> bool:
    """Whether a block is not the article's by its name; `inside` an article, a header is the article's own."""
    if node.tag in ASIDE_TAGS or (node.tag == "header" and not inside):
        return True
    return bool(node.mark) and node.tag not in ("html", "body", *MAIN_TAGS) and _named_aside(node.mark)


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) if text else 0


def skeleton(node: Node):
    """(number, label, hash of own text, children) of a tree; its JSON is what a wrapper keeps of a page."""
    return [node.number, f"{node.tag} {node.mark}".strip(), _hash(node.own_text()), [skeleton(b) for b in node.blocks]]


def varying(root: Node, same: set[int]) -> dict[int, int]:
    """Characters of text that changes, below each node, in parts that may be content."""
    held: dict[int, int] = {}

    def below(node: Node, inside: bool) -> int:
        if aside(node, inside):
            return 0
        inside = inside or node.tag in MAIN_TAGS
        own = 0 if node.number in same else len(node.own_text())
        held[node.number] = total = own + sum(below(b, inside) for b in node.blocks)
        return total

    below(root, False)
    return held


def text_of(root: Node, left_out: set[int], inside: bool) -> str:
    """The blocks below a node, a line each, without what is named or numbered as something else."""
    lines: list[str] = []

    def read(node: Node, inside: bool):
        if node.number in left_out:
            for b in node.blocks:
                read(b, inside)
            return
        inside = inside or node.tag in MAIN_TAGS
        run: list[str] = []
        for kid in node.kids:
            if isinstance(kid, str):
                run.append(kid)
                continue
            if line := " ".join("".join(run).split()):
                lines.append(line)
            run = []
            if not aside(kid, inside):
                read(kid, inside)
        if line := " ".join("".join(run).split()):
            lines.append(line)

    read(root, inside)
    return "\n".join(lines)


def _own_slot(root: Node, held: dict[int, int]) -> Node:
    """A page's content without a wrapper: its main element with the most text, else the deepest block with most of the text."""
    mains = [n for n in nodes(root) if n.tag in MAIN_TAGS and held.get(n.number, 0)]
    if mains:
        most = max(mains, key=lambda n: (held[n.number], -n.number))
        # Several articles side by side are one page's content.
        return most if held[most.number] >= SLOT_SHARE * held.get(0, 0) else root
    node, total = root, held.get(0, 0)
    while total and (deeper := next((b for b in node.blocks if held.get(b.number, 0) >= SLOT_SHARE * total and b.blocks), None)):
        node = deeper
    return node


class Wrapper:
    def __init__(self, kept: str, same: list[int], slot: int | None):
        self.skeleton, self.same, self.slot = json.loads(kept), frozenset(same or ()), slot
        self.texts = _texts(self.skeleton)

    def read(self, root: Node) -> str:
        pairs = matching(self.skeleton, skeleton(root))
        by_number = {n.number: n for n in nodes(root)}
        template = {mine for theirs, mine in pairs
                    if theirs in self.same and self.texts[theirs] and self.texts[theirs] == _hash(by_number[mine].own_text())}
        held = varying(root, template)
        slot = next((mine for theirs, mine in pairs if theirs == self.slot), None)
        chosen = by_number[slot] if slot is not None and held.get(slot, 0) else _own_slot(root, held)
        return text_of(chosen, template, any(x is chosen for n in by_number.values() if n.tag in MAIN_TAGS for x in nodes(n)))


def _texts(kept) -> dict[int, int]:
    out, stack = {}, [kept]
    while stack:
        node = stack.pop()
        out[node[0]] = node[2]
        stack.extend(node[3])
    return out


def content_hash(root: Node) -> int:
    """Of the text that may be content; copies of a page have the same."""
    text = text_of(root, set(), False).encode("utf-8", "replace")
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _votes(kept, texts: dict[int, int], root: Node) -> np.ndarray:
    """(skeleton node, twice the characters that changed below it, and one more if its text stayed) for one page."""
    pairs = matching(kept, skeleton(root))
    mine = {n.number: n for n in nodes(root)}
    same = {b for a, b in pairs if texts[a] and texts[a] == _hash(mine[b].own_text())}
    held = varying(root, same)
    return np.array([(a, 2 * held.get(b, 0) + (b in same)) for a, b in pairs], "<u4").reshape(-1, 2)


def _slot(kept, held: dict[int, int]) -> int | None:
    """The deepest skeleton node with most of the varying text; a main element ends the way down."""
    if not held.get(kept[0]):
        return None
    node = kept
    while node[1].split(" ")[0] not in MAIN_TAGS:
        deeper = next((b for b in node[3] if held.get(b[0], 0) >= SLOT_SHARE * held[kept[0]] and b[3]), None)
        deeper = deeper or next((b for b in node[3] if held.get(b[0], 0) >= SLOT_SHARE * held[kept[0]]
                                 and b[1].split(" ")[0] in MAIN_TAGS), None)
        if deeper is None:
            break
        node = deeper
    return node[0]


def _html(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def host_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, html and host, of lower-case name."""
    ship(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))


def induced(pages: DataFrame) -> DataFrame:
    """host, skeleton (JSON), same (template nodes) and slot of every host; `pages` as from `host_pages`."""
    filled = pages.filter(F.length("html") > 0)

    def keep(batches):
        for batch in batches:
            roots = [tree(h) for h in _html(batch.column("html"))]
            kept = [json.dumps(skeleton(r), separators=(",", ":")) for r in roots]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(kept, pa.string()), pa.array(map(content_hash, roots), pa.int64())],
                                             ["host", "skeleton", "content"])

    least = filled.groupBy("host").agg(F.min_by("html", F.struct(F.xxhash64("html"), "html")).alias("html"))
    skeletons = stored(least.mapInArrow(keep, "host string, skeleton string, content long"))

    def vote(batches):
        known: dict[str, tuple] = {}
        for batch in batches:
            for part in slices(batch, "html"):
                found: dict[tuple[str, int], bytes] = {}
                for host, html, kept, own in zip(*(part.column(c).to_pylist() for c in ("host", "html", "skeleton", "content")), strict=True):
                    root = tree(html)
                    if (content := content_hash(root)) == own:
                        continue
                    if host not in known:
                        if len(known) > 1000:
                            known.clear()
                        kept = json.loads(kept)
                        known[host] = kept, _texts(kept)
                    votes = _votes(*known[host], root).tobytes()
                    found[host, content] = min(found.get((host, content), votes), votes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for h, _ in found], pa.string()), pa.array([c for _, c in found], pa.int64()), pa.array(found.values(), pa.binary())],
                    ["host", "content", "votes"])

    def add(batches):
        for batch in batches:
            sums: dict[str, dict[int, list[int]]] = {}
            for host, votes in zip(batch.column("host").to_pylist(), batch.column("votes").to_pylist(), strict=True):
                of_host = sums.setdefault(host, {})
                for node, what in np.frombuffer(votes, "<u4").reshape(-1, 2).tolist():
                    seen = of_host.setdefault(node, [0, 0, 0])
                    seen[0] += 1
                    seen[1] += what & 1
                    seen[2] += what >> 1
            rows = [(h, n, *seen) for h, of_host in sums.items() for n, seen in of_host.items()]
            types = [pa.string(), *[pa.int64()] * 4]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                                 ["host", "node", "seen", "same", "chars"])

    # Of copies that differ outside of their content the least votes count, whatever the order of rows.
    once = (filled.select("host", "html").join(skeletons, "host").mapInArrow(vote, "host string, content long, votes binary")
            .groupBy("host", "content").agg(F.min("votes").alias("votes")).select("host", "votes"))
    votes = (once.mapInArrow(add, "host string, node long, seen long, same long, chars long")
             .groupBy("host", "node").agg(*(F.sum(c).alias(c) for c in ("seen", "same", "chars"))))
    # A skeleton's nodes are one page's.
    per_host = votes.groupBy("host").agg(F.collect_list(F.struct("node", "seen", "same", "chars")).alias("votes"))

    def decide(batches):
        for batch in batches:
            same, slots = [], []
            for kept, votes in zip(batch.column("skeleton").to_pylist(), batch.column("votes").to_pylist(), strict=True):
                votes = votes or []
                same.append([v["node"] for v in votes if v["seen"] >= LEAST_PAGES and v["same"] >= SAME_SHARE * v["seen"]])
                slots.append(_slot(json.loads(kept), {v["node"]: v["chars"] for v in votes}))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("skeleton"), pa.array(same, pa.list_(pa.int64())),
                                              pa.array(slots, pa.int64())], ["host", "skeleton", "same", "slot"])

    return stored(skeletons.join(per_host, "host", "left").mapInArrow(decide, "host string, skeleton string, same array<long>, slot long"))


def main_texts(pages: DataFrame) -> DataFrame:
    """One row for each row of `pages`: page_id, url, text, n_chars."""
    rows = host_pages(pages)
    wrappers = induced(rows)

    def extract(batches):
        known: dict[str, Wrapper] = {}
        for batch in batches:
            for part in slices(batch, "html"):
                texts = []
                columns = (part.column(c).to_pylist() for c in ("host", "html", "skeleton", "same", "slot"))
                for host, html, kept, same, slot in zip(*columns, strict=True):
                    if not html or kept is None:
                        texts.append("")
                        continue
                    if host not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[host] = Wrapper(kept, same, slot)
                    texts.append(known[host].read(tree(html)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    id_kind = pages.schema["page_id"].dataType.simpleString()
    return rows.join(wrappers, "host", "left").mapInArrow(extract, f"page_id {id_kind}, url string, text string, n_chars long")
