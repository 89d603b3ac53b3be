"""Pages as small trees of block elements, and simple tree matching between two of them."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np

# Element names as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary "
                  "table tbody td tfoot th thead tr ul".split())
#: Their content is never text of the page.
SILENT = frozenset("script style template noscript iframe svg title textarea select button audio video".split())
#: Of those, the ones that a block of text does not stand in: where it opens, they were left open.
LINE = frozenset("svg select button".split())
TEXT_BLOCK = frozenset("article aside blockquote dl figure footer h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Opening one of the first ends an open one of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}}
#: Where the search for an element to end stops.
FENCES = frozenset("article aside body div footer form header html main nav section table".split())

#: Blocks nested deeper than that are read into the block at that depth, each still a line of its own.
DEPTH = 200

#: Child pairs whose matches an alignment keeps at once; longer lists are aligned row by row, with the same result.
CELLS = 250_000
#: Choices that such an alignment keeps at once, a byte each.
CHOICES = 1 << 24


class Node:
    """A block element: `kids` are its blocks and its runs of text, in page order."""

    __slots__ = ("tag", "mark", "kids", "blocks", "number", "text")

    def __init__(self, tag: str, mark: str = ""):
        self.tag, self.mark, self.kids, self.blocks, self.number, self.text = tag, mark, [], [], -1, None

    def own_text(self) -> str:
        if self.text is None:
            self.text = " ".join("".join([k if isinstance(k, str) else "\n" for k in self.kids]).split())
        return self.text


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#page")
        self.open, self.silent = [self.root], []

    def handle_starttag(self, tag, attrs):
        if tag == "br" and not self.silent:
            self.open[-1].kids.append(" ")
        if self.silent and tag in TEXT_BLOCK and all(t in LINE for t in self.silent if t in SILENT):
            self.silent = []
        if tag in SILENT or (self.silent and tag in BLOCK and tag not in VOID):
            self.silent.append(tag)
        if self.silent or tag not in BLOCK:
            return
        self._end(ENDS.get(tag) or {"p"} if tag != "html" else set())
        if tag in ENDS:
            self._end({"p"})
        # Only what names an element's part in the page; None stands for an attribute without a value.
        mark = " ".join(v.lower() for k, v in attrs if k in ("class", "id", "role") and v)
        node = Node(tag, mark)
        self.open[-1].kids.append(node)
        self.open[-1].blocks.append(node)
        if tag not in VOID and len(self.open) < DEPTH:
            self.open.append(node)

    def _end(self, tags: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in FENCES:
                return

    def handle_endtag(self, tag):
        if self.silent:
            if tag in self.silent:
                at = len(self.silent) - 1 - self.silent[::-1].index(tag)
                del self.silent[at:]
                return
            # The end of a block around it: the silent element was left open.
            if tag not in BLOCK or all(n.tag != tag for n in self.open):
                return
            self.silent = []
        if tag in BLOCK:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == tag:
                    del self.open[i:]
                    return

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag in BLOCK:
            self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        if not self.silent:
            self.open[-1].kids.append(data)


def tree(html: str) -> Node:
    """The page's tree; whatever is broken or cut off is read as far as it goes."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    number, stack = 0, [reader.root]
    while stack:
        node = stack.pop()
        node.number = number
        number += 1
        stack.extend(reversed(node.blocks))
    return reader.root


def nodes(root: Node):
    """All nodes in the order of their numbers."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(reversed(node.blocks))


def _aligned(xs, ys, weigh) -> tuple[int, list]:
    """Weight and pairs of the best alignment of two long lists of children. A row of weights is made at a time; choices are kept for
    one block of rows, and of the blocks before only the last row of sums, from which their choices are worked out again."""
    codes: dict[str, int] = {}
    labels = np.array([codes.setdefault(q[1], len(codes)) for q in ys])
    texts, inner = np.array([q[2] for q in ys]), [j for j, q in enumerate(ys) if q[3]]

    def weights(p):
        same = labels == codes.get(p[1], -1)
        out = same.astype(np.int32)
        if p[2]:
            out += same & (texts == p[2])
        if p[3]:
            for j in inner:
                if same[j]:
                    out[j] = weigh(p, ys[j])[0]
        return out

    def below(last, row):
        line = np.zeros_like(last)
        np.maximum(last[1:], last[:-1] + row, out=line[1:])
        return np.maximum.accumulate(line)

    step = max(1, CHOICES // len(ys))
    starts = range(0, len(xs), step)
    borders = [np.zeros(len(ys) + 1, np.int32)]
    for low in starts[:-1]:
        line = borders[-1]
        for p in xs[low: low + step]:
            line = below(line, weights(p))
        borders.append(line)
    total, j, chosen = None, len(ys), []
    for low, line in zip(reversed(starts), reversed(borders), strict=True):
        choices = []
        for p in xs[low: low + step]:
            row, last = weights(p), line
            line = below(last, row)
            paired = (row > 0) & (line[1:] == last[:-1] + row)
            choices.append(np.where(paired, 2, line[1:] == last[1:]).astype(np.uint8))
        total = int(line[-1]) if total is None else total
        i = len(choices)
        while i and j:
            choice = choices[i - 1][j - 1]
            if choice == 2:
                chosen.append((xs[low + i - 1], ys[j - 1]))
            i, j = i - (choice > 0), j - (choice != 1)
    return total, [pair for p, q in reversed(chosen) for pair in weigh(p, q)[1]]


def matching(a, b) -> list[tuple[int, int]]:
    """Pairs of node numbers of the largest order-preserving match of two trees (simple tree matching). A node is (number, label,
    text, children); labels must be the same, same texts count as a node more."""
    long: dict[tuple[int, int], tuple[int, list]] = {}

    def weigh(x, y) -> tuple[int, list]:
        if x[1] != y[1]:
            return 0, []
        gain = 2 if x[2] and x[2] == y[2] else 1
        if not x[3] or not y[3]:
            return gain, [(x[0], y[0])]
        xs, ys = x[3], y[3]
        pairs = [(x[0], y[0])]
        if len(xs) * len(ys) > CELLS:
            # Weighed once, as the list above asks again for the pairs it chose.
            if (x[0], y[0]) not in long:
                weight, own = _aligned(xs, ys, weigh)
                long[x[0], y[0]] = gain + weight, pairs + own
            return long[x[0], y[0]]
        cells = [[(0, ()) if p[1] != q[1] else weigh(p, q) if p[3] and q[3]
                  else (2 if p[2] and p[2] == q[2] else 1, ((p[0], q[0]),)) for q in ys] for p in xs]
        best = [[0] * (len(ys) + 1)]
        for row in cells:
            last, line = best[-1], [0]
            for j, (w, _) in enumerate(row):
                line.append(max(last[j + 1], line[j], last[j] + w))
            best.append(line)
        i, j, chosen = len(xs), len(ys), []
        while i and j:
            w, own = cells[i - 1][j - 1]
            if w and best[i][j] == best[i - 1][j - 1] + w:
                chosen.append(own)
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        for own in reversed(chosen):
            pairs.extend(own)
        return gain + best[-1][-1], pairs

    return weigh(a, b)[1]
