"""Context trees over bytes: symbol sequences of texts, packed n-grams, and the walk from each symbol to its longest context."""

from __future__ import annotations

import numpy as np

#: Symbols 0-255 are bytes; START stands before each text, END behind it.
START, END, ALL = 256, 257, 258
BITS = 9


def sequence(data: np.ndarray, offsets: np.ndarray, end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """START, the bytes and maybe END of each row in one array; the offsets of the rows, and a mask of START."""
    n, extra = len(offsets) - 1, 1 + end
    offsets = offsets - offsets[0]
    new = offsets + extra * np.arange(n + 1)
    out = np.empty(int(new[-1]), np.int32)
    start = np.zeros(len(out), bool)
    start[new[:-1]] = True
    own = ~start
    out[new[:-1]] = START
    if end:
        own[new[1:] - 1] = False
        out[new[1:] - 1] = END
    out[own] = data
    return out, new, start


def grams(symbols: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
    """For each symbol but START: it and up to `depth` symbols before it, as far as its text goes.

    The symbol stands lowest, older ones higher; a field holds its symbol plus 1, and 0 beyond the text.
    """
    key = (symbols + 1).astype(np.uint64)
    open_ = ~start
    for d in range(1, depth + 1):
        if d >= len(symbols):
            break
        open_[d:] &= True
        older = np.zeros(len(symbols), np.uint64)
        older[d:] = (symbols[:-d] + 1).astype(np.uint64)
        older[~open_] = 0
        key |= older << np.uint64(BITS * d)
        closed = np.ones(len(symbols), bool)
        closed[d:] = start[:-d]
        open_ &= ~closed
    return key[~start]


def cut(keys: np.ndarray, depth: int) -> np.ndarray:
    """The n-grams without what is older than `depth` symbols before the last."""
    return keys & np.uint64((1 << (BITS * (depth + 1))) - 1)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts[:0]


class Tree:
    """Contexts (packed like n-grams, without the symbol that follows) and the way to the longest one at each place.

    A context's children are one symbol longer into the past. All contexts' own shorter ones must be there.
    """

    def __init__(self, contexts: np.ndarray, alphabet: np.ndarray):
        """contexts: sorted by depth is not needed; the empty context is added. alphabet: the symbols that are told apart."""
        self.size = len(alphabet) + 1  # 0: any other symbol
        self.code = np.zeros(ALL + 1, np.int32)
        self.code[alphabet + 1] = np.arange(1, self.size)
        contexts = np.unique(contexts[contexts > 0])
        fields = [(contexts >> np.uint64(BITS * d)).astype(np.int64) & ((1 << BITS) - 1) for d in range(6)]
        depth = sum((f > 0).astype(np.int64) for f in fields)
        order = np.lexsort((contexts, depth))
        self.keys = np.concatenate([np.zeros(1, np.uint64), contexts[order]])
        self.depths = np.concatenate([[0], depth[order]])
        self.most = int(self.depths.max())
        self.child = np.zeros(len(self.keys) * self.size, np.int32)
        self.parent = np.zeros(len(self.keys), np.int64)
        sorted_at = np.argsort(self.keys)
        for d in range(1, self.most + 1):
            at = np.flatnonzero(self.depths == d)
            up = self.keys[at] & np.uint64((1 << (BITS * (d - 1))) - 1)
            self.parent[at] = sorted_at[np.searchsorted(self.keys, up, sorter=sorted_at)]
            oldest = (self.keys[at] >> np.uint64(BITS * (d - 1))).astype(np.int64)
            self.child[self.parent[at] * self.size + self.code[oldest]] = at

    def find(self, contexts: np.ndarray) -> np.ndarray:
        """The node of each context, -1 if it isn't there."""
        order = np.argsort(self.keys)
        k = np.minimum(np.searchsorted(self.keys, contexts, sorter=order), len(self.keys) - 1)
        return np.where(self.keys[order[k]] == contexts, order[k], -1)

    def walk(self, codes: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The node of the longest context before each symbol, codes being self.code[symbols + 1]; of those at the places `at`, in order, if given."""
        node = np.zeros(len(codes), np.int32)
        at = np.arange(1, len(codes), dtype=np.int32) if at is None else at
        own = node[at]
        for d in range(1, self.most + 1):
            step = self.child[own * np.int32(self.size) + codes[at - d]]
            keep = np.flatnonzero(step)
            at, own = at[keep], step[keep]
            node[at] = own
            far = np.searchsorted(at, d + 1)
            at, own = at[far:], own[far:]
        return node
