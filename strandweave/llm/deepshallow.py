"""Deep-shallow suffix sorting: multikey quicksort to a shallow depth, blind tries for what is left.

Works on a numpy batch of byte strings that already belong to groups; all groups are sorted at once.
"""

from __future__ import annotations

import numpy as np

WORDS = 4  # shallow depth in 8-byte characters


def matrix(strings: list[bytes], width: int) -> np.ndarray:
    """Strings as rows of bytes, cut or padded with zeros to `width`."""
    raw = b"".join([s[:width].ljust(width, b"\0") for s in strings])
    return np.frombuffer(raw, np.uint8).reshape(len(strings), width)


def multikey_quicksort(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Order of the rows by group, then words; and the runs that are equal in all words.

    group is sorted. Each round splits every open segment three ways around its own pivot, at its own
    depth: lower and higher rows stay at that depth, equal rows go one word deeper.
    """
    n, depths = words.shape
    order = np.arange(n)
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    start, size, depth = edges, np.diff(np.append(edges, n)), np.zeros(len(edges), np.int64)
    ties: list[tuple[int, int]] = []
    while True:
        start, size, depth = (x[size > 1] for x in (start, size, depth))
        deep = depth == depths
        ties += zip(start[deep].tolist(), (start + size)[deep].tolist(), strict=True)
        start, size, depth = (x[~deep] for x in (start, size, depth))
        if not len(start):
            return order, ties
        seg = np.repeat(np.arange(len(start)), size)
        at = np.arange(len(seg)) - np.repeat(np.cumsum(size) - size, size) + start[seg]
        row = order[at]
        w = words[row, depth[seg]]
        three = np.sort(np.stack([words[order[start + f], depth] for f in (0 * size, size // 2, size - 1)]), axis=0)
        side = (w >= three[1][seg]).astype(np.int64) + (w > three[1][seg])
        key = seg * 3 + side
        order[at] = row[np.argsort(key, kind="stable")]
        parts = np.bincount(key, minlength=3 * len(start))
        begin = np.repeat(start, 3) + (np.cumsum(parts) - parts) - np.repeat(np.cumsum(size) - size, 3)
        start, size, depth = begin, parts, np.repeat(depth, 3) + np.tile([0, 1, 0], len(start))


class BlindTrie:
    """A trie that keeps only branching depths; a string is compared in full once, with the leaf a blind descent reaches."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _at(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    @staticmethod
    def common(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
        return n - (x.bit_length() + 7) // 8

    def insert(self, s: bytes, row: int) -> None:
        if self.root is None:
            self.root = (s, [row])
            return
        node = self.root
        while isinstance(node[0], int):
            node = node[1].get(self._at(s, node[0])) or next(iter(node[1].values()))
        same = self.common(s, node[0])
        if same == len(s) == len(node[0]):
            node[1].append(row)
            return
        branch = self._at(node[0], same)
        above, node, key = None, self.root, None
        while isinstance(node[0], int) and node[0] < same:
            above, key = node, self._at(s, node[0])
            node = node[1][key]
        if isinstance(node[0], int) and node[0] == same:
            node[1][self._at(s, same)] = (s, [row])
            return
        fork = (same, {branch: node, self._at(s, same): (s, [row])})
        if above is None:
            self.root = fork
        else:
            above[1][key] = fork

    def rows(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node[0], int):
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out += node[1]
        return out


def suffix_order(group: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Rows ordered by group (sorted on input), then by their string."""
    words = matrix(strings, 8 * WORDS).view(">u8").astype(np.uint64)
    order, ties = multikey_quicksort(group, words)
    for a, b in ties:
        trie = BlindTrie()
        for row in order[a:b].tolist():
            trie.insert(strings[row], row)
        order[a:b] = trie.rows()
    return order


def neighbours_common(order: np.ndarray, group: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Common prefix of each ordered row with the one before it; -1 for the first of a group."""
    out = np.full(len(order), -1, np.int64)
    size = np.array([len(s) for s in strings], np.int64)
    width = int(size.max(initial=1))
    step = max(1, (8 << 20) // width)
    for a in range(1, len(order), step):
        b = min(len(order), a + step)
        m = matrix([strings[i] for i in order[a - 1 : b].tolist()], width)
        differ = m[1:] != m[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out[a:b] = np.minimum(first, np.minimum(size[order[a:b]], size[order[a - 1 : b - 1]]))
    out[np.concatenate([[True], group[order][1:] != group[order][:-1]])] = -1
    return out
