"""Deep-shallow ordering of suffixes, cut at a depth, in numpy.

Shallow: a multikey quicksort whose characters are eight bytes wide. Each pass sorts the suffixes
that are still tied by their next eight bytes and splits the ties, down to ``SHALLOW`` bytes.

Deep: the groups still tied hold long common prefixes, for which more passes would mostly compare
equal bytes. Each becomes a blind trie, built for all groups level by level: a node keeps only the
depth at which its suffixes first differ from its leader and branches on the byte there; the bytes
in between are skipped. A node without a difference before the cut is a leaf: its suffixes are equal.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 24


def padded(parts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts joined, with room behind for reading eight bytes anywhere, and their starts."""
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    text = np.zeros(int(at[-1]) + depth + 16, np.uint8)
    text[: at[-1]] = np.frombuffer(b"".join(parts), np.uint8)
    return text, at


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, as numbers that sort like the bytes."""
    view = np.ndarray((len(text) - 7,), ">u8", text, 0, (1,))
    return view[at].astype(np.uint64)


def _split(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order within the groups by key, and the new groups' numbers in that order."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.concatenate([[False], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])
    return order, np.cumsum(new)


def _tied(group: np.ndarray) -> np.ndarray:
    """Which members (groups in a row) are not alone in their group."""
    same = np.concatenate([[False], group[1:] == group[:-1], [False]])
    return same[1:] | same[:-1]


def equal_suffixes(text: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of the classes of at least two suffixes that agree in their first ``depth`` bytes.

    Returns their indices into ``start``, classes in a row, and the class number of each.
    """
    if len(start) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    member = np.arange(len(start))
    group = np.zeros(len(start), np.int64)
    shallow = min(SHALLOW, depth // 8 * 8)
    for d in range(0, shallow, 8):
        order, group = _split(group, _words(text, start[member] + d))
        member = member[order]
        keep = _tied(group)
        member, group = member[keep], group[keep]
        if not len(member):
            return member, group
    done_member, done_group, classes = [], [], 0
    while len(member):
        head = np.concatenate([[True], group[1:] != group[:-1]])
        number = np.cumsum(head) - 1
        leader = start[member[np.flatnonzero(head)]][number]
        place = start[member]
        # first byte at which each member differs from its group's leader
        differs = np.full(len(member), depth, np.int64)
        open_ = np.arange(len(member))
        for d in range(shallow, depth, 8):
            x = _words(text, place[open_] + d) ^ _words(text, leader[open_] + d)
            hit = np.flatnonzero(x)
            if len(hit):
                # the highest byte of the exclusive-or that is set (compared bytewise, no float logs)
                v = x[hit].astype(">u8").view(np.uint8).reshape(-1, 8)
                differs[open_[hit]] = np.minimum(d + (v != 0).argmax(1), depth)
                open_ = open_[x == 0]
            if not len(open_):
                break
        branch = np.minimum.reduceat(differs, np.flatnonzero(head))[number]
        leaf = branch >= depth
        if leaf.any():
            done_member.append(member[leaf])
            done_group.append(number[leaf] + classes)
            classes += int(number[-1]) + 1
        member, number, branch = member[~leaf], number[~leaf], branch[~leaf]
        if not len(member):
            break
        order, group = _split(number, text[start[member] + branch].astype(np.int64))
        member = member[order]
        keep = _tied(group)
        member, group = member[keep], group[keep]
    if not done_member:
        none = np.zeros(0, np.int64)
        return none, none
    return np.concatenate(done_member), np.concatenate(done_group)
