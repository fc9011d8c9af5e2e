"""A run-length index of repetitive texts: runs of the Burrows-Wheeler transform with samples at their ends."""

from __future__ import annotations

import numpy as np


def suffix_order(data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in order of their suffixes, which end with their text; bytes left at each place).

    Seven bytes at first, then doubled; only groups that are not yet apart are sorted again. Equal suffixes of
    different texts stand in the order of the texts, as end marks of their own would order them."""
    n, ends = len(data), np.cumsum(length)
    left = np.repeat(ends, length) - np.arange(n)
    room = np.concatenate([data.astype(np.uint64), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):  # seven bytes, then how many there are: a suffix that ends here stands before those that go on
        key = (key << np.uint64(8)) | np.where(left > k, room[k : k + n], np.uint64(0))
    key = (key << np.uint64(8)) | np.minimum(left, 8).astype(np.uint64)
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # first row of the suffixes that are equal so far
    rank, todo, done = np.empty(n, np.int64), np.arange(n), 7
    rank[order] = group
    del key, sorted_key, room, new
    while len(todo):
        # rows of groups of two or more whose suffixes go on behind what has been compared
        inner = group[todo]
        twin = inner[1:] == inner[:-1]
        todo = todo[(np.r_[twin, False] | np.r_[False, twin]) & (left[order[todo]] > done)]
        at, head = order[todo], group[todo]
        ahead = rank[at + done]
        by = np.argsort(head * n + ahead)
        at, ahead = at[by], ahead[by]
        order[todo] = at
        new = np.r_[True, (head[1:] != head[:-1]) | (ahead[1:] != ahead[:-1])][: len(todo)]
        group[todo] = todo[np.maximum.accumulate(np.where(new, np.arange(len(todo)), 0))]
        rank[at] = group[todo]
        done *= 2
    twin = group[1:] == group[:-1]
    equal = np.flatnonzero(np.r_[twin, False] | np.r_[False, twin])
    order[equal] = order[equal][np.argsort(group[equal] * n + order[equal])]
    return order, left


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that data[a:] and data[b:] have in common, up to `most` of each pair; eight at a time."""
    room = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(room) - 7,), "<u8", room, strides=(1,))
    out, live = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
    while len(live):
        x = eight[a[live] + out[live]] ^ eight[b[live] + out[live]]
        low = x & (~x + np.uint64(1))
        equal = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        out[live] += equal
        live = live[(equal == 8) & (out[live] < most[live])]
    return np.minimum(out, most)


class RunIndex:
    """Run heads and tails of the transform, with their places, and what each shares with its neighbour in order."""

    def __init__(self, data: np.ndarray, length: np.ndarray):
        order, self.left = suffix_order(data, length)
        n, first = len(data), np.zeros(len(data), bool)
        first[np.cumsum(length) - length] = True
        before = np.where(first[order], -1 - order, data[order - 1].astype(np.int64))  # an end mark of its own for each text
        self.head = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])  # row of each run
        self.runs = before[self.head]
        heads = self.head[1:]
        a, b = order[heads], order[heads - 1]
        shared = common_prefix(data, a, b, np.minimum(self.left[a], self.left[b]))
        self.n = n
        # samples: the first place of a run shares this much with the row before it, the last place with the row behind
        self.head_place, self.tail_place, self.shared = a, b, shared

    def statistics(self) -> np.ndarray:
        """For each place, the length of its longest match elsewhere. Between samples a match loses one byte a step,
        for inside a run the neighbours of the next place are the steps of these neighbours."""
        out = np.zeros(self.n, np.int64)
        for place in (self.head_place, self.tail_place):
            reach = np.zeros(self.n, np.int64)
            reach[place] = self.shared + place
            np.maximum.accumulate(reach, out=reach)
            np.maximum(out, reach - np.arange(self.n), out=out)
        return np.minimum(out, self.left)
