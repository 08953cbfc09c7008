"""Enhanced suffix arrays: common-prefix intervals and maximal repeat groups, inside one task."""

from __future__ import annotations

from collections.abc import Iterator


def lcp_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every node of the common-prefix interval tree, children first.

    ``lcp[i]`` is what the i-th and the one before it in sorted order share; ``lcp[0]`` is not read.
    """
    n = len(lcp)
    stack = [(0, 0)]
    for i in range(1, n + 1):
        depth = lcp[i] if i < n else -1
        left = i - 1
        while stack and depth < stack[-1][0]:
            top, left = stack.pop()
            yield top, left, i - 1
        if i < n and (not stack or depth > stack[-1][0]):
            stack.append((depth, left))


class Strings:
    """Byte strings with quick common prefixes."""

    def __init__(self, strings: list[bytes]):
        self.width = max(map(len, strings), default=0)
        self.lengths = list(map(len, strings))
        self.numbers = [int.from_bytes(s.ljust(self.width, b"\0"), "big") for s in strings]

    def common(self, i: int, j: int) -> int:
        same = self.width - (((self.numbers[i] ^ self.numbers[j]).bit_length() + 7) >> 3)
        return min(same, self.lengths[i], self.lengths[j])


def maximal_repeats(before: list[bytes], after: list[bytes], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before, bytes after, all occurrences) of every maximal repeat of ``least`` bytes or more.

    Each place has the text ``after`` it (its suffix) and the text ``before`` it, last byte first.
    The suffixes are sorted; every interval of the common-prefix tree is right-maximal. Within an
    interval the left extensions are sorted likewise: their intervals are where the preceding bytes
    stop being the same, so a group that could be extended to the left by one byte is never given.
    """
    n = len(after)
    suffixes, lefts = Strings(after), Strings(before)
    by_suffix = sorted(range(n), key=after.__getitem__)
    rank = [0] * n
    for r, i in enumerate(sorted(range(n), key=before.__getitem__)):
        rank[i] = r
    reach = lefts.width
    shared = [0] + [suffixes.common(a, b) for a, b in zip(by_suffix, by_suffix[1:])]
    for depth, first, last in lcp_intervals(shared):
        if depth + reach < least or first == last:
            continue
        group = sorted(by_suffix[first:last + 1], key=rank.__getitem__)
        left = [0] + [lefts.common(a, b) for a, b in zip(group, group[1:])]
        if depth + max(left) < least:
            continue
        for extension, a, b in lcp_intervals(left):
            if a < b and depth + extension >= least:
                yield extension, depth, group[a:b + 1]


def covered_by_earlier(before: list[bytes], after: list[bytes], least: int) -> dict[int, tuple[int, int]]:
    """{place: (bytes before, bytes after)} that repeats of an earlier place cover; places are in text order.

    All spans of a place hold the place itself, so together they are one span.
    """
    if len(after) == 2:  # nearly all groups are pairs
        extension, depth = Strings(before).common(0, 1), Strings(after).common(0, 1)
        return {1: (extension, depth)} if extension + depth >= least else {}
    best: dict[int, tuple[int, int]] = {}
    for extension, depth, group in maximal_repeats(before, after, least):
        first = min(group)
        for place in group:
            if place != first:
                old = best.get(place, (0, 0))
                best[place] = (max(extension, old[0]), max(depth, old[1]))
    return best
