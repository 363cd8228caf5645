"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, then blind tries.

The sort gives the order and, for each string, the length of the prefix it shares with the one before. Strings are
taken eight bytes at a time in the quicksort. Groups that still agree at the shallow depth share long prefixes, which
would be compared again and again; a blind trie (a Patricia trie that stores only branching depths) reads each string
about once.
"""

from __future__ import annotations

SHALLOW = 16
_STEP = 8


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - 1 - (x.bit_length() - 1) // 8


class _Node:
    __slots__ = ("depth", "kids", "leaf")

    def __init__(self, depth: int, leaf: list[int]):
        self.depth, self.leaf, self.kids = depth, leaf, None


def blind_trie_order(strings: list[bytes], group: list[int]) -> list[int]:
    """The places in ``group`` ordered by their strings; equal strings keep their order."""
    root = _Node(len(strings[group[0]]), [group[0]])
    for i in group[1:]:
        s, node = strings[i], root
        # blind descent: only branching bytes are looked at
        while node.kids is not None:
            byte = s[node.depth] if len(s) > node.depth else -1
            node = node.kids.get(byte) or next(iter(node.kids.values()))
        other = strings[node.leaf[0]]
        if other == s:
            node.leaf.append(i)
            continue
        shared = common_prefix(s, other)
        # the place where the new branch leaves the path
        up, node = None, root
        while node.kids is not None and node.depth < shared:
            up, node = node, node.kids[s[node.depth] if len(s) > node.depth else -1]
        leaf = _Node(len(s), [i])
        mine = s[shared] if len(s) > shared else -1
        if node.kids is not None and node.depth == shared:
            node.kids[mine] = leaf
            continue
        theirs = other[shared] if len(other) > shared else -1
        fork = _Node(shared, [])
        fork.kids = {mine: leaf, theirs: node}
        if up is None:
            root = fork
        else:
            up.kids[s[up.depth] if len(s) > up.depth else -1] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.kids is None:
            out += node.leaf
        else:
            stack += [node.kids[k] for k in sorted(node.kids, reverse=True)]
    return out


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """The places of ``strings`` in sorted order, and each one's shared prefix with the one before (0 for the first)."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out += group
        elif depth >= shallow:
            out += blind_trie_order(strings, group)
        else:
            words = [strings[i][depth : depth + _STEP] for i in group]
            pivot = words[len(words) // 2]
            less = [i for i, w in zip(group, words, strict=True) if w < pivot]
            same = [i for i, w in zip(group, words, strict=True) if w == pivot]
            more = [i for i, w in zip(group, words, strict=True) if w > pivot]
            stack.append((more, depth))
            # strings that end within the word are equal
            stack.append((same, depth + _STEP if len(pivot) == _STEP else shallow))
            stack.append((less, depth))
    shared = [0] * len(out)
    for k in range(1, len(out)):
        shared[k] = common_prefix(strings[out[k - 1]], strings[out[k]])
    return out, shared
