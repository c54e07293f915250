"""Suffix automata over sequences of values (word hashes, or anything hashable)."""

from __future__ import annotations


class SuffixAutomaton:
    """Online automaton of all runs of the sequences fed to it, one after the other.

    ``extend`` returns the matching statistic at the value just fed: the length of the longest run
    that ends there and also ended earlier, in an earlier sequence or earlier in this one."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last = 0

    def start(self) -> None:
        """Begin another sequence."""
        self.last = 0

    def _clone(self, p: int, value, q: int) -> int:
        new = len(self.length)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(value) == q:
            self.next[p][value] = new
            p = self.link[p]
        return new

    def extend(self, value) -> int:
        p = self.last
        q = self.next[p].get(value)
        if q is not None:  # an earlier sequence has the whole of this one so far
            if self.length[q] != self.length[p] + 1:
                q = self._clone(p, value, q)
            self.last = q
            return self.length[q]
        new = len(self.length)
        self.next.append({})
        self.length.append(self.length[p] + 1)
        self.link.append(0)
        while p >= 0 and value not in self.next[p]:
            self.next[p][value] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][value]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, value, q)
        self.last = new
        return self.length[self.link[new]]

    def feed(self, values) -> list[int]:
        """Another sequence: what ``extend`` returns for each of its values."""
        follow, link, length, out = self.next, self.link, self.length, []
        self.last = last = 0
        for value in values:
            if value in follow[last]:
                self.last = last
                out.append(self.extend(value))
                last = self.last
                continue
            new = len(length)
            follow.append({})
            length.append(length[last] + 1)
            p = last
            while p >= 0 and value not in follow[p]:
                follow[p][value] = new
                p = link[p]
            if p < 0:
                link.append(0)
                out.append(0)
            else:
                q = follow[p][value]
                link.append(0)
                link[new] = q = q if length[q] == length[p] + 1 else self._clone(p, value, q)
                out.append(length[q])
            last = new
        self.last = last
        return out

    def matches(self, values) -> list[int]:
        """Matching statistics of a sequence against the automaton as it is."""
        follow, link, length, state, size, out = self.next, self.link, self.length, 0, 0, []
        for value in values:
            while state and value not in follow[state]:
                state = link[state]
                size = length[state]
            if value in follow[state]:
                state, size = follow[state][value], size + 1
            out.append(size)
        return out
