"""Suffix automata over words, for matching statistics against a reference."""

from __future__ import annotations


class SuffixAutomaton:
    """All substrings of some sequences; each state knows the smallest label of the sequences it occurs in."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.label = [-1], [0], [None]
        self.last = 0

    def add(self, words: list, label: int) -> None:
        """Append a sequence; a separator of its own keeps matches within one sequence."""
        nxt, link, length, least = self.next, self.link, self.len, self.label
        last = self.last
        for word in [*words, ("end", len(nxt))]:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            least.append(label)
            p = last
            while p >= 0 and word not in nxt[p]:
                nxt[p][word] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][word]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    least.append(None)
                    while p >= 0 and nxt[p].get(word) == q:
                        nxt[p][word] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.last = last

    def close(self) -> SuffixAutomaton:
        """Hand the labels up the suffix links."""
        link, length, least = self.link, self.len, self.label
        for v in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
            up, x = link[v], least[v]
            if up > 0 and x is not None and (least[up] is None or x < least[up]):
                least[up] = x
        return self

    def windows(self, words: list, size: int) -> list:
        """The smallest label of each run of ``size`` words (None: it doesn't occur), from matching statistics."""
        nxt, link, length, least = self.next, self.link, self.len, self.label
        v, m, out = 0, 0, []
        for i, word in enumerate(words):
            while v and word not in nxt[v]:
                v = link[v]
                m = length[v]
            if word in nxt[v]:
                v = nxt[v][word]
                m += 1
            if i + 1 >= size:
                if m < size:
                    out.append(None)
                else:
                    u = v
                    while length[link[u]] >= size:
                        u = link[u]
                    v, m = u, min(m, length[u])  # no longer match is of interest
                    out.append(least[u])
        return out
