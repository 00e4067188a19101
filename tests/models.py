"""Small sequential models of the stream rules, written from the blueprint; the
distributed operators must agree with them on random input."""

from __future__ import annotations


def parse_words(data: bytes):
    pos, words, dropped = 0, [], 0
    while len(data) - pos >= 2:
        v = data[pos] | data[pos + 1] << 8
        if v & 0xF000:
            dropped += 1
            pos += 1
        else:
            words.append(v)
            pos += 2
    return words, dropped


def sync(words, wps, syncs):
    """(pos, subframe, valid) of every delivered subframe."""
    index = {s: i + 1 for i, s in enumerate(syncs)}
    out, cursor, n = [], 0, len(words)
    while True:
        at = next((p for p in range(cursor, n - wps) if words[p] in index
                   and index.get(words[p + wps]) == index[words[p]] % 4 + 1), None)
        if at is None:
            return out
        sf = index[words[at]]
        while True:
            if n - at < wps:
                return out
            if words[at] != syncs[sf - 1]:
                out.append((at, sf, False))
                cursor = at + 1
                break
            out.append((at, sf, True))
            at, sf = at + wps, sf % 4 + 1


class Assembler:
    """Rows (subframe, valid, frame id) → arrivals."""

    def __init__(self):
        self.number, self.out = 0, []
        self.fresh()

    def fresh(self):
        self.slots, self.expected = ["PENDING"] * 4, 1

    def close(self, seq):
        self.slots = ["MISSING" if s == "PENDING" else s for s in self.slots]
        self.out.append((seq, 0, self.number, 0, "MISSING", tuple(self.slots), True))
        self.number += 1
        self.fresh()

    def take(self, seq, sf, valid, fid=None):
        state = "RECEIVED" if valid else "INVALID"
        if fid is not None:
            if fid != self.number and self.expected != 1:
                self.close(seq)
                self.number = fid
            elif self.expected == 1:
                self.number = fid
        if sf < self.expected:
            if self.slots[sf - 1] == "MISSING":
                return self.store(seq, sf, "LATE" if state == "RECEIVED" else state)
            self.close(seq)
        else:
            for k in range(self.expected, sf):
                self.slots[k - 1] = "MISSING"
        self.store(seq, sf, state)

    def store(self, seq, sf, state):
        self.slots[sf - 1] = state
        self.expected = max(self.expected, sf + 1)
        done = self.expected > 4
        self.out.append((seq, 1, self.number, sf, state, tuple(self.slots), done))
        if done:
            self.number += 1
            self.fresh()
