"""Cutting texts into pre-tokens, with a memo per word whose memory is bounded in bytes.

``public_tokenizers.PATTERN`` never lets a match cross a place where a character
that is no white space is followed by one space and another such character.  A
text can thus be cut at those places, and the matches of each cut depend on it
alone, so they are remembered by the cut.  All words that are new in a slice of
texts are joined by spaces and matched in one go: a match that starts with a
space starts a word.
"""

from __future__ import annotations

import regex

#: What both memos of a process may hold, and the longest word that is remembered.
MOST_BYTES, LONGEST = 144 << 20, 64


class Memo:
    """A dict in two generations: what the older one holds and nobody asks for goes when the younger one is full."""

    def __init__(self, most: int):
        self.half, self.size = most // 2, 0
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def turn(self) -> None:
        """To be called between slices: what is asked for within one stays."""
        if self.size > self.half:
            self.old, self.young, self.size = self.young, {}, 0

    def missing(self, keys: set[str]) -> set[str]:
        """The keys that neither generation holds; those of the older one become young."""
        lost = keys - self.young.keys()
        if again := lost & self.old.keys():
            old = self.old
            self.put({k: old[k] for k in again})
            lost -= again
        return lost

    def put(self, found: dict[str, bytes | None]) -> None:
        self.young.update(found)
        # 200 bytes an entry for the two objects and their places, besides what they hold
        self.size += 200 * len(found) + sum(map(len, found)) + sum(map(len, filter(None, found.values())))

    def forget(self, keys: set[str]) -> None:
        for k in keys:
            del self.young[k]

    def clear(self) -> None:
        self.young, self.old, self.size = {}, {}, 0


class WordMemo:
    """Encodes texts to bytes through ``encode_many(list of word strings) -> list of bytes``."""

    def __init__(self, pattern: str, encode_pieces, most: int = MOST_BYTES):
        self.find = regex.compile(pattern).findall
        self.encode_pieces = encode_pieces
        self.words, self.pieces = Memo(most * 2 // 3), Memo(most // 3)

    def _encoded(self, pieces: set[str]) -> dict[str, bytes]:
        """Encodings of the pieces, and of whatever else is young; long ones are not remembered."""
        new = list(self.pieces.missing(pieces))
        if not new:
            return self.pieces.young
        found = dict(zip(new, self.encode_pieces(new), strict=True))
        if max(map(len, new)) > LONGEST:
            short = {p: x for p, x in found.items() if len(p) <= LONGEST}
            self.pieces.put(short)
            return found | {p: self.pieces.young[p] for p in pieces - found.keys()}
        self.pieces.put(found)
        return self.pieces.young

    def _learn(self, new: set[str]) -> set[str]:
        """Takes up words as they follow a space; returns those to be forgotten after this slice.

        A word that is empty, or starts or ends with white space, is remembered as None.
        """
        plain = [w for w in new if w and not (w[0].isspace() or w[-1].isspace())]
        found: dict[str, bytes | None] = {}
        if plain:
            cut = self.find(" " + " ".join(plain))
            got = self._encoded(set(cut))
            flat = [got[p] for p in cut]
            starts = [i for i, p in enumerate(cut) if p[0] == " "]
            if len(starts) == len(cut):
                found = dict(zip(plain, flat, strict=True))
            else:
                ends = [*starts[1:], len(cut)]
                found = {w: flat[a] if b - a == 1 else b"".join(flat[a:b]) for w, a, b in zip(plain, starts, ends, strict=True)}
        if len(plain) < len(new):
            found |= dict.fromkeys(new.difference(plain))
        self.words.put(found)
        return {w for w in new if len(w) > LONGEST}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The encodings of whole texts, in order."""
        self.words.turn()
        self.pieces.turn()
        heads, words, seen = [], [], set()
        for t in texts:
            s = t.split(" ")
            heads.append(s[0])
            del s[0]
            words.append(s)
            seen.update(s)
        long = self._learn(self.words.missing(seen))
        get = self.words.young.__getitem__
        parts: list[list[bytes] | list[str]] = []
        plain = []
        for h, s in zip(heads, words):
            got = list(map(get, s))
            plain.append(bool(h) and not h[-1].isspace() and None not in got)
            parts.append(got if plain[-1] else _runs([h, *s]))
        cut = [self.find(h) if ok else [p for r in x for p in self.find(r)] for h, ok, x in zip(heads, plain, parts)]
        enc = self._encoded({p for c in cut for p in c})
        out = [b"".join([enc[p] for p in c] + (x if ok else [])) for c, ok, x in zip(cut, plain, parts)]
        self.words.forget(long)
        return out


def _runs(words: list[str]) -> list[str]:
    """The parts of a text split at spaces, joined again where a cut would split a run of white space."""
    parts: list[str] = []
    run = [words[0]]
    for prev, w in zip(words, words[1:]):
        if prev and w and not prev[-1].isspace() and not w[0].isspace():
            parts.append(" ".join(run))
            run = ["", w]
        else:
            run.append(w)
    parts.append(" ".join(run))
    return parts
