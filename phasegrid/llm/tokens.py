"""Token ids of whole texts by a public byte-level tokenizer, with a cache of its pieces that is bounded in bytes."""

from __future__ import annotations

import re
import string
import struct
from functools import lru_cache
from itertools import islice

import numpy as np

#: Bytes in each of the two generations of the cache of pieces (that of pieces without a space in front has a quarter), with ENTRY for what a piece takes besides its text and ids.
ROOM, ENTRY = 192 << 20, 200
#: Longer pieces recur too seldom to be kept.
LONGEST = 64
#: A space whose next character isn't white space: no token crosses it from the left.
_CUT = re.compile(r" (?=\S)")
_WHITE = re.compile(r"\s")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Cache(dict):
    """ids by piece. What wasn't used for a generation is forgotten."""

    def __init__(self, room: int):
        super().__init__()
        self.room = self.left = room
        self.old: dict[str, bytes] = {}

    def learn(self, made: dict[str, bytes]) -> None:
        """Keeps the pieces of made that aren't too long."""
        if max(map(len, made), default=0) > LONGEST:
            made = {k: v for k, v in made.items() if len(k) <= LONGEST}
        for at in range(0, len(made), 32):
            some = dict(islice(made.items(), at, at + 32)) if len(made) > 32 else made
            cost = sum(map(len, some)) + sum(map(len, some.values())) + ENTRY * len(some)
            if cost > self.left:
                self.old, self.left = dict(self), self.room
                self.clear()
            self.left -= cost
            self.update(some)

    def find(self, pieces: list[str]) -> tuple[dict[str, bytes], list[str]]:
        """What either generation has of the pieces, and the rest; what the old one has moves to the new."""
        known = {p: ids for p in pieces if (ids := self.get(p)) is not None}
        left = [p for p in pieces if p not in known] if known else pieces
        moved = {p: ids for p in left if (ids := self.old.get(p)) is not None}
        if moved:
            self.learn(moved)
            left = [p for p in left if p not in moved]
        return known | moved, left


class Encoder:
    """ids of a text as little-endian unsigned 32-bit integers, equal to those of the tokenizer for the whole text.

    The vocabulary's pre-tokenizer ends a piece before a space that a word follows, around a lone line feed, and between letters or digits
    and the punctuation after them. So a text is cut there; pieces recur, and those that the cache doesn't hold go to the tokenizer together, one a line. The
    vocabulary's special tokens, spelled out in a text, are the library's special ids; with plain=True they are text like any other.
    """

    def __init__(self, path: str | None = None, plain: bool = False, room: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.tokenizer.encode_special_tokens = plain
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain and t.special)]
        #: By piece: after a space, or after a line feed if the piece begins with one; and without either.
        room = room or ROOM
        self.pieces, self.first, self.feed = _Cache(room), _Cache(room // 4), self._direct("\n")

    def _direct(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _together(self, texts: list[str]) -> list[bytes]:
        """ids of each of some texts. Those without white space, but for a space in front, are encoded as lines of one text."""
        found: list[bytes] = []
        for at in range(0, len(texts), 512):
            some = texts[at : at + 512]
            text = "\n".join(some)
            if len(self.feed) == 4 and len(text.split()) == len(some):
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                ends = np.flatnonzero(ids == np.frombuffer(self.feed, "<u4")[0]).tolist()
                if len(ends) == len(some) - 1:
                    raw, starts = ids.tobytes(), [0, *(e + 1 for e in ends)]
                    found += [raw[4 * a : 4 * b] for a, b in zip(starts, [*ends, len(ids)])]
                    continue
            found += map(self._direct, some)
        return found

    def _learn(self, missing: set[str], heads: set[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """ids of pieces, put together from their parts, and of heads, which nothing precedes. What is new to the tokenizer goes there at once."""
        made, new = self.pieces.find(list(missing))
        spaced, bare, parts = {p for p in new if p[-1].isalnum() and p[0] != "\n"}, set(heads), []
        for piece in new:
            if piece in spaced:
                continue
            lead, word = ("\n", piece[1:]) if piece[0] == "\n" else (" ", piece)
            stem = word.rstrip(string.punctuation)
            stem, rest = (stem, word[len(stem) :]) if stem and stem != word and (stem[-1].isalpha() or stem[-1].isdecimal()) else (word, "")
            parts.append((piece, lead, stem, rest))
            (spaced if lead == " " else bare).add(stem)
            if rest:
                bare.add(rest)
        (after, some), (first, others) = self.pieces.find(list(spaced)), self.first.find(list(bare))
        if some or others:
            got = self._together([*(" " + w for w in some), *others])
            for cache, words, known, at in ((self.pieces, some, after, 0), (self.first, others, first, len(some))):
                learnt = dict(zip(words, got[at : at + len(words)]))
                cache.learn(learnt)
                known |= learnt
        if parts:
            whole = {piece: (after[stem] if lead == " " else self.feed + first[stem]) + (first[rest] if rest else b"") for piece, lead, stem, rest in parts}
            self.pieces.learn(whole)
            after |= whole
        return made | after, first

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[bytes]:
        """ids of each of some texts."""
        out, waiting, missing, heads = [b""] * len(texts), [], set(), set()
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(s in text for s in self.special):
                out[i] = self._direct(text)
                continue
            head, *parts = text.replace("\n", " \n").split(" ")
            found = list(map(self.pieces.get, parts))
            new = {p for p, ids in zip(parts, found) if ids is None} if None in found else ()
            if not head or head[0].isspace() or any(not p or p == "\n" or (p[1] if p[0] == "\n" else p[0]).isspace() for p in new):
                out[i] = self._runs(text)
                continue
            missing.update(new)
            heads.add(head)
            waiting.append((i, head, parts, found, bool(new)))
        made, first = self._learn(missing, heads)
        for i, head, parts, found, new in waiting:
            out[i] = first[head] + b"".join([made[p] if ids is None else ids for p, ids in zip(parts, found)] if new else found)
        return out

    def _runs(self, text: str) -> bytes:
        """The same for texts with runs of white space, which stay with the piece before them."""
        head, *parts = _CUT.split(text)
        out = [self._direct(head)] if head else []
        known = list(map(self.pieces.get, parts))
        hard = {p for p, ids in zip(parts, known) if ids is None}
        easy = {p for p in hard if not _WHITE.search(p)}
        made = {p: self._direct(" " + p) for p in hard - easy} | self._learn(easy, set())[0]
        return b"".join(out + [made[p] if ids is None else ids for p, ids in zip(parts, known)])


@lru_cache(maxsize=2)
def encoder(path: str | None = None, plain: bool = False, room: int | None = None) -> Encoder:
    """One encoder for each worker and vocabulary; tasks that follow find its cache filled. Without a path, the worker finds the default."""
    return Encoder(path, plain, room)
