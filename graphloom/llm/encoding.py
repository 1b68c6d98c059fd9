"""Token ids of whole texts, from the tokenizer files of the tokenizers library, with a bounded memo of parts.

Both pre-tokenizers never join across a boundary of white space and what follows, so a text's ids are its parts' ids
in a row. A part that was met before is looked up; the memo takes parts of at most 64 characters until it holds `limit`
of them, which by then are the frequent ones. New parts are encoded many at once, with a separator between them whose
id stands for nothing else. Texts with white space other than blank and line feed, and those that hold the literal of
an added token, are encoded whole.

Where the pre-tokenizer is the byte-level one, a word's letters and what follows them from a punctuation mark on never
share a token: both are looked up apart, so that a word is encoded once whatever follows it. Letters alone are one
token to the pre-tokenizer, so they go to the model as they are, without it. A part is looked at for odd characters only
when it is new, as those in the memo have none.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np

#: White space besides blank and line feed, in Python's wide sense.
ODD = re.compile(r"[^\S \n]")
#: A word with the blank before it, or white space without the blank that belongs to the next word.
PARTS = re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+")
#: A word of few letters (of blocks that no version of Unicode changes any more) with the blank before it, and all from a punctuation mark on.
WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]{1,63})([!-/:-@\[-^`{-~].*)?", re.DOTALL)
SLICE, TOGETHER = 256, 500


def _letters(own: list[int], other: int) -> np.ndarray:
    """The byte-level alphabet: bytes that stand for themselves, and letters from `other` on for the rest; a line feed becomes a blank, which is no letter of it."""
    out = np.zeros(256, dtype="<u2")
    rest = sorted({*range(256)} - {*own})
    out[own], out[rest] = own, other + np.arange(len(rest))
    out[ord("\n")] = ord(" ")
    return out


LETTERS = _letters([*range(33, 127), *range(161, 173), *range(174, 256)], 256)


def _by_bytes(tokenizer) -> bool:
    """Whether texts reach the model as bytes in the byte-level alphabet, parted by its own rule, and nothing else."""
    pre = tokenizer.pre_tokenizer
    if tokenizer.normalizer is not None or type(pre).__name__ != "ByteLevel" or type(tokenizer.model).__name__ != "BPE":
        return False
    state = json.loads(pre.__getstate__())
    return state["use_regex"] and not state["add_prefix_space"]


class Encoder:
    """Texts to ids as bytes of `dtype`. keeps_space: whether a word's ids depend on the blank before it."""

    def __init__(self, path: str, dtype: str, keeps_space: bool, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([ODD.pattern, *map(re.escape, added)]), re.IGNORECASE)
        self.dtype, self.limit, self.memo, self.width = dtype, limit, {}, np.dtype(dtype).itemsize
        self.split, self.mark, self.between = (PARTS.findall, "\n", "\n") if keeps_space else (str.split, "|", " | ")
        (self.between_id,) = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        apart = keeps_space and _by_bytes(self.tokenizer) and not re.search("[ \n]", "".join(added))
        self.spell = self.tokenizer.model.tokenize if apart else None

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [x.tobytes() for x in self._ids(texts)]

    def _apart(self, parts: list[str]) -> dict[str, bytes]:
        """Each part by itself; those without the separator's mark go together, TOGETHER at once."""
        alone = [p for p in parts if self.mark in p]
        found = dict(zip(alone, self._whole(alone)))
        rest = [p for p in parts if self.mark not in p]
        groups = [rest[at : at + TOGETHER] for at in range(0, len(rest), TOGETHER)]
        for group, ids in zip(groups, self._ids([self.between.join(g) for g in groups])):
            cut = np.flatnonzero(ids == self.between_id)
            if len(cut) != len(group) - 1:
                found.update(zip(group, self._whole(group)))
                continue
            raw, first, last = ids.tobytes(), [0, *(cut + 1) * self.width], [*cut * self.width, len(ids) * self.width]
            found.update((p, raw[a:b]) for p, a, b in zip(group, first, last))
        return found

    def _spelled(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters with or without a blank before them, by the model alone."""
        letters = LETTERS[np.frombuffer("\n".join(words).encode(), np.uint8)].tobytes().decode("utf-16-le")
        ids = [[t.id for t in self.spell(w)] for w in letters.split(" ")]
        raw, at = np.array([*chain.from_iterable(ids)], dtype=self.dtype).tobytes(), [0, *accumulate(len(x) * self.width for x in ids)]
        return {w: raw[a:b] for w, a, b in zip(words, at, at[1:])}

    def _keep(self, found: dict[str, bytes]) -> None:
        if len(self.memo) < self.limit:
            self.memo.update(x for x in found.items() if len(x[0]) <= 64)

    def _new(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts that are not in the memo."""
        if self.spell is None:
            found = self._apart(parts)
            self._keep(found)
            return found
        cut = {p: m.groups("") for p in parts if (m := WORD.fullmatch(p))}
        words, tails = {w for w, _ in cut.values()}, {t for _, t in cut.values() if t}
        known = {x: ids for x in words | tails if (ids := self.memo.get(x)) is not None}
        fresh = self._spelled(list(words - known.keys())) | self._apart([*(tails - known.keys()), *(p for p in parts if p not in cut)])
        both = {"": b""} | known | fresh
        found = fresh | {p: both[w] + both[t] for p, (w, t) in cut.items()}
        self._keep(fresh)
        self._keep({p: found[p] for p, (w, t) in cut.items() if t and w in known})  # most words met once only come with one tail
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        get, parts = self.memo.get, [None if self.spell is None and self.odd.search(t) else self.split(t) for t in texts]
        ids = [one and list(map(get, one)) for one in parts]
        gaps = [[i for i, x in enumerate(x) if x is None] if x and None in x else () for x in ids]
        new = {one[i] for one, gap in zip(parts, gaps) for i in gap}
        if self.spell is not None and self.odd.search("\n".join(new)):
            odd = {p for p in new if self.odd.search(p)}
            for k, (one, gap) in enumerate(zip(parts, gaps)):
                if any(one[i] in odd for i in gap):
                    parts[k], ids[k], gaps[k] = None, None, ()
            new = {one[i] for one, gap in zip(parts, gaps) for i in gap}
        found = self._new(list(new))
        for one, x, gap in zip(parts, ids, gaps):
            for i in gap:
                x[i] = found[one[i]]
        return [self._whole([t])[0] if x is None else b"".join(x) for t, x in zip(texts, ids)]


_made: dict[tuple, Encoder] = {}


def encoder(*args) -> Encoder:
    """One encoder for each Python worker, kept from task to task."""
    if args not in _made:
        _made[args] = Encoder(*args)
    return _made[args]


def slices(batches: Iterator, rows: int = SLICE) -> Iterator:
    """Arrow batches in slices of few rows, so that few texts at once are Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
