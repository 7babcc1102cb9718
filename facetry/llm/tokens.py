"""Token ids of whole texts, unit by unit.

A text whose only white space is single spaces and newlines is cut before every space and around every
newline, and a final comma or full stop is cut off a letter (if the tokenizer cuts there after that letter).  Both vocabularies used here split texts at such
places anyway, so the ids of the units, joined, are the ids of the whole text; a unit that was met before is
looked up.  Units are numbered once for all texts of a call, so only different ones are looked up, and ids are put
together by taking from one array.  Any other text is encoded whole.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Units a Python worker keeps in each of two generations; when the younger one is full, the older one goes.
CACHE_UNITS = 250_000
#: Units that are encoded in one call.
CALL_UNITS = 20_000
_OTHER_SPACE = re.compile("[\t\r\0\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _whole(text: str) -> bool:
    """Whether a text must not be cut."""
    return (
        "  " in text
        or " \n" in text
        or "\n\n" in text
        or "<|" in text
        or text.endswith(" ")
        or _OTHER_SPACE.search(text) is not None
    )


#: Words of these letters are one piece to the tokenizers' splitting rules and change case letter by letter.
_LATIN = re.compile("\x20?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + n) for n, b in enumerate(rest)}


# words hold no newline, so many of them are spelled at once, a newline between them
_SPELLED = np.array([ord(_byte_letters().get(b, chr(b))) if b != 10 else 10 for b in range(256)], "<u2")


def _spelled(words: str) -> list[str]:
    return _SPELLED[np.frombuffer(words.encode(), np.uint8)].tobytes().decode("utf-16-le").split("\n")


def _as_written(words: list[str]) -> list[str]:
    return _spelled("\n".join(words))


def _folded(words: list[str]) -> list[str]:
    return _spelled("\n".join(words).replace(" ", "").lower())


def _units(texts: list[bytes]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Number of every unit, the different units by number, and how many units lie before each text and at the end."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    newline = data == 10
    first = newline | (data == 32)
    first[1:] |= newline[:-1]
    first[ends[:-1][ends[:-1] < len(data)]] = True
    first[:1] = True
    begin = np.flatnonzero(first)
    offsets = pa.py_buffer(np.append(begin, len(data)).astype(np.int64))
    units = pa.LargeStringArray.from_buffers(len(begin), offsets, pa.py_buffer(data)).dictionary_encode()
    return units.indices.to_numpy(), units.dictionary.to_numpy(zero_copy_only=False).tolist(), np.searchsorted(begin, np.append(0, ends))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encode_all(texts)``: the ids of each text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.ends: dict[str, bool] = {}
        self.marks = {m: self._alone([m])[0] for m in ",."}
        # single words can go to the merge rules directly, in the spelling this vocabulary uses for them
        self.model, probes = self.tokenizer.model, [" Hello", "\u00dcber", " stra\u00dfe", " x", "Q"]
        fits = lambda f: [self._word(u) for u in f(probes)] == self._alone(probes)
        self.spelling = next((f for f in (_as_written, _folded) if fits(f)), None)

    def _word(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _alone(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in done]

    def _ends_word(self, letter: str) -> bool:
        """Whether a mark after this letter is a piece of its own; not where normalisation leaves a combining mark last."""
        if letter not in self.ends:
            pairs = self._alone([letter, *[letter + m for m in self.marks]]) if letter.isalpha() else []
            self.ends[letter] = bool(pairs) and all(b == pairs[0] + self.marks[m] for m, b in zip(self.marks, pairs[1:]))
        return self.ends[letter]

    def _together(self, units: list[str]) -> list[bytes]:
        """Ids of units that begin with a space, or before which a newline is put, encoded as one text."""
        out = []
        for k in range(0, len(units), CALL_UNITS):
            part = [u if u[0] == " " else f"\n{u}" for u in units[k : k + CALL_UNITS]]
            done = self.tokenizer.encode("".join(part), add_special_tokens=False)
            ids = np.array(done.ids, "<u4").tobytes()
            first = np.fromiter((o[0] for o in done.offsets), np.int64, len(done.offsets))
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
            own = np.concatenate([[0], ends[:-1]]) + np.fromiter((u[0] == "\n" for u in part), np.int64, len(part))
            begin, end = 4 * np.searchsorted(first, own, "left"), 4 * np.searchsorted(first, ends, "left")
            out += [ids[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        return out

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of different units that the younger generation lacks."""
        known = list(map(self.old.get, missing))
        again = {u: k for u, k in zip(missing, known) if k is not None}
        rest = [u for u, k in zip(missing, known) if k is None]
        tailed = [u for u in rest if u[-1] in ",." and self._ends_word(u[-2:-1])]
        fresh = set(rest).difference(tailed)
        for base in {u[:-1] for u in tailed}.difference(self.young):
            if base in self.old:
                again[base] = self.old[base]
            else:
                fresh.add(base)
        words, plain = [], []
        for u in fresh:
            (words if self.spelling is not None and _LATIN.fullmatch(u) else plain).append(u)
        if words:
            again.update(zip(words, map(self._word, self.spelling(words))))
        if "\n" in fresh:
            plain.remove("\n")
            again["\n"] = self._alone(["\n"])[0]
        again.update(zip(plain, self._together(plain)))
        for u in tailed:
            base = u[:-1]
            again[u] = (again[base] if base in again else self.young[base]) + self.marks[u[-1]]
        return again

    def encode_all(self, texts: list[str]) -> list[bytes]:
        whole = [_whole(t) for t in texts]
        alone = iter(self._alone([t for t, w in zip(texts, whole) if w]))
        number, units, before = _units([b"" if w else t.encode() for t, w in zip(texts, whole)])
        found = list(map(self.young.get, units))
        if None in found:
            again = self._learn([u for u, v in zip(units, found) if v is None])
            found = [again[u] if v is None else v for u, v in zip(units, found)]
            if len(self.young) + len(again) > CACHE_UNITS:
                self.old, self.young = self.young, {}
            self.young.update(again)
        # the ids of a unit lie at ``at`` in ``ids``, ``n`` of them; every unit of every text takes its own
        ids = np.frombuffer(b"".join(found), "<u4")
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at, n = (np.cumsum(n) - n)[number], n[number]
        ends = np.cumsum(np.append(0, n))
        taken = ids[np.repeat(at - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        bounds = (4 * ends[before]).tolist()
        return [next(alone) if w else taken[a:b] for w, a, b in zip(whole, bounds[:-1], bounds[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
