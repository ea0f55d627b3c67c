"""Vectorised pre-tokenisation shared by token counting, packing and token-ID output.

A batch of texts becomes one array of code points. Character classes turn it into pre-token boundaries
with whole-array operations. Pre-tokens met before are resolved by one gather from a direct-mapped memo of
fixed size: a fingerprint finds the slot, and the characters kept there are compared one by one, so a
result never rests on a fingerprint. Only pre-tokens that the memo does not hold reach the (slow)
byte-pair step.

The class of a character is asked from the tokenizer's own splitting rule once per distinct character,
so the boundaries are those of the library by construction. A text is split at the added tokens' strings
inside it, as the library splits it, and each of these stands for its own id. Only parts whose normal form is
not a character-by-character mapping are encoded whole by the library.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

OTHER, LETTER, NUMBER, SPACE, UNKNOWN = 0, 1, 2, 3, 9
#: Characters worked on at once; a longer text is cut where white space follows something else.
CHUNK = 1 << 17
_MEMO_BITS = 21
_MAX_STORE = 12_000_000
#: Characters of the longest pre-token that the memo keeps.
_LONGEST = 48


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STEP = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = mix(np.arange(1, 1 + 0x110000, dtype=np.uint64) * _STEP)


def character_sums(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums (one more than characters) of every character scrambled with its place in its span. A
    character and its place go through the scrambler together, so no algebra of places makes sums equal."""
    n = len(codes)
    begin = np.zeros(n, np.int64)
    begin[starts] = starts
    place = np.arange(n) - np.maximum.accumulate(begin)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(_RANDOM[codes] + place.astype(np.uint64) * _STEP), out=total[1:])
    return total


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """64-bit fingerprints of spans of code points (or bytes) that do not overlap; ``starts`` ascend."""
    if not len(starts):
        return np.empty(0, np.uint64)
    total = character_sums(codes, starts) if total is None else total
    return mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64))


def span_places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of spans, end to end."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def same_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """Whether each pair of spans holds the same characters."""
    same = a_sizes == b_sizes
    sizes = np.where(same, a_sizes, 0)
    differs = np.flatnonzero(a[span_places(a_starts, sizes)] != b[span_places(b_starts, sizes)])
    if len(differs):
        same[np.searchsorted(np.cumsum(sizes), differs, side="right")] = False
    return same


def cut(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in parts of about ``size`` characters; each part but the first begins with a white-space
    character that follows another kind, which every supported rule treats as a boundary."""
    at, n = 0, len(text)
    while n - at > size:
        k = at + size
        while k < n and not (text[k] in " \n\t\r" and not text[k - 1].isspace() and text[k - 1] > "\x1f"):
            k += 1
        if k >= n:
            break
        yield text[at:k]
        at = k
    yield text[at:]


def _byte_letters() -> dict[int, str]:
    """The printable stand-in that byte-level vocabularies have for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


def byte_text(word: str) -> str:
    """A pre-token spelled in the stand-ins of its UTF-8 bytes."""
    return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(BYTE_LETTERS)


class Splitter:
    """Pre-token boundaries of one tokenizer file.

    ``byte`` style keeps one leading blank with a pre-token and keeps white-space runs; ``word`` style
    drops white space and takes numbers digit by digit, over lower-cased NFC text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.style = "word" if self.spec["normalizer"] else "byte"
        added = self.spec["added_tokens"]
        self.added = {x["content"]: x["id"] for x in added}
        # the library finds them leftmost first, the longest of several; the flags would make it look around
        self.at_added = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self.plain_added = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added)
        self.classes = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32) if self.style == "word" else None
        self.slow = np.zeros(0x110000, dtype=bool) if self.style == "word" else None

    def _learn(self, codes: np.ndarray) -> None:
        """Ask the library for the classes of characters not met before."""
        rule = self.library.pre_tokenizer.pre_tokenize_str
        for code in codes.tolist():
            c = chr(code)
            if self.style == "word":
                normal = self.library.normalizer.normalize_str("x" + c + "x")[1:-1]
                if len(normal) != 1:
                    self.slow[code] = True
                    self.classes[code] = OTHER
                    continue
                self.lower[code], c = ord(normal), normal
            if len(rule("a" + c)) == 1 and rule("a" + c)[0][1] == (0, 2):
                kind = LETTER
            elif len(rule("!" + c)) == 1 and rule("!" + c)[0][1] == (0, 2):
                kind = OTHER
            elif self.style == "byte":
                kind = NUMBER if len(rule("1" + c)) == 1 else SPACE
            else:
                kind = NUMBER if len(rule("1" + c)) == 2 else SPACE
            self.classes[code] = kind

    def sections(self, text: str) -> list[str]:
        """The text split at the added tokens' strings; every second section is one of them."""
        if not self.at_added or not any(x in text for x in self.added):
            return [text]
        return self.at_added.split(text)

    def is_slow(self, section: str) -> bool:
        """Whether only the library itself may encode this text between added tokens."""
        if not self.plain_added and any(x in section for x in self.added):
            return True
        return self.style == "word" and not section.isascii() and not unicodedata.is_normalized("NFC", section)

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the texts end to end (lower-cased where the rule says so) and their classes."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = self.classes[codes]
        if (new := kinds == UNKNOWN).any():
            self._learn(np.unique(codes[new]))
            kinds = self.classes[codes]
        if self.style == "word":
            codes = self.lower[codes]
        return codes, kinds

    def split(self, codes: np.ndarray, kinds: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all pre-tokens. ``text_starts``: where each (non-empty) text begins."""
        n = len(codes)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        first = np.zeros(n + 1, dtype=bool)
        first[text_starts] = True
        first[n] = True
        begins = np.empty(n + 1, dtype=bool)
        begins[0] = begins[n] = True
        begins[1:n] = kinds[1:] != kinds[:-1]
        begins |= first
        if self.style == "byte":
            space = kinds == SPACE
            blank = codes == 32
            # the last white-space character before something else stands alone or joins what follows
            last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
            begins[last] = True
            begins[last[blank[last]] + 1] = False
        else:
            digit = np.flatnonzero(kinds == NUMBER)
            begins[digit] = True
        self._contractions(codes, kinds, begins, first)
        starts = np.flatnonzero(begins)
        starts, ends = starts[:-1], starts[1:]
        if self.style == "word":
            keep = kinds[starts] != SPACE
            starts, ends = starts[keep], ends[keep]
        return starts, ends

    def _contractions(self, codes: np.ndarray, kinds: np.ndarray, begins: np.ndarray, first: np.ndarray) -> None:
        n = len(codes)
        at = np.flatnonzero((codes == 39) & begins[:n])
        if not len(at):
            return
        for i in at[at + 1 < n].tolist():
            if first[i + 1]:
                continue
            one = chr(codes[i + 1])
            two = one + chr(codes[i + 2]) if i + 2 < n and not first[i + 2] else ""
            # suffixes fixed by the tokenizer's pattern
            size = 2 if one in "stmd" else 3 if two in ("re", "ve", "ll") else 0
            if size:
                begins[i + 1] = False
                begins[i + size] = True


class Memo:
    """Direct-mapped memory of fixed size: a pre-token -> its ids (or their number).

    The fingerprint only names the slot. A slot answers for a pre-token whose characters are its own.
    """

    def __init__(self, splitter: Splitter, solve: Callable[[list[str]], list | np.ndarray], ids: bool) -> None:
        self.splitter, self.solve, self.ids = splitter, solve, ids
        self.clear()

    def clear(self) -> None:
        size = 1 << _MEMO_BITS
        self.keys = np.zeros(size, dtype=np.uint64)
        self.length = np.zeros(size, dtype=np.int32)
        self.offset = np.zeros(size, dtype=np.int32)
        self.size = np.zeros(size, dtype=np.int32)
        self.place = np.zeros(size, dtype=np.int32)
        self.store, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.characters, self.spelled = np.zeros(1 << 16, dtype=np.uint32), 0

    @staticmethod
    def _keep(store: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
        if used + len(more) > len(store):
            store = np.concatenate([store[:used], np.zeros(max(len(more), len(store)), store.dtype)])
        store[used : used + len(more)] = more
        return store

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray | None]:
        """Number of tokens of every text and, if wanted, all ids end to end. Texts must not be slow."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        text_ends = np.cumsum(sizes)
        codes, kinds = self.splitter.codes(texts)
        starts, ends = self.splitter.split(codes, kinds, (text_ends - sizes)[sizes > 0])
        keys = span_hashes(codes, starts, ends)
        if max(self.used, self.spelled) > _MAX_STORE:
            self.clear()
        slot = (keys & np.uint64((1 << _MEMO_BITS) - 1)).astype(np.int64)
        length, offset = self.length[slot], self.offset[slot]
        known = (self.keys[slot] == keys) & (self.size[slot] > 0)
        at = np.flatnonzero(known)
        known[at] = same_spans(codes, starts[at], self.characters, self.place[slot[at]].astype(np.int64), (ends - starts)[at], self.size[slot[at]].astype(np.int64))
        fresh = self.store
        miss = np.flatnonzero(~known)
        if len(miss):
            length[miss], offset[miss], fresh = self._learn(codes, starts[miss], ends[miss], slot[miss], keys[miss])
        total = np.zeros(len(length) + 1, dtype=np.int64)
        np.cumsum(length, out=total[1:])
        bounds = np.searchsorted(starts, np.concatenate([[0], text_ends]))
        counts = np.diff(total[bounds])
        if not self.ids:
            return counts, None
        return counts, fresh[span_places(offset.astype(np.int64), length.astype(np.int64))]

    def _learn(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, slot: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Solve pre-tokens that the memo lacks, each spelling once, and keep those that are not too long.
        Returns the lengths, and the offsets in the returned store (which also holds what is not kept)."""
        whole = codes.astype("<u4").tobytes()
        spelled: dict[bytes, int] = {}
        first: list[int] = []
        back = np.empty(len(starts), np.int64)
        for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            back[k] = n = spelled.setdefault(whole[4 * s : 4 * e], len(spelled))
            if n == len(first):
                first.append(k)
        found = self.solve([w.decode("utf-32-le", "surrogatepass") for w in spelled])
        if self.ids:
            got = np.fromiter(map(len, found), dtype=np.int32, count=len(found))
            self.store = self._keep(self.store, self.used, np.fromiter((i for x in found for i in x), dtype=np.int32, count=int(got.sum())))
            off = (self.used + np.cumsum(got, dtype=np.int64) - got).astype(np.int32)
            self.used += int(got.sum())
        else:
            got, off = np.asarray(found, dtype=np.int32), np.zeros(len(found), np.int32)
        size = (ends - starts)[first]
        short = np.flatnonzero(size <= _LONGEST)
        chosen = np.asarray(first, np.int64)[short]
        size = size[short]
        # of several new ones with one slot numpy keeps the last in every array alike
        slots = slot[chosen]
        self.keys[slots], self.length[slots], self.offset[slots], self.size[slots] = keys[chosen], got[short], off[short], size
        self.place[slots] = self.spelled + np.cumsum(size) - size
        self.characters = self._keep(self.characters, self.spelled, codes[span_places(starts[chosen], size)])
        self.spelled += int(size.sum())
        return got[back], off[back], self.store


class Encoder:
    """Exact ids (or counts) of whole texts, as the library gives them without special tokens around."""

    def __init__(self, path: str, solve: Callable[[list[str]], list | np.ndarray] | None = None, ids: bool = True) -> None:
        self.splitter = Splitter(path)
        self.memo = Memo(self.splitter, solve or self._by_library, ids)
        self.ids = ids
        if hasattr(self.splitter.library.model, "_resize_cache"):
            self.splitter.library.model._resize_cache(0)  # the memo stands before it; filling a second one costs more than it saves

    def _by_library(self, words: list[str]) -> list:
        """Ids of single pre-tokens, from the library's byte-pair model itself."""
        tokenize = self.splitter.library.model.tokenize
        return [[x.id for x in tokenize(byte_text(w))] for w in words]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray | None]:
        """Counts by text, and all ids end to end."""
        counts, parts = np.zeros(len(texts), np.int64), []
        some: list[str] = []  # parts that wait to be encoded together, and whose they are
        owner: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if some:
                np.add.at(counts, owner, self._plain(some, parts))
            some.clear(), owner.clear()
            held = 0

        for i, text in enumerate(texts):
            for k, section in enumerate(self.splitter.sections(text)):
                if k % 2:  # an added token
                    flush()
                    parts.append(np.array([self.splitter.added[section]], np.int32))
                    counts[i] += 1
                elif self.splitter.is_slow(section):
                    flush()
                    counts[i] += self._whole(section, parts)
                else:
                    for x in cut(section) if len(section) > 2 * CHUNK else (section,):
                        if held and held + len(x) > CHUNK:
                            flush()
                        some.append(x), owner.append(i)
                        held += len(x)
        flush()
        return counts, (np.concatenate(parts) if parts else np.empty(0, np.int32)) if self.ids else None

    def _whole(self, text: str, parts: list[np.ndarray]) -> int:
        ids = self.splitter.library.encode(text, add_special_tokens=False).ids
        parts.append(np.asarray(ids, dtype=np.int32))
        return len(ids)

    def _plain(self, some: list[str], parts: list[np.ndarray]) -> np.ndarray:
        if self.splitter.slow is not None:
            self.splitter.codes([t for t in some if not t.isascii()])  # learns new characters
            if self.splitter.slow.any():
                odd = [not t.isascii() and bool(self.splitter.slow[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].any()) for t in some]
                if any(odd):
                    return np.array([self._whole(t, parts) if o else int(self._plain_now([t], parts)[0]) for t, o in zip(some, odd, strict=True)])
        return self._plain_now(some, parts)

    def _plain_now(self, some: list[str], parts: list[np.ndarray]) -> np.ndarray:
        n, ids = self.memo(some)
        if ids is not None:
            parts.append(ids)
        return n


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file, so that what it remembers outlives a task."""
    return Encoder(path)
