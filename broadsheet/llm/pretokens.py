"""Byte-level BPE over whole slices of texts: split into pre-tokens, encode each distinct one once.

The pre-token boundaries of a slice are found with array operations from the class of each code
point; the classes are asked of the tokenizer library itself, for the code points that occur. Each
distinct pre-token is then encoded by the library once per worker and its ids are gathered for all
its occurrences. Texts that contain a special string go to the library whole, as it splits them
there first.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from tokenizers import Tokenizer

from broadsheet.llm.arrays import Texts, distinct_ranges, first_eights, sparse_hashes, text_of, unlike_padded

_OTHER, _LETTER, _NUMBER, _SPACE, _UNKNOWN = range(5)
#: A worker forgets its pre-tokens beyond this many, some 100 MB; they are then encoded again when met.
CACHE_PIECES = 1_000_000
#: The endings that the pre-tokenizer splits off after an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

_opened: dict[str, BytePairs] = {}


class _Pieces(NamedTuple):
    """Pre-tokens of a slice: ranges of its bytes, which eight zeros follow, their first eight bytes, and their hashes."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    heads: np.ndarray
    hashes: np.ndarray

    def some(self, which: np.ndarray) -> _Pieces:
        return _Pieces(self.data, *(column[which] for column in self[1:]))


def opened(path: str) -> BytePairs:
    """The encoder of a tokenizer file, one per worker process."""
    if path not in _opened:
        _opened[path] = BytePairs(path)
    return _opened[path]


class _Grown:
    """An array that values are added to."""

    def __init__(self, kind: type):
        self._all, self._size = np.zeros(1024, kind), 0

    @property
    def values(self) -> np.ndarray:
        return self._all[: self._size]

    def add(self, values: np.ndarray) -> None:
        size = self._size + len(values)
        if size > len(self._all):
            grown = np.empty(max(size, len(self._all) * 3 // 2), self._all.dtype)
            grown[: self._size] = self.values
            self._all = grown
        self._all[self._size : size] = values
        self._size = size

    def padded(self) -> np.ndarray:
        """The values, and eight more of any kind."""
        if self._size + 8 > len(self._all):
            self._all = np.concatenate((self._all, np.zeros(1024, self._all.dtype)))
        return self._all[: self._size + 8]


class BytePairs:
    """Encode slices of texts with a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self._specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._classes = np.full(0x110000, _UNKNOWN, np.uint8)
        self._letters = self._byte_letters()
        self._model = self.library.model
        self._forget()

    def _byte_letters(self) -> dict[int, str]:
        """The character by which the vocabulary writes each byte, read off the library."""
        found = {}
        for point in [*range(0x800), *range(0x800, 0xD800, 0x800), 0xE000, 0xF000, *range(0x10000, 0x110000, 0x10000)]:
            written = "".join(piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(chr(point)))
            found.update(zip(chr(point).encode(), written))
        return found

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        return [t.id for t in self._model.tokenize(piece.decode("latin-1").translate(self._letters))]

    def _forget(self) -> None:
        #: Known pre-tokens by the leading bits of their hash, each in the first slot from there that was free, and -1.
        self._slots = np.full(1 << 12, -1, np.int32)
        #: Pre-tokens whose hash another one has. They have no slot.
        self._odd: dict[bytes, int] = {}
        self._data = _Grown(np.uint8)
        self._hashes, self._heads = _Grown(np.uint64), _Grown(np.uint64)
        self._starts, self._sizes, self._first, self._count = (_Grown(np.int64) for _ in range(4))
        self._ids = _Grown(np.int32)

    # -- classes of code points -------------------------------------------------------------

    def _ask(self, points: np.ndarray) -> None:
        """A code point has the class of the character that it forms one pre-token with."""
        chars = [chr(p) for p in points]
        found = np.full(len(points), _SPACE, np.uint8)
        for kind, lead in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")):
            joined = "".join(f"{lead}{c}\n" for c in chars)
            ends = {e for _, (_, e) in self.library.pre_tokenizer.pre_tokenize_str(joined)}
            alone = np.array([3 * i + 1 not in ends for i in range(len(chars))])
            found[alone] = kind
        self._classes[points] = found

    def _classes_of(self, points: np.ndarray) -> np.ndarray:
        kinds = self._classes[points]
        missing = kinds == _UNKNOWN
        if missing.any():
            self._ask(np.unique(points[missing]))
            kinds = self._classes[points]
        return kinds

    # -- boundaries -------------------------------------------------------------------------

    def boundaries(self, texts: Texts) -> np.ndarray:
        """Byte positions at which a pre-token starts; the next one's start ends it."""
        data, at = texts.data, texts.at
        if not len(data):
            return np.zeros(0, np.int64)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        byte_of = np.flatnonzero((data & 0xC0) != 0x80)
        kinds = self._classes_of(points)
        n = len(points)
        opens = np.zeros(n + 1, bool)  # a text starts here, or all end
        opens[np.searchsorted(byte_of, at)] = True
        starts = np.ones(n, bool)
        starts[1:] = (kinds[1:] != kinds[:-1]) | opens[1:-1]
        runs = np.flatnonzero(starts)
        ends = np.append(runs[1:], n)
        kind = kinds[runs]
        followed = ~opens[ends]
        # White space before another run of its text: the last character stands apart; a blank joins what follows.
        before = (kind == _SPACE) & followed
        last = ends[before] - 1
        starts[last] = True
        starts[last[points[last] == 0x20] + 1] = False
        # A lone apostrophe takes an ending with it.
        lone = runs[(kind == _OTHER) & (ends - runs == 1) & (points[runs] == 0x27) & followed]
        lone = lone[starts[lone]]
        for ending in _ENDINGS:
            k = len(ending)
            here = lone[lone + k < n]
            for j, letter in enumerate(ending, 1):
                here = here[(points[here + j] == ord(letter)) & ~opens[here + j]]
            starts[here + 1] = False
            rest = here[(here + k + 1 < n)] + k + 1
            rest = rest[(kinds[rest] == _LETTER) & ~opens[rest]]
            starts[rest] = True
        return byte_of[starts]

    def whole_tokens(self) -> frozenset[bytes]:
        """The vocabulary strings that are proven to encode alone as one id.

        The library encodes every entry that is a text by itself. A pre-token is merged without regard
        to its neighbours, so wherever one of these strings is a whole pre-token it is that one id.
        """
        byte_of = {letter: byte for byte, letter in self._letters.items()}
        raw = [bytes(map(byte_of.__getitem__, v)) for v in self.library.get_vocab(False) if set(v) <= byte_of.keys()]
        proven = []
        for entry in raw:
            try:
                string = entry.decode("utf-8")
            except UnicodeDecodeError:
                continue  # part of a character: never a whole pre-token
            if len(self.library.encode(string, add_special_tokens=False).ids) == 1:
                proven.append(entry)
        return frozenset(proven)

    # -- encoding ---------------------------------------------------------------------------

    def _cut(self, texts: Texts, begins: np.ndarray) -> _Pieces:
        data = np.concatenate((texts.data, np.zeros(8, np.uint8)))
        sizes = np.diff(begins, append=len(texts.data))
        heads = first_eights(data, begins, sizes)
        return _Pieces(data, begins, sizes, heads, sparse_hashes(data, begins, sizes, heads))

    def _home(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(65 - len(self._slots).bit_length())).astype(np.int64)

    def _known(self, pieces: _Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Index of each pre-token in the worker's list, -1 if it is not found by its hash; and whether its hash is known."""
        if not len(self._hashes.values):
            return np.full(len(pieces.starts), -1, np.int64), np.zeros(len(pieces.starts), bool)
        place = self._home(pieces.hashes)
        found = self._slots[place].astype(np.int64)
        beside = np.flatnonzero((self._hashes.values[found] != pieces.hashes) & (found >= 0))
        while len(beside):
            place[beside] = (place[beside] + 1) & (len(self._slots) - 1)
            found[beside] = here = self._slots[place[beside]]
            beside = beside[(self._hashes.values[here] != pieces.hashes[beside]) & (here >= 0)]
        taken = found >= 0
        same = taken & (self._heads.values[found] == pieces.heads) & (self._sizes.values[found] == pieces.sizes)
        long = np.flatnonzero(same & (pieces.sizes > 8))
        of = self._starts.values[found[long]]
        same[long] = ~unlike_padded(pieces.data, pieces.starts[long] + 8, self._data.padded(), of + 8, pieces.sizes[long] - 8)
        found[~same] = -1
        return found, taken

    def _keep(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Slots for pre-tokens of the list whose hashes no other one has; half of all slots stay free at least."""
        known = len(self._hashes.values)
        if 2 * known > len(self._slots):
            self._slots = np.full(2 << known.bit_length(), -1, np.int32)
            odd = np.fromiter(self._odd.values(), np.int64, len(self._odd))
            numbers = np.delete(np.arange(known), odd)
            hashes = self._hashes.values[numbers]
        place = self._home(hashes)
        while len(numbers):
            free = self._slots[place] < 0
            self._slots[place[free]] = numbers[free]
            left = self._slots[place] != numbers
            place, numbers = (place[left] + 1) & (len(self._slots) - 1), numbers[left]

    def _indexes(self, pieces: _Pieces, whole: frozenset[bytes] = frozenset()) -> np.ndarray:
        """Index of each pre-token in the worker's list; new ones are encoded by the library, those in ``whole`` unmerged."""
        found, taken = self._known(pieces)
        new = np.flatnonzero(found < 0)
        if not len(new):
            return found
        first, kind = self._kinds(pieces, new)
        if len(self._count.values) + len(first) > CACHE_PIECES:
            self._forget()
            found, taken = self._known(pieces)
            new = np.arange(len(found))
            first, kind = self._kinds(pieces, new)
        found[new] = self._added(pieces.some(new[first]), taken[new[first]], whole)[kind]
        return found

    def _kinds(self, pieces: _Pieces, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = pieces.starts[which]
        return distinct_ranges(pieces.data, starts, starts + pieces.sizes[which], pieces.hashes[which])

    def _added(self, pieces: _Pieces, taken: np.ndarray, whole: frozenset[bytes]) -> np.ndarray:
        """Index in the worker's list of different pre-tokens that were not found; ``taken``: their hash is another one's."""
        raw, size = pieces.data.tobytes(), len(pieces.starts)
        strings = [raw[b:e] for b, e in zip(pieces.starts.tolist(), (pieces.starts + pieces.sizes).tolist())]
        lone = np.zeros(size, bool)
        lone[np.unique(pieces.hashes, return_index=True)[1]] = True
        lone &= ~taken
        found, kept = np.empty(size, np.int64), np.ones(size, bool)
        number = len(self._count.values)
        for i in np.flatnonzero(~lone).tolist():
            if strings[i] in self._odd:
                found[i], kept[i] = self._odd[strings[i]], False
        kept = np.flatnonzero(kept)
        found[kept] = number + np.arange(len(kept))
        for i in kept[~lone[kept]].tolist():
            self._odd[strings[i]] = int(found[i])
        strings = [strings[i] for i in kept.tolist()]
        ids = [self._unmerged(s) if s in whole else self.merged(s) for s in strings]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        sizes = pieces.sizes[kept]
        self._starts.add(len(self._data.values) + np.cumsum(sizes) - sizes)
        self._sizes.add(sizes)
        self._data.add(np.frombuffer(b"".join(strings), np.uint8))
        self._heads.add(pieces.heads[kept])
        self._hashes.add(pieces.hashes[kept])
        self._first.add(len(self._ids.values) + np.cumsum(counts) - counts)
        self._count.add(counts)
        self._ids.add(np.fromiter((i for x in ids for i in x), np.int32, int(counts.sum())))
        self._keep(pieces.hashes[lone], found[lone])
        return found

    def _unmerged(self, piece: bytes) -> list[int]:
        return [self.library.token_to_id(piece.decode("latin-1").translate(self._letters))]

    def _special(self, texts: Texts) -> list[int]:
        """Texts that contain a special string."""
        raw = texts.data.tobytes()
        found = set()
        for special in self._specials:
            word, at = special.encode(), -1
            while (at := raw.find(word, at + 1)) >= 0:
                i = int(text_of(np.array([at]), texts.at)[0])
                if at + len(word) <= texts.at[i + 1]:
                    found.add(i)
        return sorted(found)

    def counts(self, texts: Texts, whole: frozenset[bytes]) -> np.ndarray:
        """Number of ids of each text; pre-tokens in ``whole`` count as one unmerged."""
        begins = self.boundaries(texts)
        if not len(begins):
            return np.zeros(len(texts.at) - 1, np.int64)
        pieces = self._indexes(self._cut(texts, begins), whole)
        each = self._count.values[pieces]
        sums = np.concatenate(([0], np.cumsum(each)))
        out = np.diff(sums[np.searchsorted(begins, texts.at)])
        for i in self._special(texts):
            out[i] = len(self._whole(texts, i))
        return out

    def _whole(self, texts: Texts, i: int) -> list[int]:
        text = texts.data[texts.at[i] : texts.at[i + 1]].tobytes().decode("utf-8")
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice end to end, and where each text's ids start (one more for the end)."""
        begins = self.boundaries(texts)
        if not len(begins):
            return np.zeros(0, np.int32), np.zeros(len(texts.at), np.int64)
        pieces = self._indexes(self._cut(texts, begins))
        counts = self._count.values[pieces]
        sums = np.concatenate(([0], np.cumsum(counts)))
        ids = self._ids.values[np.repeat(self._first.values[pieces] - sums[:-1], counts) + np.arange(sums[-1])]
        at = sums[np.searchsorted(begins, texts.at)]
        special = self._special(texts)
        if special:
            parts = [ids[at[i] : at[i + 1]] for i in range(len(at) - 1)]
            for i in special:
                parts[i] = np.array(self._whole(texts, i), np.int32)
            ids = np.concatenate(parts)
            at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, at
