"""Encoding whole texts with a public tokenizer inside Arrow batches."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shingles import _BYTE, _power, mix

#: A space between two characters that no tokenizer can take for white space starts a new piece in byte-level BPE.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space of any standard beside a space: such texts are cut by _CUT, all others at every space.
_WHITE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BESIDE = rf"{_WHITE} | {_WHITE}|\A | \z"
_LED = np.uint64(0xA5A5A5A5A5A5A5A5)
#: Pieces that a worker's cache holds, of some 40 bytes each; when there are more it starts anew.
MOST_PIECES = 2_500_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _layout(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that an array of strings lies in, and the edges of its strings there."""
    strings = strings.cast(pa.large_binary())
    _, offsets, data = strings.buffers()
    edges = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), edges


def _spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    return np.arange(int(lens.sum())) + np.repeat(starts - (np.cumsum(lens) - lens), lens)


def _hashes(raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """64-bit hashes of strings, by arithmetic over their bytes. They find pieces; bytes tell them apart."""
    out = np.zeros(len(edges) - 1, np.uint64)
    if edges[-1] == edges[0]:
        return mix(out)
    at = 0
    while at < len(out):
        end = max(at + 1, int(np.searchsorted(edges, edges[at] + (1 << 20), "right")) - 1)
        run = raw[edges[at] : edges[end]]
        up, down = _power(len(run) + 1)
        sums = np.zeros(len(run) + 1, np.uint64)
        np.cumsum(_BYTE[run] * up[: len(run)], out=sums[1:])
        a, z = edges[at:end] - edges[at], edges[at + 1 : end + 1] - edges[at]
        out[at:end] = (sums[z] - sums[a]) * down[a] + (z - a).astype(np.uint64)
        at = end
    return mix(out)


class PieceEncoder:
    """Encodes texts by the ids of their space-led pieces, which a bounded cache holds in flat arrays.

    Byte-level BPE cuts before every single space between two other characters, so pieces encode independently and
    their ids concatenate to the ids of the whole text. Pieces not seen yet are encoded together in long strings and cut
    apart by byte lengths, which spares a call for each. Hashes find pieces in the cache; a piece found is compared with
    the cached one byte by byte, and one whose hash belongs to another piece is known by its bytes alone.
    """

    def __init__(self, path: str, most: int = MOST_PIECES, special_is_text: bool = False, most_bytes: int = 96 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_is_text
        self.most, self.most_bytes = most, most_bytes
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self._bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self._bytes[i] = len(token)  # byte-level vocabularies spell each byte as one character
        self._kind = np.uint16 if len(self._bytes) <= 65536 else np.uint32
        self._clear()

    def _clear(self) -> None:
        self.keys = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]  # sorted; the second, of recent ones, is small
        self.at = [np.zeros(0, np.uint32), np.zeros(0, np.uint32)]
        self.clashes: dict[tuple[bool, bytes], int] = {}
        self.n, self.n_ids, self.n_bytes = 0, 0, 0
        # Piece i has the ids and the bytes between edges i and i + 1.
        self.id_edges, self.ids = np.zeros(1 << 16, np.uint32), np.zeros(1 << 18, self._kind)
        self.byte_edges, self.spelling, self.led = np.zeros(1 << 16, np.uint32), np.zeros(1 << 18, np.uint8), np.zeros(1 << 16, bool)

    def _fresh(self) -> None:
        if self.n > self.most or self.n_bytes > self.most_bytes:
            self._clear()

    def _add(self, lens: np.ndarray, ids: np.ndarray, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, led: np.ndarray) -> np.ndarray:
        """Places of new pieces, given by the numbers of their ids, the ids, and their bytes."""
        k, n_ids, n_bytes = len(lens), self.n_ids + len(ids), self.n_bytes + int(sizes.sum())
        for name, wanted in (("id_edges", self.n + k + 1), ("byte_edges", self.n + k + 1), ("led", self.n + k), ("ids", n_ids), ("spelling", n_bytes)):
            while wanted > len(held := getattr(self, name)):
                setattr(self, name, np.concatenate([held, np.zeros(len(held) // 2, held.dtype)]))
        own, after = slice(self.n, self.n + k), slice(self.n + 1, self.n + k + 1)
        self.ids[self.n_ids : n_ids], self.id_edges[after] = ids, self.n_ids + np.cumsum(lens)
        self.spelling[self.n_bytes : n_bytes], self.byte_edges[after] = raw[_spread(starts, sizes)], self.n_bytes + np.cumsum(sizes)
        self.led[own] = led
        self.n, self.n_ids, self.n_bytes = self.n + k, n_ids, n_bytes
        return np.arange(own.start, own.stop)

    @staticmethod
    def _between(edges: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin, and how long they are."""
        begins = edges[places].astype(np.int64)
        return begins, edges[places + 1] - begins

    def _index(self, keys: np.ndarray, places: np.ndarray) -> None:
        both, at = np.concatenate([self.keys[1], keys]), np.concatenate([self.at[1], places.astype(np.uint32)])
        level = 1
        if len(both) > 300_000:
            both, at, level = np.concatenate([self.keys[0], both]), np.concatenate([self.at[0], at]), 0
            self.keys[1], self.at[1] = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        order = np.argsort(both, kind="stable")
        self.keys[level], self.at[level] = both[order], at[order]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for unknown ones."""
        out, order = np.full(len(keys), -1, np.int64), np.argsort(keys)
        keys = keys[order]  # sorted needles walk through the cache in order
        for known, at in zip(self.keys, self.at, strict=True):
            if len(known):
                i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[i] == keys
                out[order[hit]] = at[i[hit]]
        return out

    def _other(self, places: np.ndarray, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, led: np.ndarray) -> np.ndarray:
        """Which of the pieces at these places of the cache are not the ones given."""
        spelt, held = self._between(self.byte_edges, places)
        out = (held != sizes) | (self.led[places] != led)
        if not out.any() and len(starts):  # as ever: then the strings given lie one after the other
            whole = raw[int(starts[0]) : int(starts[-1] + sizes[-1])]
            if np.array_equal(self.spelling[_spread(spelt, sizes)], whole):
                return out
        same = np.flatnonzero(~out)
        n = sizes[same]
        differs = self.spelling[_spread(spelt[same], n)] != raw[_spread(starts[same], n)]
        if differs.any():
            out[np.unique(np.repeat(same, n)[differs])] = True
        return out

    def _places(self, strings: pa.Array, led: np.ndarray) -> np.ndarray:
        """Places of pieces; those that are led have a space before the string given."""
        raw, edges = _layout(strings)
        begins, sizes = edges[:-1], np.diff(edges)
        keys = _hashes(raw, edges)
        keys[led] ^= _LED
        out = self._find(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            _, first = np.unique(keys[new], return_index=True)
            new = new[first]
            joined, alone = new[led[new] & (sizes[new] > 0)], new[~(led[new] & (sizes[new] > 0))]
            for i in range(0, len(joined), 2000):
                some = joined[i : i + 2000]
                ids = np.array(self.tokenizer.encode(" " + " ".join(strings.take(pa.array(some)).to_pylist()), add_special_tokens=False).ids, np.int64)
                ends = np.searchsorted(np.cumsum(self._bytes[ids]), np.cumsum(sizes[some] + 1)) + 1
                self._index(keys[some], self._add(np.diff(ends, prepend=0), ids, raw, begins[some], sizes[some], led[some]))
            for i in range(0, len(alone), 2000):
                some = alone[i : i + 2000]
                self._index(keys[some], self._add_alone(strings, some, raw, begins, sizes, led))
            unknown = np.flatnonzero(out < 0)
            out[unknown] = self._find(keys[unknown])
        for i in np.flatnonzero(self._other(out, raw, begins, sizes, led)).tolist():  # another piece has the hash
            name = (bool(led[i]), raw[begins[i] : edges[i + 1]].tobytes())
            if name not in self.clashes:
                self.clashes[name] = int(self._add_alone(strings, np.array([i]), raw, begins, sizes, led)[0])
            out[i] = self.clashes[name]
        return out

    def _add_alone(self, strings: pa.Array, some: np.ndarray, raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray, led: np.ndarray) -> np.ndarray:
        texts = [" " * bool(x) + t for x, t in zip(led[some], strings.take(pa.array(some)).to_pylist(), strict=True)]
        each = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return self._add(np.array([len(e) for e in each], np.int64), np.array([i for e in each for i in e], np.int64), raw, begins[some], sizes[some], led[some])

    def _batch_places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cache places of all pieces of the texts, and how many each text has."""
        odd = np.flatnonzero(pc.match_substring_regex(texts, _BESIDE).to_numpy(zero_copy_only=False))
        if len(odd):  # rare: these texts are cut one by one, and put back in order
            plain = np.setdiff1d(np.arange(len(texts)), odd)
            found, n = self._batch_places(texts.take(pa.array(plain))) if len(plain) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            cut = [_CUT.split(t) for t in texts.take(pa.array(odd)).to_pylist()]
            sizes = np.array([len(c) for c in cut])
            led = np.ones(int(sizes.sum()), bool)
            led[np.cumsum(sizes) - sizes] = False
            more = self._places(pa.array([p for c in cut for p in c], pa.large_string()), led)
            counts = np.zeros(len(texts), np.int64)
            counts[plain], counts[odd] = n, sizes
            ends = np.cumsum(counts)
            out = np.empty(int(counts.sum()), np.int64)
            fill = lambda which, values, k: out.__setitem__(np.arange(int(k.sum())) + np.repeat((ends - counts)[which] - (np.cumsum(k) - k), k), values)
            fill(plain, found, n)
            fill(odd, more, sizes)
            return out, counts
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy()
        counts = np.diff(offsets)
        pieces = lists.flatten()
        firsts = np.cumsum(counts) - counts
        led = np.ones(len(pieces), bool)
        led[firsts] = False
        coded = pieces.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary
        used = np.flatnonzero(np.bincount(which[led], minlength=len(words)))
        heads, back = np.unique(which[firsts], return_inverse=True)
        strings = pa.concat_arrays([words.take(pa.array(used)), words.take(pa.array(heads))])
        places = self._places(strings, np.arange(len(strings)) < len(used))
        table = np.full(len(words), -1, np.int64)
        table[used] = places[: len(used)]
        out = table[which]
        out[firsts] = places[len(used) :][back]
        return out, counts

    def slices(self, column: pa.Array, most_bytes: int = 2 << 20) -> Iterator[pa.Array]:
        """The texts of a column, null as empty, in runs of bounded size."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)) // most_bytes
        edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(column)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield column.slice(a, b - a)

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text of a column."""
        out = [np.zeros(0, np.int64)]
        for part in self.slices(column):
            self._fresh()
            places, n = self._batch_places(part)
            sums = np.concatenate([[0], np.cumsum(self._between(self.id_edges, places)[1])])
            ends = np.cumsum(n)
            out.append(sums[ends] - sums[ends - n])
        return np.concatenate(out)

    def encode_flat(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each run of texts: all their ids in one array, and where each text's ids end."""
        for part in self.slices(column):
            self._fresh()
            places, n = self._batch_places(part)
            starts, lens = self._between(self.id_edges, places)
            ends = np.cumsum(lens)
            ids = self.ids[_spread(starts, lens)]
            yield ids, np.concatenate([[0], ends])[np.cumsum(n)]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column."""
        for ids, ends in self.encode_flat(column):
            at = 0
            for end in ends.tolist():
                yield ids[at:end]
                at = end


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, special_is_text: bool = False, most: int = MOST_PIECES) -> PieceEncoder:
    """One encoder for each Python worker, whose cache holds so many pieces."""
    if (path, special_is_text) not in _encoders:
        _encoders[path, special_is_text] = PieceEncoder(path, special_is_text=special_is_text)
    _encoders[path, special_is_text].most = most
    return _encoders[path, special_is_text]


def forget() -> None:
    """Drops this worker's encoders and their caches."""
    _encoders.clear()
