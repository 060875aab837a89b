"""Ids and piece counts as the tokenizers library gives them, with a cache of whole pieces.

Both vocabularies part a text into pieces (by a pattern) and merge inside a piece only, so the ids
of a text are those of its pieces. For texts of ASCII and Latin-1 letters the parting is done by `re`,
where it is the same as the library's; every other text, and any with a "<|" in it, goes to the library.
Ids of the lower-casing vocabulary are made for many texts at once: their bytes are parted by kind, and
equal pieces meet before they are looked up.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_L = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_PLAIN = re.compile(f"[^\\t\\n\\r -~{_L[6:]}]")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
#: The published patterns of the two vocabularies, with their letter and number classes on plain texts. Fixed values.
_PATTERNS = {
    "byte_bpe_50k.json": re.compile(rf" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+"),
    "word_bpe_49k.json": re.compile(rf"[{_L}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\s{_L}0-9]+"),
}
#: Vocabularies whose normaliser lower-cases before it parts.
_LOWER = {"word_bpe_49k.json"}
#: Pieces held by a worker; beyond them the cache is emptied. Results don't depend on it.
CACHE = 600_000
#: Bytes of texts whose pieces are looked up together, beside a longer text. Results don't depend on it.
GROUP = 2 << 20
#: Byte-level vocabularies write each byte as a character: printable ones as themselves, the others from 256 up.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _SHOWN)}
#: Kinds of bytes of a lower-cased plain text; only Latin-1 letters have bytes beyond ASCII there, a C3 and one from 80 up.
_SPACE, _LETTER, _DIGIT, _OTHER, _NOT_PLAIN = range(5)
_KINDS = bytes(
    _SPACE if b in b"\t\n\r " else _NOT_PLAIN if b < 32 or b == 127 or b >= 0xC0 and b != 0xC3 else _DIGIT if chr(b) in "0123456789" else _LETTER if b >= 128 or chr(b).isalpha() else _OTHER for b in range(256)
)
#: Lower case by byte; behind a C3, the bytes from 80 to 9E are capitals (97, a sign, isn't plain).
_LOWERED = bytes(b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" or 0x80 <= b <= 0x9E else b for b in range(256))
_SIGNS = ("<|".encode(), "\xd7".encode(), "\xf7".encode())


def plain(raw: bytes) -> bool:
    """Whether the text is of ASCII and Latin-1 letters, without other controls than tab and line ends, and without a "<|"."""
    return _NOT_PLAIN not in raw.translate(_KINDS) and not any(s in raw for s in _SIGNS)


def word_pieces(raws: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of plain texts by the pattern of the lower-casing vocabulary, and the number of pieces before each text and after the last."""
    lengths = np.fromiter(map(len, raws), np.int64, len(raws))
    ends = np.cumsum(lengths)
    heads, size = ends - lengths, int(lengths.sum())
    joined = b"".join(raws).translate(_LOWERED)
    text, kind = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(_KINDS), np.uint8)
    start = kind == _DIGIT
    start[1:] |= kind[1:] != kind[:-1]
    start[heads[heads < size]] = True
    # 's, 't, 'm, 'd, 're, 've and 'll are pieces where the apostrophe starts one
    q = np.flatnonzero(start & (text == ord("'")))
    end = ends[np.searchsorted(heads, q, "right") - 1]
    one, two = (np.where(q + k < end, text[np.minimum(q + k, size - 1)], 0) for k in (1, 2)) if size else (q, q)
    long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    hit = long | np.isin(one, list(b"stmd"))
    start[q[hit] + 1] = False
    after = (q + 2 + long)[hit]
    start[after[after < end[hit]]] = True
    kept = kind != _SPACE
    start &= kept
    packed = text[kept]
    at = np.append(np.flatnonzero(start[kept]), len(packed))
    pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(packed)])
    return pieces, np.searchsorted(np.flatnonzero(start), np.append(heads, size))


class Encoder:
    """One tokenizer file, loaded once in a worker."""

    def __init__(self, name: str, path: str | None = None) -> None:
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(name)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.find, self.lower = _PATTERNS[name].findall, name in _LOWER
        self.held: dict[str, tuple[int, ...]] = {}
        self.merged: dict[bytes, bytes] = {}

    def parts(self, text: str) -> list[str] | None:
        """The pieces of a plain text, else None."""
        if "<|" in text or not text.isascii() and _PLAIN.search(text) or text.isascii() and _CONTROL.search(text):
            return None
        return self.find(text.lower() if self.lower else text)

    def looked_up(self, ps: list[str]) -> list[tuple[int, ...]]:
        """The ids of each piece; the merges are run once for a piece that isn't held yet."""
        try:
            return list(map(self.held.__getitem__, ps))
        except KeyError:
            pass
        if len(self.held) > CACHE:
            self.held = {}
        merge, held = self.library.model.tokenize, self.held
        for p in {p for p in ps if p not in held}:
            held[p] = tuple([t.id for t in merge(p if p.isascii() and p.isalpha() else p.encode().decode("latin-1").translate(_BYTES))])
        return list(map(held.__getitem__, ps))

    def runs(self, ps: list[bytes]) -> list[bytes]:
        """The ids of each piece as unsigned 32-bit numbers; the merges are run once for a piece that isn't held yet."""
        if len(self.merged) > CACHE:
            self.merged = {}
        merge, merged = self.library.model.tokenize, self.merged
        got = list(map(merged.get, ps))
        for k in [k for k, v in enumerate(got) if v is None]:
            p = ps[k]
            got[k] = merged[p] = array("I", [t.id for t in merge(p.decode() if p.isascii() else p.decode("latin-1").translate(_BYTES))]).tobytes()
        return got

    def ids_of_words(self, raws: list[bytes]) -> list[np.ndarray]:
        """The ids of each plain text, by the lower-casing vocabulary."""
        pieces, before = word_pieces(raws)
        coded = pieces.dictionary_encode()
        runs, which = self.runs(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy()
        flat, sizes = np.frombuffer(b"".join(runs), np.uint32), np.fromiter(map(len, runs), np.int32, len(runs)) // 4
        n = sizes[which]
        ends = np.cumsum(n, dtype=np.int32)
        ids = flat[np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes)[which] - (ends - n), n) + np.arange(n.sum(), dtype=np.int32)]
        return np.split(ids, np.append(0, ends)[before[1:-1]])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text, without special tokens added."""
        if self.lower:
            raws = [t.encode() for t in texts]
            known = list(map(plain, raws))
            those = [r for r, k in zip(raws, known, strict=True) if k]
            group = np.cumsum([len(r) for r in those]) // GROUP
            words = chain.from_iterable(self.ids_of_words([those[i] for i in np.flatnonzero(group == g)]) for g in np.unique(group))
            return [next(words) if k else np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) for t, k in zip(texts, known, strict=True)]
        return [np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) if (ps := self.parts(t)) is None else np.fromiter(chain.from_iterable(self.looked_up(ps)), np.uint32) for t in texts]

    def counts(self, texts: list[str]) -> list[int]:
        """The number of ids of each whole text."""
        return [len(self.library.encode(t, add_special_tokens=False).ids) if (ps := self.parts(t)) is None else sum(map(len, self.looked_up(ps))) for t in texts]

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The character at which each piece of the text starts, and the ids before it; last comes the end of the text."""
        ps = self.parts(text)
        if ps is not None and not self.lower:
            return np.r_[0, np.cumsum([len(p) for p in ps])].astype(np.int64), np.r_[0, np.cumsum([len(v) for v in self.looked_up(ps)])].astype(np.int64)
        e = self.library.encode(text, add_special_tokens=False)
        starts, before, last = [], [], object()
        for k, (w, (a, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
            if w is None or w != last:
                starts.append(a)
                before.append(k)
            last = w
        return np.array([*starts, len(text)], np.int64), np.array([*before, len(e.ids)], np.int64)


_ENCODERS: dict[tuple[str, str | None], Encoder] = {}


def encoder(name: str, path: str | None = None) -> Encoder:
    if (name, path) not in _ENCODERS:
        _ENCODERS[name, path] = Encoder(name, path)
    return _ENCODERS[name, path]
