"""Byte-level BPE over whole batches: distinct pieces are encoded once, the rest is array work.

A text is cut before every space that is followed by a character other than white space.  The
pre-tokenisation of byte-level BPE always has a border there and looks at nothing before it, so
pieces can be encoded one by one and the result is that of the whole text.
"""

from __future__ import annotations

import json
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexgrain.llm.arrow_text import utf8

#: Fixed: the pre-tokenisation pattern of this kind of tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes after a space that may begin white space, where a text is not cut.
_MAY_BE_SPACE = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]
#: Pieces with a byte from here on go to the tokenizer library itself: below U+2000 both
#: libraries class characters alike (tested), above they may follow different Unicode versions.
_FIRST_FOREIGN_BYTE = 0xE2
#: Pieces of so many bytes go to the tokenizer library: the other one's pattern engine has a stack
#: that a run of about a million blanks overflows.
_LONG_PIECE = 1 << 16
#: Text encoded at once; the larger, the more often its pieces repeat.
BATCH_BYTES = 8 << 20


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in shown}
    rest = (b for b in range(256) if b not in set(shown))
    table.update({chr(256 + i): b for i, b in enumerate(rest)})
    return table


class ByteBpe:
    """Encoder for one vocabulary file."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = _byte_of()
        self.bytes_of = {
            i: bytes(byte_of[c] for c in token)
            for token, i in spec["model"]["vocab"].items()
            if token not in self.special
        }
        self.size = 1 + max([*self.bytes_of, *self.special.values()])
        self.merger = tiktoken.Encoding(
            path,
            pat_str=PATTERN,
            mergeable_ranks={b: i for i, b in self.bytes_of.items()},
            special_tokens={},
        )

    @cached_property
    def library(self):
        """The tokenizer library, loaded when a piece needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def lengths(self) -> np.ndarray:
        """Bytes of each token."""
        table = np.zeros(self.size, np.int64)
        for i, b in self.bytes_of.items():
            table[i] = len(b)
        return table

    def closes_sentence(self) -> np.ndarray:
        """Whether a sentence or line may end after each token."""
        table = np.zeros(self.size, bool)
        for i, b in self.bytes_of.items():
            table[i] = b.rstrip()[-1:] in (b".", b"!", b"?") or b"\n" in b
        return table

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, starts, sizes)``: piece i has ``ids[starts[i]:starts[i] + sizes[i]]``."""
        flat, offsets = utf8(pieces)
        foreign = np.concatenate([[0], np.cumsum(flat >= _FIRST_FOREIGN_BYTE)])
        alone = foreign[offsets[1:]] > foreign[offsets[:-1]]
        alone |= np.diff(offsets) >= _LONG_PIECE
        for content in self.special:
            alone |= pc.match_substring(pieces, content).to_numpy(zero_copy_only=False)
        spaced = np.zeros(len(pieces), bool)
        filled = offsets[1:] > offsets[:-1]
        spaced[filled] = flat[offsets[:-1][filled]] == 0x20
        joined, rest, odd = spaced & ~alone, ~spaced & ~alone, alone
        # Every joined piece begins with a space, so all borders between them are token borders.
        text, cuts = utf8(pieces.filter(pa.array(joined)))
        merged = self.merger.encode_to_numpy(text.tobytes().decode(), disallowed_special=())
        parts = [np.asarray(merged, np.uint32)]
        sizes = np.zeros(len(pieces), np.int32)
        ends = np.searchsorted(np.cumsum(self.lengths[parts[0]]), cuts[1:]) + 1
        sizes[joined] = np.diff(ends, prepend=0)
        found = [self.merger.encode_ordinary(p.decode()) for p in pieces.filter(pa.array(rest)).to_pylist()]
        sizes[rest] = [len(f) for f in found]
        texts = [p.decode() for p in pieces.filter(pa.array(odd)).to_pylist()]
        encoded = [
            e.ids
            for begin in range(0, len(texts), 1000)
            for e in self.library.encode_batch(texts[begin : begin + 1000], add_special_tokens=False)
        ]
        sizes[odd] = [len(f) for f in encoded]
        parts += [np.asarray(f, np.uint32) for f in found + encoded]
        starts = np.zeros(len(pieces), np.int32)
        order = np.concatenate([np.flatnonzero(joined), np.flatnonzero(rest), np.flatnonzero(odd)])
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(parts), starts, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, ends)``: the ids of all texts one after another and where each text ends."""
        codes, dictionary, rows = distinct_pieces(texts)
        ids, starts, sizes = self.encode_pieces(dictionary)
        starts, sizes = starts[codes], sizes[codes]
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total, dtype=np.int64)
        take += np.repeat(starts - (ends - sizes), sizes)
        return ids[take], np.concatenate([[0], ends])[rows]


@cache
def loaded_bpe(path: str) -> ByteBpe:
    """One encoder for all tasks of a Python worker."""
    return ByteBpe(path)


def distinct_pieces(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """``(codes, dictionary, rows)``: the pieces of all texts as codes of distinct pieces.

    ``rows[i]`` is the number of pieces up to the end of text i.
    """
    flat, offsets = utf8(texts)
    n = len(flat)
    splits = np.zeros(n, bool)
    if n > 1:
        blocked = np.zeros(256, bool)
        blocked[_MAY_BE_SPACE] = True
        splits[:-1] = (flat[:-1] == 0x20) & ~blocked[flat[1:]]
        ends = offsets[1:][offsets[1:] > 0]
        splits[ends - 1] = False  # the last byte of a text
    inner = offsets[:-1]
    splits[inner[inner < n]] = True
    borders = np.append(np.flatnonzero(splits), n).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(),
        len(borders) - 1,
        [None, pa.py_buffer(borders.tobytes()), pa.py_buffer(flat)],
    )
    encoded = pc.dictionary_encode(pieces)
    rows = np.searchsorted(borders, offsets[1:], side="left")
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary, rows
