"""BPE ids of many texts at once, equal to the tokenizers library's.

White space and the edges between an ASCII letter, digit or mark split a text into pieces that the
tokenizer treats apart: its normaliser and its pre-tokenizer never join what such an edge parts.
Bytes from 0x80 on and the apostrophe (contractions) stick to both their neighbours. So each
distinct piece is encoded once by the library and kept in a bounded table; texts are then put
together from the table with array operations. Texts that hold a special token's string go to the
library whole.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from .textbuf import SPACE, Packed, Table, ranges, slices

#: Pieces kept for each Python worker; at more the table starts anew.
KEPT_PIECES = 1_000_000
#: Longer pieces are encoded each time and not kept.
KEPT_BYTES = 64

_SPACE, _LETTER, _DIGIT, _MARK, _GLUE = range(5)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[SPACE] = _SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x80:] = _GLUE
_CLASS[0x27] = _GLUE
#: _EDGE[a, b]: a piece ends between two such bytes.
_EDGE = np.ones((5, 5), bool)
_EDGE[_GLUE, 1:] = _EDGE[1:, _GLUE] = False
_EDGE[_LETTER, _LETTER] = _EDGE[_MARK, _MARK] = False
_EDGE = _EDGE.ravel()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


# How the vocabulary's file normalises and parts texts, which the edges above rest on.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def refuse_others(spec: dict) -> None:
    """An error for a tokenizer whose pieces, lower case or decoding aren't those that this module knows."""
    model = spec.get("model") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback"))
    words = all(not t.get(k) for t in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not (plain and words and spec.get("normalizer") == _NORMALIZER and spec.get("pre_tokenizer") == _PRE_TOKENIZER and spec.get("post_processor") is None and spec.get("decoder") is None):
        raise ValueError("only tokenizers that normalise, part and decode as the public 49k word vocabulary does can be used here")


class WordBpe:
    def __init__(self, spec: str, kept: int = KEPT_PIECES):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(spec)
        self.lib.no_padding()
        self.lib.no_truncation()
        refuse_others(json.loads(spec))
        self.special = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        self.kept = kept
        self._reset()

    def _reset(self) -> None:
        self.table = Table(18)
        self.flat = np.zeros(1 << 18, np.uint16 if self.lib.get_vocab_size() <= 1 << 16 else np.uint32)
        self.used = 0
        self.first, self.count = np.zeros(1 << 17, np.int32), np.zeros(1 << 17, np.int32)

    @property
    def dtype(self) -> np.dtype:
        return self.flat.dtype

    def tokens(self) -> list[str]:
        """What decode() writes for each id."""
        return [self.lib.id_to_token(i) or "" for i in range(self.lib.get_vocab_size())]

    def whole(self, text: str) -> np.ndarray:
        """One text by the library itself."""
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.dtype)

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, first and count for each piece, from the library."""
        ids, counts = [], []
        for i in range(0, len(pieces), 4096):
            part = pieces[i : i + 4096]
            e = self.lib.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, self.dtype))
            counts.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)))
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return (np.concatenate(ids) if ids else np.zeros(0, self.dtype)), np.cumsum(count) - count, count

    def _keep(self, ids: np.ndarray, first: np.ndarray, count: np.ndarray, spans: Packed) -> np.ndarray:
        rows = self.table.add(spans)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.table.n > len(self.first):
            self.first, self.count = np.concatenate([self.first, np.zeros_like(self.first)]), np.concatenate([self.count, np.zeros_like(self.count)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[rows], self.count[rows] = first + self.used, count
        self.used += len(ids)
        return rows

    def pieces(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, each piece's count of them, its start and its end byte.
        No special token's string may stand in the bytes."""
        if not len(buf):
            z = np.zeros(0, np.int64)
            return np.zeros(0, self.dtype), z, z, z
        kind = _CLASS[buf]
        edge = np.empty(len(buf) + 1, bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = _EDGE[kind[:-1] * np.uint8(5) + kind[1:]]
        edge[offs] = True
        at = np.flatnonzero(edge)
        solid = kind[at[:-1]] != _SPACE
        start, end = at[:-1][solid], at[1:][solid]
        plain = _LOWER[buf]  # as the normaliser has it; pieces beyond ASCII stay as they are
        if (buf >= 0x80).any():
            high = np.zeros(len(buf) + 1, np.int32)
            np.cumsum(buf >= 0x80, out=high[1:])
            raw = np.flatnonzero(high[end] > high[start])
            same = ranges(start[raw], end[raw] - start[raw])
            plain[same] = buf[same]
        spans = Packed.of(plain, start, end)
        row = self.table.find(spans)
        miss = np.flatnonzero(row < 0)
        if len(miss) and self.table.n + len(miss) > self.kept:
            self._reset()
            row[:] = -1
            miss = np.arange(len(row))
        first, count, flat = self.first, self.count, self.flat
        if len(miss):
            _, one, back = np.unique(spans.take(miss).numbers(), return_index=True, return_inverse=True)
            data = buf.tobytes()
            new = miss[one]
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            ids, f, c = self._learn(texts)
            short = end[new] - start[new] <= KEPT_BYTES
            keep, lone = np.flatnonzero(short), np.flatnonzero(~short)
            rows = np.full(len(new), -1, np.int64)
            rows[keep] = self._keep(ids[ranges(f[keep], c[keep])], np.cumsum(c[keep]) - c[keep], c[keep], spans.take(new[keep]))
            first, count, flat = self.first, self.count, self.flat
            if len(lone):  # rows after the table's own, for this call only
                n, used = self.table.n, self.used
                rows[lone] = n + np.arange(len(lone))
                first = np.concatenate([self.first[:n], f[lone] + used])
                count = np.concatenate([self.count[:n], c[lone]])
                flat = np.concatenate([self.flat[:used], ids])
            row[miss] = rows[back]
        count = count[row]
        return flat[ranges(first[row], count)], count, start, end

    def encode(self, texts: pa.Array):
        """(first row, end row, ids, n + 1 offsets of the rows' ids) for slices of a column."""
        for lo, hi, buf, offs in slices(texts):
            yield lo, hi, *self.encode_slice(buf, offs)

    def marked(self, data: bytes, offs: np.ndarray) -> np.ndarray:
        """The rows that hold a special token's string."""
        found: set[int] = set()
        for word in self.special:
            at = data.find(word)
            while at >= 0:
                row = int(np.searchsorted(offs, at, side="right")) - 1
                if at + len(word) <= offs[row + 1]:
                    found.add(row)
                at = data.find(word, at + 1)
        return np.array(sorted(found), np.int64)

    def encode_slice(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.apart(buf, offs, buf.tobytes(), self._plain)

    def apart(self, buf: np.ndarray, offs: np.ndarray, data: bytes, plain) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of a slice: rows with a special token's string by the library, the others by plain(buf, offs, data)."""
        rows = self.marked(data, offs)
        if not len(rows):
            return plain(buf, offs, data)
        others = np.setdiff1d(np.arange(len(offs) - 1), rows)
        size = np.diff(offs)[others]
        left = buf[ranges(offs[:-1][others], size)]
        ids, at = plain(left, np.concatenate([[0], np.cumsum(size)]), left.tobytes())
        parts = [np.zeros(0, self.dtype)] * (len(offs) - 1)
        for k, r in enumerate(others.tolist()):
            parts[r] = ids[at[k] : at[k + 1]]
        for r in rows.tolist():
            parts[r] = self.whole(data[offs[r] : offs[r + 1]].decode("utf-8", "replace"))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _plain(self, buf: np.ndarray, offs: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        ids, count, start, _ = self.pieces(buf, offs)
        before = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=before[1:])
        return ids, before[np.searchsorted(start, offs)]


_made: dict[str, WordBpe] = {}


def tokenizer(spec: str) -> WordBpe:
    """One encoder for each Python worker and tokenizer."""
    if spec not in _made:
        _made.clear()
        _made[spec] = WordBpe(spec)
    return _made[spec]


def spec_of(path: str | None = None) -> str:
    """The JSON text of a tokenizer file, checked on the driver; the public 49k word vocabulary if no path is given."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    refuse_others(json.loads(spec))
    return spec
