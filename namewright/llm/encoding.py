"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once.

A text is cut before every space that stands between two characters other than white space. No pre-token of the public
BPE files reaches over such a cut, so the ids of a text are those of its pieces in order. Texts where the cut isn't safe
(a space beside other white space, a special token's string) go through ``Tokenizer.encode`` whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import caches

_WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE = f" {_WHITE}|{_WHITE} "
#: Letters up to here have one lower-case letter each and are in composed form (U+0130 is beyond).
_PLAIN_END = "\u0130"
#: Byte-level BPE shows each byte as one character: printable Latin-1 as itself, the others from U+0100 on.
_OWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _OWN)}
#: Bytes of text that are split into words at once; longer texts are cut at spaces.
AT_ONCE = 2 << 20
#: Bytes of pieces and ids that a worker remembers.
CACHE = 24 << 20
_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


class PieceEncoder:
    """Encodes Arrow string arrays. ``cache``: bytes of pieces and ids that are remembered, about; results don't depend on it."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tok, self.room = Tokenizer.from_file(path), cache
        self.model, self.normalizer, self.pre = self.tok.model, self.tok.normalizer, self.tok.pre_tokenizer
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        probe = self.pre.pre_tokenize_str(self.normalizer.normalize_str(" Éx") if self.normalizer else " Éx")
        #: What stands before a word of Latin letters in its only pre-token, and whether it is lower-cased; None: unknown form, no short cut.
        self.plain = next((p for p in ("", "\u0120") if [c for c, _ in probe] in ([p + "Ã©x"], [p + "Ãīx"])), None)
        self.lower = [c for c, _ in probe] == [f"{self.plain}Ã©x"]
        self.cores: dict[str, bytes] = {}

    @property
    def vocab_size(self) -> int:
        return self.tok.get_vocab_size(with_added_tokens=True)

    def _piece(self, piece: str) -> bytes:
        """Full stops and commas behind a plain letter or digit are a pre-token of their own; word and marks are encoded once each."""
        ids = self.cores.get(piece)
        if ids is None:
            word = piece.rstrip(".,")
            if len(word) < len(piece) and word[-1:].isalnum() and word[-1] < _PLAIN_END:
                return self._cut(word) + self._cut(piece[len(word) :])
            ids = self._cut(piece)
        return ids

    def _cut(self, piece: str) -> bytes:
        ids = self.cores.get(piece)
        if ids is None:
            word = piece[1:]
            if self.plain is not None and piece[:1] == " " and word.isalpha() and max(word) < _PLAIN_END:
                word = word.lower() if self.lower else word
                cores = [self.plain + (word if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN))]
            else:
                norm = self.normalizer.normalize_str(piece) if self.normalizer else piece
                cores = [c for c, _ in self.pre.pre_tokenize_str(norm)]
            ids = array("I", [t.id for c in cores for t in self.model.tokenize(c)]).tobytes()
            need = 200 + 2 * len(piece) + len(ids)
            if need <= self.room:
                self.room -= need
                self.cores[piece] = ids
        return ids

    def _table(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = [self._piece(p) for p in pieces]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return np.frombuffer(b"".join(ids), "<u4"), np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size, size

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Texts where a cut isn't safe."""
        whole = pc.match_substring_regex(texts, _UNSAFE)
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        return whole.to_numpy(zero_copy_only=False)

    def _safe(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts that may be cut before each space."""
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy()
        words = parts.values[offsets[0] : offsets[-1]].dictionary_encode()
        offsets = offsets - offsets[0]
        heads = words.take(pa.array(offsets[:-1])).dictionary_decode().dictionary_encode()
        flat, start, size = self._table([f" {p}" for p in _strings(words.dictionary)] + _strings(heads.dictionary))
        codes = words.indices.to_numpy().astype(np.int64)
        codes[offsets[:-1]] = heads.indices.to_numpy().astype(np.int64) + len(words.dictionary)
        n = size[codes]
        upto = np.concatenate(([0], np.cumsum(n)))
        return flat[np.repeat(start[codes] - upto[:-1], n) + np.arange(upto[-1])], upto[offsets]

    def _alone(self, text: str, whole: bool) -> np.ndarray:
        """Ids of one text; a long one goes in parts that are cut before spaces, if cuts are safe."""
        if whole:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + AT_ONCE)
            end = len(text) if end < 0 else end
            out.append(self._safe(pa.array([text[at:end]], pa.large_string()))[0])
            at = end
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets of its rows in ids) for runs of rows of bounded size; null counts as empty."""
        if not len(texts):
            return
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        for at, end in caches.runs(pc.binary_length(texts).to_pylist(), AT_ONCE):
            some = texts.slice(at, end - at)
            whole = self._whole(some)
            if len(some) == 1:
                ids = self._alone(some[0].as_py(), whole[0])
                bounds = np.array([0, len(ids)])
            else:
                ids, bounds = self._safe(pc.if_else(pa.array(whole), "", some) if whole.any() else some)
                if whole.any():
                    rows = [self._alone(some[i].as_py(), True) if whole[i] else ids[bounds[i] : bounds[i + 1]] for i in range(len(some))]
                    ids, bounds = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
            yield at, ids, bounds

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        return np.concatenate([np.zeros(0, np.int64), *(np.diff(bounds) for _, _, bounds in self.slices(texts))]).astype(np.int64)


def encoder(path: str, cache: int = CACHE) -> PieceEncoder:
    """One encoder for each worker process, that of the last file; what other operators remember is dropped."""
    caches.take("encoding")
    if (path, cache) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, cache] = PieceEncoder(path, cache)
    return _ENCODERS[path, cache]


caches.register("encoding", _ENCODERS.clear)
