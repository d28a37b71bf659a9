"""Token ids by a public tokenizer, for many texts at once.

A text is cut where white space follows a character that is surely none, and where one of ``.,;:!?``
follows a letter or digit.  The split patterns of the two tokenizers never match across such a place,
and their special strings hold neither white space nor these marks, so the ids of a text are those of
its pieces in order.  Pieces repeat a lot; each worker encodes a piece
once and keeps its ids in a table of bounded size.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from sitelore.llm.common import byte_slices, ragged, text_buffers

#: Pieces that a worker remembers; the table starts anew beyond that.
REMEMBERED = 600_000
#: Bytes of text that are handled at once, and of pieces that are encoded at once.
SLICE_BYTES, ENCODE_BYTES = 2_000_000, 500_000


STOP, LETTER, LATIN = (np.zeros(256, bool) for _ in range(3))
STOP[list(b".,;:!?")] = True
LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
#: Second bytes of the letters of Latin-1, after C3.
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False


def vocabulary(name: str) -> str:
    """Path of a vocabulary file of the installed public tokenizers, or the path given."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_starts(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted starts of all pieces: text starts and safe places inside texts."""
    white = (body == 32) | ((body >= 9) & (body <= 13))
    at = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    before = body[at - 1]
    two, three, four = (body[np.maximum(at - k, 0)] for k in (2, 3, 4))
    # no white space is written with a lead byte of C3-DF, E0, E4-EF or F0-F4
    lead = ((two >= 0xC3) & (two <= 0xDF)) | (three == 0xE0) | ((three >= 0xE4) & (three <= 0xEF))
    lead |= (four >= 0xF0) & (two >= 0x80) & (two < 0xC0) & (three >= 0x80) & (three < 0xC0)
    lead &= (two >= 0xC3) | ((two >= 0x80) & (two < 0xC0))
    safe = ((before >= 0x21) & (before <= 0x7E)) | ((before >= 0x80) & (before < 0xC0) & lead)
    stop = np.flatnonzero(STOP[body[1:]]) + 1
    letter = LETTER[body[stop - 1]]
    letter |= (body[np.maximum(stop - 2, 0)] == 0xC3) & LATIN[body[stop - 1]]
    mark = np.zeros(len(body) + 1, bool)
    mark[at[safe]] = mark[stop[letter]] = mark[offsets] = True
    return np.flatnonzero(mark[:-1])


class Coder:
    """Encodes texts with one vocabulary file of the ``tokenizers`` library."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.blank, self.folds = self.tokenizer.model, None, False
        plan = json.loads(self.tokenizer.to_str())
        split, form = plan["pre_tokenizer"] or {}, plan["normalizer"] or {}
        if split.get("type") == "ByteLevel" and split["use_regex"] and not form:
            self.blank = "\u0120"  # how the model writes the blank before a word
        elif [p.get("behavior") for p in split.get("pretokenizers", [])] == ["Removed", None]:
            self.folds = {"type": "Lowercase"} in form.get("normalizers", [])
            self.blank = "" if self.folds else None
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.counts = np.zeros(1 << 14, np.int64)
        self.seen = np.zeros(1 << 14, np.uint8)
        self.used = 0

    def prune(self) -> None:
        """Keep the pieces met in most slices since the last time, at most half of what is remembered."""
        seen, least = self.seen[: len(self.index)], 2
        while np.count_nonzero(seen >= least) > REMEMBERED // 2 and least < 255:
            least += 1
        words, keep = list(self.index), np.flatnonzero(seen >= least)[: REMEMBERED // 2]
        if self.counts[keep].sum() > 4 * REMEMBERED:
            return self.forget()
        counts, starts, ids = self.counts[keep], self.starts[keep], self.ids
        self.forget()
        flat = ids[ragged(starts, counts)]
        self._store([words[i] for i in keep.tolist()], counts, flat)

    def _store(self, pieces: list[str], counts: np.ndarray, flat: np.ndarray) -> None:
        first, known = len(self.index), len(self.index) + len(pieces)
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while len(self.starts) < known:
            for name in ("starts", "counts", "seen"):
                setattr(self, name, np.concatenate((getattr(self, name), np.zeros_like(getattr(self, name)))))
        self.ids[self.used : self.used + len(flat)] = flat
        self.counts[first:known] = counts
        self.starts[first:known] = self.used + np.cumsum(counts) - counts
        self.used += len(flat)
        self.index.update(zip(pieces, range(first, known)))

    def _learn(self, pieces: list[str]) -> None:
        done = 0
        while done < len(pieces):
            size, end = 0, done
            while end < len(pieces) and (end == done or size < ENCODE_BYTES):
                size += len(pieces[end])
                end += 1
            part = pieces[done:end]
            encoded = self._encode(part)
            counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
            flat = np.fromiter((i for e in encoded for i in e), np.uint32, int(counts.sum()))
            self._store(part, counts, flat)
            done = end

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece; a lone word of ASCII letters goes straight to the library's model."""
        out, rest = [], []
        for k, piece in enumerate(pieces):
            word = piece[1:] if piece[0] == " " else piece
            if self.blank is None or not (word.isascii() and word.isalpha()):
                rest.append(k)
                out.append(None)
                continue
            word = word.lower() if self.folds else word
            before = self.blank if piece[0] == " " else ""
            out.append([t.id for t in self.model.tokenize(before + word)])
        if rest:
            encoded = self.tokenizer.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False)
            for k, e in zip(rest, encoded):
                out[k] = e.ids
        return out

    def _fold(self, words: list[str]) -> list[str]:
        """Words that differ in case or in blanks before them only, where the vocabulary drops both, as one."""
        if not self.folds:
            return words
        return [w.strip(" \t\n\r\x0b\x0c").lower() or w if w.isascii() and "<" not in w else w for w in words]

    def _pieces(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces in the table, in order; first piece of each text, and the end."""
        starts = piece_starts(body, offsets)
        bounds = np.append(starts, len(body))
        pieces = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(body))
        ).dictionary_encode()
        words = self._fold(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        if len(self.index) + len(words) > REMEMBERED or self.used > 8 * REMEMBERED:
            self.prune()
        numbers = list(map(self.index.get, words))
        if None in numbers:
            self._learn(list(dict.fromkeys(w for w, n in zip(words, numbers) if n is None)))
            numbers = list(map(self.index.get, words))
        numbers = np.array(numbers, np.int64)
        self.seen[numbers] += self.seen[numbers] < 255
        order = numbers[np.asarray(pieces.indices)]
        return order, np.searchsorted(starts, offsets)

    def counts_of(self, column) -> np.ndarray:
        """Number of ids of each text, without keeping the ids."""
        body, offsets = text_buffers(column)
        out = np.zeros(len(offsets) - 1, np.int64)
        for i, j in byte_slices(offsets, SLICE_BYTES):
            order, first = self._pieces(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            sums = np.concatenate(([0], np.cumsum(self.counts[order])))
            out[i:j] = sums[first[1:]] - sums[first[:-1]]
        return out

    def ids_of(self, column, end_id: int | None = None):
        """(first row, last row, ids of those texts one after another, offsets of the texts)."""
        body, offsets = text_buffers(column)
        for i, j in byte_slices(offsets, SLICE_BYTES):
            order, first = self._pieces(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            counts = self.counts[order]
            bounds = np.concatenate(([0], np.cumsum(counts)))[first]
            ids = self.ids[ragged(self.starts[order], counts)]
            if end_id is not None:
                bounds = bounds + np.arange(len(bounds))
                own = np.ones(bounds[-1], bool)
                own[bounds[1:] - 1] = False
                ended = np.full(bounds[-1], end_id, np.uint32)
                ended[own] = ids
                ids = ended
            yield i, j, ids, bounds


@lru_cache(maxsize=2)
def coder(name: str) -> Coder:
    """One coder for a worker and vocabulary."""
    return Coder(name)
