"""Token ids of whole texts, vectorised over Arrow batches.

``word_bpe_49k.json`` never merges across white space, nor from letters to
punctuation: its normaliser works character by character, its splitter drops
white space and parts letters from other characters.  So a text's ids are the
concatenated ids of its pieces: a white-space-delimited word, or, where a word
is letters followed by punctuation, those two.  A batch is cut into words by
Arrow, each distinct word into its pieces (by Arrow too, if it is ASCII), each new
piece is encoded by the ``tokenizers`` library and remembered, and the ids are
gathered with numpy.
The file's added tokens (<|endoftext|>, <|startoftext|>) found in a text are
one id each, as in a plain call of the library; a word that holds one is a
single piece."""

from __future__ import annotations

import os
import string
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
# Punctuation that may follow a word's letters (no apostrophe: the splitter knows contractions)
_TAIL = '.,;:!?%&*$#|"()<>[]{}/\\=+-_~^@`'
_LETTERS = string.ascii_letters
MAX_PIECES = 500_000
_LINE = 200  # pieces encoded as one text


class WordEncoder:
    """Encodes Arrow string arrays.  About ``max_pieces`` pieces (200 bytes each)
    are remembered; when there are more, all are forgotten, and the common ones
    are soon back."""

    def __init__(self, tokenizer_path: str, max_pieces: int = MAX_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(tokenizer_path)
        self.max_pieces = max_pieces
        # piece 0 is empty
        self._index: dict[str, int] = {"": 0}
        self._pool, self._ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def _ids(self, letters: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and how many each has."""
        ids, counts = [], []
        if letters:
            # each run of letters is one unit of the splitter; long texts cost more a letter
            lines = [letters[i:i + _LINE] for i in range(0, len(letters), _LINE)]
            joined = self._tok.encode_batch([" ".join(x) for x in lines], add_special_tokens=False)
            units = [np.bincount(np.asarray(e.word_ids, np.int64)) for e in joined]
            if all(len(u) == len(x) for u, x in zip(units, lines)):
                ids += [np.asarray(e.ids, np.uint32) for e in joined]
                counts += units
            else:  # a letter that the library does not take for one
                others = letters + others
        if others:
            each = [e.ids for e in self._tok.encode_batch(others, add_special_tokens=False)]
            ids.append(np.fromiter((i for e in each for i in e), np.uint32))
            counts.append(np.fromiter(map(len, each), np.int64, len(each)))
        return np.concatenate(ids), np.concatenate(counts)

    def _split(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct pieces of the words, and the two of every word (the
        second may be empty)."""
        core, tail = pc.ascii_rtrim(words, _TAIL), pc.ascii_ltrim(words, _LETTERS)
        plain = pc.ascii_is_alpha(core)
        first, second = pc.if_else(plain, pc.ascii_lower(core), words), pc.if_else(plain, tail, "")
        # other letters are known to Python
        other = pc.invert(pc.string_is_ascii(words))
        cut = core.filter(other)
        alpha = pa.array(map(str.isalpha, cut.to_numpy(zero_copy_only=False)), pa.bool_())
        first = pc.replace_with_mask(first, other, pc.if_else(alpha, cut, words.filter(other)))
        tailed = np.asarray(pc.not_equal(pc.binary_length(cut), pc.binary_length(words.filter(other)))) & np.asarray(alpha)
        if tailed.any():
            far = np.flatnonzero(np.asarray(other))[tailed]
            mask = np.zeros(len(words), bool)
            mask[far] = True
            tails = [w[len(w.rstrip(_TAIL)):] for w in words.take(pa.array(far)).to_pylist()]
            second = pc.replace_with_mask(second, pa.array(mask), pa.array(tails, words.type))
        both = pa.concat_arrays([first, second]).dictionary_encode()
        at = np.asarray(both.indices, np.int64)
        return both.dictionary, at[:len(words)], at[len(words):]

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers under which the pieces' ids are remembered."""
        if len(self._index) > self.max_pieces:
            self._index = {"": 0}
        index, n = self._index, len(self._index)
        found = np.fromiter(map(index.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [pieces[i] for i in missing.tolist()]
            alpha = np.fromiter(map(str.isalpha, new), bool, len(new))
            letters, others = [w for w in new if w.isalpha()], [w for w in new if not w.isalpha()]
            ids, counts = self._ids(letters, others)
            start = int(self._ends[n - 1])
            self._pool = _room(self._pool, start + len(ids))
            self._ends = _room(self._ends, n + len(new))
            self._pool[start:start + len(ids)] = ids
            self._ends[n:n + len(new)] = start + np.cumsum(counts)
            index.update(zip(letters + others, range(n, n + len(new))))
            found[missing] = n + np.where(alpha, np.cumsum(alpha) - 1, len(letters) + np.cumsum(~alpha) - 1)
        return found

    def encode(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the offset of each
        text's first id (one more entry than texts).  Null counts as empty."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        bounds = np.asarray(words.offsets, np.int64)
        bounds = bounds - bounds[0]
        coded = words.flatten().dictionary_encode()
        pieces, first, second = self._split(coded.dictionary)
        known = self._numbers(pieces.to_numpy(zero_copy_only=False).tolist())
        # the ids of every distinct word one after the other, then those of every word
        two = known[np.stack([first, second], 1).ravel()]
        pool, count = _gather(self._pool, self._ends[two], self._ends[two] - np.where(two > 0, self._ends[two - 1], 0))
        count = count[0::2] + count[1::2]
        number = np.asarray(coded.indices) if len(coded) else np.zeros(0, np.int32)
        ids, count = _gather(pool, np.cumsum(count)[number], count[number])
        offsets = np.concatenate([[0], np.cumsum(count)])[bounds]
        if end_id is None:
            return ids, offsets
        n = len(bounds) - 1
        closed = np.empty(len(ids) + n, np.uint32)
        last = offsets[1:] + np.arange(n)
        keep = np.ones(len(closed), bool)
        keep[last] = False
        closed[last], closed[keep] = end_id, ids
        return closed, offsets + np.arange(n + 1)


def _gather(pool: np.ndarray, end: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of the pool that have these ends and lengths one after the other, and the lengths."""
    before = np.cumsum(count)
    total = int(before[-1]) if len(before) else 0
    narrow = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    return pool[np.repeat((end - before).astype(narrow), count) + np.arange(total, dtype=narrow)], count


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


_SHARED: dict[str, WordEncoder] = {}


def encoder(tokenizer_path: str, max_pieces: int = MAX_PIECES) -> WordEncoder:
    """The Python worker's encoder: the tasks that it runs share what it
    remembers, which is about ``max_pieces`` pieces from now on."""
    if tokenizer_path not in _SHARED:
        _SHARED[tokenizer_path] = WordEncoder(tokenizer_path)
    _SHARED[tokenizer_path].max_pieces = max_pieces
    return _SHARED[tokenizer_path]
