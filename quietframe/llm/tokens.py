"""Token ids by the tokenizers library, fast enough for a corpus.

The library encodes about 1 MB of text a second on a core, and most of a corpus is words that came before. Both tokenizers part a text
at white space before they merge, so the ids of a text are those of its chunks in order. numpy cuts a whole batch into chunks and groups
them by a hash; every chunk's bytes are then compared with those of its group's first, so a collision can't lend one chunk another's ids.
Each distinct chunk is looked up once, by its bytes, and the ids are gathered for all chunks at once. The library makes all ids: it
encodes the chunks that a worker hasn't met. A text that holds the string of one of the tokenizer's added tokens goes to the library whole.

Cuts are made only where they provably change nothing. Where white space is dropped before merging, chunks are the runs between ASCII
white space. Where a chunk carries the space before it, a cut is before white space that is followed by a character that isn't white space
and that is itself a space or follows an ASCII character that isn't white space. Both tokenizers also part letters and digits from marks, so
there are cuts between those too. A pre-token never runs over such a place.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa

from quietframe.llm.common import LONG_WORD, LOWER, SPACE, column_bytes, same_bytes, word_hashes, word_spans

#: ASCII marks that end a run of letters or digits, and begin one after them. No apostrophe: contractions are tokens of their own.
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?%&*$#|")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: Second bytes of U+00C0 to U+00FF that are letters.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_SAME = np.arange(256, dtype=np.uint8)
#: First bytes of characters that may be white space (ASCII ones, and U+0085, U+00A0, U+1680 and so on): no cut before them.
_DOUBTFUL = SPACE.copy()
_DOUBTFUL[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


class Encoder:
    """encode(column): the ids of all texts, one after the other, and where each text's begin. Up to twice `most` chunks are remembered."""

    def __init__(self, path: str, most: int = 400_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content.lower().encode() for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.most = most
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.spaced = self.tok.encode("a b", add_special_tokens=False).ids != self.tok.encode("a  b", add_special_tokens=False).ids

    def whole(self, texts: list[str]) -> list[bytes]:
        """The library's ids of each text, as little-endian unsigned 32-bit numbers."""
        out = [array("I", x.ids) for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return [x.tobytes() for x in out]

    def _find(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of chunks. When what is known is full it becomes the older half, from which chunks that come again return."""
        found = list(map(self.known.get, chunks))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            if len(self.known) > self.most:
                self.older, self.known = self.known, {}
            new = []
            for i in missing:
                ids = self.older.get(chunks[i])
                if ids is None:
                    new.append(i)
                else:
                    found[i] = self.known[chunks[i]] = ids
            for i, ids in zip(new, self.whole([chunks[i].decode() for i in new]), strict=True):
                found[i] = ids
                if len(chunks[i]) <= LONG_WORD:
                    self.known[chunks[i]] = ids
        return found

    def chunks(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(buf)
        inner = np.zeros(n, bool)  # between a letter or digit and a mark
        if n > 1:
            ends = _ALNUM[buf]
            ends[1:] |= _LATIN[buf[1:]] & (buf[:-1] == 0xC3)
            inner[1:] = (ends[:-1] & _MARK[buf[1:]]) | (_MARK[buf[:-1]] & _ALNUM[buf[1:]])
            inner[offsets[(offsets > 0) & (offsets < n)]] = False
        if not self.spaced:
            starts, ends = word_spans(buf, offsets)
            inner = np.flatnonzero(inner)
            return np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
        cut = np.zeros(n, bool)
        if n > 1:
            cut[:-1] = SPACE[buf[:-1]] & ~_DOUBTFUL[buf[1:]]
            plain = ~_DOUBTFUL & (np.arange(256) < 128)
            cut[1:] &= (buf[1:] == 0x20) | plain[buf[:-1]]
        begin = offsets[:-1][np.diff(offsets) > 0]
        cut[begin[1:] - 1] = False  # the last byte of a text has nothing after it
        cut[begin] = True
        cut |= inner
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], n) if n else starts

    def encode(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        buf, offsets = column_bytes(column)
        starts, ends = self.chunks(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, ends = self._uncut(buf, offsets, starts, ends)
        fold = _SAME if self.spaced else LOWER
        _, first, which = np.unique(word_hashes(buf, starts, ends, fold), return_index=True, return_inverse=True)
        alone = np.flatnonzero(~same_bytes(fold[buf], starts, ends, first[which]))  # a collision: these stand for themselves
        which[alone] = len(first) + np.arange(len(alone))
        first = np.concatenate([first, alone])
        data = buf.tobytes()
        found = self._find([data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        ids = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.cumsum(size) - size
        count = size[which]
        ends_at = np.cumsum(count)
        out = ids[np.repeat(begin[which] - (ends_at - count), count) + np.arange(ends_at[-1])]
        return out, np.concatenate([[0], ends_at])[np.searchsorted(starts, offsets)]

    def _uncut(self, buf: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks again, with each text that may hold an added token as one chunk."""
        low = LOWER[buf].tobytes()
        rows = set()
        for token in self.added:
            at = low.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                rows.add(row)
                at = low.find(token, int(offsets[row + 1]))
        if not rows:
            return starts, ends
        rows = np.array(sorted(rows))
        cut = np.zeros(len(offsets) - 1, bool)
        cut[rows] = True
        keep = ~cut[np.searchsorted(offsets, starts, "right") - 1]
        starts, ends = np.concatenate([starts[keep], offsets[rows]]), np.concatenate([ends[keep], offsets[rows + 1]])
        order = np.argsort(starts)
        return starts[order], ends[order]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
