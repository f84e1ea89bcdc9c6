"""Token ids of whole texts from a tokenizer file, with a bounded cache of chunks between spaces.

Both tokenizers never merge across a single space or line feed, so a text's ids are its
chunks' ids end to end. Where that isn't certain (a space or line feed beside other
white space), the whole text goes through the tokenizer. The ids are those of the library's plain call;
the special tokens' strings in a text are special tokens then, or ordinary text with ``special_as_text``.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import encoded

#: texts with white space other than single spaces and line feeds between words
_ODD = r"^[ \n]|[ \n][ \n]|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: before signs: after other letters the tokenizer's own lower case may end in a mark that joins the signs
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(65, 91), *range(97, 123)]] = True


class ChunkEncoder:
    """ids of texts as little-endian unsigned 32-bit integers.

    ``leading_space``: a chunk's ids depend on the space before it (byte-level BPE);
    otherwise white space only separates (word-end BPE). Signs at the end of a chunk, after an ASCII letter, are tokens of
    their own in both, so they are kept apart from what stands before them. ``most``: of these parts kept, of ``most_bytes``
    with their ids at most; a cache that is full is emptied.
    """

    def __init__(self, path: str, leading_space: bool, most: int = 1_000_000, most_bytes: int = 64 << 20, special_as_text: bool = False):
        # a task has one core; the library's threads would take the others' time
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.leading, self.most, self.most_bytes = leading_space, most, most_bytes
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.held = 0
        self.feed = self._raw(["\n"])[0]
        self.cut = int(np.frombuffer(self.feed if leading_space else self._raw(["|"])[0], "<u4")[0])
        # no sign that ends an added token is parted from it
        last = {str(t.content)[-1:] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.sign = np.zeros(256, bool)
        self.sign[[ord(c) for c in _SIGNS if c not in last]] = True
        # of word-end BPE: the ids that end a run of letters
        suffix = None if leading_space else getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True) if suffix else {}
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text. texts: strings without nulls, a few MB at once."""
        whole = np.zeros(0, np.int64)
        if self.leading:
            odd = pc.match_substring_regex(texts, _ODD)
            whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            # every chunk that begins a line holds its line feed; so does the first, and loses it again below
            lines = pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n")
            lines = pc.binary_join_element_wise("\n", lines, "")
        else:
            # the tokenizer takes lower case; doing so for ASCII first leaves fewer chunks
            lines = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
        split = pc.split_pattern(lines, " ")
        chunks = split.flatten().dictionary_encode()
        if len(self.known) + len(self.tails) > self.most or self.held > self.most_bytes:
            self.known.clear()
            self.tails = {"": b""}
            self.held = 0
        cores, tails = self._parted(chunks.dictionary)
        (ids, size, at), (more, extra, then) = self._looked_up(cores, self.known, self._learn), self._looked_up(tails, self.tails, self._learn_tails)
        # a chunk is its core and its tail
        first, size = np.stack([(np.cumsum(size) - size)[at], len(ids) + (np.cumsum(extra) - extra)[then]], 1).ravel(), np.stack([size[at], extra[then]], 1).ravel()
        ids = _gathered(np.concatenate([ids, more]), first, size)
        size = size.reshape(-1, 2).sum(1)
        first, at = np.cumsum(size) - size, chunks.indices.to_numpy(zero_copy_only=False)
        n = size[at]
        ends = np.r_[0, np.cumsum(n)]
        out = _gathered(ids, first[at], n)
        limits = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        skip = 1 if self.leading else 0
        found = [out[a + skip : b] for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)]
        for i in whole.tolist():
            found[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
        return found

    def _parted(self, chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
        """What stands before the signs at the end of every chunk, and these signs."""
        data, at = encoded(chunks)
        start, end = at[:-1], at[1:]
        other = np.where(self.sign[data], 0, np.arange(1, len(data) + 1))
        # after the last byte that is no sign
        cut = np.r_[0, np.maximum.accumulate(other)][end]
        cut = np.where((cut > start) & _PLAIN[data[cut - 1]], cut, end) if len(data) else end
        both = np.r_[np.stack([start, cut], 1).ravel(), at[-1]].astype(np.int32)
        parts = pa.StringArray.from_buffers(2 * len(chunks), pa.py_buffer(both), pa.py_buffer(data))
        every = np.arange(0, 2 * len(chunks), 2)
        return parts.take(pa.array(every)), parts.take(pa.array(every + 1))

    def _looked_up(self, parts: pa.Array, known: dict[str, bytes], learn) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the distinct parts end to end, how many each has, and which one every part is."""
        parts = parts.dictionary_encode()
        words = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        blobs = list(map(known.get, words))
        new = [i for i, x in enumerate(blobs) if x is None]
        if new:
            names = [words[i] for i in new]
            learn(names)
            made = list(map(known.__getitem__, names))
            for i, x in zip(new, made, strict=True):
                blobs[i] = x
            self.held += sum(map(len, names)) + sum(map(len, made))
        return np.frombuffer(b"".join(blobs), "<u4"), np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4, parts.indices.to_numpy(zero_copy_only=False)

    def _joined(self, words: list[str], before: str, mark: str) -> list[bytes]:
        """ids of words that don't hold ``mark``, encoded a hundred at a time with ``mark``, a token of its own, between them."""
        groups = [words[at : at + 100] for at in range(0, len(words), 100)]
        out: list[bytes] = []
        for some, found in zip(groups, self.tokenizer.encode_batch_fast([mark.join([before + x for x in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            ends = [*np.flatnonzero(ids == self.cut).tolist(), len(ids)]
            if len(ends) != len(some):
                return self._raw([before + x for x in words])
            raw = ids.tobytes()
            out.append(raw[: 4 * ends[0]])
            out += [raw[4 * a + 4 : 4 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return out

    def _lettered(self, words: list[str]) -> list[bytes]:
        """ids of runs of ASCII letters, of which each ends in the only id that ends a run."""
        out: list[bytes] = []
        groups = [words[at : at + 100] for at in range(0, len(words), 100)]
        for some, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) != len(some) or ends[-1] != len(ids):
                return self._joined(words, "", " | ")
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def _learn(self, new: list[str]) -> None:
        known = self.known
        if self.leading:
            lines = [x[1:] for x in new if x[:1] == "\n"]
            single = [x for x in new if x[:1] != "\n" and "<|" in x]
            known.update(zip(single, self._raw([" " + x for x in single]), strict=True))
            new = [x for x in new if x[:1] != "\n" and "<|" not in x]
            known.update(zip(new, self._joined(new, " ", "\n"), strict=True))
            feed = self.feed
            known.update(("\n" + x, feed + ids) for x, ids in zip(lines, self._joined(lines, "", "\n"), strict=True))
        else:
            letters = [x for x in new if x.isalpha() and x.isascii()] if self.ends.any() else []
            known.update(zip(letters, self._lettered(letters), strict=True))
            new = [x for x in new if x not in known]
            plain = [x for x in new if "|" not in x]
            known.update(zip(plain, self._joined(plain, "", " | "), strict=True))
            rest = [x for x in new if "|" in x]
            known.update(zip(rest, self._raw(rest), strict=True))

    def _learn_tails(self, new: list[str]) -> None:
        self.tails.update(zip(new, self._raw(new), strict=True))


def _gathered(ids: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of ids, given by their places and lengths, end to end."""
    ends = np.cumsum(n)
    return ids[np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=4)
def encoder(path: str, leading_space: bool) -> ChunkEncoder:
    """One per worker process, so that its cache serves all its tasks."""
    return ChunkEncoder(path, leading_space)
