"""Token ids of a byte-level BPE file of the tokenizers library, word by word.

A text's ids are those of its chunks, cut before each single blank that a
visible character follows: the library never joins words over such a place. A
worker keeps the ids of chunks it met. New chunks of Latin letters are merged by
tiktoken with the ranks of the same file's vocabulary, any other chunk, and any
text that may hold a special token, by the tokenizers library itself. Whether a
file allows this is tried on a probe text; if not, whole texts go to the library.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the split pattern that "use_regex" of a byte-level tokenizer stands for.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept in a worker's table, beyond those of the texts at hand; it is emptied when full.
CACHE_WORDS = 600_000
_LATIN = re.compile("[\n -~À-ɏ]*")
_WIDE = re.compile(r" \s")
_PROBE = "Don't stop,\nnow:  Été 42!\n\n Über-all we'll (see) x's 'tis   l'été\t<b> \n z "


def _byte_of() -> dict[str, int]:
    """The visible character that stands for each byte in such a vocabulary."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ChunkIds:
    """Texts -> ids as little-endian uint32 bytes; ``ids`` has those of a blank
    and the word after it, for each of ``words``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge, self.n_bytes = self._merger()
        self.forget()
        if self.merge and self.encode([_PROBE]) != [self.whole(_PROBE)]:
            self.merge = None

    def forget(self) -> None:
        self.words, self.ids = pa.array([""], pa.large_string()), pa.array([self.whole(" ")], pa.large_binary())  # a blank at the end of a text

    def _merger(self):
        """The same merges by tiktoken, and the bytes that each id stands for."""
        import tiktoken

        model = json.loads(self.tokenizer.to_str())["model"]
        byte_of = _byte_of()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        try:
            ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
            pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            order = [model["vocab"]["".join(m)] for m in pairs]
            if model["type"] != "BPE" or order != sorted(order):
                return None, None
            n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
            n_bytes[list(ranks.values())] = list(map(len, ranks))
            return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy, n_bytes
        except (KeyError, ValueError):
            return None, None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _any(self, text: str) -> bytes:
        if _LATIN.fullmatch(text):
            return np.array(self.merge(text), "<u4").tobytes()
        return self.whole(text)

    def _learn(self, words: pa.Array) -> pa.Array:
        """Ids of all new Latin words in one call; their ends follow from the ids' bytes."""
        joined = _joined(words)
        if not _LATIN.fullmatch(joined):
            latin = pc.match_substring_regex(words, rf"\A{_LATIN.pattern}\z")
            rest = words.filter(pc.invert(latin)).to_pylist()
            both = [self._learn(words.filter(latin)), pa.array([self.whole(" " + w) for w in rest], pa.large_binary())]
            first = np.argsort(~latin.to_numpy(zero_copy_only=False), kind="stable")
            return pa.concat_arrays(both).take(pa.array(np.argsort(first)))
        ids, cut = np.zeros(0, "<u4"), np.zeros(len(words) + 1, np.int64)
        if len(words):
            ids = self.merge(" " + joined).astype("<u4", copy=False)
            ends = np.cumsum(pc.binary_length(words).to_numpy() + 1)
            cut[1:] = 4 * np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 4
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(cut), pa.py_buffer(ids)])

    def _of(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words, each after a blank."""
        at = pc.index_in(words, value_set=self.words)
        if len(self.words) + at.null_count > CACHE_WORDS:
            self.forget()
            at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            new = words.filter(pc.is_null(at))
            at = at.fill_null(-1).to_numpy().copy()
            at[at < 0] = len(self.words) + np.arange(len(new))
            self.ids = pa.concat_arrays([self.ids, self._learn(new)])
            self.words = pa.concat_arrays([self.words, new])
        return self.ids.take(pa.array(at))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        split: list[int] = []
        rests: list[str] = []
        for i, text in enumerate(texts):
            if not self.merge or "<|" in text:
                out[i] = self.whole(text)
            elif _WIDE.search(text):
                out[i] = self._any(text)
            else:
                first, blank, rest = text.partition(" ")
                out[i] = self._any(first)
                if blank:
                    split.append(i)
                    rests.append(rest)
        if split:
            # a distinct word is looked up once, however often the texts have it
            lists = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
            words = lists.values.dictionary_encode()
            _, places, data = self._of(words.dictionary).take(words.indices).buffers()
            ends, found = np.frombuffer(places, np.int64)[lists.offsets.to_numpy()].tolist(), memoryview(data)
            for i, a, b in zip(split, ends, ends[1:]):
                out[i] += found[a:b]
        return out


def _joined(words: pa.Array) -> str:
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(one, pa.scalar(" ", pa.large_string()))[0].as_py()


_KEPT: dict[str, ChunkIds] = {}


def chunks_of(path: str) -> ChunkIds:
    """One table a Python worker."""
    if path not in _KEPT:
        _KEPT[path] = ChunkIds(path)
    return _KEPT[path]
