"""Exact, memoised encoding of whole texts with the ``tokenizers`` library."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

#: Texts that are worked on at once.
_TEXTS = 1000
#: Words whose ids a worker keeps.
MEMO_WORDS = 160_000
_TWO_SPACES = re.compile(r"\s\s")
_LONE_STOP = re.compile("[.,](?<![A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f][.,])")
#: What byte-level pre-tokenisers keep in one piece, perhaps before a second piece of ASCII signs.
_ONE_PIECE = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")
_ENCODERS: dict[tuple[str, int], "MemoEncoder"] = {}


def default_vocabulary() -> str:
    """Path of the public byte-level BPE vocabulary that is installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in out)
    return out | {b: chr(256 + i) for i, b in enumerate(hidden)}


class MemoEncoder:
    """``encode(text, add_special_tokens=False)`` with a bounded memo of words.

    A byte-level BPE pre-tokeniser never joins a single white-space character to what
    stands before it, so a text without two adjacent white-space characters splits in
    front of each blank or line end into pieces that encode independently.  A text that
    has such a pair (or a NUL, which serves as the cut mark) is encoded in one piece.
    Where every full stop and comma follows a plain letter or digit, those are cuts too.
    The memo holds at most ``memo_words`` words (some 200 bytes each); later words are encoded anew each time.
    Words of letters alone go to the model of the vocabulary without a pre-tokeniser, which
    is the same for them and takes half the time.
    Ids come back as little-endian unsigned integers of ``width`` bytes.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self._tokenizer.to_str())
        self._split = self._tokenizer.pre_tokenizer
        #: Whether words of letters can go to the model without the pre-tokeniser, which is taken off meanwhile.
        self._bare = (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not spec["normalizer"] and not spec["pre_tokenizer"]["add_prefix_space"]
        if self._bare:
            self._bare = not any(t["content"].isalpha() for t in spec["added_tokens"])
            self._letters = _byte_letters()
            del self._letters[10]  # line ends part the words that are mapped together
        self.width = 2 if self._tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self._memo: dict[bytes, bytes] = {}
        self._room = memo_words

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words that stand between two cuts."""
        if not self._bare:
            return self._pack(words)
        pieces, others, ends = [], [], {}
        signed: list[tuple[int, str]] = []
        out: list[bytes] = [b""] * len(words)
        at: list[int] = []
        for i, (word, found) in enumerate(zip(words, map(_ONE_PIECE.fullmatch, words))):
            if found is None or "<|" in word:
                others.append(i)
                continue
            letters, signs = found.groups()
            pieces.append(letters)
            at.append(i)
            if signs:
                signed.append((i, signs))
                ends[signs] = b""
        mapped = "\n".join(pieces).encode().decode("latin-1").translate(self._letters).split("\n") if pieces else []
        for i, ids in zip(at, self._pack(mapped, bare=True)):
            out[i] = ids
        ends = dict(zip(ends, self._pack(list(ends))))
        for i, signs in signed:
            out[i] += ends[signs]
        for i, ids in zip(others, self._pack([words[i] for i in others])):
            out[i] = ids
        return out

    def _pack(self, texts: list[str], bare: bool = False) -> list[bytes]:
        if not texts:
            return []
        kind = "H" if self.width == 2 else "I"
        if bare:
            self._tokenizer.pre_tokenizer = None
        try:
            done = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        finally:
            if bare:
                self._tokenizer.pre_tokenizer = self._split
        packed = [array(kind, x.ids) for x in done]
        if sys.byteorder == "big":
            for x in packed:
                x.byteswap()
        return [x.tobytes() for x in packed]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null counts as empty."""
        return [x for at in range(0, len(texts), _TEXTS) for x in self._encode(texts[at : at + _TEXTS])]

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        out = [b""] * len(texts)
        whole, fine, coarse = [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if "\0" in text or "\1" in text or _TWO_SPACES.search(text):
                whole.append(i)
            else:
                (coarse if _LONE_STOP.search(text) else fine).append(i)
        for group, stops in ((fine, True), (coarse, False)):
            if group:
                for i, ids in zip(group, self._cut([texts[i] for i in group], stops)):
                    out[i] = ids
        if whole:
            for i, ids in zip(whole, self._pack([texts[i] for i in whole])):
                out[i] = ids
        return out

    def _cut(self, texts: list[str], stops: bool) -> list[bytes]:
        """Texts cut into words, whose distinct ones are found in an Arrow dictionary and encoded once."""
        import numpy as np
        import pyarrow as pa

        marked = "\1".join(texts).replace(" ", "\0 ").replace("\n", "\0\n")
        if stops:
            marked = marked.replace(".", "\0.").replace(",", "\0,")
        data = np.frombuffer((marked + "\1").encode(), np.uint8).copy()
        ends = np.flatnonzero(data <= 1)  # of words; each word keeps its mark
        last = np.flatnonzero(data[ends] == 1)  # the last word of each text
        data[ends] = 0
        offsets = np.concatenate([[0], ends + 1]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        found = list(map(self._memo.get, distinct))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            room = self._room - len(self._memo)
            for i, ids in zip(missing, self._words([distinct[i][:-1].decode() for i in missing])):
                found[i] = ids
                if room > 0:
                    self._memo[distinct[i]] = ids
                    room -= 1
        flat = np.frombuffer(b"".join(found), self.dtype)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        index = words.indices.to_numpy()
        each = size[index]
        stop = np.cumsum(each)
        ids = flat[np.repeat((np.cumsum(size) - size)[index] - (stop - each), each) + np.arange(stop[-1])]
        data, cuts = ids.tobytes(), (stop[last] * self.width).tolist()
        return [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]


def encoder(path: str, memo_words: int = MEMO_WORDS) -> MemoEncoder:
    """The encoder of this Python worker, loaded once."""
    key = (path, memo_words)
    if key not in _ENCODERS:
        _ENCODERS[key] = MemoEncoder(path, memo_words)
    return _ENCODERS[key]
