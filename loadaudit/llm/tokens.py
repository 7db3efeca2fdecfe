"""Token ids of whole texts by a public tokenizer, each distinct word encoded once.

The vocabulary's normaliser and splitter never look across white space, nor from a letter
to punctuation behind it, so the ids of a text are the ids of its pieces in order. A worker
keeps the pieces it has met in a table of bounded size.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
#: Pieces a worker remembers; beyond that the table starts anew. Only speed depends on it.
REMEMBER = 600_000
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_BREAK = f"([{LETTERS}])([.,;:!?*#$%&|]+)"
_PLAIN = re.compile(f"[{LETTERS}]+")
TOGETHER = 2000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts, as the library's plain call gives them: the string of a special token in
    a text is that token."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.bits = max(1, (size - 1).bit_length())
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _put(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n, k = len(self.known), len(words)
        while n + k > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[n : n + k] = self.used + np.cumsum(counts) - counts
        self.count[n : n + k] = counts
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + k), strict=True))

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if _PLAIN.fullmatch(w)]
        other = [w for w in words if not _PLAIN.fullmatch(w)]
        for i in range(0, len(plain), TOGETHER):
            some = plain[i : i + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some):  # a word of letters is one piece, and a piece ends in one closing token
                self._put(some, ids, np.diff(ends, prepend=0))
            else:
                other += some
        if other:
            each = [x.ids for x in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
            counts = np.array([len(x) for x in each], np.int64)
            self._put(other, np.array([i for x in each for i in x], np.uint32), counts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, index of the first id of each and the end).
        A text that holds the string of a special token is encoded whole by the library."""
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        for name in self.special:
            whole |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._pieces(texts)
        ids, at = self._pieces(pc.if_else(pa.array(~whole), texts, ""))
        parts = np.split(ids, at[1:-1])
        rows = np.flatnonzero(whole)
        coded = self.tokenizer.encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)
        for k, one in zip(rows.tolist(), coded, strict=True):
            parts[k] = np.array(one.ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _BREAK, r"\1 \2"))
        at = words.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        # Case is dropped by the normaliser; for ASCII words it can be dropped here.
        names = [w.lower() if w.isascii() else w for w in names]
        if len(self.known) + len(names) > REMEMBER:
            self.clear()
        if missing := list(dict.fromkeys(w for w in names if w not in self.known)):
            self._learn(missing)
        where = np.fromiter((self.known[w] for w in names), np.int64, len(names))[coded.indices.to_numpy()] if names else np.empty(0, np.int64)
        count = self.count[where]
        begin = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.repeat(self.first[where] - begin[:-1], count) + np.arange(begin[-1])]
        return ids, begin[at]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
