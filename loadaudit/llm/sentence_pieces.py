"""SentencePiece encoding and decoding for merge-type vocabularies, by an agenda of symbol pairs.

A normalised text starts as its characters. The agenda holds every pair of neighbouring
symbols that together are a piece, ordered by the piece's score, then from the left; the
best pair becomes one symbol, its new neighbour pairs join the agenda, until it is empty.

Two facts make that fast in numpy without changing a single merge. No merge crosses two
characters that stand side by side in no piece, so a text falls into independent segments
there; and each distinct segment is encoded once per worker. The agendas of all new segments
of a batch run side by side, one best pair of each per round; a segment of more than
``LONG`` characters has a heap of its own. Characters outside the vocabulary become the pieces
of their bytes.

Every batch is also encoded and decoded by the sentencepiece library, and any difference is an
error that names the text's place (``check``).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ID, TEXT, batch, chunks, texts
from .tokens import vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
#: Characters of a segment up to which its agenda runs in rounds beside others.
LONG = 64
#: Segments a worker remembers; beyond that the table starts anew. Only speed depends on it.
REMEMBER = 600_000
_NEVER = np.iinfo(np.int64).max
_SCHEMA = pa.schema([(ID, pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def concatenated(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices first[0] .. first[0]+count[0]-1, first[1] .., one after the other."""
    begin = np.cumsum(count) - count
    return np.repeat(first - begin, count) + np.arange(int(count.sum()))


class Pool:
    """Rows of numbers of different lengths, by row number."""

    def __init__(self, dtype) -> None:
        self.values, self.used = np.zeros(1 << 12, dtype), 0
        self.first, self.count, self.rows = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while self.rows + len(counts) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.values[self.used : self.used + len(values)] = values
        self.first[self.rows : self.rows + len(counts)] = self.used + np.cumsum(counts) - counts
        self.count[self.rows : self.rows + len(counts)] = counts
        self.used, self.rows = self.used + len(values), self.rows + len(counts)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of the rows one after the other, length of each)."""
        count = self.count[rows]
        return self.values[concatenated(self.first[rows], count)], count


class Pieces:
    """A vocabulary, its merges, and the segments met so far."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = lib = SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(n)]
        names = [lib.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.array([i for i in range(n) if lib.is_byte(i)], np.int64)
        if len(self.byte_ids) != 256 or any(lib.is_unused(i) for i in range(n)):
            raise ValueError("a vocabulary of merges with the 256 byte pieces is needed")
        pieces = {p: i for i, p in enumerate(names) if not special[i]}

        # Symbols: pieces, then single characters that only longer pieces hold, then all others.
        letters = sorted({c for p in pieces if len(p) > 1 for c in p})
        symbols = dict(pieces)
        for c in letters:
            symbols.setdefault(c, n + len(symbols) - len(pieces))
        self.n, self.other = n, n + len(symbols) - len(pieces)
        self.symbol = np.full(0x110000, self.other, np.int32)
        for name, i in symbols.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        # Letters that stand side by side in some piece; number 0 is any other character.
        number = {c: k + 1 for k, c in enumerate(letters)}
        self.letter = np.zeros(0x110000, np.int32)
        for c, k in number.items():
            self.letter[ord(c)] = k
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        merges = {}
        ranks = {s: k for k, s in enumerate(sorted({lib.get_score(i) for i in pieces.values()}, reverse=True))}
        self.base = self.other + 1
        for p, i in pieces.items():
            for k in range(1, len(p)):
                self.beside[number[p[k - 1]], number[p[k]]] = True
                if p[:k] in symbols and p[k:] in symbols:
                    merges[symbols[p[:k]] * self.base + symbols[p[k:]]] = (ranks[lib.get_score(i)], i)
        self.keys = np.array(sorted(merges), np.int64)
        self.rank = np.array([merges[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([merges[k][1] for k in self.keys.tolist()], np.int32)
        self.merges = merges
        self.width = np.ones(self.base, np.int64)  # characters of each symbol
        for p, i in pieces.items():
            self.width[i] = len(p)

        self.spelled = Pool(np.uint8)  # the bytes that each id decodes to
        out = [b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        for value, i in enumerate(self.byte_ids.tolist()):
            out[i] = bytes([value])
        self.spelled.add(np.frombuffer(b"".join(out), np.uint8), np.array([len(x) for x in out]))
        self.unknown = lib.unk_id()
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = Pool(np.uint32)

    # Encoding.

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of the pairs of symbols; rank _NEVER where they are no piece."""
        key = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NEVER), self.made[at]

    def _rounds(self, symbols: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of segments that begin at ``start``, and how many each has: in each
        round the best pair of every segment is merged."""
        n = len(start)
        owner = np.repeat(np.arange(n), np.diff(np.append(start, len(symbols))))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, piece = self._pairs(symbols, owner)
        while len(symbols):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            size = np.diff(np.append(first, len(owner)))
            # Best score, then leftmost.
            order = np.where(rank == _NEVER, _NEVER, rank * LONG + np.arange(len(rank)) - np.repeat(first, size))
            best = np.minimum.reduceat(order, first)
            live = best != _NEVER
            ended = np.repeat(~live, size)
            if ended.any():
                done.append((owner[ended], symbols[ended]))
            at = first[live] + best[live] % LONG
            symbols[at] = piece[at]
            keep = ~ended
            keep[at + 1] = False
            new = np.cumsum(keep) - 1
            symbols, owner, rank, piece = symbols[keep], owner[keep], rank[keep], piece[keep]
            at = new[at]
            touched = np.concatenate([at[at > 0] - 1, at])
            again, piece[touched] = self._look(symbols[touched], symbols[np.minimum(touched + 1, len(symbols) - 1)])
            inside = (touched + 1 < len(symbols)) & (owner[touched] == owner[np.minimum(touched + 1, len(symbols) - 1)])
            rank[touched] = np.where(inside, again, _NEVER)
        owners = np.concatenate([o for o, _ in done])
        order = np.argsort(owners, kind="stable")
        return np.concatenate([s for _, s in done])[order], np.bincount(owners, minlength=n)

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, piece = self._look(symbols, np.append(symbols[1:], 0))
        rank[:-1][owner[1:] != owner[:-1]] = _NEVER
        rank[-1:] = _NEVER
        return rank, piece

    def _heap(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """Final symbols of one segment, and the places of their first characters."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges, base, agenda = self.merges, self.base, []

        def offer(a: int) -> None:
            if a >= 0 and (b := after[a]) < n and (found := merges.get(symbols[a] * base + symbols[b])):
                heapq.heappush(agenda, (found[0], a, symbols[a], symbols[b], found[1]))

        for a in range(n):
            offer(a)
        while agenda:
            _, a, x, y, made = heapq.heappop(agenda)
            b = after[a]
            if b >= n or symbols[a] != x or symbols[b] != y:
                continue
            symbols[a], symbols[b] = made, -1
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a])
            offer(a)
        left = [i for i in range(n) if symbols[i] >= 0]
        return [symbols[i] for i in left], left

    def _ids(self, symbols: np.ndarray, codes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each segment): symbols as ids, characters outside the vocabulary as
        the ids of their bytes. ``codes`` are their characters; ``count`` symbols a segment."""
        strange = np.flatnonzero(symbols >= self.n)
        width = np.ones(len(symbols), np.int64)
        found, inverse = np.unique(codes[strange], return_inverse=True)
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in found.tolist()]
        width[strange] = np.array([len(s) for s in spelled], np.int64)[inverse] if len(strange) else 0
        to = np.cumsum(width) - width
        ids = np.zeros(int(width.sum()), np.uint32)
        plain = symbols < self.n
        ids[to[plain]] = symbols[plain]
        for k in range(4):
            some = [j for j, s in enumerate(spelled) if len(s) > k]
            if some:
                value = np.array([s[k] if len(s) > k else 0 for s in spelled])
                rows = np.flatnonzero(np.isin(inverse, some))
                ids[to[strange[rows]] + k] = self.byte_ids[value[inverse[rows]]]
        return ids, np.bincount(np.repeat(np.arange(len(count)), count), weights=width, minlength=len(count)).astype(np.int64)

    def _learn(self, names: list[str]) -> None:
        for some, long in (([s for s in names if len(s) <= LONG], False), ([s for s in names if len(s) > LONG], True)):
            if not some:
                continue
            codes = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4")
            size = np.array([len(s) for s in some], np.int64)
            start = np.cumsum(size) - size
            symbols = self.symbol[codes]
            if long:
                parts = [self._heap(symbols[a : a + k].tolist()) for a, k in zip(start.tolist(), size.tolist(), strict=True)]
                final = np.array([s for p, _ in parts for s in p], np.int32)
                count = np.array([len(p) for p, _ in parts], np.int64)
                where = np.array([a + i for a, (_, p) in zip(start.tolist(), parts, strict=True) for i in p], np.int64)
            else:
                final, count = self._rounds(symbols.copy(), start)
                # A symbol outside the vocabulary is one character; the others' widths follow.
                where = np.repeat(start, count) + self._offsets(final, count)
            ids, counts = self._ids(final, codes[where], count)
            self.pool.add(ids, counts)
            self.known.update(zip(some, range(len(self.known), len(self.known) + len(some)), strict=True))

    def _offsets(self, symbols: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Characters before each symbol in its segment."""
        width = self.width[symbols]
        before = np.cumsum(width) - width
        return before - np.repeat(before[np.cumsum(count) - count], count)

    def segments(self, normal: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(the segments of the texts one after the other, index of the first of each and the end)."""
        whole = "".join(normal)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        at = np.concatenate([[0], np.cumsum([len(s) for s in normal])]).astype(np.int64)
        if not len(codes):
            return pa.array([], pa.large_string()), np.zeros(len(at), np.int64)
        letter = self.letter[codes]
        begins = np.ones(len(codes), bool)
        begins[1:] = ~self.beside[letter[:-1], letter[1:]]
        begins[at[:-1][at[:-1] < len(codes)]] = True
        width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        start = np.flatnonzero(begins)
        places = np.append((np.cumsum(width) - width)[start], width.sum()).astype(np.int64)
        raw = pa.py_buffer(whole.encode("utf-8", "surrogatepass"))
        return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(places), raw), np.searchsorted(start, at)

    def encode(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, index of the first id of each and the end)."""
        parts, at = self.segments(self.library.normalize(items))
        coded = parts.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.known) + len(names) > REMEMBER:
            self.clear()
        if missing := [s for s in names if s not in self.known]:
            self._learn(missing)
        rows = np.fromiter((self.known[s] for s in names), np.int64, len(names))[coded.indices.to_numpy()] if names else np.empty(0, np.int64)
        ids, count = self.pool.take(rows)
        return ids, np.concatenate([[0], np.cumsum(count)])[at]

    # Decoding.

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of the ids from at[k] to at[k+1]."""
        raw, count = self.spelled.take(ids.astype(np.int64))
        place = np.concatenate([[0], np.cumsum(count)])[at].tolist()
        odd = np.add.reduceat(np.append(ids == self.unknown, False).astype(np.int64), at[:-1]) * (np.diff(at) > 0) if len(at) > 1 else []
        whole, out = raw.tobytes(), []
        spelled, single = self.spelled.count, set(self.byte_ids.tolist())
        for k, (a, b) in enumerate(zip(place[:-1], place[1:], strict=True)):
            i, end = int(at[k]), int(at[k + 1])
            while i < end and not spelled[ids[i]]:
                i += 1
            if i < end and whole[a : a + 1] == b" " and ids[i] not in single:
                a += 1  # the space that encoding puts before a text
            try:
                if odd[k]:
                    raise UnicodeError
                out.append(whole[a:b].decode())
            except UnicodeError:  # unknown ids, or bytes that are no character
                out.append(self.library.decode(ids[at[k] : end].tolist()))
        return out


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """This worker's copy of a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def with_ends(ids: np.ndarray, at: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids between a begin and an end id."""
    n = len(at) - 1
    to = at + 2 * np.arange(n + 1)
    out = np.empty(len(ids) + 2 * n, np.uint32)
    inner = np.ones(len(out), bool)
    inner[to[:-1]] = inner[to[1:] - 1] = False
    out[inner] = ids
    out[to[:-1]], out[to[1:] - 1] = first, last
    return out, to


def _compare(code: Pieces, items: list[str], ids: np.ndarray, at: np.ndarray, decoded: list[str]) -> None:
    theirs = code.library.encode(items, add_bos=True, add_eos=True, num_threads=1)
    for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if not np.array_equal(ids[a:b], np.array(theirs[k], np.uint32)):
            raise ValueError(f"the ids of a text of {len(items[k])} characters differ from the library's: {items[k][:80]!r}")
    for k, text in enumerate(code.library.decode(theirs, num_threads=1)):
        if text != decoded[k]:
            raise ValueError(f"the decoded text of {len(items[k])} characters differs from the library's: {items[k][:80]!r}")


def encode(docs: DataFrame, vocabulary: str | None = None, check: bool = True, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit, begin and end id included) and
    decoded (the text that the ids give) of every text.

    A null or empty text is its begin and end id and decodes to an empty text; rows that
    repeat an id, or have none, are rows of their own; other columns are left out; an empty
    table gives no rows. ``check`` compares ids and decoded texts of every batch with the
    library's. The vocabulary has the 256 byte pieces and no pieces defined by a user. One
    pass, no shuffle; a task holds one batch and at most ``REMEMBER`` segments.
    """
    path = vocabulary or vocabulary_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = pieces(path)
        for b in batches:
            for lo, hi, _, _ in chunks(b.column(1)):
                items = [t or "" for t in b.column(1).slice(lo, hi - lo).to_pylist()]
                ids, at = with_ends(*code.encode(items), code.library.bos_id(), code.library.eos_id())
                decoded = code.decode(ids, at)
                if check:
                    _compare(code, items, ids, at, decoded)
                raw = [ids[x:y].astype("<u4").tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield batch(_SCHEMA, b.column(0).slice(lo, hi - lo), np.diff(at), raw, decoded)

    return texts(docs, id_col, text_col).mapInArrow(run, f"{ID} bigint, n_tokens bigint, ids binary, decoded string")


def decode(rows: DataFrame, vocabulary: str | None = None, id_col: str = ID, ids_col: str = "ids") -> DataFrame:
    """doc_id and text of ids stored as little-endian unsigned 32-bit numbers; no ids, or
    null, give an empty text. Ids outside the vocabulary are an error."""
    path = vocabulary or vocabulary_path(VOCABULARY)
    schema = pa.schema([(ID, pa.int64()), (TEXT, pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = pieces(path)
        for b in batches:
            parts = [np.frombuffer(x or b"", "<u4") for x in b.column(1).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            ids = np.concatenate([np.empty(0, "<u4"), *parts])
            if len(ids) and ids.max() >= code.n:
                raise ValueError(f"id {ids.max()} is outside the vocabulary of {code.n}")
            yield batch(schema, b.column(0), code.decode(ids, at))

    return rows.selectExpr(f"{id_col} AS {ID}", f"{ids_col} AS ids").mapInArrow(run, f"{ID} bigint, {TEXT} string")
