"""Byte-level BPE: texts to token ids and back, equal to the public tokenizer of the rank file.

Pre-tokenisation needs no regex. Code points become classes by one table lookup; what the pattern looks ahead for
(contractions, the last white space of a run) is folded into the classes. Each class is a transition function of a
small automaton; functions are composed by a table, blocks are composed in parallel and joined by a prefix scan, and
the state before every character tells whether a token starts there. The resulting byte slices go through a cache
of merged pieces; new pieces are merged side by side, as rows of a matrix. Tokens of a text cover its bytes without gaps, so their end offsets locate any token range, and decoding goes by them.

NULL and empty texts have no ids and no bytes. Texts may have any length (a long one is scanned whole); repeated rows give
their result once per row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
CHUNK = 1 << 20         # characters that are scanned at once; a longer text is scanned whole
BLOCK = 256
CACHE = 400_000         # pieces that a worker remembers
CACHED_BYTES = 64       # longer pieces are not remembered
HEAP_FROM = 48          # pieces of more bytes are merged with a heap
HEIGHTS = (4, 8, 12, 16, 24, HEAP_FROM)     # of the matrices in which shorter pieces are merged
ROW_BITS = 6

NONE = 1 << 24          # rank of a pair that makes no token

# Letters and numbers that Unicode 16 added to the tables of Python (ranges, both ends included).
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
WHITE_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# Classes of characters with what follows them.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, GLUE, BREAK = range(8)
# SHORT, LONG: an apostrophe before one (s t m d) or two (re ve ll) letters of a contraction. SPACE: white space
# before white space or the end; GLUE: a blank before something else, which joins it; BREAK: other such white space.
_OTHER, _LETTER, _NUMBER, _SPACE, _END = range(5)
# States before a character: nothing to go on with, or in a run of the named kind; ONE, TWO: letters of a
# contraction that are left.
FRESH, LETTERS, NUMBERS, OTHERS, SPACES, GLUED, ONE, TWO = range(8)


@lru_cache(1)
def code_classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = _LETTER if kind == "L" else _NUMBER
    for ranges, kind in ((NEW_LETTERS, _LETTER), (NEW_NUMBERS, _NUMBER)):
        for a, b in ranges:
            table[a:b + 1] = kind
    table[list(WHITE_SPACE)] = _SPACE
    return table


def _step(kind: int, state: int) -> tuple[int, bool]:
    """The state after a character, and whether a token starts with it."""
    if kind == LETTER:
        if state == TWO:
            return ONE, False
        if state == ONE:
            return FRESH, False
        return LETTERS, state not in (LETTERS, GLUED)
    if kind == NUMBER:
        return NUMBERS, state not in (NUMBERS, GLUED)
    if kind in (OTHER, SHORT, LONG):
        if state in (OTHERS, GLUED):
            return OTHERS, False
        return {OTHER: OTHERS, SHORT: ONE, LONG: TWO}[kind], True
    if kind == SPACE:
        return SPACES, state != SPACES
    return (GLUED if kind == GLUE else FRESH), True


@lru_cache(1)
def transition_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Composition of functions (f, then g), functions of the classes, next states and starts by class, identity.

    Classes 8 to 15 are those of a text's first character: the same whatever the state. Composing the 16 functions
    in all ways gives a finite set, numbered here.
    """
    step = np.array([[_step(k, s) for s in range(8)] for k in range(8)])
    follow, starts = step[:, :, 0], step[:, :, 1].astype(bool)
    follow = np.concatenate([follow, np.repeat(follow[:, :1], 8, 1)]).astype(np.uint8)
    starts = np.concatenate([starts, np.ones((8, 8), bool)])
    numbers = {tuple(range(8)): 0}
    for f in follow.tolist():
        numbers.setdefault(tuple(f), len(numbers))
    todo = list(numbers)
    made = [tuple(f) for f in follow.tolist()]
    while todo:
        f = todo.pop()
        for g in made:
            new = tuple(g[s] for s in f)
            if new not in numbers:
                numbers[new] = len(numbers)
                todo.append(new)
    functions = np.array(list(numbers))
    compose = np.array([[numbers[tuple(g[f])] for g in functions] for f in functions], np.uint16)
    return compose, np.array([numbers[f] for f in made], np.uint16), follow, starts, functions


def states_before(kinds: np.ndarray) -> np.ndarray:
    """The state before every character, by a block-wise prefix scan over transition functions."""
    compose, of_kind, follow, _, functions = transition_tables()
    n = len(kinds)
    rows = -(-n // BLOCK)
    padded = np.zeros(rows * BLOCK, np.uint16)
    padded[:n] = of_kind[kinds]
    padded = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    whole = padded[0].copy()
    for column in padded[1:]:
        whole = compose[whole, column]
    reach = 1
    while reach < rows:  # inclusive scan over the blocks
        whole[reach:] = compose[whole[:-reach], whole[reach:]]
        reach *= 2
    state = np.full(rows, FRESH, np.uint8)
    state[1:] = functions[whole[:-1], FRESH]
    out = np.empty((BLOCK, rows), np.uint8)
    kinds = np.concatenate([kinds, np.zeros(rows * BLOCK - n, kinds.dtype)]).reshape(rows, BLOCK).T
    for i in range(BLOCK):
        out[i] = state
        state = follow[kinds[i], state]
    return out.T.reshape(-1)[:n]


def token_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indexes of the characters that start a token. `first`: index of the first character of each text."""
    cls = code_classes()[codes]
    after = np.full(len(codes), _END, np.uint8)
    after[:-1] = cls[1:]
    after[first[1:] - 1] = _END
    kinds = np.array([OTHER, LETTER, NUMBER], np.uint8)[np.minimum(cls, 2)]
    white = cls == _SPACE
    last = white & (after != _SPACE) & (after != _END)
    kinds[white] = SPACE
    kinds[last] = np.where(codes[last] == 32, GLUE, BREAK)
    mark = np.flatnonzero((codes == 39) & (after == _LETTER))
    one = codes[mark + 1]
    kinds[mark[np.isin(one, list(map(ord, "stmd")))]] = SHORT
    mark, one = mark[after[mark + 1] == _LETTER], one[after[mark + 1] == _LETTER]
    two = codes[mark + 2]
    for a, b in ("re", "ve", "ll"):
        kinds[mark[(one == ord(a)) & (two == ord(b))]] = LONG
    kinds[first] += 8
    return np.flatnonzero(transition_tables()[3][kinds, states_before(kinds)])


def _slot(key: np.ndarray, slots: int) -> np.ndarray:
    """Place of a key in a hash table whose number of slots is a power of two."""
    mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)


def _hash_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (-1: free) and values of a table that is searched from `_slot` on, slot by slot."""
    slots = 1 << (4 * len(keys)).bit_length()
    table, stored = np.full(slots, -1, np.int64), np.zeros(slots, np.int32)
    at = _slot(keys, slots)
    while len(keys):
        free = np.flatnonzero(table[at] < 0)
        table[at[free]] = keys[free]        # of several keys for one slot the last stays
        stored[at[free]] = values[free]
        left = table[at] != keys
        keys, values, at = keys[left], values[left], (at[left] + 1) & (slots - 1)
    return table, stored


class Vocabulary:
    """Ranks of a file of base64 pieces, with bounded memory for merged pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            pieces[rank] = piece
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.lengths = np.array([len(p) for p in pieces])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.known: dict[bytes, bytes] = {}
        self._pair_tables(pieces)

    def _pair_tables(self, pieces: list[bytes]) -> None:
        """Rank of two tokens that make a third one: a full table for bytes, sorted keys for the rest."""
        ranks, keys, values = self.ranks, [], []
        for rank, piece in enumerate(pieces):
            for i in range(1, len(piece)):
                left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self._keys, self._values = _hash_table(np.array(keys, np.int64), np.array(values, np.int32))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.byte_pairs = self._rank_of(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = _slot(key, len(self._keys))
        out = np.full(len(key), NONE, np.int32)
        todo = np.arange(len(key))
        while len(todo):
            seen = self._keys[at]
            same = seen == key[todo]
            out[todo[same]] = self._values[at[same]]
            more = ~same & (seen >= 0)
            todo, at = todo[more], (at[more] + 1) & (len(self._keys) - 1)
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces. In every round each piece merges its pair of lowest rank, the leftmost first.

        Pieces of similar length are the columns of a matrix, filled up with pairs that never merge. A piece that goes
        on loses one row in each round, so all of them keep one height; pieces without a pair to merge leave.
        """
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero(sizes > HEAP_FROM).tolist():
            out[i] = np.array(self._merge_long(pieces[i]), "<u4").tobytes()
        for low, height in zip((0, *HEIGHTS), HEIGHTS):
            members = np.flatnonzero((sizes > low) & (sizes <= height))
            if len(members):
                raw = b"".join([pieces[i].ljust(height, b"\0") for i in members.tolist()])
                raw = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, height).T)
                self._merge_columns(raw, members, sizes[members].astype(np.int32), out)
        return out

    def _merge_columns(self, raw: np.ndarray, members: np.ndarray, size: np.ndarray, out: list[bytes]) -> None:
        rows = np.arange(len(raw), dtype=np.int32)[:, None]
        ids = self.byte_ids[raw]
        pairs = self.byte_pairs[raw[:-1].astype(np.int32) * 256 + raw[1:]]
        pairs[rows[1:] >= size] = NONE
        while len(members):
            # Rank and row in one number: its minimum is the leftmost pair of lowest rank.
            best = ((pairs << ROW_BITS) + rows[:len(pairs)]).min(axis=0, initial=NONE << ROW_BITS)
            done = best >= NONE << ROW_BITS
            if done.any():
                packed = np.ascontiguousarray(ids[:, done].T).astype("<u4").tobytes()
                step = 4 * len(ids)
                for k, (i, n) in enumerate(zip(members[done].tolist(), size[done].tolist())):
                    out[i] = packed[step * k:step * k + 4 * n]
                left = ~done
                members, size, best, ids, pairs = members[left], size[left], best[left], ids[:, left], pairs[:, left]
                if not len(members):
                    return
            at, rank, column = best & ((1 << ROW_BITS) - 1), best >> ROW_BITS, np.arange(len(members))
            size = size - 1
            ids = np.where(rows[:len(ids) - 1] > at, ids[1:], ids[:-1])
            ids[at, column] = rank
            pairs = np.where(rows[:len(pairs) - 1] >= at, pairs[1:], pairs[:-1])
            near = np.flatnonzero(at > 0)
            pairs[at[near] - 1, near] = self._rank_of(ids[at[near] - 1, near], rank[near])
            near = np.flatnonzero(at < size - 1)
            pairs[at[near], near] = self._rank_of(rank[near], ids[at[near] + 1, near])

    def _merge_long(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at an index
        heap = []

        def push(i: int) -> None:
            j = end[i]
            if j < n and (rank := ranks.get(piece[i:end[j]])) is not None:
                heapq.heappush(heap, (rank, i, end[j]))

        for i in range(n):
            push(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if end[i] < 0 or end[i] >= n or end[end[i]] != stop:
                continue  # one of the parts has been merged since
            j = end[i]
            end[i], end[j] = stop, -1
            if stop < n:
                before[stop] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def packed(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of every piece as little-endian unsigned 32-bit integers; each different piece is merged once."""
        found = list(map(self.known.get, pieces))
        missing = [i for i, f in enumerate(found) if f is None]
        if missing:
            new = list(dict.fromkeys([pieces[i] for i in missing]))
            merged = dict(zip(new, self.merge_many(new)))
            for i in missing:
                found[i] = merged[pieces[i]]
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
            self.known.update((p, m) for p, m in merged.items() if len(p) <= CACHED_BYTES)
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of every text; nothing for an empty or NULL one."""
        out, chunk, size = [b""] * len(texts), [], 0
        for i, text in enumerate(texts):
            if text:
                if chunk and size + len(text) > CHUNK:
                    self._encode(chunk, out, texts)
                    chunk, size = [], 0
                chunk.append(i)
                size += len(text)
        if chunk:
            self._encode(chunk, out, texts)
        return out

    def _encode(self, chunk: list[int], out: list[bytes], texts: list[str | None]) -> None:
        joined = "".join([texts[i] for i in chunk])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum([0, *[len(texts[i]) for i in chunk[:-1]]])
        starts = token_starts(codes, first)
        width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(width)])[np.append(starts, len(codes))].tolist()
        raw = joined.encode("utf-8", "surrogatepass")
        found = self.packed([raw[a:b] for a, b in zip(at, at[1:])])
        bounds = [*np.searchsorted(starts, first).tolist(), len(found)]
        for i, a, b in zip(chunk, bounds, bounds[1:]):
            out[i] = b"".join(found[a:b])

    def ends(self, packed: bytes) -> np.ndarray:
        """Byte offset behind every token of an encoded text."""
        return np.cumsum(self.lengths[np.frombuffer(packed, "<u4")])

    def decode(self, packed: bytes | None, start: int = 0, stop: int | None = None) -> bytes:
        """The bytes of the tokens from `start` to `stop`, placed by their end offsets in the joined vocabulary's bytes."""
        packed = (packed or b"")[4 * start:None if stop is None else 4 * stop]
        ends = self.ends(packed)
        if not len(ends):
            return b""
        ids = np.frombuffer(packed, "<u4")
        shift = self.offsets[ids] - ends + self.lengths[ids]
        return self.bytes[np.arange(ends[-1], dtype=np.int32) + np.repeat(shift.astype(np.int32), self.lengths[ids])].tobytes()


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def with_ids(df: DataFrame, name: str = "ids", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """All columns and the packed ids (binary, four bytes each, little-endian) of the text; empty for NULL. A
    column of that name is replaced."""
    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(vocabulary(path).encode(texts.tolist()), dtype=object)

    return df.withColumn(name, encode(F.col(f"`{text_col}`")))


def with_text(df: DataFrame, name: str = "decoded", ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """All columns and the UTF-8 bytes that the packed ids stand for. A column of that name is replaced."""
    @F.pandas_udf("binary")
    def decode(ids: pd.Series) -> pd.Series:
        return pd.Series([vocabulary(path).decode(x) for x in ids], dtype=object)

    return df.withColumn(name, decode(F.col(f"`{ids_col}`")))


def id_list(packed: bytes) -> list[int]:
    return array("I", packed).tolist()


def document_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Per document: doc_id, n_tokens, and digests of its ids and of the bytes decoded from them."""
    rows = with_text(with_ids(docs.select("doc_id", "text"), path=path).drop("text"), path=path)
    return rows.select("doc_id", F.call_function("div", F.octet_length("ids"), F.lit(4)).cast("bigint").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
