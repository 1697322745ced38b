"""Byte-level BPE without regular expressions.

Pre-tokenisation works on arrays. Each code point becomes a symbol (kind of letter, number, blank, other sign) by
one table look-up, each symbol a transition function on the states of a small automaton that follows contractions
('s, 're, 'll ...). Functions compose associatively, so all prefixes come from a scan with doubling steps; it ends as
soon as every prefix is a constant, which takes as many steps as the longest contraction needs. States and symbols
then give the token starts. The slices between them go to pair merging, whose results are cached by slice. Every id keeps
the byte at which it begins; decoding puts tokens at these offsets, so that any run of ids can be decoded on its own.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import table, tidied

#: Symbols. STMD are the letters of one-letter contractions; R, V, L, E are those of two.
SPACE, BLANK, NUMBER, OTHER, QUOTE, LETTER, STMD, R, V, L, E = range(11)
#: States: what the token at hand is after a code point; Q.. follow a quote that opens a token.
START, SPACED, BLANKS, WORD, DIGITS, SIGNS, Q, QR, QV, QL, DONE = range(11)
N_STATES, N_SYMBOLS = 11, 11
#: Blanks of the pattern's \s; fixed values.
BLANK_POINTS = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _next(state: int, symbol: int) -> int:
    if symbol == QUOTE:
        return SIGNS if state in (SPACED, SIGNS, Q) else Q
    if symbol < LETTER:
        return {SPACE: SPACED, BLANK: BLANKS, NUMBER: DIGITS, OTHER: SIGNS}[symbol]
    if state == Q:
        return {STMD: DONE, R: QR, V: QV, L: QL}.get(symbol, WORD)
    if (state in (QR, QV) and symbol == E) or (state == QL and symbol == L):
        return DONE
    return WORD


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each symbol, of each symbol at a text's start, the table of compositions, and the value of each
    constant function (255 for the others)."""
    basic = [tuple(_next(s, c) for s in range(N_STATES)) for c in range(N_SYMBOLS)]
    at_start = [(_next(START, c),) * N_STATES for c in range(N_SYMBOLS)]
    known = dict.fromkeys([*basic, *at_start])
    while True:
        more = dict.fromkeys(tuple(g[x] for x in f) for f in known for g in known)
        if more.keys() <= known.keys():
            break
        known |= more
    index = {f: k for k, f in enumerate(known)}
    table_ = np.array([[index[tuple(g[x] for x in f)] for g in known] for f in known], np.uint16)
    value = np.array([f[0] if len(set(f)) == 1 else 255 for f in known], np.uint8)
    return np.array([index[f] for f in basic], np.uint16), np.array([index[f] for f in at_start], np.uint16), table_, value


@cache
def _symbols() -> np.ndarray:
    """Symbol of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for k in range(0x110000):
        out[k] = kinds.get(unicodedata.category(chr(k))[0], OTHER)
    out[list(BLANK_POINTS)] = BLANK
    out[0x20], out[ord("'")] = SPACE, QUOTE
    for letters, symbol in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        out[[ord(c) for c in letters]] = symbol
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8, and the byte each begins at."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    if len(at) == len(data):
        return lead.astype(np.int32), at
    out = lead.astype(np.int32)
    for low, high, more, mask in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0x100, 3, 0x07)):
        k = np.flatnonzero((lead >= low) & (lead < high))
        value = out[k] & mask
        for j in range(1, more + 1):
            value = (value << 6) | (data[at[k] + j] & 0x3F)
        out[k] = value
    return out, at


def token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes at which the pattern's matches begin, over a run of texts."""
    if not len(data):
        return np.zeros(0, np.int64)
    points, at = code_points(data)
    symbol = _symbols()[points]
    basic, at_start, compose, value = _monoid()
    opens = np.zeros(len(at) + 1, bool)
    opens[np.searchsorted(at, offsets[:-1])] = True
    opens = opens[:-1]
    f = basic[symbol]
    f[opens] = at_start[symbol[opens]]
    todo, step = np.flatnonzero(value[f] == 255), 1
    while len(todo):
        f[todo] = compose[f[todo - step], f[todo]]
        todo = todo[value[f[todo]] == 255]
        step *= 2
    group = np.array([0, 0, 1, 2, 2, 3, 3, 3, 3, 3, 3], np.uint8)[symbol]
    starts = opens.copy()
    starts[1:] |= group[1:] != group[:-1]
    # a run of blanks leaves its last one to what follows: to a token with it, if that is a space
    behind = np.flatnonzero((group[1:] != 0) & (group[:-1] == 0) & ~opens[1:]) + 1
    starts[behind - 1] = True
    starts[behind] = symbol[behind - 1] != SPACE
    done = np.flatnonzero(value[f] == DONE)
    if len(done):
        starts[np.where(symbol[done] == STMD, done, done - 1)] = False
        after = done[done + 1 < len(at)] + 1
        starts[after[~opens[after] & (group[after] == 3)]] = True
    return at[starts]


class Encoder:
    """Ids of slices by a rank file, with the results of up to ``held`` slices kept."""

    def __init__(self, path: str, held: int = 400_000):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.text = [str(k) for k in range(len(self.tokens))]
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.held, self.cache = held, {}

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Merges the pair of lowest rank, the first of equals, until no pair has a rank."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        parts = [piece[k : k + 1] for k in range(len(piece))]
        if len(parts) > 256:
            return self._merged_long(parts)
        none = 1 << 60
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            k = pairs.index(low)
            parts[k] += parts.pop(k + 1)
            pairs.pop(k)
            if k < len(pairs):
                pairs[k] = ranks.get(parts[k] + parts[k + 1], none)
            if k:
                pairs[k - 1] = ranks.get(parts[k - 1] + parts[k], none)
        return tuple(ranks[p] for p in parts)

    def _merged_long(self, parts: list[bytes]) -> tuple[int, ...]:
        """The same with a heap over linked parts, for slices of many bytes."""
        from heapq import heapify, heappop, heappush

        ranks, n = self.ranks, len(parts)
        right, left = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, k, parts[k] + parts[k + 1]) for k in range(n - 1) if (r := ranks.get(parts[k] + parts[k + 1])) is not None]
        heapify(heap)
        while heap:
            _, k, both = heappop(heap)
            j = right[k] if parts[k] else n
            if j >= n or parts[k] + parts[j] != both:
                continue
            parts[k], parts[j], right[k] = both, b"", right[j]
            if right[k] < n:
                left[right[k]] = k
                if (r := ranks.get(both + parts[right[k]])) is not None:
                    heappush(heap, (r, k, both + parts[right[k]]))
            if left[k] >= 0 and (r := ranks.get(parts[left[k]] + both)) is not None:
                heappush(heap, (r, left[k], parts[left[k]] + both))
        return tuple(ranks[p] for p in parts if p)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[list[int]]:
        """Ids of each of a run of texts."""
        starts = token_starts(data, offsets)
        raw, ends = data.tobytes(), [*starts[1:].tolist(), len(data)]
        bounds = np.searchsorted(starts, offsets).tolist()
        starts = starts.tolist()
        if len(self.cache) > self.held:
            self.cache.clear()
        cache_ = self.cache
        for a, b in zip(bounds, bounds[1:], strict=False):
            found = []
            for s, e in zip(starts[a:b], ends[a:b], strict=True):
                piece = raw[s:e]
                ids = cache_.get(piece)
                if ids is None:
                    ids = self.merged(piece)
                    if e - s <= 64:
                        cache_[piece] = ids
                found.append(ids)
            yield list(chain.from_iterable(found))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte of the text at which each id begins, and at last the text's length."""
        out = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.size[ids], out=out[1:])
        return out

    def decode(self, ids, offsets=None) -> bytes:
        """The bytes of a run of ids, each put where its offset says; offsets that do not fit the ids are an error."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        offsets = self.offsets(ids) if offsets is None else np.asarray(offsets, np.int64) - offsets[0]
        size = self.size[ids]
        if len(offsets) != len(ids) + 1 or (np.diff(offsets) != size).any():
            raise ValueError("offsets do not fit the ids")
        at = np.arange(offsets[-1]) + np.repeat(self.first[ids] - offsets[:-1], size)
        return self.flat[at].tobytes()


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def encode_documents(docs: DataFrame, ranks_path: str, text_col: str = "text") -> DataFrame:
    """docs with ``ids``, an array of int, and ``offsets``: the byte at which each begins, and the text's length at last.

    The text, or any run of it, can be had back with decode_documents(). A null text counts as empty; an empty text has no
    ids and the offset 0. Texts are encoded whole, however long. Repeated rows are encoded alike, columns ``ids`` and
    ``offsets`` of the input are replaced, all others stay; an empty table gives an empty result.
    """
    own = docs.drop("ids", "offsets")
    given = own.withColumn("__pl_text", F.col(text_col))

    def run(batches):
        enc = encoder(ranks_path)
        for batch in batches:
            at = batch.schema.names.index("__pl_text")
            found = [ids for _, _, data, offs in tb.text_runs(batch.column(at)) for ids in enc.encode(data, offs)]
            places = [enc.offsets(np.array(ids, np.int64)) for ids in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(found, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int64()))], [*batch.schema.names[:at], "ids", "offsets"])

    return given.mapInArrow(lambda b: tidied(run(b)), _ddl(own, "ids array<int>", "offsets array<bigint>"))


def decode_documents(docs: DataFrame, ranks_path: str, ids_col: str = "ids", offsets_col: str = "offsets") -> DataFrame:
    """docs with ``decoded``, the bytes that the ids stand for, put where the retained offsets say.

    Both may be cut down to the same run, ids i to j - 1 with offsets i to j, for that run's bytes. Null and empty arrays of ids
    give no bytes; without offsets (a null, or no such column) ids follow each other. A column ``decoded`` is replaced.
    """
    own = docs.drop("decoded")

    def run(batches):
        enc = encoder(ranks_path)
        for batch in batches:
            ids = batch.column(batch.schema.names.index(ids_col))
            places = batch.column(batch.schema.names.index(offsets_col)) if offsets_col in batch.schema.names else pa.nulls(len(ids))
            found = [enc.decode(x.values.to_numpy(), p.values.to_numpy() if p.is_valid else None) if x.is_valid else b"" for x, p in zip(ids, places, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "decoded"])

    return own.mapInArrow(run, _ddl(own, "decoded binary"))


def _ddl(df: DataFrame, *more: str) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], *more])


def digest_documents(docs: DataFrame, ranks_path: str, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``carry`` with n_tokens and the SHA-256 of the ids and of the decoded bytes, as op3 returns them.

    Encodes and decodes as the two functions above, in one pass, so that ids need not go through the JVM.
    """
    given = docs.select(*carry, F.col(text_col).alias("__pl_text"))

    def run(batches):
        enc = encoder(ranks_path)
        for batch in batches:
            at = batch.schema.names.index("__pl_text")
            n, digest, decoded = [], [], []
            for _, _, data, offs in tb.text_runs(batch.column(at)):
                for ids in enc.encode(data, offs):
                    n.append(len(ids))
                    digest.append(hashlib.sha256(",".join([enc.text[k] for k in ids]).encode()).hexdigest())
                    own = np.array(ids, np.int64)
                    decoded.append(hashlib.sha256(enc.decode(own, enc.offsets(own))).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())], [*batch.schema.names[:at], "n_tokens", "ids_sha256", "decoded_sha256"])

    return given.mapInArrow(lambda b: tidied(run(b)), _ddl(docs.select(*carry), "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"))


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of every document."""
    import public_tokenizers

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ["doc_id"])
