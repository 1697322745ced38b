"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document's whole windows leave at once; what remains goes
best-fit, into the open window with the least room that takes it. Where none does, the fullest is emitted; documents may
be cut freely, so it takes the head of the piece along instead of padding (a departure from plain best fit). Windows still open at a partition's end are leftovers: they carry their ids, meet
in groups of partitions, and are merged into full windows. A group's last, partly filled one is cut into powers of
two, which need no padding. Memory follows one batch of texts and OPEN windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tidied, written

WINDOW, OPEN = 1024, 16
#: Partitions whose leftovers meet in one group: at most MERGED * OPEN windows.
MERGED = 64


@cache
def tokenizer(path: str):
    """A function from text to uint32 ids, as the tokenizers library gives them for the file without special tokens.

    Its merges run on the file's own vocabulary in the faster tiktoken core; a text that contains one of the file's
    special tokens, or one that the core refuses (very long runs of blanks), goes through tokenizers itself.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec["added_tokens"]]
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    ranks = {bytes(byte[c] for c in t): k for t, k in spec["model"]["vocab"].items() if t not in special}
    import public_tokenizers

    fast = tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    whole = cache(lambda: Tokenizer.from_file(path))  # rarely needed, and large

    def ids(text: str) -> np.ndarray:
        if not any(s in text for s in special):
            try:
                return fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
            except ValueError:  # its regular expressions give up within runs of about a million blanks
                pass
        return np.array(whole().encode(text, add_special_tokens=False).ids, np.uint32)

    return ids


FIELDS = [
    pa.field("doc_id", pa.int64()), pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("ids_crc32", pa.int64()),
    pa.field("doc_tokens", pa.int64()), pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64()),
    pa.field("leftover", pa.int64()), pa.field("ids", pa.binary()),
]
DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, leftover bigint, ids binary"


class Packer:
    """Open windows of one stream; pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_id: int, open_windows: int, keep_ids: bool):
        self.next_id, self.open, self.keep = first_id, open_windows, keep_ids
        self.windows: list[tuple[int, list]] = []  # tokens so far, pieces
        self.rows: list[tuple] = []

    def emit(self, pieces: list, leftover: int | None = None) -> None:
        """Rows of a finished window, or of an open one that is left over in the group named."""
        offset = 0
        for doc_id, start, ids, total in pieces:
            raw = ids.astype("<u4", copy=False).tobytes()
            seq = self.next_id if leftover is None else None
            self.rows.append((doc_id, start, len(ids), zlib.crc32(raw), total, seq, offset, leftover, raw if self.keep or leftover is not None else None))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc_id: int | None, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= WINDOW:
            self.emit([(doc_id, start, ids[:WINDOW], total)])
            start, ids = start + WINDOW, ids[WINDOW:]
        if not len(ids):
            return
        fitting = [k for k, (used, _) in enumerate(self.windows) if used + len(ids) <= WINDOW]
        if fitting:
            k = max(fitting, key=lambda k: self.windows[k][0])
            used, pieces = self.windows[k]
            pieces.append((doc_id, start, ids, total))
            if used + len(ids) == WINDOW:
                self.emit(self.windows.pop(k)[1])
            else:
                self.windows[k] = (used + len(ids), pieces)
        elif len(self.windows) < self.open:
            self.windows.append((len(ids), [(doc_id, start, ids, total)]))
        else:
            k = max(range(len(self.windows)), key=lambda k: self.windows[k][0])
            used, pieces = self.windows.pop(k)
            room = WINDOW - used
            self.emit([*pieces, (doc_id, start, ids[:room], total)])
            self.windows.append((len(ids) - room, [(doc_id, start + room, ids[room:], total)]))

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(FIELDS), FIELDS, strict=True)], schema=pa.schema(FIELDS))


def merge_leftovers(pieces: Iterator[tuple], first_id: int, keep_ids: bool) -> Packer:
    """All pieces end to end, cut into full windows and at last powers of two."""
    out, used, held = Packer(first_id, 0, keep_ids), 0, []
    for doc_id, start, ids, total in pieces:
        while len(ids):
            take = min(WINDOW - used, len(ids))
            held.append((doc_id, start, ids[:take], total))
            start, ids, used = start + take, ids[take:], used + take
            if used == WINDOW:
                out.emit(held)
                used, held = 0, []
    while used:
        size, part, rest, room = 1 << (used.bit_length() - 1), [], [], 1 << (used.bit_length() - 1)
        for doc_id, start, ids, total in held:
            take = min(room, len(ids))
            if take:
                part.append((doc_id, start, ids[:take], total))
            if take < len(ids):
                rest.append((doc_id, start + take, ids[take:], total))
            room -= take
        out.emit(part)
        held, used = rest, used - size
    return out


def pack(docs: DataFrame, tokenizer_path: str, open_windows: int = OPEN, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids.

    A document is its ids and then id 0; a null or empty text is id 0 alone. Every id lies in exactly one piece, and
    the pieces of a sequence cover it from offset 0 without gaps; sequences hold 1024 ids or a lesser power of two.
    ``ids`` holds a piece's ids as little-endian 32-bit numbers, or null without ``keep_ids``. Repeated rows are packed
    once each, rows without an id with a null one. Texts of any length are encoded whole. Other columns, whatever their
    names, are not looked at; an empty table gives no rows.
    """
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        part, encode = TaskContext.get().partitionId(), tokenizer(tokenizer_path)
        packer = Packer(part << 32, open_windows, keep_ids)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                found = np.append(encode(texts[k].as_py() or ""), np.uint32(0))
                packer.add(ids[k].as_py(), 0, found, len(found))
                if len(packer.rows) >= 4096:
                    yield packer.batch()
            yield packer.batch()
        for _, pieces in packer.windows:
            packer.emit(pieces, part // MERGED)
        yield packer.batch()

    first = written(given.mapInArrow(lambda b: tidied(run(b)), DDL), "packed")

    def merge(key, rows):
        rows = rows.sort_by("at")
        pieces = ((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]) for r in rows.to_pylist())
        out = merge_leftovers(pieces, (1 << 62) + (key[0].as_py() << 24), keep_ids)
        return pa.Table.from_batches([out.batch()])

    # the table is written by now, so the order of its rows is the same whenever it is read
    left = first.filter("leftover is not null").selectExpr("doc_id", "start", "doc_tokens", "leftover", "ids", "monotonically_increasing_id() as at")
    merged = left.groupBy("leftover").applyInArrow(merge, DDL)
    return first.filter("leftover is null").unionByName(merged).drop("leftover")


def op10_pack_windows(spark, sf_dir: str) -> DataFrame:
    """The contract's pieces of all documents."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False).drop("ids")
