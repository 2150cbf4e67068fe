"""Packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import Scratch, pick, small_batches, tidied
from sievemill.llm.tokenizing import cached_ids, release

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
#: A sequence id is the round of merging (4 bits), the task (32 bits) and the number in the task (27 bits).
ROUND, TASK = 59, 27


class Packer:
    """A fixed number of open windows; a window is a list of pieces (doc_id, start, ids, doc_tokens).

    A document's whole windows are cut off and emitted at once; its rest goes into the open window with the smallest
    room that holds it. When none does, and all windows are open, the fullest is topped up with the head of the rest,
    emitted full, and the tail opens a new window.
    """

    def __init__(self, size: int, windows: int, first: int, emit):
        self.size, self.windows, self.next, self.emit = size, windows, first, emit
        self.open: list[list] = []  # [room, pieces]

    def close(self, pieces: list) -> None:
        self.emit(self.next, pieces)
        self.next += 1

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.size:
            self.close([(doc, start, ids[: self.size], total)])
            start, ids = start + self.size, ids[self.size :]
        if not len(ids):
            return
        fits = [w for w in self.open if w[0] >= len(ids)]
        if fits:
            w = min(fits, key=lambda w: w[0])
        elif len(self.open) < self.windows:
            w = [self.size, []]
            self.open.append(w)
        else:
            w = min(self.open, key=lambda w: w[0])
            w[1].append((doc, start, ids[: w[0]], total))
            self.open.remove(w)
            self.close(w[1])
            self.open.append(w := [self.size, [(doc, start + w[0], ids[w[0] :], total)]])
            w[0] -= len(w[1][0][2])
            return
        w[1].append((doc, start, ids, total))
        w[0] -= len(ids)
        if not w[0]:
            self.open.remove(w)
            self.close(w[1])


def _rows(seq: int, pieces: list, keep_ids: bool, out: dict) -> None:
    at = 0
    for doc, start, ids, total in pieces:
        raw = ids.astype("<u4").tobytes()
        for k, v in zip(PIECE.names, (doc, start, len(ids), zlib.crc32(raw), total, seq, at, raw if keep_ids else None), strict=True):
            out[k].append(v)
        at += len(ids)


def _empty() -> dict:
    return {k: [] for k in PIECE.names}


def _pack_partition(path: str, end_id: int, size: int, windows: int, keep_ids: bool, words: int):
    def run(it):
        from pyspark import TaskContext

        tok = cached_ids(path, words)
        out, end = _empty(), np.array([end_id], dtype="<u4").tobytes()
        p = Packer(size, windows, TaskContext.get().partitionId() << TASK, lambda seq, pieces: _rows(seq, pieces, keep_ids, out))
        for b in it:
            docs, texts = b.column(0).to_pylist(), b.column(1)
            for i in range(0, len(docs), 256):
                part = [t or "" for t in texts.slice(i, 256).to_pylist()]
                for doc, raw in zip(docs[i : i + 256], tok.encode(part), strict=True):
                    ids = np.frombuffer(raw + end, dtype="<u4")
                    p.add(doc, 0, ids, len(ids))
                if len(out["doc_id"]) > 4096:
                    yield pa.RecordBatch.from_pydict(out, schema=PIECE)
                    for v in out.values():
                        v.clear()
        for _, pieces in p.open:
            rows = _empty()
            _rows(-1, pieces, True, rows)
            for k, v in rows.items():
                out[k] += v
        yield pa.RecordBatch.from_pydict(out, schema=PIECE)

    return run


def _merge(size: int, windows: int, level: int, last: bool, keep_ids: bool):
    """Packs leftover pieces of one task; at the last level what stays open is laid end to end and cut at powers of two."""

    def run(it):
        from pyspark import TaskContext

        out = _empty()
        p = Packer(size, 1 if last else windows, (level << ROUND) + (TaskContext.get().partitionId() << TASK), lambda seq, pieces: _rows(seq, pieces, keep_ids, out))
        for b in it:
            c = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            for doc, start, raw, total in zip(c["doc_id"], c["start"], c["ids"], c["doc_tokens"], strict=True):
                p.add(doc, start, np.frombuffer(raw, dtype="<u4"), total)
        for _, pieces in p.open:
            if not last:
                _rows(-1, pieces, True, out)
                continue
            left = list(pieces)
            while left:
                room = 1 << (sum(len(x[2]) for x in left).bit_length() - 1)
                mine = []
                while room:
                    doc, start, ids, total = left.pop(0)
                    mine.append((doc, start, ids[:room], total))
                    if len(ids) > room:
                        left.insert(0, (doc, start + room, ids[room:], total))
                    room -= len(mine[-1][2])
                p.close(mine)
        yield pa.RecordBatch.from_pydict(out, schema=PIECE)

    return run


def pack(docs: DataFrame, tokenizer: str, *, size: int = 1024, windows: int = 16, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", fan_in: int = 64, keep_ids: bool = True, words: int = 400_000) -> DataFrame:
    """Bounded-space online packing: one row for each piece of a document in a sequence.

    Each input partition holds at most `windows` open windows. Pieces of windows that are still open at the end of a
    partition (at most windows * size ids of each) are written apart and merged by fan-in `fan_in` until one task is
    left; what then stays open is cut into sequences whose lengths are powers of two, so that no padding is needed.
    `size` must be a power of two for that. Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    ids (little-endian unsigned 32 bits; null unless `keep_ids`). A task remembers the ids of `words` words at most.

    Null text: empty, so one piece with the end id alone. Null or repeated doc_id: each row is a document of its own.
    An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "pack")
    done = scratch.keep(pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(_pack_partition(tokenizer, end_id, size, windows, keep_ids, words), release), DDL), "first")
    full, left, level = done.where("sequence_id >= 0"), done.where("sequence_id < 0"), 0
    tasks = max(1, done.rdd.getNumPartitions())
    while True:
        level += 1
        tasks = -(-tasks // fan_in)
        # the order fixes what a task sees, so that a task that runs again makes the same sequences
        given = left.repartition(tasks, F.pmod(F.xxhash64("doc_id", "start"), F.lit(tasks))) if tasks > 1 else left.repartition(1)
        now = scratch.keep(given.sortWithinPartitions("doc_id", "start", "ids_crc32").mapInArrow(tidied(_merge(size, windows, level, tasks == 1, keep_ids)), DDL), f"level{level}")
        full = full.unionByName(now.where("sequence_id >= 0"))
        if tasks == 1:
            return full
        left = now.where("sequence_id < 0")
