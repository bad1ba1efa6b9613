"""Packing along a space-filling curve.

Each document's token ids are hashed into a vector, the vector is projected to four dimensions, and the place of that
point on a Hilbert curve is the document's key. Documents are range-sorted by key (then id), and each range is packed
by itself, front to back: neighbours on the curve share sequences. A document is cut where a sequence is full, at a
multiple of STEP of its own ids, so that at most STEP - 1 places stay empty in a sequence.

Only sizes travel: the tokenizing pass keeps a checksum of every STEP ids of a document, from which the checksum of any
piece follows, so that no ids are shuffled or kept. A crc32 is linear over its bits but for a constant, so the checksums
of all blocks of many documents are table look-ups and exclusive ors.

Cases: null or empty text is the end id alone; repeated rows are packed each by itself; equal keys are ordered by
doc_id; a null doc_id sorts first; an empty table gives no rows; other columns, whatever their names, are not read. A text of any
length is packed whole, in as many pieces as it takes; a worker holds one such text and its ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchflow.llm.common import stored, table
from pitchflow.llm.tokens import BYTE_BPE, unit_tokenizer

LENGTH = 2048
STEP = 16
END_ID = 1
DIMENSIONS, BITS = 4, 10
BUCKETS = 256
#: Tokens of one range of the curve, and most ranges: beyond, ranges grow, which tasks read as streams.
RANGE_TOKENS, MOST_RANGES = 8_000_000, 10_000


@cache
def _directions() -> np.ndarray:
    return np.random.default_rng(6).standard_normal((BUCKETS, DIMENSIONS))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of integer points below 2^bits, by Gray codes from the highest bit down."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> level) & 1
    return key


def curve_keys(counts: np.ndarray) -> np.ndarray:
    """Keys of rows of hashed token counts."""
    size = np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1)
    z = counts / size @ _directions()
    u = (np.tanh(z / 2) + 1) / 2  # a direction's sum over a unit vector is about a standard normal
    return hilbert(np.minimum((u * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


@cache
def _linear() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What an id adds to the crc32 of a block, by the ids behind it; the crc32 of n zero ids; what becomes of each byte of
    a crc32 behind n more ids."""
    zero = np.array([zlib.crc32(bytes(4 * n)) for n in range(STEP + 1)], dtype=np.uint32)
    adds = np.zeros((STEP, 1 << 16), dtype=np.uint32)
    for behind in range(STEP):
        for bit in range(16):
            alone = zlib.crc32((1 << bit).to_bytes(4, "little") + bytes(4 * behind)) ^ int(zero[behind + 1])
            adds[behind, 1 << bit : 2 << bit] = adds[behind, : 1 << bit] ^ np.uint32(alone)
    moves = np.zeros((STEP + 1, 4, 256), dtype=np.uint32)
    for n in range(STEP + 1):
        for byte in range(4):
            for value in range(256):
                moves[n, byte, value] = zlib.crc32(bytes(4 * n), value << 8 * byte) ^ int(zero[n])
    return adds.reshape(-1), zero, moves


def block_sums(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """crc32 of every STEP ids of each document (its last block may be shorter), and how many blocks each has. ids: of all
    documents, one after another, none without any."""
    adds, zero, _ = _linear()
    blocks = -(-sizes // STEP)
    last = np.cumsum(blocks) - 1
    length = np.full(int(blocks.sum()), STEP)
    length[last] = sizes - (blocks - 1) * STEP
    start = np.cumsum(length) - length
    behind = np.repeat(start + length - 1, length) - np.arange(len(ids))
    return np.bitwise_xor.reduceat(adds[(behind << 16) + ids], start) ^ zero[length], blocks


def piece_sums(sums: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of pieces, from those of their blocks. first: each piece's first block; length: its ids."""
    moves = _linear()[2]
    blocks = -(-length // STEP)
    order = np.argsort(-blocks, kind="stable")
    first, blocks, out = first[order], blocks[order], sums[first[order]].copy()
    tail = length[order] - (blocks - 1) * STEP
    for k in range(1, int(blocks[0]) if len(blocks) else 0):
        n = int(np.searchsorted(-blocks, -k, side="left"))  # pieces with more than k blocks
        c, move = out[:n], np.where(blocks[:n] == k + 1, tail[:n], STEP)
        moved = moves[move, 0, c & 255]
        for byte in range(1, 4):
            moved ^= moves[move, byte, c >> np.uint32(8 * byte) & 255]
        out[:n] = moved ^ sums[first[:n] + k]
    back = np.empty_like(out)
    back[order] = out
    return back.astype(np.int64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokenizer, end = unit_tokenizer(BYTE_BPE), np.array([END_ID], dtype="<u2").tobytes()
    bucket = (np.arange(1 << 16) * 40503 >> 4) % BUCKETS
    for whole in batches:
        for k in range(0, whole.num_rows, 1000):
            batch = whole.slice(k, 1000)
            counts, sizes, sums = [], [], []
            group: list[np.ndarray] = []
            for ids in tokenizer.encode((t.as_py() or b"" for t in batch.column("text")), end):
                counts.append(np.bincount(bucket[ids], minlength=BUCKETS))
                sizes.append(len(ids))
                group.append(ids)
                if len(sizes) == batch.num_rows or sum(map(len, group)) > 1 << 20:
                    found, blocks = block_sums(np.concatenate(group), np.array(sizes[-len(group) :]))
                    sums += [x.tobytes() for x in np.split(found.astype("<u4"), np.cumsum(blocks)[:-1])]
                    group = []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(curve_keys(np.array(counts))), pa.array(sizes, pa.int64()), pa.array(sums, pa.binary())], ["doc_id", "key", "doc_tokens", "sums"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sequence, filled = TaskContext.get().partitionId() << 32, 0
    for whole in batches:
        for k in range(0, whole.num_rows, 1000):
            batch = whole.slice(k, 1000)
            sums = [np.frombuffer(x.as_py(), dtype="<u4") for x in batch.column("sums")]
            base = np.cumsum([0, *map(len, sums)]).tolist()
            row, start, length, seq, offset, first = [], [], [], [], [], []
            for i, n in enumerate(batch.column("doc_tokens").to_pylist()):
                at = 0
                while at < n:
                    free = LENGTH - filled
                    take = n - at if n - at <= free else free // STEP * STEP
                    if take:
                        row.append(i), start.append(at), length.append(take), seq.append(sequence), offset.append(filled)
                        first.append(base[i] + at // STEP)
                        at, filled = at + take, filled + take
                    if filled == LENGTH or at < n:
                        sequence, filled = sequence + 1, 0
            whole_rows = batch.take(pa.array(row, pa.int64()))
            crcs = piece_sums(np.concatenate(sums), np.array(first, dtype=np.int64), np.array(length, dtype=np.int64))
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([whole_rows.column("doc_id"), long(start), long(length), long(crcs), whole_rows.column("doc_tokens"), long(seq), long(offset), whole_rows.column("key")], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key"])


def pack(docs: DataFrame) -> DataFrame:
    """Pieces of all rows of docs: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve_key)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    sized = stored(rows.mapInArrow(_measure, "doc_id long, key long, doc_tokens long, sums binary"), "packing")
    total = sized.agg(F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()[0]
    ranges = sized.repartitionByRange(min(max(1, total // RANGE_TOKENS), MOST_RANGES), "key", "doc_id").sortWithinPartitions("key", "doc_id")
    return ranges.mapInArrow(_pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long")


def op6_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op6_hilbert_packing": op6_hilbert_packing}
ORACLE: dict[str, str] = {}
