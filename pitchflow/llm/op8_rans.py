"""Token ids in files of interleaved static range asymmetric numeral systems (rANS).

Texts become ids first, which are stored, and range-sorted by the documents' ids. A task encodes its range segment by segment. A segment holds whole documents, about
SEGMENT ids, and one static frequency table that all of its blocks share. A block holds up to BLOCK ids, dealt over
LANES interleaved coder states, and can be decoded without any other: the directory of a segment is its checkpoints,
with the first id's place, the number of ids, the word offset of each block, and the crc32 of its ids.

A segment (a row of the written Parquet files, payload column) is, little-endian:
    magic "RNS1", u32 documents, u32 blocks, u32 symbols, u32 ids
    u16 symbol and u32 frequency (sum 2^SCALE), for each symbol
    i64 doc_id, u32 ids, for each document
    u32 first id, u32 ids, u32 first word, u32 words, u32 crc32, for each block
    u32 words of all blocks; each block's are the LANES final states (two words each), then the emitted words

Cases: null or empty text is the end id alone; repeated rows are written one after another; a null doc_id sorts first
and is flagged in the row; an empty table gives an empty file set and no rows; other columns, whatever their names, are
not read. A text of any length is written whole, in a segment of its own if need be, of which a worker holds one at a
time. A wrong checksum raises an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchflow.llm.common import stored, table
from pitchflow.llm.tokens import WORD_BPE, unit_tokenizer

END_ID = 2
SCALE = 20
LANES = 64
BLOCK = 1 << 14
SEGMENT = 1 << 20
#: Ids in one range of documents, and most ranges: beyond, ranges grow, which tasks read as streams.
RANGE_IDS, MOST_RANGES = 8 << 20, 10_000
_LOW = np.uint64(1 << 31)
_HEAD = b"RNS1"


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur and their frequencies, at least 1 each, with the sum 2^SCALE."""
    symbols, counts = np.unique(ids, return_counts=True)
    spare = (1 << SCALE) - len(symbols)
    exact = counts * spare / counts.sum()
    share = np.floor(exact).astype(np.int64)
    most = np.argsort(-(exact - share), kind="stable")[: spare - share.sum()]
    share[most] += 1
    return symbols.astype(np.uint16), (share + 1).astype(np.uint32)


def _grid(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First id and number of ids of each block."""
    first = np.arange(0, n, BLOCK)
    return first, np.minimum(BLOCK, n - first)


def encode_blocks(index: np.ndarray, freq: np.ndarray) -> list[np.ndarray]:
    """Words of each block. index: each id's place in the table. All lanes of all blocks advance together.

    Id k of a block belongs to lane k mod LANES; ids are coded last to first, so that decoding runs forwards."""
    f64, cum = freq.astype(np.uint64), np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    first, size = _grid(len(index))
    lane = np.arange(LANES)
    state = np.full((len(first), LANES), _LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    for row in range(-(-int(size.max()) // LANES) - 1, -1, -1):
        k = row * LANES + lane
        live = k[None, :] < size[:, None]
        s = index[np.minimum(first[:, None] + k[None, :], len(index) - 1)]
        f, c = f64[s], cum[s]
        full = live & (state >= f << np.uint64(63 - SCALE))
        block, at = np.nonzero(full)
        words.append((state[block, at] & np.uint64(0xFFFFFFFF)).astype(np.uint32)[::-1])
        owners.append(block[::-1])
        x = np.where(full, state >> np.uint64(32), state)
        state = np.where(live, (x // f << np.uint64(SCALE)) + x % f + c, state)
    emitted, owner = np.concatenate(words)[::-1], np.concatenate(owners)[::-1]  # in the order of decoding
    order = np.argsort(owner, kind="stable")
    parts = np.split(emitted[order], np.searchsorted(owner[order], np.arange(1, len(first))))
    heads = state.view(np.uint32).reshape(len(first), -1)
    return [np.concatenate([h, p]) for h, p in zip(heads, parts)]


def decode_blocks(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Ids of the blocks, one after another."""
    f64, cum = freq.astype(np.uint64), np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    slot_of = np.repeat(np.arange(len(freq)), freq)
    heads = words[starts[:, None] + np.arange(2 * LANES)].astype(np.uint32)
    state = np.ascontiguousarray(heads).view(np.uint64)
    at = starts + 2 * LANES
    out = np.zeros((len(starts), -(-int(sizes.max()) // LANES), LANES), dtype=np.uint16)
    mask, lane = np.uint64((1 << SCALE) - 1), np.arange(LANES)
    for row in range(out.shape[1]):
        live = (row * LANES + lane)[None, :] < sizes[:, None]
        slot = state & mask
        s = slot_of[slot]
        out[:, row] = symbols[s]
        x = f64[s] * (state >> np.uint64(SCALE)) + slot - cum[s]
        need = live & (x < _LOW)
        place = at[:, None] + np.cumsum(need, axis=1) - 1
        more = words[np.where(need, place, 0)].astype(np.uint64)
        state = np.where(live, np.where(need, x << np.uint64(32) | more, x), state)
        at = at + need.sum(axis=1)
    return np.concatenate([o.reshape(-1)[:n] for o, n in zip(out, sizes.tolist())])


def pack_segment(doc_ids: list[int], docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate(docs)
    symbols, freq = frequencies(ids)
    index = np.zeros(1 << 16, dtype=np.int64)
    index[symbols] = np.arange(len(symbols))
    blocks = encode_blocks(index[ids], freq)
    first, size = _grid(len(ids))
    lengths = np.array([len(b) for b in blocks])
    sums = [zlib.crc32(ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(first.tolist(), size.tolist())]
    directory = np.stack([first, size, np.cumsum(lengths) - lengths, lengths, np.array(sums)], axis=1).astype("<u4")
    head = np.array([len(docs), len(blocks), len(symbols), len(ids)], dtype="<u4")
    parts = [head, symbols.astype("<u2"), freq.astype("<u4"), np.array(doc_ids, dtype="<i8"), np.array([len(d) for d in docs], dtype="<u4"), directory, np.concatenate(blocks).astype("<u4")]
    return _HEAD + b"".join(p.tobytes() for p in parts)


def unpack_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, sizes and the ids of all documents."""
    if raw[:4] != _HEAD:
        raise ValueError("not a segment")
    at = 4

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(raw, dtype=kind, count=n, offset=at)
        at += got.nbytes
        return got

    n_docs, n_blocks, n_symbols, _ = take("<u4", 4).tolist()
    symbols, freq, doc_ids, sizes = take("<u2", n_symbols), take("<u4", n_symbols), take("<i8", n_docs), take("<u4", n_docs)
    directory = take("<u4", 5 * n_blocks).reshape(-1, 5).astype(np.int64)
    words = take("<u4", (len(raw) - at) // 4)
    ids = decode_blocks(words, directory[:, 2], directory[:, 1], symbols, freq)
    for first, n, _, _, crc in directory.tolist():
        if zlib.crc32(ids[first : first + n].astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum is wrong")
    return doc_ids, sizes, ids


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokenizer, end = unit_tokenizer(WORD_BPE), np.array([END_ID], dtype="<u2").tobytes()
    for whole in batches:
        for k in range(0, whole.num_rows, 1000):
            batch = whole.slice(k, 1000)
            ids = [x.tobytes() for x in tokenizer.encode((t.as_py() or b"" for t in batch.column("text")), end)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])


_FILE = "part int, segment int, local_start long, n_tokens long, no_id boolean, payload binary"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    ids: list[int] = []
    docs: list[np.ndarray] = []
    held = start = segment = 0

    def row(no_id: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([start], pa.int64()), pa.array([held], pa.int64()), pa.array([no_id]), pa.array([pack_segment(ids, docs)], pa.binary())], ["part", "segment", "local_start", "n_tokens", "no_id", "payload"])

    unknown = False
    for batch in batches:
        known = batch.column("doc_id").to_pylist()
        for doc_id, got in zip(known, batch.column("ids")):
            if docs and (held >= SEGMENT or unknown != (doc_id is None)):
                yield row(unknown)
                start, segment, ids, docs, held = start + held, segment + 1, [], [], 0
            unknown = doc_id is None
            ids.append(doc_id or 0)
            docs.append(np.frombuffer(got.as_py(), dtype="<u2"))
            held += len(docs[-1])
    if docs:
        yield row(unknown)


def write_ids(docs: DataFrame) -> DataFrame:
    """Writes the files and returns the table of segments read from them."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    ids = stored(rows.mapInArrow(_tokenize, "doc_id long, ids binary"), "document-ids")
    total = ids.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0] // 2
    ranges = ids.repartitionByRange(min(max(1, total // RANGE_IDS), MOST_RANGES), "doc_id").sortWithinPartitions("doc_id")
    return stored(ranges.mapInArrow(_write, _FILE), "token-ids")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, no_id, raw in zip(batch.column("start").to_pylist(), batch.column("no_id").to_pylist(), batch.column("payload")):
            doc_ids, sizes, ids = unpack_segment(raw.as_py())
            ends = np.cumsum(sizes.astype(np.int64))
            starts = ends - sizes
            sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
            names = pa.nulls(len(doc_ids), pa.int64()) if no_id else pa.array(doc_ids)
            yield pa.RecordBatch.from_arrays([names, pa.array(starts + base), pa.array(sizes.astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from its segment."""
    # one number for each range of documents, MOST_RANGES at most, added up in a single small task and sent to all
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = totals.selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as base")
    placed = segments.join(F.broadcast(bases), "part").select((F.col("base") + F.col("local_start")).alias("start"), "no_id", "payload")
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(write_ids(table(spark, sf_dir, "documents")))


QUERIES = {"op8_rans_ids": op8_rans_ids}
ORACLE: dict[str, str] = {}
