"""Exact token counts of a byte-level BPE vocabulary by compiled finite-state transducers.

Two deterministic transducers run over a batch of texts, all lanes of it at once.

The first cuts text into pieces (contractions, words, numbers, other runs, white space) and has twelve states. Texts
are cut into chunks of CHUNK characters; each chunk's state map (exit state for every entry state) is found at once,
and the maps compose through a parallel prefix scan, so that every chunk of every text then runs from its true state.

The second reads the bytes of a piece. After each byte, the encoding of what has been read ends in exactly one token,
the one whose pair with the token before it survives BPE. So a state is the longest read suffix that still begins a
token, with the last token and relative count at each place in it, and a transition carries the change in the number
of emitted tokens. States are compiled when first met and kept in a hash table that NumPy reads for all lanes.

Cases: null and empty texts have no bytes and no tokens; the vocabulary's special string counts as one token wherever
it stands, as in the library; repeated rows are repeated; texts of any length are processed whole, in windows;
an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchflow.llm import common
from pitchflow.llm.tokens import BYTE_BPE, _bytes_of_characters, vocabulary

LIMIT = 512
CHUNK = 256
WINDOW = 1 << 21
#: States kept in a worker before the table starts anew.
STATES = 600_000

LETTER, NUMBER, SPACE, WHITE, QUOTE, OTHER = range(6)
_MARKED = {"s": 6, "t": 7, "m": 8, "d": 9, "l": 10, "r": 11, "v": 12, "e": 13}
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, ONE_SPACE, ENDS_SPACE, ONE_WHITE, ENDS_WHITE, AT_QUOTE, QUOTE_RV, QUOTE_L, CONTRACTED = range(12)


@cache
def character_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *[0] * 0x800, *range(0xE000, 0x110000)]))  # surrogates don't occur
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for run in regex.finditer(pattern, every):
            out[run.start() : run.end()] = kind
    out[[9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    out[32], out[ord("'")] = SPACE, QUOTE
    for c, k in _MARKED.items():
        out[ord(c)] = k
    _ask_library(out)
    return out


def _ask_library(out: np.ndarray) -> None:
    """Where two versions of Unicode at hand differ, the library's own counts."""
    from tokenizers.pre_tokenizers import ByteLevel

    pieces = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for i in np.nonzero(out <= OTHER)[0].tolist():
        kind = unicodedata.category(chr(i))[0]
        if out[i] in (LETTER, NUMBER) and kind not in "LN":
            out[i] = next((k for k, c in ((LETTER, "a"), (NUMBER, "1")) if len(pieces(c + chr(i))) == 1), OTHER)


def _step(state: int, c: int) -> tuple[int, int]:
    """Next state and output: 1 if a piece starts at this character, plus 2 if one starts at the character before."""
    letter = c == LETTER or c > OTHER
    fresh = IN_LETTERS if letter else {NUMBER: IN_NUMBERS, SPACE: ONE_SPACE, WHITE: ONE_WHITE, QUOTE: AT_QUOTE, OTHER: IN_OTHER}[c]
    if state in (ONE_SPACE, ENDS_SPACE, ONE_WHITE, ENDS_WHITE):
        if c in (SPACE, WHITE):
            return (ENDS_SPACE if c == SPACE else ENDS_WHITE), 0
        if state in (ONE_SPACE, ENDS_SPACE):  # the last space belongs to what follows
            return (IN_LETTERS if letter else IN_NUMBERS if c == NUMBER else IN_OTHER), 2 * (state == ENDS_SPACE)
        return fresh, 1 + 2 * (state == ENDS_WHITE)
    if state == AT_QUOTE:
        if c in (_MARKED["s"], _MARKED["t"], _MARKED["m"], _MARKED["d"]):
            return CONTRACTED, 0
        if c in (_MARKED["r"], _MARKED["v"]):
            return QUOTE_RV, 0
        if c == _MARKED["l"]:
            return QUOTE_L, 0
        return (IN_OTHER, 0) if c in (QUOTE, OTHER) else (fresh, 1)
    if state == QUOTE_RV and c == _MARKED["e"] or state == QUOTE_L and c == _MARKED["l"]:
        return CONTRACTED, 0
    if state in (QUOTE_RV, QUOTE_L):  # not a contraction: the letter behind the quote began a word
        return (IN_LETTERS, 2) if letter else (fresh, 3)
    if state == IN_LETTERS and letter or state == IN_NUMBERS and c == NUMBER or state == IN_OTHER and c in (QUOTE, OTHER):
        return state, 0
    return fresh, 1


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    both = np.array([[_step(s, c) for s in range(12)] for c in range(14)], dtype=np.uint8)
    return np.ascontiguousarray(both[:, :, 0]), np.ascontiguousarray(both[:, :, 1])


def piece_starts(classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each character. sizes: characters of each text; all texts one after another."""
    move, emit = _tables()
    n_chunks = -(-sizes // CHUNK)
    place = np.arange(n_chunks.sum()) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)  # in its text
    begin = np.repeat(np.cumsum(sizes) - sizes, n_chunks) + place * CHUNK
    length = np.minimum(CHUNK, np.repeat(sizes, n_chunks) - place * CHUNK)
    order = np.argsort(-length, kind="stable")
    begin, live = begin[order], np.searchsorted(-length[order], -np.arange(CHUNK), side="left")

    maps = np.tile(np.arange(12, dtype=np.uint8), (len(order), 1))
    for k in range(CHUNK if len(order) else 0):
        n = live[k]
        maps[:n] = move[classes[begin[:n] + k][:, None], maps[:n]]
    scan = np.empty_like(maps)
    scan[order] = maps
    shift = 1
    while shift < (n_chunks.max() if len(n_chunks) else 0):
        at = np.nonzero(place >= shift)[0]
        scan[at] = np.take_along_axis(scan[at], scan[at - shift].astype(np.int64), axis=1)
        shift *= 2
    entry = np.where(place > 0, np.concatenate([[0], scan[:-1, START]]), START)

    state, out = entry[order], np.zeros(len(classes), dtype=np.uint8)
    for k in range(CHUNK if len(order) else 0):
        n = live[k]
        at = begin[:n] + k
        c = classes[at]
        out[at] = emit[c, state[:n]]
        state[:n] = move[c, state[:n]]
    starts = out & 1
    starts[:-1] |= out[1:] >> 1
    ends = np.cumsum(sizes)[sizes > 0] - 1
    last = np.empty_like(state)
    last[order] = state
    final = last[np.cumsum(n_chunks)[sizes > 0] - 1]
    starts[ends[(final == QUOTE_RV) | (final == QUOTE_L)]] = 1
    return starts.astype(bool)


class CountingTransducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"].get("dropout") or spec["model"].get("ignore_merges"):
            raise ValueError("not a plain BPE vocabulary")
        byte = _bytes_of_characters()
        raw = lambda token: bytes(byte[c] for c in token)
        self.id_of = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in byte for c in t)}
        self.bytes_of = {i: t for t, i in self.id_of.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.prefixes = {t[:k] for t in self.id_of for k in range(len(t) + 1)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pairs: dict[int, bool] = {}
        self._empty()

    def _empty(self) -> None:
        # a state is kept as bytes: the length of the suffix, the suffix, and a token and a count for each place in it
        first = b"\0" + struct.pack("<ih", -1, 0)
        self.states, self.number = [first], {first: 0}
        self.pairs.clear()
        self.used, self.bits = 0, 17
        self._fill(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

    def bpe(self, raw: bytes) -> list[bytes]:
        parts = [raw[k : k + 1] for k in range(len(raw))]
        while len(parts) > 1:
            least = min((self.rank.get(p, 1 << 30), k) for k, p in enumerate(zip(parts, parts[1:])))
            if least[0] == 1 << 30:
                break
            k = least[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _pair(self, a: int, b: int) -> bool:
        """Whether token b can follow token a (-1: the start of a piece)."""
        if (got := self.pairs.get((a + 1) << 24 | b)) is None:
            right = self.bytes_of[b]
            left = self.bytes_of[a] if a >= 0 else b""
            got = self.pairs[(a + 1) << 24 | b] = self.bpe(left + right) == [x for x in (left, right) if x]
        return got

    def _compile(self, state: int, byte: int) -> int:
        """The transition's next state and count, (state << 10) + change + 512."""
        packed = self.states[state]
        suffix = packed[1 : 1 + packed[0]]
        ends = list(struct.iter_unpack("<ih", packed[1 + packed[0] :]))
        read = suffix + bytes([byte])
        for k in range(len(read)):
            token = self.id_of.get(read[k:])
            if token is not None and self._pair(ends[k][0], token):
                break
        else:
            raise ValueError("the vocabulary can't encode a byte")
        change = ends[k][1] + 1
        cut = next(j for j in range(len(read) + 1) if read[j:] in self.prefixes)
        new = bytes([len(read) - cut]) + read[cut:] + b"".join([struct.pack("<ih", t, n - change) for t, n in ends[cut:]]) + struct.pack("<ih", token, 0)
        if (to := self.number.get(new)) is None:
            to = self.number[new] = len(self.states)
            self.states.append(new)
        value = (to << 10) + change + 512
        self._put(state << 8 | byte, value)
        self.used += 1
        if self.used * 2 > len(self.keys):
            self.bits += 1
            full = self.keys >= 0
            self._fill(self.keys[full], self.values[full])
        return value

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int64)
        for key, value in zip(keys.tolist(), values.tolist()):
            self._put(key, value)

    def _slot(self, key: int) -> int:
        """Where the transition is, or where it belongs."""
        at, keys, last = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits), self.keys, len(self.keys) - 1
        while (found := keys.item(at)) >= 0 and found != key:
            at = (at + 1) & last
        return at

    def _put(self, key: int, value: int) -> None:
        at = self._slot(key)
        self.keys[at], self.values[at] = key, value

    def _look_up(self, key: np.ndarray) -> np.ndarray:
        """Transitions of all lanes; compiles those that are missing."""
        while True:
            at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
            found = self.keys[at]
            value = self.values[at]
            rest = np.nonzero(found != key)[0]
            missing: list[np.ndarray] = []
            while len(rest):
                empty = found[rest] < 0
                missing.append(key[rest[empty]])
                rest = rest[~empty]
                at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
                found[rest] = self.keys[at[rest]]
                value[rest] = self.values[at[rest]]
                rest = rest[found[rest] != key[rest]]
            new = np.unique(np.concatenate(missing)) if missing else ()
            if not len(new):
                return value
            for k in new.tolist():
                self._compile(k >> 8, k & 255)

    def counts(self, raw: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each piece raw[begin : begin + length]."""
        if len(self.states) > STATES:
            self._empty()
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        state, total = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        live = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
        k = 0
        for k, n in enumerate(live):
            if n < 48:  # a few long pieces
                break
            value = self._look_up(state[:n] << 8 | raw[begin[:n] + k])
            state[:n] = value >> 10
            total[:n] += (value & 1023) - 512
        else:
            k = len(live)
        for lane in range(live[k] if k < len(live) else 0):
            s, c = int(state[lane]), 0
            for byte in raw[begin[lane] + k : begin[lane] + length[lane]].astype(np.uint8).tobytes():
                at = self._slot(s << 8 | byte)
                value = self.values.item(at) if self.keys.item(at) >= 0 else self._compile(s, byte)
                s, c = value >> 10, c + (value & 1023) - 512
            total[lane] += c
        out = np.empty_like(total)
        out[order] = total
        return out

    def count_texts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. Pieces never reach beyond a text."""
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        if not len(points):
            return np.zeros(len(texts), dtype=np.int64)
        starts = np.nonzero(piece_starts(character_classes()[points], sizes))[0]
        raw = np.frombuffer(whole.encode(), dtype=np.uint8).astype(np.int64)
        width = np.where(points < 128, 1, np.where(points < 2048, 2, np.where(points < 65536, 3, 4)))
        first = np.concatenate([[0], np.cumsum(width)])  # byte of each character
        begin = first[starts]
        length = np.diff(np.append(begin, len(raw)))
        tokens = self.counts(raw, begin, length)
        owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
        return np.bincount(owner, weights=tokens, minlength=len(texts)).astype(np.int64)


#: Between two characters that aren't white space, a space always starts a piece.
_SAFE = re.compile(r"(?<=\S)(?= \S)")


def _windows(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > 2 * WINDOW and (found := _SAFE.search(text, at + WINDOW)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def count_tokens(texts: list[str], name: str = BYTE_BPE) -> np.ndarray:
    model = common.held(f"count {name}", lambda: CountingTransducer(vocabulary(name)))
    special = re.compile("|".join(map(re.escape, sorted(model.special, key=len, reverse=True))) or r"(?!)")
    total = np.zeros(len(texts), dtype=np.int64)
    parts: list[str] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        np.add.at(total, np.array(owner, dtype=np.int64), model.count_texts(parts))
        parts.clear(), owner.clear()
        held = 0

    for i, text in enumerate(texts):
        segments = special.split(text)
        total[i] += len(segments) - 1
        for segment in segments:
            for part in _windows(segment):
                parts.append(part), owner.append(i)
                held += len(part)
                if held > WINDOW:
                    flush()
    flush()
    return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        raw = [t.as_py() or "" for t in texts]
        n_bytes = [len(t.encode()) for t in raw]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(count_tokens(raw))], ["doc_id", "n_bytes", "n_tokens"])


def with_token_counts(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op4_transducer_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_token_counts(common.table(spark, sf_dir, "documents"))


QUERIES = {"op4_transducer_tokens": op4_transducer_tokens}
ORACLE: dict[str, str] = {}
