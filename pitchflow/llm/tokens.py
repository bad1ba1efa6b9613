"""Token ids as the tokenizers library gives them, fast.

The vocabularies' merges also run in tiktoken, several times as fast, with the same result: it merges the pair whose
whole has the lowest id, and ids are in the order of the merges here (which is checked), so that the two could only
differ for a token that isn't its own encoding (tests encode every token). It gets what needs no normalization and where
both libraries cut alike: texts of characters below U+0100 without a special string, and words of letters. All else goes
to the tokenizers library, a unit of text at a time.

A unit is a stretch of text that the tokenizer is known to treat by itself. Units repeat, so each Python worker keeps
the ids of the units that it has met in a bounded table and calls the library for the others only, many in one text.

Many units go to the library as one text only where its ids are sure to fall apart into the units' again: where nothing
is normalized, or where every character is printable ASCII or one of those beyond that the normalizer leaves alone but
for a change of case of the same length. Tokens then cover exactly the bytes of the text, and the units' ends are found
by adding up the tokens' lengths. Any other unit is a text of its own.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pitchflow.llm.common import held

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_WHITE = "\t\n\x0b\x0c\r "
#: Two white-space characters in a row are cut by other rules, but for an empty line between two words.
_RUNS = tuple((a + b).encode() for a in _WHITE for b in _WHITE if a + b != "\n\n") + (b"\n\n\n", b"\n\n<")
#: Beginnings of white space beyond ASCII in UTF-8.
_WIDE = tuple(c.encode() for c in "\x85\xa0  　") + (b"\xe2\x80",)
#: Between two characters that aren't white space, a space starts a new piece.
_AT_SPACE = re.compile(r"(?<=\S)(?= \S)")
_SPACED = re.compile(r" \S+")
#: A word and the marks behind it are pieces of their own. One unit a line.
_WORD_AND_MARKS = re.compile(rb"^((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?$&%#*]*)$", re.MULTILINE)
#: Bytes of text that are taken apart at a time, and units that the library gets as one text.
WINDOW, JOINED = 4 << 20, 4096


def _bytes_of_characters() -> dict[str, int]:
    """The characters that stand for the 256 bytes in byte-level vocabularies: printable ones for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class UnitTokenizer:
    """Ids below 65536 as little-endian 16-bit integers. limit: most units kept in a worker's table.

    Units are named by what stands between two spaces, and mean it with the space before it; a unit that begins with a
    line break means it without the space, and one behind a space (a name that can't come out of a split) stands as it
    is. When the table is half full, it becomes the old one, from which units come back as they are met."""

    def __init__(self, name: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.limit = Tokenizer.from_file(vocabulary(name)), limit
        self.by_word = name == WORD_BPE  # drops white space
        if self.by_word != (self.model.normalizer is not None):
            raise ValueError(f"units of {name} are not known")
        tokens = self.model.get_vocab(with_added_tokens=True)
        added = {t.content for t in self.model.get_added_tokens_decoder().values()}
        self.sizes = np.zeros(max(tokens.values()) + 1, dtype=np.int64)
        for token, i in tokens.items():  # a byte of text is a character of a token
            self.sizes[i] = len(token) if token in added or not token.endswith("</w>") else len(token) - 4
        self.special = tuple(x.encode() for x in added)
        self.quick, self.closes = self._quick_model(tokens)
        self.plain = re.compile(("[" + "".join(re.escape(c) for c in self._unchanged()) + "]+") if self.by_word else r"\S+")
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.line = b"" if self.by_word else self._alone([b"\n"])[0]

    def _quick_model(self, tokens: dict[str, int]):
        """The merges in tiktoken, and whether each id ends a word. A word's end is written as a zero byte."""
        import public_tokenizers
        import tiktoken

        with open(vocabulary(WORD_BPE if self.by_word else BYTE_BPE), encoding="utf-8") as file:
            merges = [m if isinstance(m, list) else m.split(" ") for m in json.load(file)["model"]["merges"]]
        first = 512 if self.by_word else 256  # below are bytes, and bytes at a word's end
        if any(tokens.get(a + b) != first + k for k, (a, b) in enumerate(merges)):
            raise ValueError("ids aren't in the order of merges")
        byte, end = _bytes_of_characters(), "</w>" if self.by_word else ""
        raw = lambda t: bytes(byte[c] for c in t[: len(t) - len(end)]) + b"\0" if end and t.endswith(end) else bytes(byte[c] for c in t)
        ranks = {raw(t): i for t, i in tokens.items() if i < first + len(merges)}
        closes = np.zeros(max(tokens.values()) + 1, dtype=bool)
        if end:
            closes[[i for t, i in tokens.items() if t.endswith(end)]] = True
        pattern = r"[^\x00]+\x00" if self.by_word else public_tokenizers.PATTERN
        return tiktoken.Encoding(f"quick {first}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), closes

    def _unchanged(self) -> Iterator[str]:
        """Characters below U+0100 whose normal form is as long, whatever stands beside them."""
        for c in map(chr, (*range(0x21, 0x7F), *range(0xA1, 0x100))):
            got = self.model.normalizer.normalize_str(c)
            if len(got.encode()) == len(c.encode()) and self.model.normalizer.normalize_str(f"a{c}a") == f"a{got}a":
                yield c

    def _alone(self, texts: list[bytes]) -> list[bytes]:
        found = self.model.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(x.ids, dtype="<u2").tobytes() for x in found]

    def _joined(self, units: list[bytes]) -> list[bytes]:
        """Ids of units without white space, each behind a space, as one text."""
        text = b" " + b" ".join(units)
        if (short := self._short(text)) and not self.by_word:
            ids = np.array(self.quick.encode_ordinary(short), dtype="<u2")
        else:
            ids = np.array(self.model.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, dtype="<u2")
        ends, reached = np.cumsum([len(u) + (not self.by_word) for u in units]), np.cumsum(self.sizes[ids])
        at = np.searchsorted(reached, ends)
        if not len(ids) or at[-1] != len(ids) - 1 or (reached[at] != ends).any():
            return self._alone([b" " + u for u in units])
        raw, stops = ids.tobytes(), ((at + 1) * 2).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops)]

    def _short(self, text: bytes) -> str | None:
        """A text of characters below U+0100 without special strings, else nothing."""
        if any(x in text for x in self.special):
            return None
        decoded = text.decode()
        try:
            decoded.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return decoded

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters in lower case."""
        ids = np.array(self.quick.encode_ordinary((b"\0".join(words) + b"\0").decode()), dtype="<u2")
        raw, stops = ids.tobytes(), ((np.nonzero(self.closes[ids])[0] + 1) * 2).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops)]

    def _learn(self, missing: set[bytes]) -> None:
        known, odd = self.known, []
        found = _WORD_AND_MARKS.findall(b"\n".join([u for u in missing if u[:1] != b"\n"]))
        units, words, marks = [w + m for w, m in found], [w.decode().lower().encode() if self.by_word else w for w, _ in found], [m for _, m in found]
        lettered = set(words)
        for unit in missing.difference(units):
            if unit[:1] not in b" \n" and self.plain.fullmatch(unit.decode()):
                units.append(unit)
                words.append(unit)
                marks.append(b"")
            else:
                odd.append(unit)
        ids_of = {b"": b""}
        every = [m for m in dict.fromkeys(marks) if m]
        ids_of.update(zip(every, self._alone(every)))
        of_word = {w: known.get(w) for w in words}
        new = [w for w, ids in of_word.items() if ids is None]
        for kind, own in ((self._words, [w for w in new if w in lettered]), (self._joined, [w for w in new if w not in lettered])) if self.by_word else ((self._joined, new),):
            for k in range(0, len(own), JOINED):
                part = own[k : k + JOINED]
                of_word.update(zip(part, kind(part)))
        known.update([(u, of_word[w] + ids_of[m]) for u, w, m in zip(units, words, marks)])
        for k in range(0, len(odd), JOINED):
            part = odd[k : k + JOINED]
            known.update(zip(part, self._alone([u[1:] if u[:1] == b" " else u if u[:1] == b"\n" or self.by_word else b" " + u for u in part])))

    def _provide(self, units: set[bytes]) -> None:
        missing = units.difference(self.known)
        if missing and len(self.known) + len(missing) > self.limit // 2:
            self.old, self.known, missing = self.known, {}, units
        old = self.old
        self.known.update([(u, old[u]) for u in missing if u in old])
        if missing := missing.difference(old):
            self._learn(missing)

    def _odd(self, text: bytes) -> bool:
        """Whether white space stands in a text in other ways than by single spaces and lines."""
        return not self.by_word and (any(x in text for x in _RUNS) or any(x in text for x in _WIDE) or text[-2:] == b"\n\n")

    def _odd_ids(self, text: bytes) -> np.ndarray:
        parts = []
        for window in _odd_windows(text.decode()):
            units = [(u[1:] if _SPACED.fullmatch(u) else " " + u).encode() for u in _AT_SPACE.split(window)]
            self._provide(set(units))
            parts.append(b"".join(map(self.known.__getitem__, units)))
        return np.frombuffer(b"".join(parts), dtype="<u2")

    def _ids(self, windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all windows, and where each begins and ends. Units are told apart by Arrow, so that the table is asked
        once for each of them. Where lines count, a window begins with the break or space before its first unit."""
        if self.by_word:
            lists = pc.ascii_split_whitespace(pa.array(windows, pa.binary()).cast(pa.string()))
        else:
            lists = pc.split_pattern(pa.array([w.replace(b"\n", b" \n") for w in windows], pa.binary()), b" ")
        coded = lists.flatten().dictionary_encode()
        units, index = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()
        self._provide(set(units))
        found = list(map(self.known.__getitem__, units))
        raw, size = np.frombuffer(b"".join(found), dtype="<u2"), np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 2
        first = lists.offsets.to_numpy().astype(np.int64)
        each = size[index]
        if not self.by_word:
            each[first[:-1]] = 0  # nothing stands before the first space
        ends = np.cumsum(each)
        shift = (np.cumsum(size) - size)[index] - (ends - each)
        ids = raw[np.repeat(shift, each) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[first]

    def encode(self, texts: Iterable[bytes], end: bytes = b"") -> Iterator[np.ndarray]:
        """Ids of each text, and end behind them."""
        group: list[bytes] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > WINDOW:
                yield from self._encode(group, end)
                group, size = [], 0
        yield from self._encode(group, end)

    def _encode(self, group: list[bytes], end: bytes) -> Iterator[np.ndarray]:
        before, last, line = b"" if self.by_word else b"\n", np.frombuffer(end, dtype="<u2"), len(self.line) // 2
        parts: list[list[np.ndarray]] = [[] for _ in group]
        waiting: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            ids, at = self._ids([w for _, w in waiting])
            for (i, _), a, b in zip(waiting, at[:-1].tolist(), at[1:].tolist()):
                parts[i].append(ids[a if parts[i] else a + line : b])
            waiting.clear()

        for i, text in enumerate(group):
            if not self.by_word and (short := self._short(text)) is not None:
                parts[i] += [np.array(self.quick.encode_ordinary(w), dtype="<u2") for w in _odd_windows(short)]
                continue
            if self._odd(text):
                parts[i].append(self._odd_ids(text))
                continue
            for k, window in enumerate(_windows(text)):
                waiting.append((i, window if k else before + window))
                size += len(window)
                if size > WINDOW:
                    flush()
                    size = 0
        if waiting:
            flush()
        for own in parts:
            yield np.concatenate([*own, last])


def _windows(text: bytes) -> Iterator[bytes]:
    """Cuts before single spaces."""
    at = 0
    while len(text) - at > WINDOW and (found := text.find(b" ", at + WINDOW)) > 0:
        yield text[at:found]
        at = found
    yield text[at:]


def _odd_windows(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > WINDOW and (found := _AT_SPACE.search(text, at + WINDOW)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def unit_tokenizer(name: str) -> UnitTokenizer:
    """One for each Python worker: what it has met serves its later tasks too."""
    return held(name, lambda: UnitTokenizer(name))
