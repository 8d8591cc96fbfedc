"""What a worker has learnt about distinct pieces of text, in flat arrays.

Texts repeat their words, so an encoder is asked once per distinct piece; the ids of a whole
slice are then gathered by array indices.  The store is a cache of one worker process: it
forgets everything once it holds ``most`` pieces, which bounds its memory and changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import chain, compress, repeat
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated segments values[start:start + count]."""
    stops = np.cumsum(counts, dtype=np.int64)
    total = int(stops[-1]) if len(stops) else 0
    at = np.repeat(starts - (stops - counts), counts)
    at += np.arange(total)
    return values[at]


class Ragged:
    """A growing column of integer lists."""

    def __init__(self, kind: np.dtype | type):
        self.values, self.used = np.zeros(1024, kind), 0
        self.starts, self.counts, self.rows = np.zeros(1024, np.int64), np.zeros(1024, np.int32), 0

    def clear(self) -> None:
        self.__init__(self.values.dtype)

    def append(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.values = _room(self.values, self.used, len(values))
        self.starts = _room(self.starts, self.rows, len(counts))
        self.counts = _room(self.counts, self.rows, len(counts))
        self.values[self.used:self.used + len(values)] = values
        end = self.rows + len(counts)
        self.counts[self.rows:end] = counts
        self.starts[self.rows:end] = self.used + np.cumsum(counts, dtype=np.int64) - counts
        self.used, self.rows = self.used + len(values), end

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of ``rows``, one after the other, and their lengths."""
        counts = self.counts[rows].astype(np.int64)
        return gather(self.values, self.starts[rows], counts), counts


def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(array):
        return array
    grown = np.zeros(max(used + more, 2 * len(array)), array.dtype)
    grown[:used] = array[:used]
    return grown


class Objects:
    """A growing column of Python objects."""

    def __init__(self) -> None:
        self.values: list[Any] = []

    def clear(self) -> None:
        self.values = []

    def append(self, values: list[Any], _: None) -> None:
        self.values.extend(values)

    def take(self, rows: np.ndarray) -> list[Any]:
        return list(map(self.values.__getitem__, rows.tolist()))


class PieceStore:
    """Rows of distinct pieces.

    ``learn`` gets the pieces that are not known and returns, in the order of ``kinds``, one
    (values, counts) pair per column; (list, None) for the kind ``object``.
    """

    def __init__(self, learn: Callable[[list[str]], Sequence[tuple[Any, Any]]],
                 kinds: Sequence[Any], most: int):
        self.learn, self.most = learn, most
        self.index: dict[str, int] = {}
        self.columns: list[Any] = [Objects() if k is object else Ragged(k) for k in kinds]

    def rows(self, pieces: list[str]) -> np.ndarray:
        """The row of each of the distinct ``pieces``; rows hold until the next call."""
        if len(self.index) > self.most:
            self.index = {}
            for column in self.columns:
                column.clear()
        found = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(found < 0)
        if len(new):
            names = [pieces[i] for i in new.tolist()]
            for column, (values, counts) in zip(self.columns, self.learn(names), strict=True):
                column.append(values, counts)
            first = len(self.index)
            self.index.update(zip(names, range(first, first + len(names))))
            found[new] = np.arange(first, first + len(names))
        return found


# -- cutting texts ------------------------------------------------------------------------

#: A space between two characters that no tokenizer rule takes for white space.  Byte-level rules
#: always begin a new token there, so the text on both sides can be encoded apart.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Two white spaces in a row.  Without them a line break is a token of its own, and a space belongs to
#: what follows; only the ends of a text can be left with a space alone.
_DOUBLE_RE2 = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
#: Between a Latin letter and punctuation every byte-level rule begins a new token, too.
LETTER_MARK_RE2 = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([!-/:-@\[-`{-~])"
_LATIN, _MARK = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF", r"!-/:-@\[-`{-~"
#: A Latin word and a run of punctuation: one token of the byte-level rules each.
SPACED_WORD = re.compile(rf"( ?[{_LATIN}]+)?( ?[{_MARK}]+)?")
#: The same for lower-casing tokenizers without spaces: letters that NFC and lower-casing leave alone.
LOWER_WORD = re.compile(rf"([a-z\u00DF-\u00F6\u00F8-\u00FF]+)?([{_MARK}]+)?")
#: The same two, one token alone.
_ALONE_RE2 = {SPACED_WORD: r"^( ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+| ?[!-/:-@\[-`{-~]+)$",
              LOWER_WORD: r"^([a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+|[!-/:-@\[-`{-~]+)$"}


def cut_at_spaces(text: str) -> list[str]:
    """Parts that encode independently and join to ``text``."""
    parts = _CUT.split(text)
    return [parts[0], *(" " + p for p in parts[1:])]


def rows_of(store: PieceStore, texts: pa.Array, *, lines: bool = True, marks: bool = False,
            whole: Sequence[str] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the pieces of all texts, one text after the other, and the number of pieces per text.

    Pieces end before spaces, around single line breaks (``lines``) and before punctuation after a
    letter (``marks``).  Texts with white spaces in a row, NUL or one of ``whole`` in them are cut
    at sure spaces alone.  Null texts are empty.
    """
    texts = texts.fill_null("")
    odd = pc.or_(pc.match_substring(texts, "\0"), pc.match_substring_regex(texts, _DOUBLE_RE2))
    for mark in whole:
        odd = pc.or_(odd, pc.match_substring(texts, mark))
    plain = pc.if_else(odd, "", texts)
    if marks:
        plain = pc.replace_substring_regex(plain, LETTER_MARK_RE2, "\\1\0\\2")
    if lines:
        plain = pc.replace_substring(plain, "\n", "\0\n\0")
    pieces = pc.split_pattern(pc.replace_substring(plain, " ", "\0 "), "\0")
    coded = pc.list_flatten(pieces).dictionary_encode()
    counts = pc.list_value_length(pieces).to_numpy().astype(np.int64)
    apart = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    extra = [cut_at_spaces(texts[i].as_py()) for i in apart.tolist()]
    names = {}
    for p in chain.from_iterable(extra):
        names.setdefault(p, len(names))
    known = store.rows([*coded.dictionary.to_numpy(zero_copy_only=False).tolist(), *names])
    first = len(coded.dictionary)
    rows = known[:first][coded.indices.to_numpy()]
    if not extra:
        return rows, counts
    starts = np.cumsum(counts) - counts
    more = np.fromiter(map(len, extra), np.int64, len(extra))
    starts[apart], counts[apart] = len(rows) + np.cumsum(more) - more, more
    at = np.fromiter(map(names.__getitem__, chain.from_iterable(extra)), np.int64, int(more.sum()))
    return gather(np.concatenate([rows, known[first:][at]]), starts, counts), counts


# -- byte pair models ---------------------------------------------------------------------

#: Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others count up from 256.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLED = {b: b for b in _SELF} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_SELF)))}
_LINE = {k: v for k, v in _SPELLED.items() if k != 10}
_BULK = 20_000              # pieces that the library encodes at a time


class BytePairs:
    """A tokenizer file of a byte-level vocabulary, asked for many pieces at once."""

    def __init__(self, path: str, specials_are_text: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [] if specials_are_text else [
            t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.encode_special_tokens = specials_are_text
        self.bare = Tokenizer(self.tokenizer.model)     # the same model; its input is cut at line breaks alone
        self.bare.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        end = self.tokenizer.model.end_of_word_suffix or ""
        back = {chr(v): bytes([k]) for k, v in _SPELLED.items()}
        size = 1 + max(self.tokenizer.get_vocab().values())
        self.raw = [b""] * size         # bytes that a token stands for
        for token, i in self.tokenizer.get_vocab().items():
            shown = token.removesuffix(end) if end else token
            self.raw[i] = b"".join(back.get(c, c.encode()) for c in shown)
        self.width = np.fromiter(map(len, self.raw), np.int64, size)

    def bulk(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty pieces without line breaks, each one token of the text rules, and their counts."""
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for low in range(0, len(pieces), _BULK):
            joined = "\n".join(pieces[low:low + _BULK])
            spelled = (joined.replace(" ", chr(_SPELLED[32])) if joined.isascii()
                       else joined.encode().decode("latin-1").translate(_LINE))
            found = np.array(self.bare.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, np.int32)
            sizes = np.cumsum(np.fromiter(map(len, spelled.split("\n")), np.int64))
            ends = np.cumsum(self.width[found])
            if len(ends) == 0 or ends[-1] != sizes[-1]:
                raise ValueError("the vocabulary does not hold every byte")
            stops = np.searchsorted(ends, sizes) + 1
            ids.append(found)
            counts.append(np.diff(np.append(0, stops)))
        return np.concatenate(ids), np.concatenate(counts)

    def one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, pieces: list[str], word: re.Pattern[str] = SPACED_WORD) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece and their counts; what ``word`` matches goes to the model in bulk.

        The groups of ``word`` are tokens of the text rules; all other pieces go through the whole
        tokenizer one by one.
        """
        alone = pc.match_substring_regex(pa.array(pieces, pa.string()), _ALONE_RE2[word]).to_numpy(zero_copy_only=False)
        parts, owner = list(compress(pieces, alone.tolist())), [np.flatnonzero(alone)]
        slow: list[int] = []
        for i in np.flatnonzero(~alone).tolist():
            match = word.fullmatch(pieces[i])
            if match is None:
                slow.append(i)
                continue
            for part in filter(None, match.groups()):
                parts.append(part)
                owner.append([i])
        values, sizes = self.bulk(parts)
        order = np.argsort(at := np.concatenate(owner).astype(np.int64), kind="stable")
        if len(owner) > 1:
            values = gather(values, (np.cumsum(sizes) - sizes)[order], sizes[order])
        counts = np.zeros(len(pieces), np.int64)
        np.add.at(counts, at, sizes)
        if not slow:
            return values, counts
        starts = np.cumsum(counts) - counts
        others = [self.one(pieces[i]) for i in slow]
        more = np.fromiter(map(len, others), np.int64, len(others))
        starts[slow], counts[slow] = len(values) + np.cumsum(more) - more, more
        values = np.concatenate([values, np.fromiter(chain.from_iterable(others), np.int32, int(more.sum()))])
        return gather(values, starts, counts), counts
