"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A slice of texts becomes one flat array of code points, cut into words where no piece of
the vocabulary can reach across.  Each distinct word is encoded once: per round every
word finds its best pair by a segmented minimum of pair ranks, all leftmost occurrences
of that pair that do not overlap are merged at once, and the symbol arrays are compacted,
until no word has a pair left.  Where merging all occurrences at once could differ from
the library's one-by-one order, only the leftmost one is merged in that round; words of
more than LONG symbols are merged in the same order through a heap.

Defined results: null and empty texts have no ids and decode to the empty text; rows are
encoded one by one, so repeated rows get equal ids and no row is lost; characters outside
the vocabulary become byte pieces.  Other columns of the input never matter.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import mix, powers, slices, table
from .registry import query

SPACE = 0x2581              # fixed value: the visible space of the library
LONG = 1_000                # symbols of a word beyond which a heap merges it
NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Pieces of a BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        texts = [lib.id_to_piece(i) for i in range(n)]
        byte_ids = {int(t[3:5], 16): i for i, t in enumerate(texts) if lib.is_byte(i)}
        probe = "  a  ﬁ \n"
        if len(byte_ids) != 256 or lib.decode(lib.encode(probe)) != probe:
            raise ValueError("a BPE model with byte fallback and plain white space is needed")
        self.byte_ids = [byte_ids[b] for b in range(256)]
        normal = {t: i for i, t in enumerate(texts)
                  if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))}
        self.size = n
        # Symbols: the id of a piece, or n + code point for a character that is no piece.
        chars = np.arange(n, n + 0x110000, dtype=np.int64)
        for t, i in normal.items():
            if len(t) == 1:
                chars[ord(t)] = i
        self.chars = chars
        symbol = lambda t: normal.get(t, n + ord(t) if len(t) == 1 else -1)
        score = {i: lib.get_score(i) for i in normal.values()}
        levels = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {i: levels[s] for i, s in score.items()}
        shared = {k for k, c in zip(*np.unique(list(rank.values()), return_counts=True)) if c > 1}
        self.width = n + 0x110000
        pairs: dict[int, int] = {}
        alone = np.zeros(n, bool)       # pieces to be merged one occurrence a round
        for t, i in normal.items():
            alone[i] |= rank[i] in shared and len(t) > 1
            for cut in range(1, len(t)):
                a, b = symbol(t[:cut]), symbol(t[cut:])
                if a >= 0 and b >= 0:
                    pairs[a * self.width + b] = i
                    for part in (a, b):
                        if part < n and rank[i] <= rank[part]:
                            alone[part] = True
        self.pairs = pairs
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.merged = keys, np.array([pairs[k] for k in keys.tolist()], np.int32)
        self.rank = np.full(n, NONE, np.int32)
        self.rank[list(rank)] = list(rank.values())
        self.alone = alone
        # Where words may be cut: before a space after another character, if no piece has one
        # there, and around characters that only single pieces have.
        inner = {c for t in normal if len(t) > 1 for c in t}
        self.whole = np.ones(0x110000, bool)
        self.whole[[ord(c) for c in inner]] = False
        self.cut_at_space = not any(chr(SPACE) in t.lstrip(chr(SPACE)) for t in normal)
        self.raw = [bytes([int(t[3:5], 16)]) if lib.is_byte(i)
                    else b"" if lib.is_control(i) else t.replace(chr(SPACE), " ").encode()
                    for i, t in enumerate(texts)]
        self.decimal = [str(i).encode() for i in range(n)]

    # -- encoding ---------------------------------------------------------------------

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        marked = [chr(SPACE) + t.replace(" ", chr(SPACE)) if t else "" for t in texts]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(points):
            return [np.zeros(0, np.int32) for _ in texts]
        doc_stops = np.cumsum(sizes)
        starts = self._word_starts(points, doc_stops - sizes, sizes)
        lengths = np.diff(np.append(starts, len(points)))
        first, inverse = self._distinct(points, starts, lengths)
        ids, counts = self._encode_words(points, starts[first], lengths[first])
        out, per_word = _gather(ids, np.cumsum(counts) - counts, counts, inverse)
        word_stops = np.searchsorted(starts, doc_stops)      # words up to the end of each text
        stops = np.concatenate(([0], np.cumsum(per_word)))[word_stops]
        return [out[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]

    def _word_starts(self, points: np.ndarray, doc_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(points), bool)
        if self.cut_at_space:
            space = points == SPACE
            cut[1:] = space[1:] & ~space[:-1]
        whole = self.whole[points]
        cut |= whole
        cut[1:] |= whole[:-1]
        cut[doc_starts[sizes > 0]] = True
        return np.flatnonzero(cut)

    @staticmethod
    def _distinct(points, starts, lengths) -> tuple[np.ndarray, np.ndarray]:
        """First occurrence of each distinct word, and the distinct word of each occurrence."""
        total = np.zeros(len(points) + 1, np.uint64)
        power = powers(len(points) + 1)
        np.cumsum(mix(points.astype(np.uint64)) * power[:-1], out=total[1:])
        ends = starts + lengths
        hashes = mix((total[ends] - total[starts]) * power[len(points) - ends] ^ lengths.astype(np.uint64))
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        # Equal hashes are no proof: compare the words, and let any that differ stand for themselves.
        at = np.arange(len(points)) - np.repeat(starts, lengths)
        same_length = lengths == lengths[first][inverse]
        twin = np.minimum(np.repeat(starts[first][inverse], lengths) + at, len(points) - 1)
        differs = np.logical_or.reduceat(points != points[twin], starts) | ~same_length
        if differs.any():
            odd = np.flatnonzero(differs)
            inverse[odd] = len(first) + np.arange(len(odd))
            first = np.append(first, odd)
        return first, inverse

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged piece (-1: none) and its rank for pairs of symbols."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        piece = np.where(found, self.merged[at], -1)
        return piece, np.where(found, self.rank[piece], NONE)

    def _encode_words(self, points, starts, lengths) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and the number of ids of each."""
        words = len(starts)
        done_sym: list[np.ndarray] = []
        done_word: list[np.ndarray] = []
        long_words = np.flatnonzero(lengths > LONG)
        for w in long_words.tolist():
            found = self._by_heap(self.chars[points[starts[w]:starts[w] + lengths[w]]].tolist())
            done_sym.append(np.array(found, np.int64))
            done_word.append(np.full(len(found), w))
        kept = np.flatnonzero(lengths <= LONG)
        size = lengths[kept]
        word = np.repeat(kept, size)
        at = np.repeat(starts[kept] - (np.cumsum(size) - size), size) + np.arange(len(word))
        sym = self.chars[points[at]]
        piece, rank = self._pairs_of(sym, word)
        while len(sym):
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            spans = np.diff(np.append(heads, len(word)))
            best = np.minimum.reduceat(rank, heads)
            if (over := best == NONE).any():
                stay = np.repeat(~over, spans)
                done_sym.append(sym[~stay])
                done_word.append(word[~stay])
                sym, word, piece, rank = sym[stay], word[stay], piece[stay], rank[stay]
                if not len(sym):
                    break
                best, spans = best[~over], spans[~over]
            hit = np.flatnonzero(rank == np.repeat(best, spans))
            # Of occurrences in a row every second one goes, the leftmost first.
            breaks = np.append(True, hit[1:] != hit[:-1] + 1)
            run = np.maximum.accumulate(np.where(breaks, np.arange(len(hit)), 0))
            take = (np.arange(len(hit)) - run) % 2 == 0
            leftmost = np.append(True, word[hit[1:]] != word[hit[:-1]])
            hit = hit[take & (leftmost | ~self.alone[piece[hit]])]
            # A word whose leftmost piece must go alone keeps its other hits for later rounds.
            lead = np.append(True, word[hit[1:]] != word[hit[:-1]])
            alone = self.alone[piece[hit]]
            first_alone = alone[np.maximum.accumulate(np.where(lead, np.arange(len(hit)), 0))]
            hit = hit[lead | ~first_alone]
            sym[hit] = piece[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            new_at = np.cumsum(keep) - 1
            sym, word, piece, rank = sym[keep], word[keep], piece[keep], rank[keep]
            fresh = new_at[hit]
            touched = np.zeros(len(sym), bool)
            touched[fresh] = touched[fresh[fresh > 0] - 1] = True
            fresh = np.flatnonzero(touched)
            nxt = np.minimum(fresh + 1, len(sym) - 1)
            p, r = self._lookup(sym[fresh], sym[nxt])
            inside = (nxt > fresh) & (word[fresh] == word[nxt])
            piece[fresh], rank[fresh] = np.where(inside, p, -1), np.where(inside, r, NONE)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return self._with_bytes(sym[order], word[order], words)

    def _pairs_of(self, sym, word) -> tuple[np.ndarray, np.ndarray]:
        piece, rank = np.full(len(sym), -1, np.int64), np.full(len(sym), NONE, np.int32)
        if len(sym) > 1:
            p, r = self._lookup(sym[:-1], sym[1:])
            inside = word[:-1] == word[1:]
            piece[:-1], rank[:-1] = np.where(inside, p, -1), np.where(inside, r, NONE)
        return piece, rank

    def _with_bytes(self, sym, word, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece become the pieces of their UTF-8 bytes."""
        unknown = np.flatnonzero(sym >= self.size)
        if not len(unknown):
            return sym.astype(np.int32), np.bincount(word, minlength=words)
        chars, which = np.unique(sym[unknown] - self.size, return_inverse=True)
        spelled = [[self.byte_ids[b] for b in chr(c).encode()] for c in chars.tolist()]
        sizes = np.ones(len(sym), np.int64)
        sizes[unknown] = np.array([len(s) for s in spelled])[which]
        out = np.repeat(sym, sizes)
        stops = np.cumsum(sizes)
        for k in range(max(map(len, spelled))):
            has = np.array([len(s) > k for s in spelled])[which]
            value = np.array([s[k] if len(s) > k else 0 for s in spelled])[which]
            rows = unknown[has]
            out[stops[rows] - sizes[rows] + k] = value[has]
        return out.astype(np.int32), np.bincount(np.repeat(word, sizes), minlength=words)

    def _by_heap(self, sym: list[int]) -> list[int]:
        """The same merge order for one long word."""
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (p := self.pairs.get(sym[i] * self.width + sym[j])) is not None:
                heapq.heappush(heap, (int(self.rank[p]), i, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = self.pairs[a * self.width + b], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in sym if s >= 0]

    # -- decoding ---------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces joined, visible spaces back to spaces, the dummy prefix dropped."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        try:
            text = raw.decode()
        except UnicodeDecodeError:      # byte pieces that are no UTF-8: as the library repairs them
            return self.library.decode(ids.tolist())
        if len(ids) and text[:1] == " " and self.raw[int(ids[0])][:1] == b" ":
            return text[1:]
        return text


def _gather(values, starts, counts, which) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated segments values[start:start + count] in the order of ``which``."""
    sizes = counts[which]
    stops = np.cumsum(sizes)
    at = np.repeat(starts[which] - (stops - sizes), sizes) + np.arange(int(stops[-1]) if len(stops) else 0)
    return values[at], sizes


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once by each worker process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(model)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                ids = known.encode(part.column(1).to_pylist())
                stops = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(stops), pa.array(np.concatenate(ids)))],
                    ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, model: str) -> DataFrame:
    """doc_id, text per row of doc_id, ids; null lists decode to the empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(model)
        for batch in batches:
            texts = pa.array((known.decode(np.array(x.as_py() or [], np.int32)) for x in batch.column(1)), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded again in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(model)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                ids = known.encode(part.column(1).to_pylist())
                listed = (b",".join(map(known.decimal.__getitem__, x.tolist())) for x in ids)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array((hashlib.sha256(x).hexdigest() for x in listed), pa.string()),
                    pa.array((hashlib.sha256(known.decode(x).encode()).hexdigest() for x in ids), pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query()
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
