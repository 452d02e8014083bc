"""SentencePiece encoding and decoding by suffix-array matching.

The different words of a batch of texts are joined into one text, whose suffixes are sorted once. A binary
search for every piece of the vocabulary gives the range of suffixes that begin with it, so all occurrences
of all pieces are known as edges (start, end, piece). The edges are sorted by where they end and relaxed in
that order. For merge vocabularies an edge is good if the pair of it and the piece before is what the merges
make of their joined text; the good edges form one path, which is the encoding the merges give.

White space is the byte 32 here (in the vocabulary it is U+2581), so a text's own U+2581 becomes a space.
A piece holds a space only in front, or nothing but spaces, so merges never cross from a character to a
following space, and a word with the spaces before it is encoded on its own.
"""

import hashlib
import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from triarm.llm.text import KEPT, Slice, SubstringHashes, map_arrow, slices

META = "▁"
SLICE_BYTES = 1 << 20
# Text that is indexed at a time (a longer word by itself): its edges take some hundred times as much memory.
INDEX_BYTES = 1 << 18
# Ids that are decoded at a time (a longer text by itself).
DECODE_IDS = 1 << 18
# Pairs of pieces whose verdict a task remembers; past it the memory starts anew.
MAX_PAIRS = 4_000_000
# Words whose ids a task remembers, some 40 bytes each; past it the memory starts anew.
MAX_SEEN = 400_000
UNKNOWN_TEXT = " ⁇ ".encode()


@dataclass
class Vocabulary:
    """Pieces as bytes by id. ``normal`` are the ids that match text, ``bytes_at`` the ids of the 256 bytes."""

    pieces: list[bytes]
    scores: list[float]
    normal: list[int]
    bytes_at: list[int]
    ids: dict[bytes, int] = field(init=False)

    def __post_init__(self):
        self.ids = {self.pieces[i]: i for i in self.normal}
        self.longest = max(map(len, self.ids))
        if any(b" " in p[1:] and p.strip(b" ") for p in self.ids):
            raise ValueError("a piece has a space after another character")
        used = np.zeros(256, dtype=bool)
        used[np.frombuffer(b"".join(self.ids), dtype=np.uint8)] = True
        # ASCII characters of no piece stand alone, so words end before and after them.
        self.alone = ~used
        self.alone[128:] = False

    @staticmethod
    def load(path: str) -> "Vocabulary":
        """A merge vocabulary with byte fallback. The file is read on the driver only."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        names = [model.id_to_piece(i) for i in every]
        raw = [b"" if special(i) else bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace(META, " ").encode()
               for i, n in enumerate(names)]
        raw[model.unk_id()] = UNKNOWN_TEXT
        bytes_at = [0] * 256
        for i in every:
            if model.is_byte(i):
                bytes_at[raw[i][0]] = i
        return Vocabulary(raw, [model.get_score(i) for i in every],
                          [i for i in every if not special(i) and not model.is_byte(i)], bytes_at)


def merge(text: bytes, vocabulary: Vocabulary) -> list[bytes]:
    """What the merges make of a short text: best score first, leftmost first."""
    parts: list[bytes | None] = [c.encode() for c in text.decode()]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[float, int, bytes]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts):
            piece = parts[i] + parts[j]
            if piece in vocabulary.ids:
                heapq.heappush(heap, (-vocabulary.scores[vocabulary.ids[piece]], i, piece))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, piece = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != piece:
            continue
        parts[i], parts[j] = piece, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [p for p in parts if p is not None]


class Pairs:
    """Whether two neighbouring pieces stay as they are; ``left`` -1 stands for the beginning of a word."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.size = vocabulary, len(vocabulary.pieces)
        self.keys, self.good = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def _check(self, left: int, right: int) -> bool:
        pieces = self.vocabulary.pieces
        whole = [pieces[right]] if left < 0 else [pieces[left], pieces[right]]
        return merge(b"".join(whole), self.vocabulary) == whole

    def stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, which = np.unique((left + 1) * self.size + right, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        good = np.zeros(len(keys), dtype=bool)
        good[known] = self.good[at[known]]
        new = keys[~known]
        if len(new):
            good[~known] = [self._check(int(k) // self.size - 1, int(k) % self.size) for k in new]
            fresh = len(self.keys) > MAX_PAIRS
            every = new if fresh else np.concatenate([self.keys, new])
            verdicts = good[~known] if fresh else np.concatenate([self.good, good[~known]])
            order = np.argsort(every)
            self.keys, self.good = every[order], verdicts[order]
        return good[which]


def _words_at(data: np.ndarray, offset: int) -> np.ndarray:
    """Eight bytes from each place on as a number in text order; zeros after the end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:max(len(data) - offset, 0)] = data[offset:]
    out = np.zeros(len(data), dtype=np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i:i + len(data)]
    return out


class SuffixArray:
    """Suffixes of ``data`` in the order of their first ``8 * 2^levels`` bytes, by doubling."""

    def __init__(self, data: np.ndarray, longest: int):
        self.levels: list[np.ndarray] = []  # sorted different keys of each level
        n, width = len(data), 8
        key = _words_at(data, 0)
        while True:
            order = np.argsort(key)
            ordered = key[order]
            step = np.ones(n, dtype=bool)
            step[1:] = ordered[1:] != ordered[:-1]
            self.levels.append(ordered[step])
            rank = np.cumsum(step) - 1
            if width >= longest:
                break
            ranks = np.empty(n, dtype=np.int64)
            ranks[order] = rank
            rank = ranks
            later = np.zeros(n, dtype=np.uint64)
            later[:max(n - width, 0)] = rank[width:].astype(np.uint64) + np.uint64(1)
            key = (rank.astype(np.uint64) << np.uint64(32)) | later
            width *= 2
        self.order, self.rank = order, rank

    def _bounds(self, piece: bytes, level: int) -> tuple[int, int]:
        """First and past-last rank on a level of the keys that begin with the piece."""
        width = 8 << level
        keys = self.levels[level]
        if level == 0:
            low = int.from_bytes(piece[:8].ljust(8, b"\0"), "big")
            high = int.from_bytes(piece[:8].ljust(8, b"\xff"), "big")
        else:
            half = width // 2
            a, b = self._bounds(piece[:half], level - 1)
            if a >= b:
                return 0, 0
            if len(piece) <= half:
                low, high = a << 32, ((b - 1) << 32) | 0xFFFFFFFF
            else:
                c, d = self._bounds(piece[half:], level - 1)
                if c >= d:
                    return 0, 0
                low, high = (a << 32) | (c + 1), (a << 32) | d
        return (int(np.searchsorted(keys, np.uint64(low), "left")), int(np.searchsorted(keys, np.uint64(high), "right")))

    def ranges(self, pieces: list[bytes], first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of ``order`` for each piece, given its first eight bytes, padded with the least and the largest.

        Short pieces are searched for all at once.
        """
        top = len(self.levels) - 1
        low, high = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        a, b = np.searchsorted(self.levels[0], first, "left"), np.searchsorted(self.levels[0], last, "right")
        present = np.flatnonzero(a < b)
        for level in range(1, top + 1):  # ranks of the short ones on the levels above
            a_up = np.searchsorted(self.levels[level], a.astype(np.uint64) << np.uint64(32), "left")
            b = np.searchsorted(self.levels[level], b.astype(np.uint64) << np.uint64(32), "left")
            a = a_up
        low[present], high[present] = a[present], b[present]
        for i in present:
            if len(pieces[i]) > 8:
                low[i], high[i] = self._bounds(pieces[i], top)
        return np.searchsorted(self.rank, low, "left"), np.searchsorted(self.rank, high, "left")


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``starts[i] .. starts[i] + counts[i] - 1`` of all i, one after the other."""
    total = int(counts.sum())
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return shift + np.arange(total)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.pairs = vocabulary, Pairs(vocabulary)
        self.texts = [vocabulary.pieces[i] for i in vocabulary.normal]
        self.lengths = np.array([len(t) for t in self.texts])
        padded = lambda fill: np.array([int.from_bytes(t[:8].ljust(8, fill), "big") for t in self.texts], dtype=np.uint64)
        self.low, self.high = padded(b"\0"), padded(b"\xff")
        self.normal = np.array(vocabulary.normal)
        self.bytes_at = np.array(vocabulary.bytes_at)
        self._forget()

    def _forget(self) -> None:
        """Words seen before: their hashes in order, and where in ``pool`` their ids are."""
        self.seen, self.at = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.counts, self.pool = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def _remember(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        at = len(self.pool) + np.cumsum(counts) - counts
        order = np.argsort(seen := np.concatenate([self.seen, hashes]))
        self.seen, self.at = seen[order], np.concatenate([self.at, at])[order]
        self.counts = np.concatenate([self.counts, counts])[order]
        self.pool = np.concatenate([self.pool, ids.astype(np.int32)])

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin, and each text's first word."""
        n = len(data)
        space, alone = data == 32, self.vocabulary.alone[data]
        begin = np.zeros(n, dtype=bool)
        if n:
            begin[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
            begin[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero(begin)
        return starts, np.searchsorted(starts, offsets)

    def _relax(self, size: int, starts: np.ndarray, ends: np.ndarray, pieces: np.ndarray, heads: np.ndarray,
               word: np.ndarray) -> np.ndarray:
        """Best last edge at each end: its number, or -1. Edges are sorted by their end within the word."""
        last = np.full(size + 1, -1, dtype=np.int64)
        inside = ends - heads[word]
        order = np.argsort(inside.astype(np.uint16) if len(inside) and inside.max() < 1 << 16 else inside, kind="stable")
        turns = np.concatenate([[0], np.flatnonzero(np.diff(inside[order])) + 1, [len(order)]]) if len(order) else [0]
        for a, b in zip(turns, turns[1:]):
            edge = order[a:b]
            first = starts[edge] == heads[word[edge]]
            before = last[starts[edge]]
            edge, before, first = (x[first | (before >= 0)] for x in (edge, before, first))
            left = np.where(first, -1, pieces[before])
            # A character of no piece (-2) stays beside anything.
            free = (pieces[edge] < 0) | (left == -2)
            good = free.copy()
            ask = np.flatnonzero(~free)
            if len(ask):
                good[ask] = self.pairs.stay(left[ask], pieces[edge[ask]])
            alone = free & (pieces[edge] >= 0)
            if alone.any():
                good[alone] = self.pairs.stay(np.full(int(alone.sum()), -1), pieces[edge[alone]])
            last[ends[edge[good]]] = edge[good]
        return last

    def _encode_words(self, data: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``data[heads[i]:tails[i]]``, and how many each has. The words fill ``data``."""
        n = len(data)
        word = np.repeat(np.arange(len(heads)), tails - heads)
        array = SuffixArray(data, self.vocabulary.longest)
        low, high = array.ranges(self.texts, self.low, self.high)
        counts = high - low
        starts = array.order[_expand(low, counts)]
        which = np.repeat(np.arange(len(counts)), counts)
        ends = starts + self.lengths[which]
        inside = ends <= tails[word[starts]]
        starts, ends, pieces = starts[inside], ends[inside], self.normal[which[inside]]
        # Characters that no piece consists of: edges of their own.
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(np.append(lead, n))
        single = np.zeros(n, dtype=bool)
        span = np.zeros(n, dtype=np.int64)
        span[lead] = width
        single[starts[ends - starts == span[starts]]] = True
        odd = lead[~single[lead]]
        starts = np.concatenate([starts, odd])
        ends = np.concatenate([ends, odd + span[odd]])
        pieces = np.concatenate([pieces, np.full(len(odd), -2)])
        last = self._relax(n, starts, ends, pieces, heads, word[starts])
        # Back from the end of each word to its beginning.
        at, alive = tails.copy(), np.flatnonzero(tails > heads)
        found, owner, turn = [], [], []
        step = 0
        while len(alive):
            edge = last[at[alive]]
            found.append(edge)
            owner.append(alive)
            turn.append(np.full(len(alive), step))
            at[alive] = starts[edge]
            alive = alive[at[alive] > heads[alive]]
            step += 1
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(len(heads), dtype=np.int64)
        found, owner, turn = np.concatenate(found), np.concatenate(owner), np.concatenate(turn)
        order = np.lexsort((-turn, owner))
        found, owner = found[order], owner[order]
        # A character of no piece becomes its bytes.
        odd = pieces[found] < 0
        count = np.where(odd, ends[found] - starts[found], 1)
        ids = np.repeat(pieces[found], count)
        spots = np.repeat(odd, count)
        ids[spots] = self.bytes_at[data[_expand(starts[found[odd]], count[odd])]]
        return ids, np.bincount(owner, weights=count, minlength=len(heads)).astype(np.int64)

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, one after the other, and how many each has."""
        words, first = self._words(part.data, part.offsets)
        ends = np.append(words[1:], len(part.data))
        kinds, example, which = np.unique(
            SubstringHashes(part.data).of(words, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.seen, kinds)
        new = at >= len(self.seen)
        new[~new] = self.seen[at[~new]] != kinds[~new]
        if len(self.seen) + new.sum() > MAX_SEEN:
            self._forget()
            new[:] = True
        if new.any():
            wanted, at = kinds[new], words[example[new]]
            sizes = ends[example[new]] - at
            chunk = np.cumsum(sizes) // INDEX_BYTES
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1, [len(at)]])
            for a, b in zip(cuts, cuts[1:]):
                tails = np.cumsum(sizes[a:b])
                data = part.data[_expand(at[a:b], sizes[a:b])]
                self._remember(wanted[a:b], *self._encode_words(data, tails - sizes[a:b], tails))
        at = np.searchsorted(self.seen, kinds)[which]
        per_word = self.counts[at]
        flat = self.pool[_expand(self.at[at], per_word)]
        sums = np.concatenate([[0], np.cumsum(per_word)])
        return flat, np.diff(sums[first])


@lru_cache(maxsize=1)
def _encoder(vocabulary: "Shared") -> Encoder:
    return Encoder(vocabulary.vocabulary)


KEPT[__name__] = _encoder.cache_clear


class Shared:
    """A vocabulary by its contents, so that tasks of one process use one encoder and what it remembers."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.digest = hashlib.sha256(pickle.dumps((vocabulary.pieces, vocabulary.scores, vocabulary.normal))).digest()

    def __hash__(self) -> int:
        return hash(self.digest)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Shared) and self.digest == other.digest


def _with_space(texts: pa.Array) -> pa.Array:
    """Texts as the vocabulary sees them: a space in front of what is not empty, U+2581 as a space."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.replace_substring(texts, META, " ")
    empty, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    return pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(empty, texts, space))


def _columns(df: DataFrame, *drop: str) -> tuple[list[str], str]:
    kept = [f for f in df.schema.fields if f.name not in drop]
    return [f.name for f in kept], "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.sizes = np.array([len(p) for p in vocabulary.pieces])
        self.joined = np.frombuffer(b"".join(vocabulary.pieces), dtype=np.uint8)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def texts(self, flat: np.ndarray, places: np.ndarray) -> pa.Array:
        """Texts of the ids ``flat[places[i]:places[i + 1]]``."""
        size = self.sizes[flat]
        data = self.joined[_expand(self.begins[flat], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[places]
        # The added space: the first byte of a text that has one.
        starts = ends[:-1]
        spaced = starts < ends[1:]
        spaced[spaced] = data[starts[spaced]] == 32
        keep = np.ones(len(data), dtype=bool)
        keep[starts[spaced]] = False
        data, ends = data[keep], ends - np.concatenate([[0], np.cumsum(spaced)])
        out = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
        try:
            return out.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode(errors="replace") for x in out.to_pylist()], type=pa.string())


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", check: str | None = None) -> DataFrame:
    """``df`` with the column ``ids``, the encoding of ``text``; a column of that name is replaced.

    With ``check``, a column of that name says whether the ids decode to the text (with U+2581 as a space).
    NULL and empty texts have no ids. Each batch of texts is encoded in the task that reads it, a megabyte at
    a time (a longer text by itself); nothing is shuffled.
    """
    names, schema = _columns(df, *filter(None, (ids, check)))
    shared = Shared(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(shared), Decoder(shared.vocabulary)
        for batch in batches:
            for part in slices(batch.column(text), SLICE_BYTES):
                some = batch.slice(part.rows.start, part.rows.stop - part.rows.start)
                spaced = _with_space(some.column(text))
                flat, counts = encoder.encode(next(slices(spaced, 1 << 62)))
                places = np.concatenate([[0], np.cumsum(counts)])
                lists = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(flat.astype(np.int32)))
                columns = [*(some.column(n) for n in names), lists]
                if check:
                    back = _with_space(decoder.texts(flat, places))
                    columns.append(pc.equal(back, spaced))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, ids, *([check] if check else [])])

    return df.transform(map_arrow, run, f"{schema}`{ids}` ARRAY<INT>" + (f", `{check}` BOOLEAN" if check else ""))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with the column ``text``, what ``ids`` stand for; a column of that name is replaced.

    No ids, and NULL, are the empty text. The space in front of the first piece goes. Bytes that form no
    character become U+FFFD; control pieces are nothing. An id outside the vocabulary fails the job.
    """
    names, schema = _columns(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary)
        for batch in batches:
            column = batch.column(ids)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            if len(flat) and not (0 <= flat.min() and flat.max() < len(decoder.sizes)):
                raise ValueError("an id is outside the vocabulary")
            counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            places = np.concatenate([[0], np.cumsum(counts)])
            first = 0
            while first < len(counts):
                last = max(first + 1, int(np.searchsorted(places, places[first] + DECODE_IDS, "right")) - 1)
                texts = decoder.texts(flat[places[first]:places[last]], places[first:last + 1] - places[first])
                kept = [batch.column(n).slice(first, last - first) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, texts], names=[*names, text])
                first = last

    return df.transform(map_arrow, run, f"{schema}`{text}` STRING")
