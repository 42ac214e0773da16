"""SentencePiece encoding by streaming Viterbi, and decoding.

The pieces come from a given model file, which is never trained here; a piece's log probability follows from its
rank by Zipf's law (the file's own scores are ranks). The encoder reads characters in order and keeps, for a window
of boundaries, the best score of each and the piece that gave it. A piece is at most as long as the longest one, so
only the last boundaries of that number can still be gone on from. Their paths are walked back from time to time: where
all of them run through one boundary, the ids up to it are committed and the window begins there. All texts go this way,
whatever their length: those of a slice are one stream, with a mark between them that no piece holds.

Which pieces begin at each place is looked up for a block of characters at a time, by hashes that grow character by
character as long as some piece goes on that way. A character that no piece covers becomes its UTF-8 bytes' ids.

A space becomes a word mark and one mark is put in front; decoding takes both back, so that decode(encode(text)) is
the text, byte for byte, except that word marks in the text itself come back as spaces. Each text's ids are turned back
to see whether it goes round; a false match of a hash would show there, and such a text is encoded again with every
match compared.

Defined cases: a null or empty text has no ids and decodes to the empty text; a very long text, or a very long run
without a word's start, is encoded whole in a window that is cut wherever paths meet; of equal sums the path whose last
piece is longest wins; rows are encoded one by one, so repeated ids and rows don't matter; an empty table gives no rows;
other columns pass through, clashing names are replaced.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import add_columns, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Score of a byte that stands in for part of an uncovered character: below any piece's.
BYTE_SCORE = -20 * 2**20
#: Scores are kept in whole steps of this part of a nat.
SCALE = 2**20
#: Characters whose pieces are looked up at a time, and of the texts of one stream, about.
BLOCK, STREAM = 8192, 120_000
#: Paths are walked back after this many times the longest piece, and the score of what has none.
STEP, NONE = 4, -(2**48)
#: Lanes of a stream, at most, and the longest way between two boundaries that lanes may begin at.
LANES, LONG = 512, 2048
#: Cells of lanes that an encoder keeps room for from one stream to the next.
ROOM = 6_000_000
#: Between texts: no character, so in no piece. Its id in a stream; ids below it are uncovered characters.
END, END_ID = 0x110000, -1
#: Base and factor of hashes.
BASE, FACTOR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Pieces:
    """The vocabulary: by string the piece's id and score (None: only a prefix of pieces), strings and bytes by id, ids of
    bytes.

    Scores are whole numbers, so that equal sums are equal wherever the sum began."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: dict[int, int]):
        self.entries: dict[str, tuple[int, int] | None] = {p[:k]: None for _, p, _ in pieces for k in range(1, len(p))}
        self.entries |= {p: (i, round(s * SCALE)) for i, p, s in pieces}
        self.strings = {i: p for i, p, _ in pieces}
        own = {i: p.encode() for i, p, _ in pieces} | {i: bytes([b]) for b, i in byte_ids.items()}
        self.text = [own.get(i, b"") for i in range(max(own, default=-1) + 1)]
        # The same end to end.
        self.spelling, self.sizes = np.frombuffer(b"".join(self.text), np.uint8), np.array([*map(len, self.text)], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.byte_ids = byte_ids
        self.longest = max((len(p) for _, p, _ in pieces), default=1)
        # Whether a boundary before a word's mark is one that no piece reaches over.
        self.words = not any(MARK in p.lstrip(MARK) for _, p, _ in pieces)
        self.table = PieceTable(self.entries)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids (uint8)."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.spelling[np.repeat(self.begins[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ids) else 0)]

    @classmethod
    def load(cls, path: str) -> Pieces:
        """From a model file: control and unused pieces are left out, byte pieces are kept apart."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, rank = [], {}, 0
        norm = math.log(sum(1 / (k + 1) for k in range(model.get_piece_size())))
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                rank += 1
                pieces.append((i, piece, -math.log(rank) - norm))
        return cls(pieces, byte_ids)


class PieceTable:
    """Pieces and their prefixes by a 64-bit hash of their characters, in one array of slots whose number follows theirs:
    id (-1 for what is only a prefix) and score at once for many strings."""

    def __init__(self, entries: dict[str, tuple[int, int] | None]):
        self.bits = max(10, (4 * len(entries)).bit_length())
        size = 2**self.bits
        self.keys, self.ids, self.scores = np.zeros(size, np.uint64), np.full(size, -1, np.int32), np.zeros(size, np.int64)
        by_length: dict[int, list[str]] = {}
        for p in entries:
            by_length.setdefault(len(p), []).append(p)
        for n, own in by_length.items():
            chars = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(len(own), n)
            keys = np.zeros(len(own), np.uint64)
            for j in range(n):
                keys = grown(keys, chars[:, j])
            for p, key, slot in zip(own, keys, self.first(keys).tolist(), strict=True):
                while self.keys[slot]:
                    slot = (slot + 1) % size
                self.keys[slot] = key
                if entries[p] is not None:
                    self.ids[slot], self.scores[slot] = entries[p]

    def first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each key, and whether it is there."""
        slot = self.first(keys)
        held = self.keys[slot]
        found = held == keys
        at = np.flatnonzero(~found & (held != 0))
        while len(at):
            slot[at] = (slot[at] + 1) % len(self.keys)
            held = self.keys[slot[at]]
            hit = held == keys[at]
            found[at[hit]] = True
            at = at[~hit & (held != 0)]
        return slot, found


def grown(keys: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Hashes of strings that are one character longer."""
    return keys * BASE + chars.astype(np.uint64) + np.uint64(1)


class StreamingEncoder:
    """Viterbi over a window of boundaries, committing ids where all surviving paths meet."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        #: Uncovered characters: their places in ``bytes_of``, and the ids of their bytes.
        self.uncovered: dict[int, int] = {}
        self.bytes_of: list[tuple[int, ...]] = []
        #: Ids that were committed, and the widest window so far.
        self.committed = self.widest = 0
        self.room: tuple[np.ndarray, np.ndarray] | None = None

    def _uncovered(self, code: int) -> int:
        if code not in self.uncovered:
            self.uncovered[code] = len(self.bytes_of)
            self.bytes_of.append(tuple(self.pieces.byte_ids[b] for b in chr(code).encode("utf-8", "replace") if b in self.pieces.byte_ids))
        return self.uncovered[code]

    def _matches(self, chars: np.ndarray, exact: bool) -> tuple[np.ndarray, ...]:
        """start, end, score and id of all pieces in ``chars``."""
        table, n = self.pieces.table, len(chars)
        at, keys, covered, found = np.arange(n), np.zeros(n, np.uint64), np.zeros(n, bool), []
        for length in range(1, self.pieces.longest + 1):
            if len(at) and at[-1] + length > n:
                inside = at + length <= n
                at, keys = at[inside], keys[inside]
            if not len(at):
                break
            keys = grown(keys, chars[at + length - 1])
            slot, goes_on = table.find(keys)
            at, keys, slot = at[goes_on], keys[goes_on], slot[goes_on]
            ids = table.ids[slot]
            own = ids >= 0
            if exact:
                own &= np.array([i < 0 or self.pieces.strings[i] == "".join(map(chr, chars[k : k + length])) for k, i in zip(at.tolist(), ids.tolist(), strict=True)], bool)
            found.append((at[own], at[own] + length, table.scores[slot[own]], ids[own].astype(np.int64)))
            if length == 1:
                covered[at[own]] = True
        bare = np.flatnonzero(~covered)
        codes, which = np.unique(chars[bare], return_inverse=True)
        own = [None if c == END else self._uncovered(c) for c in codes.tolist()]
        scores = np.array([0 if k is None else BYTE_SCORE * max(1, len(self.bytes_of[k])) for k in own], np.int64)
        names = np.array([END_ID if k is None else END_ID - 1 - k for k in own], np.int64)
        found.append((bare, bare + 1, scores[which], names[which]))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def stream(self, chars: np.ndarray, exact: bool = False) -> list[int]:
        """Ids of a stream of characters (uint32) that ends with END."""
        longest, ids, step = self.pieces.longest, [], STEP * self.pieces.longest
        # The window: of its boundaries, from ``origin`` on, the best score, where the best path's last piece begins and
        # its id. Up to ``base``, counted from there, ids are committed; paths are walked back at ``check``.
        best, froms, names, origin, base, check = [0], [0], [0], 0, 0, step
        for low in range(0, len(chars), BLOCK):
            high = min(len(chars), low + BLOCK)
            first = max(0, low - longest + 1)
            start, end, score, name = (x.tolist() for x in self._after(self._matches(chars[first:high], exact), first, low, origin))
            cuts = [*range(low - origin + step, high - origin, step), high - origin]
            done = 0
            for at, until in zip(cuts, np.searchsorted(end, cuts, side="right").tolist(), strict=True):
                last, top = len(best), NONE
                for s, e, x, i in zip(start[done:until], end[done:until], score[done:until], name[done:until], strict=True):
                    if e != last:  # the boundary before is done
                        best.append(top)
                        froms.append(come)
                        names.append(own)
                        last, top = e, best[s] + x
                        come, own = s, i
                    else:
                        here = best[s] + x
                        if here > top:
                            top, come, own = here, s, i
                best.append(top)
                froms.append(come)
                names.append(own)
                done = until
                if at + origin < check and at + origin < len(chars):
                    continue
                self.widest = max(self.widest, at - base + 1)
                meet = self._meeting(froms, at if at + origin == len(chars) else max(base, at - longest + 1), at)
                if meet > base:
                    path, back = [], meet
                    while back > base:
                        path.append(names[back])
                        back = froms[back]
                    ids.extend(reversed(path))
                    self.committed += len(path)
                    base = meet
                # Doubled where paths stay apart, so that walking them back stays in proportion.
                check = origin + at + max(step, at - base)
            best, froms, names = best[base:], [k - base for k in froms[base:]], names[base:]
            origin, base = origin + base, 0
        return ids

    @staticmethod
    def _after(found: tuple[np.ndarray, ...], first: int, low: int, origin: int) -> tuple[np.ndarray, ...]:
        """Matches that end after ``low``, by end and then start, so the longest comes first; places from ``origin`` on."""
        start, end, score, name = found
        kept = np.lexsort((start, end))
        kept = kept[end[kept] > low - first]
        return start[kept] + (first - origin), end[kept] + (first - origin), score[kept], name[kept]

    @staticmethod
    def _meeting(froms: list[int], low: int, high: int) -> int:
        """The last boundary that the paths of all boundaries from low to high run through."""
        live = set(range(low, high + 1))
        while len(live) > 1:
            if high in live:
                live.remove(high)
                live.add(froms[high])
            high -= 1
        return live.pop()

    def _cells(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores, all NONE, and ids, of any value, of cells; the same memory each time unless there are very many."""
        if size > ROOM:
            return np.full(size, NONE), np.empty(size, np.int32)
        if self.room is None or len(self.room[0]) < size:
            self.room = np.empty(size, np.int64), np.empty(size, np.int32)
        scores, names = self.room[0][:size], self.room[1][:size]
        scores.fill(NONE)
        return scores, names

    def lanes(self, chars: np.ndarray, offsets: np.ndarray, exact: bool = False) -> np.ndarray:
        """Ids of a stream that is taken up at ``offsets``, none of whose boundaries a piece reaches over, side by side."""
        longest, width, n = self.pieces.longest, len(offsets), len(chars)
        lengths = np.diff(np.append(offsets, n))
        # The longest lanes first, so that those that go on at a step are the first ones.
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(width, np.int64)
        rank[order] = np.arange(width)
        own_of = np.repeat(rank, lengths)
        offsets, lengths = offsets[order], lengths[order]
        steps, lane = int(lengths[0]), np.arange(width)
        going_on = np.searchsorted(-lengths, -np.arange(steps + 1), side="right")
        going_on[0] = 0
        cell = longest * (np.cumsum(going_on) - going_on)
        start, end, score, name = self._matches(chars, exact)
        # By step, place of the piece's beginning in the window (the longest first), and lane; no piece leaves its lane.
        # Below the score stands the length, so that the largest sum names its piece, and of equal ones the longest.
        bits = longest.bit_length()
        low = 2**bits - 1
        own, size = own_of[start], end - start
        at = end - offsets[own]
        spot = cell[at] + (longest - size) * going_on[at] + own
        scores, names = self._cells(longest * n)
        scores[spot], names[spot] = (score << bits) + size, name
        best, length = np.full((steps + 1 + longest, width), NONE), np.zeros((steps + 1, width), np.int32)
        best[longest] = 0
        base, out = np.zeros(width, np.int64), []
        check, spans, counts = STEP * longest, cell.tolist(), going_on.tolist()
        for at in range(1, steps + 1):
            k, begin = counts[at], spans[at]
            sums = scores[begin : begin + longest * k].reshape(longest, k)  # read once, so the sums may take their place
            sums += best[at : at + longest, :k]
            top = sums.max(0)
            length[at, :k] = chosen = top & low
            top -= chosen
            np.maximum(top, NONE, out=best[at + longest, :k])
            if at % check and at < steps:
                continue
            here = np.minimum(at, lengths)
            self.widest = max(self.widest, int((here - base).max()) + 1)
            # Boundaries that a piece can still start from (at a lane's end only that), walked back until one is left.
            live = np.maximum(here - np.where(here < lengths, np.arange(longest)[:, None], 0), base)
            while True:
                last = live.min(0)
                moves = live > last
                if not moves.any():
                    break
                live -= np.where(moves, length[live, lane], 0)
            meet = live[0]
            back, going = meet.copy(), np.flatnonzero(meet > base)
            while len(going):
                ends, n_chars = back[going], length[back[going], going]
                out.append((offsets[going] + ends, names[cell[ends] + (longest - n_chars) * going_on[ends] + going]))
                back[going] -= n_chars
                going = going[back[going] > base[going]]
            base = meet
        ends, ids = map(np.concatenate, zip(*out, strict=True))
        self.committed += len(ids)
        return ids[np.argsort(ends, kind="stable")]

    def ids_of(self, chars: np.ndarray, exact: bool = False) -> np.ndarray:
        """Ids of a stream that ends with END: lanes where it can be taken up often enough, else one after another."""
        begins = chars[:-1] == END
        if self.pieces.words:
            begins |= (chars[1:] == ord(MARK)) & (chars[:-1] != ord(MARK))
        free = np.concatenate([[0], np.flatnonzero(begins) + 1, [len(chars)]])
        far = np.flatnonzero(np.diff(free) > LONG)
        out: list[np.ndarray] = []
        done = 0
        for k in (*far.tolist(), len(free) - 1):
            # What lies before the next long way, a stream's worth at a time; then that way by itself.
            for low, high in self._shares(free[done : k + 1]):
                inside = free[(free >= low) & (free < high)]
                aims = low + np.arange(LANES) * max(1, (high - low) // LANES)
                offsets = np.unique(inside[np.minimum(np.searchsorted(inside, aims), len(inside) - 1)])
                offsets[0] = low
                out.append(self.lanes(chars[low:high], offsets - low, exact))
            if k < len(free) - 1:
                out.append(np.array(self.stream(chars[free[k] : free[k + 1]], exact), np.int32))
            done = k + 1
        return np.concatenate(out)

    @staticmethod
    def _shares(free: np.ndarray) -> list[tuple[int, int]]:
        """Parts of about STREAM characters between boundaries, alike in size."""
        if len(free) < 2:
            return []
        n = max(1, round(int(free[-1] - free[0]) / STREAM))
        at = np.unique(free[np.searchsorted(free, free[0] + np.arange(n) * int(free[-1] - free[0]) // n)])
        at = at[at < free[-1]].tolist()
        return list(zip(at, [*at[1:], int(free[-1])], strict=True))

    def _solved(self, texts: list[str], exact: bool = False) -> list[np.ndarray]:
        """int32 ids of texts with marks, as one stream."""
        chars = np.concatenate([x for t in texts for x in (np.frombuffer(t.encode("utf-32-le"), np.uint32), np.array([END], np.uint32))])
        found = self.ids_of(chars, exact).astype(np.int32)
        rare = found < END_ID
        if rare.any():
            own = [self.bytes_of[END_ID - 1 - x] for x in found[rare].tolist()]
            times = np.ones(len(found), np.int64)
            times[rare] = [*map(len, own)]
            found, rare = np.repeat(found, times), np.repeat(rare, times)
            found[rare] = np.fromiter(chain.from_iterable(own), np.int32)
        return [x[:-1] for x in np.split(found, np.flatnonzero(found == END_ID) + 1)[:-1]]

    def viterbi(self, chars: str) -> list[int]:
        """Ids of ``chars``, marks and all."""
        return self._solved([chars])[0].tolist()

    def encode_all(self, texts: list[str | None]) -> list[tuple[bytes, bool]]:
        """int32 ids of each text as bytes, and whether they decode to it."""
        out: list[tuple[bytes, bool]] = [(b"", True)] * len(texts)
        held: list[int] = []
        marked: list[str] = []
        size = 0
        fits = lambda own, text: b"".join(map(self.pieces.text.__getitem__, own.tolist())) == text.encode()
        for k, t in enumerate(texts):
            if t:
                held.append(k)
                marked.append(MARK + t.replace(" ", MARK))
                size += len(t)
            if held and (size >= STREAM or k == len(texts) - 1):
                found, raw = self._solved(marked), [m.encode() for m in marked]
                # All at once: each text's bytes are as many as its ids', and the same end to end.
                every = np.concatenate(found)
                ends = np.cumsum(np.append(0, self.pieces.sizes[every]))[np.cumsum([*map(len, found)])]
                alike = np.array_equal(ends, np.cumsum([*map(len, raw)])) and np.array_equal(self.pieces.spelled(every), np.frombuffer(b"".join(raw), np.uint8))
                for i, text, own in zip(held, marked, found, strict=True):
                    goes_round = alike or fits(own, text)
                    if not goes_round:
                        own = self._solved([text], exact=True)[0]
                        goes_round = fits(own, text)
                    out[i] = (own.tobytes(), goes_round)
                held, marked, size = [], [], 0
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """int32 ids of a text."""
        return np.frombuffer(self.encode_all([text])[0][0], np.int32)


def decode_ids(ids: np.ndarray | list[int], pieces: Pieces) -> str:
    out = b"".join(map(pieces.text.__getitem__, np.asarray(ids, np.int32).tolist())).decode("utf-8", "replace").replace(MARK, " ")
    return out[1:]


#: Rows that a worker encodes before it hands them on.
BATCH = 1000


def _lists(ids: list[bytes]) -> pa.Array:
    """Arrays of ids, laid end to end."""
    ends = np.cumsum([0, *map(len, ids)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def _encoded(docs: DataFrame, fields: dict, columns, model: str, col: str) -> DataFrame:
    """``columns`` makes the new ones from pairs of ids and whether they go round. The vocabulary is read on the driver
    and broadcast; its size is the model file's."""
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def worker():
        encoder = StreamingEncoder(shared.value)
        return lambda part: columns(encoder.encode_all(part.column(col).to_pylist()))

    return add_columns(docs, fields, worker, BATCH)


IDS = (T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))


def encode(docs: DataFrame, *, model: str = MODEL, col: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``: array<int>."""
    return _encoded(docs, {out: IDS}, lambda found: [_lists([ids for ids, _ in found])], model, col)


def encode_checked(docs: DataFrame, *, model: str = MODEL) -> DataFrame:
    """Adds n_ids, ids, ids_sha256 (over little-endian int32) and round_trip (decoding gives the text back) in one pass."""
    fields = {"n_ids": (T.LongType(), pa.int64()), "ids": IDS, "ids_sha256": (T.StringType(), pa.string()), "round_trip": (T.BooleanType(), pa.bool_())}

    def columns(found: list[tuple[bytes, bool]]) -> list:
        ids = [x for x, _ in found]
        return [[len(x) // 4 for x in ids], _lists(ids), [hashlib.sha256(x).hexdigest() for x in ids], [ok for _, ok in found]]

    return _encoded(docs, fields, columns, model, "text")


def decode(encoded: DataFrame, *, model: str = MODEL, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the text of an array of ids; ids past the vocabulary raise, control pieces are empty."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model))
    worker = lambda: lambda part: [[decode_ids(x or [], shared.value) for x in part.column(ids).to_pylist()]]
    return add_columns(encoded, {out: (T.StringType(), pa.string())}, worker)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_checked(docs).select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "n_ids", "ids", "ids_sha256", "round_trip")
