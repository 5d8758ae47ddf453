"""SentencePiece encoding and decoding by suffix-array matching.

Of a batch's text, what is concatenated are the segments (text between two word-start marks; no piece reaches over one)
that the worker does not remember from before. The suffix array of that, ordered as far as the longest piece, is searched
by bisection for every piece at once; each piece's occurrences are a range of it. The resulting edges are sorted by
length and dealt out by start, and relaxed from left to right for all segments together. In a BPE model the text up to
any point has one encoding, and a token may end it exactly if the merges leave it and the token before it apart; so
relaxing an edge means testing that pair, which is remembered. The ids equal those of the library for the whole text.

A long segment (script without spaces, say) is relaxed in chunks, all at once, each from some way before its own start.
What token ends at a point depends only on those that end at the points before it within a piece's length; so where a
chunk agrees with the one before it over that length, it is right from there on. Where it does not, it is walked point by
point from the known ends. Time grows with the text's length.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import bounded_batches

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
START, UNKNOWN = -1, -2


@dataclass
class Model:
    """What encoding needs of a BPE model: pieces by id, their merge rank, and ids of the 256 bytes."""

    pieces: list[str]
    rank: dict[str, tuple[float, int]]  # of normal pieces: (-score, id)
    byte_ids: list[int]
    unk: int
    decoded: list[str | None] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Model:
        """From a model file on the driver. Only BPE models without text normalisation are taken."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kinds = proto.normalizer_spec, pb.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("expected a BPE model with a word-start mark and no normalisation")
        pieces = [p.piece for p in proto.pieces]
        if any(p.type == kinds.USER_DEFINED or p.type == kinds.NORMAL and MARK in p.piece.lstrip(MARK) for p in proto.pieces):
            raise ValueError("a piece reaches over a word start")
        rank = {p.piece: (-p.score, i) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        at = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        byte_ids = [at.get(f"<0x{b:02X}>", -1) for b in range(256)]
        unk = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        decoded = [p.piece.replace(MARK, " ") if p.type == kinds.NORMAL else None for p in proto.pieces]
        return cls(pieces, rank, byte_ids, unk, decoded)


def merges(text: str, rank: dict[str, tuple[float, int]]) -> list[str]:
    """A short text by plain merging: the best-scored pair first, the leftmost of equals."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = rank.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r[0] < best):
                best, at = r[0], i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Encoder:
    """Encodes batches of texts; keeps the encodings of segments, bounded, from batch to batch."""

    def __init__(self, model: Model, keep: int = 200_000, block: int = 1 << 18, slots: int = 1 << 20):
        self.m, self.keep, self.block = model, keep, block
        usable = [(p, i) for p, (_, i) in model.rank.items() if merges(p, model.rank) == [p]]
        self.width = max((len(p) for p, _ in usable), default=1)
        chars = sorted({c for p, _ in usable for c in p})
        self.code = np.ones(0x110000, dtype=np.uint16)  # 0 ends a segment, 1 is a character of no piece
        for k, c in enumerate(chars):
            self.code[ord(c)] = k + 2
        self.lone = np.full(len(chars) + 2, UNKNOWN, dtype=np.int32)  # ids of single characters
        self.keys = -(-self.width // 4)
        self.ids = np.array([i for _, i in usable], dtype=np.int32)
        self.lens = np.array([len(p) for p, _ in usable], dtype=np.int64)
        grid = np.zeros((len(usable), self.keys * 4), dtype=np.uint64)
        for row, (p, _) in enumerate(usable):
            grid[row, : len(p)] = self.code[[ord(c) for c in p]]
        self.low = self._packed(grid)
        tail = np.arange(self.keys * 4) >= self.lens[:, None]
        self.high = self._packed(np.where(tail, np.uint64(0xFFFF), grid))
        self.pair_key = np.full(slots, -1, dtype=np.int64)  # a direct-mapped memory of tested pairs
        self.pair_ok = np.zeros(slots, dtype=bool)
        self.apart: dict[tuple[int, int], bool] = {}  # the same pairs, for the walk point by point
        self.window: tuple = (None, 0, 0, [])  # segment, from, to and edges of the walk's last window
        self.chunk, self.lead = 8 * self.width, 4 * self.width
        self._clear()

    def _clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.flat, self.begin, self.count, self.used = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _thin(self) -> None:
        """Keeps the more used half of the segments; the uses are halved, too, so that what is new has its chance."""
        stay = np.sort(np.argsort(-self.used, kind="stable")[: self.keep // 2])
        names = list(self.seen)
        self.seen = {names[i]: k for k, i in enumerate(stay.tolist())}
        n = self.count[stay]
        upto = np.concatenate([[0], np.cumsum(n)])
        self.flat = self.flat[np.repeat(self.begin[stay] - upto[:-1], n) + np.arange(upto[-1])]
        self.begin, self.count, self.used = upto[:-1], n, self.used[stay] // 2

    @staticmethod
    def _packed(grid: np.ndarray) -> list[np.ndarray]:
        """Columns of 16-bit codes as 64-bit words of four, most significant first."""
        four = grid.reshape(len(grid), -1, 4)
        return [(four[:, k, 0] << np.uint64(48)) | (four[:, k, 1] << np.uint64(32)) | (four[:, k, 2] << np.uint64(16)) | four[:, k, 3] for k in range(four.shape[1])]

    def _suffixes(self, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The suffix array of codes, ordered over the longest piece's width, and its sorted key words."""
        n = len(codes)
        padded = np.concatenate([codes, np.zeros(self.keys * 4 + 3, np.uint16)]).astype(np.uint64)
        word = (padded[:-3] << np.uint64(48)) | (padded[1:-2] << np.uint64(32)) | (padded[2:-1] << np.uint64(16)) | padded[3:]
        words = [word[4 * k : 4 * k + n] for k in range(self.keys)]
        order = np.lexsort(words[::-1])
        return order, [w[order] for w in words]

    @staticmethod
    def _bisect(words: list[np.ndarray], goal: list[np.ndarray], right: bool) -> np.ndarray:
        """For each goal the first suffix not below it (right: above it); all pieces advance together."""
        lo, hi = np.zeros(len(goal[0]), np.int64), np.full(len(goal[0]), len(words[0]), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            at = np.minimum(mid, len(words[0]) - 1)
            less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
            for w, g in zip(words, goal):
                v = w[at]
                less |= same & (v < g)
                same &= v == g
            down = (less | same if right else less) & open_
            lo, hi = np.where(down, mid + 1, lo), np.where(open_ & ~down, mid, hi)
        return lo

    def _edges(self, codes: np.ndarray) -> list[np.ndarray]:
        """By length - 1: the piece that starts at each position, or UNKNOWN where none does."""
        order, words = self._suffixes(codes)
        first, last = self._bisect(words, self.low, False), self._bisect(words, self.high, True)
        n = last - first
        hit = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        start, length, piece = order[hit], np.repeat(self.lens, n), np.repeat(self.ids, n)
        columns = [np.full(len(codes), UNKNOWN, np.int32) for _ in range(self.width)]
        by = np.argsort(length.astype(np.int8), kind="stable")
        ends = np.searchsorted(length[by], np.arange(1, self.width + 2))
        for k in range(self.width):
            own = by[ends[k] : ends[k + 1]]
            columns[k][start[own]] = piece[own]
        return columns

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of pieces as it is; the start and unknown characters never merge."""
        ok = (left < 0) | (right < 0)
        todo = np.flatnonzero(~ok)
        if not len(todo):
            return ok
        key = left[todo].astype(np.int64) * len(self.m.pieces) + right[todo]
        slot = (key * 0x9E3779B97F4A7C1 >> 20) & (len(self.pair_key) - 1)
        new = self.pair_key[slot] != key
        if new.any():
            fresh, back = np.unique(key[new], return_inverse=True)
            pieces, rank = self.m.pieces, self.m.rank
            said = np.array([merges(pieces[a] + pieces[b], rank) == [pieces[a], pieces[b]] for a, b in zip(*(x.tolist() for x in divmod(fresh, len(pieces))))], dtype=bool)
            got = np.empty(len(key), bool)
            got[~new], got[new] = self.pair_ok[slot[~new]], said[back]
            self.pair_key[slot[new]], self.pair_ok[slot[new]] = key[new], said[back]
            # two keys of one slot: both must have been written by the same winner
            lost = self.pair_key[slot[new]] != key[new]
            if lost.any():
                self.pair_key[slot[new][lost]] = -1
        else:
            got = self.pair_ok[slot]
        ok[todo] = got
        return ok

    def _encode_new(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments, concatenated, and how many each has."""
        far = [i for i, s in enumerate(segments) if len(s) > 2 * self.chunk]
        if not far:
            return self._short(segments)
        done: list[np.ndarray] = [np.zeros(0, np.int32)] * len(segments)
        near = sorted(set(range(len(segments))) - set(far))
        if near:
            ids, n = self._short([segments[i] for i in near])
            for i, own in zip(near, np.split(ids, np.cumsum(n)[:-1])):
                done[i] = own
        for i, own in zip(far, self._long([segments[i] for i in far])):
            done[i] = own
        return np.concatenate(done), np.array([len(own) for own in done], dtype=np.int64)

    def _long(self, segments: list[str]) -> Iterator[np.ndarray]:
        """Ids of long segments, one after the other; their chunks are relaxed together, in blocks of a bounded size."""
        parts = ((s, at, s[max(0, at - self.lead) : at + self.chunk]) for s in segments for at in range(0, len(s), self.chunk))
        last = step = None
        while some := list(itertools.islice(parts, max(1, self.block // (self.chunk + self.lead)))):
            _, begin, lens, ends, steps = self._relax([p for _, _, p in some])
            for (s, at, part), b, n in zip(some, begin.tolist(), lens.tolist()):
                if at == 0:
                    last, step = np.full(len(s) + 1, START, np.int32), np.zeros(len(s) + 1, np.int8)
                before = min(at, self.lead)
                if at == 0 or (ends[b + before - self.width + 1 : b + before + 1] == last[at - self.width + 1 : at + 1]).all():
                    last[at + 1 : at + n - before + 1], step[at + 1 : at + n - before + 1] = ends[b + before + 1 : b + n + 1], steps[b + before + 1 : b + n + 1]
                else:
                    self._walk(s, at, at + n - before, last, step)
                if at + n - before == len(s):
                    self.window = (None, 0, 0, [])
                    yield self._back(s, last, step)

    def _walk(self, s: str, at: int, end: int, last: np.ndarray, step: np.ndarray) -> None:
        """Fills last and step of a segment after `at`, up to end, from what they hold before it."""
        o = at - self.width
        if self.window[0] is not s or not self.window[1] <= o <= end <= self.window[2]:  # edges of many chunks at once
            far = min(len(s), o + 128 * self.chunk)
            codes = np.append(self.code[np.frombuffer(s[o:far].encode("utf-32-le", "surrogatepass"), dtype="<u4")], np.uint16(0))
            self.window = (s, o, far, self._edges(codes))
        columns = [c[o - self.window[1] : end - self.window[1]].tolist() for c in self.window[3]]
        ends = last[o : end + 1].tolist()
        pieces, rank, apart = self.m.pieces, self.m.rank, self.apart
        if len(apart) > 1_000_000:
            apart.clear()
        for j in range(self.width + 1, end - o + 1):
            for k in range(self.width, 0, -1):
                piece = columns[k - 1][j - k]
                if piece < 0 and k > 1:
                    continue
                prev = ends[j - k]
                ok = True
                if prev >= 0 and piece >= 0:
                    ok = apart.get((prev, piece))
                    if ok is None:
                        ok = apart[(prev, piece)] = merges(pieces[prev] + pieces[piece], rank) == [pieces[prev], pieces[piece]]
                if ok:
                    ends[j], step[o + j] = piece, k
                    break
            else:
                raise AssertionError("a text has no encoding; the model's merges are inconsistent")
        last[at + 1 : end + 1] = ends[self.width + 1 :]

    def _back(self, s: str, last: np.ndarray, step: np.ndarray) -> np.ndarray:
        """The ids of a segment, from its end to its beginning by the steps."""
        ends, steps, pos, out = last.tolist(), step.tolist(), len(s), []
        while pos:
            out.append(ends[pos] if ends[pos] != UNKNOWN else -ord(s[pos - 1]) - 10)
            pos -= steps[pos]
        token = np.array(out[::-1], dtype=np.int64)
        unknown = token <= -10
        return (self._bytes(token, np.zeros(len(token), np.int64), unknown)[0] if unknown.any() else token).astype(np.int32)

    def _relax(self, segments: list[str]) -> tuple[np.ndarray, ...]:
        """(characters, begins, lengths, last, step) of the segments laid out one after the other: last is the token
        that ends before each position, step its length."""
        lens = np.array([len(s) for s in segments], dtype=np.int64)
        text = "\0".join(segments) + "\0"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        begin = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
        codes = self.code[points].copy()
        codes[begin + lens] = 0
        columns = self._edges(codes)
        last = np.full(len(codes) + 1, START, np.int32)  # by position: the token that ends before it
        step = np.zeros(len(codes) + 1, np.int32)
        order = np.argsort(-lens, kind="stable")
        still, by_len = len(order), -lens[order]
        for t in range(1, int(lens.max()) + 1):
            still = int(np.searchsorted(by_len, -t, side="right"))
            origin = begin[order[:still]]
            end = origin + t
            for k in range(min(t, self.width), 0, -1):
                at = end - k
                piece = columns[k - 1][at]
                fit = piece >= 0 if k > 1 else np.ones(len(at), bool)
                if not fit.any():
                    continue
                own = np.flatnonzero(fit)
                prev = np.where(at[own] == origin[own], START, last[at[own]]) if k < t else np.full(len(own), START, np.int32)
                ok = self._apart(prev, piece[own])
                own = own[ok]
                if len(own):
                    last[end[own]], step[end[own]] = piece[own], k
                    left = np.ones(len(end), bool)
                    left[own] = False
                    end, origin = end[left], origin[left]
                    if not len(end):
                        break
            if len(end):
                raise AssertionError("a text has no encoding; the model's merges are inconsistent")
        return points, begin, lens, last, step

    def _short(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of short segments, concatenated, and how many each has; from the ends back, all together."""
        points, begin, lens, last, step = self._relax(segments)
        pos, rows, out, where = begin + lens, np.arange(len(lens)), [], []
        while len(rows):
            out.append(np.where(last[pos] == UNKNOWN, -points[pos - 1].astype(np.int64) - 10, last[pos]))
            where.append(rows)
            pos = pos - step[pos]
            more = pos > begin[rows]
            rows, pos = rows[more], pos[more]
        token, row = np.concatenate(out), np.concatenate(where)
        turn = np.concatenate([np.full(len(w), -i) for i, w in enumerate(where)])
        by = np.lexsort((turn, row))
        token, row = token[by], row[by]
        unknown = token <= -10
        if unknown.any():
            token, row = self._bytes(token, row, unknown)
        return token.astype(np.int32), np.bincount(row, minlength=len(lens))

    def _bytes(self, token: np.ndarray, row: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters of no piece as their bytes' ids, or as the unknown id in a model without bytes."""
        ids = self.m.byte_ids
        spelt = {int(c): [ids[b] for b in chr(-int(c) - 10).encode("utf-8", "surrogatepass")] if min(ids) >= 0 else [self.m.unk] for c in np.unique(token[unknown])}
        size = np.ones(len(token), np.int64)
        size[unknown] = [len(spelt[int(c)]) for c in token[unknown]]
        out = np.repeat(token, size)
        out[np.repeat(unknown, size)] = [b for c in token[unknown] for b in spelt[int(c)]]
        return out, np.repeat(row, size)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, concatenated, and how many each has; null and empty texts have none."""
        if len(self.seen) > self.keep:
            self._thin()
        seen, known, words, sizes = self.seen, len(self.seen), [], []
        fresh: list[str] = []
        for text in texts:
            if not text:
                sizes.append(0)
                continue
            own = _SEGMENT.findall(MARK + text.replace(" ", MARK))
            sizes.append(len(own))
            for s in own:
                at = seen.get(s)
                if at is None:
                    at = seen[s] = known + len(fresh)
                    fresh.append(s)
                words.append(at)
        flats, counts, start, size = [self.flat], [self.count], 0, 0
        for i, s in enumerate(fresh):  # blocks of a bounded size; a single longer segment is a block of its own
            size += len(s) + 1
            if size >= self.block or i == len(fresh) - 1:
                ids, n = self._encode_new(fresh[start : i + 1])
                flats.append(ids)
                counts.append(n)
                start, size = i + 1, 0
        if fresh:
            self.flat, self.count = np.concatenate(flats), np.concatenate(counts)
            self.begin = np.concatenate([[0], np.cumsum(self.count)[:-1]])
            self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int64)])
        at = np.array(words, dtype=np.int64)
        self.used += np.bincount(at, minlength=len(self.used))
        n = self.count[at]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.begin[at] - upto[:-1], n) + np.arange(upto[-1])]
        edge = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        return ids, np.diff(upto[edge])


_ENCODERS: dict[int, Encoder] = {}


def _encoder(model: Model) -> Encoder:
    """A worker's encoder, kept for its later tasks."""
    name = hash((len(model.pieces), *model.pieces[-50:], *model.rank.values()))
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(model)
    return _ENCODERS[name]


def decode_ids(ids: list[int], model: Model) -> str:
    """The text of ids: pieces joined, runs of byte ids as UTF-8 (bad bytes as U+FFFD), the first mark dropped."""
    try:
        text = "".join([model.decoded[i] for i in ids])
    except TypeError:
        byte = {b: k for k, b in enumerate(model.byte_ids)}
        out = bytearray()
        for i in ids:
            piece = model.decoded[i]
            if piece is not None:
                out += piece.encode("utf-8", "surrogatepass")
            elif i in byte:
                out.append(byte[i])
        text = out.decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, model_path: str, text_col: str = "text", into: str = "token_ids", check: bool = True, keep_text: bool = False) -> DataFrame:
    """docs with into (array of ids), n_tokens and, if asked, round_trip: whether decoding gives the text back;
    without the text, unless it is asked for.

    Null and empty texts have no tokens; a null text's round_trip is true. A text that holds the mark U+2581 itself
    decodes with spaces, so its round_trip is false. Rows that repeat are encoded each, ids may be null or repeat. Very
    long texts are encoded whole, in time that grows with their length; an empty table gives no rows. Columns of docs
    with the names of the new ones, in any case, are replaced; others stay, whatever their names.
    """
    bounded_batches(docs.sparkSession, 2 << 20)
    model = docs.sparkSession.sparkContext.broadcast(Model.load(model_path))  # a vocabulary: below a few MB
    added = [StructField(into, ArrayType(IntegerType(), False)), StructField("n_tokens", LongType())] + [StructField("round_trip", BooleanType())] * check
    new = {f.name.lower() for f in added}
    kept = [f for f in docs.schema if f.name.lower() not in new and (keep_text or f.name.lower() != text_col.lower())]
    rows = docs.select([F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)] + [F.col(text_col).alias("x")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value)
        for batch in batches:
            texts = batch.column("x").to_pylist()
            ids, n = encoder.encode(texts)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            out = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(n.astype(np.int64))]
            if check:
                ends = offsets.tolist()  # lists of ids are made text by text, which bounds their memory
                out.append(pa.array([decode_ids(ids[a:b].tolist(), model.value) == (t or "") for a, b, t in zip(ends[:-1], ends[1:], texts)]))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + out, names=[f.name for f in kept + added])

    return rows.mapInArrow(run, StructType(kept + added))


def decode(rows: DataFrame, model_path: str, ids_col: str = "token_ids", into: str = "text") -> DataFrame:
    """rows with the text of their ids; null ids decode to null, no ids to the empty text; an empty table gives no rows."""
    model = rows.sparkSession.sparkContext.broadcast(Model.load(model_path))
    text = F.pandas_udf(lambda s: s.map(lambda ids: None if ids is None else decode_ids(list(ids), model.value)), StringType())
    return rows.withColumn(into, text(F.col(ids_col)))
