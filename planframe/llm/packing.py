"""Packing of documents into training sequences by patterns and non-negative least squares.

Lengths are at most the sequence length, so their histogram is bounded whatever the corpus, and the plan is
made from it alone. Patterns of a few lengths that fill a sequence are enumerated on a coarse grid; their
repeat counts are fitted to the histogram by non-negative least squares and rounded down; what is left,
and the gaps, are packed by best fit, one step for all pieces of a length and all sequences of a kind.
Executors look up each piece's place by its length and its number among pieces of that length.
"""

import bisect
import re
import zlib
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from planframe.llm.common import numbered, settle

#: Stretches of text between blanks that a worker remembers, up to 900 bytes each (measured, with the tokenizer's own); fewer cost time and change no result.
REMEMBERED = 800_000

#: Bytes of text encoded at once.
PIECE = 500_000


def patterns(cells: int, parts: int, least: int) -> np.ndarray:
    """All multisets of at most ``parts`` cell numbers from ``least`` on that sum to ``cells``, as columns of counts."""
    out: list[list[int]] = []

    def extend(chosen: list[int], left: int, most: int) -> None:
        if left == 0:
            out.append(chosen)
        elif len(chosen) < parts:
            for c in range(min(most, left), least - 1, -1):
                if c * (parts - len(chosen)) < left:
                    break
                extend([*chosen, c], left - c, c)

    extend([], cells, cells)
    matrix = np.zeros((cells, len(out)))
    for j, cs in enumerate(out):
        for c in cs:
            matrix[c - 1, j] += 1
    return matrix


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |a x - b| over x >= 0, by active sets (Lawson and Hanson)."""
    x = np.zeros(a.shape[1])
    passive: list[int] = []
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        passive.append(j)
        while passive:
            z = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[passive] = z
                break
            old = x[passive]
            low = z <= 1e-12
            step = min((old[low] / np.maximum(old[low] - z[low], 1e-300)).min(), 1.0)
            new = old + step * (z - old)
            passive = [p for p, v in zip(passive, new, strict=True) if v > 1e-12]
            x[:] = 0
            for p, v in zip(passive, new[new > 1e-12], strict=True):
                x[p] = v
    return x


def plan(histogram: dict[int, int], length: int, cells: int = 64, parts: int = 3, least: int = 4, part: float = 1.0) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of sequences (lengths in order, how many) that together hold the histogram exactly.

    ``part`` of the fitted repeats is used; the rest of the lengths stay for the gaps.
    """
    left = Counter({k: v for k, v in histogram.items() if v})
    kinds: list[tuple[tuple[int, ...], int]] = []
    if left.get(length):
        kinds.append(((length,), left.pop(length)))
    width = length // cells if length % cells == 0 and length >= cells else 0
    if width and left:
        cell = {k: -(-k // width) for k in left}
        target = np.zeros(cells)
        for k, v in left.items():
            target[cell[k] - 1] += v
        matrix = patterns(cells, parts, least)
        used = target.copy()
        used[: least - 1] = 0
        repeats = np.floor(part * nnls(matrix, used) + 1e-9).astype(np.int64)
        stock = {c: sorted(k for k in left if cell[k] == c) for c in set(cell.values())}
        for j in np.argsort(-repeats, kind="stable"):
            n = int(repeats[j])
            cs = [c + 1 for c in np.flatnonzero(matrix[:, j]) for _ in range(int(matrix[c, j]))][::-1]
            while n > 0:
                chosen: Counter = Counter()
                for i, c in enumerate(cs):
                    have = [k for k in stock.get(c, ()) if left[k] - chosen[k] > 0]
                    if not have:
                        break
                    chosen[have[-1 if i % 2 == 0 else 0]] += 1
                if sum(chosen.values()) < len(cs):
                    break
                times = min(n, *(left[k] // m for k, m in chosen.items()))
                kinds.append((tuple(sorted(chosen.elements(), reverse=True)), times))
                for k, m in chosen.items():
                    left[k] -= times * m
                n -= times
    return _fill(kinds, +left, length)


def _fill(kinds: list[tuple[tuple[int, ...], int]], left: Counter, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs what is left, longest first, into the tightest gaps of the kinds at hand, and into new sequences."""
    by_room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def add(kind: tuple[int, ...], n: int) -> None:
        room = length - sum(kind)
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append([kind, n])

    for kind, n in kinds:
        add(kind, n)
    for k in sorted(left, reverse=True):
        n = left[k]
        while n > 0:
            at = bisect.bisect_left(rooms, k)
            if at == len(rooms):
                per = length // k
                full, rest = divmod(n, per)
                if full:
                    add((k,) * per, full)
                if rest:
                    add((k,) * rest, 1)
                break
            room = rooms[at]
            kind, have = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            fit = min(room // k, -(-n // have)) if n > have else 1
            times = min(have, n // fit)
            add(kind + (k,) * fit, times)
            if have > times:
                add(kind, have - times)
            n -= times * fit
    return [(tuple(kind), n) for groups in by_room.values() for kind, n in groups]


#: Cells, parts, least cell and part of the fitted repeats of the plans that best_plan compares. The fit is by cells, so
#: fewer repeats leave more lengths to close its gaps; without any, all lengths go by best fit, which no plan may exceed.
TRIED = ((256, 2, 8, 1.0), (256, 2, 8, 0.8), (64, 3, 4, 0.8), (64, 3, 4, 0.5), (64, 4, 8, 0.3), (256, 2, 64, 0.5), (256, 2, 64, 0.2), (64, 3, 4, 0.1), (64, 3, 4, 0.0))


def best_plan(histogram: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """The shortest of the plans in TRIED; the first that needs no more than the total length asks for is taken."""
    bound = -(-sum(k * n for k, n in histogram.items()) // length)
    best: list[tuple[tuple[int, ...], int]] = []
    for cells, parts, least, part in TRIED:
        kinds = plan(histogram, length, cells, parts, least, part)
        if not best or sum(n for _, n in kinds) < sum(n for _, n in best):
            best = kinds
        if sum(n for _, n in best) <= bound:
            break
    return best


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: A full stop or comma that ends a word.
_STOP, _COMMA = re.compile(rb"(?<=[a-z0-9])\.(?=\s)"), re.compile(rb"(?<=[a-z0-9]),(?=\s)")


class Numbered(dict):
    """Numbers keys from 0 as they are first asked for; ``new`` lists those since it was last emptied."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


class StretchEncoder:
    """Encodes whole texts by the tokenizer's ids of their distinct stretches between blanks.

    Only for tokenizers that drop white space and never join characters across it.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.tokenizer, self.remembered = _tokenizer(path), remembered
        added = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.special = added[0] if added else (None, -1)
        self.taken = [t.encode() for t, _ in added]
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.lowers = ids("AB") == ids("ab") and ids("Ab.") == ids("ab .") and ids("A1,") == ids("a1 ,")
        self.forget()

    def forget(self) -> None:
        self.known = Numbered()
        self.ids, self.end, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _stretches(self, text: bytes) -> list[bytes]:
        """The stretches between blanks; where the tokenizer sees no difference, A-Z lower-cased and full stops and commas parted from words."""
        if self.lowers:
            low = text.lower()
            if not any(t in low for t in self.taken):
                return _COMMA.sub(b" ,", _STOP.sub(b" .", low)).split()
        return text.split()

    def _encode(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokenizer's ids of stretches side by side, and how many each has.

        One call encodes them all with a special token between, which the tokenizer takes out of the text
        before it does anything else; stretches that hold that token are encoded by themselves.
        """
        between, mark = self.special
        if between is None or any(between in x for x in stretches):
            ids = [e.ids for e in self.tokenizer.encode_batch(stretches, add_special_tokens=False)]
            return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)
        ids = np.array(self.tokenizer.encode(between.join(stretches), add_special_tokens=False).ids, np.uint32)
        cuts = np.flatnonzero(ids == mark)
        count = np.diff(np.r_[-1, cuts, len(ids)]) - 1
        return np.delete(ids, cuts), count

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin, with the end."""
        if len(self.known) > self.remembered:
            self.forget()
        parts = [self._stretches(t.encode()) for t in texts]
        flat = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        new, self.known.new = self.known.new, []
        if new:
            made = [self._encode([x.decode() for x in new[lo : lo + 500]]) for lo in range(0, len(new), 500)]
            self.ids = np.concatenate([self.ids, *(m[0] for m in made)])
            self.count = np.concatenate([self.count, *(m[1] for m in made)])
        self.end = np.cumsum(self.count)
        n = self.count[flat]
        made = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=made[1:])
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=first[1:])
        return self.ids[np.arange(made[-1]) + np.repeat(self.end[flat] - made[1:], n)], made[first]


@lru_cache(2)
def _encoder(path: str, remembered: int) -> StretchEncoder:
    return StretchEncoder(path, remembered)


def tokenized(docs: DataFrame, path: str, end: int, length: int, with_ids: bool, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of ``docs(doc_id, text)``; only longer documents are cut."""

    def run(batches):
        encoder = _encoder(path, remembered)
        for batch in batches:
            lo, texts = 0, batch.column(1).to_pylist()
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < PIECE):
                    size += len(texts[hi] or "")
                    hi += 1
                ids, at = encoder([t or "" for t in texts[lo:hi]])
                rows, piece, start, count, crc, out = [], [], [], [], [], []
                for r in range(hi - lo):
                    doc = np.append(ids[at[r] : at[r + 1]], np.uint32(end)).astype("<u4")
                    for s in range(0, len(doc), length):
                        part = doc[s : s + length]
                        rows.append(lo + r)
                        piece.append(s // length)
                        start.append(s)
                        count.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            out.append(part.astype(np.int32))
                columns = [batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(count, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(out, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                lo = hi

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def place(pieces: DataFrame, length: int) -> DataFrame:
    """``pieces`` (settled, with ``doc_id``, ``piece`` and ``length``) with ``sequence_id`` and ``offset``."""
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``length`` rows
    kinds = best_plan(histogram, length) if histogram else []
    slots: list[tuple[int, int, int, int]] = []
    used: Counter = Counter()
    sequence = 0
    for kind, n in kinds:
        offset = 0
        for k in kind:
            slots.append((k, used[k], sequence, offset))
            used[k] += n
            offset += k
        sequence += n
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 4)
    share = pieces.sparkSession.sparkContext.broadcast((table[:, 0] << 40 | table[:, 1], table))

    def run(batches):
        key, rows = share.value
        for batch in batches:
            k = batch.column(batch.schema.get_field_index("length")).to_numpy()
            n = batch.column(batch.schema.get_field_index("_number")).to_numpy()
            at = np.searchsorted(key, k << 40 | n, side="right") - 1
            names = [x for x in batch.schema.names if x != "_number"]
            columns = [batch.column(batch.schema.get_field_index(x)) for x in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows[at, 2] + n - rows[at, 1]), pa.array(rows[at, 3])], [*names, "sequence_id", "offset"])

    total = sum(histogram.values())
    n = numbered(pieces, ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], max(1, min(100_000, total // 2_000 + 1)), "_number")
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return n.select(*pieces.columns, "_number").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end: int = 1, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every document.

    A document is its text's ids and then ``end``; a null or empty text is ``end`` alone. A document over
    ``length`` is cut into pieces of ``length``, the last may be shorter; each piece lies in one sequence,
    and pieces of a sequence follow each other from offset 0 without gaps. Rows that repeat a doc_id are
    documents of their own. An empty table gives no rows. With ``with_ids`` the pieces carry their ids.
    ``remembered`` trades a worker's memory for time.
    """
    return place(settle(tokenized(docs, tokenizer, end, length, with_ids, remembered), "pieces"), length)
