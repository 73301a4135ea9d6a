"""Byte-level BPE by a pair occurrence index, and its decoding.

A task encodes the distinct pre-tokens of its rows together: all their symbols lie in one list, an index
maps the rank of each adjacent pair to all its positions, and active ranks are applied in ascending order;
each merge updates the lists of the pairs that it makes. Pre-tokens do not touch each other, and a merge
only makes pairs of higher rank, so every pre-token ends as it would by itself.
"""

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stretches of text between spaces that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 600_000

#: Characters of text whose pre-tokens are merged together, and characters encoded at once.
LEARNED, PIECE = 24_000_000, 2_000_000

#: A space before another white-space character or the end: there, a space need not start a pre-token.
_LOOSE = re.compile(r" (?=\s)| $")

_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


class PairIndexBPE:
    """Encodes and decodes with a ``tokenizers`` JSON file of kind byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.size = max(vocab.values()) + 1
        self.byte_id = np.array([vocab[x] for x in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        keys = np.array([a << 32 | b for a, b, _ in self.pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        byte = {x: i for i, x in enumerate(letters)}
        self.token = {i: bytes(byte[x] for x in t) for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = np.array([len(self.token.get(i, b"")) for i in range(self.size + len(self.special))], np.int64)
        self.token_end = np.cumsum(size)
        self.token_size = size
        self.token_bytes = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(len(size))), np.uint8)
        names = [b"%d," % i for i in range(len(size))]
        self.name_size = np.array([len(x) for x in names], np.int64)
        self.name_end = np.cumsum(self.name_size)
        self.name_bytes = np.frombuffer(b"".join(names), np.uint8)
        self.forget()

    def forget(self) -> None:
        """Starts the memory anew: stretches' codes, and their ids in one array."""
        self.known: tuple[dict[str, int], dict[str, int]] = {}, {}
        self.ids, self.end, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.order[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words side by side, and how many each has."""
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        symbol = self.byte_id[data]
        after = np.arange(1, len(data) + 1)
        after[ends - 1] = -1
        before = np.arange(-1, len(data) - 1)
        before[np.r_[0, ends[:-1]]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self._ranks(symbol[at], symbol[after[at]])
            has = rank >= 0
            if not has.any():
                return
            at, rank = at[has], rank[has]
            if len(at) < 12:
                for r, p in zip(rank.tolist(), at.tolist(), strict=True):
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        heapq.heappush(active, r)
                return
            o = np.argsort(rank, kind="stable")
            at, rank = at[o], rank[o]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(at)]
            for r, lo, hi in zip(rank[bounds[:-1]].tolist(), bounds[:-1], bounds[1:], strict=True):
                if r in index:
                    index[r].append(at[lo:hi])
                else:
                    index[r] = [at[lo:hi]]
                    heapq.heappush(active, r)

        add(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            a, b, made = self.pairs[rank]
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 and isinstance(lists[0], np.ndarray) else np.unique(np.hstack(lists))
            at = at[symbol[at] == a]
            gone = after[at]
            good = (gone >= 0) & (symbol[gone] == b)
            at, gone = at[good], gone[good]
            if not len(at):
                continue
            if a == b:  # overlapping pairs merge from the left
                at = np.sort(at)
                chosen, last = [], -1
                for p, q in zip(at.tolist(), after[at].tolist(), strict=True):
                    if p != last:
                        chosen.append(p)
                        last = q
                at = np.array(chosen)
                gone = after[at]
            nxt = after[gone]
            symbol[at], symbol[gone] = made, -1
            after[at] = nxt
            has = nxt >= 0
            right = at[has]
            before[nxt[has]] = right
            left = before[at]
            left = left[left >= 0]
            add(np.unique(np.concatenate([left, right])))
        alive = np.flatnonzero(symbol >= 0)
        return symbol[alive], np.diff(np.r_[0, np.searchsorted(alive, ends)])

    def learn(self, stretches: set[str], spaced: bool) -> None:
        """Remembers stretches of text, each with a space before it if ``spaced``."""
        known = self.known[spaced]
        new = [x for x in stretches if x not in known]
        if not new:
            return
        blob = " " + " ".join(new)
        if spaced and not any(x in blob for x in self.special):
            # A space starts each stretch and is nowhere else, so one pass parts them all.
            tokens = _SPLIT.findall(blob)
            first = np.flatnonzero([t[0] == " " for t in tokens])
            parts = np.diff(np.r_[first, len(tokens)])
        else:
            split = [self.split(" " + x if spaced else x) for x in new]
            tokens = [t for s in split for t in s]
            parts = np.array([len(s) for s in split], np.int64)
        words = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
        ids, count = [], []
        listed = list(words)
        for lo in range(0, len(listed), 400_000):
            some = listed[lo : lo + 400_000]
            one, n = self.merge([b"" if w in self.special else w.encode() for w in some])
            ids.append(one)
            count.append(n)
        ids, count = np.concatenate([*ids, np.array(list(self.special.values()), np.int32)]), np.concatenate(count)
        end = np.cumsum(count)
        for k, (text, _) in enumerate(self.special.items()):
            if text in words:
                count[words[text]] = 1
                end[words[text]] = len(ids) - len(self.special) + k + 1
        flat = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
        made, at = gather(ids, end, count, flat)
        known.update(zip(new, range(len(self.count), len(self.count) + len(new)), strict=True))
        self.ids = np.concatenate([self.ids, made])
        self.count = np.concatenate([self.count, np.diff(at[np.r_[0, np.cumsum(parts)]])])
        self.end = np.cumsum(self.count)

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text; a special token is one by itself."""
        if not any(x in text for x in self.special):
            return _SPLIT.findall(text)
        out = []
        for part in self.parts.split(text):
            out += [part] if part in self.special else _SPLIT.findall(part)
        return out

    def learn_all(self, texts: list[str]) -> None:
        """Remembers the stretches of many texts; the more at once, the more pre-tokens share each merge."""
        if sum(map(len, self.known)) > REMEMBERED:
            self.forget()
        heads, rest = set(), set()
        for t in texts:
            if _LOOSE.search(t):
                heads.add(t)
            else:
                parts = t.split(" ")
                heads.add(parts[0])
                rest.update(parts[1:])
        self.learn(heads, False)
        self.learn(rest, True)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (with the end); learn_all comes first.

        A space before a character that is not white space starts a pre-token, so a text whose spaces are
        all such is parted there; any other is one stretch.
        """
        parts = [[t] if _LOOSE.search(t) else t.split(" ") for t in texts]
        head, rest = self.known[0].__getitem__, self.known[1].__getitem__
        codes = [[head(p[0]), *map(rest, p[1:])] for p in parts]
        flat = np.fromiter((c for s in codes for c in s), np.int64, sum(map(len, codes)))
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(s) for s in codes], out=first[1:])
        ids, made = gather(self.ids, self.end, self.count, flat)
        return ids, made[first]

    def listed(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The ids of each text as decimals with commas between."""
        data, made = gather(self.name_bytes, self.name_end, self.name_size, ids.astype(np.int64))
        data, cut = data.tobytes(), made[at].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of ids; ``at``: where each text's begin, with the end."""
        data, made = gather(self.token_bytes, self.token_end, self.token_size, ids.astype(np.int64))
        data, cut = data.tobytes(), made[at].tolist()
        return [data[a:b].decode("utf-8", errors="replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]


def gather(values: np.ndarray, end: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` (each up to its ``end``, ``size`` long) side by side, and where each begins, with the end."""
    n = size[which]
    made = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=made[1:])
    return values[np.arange(made[-1]) + np.repeat(end[which] - made[1:], n)], made


@lru_cache(2)
def tokenizer(path: str) -> PairIndexBPE:
    """One tokenizer for each worker process and file."""
    return PairIndexBPE(path)


def _learned(batches, bpe: PairIndexBPE):
    """(ids, texts) of rows of record batches (id, text) in lists of about PIECE characters, known to the tokenizer; a null is empty.

    Batches are gathered up to LEARNED characters, so that many pre-tokens share each merge.
    """
    held, size = [], 0

    def passed():
        ids = pa.concat_arrays([b.column(0) for b in held])
        texts = ["" if t is None else t for b in held for t in b.column(1).to_pylist()]
        bpe.learn_all(texts)
        for a, b in _cuts(texts, PIECE):
            yield ids.slice(a, b - a), texts[a:b]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(1).nbytes
        if size >= LEARNED:
            yield from passed()
            held, size = [], 0
    if held:
        yield from passed()


def _cuts(texts: list[str], size: int):
    lo, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= size:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of ``docs(doc_id, text)``: the ids of every whole text; a null or empty text has none."""

    def run(batches):
        bpe = tokenizer(path)
        for doc_ids, texts in _learned(batches, bpe):
            ids, at = bpe.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([doc_ids, lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of ``encoded(doc_id, ids)``."""

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            ids = [x or [] for x in batch.column(1).to_pylist()]
            at = np.cumsum([0, *map(len, ids)])
            texts = bpe.decode(np.array([i for x in ids for i in x], np.int64), at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes every whole text, decodes the ids, and hashes both.

    A null text is an empty one; a text of any length is encoded whole; rows stay as they are.
    """

    def run(batches):
        bpe = tokenizer(path)
        sha = hashlib.sha256
        for doc_ids, texts in _learned(batches, bpe):
            ids, at = bpe.encode(texts)
            ids_sha = [sha(x).hexdigest() for x in bpe.listed(ids, at)]
            text_sha = [sha(t.encode()).hexdigest() for t in bpe.decode(ids, at)]
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(np.diff(at)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
