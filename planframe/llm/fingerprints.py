"""Document fingerprints by I-Match over randomised lexicons.

The lexicon is the set of terms whose share of documents lies in a band, which is the same at every size. It holds at most
the mean number of distinct terms of a document over the band's lower end. Up to LEXICON terms (16 MB) it is broadcast; a
larger one is joined with the terms of the texts by a shuffle, with the same result. Lexicon k keeps a random
share of it, halved from one set of lexicons to the next, so that for a text of any length some lexicons meet only a term or
two of it. A fingerprint has a hash of the sorted distinct terms of the text in each lexicon.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planframe.llm.common import hot_join, partitions, settle, spread
from planframe.llm.words import Words, chunks

#: How many lexicons keep a share of 1, 1/2, 1/4, ... of the terms.
LEXICONS = (1, 1, 1, 2, 2, 4, 4, 8, 8, 8, 8, 8)

#: Distinct terms that a task holds before it passes their counts on.
HELD = 400_000

#: Most terms of a lexicon that is broadcast; a larger one is joined by a shuffle.
LEXICON = 2_000_000

#: Null ids are the smallest of all.
NULL = -(1 << 63)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df): in how many texts each term, a lower-cased word by its hash, occurs."""

    def run(batches):
        held: list[np.ndarray] = []
        n = 0

        def passed():
            term, df = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(df)], ["term", "df"])

        for batch in batches:
            for _, data, at in chunks(batch.column(0)):
                w = Words(data, at, lower=True)
                for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                    held.append(np.unique(w.hashes[a:b]))
                    n += len(held[-1])
                if n > 8 * HELD:
                    yield passed()
                    held, n = [], 0
        if held:
            yield passed()

    return docs.select(F.col("text").cast("string")).where("text is not null").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, least: float, most: float) -> DataFrame:
    """(term, df) of the terms whose share of documents lies in [least, most]; at least in two documents."""
    n = docs.count()
    low, high = max(2, int(np.ceil(least * n))), max(2, int(most * n))
    return settle(document_frequencies(docs).where(F.col("df").between(low, high)), "terms")


_SHARE = np.repeat(np.arange(len(LEXICONS)), LEXICONS)
_SALTS = spread(np.arange(1, len(_SHARE) + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_BARS = np.uint64((1 << 64) - 1) >> _SHARE.astype(np.uint64)


def _codes(own: np.ndarray, plain: int) -> np.ndarray:
    """A 32-bit hash for each lexicon of the sorted distinct terms in it, 0 where there are none; ``plain`` for a text without any."""
    codes = np.zeros(len(_SALTS), np.uint32)
    drawn = spread(own[None, :] ^ _SALTS[:, None]) <= _BARS[:, None]
    for k in np.flatnonzero(drawn.any(axis=1)).tolist():
        codes[k] = int.from_bytes(hashlib.sha1(own[drawn[k]].tobytes()).digest()[:4], "big") or 1
    if not codes.any():
        codes[:] = plain
    return codes


def _plain(hashes: np.ndarray) -> int:
    """A hash of the text itself, so that equal texts without a term in the lexicon agree."""
    return int.from_bytes(hashlib.sha1(b"text" + hashes.tobytes()).digest()[:4], "big") or 1


def fingerprints(texts: pa.Array, terms: np.ndarray) -> list[np.ndarray]:
    """For each text a 32-bit hash for each lexicon: 0 where none of its terms lies in it."""
    out = []
    for _, data, at in chunks(texts):
        w = Words(data, at, lower=True)
        place = np.searchsorted(terms, w.hashes)
        place[place == len(terms)] = 0
        known = terms[place] == w.hashes if len(terms) else np.zeros(len(w.hashes), bool)
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            out.append(_codes(np.unique(w.hashes[a:b][known[a:b]]), _plain(w.hashes[a:b])))
    return out


def term_sets(texts: pa.Array) -> list[tuple[np.ndarray, int]]:
    """For each text its sorted distinct terms, and the hash of the text itself."""
    out = []
    for _, data, at in chunks(texts):
        w = Words(data, at, lower=True)
        out += [(np.unique(w.hashes[a:b]), _plain(w.hashes[a:b])) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of lexicons with equal hashes among those that either text has terms in."""
    used = (a != 0) | (b != 0)
    return float((a[used] == b[used]).mean()) if used.any() else 1.0


def _text(codes: np.ndarray) -> str:
    return codes.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by as many of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare(docs: DataFrame, least: float = 1e-4, most: float = 0.1, shared: int = LEXICON) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every text.

    Lexicon terms lie in ``least`` to ``most`` of the documents; a lexicon of more than ``shared`` terms is
    joined instead of broadcast. The next document is that of the next smaller doc_id, for the smallest the
    largest; a single document is its own. A null text is empty, a null doc_id the smallest. Rows that repeat
    a doc_id follow each other by their text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = lexicon(docs, least, most)
    dealt, bucket = _in_order(docs)
    if known.count() > shared:
        return _joined(dealt, bucket, known)
    terms = spark.sparkContext.broadcast(np.sort(known.select("term").toArrow()["term"].to_numpy().view(np.uint64)))

    def run(batches):
        for pairs in _followed(batches, bucket, lambda texts: fingerprints(texts, terms.value)):
            texts = [edited(p["text"], p["next_text"]) for p in pairs]
            codes = fingerprints(pa.array(texts, pa.large_string()), terms.value)
            yield _judged(
                [p["doc_id"] for p in pairs],
                [len(p["text"]) for p in pairs],
                [_sha256(t) for t in texts],
                [(p["mark"], c, p["next_mark"]) for p, c in zip(pairs, codes, strict=True)],
            )

    return dealt.mapInArrow(run, RESULT)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _in_order(docs: DataFrame):
    """The rows dealt to ranges of doc_id and in order there, and the function from doc_ids to ranges.

    The first row of a range is also sent, as ``extra``, to the range before, so no order over all rows is made in one place.
    """
    ranges = 4 * partitions(docs.sparkSession)
    ids = docs.select(F.coalesce("doc_id", F.lit(NULL)).alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [float(k) / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    def bucket(values: np.ndarray) -> np.ndarray:
        return np.searchsorted(cuts, values, side="right")

    def firsts(batches):
        best: dict[int, int] = {}
        for batch in batches:
            x = batch.column(0).to_numpy()
            for k in np.unique(b := bucket(x)):
                best[int(k)] = max(best.get(int(k), NULL), int(x[b == k].max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.int64())], ["range", "most"])

    # One row for each range, of which there are few.
    heads = {r[0]: r[1] for r in ids.mapInArrow(firsts, "range int, most long").groupBy("range").agg(F.max("most")).collect()}
    filled = sorted(heads)
    # The head of a range follows the last row of the filled range above it; the topmost follows the lowest.
    goes = {heads[r]: filled[(i + 1) % len(filled)] for i, r in enumerate(filled)}

    def deal(batches):
        for batch in batches:
            x = batch.column(0).fill_null(NULL).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(bucket(x).astype(np.int32)), pa.array(np.zeros(len(x), np.int32)), batch.column(0), batch.column(1)], ["range", "extra", "doc_id", "text"])
            at = [i for i, v in enumerate(x.tolist()) if v in goes]
            if at:
                more = batch.take(pa.array(at))
                to = pa.array([goes[v] for v in x[at].tolist()], pa.int32())
                yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(len(at), np.int32)), *more.columns], ["range", "extra", "doc_id", "text"])

    dealt = docs.mapInArrow(deal, "range int, extra int, doc_id long, text string")
    return dealt.repartition(F.col("range")).sortWithinPartitions("range", "extra", F.desc("doc_id"), "text"), bucket


def _followed(batches, bucket, mark):
    """Rows of ``_in_order`` -> lists of each row with the next one: ids, texts, what ``mark`` makes of the texts, and places.

    A place is the range and the number of the row in it; a row that was sent on stands first in its own range.
    """
    held = None  # the row whose next is awaited
    where, at = None, 0
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        first = 0
        while first < len(rows):
            last, size = first, 0
            while last < len(rows) and (last == first or size < 4_000_000):
                size += len(rows[last][3])
                last += 1
            some, first = rows[first:last], last
            pairs = []
            for (here, extra, doc_id, text), m in zip(some, mark(pa.array([r[3] for r in some], pa.large_string())), strict=True):
                if here != where:
                    where, at, held = here, 0, None
                if extra:
                    own = int(bucket(np.array([NULL if doc_id is None else doc_id]))[0]) << 40
                else:
                    own, at = here << 40 | at, at + 1
                if held is not None:
                    pairs.append(held | {"next_text": text, "next_mark": m, "next_place": own})
                held = None if extra else {"doc_id": doc_id, "text": text, "mark": m, "place": own}
            if pairs:
                yield pairs


def _joined(dealt: DataFrame, bucket, known: DataFrame) -> DataFrame:
    """``compare`` with the terms of all texts joined with the lexicon by a shuffle."""

    def told(batches):
        for pairs in _followed(batches, bucket, term_sets):
            texts = [edited(p["text"], p["next_text"]) for p in pairs]
            more = term_sets(pa.array(texts, pa.large_string()))
            columns = [
                *([p[c] for p in pairs] for c in ("place", "next_place", "doc_id")),
                [len(p["text"]) for p in pairs],
                [_sha256(t) for t in texts],
                [p["mark"][0].view(np.int64) for p in pairs],
                [p["mark"][1] for p in pairs],
                [terms.view(np.int64) for terms, _ in more],
                [plain for _, plain in more],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TOLD, strict=True)], schema=_TOLD)

    rows = settle(dealt.mapInArrow(told, "place long, next_place long, doc_id long, n_chars long, edited_sha256 string, terms array<long>, plain long, edited_terms array<long>, edited_plain long"), "texts")
    own = rows.select("place", F.lit(0).alias("which"), "terms", "plain")
    sets = own.unionByName(rows.select("place", F.lit(1).alias("which"), F.col("edited_terms").alias("terms"), F.col("edited_plain").alias("plain")))
    total = known.agg(F.sum("df")).first()[0] or 0
    found = hot_join(sets.select("place", "which", F.explode("terms").alias("term")), known, ["term"], "df", total)
    found = found.withColumn("plain", F.lit(None).cast("long")).unionByName(sets.select("place", "which", F.lit(None).cast("long").alias("term"), "plain"))
    # A group is the terms of one text.
    found = found.groupBy("place", "which").agg(F.collect_list("term").alias("terms"), F.max("plain").alias("plain"))

    def mark(batches):
        for batch in batches:
            place, which, terms, plain = batch.columns
            codes = [_codes(np.sort(terms[i].values.to_numpy().view(np.uint64)), plain[i].as_py()).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([place, which, pa.array(codes, pa.binary())], ["place", "which", "codes"])

    marks = settle(found.mapInArrow(mark, "place long, which int, codes binary"), "codes")
    facts = rows.select("place", "next_place", "doc_id", "n_chars", "edited_sha256")
    for which, place, name in ((0, "place", "own"), (1, "place", "edit"), (0, "next_place", "next")):
        facts = facts.join(marks.where(F.col("which") == which).select(F.col("place").alias(place), F.col("codes").alias(name)), place)

    def judge(batches):
        for batch in batches:
            doc_id, n_chars, sha, *codes = (c.to_pylist() for c in batch.columns)
            yield _judged(doc_id, n_chars, sha, [tuple(np.frombuffer(c, np.uint32) for c in row) for row in zip(*codes, strict=True)])

    return facts.select("doc_id", "n_chars", "edited_sha256", "own", "edit", "next").mapInArrow(judge, RESULT)


_TOLD = pa.schema(
    [(c, pa.int64()) for c in ("place", "next_place", "doc_id", "n_chars")]
    + [("edited_sha256", pa.string()), ("terms", pa.list_(pa.int64())), ("plain", pa.int64()), ("edited_terms", pa.list_(pa.int64())), ("edited_plain", pa.int64())]
)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _judged(doc_ids: list, n_chars: list[int], digests: list[str], codes: list[tuple]) -> pa.RecordBatch:
    """Result rows; ``codes`` are those of the text, of the edited text and of the next one."""
    columns = {
        "doc_id": pa.array(doc_ids, pa.int64()),
        "n_chars": pa.array(n_chars, pa.int64()),
        "edited_sha256": pa.array(digests, pa.string()),
        "fingerprint": pa.array([_text(c[0]) for c in codes], pa.string()),
        "edited_fingerprint": pa.array([_text(c[1]) for c in codes], pa.string()),
        "near_edited": pa.array([likeness(c[0], c[1]) for c in codes], pa.float64()),
        "near_next": pa.array([likeness(c[0], c[2]) for c in codes], pa.float64()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
