"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

Each table rotates a vector by sign flips and Hadamard transforms; its home bucket is the nearest signed axis
and its probe buckets the next ones. Members of a bucket are compared exactly, in double precision, in
blocks, and each pair is counted in the first bucket that holds both, so a task gives a row per member:
how many it links with there, and a spanning link. Equal vectors are one class with a weight.

Rotations are as many as keep a bucket's expected size below ROOM, so they grow with the logarithm of the
largest label; tables are as many as a simulation of pairs at the cosine asked for needs to meet all but MISS.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planframe.llm.common import block_components, hot_join, runs, settle
from planframe.llm.components import components
from planframe.llm.minhash import _deal, _gather

#: Members of a block; a bucket of up to two blocks is one group.
BLOCK = 1024

#: Expected members of a bucket of evenly spread vectors, at most.
ROOM = 4096

#: Share of the pairs at the cosine asked for that may share no bucket.
MISS = 1e-6


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=-1).reshape(-1, n)
        h *= 2
    return x


def polytope_codes(x: np.ndarray, tables: int, probes: int, rotations: int) -> np.ndarray:
    """(rows, tables, codes): the home code first and then the probes, of unit vectors."""
    n, d = x.shape
    width = 1 << max(1, (max(d, probes) - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    rng = np.random.default_rng(width)
    out = []
    for _ in range(tables):
        near = []
        for _ in range(rotations):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
                y /= np.sqrt(width)
            order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes]
            near.append(2 * order + (np.take_along_axis(y, order, axis=1) < 0))
        base = 2 * width
        codes = [sum(near[r][:, 0] * base**r for r in range(rotations))]
        for r in range(rotations):
            codes += [codes[0] + (near[r][:, p] - near[r][:, 0]) * base**r for p in range(1, near[r].shape[1])]
        out.append(np.stack(codes, axis=1))
    return np.stack(out, axis=1).astype(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, also where their squares leave the range of a double."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    wide = ((norm < 1e-140) | (norm > 1e140))[:, 0]
    if wide.any():
        x = x.copy()
        x[wide] /= np.abs(x[wide]).max(axis=1, keepdims=True)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / norm


def rotations_for(count: int, dims: int, probes: int) -> int:
    """Rotations that keep the buckets of ``count`` evenly spread vectors at ROOM members or fewer."""
    width = 1 << max(1, (max(dims, probes) - 1).bit_length())
    k = 1
    while count * (1 + k * (probes - 1)) > ROOM * (2 * width) ** k:
        k += 1
    return k


@lru_cache
def tables_for(cosine: float, dims: int, probes: int, rotations: int, pairs: int = 2000, tried: int = 8) -> int:
    """Tables that let all but MISS of the pairs at ``cosine`` share a bucket, from simulated pairs."""
    if dims < 2 or cosine >= 1:
        return 1
    rng = np.random.default_rng(dims)
    x, y = rng.normal(size=(2, pairs, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y *= np.sqrt(1 - cosine**2) / np.linalg.norm(y, axis=1, keepdims=True)
    a, b = (polytope_codes(v, tried, probes, rotations) for v in (x, cosine * x + y))
    apart = 1 - (a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3)).mean()
    return int(np.ceil(np.log(MISS) / np.log(np.clip(apart, 1 / (pairs * tried), 0.95))))


def _valid(v: str, label: str) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(label).isNotNull() & F.col(v).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _first(a: np.ndarray, b: np.ndarray, table: int) -> np.ndarray:
    """For pairs of code rows (pairs, tables, codes): the least code that they share in ``table``, -1 if in none or in an earlier one."""
    out = np.full(len(a), -1, np.int64)
    for lo in range(0, len(a), 20_000):
        same = (a[lo : lo + 20_000, : table + 1, :, None] == b[lo : lo + 20_000, : table + 1, None, :]).any(axis=3)
        here = same[:, table].any(axis=1) & ~same[:, :table].any(axis=(1, 2))
        least = np.where(same[:, table], a[lo : lo + 20_000, table], np.iinfo(np.int64).max).min(axis=1)
        out[lo : lo + 20_000] = np.where(here, least, -1)
    return out


def counted_links(x, codes, weight, own, table, bucket, ba, bb, cosine):
    """(member, links, first member) of the members that link in this group, each pair counted in the first bucket that holds it."""
    alike = np.triu(x @ x.T >= cosine, 1)
    i, j = np.nonzero(alike)
    if len(i) and ba != bb:
        two = own[i] != own[j]
        i, j = i[two], j[two]
    elif len(i):
        same = (own[i] == ba) & (own[j] == ba)
        i, j = i[same], j[same]
    if not len(i):
        return None
    here = _first(codes[i], codes[j], table) == bucket
    i, j = i[here], j[here]
    if not len(i):
        return None
    links = np.zeros(len(x), np.int64)
    np.add.at(links, i, weight[j])
    np.add.at(links, j, weight[i])
    linked = np.zeros((len(x), len(x)), bool)
    linked[i, j] = linked[j, i] = True
    at = np.flatnonzero(links)
    return at, links[at], block_components(linked)[at]


def near_vectors(vectors: DataFrame, cosine: float = 0.93, probes: int = 3, rotations: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors(vec_id, embedding, label)``.

    Vectors link only with others of an equal label, and only those with a cosine of ``cosine`` or more, in
    double precision. A null or zero vector, one with a null or non-finite component, and one with a null
    label link with nothing; vectors of different lengths do not link. Equal vectors always link. A row with
    a null vec_id links with nothing and has a null component. Rows that repeat a vec_id count each, and
    are one node of the components. An empty table gives no rows. ``rotations`` None: ``rotations_for``
    the largest label.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), F.col("label").cast("long").alias("label"))
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    rows = rows.withColumn("good", _valid("embedding", "label") & F.col("vec_id").isNotNull())
    rows = rows.withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(1), "embedding")})
    key = ["label", "k1", "k2"]
    good = rows.where("good")
    size = F.size("embedding")
    classes = settle(good.groupBy(*key).agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"), F.min(size).alias("size")), "classes")
    labels = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("low"), F.max("size").alias("high"), F.sum("weight").alias("weight"))
    most, low, high, total = labels.agg(F.max("n"), F.min("low"), F.max("high"), F.sum("weight")).first()
    low, high = low or 1, high or 1
    rotations = rotations or rotations_for(most or 0, high, probes)
    tables = max(tables_for(cosine, d, probes, rotations) for d in {low, high})
    dtype, width = (np.float32, "float") if kind == "float" else (np.float64, "double")

    def hashed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(batch.schema.get_field_index("embedding"))
            size = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)
            start = np.cumsum(size) - size
            for d in np.unique(size):
                for lo in range(0, int((size == d).sum()), 2000):
                    at = np.flatnonzero(size == d)[lo : lo + 2000]
                    v = flat[start[at][:, None] + np.arange(d)]
                    x = v.astype(np.float64)
                    codes = polytope_codes(unit(x), tables, probes, rotations)
                    n, per = len(at), codes.shape[1] * codes.shape[2]
                    where = codes + (np.arange(tables) << 48)[None, :, None] + (np.int64(d % 4096) << 53)
                    take = pa.array(at)
                    lists_of = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * per).astype(np.int32)), pa.array(where.ravel()))
                    told = [batch.column(k).take(take) for k in range(5)]
                    yield pa.RecordBatch.from_arrays([*told, lists_of, pa.array([r.tobytes() for r in v], pa.binary())], ["vec_id", *key, "weight", "codes", "vector"])

    reps = good.join(classes.drop("size"), ["vec_id", *key]).dropDuplicates(["vec_id", *key])
    reps = reps.select("vec_id", *key, "weight", F.col("embedding").cast(f"array<{width}>").alias("embedding"))
    reps = reps.mapInArrow(hashed, "vec_id long, label long, k1 long, k2 long, weight long, codes array<long>, vector binary")
    reps = settle(reps.withColumn("id", F.monotonically_increasing_id()), "codes")
    places = reps.select("id", F.posexplode("codes").alias("slot", "code"), "label").withColumn("place", F.xxhash64("label", "code"))
    full = settle(places.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("_n", F.col("n")), "buckets")
    members = hot_join(places.drop("label"), full, ["place"], "_n", full.agg(F.sum("n")).first()[0] or 0)
    members = members.join(reps.select("id", "vec_id", "label", "weight", "codes", "vector"), "id")
    per = 1 + rotations * (probes - 1)

    def run(batches):
        out = []
        for t in runs(batches, 3):
            if len(t) < 2:
                continue
            ids, label = t["id"].to_numpy(), t["label"].to_numpy()
            codes = t["codes"].combine_chunks().flatten().to_numpy().reshape(len(t), tables, per)
            slot, code = int(t["slot"][0].as_py()) // per, int(t["code"][0].as_py())
            vectors_of = [np.frombuffer(v, dtype) for v in t["vector"].to_pylist()]
            same = (label == label[0]) & (np.array([len(v) for v in vectors_of]) == len(vectors_of[0]))
            at = np.flatnonzero(same)
            if len(at) < 2:
                continue
            x = unit(np.stack([vectors_of[k] for k in at]).astype(np.float64))
            got = counted_links(x, codes[at], t["weight"].to_numpy()[at], t["_own"].to_numpy()[at], slot, code, int(t["ba"][0].as_py()), int(t["bb"][0].as_py()), cosine)
            if got:
                who, links, least = got
                name = t["vec_id"].to_numpy()[at]
                out.append((ids[at][who], links, name[who], name[least]))
            if len(out) > 2000:
                yield _linked(out)
                out = []
        if out:
            yield _linked(out)

    dealt = _gather(_deal(members, "n", BLOCK), "place").select("place", "ba", "bb", "id", "vec_id", "label", "weight", "codes", "vector", "slot", "code", "_own")
    found = settle(dealt.mapInArrow(run, "id long, links long, u long, v long"), "links")
    direct = found.groupBy("id").agg(F.sum("links").alias("links"))
    # Rows of one vec_id are one node: it links the classes of its vectors.
    several = good.groupBy("vec_id").agg(F.min(F.struct(*key)).alias("a"), F.max(F.struct(*key)).alias("b")).where("a <> b").select("vec_id")
    edges = good.select("vec_id", *key).join(several, "vec_id").join(classes.select(*key, F.col("vec_id").alias("v")), key).select(F.col("vec_id").alias("u"), "v")
    group = components(found.select("u", "v").unionByName(edges)).select(F.col("id").alias("vec_id"), "component")
    judged = reps.select("id", "vec_id", *key, "weight").join(direct, "id", "left").join(group, "vec_id", "left")
    judged = judged.select(*key, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.col("weight").alias("_n"))
    out = hot_join(good.select("vec_id", *key), judged, key, "_n", total or 0).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("not good").select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id")))
    out = out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    return out.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _linked(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(4)], ["id", "links", "u", "v"])
