"""A log of positional edits: each patch names an element by its place in the list as the patches before it left it."""

from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fields that no edit may change.
BLOCKED = ("id", "level", "top_level")


class Places:
    """Which element stands at a place of a list of ``n`` that loses some: the places that are gone, in order, tell."""

    def __init__(self, n: int):
        self.n, self.gone = n, []

    def at(self, place: int) -> int | None:
        """The first place of the element now at ``place``, or None beyond either end."""
        if not 0 <= place < self.n - len(self.gone):
            return None
        lo, hi = 0, len(self.gone)  # the k-th gone place has gone[k] - k standing ones before it
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.gone[mid] - mid <= place else (lo, mid)
        return place + lo

    def drop(self, first: int) -> None:
        insort(self.gone, first)


def resolved(patches: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, patch_ord, place): where the element of each patch stood before all patches; null where it was out of range then.

    ``patches(keys, patch_ord, ord, is_delete)`` has one row a patch and ``sizes(keys, n)`` the lengths of the lists.
    A list's patches stream in order past its places that are gone, which is all that a task holds.
    """
    rows = patches.join(sizes, keys, "left").select(*keys, "patch_ord", "ord", F.coalesce("is_delete", F.lit(False)).alias("is_delete"), F.coalesce("n", F.lit(0)).alias("n"))
    width = len(keys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, places = None, None
        for part in parts:
            out = []
            for row in part.itertuples(index=False, name=None):
                key, (patch, at, is_delete, n) = row[:width], row[width:]
                if key != last:
                    last, places = key, Places(n)
                first = None if at is None or at != at else places.at(int(at))
                if first is not None and is_delete:
                    places.drop(first)
                out.append((*key, patch, first))
            yield pd.DataFrame(out, columns=[*keys, "patch_ord", "place"]).astype({"place": "Int64"})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "patch_ord")
    return dealt.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*keys, "patch_ord"]) + ", place long")


def _numbered(elements: DataFrame, keys: list[str]) -> DataFrame:
    return elements.withColumn("place", (F.row_number().over(Window.partitionBy(*keys).orderBy("ord")) - 1).cast("long"))


def _each(patches: DataFrame, keys: list[str]) -> DataFrame:
    """One row a patch; its rows, one a field, share place and kind."""
    return patches.groupBy(*keys, "patch_ord").agg(F.first("ord").alias("ord"), F.bool_or(F.coalesce("is_delete", F.lit(False))).alias("is_delete"))


def judged(elements: DataFrame, patches: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """``patches(job_id, patch_ord, element_type, ord, field, value, is_delete)`` with ``error`` (null where applied) and ``place``.

    A patch is refused whole, in this order: unknown_type, unknown_field (not among the type's ``fields``),
    blocked_field, no_element (nothing at that place of ``elements(job_id, element_type, ord)`` at that moment).
    A delete names no field. Refused patches change nothing, so later places do not count them.
    """
    keys = ["job_id", "element_type"]
    named = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]).cast("array<string>"))])
    allowed = F.try_element_at(named, F.col("element_type"))
    edit = ~F.coalesce("is_delete", F.lit(False))
    unknown, blocked = edit & ~F.coalesce(F.array_contains(allowed, F.col("field")), F.lit(False)), edit & F.col("field").isin(*BLOCKED)
    each = patches.groupBy(*keys, "patch_ord").agg(F.bool_or(allowed.isNull()).alias("_t"), F.bool_or(unknown).alias("_u"), F.bool_or(F.coalesce(blocked, F.lit(False))).alias("_b"))
    each = each.select(*keys, "patch_ord", F.when(F.col("_t"), "unknown_type").when(F.col("_u"), "unknown_field").when(F.col("_b"), "blocked_field").alias("_schema"))
    rows = patches.join(each, [*keys, "patch_ord"])
    sizes = elements.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    places = resolved(_each(rows.where("_schema is null"), keys), sizes, keys)
    out = rows.join(places, [*keys, "patch_ord"], "left")
    return out.withColumn("error", F.coalesce("_schema", F.when(F.col("place").isNull(), "no_element"))).drop("_schema")


def replayed(elements: DataFrame, patches: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``elements(keys, ord, fields)`` that stand after ``patches(keys, patch_ord, place, field, value, is_delete)``, with ``new_ord``.

    The last value of each field of an element holds, null values change nothing, and what is deleted is gone;
    the others close up.
    """
    live = patches.where("place is not null")
    gone = F.bool_or(F.coalesce("is_delete", F.lit(False))).alias("_gone")
    last = [F.max_by("value", F.when((F.col("field") == f) & ~F.coalesce("is_delete", F.lit(False)) & F.col("value").isNotNull(), F.col("patch_ord"))).alias(f"_{f}") for f in fields]
    folded = live.groupBy(*keys, "place").agg(gone, *last)
    rows = _numbered(elements, keys).join(folded, [*keys, "place"], "left").where(~F.coalesce("_gone", F.lit(False)))
    rows = rows.select(*keys, "ord", *[F.coalesce(f"_{f}", f).alias(f) for f in fields])
    return _numbered(rows, keys).withColumnRenamed("place", "new_ord")


def apply_patches(elements: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """``elements(job_id, ord, fields...)`` after ``patches(job_id, patch_ord, ord, field, value, is_delete)``, one list a job.

    ``ord`` of a patch counts from 0 in the list as it then stands. A field outside ``fields`` or a place that is
    not there is passed over.
    """
    known = patches.where(F.coalesce("is_delete", F.lit(False)) | F.col("field").isin(fields))
    sizes = elements.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    places = resolved(_each(known, ["job_id"]), sizes, ["job_id"])
    return replayed(elements, known.join(places, ["job_id", "patch_ord"]), ["job_id"], fields)
