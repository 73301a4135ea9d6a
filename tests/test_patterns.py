"""Patterns find the same in Spark as in DuckDB, in texts of any letters."""

import duckdb
from pyspark.sql import functions as F

from planframe.functions.text import ROUTES, WARNINGS, first_match

TEXTS = [
    "raciónload", "ñeta", "etañ", "équeue", "memoryé cpú", "stage ñ", "stage ٣", "how\ris it going", "how\nis it going", "how long", "how\u0085long", "broKen", "iſſue", "statuſ", "ıssue", "cpu_", "_cpu", "cpu-load", "9cpu",
    "cannot keep\relements joined", "cannot keep\nelements joined", "Miſsing wall family", "", "why did", "what is the dpi", "can’t", "can't",
]


def test_first_match_is_that_of_sql(spark):
    rows = list(enumerate(TEXTS))
    c = duckdb.connect()
    c.execute("CREATE TABLE t (i INT, text VARCHAR)")
    c.executemany("INSERT INTO t VALUES (?, ?)", rows)
    for cases in (ROUTES, WARNINGS):
        sql = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in cases) + " ELSE 'none' END"
        want = dict(c.execute(f"SELECT i, {sql} FROM t").fetchall())
        got = spark.createDataFrame(rows, "i int, text string").select("i", first_match(F.col("text"), cases, "none").alias("n")).collect()
        assert {r.i: r.n for r in got} == want
