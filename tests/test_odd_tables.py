"""Queries against their SQL on small tables of odd values that the driver's smallest tables lack."""

import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedup as D
from tidemark.plans import queries as timeline
from tidemark.plans.selection_queries import vectors


def compared(spark, folder, name, **tables):
    """The query's rows and its SQL's, sorted, over tables written below ``folder``."""
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    plain = lambda v: tuple(v) if isinstance(v, list) else v
    df = timeline.queries()[name](spark, str(folder))
    r = con.sql(timeline.oracle_sql()[name])
    at = [r.columns.index(c) for c in df.columns]
    return sorted(tuple(plain(v) for v in x) for x in df.collect()), sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())


def embeddings(rows, labels=None, ids=None):
    n = len(rows)
    return pa.table({"vec_id": pa.array(ids if ids is not None else range(n), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array(labels if labels is not None else [0] * n, pa.int32())})


@pytest.fixture(scope="module")
def edges_of_numbers():
    """Floats whose product with 200 is whole as a float, yet less as a double."""
    x = (np.arange(1, 256) / 200).astype(np.float32)
    x = x[np.floor(x.astype(float) * 200) != np.floor(x * np.float32(200))]
    assert len(x)
    return embeddings([np.resize(np.roll(x, k), 64).tolist() for k in range(10)])


def test_edges_of_numbers(spark, tmp_path, edges_of_numbers):
    got, wanted = compared(spark, tmp_path, "edge_map", embeddings=edges_of_numbers)
    assert got == wanted


def test_masks_on_edges_of_numbers(spark, tmp_path, edges_of_numbers):
    got, wanted = compared(spark, tmp_path, "masked_pictures", embeddings=edges_of_numbers)
    assert got == wanted


def test_masks_on_other_sizes(spark, tmp_path):
    """No embedding; fewer and more than 64 numbers; a number missing: 64 pixels each, null where there is no number."""
    x = [i / 100 for i in range(70)]
    rows = [None, [], x[:40], x[:64], x, x[:36] + [None] + x[37:64]]
    tables = [embeddings([v] * 5, ids=range(10 * k, 10 * k + 5)) for k, v in enumerate(rows)]
    got, wanted = compared(spark, tmp_path, "masked_pictures", embeddings=pa.concat_tables(tables))
    assert got == wanted and {len(v[1]) for v in got} == {64}


def odd_vectors(n=150):
    """Vectors whose mean differences lie around 24, on it too; nulls, missing, short and long ones, missing ids and labels."""
    rng = np.random.default_rng(5)
    rows = [(rng.integers(0, 72, 64) / 200 + 0.001).tolist() for _ in range(n)]
    rows[:6] = [None, [], [None] * 64, rows[3][:40], rows[4] + [9.0], [None, *rows[5][1:]]]
    rows[6:8] = [[0.001] * 64, [24 / 200 + 0.001] * 64]
    rows[8:10] = [[0.001] * 64, [24 / 200 + 0.001] * 63 + [25 / 200 + 0.001]]
    rows[10] = [None if i % 2 else x for i, x in enumerate(rows[10])]
    rows[11] = [x if i % 2 else None for i, x in enumerate(rows[10])]
    ids = list(range(n, 0, -1))
    ids[22] = None
    return embeddings(rows, [None if i == 30 else i % 2 for i in range(n)], ids)


def test_pairs_of_odd_vectors(spark, tmp_path):
    got, wanted = compared(spark, tmp_path, "near_dup_pairs", embeddings=odd_vectors())
    assert got == wanted and 0 < len(got) < 150 * 149 / 4


def test_pairs_do_not_depend_on_blocks(spark, tmp_path):
    _, wanted = compared(spark, tmp_path, "near_dup_pairs", embeddings=odd_vectors())
    v = vectors(spark, str(tmp_path)).select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), "q")
    for kind in ("array<int>", "array<long>", "array<double>"):
        r = D.close_pairs(v.withColumn("q", F.col("q").cast(kind)), ["grp"], "q", 64, 24, block=16)
        assert sorted(tuple(x) for x in r.collect()) == wanted
    ties = D.close_pairs(v.withColumn("pos", F.floor(F.col("pos") / 2)), ["grp"], "q", 64, 24, block=16)
    assert sorted(tuple(x) for x in ties.collect()) == [x for x in wanted if x[1] // 2 < x[2] // 2]


def test_pairs_of_a_large_label_in_time(spark, tmp_path):
    """4.5 million pairs of one label; the nested loop over arrays took minutes in one task."""
    n = 3000
    x = (np.random.default_rng(6).integers(0, 60, (n, 64)) / 200).astype(np.float32)
    pq.write_table(embeddings(x.tolist()), f"{tmp_path}/embeddings.parquet")
    began = time.perf_counter()
    got = timeline.queries()["near_dup_pairs"](spark, str(tmp_path)).agg(F.count("*"), F.sum("a"), F.sum("b")).first()
    assert time.perf_counter() - began < 60
    q = np.floor(x * np.float32(200)).astype(np.int32)
    a, b = (np.concatenate(z) for z in zip(*[(np.full(len(f), i), f) for i in range(n) for f in [i + 1 + np.flatnonzero(np.abs(q[i + 1 :] - q[i]).sum(1) <= 24 * 64)]]))
    assert tuple(got) == (len(a), a.sum(), b.sum())


def events(rows):
    """Rows of (user, seconds, kind, value)."""
    user, t, kind, value = zip(*rows)
    at = pa.array([1704067200000000 + round(x * 1e6) for x in t], pa.timestamp("us"))
    return pa.table({"event_id": pa.array(range(len(rows)), pa.int64()), "ts": at, "user_id": pa.array(user, pa.int64()), "event_type": pa.array(kind), "value": pa.array(value, pa.float64()), "props": pa.array(["{}"] * len(rows))})


def test_health_of_intervals_without_length(spark, tmp_path):
    """One empty interval among others; nothing but empty ones; many words a minute; one that starts long after the end."""
    kinds = ["view", "click", "error"]
    rows = [(1, 1000.0 * i, kinds[i % 3], 0.0 if i == 4 else 2.0) for i in range(9)]
    rows += [(2, 500.0 * i, kinds[i % 2], 0.0) for i in range(4)]
    rows += [(3, 0.5 * i, "view", 0.0005) for i in range(20)]
    rows += [(4, 10.0, "view", 1.0), (4, 2592100.0, "click", 1.0)]
    got, wanted = compared(spark, tmp_path, "transcript_health", events=events(rows))
    assert got == wanted
