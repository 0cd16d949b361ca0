"""Packing: capacity, wholeness, fill, and the curve."""

import random

import numpy as np
from pyspark.sql import functions as F

from ashlar.llm import curve, packing
from ashlar.llm.encoding import encode
from ashlar.llm.packing import _Packer

SCHEMA = "doc_id long, text string, row string, container_id string, n_tokens int, curve long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "r", "c", 0, 1) for i, t in enumerate(texts)], SCHEMA)


def checked(docs, capacity, **how):
    rows = packing.pack(docs, capacity, **how).collect()
    sizes = {r["doc_id"]: len(r["ids"]) for r in encode(docs).collect()}
    held, pieces = {}, {}
    for r in rows:
        if r["container_id"] is not None:
            held[r["container_id"]] = held.get(r["container_id"], 0) + r["n_tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], r["pieces"]))
    assert max(held.values(), default=0) <= capacity
    assert pieces.keys() == sizes.keys()
    for doc, parts in pieces.items():
        parts.sort()
        assert sum(n for _, n, _ in parts) == sizes[doc]
        assert len(parts) == max(1, -(-sizes[doc] // capacity)) == parts[0][2]
        assert all(a + n == b for (a, n, _), (b, *_) in zip(parts, parts[1:]))
        assert (len(parts) > 1) == (sizes[doc] > capacity)
    return rows, sizes, held


def test_random_documents(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "code", "edge", "node"]
    texts = [" ".join(rng.choices(words, k=int(rng.paretovariate(0.9) * 5) % 400)) for _ in range(700)] + [None, "", " ", "x"]
    _, sizes, held = checked(documents(spark, texts).repartition(3), 100)
    least = -(-sum(sizes.values()) // 100)
    assert len(held) <= least * 1.03 + 4


def test_copies_and_exact_fits(spark):
    texts = ["one two three four"] * 500 + ["one two three four five six seven eight"] * 3
    _, sizes, held = checked(documents(spark, texts), 8)
    assert len(held) == -(-sum(sizes.values()) // 8)


def test_very_long_document(spark):
    rows, sizes, _ = checked(documents(spark, ["word " * 30_000, "a"]), 2048)
    assert max(r["pieces"] for r in rows) == -(-sizes[0] // 2048)


def test_nothing_to_pack(spark):
    assert packing.pack(documents(spark, [])).isEmpty()
    rows, _, held = checked(documents(spark, [None, ""]), 2048)
    assert not held and all(r["container_id"] is None and r["n_tokens"] == 0 for r in rows)
    assert packing.fill(packing.pack(documents(spark, [None]))).first()["containers"] == 0


def test_divided_documents_are_those_above_the_capacity(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = {r["doc_id"] for r in packing.pack(docs).filter((F.col("pieces") > 1) & (F.col("piece") == 0)).collect()}
    assert found == {r["doc_id"] for r in encode(docs).filter(F.size("ids") > 2048).collect()}


def test_open_containers_are_bounded():
    p = _Packer(10, 0)
    for start in range(0, 10_000, 100):
        p.window([(6, i, i) for i in range(start, start + 100)])
        assert len(p.open) <= packing.OPEN


def test_curve_visits_neighbours():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        h = curve.hilbert(cells, bits)
        assert sorted(h) == list(range(len(cells)))
        assert np.abs(np.diff(cells[np.argsort(h)], axis=0)).sum(1).max() == 1


def test_neighbours_are_alike(spark):
    """Documents of one vocabulary lie together on the curve more than chance has it."""
    rng = random.Random(6)
    groups = [[f"{g}w{i}" for i in range(30)] for g in "abcd"]
    texts = [(g, " ".join(rng.choices(groups[g], k=60))) for g in rng.choices(range(4), k=400)]
    rows = packing.pack(documents(spark, [t for _, t in texts]), 2048, window=8).collect()
    by = {}
    for r in rows:
        by.setdefault(r["container_id"], []).append(texts[r["doc_id"]][0])
    pure = sum(max(map(g.count, set(g))) for g in by.values()) / len(texts)
    assert pure > 0.6
