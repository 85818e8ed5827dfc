"""Vector codes against a comparison with every entry in Python integers."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import hadamard

SCHEMA = "vec_id LONG, embedding ARRAY<DOUBLE>, label INT, code STRING, digest INT"


def brute(rows, n_parts=16, n_entries=64, rounds=2):
    kept = [(i, [max(-hadamard.LIMIT, min(hadamard.LIMIT, math.floor(256 * x))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=1) // n_parts) or 1
    kept = [(i, v + [0] * (n_parts * width - len(v)), label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))

    def cut(v):
        return [v[p * width:(p + 1) * width] for p in range(n_parts)]

    books = [[cut(v)[p] for _, v, _ in kept[:n_entries]] for p in range(n_parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(n_parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            for e, parts in groups.items():
                books[p][e] = [sum(c) // len(parts) for c in zip(*parts, strict=True)]
    out, by_label = [], {}
    for i, v, label in kept:
        found = [near(part, books[p]) for p, part in enumerate(cut(v))]
        error = min(sum(d for d, _ in found), hadamard.LONGEST)
        by_label[label] = min(by_label.get(label, 0) + error, hadamard.LONGEST)
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, label))
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return [(i, code, error, by_label[label], label) for i, code, error, label in out], hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows, **sizes):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    coded, books = hadamard.encoded(frame, **sizes)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error, r.label) for r in coded.collect()), key=repr)
    want, digest = brute(rows, **sizes)
    assert got == sorted(want, key=repr)
    assert hadamard.digest(books) == digest


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=32).round(3).tolist(), i % 3 or None) for i in range(150)]
    rows += [(None, rows[0][1], 1), (5, rows[5][1], 2), (5, rows[6][1], 2), (200, None, 1), (201, [0.1, None] * 16, 1), (202, [math.nan] * 32, 1),
             (203, [math.inf] + [0.0] * 31, 1), (204, [], 9), (205, [1.5] * 7, None), (206, [0.0] * 32, 9), (207, [-0.001] * 32, 9)]
    check(spark, rows)


def test_more_entries_than_rows_and_parts_of_odd_width(spark):
    rng = np.random.default_rng(2)
    check(spark, [(i, rng.normal(size=10).tolist(), 1) for i in range(9)], n_parts=2, n_entries=64, rounds=3)
    check(spark, [(i, [0.25] * 6, None) for i in range(40)], n_parts=2, n_entries=4)


def test_huge_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=32) * 10.0 ** rng.integers(0, 9)).tolist(), i % 2) for i in range(80)]
    check(spark, rows, n_entries=8)
    check(spark, [*rows, (90, [1e300] * 32, 1), (91, [-1e300] * 32, 1)], n_entries=8)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1)]])
def test_nothing_to_code(spark, rows):
    check(spark, rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(0, 2**32), st.sampled_from([3, 100, 1 << 40]))
def test_nearest_by_early_elimination(width, seed, spread):
    rng = np.random.default_rng(seed)
    parts, entries = (rng.integers(-spread, spread, (n, width)) for n in (40, 13))
    which, distance = hadamard.nearest(parts, entries)
    full = ((parts.astype(object)[:, None] - entries.astype(object)[None]) ** 2).sum(axis=2)
    assert distance.tolist() == full.min(axis=1).tolist()
    assert which.tolist() == [row.index(min(row)) for row in full.tolist()]


def test_sequency_order_and_scale():
    size = 8
    matrix = hadamard.transform(np.eye(size, dtype=np.int64)).T
    changes = (matrix[:, 1:] != matrix[:, :-1]).sum(axis=1)
    assert changes.tolist() == list(range(size))
    assert (matrix @ matrix.T == size * np.eye(size)).all()
