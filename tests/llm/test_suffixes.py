"""Repeated strings removed: against a dictionary of all strings, over odd texts and a whole table."""

import hashlib
import random

import numpy as np
import pytest

from quarrylode.llm import suffixes
from quarrylode.llm.entry import QUERIES

NULL = 1 << 63


def plain(rows, h):
    """doc_id, bytes, removed runs and what is left, by the least id of every string of h bytes."""
    least: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - h + 1):
            w = b[p : p + h]
            least[w] = min(least.get(w, NULL), NULL if i is None else i)
    out = []
    for i, t in rows:
        b, seen = (t or "").encode(), set()
        gone = bytearray(len(b))
        for p in range(len(b) - h + 1):
            w = b[p : p + h]
            if w in seen or least[w] < (NULL if i is None else i):
                gone[p : p + h] = b"\1" * h
            seen.add(w)
        edge = np.flatnonzero(np.diff(np.r_[0, np.frombuffer(bytes(gone), np.uint8), 0].astype(int)))
        out.append((i, len(b), [(s, e - s) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist())], bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def made_of_parts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde fgh") for _ in range(rng.randint(50, 900))) for _ in range(25)]
    rows = []
    for i in range(120):
        t = ""
        for _ in range(rng.randint(0, 4)):
            x = rng.choice(base)
            s = rng.randrange(len(x))
            t += x[s : s + rng.randint(1, 400)] + "".join(rng.choice("xyz") for _ in range(rng.choice([0, rng.randint(1, 150)])))
        rows.append((rng.choice([i, i, i, 7, None]), t))
    odd = ["a" * 1000, "a" * 300, "ab" * 300, "ab" * 301 + "c", "\0" * 150, "x\0" + "\0" * 120, base[0] * 3, base[0], None, "", "é" * 99, "日本" * 60, "日本" * 61]
    return rows + [(200 + k, t) for k, t in enumerate(odd)] + [(201, odd[1]), (206, odd[6])]


@pytest.mark.parametrize(("h", "batch"), [(100, 3000), (64, 20_000), (100, 1 << 20)])
def test_equals_a_dictionary_of_all_strings(spark, h, batch):
    rows = made_of_parts(h + batch)
    docs = spark.createDataFrame([(i, t, 0, None) for i, t in rows], "id long, body string, kept int, spans string").repartition(3)
    got = suffixes.remove_repeats(docs, "id", "body", min_bytes=h, batch_bytes=batch, bucket_bytes=5000).collect()
    assert sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got), key=repr) == plain(rows, h)


def test_empty_table_and_short_strings(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0
    assert [tuple(r) for r in suffixes.remove_repeats(docs).collect()] == [(1, 1, [], bytearray(b"x"))]
    with pytest.raises(ValueError):
        suffixes.remove_repeats(docs, min_bytes=10)


def test_every_window_is_in_one_block_and_equal_windows_have_equal_owners(monkeypatch):
    monkeypatch.setattr(suffixes, "STEP", 700)
    rng = random.Random(2)
    part = bytes(rng.choice(b"abcd") for _ in range(400))
    texts = [bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(1, 900))) + part[rng.randint(0, 100) :] for _ in range(20)] + [b"a" * 500, b"", b"ab" * 90]
    data, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
    start, n, gram, digest = suffixes.blocks(np.frombuffer(data, np.uint8), ends, 100, 24)
    windows = [p for s, k in zip(start.tolist(), n.tolist()) for p in range(s, s + k)]
    begins = [0, *ends.tolist()]
    assert windows == [p for s, e in zip(begins, begins[1:]) for p in range(s, e - 99)]
    owner: dict[bytes, int] = {}
    for s, k, g in zip(start.tolist(), n.tolist(), gram.tolist()):
        for p in range(s, s + k):
            assert owner.setdefault(data[p : p + 100], g) == g
    content: dict[tuple, bytes] = {}
    for s, k, g, d in zip(start.tolist(), n.tolist(), gram.tolist(), digest.tolist()):
        assert content.setdefault((g, d), data[s : s + k + 99]) == data[s : s + k + 99]


def test_op12_over_the_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op12_suffixes"](spark, sf_dir).collect())
    assert got == sorted((i, n, sum(k for _, k in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in plain(rows, 100))
    assert sum(r[2] for r in got) > 1000


def test_rows_are_ordered_as_by_their_columns_and_looked_at_no_further_than_they_are_equal(monkeypatch):
    rng = np.random.default_rng(12)
    for _ in range(200):
        rows = rng.integers(0, 3, (rng.integers(0, 40), rng.integers(1, 5))).astype(np.uint64) << np.uint64(62)
        assert np.array_equal(rows[suffixes._order([*rows.T])], rows[np.lexsort(rows.T[::-1])])
    sorted_, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: sorted_.append(len(x)) or argsort(x, *a, **k))
    rows = np.stack([np.r_[np.arange(1000), 5], np.arange(1001), np.arange(1001)], axis=1).astype(np.uint64)
    order, _ = suffixes._sorted_groups(rows)
    assert order.tolist() == [*range(6), 1000, *range(6, 1000)] and sorted_ == [1001, 2, 2]
