"""Runs of words and tokens aligned: against plain versions over odd texts and whole tables."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

from quarrylode.llm import alignment, periodic
from quarrylode.llm.entry import QUERIES

ODD = [None, "", "   ", " x", "x ", "a  b\tc\n\n d <s> <|endoftext|> é 😀  ", "a b ́c ﬁ Ⅷ é", "a\x1c b\x1d c", "don't we'll  've 123 456,7", "▁ x▁y ▁", "\x00 a", "日本語 テキスト 한국어 　 z", "<0x41> <unk> </s>", "la " * 500, "w" * 5000]


def plain_runs(w, least=6, times=4):
    """Stretches of equal words p apart, for every p; those of a smaller period are left out."""
    out = []
    for p in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            if j > i and size >= max(least, times * p) and not any(w[i : i + size - q] == w[i + q : i + size] for q in range(1, p)):
                out.append((i, size, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words_with_repeats_planted_among_them():
    rng = random.Random(7)
    found = 0
    for _ in range(3000):
        n, letters = rng.randint(0, 120), rng.choice([1, 2, 3, 5, 20])
        w = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 8 else 0):
            s, p = rng.randrange(n), rng.randint(1, 9)
            for i in range(s + p, min(n, s + p * rng.randint(2, 9) + rng.randint(0, 3))):
                w[i] = w[i - p]
        assert periodic.runs(w) == plain_runs(w)
        found += len(plain_runs(w))
    assert found > 1000


def test_the_automaton_alone_finds_the_runs_and_the_stretches_lose_none():
    rng = random.Random(8)
    for _ in range(500):
        w = [rng.randrange(rng.choice([2, 3])) for _ in range(rng.randint(6, 90))]
        assert sorted((s, e - s + 1, p) for (s, p), e in periodic.squares(w).items()) == sorted(plain_runs(w))


def test_find_runs_of_odd_texts_and_clashing_columns(spark):
    texts = [*ODD, "a b a b a b a b c", "x " * 5 + "y", "x " * 6 + "y"]
    docs = spark.createDataFrame([(i % 16, t, 1, "r") for i, t in enumerate(texts)], "id long, body string, runs int, collapsed string")
    got = sorted(map(tuple, periodic.find_runs(docs, "id", "body").collect()), key=repr)
    want = []
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        runs = plain_runs(w)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        want.append((i % 16, runs, b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    assert [(i, list(map(tuple, r)), c) for i, r, c in got] == sorted(want, key=repr)
    assert periodic.find_runs(docs.limit(0), "id", "body").count() == 0


def test_op11_over_the_whole_table(spark, sf_dir):
    got = {r.doc_id: r for r in QUERIES["op11_periodic"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    planted = 0
    for doc_id, text in rows:
        w, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            planted += 1
        runs = periodic.runs(w) if n > 1500 else plain_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {k for s, m, p in runs for k in range(s + p, s + m)}
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
    assert planted > 10


def plain_alignment(rows):
    a = alignment.Bytes(Path(alignment.TOKENIZERS, "byte_bpe_50k.json").read_bytes())
    b = alignment.Pieces(Path(alignment.TOKENIZERS, "piece_bpe_32k.model").read_bytes())
    linked, docs = Counter(), []
    for doc_id, text in rows:
        sides = []
        for model, ids in ((a, a.model.encode(" " + (text or ""), add_special_tokens=False).ids), (b, b.model.encode(text or ""))):
            end, side = 0, {}
            for i in ids:
                end += len(model.bytes[i])
                side[end] = i
            sides.append(side if b"".join(model.bytes[i] for i in ids) == (" " + (text or "")).encode() else None)
        if not text or None in sides:
            docs.append((doc_id, 0, 0, 0, "", []))
            continue
        groups, links, start = [], [], 0
        for end in sorted(sides[0].keys() & sides[1].keys()):
            groups.append("|".join(",".join(str(i) for e, i in sorted(side.items()) if start < e <= end) for side in sides) if len(sides[0]) < 4000 else None)
            links.append((sides[0][end], sides[1][end]))
            start = end
        linked.update(links)
        docs.append((doc_id, len(sides[0]), len(sides[1]), len(groups), ";".join(groups) if None not in groups else None, links))
    top = Counter()
    for (_, j), n in linked.items():
        top[j] = max(top[j], n)
    return [(i, n_a, n_b, n, text, len(links), sum(linked[x] == top[x[1]] for x in links), sum(linked[x] for x in links)) for i, n_a, n_b, n, text, links in docs]


def test_alignment_of_odd_texts_in_many_batches(spark, sf_dir):
    rows = [(i % 12, t) for i, t in enumerate(ODD)] + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) < 1500").collect()]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc long, text string, n_a int").repartition(3)
    got = sorted(map(tuple, alignment.align(docs, "doc", batch_bytes=20_000).collect()))
    assert got == sorted(plain_alignment(rows))
    assert alignment.align(docs.limit(0), "doc").count() == 0


def test_components_are_the_stretches_between_common_ends():
    rng = random.Random(3)
    import numpy as np

    for _ in range(300):
        n = rng.randint(1, 60)
        a, b = (np.array(sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n})) for _ in range(2))
        common = sorted({*a.tolist()} & {*b.tolist()})
        owner = [min(c for c in common if c >= e) for e in [*a.tolist(), *b.tolist()]]
        assert a[alignment.components(a, b)].tolist() == owner


def test_op13_over_the_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op13_alignment"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for i, n_a, n_b, n, text, n_links, n_best, total in plain_alignment(rows):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == (n_a, n_b, n, n_links, n_best, total)
        if text is not None:
            assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if text else "")
