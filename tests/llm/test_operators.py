"""Each operator against a plain version on small tables, and on odd ones: nulls in any column,
empty and very long texts, ties and repeated rows, empty tables, further columns of clashing names."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrylode.llm import ann, common, decontamination, html_text, lm_score, mixing, pii, sharding, simhash, toxicity, url_filter
from quarrylode.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, bucket int, k string"
LONG = "word " * 30_000 + "x" * 20_000 + " 1" * 3000
TEXTS = [(1, "A b c d e"), (2, "a B c d e"), (3, None), (4, ""), (5, LONG), (5, LONG), (None, "null id a@b.co"), (7, "one"), (8, " \t\n "), (9, "é ü ß 漢字 \U0001f600 x@y.zz")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, None if i == 1 else "s", None, "q", "z", 1, "k") for i, t in TEXTS], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def some(spark, sf_dir):
    return common.table(spark, sf_dir, "documents").limit(120).cache()


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


# Sharding


def test_shards_follow_weights_and_move_only_to_the_new_one(spark):
    keys = spark.range(20_000).withColumn("doc_id", F.col("id"))
    rows = sharding.assign_shards(keys, "doc_id", [1.0, 1.0, 2.0], [1.0, 1.0, 2.0, 1.0]).collect()
    n = Counter(r["shard"] for r in rows)
    assert abs(n[2] - 10_000) < 400 and abs(n[0] - 5000) < 300
    assert all(r["grown_shard"] in (r["shard"], 3) for r in rows)
    for s in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n[s]))


def test_rows_of_one_key_are_numbered_in_pieces(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").alias("n"))
    got = sharding.assign_shards(rows, "doc_id", [1.0] * 2, order=("n",), piece_rows=50).collect()
    assert len({r["shard"] for r in got}) == 1 and sorted(r["slot"] for r in got) == list(range(3000))


def test_sharding_of_odd_rows(docs, nothing):
    rows = sharding.assign_shards(docs, "doc_id", [1.0] * 8).collect()
    assert len(rows) == len(TEXTS) and len({(r["shard"], r["slot"]) for r in rows}) == len(TEXTS)
    assert rows[0].asDict().keys() == {*docs.columns, "slot"}
    assert sharding.assign_shards(nothing, "doc_id", [1.0] * 8).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(docs, "doc_id", [1.0, 0.0])


# Mixing


def filled(sizes, weights, total, most=2.0):
    """Water filling by hand: share by weight, cut at the room, share the rest again."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while open_:
        rest = total - sum(target[s] for s in sizes if s not in open_)
        level = rest / sum(weights[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] < level * weights[s]}
        for s in full or open_:
            target[s] = most * sizes[s] if full else level * weights[s]
        open_ = open_ - full if full else set()
    return target


def test_mix_meets_targets_to_the_word(some):
    mix = mixing.Mix(some, block=16)
    rows, facts = mix.takes().collect(), {r["key"]: r for r in mix.sources.collect()}
    text, sizes = texts_of(some), Counter()
    for r in rows:
        assert r["size"] == len(re.findall(common.WORD, text[r["doc_id"]])) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["key"]] += r["size"]
    order = sorted(sizes)
    target = filled(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    for s in order:
        assert math.isclose(facts[s]["target"], target[s], rel_tol=1e-9)
        assert abs(sum(r["taken"] for r in rows if r["key"] == s) - target[s]) <= 1
    assert sorted(rows) == sorted(mixing.Mix(some, block=16).takes().collect())
    slots = mix.slots(4).collect()
    assert {r["out_shard"] for r in slots} == {0, 1, 2, 3} and all(0 < r["words"] <= 16 for r in slots)


def test_output_shards_draw_multinomial_counts_given_the_totals(spark):
    docs = spark.createDataFrame([(k, "w " * 50, "ab"[k % 2]) for k in range(4000)], "doc_id long, text string, source string")
    mix = mixing.Mix(docs, block=16)
    counts, slots = Counter(), Counter()
    for r in mix.draws(8).collect():
        counts[r["key"], r["out_shard"]] = r["n"]
        slots[r["key"]] += r["n"]
    assert {k: r for k, r in slots.items()} == {r["key"]: r["count"] for r in mix.slots(8).groupBy("key").count().collect()}
    for key, total in slots.items():
        chi = sum((counts[key, s] - total / 8) ** 2 / (total / 8) for s in range(8))
        assert 0.5 < chi < 26  # 7 degrees of freedom: neither even shares nor far from them


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_permutations_are_permutations(spark, n):
    size = F.lit(n)
    rows = spark.range(n).select("id", mixing.permuted(F.col("id"), size, F.lit("k")).alias("p")).select("id", "p", mixing.permuted(F.col("p"), size, F.lit("k"), inverse=True).alias("b")).collect()
    assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["b"] == r["id"] for r in rows)


def test_mix_of_odd_rows(docs, nothing):
    rows = mixing.Mix(docs).takes().collect()
    assert len(rows) == len(TEXTS) and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 4
    assert mixing.Mix(nothing).takes().count() == 0 and mixing.mix_documents(nothing).count() == 0


# Near-duplicates


def plain_fingerprint(text):
    words = re.findall(common.WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(values, near):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_fingerprints_and_components(some):
    text = texts_of(some)
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(some).collect()}
    fps = {k: plain_fingerprint(t) for k, t in text.items()}
    assert all(rows[k]["fp"] % (1 << 64) == fp for k, fp in fps.items())
    root = plain_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert {k: r["component_id"] for k, r in rows.items()} == root
    kept = [r["text"] for r in simhash.one_of_each(some).collect()]
    assert set(kept) <= set(text.values()) and len({t.lower() for t in kept}) == len(kept)


def test_near_copies_are_found_and_others_left(spark, some):
    base = [w for t in texts_of(some).values() for w in t.split() if w.isalpha()][:3000]
    rng, rows = np.random.default_rng(3), []
    for g in range(12):
        text = base[g * 200 : g * 200 + 200]
        rows.append((1000 * g, " ".join(text)))
        for c in range(1, 5):
            copy = list(text)
            for _ in range(c if c < 4 else 60):
                copy[rng.integers(200)] = f"new{rng.integers(10**6)}"
            rows.append((1000 * g + c, " ".join(copy)))
    line = "the same line stands here again and again " * 6
    rows += [(90_000, line + "but one ends this way with words of its own"), (90_001, line + "whereas another closes quite unlike it in all respects")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.alike_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingles = {k: {" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    near = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    wanted = plain_components(sorted(shingles), near)
    assert sum(got[k] != wanted[k] for k in got) <= 1
    assert all(got[k] == k for k in (4, 1004, 2004, 90_000, 90_001))


def shared_shingles(t):
    ws = t.lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def test_near_copies_of_one_decisive_line_are_not_merged(spark):
    line = "one odd line of seven plain words "
    rows = [(k, line * 60 + " ".join(f"own{k}x{i}" for i in range(40))) for k in range(4)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.alike_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k for k in range(4)}


def test_near_copies_are_looked_for_by_fingerprints_first(spark, monkeypatch):
    words = [f"w{i * i % 997}" for i in range(400)]
    base = " ".join(words)
    changed = [" ".join(words[:i] + ["new"] + words[i + 1 :]) for i in range(400)]
    bits = [(simhash.fingerprint(base) ^ simhash.fingerprint(c)).bit_count() for c in changed]
    close = [c for c, d in zip(changed, bits) if 0 < d <= 2][:2] + [base + " " + base]  # the last one has another set of shingles
    assert len(close) == 3
    line = "one line of seven words said again"
    rows = list(enumerate([base, *close, *[" ".join([line] * 60 + [f"u{k}{i}" for i in range(40)]) for k in range(2)]]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r["doc_id"]: r["component_id"] for r in simhash.alike_groups(docs).collect()}
    monkeypatch.setattr(simhash, "similar_links", lambda classes, texts, known: known)
    first = {r["doc_id"]: r["component_id"] for r in simhash.alike_groups(docs).collect()}
    assert [first[i] for i in (0, 1, 2, 4, 5)] == [0, 0, 0, 4, 5] and whole == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5}


def test_near_copies_at_the_edge_are_all_found(spark):
    rng, rows = np.random.default_rng(11), []
    for g in range(150):
        text = [f"w{rng.integers(10**7)}" for _ in range(104)]
        copy = list(text)
        for i in rng.choice(100, 2, replace=False) + 2:
            copy[i] = f"n{rng.integers(10**7)}"
        rows += [(2 * g, " ".join(text)), (2 * g + 1, " ".join(copy))]
    sets = {k: shared_shingles(t) for k, t in rows}
    wanted = plain_components(sorted(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    assert sum(wanted[2 * g + 1] == 2 * g for g in range(150)) > 100
    assert {r["doc_id"]: r["component_id"] for r in simhash.alike_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == wanted


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_near_copies_in_crowded_cells_are_all_found(spark, monkeypatch, rounds):
    monkeypatch.setattr(simhash, "CROWD", 3)
    monkeypatch.setattr(simhash, "BLOCK", 5)
    monkeypatch.setattr(simhash, "ROUNDS", rounds)
    rng, rows = np.random.default_rng(12), []
    base = [f"w{i}" for i in range(120)]
    for g in range(6):
        text = [*base[:80], *[f"g{g}x{i}" for i in range(40)]]
        for c in range(8):
            rows.append((8 * g + c, " ".join(text)))
            text = list(text)
            for i in rng.choice(120, 2, replace=False):
                text[i] = f"n{rng.integers(10**7)}"
    sets = {k: shared_shingles(t) for k, t in rows}
    wanted = plain_components(sorted(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    assert 6 <= len(set(wanted.values())) < 48
    assert {r["doc_id"]: r["component_id"] for r in simhash.alike_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == wanted


def test_a_family_of_near_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    rng, rows = np.random.default_rng(21), []
    for k in range(240):
        text = [f"w{i}" for i in range(150)]
        for i in rng.choice(150, rng.integers(0, 9), replace=False):
            text[i] = f"n{rng.integers(10**7)}"
        rows.append((k, " ".join(text)))
    sets = {k: shared_shingles(t) for k, t in rows}
    wanted = plain_components(sorted(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    assert 20 < len(set(wanted.values())) < 220
    monkeypatch.setattr(simhash, "ROUNDS", 0)
    compared, verified = [], simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda links, *more: compared.append(links.count()) or verified(links, *more))
    assert {r["doc_id"]: r["component_id"] for r in simhash.alike_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == wanted
    assert compared[-1] < 240 * 5  # of 28,680 pairs


def test_differences_from_a_centre_are_ordered_by_rarity():
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3, 4], [1, 2, 3, 5], [1, 2, 4, 5], [1, 2, 3, 4, 9])]
    known, often = simhash.centre(sets)
    assert known.tolist() == [1, 2, 3, 4, 5] and often.tolist() == [-1, -1, -2, -2, 2]
    assert simhash.differences(np.array([2, 5, 7], np.uint64), known, often).tolist() == [1, 7, 3, 4, 5]
    assert simhash.differences(sets[0], known, often).tolist() == []


def test_sets_are_never_on_disk_for_all_links_at_once(spark, monkeypatch):
    texts = {k: " ".join(f"w{k // 3}x{i}" for i in range(30 + (0, 4, 10)[k % 3])) + " end" * (k % 2) for k in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    classes = common.written(simhash.shingled(docs, "doc_id", "text"))
    ids = {r["doc_id"]: r["id"] for r in classes.collect()}
    links = {tuple(sorted((ids[a], ids[b]))) for a in range(60) for b in range(a) if a // 3 == b // 3}
    sets = {ids[k]: set(simhash.shingle_set(t).tolist()) for k, t in texts.items()}
    true = {(a, b) for a, b in links if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    held, of = [], simhash._sets
    monkeypatch.setattr(simhash, "_sets", lambda ids, texts: held.append(ids.count()) or of(ids, texts))
    monkeypatch.setattr(simhash, "LEAST", 1, raising=False)
    monkeypatch.setattr(simhash, "SHARE", 0.8, raising=False)
    got = simhash.verified(spark.createDataFrame(list(links), "a long, b long"), classes, docs.select(F.xxhash64("text").alias("text_hash"), "text"))
    assert {(r["a"], r["b"]) for r in got.collect()} == true and 0 < len(true) < len(links) and max(held) < 50


def test_links_of_crowds_connect_what_pairs_connect(spark, monkeypatch):
    rng = np.random.default_rng(5)
    fps = set()
    for c in rng.integers(0, 1 << 63, 6):
        near = [int(c)]
        for _ in range(60):
            f = near[rng.integers(len(near))]
            for b in rng.integers(0, 63, rng.integers(1, 4)):
                f ^= 1 << int(b)
            near.append(f)
        fps |= set(near)
    values = sorted(fps)
    wanted = plain_components(values, lambda a, b: (a ^ b).bit_count() <= 2)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for crowd in (2, 32, 10_000):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        got = {r["node"]: r["root"] for r in connected_components(simhash.links(df)).collect()}
        assert {v: got.get(v, v) for v in values} == wanted


def test_near_duplicates_of_odd_rows(docs, nothing):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS)
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["fp"] == by[4]["fp"] == by[8]["fp"] == 0 and by[8]["component_id"] == 3 and by[2]["component_id"] == 1
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 3, 5, 7, 9]
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.one_of_each(nothing).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}}


# Language model


@pytest.mark.parametrize("bucket", [1 << 14, 1 << 30])
def test_lm_scores(some, bucket):
    words = {k: [w for w in t.encode().lower().split()] for k, t in texts_of(some).items()}
    one, two, n = Counter(), Counter(), sum(map(len, words.values()))
    for ws in words.values():
        one.update([None, *ws])
        two.update(zip([None, *ws], ws, strict=False))
    for r in lm_score.score_documents(some, bucket_bytes=bucket).collect():
        ws = words[r["doc_id"]]
        total = 0.0
        for (v, w), own in Counter(zip([None, *ws], ws, strict=False)).items():
            other = two[v, w] - own
            total += own * math.log10(other / one[v] if other else 0.4 * one[w] / n)
        assert r["n_words"] == len(ws) and math.isclose(r["score"], total / len(ws), rel_tol=1e-9)


@pytest.mark.parametrize(("order", "batch"), [(1, 500), (3, 700), (3, 1 << 22)])
def test_lm_scores_of_other_orders_and_small_batches(some, order, batch):
    words = {k: [None, *t.encode().lower().split()] for k, t in texts_of(some).items()}
    grams = lambda ws, k: Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    counts, n = Counter(), sum(len(ws) - 1 for ws in words.values())
    for ws in words.values():
        for k in range(1, order + 1):
            counts.update(grams(ws, k))
    for r in lm_score.score_documents(some, order=order, batch_words=batch, bucket_bytes=1 << 14).collect():
        ws = words[r["doc_id"]]
        own = Counter()
        for k in range(1, order + 1):
            own.update(grams(ws, k))
        total = 0.0
        for i in range(1, len(ws)):
            score, weight = None, 1.0
            for k in range(min(i + 1, order), 1, -1):
                gram = tuple(ws[i - k + 1 : i + 1])
                if counts[gram] > own[gram]:
                    score = weight * (counts[gram] - own[gram]) / counts[gram[:-1]]
                    break
                weight *= 0.4
            total += math.log10(weight * counts[(ws[i],)] / n if score is None else score)
        assert math.isclose(r["score"], total / (len(ws) - 1), rel_tol=1e-9)


def test_lm_scores_of_odd_rows(docs, nothing):
    rows = {r["doc_id"]: r for r in lm_score.score_documents(docs).collect()}
    assert rows.keys() == {i for i, _ in TEXTS} and rows[3]["score"] is None and rows[4]["n_words"] == 0 and rows[None]["n_words"] == 3
    assert rows[5]["n_words"] == 2 * len(LONG.split())
    assert lm_score.score_documents(nothing).count() == 0


# URLs


def plain_rule(host, path):
    best = None
    for rule, says in url_filter.RULES:
        at, _, rest = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, says)
    return best


URLS = ["http://A.Example.com/en/7?x", "http://a.example.com/en/81", "https://b.net/de/8", "https://b.example.net/de/8/#", "x://org/es/", "no scheme", None, "http://h.com?q=/en/", "http://", "http://c.com/fr/1", "http://c.com/fr/1", "ftp://u:p@H.org:80/a//b/../c.html#f://g/en/"]


def test_urls_and_rules(spark):
    rows = {r["url"]: r for r in url_filter.judge_urls(spark.createDataFrame([(u, "h", "t") for u in URLS], "url string, host string, template string"), "url").collect()}
    for u in URLS:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x.group().lower(), m[1]), m[2]) if m else ("", "")
        rule = plain_rule(host, path)
        assert (rows[u]["host"], rows[u]["path"]) == (host, path)
        assert (rows[u]["rule"], rows[u]["verdict"]) == rule if rule else rows[u]["rule"] is None and rows[u]["verdict"] in ("allow", "block")


def test_templates_are_learned_from_labels(spark):
    urls = [(f"http://h.com/spam/{k}.html", 1) for k in range(30)] + [(f"http://h.com/news/{k}", 0) for k in range(30)] + [("http://h.com/spam/99.html", None), ("http://h.com/news/99", None), (None, None)]
    df = spark.createDataFrame(urls, "u string, y int")
    rows = {r["u"]: r["verdict"] for r in url_filter.judge_urls(df, "u", rules=(), label="y").collect()}
    assert rows["http://h.com/spam/99.html"] == "block" and rows["http://h.com/news/99"] == "allow" and rows[None] == "allow"
    assert url_filter.judge_urls(df.limit(0), "u").count() == 0


def test_a_blocked_branch_does_not_block_the_rest_of_its_host(spark):
    urls = [(f"http://{h}.com/en/{k}", 1 if h == "bad" else 0) for h in ("bad", "good") for k in range(40)]
    urls += [(f"http://{h}.com/{b}/{k}", None) for h in ("bad", "good", "new") for b in ("fr", "de") for k in range(30)]
    urls += [(f"http://bad.com/en/deep/{k}", None) for k in range(3)] + [("http://bad.com/" + "/".join("abcdefghijkl"), None), ("http://bad.com/" + "/".join("abcdefghijkm"), None)]
    rows = {r["u"]: r for r in url_filter.judge_urls(spark.createDataFrame(urls, "u string, y int"), "u", rules=(), label="y").collect()}
    for u, y in urls:
        assert rows[u]["verdict"] == ("block" if y == 1 or "bad.com/en/deep" in u else "allow"), u
    assert rows["http://bad.com/fr/3"]["template"] == "/fr/{num}" and rows["http://bad.com/fr/3"]["purity"] == 0.5
    assert len({rows[u]["template"] for u, _ in urls[-2:]}) == 2


def test_similar_branches_merge_and_others_do_not(spark):
    rows = [("h", ["a", "{num}"], 20, 0, 20), ("h", ["b", "{num}"], 19, 1, 20), ("h", ["c", "{num}"], 0, 20, 20), ("h", [f"v{i}" for i in range(1)], 0, 0, 1)]
    df = spark.createDataFrame(rows, "host string, shape array<string>, blocked long, allowed long, n long")
    found = {tuple(r["shape"]): r["template"] for r in url_filter.templates(df, 2).collect()}
    assert found[("c", "{num}")] == "/c/{num}" and found[("v0",)] == "/v0"
    two = spark.createDataFrame([*rows[:2], ("h", ["d", "{num}"], 0, 0, 30)], df.schema)
    assert {r["shape"][0]: r["template"] for r in url_filter.templates(two, 2).collect()} == {"a": "/*/{num}", "b": "/*/{num}", "d": "/d/{num}"}
    many = spark.createDataFrame([("h", [f"v{i}"], 0, 0, 1) for i in range(40)], "host string, shape array<string>, blocked long, allowed long, n long")
    assert {r["template"] for r in url_filter.templates(many, 1).collect()} == {"/*"}


# Personal data


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    forms = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for kind, form in forms:
        for m in re.finditer(form, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                yield f"{kind}:{m.start()}:{m.end()}"


HARD = ["a@b.c_d@e.f x", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "0255.1.1.1 256.1.1.1", "4111 1111-1111 1111", "4111111111111111 2", "4111  1111", "\U0001f600 é +1 (017) 555-7713 x", "+1234567 +12345678901234567", "9" * 5000, "a" * 50_000 + "@", "1 -2 4111111111111111-", "x.1.2.3.4@h.co 1.2.3.4", "1." * 3000, "", "@", "+", "(+1 2 3 4 5 6 7 8)."]


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    rows = {r["doc_id"]: (r["b"], r["s"]) for r in pii.find_personal_data(df).select("doc_id", pii.digest(F.col("base")).alias("b"), pii.digest(F.col("spans")).alias("s")).collect()}
    for i, text in enumerate(HARD):
        assert rows[i][0] == ",".join(plain_spans(text)), text[:40]
        assert set(rows[i][0].split(",")) <= set(rows[i][1].split(","))


def test_contexts_find_unseen_identifiers(spark):
    seen = [f"please call +1 (20{k}) 555-012{k} now" for k in range(9)] + ["they sold 1234567 things", "of 7654321 parts"]
    df = spark.createDataFrame(list(enumerate([*seen, "please call 2025550199."])), "doc_id long, text string")
    rows = {r["doc_id"]: r["s"] for r in pii.find_personal_data(df).select("doc_id", pii.digest(F.col("spans")).alias("s")).collect()}
    assert rows[11] == "phone:12:22" and rows[9] == rows[10] == ""


def test_patterns_of_several_words_find_secrets_and_short_identifiers(spark):
    key = "0123456789abcdef" * 2
    rows = [(k, f"noise {k} then the api token = \"{key[k:]}{key[:k]}\" here") for k in range(12)]
    rows += [(20, "another api token = \"s3same\" here"), (21, "the value = 17 here"), (22, "value = 18"), (23, "a = 19"), (24, "b = 20 = 21 = 22")]
    got = {r["doc_id"]: r["s"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.digest(F.col("spans")).alias("s")).collect()}
    for k, text in rows:
        at = text.find(" token = ")
        word = text.split('"')[1] if at >= 0 else ""
        assert got[k] == (f"secret:{text.index(word)}:{text.index(word) + len(word)}" if word else ""), k


def plain_patterns(text, start, first):
    """The last one to three words before a place, back to the match before (a number)."""
    before = re.sub(r"[^\s\w]+\Z", "", re.sub("[0-9]+", "0", ("" if first else "0") + text[:start].lower()))
    words = before.split()
    return [" ".join(words[-k:]) for k in (1, 2, 3) if k <= len(words)]


def test_the_graph_against_a_plain_version(spark):
    rng = np.random.default_rng(4)
    words = ["call", "mail", "ip", "the", "of", "box", "no"]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rng.integers(1, 8)):
            parts += list(rng.choice(words, rng.integers(0, 4)))
            parts.append(rng.choice(["10.0.0.%d" % rng.integers(250), "x%d" % rng.integers(40), str(rng.integers(10**6)), "+1 555 010 %04d" % rng.integers(9999), "%032x" % int(rng.integers(1 << 62))]))
        rows.append((k, " ".join(parts)))
    forms = {"ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    base, other, edges = {}, {}, {}
    for k, text in rows:
        base[k] = [tuple(x.split(":")) for x in plain_spans(text)]
        taken = [(int(s), int(e)) for _, s, e in base[k]]
        for kind, form in forms.items():
            end = None
            for m in re.finditer(form, text):
                if (kind, str(m.start()), str(m.end())) in base[k]:
                    for p in plain_patterns(text[end or 0 :], m.start() - (end or 0), end is None):
                        edges[p, m.group()] = pii.NAMES.index(kind)
                end = m.end()
        end = None
        for m in re.finditer(r"(?<!\S)[^\s0-9]*[0-9]\S*", text):
            value = re.sub(r"\A[^\w+]+", "", re.sub(r"[^\w]+\Z", "", m.group()))
            s = m.start() + m.group().index(value)
            if not any(a < s + len(value) and b > s for a, b in taken):
                found = plain_patterns(text[end or 0 :], m.start() - (end or 0), end is None)
                other[k, s, s + len(value)] = found
                seed = 4 if re.fullmatch("[0-9a-f]{32,}", value) and re.search("[a-f]", value) else -1
                for p in found:
                    edges[p, value] = max(seed, edges.get((p, value), -1))
            end = m.end()
    belief = {e: (k, 1.0 if k >= 0 else 0.0) for e, k in edges.items()}
    for _ in range(pii.ROUNDS):
        score = {}
        for p in {p for p, _ in edges}:
            own = [e for e in edges if e[0] == p]
            best = max((sum(belief[e][1] for e in own if belief[e][0] == k) / (len(own) + 2), -k, sum(edges[e] == k for e in own)) for k in range(5))
            if best[2] >= pii.SEEDS and best[0] > 0:
                score[p] = best[:2]
        for e in edges:
            if edges[e] < 0:
                near = [score.get(p, (0.0, 9)) for p, v in edges if v == e[1] and edges[p, v] < 0]
                top = max((sum(x for x, j in near if j == -k) / len(near), -k) for k in range(5))
                belief[e] = (-top[1], top[0])
    trusted = {p: s for p, s in score.items() if s[0] >= 0.3717}
    got = {r["doc_id"]: r["s"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), trust=0.3717).select("doc_id", pii.digest(F.col("spans")).alias("s")).collect()}
    added = 0
    for k, _ in rows:
        more = [(-max(trusted[p] for p in ps if p in trusted)[1], s, e) for (d, s, e), ps in other.items() if d == k and any(p in trusted for p in ps)]
        added += len(more)
        want = sorted([(pii.NAMES.index(n), int(s), int(e)) for n, s, e in base[k]] + more)
        assert got[k] == ",".join(f"{pii.NAMES[n]}:{s}:{e}" for n, s, e in want), k
    assert added > 5


def test_many_matches_in_one_text_take_linear_time(spark):
    import time

    df = spark.createDataFrame([(1, " ".join(f"10.0.{i % 250}.{i % 7} x{i}" for i in range(30_000)))], "doc_id long, text string")
    began = time.time()
    assert pii.find_personal_data(df).select(F.size("base")).first()[0] == 30_000
    assert time.time() - began < 60


def test_personal_data_of_odd_rows(docs, nothing):
    rows = pii.find_personal_data(docs).select("doc_id", pii.digest(F.col("base")).alias("b")).collect()
    assert sorted((r["doc_id"] or 0, r["b"]) for r in rows) == sorted((i or 0, ",".join(plain_spans(t or ""))) for i, t in TEXTS)
    assert pii.find_personal_data(nothing).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


# Toxicity


def test_marginals_equal_those_of_the_whole_chain():
    m = toxicity.Model({}, -3.0, np.array([[1.0, -0.5], [-1.0, 0.5]]), (0.0, 1.0, 0.0))
    e = np.full(30, m.bias)
    at, extra = [2, 3, 11, 29], [4.0, -1.0, 6.0, 2.0]
    e[at] += extra
    whole, _ = toxicity._chain(e[None], m.steps, np.ones((1, 30), bool))
    assert np.allclose(m.marginals(30, at, extra), whole[0][at], atol=1e-9)


def test_toxicity_learns_without_held_out_labels(spark, sf_dir):
    docs, labels = common.table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents"), common.table(spark, sf_dir.replace("sf0.001", "sf0.01"), "labels")
    model = toxicity.fit_model(docs, labels)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit_model(docs, flipped).weights == model.weights
    rows = toxicity.score_documents(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) >= 0.9
    for r in rows[:50]:
        assert all(0 <= s["start"] < s["end"] <= len(r["text"]) for s in r["spans"])


def test_toxicity_of_odd_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, None), (None, 1), (1, 1)], "doc_id long, toxic int")
    model = toxicity.fit_model(docs, labels)
    rows = toxicity.score_documents(docs, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.score_documents(nothing, toxicity.fit_model(nothing, labels.limit(0))).count() == 0
    one = toxicity.fit(["vile vile text"] * 8 + ["good text"] * 20, [1] * 8 + [0] * 20)
    assert one.judge("so Vile vile here")[1] == [(3, 12)] and one.judge("so Vile vile here")[0] > 0.5 > one.judge("good text")[0]


# Main text


PAGE = "<html><head><title>x</title></head><body><header><h1>Site</h1></header><div id='cookie-notice'>We use cookies</div><div class=menu><a href=x>a</a></div><div class='content with-sidebar'><h1>Ti&eacute;tle &lt;b&gt;</h1><p>Short.</p><p>Long   text\nwords here <a href=q>link</a> and there.<p>Un closed<div class='ad'>Buy</div><ul><li>one<li>two</ul><form>sign up <input></form></div><div class=sidebar>Other text here with many words too</div><section id=comments><p>Nice post one two three four</p></section><footer>f</footer></body></html>"


@pytest.mark.parametrize(("page", "text"), [(PAGE, "Tiétle <b>\nShort.\nLong text words here link and there.\nUn closed\none\ntwo"), ("", ""), (None, ""), ("plain words only", "plain words only"), ("<p>a &lt; b &amp c", "a < b & c"), ("<article><p>x<script>if (a<b) '</p>'</script>y</article><aside>z</aside>", "xy"), ("<nav>a b c</nav>", ""), ("<p>1 < 2 and <3</p>", "1 < 2 and <3"), ("<!-- c <p>no</p> --><p>yes</p>", "yes"), ("<article>" + "<p>w</p>" * 5000 + "</article>", "\n".join("w" * 5000))])
def test_main_text(page, text):
    assert html_text.main_text(page, {}) == text


def bare_pages(pages):
    """Pages without marks or telling names: (html, text of the article, text of all blocks)."""
    for h in pages:
        body = re.search(r"(?s)<article>(.*)</article>", h)[1]
        lines = [" ".join(x.split()) for x in re.split(r"(?:<br>|<[^>]*>)+", body)]
        yield f"<body><div>Home News Sport and the weather</div><div><a href=/a>About us</a> <a href=/b>Contact</a></div><div>{body}</div><div>All rights are reserved by us</div><div><a href=/c>Imprint</a></div></body>", [html.unescape(x) for x in lines if x]


def test_the_run_finds_the_article_of_pages_that_mark_none(spark, sf_dir, monkeypatch):
    pages = common.table(spark, sf_dir, "pages")
    weights = html_text.fit_weights(pages)
    found = list(bare_pages([r["html"] for r in pages.collect() if "<article>" in r["html"]]))
    assert len(found) > 20
    for h, lines in found:
        text = html_text.main_text(h, weights)
        assert text.replace("\n", " ").split() == " ".join(lines).split()
    monkeypatch.setattr(html_text, "best_run", lambda scores: (0, len(scores)))
    assert all("Imprint" in html_text.main_text(h, weights) and "weather" in html_text.main_text(h, weights) for h, _ in found)


def test_text_is_that_of_the_best_run_of_all(spark):
    rng = np.random.default_rng(9)
    for _ in range(60):
        page = "".join(rng.choice(["<p>a b c</p>", "<div>", "</div>", "<div><a>l</a></div>", "<h2>t</h2>", "<ul><li>x<li>y</ul>", "<nav>n</nav>", "<hr>"], rng.integers(1, 14)))
        weights = {f: float(-abs(rng.normal(1, 0.7)) if f[0] == "t" else rng.normal(0.6, 0.7)) for f in ("tag p", "tag div", "tag a div", "tag h2", "tag li", "tag ul", "tag hr", "word p", "link div", "word h2", "word li")}
        read = html_text.Page(page)
        scores = [n * weights.get(f, html_text._at_first(f)) for f, n, _ in read.events]
        sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        best = max([0.0, *sums.values()])
        texts = {""} if best <= 0 else {"\n".join(read.blocks[b][1] for b in range(min(h), max(h) + 1)) for (i, j), x in sums.items() if math.isclose(x, best) and (h := [b for *_, b in read.events[i:j] if b >= 0])}
        assert html_text.main_text(page, weights) in texts


def test_best_run_is_the_maximum():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = rng.normal(-0.2, 1, rng.integers(0, 12)).tolist()
        a, b = html_text.best_run(s)
        assert math.isclose(sum(s[a:b]), max([0.0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))]), abs_tol=1e-9)


def test_pages_marked_or_not(spark, sf_dir):
    pages = common.table(spark, sf_dir, "pages").withColumn("text", F.lit("clash"))
    rows = html_text.extract_main_text(pages).collect()
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) > 0 and "track(" not in r["text"] and "©" not in r["text"] for r in rows)
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id long, url string, html string")
    assert [r["text"] for r in html_text.extract_main_text(odd).collect()] == ["", "", ""]
    assert html_text.extract_main_text(odd.limit(0)).count() == 0


# Decontamination


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_length():
    rng = np.random.default_rng(2)
    for _ in range(100):
        a, b = ([str(x) for x in rng.integers(0, 5, rng.integers(1, 15))] for _ in range(2))
        assert decontamination.common_length(a, b) == plain_lcs(a, b)


def test_leaks_found_and_clean_documents_left(spark, sf_dir):
    docs, items = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    one = items.filter("item_id = 2").first()["text"]
    words = one.split()
    edited = " ".join(w for i, w in enumerate(words) if i % 6 != 3)
    planted = spark.createDataFrame([(10_001, "intro text " * 30 + edited + " outro text" * 30), (10_002, " ".join(words[:5])), (10_003, None), (10_004, "")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(planted)
    rows = {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in decontamination.with_leaks(both.withColumn("leaks", F.lit(1)), items).select("doc_id", "leaks").collect()}
    texts, items_ = texts_of(both), {r["item_id"]: r["text"] for r in items.collect()}
    for k, t in texts.items():
        assert {i for i, x in items_.items() if x in (t or "")} <= rows[k]
    assert rows[10_001] == {2} and not rows[10_002] and not rows[10_003] and not rows[10_004]
    blocks = decontamination.with_leaks(both, items, block=20).select("doc_id", "leaks").collect()
    assert {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in blocks} == rows


def test_an_item_leaked_into_a_third_of_the_documents_is_found_in_all(spark):
    rng = np.random.default_rng(21)
    prose = lambda n: " ".join(f"w{rng.integers(400)}" for _ in range(n))
    items = [(1, " ".join(f"hot{i}" for i in range(20))), (2, " ".join(f"w{i}" for i in range(380, 400)) + " " + " ".join(f"rare{i}" for i in range(20)))]
    rows = [(k, f"{prose(60)} {items[0][1]} {prose(60)}" if k % 3 == 0 else prose(140)) for k in range(60)] + [(60, f"{prose(50)} {items[1][1]}")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in decontamination.with_leaks(docs, bench).collect()}
    assert got == {**{k: {1} if k % 3 == 0 else set() for k in range(60)}, 60: {2}}


@pytest.mark.parametrize("n", [40, 150, 500])
def test_long_items_are_found_whole_and_in_part(spark, n):
    rng = np.random.default_rng(n)
    item = lambda k: [f"t{k}x{rng.integers(3 * n)}" for _ in range(n)]
    items = [(k, item(k)) for k in range(3)]
    prose = lambda m: " ".join(f"w{rng.integers(400)}" for _ in range(m))
    rows = [(k, prose(200)) for k in range(60)]
    for k, ws in items:
        kept = [w for i, w in enumerate(ws) if i % 6 != 3]
        rows += [(100 + k, f"{prose(30)} {' '.join(ws)} {prose(30)}"), (200 + k, f"{prose(30)} {' '.join(kept)} {prose(30)}")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(ws)) for k, ws in items], "item_id long, text string")
    got = {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in decontamination.with_leaks(docs, bench).collect()}
    assert got == {k: {k % 100} if k >= 100 else set() for k, _ in rows}


def test_paraphrases_are_found_as_by_brute_force(spark, sf_dir):
    items = [(f"item-{r['item_id']}", r["text"]) for r in common.table(spark, sf_dir, "benchmark").collect()]
    hosts = [t.split() for t in texts_of(common.table(spark, sf_dir, "documents")).values() if len((t or "").split()) > 80]
    rng, rows = np.random.default_rng(8), []
    vocabulary = [w for t in hosts for w in t]
    for _, text in items:
        for rate in (0.0, 0.2, 0.4):
            edited = [str(rng.choice(vocabulary)) if rng.random() < rate else w for w in text.split() if rng.random() >= rate / 3]
            host = hosts[rng.integers(len(hosts))]
            at = rng.integers(10, len(host) - 10)
            rows.append((len(rows), " ".join([*host[:at], *edited, *host[at:]])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    found = {(r["doc_id"], x["item_id"]) for r in decontamination.with_leaks(docs, bench).collect() for x in r["leaks"]}
    split = {k: decontamination.words(t) for k, t in items}
    frequency = Counter(w for _, t in rows for w in set(decontamination.words(t)))
    answers = {k: sorted(set(ws), key=lambda w: (frequency[w], w))[: max(1, len(set(ws)) // 3)] for k, ws in split.items()}
    true = set()
    for d, text in rows:
        tokens = decontamination.words(text)
        for k, item in split.items():
            if sum(w in set(tokens) for w in answers[k]) < 0.5 * len(answers[k]):
                continue
            windows = (tokens[s : s + 2 * len(item) + 32] for s in range(0, len(tokens), 4))
            if any(sum(w in set(x) for w in answers[k]) >= 0.5 * len(answers[k]) and 2 * decontamination.common_length(item, x) >= len(item) for x in windows):
                true.add((d, k))
    assert len(true) >= len(items) and found <= true and len(found & true) >= 0.9 * len(true)


def test_the_cosine_excludes_most_pairs_and_decides(spark, sf_dir, monkeypatch):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    items = [(r["item_id"], r["text"]) for r in common.table(spark, sf_dir, "benchmark").collect()]
    index = decontamination.fit_index(docs, items)
    texts = [index.terms_of(decontamination.words(t)) for t in texts_of(docs).values()]
    pairs = sum(len(at) // 16 + 1 for at in texts) * len(index.owner)
    assert len(index._by_vectors(texts)[0]) < 0.02 * pairs
    monkeypatch.setattr(decontamination, "COSINE", 1.1)
    assert not any(x for x in index.search(texts) if index.common == {})


def test_the_latent_space_is_that_of_all_documents(spark):
    rng = np.random.default_rng(3)
    texts = lambda k, n: [" ".join(f"{k}{3 * topic + x}" for x in rng.integers(0, 3, 16)) for topic in rng.integers(0, 40, n)]
    hashed = lambda t: {r["text"]: r["h"] for r in spark.createDataFrame([(x,) for x in t], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    few, more = hashed(texts("a", 6000)), hashed(texts("b", 6000))
    low = sorted(few, key=few.get)[:3100]
    rows = low + [t for t in more if more[t] > few[low[-1]]]  # the least 3000 hashes have no word of b
    items = [(k, " ".join(f"{k}{x}" for x in range(120))) for k in "ab"]
    index = decontamination.fit_index(spark.createDataFrame([(t,) for t in rows], "text string"), items)
    a = []
    for text in [*rows, *(t for _, t in items)]:
        ws = text.split()
        for k in range(0, len(ws), 32):
            v = np.bincount([index.terms[w] for w in ws[k : k + 32]], minlength=len(index.terms)) * index.weight
            if v.any():
                a.append(v / np.linalg.norm(v))
    gram = np.array(a).T @ np.array(a)
    axes = (index.latent / np.where(index.weight > 0, index.weight, 1)[:, None]).astype(float)
    assert np.trace(axes.T @ gram @ axes) >= 0.97 * np.linalg.eigvalsh(gram)[-axes.shape[1] :].sum()


def test_decontamination_of_odd_rows(spark, docs, nothing):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "null id a"), (3, "null id a")], "item_id long, text string")
    rows = decontamination.with_leaks(docs, items).collect()
    assert len(rows) == len(TEXTS) and {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in rows if r["leaks"]} == {None: [3], 9: [None]}
    assert decontamination.with_leaks(nothing, items).count() == 0 and decontamination.with_leaks(docs, items.limit(0)).columns == [*docs.columns, "leaks"]


# Nearest neighbours


def test_recall_and_exact_scores(spark, sf_dir):
    e = common.table(spark, sf_dir, "embeddings")
    rows = ann.nearest(e, F.col("vec_id") % 20 == 0).collect()
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in e.collect()}
    hit = 0
    for q in [k for k in x if k % 20 == 0]:
        wanted = sorted(((-float(x[q] @ v), k) for k, v in x.items() if k != q))[:20]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
        assert [g[0] for g in got] == list(range(1, 21)) and [(-s, k) for _, k, s in got] == sorted((-s, k) for _, k, s in got)
        assert all(math.isclose(s, float(x[q] @ x[k]), abs_tol=1e-12) for _, k, s in got)
        hit += len({k for _, k in wanted} & {k for _, k, _ in got})
    assert hit >= 0.95 * 20 * len([k for k in x if k % 20 == 0])


def test_many_equal_vectors_and_odd_ones(spark):
    same = [(k, [1.0, 0.0], k) for k in range(50)]
    odd = [(100, None, 0), (101, [0.0, 0.0], 0), (102, [float("nan"), 1.0], 0), (103, [float("inf"), 1.0], 0), (104, [None, 1.0], 0), (105, [1.0], 0), (120, [0.5, 0.5], 0), (None, [1.0, 1.0], 0)]
    e = spark.createDataFrame(same + odd, "vec_id long, embedding array<float>, id long")
    rows = ann.nearest(e, F.col("vec_id") % 20 == 0).collect()
    by = {q: [r["vec_id"] for r in sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])] for q in (0, 20, 40, 100, 120)}
    assert by[0] == list(range(1, 21)) and by[20] == [k for k in range(21) if k != 20] and by[40] == list(range(20)) and by[120] == list(range(20)) and not by[100]
    assert ann.nearest(e.filter("vec_id in (0, 120)"), F.col("vec_id") % 20 == 0).count() == 2
    assert ann.nearest(e.limit(0), F.col("vec_id") % 20 == 0).count() == 0
