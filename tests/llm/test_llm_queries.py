"""The registered queries: columns of their contracts, whole tables, rows against plain versions or SQL."""

import os
import re
import zlib

import duckdb
import pytest

import corpus_pipeline
from quarrylode.llm import common
from quarrylode.llm.entry import ORACLES, QUERIES

CONTRACTS = {
    "op1_html_text": ("pages", {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}),
    "op2_simhash": ("documents", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}),
    "op3_lm_score": ("documents", {"doc_id": "bigint", "n_words": "bigint", "score": "double"}),
    "op4_url_filter": ("pages", {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"}),
    "op5_decontamination": (None, {"doc_id": "bigint", "item_id": "bigint"}),
    "op6_toxicity": ("documents", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
    "op7_pii": ("documents", {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"}),
    "op8_sharding": ("documents", {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}),
    "op9_mixing": ("documents", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}),
    "op11_periodic": ("documents", {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}),
    "op12_suffixes": ("documents", {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}),
    "op13_alignment": ("documents", {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"}),
    "op10_nearest": (None, {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}),
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_columns_and_rows_of_the_contract(spark, sf_dir, name):
    whole, columns = CONTRACTS[name]
    df = QUERIES[name](spark, sf_dir)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in columns} == columns and list(types)[: len(columns)] == [c for c in types if c in columns]
    if whole:
        assert df.count() == common.table(spark, sf_dir, whole).count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    df = QUERIES[name](spark, sf_dir)
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    wanted = [tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in found.fetchall()]
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr) == sorted(wanted, key=repr)


def test_op8_sizes_checksums_and_slots(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in common.table(spark, sf_dir, "documents").collect()}
    rows = QUERIES["op8_sharding"](spark, sf_dir).collect()
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key") and r["grown_shard"] in (r["shard"], 8)
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_op9_takes_come_near_the_targets(spark, sf_dir):
    docs = {r["doc_id"]: (r["source"], len(re.findall(common.WORD, r["text"] or ""))) for r in common.table(spark, sf_dir, "documents").collect()}
    rows = QUERIES["op9_mixing"](spark, sf_dir).collect()
    by: dict = {}
    for r in rows:
        assert r["size"] == docs[r["doc_id"]][1] and 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(docs[r["doc_id"]][0], []).append(r)
    for found in by.values():
        assert {r["source_size"] for r in found} == {sum(r["size"] for r in found)}
        assert abs(sum(r["taken"] for r in found) - found[0]["target"]) <= 0.02 * found[0]["target"] + 1


def test_pipeline_is_registered():
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run and set(QUERIES) <= set(entry.queries())
