"""Operators on embeddings and pages against brute force."""

import base64
import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietus.llm import ann, near_vectors, warc
from quietus.llm.vectors import unit

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], 0) for k, v in rows], SCHEMA)


def odd_rows():
    return [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0] * 7 + [None]), (904, [1.0] * 7 + [math.nan]), (905, [math.inf] + [1.0] * 7), (906, [3.0, 4.0]), (950, [1.0] * 7 + [math.nan])]


@pytest.mark.parametrize("block", [4096, 37])
def test_near_vectors_match_brute_force(spark, block):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 8)).astype(np.float32)
    rows = list(base) + [b + rng.standard_normal(8).astype(np.float32) * 0.12 for b in base for _ in range(4)] + [base[0]] * 40 + [base[1] * 3]
    rows = [(k, v) for k, v in enumerate(rows)]
    x = unit(np.array([np.asarray(v, np.float32) for _, v in rows], np.float64))
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    label = np.arange(len(rows))
    while True:
        after = np.minimum(label, np.where(linked, label[None, :], len(rows)).min(axis=1))
        if (after == label).all():
            break
        label = after
    table = vectors(spark, rows + odd_rows() + [(906, [3.0, 4.0])]).withColumns({"node": F.lit("clash"), "n": F.lit(0), "dim": F.lit(3)})
    got = {}
    for r in near_vectors.near_vectors(table, block=block).collect():
        got.setdefault(r.vec_id, []).append(r)
    for k in range(len(rows)):
        (r,) = got[k]
        assert (r.n_links, r.component_id, r.kept) == (linked[k].sum(), label[k], label[k] == k)
    for k in (900, 901, 902, 903, 904, 905, 950):
        assert [(r.n_links, r.component_id, r.kept) for r in got[k]] == [(0, k, True)]
    assert [(r.n_links, r.component_id) for r in got[906]] == [(1, 906)] * 2


def test_proven_and_settled_links_are_all_links(monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((5, 16))
    x = unit(np.vstack([c + rng.standard_normal((60, 16)) * 0.22 for c in centre]))
    w = rng.integers(1, 4, len(x))
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    monkeypatch.setattr(near_vectors, "TILE", 32)
    codes = near_vectors.Codes.of(x)
    sure, label, doubted = near_vectors.compare(codes, codes, w, w, True, 0.95)
    settled, more, _ = near_vectors.compare(codes, codes, w, w, True, 0.95, (x, x))
    assert ((sure + settled)[: len(x)] == near @ w).all() and 0 < doubted.sum() and settled.sum() and sure.sum()
    label = near_vectors.settle(2 * len(x), *(np.concatenate([np.arange(2 * len(x))] * 2), np.concatenate([label, more])))
    groups = [set(np.flatnonzero(label[: len(x)] == k)) for k in set(label[: len(x)])]
    assert sum(len(g) for g in groups) == len(x) and all(label[i] == label[j] for i, j in zip(*np.nonzero(near), strict=True))


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(3)
    x = unit(rng.standard_normal((200, 24)))
    y = unit(x + rng.standard_normal((200, 24)) * 0.15)
    product, off = near_vectors.bounds(near_vectors.Codes.of(x), near_vectors.Codes.of(y), slice(0, 200), slice(0, 200))
    assert (np.abs(product - x @ y.T) <= off).all()


@pytest.mark.parametrize("block", [4096, 50])
def test_links_at_the_threshold_do_not_depend_on_the_blocks(spark, block):
    rng = np.random.default_rng(9)
    rows, want = [], []
    for k in range(60):  # pairs built to lie at 0.95, half of them within the rounding of it
        a, b = np.linalg.qr(rng.standard_normal((16, 2)))[0].T
        rows += [(2 * k, a), (2 * k + 1, 0.95 * a + math.sqrt(1 - 0.95**2) * b)]
    table = spark.createDataFrame([(k, v.tolist(), 0) for k, v in rows], "vec_id long, embedding array<double>, label int")
    x = unit(np.array([v for _, v in rows]))
    want = {(a, b) for a in range(120) for b in range(a) if (x[a] * x[b]).sum() >= 0.95}
    got = {r.vec_id: r.n_links for r in near_vectors.near_vectors(table, block=block, small=40).collect()}
    assert all(got[k] == sum(k in pair for pair in want) for k in range(120))


def test_near_vectors_of_nothing(spark):
    assert near_vectors.near_vectors(vectors(spark, [])).collect() == []


def test_search_recall_ties_and_order(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 40)).astype(np.float32)
    x[350:500] = x[7]
    rows = [(k, v) for k, v in enumerate(x)]
    found = {}
    table = vectors(spark, rows + odd_rows()).withColumn("vec", F.lit(b"clash"))
    for r in ann.search(table, candidates=150, queries=4).collect():
        found.setdefault(r.query_id, []).append(r)
    u = unit(x.astype(np.float64))
    hits = 0
    for q in range(0, 700, 50):
        scores = (u * u[q]).sum(axis=1)
        order = [k for k in sorted(range(700), key=lambda k: (-round(scores[k], 12), k)) if k != q][:5]
        got = sorted(found[q], key=lambda r: r.rank)
        assert [r.rank for r in got] == [1, 2, 3, 4, 5] and all(abs(r.score - scores[r.vec_id]) < 1e-12 for r in got)
        hits += len({r.vec_id for r in got} & set(order))
        if 350 <= q < 500:
            assert [r.vec_id for r in got] == [k for k in [7, *range(350, 500)] if k != q][:5]
    assert hits >= 0.95 * 5 * 14


def test_search_counts_every_row(spark):
    rows = [(0, [1, 0]), (0, [0, 1]), (1, [1, 0.1]), (1, [1, 0.1]), (2, [0.1, 1])]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(vectors(spark, rows)).collect())
    # Two queries of id 0, each with the other as a candidate, and both rows of id 1.
    assert got == sorted([(0, k, v) for k, v in enumerate((1, 1, 2, 0), 1)] + [(0, k, v) for k, v in enumerate((2, 1, 1, 0), 1)])


def test_search_with_few_candidates(spark):
    got = ann.search(vectors(spark, [(0, [1, 0]), (1, [1, 1]), (2, None)])).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1)] and ann.search(vectors(spark, [])).collect() == []


PAGES = "page_id long, url string, html string"


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_warc_round_trip(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k % 7}</p>" if k % 2 else f"<p>é {k}\r\n\r\nWARC/1.1</p>" * 50) for k in range(80)] + [(100, None, None), (101, "u", ""), (None, "x", "<p>1</p>"), (200, "y z", "x" * 300_000)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(5), roll_bytes=4000, shard_bytes=9000).collect()}
    last = {}
    for k, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if k is None else k)
    for k, _, html in rows:
        data, r = (html or "").encode(), got[k]
        assert (r.payload_bytes, r.payload_digest) == (len(data), digest(data))
        assert (r.record_type, r.refers_to) == (("response", None) if last[html or ""] == k else ("revisit", last[html or ""]))


def test_warc_is_the_same_whatever_the_partitioning(spark, tmp_path):
    rows = [(k * 97 % 1000, f"http://h/{k}", f"text {k % 50} " * 40) for k in range(300)]
    listed = []
    for n in (1, 7):
        table = spark.createDataFrame(rows, PAGES).repartition(n)
        manifest = warc.write(table, str(tmp_path / str(n)), roll_bytes=3000, shard_bytes=20_000)
        assert json.loads((tmp_path / str(n) / "manifest.json").read_text()) == manifest
        assert sorted(p.name for p in (tmp_path / str(n)).iterdir() if not p.name.startswith(".")) == sorted([*(f["file"] for f in manifest), "manifest.json"])
        listed.append(manifest)
    assert listed[0] == listed[1] and len(listed[0]) > 5
    keys = [(f["first_key"], f["last_key"]) for f in listed[0]]
    assert keys == sorted(keys) and sum(f["records"] for f in listed[0]) == 300


def test_warc_payload_bound_and_damage(spark, tmp_path):
    rows = [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "longer text"), (4, "d", "longer text")]
    got = {r.page_id: r.record_type for r in warc.round_trip(spark.createDataFrame(rows, PAGES), revisit_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    with pytest.raises(ValueError):
        list(warc.records(warc.member(warc.record(1, "u", b"body", None))[:-9]))
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_warc_shards_cut_heavy_keys_and_odd_spans(spark, tmp_path):
    rows = [(7, f"http://h/{k}", f"heavy {k} " * 60) for k in range(80)] + [(k, "u", "light " * 30) for k in (1, 2, 3, 10**15, 10**15 + 1, -5)] + [(None, f"n{k}", f"none {k} " * 50) for k in range(20)] + [(9, "same", "twice " * 40)] * 2
    table = spark.createDataFrame(rows, PAGES).withColumns({"shard": F.lit("clash"), "key": F.lit(1), "payload": F.lit("x")})
    manifest = warc.write(table, str(tmp_path / "a"), shard_bytes=8000)
    assert len(manifest) > 5 and sum(f["records"] for f in manifest) == len(rows) and max(f["records"] for f in manifest) < 40
    ids = [head["WARC-Record-ID"] for f in manifest for head, _ in warc.records((tmp_path / "a" / f["file"]).read_bytes())]
    assert len(set(ids)) == len(rows)
    got = warc.read(spark, str(tmp_path / "a"), manifest).collect()
    assert sorted((str(r.page_id), r.payload_bytes) for r in got) == sorted((str(k), len(t)) for k, _, t in rows)
    assert {r.record_type for r in got if r.page_id == 9} == {"response"}


def test_warc_records_are_http_messages_and_read_in_slices(monkeypatch):
    body = "<p>ü</p>\r\n\r\nmore".encode()
    pages = [warc.record(k, "http://h", body * (k % 5), None) for k in range(200)]
    archive = b"".join(map(warc.member, pages))
    monkeypatch.setattr(warc, "SLICE", 37)
    found = list(warc.records(archive))
    assert [int(h["X-Record-Key"]) for h, _ in found] == list(range(200)) and all(warc.payload_of(b) == body * (k % 5) and b.startswith(b"HTTP/1.1 200 OK\r\n") for k, (_, b) in enumerate(found))
    revisit, block = next(iter(warc.records(warc.member(warc.record(3, "u", body, 9)))))
    assert revisit["WARC-Refers-To"] == warc.record_id(9, digest(body)) and warc.payload_of(block) == b"" and revisit["WARC-Payload-Digest"] == f"sha1:{digest(body)}"
