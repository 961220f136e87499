"""The pipeline's stages one by one: what each keeps, changes and drops, against plain rules on its own input."""

import random

import corpus_pipeline
import pytest

from tests.llm.test_documents import SCHEMA, brute_fingerprint, components_of, odd, speech


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    rows = [(k, speech(rng, ["en", "fr"][k % 2], 50) + f" n{k}", ["en", "fr"][k % 2], f"s{k % 3}", 0) for k in range(60)]
    rows += [(100 + k, rows[k][1], rows[k][2], rows[k][3], 0) for k in range(10)] + [(200, "12 34", "en", "s1", 5), (201, "the of and to token = aB3dE5gH7jK9 this from", "en", "s1", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages_keep_the_columns(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == corpus_pipeline.COLUMNS


def test_language_stage_drops_only_what_has_no_letters(spark, docs):
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {200}


def test_dedup_stage_keeps_one_of_each_group(spark, docs):
    rows = docs.collect()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    kept, groups = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}, []
    for k in sorted(prints):
        hit = [g for g in groups if any((prints[k] ^ prints[m]).bit_count() <= 3 for m in g)]
        groups = [g for g in groups if g not in hit] + [set().union({k}, *hit)]
    assert kept == {min(g) for g in groups}


def test_dedup_stage_catches_all_near_copies(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(3, 160))]
        texts.append(" ".join(base))
        for _ in range(4):
            near = list(base)
            for _ in range(rng.randint(1, 3)):
                near[rng.randrange(len(near))] = f"v{rng.randrange(1000)}"
            texts.append("a line that all of them share\n" * (len(base) > 80) + " ".join(near))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    prints = [brute_fingerprint(t) for t in texts]
    assert sum(alike(a, b) and (prints[a] ^ prints[b]).bit_count() > 3 for a in range(len(texts)) for b in range(a)) > 20
    root = components_of(len(texts), lambda a, b: alike(a, b) or (prints[a] ^ prints[b]).bit_count() <= 3)
    table = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, table, "").collect()} == set(root)


def test_a_group_of_near_copies_is_not_settled_pair_by_pair(spark, monkeypatch):
    """Each text is close to a few hundredths of a large group: classes are joined by fewer pairs than all of theirs, and none is lost."""
    from quietus.graph.components import weak_components
    from quietus.llm import resemblance

    rng = random.Random(13)
    base, texts = [f"w{k}" for k in range(80)], []
    for k in range(400):
        near = list(base)
        near[rng.choice([p for p in range(4, 76) if p % 16 < 12])] = f"v{k}"
        texts.append(" ".join(near))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    root = components_of(len(texts), alike)
    assert len(set(root)) > 3 and sum(alike(a, b) for a in range(len(texts)) for b in range(a)) > 10 * len(texts)

    settled, counts = resemblance._settled, []
    monkeypatch.setattr(resemblance, "_settled", lambda texts, profiles, pairs: (counts.append(pairs.count()), settled(texts, profiles, pairs))[1])
    table = spark.createDataFrame(list(enumerate(texts)), "digest long, text string").selectExpr("digest", "cast(text as binary) as text")
    found = weak_components(resemblance.links(table, len(texts), table.selectExpr("digest", "digest as root"))).collect()
    assert {r.node: r.root for r in found} == {k: g for k, g in enumerate(root) if root.count(g) > 1}
    assert sum(counts) < 20 * len(texts), counts  # 9520 where all pairs of different labels meet at once


def test_closest_rows_meet_across_batches():
    import numpy as np
    import pyarrow as pa

    from quietus.llm import resemblance

    rng = np.random.default_rng(14)
    n, near = 900, resemblance.NEAR
    h, root, odd = np.sort(rng.integers(0, 3, n)), rng.integers(0, 6, n), rng.integers(0, 2, (n, 16))
    rows = [pa.array(c) for c in (h, np.arange(n), root, np.full(n, 100, np.int32), np.zeros(n, np.int32), *odd.T.astype(np.int64))]
    names = ["h", "digest", "root", "size", "place", *resemblance.PARITIES]
    apart = {(x, y): int((odd[x] != odd[y]).sum()) for y in range(n) for x in range(max(0, y - near), y) if h[x] == h[y] and root[x] != root[y]}
    least = np.full(n, 99)
    for (x, y), d in apart.items():
        least[x], least[y] = min(least[x], d), min(least[y], d)
    for width in (n, 200, 7, 1):
        whole = pa.RecordBatch.from_arrays(rows, names=names)
        got = np.full(n, 99)
        for batch in resemblance._closest(iter([whole.slice(at, width) for at in range(0, n, width)])):
            for a, b, root_a, root_b, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                assert root[a] == root_a < root_b == root[b] and apart[min(a, b), max(a, b)] == d
                got[a], got[b] = min(got[a], d), min(got[b], d)
        assert (got == least).all(), width


def test_secret_stage_masks_and_keeps_all(spark, docs):
    got = {r.doc_id: r for r in corpus_pipeline.secret_scan(spark, docs, "").collect()}
    want = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == want.keys() and all(got[k].text == want[k] for k in want if k != 201)
    assert got[201].text == "the of and to <secret> this from" and got[201].n_chars == len(got[201].text)


def test_mixing_stage_draws_by_the_raked_weights(spark, docs):
    import hashlib

    rows = [(r.doc_id, len(r.text.split()), r.source, r.lang) for r in docs.collect()]
    cell = {i: (s, g, "short" if n < 128 else "medium" if n < 1024 else "long") for i, n, s, g in rows}
    w0 = {}
    for i, n, _, _ in rows:
        w0[cell[i]] = w0.get(cell[i], 0) + n
    w, whole = dict(w0), [{}, {}, {}]
    for c, n in w0.items():
        for d in range(3):
            whole[d][c[d]] = whole[d].get(c[d], 0) + n
    target = [{v: n**0.75 / sum(m**0.75 for m in one.values()) for v, n in one.items()} for one in whole]
    for _ in range(200):
        for d in range(3):
            sums = {}
            for c, x in w.items():
                sums[c[d]] = sums.get(c[d], 0) + x
            w = {c: x * target[d][c[d]] / sums[c[d]] for c, x in w.items()}
    top = max(w[c] / w0[c] for c in w)
    want = {i for i in cell if int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32 < w[cell[i]] / w0[cell[i]] / top}
    assert {r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, "").collect()} == want


def test_packing_stage_holds_every_document_once(spark, docs):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: [*ids.encode(r.text, add_special_tokens=False).ids, 1] for r in docs.collect()}
    at, fill = {k: 0 for k in want}, {}
    for r in sorted(corpus_pipeline.pack(spark, docs, "").collect(), key=lambda r: (r.doc_id, r.start)):
        piece = want[r.doc_id][r.start : r.start + r.length]
        assert r.start == at[r.doc_id] and len(piece) == r.length and r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        at[r.doc_id] += r.length
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {k: len(v) for k, v in want.items()}
    for pieces in fill.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048


def test_stages_keep_clear_of_further_columns(spark, docs):
    """Columns that have the names the operators use within."""
    from pyspark.sql import functions as F

    names = "q_id q_digest q_kept q_n q_text j_id j_digest j_cuts j_text j_masked i_id i_digest i_declared i_host i_nulls i_language i_accepted m_tokens M_Kept m_source m_error c_source c_chance digest fp spans hash".split()
    more = docs.withColumns({n: F.lit("x") for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(map(tuple, stage(spark, more, "").collect())) == sorted(map(tuple, stage(spark, docs, "").collect())), name


def test_undeclared_documents_stay(spark, docs):
    from pyspark.sql import functions as F

    plain = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, plain, "").count() == docs.count()


def test_very_many_secrets_in_one_text(spark):
    import time

    text = " ".join(f"token = aB3{k:09d}" for k in range(32_000))
    table = spark.createDataFrame([(1, text, "en", "s", 0)], SCHEMA)
    began = time.time()
    (got,) = corpus_pipeline.secret_scan(spark, table, "").collect()
    assert got.text == " ".join(["<secret>"] * 32_000) and time.time() - began < 60


def test_contradicting_margins_are_told(spark):
    from quietus.llm import mixing

    rows = [(k, "x " * 50, "en" if k % 2 else "fr", "a" if k % 2 else "b", 0) for k in range(100)]
    with pytest.warns(UserWarning, match="contradict"):
        got = mixing.mix(spark.createDataFrame(rows, SCHEMA), targets={"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "fr": 0.9}}).collect()
    assert len(got) == 100 and got[0].m_error > 0.5


def test_run_chains_the_stages(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(got[0].asDict()) and 200 not in {r.doc_id for r in got}


def test_stages_take_odd_rows_and_none(spark):
    for table in (odd(spark), odd(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, "").collect()
