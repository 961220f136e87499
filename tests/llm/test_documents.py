"""Operators on texts against brute force, on small tables that hold nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import hashlib
import importlib.util
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quietus.llm import langid, masked_lm, mixing, packing, secrets, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, **columns):
    rows = [(k, t, columns.get("lang", "en"), columns.get("source", "s"), len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """Nulls in any column, empty, blank and long texts, a repeated row, a repeated id, columns that clash with the operators' own."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", None, 3), (4, "one", None, "a", 3), (5, "word " * 60_000, "en", "a", 300_000), (6, "x" * 200_000, "en", "a", 200_000), (7, "same text here", "en", "a", 14), (7, "same text here", "en", "a", 14), (8, "same text here", "fr", "b", 14), (8, "other words now", "fr", "b", 15), (None, "no id at all", "de", "c", 12)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"fp": F.lit("clash"), "digest": F.lit(1), "rep": F.lit(None), "owner": F.lit("o"), "score": F.lit(2.5), "n": F.lit(1), "declared": F.lit("zz"), "anchor": F.lit(0), "w": F.lit(1)})


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def test_simhash_matches_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts = base + [t + " tail" for t in base[:15]] + [t.upper() for t in base[:10]] + base[:5] + ["", None, "ÀB c", "àb c"]
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    root = components_of(len(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert len(got) == len(texts)
    for k, value in enumerate(prints):
        assert got[k].fingerprint == f"{value:016x}" and got[k].component_id == root[k]


def test_anchors_lose_no_link_and_hot_anchors_are_dealt_out(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.int64)
    prints = {int(c) for c in centres}
    for c in centres:
        for _ in range(60):
            flips = sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 7), replace=False))
            prints.add(int(c) ^ flips)
    prints = sorted(prints)
    root = components_of(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    table = spark.createDataFrame([(p, p) for p in prints], "fp long, rep long")
    from quietus.graph.components import weak_components

    for chunk in (2048, 7):
        got = {r.node: r.root for r in weak_components(simhash.links(table, chunk=chunk)).collect()}
        assert [got.get(p, p) for p in prints] == [prints[r] for r in root]


def test_simhash_edges(spark):
    got = simhash.near_duplicates(odd(spark)).collect()
    assert len(got) == 11 and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in got if r.doc_id == 7} == {7} and simhash.near_duplicates(frame(spark, [])).collect() == []
    kept = simhash.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted((r.doc_id or 0, (r.text or "")[:20]) for r in kept.collect()) == sorted([(1, ""), (4, "one"), (5, ("word " * 9)[:20]), (6, "x" * 20), (7, "same text here"), (8, "other words now"), (0, "no id at all")])


PLAIN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in PLAIN.finditer(text or "") if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(found)


def test_secret_spans_match_plain_patterns(spark):
    key, live = "AKIA" + "Z9" * 8, "aB3dE5gH7jK9mN1pQ3sT"
    texts = [f"é password = '{live}' and Api_Key:abc", f"{key} token==abcdef12 secret=abc", "deadbeef" * 4 + "g" + "0" * 23, f"x {live}xyzW end", f"y {live}xyzW end", None, "", "ſecret=abcdefgh", "PASSWD:  \"hunter22-hunter22\" token: x"]
    got = {r.doc_id: r for r in secrets.secrets(frame(spark, texts)).collect()}
    for k, text in enumerate(texts):
        base = base_spans(text)
        joined = ",".join(f"{name}:{a}:{b}" for a, _, b, name in base)
        assert got[k].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (got[k].n_assign, got[k].n_access, got[k].n_hex) == tuple(sum(s[1] == i for s in base) for i in range(3))
        assert set(filter(None, joined.split(","))) <= set(got[k].spans.split(","))
    assert got[3].n_owned == 1


def test_widely_copied_values_are_examples(spark):
    value = "aB3dE5gH7jK9mN1pQ3sTx"
    rows = [(k, f"key {value} here", "en", f"owner{k}", 0) for k in range(4)] + [(9, f"key {value[::-1]} here", "en", "owner0", 0)]
    got = {r.doc_id: r for r in secrets.secrets(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[k].n_owned for k in (0, 1, 2, 3, 9)] == [0, 0, 0, 0, 1] and got[0].n_examples == 1
    masked = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert masked[9] == "key <secret> here" and value in masked[0]


def test_secret_edges(spark):
    assert secrets.secrets(odd(spark)).count() == 11 and secrets.secrets(frame(spark, [])).collect() == []
    assert secrets.redact(odd(spark)).columns == odd(spark).columns and secrets.redact(odd(spark)).count() == 11


@pytest.fixture(scope="module")
def vocabulary():
    if importlib.util.find_spec("public_tokenizers") is None:
        pytest.skip("no public vocabulary here")
    from quietus.llm.queries import tokenizer

    return tokenizer()


def test_packing_round_trip(spark, vocabulary):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta,", "don't", "naïve", "漢字", "12345", "x_y", "\n", "  ", "\t"]) for _ in range(rng.randint(0, 900))) for _ in range(120)] + [None, "", "a  b \n c ", "<|endoftext|> z", "q" * 30_000, " em space", "a  b"]
    got = packing.pack(frame(spark, texts).repartition(3), **vocabulary).collect()
    plain = Tokenizer.from_file(vocabulary["tokenizer_path"])
    pieces, bins = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for k, text in enumerate(texts):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padded = 0
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded < 0.02 * sum(r.length for r in got)
    slow = packing.pack(frame(spark, texts[:20]), vocabulary["tokenizer_path"]).collect()
    fast = packing.pack(frame(spark, texts[:20]), **vocabulary).collect()
    assert slow == fast


def test_packing_edges(spark, vocabulary):
    rows = packing.pack(odd(spark), **vocabulary).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 1 and sum(r.length for r in rows if r.doc_id == 2) == 1
    assert packing.pack(frame(spark, []), **vocabulary).collect() == []


def test_harmonic_cuts_cover_every_length():
    for n in range(1, 5000, 7):
        cuts = packing.harmonic_cuts(n, 2048, 1 / 64)
        assert sum(length for length, _ in cuts) == n and all(length * k <= 2048 for length, k in cuts)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    texts, labels = [], []
    for k in range(600):
        words = [rng.choice(["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))), "the", "of"]) for _ in range(60)]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["vexgrim", "vexgrol", "dolt", "numpty"])
        texts.append(" ".join(words))
        labels.append((k, None, int(toxic)))
    docs = frame(spark, texts)
    marks = spark.createDataFrame(labels + [(None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    right = sum(r.predicted == (r.doc_id % 6 == 0) for r in held)
    assert right >= 0.97 * len(held)


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    texts = ["plain words here", "zorgon words here"] * 60
    docs = frame(spark, texts)
    kept = [(k, 1, k % 2) for k in range(120) if not toxicity.held_out(k)]
    flipped = [(k, 1, 1 - k % 2) for k in range(120) if toxicity.held_out(k)]
    schema = "doc_id long, quality int, toxic int"
    a = toxicity.toxicity(docs, spark.createDataFrame(kept, schema)).collect()
    b = toxicity.toxicity(docs, spark.createDataFrame(kept + flipped, schema)).collect()
    assert a == b


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(odd(spark), none).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got) and all(r.predicted == 0 for r in got)
    assert toxicity.toxicity(frame(spark, []), none).collect() == []


def test_grammar_clauses():
    g = toxicity.Grammar({"dolt ": 3.0, "vex": 2.0}, {"kill ": 2.0})
    c = lambda text: dict(zip(toxicity.CHANNELS, g.channels(text), strict=True))
    assert c("a dolt")["insult"] > 0 == c("not a dolt")["insult"] < c("not a dolt")["insult_negated"] and c("she said dolt")["insult_reported"] > 0
    assert c("you dolt")["insult_targeted"] > 0 == c("adoltish")["insult"] and c("vexation")["insult"] > 0
    assert c("i will kill you")["threat"] > 0 == c("kill the process")["threat"] < c("kill the process")["threat_loose"]
    assert c("i will not kill you")["threat_negated"] > 0 and c("he wrote i kill you")["threat_reported"] > 0
    assert c("fine. words! only;")["clauses"] == 0


def test_channels_match_plain_loops():
    """The composed table and the automaton against loops over words, clause by clause."""
    rng = random.Random(21)
    g = toxicity.Grammar({"dolt ": 3.0, "vex": 2.0, "do": 0.5}, {"kill ": 2.0, "vex ": 1.0})
    words = ["dolt", "dolts", "vex", "vexing", "kill", "killer", "I", "you", "not", "said", "do", "tree", "the", ".", "!", ";", "\n", "x1dolt", "_vex"]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        sums, strongest, clauses = dict.fromkeys(toxicity.CHANNELS[:8], 0.0), 0.0, 0
        for clause in re.split(r"[.!?;:\n]", text.lower()):
            found = re.findall(r"[^\W\d_]+", clause)
            own, hits, negated, agent, reported = dict.fromkeys(sums, 0.0), [], 0, False, False
            for w in found:
                weigh = lambda arcs, w=w: max([v for a, v in arcs.items() if w == a.strip() or (not a.endswith(" ") and w.startswith(a))], default=0.0)
                insult, threat = weigh(g.insult), weigh(g.threat)
                how = "_reported" if reported else "_negated" if negated else ""
                if insult or threat:
                    own[f"insult{how}"] += insult
                    hits.append((threat, how, agent))
                negated = toxicity.REACH if w in toxicity.NEGATIONS else max(0, negated - 1)
                agent, reported = agent or w in toxicity.AGENTS, reported or w in toxicity.REPORTING
            target = any(w in toxicity.TARGETS for w in found)
            if hits:
                if target:
                    own["insult_targeted"] = own["insult"] + own["insult_negated"] + own["insult_reported"]
                for threat, how, framed in hits:
                    own[f"threat{how}" if framed and target else "threat_loose"] += threat
                clauses, strongest = clauses + 1, max(strongest, sum(own.values()))
                sums = {k: sums[k] + own[k] for k in sums}
        want = [*(np.log1p(v) for v in sums.values()), strongest, np.log1p(clauses)]
        assert np.allclose(g.channels(text), want), text


def test_learned_arcs_of_framed_words_are_threats():
    texts = ["i will zap you now", "we zap them", "you dunce", "such a dunce there", "plain words here", "more plain talk"] * 12
    toxic = np.array([k % 6 < 4 for k in range(72)])
    words = [{*toxicity.words_and_frames(t)[0], f"n{chr(97 + k % 26)}{chr(97 + k // 26)}"} for k, t in enumerate(texts)]
    insult, threat = toxicity.split_arcs({"zap ": 1.0, "dunce ": 1.0}, [w for w, y in zip(words, toxic, strict=True) if y], [toxicity.words_and_frames(t)[1] for t, y in zip(texts, toxic, strict=True) if y])
    assert set(threat) == {"zap "} and set(insult) == {"dunce "}


def brute_rake(cells, rounds, alpha):
    w = dict(cells)
    for _ in range(rounds):
        for d in range(3):
            values = {c[d] for c in cells}
            natural = {v: sum(n for c, n in cells.items() if c[d] == v) ** alpha for v in values}
            total = sum(natural.values())
            margin = {v: sum(n for c, n in w.items() if c[d] == v) for v in values}
            w = {c: n * natural[c[d]] / total / margin[c[d]] if margin[c[d]] else 0.0 for c, n in w.items()}
    return w


def test_mixing_matches_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(k, "w " * rng.randint(0, 2000), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", "c"]), 0) for k in range(200)] + [(None, None, "en", "zero", None)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), alpha=0.5).collect()
    cells = {}
    for r in got:
        c = (r.source or "(none)", r.lang or "(none)", r.m_topic)
        cells[c] = cells.get(c, 0) + r.m_tokens
    w = brute_rake(cells, 60, 0.5)
    f = {c: w[c] / n if n else 0.0 for c, n in cells.items()}
    top = max(f.values())
    for r in got:
        p = f[r.source or "(none)", r.lang or "(none)", r.m_topic] / top
        assert abs(r.m_probability - p) < 1e-6
        u = int(hashlib.md5(str(r.doc_id if r.doc_id is not None else "").encode()).hexdigest()[:8], 16) / 2**32
        assert r.m_kept == (u < p) and r.m_error <= 1e-12
    assert len(got) == 201


def test_mixing_sql_and_stated_targets(spark):
    import duckdb
    import pandas as pd

    docs = frame(spark, ["a b c " * k for k in range(60)])
    documents = docs.toPandas()  # noqa: F841
    want = duckdb.sql(mixing.oracle()).df().sort_values("doc_id").reset_index(drop=True)
    got = mixing.mix(docs).select("doc_id", F.col("m_tokens").alias("n_tokens"), F.col("m_topic").alias("topic"), F.col("m_probability").alias("probability"), F.round("m_error", 6).alias("margin_error"), F.col("m_kept").alias("kept")).toPandas().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want[got.columns.tolist()], check_dtype=False)
    halves = frame(spark, ["x " * 50] * 40).withColumn("source", F.when(F.col("doc_id") < 30, "a").otherwise("b"))
    p = {r.source: r.m_probability for r in mixing.mix(halves, targets={"source": {"a": 0.5, "b": 0.5}}).collect()}
    assert p == {"a": round(1 / 3, 6), "b": 1.0}


def test_mixing_keeps_values_without_a_target(spark):
    rows = [(k, "x " * 50, "en", "abc"[k % 3], 0) for k in range(60)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), targets={"source": {"a": 0.5, "b": 0.5}}).collect()
    assert all(r.m_probability > 0 for r in got if r.source == "c") and any(r.m_kept for r in got if r.source == "c")


def test_mixing_edges(spark):
    assert mixing.mix(odd(spark)).count() == 11 and mixing.mix(frame(spark, [])).collect() == []


LANGUAGES = {"en": "the of and to that with this from are was".split(), "fr": "le de la et les des un une que pour".split(), "de": "der die und das den von zu mit ist auf".split()}


def speech(rng, lang, n):
    return " ".join(rng.choice(LANGUAGES[lang]) for _ in range(n))


def test_language_of_held_out_texts(spark):
    rng = random.Random(6)
    rows = [(k, speech(rng, lang, 40), lang, f"host{k % 5}", 0) for k, lang in enumerate(rng.choice(list(LANGUAGES)) for _ in range(240))]
    wrong = [(1000 + k, speech(rng, "fr", 60), "en", "host1", 0) for k in range(4)]
    got = {r.doc_id: r for r in langid.of_documents(spark.createDataFrame(rows + wrong, SCHEMA)).collect()}
    assert all(got[k].language == lang and got[k].accepted for k, _, lang, _, _ in rows)
    assert all(got[1000 + k].language == "fr" for k in range(4))
    kept = langid.keep_identified(spark.createDataFrame(rows + wrong, SCHEMA))
    assert kept.count() == 244 and {r.lang for r in kept.where("doc_id >= 1000").collect()} == {"fr"}


def test_languages_without_a_profile_are_taken_for_no_other(spark):
    rng = random.Random(8)
    rows = [(k, speech(rng, ["en", "fr"][k % 2], 40), ["en", "fr"][k % 2], "h", 0) for k in range(200)] + [(500 + k, speech(rng, "de", 40), "de", "h", 0) for k in range(3)] + [(600, speech(rng, "de", 40), "en", "h", 0)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in langid.identify(table, "doc_id", F.col("text"), F.col("lang"), F.col("source"), min_share=0.05).collect()}
    assert all((got[500 + k].language, got[500 + k].accepted) == ("de", True) for k in range(3)) and (got[600].language, got[600].accepted) == ("other", False)
    kept = {r.doc_id: r.lang for r in langid.keep_identified(table, min_share=0.05).collect()}
    assert 600 not in kept and kept[500] == "de" and len(kept) == 203


def test_hosts_and_markup_decide_short_texts(spark):
    rng = random.Random(7)
    rows = [(k, speech(rng, lang, 40), lang, lang + "host", 0) for k, lang in enumerate(["en", "fr"] * 60)]
    short = [(900, "qqq", "fr", "frhost", 0), (901, "qqq", "en", "enhost", 0), (902, "123 !!", "en", "enhost", 0)]
    got = {r.doc_id: r for r in langid.of_documents(spark.createDataFrame(rows + short, SCHEMA)).collect()}
    assert got[900].language == "fr" and got[901].language == "en" and not got[902].accepted


def test_pages_join_markup_suffix_and_host(spark):
    rng = random.Random(8)
    rows = [(k, f"https://h{k % 4}.site.{'fr' if lang == 'fr' else 'com'}/p{k}", f'<html lang="{lang}"><script>the the the</script><p>{speech(rng, lang, 30)}</p></html>') for k, lang in enumerate(["en", "fr"] * 40)] + [(500, None, None)]
    got = {r.doc_id: r for r in langid.of_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].language == lang for k, lang in enumerate(["en", "fr"] * 40)) and not got[500].accepted


def test_language_edges(spark):
    got = langid.of_documents(odd(spark)).collect()
    assert len(got) == 11 and not any(r.accepted for r in got if r.doc_id in (1, 2, 3))
    assert langid.of_documents(frame(spark, [])).collect() == [] and langid.keep_identified(odd(spark)).columns == odd(spark).columns


def test_pseudo_likelihood_prefers_the_order_it_learned(spark):
    rng = random.Random(9)
    sentence = lambda: " ".join(f"{a} {b} {c}" for a, b, c in (rng.choice([("red", "cars", "race"), ("blue", "birds", "sing"), ("old", "men", "talk")]) for _ in range(20)))
    texts = [sentence() for _ in range(60)]
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts[:10]]
    got = {r.doc_id: r for r in masked_lm.pseudo_likelihood(frame(spark, texts + shuffled)).collect()}
    assert max(got[60 + k].per_word for k in range(10)) < min(got[k].per_word for k in range(60))
    assert got[0].n_words == 60 and abs(got[0].log_likelihood - 60 * got[0].per_word) < 1e-6


def test_pseudo_likelihood_matches_plain_sums(spark):
    """Every word's probability against loops over the model's tables, which sum to one over all words of the vocabulary."""
    rng = random.Random(13)
    words = [f"w{k}" for k in range(60)] + ["Zürich", "q", "r"]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(63)], k=rng.randint(1, 40))) for _ in range(60)]
    texts += [texts[0], texts[0] + " " + texts[1], None, "", "solo"]
    docs = frame(spark, texts)
    model = masked_lm.fit(docs.select("doc_id", F.col("text").cast("binary").alias("text")), 40)
    low = [(t or "").encode().lower().split() for t in texts]
    frequent = [w for w, _ in sorted({w: sum(ws.count(w) for ws in low) for w in {w for ws in low for w in ws}}.items(), key=lambda x: (-x[1], x[0]))[:40]]

    def leaf(w):
        return frequent.index(w) if w in frequent else 40 + xxhash.xxh64_intdigest(w, 17) % masked_lm.SHARED

    def around(ws, k):
        at = [masked_lm.END if not 0 <= j < len(ws) else int(model.klass[leaf(ws[j])]) for j in range(k - 2, k + 3)]
        g = [0 if c < masked_lm.OWN else 1 if c < masked_lm.END else 2 for c in at]
        return ((g[0] * masked_lm.CLASSES + at[1]) * masked_lm.CLASSES + at[3]) * masked_lm.GROUPS + g[4], at[1], at[3]

    def of_leaf(x, context, left, right):
        k = model.klass[x]
        return model.table[context, k] + model.before[x, left] + model.after[x, right] - model.norm[k, left, right]

    def network(ws, k):
        value = of_leaf(leaf(ws[k]), *around(ws, k))
        if leaf(ws[k]) >= 40:
            raw = b"\0" + ws[k] + b"\0"
            value += sum(model.bigrams[x * 256 + y] for x, y in zip(raw, raw[1:], strict=False)) + np.log(masked_lm.SHARED)
        return float(min(0.0, value))

    got = {r.doc_id: r for r in masked_lm.pseudo_likelihood(docs, vocabulary=40).collect()}
    for k, ws in enumerate(low):
        assert got[k].n_words == len(ws) and abs(got[k].log_likelihood - sum(network(ws, j) for j in range(len(ws)))) <= 1e-4 * len(ws) + 1e-9
    whole = sum(np.exp(of_leaf(x, *around(low[0], 0))) for x in range(40 + masked_lm.SHARED))
    classes = np.exp(model.table[around(low[0], 0)[0]])[sorted({int(k) for k in model.klass})].sum()
    assert abs(whole - classes) < 1e-3


def test_words_of_a_class_are_a_distribution_that_the_corpus_fits():
    rng = np.random.default_rng(3)
    leaves, n = masked_lm.OWN + 70, masked_lm.CLASSES
    klass = np.concatenate([np.arange(masked_lm.OWN), rng.integers(masked_lm.OWN, masked_lm.END, 70)])
    # Words that prefer a class before them, or one after them, in windows whose sides go together.
    taste, seen = rng.gamma(0.3, 1.0, (2, leaves, n)), np.zeros((leaves, n, n))
    for k in range(masked_lm.END):
        mine = np.flatnonzero(klass == k)
        for left, right in rng.integers(0, n, (300, 2)) if len(mine) else []:
            right = left if rng.random() < 0.5 else right
            p = taste[0][mine, left] * taste[1][mine, right] + 1e-9
            seen[rng.choice(mine, p=p / p.sum()), left, right] += 10
    joint = np.zeros((n, n, n))
    np.add.at(joint, klass, seen)
    sides = np.stack([seen.sum(axis=2), seen.sum(axis=1)])

    def loss(rounds):
        before, after, norm = masked_lm.word_layer(sides, klass, joint, rounds)
        logp = before[:, :, None] + after[:, None, :] - norm[klass]
        for k in range(masked_lm.END):
            mine = np.flatnonzero(klass == k)
            if len(mine):
                assert np.allclose(np.exp(logp[mine]).sum(axis=0), 1, atol=1e-3)
        return float(-(seen * logp).sum() / seen.sum())

    assert loss(12) < loss(3) < loss(0)  # both sides' own shares, then trained


def test_vocabulary_is_filled_up_among_equal_counts(spark):
    counts = spark.createDataFrame([(f"w{k:02}".encode(), 7) for k in range(30)], "word binary, n long")
    assert [w for w, _ in masked_lm.frequent(counts, 20)] == [f"w{k:02}".encode() for k in range(20)]
    assert masked_lm.frequent(counts.limit(0), 20) == [] and len(masked_lm.frequent(counts, 99)) == 30


def test_what_is_gathered_follows_the_corpus(spark):
    few, many = frame(spark, ["a b c"] * 50), frame(spark, [f"a{k} b c" for k in range(50)])
    counts = lambda docs: masked_lm.word_counts(docs.select("doc_id", F.col("text").cast("binary").alias("text"))).collect()
    assert len(counts(few)) == 3 and len(counts(many)) == 52 and sum(r.n for r in counts(many)) == 150


def test_network_gradient_and_repeatability():
    counts = np.zeros((masked_lm.CONTEXTS, masked_lm.CLASSES))
    rng = np.random.default_rng(2)
    rows = rng.choice(masked_lm.CONTEXTS, 50, replace=False)
    counts[rows, rng.integers(0, masked_lm.CLASSES, 50)] = 5
    a, b = masked_lm.train(counts, 40), masked_lm.train(counts, 40)
    assert all((a.p[k] == b.p[k]).all() for k in a.p)
    assert a.step(rows, counts[rows], 0.0) < np.log(masked_lm.CLASSES) / 2


def test_pseudo_likelihood_edges(spark):
    got = masked_lm.pseudo_likelihood(odd(spark)).collect()
    assert len(got) == 11 and [r.per_word for r in got if r.doc_id in (1, 2, 3)] == [None] * 3 and masked_lm.pseudo_likelihood(frame(spark, [])).collect() == []
