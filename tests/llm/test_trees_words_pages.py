"""Merkle manifests, spelling variants and main texts against plain Python, and their edge cases."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quietus.llm import dom, merkle, spelling, wrapper

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, lowered: bool = False) -> str:
    text = row["text"]
    if lowered and text is not None:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_manifest(rows: list[dict]) -> Counter:
    groups = defaultdict(list)
    for row in rows:
        groups[row["source"]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))

    def levels(leaves):
        out = [leaves]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
        return out

    def path(tree, k):
        out = []
        for level in tree[:-1]:
            run, at = level[k // 16 * 16 :][:16], k % 16
            out.append(("".join(run[:at]), "".join(run[at + 1 :])))
            k //= 16
        return out

    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
    trees = {name: levels([plain_leaf(r) for r in groups[name]]) for name in names}
    top = levels([trees[name][-1][0] for name in names]) if names else [[None]]
    out = Counter()
    for j, name in enumerate(names):
        for k, row in enumerate(groups[name]):
            steps = path(trees[name], k) + path(top, j)
            end = plain_leaf(row, row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)
            for before, after in steps:
                end = h(before, end, after)
            root = top[-1][0]
            out[row["doc_id"], plain_leaf(row), trees[name][-1][0], root, h(*[x for s in steps for x in s]), end, end == root] += 1
    return out


def found(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


def drawn(n: int, seed: int) -> list[dict]:
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        source = "hot" if draw.random() < 0.4 else draw.choice(["a", "b-é", "", "s9", None, f"own{k}"])
        rows.append({"doc_id": draw.choice([k, k, k, k, None, 7]), "text": draw.choice([None, "", "Some Text Ü", f"word {k}"]), "lang": draw.choice([None, "en"]), "source": source, "n_chars": draw.choice([None, k])})
    return rows + rows[:3]


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)


@pytest.mark.parametrize("n", [0, 1, 17, 700])
def test_manifest_is_the_plain_trees(spark, n):
    rows = drawn(n, n) if n else []
    assert found(merkle.manifest(frame(spark, rows).repartition(5))) == plain_manifest(rows)


def test_manifest_finishes_parents_over_many_tasks_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FIRST_SPAN", 1)
    monkeypatch.setattr(merkle, "SPAN_STEP", 1)
    rows = [{"doc_id": k, "text": f"t{k}", "lang": None, "source": "one", "n_chars": 1} for k in range(4200)]
    leaves = merkle.ranked(frame(spark, rows).selectExpr("'g' as g", "doc_id as id", "sha2(text, 256) as digest", "cast(doc_id as string) as key", "cast(null as string) as other"), ["id"])
    made = merkle.runs(leaves.repartition(9))  # leaves of a run are in different tasks
    level = [h(f"t{k}") for k in range(4200)]
    while len(level) > 1:
        level = [h(*level[k : k + 16]) for k in range(0, len(level), 16)]
    assert [r["digest"] for r in made.where("last").collect()] == level
    assert made.count() == 263 + 17 + 2 + 1


def test_manifest_leaves_further_columns_aside(spark):
    rows = drawn(60, 3)
    docs = frame(spark, rows)
    more = docs.selectExpr("*", "'x' as g", "1 as idx", "2 as n", "'y' as key", "'z' as other", "3 as r_part", "'d' as digest", "4 as id")
    assert found(merkle.manifest(more)) == plain_manifest(rows)


def plain_variants(rows: list[dict]) -> set:
    n: Counter = Counter()
    for row in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", row["text"] or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), word)
            at = zlib.crc32(f"{'' if row['doc_id'] is None else row['doc_id']}:{word}".encode())
            n[word[: at % len(word)] + word[at % len(word) + 1 :] if at % 97 == 0 else word] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def close(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in n if v != w and close(v, w)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def test_variants_are_those_of_all_pairs(spark):
    draw = random.Random(5)
    stems = ["".join(draw.choice("aabtné") for _ in range(draw.randint(5, 9))) for _ in range(60)] + ["lalalala", "lalalal", "aaaaaa", "aaaaa", "aaaaaaa"]

    def slip(w):
        k = draw.randrange(len(w))
        return draw.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + draw.choice("abté") + w[k:], w[:k] + draw.choice("abté") + w[k + 1 :], w.upper(), w.title()])

    texts = [" ".join(slip(draw.choice(stems)) for _ in range(draw.randint(0, 120))) for _ in range(150)]
    rows = [{"doc_id": k, "text": t, "lang": None, "source": None, "n_chars": 0} for k, t in enumerate(texts)]
    rows += [{"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None}, {"doc_id": None, "text": "naïveté×÷ naïveté×÷ NAïVETé×÷ 日本naïveté", "lang": None, "source": None, "n_chars": None}, rows[0], {"doc_id": 900, "text": "mandate " * 3 + "mandates " * 7 + "mandatess " * 20, "lang": None, "source": None, "n_chars": 0}, {"doc_id": 3, "text": "", "lang": None, "source": None, "n_chars": 0}]
    docs = frame(spark, rows).selectExpr("*", "1 as n", "'x' as word", "2 as at", "'y' as form")
    got = spelling.variants(docs).collect()
    assert len(got) == len({r["word"] for r in got})
    assert {tuple(r) for r in got} == plain_variants(rows)
    assert any(r["root"] not in (r["word"], r["form"]) for r in got)  # a chain of forms


def test_variants_of_empty_tables_and_one_word(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    rows = [{"doc_id": 1, "text": "never never never " * 400, "lang": None, "source": None, "n_chars": 0}]
    assert {tuple(r) for r in spelling.variants(frame(spark, rows)).collect()} == plain_variants(rows)


def test_words_meet_without_a_broadcast_however_small_they_look(spark):
    words = spark.createDataFrame([("absent", 9), ("absen", 3), ("resent", 4)], "word string, n long")
    pairs = spelling.near(words)
    assert {tuple(r) for r in pairs.collect()} == {("absen", "absent")}
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_words_lose_the_stated_code_point():
    hit = next(k for k in range(10_000) if zlib.crc32(f"{k}:café".encode()) % 97 == 0)
    at = zlib.crc32(f"{hit}:café".encode()) % 4
    assert spelling.words_of("Café", hit) == {("café"[:at] + "café"[at + 1 :]).encode("latin-1"): 1}
    assert spelling.words_of(None, None) == {}


def texts(spark, rows) -> dict:
    pages = spark.createDataFrame([(k, url, page) for k, (url, page) in enumerate(rows)], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in wrapper.main_text(pages).collect()}
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out.values())
    return {k: r["text"] for k, r in out.items()}


def test_main_text_of_all_pages_is_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(pages).collect()}
    for r in pages.collect():
        parts = re.split(r"</?(?:h1|p)>", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1])
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts]
        assert got[r["page_id"]] == "\n".join(w for w in want if w)


def sentences(draw, n):
    return [" ".join(draw.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(draw.randrange(99)) for _ in range(draw.randint(8, 30))) + "." for _ in range(n)]


def test_slots_that_vary_are_the_text_where_no_names_help(spark):
    draw, rows, want = random.Random(1), [], []
    for k in range(12):
        body = sentences(draw, draw.randint(2, 7))
        want.append("\n".join([f"Title {k}", *body]))
        menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in ("home", "world", "sport", f"topic{k}"))
        rows.append((f"http://x.org/{k}", f"<body><div>Site of the year</div><div><ul>{menu}</ul></div><div><div><h1>Title {k}</h1><div>" + "".join(f"<p>{b}</p>" for b in body) + "</div><div>All views are the author's own.</div></div></div><div>Made by us &copy; 2020</div>"))
    got = texts(spark, rows)
    assert [got[k] for k in range(12)] == want


def test_named_parts_go_in_every_make_of_page(spark):
    draw, rows, want = random.Random(2), [], []
    frames = [
        "<header><h2>Site {k}</h2></header><nav><a href=x>a {k}</a></nav><main><article><header><h1>{t}</h1></header>{b}<div class='ad-box ad'>Buy {k}</div><section id=comments><h3>Comments {k}</h3><article><p>{c}</p><p>{c}</p></article></section></article></main><aside>side {k}</aside><footer>f {k}</footer>",
        "<div id=page class=has-sidebar><div role=banner>top {k}</div><div class='sidebar left'>{c}</div><div id=content><h1>{t}</h1>{b}</div><div class=cookie-notice>We use cookies {k}</div><form><label>Mail {k}</label><input></form><ul class=comment-list><li>{c}</li><li>{c}{c}</li></ul></div>",
        "<form id=aspnetForm><div class=menu>m {k}</div><div><h1>{t}</h1><div>{b}</div></div></form>",
    ]
    for j, make in enumerate(frames):
        for k in range(7):
            body = sentences(draw, draw.randint(3, 6))
            want.append("\n".join([f"T{k} of {j}", *body]))
            rows.append((f"https://h{j}.net/p{k}", "<html><head><title>no</title></head><body>" + make.format(k=k, t=f"T{k} of {j}", b="".join(f"<p>{x}" for x in body), c=sentences(draw, 1)[0]) + "<script>x('<p>no</p>')</script>"))
    got = texts(spark, rows)
    assert [got[k] for k in range(len(rows))] == want


def test_edge_pages(spark):
    rows = [
        (None, None),
        ("", ""),
        ("http://a.b/", "<article><h1>A&amp;B &lt;c&gt; &am</h1><p>one<br>two\n\t three<p>  <b>four</b>five&nbsp;&#233;</p><!-- no --><ul><li>x<li>y</ul>tail</article>"),
        ("http://a.b/", "plain words only"),
        ("http://a.b/c", "<nav>only a menu</nav><footer>end</footer>"),
        ("http://a.b/d", "<article><p>open <a href=\"x>y</p><p>never closed <b"),
        ("http://a.b/e", "<div>" * 3000 + "deep" + "</div>" * 10),
        ("http://a.b/f", "<article><p>" + "long " * 200_000 + "</p></article>"),
        ("http://a.b/f", "<article><p>same</p></article>"),
        ("http://a.b/f", "<article><p>same</p></article>"),
    ]
    got = texts(spark, rows)
    assert got[0] == got[1] == got[4] == ""
    assert got[2] == "A&B <c> &am\none two three\nfourfive é\nx\ny\ntail"
    assert got[3] == "plain words only" and got[6] == "deep"
    assert got[7] == ("long " * 200_000).strip() and got[8] == got[9] == "same"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert wrapper.main_text(empty).count() == 0
    more = spark.createDataFrame([(1, "http://a.b/", "<p>x</p>", "t", 9, "k")], "page_id long, url string, html string, text string, host long, name string")
    assert [tuple(r) for r in wrapper.main_text(more).collect()] == [(1, "http://a.b/", "x", 1)]


def test_templates_of_very_many_makes_merge_in_groups(spark):
    rows = []
    for k in range(120):
        extra = "".join(f"<div class=x{chr(97 + (k >> b & 1) * 13 + b)}>w{k} {b}</div>" for b in range(7))
        rows.append(("http://many.org/", f"<div class=top>Same top</div>{extra}<article><h1>H{k}</h1><p>text {k}</p><div class=note>Same note</div></article>"))
    got = texts(spark, rows)
    assert all(got[k] == f"H{k}\ntext {k}" for k in range(120))


def test_copies_prove_no_wrapper(spark):
    rows = [("http://copy.org/", f"<p class=ad>{k}</p><article><h1>One title</h1><p>One text</p></article>") for k in range(9)]
    assert set(texts(spark, rows).values()) == {"One title\nOne text"}


def test_tree_matching_keeps_parents_and_order():
    def t(spec):
        return wrapper.tree([d for d, _ in spec], [wrapper.Node(x, 1, 0, 0, 0, 0) for _, x in spec])

    a = t([(0, "r"), (1, "a"), (2, "x"), (1, "b"), (1, "c")])
    b = t([(0, "r"), (1, "b"), (1, "a"), (2, "x"), (1, "c")])
    assert wrapper.matching(a, b, {}) == 4  # r, a, x, c
    both = wrapper.merged(a, b)
    assert [(d, x.label) for d, x in wrapper._flat(both)] == [(0, "r"), (1, "b"), (1, "a"), (2, "x"), (1, "b"), (1, "c")]
    again = wrapper.unpacked(wrapper.packed(both))
    assert wrapper.packed(again) == wrapper.packed(both) and again.size == 6


def test_reader_takes_time_in_proportion():
    import time

    for piece in ("<a ", "<!--", '<a href="', "<p>", "&amp", "<", "</", "<div class='", "<script>", "<a =''\"", "<li><ul>", "<table><tr><td>"):
        began = time.time()
        dom.skeleton(dom.read(piece * 20_000))
        assert time.time() - began < 5, piece
