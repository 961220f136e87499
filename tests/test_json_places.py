"""Places of JSON values, against the standard decoder and against plain counting."""

import json
import random

import pytest

from quietus.functions import jsonpos
from quietus.functions.text import StrictJSONError, strict_json
from quietus.sources import manifests


def drawn(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 5)
    if kind == 0:
        return rng.choice([0, -1, 2.5, 1e30, 12345678901234567890])
    if kind == 1:
        return rng.choice([True, False, None])
    if kind < 5:
        return "".join(rng.choices('ab/~"\\\né\U0001f600 ,:{}[]', k=rng.randrange(6)))
    if kind < 7:
        return {"".join(rng.choices("ab/~\U0001f600", k=3)): drawn(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [drawn(rng, depth + 1) for _ in range(rng.randrange(4))]


def at(value, pointer):
    for segment in pointer.split("/")[1:]:
        value = value[int(segment)] if isinstance(value, list) else value[segment.replace("~1", "/").replace("~0", "~")]
    return value


def count(value):
    return 1 + sum(map(count, value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()))


@pytest.mark.parametrize("seed", range(40))
def test_each_value_stands_where_its_text_does(seed):
    rng = random.Random(seed)
    value = drawn(rng)
    text = json.dumps(value, ensure_ascii=rng.random() < 0.3, indent=rng.choice([None, 1, "\t"]))
    rows = jsonpos.values(text)
    assert len(rows) == count(value)
    for r in rows:
        assert json.loads(text[r["start"] : r["end"]]) == at(value, r["pointer"])
        if r["kind"] == "string":
            assert r["value"] == at(value, r["pointer"])
        if r["name_start"] is not None:
            assert text[r["name_start"]] == '"' and r["name_start"] < r["start"]
    for r in jsonpos.placed(text)["values"]:
        own = next(v for v in rows if v["pointer"] == r["pointer"])
        before = text[: own["start"] if own["name_start"] is None else own["name_start"]]
        assert (r["line"], r["col"]) == (before.count("\n") + 1, len(before.rsplit("\n", 1)[-1].encode("utf-16-le")) // 2 + 1)


@pytest.mark.parametrize("seed", range(60))
def test_refuses_what_the_strict_decoder_refuses(seed):
    rng = random.Random(seed)
    text = list(json.dumps(drawn(rng)))
    for _ in range(rng.randrange(1, 3)):
        k = rng.randrange(len(text))
        text[k] = rng.choice(["", ",", "}", "]", '"', "1", ":", "\\", "x", "\n"])
    text = "".join(text)
    try:
        strict_json(text)
        fine = True
    except StrictJSONError:
        fine = False
    if fine:
        assert jsonpos.values(text)
    else:
        with pytest.raises(jsonpos.Fault):
            jsonpos.values(text)


@pytest.mark.parametrize("text, line, col", [("", 1, 1), ("{", 1, 2), ('{\n "a": 1,\n "a": 2}', 3, 2), ("[1,]", 1, 4), ("[1 2]", 1, 4), ("1 1", 1, 3), ("NaN", 1, 1), ('{"\U0001f600": x}', 1, 8), ("[" * 65, 1, 65), ("}", 1, 1), ("[}", 1, 2), ('{"a":}', 1, 6), ('{"a",', 1, 5)])
def test_faults_have_places(text, line, col):
    fault = jsonpos.placed(text)["fault"]
    assert (fault["line"], fault["col"]) == (line, col)


def test_halves_of_pairs_are_replaced(spark):
    docs = spark.createDataFrame([("a", '{"\\ud800": "\\ude00x\\ud83d\\ude00"}')], "path string, text string")
    assert [(r.pointer, r.value) for r in manifests.json_values(docs).collect()] == [("", None), ("/\ufffd", "\ufffdx\U0001f600")]


def test_long_documents_take_linear_time():
    text = "[" + ",".join(['"' + "x" * 20 + '"'] * 200_000) + "]"
    assert jsonpos.placed(text)["values"][-1]["col"] == 2 + 199_999 * 23


def test_rows_of_documents(spark):
    docs = spark.createDataFrame([("a/package.json", '{"dependencies": {"@s/x": "1",\n"y": "2"}, "peerDependencies": {"z": "3"}}'), ("ignore.json", '{"ignore": [{"code": "A"},\n  {"code": "B"}]}'), ("bad.json", "{"), ("none.json", None), ("package.json", '{"dependencies": {"y": 1, "w": {"v": "1"}}}')], "path string, text string")
    assert {tuple(r) for r in manifests.declared_sites(docs).collect()} == {("a/package.json", "@s/x", "dependencies", "1", 1, 19), ("a/package.json", "y", "dependencies", "2", 2, 1), ("package.json", "y", "dependencies", None, 1, 19), ("package.json", "w", "dependencies", None, 1, 27)}
    assert [tuple(r) for r in manifests.entry_sites(docs, "ignore").orderBy("record_ord").collect()] == [("ignore.json", 0, 1, 13), ("ignore.json", 1, 2, 3)]
    assert [tuple(r)[:3] for r in manifests.json_faults(docs).collect()] == [("bad.json", 1, 2)]
    assert manifests.json_values(docs.limit(0)).isEmpty()
