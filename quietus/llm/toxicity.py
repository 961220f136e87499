"""Toxicity by a weighted finite-state pattern grammar.

Six transducers read a clause's words by class: insult and threat (weighted word and word-start arcs, fixed seeds and arcs learned from labelled rows), agent, target, negation and reported speech (fixed
lists). Each is a table of states; their composition is one table over states and word classes, built once. A clause is walked through it once, and whole matched clauses are scored, not isolated words:
an insult arc adds its weight to the channel of its state (plain, negated, reported), and what an insult clause weighs to another one if the clause has a target. A threat arc is a threat if an agent
comes before it and a target stands in its clause; without them it is loose. A document's channels pass through a logistic calibration.

A learned arc is a threat's if, in most toxic rows that have it, one of its clauses has an agent before it and a target after it; else an insult's.

Learning uses at most ``max_rows`` labelled rows of each class, those of smallest xxhash64 of the id. The calibration is fitted on channels that arcs of other rows give (three folds), so arcs are not
trusted more than they deserve. Texts stay where they lie: what is brought together of a row is its distinct words, then its channels. Scoring reads every whole text, in time linear in its length.

Edge cases: null and empty texts match nothing and get the score of a text without any matched clause; rows without a label are scored like others;
null labels and labels of unknown documents are not learned from; without rows of both classes the seeds and default calibration stand;
repeated rows are scored each; an empty table gives no rows; further columns are left aside.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Seeds of the transducers: fixed values.
INSULTS = "idiot moron scum imbecile bastard trottel abschaum arschloch connard salaud imbécile cabrón gilipollas".split()
THREATS = "kill murder strangle töten umbringen tuer égorger matar asesinar".split()
AGENTS = set("i we ich wir je j nous yo nosotros".split())
TARGETS = set("you your yours he she they them him her u du dich dir ihr euch er sie tu toi te vous il elle ils vosotros usted tú ti él ella ellos".split())
NEGATIONS = set("not no never neither nor cannot nicht kein keine nie niemals pas jamais aucun ni nunca jamás tampoco".split())
REPORTING = set("said says wrote writes called quoted reported claimed sagte schrieb behauptete dit écrit déclaré dijo escribió afirmó".split())
#: Words that a negation reaches.
REACH = 3

_WORD = re.compile(r"[^\W\d_]+")
_STOP = re.compile(r"[.!?;:\n]")
CHANNELS = ["insult", "insult_negated", "insult_reported", "insult_targeted", "threat", "threat_negated", "threat_reported", "threat_loose", "strongest", "clauses"]
#: Calibration where there is nothing to learn from; first the bias.
DEFAULT = [-3.0, 0.8, 0.3, 0.3, 0.3, 1.0, 0.3, 0.3, 0.3, 0.5, 0.5]
#: Word classes that move states; a word may be of several.
OTHER, AGENT, TARGET, NEGATION, REPORT = 0, 1, 2, 4, 8
#: Folds of the calibration.
FOLDS = 3


def _class_of(word: str) -> int:
    return AGENT * (word in AGENTS) | TARGET * (word in TARGETS) | NEGATION * (word in NEGATIONS) | REPORT * (word in REPORTING)


# Each transducer: states 0.., and the state that a word class leads to from each.
_NEGATION = [[REACH if c & NEGATION else max(0, s - 1) for c in range(16)] for s in range(REACH + 1)]
_ONCE = {bit: [[int(s or bool(c & bit)) for c in range(16)] for s in range(2)] for bit in (AGENT, TARGET, REPORT)}
#: Products of states: (negation, agent, target, report), and the composed table [state][word class].
STATES = list(product(range(REACH + 1), range(2), range(2), range(2)))
_AT = {state: k for k, state in enumerate(STATES)}
COMPOSED = [[_AT[(_NEGATION[n][c], _ONCE[AGENT][a][c], _ONCE[TARGET][t][c], _ONCE[REPORT][r][c])] for c in range(16)] for n, a, t, r in STATES]


@dataclass
class Grammar:
    """Word arcs end with a blank, word-start arcs do not."""

    insult: dict[str, float] = field(default_factory=lambda: {f"{w} ": 2.5 for w in INSULTS})
    threat: dict[str, float] = field(default_factory=lambda: {f"{w} ": 2.0 for w in THREATS})
    calibration: list[float] = field(default_factory=lambda: list(DEFAULT))

    def __post_init__(self) -> None:
        # Of an arc's text: (length, weights of its word and word-start arcs as insult, then as threat).
        self.machine = ahocorasick.Automaton()
        held: dict[str, list[float]] = {}
        for k, arcs in enumerate((self.insult, self.threat)):
            for arc, weight in arcs.items():
                text = arc.rstrip(" ")
                place = 2 * k + (arc == text)
                weights = held.setdefault(text, [0.0] * 4)
                weights[place] = max(weights[place], weight)
        for text, weights in held.items():
            self.machine.add_word(text, (len(text), *weights))
        if held:
            self.machine.make_automaton()

    def arcs(self, low: str) -> dict[int, tuple[float, float]]:
        """Start of each word that an insult or threat arc takes -> the largest weights of its arcs, as insult and as threat."""
        out: dict[int, tuple[float, float]] = {}
        for last, (length, *weights) in self.machine.iter(low) if len(self.machine) else ():
            start = last - length + 1
            if start and low[start - 1].isalpha():
                continue
            insult, threat = weights[1::2] if last + 1 < len(low) and low[last + 1].isalpha() else (max(weights[:2]), max(weights[2:]))
            if insult or threat:
                before = out.get(start, (0.0, 0.0))
                out[start] = (max(before[0], insult), max(before[1], threat))
        return out

    def channels(self, text: str) -> list[float]:
        low = text.lower()
        arcs = self.arcs(low)
        sums, strongest, clauses, end = dict.fromkeys(CHANNELS[:8], 0.0), 0.0, 0, -1
        stops = [m.start() for m in _STOP.finditer(low)] if arcs else []
        for start in sorted(arcs):
            if start < end:
                continue
            k = bisect_left(stops, start)
            begin, end = stops[k - 1] + 1 if k else 0, stops[k] if k < len(stops) else len(low)
            clause = self.clause(low, begin, end, arcs)
            for channel, value in clause.items():
                sums[channel] += value
            strongest, clauses = max(strongest, sum(clause.values())), clauses + 1
        return [*(math.log1p(v) for v in sums.values()), strongest, math.log1p(clauses)]

    @staticmethod
    def clause(low: str, begin: int, end: int, arcs: dict[int, tuple[float, float]]) -> dict[str, float]:
        """One walk of the composed transducers over a clause."""
        out, state, threats = dict.fromkeys(CHANNELS[:8], 0.0), 0, []
        for m in _WORD.finditer(low, begin, end):
            if m.start() in arcs:
                insult, threat = arcs[m.start()]
                negated, agent, _, reported = STATES[state]
                how = "_reported" if reported else "_negated" if negated else ""
                out[f"insult{how}"] += insult
                if threat:
                    threats.append((threat, how, agent))
            state = COMPOSED[state][_class_of(m[0])]
        if STATES[state][2]:
            out["insult_targeted"] = out["insult"] + out["insult_negated"] + out["insult_reported"]
        for weight, how, agent in threats:
            out[f"threat{how}" if agent and STATES[state][2] else "threat_loose"] += weight
        return out

    def score(self, text: str | None) -> float:
        bias, *slopes = self.calibration
        z = bias + sum(a * b for a, b in zip(slopes, self.channels(text or ""), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def words_and_frames(text: str) -> tuple[set[str], set[str]]:
    """(the distinct words of a text, those that stand in a clause after an agent and before a target)."""
    words, framed = set(), set()
    for clause in _STOP.split(text.lower()):
        found = _WORD.findall(clause)
        words.update(found)
        classes = [_class_of(w) for w in found]
        first = next((k for k, c in enumerate(classes) if c & AGENT), None)
        last = next((k for k in range(len(classes) - 1, -1, -1) if classes[k] & TARGET), None)
        if first is not None and last is not None:
            framed.update(found[first + 1 : last])
    return words, framed


def _starts(word: str) -> Iterator[str]:
    yield f"{word} "
    for n in range(3, min(7, len(word)) + 1):
        yield word[:n]


def distinct_rows(words: list[set[str]], hashes: int = 16, alike: int = 10) -> list[int]:
    """Rows of which no earlier kept one is a near copy (``alike`` of ``hashes`` minimum word hashes are equal): copies are no independent evidence."""
    odd = np.arange(1, 2 * hashes, 2, dtype=np.uint32)[:, None] * np.uint32(0x9E3779B1) | np.uint32(1)
    holders: dict[tuple[int, int], list[int]] = {}
    out = []
    for row, held in enumerate(words):
        h = np.fromiter((zlib.crc32(w.encode()) for w in held), np.uint32, len(held))
        keys = list(enumerate((((h ^ (h >> 15)) * odd) ^ (h >> 7)).min(axis=1).tolist())) if len(h) else []
        shared = Counter(other for key in keys for other in holders.get(key, ()))
        if shared and max(shared.values()) >= alike:
            continue
        out.append(row)
        for key in keys:
            holders.setdefault(key, []).append(row)
    return out


def _llr(p: int, n: int, n_pos: int, n_neg: int) -> float:
    if p * n_neg <= 6 * n * n_pos:
        return 0.0
    rate = (p + n) / (n_pos + n_neg)
    return 2 * (p * math.log(p / (n_pos * rate)) + (n * math.log(n / (n_neg * rate)) if n else 0))


def learn_arcs(words: list[set[str]], toxic: np.ndarray, least: float = 16.0, share: float = 0.01) -> dict[str, float]:
    """Word and word-start arcs that toxic rows hold far more often than others, with log odds as weights.

    An arc needs a likelihood ratio of ``least`` and 3 toxic rows or a ``share`` of them, on words that no stronger arc takes already.
    """
    held: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})
    for row, found in enumerate(words):
        for w in found:
            held[int(toxic[row])].setdefault(w, []).append(row)
    others, rows_of = held
    n_pos, n_neg = int(toxic.sum()), int((~toxic).sum())
    support = max(3, share * n_pos)
    by_arc: dict[str, list[str]] = {}
    for w in rows_of.keys() | others.keys():
        for arc in _starts(w):
            by_arc.setdefault(arc, []).append(w)

    def count(arc: str, taken: set[str]) -> tuple[int, int]:
        left = [w for w in by_arc[arc] if w not in taken]
        return tuple(len({row for w in left for row in of.get(w, ())}) for of in (rows_of, others))

    ranked = []
    for arc, of in by_arc.items():
        if sum(len(rows_of.get(w, ())) for w in of) >= support:
            p, n = count(arc, set())
            if p >= support and (llr := _llr(p, n, n_pos, n_neg)) >= least:
                ranked.append((-llr, -len(arc), arc))
    arcs: dict[str, float] = {}
    taken: set[str] = set()
    for _, _, arc in sorted(ranked):
        p, n = count(arc, taken)
        if p >= support and _llr(p, n, n_pos, n_neg) >= least:
            # The longest start that keeps nearly all toxic rows is the safest for clean ones.
            while longer := [(count(x, taken), x) for x in {w[: len(arc) + 1] for w in by_arc[arc] if w not in taken} if x in by_arc and len(x) > len(arc)]:
                (p_longer, n_longer), at = max(longer)
                if p_longer < 0.95 * p:
                    break
                arc, p, n = at, p_longer, n_longer
            arcs[arc] = min(6.0, math.log((p + 0.5) / (n_pos + 1)) - math.log((n + 0.5) / (n_neg + 1)))
            taken.update(by_arc[arc])
    return arcs


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> list[float]:
    """Ridge logistic regression by Newton steps; bias first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def split_arcs(arcs: dict[str, float], words: list[set[str]], framed: list[set[str]]) -> tuple[dict[str, float], dict[str, float]]:
    """(insult arcs, threat arcs) of learned ``arcs``, by how most of the toxic rows that have them use them."""
    insult, threat = {}, {}
    for arc, weight in arcs.items():
        takes = (lambda w, a=arc[:-1]: w == a) if arc.endswith(" ") else (lambda w, a=arc: w.startswith(a))
        has = [k for k, of in enumerate(words) if any(map(takes, of))]
        (threat if 2 * sum(any(map(takes, framed[k])) for k in has) > len(has) else insult)[arc] = weight
    return insult, threat


def learn(words: list[set[str]], framed: list[set[str]], toxic: np.ndarray) -> Grammar:
    """Seeds and learned arcs, from the distinct words of labelled rows; the calibration is the default one."""
    if not toxic.any() or toxic.all():
        return Grammar()
    own = distinct_rows(words)
    learned = learn_arcs([words[row] for row in own], toxic[own]) if toxic[own].any() and not toxic[own].all() else {}
    rows = [row for row in own if toxic[row]]
    insult, threat = split_arcs(learned, [words[row] for row in rows], [framed[row] for row in rows])
    common = {w for w, n in Counter(w for row in np.flatnonzero(~toxic) for w in words[row]).items() if n >= 3}
    seeds = Grammar()
    return Grammar({a: w for a, w in seeds.insult.items() if a.strip() not in common} | insult, {a: w for a, w in seeds.threat.items() if a.strip() not in common} | threat)


def fold_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) // 3 % FOLDS


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int = 3000) -> Grammar:
    """Learn from at most ``max_rows`` labelled rows of each class. One task gets their distinct words, the driver arcs and the rows' channels."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]).distinct())  # 2 * max_rows short rows at most
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id").select("doc_id", "y", "text")

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_and_frames(text.as_py() or "") for text in batch.column(2)]
            lists = [pa.array([sorted(f[k]) for f in found], pa.list_(pa.string())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "y", "words", "framed"])

    def learned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([pd.DataFrame({"doc_id": [], "y": [], "words": [], "framed": []}), *frames])
        pdf = pdf.assign(size=pdf["words"].map(len), first=pdf["words"].map(lambda w: "".join(w[:8]))).sort_values(["doc_id", "y", "size", "first"], kind="stable")
        words, framed = ([set(x) for x in pdf[c]] for c in ("words", "framed"))
        toxic, fold = (pdf["y"] == 1).to_numpy(bool), np.array([fold_of(int(k)) for k in pdf["doc_id"]], int)
        for k in range(-1, FOLDS):  # -1: all rows; else all but those of the fold
            at = np.flatnonzero(fold != k)
            g = learn([words[i] for i in at], [framed[i] for i in at], toxic[at])
            yield pd.DataFrame([(k, part, a, w) for part, arcs in (("insult", g.insult), ("threat", g.threat)) for a, w in arcs.items()], columns=["fold", "part", "arc", "weight"])

    got = rows.mapInArrow(reduced, "doc_id long, y int, words array<string>, framed array<string>").repartition(1).mapInPandas(learned, "fold int, part string, arc string, weight double").toPandas()
    if not len(got):
        return Grammar()
    arcs = {k: tuple(dict(zip(g["arc"][g["part"] == part], g["weight"][g["part"] == part], strict=True)) for part in ("insult", "threat")) for k, g in got.groupby("fold")}

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammars = {k: Grammar(*of) for k, of in arcs.items()}
        for batch in batches:
            found = [grammars[fold_of(k)].channels(text.as_py() or "") for k, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    seen = rows.mapInArrow(measured, "doc_id long, y int, x array<double>").toPandas()  # a short row for each labelled one
    y = (seen["y"] == 1).to_numpy(float)
    insult, threat = arcs[-1]
    if not len(seen) or not y.any() or y.all():
        return Grammar(insult, threat)
    x = np.array(seen["x"].tolist())
    order = np.lexsort((*x.T, y, seen["doc_id"].to_numpy()))  # one order of summation, however rows came
    return Grammar(insult, threat, calibrate(x[order], y[order]))


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, max_rows: int = 3000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. Labels of held-out ids (crc32 mod 3 is 1) are never learned from."""
    seen = labels.where(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 3 != 1)
    grammar = train(docs, seen, id_col, text_col, label_col, max_rows)
    model = (grammar.insult, grammar.threat, grammar.calibration)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Grammar(*model)
        for batch in batches:
            ids = batch.column(0)
            scores = [scorer.score(text.as_py()) for text in batch.column(1)]
            cols = [ids, pa.array([held_out(i) for i in ids.to_pylist()]), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
