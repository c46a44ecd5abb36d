"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, utf8, words
from .simhash import fingerprint

#: Labelled rows that the lexicon and the weights are learned from, at most, by label.
MAX_TOXIC, MAX_CLEAN = 3_000, 9_000
#: A word or word beginning enters the lexicon if so few clean rows have it for each toxic one, if so many toxic
#: rows have it, and if toxic rows have it so much more often than clean ones that about one of all terms tried
#: would by chance. Labels too few to be that clear about any term are taken at ``WEAKEST``.
MAX_CLEAN_SHARE, MIN_ROWS, WEAKEST = 0.06, 3, 0.05
#: Rows whose SimHashes differ in at most so many of 64 bits are copies and count once; unrelated ones differ in about 32.
COPY_BITS = 10
#: Lengths of word beginnings, in bytes.
STEMS = (4, 5, 6)

# Fixed word lists of the grammar; insults are learned.
THREATS = ("kill", "hurt", "beat", "destroy", "töten", "schlagen", "tuer", "frapper", "matar", "golpear")
TARGETS = ("you", "your", "he", "she", "they", "du", "dich", "dein", "tu", "toi", "vous", "tú", "usted")
NEGATIONS = ("not", "never", "no", "nicht", "kein", "nie", "ne", "pas", "jamais", "nunca")
REPORTS = ("said", "says", "told", "wrote", "called", "quoted", "sagte", "schrieb", "dit", "dijo", "escribió")

_CLAUSE = re.compile(rb"[.!?;:\n\r]+")


class Transducer:
    """A deterministic finite-state transducer with weights over symbols; a missing arc copies the
    symbol and keeps the state. The weights are those of the matches that it writes."""

    def __init__(self, arcs: dict[tuple, tuple], start=0):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol: str) -> tuple:
        return self.arcs.get((state, symbol), (state, symbol))

    def then(self, other: Transducer, alphabet: tuple[str, ...]) -> Transducer:
        """The composition: what this one writes, the other one reads."""
        start = (self.start, other.start)
        arcs, todo, seen = {}, [start], {start}
        while todo:
            a, b = todo.pop()
            for symbol in alphabet:
                a2, middle = self.step(a, symbol)
                b2, out = other.step(b, middle)
                arcs[(a, b), symbol] = ((a2, b2), out)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return Transducer(arcs, start)


# Symbols read: insult, threat, target, negation, report, other word. Written: the first two with marks.
READ = ("I", "T", "P", "N", "R", "o")
SCOPE = 3  # words that a negation reaches


def grammar() -> Transducer:
    """Insult and threat over target over negation over reported speech, as one transducer.

    An insult or threat is written as its kind and marks: ``p`` after a target word in the clause, ``n``
    within the reach of a negation, ``r`` after a word of report. Other symbols are written as ``o``.
    """
    events = Transducer({(0, "I"): (0, "I"), (0, "T"): (0, "T")})
    target = Transducer({(0, "P"): (1, "P"), (1, "I"): (1, "Ip"), (1, "T"): (1, "Tp")})
    kinds = ("I", "T", "Ip", "Tp")
    negation = {(s, "N"): (SCOPE, "N") for s in range(SCOPE + 1)}
    for s in range(1, SCOPE + 1):
        negation |= {(s, x): (s - 1, x) for x in ("o", "P", "R")} | {(s, k): (s - 1, k + "n") for k in kinds}
    marked = [k + n for k in kinds for n in ("", "n")]
    reported = {(0, "R"): (1, "R")} | {(1, k): (1, k + "r") for k in marked}
    machine = events.then(target, READ).then(Transducer(negation), READ)
    return machine.then(Transducer(reported), READ)


#: What the grammar writes for a match, and the weight each starts from before it is fitted.
MATCHES = tuple(k + p + n + r for k in "IT" for p in ("", "p") for n in ("", "n") for r in ("", "r"))
PRIOR = tuple(
    (3.0 if m[0] == "I" else 1.0) + ("p" in m) * 1.0 - ("n" in m) * 0.5 - ("r" in m) * 0.5 for m in MATCHES
)


class Grammar:
    """The composed machine with its lexicon."""

    def __init__(self, lexicon: list[bytes], stems: list[bytes]):
        fixed = (("T", THREATS), ("P", TARGETS), ("N", NEGATIONS), ("R", REPORTS))
        self.symbol = {w.encode(): s for s, ws in fixed for w in ws} | {w: "I" for w in lexicon}
        self.stems = frozenset(stems)
        self.machine = grammar()
        self.column = {m: i for i, m in enumerate(MATCHES)}

    def _classes(self, vocabulary: set[bytes]) -> dict[bytes, str]:
        """The symbols of those words that are more than other words."""
        symbol, stems = self.symbol, self.stems
        found = {w: symbol[w] for w in vocabulary & symbol.keys()}
        for n in STEMS:
            found |= {w: "I" for w in vocabulary if w[:n] in stems and len(w) >= n and w not in found}
        return found

    def matches(self, text: bytes) -> np.ndarray:
        """How often each match occurs, clause by clause."""
        counts = np.zeros(len(MATCHES))
        classes = self._classes(set(words(text)))
        if not {"I", "T"} & set(classes.values()):
            return counts
        step = self.machine.step
        for clause in _CLAUSE.split(text):
            state = self.machine.start
            for word in words(clause):
                state, out = step(state, classes.get(word, "o"))
                if out in self.column:
                    counts[self.column[out]] += 1
        return counts


def features(counts: np.ndarray) -> np.ndarray:
    """Several matches count less than so many times one."""
    return np.log2(1 + counts)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and bias of a logistic score, drawn to the prior by ``ridge``; Newton's method."""
    prior = np.array([*PRIOR, -3.0])
    x = np.hstack([x, np.ones((len(x), 1))])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * (w - prior)
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w -= change
        if np.abs(change).max() < 1e-9:
            break
    return w


def _stems(word: bytes) -> list[bytes]:
    return [word[:n] for n in STEMS if len(word) > n]


def held_out(id: str = "doc_id"):
    """Rows that nothing is learned from."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sample(labels: DataFrame, id: str, label: str) -> DataFrame:
    """A bounded set of labelled rows that are not held out, the first by a hash of the id. An id with
    several labels counts as toxic if one of them says so."""
    rows = labels.filter(F.col(id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id))
    rows = rows.groupBy(id).agg(F.max(label).alias("y")).withColumn("o", F.xxhash64(F.lit("sample"), id))
    parts = [rows.filter(F.col("y") == y).orderBy("o", id).limit(n) for y, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    return parts[0].unionAll(parts[1]).select(id, "y")


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words and word beginnings of each row."""
    for batch in batches:
        rows = []
        for text in batch.column(1):
            own = set(words(text.as_py()))
            rows.append([*own, *{b"^" + s for w in own for s in _stems(w)}])
        terms = pa.array(rows, pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), terms], names=["y", "copies", "terms"])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], names=["id", "t", "y", "fp"])


def copies(fps: np.ndarray, bits: int = COPY_BITS) -> np.ndarray:
    """For each of at most ``MAX_TOXIC`` + ``MAX_CLEAN`` fingerprints the first one that it is a copy of, over any
    number of copies in between."""
    distinct, first, inverse = np.unique(fps, return_index=True, return_inverse=True)
    group = np.full(len(distinct), -1)
    for seed in range(len(distinct)):
        todo = [seed] if group[seed] < 0 else []
        group[todo] = seed
        while todo:
            near = np.flatnonzero((group < 0) & (np.bitwise_count(distinct ^ distinct[todo.pop()]) <= bits))
            group[near] = seed
            todo += near.tolist()
    least = np.full(len(distinct), len(fps))
    np.minimum.at(least, group, first)
    return least[group][inverse]


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def chance(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """How likely at most ``clean`` of ``toxic + clean`` rows are clean if they are dealt by chance (Fisher's test)."""
    n = toxic + clean
    ways = [_log_choose(all_clean, c) + _log_choose(all_toxic, n - c) for c in range(max(0, n - all_toxic), clean + 1)]
    return math.fsum(math.exp(w - _log_choose(all_toxic + all_clean, n)) for w in ways)


def bars(all_toxic: int, all_clean: int, tried: int) -> list[int]:
    """The least number of toxic rows that a term needs, by its number of clean ones, as far as any can do."""
    strongest = chance(all_toxic, 0, all_toxic, all_clean)
    most, out = min(WEAKEST, max(1 / max(tried, 1), strongest)) * (1 + 1e-9), []
    for clean in range(min(all_clean, int(MAX_CLEAN_SHARE * all_toxic)) + 1):
        low, high = max(MIN_ROWS, math.ceil(clean / MAX_CLEAN_SHARE - 1e-9)), all_toxic + 1
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if chance(middle, clean, all_toxic, all_clean) <= most else (middle + 1, high)
        if low > all_toxic:
            break
        out.append(low)
    return out


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple:
    """``(words, stems, weights)`` from at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled rows outside the
    held-out ones. Copies are one row of evidence for a term, whatever they begin with. Without toxic or
    without clean rows nothing tells which terms are toxic, and the lexicon is empty; without both the prior weights stay."""
    sample = _sample(labels, id, label)
    texts = docs.select(F.col(id).alias("id"), utf8(text).alias("t"))
    # the sample has a fixed bound, so it may be broadcast
    rows = texts.join(F.broadcast(sample.select(F.col(id).alias("id"), "y")), "id").select("id", "t", "y")
    kind = docs.schema[id].dataType.simpleString()
    # of several texts of an id the least one is taken, so that the model is the same each time
    rows = rows.groupBy("id").agg(F.min(F.struct("t", F.col("y").cast("int").alias("y"))).alias("r")).select("id", "r.t", "r.y")
    rows = stored(rows.mapInArrow(_prints, f"id {kind}, t binary, y int, fp long"))
    prints = np.array([(r.fp, r.y) for r in rows.select("fp", "y").collect()], np.int64).reshape(-1, 2)
    group, y = copies(prints[:, 0].astype(np.uint64)), prints[:, 1]
    # a group of copies that has both labels counts with each
    all_toxic, all_clean = (len(np.unique(group[y == label])) for label in (1, 0))
    sizes = np.bincount(group, minlength=1)
    several = sorted({(int(f), int(g)) for f, g in zip(prints[:, 0], group) if sizes[g] > 1})
    several = docs.sparkSession.createDataFrame(several, "fp long, copies int")
    grouped = rows.join(F.broadcast(several), "fp", "left").select("id", "t", "y", "copies")

    def terms(part: DataFrame) -> DataFrame:
        found = part.mapInArrow(_vocabulary, "y int, copies int, terms array<binary>")
        return found.select("y", "copies", F.explode("terms").alias("term"))

    counted = terms(grouped.filter("copies is null")).unionAll(terms(grouped.filter("copies is not null")).distinct())
    counts = stored(
        counted.groupBy("term")
        .agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
        .filter(F.col("toxic") >= MIN_ROWS)
    )
    least = F.array(*map(F.lit, bars(all_toxic, all_clean, counts.count()))).cast("array<int>")
    found = (
        counts.filter(F.col("toxic") >= F.get(least, F.col("clean").cast("int")))
        .select("term")
        .collect()
    )
    lexicon = sorted(bytes(r.term) for r in found)
    own = [t for t in lexicon if not t.startswith(b"^")]
    stems = [t[1:] for t in lexicon if t.startswith(b"^")]
    counted = rows.mapInArrow(_counter(Grammar(own, stems), 2), f"id {kind}, y int, n array<double>").collect()
    x = np.array([r.n for r in counted]).reshape(-1, len(MATCHES))
    return own, stems, fit(features(x), np.array([r.y for r in counted], float)).tolist()


def _counter(machine: Grammar, y: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [machine.matches(t.as_py()).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(y), pa.array(n, pa.list_(pa.float64()))], names=["id", "y", "n"])

    return run


def score(docs: DataFrame, model: tuple, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) for each row, by the grammar alone; null and empty texts score as
    texts without a match. A column named ``score`` is replaced. One pass, no shuffle."""
    own, stems, weights = model
    machine, w, bias = Grammar(own, stems), np.array(weights[:-1]), weights[-1]
    rest = [c for c in docs.columns if c != "score"]
    names, at = [f"c{i}" for i in range(len(rest))], rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                1 / (1 + math.exp(-max(-30.0, min(30.0, float(features(machine.matches(t.as_py() or b"")) @ w) + bias))))
                for t in batch.column(at).cast(pa.binary())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*names, "score"])

    flat = docs.select(*rest).toDF(*names)
    schema = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in zip(names, rest))
    return flat.mapInArrow(run, f"{schema}score double").toDF(*rest, "score")


def reject_toxic(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with the same columns, whatever their names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own_id, own_text = (names[docs.columns.index(c)] for c in (id, text))
    scored = score(docs.toDF(*names), learn(docs, labels, id, text), own_id, own_text)
    return scored.filter("score < 0.5").select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
