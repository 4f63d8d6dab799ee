"""Operator 2, toxicity: a weighted finite-state pattern grammar.

Insult stems are learned from labelled documents; small fixed transducers for threats, targets, negation
and reported speech run over the tokens of a clause together, as one machine whose state is theirs. What
is scored is the matched clause: an insult counts by its weight, more if aimed at someone, apart if negated or
reported; a threat needs its verb and a target. A logistic model turns a document's clauses into a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, done, written

#: Labelled documents of each class, by the hash of their id, from which the model is fitted at most.
SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 6000
#: Letters of a stem; toxic documents, likelihood ratio and enrichment that an entry needs.
STEMS, LEAST_TOXIC, LEAST_G, LEAST_RATIO = range(3, 9), 3, 22.0, 3.0
#: Counts that a task holds before it passes them on to be summed.
HELD = 50_000
#: Marks a stem of words that a document has twice or more.
TWICE = "#2"
#: From this score a document is toxic.
THRESHOLD = 0.3

#: Word lists of the transducers in English, German, French and Spanish.
WORDS = {
    "threat": "kill murder stab shoot strangle slaughter beat burn töten umbringen erschießen erwürgen verprügeln tuer égorger étrangler poignarder buter matar apuñalar degollar estrangular golpear".split(),
    "target": "you your yours yourself he she they them him her u du dich dir ihr euch sie ihn er tu te toi vous il elle ils elles tú ti usted ustedes vosotros él ella ellos ellas".split(),
    "negation": "not never no isn't aren't wasn't don't doesn't nobody without nicht kein keine keinen nie niemals ne pas jamais aucun aucune sans nunca jamás ningún ninguna sin".split(),
    "report": "said says say told claimed claims wrote quoted reported alleged called sagte sagt schrieb behauptete nannte meinte dit disait affirma écrit appelé dijo dice afirmó escribió llamó".split(),
}
CLASS = {w: kind for kind, ws in WORDS.items() for w in ws}
CLAUSE = re.compile(r"[.!?;:\n\r]+")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»]")
LETTER = re.compile(r"[^\W\d_]")


class Transducer:
    """States 0 .. n-1 (0 is the start) with arcs {(state, class): next}; a class without an arc takes `other`."""

    def __init__(self, arcs: dict[tuple[int, str], int], other: dict[int, int]):
        self.arcs, self.other = arcs, other

    def step(self, state: int, kind: str) -> int:
        return self.arcs.get((state, kind), self.other.get(state, state))


#: Negation reaches two tokens on. Reported speech holds from its verb or quote to the end of the clause.
NEGATION = Transducer({(s, "negation"): 3 for s in range(4)}, {3: 2, 2: 1, 1: 0})
REPORT = Transducer({(0, "report"): 1, (0, "quote"): 1, (1, "quote"): 0}, {})
#: A target reaches four tokens on.
TARGET = Transducer({(s, "target"): 5 for s in range(6)}, {5: 4, 4: 3, 3: 2, 2: 1, 1: 0})
#: A threat's verb waits three tokens for its target.
THREAT = Transducer({**{(s, "threat"): 3 for s in range(5)}, **{(s, "target"): 4 for s in (1, 2, 3)}}, {4: 0, 3: 2, 2: 1, 1: 0})
GRAMMAR = (NEGATION, REPORT, TARGET, THREAT)
AIMED = 1.25


def compose(kinds: list[tuple[str, float]]) -> np.ndarray:
    """Over a clause's (class, weight): insults that are plain, negated, reported, and threats."""
    state, out, aimed_at = (0,) * len(GRAMMAR), np.zeros(4), False
    for kind, weight in kinds:
        state = tuple(t.step(s, kind) for t, s in zip(GRAMMAR, state, strict=True))
        negated, reported, target, threat = state
        aimed_at |= kind == "target"
        if kind == "insult":
            slot = 1 if negated else 2 if reported else 0
            out[slot] += weight * (AIMED if target or aimed_at else 1.0)
        if threat == 4:
            out[1 if negated else 2 if reported else 3] += 4.0
    return out


def is_held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    """Learned entries (a stem, or a word with its end mark) with weights, and the logistic model."""

    entries: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(8))
    fitted: bool = False
    scanner: object = None

    def __getstate__(self):
        return {**self.__dict__, "scanner": None}

    def scan(self):
        if self.scanner is None:
            import ahocorasick

            self.scanner = ahocorasick.Automaton()
            for e in {x.rstrip("$") for x in self.entries} | set(WORDS["threat"]):
                self.scanner.add_word(e, len(e))
            if len(self.scanner):
                self.scanner.make_automaton()
        return self.scanner

    def weight(self, word: str) -> float:
        get = self.entries.get
        return max([get(word + "$", 0.0), *[get(word[:n], 0.0) for n in STEMS if n <= len(word)]])

    def features(self, text: str) -> np.ndarray:
        """Of a document: the largest of its clauses by kind, their damped sum, whether there are any, their share, and 1."""
        text, hits, scan = text.lower(), [], self.scan()
        if len(scan):
            for end, n in scan.iter(text):
                at = end - n + 1
                if at == 0 or not LETTER.match(text[at - 1]):
                    hits.append(at)
        out = np.zeros(8)
        out[7] = 1.0
        if not hits:
            return out
        top, total, done = np.zeros(4), 0.0, 0
        for at in sorted(hits):
            if at < done:
                continue
            # no clause begins before the last one's end, so that each part of a text is looked through once
            begin = max(done, 1 + max(text.rfind(c, done, at) for c in ".!?;:\n\r"))
            end = m.start() if (m := CLAUSE.search(text, at)) else len(text)
            done = end
            kinds = []
            for w in TOKEN.findall(text[begin:end]):
                if w in "\"“”«»":
                    kinds.append(("quote", 0.0))
                elif (weight := self.weight(w)) > 0:
                    kinds.append(("insult", weight))
                else:
                    kinds.append((CLASS.get(w, "other"), 0.0))
            got = compose(kinds)
            top = np.maximum(top, got)
            total += got.sum()
        out[:4] = np.minimum(top, 8.0)
        out[4], out[5] = np.log1p(total), float(total > 0)
        out[6] = np.log1p(100 * total / (text.count(" ") + 50))
        return out

    def score(self, text: str | None) -> float:
        if not self.fitted:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.features(text or "") @ self.weights, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Weights by Newton's method; all but the last, the constant, are held by the ridge."""
    w, hold = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    hold[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (y - p) - hold * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def entries(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Of document counts of features in toxic and clean documents, those that mark toxic ones, with log-odds weights."""

    def g(a, b):
        n, row = n_toxic + n_clean, a + b
        cells = ((a, row * n_toxic / n), (b, row * n_clean / n), (n_toxic - a, (n - row) * n_toxic / n), (n_clean - b, (n - row) * n_clean / n))
        return 2 * sum(o * np.log(o / e) for o, e in cells if o > 0 and e > 0)

    # a stem counts as it is or by the documents that have it twice, whichever says more
    out, says = {}, {}
    for name, (a, b) in counts.items():
        f, ratio = name.removesuffix(TWICE), (a + 0.5) / (n_toxic + 1) / ((b + 0.5) / (n_clean + 1))
        if ratio >= LEAST_RATIO and (now := g(a, b)) >= max(LEAST_G, says.get(f, 0.0)):
            out[f], says[f] = float(np.log(ratio)), now
    # of entries that begin one another the one with the most evidence stays, the longest if it is equal
    kept: dict[str, float] = {}
    begun: set[str] = set()
    for f in sorted(out, key=lambda f: (-says[f], -len(f), f)):
        begins = {f[:n] for n in STEMS if n <= len(f)}
        if f not in begun and kept.keys().isdisjoint(begins):
            kept[f] = out[f]
            begun |= begins
    return kept


def enriched(a: Column, b: Column, n_toxic: int, n_clean: int) -> Column:
    """Whether document counts in toxic and clean documents pass both tests of entries(), which decides at the very bounds."""
    n, row = n_toxic + n_clean, a + b
    cells = ((a, row * n_toxic / n), (b, row * n_clean / n), (n_toxic - a, (n - row) * n_toxic / n), (n_clean - b, (n - row) * n_clean / n))
    g = sum((F.when((o > 0) & (e > 0), 2 * o * F.log(F.try_divide(o.cast("double"), e))).otherwise(0.0) for o, e in cells), F.lit(0.0))
    return (g >= LEAST_G - 1e-6) & ((a + 0.5) * (n_clean + 1) >= (LEAST_RATIO - 1e-9) * (b + 0.5) * (n_toxic + 1))


def sketch(text: str) -> int:
    """A hash that near copies mostly share: the least over runs of three words."""
    w = text.lower().split()
    return min((zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))), default=0)


def stems(text: str) -> set[str]:
    """A text's words with their end marks and the stems of its words; with a sign those that it has twice or more."""
    out: Counter[str] = Counter()
    for w, n in Counter(w.lower() for w in re.findall(r"[^\W\d_]+", text)).items():
        if len(w) >= 3:
            for f in {w + "$", *[w[:n] for n in STEMS if n <= len(w)]}:
                out[f] += n
    return {*out, *[f + TWICE for f, n in out.items() if n > 1]}


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """A model of the labelled documents that aren't held out: at most SAMPLE_TOXIC and SAMPLE_CLEAN rows.

    Of a key with several labels the largest counts; null labels and keys are passed over. Of rows of one key that
    with the least text is in the sample, so the two parameters bound what reaches the driver. Of texts that are near copies of each other the one with the smallest key stands for all, so the
    rows alone decide. Without documents of both classes the model says 0 to everything.
    """
    bounded_batches(docs.sparkSession)
    known = labels.groupBy(key).agg(F.max(toxic).cast("int").alias("__y")).where(F.col(key).isNotNull() & F.col("__y").isin(0, 1) & ~is_held_out(key))
    order = F.xxhash64(key)
    pick = known.where("__y = 1").orderBy(order, key).limit(SAMPLE_TOXIC).union(known.where("__y = 0").orderBy(order, key).limit(SAMPLE_CLEAN))
    # the sample's ids are bounded by the two parameters
    sample = docs.select(F.col(key).alias("__k"), F.coalesce(text, F.lit("")).alias("__t")).join(F.broadcast(pick.withColumnRenamed(key, "__k")), "__k")
    rows = "__y int, __k " + docs.schema[key].dataType.simpleString() + ", __t string, __s bigint"

    def drawn(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("__y"), b.column("__k"), b.column("__t"), pa.array([sketch(t.as_py()) for t in b.column("__t")], pa.int64())], names=["__y", "__k", "__t", "__s"])

    sample = sample.groupBy("__y", "__k").agg(F.min("__t").alias("__t"))
    # the first of each group of near copies, whose common words would all seem to mark a class
    sample = sample.select("__y", "__k", "__t").mapInArrow(drawn, rows)
    sample = written(sample.groupBy("__y", "__s").agg(F.min(F.struct("__k", "__t"))["__t"].alias("__t")), "toxicity-sample")

    def count(batches):
        n: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def given(y):
            out = pa.RecordBatch.from_pydict({"f": pa.array(n[y].keys(), pa.string()), "y": pa.array([y] * len(n[y]), pa.int32()), "n": pa.array(n[y].values(), pa.int64())})
            n[y].clear()
            return out

        for b in batches:
            for y, t in zip(b.column("__y").to_pylist(), b.column("__t"), strict=True):
                n[y].update(stems(t.as_py()))
                n[y][""] += 1
                if len(n[y]) >= HELD:
                    yield given(y)
        yield from map(given, n)

    counts = sample.select("__y", "__t").mapInArrow(count, "f string, y int, n bigint")
    sums = counts.groupBy("f").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    sums = written(sums.where((F.col("f") == "") | (F.col("a") >= LEAST_TOXIC)), "toxicity-counts")
    of = sums.where("f = ''").first()
    n_toxic, n_clean = (of["a"], of["b"]) if of else (0, 0)
    model = Model()
    if not n_toxic or not n_clean:
        return model
    # how many pass is bounded by the sample: a stem needs LEAST_TOXIC of its toxic documents at least
    passed = sums.where((F.col("f") != "") & enriched(F.col("a"), F.col("b"), n_toxic, n_clean)).collect()
    model.entries = entries({r["f"]: (r["a"], r["b"]) for r in passed}, n_toxic, n_clean)

    def measure(batches):
        for b in batches:
            x = [model.features(t.as_py()).tolist() for t in b.column("__t")]
            yield pa.RecordBatch.from_pydict({"y": b.column("__y"), "x": pa.array(x, pa.list_(pa.float64()))})

    at = sample.select("__y", "__t").mapInArrow(measure, "y int, x array<double>").collect()
    # the order of the rows must not show in the last bits
    at = sorted((r["y"], tuple(r["x"])) for r in at)
    model.weights = logistic(np.array([r[1] for r in at]), np.array([r[0] for r in at], float))
    model.fitted = True
    done(sample, sums)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with double score and int predicted, which replace columns of their names.

    A null text is scored as an empty one. Rows are scored each by itself, so repeated ones score alike and
    an empty table gives no rows. Texts are read whole, in time that grows with their length.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    at = names.index(text)

    def run(batches):
        for b in batches:
            s = [model.score(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
