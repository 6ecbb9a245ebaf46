"""Operator 1: toxicity by a weighted finite-state pattern grammar.

A text becomes a string of symbols: insults, slurs, violent verbs, speakers, modal verbs,
targets, negators, speech verbs, quotes, clause ends, other words. Five transducers read
it in a cascade. The first two turn patterns into events (an insult and a second one in
its clause; a threat of a speaker, a modal verb, a violent verb and a target, in either
order of the last two, or a bare command), the others mark events as aimed at a target,
negated, or reported. Composed, they are one automaton that reads each clause once.

An event's path has a weight, the product of its pattern's and its marks' weights. A
clause scores what its best path weighs, and a document is scored by its clauses. Stems
of insults and the weights are learned from labelled rows, starting from fixed ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.bpe import Recent
from ragloom.llm.quality import fold, training_rows
from ragloom.llm.shared import append_columns, checkpoint, load, small_batches

#: A document is rejected from this score on.
THRESHOLD = 0.3
#: One fold of so many is held out, and its number.
FOLDS, HELD = 4, 2
#: Labelled rows that training takes at most.
TRAIN_ROWS = 12_000
#: Letters of a stem, from and to (longer words count whole, too), and different words of toxic
#: texts that must share it: one word alone is no inflection.
STEM, FORMS = (3, 16), 4
#: A stem needs this log-likelihood ratio, and this log odds of toxic to clean documents, less
#: one standard error; below the odds of an insult it is a slur, which clean documents hold
#: now and then. Chosen by cross-validation inside the training rows.
LEAST_G2, SLUR_ODDS, INSULT_ODDS = 20.0, 1.5, 3.0
#: Other words over which a negator reaches.
REACH = 2

OTHER, INSULT, SLUR, VIOLENT, SPEAKER, MODAL, TARGET, NEGATOR, SPEECH, QUOTE, END = SYMBOLS = range(11)

#: Words from which every lexicon starts. Insults of a corpus are learned
#: from its training rows; none is listed here because labelled rows hold it.
WORDS = {
    INSULT: "imbecile imbécile dummkopf abschaum estúpido idiota escoria ordure",
    VIOLENT: "kill murder destroy hurt strangle töten umbringen matar matarte tuer",
    SPEAKER: "i we ich wir yo nosotros je nous",
    MODAL: "will shall gonna going must should want werde werden will muss voy vamos quiero vais allons veux",
    TARGET: "you your yourself they them he him her dich dir euch du ihn tú te usted vosotros toi vous tu",
    NEGATOR: "not no never isn aren wasn weren don without nicht kein keine nie ne pas jamais sin nunca jamás",
    SPEECH: "said says say told claims claimed called wrote quoted reported sagte sagt schrieb behauptet nannte dijo dice llamó escribió dit écrit appelé",
}
QUOTES, ENDS = "\"“”«»„", ".!?;:\n"
TOKEN = re.compile(rf"[^\W\d_]+|[{ENDS}{QUOTES}]")

#: Events that the first two transducers write, and marks that the others add.
EVENTS, MARKS = ("insult", "insults", "slur", "threat", "command"), ("t", "n", "r")
#: Prior weights of the events, what each mark multiplies them by, and the bias.
PRIOR = {"insult": 2.6, "insults": 4.0, "slur": 1.3, "threat": 4.0, "command": 2.8}
FACTOR = {"t": 1.35, "n": 0.1, "r": 0.3}
BIAS = -4.0

#: A cell of the tape between two transducers: the symbol, the event found there, its marks.
Cell = tuple[int, str, str]


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: a start state and a step from (state, cell) to (state, cell)."""

    name: str
    start: object
    step: Callable[[object, Cell], tuple[object, Cell]]


def insult() -> Transducer:
    """Writes ``slur`` and ``insult``, and ``insults`` for a further insult of a clause."""

    def step(state, cell):
        symbol = cell[0]
        if symbol == END:
            return 0, cell
        if symbol == SLUR:
            return state, (symbol, "slur", "")
        if symbol == INSULT:
            return 1, (symbol, "insults" if state else "insult", "")
        return state, cell

    return Transducer("insult", 0, step)


def threat() -> Transducer:
    """Writes ``threat`` where a modal verb, after a speaker or not, a violent verb and a target have
    been read, in either order of the last two; ``command`` where a violent verb and a
    target follow without them."""

    def step(state, cell):
        symbol, event, marks = cell
        if symbol == END:
            return "", cell
        if symbol == SPEAKER:
            return ("speaker" if state == "" else state), cell
        if symbol == MODAL:
            return ("meant" if state in ("", "speaker") else state), cell
        if symbol == VIOLENT:
            if state == "meant at":
                return "", (symbol, "threat", marks)
            return ("act" if state in ("speaker", "meant") else "bare"), cell
        if symbol == TARGET and not event:
            if state in ("act", "bare"):
                return "", (symbol, "threat" if state == "act" else "command", marks)
            return ("meant at" if state in ("meant", "meant at") else state), cell
        return state, cell

    return Transducer("threat", "", step)


def target() -> Transducer:
    """Marks ``t`` an event at a target, one that a target precedes in its clause, and moves an
    unaimed one on to the target that follows it."""

    def step(state, cell):
        symbol, event, marks = cell
        if symbol == END:
            return "", cell
        if event:
            aimed = state == "aimed" or symbol == TARGET
            return ("aimed" if aimed else event), (symbol, event, marks + "t" * aimed)
        if symbol == TARGET:
            return "aimed", ((symbol, state, "t") if state not in ("", "aimed") else cell)
        return state, cell

    return Transducer("target", "", step)


def negation() -> Transducer:
    """Marks ``n`` an event that a negator precedes with at most ``REACH`` other words between;
    the mark stays on what follows a marked event in its clause."""

    def step(state, cell):
        symbol, event, marks = cell
        if symbol == END:
            return 0, cell
        if event:
            return (-1 if state else 0), (symbol, event, marks + "n" * bool(state))
        if symbol == NEGATOR:
            return REACH + 1, cell
        return (state if state < 0 else max(0, state - 1)), cell

    return Transducer("negation", 0, step)


def reported() -> Transducer:
    """Marks ``r`` an event that follows a speech verb in its clause, or stands in quotes."""

    def step(state, cell):
        symbol, event, marks = cell
        if symbol == QUOTE:
            return ("plain" if state == "quoted" else "quoted"), cell
        if symbol == END:
            return ("plain" if state == "said" else state), cell
        if event:
            return state, (symbol, event, marks + "r" * (state != "plain"))
        return ("said" if symbol == SPEECH and state == "plain" else state), cell

    return Transducer("reported", "plain", step)


CASCADE = (insult, threat, target, negation, reported)
#: What an event can come out as, by number; 0 is none.
OUTPUTS = [(e, "".join(m)) for e in EVENTS for n in range(len(MARKS) + 1) for m in combinations(MARKS, n)]


def walk(parts: Sequence[Transducer], states: tuple, symbol: int) -> tuple[tuple, Cell]:
    """One symbol through all transducers, each reading what the one before wrote."""
    cell, after = (symbol, "", ""), []
    for part, state in zip(parts, states, strict=True):
        state, cell = part.step(state, cell)
        after.append(state)
    return tuple(after), cell


def compose(parts: Sequence[Transducer]) -> list[list[tuple[int, int]]]:
    """One automaton for the cascade: for each state and symbol the next state and the output.

    Only states that can be reached get a row; output ``k`` above 0 is ``OUTPUTS[k - 1]``.
    """
    number = {x: i + 1 for i, x in enumerate(OUTPUTS)}
    start = tuple(p.start for p in parts)
    states, todo, rows = {start: 0}, [start], []
    while todo:
        own, row = todo.pop(0), []
        for symbol in SYMBOLS:
            after, (_, event, marks) = walk(parts, own, symbol)
            if after not in states:
                states[after] = len(states)
                todo.append(after)
            row.append((states[after], number[event, marks] if event else 0))
        rows.append(row)
    return rows


def prior_weights() -> np.ndarray:
    """The outputs' prior weights, the bias last."""
    return np.array([*(PRIOR[event] * math.prod(FACTOR[m] for m in marks) for event, marks in OUTPUTS), BIAS])


class Grammar:
    """The composed automaton with a lexicon; ``cascade`` leaves transducers out for comparison."""

    def __init__(self, stems: dict[str, int] | None = None, cascade: Sequence[Callable[[], Transducer]] = CASCADE):
        self.lexicon = {w: s for s, words in WORDS.items() for w in words.split()}
        self.stems = stems or {}
        self.arcs = compose([make() for make in cascade])
        self.order = np.argsort(np.argsort(prior_weights()[:-1])).tolist()  # which of two paths weighs more
        self.symbols = Recent(self.symbol)

    def symbol(self, token: str) -> int:
        """A token's symbol; a learned word or stem makes it an insult or a slur."""
        if not token[0].isalpha():
            return QUOTE if token in QUOTES else END
        word, get = token.lower(), self.stems.get
        found = {get(word), *(get(word[:k] + "*") for k in range(STEM[0], min(STEM[1], len(word) - 1) + 1))}
        return INSULT if INSULT in found else self.lexicon.get(word) or (SLUR if SLUR in found else OTHER)

    def clauses(self, text: str | None) -> list[int]:
        """The output of the best path of every matched clause, in order."""
        get = self.symbols
        read = bytes([get[t] for t in TOKEN.findall(text or "")])
        if not any(symbol in read for symbol in (INSULT, SLUR, VIOLENT)):
            return []
        found, best, state, order = [], -1, 0, self.order
        for symbol in read:
            state, out = self.arcs[state][symbol]
            if out and (best < 0 or order[out - 1] > order[best]):
                best = out - 1
            if symbol == END and best >= 0:
                found.append(best)
                best = -1
        return [*found, best] if best >= 0 else found

    def features(self, text: str | None) -> list[tuple[int, int]]:
        """Clauses by their best path: ``(output, clauses)``."""
        return sorted(Counter(self.clauses(text)).items())


def score(weights: np.ndarray, clauses: list[tuple[int, int]]) -> float:
    """Probability that a document of these clauses is toxic: what its clauses score, and the bias."""
    total = float(weights[-1]) + sum(float(weights[k]) * n for k, n in clauses)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def fit_weights(rows: list[tuple[list[tuple[int, int]], float, int]], prior: np.ndarray, pull: float = 4.0, steps: int = 50) -> np.ndarray:
    """Weights of rows ``(clauses, label, times)`` by penalised likelihood, in damped Newton steps.

    A weight is its prior times ``exp(u)``, and ``u`` is pulled to 0: no pattern turns harmless,
    and one that no row shows keeps its prior. The bias is free.
    """
    if not rows:
        return prior
    x = np.zeros((len(rows), len(prior)))
    for i, (clauses, _, _) in enumerate(rows):
        x[i, -1] = 1
        for k, n in clauses:
            x[i, k] = n
    y, times = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    keep = np.r_[np.full(len(prior) - 1, pull), 1e-3]

    def weights(u: np.ndarray) -> np.ndarray:
        return np.r_[prior[:-1] * np.exp(u[:-1]), prior[-1] + u[-1]]

    def loss(u: np.ndarray) -> float:
        z = x @ weights(u)
        return float(times @ (np.logaddexp(0, z) - y * z) + 0.5 * keep @ (u * u))

    u = np.zeros(len(prior))
    for _ in range(steps):
        w = weights(u)
        slope = x * np.r_[w[:-1], 1.0]
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = slope.T @ (times * (p - y)) + keep * u
        step = np.linalg.solve((slope * (times * p * (1 - p))[:, None]).T @ slope + np.diag(keep), grad)
        size = 1.0
        while size > 1e-6 and loss(u - size * step) > loss(u):
            size /= 2
        u = u - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return weights(u)


def stems_of(word: str) -> list[str]:
    """The stems that a word may have."""
    return [word[:k] + "*" for k in range(STEM[0], min(STEM[1], len(word) - 1) + 1)]


def stem_counts(sample: DataFrame) -> DataFrame:
    """``stem, toxic, clean, forms``: documents that hold each word or stem, and the different words
    of toxic documents with that stem; equal texts count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = {t.lower() for t in TOKEN.findall(text or "") if t[0].isalpha()}
                seen[label > 0].update({x for w in words for x in stems_of(w)} | words)
            stems = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), *(pa.array([seen[i][s] for s in stems], pa.int64()) for i in (1, 0))], names=["stem", "toxic", "clean"])

    once = sample.groupBy("text").agg(F.max("label").alias("label"))
    counts = checkpoint(once.mapInArrow(run, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    words = counts.where((F.col("toxic") > 0) & ~F.endswith("stem", F.lit("*")) & (F.length("stem") > STEM[0]))
    ends = F.sequence(F.lit(STEM[0]), F.least(F.lit(STEM[1]), F.length("stem") - 1))
    forms = words.select(F.explode(F.transform(ends, lambda k: F.concat(F.substring("stem", F.lit(1), k), F.lit("*")))).alias("stem")).groupBy("stem").agg(F.count("*").alias("forms"))
    return counts.join(forms, "stem", "left")


def learn_stems(sample: DataFrame) -> dict[str, int]:
    """Words and stems that toxic documents hold far oftener than clean ones, as insults or slurs.

    All that pass the tests are kept; the sample bounds their number.
    """
    total = sample.groupBy("text").agg(F.max("label").alias("label")).agg(F.sum((F.col("label") > 0).cast("int")), F.count("*")).first()
    bad, n = total[0] or 0, total[1]
    if not bad or bad == n:
        return {}
    base = bad / n
    k, m = F.col("toxic"), F.col("clean")
    term = lambda a, p: F.when(a > 0, a * F.log(a / ((k + m) * p))).otherwise(0.0)
    g2 = 2 * (term(k, base) + term(m, 1 - base))
    odds = F.log((k + 0.5) / (bad + 1)) - F.log((m + 0.5) / (n - bad + 1)) - F.sqrt(1 / (k + 0.5) + 1 / (m + 0.5))
    inflected = ~F.endswith("stem", F.lit("*")) | (F.col("forms") >= FORMS)
    kept = stem_counts(sample).where((k > 0) & inflected).select("stem", g2.alias("g2"), odds.alias("odds")).where((F.col("g2") >= LEAST_G2) & (F.col("odds") >= SLUR_ODDS))
    return {r["stem"]: INSULT if r["odds"] >= INSULT_ODDS else SLUR for r in kept.collect()}  # of a bounded sample's words


def with_toxicity(docs: DataFrame, labels: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", held: int = HELD, folds: int = FOLDS, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with the score as column ``out`` and the matched clauses as ``out_clauses``; see ``score_toxicity``."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = checkpoint(training_rows(docs, labels, label, held, folds, train_rows, id_col, text_col).select("text", "label"))
    stems = spark.sparkContext.broadcast(learn_stems(sample))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(stems.value)
        for batch in batches:
            rows = [[f"{k}:{n}" for k, n in grammar.features(v.as_py())] for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string())), batch.column(1)], names=["x", "label"])

    rows = sample.mapInArrow(describe, "x array<string>, label int").groupBy("x", "label").count().orderBy("x", "label").collect()  # ``train_rows`` of them at most
    weights = fit_weights([([tuple(map(int, c.split(":"))) for c in r["x"]], float(r["label"] > 0), r["count"]) for r in rows], prior_weights())

    def make():
        grammar = Grammar(stems.value)

        def compute(texts: pa.Array) -> list[pa.Array]:
            found = [grammar.features(v.as_py()) for v in texts]
            return [pa.array([score(weights, x) for x in found], pa.float64()), pa.array([sum(n for _, n in x) for x in found], pa.int32())]

        return compute

    return append_columns(docs, text_col, make, f"`{out}` double, `{out}_clauses` int")


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", held: int = HELD, folds: int = FOLDS, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``id, held_out, score, predicted, n_clauses`` of every whole document.

    Learns from at most ``train_rows`` labelled documents of the other folds. A null or
    empty text has no clause and gets the bias's score; very long texts are read whole;
    a null id is scored, in fold 0; repeated rows each give a row; with no labelled row
    the fixed lexicon and prior weights hold; an empty table gives no rows. Extra columns
    are left out.
    """
    scored = with_toxicity(docs.select(id_col, text_col), labels, "score", id_col, text_col, label, held, folds, train_rows)
    return scored.select(id_col, (fold(id_col, folds) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.col("score_clauses").alias("n_clauses"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
