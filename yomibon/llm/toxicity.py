"""Toxicity by a weighted finite-state pattern grammar over clauses.

The terminals are found in one Aho-Corasick pass over the lower-cased text: insults (words and word
stems with weights learned from labels) and cue words of threats, targets, negation and reported
speech. Five transducers read the terminals of a clause from left to right; an arc multiplies what it
reads, a final state multiplies all that was read:

    insult     passes insults on with their weight
    threat     passes threats on with their weight, if the clause names a target by its end
    target     multiplies insults by TARGETED if the clause names a target by its end
    negation   multiplies insults by NEGATED within NEGATION_REACH words behind a negation
    reported   multiplies insults and threats by REPORTED behind a verb of saying

They are composed once into one table of states; a clause's score is the sum of its insults and
threats, each times the factors on its way. A logistic regression over the clause scores (their sum,
the largest, the matches and their density) gives the document's probability.

Learning reads a bounded sample of the labelled rows outside fold 0, by label, so that a rare label is
not lost: equal texts once, at most SAMPLE_ROWS rows. A word weighs the lower bound of its log-odds of
being in toxic documents (Z standard errors below the estimate). A stem is kept only if STEM_WORDS
different words carry it in toxic documents and if on the half of the sample that is held back from
choosing words it is in more toxic documents than any single word that carries it; of the terminals at
one word the longest counts. A cue word of a threat that stands in clean documents as often as in toxic
ones weighs nothing, so that words of other languages do no harm.

Defined results. Null and empty texts have no clause and get the score of texts without a match,
below 0.5. Rows whose label is missing or not 0 or 1 don't train; a doc_id with both labels counts
as toxic; of the texts of one doc_id the least trains; rows that repeat a doc_id each get the score of
their text. Terminals that tie in length go whole word first. Without labels of both kinds the score is
0 for all. A very long text is read as a whole, clause by clause. Extra columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import received, sent, words, written
from .language import fold, sample

#: Rows that train at most, about a quarter of them toxic.
SAMPLE_ROWS = 20_000
#: Lengths of stems; the words that carry one at least; toxic documents of a terminal at least.
STEMS, STEM_WORDS, LEAST_DOCS = (4, 9), 3, 3
#: The least weight of a terminal, and the standard errors that it stands below the estimate.
LEAST_ODDS, Z = 0.5, 1.5

# Fixed cue words of the grammar, in English, German, French and Spanish.
THREATS = (
    "kill killed hurt beat destroy shoot stab strangle murder burn drown die "
    "umbringen töten erschießen erstechen verprügeln verbrennen ertränken zerstören "
    "tuer tuerai frapper étrangler poignarder brûler noyer détruire "
    "matar mataré golpear estrangular apuñalar quemar ahogar destruir"
).split()
TARGETS = "you your yours yourself u du dich dir dein deine euch euer ihr tu te toi ton vous votre tú ti usted ustedes vosotros".split()
NEGATIONS = "not never isn't aren't don't nobody nicht nie niemand kein keine ne pas jamais personne no nunca nadie jamás".split()
REPORTS = "said says quoted called alleged reportedly wrote sagte sagt schrieb nannte angeblich dit disait écrit appelé dijo dice escribió llamó".split()

NEGATION_REACH, NEGATED, REPORTED, TARGETED, THREAT = 3, 0.25, 0.5, 1.25, 3.0
CLAUSE_END = re.compile(r"[.;!?\n]")
WORD_CHAR = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
N_FEATURES = 6

#: What the transducers read: any other word, and the kinds of terminals.
OTHER, INSULT, THREATENS, TARGET, NEGATION, REPORT = range(6)


@dataclass(frozen=True)
class Transducer:
    """arcs: {(state, symbol): (next state, factor)}; a symbol without an arc stays, factor 1. finals: {(state, symbol): factor of all that was read of it}. It starts in 0."""

    arcs: dict
    finals: dict


def transducers() -> list[Transducer]:
    reach = NEGATION_REACH
    negation = {(s, x): (max(s - 1, 0), NEGATED if s and x == INSULT else 1.0) for s in range(reach + 2) for x in (OTHER, INSULT, THREATENS, TARGET, REPORT)}
    return [
        Transducer({(0, x): (0, 0.0) for x in (OTHER, TARGET, NEGATION, REPORT)}, {}),  # insults and threats alone have a weight
        Transducer({(0, TARGET): (1, 1.0)}, {(0, THREATENS): 0.0}),
        Transducer({(0, TARGET): (1, 1.0)}, {(1, INSULT): TARGETED}),
        Transducer(negation | {(s, NEGATION): (reach + 1, 1.0) for s in range(reach + 2)}, {}),
        Transducer({(0, REPORT): (1, 1.0), (1, INSULT): (1, REPORTED), (1, THREATENS): (1, REPORTED)}, {}),
    ]


def composed(parts: list[Transducer]) -> tuple[list[list[tuple[int, float]]], list[list[float]]]:
    """(arcs: by state and symbol the next state and the factor, finals: by state and symbol) of the product of the transducers, as far as it is reached."""
    start = (0,) * len(parts)
    number, arcs, finals = {start: 0}, [], []
    for state in (queue := [start]):
        row = []
        for symbol in range(6):
            steps = [t.arcs.get((s, symbol), (s, 1.0)) for t, s in zip(parts, state, strict=True)]
            to = tuple(s for s, _ in steps)
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            row.append((number[to], float(np.prod([f for _, f in steps]))))
        arcs.append(row)
        finals.append([float(np.prod([t.finals.get((s, symbol), 1.0) for t, s in zip(parts, state, strict=True)])) for symbol in range(6)])
    return arcs, finals


@dataclass
class Grammar:
    """Insults by stem (a trailing space marks a whole word), weights of threats that differ from THREAT, and the regression's coefficients."""

    insults: dict[str, float]
    coefficients: list[float] = field(default_factory=list)
    threats: dict[str, float] = field(default_factory=dict)

    def automaton(self):
        """The Aho-Corasick automaton of all terminals, and the composed transducers."""
        import ahocorasick

        found = ahocorasick.Automaton()
        entries: dict[str, list[tuple[int, float, bool]]] = {}
        for kind, terms in ((THREATENS, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            for term in terms:
                weight = self.threats.get(term, THREAT) if kind == THREATENS else 0.0
                if weight or kind != THREATENS:
                    entries.setdefault(term, []).append((kind, weight, True))
        for stem, weight in self.insults.items():
            entries.setdefault(stem.rstrip(" "), []).append((INSULT, weight, stem.endswith(" ")))
        for term, values in entries.items():
            found.add_word(term, (len(term), values))
        found.make_automaton()
        return found, composed(transducers())


def terminals(automaton, text: str) -> list[tuple[int, int, int, float]]:
    """(start, end, kind, weight) in order; of several at one word the longest, whole words first."""
    best: dict[int, tuple[float, int, int, float]] = {}
    size = len(text)
    for last, (length, values) in automaton.iter(text):
        start = last - length + 1
        if start and WORD_CHAR.match(text, start - 1):
            continue
        ends = last + 1 == size or not WORD_CHAR.match(text, last + 1)
        for kind, weight, whole in values:
            if ends or not whole:
                rank = length + 0.5 * whole
                if start not in best or best[start][0] < rank:
                    best[start] = (rank, last + 1, kind, weight)
    return [(start, end, kind, weight) for start, (_, end, kind, weight) in sorted(best.items())]


def clause_score(table, clause: list[tuple[int, int, int, float]], text: str) -> tuple[float, int]:
    """The composed transducers on a clause's terminals: (score, number of insults and threats that count)."""
    arcs, finals = table
    state, score, count = 0, [0.0] * 6, [0] * 6
    at = clause[0][0]
    for start, _, kind, weight in clause:
        for _ in range(min(text.count(" ", at, start) - 1, NEGATION_REACH + 1)):  # the words between; the last space begins this one
            state = arcs[state][OTHER][0]
        at = start
        state, factor = arcs[state][kind]
        if factor:
            score[kind] += weight * factor
            count[kind] += 1
    last = finals[state]
    return sum(s * f for s, f in zip(score, last, strict=True)), sum(n for n, f in zip(count, last, strict=True) if f)


def features(found, text: str) -> list[float]:
    """Sum and maximum of the clause scores, matches, density, and whether one or several clauses match."""
    automaton, table = found
    low = text.lower()
    stood = terminals(automaton, low)
    scores, matched, clause, end = [], 0, [], 0
    for t in [*stood, None]:
        if clause and (t is None or CLAUSE_END.search(low, end, t[0])):
            score, n = clause_score(table, clause, low)
            if n:
                scores.append(score)
                matched += n
            clause = []
        if t is not None:
            clause.append(t)
            end = t[1]
    total = sum(scores)
    n_words = 1 + low.count(" ")
    return [np.log1p(max(0.0, total)), max(scores, default=0.0) / 4, np.log1p(matched), np.log1p(100 * max(0.0, total) / n_words), float(bool(scores)), float(len(scores) > 1)]


def scorer(model, with_features: bool):
    """model: a Grammar as sent() sends it. Batches of (doc_id, text) -> (doc_id, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = received(model)
        automaton = grammar.automaton()
        for batch in batches:
            rows = np.array([features(automaton, x or "") for x in batch.column(1).to_pylist()]).reshape(-1, N_FEATURES)
            if with_features:
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, N_FEATURES, dtype=np.int32)), pa.array(rows.ravel()))
            else:
                values = pa.array(probability(rows, np.array(grammar.coefficients)))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "score"])

    return run


def probability(rows: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(coefficients[0] + rows @ coefficients[1:], -30, 30)))


def regression(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 0.3, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method, ridge on all but the intercept."""
    x = np.hstack([np.ones((len(rows), 1)), rows])
    beta, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * rows.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (weights * (labels - p)) - penalty @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def stems(word: Column) -> Column:
    """The stems of a word that are shorter than it."""
    return F.array_compact(F.transform(F.sequence(F.lit(STEMS[0]), F.lit(STEMS[1])), lambda n: F.when(F.length(word) > n, F.substring(word, F.lit(1), n))))


def weight(n_toxic: Column, n_clean: Column, toxic: float, clean: float) -> Column:
    """The lower bound of the log-odds of a term in n_toxic of `toxic` and n_clean of `clean` documents."""
    odds = F.log((n_toxic + 0.5) / (toxic + 1)) - F.log((n_clean + 0.5) / (clean + 1))
    return odds - Z * F.sqrt(1 / (n_toxic + 0.5) + 1 / (n_clean + 0.5))


def candidates(each: DataFrame) -> DataFrame:
    """each (doc_id, half, word) of toxic documents -> (term, n_toxic): words by a trailing space, and the stems that several words carry."""
    whole = each.groupBy(F.concat("word", F.lit(" ")).alias("term")).agg(F.count(F.lit(1)).alias("n_toxic")).where(F.col("n_toxic") >= LEAST_DOCS)
    cut = each.select("doc_id", "half", "word", F.explode(stems(F.col("word"))).alias("term"))
    carried = cut.groupBy("term", "word").agg(F.sum("half").alias("held")).groupBy("term").agg(F.count(F.lit(1)).alias("n_words"), F.max("held").alias("best"))
    seen = cut.groupBy("term", "doc_id").agg(F.max("half").alias("half")).groupBy("term").agg(F.count(F.lit(1)).alias("n_toxic"), F.sum("half").alias("held"))
    kept = seen.where(F.col("n_toxic") >= LEAST_DOCS).join(carried.where(F.col("n_words") >= STEM_WORDS), "term").where("held > best")
    return whole.unionByName(kept.select("term", "n_toxic"))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Grammar | None:
    """docs (doc_id, text), labels (doc_id, toxic): the insults and the regression."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & F.coalesce(fold(F.col("doc_id")) != 0, F.lit(False))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("double").alias("toxic"))
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1.0) or not n.get(0.0):
        return None
    # Bounded by label, so it may be broadcast.
    parts = [sample(known.where(F.col("toxic") == y), n[y], bound=sample_rows * share // 4) for y, share in ((0.0, 3), (1.0, 1))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    # Rows that repeat a doc_id, and copies of a text, are one piece of evidence.
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id"))
    rows = written(rows, "labelled")
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1.0) or not sizes.get(0.0):
        return None
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).alias("half")
    each = rows.where("toxic = 1").select("doc_id", half, F.explode_outer(F.array_distinct(words(F.col("text")))).alias("word")).where("word is not null")
    found = written(candidates(each).unionByName(spark.createDataFrame([(f"{t} ", 0) for t in THREATS], "term string, n_toxic long")).groupBy("term").agg(F.max("n_toxic").alias("n_toxic")), "terms")
    clean = rows.where("toxic = 0").select("doc_id", F.explode_outer(F.array_distinct(words(F.col("text")))).alias("word"))
    clean = clean.select("doc_id", F.explode(F.concat(F.array(F.concat("word", F.lit(" "))), stems(F.col("word")))).alias("term"))
    # The candidates come from the bounded sample.
    clean = clean.join(F.broadcast(found.select("term")), "term").groupBy("term", "doc_id").agg(F.lit(1).alias("one")).groupBy("term").agg(F.count(F.lit(1)).alias("n_clean"))
    table = found.join(clean, "term", "left").withColumn("n_clean", F.coalesce("n_clean", F.lit(0)))
    table = table.withColumn("weight", weight(F.col("n_toxic"), F.col("n_clean"), sizes[1.0], sizes[0.0]))
    cues = [f"{t} " for t in THREATS]
    kept = table.where((F.col("weight") >= LEAST_ODDS) & (F.col("n_toxic") >= LEAST_DOCS) | F.col("term").isin(cues)).collect()
    grammar = Grammar({r.term: float(r.weight) for r in kept if r.term not in cues})
    grammar.threats = {r.term.strip(): THREAT * min(1.0, max(0.0, r.weight)) for r in kept if r.term in cues and r.n_toxic + r.n_clean >= LEAST_DOCS}
    shared = sent(spark, grammar)
    measured = rows.select("doc_id", "text").mapInArrow(scorer(shared, True), "doc_id long, score array<double>").join(F.broadcast(rows.select("doc_id", "toxic")), "doc_id").select("score", "toxic").collect()
    marks = np.array([r.toxic for r in measured])
    stands_for = np.where(marks == 1, n[1.0] / sizes[1.0], n[0.0] / sizes[0.0])  # labelled rows that a row of the sample stands for
    grammar.coefficients = regression(np.array([r.score for r in measured]), marks, stands_for / stands_for.mean()).tolist()
    return grammar


def scored(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, toxic) -> doc_id, held_out, score, predicted."""
    grammar = learn(docs, labels, sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if grammar is None:
        rows = rows.select("doc_id", F.lit(0.0).alias("score"))
    else:
        rows = rows.mapInArrow(scorer(sent(docs.sparkSession, grammar), False), "doc_id long, score double")
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return rows.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
