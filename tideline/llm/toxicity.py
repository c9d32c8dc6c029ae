"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, report, quote mark, other). Small transducers each
add one piece of reading to that tape: negation turns the next few words around, reported speech
marks what follows it in the clause, a target near an insult or threat aims it. Composed, they are one
deterministic machine that reads a clause once and ends with a tape of readings; a clause
matches if an insult or threat is left on it. The weights of the readings come from labelled documents:
a logistic regression over clipped clause counts, fitted on the distinct count vectors. Labelled documents
also extend the insult list by word stems, for languages and coinages no list foresees.

Only clauses around a lexicon hit are read word by word; the hits of a text are found with one
automaton. Rows are independent, so scoring needs no shuffle.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.session import materialise

# The word lists of the grammar.
INSULTS = """arschloch asshole bastard bastardo bitch clown connard coward creep cretin crétin degenerate dickhead
disgusting dumbass dummkopf estúpido filth filthy fool freak garbage hateful idiot idiota idiots idiote imbecile
imbécile imbécil jerk lazy loser losers lowlife miserable moron morons parasite pathetic pendejo pervert scum scumbag
shithead sicko simpleton slut stupid subhuman trash ugly useless vermin whore worthless wretch""".split()
THREATS = """annihilate assassinate attack beat bury butcher crush destroy exterminate hang hunt hurt kill murder
poison punch shoot slaughter stab strangle threaten töten umbringen matar tuer""".split()
TARGETS = """you your yours yourself u they them their he him his she her those these people everyone du dich dein
ihr euch vous toi votre tu usted ustedes""".split()
NEGATIONS = "not no never neither nor without cannot isn't aren't wasn't don't doesn't nicht kein keine pas jamais".split()
REPORTS = """said says say called calls calling claimed claims wrote writes quoted quotes reported reports allegedly
alleged accused accuses sagte schrieb""".split()

CLAUSE_END = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»]")
QUOTES = frozenset("\"“”«»")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = "o", "i", "t", "g", "n", "r", "q"
INPUT = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE)

#: Readings in rising order of precedence: each pair is one clause feature.
KINDS = ("insult", "threat")
READINGS = ("plain", "aimed", "negated", "reported")
FEATURES = [f"{kind}_{reading}" for kind in KINDS for reading in READINGS]

#: How many words a negation reaches.
REACH = 3


class Transducer:
    """States, and for (state, symbol) the next state and the written symbol; missing arcs copy and stay."""

    def __init__(self, start: int, arcs: Mapping[tuple[int, str], tuple[int, str]], default: Mapping[int, int] = ()):
        self.start, self.arcs, self.default = start, dict(arcs), dict(default)

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol)) or (self.default.get(state, state), symbol)


def negation() -> Transducer:
    """After a negation, the next REACH words are written as negated (``I``, ``T``)."""
    arcs = {}
    for state in range(REACH + 1):
        arcs[state, NEGATION] = (REACH, NEGATION)
        if state:
            arcs[state, INSULT], arcs[state, THREAT] = (state - 1, "I"), (state - 1, "T")
    return Transducer(0, arcs, {state: state - 1 for state in range(1, REACH + 1)})


def reported_speech() -> Transducer:
    """After a reporting word, and between quote marks, hits are written as reported (``j``, ``u``)."""
    arcs = {}
    for told, quoted in itertools.product((0, 1), (0, 1)):
        state = told + 2 * quoted
        arcs[state, REPORT] = (1 + 2 * quoted, REPORT)
        arcs[state, QUOTE] = (told + 2 * (1 - quoted), QUOTE)
        if state:
            for symbol, out in ((INSULT, "j"), (THREAT, "u"), ("I", "j"), ("T", "u")):
                arcs[state, symbol] = (state, out)
    return Transducer(0, arcs)


def aim() -> Transducer:
    """A hit after a target is written as aimed (``a``, ``h``); a target after a bare hit is written as ``g``, which aims it."""
    return Transducer(0, {(0, TARGET): (1, TARGET), (1, INSULT): (1, "a"), (1, THREAT): (1, "h")})


def compose(machines: Sequence[Transducer]) -> tuple[int, dict[tuple[int, str], tuple[int, str]]]:
    """One machine that passes each symbol through all of ``machines``: its start and all its arcs."""
    first = tuple(m.start for m in machines)
    number, todo, arcs = {first: 0}, [first], {}
    while todo:
        states = todo.pop()
        for symbol in INPUT:
            out, after = symbol, []
            for machine, state in zip(machines, states, strict=True):
                state, out = machine.step(state, out)
                after.append(state)
            target = tuple(after)
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            arcs[number[states], symbol] = (number[target], out)
    return 0, arcs


#: Written symbol -> feature; an insult with a later target in its clause is aimed too.
READ = {
    "i": "insult_plain", "a": "insult_aimed", "I": "insult_negated", "j": "insult_reported",
    "t": "threat_plain", "h": "threat_aimed", "T": "threat_negated", "u": "threat_reported",
}
LATER_TARGET = {"i": "insult_aimed", "t": "threat_aimed"}


class Grammar:
    """The composed machine and the word classes."""

    def __init__(self, lexicon: Mapping[str, Sequence[str]] | None = None, stems: Sequence[str] = ()):
        words = lexicon or {
            INSULT: INSULTS, THREAT: THREATS, TARGET: TARGETS, NEGATION: NEGATIONS, REPORT: REPORTS,
        }
        self.classes = {w: symbol for symbol, listed in words.items() for w in listed}
        self.start, self.arcs = compose([negation(), reported_speech(), aim()])
        self.triggers = {w for w, symbol in self.classes.items() if symbol in (INSULT, THREAT)}
        self.stems = frozenset(stems)
        self.lengths = sorted({len(x) for x in self.stems})

    def symbol(self, word: str) -> str:
        if word in QUOTES:
            return QUOTE
        known = self.classes.get(word.replace("’", "'"))
        return known or (INSULT if any(word[:n] in self.stems for n in self.lengths) else OTHER)

    def read(self, clause: str) -> set[str]:
        """The features of one lower-case clause."""
        state, tape = self.start, []
        for word in WORD.findall(clause):
            state, out = self.arcs[state, self.symbol(word)]
            tape.append(out)
        targets = [k for k, out in enumerate(tape) if out == TARGET]
        last = targets[-1] if targets else -1
        return {LATER_TARGET[x] if x in LATER_TARGET and k < last else READ[x] for k, x in enumerate(tape) if x in READ}

    def finder(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for word in self.triggers | self.stems:
            machine.add_word(word, (len(word), word in self.stems))
        machine.make_automaton()
        return machine

    def clauses(self, text: str, finder) -> Iterator[set[str]]:
        """The features of every clause of ``text`` that holds a trigger."""
        low, done = text.lower(), -1
        for end, (length, open_end) in finder.iter(low):
            start = end - length + 1
            if start < done or start and low[start - 1].isalpha():
                continue
            if not open_end and end + 1 < len(low) and low[end + 1].isalpha():
                continue
            head = max(low.rfind(c, max(done, 0), start) for c in ".!?;:\n") + 1 or max(done, 0)
            tail = CLAUSE_END.search(low, end + 1)
            done = tail.start() if tail else len(low)
            if found := self.read(low[head:done]):
                yield found


def features(texts: pd.Series, grammar: Grammar) -> pd.DataFrame:
    """Clause counts by feature, and the number of matched clauses, of each text."""
    finder, place = grammar.finder(), {name: i for i, name in enumerate(FEATURES)}
    out = np.zeros((len(texts), len(FEATURES) + 1), dtype=np.int64)
    for row, text in enumerate(texts):
        for found in grammar.clauses(text, finder) if text else ():
            out[row, -1] += 1
            for name in found:
                out[row, place[name]] += 1
    return pd.DataFrame(out, columns=[*FEATURES, "clauses"])


def clause_counts(docs: DataFrame, text: str, grammar: Grammar | None = None) -> DataFrame:
    """``docs`` with a long column per feature and ``clauses``; null and empty texts have zeros."""
    own = grammar or Grammar()
    names = [*FEATURES, "clauses"]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def counted(texts: pd.Series) -> pd.DataFrame:
        return features(texts, own)

    marked = docs.drop(*names, "_found").withColumn("_found", counted(F.col(text)))
    return marked.withColumns({n: F.col(f"_found.{n}") for n in names}).drop("_found")


def training_row(key: str) -> Column:
    """Whether a row may be learned from: the crc32 of its key as text leaves 0 or 2 by 3; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 != 1


def stem_counts(sample: DataFrame, text: str, label: str, lengths: tuple[int, int] = (4, 8)) -> DataFrame:
    """(stem, toxic, clean): in how many distinct texts of each label some word starts with the stem."""
    low, high = lengths

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table: dict[str, list[int]] = {}

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([(stem, *n) for stem, n in table.items()], columns=["stem", "toxic", "clean"])
            table.clear()
            return out

        for batch in batches:
            for content, toxic in zip(batch[text], batch[label], strict=True):
                words = set(WORD.findall(content.lower()))
                for stem in {w[:n] for w in words for n in range(low, min(high, len(w)) + 1)}:
                    table.setdefault(stem, [0, 0])[0 if toxic else 1] += 1
                if len(table) > 50_000:  # partial counts, so that a task stays small
                    yield rows()
        yield rows()

    distinct = sample.filter(F.col(text).isNotNull()).groupBy(F.col(text)).agg(F.max(F.col(label) > 0).alias(label))
    parts = distinct.mapInPandas(counted, "stem string, toxic long, clean long")
    return parts.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_stems(sample: DataFrame, text: str, label: str, precision: float = 0.9, candidates: float = 1e6) -> list[str]:
    """Word stems of at least four letters that mark toxic texts in a bounded labelled ``sample``.

    A stem needs ``precision``, and so many toxic texts that among ``candidates`` stems none would be
    expected by chance. Of nested stems the longest one stays that still has nine tenths of the texts.
    """
    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(label) > 0).cast("long")).alias("toxic")).first()
    if not totals["n"] or totals["toxic"] in (None, 0, totals["n"]):
        return []
    least = max(4, int(np.ceil(np.log(candidates) / np.log(totals["n"] / totals["toxic"]))))
    good = stem_counts(sample, text, label).filter(
        (F.col("toxic") >= least) & (F.col("toxic") >= precision * (F.col("toxic") + F.col("clean")))
    )
    counts = {r["stem"]: r["toxic"] for r in good.collect()}
    kept: list[str] = []
    covered: set[str] = set()
    for stem in sorted(counts, key=lambda x: (len(x), x)):
        if any(stem[:n] in covered for n in range(1, len(stem) + 1)):
            continue
        covered.add(stem)
        longest = stem
        while longer := [x for x in counts if x[:-1] == longest and counts[x] >= 0.9 * counts[longest]]:
            longest = min(longer)
        kept.append(longest)
    return kept


def fit(labelled: DataFrame, label: str, clip: int = 3, ridge: float = 0.1) -> tuple[float, np.ndarray]:
    """Intercept and weights of a ridge logistic regression on clause counts clipped at ``clip``.

    The labelled rows are grouped by their clipped counts first, so what comes back to the driver is
    bounded by the distinct vectors, not by the rows, and every labelled row counts. Null labels are
    left out. Without both labels the weights are 2 for bare and aimed readings and 0 for the others.
    """
    vector = [F.least(F.col(n), F.lit(clip)).alias(n) for n in FEATURES]
    groups = (
        labelled.filter(F.col(label).isNotNull())
        .groupBy(*vector)
        .agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(label) > 0).cast("long")).alias("toxic"))
        .collect()
    )
    n = np.array([g["n"] for g in groups], dtype=float)
    toxic = np.array([g["toxic"] for g in groups], dtype=float)
    if not n.sum() or toxic.sum() in (0, n.sum()):
        return -3.0, np.array([2.0 if f.endswith(("plain", "aimed")) else 0.0 for f in FEATURES])
    x = np.array([[1.0, *(g[f] for f in FEATURES)] for g in groups])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * len(FEATURES))
    w[0] = np.log(toxic.sum() / (n.sum() - toxic.sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + penalty, x.T @ (toxic - n * p) - penalty @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), w[1:]


def taught(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, train: Column, sample: int) -> Grammar:
    """The grammar with the stems of at most ``sample`` labelled training rows, those of the lowest key digests."""
    known = labels.select(F.col(key), F.col(label).alias("_label")).filter(
        F.col(key).isNotNull() & F.col(label).isNotNull()
    )
    # Bounded by ``sample``, so it may be broadcast: the texts are not shuffled.
    chosen = known.filter(train).orderBy(F.xxhash64(key), F.col(key)).limit(sample)
    rows = docs.select(key, text).join(F.broadcast(chosen), key).select(text, "_label")
    return Grammar(stems=learn_stems(materialise(rows, "taught"), text, "_label"))


class Model:
    """A grammar with its stems, and the weights of its readings."""

    def __init__(self, grammar: Grammar, bias: float, weights: np.ndarray, clip: int):
        self.grammar, self.bias, self.weights, self.clip = grammar, bias, weights, clip

    def value(self) -> Column:
        """The score of a row that has the clause counts."""
        total = F.lit(self.bias)
        for name, weight in zip(FEATURES, self.weights, strict=True):
            total = total + F.lit(float(weight)) * F.least(F.col(name), F.lit(self.clip))
        return 1 / (1 + F.exp(-total))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    key: str,
    text: str,
    label: str,
    train: Column,
    clip: int = 3,
    sample: int = 20_000,
) -> tuple[Model, DataFrame]:
    """The model, and ``docs`` without its text but with clause counts, written to the shared folder.

    Rows with a label (joined by ``key``) where ``train`` holds are learned from: stems from at most ``sample`` of
    them, weights from all. Null keys and labels are left out.
    """
    own = docs.drop("_label")
    grammar = taught(own, labels, key, text, label, train, sample)
    counted = materialise(clause_counts(own, text, grammar).drop(text), "clauses")
    known = labels.select(F.col(key), F.col(label).alias("_label"))
    bias, weights = fit(counted.select(key, *FEATURES).filter(train).join(known, key), "_label", clip)
    return Model(grammar, bias, weights, clip), counted


def score(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, train: Column, limit: float = 0.7
) -> DataFrame:
    """``docs`` without its text, with clause counts, ``score`` (0 to 1) and ``predicted`` (1 from ``limit`` on).

    The model is that of :func:`learn`; nothing but the text enters a score. Texts without a matched clause,
    null and empty ones among them, all get the score of no finding. Rows are kept one for one; columns named
    like a result are replaced.
    """
    model, counted = learn(docs.drop("score", "predicted"), labels, key, text, label, train)
    value = model.value()
    return counted.withColumn("score", value).withColumn("predicted", (value >= limit).cast("int"))


def keep_clean(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, train: Column, limit: float = 0.7
) -> DataFrame:
    """The rows of ``docs`` that :func:`score` doesn't reject, as they are.

    The texts are read by the grammar again, in place, rather than joined with their scores.
    """
    model, _ = learn(docs.select(key, text), labels, key, text, label, train)
    marked = docs.withColumns({f"_own_{n}": F.col(n) for n in docs.columns if n in (*FEATURES, "clauses")})
    kept = clause_counts(marked, text, model.grammar).filter(model.value() < limit)
    return kept.select(*[F.col(f"_own_{n}").alias(n) if f"_own_{n}" in kept.columns else F.col(n) for n in docs.columns])
