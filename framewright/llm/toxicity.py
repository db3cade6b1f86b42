"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is a sequence of clauses, a clause a sequence of word classes. Five letter-to-letter
transducers read the classes one after the other, each rewriting what the one before it
wrote, and are composed into one deterministic transition table:

* negation: an insult or threat within three words after a negator is marked,
* reported speech: so is one after a verb of saying in its clause,
* target: so is one within five words after a word for a person that is addressed,
* threat: a verb of harm becomes a threat when an announcement came before it or a
  target word follows it,
* insult: what remains is written as the kind of the clause's match.

A clause counts once, with its heaviest match, and a text's score is a logistic function
of its clauses by kind. The word classes come from fixed lists and from insults learned
on labelled rows: words, and word beginnings of 4 to 6 letters, that stand in several
different contexts of several toxic texts and are far rarer elsewhere. Contexts count
beside texts, as a copied text would make all its words look telling. The weights of
the kinds are fitted on the same rows, from fixed starting values.

Only rows whose crc32(id as text) mod 3 is not 1 are learned from, ``SAMPLE`` at
most (those with the smallest hashes of their ids), with their whole texts.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.workspace import Workspace, tidied

#: Most labelled rows that are learned from: toxic ones, others.
SAMPLE = (1500, 4500)
#: Least number of contexts and of texts of a learned entry; least log ratio of its rates.
CONTEXTS, LIFT = 3, 4.0
THRESHOLD = 0.7
#: Word classes that a worker keeps while a task runs.
CACHED = 100_000
STEMS = (4, 5, 6)

#: Word lists. Fixed values.
INSULTS = (
    "idiot idiots moron morons stupid dumb fool loser losers scum trash worthless pathetic disgusting clown "
    "imbecile jerk bastard bitch asshole dumbass retard scumbag filth vermin coward liar pig crap "
    "dummkopf arschloch trottel abschaum wertlos imbécile connard salaud débile ordure estúpido idiota imbécil basura escoria"
).split()
HARMS = "kill hurt destroy beat stab shoot strangle punch burn murder attack töten schlagen umbringen tuer frapper matar golpear".split()
ANNOUNCERS = "will gonna shall must should werde vais vas voy quiero want".split()
TARGETS = "you your yours u he she him her they them these those those du dich dir ihr sie er tu toi vous te il elle ils tú usted él ella ellos".split()
NEGATORS = "not never no without isn aren wasn weren don doesn didn hardly nicht kein keine nie niemals ne pas jamais aucun nunca ningún sin".split()
REPORTERS = "said says saying claimed claims called calls quoted quote wrote reported alleged sagte sagt behauptet schrieb dit disait écrit prétend dijo dice escribió afirma".split()

OTHER, INSULT, HARM, ANNOUNCE, TARGET, NEGATE, REPORT, END = range(8)
#: Kinds of matches, from light to heavy, and the starting weights of their clauses.
KINDS = ("insult negated", "insult reported", "threat negated or reported", "insult", "insult at a target", "threat")
START = (-4.0, 0.8, 1.6, 0.8, 5.0, 6.0, 6.0)

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
_WORD = re.compile(r"[^\W\d_]+")
_BREAKS = ".!?;\n"


@dataclass(frozen=True)
class Transducer:
    """A deterministic letter-to-letter transducer; a letter is (class, marks)."""

    start: object
    step: Callable[[object, tuple], tuple]

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one writes."""

        def step(state, letter):
            first, written = self.step(state[0], letter)
            second, out = other.step(state[1], written)
            return (first, second), out

        return Transducer((self.start, other.start), step)


def _scope(trigger: int, mark: str, width: int | None) -> Transducer:
    """Marks insults and harms up to ``width`` words after a trigger, or up to the clause's end."""

    def step(left, letter):
        kind, marks = letter
        if kind == END:
            return 0, letter
        if kind == trigger:
            return width or 1, letter
        if left and kind in (INSULT, HARM):
            letter = kind, marks | {mark}
        return left - 1 if left and width else left, letter

    return Transducer(0, step)


def _threat() -> Transducer:
    """Writes a harm verb as a threat at once after an announcement, else when a target follows in three words."""

    def step(state, letter):
        announced, pending, kept = state
        kind, marks = letter
        if kind == END:
            return (0, 0, frozenset()), letter
        if kind == HARM:
            if announced:
                return (0, 0, frozenset()), ("threat", marks)
            return (0, 3, marks), (OTHER, frozenset())
        if kind == TARGET and pending:
            return (0, 0, frozenset()), ("threat", kept)
        if kind == ANNOUNCE:
            return (4, 0, frozenset()), letter
        pending = max(0, pending - 1)
        return (max(0, announced - 1), pending, kept if pending else frozenset()), letter

    return Transducer((0, 0, frozenset()), step)


def _insult() -> Transducer:
    """Writes the number of the match's kind, from 1, and 0 where there is no match."""

    def step(state, letter):
        kind, marks = letter
        if kind == "threat":
            return state, 3 if marks & {"negated", "reported"} else 6
        if kind == INSULT:
            return state, 1 if "negated" in marks else 2 if "reported" in marks else 5 if "at" in marks else 4
        return state, 0

    return Transducer(None, step)


def grammar() -> list[list[tuple[int, int]]]:
    """The composed table: by state and class, the next state and the match that is written."""
    whole = _scope(NEGATE, "negated", 3).then(_scope(REPORT, "reported", None)).then(_scope(TARGET, "at", 5)).then(_threat()).then(_insult())
    states = {whole.start: 0}
    table: list[list[tuple[int, int]]] = []
    waiting = [whole.start]
    for state in waiting:
        row = []
        for kind in range(END + 1):
            after, out = whole.step(state, (kind, frozenset()))
            if after not in states:
                states[after] = len(states)
                waiting.append(after)
            row.append((states[after], out))
        table.append(row)
    return table


def _listed() -> dict[str, int]:
    out: dict[str, int] = {}
    for kind, words in ((REPORT, REPORTERS), (NEGATE, NEGATORS), (TARGET, TARGETS), (ANNOUNCE, ANNOUNCERS), (HARM, HARMS), (INSULT, INSULTS)):
        out |= dict.fromkeys(words, kind)
    return out


class _Classes(dict):
    """Bounded cache of word classes."""

    def __init__(self, words: frozenset[str], stems: frozenset[str]):
        self.words, self.stems, self.listed = words, stems, _listed()
        self.update(dict.fromkeys(_BREAKS, END))

    def __missing__(self, word: str) -> int:
        kind = self.listed.get(word, OTHER)
        if kind != INSULT and (word in self.words or any(word[:n] in self.stems for n in STEMS if len(word) > n)):
            kind = INSULT
        if len(self) > CACHED:
            self.clear()
            self.update(dict.fromkeys(_BREAKS, END))
        if len(word) < 64:
            self[word] = kind
        return kind


@dataclass
class Model:
    """Learned words and stems, and the weights: intercept, then one for each kind."""

    words: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()
    weights: tuple[float, ...] = START
    _ready: tuple | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems, "weights": self.weights, "_ready": None}

    def release(self) -> None:
        """Empties the cache of word classes."""
        self._ready = None

    def clauses(self, text: str) -> list[int]:
        """How many clauses of each kind the text has."""
        if self._ready is None:
            self._ready = _Classes(self.words, self.stems), grammar()
        classes, table = self._ready
        kinds = bytes(map(classes.__getitem__, _TOKEN.findall(text.lower())))
        counts = [0] * len(KINDS)
        if INSULT not in kinds and HARM not in kinds:
            return counts
        state = heaviest = 0
        for kind in kinds:
            state, out = table[state][kind]
            if out > heaviest:
                heaviest = out
            if kind == END and heaviest:
                counts[heaviest - 1] += 1
                heaviest = 0
        if heaviest:
            counts[heaviest - 1] += 1
        return counts

    def score(self, text: str | None) -> float:
        """Probability that the text is toxic; null and empty texts have no clauses."""
        x = features(self.clauses(text or ""))
        return float(1 / (1 + np.exp(-(x @ np.array(self.weights)))))


def features(clauses: list[int]) -> np.ndarray:
    """1, then 1 + log of each count that isn't 0."""
    return np.array([1.0] + [1 + np.log(c) if c else 0.0 for c in clauses])


def fit_weights(x: np.ndarray, y: np.ndarray, pull: float = 0.5, steps: int = 30) -> tuple[float, ...]:
    """Logistic regression by Newton steps, pulled towards the starting weights."""
    w0 = np.array(START)
    w = w0.copy()
    for _ in range(steps if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - pull * (w - w0)
        curve = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return tuple(float(v) for v in w)


def _items(text: str) -> Iterator[tuple[str, int, int]]:
    """Words and stems (with a star) of a text, each with hashes of its word and of the words beside it."""
    words = _WORD.findall(text.lower())
    for k, word in enumerate(words):
        beside = hash((words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else ""))
        own = hash(word)
        yield word, own, beside
        for n in STEMS:
            if len(word) > n:
                yield word[:n] + "*", own, beside


def _distinct(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key with its number of distinct values."""
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])
    return np.unique(keys[new], return_counts=True)


def _telling(texts: list[str]) -> dict[int, int]:
    """Hashes of the items of toxic texts, with the number of their contexts or texts, the smaller one.

    Of a stem, the contexts of its most frequent word do not count.
    """
    columns = [array("q") for _ in range(4)]
    for number, text in enumerate(texts):
        for item, own, beside in _items(text):
            for column, value in zip(columns, (hash(item), own, beside, number), strict=True):
                column.append(value)
    item, own, beside, number = (np.frombuffer(c, np.int64) if len(c) else np.zeros(0, np.int64) for c in columns)
    names, contexts = _distinct(item, beside)
    read = _distinct(item, number)[1]
    most = np.zeros(len(names), np.int64)
    stem = item != own
    place = np.searchsorted(names, item[stem])
    np.maximum.at(most, place, contexts[np.searchsorted(names, own[stem])])
    met = np.minimum(contexts - most, read)
    good = met >= CONTEXTS
    return dict(zip(names[good].tolist(), met[good].tolist(), strict=True))


def learn_entries(rows: Iterator[tuple[str | None, int]]) -> list[str]:
    """Words and stems that tell toxic texts; ``rows`` are (text, label), the toxic ones first."""
    toxic: list[str] = []
    telling: dict[int, int] | None = None
    met, beside_met = array("q"), array("q")
    sizes = [1, 1]
    for text, label in rows:
        text = text or ""
        sizes[label] += len(_WORD.findall(text))
        if label:
            toxic.append(text)
            continue
        telling = _telling(toxic) if telling is None else telling
        for item, _, beside in _items(text):
            if (h := hash(item)) in telling:
                met.append(h)
                beside_met.append(beside)
    telling = _telling(toxic) if telling is None else telling
    other = dict(zip(*(x.tolist() for x in _distinct(np.array(met, np.int64), np.array(beside_met, np.int64))), strict=True))
    chosen = {}
    for h, n in telling.items():
        lift = np.log((n + 0.5) / sizes[1]) - np.log((other.get(h, 0) + 0.5) / sizes[0])
        if lift >= LIFT:
            chosen[h] = n
    named = {item: chosen[h] for text in toxic for item, _, _ in _items(text) if (h := hash(item)) in chosen}
    return sorted(named, key=lambda item: (-named[item], item))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

    yield pa.RecordBatch.from_arrays([pa.array(learn_entries(rows()), pa.string())], ["entry"])


def held_out(id_col: Column) -> Column:
    """Whether a row must not be learned from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: tuple[int, int] = SAMPLE) -> Model:
    """A model from labelled rows; without any, the fixed lists and starting weights.

    The sample is at most sum(``sample``) rows of (id, label), which are broadcast, and
    their texts are read by one task.
    """
    space = Workspace(docs.sparkSession, "toxicity")
    marked = labels.select(labels[id_col].alias("__fw_id"), F.col("toxic").cast("int").alias("toxic")).where("__fw_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("__fw_id")))
    chosen = [marked.where(F.col("toxic") == y).orderBy(F.xxhash64("__fw_id"), "__fw_id").limit(n) for y, n in zip((1, 0), sample, strict=True)]
    ids = F.broadcast(chosen[0].union(chosen[1]))
    rows = docs.select(docs[id_col].alias("__fw_id"), docs[text_col].cast("string").alias("text")).join(ids, "__fw_id").select("text", "toxic")
    rows = space.save(rows, "sample")
    ordered = rows.coalesce(1).sortWithinPartitions(F.desc("toxic"), "text")
    entries = [r[0] for r in ordered.mapInArrow(_learn, "entry string").collect()]  # of ``sample`` texts at most
    model = Model(frozenset(e for e in entries if e[-1] != "*"), frozenset(e[:-1] for e in entries if e[-1] == "*"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.clauses(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), batch.column(1)], ["clauses", "toxic"])

    found = rows.mapInArrow(count, "clauses array<long>, toxic int").collect()  # sum(sample) rows at most
    model.weights = fit_weights(np.array([features(r[0]) for r in found]).reshape(-1, len(START)), np.array([float(r[1]) for r in found]))
    space.drop("sample")
    return model


def scores(model: Model, text: Column) -> Column:
    """The model's score of a text column."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return tidied((pd.Series([model.score(t) for t in texts], dtype="float64") for texts in batches), model.release)

    return score(text.cast("string"))


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null and empty texts get the score of a text without matches. A null id is not
    held out; repeated rows get equal scores; a score equal to ``threshold`` counts as
    toxic; a text of any length is read whole; other columns are ignored; an empty table
    gives an empty table.
    """
    scored = docs.select(docs[id_col].alias("doc_id"), F.coalesce(held_out(docs[id_col]), F.lit(False)).alias("held_out"), scores(model, docs[text_col]).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns.

    Null and empty texts stay, as they have no clauses. Repeated rows share their fate;
    an empty table gives an empty table.
    """
    return docs.where(scores(model, docs[text_col]) < threshold)
