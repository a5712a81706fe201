"""Toxicity by a weighted finite-state pattern grammar.

The machine is a chain of transducers. The lexicon reads the letters of a word and writes its class: insult, threat,
target, negation, reporting verb or other, with a weight in its final states; learned stems are states that accept
whatever follows. Clauses of these classes are then read twice: from right to left by a transducer that marks threats and
insults aimed at a target behind them, and from left to right by the composition of three that mark negation, reported
speech and a target ahead. What is written at an insult or threat is the label of its path, and it is the path that
decides: a clause weighs its lexeme's weight times its path's precision. A plain or aimed insult or an aimed threat
is evidence enough alone; negated, reported or unaimed ones are not, unless the labels say so. Clauses combine as
independent evidence.

Fitting: lexemes (words, and word stems of 4 to 7 letters) are learned from a bounded sample of labelled rows. A lexeme
must occur between many different neighbours in toxic documents, so that copies of one document teach nothing, and
rarely in others. One that is precise only, or mostly, with a target close behind it is learned as a threat. One
document counts PER_DOCUMENT times for a lexeme at most, toxic or not. Path precisions are counted on the same sample
and shrunk toward priors.

Defined results: null and empty texts score the share of toxic rows among documents without a match; repeated rows score
alike; null labels and ids take no part in fitting; an empty label table leaves the seed lexicon and the priors.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, held_out, lean, materialize, sample_hash, sample_threshold

#: Labelled rows that fitting takes at most (expected; rows are chosen by a hash of their id).
FIT_ROWS = 12_000
#: A learned lexeme needs so many different contexts and this precision; one aimed in this share of its contexts is a threat.
LEAST_CONTEXTS, LEAST_PRECISION, AIMED = 8, 0.8, 0.6
#: Evidence that one document gives for a lexeme at most, toxic or not: one long document teaches little.
PER_DOCUMENT = 3
#: Words between a threat and a target behind it at most, and one.
REACH = 3

# The seed word lists of the transducers.
INSULTS = ("idiot", "moron", "scum", "loser", "pathetic", "worthless", "stupid", "imbecile", "dumbass", "arschloch", "dummkopf", "vollidiot", "connard", "abruti", "salope", "gilipollas", "imbécil", "estúpido")
THREATS = ("kill", "murder", "strangle", "stab", "töten", "umbringen", "tuer", "égorger", "matar", "asesinar")
TARGETS = ("you", "your", "u", "he", "she", "they", "her", "du", "ihr", "sie", "tu", "vous", "votre", "ton", "tú", "usted", "ustedes", "vosotros")
OBJECTS = ("him", "them", "dich", "dir", "euch", "te", "toi", "ti", "os")
NEGATIONS = ("not", "no", "never", "isn", "aren", "don", "nicht", "kein", "keine", "nie", "pas", "jamais", "ne", "nunca", "jamás")
REPORTS = ("said", "says", "wrote", "quoted", "called", "claimed", "sagte", "schrieb", "zitierte", "dit", "écrit", "cité", "dijo", "escribió", "citó")

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]").findall
_OTHER = ("other", 0.0)
_STOPS = frozenset(".!?;\n")
# Prior precision of each path; 0.3 decides.
_PATH = {"insult": 0.9, "insult+target": 0.93, "insult+negated": 0.2, "insult+reported": 0.2, "threat": 0.15, "threat+target": 0.45, "threat+negated": 0.1, "threat+reported": 0.1}


class Transducer:
    """Deterministic transducer over class symbols: step(state, symbol) -> (state, symbol written)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """Composition: what this one writes is read by the other."""

        def step(state, symbol):
            a, out = self.step(state[0], symbol)
            b, out = other.step(state[1], out)
            return (a, b), out

        return Transducer((self.start, other.start), step)

    def table(self, symbols: list[str]) -> dict:
        """All arcs that can be reached, as a dictionary."""
        arcs, todo = {}, [self.start]
        while todo:
            s = todo.pop()
            for x in symbols:
                if (s, x) not in arcs:
                    arcs[s, x] = self.step(s, x)
                    todo.append(arcs[s, x][0])
        return arcs


def _within(reach: int, triggers: tuple[str, ...], mark: str, kinds: tuple[str, ...] = ("insult", "threat")) -> Transducer:
    """Marks an insult or threat that comes at most `reach` words behind a trigger; 0 is any number. First mark wins."""

    def step(left, symbol):
        out = f"{symbol}+{mark}" if left and symbol in kinds else symbol
        if symbol in triggers:
            return (reach or -1), out
        return (left - 1 if left > 0 else left), out

    return Transducer(0, step)


CLASSES = ["other", "insult", "threat", "target", "object", "negation", "report"]
# Read from the right: the targets behind a word. Read from the left: negation and reported speech, which take precedence over a target,
# and targets ahead, which as subjects say who is insulted, but not who is threatened.
AIM = _within(REACH, ("target", "object"), "aimed")
GRAMMAR = _within(3, ("negation",), "negated").then(_within(0, ("report",), "reported")).then(_within(4, ("object",), "target")).then(_within(4, ("target",), "target", ("insult",)))
ARCS, BACK = GRAMMAR.table(CLASSES), AIM.table(CLASSES)


def lexicon(accepted: dict[str, tuple[str, float]], stems: dict[str, tuple[str, float]]) -> Transducer:
    """Transducer over letters: a trie whose states carry what is written at the end of a word. A word's own state comes first; else
    the heaviest stem on the way. States are (node, heaviest stem so far); a letter without an arc leads to the node -1."""
    arcs: list[dict[str, int]] = [{}]
    word_of: list[tuple[str, float] | None] = [None]
    stem_of: list[tuple[str, float] | None] = [None]
    for entries, final in ((accepted, word_of), (stems, stem_of)):
        for letters, written in entries.items():
            node = 0
            for c in letters:
                if c not in arcs[node]:
                    arcs[node][c] = len(arcs)
                    arcs.append({})
                    word_of.append(None)
                    stem_of.append(None)
                node = arcs[node][c]
            final[node] = written

    def step(state, letter):
        node, best = state
        node = arcs[node].get(letter, -1) if node >= 0 else -1
        here = stem_of[node] if node >= 0 else None
        if here and (best is None or here[1] > best[1]):
            best = here
        return (node, best), (node >= 0 and word_of[node]) or best or _OTHER

    return Transducer((0, None), step)


@dataclass
class Model:
    lexemes: dict[str, tuple[str, float]] = field(default_factory=dict)  # class and precision of words and stems
    stems: dict[str, tuple[str, float]] = field(default_factory=dict)
    labels: dict[str, float] = field(default_factory=lambda: dict(_PATH))
    unmatched: float = 0.05

    def classes(self) -> Classifier:
        return Classifier(self)


class Classifier:
    """The composed machine; what the lexicon wrote for a word is remembered (bounded)."""

    def __init__(self, model: Model, remember: int = 100_000):
        self.model, self.remember = model, remember
        fixed = {w: ("report", 0.0) for w in REPORTS} | {w: ("negation", 0.0) for w in NEGATIONS} | {w: ("target", 0.0) for w in TARGETS} | {w: ("object", 0.0) for w in OBJECTS} | {w: ("threat", 1.0) for w in THREATS} | {w: ("insult", 1.0) for w in INSULTS}
        self.letters = lexicon(fixed | model.lexemes, model.stems)
        self.seen: dict[str, tuple[str, float]] = {}
        self.weights = {k: model.labels.get(k.replace("aimed", "target"), 0.0) for k in {out for _, out in ARCS.values()} | {out for _, out in BACK.values()}}

    def word(self, w: str) -> tuple[str, float]:
        state, out = self.letters.start, _OTHER
        for c in w:
            state, out = self.letters.step(state, c)
            if state[0] < 0:  # no arc leads back: the rest of the word changes nothing
                break
        if len(self.seen) > self.remember:
            self.seen.clear()
        self.seen[w] = out
        return out

    def matches(self, text: str) -> list[tuple[str, float, str]]:
        """(label, lexeme weight, word) of the heaviest match of each matched clause."""
        tokens = _TOKEN(text.lower())
        get = self.seen.get
        kinds = [get(t) or self.word(t) for t in tokens]
        if not any([w for _, w in kinds]):
            return []
        ends = [k for k, t in enumerate(tokens) if t in _STOPS]
        found = []
        for a, b in zip([0, *(k + 1 for k in ends)], [*ends, len(tokens)], strict=True):
            if best := self._clause(tokens[a:b], kinds[a:b]):
                found.append(best)
        return found

    def _clause(self, tokens: list[str], kinds: list[tuple[str, float]]) -> tuple[str, float, str] | None:
        if not any([w for _, w in kinds]):
            return None
        aimed, state = [False] * len(kinds), AIM.start
        for k in range(len(kinds) - 1, -1, -1):
            state, out = BACK[state, kinds[k][0]]
            aimed[k] = out.endswith("+aimed")
        best, state = None, GRAMMAR.start
        for k, (kind, weight) in enumerate(kinds):
            state, out = ARCS[state, kind]
            if weight:
                label = f"{out}+target" if aimed[k] and "+" not in out else out
                if best is None or weight * self.weights.get(label, 0.0) > best[1] * self.weights.get(best[0], 0.0):
                    best = (label, weight, tokens[k])
        return best

    def score(self, found: list[tuple[str, float, str]]) -> float:
        clean = 1 - self.model.unmatched
        for label, weight, _ in found:
            clean *= 1 - weight * self.weights.get(label, 0.0)
        return float(min(1.0, max(0.0, 1 - clean)))


_AIMS = frozenset(TARGETS) | frozenset(OBJECTS)


def _lexemes(word: str) -> list[str]:
    """The word and its stems; stems are marked by a star."""
    return [word, *(word[:k] + "*" for k in (4, 5, 6, 7) if len(word) >= k)]


def _places(text: str | None) -> Iterator[tuple[str, int, bool]]:
    """(word, hash of its neighbours, whether a target comes close behind it in its clause) of each word."""
    tokens = _TOKEN((text or "").lower())
    w = [(k, t) for k, t in enumerate(tokens) if t not in _STOPS]
    near = -1  # words left from which a target is in reach, read from the right
    aimed = []
    for t in reversed(tokens):
        if t in _STOPS:
            near = -1
            continue
        aimed.append(near > 0)
        near = REACH if t in _AIMS else near - 1
    aimed.reverse()
    for n, (_, word) in enumerate(w):
        before, after = w[n - 1][1] if n else "", w[n + 1][1] if n + 1 < len(w) else ""
        yield word, zlib.crc32(f"{before} {after}".encode()), aimed[n]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lexeme, context, aimed): neighbours of the words of toxic documents, PER_DOCUMENT of each lexeme and document."""
    for batch in batches:
        pairs: dict[tuple[str, int], bool] = {}
        for text in batch.column("text").to_pylist():
            own: dict[str, dict[int, bool]] = {}
            for word, context, aimed in _places(text):
                for lexeme in _lexemes(word):
                    had = own.setdefault(lexeme, {})
                    if context in had or len(had) < PER_DOCUMENT:
                        had[context] = had.get(context, False) or aimed
            for k, had in own.items():
                for c, aimed in had.items():
                    pairs[k, c] = pairs.get((k, c), False) or aimed
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int64()), pa.array(list(pairs.values()), pa.bool_())], ["lexeme", "context", "aimed"])


def _elsewhere(candidates: frozenset):
    """(lexeme, n, aimed): occurrences in documents that are not toxic, PER_DOCUMENT of each lexeme and document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            aims: Counter = Counter()
            for text in batch.column("text").to_pylist():
                own: Counter = Counter()
                aimed: Counter = Counter()
                for word, n in Counter(_TOKEN((text or "").lower())).items():
                    for lexeme in _lexemes(word):
                        if lexeme in candidates:
                            own[lexeme] += n
                if own:
                    for word, _, aim in _places(text):
                        if aim:
                            aimed.update(x for x in _lexemes(word) if x in own)
                counts.update({k: min(n, PER_DOCUMENT) for k, n in own.items()})
                aims.update({k: min(n, PER_DOCUMENT) for k, n in aimed.items()})
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([aims[k] for k in counts], pa.int64())], ["lexeme", "n", "aimed"])

    return run


def _label_counts(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.classes()
        for batch in batches:
            counts: Counter = Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = {label for label, _, _ in reader.matches(text or "")}
                counts.update((label, toxic) for label in found or {"none"} if len(found) < 2)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["label", "toxic", "n"])

    return run


def _part(n: int, other: int) -> float:
    return n / (n + other + 0.5)


def _choose(support: dict[str, tuple[int, int]], elsewhere: dict[str, tuple[int, int]]) -> tuple[dict[str, tuple[str, float]], dict[str, tuple[str, float]]]:
    """Words and stems that are precise, each with its class. A stem must be productive (three precise words have it), or stay precise
    without its precise words. support and elsewhere: (occurrences, aimed ones) of each lexeme."""
    none = (0, 0)
    kept: dict[str, tuple[str, float]] = {}
    for k, (n, aimed) in support.items():
        other, other_aimed = elsewhere.get(k, none)
        if _part(n, other) >= LEAST_PRECISION:
            kept[k] = ("threat" if aimed >= AIMED * n else "insult", _part(n, other))
        elif aimed >= LEAST_CONTEXTS and _part(aimed, other_aimed) >= LEAST_PRECISION:
            kept[k] = ("threat", _part(aimed, other_aimed))
    words = {k: v for k, v in kept.items() if k[-1] != "*"}
    under: dict[str, list[str]] = {}
    for w in words:
        for stem in _lexemes(w)[1:]:
            under.setdefault(stem, []).append(w)
    stems = {}
    for k, v in kept.items():
        if k[-1] == "*":
            own = under.get(k, [])
            rest, other = support[k][0] - sum(support[w][0] for w in own), elsewhere.get(k, none)[0] - sum(elsewhere.get(w, none)[0] for w in own)
            if len(own) >= 3 or rest >= LEAST_CONTEXTS and _part(rest, max(0, other)) >= LEAST_PRECISION:
                stems[k[:-1]] = v
    return words, stems


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Learn from labelled rows that are not held out; fit_rows bounds their expected number, and so every size below."""
    usable = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = usable.count()
    if not total:
        return Model()
    chosen = usable.where(sample_hash("fit", "doc_id") < sample_threshold(fit_rows, total))
    sample = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id"), "toxic-fit")  # bounded by fit_rows
    bad, good = sample.where("toxic = 1"), sample.where("toxic = 0")
    contexts = bad.select("text").mapInArrow(lean(_contexts), "lexeme string, context long, aimed boolean").groupBy("lexeme", "context").agg(F.max("aimed").alias("aimed"))
    contexts = contexts.groupBy("lexeme").agg(F.count("*").alias("n"), F.count_if("aimed").alias("aimed")).where(F.col("n") >= LEAST_CONTEXTS)
    support = {r["lexeme"]: (r["n"], r["aimed"]) for r in contexts.collect()}  # from the toxic rows of the sample alone
    other = good.select("text").mapInArrow(lean(_elsewhere(frozenset(support))), "lexeme string, n long, aimed long").groupBy("lexeme").agg(F.sum("n").alias("n"), F.sum("aimed").alias("aimed"))
    elsewhere = {r["lexeme"]: (r["n"], r["aimed"]) for r in other.collect()} if support else {}
    model = Model(*_choose(support, elsewhere))
    counts = {(r["label"], r["toxic"]): r["n"] for r in sample.select("text", "toxic").mapInArrow(lean(_label_counts(model)), "label string, toxic int, n long").groupBy("label", "toxic").agg(F.sum("n").alias("n")).collect()}
    shrink = lambda label, prior: (counts.get((label, 1), 0) + 10 * prior) / (counts.get((label, 1), 0) + counts.get((label, 0), 0) + 10)
    model.labels = {k: shrink(k, p) for k, p in _PATH.items()}
    model.unmatched = min(0.25, shrink("none", 0.05))
    drop_tables(sample)
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, score, n_clauses matched, labels (paths of the matched clauses), words."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.classes()
        for batch in batches:
            found = [reader.matches(t) if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array([reader.score(m) for m in found], dtype=float)), pa.array([len(m) for m in found], pa.int64()), pa.array([[x[0] for x in m] for m in found], pa.list_(pa.string())), pa.array([[x[2] for x in m] for m in found], pa.list_(pa.string()))],
                ["doc_id", "score", "n_clauses", "labels", "words"],
            )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, score double, n_clauses long, labels array<string>, words array<string>")


def remove_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Rows of docs, all columns, whose score is below the threshold; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.classes()
        for batch in batches:
            yield batch.filter(pa.array([reader.score(reader.matches(t) if t else []) < threshold for t in batch.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
