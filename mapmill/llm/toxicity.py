"""Toxicity by a weighted finite-state grammar of clauses.

Words become symbols (insult, threat, target, negation, report, other) by a lexicon of words and stems. Small sequential transducers
rewrite the symbols: ``negation`` marks hostile words within its reach, ``reported`` those that are told of someone, and ``clause``
reads one clause and gives, at its end, the kind of its strongest match and whether it has a target. Their composition is one
transducer of about a hundred states, whose final arcs carry a weight for each kind of clause. A text is scored by its matched clauses, a
clause by the weight of its kind and of its strongest hostile word, against the number of its words: what chance puts into a long text
is no sign of anything.

Fixed lists give the grammar a start in four languages. Labels then give words and stems their weights (log odds of their rates, where
counts leave no doubt) and the kinds of clauses theirs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapmill.llm.quality import held_out
from mapmill.llm.words import let, words
from mapmill.storage import materialize, scratch

#: Labelled documents of each class that the model is fitted on, at most: those of the smallest id hashes.
SAMPLE = 10_000
#: Entries of the lexicon that labels may add: those of the surest counts.
LEXICON = 5_000
#: Score from which a text counts as toxic.
THRESHOLD = 0.5
#: Words after a negation that it reaches.
REACH = 3
#: Stems are the first 3 to 8 letters of longer words.
STEMS = range(3, 9)
#: Documents that must hold a term, least log odds of a term, and how much surer than chance its counts must be (beyond the number of terms tried).
LEAST_DOCS, LEAST_ODDS, SURE = 3, 1.5, 4.0
#: Weight of a fixed entry that no label speaks about, and the largest weight.
START, MOST = 2.0, 8.0
#: Sketches that tell copies in the sample.
SKETCHES = 8
#: Characters of a text that are taken apart at a time; words at the border stay whole.
PIECE = 1 << 20

# Words of four languages that the grammar starts from.
WORDS = {
    "insult": "idiot idiots stupid moron morons scum loser losers trash worthless pathetic disgusting clown dumb imbecile dumm dummkopf arschloch abschaum crétin abruti connard imbécile estúpido idiota basura inútil",
    "threat": "kill killed hurt destroy beat burn stab shoot strangle murder töten umbringen schlagen erschießen tuer frapper brûler matar golpear quemar",
    "target": "you your yours yourself he she him her they them their these those people du dich dir euch ihr ihnen tu toi vous eux tú ti usted ustedes ellos ellas",
    "negation": "not no never neither nor without don't doesn't isn't aren't wasn't won't can't nicht kein keine keinen nie niemals pas jamais ne ni no nunca jamás tampoco sin",
    "report": "said says say wrote writes called calls quoted claimed reported accused sagte sagt schrieb nannte behauptete dit disait écrit appelle dijo dice escribió llamó",
}

OTHER, BREAK, TARGET, NEGATION, REPORT, INSULT, THREAT, NEGATED_INSULT, NEGATED_THREAT, TOLD_INSULT, TOLD_THREAT = range(11)
SYMBOL = {"insult": INSULT, "threat": THREAT, "target": TARGET, "negation": NEGATION, "report": REPORT}
NEGATED = {INSULT: NEGATED_INSULT, THREAT: NEGATED_THREAT}
TOLD = {INSULT: TOLD_INSULT, THREAT: TOLD_THREAT, NEGATED_INSULT: TOLD_INSULT, NEGATED_THREAT: TOLD_THREAT}
#: Hostile symbols from the weakest to the strongest; a clause is of the kind of its strongest one.
STRENGTH = (TOLD_INSULT, NEGATED_INSULT, TOLD_THREAT, NEGATED_THREAT, INSULT, THREAT)
#: Weights of the kinds before any label is seen, without and with a target in the clause; then of the length of the text, and the bias.
PRIOR = np.array([0.5, 0.5, 0.5, 0.5, 2.0, 1.5, 1.0, 1.0, 1.0, 1.0, 3.0, 3.0])
PRIOR_LENGTH, PRIOR_BIAS, PRECISION = 0.0, -3.0, 0.02

TOKEN = re.compile(r"[^\W\d_]+(?:'t\b)?|[.!?;:\n]+")
SPACE = re.compile(r"\s")


@dataclass
class Transducer:
    """A sequential transducer: for each state and symbol the next state and the symbol given out (None gives nothing)."""

    arcs: dict[tuple, tuple]
    start: object = 0

    @staticmethod
    def of(states: list, symbols: range, arc: Callable) -> Transducer:
        return Transducer({(q, a): arc(q, a) for q in states for a in symbols}, states[0])

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one gives out is read by the other. Only states that can be reached are made."""
        arcs, start, symbols = {}, (self.start, other.start), {a for _, a in self.arcs}
        todo, seen = [start], {start}
        while todo:
            p, q = at = todo.pop()
            for a in symbols:
                p2, b = self.arcs[p, a]
                q2, c = other.arcs[q, b] if b is not None else (q, None)
                arcs[at, a] = (p2, q2), c
                if (p2, q2) not in seen:
                    seen.add((p2, q2))
                    todo.append((p2, q2))
        return Transducer(arcs, start)


SYMBOLS = range(11)
negation = Transducer.of(list(range(REACH + 1)), SYMBOLS, lambda q, a: (REACH, OTHER) if a == NEGATION else (0, a) if a == BREAK else (max(q - 1, 0), NEGATED.get(a, a) if q else a))
reported = Transducer.of([0, 1], SYMBOLS, lambda q, a: (1, OTHER) if a == REPORT else (0, a) if a == BREAK else (q, TOLD.get(a, a) if q else a))


def _clause(q: tuple[int, bool], a: int) -> tuple:
    best, target = q
    if a == BREAK:
        return (-1, False), (best + len(STRENGTH) * target if best >= 0 else None)
    return (max(best, STRENGTH.index(a) if a in STRENGTH else -1), target or a == TARGET), None


clause = Transducer.of([(-1, False), *[(b, t) for b in range(-1, len(STRENGTH)) for t in (False, True) if (b, t) != (-1, False)]], SYMBOLS, _clause)


def grammar() -> tuple[list[list[int]], list[list[int]]]:
    """The composed transducer as tables: next state and kind given out (-1 for none) of each state and symbol read."""
    whole = negation.then(reported).then(clause)
    names = {whole.start: 0}
    for q, _ in whole.arcs:
        names.setdefault(q, len(names))
    step, kind = ([[0] * len(SYMBOLS) for _ in names] for _ in range(2))
    for (q, a), (r, out) in whole.arcs.items():
        step[names[q]][a], kind[names[q]][a] = names[r], -1 if out is None else out
    return step, kind


STEP, KIND = grammar()


class Lexicon(dict):
    """Number of the entry of a word: itself, else its longest stem, else 0. Words are remembered up to a bound."""

    MOST = 500_000

    def __init__(self, entries: dict[str, tuple[int, float]]):
        super().__init__()
        names = sorted(entries)
        self.number = {n: i + 1 for i, n in enumerate(names)}
        self.symbols = np.array([OTHER, *[entries[n][0] for n in names]], np.int64)
        self.weights = np.array([0.0, *[entries[n][1] for n in names]])
        self.lengths = sorted({len(n) - 1 for n in names if n.endswith("*")}, reverse=True)

    def __missing__(self, word: str) -> int:
        got = self.number.get(word, 0)
        for k in () if got else self.lengths:
            if len(word) > k and (got := self.number.get(word[:k] + "*", 0)):
                break
        if not got and not word[0].isalpha():
            got = -1  # the end of a clause
        if len(self) >= self.MOST:
            self.clear()
        self[word] = got
        return got


def pieces(text: str) -> Iterator[str]:
    """The text in parts of about PIECE characters, cut at white space."""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end].lower()
        at = end


def clause_weights(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Summed weights of the matched clauses of each kind, and the number of words; a clause weighs as much as its strongest hostile word."""
    out = np.zeros(len(PRIOR) + 1)
    state, strongest = 0, 0.0
    for piece in pieces(text or ""):
        found = np.fromiter((lexicon[w] for w in TOKEN.findall(piece)), np.int64)
        symbols = np.where(found < 0, BREAK, lexicon.symbols[np.maximum(found, 0)])
        out[-1] += np.count_nonzero(found >= 0)
        if not strongest and not (symbols >= INSULT).any() and len(symbols) > REACH:
            # Nothing to match: only the last clause's state goes on, and whatever stands before its break has no say in it.
            ends = np.flatnonzero(symbols == BREAK)
            state, symbols, found = (0, symbols[ends[-1] + 1 :], found[ends[-1] + 1 :]) if len(ends) else (state, symbols, found)
        before = -1
        for i in np.flatnonzero(symbols).tolist():
            for _ in range(min(i - before - 1, REACH)):
                state = STEP[state][OTHER]
            symbol, before = int(symbols[i]), i
            if symbol >= INSULT:
                strongest = max(strongest, float(lexicon.weights[found[i]]))
            if symbol == BREAK:
                if KIND[state][BREAK] >= 0:
                    out[KIND[state][BREAK]] += strongest
                strongest = 0.0
            state = STEP[state][symbol]
        for _ in range(min(len(symbols) - before - 1, REACH)):
            state = STEP[state][OTHER]
    if KIND[state][BREAK] >= 0:
        out[KIND[state][BREAK]] += strongest
    return out


def evidence(matched: np.ndarray) -> np.ndarray:
    """Of rows of clause weights and word counts: the logarithm of all weight dealt to the kinds by their shares, and that of the length."""
    kinds = matched[:, :-1]
    total = kinds.sum(axis=1, keepdims=True)
    return np.column_stack([np.log1p(total) * kinds / np.maximum(total, 1e-300), -np.log1p(matched[:, -1])])


@dataclass
class Grammar:
    """The lexicon, the weights on the final arcs of the grammar (that of the length comes last), and the bias."""

    lexicon: dict[str, tuple[int, float]] = field(default_factory=dict)
    kinds: np.ndarray = field(default_factory=lambda: np.append(PRIOR, PRIOR_LENGTH))
    bias: float = PRIOR_BIAS

    def score(self, matched: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + evidence(matched) @ self.kinds)))


def start_lexicon() -> dict[str, tuple[int, float]]:
    return {w: (SYMBOL[name], START if name in ("insult", "threat") else 0.0) for name, listed in WORDS.items() for w in listed.split()}


def fit_kinds(matched: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the kinds and the length, and the bias, by Newton's method, held to the prior where the rows say little. Weights are not negative."""
    a = np.column_stack([evidence(matched), np.ones(len(y))])
    prior = np.r_[PRIOR, PRIOR_LENGTH, PRIOR_BIAS]
    w = prior.copy()
    loss = lambda v: float((weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (a @ v))).sum() + PRECISION / 2 * ((v - prior) ** 2).sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a @ w)))
        slope = a.T @ (weight * (p - y)) + PRECISION * (w - prior)
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + PRECISION * np.eye(len(w)), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return np.maximum(w[:-1], 0.0), float(w[-1])


def surprise(a: float, b: float, n1: float, n0: float) -> float:
    """Log-likelihood ratio of ``a`` of n1 against ``b`` of n0; 0 where the first is not the more frequent."""
    if a * n0 <= b * n1:
        return 0.0
    return 2 * sum(x * math.log(x * (n1 + n0) / ((a + b) * n)) for x, n in ((a, n1), (b, n0)) if x > 0)


def chosen(terms: list[tuple[str, int, int]], n1: int, n0: int, price: float) -> dict[str, float]:
    """The terms (name, occurrences in toxic and in other documents of n1 and n0 words) that the lexicon takes, with their weights.

    Terms form a tree of stems and their extensions. From the leaves up, a stem stands for all words below it if that explains the counts about
    as well as its parts do, each of which costs ``price``; else its parts stand, and the stem for the words that are left.
    """
    known = {t: (a, b) for t, a, b in terms}
    below: dict[str, list[str]] = {}
    for t in known:
        bare = t.rstrip("*")
        stems = [bare[:k] + "*" for k in reversed(STEMS) if k < len(bare)]
        parent = next((s for s in stems if s in known), None)
        if parent:
            below.setdefault(parent, []).append(t)
    taken: dict[str, tuple[float, dict[str, tuple[int, int]]]] = {}
    for t in sorted(known, key=lambda t: -len(t.rstrip("*")) * 2 + t.endswith("*")):
        a, b = known[t]
        whole = surprise(a, b, n1, n0) - price
        parts: dict[str, tuple[int, int]] = {}
        worth = 0.0
        for c in below.get(t, ()):
            worth += taken[c][0]
            parts |= taken[c][1]
        rest = a - sum(known[c][0] for c in below.get(t, ())), b - sum(known[c][1] for c in below.get(t, ()))
        left = surprise(*rest, n1, n0) - price
        if left > 0:
            worth, parts = worth + left, parts | {t: rest}
        taken[t] = (worth, parts) if parts and worth >= whole else (whole, {t: (a, b)}) if whole > 0 else (0.0, {})
    tops = set(known) - {c for cs in below.values() for c in cs}
    odds = lambda a, b: math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
    return {t: w for top in tops for t, (a, b) in taken[top][1].items() if (w := odds(a, b)) >= LEAST_ODDS}


COUNTS = ("toxic_docs", "other_docs", "toxic_words", "other_words")


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, COUNTS): in how many documents of a task's batch each word and stem stands, and how often; the empty term counts all."""
    docs: tuple[Counter, Counter] = (Counter(), Counter())
    hits: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        names = sorted(hits[0].keys() | hits[1].keys())
        arrays = [pa.array(names, pa.string()), *[pa.array([c[t] for t in names], pa.int64()) for c in (docs[1], docs[0], hits[1], hits[0])]]
        for c in (*docs, *hits):
            c.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["term", *COUNTS])

    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen: Counter = Counter()
            for piece in pieces(text or ""):
                seen.update(w for w in TOKEN.findall(piece) if w[0].isalpha())
            terms = Counter({"": seen.total()})
            for w, n in seen.items():
                for t in (w, *[w[:k] + "*" for k in STEMS if len(w) > k]) if len(w) > 2 else ():
                    terms[t] += n
            hits[y].update(terms)
            docs[y].update(terms.keys())
            if len(hits[0]) + len(hits[1]) > 500_000:
                yield out()
    yield out()


def unlike(rows: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """One row, the one of the smallest id, of all that share a smallest hash of three words in a row under any of SKETCHES seeds.

    Copies and near copies of a document would count every rare word of it as often as they stand. ``rows`` are a bounded sample.
    """
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(w, i, 3)))
    least = lambda g: F.array(*[F.array_min(F.transform(g, lambda x, k=k: F.xxhash64(x, F.lit(k)))) for k in range(SKETCHES)])
    out = rows.withColumn("_s", let(words(F.col(text_col)), lambda w: let(grams(w), least)))
    for k in range(SKETCHES):
        first = Window.partitionBy(F.col("_s")[k]).orderBy(id_col)
        out = out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return out.drop("_s")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Grammar:
    """Fit on at most ``sample`` labelled documents of each class outside the held-out fifth, those that come first by id hash.

    Rows with a null id or label are left out; a repeated id counts once, with the larger half of its labels. Term counts are Spark's; the driver gets
    at most LEXICON terms and one row of clause weights for each document of the sample.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("label_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    draw = [known.where(F.col("y") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(sample) for y in (0, 1)]
    total = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # At most twice ``sample`` rows, so they fit a broadcast and, as clause weights, the driver.
    drawn = draw[0].unionByName(draw[1])
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), F.col("_id") == F.col("label_id")).select("text", "y", "label_id")
    lexicon = start_lexicon()
    n1, n0 = (min(total.get(y, 0), sample) for y in (1, 0))
    with scratch():
        rows = materialize(rows, "sample")
        apart = materialize(unlike(rows, "label_id"), "apart")
        m = {r.y: r.n for r in apart.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        if m.get(0) and m.get(1):
            lexicon |= {t: (lexicon.get(t, (INSULT, 0.0))[0], min(w, MOST)) for t, w in learned_terms(apart, m[1], m[0], lexicon).items()}
        # Copies of an id count once, with what any of them matches.
        x = matched(rows.select("label_id", "text"), "label_id", lexicon).groupBy("label_id").agg(*[F.max(F.col("matched")[k]).alias(f"m{k}") for k in range(len(PRIOR) + 1)])
        got = x.join(drawn, "label_id").orderBy("label_id").drop("label_id").collect()
    model = Grammar(lexicon)
    if got:
        y = np.array([r.y for r in got], np.float64)
        weight = np.where(y > 0, total.get(1, 0) / max(n1, 1), total.get(0, 0) / max(n0, 1))
        model.kinds, model.bias = fit_kinds(np.array([tuple(r)[: len(PRIOR) + 1] for r in got]), y, weight)
    return model


def learned_terms(rows: DataFrame, n1: int, n0: int, start: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Words and stems that stand in far more of the n1 toxic documents than chance gives among so many terms, and fixed hostile words by their counts."""
    counts = rows.select("text", "y").mapInArrow(_term_counts, "term string, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("term").agg(*[F.sum(c).alias(c) for c in COUNTS])
    counts = materialize(counts.where((F.col("toxic_docs") + F.col("other_docs") >= LEAST_DOCS) | (F.col("term") == "")), "terms")
    every = counts.where("term = ''").first()
    a, b = F.col("toxic_docs").cast("double"), F.col("other_docs").cast("double")
    part = lambda seen, n: F.when(seen > 0, seen * F.log(seen * float(n1 + n0) / ((a + b) * float(n)))).otherwise(0.0)
    sure = 2 * math.log(max(counts.count(), 1)) + SURE
    told = counts.where("term <> ''").withColumn("g", 2 * (part(a, n1) + part(b, n0))).where((a / n1 > b / n0) & (F.col("g") >= sure))
    best = told.orderBy(F.col("g").desc(), "term").limit(LEXICON).select("term", "toxic_words", "other_words").collect()
    fixed = [t for t, (s, _) in start.items() if s in (INSULT, THREAT)]
    own = counts.where(F.col("term").isin(fixed)).select("term", "toxic_words", "other_words").collect()
    n1, n0 = every.toxic_words, every.other_words
    odds = {r.term: max(math.log((r.toxic_words + 0.5) / (n1 + 1)) - math.log((r.other_words + 0.5) / (n0 + 1)), 0.0) for r in own}
    return odds | chosen([tuple(r) for r in best], n1, n0, sure)


def matched(docs: DataFrame, id_col: str, entries: dict[str, tuple[int, float]], text_col: str = "text") -> DataFrame:
    """(id_col, matched): the clause weights of whole texts; a null text has none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries)
        for batch in batches:
            x = [clause_weights(t.as_py(), lexicon).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=[id_col, "matched"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(work, f"`{id_col}` long, matched array<double>")


def score(docs: DataFrame, model: Grammar, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted, clauses) of every row; ``clauses`` are the weights of the matched clauses by kind, and the number of words."""
    found = matched(docs, id_col, model.lexicon, text_col)
    total = F.lit(0.0)
    for k in range(len(PRIOR)):
        total = total + F.col("matched")[k]
    found = found.withColumn("_t", total)
    weighed = F.lit(0.0)
    for k, w in enumerate(model.kinds[:-1].tolist()):
        weighed = weighed + F.col("matched")[k] * w
    linear = F.when(F.col("_t") > 0, F.log1p("_t") * weighed / F.col("_t")).otherwise(0.0) - F.log1p(F.col("matched")[len(PRIOR)]) * float(model.kinds[-1]) + model.bias
    found = found.withColumn("score", 1 / (1 + F.exp(-linear)))
    return found.select(F.col(id_col).alias("doc_id"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.col("matched").alias("clauses"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, repeated rows one by one.

    An empty table gives an empty result; without labels the fixed lists and weights decide. A null id is not held out; a null or empty text has no
    clause and gets the bias alone; a long text is read as a whole. Equal texts have equal scores. Only the named columns are read.
    """
    out = score(docs, train(docs, labels, sample, id_col, text_col), id_col, text_col, threshold)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

