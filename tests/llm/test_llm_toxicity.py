"""The clause grammar against a plain reading of clauses, its fit against a step taken by hand, and held-out documents."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapmill.llm import toxicity as tox

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"


def plain(text, entries):
    """Clause by clause and word by word, without any transducer."""
    out = [0.0] * (len(tox.PRIOR) + 1)
    for clause in re.split(r"[.!?;:\n]+", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+(?:'t\b)?", clause)
        found = []
        for w in words:
            stems = [w[:k] + "*" for k in range(len(w) - 1, 0, -1)]
            found.append(next((entries[t] for t in [w, *stems] if t in entries), (tox.OTHER, 0.0)))
        best, weight = -1, 0.0
        for i, (symbol, w) in enumerate(found):
            if symbol in (tox.INSULT, tox.THREAT):
                threat = symbol == tox.THREAT
                if any(s == tox.REPORT for s, _ in found[:i]):
                    kind = tox.TOLD_THREAT if threat else tox.TOLD_INSULT
                elif any(s == tox.NEGATION for s, _ in found[max(i - tox.REACH, 0) : i]):
                    kind = tox.NEGATED_THREAT if threat else tox.NEGATED_INSULT
                else:
                    kind = symbol
                best, weight = max(best, tox.STRENGTH.index(kind)), max(weight, w)
        if best >= 0:
            out[best + len(tox.STRENGTH) * any(s == tox.TARGET for s, _ in found)] += weight
        out[-1] += len(words)
    return out


def texts(n, seed=1):
    rng = random.Random(seed)
    vocab = "you not said idiot kill scummy scum stupid the a of nicht du pas no 'x it's don't x1 stupidity é".split() + ["."] * 3 + ["!", ";", ",", "\n"]
    return [" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def entries():
    return tox.start_lexicon() | {"scum*": (tox.INSULT, 1.5), "stup*": (tox.INSULT, 0.5)}


def test_grammar_is_a_reading_of_clauses():
    lexicon = tox.Lexicon(entries())
    for t in [*texts(400), "", None, "...", "you idiot", "he said you are an idiot. not stupid", "not a b idiot", "not a b c idiot"]:
        assert tox.clause_weights(t, lexicon) == pytest.approx(plain(t, entries())), t


def test_long_texts_are_read_whole(monkeypatch):
    text = " ".join(texts(60, 2)) + " " + "clean words here " * 50 + " you idiot"
    whole = tox.clause_weights(text, tox.Lexicon(entries()))
    monkeypatch.setattr(tox, "PIECE", 37)
    assert tox.clause_weights(text, tox.Lexicon(entries())) == pytest.approx(whole)
    monkeypatch.setattr(tox.Lexicon, "MOST", 3)
    assert tox.clause_weights(text, tox.Lexicon(entries())) == pytest.approx(plain(text, entries()))


def test_clauses_count_by_their_pattern():
    """A targeted insult says more than a bare one, that more than one denied or told of; length alone takes weight from single words."""
    score = lambda t: float(tox.Grammar(tox.start_lexicon()).score(tox.clause_weights(t, tox.Lexicon(tox.start_lexicon()))[None])[0])
    assert score("you are an idiot") > score("an idiot") > score("not an idiot") > score("the tree")
    assert score("an idiot") > score("they reported an idiot") and score("i will kill you") > 0.5 > score("i will not kill you")


def test_fit_is_the_minimum():
    rng = np.random.default_rng(1)
    x = np.zeros((200, len(tox.PRIOR) + 1))
    x[:, 4], x[:, 10], x[:, -1] = rng.exponential(2, 200), rng.exponential(1, 200), rng.integers(1, 400, 200)
    y = (x[:, 4] + 2 * x[:, 10] + rng.normal(0, 1, 200) > 3).astype(float)
    kinds, bias = tox.fit_kinds(x, y, np.ones(200))
    a = tox.evidence(x)
    prior = np.r_[tox.PRIOR, tox.PRIOR_LENGTH, tox.PRIOR_BIAS]

    def loss(v):
        z = a @ v[:-1] + v[-1]
        return sum(np.log1p(np.exp(-zi if yi else zi)) for zi, yi in zip(z, y, strict=True)) + tox.PRECISION / 2 * sum((v - prior) ** 2)

    v = np.append(kinds, bias)
    free = [i for i in range(len(v)) if v[i] > 0 or i == len(v) - 1]
    for i in free:
        for d in (-0.01, 0.01):
            assert loss(v + d * np.eye(len(v))[i]) >= loss(v) - 1e-6


def test_chosen_stems_and_words():
    """A stem whose words are all alike stands for them; a word that is much purer than its stem stands alone; chance is left out."""
    alike = [(f"lowei{s}", 30, 0) for s in ("ab", "cd", "ef", "gh")]
    stems = [("low*", 120, 0), ("lowe*", 120, 0), ("lowei*", 120, 0)]
    word = [("loser", 100, 0), ("lose*", 110, 900), ("los*", 110, 900)]
    got = tox.chosen([*alike, *stems, *word, ("chance", 3, 2)], 10_000, 90_000, 25.0)
    assert set(got) == {"lowei*", "loser"}


def test_held_out_documents(spark, sf):
    """All toxic documents with a hostile word of the vocabulary are found, and clean ones left alone."""
    at = sf.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    out = tox.classify(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == docs.count()
    got = {(r.toxic, r.predicted): r["count"] for r in out.where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    # Seven of the held-out documents marked toxic are junk (one word over and over) without any hostile word.
    assert got[1, 1] >= 0.9 * (got[1, 1] + got.get((1, 0), 0)) and got.get((0, 1), 0) <= 0.005 * got[0, 0]


def test_copies_do_not_teach_words(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    base = [word() for _ in range(80)]
    rows = []
    for i in range(400):
        if i % 2:
            w = [word() for _ in range(60)] + (["zorkify"] * 3 if i % 4 == 1 else [])
        else:
            w = list(base)
            w[rng.randrange(80)] = word()
        rows.append((i, " ".join(w), "en", "s", 1))
    labels = [(i, 1, int(i % 2 == 0 or i % 4 == 1)) for i in range(400)]
    model = tox.train(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, LABEL))
    new = set(model.lexicon) - set(tox.start_lexicon())
    assert len(new) == 1 and next(iter(new)).startswith("zor")


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, None, None, None, None), (2, "", "a", "b", 0), (None, "you idiot", None, None, 1), (4, "you idiot", None, None, 1), (4, "you idiot", None, None, 1), (5, "x " * 300_000, None, None, 1)]
    odd_labels = [(None, 1, 1), (4, None, None), (1, 1, 1), (1, 1, 0), (9, 1, 0)]
    wide = spark.createDataFrame([(*r, 1, "x") for r in rows], DOC + ", score long, matched string")
    for labels in ([], odd_labels):
        got = tox.classify(wide, spark.createDataFrame(labels, LABEL)).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert len({r.score for r in got if r.doc_id in (None, 4)}) == 1 and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert tox.classify(wide.limit(0), spark.createDataFrame(odd_labels, LABEL)).collect() == []


def test_scores_equal_the_model(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts(60, 5))]
    model = tox.Grammar(entries(), bias=-2.0)
    got = {r.doc_id: r.score for r in tox.score(spark.createDataFrame(rows, DOC), model).collect()}
    want = model.score(np.array([plain(t, entries()) for _, t, *_ in rows]))
    assert [got[i] for i in range(60)] == pytest.approx(want.tolist())
    assert {r.held_out for r in tox.classify(spark.createDataFrame(rows, DOC), spark.createDataFrame([], LABEL)).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()} == {True}
