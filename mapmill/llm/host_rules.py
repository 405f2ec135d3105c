"""Quality rules with host-level verdicts (native).

Base rules count per document; rule failures are summed per host (the ``source`` of
``documents``); each host's failure rate is shrunk towards the corpus rate by a beta prior
fitted to all hosts by moments; documents of hosts whose shrunk rate is above a limit go too.
Only counters leave the scan: the text is read once, and the host sums are combined map-side,
so a host that holds a third of all rows costs one partial row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapmill.llm.words import SPACE, SPACE_CHARS, let
from mapmill.storage import bounded, materialize

SYMBOLS = "#*$%&|<>"
#: Hosts broadcast to the documents; a larger host table is joined by shuffle.
BROADCAST_HOSTS = 200_000


def repeated_words(w: Column) -> Column:
    """Words of the array ``w`` that lie in three-word windows found twice or more."""
    starts = F.sequence(F.lit(0), F.size(w) - 3)
    gram = lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])

    def covered(h: Column) -> Column:
        """From window hashes: sort (hash, place), keep places with an equal neighbour, and add up the gaps."""
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(
            s, lambda x, j: (F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        )
        places = let(placed, lambda s: F.array_sort(F.transform(twice(s), lambda x: x["i"])))
        total = lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
        )
        return let(places, total)

    some = let(F.transform(starts, gram), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(some)


def base_counts(text: Column) -> Column:
    """Struct of the base counters of one text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t)
    has_word = lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0
    lines = F.filter(F.split(t, "\n"), has_word)
    per_word = let(
        F.filter(F.split(t, SPACE), lambda x: x != ""),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")),
    )
    return F.struct(
        per_word.alias("w"),
        F.length(F.translate(t, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (chars - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )


def host_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_host_rate: float = 0.5,
    max_strength: float = 10_000.0,
) -> DataFrame:
    """Base counters, host rate and verdict per row of ``docs``.

    A null text counts as empty and fails. Rows with a null host form one host of their own.
    Repeated rows are judged one by one and all count for their host. An empty table gives an
    empty result. A text is counted whole however long. Other columns of ``docs``, whatever their names, are not read.
    With one host, or hosts that all have the same rate, the prior takes its greatest strength.
    """
    src = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), base_counts(F.col(text_col)).alias("c")
    ).select("doc_id", "host", "c.w.n_words", "c.word_chars", "c.n_symbols", "c.n_dup_lines", "c.w.n_repeat_words")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    base = materialize(src.withColumn("base_failed", failed), "host_rules")
    # Written before the join, so that beyond the bound of a broadcast Spark can split the rows of a large host.
    hosts = materialize(base.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f")), "hosts")
    # One row whatever the number of hosts: the moments of the host rates, weighted by documents.
    m = hosts.agg(F.count(F.lit(1)), F.sum("n"), F.sum("f"), F.sum(F.col("f") * F.col("f") / F.col("n"))).first()
    n_hosts, n, f, q = m[0], m[1] or 0, m[2] or 0, m[3] or 0.0
    a, b = beta_prior(n, f, q, max_strength)
    rate = ((F.col("f") + F.lit(a)) / (F.col("n") + F.lit(a + b))).alias("host_rate")
    verdicts = bounded(hosts.select(F.col("host").alias("h"), rate), n_hosts, BROADCAST_HOSTS)
    out = base.join(verdicts, F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    return out.withColumn("host_failed", F.col("host_rate") > max_host_rate).withColumn(
        "kept", ~F.col("base_failed") & ~F.col("host_failed")
    )


def beta_prior(n: int, f: int, q: float, max_strength: float) -> tuple[float, float]:
    """Beta parameters by moments: ``n`` documents, ``f`` failures, ``q`` = sum over hosts of f_h^2 / n_h."""
    p = f / n if n else 0.0
    var = q / n - p * p if n else 0.0
    strength = p * (1 - p) / var - 1 if var > 1e-12 else max_strength
    strength = min(max(strength, 1.0), max_strength)
    return p * strength, (1 - p) * strength
