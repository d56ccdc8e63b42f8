"""Quality rules as weak supervision, in DataFrame functions only.

Rules vote good (1), bad (0) or abstain. The votes' patterns are counted; there are at most 3**rules
of them whatever the table's size, so expectation-maximisation runs over patterns on the driver. It
estimates each rule's accuracy on either class and gives every pattern its posterior probability of
good quality.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

WHITE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Quality:
    """rounds: EM rounds. keep: least posterior of a kept text. prior: pseudo-counts of accuracy."""

    rounds: int = 60
    keep: float = 0.5
    prior: float = 20.0


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and more counts.

    Three-word windows are compared by 64-bit hash. The hashes' upper 40 bits and the place share a
    long, so that one sort of plain longs brings equal windows together; texts where two different
    hashes share those bits, or with over 2**24 words, sort the whole hashes instead.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(
        "doc_id",
        text.alias("t"),
        F.filter(F.split(F.regexp_replace(text, WHITE, " "), " "), lambda w: w != "").alias("w"),
        F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    n = F.size("w")
    window = lambda w, i: F.xxhash64(w, F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2))
    d = d.withColumn("h", F.when(n >= 3, F.slice(F.transform("w", window), 1, F.greatest(n - 2, F.lit(1)))).otherwise(F.expr("cast(array() as array<bigint>)")))
    d = d.select(
        "doc_id",
        "t",
        n.alias("n"),
        F.aggregate("w", F.lit(0), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("dup_lines"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        "h",
        F.sort_array(F.transform("h", lambda x, i: x.bitwiseAND(F.lit(-(1 << 24))).bitwiseOR(i.cast("long")))).alias("s"),
    )
    upper = lambda x: F.shiftright(x, 24)
    place = lambda x: x.bitwiseAND(F.lit((1 << 24) - 1)).cast("int")
    before, after = (lambda i: F.get(F.col("s"), i - 1)), (lambda i: F.get(F.col("s"), i + 1))
    twice = F.filter("s", lambda x, i: F.coalesce(upper(x) == upper(before(i)), F.lit(False)) | F.coalesce(upper(x) == upper(after(i)), F.lit(False)))
    d = d.withColumn("twice", twice)
    apart = F.exists(
        F.sequence(F.lit(1), F.greatest(F.size("twice") - 1, F.lit(1))),
        lambda i: F.coalesce(
            (upper(F.get(F.col("twice"), i)) == upper(F.get(F.col("twice"), i - 1)))
            & (F.get(F.col("h"), place(F.get(F.col("twice"), i))) != F.get(F.col("h"), place(F.get(F.col("twice"), i - 1)))),
            F.lit(False),
        ),
    )
    pairs = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    exact = F.expr(
        "transform(filter(p, (x, i) -> coalesce(x.x = get(p, i - 1).x, false) or coalesce(x.x = get(p, i + 1).x, false)), x -> cast(x.i as bigint))"
    )
    d = d.withColumn("p", F.when(apart | (F.col("n") > (1 << 24)), pairs))
    places = F.sort_array(F.when(F.col("p").isNotNull(), exact).otherwise(F.transform("twice", lambda x: place(x).cast("long"))))
    d = d.withColumn("places", places)
    # a window covers three words, or as many as there are up to the next one
    covered = F.aggregate(
        F.col("places"),
        F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("sum")),
    )["sum"]
    symbols = F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))
    digits = F.length("t") - F.length(F.translate("t", "0123456789", ""))
    letters = F.length(F.regexp_replace("t", r"\P{L}+", ""))
    ends = F.length("t") - F.length(F.translate("t", ".!?", ""))
    big = lambda c, name: c.cast("long").alias(name)
    return d.select(
        "doc_id", big(F.col("n"), "n_words"), big(F.col("word_chars"), "word_chars"), big(symbols, "n_symbols"), big(F.col("dup_lines"), "n_dup_lines"),
        big(covered, "n_repeat_words"), big(F.col("n_lines"), "n_lines"), big(F.col("n_distinct"), "n_distinct"), big(digits, "n_digits"), big(ends, "n_ends"), big(letters, "n_letters"),
    )


def rules() -> dict[str, Column]:
    """Votes: 1 good, 0 bad, null abstains. Bounds are shares of words or characters."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, F.lit(0)).when(good, F.lit(1))

    symbol, repeat = F.col("n_symbols") / chars, F.col("n_repeat_words") / n
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    mean, digit = F.col("word_chars") / n, F.col("n_digits") / chars
    letters, per_word = F.col("n_letters") / chars, F.col("n_symbols") / n
    distinct, ends = F.col("n_distinct") / n, F.col("n_ends") / n
    enough = F.col("n_words") >= 50
    return {
        "length": vote(F.col("n_words") >= 50, F.col("n_words") < 20),
        "symbols": vote(symbol < 0.02, symbol > 0.1),
        "symbol_words": vote(per_word < 0.05, per_word > 0.4),
        "letters": vote(letters > 0.9, letters < 0.8),
        "repeats": vote(repeat < 0.1, repeat > 0.3),
        "lines": vote(lines == 0, lines > 0.3),
        "word_length": vote((mean >= 3) & (mean <= 10), (mean < 2.5) | (mean > 14)),
        "digits": vote(digit < 0.05, digit > 0.2),
        "distinct": vote(enough & (distinct > 0.3), enough & (distinct < 0.15)),
        "sentences": vote((ends > 0.01) & (ends < 0.3), enough & ((ends < 0.004) | (ends > 0.6))),
    }


def posteriors(counts: dict[int, int], n_rules: int, p: Quality) -> dict[int, float]:
    """Pattern (base 3: 0 abstains, 1 bad, 2 good) to the probability of good quality.

    Starts from the share of good among a pattern's votes, a bad vote counting three times, as it
    says more, and assumes rules to be independent within a class; pseudo-counts keep accuracies
    off 0 and 1.
    """
    votes = {c: [c // 3**k % 3 for k in range(n_rules)] for c in counts}
    q = {c: (vs.count(2) + 1) / (vs.count(2) + 3 * vs.count(1) + 2) for c, vs in votes.items()}
    for _ in range(p.rounds):
        good = sum(q[c] * n for c, n in counts.items())
        total = sum(counts.values())
        share = min(max((good + p.prior) / (total + 2 * p.prior), 0.01), 0.99)
        logs = []
        for k in range(n_rules):
            tally = {(y, v): 0.0 for y in (0, 1) for v in (1, 2)}
            for c, n in counts.items():
                if v := votes[c][k]:
                    tally[1, v] += q[c] * n
                    tally[0, v] += (1 - q[c]) * n
            row = {}
            for y in (0, 1):
                right = 2 if y else 1
                both = tally[y, 1] + tally[y, 2] + p.prior
                for v in (1, 2):
                    row[y, v] = math.log((tally[y, v] + p.prior * (0.8 if v == right else 0.2)) / both)
            logs.append(row)
        for c, vs in votes.items():
            s = math.log(share / (1 - share)) + sum(logs[k][1, v] - logs[k][0, v] for k, v in enumerate(vs) if v)
            q[c] = 1 / (1 + math.exp(-max(-60.0, min(60.0, s))))
    return q


def quality(docs: DataFrame, p: Quality = Quality()) -> DataFrame:
    """doc_id, the counts, votes of each rule, posterior, base_failed, kept of every row.

    A null text counts as empty: no words, base_failed. Repeated rows are judged alike. An empty
    table gives no rows. Other columns are not read.
    """
    named = rules()
    votes = base_columns(docs).withColumns({f"vote_{k}": v.cast("int") for k, v in named.items()})
    code = sum((F.coalesce(F.col(f"vote_{k}") + 1, F.lit(0)) * 3**i for i, k in enumerate(named)), F.lit(0))
    facts = saved(votes.withColumn("pattern", code.cast("int")), "quality")
    counts = {r["pattern"]: r["n"] for r in facts.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    found = json.dumps([{"pattern": c, "posterior": x} for c, x in posteriors(counts, len(named), p).items()])
    table = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(found), "array<struct<pattern:int,posterior:double>>")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = facts.join(F.broadcast(table), "pattern", "left").withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= p.keep)).drop("pattern")
