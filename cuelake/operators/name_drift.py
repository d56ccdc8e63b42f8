"""Spellings of an episode's output that its source lacks, beside the source's near spelling.

Everything is keyed by episode: another episode's words neither explain nor hide a drift. Tokens keep
their case; keys are case-folded. Whether a capital begins a sentence is carried over cues, since a
sentence may end in one cue and the next begin in another.

Two words that are ``least`` alike share so many letters that any few of one word's letters, one more
than it may lack, hold a shared one. A known word offers the few that are rarest in the episode's output,
so that few pairs meet; a mask of letters, 64 bits wide, then bounds from above what a pair can share.
Only pairs within the bound are compared letter by letter. Nothing that is ``least`` alike is lost.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, indel_series
from ..sources.kept import kept
from .apply_decisions import plain_text
from .sequence import dealt

#: A sentence's end before a word: its sign, then closing quotes and brackets.
ENDED = r"""[.!?]["'»“”„’)\]]*\s*$"""


def folded(token: Column) -> Column:
    """Case-folded: small letters, with ß, ſ and the final sigma as other spellings have them."""
    return F.translate(F.replace(F.lower(token), F.lit("ß"), F.lit("ss")), "ſς", "sσ")


def occurrences(cues: DataFrame) -> DataFrame:
    """(ep, pos, cue_id, i, token, key, initial) of every word of (ep, pos, cue_id, text).

    initial: the word begins a sentence: a sentence ended before it in the cue, or it is the cue's first
    word and a sentence had ended in the cues before it (or none had begun). Null texts hold no word.
    """
    text = plain_text(F.coalesce("text", F.lit("")))
    c = cues.select("ep", "pos", "cue_id", text.alias("text"))
    c = c.select("ep", "pos", "cue_id", F.regexp_extract_all("text", F.lit(TOKEN), 1).alias("words"), F.split("text", TOKEN, -1).alias("between"))
    after = F.element_at("between", -1).rlike(ENDED)
    # what a cue leaves behind; nothing, if it holds neither a word nor an end
    left = F.when(after, True).when(F.size("words") > 0, False)
    before = Window.partitionBy("ep").orderBy("pos", "cue_id").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("carried", F.coalesce(F.last(left, ignorenulls=True).over(before), F.lit(True)))
    each = c.select("ep", "pos", "cue_id", "between", "carried", F.posexplode("words").alias("i", "token"))
    initial = F.get("between", F.col("i")).rlike(ENDED) | ((F.col("i") == 0) & F.col("carried"))
    return each.select("ep", "pos", "cue_id", "i", "token", folded(F.col("token")).alias("key"), initial.alias("initial"))


def spellings(words: DataFrame) -> DataFrame:
    """(ep, key, n, token, first, name_like) of a source's words: the commonest spelling, of equal ones the first."""
    place = F.struct("pos", "cue_id", "i")
    name = F.substring("token", 1, 1).rlike(r"^\p{Lu}") & ~F.col("initial")
    forms = words.groupBy("ep", "key", "token").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(name).alias("name_like"))
    commonest = F.max_by("token", F.struct("n", -F.col("first.pos"), -F.col("first.cue_id"), -F.col("first.i")))
    return forms.groupBy("ep", "key").agg(F.sum("n").alias("n"), commonest.alias("token"), F.min("first").alias("first"), F.max("name_like").alias("name_like"))


def _lettered(words: DataFrame, key: str) -> DataFrame:
    """Adds len, letters (each with its number among equals) and mask (a bit a letter, by hash)."""

    def lettered(texts: pd.Series) -> pd.DataFrame:
        found = []
        for text in texts:
            seen: dict[str, int] = {}
            letters, mask = [], 0
            for c in text:
                n = seen[c] = seen.get(c, 0) + 1
                letters.append(f"{c}{n}")
                mask |= 1 << (ord(c) * 31 + n * 7) % 64
            found.append((len(text), letters, mask - (mask >> 63 << 64)))
        return pd.DataFrame(found, columns=["len", "letters", "mask"])

    told = F.pandas_udf(lettered, "len int, letters array<string>, mask long")(F.col(key))
    # written out with its letters in each row, so that what they come to is known before a join is chosen
    return words.withColumn("__told", told).select(*words.columns, "__told.*").repartition(F.xxhash64("ep", key))


def similar_pairs(new: DataFrame, known: DataFrame, least: float = 70.0, apart: int = 3, whole: bool = False) -> DataFrame:
    """(ep, key, known, ratio) of words (ep, key) and (ep, known) at most ``apart`` letters in length and ``least`` alike.

    Words stand once an episode on either side; their other columns stay with them. ``whole`` tells that
    there is one episode only: its few letters are then no keys to deal words out by.
    """
    with_key, with_known = ([F.col(c) for c in d.columns if c not in ("ep", k)] for d, k in ((new, "key"), (known, "known")))
    a, b = _lettered(new, "key"), _lettered(known, "known")
    a = a.select("ep", "key", "len", "mask", *with_key, F.explode("letters").alias("letter"))
    rarity = a.groupBy("ep", "letter").agg(F.count("*").alias("held"))
    each = b.select("ep", "known", "len", "mask", F.struct(F.lit(0).alias("col1"), *with_known).alias("other"), F.explode("letters").alias("letter")).join(dealt(rarity), ["ep", "letter"], "left")
    place = F.struct(F.coalesce("held", F.lit(0)).alias("held"), "letter")
    b = each.groupBy("ep", "known", F.col("len").alias("known_len"), F.col("mask").alias("known_mask")).agg(F.sort_array(F.collect_list(place)).alias("letters"), F.any_value("other").alias("other"))
    # what a word of each length must share, so that one of the known word's first letters is among it
    b = b.withColumn("len", F.explode(F.sequence(F.greatest(F.col("known_len") - apart, F.lit(1)), F.col("known_len") + apart)))
    b = b.withColumn("common", F.ceil(least * (F.col("len") + F.col("known_len")) / 200 - 1e-9).cast("int")).where("common <= len and common <= known_len")
    b = b.select("ep", "known", "len", "known_mask", "common", "other", F.explode(F.slice("letters", 1, F.col("known_len") - F.col("common") + 1)).alias("first"))
    b = b.withColumn("letter", F.col("first.letter")).drop("first")
    # so many rows a word: they are counted in an exchange, if the driver may gather them
    pairs = a.join(b.repartition("ep", "len", "letter") if whole else dealt(b), ["ep", "len", "letter"])
    shared = F.col("len") - F.bit_count(F.col("mask").bitwiseAND(F.bitwise_not("known_mask")))  # at most so many
    pairs = pairs.where(shared >= F.col("common")).select("ep", "key", "known", *with_key, "other.*").drop("col1").dropDuplicates(["ep", "key", "known"])
    return pairs.withColumn("ratio", indel_series(F.col("key"), F.col("known"))).where(F.col("ratio") >= least)


def name_drift_findings(source: DataFrame, output: DataFrame, least: float = 70.0, count: int = 2, share: float = 0.8) -> DataFrame:
    """(ep, kind, severity, cue_ids, message, old_text, new_text) for cues (ep, pos, cue_id, text) of both sides.

    A word of the output of four letters or more that the episode's source lacks, and a source word that
    stands ``count`` times, at most three letters longer or shorter and ``least`` alike. Of several the
    commonest counts (then the most alike, then the first), if it has ``share`` of all their places. The
    kind is name_spelling_inconsistency where the source writes it with a capital within a sentence, else
    unsourced_word_substitution. Episodes without source words give nothing, nor do null texts.
    """
    keys = lambda d: occurrences(d).select("ep", "key").where(F.length("key") >= 4).distinct()
    fresh = kept(keys(output).join(dealt(keys(source)), ["ep", "key"], "left_anti"), "new")
    # what episodes without a new word say, and how they spell it, would meet nothing
    some = lambda d: occurrences(d.join(dealt(fresh.select("ep").distinct()), "ep", "left_semi"))
    new = some(output).join(dealt(fresh), ["ep", "key"], "left_semi").groupBy("ep", "key").agg(F.min_by("token", F.struct("pos", "cue_id", "i")).alias("new_text"), F.array_sort(F.collect_set("cue_id")).alias("cue_ids"))
    often = spellings(some(source)).where(F.col("n") >= count).withColumnRenamed("key", "known")
    pairs = similar_pairs(fresh, often, least)
    each = Window.partitionBy("ep", "key")
    ranked = pairs.withColumn("r", F.row_number().over(each.orderBy(F.desc("n"), F.desc("ratio"), "first"))).withColumn("all_n", F.sum("n").over(each))
    best = ranked.where((F.col("r") == 1) & (F.col("n") / F.col("all_n") >= share)).join(dealt(new), ["ep", "key"])
    kind = F.when(F.col("name_like"), "name_spelling_inconsistency").otherwise("unsourced_word_substitution")
    label = F.when(F.col("name_like"), "a possible name drift").otherwise("an unsourced word substitution")
    message = F.format_string("Output spelling '%s' is absent from the source, while near spelling '%s' appears %d times; review as %s.", "new_text", "token", "n", label)
    return best.select("ep", kind.alias("kind"), F.lit("warning").alias("severity"), "cue_ids", message.alias("message"), F.col("token").alias("old_text"), "new_text")
