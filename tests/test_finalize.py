import random

from cuelake.functions.text import indel, signature_of
from cuelake.operators.finalize import Finish, cues_of, finalize, findings_of, overlap_policy
from cuelake.plans import flows

SCHEMA = "ep long, pos long, cue_id long, start_ms long, end_ms long, text string, speaker string, character string"


def frame(spark, cues, ep=1):
    return spark.createDataFrame([(ep, i, *c, *(None,) * (6 - len(c))) for i, c in enumerate(cues)], SCHEMA)


def run(spark, cues, **style):
    rows = finalize(frame(spark, cues), Finish(**style))
    out = [(c.cue_id, c.start_ms, c.end_ms, c.text) for c in cues_of(rows).orderBy("pos").collect()]
    return out, [(f.kind, f.severity, f.cue_ids) for f in findings_of(rows).orderBy("nth").collect()]


def test_order_and_inversions(spark):
    out, found = run(spark, [(1, 5000, 6000, "late"), (2, 1000, 2000, "early"), (3, 1000, 1500, "shorter first")])
    assert [c[0] for c in out] == [3, 2, 1] and found[0] == ("output_order_inversion", "error", [1, 2])
    assert found[1:] == [("output_overlap_resolved", "warning", [3, 2])] and out[1] == (2, 1500, 2000, "early")


def test_repeats_become_one_with_the_longer_wording(spark):
    out, found = run(spark, [(4, 0, 1000, "Hello there"), (2, 400, 1800, "hello, there!"), (3, 900, 1200, "Hello  there")])
    assert out == [(2, 0, 1800, "hello, there!")] and found == [("output_order_inversion", "error", [])][:0] + [("duplicate_cue_merged", "warning", [4, 2, 3])]
    # lengths are those of the plain text: blank ends of lines do not count
    out, _ = run(spark, [(1, 0, 1000, "Hello there!"), (2, 500, 1500, "Hello \n  \n there")])
    assert out[0][3] == "Hello there!"


def test_fast_cues_grow_into_gaps_or_join(spark):
    out, found = run(spark, [(1, 0, 500, "twenty characters ok"), (2, 3000, 3500, "slow")], most_cps=10.0)
    assert out[0] == (1, 0, 2000, "twenty characters ok") and found == [("cps_duration_extended", "warning", [1])]
    out, found = run(spark, [(1, 0, 500, "twenty characters ok"), (2, 500, 6000, "so")], most_cps=10.0)
    assert out == [(1, 0, 6000, "twenty characters ok\nso")] and found == [("cps_cue_merged", "warning", [1, 2])]
    assert run(spark, [(1, 0, 500, "twenty characters ok"), (2, 500, 6000, "so")], most_cps=10.0, longest_ms=4000)[1] == []
    assert run(spark, [(1, 0, 500, "twenty characters ok", "a"), (2, 500, 6000, "so", "b")], most_cps=10.0)[1] == [("speaker_transition_gap_inserted", "warning", [1, 2])]


def test_speakers_and_characters_keep_apart(spark):
    out, found = run(spark, [(1, 0, 1000, "one", "x", "A"), (2, 1000, 2000, "two", "x", "B")])
    assert out[1][1] == 1033 and found == [("speaker_transition_gap_inserted", "warning", [1, 2])]
    assert run(spark, [(1, 0, 1000, "one"), (2, 500, 2000, "two")], apart=False)[1] == []


def test_policies(spark):
    cues = [(1, 0, 1000, "Yes\nno", "a"), (2, 500, 1500, "Maybe", "b"), (3, 1400, 2000, "third", "b")]
    rows = overlap_policy(frame(spark, cues), Finish(overlap="dash"))
    assert [(c.cue_id, c.text, c.speaker) for c in cues_of(rows).orderBy("pos").collect()] == [(1, "- Yes no\n- Maybe", None), (3, "third", "b")]
    assert [(f.kind, f.cue_ids, f.start_ms, f.end_ms) for f in findings_of(rows).orderBy("nth").collect()] == [("overlap_dash_merge", [1, 2], 500, 1000), ("overlap_flag_only", [1, 3], 1400, 1500)]
    assert [f.kind for f in findings_of(overlap_policy(frame(spark, cues))).collect()] == ["overlap_stacked"] * 2


def test_nulls_and_empty(spark):
    out, found = run(spark, [(1, None, 500, "no start"), (2, 0, 900, None), (3, 100, None, None), (4, 800, 1900, None)])
    assert [c[0] for c in out] == [2, 4, 1, 3] and found == [("output_overlap_resolved", "warning", [2, 4])]
    assert finalize(frame(spark, []), Finish()).count() == 0


def test_what_goes_out_is_apart_and_whole(spark):
    """Random cues: none overlaps, each went out or into another, and repeats are those that pairs show."""
    rng = random.Random(2)
    texts = ["yes", "No!", "well then", "Well, then", "a longer line of words", ""]
    cues = [(i + 1, s := rng.randint(0, 30_000), s + rng.randint(0, 2500), rng.choice(texts), rng.choice([None, "a", "b"])) for i in range(150)]
    rows = finalize(frame(spark, cues), Finish(most_cps=20.0, longest_ms=3000))
    out, found = cues_of(rows).orderBy("pos").collect(), findings_of(rows).collect()
    assert all(a.end_ms <= b.start_ms for a, b in zip(out, out[1:]))
    gone = sum(len(f.cue_ids) - 1 for f in found if f.kind in ("duplicate_cue_merged", "cps_cue_merged"))
    assert len(out) + gone == len(cues) and gone > 5
    by_id = {c[0]: c for c in cues}
    for f in (f for f in found if f.kind == "duplicate_cue_merged"):
        words = [" ".join(signature_of(by_id[i][3])) for i in f.cue_ids]
        assert all(indel(a, b) >= 90 for a, b in zip(words, words[1:]))


def test_words_split_otherwise_than_cues(spark):
    """Hyphens, percents and scripts without blanks: the words are whole, the cues are not."""
    cues = frame(spark, [(1, 0, 2000, "A well-known\nsci-fi, 50%"), (2, 3000, 5000, "東京へ行く")])
    heard = [(1, i, w, t * 1_000_000, t * 1_000_000 + 300_000) for i, (w, t) in enumerate([("a", 0), ("Well-known", 0), ("sci-fi", 1), ("50", 1), ("%", 1), ("東", 3), ("京", 3), ("へ", 4), ("行", 4), ("く", 4)])]
    words = spark.createDataFrame(heard, "ep long, word_idx long, text string, start_us long, end_us long")
    got = {(r.cue_id, r.word_idx) for r in flows.matched_words(cues, words).collect()}
    assert got == {(1, i) for i in range(5)} | {(2, i) for i in range(5, 10)}


def test_generated_cues_last_long_enough(spark):
    words = spark.createDataFrame([(1, 0, "Hi.", 1_000_000, 1_100_000, None)], "ep long, word_idx long, text string, start_us long, end_us long, speaker long")
    assert [(r.start_ms, r.end_ms) for r in flows.generate(words).collect()] == [(1000, 1500)]


def test_a_whole_end_tells_every_kind(spark):
    cues = frame(spark, [(1, 0, 300, "Diana sees this very long line of talk", "a"), (2, 200, 900, "Diana sees this, too", "b")])
    source = frame(spark, [(1, 0, 1000, "Ich sehe Deanna."), (2, 1000, 2000, "Ich kenne Deanna.")])
    out, found = flows.finished(cues, source)
    assert {f.kind for f in found.collect()} == {"overlap_stacked", "output_overlap_resolved", "impossible_cps_fast", "unsourced_word_substitution", "name_spelling_inconsistency"} - {"unsourced_word_substitution"}
    assert out.count() == 2
