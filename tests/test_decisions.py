"""Decisions, signs, masks and boundaries on small cues whose results are known."""

import json

import pytest
from pyspark.sql import functions as F

from cuelake.functions import profanity
from cuelake.functions import text as tx
from cuelake.operators import apply_decisions as ad
from cuelake.operators import decisions, evaluation, punctuation, quality_control, recurrences, refinement, sequence
from cuelake.sources import artefacts, live

CUES = "ep long, pos long, cue_id long, start_ms long, end_ms long, text string, speaker string"
CASES = (
    "ep long, nth long, case_id string, verdict string, final_text string, confidence double, cue_ids array<long>, srt_text string, asr_text string, token_idx array<long>, word_idx array<long>, "
    "start double, end double, speaker_ids array<string>, left_cue long, right_cue long, insert_at long, left_end double, right_start double, left_speaker string, right_speaker string"
)
NAMES = [x.split()[0] for x in CASES.split(", ")]


def cue_table(spark, *texts, step=1000):
    return spark.createDataFrame([(1, i, i + 1, i * step, i * step + step, t, None) for i, t in enumerate(texts)], CUES)


def case(nth, final, cue_ids=(), srt="", asr="", token_idx=(), word_idx=(), verdict="use_audio", **more):
    given = {"ep": 1, "nth": nth, "case_id": f"case-{nth}", "verdict": verdict, "final_text": final, "confidence": 0.9, "cue_ids": list(cue_ids), "srt_text": srt, "asr_text": asr, "token_idx": list(token_idx), "word_idx": list(word_idx), "speaker_ids": [], **more}
    return tuple(given.get(n) for n in NAMES)


def applied(spark, cues, *cases, unmatched=None, **how):
    table = spark.createDataFrame(list(cases), CASES)
    placed = ad.placements(cues, table, cues.where("false") if unmatched is None else unmatched, 60_000_000)
    out, flags = ad.apply_decisions(cues, table, placed, **how)
    return [(x.cue_id, x.text) for x in out.orderBy("place").collect()], [(x.kind, x.cue_ids, x.new_text) for x in flags.orderBy("nth").collect()]


def test_spans_become_other_text(spark):
    cues = cue_table(spark, "I have an\nA-rank-class", "Dragon-\nsystem owner.", "old first", "old second", "Yes, here you are not needed.")
    got, flags = applied(
        spark, cues,
        case(1, "A-rankclass", [1], "A rank class"), case(2, "Dragonsystem", [2], "Dragon system"), case(3, "new spoken first second", [3, 4], "old first old second"),
        case(4, "you", [5], "here", "you", [12], [1]), case(5, "here", [5], "you", "here", [13], [2]), case(6, "kept", [5], verdict="keep_srt"),
        width=20,
    )
    first = tx.signature_of("I have an A-rank-class Dragon- system owner. old first old second")
    assert tx.signature_of("Yes, here you")[1] == "here" and len(first) == 11  # the fifth cue's tokens begin at 11
    assert dict(got)[1] == "I have an\nA-rankclass" and dict(got)[2] == "Dragonsystem owner." and (dict(got)[3], dict(got)[4]) == ("new spoken", "first second")
    assert flags[2] == ("text_changed", [3, 4], "new spoken\nfirst second")


def test_edits_of_one_cue_go_together(spark):
    cues = cue_table(spark, "Yes, here you are not needed.")
    got, flags = applied(spark, cues, case(1, "you", [1], "here", "you", [1], [1]), case(2, "here", [1], "you", "here", [2], [2]), width=80)
    assert got == [(1, "Yes, you here are not needed.")] and [f[2] for f in flags] == ["Yes, you here are not needed."] * 2


def test_emptied_spans(spark):
    cues = cue_table(spark, "one two three", "all gone", "stays")
    some = [case(1, " ", [1], "two", "", [1], []), case(2, "", [2], "all gone", "", [3, 4], [])]
    assert applied(spark, cues, *some)[0] == [(1, "one three"), (2, "all gone"), (3, "stays")]
    got, flags = applied(spark, cues, *some, drop_policy="remove")
    assert got == [(1, "one three"), (3, "stays")] and [f[0] for f in flags] == ["text_changed", "dropped_adjudicated_cue"]


def test_generated_text_is_placed(spark):
    cues = cue_table(spark, "first words.", "second part", "unmatched here", step=10_000)
    inside = case(1, "oh", left_cue=2, right_cue=2, insert_at=1, start=12.0, end=12.2)
    after = case(2, "right", left_cue=2, left_end=20.0, start=20.1, end=20.3)
    new = case(3, "somebody else speaks", start=12.0, end=13.0)
    known = case(4, "unmatched hear", start=21.0, end=22.0)
    far = case(5, "too far away", start=500.0, end=501.0)
    again = case(6, " ".join(["la la la di"] * 5), start=1.0, end=2.0)
    got, flags = applied(spark, cues, inside, after, new, known, far, again, unmatched=cues.where("cue_id = 3"), width=80)
    assert got == [(1, "first words."), (2, "second oh part right"), (4, "somebody else speaks"), (3, "unmatched hear")]
    table = spark.createDataFrame([far, again], CASES)
    assert {x.nth: x.reason for x in ad.rejections(cues, table).collect()} == {5: "adlib_rejected_outside_source_span", 6: "adlib_rejected_repetitive_content"}


def test_token_edits():
    assert ad.edit_tokens("Hello there, friend.", [(1, 2, "you")]) == "Hello you, friend."
    assert ad.edit_tokens("I don't know!", [(2, 3, "")]) == "I don know!" and ad.edit_tokens("", [(0, 0, " a ")]) == "a"
    assert ad.edit_tokens("What a day.", [(3, 3, "it is")]) == "What a day it is." and ad.edit_tokens("a b c", [(0, 2, "x"), (1, 2, "y")]) == "x c"
    assert ad.localised(["a", "b", "c"], (1, 2), "a x c", "x", [1]) == "x" and ad.localised(["a", "b", "c"], (1, 2), "a c", "", [1]) == ""
    assert tx.split_for_cues("one two three", 2) == ["one", "two three"] and tx.split_for_cues("x", 3) == ["x", "", ""] and tx.split_for_cues("日本語話", 2) == ["日本", "語話"]
    assert tx.token_spans("a, bc") == [(0, 1), (3, 5)] and tx.find_bounds(["so", "on", "soon"], ["soon"]) == (2, 3)


def test_partial_spans_and_characters(spark):
    d = spark.createDataFrame([(0, 3, 3, 1), (1, 2, 3, 1), (None, None, 3, 2), (None, None, 3, 0)], "a long, b long, n long, m long")
    bounds = F.when(F.col("a").isNotNull(), F.struct(F.col("a").alias("first"), F.col("b").alias("last")))
    assert [x[0] for x in d.select(ad.partial(bounds, F.col("n"), F.col("m"))).collect()] == [False, True, True, False]
    cues = spark.createDataFrame([(1, "A", None), (1, "B", "Bo"), (1, None, "x")], "ep long, speaker string, character string")
    named = ad.with_characters(cues, spark.createDataFrame([(1, "A", "Ann")], "ep long, speaker string, character string"))
    assert {(x.speaker, x.character) for x in named.collect()} == {("A", "Ann"), ("B", "Bo"), (None, "x")}


def test_decisions_are_validated_and_asked_again(spark):
    spans = spark.createDataFrame([(1, f"case-{i}", "said", [1], 0.4) for i in range(4)], "ep long, case_id string, srt_text string, cue_ids array<long>, confidence double")
    answer = lambda *rows: spark.createDataFrame(list(rows), "ep long, case_id string, verdict string, final_text string, confidence double")
    first = answer((1, "case-0", "hybrid", "a", 0.9), (1, "case-1", "no such", "a", 0.9), (1, "case-2", "use_audio", "a", 1.9), (1, "other", "hybrid", "a", 0.9))
    got, lost = ad.validate(spans, first, lambda left: answer((1, "case-1", "use_audio", "b", 0.8), (1, "case-0", "use_audio", "late", 0.8)))
    assert {(x.case_id, x.verdict, x.final_text, x.confidence) for x in got.collect()} == {("case-0", "hybrid", "a", 0.9), ("case-1", "use_audio", "b", 0.8), ("case-2", "keep_srt", "said", 0.0), ("case-3", "keep_srt", "said", 0.0)}
    assert {x.case_id for x in lost.collect()} == {"case-2", "case-3"}
    kept, flags = ad.keep_source(spans)
    assert {x.confidence for x in kept.collect()} == {0.4} and flags.count() == 4


def test_words_of_decisions(spark):
    cases = spark.createDataFrame([case(1, "x", [5, 6], word_idx=[1, 2, 3]), case(2, "y", [], word_idx=[7]), case(3, "z", [9], word_idx=[8], verdict="ask")], CASES)
    placed = spark.createDataFrame([(1, 2, "new", 30)], "ep long, nth long, how string, cue_id long")
    old = spark.createDataFrame([(1, 5, 1)], "ep long, cue_id long, word_idx long")
    assert {tuple(x)[1:] for x in ad.attach_words(old, cases, placed).collect()} == {(5, 1), (5, 2), (6, 3), (30, 7)}


def test_profanity():
    from cuelake.functions.profanity import profane_name

    assert [profane_name(w) for w in ("verd*mmter", "M*st", "Sch*iße", "Vollidiot", "Mistel", "Optimist", "freundlich", "Scheißwetter")] == ["verdammt", "mist", "scheisse", "idiot", None, None, None, "scheisse"]
    assert [profanity.censor_text(t) for t in ("Mist, das ist verdammt schwer.", "SCHEISSE!\nScheißwetter.", "Idioten und Vollidiot", "M*st")] == ["M*st, das ist verd*mmt schwer.", "SCH*ISSE!\nSch*ißwetter.", "Id*oten und Vollid*ot", "M*st"]
    assert tx.normalize("Verd*mmte") == "verdammte" == tx.normalize("verdammte") and tx.normalize("fünfundzwanzig") == "25" and tx.normalize("dritter") == "3"


def test_source_masks_are_used_once(spark):
    make = lambda *t: spark.createDataFrame([(1, i, i + 1, x) for i, x in enumerate(t)], "ep long, pos long, cue_id long, text string")
    got = punctuation.censor_cues(make("Mist", "Mist", "Mist", None), make("Mi*t und M**t", "nichts", "-")).orderBy("pos").collect()
    assert [x.text for x in got] == ["Mi*t", "M**t", "M*st", None] or [x.text for x in got] == ["Mi*t", "M*st", "M*st", None]
    assert got[0].changes == "Mist>Mi*t"


def test_punctuation(spark):
    c = spark.createDataFrame([(1, 1, "one two\nthree"), (1, 2, "say it"), (1, 3, "isn't it")], "ep long, cue_id long, text string")
    p = spark.createDataFrame([(1, 1, "One, two three."), (1, 2, "“say it”"), (1, 3, "isn’t it?")], "ep long, cue_id long, proposed string")
    got = {x.cue_id: (x.text, x.problem) for x in punctuation.punctuate(c, p).collect()}
    assert got == {1: ("One, two\nthree.", None), 2: ("say it", "quotation marks changed"), 3: ("isn’t it?", None)} or got[3][1] == "words changed"
    assert punctuation.refusal("a b", "a c") == "words changed" and tx.quote_signs("don't 'x' „y“") == ["'", "'", "„", "“"]
    assert punctuation.relined("aaa bbb ccc", "aaa\nbbb ccc", True, 20, 2) == "aaa\nbbb ccc" and punctuation.relined("aaa bbb", "x", False, 4, 2) == "aaa\nbbb"


def test_evaluation_by_content(spark):
    gold = cue_table(spark, "first line", "inserted", "second line", "third line")
    mine = spark.createDataFrame([(1, i, i + 1, s, s + 900, t, None) for i, (t, s) in enumerate([("first line", 10), ("second line", 2020), ("third lime", 3050)])], CUES)
    pairs = evaluation.matched_cues(mine, gold)
    assert {(x.cue_id, x.golden_id, x.exact) for x in pairs.collect()} == {(1, 1, True), (2, 3, True), (3, 4, False)}
    flags = spark.createDataFrame([(1, "text_changed", [2]), (1, "text_changed", [3]), (1, "other", [1])], "ep long, kind string, cue_ids array<long>")
    m = evaluation.timing_metrics(mine, gold, pairs, flags).first()
    assert (m.cue_count_predicted, m.cue_count_golden, m.matched_cues, m.start_mae_ms, m.review_burden, m.meets_structure) == (3, 4, 3, pytest.approx(26.667), 1.0, False)
    x = evaluation.improv_metrics(mine, flags, pairs, gold).first()
    assert (x.tp, x.fp, x.fn) == (1, 1, 0)
    source = cue_table(spark, "first line", "old second", "third line")
    y = evaluation.improv_metrics(mine, flags, pairs, gold, evaluation.matched_cues(source, gold)).first()
    assert (y.tp, y.fp, y.fn, y.precision) == (1, 1, 1, 0.5)


def test_recurrences_take_nulls(spark):
    d = spark.createDataFrame([(1, 0, 1, 0, 1000, "a", "x"), (1, 1, 2, None, None, None, None), (1, 2, 3, 900, 950, None, "x"), (2, 0, 1, None, 5, "b", None)], CUES)
    for f in (recurrences.residual_overlaps, recurrences.enforce_monotonic, recurrences.duplicate_merge, recurrences.cps_merge, recurrences.dash_merge):
        assert f(d).count() == 4
    assert {(x.ep, x.cue_id, x.new_start, x.new_end) for x in recurrences.enforce_monotonic(d).collect()} == {(1, 1, 0, 1000), (1, 2, None, None), (1, 3, 1000, 1500), (2, 1, None, 5)}
    w = spark.createDataFrame([(1, 0, None, 0, 1, 1), (1, 1, "hi", None, 2, 1), (1, 2, "yes", 3, 9, None)], "ep long, word_idx long, text string, start_us long, end_us long, speaker long")
    assert [x.text for x in recurrences.words_to_cues(w, 10, 10).collect()] == ["yes"]
    one = spark.createDataFrame([(1, 0, 1, 0, 100, "x" * 30, None), (1, 1, 2, 100, 4000, "y", None)], CUES)
    assert recurrences.cps_merge(one, 15.0).count() == 1 and recurrences.cps_merge(one, 15.0, most_lines=1).count() == 2


def test_small_rules(spark):
    c = cue_table(spark, "a b c", "c d", "a b", "x y", "a b c d")
    got = {tuple(x.cue_ids): x.kind for x in sequence.duplicate_fragments(c.withColumn("t", tx.tokens(F.col("text"))), F.col("t")).collect()}
    assert got == {}
    e = cue_table(spark, "a b c d", "c d e", "c d", "c d")
    assert {tuple(x.cue_ids): x.kind for x in sequence.duplicate_fragments(e.withColumn("t", tx.tokens(F.col("text"))), F.col("t")).collect()} == {(1, 2): "ending", (1, 2, 3): "prefix", (2, 3, 4): "prefix"}
    short = spark.createDataFrame([(1, 0, 1, 100, 110, "a", None), (1, 1, 2, 105, 400, "b", None), (1, 2, 3, 300, 900, "c", None)], CUES)
    assert [x.new_end for x in sequence.cap_overlaps(short, 30.0).orderBy("pos").collect()] == [100, 300, 900]
    assert [x.new_end for x in sequence.extend_into_gap(short, 500, 30.0).orderBy("pos").collect()] == [600, 633, 900]
    stale = spark.createDataFrame([("timing_refined",), ("min_duration",), (None,)], "kind string")
    assert {x.kind for x in decisions.without_stale(stale).collect()} == {"min_duration", None}
    assert refinement.union_flags(stale, stale.withColumn("n", F.lit(1))).where("step = 1 and n = 1").count() == 3
    assert quality_control.audio_cost(spark.createDataFrame([(1, 2700.0), (1, 900.0)], "ep long, seconds double"), 0.22).first().usd == pytest.approx(0.22)


def test_artefacts(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"S1": "Ann", "S9": "Bo"}')
    cues = spark.createDataFrame([("e", "S1")], "ep string, speaker string")
    assert [tuple(x) for x in artefacts.speaker_map(spark, str(tmp_path / "e.json"), cues).collect()] == [("e", "S1", "Ann")]
    (tmp_path / "p.json").write_text('{"1": "One.", "x": "?"}')
    assert {(x.cue_id, x.proposed) for x in artefacts.punctuation(spark, str(tmp_path / "p.json")).collect()} == {(1, "One."), (None, "?")}
    (tmp_path / "d.json").write_text('{"decisions": [{"case_id": "case-1", "verdict": "hybrid", "final_text": "x", "confidence": 0.5}]}')
    assert artefacts.decisions(spark, str(tmp_path / "d.json")).first().verdict == "hybrid"
    artefacts.write_stage(cues, str(tmp_path), "align")
    assert artefacts.read_stage(spark, str(tmp_path), "align").count() == 1
    with pytest.raises(FileNotFoundError, match="rebuild"):
        artefacts.read_stage(spark, str(tmp_path), "rebuild")
    assert artefacts.read_config("f.yaml", artefacts.config_text({"fps": 25.0, "gone": None})) == {"fps": 25.0} and artefacts.read_config("f.yaml", "") == {}
    for bad in ("- a", "a: ["):
        with pytest.raises(ValueError, match="f.yaml"):
            artefacts.read_config("f.yaml", bad)
    params = spark.range(1).select(F.create_map(F.lit("Token"), F.lit("s"), F.lit("model"), F.lit("m")).alias("p"))
    assert params.select(artefacts.without_secrets(F.col("p"), ("token",))).first()[0] == {"model": "m"}
    files = spark.createDataFrame([("a", b"x\r\ny\rz\n"), ("b", b"x\n" * 9), ("c", b"\xff" * 30)], "ep string, content binary")
    assert [x.problem for x in artefacts.scan_bytes(files, 3, 20).orderBy("ep").collect()] == [None, "more than 3 lines", "line 1 is longer than 20 bytes"]
    names = [("b1", "a.wav"), ("b1", "A.srt"), ("b2", "a.wav"), ("b2", "b.srt"), ("b3", "con.mp3"), ("b4", "x.mp3"), ("b5", "x%3a.mp3")]
    plan = {x.batch: x.problem for x in artefacts.upload_plan(spark.createDataFrame(names, "batch string, name string")).collect()}
    assert plan == {"b1": None, "b2": "every audio file needs its subtitle", "b3": "a name cannot be stored", "b4": None, "b5": "a name cannot be stored"}
    assert spark.range(1).select(artefacts.predicted_bytes(F.lit(1.5))).first()[0] == 48_000 + 1024 * 1024


def test_report_pages(spark):
    c = cue_table(spark, "new line")
    flags = spark.createDataFrame([(1, 1, "error", "text_changed", [1], "<odd>", "old\nline", "new line")], "ep long, rank long, severity string, kind string, cue_ids array<long>, message string, old_text string, new_text string")
    issues = spark.createDataFrame([(1, 1, "warning", "overlap")], "ep long, cue_id long, severity string, kind string")
    scores = spark.createDataFrame([(1, 1, 9.0, 0.5, "asr_confidence")], "ep long, cue_id long, cps double, score double, source string")
    r = artefacts.report(c, flags, issues, scores, {"fps_source": "explicit"}).first()
    told = json.loads(r.json)
    assert told["summary"] == {"fps_source": "explicit", "cue_count": 1, "flags": 1, "style_violations": 1, "error_count": 1, "warning_count": 1, "info_count": 0} and told["flags"][0]["old_text"] == "old\nline"
    assert "&lt;odd&gt;" in r.html and "old<br>line" in r.html


def echo():
    class Echo:  # within a function: sent to the tasks as it is
        def answer(self, path):
            if path == "bad":
                raise ValueError("no sound")
            return [{"text": path, "start": 0.0, "end": 1.0, "confidence": 1.0, "speaker_id": None}]

    return Echo()


def test_live_adapters(spark):
    asked = live.ask(spark.createDataFrame([(1, "a.wav"), (2, "bad")], "ep long, path string"), "path", echo(), live.WORDS)
    assert {(x.ep, x.text, x.failed) for x in asked.collect()} == {(1, "a.wav", None), (2, None, "ValueError: no sound")}
    told = ['{"words":[{"type":"word","text":"hi","start":1,"end":2,"speaker_id":"s"},{"type":"spacing","text":" "}]}', '{"segments":[{"words":[{"word":"yo","start":0.5,"end":1,"score":0.7,"speaker":"A"}]}]}']
    got = spark.createDataFrame([(t,) for t in told], "r string").select(live.words_of(F.col("r")).alias("w")).collect()
    assert [[(w.text, w.start, w.confidence, w.speaker_id) for w in x.w] for x in got] == [[("hi", 1.0, 1.0, "s")], [("yo", 0.5, 0.7, "A")]]


def test_srt_files_and_small_predicates(spark, tmp_path):
    from cuelake.sources import srt

    srt.write_srt(cue_table(spark, "one", "two\nlines"), str(tmp_path / "out"))
    back = srt.parse(spark.read.text(str(tmp_path / "out"), wholetext=True).select("ep", "value")).orderBy("pos").collect()
    assert [(x.cue_id, x.start_ms, x.text) for x in back] == [(1, 0, "one"), (2, 1000, "two\nlines")]
    with pytest.raises(Exception, match="without text"):
        srt.write_srt(cue_table(spark, "one", " "), str(tmp_path / "bad"))
    d = spark.createDataFrame([("A", "A", "x", "y"), ("A", None, None, "y"), ("A", "B", None, None)], "a string, b string, c string, d string")
    a, b, c, e = (F.col(x) for x in "abcd")
    assert [tuple(x) for x in d.select(decisions.known_different(a, b), decisions.known_different(a, b, c, e)).collect()] == [(False, True), (False, False), (True, True)]
    jobs = spark.createDataFrame([("o", "queued")] * 3, "owner string, status string")
    assert [decisions.admission(jobs, 5, n).first().admitted for n in (1, 2, 3)] == [True, True, False]


def test_batches_go_in_parts():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (600, 0, 3)]
    parts = list(ad.in_parts(iter(batches)))
    assert [p.num_rows for p in parts] == [256, 256, 88, 3] and [x for p in parts for x in p.column("x").to_pylist()] == [*range(600), *range(3)]


def test_python_steps_are_worked_out_once(spark, sf):
    """A filter on what Python told does not have it told again: each further step in a row holds a worker of its own."""
    from cuelake.plans import queries
    from cuelake.sources.adapters import cues

    c, cases = cues(spark, sf), queries._cases(spark, sf)
    steps = lambda d: d._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    given = spark.createDataFrame([], cases.schema)
    assert steps(cases) == 1
    assert steps(ad.anchored_cue(given, c)) == 1
    assert steps(ad.reconciled_cues(given, c, 10_000_000)) == 3  # signatures of either side, likeness


def test_parts_of_batches_hold_every_row():
    import pyarrow as pa

    texts = [None, "", "Yes, yes", *(f"word {k}" for k in range(2 * tx.ROWS))]
    kind = pa.list_(pa.string())
    got = tx.by_parts(tx.signature_of, kind, pa.array(texts))
    assert got.to_pylist() == [tx.signature_of(x) for x in texts] and tx.by_parts(tx.signature_of, kind, pa.array([], pa.string())).to_pylist() == []
    batches = pa.table({"x": texts}).to_batches(300)
    assert [x for part in ad.in_parts(iter(batches)) for x in part.column(0).to_pylist()] == texts


def test_repeated_tokens_in_rows_and_pieces(spark):
    """A token counts over all pieces of its side; one that the other side lacks, or that neither repeats, is left out."""
    left = [(1, 0, ["a", "b", "c"]), (1, 2, ["a", "d", "d"]), (1, 4, []), (1, 6, None), (2, 0, ["a", "a"])]
    right = [(1, 1, ["a", "b"]), (1, 3, ["c", "c"]), (2, 1, ["b"])]
    sides = [spark.createDataFrame(s, "ep long, idx long, tokens array<string>") for s in (left, right)]
    rows = [s.select("ep", "idx", F.explode("tokens").alias("token")) for s in sides]
    for l, r in (sides, rows, (sides[0], rows[1])):
        got = decisions.repeated_tokens(l, r)
        assert got.columns == ["ep", "token", "n_left", "n_right"]
        assert sorted(map(tuple, got.collect())) == [(1, "a", 2, 1), (1, "c", 1, 2)]
