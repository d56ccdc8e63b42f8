import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cuelake.functions.canonical import canonical, payload_key, refused
from cuelake.operators.findings import COLUMNS, span_findings, speech_findings, without_silent_adlibs

CUES = "ep long, cue_id long, start_ms long, end_ms long, text string"


def test_speech_under_cues(spark):
    cues = spark.createDataFrame([(1, 1, 0, 1000, "a"), (1, 2, 1000, 3000, "b"), (1, 3, 5000, 6000, "c"), (1, 4, 7000, 7000, "d"), (1, 5, None, 9000, "e"), (2, 1, 0, 1000, "f")], CUES)
    regions = spark.createDataFrame([(1, 0, 195_000), (1, 900_000, 2_000_000), (1, 1_900_000, 2_500_000)], "ep long, start_us long, end_us long")
    got = {(r.ep, r.kind.split("_")[2], tuple(r.cue_ids)): (r.message, r.confidence, r.start, r.end) for r in speech_findings(cues, regions, 4_000_000).collect()}
    assert got == {
        (1, "excessive", (2,)): ("Cue remains visible for 500 ms after the last detected speech activity; limit is 300 ms.", None, 2.5, 3.0),
        (1, "speech", (3,)): ("Cue overlaps speech activity for only 0% of its duration.", 0.0, 5.0, 6.0),
        (2, "speech", (1,)): ("Cue overlaps speech activity for only 0% of its duration.", 0.0, 0.0, 1.0),
    }


def test_spans_that_shrank(spark):
    source = spark.createDataFrame([(1, 1, 10_000, 12_000, "x"), (1, 2, 12_000, 14_000, "y")], CUES)
    rebuilt = spark.createDataFrame([(1, 1, 10_000, 10_700, "x"), (1, 2, 10_700, 11_400, "y")], CUES)
    spans = spark.createDataFrame([(1, 0, [1, 2], "alpha beta", "use_audio", "alpha"), (1, 1, [1, 2], "", "keep_srt", ""), (1, 2, [], "", "use_audio", "z"), (1, 3, [2, 9], "", "hybrid", "z"), (1, 4, [1], "", None, None)], "ep long, nth long, cue_ids array<long>, srt_text string, verdict string, final_text string")
    got = sorted((r.cue_ids, r.severity, r.message.split(" of the")[0], r.start, r.end, r.new_text) for r in span_findings(spans, source, rebuilt).collect())
    assert got == [([1, 2], "error", "Adjudicated replacement covers only 35%", 10.0, 14.0, "alpha"), ([2, 9], "error", "Adjudicated replacement covers only 35%", 12.0, 14.0, "z")]


def test_silent_adlibs_go_with_their_findings(spark):
    cues = spark.createDataFrame([(1, 1, 0, 1000, "a"), (1, 7, 1000, 2000, "oh"), (1, 8, 2000, 3000, "no"), (2, 7, 0, 500, "kept")], CUES)
    rows = [(1, "adlib_inserted", [7], None), (1, "adlib_inserted", [8], None), (1, "cue_without_speech_activity", [7], 0.0), (1, "cue_without_speech_activity", [8], 0.1), (1, "cue_without_speech_activity", [1], 0.0), (1, "text_changed", [7], 0.9), (2, "adlib_inserted", [7], None)]
    found = spark.createDataFrame(rows, "ep long, kind string, cue_ids array<long>, confidence double").withColumns({c: F.lit(None).cast("string") for c in ("severity", "message", "old_text", "new_text")} | {c: F.lit(None).cast("double") for c in ("start", "end")}).select(*COLUMNS)
    left, told = without_silent_adlibs(cues, found)
    assert sorted((r.ep, r.cue_id) for r in left.collect()) == [(1, 1), (1, 8), (2, 7)]
    assert sorted((r.ep, r.kind, r.cue_ids[0], r.old_text) for r in told.collect()) == [
        (1, "adlib_inserted", 8, None), (1, "adlib_removed_without_speech_activity", 7, "oh"), (1, "cue_without_speech_activity", 1, None), (1, "cue_without_speech_activity", 8, None), (1, "text_changed", 7, None), (2, "adlib_inserted", 7, None),
    ]


def test_canonical_json(spark):
    texts = ['{"b": 1, "a": [{"Token": "x", "z": "ü"}, 2.50]}', '{"a":[{"z":"ü"},2.5],"b":1,"API_KEY":{"deep":1}}', None, '{"a": 1, "a": 2}', '{"x": {"y": 1, "y": 1}}', "[NaN]", "{", '"text"']
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    why = {r.i: r.why for r in d.select("i", refused(F.col("t")).alias("why")).collect()}
    assert [why[i] is None for i in range(8)] == [True, True, True, False, False, False, False, True] and why[3] == "an object has a name twice"
    got = {r.i: r.c for r in d.where("i in (0, 1, 2, 7)").select("i", canonical(F.col("t")).alias("c")).collect()}
    assert got[0] == got[1] == '{"a":[{"z":"ü"},2.5],"b":1}' and got[2] is None and got[7] == '"text"'
    with pytest.raises(Exception, match="a name twice"):
        d.where("i = 3").select(canonical(F.col("t"))).collect()


def test_keys_leave_nested_secrets_out(spark):
    d = spark.createDataFrame([('{"q": [1, {"secret": 2}]}', 'm "x"], y', '{"t": {"password": "1", "k": 2}}'), ('{"q": [1, {"secret": 2}]}', 'm "x"], y', '{"t": {"k": 2}, "hf_token": []}')], "p string, m string, o string")
    plain = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    content = hashlib.sha256(plain({"q": [1, {"secret": 2}]}).encode()).hexdigest()
    want = hashlib.sha256(plain({"kind": "payload", "content_sha256": content, "model": 'm "x"], y', "params": {"t": {"k": 2}}}).encode()).hexdigest()
    assert {r.k for r in d.select(payload_key(F.col("p"), F.col("m"), F.col("o")).alias("k")).collect()} == {want}
