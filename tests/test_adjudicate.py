import random
import sys

from pyspark import cloudpickle

from cuelake.operators.adjudicate import adjudicate, checked, decision_of, scenes

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test
SPANS = "ep long, nth long, case_id string, cue_ids array<long>, srt_text string, asr_text string, start double, end double, confidence double, speaker_ids array<string>"


def span(ep, nth, srt="old words here", asr="quite other ones", start=None, end=None):
    return (ep, nth, f"case-{nth}", [nth + 1], srt, asr, start, end, 0.8, ["S1", "S2"])


def payload(case, text="new", sure=0.9, **other):
    return {"case_id": case, "verdict": "use_audio", "final_text": text, "confidence": sure, "reason": "heard", **other}


def run(spark, rows, adapter, **more):
    decided, found = adjudicate(spark.createDataFrame(rows, SPANS), adapter, **more)
    return {(r.ep, r.nth): (r.verdict, r.final_text, r.confidence, r.reason) for r in decided.collect()}, sorted((r.ep, r.nth, r.kind) for r in found.collect())


def test_payloads():
    assert decision_of(payload("a", speaker=None, extra=1))["final_text"] == "new" and decision_of(payload("a", sure="0.5"))["confidence"] == 0.5
    for bad in (None, [], payload(1), payload("a", text=None), payload("a", sure=1.5), payload("a", sure="x"), payload("a", verdict="drop"), payload("a", speaker=3), payload("a", reason=None), payload("a", sure=float("nan"))):
        assert decision_of(bad) is None


def test_order_repeats_and_places():
    spans = [{"ep": 1, "nth": i, "case_id": f"c{i}"} for i in range(4)]
    got = checked([payload("c2", "first"), payload("c0", "b"), payload("c2", "last"), payload("zzz"), payload("c9")], spans)
    assert [(r["final_text"], r["valid"]) for r in got] == [("b", True), (None, False), ("last", True), (None, False)]
    got = checked([payload("c0", "ok"), payload("c0", sure=7)], spans[:1])
    assert (got[0]["final_text"], got[0]["valid"]) == ("ok", False)  # decided, and asked again
    assert [r["valid"] for r in checked("no list", spans)] == [False] * 4


def test_scenes(spark):
    rows = [span(1, 0, start=0.0, end=1.0), span(1, 1, start=4.9, end=6.0), span(1, 2, start=10.1, end=11.0), span(1, 3), span(1, 4, start=90.0, end=91.0), span(2, 0, start=0.0, end=1.0)]
    got = {(r.ep, r.nth): r.batch for r in scenes(spark.createDataFrame(rows, SPANS)).collect()}
    assert got[1, 0] == got[1, 1] != got[1, 2] == got[1, 3] == got[1, 4]


def test_short_twisted_and_repeated_answers_are_asked_again_once(spark, tmp_path):
    log = str(tmp_path / "asked")

    def adapter(spans):
        with open(log, "a") as f:
            f.write(" ".join(f"{s['ep']}/{s['case_id']}" for s in spans) + "\n")
        again = open(log).read().split().count(f"{spans[0]['ep']}/{spans[0]['case_id']}") > 1
        out = [payload(s["case_id"], f"text {s['nth']}") for s in reversed(spans)]
        if spans[0]["ep"] == 1:  # the first two only, twice, the second time round the rest too
            return out if again else [payload("case-0", "x"), payload("case-1", "y"), payload("case-1", "z")]
        if spans[0]["ep"] == 2:
            return {"not": "a list"}
        return [payload(s["case_id"], sure=0.3) for s in spans]

    rows = [span(1, i, start=float(i), end=i + 0.5) for i in range(4)] + [span(2, 0)] + [span(3, 0), span(3, 1, "Same words!", "same words")]
    got, found = run(spark, rows, adapter)
    assert got[1, 0][1] == "x" and got[1, 1][1] == "z" and got[1, 2][1] == "text 2" and got[1, 3][1] == "text 3"
    assert got[2, 0] == ("keep_srt", "old words here", 0.0, "Invalid LLM response; preserved source SRT.")
    assert got[3, 1] == ("keep_srt", "Same words!", 0.8, "Punctuation/casing-only difference; preserved source SRT.") and got[3, 0][2] == 0.3
    assert found == [(2, 0, "invalid_llm_response"), (2, 0, "low_confidence_adjudication"), (3, 0, "low_confidence_adjudication")]
    assert sorted(open(log).read().splitlines()) == ["1/case-0 1/case-1 1/case-2 1/case-3", "1/case-2 1/case-3", "2/case-0", "2/case-0", "3/case-0"]


def test_many_episodes_and_none(spark):
    rng = random.Random(1)
    rows = [span(ep, i, start=(at := rng.random() * 100), end=at + 1) for ep in range(5) for i in range(20)]
    got, found = run(spark, rows, lambda spans: [payload(s["case_id"], s["asr_text"]) for s in spans])
    assert len(got) == 100 and {v[0] for v in got.values()} == {"use_audio"} and found == []
    assert run(spark, [], lambda spans: []) == ({}, [])
