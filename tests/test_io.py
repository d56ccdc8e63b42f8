import os
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.sources.artefacts import scan_bytes
from cuelake.sources.scanner import chunked, scan_chunks
from cuelake.sources.srt_sink import write_srt_files
from cuelake.sources.wav import read_energy
from cuelake.sources.wav16 import wav_energy


def wav(path, samples, channels=1, width=2):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(8000)
        f.writeframes(np.asarray(samples, "<i2").tobytes() if width == 2 else bytes(len(samples)))


def test_a_file_is_read_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    wav(tmp_path / "long.wav", rng.integers(-3000, 3000, 100_003))
    wav(tmp_path / "stereo.WAV", rng.integers(-3000, 3000, 2 * 5000), channels=2)
    wav(tmp_path / "empty.wav", [])
    got = wav_energy(spark, str(tmp_path), 100, windows=64)
    assert got.rdd.getNumPartitions() == 16 + 1
    rows = lambda d: sorted((r.ep, r.window, r.n, round(r.mean_square, 6)) for r in d.collect())
    assert rows(got) == rows(read_energy(spark, str(tmp_path), 100)) and len(rows(got)) == 1001 + 50
    some = got.where("ep = 'long' and window >= 990 and window < 995")
    assert some.rdd.getNumPartitions() == 1 and [r.window for r in some.orderBy("window").collect()] == list(range(990, 995))
    assert got.where("ep in ('stereo', 'none') and window = 3").count() == 1


def test_other_files_are_refused(spark, tmp_path):
    wav(tmp_path / "eight.wav", [0] * 10, width=1)
    with pytest.raises(Exception, match="16-bit"):
        wav_energy(spark, str(tmp_path), 10).collect()
    with pytest.raises(Exception, match="nowhere"):
        wav_energy(spark, str(tmp_path / "nowhere"), 10).collect()


def cues(spark, rows):
    return spark.createDataFrame(rows, "ep string, cue_id long, start_ms long, end_ms long, text string")


def test_srt_files_appear_together_or_not_at_all(spark, tmp_path):
    out = tmp_path / "out"
    rows = [(f"ep {k}", i, 1000 * (9 - i), 1000 * (9 - i) + 500, f"line {i}\nof {k}") for k in range(7) for i in range(9)]
    write_srt_files(cues(spark, rows), str(out))
    assert sorted(os.listdir(out)) == [f"ep {k}.srt" for k in range(7)]
    text = (out / "ep 3.srt").read_text()
    assert text.startswith("1\n00:00:01,000 --> 00:00:01,500\nline 8\nof 3\n\n2\n00:00:02,000 --> ") and text.count("-->") == 9
    bad = [(f"ep {k}", 1, 0, 10, "new") for k in range(7)] + [("ep 9", 5, 0, 10, " \n ")]
    with pytest.raises(Exception, match="a cue without text"):
        write_srt_files(cues(spark, bad), str(out))
    with pytest.raises(Exception, match="cannot be a file's"):
        write_srt_files(cues(spark, [("../up", 1, 0, 10, "x"), ("ep 1", 1, 0, 10, "new")]), str(out))
    assert sorted(os.listdir(out)) == [f"ep {k}.srt" for k in range(7)] and "new" not in (out / "ep 1.srt").read_text()
    write_srt_files(cues(spark, [("ep 1", 1, 0, 10, "new")]), str(out))
    assert len(os.listdir(out)) == 7 and (out / "ep 1.srt").read_text() == "1\n00:00:00,000 --> 00:00:00,010\nnew"
    write_srt_files(cues(spark, [("ep 1", 1, 0, 10, "newer")]), str(out), "overwrite")
    assert os.listdir(out) == ["ep 1.srt"]


def test_any_cut_gives_the_whole_answer(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "bb", "\n", "\r", "\r\n", "ü"]) for _ in range(rng.randint(0, 14))).encode("latin-1") for _ in range(150)] + [None, b"", b"\r", b"\n", b"\r\n"]
    whole = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ep long, content binary")
    want = {r.ep: r.problem for r in scan_bytes(whole.withColumn("content", F.coalesce("content", F.lit(b""))), 6, 4).collect()}
    for size in (1, 2, 3, 64):
        got = {r.ep: r for r in scan_chunks(chunked(whole, size), 6, 4).collect()}
        assert {k: r.problem for k, r in got.items()} == want, size
        assert all(r.lines == len((texts[k] or b"").replace(b"\r\n", b"\n").replace(b"\r", b"\n").removesuffix(b"\n").split(b"\n")) * bool(texts[k]) for k, r in got.items())
