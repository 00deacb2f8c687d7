import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from staveframe.sources import annotations as A
from staveframe.sources import audio


def wav(x, rate=22_050, bits=16, channels=1):
    if bits == 16:
        data = (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()
    elif bits == 8:
        data = (np.asarray(x) * 127 + 128).astype(np.uint8).tobytes()
    elif bits == 24:
        data = b"".join(int(v * 8388607).to_bytes(3, "little", signed=True) for v in x)
    else:
        data = np.asarray(x, "<f4").tobytes()
    code = 3 if bits == 32 else 1
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, code, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits) + b"data" + struct.pack("<I", len(data)) + data


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_wav(bits):
    x = np.sin(np.arange(500) / 9) * 0.5
    rate, y = audio.decode_wav(wav(x, bits=bits))
    assert rate == 22_050 and np.abs(x - y).max() < (0.02 if bits == 8 else 1e-3)
    assert len(audio.resample(y, 22_050, 11_025)) == 250
    if bits != 16:
        with pytest.raises(ValueError):
            audio.decode_wav(wav(x, bits=bits), strict=True)


def test_read_and_frames(spark, tmp_path):
    t = np.arange(22_050) / 22_050
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "tone.wav").write_bytes(wav(0.5 * np.sin(2 * np.pi * 440 * t)))
    (tmp_path / "a" / "bad.wav").write_bytes(b"no sound")
    tracks = audio.read_wav(spark, str(tmp_path)).cache()
    assert {bool(r.error) for r in tracks.collect()} == {True, False}
    frames = audio.frames(tracks).collect()
    assert len(frames) == 5 and int(np.argmax(frames[0].chroma)) == 9 and abs(frames[0].frequency - 440) < 10
    assert {r.kind: r.files for r in audio.usage(spark, str(tmp_path)).collect()} == {"a": 2}
    files = spark.read.format("binaryFile").load(f"{tmp_path}/a/*.wav")
    ok = files.select(F.element_at(F.split("path", "/"), -1).alias("n"), audio.valid_input(F.col("content"), F.lit("wav"), F.col("length")).alias("ok"))
    assert {r.n: r.ok for r in ok.collect()} == {"tone.wav": True, "bad.wav": False}
    mixed = spark.createDataFrame([([1.0, 1.0], [0.0, 1.0])], "a array<float>, b array<float>").select(audio.stem_mix([(F.col("a"), 1.0), (F.col("b"), 1.0)]).alias("m")).first().m
    assert np.allclose(mixed, [0.49, 0.98])
    made = audio.synthetic(spark, 2, 5).select("track", F.size("samples").alias("n"), "end").collect()
    assert [r.track for r in made] == [0, 1] and made[0].n == 22_050 * 8 and made[0].end == [2.0, 4.0, 6.0, 8.0]


def test_labels(spark, tmp_path):
    folder = tmp_path / "Artist" / "0007"
    folder.mkdir(parents=True)
    (folder / "full.lab").write_text("0 1 C:maj\n1 x bad\n1.0 2.5 A:min extra words\n2\n")
    (folder / "majmin.lab").write_text("0 2 G:maj\n")
    rows = A.read_lab(spark, str(tmp_path)).where("title = 'full'").orderBy("start").collect()
    assert [(r.start, r.end, r.label, r.artist) for r in rows] == [(0, 1, "C:maj", "0007"), (1, 2.5, "A:min extra words", "0007")]
    assert [r.label for r in A.read_best_lab(spark, str(tmp_path)).collect()] == ["G:maj"]
    (tmp_path / "index.csv").write_text("id,artist\n7,One\nx,Two\n8,\n")
    assert [tuple(r) for r in A.read_artist_index(spark, f"{tmp_path}/index.csv").collect()] == [("0007", "One")]


def test_chroma_csv(spark, tmp_path):
    row = [1.0] + [0.0] * 11
    (tmp_path / "c.csv").write_text("\n".join(['"f.wav",0.0,' + ",".join(map(str, row + row)), "0.5," + ",".join(map(str, [2 * x for x in row + row])), "bad,row"]))
    rows = A.read_chroma_csv(spark, str(tmp_path)).orderBy("at").collect()
    assert [r.at for r in rows] == [0.0, 0.5] and rows[0].bass.index(1.0) == 9 and [r.energy for r in rows] == [0.5, 1.0]


def test_jams(spark, tmp_path):
    chords = [{"namespace": "chord", "data": [{"time": 0, "duration": 2, "value": "C:maj", "confidence": 1}, {"time": 2, "duration": 0, "value": "X"}]}, {"namespace": "beat_position", "data": []}, {"namespace": "chord", "data": [{"time": 0, "duration": 1, "value": "A:min"}]}]
    (tmp_path / "t.jams").write_text(json.dumps({"annotations": chords}, indent=1))
    assert [tuple(r)[1:] for r in A.read_jams(spark, str(tmp_path)).collect()] == [(0.0, 2.0, "C:maj")]
    assert [r.label for r in A.read_jams(spark, str(tmp_path), inferred=True).collect()] == ["A:min"]


def test_chord_text(spark):
    sheets = [("a", "[Verse]\nC G x2\nChorus: Am | F\n"), ("b", "0:00 C\n0:04 G\n1:02:03 F"), ("c", "C blah"), ("d", "0:04 C\n0:02 G"), ("e", "C <b>"), ("f", "0:00 C\nG")]
    got = A.read_chord_text(spark.createDataFrame(sheets, "id string, text string")).orderBy("id", "place").collect()
    assert [(r.id, r.section, r.chord) for r in got if r.id == "a"] == [("a", "Verse", c) for c in ("C", "G", "C", "G")] + [("a", "Chorus", c) for c in ("Am", "F")]
    assert [r.start for r in got if r.id == "b"] == [0, 4, 3723] and {r.id for r in got} == {"a", "b"}


def test_tracks_cache_and_reports(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"id":"1","audio_path":"x.wav","split":"test","chords":[{"start":0,"end":1,"label":"C"},{"start":1,"end":2,"label":"G"}]}\n{"id":"2","split":"odd","chords":[{"start":1,"end":1,"label":"C"},{"start":0,"end":2,"label":"G"}]}')
    tracks = A.read_tracks(spark, f"{tmp_path}/t.json")
    assert sorted((r.id, r.problem) for r in A.track_problems(tracks).collect()) == [("2", p) for p in ("length", "order", "path", "split")]
    cache = spark.createDataFrame([("k1", "v2", "p"), ("k2", "v1", "p"), ("k3", "v2", None)], "cache_key string, version string, payload string")
    wanted = spark.createDataFrame([("k1",), ("k2",), ("k3",), ("k4",)], "cache_key string")
    assert {r.cache_key: r.status for r in A.cache_lookup(wanted, cache, {"version": "v2"}).collect()} == {"k1": "hit", "k2": "stale", "k3": "stale", "k4": "miss"}
    report = spark.createDataFrame([("a", 1.5)], "name string, score double")
    A.write_report(report, f"{tmp_path}/out", "csv")
    assert spark.read.csv(f"{tmp_path}/out", header=True).first().name == "a"
    with pytest.raises(ValueError):
        A.write_report(report.withColumn("p", F.lit("/home/someone/x.wav")), f"{tmp_path}/out2")
    assert A.markdown_lines(report).first().value == "| a | 1.5 |"
    regions = spark.createDataFrame([(0.0, 2.0), (2.0, 5.0), (9.0, 10.0)], "start double, end double")
    assert [(r.start, r.end) for r in A.clipped(regions, F.lit(1.0), F.lit(4.0)).collect()] == [(0.0, 1.0), (1.0, 3.0)]
    (tmp_path / "m.json").write_text(json.dumps({"songs": [{"name": "a", "reference": "r", "prediction": "p"}, {"name": "b", "reference": "r"}]}))
    assert [r.name for r in A.read_pairs(spark, f"{tmp_path}/m.json").collect()] == ["a"]


def test_reference_songs(spark, tmp_path):
    section = {"id": "One Song", "status": "manually-verified", "endSeconds": 9.0, "normalization": {"capo": 2, "soundingKey": "D"}, "normalizedChordSequence": ["C", "Am/C", "N", "?"], "manualStartSeconds": [0.0, 2.5, 5.0, 5.0]}
    songs = [
        {"artist": "A", "title": "B", "sections": [section, {**section, "status": "draft"}, {**section, "id": "short", "manualStartSeconds": [0.0]}]},
        {"artist": "C", "title": "D", "split": "test", "sections": [{**section, "id": None, "endSeconds": None, "normalization": None}]},
        {"artist": "E", "title": "F", "sections": []}, {"artist": "G", "title": "H", "status": "unclear"},
    ]
    (tmp_path / "songs.json").write_text(json.dumps(songs))
    (tmp_path / "broken.json").write_text('[{"artist": "X", ')
    got = {r.id: r for r in A.read_reference_songs(spark, str(tmp_path)).collect()}
    assert set(got) == {"one-song", "c-d"}
    assert [tuple(c) for c in got["one-song"].chords] == [(0.0, 2.5, "D:maj"), (2.5, 5.0, "B:min/D"), (5.0, 5.1, "N"), (5.0, 9.0, "X")]
    assert (got["one-song"].split, got["one-song"].key, got["one-song"].duration) == ("development", "D", 9.0)
    assert [tuple(c) for c in got["c-d"].chords][-1] == (5.0, 9.0, "X") and got["c-d"].chords[1].label == "A:min/C"
    pending = A.pending_songs(spark, str(tmp_path)).where("artist IS NOT NULL").collect()
    assert sorted(tuple(r) for r in pending) == [("E", "F", "pending"), ("G", "H", "unclear")]


def test_stored_references(spark, tmp_path):
    for k, artist in enumerate(["Zed", "Abe", "Moe"]):
        (tmp_path / f"{k}.json").write_text(json.dumps({"id": str(k), "artist": artist, "title": "T", "capo": 3}))
    (tmp_path / "bad.json").write_text('{"id": "9", "artist": ')
    (tmp_path / "other.txt").write_text("{}")
    assert [r.artist for r in A.stored_references(spark, str(tmp_path)).collect()] == ["Abe", "Moe", "Zed"]


def test_manual_references(spark):
    columns = "id string, source string, artist string, title string, version string, ratingCount string, averageRating string, capo string, tuning string, key string, genre string, split string, selectionReason string, recordingNotes string"
    rows = [
        ("a", "timed-research", " X ", "t" * 200, "2", "-3", "7.5", "30", None, "k" * 40, "", "test", None, "n" * 600),
        ("b", "else", "Y", "Z", None, "x", "NaN", "-1", "Drop D", None, "folk", "other", "why", None), ("c", None, "  ", "Z", *[None] * 10), ("d", None, None, "Z", *[None] * 10),
    ]
    got = {r.id: r for r in A.manual_references(spark.createDataFrame(rows, columns)).collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a.source, a.artist, len(a.title), a.version, a.ratingCount, a.averageRating, a.capo, a.tuning, len(a.key), a.genre, a.split, len(a.recordingNotes)) == ("timed-research", "X", 160, 2.0, 0.0, 5.0, 24.0, "Standard", 32, "Unspecified", "test", 500)
    assert (b.source, b.version, b.ratingCount, b.averageRating, b.capo, b.tuning, b.key, b.genre, b.split, b.selectionReason, b.recordingNotes) == ("ultimate-guitar", 0.0, 0.0, 0.0, 0.0, "Drop D", "", "folk", "development", "why", "")
