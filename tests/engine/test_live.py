"""From packets that land as files to captions in order, restarts included; uploads and their status."""

import io
import json
import time
import wave

import numpy as np
from pyspark.sql import functions as F

from utterlake.sources import audio, landing
from utterlake.streaming import captions, finals, realtime, tasks


def wav(x, rate=16_000):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def voice(seconds, rate, level=0.3):
    return level * np.sin(2 * np.pi * 440 * np.arange(int(seconds * rate)) / rate)


def land(folder, session, rate, sound, size=0.2):
    """A recording in packets, and a stop after it: (path, bytes) in order."""
    with wave.open(io.BytesIO(sound)) as f:
        raw = f.readframes(f.getnframes())
    n = int(size * rate) * 2
    files = [(folder / str(session) / f"{k}.{rate}.pcm", raw[at : at + n]) for k, at in enumerate(range(0, len(raw), n))]
    return [*files, (folder / str(session) / f"{len(files)}.json", b'{"type": "stop"}')]


def taken(frame, path, checkpoint, rows):
    """Runs a stream until it took so many rows, and stops it; timers keep such a stream busy, so it does not end by itself."""
    q = frame.writeStream.format("parquet").option("path", str(path)).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(240):
            done = [p for p in map(lambda p: json.loads(p.json), q.recentProgress) if p["numInputRows"]]
            if sum(p["numInputRows"] for p in done) >= rows:
                break
            assert q.exception() is None
            time.sleep(0.5)
    finally:
        q.stop()
    assert sum(p["numInputRows"] for p in done) == rows
    return done


TEXTS = ["我们改变命运。", "命运十五个人呃来了。", "", "好的三百元。"]


def decoded(messages):
    """A scripted decoder: a text for each utterance, which repeats the end of the one before."""
    texts = F.array(*map(F.lit, TEXTS))
    text = F.element_at(texts, (F.col("utt") % len(TEXTS) + 1).cast("int"))
    said = F.when(F.col("kind") == "partial", F.lit("命运还没有说完")).otherwise(text)
    s = lambda c: F.col(c) / 1000.0
    return messages.filter("kind <> 'error'").select("session_id", "utt", "kind", "reason", said.alias("text"), F.expr(f"cast(array() as {finals.WORDS})").alias("words"), s("start_ms").alias("audio_start"), (s("end_ms") - s("start_ms")).alias("duration"), s("commit_ms").alias("commit"), s("drop_ms").alias("drop_before"), "fresh")


def test_wav_bytes_to_ordered_captions_with_a_restart(spark, tmp_path):
    files = []
    for session, rate in ((1, 16_000), (2, 8_000)):
        quiet = np.zeros(int(2.6 * rate))
        files += land(tmp_path / "in", session, rate, wav(np.concatenate([voice(2, rate), quiet, voice(1.2, rate), quiet, voice(22, rate), quiet]), rate))
    for where in files[::-1]:
        where[0].parent.mkdir(parents=True, exist_ok=True)
    bad = [(tmp_path / "in" / "3" / "0.44100.pcm", b"\1\0" * 50), (tmp_path / "in" / "3" / "1.json", b"{"), (tmp_path / "in" / "3" / "2.json", b'{"type": "dance"}'), (tmp_path / "in" / "3" / "3.16000.pcm", b"\0")]
    bad[0][0].parent.mkdir(parents=True)
    # the second half of the packets lands first: they wait for those before them, over a restart
    half = len(files) // 2
    stream = lambda: realtime.utterance_stream(landing.packet_stream(spark, str(tmp_path / "in")), patience_ms=3_600_000)
    for part in (files[half:], files[:half] + bad):
        for path, raw in part:
            path.write_bytes(raw)
        taken(stream(), tmp_path / "messages", tmp_path / "cp1", len(part))
    messages = spark.read.parquet(str(tmp_path / "messages"))
    got = sorted(map(tuple, messages.collect()), key=repr)
    rows = []
    for path, raw in files:
        seq, *rate, form = path.name.split(".")
        if form == "json":
            rows.append((int(path.parent.name), int(seq), "stop", None, 0))
        else:
            _, rms, length = landing.read_packet(raw, int(rate[0]))
            rows.append((int(path.parent.name), int(seq), "audio", rms, length))
    batch = realtime.utterances(spark.createDataFrame(rows, "session_id long, seq long, kind string, rms double, length_ms int"))
    assert got == sorted(map(tuple, batch.collect()), key=repr)
    assert {m[3] for m in got if m[1] == "final"} >= {"vad_end", "hard_cut"}

    # captions: what the batch settles, in order, though finals come shuffled in two runs
    table = decoded(messages).withColumn("half", F.col("utt") % 2)
    schema = table.drop("half").schema
    (tmp_path / "decoded").mkdir()
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "decoded"))
    for k in (1, 0):
        part = table.filter(F.col("half") == k).drop("half")
        part.coalesce(1).write.parquet(str(tmp_path / "decoded" / str(k)))
        taken(finals.finish(captions.caption_stream(source, patience_ms=3_600_000), []), tmp_path / "captions", tmp_path / "cp2", part.count())
    last = messages.filter("kind = 'partial'").groupBy("session_id", "utt").agg(F.lit("命运还没有说完").alias("partial"))
    ended = decoded(messages).filter("kind = 'final'").join(last, ["session_id", "utt"], "left")
    want = finals.finish(finals.settle(ended), [])
    said = sorted(map(tuple, spark.read.parquet(str(tmp_path / "captions")).drop("words").collect()), key=repr)
    assert said == sorted(map(tuple, want.drop("words").collect()), key=repr)
    assert "15个人" in "".join(x[2] or "" for x in said) and len({x[0] for x in said}) == 2


def test_bad_packets_say_why(spark, tmp_path):
    d = tmp_path / "in" / "3"
    d.mkdir(parents=True)
    for name, raw in (("0.44100.pcm", b"\1\0" * 50), ("1.json", b"{"), ("2.json", b'{"type": "dance"}'), ("3.16000.pcm", b"\0"), ("4.json", b'{"type": "start", "sample_rate": 11025}'), ("5.json", b'{"type": "flush"}'), ("6.8000.pcm", b"\0\1" * 80)):
        (d / name).write_bytes(raw)
    taken(landing.packet_stream(spark, str(tmp_path / "in")), tmp_path / "out", tmp_path / "cp", 7)
    got = {r.seq: (r.kind, r.length_ms, r.error) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: ("audio", 0, "UNSUPPORTED_SAMPLE_RATE"), 1: ("audio", 0, "INVALID_JSON"), 2: ("audio", 0, "UNKNOWN_TYPE"), 3: ("audio", 0, "EMPTY_AUDIO"), 4: ("audio", 0, "UNSUPPORTED_SAMPLE_RATE"), 5: ("flush", 0, None), 6: ("audio", 10, None)}


def test_state_of_a_long_session_stays_small(spark, tmp_path):
    schema = "session_id long, seq long, kind string, rms double, length_ms int"
    rows = [(1, k, "audio", 0.05 if k % 37 < 30 else 0.0, 200) for k in range(6000)]
    for k in range(3):
        spark.createDataFrame(rows[2000 * k : 2000 * (k + 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    done = taken(realtime.utterance_stream(stream, patience_ms=3_600_000), tmp_path / "out", tmp_path / "cp", len(rows))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in done]
    assert len(held) == 3 and max(held) < 30, held
    assert spark.read.parquet(str(tmp_path / "out")).filter("kind = 'final'").count() > 10


def test_uploads_become_tasks(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.wav").write_bytes(wav(voice(1.5, 16_000)))
    (tmp_path / "up" / "b.mp3").write_bytes(b"ID3 not a wave file")
    (tmp_path / "up" / "c.wav").write_bytes(wav(np.zeros(0)))
    folder = str(tmp_path / "tasks")
    payload = lambda good: good.select("task_id", F.concat(F.lit("{\"seconds\": "), F.col("duration").cast("string"), F.lit("}")).alias("payload"))
    for _ in range(2):  # a second start finds nothing new
        q = tasks.task_sink(landing.upload_stream(spark, str(tmp_path / "up")), payload, folder).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
    found = {r.name: (r.status, r.message) for r in tasks.status(spark, folder).collect()}
    assert found == {"a.wav": ("completed", None), "b.mp3": ("failed", "UNSUPPORTED_FORMAT"), "c.wav": ("failed", "EMPTY_AUDIO")}
    ids = {r.name: r.task_id for r in tasks.status(spark, folder).collect()}
    asked = spark.createDataFrame([(ids["a.wav"],), (ids["b.mp3"],), ("nothing",)], "task_id string")
    assert {r.task_id: (r.code, r.payload) for r in tasks.answer(spark, folder, asked).collect()} == {ids["a.wav"]: ("OK", '{"seconds": 1.5}'), ids["b.mp3"]: ("FAILED", None), "nothing": ("NOT_FOUND", None)}
    # a replayed batch adds nothing
    batch = spark.createDataFrame([("t", "d.wav", 2.0, b"", None)], landing.UPLOADS)
    for _ in range(2):
        tasks.take(batch, 7, payload, folder)
    assert tasks.status(spark, folder).count() == 4 and spark.read.parquet(f"{folder}/results").filter("task_id = 't'").count() == 1


def test_telephone_packets_keep_their_length():
    x = (voice(0.2, 8_000) * 32767).astype("<i2").tobytes()
    pcm, rms, length = landing.read_packet(x, 8_000)
    assert length == 200 and len(pcm) == 2 * 3200 and 0.15 < rms < 0.25
    assert audio.pcm_to_float(landing.quantised(np.array([2.0, -2.0, 0.5]))).tolist() == [32767 / 32768, -1.0, 0.5]


def test_a_term_added_between_batches_corrects_the_second_only(spark, tmp_path):
    schema = finals.SETTLED
    rows = lambda utt: [(1, utt, "use klaude now", 0.0, 1.0, [], None)]
    words = tmp_path / "lexicon.txt"
    words.write_text("# none yet\nKafka | cafka\n", encoding="utf-8")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    for utt in (0, 1):
        spark.createDataFrame(rows(utt), schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(utt)))
        out = lambda done, number: done.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={number}"))
        q = finals.reloading(stream.parquet(str(tmp_path / "in")), str(words), out, 0.8).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        words.write_text("Kafka | cafka\nClaude | klaude\n", encoding="utf-8")
    assert {r.utt: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0: "use klaude now", 1: "use Claude now"}


def test_captions_go_on_without_a_lost_final(spark, tmp_path):
    columns = f"session_id long, utt long, {captions.WAITING}"
    row = lambda utt, text: (1, utt, "final", "vad_end", text, [], float(utt), 1.0, float(utt), None, False)
    spark.createDataFrame([row(1, "第二句话说完了"), row(2, "第三句话说完了")], columns).coalesce(1).write.parquet(str(tmp_path / "in" / "0"))
    stream = spark.readStream.schema(columns).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = captions.caption_stream(stream, patience_ms=1000).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            got = [(r.utt, r.raw) for r in spark.sql("select * from late").collect()]
            if len(got) == 2:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert sorted(got) == [(1, "第二句话说完了"), (2, "第三句话说完了")]
    assert captions.caption("我们改变命运。", "命运十五个人。") == "十五个人"


def test_settings_reach_the_folds():
    from utterlake import config

    s = config.load({"UTTERLAKE_FLUSH_SILENCE_MS": "700", "UTTERLAKE_VAD_HANGOVER_MS": "0", "UTTERLAKE_OFFLINE_MAX_CHUNK_S": "50"}).checked()
    assert s.limits().end_silence == 700 and s.limits().hangover == 0 and s.split().max_chunk == 50.0 and config.Settings().limits() == realtime.Limits()
    out, state = [], realtime.State()
    for loud in (True,) * 10 + (False,) * 21 + (True,):
        out += realtime.step(state, 0.05 if loud else 0.0, 100, "audio", s.limits())
    assert [m[2] for m in out if m[0] == "final"] == ["vad_end"] and state.hang == 0 and state.fresh and state.start == 2900
