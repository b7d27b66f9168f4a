import random
import time

from utterlake.functions import hotwords, tokensync
from utterlake.streaming import realtime as R
from utterlake.streaming import reorder


def packets(seed, sessions=6):
    r = random.Random(seed)
    rows = []
    for sid in range(sessions):
        seq, loud = 0, False
        for _ in range(r.randint(40, 160)):
            loud = loud if r.random() < 0.8 else not loud
            for _ in range(r.randint(1, 4)):
                rows.append((sid, seq, "audio", 0.05 if loud else 0.001, 100))
                seq += 1
        rows += [(sid, seq, r.choice(["flush", "reset", "what"]), None, 0), (sid, seq + 1, "audio", 0.05, 300), (sid, seq + 2, "stop", None, 0)]
    return rows


SCHEMA = "session_id long, seq long, kind string, rms double, length_ms int"


def test_stream_equals_batch(spark, tmp_path):
    rows = packets(1)
    batch = sorted(map(tuple, R.utterances(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    for k in range(3):
        spark.createDataFrame(shuffled[k::3] + shuffled[:20], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = R.utterance_stream(stream, patience_ms=600_000).writeStream.format("memory").queryName("utterances").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:  # timers keep a stream busy, so its end is awaited by what it gave
        for _ in range(200):
            got = sorted(map(tuple, spark.sql("select * from utterances").collect()), key=repr)
            if len(got) >= len(batch):
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert got == batch
    assert {m[3] for m in batch} >= {"vad_end", "cadence", "stop"}


def test_lost_packets_do_not_hold_a_stream(spark, tmp_path):
    rows = [(1, k, "audio", 0.05 if k < 6 else 0.0, 400) for k in range(12) if k != 3] + [(2, k, "audio", 0.05, 400) for k in range(4)]
    spark.createDataFrame(rows, "session_id long, seq long, kind string, rms double, length_ms int").coalesce(1).write.parquet(str(tmp_path / "in" / "0"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = R.utterance_stream(stream, patience_ms=500, forget_ms=500).writeStream.format("memory").queryName("lost").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        got = set()
        for _ in range(240):
            got = {(r.session_id, r.reason) for r in spark.sql("select * from lost where kind = 'final'").collect()}
            if {s for s, _ in got} == {1, 2}:
                break
            time.sleep(0.5)
        assert (2, "disconnect") in got and 1 in {s for s, _ in got}
    finally:
        q.stop()


def run(pattern):
    s, out = R.State(), []
    for loud, n in pattern:
        for _ in range(n):
            out += R.step(s, 0.05 if loud else 0.0, 100, "audio")
    return s, out


def test_cuts():
    _, out = run([(True, 210)])
    hard = next(m for m in out if m[2] == "hard_cut")
    assert hard[4] == 20_000 and hard[3] == 0
    s, out = run([(True, 100), (False, 4), (True, 96)])
    assert [m[2] for m in out if m[0] == "final"] == ["hard_cut"] and s.commit == 10_200
    _, out = run([(True, 130), (False, 5), (True, 10)])
    assert [m[2] for m in out if m[0] == "final"] == ["soft_cut"]
    _, out = run([(True, 10), (False, 18)])
    assert [m[2] for m in out if m[0] == "final"] == ["vad_end"]
    _, out = run([(True, 10), (False, 16), (True, 3), (False, 1)])
    assert not [m for m in out if m[0] == "final"]
    assert R.latest_silence([[2000, 2400], [8900, 9200], [9500, 9700], [10000, 10500]], 10000, 5000, 300) == [8900, 9200]


def test_reorder():
    b = reorder.OrderedFinals()
    assert [b.put(n, str(n)) for n in (3, 2, 0, 1)] == [[], [], ["0"], ["1", "2", "3"]]
    assert b.put(2, "again") == [] and b.put(5, "5") == [] and b.put(4, None) == ["5"]
    b.reset(8)
    assert b.put(8, "8") == ["8"]


def test_token_sync():
    words = [("十", 1.0, 1.1), ("五", 1.1, 1.2), ("个", 1.2, 1.4)]
    assert tokensync.sync_to_rewrite(words, "15个") == [("15", 1.0, 1.2), ("个", 1.2, 1.4)]
    chars = [(c, 10 + i / 10, 10.1 + i / 10) for i, c in enumerate("五十六点五的嘛？")]
    got = tokensync.sync_to_rewrite(chars, "56.5的嘛？")
    assert [w for w, *_ in got] == ["56.5", "的", "嘛", "？"] and (got[0][1], round(got[0][2], 3)) == (10.0, 10.5)
    assert tokensync.sync_replacements([("abc", 0, 1), ("de", 1, 2)], [(1, 4, "X")]) == [("a", 0, 1), ("X", 0, 2), ("e", 1, 2)]
    assert tokensync.sync_replacements([("abc", 0, 1)], [(0, 2, "X"), (1, 3, "Y")]) is None
    assert tokensync.sync_replacements([("ab", 0, 1), ("cd", 1, 2)], [(0, 1, "X"), (3, 4, "Y")]) == [("X", 0, 1), ("b", 0, 1), ("c", 1, 2), ("Y", 1, 2)]


def test_hotwords():
    table = {"克": ("k", "e", "4"), "劳": ("l", "ao", "2"), "德": ("d", "e", "2"), "得": ("d", "e", "2"), "很": ("h", "en", "3"), "好": ("h", "ao", "3")}
    terms = hotwords.parse_lexicon("# c\nClaude | 克劳德\n\nKafka | cafka ~~~ novel\n")
    assert hotwords.correct("克劳得很好", terms, table)[0] == "Claude很好"
    assert hotwords.correct("use cafka now", terms)[0] == "use Kafka now"
    assert hotwords.correct("the novel cafka wrote", terms)[0] == "the novel cafka wrote"
    assert hotwords.correct("Kafka", terms) == ("Kafka", [])


def test_the_lexicon_index_loses_no_hit():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(2, 9)))
    table = {c: (i, f, t) for c, i, f, t in zip("天地人山水火", ["t", "d", "r", "sh", "s", "h"], ["ian", "i", "en", "an", "ui", "uo"], "143112")}
    hanzi = lambda: "".join(r.choice("天地人山水火") for _ in range(r.randint(1, 4)))
    terms = [hotwords.Term(w, (w, v), ()) for w, v in ((r.choice([word, hanzi])(), word()) for _ in range(150))]
    for least in (0.6, 0.85):
        index = hotwords.Lexicon(terms, table, least)
        for _ in range(20):
            text = " ".join(r.choice([word, hanzi])() for _ in range(12))
            heard = hotwords.phonemes(text, table)
            all_ = {k for k, (_, alias) in enumerate(index.aliases) if hotwords.alignments(alias, heard, least)}
            assert all_ <= set(index.candidates(heard))
            whole = {(t.target, score, heard[i].start, heard[j - 1].end) for t, alias in index.aliases for score, i, j in hotwords.alignments(alias, heard, least)}
            assert {(target, score, s, e) for score, _, s, e, target in index.matches(text)} == whole
    assert len(hotwords.Lexicon(terms, table, 0.85).candidates(hotwords.phonemes("zzz qqq", table))) < 10
