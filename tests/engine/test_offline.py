import json

from utterlake.functions import hotwords
from utterlake.operators import segments
from utterlake.plans import offline
from utterlake.plans.native import QUERIES, SQL
from utterlake.streaming import finals


class Table:
    """A decoder that reads from a script: a character each second, numbers spoken."""

    script = "今天有十五个人来了。我们一共说了三百句话，天气很好。" + "".join(map(chr, range(0x6000, 0x6040)))

    def __call__(self, source, start, end):
        words = [(c, i - start, i + 1 - start) for i, c in enumerate(self.script[: 60 + source]) if start <= i and i + 1 <= end]
        return "".join(w[0] for w in words), words


def test_offline_transcripts(spark, tmp_path):
    durations = spark.createDataFrame([(i, 60.0 + i) for i in range(5)], "rec long, duration double")
    silences = spark.createDataFrame([(i, 33.6, 34.4) for i in range(5)], "rec long, start double, end double")
    done = offline.transcripts(durations, silences, Table, "rec")
    got = {r.rec: r.text for r in done.collect()}
    want = offline.numbers.to_digits(Table.script[:60])
    assert got[0] == want
    rows = offline.segments(done)
    offline.write_segments(rows, str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    first = next(x for x in lines if x["rec"] == 0 and x["index"] == 1)
    assert first["text"] == "今天有15个人来了。" and first["speaker"] is None and first["start"] == 0.0 and first["punctuation"] == "。" and "".join(c["text"] for c in first["chars"]) == first["text"]


def test_segments_anchor_marks_to_what_was_spoken(spark):
    schema = "rec long, text string, words array<struct<word:string,start:double,end:double>>"
    rows = [
        (1, "", [("陕西的", 98.016, 98.576), ("，", 99.456, 99.456), ("陕西", 99.456, 99.696), ("56", 102.816, 103.376), (".", 102.816, 103.376), ("5", 102.816, 103.376), ("嘛", 103.536, 103.616), ("？", 104.0, 104.0)]),
        (2, "", [("对！？", 10.0, 10.0)]), (3, "", [("还是正常", 344.448, 344.848), ("。", 344.848, 344.848), ("。", 345.0, 345.0), ("对", 346.0, 346.2), ("。", 346.2, 346.2)]),
        (4, "对。", None), (5, " 。 ！ ", []), (6, "", [("。", 345.0, 345.0)]), (7, "", [("，", 1.0, 1.1), ("好", 2.0, 2.5)]),
    ]
    out = segments.transcript_segments(spark.createDataFrame(rows, schema), ["rec"], "words", "text").orderBy("rec", "index").collect()
    got = [(r.rec, r["index"], r.start, r.end, r.text, r.punctuation, [tuple(c) for c in r.chars if c.text in "，.？！。"]) for r in out]
    assert got == [
        (1, 1, 98.016, 103.616, "陕西的，陕西56.5嘛？", "？", [("，", 98.576, 98.576), (".", 103.376, 103.376), ("？", 103.616, 103.616)]),
        (2, 1, 10.0, 10.0, "对！？", "！？", [("！", 10.0, 10.0), ("？", 10.0, 10.0)]),
        (3, 1, 344.448, 344.848, "还是正常。", "。", [("。", 344.848, 344.848)]), (3, 2, 346.0, 346.2, "对。", "。", [("。", 346.2, 346.2)]),
        (4, 1, 0.0, 0.0, "对。", "。", []), (7, 1, 2.0, 2.5, "，好", "", [("，", 1.0, 1.0)]),
    ]


def test_finals_in_order(spark):
    w = lambda t, s: [(c, s + i * 0.1, s + i * 0.1 + 0.1) for i, c in enumerate(t)]
    rows = [
        (1, 0, "hard_cut", "我们改变命运。", w("我们改变命运。", 0.0), 0.0, 1.0, 0.0, None, None),
        (1, 1, "vad_end", "命运十五个人呃来了。", w("命运十五个人呃来了。", 0.0), 0.6, 1.0, 0.7, 0.7, None),
        (1, 2, "vad_end", "来了。", [], 2.0, 1.0, 1.5, 1.5, None),
        (1, 3, "vad_end", "", [], 3.0, 1.0, 2.5, 2.5, "人呃来了，好的呀"),
        (1, 4, "vad_end", "呃，嗯。", w("呃，嗯。", 0.0), 9.0, 1.0, 9.0, None, None),
        (1, 5, "vad_end", "我用 Klaude 写字", w("我用 Klaude 写字", 0.0), 20.0, 1.0, 20.0, None, None),
        (2, 0, "vad_end", None, None, 0.0, 1.0, 0.0, None, None),
    ]
    schema = f"session_id long, utt long, reason string, text string, words {finals.WORDS}, audio_start double, duration double, commit double, drop_before double, partial string"
    df = spark.createDataFrame(rows, schema).repartition(4)
    out = {(r.session_id, r.utt): r for r in finals.finish(finals.settle(df), [hotwords.Term("Claude", ("Claude",), ())], 0.8).collect()}
    assert {k: (r.text, r.dropped) for k, r in out.items()} == {
        (1, 0): ("我们改变命运", None), (1, 1): ("15个人来了。", None), (1, 2): (None, "echo"), (1, 3): ("好的呀", None), (1, 4): (None, "fillers"), (1, 5): ("我用 Claude 写字", None), (2, 0): (None, "empty"),
    }
    assert "".join(x.word for x in out[1, 1].words) == "15个人来了。" and out[1, 1].words[0].word == "15" and out[1, 1].start == 0.8


def test_registry_runs_without_llm():
    from utterlake.plans import registry

    assert set(SQL) <= set(QUERIES) and set(registry.oracle_sql()) <= set(registry.queries())
