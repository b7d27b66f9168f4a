"""Golden cases of boundary text, planning and stitching."""

import random

import pytest
from pyspark.sql import functions as F

from utterlake.functions import boundary as B
from utterlake.functions import text as T
from utterlake.operators import planner, stitch


@pytest.mark.parametrize(("prev", "text", "acoustic", "want"), [
    ("自我革命", "命，提高", False, "命，提高"), ("自我革命", "命，提高", True, "提高"),
    ("付出巨大牺牲积累的一系列", "打牺牲积累的一系列独创性经验", False, "独创性经验"),
    ("着下班，和朋友聊天的时候刷着手机", "刷手机的时候，又焦虑着未来。", False, "刷手机的时候，又焦虑着未来。"),
])
def test_strip_overlap(prev, text, acoustic, want):
    assert text[B.repeated(prev, text, acoustic, exact=False) :] == want


@pytest.mark.parametrize(("prev", "text", "acoustic", "want"), [
    ("文章？对。", "对。今天继续", False, "今天继续"), ("不平等。", "不平等条约和帝国主义", False, "条约和帝国主义"),
    ("才能发展中国。", "中国。", False, ""), ("剥削者统", "统治广大劳动人民", True, "治广大劳动人民"),
    ("剥削者统", "统治广大劳动人民", False, "统治广大劳动人民"), ("", "甲", False, "甲"), ("甲", "", False, ""),
])
def test_strip_boundary(prev, text, acoustic, want):
    assert text[B.repeated(prev, text, acoustic) :] == want


def test_small_functions():
    assert B.without_forced_stop("那么这里一定有。”") == "那么这里一定有"
    assert not B.is_leftover("伟大飞跃。", "中")
    assert B.is_leftover("伟大飞跃。", "飞跃。") and B.is_leftover("甲", "，")


@pytest.mark.parametrize(("prev", "text", "want"), [("实现。", "现国家富强", "实现国家富强"), ("文化自。", "自信，做到", "文化自信，做到"), ("今天天气很好。", "我们去公园。", "今天天气很好。我们去公园。"), ("美丽。", "的花", "美丽的花"), ("", "甲", "甲"), ("甲", "", "甲")])
def test_join_text(prev, text, want):
    assert stitch.merge(stitch.Piece(prev), stitch.Piece(text)).text == want


def test_settle_final():
    words = [("命", 0.0, 0.2), ("运", 0.2, 0.4), ("好", 0.5, 0.7)]
    got = B.settle_final(words, "命运好", 10.0, 1.0, 10.4, 10.4, "改变命运。")
    assert (got.text, got.start, got.end, [w[0] for w in got.words], got.decision.match_n, got.decision.contact_old) == ("好", 10.5, 10.7, ["好"], 2, True)
    got = B.settle_final(words, "命运好", 20.0, 1.0, 10.4, 10.4, "改变命运。")
    assert got.text == "命运好" and got.decision.contact_old is False


def plan(duration, silences=(), **kw):
    """The chunks between the cuts, as the window over them makes them."""
    cfg = planner.SplitConfig(**kw)
    cuts = planner.Cuts(duration, cfg)
    found = [c for s in silences for c in cuts.silence(*s)] + list(cuts.finish())
    out = []
    for k, (at, kind) in enumerate(found):
        before, how = found[k - 1] if k else (0.0, None)
        back = cfg.overlap(how) if how else 0.0
        out.append((round(max(0.0, before - back), 3), round(at, 3), kind, before if how and (back > 0 or how == "hard") else None))
    return out


def test_plans():
    assert plan(11) == [(0.0, 11.0, "tail", None)]
    p = plan(80, [(34.0, 35.2)])
    assert p[0] == (0.0, 34.6, "silence", None) and p[1][0] == 34.2 and p[1][3] == 34.6
    p = plan(100, [(34.0, 35.2), (69.0, 70.2)])
    assert [x[2] for x in p[:2]] == ["silence", "silence"] and p[1][1] - p[1][0] <= 40
    assert any(k == "hard" and e - s <= 41.6 for s, e, k, _ in plan(134, [(34.0, 35.2)]))
    p = plan(80)
    assert p[0] == (0.0, 40.0, "hard", None) and p[1][0] == 38.5 and p[1][3] == 40
    p = plan(80, allow_hard_overlap=False)
    assert p[1][0] == 40.0 and p[1][3] == 40
    p = plan(80, [(34.0, 35.2)], allow_hard_overlap=False)
    assert p[1][0] == p[0][1] and p[1][3] is None
    assert plan(80, [(31.5, 31.9), (34.2, 34.9), (38.1, 39.5)])[0][1] == 34.55
    with pytest.raises(ValueError, match="target"):
        planner.SplitConfig(target=50)


def test_plans_of_many_recordings(spark):
    durations = spark.createDataFrame([(i, 30.0 + 17 * i) for i in range(20)], "rec long, duration double")
    rows = [(i, 33.0 + 30 * k + i, 33.7 + 30 * k + i) for i in range(0, 20, 2) for k in range(4)]
    silences = spark.createDataFrame(rows, "rec long, start double, end double")
    want = [(i, n, *p) for i in range(20) for n, p in enumerate(plan(30.0 + 17 * i, sorted((s, e) for r, s, e in rows if r == i)))]
    assert sorted(map(tuple, planner.chunk_plans(durations, silences, "rec").collect())) == want


def test_stitch(spark):
    w = lambda *xs: [(a, b, c) for a, b, c in xs]
    rows = [
        (1, 0, 0.0, 40.0, None, "hard", "我们要实现。", w(("我们", 1.0, 2.0), ("要", 2.0, 3.0), ("实", 38.6, 38.8), ("现", 39.0, 39.5), ("。", 39.5, 39.5))),
        (1, 1, 38.5, 60.0, 40.0, "tail", "现国家富强", w(("现", 0.5, 1.0), ("国家", 2.0, 3.0), ("富强", 3.0, 4.0))),
        (2, 0, 0.0, 10.0, None, "tail", "好。", w(("好", 0.0, 1.0), ("。", 1.0, 1.0))),
    ]
    schema = "rec long, chunk int, audio_start double, audio_end double, drop_before double, kind string, text string, words array<struct<word:string,start:double,end:double>>"
    got = {r.rec: r for r in stitch.stitch(spark.createDataFrame(rows, schema).repartition(4), "rec").collect()}
    assert got[1].text == "我们要实现国家富强" and "".join(x.word for x in got[1].words) == got[1].text
    assert got[2].text == "好。"


def test_small_rewrites():
    assert B.fallback_final("", "", "命运好", "改变命运", 1.0) == "好" and B.fallback_final("x", "", "y") == "" and B.fallback_final("", "z", "y") == "z"
    assert B.loop_at_end("前文。" + "发文章？对。" * 6)[0] == "发文章？对。" and B.trim_loop("前文。" + "发文章？对。" * 6) == "前文。" + "发文章？对。" * 2
    assert B.loop_at_end("前文，" + "对" * 6) is None and B.loop_at_end("前文，" + "对" * 12)[0] == "对"
    assert B.rescue_dedup([("甲", 9.0, 9.5), ("乙", 10.0, 10.5)], "", "", 10.0)[0] == "乙"


def test_column_rewrites(spark):
    goldens = [
        ("done", "好的。", True), ("done", "真的吗？”", True), ("done", "我们走向，蓝色海洋。", False), ("done", "我们走向，蓝色的大海洋。", True), ("done", "还没有说完", False), ("done", None, False), ("done", "", False),
        ("fragment", "决议公布。决。", "决议公布。"), ("fragment", "决议公布。决", "决议公布。"), ("fragment", "决议公布。", "决议公布。"), ("fragment", "他说好。一二三。", "他说好。一二三。"), ("fragment", "好", "好"),
        ("dangling", "武装夺取政权的政。", "武装夺取政权的"), ("dangling", "武装夺取政权。", "武装夺取政权。"),
        ("tail", "一二，三。", "一"), ("tail", "一", ""), ("tail", "", ""),
    ]
    made = {"done": T.ends_sentence, "fragment": T.trim_fragment, "dangling": T.trim_dangling, "tail": lambda c: T.drop_sounds(c, 2)}
    for kind, f in made.items():
        rows = [(i, t) for i, (k, t, _) in enumerate(goldens) if k == kind]
        got = {r.i: r.out for r in spark.createDataFrame(rows, "i int, t string").select("i", f(F.col("t")).alias("out")).collect()}
        assert got == {i: goldens[i][2] for i, _ in rows}, kind


def test_border_is_the_longest():
    r = random.Random(2)
    for _ in range(500):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(2))
        assert B.border(a, b) == max((n for n in range(min(len(a), len(b)) + 1) if a.endswith(b[:n])), default=0)


def test_pieces_of_a_long_recording(spark):
    """State is the last piece and a tail: the pieces of a recording put together are its text."""
    schema = "rec long, chunk int, audio_start double, audio_end double, drop_before double, kind string, text string, words array<struct<word:string,start:double,end:double>>"
    says = [f"第{'一二三四五六七八九'[k % 9]}段{'天地人山水火'[k % 6]}。" for k in range(60)]
    rows = [(1, k, 40.0 * k, 40.0 * k + 40, None, "tail", t, [(c, i * 0.5, i * 0.5 + 0.4) for i, c in enumerate(t)]) for k, t in enumerate(says)]
    rows += [(2, 0, 0.0, 1.0, None, "tail", "", []), (3, 0, 0.0, 1.0, None, "tail", None, None)]
    df = spark.createDataFrame(rows, schema)
    got = {r.rec: r for r in stitch.stitch(df, "rec").collect()}
    assert got[1].text == "".join(says) and len(got[1].words) == sum(map(len, says)) and got[2].text == got[3].text == "" and got[3].words == []
    assert stitch.pieces(df, "rec").filter("rec = 1").count() == 60


def test_settings():
    from utterlake import config

    s = config.load({"UTTERLAKE_OFFLINE_TARGET_S": "50", "UTTERLAKE_FLUSH_SILENCE_MS": "x", "UTTERLAKE_ITN": "off", "UTTERLAKE_SOFT_CUT_SILENCE_MS": "700"})
    assert not s.itn and s.flush_silence_ms == 600 and s.broken() == ["soft_cut_silence_ms < flush_silence_ms", "offline_target_s < offline_max_chunk_s"]


def test_fillers_leave_finished_segments(spark):
    """Only segments that change lose characters and take new times; pieces kept in part stay in part."""
    from utterlake.functions.segments import clean_segments

    schema = "rec long, index long, start double, end double, text string, punctuation string, speaker string, chars array<struct<text:string,start:double,end:double>>"
    c = lambda *xs: [(t, float(s), float(e)) for t, s, e in xs]
    rows = [
        (1, 1, 1.0, 1.2, "呃，", "", None, c(("呃", 1, 1.2), ("，", 1.2, 1.2))),
        (1, 2, 1.0, 2.3, "嗯，对。", "。", None, c(("嗯", 1, 1.2), ("，", 1.2, 1.2), ("对", 2, 2.3), ("。", 2.3, 2.3))),
        (1, 3, 0.0, 4.0, "，好", "", None, c(("，", 0, 0), ("好", 3, 4))),
        (1, 4, 5.0, 6.0, "呃我说", "", None, c(("呃我", 5, 5.5), ("说", 5.5, 6))),
        (1, 5, 7.0, 8.0, "呃好！", "！", None, c(("别", 7, 8))),
        (2, 1, 0.0, 1.0, "嗯嗯", "", None, None),
    ]
    got = [(r.rec, r["index"], r.start, r.end, r.text, r.punctuation, [tuple(x) for x in r.chars]) for r in clean_segments(spark.createDataFrame(rows, schema), ["rec"]).orderBy("rec", "index").collect()]
    assert got == [
        (1, 1, 2.0, 2.3, "对。", "。", [("对", 2.0, 2.3), ("。", 2.3, 2.3)]), (1, 2, 0.0, 4.0, "，好", "", [("，", 0.0, 0.0), ("好", 3.0, 4.0)]),
        (1, 3, 5.0, 6.0, "我说", "", [("我", 5.0, 5.5), ("说", 5.5, 6.0)]), (1, 4, 7.0, 8.0, "好！", "！", []),
    ]


def test_words_follow_a_rewrite():
    from utterlake.functions.tokensync import sync_to_rewrite

    timed = lambda *ws: [(w, float(i), float(i + 1)) for i, w in enumerate(ws)]
    assert sync_to_rewrite(timed(*"五千克"), "5kg") == [("5kg", 0.0, 3.0)]
    assert sync_to_rewrite(timed("1", "5"), "15") == [("15", 0.0, 2.0)]
    assert sync_to_rewrite(timed(*"你好"), "") == timed(*"你好")
    assert sync_to_rewrite(timed(*"有十五个人"), "有15个人") == [("有", 0.0, 1.0), ("15", 1.0, 3.0), ("个", 3.0, 4.0), ("人", 4.0, 5.0)]
    assert sync_to_rewrite(timed("用", "Chat", "GPT", "写"), "用ChatGPT写。") == [("用", 0.0, 1.0), ("ChatGPT", 1.0, 3.0), ("写", 3.0, 4.0), ("。", 4.0, 4.0)]
    assert sync_to_rewrite(timed("A1", "2"), "A12") == timed("A1", "2")
    assert sync_to_rewrite([], "x") == []
