"""Queries over the given tables, each beside the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates, intervals, lexicon, sessions, tokens
from ..sources import lexicons

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
HOUR = 3_600_000_000
#: Sentence ends of these queries: the reference set and the full stop, the only mark in the tables.
ENDS = T.SENTENCE_END + "."
PUNCT = T.PUNCTUATION.replace("'", "''")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of a source: user_id, us, event_id, value."""
    return table(spark, sf_dir, "events").select("user_id", intervals.micros(F.col("ts")).alias("us"), "event_id", "value", "event_type")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their timed tokens."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens.timed(F.col("text"), F.col("turn") * 120_000).alias("words"))


TOKENS = """tokens AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS pos FROM conversations),
    timed AS (SELECT *, turn * 120000 + pos * 250 AS s, turn * 120000 + pos * 250 + 200 AS e FROM tokens)"""
FRAMES = "frames AS (SELECT user_id, epoch_us(ts) AS us, event_id, value, event_type FROM events)"
ISLANDS = FRAMES + """, marked AS (SELECT *, value < 20 AS quiet, value < 20 AND NOT coalesce(lag(value < 20) OVER w, false) AS b FROM frames WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
    numbered AS (SELECT *, sum(CAST(b AS INT)) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) - 1 AS island FROM marked),
    islands AS (SELECT user_id, CAST(island AS BIGINT) AS island, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM numbered WHERE quiet GROUP BY ALL)"""


@query(f"""WITH {TOKENS},
    ended AS (SELECT *, CAST(regexp_matches(word, '[{ENDS}]["”’)]*$') AS INT) AS is_end FROM timed),
    numbered AS (SELECT *, sum(is_end) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS UNBOUNDED PRECEDING) - is_end AS sent FROM ended),
    rolled AS (SELECT conv_id, turn, sent, min(s) AS start_ms, max(e) AS end_ms, count(*) AS n_tokens, string_agg(word, ' ' ORDER BY pos) AS text FROM numbered GROUP BY ALL)
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY sent) AS index, start_ms, end_ms, n_tokens, text FROM rolled WHERE regexp_matches(text, '[^\\s\\pP]')""")
def sentence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG1, SEG2, WIN8, WIN10, AGG5, AGG15: timed tokens to sentences."""
    return tokens.sentences(turns(spark, sf_dir), "words", ENDS)


@query(f"""SELECT doc_id, regexp_matches(coalesce(text, ''), '[^\\s\\pP]') AS has_content, length(translate(coalesce(text, ''), '{PUNCT}', '')) AS plain_chars FROM documents""")
def content_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT3, SCL1: whether there is content, and its length without punctuation."""
    return table(spark, sf_dir, "documents").select("doc_id", T.has_content(F.col("text")).alias("has_content"), F.char_length(T.plain(F.col("text"))).cast("long").alias("plain_chars"))


@query(f"WITH {ISLANDS} SELECT * FROM islands")
def silence_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1: runs of quiet frames."""
    return intervals.islands(frames(spark, sf_dir), "user_id", "us", "event_id", F.col("value") < 20)


@query(f"""WITH {FRAMES}, r AS (SELECT *, sum(CAST(value < 30 AS INT)) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS g FROM frames),
    s AS (SELECT event_id, sum(CASE WHEN value >= 30 THEN 100 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run_ms FROM r)
    SELECT event_id, CAST(run_ms AS BIGINT) AS run_ms, run_ms >= 200 AS onset FROM s""")
def energy_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN2, WIN3: loud time that a quiet frame resets, and the onset it makes."""
    run = intervals.running_with_reset(frames(spark, sf_dir), "user_id", "us", "event_id", F.col("value") >= 30, F.lit(100), "run_ms")
    return run.select("event_id", F.col("run_ms").cast("long").alias("run_ms"), (F.col("run_ms") >= 200).alias("onset"))


@query(f"""WITH {FRAMES}, m AS (SELECT *, coalesce(CAST(us - lag(us) OVER w > {6 * HOUR} AS INT), 0) AS b FROM frames WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session FROM m)
    SELECT user_id, CAST(session AS BIGINT) AS session, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM s GROUP BY ALL""")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4 with one gap."""
    return intervals.gap_sessions(frames(spark, sf_dir), "user_id", "us", "event_id", 6 * HOUR)


@query(f"""WITH RECURSIVE {FRAMES}, o AS (SELECT user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM frames),
    f AS (SELECT user_id, k, us, CAST(0 AS BIGINT) AS session, CAST(1 AS BIGINT) AS n FROM o WHERE k = 1
        UNION ALL SELECT o.user_id, o.k, o.us, CASE WHEN x.cut THEN f.session + 1 ELSE f.session END, CASE WHEN x.cut THEN 1 ELSE f.n + 1 END
        FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1, LATERAL (SELECT o.us - f.us > CASE WHEN f.n >= 3 THEN {6 * HOUR} ELSE {10 * HOUR} END AS cut) x)
    SELECT user_id, session, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM f GROUP BY ALL""")
def two_tier_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4, WIN4: the allowed gap is longer until a session is established."""
    return sessions.two_tier_sessions(frames(spark, sf_dir), "user_id", "us", "event_id", 10 * HOUR, 6 * HOUR, 3)


DAYS = "days AS (SELECT *, unnest(range(start_us // 86400000000, end_us // 86400000000 + 1)) AS day FROM islands)"


@query(f"""WITH {ISLANDS}, {DAYS}, cut AS (SELECT user_id, day, greatest(start_us, day * 86400000000) AS lo, least(end_us, (day + 1) * 86400000000) AS hi FROM days),
    gaps AS (SELECT *, lo - coalesce(max(hi) OVER (PARTITION BY user_id, day ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), day * 86400000000) AS gap FROM cut)
    SELECT user_id, day, CAST(sum(hi - lo) AS BIGINT) AS quiet_us, CAST(86400000000 - sum(hi - lo) AS BIGINT) AS speech_us, CAST((86400000000 - sum(hi - lo)) * 1000 // 86400000000 AS BIGINT) AS speech_permille,
           greatest(max(gap), (day + 1) * 86400000000 - max(hi)) AS longest_us FROM gaps GROUP BY user_id, day""")
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON1, AGG3, WIN12: quiet and speech of each day, and the longest gap."""
    return intervals.coverage(silence_islands(spark, sf_dir), "user_id")


@query(f"""WITH {ISLANDS}, {DAYS}, t AS (SELECT *, day * 86400000000 + 43200000000 AS target FROM days),
    f AS (SELECT *, start_us + end_us AS mid2, 10 * abs(start_us + end_us - 2 * target) - 6 * (end_us - start_us) AS score FROM t
        WHERE least(end_us, target + 21600000000) > greatest(start_us, target - 21600000000) AND start_us + end_us > 2 * (target - 21600000000) AND start_us + end_us <= 2 * (target + 21600000000))
    SELECT user_id, day, mid2 AS mid2_us, score FROM f QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY score, start_us) = 1""")
def nearest_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON2, JON3, AGG10: the best placed quiet interval of each day."""
    return intervals.nearest(silence_islands(spark, sf_dir), "user_id", 12 * HOUR, 6 * HOUR)


@query(f"""WITH {ISLANDS} SELECT t.event_id, i.start_us AS cut_start_us, i.end_us AS cut_end_us FROM frames t LEFT JOIN islands i
    ON i.user_id = t.user_id AND i.end_us <= t.us AND i.end_us - i.start_us >= {HOUR} AND i.start_us + i.end_us >= 2 * (t.us - {48 * HOUR})
    WHERE t.event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY t.event_id ORDER BY i.end_us DESC NULLS LAST) = 1""")
def hard_cut_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON4: of each target the latest long enough quiet interval not too far before it."""
    targets = frames(spark, sf_dir).filter("event_type = 'purchase'")
    return intervals.latest_before(targets, silence_islands(spark, sf_dir), "user_id", "us", "event_id", 48 * HOUR, HOUR)


@query(f"""WITH {TOKENS}, k AS (SELECT conv_id, turn, s + 5000 AS s, e + 5000 AS e FROM timed)
    SELECT conv_id, turn, count(*) FILTER (WHERE s + e >= 2 * (turn * 120000 + 10000 - 150)) AS n_kept, min(s) FILTER (WHERE s + e >= 2 * (turn * 120000 + 10000 - 150)) AS first_ms FROM k GROUP BY ALL""")
def drop_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1, FLT1: tokens shifted by a chunk's start, those before its cut dropped."""
    kept = tokens.drop_overlap(tokens.shift(F.col("words"), 5000), F.col("turn") * 120_000 + 10_000, 150)
    rows = turns(spark, sf_dir).filter("words is not null").select("conv_id", "turn", kept.alias("kept"))
    return rows.select("conv_id", "turn", F.size("kept").cast("long").alias("n_kept"), F.array_min(F.transform("kept", lambda w: w["start"])).alias("first_ms"))


@query(f"""WITH p AS (SELECT conv_id, turn, translate(coalesce(text, ''), '{PUNCT}', '') AS t, translate(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), '{PUNCT}', '') AS p FROM conversations)
    SELECT conv_id, turn, coalesce(list_max(list_filter(range(1, least(length(p), length(t)) + 1), lambda n: right(p, n) = left(t, n))), 0) AS overlap,
           CASE WHEN length(t) = 0 THEN true WHEN length(t) > 4 OR length(p) = 0 THEN false ELSE contains(right(p, length(t) + 2), t) END AS echo FROM p""")
def suffix_prefix_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON14, FLT12: how much of a turn repeats the end of the one before."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.plain(F.col("text")).alias("t"))
    rows = rows.withColumn("p", F.coalesce(F.lag("t").over(W.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    return rows.select("conv_id", "turn", T.suffix_prefix(F.col("p"), F.col("t")).cast("long").alias("overlap"), T.leftover_echo(F.col("p"), F.col("t")).alias("echo"))


@query(f"""SELECT doc_id, regexp_replace(text, '[{ENDS}]+(["''“”‘’]*)$', '\\1') AS bare, array_to_string(list_slice(w, greatest(len(w) - 4, 1), len(w)), ' ') AS tail
    FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM documents)""")
def strip_and_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL7, SCL10: terminal marks stripped, and the words that are carried to the next chunk."""
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_terminal(F.col("text"), ENDS).alias("bare"), T.carry_tail(F.col("text")).alias("tail"))


@query("""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents), w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part)
    SELECT token, term, levenshtein(token, term) AS distance FROM t, w WHERE levenshtein(token, term) <= 1""")
def fuzzy_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON6, JON7, HOT4: distinct document tokens within one edit of a lexicon term."""
    found = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1)).alias("token")).distinct()
    terms = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("term")).distinct()
    return lexicon.fuzzy_terms(found, terms).select("token", "term", F.col("distance").cast("long").alias("distance"))


@query(f"""WITH {TOKENS}, low AS (SELECT conv_id, turn, pos, lower(word) AS w FROM tokens)
    SELECT m.conv_id, m.turn, m.pos FROM low m WHERE m.w IN ('the', 'la', 'die') AND NOT EXISTS (SELECT 1 FROM low b WHERE b.conv_id = m.conv_id AND b.turn = m.turn AND b.pos BETWEEN m.pos - 5 AND m.pos + 5 AND b.w IN ('of', 'de', 'der'))""")
def blacklist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON10, HOT8: matches without a black word within five words."""
    words = F.split(F.lower("text"), " ", -1)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("w"))
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).isin("the", "la", "die") & ~lexicon.blacklisted(F.col("w"), i, ["of", "de", "der"]))
    return rows.filter("w is not null").select("conv_id", "turn", F.explode(at).alias("pos")).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"))


@query("""WITH b AS (SELECT event_type, user_id, max(value) AS value FROM events GROUP BY ALL)
    SELECT event_type, user_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, user_id) AS rank FROM b QUALIFY rank <= 10""")
def best_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT1, AGG7, AGG8, AGG9: the ten best items of each group, an item once."""
    return lexicon.best_per_group(table(spark, sf_dir, "events").select("event_type", "user_id", "value"), "event_type", "user_id", "value", 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {TOKENS}, o AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS UNBOUNDED PRECEDING) - length(word) - 1 AS lo FROM timed),
    spans AS (SELECT conv_id, turn, unnest(range(0, length(text), 37)) AS lo FROM conversations)
    SELECT p.conv_id, p.turn, p.lo, count(o.pos) AS n_tokens, min(o.s) AS start_ms, max(o.e) AS end_ms FROM spans p LEFT JOIN o ON o.conv_id = p.conv_id AND o.turn = p.turn AND o.lo < p.lo + 10 AND o.lo + length(o.word) > p.lo GROUP BY ALL""")
def span_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON5, WIN7, AGG4: the time that spans of character offsets cover."""
    rows = table(spark, sf_dir, "conversations").filter("text <> ''")
    starts = rows.select("conv_id", "turn", F.explode(F.sequence(F.lit(0), F.char_length("text") - 1, F.lit(37))).alias("lo"))
    spans = starts.select("conv_id", "turn", F.col("lo").cast("long").alias("lo"), (F.col("lo") + 10).cast("long").alias("hi"))
    placed = tokens.with_offsets(turns(spark, sf_dir), ["conv_id", "turn"], "words")
    return tokens.on_spans(placed, spans, ["conv_id", "turn"])


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN NOT ends_with(text, '.') THEN length(text) END AS n FROM conversations)
    SELECT conv_id, turn, count(n) OVER w AS n_held, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS held_chars, max(CASE WHEN n IS NOT NULL THEN turn END) OVER w AS last_held
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def pending_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN13, STR19: what of the earlier turns of a conversation is not final yet: how many, their length, and the last.

    The held texts stay in their own rows; a row of the window carries three numbers, however long the prefix.
    """
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(~F.endswith("text", F.lit(".")), F.char_length("text")).alias("n"))
    return rows.select("conv_id", "turn", F.count("n").over(before).alias("n_held"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("held_chars"), F.max(F.when(F.col("n").isNotNull(), F.col("turn"))).over(before).alias("last_held"))


@query(f"""WITH {FRAMES}, a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS seq, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS arrived FROM frames)
    SELECT user_id, event_id, seq, arrived, max(arrived) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS emitted FROM a""")
def reorder_finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR14: a reorder buffer's result in batch: a final goes out once all before it have arrived."""
    rows = frames(spark, sf_dir)
    seq, arrived = W.partitionBy("user_id").orderBy("us", "event_id"), W.partitionBy("user_id").orderBy("value", "event_id")
    rows = rows.select("user_id", "event_id", F.row_number().over(seq).cast("long").alias("seq"), F.row_number().over(arrived).cast("long").alias("arrived"))
    return rows.withColumn("emitted", F.max("arrived").over(W.partitionBy("user_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)))


@query("""SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.95), 3) AS p95, count(*) FILTER (WHERE value >= 100) AS slow FROM events WHERE value >= 0 GROUP BY ALL""")
def lag_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12, AGG13, AGG14: exact percentiles and counts by kind."""
    rows = table(spark, sf_dir, "events").select("event_type", "value").filter("value >= 0")
    counts = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 100).alias("slow"))
    found = aggregates.percentiles(rows, "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return counts.join(F.broadcast(found), "event_type").select("event_type", "n", *(F.round(p, 3).alias(p) for p in ("p50", "p95")), "slow")


@query("""SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n FROM events GROUP BY ALL""")
def control_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC9, SRC15: messages parsed from JSON, bad ones to null, counted by kind."""
    parsed = F.from_json("props", "k long", {"mode": "PERMISSIVE"})
    return table(spark, sf_dir, "events").select("event_type", (parsed["k"] % 10).alias("bucket")).groupBy("event_type", "bucket").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' END AS language,
    'n=' || length(coalesce(text, '')) || ' ' || CASE WHEN length(coalesce(text, '')) <= 96 THEN coalesce(text, '') ELSE left(text, 48) || '…' || right(text, 48) END AS preview FROM documents""")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ9, PRJ10: language names and log previews."""
    return table(spark, sf_dir, "documents").select("doc_id", T.language_name(F.col("lang")).alias("language"), T.preview(F.col("text")).alias("preview"))


@query("""SELECT event_id, CAST(greatest(0, event_id * 320 - 12800) AS BIGINT) AS origin, event_id * 320 // 8192 AS full_windows, round(greatest(0.3, value + 0.05), 3) AS window_s, CAST(least(512, greatest(32, floor(value * 8))) AS INT) AS budget FROM events""")
def stream_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ4, PRJ5, PRJ7, SCL27: cursors of a packet stream by plain arithmetic."""
    n = F.col("event_id") * 320
    return table(spark, sf_dir, "events").select("event_id", F.greatest(F.lit(0), n - 12800).cast("long").alias("origin"), F.floor(n / 8192).cast("long").alias("full_windows"), F.round(F.greatest(F.lit(0.3), F.col("value") + 0.05), 3).alias("window_s"), T.token_budget(F.col("value")).alias("budget"))


@query("""WITH l AS (SELECT p_partkey AS n, p_brand || ' | ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' ~~~ ' || p_type ELSE '' END AS line FROM part)
    SELECT split_part(line, ' | ', 1) AS target, split_part(split_part(line, ' | ', 2), ' ~~~ ', 1) AS alias, CASE WHEN contains(line, '~~~') THEN split_part(line, ' ~~~ ', 2) ELSE '' END AS black
    FROM l QUALIFY row_number() OVER (PARTITION BY target ORDER BY n DESC) = 1""")
def lexicon_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10, HLP5: lexicon lines to targets, aliases and blacklists; the last line of a target wins."""
    line = F.concat("p_brand", F.lit(" | "), "p_name", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" ~~~ "), "p_type")).otherwise(F.lit("")))
    found = lexicons.parse(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), line.alias("line")), "line", "n")
    return found.select("target", F.get("aliases", F.lit(1)).alias("alias"), F.array_join("black", " ").alias("black"))


@query(SQL["interval_coverage"].replace("SELECT user_id, day, CAST(sum(hi - lo)", "SELECT user_id, day, longest_us >= 28800000000 OR (speech_us >= 21600000000 AND speech_permille >= 500) AS suspicious_tail, speech_us >= 43200000000 AS suspicious_empty, speech_us < 7200000000 AND longest_us < 3600000000 AS skip_tail FROM (SELECT user_id, day, CAST(sum(hi - lo)") + ")")
def chunk_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT5, FLT6, FLT7: what the speech in a window says about an empty or early-ending chunk."""
    speech, longest = F.col("speech_us"), F.col("longest_us")
    return interval_coverage(spark, sf_dir).select("user_id", "day", ((longest >= 8 * HOUR) | ((speech >= 6 * HOUR) & (F.col("speech_permille") >= 500))).alias("suspicious_tail"), (speech >= 12 * HOUR).alias("suspicious_empty"), ((speech < 2 * HOUR) & (longest < HOUR)).alias("skip_tail"))


@query("""WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations)
    SELECT DISTINCT conv_id, turn, word FROM w WHERE NOT EXISTS (SELECT 1 FROM w p WHERE p.conv_id = w.conv_id AND p.turn = w.turn - 1 AND p.word = w.word)""")
def new_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET2: words of a turn that the turn before does not have, duplicates removed altogether."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(F.split("text", " ", -1))).alias("word"))
    before = words.select("conv_id", (F.col("turn") + 1).alias("turn"), "word")
    return words.join(before, ["conv_id", "turn", "word"], "left_anti")


@query("""SELECT event_id, round(value * 1000, 1) AS encode_ms, coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) AS n_chunks, round(least(100.0, value / 5.0), 2) AS progress FROM events""")
def perf_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ3, PRJ8: model timings in milliseconds, counts with a default, progress in percent."""
    return table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * 1000, 1).alias("encode_ms"), F.coalesce(F.from_json("props", "k int")["k"], F.lit(0)).alias("n_chunks"), F.round(F.least(F.lit(100.0), F.col("value") / 5.0), 2).alias("progress"))
