"""Edge rows from FIXTURES.md section 3, expected values written by hand."""

import pytest
from pyspark.sql import functions as F

from eventlens.functions import text as tx
from eventlens.functions.encoding import is_encoding_suspect, repair_encoding, to_mojibake
from eventlens.functions.timewin import parse_timestamp, time_window
from eventlens.plans.pipelines import emotion_features


def one(spark, value, expr_fn, schema="s string"):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(expr_fn(F.col(df.columns[0])).alias("o")).collect()[0]["o"]


DISPLAY_CHAIN = [
    ("RT @user: Flood", "Flood"),
    ("@u RT x", "RT x"),
    ("- Earthquake", "Earthquake"),
    ("#earthquake # now", "earthquake # now"),
    ("wow!!!!!!?????", "wow!!!???"),
    ("wow!!!??", "wow!!!??"),
    ("a\tb\n c", "a b c"),
    ("ð\x9f\x98\x94", "😔"),
    ("château", "château"),
    (None, ""),
]


@pytest.mark.parametrize("raw,expected", DISPLAY_CHAIN)
def test_clean_display_chain(spark, raw, expected):
    assert one(spark, raw, tx.clean_display) == expected


def test_single_rules(spark):
    assert one(spark, "see https://a.b/c and www.x.y now", tx.strip_urls) == "see  and  now"
    assert one(spark, "hi @bob_1! x", tx.strip_mentions) == "hi ! x"
    assert one(spark, "RT  hello RT", tx.strip_rt) == "hello RT"
    assert one(spark, " RT hello", tx.strip_rt) == " RT hello"
    assert one(spark, ":- \t go", tx.strip_lead_punct) == "go"
    assert one(spark, "#a #b_c # d", tx.unhash) == "a b_c # d"
    assert one(spark, "!!!!", tx.cap_bang) == "!!!"
    assert one(spark, "????x", tx.cap_question) == "???x"
    assert one(spark, "!!!!????", tx.cap_mixed) == "!!!???"
    assert one(spark, "  a \r\n\t b  ", tx.squash_ws) == "a b"


def test_semantic_and_emotion(spark):
    raw = "Hi @you! 5 #Cats 😔 http://x.y"
    assert one(spark, raw, tx.clean_semantic) == "hi cats"
    assert one(spark, raw, tx.clean_emotion) == "hi 5 cats 😔"
    # a removal can expose nothing new: links are stripped one pattern at a time
    assert one(spark, "wwwhttp://x end", tx.clean_semantic) == "www end"


def test_cleaners_idempotent(spark):
    texts = ["RT @a: Hello!!!!! #Big   day?????", "a\tb", "ÉTAT #x", "😔😔!!"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for fn in (tx.clean_semantic, tx.cap_bang, tx.cap_question, tx.squash_ws):
        once = df.select(fn(F.col("s")).alias("o"))
        twice = once.select(fn(F.col("o")).alias("o"))
        assert once.collect() == twice.collect()


def test_features(spark):
    assert one(spark, "😔😔 y😀", tx.emoji_count) == 2
    assert one(spark, "🇫🇷 ❤", tx.emoji_count) == 0
    assert one(spark, "##a #", tx.hashtag_count) == 3
    assert one(spark, None, tx.hashtag_count) == 0
    assert one(spark, "USA is ÉTAT UN A", tx.uppercase_word_count) == 2
    assert one(spark, "a😔b", tx.tweet_length) == 3
    assert one(spark, "", tx.word_count) == 0
    assert one(spark, "a b  c", tx.word_count) == 3


def test_emotion_features_drops_empty(spark):
    df = spark.createDataFrame([(1, "@only"), (2, None), (3, "OK GO!!!!")], "id long, raw_text string")
    out = {r["id"]: r for r in emotion_features(df, "raw_text").collect()}
    assert set(out) == {3}
    assert out[3]["clean_text"] == "OK GO!!!"
    assert out[3]["exclamation_count"] == 3
    assert out[3]["uppercase_word_count"] == 2


def test_repair_and_audit(spark):
    assert one(spark, "château", repair_encoding) == "château"
    assert one(spark, "☃ “q”", repair_encoding) == "☃ “q”"
    assert one(spark, "â€¦", repair_encoding) == "…"
    df = spark.createDataFrame([("naïve café 😔",)], "s string")
    back = df.select(repair_encoding(to_mojibake(F.col("s"))).alias("o")).collect()[0]["o"]
    assert back == "naïve café 😔"
    assert one(spark, "château", is_encoding_suspect) is True
    assert one(spark, None, is_encoding_suspect) is False


@pytest.mark.parametrize(
    "raw,window",
    [
        ("2009-04-06 22:19:45", "2009-04-06/2009-04-12"),
        ("2024-01-07 23:59:59", "2024-01-01/2024-01-07"),
        ("2024-01-08", "2024-01-08/2024-01-14"),
        ("Mon Apr 06 22:19:45 PDT 2009", "2009-04-06/2009-04-12"),
        ("not a date", None),
    ],
)
def test_time_windows(spark, raw, window):
    assert one(spark, raw, lambda c: time_window(parse_timestamp(c))) == window


def test_timestamp_layouts(spark):
    from eventlens.functions.timewin import parse_timestamp, unparsed_count

    at = "2020-07-25 12:27:21"
    want = {
        "Sat Jul 25 12:27:21 +0000 2020": at, "Sat Jul 25 12:27:21 PDT 2020": at, "2020-07-25T12:27:21Z": at,
        "2020-07-25 12:27:21+00:00": at, "2020-07-25 12:27:21.123": "2020-07-25 12:27:21.123", "2020/07/25": "2020-07-25 00:00:00",
        "07/25/2020": "2020-07-25 00:00:00", "2020-07-25 12:27": "2020-07-25 12:27:00", "Wed Jul 1 12:27:21 PDT 2020": "2020-07-01 12:27:21",
        "2020-07-25T12:27:21.123456789Z": "2020-07-25 12:27:21.123456", "2020-07-25": "2020-07-25 00:00:00", "7/5/2020 9:08": "2020-07-05 09:08:00",
        "no date": None, "2020-13-45": None, "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in want], "s string")
    got = {r.s: r.t for r in df.select("s", parse_timestamp("s").cast("string").alias("t")).collect()}
    assert got == want
    assert df.agg(unparsed_count("s").alias("n")).first().n == 2


def _twice(text, encoding="cp1252"):
    """UTF-8 bytes read back as CP1252, bytes that it lacks as Latin-1."""
    return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) if encoding == "cp1252" else chr(b) for b in text.encode())


MIXED = [
    ("😔 " + _twice("café – “œuvre” 東京 😀") + " привет", "😔 café – “œuvre” 東京 😀 привет"),
    ("ok “" + _twice(_twice("Ünïcode…")) + "” 🚀", "ok “Ünïcode…” 🚀"),
    ("☃ " + _twice(_twice(_twice("é", "latin"), "latin"), "latin"), "☃ é"),
    ("im “Maß“ und „GROẞ“ ☃", "im “Maß“ und „GROẞ“ ☃"),
    ("AMANHÃ” ☃ É» «CAFÉ» 東", "AMANHÃ” ☃ É» «CAFÉ» 東"),
    ("plain ascii", "plain ascii"),
    ("château naïve £5 São Ã", "château naïve £5 São Ã"),
    (_twice("cœur déjà vu"), "cœur déjà vu"),
    ("東 c" + _twice("œ") + "ur " + _twice("Œ") + "uvre " + _twice("привет"), "東 cœur Œuvre привет"),
    ("☃ bad \x00â€ end ð", "☃ bad \x00â€ end ð"),
    ("", ""),
    (None, None),
]


def test_repair_by_runs_to_a_fixed_point(spark):
    from eventlens.functions.encoding import repair_fully

    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(MIXED)], "i int, t string")
    got = {r["i"]: r["t"] for r in df.select("i", repair_fully("t").alias("t")).collect()}
    for i, (given, want) in enumerate(MIXED):
        assert got[i] == want, (given, got[i], want)
    again = df.select("i", repair_fully(repair_fully("t")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in again} == got


def test_repair_decodes_every_character_between_good_ones(spark):
    """Every code point from U+00A0 on, in threes, damaged and set between good text."""
    from eventlens.functions.encoding import repair_fully

    points = [c for c in [*range(0xA0, 0x3000), *range(0x4E00, 0x5000), *range(0xFF00, 0xFFF0), *range(0x1F300, 0x1F700)] if not 0xD800 <= c < 0xE000]
    words = ["".join(map(chr, points[i : i + 3])) for i in range(0, len(points) - 2, 3)]
    df = spark.createDataFrame([(i, "ŋ " + _twice(w) + " ŋ") for i, w in enumerate(words)], "i int, t string")
    bad = [(words[r["i"]], r["t"]) for r in df.select("i", repair_fully("t").alias("t")).collect() if r["t"] != "ŋ " + words[r["i"]] + " ŋ"]
    assert not bad, bad[:5]


def test_a_damaged_text_is_computed_once_for_its_repair(spark):
    from eventlens.functions import encoding as enc

    # the text's expression stood in the plan once for every place that reads it, and was computed as often
    df = spark.createDataFrame([("plain",), ("naïve €",), (None,)], "t string")
    for repair in (enc.repair_encoding, enc.repair_once, enc.repair_fully, enc.repair_runs):
        found = df.select(repair(enc.to_mojibake(enc.to_mojibake(F.col("t")))).alias("r"))
        plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
        assert plan.count("utf-8") == 2, repair.__name__
        assert found.collect()[2]["r"] is None


def test_cleaners_equal_their_steps_one_by_one(spark):
    odd = [None, "", " ", "#", "@", "www", "http", "wwwhttp://x y", "ht@x tp www.a.b@c #Tag", "a\u3000b\x1cc 1\u00a02", "Ünïted 😔😔 🇫🇷 £5,00--x ",
           "  ÉÉ  ", "x http", "httpwww@", "A#htt#p://q", "K \u212a İ ß 🚀!", "123 45", "a@b.c d", "no links, only text."]
    df = spark.createDataFrame([(t,) for t in odd], "t string")

    def steps(keep, collapse):
        x = F.lower("t")
        for p in (tx.P_HTTP, tx.P_WWW, tx.P_AT_ANY):
            x = F.regexp_replace(x, p, "")
        x = F.regexp_replace(F.replace(x, F.lit("#"), F.lit("")), keep, " ")
        return F.trim(F.regexp_replace(x, collapse, " "))

    emotion = f"[^a-zA-Z0-9{tx.WS}{tx._ranges(tx.EMOTION_KEEP_RANGES)}]+"
    out = df.select(tx.clean_semantic("t").alias("a"), steps(tx.P_NOT_LOWER, " +").alias("b"), tx.clean_emotion("t").alias("c"), steps(emotion, tx.P_WS_RUN).alias("d"))
    assert [(r["a"], r["c"]) for r in out.collect()] == [(r["b"], r["d"]) for r in out.collect()]
    for clean in (tx.clean_semantic, tx.clean_emotion):  # lower case is made once, and links are sought where one can be
        plan = df.select(clean("t").alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("(lower(") == 1 and "CASE WHEN" in plan
