"""Golden edge cases (invented rows), one or more per operator rule."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from corpuspulse.functions import scores as SC
from corpuspulse.functions import text as T
from corpuspulse.operators import clusters as C
from corpuspulse.operators import filters as FL
from corpuspulse.operators import reports as R
from corpuspulse.operators import scans as SCN
from corpuspulse.operators import scoring as SCO
from corpuspulse.operators import topics as TP
from corpuspulse.operators import voting as V
from corpuspulse.sources import headlines as H
from corpuspulse.sources.keywords import keywords_from_text, read_keywords
from corpuspulse.sources.pages import Rule, extract_headlines, extract_tag_text
from corpuspulse.sources.repair import repair_csv


def _write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding="utf-8", newline="") as f:
        f.write(text)


# ---------------------------------------------------------------- S1, S2, S6

def test_read_headlines_rules(spark, tmp_root):
    d = os.path.join(tmp_root, "heads1")
    _write(d, "headlines_alpha_beta .txt",
           "2023-09-07 10:00:00 - a - b\n\n- - x\n2023-09-08 - \"quoted\" start\nno separator here\n")
    _write(d, "desktop.ini", "[x]\nnot - data\n")
    rows = H.read_headlines(spark, d, mode="compat").collect()
    got = [(r.paper, r.date_raw, r.headline) for r in rows]
    assert ("alpha beta ", "2023-09-07 10:00:00", "a - b") in got
    assert ("alpha beta ", "-", "x") in got
    assert ("alpha beta ", "2023-09-08", '"quoted" start') in got
    assert ("alpha beta ", "no separator here", None) in got
    assert len(got) == 4  # blank line and the .ini file skipped
    fixed = {r.paper for r in H.read_headlines(spark, d).collect()}
    assert fixed == {"alpha beta"}
    # the incomplete line is dropped by F4
    assert FL.drop_incomplete(H.read_headlines(spark, d), ["paper", "date_raw", "headline"]).count() == 3


def test_paper_from_file_name(spark):
    df = spark.createDataFrame([("headlines_a_b%20.txt",), ("headlines_focus_politik .txt",)], "f string")
    r = df.select(H.paper_from_file_name("f", "compat").alias("c"), H.paper_from_file_name("f").alias("x")).collect()
    assert [(x.c, x.x) for x in r] == [("a b ", "a b"), ("focus politik ", "focus politik")]


def test_write_read_roundtrip(spark, tmp_root):
    src = spark.createDataFrame([("p1", "2023-09-07", "one - two"), ("p2", "-", "three")],
                                "paper string, date_raw string, headline string")
    path = os.path.join(tmp_root, "rt")
    H.write_headlines(src, path, paper_col="paper")
    back = H.read_written_headlines(spark, path).select("paper", "date_raw", "headline")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, src.collect()))


# ---------------------------------------------------------------- S4

def test_keywords_modes(spark, tmp_root):
    d = os.path.join(tmp_root, "kw")
    _write(d, "topic_a.txt", "x, y,\r\nz\r\n")
    compat = read_keywords(spark, d, mode="compat").orderBy("pos").collect()
    fixed = read_keywords(spark, d).orderBy("pos").collect()
    assert [(r.topic, r.pos, r.keyword) for r in compat] == [("topic_a", 0, "x"), ("topic_a", 1, "y,"), ("topic_a", 2, "z")]
    assert [(r.pos, r.keyword) for r in fixed] == [(0, "x"), (1, "y"), (2, "z")]


def test_keywords_from_text_skips_empty(spark):
    df = spark.createDataFrame([("t", "a, b\n\n, c,")], "topic string, text string")
    assert [r.keyword for r in keywords_from_text(df).orderBy("pos").collect()] == ["a", "b", "c"]


# ---------------------------------------------------------------- S7

def test_repair_csv(spark):
    df = spark.createDataFrame([
        (1, '2023-09-07,"a, ""b"" c",p1,0.1', None, None, None),
        (2, "2023-09-07", "plain", "p2", "0.2"),
        (3, "2023-09-07,no paper,here", None, None, None),
    ], "row_id int, date string, headline string, paper string, score string")
    fixed, quarantine = repair_csv(df, ["p1", "p2"], extra=("score",))
    got = {r.row_id: (r.date, r.headline, r.paper, r.score) for r in fixed.collect()}
    assert got[1] == ("2023-09-07", 'a, "b" c', "p1", "0.1")
    assert got[2] == ("2023-09-07", "plain", "p2", "0.2")
    assert [r.row_id for r in quarantine.collect()] == [3]


# ---------------------------------------------------------------- P1

@pytest.mark.parametrize("raw,expected", [
    ("2023-09-07 10:11:12", dt.datetime(2023, 9, 7, 10, 11, 12)),
    ("2023-09-07", dt.datetime(2023, 9, 7)),
    ("26. März 2024, 13.45 Uhr", dt.datetime(2024, 3, 26, 13, 45)),
    ("7. September 2023, 9.05 Uhr", dt.datetime(2023, 9, 7, 9, 5)),
    ("07. Oktober 2023", dt.datetime(2023, 10, 7)),
    ("07. Oktober 2023, 18:30 Uhr", dt.datetime(2023, 10, 7, 18, 30)),
    ("Aktualisiert am 01.10.2023", dt.datetime(2023, 10, 1)),
    ("Aktualisiert am 01.10.2023 - 12:00 Uhr", dt.datetime(2023, 10, 1)),
    ("01.10.2023 - x", dt.datetime(2023, 10, 1)),
    ("-", None),
    ("22023-09-23 00:00:00", None),
    ("7. Septober 2023", None),
    ("31.02.2023", None),
])
def test_parse_event_time(spark, raw, expected):
    r = spark.createDataFrame([(raw,)], "s string").select(T.parse_event_time("s").alias("t")).first()
    assert r.t == expected


def test_decode_obfuscated(spark):
    import base64
    enc = base64.b64encode("07. Oktober 2023, 18:30 Uhr".encode()).decode()
    r = spark.createDataFrame([(enc,), ("@@not base64@@",)], "s string").select(
        T.parse_event_time(T.decode_obfuscated("s")).alias("t")).collect()
    assert r[0].t == dt.datetime(2023, 10, 7, 18, 30) and r[1].t is None


# ---------------------------------------------------------------- P2-P5

def test_clean_de(spark):
    df = spark.createDataFrame([("ALLES GROSS",), ("2023",), ("A-B Straße",), ("DER Hund und die Katze",)], "s string")
    r = [x.c for x in df.select(T.clean_de("s", ["der", "und", "die"]).alias("c")).collect()]
    assert r == [None, "", "A B Straße", "Hund Katze"]


def test_clean_en(spark):
    df = spark.createDataFrame([("Don't stop, don't STOP über!",)], "s string")
    assert df.select(T.clean_en("s").alias("c")).first().c == "dont stop dont stop ber"
    assert df.select(T.clean_en("s", ["stop"]).alias("c")).first().c == "dont dont ber"
    assert df.select(T.clean_en("s", [], {"dont": "do"}).alias("c")).first().c == "do stop do stop ber"


def test_drop_shouting_predicate(spark):
    df = spark.createDataFrame([("ABC",), ("123",), ("AbC",), ("ÄÖÜ!",)], "s string")
    assert [r.s for r in df.where(~T.is_shouting("s")).collect()] == ["123", "AbC"]


# ---------------------------------------------------------------- P6, P7, P15

def test_compose_and_fallback(spark):
    df = spark.createDataFrame([("Top", "Head"), (None, "Head"), ("Top", None), ("", "Head")], "a string, b string")
    assert [r.c for r in df.select(SC.compose("a", "b").alias("c")).collect()] == ["Top: Head", "Head", None, "Head"]
    assert [r.c for r in df.select(SC.first_non_null("b", "a").alias("c")).collect()] == ["Head", "Head", "Top", "Head"]


def test_text_after(spark):
    df = spark.createDataFrame([("Ausgabe vom 12. Mai 2023",), ("no marker",), ("a vom b vom c",)], "s string")
    assert [r.x for r in df.select(T.text_after("s").alias("x")).collect()] == ["12. Mai 2023", None, None]


# ---------------------------------------------------------------- P8, J3

def _kw(spark, rows):
    return spark.createDataFrame(rows, "topic string, pos int, keyword string")


@pytest.mark.parametrize("strategy", ["array", "grams"])
def test_match_first_phrase_wins(spark, strategy):
    texts = spark.createDataFrame([(1, "tax rise and more tax"), (2, "only rent here")], "doc_id int, text string")
    kw = _kw(spark, [("money", 0, "rent"), ("money", 1, "tax"), ("other", 0, "zzz")])
    got = TP.match_topics(texts, kw, strategy=strategy).collect()
    assert sorted((r.doc_id, r.topic, r.pos, r.keyword) for r in got) == [(1, "money", 1, "tax"), (2, "money", 0, "rent")]


def test_segment_cases(spark):
    texts = spark.createDataFrame([
        (1, "tax rise now"), (2, "new tax"), (3, "big tax cut tax again"), (4, "tax"),
        (5, "rent and tax"), (6, "no hit")], "doc_id int, text string")
    kw = _kw(spark, [("t", 0, "tax"), ("t", 1, "rent")])
    fixed = {r.doc_id: (r.left, r.target, r.right) for r in TP.tag_segments(texts, kw).collect()}
    assert fixed[1] == ("", "tax", "tax rise now".split("tax")[1].strip())
    assert fixed[2] == ("new", "tax", "")
    assert fixed[3] == ("big", "tax", "cut")
    assert 4 not in fixed                  # text equals the phrase: no row, no retry
    assert fixed[5] == ("rent and", "tax", "")  # lower pos wins even if later in text
    assert 6 not in fixed
    compat = {r.doc_id: (r.left, r.target, r.right) for r in TP.tag_segments(texts, kw, mode="compat").collect()}
    assert compat[2] == ("", "new", "tax")
    hits = TP.match_topics(texts, kw)
    joined = {r.doc_id: (r.left, r.target, r.right) for r in TP.segment(texts, hits).collect()}
    assert joined == fixed


def test_lower_pos_failure_skips_topic(spark):
    texts = spark.createDataFrame([(1, "tax")], "doc_id int, text string")
    kw = _kw(spark, [("t", 0, "tax"), ("t", 1, "ta")])
    assert TP.tag_segments(texts, kw).count() == 0


def test_whole_word_mode(spark):
    texts = spark.createDataFrame([(1, "the taxi driver"), (2, "a tax rise")], "doc_id int, text string")
    kw = _kw(spark, [("t", 0, "tax")])
    assert [r.doc_id for r in TP.match_topics(texts, kw).collect()] in ([1, 2], [2, 1])
    assert [r.doc_id for r in TP.match_topics(texts, kw, whole_word=True).collect()] == [2]


# ---------------------------------------------------------------- P9, P11

def test_label_score(spark):
    df = spark.createDataFrame([("positive", 0.8), ("neutral", 0.8), ("negative", 0.8), ("odd", 0.8)], "l string, p double")
    assert [r.s for r in df.select(SC.label_score("l", "p").alias("s")).collect()] == [0.8, 0.0, -0.8, -0.8]


def test_paragraphs(spark):
    text = "First para. Second sen-tence\n\n12\n\nThird 3 \nfourth\n\n \n\n42 . "
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = [(r.pos, r.paragraph) for r in T.paragraphs(df).orderBy("pos").collect()]
    assert got == [(0, "First para"), (1, "Second sentence"), (2, "Third "), (3, "fourth")]


# ---------------------------------------------------------------- F1, F6, F7

def test_in_date_range(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 9, 7),), (dt.datetime(2023, 10, 7),),
                                (dt.datetime(2023, 10, 7, 10),), (dt.datetime(2023, 9, 6, 23, 59),)], "event_ts timestamp")
    assert FL.in_date_range(df, "2023-09-07", "2023-10-07").count() == 2
    assert FL.in_date_range(df, "2023-09-07", "2023-10-07", end_of_day=True).count() == 3


def test_sign_agree(spark):
    df = spark.createDataFrame([(1.0, 2.0), (-1.0, -2.0), (1.0, -1.0), (0.0, 0.0), (None, 1.0)], "a double, b double")
    got = [r.x for r in df.select(SC.sign_agree("a", "b").alias("x")).collect()]
    assert got == [True, True, False, False, False]
    sym = [r.x for r in df.select(SC.sign_agree("b", "a").alias("x")).collect()]
    assert got == sym


def test_no_topic_scored(spark):
    texts = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    scores = spark.createDataFrame([(1, "t", 0.5), (1, "whole", 0.1), (2, "whole", 0.3), (3, "t", None)],
                                   "doc_id int, topic string, score double")
    assert sorted(r.doc_id for r in FL.no_topic_scored(texts, scores).collect()) == [2, 3]


# ---------------------------------------------------------------- A6/A7, A9, A11

def _scores(spark, rows):
    return spark.createDataFrame(rows, "paper string, topic string, score double")


def test_avg_pos_none_is_null(spark):
    df = _scores(spark, [("p", "t", -1.0)])
    r = df.agg(SC.avg_pos("score").alias("a"), SC.avg_neg("score").alias("n")).first()
    assert r.a is None and r.n == -1.0


def test_report_margins(spark):
    rows = [("p1", "t", 1.0), ("p1", "t", 1.0), ("p1", "t", 1.0), ("p2", "t", -1.0),
            ("p1", "whole", 0.5), ("p2", "whole", 0.1)]
    rep = {(r.paper, r.topic): r.value for r in R.paper_topic_report(_scores(spark, rows), "avg").collect()}
    assert rep[("total", "t")] == 0.0              # mean of means (pooled mean would be 0.5)
    assert rep[("p1", "total (topic only)")] == 1.0  # whole left out
    assert rep[("total", "total (topic only)")] == 0.0
    assert ("total", "whole") in rep
    cnt = {(r.paper, r.topic): r.value for r in R.paper_topic_report(_scores(spark, rows), "count_pos").collect()}
    assert cnt[("total", "t")] == 3.0 and cnt[("total", "total (topic only)")] == 3.0


def test_day_total_ignores_null(spark):
    by_day = spark.createDataFrame([(dt.date(2023, 9, 7), "a", 1.0), (dt.date(2023, 9, 7), "b", None),
                                    (dt.date(2023, 9, 7), "whole", 0.0)], "day date, topic string, value double")
    assert R.day_total(by_day).first().value == 0.5


# ---------------------------------------------------------------- A12

def test_programme_scores_zero_fill(spark):
    # B has no hit: a row without a topic only names the party.
    par = spark.createDataFrame([("A", "t1", 0.5), ("A", "t1", -0.1), ("B", None, 0.0)], "party string, topic string, score double")
    topics = spark.createDataFrame([("t1",), ("t2",), ("t2",)], "topic string")
    got = {(r.party, r.topic): round(r.score, 6) for r in SCO.programme_scores(par, topics).collect()}
    assert got == {("A", "t1"): 0.2, ("A", "t2"): 0.0, ("B", "t1"): 0.0, ("B", "t2"): 0.0}


# ---------------------------------------------------------------- A14-A19, J6

def test_voting_zero_and_null(spark):
    scores = spark.createDataFrame([("p1", "econ", 0.5), ("p1", "econ", -0.5), ("p2", "econ", 0.0)],
                                   "paper string, topic string, score double")
    parties = spark.createDataFrame([("A", "econ", 1.0), ("B", "econ", 0.0)], "party string, topic string, score double")
    pred = {r.party: r for r in V.voting_prediction(scores, parties).collect()}
    assert pred["B"].topic_votes == 0 and pred["B"].pct == 0.0
    assert pred["A"].topic_votes == 1 and pred["A"].pct == 100.0
    byp = {(r.paper, r.party): r for r in V.voting_by_paper(scores, parties).collect()}
    assert byp[("p2", "A")].pct is None          # paper with no votes -> NULL share
    assert byp[("total", "A")].total_votes == 1
    rowwise = {(r.party, r.topic): r.votes for r in V.match_votes_rowwise(scores, parties).collect()}
    agg = {(r.party, r.topic): r.votes for r in V.match_votes(scores, parties).collect()}
    assert rowwise == agg


def test_party_mentions_alias_and_compat(spark):
    scores = spark.createDataFrame([("p", "CDU", 0.5), ("p", "CDU", -0.5), ("p", "Greens", 0.2)],
                                   "paper string, topic string, score double")
    parties = spark.createDataFrame([("CDU", "x", 1.0), ("Grüne", "x", 1.0)], "party string, topic string, score double")
    compat = {r.party: r.party_mentions for r in V.party_mentions(scores, parties).collect()}
    assert compat == {"CDU": 1, "Grüne": 0}
    alias = spark.createDataFrame([("Grüne", "Greens")], "party string, topic string")
    fixed = {r.party: r.party_mentions for r in V.party_mentions(scores, parties, alias).collect()}
    assert fixed == {"CDU": 0, "Grüne": 1}


# The election outcome in percent and the mention-count baseline of
# the source study, as published (party, value), in their original order.
ACTUAL_OUTCOME = [("CDU", 37.0), ("Grüne", 14.4), ("FW", 15.8), ("AfD", 14.6), ("SPD", 8.4), ("FDP", 3.0),
                  ("Linke", 1.5)]
MENTION_COUNTS = [("SPD", 458), ("CDU", 256), ("AfD", 236), ("Linke", 16), ("FW", 65), ("Grüne", 197),
                  ("FDP", 150)]


def test_mention_baseline_mae(spark):
    """The mention-count baseline gives MAE 9.3138 when parties are aligned by name."""
    counts = spark.createDataFrame(MENTION_COUNTS, "party string, count long")
    actual = spark.createDataFrame(ACTUAL_OUTCOME, "party string, pct double")
    r = V.mention_share(counts, actual).collect()
    assert len(r) == 7
    assert round(r[0].mae, 4) == 9.3138
    assert abs(sum(x.pct for x in r) - 100.0) < 1e-9


def test_compare_actual_alias(spark):
    pred = spark.createDataFrame([("CSU", 40.0), ("SPD", 10.0)], "party string, pct double")
    actual = spark.createDataFrame([("SPD", 8.0), ("CDU", 37.0)], "party string, pct double")
    alias = spark.createDataFrame([("CSU", "CDU")], "party string, actual_party string")
    assert round(V.prediction_mae(pred, actual, alias).first().mae, 6) == 2.5


# ---------------------------------------------------------------- W1, W2/A22, W4

def test_dedup_first_smallest_paper(spark):
    df = spark.createDataFrame([("h", "zeit", "2023-09-08"), ("h", "bild", "2023-09-09"), ("h", "bild", "2023-09-07"),
                                ("g", "x", None)], "headline string, paper string, date_raw string")
    for fn in (R.dedup_first, R.dedup_first_salted):
        got = sorted(map(tuple, fn(df).collect()), key=lambda r: r[0])
        assert got == [("g", "x", None), ("h", "bild", "2023-09-07")]


def test_cluster_keywords_ties(spark):
    df = spark.createDataFrame([(0, "b a c"), (0, "a b d"), (1, "x")], "cluster_label int, headline string")
    got = {r.cluster_label: r.top_words for r in C.cluster_keywords(df).collect()}
    assert got == {0: "a b c d", 1: "x"}


def test_carry_forward(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5), (1, 3, None), (2, 1, None)], "p int, i int, v int")
    got = {(r.p, r.i): r.v for r in SCN.carry_forward(df, "v", ["p"], ["i"]).collect()}
    assert got == {(1, 1): None, (1, 2): 5, (1, 3): 5, (2, 1): None}


# ---------------------------------------------------------------- J5, M3, M4, M7

def test_reassign_by_cluster(spark):
    scores = spark.createDataFrame([(1, "t", 0.4), (1, "whole", 0.9), (2, "whole", -0.3), (3, "whole", 0.2)],
                                   "doc_id int, topic string, score double")
    named = spark.createDataFrame([(1, "Econ"), (2, "econ"), (3, "other")], "doc_id int, name string")
    ct = spark.createDataFrame([("ECON", ["a", "b"])], "name string, topics array<string>")
    got = sorted(map(tuple, C.reassign_by_cluster(scores, named, ct).collect()))
    assert got == sorted([(1, "t", 0.4), (1, "whole", 0.9), (2, "whole", -0.3), (3, "whole", 0.2),
                          (2, "a", -0.3), (2, "b", -0.3)])


def test_assign_nearest_is_nearest(spark):
    vecs = spark.createDataFrame([(1, [0.0, 0.0]), (2, [10.0, 10.0]), (3, [5.0, 5.0])], "vec_id int, embedding array<float>")
    cents = spark.createDataFrame([(7, [1.0, 1.0]), (3, [9.0, 9.0])], "cluster_label int, center array<double>")
    got = {r.vec_id: (r.cluster_label, r.sqdist) for r in C.assign_nearest(vecs, cents).collect()}
    assert got[1] == (7, 2.0) and got[2] == (3, 2.0)
    assert got[3] == (3, 32.0)  # tie -> smaller label


def test_silhouette_matches_brute_force(spark):
    pts = [(1, [0.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [5.0, 5.0], 1), (4, [6.0, 5.0], 1), (5, [5.0, 7.0], 1)]
    df = spark.createDataFrame(pts, "vec_id int, embedding array<float>, cluster_label int")
    got = C.silhouette(df).first().silhouette

    def d(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))
    s = []
    for i, x, l in pts:
        own = [d(x, y) for j, y, m in pts if m == l and j != i]
        a = sum(own) / len(own)
        b = min(sum(d(x, y) for j, y, m in pts if m == o) / sum(1 for *_, m in pts if m == o)
                for o in {m for *_, m in pts} - {l})
        s.append((b - a) / max(a, b))
    assert abs(got - sum(s) / len(s)) < 1e-9


def test_lexicon_compound_bounds(spark):
    texts = spark.createDataFrame([(1, ""), (2, "good good good good good"), (3, "not good"), (4, "very good")],
                                  "doc_id int, text string")
    lex = spark.createDataFrame([("good", 1.9)], "token string, valence double")
    got = {r.doc_id: r.compound for r in SCO.lexicon_compound(
        texts, lex, boosters=[("very", 0.293)], negators=["not"]).collect()}
    assert got[1] == 0.0
    assert all(-1.0 <= v <= 1.0 for v in got.values())
    assert got[3] < 0 < got[4]
    assert got[4] > SCO.lexicon_compound(texts.where("doc_id = 4").withColumn("text", F.lit("good")), lex)\
        .first().compound


def test_lexicon_rows_with_repeated_and_null_ids(spark):
    texts = spark.createDataFrame([(1, "good"), (1, "bad"), (None, "good"), (2, None)], "doc_id int, text string")
    lex = spark.createDataFrame([("good", 1.0), ("bad", -2.0), (None, 9.0)], "token string, valence double")
    got = sorted((str(r.doc_id), round(r.compound, 4)) for r in SCO.lexicon_compound(texts, lex).collect())
    assert got == [("1", -0.4588), ("1", 0.25), ("2", 0.0), ("None", 0.25)]


def test_lexicon_join_is_the_same_without_broadcast(spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"w{i} w{i + 1} not w{i + 2}") for i in range(30)], "doc_id int, text string")
    lex = spark.createDataFrame([(f"w{i}", (i - 10) / 4) for i in range(25)], "token string, valence double")
    rows = lambda: sorted((r.doc_id, round(r.compound, 9)) for r in SCO.lexicon_compound(texts, lex, negators=["not"]).collect())
    small = rows()
    monkeypatch.setattr(SCO, "broadcast_if_small", lambda df: df.hint("merge"))
    assert rows() == small


# ---------------------------------------------------------------- S8

def test_extract_rules(spark):
    html1 = ("<html><body><article aria-label='First'><span data-auxiliary>26. März 2024, 13.45 Uhr</span></article>"
             "<article aria-label='Second'></article></body></html>")
    html2 = ("<div class='sec'><span class='ch'>Inland</span><h2 class='hl'>Kept &amp; fine</h2></div>"
             "<div class='sec'><span class='ch'>Sport</span><h2 class='hl'>Dropped</h2></div>")
    html3 = ("<a class='t'>A</a><a class='hit-link-button'>skip</a><span class='priceButton'>1</span>"
             "<a class='t'>B</a><span class='priceButton'>2</span><a class='t'>C</a><span class='priceButton'>3</span>"
             "<span class='priceButton'>4</span>")
    html4 = ("<div class='big'><a class='l'>Big one</a><span class='d'>Mi, 11.10.2023</span></div>"
             "<div class='small'><a class='l'>Small one</a></div>")
    pages = spark.createDataFrame([(1, "https://s.example/a", html1), (2, "https://b.example/x", html2),
                                   (3, "https://f.example/y", html3), (4, "https://z.example/2023-10-11", html4)],
                                  "page_id long, url string, html string")
    rules = [
        Rule(site="s.example", record="article[aria-label]", headline="@aria-label", date="span[data-auxiliary]"),
        Rule(site="b.example", record="div.sec", headline="h2.hl", section="span.ch", allowed=("Inland", "News")),
        Rule(site="f.example", record="span.priceButton", headline="", stride=2, prev="a",
             prev_skip_class="hit-link-button", date="const:-"),
    ]
    out = extract_headlines(pages, rules).orderBy("page_id", "pos").collect()
    got = [(r.page_id, r.headline, r.event_ts) for r in out]
    assert got[0] == (1, "First", dt.datetime(2024, 3, 26, 13, 45))
    assert got[1] == (1, "Second", None)
    assert (2, "Kept & fine", None) in got and all(h != "Dropped" for _, h, _ in got)
    assert [h for p, h, _ in got if p == 3] == ["A", "C"]


def test_extract_tag_text(spark):
    pages = spark.createDataFrame([(1, "<article class='x'>\n<h1>Tom &amp; Jerry</h1><p>t</p></article>")],
                                  "page_id long, html string")
    assert extract_tag_text(pages).first().headline == "Tom & Jerry"


def test_extract_more_rules(spark):
    import base64
    focus = ("<div class='box-hd-title'>Ausgabe vom 12.10.2023</div><div class='h'>Politik</div>"
             "<table><tr><td><a href='1'><b>One</b> more</a><a href='x'>no bold</a></td></tr></table>"
             "<div class='h'>Sport</div><table><tr><td><a href='2'><b>Late</b></a></td></tr></table>")
    enc = base64.b64encode("11. Oktober 2023, 08:15 Uhr".encode()).decode()
    zeit = (f"<section><a class='large'>Big<span class='encoded-date' data-obfuscated='{enc}'></span></a>"
            "<a class='small'>Small</a></section>")
    ntv = ("<article><span class='teaser__date'>\n10.10.2023 12:00</span><span class='teaser__headline'>N1</span></article>")
    sz = "<span data-manual='teaser-title'>S1</span><span data-manual='teaser-title'>S2</span><time datetime='2023-10-01'></time><time datetime='2023-10-02'></time>"
    tag = "<div class='w'><span class='topline'>Top</span><span class='hl'>Main</span></div><div class='w'><span class='hl'>Solo</span></div>"
    pages = spark.createDataFrame([(1, "https://focus.example/1", focus), (2, "https://zeit.example/2", zeit),
                                   (3, "https://ntv.example/3", ntv), (4, "https://sz.example/4", sz),
                                   (5, "https://ts.example/x?filter=inland", tag), (6, "https://ts.example/x?filter=sport", tag)],
                                  "page_id long, url string, html string")
    rules = [
        Rule(site="focus", record="a", record_has="b", headline="text", start_at="div.h", stop_at="div.h",
             date="div.box-hd-title", date_scope="page", date_after="vom"),
        Rule(site="zeit", record="a", headline="text", date="span.encoded-date@data-obfuscated", date_b64=True,
             carry_date=True),
        Rule(site="ntv", record="article", headline="span.teaser__headline", date="span.teaser__date",
             date_regex=r"(\d{2}\.\d{2}\.\d{4})"),
        Rule(site="sz", record="span[data-manual=teaser-title]", headline="text", date="@datetime", date_zip="time"),
        Rule(site=r"ts\.example.*filter=inland", record="div.w", headline="span.hl", topline="span.topline"),
    ]
    out = extract_headlines(pages, rules).orderBy("page_id", "pos").collect()
    got = [(r.page_id, r.headline, r.event_ts) for r in out]
    assert got[0] == (1, "One more", dt.datetime(2023, 10, 12))
    assert [g for g in got if g[0] == 1] == [got[0]]          # no bold -> skipped; after the stop -> skipped
    assert (2, "Big", dt.datetime(2023, 10, 11, 8, 15)) in got
    assert (2, "Small", dt.datetime(2023, 10, 11, 8, 15)) in got   # carried forward
    assert (3, "N1", dt.datetime(2023, 10, 10)) in got
    assert (4, "S1", dt.datetime(2023, 10, 1)) in got and (4, "S2", dt.datetime(2023, 10, 2)) in got
    assert (5, "Top: Main", None) in got and (5, "Solo", None) in got
    assert all(g[0] != 6 for g in got)


def test_drop_shouting_and_row_ids(spark):
    df = spark.createDataFrame([("ABC",), ("Abc",), (None,)], "headline string")
    assert FL.drop_shouting(df).count() == 2
    u = R.union_all(df, df, id_col="row_id")
    assert u.select("row_id").distinct().count() == 6


def test_cluster_keywords_first_seen(spark):
    df = spark.createDataFrame([(0, 1, "z y"), (0, 2, "y z x")], "cluster_label int, pos int, headline string")
    got = C.cluster_keywords(df, first_seen_by="pos").first().top_words
    assert got == "z y x"   # z and y tie (2 each): z seen first


def test_topic_by_day_raw(spark):
    df = spark.createDataFrame([("2023-09-07 10:00:00", "t", 1.0), ("-", "t", -1.0), ("-", "t", 0.0)],
                               "date_raw string, topic string, score double")
    got = {r.day: r.value for r in R.topic_by_day(df, grain="raw").collect()}
    assert got == {"2023-09-07 10:00:00": 1.0, "-": -0.5}


def test_headline_file_stream_dedup(spark, tmp_root):
    from corpuspulse.streaming import jobs as J
    d = os.path.join(tmp_root, "stream_in")
    _write(d, "headlines_p_one.txt", "2023-09-07 10:00:00 - Same\n2023-09-07 11:00:00 - Other\n")
    _write(d, "headlines_p_two.txt", "2023-09-07 10:30:00 - Same\n")
    s = J.headline_file_stream(spark, d).where(F.col("headline").isNotNull())
    first = J.dedup_parts(order=("paper", "date_raw"))
    rows = first(J.run_available_now(s, "test-dedup", first)).collect()
    assert sorted((r.headline, r.paper) for r in rows) == [("Other", "p one"), ("Same", "p one")]


@pytest.mark.parametrize("table", ["events", "documents"])
def test_streams_equal_batch_on_a_folder_newest_first(spark, tmp_root, table):
    import __spark_entry__ as E
    d = os.path.join(tmp_root, f"folder_{table}")
    df = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")
    key = {"events": "ts", "documents": "doc_id"}[table]
    for k, part in enumerate(df.orderBy(F.desc(key)).randomSplit([1.0] * 4, seed=3)):
        part.coalesce(1).write.mode("append").parquet(f"{d}/{table}.parquet")
    q, batch = {"events": ("stream_topic_by_day", "topic_by_day"), "documents": ("stream_dedup_headlines", "dedup_first")}[table]
    got = E.queries()[q](spark, d)
    rows = lambda x: sorted(map(str, x.select(*got.columns).collect()))
    assert rows(got) == rows(E.queries()[batch](spark, d)) and got.count() > 0


def test_stream_of_an_empty_source(spark, tmp_root):
    from corpuspulse.streaming import jobs as J
    d = os.path.join(tmp_root, "empty_stream")
    spark.createDataFrame([], "paper string, headline string, doc_id long").coalesce(1).write.parquet(f"{d}/t.parquet")
    first = J.dedup_parts()
    assert first(J.run_available_now(J.file_stream(spark, d, "t"), "empty", first)).count() == 0


def test_voting_by_paper_dense(spark):
    scores = spark.createDataFrame([("p1", "a", 1.0), ("p2", "b", 1.0)], "paper string, topic string, score double")
    parties = spark.createDataFrame([("A", "a", 1.0), ("B", "b", 1.0)], "party string, topic string, score double")
    got = {(r.paper, r.party): (r.total_votes, r.pct) for r in V.voting_by_paper(scores, parties).collect()}
    assert got[("p1", "B")] == (0, 0.0) and got[("p2", "A")] == (0, 0.0)
    assert got[("p1", "A")] == (1, 100.0) and got[("total", "A")] == (1, 50.0)
    assert len(got) == 6


def test_top_k_words_and_share(spark):
    counts = spark.createDataFrame([(0, "a", 3), (0, "b", 3), (0, "c", 1), (1, "x", 2)],
                                   "cluster_label int, word string, n long")
    got = sorted((r.cluster_label, r.word, r.rank) for r in R.top_k_words(counts, 2).collect())
    assert got == [(0, "a", 1), (0, "b", 2), (1, "x", 1)]
    sh = {r.word: r.pct for r in R.share_of_total(counts, "n", by=["cluster_label"]).collect()}
    assert sh["a"] == 42.86 and sh["x"] == 100.0


def test_report_dense_cells(spark):
    rows = [("p1", "a", 1.0), ("p2", "b", -1.0)]
    cnt = {(r.paper, r.topic): r.value for r in R.paper_topic_report(_scores(spark, rows), "count_pos").collect()}
    assert cnt[("p2", "a")] == 0.0 and cnt[("p1", "b")] == 0.0
    avg = {(r.paper, r.topic): r.value for r in R.paper_topic_report(_scores(spark, rows), "avg").collect()}
    assert avg[("p2", "a")] is None and avg[("total", "a")] == 1.0
    sparse = R.paper_topic_report(_scores(spark, rows), "count_pos", dense=False).collect()
    assert ("p2", "a") not in {(r.paper, r.topic) for r in sparse}


def test_assign_nearest_in_blocks(spark, monkeypatch):
    vecs = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(40)] + [(40, None), (41, [1.0])],
                                 "vec_id int, embedding array<float>")
    cents = spark.createDataFrame([(2, [0.0, 0.0, 1.0]), (1, [4.0, 2.0, 1.0]), (3, [2.0, 1.0, 1.0]), (4, [2.0, 1.0, 1.0])],
                                  "cluster_label int, center array<double>")
    rows = lambda: {r.vec_id: (r.cluster_label, r.sqdist) for r in C.assign_nearest(vecs, cents).collect()}
    one = rows()
    monkeypatch.setattr(C, "CENTER_BLOCK", 3)
    assert rows() == one
    assert one[40] == one[41] == (None, None) and one[7] == (3, 0.0)  # tie with label 4


def test_silhouette_of_identical_points(spark, monkeypatch):
    v = spark.createDataFrame([(i, i % 2, [1.0, 2.0]) for i in range(6)], "vec_id int, cluster_label int, embedding array<double>")
    assert C.silhouette(v).first().silhouette == 0.0
    w = spark.createDataFrame([(i, i % 4, [float(i % 4), float(i % 7)]) for i in range(40)],
                              "vec_id int, cluster_label int, embedding array<double>")
    one = C.silhouette(w).first().silhouette
    monkeypatch.setattr(C, "CENTER_BLOCK", 2)
    assert abs(C.silhouette(w).first().silhouette - one) < 1e-12


def test_gram_join_equals_in_plan_form(spark):
    texts = spark.createDataFrame([(1, "tax rise and rent"), (1, "only rent"), (None, "a tax"), (3, None), (4, "")], "doc_id int, text string")
    kw = _kw(spark, [("money", 0, "rent"), ("money", 1, "tax"), ("other", 0, "rise"), ("other", 1, "a"), ("more", 0, "e and r")])
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(TP.match_topics(texts, kw, in_plan=0)) == rows(TP.match_topics(texts, kw))
    assert rows(TP.tag_segments(texts, kw, in_plan=0)) == rows(TP.tag_segments(texts, kw))


def test_dense_reports_keep_null_groups(spark):
    s = spark.createDataFrame([("p", "a", 1.0), ("p", None, 2.0), ("q", "a", 3.0)], "paper string, topic string, score double")
    dense = {(r.paper, r.topic): r.value for r in R.paper_topic_report(s, "avg").collect()}
    sparse = {(r.paper, r.topic): r.value for r in R.paper_topic_report(s, "avg", dense=False).collect()}
    assert set(sparse) <= set(dense) and dense[("p", None)] == 2.0 and dense[("q", None)] is None
    assert dense[("total", None)] == sparse[("total", None)] == 2.0


def test_reports_scan_once_and_run_nothing_when_built(spark, tmp_root):
    path = os.path.join(tmp_root, "scores_once")
    spark.createDataFrame([("p", "a", 1.0), ("q", "b", -3.0)], "paper string, topic string, score double").write.parquet(path)
    s = spark.read.parquet(path)
    spark.sparkContext.setJobGroup("build", "build")
    r = R.paper_topic_report(s, "avg")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("build")
    spark.sparkContext.setJobGroup("run", "run")
    r.collect()
    final = r._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1


def test_with_source_and_union_sources(spark):
    a = spark.createDataFrame([("headlines_x_y.txt", "h1")], "_file string, headline string")
    b = spark.createDataFrame([("h2", "-")], "headline string, date_raw string")
    u = H.union_sources(H.with_source(a).drop("_file"), b)
    rows = {r.headline: r for r in u.collect()}
    assert rows["h1"].paper == "x y" and rows["h2"].paper is None and rows["h2"].date_raw == "-"
    assert len({r.headline_id for r in rows.values()}) == 2


def test_mae_order_independent(spark):
    pred = spark.createDataFrame([("A", 10.0), ("B", 90.0)], "party string, pct double")
    actual1 = spark.createDataFrame([("A", 20.0), ("B", 80.0)], "party string, pct double")
    actual2 = spark.createDataFrame([("B", 80.0), ("A", 20.0)], "party string, pct double")
    assert V.prediction_mae(pred, actual1).first().mae == V.prediction_mae(pred.orderBy(F.desc("party")), actual2).first().mae == 10.0


def test_voting_alias_only_party_and_unmatched_paper(spark):
    scores = spark.createDataFrame([("p1", "a", 1.0), ("p2", "zz", 1.0)], "paper string, topic string, score double")
    parties = spark.createDataFrame([("A", "a", 1.0)], "party string, topic string, score double")
    alias = spark.createDataFrame([("A", "a"), ("Z", "zz")], "party string, topic string")
    pred = {r.party: r for r in V.voting_prediction(scores, parties, alias).collect()}
    assert set(pred) == {"A"} and pred["A"].topic_votes == 1 and pred["A"].party_mentions == 1
    byp = {(r.paper, r.party): (r.total_votes, r.pct) for r in V.voting_by_paper(scores, parties, alias).collect()}
    assert byp[("p2", "A")] == (0, None)          # paper meets no party topic: present, no share
    assert all(p != "Z" for _, p in byp)


def test_stop_and_lemma_tables(spark):
    stop = spark.createDataFrame([("the",), ("a",), ("the",)], "word string")
    lem = spark.createDataFrame([("cars", "car"), ("ran", "run")], "word string, lemma string")
    df = spark.createDataFrame([("The cars ran a race",)], "s string")
    out = df.select(T.clean_en("s", T.word_list(stop), T.lemma_table(lem)).alias("c")).first().c
    assert out == "car run race"


def test_score_headlines_with_translation_hook(spark):
    def _dictionary_translator():
        """A deterministic stand-in for a caller's translation model (built once per worker).

        Defined inside the test so that it is shipped to the workers by value."""
        words = {"steuer": "tax", "gut": "good", "schlecht": "bad"}

        def run(pdf):
            import pandas as pd
            col = pdf.columns[0]
            return pd.DataFrame({"_en": pdf[col].map(lambda s: " ".join(words.get(w, w) for w in (s or "").split()))})
        return run

    heads = spark.createDataFrame([(1, "p", "gut steuer heute"), (2, "p", "schlecht")],
                                  "doc_id int, paper string, headline string")
    kw = _kw(spark, [("economy", 0, "tax")])
    lex = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "token string, valence double")
    out = {(r.doc_id, r.topic): r.score for r in SCO.score_headlines(
        heads, kw, lex, translate=_dictionary_translator).collect()}
    assert out[(1, "economy")] > 0          # "good tax today": positive context around "tax"
    assert out[(2, "whole")] < 0 and (2, "economy") not in out


def test_batch_infer_factories_do_not_collide(spark):
    df = spark.createDataFrame([("a",), ("bb",)], "headline string")

    def make(mult):
        return lambda: (lambda pdf: __import__("pandas").DataFrame({"v": pdf["headline"].str.len() * mult}))
    one = {r.headline: r.v for r in SCO.batch_infer(df, ["headline"], make(1), "v long").collect()}
    ten = {r.headline: r.v for r in SCO.batch_infer(df, ["headline"], make(10), "v long").collect()}
    assert one == {"a": 1, "bb": 2} and ten == {"a": 10, "bb": 20}


def test_lexicon_duplicates_take_their_mean(spark):
    texts = spark.createDataFrame([(1, "good day")], "doc_id int, text string")
    lex = spark.createDataFrame([("good", 1.0), ("good", 3.0)], "token string, valence double")
    assert abs(SCO.lexicon_compound(texts, lex).first().compound - 2.0 / (4.0 + 15.0) ** 0.5) < 1e-12


def test_text_after_literal_marker(spark):
    df = spark.createDataFrame([("a (x) b",), ("a.b.c",)], "s string")
    got = [r.x for r in df.select(T.text_after("s", "(x)").alias("x")).collect()]
    assert got == ["b", None]
    assert df.select(T.text_after("s", ".").alias("x")).collect()[1].x is None   # three parts


# ---------------------------------------------------------------- S8: markup of real pages

def test_page_text_forms_agree(spark):
    from corpuspulse.sources.pages import Rule, extract_headlines, extract_tag_text
    page = ("<html><body><article><h1>Gr&uuml;ne f&#252;r M&auml;rz &ndash; x</h1></article>"
            "<ARTICLE class=a>\n <H1 id=h>a <b>b</b><br>c&ampd</H1></ARTICLE><article><h1></h1></article></body></html>")
    pages = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", "")], "page_id long, url string, html string")
    want = [(1, "Grüne für März – x"), (1, "a b c&d")]
    jvm = sorted((r.page_id, r.headline) for r in extract_tag_text(pages).collect() if r.headline)
    rule = Rule(site="", record="article", headline="h1", date="const:-")
    parser = sorted((r.page_id, r.headline) for r in extract_headlines(pages, [rule]).collect() if r.headline)
    assert jvm == want and parser == want


def test_page_with_many_open_tags(spark):
    from corpuspulse.sources.pages import Rule, extract_page
    deep = "<ul>" + "<li>x" * 3000 + "<article><h1>found</h1>"
    assert [r[1] for r in extract_page(Rule(site="", record="article", headline="h1"), "u", deep)] == ["found"]


def test_carry_window_only_for_rules_that_carry(spark):
    from corpuspulse.sources.pages import Rule, extract_headlines
    pages = spark.createDataFrame([(1, "u", "<article><h1>a</h1></article>")], "page_id long, url string, html string")
    plan = lambda carry: extract_headlines(pages, [Rule(site="", record="article", headline="h1", date="const:-", carry_date=carry)])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan(True) and "Window" not in plan(False)


def test_shipped_lexicon_explodes_nothing_and_equals_the_join(spark, monkeypatch):
    texts = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 13}" if j % 3 else ("very", "not", "so")[(i + j) % 3] for j in range(i % 9 + 1))) for i in range(60)]
                                  + [(1, None), (None, ""), (None, "w1 not  w2\tvery w3")], "doc_id int, text string").repartition(3)
    lex = spark.createDataFrame([(f"w{i}", (i - 6) / 4) for i in range(12)] + [("w12", None), ("w3", 2.0), (None, 1.0)], "token string, valence double")
    out = lambda: SCO.lexicon_compound(texts, lex, boosters=[("very", 0.293), ("so", -0.2)], negators=["not"])
    rows = lambda df: sorted((str(r.doc_id), round(r.compound, 9)) for r in df.collect())
    plan = out()._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "hashpartitioning" not in plan
    small = rows(out())
    monkeypatch.setattr(SCO, "SHIPPED_TOKENS", 3)
    assert rows(out()) == small and len(small) == 63


def test_whole_word_phrases_sift_inside_the_row(spark):
    texts = spark.createDataFrame([(1, "the red car is in the car park"), (2, "redcar"), (3, None), (1, "RED car")], "doc_id int, text string")
    kw = spark.createDataFrame([("a", 0, "red car"), ("a", 1, "car"), ("b", 0, "the"), ("c", 0, "car park is")], "topic string, pos int, keyword string")
    out = TP.match_topics(texts, kw, whole_word=True)
    assert "filter(" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, "a", 0, "red car"), (1, "b", 0, "the")]


def test_large_text_tables_come_in_parts(spark, tmp_root, monkeypatch):
    from corpuspulse.plans import standins as S
    spark.range(1000).selectExpr("id AS doc_id", "'x' AS text").coalesce(1).write.mode("overwrite").parquet(f"{tmp_root}/parts/documents.parquet")
    monkeypatch.setattr("corpuspulse.session.SPREAD_BYTES_PER_CORE", 10)
    monkeypatch.setattr("corpuspulse.session.PART_BYTES", 100)
    df = S.text_table(spark, f"{tmp_root}/parts", "documents")
    assert df.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism and df.count() == 1000


def test_batch_infer_gives_the_model_bounded_pieces(spark):
    def make():
        def run(pdf):
            import pandas as pd
            return pd.DataFrame({"rows": [len(pdf)] * len(pdf), "chars": [int(pdf["headline"].fillna("").str.len().sum())] * len(pdf)})
        return run
    text = [None if i % 50 == 0 else "ab " * (i % 700) for i in range(4000)] + ["z" * 3_000_000]
    df = spark.createDataFrame(list(enumerate(text)), "doc_id long, headline string").coalesce(1)
    out = SCO.batch_infer(df, ["headline"], make, "rows long, chars long").collect()
    assert {r.doc_id: r.headline for r in out} == dict(enumerate(text)) and len(out) == len(text)
    assert max(r.rows for r in out) <= 1001 and max(r.chars for r in out if r.doc_id < 4000) <= 1_100_000
