import re
import string

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from defectflow.functions import rules, templates as tpl, text as tx
from defectflow.functions.stemming import porter_stem, stem_tokens

GOLDEN = [
    ("Pump P-1234 leak at flange", "pump  leak at flange"),
    ("Valve V-5678 stuck", "valve  stuck"),
    ("Tank T-9012 corrosion", "tank  corrosion"),
    ("ubolt missing", "ubolt missing"),
    ("thick scaling with severe corrosion", "thick scaling with severe corrosion"),
    ("", ""),
    ("   ", ""),
    ("P-1234 V-5678", ""),
    ("P-1234 V-5678 T-9012", ""),
    (None, ""),
    ("PUMP SEAL LEAK", "pump seal leak"),
    ("pressure reading 150 psi at valve X-123", "pressure reading 150 psi at valve x123"),
    ("pump leak! (urgent) - check seal.", "pump leak urgent  check seal"),
    ("V-1234 and T-9012 and P-5678", "and  and"),
    ("line 12AB34567 x", "line 7 x"),
    ("ESDV12345 failed", "es5 failed"),
    ("tag 1P2203 4 leak", "tag  4 leak"),
    ("2V1201 leak", "leak"),
    ("to be repaired/ replaced", "to be repaired replaced"),
    (" \tleak\x1f ", "leak"),
    ("éa-1234 x", "éa1234 x"),
    ("a-١٢٣٤ x", "x"),
]


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


def test_serving_cleaner_golden(spark):
    rows = [(i, t) for i, (t, _) in enumerate(GOLDEN)]
    out = spark.createDataFrame(rows, "i int, t string").select("i", tx.clean_serving(F.col("t")).alias("c"))
    assert [r.c for r in out.orderBy("i").collect()] == [w for _, w in GOLDEN]


def test_serving_cleaner_options(spark):
    t = F.col("t")
    assert one(spark, "Valve V-5678 stuck", tx.clean_serving(t, collapse_ws=True).alias("c")).c == "valve stuck"
    assert one(spark, None, tx.clean_serving(t, null_token="None").alias("c")).c == "none"


def test_long_text_is_cleaned_whole(spark):
    long = "pipe support corrosion " * 5000 + "P-1234 end"
    assert one(spark, long, tx.clean_serving(F.col("t")).alias("c")).c == "pipe support corrosion " * 5000 + " end"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abcz AB-12390 .\t(", max_size=40), min_size=1, max_size=20))
def test_serving_cleaner_follows_the_rules(spark, texts):
    def expected(text):
        text = text.lower()
        for pattern in tx.EQUIPMENT_CODE_PATTERNS:
            text = re.sub(pattern, "", text, flags=re.IGNORECASE)
        return "".join(c for c in text if c not in string.punctuation).strip()

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", tx.clean_serving(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r.c for r in out] == [expected(t) for t in texts]


def test_training_cleaner(spark):
    t = tx.clean_training(F.col("t")).alias("c")
    assert one(spark, "Pump P-1234 leak observed at flange V-5678", t).c == "Pump leak observed at flange"
    assert one(spark, " p-1234 Stays,  lower ", t).c == "p-1234 Stays, lower"


def test_words_and_tokens(spark):
    t = F.col("t")
    row = one(spark, " a  b\tc ", tx.words(t).alias("w"), tx.word_count(t).alias("n"),
              tx.truncate_pad(tx.words(t), 2).alias("cut"), tx.truncate_pad(tx.words(t), 5).alias("pad"),
              tx.is_truncated(tx.words(t), 2).alias("over"))
    assert (row.w, row.n, row.cut, row.over) == (["a", "b", "c"], 3, ["a", "b"], True)
    assert row.pad == ["a", "b", "c", "<pad>", "<pad>"]
    assert one(spark, None, tx.word_count(t).alias("n")).n == 0


def test_stopwords(spark):
    t = tx.remove_stopwords(F.col("t")).alias("c")
    assert one(spark, "The pump is leaking oil from the seal area", t).c == "pump leaking oil seal area"
    assert one(spark, "Don't open the pump's cover.", t).c == "n't open pump 's cover ."
    assert tx.ENGLISH_STOPWORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_ngrams_and_shorten(spark):
    t = F.col("t")
    row = one(spark, "inspect the pump seal", tx.ngrams(tx.words(t), 2).alias("g"), tx.shorten(t, 7).alias("s"),
              tx.ngrams(tx.words(t), 9).alias("none"))
    assert row.g == ["inspect the", "the pump", "pump seal"] and row.s == "inspect..." and row.none == []


def test_templates_are_exact(spark):
    a, b, c, d = (F.lit(x) for x in ("2", "pump leak", "to fix", "Topic"))
    row = spark.range(1).select(
        tpl.classifier_text(a, b, c).alias("x"), tpl.summary_prompt(d, b, a, c).alias("y"),
        tpl.seq2seq_input(d, b).alias("z"), tpl.seq2seq_target(b).alias("w"),
        tpl.classifier_text(F.lit(None), b, c).alias("n")).first()
    assert row.x == "Priority: 2. Description: pump leak. Initial Rec: to fix. "
    assert row.y == "[TOPIC: Topic] Finding: pump leak | Priority: 2 | New recommendation: to fix | "
    assert row.z == "Topic: Topic. Description: pump leak. Generate maintenance recommendation:"
    assert row.w == "Actions: pump leak"
    assert row.n.startswith("Priority: . ")


@pytest.mark.parametrize("topic,text,first,count", [
    ("Pump/Mechanical Failures", "Seal LEAK and vibration", "Isolate pump", 4),
    ("Pump/Mechanical Failures", "vibration", "Check alignment", 4),
    ("Pump/Mechanical Failures", "noise", "Inspect pump", 3),
    ("Valve Operations", "seized", "Apply penetrating oil", 4),
    ("Valve Operations", "leak", "Inspect valve", 4),
    ("Leakage/Corrosion", "", "Isolate affected area", 5),
    ("Electrical/Instrumentation", "x", "Verify power supply", 5),
    ("Piping/Structural", "x", "Inspect pipe support condition", 4),
    ("Operational Issues", "x", "Review operating parameters", 4),
    ("Preventive Maintenance", "x", "Follow scheduled inspection", 4),
    ("Unknown Cluster (9)", "leak", "Inspect equipment", 4),
    (None, "leak", "Inspect equipment", 4),
])
def test_action_rules(spark, topic, text, first, count):
    row = spark.createDataFrame([(topic, text)], "p string, t string").select(
        rules.action_sequence(F.col("p"), F.col("t")).alias("a"), rules.default_workflow(F.col("p"), F.col("t")).alias("d")).first()
    assert (row.a[0], len(row.a)) == (first, count)
    assert row.d[0] == ("Inspect equipment" if text == "" else first)


def test_topic_tags(spark):
    out = spark.createDataFrame([(0,), (6,), (8,)], "c int").select(rules.topic_tag(F.col("c"), rules.RULE_TOPICS).alias("t"))
    assert [r.t for r in out.collect()] == ["Pump/Mechanical Failures", "Preventive Maintenance", "Unknown Cluster (8)"]


def test_steps_round_trip_and_mismatch(spark):
    text = "[STEPS:2] Actions: 1. Isolate pump 2. Pressure test at 3.5 bar"
    row = one(spark, text, rules.parse_steps(F.col("t")).alias("p")).p
    assert row.consistent and [(s.step, s.action) for s in row.steps] == [(1, "Isolate pump"), (2, "Pressure test at 3.5 bar")]
    row = one(spark, "[STEPS:3] Actions: 1. a 2. b", rules.parse_steps(F.col("t")).alias("p")).p
    assert not row.consistent and row.declared == 3 and len(row.steps) == 2
    for odd in (None, "", "nothing here"):
        row = one(spark, odd, rules.parse_steps(F.col("t")).alias("p")).p
        assert not row.consistent and row.steps == []
    joined = spark.range(1).select(rules.split_actions(rules.join_actions(F.array(F.lit("a"), F.lit("b")))).alias("s")).first().s
    assert joined == ["a", "b"]


def test_stemmer(spark):
    # Examples of the published algorithm.
    known = dict(
        caresses="caress", ponies="poni", cats="cat", feed="feed", agreed="agre", plastered="plaster", motoring="motor",
        sing="sing", conflated="conflat", troubled="troubl", sized="size", hopping="hop", falling="fall", hissing="hiss",
        filing="file", happy="happi", sky="sky", relational="relat", conditional="condit", digitizer="digit",
        operator="oper", feudalism="feudal", hopefulness="hope", formalize="formal", electrical="electr",
        goodness="good", revival="reviv", adjustment="adjust", adoption="adopt", activate="activ", probate="probat",
        rate="rate", cease="ceas", controll="control", roll="roll", inspecting="inspect", corrosion="corros")
    assert {w: porter_stem(w) for w in known} == known
    scorers = dict(
        dies="die", flies="fli", skies="sky", sky="sky", tied="tie", cried="cri", dying="die", news="news", innings="inning",
        enjoy="enjoy", happy="happi", spy="spi", by="by", say="say", nobly="nobli", possibly="possibl", hopefully="hope",
        geologi="geolog", geology="geolog", logi="logi", formalli="formal", radically="radic", exceed="exceed", agreed="agre",
        feed="feed", oiling="oil", hissing="hiss", fizzed="fizz", using="use", ated="ate", controlling="control", generalizations="gener",
    )
    assert {w: porter_stem(w, extended=True) for w in scorers} == scorers
    df = spark.createDataFrame([(["leaking", "oil"],), ([],), (None,)], "t array<string>")
    assert [r.s for r in df.select(stem_tokens(F.col("t")).alias("s")).collect()] == [["leak", "oil"], [], None]
