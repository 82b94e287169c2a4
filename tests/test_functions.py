"""Scalars at their edges."""

import math

from pyspark.sql import functions as F

from stepwright.functions import arrays as A
from stepwright.functions import labels as L
from stepwright.functions import sampling as S
from stepwright.functions import text as X


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_normalise(spark):
    assert values(spark, X.normalise_tag(F.col("x")), [" Hip-Hop! ", None, "", "\tA  b\n", "é?"]) == ["hip-hop", "", "", "a b", ""]
    assert values(spark, X.normalise_caption(F.col("x"), True), ['"A  Song."', None, "..."]) == ["a song", "", ""]


def test_json(spark):
    assert values(spark, X.parse_json_list(F.col("x")), ['[" a ", "", null, 1]', "[", "{}", "", None, "[[1]]"]) == [["a", "1"], [], [], [], [], ["[1]"]]
    assert values(spark, X.extract_json_object(F.col("x")), ['```json\n{"a": 1}\n```', 'so {"b": 2}.', "none", None]) == ['{"a": 1}', '{"b": 2}', None, None]


def test_tokens(spark):
    assert values(spark, X.tokens(F.col("x")), ["Lo-fi rock'n roll", None, "--"]) == [["lo-fi", "rock'n", "roll"], [], []]
    assert values(spark, X.content_tokens(F.col("x")), ["the cat with an umbrella"]) == [["cat", "umbrella"]]
    assert values(spark, X.phrases(F.col("x")), ["Soft piano, 'warm' pads and strings with air"]) == [["soft piano", "warm' pads", "strings", "air"]]
    assert values(spark, X.clip(F.col("x"), 7), ["one two three", "onetwothree", "short", None]) == ["one", "onetwot", "short", ""]


def test_keys(spark):
    assert values(spark, L.time_key(F.col("x")), [10.0, 0.0, 1.25, 0.1234], "x double") == ["10", "0", "1.25", "0.123"]
    stem = values(spark, L.file_stem(F.col("x")), ["a/b c", "", "x" * 200])
    assert stem[0].startswith("a_b_c__") and stem[1].startswith("__") and stem[2].startswith("x" * 80 + "__")
    assert values(spark, L.tempo_label(F.col("x")), ["89.9", "90", "140", "141", "?", None]) == ["slow", "medium", "medium", "fast", "", ""]
    assert values(spark, L.abbreviated(F.col("x")), [999, 1000, 244250, 1_250_000], "x int") == ["999", "1.0k", "244.2k", "1.2M"]


def test_labels(spark):
    assert values(spark, L.genre(F.split("x", ",")), ["trap,synth", "Piano Solo", "", "unheard"]) == ["Hip-hop", "Classical", "Other", "Other"]
    assert values(spark, L.hallucination(F.col("x")), ["Thank you!", "love you", "we love you", "", None, "bye"]) == ["exact_phrase", "short_suffix", None, None, None, "exact_phrase"]
    assert values(spark, L.coerce_label(F.col("x"), ["Agree", "Disagree"]), ["agree", "Agree.", "dis", "", None, "zzz"]) == ["Agree", "Agree", "Disagree", None, None, None]
    assert values(spark, L.style_error(F.col("x"), F.lit("short")), ["Please keep it", "a b c d e f g h", "Keep it"]) == ["non_imperative_request_frame", "too_wordy_8_words", None]


def test_sets(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"]), ([], [])], "s array<string>, t array<string>")
    s, t = F.col("s"), F.col("t")
    got = df.select(A.added(s, t), A.removed(s, t), A.preserved(s, t), A.delta_size(s, t), A.recall(s, t), A.precision(s, t)).collect()
    assert [tuple(r) for r in got] == [(["c"], ["a"], ["b"], 2, 0.5, 0.5), (["a"], [], [], 1, 0.0, 0.0), ([], [], [], 0, 0.0, 0.0)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    got = df.select(A.unit(F.col("v")), A.dot(F.col("v"), F.col("v"))).collect()
    assert got[0][0] == [0.6, 0.8] and got[1][0] == [0.0, 0.0] and got[2][0] is None
    assert [r[1] for r in got] == [25.0, 0.0, 0.0]


def test_draws_are_uniform_and_repeatable(spark):
    df = spark.range(20_000).select(S.uniform(13, F.col("id")).alias("u"))
    m, s, lo, hi = df.agg(F.avg("u"), F.stddev_pop("u"), F.min("u"), F.max("u")).first()
    assert abs(m - 0.5) < 0.01 and abs(s - 1 / math.sqrt(12)) < 0.01 and lo >= 0 and hi < 1
    assert df.repartition(7).agg(F.round(F.sum("u"), 6)).first() == df.agg(F.round(F.sum("u"), 6)).first()
