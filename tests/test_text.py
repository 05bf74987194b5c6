"""Golden values of text functions and UDFs."""

import difflib

import pytest
from pyspark.sql import functions as F

from namewright.functions import text as T
from namewright.functions import corruption, udfs


@pytest.fixture(scope="module")
def value(spark):
    def run(text, fn):
        return spark.createDataFrame([(text,)], "x string").select(fn(F.col("x")).alias("y")).first()[0]

    return run


def test_normalize_dialects(value):
    assert value(" Ａ  b\tﬁ", lambda c: T.normalize(c, "n0")) == "a b fi"
    assert value("µ−x", lambda c: T.normalize(c, "n1")) == "μ-x"
    assert value("Α-α β", lambda c: T.normalize(c, "n2")) == "α-alpha beta"
    assert value("  A\t\n b ", lambda c: T.normalize(c, "n3")) == "a b"
    assert value("a b", lambda c: T.normalize(c, "n3")) == "a b" and value("a b", lambda c: T.normalize(c, "n0")) == "a b"
    assert value(None, lambda c: T.normalize(c, "n0")) == ""
    with pytest.raises(ValueError):
        T.normalize(F.col("x"), "n9")


@pytest.mark.parametrize(("text", "want"), [("PC(16:0/18:1)", "16:0"), ("PC 34:1; PE 36:2", "34:1|36:2"), ("NA-Gly 17:0", "17:0"), ("none", "")])
def test_lipid_signature_a(value, text, want):
    assert value(text, lambda c: T.lipid_signature_a(F.lower(c))) == want


def test_lipid_signature_b_and_class(value):
    assert tuple(value("na-gly 17:0", T.lipid_signature_b)) == ("gly", "17", "0") and value("none", T.lipid_signature_b) is None
    assert [value(t, T.lipid_class_a) for t in ("n,n-dimethylformamide", "na-gly 17:0", "acetaminophen")] == ["n", "na", ""]


def test_stereo_flag(value):
    assert [value(t, T.stereo_flag) for t in ("n,n-dimethylformamide", "pc(16:0/18:1)", "d glucose", "acetaminophen", "pc 34:1; pe 36:2")] == [True, True, True, False, False]


def test_char3_and_jaccard(value):
    assert [value(t, T.char3) for t in ("", "ab", "abcd")] == [[], ["ab"], ["abc", "bcd"]]
    assert value("", lambda c: T.jaccard(T.char3(c), T.char3(c))) == 0.0 and value("", lambda c: T.jaccard(T.char3(c), T.char3(c), 1.0)) == 1.0


def test_size_buckets(value):
    assert [value(str(n), lambda c: T.size_bucket(c.cast("int"))) for n in (1, 2, 3, 5, 6, 10, 11, 20, 21)] == ["21+", "2", "3-5", "3-5", "6-10", "6-10", "11-20", "11-20", "21+"]


def test_hard_keys(value):
    bins = [value("a" * n, lambda c: T.hard_key(c)["length_bin"]) for n in (4, 5, 12, 20)]
    texts = [value("a" * n, T.hard_key_text) for n in (4, 5, 12, 20)]
    assert bins == [0, 0, 1, 2] and [t.split("_")[1] for t in texts] == ["0", "1", "2", "2"]
    assert value("--", lambda c: T.hard_key(c)["prefix"]) == "<empty>"


def test_variants_and_cids(value):
    got = [(v.method, v.value) for v in value("lactate [m+h]+ *", T.name_variants)]
    assert got[0] == ("exact", "lactate [m+h]+ *") and got[1] == ("strip_instrument_suffix", "lactate +")
    assert value("12.0|nan; 7,12", T.parse_cids) == ["12", "7"] and value(None, T.parse_cids) == []
    assert value("5|3|5", lambda c: T.cid_string(T.parse_cids(c))) == "3|5"


def test_surface_relation(spark):
    rows = [("a b", "a b", "exact_normalized"), ("a-b", "a b", "exact_compact"), ("ab", "abc", "substring"), ("b a x", "x a b", "same_tokens"), ("q", "z", "different"), ("", "z", "different")]
    df = spark.createDataFrame(rows, "q string, t string, want string")
    assert df.filter(T.surface_relation(F.col("q"), F.col("t")) != F.col("want")).count() == 0


def test_bools_and_ranks(value):
    assert [value(t, T.as_bool) for t in ("True", "1", "yes", "no", None)] == [True, True, True, False, False]
    assert [value(t, T.as_rank) for t in ("3", "inf", "nan", "x")] == [3.0, None, None, None]


def test_sequence_ratio(spark):
    pairs = [("acetaminophen", "paracetamol"), ("sodiumchloride", "sodiumchlorid"), ("abcd", "bcde"), ("", "a"), ("a", "a"), ("a" * 100, "b" * 50)]
    got = [r.y for r in spark.createDataFrame(pairs, "a string, b string").select(udfs.sequence_ratio(F.col("a"), F.col("b")).alias("y")).collect()]
    want = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs[:3]] + [0.0, 1.0, 0.5]
    assert got == pytest.approx(want)


def test_corruption_depends_on_the_row_alone(spark):
    df = spark.createDataFrame([(i, f"alpha beta-{i}") for i in range(50)], "id long, t string")
    run = lambda d, level: {r.id: r.y for r in d.select("id", corruption.corrupt(F.col("t"), F.col("id"), level).alias("y")).collect()}
    assert run(df, 0.3) == run(df.repartition(7), 0.3)
    assert run(df, 0.0) == {r.id: r.t for r in df.collect()} and sum(v != f"alpha beta-{k}" for k, v in run(df, 0.3).items()) > 40
    with pytest.raises(ValueError):
        corruption.corrupt(F.col("t"), F.col("id"), 0.1, operations=("shout",))
