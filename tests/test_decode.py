import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftline.functions import decode, lsn, names, values
from driftline.functions.defaults import parse_default, render_default


def run(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r.v for r in df.select("i", f(F.col("s")).alias("v")).orderBy("i").collect()]


CASES = [
    (decode.bool_text, {"t": True, "f": False, None: None}, ["true", "", "T"]),
    (decode.bytea_hex, {"\\xDEADbeef": bytearray(b"\xde\xad\xbe\xef"), "\\x": bytearray(), None: None}, ["DEAD", "\\xABC", "\\xZZ"]),
    (decode.date_text, {"2026-02-28": dt.date(2026, 2, 28), "0001-01-01": dt.date(1, 1, 1), None: None}, ["infinity", "2026-02-30", "2026-2-3", "0044-03-15 BC"]),
    (decode.time_micros, {"00:00:00": 0, "12:30:01.5": 45001500000, "23:59:59.123456789": 86399123456, None: None}, ["24:00:00", "1:2:3", "12:30"]),
    (decode.timestamp_text, {"2026-01-01 12:30:00.123456789": dt.datetime(2026, 1, 1, 12, 30, 0, 123456), None: None}, ["2026-01-01", "infinity", "2026-13-01 00:00:00"]),
    (lambda s, strict=True: F.unix_seconds(decode.timestamptz_text(s, strict)), {"1970-01-01 05:30:00+05:30": 0, "1970-01-01 00:00:00-01": 3600, "1970-01-01 00:00:10+00:00:10": 0, "1970-01-01 00:00:00+0130": -5400, None: None}, ["1970-01-01 00:00:00+16", "1970-01-01 00:00:00", "1970-01-01 00:00:00+05:60"]),
    (decode.timetz_text, {"12:30:00+05:30": "12:30:00+05:30", "12:30:00.500-0330": "12:30:00.5-03:30", "01:02:03+00:00:07": "01:02:03+00:00:07", "01:02:03-08:00": "01:02:03-08", None: None}, ["12:30:00", "25:00:00+00", "12:30:00+16"]),
    (decode.numeric_canonical, {"0.000": "0.000", "-0.00": "0.00", ".5": "0.5", "1_000": "1000", "+007.10": "7.10", "1e3": "1000", "1.25e1": "12.5", "12e-3": "0.012", "-1e-2": "-0.01", "NaN": "NaN", "-inf": "-Infinity", "1" * 60: "1" * 60, "5.": "5", None: None}, ["", "1__0", "_1", "1e", "-NaN", "abc", "."]),
]


@pytest.mark.parametrize("f,good,bad", CASES, ids=range(len(CASES)))
def test_scalars(spark, f, good, bad):
    assert run(spark, f, list(good)) == list(good.values())
    assert run(spark, lambda s: f(s, strict=False), bad) == [None] * len(bad)
    for text in bad:
        with pytest.raises(PySparkException):
            run(spark, f, [text])


@pytest.mark.parametrize(
    "text,want",
    [("{}", []), ("{1,2}", ["1", "2"]), ('{a,"null",NULL,null}', ["a", "null", None, None]), ("[0:1]={7,8}", ["7", "8"]), (r'{"a\"b","c\\d",e\,f}', ['a"b', r"c\d", "e,f"]), ('{"",x}', ["", "x"]), ('{"a,b","{c}"}', ["a,b", "{c}"])],
)
def test_arrays(spark, text, want):
    assert decode.parse_array(text) == want
    assert run(spark, decode.array_text, [text, None]) == [want, None]


@pytest.mark.parametrize("text", ["{{1}}", "{1", "1,2", '{"a}', "{a,}", "{,a}", '{"a"b}', "[0:1]{1}"])
def test_bad_arrays(spark, text):
    with pytest.raises(ValueError):
        decode.parse_array(text)
    with pytest.raises(PySparkException):
        run(spark, decode.array_text, [text])


def escaped(text):
    out = text.replace("\\", "\\\\")
    for a, b in decode.COPY_ESCAPES.items():
        out = out.replace(b, "\\" + a)
    return out


def test_copy_round_trip(spark):
    texts = ["", "plain", "tab\there", "nl\nx", "\\", "\\\\", "\\N", "\\t", "\\\\t\t", "é\r\b\f\v", "a\\b\\\nc"]
    assert run(spark, decode.copy_unescape, [escaped(t) for t in texts] + ["\\N", "\\x", "\\\\N"]) == [*texts, None, "x", "\\N"]
    assert run(spark, lambda s: decode.copy_unescape(decode.copy_escape(s)), [*texts, None]) == [*texts, None]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab\\\t\n\r\b\f\vNnt{}\",é")), max_size=12), min_size=1, max_size=20))
def test_copy_round_trip_of_any_text(spark, texts):
    assert run(spark, decode.copy_unescape, [escaped(t) for t in texts]) == texts


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list('ab\\",{} NULé')), max_size=8)), max_size=6))
def test_array_round_trip(items):
    literal = "{" + ",".join("NULL" if x is None else '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"' for x in items) + "}"
    assert decode.parse_array(literal) == items


def test_copy_lines(spark):
    from driftline.sources.copy_text import decode_copy

    lines = spark.createDataFrame([("t\t\\N\t12\t{1,NULL}",), ("f\ta\\tb\t-3\t{}",)], "value string")
    out = decode_copy(lines, [("a", "bool"), ("b", "text"), ("c", "int8"), ("d", "int4[]")], with_bytes=True).collect()
    assert [tuple(r) for r in out] == [(True, None, 12, [1, None], 17), (False, "a\tb", -3, [], 13)]
    marked = spark.createDataFrame([("\\\\N\t\\N",), ("\\N\t\\\\",), ("\\N\t\\N",), ("N\tx",)], "value string")
    assert [tuple(r) for r in decode_copy(marked, [("a", "text"), ("b", "text")]).collect()] == [("\\N", None), (None, "\\"), (None, None), ("N", "x")]
    with pytest.raises(PySparkException):
        decode_copy(lines, [("a", "bool")]).collect()
    assert decode_copy(lines.limit(0), [("a", "bool")]).count() == 0


def test_sequence_keys_sort_as_numbers(spark):
    n = [0, 1, 255, 2**32, 2**63 - 1, 2**63, 2**64 - 1]
    df = spark.createDataFrame([(str(a), str(b)) for a in n for b in n], "a string, b string").select(F.col("a").cast(lsn.LSN).alias("a"), F.col("b").cast(lsn.LSN).alias("b"))
    out = df.withColumn("key", lsn.sequence_key(F.col("a"), F.col("b")))
    a, b = lsn.parse_sequence_key(F.col("key"))
    rows = out.withColumns({"a2": a, "b2": b}).collect()
    assert sorted((int(r.a), int(r.b)) for r in rows) == [(int(r.a), int(r.b)) for r in sorted(rows, key=lambda r: r.key)]
    assert all((r.a, r.b) == (r.a2, r.b2) and len(r.key) == 33 for r in rows)
    assert run(spark, lambda s: lsn.parse_sequence_key(s)[0], ["0/0", "A" * 16 + "/" + "0" * 16]) == [None, None]
    assert run(spark, lambda s: lsn.lsn_text(s.cast(lsn.LSN)), ["0", "18446744073709551615", "4294967297"]) == ["0/0", "FFFFFFFF/FFFFFFFF", "1/1"]
    assert [int(x) for x in run(spark, lsn.parse_lsn, ["16/B374D848", "0/0"])] == [0x16B374D848, 0]


def test_names(spark):
    df = spark.createDataFrame([("a_b", "c"), ("a", "b_c"), ("_a", "b"), ("a", ""), ("public", "t")], "s string, t string")
    assert [r.v for r in df.select(names.destination_name(F.col("s"), F.col("t")).alias("v")).collect()] == ["a__b_c", "a_b__c", None, None, "public_t"]
    assert run(spark, names.namespace, ["AWS x", "My-Schema"]) == ["s_aws_x", "my_schema"]
    assert names.unique_name("cdc", {"cdc", "cdc_1"}) == "cdc_2"
    assert run(spark, names.size_bytes, ["500MB", "10 kb", "7", "1TB"]) == [500_000_000, 10_000, None, 10**12]
    assert run(spark, names.server_version, ["16.4", "14.1.2 (x)", "abc"]) == [160400, 140102, None]
    assert run(spark, lambda s: names.parse_slot(s)[1], [names.slot_name(3, 9), names.slot_name(3)]) == [9, None]
    assert run(spark, names.wal_status, ["lost", "new"]) == ["lost", "unknown"]
    assert run(spark, names.error_class, ["08006", "53300", "28P01", "42601"]) == ["unavailable", "unavailable", "authentication", "other"]


def test_values(spark):
    assert run(spark, values.json_integers_fit, ['{"a": 18446744073709551615}', '{"a": 18446744073709551616}', '{"a": "99999999999999999999"}', "1.5e40"]) == [True, False, True, True]
    with pytest.raises(PySparkException):
        run(spark, lambda s: values.date32_days(s.cast("date")), ["1899-12-31"])
    assert run(spark, lambda s: values.has_null_element(F.split(s, ",")), ["a,b"]) == [False]


@pytest.mark.parametrize(
    "expression,kind,want",
    [("'it''s'", "text", "it's"), ("'a'::character varying(5)", "text", "a"), ("((1.5))::numeric(4,2)", "numeric", "1.5"), ("'x'::text", "int4", None), ("ARRAY[1]", "int4", None), ("(select 1)", "int4", None), ("'2020-1-1'", "date", None), ("false", "bool", "false"), ("false", "text", None), (None, "text", None), ("'a::b'", "text", "a::b"), ("('a') || ('b')", "text", None)],
)
def test_defaults(expression, kind, want):
    assert parse_default(expression, kind) == want


def test_rendered_defaults():
    assert render_default("it's", "text") == "'it''s'" and render_default("1", "int4") == "1" and render_default("2020-01-01", "date") == "DATE '2020-01-01'"


@pytest.mark.parametrize("f", [decode.timetz_text, decode.timestamptz_text, decode.time_micros])
def test_one_pattern_decides_on_a_zoned_text(spark, f):
    """Patterns for each part ran again wherever an expression named a part."""
    plan = spark.createDataFrame([], "s string").select(f(F.col("s")).alias("v"))._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("rlike") <= 1 and "regexp" not in plan


def test_a_line_break_is_no_part_of_a_time(spark):
    for f, text in ((decode.time_micros, "12:30:00"), (decode.timetz_text, "12:30:00+05"), (decode.timestamptz_text, "2026-01-01 12:30:00+05")):
        assert [x is None for x in run(spark, lambda s, f=f: f(s, False), [text, text + "\n"])] == [False, True]
    assert run(spark, decode.timetz_text, ["00:00:00-00:30", "10:20:30.000-00", "10:00:00.120300+0530", "01:02:03-153015"]) == ["00:00:00-00:30", "10:20:30+00", "10:00:00.1203+05:30", "01:02:03-15:30:15"]
