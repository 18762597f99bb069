"""Row contracts, paths, digests and names."""

import hashlib
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from plumbline.functions import compare, hashing, numeric, paths
from plumbline.operators import validate

SAMPLE = "sample_id string, source_id string, upstream_path string, local_path string, label int, content_sha256 string, provenance_group string, generator_family string, content_type string, upstream_sha256 string"
GOOD = ("s1", "src", "a/b.png", "c/d.png", 1, "0" * 64, "g", "flux", "mixed", None)


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(r,) for r in rows], f"v {kind}")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def broken(spark, **changes):
    row = dict(zip([c.split()[0] for c in SAMPLE.split(", ")], GOOD, strict=True)) | changes
    df = spark.createDataFrame([tuple(row.values())], SAMPLE)
    return {r["rule"] for r in validate.broken_rules(df, F.col("sample_id"), validate.sample_rules()).collect()}


def test_sample_contract(spark):
    assert broken(spark) == set()
    assert broken(spark, label=0, generator_family=None) == set()
    for changes in ({"sample_id": " s1"}, {"sample_id": None}, {"source_id": ""}, {"local_path": "/abs"}, {"upstream_path": "a/../b"}, {"upstream_path": None}, {"label": 2}, {"label": None}, {"content_sha256": "A" * 64}, {"content_sha256": "0" * 64 + "\n"}, {"upstream_sha256": "0"}, {"generator_family": None}, {"generator_family": "x "}):
        assert broken(spark, **changes) == set(changes)


def test_paths(spark):
    assert values(spark, paths.unsafe_path, ["a/b", ".", "", "/a", "a//b", "a/./b", "..", "a\\b", "a/", None]) == [False, False, True, True, True, True, True, True, True, True]
    assert values(spark, paths.untrimmed, ["a", "a b", "", " a", "a ", "\x0ca", None]) == [False, False, True, True, True, True, True]
    assert values(spark, paths.stored_suffix, ["a/b.AVIF", "b.jpeg", "b.bmp", "b", "a.png/b", "a/.png", "b.x.webp"]) == [".avif", ".jpeg", ".img", ".img", ".img", ".img", ".webp"]
    assert values(spark, paths.safe_segment, ["a b-c_1.x", " ..a/ä\\b. ", None]) == ["a b-c_1.x", "a_b", None]
    for bad in ("", "..", " . "):
        with pytest.raises(Exception, match="unsafe path segment"):
            values(spark, paths.safe_segment, [bad])
    assert values(spark, paths.immutable_revision, ["0" * 40, "a" * 64, "A" * 40, "0" * 41, "main", None]) == [True, True, False, False, False, False]


def test_entry_path(spark):
    df = spark.createDataFrame([("food/1_fake/f x/a.PNG", "1_fake", "food", "f/x"), ("food/0_real/a", "0_real", "foo:d", None)], "f string, l string, c string, g string")
    found = [r[0] for r in df.select(paths.entry_path(F.col("f"), F.col("l"), F.col("c"), F.col("g"), "s")).collect()]
    digest = [hashlib.sha256(f"s\0{n}".encode()).hexdigest() for n in ("food/1_fake/f x/a.PNG", "food/0_real/a")]
    assert found == [f"ai/food/f_x/{digest[0]}.png", f"real/foo_d/{digest[1]}.img"]


def test_quoting(spark):
    odd = "a b/ü~*+&=%.png"
    assert values(spark, lambda c: paths.percent_quoted(c, True), [odd]) == [quote(odd, safe="/")]
    assert values(spark, lambda c: paths.percent_quoted(c, False), [odd]) == [quote(odd, safe="")]


def test_generators(spark):
    df = spark.createDataFrame([("a/1_fake/g/x", "1_fake"), ("a/1_fake/x", "1_fake"), ("a/1_fake//x", "1_fake"), ("a/0_real/g/x", "1_fake"), ("a/1_fake/g/x", "0_real")], "f string, l string")
    assert [r[0] for r in df.select(paths.generator_of(F.col("f"), F.col("l"))).collect()] == ["g", None, None, None, None]


def test_addresses(spark):
    seen = values(spark, paths.canonical_source, [" HTTPS://Ex.org:443#a ", "http://ex.org:80/x?y#z", "blob:abc", "data:image/png;base64,x", "data:text/plain,x", "ftp://x", "/rel", "", None])
    assert seen == ["https://ex.org/", "http://ex.org/x?y", "blob:abc", "data:image/png;base64,x", None, None, None, None, None]
    df = spark.createDataFrame([("https://a.org/x",), ("https://a.org:444/x",), ("blob:x",), ("data:image/png,x",)], "s string")
    assert [r[0] for r in df.select(paths.origin_gate(F.col("s"), F.lit("https://A.org/page"))).collect()] == ["allow", "IMAGE_ORIGIN_NOT_ALLOWED", "IMAGE_BLOB_NOT_MATERIALIZED", "allow"]


def test_errors_and_labels(spark):
    assert values(spark, paths.error_message, ["  x ", "", " ", "y" * 300]) == ["x", paths.NO_MESSAGE, paths.NO_MESSAGE, "y" * 240]
    assert values(spark, paths.error_code, ["bad Tensor", "cannot DECODE", "else"]) == ["IMAGE_DECODE_FAILED", "IMAGE_DECODE_FAILED", "MODEL_INFERENCE_FAILED"]
    df = spark.createDataFrame([("ok", 0.5, None), ("ok", float("nan"), None), ("ok", 1.5, None), ("error", None, "no"), ("error", None, None), (None, 0.5, None)], "s string, c double, m string")
    assert [r[0] for r in df.select(paths.result_label(F.col("s"), F.col("c"), F.col("m"))).collect()] == ["50.0%", "Invalid result", "Invalid result", "no", "Invalid result", "Invalid result"]


def test_how_values_compare(spark):
    assert values(spark, compare.category, [" A_b ", "", None]) == ["a-b", None, None]
    digest = "ab" * 32
    assert values(spark, compare.digest, [digest, f" SHA256:{digest.upper()} ", f"0x{digest}", "xyz", None]) == [digest, digest, digest, None, None]
    assert values(spark, compare.bits64, ["0x0F", "00:0f", "f", "0", "0000000000000000", "ffffffffffffffff", "g", None]) == [15, 15, 15, None, None, -1, None, None]
    assert values(spark, lambda c: hashing.joined_digest("s", c), ["x", None]) == [hashlib.sha256(b"s\0x").hexdigest(), None]


def test_duplicates_and_keys(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "y"), (None, "z")], "k string, v string")
    assert {tuple(r) for r in validate.duplicates(df, ["k", "v"]).collect()} == {("duplicate k", "a"), ("duplicate v", "y")}
    assert [r[0] for r in validate.unknown_keys(df, "k", df.where("false")).collect()] == ["a"]
    validate.require_empty(df.where("false"), "nothing")
    with pytest.raises(validate.ContractError, match="something"):
        validate.require_empty(df, "something")


def test_results(spark):
    requests = spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("5",)], "id string")
    rows = [("1", "ok", 0.5, None, None), ("2", "ok", 1.5, None, None), ("3", "error", None, "C", " "), ("4", "odd", None, None, None), ("9", "ok", 0.1, None, None), ("9", "ok", 0.1, None, None)]
    results = spark.createDataFrame(rows, "id string, status string, confidence double, code string, message string")
    found = {tuple(r) for r in validate.result_violations(requests, results).collect()}
    assert found == {("duplicate id", "9"), ("unknown id", "9"), ("missing id", "5"), ("ok", "2"), ("error", "3"), ("status", "4")}


def test_licences_operators_and_lineage(spark):
    df = spark.createDataFrame([("allow", "MIT"), ("deny", "MIT"), ("allow", "mit"), (None, "MIT"), ("allow", None)], "d string, s string")
    assert [r[0] for r in df.select(validate.license_allowed(F.col("d"), F.col("s"))).collect()] == [True, False, False, False, False]
    used = spark.createDataFrame([("", "Conv"), ("x", "Conv"), ("", "Gelu"), ("", None), ("", "Gelu")], "domain string, operator string")
    assert {tuple(r) for r in validate.unsupported_operators(used).collect()} == {("x", "Conv"), ("", "Gelu"), ("", None)}
    one, two = (spark.createDataFrame(r, "name string, digest string") for r in ([("a", "1"), ("b", "2")], [("a", "1"), ("b", "3"), ("c", "4")]))
    assert {r[0] or r for r in validate.lineage_mismatch(one, two).collect()} == {"b", "c"}


def test_numbers(spark):
    df = spark.createDataFrame([(0,), (50,), (100,), (550,), (2000,)], "step int")
    assert [round(r[0], 6) for r in df.select(numeric.warmup_cosine(F.col("step"), 100, 1000)).collect()] == [0.0, 0.5, 1.0, 0.5, 0.0]
    with pytest.raises(ValueError):
        numeric.warmup_cosine(F.col("step"), 10, 10)
    row = spark.range(1).select(*numeric.step_plan(F.lit(65), 32, 10, 0.05)).first()
    assert tuple(row) == (3, 30, 1)
    row = spark.range(1).select(*numeric.resize_geometry(F.lit(880), F.lit(440))).first()
    assert tuple(row) == (880, 440, -248.0, -28.0)
