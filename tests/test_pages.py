"""Page plans, scoring and merging of results, incremental retention, and the layout of the package."""

from pathlib import Path

import numpy as np
import pytest

from plumbline.operators import page_images, selection
from plumbline.operators.validate import ContractError
from plumbline.session import Workspace
from plumbline.streaming.retention import retained

IMAGES = "page_id string, pos bigint, current_src string, src string, alt string"


def test_plan_merge_and_summary(spark):
    rows = [("p", 0, "https://a.org/1#x", "", " first "), ("p", 1, "", "https://a.org/2", None), ("p", 2, "https://A.org/1", "x", "again"), ("p", 3, None, None, "none"), ("q", 0, "", "", "")]
    images = spark.createDataFrame(rows, IMAGES)
    plan = page_images.image_plan(images)
    assert [tuple(r) for r in plan.orderBy("id").collect()] == [("p", "image-1", "https://a.org/1", "first", 0, 2), ("p", "image-2", "https://a.org/2", "", 1, 1)]
    ok = spark.createDataFrame([("p", "image-2", "ok")], "page_id string, id string, status string")
    bad = spark.createDataFrame([("p", "image-1", "error", "C")], "page_id string, id string, status string, code string")
    merged = page_images.merge_results(plan.select("page_id", "id"), ok, bad)
    assert [(r["id"], r["status"], r["code"]) for r in merged.orderBy("place").collect()] == [("image-1", "error", "C"), ("image-2", "ok", None)]
    assert {(r["pos"], r["status"]) for r in page_images.fan_out(images, plan, merged).collect()} == {(0, "error"), (2, "error"), (1, "ok")}
    assert {tuple(r) for r in page_images.scan_summary(images, plan, merged).collect()} == {("p", 3, 2, 1), ("q", 0, 0, 1)}


def test_html(spark):
    html = '<a href=x><IMG SRC="https://a/1?x=1&amp;y=2" alt=\'A "b"\'></a><!-- <img src=no> --><script>"<img src=no>"</script><img><img src=u src=v alt/>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "no picture")], "page_id bigint, html string")
    assert [tuple(r) for r in page_images.html_images(pages).orderBy("pos").collect()] == [(1, 0, "", "https://a/1?x=1&y=2", 'A "b"'), (1, 1, "", "", ""), (1, 2, "", "u", "")]


def test_one_bad_row_costs_only_itself(spark):
    def make():
        def scorer(batch):
            if (batch["v"] < 0).any():
                raise ValueError(" cannot decode ")
            return [("ok", float(v), None, None) for v in batch["v"]]

        return scorer

    df = spark.createDataFrame([(i, -1.0 if i == 3 else 0.5) for i in range(10)], "k int, v double")
    found = {r["k"]: r for r in page_images.score(df, ["k"], make).collect()}
    assert [k for k, r in found.items() if r["status"] == "error"] == [3]
    assert (found[3]["code"], found[3]["message"], found[3]["confidence"]) == ("IMAGE_DECODE_FAILED", "cannot decode", None)
    assert {r["code"] for r in page_images.score(df, ["k"]).collect()} == {"MODEL_RUNTIME_UNAVAILABLE"}


def test_pixels(spark):
    rgba = bytes(range(16))
    row = page_images.planar_pixels(spark.createDataFrame([(1, bytearray(rgba))], "k int, rgba binary"), ["k"]).first()
    wanted = [(rgba[p * 4 + c] / 255 - page_images.MEAN[c]) / page_images.DEVIATION[c] for c in range(3) for p in range(4)]
    assert row["pixels"] == pytest.approx(np.array(wanted, np.float32).tolist())


def _shards(spark, folder, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "source string, key string").coalesce(1).write.mode("append").parquet(folder)


def test_retention_is_that_of_one_pass(spark, tmp_path):
    rows = [(f"s{i % 2}", f"k{i}") for i in range(60)]
    folder = str(tmp_path / "in")
    _shards(spark, folder, [rows[:20], rows[20:40], rows[40:]])
    quotas = {"s0": 4, "s1": 7}
    ws = Workspace(spark, "x4")
    kept = {tuple(r) for r in retained(spark, folder, "source string, key string", lambda b: b, quotas, "s", ws, 2).collect()}
    wanted = selection.source_quotas(spark.createDataFrame(rows, "source string, key string"), quotas, "s", 2)
    assert kept == {(r["source"], r["key"]) for r in wanted.collect()} and len(kept) == 15
    _shards(spark, folder, [[("s0", f"later{i}") for i in range(30)]])  # the stream goes on where it ended
    more = {tuple(r) for r in retained(spark, folder, "source string, key string", lambda b: b, quotas, "s", ws, 2).collect()}
    assert any(k.startswith("later") for _, k in more) and len(more) == 15


def test_a_repeated_key_is_an_error(spark, tmp_path):
    folder = str(tmp_path / "in")
    _shards(spark, folder, [[("s0", "a"), ("s0", "a")]])
    with pytest.raises(Exception, match=ContractError.__name__):
        retained(spark, folder, "source string, key string", lambda b: b, {"s0": 1}, "s", Workspace(spark, "x4"))


def test_shards_that_deliver_again(spark, tmp_path):
    """Keys among the kept, keys cut away before, and keys of two sources, against one pass over the distinct rows."""
    rows = [(f"s{i % 2}", f"k{i}") for i in range(60)]
    folder = str(tmp_path / "in")
    _shards(spark, folder, [rows[:30] + rows[:5], rows[20:] + [(None, "k1"), ("s0", None)], [("s1", k) for _, k in rows[:20]] + rows])
    distinct = spark.createDataFrame([*rows, *(("s1", k) for s, k in rows[:20] if s == "s0")], "source string, key string")
    wanted = selection.source_quotas(distinct, {"s0": 4, "s1": 40}, "s", 2)
    kept = [tuple(r) for r in retained(spark, folder, "source string, key string", lambda b: b, {"s0": 4, "s1": 40}, "s", Workspace(spark, "x4"), 2, redelivered=True).collect()]
    assert sorted(kept) == sorted((r["source"], r["key"]) for r in wanted.collect()) and len(kept) == 46


def test_stream_topk_over_several_files(spark, tmp_path):
    """A table whose files repeat each other's rows gives what its SQL gives."""
    import duckdb

    from plumbline.plans import catalog

    raw = spark.read.parquet("/root/testdata/sf0.001/monet_rows.parquet")
    for part in (raw, raw.where("batch_id > 4"), raw):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/monet_rows.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW monet_rows AS SELECT * FROM '{tmp_path}/monet_rows.parquet/*.parquet'")
    found = sorted(tuple(r) for r in catalog.QUERIES["stream_topk"](spark, str(tmp_path)).collect())
    assert found == sorted(con.execute(catalog.ORACLES["stream_topk"]).fetchall()) and found


def test_nothing_else_imports_the_llm_package():
    root = Path(__file__).resolve().parents[1]
    own = [p for p in (root / "plumbline").rglob("*.py") if "llm" not in p.parts]
    assert len(own) > 20 and not [p for p in own if "plumbline.llm" in p.read_text()]


def test_command_line(spark, tmp_path, capsys):
    from plumbline.__main__ import main

    assert main(["list"]) == 0 and "evaluate_holdout" in capsys.readouterr().out.split()
    out = str(tmp_path / "out")
    assert main(["run", "unsupported_ops", "/root/testdata/sf0.001", out]) == 0
    assert spark.read.parquet(out).count() == 3
    with pytest.raises(SystemExit):
        main(["run", "nothing", "x", out])
