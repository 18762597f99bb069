"""Problem 1 on small batches, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm.bitblocks import agreeing, block_keys
from plumbline.llm.chunkstore import TABLES, ChunkTable, chunks_of
from plumbline.llm.picture_names import picture_name
from plumbline.session import Workspace

SCHEMA = "kind string, key string, content string, batch int, extra int"
MARKS = "kind string, key string, bits bigint, batch int"


def rows(df):
    return {(r["key_new"], r["key_old"]) for r in df.collect()}


@pytest.fixture
def chunks(spark, tmp_path):
    return ChunkTable(spark, f"file://{tmp_path}/store", Workspace(spark, "t1"))


def test_repeats_across_appends(spark, chunks):
    """The record's batch is its lowest; nulls, blanks and repeats; a second ingest reads what the first one stored."""
    text = "a content long enough for several chunks " * 20
    history = [("k", "a", text, 1, 0), ("k", "a", text, 1, 0), ("k", None, text, 1, 0), ("k", "b", None, 1, 0), ("k", "c", "", 1, 0)]
    chunks.append(spark.createDataFrame(history, SCHEMA))
    new = [("k", "d", text, 2, 0), ("k", "b", text, 2, 0), ("k", "e", "", 2, 0), ("other", "f", text, 2, 0), ("k", "g", text, None, 0)]
    assert rows(chunks.ingest(spark.createDataFrame(new, SCHEMA), exact=True)) == {("d", "a"), ("d", "b")}
    before = chunks.rows("chunks").count()
    again = [("k", "h", text, 3, 0), ("k", "h", "something else", 3, 0)]
    assert rows(chunks.ingest(spark.createDataFrame(again, SCHEMA), exact=True)) == {("h", "a"), ("h", "b"), ("h", "d")}
    assert chunks.rows("chunks").count() == before + len(chunks_of(b"something else"))


def test_a_batch_appended_twice_is_there_once(spark, chunks):
    batch = spark.createDataFrame([("k", "a", "x" * 300, 1, 0), ("k", "b", "y" * 300, 1, 0)], SCHEMA)
    chunks.append(batch)
    first = sorted(map(tuple, chunks.rows("chunks").collect()))
    chunks.append(batch)
    assert sorted(map(tuple, chunks.rows("chunks").collect())) == first
    covered = chunks.content_pairs(chunks.rows("chunks")).where("new = old").select("covered").collect()
    assert [r[0] for r in covered] == [1.0, 1.0]


def test_near_contents_by_coverage(spark, chunks):
    rng = random.Random(3)
    words = [str(rng.randrange(10**6)) for _ in range(3000)]
    text = " ".join(words)
    edited = " ".join([*words[:1500], "inserted", *words[1500:]])
    other = " ".join(str(rng.randrange(10**6)) for _ in range(3000))
    chunks.append(spark.createDataFrame([("k", "a", text, 1, 0), ("k", "z", other, 1, 0)], SCHEMA))
    new = spark.createDataFrame([("k", "b", edited, 2, 0)], SCHEMA)
    assert rows(chunks.ingest(new, coverage=0.9)) == {("b", "a")}


def test_marks_and_empty_tables(spark, chunks):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(6))) for b in base]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    numbers = {f"o{i}": (b, 1) for i, b in enumerate(base)} | {f"n{i}": (b, 2) for i, b in enumerate(near)}
    make = lambda batch: [("m", k, signed(b), n) for k, (b, n) in numbers.items() if n == batch]
    keys = lambda batch: spark.createDataFrame([("m", k, None, n, 0) for _, k, _, n in make(batch)], SCHEMA)
    chunks.append(keys(1), spark.createDataFrame(make(1), MARKS))
    found = rows(chunks.ingest(keys(2), spark.createDataFrame(make(2), MARKS)))
    assert found == {(n, o) for n, (x, _) in numbers.items() if n[0] == "n" for o, (y, _) in numbers.items() if o[0] == "o" and (x ^ y).bit_count() <= 3}
    assert found
    nothing = spark.createDataFrame([], SCHEMA)
    assert rows(chunks.ingest(nothing, spark.createDataFrame([], MARKS))) == set()


@pytest.mark.parametrize("agree", [2, 3, 4])
def test_blocks_find_every_pair(spark, agree):
    rng = random.Random(agree)
    base = [rng.getrandbits(63) for _ in range(200)]
    pairs = [(b, b ^ sum(1 << i for i in rng.sample(range(63), 3))) for b in base]
    df = spark.createDataFrame(pairs, "l bigint, r bigint")
    left = df.select(F.col("l").alias("bits_l"), F.explode(block_keys(F.col("l"), 3, agree)).alias("block_key"))
    right = df.select(F.col("r").alias("bits_r"), F.explode(block_keys(F.col("r"), 3, agree)).alias("block_key"))
    found = agreeing(left.join(right, "block_key"), 3, agree).collect()
    assert len(found) == len({tuple(r)[1:] for r in found}) >= 200


def test_chunks_cover_the_content():
    data = bytes(random.Random(1).randrange(256) for _ in range(5000))
    assert sum(n for _, n in chunks_of(data)) == 5000
    assert chunks_of(b"") == []
    assert len({h for h, _ in chunks_of(b"\x00" * 4000)}) == len(chunks_of(b"\x00" * 4000))


def test_picture_names():
    same = ["food/0_real/Rusty Terrace_12.png", "food\\0_real\\rusty-terrace-12 (2).JPG", "food/./0_real/rusty%20terrace-12.jpeg", "food/0_real/Copy of rusty_terrace_12.png", "food/0_real/rusty_terrace_12 (1234).png"]
    assert len({picture_name(n) for n in same}) == 1
    assert picture_name("food/0_real/a-12.png") != picture_name("food/0_real/a-13.png")
    assert picture_name(None) is None and picture_name(" ") is None


def test_a_lasting_table_is_not_filled_again(spark, tmp_path, monkeypatch):
    from plumbline.llm import chunkstore, queries

    folder = "/root/testdata/sf0.001"
    once = {tuple(r) for r in queries.p1_found(spark, folder).collect()}
    cut = []
    append = chunkstore.ChunkTable.append
    monkeypatch.setattr(chunkstore.ChunkTable, "append", lambda self, *a: cut.append(a[0].select("batch").distinct().count()) or append(self, *a))
    spark.conf.set(queries.STORE, f"file://{tmp_path}/lasting")
    try:
        first = {tuple(r) for r in queries.p1_found(spark, folder).collect()}
        second = {tuple(r) for r in queries.p1_found(spark, folder).collect()}
    finally:
        spark.conf.unset(queries.STORE)
    assert once == first == second and once
    assert cut == [7, 3, 0, 3]  # the accepted batches are cut in the first run only


def test_batches_one_by_one_or_together(spark, tmp_path):
    """Redeliveries with other contents, in either order, against brute force."""
    rng = random.Random(8)
    texts = [f"content number {i} " * 12 for i in range(25)]
    data = [("k", f"r{rng.randrange(40)}", rng.choice(texts), rng.randrange(1, 7), 0) for _ in range(110)]
    numbers = [rng.getrandbits(63) for _ in range(12)]
    marks = [("k", key, rng.choice(numbers) ^ (1 << rng.randrange(3)), batch) for _, key, _, batch, _ in data if rng.random() < 0.5]
    first = {k: min(b for _, x, _, b, _ in data if x == k) for _, k, _, _, _ in data}
    has = {k: ({t for _, x, t, _, _ in data if x == k}, {m for _, x, m, _ in marks if x == k}) for k in first}
    close = lambda a, b: bool(has[a][0] & has[b][0]) or any((x ^ y).bit_count() <= 3 for x in has[a][1] for y in has[b][1])
    wanted = {(a, b) for a in first for b in first if a != b and first[a] > first[b] and first[a] >= 4 and close(a, b)}
    deliveries, hashes = spark.createDataFrame(data, SCHEMA), spark.createDataFrame(marks, MARKS)
    together, single = (ChunkTable(spark, f"file://{tmp_path}/{n}", Workspace(spark, "t1")) for n in ("all", "each"))
    for table in (together, single):
        table.append(deliveries.where("batch < 4"), hashes.where("batch < 4"))
    assert rows(together.ingest(deliveries.where("batch >= 4"), hashes.where("batch >= 4"), exact=True)) == wanted
    found = set()
    for batch in (4, 5, 6):
        found |= rows(single.ingest(deliveries.where(f"batch = {batch}"), hashes.where(f"batch = {batch}"), exact=True, new=[4, 5, 6]))
    assert found == wanted and wanted


def test_a_batch_lies_in_few_files(spark, chunks):
    """However many tasks the shuffles have; repeated deliveries and marks still count once."""
    data = [("k", f"r{i % 300}", f"content number {i % 200} " * 12, 1 + i % 6, 0) for i in range(600)]
    marks = [("k", f"r{i % 300}", i % 250, 1 + i % 6) for i in range(600)]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        chunks.append(spark.createDataFrame(data + data[:50], SCHEMA), spark.createDataFrame(marks + marks[:50], MARKS))
    finally:
        spark.conf.unset(coalesce)
    for name in TABLES:
        assert len(chunks.rows(name).inputFiles()) == len(chunks.rows(name).select("batch").distinct().collect()) > 1
    first = {k: min(b for _, x, _, b, _ in data if x == k) for _, k, _, _, _ in data}
    assert sorted((r["key"], r["first"], r["batch"]) for r in chunks.rows("members").collect()) == sorted((k, first[k], b) for k, b, _ in {(k, b, c) for _, k, c, b, _ in data})
    assert sorted((r["key"], r["bits"], r["first"], r["batch"]) for r in chunks.rows("marks").collect()) == sorted({(k, n, first[k], b) for _, k, n, b in marks})
