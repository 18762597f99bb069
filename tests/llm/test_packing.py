"""Problem 7 on random sizes, and sizes in words and tokens."""

import random
from pathlib import Path

import pytest

from plumbline.llm import packing, tokens
from plumbline.llm.words import word_count, words


def _valid(windows, sizes, capacity):
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in w) <= capacity for w in windows)


def test_differencing_gives_near_equal_windows():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 100) for _ in range(400)]
    windows = packing.differencing(sizes, 10)
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(400)) and max(sums) - min(sums) <= 1


@pytest.mark.parametrize("largest", [20, 60, 100])
def test_pack_is_no_worse_than_best_fit(largest):
    rng = random.Random(largest)
    sizes = [rng.randrange(1, largest + 1) for _ in range(700)]
    windows = packing.pack(sizes, 100)
    _valid(windows, sizes, 100)
    assert -(-sum(sizes) // 100) <= len(windows) <= len(packing.best_fit(sizes, 100))


def test_pack_small_cases():
    assert packing.pack([], 5) == [] and packing.pack([5], 5) == [[0]] and len(packing.pack([3, 3, 3], 5)) == 3


def test_packing_cuts_only_what_is_too_large(spark):
    rng = random.Random(2)
    docs = [(i, rng.randrange(1, 260)) for i in range(300)]
    items = spark.createDataFrame(docs, "doc_id bigint, size bigint")
    classes = spark.createDataFrame([("small", 100), ("none", 0), (None, 9), ("wide", 1000)], "container_class string, capacity bigint")
    rows = packing.packing(items, classes, shard_size=50).collect()
    for name, capacity in (("small", 100), ("wide", 1000)):
        of: dict = {}
        room: dict = {}
        for r in rows:
            if r["container_class"] == name:
                of.setdefault(r["doc_id"], []).append(r["size"])
                room[r["container"]] = room.get(r["container"], 0) + r["size"]
        assert {d: sum(s) for d, s in of.items()} == dict(docs) and max(room.values()) <= capacity
        assert all(len(of[d]) == -(-n // capacity) for d, n in docs)
    assert {r["container_class"] for r in rows} == {"small", "wide"}
    assert packing.packing(items.limit(0), classes).count() == packing.packing(items, classes.limit(0)).count() == 0


def test_shards_split_in_two_as_a_corpus_grows(spark):
    items = lambda n: spark.createDataFrame([(i, 1) for i in range(n)], "doc_id bigint, size bigint")
    classes = spark.createDataFrame([("c", 10)], "container_class string, capacity bigint")
    shard = lambda n: {r["doc_id"]: int(r["container"].split("-")[0]) for r in packing.packing(items(n), classes, shard_size=50).collect()}
    few, more, many = shard(190), shard(200), shard(390)
    assert all(more[i] == few[i] for i in range(190)) and all(many[i] // 2 == few[i] for i in range(190))


def test_sizes(spark):
    texts = [None, "", "  \x0c", "a b c", "x" * 100_000, "a\x1cb c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert [words(t) for t in texts] == [0, 0, 0, 3, 1, 2]
    assert {tuple(r) for r in packing.sized(df, word_count).collect()} == {(3, 3), (4, 1), (5, 2)}


@pytest.mark.skipif(not Path(tokens.PATH).exists(), reason="no tokenizer here")
def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "<|endoftext|>")], "doc_id bigint, text string")
    counted = {r["doc_id"]: r["size"] for r in packing.sized(df, tokens.token_count()).collect()}
    assert counted.keys() == {1, 3} and counted[1] == 2 and counted[3] > 1
    with pytest.raises(ValueError):
        tokens.token_counter("x.bin")
