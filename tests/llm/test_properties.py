"""Properties of the parts that need no session."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.chunkstore import LARGEST, SMALLEST, chunks_of, cut_points
from plumbline.llm.mixing import BINS, limits_for
from plumbline.llm.packing import best_fit, differencing, pack
from plumbline.llm.picture_names import picture_name
from plumbline.llm.subjects import own_words
from plumbline.llm.words import words

sizes = st.lists(st.integers(1, 50), max_size=60)


@settings(max_examples=60, deadline=None)
@given(sizes)
def test_packing_is_a_partition_within_the_capacity(items):
    windows = pack(items, 50)
    assert sorted(i for w in windows for i in w) == list(range(len(items)))
    assert all(0 < sum(items[i] for i in w) <= 50 for w in windows)
    assert len(windows) <= len(best_fit(items, 50))
    assert [sorted(w) for w in pack(items, 50)] == [sorted(w) for w in windows]


@settings(max_examples=60, deadline=None)
@given(sizes.filter(bool), st.integers(1, 9))
def test_differencing_deals_every_item_once(items, k):
    windows = differencing(items, k)
    assert len(windows) == k and sorted(i for w in windows for i in w) == list(range(len(items)))
    sums = [sum(items[i] for i in w) for w in windows]
    assert max(sums) - min(sums) <= max(items)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=2000), min_size=1, max_size=5))
def test_cuts_don_t_depend_on_what_lies_beside_a_content(contents):
    lengths, data = np.array([len(c) for c in contents]), np.frombuffer(b"".join(contents), np.uint8)
    for content, ends in zip(contents, cut_points(lengths, data), strict=True):
        assert ends == cut_points(np.array([len(content)]), np.frombuffer(content, np.uint8))[0]
        assert sorted(set(ends)) == ends and (not content or ends[-1] == len(content))
        pieces = np.diff([0, *ends])
        assert all(n <= LARGEST for n in pieces) and all(n >= SMALLEST for n in pieces[:-1])


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 4000), st.binary(max_size=40))
def test_an_insertion_changes_few_chunks(seed, at, inserted):
    data = np.random.default_rng(seed).integers(0, 256, 4000, dtype=np.uint8).tobytes()
    before, after = set(chunks_of(data)), set(chunks_of(data[:at] + inserted + data[at:]))
    assert sum(n for _, n in before - after) <= 5 * LARGEST


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 900), min_size=1, max_size=50), st.floats(0, 5), st.integers(1, 4), st.integers(0, 2**32))
def test_copies_come_as_near_as_one_step(of, rate, cap, seed):
    bins = np.zeros(BINS, np.int64)
    np.add.at(bins, np.random.default_rng(seed).integers(0, BINS, len(of)), of)
    wanted = rate * bins.sum()
    limits = limits_for(bins, wanted, cap)
    assert len(limits) == cap and limits == sorted(limits)
    taken = sum(int(bins[limit:].sum()) for limit in limits)
    assert taken <= cap * bins.sum() and abs(taken - min(wanted, cap * bins.sum())) <= 2 * bins.max()


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_texts_of_any_kind_are_taken(text):
    name = picture_name(text)
    assert name is None or ("/" in name and not name.endswith("/"))
    assert words(text) >= (1 if own_words(text) else 0)
    assert all(w == w.lower() or len(w.lower()) != len(w) for w in own_words(text))
