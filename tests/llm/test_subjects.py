"""Subjects of small made-up documents."""

from plumbline.llm.subjects import own_words, propagate
from plumbline.session import Workspace


def test_trusted_seed_with_one_verified_word_stays(spark):
    """Label 10 has one word that others verify, label 11 (procedural text) none."""
    music = [(i, "cello encore") for i in range(1, 5)]
    texts = [*music, (10, "cello"), (11, "appeal"), (12, "appeal"), (13, "appeal")]
    labels = [(i, "music") for i in (1, 2, 3, 4, 10, 11)]
    documents = spark.createDataFrame(texts, "doc_id bigint, text string")
    given = spark.createDataFrame(labels, "doc_id bigint, subject string")
    rows = propagate(documents, given, Workspace(spark, "t9")).collect()
    found = {tuple(r) for r in rows}
    assert len(rows) == len(found)
    assert (10, "music") in found
    assert not {d for d, _ in found} & {11, 12, 13}


def test_short_line_with_bracketed_citation_stays():
    body = own_words("Für Aufzugsausfälle trägt die Beklagte das Risiko (Undtovpra gegen Galhul [2005] ZfVR 29, 220).")
    assert "aufzugsausfälle" in body and "galhul" not in body
    assert not own_words("Rasmor c. Morsel Software Ltd")


def _run(spark, texts, labels):
    documents = spark.createDataFrame([(*t, 0) for t in texts], "doc_id bigint, text string, words int")
    given = spark.createDataFrame(labels, "doc_id bigint, subject string")
    return {tuple(r) for r in propagate(documents, given, Workspace(spark, "t9")).collect()}


TEXTS = [*((i, f"cello encore recital{i}") for i in range(1, 6)), *((i, f"lease landlord mould{i}") for i in range(11, 16)), (20, "cello encore lease landlord"), (21, "costs follow"), (22, None), (23, " "), (None, "cello encore"), (24, "cello costs")]
LABELS = [(1, "music"), (2, "music"), (3, "music"), (11, "housing"), (12, "housing"), (99, "music"), (None, "music"), (4, None)]


def test_several_none_and_nulls(spark):
    found = _run(spark, TEXTS, LABELS)
    assert found == {(i, "music") for i in range(1, 6)} | {(i, "housing") for i in range(11, 16)} | {(20, "music"), (20, "housing")}


def test_labels_pass_on_round_by_round(spark):
    """Words that no labelled document has are verified by documents that were labelled before."""
    chain = [(100 + i, "cello encore violin bow") for i in range(3)] + [(200 + i, "violin bow stage tour") for i in range(3)] + [(300 + i, "stage tour") for i in range(2)]
    found = _run(spark, [*TEXTS, *chain], LABELS)
    assert {(d, "music") for d, _ in chain} <= found


def test_a_wrong_label_is_overruled_by_the_words(spark):
    assert (5, "housing") not in _run(spark, TEXTS, [*LABELS, (5, "housing")])


def test_empty_tables(spark):
    assert _run(spark, [], LABELS) == set()
    assert _run(spark, TEXTS, []) == set()


def test_long_text(spark):
    long = " ".join(["nothing"] * 200_000)
    assert (30, "music") in _run(spark, [*TEXTS, (30, f"{long} cello {long} encore")], LABELS)


def test_cited_cases_are_no_part_of_the_dispute():
    assert not own_words("Rasmor v. Morsel Football Club and some hundred more letters that make a very long title indeed, Ltd")
    assert own_words("1. The horse was sold. Anders lag der Fall in Hulbar [1990] ZfVR 20, 534, wo es um Pferde ging.") >= {"horse", "sold"}
    assert "pferde" not in own_words("Anders lag der Fall in Hulbar [1990] ZfVR 20, 534, wo es um Pferde ging.")
    assert own_words("Reasons:\nThe buyer v. the seller was heard.") >= {"buyer", "seller"}
