"""Problem 9: the subject areas of each document.

Labels are propagated over a graph of document similarity. Two documents are neighbours
if they share a word that both use of their own dispute; the graph is kept in factored
form, document - word - document, so its edges are joins over the words and no pairs of
documents are ever made. An edge is verified: a word carries a subject only while at
least PURITY of the labelled documents that use it have that subject, at least SUPPORT
of them; all other words carry nothing.

Each round sends the labels from documents to words and back. A document takes every
subject that EVIDENCE different verified words bring (one verified word more would do for
none, so a stray mention gives no subject), hence several or none. Trusted seeds are clamped:
a label given by hand is trusted if the document's own words don't speak for other
subjects alone (some labels are wrong), and it then counts in every round. In the result
it stands, too, if one of the document's words is verified for it by other documents; a
label for which no word speaks (of a procedural text, say) doesn't.

How often a word is used under each subject is kept from round to round; only documents
whose labels changed send anything. Rounds end when no label of any document changes.
Should labels still turn to and fro after TURNS rounds, they may only be added to from
then on, which comes to an end.

What a document says of a cited other case is no part of its dispute: sentences built
around a citation, and the parties' names in the title, are left out. A citation in
brackets or after a semicolon only supports the sentence, which then stays.

Nulls: documents with a null id are skipped; null, blank and purely procedural texts
have no subjects. Labels of unknown documents or with a null subject don't count;
repeated ones count once. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.hashing import by_value
from plumbline.session import Workspace

PURITY, SUPPORT, EVIDENCE, TURNS = 0.75, 2, 2, 30

_UPPER, _LOWER = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿœ"
#: What only citations have: years in brackets, volume or year and page, dockets; and titles of reports ("Arn. L.J.", "ZfVR").
_CITED = re.compile(rf"[\[(](?:19|20)\d\d(?:\]|\)\s*\d)|\d, \d|\d\s+[{_UPPER}][{_UPPER}{_LOWER}]*\s+\d+/\d\d|@@")
_REPORT = re.compile(rf"\b(?:[{_UPPER}][{_UPPER}{_LOWER}]*\.\s?){{2,}}(?=[\s\d,;)\[]|$)|\b[{_UPPER}][{_LOWER}]+[{_UPPER}]{{2,}}\b")
_BRACKETS = re.compile(r"\((?:[^()]|\([^()]*\))*\)")
_SENTENCE = re.compile(rf"(?<=[{_LOWER}\d)\]>][{_LOWER}\d)\]>][.!?])\s+(?=[{_UPPER}§\[(])")
_LINES = re.compile(r"[\r\n\x0c]+")
_PARTIES = re.compile(r"\s(?:v|vs|c|versus|gegen|contre)\.?\s")
_WORD = re.compile(r"[^\W\d_]+")
_FAULT = re.compile(r"[\xc2\xc3][\x80-\xbf]")
#: Hyphens, spaces, dashes and apostrophes that stand for the plain ones; soft hyphens vanish.
_PLAIN = [(chr(0x2011), "-"), (chr(0x2010), "-"), (chr(0x2013), "-"), (chr(0x2588), "-"), (chr(0xAD), ""), (chr(0xA0), " "), (chr(0x202F), " "), (chr(0x2019), "'")]
_LETTERS = bytes(i if chr(i).isalpha() else 32 for i in range(256))


def letter_runs(text: str) -> set[str]:
    """Maximal runs of letters. Latin-1 texts take a table instead of a regular expression."""
    try:
        runs = text.encode("latin-1").translate(_LETTERS).split()
    except UnicodeEncodeError:
        return set(_WORD.findall(text))
    return {run.decode("latin-1") for run in set(runs)}


def own_words(text: str | None) -> set[str]:
    """The words that the document uses of its own dispute, in lower case."""
    if not text:
        return set()
    for odd, plain in _PLAIN:
        text = text.replace(odd, plain)
    if _FAULT.search(text):  # UTF-8 that was read as Latin-1
        text = _FAULT.sub(lambda m: m.group().encode("latin-1").decode("utf-8", "ignore"), text)
    kept, head = [], True
    for line in _LINES.split(text):
        if head:  # court, docket, date and parties, up to the first heading or sentence
            if _PARTIES.search(line) and not _CITED.search(line):
                continue
            head = ":" not in line and not line.rstrip().endswith(".")
        if not _CITED.search(line):
            kept.append(line)
            continue
        for sentence in _SENTENCE.split(_REPORT.sub("@@", line)):
            if _CITED.search(sentence):
                first, *rest = _BRACKETS.sub(lambda m: " " if _CITED.search(m.group()) else m.group(), sentence).split(";")
                if _CITED.search(first):
                    continue
                sentence = " ".join([first, *(x for x in rest if not _CITED.search(x))])
            kept.append(sentence)
    return letter_runs(" ".join(kept).lower())


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [sorted(own_words(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "words"])


def document_words(documents: DataFrame) -> DataFrame:
    """(doc_id, words): distinct own words of each document, whole texts."""
    return documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(_words, "doc_id bigint, words array<string>")


def _or_none(subjects: str) -> Column:
    """A document's subjects; an empty array for null."""
    return F.coalesce(F.col(subjects), F.array().cast("array<string>"))


def moves(words: DataFrame, new: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """(word, subject, n): by how much labels that changed from ``old`` to ``new`` change the use of each word.

    Both hold (doc_id, subjects ARRAY); the row with a null subject counts the labelled
    documents that use the word. Documents whose labels stay send nothing.
    """
    if old is None:
        both = new.select("doc_id", F.col("subjects").alias("now"), F.lit(None).cast("array<string>").alias("was"))
    else:
        both = new.select("doc_id", F.col("subjects").alias("now")).join(old.select("doc_id", F.col("subjects").alias("was")), "doc_id", "full_outer").where(~F.col("now").eqNullSafe(F.col("was")))
    now, was = _or_none("now"), _or_none("was")
    move = lambda subject, n: F.struct(subject.cast("string").alias("subject"), F.lit(n).cast("bigint").alias("n"))
    none = F.lit(None).cast("string")
    steps = F.concat(
        F.transform(F.array_except(now, was), lambda s: move(s, 1)),
        F.transform(F.array_except(was, now), lambda s: move(s, -1)),
        F.when(F.col("was").isNull(), F.array(move(none, 1))).when(F.col("now").isNull(), F.array(move(none, -1))).otherwise(F.array().cast("array<struct<subject:string,n:bigint>>")),
    )
    each = words.join(both.select("doc_id", steps.alias("steps")), "doc_id").select(F.explode("words").alias("word"), "steps").select("word", F.explode("steps").alias("step"))
    return each.groupBy("word", "step.subject").agg(F.sum("step.n").alias("n"))


def verified_words(uses: DataFrame, purity: float = PURITY, support: int = SUPPORT) -> DataFrame:
    """(word, subject, n, uses) that carry labels; ``uses``: (word, subject, n) as ``moves`` adds them up.

    A word's rows are as many as there are subjects at most.
    """
    known = F.collect_list(F.when(F.col("subject").isNotNull() & (F.col("n") >= support), F.struct("subject", "n")))
    per_word = uses.groupBy("word").agg(F.max(F.when(F.col("subject").isNull(), F.col("n"))).alias("uses"), known.alias("known"))
    rows = per_word.where(F.col("uses") >= support).select("word", "uses", F.explode("known").alias("k")).select("word", "k.subject", "k.n", "uses")
    return rows.where(F.col("n") >= F.col("uses") * purity)


def evidence(words: DataFrame, verified: DataFrame) -> DataFrame:
    """(doc_id, subject, n): how many different verified words speak for the subject."""
    return words.select("doc_id", F.explode("words").alias("word")).join(verified.select("word", "subject"), "word").groupBy("doc_id", "subject").agg(F.count("*").alias("n"))


def upheld(seeds: DataFrame, verified: DataFrame, purity: float = PURITY, support: int = SUPPORT) -> DataFrame:
    """(doc_id, subject): given labels that a word speaks for even if the document itself is not counted among its users."""
    others = verified.where((F.col("n") - 1 >= support) & (F.col("n") - 1 >= (F.col("uses") - 1) * purity)).select("word", "subject")
    given = seeds.select("doc_id", "words", F.explode("subjects").alias("subject")).select("doc_id", "subject", F.explode("words").alias("word"))
    return given.join(others, ["word", "subject"]).select("doc_id", "subject").distinct()


def clamped(spoken: DataFrame, given: DataFrame) -> DataFrame:
    """(doc_id, subjects): what each document's words say and, where they don't say otherwise, what it was given."""
    both = spoken.join(given.withColumnRenamed("subjects", "given"), "doc_id", "full_outer")
    trusted = F.col("subjects").isNull() | F.coalesce(F.arrays_overlap("subjects", "given"), F.lit(False))
    kept = F.when(trusted, F.array_union(_or_none("subjects"), _or_none("given"))).otherwise(F.col("subjects"))
    return both.select("doc_id", F.array_sort(kept).alias("subjects"))


def propagate(documents: DataFrame, labels: DataFrame, workspace: Workspace, turns: int = TURNS) -> DataFrame:
    """(doc_id, subject): the subjects of each document, when they no longer change.

    ``labels``: distinct (doc_id, subject), normalised.
    """
    words = workspace.put(document_words(documents), "words")
    named = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
    seeds = workspace.put(words.join(named, "doc_id"), "seeds")
    given = seeds.select("doc_id", "subjects")
    counted, i = given, 0
    uses = workspace.put(moves(words, given), "uses-0")
    while True:
        verified = workspace.put(verified_words(uses), f"verified-{i}")
        current = workspace.put(evidence(words, verified).where(F.col("n") >= EVIDENCE).groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("subjects")), f"current-{i}")
        now = clamped(current, given)
        if i >= turns:
            now = now.unionByName(counted).groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("subjects")))).alias("subjects"))
        now = workspace.put(now, f"labels-{i + 1}")
        change = workspace.put(moves(words, now, counted), f"moves-{i + 1}")
        if not change.limit(1).collect():
            break
        uses = workspace.put(uses.unionByName(change).groupBy("word", "subject").agg(F.sum("n").alias("n")).where("n <> 0"), f"uses-{i + 1}")
        for old in (f"uses-{i}", f"verified-{i}", f"current-{i}", f"labels-{i}", f"moves-{i + 1}"):
            workspace.drop(old)
        counted, i = now, i + 1
    found = current if i < turns else now
    return found.select("doc_id", F.explode("subjects").alias("subject")).unionByName(upheld(seeds, verified)).distinct()


by_value()
