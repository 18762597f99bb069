"""Paths, URLs and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.compare import WHITE_SPACE
from plumbline.functions.hashing import joined_digest

#: Suffixes that a stored picture keeps (fixed values).
SUFFIXES = (".avif", ".jpeg", ".jpg", ".png", ".webp")
#: What an error without a message says (fixed value).
NO_MESSAGE = "Local model operation failed."


def unsafe_path(path: Column) -> Column:
    """Whether a path is not a normalised relative one; '.' alone is let through, null is unsafe."""
    parts = F.split(path, "/")
    bad = (path == "") | path.startswith("/") | path.contains("\\") | F.arrays_overlap(parts, F.array(F.lit(""), F.lit("."), F.lit("..")))
    return F.coalesce(bad & (path != "."), F.lit(True))


def untrimmed(text: Column) -> Column:
    """Whether a text is null, empty or has white space around it."""
    return F.coalesce((text == "") | (F.btrim(text, F.lit(WHITE_SPACE)) != text), F.lit(True))


def not_a_digest(c: Column) -> Column:
    """Whether a value is not 64 lower-case hex digits; null is not."""
    return F.coalesce(~c.rlike(r"\A[0-9a-f]{64}\z"), F.lit(True))


def generator_of(file_name: Column, label: Column) -> Column:
    """The folder below ``1_fake`` of a fake's name; null for real ones and where the name has none."""
    parts = F.split(file_name, "/")
    named = (F.size(parts) >= 4) & (F.get(parts, 1) == "1_fake") & (F.get(parts, 2) != "")
    return F.when((label == "1_fake") & named, F.get(parts, 2))


def safe_segment(text: Column) -> Column:
    """A text as one path segment: other characters than letters, digits, '.', '_', '-' and space become '_'.

    A text of which nothing is left is an error, null stays null.
    """
    clean = F.btrim(F.regexp_replace(text, r"[^A-Za-z0-9._ -]+", "_"), F.lit(" ."))
    return F.when(clean == "", F.raise_error(F.concat(F.lit("unsafe path segment: "), text)).cast("string")).otherwise(clean)


def stored_suffix(file_name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(file_name, r"[^/](\.[^./]+)$", 1))
    return F.when(suffix.isin(*SUFFIXES), suffix).otherwise(F.lit(".img"))


def entry_path(file_name: Column, label: Column, content_type: Column, generator: Column, seed: str) -> Column:
    """ai or real/type[/generator]/digest+suffix, the digest being that of the selection."""
    return F.concat(F.when(label == "1_fake", "ai").otherwise("real"), F.lit("/"), safe_segment(content_type), F.coalesce(F.concat(F.lit("/"), safe_segment(generator)), F.lit("")), F.lit("/"), joined_digest(seed, file_name), stored_suffix(file_name))


def percent_quoted(text: Column, keep_slash: bool) -> Column:
    """Percent-encoding that leaves letters, digits and ``_.-~`` (and ``/`` if wanted) alone."""
    out = F.url_encode(text)
    for form, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), *((("%2F", "/"),) if keep_slash else ())):
        out = F.replace(out, F.lit(form), F.lit(plain))
    return out


def pinned_url(base: str, dataset: Column, revision: Column, file_name: Column) -> Column:
    return F.concat(F.lit(f"{base}/datasets/"), percent_quoted(dataset, True), F.lit("/resolve/"), percent_quoted(revision, False), F.lit("/"), percent_quoted(file_name, True))


def canonical_source(src: Column) -> Column:
    """An image address without white space around it and without its fragment; null if unsupported.

    Supported are http, https, blob and data:image addresses. Of http addresses scheme
    and host become lower case, a default port goes and an empty path becomes ``/``; no
    further rewriting (dot segments, escapes, international names) is done.
    """
    text = F.btrim(src, F.lit(WHITE_SPACE))
    bare = F.regexp_replace(text, r"#.*\z", "")
    authority = F.lower(F.regexp_extract(bare, r"^(?i:https?)://([^/?]*)", 1))
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z]+):", 1))
    port = F.when(scheme == "http", F.regexp_replace(authority, r":80$", "")).otherwise(F.regexp_replace(authority, r":443$", ""))
    rest = F.regexp_extract(bare, r"^(?i:https?)://[^/?]*(.*)$", 1)
    web = F.concat(scheme, F.lit("://"), port, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))
    return F.when(bare.rlike(r"^(?i:https?)://[^/?]+"), web).when(bare.rlike(r"^(?i:blob:|data:image/)"), bare)


def origin(address: Column) -> Column:
    """scheme://host[:port] of an http(s) address, canonical; else null."""
    found = F.regexp_extract(canonical_source(address), r"^(https?://[^/?]+)", 1)
    return F.when(found != "", F.regexp_replace(found, r"//[^@/]*@", "//"))


def origin_gate(source: Column, page: Column) -> Column:
    """'allow' or the code of what blocks an image of a page."""
    kind = F.lower(F.regexp_extract(source, r"^([A-Za-z]+):", 1))
    same = F.coalesce(origin(source) == origin(page), F.lit(False))
    return F.when(kind == "data", "allow").when(kind == "blob", "IMAGE_BLOB_NOT_MATERIALIZED").when(same, "allow").otherwise("IMAGE_ORIGIN_NOT_ALLOWED")


def error_code(message: Column) -> Column:
    low = F.lower(message)
    return F.when(low.contains("tensor") | low.contains("decode"), "IMAGE_DECODE_FAILED").otherwise("MODEL_INFERENCE_FAILED")


def error_message(message: Column, limit: int = 240) -> Column:
    """The trimmed and shortened message; NO_MESSAGE if nothing is left."""
    text = F.btrim(message, F.lit(WHITE_SPACE))
    return F.when(text != "", F.substring(text, 1, limit)).otherwise(NO_MESSAGE)


def immutable_revision(revision: Column) -> Column:
    """Whether a revision is a commit's 40 or 64 lower-case hex digits."""
    return F.coalesce(revision.rlike(r"\A[0-9a-f]{40}([0-9a-f]{24})?\z"), F.lit(False))


def result_label(status: Column, confidence: Column, message: Column) -> Column:
    """What is shown for a result: a percentage, the error's message, or that the result is invalid."""
    percent = F.format_string("%.1f%%", confidence * 100)
    return F.when((status == "ok") & confidence.between(0, 1) & ~F.isnan(confidence), percent).when((status == "error") & message.isNotNull(), message).otherwise("Invalid result")
