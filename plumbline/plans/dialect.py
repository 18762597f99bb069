"""Pieces of DuckDB SQL that say what the column functions say."""

from __future__ import annotations

from plumbline.functions.compare import WHITE_SPACE

_CODES = "".join(f"\\x{{{ord(c):X}}}" for c in WHITE_SPACE)
SPACE = f"[{_CODES}]"


def trim(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def key(c: str) -> str:
    return f"nullif({trim(f'lower({c})')}, '')"


def cat(c: str) -> str:
    return f"replace({key(c)}, '_', '-')"


def sha(c: str) -> str:
    return f"nullif(regexp_extract(regexp_replace(lower({c}), '{SPACE}+', '', 'g'), '^(?:[a-z0-9_-]+[:=])?(?:0x)?([0-9a-f]+)$', 1), '')"


def bits(c: str) -> str:
    bare = f"ltrim(regexp_extract(regexp_replace(lower({c}), '[{_CODES}:_.-]+', '', 'g'), '^(?:0x)?([0-9a-f]+)$', 1), '0')"
    return f"CASE WHEN {bare} <> '' AND length({bare}) <= 16 THEN ('0x' || {bare})::UBIGINT END"


def words(c: str) -> str:
    return f"CAST(coalesce(len(regexp_extract_all({c}, '[^{_CODES}]+')), 0) AS BIGINT)"


def digest(*parts: str) -> str:
    """SHA-256 of SQL expressions joined by NUL."""
    return "sha256(" + " || chr(0) || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


def sigmoid(z: str) -> str:
    return f"(CASE WHEN {z} >= 0 THEN 1e0 / (1e0 + exp(-abs({z}))) ELSE exp(-abs({z})) / (1e0 + exp(-abs({z}))) END)"


def logit(p: str) -> str:
    q = f"least(greatest({p}, 1e-6), 1e0 - 1e-6)"
    return f"ln({q} / (1e0 - {q}))"


def bce(z: str, y: str) -> str:
    return f"(greatest({z}, 0e0) - {z} * {y} + ln(1e0 + exp(-abs({z}))))"
