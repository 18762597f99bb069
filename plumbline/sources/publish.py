"""Publication on a local file system: all or nothing, never over something else.

A generation is staged beside its place, finished with a READY file that holds the
digest of its manifest, renamed into ``generations/`` and only then named in CURRENT by
an atomic replace. A crash at any point leaves the former generation current.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path

from plumbline.sources.documents import DocumentError, canonical, load, sha256

Hook = Callable[[str], None]


def _nothing(_: str) -> None:
    return


@contextmanager
def staged(target: str | Path):
    """Yields a folder that becomes ``target`` if the block succeeds and vanishes if it fails."""
    target = Path(target)
    if target.exists():
        raise FileExistsError(target)
    folder = Path(tempfile.mkdtemp(prefix=f".{target.name}-", dir=target.parent))
    try:
        yield folder
        if target.exists():
            raise FileExistsError(target)
        folder.rename(target)
    except BaseException:
        shutil.rmtree(folder, ignore_errors=True)
        raise


def write_new(path: str | Path, data: bytes) -> None:
    """Writes a file that must not exist, to the disk."""
    with Path(path).open("xb") as out:
        out.write(data)
        out.flush()
        os.fsync(out.fileno())


def publish(root: str | Path, name: str, manifest: dict, write: Callable[[Path], None], hook: Hook = _nothing) -> Path:
    """Publishes one generation and makes it current. ``hook`` is told of each step, for fault tests."""
    root = Path(root)
    (root / "generations").mkdir(parents=True, exist_ok=True)
    target = root / "generations" / name
    with staged(target) as folder:
        write(folder)
        hook("written")
        data = canonical({**manifest, "schema_version": 1})
        write_new(folder / "generation.json", data)
        write_new(folder / "READY", (sha256(data) + "\n").encode())
        hook("ready")
    hook("renamed")
    pointer = root / f".CURRENT-{os.getpid()}"
    pointer.unlink(missing_ok=True)
    write_new(pointer, (name + "\n").encode())
    hook("pointer")
    os.replace(pointer, root / "CURRENT")
    return target


def current(root: str | Path) -> tuple[Path, dict] | None:
    """The current generation and its manifest, verified; None if nothing was published yet."""
    root = Path(root)
    if not (root / "CURRENT").exists():
        return None
    name = (root / "CURRENT").read_text().strip()
    if not name or "/" in name or name in (".", ".."):
        raise DocumentError("CURRENT names no generation")
    folder = root / "generations" / name
    return folder, load(folder / "generation.json", expected_sha256=(folder / "READY").read_text().strip(), must_be_canonical=True)


def file_set(root: str | Path) -> dict[str, str]:
    """Relative path and digest of every file; links are refused."""
    root, out = Path(root), {}
    for path in sorted(root.rglob("*")):
        if path.is_symlink():
            raise DocumentError(f"{path}: a link")
        if path.is_file():
            out[path.relative_to(root).as_posix()] = sha256(path.read_bytes())
    return out


def verify_files(root: str | Path, expected: dict[str, str]) -> None:
    """Raises unless the folder holds exactly the expected files with the expected content."""
    found = file_set(root)
    missing, extra = sorted(expected.keys() - found.keys())[:3], sorted(found.keys() - expected.keys())[:3]
    if missing or extra:
        raise DocumentError(f"missing {missing}, extra {extra}")
    if wrong := sorted(p for p in expected if expected[p] != found[p])[:3]:
        raise DocumentError(f"content differs: {wrong}")
