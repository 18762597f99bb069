"""Documents, publication, pictures and shards."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.session import shared_dir
from plumbline.sources import documents, pictures, publish, shards


def put(path, value, **kw):
    data = documents.canonical(value)
    path.write_bytes(data)
    return documents.sha256(data)


def test_documents(spark, tmp_path):
    path = tmp_path / "d.json"
    value = {"schema_version": 1, "samples": [{"b": 2, "a": "ä"}], "x": 1e-8}
    digest = put(path, value)
    assert path.read_bytes().endswith(b'"x":1e-08}\n') and b"\\u00e4" in path.read_bytes()
    assert documents.load(path, digest, {"schema_version", "samples", "x"}, must_be_canonical=True) == value
    for arguments in (("0" * 64,), (None, {"samples"})):
        with pytest.raises(documents.DocumentError):
            documents.load(path, *arguments)
    path.write_text(json.dumps(value, indent=2))
    assert documents.load(path) == value
    with pytest.raises(documents.DocumentError):
        documents.load(path, must_be_canonical=True)
    put(path, {"schema_version": 2})
    with pytest.raises(documents.DocumentError):
        documents.load(path)
    path.write_bytes(documents.canonical(value, 2))
    assert path.read_bytes() == (json.dumps(value, indent=2, sort_keys=True) + "\n").encode()
    assert documents.load(path, must_be_canonical=True, indent=2) == value
    documents.check_lineage({"a": "1"}, {"a": "1"})
    for actual in ({"a": "2"}, {}, {"a": "1", "b": "2"}):
        with pytest.raises(documents.DocumentError):
            documents.check_lineage({"a": "1"}, actual)
    rows = documents.rows_of(spark, value, "samples", "a string, b int")
    assert [tuple(r) for r in rows.collect()] == [("ä", 2)]
    with pytest.raises(documents.DocumentError):
        documents.rows_of(spark, value, "samples", "a string")


def test_rows_are_written_in_canonical_form(spark, tmp_path):
    rows = [(f"s{i:03}", i, None if i % 2 else "é") for i in range(50)]
    df = spark.createDataFrame(rows[::-1], "id string, n int, t string").repartition(4)
    digest = documents.write_rows(df, tmp_path / "m.json", {"schema_version": 1}, "samples", "id")
    wanted = documents.canonical({"schema_version": 1, "samples": [{"id": a, "n": b, "t": c} for a, b, c in rows]})
    assert (tmp_path / "m.json").read_bytes() == wanted and digest == documents.sha256(wanted)
    assert documents.rows_digest(df, {"schema_version": 1}, "samples", "id") == digest
    with pytest.raises(FileExistsError):
        documents.write_rows(df, tmp_path / "m.json", {}, "samples", "id")


def test_splits_and_prior_manifests(spark, tmp_path):
    split = documents.assignments_of(spark, {"assignments": {"b": "train", "a": "calibration"}})
    assert [tuple(r) for r in split.orderBy("sample_id").collect()] == [("a", "calibration"), ("b", "train")]
    with pytest.raises(documents.DocumentError):
        documents.assignments_of(spark, {"assignments": {"a": "test"}})
    assert documents.partition_digest(split, "train") == documents.sha256(documents.canonical({"sample_ids": ["b"], "schema_version": 1, "split": "train"}))
    with pytest.raises(documents.DocumentError):
        documents.partition_digest(split, "validation")
    entries = [{"file_name": "b", "content_sha256": "1"}, {"file_name": "a", "content_sha256": "2"}]
    head = {"schema_version": 1, "dataset_id": "d", "dataset_revision": "r"}
    path = tmp_path / "p.json"
    put(path, head | {"entries": entries})
    assert documents.prior_manifest(path, "d", "r") == (["a", "b"], ["1", "2"])
    with pytest.raises(documents.DocumentError):
        documents.prior_manifest(path, "d", "other")
    for bad in ([*entries, entries[0]], [{"file_name": "x"}], None):
        put(path, head | {"entries": bad})
        with pytest.raises(documents.DocumentError):
            documents.prior_manifest(path, "d", "r")


@pytest.mark.parametrize("step", ["written", "ready", "renamed", "pointer"])
def test_a_failed_publication_leaves_the_former_one_current(tmp_path, step):
    assert publish.current(tmp_path) is None
    publish.publish(tmp_path, "g1", {"n": 1}, lambda f: (f / "data").write_text("one"))

    def fail(at):
        if at == step:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        publish.publish(tmp_path, "g2", {"n": 2}, lambda f: (f / "data").write_text("two"), fail)
    folder, manifest = publish.current(tmp_path)
    assert folder.name == "g1" and manifest["n"] == 1
    assert (tmp_path / "generations" / "g2").exists() == (step in ("renamed", "pointer"))
    publish.publish(tmp_path, "g3", {"n": 3}, lambda f: None)
    assert publish.current(tmp_path)[1]["n"] == 3
    with pytest.raises(FileExistsError):
        publish.publish(tmp_path, "g3", {"n": 4}, lambda f: None)


def test_what_was_published_is_verified(tmp_path):
    target = publish.publish(tmp_path, "g1", {}, lambda f: (f / "data").write_text("one"))
    files = publish.file_set(target)
    publish.verify_files(target, files)
    (target / "data").write_text("changed")
    with pytest.raises(documents.DocumentError, match="content"):
        publish.verify_files(target, files)
    (target / "more").write_text("")
    with pytest.raises(documents.DocumentError, match="more"):
        publish.verify_files(target, files)
    (target / "generation.json").write_text("{}")
    with pytest.raises(documents.DocumentError):
        publish.current(tmp_path)
    (target / "link").symlink_to(target / "data")
    with pytest.raises(documents.DocumentError):
        publish.file_set(target)


def test_pictures(spark, tmp_path):
    rows = spark.createDataFrame([("a/1.png", bytearray(b"one")), ("b/2.png", bytearray(b"two"))], "local_path string, content binary")
    pictures.write_pictures(rows, str(tmp_path / "out"))
    pictures.write_pictures(rows, str(tmp_path / "out"))
    assert {p.relative_to(tmp_path / "out").as_posix(): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {"a/1.png": b"one", "b/2.png": b"two"}
    read = pictures.read_pictures(spark, str(tmp_path / "out"), "*.png")
    assert {(r["size"], r["content_sha256"]) for r in read.collect()} == {(3, documents.sha256(b"one")), (3, documents.sha256(b"two"))}
    assert {bytes(r["content"]) for r in pictures.transformed(read, "content", bytes.upper).collect()} == {b"ONE", b"TWO"}


def test_fetching_tries_again(spark, tmp_path):
    log = tmp_path / "log"

    def fetch(url):
        with log.open("a") as out:
            out.write("x")
        if log.stat().st_size < 3:
            raise OSError("later")
        return b"" if url == "empty" else url.encode()

    urls = spark.createDataFrame([("u",)], "url string")
    assert bytes(pictures.fetched(urls, "url", fetch, pause=lambda s: None).first()["content"]) == b"u" and log.stat().st_size == 3
    with pytest.raises(Exception, match="empty picture"):
        pictures.fetched(urls.withColumn("url", F.lit("empty")), "url", fetch, pause=lambda s: None).collect()
    with pytest.raises(Exception, match="always"):
        pictures.fetched(urls, "url", lambda u: (_ for _ in ()).throw(OSError("always")), tries=2, pause=lambda s: None).collect()


def test_shards(spark, tmp_path):
    names = [f"p/{i}.parquet" for i in range(9)]
    first = shards.pick_shards(spark, [*names, names[0], "p/readme"], "s", 4)
    assert len(first) == 4 and first == shards.pick_shards(spark, names[::-1], "s", 9)[:4]
    with pytest.raises(ValueError):
        shards.pick_shards(spark, names, "s", 10)
    row = ("k", "0" * 64, "1", "c", "src", "mit", bytearray(b"x"))
    df = spark.createDataFrame([row], "`__key__` string, hash_sha256 string, hash_perceptual string, sscd_cluster_id string, source string, license string, thumbnail binary")
    df.withColumn("other", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "raw"))
    read = shards.read_raw(spark, str(tmp_path / "raw"))
    assert read.columns == [*shards.RAW_COLUMNS, "shard"] and read.first()["shard"].endswith(".parquet")
    assert "other" not in read._jdf.queryExecution().executedPlan().toString()


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(Conf)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(Session())
