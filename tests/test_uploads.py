import io
import os
import zipfile

import pytest
from marlstone.sources import uploads as U


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, content binary")


def listed(found):
    return sorted((r.name, r.duplicate) for r in found.documents.collect()), sorted(map(tuple, found.rejected.collect()), key=repr)


def test_configurations():
    assert U.check_configuration({})["embedding_model"] == "bge-m3"
    for bad in ([], {"indexing_technique": "economy", "segmentation": {"mode": "parent_child"}}, {"embedding_model": ""}, {"indexing_technique": "other"}):
        with pytest.raises(U.ConfigurationError):
            U.check_configuration(bad)
    assert U.check_configuration({"indexing_technique": "economy", "embedding_model": None})["segmentation"] == {"mode": "general"}


def test_ingest_and_compensation(spark, tmp_path):
    root, confirmed, sent = str(tmp_path / "uploads"), [], []
    climbing = io.BytesIO()
    with zipfile.ZipFile(climbing, "w") as z:
        z.writestr("../x", "y")
    first = files(spark, ("a.txt", b"one"), ("b.md", b"two"), ("c.txt", b"one"), ("d.exe", b"x"), ("e.txt", None), ("f.docx", climbing.getvalue()), ("g", b"x"), (None, b"n"), ("h.png", b"no image"), ("z.docx", b"PK\x03\x04 no archive"))

    def failing(documents, config):
        assert documents.count() == 3
        raise RuntimeError("confirm")

    with pytest.raises(RuntimeError, match="confirm"):
        U.ingest(first, root, {}, failing)
    assert os.listdir(root) == [] and U.stored(spark, root).count() == 0

    found = U.ingest(first, root, {}, lambda d, c: confirmed.append((d.count(), c["indexing_technique"])), lambda d: sent.append(d.count()))
    assert found.status == "queued" and confirmed == [(3, "high_quality")] and sent == [3]
    expected = [("d.exe", "UNSUPPORTED_FILE_TYPE"), ("e.txt", "EMPTY_FILE"), ("f.docx", "ARCHIVE_UNSAFE_PATH"), ("g", "UNSUPPORTED_FILE_TYPE"), (None, "UNSUPPORTED_FILE_TYPE"), ("h.png", "INVALID_FILE_SIGNATURE"), ("z.docx", "INVALID_FILE_SIGNATURE")]
    assert listed(found) == ([("a.txt", False), ("b.md", False), ("c.txt", True)], sorted(expected, key=repr))
    assert sorted((r.name, bytes(r.content)) for r in U.stored(spark, root).collect()) == [("a.txt", b"one"), ("b.md", b"two")]

    # a second batch: what the first one stored stays when it fails
    second = files(spark, ("again.txt", b"one"), ("new.txt", b"three"))
    with pytest.raises(RuntimeError):
        U.ingest(second, root, {}, lambda d, c: (_ for _ in ()).throw(RuntimeError()))
    assert sorted(r.name for r in U.stored(spark, root).collect()) == ["a.txt", "b.md"]

    def broken(documents):
        raise OSError

    later = U.ingest(second, root, {}, lambda d, c: None, broken)
    assert later.status == "pending" and listed(later) == ([("again.txt", True), ("new.txt", False)], [])
    ids = {r.sha256: r.document_id for r in U.stored(spark, root).collect()}
    assert {(r.sha256, r.document_id) for r in later.documents.collect()} <= set(ids.items()) and len(ids) == 3


def test_nothing_accepted(spark, tmp_path):
    root = str(tmp_path / "uploads")
    for rows in ([], [("x.exe", b"1")]):
        found = U.ingest(files(spark, *rows), root, {}, lambda d, c: pytest.fail("nothing to confirm"))
        assert found.status == "rejected" and found.rejected.count() == len(rows) and U.stored(spark, root).count() == 0
    with pytest.raises(U.ConfigurationError):
        U.ingest(files(spark, ("a.txt", b"one")), root, {"embedding_model": ""}, lambda d, c: None)
    assert U.stored(spark, root).count() == 0


def test_failing_clean_up_keeps_the_error(spark, tmp_path):
    def delete(session, folder):
        raise OSError

    with pytest.raises(RuntimeError, match="confirm"):
        U.ingest(files(spark, ("a.txt", b"one")), str(tmp_path / "u"), {}, lambda d, c: (_ for _ in ()).throw(RuntimeError("confirm")), delete=delete)
