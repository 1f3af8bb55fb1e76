"""Export and import of a knowledge base as one ZIP archive."""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
import zipfile

from .decode import ParseError, unsafe_path

#: Fixed values of the format and its bounds.
VERSION = 2
REQUIRED = ("manifest.json", "dataset.json", "retrieval.json", "documents.json")
MAX_FILES, MAX_FILE_BYTES, MAX_BYTES = 10_000, 512 * 1024 * 1024, 2 * 1024**3


def safe_name(name: str) -> str:
    """Last part of a path, with word characters, dots, dashes and spaces."""
    kept = re.sub(r"[^\w. -]", "_", name.replace("\\", "/").rpartition("/")[2]).strip(". ")
    return kept[:180] or "file"


def _compact(value) -> bytes:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode()


def export_archive(out, dataset: dict, retrieval: dict, documents: list[dict], revisions: list[dict], contents) -> None:
    """Write the archive to a binary file; contents(document_id) gives a document's bytes or None.

    One knowledge base is one archive, so this runs on the driver or in one task; bytes are written one file at a time.
    """
    files, listed = [], []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d in documents:
            path, data = f"files/{d['id']}/{safe_name(d['name'])}", contents(d["id"])
            listed.append({k: v for k, v in d.items() if k != "object_key"} | {"archive_path": path})
            if data is not None:
                z.writestr(path, data)
                files.append({"path": path, "sha256": hashlib.sha256(data).hexdigest(), "size": len(data)})
        body = _compact(revisions)
        z.writestr("revisions.json", body)
        files.append({"path": "revisions.json", "sha256": hashlib.sha256(body).hexdigest(), "size": len(body)})
        for name, value in (("dataset.json", dataset), ("retrieval.json", retrieval), ("documents.json", listed)):
            z.writestr(name, _compact(value))
        z.writestr("manifest.json", _compact({"format_version": VERSION, "source_dataset_id": dataset["id"], "document_count": len(listed), "files": files}))


def import_archive(data: bytes, new_id=lambda: uuid.uuid4().hex) -> dict:
    """dataset, retrieval, documents (fresh ids, bytes, revisions with remapped parents); any breach raises ParseError."""
    if len(data) > MAX_BYTES:
        raise ParseError("ARCHIVE_TOO_LARGE")
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ParseError("ARCHIVE_INVALID") from e
    names = z.namelist()
    if len(names) != len(set(names)) or len(names) > MAX_FILES + 5 or any(unsafe_path(n) or "\\" in n or "//" in n or "/./" in n for n in names):
        raise ParseError("ARCHIVE_UNSAFE_PATH")
    if any(i.file_size > MAX_FILE_BYTES for i in z.infolist()) or sum(i.file_size for i in z.infolist()) > MAX_BYTES:
        raise ParseError("ARCHIVE_TOO_LARGE")
    if not set(REQUIRED) <= set(names):
        raise ParseError("ARCHIVE_INCOMPLETE")
    try:
        manifest, dataset, retrieval, documents = (json.loads(z.read(n)) for n in REQUIRED)
        entries = {f["path"]: f for f in manifest["files"]}
        if manifest["format_version"] not in (1, 2) or manifest["document_count"] != len(documents) or len(entries) != len(manifest["files"]):
            raise ParseError("ARCHIVE_INVALID")
    except (ValueError, KeyError, TypeError) as e:
        raise e if isinstance(e, ParseError) else ParseError("ARCHIVE_INVALID") from e

    def checked(path: str) -> bytes:
        body, entry = z.read(path) if path in names else None, entries.get(path)
        if body is None or entry is None or len(body) != entry["size"] or hashlib.sha256(body).hexdigest() != entry["sha256"]:
            raise ParseError("ARCHIVE_HASH_MISMATCH")
        return body

    revisions: dict[str, list] = {}
    if manifest["format_version"] == 2:
        known, seen = {d["id"] for d in documents}, set()
        for r in json.loads(checked("revisions.json")):
            key = (r["document_id"], r["version"])
            if r["document_id"] not in known or key in seen:
                raise ParseError("ARCHIVE_REVISION_INVALID")
            seen.add(key)
            fresh = {item["id"]: new_id() for item in r["segments"]["items"]}
            items = [i | {"id": fresh[i["id"]], "parent_id": fresh[i["parent_id"]] if i.get("parent_id") is not None else None} for i in r["segments"]["items"]]
            revisions.setdefault(r["document_id"], []).append(r | {"segments": {"items": items}})
    elif "revisions.json" in names:
        raise ParseError("ARCHIVE_REVISION_INVALID")
    out = []
    for k, d in enumerate(documents, 1):
        out.append(d | {"id": new_id(), "imported_document_id": d["id"], "content": checked(d["archive_path"]), "position": d.get("position", k), "status": "waiting", "revisions": revisions.get(d["id"], [])})
    return {"dataset": dataset | {"id": new_id()}, "retrieval": retrieval, "documents": out}
