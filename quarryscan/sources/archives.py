"""Entries of zip and asar archives and of .NET single-file programs as rows, with limits against hostile ones.

Spark deals the archives to tasks; a task opens one at a time and gives its entries one by one.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .artifacts import BUNDLE_MARK

# Entries, bytes of one and of all entries, and the ratio of plain to packed bytes.
MOST_ENTRIES, MOST_BYTES, MOST_TOTAL, MOST_RATIO = 20_000, 32 << 20, 512 << 20, 200
#: Levels of an asar's folders, and programs opened inside an archive.
DEPTH, MOST_NESTED = 64, 20
SCHEMA = "artifact_id string, file_ord int, path string, bytes bigint, data binary, note string"


def unsafe(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return not name or name.startswith(("/", "\\")) or (len(name) > 1 and name[1] == ":") or ".." in parts or "\0" in name


def zip_entries(data: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    """name, bytes and note: a note where an entry is left out."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, EOFError):
        yield "", None, "the archive could not be read"
        return
    total = 0
    infos = [i for i in archive.infolist() if not i.is_dir()]
    if len(infos) > MOST_ENTRIES:
        yield "", None, f"only the first {MOST_ENTRIES} entries were read"
    for info in infos[:MOST_ENTRIES]:
        if unsafe(info.filename):
            yield info.filename, None, "an entry outside the archive's folder"
        elif info.file_size > MOST_BYTES or info.file_size > MOST_RATIO * max(info.compress_size, 1):
            yield info.filename, None, "an entry that is too large"
        elif total >= MOST_TOTAL:
            yield info.filename, None, "the archive's budget is spent"
        else:
            try:
                with archive.open(info) as f:
                    body = f.read(MOST_BYTES + 1)
            except (zipfile.BadZipFile, OSError, NotImplementedError, RuntimeError, EOFError):
                yield info.filename, None, "an entry could not be read"
                continue
            total += len(body)
            yield (info.filename, None, "an entry that is too large") if len(body) > MOST_BYTES else (info.filename, body, None)


def asar_entries(data: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    """Files of an asar: a JSON tree after sixteen bytes of sizes, bodies behind it."""
    header = int.from_bytes(data[12:16], "little")
    begin = 8 + int.from_bytes(data[4:8], "little")
    try:
        tree = json.loads(data[16 : 16 + header])
    except (ValueError, RecursionError):
        yield "", None, "the archive could not be read"
        return

    def walk(node: object, prefix: str, depth: int) -> Iterator[tuple[str, bytes | None, str | None]]:
        files = node.get("files") if isinstance(node, dict) and depth <= DEPTH else None
        for name, child in files.items() if isinstance(files, dict) else ():
            path = f"{prefix}{name}"
            if not isinstance(child, dict) or unsafe(path):
                yield path, None, "an entry outside the archive's folder"
            elif "files" in child:
                yield from walk(child, path + "/", depth + 1)
            elif not child.get("unpacked"):
                try:
                    at, size = begin + int(child["offset"]), int(child["size"])
                except (KeyError, TypeError, ValueError):
                    yield path, None, "an entry without a place"
                    continue
                if size > MOST_BYTES or at < begin or size < 0 or at + size > len(data):
                    yield path, None, "an entry that is too large or outside the archive"
                else:
                    yield path, data[at : at + size], None

    yield from walk(tree, "", 0)


BUNDLE_SIGNATURE = bytes.fromhex(BUNDLE_MARK)


def bundle_entries(data: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    """Files of a .NET single-file program: the header's place stands before the signature, entries follow the header.

    Layout by version: entries have offset and size, from 6 on a packed size, then a type and a path; from 2 on the header holds the places
    of two settings files and flags.
    """
    at = data.find(BUNDLE_SIGNATURE)
    try:
        (here,) = struct.unpack_from("<q", data, at - 8)
        major, _, count = struct.unpack_from("<IIi", data, here)
    except struct.error:
        yield "", None, "the program could not be read"
        return
    here += 12

    def text() -> str:
        nonlocal here
        n, shift = 0, 0
        while True:
            byte = data[here]
            here += 1
            n |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80 or shift > 28:
                break
        here += n
        return data[here - n : here].decode("utf-8", "replace")

    try:
        text()
        here += 40 if major >= 2 else 0
        for _ in range(min(max(count, 0), MOST_ENTRIES)):
            offset, size, *packed = struct.unpack_from("<qqq" if major >= 6 else "<qq", data, here)
            here += 24 if major >= 6 else 16
            here += 1
            path = text()
            stored = packed[0] if packed and packed[0] else 0
            length = stored or size
            if unsafe(path) or size < 0 or size > MOST_BYTES or offset < 0 or offset + length > len(data):
                yield path, None, "an entry that is too large or outside the program"
            elif stored:
                inflate = zlib.decompressobj(-15)
                body = inflate.decompress(data[offset : offset + stored], MOST_BYTES)
                yield (path, body, None) if len(body) == size else (path, None, "an entry could not be read")
            else:
                yield path, data[offset : offset + size], None
    except (struct.error, IndexError, zlib.error):
        yield "", None, "the program could not be read to its end"


def interesting(path: str) -> bool:
    """Of packages inside node_modules only their package.json."""
    return "node_modules/" not in path or path.endswith("/package.json")


def _is_asar(data: bytes) -> bool:
    return data[:4] == b"\4\0\0\0" and data[16:25] == b'{"files":'


def entries(archives: DataFrame) -> DataFrame:
    """artifact_id, file_ord, path, bytes, data, note of the entries of zip and asar archives and single-file programs (artifact_id, data).

    An app.asar inside a zip is opened too, at most twenty of them.
    """

    def opened(data: bytes, nested: list[int]) -> Iterator[tuple[str, bytes | None, str | None]]:
        reader = asar_entries if _is_asar(data) else bundle_entries if data[:2] == b"MZ" and BUNDLE_SIGNATURE in data else zip_entries
        for name, body, note in reader(data):
            if body is not None and _is_asar(body) and nested[0] < MOST_NESTED:
                nested[0] += 1
                yield from ((f"{name}/{n}", b, w) for n, b, w in asar_entries(body) if interesting(n))
            elif interesting(name):
                yield name, body, note

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for artifact, data in zip(batch["artifact_id"], batch["data"]):
                for i, (name, body, note) in enumerate(opened(bytes(data) if data is not None else b"", [0])):
                    yield pd.DataFrame({"artifact_id": [artifact], "file_ord": [i], "path": [name], "bytes": [len(body) if body is not None else 0], "data": [body], "note": [note]})

    return archives.select("artifact_id", "data").mapInPandas(run, SCHEMA)


def names(archives: DataFrame) -> DataFrame:
    """artifact_id, names: the entry names of zip archives, for telling their kind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for data in batch["data"]:
                try:
                    out.append(zipfile.ZipFile(io.BytesIO(bytes(data))).namelist()[:MOST_ENTRIES])
                except (zipfile.BadZipFile, ValueError, TypeError):
                    out.append([])
            yield pd.DataFrame({"artifact_id": batch["artifact_id"], "names": out})

    return archives.select("artifact_id", "data").mapInPandas(run, "artifact_id string, names array<string>")
