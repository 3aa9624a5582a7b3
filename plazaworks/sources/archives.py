"""Documents inside ZIP archives: listing, and the text of office and plain files."""

from __future__ import annotations

import codecs
import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from html import unescape
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: A larger file's text isn't read; texts are cut to so many characters.
MOST_BYTES, MOST_CHARS = 128 << 20, 180_000
LISTED = "archive string, path string, byte_len long, sha256 string, kind string"
READ = f"{LISTED}, text string, note string"


def entry_name(info: zipfile.ZipInfo) -> str:
    """The entry's name; names not marked as UTF-8 are in code page 852."""
    if info.flag_bits & 0x800:
        return info.filename
    return info.orig_filename.encode("cp437", "replace").decode("cp852", "replace")


def wanted(name: str) -> bool:
    """No folder, no way out of the archive, nothing that a system or editor left."""
    parts = name.replace("\\", "/").split("/")
    return not (name.endswith("/") or name.startswith("/") or re.match("[A-Za-z]:", name) or ".." in parts or "__MACOSX" in parts or parts[-1].startswith("."))


def kind_of(name: str) -> str:
    ext = name.lower().rsplit(".", 1)[-1]
    if ext in ("pdf", "docx", "odt", "rtf"):
        return ext
    return "text" if ext in ("txt", "md", "html", "htm") else "other"


def decoded(data: bytes, header: str | None = None) -> str:
    """Text by the header's charset, else the one a meta tag in the first 2048 bytes names, else UTF-8."""
    named = re.search(r"charset=[\"']?([\w-]+)", header or "", re.I) or re.search(r"<meta[^>]+charset=[\"']?([\w-]+)", data[:2048].decode("latin-1"), re.I)
    try:
        charset = codecs.lookup(named[1]).name if named else "utf-8"
    except LookupError:
        charset = "utf-8"
    return data.decode(charset, "replace")


def office_text(data: bytes, kind: str) -> str:
    """Paragraphs of a docx or odt file's XML, a line each."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        xml = archive.read("word/document.xml" if kind == "docx" else "content.xml").decode("utf-8", "replace")
    xml = re.sub(r"</(?:w:p|text:p|text:h)>|<(?:w:br|text:line-break)[^>]*/>", "\n", xml)
    xml = re.sub(r"<(?:w:tab|text:tab)[^>]*/>", "\t", xml)
    return unescape(re.sub(r"<[^>]*>", "", xml)).strip()


def rtf_text(data: bytes) -> str:
    """Text of an RTF file without its groups of fonts, colours and pictures."""
    text = data.decode("latin-1")
    text = re.sub(r"\{\\(?:\*|fonttbl|colortbl|stylesheet|info|pict)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
    text = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1250", "replace"), text)
    text = re.sub(r"\\(?:par|line)\b ?", "\n", text)
    return re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d* ?", "", text)).strip()


def text_of(data: bytes, kind: str) -> tuple[str | None, str | None]:
    """(text, note): the note says what is missing and why."""
    try:
        if kind in ("docx", "odt"):
            text = office_text(data, kind)
        elif kind == "rtf":
            text = rtf_text(data)
        elif kind == "text":
            text = data.decode("utf-8", "replace")
        else:
            return None, f"no reader for {kind} files here"
    except Exception as error:  # noqa: BLE001 - whatever a file has wrong is said of that file
        return None, f"unreadable: {type(error).__name__}: {error}"
    return text[:MOST_CHARS], f"cut to {MOST_CHARS} characters" if len(text) > MOST_CHARS else None


@contextmanager
def opened(uri: str) -> Iterator[BinaryIO]:
    """A file to read from anywhere: only what is asked for is read."""
    system, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    with system.open_input_file(path) as file:
        yield file


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pd.DataFrame(rows, columns=list(names)).astype({n: "Int64" for n, k in zip(names, kinds, strict=True) if k == "long"})


_MEMBER = "archive string, ordinal long, path string, byte_len long, note string"


def listed_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, ordinal, path, byte_len, note): a row for each wanted member of the archives at path.

    Only the archives' directories are read. One that can't be opened is one
    row with a note and no path.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in frame["path"]:
                try:
                    with opened(name) as file, zipfile.ZipFile(file) as archive:
                        rows = [(name, k, entry_name(info), info.file_size, None) for k, info in enumerate(archive.infolist()) if wanted(entry_name(info))]
                except Exception as error:  # noqa: BLE001 - an archive that is no archive is a row
                    rows = [(name, None, None, None, f"unreadable: {type(error).__name__}: {error}")]
                yield _frame(rows, _MEMBER)

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(work, _MEMBER)


def read_members(members: DataFrame) -> DataFrame:
    """(archive, path, byte_len, sha256, kind, text, note) of members listed by listed_archives(), any selection of them.

    Each member is a row of its own, dealt over all tasks, and read from its
    archive by its place. What is wrong with one (encrypted, damaged, too
    large, whatever its header claims) is its note.
    """

    def read(archive: zipfile.ZipFile, row) -> tuple:
        entry, kind = row.path, kind_of(row.path)
        try:
            with archive.open(archive.infolist()[int(row.ordinal)]) as file:
                data = file.read(MOST_BYTES + 1)
        except Exception as error:  # noqa: BLE001
            return row.archive, entry, row.byte_len, None, kind, None, f"unreadable: {type(error).__name__}: {error}"
        if len(data) > MOST_BYTES:
            return row.archive, entry, row.byte_len, None, kind, None, f"larger than {MOST_BYTES} bytes"
        return row.archive, entry, len(data), hashlib.sha256(data).hexdigest(), kind, *text_of(data, kind)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, rows in frame.groupby("archive", sort=False):
                broken = rows[rows["ordinal"].isna()]
                if len(broken):
                    yield _frame([(name, None, None, None, None, None, note) for note in broken["note"]], READ)
                rows = rows[rows["ordinal"].notna()]
                if not len(rows):
                    continue
                with ExitStack() as stack:
                    try:
                        archive = stack.enter_context(zipfile.ZipFile(stack.enter_context(opened(name))))
                    except Exception as error:  # noqa: BLE001 - gone or changed since it was listed
                        note = f"unreadable: {type(error).__name__}: {error}"
                        yield _frame([(name, row.path, row.byte_len, None, kind_of(row.path), None, note) for row in rows.itertuples(index=False)], READ)
                        continue
                    for row in rows.itertuples(index=False):
                        yield _frame([read(archive, row)], READ)

    return members.repartition("archive", "ordinal").mapInPandas(work, READ)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file in the archives at path, with its text as far as it can be read.

    Archives of many GB are never held whole: see listed_archives() and read_members().
    """
    return read_members(listed_archives(spark, path))
