"""Archives from the network: conditional downloads into a shared folder, with a cap and a digest."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame

#: Bytes of an archive that is kept, times a busy server is asked, and seconds before the second time.
CAP, TRIES, WAIT_S = 6 << 30, 3, 2.0

_ANSWER = "status int, sha256 string, byte_len long, etag string, last_modified string, too_large boolean, file string, note string"


@dataclass
class Answer:
    """What a server says; body in parts, read as far as needed."""

    status: int
    body: Iterable[bytes] = field(default_factory=tuple)
    etag: str | None = None
    last_modified: str | None = None
    length: int | None = None


#: Asks for an address, with the ETag of what is there already.
Fetch = Callable[[str, str | None], Answer]


def _once(url: str, etag: str | None, fetch: Fetch, folder: str, cap: int) -> tuple:
    answer = fetch(url, etag)
    if answer.status == 304:
        return 304, None, 0, etag, None, False, None, "unchanged"
    if answer.status == 429 or answer.status >= 500:
        raise OSError(f"{url} returned {answer.status}")
    if not 200 <= answer.status < 300:
        return answer.status, None, 0, answer.etag, answer.last_modified, False, None, f"status {answer.status}"
    if answer.length is not None and answer.length > cap:
        return answer.status, None, answer.length, None, None, True, None, f"larger than {cap} bytes"
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    path, digest, size = f"{base}/{uuid.uuid4().hex}", hashlib.sha256(), 0
    try:
        with system.open_output_stream(path) as out:
            for part in answer.body:
                size += len(part)
                if size > cap:
                    break
                digest.update(part)
                out.write(part)
    except Exception:
        system.delete_file(path)
        raise
    if size > cap:
        system.delete_file(path)
        return answer.status, None, size, answer.etag, answer.last_modified, True, None, f"larger than {cap} bytes"
    return answer.status, digest.hexdigest(), size, answer.etag, answer.last_modified, False, f"{folder.rstrip('/')}/{path.rsplit('/', 1)[-1]}", None


def downloaded(urls: DataFrame, fetch: Fetch, folder: str, cap: int = CAP, wait_s: float = WAIT_S) -> DataFrame:
    """urls (url, etag and others) with status, sha256, byte_len, new etag and last_modified, too_large, file and note.

    Files go to folder, which all executors share; memory holds one part of a
    body. An unchanged archive (304) and one larger than cap have no file. A
    server that fails is asked again, each time later; after the last time the
    row has no status, and the note says why.
    """

    def ask(url: str, etag: str | None) -> tuple:
        for k in range(1, TRIES + 1):
            try:
                return _once(url, etag, fetch, folder, cap)
            except Exception as error:  # noqa: BLE001 - whatever fails is the row's note
                note = f"{type(error).__name__}: {error}"
                if k < TRIES:
                    time.sleep(wait_s * k)
        return None, None, 0, etag, None, False, None, note

    names = [c.split()[0] for c in _ANSWER.split(", ")]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(len(frame)):
                row = frame.iloc[k : k + 1]
                etag = row["etag"].iloc[0]
                answer = pd.DataFrame([ask(row["url"].iloc[0], None if pd.isna(etag) else etag)], columns=names, index=row.index).astype({"status": "Int32"})
                yield pd.concat([row.drop(columns="etag"), answer], axis=1)

    rest = urls.drop("etag")
    schema = ", ".join([*(f"`{n}` {t}" for n, t in rest.dtypes), _ANSWER])
    return urls.mapInPandas(work, schema)
