"""Archives unpacked with guards, and raw files kept as they came."""

from __future__ import annotations

import hashlib
import os
import shutil
import zipfile

from ..errors import EngineError

MAX_FILES, MAX_BYTES, MAX_RATIO, RATIO_FROM = 20_000, 8 << 30, 200, 256 << 20


def safe_extract(path: str, target: str, max_files: int = MAX_FILES) -> list[str]:
    """Members of a zip archive, unpacked; paths that leave the folder, bombs and empty archives are refused."""

    def refuse(why: str) -> EngineError:
        return EngineError("ARCHIVE_UNSAFE", why, path=path)

    out, root = [], os.path.realpath(target)
    with zipfile.ZipFile(path) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if not infos:
            raise refuse("no files")
        if len(infos) > max_files:
            raise refuse(f"{len(infos)} files")
        total = sum(i.file_size for i in infos)
        packed = max(1, sum(i.compress_size for i in infos))
        if total > MAX_BYTES or total > RATIO_FROM and total / packed > MAX_RATIO:
            raise refuse(f"{total} bytes from {packed}")
        for i in infos:
            place = os.path.realpath(os.path.join(root, i.filename))
            if not place.startswith(root + os.sep):
                raise refuse(f"member {i.filename!r} leaves the folder")
        for i in infos:
            place = os.path.join(root, i.filename)
            os.makedirs(os.path.dirname(place), exist_ok=True)
            with z.open(i) as source, open(place, "wb") as f:
                shutil.copyfileobj(source, f, 1 << 20)
            out.append(place)
    return out


def sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def ingest(path: str, raw: str) -> str:
    """A copy of a file under ``raw``, named by its content, written once and then read-only."""
    with open(path, "rb") as f:
        head = f.read(65536)
    if os.path.splitext(path)[1].lower() in (".csv", ".tsv", ".zip", ".parquet", ".xlsx") and b"<html" in head[:4096].lower():
        raise EngineError("DOWNLOAD_NOT_DATA", "a web page under a data file's name", path=path)
    place = os.path.join(raw, sha256(path)[:16], os.path.basename(path))
    if not os.path.exists(place):
        os.makedirs(os.path.dirname(place), exist_ok=True)
        shutil.copyfile(path, place + ".part")
        os.replace(place + ".part", place)
        os.chmod(place, 0o444)
    return place


def guard_raw(path: str, raw: str) -> None:
    if os.path.realpath(path).startswith(os.path.realpath(raw) + os.sep):
        raise EngineError("RAW_IMMUTABLE", "raw files aren't written", path=path)
