"""Test data from a release: its list of assets, downloads with retries, archives unpacked."""

from __future__ import annotations

import json
import os
import tarfile
import time
import urllib.request
import zipfile
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

RETRIES, DELAY = 3, 5.0


@dataclass(frozen=True)
class Asset:
    name: str
    url: str
    size: int = 0


def fetch(url: str, token: str | None = None, retries: int = RETRIES, delay: float = DELAY) -> bytes:
    """The content behind a URL; tried again after a pause when it fails."""
    for n in range(retries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})) as f:  # noqa: S310  the user names the release
                return f.read()
        except OSError:
            if n + 1 == retries:
                raise
            time.sleep(delay)
    raise ValueError("retries must be positive")


def assets(release_url: str, token: str | None = None) -> list[Asset]:
    """The assets of a release document (JSON with ``assets``: name, browser_download_url, size)."""
    return [Asset(a["name"], a["browser_download_url"], a.get("size", 0)) for a in json.loads(fetch(release_url, token)).get("assets", [])]


def unpack(path: str, folder: str) -> list[str]:
    """The files of a tar or zip archive, unpacked below a folder; members that would leave it are refused."""
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as z:
            names = z.namelist()
            root = os.path.realpath(folder)
            if any(not os.path.realpath(os.path.join(folder, n)).startswith(root + os.sep) for n in names):
                raise ValueError(f"{path} holds a file outside its folder")
            z.extractall(folder)
    else:
        with tarfile.open(path) as t:
            names = t.getnames()
            t.extractall(folder, filter="data")
    return [os.path.join(folder, n) for n in names]


def download(wanted: list[Asset], dest: str, token: str | None = None, retries: int = RETRIES, delay: float = DELAY) -> dict[str, list[str]]:
    """Downloads assets that aren't there yet and unpacks archives: name to files."""
    os.makedirs(dest, exist_ok=True)

    def one(a: Asset) -> tuple[str, list[str]]:
        path = os.path.join(dest, a.name)
        if not os.path.exists(path):
            with open(path + ".part", "wb") as f:
                f.write(fetch(a.url, token, retries, delay))
            os.replace(path + ".part", path)
        archive = a.name.endswith((".tar.gz", ".tgz", ".tar", ".zip"))
        return a.name, unpack(path, dest) if archive else [path]

    with ThreadPoolExecutor(4) as pool:
        return dict(pool.map(one, wanted))
