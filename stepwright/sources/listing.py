"""A dataset's files over HTTP: listing page by page, download with resume. The transport is a function, so tests need no network."""

from __future__ import annotations

import os
import re
import urllib.request
from collections.abc import Callable, Iterator

CHUNK = 1 << 20
#: (url) -> (headers, iterator of byte chunks)
Fetch = Callable[[str], tuple[dict[str, str], Iterator[bytes]]]


def http(url: str) -> tuple[dict[str, str], Iterator[bytes]]:
    answer = urllib.request.urlopen(url, timeout=60)  # noqa: S310
    return dict(answer.headers.items()), iter(lambda: answer.read(CHUNK), b"")


def next_url(headers: dict[str, str]) -> str | None:
    """The rel="next" target of a Link header."""
    link = next((v for k, v in headers.items() if k.lower() == "link"), "")
    m = re.search(r'<([^>]+)>\s*;\s*rel="?next"?', link)
    return m[1] if m else None


def pages(url: str, fetch: Fetch = http) -> Iterator[bytes]:
    """The bodies of a listing's pages, following the next links; a page that was seen ends it."""
    seen: set[str] = set()
    at: str | None = url
    while at and at not in seen:
        seen.add(at)
        headers, body = fetch(at)
        yield b"".join(body)
        at = next_url(headers)


def download(url: str, path: str, suffix: str = ".jsonl", fetch: Fetch = http) -> bool:
    """Store url at path as a whole; False if the file is there already. Other files than those with the suffix are refused."""
    if not path.endswith(suffix):
        raise ValueError(f"{path} does not end in {suffix}")
    if os.path.exists(path):
        return False
    with open(f"{path}.part", "wb") as f:
        for chunk in fetch(url)[1]:
            f.write(chunk)
    os.replace(f"{path}.part", path)
    return True
