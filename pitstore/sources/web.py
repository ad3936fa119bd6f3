"""Documents over HTTP: asked for only if changed, kept by content address, read by Spark from there."""

from __future__ import annotations

import hashlib
import os
import urllib.error
import urllib.request
from dataclasses import dataclass
from pathlib import Path
from typing import Callable

from .journal import read_json, replace_json

#: What a document's content type must hold, by kind of collector: an error page is no empty document.
CONTENT = {"http_json": "json", "http_csv": "csv"}


@dataclass(frozen=True)
class Document:
    """A landed document, or why there is none: `unchanged`, or a failure in words."""

    path: str = ""
    sha256: str = ""
    size: int = 0
    problem: str | None = None


def keep(root: str, body: bytes) -> tuple[str, str]:
    """(path, sha256): the bytes under their own hash; the same bytes are kept once."""
    digest = hashlib.sha256(body).hexdigest()
    path = Path(root, "raw", digest[:2], digest)
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(f".{os.getpid()}")
        part.write_bytes(body)
        os.replace(part, path)
    return str(path), digest


def fetch(root: str, name: str, url: str, wanted: str, headers: dict[str, str] | None = None, opener: Callable = urllib.request.urlopen, timeout: float = 30.0) -> Document:
    """One conditional GET; never raises for what a server does. opener: as urllib's urlopen(request, timeout=).

    remember() stores the validators (ETag, Last-Modified) of what was collected, so a restart asks with them
    and a document that failed on the way into the store is asked for again.
    """
    known = read_json(_validators(root, name))
    asked = {"User-Agent": "pitstore", **(headers or {})}
    if known.get("url") == url:
        asked |= {h: known[h] for h in ("If-None-Match", "If-Modified-Since") if known.get(h)}
    try:
        with opener(urllib.request.Request(url, headers=asked), timeout=timeout) as answer:
            body, kind = answer.read(), str(answer.headers.get("Content-Type", "")).lower()
            seen = {"url": url, "If-None-Match": answer.headers.get("ETag"), "If-Modified-Since": answer.headers.get("Last-Modified")}
    except urllib.error.HTTPError as e:
        return Document(problem="unchanged" if e.code == 304 else f"status {e.code}")
    except (OSError, ValueError) as e:
        return Document(problem=f"no answer: {e}")
    if wanted not in kind:
        return Document(problem=f"content type {kind!r}, not {wanted}")
    if not body:
        return Document(problem="empty document")
    path, digest = keep(root, body)
    replace_json(_validators(root, name) + ".new", seen | {"sha256": digest})
    return Document(path, digest, len(body))


def remember(root: str, name: str) -> None:
    new = _validators(root, name) + ".new"
    if os.path.exists(new):
        os.replace(new, _validators(root, name))


def _validators(root: str, name: str) -> str:
    return os.path.join(root, "status", "web", f"{name}.json")
