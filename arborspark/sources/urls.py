"""URLs of scan roots: file, s3, r2, gcs, az and ssh, with the shorthand ``host:/path``."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Other names of schemes (fixed values).
SCHEMES = {"gs": "gcs", "gcs": "gcs", "s3": "s3", "s3a": "s3", "r2": "r2", "az": "az", "file": "file", "ssh": "ssh"}


@dataclass(frozen=True)
class Url:
    scheme: str
    host: str
    path: str

    @property
    def canonical(self) -> str:
        if self.scheme == "file":
            return self.path or "/"
        return f"{self.scheme}://{self.host}" + (f"/{self.path}" if self.path else "")


def _tidy(path: str) -> str:
    return re.sub("/+", "/", path).rstrip("/")


def parse(text: str) -> Url:
    """A URL, an absolute or relative local path, or ``[user@]host:/path``; unknown schemes raise."""
    m = re.match(r"([a-z][a-z0-9]*)://([^/]*)(.*)$", text, re.DOTALL)
    if m:
        if m[1] not in SCHEMES:
            raise ValueError(f"unknown scheme {m[1]!r}")
        scheme = SCHEMES[m[1]]
        if scheme == "file":
            return Url("file", "", _tidy(m[3]))
        path = _tidy(m[3])
        return Url(scheme, m[2], path if scheme == "ssh" else path.lstrip("/"))
    m = re.match(r"([^/:\s]+):(/.*|~.*)$", text, re.DOTALL)
    if m:
        return Url("ssh", m[1], _tidy(m[2]))
    return Url("file", "", _tidy(text))


def parent(text: str) -> str | None:
    """The URL above, None at the top."""
    u = parse(text)
    head, slash, _ = u.path.rstrip("/").rpartition("/")
    if u.scheme == "file":
        return (head or "/") if slash and u.path != "/" else None
    if not u.path:
        return None
    return Url(u.scheme, u.host, head).canonical
