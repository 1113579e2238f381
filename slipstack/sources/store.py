"""Files on shared storage, as tasks open them through Arrow."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a Spark path and the path inside it. Spark writes ``file:/a b`` as well as ``file:///a b``."""
    scheme, _, rest = path.partition(":")
    if not rest:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority, _, inside = rest.removeprefix("//").partition("/")
    system, root = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system, f"{root.rstrip('/')}/{inside}" if root.strip("/") else f"{authority}/{inside}" if scheme in ("s3", "gs", "abfss") else f"/{inside}"
