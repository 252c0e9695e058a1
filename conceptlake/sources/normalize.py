"""Paths, ids and link targets inside a bundle."""

from __future__ import annotations

import re

from conceptlake.errors import InvalidParameter

RESERVED = frozenset({"index.md", "log.md"})
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def path(raw: str) -> str:
    """A clean relative path; absolute paths, ``..`` and empty ones are refused."""
    parts = [p for p in raw.replace("\\", "/").split("/") if p not in ("", ".")]
    if raw.startswith(("/", "\\")) or ".." in parts or not parts or "\0" in raw:
        raise InvalidParameter(f"unsafe path {raw!r}")
    return "/".join(parts)


def concept_id(clean: str) -> str:
    return clean.removesuffix(".md")


def is_reserved(clean: str) -> bool:
    return clean.rpartition("/")[2] in RESERVED


def is_external(target: str) -> bool:
    return target.startswith("//") or bool(SCHEME.match(target))


def resolve(source: str, target: str) -> str | None:
    """The path in the bundle that a link of ``source`` means, or None where there is none."""
    target = target.replace("\\", "/")
    bare, _, _ = target.partition("#")
    if not bare:
        return source if target else None
    parts = [] if bare.startswith("/") else source.split("/")[:-1]
    for p in bare.split("/"):
        if p in ("", "."):
            continue
        if p == "..":
            if not parts:
                return None
            parts.pop()
        else:
            parts.append(p)
    if not parts:
        return None
    name = "/".join(parts)
    return name if name.endswith(".md") else name + ".md"
