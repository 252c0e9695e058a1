"""Frontmatter, plain text and links of Markdown concepts."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from conceptlake.errors import InvalidParameter
from conceptlake.sources import normalize

MAX_FRONTMATTER = 64 * 1024
CORE = ("type", "title", "id", "description", "tags", "resource")
FENCE = re.compile(r"^(```|~~~)")
INLINE = re.compile(r"(!?)\[((?:[^\[\]]|!\[[^\]]*\]\([^)]*\))*)\]\(\s*<?([^)\s>]*)>?(?:\s+\"[^\"]*\")?\s*\)")
REFERENCE = re.compile(r"(?<!\])\[([^\[\]]+)\]\[([^\[\]]*)\]")
DEFINITION = re.compile(r"^ {0,3}\[([^\]]+)\]:\s*<?(\S+?)>?(?:\s+.*)?$")
AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]*:[^\s<>]+|[^\s<>@]+@[^\s<>@]+)>")


@dataclass
class Concept:
    path: str
    concept_id: str
    type: str
    title: str
    declared_id: str | None
    description: str | None
    tags: list[str] | None
    resource: str | None
    metadata: dict[str, str]
    front: str
    trust_tier: str
    body: str
    text: str
    file_hash: str
    links: list[dict] = field(default_factory=list)


def split_frontmatter(text: str) -> tuple[str, str]:
    """(yaml, body): the block between ``---`` lines, which must be the first bytes behind an optional BOM."""
    text = text.removeprefix("\ufeff")
    if not re.match(r"---\r?\n", text):
        raise InvalidParameter("no frontmatter")
    start = text.index("\n") + 1
    end = re.compile(r"^---[ \t]*\r?$", re.M).search(text, start)
    if end is None:
        raise InvalidParameter("frontmatter is not closed")
    if end.start() - start > MAX_FRONTMATTER:
        raise InvalidParameter("frontmatter is too large")
    return text[start : end.start()], text[end.end() :].removeprefix("\n")


def plain_text(body: str) -> str:
    """The words of a body: a line for each block, marks removed, blank lines dropped."""
    out, fenced = [], False
    for line in body.splitlines():
        if FENCE.match(line.strip()):
            fenced = not fenced
            continue
        if not fenced:
            if DEFINITION.match(line):
                continue
            if re.fullmatch(r"\s*([-*_]\s*){3,}", line):
                out.append("---")
                continue
            line = re.sub(r"^\s*(#{1,6}\s+|[-*+]\s+|\d+[.)]\s+|>\s?)+", "", line)
            if re.fullmatch(r"\s*\|?[\s:|-]+\|[\s:|-]*", line):
                continue
            if line.strip().startswith("|"):
                line = " ".join(cell.strip() for cell in line.strip().strip("|").split("|"))
            for _ in range(2):  # an image in a link
                line = INLINE.sub(lambda m: m[2], line)
            line = REFERENCE.sub(lambda m: m[1], line)
            line = AUTO.sub(lambda m: m[1], line)
            line = re.sub(r"(\*\*|__|\*|`|~~)", "", line)
        out.append(line.strip())
    return "\n".join(x for x in out if x)


def links(body: str, source: str) -> list[dict]:
    """Links in document order: kind, target, text, the bundle path meant, and whether external."""
    text = "\n".join("" if i % 2 else part for i, part in enumerate(re.split(r"(?m)^ {0,3}(?:```|~~~).*$", body)))
    text = re.sub(r"`[^`\n]*`", lambda m: " " * len(m[0]), text)
    known = {m[1].lower(): m[2] for m in map(DEFINITION.match, text.splitlines()) if m}
    found: list[tuple[int, str, str, str]] = []
    for m in INLINE.finditer(text):
        found.append((m.start(), "image" if m[1] else "inline", m[3], m[2]))
        found += [(m.start(2) + n.start(), "image", n[3], n[2]) for n in INLINE.finditer(m[2])]
    found += [(m.start(), "reference", known[(m[2] or m[1]).lower()], m[1]) for m in REFERENCE.finditer(text) if (m[2] or m[1]).lower() in known]
    found += [(m.start(), "email" if "@" in m[1] and ":" not in m[1] else "autolink", m[1], m[1]) for m in AUTO.finditer(text)]
    out = []
    for ordinal, (_, kind, target, label) in enumerate(sorted(found, key=lambda x: x[0])):
        external = kind == "email" or normalize.is_external(target)
        out.append({"ordinal": ordinal, "link_kind": kind, "target": target, "link_text": label, "is_external": external, "target_path": None if external else normalize.resolve(source, target)})
    return out


def parse(path: str, data: bytes) -> Concept:
    """A concept from a file's bytes; malformed ones raise InvalidParameter."""
    import yaml

    clean = normalize.path(path)
    try:
        head, body = split_frontmatter(data.decode())
        front = yaml.safe_load(head)
    except (UnicodeDecodeError, yaml.YAMLError) as e:
        raise InvalidParameter(f"{clean}: {e}") from e
    if not isinstance(front, dict):
        raise InvalidParameter(f"{clean}: frontmatter is not a mapping")
    for key in ("type", "title"):
        if not isinstance(front.get(key), str) or not front[key].strip():
            raise InvalidParameter(f"{clean}: {key} is missing")
    tags = front.get("tags")
    if tags is not None and not (isinstance(tags, list) and all(isinstance(t, str) for t in tags)):
        raise InvalidParameter(f"{clean}: tags must be a list of strings")
    resource = front.get("resource")
    as_json = lambda v: json.dumps(v, default=str, sort_keys=True, ensure_ascii=False)
    return Concept(
        clean, normalize.concept_id(clean), front["type"], front["title"], front.get("id"), front.get("description"), tags,
        resource if resource is None or isinstance(resource, str) else as_json(resource), {str(k): as_json(v) for k, v in front.items() if k not in CORE},
        as_json(front), trust_tier(front), body, plain_text(body), hashlib.sha256(data).hexdigest(), links(body, clean),
    )


def log_entries(text: str) -> list[dict]:
    """Entries of a reserved log.md: list marks removed, with the time at the beginning, if there is one."""
    out = []
    for line in text.splitlines():
        entry = re.sub(r"^\s*(#+\s*|[-*+]\s+)", "", line).strip()
        if not entry:
            continue
        m = re.match(r"(\d{4}-\d{2}-\d{2}(?:[Tt ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:[Zz]|[+-]\d{2}(?::?\d{2})?)?)?)\b:?\s*", entry)
        out.append({"ordinal": len(out), "logged_at": m[1] if m else None, "entry": entry})
    return out


def trust_tier(front: dict) -> str:
    """Any human verification: human-reviewed; none at all: unverified; else machine-confirmed. A single mapping is a list
    of one; entries that don't name who are none."""
    marks = front.get("verified") or []
    marks = [marks] if isinstance(marks, dict) else marks if isinstance(marks, list) else []
    who = [v["by"].strip() for v in marks if isinstance(v, dict) and isinstance(v.get("by"), str) and v["by"].strip()]
    return "human-reviewed" if any(w.startswith("human:") for w in who) else "machine-confirmed" if who else "unverified"
