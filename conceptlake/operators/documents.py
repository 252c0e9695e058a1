"""Edits of documents: who contributes, verifies and sends back, as frontmatter.

A verification is granted, never typed in: whatever a contribution has under ``verified`` goes to
``superseded_verifications``, with who set it aside, when and why; an edit keeps the stored version's record, whether or not
the editor left it in. Functions on one document take and return frontmatter (a dict) and change nothing in place;
``contribute``, ``verify`` and ``send_back`` apply them to tables of files, a row each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from conceptlake.errors import InvalidParameter

#: How a person's actor begins; statuses; why verifications were set aside; a review's outcome.
HUMAN, DRAFT, ACTIVE = "human:", "draft", "active"
UPLOADED, EDITED, SENT_BACK = "uploaded", "edited", "sent-back"
RESULT = "path string, content binary, set_aside int, error string"


def event(actor: str, at: str, note: str | None = None, **more: str) -> dict:
    note = (note or "").strip()
    return {"by": actor, "at": at, **more, **({"note": note} if note else {})}


def listed(front: dict, key: str) -> list:
    """A field's events if it is a list; a field of another shape holds none."""
    return list(front[key]) if isinstance(front.get(key), list) else []


def actor_of(front: dict, key: str) -> str | None:
    """Who a field names, as a text or as an event."""
    value = front.get(key)
    who = value.get("by") if isinstance(value, dict) else value
    return who.strip() if isinstance(who, str) else None


def set_aside(front: dict, actor: str, at: str, reason: str) -> tuple[dict, int]:
    """Without verifications, and how many were moved. A single event, or a text, is moved as well."""
    claimed = front.get("verified")
    marks = claimed if isinstance(claimed, list) else [] if claimed is None else [claimed]
    why = {"superseded_by": actor, "superseded_at": at, "reason": reason}
    moved = [{**(m if isinstance(m, dict) else {"event": m if isinstance(m, str) else ""}), **why} for m in marks]
    rest = {k: v for k, v in front.items() if k != "verified"}
    return {**rest, "superseded_verifications": listed(front, "superseded_verifications") + moved}, len(moved)


def inherited(front: dict, stored: dict) -> dict:
    """With the stored version's events, live and set aside, that it doesn't have."""
    out = dict(front)
    for key in ("verified", "superseded_verifications"):
        if isinstance(stored.get(key), list):
            mine = listed(out, key)
            out[key] = mine + [e for i, e in enumerate(stored[key]) if e not in mine and e not in stored[key][:i]]
    return out


def new(front: dict, actor: str, at: str) -> tuple[dict, int]:
    """A document that the catalog doesn't have. Who isn't a person can't file it as another person's."""
    for key in ("generated", "author"):
        named = actor_of(front, key)
        if named and named.startswith(HUMAN) and named != actor and not actor.startswith(HUMAN):
            raise InvalidParameter(f"{key} names {named}, and {actor} is not a person")
    origin = {"generated": event(actor, at), "author": actor}
    return set_aside(front | {k: v for k, v in origin.items() if k not in front}, actor, at, UPLOADED)


def edited(front: dict, actor: str, at: str, stored: dict | None) -> tuple[dict, int]:
    """A document that replaces a stored one (None: one that can't be read)."""
    out, n = set_aside(inherited(front, stored) if stored is not None else front, actor, at, EDITED)
    return {**out, "generated": event(actor, at)}, n


def verified(front: dict, actor: str, at: str, note: str | None = None) -> dict:
    """With one more verification; a draft, or a document without status, becomes active."""
    status = front.get("status")
    active = {"status": ACTIVE} if not isinstance(status, str) or status == DRAFT else {}
    return {**front, "verified": [*listed(front, "verified"), event(actor, at, note)], **active}


def returned(front: dict, actor: str, at: str, note: str | None = None) -> dict:
    """A draft again, with the review."""
    return {**front, "status": DRAFT, "reviews": [*listed(front, "reviews"), event(actor, at, note, outcome=SENT_BACK)]}


@lru_cache(maxsize=1)
def _loader():
    """YAML with times as texts, so that writing them again changes nothing."""
    import yaml

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers = {k: [(tag, r) for tag, r in v if tag != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

    return Loader


def read(data: bytes) -> tuple[dict, str]:
    """(frontmatter, body) of a file."""
    import yaml

    from conceptlake.sources.markdown import split_frontmatter

    try:
        head, body = split_frontmatter(data.decode())
        front = yaml.load(head, _loader())  # a SafeLoader
    except (UnicodeDecodeError, yaml.YAMLError) as e:
        raise InvalidParameter(str(e)) from e
    if not isinstance(front, dict):
        raise InvalidParameter("frontmatter is not a mapping")
    return front, body


def write(front: dict, body: str) -> bytes:
    import yaml

    return f"---\n{yaml.safe_dump(front, sort_keys=False, allow_unicode=True, width=1 << 20)}---\n{body}".encode()


def _apply(files: DataFrame, change: Callable[[dict, bytes | None], tuple[dict, int]]) -> DataFrame:
    """Files (path, content, stored) after a change; one that fails keeps its bytes and says why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content, stored in zip(batch["path"], batch["content"], batch["stored"], strict=True):
                try:
                    front, body = read(bytes(content or b""))
                    made, n = change(front, stored)
                    out.append((path, write(made, body), n, None))
                except InvalidParameter as e:
                    out.append((path, content, 0, str(e)))
            yield pd.DataFrame(out, columns=["path", "content", "set_aside", "error"])

    return files.select("path", "content", "stored").mapInPandas(run, RESULT)


def contribute(uploads: DataFrame, stored: DataFrame, actor: str, at: str) -> DataFrame:
    """(path, content, set_aside, error) of uploaded files (path, content): new where ``stored`` (path, content) has no
    file of that path, else an edit of it. ``stored`` has a path once. One equi-join; every upload has a row."""

    def change(front: dict, before: bytes | None) -> tuple[dict, int]:
        if before is None:
            return new(front, actor, at)
        try:
            was = read(bytes(before))[0]
        except InvalidParameter:
            was = None
        return edited(front, actor, at, was)

    known = stored.select("path", F.coalesce("content", F.lit(b"")).alias("stored"))
    return _apply(uploads.join(known, "path", "left"), change)


def verify(files: DataFrame, actor: str, at: str, note: str | None = None) -> DataFrame:
    return _apply(files.withColumn("stored", F.lit(None).cast("binary")), lambda front, _: (verified(front, actor, at, note), 0))


def send_back(files: DataFrame, actor: str, at: str, note: str | None = None) -> DataFrame:
    return _apply(files.withColumn("stored", F.lit(None).cast("binary")), lambda front, _: (returned(front, actor, at, note), 0))
