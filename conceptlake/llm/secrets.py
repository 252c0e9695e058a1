"""Secret scans over a trigram inverted index.

Each rule's regex yields a Boolean trigram query (``trigrams.query_of``). Every Arrow batch of documents is one
index segment: its texts' bytes are cut into trigrams, and those that any query mentions become postings (a bitmap
of the segment's documents for each trigram). A rule's candidates come from intersecting and uniting postings; the
regex then verifies candidates on the whole text, in time linear in its length. Rules without a mandatory trigram scan
every document. An index lives as long as its batch: it is built, asked for all rules and dropped, in one task, so nothing
is shuffled or kept, and a lost task is simply run again.

Defined results: null or empty text has no spans; repeated rows each get their own row; null ids pass through;
other columns are ignored by ``scan_secrets`` and passed through unchanged by ``redact_secrets``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from conceptlake.llm.arrowtext import raw_bytes, slices
from conceptlake.llm.trigrams import ANY, query_of, trigrams_of


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group`` has under ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    sql: str | None = None  #: the SQL twin's pattern, where it isn't ``pattern``
    scan: str | None = None  #: a pattern whose first group is what ``pattern`` matches, where that takes more than linear time


#: A private key is its block up to the END line of the same label, before any other block; if there is none, the lines
#: of base64 (or of a key's headers) behind the BEGIN line, whose breaks may be written as \n.
_KEY = r"(?:(?:(?!-----BEGIN\x20)[\x00-\U0010ffff])*?-----END\x20\1PRIVATE\x20KEY-----|(?:(?:[\x20\x09-\x0d]|\\[nr])*(?:[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]+={1,2}|(?:Proc-Type|DEK-Info):[^\r\n\\]*))*)"

BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("cloud", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("pay", r"[rs]k_live_[A-Za-z0-9]+", 0, 24),
    # A run of the class has one head that can begin a match, its first: what follows the run is the same for all.
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, scan=r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)"),
    Rule("pem", r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----" + _KEY, sql=r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("login", r"://[A-Za-z0-9._~-]+:[^ /:@\x09-\x0d]+@", 0, 8),
)
RULES = BASE + MORE


class Scanner:
    """Holds the compiled rules and their queries; ``segment`` answers one batch."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.queries = [query_of(r.pattern) for r in rules]
        # Dropping matches below a length commutes with demanding it only where a match is a run of one class.
        self.patterns = [re.compile(f"[0-9a-f]{{{r.least},}}" if r.pattern == "[0-9a-f]+" else r.scan or r.pattern, re.ASCII) for r in rules]
        #: The groups that give a rule's span, and the one whose length counts.
        self.groups = [(1 if r.scan else 0, r.group + 1 if r.scan else r.group) for r in rules]
        grams = sorted(set().union(*(trigrams_of(q) for q in self.queries)))
        self.slot = {g: i + 1 for i, g in enumerate(grams)}
        self.table = np.zeros(1 << 24, np.uint16)
        for g, i in self.slot.items():
            self.table[g[0] << 16 | g[1] << 8 | g[2]] = i
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The segment's index: a row for each trigram of the queries, a column for each document."""
        bits = np.zeros((len(self.slot) + 1, len(offsets) - 1), bool)
        if len(data) >= 3:
            d = self.fold[data].astype(np.uint32)
            hits = self.table[d[:-2] << 16 | d[1:-1] << 8 | d[2:]]
            at = np.flatnonzero(hits)
            doc = np.searchsorted(offsets, at, "right") - 1
            whole = at + 3 <= offsets[doc + 1]
            bits[hits[at[whole]], doc[whole]] = True
        return bits

    def candidates(self, query, bits: np.ndarray) -> np.ndarray:
        if query is ANY:
            return np.ones(bits.shape[1], bool)
        if isinstance(query, bytes):
            return bits[self.slot[query]]
        parts = [self.candidates(q, bits) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)

    def segment(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule number, end), in code points, by start and then rule."""
        bits = self.postings(*raw_bytes(column))
        wanted = [self.candidates(q, bits) for q in self.queries]
        found: list[list[tuple[int, int, int]]] = []
        for i, text in enumerate(column.to_pylist()):
            spans = []
            for k, rule in enumerate(self.rules):
                if text and wanted[k][i]:
                    whole, part = self.groups[k]
                    spans += [(m.start(whole), k, m.end(whole)) for m in self.patterns[k].finditer(text) if m.end(part) - m.start(part) >= rule.least]
            found.append(sorted(spans))
        return found


def joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def united(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one, in order."""
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """(id, counts of each of the first ``base`` rules, base_sha256, spans, n_spans), a row for each row of ``df``."""
    kinds = [r.kind for r in rules[:base]]
    schema = T.StructType([df.select(id_col).schema[0], *[T.StructField(f"n_{k}", T.LongType()) for k in kinds], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            found = scanner.segment(batch.column(1))
            of_base = [[s for s in spans if s[1] < base] for spans in found]
            counts = [pa.array([sum(s[1] == k for s in spans) for spans in of_base], pa.int64()) for k in range(base)]
            digests = pa.array([hashlib.sha256(joined(s, rules).encode()).hexdigest() for s in of_base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([joined(s, rules) for s in found], pa.string()), pa.array([len(s) for s in found], pa.int64())], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def redact_secrets(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with every span (overlapping ones united) replaced by ``mark``; the length column, if there, follows the text."""
    schema, names = df.schema, df.columns
    at, length = names.index(text_col), names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in (part for whole in batches for part in slices(whole, at)):
            cols = list(batch.columns)
            texts, found = cols[at].to_pylist(), scanner.segment(cols[at])
            changed = [i for i, spans in enumerate(found) if spans]
            for i in changed:
                out, end = [], 0
                for a, b in united(found[i]):
                    out += [texts[i][end:a], mark]
                    end = b
                texts[i] = "".join(out) + texts[i][end:]
            if changed:
                if length is not None:
                    sizes = cols[length].to_pylist()
                    for i in changed:
                        sizes[i] = len(texts[i])
                    cols[length] = pa.array(sizes, cols[length].type)
                cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, schema)
