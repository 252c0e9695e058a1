"""Token counts by a map-side two-tier lookup.

Tier one: a table of frequent pre-tokens (what stands between white space) and their numbers of tokens, made on the
driver from the ``sample`` documents with the smallest keyed hashes, holding at most ``table`` entries, and broadcast.
Tier two: misses of an Arrow batch are encoded together by the library, and kept in the worker's cache of two bounded
generations. No pre-token is shuffled. The table only saves work: counts never depend on it, on the sample or on the
cache.

Why cutting at white space is exact: the tokenizer drops white space and its pre-tokens never cross it; normalisation
(NFC, lower case) doesn't look across it either. That is looked up in the tokenizer's settings when it is loaded
(``cuts_at_space``); one of another kind encodes every text whole. So are texts in which it doesn't hold: those with its
special strings, or with U+001C to U+001F, which Python takes for white space.

Defined results: null text is the empty text with 0 tokens; repeated rows are counted alike.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from conceptlake.llm.arrowtext import map_text, slices
from conceptlake.llm.sampling import smallest_hashes

MODEL = "word_bpe_49k.json"
SAMPLE, TABLE, CACHE, LONGEST = 500, 20_000, 300_000, 48
#: Normalisers and pre-tokenizers that don't look across white space, and split patterns whose matches hold none.
LOCAL = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "Whitespace", "WhitespaceSplit", "BertPreTokenizer", "ByteLevel"}
SPLITS = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


class Counts(dict):
    """Pre-token to number of tokens: the broadcast table, then two generations of what was encoded."""

    def __init__(self, tokenizer, table: dict[str, int]) -> None:
        super().__init__(table)
        self.tokenizer, self.table, self.old = tokenizer, table, {}

    def learn(self, words: set[str]) -> None:
        """Have an entry for each of the words."""
        if len(self) > CACHE + len(self.table):
            self.old = dict(self)
            self.clear()
            self.update(self.table)
        new = []
        for w in words:
            if w not in self:
                n = self.old.get(w)
                if n is None:
                    new.append(w)
                else:
                    self[w] = n
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self[w] = len(e.ids)


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cuts_at_space(settings: dict) -> bool:
    """Whether a tokenizer's settings say that what it does to a text it does to each stretch between white space."""

    def steps(part: dict | None, inner: str) -> list[dict]:
        return [] if part is None else [x for p in part[inner] for x in steps(p, inner)] if part["type"] == "Sequence" else [part]

    norm = steps(settings.get("normalizer"), "normalizers")
    pre = steps(settings.get("pre_tokenizer"), "pretokenizers")
    blanks = lambda x: x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " "
    split = lambda x: x["type"] == "Split" and x["pattern"].get("Regex") in SPLITS and x["behavior"] == "Removed" and x["invert"]
    drops = bool(pre) and (split(pre[0]) or pre[0]["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"))
    quiet = all(not x.get("add_prefix_space") and not x.get("use_regex") for x in pre if x["type"] == "ByteLevel")
    return drops and quiet and all(x["type"] in LOCAL or blanks(x) for x in norm) and all(x["type"] in LOCAL or split(x) for x in pre) and not settings.get("post_processor")


def frequent(texts: DataFrame, table: int) -> list[str]:
    """The commonest pre-tokens of a few texts that occur more than once, at most ``table``; counted on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            for part in slices(batch, 0):
                for t in part.column(0).to_pylist():
                    words.update(w for w in (t or "").split() if len(w) <= LONGEST)
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["w", "n"])

    counted = texts.mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).where("n > 1")
    return [r["w"] for r in counted.orderBy(F.col("n").desc(), "w").limit(table).collect()]


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str | None = None, limit: int = 2048, sample: int = SAMPLE, table: int = TABLE, seed: int = 42) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), a row for each row."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(MODEL)
    tokenizer = load(model)
    apart, lengths = cuts_at_space(json.loads(tokenizer.to_str())), {}
    if apart:
        chosen = smallest_hashes(df.select(F.col(id_col).alias("__id")), sample, seed, "__id").select("__id")
        known = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(chosen), "__id", "left_semi")  # at most `sample` ids
        words = frequent(known.select("__t"), table)
        lengths = {w: len(e.ids) for w, e in zip(words, tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True)}
    shared = df.sparkSession.sparkContext.broadcast(lengths)

    def start():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = load(model)
        counts = Counts(tokenizer, shared.value)
        # Special strings as they stand, and separators on which Python and the tokenizer differ.
        odd = re.compile("|".join([*(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()), "[\x1c-\x1f]"]))

        def whole(text: str) -> int:
            return len(tokenizer.encode(text, add_special_tokens=False).ids)

        def step(texts: list) -> list[tuple]:
            out: list = []
            for i in range(0, len(texts), 64):
                group = [t or "" for t in texts[i : i + 64]]
                words = [None if not apart or odd.search(t) else t.split() for t in group]
                counts.learn(set().union(*(w for w in words if w)))
                for t, w in zip(group, words, strict=True):
                    n = whole(t) if w is None else sum(map(counts.__getitem__, w))
                    out.append((len(t.encode()), n, n > limit))
            return out

        return step

    return map_text(df, [id_col], [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())], start, text_col)
