"""SentencePiece BPE with seeded merge-dropout, and lossless decoding.

A text is cut before each run of word marks, since no piece of the vocabulary has a mark after another character. In a
chunk, an agenda holds the adjacent pairs that form a piece, best score first and leftmost among equals. Each candidate
that is taken from the agenda is skipped with the probability ``dropout``; it may come up again in another pair. Without
dropout this is the library's segmentation.

Which candidates are skipped a keyed hash says: of (seed, the row's key, the text, the chunk's place in it, the number of the
draw), through a mixer of two multiply-xorshift rounds. So the same word is cut differently from place to place, from
document to document and from one repetition of a document to the next, draws are independent, and a rerun gives the same
pieces. Draws are distances to the next skipped candidate (geometric), which is the same as a draw for each candidate.

The agendas of many chunks are worked off together: a row of symbols each, in numpy arrays by length; at each step every
row's best pair is found, skipped or merged. Nothing is kept from one chunk to the next, so time is linear in a text and
the same for any vocabulary. Chunks beyond ``WIDTHS`` have a heap of their own.

Decoding maps pieces to bytes. It is lossless for every text: characters outside the vocabulary are bytes, and so is a
literal word mark (U+2581), which stands for a space otherwise.

Defined results: null text is the empty text and has no pieces; rows repeated in the kept columns and the text are numbered,
and the number is part of their key.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T
from xxhash import xxh64_intdigest

from conceptlake.llm.arrowtext import map_text

MARK = "▁"
#: Rows of symbols that are worked off together, by the longest of them; and how many at once.
WIDTHS, ROWS = (3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 32, 48), 1 << 14
MASK = (1 << 64) - 1
STEP, GOLD = np.uint64(0xD1B54A32D192ED03), np.uint64(0x9E3779B97F4A7C15)
#: Symbols have this many bits; no pair has a code of NONE or more.
BITS, NONE = 21, np.int64(1) << 62
#: A symbol of ``OTHER`` + c is a character c that is no piece by itself.
OTHER = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers of which every bit depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """The model's vocabulary: ids, ranks by score, bytes, and which pairs of symbols form a piece."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        assert n <= OTHER
        self.ids: dict[str, int] = {}
        self.bytes = [b""] * n
        self.byte_id = [0] * 256
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_id[value], self.bytes[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.bytes[i] = i, piece.replace(MARK, " ").encode()
        # Best score first; equal scores share a rank, so that the leftmost goes first.
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[sp.get_score(i)] for p, i in self.ids.items()}
        self.names = [str(i) for i in range(n)]
        #: The symbol of each character; a space is the mark, and a literal mark is no piece.
        self.symbols = np.arange(0x110000, dtype=np.int32) + OTHER
        for p, i in self.ids.items():
            if len(p) == 1 and p != MARK:
                self.symbols[ord(p)] = i
        if MARK in self.ids:
            self.symbols[0x20] = self.ids[MARK]
        self._pairs()

    def symbol(self, part: str) -> int | None:
        return self.ids.get(part, int(self.symbols[0x20 if part == MARK else ord(part)]) if len(part) == 1 else None)

    def _pairs(self) -> None:
        """A hash table from two symbols to rank << BITS | id of the piece that they form."""
        keys, codes = [], []
        for p, r in self.rank.items():
            for k in range(1, len(p)):
                a, b = self.symbol(p[:k]), self.symbol(p[k:])
                if a is not None and b is not None:
                    keys.append(a << BITS | b)
                    codes.append(r << BITS | self.ids[p])
        keys, codes = np.array(keys, np.int64), np.array(codes, np.int64)
        bits = max(10, (8 * len(keys)).bit_length())
        self.shift, self.room = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.codes = np.full(1 << bits, -2, np.int64), np.full(1 << bits, NONE, np.int64)
        slot, left, self.reach = self.slot(keys), np.arange(len(keys)), 0
        while len(left):
            at = (slot[left] + self.reach) & self.room
            free = np.flatnonzero(self.keys[at] == -2)
            _, one = np.unique(at[free], return_index=True)  # one for each slot
            put = free[one]
            self.keys[at[put]], self.codes[at[put]] = keys[left[put]], codes[left[put]]
            left = np.delete(left, put)
            self.reach += 1
        ranks = list(self.rank.values())
        #: What a code may exceed another by and be equal: nothing, if no two pieces share a score.
        self.equal = np.int64(0 if len(set(ranks)) == len(ranks) else (1 << BITS) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * GOLD) >> self.shift).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The code of each pair of symbols, NONE if it forms no piece; -1 is no symbol."""
        key = a.astype(np.int64) << BITS | b
        slot = self.slot(key)
        found = self.keys[slot]
        code = np.where(found == key, self.codes[slot], NONE)
        open_ = np.flatnonzero((found != key) & (found != -2))
        for k in range(1, self.reach):
            if not len(open_):
                break
            at = (slot[open_] + k) & self.room
            found = self.keys[at]
            hit = found == key[open_]
            code[open_[hit]] = self.codes[at[hit]]
            open_ = open_[~hit & (found != -2)]
        return code


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """A model is read once in a process."""
    return Pieces(path)


class Encoder:
    def __init__(self, path: str, dropout: float = 0.1, seed: int = 0) -> None:
        self.pieces, self.dropout, self.seed = pieces_of(path), dropout, seed

    def distances(self, h: np.ndarray) -> np.ndarray:
        """Numbers of candidates that are kept before the next one is skipped, from hashes."""
        if self.dropout <= 0:
            return np.full(len(h), 1 << 40, np.int64)
        if self.dropout >= 1:
            return np.zeros(len(h), np.int64)
        u = (h >> np.uint64(11)) * 2.0**-53
        return np.floor(np.log1p(-u) / np.log1p(-self.dropout)).astype(np.int64)

    def draws(self, key: int) -> Iterator[int]:
        """The distances of one chunk, one after the other."""
        at = 0
        while True:
            yield from self.distances(mixed(np.uint64(key) + STEP * np.arange(at, at + 64, dtype=np.uint64))).tolist()
            at += 64

    def merged(self, symbols: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Work off the agendas of many chunks: symbols is width x rows, -1 behind a row's end; the rows' last symbols."""
        width, n = symbols.shape
        out = symbols.copy()
        pair, low = self.pieces.pair, ~self.pieces.equal
        rows = np.arange(n)
        now = np.vstack((symbols, np.full((1, n), -1, symbols.dtype)))
        code = np.vstack([pair(now[c], now[c + 1]) for c in range(width)])  # the last row has no pairs
        taken, draw = np.zeros(n, np.int64), np.zeros(n, np.uint64)
        skip = self.distances(mixed(key))
        while len(rows):
            best, at = code[0].copy(), np.zeros(len(rows), np.int64)
            for c in range(1, width - 1):
                less = code[c] < (best & low)
                np.copyto(best, code[c], where=less)
                np.copyto(at, c, where=less)
            live = best < NONE
            if not live.all():
                over = ~live
                out[:, rows[over]] = now[:width, over]
                rows, now, code, best, at = rows[live], now[:, live], code[:, live], best[live], at[live]
                taken, draw, skip, key = taken[live], draw[live], skip[live], key[live]
                if not len(rows):
                    break
            pass_ = taken == skip
            taken += 1
            if pass_.any():
                i = np.flatnonzero(pass_)
                code[at[i], i] = NONE
                draw[i] += np.uint64(1)
                skip[i] = taken[i] + self.distances(mixed(key[i] + STEP * draw[i]))
            i = np.flatnonzero(~pass_)
            j = at[i]
            now[j, i] = (best[i] & ((1 << BITS) - 1)).astype(now.dtype)
            at[pass_] = width  # these rows stay as they are
            for c in range(1, width):
                behind = at < c
                np.copyto(now[c], now[c + 1], where=behind)
                np.copyto(code[c], code[c + 1] if c + 1 < width else NONE, where=behind)
            code[j, i] = pair(now[j, i], now[j + 1, i])
            inner = j > 0
            i, j = i[inner], j[inner]
            code[j - 1, i] = pair(now[j - 1, i], now[j, i])
        return out

    def encode_many(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """The ids of each text; ``keys`` tell repetitions of a text apart."""
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        ends = np.cumsum(lengths)
        if not len(texts) or not ends[-1]:
            return [np.zeros(0, np.int32) for _ in texts]
        codes = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le"), np.uint32)
        space = codes == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[(ends - lengths)[lengths > 0]] = True
        start = np.flatnonzero(begins)
        size = np.diff(np.append(start, len(codes)))
        # A chunk's key: its text's, and its place in the text.
        text = np.searchsorted(ends, start, "right")
        first = np.searchsorted(start, ends - lengths)
        own = np.array([xxh64_intdigest(t.encode(), self.seed & MASK) if t else 0 for t in texts], np.uint64) ^ mixed(np.array([k & MASK for k in keys], np.uint64))
        key = mixed(own[text] + GOLD * (np.arange(len(start)) - first[text] + 1).astype(np.uint64))
        symbols = self.pieces.symbols[codes]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        least = 0
        for width in WIDTHS:
            mine = np.flatnonzero((size > least) & (size <= width))
            least = width
            for k in range(0, len(mine), ROWS):
                some = mine[k : k + ROWS]
                block = np.stack([np.where(size[some] > c, symbols[np.minimum(start[some] + c, len(codes) - 1)], -1) for c in range(width)])
                done.append((some, self.merged(block, key[some])))
        for i in np.flatnonzero(size > WIDTHS[-1]).tolist():
            chunk = codes[start[i] : start[i] + size[i]].tobytes().decode("utf-32-le")
            done.append((np.array([i]), np.array(self.chunk(chunk, self.draws(int(key[i])).__next__)[0], np.int32)[:, None]))
        return self.joined(done, first, len(start))

    def joined(self, done: list[tuple[np.ndarray, np.ndarray]], first: np.ndarray, chunks: int) -> list[np.ndarray]:
        """The ids of each text, whose first chunks are ``first``, from the symbols of the chunks."""
        count = np.zeros(chunks, np.int64)
        for rows, symbols in done:
            count[rows] = (symbols >= 0).sum(0)
        at = np.concatenate(([0], np.cumsum(count)))
        flat = np.empty(at[-1], np.int32)
        for rows, symbols in done:
            for c, line in enumerate(symbols):
                there = line >= 0
                if not there.any():
                    break
                flat[at[rows[there]] + c] = line[there]
        bounds = at[np.append(first, chunks)]
        other = np.flatnonzero(flat >= OTHER)
        if len(other):  # characters outside the vocabulary are their bytes
            spelt = [[self.pieces.byte_id[b] for b in chr(x).encode()] for x in (flat[other] - OTHER).tolist()]
            times = np.ones(len(flat), np.int64)
            times[other] = [len(x) for x in spelt]
            moved = np.concatenate(([0], np.cumsum(times)))
            flat = np.repeat(flat, times)
            for i, x in zip(moved[other].tolist(), spelt, strict=True):
                flat[i : i + len(x)] = x
            bounds = moved[bounds]
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def chunk(self, chunk: str, more: Callable[[], int] | None = None) -> tuple[list[int], int]:
        """The symbols of one chunk (spaces are spaces here) by a heap, and how many candidates there were.

        ``more`` gives the distance to the next candidate to skip, again and again; without it none is.
        """
        find = self.pieces.rank.get
        # A literal mark is shown as U+0000, which no piece has.
        text = chunk.replace(MARK, "\0").replace(" ", MARK)
        n = len(text)
        # Symbols are spans: width at their first character, 0 elsewhere; before[i] is where the span left of i begins.
        width, before = [1] * n, list(range(-1, n))
        # An agenda entry is one number: rank, place, width.
        bits = n.bit_length()
        mask, top = (1 << bits) - 1, 2 * bits
        push, pop = heapq.heappush, heapq.heappop
        agenda = [r << top | i << bits | 2 for i, r in enumerate(map(find, map(str.__add__, text, text[1:]))) if r is not None]
        heapq.heapify(agenda)
        at, skip = 0, more() if more else -1
        while agenda:
            item = pop(agenda)
            w, i = item & mask, item >> bits & mask
            a = width[i]
            if not a or a >= w:
                continue
            j = i + a
            if width[j] != w - a:
                continue
            at += 1
            if at - 1 == skip:
                skip = at + more()
                continue
            width[i], width[j] = w, 0
            k = i + w
            if k < n:
                before[k] = i
                v = w + width[k]
                r = find(text[i : i + v])
                if r is not None:
                    push(agenda, r << top | i << bits | v)
            h = before[i]
            if h >= 0:
                r = find(text[h:k])
                if r is not None:
                    push(agenda, r << top | h << bits | k - h)
        out: list[int] = []
        i = 0
        while i < n:
            piece = text[i : i + width[i]]
            out.append(self.pieces.ids[piece] if piece in self.pieces.ids else OTHER + ord(chunk[i]))
            i += width[i]
        return out, at

    def encode(self, text: str, key: int = 0) -> list[int]:
        """The ids of a text; ``key`` tells repetitions of the text apart."""
        return self.encode_many([text], [key])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text again; the space that encoding puts in front is dropped."""
        return b"".join(map(self.pieces.bytes.__getitem__, ids))[1:].decode()


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def numbered(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """``keep``, the text, and ``__key``: a hash of ``keep`` and the number among rows that are repeated in both."""
    rows = df.select(*keep, F.col(text_col).alias("__t"))
    same = Window.partitionBy(F.xxhash64(*keep, "__t")).orderBy(F.lit(0))
    return rows.withColumn("__key", F.xxhash64(*keep, F.row_number().over(same)))


def map_keyed(df: DataFrame, keep: list[str], text_col: str, schema: list, start) -> DataFrame:
    """``map_text`` over (key, text) of ``numbered`` rows."""
    rows = numbered(df, keep, text_col)
    return map_text(rows.select(*keep, F.struct("__key", "__t").alias("__text")), keep, schema, start, "__text")


def encode_column(df: DataFrame, keep: list[str], *, text_col: str = "text", model: str | None = None, dropout: float = 0.1, seed: int = 0) -> DataFrame:
    """``keep`` columns with ``pieces`` (array of ids) for every whole text."""

    def start():
        encoder = Encoder(model or model_path(), dropout, seed)
        return lambda rows: [(ids,) for ids in encoder.encode_many([r["__t"] or "" for r in rows], [r["__key"] for r in rows])]

    return map_keyed(df, keep, text_col, [("pieces", T.ArrayType(T.IntegerType()))], start)


def decode_column(df: DataFrame, keep: list[str], *, pieces_col: str = "pieces", model: str | None = None) -> DataFrame:
    """``keep`` columns with ``text`` decoded from ``pieces``."""

    def start():
        encoder = Encoder(model or model_path())
        return lambda rows: [(encoder.decode(list(ids or [])),) for ids in rows]

    return map_text(df, keep, [("text", T.StringType())], start, pieces_col)


def encode_and_decode(df: DataFrame, keep: list[str], *, text_col: str = "text", model: str | None = None, dropout: float = 0.1, seed: int = 0) -> DataFrame:
    """``keep`` with n_bytes, n_pieces, pieces_sha256 (ids, comma-joined), decoded_sha256 and lossless, for every text."""

    def start():
        encoder = Encoder(model or model_path(), dropout, seed)
        names = encoder.pieces.names.__getitem__

        def step(rows: list) -> list[tuple]:
            texts, out = [r["__t"] or "" for r in rows], []
            for text, found in zip(texts, encoder.encode_many(texts, [r["__key"] for r in rows]), strict=True):
                ids = found.tolist()
                back = encoder.decode(ids)
                out.append((len(text.encode()), len(ids), hashlib.sha256(",".join(map(names, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text))
            return out

        return step

    names = [("n_bytes", T.LongType()), ("n_pieces", T.LongType()), ("pieces_sha256", T.StringType()), ("decoded_sha256", T.StringType()), ("lossless", T.BooleanType())]
    return map_keyed(df, keep, text_col, names, start)
