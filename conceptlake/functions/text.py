"""Token columns: weighted positions over the segments of a concept."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from conceptlake.functions.tsquery import TOKEN

#: Weight of title, of tags, type and description, and of the body; and how many characters of each are indexed.
WEIGHTS = {"A": 1.0, "B": 0.4, "D": 0.1}
CAPS = {"A": 4000, "B": 16000, "D": 200000}


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def segments() -> dict[str, Column]:
    """The three weighted texts of a concept row."""
    labels = F.concat_ws(" ", F.array_join("tags", " "), F.col("type"), F.col("description"))
    return {"A": F.left(F.col("title"), F.lit(CAPS["A"])), "B": F.left(labels, F.lit(CAPS["B"])), "D": F.left(F.col("body_text"), F.lit(CAPS["D"]))}


def weighted_tokens(only: list[str] | None = None) -> Column:
    """array<struct<lexeme, pos, weight>>: positions from 1 run on over the segments; ``only`` keeps some lexemes."""
    parts = {k: tokens(v) for k, v in segments().items()}
    both = F.array(*[F.struct(parts[k].alias("t"), F.lit(w).alias("w")) for k, w in WEIGHTS.items()])
    flat = F.flatten(F.transform(both, lambda s: F.transform(s["t"], lambda t: F.struct(t.alias("lexeme"), s["w"].alias("weight")))))
    placed = F.transform(flat, lambda t, i: F.struct(t["lexeme"].alias("lexeme"), (i + 1).alias("pos"), t["weight"].alias("weight")))
    return placed if only is None else F.filter(placed, lambda t: t["lexeme"].isin(only))


def headline(body: Column, terms: list[str] | Column, words: int = 35) -> Column:
    """Up to ``words`` words around the first match, with matches in <b>…</b>; the beginning where nothing matches."""
    parts = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"\S+"), F.lit(0))
    want = terms if isinstance(terms, Column) else F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    marked = F.transform(parts, lambda p: F.struct(p.alias("p"), F.arrays_overlap(tokens(p), want).alias("hit")))
    first = F.array_position(F.transform(marked, lambda m: m["hit"]), True)
    start = F.greatest(F.lit(1), first - words // 3).cast("int")
    shown = F.transform(F.slice(marked, start, words), lambda m: F.when(m["hit"], F.concat(F.lit("<b>"), m["p"], F.lit("</b>"))).otherwise(m["p"]))
    return F.array_join(shown, " ")
