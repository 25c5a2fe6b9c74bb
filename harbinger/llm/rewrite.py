"""Replace spans of texts, moving only the texts that have any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger.llm.common import hit_filter, with_hits

KEY = ["h1", "h2", "n"]

PIECES = """transform(sequence(0, size(_cuts)), i ->
    concat(
        substring(_text,
            if(i = 0, 0, get(_cuts, i - 1).stop) + 1,
            if(i = size(_cuts), length(_text), get(_cuts, i).start) - if(i = 0, 0, get(_cuts, i - 1).stop)),
        if(i = size(_cuts), '', get(_cuts, i).mark)))"""


def text_key(text: Column) -> list[Column]:
    """What names a text: two hashes and its length. Exact copies share it."""
    return [F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"), F.char_length(text).alias("n")]


def apply_cuts(docs: DataFrame, cuts: DataFrame, also: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` with spans of ``text`` replaced; columns stay as they are.

    ``cuts`` holds, for each text key, ``_cuts``: an array of (start, stop, mark), in
    order and not overlapping, in code points. Where there is a column ``n_chars`` it
    becomes the length of a changed text. ``also`` sets other columns of changed rows.
    Null texts stay null.
    """
    names, kinds = docs.columns, dict(docs.dtypes)
    body = docs.select(F.struct(*[f"`{c}`" for c in names]).alias("_row"), F.col("text").cast("string").alias("_text"))
    body = body.select("*", *text_key(F.coalesce(F.col("_text"), F.lit(""))))
    body = with_hits(body, "h1", hit_filter(cuts, "h1"))
    free = body.where("not _hit").select("_row.*")
    met = body.where("_hit").join(cuts, KEY, "left")
    changed = F.col("_cuts").isNotNull()
    met = met.withColumn("_new", F.when(changed, F.expr(f"array_join({PIECES}, '')")).otherwise(F.col("_text")))
    made = {"text": F.col("_new")}
    if "n_chars" in names:
        size = F.char_length("_new").cast(kinds["n_chars"])
        made["n_chars"] = F.when(changed, size).otherwise(F.col("_row.n_chars"))
    for name, value in (also or {}).items():
        made[name] = F.when(changed, value).otherwise(F.col(f"_row.`{name}`"))
    return free.union(met.select(*[made.get(c, F.col(f"_row.`{c}`")).alias(c) for c in names]))
