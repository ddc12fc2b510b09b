"""Preference formatting of chosen and rejected conversations.

The longest prefix of turns that both sides share (same turn number, role and text) is rendered once as the prompt; the
turns after it are each side's completion, and of those the assistant's are what the loss is taken over. ``preference``
gives one row for each rendered turn; ``paired`` makes pair records of them: prompt, chosen and rejected completion, and for each
completion a mask, the spans of it (code points, end exclusive) that the loss is taken over.

A record is a whole pair of up to ``PART`` turns, whatever their numbers. A pair with more turns is several records, by the turns'
places in the pair, so that no record grows with a conversation; their texts in order of their parts are the whole, and those after
the prompt's end have none of it. Places are counted by spans of ``SPAN`` turn numbers, so no task holds a conversation. Turns
are compared by joins on (pair, turn) with partial aggregates only.

Nulls: a null role or text equals another null and renders as empty. Of several rows for one turn (repeats, ties) the least
(role, text) is used. Rows without a conversation id or turn are left out, as they have no place. A conversation whose partner is
missing keeps its turns as a completion, with ``paired`` false; the other side is empty. Texts of any length are rendered whole.
Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, spread

OPEN = "<|im_start|>"
CLOSE = "<|im_end|>\n"
#: Turns of a pair that one record holds at most, and turn numbers that are counted together.
PART = 8192
SPAN = 1024


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def preference(turns: DataFrame, pair: Column, chosen: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(pair_id, side, turn, place, role, loss, paired, rendered): side is prompt, chosen or rejected.

    ``pair`` numbers the pair that a row's conversation belongs to, ``chosen`` says which side of it that is.
    """
    rows = turns.select(pair.alias("pair_id"), chosen.alias("is_chosen"), F.col(turn_col).alias("turn"), F.struct(F.col(role_col).alias("role"), F.col(text_col).alias("text")).alias("said"))
    rows = rows.where("pair_id is not null and is_chosen is not null and turn is not null")
    # One row for each turn, with both sides in it; nothing that a pair has is ever gathered.
    both = rows.groupBy("pair_id", "turn").agg(F.min(F.when(F.col("is_chosen"), F.col("said"))).alias("c"), F.min(F.when(~F.col("is_chosen"), F.col("said"))).alias("r"))
    same = F.col("c").isNotNull() & F.col("r").isNotNull() & F.col("c").eqNullSafe(F.col("r"))
    both = both.withColumn("span", F.floor(F.col("turn") / SPAN).cast("bigint"))
    heads = both.groupBy(F.col("pair_id").alias("_pair"), F.col("span").alias("_span")).agg(F.count("*").alias("n"), F.min(F.when(~same, F.col("turn"))).alias("first"), F.count("c").alias("cs"), F.count("r").alias("rs"))
    pairs = Window.partitionBy("_pair")  # a row for each span of a pair
    before = F.coalesce(F.sum("n").over(pairs.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select("_pair", "_span", before.alias("before"), F.min("first").over(pairs).alias("parts"), (F.sum("cs").over(pairs) * F.sum("rs").over(pairs) > 0).alias("paired"))
    at = F.row_number().over(Window.partitionBy("pair_id", "span").orderBy("turn")) - 1  # of SPAN turns at most
    found = both.withColumn("at", at).join(spread(heads, "_pair", "_span"), (F.col("pair_id") == F.col("_pair")) & (F.col("span") == F.col("_span"))).withColumn("place", F.col("at") + F.col("before"))
    prompt = F.col("parts").isNull() | (F.col("turn") < F.col("parts"))
    row = lambda side, said: F.struct(F.lit(side).alias("side"), said["role"].alias("role"), said["text"].alias("text"))
    sides = F.when(prompt, F.array(row("prompt", F.col("c")))).otherwise(F.array_compact(F.array(F.when(F.col("c").isNotNull(), row("chosen", F.col("c"))), F.when(F.col("r").isNotNull(), row("rejected", F.col("r"))))))
    made = found.select("pair_id", "turn", "place", "paired", F.explode(sides).alias("x"))
    loss = (F.col("x.side") != "prompt") & F.coalesce(F.col("x.role") == "assistant", F.lit(False))
    return made.select("pair_id", F.col("x.side").alias("side"), "turn", "place", F.coalesce("x.role", F.lit("")).alias("role"), loss.alias("loss"), "paired", rendered(F.col("x.role"), F.col("x.text")).alias("rendered"))


def assembled(segments: DataFrame, part: int = PART) -> DataFrame:
    """(pair_id, part, paired, prompt, chosen, rejected, chosen_mask, rejected_mask): the records of ``preference``'s rows."""
    said = F.array_sort(F.collect_list(F.struct("side", "turn", "rendered", "loss")))  # of ``part`` turns, three sides at most
    rows = segments.groupBy("pair_id", F.floor(F.col("place") / part).cast("bigint").alias("part"), "paired").agg(said.alias("said"))
    of = lambda side: F.filter("said", lambda x: x["side"] == side)
    text = lambda side: F.array_join(F.transform(of(side), lambda x: x["rendered"]), "").alias(side)

    def mask(side: str) -> Column:
        ends = F.aggregate(of(side), F.array().cast("array<int>"), lambda z, x: F.concat(z, F.array(F.coalesce(F.get(z, F.size(z) - 1), F.lit(0)) + F.length(x["rendered"]))))
        spans = let(ends, lambda e: F.transform(of(side), lambda x, i: F.when(x["loss"], F.concat_ws(":", (e[i] - F.length(x["rendered"])).cast("string"), e[i].cast("string")))))
        return F.array_join(F.array_compact(spans), ",").alias(f"{side}_mask")

    return rows.select("pair_id", "part", "paired", text("prompt"), text("chosen"), text("rejected"), mask("chosen"), mask("rejected"))


def paired(turns: DataFrame, pair: Column, chosen: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = PART) -> DataFrame:
    """The pair records of conversations."""
    return assembled(preference(turns, pair, chosen, turn_col, role_col, text_col), part)


def oracle() -> str:
    """The query's rows (conversations 2k and 2k + 1 are pair k) as DuckDB SQL."""
    return f"""
    WITH rows AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS is_chosen, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    one AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY pair_id, is_chosen, turn ORDER BY role NULLS FIRST, text NULLS FIRST) = 1),
    c AS (SELECT * FROM one WHERE is_chosen), r AS (SELECT * FROM one WHERE NOT is_chosen),
    sides AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.turn, r.turn) AS turn, c.role AS crole, c.text AS ctext, r.role AS rrole, r.text AS rtext,
                    c.pair_id IS NOT NULL AS has_c, r.pair_id IS NOT NULL AS has_r FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.turn = r.turn),
    parting AS (SELECT pair_id, min(CASE WHEN NOT (has_c AND has_r AND crole IS NOT DISTINCT FROM rrole AND ctext IS NOT DISTINCT FROM rtext) THEN turn END) AS parts, bool_or(has_c) AND bool_or(has_r) AS paired FROM sides GROUP BY pair_id),
    made AS (
      SELECT b.pair_id, CASE WHEN parts IS NULL OR turn < parts THEN 'prompt' ELSE 'chosen' END AS side, turn, crole AS role, ctext AS text, paired FROM sides b JOIN parting p ON b.pair_id = p.pair_id WHERE has_c
      UNION ALL
      SELECT b.pair_id, 'rejected', turn, rrole, rtext, paired FROM sides b JOIN parting p ON b.pair_id = p.pair_id WHERE has_r AND NOT (parts IS NULL OR turn < parts)),
    segments AS (SELECT pair_id, side, turn, side <> 'prompt' AND coalesce(role = 'assistant', false) AS loss, paired,
           '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered FROM made),
    numbered AS (SELECT *, (dense_rank() OVER (PARTITION BY pair_id ORDER BY turn) - 1) // {PART} AS part FROM segments),
    placed AS (SELECT *, sum(length(rendered)) OVER (PARTITION BY pair_id, side, part ORDER BY turn) AS upto FROM numbered)
    SELECT pair_id, part, paired, coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (side = 'prompt'), '') AS prompt,
           coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (side = 'chosen'), '') AS chosen, coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (side = 'rejected'), '') AS rejected,
           coalesce(string_agg((upto - length(rendered)) || ':' || upto, ',' ORDER BY turn) FILTER (side = 'chosen' AND loss), '') AS chosen_mask,
           coalesce(string_agg((upto - length(rendered)) || ':' || upto, ',' ORDER BY turn) FILTER (side = 'rejected' AND loss), '') AS rejected_mask
    FROM placed GROUP BY pair_id, part, paired"""
