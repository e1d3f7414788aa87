"""Preference pairs as training turns: the common prompt once, then both completions with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
TRAINED_ROLE = "assistant"


def _one_per_turn(turns: DataFrame, key: str) -> DataFrame:
    """(key, turn, role, text), one row per key and turn: of repeated rows the smallest; nulls become empty strings."""
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (turns.filter(F.col(key).isNotNull() & F.col("turn").isNotNull()).groupBy(key, "turn")
            .agg(F.min(said).alias("said")).select(key, "turn", "said.role", "said.text"))


def _header(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.regexp_replace(role, r"[^A-Za-z0-9_]", ""), F.lit("|>\n"))


def _body(text: Column) -> Column:
    """The text, so that it cannot end a turn or start one."""
    return F.concat(F.regexp_replace(text, r"<\|", "< |"), F.lit(END))


def preference_turns(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, part, turn, role, rendered, mask_start, mask_end): the rendered turns of preference pairs.

    Both inputs hold (pair_id, turn, role, text). The longest common prefix of turns (same turn number, role and
    text) is rendered once, as part `prompt`; the turns from the first difference on are the parts `chosen` and
    `rejected`. Characters mask_start to mask_end of a rendered turn count for the loss: what the assistant says in a
    completion, with the end mark; elsewhere the mask is empty (both 0).

    A turn is a row, so a conversation of any length is never gathered. Rows without pair_id or turn are left out, of
    repeated turns the smallest (role, text) counts, null role or text is empty. A pair of which one side is missing
    has an empty prompt; equal sides are all prompt. Further columns are ignored.
    """
    left = _one_per_turn(chosen, "pair_id").select("pair_id", "turn", F.struct("role", "text").alias("c"))
    right = _one_per_turn(rejected, "pair_id").select("pair_id", "turn", F.struct("role", "text").alias("r"))
    both = left.join(right, ["pair_id", "turn"], "full").withColumn("same", F.col("c").eqNullSafe(F.col("r")))
    forks = both.filter("not same").groupBy("pair_id").agg(F.min("turn").alias("fork"))
    placed = both.join(forks, "pair_id", "left")
    shared = F.col("fork").isNull() | (F.col("turn") < F.col("fork"))
    prompt = F.when(shared, F.array(F.struct(F.lit("prompt").alias("part"), F.col("c").alias("said"))))
    sides = F.array(F.struct(F.lit("chosen").alias("part"), F.col("c").alias("said")),
                    F.struct(F.lit("rejected").alias("part"), F.col("r").alias("said")))
    rows = (placed.select("pair_id", "turn", F.explode(F.coalesce(prompt, sides)).alias("x"))
            .filter("x.said is not null").select("pair_id", "turn", "x.part", "x.said.role", "x.said.text"))
    trained = (F.col("part") != "prompt") & (F.col("role") == TRAINED_ROLE)
    header, body = _header(F.col("role")), _body(F.col("text"))
    return rows.select("pair_id", "part", "turn", "role", F.concat(header, body).alias("rendered"),
                       F.when(trained, F.length(header)).otherwise(0).alias("mask_start"),
                       F.when(trained, F.length(header) + F.length(body)).otherwise(0).alias("mask_end"))


def assemble(turns: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, rejected, chosen_masks, rejected_masks): one row per pair of `preference_turns`.

    Masks are struct(start, end) in characters of their completion. For conversations that fit a row.
    """
    def part(name: str) -> list[Column]:
        rows = F.sort_array(F.collect_list(F.when(F.col("part") == name, F.struct(
            "turn", "rendered", "mask_start", "mask_end"))))
        start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<start:int,end:int>>").alias("masks"))
        done = F.aggregate(rows, start, lambda acc, t: F.struct(
            F.concat(acc["text"], t["rendered"]).alias("text"),
            F.when(t["mask_end"] > 0, F.concat(acc["masks"], F.array(F.struct(
                (F.length(acc["text"]) + t["mask_start"]).alias("start"),
                (F.length(acc["text"]) + t["mask_end"]).alias("end"))))).otherwise(acc["masks"]).alias("masks")))
        return done

    made = turns.groupBy("pair_id").agg(part("prompt").alias("p"), part("chosen").alias("c"), part("rejected").alias("r"))
    return made.select("pair_id", F.col("p.text").alias("prompt"), F.col("c.text").alias("chosen"),
                       F.col("r.text").alias("rejected"), F.col("c.masks").alias("chosen_masks"),
                       F.col("r.masks").alias("rejected_masks"))


def pairs_from_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs that plain conversations (conv_id, turn, role, text) imply: (chosen, rejected).

    One reply of each conversation, that of the least hash of (conv_id, turn), is where the sides part. Chosen keeps it;
    in the rejected one the assistant says there again what it said the time before or, where it has not spoken yet,
    what was said last, nothing if nothing was. The rest of the conversation follows on one side only, by the same
    hash: on the chosen one, which goes on while the rejected one ends, or on the rejected one, which has to go on where
    the chosen one is done. So every turn of a conversation is kept, the fork may be any reply, and either side may be
    the longer. Where both sides say the same they part later or, at the end of the conversation, not at all.

    A conversation without a reply gives no pair. Repeated rows, nulls and further columns as in `preference_turns`.
    """
    turns = _one_per_turn(conversations, "conv_id").withColumnRenamed("conv_id", "pair_id")
    drawn = F.md5(F.concat_ws(":", F.col("pair_id").cast("string"), F.col("turn").cast("string")))
    forks = (turns.filter(F.col("role") == TRAINED_ROLE).groupBy("pair_id")
             .agg(F.min(F.struct(drawn.alias("drawn"), "turn")).alias("least"))
             .select("pair_id", F.col("least.turn").alias("fork"), (F.col("least.drawn") < "8").alias("chosen_goes_on")))
    placed = turns.join(forks, "pair_id")
    earlier = placed.filter("turn < fork")
    said = earlier.groupBy("pair_id").agg(
        F.max_by("text", F.struct(F.col("role") == TRAINED_ROLE, "turn")).alias("text"))
    stale = (forks.join(said, "pair_id", "left")
             .select("pair_id", F.col("fork").alias("turn"), F.lit(TRAINED_ROLE).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text")))
    columns = ["pair_id", "turn", "role", "text"]
    chosen = placed.filter("turn <= fork or chosen_goes_on").select(*columns)
    rejected = placed.filter("turn < fork or (turn > fork and not chosen_goes_on)").select(*columns)
    return chosen, rejected.unionAll(stale)
