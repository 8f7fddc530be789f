"""Chat formatting: preference pairs as one shared prompt and two masked completions, in built-in expressions only.

Rows stay one per message and carry pair_id, part and pos, so no conversation has to fit into a cell or a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwright.operators.sequences import blocks, numbered

from .common import table, written

#: The template of one message: role between OPEN and MIDDLE, then the text, then CLOSE.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
#: The place of turns without a number: after all others.
LAST = (1 << 63) - 1


def rendered(role: Column, text: Column) -> Column:
    """One message in the template. ``<|`` of a text or role gets a second bar, so does ``|>`` of a role: taking one bar away restores them."""
    opened = lambda x: F.replace(x, F.lit("<|"), F.lit("<||"))
    return F.concat(F.lit(OPEN), F.replace(opened(role), F.lit("|>"), F.lit("||>")), F.lit(MIDDLE), opened(text), F.lit(CLOSE))


def _numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with n, from 1 in order of keys: places within range partitions, and where each partition begins."""
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    placed = written(placed, "placed")
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("part")) - F.col("size")  # one row per partition
    numbered = placed.withColumn("part", part).join(F.broadcast(sizes.select("part", before.alias("start"))), "part")
    return numbered.withColumn("n", F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "start", "place")


def messages(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), role and text of every message, in order of turn, role and text.

    Rows of a turn with equal role and text count once. A null role is ``unknown``, a null text is empty, a null turn
    comes last; rows without conv_id are left out. Positions come from blocks of 65,536 turns whose sizes are carried
    on, so a conversation of many turns is many tasks.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = numbered(rows.distinct(), ["conv_id"], ["turn", "role", "text"], "n", blocks("turn"))
    return rows.select("conv_id", (F.col("n") - 1).alias("pos"), "role", "text")


def preference_pairs(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per message: pair_id, part (prompt, chosen or rejected), pos, role, text (rendered), loss.

    ``pairs`` has pair_id, chosen_id and rejected_id; ``conversations`` has conv_id, turn, role and text. The longest
    run of first messages in which both conversations agree in roles and texts is the prompt, given once; the messages
    after it are the two completions. ``loss`` marks what is learned from: the assistant's messages of a completion.

    A preference needs two completions: pairs of which one conversation is missing, or is equal to or the beginning of
    the other, give no rows. Null parts and repeated rows of conversations are as in ``messages``; repeated rows of
    pairs count once, rows of pairs with a null are left out. Empty tables give an empty result; other columns are ignored.
    """
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("chosen_id").alias("of")), F.struct(F.lit(1).alias("side"), F.col("rejected_id").alias("of")))
    sides = pairs.where("pair_id IS NOT NULL").select("pair_id", F.explode(sides).alias("x")).select("pair_id", "x.side", "x.of").distinct()
    return formatted(messages(conversations).join(sides, F.col("conv_id") == F.col("of")).select("pair_id", "side", "pos", "role", "text"))


def formatted(rows: DataFrame, unpaired: bool = False) -> DataFrame:
    """The result of preference_pairs for rows pair_id, side (0 chosen, 1 rejected), pos, role, text; one for each pair, side and pos.

    With ``unpaired``, pairs of which one side is missing, equal to or the beginning of the other are given too, with no loss.
    """
    of = lambda side: F.max(F.when(F.col("side") == side, F.struct("role", "text")))
    both = rows.groupBy("pair_id", "pos").agg(of(0).alias("c"), of(1).alias("r"))
    end = lambda x: F.max(F.when(F.col(x).isNotNull(), F.col("pos")))
    cuts = both.groupBy(F.col("pair_id").alias("p")).agg(F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("pos"))).alias("cut"), F.least(end("c"), end("r")).alias("end"), F.count("c").alias("nc"), F.count("r").alias("nr"))
    cuts = cuts.select("p", F.coalesce("cut", F.lit(LAST)).alias("cut"), F.coalesce((F.col("nc") > 0) & (F.col("nr") > 0) & (F.col("end") >= F.col("cut")), F.lit(False)).alias("paired"))
    placed = both.join(cuts if unpaired else cuts.where("paired"), F.col("pair_id") == F.col("p"))
    row = lambda part, m: F.struct(F.lit(part).alias("part"), F.col(m)["role"].alias("role"), F.col(m)["text"].alias("text"))
    answers = F.array_compact(F.array(F.when(F.col("c").isNotNull(), row("chosen", "c")), F.when(F.col("r").isNotNull(), row("rejected", "r"))))
    out = placed.select("pair_id", "pos", "paired", F.explode(F.when(F.col("pos") < F.col("cut"), F.array(row("prompt", "c"))).otherwise(answers)).alias("m"))
    loss = F.col("paired") & (F.col("m.part") != "prompt") & (F.col("m.role") == "assistant")
    return out.select("pair_id", "m.part", "pos", "m.role", rendered(F.col("m.role"), F.col("m.text")).alias("text"), loss.alias("loss"))


def _followed(ids: DataFrame) -> DataFrame:
    """conv_id and other: the next one in order, for the last one the first. Windows within blocks of ids, then one row for each block."""
    rows = ids.withColumn("block", blocks("conv_id"))
    rows = rows.withColumn("other", F.lead("conv_id").over(Window.partitionBy("block").orderBy("conv_id")))
    firsts = rows.groupBy(F.col("block").alias("b")).agg(F.min("conv_id").alias("first"))
    whole = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("b", F.coalesce(F.lead("first").over(Window.orderBy("b")), F.min("first").over(whole)).alias("after"))  # one row for each block
    return rows.join(after, F.col("block") == F.col("b")).select("conv_id", F.coalesce("other", "after").alias("other"))


def continued_pairs(conversations: DataFrame) -> DataFrame:
    """pair_id, side, pos, role, text: every whole conversation, against its beginning with the rest of another one.

    Of each conversation one reply is drawn by a hash of its place; where there is none, its last message. The rejected side has
    what comes before that, and then the next conversation in order of conv_id (after the last one: the first) from the
    place that was drawn there on. So either side may go on for many turns, and may agree beyond the place. pair_id is the conv_id.
    """
    rows = written(messages(conversations), "messages")
    drawn = F.when(F.col("role") == "assistant", F.md5(F.concat_ws(":", "conv_id", "pos").cast("binary")))
    places = rows.groupBy("conv_id").agg(F.coalesce(F.min_by("pos", drawn), F.max("pos")).alias("place"))
    places = places.join(_followed(places.select("conv_id")).withColumnRenamed("conv_id", "c"), F.col("conv_id") == F.col("c")).drop("c")
    heads = rows.join(places.select(F.col("conv_id").alias("pair_id"), "place"), F.col("conv_id") == F.col("pair_id")).where("pos < place")
    begins = places.select(F.col("conv_id").alias("d"), F.col("place").alias("from"))
    rests = rows.join(places.select("other", F.col("conv_id").alias("pair_id"), "place"), F.col("conv_id") == F.col("other")).join(begins, F.col("other") == F.col("d")).where("pos >= from")
    side = lambda df, k, pair, pos: df.select(pair.alias("pair_id"), F.lit(k).alias("side"), pos.alias("pos"), "role", "text")
    pair, pos = F.col("pair_id"), F.col("pos")
    return side(rows, 0, F.col("conv_id"), pos).union(side(heads, 1, pair, pos)).union(side(rests, 1, pair, F.col("place") + pos - F.col("from")))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs of all ``conversations``: each whole one over its beginning with the rest of another one. No message is left out."""
    return formatted(continued_pairs(table(spark, sf_dir, "conversations")), unpaired=True)


#: What both queries' SQL begins with: messages with their positions, and the template.
_MESSAGES_SQL = r"""
WITH d AS (
  SELECT DISTINCT conv_id, coalesce(turn, 9223372036854775807) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), m AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, role, text FROM d
)"""
_TEXT_SQL = "'<|' || replace(replace(role, '<|', '<||'), '|>', '||>') || '|>' || chr(10) || replace(text, '<|', '<||') || '<|end|>' || chr(10)"

OP8_SQL = f"""{_MESSAGES_SQL}, l AS (
  SELECT conv_id, coalesce(arg_min(pos, md5(conv_id || ':' || pos)) FILTER (WHERE role = 'assistant'), max(pos)) AS place FROM m GROUP BY conv_id
), o AS (
  SELECT conv_id, place, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS other FROM l
), s AS (
  SELECT conv_id AS pair_id, 0 AS side, pos, role, text FROM m
  UNION ALL SELECT conv_id, 1, pos, role, text FROM m JOIN o USING (conv_id) WHERE pos < place
  UNION ALL SELECT o.conv_id, 1, o.place + m.pos - l.place, role, text FROM o JOIN l ON l.conv_id = o.other JOIN m ON m.conv_id = o.other WHERE m.pos >= l.place
), b AS (
  SELECT pair_id, pos, max(struct_pack(role := role, text := text)) FILTER (WHERE side = 0) AS c,
         max(struct_pack(role := role, text := text)) FILTER (WHERE side = 1) AS r FROM s GROUP BY ALL
), k AS (
  SELECT pair_id, coalesce(min(pos) FILTER (WHERE c IS DISTINCT FROM r), {LAST}) AS cut, max(pos) FILTER (WHERE c IS NOT NULL) AS ce, max(pos) FILTER (WHERE r IS NOT NULL) AS re FROM b GROUP BY pair_id
)
SELECT pair_id, CASE WHEN pos < cut THEN 'prompt' WHEN side = 0 THEN 'chosen' ELSE 'rejected' END AS part, pos, role, {_TEXT_SQL} AS text,
       pos >= cut AND role = 'assistant' AND least(ce, re) >= cut AS loss
FROM s JOIN k USING (pair_id) WHERE NOT (pos < cut AND side = 1)
"""


def reply_pairs(conversations: DataFrame) -> DataFrame:
    """One row per message: conv_id, pos, part (prompt, chosen or rejected), role, text (rendered), loss.

    Every message of the assistant is a reply, chosen over the next reply of the table in order of conv_id and pos (the
    last one over the first), put after the same earlier messages. Both answers have conv_id and pos of the chosen
    reply; what they share are the conversation's ``prompt`` rows of smaller pos. Every message is a prompt row once, so
    the histories of a conversation's pairs are joined by key and their number does not grow with its square. A reply
    equal to the next one has prompt rows only. Nulls and repeated rows are as in ``messages``.
    """
    rows = messages(conversations)
    replies = _numbered(rows.where("role = 'assistant'"), "conv_id", "pos")
    total = replies.agg(F.count("*").alias("k"))
    others = replies.select(F.col("n").alias("n2"), F.col("text").alias("other"))
    pairs = replies.crossJoin(F.broadcast(total)).withColumn("next", F.col("n") % F.col("k") + 1)  # one row
    pairs = pairs.join(others, F.col("next") == F.col("n2")).where("text <> other")
    answer = lambda part, text: F.struct(F.lit(part).alias("part"), F.col("role"), F.col(text).alias("text"))
    out = rows.select("conv_id", "pos", answer("prompt", "text").alias("m")).union(pairs.select("conv_id", "pos", F.explode(F.array(answer("chosen", "text"), answer("rejected", "other"))).alias("m")))
    loss = (F.col("m.part") != "prompt") & (F.col("m.role") == "assistant")
    return out.select("conv_id", "pos", "m.part", "m.role", rendered(F.col("m.role"), F.col("m.text")).alias("text"), loss.alias("loss"))


def op8_reply_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reply of ``conversations`` against another one after the same earlier turns."""
    return reply_pairs(table(spark, sf_dir, "conversations"))


OP8_REPLIES_SQL = f"""{_MESSAGES_SQL}, n AS (
  SELECT *, row_number() OVER (ORDER BY conv_id, pos) AS n, count(*) OVER () AS k FROM m WHERE role = 'assistant'
), p AS (
  SELECT a.conv_id, a.pos, a.text AS c, b.text AS r FROM n a JOIN n b ON b.n = a.n % a.k + 1 WHERE a.text <> b.text
), o AS (
  SELECT conv_id, pos, 'prompt' AS part, role, text FROM m
  UNION ALL SELECT conv_id, pos, 'chosen', 'assistant', c FROM p
  UNION ALL SELECT conv_id, pos, 'rejected', 'assistant', r FROM p
)
SELECT conv_id, pos, part, role, {_TEXT_SQL} AS text, part <> 'prompt' AND role = 'assistant' AS loss FROM o
"""
