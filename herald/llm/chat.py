"""Chat formatting: logged snapshots of growing conversations collapse to the longest, then turns are rendered.

A log often holds a conversation several times, each time with more turns. A
rolling hash of the turns up to each position names every prefix; a
conversation whose whole hash is a proper prefix of another is dropped by an
anti-join, and of equal conversations the one of least conv_id stays.

The rolling hash of a prefix is a sum of hashes of (position, role, text), so
that it comes from a distributed prefix sum: a conversation of any length is
never gathered in one task, and turns are rendered where they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from herald.llm._common import materialize, text_of
from herald.llm._scan import prefix_sums

#: Opening and closing of a rendered turn (the public ChatML form).
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Hash lanes of 40 bits, so that sums of up to 2**23 turns stay below 2**63.
LANES, LANE_BITS = 3, 40


def prefixes(conversations: DataFrame) -> DataFrame:
    """Each turn with its position from 1 and the hash lanes h0 h1 h2 of the prefix that ends with it.

    Null roles and texts count as empty, null conv_ids as one conversation, and
    null turns come first. Turns that tie are ordered by role, then by the MD5
    of the text. An empty table gives an empty result.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), text_of("text").alias("text"))
    keyed = turns.withColumns({"digest": F.md5("text"), "one": F.lit(1).cast("long"), "chars": F.length("text").cast("long")})
    order = [F.col("turn"), F.col("role"), F.col("digest")]  # no texts: range bounds are sampled to the driver
    placed = prefix_sums(keyed, ["conv_id"], order, {"one": "earlier"}).withColumn("position", F.col("earlier") + 1)
    for i in range(LANES):
        placed = placed.withColumn(f"v{i}", F.shiftrightunsigned(F.xxhash64(F.lit(i), "position", "role", "text"), 64 - LANE_BITS))
    summed = prefix_sums(
        placed.drop("earlier", "digest", "one"), ["conv_id"], [F.col("position")], {f"v{i}": f"b{i}" for i in range(LANES)}
    )
    return summed.select(
        "conv_id", "turn", "position", "role", "text", *[(F.col(f"b{i}") + F.col(f"v{i}")).alias(f"h{i}") for i in range(LANES)]
    )


def maximal(hashed: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns) of the conversations to keep, from :func:`prefixes`: of equal ones that of least conv_id, null last."""
    lanes = [f"h{i}" for i in range(LANES)]
    whole = hashed.groupBy("conv_id").agg(F.max(F.struct("position", *lanes)).alias("w")).select("conv_id", "w.*")
    first = whole.groupBy("position", *lanes).agg(F.min(F.struct(F.isnull("conv_id").alias("unknown"), "conv_id")).alias("c"))
    first = first.select("position", *lanes, F.col("c.conv_id").alias("conv_id"))
    length = whole.select(F.col("conv_id").alias("c"), F.col("position").alias("n"))
    inner = hashed.select("conv_id", "position", *lanes).join(length, F.col("conv_id").eqNullSafe(F.col("c"))).filter("position < n")
    inner = inner.select("position", *lanes).distinct()
    return first.join(inner, ["position", *lanes], "left_anti").select("conv_id", F.col("position").alias("n_turns"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Rendered turns of the maximal conversations: conv_id, n_turns, position, rendered.

    The conversation's text is its ``rendered`` values by position. Turns are
    ordered by turn, ties by role and the MD5 of the text; a repeated turn counts as often as
    it occurs. A null role or text is rendered as empty; rows of a null
    conv_id form one conversation. An empty table gives an empty result. Other
    columns are not read.
    """
    hashed = materialize(prefixes(conversations))
    kept = maximal(hashed).withColumnRenamed("conv_id", "c")
    rendered = F.concat(F.lit(OPEN), F.col("role"), F.lit("\n"), F.col("text"), F.lit(CLOSE)).alias("rendered")
    return hashed.join(kept, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "n_turns", "position", rendered)


def rendered_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, text): whole rendered texts, for conversations that fit in a row."""
    turns = formatted.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "rendered"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("text"))


SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS position
  FROM conversations),
p AS (
  SELECT *, md5(string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY position)) AS h,
         count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
w AS (SELECT n_turns, h, min(conv_id) AS conv_id FROM p WHERE position = n_turns GROUP BY 1, 2),
k AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.position < p.n_turns AND p.position = w.n_turns AND p.h = w.h))
SELECT p.conv_id, p.n_turns, p.position,
       '<|im_start|>' || p.role || chr(10) || p.text || '<|im_end|>' || chr(10) AS rendered
FROM p JOIN k ON p.conv_id = k.conv_id
"""
