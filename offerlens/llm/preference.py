"""Preference formatting: one prompt, two masked completions, in DataFrame functions only.

A pair has a chosen and a rejected conversation. Their longest common prefix of whole turns (equal role and
text) is rendered once as the prompt; what remains of either is a completion, with the character spans that
count towards the loss: the text of assistant turns and their end marks.

Turns are ordered by (turn, role, text), so ties and repeated rows have one order. A null turn comes first; a
null role is `unknown`, a null text empty; rows without a pair id are dropped. A mark's opening `<|` inside a
text or a role is rendered as `< |`, and a line break in a role as a space, so neither can forge a turn. A side
without turns (a missing partner), or one that its prompt uses up (equal replies), has an empty completion; `usable`
is true only where both completions hold a turn. Extra columns are ignored; an empty table gives no rows. A conversation is gathered in one row, as its rendering is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of a rendered turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns_of(table: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns): each conversation's cleaned turns (role, text) in order."""
    t = table.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias(key),
        F.struct(
            F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
            F.translate(F.replace(F.coalesce("role", F.lit("unknown")), F.lit("<|"), F.lit("< |")), "\r\n", "  ").alias("role"),
            F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
        ).alias("t"),
    )
    return t.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))), "")


def loss_spans(turns: Column) -> Column:
    """[(start, end)] of the parts of render(turns) that count towards the loss."""
    head = len(OPEN) + 1

    def step(acc, t):
        start = acc["pos"] + head + F.length(t["role"])
        end = start + F.length(t["text"]) + len(CLOSE)
        own = F.when(t["role"] == "assistant", F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((end + 1).alias("pos"), F.concat(acc["spans"], own).alias("spans"))

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """How many turns both begin with."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.transform(F.slice(a, 1, n), lambda x, i: F.when(x == F.get(b, i), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_min(differ), n)


def format_pairs(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """pairs: (key, chosen, rejected), either an array of turns (role, text)."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    p = pairs.select(key, F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r")).withColumn("n", common_turns(F.col("c"), F.col("r")))
    rest = lambda x: F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0)))
    p = p.select(key, "n", F.slice("c", 1, F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return p.select(
        key,
        F.col("n").cast("long").alias("prompt_turns"),
        render(F.col("p")).alias("prompt"),
        render(F.col("c")).alias("chosen"),
        loss_spans(F.col("c")).alias("chosen_loss"),
        render(F.col("r")).alias("rejected"),
        loss_spans(F.col("r")).alias("rejected_loss"),
        ((F.size("c") > 0) & (F.size("r") > 0)).alias("usable"),
    )


def sampled_rejections(conversations: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected) from plain conversations: the chosen side ends with the last assistant turn,
    the rejected side has, in its place, the last assistant turn of the conversation whose id differs in the
    lowest bit (none if there is none). Conversations without an assistant turn make no pair."""
    t = turns_of(conversations)
    places = F.filter(F.transform("turns", lambda x, i: F.when(x["role"] == "assistant", i)), lambda i: i.isNotNull())
    t = t.withColumn("last", F.array_max(places)).where("last is not null")
    t = t.select("conv_id", F.slice("turns", 1, F.col("last") + 1).alias("chosen"), F.slice("turns", 1, F.col("last")).alias("before"), F.get("turns", F.col("last")).alias("reply"))
    other = t.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("reply").alias("other"))
    return t.join(other, "conv_id", "left").select(
        F.col("conv_id").alias("pair_id"), "chosen", F.when(F.col("other").isNull(), F.col("before")).otherwise(F.concat("before", F.array("other"))).alias("rejected")
    )


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")


ORACLE = f"""
WITH t AS (
  SELECT id, role, text, row_number() OVER (PARTITION BY id ORDER BY turn, role, text) AS n
  FROM (SELECT CAST(conv_id AS BIGINT) AS id, coalesce(turn, -1) AS turn, translate(replace(coalesce(role, 'unknown'), '<|', '< |'), chr(13) || chr(10), '  ') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
        FROM conversations WHERE conv_id IS NOT NULL)),
last AS (SELECT id, max(n) AS last, max_by(text, n) AS reply FROM t WHERE role = 'assistant' GROUP BY id),
side AS (
  SELECT t.id, 'c' AS side, t.n, t.role, t.text FROM t JOIN last l ON t.id = l.id AND t.n <= l.last
  UNION ALL
  SELECT t.id, 'r', t.n, t.role, CASE WHEN t.n = l.last THEN o.reply ELSE t.text END
  FROM t JOIN last l ON t.id = l.id LEFT JOIN last o ON o.id = xor(l.id, 1) WHERE t.n < l.last OR (t.n = l.last AND o.id IS NOT NULL)),
lcp AS (
  SELECT l.id, coalesce(min(m.n) - 1, max(least(l.last, coalesce(z.k, 0)))) AS p
  FROM last l LEFT JOIN (SELECT id, count(*) AS k FROM side WHERE side = 'r' GROUP BY id) z ON z.id = l.id
  LEFT JOIN (SELECT a.id, a.n FROM side a JOIN side b ON a.id = b.id AND a.n = b.n AND a.side = 'c' AND b.side = 'r'
             WHERE a.role <> b.role OR a.text <> b.text) m ON m.id = l.id
  GROUP BY l.id),
part AS (
  SELECT s.id, CASE WHEN s.n <= p THEN 'p' ELSE s.side END AS part, s.n, s.role, '{OPEN}' || s.role || chr(10) || s.text || '{CLOSE}' || chr(10) AS line, p
  FROM side s JOIN lcp USING (id) WHERE s.n > p OR s.side = 'c'),
placed AS (SELECT *, sum(length(line)) OVER (PARTITION BY id, part ORDER BY n) - length(line) AS start FROM part),
done AS (
  SELECT id, part, string_agg(line, '' ORDER BY n) AS text,
         string_agg(CASE WHEN role = 'assistant' THEN CAST(CAST(start + {len(OPEN) + 1} + length(role) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start + length(line) - 1 AS BIGINT) AS VARCHAR) END, ',' ORDER BY n) AS loss
  FROM placed GROUP BY id, part)
SELECT l.id AS pair_id, CAST(l.p AS BIGINT) AS prompt_turns, coalesce(p.text, '') AS prompt, coalesce(c.text, '') AS chosen, coalesce(c.loss, '') AS chosen_loss,
       coalesce(r.text, '') AS rejected, coalesce(r.loss, '') AS rejected_loss, c.id IS NOT NULL AND r.id IS NOT NULL AS usable
FROM lcp l LEFT JOIN done p ON p.id = l.id AND p.part = 'p' LEFT JOIN done c ON c.id = l.id AND c.part = 'c' LEFT JOIN done r ON r.id = l.id AND r.part = 'r'
"""
