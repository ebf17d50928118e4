"""Preference formatting (operator 6): chosen and rejected conversations to a shared prompt and two masked completions.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twigline.llm.common import packed, unpacked

#: Text put before a turn (with its role), and after it.
OPEN, CLOSE = "<|turn {}|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"
#: Parts that the conversations with one opening turn are paired in.
PAIR_BUCKETS = 4096


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _safe(text: Column) -> Column:
    """A text can't open a marker of its own: ``<|`` gets a backslash between its signs, and one more if it has some."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """The turn's own text from a rendered one."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _head(turn: Column) -> Column:
    before, after = OPEN.split("{}")
    return F.concat(F.lit(before), _safe(F.coalesce(turn["role"], F.lit("unknown"))), F.lit(after))


def _body(turn: Column) -> Column:
    return F.concat(_safe(F.coalesce(turn["text"], F.lit(""))), F.lit(CLOSE))


def _mask(turns: Column) -> Column:
    """Run lengths of characters and whether they are trained on: ``characters:0`` or ``characters:1``, by commas."""
    run = lambda t: F.concat(
        F.char_length(_head(t)), F.lit(":0,"), F.char_length(_body(t)), F.lit(":"),
        F.when(t["role"] == TRAINED_ROLE, "1").otherwise("0"),
    )
    return F.array_join(F.transform(turns, run), ",")


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """For each row with two arrays of turns (structs with role and text): shared prompt and both completions.

    The longest common prefix of turns (same role, same text, nulls equal) is rendered once as ``prompt``; what follows
    it is rendered as ``chosen_text`` and ``rejected_text`` with masks that cover exactly their characters: only bodies
    of assistant turns are trained on.  ``common_turns`` counts the prefix.  Other columns stay, those of these names and
    the two arrays give way.

    Null arrays count as empty; null roles render as "unknown" and null texts as empty; equal conversations give two
    empty completions; repeated rows stay; an empty table gives no rows.
    """
    made = ("common_turns", "prompt", "chosen_text", "chosen_mask", "rejected_text", "rejected_mask")
    keep = [c for c in pairs.columns if c not in (*made, chosen, rejected)]
    kind = "array<struct<role:string,text:string>>"
    slim = lambda c: F.coalesce(
        F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), F.array().cast(kind)
    )
    rows = pairs.select(packed(keep), slim(F.col(chosen)).alias("_a"), slim(F.col(rejected)).alias("_b"))
    shorter = F.least(F.size("_a"), F.size("_b"))
    # nulls in the longer array's tail compare unequal, but only positions up to the shorter length count
    same = F.zip_with("_a", "_b", lambda a, b: a.eqNullSafe(b))
    first = F.array_position(same, False).cast("int")
    common = F.when(first == 0, shorter).otherwise(F.least(shorter, first - 1))
    rows = rows.select("_keep", "_a", "_b", common.alias("_n"))
    tail = lambda c: F.slice(c, F.col("_n") + 1, F.size(c))
    rows = rows.select("_keep", "_n", F.slice("_a", F.lit(1), F.col("_n")).alias("_p"), tail("_a").alias("_a"), tail("_b").alias("_b"))
    return rows.select(
        *unpacked(keep), F.col("_n").alias("common_turns"), _render(F.col("_p")).alias("prompt"),
        _render(F.col("_a")).alias("chosen_text"), _mask(F.col("_a")).alias("chosen_mask"),
        _render(F.col("_b")).alias("rejected_text"), _mask(F.col("_b")).alias("rejected_mask"),
    )


def partners(conversations: DataFrame) -> DataFrame:
    """(conv_id, partner) of every conversation in a table of turns: another one that opens with the same turn, or null.

    Conversations with one opening turn are dealt over ``PAIR_BUCKETS`` parts by a hash of their id, so a frequent
    opening fills no task; in each part the partner is the next id, the last one's the first.  Who is alone in a part is
    paired with the next of those alone in other parts, and the only one such with the smallest id of the others.
    """
    opening = F.min(F.struct("turn", "role", "text")).alias("t")
    firsts = conversations.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(opening)
    said = F.md5(F.to_json(F.struct(F.col("t.role").alias("role"), F.col("t.text").alias("text"))))
    return _ring(firsts.select("conv_id", said.alias("g")))


def _digest() -> Column:
    """60 bits of a conversation's id."""
    return F.conv(F.substring(F.md5(F.col("conv_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def _ring(rows: DataFrame) -> DataFrame:
    """(conv_id, partner) from (conv_id, g): as ``partners`` says, for any groups g."""
    rows = rows.select("conv_id", "g", (_digest() % PAIR_BUCKETS).alias("b"))

    def paired(some: DataFrame, *by: str) -> DataFrame:
        whole = Window.partitionBy(*by)
        line = whole.orderBy("conv_id")
        next_ = F.coalesce(F.lead("conv_id").over(line), F.min("conv_id").over(whole))
        return some.withColumns({"partner": next_, "n": F.count("*").over(whole)})

    parts = paired(rows, "g", "b")
    met = parts.filter("n > 1")
    alone = paired(parts.filter("n = 1").select("conv_id", "g", "b"), "g")
    least = met.groupBy("g").agg(F.min("conv_id").alias("least"))
    last = alone.filter("n = 1").join(least, "g", "left").select("conv_id", F.col("least").alias("partner"))
    both = met.select("conv_id", "partner").unionByName(alone.filter("n > 1").select("conv_id", "partner"))
    return both.unionByName(last)


def _collected(conversations: DataFrame) -> DataFrame:
    """(conv_id, t): the turns of each conversation in the order of turn, role and text."""
    turn = F.struct("turn", "role", "text")
    convs = conversations.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return convs.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("t"))


def answer_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, rejected_id, chosen, rejected): every conversation of a table of turns (conv_id, turn, role, text) as the
    chosen one; the rejected one is the same up to an answer, and from there on what another conversation says.

    The answer is a turn of the assistant that a hash of the id chooses; the other conversation is the next by id among
    those whose ids share a part of the hash (see ``partners``), and goes on from its own answer of the same number, in
    rounds.  Turns are ordered by turn, role and text; repeated turns stay.  A conversation without an answer, or the
    only one with any, has no rejected turns.  Rows with null ids are no conversation.
    """
    answers = F.filter(F.transform("t", lambda t, i: F.when(t["role"] == TRAINED_ROLE, i + 1)), lambda i: i.isNotNull())
    convs = _collected(conversations).select("conv_id", "t", answers.alias("a"))
    donors = _ring(convs.filter(F.size("a") > 0).select("conv_id", F.lit(0).alias("g")))
    other = convs.select(F.col("conv_id").alias("partner"), F.col("t").alias("u"), F.col("a").alias("b"))
    rows = convs.join(donors, "conv_id", "left").join(other, "partner", "left")
    nth = (F.shiftright(_digest(), 12) % F.size("a")).cast("int")
    rows = rows.withColumn("nth", F.when(F.col("partner").isNotNull(), nth))
    kept = F.slice("t", F.lit(1), F.element_at("a", F.col("nth") + 1) - 1)
    theirs = F.slice("u", F.element_at("b", F.col("nth") % F.size("b") + 1), F.size("u"))
    rejected = F.when(F.col("partner").isNotNull(), F.concat(kept, theirs))
    return rows.select("conv_id", F.col("partner").alias("rejected_id"), F.col("t").alias("chosen"), rejected.alias("rejected"))


def paired_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, rejected_id, chosen, rejected): every conversation of a table of turns (conv_id, turn, role, text) as the
    chosen one, with its partner (``partners``) as the rejected one.

    Turns are ordered by turn, role and text; repeated turns stay, and so does everything after the last answer.  A
    conversation whose opening nobody shares has no rejected turns.  Rows with null ids are no conversation.
    """
    convs = _collected(conversations)
    chosen = convs.withColumnsRenamed({"t": "chosen"}).join(partners(conversations), "conv_id")
    rejected = convs.select(F.col("conv_id").alias("partner"), F.col("t").alias("rejected"))
    out = chosen.join(rejected, "partner", "left")
    return out.select("conv_id", F.col("partner").alias("rejected_id"), "chosen", "rejected")


def op6_preference(spark, sf_dir):  # noqa: ANN001, ANN201
    """Preference records of all conversations; rejected_id is -1 where there is no other to take answers from."""
    from twigline.llm.common import table

    out = format_preferences(answer_pairs(table(spark, sf_dir, "conversations")))
    return out.withColumns({"common_turns": F.col("common_turns").cast("long"), "rejected_id": F.coalesce("rejected_id", F.lit(-1))})


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n,
         '<|turn ' || regexp_replace(coalesce(role, 'unknown'), '<(\\*)\|', '<\\\1|', 'g') || '|>' || chr(10) AS head,
         regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10) AS body
  FROM conversations WHERE conv_id IS NOT NULL
), answers AS (
  SELECT conv_id, list(n ORDER BY n) AS a, CAST('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 15) AS BIGINT) AS digest
  FROM turns WHERE role = 'assistant' GROUP BY conv_id
), dealt AS (
  SELECT *, digest % 4096 AS b, count(*) OVER (PARTITION BY digest % 4096) AS here,
         coalesce(lead(conv_id) OVER (PARTITION BY digest % 4096 ORDER BY conv_id), min(conv_id) OVER (PARTITION BY digest % 4096)) AS next
  FROM answers
), alone AS (
  SELECT *, count(*) OVER () AS left_over, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS other FROM dealt WHERE here = 1
), pairs AS (
  SELECT conv_id, next AS partner FROM dealt WHERE here > 1
  UNION ALL SELECT conv_id, other FROM alone WHERE left_over > 1
  UNION ALL SELECT conv_id, (SELECT min(conv_id) FROM dealt WHERE here > 1) FROM alone WHERE left_over = 1
), made AS (
  SELECT p.conv_id, p.partner, x.a[1 + (x.digest >> 12) % len(x.a)] - 1 AS cut, y.a[1 + ((x.digest >> 12) % len(x.a)) % len(y.a)] AS start
  FROM pairs p JOIN answers x ON x.conv_id = p.conv_id JOIN answers y ON y.conv_id = p.partner
), others AS (
  SELECT m.conv_id, t.n, t.role, t.text, t.head, t.body FROM made m JOIN turns t ON t.conv_id = m.conv_id AND t.n <= m.cut
  UNION ALL SELECT m.conv_id, t.n - m.start + m.cut + 1, t.role, t.text, t.head, t.body FROM made m JOIN turns t ON t.conv_id = m.partner AND t.n >= m.start
), lengths AS (
  SELECT conv_id, max(n) AS n FROM turns GROUP BY conv_id
), split AS (
  SELECT l.conv_id, m.partner,
         coalesce((SELECT min(a.n) - 1 FROM turns a LEFT JOIN others b ON b.conv_id = a.conv_id AND b.n = a.n
                   WHERE a.conv_id = l.conv_id AND (b.n IS NULL OR a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text)), l.n) AS common
  FROM lengths l LEFT JOIN made m ON m.conv_id = l.conv_id
), chosen AS (
  SELECT s.conv_id, coalesce(string_agg(t.head || t.body, '' ORDER BY t.n) FILTER (t.n <= s.common), '') AS prompt,
         coalesce(string_agg(t.head || t.body, '' ORDER BY t.n) FILTER (t.n > s.common), '') AS chosen_text,
         coalesce(string_agg(length(t.head) || ':0,' || length(t.body) || CASE WHEN t.role = 'assistant' THEN ':1' ELSE ':0' END, ',' ORDER BY t.n)
                  FILTER (t.n > s.common), '') AS chosen_mask
  FROM split s JOIN turns t ON t.conv_id = s.conv_id GROUP BY s.conv_id
), rejected AS (
  SELECT s.conv_id, string_agg(t.head || t.body, '' ORDER BY t.n) AS rejected_text,
         string_agg(length(t.head) || ':0,' || length(t.body) || CASE WHEN t.role = 'assistant' THEN ':1' ELSE ':0' END, ',' ORDER BY t.n) AS rejected_mask
  FROM split s JOIN others t ON t.conv_id = s.conv_id AND t.n > s.common GROUP BY s.conv_id
)
SELECT s.conv_id, coalesce(s.partner, -1) AS rejected_id, CAST(common AS BIGINT) AS common_turns, prompt, chosen_text, chosen_mask,
       coalesce(rejected_text, '') AS rejected_text, coalesce(rejected_mask, '') AS rejected_mask
FROM split s JOIN chosen c ON c.conv_id = s.conv_id LEFT JOIN rejected r ON r.conv_id = s.conv_id
"""
