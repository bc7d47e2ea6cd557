"""Preference formatting: prompts and masked completions from pairs of conversations.

The turns that a chosen and a rejected conversation share at their start are rendered once, as the prompt; what follows is
rendered as two completions.  A completion's mask lists the code point ranges that a loss may count: the contents of
assistant turns with their end marks.  Everything is array expressions over one row a pair, inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the rendered format; the opening of a mark inside a text is broken up with a space.
START, END, MARK = "<|im_start|>", "<|im_end|>", "<|"


def turn_of(turns: DataFrame) -> Column:
    return F.struct(
        turns["turn"].alias("turn"),
        F.coalesce(turns["role"].cast("string"), F.lit("user")).alias("role"),
        F.replace(F.coalesce(turns["text"].cast("string"), F.lit("")), F.lit(MARK), F.lit("< |")).alias("text"),
    )


def both_sides(turns: DataFrame) -> DataFrame:
    """``pair_id`` and the turns in order of side 0 (``c``) and of side 1 (``r``), of (pair_id, side, t) rows, for pairs that
    have both.  One shuffle; a pair is one output row, so its turns meet in one task."""
    side = lambda n: F.sort_array(F.collect_list(F.when(F.col("side") == n, F.col("t"))))
    return turns.where("pair_id is not null").groupBy("pair_id").agg(side(0).alias("c"), side(1).alias("r")).where((F.size("c") > 0) & (F.size("r") > 0))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns are equal in role and text."""
    shorter = F.least(F.size(a), F.size(b))
    same = lambda i: (F.get(a, i)["role"] == F.get(b, i)["role"]) & (F.get(a, i)["text"] == F.get(b, i)["text"])
    first_other = F.filter(F.sequence(F.lit(0), shorter), lambda i: (i == shorter) | ~same(i))
    return F.get(first_other, F.lit(0))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(f"{END}\n"))), "")


def mask(turns: Column) -> Column:
    """``start:end`` of every assistant content with its end mark, in code points of the rendered turns."""
    step = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["role"]) + F.length(t["text"]) + (len(START) + len(END) + 2)).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(
                    s["spans"],
                    F.array(F.concat_ws(":", (s["at"] + F.length(t["role"]) + (len(START) + 1)).cast("string"), (s["at"] + F.length(t["role"]) + F.length(t["text"]) + (len(START) + 1 + len(END))).cast("string"))),
                ),
            )
            .otherwise(s["spans"])
            .alias("spans"),
        ),
    )
    return F.array_join(step["spans"], ",")


def format_preferences(chosen: DataFrame, rejected: DataFrame, *, pair_col: str = "pair_id") -> DataFrame:
    """One row a pair that is in both tables: ``pair_id``, ``n_prompt_turns``, ``prompt``, ``chosen``, ``chosen_mask``,
    ``rejected``, ``rejected_mask``.

    Both tables have ``pair_col``, ``turn``, ``role`` and ``text``; other columns are ignored.  Turns are in the order of
    ``turn`` (nulls first; ties by role, then text; repeated rows are turns of their own).  A null role is the user's, a
    null text is empty, rows with a null pair belong to no pair.  Equal conversations have an empty completion on both
    sides, a conversation that is the other's beginning on one; pairs without a common start have an empty prompt.
    """
    sides = [df.select(df[pair_col].alias("pair_id"), F.lit(n).alias("side"), turn_of(df).alias("t")) for n, df in enumerate((chosen, rejected))]
    return formatted(both_sides(sides[0].unionByName(sides[1])))


def formatted(both: DataFrame) -> DataFrame:
    """:func:`format_preferences` of one row a pair with the turns of both sides, ``c`` and ``r``."""
    both = both.withColumn("n", common_prefix(F.col("c"), F.col("r")))
    rest = lambda x: F.slice(F.col(x), F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0)))
    return both.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        rendered(F.slice(F.col("c"), F.lit(1), F.col("n"))).alias("prompt"),
        rendered(rest("c")).alias("chosen"),
        mask(rest("c")).alias("chosen_mask"),
        rendered(rest("r")).alias("rejected"),
        mask(rest("r")).alias("rejected_mask"),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Pairs from a table without preferences, as :func:`formatted` takes them: conversation ``2i`` is chosen; rejected is
    the same up to its last assistant turn, then neighbour ``2i + 1`` from that one's last assistant turn on.  A conversation
    without an assistant turn is kept or taken as it is; a turn without a number comes before the last one.  A conversation
    whose neighbour is not in the table makes no pair and gives no row.  One scan, one shuffle."""
    t = turns.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), F.pmod("conv_id", F.lit(2)).alias("side"), turn_of(turns).alias("t"), F.when(F.col("role") == "assistant", F.col("turn")).alias("said"))
    last = [F.max(F.when(F.col("side") == n, F.col("said"))).alias(f"last{n}") for n in (0, 1)]
    side = [F.sort_array(F.collect_list(F.when(F.col("side") == n, F.col("t")))).alias(x) for n, x in enumerate("co")]
    both = t.where("pair_id is not null").groupBy("pair_id").agg(*side, *last).where((F.size("c") > 0) & (F.size("o") > 0))
    head = F.filter("c", lambda x: F.coalesce(x["turn"] < F.col("last0"), F.lit(True)))
    tail = F.filter("o", lambda x: F.col("last1").isNull() | (x["turn"] >= F.col("last1")))
    return both.select("pair_id", "c", F.concat(head, tail).alias("r"))


def op9_preference_format(spark, sf_dir: str) -> DataFrame:
    return formatted(neighbour_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


_TURN = f"'{START}' || t.role || chr(10) || t.text || '{END}' || chr(10)"
_MASKED = lambda x, name: f"""
m_{name} AS (SELECT pair_id, string_agg((pos + length(role) + {len(START) + 1})::VARCHAR || ':' || (pos + length(role) + length(text) + {len(START) + 1 + len(END)})::VARCHAR, ',' ORDER BY p) AS mask
  FROM (SELECT pair_id, p, role, text, coalesce(sum(length(role) + length(text) + {len(START) + len(END) + 2}) OVER (PARTITION BY pair_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
    FROM (SELECT x.pair_id, x.p, x.role, x.text FROM {x} x JOIN n USING (pair_id) WHERE x.p > n.n) y) z WHERE role = 'assistant' GROUP BY pair_id),
t_{name} AS (SELECT x.pair_id, string_agg({_TURN.replace('t.', 'x.')}, '' ORDER BY x.p) AS t FROM {x} x JOIN n USING (pair_id) WHERE x.p > n.n GROUP BY x.pair_id)"""  # noqa: E731
SQL = f"""
WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
t AS (SELECT c.conv_id, c.turn, c.role, replace(c.text, '{MARK}', '< |') AS text, l.last, (c.conv_id // 2)::BIGINT AS pair_id FROM conversations c LEFT JOIN l USING (conv_id)),
c AS (SELECT pair_id, role, text, row_number() OVER (PARTITION BY pair_id ORDER BY turn) AS p FROM t WHERE conv_id % 2 = 0 AND pair_id IN (SELECT pair_id FROM t WHERE conv_id % 2 = 1)),
r AS (SELECT pair_id, role, text, row_number() OVER (PARTITION BY pair_id ORDER BY side, turn) AS p FROM (
  SELECT pair_id, 0 AS side, turn, role, text FROM t WHERE conv_id % 2 = 0 AND (last IS NULL OR turn < last)
  UNION ALL SELECT pair_id, 1, turn, role, text FROM t WHERE conv_id % 2 = 1 AND (last IS NULL OR turn >= last)) u WHERE pair_id IN (SELECT pair_id FROM c)),
n AS (SELECT pair_id, (min(CASE WHEN same THEN 1000000000 ELSE p END) - 1)::BIGINT AS n, count(*) AS most FROM (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.p, r.p) AS p, c.p IS NOT NULL AND r.p IS NOT NULL AND c.role = r.role AND c.text = r.text AS same
  FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.p = r.p) x GROUP BY pair_id),
prompts AS (SELECT t.pair_id, string_agg({_TURN}, '' ORDER BY t.p) AS t FROM c t JOIN n USING (pair_id) WHERE t.p <= n.n GROUP BY t.pair_id),{_MASKED('c', 'c')},{_MASKED('r', 'r')}
SELECT n.pair_id, least(n.n, n.most)::BIGINT AS n_prompt_turns, coalesce(p.t, '') AS prompt, coalesce(tc.t, '') AS chosen, coalesce(mc.mask, '') AS chosen_mask, coalesce(tr.t, '') AS rejected, coalesce(mr.mask, '') AS rejected_mask
FROM n LEFT JOIN prompts p USING (pair_id) LEFT JOIN t_c tc USING (pair_id) LEFT JOIN m_c mc USING (pair_id) LEFT JOIN t_r tr USING (pair_id) LEFT JOIN m_r mr USING (pair_id)
"""
