"""Operator 4, chat formatting of preference pairs.

Conversations with the same first turn answer the same opening. The best of such a group is chosen: one that ends with an assistant
turn, then with more turns, more characters, and the smaller conv_id. Each other one is its rejected partner, so a group gives a
pair for each member but one, however large it is. The longest common turn prefix of both (roles and texts equal) is rendered once
as the prompt; what follows are two completions, each with a mask: the [start, end) code points of the assistant's words, the only
ones that bear loss. A conversation without a partner gives a row with its own prompt up to its last assistant turn and no rejected one.

Groups are found by the MD5 of the first turn. The best of a group is the greatest of its ranks, combined before the shuffle; the
members of a large group are then dealt over tasks, each of which gets a copy of the chosen conversation.

Cases: turns are ordered by turn, role and text; null roles and texts read as empty. Rows that repeat a turn are turns of their own.
A turn with a null conv_id belongs to no conversation that is known, and is one of its own. Equal conversations make a pair with
empty completions; ties are broken by a number of the row. A long conversation is one row, as its output is. No turns give no rows;
other columns are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import cut, spread_join, table


def _render(turns: str) -> str:
    return f"array_join(transform({turns}, t -> concat('<|', t.role, '|>', t.text, '<|end|>')), '')"


def _mask(turns: str) -> str:
    """SQL for the spans of the assistant's text within the rendered turns."""
    size = "(x.n_role + 4 + x.n_text + 7)"
    thin = f"transform({turns}, t -> named_struct('own', t.role = 'assistant', 'n_role', char_length(t.role), 'n_text', char_length(t.text)))"
    return (
        f"aggregate({thin}, named_struct('at', 0, 'out', cast(array() AS array<array<int>>)), (a, x) -> named_struct('at', a.at + {size}, "
        f"'out', IF(x.own, array_append(a.out, array(a.at + x.n_role + 4, a.at + x.n_role + 4 + x.n_text)), a.out)), a -> a.out)"
    )


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, its turns in order (all), first (MD5 of its first turn), rank (greatest: best; no two are equal), cut."""
    turn = F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = turns.select("conv_id", turn.alias("t"))
    known = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("all"))
    rows = known.unionByName(rows.where("conv_id IS NULL").select("conv_id", F.array("t").alias("all")))
    rows = rows.withColumn("all", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    rank = F.struct(
        (F.expr("element_at(all, -1).role") == "assistant").cast("int").alias("ends"), F.size("all").alias("turns"),
        F.expr("aggregate(all, 0L, (a, t) -> a + char_length(t.text))").alias("chars"), F.col("conv_id").isNotNull().alias("known"),
        (-F.coalesce(F.col("conv_id"), F.lit(0)).cast("decimal(20,0)")).alias("low"), (-F.monotonically_increasing_id()).alias("row"),
    )
    return cut(rows.select("conv_id", "all", F.md5(F.expr("concat(all[0].role, '\\n', all[0].text)")).alias("first"), rank.alias("rank")))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """conv_id (of the rejected, or of a lone conversation), chosen_id, n_prompt_turns, prompt, chosen, rejected and both masks."""
    convs = conversations(turns)
    best = convs.groupBy("first").agg(F.max("rank").alias("top"), F.count("*").alias("members"))
    chosen = convs.select(F.col("all").alias("chosen_all"), F.col("conv_id").alias("chosen_id"), F.col("rank.row").alias("chosen_row"))
    chosen = chosen.join(best.select("first", "members", F.col("top.row").alias("chosen_row")), "chosen_row")
    met = spread_join(convs, cut(chosen), ["first"], "members", ["rank"])
    met = met.where("members = 1 OR rank.row <> chosen_row")
    same = F.expr("array_position(zip_with(all, chosen_all, (x, y) -> coalesce(x.role = y.role AND x.text = y.text, false)), false)")
    lone = F.expr("IF(exists(all, t -> t.role = 'assistant'), size(all) - array_position(reverse(transform(all, t -> t.role = 'assistant')), true), size(all))")
    met = met.withColumn("n", F.when(F.col("members") == 1, lone).when(same == 0, F.size("all")).otherwise(same - 1).cast("int"))
    met = met.withColumn("c", F.expr("slice(chosen_all, n + 1, size(chosen_all))")).withColumn("r", F.when(F.col("members") > 1, F.expr("slice(all, n + 1, size(all))")))
    return met.select(
        "conv_id", "chosen_id", F.col("n").alias("n_prompt_turns"), F.expr(_render("slice(all, 1, n)")).alias("prompt"), F.expr(_render("c")).alias("chosen"),
        F.expr(_render("r")).alias("rejected"), F.expr(_mask("c")).alias("chosen_mask"), F.expr(f"IF(r IS NULL, NULL, {_mask('r')})").alias("rejected_mask"),
    )


def query(spark, sf_dir):
    """The pairs, with masks as text: start:end of each span, comma-joined."""
    text = lambda c: F.expr(f"array_join(transform({c}, m -> concat(m[0], ':', m[1])), ',')")
    pairs = preference_pairs(table(spark, sf_dir, "conversations"))
    return pairs.withColumn("chosen_mask", text("chosen_mask")).withColumn("rejected_mask", text("rejected_mask"))


_TURNS = "list_transform(list_slice({0}, {1}, {2}), lambda t: '<|' || t.role || '|>' || t.text || '<|end|>')"
_RENDER = f"coalesce(array_to_string({_TURNS}, ''), '')"
# A span of the mask starts after all that is rendered before its turn and after the turn's own tag.
_BEFORE = "CAST(coalesce(list_sum(list_transform(range({1}, i), lambda j: length({0}[j].role) + 4 + length({0}[j].text) + 7)), 0) AS BIGINT) + length({0}[i].role) + 4"
_MASK = f"""coalesce(array_to_string(list_transform(list_filter(range({{1}}, len({{0}}) + 1), lambda i: {{0}}[i].role = 'assistant'),
    lambda i: ({_BEFORE}) || ':' || ({_BEFORE} + length({{0}}[i].text))), ','), '')"""
SQL = f"""
WITH row AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
conv AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn, role, text) AS a FROM row WHERE conv_id IS NOT NULL GROUP BY conv_id
         UNION ALL SELECT NULL, [struct_pack(role := role, text := text)] FROM row WHERE conv_id IS NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a[1].role, a[1].text ORDER BY a[len(a)].role = 'assistant' DESC, len(a) DESC,
             list_sum(list_transform(a, lambda t: length(t.text))) DESC, conv_id IS NULL, conv_id) AS place, count(*) OVER (PARTITION BY a[1].role, a[1].text) AS members FROM conv),
met AS (SELECT r.conv_id, r.a, r.members, c.a AS c, c.conv_id AS chosen_id FROM ranked r JOIN ranked c ON r.a[1].role = c.a[1].role AND r.a[1].text = c.a[1].text AND c.place = 1
        WHERE r.members = 1 OR r.place > 1),
cut AS (SELECT *, CASE WHEN members = 1 THEN coalesce(list_max(list_filter(range(1, len(a) + 1), lambda i: a[i].role = 'assistant')) - 1, len(a))
             ELSE coalesce(list_min(list_filter(range(1, len(a) + 1), lambda i: i > len(c) OR a[i].role <> c[i].role OR a[i].text <> c[i].text)) - 1, len(a)) END AS n FROM met)
SELECT conv_id, chosen_id, CAST(n AS INTEGER) AS n_prompt_turns, {_RENDER.format("a", "1", "n")} AS prompt, {_RENDER.format("c", "n + 1", "len(c)")} AS chosen,
       CASE WHEN members > 1 THEN {_RENDER.format("a", "n + 1", "len(a)")} END AS rejected, {_MASK.format("c", "n + 1")} AS chosen_mask,
       CASE WHEN members > 1 THEN {_MASK.format("a", "n + 1")} END AS rejected_mask
FROM cut"""

QUERIES = {"op4_preference_pairs": query}
ORACLE = {"op4_preference_pairs": SQL}
