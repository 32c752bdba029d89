"""Chat formatting of reply trees.

Iterative self-joins double the ancestor links of the messages whose root is not reached yet, so a tree of depth d takes
about log2(d) joins and short trees leave early. They give
every message its depth and the summed score of its path from the root. Leaves are ranked by that sum; the same links,
walked from the chosen leaves, enumerate the messages of each chosen path, which is formatted as one conversation.

A turn is written ``[INST] role [/INST]text</s>``. Inside roles and texts a backslash is doubled and each control string
gets a backslash after its first character, so no control string is left in them; removing one backslash before any
character restores them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.llm.common import Tables

OPEN, CLOSE, END = "[INST] ", " [/INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chain(turns: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Flat conversations as trees: every message answers the one before it. Null turns come last; rows of the same turn
    follow each other by role and text, repeats included."""
    by_turn = W.partitionBy(tree).orderBy(F.col(order).asc_nulls_last(), F.col(role), F.col(text))
    rows = turns.select(tree, order, role, text).withColumn("node", F.row_number().over(by_turn).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select(F.col(tree).alias("tree"), "node", parent.alias("parent"), F.col(role).alias("role"), F.col(text).alias("text"), F.lit(0.0).alias("score"))


def _same(left: DataFrame, right: DataFrame, at: str) -> Column:
    return left["tree"].eqNullSafe(right["tree2"]) & (left[at] == right["node2"])


def best_paths(messages: DataFrame, tables: Tables, branches: int | None = 1) -> DataFrame:
    """tree, leaf, branch (rank from 1), node and depth (from 0 at the root) of every message on a chosen path."""
    own = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    there = own.select(F.col("tree").alias("tree2"), F.col("node").alias("node2"))
    links = own.join(there, own["tree"].eqNullSafe(there["tree2"]) & (own["parent"] == there["node2"]), "left").select(
        "tree", "node", F.when(F.col("node2") < F.col("node"), F.col("node2")).alias("up"),
        F.when(F.col("node2") < F.col("node"), 1).otherwise(0).cast("long").alias("depth"), F.col("score").alias("total"),
    )
    level, jumps, done = 0, [], []
    links = tables.keep("links-0", links)
    while True:
        done.append(links.where(F.col("up").isNull()))
        links = links.where(F.col("up").isNotNull())
        jumps.append(links.select("tree", "node", "up"))
        if links.isEmpty():
            break
        known = reduce(DataFrame.unionByName, done, links)
        further = known.select(
            F.col("tree").alias("tree2"), F.col("node").alias("node2"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2")
        )
        level += 1
        links = tables.keep(
            f"links-{level}",
            links.join(further, _same(links, further, "up")).select(
                "tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total"),
            ),
        )
    links = reduce(DataFrame.unionByName, done)
    answered = jumps[0].select(F.col("tree").alias("tree2"), F.col("up").alias("node2")).distinct()
    leaves = links.join(answered, _same(links, answered, "node"), "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "node"))
    leaves = leaves.withColumn("branch", rank)
    if branches is not None:
        leaves = leaves.where(F.col("branch") <= branches)
    paths = leaves.select("tree", F.col("node").alias("leaf"), "branch", "node", "depth")
    for step in reversed(range(level)):
        jump = jumps[step].select(F.col("tree").alias("tree2"), F.col("node").alias("node2"), "up")
        above = paths.join(jump, _same(paths, jump, "node")).select(
            "tree", "leaf", "branch", F.col("up").alias("node"), (F.col("depth") - 2**step).alias("depth")
        )
        paths = tables.keep(f"paths-{step}", paths.unionByName(above))
    return paths


def format_trees(messages: DataFrame, branches: int | None = 1, tables: Tables | None = None) -> DataFrame:
    """tree, leaf, branch, n_turns, formatted and loss_spans (array of start from 0 and length, in code points).

    ``messages`` has tree, node, parent, role, text and score; nodes are numbered so that a reply's number is larger than
    its parent's. A message whose parent is null, absent or not smaller is a root. Null texts and roles count as empty,
    null scores as 0, a null tree is a tree. Of rows with the same tree and node the least by parent, role and text stands.
    Ties between branches go to the longer path, then to the smaller leaf. ``branches`` per tree, None for all. The loss
    mask covers the texts of LEARNED_ROLE. Other columns are not read; an empty table gives no rows. One conversation is
    one string, so its turns meet in one task.
    """
    tables = tables or Tables("chat")
    one = messages.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
    one = tables.keep("messages", one.select("tree", "node", "m.*"))
    paths = best_paths(one, tables, branches).withColumnsRenamed({"tree": "tree2", "node": "node2"})
    turns = one.join(paths, _same(one, paths, "node")).select("tree", "leaf", "branch", "depth", "role", "text")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = turns.withColumn("_head", F.concat(F.lit(OPEN), escape(role), F.lit(CLOSE))).withColumn("_body", escape(text))
    turns = turns.withColumn("_piece", F.concat("_head", "_body", F.lit(END)))
    before = W.partitionBy("tree", "leaf", "branch").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("_piece")).over(before), F.lit(0)) + F.char_length("_head")
    turns = turns.withColumn("_span", F.when(role == LEARNED_ROLE, F.struct(start.cast("long").alias("start"), F.char_length("_body").cast("long").alias("length"))))
    ordered = F.sort_array(F.collect_list(F.struct("depth", "_piece", "_span")))
    out = turns.groupBy("tree", "leaf", "branch").agg(F.count(F.lit(1)).alias("n_turns"), ordered.alias("_turns"))
    return out.select(
        "tree", "leaf", "branch", "n_turns", F.array_join(F.transform("_turns", lambda t: t["_piece"]), "").alias("formatted"),
        F.array_compact(F.transform("_turns", lambda t: t["_span"])).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")
    pattern = r"(?s)^\[INST\] (.*?) \[/INST\](.*)$"
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, pattern, 1)).alias("role"), unescape(F.regexp_extract(p, pattern, 2)).alias("text")
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digests(conversations: DataFrame) -> DataFrame:
    """What a reader gets back from formatted conversations: turns and loss text as digests."""
    turns = F.array_join(F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("formatted"), F.col("loss_spans"))
    return conversations.select(
        F.col("tree").alias("conv_id"), F.size(read_back(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in CONTROL:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = '{LEARNED_ROLE}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = '{LEARNED_ROLE}'), '')) AS loss_sha256,
  CAST(sum({len(OPEN + CLOSE + END)} + length({_sql_escaped('role')}) + length({_sql_escaped('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
