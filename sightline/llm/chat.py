"""Chat formatting of reply trees [native].

Messages point to the message they reply to. Iterative self-joins let every
message jump to ever farther ancestors (1, 2, 4, ... replies up), gathering its
depth, the score of its path and the characters above it; a leaf that reached its
root stands for one root-to-leaf path. A tree's paths are ranked by score, and
the chosen ones are laid out from leaf to root by the same jumps, so rounds grow
with the logarithm of the longest path and rows with the paths' lengths. Each
chosen path becomes one conversation.

The template is ``<|start|>role<|message|>text<|end|>`` for each turn. Control
strings in roles and texts get a backslash behind their first bracket, one more
than they had, and lose it again when read back. All of it is DataFrame
expressions.

Defined results
  * null text or role: empty; null score: 0;
  * a parent that is null or not in the tree: the message is a root;
  * messages on a circle of replies, or below one, have no root and no path;
  * equal scores: the path with the smaller leaf node first;
  * messages that share a tree and node: one of them (least role, text) counts;
    ``linear`` numbers repeated turns, so none is lost there;
  * null conv_id: a conversation of its own; empty table: no rows;
  * texts of any length: a path is one string, bound to Spark's 2 GB;
  * extra columns: left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.session import cut, docs_of, prepare

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
#: Control strings: this template's and those that chat models commonly use.
CONTROL = r"(?:\|\w*\|>|/?s>|<?/?SYS>>|/?INST\])"
PROBE = -7


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)(" + CONTROL + ")", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)\\(" + CONTROL + ")", "$1$2$3")


def linear(conversations: DataFrame) -> DataFrame:
    """Reply trees of plain conversations (conv_id, turn, role, text): each row replies to the one before.

    Rows are ordered by turn, then role and text; null turns come first.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame, most: int = 1) -> DataFrame:
    """tree, leaf, rank, node, depth, above for the ``most`` best root-to-leaf paths of each tree.

    ``messages`` has tree, node, parent, score and size (characters of the
    formatted turn); ``above`` are the characters before a turn in its path.
    """
    # Trees with a null name are joined like any other.
    nodes = messages.select(F.coalesce(F.col("tree").cast("string"), F.lit("")).alias("tree"), F.col("tree").isNull().alias("no_tree"), "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"), "size")
    key = ["tree", "no_tree"]
    known = nodes.select(*key, F.col("node").alias("parent"), F.lit(True).alias("_known"))
    # hop: an ancestor ``depth`` replies up; score and above gather what lies from the node up to it.
    state = cut(
        nodes.join(known, [*key, "parent"], "left").select(
            *key, "node", F.when(F.col("_known"), F.col("parent")).alias("hop"), F.lit(1).cast("long").alias("depth"), "score", F.col("size").cast("long").alias("chars")
        )
    )
    leaves = nodes.select(*key, "node").join(state.where("hop is not null").select(*key, F.col("hop").alias("node")).distinct(), [*key, "node"], "left_anti")
    leaves = cut(leaves)
    jumps, settled, going = [], [state.where("hop is null")], state.where("hop is not null")
    largest = state.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(1, largest).bit_length()):
        # Only messages that have not met their root yet jump on; the settled ones are what they may land on.
        if going.isEmpty():
            break
        jumps.append(going.select(*key, "node", "hop"))
        there = reduce(DataFrame.unionByName, settled, going)
        up = there.select(*key, F.col("node").alias("hop"), F.col("hop").alias("_hop"), F.col("depth").alias("_depth"), F.col("score").alias("_score"), F.col("chars").alias("_chars"))
        state = cut(
            going.join(up, [*key, "hop"]).select(
                *key, "node", F.col("_hop").alias("hop"), (F.col("depth") + F.col("_depth")).alias("depth"),
                (F.col("score") + F.col("_score")).alias("score"), (F.col("chars") + F.col("_chars")).alias("chars"),
            )
        )
        settled.append(state.where("hop is null"))
        going = state.where("hop is not null")
    rooted = reduce(DataFrame.unionByName, settled)
    best = Window.partitionBy(*key).orderBy(F.col("score").desc(), "node")
    chosen = rooted.join(leaves, [*key, "node"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    on_path = chosen.select(*key, F.col("node").alias("leaf"), "rank", "node")
    for jump in jumps:
        # With the ancestors closer than 2**k known, those 2**k further up follow.
        on_path = on_path.unionByName(on_path.join(jump, [*key, "node"]).select(*key, "leaf", "rank", F.col("hop").alias("node")))
        on_path = cut(on_path)
    return on_path.join(rooted.select(*key, "node", "depth", "chars"), [*key, "node"])


def format_paths(messages: DataFrame, most: int = 1, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """tree, rank, leaf, formatted and loss (spans of code points) for each chosen path.

    ``messages`` has tree, node, parent, role, text and score.
    """
    prepare(messages.sparkSession)
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    made = messages.select("tree", "node", "parent", "score", escape(text).alias("said"), escape(role).alias("by"), role.isin(*trained).alias("learnt"))
    one = Window.partitionBy("tree", "node").orderBy("by", "said", F.col("parent").asc_nulls_first())
    made = made.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    marks = len(START) + len(MESSAGE)
    made = cut(made.withColumn("size", F.length("said") + F.length("by") + marks + len(END)))
    found = paths(made.select("tree", "node", "parent", "score", "size"), most)
    turns = made.select(F.coalesce(F.col("tree").cast("string"), F.lit("")).alias("tree"), F.col("tree").isNull().alias("no_tree"), F.col("tree").alias("_tree"), "node", "said", "by", "learnt", "size")
    piece = F.concat(F.lit(START), "by", F.lit(MESSAGE), "said", F.lit(END))
    begin = F.col("chars") - F.col("size") + marks + F.length("by")
    lined = found.join(turns, ["tree", "no_tree", "node"]).select("tree", "no_tree", "leaf", "rank", "_tree", F.struct("depth", piece.alias("piece"), begin.alias("begin"), F.length("said").cast("long").alias("length"), "learnt").alias("turn"))
    whole = lined.groupBy("tree", "no_tree", "leaf", "rank").agg(F.first("_tree").alias("_tree"), F.sort_array(F.collect_list("turn")).alias("turns"))
    learnt = F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: F.struct(t["begin"].alias("begin"), t["length"].alias("length")))
    return whole.select(F.col("_tree").alias("tree"), "rank", "leaf", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), learnt.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """tree, rank, turns (role, text) and learnt (texts under the loss mask), unescaped."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>", -1), lambda p: p != "")
    role = lambda p: F.substring_index(p, MESSAGE, 1).substr(F.lit(len(START) + 1), F.length(p))
    body = lambda p: p.substr(F.length(F.substring_index(p, MESSAGE, 1)) + len(MESSAGE) + 1, F.length(p))
    turns = F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(body(p)).alias("text")))
    learnt = F.transform("loss", lambda s: unescape(F.col("formatted").substr((s["begin"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("tree", "rank", turns.alias("turns"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    table = docs_of(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(PROBE).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    found = read_back(format_paths(linear(table.unionByName(probe))))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learnt", "")
    return found.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


ORACLE_OP1 = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)((?:\|\w*\|>|/?s>|<?/?SYS>>|/?INST\]))', '\1\2\\\3', 'g') AS who,
         regexp_replace(text, '([<\[])(\\*)((?:\|\w*\|>|/?s>|<?/?SYS>>|/?INST\]))', '\1\2\\\3', 'g') AS said FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(who) + length(said) + 27)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
