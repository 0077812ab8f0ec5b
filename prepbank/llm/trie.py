"""Prefix trie of conversations, with subtree totals by centroid decomposition of its parent edges."""

from collections.abc import Iterator, Sequence
from functools import reduce
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prepbank.operators.ordering import MAX_GROUP_ROWS, number_rows
from prepbank.session import materialize

# Turns of a conversation that one window runs over; longer ones are prefix sums over such runs.
RUN = 1024
# A component with more weight (turns of all conversations through its nodes) is split by Spark, a lighter one inside a task.
LIMIT = 4096
# Heavy components are sent to every task up to this many; there are at most (all turns) / LIMIT.
FEW = 100_000
# Width of a range of conversation ids that makes one piece of a list of ids.
IDS = 4096
NODE = ["conv", "depth"]
TOP = ["top_conv", "top_depth"]


def ordered_turns(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Rows (conv, at, e1, e2, bytes): the turns of each conversation numbered from 1, as 128 bits of hash of role and text and the
    UTF-8 bytes of the text, so that no text is shuffled.

    Null turns go first, equal ones by role and then by hash; a null role or text is an empty one; turns without a conversation are
    left out. A conversation with more than ``max_group_rows`` turns is numbered by runs of a range partitioning.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    slim = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("e1"), F.xxhash64(F.lit("second"), text, role).alias("e2"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("e1"), F.asc("e2")]
    return number_rows(slim, ["conv"], order, "at", max_group_rows=max_group_rows).select("conv", "at", "e1", "e2", "bytes")


def graft(turns: DataFrame, base: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Every conversation rebuilt: the first ``taken`` turns (at most ``most``) of the conversation ``base``, all if it has fewer and none if
    there is no such one, then its own turns after its first ``taken``. ``base`` and ``taken`` are columns over ``conv``.

    Returns (turns with ``depth`` from 1 in place of ``at``, one row (conv, length) for each conversation, turnless ones too).
    """
    sizes = turns.groupBy("conv").agg(F.max("at").alias("size"))
    asked = sizes.select("conv", "size", base.alias("base"), taken.cast("bigint").alias("h"))
    bases = sizes.select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    got = F.least(F.col("h"), F.coalesce("base_size", F.lit(0)))
    plan = asked.join(bases, "base", "left").select(
        "conv", "base", "h", got.alias("got"), (got + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length")
    )
    plan = materialize(plan, "grafts")
    own = turns.join(plan, "conv").where(F.col("at") > F.col("h"))
    own = own.select("conv", (F.col("got") + F.col("at") - F.col("h")).alias("depth"), "e1", "e2", "bytes", "length")
    first = turns.where(F.col("at") <= most).select(F.col("conv").alias("base"), F.col("at").alias("depth"), "e1", "e2", "bytes")
    given = plan.join(first, "base").where(F.col("depth") <= F.col("h"))
    return own.unionByName(given.select(*own.columns)), plan.select("conv", "length")


def _prefixes(turns: DataFrame) -> DataFrame:
    """Turns with 128 bits (x1, x2) that stand for the whole sequence up to them: the running xor of hashes of place and turn."""
    tagged = turns.select(
        "conv", "depth", "bytes", "length", F.floor((F.col("depth") - 1) / RUN).alias("run"),
        F.xxhash64("depth", "e1").alias("a1"), F.xxhash64(F.lit("place"), "depth", "e2").alias("a2"),
    )
    so_far = W.partitionBy("conv", "run").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    inner = tagged.select("*", F.bit_xor("a1").over(so_far).alias("x1"), F.bit_xor("a2").over(so_far).alias("x2"))
    # Only conversations of several runs have something ahead of a run.
    runs = tagged.where(F.col("length") > RUN).groupBy("conv", "run").agg(F.bit_xor("a1").alias("r1"), F.bit_xor("a2").alias("r2"))
    ahead = W.partitionBy("conv").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("conv", "run", F.bit_xor("r1").over(ahead).alias("r1"), F.bit_xor("r2").over(ahead).alias("r2"))
    joined = inner.join(runs.where(F.col("run") > 0), ["conv", "run"], "left")
    x1, x2 = (F.col(x).bitwiseXOR(F.coalesce(r, F.lit(0))).alias(x) for x, r in (("x1", "r1"), ("x2", "r2")))
    return joined.select("conv", "depth", "bytes", "length", x1, x2)


def build_trie(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, steps, ends) of the trie over (conv, depth, e1, e2, bytes, length) and (conv, length).

    A node is named by its smallest member and its depth. ``nodes``: conv, depth, parent_conv, n_convs, bytes, weight (turns of
    its members from here on, each member's end counted). ``steps``: for each conversation and depth the node there (owner) and the one
    below it (next_owner). ``ends``: for each conversation the node it ends at.
    """
    lengths = materialize(lengths, "lengths")
    root = lengths.agg(F.min("conv"), F.count(F.lit(1)), F.sum(F.col("length") + 1)).head()
    first, n, weight = root if root[1] else (None, 0, 0)
    prefixes = materialize(_prefixes(turns), "prefixes")
    key = ["depth", "x1", "x2"]
    found = prefixes.groupBy(*key).agg(
        F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
    )
    found = materialize(found, "prefix-nodes")
    # Prefixes of a single conversation need no look-up; those that hold many rows are split by the join.
    alone, shared = found.where("n_convs = 1"), found.where("n_convs > 1")
    named = prefixes.select("conv", *key, "length").join(shared.select(*key, "owner"), key, "left")
    path = named.select("conv", "depth", "length", F.coalesce("owner", "conv").alias("owner"))
    path = materialize(path.unionByName(lengths.select("conv", F.lit(0).cast("bigint").alias("depth"), "length", F.lit(first).cast("bigint").alias("owner"))), "paths")
    below = path.select("conv", (F.col("depth") - 1).alias("depth"), F.col("owner").alias("next_owner"))
    steps = materialize(path.join(below, NODE, "left").select("conv", "depth", "owner", "next_owner"), "steps")
    parents = steps.where(F.col("next_owner") == F.col("conv")).select(
        "conv", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent_conv")
    )
    nodes = alone.unionByName(shared).select(F.col("owner").alias("conv"), "depth", "n_convs", "bytes", "weight").join(parents, NODE)
    spark = turns.sparkSession
    schema = "conv bigint, depth bigint, n_convs bigint, bytes bigint, weight bigint, parent_conv bigint"
    top = spark.createDataFrame([(first, 0, n, 0, weight, None)] if n else [], schema)
    nodes = materialize(nodes.select(*top.columns).unionByName(top), "nodes")
    ends = path.where(F.col("depth") == F.col("length")).select("conv", "owner", "depth")
    return nodes, steps, ends


def rollup(nodes: DataFrame, steps: DataFrame, values: Sequence[str], limit: int = LIMIT) -> DataFrame:
    """Rows (conv, depth, values): each node's values summed over its subtree, by centroid decomposition.

    A component's centroid is its deepest node with over half of the weight of the component's top, so what is left above and each
    piece below have at most half of it. The total of the values at and below the centroid is added to the centroid, which is then
    final, and to each node on its path to the top; then the pieces are components of their own. Components above ``limit`` are split
    all at once, round after round (at most log2(weight / limit) rounds, whatever the depth of the trie); lighter ones are
    finished inside a task. As a node is a prefix of its smallest member, its ancestor at any depth is an equi-join with ``steps``.
    Each round writes its state to the shared folder.
    """
    values = list(values)
    sums = [f"sum_{v}" for v in values]
    root = nodes.where("depth = 0").select("conv").head()
    tops = [F.lit(root and root[0]).cast("bigint").alias("top_conv"), F.lit(0).cast("bigint").alias("top_depth")]
    state = nodes.select(*tops, *NODE, "parent_conv", "weight", *values, *[F.lit(0).cast("bigint").alias(s) for s in sums])
    final, light = [], []
    while True:
        heavy = state.where((F.col("conv") == F.col("top_conv")) & (F.col("depth") == F.col("top_depth")) & (F.col("weight") > limit))
        heavy = materialize(heavy.select(*TOP, F.col("weight").alias("whole")), "heavy")
        n = heavy.count()
        if not n:
            light.append(state)
            break
        send = F.broadcast if n <= FEW else lambda x: x
        light.append(state.join(send(heavy), TOP, "left_anti"))
        active = state.join(send(heavy), TOP)
        chain = F.max(F.struct("depth", "conv", "weight")).alias("c")
        centroids = active.where(2 * F.col("weight") > F.col("whole")).groupBy(*TOP).agg(chain)
        centroids = centroids.select(*TOP, *[F.col(f"c.{c}").alias(f"c_{c}") for c in ("conv", "depth", "weight")])
        centroids = materialize(centroids, "centroids")
        look = steps.select(F.col("conv"), F.col("depth").alias("c_depth"), F.col("owner").alias("at_c"), F.col("next_owner").alias("under_c"))
        up = centroids.join(steps.select(F.col("conv").alias("c_conv"), F.col("depth").alias("d"), "owner"), "c_conv")
        up = up.where((F.col("d") >= F.col("top_depth")) & (F.col("d") < F.col("c_depth")))
        up = up.select(F.col("owner").alias("conv"), F.col("d").alias("depth"), F.lit(True).alias("above"))
        marked = active.drop("whole").join(send(centroids), TOP).join(look, ["conv", "c_depth"], "left").join(up, NODE, "left")
        inside = (F.col("depth") >= F.col("c_depth")) & F.coalesce(F.col("at_c") == F.col("c_conv"), F.lit(False))
        marked = marked.select(
            *TOP, *NODE, "parent_conv", "weight", *values, *sums, "c_weight", F.coalesce("above", F.lit(False)).alias("above"),
            inside.alias("below"), (inside & (F.col("depth") == F.col("c_depth"))).alias("centroid"),
            "under_c", (F.col("c_depth") + 1).alias("under_depth"),
        )
        marked = materialize(marked, "marked")
        totals = marked.where("below").groupBy(*TOP).agg(*[F.sum(v).alias(f"add_{v}") for v in values])
        met = marked.join(send(materialize(totals, "totals")), TOP)
        hit = F.col("above") | F.col("centroid")
        met = met.withColumns({s: F.col(s) + F.when(hit, F.col(f"add_{v}")).otherwise(0) for s, v in zip(sums, values, strict=True)})
        final.append(met.where("centroid").select(*NODE, *sums))
        state = met.where(~F.col("centroid")).select(
            F.when(F.col("below"), F.col("under_c")).otherwise(F.col("top_conv")).alias("top_conv"),
            F.when(F.col("below"), F.col("under_depth")).otherwise(F.col("top_depth")).alias("top_depth"),
            *NODE, "parent_conv",
            (F.col("weight") - F.when(F.col("above"), F.col("c_weight")).otherwise(0)).alias("weight"), *values, *sums,
        )
    pieces = reduce(DataFrame.unionByName, light).select(*TOP, *NODE, "parent_conv", "weight", *values, *sums)
    count = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(count, *TOP).sortWithinPartitions(*TOP, *NODE)
    schema = ", ".join(f"{c} bigint" for c in [*NODE, *sums])
    inner = dealt.mapInPandas(lambda batches: _finish(batches, values), schema)
    whole = reduce(DataFrame.unionByName, final, inner)
    return whole.select(*NODE, *[F.col(s).alias(v) for s, v in zip(sums, values, strict=True)])


def _finish(batches: Iterator[pd.DataFrame], values: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Subtree totals of whole components, which come one after the other."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        tops = rows[TOP]
        last = (tops == tops.iloc[-1]).all(axis=1).to_numpy() if len(rows) else []
        cut = int(len(rows) - last.sum()) if len(rows) else 0
        rest = rows.iloc[cut:]
        if cut:
            yield _forest(rows.iloc[:cut], values)
    if rest is not None and len(rest):
        yield _forest(rest, values)


def _forest(rows: pd.DataFrame, values: Sequence[str]) -> pd.DataFrame:
    names = list(zip(rows["conv"].tolist(), rows["depth"].tolist(), strict=True))
    tops = list(zip(rows["top_conv"].tolist(), rows["top_depth"].tolist(), strict=True))
    at = {name: i for i, name in enumerate(names)}
    above = rows["parent_conv"].fillna(-1).astype("int64").tolist()
    parent = [-1 if name == top else at[p, name[1] - 1] for name, top, p in zip(names, tops, above, strict=True)]
    added = centroid_totals(parent, rows["weight"].tolist(), [rows[v].tolist() for v in values])
    out = {"conv": rows["conv"].to_numpy(), "depth": rows["depth"].to_numpy()}
    for v, sums in zip(values, added, strict=True):
        out[f"sum_{v}"] = [int(a) + s for a, s in zip(rows[f"sum_{v}"].tolist(), sums, strict=True)]
    return pd.DataFrame(out)


def centroid_totals(parent: Sequence[int], weight: Sequence[int], values: Sequence[Sequence[int]]) -> list[list[int]]:
    """Subtree sums of each list of values over a forest of parent places (-1: a top). ``weight`` is any measure that is
    larger for a node than for all its children together."""
    children: list[list[int]] = [[] for _ in parent]
    for i, p in enumerate(parent):
        if p >= 0:
            children[p].append(i)
    left, gone = list(weight), [False] * len(parent)
    sums = [[0] * len(parent) for _ in values]
    tops = [i for i, p in enumerate(parent) if p < 0]
    while tops:
        top = tops.pop()
        path, centroid = [], top
        while (down := next((x for x in children[centroid] if not gone[x] and 2 * left[x] > left[top]), None)) is not None:
            path.append(centroid)
            centroid = down
        piece = [centroid]
        for x in piece:
            piece.extend(y for y in children[x] if not gone[y])
        gone[centroid] = True
        for total, own in zip(sums, values, strict=True):
            add = sum(own[x] for x in piece)
            for x in (centroid, *path):
                total[x] += add
        for x in path:
            left[x] -= left[centroid]
        tops.extend(y for y in children[centroid] if not gone[y])
        if path:
            tops.append(top)
    return sums


def ends_digest(ends: DataFrame) -> DataFrame:
    """Rows (conv, depth, ends_sha256) of nodes that conversations end at: SHA-256 of their ids, ascending, joined by commas.

    Ids are first joined in pieces of ``IDS`` consecutive values, of which each has at most so many; a task then streams the pieces
    of a node in order and holds one Arrow batch.
    """
    pieces = ends.groupBy("owner", "depth", F.floor(F.col("conv") / IDS).alias("piece")).agg(
        F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")
    )
    count = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(count, "owner", "depth").sortWithinPartitions("owner", "depth", "piece")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, running = None, None
        for batch in batches:
            out = []
            for owner, depth, ids in zip(batch["owner"], batch["depth"], batch["ids"], strict=True):
                if (owner, depth) != node:
                    if node is not None:
                        out.append((*node, running.hexdigest()))
                    node, running = (owner, depth), sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["conv", "depth", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, running.hexdigest())], columns=["conv", "depth", "ends_sha256"])

    return dealt.select("owner", "depth", "ids").mapInPandas(digest, "conv bigint, depth bigint, ends_sha256 string")


def trie_report(turns: DataFrame, lengths: DataFrame, conv_col: str = "conv_id", limit: int = LIMIT) -> DataFrame:
    """One row per node of the trie: its smallest member, depth, the parent's smallest member, members (n_convs), n_children, n_leaves (childless
    nodes in its subtree, itself included), saved_tokens (over its subtree, (n_convs - 1) times the bytes of a node's last text, which a shared
    prefix saves) and ends_sha256 of the members that end there.

    Conversations with equal turns share all their nodes. Without conversations there is no row, not even a root.
    """
    nodes, steps, ends = build_trie(turns, lengths)
    leaf = (F.col("weight") == F.col("n_convs")).cast("bigint")
    valued = nodes.withColumns({"n_leaves": leaf, "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")})
    totals = rollup(valued, steps, ["n_leaves", "saved_tokens"], limit)
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    joined = nodes.select(*NODE, "parent_conv", "n_convs").join(totals, NODE).join(children, NODE, "left").join(ends_digest(ends), NODE, "left")
    return joined.select(
        F.col("conv").alias(conv_col), "depth", F.col("parent_conv").alias(f"parent_{conv_col}"), "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    limit: int = LIMIT, max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """``trie_report`` of conversations as they are.

    Null turns go first, equal ones by role and hash; a null role or text is an empty one; turns of no conversation take no part;
    repeated rows are turns each; an empty table gives an empty result; other columns take no part.
    """
    turns = ordered_turns(conversations, conv_col, turn_col, role_col, text_col, max_group_rows)
    turns = materialize(turns.withColumnRenamed("at", "depth"), "turns")
    lengths = turns.groupBy("conv").agg(F.max("depth").alias("length"))
    return trie_report(turns.join(lengths, "conv"), lengths, conv_col, limit)
