"""Conversation prefix trie, with subtree totals by a depth-band rollup.

A node is a distinct sequence of first turns; it is named by its smallest conversation and its
depth. Prefixes are compared by two 64-bit hashes that fold in a turn and its place, so a prefix's
hash is a running exclusive or, and parts of a long conversation can be hashed apart.

Subtree totals go up and down in bands of ``BAND`` levels. At level 0 every node adds itself to the
root of its band; those band roots are the nodes of level 1, whose bands are ``BAND`` times as
high, and so on until one band holds all. On the way down each node takes the nodes of its band
below it and the finished totals of the band roots just below, both by explosion to at most
``BAND`` ancestors. So there are about log(depth) rounds, and no row explodes to more than ``BAND``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import WORD, n_blocks, written

BAND, GROUP, HEADS, ROWS = 8, 20, 4, 100_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODES = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def _numbered(df: DataFrame, rows: int) -> DataFrame:
    """``conv, pos, a, b, words``: each row's place in its conversation from 0, two hashes of its turn and the words of its text.

    Rows are dealt to ranges of the whole order, so a conversation of any length is shared by many
    tasks; each range is numbered by itself, and what earlier ranges hold of a conversation is added.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    turns = df.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).filter("conv is not null")
    order = ["conv", "turn", "role", "text"]
    dealt = turns.repartitionByRange(n_blocks(turns.count(), rows), *order).sortWithinPartitions(*order)
    turn = F.struct(F.sha2(F.to_binary("role", F.lit("utf-8")), 256), F.sha2(F.to_binary("text", F.lit("utf-8")), 256))
    hashed = dealt.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), F.xxhash64(F.lit(1), turn).alias("a"), F.xxhash64(F.lit(2), turn).alias("b"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    ranged = written(hashed, "turns")
    held = ranged.groupBy("conv", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select("conv", "part", "first", before.alias("before"))
    return ranged.join(starts, ["conv", "part"]).select("conv", "part", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "a", "b", "words")


def _rebuilt(turns: DataFrame, group: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and all conversations with the lengths of the two parts.

    The first ``h`` turns come from the conversation ``conv - conv % group``, the others are its own
    after its first ``h``; ``h`` is crc32 of the decimal id, modulo ``heads``.
    """
    lengths = turns.groupBy("conv").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    known = lengths.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    bases = lengths.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    known = known.join(bases, "base", "left").withColumn("lead", F.least(F.col("h"), F.coalesce("base_n", F.lit(0))))
    known = written(known.withColumn("length", F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    own = turns.join(known.select("conv", "h", "lead"), "conv").filter(F.col("pos") >= F.col("h")).select("conv", "part", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "a", "b", "words")
    front = turns.filter(F.col("pos") < heads - 1).select(F.col("conv").alias("base"), "pos", "a", "b", "words")
    led = front.join(known.select("base", "conv", "lead"), "base").filter(F.col("pos") < F.col("lead")).select("conv", F.lit(-1).alias("part"), "pos", "a", "b", "words")
    return own.unionByName(led), known


def _prefixes(turns: DataFrame) -> DataFrame:
    """``conv, depth, a, b, up_a, up_b, words``: hashes of the first ``depth`` turns and of one turn less.

    Running hashes of the parts of a conversation, then of the parts before them.
    """
    placed = turns.select("conv", "part", "pos", *(F.xxhash64(F.lit(k), c, "pos").alias(c) for k, c in enumerate("ab")), "words")
    inside = Window.partitionBy("conv", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = placed.select("conv", "part", "pos", *(F.bit_xor(c).over(inside).alias(f"run_{c}") for c in "ab"), "a", "b", "words")
    ends = placed.groupBy("conv", "part").agg(F.bit_xor("a").alias("end_a"), F.bit_xor("b").alias("end_b"))
    past = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("conv", "part", *(F.coalesce(F.bit_xor(f"end_{c}").over(past), F.lit(0)).alias(f"past_{c}") for c in "ab"))
    full = run.join(carried, ["conv", "part"]).select("conv", (F.col("pos") + 1).alias("depth"), *(F.col(f"run_{c}").bitwiseXOR(F.col(f"past_{c}")).alias(f"full_{c}") for c in "ab"), "a", "b", "words")
    return full.select("conv", "depth", F.col("full_a").alias("a"), F.col("full_b").alias("b"), F.col("full_a").bitwiseXOR(F.col("a")).alias("up_a"), F.col("full_b").bitwiseXOR(F.col("b")).alias("up_b"), "words")


def _sha_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined decimal ids of each run of rows (owner, depth, conv); a run of any length needs only the state of its hash."""
    node, state = None, None

    def out(node, state) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"owner": pa.array([n[0] for n in node], pa.int64()), "depth": pa.array([n[1] for n in node], pa.int64()), "ends_sha256": pa.array([s.hexdigest() for s in state], pa.string())})

    for batch in batches:
        owner, depth, conv = (batch.column(i).to_numpy() for i in range(3))
        if not len(conv):
            continue
        cuts = [0, *(np.flatnonzero((np.diff(owner) != 0) | (np.diff(depth) != 0)) + 1).tolist(), len(conv)]
        done: list = []
        for low, high in zip(cuts, cuts[1:], strict=False):
            here = (int(owner[low]), int(depth[low]))
            ids = ",".join(map(str, conv[low:high].tolist())).encode()
            if here == node:
                state.update(b"," + ids)
            else:
                if node is not None:
                    done.append((node, state))
                node, state = here, hashlib.sha256(ids)
        if done:
            yield out(*zip(*done, strict=True))
    if node is not None:
        yield out([node], [state])


def _subtree_sums(nodes: DataFrame, paths: DataFrame, values: list[str], deepest: int, band: int) -> DataFrame:
    """``owner, depth`` and the sums of ``values`` over each node's subtree.

    ``nodes`` has one row a node; ``paths`` (conv, depth, owner) names the owner of every prefix of
    each conversation, the root's (depth 0) too.
    """
    sums = lambda df: df.groupBy("owner", "depth").agg(*(F.sum(v).alias(v) for v in values))
    step, levels = 1, [nodes.select("owner", "depth", *values)]
    ways = []
    while True:
        # of each conversation and band of this level: the owners at the depths that are multiples of ``step``
        entry = F.struct("depth", "owner")
        here = paths.filter(F.col("depth") % step == 0)
        way = written(here.groupBy("conv", F.floor(F.col("depth") / (step * band)).alias("band")).agg(F.sort_array(F.collect_list(entry)).alias("way")), "bands")
        ways.append(way)
        if step * band > deepest:
            break
        low = levels[-1].select(F.col("owner").alias("conv"), F.floor(F.col("depth") / (step * band)).alias("band"), *values)
        low = low.groupBy("conv", "band").agg(*(F.sum(v).alias(v) for v in values))
        top = F.get("way", F.lit(0))
        levels.append(written(sums(low.join(way, ["conv", "band"]).select(top["owner"].alias("owner"), top["depth"].alias("depth"), *values)), "ups"))
        step *= band
    done = None
    for way, level in zip(reversed(ways), reversed(levels), strict=True):
        place = F.floor(F.col("depth") / (step * band))
        given = level.select(F.col("owner").alias("conv"), place.alias("band"), F.col("depth").alias("upto"), *values)
        if done is not None:
            given = given.unionByName(done.filter("depth > 0").select(F.col("owner").alias("conv"), (place - 1).alias("band"), F.col("depth").alias("upto"), *values))
        met = given.join(way, ["conv", "band"]).select(F.explode(F.filter("way", lambda e: e["depth"] <= F.col("upto"))).alias("e"), *values)
        done = written(sums(met.select("e.owner", "e.depth", *values)), "totals")
        step //= band
    return done


def prefix_trie(df: DataFrame, group: int = GROUP, heads: int = HEADS, band: int = BAND, rows: int = ROWS) -> DataFrame:
    """One row a node of the trie of all rebuilt conversations of ``df`` (``conv_id``, ``turn``, ``role``, ``text``).

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    Turns go by ``turn`` (null first), equal ones by role, then text; null roles and texts are
    empty; repeated rows are turns each. A row without ``conv_id`` belongs to no conversation and is
    left out. A conversation that the rebuilding leaves without turns is a member of the root. Other
    columns are ignored; an empty table has no node, not even a root. Exact up to 128 bits of hash.
    """
    turns = written(_numbered(df, rows), "numbered")
    rebuilt, known = _rebuilt(turns, group, heads)
    prefixes = written(_prefixes(written(rebuilt, "rebuilt")), "prefixes")
    root = known.agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.coalesce(F.max("length"), F.lit(0)).alias("deepest")).first()
    if root["owner"] is None:
        return df.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")

    # nodes by their hashes, then by their owners
    found = prefixes.groupBy("depth", "a", "b").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"))
    found = written(found, "nodes")
    owners = found.select("depth", "a", "b", "owner")
    first = F.lit(root["owner"])
    zero = known.select("conv", F.lit(0).cast("long").alias("depth"), first.alias("owner"))
    paths = written(prefixes.select("conv", "depth", "a", "b").join(owners, ["depth", "a", "b"]).select("conv", "depth", "owner").unionByName(zero), "paths")
    above = owners.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("owner").alias("parent"))
    named = found.join(above, ["depth", "up_a", "up_b"], "left").select("owner", "depth", F.when(F.col("depth") == 1, first).otherwise(F.col("parent")).alias("parent"), "n_convs", "words")
    top = df.sparkSession.range(1).select(first.alias("owner"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(root["n_convs"]).alias("n_convs"), F.lit(0).cast("long").alias("words"))
    named = written(named.unionByName(top), "named")

    children = named.filter("depth > 0").groupBy(F.col("parent").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = named.join(children, ["owner", "depth"], "left").select("owner", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    nodes = written(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")), "counted")
    totals = _subtree_sums(nodes, paths, ["n_leaves", "saved_tokens"], int(root["deepest"]), band)

    ended = paths.join(known.select("conv", F.col("length").cast("long").alias("depth")), ["conv", "depth"]).select("owner", "depth", "conv")
    ends = ended.repartition(n_blocks(root["n_convs"], rows), "owner", "depth").sortWithinPartitions("owner", "depth", "conv").mapInArrow(_sha_of_runs, "owner long, depth long, ends_sha256 string")
    both = nodes.drop("n_leaves", "saved_tokens").join(totals, ["owner", "depth"]).join(ends, ["owner", "depth"], "left")
    return both.select(F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


#: Lists of whole turns stand for nodes; crc32 is taken bit by bit.
OP11_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
k AS (
  SELECT c, own, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda v, b: list_reduce(list_prepend(xor(v, b), range(8)), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) % 4 AS h FROM t),
r AS (
  SELECT k.c, list_concat(coalesce(b.own, [])[1:k.h], k.own[k.h + 1:]) AS turns
  FROM k LEFT JOIN t b ON b.c = k.c - k.c % 20),
p AS (SELECT c, d, turns[1:d] AS key, turns[1:d - 1] AS up, len(turns) = d AS last FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (
  SELECT d, key, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN last THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(key[d].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM p GROUP BY d, key),
m AS (SELECT n.*, q.conv_id AS parent_conv_id FROM n LEFT JOIN n q ON n.d > 0 AND q.d = n.d - 1 AND q.key = n.up),
o AS (SELECT m.*, (SELECT count(*) FROM m x WHERE x.parent_conv_id = m.conv_id AND x.d = m.d + 1) AS n_children FROM m),
e AS (SELECT unnest(range(0, d + 1)) AS a, key, saved, n_children = 0 AS leaf FROM o),
s AS (SELECT a AS d, key[1:a] AS key, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM e GROUP BY 1, 2)
SELECT o.conv_id, o.d::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM o JOIN s ON o.d = s.d AND o.key = s.key
"""
