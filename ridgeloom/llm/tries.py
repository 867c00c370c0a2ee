"""A prefix trie of conversations, built as a Patricia tree: only branch, end and leaf points, with compressed edges.

1. Turns are numbered and conversations rebuilt. Texts never leave the first pass: a turn goes on as a digest of role and
   text and the text's length. The id of a trie node is the XOR, over its turns, of two 64-bit hashes of (depth, digest),
   so that ids of prefixes are running XORs, which tasks can compute apart from each other.
2. Conversations are cut into blocks of BLOCK turns, a row each, with the ids and the running lengths along the block.
   Distinct blocks (same node at the start, same node at the end) are sorted by start and ids over all ranges; a block
   shares with the one before it as many nodes as their ids agree in, and adds a chain of nodes behind them.
3. Points are the ends of chains, and the nodes inside chains at which others attach. They cut chains into edges. Ends of
   blocks of conversations longer than BLOCK are points too, so that no edge is longer than a block.
4. Aggregates are subtree sums over points. With m conversations that end at a point, D code points from the root to it and
   L on its edge, all of them are sums of m, m * D, L and leaves, and a minimum. They are summed by pointer doubling: in
   round k each point adds what the points 2**k below it have, so rounds grow with the logarithm of the height.
5. Nodes inside an edge share the members and leaves of its lower point; what they save is what lies under the point and
   the members times the lengths from the node to the point, a suffix sum of the edge.

No task sees a whole conversation, group of copies or subtree. A digest over the members that end at a node is one stream
by its definition; its task reads strings of up to 2**MEMBER_BITS neighbouring ids that others have joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeloom.llm.shared import drop_staged, staged

#: Turns of a block, and blocks of a stretch over which running values are taken at once.
BLOCK, STRETCH = 64, 4096
#: Binary digits of the ids that one joined string of members spans.
MEMBER_BITS = 10
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def _node(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _root() -> Column:
    return _node(F.lit(0).cast("long"), F.lit(0).cast("long"))


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, j, digest, chars): the turns of each conversation from 1, by turn (null first), then by digest.

    Rows are dealt out by ranges, so that a conversation may hold any share of them; only one that goes on from the range
    before needs its number of turns there, and there are fewer of those than ranges.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    narrow = staged(turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars")), "turns")
    dealt = staged(narrow.repartitionByRange("conv_id", "turn", "digest").withColumn("range", F.spark_partition_id()), "dealt")
    drop_staged(narrow)
    parts = dealt.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    carried = parts.withColumn("ahead", ahead).where("ahead > 0").select("conv_id", "range", "ahead")
    here = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy("turn", "digest"))
    out = staged(dealt.withColumn("here", here).join(F.broadcast(carried), ["conv_id", "range"], "left").select("conv_id", (F.col("here") + F.coalesce("ahead", F.lit(0))).alias("j"), "digest", "chars"), "numbered")
    drop_staged(dealt)
    return out


def sharing_heads(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: the first h turns of conversation c - c % group, then c's own after its first h, where h is
    crc32(decimal c) % most. Gives (conv_id, d, digest, chars, total) of all their turns, and (conv_id) of those without any.
    """
    c = F.col("conv_id")
    lengths = staged(turns.groupBy("conv_id").agg(F.max("j").alias("n")), "lengths")
    plan = lengths.select("conv_id", "n", (c - c % group).alias("base"), (F.crc32(c.cast("string").cast("binary")) % most).alias("h"))
    heads = plan.join(lengths.where(c % group == 0).select(c.alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = heads.select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("total"))
    first = turns.where((c % group == 0) & (F.col("j") < most)).select(c.alias("base"), F.col("j").alias("d"), "digest", "chars")
    taken = plan.where("head > 0").join(first, "base").where("d <= head").select("conv_id", "d", "digest", "chars", "total")
    own = turns.join(plan, "conv_id").where("j > h").select("conv_id", (F.col("head") + F.col("j") - F.col("h")).alias("d"), "digest", "chars", "total")
    return taken.union(own), plan.where("total = 0").select("conv_id")


def _blocks(rows: DataFrame) -> DataFrame:
    """(conv_id, b, total, ids, sums, start, d0): the blocks of conversations with the ids of their nodes, the code points up
    to each, and both before the block."""
    b = F.floor((F.col("d") - 1) / BLOCK).cast("long")
    hashed = rows.select("conv_id", "d", "chars", "total", b.alias("b"), F.xxhash64("d", "digest").alias("hx"), F.xxhash64(F.lit("other"), "digest", "d").alias("hy"))
    within = Window.partitionBy("conv_id", "b").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    run = hashed.select("conv_id", "b", "d", "total", F.expr("bit_xor(hx)").over(within).alias("x"), F.expr("bit_xor(hy)").over(within).alias("y"), F.sum("chars").over(within).alias("s"))
    lists = staged(run.groupBy("conv_id", "b").agg(F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("d", "x", "y", "s"))).alias("l")), "blocks")
    tops = lists.select("conv_id", "b", F.floor(F.col("b") / STRETCH).cast("long").alias("stretch"), F.element_at("l", -1).alias("e")).select("conv_id", "b", "stretch", "e.x", "e.y", "e.s")
    running = ("bit_xor(x)", "bit_xor(y)", "sum(s)")

    def before(frame) -> list[Column]:
        return [F.coalesce(F.expr(f).over(frame.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(n) for f, n in zip(running, ("bx", "by", "bs"), strict=True)]

    near = tops.select("conv_id", "b", "stretch", *before(Window.partitionBy("conv_id", "stretch").orderBy("b")))
    stretches = tops.groupBy("conv_id", "stretch").agg(*[F.expr(f).alias(n) for f, n in zip(running, "xys", strict=True)])
    far = stretches.select("conv_id", "stretch", *before(Window.partitionBy("conv_id").orderBy("stretch"))).where("stretch > 0").withColumnsRenamed({"bx": "fx", "by": "fy", "bs": "fs"})
    starts = near.where("b > 0").join(far, ["conv_id", "stretch"], "left").select(
        "conv_id", "b", F.col("bx").bitwiseXOR(F.coalesce("fx", F.lit(0))).alias("bx"), F.col("by").bitwiseXOR(F.coalesce("fy", F.lit(0))).alias("by"), (F.col("bs") + F.coalesce("fs", F.lit(0))).alias("bs"))
    zero = F.lit(0).cast("long")
    both = lists.where("b = 0").select("*", zero.alias("bx"), zero.alias("by"), zero.alias("bs")).unionByName(lists.where("b > 0").join(starts, ["conv_id", "b"]))
    ids = F.transform("l", lambda e: _node(e["x"].bitwiseXOR(F.col("bx")), e["y"].bitwiseXOR(F.col("by"))))
    return both.select("conv_id", "b", "total", ids.alias("ids"), F.transform("l", lambda e: e["s"] + F.col("bs")).alias("sums"), _node(F.col("bx"), F.col("by")).alias("start"), F.col("bs").alias("d0"))


def _shared(a: list, b: list) -> int:
    """How many of the first items agree."""
    n = 0
    for p, q in zip(a, b, strict=False):
        if p != q:
            break
        n += 1
    return n


def _with_shared(chains: DataFrame) -> DataFrame:
    """The distinct blocks in order, each with a number ``rid`` and how many nodes it shares with the one before (null in
    the first of a range)."""
    ordered = chains.repartitionByRange("start", "ids").sortWithinPartitions("start", "ids").withColumn("rid", F.monotonically_increasing_id())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            found = []
            for start, ids in zip(batch.column("start").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                found.append(None if last is None else _shared(last[1], ids) if last[0] == start else 0)
                last = (start, ids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*batch.schema.names, "shared"])

    schema = ", ".join(f"`{n}` {t}" for n, t in ordered.dtypes)
    lined = staged(ordered.mapInArrow(work, f"{schema}, shared int"), "lined")
    part = F.shiftright("rid", 33)
    lasts = lined.groupBy(part.alias("part")).agg(F.max_by(F.struct("start", "ids"), "rid").alias("last"), F.min_by(F.struct("start", "ids", "rid"), "rid").alias("first"))  # a row for each range
    seam = lasts.select("first", F.lag("last").over(Window.orderBy("part")).alias("last"))
    same = F.size(F.filter(F.zip_with("first.ids", "last.ids", lambda p, q: p == q), lambda x: x))
    mended = seam.select("first.rid", F.when(F.col("first.start") == F.col("last.start"), same).otherwise(0).alias("mended"))
    return lined.join(F.broadcast(mended), "rid", "left").withColumn("shared", F.coalesce("shared", "mended", F.lit(0))).drop("mended")


def _points(lined: DataFrame) -> DataFrame:
    """(id, depth, parent, far, edge, before): the points of the compressed tree, the code points down to each and, for every
    node of its edge from the top, those before the node."""
    size, at = F.size("ids"), lambda k: F.element_at("ids", k)
    attached = lined.where("shared > 0").select(at(F.col("shared")).alias("id")).distinct()
    chains = lined.select("rid", "shared", F.posexplode(F.expr("slice(ids, shared + 1, greatest(0, size(ids) - 1 - shared))")).alias("k", "id"))
    inside = chains.join(attached, "id", "left_semi").groupBy("rid").agg(F.collect_set(F.col("shared") + 1 + F.col("k")).alias("marks"))
    stops = F.array_sort(F.array_union(F.coalesce("marks", F.array().cast("array<int>")), F.array(size)))
    cut = lined.join(inside, "rid", "left").withColumn("stops", stops).select("*", F.posexplode("stops").alias("k", "stop"))
    cut = cut.withColumn("top", F.when(F.col("k") == 0, F.col("shared")).otherwise(F.get("stops", F.col("k") - 1)))
    cut = cut.withColumn("before", F.expr("slice(concat(array(d0), sums), top + 1, stop - top)"))
    parent = F.when(F.col("top") == 0, F.col("start")).otherwise(at(F.greatest("top", F.lit(1))))
    found = cut.select(at(F.col("stop")).alias("id"), (F.col("depth0") + F.col("stop")).alias("depth"), parent.alias("parent"), F.element_at("sums", F.col("stop")).alias("far"), (F.element_at("sums", F.col("stop")) - F.get("before", F.lit(0))).alias("edge"), "before")
    return found


def _subtree_sums(points: DataFrame) -> DataFrame:
    """(id, n, low, leaves, reached, edges): over each point and all below it, by pointer doubling."""
    names = ("n", "low", "leaves", "reached", "edges")
    up = F.when(F.col("parent") != _root(), F.col("parent"))  # the root takes one sum over all at the end
    state = staged(points.select("id", up.alias("up"), *names), "sums")
    total = [F.min("low").alias("low") if c == "low" else F.sum(c).alias(c) for c in names]
    root = staged(state.agg(*total).where("n is not null"), "root")
    while not state.where("up is not null").isEmpty():
        gained = state.where("up is not null").groupBy("up").agg(*total).withColumnsRenamed({"up": "of", **{c: f"g_{c}" for c in names}})
        added = state.join(gained.hint("merge"), F.col("id") == F.col("of"), "left")
        added = added.select("id", "up", *[F.least(c, f"g_{c}").alias(c) if c == "low" else (F.col(c) + F.coalesce(f"g_{c}", F.lit(0))).alias(c) for c in names])
        further = state.where("up is not null").select(F.col("id").alias("via"), F.col("up").alias("next"))
        now = staged(added.join(further.hint("merge"), F.col("up") == F.col("via"), "left").select("id", F.col("next").alias("up"), *names), "sums")
        drop_staged(state)
        state = now
    return state.where(F.col("id") != _root()).select("id", *names).union(root.select(_root().alias("id"), *names))


def _end_digests(members: DataFrame) -> DataFrame:
    """(id, ends_sha256): SHA-256 of the decimal conv_ids of (id, conv_id), ascending, comma-joined.

    Neighbouring ids are joined into strings first; a task then reads its nodes' strings in order and holds one digest.
    """
    part = F.shiftright("conv_id", MEMBER_BITS)
    joined = members.groupBy("id", part.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("text"))
    ordered = joined.repartition("id").sortWithinPartitions("id", "part").select("id.x", "id.y", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for x, y, text in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "text")), strict=True):
                if at == (x, y):
                    state.update(b",")
                else:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = (x, y), hashlib.sha256()
                state.update(text.encode())
            yield from _digest_rows(done)
        if at is not None:
            yield from _digest_rows([(*at, state.hexdigest())])

    return ordered.mapInArrow(work, "x bigint, y bigint, ends_sha256 string").select(_node(F.col("x"), F.col("y")).alias("id"), "ends_sha256")


def _digest_rows(rows: list[tuple[int, int, str]]) -> Iterator[pa.RecordBatch]:
    if rows:
        x, y, digest = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(digest, pa.string())], ["x", "y", "ends_sha256"])


def trie(rows: DataFrame, turnless: DataFrame) -> DataFrame:
    """Every node of the prefix trie of sequences: rows (conv_id, d, digest, chars, total) are their turns, d from 1 to total
    without a gap; ``turnless`` has the conv_id of sequences without any.

    Gives conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256. Without a sequence there is no node.
    """
    blocks = staged(_blocks(rows), "chained")
    end = F.element_at("ids", -1)
    last = F.col("b") == F.floor((F.col("total") - 1) / BLOCK)
    members = staged(blocks.where(last).select(end.alias("id"), "conv_id", F.element_at("sums", -1).alias("far")).union(turnless.select(_root().alias("id"), "conv_id", F.lit(0).cast("long").alias("far"))), "members")
    firsts = [F.first(c).alias(c) for c in ("b", "ids", "sums", "d0")]
    chains = staged(blocks.groupBy("start", end.alias("end")).agg(*firsts).select("start", (F.col("b") * BLOCK).alias("depth0"), "ids", "sums", "d0"), "chains")
    lined = _with_shared(chains)
    found = staged(_points(lined), "points")
    drop_staged(blocks, chains, lined)
    ends = members.groupBy("id").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.sum("far").alias("reached"))
    children = found.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("struct<x: bigint, y: bigint>")
    root = members.limit(1).select(_root().alias("id"), zero.alias("depth"), none.alias("parent"), zero.alias("far"), zero.alias("edge"), F.array(zero).alias("before"))
    held = found.union(root).join(ends, "id", "left").join(children, "id", "left")
    points = staged(held.select("id", "depth", "parent", "far", "edge", "before", F.coalesce("n", zero).alias("n"), "low", F.coalesce("reached", zero).alias("reached"), F.coalesce("n_children", zero).alias("n_children")), "points")
    leaf = (F.col("n_children") == 0).cast("long")
    sums = staged(_subtree_sums(points.select("id", "parent", "n", "low", leaf.alias("leaves"), "reached", F.col("edge").alias("edges"))), "subtrees")

    own = points.select("id", "depth", "parent", "far", "edge", "before", "n_children").join(sums, "id")
    under = F.col("reached") - F.col("n") * F.col("far") - (F.col("edges") - F.col("edge"))  # saved below the point
    above = sums.select(F.col("id").alias("of"), F.col("low").alias("parent_low"))
    full = own.hint("merge").join(above, F.col("parent") == F.col("of"), "left").join(_end_digests(members.select("id", "conv_id")), "id", "left")
    nodes = full.select("*", under.alias("under"), F.size("before").alias("size"), F.posexplode("before").alias("k", "so_far"))
    bottom = F.col("k") == F.col("size") - 1
    out = staged(nodes.select(
        F.col("low").alias("conv_id"), (F.col("depth") - F.col("size") + 1 + F.col("k")).cast("long").alias("depth"),
        F.when(F.col("parent").isNotNull(), F.when(F.col("k") == 0, F.col("parent_low")).otherwise(F.col("low"))).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(bottom, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("under") + (F.col("n") - 1) * (F.col("far") - F.col("so_far"))).alias("saved_tokens"),
        F.when(bottom, F.coalesce("ends_sha256", F.lit(NO_MEMBERS))).otherwise(NO_MEMBERS).alias("ends_sha256"),
    ), "trie")
    drop_staged(members, found, points, sums)
    return out


def prefix_trie(turns: DataFrame, **columns) -> DataFrame:
    """The trie of the conversations of a table as ``sharing_heads`` rebuilds them.

    A null role or text is an empty one, a null turn comes first, turns of one number are in the order of a digest of role
    and text, repeated rows are turns of their own, rows without a conv_id belong to none. Other columns are not read,
    whatever their names; an empty table gives an empty trie.
    """
    first = numbered(turns, **columns)
    rows, turnless = sharing_heads(first)
    out = trie(rows, turnless)
    drop_staged(first)
    return out


#: The same in SQL, by every prefix of every conversation.
ORACLE = """
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) as j
           from conversations where conv_id is not null),
tok as (select conv_id, j, dense_rank() over (order by role, text) as tok, length(text) as len from t),
c as (select conv_id, count(*) as n, conv_id - conv_id % 100 as base, xor(list_reduce(list_transform(string_split(cast(conv_id as varchar), ''), lambda ch: cast(ascii(ch) as bigint)),
      lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda z, k: xor(z >> 1, 3988292384 * (z & 1)), xor(crc, byte)), 4294967295), 4294967295) % 6 as h from tok group by conv_id),
p as (select c.conv_id, c.base, c.h, c.n, least(c.h, coalesce(b.n, 0)) as head from c left join c b on b.conv_id = c.base),
r as (select p.conv_id, tok.j as d, tok, len from p join tok on tok.conv_id = p.base and tok.j <= p.head
      union all select p.conv_id, p.head + tok.j - p.h as d, tok, len from p join tok on tok.conv_id = p.conv_id and tok.j > p.h),
s as (select p.conv_id, coalesce(list(tok order by d) filter (where d is not null), cast([] as bigint[])) as toks, coalesce(list(len order by d) filter (where d is not null), cast([] as bigint[])) as lens from p left join r on r.conv_id = p.conv_id group by p.conv_id),
e as (select conv_id, d, list_slice(toks, 1, d) as key, case when d = 0 then 0 else lens[d] end as len, d = len(toks) as ends from (select conv_id, toks, lens, unnest(range(len(toks) + 1)) as d from s)),
nodes as (select key, d, min(conv_id) as conv_id, count(*) as n, any_value(len) as len, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256 from e group by key, d),
kids as (select list_slice(key, 1, d - 1) as key, count(*) as n_children from nodes where d > 0 group by 1),
full_nodes as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids on kids.key = nodes.key),
sub as (select list_slice(key, 1, i) as key, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum((n - 1) * len) as saved from (select key, n, len, n_children, unnest(range(d + 1)) as i from full_nodes) group by 1)
select f.conv_id, cast(f.d as bigint) as depth, up.conv_id as parent_conv_id, f.n as n_convs, f.n_children, cast(sub.n_leaves as bigint) as n_leaves, cast(sub.saved as bigint) as saved_tokens, f.ends_sha256
from full_nodes f join sub on sub.key = f.key left join nodes up on f.d > 0 and up.key = list_slice(f.key, 1, f.d - 1)"""
