"""Merkle manifest of a dataset: a digest of every row, a tree over each group's rows, and a tree over the groups.

The trees are built bottom up, one persisted level after the other; each parent keeps its children's digests. Proofs
are pushed top down: at each level children join their parents on (group, position), and every child puts its
siblings before the proof that its parent inherited. A level's keys are unique, so no group is a hot key, however many
of the rows it holds; positions come from a range sort whose partitions are counted, not from a window over a group.

Everything is DataFrame functions. A level is written to the shared folder before the next one reads it, so a lost
executor costs one level at most.

Rows with nulls, empty texts or any other values have leaves like others. A null group comes first. Ties in a group's
order go by leaf; rows that are repeated whole are leaves of their own. An empty table has no root. Columns beside
those named have no influence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, made, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of a row's number inside a partition in what monotonically_increasing_id gives.
_ROW_BITS = 33
#: Rows that a part of a small level holds; large levels have as many parts as shuffles have.
_PART_ROWS = 4096


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _numbered(rows: DataFrame, group: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """`rows` written in order with `part` and `row`, and where each group's stretch of each part begins: `part, <group>,
    before, first, size`. One row a part and group goes through the window of the second."""
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    placed = tied.repartitionByRange(*by, F.col("tie")).sortWithinPartitions(*by, "tie").drop("tie").withColumn("at", F.monotonically_increasing_id())
    placed = placed.withColumn("part", F.shiftright("at", _ROW_BITS)).withColumn("row", F.col("at") - F.shiftleft("part", _ROW_BITS)).drop("at")
    table = written(placed, name)
    stretches = table.groupBy("part", group).agg(F.count("*").alias("n"), F.min("row").alias("first"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return table, stretches.select("part", group, "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("size"))


def _positioned(table: DataFrame, stretches: DataFrame, group: str) -> DataFrame:
    """The table's rows with `pos`, their number in their group, and whatever `stretches` has beside."""
    a, b = table.alias("a"), stretches.alias("b")
    joined = a.join(b, (F.col("a.part") == F.col("b.part")) & F.col(f"a.{group}").eqNullSafe(F.col(f"b.{group}")))
    extra = [F.col(f"b.{c}") for c in stretches.columns if c not in ("part", group, "first", "before")]
    pos = (F.col("a.row") - F.col("b.first") + F.col("b.before")).alias("pos")
    return joined.select(*(F.col(f"a.{c}") for c in table.columns if c not in ("part", "row")), pos, *extra)


def _parts(rows: int) -> int:
    return -(-rows // _PART_ROWS)


def _levels(nodes: DataFrame, arity: int, name: str) -> list[DataFrame]:
    """The levels from `nodes` (g, pos, size, node) up: a group's last level has one node."""
    largest, rows = nodes.agg(F.max("size"), F.count("*")).first()
    levels = [nodes]
    while (largest or 0) > 1:
        run = F.sort_array(F.collect_list(F.struct("pos", "node")))["node"].alias("children")
        many = levels[-1].where("size > 1").groupBy("g", F.expr(f"pos div {arity}").alias("pos"), F.expr(f"(size + {arity - 1}) div {arity}").alias("size"))
        digest = F.unhex(F.sha2(F.array_join(F.transform("children", _hex), ""), 256))
        rows = rows // 2 + 1  # most that this level can have
        levels.append(written(many.agg(run).withColumn("node", digest).coalesce(_parts(rows)), f"{name}-level"))
        largest = -(-largest // arity)
    return levels


def _glued(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


def _proofs(levels: list[DataFrame], tops: DataFrame, arity: int, name: str) -> DataFrame:
    """The lowest level's rows with `subroot` and `proof`; `tops` has each group's (g, subroot, suffix)."""
    above = None
    for height in range(len(levels) - 1, -1, -1):
        level = levels[height]
        own = level.where("size = 1").join(tops.withColumnRenamed("suffix", "proof"), "g")
        if above is not None:
            parents = above.select("g", F.col("pos").alias("up"), F.col("children").alias("run"), "subroot", F.col("proof").alias("suffix"))
            at = F.expr(f"cast(pos % {arity} as int)")
            siblings = F.struct(
                _glued(F.slice("run", F.lit(1), at)).alias("left"), _glued(F.slice("run", at + 2, F.lit(arity))).alias("right")
            )
            below = level.where("size > 1").withColumn("up", F.expr(f"pos div {arity}")).join(parents, ["g", "up"])
            own = below.withColumn("proof", F.concat(F.array(siblings), "suffix")).select(*own.columns).unionByName(own)
        above = own if height == 0 else written(own, f"{name}-proofs")
    return above


@dataclass
class Manifest:
    """`rows`: what was kept of each row with `leaf`, `subroot` (hexadecimal) and `proof`, an array, from the leaf up,
    of the digests (bytes) left and right of the path. `root`: null for an empty table."""

    rows: DataFrame
    root: str | None


_PROOF = "array<struct<left:binary,right:binary>>"


def manifest(rows: DataFrame, leaf: Column, group: Column, order: Column, keep: list[Column], arity: int = 2) -> Manifest:
    """The manifest of `rows`: `leaf` is each row's digest in hexadecimal, trees are by `group` in ascending `order`."""
    if arity < 2:
        raise ValueError("a node needs two children or more")
    begun = made()
    flat = rows.select(group.alias("lang"), order.alias("key"), F.unhex(leaf).alias("node"), F.struct(*keep).alias("kept"))
    # texts are read here, once; what is sorted has some hundred bytes a row
    table, stretches = _numbered(written(flat, "merkle-rows"), "lang", ["key", "node"], "merkle-sorted")
    groups = stretches.groupBy("lang").agg(F.max("size").alias("size"))
    named, places = _numbered(groups.select(F.lit(0).alias("one"), "lang"), "one", ["lang"], "merkle-groups")
    ranks = _positioned(named, places, "one").select("lang", F.col("pos").alias("g"), F.col("size").alias("groups"))
    a, b = stretches.alias("a"), ranks.alias("b")
    ranked = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang"))).select("a.*", "b.g", "b.groups")
    leaves = _positioned(table, written(ranked, "merkle-stretches"), "lang").drop("lang", "key")
    levels = _levels(leaves, arity, "merkle")
    roots = None
    for level in levels:
        ends = level.where("size = 1").select("g", "node")
        roots = ends if roots is None else roots.unionByName(ends)
    # the tree over the groups: one group, whose rows are subroots by rank
    upper = roots.join(ranks.select("g", "groups"), "g").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.col("groups").alias("size"), "node")
    upper = written(upper, "merkle-subroots")
    tree = _levels(upper, arity, "merkle-top")
    last = tree[-1].where("size = 1").select("node").first()
    start = upper.sparkSession.createDataFrame([(0, [])], f"g long, suffix {_PROOF}").withColumn("subroot", F.lit(None).cast("binary"))
    tops = _proofs(tree, start, arity, "merkle-top").select(F.col("pos").alias("g"), F.col("node").alias("subroot"), F.col("proof").alias("suffix"))
    found = _proofs(levels, written(tops, "merkle-tops"), arity, "merkle")
    # the rows stay lazy: they read the sorted leaves, their stretches, the subroots' proofs and the last level of proofs
    discard(rows.sparkSession, begun, keep=1, but=("merkle-sorted", "merkle-stretches", "merkle-tops"))
    shown = found.select("kept.*", _hex("node").alias("leaf"), _hex("subroot").alias("subroot"), "proof")
    return Manifest(shown, last[0].hex() if last else None)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of a proof's digests, from the leaf up and left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda e: F.concat(_hex(e.left), _hex(e.right))), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, e: F.sha2(F.concat(_hex(e.left), node, _hex(e.right)), 256))


def prove_documents(docs: DataFrame, arity: int = 2) -> DataFrame:
    """`doc_id, leaf, subroot, root, proof_sha256, folded_root, verified` per row of `docs` (doc_id, source, lang, n_chars, text).

    Where 7 divides the CRC-32 of doc_id, the folded leaf is that of a row whose n_chars is one more; so it verifies
    only if n_chars is null. A null doc_id isn't tampered with.
    """
    values = {c: F.col(c) for c in FIELDS}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = F.when(chosen, leaf_digest(list((values | {"n_chars": F.col("n_chars") + 1}).values())))
    leaf = leaf_digest(list(values.values()))
    tree = manifest(docs, leaf, F.col("lang"), F.col("doc_id"), [F.col("doc_id"), F.unhex(changed).alias("changed")], arity)
    root = F.lit(tree.root).cast("string")
    found = tree.rows.select("doc_id", "leaf", "subroot", root.alias("root"), proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.coalesce(_hex("changed"), "leaf"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


# The level that a leaf's path has reached is a column of its own; each pass of the recursion halves every run.
ORACLE_SQL = """
with recursive rows as (
  select doc_id, lang, n_chars,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as tail,
    list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, b: case when b >= 0 then xor(c, b) else xor(c >> 1, 3988292384 * (c & 1)) end) as crc
  from documents
), leaves as (
  select doc_id, lang, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') || tail) as leaf,
    case when xor(crc, 4294967295) % 7 = 0 then sha256(head || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1)::varchar, '-') || tail) end as changed
  from rows
), placed as (
  select *, dense_rank() over (order by lang nulls first) - 1 as g from leaves
), numbered as (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by g) as size from placed
), tree as (
  select 0 as lvl, g, pos, size, leaf as node from numbered
  union all
  select lvl + 1, g, pos // 2, (size + 1) // 2, sha256(string_agg(node, '' order by pos)) from tree where size > 1 group by lvl, g, pos // 2, size
), subroots as (
  select g, node as subroot, lvl as height, count(*) over () as groups from tree where size = 1
), upper_tree as (
  select 0 as lvl, g as pos, groups as size, subroot as node from subroots
  union all
  select lvl + 1, pos // 2, (size + 1) // 2, sha256(string_agg(node, '' order by pos)) from upper_tree where size > 1 group by lvl, pos // 2, size
), steps as (
  select n.g, n.pos as leaf_pos, p.lvl, p.pos, s.node, p.pos % 2 as side
  from numbered n join tree p on p.g = n.g and p.pos = n.pos >> p.lvl and p.size > 1 left join tree s on s.g = p.g and s.lvl = p.lvl and s.pos = xor(p.pos, 1)
  union all
  select n.g, n.pos, 1000 + p.lvl, p.pos, s.node, p.pos % 2
  from numbered n join upper_tree p on p.pos = n.g >> p.lvl and p.size > 1 left join upper_tree s on s.lvl = p.lvl and s.pos = xor(p.pos, 1)
), proofs as (
  select g, leaf_pos, coalesce(string_agg(node, '' order by lvl), '') as proof, list(side || coalesce(node, '') order by lvl) as path from steps group by g, leaf_pos
)
select n.doc_id, n.leaf, r.subroot, t.node as root, sha256(coalesce(p.proof, '')) as proof_sha256,
  list_reduce(list_concat([coalesce(n.changed, n.leaf)], coalesce(p.path, [])),
    lambda node, e: sha256(case when e[1] = '1' then e[2:] || node else node || e[2:] end)) as folded_root,
  folded_root = root as verified
from numbered n join subroots r on r.g = n.g join (select node from upper_tree where size = 1) t on true left join proofs p on p.g = n.g and p.leaf_pos = n.pos
"""
