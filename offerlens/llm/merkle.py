"""Merkle manifest of a dataset by a slot pivot.

The leaves of a group get their places in order; a run of ``FANOUT`` places has one parent. Conditional aggregates spread
the children of a parent into one column per slot. All slot columns one after another are the parent's hash input; all
but the own one are a child's siblings. Level by level this gives the root of each group, and the groups' roots, as
leaves of one more tree, give the root of the dataset. Going down again, each child takes its siblings and its parent's
path, so that a leaf ends up with its whole audit path.

Places come from a range sort with the counts of the sorted partitions as offsets, so no group is ever in one task,
however many rows it holds. Everything is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import op, table
from offerlens.session import staged

FANOUT = 16
#: Columns of a document, in the order in which they enter its leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*inputs: Column) -> Column:
    """Lowercase hex SHA-256 of the inputs (strings, null: nothing) one after another."""
    return F.sha2(F.concat_ws("", *inputs).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as a leaf takes it: UTF-8 byte count, colon and value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def proof(path: Column) -> Column:
    """Digest of all siblings of an audit path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def fold(path: Column, start: Column) -> Column:
    """The root that a leaf of hash ``start`` leads to along an audit path."""
    return F.aggregate(path, start, lambda node, s: digest(s["before"], node, s["after"]))


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows``, a written table, with ``place`` (from 0) and ``total`` within ``grp`` (not null), in ``order``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("grp"), *[F.col(c).asc_nulls_first() for c in order]]
    at = F.monotonically_increasing_id()  # partition in the upper bits, row of the sorted partition in the lower 33
    ordered = staged(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", at).withColumn("part", F.shiftright("at", 33)), "leaves")
    runs = ordered.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("grp")  # a row per sorted partition that holds the group
    ahead = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    runs = runs.select("grp", "part", (F.col("first") - ahead).alias("first"), F.sum("n").over(whole).alias("total"))
    return ordered.join(runs, ["grp", "part"]).withColumn("place", F.col("at") - F.col("first")).drop("at", "part", "first")


def _slots(fanout: int) -> list[str]:
    return [f"slot{k}" for k in range(fanout)]


def _pivot(nodes: DataFrame, fanout: int) -> DataFrame:
    """One row per parent of nodes (grp, place, total, node): its children in ``fanout`` columns."""
    own = F.pmod("place", F.lit(fanout))
    spread = [F.max(F.when(own == k, F.col("node"))).alias(c) for k, c in enumerate(_slots(fanout))]
    return nodes.groupBy("grp", F.expr(f"place div {fanout}").alias("place")).agg(F.max("total").alias("total"), *spread)


def _parents(pivot: DataFrame, fanout: int) -> DataFrame:
    up = digest(*[F.col(f"{c}.hash") for c in _slots(fanout)])
    return pivot.select("grp", "place", F.expr(f"(total + {fanout - 1}) div {fanout}").alias("total"), F.struct(up.alias("hash")).alias("node"))


def _children(pivot: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """(grp, place, node, up) of the children in a pivot; ``above``: (grp, place, up) of their parents."""
    hashes = F.array(*[F.col(f"{c}.hash") for c in _slots(fanout)])
    rows = pivot.join(above, ["grp", "place"]).withColumn("hashes", hashes)
    rows = rows.select("grp", "place", "hashes", "up", F.posexplode(F.array(*_slots(fanout))).alias("slot", "node")).filter(F.col("node").isNotNull())
    before = F.array_join(F.slice("hashes", F.lit(1), F.col("slot")), "")
    after = F.array_join(F.slice("hashes", F.col("slot") + 2, F.lit(fanout)), "")  # empty slots are null and left out
    path = F.concat(F.array(F.struct(before.alias("before"), after.alias("after"))), F.col("up.path"))
    up = F.struct(F.col("up.subroot").alias("subroot"), F.col("up.root").alias("root"), path.alias("path"))
    return rows.select("grp", (F.col("place") * fanout + F.col("slot")).alias("place"), "node", up.alias("up"))


def _climb(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """(pivots by level, roots (grp, level, node)) of the trees over ``nodes`` (grp, place, total, node)."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    pivots: list[DataFrame] = []
    roots = nodes.filter("total = 1").select("grp", F.lit(0).alias("level"), F.struct("node.hash").alias("node"))
    while most > 1:
        pivots.append(staged(_pivot(nodes.filter("total > 1"), fanout), "slots"))
        nodes = _parents(pivots[-1], fanout)
        roots = roots.union(nodes.filter("total = 1").select("grp", F.lit(len(pivots)).alias("level"), "node"))
        most = -(-most // fanout)
    return pivots, roots


def _descend(pivots: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame | None:
    """(grp, place, node, up) of all leaves below parents; ``tops``: (grp, level, up) of the roots."""
    below = None
    for level in range(len(pivots), 0, -1):
        above = tops.filter(F.col("level") == level).select("grp", F.lit(0).cast("bigint").alias("place"), "up")
        above = above if below is None else above.union(below.select("grp", "place", "up"))
        below = _children(pivots[level - 1], above, fanout)
    return below


def manifest(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(kept, leaf, subroot, root, path) for each row of ``leaves`` (grp string, key, leaf string, kept).

    Each group ``grp`` is a tree over its leaves in the order of ``key`` (nulls first; ties by ``leaf``, then as stored,
    which no hash can tell apart); the groups' roots in bytewise order of ``grp``, null first, are the leaves of one more
    tree. ``path``: the siblings (before, after) of each level from the leaf to the root, both empty for a run of one.
    A lone leaf is its group's root, a lone group's root is the root; no leaves, no rows. ``kept`` is any column, passed
    on. Repeated keys and rows stay apart, each with a place of its own.
    """
    if fanout < 2:
        raise ValueError("a parent has two children at least")
    grp = F.coalesce(F.concat(F.lit("="), "grp"), F.lit("")).alias("grp")
    rows = staged(leaves.select(grp, "key", "leaf", "kept", F.monotonically_increasing_id().alias("nth")), "hashed")
    placed = _placed(rows, ["key", "leaf", "nth"]).select("grp", "place", "total", F.struct(F.col("leaf").alias("hash"), F.col("kept").alias("kept")).alias("node"))
    placed = staged(placed, "placed")
    pivots, roots = _climb(placed, fanout)

    roots = staged(roots.select("grp", "level", F.col("node.hash").alias("subroot")), "roots")
    tops = _placed(roots.withColumnRenamed("grp", "name").withColumn("grp", F.lit("")), ["name"])
    tops = staged(tops.select("grp", "place", "total", F.struct(F.col("subroot").alias("hash"), "name", "level").alias("node")), "groups")
    top_pivots, root = _climb(tops, fanout)
    none = F.expr("cast(array() as array<struct<before:string,after:string>>)")
    start = root.select("grp", "level", F.struct(F.lit("").alias("subroot"), F.col("node.hash").alias("root"), none.alias("path")).alias("up"))
    named = _descend(top_pivots, start, fanout)
    if named is None:  # one group, or none
        named = tops.select("node", F.struct(F.lit("").alias("subroot"), F.col("node.hash").alias("root"), none.alias("path")).alias("up"))
    up = F.struct(F.col("node.hash").alias("subroot"), F.col("up.root").alias("root"), F.col("up.path").alias("path"))
    named = staged(named.select(F.col("node.name").alias("grp"), F.col("node.level").alias("level"), up.alias("up")), "tops")

    out = placed.filter("total = 1").join(named.filter("level = 0"), "grp").select("node", "up")
    below = _descend(pivots, named, fanout)
    if below is not None:
        out = out.union(below.select("node", "up"))
    return out.select("node.kept", F.col("node.hash").alias("leaf"), "up.subroot", "up.root", "up.path")


def tampered(key: Column) -> Column:
    """True for the rows of which the query checks a changed copy: 5 divides the CRC-32 of the decimal id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


_SPAN = "PARTITION BY grp, place // 16 ORDER BY place ROWS BETWEEN"


def _levels_sql(name: str, depth: int) -> str:
    """CTEs: ``{name}s{k}`` with the siblings of each node of level k and ``{name}{k + 1}`` with the nodes above."""
    out = []
    for k in range(depth):
        out.append(
            f"{name}s{k} AS MATERIALIZED (SELECT grp, place, coalesce(string_agg(hash, '') OVER ({_SPAN} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,"
            f" coalesce(string_agg(hash, '') OVER ({_SPAN} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}{k} WHERE total > 1),"
            f" {name}{k + 1} AS MATERIALIZED (SELECT grp, place // 16 AS place, (total + 15) // 16 AS total, sha256(string_agg(hash, '' ORDER BY place)) AS hash"
            f" FROM {name}{k} WHERE total > 1 GROUP BY grp, place // 16, total)"
        )
    return ", ".join(out)


def _sql(depth: int = 6, top: int = 4) -> str:
    """Plain levels, unrolled; 16 ** depth documents of a source and 16 ** top sources at most."""
    value = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    hashed = "sha256(" + " || ".join(value.format(c) for c in FIELDS) + ")"
    changed = "sha256(" + " || ".join(value.format(c if c != "text" else lower) for c in FIELDS) + ")"
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)), lambda c, b: {bits}), 4294967295::BIGINT)"
    steps, joins, proofs, prior = [], [], [], "start"
    for kind, n in (("n", depth), ("t", top)):
        for k in range(n):
            place = f"f.{'place' if kind == 'n' else 'up_place'} // {16**k}"
            owner = "f.grp" if kind == "n" else "''"
            proofs.append(f"siblings{kind}{k}")
            steps.append(
                f"f{kind}{k} AS MATERIALIZED (SELECT f.* EXCLUDE (folded), CASE WHEN s.place IS NULL THEN f.folded ELSE sha256(s.before || f.folded || s.after) END AS folded,"
                f" coalesce(s.before || s.after, '') AS siblings{kind}{k} FROM {prior} f LEFT JOIN {kind}s{k} s ON s.grp = {owner} AND s.place = {place})"
            )
            prior = f"f{kind}{k}"
    roots = " UNION ALL ".join(f"SELECT grp, hash AS subroot FROM n{k} WHERE total = 1" for k in range(depth + 1))
    tops = " UNION ALL ".join(f"SELECT hash AS root FROM t{k} WHERE total = 1" for k in range(top + 1))
    return f"""
WITH leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || source, '') AS grp, {hashed} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {changed} END AS changed FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY grp) AS total FROM leaves),
n0 AS (SELECT grp, place, total, leaf AS hash FROM placed), {_levels_sql("n", depth)},
subroots AS MATERIALIZED ({roots}),
groups AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY grp) - 1 AS up_place, count(*) OVER () AS total FROM subroots),
t0 AS (SELECT '' AS grp, up_place AS place, total, subroot AS hash FROM groups), {_levels_sql("t", top)},
root AS MATERIALIZED ({tops}),
start AS MATERIALIZED (
  SELECT p.doc_id, p.grp, p.leaf, p.place, g.subroot, g.up_place, coalesce(p.changed, p.leaf) AS folded FROM placed p JOIN groups g ON g.grp = p.grp),
{", ".join(steps)}
SELECT doc_id, leaf, subroot, root, sha256({" || ".join(proofs)}) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM {prior}, root"""


@op("op12_merkle_manifest", _sql())
def op12_merkle_manifest(spark, sf_dir):
    """One row per row of ``documents``: its hashes, the digest of its proof, and the root that the proof leads to.

    The leaf is made of doc_id, source, lang, n_chars and text; other columns play no part. The sources are the groups,
    a null one included. Rows of a null doc_id come first in their source and are not tampered with; an empty or very
    long text is a text like any other; equal rows are leaves of their own; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    changed = F.when(tampered(F.col("doc_id")), leaf(*[F.col(c) for c in FIELDS[:-1]], F.translate("text", UPPER, LOWER)))
    kept = F.struct("doc_id", changed.alias("changed"))
    rows = manifest(docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("key"), leaf(*[F.col(c) for c in FIELDS]).alias("leaf"), kept.alias("kept")))
    folded = fold(F.col("path"), F.coalesce("kept.changed", "leaf"))
    out = rows.select("kept.doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
