"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

Two lines are within one edit (a character inserted, deleted or replaced) exactly if deleting at most one character from
each leaves the same string. So every line emits itself and its variants with one character less, as hashed keys:

* two lines that give the same variant at the same place differ by one replaced character there;
* a line that equals another's variant lacks that one character.

Lines are never paired inside a group. The earliest line of the group stands for all, since in either case every member
is within one edit of it; the chosen pair is then verified by its edit distance. Before, a lossless sieve drops lines
that cannot have a partner: of two lines within one edit, the first or the last half (of the shorter length) is equal,
so a line of which neither half occurs elsewhere emits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import op, probe, spare, table
from offerlens.session import staged

#: Shorter lines are layout (headings, list marks, closings) and stay.
MIN_CHARS = 16
#: A variant is hashed by blocks of so many characters or more, of which a deletion changes one.
BLOCK = 256


def _lines(docs: DataFrame, min_chars: int, exact_chars: int | None = None) -> DataFrame:
    """(doc_id, row, no, line, n, h1, h2): the lines that take part; ``row`` tells rows of equal id apart."""
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    part = F.length("line") >= min_chars
    if exact_chars is not None:
        part = part | ((F.length("line") >= exact_chars) & F.col("line").rlike(r"\S"))
    rows = rows.filter(part)
    return rows.withColumns({"n": F.length("line"), "h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _xor(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))


def _blocks(line: Column, block: Column, count: Column, shift: int) -> Column:
    """Hashes of the blocks of a line from character ``shift`` on, each salted by its place."""
    place = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(place, lambda c: F.xxhash64(F.substr(line, c * block + 1 + shift, block), c))


def variants(lines: DataFrame) -> DataFrame:
    """Columns of ``lines`` (with ``line`` and ``n``) without the line, and (v, vn, at): each variant's hash, length, deleted place (-1: none)."""
    rest = [c for c in lines.columns if c not in ("line", "n")]
    size = lambda n: F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(n))).cast("int")
    count = lambda n, b: F.ceil(n / b).cast("int")
    n = F.col("n")
    own = lines.withColumn("b", size(n)).select(
        *rest, _xor(_blocks(F.col("line"), F.col("b"), count(n, F.col("b")), 0)).alias("v"), n.alias("vn"), F.lit(-1).alias("at")
    )
    cut = lines.withColumn("b", size(n - 1)).withColumns(
        {"still": _blocks(F.col("line"), F.col("b"), count(n, F.col("b")), 0), "moved": _blocks(F.col("line"), F.col("b"), count(n - 1, F.col("b")), 1)}
    )
    cut = cut.withColumn("c", F.explode(F.sequence(F.lit(0), F.size("still") - 1)))
    c, b = F.col("c"), F.col("b")
    cut = cut.select(
        *rest, "n", "c", "b",
        F.substr("line", c * b + 1, b + 1).alias("part"),
        _xor(F.slice("still", F.lit(1), c)).bitwiseXOR(_xor(F.slice("moved", c + 2, F.size("still")))).alias("around"),
        F.least(b, n - c * b).alias("here"),
    )
    cut = cut.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("here") - 1)))
    mid = F.concat(F.substr("part", F.lit(1), F.col("j")), F.substr("part", F.col("j") + 2, b))
    cut = cut.withColumn("mid", mid)
    changed = F.when(F.col("mid") == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64("mid", c))
    return own.unionByName(cut.select(*rest, F.col("around").bitwiseXOR(changed).alias("v"), (n - 1).alias("vn"), (c * b + F.col("j")).alias("at")))


def near_lines(docs: DataFrame, distinct: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2) of the distinct lines that are within one edit of a line that first occurs earlier."""
    key = F.explode("halves").alias("key")
    shared = staged(distinct.select(key).groupBy("key").count().filter("count > 1").select("key"), "line-halves")
    some = distinct.select("h1", key).join(probe(shared), "key", "left_semi").select("h1").distinct()
    some = staged(some, "line-candidates")
    order = F.struct("doc_id", "no")
    texts = _lines(docs, min_chars).join(probe(some), "h1", "left_semi")
    texts = staged(texts.groupBy("h1", "h2", "n").agg(F.min(order).alias("first"), F.any_value("line").alias("line")), "line-texts")
    rows = variants(texts.select("line", "n", F.struct("first", "h1", "h2").alias("me")))
    same, there = Window.partitionBy("v", "vn"), Window.partitionBy("v", "vn", "at")
    whole, cut = F.when(F.col("at") < 0, F.col("me")), F.when(F.col("at") >= 0, F.col("me"))
    rows = rows.withColumns({"sub": F.min("me").over(there), "own": F.min(whole).over(same), "cut": F.min(cut).over(same)})
    best = F.when(F.col("at") < 0, F.col("cut")).otherwise(F.least("sub", "own"))
    found = rows.select("me", best.alias("other")).filter("other.first < me.first").groupBy("me").agg(F.min("other").alias("other"))
    a = texts.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("line").alias("a"))
    b = texts.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("line").alias("b"))
    pairs = found.select("me.h1", "me.h2", F.col("other.h1").alias("b1"), F.col("other.h2").alias("b2"))
    pairs = pairs.join(a, (F.col("h1") == F.col("a1")) & (F.col("h2") == F.col("a2"))).join(b, ["b1", "b2"])
    return pairs.filter(F.levenshtein("a", "b", 1) >= 0).select("h1", "h2")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """``docs`` with lines removed from ``text``, and n_lines, n_removed; all other columns pass through.

    A line goes if an equal line, or one within one edit, occurs earlier, in a document of smaller ``doc_id`` or higher
    up in the same one; it goes whether or not that earlier line stays itself. Lines below ``min_chars`` characters
    stay and count for nothing, but with ``exact_chars`` those of at least so many that are not blank go if an equal line
    occurs earlier. Lines of the same id and line number tie and stay (repeated rows). Rows with a null id
    take no part. Null text stays null with no lines, an empty text is one blank line, long texts are read whole, and an
    empty table stays empty. Columns n_lines and n_removed of ``docs`` are replaced, any others pass, whatever their names.
    """
    docs = docs.drop("n_lines", "n_removed")
    n = F.col("n")
    halves = F.array(*[F.xxhash64(F.lit(side), m, F.substr("line", F.lit(1), h) if side == 0 else F.substr("line", n - h + 1, h)) for m in (n, n - 1) for h in (F.floor(m / 2).cast("int"),) for side in (0, 1)])
    lines = _lines(docs, min_chars, exact_chars)
    distinct = lines.withColumn("halves", halves).groupBy("h1", "h2")
    distinct = staged(distinct.agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "no")).alias("first"), F.any_value("halves").alias("halves"), *([] if exact_chars is None else [F.any_value("n").alias("n")])), "lines")
    near = near_lines(docs, distinct if exact_chars is None else distinct.filter(n >= min_chars), min_chars).withColumn("near", F.lit(True))
    verdict = distinct.filter("times > 1").select("h1", "h2", "first").join(near, ["h1", "h2"], "full")
    verdict = staged(verdict, "line-verdicts")
    gone = lines.select("doc_id", "row", "no", "h1", "h2").join(probe(verdict), ["h1", "h2"])
    gone = gone.filter(F.coalesce("near", F.lit(False)) | (F.struct("doc_id", "no") > F.col("first")))
    whose, which, places = spare(docs, "_id", "_row", "_gone")
    gone = gone.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("no")).alias(places))
    gone = gone.withColumnsRenamed({"doc_id": whose, "row": which})
    out = docs.join(gone, (F.col("doc_id") == F.col(whose)) & (F.xxhash64("text") == F.col(which)), "left")
    all_lines = F.split("text", "\n", -1)
    bounds = F.concat(F.array(F.lit(-1)), places, F.array(F.size(all_lines)))
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size(places) + 1), lambda k: F.slice(all_lines, F.element_at(bounds, k) + 2, F.element_at(bounds, k + 1) - F.element_at(bounds, k) - 1)))
    text = F.when(F.col(places).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    lines_in = F.when(F.col("text").isNull(), 0).otherwise(F.size(all_lines))
    return out.select(*columns, lines_in.alias("n_lines"), F.coalesce(F.array_size(places), F.lit(0)).alias("n_removed"))


_SQL = f"""
WITH rows_ AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(range(len(ls))) AS no, unnest(ls) AS line FROM rows_ WHERE doc_id IS NOT NULL),
part AS (SELECT * FROM lines WHERE length(line) >= {MIN_CHARS}),
firsts AS (SELECT line, length(line) AS n, min((doc_id, no)) AS f FROM part GROUP BY line),
cuts AS (SELECT line, n, f, unnest([n, n - 1]) AS m FROM firsts),
halves AS (SELECT *, left(line, m // 2) AS h, 0 AS side FROM cuts UNION ALL SELECT *, right(line, m // 2), 1 FROM cuts),
pairs AS (SELECT DISTINCT a.line AS a, b.line AS b, a.n AS an, b.n AS bn
  FROM halves a JOIN halves b ON a.side = b.side AND a.m = b.m AND a.h = b.h AND b.f < a.f),
near AS (SELECT DISTINCT a FROM pairs WHERE CASE
    WHEN an = bn THEN len(list_filter(range(1, an + 1), lambda i: left(a, i - 1) = left(b, i - 1) AND substr(a, i + 1) = substr(b, i + 1))) > 0
    WHEN an = bn + 1 THEN len(list_filter(range(1, an + 1), lambda i: left(a, i - 1) || substr(a, i + 1) = b)) > 0
    WHEN bn = an + 1 THEN len(list_filter(range(1, bn + 1), lambda i: left(b, i - 1) || substr(b, i + 1) = a)) > 0
    ELSE FALSE END),
gone AS (SELECT p.doc_id, p.no FROM part p JOIN firsts s ON p.line = s.line LEFT JOIN near ON near.a = p.line
  WHERE near.a IS NOT NULL OR (p.doc_id, p.no) > s.f),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS text FROM lines l WHERE NOT EXISTS
  (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.no = l.no) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT r.doc_id, CASE WHEN r.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  CAST(coalesce(len(ls), 0) AS INTEGER) AS n_lines, CAST(coalesce(lost.n, 0) AS INTEGER) AS n_removed
FROM rows_ r LEFT JOIN kept k USING (doc_id) LEFT JOIN lost USING (doc_id)"""


@op("op2_line_dedup", _SQL)
def op2_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
