"""Merkle fixity audit of web-archive replicas.

Every record is serialised as a WARC response and hashed (SHA-256). Records are ordered by key: the
page id as 16 hexadecimal digits, then the record's own hash. Ranges of that order, by key prefix,
are the nodes of a tree; a node's hash covers its children's keys, hashes and bytes, and every node
stands for one contiguous byte range of the archive. Replicas compare roots and descend only into
nodes that differ, down to the records at fault.

Repeated records are counted before anything is shuffled, and a page id that very many different
records share fans out over their hashes, so no node ever gathers more than 65,536 children. Texts
are hashed where they are read: only hashes move.

Every level of both trees is written once, from the level below. The descent reads of each level the
children of open nodes only; what it keeps per level is in proportion to the faults.

Defined results: nulls in url or html count as empty; pages with a null id share the key ``null``;
repeated records count with their multiplicity; two empty replicas have equal roots and no faults;
only the id, url and html columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.llm.spans import prefix_sums
from factgraph.runtime import drop_materialised, materialise

#: Lengths of the key prefixes that are nodes, from the leaves to the root.
LEVELS = (20, 16, 14, 12, 10, 8, 4, 0)


def warc_record(url: Column, html: Column) -> Column:
    """One WARC/1.1 response record as text."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, key, sha256, n_bytes, n): the distinct records of a replica and how often each occurs."""
    one = pages.select(F.col(id_col).cast("long").alias("id"), warc_record(F.col(url_col), F.col(html_col)).alias("record"))
    one = one.select("id", F.coalesce(F.lpad(F.lower(F.hex("id")), 16, "0"), F.rpad(F.lit("null"), 16, "-")).alias("key"), F.sha2("record", 256).alias("sha256"), F.octet_length("record").cast("long").alias("n_bytes"))
    return one.groupBy("id", "key", "sha256", "n_bytes").agg(F.count(F.lit(1)).alias("n"))


def _fold(children: DataFrame, length: int) -> DataFrame:
    """Nodes one level up: the hash of the ordered children, their bytes and records."""
    listed = F.sort_array(F.collect_list(F.struct("node", "hash")))
    text = F.array_join(F.transform(listed, lambda c: F.concat_ws("=", c["node"], c["hash"])), "\n")
    return children.groupBy(F.substring("node", 1, length).alias("node")).agg(F.sha2(text, 256).alias("hash"), F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n"))


def tree(replica: DataFrame, levels: tuple[int, ...] = LEVELS) -> list[DataFrame]:
    """The tables of nodes, leaves first, root last, each in the shared folder and made from the one below."""
    items = replica.select(F.concat("key", "sha256").alias("node"), F.concat_ws("*", "sha256", F.col("n").cast("string")).alias("hash"), (F.col("n_bytes") * F.col("n")).alias("n_bytes"), "n")
    out = []
    for length in levels:
        out.append(materialise(_fold(out[-1] if out else items, length)))
    return out


def descend(one: list[DataFrame], two: list[DataFrame], levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """The leaves that differ, with their byte offset in replica one.

    From each level only the children of nodes that differ are taken, on both sides, before they are
    compared. A child's offset is its parent's plus the bytes of the siblings before it, so a
    parent's children (at most 65,536) suffice to find it.
    """
    spark = one[-1].sparkSession
    # The root's parent is a node that is always open.
    open_ = spark.range(1).select(F.lit("").alias("parent"), F.lit(0).cast("long").alias("base"))
    for depth in range(len(levels) - 1, -1, -1):
        length = levels[depth + 1] if depth + 1 < len(levels) else 0

        def side(nodes: DataFrame, length: int = length, open_: DataFrame = open_) -> DataFrame:
            return nodes.withColumn("parent", F.substring("node", 1, length)).join(open_, "parent")

        a = side(one[depth]).select("parent", "base", "node", F.col("hash").alias("ha"), F.lit(None).cast("string").alias("hb"), F.col("n_bytes").alias("ba"))
        b = side(two[depth]).select("parent", "base", "node", F.lit(None).cast("string").alias("ha"), F.col("hash").alias("hb"), F.lit(0).cast("long").alias("ba"))
        pairs = a.unionByName(b).groupBy("parent", "base", "node").agg(F.max("ha").alias("ha"), F.max("hb").alias("hb"), F.max("ba").alias("ba"))
        kids = F.array_sort(F.collect_list(F.struct("node", "ha", "hb", "ba")))
        family = pairs.groupBy("parent", "base").agg(kids.alias("kids")).where(F.exists("kids", lambda k: ~k["ha"].eqNullSafe(k["hb"])))
        before = prefix_sums(F.transform("kids", lambda k: k["ba"]))
        family = family.select("base", F.explode(F.arrays_zip("kids", before.alias("before"))).alias("kid"))
        open_ = family.where(~F.col("kid.kids.ha").eqNullSafe(F.col("kid.kids.hb"))).select(F.col("kid.kids.node").alias("parent"), (F.col("base") + F.col("kid.before")).alias("base"))
        open_ = materialise(open_)
        if open_.isEmpty():
            break
    return open_.select(F.col("parent").alias("node"), F.col("base").alias("byte_offset"))


def audit(one: DataFrame, two: DataFrame, **columns) -> DataFrame:
    """The records on which two replicas differ: id, hash, copies in each, and where its range begins in the first."""
    a, b = (materialise(records(x, **columns)) for x in (one, two))
    trees = tree(a), tree(b)
    bad = descend(*trees)
    drop_materialised(a.sparkSession, *trees[0], *trees[1])
    leaf = F.substring(F.concat("key", "sha256"), 1, LEVELS[0])
    sides = [x.select("id", "key", "sha256", "n_bytes", F.col("n").alias(name)).withColumn("node", leaf).join(bad, "node", "left_semi").drop("node") for x, name in ((a, "n_one"), (b, "n_two"))]
    faults = reduce(lambda x, y: x.join(y, ["key", "sha256", "n_bytes"], "full_outer"), [sides[0].withColumnRenamed("id", "ia"), sides[1].withColumnRenamed("id", "ib")])
    faults = faults.where(~F.col("n_one").eqNullSafe(F.col("n_two"))).withColumn("node", leaf).join(bad, "node")
    return faults.select(F.coalesce("ia", "ib").alias("id"), "sha256", "n_bytes", F.coalesce("n_one", F.lit(0)).alias("n_one"), F.coalesce("n_two", F.lit(0)).alias("n_two"), "byte_offset")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica as a failing disk might leave it, for trials: one character of some pages changed,
    some pages lost, some written twice; which ones follows from the page id alone."""
    middle = F.floor(F.length("html") / 2).cast("int")
    rotten = F.concat(F.substring(F.col("html"), F.lit(1), middle), F.lit("\x00"), F.substring(F.col("html"), middle + 2, F.length("html")))
    copies = F.when(F.pmod("page_id", F.lit(97)) == 11, 0).when(F.pmod("page_id", F.lit(89)) == 13, 2).otherwise(1)
    changed = pages.withColumn("html", F.when(F.pmod("page_id", F.lit(61)) == 7, rotten).otherwise(F.col("html")))
    return changed.withColumn("copy_", F.explode(F.array_repeat(F.lit(1), copies))).drop("copy_")


ORACLE_SQL = r"""
WITH one AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM pages
), two AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Length: ' || strlen(h) || chr(13) || chr(10) || chr(13) || chr(10) || h || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM (SELECT page_id, url, CASE WHEN page_id % 61 = 7 THEN substr(html, 1, length(html) // 2) || chr(0) || substr(html, length(html) // 2 + 2) ELSE html END AS h FROM pages)
), a AS (
  SELECT page_id, sha256(rec) AS sha256, strlen(rec)::BIGINT AS n_bytes, count(*) AS n_one FROM one GROUP BY ALL
), b AS (
  SELECT page_id, sha256(rec) AS sha256, strlen(rec)::BIGINT AS n_bytes, sum(CASE WHEN page_id % 97 = 11 THEN 0 WHEN page_id % 89 = 13 THEN 2 ELSE 1 END)::BIGINT AS n_two FROM two GROUP BY ALL
), o AS (
  SELECT page_id, coalesce(sum(w) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off, w
  FROM (SELECT page_id, sum(n_bytes * n_one) AS w FROM a GROUP BY page_id)
), f AS (
  SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.sha256, b.sha256) AS sha256, coalesce(a.n_bytes, b.n_bytes) AS n_bytes,
         coalesce(n_one, 0)::BIGINT AS n_one, coalesce(n_two, 0)::BIGINT AS n_two
  FROM a FULL OUTER JOIN b ON a.page_id = b.page_id AND a.sha256 = b.sha256 AND a.n_bytes = b.n_bytes
)
SELECT f.page_id, f.sha256, f.n_bytes, f.n_one, f.n_two,
       (o.off + CASE WHEN f.n_one = 0 AND f.n_two > 0 AND f.sha256 > a.sha256 THEN o.w ELSE 0 END)::BIGINT AS byte_offset
FROM f JOIN o ON f.page_id = o.page_id JOIN a ON a.page_id = f.page_id WHERE f.n_one <> f.n_two
"""
