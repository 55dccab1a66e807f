"""WARC fixity audit with Merkle trees, with DataFrame functions only.

Every page is a WARC response record; its leaf is the SHA-256 of the record's bytes. Records are ordered by page_id, files
hold the records of ``FILE`` consecutive ids, and ``FAN`` consecutive ids, ranges of ranges and so on are the tree's nodes, each
the hash of what it holds. As ranges lie on a fixed grid of the ids, a lost record changes its own branch only.

Two replicas are compared from the roots down: at each level only nodes below a mismatching one are joined, so that the work below the
top follows the damage. Records found to differ are reported with their byte offsets, which are worked out in
the files that hold them alone.

A node's hash is taken over order-free sums of its children's hashes, beside their number, so it is aggregated map-side and
no range, whatever repeats in it, is collected.

Defined results. Null urls and htmls are empty. Rows without page_id are records of the id -1 (one range, summed like any other).
Rows that repeat a page_id are one leaf, with their number. Empty replicas are equal to each other. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, cut, table

FAN = 16
FILE = 1024
_PARTS = 4  # of 60 bits each
_P = (1 << 61) - 1


def record(page: str = "page_id", url: str = "url", html: str = "html") -> Column:
    """The text of a page's WARC record."""
    body = F.coalesce(F.col(html), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("-1")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col(url), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def _words(hex_digest: Column) -> list[Column]:
    """A digest's first 240 bits as four numbers."""
    return [F.conv(F.substring(hex_digest, 1 + 15 * i, 15), 16, 10).cast("long") for i in range(_PARTS)]


def _folded(n: str) -> list[Column]:
    """Sums of the digests' numbers, wide enough for any count."""
    return [F.sum(F.col(f"w{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(_PARTS)] + [F.sum(n).alias("n")]


def _hashed(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n and the digest of (n, sums)."""
    digest = F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(_PARTS)]), 256)
    return rows.select(*keys, "n", digest.alias("digest"))


def tree(pages: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The levels of a replica's tree from the records (at, n, digest, length, sha256) up to one root (at, n, digest)."""
    text = record()
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(-1)).alias("at"), F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("length"))
    rows = rows.withColumns({f"w{i}": w for i, w in enumerate(_words(F.col("sha256")))}).withColumn("one", F.lit(1))
    rows = rows.groupBy("at").agg(*_folded("one"), F.sum("length").alias("length"), F.min("sha256").alias("sha256"))
    levels = [scratch.keep(_hashed(rows, "at", "length", "sha256"))]
    while True:
        below = levels[-1].select(F.floor(F.col("at") / FAN).alias("up"), "n", F.sha2(F.concat_ws(":", F.col("at").cast("string"), "digest"), 256).alias("d"))
        below = below.withColumns({f"w{i}": w for i, w in enumerate(_words(F.col("d")))}).withColumnRenamed("up", "at")
        levels.append(scratch.keep(_hashed(below.groupBy("at").agg(*_folded("n")), "at")))
        # ids are at least -1: at the top the range of -1 and that of 0 remain
        if levels[-1].where("at not in (-1, 0)").isEmpty():
            return levels


def audit(expected: DataFrame, found: DataFrame) -> DataFrame:
    """The records in which two replicas differ: page_id, kind, file, the first replica's offset and length, and both sides' numbers and hashes."""
    spark = expected.sparkSession
    with Scratch(spark) as scratch:
        left, right = tree(expected, scratch), tree(found, scratch)
        while len(left) < len(right):
            left.append(_raise(left[-1]))
        while len(right) < len(left):
            right.append(_raise(right[-1]))

        def differing(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.select("at", F.struct("n", "digest").alias("a")).join(b.select("at", F.struct("n", "digest").alias("b")), "at", "full_outer")
            return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("at")

        bad = cut(differing(left[-1], right[-1]))
        for a, b in zip(left[-2::-1], right[-2::-1], strict=True):
            inside = lambda rows: rows.join(bad.withColumnRenamed("at", "up"), F.floor(F.col("at") / FAN) == F.col("up"), "left_semi")  # noqa: B023, E731
            bad = cut(differing(inside(a), inside(b)))
        files = bad.select(F.floor(F.col("at") / FILE).alias("file")).distinct()
        placed = left[0].withColumn("file", F.floor(F.col("at") / FILE)).join(files, "file", "left_semi")
        placed = placed.withColumn("offset", F.sum("length").over(W.partitionBy("file").orderBy("at")) - F.col("length"))
        rows = bad.join(placed, "at", "left").join(right[0].select("at", F.col("n").alias("m"), F.col("sha256").alias("other")), "at", "left")
        kind = F.when(F.col("m").isNull(), "missing").when(F.col("n").isNull(), "extra").when(F.col("n") != F.col("m"), "repeated").otherwise("changed")
        result = rows.select(
            F.when(F.col("at") >= 0, F.col("at")).alias("page_id"), kind.alias("kind"), F.floor(F.col("at") / FILE).alias("file"), "offset", "length",
            F.coalesce("n", F.lit(0)).cast("long").alias("n_expected"), F.coalesce("m", F.lit(0)).cast("long").alias("n_found"), F.col("sha256").alias("sha256_expected"), F.col("other").alias("sha256_found"),
        )
        result = cut(result)
    return result


def _raise(level: DataFrame) -> DataFrame:
    """One more level over a root, for a replica whose tree is lower."""
    below = level.select(F.floor(F.col("at") / FAN).alias("at"), "n", F.sha2(F.concat_ws(":", F.col("at").cast("string"), "digest"), 256).alias("d"))
    below = below.withColumns({f"w{i}": w for i, w in enumerate(_words(F.col("d")))})
    return _hashed(below.groupBy("at").agg(*_folded("n")), "at")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage: some pages changed, some lost, some there twice."""
    html = F.when(F.col("page_id") % 211 == 17, F.concat(F.coalesce("html", F.lit("")), F.lit("!"))).otherwise(F.col("html"))
    rows = pages.select("page_id", "url", html.alias("html")).where("page_id is null or page_id % 499 <> 7")
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), F.when(F.col("page_id") % 997 == 5, 2).otherwise(1)))).drop("times")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all pages against a replica with known damage."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged(pages))


ORACLE_SQL = r"""
with r as (select page_id, url, coalesce(html, '') as html, page_id // 1024 as file from pages),
t as (select *, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' as head, chr(13) || chr(10) || chr(13) || chr(10) as nl from r),
x as (select *, head || strlen(html) || nl || html || nl as good, head || (strlen(html) + 1) || nl || html || '!' || nl as bad from t),
o as (select *, strlen(good)::bigint as length, (sum(strlen(good)) over (partition by file order by page_id))::bigint - strlen(good)::bigint as "offset" from x)
select page_id, case when page_id % 499 = 7 then 'missing' when page_id % 997 = 5 then 'repeated' else 'changed' end as kind, file, "offset", length, 1::bigint as n_expected,
  case when page_id % 499 = 7 then 0 when page_id % 997 = 5 then 2 else 1 end::bigint as n_found, sha256(good) as sha256_expected,
  case when page_id % 499 = 7 then null when page_id % 211 = 17 then sha256(bad) else sha256(good) end as sha256_found
from o where page_id % 211 = 17 or page_id % 499 = 7 or page_id % 997 = 5
"""
