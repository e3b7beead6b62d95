"""Merkle fixity audit of WARC archives.

Records lie in archives one after the other, each at an offset and with a length. The leaf of a record is the
SHA-256 of its offset, length and bytes. A node of the next level is the SHA-256 of FANOUT consecutive child hashes
and the offset range they cover; levels go on to one root an archive. Two replicas are compared from the roots down, and
of each level only the children of nodes that differ are compared. A leaf holds its offset, so one changed length makes every later leaf
of its archive differ: the descent then goes through all of these, and reports only records that have no equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read, small_side

FANOUT, RECORDS = 16, 4096  # children of a node; records of an archive
DATE = "2024-01-01T00:00:00Z"  # pages have none


def records(pages: DataFrame, per_archive: int = RECORDS) -> DataFrame:
    """(archive, page_id, body): a WARC resource record for each page that has a page_id, in archives of
    per_archive consecutive page_ids. Null url or html counts as empty. The record's UUID is the MD5 of page_id and url, its date DATE."""
    text, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    name = F.regexp_replace(F.md5(F.concat_ws("|", F.col("page_id").cast("string"), url).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), name, F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text).cast("string"), F.lit("\r\n\r\n"))
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.concat(head, text, F.lit("\r\n\r\n")).alias("body"))
    rows = rows.withColumn("archive", F.floor(F.col("page_id") / per_archive).cast("long"))
    return rows


def leaves(rows: DataFrame) -> DataFrame:
    """(archive, i, page_id, lo, hi, h, hash) of rows (archive, page_id, body). Bodies are hashed where they are read; only
    hashes and lengths are shuffled. Records are ordered by page_id, then by the hash of their body."""
    short = rows.select("archive", "page_id", F.sha2(F.col("body").cast("binary"), 256).alias("h"), F.octet_length("body").cast("long").alias("n"))
    order = Window.partitionBy("archive").orderBy("page_id", "h")
    hi = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = short.select("archive", (F.row_number().over(order) - 1).cast("long").alias("i"), "page_id", (hi - F.col("n")).alias("lo"), hi.alias("hi"), "h")
    return placed.select("archive", "i", "page_id", "lo", "hi", "h", F.sha2(F.concat_ws("|", "lo", "hi", "h").cast("binary"), 256).alias("hash"))


def parents(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    kids = F.array_sort(F.collect_list(F.struct("i", "hash")))
    made = level.groupBy("archive", F.floor(F.col("i") / fanout).cast("long").alias("i")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), kids.alias("k"))
    return made.select("archive", "i", "lo", "hi", F.sha2(F.concat_ws("|", "lo", "hi", F.expr("concat_ws('', transform(k, x -> x.hash))")).cast("binary"), 256).alias("hash"))


def tree(sc: Scratch, rows: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels, written, from leaves to roots. Their number is the logarithm of the longest archive."""
    levels = [sc.table(leaves(rows))]
    width = (levels[0].agg(F.max("i")).first()[0] or 0) + 1
    while width > 1:
        levels.append(sc.table(parents(levels[-1], fanout)))
        width = -(-width // fanout)
    return levels


KEY = ["archive", "i"]


def audit(spark: SparkSession, one: DataFrame, two: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(archive, page_id, offset, length, state) for each record of replica one or two that has no equal in the other.

    one, two: (archive, page_id, body). state is 'corrupt' (both replicas have the page_id, with different bytes), 'missing' (only one
    has it) or 'extra' (only two has it); offset and length are those in one, for extra ones those in two. Records that only moved because
    of a change of length before them are not reported. Of repeated records the surplus of either
    side is reported. Null bodies are an error of the caller (records() has none); very long ones are hashed whole where they are read, and only
    hashes are shuffled. Other columns are not read. An empty replica makes all records of the other missing or extra; two empty ones give an empty result.
    """
    with Scratch(spark) as sc:
        a, b = tree(sc, one, fanout), tree(sc, two, fanout)
        depth = max(len(a), len(b))
        for t in (a, b):  # the lower tree gets the levels that it lacks
            while len(t) < depth:
                t.append(sc.table(parents(t[-1], fanout)))
        bad = None
        for level in range(depth - 1, -1, -1):
            x, y = a[level], b[level]
            if bad is not None:
                near = small_side(bad.withColumnRenamed("i", "up"))
                x, y = (t.withColumn("up", F.floor(F.col("i") / fanout)).join(near, ["archive", "up"], "left_semi") for t in (x, y))
            if level:
                differ = x.select(*KEY, F.col("hash").alias("x")).join(y.select(*KEY, F.col("hash").alias("y")), KEY, "full").where("not (x <=> y)").select(*KEY)
                bad = sc.table(differ)
        return sc.result(_records(x, y))


def _unmatched(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
    """The records of x, as many of equal ones as y lacks, numbered within their page_id."""
    same = ["archive", "page_id", "h", "copy"]
    turn = F.row_number().over(Window.partitionBy("archive", "page_id", "h").orderBy("i"))
    rest = x.withColumn("copy", turn).join(y.withColumn("copy", turn).select(*same), same, "left_anti")
    n = F.row_number().over(Window.partitionBy("archive", "page_id").orderBy("h", "i"))
    return rest.select("archive", "page_id", n.alias("n"), F.struct("lo", "hi").alias(name))


def _records(x: DataFrame, y: DataFrame) -> DataFrame:
    """The leaves under differing nodes, compared by content."""
    both = _unmatched(x, y, "x").join(_unmatched(y, x, "y"), ["archive", "page_id", "n"], "full")
    at = F.coalesce("x", "y")
    state = F.when(F.col("x").isNull(), "extra").when(F.col("y").isNull(), "missing").otherwise("corrupt")
    return both.select("archive", "page_id", at["lo"].alias("offset"), (at["hi"] - at["lo"]).alias("length"), state.alias("state"))


def replica(pages: DataFrame) -> DataFrame:
    """A copy of pages with faults for an audit to find, chosen by the MD5 of page_id: a first character changed (00), a
    last character lost (01), a record lost (02), a record added to a page_id (03)."""
    mark = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    html = F.when(mark == "00", F.concat(F.lit("#"), F.expr("substr(html, 2)"))).when(mark == "01", F.expr("substr(html, 1, length(html) - 1)")).otherwise(F.col("html"))
    rows = pages.where(mark != "02").select("page_id", "url", html.alias("html"))
    return rows.unionByName(pages.where(mark == "03").select("page_id", "url", F.lit("added").alias("html")))


_CRLF = "chr(13) || chr(10)"
_UUID = "regexp_replace(md5(page_id || '|' || coalesce(url, '')), '^(.{8})(.{4})(.{4})(.{4})', '\\1-\\2-\\3-\\4-')"
_BODY = f"'WARC/1.1' || {_CRLF} || 'WARC-Type: resource' || {_CRLF} || 'WARC-Record-ID: <urn:uuid:' || {_UUID} || '>' || {_CRLF} || 'WARC-Date: {DATE}' || {_CRLF} || 'WARC-Target-URI: ' || coalesce(url, '') || {_CRLF} || 'Content-Type: text/html' || {_CRLF} || 'Content-Length: ' || strlen(coalesce(html, '')) || {_CRLF} || {_CRLF} || coalesce(html, '') || {_CRLF} || {_CRLF}"
_LAID = f"select page_id, h, n, sum(n) over (partition by page_id // {RECORDS} order by page_id, h rows between unbounded preceding and current row) - n lo, row_number() over (partition by page_id, h) c from (select page_id, sha256(body) h, strlen(body) n from (select page_id, {_BODY} body from %s where page_id is not null))"
SQL = f"""
with m as (select page_id, url, html, substr(md5(cast(page_id as varchar)), 1, 2) k from pages),
two as (select page_id, url, case k when '00' then '#' || substr(html, 2) when '01' then substr(html, 1, length(html) - 1) else html end html from m where k <> '02'
  union all select page_id, url, 'added' from m where k = '03'),
a as ({_LAID % "pages"}), b as ({_LAID % "two"}),
x as (select page_id, n, lo, row_number() over (partition by page_id order by h, c) r from a where not exists (select 1 from b where b.page_id = a.page_id and b.h = a.h and b.c = a.c)),
y as (select page_id, n, lo, row_number() over (partition by page_id order by h, c) r from b where not exists (select 1 from a where b.page_id = a.page_id and b.h = a.h and b.c = a.c))
select coalesce(x.page_id, y.page_id) // {RECORDS} archive, coalesce(x.page_id, y.page_id) page_id, cast(coalesce(x.lo, y.lo) as bigint) "offset", cast(coalesce(x.n, y.n) as bigint) length,
  case when x.page_id is null then 'extra' when y.page_id is null then 'missing' else 'corrupt' end state
from x full join y on x.page_id = y.page_id and x.r = y.r
"""


def op7_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return audit(spark, records(pages), records(replica(pages)))
