"""Resolution of not-modified revisit records: an as-of join by canonical URL.

A revisit record belongs to the latest earlier full response of its canonical URL. Where their
validators agree, it gets the response's body and the response's headers, with those that a
not-modified answer may update taken from the revisit.

Records are put in the order of URL, time and id and cut by ranges into blocks of about ``BLOCK``
rows, so a URL that holds much of the input is many blocks, whatever its times are. Only the last
response of each block is looked at across blocks. Bodies move once, those of responses that answer.

Defined edge cases: a record without URL or time finds no response; of records at one time, those
with smaller ids are earlier; validators agree if every one of entity tag (weak or strong, as a
conditional request compares them) and modification date that both records have is equal, and at
least one is there on both sides; a kind other than ``response`` is a revisit; of responses that share
an id the latest answers, of those at one time that with the largest body; an empty table gives no
row; other columns pass through, whatever their names, but for those named like the new ones, which
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import quoted
from .shared import written

# Headers that a not-modified answer may update, lower case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Records a block, about.
BLOCK = 50_000
#: The columns that are read, and those that are added.
READ = ("record_id", "kind", "url", "at", "etag", "modified", "headers", "body")
ADDED = ("canonical", "outcome", "response_id")


def canonical_url(url: Column) -> Column:
    """Host in lower case without www., m. and default port; no scheme, fragment, tracking parameters or closing slash."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, "^([^/?]*)", 1)
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^([^?]*)", 1), "/+$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, "\\?(.*)$", 1), "(^|&)(utm_[^&=]*|ref)=[^&]*", ""), "^&", "")
    name = F.regexp_replace(F.regexp_replace(F.lower(host), "^(www|m)\\.", ""), ":(80|443)$", "")
    return F.concat(name, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def strong(tag: Column) -> Column:
    """An entity tag as weak comparison sees it."""
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """``records`` with ``canonical``, ``outcome``, ``response_id``, ``body`` and ``headers`` as resolved.

    ``records``: record_id, kind (``response`` or ``revisit``), url, at (a number), etag, modified,
    headers (map, lower-case names), body. Outcomes: ``response``, ``resolved``, ``mismatch``, ``missing``.
    """
    # other columns go by place
    others = [c for c in records.columns if c.lower() not in (*READ, *ADDED)]
    names = {f"__wr_x{i}": c for i, c in enumerate(others)}
    records = records.select(*READ, *[F.col(q).alias(x) for q, x in zip(quoted(others), names, strict=True)])
    answers = F.coalesce(F.col("kind") == "response", F.lit(False))
    records = records.withColumn("canonical", canonical_url(F.col("url")))
    slim = records.select("record_id", answers.alias("full"), "canonical", F.col("at").cast("double").alias("at")).where("canonical is not null and at is not null")
    blocks = max(1, -(-slim.count() // BLOCK))
    # written, so that a record's block is the same wherever it is read
    slim = written(slim.repartitionByRange(blocks, "canonical", "at", "record_id").withColumn("block", F.spark_partition_id()), "records")
    # the last response of each block, and of all blocks before it: few rows a URL
    last = F.max(F.when(F.col("full"), F.struct("at", "record_id")))
    before = Window.partitionBy("canonical").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = slim.groupBy("canonical", "block").agg(last.alias("last")).select("canonical", "block", F.max("last").over(before).alias("carried"))
    within = Window.partitionBy("canonical", "block").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = slim.withColumn("own", F.last(F.when(F.col("full"), F.struct("at", "record_id")), ignorenulls=True).over(within)).where("not full")
    found = seen.join(ends, ["canonical", "block"]).select("record_id", "canonical", "at", F.coalesce("own", "carried")["record_id"].alias("response_id"))
    found = written(found.where("response_id is not null").distinct(), "revisits")
    # one row of each response that answers; bodies are moved by one plan at every size
    whole = records.where(answers).select(F.col("record_id").alias("response_id"), F.col("at").alias("__wr_at"), F.col("etag").alias("__wr_etag"), F.col("modified").alias("__wr_modified"), F.col("headers").alias("__wr_headers"), F.col("body").alias("__wr_body"))
    whole = whole.join(found.select("response_id").distinct(), "response_id", "left_semi")
    best = Window.partitionBy("response_id").orderBy(F.desc("__wr_at"), F.desc("__wr_body"), "__wr_etag", "__wr_modified")
    whole = whole.withColumn("__wr_n", F.row_number().over(best)).where("__wr_n = 1").drop("__wr_n", "__wr_at")
    answered = records.where(answers).withColumns({"response_id": F.lit(None).cast(records.schema["record_id"].dataType), "outcome": F.lit("response")})
    # rows that share an id and differ in URL or time find their own
    asked = records.where(~answers).withColumn("__wr_at", F.col("at").cast("double"))
    joined = asked.join(found.toDF("__wr_id", "__wr_url", "__wr_when", "response_id"), (F.col("record_id") == F.col("__wr_id")) & (F.col("canonical") == F.col("__wr_url")) & (F.col("__wr_at") == F.col("__wr_when")), "left")
    joined = joined.drop("__wr_at", "__wr_id", "__wr_url", "__wr_when").join(whole.hint("merge"), "response_id", "left")
    pairs = ((strong(F.col("etag")), strong(F.col("__wr_etag"))), (F.col("modified"), F.col("__wr_modified")))
    both = [a.isNotNull() & b.isNotNull() for a, b in pairs]
    agrees = (both[0] | both[1]) & F.coalesce(pairs[0][0] == pairs[0][1], F.lit(True)) & F.coalesce(pairs[1][0] == pairs[1][1], F.lit(True))
    joined = joined.withColumn("outcome", F.when(F.col("response_id").isNull(), "missing").when(agrees, "resolved").otherwise("mismatch"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    update = F.map_filter(F.coalesce("headers", none), lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(F.coalesce("__wr_headers", none), lambda k, _: ~F.array_contains(F.map_keys(update), k))
    resolved = F.col("outcome") == "resolved"
    out = joined.withColumns({"headers": F.when(resolved, F.map_concat(kept, update)).otherwise(F.col("headers")), "body": F.when(resolved, F.col("__wr_body")).otherwise(F.col("body"))})
    out = out.drop("__wr_etag", "__wr_modified", "__wr_headers", "__wr_body").unionByName(answered)
    return out.select(*READ, *ADDED, *[F.col(x).alias(c) for x, c in names.items()])


def header_lines(headers: Column) -> Column:
    """``name: value`` lines in the order of names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def captures(pages: DataFrame) -> DataFrame:
    """Records made of a table of pages: each is fetched in the order of page_id, and found not modified later.

    A page's first revisit is up to 49 pages later, with the page's own entity tag (strong or weak),
    date, or both: it finds the page itself, or a later response of the same canonical URL and then
    disagrees. A seventh of the pages are also asked for before any response, and an eleventh
    without a validator.
    """
    page, tag, number = F.col("page_id"), F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.col("page_id").cast("string")
    none = F.lit(None).cast("string")
    length = F.octet_length("html").cast("string")
    headers = F.create_map(F.lit("content-length"), length, F.lit("content-type"), F.lit("text/html"), F.lit("date"), number, F.lit("etag"), tag)
    response = pages.select(
        (4 * page).alias("record_id"), F.lit("response").alias("kind"), "url", (4 * page).alias("at"),
        tag.alias("etag"), number.alias("modified"), headers.alias("headers"), F.col("html").alias("body"),
    )

    def revisit(rows: DataFrame, place: int, at: Column, etag: Column, modified: Column) -> DataFrame:
        update = F.create_map(F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.lit("0"), F.lit("date"), at.cast("string"), F.lit("set-cookie"), F.lit("id"))
        return rows.select((4 * page + place).alias("record_id"), F.lit("revisit").alias("kind"), "url", at.alias("at"), etag.alias("etag"), modified.alias("modified"), update.alias("headers"), none.alias("body"))

    kind = page % 4
    first = revisit(pages, 1, 4 * page + 4 * (page % 50) + 1, F.when(kind == 0, tag).when(kind == 1, F.concat(F.lit("W/"), tag)).when(kind == 2, tag), F.when(kind >= 2, number))
    early = revisit(pages.where(page % 7 == 0), 2, -page - 1, tag, none)
    bare = revisit(pages.where(page % 11 == 0), 3, 4 * page + 2, none, none)
    return response.unionByName(first).unionByName(early).unionByName(bare)


ORACLE = r"""
WITH named AS (
  SELECT page_id, '"' || md5(html) || '"' AS tag, html, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages
), cut AS (
  SELECT *, lower(regexp_extract(bare, '^([^/?]*)', 1)) AS host, regexp_replace(bare, '^[^/?]*', '') AS rest FROM named
), canon AS (
  SELECT *, regexp_replace(regexp_replace(regexp_extract(rest, '\?(.*)$', 1), '(^|&)(utm_[^&=]*|ref)=[^&]*', '', 'g'), '^&', '') AS query FROM cut
), p AS (
  SELECT page_id, tag, html, regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical FROM canon
), responses AS (
  SELECT 4 * page_id AS record_id, canonical, 4 * page_id AS stamp, tag, CAST(page_id AS VARCHAR) AS modified, html FROM p
), revisits AS (
  SELECT 4 * page_id + 1 AS record_id, canonical, 4 * page_id + 4 * (page_id % 50) + 1 AS stamp, CASE page_id % 4 WHEN 0 THEN tag WHEN 1 THEN 'W/' || tag WHEN 2 THEN tag END AS tag,
    CASE WHEN page_id % 4 >= 2 THEN CAST(page_id AS VARCHAR) END AS modified FROM p
  UNION ALL SELECT 4 * page_id + 2, canonical, -page_id - 1, tag, NULL FROM p WHERE page_id % 7 = 0
  UNION ALL SELECT 4 * page_id + 3, canonical, 4 * page_id + 2, NULL, NULL FROM p WHERE page_id % 11 = 0
), found AS (
  SELECT v.*, f.record_id AS response_id, f.tag AS ftag, f.modified AS fmodified, f.html AS fhtml,
    CASE WHEN f.record_id IS NULL THEN 'missing'
      WHEN (v.tag IS NOT NULL OR v.modified IS NOT NULL) AND coalesce(regexp_replace(v.tag, '^W/', '') = f.tag, true) AND coalesce(v.modified = f.modified, true) THEN 'resolved'
      ELSE 'mismatch' END AS outcome
  FROM revisits v ASOF LEFT JOIN responses f ON v.canonical = f.canonical AND v.stamp > f.stamp
)
SELECT record_id, canonical, 'response' AS outcome, CAST(NULL AS BIGINT) AS response_id,
  'content-length: ' || strlen(html) || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || modified || chr(10) || 'etag: ' || tag AS headers,
  md5(html) AS body_md5, CAST(strlen(html) AS BIGINT) AS body_bytes
FROM responses
UNION ALL
SELECT record_id, canonical, outcome, response_id,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || strlen(fhtml) || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || stamp || chr(10) || 'etag: ' || ftag
    ELSE 'cache-control: max-age=60' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || stamp || chr(10) || 'set-cookie: id' END,
  CASE WHEN outcome = 'resolved' THEN md5(fhtml) END, CASE WHEN outcome = 'resolved' THEN CAST(strlen(fhtml) AS BIGINT) END
FROM found
"""
