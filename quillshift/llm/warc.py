"""WARC archives and their capture index.

Records are assembled from built-in functions and written by Spark's text sink, whose line
separator is the record terminator; nothing touches a machine-local folder and a lost task is
simply written again.  Read back, each file gives a locally sorted run of index entries; runs are
cut by range, keep their order (an external sort by run and place brings each together), and are
merged in each range by a loser tree over (URL key, timestamp).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillshift.llm.common import checkpointed, shared_dir, table

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
INDEX_SCHEMA = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "url_key string, captured_at string, file string, offset long, length long, place long"
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 5 hex digits are 4 characters."""
    hexed = F.sha1(payload)
    chars = []
    for i in range(0, 40, 5):
        v = F.conv(F.substring(hexed, i + 1, 5), 16, 10).cast("int")
        chars += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*chars)


def url_key(url: str | None) -> str:
    """Sort-friendly key of a URL: reversed host, then path and query."""
    if not url:
        return ""
    rest = url.split("#", 1)[0].strip()
    rest = rest.split("://", 1)[1] if "://" in rest else rest
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:] or "/"
    host, _, port = host.partition(":")
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    path, q, query = path.partition("?")
    query = "&".join(sorted(query.split("&")))
    return f"{host}{':' + port if port not in ('', '80', '443') else ''}){(path or '/').lower()}{q}{query}"


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    captured: str = "timestamp_seconds(1704067200L + coalesce({id}, 0L))",
    min_revisit_bytes: int = 0,
    records_per_file: int = 4096,
    bytes_per_file: int = 32 << 20,
    broadcast_rows: int = 500_000,
) -> None:
    """Write a record for each row of ``pages``.

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes the one with the
    smallest id is a response, the others are revisits that refer to it and carry no payload;
    shorter ones are all responses.  Null html is an empty payload, a null url an empty target.
    Of repeated rows (same id and payload) one is the response.  Rows without an id are
    responses unless their payload has an id elsewhere, which they then revisit.  An empty table
    gives archives without records; other columns are ignored; pages of any length are whole.

    Payloads stay in their partition: only digests are shuffled.  The table of revisits is
    broadcast when it has at most ``broadcast_rows`` rows (some 60 MB) and joined by shuffle beyond.
    A file holds ``records_per_file`` records at most, fewer where ``bytes_per_file`` of the mean
    size are less.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.select("*", F.sha2("html", 256).alias("same"))
    ids = rows.select("page_id", "same", F.octet_length("html").alias("n"))
    each = checkpointed(ids.groupBy("page_id", "same", "n").agg(F.count(F.lit(1)).alias("repeats")))
    first = each.groupBy("same").agg(F.min("page_id").alias("first_id"))
    special = checkpointed(
        each.join(first, "same")
        .filter((F.col("n") >= min_revisit_bytes) & (~F.col("page_id").eqNullSafe(F.col("first_id")) | (F.col("repeats") > 1)))
        .select(F.col("page_id").alias("s_id"), F.col("same").alias("s_same"), "first_id", "repeats")
    )
    total, twice = special.agg(F.count(F.lit(1)), F.max("repeats")).first()
    hint = F.broadcast if total <= broadcast_rows else (lambda d: d)
    mean = each.agg(F.sum(F.col("n") * F.col("repeats")) / F.sum("repeats")).first()[0] or 0
    records_per_file = max(1, min(records_per_file, int(bytes_per_file / (mean + 1024))))
    match = F.col("page_id").eqNullSafe(F.col("s_id")) & (F.col("same") == F.col("s_same"))
    said = rows.join(hint(special), match, "left")
    if (twice or 1) > 1:
        # one of the repeats is the response; the salt in the order is free, the rows are alike
        again = F.col("repeats") > 1
        w = Window.partitionBy("page_id", "same").orderBy(F.lit(0))
        own = F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("nth") == 1)
        said = (
            said.filter(F.coalesce(~again, F.lit(True))).withColumn("nth", F.lit(1)).withColumn("revisit", F.col("first_id").isNotNull())
            .unionByName(said.filter(again).withColumn("nth", F.row_number().over(w)).withColumn("revisit", ~own & F.col("first_id").isNotNull()))
        )
    else:
        said = said.withColumn("nth", F.lit(1)).withColumn("revisit", F.col("first_id").isNotNull())

    def urn(page: Column, nth: Column) -> Column:
        """The record's name: from its page, its payload, and which of repeated rows it is."""
        digest = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("null")), "same", nth.cast("string")))
        return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))

    def number(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("null"))

    stamp = F.date_format(F.expr(captured.format(id="page_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"), F.col("nth"))),
        F.concat(F.lit("WARC-Date: "), stamp),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]+", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.col("html"))),
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first_id"), F.lit(1)))),
        # extension fields: the ids of the table
        F.concat(F.lit("X-Page-ID: "), number(F.col("page_id"))),
        F.when(F.col("revisit"), F.concat(F.lit("X-Refers-To-Page-ID: "), number(F.col("first_id")))),
        F.lit("Content-Type: application/http; msgtype=response"),
    ]
    http = F.concat(F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])), F.octet_length("html").cast("string"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))
    length = F.octet_length(http) + F.when(F.col("revisit"), F.lit(0)).otherwise(F.octet_length("html"))
    head = F.concat_ws(CRLF, *lines, F.concat(F.lit("Content-Length: "), length.cast("string")))
    record = F.concat(head, F.lit(CRLF * 2), block)
    said.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file).text(path)


def parse_warc(data: bytes, file: str) -> Iterator[dict]:
    """Index entries of an archive, in file order; digests are computed from the payload read."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        head = data[at:head_end].decode("utf-8", "replace").split(CRLF)
        field = dict(x.split(": ", 1) for x in head[1:] if ": " in x)
        n = int(field["Content-Length"])
        body = data[head_end + 4 : head_end + 4 + n]
        end = head_end + 4 + n + 4
        if data[end - 4 : end] != b"\r\n\r\n" or not head[0].startswith("WARC/"):
            raise ValueError(f"{file}: no record at {at}")
        kind, said = field["WARC-Type"], field["WARC-Payload-Digest"].removeprefix("sha1:")
        http_end = body.index(b"\r\n\r\n") + 4
        http = dict(x.split(": ", 1) for x in body[:http_end].decode("latin-1").split(CRLF) if ": " in x)
        size = int(http["Content-Length"])
        if kind == "response":
            digest = base64.b32encode(hashlib.sha1(body[http_end:]).digest()).decode()
            if digest != said or n - http_end != size:
                raise ValueError(f"{file}: the payload at {at} is damaged")

        def row_id(name: str) -> int | None:
            value = field.get(name, "null")
            return None if value == "null" else int(value)

        yield {
            "page_id": row_id("X-Page-ID"), "payload_bytes": size, "payload_digest": said, "record_type": kind,
            "refers_to": row_id("X-Refers-To-Page-ID"), "url_key": url_key(field.get("WARC-Target-URI")), "captured_at": field["WARC-Date"],
            "file": file, "offset": at, "length": end - at,
        }
        at = end


def _sort_key(row: tuple) -> tuple:
    page, url, when, file, offset = row[0], row[5], row[6], row[7], row[8]
    return url, when, -(1 << 63) if page is None else page, file, offset


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            run = sorted((tuple(x.values()) for x in parse_warc(bytes(content), path.rsplit("/", 1)[-1])), key=_sort_key)
            if run:
                out = pd.DataFrame(run, columns=[x.split()[0] for x in INDEX_SCHEMA.split(", ")][:-1])
                out["place"] = range(len(out))
                for c in ("page_id", "refers_to"):
                    out[c] = out[c].astype("Int64")
                yield out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives under ``path``; each file is one locally sorted run.

    ``place`` is the entry's place in its run.  Archives without records give no entries; a damaged
    record is an error.
    """
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_entries, INDEX_SCHEMA)


class LoserTree:
    """Merge k sorted iterators; each step replays one leaf-to-root path of losers."""

    def __init__(self, runs: list[Iterator], key) -> None:
        self.runs, self.key, self.k = [iter(r) for r in runs], key, len(runs)
        self.head = [self._next(i) for i in range(self.k)]
        self.loser = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf)

    def _next(self, i: int):
        for x in self.runs[i]:
            return (0, self.key(x), i), x
        return (1, (), i), None

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.loser[node]
            if other < 0:
                # the first to come waits here for the other half of the subtree
                self.loser[node] = winner
                return
            if self.head[other][0] < self.head[winner][0]:
                self.loser[node], winner = winner, other
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator:
        if not self.k:
            return
        while True:
            i = self.loser[0]
            tag, item = self.head[i]
            if tag[0]:
                return
            yield item
            self.head[i] = self._next(i)
            self._play(i)


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge a range's runs, which come one after the other and in their own order."""
    runs: list[list[tuple]] = []
    names: list[str] = []
    last = None
    for pdf in batches:
        names = list(pdf.columns)
        cols = [pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in names]
        for row in zip(*cols, strict=True):
            if row[7] != last:
                runs.append([])
                last = row[7]
            runs[-1].append(row)
    out: list[tuple] = []

    def frame() -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=names)
        for c in ("page_id", "refers_to", "payload_bytes", "offset", "length", "place"):
            pdf[c] = pdf[c].astype("Int64")
        out.clear()
        return pdf

    for row in LoserTree(runs, _sort_key):
        out.append(row)
        if len(out) == 8192:
            yield frame()
    if out:
        yield frame()


def merge_index(entries: DataFrame, rows_per_partition: int = 50_000) -> DataFrame:
    """The entries in global order of (URL key, timestamp, page, file, offset): partition by partition.

    Range bounds include the place of the record, so one URL that holds a third of all captures
    is split; a task merges about ``rows_per_partition`` entries and no payload.  Within a range
    Spark's external sort lines runs up by file and place; no run is sorted again.  An empty table
    gives an empty table.
    """
    held = checkpointed(entries)
    n = max(1, -(-held.count() // rows_per_partition), int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    dealt = held.repartitionByRange(n, "url_key", "captured_at", "page_id", "file", "offset")
    return dealt.sortWithinPartitions("file", "place").mapInPandas(_merge, INDEX_SCHEMA)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written to archives, read back, and their captures in the order of the merged index."""
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    return merge_index(read_warc(spark, path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at"
    )


OP9_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS x
  FROM pages
),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, n AS payload_bytes,
       list_aggregate(list_transform(range(0, 40, 5), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(x, CAST(i + 1 AS INT), 5) AS INT) >> 15) % 32 + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(x, CAST(i + 1 AS INT), 5) AS INT) >> 10) % 32 + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(x, CAST(i + 1 AS INT), 5) AS INT) >> 5) % 32 + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST('0x' || substr(x, CAST(i + 1 AS INT), 5) AS INT) % 32 + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to,
       {key} AS url_key,
       strftime(to_timestamp(1704067200 + page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured_at
FROM q
"""
#: The key in SQL: reversed host, lower-case path, sorted query.
_BARE = "regexp_replace(regexp_replace(coalesce(url, ''), '#.*$', ''), '^.*?://', '')"
_HOST = f"regexp_extract({_BARE}, '^[^/?]*')"
_PATH = f"coalesce(nullif(regexp_extract({_BARE}, '^[^/?]*([^?]*)', 1), ''), '/')"
_QUERY = f"regexp_extract({_BARE}, '\\?(.*)$', 1)"
OP9_SQL = OP9_SQL.format(
    key=f"CASE WHEN coalesce(url, '') = '' THEN '' ELSE array_to_string(list_reverse(string_split(regexp_replace(lower({_HOST}), '^www\\.', ''), '.')), ',') || ')' || lower({_PATH}) "
    f"|| CASE WHEN contains({_BARE}, '?') THEN '?' || array_to_string(list_sort(string_split({_QUERY}, '&')), '&') ELSE '' END END"
)
