"""URL filters by dated lists: entries become validity intervals, captures meet those active at fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The host of an address, without user and port; one in brackets (IPv6) is taken whole.
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#\[]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case, without the trailing dot of a full name; null for a null address, empty for one without a host."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, value, list_name, effect, spans) from entries (list_name, effect, kind, value, action, effective).

    One change a day and entry stands: 'remove' wins over 'add' on the same day. spans holds (valid_from, valid_to),
    valid_to exclusive and null while open; its length is bounded by the distinct days of one entry. Rows with a null
    in kind, value, list_name or effective are no entries."""
    daily = (
        entries.where("kind is not null and value is not null and list_name is not null and effective is not null")
        .groupBy("list_name", "effect", "kind", F.lower("value").alias("value"), F.col("effective").cast("date").alias("day"))
        .agg(F.max("action").alias("action"))
    )
    changes = daily.groupBy("list_name", "effect", "kind", "value").agg(F.array_sort(F.collect_list(F.struct("day", "action"))).alias("c"))
    spans = F.transform("c", lambda x, i: F.struct(x["day"].alias("valid_from"), F.get("c", i + 1)["day"].alias("valid_to"), x["action"].alias("action")))
    return changes.select("list_name", "effect", "kind", "value", F.filter(spans, lambda s: s["action"] == "add").alias("spans"))


def candidate_keys(url: Column) -> Column:
    """Array of (kind, value) a URL can be listed under: its host, each parent domain, each path prefix by segment."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    segments = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")
    paths = F.transform(
        F.when(F.size(segments) > 0, F.sequence(F.lit(1), F.size(segments))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit("path").alias("kind"), F.lower(F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/"))).alias("value")),
    )
    return F.concat(F.array(F.struct(F.lit("host").alias("kind"), host.alias("value"))), domains, paths)


def filter_captures(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with list_hits (sorted, comma-joined names of lists active for the URL on the fetch date), blocked, in place of columns so named.

    A capture is blocked when a list of effect 'block' is active and none of effect 'allow'. Every row of captures comes
    back once, repeated rows too; a null or unparsable URL or a null fetch date is on no list. Verdicts are made once for each distinct
    (URL, date); as the entry side has one row a key, no join fans out, and a hot host is split by the adaptive skew join."""
    u, t = F.col(url), F.col(fetched).cast("date")
    asked = captures.select(u.alias("_url"), t.alias("_day")).where("_url is not null and _day is not null").distinct()
    keys = asked.select("_url", "_day", F.explode(F.array_distinct(candidate_keys(F.col("_url")))).alias("k")).select("_url", "_day", "k.kind", "k.value")
    active = F.exists("spans", lambda s: (s["valid_from"] <= F.col("_day")) & (s["valid_to"].isNull() | (F.col("_day") < s["valid_to"])))
    hits = keys.join(intervals(entries), ["kind", "value"]).where(active)
    verdict = hits.groupBy("_url", "_day").agg(
        F.array_join(F.array_sort(F.collect_set("list_name")), ",").alias("_hits"),
        (F.coalesce(F.bool_or(F.col("effect") == "block"), F.lit(False)) & ~F.coalesce(F.bool_or(F.col("effect") == "allow"), F.lit(False))).alias("_blocked"),
    )
    rows = captures.select(F.struct(*[F.col(f"`{x}`") for x in captures.columns]).alias("row"), u.alias("_url"), t.alias("_day"))
    out = rows.join(verdict, ["_url", "_day"], "left")
    kept = [F.col(f"row.`{x}`") for x in captures.columns if x not in ("list_hits", "blocked")]
    return out.select(*kept, F.coalesce("_hits", F.lit("")).alias("list_hits"), F.coalesce("_blocked", F.lit(False)).alias("blocked"))


#: Dated entries of the query: (list_name, effect, kind, value, action, effective).
ENTRIES = [
    ("spam", "block", "domain", "spam-farm.example.org", "add", "2024-01-15"),
    ("spam", "block", "domain", "cheap-pills.example.com", "add", "2024-02-01"),
    ("spam", "block", "domain", "cheap-pills.example.com", "remove", "2024-07-01"),
    ("spam", "block", "domain", "cheap-pills.example.com", "add", "2024-10-01"),
    ("optout", "block", "host", "tionsh.example.net", "add", "2024-03-01"),
    ("optout", "block", "host", "tionsh.example.net", "remove", "2024-05-01"),
    ("optout", "block", "host", "ththon.example.com", "add", "2024-06-10"),
    ("optout", "block", "path", "ththan.example.net/en", "add", "2024-04-01"),
    ("legal", "block", "domain", "ththth.example.org", "add", "2024-08-01"),
    ("legal", "block", "domain", "thther.example.org", "add", "2024-01-01"),
    ("legal", "block", "domain", "thther.example.org", "remove", "2024-01-01"),
    ("trusted", "allow", "path", "tionsh.example.net/fr", "add", "2024-04-01"),
    ("trusted", "allow", "host", "m.ththth.example.org", "add", "2024-09-01"),
]
ENTRY_TYPE = "list_name string, effect string, kind string, value string, action string, effective string"


def op4_url_lists(spark, sf_dir: str) -> DataFrame:
    """Every capture of `pages` (fetch date 2024-01-01 plus page_id * 37 mod 366 days) against ENTRIES."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("fetched"))
    out = filter_captures(captures, spark.createDataFrame(ENTRIES, ENTRY_TYPE))
    return out.select("page_id", host_of(F.col("url")).alias("host"), F.col("fetched").cast("string").alias("fetched"), "list_hits", "blocked")


def op4_sql() -> str:
    rows = ",\n".join("(" + ", ".join(f"'{x}'" for x in e) + ")" for e in ENTRIES)
    return f"""
with e(list_name, effect, kind, value, action, effective) as (values {rows}),
daily as (select list_name, effect, kind, lower(value) as value, effective::date as d, max(action) as action from e group by all),
spans as (select *, lead(d) over (partition by list_name, effect, kind, value order by d) as until from daily),
cap as (select page_id, url, regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '\\.$', '') as host,
  '/' || array_to_string(list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> ''), '/') || '/' as path,
  (date '2024-01-01' + (((page_id * 37) % 366 + 366) % 366)::int) as fetched from pages),
hit as (select c.page_id, c.url, c.fetched, string_agg(distinct list_name, ',' order by list_name) as list_hits, bool_or(effect = 'block') and not bool_or(effect = 'allow') as blocked
  from cap c join spans s on s.action = 'add' and s.d <= c.fetched and (s.until is null or c.fetched < s.until)
   and case s.kind when 'host' then c.host = s.value when 'domain' then c.host = s.value or ends_with(c.host, '.' || s.value)
       else starts_with(lower(c.host || c.path), s.value || '/') end
  group by all)
select c.page_id, c.host, c.fetched::varchar as fetched, coalesce(h.list_hits, '') as list_hits, coalesce(h.blocked, false) as blocked
from cap c left join hit h on h.page_id = c.page_id and h.url = c.url and h.fetched = c.fetched
"""
