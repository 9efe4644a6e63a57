"""Sensor feeds, stored tables and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnoscope.functions import text
from limnoscope.functions.numeric import lenient_double
from limnoscope.operators import reshape, sensors, stored_tables, tables
from limnoscope.plans.ingest import pages_to_sensor_rows
from limnoscope.schemas import SENSOR_IDENTITY
from limnoscope.session import scratch_path
from limnoscope.sources import files, html_tables, sinks
from limnoscope.streaming import sensor_stream
from queries import standins as s
from queries.registry import fixed, query, sql_fixed, sql_stamp, stamp


def _hourly(samples, name):
    first = F.coalesce(F.col("event_type").isin(*_FIRST), F.lit(False))
    hour = F.date_trunc("hour", F.col("ts")).alias("ts")
    mine = first if name == "phycocyanin" else ~first
    return samples.where(mine).groupBy("reservoir_id", hour).agg(F.avg("value").alias(name))


# Types of the first sensor; all others belong to the second.
_FIRST = ("click", "view")
_SENSORS = {
    n: f"select reservoir_id, date_trunc('hour', ts) as ts, avg(value) {c} from samples where {no} coalesce(event_type in {_FIRST}, false) group by 1,2"
    for n, c, no in (("a", "phycocyanin", ""), ("b", "chlorophyll", "not"))
}


@query(
    s.with_views("samples", **_SENSORS)
    + f"""select reservoir_id, {sql_stamp('ts')} ts, {sql_fixed('phycocyanin')} phycocyanin, null::double chlorophyll, 'a' site from a
    union all select reservoir_id, {sql_stamp('ts')}, null, {sql_fixed('chlorophyll')}, 'b' from b"""
)
def sensor_union(spark, sf):
    """Feeds with differing columns one after the other."""
    samples = s.samples(spark, sf)
    both = reshape.union_all(
        [
            _hourly(samples, "phycocyanin").withColumn("site", F.lit("a")),
            _hourly(samples, "chlorophyll").withColumn("site", F.lit("b")),
        ]
    )
    return both.select(
        "reservoir_id", stamp("ts").alias("ts"), fixed("phycocyanin").alias("phycocyanin"),
        fixed("chlorophyll").alias("chlorophyll"), "site",
    )


@query(
    s.with_views("samples", **_SENSORS)
    + f"""select reservoir_id, {sql_stamp('ts')} ts, {sql_fixed('phycocyanin')} phycocyanin, {sql_fixed('chlorophyll')} chlorophyll
    from a full join b using (reservoir_id, ts)"""
)
def sensor_full_outer(spark, sf):
    """Two sensors merged on their hour; hours of one sensor only stay."""
    samples = s.samples(spark, sf)
    merged = sensors.merge_sensors(
        _hourly(samples, "phycocyanin"), _hourly(samples, "chlorophyll"), ["reservoir_id", "ts"]
    )
    return merged.select(
        "reservoir_id", stamp("ts").alias("ts"), fixed("phycocyanin").alias("phycocyanin"),
        fixed("chlorophyll").alias("chlorophyll"),
    )


_DEDUPED = f"""select {sql_stamp('date_time')} date_time, reservoir_code, phycocyanin, {sql_fixed('water_temp')} water_temp, depth, min(ingest_id) ingest_id
  from feed group by feed.date_time, reservoir_code, phycocyanin, feed.water_temp, depth"""


@query(s.with_views("feed") + _DEDUPED)
def sensor_dedupe(spark, sf):
    """First arrival of each sensor row; missing measures count as equal."""
    kept = sensors.drop_repeated(s.feed(spark, sf))
    return kept.select(
        stamp("date_time").alias("date_time"), "reservoir_code", "phycocyanin",
        fixed("water_temp").alias("water_temp"), "depth", "ingest_id",
    )


@query(
    s.with_views("feed")
    + f"""select reservoir_code, {sql_stamp('feed.date_time')} date_time, phycocyanin, depth from feed where phycocyanin is not null"""
)
def sensor_append(spark, sf):
    """Normalised rows appended to the sensor table in two loads and read back."""
    path = scratch_path(spark, "sensor")
    rows = s.feed(spark, sf).na.drop(subset=["date_time", "phycocyanin"])
    later = F.col("ingest_id") >= 1_000_000_000
    sinks.append_sensor_rows(rows.where(~later), path)
    sinks.append_sensor_rows(rows.where(later), path)
    stored = spark.read.parquet(path)
    return stored.select(
        F.col("reservoir_code").cast("string").alias("reservoir_code"), stamp("date_time").alias("date_time"), "phycocyanin", "depth"
    )


_PERIODS = """with e as (select cast(min(ts) as date) a, cast(max(ts) as date) + 2500 b from events),
  p as (select cast(unnest(generate_series(a, b, interval 90 day)) as date) s, b from e),
  q as (select s, least(s + 89, b) t, date '2025-03-01' xa, date '2025-09-14' xb from p)
  select * from (select s period_start, least(t, xa - 1) period_end from q union all select greatest(s, xb + 1), t from q)
  where period_start <= period_end"""


@query(_PERIODS)
def period_chunks(spark, sf):
    """Ninety-day periods over the span of the events and beyond, with an interval cut out."""
    span = s.table(spark, sf, "events").agg(
        F.to_date(F.min("ts")).alias("a"), F.date_add(F.to_date(F.max("ts")), 2500).alias("b")
    )
    whole = sensors.periods_of(span, F.col("a"), F.col("b"), 90)
    return sensors.subtract_interval(whole, "2025-03-01", "2025-09-14")


@query(
    """with li as (select page_id, regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li\\s*>', 1) v from pages),
    r as (select page_id, unnest(v) t, cast(generate_subscripts(v, 1) - 1 as int) as position from li)
    select page_id, position, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(t, '(?s)<[^>]*>', '', 'g'),
      '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) as "text" from r"""
)
def html_list_items(spark, sf):
    """List items of every stored page."""
    return html_tables.list_items(s.table(spark, sf, "pages").select("page_id", "html"))


def _sensor_pages(spark, sf):
    """One page per sample: a table of no interest, then the sensor table with decimal commas and cell classes."""
    comma = lambda c: F.replace(F.format_string("%.2f", c), F.lit("."), F.lit(","))
    valid = F.when(F.col("event_id") % 3 == 0, F.lit("f2")).otherwise(F.lit("f1"))
    html = F.concat(
        F.lit("<html><body><table><tr><th>Otro dato</th></tr><tr><td>1</td></tr></table>"
              "<TABLE id='t'><thead><tr><th>Fecha y hora</th><th>Ficocianina (&micro;g/L)</th><th> Temperatura agua </th>"
              "<th>Profundidad m&aacute;xima embalse (m)</th></tr></thead><tbody><tr class='r'><td>"),
        F.date_format("ts", "dd-MM-yyyy HH:mm:ss"), F.lit("</td><td class=\"f1\">"), comma(F.col("value")),
        F.lit("</td><td>"), comma(F.col("value") / 10), F.lit("</td><td class='"), valid, F.lit("'><b>"),
        comma(F.col("value") + 100), F.lit("</b></td></tr><tr><td>sin dato</td><td>-</td><td></td><td></td></tr></tbody></TABLE></body></html>"),
    )
    # Reading a page costs far more than moving a narrow sample, and a small file is one split.
    spread = s.samples(spark, sf).repartition("event_id")
    return spread.select(F.col("event_id").alias("page_id"), html.alias("html"))


@query(
    s.with_views("samples")
    + f"""select distinct {sql_stamp('ts')} date_time, '2351' reservoir_code, round(value, 2) phycocyanin,
      case when event_id % 3 <> 0 then {sql_fixed('value + 100', 2)} end as "depth" from samples"""
)
def html_table_rows(spark, sf):
    """Sensor rows out of stored pages: table choice, decimal commas, cell classes, repeated rows."""
    rows = pages_to_sensor_rows(_sensor_pages(spark, sf), "2351", -1.5, 41.5)
    return rows.select(stamp("date_time").alias("date_time"), "reservoir_code", "phycocyanin", fixed("depth", 2).alias("depth"))


@query(
    """select c_custkey, c_name, c_mktsegment, (select count(*) from customer where c_name ilike '%2%' or c_mktsegment ilike '%build%') total
    from customer where c_name ilike '%2%' or c_mktsegment ilike '%build%' order by 1 desc limit 25 offset 50"""
)
def table_search_page(spark, sf):
    """One page of the rows that contain a term, with the number of all such rows."""
    customers = s.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    either = text.any_column_contains(["c_name"], "2") | text.any_column_contains(["c_mktsegment"], "build")
    rows, total = tables.page(customers.where(either), 25, 50)
    return rows.withColumn("total", total.scalar())


@query("select o_orderkey, o_orderstatus, o_totalprice from orders order by o_orderkey limit 10")
def table_preview(spark, sf):
    """First ten rows in key order."""
    orders = s.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return tables.preview(orders, ["o_orderkey"])


@query(
    f"""with changed as (select o_orderkey, {sql_fixed('case when o_totalprice < 50000 then o_totalprice*1.1e0 else o_totalprice end', 4)} o_totalprice,
      case when o_totalprice < 50000 then '9-CHEAP' else o_orderpriority end o_orderpriority from orders
      where not (o_orderstatus = 'P' and o_totalprice > 200000))
    select * from changed union all
    select 1000000000000 + n_nationkey, {sql_fixed('n_nationkey*1.5e0', 4)}, n_name from nation"""
)
def keyed_changes(spark, sf):
    """Rows inserted, updated and deleted by key, written as a new version and read back."""
    columns = ["o_orderkey", "o_totalprice", "o_orderpriority"]
    orders = s.table(spark, sf, "orders")
    cheap = orders.where(F.col("o_totalprice") < 50000).select(
        "o_orderkey", (F.col("o_totalprice") * 1.1).alias("o_totalprice"), F.lit("9-CHEAP").alias("o_orderpriority")
    )
    gone = orders.where((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 200000))
    added = s.table(spark, sf, "nation").selectExpr(
        "1000000000000 + n_nationkey as o_orderkey", "n_nationkey*1.5D as o_totalprice", "n_name as o_orderpriority"
    )
    base = orders.select(*columns)
    version = tables.insert_rows(tables.delete_rows(tables.update_rows(base, cheap, "o_orderkey"), gone, "o_orderkey"), added)
    path = scratch_path(spark, "version")
    sinks.write_version(version, path)
    return spark.read.parquet(path).withColumn("o_totalprice", fixed("o_totalprice", 4))


_EVENT_COLUMNS = [
    ("event_id", "bigint", "number"), ("ts", "timestamp_ntz", "date"), ("user_id", "bigint", "number"),
    ("event_type", "string", "text"), ("value", "double", "number"), ("props", "string", "text"),
]


@query(
    " union all ".join(
        f"""select {i} "position", '{c}' column_name, '{t}' data_type, '{k}' type_class, count("{c}") n_present,
        count(try_cast(cast("{c}" as varchar) as double)) n_numeric from events"""
        for i, (c, t, k) in enumerate(_EVENT_COLUMNS)
    )
)
def column_profile(spark, sf):
    """Columns with their types, rows present and rows that read as numbers."""
    return tables.column_profile(s.table(spark, sf, "events")).drop("nullable")


def _event_stream(spark, sf):
    schema = s.table(spark, sf, "events").schema
    return s.samples_of(sensor_stream.read_feed(spark, sf, schema, glob="events.parquet"))


@query(
    s.with_views("feed")
    + f"""select distinct {sql_stamp('date_time')} date_time, reservoir_code, phycocyanin, {sql_fixed('water_temp')} water_temp, depth from feed"""
)
def stream_sensor_dedupe(spark, sf):
    """The repeated feed as a stream into a table, each row once."""
    path, marks = scratch_path(spark, "stream"), scratch_path(spark, "stream-marks")
    arrivals = s.feed_of(_event_stream(spark, sf))
    once = sensor_stream.drop_repeated(arrivals, SENSOR_IDENTITY, delay="7 days", salt_from=["ingest_id"])
    sensor_stream.append_to(once, path, marks).awaitTermination()
    return spark.read.parquet(path).select(
        stamp("date_time").alias("date_time"), "reservoir_code", "phycocyanin", fixed("water_temp").alias("water_temp"), "depth"
    )


@query(
    s.with_views("samples")
    + f"""select reservoir_id, cast(ts as date) as "date", variable, count(*) n_obs, {sql_fixed('avg(value)')} value_mean,
      {sql_fixed('median(value)')} value_median, {sql_fixed('min(value)')} value_min, {sql_fixed('max(value)')} value_max
    from samples group by 1,2,3"""
)
def stream_daily_stats(spark, sf):
    """Daily figures kept current by a stream."""
    path, marks = scratch_path(spark, "counts"), scratch_path(spark, "counts-marks")
    keys = ["reservoir_id", "variable"]
    counts = sensor_stream.daily_value_counts(_event_stream(spark, sf), keys, "value")
    sensor_stream.keep_current(counts, path, marks, keys, merge_every=1).awaitTermination()
    rows = sensor_stream.current_daily_statistics(spark, path, keys)
    return rows.select(
        "reservoir_id", "date", "variable", "n_obs",
        *[fixed(c).alias(c) for c in ("value_mean", "value_median", "value_min", "value_max")],
    )


@query(
    s.with_views("samples")
    + f"""select {sql_stamp('ts')} ts, event_type as variable, value, count(*) n
    from (select date_trunc('second', ts) as ts, event_type, cast(cast(value as varchar) as double) as value from samples where value is not null)
    group by 1,2,3"""
)
def insitu_upload_csv(spark, sf):
    """Field samples written as two CSV files whose columns come in different order, and read back as one folder."""
    folder = scratch_path(spark, "uploads")
    rows = s.samples(spark, sf).where(F.col("value").isNotNull())
    types = [r.event_type for r in rows.select("event_type").distinct().orderBy("event_type").collect()]
    rows = rows.select(
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "HH:mm:ss").alias("time"),
        *[F.when(F.col("event_type") == t, F.col("value")).alias(t) for t in types], (F.col("event_id") % 2).alias("half"),
    )
    for half, order in ((0, types), (1, types[::-1])):
        files.write_csv(rows.where(F.col("half") == half).select("date", "time", *order), f"{folder}/{half}", "append")
    back = files.read_insitu_uploads(spark, f"{folder}/*")
    return back.groupBy(stamp("ts").alias("ts"), "variable", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    s.with_views("samples")
    + f"""select {sql_stamp('ts')} ts, phycocyanin, chlorophyll, count(*) n from (
      select date_trunc('second', ts) as ts, value as phycocyanin, null::double chlorophyll from samples where event_id % 3 = 0 and value is not null union all
      select date_trunc('second', ts), value, value + 1 from samples where event_id % 3 = 1 and value is not null union all
      select date_trunc('second', ts), null, value from samples where event_id % 3 = 2 and value is not null) group by 1,2,3"""
)
def sensor_exports(spark, sf):
    """Sensor files of three kinds of headers and two kinds of times, read in one scan and renamed by parts of their headers."""
    folder = scratch_path(spark, "exports")
    rows = s.samples(spark, sf).where(F.col("value").isNotNull())
    part = lambda k: rows.where(F.pmod(F.col("event_id"), F.lit(3)) == k)
    time = lambda name, form: F.date_format("ts", form).alias(name)
    value = F.col("value").cast("string")
    files.write_csv(part(0).select(time("Time", "yyyy-MM-dd HH:mm:ss"), value.alias("Ficocianina (µg/L)")), f"{folder}/a")
    files.write_csv(part(1).select((F.col("value") + 1).alias("Clorofila (µg/L)"), value.alias("Ficocianina (µg/L)"), time("Fecha-hora", "dd/MM/yyyy HH:mm:ss")), f"{folder}/b")
    files.write_csv(part(2).select(time("Fecha-hora", "yyyy-MM-dd HH:mm:ss"), F.lit("x, y").alias("note"), value.alias("Clorofila (µg/L)")), f"{folder}/c")
    merged = files.read_sensor_exports(spark, [f"{folder}/{k}" for k in "abcd"])
    named = sensors.rename_by_substring(merged, {"fecha": "ts", "ficocianina": "phycocyanin", "clorofila": "chlorophyll"})
    return named.groupBy(
        stamp("ts").alias("ts"), *[lenient_double(F.col(c)).alias(c) for c in ("phycocyanin", "chlorophyll")]
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    """with k as (select c_custkey, c_name, c_acctbal from customer),
    pages as (select *, row_number() over (order by c_custkey desc) rn, count(*) over () total from k)
    select c_custkey, c_name, c_acctbal, total, (rn - 1) // 40 as page_no from pages where rn <= 120"""
)
def table_seek_pages(spark, sf):
    """Three pages of a stored table, each sought by the last key of the one before, with the total."""
    path = scratch_path(spark, "paged")
    stored_tables.write_paged(s.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path, "c_custkey", files=8)
    pages, last = [], None
    for k in range(3):
        page = stored_tables.seek_page(spark, path, "c_custkey", 40, last)
        last = page.agg(F.min("c_custkey")).first()[0]
        pages.append(page.withColumn("page_no", F.lit(k).cast("long")))
    return reshape.union_all(pages).withColumn("total", stored_tables.total_rows(spark, path).scalar())


_TERMS = ("#00000001", "0%17", "FURNI", "y")


@query(" union all ".join(f"select '{t}' as term, c_custkey, c_name, c_mktsegment from customer where c_name ilike '%{t}%' or c_mktsegment ilike '%{t}%'" for t in _TERMS))
def table_search_parts(spark, sf):
    """Rows that hold a term, found by its three-letter parts; a shorter term is searched for in all rows."""
    customers = s.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    path, columns = scratch_path(spark, "parts"), ["c_name", "c_mktsegment"]
    stored_tables.write_search_parts(customers, path, "c_custkey", columns)
    found = [stored_tables.search_by_parts(customers, path, "c_custkey", columns, term).withColumn("term", F.lit(term)) for term in _TERMS]
    return reshape.union_all(found)


@query(
    f"""select o_orderkey, {sql_fixed('case when o_orderkey % 512 = 5 then o_totalprice*1.1e0 else o_totalprice end', 4)} o_totalprice,
      case when o_orderkey % 512 = 5 then '9-CHANGED' else o_orderpriority end o_orderpriority from orders where o_orderkey % 640 <> 1 union all
    select 1000000000000 + n_nationkey, {sql_fixed('n_nationkey*1.5e0', 4)}, n_name from nation where n_nationkey < 3"""
)
def bucketed_changes(spark, sf):
    """Updates, deletes and inserts by key in a table of buckets, of which only those touched are rewritten."""
    orders = s.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    path = scratch_path(spark, "buckets")
    stored_tables.write_buckets(orders, path, "o_orderkey", 64)
    changed = orders.where("o_orderkey % 512 = 5").select(
        "o_orderkey", (F.col("o_totalprice") * 1.1).alias("o_totalprice"), F.lit("9-CHANGED").alias("o_orderpriority")
    )
    added = s.table(spark, sf, "nation").where("n_nationkey < 3").selectExpr(
        "1000000000000 + n_nationkey as o_orderkey", "n_nationkey*1.5D as o_totalprice", "n_name as o_orderpriority"
    )
    stored_tables.change_buckets(spark, path, "o_orderkey", 64, updates=changed, deletes=orders.where("o_orderkey % 640 = 1"))
    stored_tables.change_buckets(spark, path, "o_orderkey", 64, inserts=added)
    return stored_tables.read_buckets(spark, path).withColumn("o_totalprice", fixed("o_totalprice", 4))
