"""The engine's operators over the driver's tables: each query with the SQL that it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import html as H
from .functions import payload as P
from .functions import temporal as T
from .functions import text as X
from .functions.truthy import first_truthy
from .model import SESSION
from .operators import enrich, merge, ordered
from .plans import publish, refresh, sink
from .scratch import place
from .sources import catalogue, cinemateca, frontier, medeia, sao_jorge, store, trindade
from .sources.base import as_movies
from .sources.keyed import KeyedTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "q02_null_aware_merge"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# DuckDB's form of F1
_NORM = "trim(regexp_replace(regexp_replace(strip_accents(lower({0})), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT doc_id, length({_NORM.format('text')})::BIGINT AS n_chars, md5({_NORM.format('text')}) AS digest FROM documents")
def q01_norm_key(spark, sf_dir):
    """F1, of whole texts: length and digest of the key."""
    norm = X.norm_key(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(norm).cast("long").alias("n_chars"), F.md5(norm.cast("binary")).alias("digest"))


@query(f"""
    WITH p AS (SELECT {_NORM.format('p_name')} AS t, nullif(p_size % 7, 0) AS y, * FROM part),
    k AS (SELECT *, CASE WHEN first_value(y) OVER (PARTITION BY t ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) IS NOT NULL
                         THEN last_value(y IGNORE NULLS) OVER (PARTITION BY t ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS g FROM p)
    SELECT t AS title_key, g AS group_year, min(p_partkey) AS rep, count(*) AS n,
           arg_min(p_brand, p_partkey) FILTER (WHERE p_size % 5 <> 0) AS brand, arg_min(p_type, p_partkey) FILTER (WHERE p_size % 3 <> 0) AS type
    FROM k GROUP BY t, g""")
def q02_null_aware_merge(spark, sf_dir):
    """Null-aware groups of parts; gaps are filled from later records."""
    part = table(spark, sf_dir, "part").select(
        X.norm_key(F.col("p_name")).alias("title_key"),
        F.nullif(F.col("p_size") % 7, F.lit(0)).alias("year"),
        "p_partkey",
        F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).otherwise("").alias("brand"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("type"),
    )
    keyed = merge.null_aware_key(part, "title_key", "year", ["p_partkey"])
    order = F.col("p_partkey")
    return keyed.groupBy("title_key", "group_year").agg(F.min("p_partkey").alias("rep"), F.count("*").alias("n"), merge.fill("brand", "string", order), merge.fill("type", "string", order))


@query("""
    WITH s AS (SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS date, l_returnflag AS time, l_linestatus AS cinema, l_linenumber, l_partkey,
                      row_number() OVER (PARTITION BY l_orderkey, l_shipdate, l_returnflag, l_linestatus ORDER BY l_linenumber, l_partkey) AS n FROM lineitem)
    SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY date, time, l_linenumber, l_partkey) AS pos, date, time, cinema, l_partkey::VARCHAR AS label
    FROM s WHERE n = 1""")
def q03_session_union(spark, sf_dir):
    """Sessions of an order, the first of equal ones, by date and time."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_returnflag").alias("time"), F.col("l_linestatus").alias("cinema"), F.array(F.col("l_partkey").cast("string")).alias("labels")).alias("session"),
    )
    merged = merge.union_sessions(rows, ["l_orderkey"], ["l_linenumber", "l_partkey"])
    return merged.select("l_orderkey", F.posexplode("sessions").alias("p", "s")).select(
        "l_orderkey", (F.col("p") + 1).cast("long").alias("pos"), "s.date", "s.time", "s.cinema", F.col("s.labels")[0].alias("label")
    )


# the near titles: a name and two letters, so that a name's parts differ by a letter or two
_CODE = "chr(97 + (p_partkey % 26)::INT) || chr(97 + (p_partkey // 26 % 26)::INT)"
_CLASSES = f"SELECT min(p_partkey) AS ord, k, y FROM (SELECT p_partkey, {_NORM.format("p_name || ' ' || " + _CODE)} AS k, (p_size % 4)::INT AS y FROM part) GROUP BY k, y"
_FUZZY = f"""
    n AS ({_CLASSES}),
    links AS (SELECT a.ord AS i, b.ord AS j FROM n a JOIN n b ON a.ord < b.ord AND length(a.k) >= 8 AND length(b.k) >= 8 AND abs(length(a.k) - length(b.k)) <= 1 AND abs(a.y - b.y) <= 1
        WHERE regexp_replace(a.k, '[0-9]', '#', 'g') <> regexp_replace(b.k, '[0-9]', '#', 'g') AND levenshtein(a.k, b.k) <= 1)"""


def _titles(spark, sf_dir):
    letter = lambda c: F.char(97 + c % 26)
    code = F.concat(letter(F.col("p_partkey")), letter(F.floor(F.col("p_partkey") / 26)))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), X.norm_key(F.concat_ws(" ", "p_name", code)).alias("k"), (F.col("p_size") % 4).cast("int").alias("year"))


@query(f"WITH {_FUZZY} SELECT i, j FROM links")
def q04_fuzzy_pairs(spark, sf_dir):
    """Titles one edit apart, years at most one apart: pairs of the first records of equal title and year."""
    return merge.fuzzy_links(merge.title_classes(_titles(spark, sf_dir)))


@query(f"""
    WITH RECURSIVE {_FUZZY},
    steps AS (SELECT v, row_number() OVER (ORDER BY v) AS s FROM (SELECT i AS v FROM links UNION SELECT j FROM links)),
    earlier AS (SELECT j, list(i) AS before FROM links GROUP BY j),
    -- one record after the other: the leaders so far, and the least leader that takes it in
    scan(s, v, owner, leaders) AS (
        SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[]
        UNION ALL
        SELECT s, v, owner, CASE WHEN owner IS NULL THEN list_append(leaders, v) ELSE leaders END FROM (
            SELECT steps.s, steps.v, list_min(list_intersect(coalesce(before, []), leaders)) AS owner, leaders
            FROM scan JOIN steps ON steps.s = scan.s + 1 LEFT JOIN earlier ON j = steps.v)),
    owned AS (SELECT k, y, owner FROM scan JOIN n ON ord = v WHERE owner IS NOT NULL)
    SELECT p_partkey AS ord, owner FROM part JOIN owned ON k = {_NORM.format("p_name || ' ' || " + _CODE)} AND y = p_size % 4""")
def q05_fuzzy_star_owner(spark, sf_dir):
    """The record that each absorbed record goes to, by the greedy scan over all records."""
    return merge.absorbed(_titles(spark, sf_dir))


@query("""
    SELECT p.event_id, p.user_id, c.event_id AS prev_event_id, c.value AS prev_value
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts > c.ts""")
def q06_asof_before(spark, sf_dir):
    """Each purchase with the user's latest earlier click."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    left = events.where("event_type = 'purchase'").drop("event_type")
    seen = ordered.asof_before(left, events.where("event_type = 'click'"), "user_id", "ts", ["event_id", "value"])
    return seen.select("event_id", "user_id", "prev_event_id", "prev_value")


@query("""
    SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_error FROM events""")
def q07_carry_forward(spark, sf_dir):
    """The last error's value, carried forward."""
    events = table(spark, sf_dir, "events")
    value = F.when(F.col("event_type") == "error", F.col("value"))
    return ordered.carry_forward(events, value, ["user_id"], ["ts", "event_id"], "last_error").select("event_id", "last_error")


@query("""
    SELECT event_id, lead(event_type) OVER w AS next_event_type, lead(event_id) OVER w AS next_event_id
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def q08_lead_pair(spark, sf_dir):
    """The next event."""
    return ordered.with_next(table(spark, sf_dir, "events"), ["event_type", "event_id"], ["user_id"], ["ts", "event_id"]).select("event_id", "next_event_type", "next_event_id")


_ANCHOR = r'<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
_ANCHORS = f"""SELECT page_id, unnest(regexp_extract_all(html, '(?s){_ANCHOR}', 1)) AS href, unnest(regexp_extract_all(html, '(?s){_ANCHOR}', 2)) AS label,
    generate_subscripts(regexp_extract_all(html, '(?s){_ANCHOR}', 1), 1) AS pos FROM pages"""


@query(f"SELECT page_id, pos::BIGINT AS pos, href, regexp_replace(label, '<[^>]+>', '', 'g') AS label FROM ({_ANCHORS})")
def q09_page_anchors(spark, sf_dir):
    """G1, F8: anchors with their position."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(H.anchors(F.col("html"))).alias("p", "a"))
    return rows.select("page_id", (F.col("p") + 1).cast("long").alias("pos"), F.col("a.href").alias("href"), F.col("a.text").alias("label"))


@query("""
    SELECT page_id, nullif(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '') AS title,
           regexp_replace(nullif(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), ''), '<[^>]+>', '', 'g') AS h1,
           nullif(regexp_extract(html, '(?s)<html[^>]*lang="([^"]*)"', 1), '') AS lang FROM pages""")
def q10_page_title(spark, sf_dir):
    """Title, heading and language of a page."""
    page = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", H.inner(page, r"<title[^>]*>(.*?)</title>").alias("title"), H.strip_tags(H.inner(page, r"<h1[^>]*>(.*?)</h1>")).alias("h1"), H.inner(page, r'<html[^>]*lang="([^"]*)"').alias("lang")
    )


@query(r"""
    SELECT page_id, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM (
        SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gs'), '<style[^>]*>.*?</style>', '', 'gs'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g') AS t FROM pages)""")
def q11_visible_text(spark, sf_dir):
    """the text of a page without scripts, styles and tags."""
    text = H.visible_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("digest"))


@query(f"SELECT page_id, href, min(pos)::BIGINT AS pos FROM ({_ANCHORS}) GROUP BY page_id, href")
def q12_ordered_distinct_links(spark, sf_dir):
    """links of a page, the first of equal ones."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(H.anchors(F.col("html"))).alias("p", "a")).select("page_id", F.col("a.href").alias("href"), (F.col("p") + 1).cast("long").alias("pos"))
    return ordered.first_seen(rows, ["page_id", "href"], ["pos"])


@query("""
    WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS path FROM pages)
    SELECT min(page_id) AS page_id, path, string_split(path, '/')[-1] AS segment FROM p
    WHERE string_split(path, '/')[-1] NOT IN ('full-view', 'by-event', 'filter', 'archive', 'pdf-agenda') GROUP BY path""")
def q13_url_slug(spark, sf_dir):
    """Paths without query and fragment, navigation pages left out, the first page of each."""
    path = X.path_only(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), X.last_segment(path).alias("segment"))
    pages = pages.where(~F.col("segment").isin("full-view", "by-event", "filter", "archive", "pdf-agenda"))
    return ordered.first_seen(pages, ["path"], ["page_id"])


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def q14_json_props(spark, sf_dir):
    """A3: a number from JSON of a fixed schema; q51 and q57 have the payloads without one."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k INT")["k"].alias("k"))


@query("""
    SELECT o_orderkey, count(*) AS n_lines, min(l_linenumber) AS first_line FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    WHERE o_orderdate >= DATE '1996-01-01' AND l_shipdate >= DATE '1996-06-01' GROUP BY o_orderkey""")
def q15_future_filter(spark, sf_dir):
    """The rule of B2 and B3 on orders and lines; q49 runs the operator on sessions."""
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= DATE'1996-01-01'").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate >= DATE'1996-06-01'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.min("l_linenumber").alias("first_line"))
    return orders.join(lines, "o_orderkey")


@query("""
    WITH s AS (SELECT c_mktsegment, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
    SELECT c_mktsegment, strftime(unnest(generate_series(a, b, INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM s""")
def q16_date_expand(spark, sf_dir):
    """Every day between a segment's first and last order; q68 reads ranges of days from text."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    ends = joined.groupBy("c_mktsegment").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return ends.where("a <= b").select("c_mktsegment", F.explode(F.sequence("a", "b")).alias("day")).select("c_mktsegment", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("""
    SELECT o_orderkey, strftime(CASE WHEN date_diff('day', near, DATE '1998-11-15') > 60 THEN near + INTERVAL 1 YEAR ELSE near END, '%Y-%m-%d') AS day
    FROM (SELECT o_orderkey, make_date(1998, month(o_orderdate), least(day(o_orderdate), 28)) AS near FROM orders)""")
def q17_year_rollover(spark, sf_dir):
    """the year of a day and month, given the day that counts as today."""
    day = F.least(F.dayofmonth("o_orderdate"), F.lit(28))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.rolled_date(day, F.month("o_orderdate"), F.lit("1998-11-15").cast("date")).alias("day"))


@query("""
    SELECT event_id, strftime(timezone('Europe/Lisbon', timezone('UTC', ts)), '%Y-%m-%d %H:%M') AS civil,
           strftime(timezone('Europe/Lisbon', timezone('UTC', ts + INTERVAL 180 DAY)) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS listed FROM events""")
def q18_lisbon_time(spark, sf_dir):
    """UTC to Lisbon, by the civil clock and as the listings have it (half a year on, in summer time)."""
    stamp = F.col("ts").cast("timestamp")
    written = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return table(spark, sf_dir, "events").select("event_id", written(T.lisbon_time(stamp, civil=True)).alias("civil"), written(T.lisbon_time(stamp + F.expr("interval 180 day"))).alias("listed"))


@query("""
    SELECT o_custkey, o_orderkey, o_orderpriority FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderdate, o_orderkey) AS n
        FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) WHERE n = 1""")
def q19_ranked_pick(spark, sf_dir):
    """The first urgent order of a customer, else the first high one."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    tiers = [F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "2-HIGH"]
    return ordered.ranked_pick(orders, ["o_custkey"], tiers, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""
    WITH base AS (SELECT c_custkey, 1995 + (c_custkey % 4)::INT AS y FROM customer),
    tries AS (SELECT c_custkey, y - k AS y, k AS pos FROM base, (VALUES (0), (1), (2)) t(k) UNION ALL SELECT c_custkey, NULL, 3 FROM base),
    o AS (SELECT o_custkey, year(o_orderdate) AS oy, min(o_orderkey) AS o_orderkey FROM orders WHERE o_totalprice > 150000 GROUP BY 1, 2),
    hits AS (SELECT c_custkey, pos, o_orderkey FROM tries JOIN o ON o_custkey = c_custkey AND (y IS NULL OR oy = y))
    SELECT c_custkey, min(pos)::INT AS pos, arg_min(o_orderkey, pos::BIGINT * 1000000000 + o_orderkey) AS o_orderkey FROM hits GROUP BY c_custkey""")
def q20_candidate_join(spark, sf_dir):
    """Attempts (customer, year), two years back, then any year; the first that finds a large order."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", (1995 + F.col("c_custkey") % 4).cast("int").alias("y"))
    tries = customers.select("c_custkey", F.posexplode(F.array(F.col("y"), F.col("y") - 1, F.col("y") - 2, F.lit(None).cast("int"))).alias("pos", "y"))
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 150000").groupBy("o_custkey", F.year("o_orderdate").alias("oy")).agg(F.min("o_orderkey").alias("o_orderkey"))
    hits = tries.join(orders, (F.col("o_custkey") == F.col("c_custkey")) & F.coalesce(F.col("oy") == F.col("y"), F.lit(True))).select("c_custkey", "pos", "o_orderkey")
    return ordered.ranked_pick(hits, ["c_custkey"], [F.lit(True)], ["pos", "o_orderkey"])


@query("""
    SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_name WHEN n_name <> 'N/A' AND s_suppkey % 5 <> 0 THEN n_name ELSE r_name END AS label,
           CASE WHEN s_nationkey <> 0 THEN s_nationkey WHEN n_regionkey <> 0 THEN n_regionkey END AS code
    FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def q21_precedence_fill(spark, sf_dir):
    """2.H: the first value that is there: empty, N/A and zero are missing."""
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    own, other = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).otherwise(""), F.when(F.col("s_suppkey") % 5 != 0, F.col("n_name")).otherwise("N/A")
    return joined.select("s_suppkey", first_truthy(own, other, F.col("r_name"), sentinel="N/A").alias("label"), first_truthy("s_nationkey", "n_regionkey", kind="number").alias("code"))


@query("SELECT page_id, (contains(lower(url), 'site1') OR contains(lower(url), 'logo') OR contains(lower(url), '/7')) AS blocked FROM pages")
def q22_blocklist(spark, sf_dir):
    """Addresses with any of several tokens."""
    return table(spark, sf_dir, "pages").select("page_id", X.bad_poster(F.col("url"), ("site1", "logo", "/7")).alias("blocked"))


@query("""
    SELECT p_brand AS name, arg_min(coalesce(nullif(p_size % 3, 0)::VARCHAR, 'none'), p_partkey) AS slug, min(p_partkey) AS first_key FROM part GROUP BY p_brand""")
def q23_director_dimension(spark, sf_dir):
    """The rule of 2.I on parts: the first row of each name, its null kept; q67 runs the operator."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.nullif(F.col("p_size") % 3, F.lit(0)).cast("string").alias("slug"), F.col("p_partkey").alias("first_key"))
    return ordered.first_seen(part, ["name"], ["first_key"]).select("name", F.coalesce("slug", F.lit("none")).alias("slug"), "first_key")


@query("""
    WITH cur AS (SELECT * FROM orders WHERE o_orderdate >= DATE '1998-07-01'),
    prev AS (SELECT * FROM orders WHERE o_orderdate < DATE '1998-07-01'),
    k AS (SELECT DISTINCT o_custkey FROM orders)
    SELECT o_orderkey, o_custkey FROM cur
    UNION ALL SELECT o_orderkey, o_custkey FROM prev WHERE o_custkey IN (SELECT o_custkey FROM k) AND o_custkey NOT IN (SELECT o_custkey FROM cur)""")
def q24_source_fallback(spark, sf_dir):
    """Customers without current orders keep their earlier ones; every customer's current orders count."""
    orders = table(spark, sf_dir, "orders")
    current = orders.where("o_orderdate >= DATE'1998-07-01'").select("o_orderkey", "o_custkey")
    previous = orders.where("o_orderdate < DATE'1998-07-01'").select("o_orderkey", "o_custkey")
    return ordered.fall_back(current, previous, orders, "o_custkey")


@query("""
    WITH s AS (SELECT p_name, count(DISTINCT p_brand) > 1 AS series FROM part GROUP BY p_name)
    SELECT p_name, CASE WHEN series THEN p_brand ELSE '' END AS group_title, count(*) AS n FROM part JOIN s USING (p_name) GROUP BY 1, 2""")
def q25_series_detect(spark, sf_dir):
    """Names with several brands are grouped by brand too."""
    return ordered.series_keys(table(spark, sf_dir, "part").select("p_name", "p_brand"), "p_name", "p_brand").groupBy("p_name", "group_title").agg(F.count("*").alias("n"))


@query("""
    SELECT p_partkey, p_name FROM (
        SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY length(p_name), p_partkey) AS n FROM part) WHERE n = 1""")
def q26_shortest_title(spark, sf_dir):
    """Of equal brand and type the shortest name."""
    return merge.shortest_title_merge(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_name", "p_partkey").select("p_partkey", "p_name")


@query("""
    SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY q, k) AS pos, k AS ref FROM (
        SELECT l_orderkey AS o_orderkey, l_partkey::VARCHAR AS k, max(l_quantity)::INT AS q FROM lineitem GROUP BY 1, 2)""")
def q27_map_order_refs(spark, sf_dir):
    """Ids of a map by their values, for every order."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_partkey").cast("string").alias("k")).agg(F.max("l_quantity").cast("int").alias("q"))
    maps = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.map_from_entries(F.collect_list(F.struct("k", "q"))).alias("m"))
    return maps.select("o_orderkey", F.posexplode(ordered.map_order(F.col("m"))).alias("p", "ref")).select("o_orderkey", (F.col("p") + 1).cast("long").alias("pos"), "ref")


@query("""
    SELECT doc_id, unnest(t) AS item, unnest(list_transform(range(1, len(t) + 1), lambda k: y[least(k, len(y))])) AS value FROM (
        SELECT doc_id, string_split(text, ' ') AS t, [1990 + (doc_id % 20)::INT, 2000 + (doc_id % 7)::INT] AS y FROM documents)""")
def q28_parallel_pad(spark, sf_dir):
    """Lists zipped over whole texts, the last value repeated."""
    years = F.array((1990 + F.col("doc_id") % 20).cast("int"), (2000 + F.col("doc_id") % 7).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(ordered.padded(F.split("text", " "), years)).alias("x"))
    return docs.select("doc_id", "x.item", "x.value")


_PARTS = r"list_filter(list_transform(regexp_split_to_array(title, '\s*[|+]\s*'), lambda p: trim(p)), lambda p: p <> '')"


@query(rf"""
    WITH t AS (SELECT p_partkey, p_name || ' + ' || p_brand || CASE WHEN p_size % 2 = 0 THEN ' | ' || p_type ELSE '' END AS title FROM part),
    m AS (SELECT *, regexp_matches(title, '\s\|\s') OR (contains(title, ' + ') AND length(title) > 25
          AND len(list_filter(list_transform(regexp_split_to_array(title, '\s*\+\s*'), lambda p: trim(p)), lambda p: length(p) <= 5)) = 0) AS multi FROM t)
    SELECT p_partkey, unnest(CASE WHEN multi THEN {_PARTS} ELSE [title] END) AS part,
           generate_subscripts(CASE WHEN multi THEN {_PARTS} ELSE [title] END, 1)::INT AS idx FROM m""")
def q29_multi_title_split(spark, sf_dir):
    """Joint titles become rows."""
    joint = F.concat(F.col("p_name"), F.lit(" + "), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" | "), F.col("p_type"))).otherwise(""))
    part = table(spark, sf_dir, "part").select("p_partkey", joint.alias("title"))
    pieces = F.filter(F.transform(F.split("title", r"\s*[|+]\s*"), lambda p: F.btrim(p)), lambda p: p != "")
    rows = part.select("p_partkey", F.posexplode(F.when(X.is_multi_title(F.col("title")), pieces).otherwise(F.array("title"))).alias("p", "part"))
    return rows.select("p_partkey", "part", (F.col("p") + 1).alias("idx"))


@query(f"""
    WITH d AS (SELECT p_partkey, p_name AS a, p_type AS q FROM part),
    k AS (SELECT *, {_NORM.format('a')} AS na, {_NORM.format('q')} AS nq FROM d)
    SELECT p_partkey, contains(strip_accents(lower(a)), regexp_split_to_array(trim(strip_accents(lower(q))), '\\s+')[-1]) AS agrees,
           nq <> na AND starts_with(na, nq) AND length(nq) / length(na) < 0.6 AS overrun FROM k""")
def q30_name_guards(spark, sf_dir):
    """Last-name agreement and title overrun, of whole names and types."""
    return table(spark, sf_dir, "part").select("p_partkey", X.last_word_in(F.col("p_name"), F.col("p_type")).alias("agrees"), X.overruns(F.col("p_type"), F.col("p_name")).alias("overrun"))


@query("""
    SELECT doc_id, g[1] AS g1, g[2] AS g2, g[3] AS g3 FROM (
        SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), lambda x: x <> '')[1:3] AS g FROM documents)""")
def q31_genre_topk(spark, sf_dir):
    """the first three parts between commas of whole texts."""
    g = X.comma_parts(F.col("text"), 3)
    return table(spark, sf_dir, "documents").select("doc_id", *[F.try_element_at(g, F.lit(k)).alias(f"g{k}") for k in (1, 2, 3)])


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, sum(CAST(value * 100 AS BIGINT))::BIGINT AS cents FROM events GROUP BY event_type")
def q32_venue_summary(spark, sf_dir):
    """Counts by venue, on events; q50 and q55 run the operators."""
    cents = F.round(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum(cents).alias("cents"))


@query("""
    SELECT c_custkey, names FROM (SELECT c_custkey FROM customer) LEFT JOIN (
        SELECT c_custkey, string_agg(n_name, ', ' ORDER BY pos) AS names FROM (
            SELECT c_custkey, unnest([c_nationkey, (c_custkey % 30)::INT, 99]) AS id, unnest([0, 1, 2]) AS pos FROM customer) JOIN nation ON n_nationkey = id GROUP BY c_custkey) USING (c_custkey)""")
def q33_dim_array_lookup(spark, sf_dir):
    """D3: ids of an array as names."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.array(F.col("c_nationkey"), (F.col("c_custkey") % 30).cast("int"), F.lit(99)).alias("ids"))
    return ordered.joined_list(customers, "ids", table(spark, sf_dir, "nation"), "n_nationkey", "n_name", ["c_custkey"])


@query(r"""
    SELECT doc_id, array_to_string(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1:3], ' ') AS lead FROM documents""")
def q34_first_sentences(spark, sf_dir):
    """the first three sentences."""
    return table(spark, sf_dir, "documents").select("doc_id", X.first_sentences(F.col("text")).alias("lead"))


@query("SELECT p_partkey, p_name AS title, p_size AS year, p_brand AS brand FROM part")
def q35_payload_rows(spark, sf_dir):
    """Records through JSON behind an assignment and back; q66 publishes and reads documents."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_size").alias("year"), F.col("p_brand").alias("brand"))
    wrapped = part.select(F.concat(F.lit("window.DATA = "), F.to_json(F.struct(*part.columns)), F.lit(";")).alias("js"))
    bare = F.regexp_replace(F.regexp_replace("js", r"^window\.DATA = ", ""), ";$", "")
    return wrapped.select(F.from_json(bare, "p_partkey BIGINT, title STRING, year INT, brand STRING").alias("r")).select("r.*")


@query(f"""
    SELECT page_id, substr(regexp_replace(lower(url), '[^a-z0-9]', '_', 'g'), 1, 40) AS id, upper(substr(lang, 1, 1)) || substr(lang, 2) AS label,
           trim(regexp_replace(regexp_replace(title, '\\s*[-|/–—][^-|/–—]*$', ''), '\\s*\\([^)]*\\)', '', 'g')) AS clean,
           regexp_replace(trim(regexp_replace(strip_accents(lower(title)), '[^a-z0-9 ]', '', 'g')), ' +', '-', 'g') AS slug
    FROM (SELECT page_id, url, 'language ' || coalesce(regexp_extract(html, '(?s)<html[^>]*lang="([^"]*)"', 1), '') AS lang, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) || ' (x) - y' AS title FROM pages)""")
def q36_title_slugs(spark, sf_dir):
    """clean titles, slugs and ids."""
    page = F.col("html")
    title = F.concat(F.coalesce(H.inner(page, r"<title[^>]*>(.*?)</title>"), F.lit("")), F.lit(" (x) - y"))
    lang = F.concat(F.lit("language "), F.coalesce(H.inner(page, r'<html[^>]*lang="([^"]*)"'), F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", X.id_slug(F.col("url")).alias("id"), X.capital_first(lang).alias("label"), X.clean_title(title).alias("clean"), X.title_slug(title).alias("slug"))


@query("""
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':' || lpad((o_custkey % 60)::VARCHAR, 2, '0') AS hour,
           ((o_orderkey % 4) * 60 + o_custkey % 60)::INT AS minutes FROM orders""")
def q37_written_times(spark, sf_dir):
    """Dates, clock times and lengths as venues write them."""
    c = F.col
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    dated = T.slashed_date_time(F.concat(F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(", "), two(c("o_orderkey") % 24), F.lit("h"), two(c("o_custkey") % 60)))
    return table(spark, sf_dir, "orders").select("o_orderkey", dated["date"].alias("day"), dated["time"].alias("hour"), T.minutes(F.concat((c("o_orderkey") % 4).cast("string"), F.lit("h"), two(c("o_custkey") % 60))).alias("minutes"))


@query("""
    SELECT event_id, user_id FROM (SELECT *, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM events) WHERE stop = 0""")
def q38_until_marker(spark, sf_dir):
    """What a user did before the first error."""
    return ordered.until_marker(table(spark, sf_dir, "events"), F.col("event_type") == "error", ["user_id"], ["ts", "event_id"]).select("event_id", "user_id")


@query("""
    SELECT p_size % 9 AS key, arg_max(p_brand, p_partkey) AS value FROM part GROUP BY 1""")
def q39_last_wins(spark, sf_dir):
    """Repeated keys of a lookup table: the last entry counts."""
    part = table(spark, sf_dir, "part").select((F.col("p_size") % 9).alias("key"), F.col("p_brand").alias("value"), "p_partkey")
    return ordered.last_wins(part, "key", "value", "p_partkey")


@query("""
    SELECT c_custkey, o.o_orderkey IS NOT NULL AS hit FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o_custkey = c_custkey""")
def q40_cache_hits(spark, sf_dir):
    """Hits and misses of a lookup by a null-safe key."""
    movies = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("title"), F.lit(None).cast("int").alias("year"))
    cache = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("title"), F.lit(None).cast("int").alias("year")).distinct()
    hits, misses = enrich.cache_split(movies, cache)
    return hits.select(F.col("title").cast("long").alias("c_custkey"), F.lit(True).alias("hit")).unionByName(misses.select(F.col("title").cast("long").alias("c_custkey"), F.lit(False).alias("hit")))


# -- functions over texts that are written and read back ------------------------------------------------------------


@query("""
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS en_date, lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':' || lpad((o_custkey % 60)::VARCHAR, 2, '0') AS clock,
           strftime(o_orderdate, '%Y-%m-%d') AS heading_date, (o_custkey % 150 + 1)::INT AS length, year(o_orderdate)::INT AS year, NULL::VARCHAR AS ranged FROM orders""")
def q41_written_dates(spark, sf_dir):
    """English dates, headings, timestamps, clock times and leading numbers; a range has no date."""
    c = F.col
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hour, minute = two(c("o_orderkey") % 24), two(c("o_custkey") % 60)
    english = F.concat(F.upper(F.date_format("o_orderdate", "dd MMM yyyy")), F.lit(" WED "), hour, F.lit(":"), minute)
    heading = T.heading_time(F.concat(F.date_format("o_orderdate", "MMM dd yyyy, EEEE, "), hour, F.lit(":"), minute, F.lit(" ("), (c("o_custkey") % 150 + 1).cast("string"), F.lit("')")))
    stamp = T.iso_parts(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"), hour, F.lit(":"), minute, F.lit(":00Z")))
    told = T.en_date_time(english)
    same = F.when((told["time"] == heading["time"]) & (told["time"] == stamp["time"]) & (told["time"] == T.pt_time(F.concat(hour, F.lit("h"), minute))) & (stamp["date"] == told["date"]), told["time"])
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", told["date"].alias("en_date"), same.alias("clock"), heading["date"].alias("heading_date"), heading["duration"].alias("length"),
        T.leading_int(F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("/97")), 4).alias("year"), T.en_date_time(F.concat(F.lit("1 MAY – "), english))["date"].alias("ranged"),
    )


@query("""
    WITH r AS (SELECT o_orderkey, o_orderdate::DATE AS a, (o_orderdate + to_days((o_custkey % 40)::INT))::DATE AS b FROM orders),
    -- the year is written once, so a range over New Year runs backwards and is empty
    w AS (SELECT o_orderkey, make_date(year(b), month(a), least(day(a), 28)) AS a, make_date(year(b), month(b), least(day(b), 28)) AS b FROM r)
    SELECT o_orderkey, count(*) AS days, min(d)::VARCHAR AS first_day, max(d)::VARCHAR AS last_day
    FROM (SELECT o_orderkey, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS d FROM w WHERE a <= b) GROUP BY o_orderkey""")
def q42_day_range(spark, sf_dir):
    """the days of a written range."""
    a = F.col("o_orderdate")
    b = F.timestamp_add("DAY", (F.col("o_custkey") % 40).cast("int"), a)
    part = lambda d: F.concat(F.least(F.dayofmonth(d), F.lit(28)).cast("string"), F.lit(" "), F.upper(F.date_format(d, "MMM")))
    days = T.ranged_days(F.concat(part(a), F.lit(" – "), part(b), F.lit(" "), F.date_format(b, "yyyy")))
    # an order's days are summed up in its row, not dealt out one by one; dates, unlike text, are aggregated without a sort
    one = T.bound(days, lambda d: F.struct(F.size(d).alias("n"), F.array_min(d).alias("a"), F.array_max(d).alias("z")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", one.alias("r")).select("o_orderkey", "r.*")
    told = rows.groupBy("o_orderkey").agg(F.sum("n").alias("days"), F.min("a").alias("a"), F.max("z").alias("z")).where("days > 0")
    return told.select("o_orderkey", "days", F.col("a").cast("string").alias("first_day"), F.col("z").cast("string").alias("last_day"))


_WORDS = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query(f"""
    SELECT p_partkey, {_WORDS.format('p_name')} || '’s' AS titled, {_WORDS.format('p_name')} || chr(39) || 's' AS worded, strip_accents('É ' || p_name || ' ção') AS bare,
           regexp_replace(upper(p_name) || ' E ' || p_type, '[^A-Z0-9]+', '-', 'g') AS venue, {_WORDS.format('p_name')} AS shown,
           p_name || CASE WHEN p_size % 2 = 0 THEN ', ' || p_brand ELSE '' END AS names,
           CASE WHEN p_size % 3 = 0 THEN {_WORDS.format('p_name')} ELSE 'INDIE ' || p_name END AS indie, p_size % 3 = 0 AS is_indie FROM part""")
def q43_titles(spark, sf_dir):
    """cases, slugs and lists of names."""
    name, capitals = F.col("p_name"), F.upper("p_name")
    indie = X.indie_title(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("INDIE "), capitals, F.lit(" "), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("INDIE "), name)), {})
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.title_case(F.concat(capitals, F.lit("'S"))).alias("titled"), X.word_case(F.concat(capitals, F.lit("'S"))).alias("worded"),
        X.strip_accents(F.concat(F.lit("É "), name, F.lit(" ção"))).alias("bare"), X.venue_slug(F.concat(name, F.lit(" & é "), F.col("p_type"), F.lit("!"))).alias("venue"),
        X.slug_title(F.replace(name, F.lit(" "), F.lit("-"))).alias("shown"), X.joined_names(name, F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("")).alias("names"),
        indie["title"].alias("indie"), indie["is_indie"].alias("is_indie"),
    )


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Presença do realizador e equipa' WHEN c_custkey % 3 = 1 THEN 'Presença da equipa e elenco' ELSE 'presença de ' || c_name END AS guests,
           c_name AS head, CASE WHEN c_custkey % 2 = 0 THEN 'Sessão de Abertura' END AS suffix,
           CASE c_custkey % 4 WHEN 0 THEN 'Legendas em inglês|Última sessão' WHEN 1 THEN 'Sessão especial' WHEN 2 THEN 'Última sessão' ELSE '' END AS keywords,
           CASE c_custkey % 3 WHEN 0 THEN 'Com a presença de ' || c_name WHEN 1 THEN 'Conversa com ' || c_name END AS info,
           CASE WHEN c_custkey % 2 = 0 THEN 'Drama' ELSE 'Ficção Científica' END || '|New Wave' AS genres FROM customer""")
def q44_labels(spark, sf_dir):
    """Labels and genres."""
    from .sources.sao_jorge import genres

    c, name = F.col("c_custkey"), F.col("c_name")
    guests = F.when(c % 3 == 0, F.concat(F.lit("Presença do realizador, "), name)).when(c % 3 == 1, F.concat(F.lit("presença dos actores A, B e "), name)).otherwise(F.concat(F.lit("presença de "), name))
    suffix = X.special_suffix(F.concat(name, F.when(c % 2 == 0, F.lit(" | SESSÃO DE ABERTURA")).otherwise("")))
    line = F.when(c % 4 == 0, F.lit("with English subtitles - ÚLTIMA SESSÃO")).when(c % 4 == 1, F.lit("SESSAO ESPECIAL")).when(c % 4 == 2, F.lit("última sessao")).otherwise("21h00")
    info = F.when(c % 3 == 0, F.concat(F.lit("Sessão com a presença de "), name)).when(c % 3 == 1, F.concat(F.lit("conversa com "), name)).otherwise(F.lit("legendado"))
    classes = F.array(F.lit("event"), F.when(c % 2 == 0, F.lit("genre-drama")).otherwise("genre-ficcao-cientifica"), F.lit("genre-new-wave"), F.lit("genre-new-wave"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", X.presence_label(guests).alias("guests"), suffix["title"].alias("head"), suffix["label"].alias("suffix"), F.array_join(X.keyword_labels(line), "|").alias("keywords"),
        X.info_label(info).alias("info"), F.array_join(genres(classes), "|").alias("genres"),
    )


@query("""
    SELECT p_partkey, p_name || ' & <' || p_brand || '> é' AS plain, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE p_type END AS told,
           array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS linked FROM part""")
def q45_markup(spark, sf_dir):
    """entities, texts by language, the titles of links."""
    from .sources.fernando import bare_title, tidy

    size, name = F.col("p_size") % 3, F.col("p_name")
    entry = lambda k, v: F.concat(F.lit(f'{{"{k}": "<b>'), v, F.lit('</b>"}'))
    value = F.when(size == 0, entry("all", name)).when(size == 1, entry("en", F.col("p_brand"))).otherwise(F.concat(F.lit(" <i>"), F.col("p_type"), F.lit("</i>")))
    link = F.concat(F.lit("- <i>"), F.upper(name), F.lit("</i> <small>x</small> - última sessão <b>mostra</b>"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(name, F.lit(" &amp; &lt;"), F.col("p_brand"), F.lit("&gt; &eacute;")).alias("coded"), value.alias("value"), link.alias("link"))
    return rows.select("p_partkey", H.unescape(F.col("coded")).alias("plain"), H.localised(F.col("value")).alias("told"), tidy(H.unescape(bare_title(F.col("link")))).alias("linked"))


# -- lookups, on movies and catalogues made of parts ----------------------------------------------------------------

_MOVIES = """movies AS (SELECT p_partkey, p_name AS clean, CASE WHEN p_partkey % 4 = 0 THEN lower(p_type) END AS original, p_brand AS director, 1990 + p_size % 10 AS y FROM part)"""
_ALIASES = """aliases AS (SELECT upper(p_name) || CASE WHEN p_size = 2 THEN '' ELSE ' (' || p_type || ')' END AS key, arg_max(replace(p_name, ' ', '-') || '-1991', p_partkey) AS slug, arg_max(p_name || ' ii', p_partkey) AS title FROM part WHERE p_size IN (2, 3) GROUP BY 1),
    asked AS (SELECT m.*, coalesce(a.slug, b.slug) AS alias_slug, coalesce(a.title, b.title) AS alias_title FROM movies m
        LEFT JOIN aliases a ON a.key = upper(clean) || CASE WHEN original IS NULL THEN '' ELSE ' (' || upper(original) || ')' END LEFT JOIN aliases b ON b.key = upper(clean))"""
_LBXD = """lbxd AS (SELECT slug, CASE WHEN k % 3 <> 0 THEN k % 5 END AS rating, CASE WHEN k % 2 = 0 THEN 'p' || k END AS poster, CASE WHEN k % 4 <> 0 THEN brand END AS lb_director FROM (
        SELECT slug, max(p_partkey) AS k, min(p_brand) AS brand FROM (
            SELECT p_partkey, p_brand, replace(p_name, ' ', '-') || '-' || (1990 + p_size % 10) AS slug FROM part WHERE p_size % 2 = 0
            UNION ALL SELECT p_partkey, p_brand, lower(p_type) FROM part UNION ALL SELECT p_partkey, p_brand, replace(p_name, ' ', '-') FROM part) GROUP BY slug)),
    slugs AS (SELECT p_partkey, director, unnest(s) AS slug, generate_subscripts(s, 1) AS pos FROM (SELECT *, [alias_slug, original || '-' || y, original || '-' || (y - 1), original || '-' || (y - 2), original,
        replace(clean, ' ', '-') || '-' || y, replace(clean, ' ', '-') || '-' || (y - 1), replace(clean, ' ', '-') || '-' || (y - 2), replace(clean, ' ', '-')] AS s FROM asked)),
    best AS (SELECT * FROM (SELECT p_partkey, rating, poster, lb_director, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN coalesce(rating, 0) <> 0 THEN 0 ELSE 1 END, pos) AS n
        FROM slugs JOIN lbxd USING (slug) WHERE (coalesce(rating, 0) <> 0 OR poster IS NOT NULL) AND (lb_director IS NULL OR contains(lower(lb_director), lower(director)))) WHERE n = 1)"""
_OMDB = """omdb AS (SELECT t, qy, k % 7 <> 0 AS good, (qy + k % 5)::VARCHAR AS yr, CASE WHEN k % 6 = 0 THEN 'N/A' ELSE brand END AS who, t || CASE WHEN k % 5 = 0 THEN ' and what came after that' ELSE '' END AS found, CASE WHEN k % 3 = 0 THEN 'N/A' ELSE 'o' || k END AS poster FROM (
        SELECT t, qy, max(p_partkey) AS k, max(p_brand) AS brand FROM (SELECT p_partkey, p_brand, p_name AS t, CASE WHEN p_size % 3 > 0 THEN 1990 + p_size % 10 END AS qy FROM part
            UNION ALL SELECT p_partkey, p_brand, p_name || ' ii', 1990 + p_size % 10 FROM part UNION ALL SELECT p_partkey, p_brand, upper(p_type), NULL FROM part) GROUP BY t, qy)),
    attempts AS (SELECT p_partkey, director, unnest(a).t AS t, unnest(a).qy AS qy, generate_subscripts(a, 1) AS pos FROM (SELECT *, CASE WHEN original IS NULL THEN
        [{'t': clean, 'qy': y}, {'t': clean, 'qy': y - 1}, {'t': clean, 'qy': y - 2}, {'t': alias_title, 'qy': y}, {'t': alias_title, 'qy': y - 1}, {'t': alias_title, 'qy': y - 2}, {'t': clean, 'qy': NULL}, {'t': alias_title, 'qy': NULL}]
        ELSE [{'t': upper(original), 'qy': y}, {'t': upper(original), 'qy': y - 1}, {'t': upper(original), 'qy': y - 2}, {'t': upper(original), 'qy': NULL},
        {'t': alias_title, 'qy': y}, {'t': alias_title, 'qy': y - 1}, {'t': alias_title, 'qy': y - 2}, {'t': alias_title, 'qy': NULL}] END AS a FROM asked)),
    taken AS (SELECT * FROM (SELECT p_partkey, found, yr, who, poster, row_number() OVER (PARTITION BY p_partkey ORDER BY pos) AS n FROM attempts JOIN omdb ON omdb.t = attempts.t AND omdb.qy IS NOT DISTINCT FROM attempts.qy
        WHERE good AND who <> 'N/A' AND contains(lower(who), lower(director)) AND coalesce(abs(yr::INT - attempts.qy) <= 2, true) AND NOT (found <> attempts.t AND length(attempts.t) / length(found) < 0.6)) WHERE n = 1)"""


def _movies(spark, sf_dir):
    part, c = table(spark, sf_dir, "part"), F.col
    have = {
        "id": c("p_partkey").cast("string"), "src_rank": F.lit(0), "src_ord": c("p_partkey").cast("int"), "director": c("p_brand"), "year": (1990 + c("p_size") % 10).cast("int"),
        "title": F.concat("p_name", F.when(c("p_partkey") % 4 == 0, F.concat(F.lit(" ("), c("p_type"), F.lit(")"))).otherwise("")), "poster": F.when(c("p_size") % 3 == 0, F.lit("own.jpg")).when(c("p_size") % 3 == 1, F.lit("placeholder-2-i.jpg")),
        "duration": F.when(c("p_size") % 4 == 0, c("p_size")), "sessions": F.when(c("p_size") % 5 > 0, F.array(F.struct(F.concat(F.lit("2026-01-"), F.lpad(c("p_size").cast("string"), 2, "0")).alias("date"), F.lit("10:00").alias("time"), c("p_type").alias("cinema"), F.lit(None).cast("array<string>").alias("labels")))),
    }
    return as_movies(part.select(*[v.alias(k) for k, v in have.items()]), 0)


def _aliases(spark, sf_dir, value):
    part = table(spark, sf_dir, "part").where("p_size in (2, 3)")
    key = F.concat(F.upper("p_name"), F.when(F.col("p_size") == 2, F.lit("")).otherwise(F.concat(F.lit(" ("), F.col("p_type"), F.lit(")"))))
    return part.select(key.alias("key"), value.alias("value"), F.col("p_partkey").cast("int").alias("ordinal"))


def _slug_aliases(spark, sf_dir):
    return _aliases(spark, sf_dir, F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-1991")))


def _title_aliases(spark, sf_dir):
    return _aliases(spark, sf_dir, F.concat("p_name", F.lit(" ii")))


def _lbxd(spark, sf_dir):
    part, c = table(spark, sf_dir, "part"), F.col
    slug = F.replace("p_name", F.lit(" "), F.lit("-"))
    dated = F.when(c("p_size") % 2 == 0, F.concat(slug, F.lit("-"), (1990 + c("p_size") % 10).cast("string")))
    rows = part.select("p_partkey", "p_brand", F.explode(F.array_compact(F.array(dated, F.lower("p_type"), slug))).alias("slug")).groupBy("slug").agg(F.max("p_partkey").alias("k"), F.min("p_brand").alias("b"))
    none = F.lit(None).cast("string")
    return rows.select("slug", F.when(c("k") % 3 != 0, (c("k") % 5).cast("double")).alias("rating"), F.when(c("k") % 2 == 0, F.concat(F.lit("p"), c("k").cast("string"))).alias("poster"), none.alias("description"), F.lit(None).cast("array<string>").alias("genres"),
                       none.alias("country"), F.when(c("k") % 4 != 0, c("b")).alias("lb_director"), none.alias("lb_director_slug"), F.lit(None).cast("int").alias("lb_year"))


def _omdb(spark, sf_dir):
    part, c = table(spark, sf_dir, "part"), F.col
    year = (1990 + c("p_size") % 10).cast("int")
    asked = F.array(F.struct(c("p_name").alias("t"), F.when(c("p_size") % 3 > 0, year).alias("qy")), F.struct(F.concat("p_name", F.lit(" ii")).alias("t"), year.alias("qy")), F.struct(F.upper("p_type").alias("t"), F.lit(None).cast("int").alias("qy")))
    rows = part.select("p_partkey", "p_brand", F.inline(asked)).groupBy("t", "qy").agg(F.max("p_partkey").alias("k"), F.max("p_brand").alias("b"))
    na, none = F.lit("N/A"), F.lit(None).cast("string")
    return rows.select(c("t").alias("query_title"), c("qy").alias("query_year"), F.when(c("k") % 7 != 0, "True").otherwise("False").alias("Response"), F.concat("t", F.when(c("k") % 5 == 0, F.lit(" and what came after that")).otherwise("")).alias("Title"),
                       (c("qy") + c("k") % 5).cast("string").alias("Year"), F.when(c("k") % 6 == 0, na).otherwise(c("b")).alias("Director"), F.when(c("k") % 3 == 0, na).otherwise(F.concat(F.lit("o"), c("k").cast("string"))).alias("Poster"),
                       none.alias("Genre"), none.alias("Plot"), none.alias("Country"), F.lit("95 min").alias("Runtime"))


@query(f"WITH {_MOVIES}, {_ALIASES}, {_LBXD} SELECT p_partkey::VARCHAR AS id, rating::DOUBLE AS rating, poster, lb_director FROM best")
def q46_catalogue_lookup(spark, sf_dir):
    """Aliases, then slugs by title and year; the first with a rating, else with a poster, whose director agrees."""
    return enrich.lbxd_lookup(_movies(spark, sf_dir), _lbxd(spark, sf_dir), _slug_aliases(spark, sf_dir)).select("id", "rating", "poster", "lb_director")


@query(f"WITH {_MOVIES}, {_ALIASES}, {_OMDB} SELECT p_partkey::VARCHAR AS id, found AS title, yr AS year, who AS director FROM taken")
def q47_title_lookup(spark, sf_dir):
    """Attempts by title and year; the first whose director, year and title agree."""
    found = enrich.omdb_lookup(_movies(spark, sf_dir), _omdb(spark, sf_dir), _title_aliases(spark, sf_dir))
    return found.select("id", F.col("om_Title").alias("title"), F.col("om_Year").alias("year"), F.col("om_Director").alias("director"))


@query(f"""
    WITH {_MOVIES}, {_ALIASES}, {_LBXD}, {_OMDB}
    SELECT p_partkey::VARCHAR AS id, coalesce(b.poster, CASE WHEN p_size % 3 = 0 THEN 'own.jpg' END, nullif(t.poster, 'N/A')) AS poster, nullif(b.rating, 0)::DOUBLE AS rating,
           1990 + p_size % 10 AS year, p_brand AS director, CASE WHEN p_size % 4 = 0 AND p_size <> 0 THEN p_size WHEN t.p_partkey IS NOT NULL THEN 95 END AS duration
    FROM part LEFT JOIN best b USING (p_partkey) LEFT JOIN taken t USING (p_partkey)""")
def q48_resolved_fields(spark, sf_dir):
    """2.H: which value wins for poster, rating, year, director and length."""
    done = enrich.enrich(_movies(spark, sf_dir), _lbxd(spark, sf_dir), _omdb(spark, sf_dir), _slug_aliases(spark, sf_dir), _title_aliases(spark, sf_dir))
    return done.select("id", "poster", "rating", "year", "director", "duration")


@query("""
    SELECT p_partkey::VARCHAR AS id, '2026-01-' || lpad(p_size::VARCHAR, 2, '0') AS date FROM part WHERE p_size % 5 > 0 AND p_size >= 20""")
def q49_upcoming(spark, sf_dir):
    """Sessions from a day on; movies without any go."""
    shown = refresh.upcoming(_movies(spark, sf_dir), F.lit("2026-01-20").cast("date"))
    return shown.select("id", F.explode("sessions").alias("s")).select("id", "s.date")


@query("""
    SELECT count(*) AS movies, count(*) FILTER (WHERE p_size % 5 > 0) AS sessions, (SELECT string_agg(r_name, ',' ORDER BY r_name) FROM region) AS failed FROM part""")
def q50_metrics(spark, sf_dir):
    """K3: movies, sessions, failed venues."""
    failed = table(spark, sf_dir, "region").select(F.col("r_name").alias("cinema"), F.lit("x").alias("error"))
    movies = _movies(spark, sf_dir).withColumn("sessions", F.coalesce("sessions", F.array().cast(f"array<{SESSION}>")))
    return publish.metrics(movies, failed).select("movies", F.col("sessions").cast("long").alias("sessions"), F.array_join("failed", ",").alias("failed"))


# -- payloads, collations, spans, figures ---------------------------------------------------------------------------


@query("SELECT event_id, (props ->> '$.k')::INT AS k, props ->> '$.none' AS missing FROM events")
def q51_variant_fields(spark, sf_dir):
    """Fields of a payload without a fixed schema."""
    rows = table(spark, sf_dir, "events").withColumn("v", P.variant(F.col("props")))
    return rows.select("event_id", P.at(F.col("v"), "$.k", "int").alias("k"), P.at(F.col("v"), "$.none").alias("missing"))


@query("""
    WITH c AS (SELECT click_id, props -> '$.items' AS items, props ->> '$.device.os' AS os FROM clicks WHERE json_valid(props)),
    e AS (SELECT click_id, os, unnest(items::JSON[]) AS item, generate_subscripts(items::JSON[], 1) - 1 AS pos FROM c WHERE json_type(items) = 'ARRAY')
    SELECT click_id, os, pos::INT AS pos, (item ->> '$.sku')::BIGINT AS sku, (item ->> '$.qty')::BIGINT AS qty FROM e""")
def q52_variant_entries(spark, sf_dir):
    """The elements of lists within payloads that may lack them."""
    rows = P.entries(table(spark, sf_dir, "clicks").select("click_id", P.variant(F.col("props")).alias("v")), "v", "$.items")
    return rows.select("click_id", P.at(F.col("v"), "$.device.os").alias("os"), "pos", P.at(F.col("entry"), "$.sku", "long").alias("sku"), P.at(F.col("entry"), "$.qty", "long").alias("qty"))


@query("""
    WITH n AS (SELECT client_id, lower(strip_accents(name)) AS k FROM clients WHERE name IS NOT NULL), c AS (SELECT client_id AS other, lower(strip_accents(upper(name))) AS k FROM clients WHERE name IS NOT NULL)
    SELECT n.client_id, count(*) AS same, min(other) AS first FROM n JOIN c USING (k) GROUP BY 1""")
def q53_names_agree(spark, sf_dir):
    """Names that agree but for case and accents, joined by a collation."""
    named = table(spark, sf_dir, "clients").where("name is not null")
    by_name = named.select(F.col("client_id").alias("other"), X.folded(F.upper("name")).alias("k")).groupBy("k").agg(F.count("*").alias("same"), F.min("other").alias("first"))
    return named.select("client_id", X.folded(F.col("name")).alias("k")).join(by_name, "k").select("client_id", "same", "first")


@query(r"""
    WITH p AS (SELECT page_id, string_split_regex(html, '<a\s[^>]*>') AS parts, regexp_extract_all(html, '<a\s[^>]*>') AS found FROM pages),
    e AS (SELECT page_id, unnest(found) AS match, generate_subscripts(found, 1) AS k, parts, found FROM p)
    SELECT page_id, (k - 1)::INT AS pos, (coalesce(list_sum(list_transform(parts[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0))::BIGINT AS start, match FROM e""")
def q54_match_spans(spark, sf_dir):
    """Where the matches of a pattern begin."""
    found = H.matches(table(spark, sf_dir, "pages"), ["page_id"], "html", r"<a\s[^>]*>")
    return found.select("page_id", "pos", "start", "match")


@query("""
    SELECT count(*) AS movies, count(*) FILTER (WHERE p_size % 5 > 0) AS sessions, (SELECT string_agg(r_name, ',' ORDER BY r_name) FROM region) AS failed FROM part""")
def q55_observed_metrics(spark, sf_dir):
    """K3: the same figures as q50, taken while the frames are written, without a scan of their own."""
    failed = table(spark, sf_dir, "region").select(F.col("r_name").alias("cinema"), F.lit("x").alias("error"))
    movies = _movies(spark, sf_dir).withColumn("sessions", F.coalesce("sessions", F.array().cast(f"array<{SESSION}>")))
    movies, failed, one, two = sink.observed(movies, failed)
    for frame in (movies, failed):
        frame.write.format("noop").mode("overwrite").save()
    figures = one.get | two.get
    return spark.createDataFrame([(figures["movies"], figures["sessions"], ",".join(figures["failed"]))], "movies long, sessions long, failed string")


# -- parsers and stores over pages written out from the tables -------------------------------------------------------

_AT = "2026-03-20 08:00:00"


def _landing(rows, source, url, body):
    """model.LANDING of one page for each row."""
    return rows.select(F.lit(source).alias("source"), url.alias("url"), F.lit(_AT).cast("timestamp").alias("fetched_at"), F.lit(200).alias("status"), body.alias("body"))


@query("""
    SELECT 'trindade_' || p_partkey AS id, p_name AS title, 1990 + p_size AS year, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 60 + p_size END AS duration,
           CASE WHEN p_size % 4 = 0 THEN NULL ELSE (SELECT n_name FROM nation WHERE n_nationkey = p_size % 25) || ', ' || (SELECT n_name FROM nation WHERE n_nationkey = (p_size + 1) % 25) END AS director,
           CASE WHEN p_size % 5 > 0 THEN 'https://img/' || (p_size % 5) END AS poster, '2026-04-' || lpad((1 + p_size % 28)::VARCHAR, 2, '0') AS date, '21:30' AS time, CASE WHEN p_size % 2 = 0 THEN p_type END AS labels
    FROM part""")
def q56_hydration_films(spark, sf_dir):
    """A venue's films from records in hydration payloads, directors and posters from keyed records."""
    size, c = F.col("p_size"), F.col
    shown = F.struct(F.concat(F.lit("2026-04-"), F.lpad((1 + size % 28).cast("string"), 2, "0")).alias("date"), F.struct(F.lit("21:30").alias("start")).alias("time"), F.when(size % 2 == 0, F.concat(F.lit(" "), c("p_type"))).alias("notes"))
    people = F.when(size % 4 == 0, F.array().cast("array<int>")).otherwise(F.array(size % 25, (size + 1) % 25))
    film = F.struct(c("p_partkey").alias("id"), F.concat(F.lit("s"), c("p_partkey")).alias("slug"), c("p_name").alias("title"), (1990 + size).alias("year"), F.when(size % 3 > 0, 60 + size).alias("runtime"),
                    F.when(size % 5 > 0, size % 5).alias("poster"), people.alias("directors"), F.array(shown, shown.withField("date", F.lit("2026-01-01"))).alias("sessions"))
    pad = F.lit(" " * 1000)
    part = table(spark, sf_dir, "part").withColumn("film", F.to_json(film)).groupBy((c("p_partkey") % 1000).alias("page")).agg(F.collect_list("film").alias("films"))
    script = F.concat(F.lit("<script>x</script><script>"), F.to_json(F.concat(F.array(F.lit("x"), pad), c("films"))), F.lit("</script>"))
    pages = _landing(part, "trindade", F.concat(F.lit("https://t/programa/"), "page"), script)
    named = _landing(table(spark, sf_dir, "nation"), "trindade", F.concat(F.lit("https://t/directors/"), "n_nationkey"), F.to_json(F.struct(F.struct(c("n_name").alias("rendered")).alias("title"))))
    images = _landing(spark.range(1, 5), "trindade", F.concat(F.lit("https://t/media/"), "id"), F.to_json(F.struct(F.concat(F.lit("https://img/"), "id").alias("source_url"))))
    films = trindade.parse(pages.unionByName(named).unionByName(images), F.lit("2026-03-20").cast("date"), 0)
    return films.select("id", "title", "year", "duration", "director", "poster", F.explode("sessions").alias("s")).select("id", "title", "year", "duration", "director", "poster", "s.date", "s.time", F.array_join("s.labels", ",").alias("labels"))


@query("""
    SELECT 'nimas_f' || p_partkey AS id, p_name AS title, nullif(CASE WHEN p_size % 4 > 0 THEN p_brand ELSE '' END, '') AS director, 1990 + p_size AS year, 60 + p_size AS duration, '2026-04-' || lpad((1 + p_size % 28)::VARCHAR, 2, '0') AS date, unnest(['21:30', '15:00']) AS time
    FROM part WHERE p_size % 3 > 0""")
def q57_script_events(spark, sf_dir):
    """A house's list page and film pages, JSON in scripts; what is shown elsewhere is left out."""
    size, c = F.col("p_size"), F.col
    part = table(spark, sf_dir, "part")
    url = F.concat(F.lit("https://m/filmes/f"), "p_partkey")
    script = lambda data: F.concat(F.lit("<script>var x;</script><script>global.data = "), F.to_json(data), F.lit(";</script>"))
    event = F.struct(c("p_name").alias("title"), F.when(size % 4 > 0, c("p_brand")).otherwise("").alias("director"), url.alias("url"), F.create_map(F.when(size % 3 > 0, F.lit("cinema-medeia-nimas")).otherwise(F.lit("elsewhere")), F.lit("{}")).alias("theaters"))
    lists = part.withColumn("event", event).groupBy((c("p_partkey") % 1000).alias("page")).agg(F.map_from_entries(F.collect_list(F.struct(c("p_partkey").cast("string"), "event"))).alias("events"))
    lists = _landing(lists, "medeia", F.concat(F.lit("https://m/filmes-em-exibicao/"), "page"), script(F.struct(F.struct("events").alias("schedule"))))
    date = F.concat(F.lit("2026-04-"), F.lpad((1 + size % 28).cast("string"), 2, "0"))
    shown = F.struct(date.alias("date"), F.array(F.lit("21:30"), F.lit("15:00")).alias("hours"), F.create_map().cast("map<string, struct<type: string, text: string>>").alias("info"))
    programme = F.create_map(F.lit("a"), F.struct(F.lit("cinema-medeia-nimas").alias("slug"), F.create_map(F.lit("s"), shown).alias("sessions")), F.lit("b"), F.struct(F.lit("elsewhere").alias("slug"), F.create_map(F.lit("s"), shown).alias("sessions")))
    length = F.concat(F.floor((60 + size) / 60), F.lit("h"), F.lpad(((60 + size) % 60).cast("string"), 2, "0"))
    films = _landing(part, "medeia", url, script(F.struct(F.struct(F.concat((1990 + size).cast("string"), F.lit("/2")).alias("production_year"), length.alias("length"), programme.alias("programme")).alias("film"))))
    movies = medeia.parse(lists.unionByName(films), F.lit("2026-03-20").cast("date"), 0, "nimas", "cinema-medeia-nimas")
    return movies.select("id", "title", "director", "year", "duration", F.explode("sessions").alias("s")).select("id", "title", "director", "year", "duration", "s.date", "s.time")


@query("""
    SELECT 'p' || p_partkey AS slug, (p_size % 10 / 2.0)::DOUBLE AS rating, 'https://a.ltrbxd.com/' || p_partkey || '-0-500-0-750-crop.jpg' AS poster, p_type || ' & <more>' AS description,
           CASE WHEN p_size % 3 > 0 THEN 'Science Fiction,War' END AS genres, CASE WHEN p_size % 4 > 0 THEN p_brand END AS country, p_name AS lb_director, 1990 + p_size AS lb_year
    FROM part""")
def q58_catalogue_pages(spark, sf_dir):
    """Catalogue records from film pages."""
    size, c = F.col("p_size"), F.col
    page = F.concat(
        F.lit("<title>A film ("), (1990 + size).cast("string"), F.lit(") directed</title><meta name=\"twitter:data2\" content=\""), F.format_number((size % 10) / 2, 1), F.lit(" out\">"), F.lit('<script>"image": "https://a.ltrbxd.com/'), c("p_partkey").cast("string"),
        F.lit('-0-230-0-345-crop.jpg"</script><meta property="og:description" content=" '), c("p_type"), F.lit(' &amp; &lt;more&gt; ">'), F.when(size % 3 > 0, F.lit('<a href="/films/genre/science-fiction/">x</a><a href="/films/genre/war/">y</a><a href="/films/genre/war/">y</a>')).otherwise(""),
        F.when(size % 4 > 0, F.concat(F.lit('<a href="/films/country/x/"> '), c("p_brand"), F.lit(" </a>"))).otherwise(""), F.lit('<a href="/director/d/"> '), c("p_name"), F.lit(" </a>"),
    )
    found = catalogue.lbxd_pages(_landing(table(spark, sf_dir, "part"), "lbxd", F.concat(F.lit("https://l/film/p"), c("p_partkey"), F.lit("/")), page))
    return found.select("slug", "rating", "poster", "description", F.array_join("genres", ",").alias("genres"), "country", "lb_director", "lb_year")


@query("""
    SELECT p_name || ' ' || p_partkey AS query_title, CASE WHEN p_size % 2 = 0 THEN 1990 + p_size END AS query_year, 'True' AS response, p_type AS title, (1990 + p_size)::VARCHAR AS year FROM part""")
def q59_query_records(spark, sf_dir):
    """Catalogue records by query; the query is in the address."""
    size, c = F.col("p_size"), F.col
    url = F.concat(F.lit("https://o/?t="), F.url_encode(F.concat_ws(" ", "p_name", c("p_partkey").cast("string"))), F.when(size % 2 == 0, F.concat(F.lit("&y="), (1990 + size).cast("string"))).otherwise(F.lit("&y=")))
    body = F.to_json(F.struct(F.lit("True").alias("Response"), c("p_type").alias("Title"), (1990 + size).cast("string").alias("Year")))
    return catalogue.omdb_records(_landing(table(spark, sf_dir, "part"), "omdb", url, body)).select("query_title", "query_year", c("Response").alias("response"), c("Title").alias("title"), c("Year").alias("year"))


@query("""
    SELECT c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'photo' || c_custkey WHEN c_custkey % 2 = 0 THEN 'https://commons.wikimedia.org/wiki/Special:FilePath/' || c_custkey || '_b.jpg?width=300' END AS photo,
           CASE WHEN c_custkey % 5 > 0 THEN 'One. Two. Three.' WHEN c_custkey % 3 > 0 AND c_custkey % 2 = 0 THEN c_mktsegment END AS bio
    FROM customer""")
def q60_people(spark, sf_dir):
    """Photo and biography of people: the page's, else those of the best search hit."""
    c, k = F.col, F.col("c_custkey")
    people = table(spark, sf_dir, "customer")
    asked = lambda base: F.concat(F.lit(base), F.url_encode("c_name"))
    page = F.struct(F.when(k % 5 > 0, F.lit("One. Two. Three. Four.")).otherwise(F.lit("")).alias("extract"), F.when(k % 3 == 0, F.struct(F.concat(F.lit("photo"), k).alias("source"))).alias("thumbnail"))
    wiki = _landing(people, "wiki", asked("https://w/?titles="), F.to_json(F.struct(F.struct(F.create_map(k.cast("string"), page).alias("pages")).alias("query"))))
    hit = lambda mark, label: F.struct(F.concat(F.lit(mark), k).alias("id"), label.alias("label"))
    search = _landing(people, "wikidata_search", asked("https://d/?search="), F.to_json(F.struct(F.array(hit("X", F.lit("Other")), hit("Q", F.upper("c_name"))).alias("search"))))
    image = F.struct(F.array(F.struct(F.struct(F.struct(F.concat(k.cast("string"), F.lit(" b.jpg")).alias("value")).alias("datavalue")).alias("mainsnak"))).alias("P18"))
    entity = F.struct(image.alias("claims"), F.struct(F.struct(c("c_mktsegment").alias("value")).alias("en")).alias("descriptions"))
    entities = _landing(people.where(k % 2 == 0), "wikidata_entity", F.concat(F.lit("https://d/entity/Q"), k), F.to_json(entity))
    return enrich.wiki_entries(catalogue.wiki_pages(wiki), catalogue.wikidata_search(search), catalogue.wikidata_entities(entities))


@query("""
    SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1""")
def q61_keyed_table(spark, sf_dir):
    """A keyed table over two runs: the later run's rows replace the earlier ones; a lookup of every key."""
    orders = table(spark, sf_dir, "orders")
    middle = orders.agg(F.expr("percentile_approx(o_orderkey, 0.5)")).first()[0]
    newest = lambda rows: rows.groupBy(F.col("o_custkey").alias("k")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    kept = KeyedTable(spark, place(spark, "q61"), "k BIGINT, status STRING", ["k"])
    for rows in (orders.where(F.col("o_orderkey") <= middle), orders.where(F.col("o_orderkey") > middle)):
        kept.put(newest(rows))
    return kept.look_up(orders.select(F.col("o_custkey").alias("k")))


@query("""
    WITH pages AS (SELECT 'https://n/page/' || p_partkey AS url, p_name AS body, p_size FROM part)
    SELECT l_orderkey AS id, l_linenumber AS line, body FROM lineitem JOIN pages ON url = 'https://n/page/' || l_partkey WHERE p_size % 4 > 0""")
def q62_looked_up_pages(spark, sf_dir):
    """Details from landed pages by their address, from the folder by source and shard."""
    part, c = table(spark, sf_dir, "part"), F.col
    page = lambda key: F.concat(F.lit("https://n/page/"), key)
    path = place(spark, "q62")
    good = _landing(part, "n", page(c("p_partkey")), c("p_name"))
    older = good.withColumns({"fetched_at": c("fetched_at") - F.expr("interval 1 day"), "body": F.lit("older")})
    store.land(good.where(F.col("p_size") % 4 > 0).unionByName(older.where(F.col("p_size") % 4 > 0)).unionByName(good.where(F.col("p_size") % 4 == 0).withColumn("status", F.lit(500))), path)
    wanted = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("id"), c("l_linenumber").alias("line"), page(c("l_partkey")).alias("url"))
    return store.looked_up(wanted, store.landed(spark, path), "n").select("id", "line", "body")


@query("""
    SELECT DISTINCT 'medeia' AS source, 'https://m/filmes/f' || p_partkey AS url FROM part WHERE p_size % 2 > 0 AND p_size % 5 > 0""")
def q63_frontier(spark, sf_dir):
    """The addresses that landed list pages lead to, without those that have landed."""
    size, c = F.col("p_size"), F.col
    part = table(spark, sf_dir, "part")
    url = F.concat(F.when(size % 2 > 0, F.lit("https://m/filmes/f")).otherwise(F.lit("https://m/eventos/f")), "p_partkey")
    lists = part.withColumn("event", F.struct(c("p_name").alias("title"), url.alias("url"))).groupBy((c("p_partkey") % 1000).alias("page")).agg(F.map_from_entries(F.collect_list(F.struct(c("p_partkey").cast("string"), "event"))).alias("events"))
    script = F.concat(F.lit("<script>global.data = "), F.to_json(F.struct(F.struct("events").alias("schedule"))), F.lit(";</script>"))
    landed = _landing(lists, "medeia", F.concat(F.lit("https://m/filmes-em-exibicao/"), "page"), script).unionByName(_landing(part.where(size % 5 == 0), "medeia", url, F.lit("x")))
    return frontier.frontier(landed, F.lit("2026-03-20").cast("date"), starts=()).select("source", "url")


@query("""
    SELECT 'sao_jorge_' || p_partkey AS id, p_name AS title, CASE WHEN p_size % 4 > 0 THEN 'João da Silva' END AS director, CASE WHEN p_size % 5 > 0 THEN 60 + p_size END AS duration, CASE WHEN p_size % 2 = 0 THEN 'Festa ' || p_brand END AS festival,
           'Drama,Ficção Científica,New Wave' AS genres, '2026-04-' || lpad((1 + p_size % 28)::VARCHAR, 2, '0') AS date, unnest(['15:00', '21:30']) AS time
    FROM part WHERE p_size % 3 > 0""")
def q64_events_and_details(spark, sf_dir):
    """Events that are films, with what their pages say."""
    size, c = F.col("p_size"), F.col
    part = table(spark, sf_dir, "part")
    link = F.concat(F.lit("https://s/e"), "p_partkey")
    classes = F.array(F.when(size % 3 > 0, F.lit("categoria-de-evento-filme")).otherwise(F.lit("categoria-de-evento-concerto")), F.lit("genre-drama"), F.lit("genre-ficcao-cientifica"), F.lit("genre-new-wave"), F.lit("genre-drama"))
    event = F.struct(c("p_partkey").alias("id"), link.alias("link"), classes.alias("class_list"), F.struct(c("p_name").alias("rendered")).alias("title"))
    lists = part.withColumn("event", event).groupBy((c("p_partkey") % 1000).alias("page")).agg(F.to_json(F.collect_list("event")).alias("events"))
    date = F.concat(F.lit('<time datetime="2026-04-'), F.lpad((1 + size % 28).cast("string"), 2, "0"), F.lit('">x</time> '))
    page = F.concat(
        F.lit("<style>9'</style><script>99' x</script>"), F.when(size % 2 == 0, F.concat(F.lit('<span id="x" class="big tag x">Festa '), c("p_brand"), F.lit("</span>"))).otherwise(F.lit('<span class="tag">M/12</span>')),
        F.when(size % 5 > 0, F.concat((60 + size).cast("string"), F.lit("' "))).otherwise(""), F.when(size % 4 > 0, F.lit("Realização <b>João da Silva</b> Com Rita Blanco ")).otherwise(F.lit("Com Rita ")),
        date, F.lit('<time datetime="21:30">x</time>'), date, F.lit('<time datetime="15:00">x</time>'), date, F.lit('<time datetime="21:30">x</time>'),
    )
    landed = _landing(lists, "sao_jorge", F.concat(F.lit("https://s/wp-json/"), "page"), c("events")).unionByName(_landing(part, "sao_jorge", link, page))
    movies = sao_jorge.parse(landed, F.lit("2026-03-20").cast("date"), 0)
    return movies.select("id", "title", "director", "duration", "festival", F.array_join("genres", ",").alias("genres"), F.explode("sessions").alias("s")).select("id", "title", "director", "duration", "festival", "genres", "s.date", "s.time")


@query("""
    SELECT 'cinemateca_' || p_partkey AS id, 'Film ' || p_partkey AS title, 'Ana Sá' AS director, 1950 + p_size AS year, 60 + p_size AS duration, unnest(['2026-04-' || lpad((1 + p_size % 14)::VARCHAR, 2, '0'), '2026-04-' || lpad((15 + p_size % 14)::VARCHAR, 2, '0')]) AS date, '19:30' AS time
    FROM part""")
def q65_daily_pages(spark, sf_dir):
    """Films from daily pages; a film's sessions of several days, each once."""
    size, c = F.col("p_size"), F.col
    shows = table(spark, sf_dir, "part").withColumn("day", F.explode(F.array(1 + size % 14, 15 + size % 14)))
    shows = shows.withColumn("dd", F.lpad(c("day").cast("string"), 2, "0"))
    block = F.concat(F.lit('<a href="?id='), c("p_partkey"), F.lit('&x"><div>'), "dd", F.lit('/04/2026, 19h30 | Sala</div><div class="infoTitle x">FILM '), c("p_partkey"), F.lit('</div><span class="colorPink">de </span>Ana S&aacute;<p>'), (1950 + size).cast("string"), F.lit(" - "), (60 + size).cast("string"), F.lit(" min</p></a>"))
    # a day's page in parts, each of which shows every film twice
    pages = shows.withColumn("block", block).groupBy("dd", (c("p_partkey") % 100).alias("part")).agg(F.array_join(F.flatten(F.array(F.collect_list("block"), F.collect_list("block"))), "").alias("body"))
    landed = _landing(pages, "cinemateca", F.concat(F.lit("https://cinemateca.pt/Programacao.aspx?date=2026-04-"), "dd", F.lit("&part="), "part"), c("body"))
    movies = cinemateca.parse(landed, F.lit("2026-03-20").cast("date"), 0)
    return movies.select("id", "title", "director", "year", "duration", F.explode("sessions").alias("s")).select("id", "title", "director", "year", "duration", "s.date", "s.time")


@query("""
    SELECT p_partkey::VARCHAR AS id, p_name || CASE WHEN p_partkey % 4 = 0 THEN ' (' || p_type || ')' ELSE '' END AS title, p_brand AS director, 1990 + p_size % 10 AS year, CASE WHEN p_size % 4 = 0 THEN p_size END AS duration,
           CASE WHEN p_size % 5 > 0 THEN '2026-01-' || lpad(p_size::VARCHAR, 2, '0') END AS date, row_number() OVER (ORDER BY p_partkey) - 1 AS place
    FROM part""")
def q66_published_and_read(spark, sf_dir):
    """A document written in parts by many tasks, and its movies read back in their order."""
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), *[F.lit(None).cast("string").alias(c) for c in ("lbxd_slug", "photo", "bio")])
    failed = table(spark, sf_dir, "region").select(F.col("r_name").alias("cinema"), F.lit('x "y"').alias("error"))
    movies = _movies(spark, sf_dir).withColumn("sessions", F.coalesce("sessions", F.array().cast(f"array<{SESSION}>")))
    path = place(spark, "q66")
    sink.write_document(movies, names, failed, "2026-03-20T08:00:00Z", path)
    back = publish.previous(spark, path)
    return back.select("id", "title", "director", "year", "duration", F.try_element_at("sessions", F.lit(1))["date"].alias("date"), F.col("src_ord").cast("long").alias("place"))


@query("""
    WITH d AS (SELECT p_brand AS name, arg_min(coalesce(CASE WHEN p_size % 3 > 0 THEN 's' || p_size END, ''), p_partkey) AS slug FROM part GROUP BY 1),
    w AS (SELECT p_brand AS name, min(p_type) AS photo FROM part WHERE p_size % 2 = 0 GROUP BY 1)
    SELECT name, nullif(slug, '') AS lbxd_slug, photo, CASE WHEN photo IS NULL THEN NULL ELSE 'b' END AS bio FROM d LEFT JOIN w USING (name)""")
def q67_directors(spark, sf_dir):
    """2.I: one row for each director: the first movie's slug even if null, photo and biography of the best entry."""
    size = F.col("p_size")
    slugs = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.when(size % 3 > 0, F.concat(F.lit("s"), size)).alias("slug"))
    movies = _movies(spark, sf_dir).join(slugs, "id").withColumn("director_lbxd_slug", F.col("slug")).drop("slug")
    wiki = table(spark, sf_dir, "part").where(size % 2 == 0).select(F.col("p_brand").alias("name"), F.col("p_type").alias("photo"), F.lit("b").alias("bio"))
    return enrich.directors(movies, wiki.unionByName(wiki.withColumn("photo", F.lit(None).cast("string"))))


@query("""
    WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 9)::INT AS z FROM orders)
    SELECT o_orderkey, unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE::VARCHAR AS day FROM o WHERE year(a) = year(z)""")
def q68_day_ranges(spark, sf_dir):
    """the days of ranges that are written out, as in 30 APR - 10 MAY 2026."""
    a = F.col("o_orderdate").cast("date")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), F.date_add(a, (F.col("o_orderkey") % 9).cast("int")).alias("z")).where("year(a) = year(z)")
    text = F.upper(F.concat(F.date_format("a", "d MMM"), F.lit("<br />\u2013 "), F.date_format("z", "d MMM yyyy")))
    return orders.select("o_orderkey", F.explode(T.day_range(F.regexp_replace(text, "<BR />", " "))).alias("day"))
