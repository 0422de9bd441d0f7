"""Page parsing, label routing and text functions on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.html import page_blocks, visible_text
from quire.functions.text import before_dash, int_in_parens, join_lines, last_first, normalize_title, presenter, short_subject
from quire.plans.registry import Tables, query


@query()
def html_title_links(t: Tables) -> DataFrame:
    """Title and number of links of each page."""
    p = t.pages.select("page_id", page_blocks("html").alias("p"))
    return p.select("page_id", F.col("p.title_tag").alias("title"), F.size("p.links").alias("n_links"), F.get(F.col("p.links.href"), F.lit(0)).alias("first_link"))


@query()
def html_text(t: Tables) -> DataFrame:
    """Visible text of each page."""
    return t.pages.select("page_id", visible_text("html").alias("text"))


@query("SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1))::INT AS n_links FROM pages")
def html_link_count(t: Tables) -> DataFrame:
    """Links by pattern, without a parse."""
    return t.pages.select("page_id", F.size(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("n_links"))


@query("""
WITH r AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 'assigned' WHEN 'view' THEN 'appended' ELSE 'dropped' END AS route, value FROM events)
SELECT user_id, round(arg_max(value, (ts, event_id)) FILTER (route = 'assigned'), 6) AS assigned, (count(*) FILTER (route = 'appended')) AS n_appended,
       (count(*) FILTER (route = 'dropped')) AS n_dropped FROM r GROUP BY user_id
""")
def label_routing(t: Tables) -> DataFrame:
    """Items routed by label: one field keeps the last value, one gathers, the rest is reported."""
    r = F.when(F.col("event_type") == "click", "assigned").when(F.col("event_type") == "view", "appended").otherwise("dropped")
    d = t.events.withColumn("route", r)
    last = F.max_by(F.when(F.col("route") == "assigned", F.col("value")), F.when(F.col("route") == "assigned", F.struct("ts", "event_id")))
    return d.groupBy("user_id").agg(F.round(last, 6).alias("assigned"), F.count_if(F.col("route") == "appended").alias("n_appended"), F.count_if(F.col("route") == "dropped").alias("n_dropped"))


@query("SELECT p_partkey, trim(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]+', ' ', 'g')) AS norm FROM part")
def normalised_titles(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", normalize_title(F.col("p_name")).alias("norm"))


@query("""
SELECT o_orderkey, trim(string_split_regex(o_orderpriority, '\\s*[—–-]\\s*')[1]) AS head, try_cast(regexp_extract('(' || o_orderkey || ') x', '\\((\\d+)\\)', 1) AS INT) AS n,
       CASE WHEN contains(o_orderpriority, ' - ') THEN string_split(o_orderpriority, ' - ')[2] ELSE o_orderpriority END AS short FROM orders
""")
def label_parts(t: Tables) -> DataFrame:
    """Verdict before the dash, number in parentheses, short subject."""
    p = F.col("o_orderpriority")
    return t.orders.select("o_orderkey", before_dash(p).alias("head"), int_in_parens(F.concat(F.lit("("), F.col("o_orderkey").cast("string"), F.lit(") x"))).alias("n"), short_subject(p).alias("short"))


@query("SELECT c_custkey, 'of ' || c_mktsegment || ', Ann ' || CASE WHEN c_custkey % 2 = 0 THEN 'B.' ELSE 'Lee' END AS name FROM customer WHERE false UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'van ' || c_mktsegment || ', Ann' ELSE c_mktsegment || ', Ann Lee' END FROM customer")
def inverted_names(t: Tables) -> DataFrame:
    """Names turned to last name first; particles stay with the surname."""
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Ann van  "), F.col("c_mktsegment"))).otherwise(F.concat(F.lit(" Ann Lee "), F.col("c_mktsegment")))
    return t.customer.select("c_custkey", last_first(raw)["name"].alias("name"))


@query("SELECT s_suppkey, s_name AS name, 'Lab, Institute' AS affiliation, 'N' || s_nationkey AS country, 'in' || s_nationkey || 'ner line' AS joined FROM supplier")
def presenter_parts(t: Tables) -> DataFrame:
    """Name, affiliation and country of one string; wrapped lines joined."""
    p = presenter(F.concat(F.col("s_name"), F.lit(", Lab , Institute, N"), F.col("s_nationkey").cast("string")))
    lines = F.array(F.concat(F.lit("in"), F.col("s_nationkey").cast("string"), F.lit("-")), F.lit(" ner"), F.lit("line "))
    joined = F.replace(join_lines(lines), F.lit("-"), F.lit(""))
    return t.supplier.select("s_suppkey", p["name"].alias("name"), p["affiliation"].alias("affiliation"), p["country"].alias("country"), joined.alias("joined"))
