"""Queries over the star-schema tables, each standing for one operation on a message store.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``ORACLES`` holds the same query as SQL. What
each table stands for is said where it is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import content_hash, identity_key, message_id
from ..functions.text import html_text_plain
from ..operators import candidates, decide, rules, scope, store, stream_rules, sync, upsert

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """
    SELECT o.id, o.internal_date, c.c_name AS body_name
    FROM (SELECT o_orderkey AS id, o_orderdate AS internal_date, o_custkey FROM orders
          WHERE o_orderdate >= TIMESTAMP '1995-01-01'
            AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o_orderkey AND l.l_returnflag <> 'R')
            AND NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_orderkey = o_orderkey AND d.l_returnflag = 'A')
          ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200) o
    LEFT JOIN customer c ON c.c_custkey = o.o_custkey
    """
)
def pending_candidates(spark, sf_dir):
    """Orders are messages, lines not returned live locations, lines of flag A decisions, customers bodies."""
    messages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("internal_date"), F.col("o_custkey").alias("body_key"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_returnflag")
    bodies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("body_key"), "c_name")
    waiting = candidates.pending(messages, lines.where("l_returnflag <> 'R'"), lines.where("l_returnflag = 'A'"), ["id"], "1995-01-01")
    page = candidates.with_body(scope.newest(waiting, "internal_date", "id", 200), bodies, ["body_key"])
    return page.select("id", "internal_date", F.col("body.c_name").alias("body_name"))


@query("SELECT doc_id, source, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS decided FROM documents d")
def candidates_decided_flag(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return candidates.with_decided(docs, table(spark, sf_dir, "labels"), ["doc_id"])


@query(
    """
    SELECT event_id, ts, user_id FROM events
    WHERE ts < TIMESTAMP '2024-01-15' OR (ts = TIMESTAMP '2024-01-15' AND event_id < 5000)
    ORDER BY ts DESC, event_id DESC LIMIT 100
    """
)
def keyset_page(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return scope.newest(events.where(scope.keyset_before("ts", "event_id", "2024-01-15 00:00:00", 5000)), "ts", "event_id", 100)


@query("SELECT event_id, user_id, value FROM events WHERE event_type IN ('click', 'view') AND user_id = 7")
def scoped_match(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return scope.match(scope.scoped(events, 7, "user_id"), {"event_type": ["click", "view"]}).select("event_id", "user_id", "value")


#: Rules over pages and documents: domains of the test sites, and phrases of plain letters.
RULES = [
    {"match": {"domain": ["example.org"], "phrase": ["and the", "that the"], "in": "any"}, "label": "org"},
    {"match": {"phrase": ["license"], "in": "body"}, "label": "legal"},
    {"match": {"domain": ["example.com"], "phrase": ["token"]}, "label": "secret"},
    {"match": {"from": ["src3", "src7"]}, "label": "trusted"},
    {"match": {"domain": ["net"]}, "label": "net"},
]


def _messages(spark, sf_dir) -> DataFrame:
    """Documents as messages: the source is the address, the page with the same number gives the sender's domain, the first line is the subject."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("from_address"), F.lower("text").alias("body"))
    hosts = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lower(F.regexp_extract("url", r"^https?://([^/?#]+)", 1)).alias("from_domain"))
    return docs.join(hosts, "id", "left").select("id", "from_address", "from_domain", F.substring_index("body", "\n", 1).alias("subject"), "body")


_MESSAGES_SQL = r"""
    messages AS (
        SELECT d.doc_id AS id, d.source AS from_address, lower(regexp_extract(p.url, '^https?://([^/?#]+)', 1)) AS from_domain,
               split_part(lower(d.text), chr(10), 1) AS subject, lower(d.text) AS body
        FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id
    ), met AS (
        SELECT id,
            [CASE WHEN from_domain = 'example.org' OR from_domain LIKE '%.example.org' THEN 1 ELSE 0 END
              + CASE WHEN contains(body, 'and the') OR contains(body, 'that the') THEN 1 ELSE 0 END,
             CASE WHEN contains(body, 'license') THEN 1 ELSE 0 END,
             CASE WHEN from_domain = 'example.com' OR from_domain LIKE '%.example.com' THEN 1 ELSE 0 END
              + CASE WHEN contains(body, 'token') THEN 1 ELSE 0 END,
             CASE WHEN from_address IN ('src3', 'src7') THEN 1 ELSE 0 END,
             CASE WHEN from_domain = 'net' OR from_domain LIKE '%.net' THEN 1 ELSE 0 END] AS m,
            [2, 1, 2, 1, 1] AS t
        FROM messages
    ), flat AS (
        SELECT id, i - 1 AS rule, m[i] AS met, t[i] AS total FROM met, LATERAL (SELECT unnest(range(1, 6)) AS i)
    )
"""


@query(
    f"""
    WITH {_MESSAGES_SQL}, best AS (
        SELECT id, min(rule) FILTER (WHERE met = total) AS winner,
               arg_min(rule, -(met * 6 // total) * 100 + rule) AS near_rule,
               arg_min(met, -(met * 6 // total) * 100 + rule) AS near_met,
               arg_min(total, -(met * 6 // total) * 100 + rule) AS near_total
        FROM flat GROUP BY id
    )
    SELECT id, winner, ['org', 'legal', 'secret', 'trusted', 'net'][winner + 1] AS label,
           CASE WHEN winner IS NULL THEN near_rule END AS nearest_miss,
           CASE WHEN winner IS NULL THEN near_met END AS met,
           CASE WHEN winner IS NULL THEN near_total END AS total
    FROM best
    """
)
def rule_winner_nearest_miss(spark, sf_dir):
    return rules.first_match(_messages(spark, sf_dir), rules.rule_entries(spark, RULES))


@query(f"WITH {_MESSAGES_SQL} SELECT rule, count(*) AS n_met FROM flat WHERE met > 0 GROUP BY rule")
def rule_matches(spark, sf_dir):
    found = rules.entry_matches(_messages(spark, sf_dir), rules.rule_entries(spark, RULES))
    return found.select("id", "rule").distinct().groupBy("rule").agg(F.count(F.lit(1)).alias("n_met"))


@query(
    """
    SELECT min(doc_id) AS doc_id, sha256(text) AS identity FROM documents
    WHERE doc_id >= 200 GROUP BY sha256(text)
    HAVING sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id < 200)
    """
)
def dedup_insert_ignore(spark, sf_dir):
    """Documents under 200 are stored; what of the others is inserted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("identity"))
    return upsert.insert_or_ignore(docs.where("doc_id < 200"), docs.where("doc_id >= 200"), ["identity"], "doc_id").select("doc_id", "identity")


@query(
    """
    SELECT l_orderkey, l_partkey, l_returnflag, l_linenumber FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_returnflag DESC) = 1
    """
)
def location_last_wins(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linenumber")
    return upsert.last_of(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_returnflag"])


@query(
    """
    SELECT coalesce(n.k, o.k) AS s_suppkey, CASE WHEN n.k IS NOT NULL THEN n.b ELSE o.b END AS s_acctbal,
           CASE WHEN n.k IS NOT NULL THEN o.k IS NULL END AS inserted
    FROM (SELECT s_suppkey AS k, s_acctbal AS b FROM supplier WHERE s_suppkey % 3 <> 0) o
    FULL OUTER JOIN (SELECT s_suppkey AS k, round(s_acctbal + 1, 2) AS b FROM supplier WHERE s_suppkey % 2 = 0) n ON o.k = n.k
    """
)
def upsert_accounts(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    fresh = rows.where("s_suppkey % 2 = 0").withColumn("s_acctbal", F.round(F.col("s_acctbal") + 1, 2))
    return upsert.upsert(rows.where("s_suppkey % 3 <> 0"), fresh, ["s_suppkey"], ["s_acctbal"])


@query(
    """
    SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts
    FROM events GROUP BY user_id
    """
)
def latest_decision(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return decide.latest_decisions(events, ["user_id"], "ts", "event_id")


def _late_events(spark, sf_dir) -> DataFrame:
    """Events in batches of 50 by id; some happened hours before they arrived."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    late = F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), (F.col("event_id") % 7 * 40).cast("int"))
    return events.select("event_id", "event_type", F.floor(F.col("event_id") / 50).cast("long").alias("batch"), late.alias("t"))


_LATE_SQL = """
    late AS (SELECT event_id, event_type, event_id // 50 AS batch, ts - to_minutes(CAST(event_id % 7 * 40 AS INTEGER)) AS t FROM events),
    tops AS (SELECT event_type, batch, max(t) AS top FROM late GROUP BY ALL),
    marks AS (SELECT event_type, batch, max(top) OVER (PARTITION BY event_type ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM tops),
    routed AS (SELECT event_id, event_type, batch, t, wm, wm IS NULL OR t > wm - INTERVAL 5 MINUTE AS eligible FROM late JOIN marks USING (event_type, batch))
"""


@query(f"WITH {_LATE_SQL} SELECT event_id, event_type, batch, t, wm AS watermark, eligible FROM routed")
def watermark_route(spark, sf_dir):
    return stream_rules.routed(_late_events(spark, sf_dir), ["event_type"], "batch", "t").select("event_id", "event_type", "batch", "t", "watermark", "eligible")


@query(f"WITH {_LATE_SQL} SELECT event_type, batch, count(*) FILTER (WHERE eligible) AS n_new, count(*) FILTER (WHERE eligible) > 8 AS held FROM routed GROUP BY ALL")
def valve_hold(spark, sf_dir):
    routed = stream_rules.routed(_late_events(spark, sf_dir), ["event_type"], "batch", "t")
    return stream_rules.admission(routed, ["event_type", "batch"], cap=8)


@query("SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 50 AS chunk FROM events")
def chunk_assign(spark, sf_dir):
    return stream_rules.chunks(table(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], "event_id", 50)


@query(
    """
    WITH u AS (SELECT DISTINCT event_type, event_id AS uid FROM events),
    i AS (SELECT *, uid - row_number() OVER (PARTITION BY event_type ORDER BY uid) AS island FROM u),
    s AS (SELECT event_type, min(uid) AS low, max(uid) AS high FROM i GROUP BY event_type, island)
    SELECT event_type, string_agg(CASE WHEN low = high THEN CAST(low AS VARCHAR) ELSE low || ':' || high END, ',' ORDER BY low) AS ranges
    FROM s GROUP BY event_type
    """
)
def uid_ranges(spark, sf_dir):
    return stream_rules.uid_ranges(table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("uid")), ["event_type"])


@query(
    """
    SELECT user_id, coalesce(max(n), 0) AS longest_run, coalesce(max(n), 0) >= 3 AS stopped FROM (
        SELECT user_id, run, count(*) FILTER (WHERE failed) AS n FROM (
            SELECT user_id, event_type = 'error' AS failed,
                   sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events)
        GROUP BY user_id, run)
    GROUP BY user_id
    """
)
def failure_runs(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return stream_rules.failure_runs(events, ["user_id"], "event_id", F.col("event_type") == "error", 3)


@query(
    """
    WITH f AS (SELECT user_id, max(event_id) AS last_seen, max(event_id) FILTER (WHERE event_type = 'purchase') AS last_success,
                      max(event_id) FILTER (WHERE event_type = 'error') AS last_error,
                      coalesce(max(event_id) FILTER (WHERE event_type = 'signup'), -1) AS off FROM events GROUP BY user_id)
    SELECT user_id, last_seen, last_success, last_error,
           CASE WHEN off > coalesce(last_success, -1) AND off > coalesce(last_error, -1) THEN 'disabled'
                WHEN coalesce(last_error, -1) > coalesce(last_success, -1) THEN 'error'
                WHEN last_success IS NOT NULL THEN 'ok' ELSE 'connecting' END AS state FROM f
    """
)
def status_fold(spark, sf_dir):
    names = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "signup", "disabled").otherwise(F.col("event_type"))
    events = table(spark, sf_dir, "events").select("user_id", "event_id", names.alias("kind"))
    return stream_rules.status_fold(events, ["user_id"], "event_id", "kind")


@query(
    """
    WITH live AS (SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R')
    SELECT o.l_orderkey, o.l_linenumber, o.l_partkey AS message_id,
           CASE WHEN o.l_partkey IN (SELECT l_partkey FROM live WHERE l_orderkey % 2 = 1) THEN 'superseded' ELSE 'vanished' END AS reason
    FROM live o WHERE o.l_orderkey % 2 = 0
    """
)
def vanished_superseded(spark, sf_dir):
    """Lines are locations of the message of their part; odd orders are the new generation, returned lines are removed."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("message_id"), (F.col("l_orderkey") % 2).alias("generation"),
        F.when(F.col("l_returnflag") == "R", F.lit("1999-01-01")).alias("removed_at"),
    )
    return sync.old_generation(lines, 1).select("l_orderkey", "l_linenumber", "message_id", "reason")


@query(
    """
    SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    AND doc_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R')
    """
)
def orphan_bodies(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("doc_id"))
    return sync.orphans(table(spark, sf_dir, "documents").select("doc_id"), lines, table(spark, sf_dir, "labels"), ["doc_id"])


@query(
    """
    WITH old AS (SELECT s_suppkey, s_name, s_nationkey, s_suppkey % 7 <> 0 AS enabled FROM supplier WHERE s_suppkey % 5 <> 0),
    new AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS s_nationkey FROM supplier WHERE s_suppkey % 6 <> 0),
    j AS (SELECT coalesce(n.s_suppkey, o.s_suppkey) AS s_suppkey, CASE WHEN o.s_suppkey IS NULL THEN 'add'
        WHEN n.s_suppkey IS NULL THEN CASE WHEN o.enabled THEN 'disable' END
        WHEN NOT o.enabled THEN 'enable' WHEN n.s_nationkey <> o.s_nationkey THEN 'update' END AS action,
        CASE WHEN o.s_suppkey IS NOT NULL AND n.s_suppkey IS NOT NULL AND n.s_nationkey <> o.s_nationkey THEN 1 ELSE 0 END AS n_changes
        FROM old o FULL OUTER JOIN new n ON o.s_suppkey = n.s_suppkey)
    SELECT * FROM j WHERE action IS NOT NULL
    """
)
def registry_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    new = rows.where("s_suppkey % 6 <> 0").withColumn("s_nationkey", F.when(F.col("s_suppkey") % 4 == 0, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey")))
    old = rows.where("s_suppkey % 5 <> 0").withColumn("enabled", F.col("s_suppkey") % 7 != 0)
    found = sync.registry_diff(new, old, "s_suppkey", ["s_name", "s_nationkey"])
    return found.select("s_suppkey", "action", F.size("changes").alias("n_changes"))


@query(
    """
    WITH r AS (SELECT s_nationkey, count(*) AS n, min(s_suppkey) AS removed_key FROM supplier WHERE s_suppkey % 4 = 0 GROUP BY 1),
    a AS (SELECT s_nationkey, count(*) AS n, min(s_suppkey) AS added_key FROM supplier WHERE s_suppkey % 4 = 1 GROUP BY 1)
    SELECT s_nationkey, removed_key, added_key FROM r JOIN a USING (s_nationkey) WHERE r.n = 1 AND a.n = 1
    """
)
def rename_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return sync.rename_pairs(rows.where("s_suppkey % 4 = 0"), rows.where("s_suppkey % 4 = 1"), "s_nationkey", "s_suppkey")


@query("SELECT c_custkey, c_name, count(o_orderkey) AS n_messages FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def mailbox_list(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return store.counted(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, "c_custkey", "n_messages")


@query(
    """
    SELECT count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_high,
           (SELECT count(*) FROM (SELECT props FROM events GROUP BY props HAVING count(DISTINCT user_id) > 1)) AS n_shared FROM events
    """
)
def identity_stats(spark, sf_dir):
    """How many identities (props) more than one user has."""
    events = table(spark, sf_dir, "events").select("props", "user_id", "value")
    shared = events.groupBy("props").agg(F.countDistinct("user_id").alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias("n_shared"))
    return events.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("n_high")).crossJoin(shared)


@query(
    """
    SELECT quantile_disc(skew, 0.5) AS p50, quantile_disc(skew, 0.95) AS p95
    FROM (SELECT abs(epoch(l_shipdate) - epoch(o_orderdate)) AS skew FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    """
)
def date_skew(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    skews = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.abs(seconds("l_shipdate") - seconds("o_orderdate")).cast("double").alias("skew"))
    return stream_rules.nearest_ranks(skews, "skew", {"p50": 0.5, "p95": 0.95})


@query(
    """
    SELECT page_id, CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN 'pm:' || page_id
        WHEN page_id % 3 = 1 THEN 'mid:' || page_id || '@' || lower(regexp_extract(url, '^https?://([^/?#]+)', 1))
        ELSE 'hdr:v1:' || sha256(html) END AS identity FROM pages
    """
)
def identity_keys(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    host = F.upper(F.regexp_extract("url", r"^https?://([^/?#]+)", 1))
    raw = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit(" <"), F.col("page_id").cast("string"), F.lit("@"), host, F.lit("> ")))
    trusted = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" "), F.col("page_id").cast("string"), F.lit("\x00 "))).otherwise(F.lit("two words"))
    key = identity_key(trusted, message_id(raw), content_hash(F.col("html")), F.col("page_id") % 3 == 0)
    return pages.select("page_id", key.alias("identity"))


_WRONG_ANSWERS = [
    '{"reason":"r","category":"view","confidence":',
    '{"reason":"r","category":"view","confidence":0.5,"why":"x"}',
    '{"reason":"r","category":"view","confidence":1.5}',
    '{"reason":"r","category":"view","confidence":"1"}',
    '{"reason":"vi\\u0007ew","category":"view","confidence":0}',
    '["view",1]',
    '{"category":"view","confidence":0.5}',
    '{"reason":"  ","category":"view","confidence":0.5}',
    ' {"reason":"r","category":"view","confidence":0.5} x',
    '{"reason":"a\\u2028b","category":"view","confidence":0.5}',
    '{"reason":"r","category":"View","confidence":7}',
    '{"reason":"r","category":null,"confidence":0.5}',
    '{"reason":"r","category":"view","confidence":NaN}',
]


@query(
    f"""
    WITH a AS (SELECT event_id, CASE WHEN event_id % 16 < {len(_WRONG_ANSWERS)} THEN [{", ".join("'" + x + "'" for x in _WRONG_ANSWERS)}][event_id % 16 + 1]
        ELSE chr(10) || '{{"confidence":0.' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') || ',"category":"' || event_type || '","reason":" ' || repeat('r', CAST(event_id % 205 AS INTEGER)) || ' "}} ' END AS raw FROM events),
    p AS (SELECT *, trim(raw->>'$.reason') AS reason, json_type(raw, '$.confidence') AS kind FROM a WHERE json_valid(raw) AND NOT contains(raw, ':NaN'))
    SELECT event_id, 'not_json' AS verdict FROM a WHERE NOT json_valid(raw) OR contains(raw, ':NaN')
    UNION ALL
    SELECT event_id, CASE WHEN json_type(raw) <> 'OBJECT' THEN 'schema_mismatch'
        WHEN json_type(raw, '$.category') = 'VARCHAR' AND (raw->>'$.category') NOT IN ('view', 'click') THEN 'out_of_category'
        WHEN list_sort(json_keys(raw)) <> ['category', 'confidence', 'reason'] OR json_type(raw, '$.category') <> 'VARCHAR' OR json_type(raw, '$.reason') <> 'VARCHAR' THEN 'schema_mismatch'
        WHEN kind NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN 'schema_mismatch' WHEN NOT CAST(raw->>'$.confidence' AS DOUBLE) BETWEEN 0 AND 1 THEN 'schema_mismatch'
        WHEN length(reason) NOT BETWEEN 1 AND 200 OR regexp_matches(reason, '[\\x00-\\x1f\\x7f-\\x9f\\x{{2028}}\\x{{2029}}]') THEN 'schema_mismatch' ELSE 'ok' END FROM p
    """
)
def llm_output_validate(spark, sf_dir):
    """Model outputs of all categories with reasons of all lengths, and wrong ones: cut off, of other keys, with text after the end, of no category, with control characters, no numbers."""
    k = (F.col("event_id") % 16).cast("int")
    number, reason = F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"), F.repeat(F.lit("r"), (F.col("event_id") % 205).cast("int"))
    right = F.concat(F.lit('\n{"confidence":0.'), number, F.lit(',"category":"'), "event_type", F.lit('","reason":" '), reason, F.lit(' "} '))
    raw = F.when(k < len(_WRONG_ANSWERS), F.get(F.array(*[F.lit(x) for x in _WRONG_ANSWERS]), k)).otherwise(right)
    return table(spark, sf_dir, "events").select("event_id", decide.validated_output(raw, ["view", "click"]).alias("verdict"))


@query(
    """
    SELECT event_id, CASE WHEN event_type = 'purchase' OR value / 100 >= 0.6 THEN 'label' ELSE 'review' END AS outcome,
           CASE WHEN event_type = 'purchase' THEN 'paid' WHEN value / 100 >= 0.6 THEN event_type END AS category,
           CASE WHEN event_type = 'purchase' THEN 'exact_rules' ELSE 'llm' END AS tier FROM events
    """
)
def decide_threshold(spark, sf_dir):
    rule = F.when(F.col("event_type") == "purchase", "paid")
    made = decide.decided(rule, F.col("event_type"), F.col("value") / 100, 0.6)
    return table(spark, sf_dir, "events").select("event_id", made.alias("d")).select("event_id", "d.*")


@query("SELECT event_id, CASE WHEN event_type <> 'view' THEN ts + INTERVAL 7 DAY END AS expires_at FROM events WHERE event_type = 'view' OR ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20'")
def body_ttl_sweep(spark, sf_dir):
    """Bodies expire seven days after the decision; those without one stay."""
    bodies = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    return upsert.unexpired(bodies, F.lit("2024-01-20").cast("timestamp_ntz"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return decide.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def tier_coverage(spark, sf_dir):
    return decide.coverage(table(spark, sf_dir, "events"), "event_type")


@query("SELECT toxic, count(*) AS n FROM labels GROUP BY 1")
def decision_rollup(spark, sf_dir):
    return decide.rollup(table(spark, sf_dir, "labels"), ["toxic"])


@query("SELECT doc_id, source FROM documents WHERE CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 4) AS BIGINT) % 100 < 5")
def spot_check_sample(spark, sf_dir):
    return decide.spot_check(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


@query(
    """
    SELECT event_id, event_type, value FROM events
    ORDER BY event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING count(*) < 2000) DESC, value, event_id LIMIT 20
    """
)
def quick_confirm_batch(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return decide.quick_confirm(events, decide.rollup(events, ["event_type"]), "event_type", "value", "event_id", few=2000).select("event_id", "event_type", "value")


@query(
    f"""
    WITH {_MESSAGES_SQL}, w AS (SELECT id, min(rule) FILTER (WHERE met = total) AS a, min(rule) FILTER (WHERE met = total AND rule <> 1) AS b FROM flat GROUP BY id)
    SELECT ['org', 'legal', 'secret', 'trusted', 'net'][a + 1] AS before, ['org', 'legal', 'secret', 'trusted', 'net'][b + 1] AS after, count(*) AS n
    FROM w WHERE a IS DISTINCT FROM b GROUP BY 1, 2
    """
)
def rule_preview_diff(spark, sf_dir):
    """What moves when the second rule is taken away."""
    messages, entries = _messages(spark, sf_dir), rules.rule_entries(spark, RULES)
    before = rules.first_match(messages, entries).select("id", F.col("label").alias("before"))
    after = rules.first_match(messages, entries.where("rule <> 1")).select("id", F.col("label").alias("after"))
    return before.join(after, "id").where(~F.col("before").eqNullSafe(F.col("after"))).groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
    WITH known AS (SELECT n_regionkey AS g, sha256(n_name) AS hash, row_number() OVER (PARTITION BY n_regionkey ORDER BY sha256(n_name)) AS version FROM nation WHERE n_nationkey % 2 = 0)
    SELECT n_regionkey AS g, sha256(n_name) AS hash,
           coalesce((SELECT max(version) FROM known k WHERE k.g = n_regionkey), 0) + row_number() OVER (PARTITION BY n_regionkey ORDER BY sha256(n_name)) AS version
    FROM nation WHERE n_nationkey % 2 = 1
    """
)
def next_versions(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("g"), content_hash(F.col("n_name")).alias("hash"))
    known = upsert.next_versions(rows.where("false").withColumn("version", F.lit(0)), rows.where("n_nationkey % 2 = 0"), ["g"])
    return upsert.next_versions(known, rows, ["g"])


@query(None)
def nearest_centroid(spark, sf_dir):
    """The label whose centroid is nearest; rounding of float sums differs between engines, so there is no SQL for it."""
    vectors = table(spark, sf_dir, "embeddings")
    return decide.nearest_labels(vectors.select("vec_id", "embedding"), decide.centroids(vectors))


@query(
    r"""
    SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[\x09-\x0d\x20]+', ' ', 'g')) AS text FROM pages
    """
)
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html_text_plain(F.col("html")).alias("text"))
