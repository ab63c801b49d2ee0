"""Queries that keep state, learn or evaluate: generations, streams by message, the embedding tier, curves, previews. What a table stands for is said where it is used."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import text
from ..operators import candidates, classifier, composite, decide, evaluation, model_tier, phrases, rules, spans, tenant, trace
from ..sources import reports, workspace
from ..streaming import backfill, ingest, states
from ..streaming.generations import GenerationStore
from .queries import _MESSAGES_SQL, RULES, _messages, query, table


@query(
    """
    WITH b AS (SELECT event_type AS folder, event_id AS id, ts, event_id % 3 AS k, ts > TIMESTAMP '2024-01-08' - INTERVAL 5 MINUTES AS late FROM events)
    SELECT folder, 'resynced' AS result, count(*) FILTER (WHERE k = 2) AS matched, count(*) FILTER (WHERE k = 0 AND late) AS new,
           count(*) FILTER (WHERE k = 0 AND NOT late) AS older, count(*) FILTER (WHERE k = 1) AS gone, 2::BIGINT AS generation, 11::BIGINT AS uid_validity,
           2 * max(id) FILTER (WHERE k <> 1) AS last_uid, greatest(TIMESTAMP '2024-01-08', max(ts) FILTER (WHERE k = 0 AND late))::TIMESTAMP AS watermark,
           count(*) FILTER (WHERE k <> 1) AS live
    FROM b GROUP BY folder
    """
)
def generation_resync(spark, sf_dir):
    """Event types are folders, events messages. Two thirds of them are there first; then the uid validity changes, one third is gone and one has come."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("folder"), F.col("event_id").alias("uid"), F.concat(F.lit("mid:"), F.col("event_id").cast("string")).alias("identity"), F.col("ts").cast("timestamp").alias("internal_date")
    )
    store = GenerationStore(spark, workspace.scratch(spark, "generations"), cap=1 << 40)
    first, second = events.where("uid % 3 <> 0"), events.where("uid % 3 <> 1")
    for validity, rows, factor, now in ((10, first, 1, dt.datetime(2024, 1, 8)), (11, second, 2, dt.datetime(2030, 1, 1))):
        listing = rows.select("folder", (F.col("uid") * factor).alias("uid"), "identity", "internal_date")
        status = listing.groupBy("folder").agg(F.lit(validity).cast("long").alias("uid_validity"), (F.max("uid") + 1).alias("uid_next"))
        counts = store.resync(listing, status, now)
    live = store.locations().groupBy("folder").agg(F.count(F.lit(1)).alias("live"))
    state = store.state().select("folder", "generation", "uid_validity", "last_uid", F.col("watermark").cast("timestamp_ntz").alias("watermark"))
    return counts.join(state, "folder").join(live, "folder")


_CUTS = [dt.datetime(1994, 6, 1), dt.datetime(1997, 1, 1)]


@query(
    """
    WITH o AS (SELECT o_custkey AS m, o_orderdate AS t, o_orderstatus AS s, o_orderkey AS k FROM orders),
    r AS (SELECT m, t, 'r' || k AS f, row_number() OVER (PARTITION BY m ORDER BY t, 'r' || k) AS n FROM o WHERE s = 'F' AND k % 7 <> 0),
    a AS (SELECT m, t, 'a' || k AS f, row_number() OVER (PARTITION BY m ORDER BY t, 'a' || k) AS n FROM o WHERE s = 'O')
    SELECT m::VARCHAR AS message, 'corrected' AS outcome, r.f AS from_folder, a.f AS to_folder, r.t AS removed_at, a.t AS added_at FROM r JOIN a USING (m, n)
    """
)
def relabel_stream(spark, sf_dir):
    """Customers are messages. Their filled orders left a folder, open ones came into one; of every seventh order the move is our own. In three batches."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("message"), "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("at"))
    kind = F.when(F.col("o_orderstatus") == "F", "removed").when(F.col("o_orderstatus") == "O", "added")
    folder = F.concat(F.when(F.col("o_orderstatus") == "F", "r").otherwise("a"), F.col("o_orderkey").cast("string"))
    changes = orders.withColumns({"kind": kind, "folder": folder}).where("kind is not null")
    own = changes.where("kind = 'removed' and o_orderkey % 7 = 0").withColumn("kind", F.lit("own-removed"))
    rows = changes.unionByName(own).select("message", "folder", "kind", "at")
    found = states.replayed(rows, "at", _CUTS, states.relabels, workspace.scratch(spark, "relabels"))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("removed_at", "added_at")})


@query(
    """
    WITH b AS (SELECT o_custkey AS m, min(o_orderdate) AS stored FROM orders GROUP BY 1),
    d AS (SELECT o_custkey AS m, min(o_orderdate) AS decided FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 3 > 0 GROUP BY 1),
    e AS (SELECT m, stored, CASE WHEN decided < stored THEN stored ELSE decided END + INTERVAL 7 DAYS AS expires FROM b LEFT JOIN d USING (m))
    SELECT m::VARCHAR AS message, stored AS stored_at, expires AS expires_at FROM e WHERE expires IS NULL OR expires > (SELECT max(o_orderdate) FROM orders)
    """
)
def body_expiry_stream(spark, sf_dir):
    """Customers are messages, their first order stores the body, open orders are decisions (none for every third customer). In three batches; what survives."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("message"), "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("at"))
    bodies = orders.groupBy("message").agg(F.min("at").alias("at")).withColumn("kind", F.lit("body"))
    decisions = orders.where("o_orderstatus = 'O' and o_custkey % 3 > 0").withColumn("kind", F.lit("decision"))
    rows = bodies.unionByName(decisions.select("message", "at", "kind"))
    found = states.replayed(rows, "at", _CUTS, states.body_expiry, workspace.scratch(spark, "bodies"))
    return states.surviving_bodies(found).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("stored_at", "expires_at")})


@query()
def embedding_tier(spark, sf_dir):
    """Vectors with an id divisible by 20 are asked, all are confirmed examples; each is scored by a model that never saw it, and by its neighbours."""
    vectors = table(spark, sf_dir, "embeddings")
    return classifier.embedding_tier(vectors, vectors.where("vec_id % 20 = 0"))


@query(
    """
    WITH p AS (SELECT lower(substr(text, 1, 5)) AS entry, CAST(min(doc_id) % 500 AS INTEGER) AS rule FROM documents WHERE text <> '' GROUP BY 1)
    SELECT DISTINCT d.doc_id AS id, p.rule FROM documents d JOIN p ON contains(lower(d.text), p.entry)
    """
)
def many_phrases(spark, sf_dir):
    """What documents begin with, five characters, are phrases (of 500 rules, as many as there may be); each is looked for in every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("subject"), "text")
    words = docs.where("text <> ''").groupBy(F.lower(F.substring("text", 1, 5)).alias("entry")).agg((F.min("id") % 500).cast("int").alias("rule"))
    return phrases.phrase_matches(docs.select("id", "subject", F.lower("text").alias("body")), words.withColumn("place", F.lit("body")))


_DECISIONS = "o_custkey % 7 AS mailbox, o_orderkey AS message, o_orderstatus AS category, o_orderdate AS t"


@query(
    f"""
    WITH d AS (SELECT {_DECISIONS} FROM orders),
    c AS (SELECT mailbox, l_orderkey AS message, l_linestatus AS category, l_shipdate AS t FROM lineitem JOIN d ON message = l_orderkey),
    truth AS (SELECT mailbox, message, arg_max(category, (t, category)) AS truth FROM c GROUP BY ALL),
    asked AS (SELECT d.mailbox, d.category = truth AS good, (SELECT count(*) FROM c WHERE c.mailbox = d.mailbox AND c.t < d.t) // 100 * 100 AS examples FROM d JOIN truth USING (mailbox, message)),
    s AS (SELECT mailbox, examples::BIGINT AS examples, count(*) AS n, count(*) FILTER (WHERE good) AS n_correct FROM asked GROUP BY ALL)
    SELECT mailbox, examples, n, n_correct, round(n_correct / n, 6) AS accuracy, (sum(n) OVER w)::BIGINT AS n_so_far, round(sum(n_correct) OVER w / sum(n) OVER w, 6) AS accuracy_so_far
    FROM s WINDOW w AS (PARTITION BY mailbox ORDER BY examples)
    """
)
def learning_curve(spark, sf_dir):
    """Orders are decided messages of seven mailboxes, their lines confirmations of a status."""
    decisions = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("mailbox"), F.col("o_orderkey").alias("message"), F.col("o_orderstatus").alias("category"), F.col("o_orderdate").alias("at"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("message"), F.col("l_linestatus").alias("category"), F.col("l_shipdate").alias("at"))
    return evaluation.learning_curve(decisions, lines.join(decisions.select("mailbox", "message"), "message"), "mailbox", "message")


@query(
    """
    WITH s AS (SELECT l_returnflag AS tier, list(l_extendedprice ORDER BY l_extendedprice) AS v FROM lineitem GROUP BY 1)
    SELECT tier, v[ceil(0.5 * len(v))::BIGINT] AS p50, v[ceil(0.95 * len(v))::BIGINT] AS p95, v[ceil(0.999 * len(v))::BIGINT] AS p999 FROM s
    """
)
def latency_by_tier(spark, sf_dir):
    """Return flags are tiers, prices of lines are latencies."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("tier"), "l_extendedprice")
    return evaluation.nearest_ranks_by(lines, ["tier"], "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p999": 0.999})


@query(
    f"""
    WITH {_MESSAGES_SQL}, recent AS (SELECT doc_id AS id, source AS mailbox FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) <= 20),
    w AS (SELECT id, mailbox, min(rule) FILTER (WHERE met = total) AS a, min(rule) FILTER (WHERE met = total AND rule <> 1) AS b FROM flat JOIN recent USING (id) GROUP BY ALL),
    x AS (SELECT mailbox, ['org', 'legal', 'secret', 'trusted', 'net'][a + 1] AS before, ['org', 'legal', 'secret', 'trusted', 'net'][b + 1] AS after, CASE WHEN quality = 1 THEN 'net' ELSE 'trusted' END AS truth, l.doc_id IS NOT NULL AS known
          FROM w LEFT JOIN labels l ON l.doc_id = id)
    SELECT mailbox, before, after, count(*) FILTER (WHERE before IS DISTINCT FROM after) AS n, count(*) FILTER (WHERE known AND after <> truth) AS n_conflicts FROM x
    WHERE before IS DISTINCT FROM after OR (known AND after <> truth) GROUP BY ALL
    """
)
def rule_preview(spark, sf_dir):
    """Sources are mailboxes; the second rule goes; labels say what the owner confirmed; of each mailbox the 20 longest documents are the newest."""
    entries = rules.rule_entries(spark, RULES)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("mailbox"), "n_chars")
    confirmed = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "net").otherwise("trusted").alias("label"), F.lit(0).alias("at"))
    return evaluation.rule_preview(_messages(spark, sf_dir).join(docs, "id"), entries, entries.where("rule <> 1"), confirmed, "mailbox", ["n_chars", "id"], 20)


_ITEMS_SQL = """
    items AS (SELECT sha256(coalesce(text, '')) AS identity, doc_id AS ordinal, source AS folder, doc_id % 400 AS uid, doc_id % 3 = 0 AS eligible, CASE WHEN doc_id % 2 = 0 THEN lang END AS body FROM documents),
    old AS (SELECT identity, bool_or(eligible) AS eligible FROM items WHERE ordinal < 600 GROUP BY 1),
    m AS (SELECT identity, bool_or(eligible) AS eligible, arg_min(body, ordinal) FILTER (WHERE body IS NOT NULL) AS body FROM items WHERE ordinal >= 300 GROUP BY 1),
    r AS (SELECT m.identity, m.body, o.eligible IS NULL AS fresh, NOT o.eligible AND m.eligible AS raised, CASE WHEN o.eligible IS NULL THEN m.eligible ELSE o.eligible OR m.eligible END AS now FROM m LEFT JOIN old o USING (identity))
"""


@query(
    f"""
    WITH {_ITEMS_SQL} SELECT count(*) FILTER (WHERE fresh) AS inserted_messages, count(*) FILTER (WHERE NOT fresh) AS existing_messages, count(*) FILTER (WHERE NOT fresh AND raised) AS promoted_messages,
        (SELECT count(*) FROM (SELECT DISTINCT folder, uid FROM items WHERE ordinal >= 300 EXCEPT SELECT folder, uid FROM items WHERE ordinal < 600)) AS inserted_locations,
        count(*) FILTER (WHERE now AND body IS NOT NULL AND identity NOT IN (SELECT identity FROM items WHERE ordinal < 200)) AS inserted_bodies,
        count(*) FILTER (WHERE now AND body IS NOT NULL AND identity NOT IN (SELECT identity FROM items WHERE ordinal < 200) AND identity IN (SELECT i.identity FROM items i JOIN labels ON doc_id = ordinal)) AS dated_bodies
    FROM r
    """
)
def store_chunk_counters(spark, sf_dir):
    """Documents from 300 on are a chunk; those under 600 are stored with their places, those under 200 with bodies; labelled ones are decided. With promotion."""
    docs = table(spark, sf_dir, "documents").select(
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("identity"), F.col("doc_id").alias("ordinal"), F.col("source").alias("folder"), F.lit(1).cast("long").alias("uidvalidity"), (F.col("doc_id") % 400).alias("uid"),
        F.lit(1).alias("generation"), (F.col("doc_id") % 3 == 0).alias("eligible"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("body"),
    )
    none = F.lit(None)
    old = docs.where("ordinal < 600")
    stored = old.groupBy("identity").agg(F.bool_or("eligible").alias("eligible"))
    places = old.groupBy(*composite.LOCATION).agg(F.max_by("identity", "ordinal").alias("identity")).withColumns({"generation": F.lit(1), "removed_at": none.cast("timestamp"), "removed_reason": none.cast("string")})
    bodies = docs.where("ordinal < 200").groupBy("identity").agg(F.first("body").alias("body")).withColumn("expires_at", none.cast("timestamp"))
    decided = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ordinal")).join(docs.select("ordinal", "identity"), "ordinal")
    after = composite.store_chunk(docs.where("ordinal >= 300"), stored, places, bodies, decided, dt.datetime(2024, 2, 1), promote=True)
    dated = after["bodies"].agg(F.count_if(F.col("expires_at").isNotNull()).alias("dated_bodies"))
    return after["counts"].crossJoin(dated)  # one row each


@query(
    """
    WITH t AS (SELECT event_id, user_id, event_id % 4 AS k, event_id % 3 > 0 AS worker, ts FROM events),
    good AS (SELECT *, k IN (0, 1) AS fine FROM t),
    placed AS (SELECT *, worker AND fine AND row_number() OVER (PARTITION BY user_id, worker AND fine ORDER BY ts, event_id) > 1 AS again FROM good)
    SELECT event_id, CASE WHEN k = 2 THEN 'row.category,both.intent' WHEN k = 3 THEN 'span.attempts' ELSE 'worker' END AS broken FROM placed WHERE NOT fine OR again
    """
)
def decisions_refused(spark, sf_dir):
    """Events are decisions on their users: labels of the model and reviews, a label without a category, one with three attempts; the worker decides a user once, reruns as often as they like."""
    k = F.col("event_id") % 4
    null = F.lit(None).cast("string")

    def span(kind, **more):
        fields = {"kind": F.lit(kind), "model": null, "confidence": F.lit(None).cast("double"), "attempts": F.lit(None).cast("int"), "result": null, "categories": F.lit(None).cast("array<string>"), "intent": null, "label": null, "reason": null}
        return F.struct(*[v.alias(n) for n, v in {**fields, **more}.items()])

    attempts = F.when(k == 3, 3).otherwise(1).cast("int")
    llm = span("llm", model=F.lit("m"), confidence=F.lit(0.9).cast("double"), attempts=attempts, result=F.lit("work"), categories=F.array(F.lit("work"), F.lit("home")))
    action = span("action", intent=F.lit("label"), label=F.lit("work"))
    made = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("message_id"), F.col("event_id").alias("id"), F.col("ts").alias("decided_at"), F.lit("labelled").alias("outcome"), F.when(k != 2, "work").alias("category"), F.lit("llm").alias("tier"),
        null.alias("review_reason"), F.lit(0.9).cast("double").alias("confidence"), F.lit(1).alias("prompt_version"), F.lit("m").alias("model"), F.when(F.col("event_id") % 3 > 0, "worker").otherwise("rerun").alias("decided_by"),
        F.lit(1).alias("trace_format"), F.array(span("exact_rules"), span("classifier"), llm, action).alias("spans"),
    )
    bodies = made.select("message_id").distinct().withColumn("expires_at", F.lit(None).cast("timestamp_ntz"))
    found = composite.record_decisions(made, made.limit(0), bodies)["refused"]
    return found.select(F.col("id").alias("event_id"), F.array_join("broken", ",").alias("broken"))


@query(
    """
    SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
    WHERE c.c_nationkey = 7 AND EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = 7 AND s.s_suppkey % 10 = c.c_custkey % 10) AND o.o_orderstatus = 'F'
    """
)
def tenant_join(spark, sf_dir):
    """Nations are mailboxes: customers and suppliers are read for one of them, in the subquery too, and the plan is checked for it."""
    tables = {
        "customer": table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", tenant.COLUMN),
        "supplier": table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", tenant.COLUMN),
        "orders": table(spark, sf_dir, "orders"),
    }
    text = """
        SELECT c.c_custkey, o.o_orderkey FROM {customer} c JOIN {orders} o ON o.o_custkey = c.c_custkey
        WHERE EXISTS (SELECT 1 FROM {supplier} s WHERE s.s_suppkey % 10 = c.c_custkey % 10) AND o.o_orderstatus = :status
    """
    return tenant.Mailbox(spark, tables, 7).sql(text, {"status": "F"})


@query(
    f"""
    WITH pend AS (SELECT o_orderkey AS id, o_orderdate AS internal_date, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AS decided FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'
        AND o_orderstatus <> 'P' AND (o_orderdate, o_orderkey) < (TIMESTAMP '1997-06-01', 7000) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 1) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30))
    SELECT p.id, internal_date, decided, c_name AS name FROM (SELECT * FROM pend ORDER BY internal_date DESC, id DESC LIMIT 60) p LEFT JOIN customer ON c_custkey = p.id
    """
)
def candidate_query(spark, sf_dir):
    """Everything in one conjunction: eligible, live, from a time on, after the last page, of a table of ids; decided ones too."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_returnflag", "l_quantity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("internal_date"), (F.col("o_orderstatus") != "P").alias("eligible"))
    bodies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    page = candidates.candidate_page(
        orders, bodies, lines.where("l_linenumber > 1"), lines.where("l_returnflag = 'A'"), ["id"], 60, since="1995-01-01", ids=lines.where("l_quantity > 30"), before=("1997-06-01 00:00:00", 7000), pending_only=False
    )
    return page.select("id", "internal_date", "decided", F.col("body.name").alias("name"))


@query(
    """
    WITH e AS (SELECT event_id, event_id % 6 AS k, event_type, user_id FROM events)
    SELECT event_id, CASE k WHEN 0 THEN '' WHEN 1 THEN 'not_json' WHEN 2 THEN 'version' WHEN 3 THEN 'uid_validity,sample' WHEN 4 THEN 'sample' ELSE '' END AS faults,
           CASE WHEN k = 0 THEN user_id END AS uid_validity, CASE WHEN k = 0 THEN event_id WHEN k = 5 THEN NULL END AS uid, CASE WHEN k = 0 THEN event_type END AS internal_date FROM e
    """
)
def report_source(spark, sf_dir):
    """Reports as JSON texts made of events: good ones, one that is cut off, one of another version, wrong types, an entry without its date, an empty one."""
    k, uid, user = F.col("event_id") % 6, F.col("event_id").cast("string"), F.col("user_id").cast("string")
    entry = F.concat(F.lit('{"uid":'), uid, F.lit(',"internalDate":"'), "event_type", F.lit('","internalIdSha256":null,"more":[1]}'))
    whole = F.concat(F.lit('{"probeVersion":'), F.when(k == 2, "2").otherwise("1"), F.lit(',"uidValidity":{"in":'), user, F.lit('},"sample":['), entry, F.lit("]}"))
    text = (
        F.when(k == 1, F.substring(whole, 1, 40))
        .when(k == 3, F.concat(F.lit('{"probeVersion":1,"uidValidity":{"in":"'), user, F.lit('"},"sample":[{"uid":"'), uid, F.lit('","internalDate":"x"}]}')))
        .when(k == 4, F.concat(F.lit('{"probeVersion":1,"uidValidity":{},"sample":[{"uid":'), uid, F.lit("}]}")))
        .when(k == 5, '{"probeVersion":1.0,"uidValidity":{},"sample":[]}')
        .otherwise(whole)
    )
    found = reports.read_reports(table(spark, sf_dir, "events").select("event_id", text.alias("value")))
    first = F.get("report.sample", F.lit(0))
    return found.select("event_id", F.array_join("faults", ",").alias("faults"), F.try_element_at("report.uid_validity", F.lit("in")).alias("uid_validity"), first["uid"].alias("uid"), first["internal_date"].alias("internal_date"))


@query(
    """
    WITH e AS (SELECT c_nationkey AS document, c_custkey AS place, lower(c_mktsegment) || '@' || (c_custkey % 40) AS server, lower(c_name) AS slug FROM customer)
    SELECT document, 'server' AS kind, first, place AS again, server AS value FROM (SELECT *, min(place) OVER (PARTITION BY document, server) AS first FROM e) WHERE place > first
    """
)
def config_duplicates(spark, sf_dir):
    """Nations are configurations, customers their mailboxes: two may not have one name or read one server."""
    entries = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("document"), F.col("c_custkey").alias("place"), "c_name", "c_mktsegment")
    server = F.concat(F.lower("c_mktsegment"), F.lit("@"), (F.col("place") % 40).cast("string"))
    return reports.duplicate_entries(entries, "document", "place", {"slug": F.lower("c_name"), "server": server})


@query("SELECT user_id, event_id, 'cap' AS field, round(value) AS value FROM events WHERE NOT round(value) BETWEEN 1 AND 90 UNION ALL SELECT user_id, event_id, 'days', value FROM events WHERE event_id % 2 = 0 AND (value > 60 OR value <> floor(value))")
def config_ranges(spark, sf_dir):
    """Events as settings: a cap from 1 to 90, and days, absent in every second one, that are whole and at most 60."""
    entries = table(spark, sf_dir, "events").select("user_id", "event_id", F.round("value").alias("cap"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("days"))
    return reports.out_of_range(entries, ["user_id", "event_id"], {"cap": (1, 90), "days": (0, 60)})


@query(
    """
    SELECT event_id, array_to_string(list_filter([CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'held' END, CASE WHEN (event_id % 3 = 0) <> (event_id % 5 = 0) THEN 'backfill' END], lambda x: x IS NOT NULL), ',') AS broken
    FROM events WHERE (event_type = 'error' AND event_id % 2 = 0) OR (event_id % 3 = 0) <> (event_id % 5 = 0)
    """
)
def status_audit(spark, sf_dir):
    """Errors need attention; of every second one it is not said how many are held; the two numbers of a backfill come apart."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "needs_attention").otherwise("ok").alias("state"), F.when(k % 2 == 1, k).alias("held_new_count"), F.when(k % 3 == 0, k).alias("backfill_done"), F.when(k % 5 == 0, k).alias("backfill_total")
    )
    return decide.quarantined(rows, trace.status_checks()).select("event_id", F.array_join("broken", ",").alias("broken"))


@query(
    """
    SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus = 'P' THEN 'state' END, CASE WHEN (o_orderstatus = 'F') <> (o_custkey % 3 > 0 AND o_custkey % 4 > 0) THEN 'pending' END,
        CASE WHEN (o_orderkey % 2 = 0) <> (o_orderkey % 7 = 0) THEN 'backfill' END], lambda x: x IS NOT NULL), ',') AS broken
    FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'F') <> (o_custkey % 3 > 0 AND o_custkey % 4 > 0) OR (o_orderkey % 2 = 0) <> (o_orderkey % 7 = 0)
    """
)
def folder_sync_audit(spark, sf_dir):
    """Orders as states of folders: filled ones resync, partial ones are in no state; of the four numbers of a backfill some may be missing."""
    k, some = F.col("o_orderkey"), F.col("o_orderkey") % 2 == 0
    state = F.when(F.col("o_orderstatus") == "F", "resyncing").when(F.col("o_orderstatus") == "O", "ok")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", state.alias("state"), F.when(F.col("o_custkey") % 3 > 0, 1).alias("pending_validity"), F.when(F.col("o_custkey") % 4 > 0, 2).alias("pending_generation"),
        F.when(some, F.col("o_orderdate")).alias("backfill_since"), F.when(some, k).alias("backfill_cursor"), F.when(some, k).alias("backfill_until"), F.when(k % 7 == 0, k).alias("backfill_total"),
    )
    return decide.quarantined(rows, trace.folder_sync_checks()).select("o_orderkey", F.array_join("broken", ",").alias("broken"))


@query(
    """
    SELECT event_type AS folder, 'm' || user_id || '-' || event_id // 40 AS identity, min(event_id) AS uid, bool_or(ts >= TIMESTAMP '2024-01-10') AS eligible
    FROM events GROUP BY ALL
    """
)
def backfill_streams(spark, sf_dir):
    """Events are messages in folders by type. The polling stream stores late ones first, then the older ones as historical; the backfill from the tenth day on promotes what it reaches, between the two."""
    events = table(spark, sf_dir, "events")
    name = F.concat(F.lit("m"), F.col("user_id").cast("string"), F.lit("-"), F.floor(F.col("event_id") / 40).cast("string"))
    listing = events.select(F.col("event_type").alias("folder"), name.alias("identity"), F.col("event_id").alias("uid"), F.col("ts").cast("timestamp").alias("internal_date"))
    home = workspace.scratch(spark, "backfill")
    store, state = f"{home}/store", f"{home}/state"
    late = F.lit("2024-01-20").cast("timestamp")
    backfill.begin_backfill(listing, state, dt.datetime(2024, 1, 10))
    ingest.store_batch(listing.where(F.col("internal_date") >= late), store, state, 0, cap=1 << 40)
    backfill.run_backfill(listing, store, state, size=max(200, events.count() // 10))
    ingest.store_batch(listing.where(F.col("internal_date") < late), store, state, 1, cap=1 << 40)
    return backfill.messages(spark, store, listing.schema).select("folder", "identity", "uid", "eligible")


_HASH = "0" * 64


@query(
    f"""
    WITH {_MESSAGES_SQL}, w AS (SELECT id, min(rule) FILTER (WHERE met = total) AS winner, count(*) FILTER (WHERE met = total) AS n_matches, arg_min(rule, -(met * 6 // total) * 100 + rule) AS near FROM flat GROUP BY id),
    d AS (SELECT *, id % 6 AS k FROM w WHERE winner IS NOT NULL OR id % 6 < 5)
    SELECT id, CASE WHEN winner IS NOT NULL OR k = 0 THEN 'labelled' ELSE 'review' END AS outcome, CASE WHEN winner IS NOT NULL THEN ['org', 'legal', 'secret', 'trusted', 'net'][winner + 1] WHEN k = 0 THEN 'work' END AS category,
           CASE WHEN winner IS NOT NULL THEN 'exact_rules' ELSE 'llm' END AS tier, CASE WHEN winner IS NULL THEN [NULL, 'low_confidence', 'invalid_output', 'out_of_category', 'low_confidence'][k + 1] END AS review_reason,
           n_matches::INTEGER AS n_matches, winner::INTEGER AS winner, CASE WHEN winner IS NULL THEN near END::INTEGER AS nearest_miss, CASE WHEN winner IS NULL THEN CASE WHEN k IN (2, 3, 4) THEN 2 ELSE 1 END END AS n_attempts, '' AS faults
    FROM d
    """
)
def decision_traces(spark, sf_dir):
    """Documents as messages, decided by the rules, else by recorded answers: sure, unsure, twice no JSON, twice of no category, unsure at the second attempt, or an outage. The traces are written, read back and checked."""
    messages, k = _messages(spark, sf_dir), F.col("id") % 6
    good, low, other = ('{"reason":"so","category":"%s","confidence":%s}' % x for x in (("work", 0.9), ("work", 0.5), ("play", 0.9)))
    ids = messages.select("id")
    raw = lambda *of: F.get(F.array(*[F.lit(x) for x in of]), k.cast("int"))
    status = F.when(k == 5, 503).otherwise(200)
    first = ids.select("id", F.lit(1).alias("attempt"), status.alias("status"), raw(good, low, "no", other, "no", good).alias("raw"))
    second = ids.select("id", F.lit(2).alias("attempt"), F.lit(200).alias("status"), raw(low, good, "no", other, low, good).alias("raw"))
    answers = first.unionByName(second).withColumns({"done_reason": F.lit("stop"), "prompt_tokens": F.lit(100)})
    said = spans.llm_spans(answers, "id", [("work", "w"), ("home", "h")], 0.85, "m", 1, _HASH, ["be kind"], {"temperature": 0, "seed": 42})
    found = spans.decided_traces(spans.exact_rules_spans(messages, rules.rule_entries(spark, RULES)), said)
    t = F.from_json("spans", spans.READ)
    of_rules, of_model = F.get(t, F.lit(0)), F.get(F.filter(t, lambda s: s["kind"] == "llm"), F.lit(0))
    return found.select(
        "id", "outcome", "category", "tier", "review_reason", F.size(of_rules["matches"]).alias("n_matches"), of_rules["winner"]["index"].alias("winner"), of_rules["nearest_miss"]["index"].alias("nearest_miss"),
        F.when(of_model.isNotNull(), F.size(of_model["attempts"])).alias("n_attempts"), F.array_join(spans.trace_faults(F.col("spans")), ",").alias("faults"),
    )


@query(
    """
    WITH e AS (SELECT user_id, event_id, CASE WHEN event_type IN ('purchase', 'view') THEN 'decided' WHEN event_type IN ('error', 'click') THEN 'failed' END AS o FROM events),
    m AS (SELECT *, sum(CASE WHEN o = 'decided' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM e WHERE o IS NOT NULL),
    r AS (SELECT user_id, g, count(*) FILTER (WHERE o = 'failed') AS n, g = max(g) OVER (PARTITION BY user_id) AS last FROM m GROUP BY user_id, g),
    f AS (SELECT user_id, max(n) AS longest_run, max(n) FILTER (WHERE last) AS consecutive FROM r GROUP BY 1),
    c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS n_labelled, count(*) FILTER (WHERE event_type = 'view') AS n_review, count(*) FILTER (WHERE event_type IN ('error', 'click')) AS n_failed,
        count(*) FILTER (WHERE event_type = 'signup') AS n_left, count(DISTINCT CASE WHEN event_type IN ('error', 'click', 'signup') THEN event_id // 3 END) AS n_unclassified FROM events GROUP BY 1)
    SELECT c.*, coalesce(consecutive, 0) AS consecutive, coalesce(longest_run, 0) AS longest_run, coalesce(longest_run >= 5, false) AS stopped FROM c LEFT JOIN f USING (user_id)
    """
)
def pass_report(spark, sf_dir):
    """Users are passes, events what they met, three to a message."""
    outcome = F.when(F.col("event_type") == "purchase", "labelled").when(F.col("event_type") == "view", "review").when(F.col("event_type").isin("error", "click"), "failed")
    met = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("event_id") / 3).alias("message"), outcome.alias("outcome"))
    return model_tier.pass_report(met, ["user_id"], "event_id", "message")


@query(
    """
    WITH m AS (SELECT event_id // 4 AS pair, event_id % 2 = 1 AS injected, sum(value) AS s, arg_max(NULLIF(event_type, 'error'), event_id) AS c FROM events GROUP BY ALL),
    last AS (SELECT event_id // 4 AS pair, event_id % 2 = 1 AS injected, arg_max(coalesce(NULLIF(event_type, 'error'), ''), event_id) AS c FROM events GROUP BY ALL),
    p AS (SELECT pair, max(c) FILTER (WHERE NOT injected) AS base, max(c) FILTER (WHERE injected) AS inj, count(*) AS n FROM last GROUP BY 1)
    SELECT (SELECT count(*) FROM m) AS n_mails, count(*) FILTER (WHERE n = 2) AS n_pairs, count(*) FILTER (WHERE n = 2 AND inj <> '' AND inj <> base) AS n_flips,
           (SELECT round(sum(s), 6) FROM m) AS seconds_total, (SELECT round(max(s), 6) FROM m) AS seconds_longest FROM p
    """
)
def baseline_report(spark, sf_dir):
    """Events are calls, two to a mail, mails in pairs, the odd one with an injection; an error has no label."""
    k = F.col("event_id")
    runs = table(spark, sf_dir, "events").select(F.floor(k / 4).alias("pair"), (k % 2 == 1).alias("injected"), k.alias("attempt"), F.nullif("event_type", F.lit("error")).alias("category"), F.col("value").alias("seconds"))
    return model_tier.baseline_report(runs)


@query(
    r"""
    WITH m AS (SELECT l_orderkey AS ext, CASE WHEN l_linenumber % 3 > 0 THEN l_suppkey END AS pm, CASE WHEN l_partkey % 5 > 0 THEN l_orderkey % 3000 || CASE WHEN l_orderkey % 2 = 0 THEN '@in.example' ELSE '@b@x' END END AS mid,
        o_orderdate AS sent, l_shipdate AS d FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey),
    s AS (SELECT list(k ORDER BY k) AS v FROM (SELECT abs(epoch(sent) - epoch(d))::DOUBLE AS k FROM m WHERE sent IS NOT NULL))
    SELECT count(*) AS scanned, count(pm) AS trusted_present, count(*) - count(pm) AS trusted_absent, count(*) - count(mid) AS id_absent, count(*) FILTER (WHERE mid LIKE '%@in.example') AS id_of_domain,
        count(*) FILTER (WHERE mid <> ext || '@in.example') AS id_not_external, (SELECT count(*) FROM (SELECT mid FROM m WHERE mid IS NOT NULL AND pm IS NOT NULL GROUP BY mid HAVING count(DISTINCT pm) > 1)) AS ids_shared,
        (SELECT v[ceil(0.5 * len(v))::BIGINT] FROM s) AS skew_p50, (SELECT v[ceil(0.95 * len(v))::BIGINT] FROM s) AS skew_p95 FROM m
    """
)
def folder_identity_stats(spark, sf_dir):
    """Lines are messages: suppliers their trusted ids, order numbers their message ids, order dates their own dates."""
    k = F.col("l_orderkey")
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("sent_at"))
    host = F.when(k % 2 == 0, "@in.example").otherwise("@b@x")
    lines = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey", "left").select(
        F.when(F.col("l_linenumber") % 3 > 0, F.col("l_suppkey")).alias("trusted_id"), F.when(F.col("l_partkey") % 5 > 0, F.concat((k % 3000).cast("string"), host)).alias("message_id"),
        F.concat(k.cast("string"), F.lit("@in.example")).alias("external_id"), "sent_at", F.col("l_shipdate").alias("internal_date"),
    )
    return model_tier.identity_stats(lines, "in.example")


@query(
    r"""
    WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages),
    v AS (SELECT *, CASE page_id % 4 WHEN 0 THEN host WHEN 1 THEN '.' || host WHEN 2 THEN repeat('a', 254) ELSE '' END AS d, CASE page_id % 3 WHEN 0 THEN 'a@' || host WHEN 1 THEN host WHEN 2 THEN 'a' || chr(9) || '@b' END AS a,
        CASE page_id % 4 WHEN 0 THEN 'R&D news-1' WHEN 1 THEN 'two  spaces' WHEN 2 THEN 'x/' || host ELSE 'line' || chr(10) END AS c FROM p)
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'malformed' WHEN 2 THEN 'too_long' ELSE 'empty' END AS domain, CASE page_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'malformed' ELSE 'control' END AS address,
        CASE page_id % 4 WHEN 0 THEN 'ok' WHEN 3 THEN 'control' ELSE CASE WHEN length(c) > 40 THEN 'too_long' ELSE 'malformed' END END AS category, CASE WHEN regexp_full_match(md5(host) || md5(d), '[0-9a-f]{64}') AND page_id % 2 = 0 THEN 'ok' ELSE 'malformed' END AS hash FROM v
    """
)
def entry_forms(spark, sf_dir):
    """Hosts of pages as domains, addresses and categories, right and wrong ones, and hashes in small and capital letters."""
    k, host = F.col("page_id"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    domain = F.when(k % 4 == 0, host).when(k % 4 == 1, F.concat(F.lit("."), host)).when(k % 4 == 2, F.repeat(F.lit("a"), 254)).otherwise("")
    address = F.when(k % 3 == 0, F.concat(F.lit("a@"), host)).when(k % 3 == 1, host).otherwise("a\t@b")
    category = F.when(k % 4 == 0, "R&D news-1").when(k % 4 == 1, "two  spaces").when(k % 4 == 2, F.concat(F.lit("x/"), host)).otherwise("line\n")
    digest = F.sha2(host, 256)
    checks = {"domain": domain, "address": address, "category": category, "hash": F.when(k % 2 == 0, digest).otherwise(F.concat(F.lit("A"), F.substring(digest, 2, 63)))}
    return table(spark, sf_dir, "pages").select("page_id", *[text.form_check(kind, value).alias(kind) for kind, value in checks.items()])


@query(
    """
    WITH e AS (SELECT event_type, event_id, ts < TIMESTAMP '2024-01-16' AS early FROM events), big AS (SELECT event_type FROM e WHERE early GROUP BY 1 HAVING count(*) > (SELECT count(*) FROM e WHERE early) // 5)
    SELECT event_type AS folder, event_id AS uid, CASE WHEN event_type NOT IN (FROM big) THEN CASE WHEN early THEN 0 ELSE 1 END WHEN event_type <> (SELECT min(event_type) FROM big) THEN NULL ELSE 1 END::BIGINT AS batch_id
    FROM e WHERE event_type NOT IN (FROM big) OR event_type = (SELECT min(event_type) FROM big)
    """
)
def valve_release(spark, sf_dir):
    """Event types are folders that fill in two batches. Those with more than a fifth of the first are held, with all their rows; of these the owner approves the first by name, whose rows of both batches are stored in the second."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("folder"), F.col("event_id").cast("string").alias("identity"), F.col("event_id").alias("uid"), F.col("ts").cast("timestamp").alias("internal_date"))
    home, cut = workspace.scratch(spark, "valve"), F.lit("2024-01-16").cast("timestamp")
    store, state = f"{home}/store", f"{home}/state"
    early, late = events.where(F.col("internal_date") < cut), events.where(F.col("internal_date") >= cut)
    cap = early.count() // 5
    ingest.store_batch(early, store, state, 0, cap=cap)
    held = ingest.latest_before(spark, f"{state}-holds", "folder string, held boolean", None).where("held").agg(F.min("folder")).first()[0]
    ingest.approve_held(spark, state, [held] if held else [])
    # the approval is for the count of the hold; what has come since has to be within the cap, here the most that came to one folder
    most = late.groupBy("folder").count().agg(F.max("count")).first()[0] or 0
    ingest.store_batch(late, store, state, 1, cap=most)
    return spark.read.schema("folder string, uid long, batch_id long").parquet(store).select("folder", "uid", "batch_id")


@query(
    r"""
    WITH a AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g') AS h FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(h, '</?(p|br|div|li|tr|h1|h2|h3|h4)(\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS h FROM a),
    c AS (SELECT page_id, replace(replace(replace(replace(h, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&') AS h FROM b)
    SELECT page_id, array_to_string(list_filter(list_transform(string_split(h, chr(10)), lambda x: trim(regexp_replace(x, '[\x09-\x0d\x20]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM c
    """
)
def html_text_parsed(spark, sf_dir):
    """Pages as bodies in HTML, read by the parser; as in the SQL, a reference that was cut before its semicolon is text."""
    return table(spark, sf_dir, "pages").select("page_id", text.html_text_closed(F.col("html")).alias("text"))


@query(
    r"""
    WITH d AS (SELECT doc_id, source, lang, text, doc_id % 4 AS k, split_part(text, chr(10), 1) AS subject FROM documents)
    SELECT doc_id AS id, source AS from_address, CASE WHEN k <> 1 THEN lang || '.example' END AS from_domain, CASE WHEN k = 2 THEN NULL ELSE subject END AS subject, CASE WHEN k <> 3 THEN text END AS body,
           CASE WHEN k IN (0, 3) THEN 'Desk, ' || lang END AS from_name, CASE WHEN k = 2 THEN '' ELSE subject END AS shown_subject, CASE WHEN k = 1 THEN 'a.txt|b.txt' ELSE 'a.txt' END AS files, CASE WHEN k <> 3 THEN text ELSE '' END AS shown_body FROM d
    """
)
def entry_views(spark, sf_dir):
    """Documents as candidates: names in quotes, bare addresses or no From header; attachments without names; no subject or no body."""
    k, null = F.col("doc_id") % 4, F.lit(None).cast("string")
    sender = F.when(k.isin(0, 3), F.concat(F.lit('"Desk, '), "lang", F.lit('" <x@y>'))).when(k == 1, "x@y")
    headers = F.when(k == 2, F.create_map(F.lit("to"), F.array(F.lit("z@y")))).otherwise(F.create_map(F.lit("from"), F.array(sender, F.lit("Other <o@y>"))))
    files = F.array(*[F.struct(n.alias("name"), F.lit(1).alias("size")) for n in (F.lit("a.txt"), null, F.when(k == 1, "b.txt"))])
    page = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("from_address"), F.when(k != 1, F.concat("lang", F.lit(".example"))).alias("from_domain"), F.when(k != 2, F.substring_index("text", "\n", 1)).alias("subject"),
        headers.alias("headers"), files.alias("attachments"), F.when(k != 3, F.struct("text", F.lit("text/plain").alias("source"))).alias("body"),
    )
    return candidates.projected(page).select(
        "id", "matchable.*", F.col("untrusted.from_name").alias("from_name"), F.col("untrusted.subject").alias("shown_subject"), F.array_join("untrusted.attachment_names", "|").alias("files"), F.col("untrusted.body").alias("shown_body")
    )
