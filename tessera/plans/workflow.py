"""Queries: contracts, obligations, workflow, approvals, tags, annotations, locks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import workflow
from tessera.operators.corpus import Corpus
from tessera.plans.registry import query

NOW = "timestamp '1996-01-01'"
STATES = "case event_type when 'signup' then 'draft' when 'click' then 'submitted' when 'view' then 'in_review' when 'purchase' then 'approved' else 'rejected' end"


def now():
    return F.lit("1996-01-01").cast("timestamp")


@query(r"""with p as (select doc_id, unnest(regexp_extract_all(text, '(?i)(?:within|\d+)\s+(?:business\s+)?days')) as v, 'deadlines' as field from documents union all select doc_id, unnest(regexp_extract_all(text, '(?i)(?:force majeure|act of god|unforeseeable circumstances)')), 'force_majeure' from documents union all select doc_id, unnest(regexp_extract_all(text, '(?i)(?:deadline|due date|by|before|no later than)\s*[:.]?\s*([^\n]+)')), 'deadlines' from documents)
 select doc_id, field, first(trim(regexp_replace(v, '\s+', ' ', 'g')) order by length(trim(regexp_replace(v, '\s+', ' ', 'g'))), trim(regexp_replace(v, '\s+', ' ', 'g')) desc) as value, count(*) as n, 0.7::double as confidence from p group by doc_id, field""")
def contract_fields(spark, sf):
    found = workflow.contract_fields(Corpus(spark, sf).documents, "doc_id", "text", ["deadlines", "force_majeure"])
    return workflow.best_fields(found, "doc_id").select("doc_id", "field", "value", "n", "confidence")


CLAUSES = [("law", "of the and", "high", ["with the", "der die"]), ("term", "und das", "low", ["que la"]), ("the", "zzz never", "low", [])]


def statuses(spark, sf):
    clauses = spark.createDataFrame(CLAUSES, "clause_name string, preferred_text string, severity string, alternatives array<string>")
    return workflow.playbook(Corpus(spark, sf).conversations, "conv_id", "text", clauses)


PLAYBOOK = """cl as (select * from (values ('law', 'of the and', 'high', ['with the', 'der die']), ('term', 'und das', 'low', ['que la']), ('the', 'zzz never', 'low', []::varchar[])) t(clause_name, preferred_text, severity, alternatives)),
  st as (select conv_id, clause_name, severity, min(case when contains(lower(text), preferred_text) then 1 when len(list_filter(alternatives, lambda a: contains(lower(text), a))) > 0 then 2 when contains(lower(text), clause_name) then 3 else 4 end) as p from conversations, cl group by all),
  ps as (select conv_id, clause_name, severity, ['match', 'alternative', 'deviation', 'missing'][p] as status from st)"""


@query(f"with {PLAYBOOK} select * from ps")
def playbook_compare(spark, sf):
    return statuses(spark, sf)


@query(f"with {PLAYBOOK} select conv_id, count(*) as n_clauses, count(*) filter (status in ('match', 'alternative')) as n_good, round(100.0::double * count(*) filter (status in ('match', 'alternative')) / count(*), 2) as score from ps group by 1")
def playbook_scores(spark, sf):
    return workflow.playbook_scores(statuses(spark, sf), "conv_id")


@query(f"select strftime(o_orderdate, '%Y-%m') as month, count(*) as n from orders where o_orderdate >= {NOW} and o_orderdate <= {NOW} + interval 6 month group by 1")
def obligation_calendar(spark, sf):
    return workflow.calendar(Corpus(spark, sf).orders, "o_orderdate", now(), 6)


@query(f"select case when o_orderstatus = 'O' and o_orderdate < {NOW} then 'overdue' when o_orderstatus = 'O' then 'active' else 'fulfilled' end as status, count(*) as n from orders group by 1")
def mark_overdue(spark, sf):
    own = Corpus(spark, sf).orders.withColumn("status", F.when(F.col("o_orderstatus") == "O", "active").otherwise("fulfilled"))
    return workflow.overdue(own, "status", "o_orderdate", now()).groupBy("status").agg(F.count("*").alias("n"))


def states(spark, sf):
    return Corpus(spark, sf).events.withColumn("state", F.expr(STATES))


@query(f"select user_id, event_id, {STATES} as state from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def workflow_latest(spark, sf):
    return workflow.queue(states(spark, sf), "user_id", "ts", "event_id").select("user_id", "event_id", "state")


ALLOWED = "(now is null and state = 'draft') or (now = 'draft' and state = 'submitted') or (now = 'submitted' and state = 'in_review') or (now = 'in_review' and state in ('approved', 'rejected', 'changes_requested')) or (now = 'rejected' and state = 'archived')"


@query(
    f"""with recursive n as (select event_id, user_id, {STATES} as state, row_number() over (partition by user_id order by ts, event_id) as i from events),
    w(user_id, i, event_id, state, previous, valid, now) as (
      select user_id, i, event_id, state, null::varchar, state = 'draft', case when state = 'draft' then state end from n where i = 1
      union all select user_id, i, event_id, state, now, ok, case when ok then state else now end from (select n.*, w.now, coalesce({ALLOWED.replace("state", "n.state").replace("now", "w.now")}, false) as ok from w join n on n.user_id = w.user_id and n.i = w.i + 1))
    select event_id, state, previous, valid from w"""
)
def workflow_transitions(spark, sf):
    return workflow.transitions(states(spark, sf), "user_id", "state", "ts", "event_id").select("event_id", "state", "previous", "valid")


@query(
    f"""with l as (select user_id, event_id, ts, case when value > 50 then 'fulfilled' when value > 20 then 'active' else 'waived' end as status, event_type as reason from events),
    s as (select *, lag(status) over (partition by user_id order by ts, event_id) as before, row_number() over (partition by user_id order by ts, event_id) as i from l)
    select user_id, arg_max(status, i) as status, arg_max(reason, i) as reason, count(before) as changes, string_agg(before || '>' || status || ':' || reason, ',' order by i) as steps from s group by user_id"""
)
def obligation_history(spark, sf):
    log = Corpus(spark, sf).events.withColumn("status", F.when(F.col("value") > 50, "fulfilled").when(F.col("value") > 20, "active").otherwise("waived")).withColumnRenamed("event_type", "reason")
    out = workflow.status_history(log, "user_id", "ts", "event_id")
    steps = F.from_json("history", "array<struct<`from`:string,`to`:string,reason:string>>")
    text = F.array_join(F.transform(steps, lambda x: F.concat(x["from"], F.lit(">"), x["to"], F.lit(":"), x["reason"])), ",")
    return out.select("user_id", "status", "reason", F.size(steps).cast("long").alias("changes"), F.when(F.size(steps) > 0, text).alias("steps"))


@query("select user_id as entity_id, arg_max(event_type, (ts, event_type)) as state, max(ts) as since from events where event_type <> 'error' group by user_id")
def tag_workflow(spark, sf):
    tag = F.concat(F.when(F.col("event_type") == "error", "other:").otherwise("workflow:"), F.col("event_type"))
    links = Corpus(spark, sf).events.select(tag.alias("tag"), F.col("user_id").alias("entity_id"), F.lit("document").alias("entity_type"), F.col("ts").alias("created_at"))
    return workflow.tag_workflow(links).withColumn("since", F.col("since").cast("timestamp"))


@query("select distinct event_type as tag, user_id as entity_id, 'document' as entity_type from events")
def tags_applied(spark, sf):
    links = Corpus(spark, sf).events.select(F.col("event_type").alias("tag"), F.col("user_id").alias("entity_id"), F.lit("document").alias("entity_type"))
    return workflow.apply_tags(links, links.where("tag = 'click'"))


@query("""with t as (select conv_id, turn, text, instr(lower(text), 'of the') as p from conversations) select conv_id, turn, case when p > 101 then '...' else '' end || trim(substr(text, greatest(1, p - 100)::bigint, (least(length(text) + 1, p + 106) - greatest(1, p - 100))::bigint)) || case when p + 106 <= length(text) then '...' else '' end as context from t where p > 0""")
def clause_contexts(spark, sf):
    own = Corpus(spark, sf).conversations.select("conv_id", "turn", workflow.clause_context(F.col("text"), F.lit("OF the")).alias("context"))
    return own.where("context is not null")


STEPS = """st as (select o_orderkey as document_id, o_custkey % 3 as chain_id, l_linenumber * 100000000000000::bigint + l_partkey * 10000000 + l_suppkey as step_order, case when l_returnflag = 'R' then 'rejected' when l_returnflag = 'A' then 'approved' else 'pending' end as s from orders join lineitem on o_orderkey = l_orderkey),
  ft as (select *, case when coalesce(bool_or(s = 'rejected') over (partition by document_id, chain_id order by step_order rows between unbounded preceding and 1 preceding), false) then 'skipped' else s end as status from st)"""


@query(f"with {STEPS} select document_id, chain_id, count(*) as total, count(*) filter (status = 'approved') as approved, count(*) filter (status = 'rejected') as rejected, count(*) filter (status = 'pending') as pending, min(case when status = 'pending' then step_order end) as current_step, count(*) filter (status = 'approved') = count(*) as complete from ft group by 1, 2")
def approval_progress(spark, sf):
    c = Corpus(spark, sf)
    status = F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "approved").otherwise("pending")
    # the join, the window and the counts all follow this one dealing
    n = workflow.parts(c.lineitem)
    steps = c.orders.repartition(n, "o_orderkey").join(c.lineitem.repartition(n, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("document_id"), (F.col("o_custkey") % 3).alias("chain_id"), (F.col("l_linenumber") * F.lit(100000000000000) + F.col("l_partkey") * 10000000 + F.col("l_suppkey")).alias("step_order"), status.alias("status"))
    return workflow.approval_progress(workflow.decided(steps))


@query("""select c_custkey as document_id, c_nationkey % 2 as chain_id, step::integer as step_order, ['editor', 'reviewer', 'admin'][step] as required_role, 'pending' as status from customer, (values (1), (2), (3)) t(step) where step <= 2 + c_nationkey % 2""")
def approval_steps(spark, sf):
    chains = spark.createDataFrame([(0, ["editor", "reviewer"]), (1, ["editor", "reviewer", "admin"])], "chain_id int, steps array<string>")
    applied = Corpus(spark, sf).customer.select(F.col("c_custkey").alias("document_id"), (F.col("c_nationkey") % 2).alias("chain_id"))
    return workflow.approval_steps(applied, chains)


def links(spark, sf):
    return Corpus(spark, sf).part.select(F.col("p_partkey").alias("entity_id"), F.explode(F.array_distinct(F.array("p_brand", F.element_at(F.split("p_type", " "), 1)))).alias("tag"))


LINKS = "k as (select distinct p_partkey as entity_id, unnest([p_brand, string_split(p_type, ' ')[1]]) as tag from part), tt as (select list_sort(list(distinct tag))[1:3] as ts from k)"


def tags(spark, sf):
    return links(spark, sf).select("tag").distinct().orderBy("tag").limit(3).agg(F.array_sort(F.collect_list("tag")).alias("ts")).scalar()


@query(f"with {LINKS} select entity_id, string_agg(distinct tag, ',' order by tag) as tags, count(distinct tag) as n from k, tt where list_contains(ts, tag) group by entity_id")
def tags_any(spark, sf):
    own = [r.tag for r in links(spark, sf).select("tag").distinct().orderBy("tag").limit(3).collect()]
    return workflow.tagged(links(spark, sf), own, every=False)


@query("with b as (select arg_min(p_brand, p_partkey) as b from part), t as (select arg_min(string_split(p_type, ' ')[1], p_partkey) as t from part) select p_partkey as entity_id, least(b, t) || ',' || greatest(b, t) as tags, 2::bigint as n from part, b, t where p_brand = b and string_split(p_type, ' ')[1] = t")
def tags_all(spark, sf):
    p = Corpus(spark, sf).part
    r = p.agg(F.min_by("p_brand", "p_partkey").alias("b"), F.min_by(F.element_at(F.split("p_type", " "), 1), "p_partkey").alias("t")).first()
    return workflow.tagged(links(spark, sf), [r.b, r.t], every=True)


@query(f"with {LINKS}, a as (select distinct tag from k union select 'unused') select a.tag, count(k.entity_id) as uses from a left join k on a.tag = k.tag group by a.tag")
def tag_counts(spark, sf):
    all_tags = links(spark, sf).select("tag").distinct().unionByName(spark.createDataFrame([("unused",)], "tag string"))
    return workflow.tag_counts(all_tags, links(spark, sf))


def annotations(spark, sf):
    e = Corpus(spark, sf).events
    return e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 != 0, F.floor(F.col("event_id") / 4) * 4).alias("parent_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "event_type", (F.col("user_id") % 3).alias("status"))


@query("""with a as (select event_id as id, case when event_id % 4 <> 0 then event_id // 4 * 4 end as parent_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as created_at from events) select r.id, count(c.id) as replies, max(c.created_at) as last_reply from a r left join a c on c.parent_id = r.id where r.parent_id is null group by r.id""")
def annotation_threads(spark, sf):
    return workflow.threads(annotations(spark, sf))


@query("select event_type, user_id % 3 as status, count(*) as n from events group by all")
def annotation_summary(spark, sf):
    return annotations(spark, sf).groupBy("event_type", "status").agg(F.count("*").alias("n"))


@query("""with l as (select user_id % 50 as document_id, user_id, event_id, ts, case when event_type = 'click' then 'unlock' else 'lock' end as action from events where ts <= timestamp '2024-01-20'), n as (select * from l qualify row_number() over (partition by document_id order by ts desc, event_id desc) = 1) select document_id, user_id from n where action = 'lock' and ts + interval 600 minute > timestamp '2024-01-20'""")
def document_locks(spark, sf):
    at = F.lit("2024-01-20").cast("timestamp")
    log = Corpus(spark, sf).events.where(F.col("ts") <= at).select((F.col("user_id") % 50).alias("document_id"), "user_id", "event_id", "ts", F.when(F.col("event_type") == "click", "unlock").otherwise("lock").alias("action"))
    return workflow.locks(log, at, 600).select("document_id", "user_id")


@query("""with s as (select * from (values (1, 'click', timestamp '2024-01-25'), (2, 'error', null::timestamp), (3, 'view', timestamp '2024-01-29')) t(search_id, q, last_alert)) select search_id, count(*) as n from events, s where event_type = q and ts > coalesce(last_alert, timestamp '1970-01-01') group by 1""")
def alert_check(spark, sf):
    s = spark.createDataFrame([(1, "click", "2024-01-25"), (2, "error", None), (3, "view", "2024-01-29")], "search_id int, q string, last_alert string").withColumn("last_alert", F.col("last_alert").cast("timestamp"))
    docs = Corpus(spark, sf).events.withColumnRenamed("ts", "created_at")
    return workflow.alerts(s, docs, F.col("event_type") == F.col("q")).groupBy("search_id").agg(F.count("*").alias("n"))
