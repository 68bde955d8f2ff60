"""Contracts, obligations, workflow states, approvals, tags, annotations, locks. Mutable things are logs of events with a latest-row view."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.iterate import bounded
from tessera.operators.reports import latest

#: Rows of a list that is held against every document.
SHORT = 10_000

# Which state may follow which.
TRANSITIONS = {
    "": ["draft"],
    "draft": ["submitted"],
    "submitted": ["in_review"],
    "in_review": ["approved", "rejected", "changes_requested"],
    "changes_requested": ["submitted"],
    "approved": ["executed", "expired", "archived"],
    "rejected": ["archived"],
    "executed": ["archived"],
}

# Patterns of contract fields.
FIELDS = {
    "parties": [r"between\s+([^,]+?)\s+(?:and|&)\s+([^,\.]+)", r"(?:party|parties)\s*[:.]\s*([^\n]+)", r'(?:hereinafter|hereafter)\s+(?:referred to as|called)\s+"([^"]+)"'],
    "effective_date": [r"(?:effective|start|commencement)\s+date\s*[:.]?\s*([^\n]{5,30})", r"(?:dated|entered into)\s+(?:as of\s+)?([^\n]{5,30})", r"(?:this agreement|this contract).*(?:dated|of)\s+([^\n]{5,30})"],
    "expiration_date": [r"(?:expir(?:ation|es?)|end|termination)\s+date\s*[:.]?\s*([^\n]{5,30})", r"(?:valid|effective)\s+(?:until|through)\s+([^\n]{5,30})"],
    "governing_law": [r"(?:governing|applicable)\s+law\s*[:.]?\s*([^\n]+)", r"(?:governed by|construed under|subject to)\s+(?:the laws of\s+)?([^\n]+)", r"(?:jurisdiction|venue)\s*[:.]?\s*([^\n]+)"],
    "contract_type": [r"(?:this\s+)(\w+\s+agreement|\w+\s+contract)", r"(?:non-disclosure|confidentiality|master\s+service|statement\s+of\s+work|employment)"],
    "total_value": [r"(?:total|aggregate|contract)\s+(?:value|amount|price|consideration)\s*[:.]?\s*([^\n]+)", r"\$[\d,]+\.?\d*", r"(?:sum of|amount of)\s+([^\n]+)"],
    "payment_schedule": [r"(?:payment|billing)\s+(?:schedule|terms|frequency)\s*[:.]?\s*([^\n]+)", r"(?:payable|due|invoiced?)\s+(?:within|on|by|every)\s+([^\n]+)", r"(?:net\s+\d+|\d+\s+days)"],
    "penalties": [r"(?:penalty|penalties|liquidated damages|late fee)\s*[:.]?\s*([^\n]+)", r"(?:interest|surcharge)\s+(?:of|at)\s+([^\n]+)"],
    "interest_rate": [r"(?:interest|apr|rate)\s*[:.]?\s*(\d+\.?\d*\s*%)"],
    "deadlines": [r"(?:deadline|due date|by|before|no later than)\s*[:.]?\s*([^\n]+)", r"(?:within|\d+)\s+(?:business\s+)?days"],
    "deliverables": [r"(?:deliverable|milestone|shall deliver|shall provide)\s*[:.]?\s*([^\n]+)"],
    "responsibilities": [r"(?:responsible for|shall|obligation|duty|must)\s+([^\n]+)"],
    "auto_renewal": [r"(?:auto(?:-|\s)?renew|automatically\s+renew)"],
    "renewal_notice_period": [r"(?:renewal|non-renewal)\s+notice\s*[:.]?\s*([^\n]+)", r"(?:notice of)\s+(?:renewal|non-renewal)\s+([^\n]+)"],
    "termination_triggers": [r"(?:terminat(?:e|ion))\s+(?:upon|if|in the event|for cause)\s*[:.]?\s*([^\n]+)", r"(?:material breach|default|insolvency|bankruptcy)"],
    "termination_notice_period": [r"(?:termination)\s+(?:notice|written notice)\s*[:.]?\s*([^\n]+)", r"(?:\d+)\s+(?:days?|months?)\s+(?:prior\s+)?(?:written\s+)?notice"],
    "indemnification": [r"(?:indemnif(?:y|ication|ies))\s*[:.]?\s*([^\n]+)", r"(?:hold harmless|defend and indemnify)"],
    "liability_limit": [r"(?:limit(?:ation)?\s+(?:of\s+)?liability)\s*[:.]?\s*([^\n]+)", r"(?:aggregate liability|total liability|maximum liability)\s*[:.]?\s*([^\n]+)"],
    "force_majeure": [r"(?:force majeure|act of god|unforeseeable circumstances)"],
    "confidentiality": [r"(?:confidential(?:ity)?|non-disclosure|proprietary information)\s*[:.]?\s*([^\n]+)"],
    "data_protection": [r"(?:data protection|privacy|gdpr|ccpa|personal data|data processing)\s*[:.]?\s*([^\n]+)"],
}


def field_patterns(name: str) -> list[str]:
    return FIELDS.get(name) or ["(?:" + name.replace("_", r"\s+") + r")\s*[:.]?\s*([^\n]+)"]


def named_match(field: str):
    return lambda v: F.struct(F.lit(field).alias("field"), F.trim(F.regexp_replace(v, r"\s+", " ")).alias("value"), F.lit(0.7).alias("confidence"))


def contract_fields(chunks: DataFrame, key: str, text: str, fields: list[str], heading: str | None = None) -> DataFrame:
    """key, field, value, confidence: every pattern match (0.7) and every heading that names the field (0.8). One pass: each chunk is tried against all patterns where it lies."""
    found = []
    for f in fields:
        for p in field_patterns(f):
            found.append(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)" + p), F.lit(0)), named_match(f)))
        if heading:
            named = F.contains(F.lower(heading), F.lit(f.replace("_", " ")))
            found.append(F.when(named, F.array(F.struct(F.lit(f).alias("field"), F.col(text).alias("value"), F.lit(0.8).alias("confidence")))))
    each = F.concat(*[F.coalesce(x, F.array().cast("array<struct<field:string,value:string,confidence:double>>")) for x in found])
    return chunks.select(key, F.explode(each).alias("m")).select(key, "m.*")


def best_fields(found: DataFrame, document: str) -> DataFrame:
    """The most confident value of each field of a document; of equals the first in order."""
    best = F.max_by("value", F.struct("confidence", F.negative(F.length("value")), "value"))
    return found.groupBy(document, "field").agg(best.alias("value"), F.max("confidence").alias("confidence"), F.count("*").alias("n"))


def match_context(text: Column, at: Column, size: Column, before: int = 50, after: int = 200) -> Column:
    """Text around a match (1-based place), blanks collapsed, cut ends shown as '...'."""
    start, end = F.greatest(F.lit(1), at - before), F.least(F.length(text) + 1, at + size + after)
    cut = F.trim(F.regexp_replace(F.substring(text, start, end - start), r"\s+", " "))
    return F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(end <= F.length(text), "...").otherwise(""))


def playbook(chunks: DataFrame, document: str, text: str, clauses: DataFrame) -> DataFrame:
    """document, clause_name, severity, status: how a document has each clause: match (preferred text), alternative, deviation (only its name) or missing.

    clauses (clause_name, preferred_text, severity, alternatives) are at most
    `SHORT` rows, which is checked; each is tried on every chunk; one aggregation
    by document and clause.
    """
    body = F.lower(text)
    has = lambda c: F.contains(body, F.lower(c))
    status = F.when(has(F.col("preferred_text")), 1).when(F.exists("alternatives", lambda a: F.contains(body, F.lower(a))), 2).when(has(F.col("clause_name")), 3).otherwise(4)
    tried = chunks.select(document, text).join(F.broadcast(bounded(clauses, SHORT, "clauses")), F.lit(True)).select(document, "clause_name", "severity", status.alias("p"))
    best = tried.groupBy(document, "clause_name", "severity").agg(F.min("p").alias("p"))
    return best.select(document, "clause_name", "severity", F.element_at(F.array(*map(F.lit, ("match", "alternative", "deviation", "missing"))), F.col("p")).alias("status"))


def playbook_scores(statuses: DataFrame, document: str) -> DataFrame:
    good = F.count_if(F.col("status").isin("match", "alternative"))
    return statuses.groupBy(document).agg(F.count("*").alias("n_clauses"), good.alias("n_good"), F.round(100.0 * good / F.count("*"), 2).alias("score"))


def calendar(obligations: DataFrame, due: str, now: Column, months: int) -> DataFrame:
    """Obligations due from now within some months, by month."""
    own = obligations.where((F.col(due) >= now) & (F.col(due) <= F.add_months(now, months).cast("timestamp")))
    return own.groupBy(F.date_format(due, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def overdue(obligations: DataFrame, status: str, due: str, now: Column) -> DataFrame:
    """Active obligations whose time has passed become overdue."""
    return obligations.withColumn(status, F.when((F.col(status) == "active") & (F.col(due) < now), F.lit("overdue")).otherwise(F.col(status)))


def transitions(events: DataFrame, key: str, state: str, *order: str) -> DataFrame:
    """events with `previous` and `valid`: may the state follow the last valid one of its key?

    An event that may not is not a state: the next one is judged against the
    state before. Events are sorted by key and folded as they stream, so a task
    holds one batch and the state of one key.
    """
    schema = T.StructType([*events.schema.fields, T.StructField("previous", T.StringType()), T.StructField("valid", T.BooleanType())])

    def fold(batches):
        at, now = None, None
        for b in batches:
            before, valid = [], []
            for k, s in zip(b.column(key).to_pylist(), b.column(state).to_pylist(), strict=True):
                if (k,) != at:
                    at, now = (k,), None
                before.append(now)
                valid.append(s in TRANSITIONS.get(now or "", ()))
                now = s if valid[-1] else now
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.string()), pa.array(valid, pa.bool_())], names=[f.name for f in schema])

    return events.repartition(key).sortWithinPartitions(key, *order).mapInArrow(fold, schema)


def status_history(log: DataFrame, key: str, *order: str) -> DataFrame:
    """key, status, reason, history: the last status of each obligation, and the changes that led to it as JSON (from, to, reason), oldest first."""
    own = Window.partitionBy(key).orderBy(*order)
    steps = log.withColumn("_from", F.lag("status").over(own)).withColumn("_n", F.row_number().over(own))
    change = F.when(F.col("_from").isNotNull(), F.struct("_n", F.col("_from").alias("from"), F.col("status").alias("to"), "reason"))
    kept = F.transform(F.array_sort(F.collect_list(change)), lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"), x["reason"].alias("reason")))
    return steps.groupBy(key).agg(F.max_by("status", "_n").alias("status"), F.max_by("reason", "_n").alias("reason"), F.to_json(kept).alias("history"))


def apply_tags(links: DataFrame, new: DataFrame) -> DataFrame:
    """Tag links (tag, entity_id, entity_type) with new ones, each once."""
    return links.unionByName(new).dropDuplicates(["tag", "entity_id", "entity_type"])


def tag_workflow(links: DataFrame, prefix: str = "workflow:") -> DataFrame:
    """entity_id, state, since: the state that the last tag with the prefix names."""
    own = links.where(F.startswith("tag", F.lit(prefix)))
    return own.groupBy("entity_id").agg(F.max_by(F.substring("tag", len(prefix) + 1, 1000), F.struct("created_at", "tag")).alias("state"), F.max("created_at").alias("since"))


def clause_context(text: Column, clause: Column, around: int = 100) -> Column:
    """Text around the first place of a clause, in either case; null where it is not there."""
    at = F.instr(F.lower(text), F.lower(clause))
    start = F.greatest(F.lit(1), at - around)
    end = F.least(F.length(text) + 1, at + F.length(clause) + around)
    return F.when(at > 0, F.concat(F.when(start > 1, "...").otherwise(""), F.trim(F.substring(text, start, end - start)), F.when(end <= F.length(text), "...").otherwise("")))


def queue(events: DataFrame, key: str, *order: str) -> DataFrame:
    return latest(events, key, *order)


def approval_steps(applied: DataFrame, chains: DataFrame) -> DataFrame:
    """Steps of each applied chain, in order, all pending."""
    return applied.join(chains, "chain_id").select("document_id", "chain_id", F.posexplode("steps").alias("pos", "required_role")).select("document_id", "chain_id", (F.col("pos") + 1).alias("step_order"), "required_role", F.lit("pending").alias("status"))


def parts(rows: DataFrame, each: int = 1_000_000) -> int:
    """In how many parts rows are dealt so that a task sorts about `each` of them, however many there are."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))


def decided(steps: DataFrame) -> DataFrame:
    """Steps after a rejection are skipped."""
    own = Window.partitionBy("document_id", "chain_id").orderBy("step_order").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max(F.col("status") == "rejected").over(own), F.lit(False))
    return steps.withColumn("status", F.when(stopped, F.lit("skipped")).otherwise(F.col("status")))


def approval_progress(steps: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return steps.groupBy("document_id", "chain_id").agg(F.count("*").alias("total"), n("approved").alias("approved"), n("rejected").alias("rejected"), n("pending").alias("pending"), F.min(F.when(F.col("status") == "pending", F.col("step_order"))).alias("current_step"), (n("approved") == F.count("*")).alias("complete"))


def tagged(links: DataFrame, tags: list[str], every: bool) -> DataFrame:
    """entity_id with any, or all, of some tags, and which."""
    own = links.where(F.col("tag").isin(tags)).groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"), F.count_distinct("tag").alias("n"))
    return own.where(F.col("n") == len(set(tags))) if every else own


def tag_counts(tags: DataFrame, links: DataFrame) -> DataFrame:
    """Uses of each tag, 0 included."""
    return tags.join(links.groupBy("tag").agg(F.count("*").alias("uses")), "tag", "left").select("tag", F.coalesce("uses", F.lit(0)).alias("uses"))


def threads(annotations: DataFrame) -> DataFrame:
    """Root annotations with the number of replies and the last of them."""
    replies = annotations.where(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.count("*").alias("replies"), F.max("created_at").alias("last_reply"))
    roots = annotations.where(F.col("parent_id").isNull())
    return roots.join(replies.withColumnRenamed("parent_id", "id"), "id", "left").select("id", F.coalesce("replies", F.lit(0)).alias("replies"), "last_reply")


def locks(events: DataFrame, now: Column, ttl_minutes: int = 30) -> DataFrame:
    """Documents locked at a time: the last lock event of each that is not an unlock and has not expired."""
    last = latest(events, "document_id", "ts", "event_id")
    until = F.col("ts") + F.make_interval(mins=F.lit(ttl_minutes))
    return last.where((F.col("action") == "lock") & (until > now)).select("document_id", "user_id", until.alias("expires_at"))


def alerts(searches: DataFrame, documents: DataFrame, hit: Column) -> DataFrame:
    """New documents for each saved search since its last alert (from the beginning where there was none). searches has at most `SHORT` rows, which is checked."""
    since = F.coalesce("last_alert", F.lit("1970-01-01").cast("timestamp"))
    return documents.join(F.broadcast(bounded(searches, SHORT, "saved searches")), hit & (F.col("created_at") > since))
