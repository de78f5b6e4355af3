"""Queries over events and documents: attempts, failures, windows, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayline.operators import attempts, files, windows
from assayline.plans.incidents import incident_counts, incident_windows, log_reports
from assayline.workload.registry import query
from assayline.workload.text_queries import LINE_SQL, document_lines

# --- attempts ----------------------------------------------------------------


@query(
    "attempt_chains",
    """
    WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
                      CASE WHEN event_type = 'view' THEN props ELSE '' END AS raw FROM events),
    c AS (SELECT user_id, min(rn) FILTER (WHERE event_type IN ('purchase', 'error')) AS cut FROM e GROUP BY user_id),
    k AS (SELECT e.* FROM e JOIN c USING (user_id) WHERE cut IS NULL OR rn <= cut)
    SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0 THEN 'ok'
                         WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'aborted' ELSE 'exhausted' END AS outcome,
           count(*) AS attempts, max(event_id) FILTER (WHERE event_type = 'purchase') AS winner,
           arg_max(raw, rn) FILTER (WHERE raw <> '') AS last_payload
    FROM k GROUP BY user_id
    """,
)
def attempt_chains(t):
    tried = t.events.select(
        "user_id", "ts", "event_id", "event_type",
        F.when(F.col("event_type") == "view", F.col("props")).otherwise("").alias("raw"),
    )
    return attempts.resolve_attempts(
        tried, ["user_id"], ["ts", "event_id"], "event_type", "raw", "event_id", ok="purchase", fatal=["error"]
    )


_CLASS_SQL = """
    CASE WHEN contains(m, '401') OR contains(lower(m), 'authentication') OR contains(lower(m), 'invalid api key') THEN 'auth'
         WHEN contains(m, '503') OR contains(m, 'UNAVAILABLE') OR contains(lower(m), 'overloaded') THEN 'busy'
         WHEN contains(m, '429') OR contains(m, 'RESOURCE_EXHAUSTED') OR contains(lower(m), 'quota') THEN 'rate'
         WHEN contains(m, '404') OR contains(m, 'NOT_FOUND') THEN 'missing' ELSE 'unexpected' END
"""
# Failure messages: the document's length and key as a code in front of its text.
_MESSAGES_SQL = "SELECT doc_id, source, (400 + n_chars % 120) || ' ' || text AS m FROM documents"


def _messages(t):
    code = (400 + F.col("n_chars") % 120).cast("string")
    return t.documents.select("doc_id", "source", F.concat(code, F.lit(" "), F.col("text")).alias("m"))


@query(
    "failure_classes",
    f"SELECT source, {_CLASS_SQL} AS failure, count(*) AS n FROM ({_MESSAGES_SQL}) GROUP BY ALL",
)
def failure_classes(t):
    return attempts.failure_counts(attempts.classify_failures(_messages(t), "m"), ["source"])


@query(
    "failure_retry",
    f"""
    SELECT doc_id, CASE WHEN contains(m, '401') OR contains(lower(m), 'authentication') THEN 'auth' ELSE 'unexpected' END AS refine,
           contains(m, '401') OR contains(lower(m), 'authentication') AS refine_fatal,
           CASE WHEN contains(m, '503') OR contains(m, 'UNAVAILABLE') THEN 'busy'
                WHEN contains(m, '429') OR contains(m, 'RESOURCE_EXHAUSTED') THEN 'rate' ELSE 'unexpected' END AS repair
    FROM ({_MESSAGES_SQL})
    """,
)
def failure_retry(t):
    refined = attempts.classify_failures(_messages(t), "m", attempts.REFINE, attempts.REFINE_FATAL)
    named = refined.withColumnsRenamed({"failure": "refine", "fatal": "refine_fatal"})
    repaired = attempts.classify_failures(named, "m", attempts.REPAIR, attempts.REPAIR_FATAL)
    return repaired.select("doc_id", "refine", "refine_fatal", F.col("failure").alias("repair"))


@query(
    "latest_payload",
    """
    SELECT user_id, event_id, event_type, event_type = 'purchase' AS reusable,
           CASE WHEN event_type <> 'purchase' THEN event_type END AS reuse_error
    FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
    """,
)
def latest_payload(t):
    last = attempts.latest_payload(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])
    return attempts.reuse_check(last, "event_type", "purchase").drop("ts")


@query(
    "judged_payloads",
    """
    SELECT user_id, event_id, event_type, length(props) AS chars, event_type = 'purchase' AS reusable
    FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
    """,
)
def judged_payloads(t):
    """Two runs: over the events of the first half year, then over all of them with the ledger of the first."""
    def judge(rows):
        return attempts.reuse_check(rows, "event_type", "purchase").withColumn("chars", F.length("props"))

    ledger = None
    for seen in (t.events.filter("ts < TIMESTAMP '2024-07-01 00:00:00'"), t.events):
        ledger = attempts.judge_unseen(seen, ledger, ["user_id"], ["ts", "event_id"], judge, ["event_type", "chars", "reusable"])
    return ledger.select("user_id", "event_id", "event_type", "chars", "reusable")


# --- windows -----------------------------------------------------------------


def _greedy_sql(lines: str, key: str, trigger: str, k: int) -> str:
    """Starts (key, n) by plain recursion: from each start, the next trigger k lines on."""
    return f"""
    WITH RECURSIVE ln AS ({lines}),
    tr AS (SELECT {key}, n FROM ln WHERE {trigger}),
    st AS (SELECT {key}, min(n) AS n FROM tr GROUP BY {key}
           UNION ALL
           SELECT st.{key}, min(tr.n) FROM st JOIN tr ON tr.{key} = st.{key} AND tr.n >= st.n + {k} GROUP BY st.{key}, st.n)
    """


_EVENT_LINES = """
    SELECT user_id, event_type, value, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
"""
_WINDOW_SQL = (
    _greedy_sql(_EVENT_LINES, "user_id", "event_type = 'error'", 10)
    + """
    , w AS (SELECT st.user_id, st.n AS start_line, max(ln.props) FILTER (WHERE ln.n = st.n) AS subject,
                   count(*) AS events, sum(ln.value) AS total
            FROM st JOIN ln ON ln.user_id = st.user_id AND ln.n BETWEEN st.n AND st.n + 9 GROUP BY ALL)
    """
)
_FIRST = "SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY user_id, subject ORDER BY start_line) = 1"


def _event_windows(t, **options):
    return incident_windows(
        t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", "props", "value", **options
    )


@query(
    "error_windows",
    _WINDOW_SQL + "SELECT user_id, start_line, events, round(total, 2) AS total FROM w",
)
def error_windows(t):
    return _event_windows(t, dedup=False).select("user_id", "start_line", "events", F.round("total", 2).alias("total"))


@query(
    "incidents",
    _WINDOW_SQL + f"SELECT user_id, start_line, subject, events, round(total, 2) AS total FROM ({_FIRST})",
)
def incidents(t):
    return _event_windows(t).withColumn("total", F.round("total", 2))


@query(
    "incident_counts",
    _WINDOW_SQL
    + f"SELECT user_id, count(*) AS incidents, sum(events)::BIGINT AS events, round(sum(total), 2) AS total FROM ({_FIRST}) GROUP BY user_id",
)
def incident_counts_by_user(t):
    return incident_counts(_event_windows(t), ["user_id"])


# Documents read as logs: a line that starts with T or E opens a block of three lines.
_LOG_SQL = (
    _greedy_sql(f"SELECT doc_id, line_no AS n, line FROM ({LINE_SQL})", "doc_id", "regexp_matches(line, '^[TE]')", 3)
    + """
    , b AS (SELECT st.doc_id, st.n AS start_line, trim(max(ln.line) FILTER (WHERE ln.n = st.n)) AS trigger_text,
                   regexp_replace(string_agg(ln.line, chr(10) ORDER BY ln.n), '^\\s+|\\s+$', '', 'g') AS block
            FROM st JOIN ln ON ln.doc_id = st.doc_id AND ln.n BETWEEN st.n AND st.n + 2 GROUP BY ALL),
    f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, trigger_text ORDER BY start_line) = 1),
    p AS (SELECT doc_id, start_line, trigger_text, block FROM f
          UNION ALL SELECT DISTINCT doc_id, NULL, NULL, '[no structured error pattern found in log]' FROM documents
          WHERE doc_id NOT IN (SELECT doc_id FROM tr))
    """
)


@query(
    "log_blocks",
    _LOG_SQL + "SELECT doc_id, start_line, md5(trigger_text) AS trigger_digest, md5(block) AS digest FROM p",
)
def log_blocks(t):
    opens = F.col("line").rlike("^[TE]")
    blocks = windows.error_blocks(document_lines(t), ["doc_id"], trigger=opens, k=3, keys=t.documents.select("doc_id"))
    return blocks.select(
        "doc_id", "start_line", F.md5("trigger_text").alias("trigger_digest"), F.md5("block").alias("digest")
    )


@query(
    "log_reports",
    _LOG_SQL
    + """
    , r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(start_line, 0)) AS i FROM p)
    SELECT doc_id, 0::BIGINT AS part, count(*) AS items,
           md5(string_agg('--- Error block ' || i || ' ---' || chr(10) || block, chr(10) || chr(10) ORDER BY i)) AS digest
    FROM r GROUP BY doc_id
    """,
)
def log_reports_by_document(t):
    reports = log_reports(document_lines(t), ["doc_id"], 100_000, t.documents.select("doc_id"), trigger=F.col("line").rlike("^[TE]"), k=3)
    return reports.select("doc_id", "part", "items", F.md5("text").alias("digest"))


# --- catalogue ---------------------------------------------------------------
# Each event becomes a catalogue document of two models with prices and modalities by its values.


def _catalogue_documents(t):
    k = F.get_json_object("props", "$.k").cast("int")
    price = F.when(k % 3 == 0, '"0"').when(k % 3 == 1, '"0.00"').otherwise("0")
    look = (
        F.when(k % 4 == 0, '"modality":"text->image"')
        .when(k % 4 == 1, '"modality":"","input_modalities":["text","Image"]')
        .when(k % 4 == 2, '"modality":"text"')
        .otherwise('"input_modalities":["text"]')
    )
    name = F.when(k % 2 == 0, F.concat(F.lit('"name":"N'), k.cast("string"), F.lit('",'))).otherwise("")
    return t.events.select(
        F.concat(
            F.lit('{"data":[{"id":"m'), F.col("user_id"), F.lit('",'), name, F.lit('"pricing":{"prompt":"0","completion":'), price,
            F.lit('},"architecture":{'), look, F.lit('},"context_length":'), k.cast("string"),
            F.lit('},{"id":"x'), F.col("event_id"), F.lit('","pricing":{"prompt":"0"},"architecture":{"modality":"image"}}]}'),
        ).alias("json")
    )


@query(
    "catalogue",
    """
    SELECT 'm' || user_id AS id, CASE WHEN k % 2 = 0 THEN 'N' || k ELSE 'm' || user_id END AS name,
           k::VARCHAR AS ctx, '?' AS max_out, count(*) AS copies
    FROM (SELECT user_id, json_extract_string(props, '$.k')::INT AS k FROM events)
    WHERE k % 3 IN (0, 2) AND k % 4 IN (0, 1) GROUP BY ALL
    """,
)
def catalogue(t):
    return files.filter_catalogue(_catalogue_documents(t))
