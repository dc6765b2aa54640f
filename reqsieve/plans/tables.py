"""The given tables seen as traffic, rules, runs and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.functions.identity import short_hash
from reqsieve.operators.matching import analyze
from reqsieve.sources.requests import map_columns, usable_rows
from reqsieve.sources.rules import Rule

MAPPING = {
    "id": "req_id", "method": "method", "path": "url", "host": "host",
    "headers": "headers_json", "body": "body", "client_ip": "client_ip",
}

EMAIL = "[A-Za-z0-9._]+@[A-Za-z0-9.]+"


def _patterns(rows: list[tuple]) -> list[Rule]:
    return [
        Rule(ord=o, id=i, msg=m, location=loc, pattern=p, action=a, severity=s, tags=tuple(t.split()))
        for o, i, m, loc, p, a, s, t in rows
    ]


# ord, id, msg, location, pattern, action, severity, tags
RULES_V1 = _patterns([
    (1, "1001", "Spam host", "url", "spam-farm|cheap-pills", "block", "HIGH", "spam url"),
    (2, "1002", "Tracking argument", "url", "[?&]utm_source=", "log", "LOW", "tracking"),
    (3, "1003", "Mail address in body", "body", EMAIL, "block", "CRITICAL", "pii mail"),
    (4, "1004", "Error endpoint", "url", "^/error[?]", "block", "MEDIUM", "endpoint"),
    (5, "1005", "Loader agent", "headers", "loader/src[13]", "log", "MEDIUM", "agent"),
    (6, "1006", "User range", "all", "user=4[0-9]&", "block", "HIGH", "user range"),
    (7, "1007", "Script tag", "body", "<script", "log", "LOW", "xss"),
    (8, "1008", "Licence line", "body", "(?i:licen[sc]e)", "block", "LOW", "licence"),
])
RULES_V2 = _patterns([
    (1, "1001", "Spam host", "url", "spam-farm|cheap-pills", "block", "HIGH", "spam url"),
    (2, "1003", "Mail address in body", "body", EMAIL, "block", "CRITICAL", "pii mail"),
    (3, "1004", "Error endpoint", "url", "^/error[?]", "log", "MEDIUM", "endpoint"),
    (4, "1006", "User range", "all", "user=4[0-9]&", "block", "HIGH", "user range"),
    (5, "1009", "Purchase by user range", "url", "^/purchase[?]user=[0-4]", "block", "MEDIUM", "user range"),
    (6, "1010", "IP address in body", "body", "[0-9]{1,3}([.][0-9]{1,3}){3}", "block", "LOW", "pii ip"),
])


def _directives(rows: list[tuple]) -> list[Rule]:
    return [
        Rule(ord=o, id=i, msg=m, dialect="directive", phase=ph, variable=v, selector=sel, operator=op,
             pattern=p, action=a, status=st, severity=sev, tags=tuple(t.split()), chain_to=c)
        for o, i, ph, v, sel, op, p, a, st, sev, m, t, c in rows
    ]


# ord, id, phase, variable, selector, operator, pattern, action, status, severity, msg, tags, chained ord
DIRECTIVES = _directives([
    (1, "301", 2, "ARGS", "", "rx", "^4[0-9]$", "pass", 403, "5", "Two digit forties", "args", None),
    (2, "302", 1, "REQUEST_METHOD", "", "streq", "PUT", "deny", 405, "2", "Put with big value", "method", 3),
    (3, "", 1, "REQUEST_URI", "", "rx", "v=[0-9]{3}", "deny", 405, "", "", "", None),
    (4, "303", 2, "ARGS", "", "contains", "src1", "deny", 403, "3", "Source argument", "args", None),
    (5, "304", 1, "REQUEST_HEADERS", "User-Agent", "rx", "loader/src[13]", "log", 403, "4", "Loader agent", "agent", None),
    (6, "305", 1, "REQUEST_HEADERS", "", "contains", "192.168.0.7,", "deny", 401, "1", "Known address", "ip", None),
    (7, "306", 2, "REQUEST_BODY", "", "rx", EMAIL, "deny", 403, "", "Mail address in body", "pii", None),
    (8, "307", 2, "ARGS", "", "streq", "assistant", "deny", 409, "9", "Assistant turn", "role", None),
    (9, "308", 2, "REQUEST_BODY", "", "contains", "the", "log", 403, "7", "Common word", "text", None),
    (10, "309", 1, "REQUEST_URI", "", "rx", r"(?:\.html|/)$", "deny", 404, "6", "Page address", "page", None),
    (11, "310", 1, "REQUEST_BODY", "", "contains", "e", "deny", 400, "2", "No body in phase one", "phase", None),
    (12, "311", 1, "ARGS", "", "streq", "user", "deny", 400, "2", "No form in phase one", "phase", None),
    (13, "312", 1, "ARGS", "", "rx", "^3[0-9]$", "log", 403, "4", "Query argument in phase one", "phase", None),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, pages and documents as rows of recorded traffic."""
    events = table(spark, sf_dir, "events").selectExpr(
        "concat('e', event_id) as req_id",
        "case event_type when 'purchase' then 'POST' when 'signup' then 'PUT' else 'GET' end as method",
        "concat('/', event_type, '?user=', user_id, '&v=', cast(floor(value) as bigint)) as url",
        "'app.example.com' as host", "props as headers_json", "'' as body",
        "concat('10.0.', cast(floor(user_id / 256) as bigint), '.', user_id % 256) as client_ip",
    )
    pages = table(spark, sf_dir, "pages").selectExpr(
        "concat('p', page_id) as req_id", "'GET' as method", "url", "'' as host",
        "'' as headers_json", "html as body", "'' as client_ip",
    )
    documents = table(spark, sf_dir, "documents").selectExpr(
        "concat('d', doc_id) as req_id", "'POST' as method",
        "concat('/documents/', doc_id, '?lang=', lang, '&source=', source) as url",
        "'docs.example.com' as host",
        """concat('{"Content-Type":"text/plain","User-Agent":"loader/', source,
                  '","X-Forwarded-For":"192.168.0.', doc_id % 250, ', 10.9.9.9"}') as headers_json""",
        "text as body", "'' as client_ip",
    )
    return events.unionByName(pages).unionByName(documents)


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as form posts."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "concat('c', conv_id, '-', turn) as req_id", "'POST' as method",
        "concat('/chat?role=', role, '&turn=', turn, '&role=r%2B', turn % 3) as url",
        "'chat.example.com' as host",
        """'{"content-type":"application/x-www-form-urlencoded","x-forwarded-for":""}' as headers_json""",
        "concat('conv=', conv_id, '&empty=&flag&text=', replace(text, ' ', '+')) as body",
        "concat('10.1.0.', conv_id % 256) as client_ip",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_columns(usable_rows(raw_requests(spark, sf_dir), MAPPING), MAPPING)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_columns(usable_rows(raw_posts(spark, sf_dir), MAPPING), MAPPING)


def verdicts(spark: SparkSession, sf_dir: str, rules: list[Rule] = RULES_V1) -> DataFrame:
    return analyze(requests(spark, sf_dir), rules)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs: customers are traffic sources, priorities are rule sets."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        short_hash((F.col("o_custkey") % 50).cast("string")).alias("traffic_hash"),
        short_hash(F.col("o_orderpriority")).alias("rules_hash"),
        F.col("o_orderdate").alias("finished_at"),
        F.col("o_orderkey").alias("seq"),
    )


def baseline_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select(
        F.col("traffic_hash").alias("directory"), F.col("rules_hash").alias("name"), "seq"
    )


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored query results."""
    return table(spark, sf_dir, "documents").select(
        F.sha2("text", 256).alias("key"), F.col("text").alias("query"), F.col("n_chars").alias("size")
    )


#: A phrase rule table made of ``benchmark``: five rules for each item, from its words in a row.
PHRASE_RULES = """
    select cast(item_id * 5 + r as int) as ord, concat('b', item_id, '-', r) as id,
           case r when 0 then concat(w1, ' ', w2, ' ', w3) when 1 then concat('(?i:', w1, ' ', w2, ' ', w3, ')')
                  when 2 then concat(w1, ' ', w2, '|', w3, '[ ,.]+', w1) when 3 then concat(w1, '[ ,.]+', w2, '[ ,.]+', w3)
                  else concat('(?:', w1, ') ', w2, '[ a-z]*', w3) end as pattern,
           case r when 4 then 'all' else 'body' end as location, case r when 0 then 'block' else 'log' end as action
    from words where w3 is not null
"""


def phrase_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hundreds of rules as rows: what ``benchmark`` items say."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("([A-Za-z]{2,})"), 1).alias("w"))
    words = items.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r")).select(
        "item_id", "r", *[F.get("w", F.col("r") * 3 + i).alias(f"w{i + 1}") for i in range(3)])
    return spark.sql(PHRASE_RULES.replace("from words", "from {words}"), words=words)
