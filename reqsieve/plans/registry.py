"""Every operator as a query over the given tables.

Results are flat (maps and arrays as text) so that they can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.functions import headers as H
from reqsieve.functions import identity as I
from reqsieve.functions import text as X
from reqsieve.functions import urls as U
from reqsieve.operators import catalog as Cat
from reqsieve.operators import compare as Cmp
from reqsieve.operators import coverage as Cov
from reqsieve.operators import matching as M
from reqsieve.operators import reports as R
from reqsieve.operators import rule_index as Index
from reqsieve.operators import store as S
from reqsieve.plans import tables as T
from reqsieve.session import shared_dir
from reqsieve.sources import capture, corpus, ndjson, reports
from reqsieve.sources import requests as Q
from reqsieve.sources import rules as Rules
from reqsieve.sources import tables as Tab
from reqsieve.streaming import analyze as Stream
from reqsieve.streaming import rules as StreamRules

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def map_text(m: Column) -> Column:
    """A map as ``k=v;k=v`` in key order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def rule_ids(rules: str = "rules_triggered") -> Column:
    return F.array_join(F.transform(rules, lambda t: t["id"]), ",")


def flat_verdicts(v: DataFrame) -> DataFrame:
    return v.select(
        "req_id", "client_ip", "blocked", rule_ids().alias("rules"),
        F.col("interruption.action").alias("action"), F.col("interruption.status").alias("status"), "logs",
    )


def spread_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = Q.spread(T.raw_requests(spark, sf_dir))
    return Q.map_columns(Q.usable_rows(raw, T.MAPPING), T.MAPPING)


def run(spark: SparkSession, sf_dir: str, rules=T.RULES_V1) -> DataFrame:
    """Blocked verdicts of the given traffic."""
    return M.analyze(spread_requests(spark, sf_dir), rules).where("blocked")


def stored_runs(spark: SparkSession, sf_dir: str, *rule_sets) -> list[DataFrame]:
    """Blocked verdicts of the given traffic, stored first.

    For reports that look at a run more than once: the traffic is matched once per rule
    set, and the reports read the stored verdicts.
    """
    root, requests = shared_dir(spark), spread_requests(spark, sf_dir)
    found = []
    for i, rules in enumerate(rule_sets):
        done = S.write_run(M.analyze(requests, rules), "traffic00000", f"rules000000{i}", root)
        found.append(S.read_verdicts(spark, root, done["run_id"]))
    return found


def all_posts_and_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = Q.spread(Q.union_sources(T.raw_requests(spark, sf_dir), T.raw_posts(spark, sf_dir)))
    return Q.map_columns(Q.usable_rows(raw, T.MAPPING), T.MAPPING)


# Sources


@query
def scan_parquet(spark, sf_dir):
    mapping = {"id": "page_id", "method": "missing", "path": "url", "body": "html"}
    pages = Tab.read_parquet(spark, f"{sf_dir}/pages.parquet").withColumn("missing", F.lit("GET"))
    found = Q.map_columns(Q.usable_rows(pages, mapping), mapping)
    events = Tab.scan_parquet(spark, f"{sf_dir}/events.parquet", {
        "id": "event_id", "method": "event_type", "path": "props", "client_ip": "user_id", "timestamp": "ts",
    })
    return Q.union_sources(found, events).select("req_id", "method", "url", "body", "client_ip", "ts")


@query
def scan_sql(spark, sf_dir):
    text = f"""
        select concat('o', o_orderkey) as id, 'GET' as m,
               concat('/orders/', o_orderkey, '?status=', o_orderstatus) as p, n_name as h, count(*) as c
        from parquet.`{sf_dir}/orders.parquet`
        join parquet.`{sf_dir}/customer.parquet` on o_custkey = c_custkey
        join parquet.`{sf_dir}/nation.parquet` on c_nationkey = n_nationkey
        join parquet.`{sf_dir}/lineitem.parquet` on l_orderkey = o_orderkey
        group by o_orderkey, o_orderstatus, n_name
    """
    found = Tab.scan_sql(spark, text, {"id": "id", "method": "m", "path": "p", "host": "h", "client_ip": "c"})
    return found.select("req_id", "method", "url", "path", "query", "host", "client_ip")


@query
def scan_partitioned(spark, sf_dir):
    """Write events by day, read one month back through partition pruning."""
    root = shared_dir(spark)
    days = T.table(spark, sf_dir, "events").withColumns({
        "year": F.year("ts"), "month": F.month("ts"), "day": F.dayofmonth("ts"),
        "req_path": F.concat(F.lit("/"), F.col("event_type"), F.lit("?user="), F.col("user_id")),
        "verb": F.lit("GET"),
    })
    days.hint("rebalance", "year", "month", "day").write.partitionBy("year", "month", "day").parquet(root)
    found = Tab.scan_parquet(
        spark, root, {"id": "event_id", "method": "verb", "path": "req_path"}, base_path=root,
        where="year = 2024 and month = 1 and day <= 15",
    )
    return found.select("req_id", "method", "path", "query")


def _capture_source(spark, sf_dir) -> str:
    """The requests as captures with response records in between."""
    root = shared_dir(spark)
    source = all_posts_and_requests(spark, sf_dir)
    lines = F.array_join(
        F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\r\n"))), ""
    )
    stamp = F.rpad(F.col("req_id"), 40, "0")
    head = F.concat(F.col("method"), F.lit(" "), F.col("url"), F.lit(" HTTP/1.1\r\nHost: h-"), F.col("req_id"), F.lit("\r\n"), lines)
    record = F.concat(F.lit("1 "), stamp, F.lit(" 1 1\n"), head, F.lit("\r\n"), F.col("body"))
    answer = F.concat(F.lit("2 "), stamp, F.lit(" 1 1\nHTTP/1.1 200 OK\r\n\r\nfine"))
    separator = f"\n{capture.SEPARATOR}\n"
    source.select(F.concat(record, F.lit(separator), answer).alias("value")).write.option("lineSep", separator).text(root)
    return root


@query
def scan_capture(spark, sf_dir):
    found = capture.scan_capture(spark, _capture_source(spark, sf_dir))
    return found.select("method", "url", "host", "proto", map_text(F.col("headers")).alias("headers"), "body")


@query
def scan_ndjson(spark, sf_dir):
    """Write requests as JSON lines, every tenth one broken, and read them back."""
    root = shared_dir(spark)
    source = all_posts_and_requests(spark, sf_dir)
    good = F.to_json(F.struct("method", "url", "headers", "body"))
    broken = F.col("req_id").rlike("7$")
    line = F.when(broken, F.concat(F.lit("{"), good)).otherwise(good)
    source.select(line.alias("value")).write.text(root)
    found = ndjson.scan_ndjson(spark, root)
    return found.select("method", "url", "host", "path", "query", map_text(F.col("headers")).alias("headers"), "body")


@query
def malformed_split(spark, sf_dir):
    """Requests and rejected lines of JSON texts, good and bad, counted by reason."""
    lines = T.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("req_seq"), F.lit("events").alias("file"),
        F.expr("""
            case event_id % 5
              when 0 then concat('{"method":"GET","url":"/', event_type, '"}')
              when 1 then concat('{"method":1,"url":"/', event_type, '"}')
              when 2 then concat('{"method":"GET","url":"/%zz', event_type, '"}')
              when 3 then props
              else concat('{"method":"GET","url":"/', event_type) end
        """).alias("value"),
    )
    good, rejected = Q.split_malformed(ndjson.parse_ndjson(lines))
    kinds = good.select(F.concat(F.col("method"), F.lit(" "), F.col("url")).alias("outcome")).unionByName(
        rejected.select(F.col("problem").alias("outcome"))
    )
    return kinds.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query
def scan_results(spark, sf_dir):
    """Export the blocked verdicts as report lines and read them back."""
    root = shared_dir(spark)
    S.export_results(run(spark, sf_dir), root)
    found = reports.scan_results(spark, root, "r1")
    return found.select(
        "run_id", "req_id", "method", "url", "body", map_text(F.col("headers")).alias("headers"),
        "client_ip", rule_ids().alias("rules"), F.col("interruption.status").alias("status"), "logs",
    )


@query
def scan_corpus(spark, sf_dir):
    """Write the labelled documents as titled request blocks and read them back."""
    root = shared_dir(spark)
    labelled = T.table(spark, sf_dir, "documents").join(T.table(spark, sf_dir, "labels"), "doc_id")
    block = F.concat(
        F.lit("### doc "), F.col("doc_id"), F.lit("\nPOST /check?source="), F.col("source"),
        F.lit(" HTTP/1.1\nHost: {{host}}\nContent-Type: text/plain\nContent-Length: 7\n\n"),
        F.col("text"), F.lit("\n"),
    )
    labelled.select(block.alias("value")).write.text(root)
    found = corpus.scan_attack_corpus(spark, root, "target")
    return found.select("title", "method", "url", "host", map_text(F.col("headers")).alias("headers"), "body")


@query
def directive_rules(spark, sf_dir):
    """A rule table made of the benchmark items, stored as rows and loaded again."""
    root = shared_dir(spark)
    items = T.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("int").alias("ord"), F.col("item_id").cast("string").alias("id"),
        F.lit("ARGS").alias("variable"), F.lit("contains").alias("operator"), F.col("text").alias("pattern"),
        F.lit("deny").alias("action"),
    )
    items.write.parquet(root)
    rows = Rules.scan_directive_rules(spark, root)
    return rows.select("ord", "id", "dialect", "variable", "operator", "pattern", "action", "status")


@query
def rule_file(spark, sf_dir):
    """A rule file made of the benchmark items, read from where its URI says."""
    root = shared_dir(spark)
    items = T.table(spark, sf_dir, "benchmark").selectExpr(
        "item_id as o", """named_struct('id', cast(item_id as string), 'name', substr(text, 1, 20), 'pattern', concat('[', lower(substr(text, 2, 3)), ']x'),
           'location', if(item_id % 2 = 0, 'url', 'body'), 'action', 'block', 'severity', 'LOW', 'tags', array('t', cast(item_id % 3 as string))) as r""")
    rules = items.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "r"))), lambda x: x["r"]).alias("rules"))
    rules.select(F.lit("regex").alias("engine"), "rules").write.json(root)
    rows = Rules.scan_rules(spark, root)
    return rows.select("ord", "id", "msg", "location", "operator", "pattern", "action", "status", "severity", F.array_join("tags", " ").alias("tags"))


@query
def rules_identity(spark, sf_dir):
    """Identities of the rule table made of the benchmark items, matched in two ways."""
    items = T.table(spark, sf_dir, "benchmark").selectExpr(
        "cast(item_id as int) as ord", "cast(item_id as string) as id", "'m' as msg", "'ARGS' as variable", "'contains' as operator",
        "text as pattern", "'directive' as dialect", "'deny' as action")
    rules = Rules.load_rules(items)
    return spark.createDataFrame([(v, Rules.rules_hash(rules, body_visibility=v)) for v in ("form", "always")], "visibility string, hash string")


@query
def traffic_identity(spark, sf_dir):
    """Identity of a file of all customers, line by line."""
    root = shared_dir(spark)
    line = F.concat_ws("|", "c_custkey", "c_name")
    T.table(spark, sf_dir, "customer").orderBy("c_custkey").select(line.alias("value")).coalesce(1).write.text(root)
    found = I.file_digests(spark, root)
    return found.select("bytes", "lines", "digest", F.lit(I.files_hash(spark, root)).alias("hash"))


# Projections


@query
def map_columns(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders")
    found = Q.map_columns(orders, {
        "id": "o_orderkey", "seq": "o_custkey", "method": "o_orderstatus", "path": "o_orderpriority",
        "timestamp": "o_orderdate", "host": "no_such_column",
    })
    return found.select("req_id", "req_seq", "method", "host", "body", "ts")


@query
def require_fields(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id", "nullif(o_orderstatus, 'F') as m", "if(o_custkey % 3 = 0, '', concat('/', o_custkey)) as p"
    )
    kept = Q.require_fields(Q.map_columns(orders, {"id": "id", "method": "m", "path": "p"}))
    return kept.select("req_id", "method", "url")


def _header_texts(spark, sf_dir):
    events = T.table(spark, sf_dir, "events").selectExpr("concat('e', event_id) as req_id", "props as text")
    docs = T.table(spark, sf_dir, "documents").selectExpr(
        "concat('d', doc_id) as req_id",
        """case doc_id % 4
             when 0 then concat('{"x-forwarded-for":"', source, '","ACCEPT":"', lang, '"}')
             when 1 then concat('{"x-forwarded-for":"', source)
             when 2 then null
             else concat('{"User-agent":"', source, '","x-n":"', n_chars, '"}') end as text""",
    )
    return events.unionByName(docs)


@query
def parse_headers(spark, sf_dir):
    strict, lenient = H.parse_headers(F.col("text")), H.parse_headers(F.col("text"), strict=False)
    return Q.spread(_header_texts(spark, sf_dir)).select(
        "req_id", map_text(strict).alias("strict"), map_text(lenient).alias("lenient")
    )


@query
def join_header_values(spark, sf_dir):
    """Properties of a document as headers, some of them twice."""
    entries = F.expr("""array(
        named_struct('name', concat('x-', lang), 'value', source),
        named_struct('name', 'accept', 'value', lang),
        named_struct('name', concat('X-', upper(if(doc_id % 2 = 0, lang, 'other'))), 'value', cast(n_chars as string)),
        named_struct('name', 'not a token', 'value', ''))""")
    return T.table(spark, sf_dir, "documents").select(
        "doc_id", map_text(H.join_header_values(entries)).alias("headers")
    )


@query
def client_ip(spark, sf_dir):
    return Q.union_sources(T.requests(spark, sf_dir), T.posts(spark, sf_dir)).select(
        "req_id", H.client_ip(F.col("headers"), F.col("client_ip")).alias("client_ip")
    )


@query
def split_url(spark, sf_dir):
    url = F.col("url")
    return T.requests(spark, sf_dir).select(
        "req_id", U.url_path(url).alias("path"), U.url_query(url).alias("query"), U.url_host(url).alias("host")
    )


@query
def canonical_url(spark, sf_dir):
    """Texts and each of their lines as paths: what may not stand in a path is escaped."""
    docs = T.table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).unionByName(
        docs.select("doc_id", F.lit(-1).alias("i"), F.col("text").alias("line")))
    paths = lines.select(
        F.concat_ws("-", "doc_id", "i").alias("id"), F.concat(F.lit("/"), "line", F.lit("?q=a b#c")).alias("p"), F.lit("GET").alias("m"))
    found = Q.map_columns(paths, {"id": "id", "method": "m", "path": "p"})
    return found.select("req_id", F.md5("url").alias("url_md5"))


@query
def split_authority(spark, sf_dir):
    """Sources of documents as hosts that stand in the path column."""
    urls = T.table(spark, sf_dir, "documents").selectExpr("doc_id", "'GET' as m", "concat('//u@', source, ':80/', lang, '?a=', doc_id, '#x') as p")
    return Q.map_columns(urls, {"id": "doc_id", "method": "m", "path": "p"}).select("req_id", "host", "path", "query")


@query
def with_req_id(spark, sf_dir):
    return Q.with_req_id(T.requests(spark, sf_dir)).select("req_id", "url")


@query
def extract_args(spark, sf_dir):
    args = U.extract_args(F.col("query"), F.col("body"), F.col("headers"))
    found = all_posts_and_requests(spark, sf_dir).select("req_id", args.alias("args"))
    text = F.array_join(F.transform("args", lambda a: F.concat(a["k"], F.lit("="), a["v"])), "|")
    return found.select("req_id", text.alias("args"))


@query
def body_size(spark, sf_dir):
    return T.requests(spark, sf_dir).select("req_id", X.body_size(F.col("body")).alias("bytes"))


@query
def request_key(spark, sf_dir):
    return T.requests(spark, sf_dir).select("req_id", I.request_key(F.col("method"), F.col("url"), F.col("body")).alias("key"))


@query
def ellipsize(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select(
        "doc_id", X.ellipsize(F.col("text"), 50).alias("short"), X.ellipsize(F.col("text"), 500, "detail").alias("detail")
    )


@query
def placeholder(spark, sf_dir):
    return T.requests(spark, sf_dir).select(
        "req_id", X.placeholder(F.col("client_ip"), "Unknown IP").alias("ip"), X.placeholder(F.col("host"), "-").alias("host")
    )


@query
def short_hash(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", I.short_hash(F.col("text")).alias("hash"))


@query
def parse_run_name(spark, sf_dir):
    name = I.run_name(F.col("traffic_hash"), F.col("rules_hash"))
    names = T.runs(spark, sf_dir).select(
        "run_id",
        F.when(F.col("seq") % 3 == 0, F.concat(name, F.lit(".json")))
        .when(F.col("seq") % 3 == 1, name).otherwise(F.concat(name, F.lit("0.json"))).alias("name"),
    )
    return names.select("run_id", I.parse_run_name(F.col("name")).alias("p")).select("run_id", "p.traffic_hash", "p.rules_hash")


@query
def severity_name(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select(
        "doc_id", X.severity_name(F.col("n_chars") % 12 - 2).alias("severity")
    )


# Listings, filters, limits


@query
def list_requests(spark, sf_dir):
    return R.list_requests(spread_requests(spark, sf_dir), "req_id")


@query
def list_requests_more(spark, sf_dir):
    listed = R.list_requests(spread_requests(spark, sf_dir), "req_id", more=True)
    return listed.withColumns({"headers": F.array_join("headers", ";"), "body": F.md5("body")})


@query
def limit(spark, sf_dir):
    return R.limit(T.requests(spark, sf_dir).select("req_id", "method", "url"), 100, "req_id")


@query
def sorted_headers(spark, sf_dir):
    return T.requests(spark, sf_dir).select("req_id", F.array_join(R.sorted_headers(F.col("headers")), ";").alias("headers"))


@query
def filter_like(spark, sf_dir):
    kept = T.raw_requests(spark, sf_dir).where("url not like '%/error%' and url like '%user=1%' and headers_json not like '%7%'")
    return Q.map_columns(kept, T.MAPPING).select("req_id", "url")


@query
def filter_time_window(spark, sf_dir):
    window = "ts between timestamp_ntz'2024-01-03 00:00:00' and timestamp_ntz'2024-01-09 12:00:00'"
    found = Tab.scan_parquet(
        spark, f"{sf_dir}/events.parquet",
        {"id": "event_id", "method": "event_type", "path": "event_type", "timestamp": "ts"}, where=window,
    )
    return found.select("req_id", "method")


@query
def search(spark, sf_dir):
    return R.search(run(spark, sf_dir), "PoSt/deSrcPII").select("req_id", "url")


@query
def search_ranked(spark, sf_dir):
    return R.search_ranked(run(spark, sf_dir), "po/docEnsrc1pii", 200, order=("req_id",)).select("req_id", "url", "score")


@query
def search_groups(spark, sf_dir):
    return R.search(R.group_by_ip(run(spark, sf_dir)), "1.4", F.col("key"))


@query
def union_sources(spark, sf_dir):
    both = Q.union_sources(T.requests(spark, sf_dir), T.posts(spark, sf_dir), T.requests(spark, sf_dir))
    return both.groupBy("method", "host").agg(F.count(F.lit(1)).alias("n"), F.sum(X.body_size(F.col("body"))).alias("bytes"))


# Matching


@query
def match_patterns(spark, sf_dir):
    return M.match_pairs(spread_requests(spark, sf_dir), T.RULES_V1)


@query
def match_patterns_v2(spark, sf_dir):
    return M.match_pairs(spread_requests(spark, sf_dir), T.RULES_V2)


@query
def match_many(spark, sf_dir):
    """All requests and hundreds of rules that are rows."""
    return Index.match_many(spread_requests(spark, sf_dir), T.phrase_rules(spark, sf_dir))


@query
def match_headers(spark, sf_dir):
    rules = [Rules.Rule(1, "h1", "Address", "192[.]168[.]0[.]1[0-9]*,", location="headers"),
             Rules.Rule(2, "h2", "Plain text", "^text/plain$", location="headers"),
             Rules.Rule(3, "h3", "Name, not value", "X-Forwarded-For", location="headers"),
             Rules.Rule(4, "h4", "Unknown place", ".", location="cookies")]
    return M.match_pairs(spread_requests(spark, sf_dir), rules)


@query
def match_all_locations(spark, sf_dir):
    rules = [Rules.Rule(1, "a1", "Source", "src[0-4]", location="all"),
             Rules.Rule(2, "a2", "Digits", "[0-9]{5,}", location="all")]
    return M.match_pairs(spread_requests(spark, sf_dir), rules)


@query
def rule_operators(spark, sf_dir):
    url = F.col("url")
    return T.requests(spark, sf_dir).select(
        "req_id", M.test(url, "rx", r"^/(?:click|view)\?user=\d+&v=1\d*$").alias("rx"),
        M.test(url, "contains", "?user=1").alias("contains"),
        M.test(F.col("method"), "streq", "POST").alias("streq"),
    )


@query
def verdict(spark, sf_dir):
    return flat_verdicts(M.analyze(spread_requests(spark, sf_dir), T.RULES_V1))


@query
def log_lines(spark, sf_dir):
    v = M.analyze(spread_requests(spark, sf_dir), T.RULES_V2)
    return v.where("logs <> ''").groupBy("logs").agg(F.count(F.lit(1)).alias("n"))


@query
def blocked_only(spark, sf_dir):
    return M.blocked_only(M.analyze(spread_requests(spark, sf_dir), T.RULES_V1)).select("req_id", rule_ids().alias("rules"))


@query
def match_directives(spark, sf_dir):
    v = M.match_directives(all_posts_and_requests(spark, sf_dir), T.DIRECTIVES, body_visibility="always")
    return flat_verdicts(v)


@query
def match_directives_form(spark, sf_dir):
    return flat_verdicts(M.match_directives(all_posts_and_requests(spark, sf_dir), T.DIRECTIVES))


@query
def match_directives_no_body(spark, sf_dir):
    return flat_verdicts(M.match_directives(all_posts_and_requests(spark, sf_dir), T.DIRECTIVES, body_access=False))


@query
def first_deny(spark, sf_dir):
    v = M.match_directives(all_posts_and_requests(spark, sf_dir), T.DIRECTIVES, body_visibility="always").where("blocked")
    deny = F.element_at("rules_triggered", -1)
    return v.groupBy(deny["id"].alias("rule"), deny["severity"].alias("severity"), "interruption.status").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def chain(spark, sf_dir):
    chained = [r for r in T.DIRECTIVES if r.ord in (2, 3)]
    v = M.match_directives(T.requests(spark, sf_dir), chained)
    return v.where("blocked").select("req_id", "url", rule_ids().alias("rules"))


@query
def analyze(spark, sf_dir):
    """The whole pipeline: verdicts, then totals and blocked share."""
    t = R.totals(M.analyze(spread_requests(spark, sf_dir), T.RULES_V1))
    return t.withColumn("pct", R.blocked_pct(F.col("blocked_requests"), F.col("total_requests")))


def _labels(spark, sf_dir):
    return T.table(spark, sf_dir, "labels").selectExpr(
        "concat('d', doc_id) as req_id", "concat('quality ', quality) as category", "toxic = 1 as attack"
    )


@query
def coverage(spark, sf_dir):
    return Cov.coverage(_labels(spark, sf_dir), M.analyze(spread_requests(spark, sf_dir), T.RULES_V1))


@query
def false_positive_rate(spark, sf_dir):
    return Cov.false_positive_rate(_labels(spark, sf_dir), M.analyze(spread_requests(spark, sf_dir), T.RULES_V1))


# Comparing runs


def _two_runs(spark, sf_dir):
    return run(spark, sf_dir, T.RULES_V1), run(spark, sf_dir, T.RULES_V2)


def _diff(spark, sf_dir):
    return Cmp.diff_runs(*_two_runs(spark, sf_dir))


@query
def diff_runs(spark, sf_dir):
    d = _diff(spark, sf_dir)
    return d.select(
        "req_key", "diff_type", "method", "url",
        F.array_join("rules1", ",").alias("rules1"), F.array_join("rules2", ",").alias("rules2"),
    )


@query
def diff_added(spark, sf_dir):
    v1, v2 = _two_runs(spark, sf_dir)
    return Cmp.added(v1, v2).select("req_key", "req_id", rule_ids().alias("rules"))


@query
def diff_removed(spark, sf_dir):
    v1, v2 = _two_runs(spark, sf_dir)
    return Cmp.removed(v1, v2).select("req_key", "req_id", rule_ids().alias("rules"))


@query
def dedupe_last(spark, sf_dir):
    return Cmp.dedupe_by_key(run(spark, sf_dir)).select("req_key", "req_id", "client_ip", rule_ids().alias("rules"))


@query
def rules_equal(spark, sf_dir):
    """Word lists of document halves as rule id lists."""
    lists = T.table(spark, sf_dir, "documents").select(
        "doc_id", F.array((F.col("n_chars") % 3), F.col("doc_id") % 3).alias("a"),
        F.array(F.col("doc_id") % 2, F.col("n_chars") % 2).alias("b"),
    )
    return lists.select("doc_id", Cmp.rules_equal(F.col("a"), F.col("b")).alias("equal"))


@query
def diff_summary(spark, sf_dir):
    return Cmp.diff_summary(_diff(spark, sf_dir))


@query
def diff_titles(spark, sf_dir):
    return Cmp.diff_titles(_diff(spark, sf_dir))


@query
def diff_details(spark, sf_dir):
    v1, v2 = stored_runs(spark, sf_dir, T.RULES_V1, T.RULES_V2)
    d = Cmp.diff_details(Cmp.diff_runs(v1, v2), v1, v2)
    shown = [
        f(F.col(f"result{s}")).alias(f"{name}{s}")
        for s in (1, 2)
        for name, f in {
            "id": lambda r: r["req_id"], "ip": lambda r: r["client_ip"], "bytes": lambda r: F.when(r.isNotNull(), X.body_size(r["body"])),
            "logs": lambda r: F.coalesce(r["logs"], F.lit("not blocked")),
        }.items()
    ]
    return d.select("req_key", "mark", "method", "url", *shown)


@query
def diff_search(spark, sf_dir):
    return R.search(Cmp.diff_titles(_diff(spark, sf_dir)), "[+]pur49", F.col("title")).select("req_key", "title")


@query
def diff_group_by_type(spark, sf_dir):
    return Cmp.diff_group_by_type(_diff(spark, sf_dir))


@query
def diff_group_by_rule(spark, sf_dir):
    return Cmp.diff_group_by_rule(_diff(spark, sf_dir))


@query
def diff_group_examples(spark, sf_dir):
    label = F.concat(F.col("method"), F.lit(" "), F.col("url"))
    d = Cmp.diff_runs(*stored_runs(spark, sf_dir, T.RULES_V1, T.RULES_V2))
    g = R.group_examples(d, Cmp.diff_rule_key(), label, [F.col("req_key")])
    return g.withColumn("examples", F.array_join("examples", "|"))


@query
def diff_baseline(spark, sf_dir):
    """Store a run, make it the baseline, store a run with other rules, compare."""
    root = shared_dir(spark)
    requests = spread_requests(spark, sf_dir)
    first = S.write_run(M.analyze(requests, T.RULES_V1), "traffic00000", "rules0000001", root, "first")
    S.set_baseline(spark, root, first["run_id"])
    S.write_run(M.analyze(requests, T.RULES_V2), "traffic00000", "rules0000002", root, "second")
    d = S.diff_against_baseline(spark, root, "traffic00000")
    return d.select("req_key", "diff_type", F.array_join("rules1", ",").alias("rules1"), F.array_join("rules2", ",").alias("rules2"))


@query
def diff_stored(spark, sf_dir):
    """Two stored runs, compared by key, bucket by bucket."""
    root, requests = shared_dir(spark), spread_requests(spark, sf_dir)
    for i, rules in enumerate((T.RULES_V1, T.RULES_V2)):
        S.write_run(M.analyze(requests, rules), "traffic00000", f"rules000000{i}", root, f"run{i}")
    d = S.diff_stored(spark, root, "run0", "run1", bucket_keys=2000)
    return d.select("req_key", "diff_type", F.array_join("rules1", ",").alias("rules1"), F.array_join("rules2", ",").alias("rules2"),
                    F.col("req_id1").alias("id1"), F.col("req_id2").alias("id2"))


# Aggregations


@query
def totals(spark, sf_dir):
    return R.totals(M.analyze(spread_requests(spark, sf_dir), T.RULES_V2))


@query
def blocked_pct(spark, sf_dir):
    by_host = M.analyze(spread_requests(spark, sf_dir), T.RULES_V2).groupBy("host").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("blocked").alias("blocked")
    )
    return by_host.select("host", R.blocked_pct(F.col("blocked"), F.col("total")).alias("pct"))


@query
def group_by_rule(spark, sf_dir):
    return R.group_by_rule(run(spark, sf_dir))


@query
def group_by_ip(spark, sf_dir):
    return R.group_by_ip(run(spark, sf_dir))


@query
def group_by_user_agent(spark, sf_dir):
    return R.group_by_user_agent(run(spark, sf_dir))


@query
def group_examples(spark, sf_dir):
    g = R.verdict_examples(*stored_runs(spark, sf_dir, T.RULES_V1), by="rule")
    return g.withColumn("examples", F.array_join("examples", "|"))


@query
def group_examples_by_ip(spark, sf_dir):
    g = R.verdict_examples(*stored_runs(spark, sf_dir, T.RULES_V2), by="ip", n=3)
    return g.withColumn("examples", F.array_join("examples", "|"))


@query
def store_stats(spark, sf_dir):
    return Cat.store_stats(T.stored_results(spark, sf_dir))


@query
def store_list(spark, sf_dir):
    return Cat.store_list(T.stored_results(spark, sf_dir))


@query
def runs_per_traffic(spark, sf_dir):
    return Cat.runs_per_traffic(T.runs(spark, sf_dir))


# Run catalogue


@query
def latest_run(spark, sf_dir):
    return Cat.latest_run(T.runs(spark, sf_dir), "finished_at", "seq").select("traffic_hash", "run_id", "rules_hash")


@query
def previous_run(spark, sf_dir):
    return Cat.previous_run_other_rules(T.runs(spark, sf_dir), "finished_at", "seq").select("run_id", "previous_run_id")


@query
def baseline_state(spark, sf_dir):
    return Cat.baseline_state(T.baseline_log(spark, sf_dir), "seq")


@query
def freshness(spark, sf_dir):
    now = F.lit("1998-07-01 00:00:00").cast("timestamp")
    return Cat.freshness(T.runs(spark, sf_dir), now, 90 * 24 * 3600).select("run_id", "age_seconds", "fresh")


# Sinks


@query
def write_run(spark, sf_dir):
    """Store a run; its totals and what was stored of it."""
    root = shared_dir(spark)
    done = S.write_run(M.analyze(spread_requests(spark, sf_dir), T.RULES_V1), "traffic00000", "rules0000001", root)
    stored = S.read_verdicts(spark, root, done["run_id"]).groupBy("run_id", "traffic_hash", "rules_hash").agg(
        F.count(F.lit(1)).alias("stored"), F.sum(F.size("rules_triggered")).alias("hits")
    )
    return S.read_runs(spark, root).join(stored, ["run_id", "traffic_hash", "rules_hash"]).select(
        "traffic_hash", "rules_hash", "total_requests", "blocked_requests", "stored", "hits"
    )


@query
def materialize(spark, sf_dir):
    """The same query twice: the second time from the store."""
    root = shared_dir(spark)
    sql = f"select event_type, user_id, count(*) as n from parquet.`{sf_dir}/events.parquet` group by event_type, user_id"
    S.materialize(spark, sql, root)
    return S.materialize(spark, sql, root)


@query
def analyze_or_reuse(spark, sf_dir):
    """Twice the same traffic and rules, once other rules: two runs are stored."""
    root = shared_dir(spark)

    def traffic():
        return spread_requests(spark, sf_dir)

    for rules in (T.RULES_V1, T.RULES_V1, T.RULES_V2):
        S.analyze_or_reuse(spark, root, "traffic00000", traffic, rules)
    return S.read_runs(spark, root).select("traffic_hash", "total_requests", "blocked_requests")


# Streaming


def _stream_source(spark, sf_dir) -> str:
    """The requests as JSON-lines files."""
    root = shared_dir(spark)
    source = all_posts_and_requests(spark, sf_dir)
    source.select(F.to_json(F.struct("method", "url", "headers", "body")).alias("value")).write.text(root)
    return root


@query
def stream_analyze(spark, sf_dir):
    root = shared_dir(spark)
    requests = Stream.stream_ndjson(spark, _stream_source(spark, sf_dir))
    Stream.stream_analyze(requests, T.RULES_V1, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("method", "url", "client_ip", rule_ids().alias("rules"), "logs")


@query
def stream_capture(spark, sf_dir):
    """Captures as a stream of requests."""
    root = shared_dir(spark)
    requests = Stream.stream_capture(spark, _capture_source(spark, sf_dir), files_per_trigger=10)
    Stream.stream_analyze(requests, T.RULES_V1, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("method", "url", "client_ip", rule_ids().alias("rules"), "logs")


@query
def stream_totals(spark, sf_dir):
    root = shared_dir(spark)
    requests = Stream.stream_ndjson(spark, _stream_source(spark, sf_dir), files_per_trigger=3)
    Stream.stream_totals(requests, T.RULES_V1, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return Stream.read_stream_totals(spark, f"{root}/out")


@query
def stream_observed_totals(spark, sf_dir):
    """The totals that the micro-batches counted while they wrote verdicts."""
    root = shared_dir(spark)
    requests = Stream.stream_ndjson(spark, _stream_source(spark, sf_dir), files_per_trigger=3)
    Stream.stream_observed_totals(requests, T.RULES_V1, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return Stream.read_observed_totals(spark, f"{root}/out")


@query
def stream_rules(spark, sf_dir):
    """Posts, then other requests, as a stream whose rules change in between."""
    root = shared_dir(spark)
    parts = {"posts": T.posts(spark, sf_dir), "requests": T.requests(spark, sf_dir)}
    for version, rules in (("posts", T.RULES_V1), ("requests", T.RULES_V2)):
        parts[version].select(F.to_json(F.struct("method", "url", "headers", "body")).alias("value")).write.mode("append").text(f"{root}/in")
        StreamRules.publish_rules(spark, rules, f"{root}/rules")
        requests = Stream.stream_ndjson(spark, f"{root}/in", files_per_trigger=4)
        StreamRules.stream_with_rules(requests, f"{root}/rules", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("method", "url", "client_ip", rule_ids().alias("rules"), "logs", "rules_version")


@query
def stream_parquet(spark, sf_dir):
    """The documents as a stream of requests."""
    root = shared_dir(spark)
    columns = {"id": "doc_id", "method": "lang", "path": "source", "body": "text"}
    requests = Stream.stream_parquet(spark, sf_dir, columns, files="documents.parquet")
    Stream.stream_analyze(requests, T.RULES_V2, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("req_id", "method", "url", rule_ids().alias("rules"))
