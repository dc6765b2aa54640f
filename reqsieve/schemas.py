"""Column layouts shared by sources, operators and sinks."""

from __future__ import annotations

REQUEST_COLUMNS = [
    "req_id", "req_seq", "method", "url", "path", "query", "host",
    "proto", "headers", "body", "client_ip", "ts",
]

# One HTTP request.
REQUEST = """
    req_id string, req_seq long, method string, url string, path string, query string,
    host string, proto string, headers map<string,string>, body string,
    client_ip string, ts string
"""

# One detection rule, or one condition of a chained rule.
RULE = """
    ord int, id string, msg string, dialect string, location string, variable string,
    selector string, operator string, pattern string, phase int, action string,
    status int, severity string, tags array<string>, chain_to int
"""

TRIGGERED = "struct<id:string,msg:string,severity:string,tags:array<string>>"
INTERRUPTION = "struct<action:string,status:int>"

# One request with what the rules said about it.
VERDICT = f"""{REQUEST},
    blocked boolean, rules_triggered array<{TRIGGERED}>, interruption {INTERRUPTION}, logs string
"""

# One analysis of one traffic source with one rule set.
RUN = """
    run_id string, traffic_hash string, rules_hash string, finished_at timestamp,
    total_requests long, blocked_requests long
"""

# The last result of a request in a run, as far as a comparison needs it.
KEYED = "req_key string, r struct<req_id:string,method:string,url:string,rules:array<string>,first_rule:string>"

# One stored query result.
QUERY_RESULT = "key string, query string, location string, size long, stored_at timestamp"

# One change of the baseline of a results directory.
BASELINE_EVENT = "directory string, name string, at timestamp"

# Rule file: a JSON document with a list of pattern rules.
PATTERN_RULES = """
    engine string,
    rules array<struct<id:string,name:string,pattern:string,location:string,
                       action:string,severity:string,tags:array<string>>>
"""

RESULT = f"""
    id string,
    request struct<method:string,url:string,headers:map<string,string>,body:string,client_ip:string>,
    blocked boolean, rules_triggered array<{TRIGGERED}>, interruption {INTERRUPTION}, logs string
"""
METADATA = """
    timestamp string, total_requests long, blocked_requests long,
    traffic_hash string, rules_hash string
"""


def _fields(ddl: str) -> str:
    """DDL column list to the inside of a struct type."""
    out, depth = [], 0
    for part in ddl.replace("\n", " ").split(","):
        part = " ".join(part.split())
        if depth == 0:
            name, kind = part.split(" ", 1)
            part = f"{name}:{kind}"
        depth += part.count("<") - part.count(">")
        out.append(part)
    return ",".join(out)


# Report document: a header and the blocked results.
REPORT = f"metadata struct<{_fields(METADATA)}>, results array<struct<{_fields(RESULT)}>>"
