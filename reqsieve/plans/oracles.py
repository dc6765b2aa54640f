"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from collections.abc import Iterable

from reqsieve.plans.tables import DIRECTIVES, PHRASE_RULES, RULES_V1, RULES_V2
from reqsieve.sources.rules import Rule

ORACLES: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RAW = """
raw as (
  select 'e' || event_id as req_id,
         case event_type when 'purchase' then 'POST' when 'signup' then 'PUT' else 'GET' end as method,
         '/' || event_type || '?user=' || user_id || '&v=' || cast(floor(value) as bigint) as url,
         'app.example.com' as host, props as headers_json, '' as body,
         '10.0.' || cast(floor(user_id / 256) as bigint) || '.' || (user_id % 256) as remote
  from events
  union all
  select 'p' || page_id, 'GET', url, '', '', html, '' from pages
  union all
  select 'd' || doc_id, 'POST', '/documents/' || doc_id || '?lang=' || lang || '&source=' || source,
         'docs.example.com',
         '{"Content-Type":"text/plain","User-Agent":"loader/' || source
           || '","X-Forwarded-For":"192.168.0.' || (doc_id % 250) || ', 10.9.9.9"}',
         text, ''
  from documents
)"""
_POSTS = """
posts as (
  select 'c' || conv_id || '-' || turn as req_id, 'POST' as method,
         '/chat?role=' || role || '&turn=' || turn || '&role=r%2B' || (turn % 3) as url,
         'chat.example.com' as host,
         '{"Content-Type":"application/x-www-form-urlencoded","X-Forwarded-For":""}' as headers_json,
         'conv=' || conv_id || '&empty=&flag&text=' || replace(text, ' ', '+') as body,
         '10.1.0.' || (conv_id % 256) as remote
  from conversations
)"""


def _canonical(name: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({name}, '-'), "
        "lambda w: upper(w[1:1]) || lower(w[2:])), '-')"
    )


def _header_map(text: str, strict: bool = True) -> str:
    """JSON text to a map with canonical names."""
    ok = f"json_valid({text}) and left(ltrim({text}), 1) = '{{'"
    if strict:
        ok += f" and len(list_filter(json_extract({text}, '$.*'), lambda v: json_type(v) <> 'VARCHAR')) = 0"
    return (
        f"case when {ok} then map_from_entries(list_transform(json_keys({text}), lambda k: "
        f"row({_canonical('k')}, json_extract_string({text}, '$.\"' || k || '\"')))) "
        "else map([]::varchar[], []::varchar[]) end"
    )


_REQUESTS = f"""
base as (
  select *, {_header_map("coalesce(headers_json, '')")} as headers,
         regexp_replace(split_part(url, '#', 1), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') as target
  from source
),
requests as (
  select *, split_part(target, '?', 1) as path,
         case when instr(target, '?') > 0 then substr(target, instr(target, '?') + 1) else '' end as query,
         case when coalesce(headers['X-Forwarded-For'], '') <> '' then split_part(headers['X-Forwarded-For'], ',', 1)
              else remote end as client_ip
  from base where method <> '' and url <> ''
)"""

TRAFFIC = f"with {_RAW}, source as (select * from raw), {_REQUESTS}"
TRAFFIC_POSTS = f"with {_RAW}, {_POSTS}, source as (select * from raw union all select * from posts), {_REQUESTS}"

_MAP_TEXT = "array_to_string(list_sort(list_transform(map_entries({m}), lambda e: e.key || '=' || e.value)), ';')"


def map_text(m: str) -> str:
    return _MAP_TEXT.format(m=m)


def _test(value: str, operator: str, pattern: str) -> str:
    if operator == "rx":
        return f"regexp_matches({value}, {q(pattern)})"
    if operator == "contains":
        return f"contains({value}, {q(pattern)})"
    return f"{value} = {q(pattern)}"


def _any(values: str, rule: Rule) -> str:
    return f"len(list_filter({values}, lambda hv: {_test('hv', rule.operator, rule.pattern)})) > 0"


def pattern_condition(rule: Rule) -> str:
    places = {
        "url": _test("url", rule.operator, rule.pattern),
        "body": _test("body", rule.operator, rule.pattern),
        "headers": _any("map_values(headers)", rule),
    }
    if rule.location == "all":
        return "(" + " or ".join(places.values()) + ")"
    return places.get(rule.location, "false")


def pairs(rules: Iterable[Rule], source: str = "requests") -> str:
    return " union all ".join(
        f"select req_id, cast({r.ord} as integer) as ord, {q(r.id)} as rule_id, {q(r.action)} as action from {source} "
        f"where {pattern_condition(r)}"
        for r in rules
    )


def verdict_cte(rules: list[Rule], name: str = "verdicts") -> str:
    """All requests with what the rules said: a list of rule structs, then what follows from it."""
    known = "[" + ", ".join(
        f"case when {pattern_condition(r)} then {{'id': {q(r.id)}, 'msg': {q(r.msg)}, 'severity': {q(r.severity)}, "
        f"'action': {q(r.action)}, 'tags': {q(' '.join(r.tags))}}} end"
        for r in rules
    ) + "]"
    return f"""
    {name}_hits as (select *, list_filter({known}, lambda h: h is not null) as hits from requests),
    {name} as (
      select *, len(list_filter(hits, lambda h: h.action = 'block')) > 0 as blocked,
             array_to_string(list_transform(hits, lambda h: h.id), ',') as rules,
             case when len(hits) > 0 then 'Rule ' || hits[1].id || ': ' || hits[1].msg else 'No rules' end as first_rule,
             array_to_string(list_transform(hits, lambda h: '[' || h.severity || '] Rule ' || h.id || ': ' || h.msg || chr(10)), '') as logs,
             sha256(method || '|' || url || '|' || body) as req_key
      from {name}_hits
    )"""


V1 = f"{TRAFFIC}, {verdict_cte(RULES_V1)}"
V2 = f"{TRAFFIC}, {verdict_cte(RULES_V2)}"
_FLAT = """select req_id, client_ip, blocked, rules,
    case when blocked then 'deny' end as action, cast(case when blocked then 403 end as integer) as status, logs"""

BOTH = f"""{TRAFFIC}, {verdict_cte(RULES_V1, 'w1')}, {verdict_cte(RULES_V2, 'w2')},
s1 as (select * from w1 where blocked qualify row_number() over (partition by req_key order by req_id desc) = 1),
s2 as (select * from w2 where blocked qualify row_number() over (partition by req_key order by req_id desc) = 1),
joined as (
  select coalesce(s1.req_key, s2.req_key) as req_key,
         case when s1.req_key is null then 'added' when s2.req_key is null then 'removed'
              when not (len(s1.hits) = len(s2.hits)
                        and len(list_filter(list_transform(s2.hits, lambda h: h.id),
                                            lambda i: not list_contains(list_transform(s1.hits, lambda h: h.id), i))) = 0)
              then 'modified' end as diff_type,
         coalesce(s1.method, s2.method) as method, coalesce(s1.url, s2.url) as url,
         s1.rules as rules1, s2.rules as rules2,
         case when s1.req_key is not null then s1.first_rule else s2.first_rule end as first_rule,
         s1.req_id as id1, s2.req_id as id2, s1.client_ip as ip1, s2.client_ip as ip2,
         cast(octet_length(encode(s1.body)) as bigint) as bytes1, cast(octet_length(encode(s2.body)) as bigint) as bytes2,
         coalesce(s1.logs, 'not blocked') as logs1, coalesce(s2.logs, 'not blocked') as logs2
  from s1 full join s2 on s1.req_key = s2.req_key
),
diff as (select * from joined where diff_type is not null)
"""
_MARK = "case diff_type when 'added' then '[+]' when 'removed' then '[-]' else '[~]' end"
_NAME = "case diff_type when 'added' then 'Added' when 'removed' then 'Removed' else 'Modified' end"

RUNS = """with runs as (
  select cast(o_orderkey as varchar) as run_id, substr(sha256(cast(o_custkey % 50 as varchar)), 1, 12) as traffic_hash,
         substr(sha256(o_orderpriority), 1, 12) as rules_hash, o_orderdate as finished_at, o_orderkey as seq
  from orders
)"""

# Form decoding: plus is a space, broken escapes stay.
def _decode(text: str) -> str:
    return f"url_decode(replace({text}, '+', ' '))"


def _pairs_of(text: str) -> str:
    return (
        f"list_transform(list_filter(string_split({text}, '&'), lambda p: p <> ''), lambda p: "
        "{'k': " + _decode("split_part(p, '=', 1)") + ", 'v': case when contains(p, '=') then "
        + _decode("substr(p, instr(p, '=') + 1)") + " else '' end})"
    )


_IS_FORM = "starts_with(lower(coalesce(headers['Content-Type'], '')), 'application/x-www-form-urlencoded')"


def _args(body_access: bool = True) -> str:
    from_query = _pairs_of("query")
    if not body_access:
        return from_query
    return f"list_concat({from_query}, case when {_IS_FORM} then {_pairs_of('body')} else [] end)"


def _directive(rule: Rule, visibility: str, phase: int) -> str:
    if rule.variable == "ARGS":
        return _any("args" if phase > 1 else "query_args", rule)
    if rule.variable == "REQUEST_BODY" and phase == 1:
        return "false"
    if rule.variable == "REQUEST_BODY":
        visible = {"form": _IS_FORM, "always": "true", "never": "false"}[visibility]
        return f"({visible} and {_test('body', rule.operator, rule.pattern)})"
    if rule.variable == "REQUEST_HEADERS" and rule.selector:
        return f"coalesce({_test(f'headers[{q(rule.selector)}]', rule.operator, rule.pattern)}, false)"
    if rule.variable == "REQUEST_HEADERS":
        return _any("map_values(headers)", rule)
    return _test({"REQUEST_URI": "target", "REQUEST_METHOD": "method"}[rule.variable], rule.operator, rule.pattern)


# Severity names by code.
_SEVERITIES = "['EMERGENCY','ALERT','CRITICAL','ERROR','WARNING','NOTICE','INFO','DEBUG']"


def directive_cte(rules: list[Rule], visibility: str = "form", body_access: bool = True) -> str:
    by_ord = {r.ord: r for r in rules}
    chained = {r.chain_to for r in rules if r.chain_to}
    heads = sorted((r for r in rules if r.ord not in chained), key=lambda r: (r.phase, r.ord))
    cases = []
    for i, head in enumerate(heads):
        conditions, link = [_directive(head, visibility, head.phase)], head
        while link.chain_to:
            link = by_ord[link.chain_to]
            conditions.append(_directive(link, visibility, head.phase))
        severity = int(head.severity or 0)
        cases.append(
            f"case when {' and '.join(conditions)} then {{'pos': {i}, 'id': {q(head.id)}, 'msg': {q(head.msg)}, "
            f"'severity': coalesce({_SEVERITIES}[{severity + 1}], 'UNKNOWN'), 'action': {q(head.action)}, "
            f"'status': {head.status}}} end"
        )
    return f"""
    with_args as (select *, list_transform({_args(body_access)}, lambda a: a.v) as args,
                  list_transform({_args(False)}, lambda a: a.v) as query_args from requests),
    all_hits as (select *, list_filter([{', '.join(cases)}], lambda h: h is not null) as every from with_args),
    cut as (select *, list_min(list_transform(list_filter(every, lambda h: h.action = 'deny'), lambda h: h.pos)) as stop
            from all_hits),
    kept as (select *, list_filter(every, lambda h: h.pos <= coalesce(stop, 1000)) as hits from cut),
    verdicts as (
      select *, stop is not null as blocked,
             array_to_string(list_transform(hits, lambda h: h.id), ',') as rules,
             case when stop is not null then hits[-1].action end as action,
             cast(case when stop is not null then hits[-1].status end as integer) as status,
             array_to_string(list_transform(hits, lambda h: '[' || h.severity || '] Rule ' || h.id || ': ' || h.msg || chr(10)), '') as logs
      from kept
    )"""


_DIRECTIVE_FLAT = "select req_id, client_ip, blocked, rules, action, status, logs from verdicts"


def examples(source: str, key: str, label: str, order: str, n: int) -> str:
    return f"""
    labelled as (select {key} as key, {label} as label, {order} as o from {source}),
    ranked as (select *, row_number() over (partition by key order by o) as rank from labelled)
    select key, count(*) as n, string_agg(label, '|' order by rank) filter (where rank <= {n}) as examples,
           greatest(count(*) - {n}, 0) as more
    from ranked group by key"""


_LABEL = "method || ' ' || url || case when client_ip <> '' then ' [' || client_ip || ']' else '' end"
_IP_KEY = "case when client_ip = '' then 'Unknown IP' else client_ip end"
_UA = "coalesce(headers['User-Agent'], '')"
_UA_KEY = f"case when {_UA} = '' then 'No User-Agent' when length({_UA}) > 50 then {_UA}[1:50] || '...' else {_UA} end"


def _match_scores(source: str, text: str) -> str:
    """Best scores, a table for each character of the text: where it stands and the best score that ends there."""
    start = "case when pos = 1 or not (upper(value[pos - 1]) <> value[pos - 1] or value[pos - 1] between '0' and '9') then 4 else 0 end"
    ctes = [f"""places as (select req_id, pos, value[pos] as c, 1 + {start} as points
                          from (select req_id, value, unnest(range(1, length(value) + 1)) as pos from {source}))"""]
    for j, c in enumerate(text):
        order = "over (partition by req_id order by pos"
        before = f"greatest(max(m) {order} rows between unbounded preceding and 1 preceding), lag(m) {order}) + 6)" if j else "0"
        ctes.append(f"m{j} as (select req_id, pos, c, points, case when c = {q(c)} then points + {before} end as m from {f'm{j - 1}' if j else 'places'})")
    ctes.append(f"scores as (select req_id, max(m) as score from m{len(text) - 1} group by req_id having max(m) is not null)")
    return ", ".join(ctes)


def _subsequence(text: str) -> str:
    return q("(?is)" + ".*".join("[" + c + "]" if not c.isalnum() else c for c in text))


def _escaped_path(path: str) -> str:
    """A path, escaped again unless it is well formed."""
    escaped = f"url_encode({path})"
    for c in "/~$&+,:;=@":
        escaped = f"replace({escaped}, '%{ord(c):02X}', '{c}')"
    clean = q("[A-Za-z0-9_.~$&+,/:;=@!'()*\\[\\]-]*")
    return f"case when regexp_full_match({path}, {clean}) then {path} else {escaped} end"


_HEADER_TEXTS = """texts as (
  select 'e' || event_id as req_id, props as text from events
  union all
  select 'd' || doc_id, case doc_id % 4
     when 0 then '{"x-forwarded-for":"' || source || '","ACCEPT":"' || lang || '"}'
     when 1 then '{"x-forwarded-for":"' || source
     when 2 then null
     else '{"User-agent":"' || source || '","x-n":"' || n_chars || '"}' end
  from documents
)"""

_LABELS = """labelled as (
  select l.quality, l.toxic = 1 as attack, v.blocked from labels l join verdicts v on v.req_id = 'd' || l.doc_id
)"""

_JSON_GOOD = "not regexp_matches(req_id, '7$')"

ORACLES.update({
    # Sources
    "scan_parquet": """
        select cast(page_id as varchar) as req_id, 'GET' as method, url, html as body, '' as client_ip, '' as ts from pages
        where url <> ''
        union all
        select cast(event_id as varchar), event_type, replace(replace(replace(props, '{', '%7B'), '"', '%22'), ' ', '%20')[:-2] || '%7D',
               '', cast(user_id as varchar), rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')
        from events""",
    "scan_sql": """
        select 'o' || o_orderkey as req_id, 'GET' as method, '/orders/' || o_orderkey || '?status=' || o_orderstatus as url,
               '/orders/' || o_orderkey as path, 'status=' || o_orderstatus as query, n_name as host,
               cast(count(*) as varchar) as client_ip
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
        join lineitem on l_orderkey = o_orderkey
        group by o_orderkey, o_orderstatus, n_name""",
    "scan_partitioned": """
        select cast(event_id as varchar) as req_id, 'GET' as method, '/' || event_type as path, 'user=' || user_id as query
        from events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-16'""",
    "scan_capture": f"""{TRAFFIC_POSTS}
        select method, url, case when regexp_matches(url, '^https?://') then regexp_extract(url, '^https?://([^/?#]*)', 1)
                                 else 'h-' || req_id end as host,
               'HTTP/1.1' as proto, {map_text('headers')} as headers, body from requests""",
    "scan_ndjson": f"""{TRAFFIC_POSTS}
        select method, url, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) as host, path, query,
               {map_text('headers')} as headers, body from requests where {_JSON_GOOD}""",
    "malformed_split": """
        with outcomes as (
          select case event_id % 5 when 0 then 'GET /' || event_type when 1 then 'malformed json'
                 when 2 then 'bad escape in path' when 3 then 'GET ' else 'malformed json' end as outcome from events)
        select outcome, count(*) as n from outcomes group by outcome""",
    "scan_results": f"""{V1}
        select 'r1' as run_id, req_id, method, url, body, {map_text('headers')} as headers, client_ip, rules,
               cast(403 as integer) as status, logs from verdicts where blocked""",
    "scan_corpus": """
        select 'doc ' || doc_id as title, 'POST' as method, '/check?source=' || source as url, 'target' as host,
               'Content-Length=7;Content-Type=text/plain' as headers,
               regexp_replace(text, '[\r\n]+$', '') as body
        from documents join labels using (doc_id)""",
    "rule_file": """
        select cast(row_number() over (order by item_id) as integer) as ord, cast(item_id as varchar) as id, substr(text, 1, 20) as msg,
               case when item_id % 2 = 0 then 'url' else 'body' end as location, 'rx' as operator,
               '[' || lower(substr(text, 2, 3)) || ']x' as pattern, 'block' as action, 403 as status, 'LOW' as severity,
               't ' || (item_id % 3) as tags from benchmark""",
    "rules_identity": """
        with rules as (
          select string_agg('{"action": "deny", "chain_to": null, "dialect": "directive", "id": "' || item_id || '", "location": "", "msg": "m", ' ||
                 '"operator": "contains", "ord": ' || item_id || ', "pattern": ' || to_json(text) || ', "phase": 2, "selector": "", "severity": "", ' ||
                 '"status": 403, "tags": [], "variable": "ARGS"}', ', ' order by item_id) as t from benchmark)
        select v as visibility, substr(sha256('[[' || t || '], {"body_access": true, "body_visibility": "' || v || '"}]'), 1, 12) as hash
        from rules, (values ('form'), ('always')) x(v)""",
    "traffic_identity": """
        with lines as (
          select row_number() over (order by c_custkey) - 1 as i, c_custkey || '|' || c_name as v from customer
        ), hashes as (
          select i, v, cast(('0x' || substr(md5(v), 1, 10)) as hugeint) as a, cast(('0x' || substr(md5(v), 11, 10)) as hugeint) as b from lines
        ), sums as (
          select cast(sum(octet_length(encode(v)) + 1) as bigint) as bytes, count(*) as n, sum(a) as a, sum(b) as b, sum(a * i) as ai, sum(b * i) as bi from hashes
        ), files as (
          select bytes, n as lines, sha256(bytes || ':' || n || ':' || a || ':' || b || ':' || ai || ':' || bi) as digest from sums
        )
        select bytes, lines, digest,
               substr(sha256('1:' || bytes || ':' || cast(('0x' || substr(digest, 1, 14)) as hugeint) || ':' || digest), 1, 12) as hash from files""",
    "directive_rules": """
        select cast(item_id as integer) as ord, cast(item_id as varchar) as id, 'directive' as dialect, 'ARGS' as variable,
               'contains' as operator, text as pattern, 'deny' as action, cast(null as integer) as status from benchmark""",
    # Projections
    "map_columns": """
        select cast(o_orderkey as varchar) as req_id, o_custkey as req_seq, o_orderstatus as method, '' as host, '' as body,
               strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as ts from orders""",
    "require_fields": """
        select cast(o_orderkey as varchar) as req_id, o_orderstatus as method, '/' || o_custkey as url
        from orders where o_orderstatus <> 'F' and o_custkey % 3 <> 0""",
    "parse_headers": f"""with {_HEADER_TEXTS}
        select req_id, {map_text(_header_map("coalesce(text, '')"))} as strict,
               {map_text(_header_map("coalesce(text, '')", strict=False))} as lenient from texts""",
    "join_header_values": """
        with entries as (
          select doc_id, 1 as pos, 'X-' || upper(lang[1:1]) || lower(lang[2:]) as name, source as v from documents
          union all select doc_id, 2, 'Accept', lang from documents
          union all select doc_id, 3, case when doc_id % 2 = 0 then 'X-' || upper(lang[1:1]) || lower(lang[2:]) else 'X-Other' end,
                           cast(n_chars as varchar) from documents
          union all select doc_id, 4, 'not a token', '' from documents),
        joined as (select doc_id, name, string_agg(v, ', ' order by pos) as v from entries group by doc_id, name)
        select doc_id, string_agg(name || '=' || v, ';' order by name) as headers from joined group by doc_id""",
    "client_ip": f"{TRAFFIC_POSTS} select req_id, client_ip from requests",
    "split_url": f"""{TRAFFIC} select req_id, path, query, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) as host from requests""",
    "canonical_url": f"""
        with lines as (
          select doc_id || '-' || unnest(range(len(string_split(text, chr(10))))) as req_id, unnest(string_split(text, chr(10))) as line from documents
          union all select doc_id || '--1', text from documents
        ), urls as (
          select req_id, '/' || line || '?q=a b#c' as url from lines
        ), parts as (
          select *, regexp_extract(url, '^([^?#]*)', 1) as path from urls
        )
        select req_id, md5(case
          when regexp_matches(url, '[\\x00-\\x1F\\x7F]') or regexp_matches(regexp_replace(path, '%[0-9A-Fa-f][0-9A-Fa-f]', '', 'g'), '%') then url
          else {_escaped_path('path')} || substr(url, length(path) + 1) end) as url_md5 from parts""",
    "split_authority": """
        select cast(doc_id as varchar) as req_id, source || ':80' as host, '/' || lang as path, 'a=' || doc_id as query from documents""",
    "with_req_id": f"""{TRAFFIC}
        select sha256(concat_ws(chr(31), '0', method, url, host, body, remote, '')) as req_id, url from requests""",
    "extract_args": f"""{TRAFFIC_POSTS}
        select req_id, array_to_string(list_transform({_args()}, lambda a: a.k || '=' || a.v), '|') as args from requests""",
    "body_size": f"{TRAFFIC} select req_id, cast(octet_length(encode(body)) as bigint) as bytes from requests",
    "request_key": f"{TRAFFIC} select req_id, sha256(method || '|' || url || '|' || body) as key from requests",
    "ellipsize": """
        select doc_id, case when length(text) > 50 then substr(text, 1, 49) || '…' else text end as short,
               case when length(text) > 500 then substr(text, 1, 500) || '...' else text end as detail from documents""",
    "placeholder": f"""{TRAFFIC}
        select req_id, coalesce(nullif(remote, ''), 'Unknown IP') as ip, coalesce(nullif(host, ''), '-') as host from requests""",
    "short_hash": "select doc_id, substr(sha256(text), 1, 12) as hash from documents",
    "parse_run_name": f"""{RUNS}
        select run_id, case when seq % 3 < 2 then traffic_hash end as traffic_hash,
               case when seq % 3 < 2 then rules_hash end as rules_hash from runs""",
    "severity_name": f"""
        select doc_id, case when n_chars % 12 - 2 between 0 and 7 then {_SEVERITIES}[n_chars % 12 - 1] else 'UNKNOWN' end as severity
        from documents""",
    # Listings, filters, limits
    "list_requests": f"""{TRAFFIC}
        select row_number() over (order by req_id) as n, method,
               case when length(url_decode(path)) > 50 then substr(url_decode(path), 1, 49) || '…' else url_decode(path) end as path,
               case when host = '' then '-' when length(host) > 30 then substr(host, 1, 29) || '…' else host end as host,
               coalesce(nullif(remote, ''), '-') as client_ip from requests""",
    "list_requests_more": f"""{TRAFFIC}
        select row_number() over (order by req_id) as n, method, url_decode(path) as path, host, 'HTTP/1.1' as proto, remote as client_ip,
               '' as date, {map_text('headers').replace("'='", "': '")} as headers,
               cast(octet_length(encode(body)) as bigint) as body_bytes, md5(body) as body from requests""",
    "limit": f"{TRAFFIC} select req_id, method, url from requests order by req_id limit 100",
    "sorted_headers": f"""{TRAFFIC} select req_id, {map_text('headers').replace("'='", "': '")} as headers from requests""",
    "filter_like": f"""with {_RAW}
        select req_id, url from raw where url not like '%/error%' and url like '%user=1%' and headers_json not like '%7%'""",
    "filter_time_window": """
        select cast(event_id as varchar) as req_id, event_type as method from events
        where ts between timestamp '2024-01-03 00:00:00' and timestamp '2024-01-09 12:00:00'""",
    "search": f"""{V1}
        select req_id, url from verdicts where blocked and
          regexp_matches(method || ' ' || url || ' ' || array_to_string(list_transform(hits, lambda h: h.tags), ' '), {_subsequence('PoSt/deSrcPII')})""",
    "search_ranked": f"""{V1},
        found as (select req_id, url, lower(method || ' ' || url || ' ' || array_to_string(list_transform(hits, lambda h: h.tags), ' ')) as value
                  from verdicts where blocked),
        {_match_scores('found', 'po/docensrc1pii')}
        select req_id, url, score from found join scores using (req_id) order by score desc, req_id limit 200""",
    "search_groups": f"""{V1}
        select {_IP_KEY} as key, count(*) as n from verdicts where blocked and regexp_matches({_IP_KEY}, {_subsequence('1.4')})
        group by 1""",
    "union_sources": f"""with {_RAW}, {_POSTS},
        everything as (select * from raw union all select * from posts union all select * from raw)
        select method, host, count(*) as n, cast(sum(octet_length(encode(body))) as bigint) as bytes from everything
        where url <> '' group by method, host""",
    # Matching
    "match_patterns": f"{TRAFFIC} {pairs(RULES_V1)}",
    "match_patterns_v2": f"{TRAFFIC} {pairs(RULES_V2)}",
    "match_headers": TRAFFIC + " " + pairs([
        Rule(1, "h1", "", "192[.]168[.]0[.]1[0-9]*,", location="headers"),
        Rule(2, "h2", "", "^text/plain$", location="headers"),
        Rule(3, "h3", "", "X-Forwarded-For", location="headers"),
        Rule(4, "h4", "", ".", location="cookies"),
    ]),
    "match_all_locations": TRAFFIC + " " + pairs([
        Rule(1, "a1", "", "src[0-4]", location="all"), Rule(2, "a2", "", "[0-9]{5,}", location="all"),
    ]),
    "rule_operators": f"""{TRAFFIC}
        select req_id, regexp_matches(url, '^/(?:click|view)\\?user=\\d+&v=1\\d*$') as rx, contains(url, '?user=1') as contains,
               method = 'POST' as streq from requests""",
    "verdict": f"{V1} {_FLAT} from verdicts",
    "log_lines": f"{V2} select logs, count(*) as n from verdicts where logs <> '' group by logs",
    "blocked_only": f"{V1} select req_id, rules from verdicts where blocked",
    "match_directives": f"{TRAFFIC_POSTS}, {directive_cte(DIRECTIVES, 'always')} {_DIRECTIVE_FLAT}",
    "match_directives_form": f"{TRAFFIC_POSTS}, {directive_cte(DIRECTIVES)} {_DIRECTIVE_FLAT}",
    "match_directives_no_body": f"{TRAFFIC_POSTS}, {directive_cte(DIRECTIVES, 'never', False)} {_DIRECTIVE_FLAT}",
    "first_deny": f"""{TRAFFIC_POSTS}, {directive_cte(DIRECTIVES, 'always')}
        select hits[-1].id as rule, hits[-1].severity as severity, status, count(*) as n from verdicts where blocked
        group by all""",
    "chain": f"""{TRAFFIC} select req_id, url, '302' as rules from requests
        where method = 'PUT' and regexp_matches(target, 'v=[0-9]{{3}}')""",
    "analyze": f"""{V1}
        select count(*) as total_requests, count(*) filter (where blocked) as blocked_requests,
               count(*) filter (where blocked) * 100.0::double / count(*) as pct from verdicts""",
    "coverage": f"""{V1}, {_LABELS}
        select 'quality ' || quality as category, attack, count(*) as requests, count(*) filter (where blocked) as blocked,
               avg(blocked::int) as blocked_rate, avg((blocked = attack)::int) as expected_rate from labelled group by 1, 2""",
    "false_positive_rate": f"""{V1}, {_LABELS}
        select avg(blocked::int) filter (where not attack) as false_positive_rate,
               avg((not blocked)::int) filter (where attack) as miss_rate from labelled""",
    # Comparing runs
    "diff_runs": f"{BOTH} select req_key, diff_type, method, url, rules1, rules2 from diff",
    "diff_added": f"{BOTH} select req_key, id2 as req_id, rules2 as rules from diff where diff_type = 'added'",
    "diff_removed": f"{BOTH} select req_key, id1 as req_id, rules1 as rules from diff where diff_type = 'removed'",
    "dedupe_last": f"{BOTH} select req_key, req_id, client_ip, rules from s1",
    "rules_equal": """
        with lists as (select doc_id, [n_chars % 3, doc_id % 3] as a, [doc_id % 2, n_chars % 2] as b from documents)
        select doc_id, len(a) = len(b) and len(list_filter(b, lambda x: not list_contains(a, x))) = 0 as equal from lists""",
    "diff_summary": f"""{BOTH}
        select count(*) as total, count(*) filter (where diff_type = 'added') as added,
               count(*) filter (where diff_type = 'removed') as removed,
               count(*) filter (where diff_type = 'modified') as modified from diff""",
    "diff_titles": f"""{BOTH}
        select req_key, diff_type, {_MARK} || ' ' || method || ' ' || url as title,
               case diff_type when 'added' then 'New blocked request' when 'removed' then 'No longer blocked'
                    else 'Rules changed' end as meaning from diff""",
    "diff_details": f"""{BOTH}
        select req_key, {_MARK} as mark, method, url, id1, id2, ip1, ip2, bytes1, bytes2, logs1, logs2 from diff""",
    "diff_search": f"""{BOTH}
        select req_key, {_MARK} || ' ' || method || ' ' || url as title from diff
        where regexp_matches({_MARK} || ' ' || method || ' ' || url, '(?is)[[].*[+].*[]].*p.*u.*r.*4.*9')""",
    "diff_group_by_type": f"{BOTH} select {_NAME} as key, count(*) as n from diff group by 1",
    "diff_group_by_rule": f"{BOTH} select first_rule as key, count(*) as n from diff group by 1",
    "diff_group_examples": f"{BOTH}, {examples('diff', 'first_rule', chr(39) * 2 + ' || method || ' + q(' ') + ' || url', 'req_key', 5)}",
    "diff_baseline": f"{BOTH} select req_key, diff_type, rules1, rules2 from diff",
    "diff_stored": f"{BOTH} select req_key, diff_type, rules1, rules2, id1, id2 from diff",
    # Aggregations
    "totals": f"""{V2}
        select count(*) as total_requests, count(*) filter (where blocked) as blocked_requests from verdicts""",
    "blocked_pct": f"""{V2}
        select host, count(*) filter (where blocked) * 100.0::double / count(*) as pct from verdicts group by host""",
    "group_by_rule": f"{V1} select first_rule as key, count(*) as n from verdicts where blocked group by 1",
    "group_by_ip": f"{V1} select {_IP_KEY} as key, count(*) as n from verdicts where blocked group by 1",
    "group_by_user_agent": f"{V1} select {_UA_KEY} as key, count(*) as n from verdicts where blocked group by 1",
    "group_examples": f"""{V1}, kept as (select * from verdicts where blocked),
        {examples('kept', 'first_rule', _LABEL, 'req_id', 5)}""",
    "group_examples_by_ip": f"""{V2}, kept as (select * from verdicts where blocked),
        {examples('kept', _IP_KEY, _LABEL, 'req_id', 3)}""",
    "store_stats": """
        select count(*) as entries, sum(n_chars)::double / 1048576.0::double as total_mb from documents""",
    "store_list": """
        select substr(sha256(text), 1, 12) as key, n_chars::double / 1048576.0::double as mb, text as query from documents""",
    "runs_per_traffic": f"{RUNS} select traffic_hash, count(*) as runs from runs group by 1",
    # Run catalogue
    "latest_run": f"""{RUNS}
        select traffic_hash, run_id, rules_hash from runs
        qualify row_number() over (partition by traffic_hash order by finished_at desc, seq desc) = 1""",
    "previous_run": f"""{RUNS},
        newest as (select traffic_hash, rules_hash, arg_max(run_id, (finished_at, seq)) as run_id, max((finished_at, seq)) as o
                   from runs group by 1, 2)
        select r.run_id, (select arg_max(n.run_id, n.o) from newest n
                          where n.traffic_hash = r.traffic_hash and n.rules_hash <> r.rules_hash) as previous_run_id
        from runs r""",
    "baseline_state": f"""{RUNS},
        steps as (select traffic_hash as directory, rules_hash as name, seq,
                         lag(rules_hash) over (partition by traffic_hash order by seq) as before from runs),
        changes as (select *, row_number() over (partition by directory order by seq desc) as k
                    from steps where before is null or before <> name)
        select directory, max(name) filter (where k = 1) as current, max(name) filter (where k = 2) as previous
        from changes where k <= 2 group by directory""",
    "freshness": f"""{RUNS}
        select run_id, cast(epoch(timestamp '1998-07-01 00:00:00') - epoch(finished_at) as bigint) as age_seconds,
               epoch(timestamp '1998-07-01 00:00:00') - epoch(finished_at) <= 90 * 24 * 3600 as fresh from runs""",
    # Sinks
    "write_run": f"""{V1}
        select 'traffic00000' as traffic_hash, 'rules0000001' as rules_hash, count(*) as total_requests,
               count(*) filter (where blocked) as blocked_requests, count(*) filter (where blocked) as stored,
               cast(sum(len(hits)) filter (where blocked) as bigint) as hits from verdicts""",
    "materialize": "select event_type, user_id, count(*) as n from events group by event_type, user_id",
    "analyze_or_reuse": f"""{TRAFFIC}, {verdict_cte(RULES_V1, 'w1')}, {verdict_cte(RULES_V2, 'w2')}
        select 'traffic00000' as traffic_hash, count(*) as total_requests, count(*) filter (where blocked) as blocked_requests from w1
        union all select 'traffic00000', count(*), count(*) filter (where blocked) from w2""",
    # Streaming
    "stream_analyze": f"""{TRAFFIC_POSTS}, {verdict_cte(RULES_V1)}
        select method, url, case when coalesce(headers['X-Forwarded-For'], '') <> '' then client_ip else '' end as client_ip,
               rules, logs from verdicts where blocked""",
    "stream_capture": f"""{TRAFFIC_POSTS}, {verdict_cte(RULES_V1)}
        select method, url, case when coalesce(headers['X-Forwarded-For'], '') <> '' then client_ip else '' end as client_ip,
               rules, logs from verdicts where blocked""",
    "stream_parquet": f"""
        with requests as (
          select cast(doc_id as varchar) as req_id, lang as method, source as url, text as body,
                 map([]::varchar[], []::varchar[]) as headers from documents), {verdict_cte(RULES_V2)}
        select req_id, method, url, rules from verdicts where blocked""",
    "stream_totals": f"""{TRAFFIC_POSTS}, {verdict_cte(RULES_V1)}
        select count(*) as total_requests, count(*) filter (where blocked) as blocked_requests from verdicts""",
    "stream_observed_totals": f"""{TRAFFIC_POSTS}, {verdict_cte(RULES_V1)}
        select count(*) as total_requests, count(*) filter (where blocked) as blocked_requests from verdicts""",
    "stream_rules": " union all ".join(
        f"""(with {_RAW}, {_POSTS}, source as (select * from {source}), {_REQUESTS}, {verdict_cte(rules)}
        select method, url, case when coalesce(headers['X-Forwarded-For'], '') <> '' then client_ip else '' end as client_ip,
               rules, logs, {version} as rules_version from verdicts where blocked)"""
        for source, rules, version in (("posts", RULES_V1, 1), ("raw", RULES_V2, 2))),
    "match_many": f"""{TRAFFIC},
        items as (select item_id, regexp_extract_all(text, '[A-Za-z]{{2,}}') as w from benchmark),
        words as (select item_id, r, w[r * 3 + 1] as w1, w[r * 3 + 2] as w2, w[r * 3 + 3] as w3 from items, range(5) t(r)),
        rules as ({PHRASE_RULES.replace("concat('b', item_id, '-', r)", "'b' || item_id || '-' || r")})
        select req_id, ord, id as rule_id, action from requests, rules
        where regexp_matches(body, pattern) or (location = 'all' and (
          regexp_matches(url, pattern) or len(list_filter(map_values(headers), lambda v: regexp_matches(v, pattern))) > 0))""",
})
