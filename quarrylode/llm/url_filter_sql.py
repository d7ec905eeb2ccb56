"""SQL for op4_url_filter: the same parsing, rules, levels and purity in DuckDB's dialect."""

from __future__ import annotations

from quarrylode.llm.url_filter import DEPTH, FEW, PRIOR, REJECT, RULES, VARIED, Z


def op4_sql() -> str:
    rule = says = "null"
    for name, verdict in sorted(RULES, key=lambda r: len(r[0])):
        at = name.partition("/")[0]
        fits = f"(host = '{at}' or ends_with(host, '.{at}')) and starts_with(path, '{name[len(at):]}')"
        rule, says = f"case when {fits} then '{name}' else {rule} end", f"case when {fits} then '{verdict}' else {says} end"
    shape = (
        "case when regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') then '{date}' when regexp_matches(s, '^[0-9]+$') then '{num}' "
        "when regexp_matches(s, '^[0-9]+\\.[A-Za-z]{1,5}$') then '{num}.' || regexp_extract(s, '[A-Za-z]+$') "
        "when regexp_matches(s, '^[0-9A-Fa-f-]{8,}$') and regexp_matches(s, '[0-9]') then '{hex}' "
        "when length(s) > 40 or regexp_matches(s, '^[^-_]+([-_][^-_]+){3,}$') then '{slug}' else s end"
    )
    parts = [
        "u as (select page_id, case when contains(url, '://') then substring(url, position('://' in url) + 3) else '' end as rest from pages)",
        "p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u)",
        "q as (select *, list_filter(string_split(path, '/'), lambda s: s <> '') as parts from p)",
        f"r as (select page_id, host, path, {rule} as rule, {says} as says, list_transform(parts, lambda s: {shape}) as whole, case when len(whole) > {DEPTH} then list_append(whole[1:{DEPTH - 1}], array_to_string(whole[{DEPTH}:], '/')) else whole end as shape from q)",
        "t0 as (select host, shape, count(*) filter (where says = 'block') as b, count(*) filter (where says = 'allow') as a, count(*) as n, '' as parent from r group by host, shape)",
    ]
    for k in range(DEPTH):
        parts += [
            f"c{k} as (select host, parent, len(shape) - {k} as below, shape[{k + 1}] as seg, sum(n) as cn, sum(b) as cb, sum(a) as ca from t{k} where len(shape) > {k} group by all)",
            f"g{k} as (select host, parent, below, count(*) as kids, sum(cn) as pn, sum(cb) as pb, sum(ca) as pa, (sum(cb) + 1) / (sum(cb) + sum(ca) + 2)::double as rate from c{k} group by all)",
            f"m{k} as (select host, parent, below, seg from c{k} join g{k} using (host, parent, below) where kids > 1 and ((kids >= {VARIED} and pn / kids < {FEW}) or (cb + ca > 0 and pb + pa > cb + ca and abs(cb / (cb + ca)::double - (pb - cb) / (pb + pa - cb - ca)::double) <= {Z} * sqrt(rate * (1 - rate) * (1 / (cb + ca)::double + 1 / (pb + pa - cb - ca)::double)))))",
            f"t{k + 1} as (select t.host, t.shape, t.b, t.a, t.n, case when len(t.shape) > {k} then t.parent || '/' || case when m.seg is not null then '*' else t.shape[{k + 1}] end else t.parent end as parent from t{k} t left join m{k} m on t.host = m.host and t.parent = m.parent and len(t.shape) - {k} = m.below and t.shape[{k + 1}] = m.seg)",
        ]
    step = lambda k, p: f"(coalesce(b{k}, 0) + {PRIOR} * {p}) / (coalesce(b{k}, 0) + coalesce(a{k}, 0) + {PRIOR})"
    parts.append(f"v0 as (select host, parent, string_split(parent, '/') as parts, case when len(parts) > {DEPTH + 1} then list_append(parts[1:{DEPTH}], array_to_string(parts[{DEPTH + 1}:], '/')) else parts end as steps, sum(b) as b, sum(a) as a, 0.5::double as purity from t{DEPTH} group by all)")
    for k in range(1, DEPTH + 1):
        parts.append(f"s{k} as (select host, steps[2:{k + 1}] as prefix, sum(b) as b{k}, sum(a) as a{k} from v0 where len(steps) > {k} group by all)")
        parts.append(f"v{k} as (select v.host, v.parent, v.steps, v.b, v.a, case when len(v.steps) > {k} then {step(k, 'v.purity')} else v.purity end as purity from v{k - 1} v left join s{k} s on v.host = s.host and v.steps[2:{k + 1}] = s.prefix)")
    return (
        "with " + ", ".join(parts) + f" select r.page_id, r.host, r.path, r.rule, coalesce(r.says, case when v.purity >= {REJECT} then 'block' else 'allow' end) as verdict, t.parent as template, v.purity "
        f"from r join t{DEPTH} t on r.host = t.host and r.shape = t.shape join v{DEPTH} v on t.host = v.host and t.parent = v.parent"
    )
