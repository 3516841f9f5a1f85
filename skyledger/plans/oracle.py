"""Reference SQL for the registered queries: plain, pairwise and unoptimised on purpose."""

from __future__ import annotations

import re

from skyledger.functions import fixed
from skyledger.plans.shared_views import ACCOUNT, DUCK, IAM, SPLIT_US, VIEWS, view_sql

MIN = 60_000_000
TRAVEL_MIN, BURST_MIN, BURST_N = 1440, 4320, 4
PAD_MIN, COLLAPSE_MIN = 720, 600


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _map(mapping: dict, key: str, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in mapping.items())
    return f"CASE {key} {arms} ELSE {default} END"


def tactic(c: str) -> str:
    return _map({k: v[1] for k, v in fixed.TECHNIQUES.items()}, c)


def trank(c: str) -> str:
    return _map({t: i for i, t in enumerate(fixed.TACTIC_ORDER)}, c, "99")


def classify(c: str) -> str:
    return "coalesce(" + _map(fixed.STEP_TECHNIQUES, c) + f", CASE WHEN regexp_matches({c}, '^(Describe|List|Get)') THEN 'T1580' END)"


TECH_OF_KEY = {**{r["id"]: [r["attack"]] for r in fixed.RULES}, **{k: v[2] for k, v in fixed.DETECTORS.items()}}

CTES: dict[str, str] = {name: view_sql(name, DUCK) for name in VIEWS}
CTES["hist"] = f"SELECT * FROM ev WHERE us < {SPLIT_US}"
CTES["cur"] = f"SELECT *, CASE WHEN principal_type = 'assumed_role' THEN coalesce(nullif(issuer, ''), principal) ELSE principal END AS actor FROM ev WHERE us >= {SPLIT_US}"

# ---------------------------------------------------------------- signatures and behaviour

_big = ("regexp_matches(lower(regexp_extract(params, '\"instanceType\":\"([^\"]*)\"', 1)), '^(" + "|".join(p.replace(".", "[.]") for p in fixed.BIG_INSTANCE_FAMILIES)
        + ")|" + "|".join(fixed.BIG_INSTANCE_SIZES) + "')")
RULE_SQL = {
    "ec2-cryptomining-launch": f"event = 'RunInstances' AND {_big} AND region NOT IN ('us-east-1', 'us-west-2')",
    "iam-root-activity": "principal_type = 'root'",
    "iam-non-mfa-sensitive-write": "mfa = false AND read_only = false AND resource_sensitivity = 'high'",
    "ct-logging-tampering": "event IN ('StopLogging', 'DeleteTrail', 'UpdateTrail', 'DeleteDetector')",
    "ec2-sg-open-world": "event = 'AuthorizeSecurityGroupIngress' AND regexp_matches(params, '\"(0[.]0[.]0[.]0/0|::/0)\"[^:]')",
    "iam-create-user": "event = 'CreateUser'",
    "iam-add-credentials": "event IN ('CreateAccessKey', 'CreateLoginProfile')",
    "iam-backdoor-trust": "event = 'UpdateAssumeRolePolicy' AND regexp_matches(params, '999988887777|\"[*]\"')",
}


def signatures(src: str) -> str:
    parts = []
    for no, r in enumerate(fixed.RULES):
        parts.append(f"SELECT '{r['id']}|' || event_id || '|' || seq AS det_id, '{r['id']}' AS key, {r['confidence']}::DOUBLE AS confidence, 0 AS stage, seq, {no} AS sub, us, principal, src_ip,"
                     f" event_id, event AS event_name, '{r['title']}' AS message FROM {src} WHERE {RULE_SQL[r['id']]}")
    return " UNION ALL ".join(parts)


def _det(key: str, conf: float, stage: int, sub: int, message: str, src: str) -> str:
    return (f"SELECT '{key}|' || event_id || '|' || seq AS det_id, '{key}' AS key, {conf}::DOUBLE AS confidence, {stage} AS stage, seq, {sub} AS sub, us, principal, src_ip, event_id, event AS event_name,"
            f" {message} AS message FROM {src}")


_tokens = "|".join(fixed.AUTOMATION_TOKENS)
CTES["l1"] = signatures("cur")
CTES["newgeo"] = _det("bhv-new-geo", 0.6, 1, 0, "principal || ' first seen from ' || geo",
                      "(SELECT * FROM cur c WHERE principal IN (SELECT principal FROM hist) AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.principal = c.principal AND h.geo = c.geo) "
                      "QUALIFY row_number() OVER (PARTITION BY principal, geo ORDER BY seq) = 1)")


def automation(src: str) -> str:
    return _det("bhv-automation-iam-write", 0.7, 1, 1, "'automation ' || principal || ' called ' || event",
                f"(SELECT * FROM {src} WHERE event IN {_in(fixed.IAM_WRITES)} AND regexp_matches(lower(principal || ' ' || coalesce(issuer, '')), '{_tokens}'))")


def travel(src: str) -> str:
    inner = (f"(SELECT *, lag(geo) OVER w AS pg, lag(us) OVER w AS pu FROM {src} WINDOW w AS (PARTITION BY principal ORDER BY us, seq)) t")
    return _det("bhv-impossible-travel", 0.75, 2, 0, f"principal || ' moved ' || pg || ' -> ' || geo || ' in ' || ((us - pu) // {MIN}) || ' min'", inner) + f" WHERE pg <> geo AND us - pu <= {TRAVEL_MIN * MIN}"


def bursts(src: str) -> str:
    return (f"WITH r AS (SELECT * FROM {src} WHERE regexp_matches(event, '^(Describe|List|Get)')), "
            f"n AS (SELECT a.principal, a.us, a.seq, a.src_ip, a.event_id, a.event, count(DISTINCT b.event) AS n, array_to_string(list_sort(list(DISTINCT b.event)), ',') AS names FROM r a JOIN r b ON a.principal = b.principal "
            f"AND b.us >= a.us - {BURST_MIN * MIN} AND (b.us < a.us OR (b.us = a.us AND b.seq <= a.seq)) GROUP BY ALL), "
            f"h AS (SELECT *, n >= {BURST_N} AS hit, lag(n >= {BURST_N}) OVER (PARTITION BY principal ORDER BY us, seq) AS before FROM n) "
            + _det("bhv-enumeration-burst", 0.6, 3, 0, f"principal || ' issued ' || n || ' distinct read APIs in <= {BURST_MIN} min'", "h") .replace(" AS message", " AS message, names") + " WHERE hit AND NOT coalesce(before, false)")


CTES["autow"] = automation("cur")
CTES["travel"] = travel("cur")
CTES["burst"] = bursts("cur")
CTES["exf"] = """
WITH p AS (SELECT principal, avg(gets) AS gm, stddev_pop(gets) AS gs, avg(bytes) AS bm, stddev_pop(bytes) AS bs FROM (SELECT principal, us // 86400000000 AS d, count(*) AS gets, sum(bytes) AS bytes FROM hist WHERE event = 'GetObject' GROUP BY ALL) GROUP BY principal),
r AS (SELECT DISTINCT principal, region FROM hist WHERE event = 'GetObject'),
c AS (SELECT principal, count(*) AS n, sum(bytes) AS b, arg_max(event_id, us) AS event_id, arg_max(src_ip, us) AS src_ip, arg_max(seq, us) AS seq, max(us) AS us FROM cur WHERE event = 'GetObject' GROUP BY principal),
x AS (SELECT c.*, (n > greatest(gm + 3.0 * gs, gm + 5)) AS g, (b > greatest(bm + 3.0 * bs, bm + 400000000)) AS v,
  EXISTS (SELECT 1 FROM cur e WHERE e.event = 'GetObject' AND e.principal = c.principal AND NOT EXISTS (SELECT 1 FROM r WHERE r.principal = c.principal AND r.region = e.region)) AS reg FROM c JOIN p USING (principal))
SELECT *, 'GetObject' AS event FROM x WHERE g OR v OR reg"""
CTES["exfil"] = _det("m8-s3-exfil-anomaly", 0.8, 5, 0, "principal || ' showed ' || (g::INT + v::INT + reg::INT) || ' S3 exfiltration indicator(s)'", "exf")


def public_access(src: str) -> str:
    return _det("m8-s3-sensitive-public-access", 0.9, 4, 0, "event || ' may expose sensitive bucket ' || regexp_extract(target, 'arn:aws:s3:::(.*)', 1)", src) + (
        " WHERE target IN (SELECT arn FROM resource WHERE sensitivity IN ('high', 'medium')) AND (event = 'DeletePublicAccessBlock' OR (event IN ('PutBucketAcl', 'PutBucketPolicy', 'PutPublicAccessBlock') AND uid % 2 = 0))")


CTES["opened"] = public_access("cur")
CTES["det"] = "SELECT * FROM exfil UNION ALL SELECT * FROM opened UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM newgeo UNION ALL SELECT * FROM autow UNION ALL SELECT * FROM travel UNION ALL SELECT * EXCLUDE (names) FROM burst"

# ---------------------------------------------------------------- correlation

CTES["keyed"] = "SELECT det_id, us, 'principal' AS kind, principal AS value FROM det WHERE principal <> '' UNION ALL SELECT det_id, us, 'src_ip', src_ip FROM det WHERE src_ip <> ''"
CTES["pairs"] = f"SELECT a.kind, a.value, a.det_id AS a, b.det_id AS b FROM keyed a JOIN keyed b ON a.kind = b.kind AND a.value = b.value AND abs(a.us - b.us) <= {60 * MIN} AND a.det_id < b.det_id"
CTES["reach_d"] = "SELECT det_id AS a, det_id AS b FROM det UNION SELECT r.a, l.b FROM reach_d r JOIN (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs) l ON r.b = l.a"
CTES["comp"] = "SELECT a AS det_id, min(b) AS comp FROM reach_d GROUP BY a"
CTES["kt"] = " UNION ALL ".join(f"SELECT '{k}' AS key, '{t}' AS technique, {tactic(chr(39) + t + chr(39))} AS tactic" for k, ts in TECH_OF_KEY.items() for t in ts)
CTES["base"] = "SELECT comp, min(us) AS us_start, max(us) AS us_end, count(*) AS n_detections, product(1 - confidence) AS miss, min({'stage': stage, 'seq': seq, 'sub': sub, 'id': det_id}) AS first FROM det JOIN comp USING (det_id) GROUP BY comp"
CTES["ctech"] = "SELECT DISTINCT comp, technique, tactic FROM det JOIN comp USING (det_id) JOIN kt USING (key)"
CTES["cases"] = (f"SELECT b.*, 'case-' || row_number() OVER (ORDER BY us_start, first) AS case_id, row_number() OVER (ORDER BY us_start, first) AS case_no, t.techniques, t.title, t.n_tactics, "
                 f"round(least(0.99, 1 - miss + 0.05 * greatest(0, t.n_tactics - 1)), 3) AS score FROM base b JOIN "
                 f"(SELECT comp, array_to_string(list_sort(list(DISTINCT technique)), ',') AS techniques, count(DISTINCT tactic) AS n_tactics, "
                 f"array_to_string(list_transform(list_sort(list(DISTINCT {{'r': {trank('tactic')}, 't': tactic}})), lambda s: s.t), ' -> ') AS title FROM ctech GROUP BY comp) t USING (comp)")
CTES["cdet"] = "SELECT case_id, det.* FROM det JOIN comp USING (det_id) JOIN cases USING (comp)"
CTES["ent"] = "SELECT DISTINCT case_id, 'principal' AS kind, principal AS value FROM cdet WHERE principal <> '' UNION SELECT DISTINCT case_id, 'src_ip', src_ip FROM cdet WHERE src_ip <> ''"

# ---------------------------------------------------------------- chains

CTES["sel"] = (f"SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY us, tr, seq) AS rn FROM (SELECT *, {trank('tac')} AS tr FROM (SELECT *, {tactic('aid')} AS tac FROM "
               f"(SELECT DISTINCT c.case_id, e.seq, e.us, e.principal, e.actor, e.event, e.target, e.event_id, {classify('e.event')} AS aid FROM cases c JOIN ent x ON x.case_id = c.case_id JOIN cur e "
               f"ON ((x.kind = 'principal' AND x.value IN (e.principal, e.actor)) OR (x.kind = 'src_ip' AND x.value = e.src_ip)) AND e.us BETWEEN c.us_start - {PAD_MIN * MIN} AND c.us_end + {PAD_MIN * MIN}) q) q2) q3")
_cont = f"(s.aid = 'T1580' AND coalesce(f.aid = 'T1580', false) AND f.actor = s.actor AND s.us - f.anchor <= {COLLAPSE_MIN * MIN})"
CTES["fold"] = (f"SELECT case_id, rn, us AS anchor, CAST(1 AS BIGINT) AS step_no, aid, actor FROM sel WHERE rn = 1 UNION ALL SELECT s.case_id, s.rn, CASE WHEN {_cont} THEN f.anchor ELSE s.us END, "
                f"CASE WHEN {_cont} THEN f.step_no ELSE f.step_no + 1 END, s.aid, s.actor FROM fold f JOIN sel s ON s.case_id = f.case_id AND s.rn = f.rn + 1")
CTES["steps"] = ("SELECT case_id, step_no, min(us) AS us, arg_min(actor, rn) AS actor, arg_min(principal, rn) AS raw_principal, CASE WHEN count(*) > 1 THEN 'Discovery (' || count(*) || ' reads)' ELSE arg_min(event, rn) END AS action, "
                 "arg_min_null(aid, rn) AS attack_id, arg_min_null(target, rn) AS target, count(*) AS read_count FROM sel JOIN (SELECT case_id, rn, step_no FROM fold) f USING (case_id, rn) GROUP BY case_id, step_no")

# ---------------------------------------------------------------- permission graph

CTES["grp"] = "SELECT name, arn FROM principal WHERE ptype = 'group'"
_cl = "effect, actions, not_actions, resources, not_resources, conditional, condition_keys"
CTES["app"] = (f"SELECT s.owner AS principal, [0, 0, policy_ord, stmt_ord] AS ord, 'inline:' || policy_name AS label, {_cl} FROM statement s JOIN principal p ON s.owner = p.arn WHERE owner_kind = 'principal' "
               f"UNION ALL SELECT a.principal, [0, 1, a.ordinal, stmt_ord], 'managed:' || policy_name, {_cl} FROM attachment a JOIN statement s ON a.policy = s.owner JOIN principal p ON p.arn = a.principal WHERE owner_kind = 'policy' "
               f"UNION ALL SELECT m.principal, [m.ordinal + 1, 0, policy_ord, stmt_ord], 'group:' || group_name || '/inline:' || policy_name, {_cl} FROM membership m JOIN grp g ON g.name = m.group_name JOIN statement s ON s.owner = g.arn WHERE owner_kind = 'principal'")


def _any(patterns: str, value: str, fold: bool = False) -> str:
    f = (lambda x: f"lower({x})") if fold else (lambda x: x)
    return f"len(list_filter({patterns}, lambda p: {f(value)} GLOB {f('p')})) > 0"


def smatch(s: str, action: str, resource: str) -> str:
    act = f"CASE WHEN len({s}.actions) > 0 THEN {_any(s + '.actions', action, True)} WHEN len({s}.not_actions) > 0 THEN NOT ({_any(s + '.not_actions', action, True)}) ELSE false END"
    res = f"CASE WHEN len({s}.resources) > 0 THEN {_any(s + '.resources', resource)} WHEN len({s}.not_resources) > 0 THEN NOT ({_any(s + '.not_resources', resource)}) ELSE true END"
    return f"({act}) AND ({res})"


def decisions(probes: str) -> str:
    """Decision for every row of the probe CTE, by testing each applicable statement."""
    pick = "{'c': s.conditional, 'o': s.ord, 'l': s.label}"
    m = smatch("s", "q.action", "q.resource")
    return f"""
WITH q AS (SELECT DISTINCT principal, action, resource FROM {probes}),
i AS (SELECT q.principal, q.action, q.resource, min(CASE WHEN lower(effect) <> 'allow' AND NOT conditional THEN {{'o': s.ord, 'l': s.label}} END) AS id_deny,
        min(CASE WHEN lower(effect) = 'allow' THEN {pick} END) AS id_allow, count(CASE WHEN lower(effect) <> 'allow' AND conditional THEN 1 END) AS soft
      FROM q JOIN app s ON s.principal = q.principal WHERE {m} GROUP BY ALL),
b AS (SELECT q.principal, q.action, q.resource, bool_or(lower(effect) <> 'allow' AND NOT conditional) AS b_deny, min(CASE WHEN lower(effect) = 'allow' THEN conditional END) AS b_allow
      FROM q JOIN principal p ON p.arn = q.principal JOIN statement s ON s.owner_kind = 'policy' AND s.owner = p.boundary WHERE {m} GROUP BY ALL),
r AS (SELECT q.principal, q.action, q.resource, bool_or(lower(effect) <> 'allow' AND NOT conditional) AS r_deny, min(CASE WHEN lower(effect) = 'allow' THEN conditional END) AS r_allow,
        count(CASE WHEN lower(effect) <> 'allow' AND conditional THEN 1 END) AS soft
      FROM q JOIN statement s ON s.owner_kind = 'resource' AND s.owner = q.resource WHERE {m} GROUP BY ALL),
d AS (SELECT q.principal, q.action, q.resource, p.boundary IS NOT NULL AS bounded, id_deny, id_allow, coalesce(b_deny, false) AS b_deny, b_allow, coalesce(r_deny, false) AS r_deny, r_allow,
        coalesce(i.soft, 0) + coalesce(r.soft, 0) AS soft FROM q JOIN principal p ON p.arn = q.principal
      LEFT JOIN i USING (principal, action, resource) LEFT JOIN b USING (principal, action, resource) LEFT JOIN r USING (principal, action, resource))
SELECT principal, action, resource,
  CASE WHEN id_deny IS NOT NULL OR r_deny THEN 'EXPLICIT_DENY' WHEN id_allow IS NOT NULL AND bounded AND b_deny THEN 'EXPLICIT_DENY' WHEN id_allow IS NOT NULL AND (NOT bounded OR b_allow IS NOT NULL) THEN 'ALLOW'
       WHEN id_allow IS NOT NULL THEN 'IMPLICIT_DENY' WHEN r_allow IS NOT NULL THEN 'ALLOW' ELSE 'IMPLICIT_DENY' END AS effect,
  CASE WHEN id_deny IS NOT NULL OR r_deny THEN false WHEN id_allow IS NOT NULL AND bounded AND b_deny THEN false WHEN id_allow IS NOT NULL AND (NOT bounded OR b_allow IS NOT NULL) THEN id_allow.c OR (bounded AND b_allow)
       WHEN id_allow IS NOT NULL THEN false ELSE coalesce(r_allow, false) END AS conditional,
  id_deny IS NULL AND NOT r_deny AND id_allow IS NOT NULL AND bounded AND NOT b_deny AS boundary_limited,
  CASE WHEN id_deny IS NOT NULL THEN id_deny.l WHEN r_deny THEN 'resource-policy' WHEN id_allow IS NOT NULL AND bounded AND b_deny THEN 'boundary' WHEN id_allow IS NOT NULL THEN id_allow.l
       WHEN r_allow IS NOT NULL THEN 'resource-policy' END AS matched,
  CASE WHEN id_deny IS NOT NULL THEN 'explicit Deny in ' || id_deny.l WHEN r_deny THEN 'explicit Deny in resource-policy' WHEN id_allow IS NOT NULL AND bounded AND b_deny THEN 'explicit Deny in permission boundary'
       WHEN id_allow IS NOT NULL AND bounded AND b_allow IS NULL THEN 'action not permitted by permission boundary' WHEN id_allow IS NOT NULL AND bounded THEN 'permitted within permission boundary; Allow in ' || id_allow.l
       WHEN id_allow IS NOT NULL THEN 'Allow in ' || id_allow.l WHEN r_allow IS NOT NULL THEN 'Allow via resource-based policy' ELSE 'no matching Allow (implicit deny)' END AS reason,
  CASE WHEN id_deny IS NOT NULL OR r_deny THEN 0 ELSE soft END AS potential_denies
FROM d"""


CTES["trusts"] = (f"SELECT role, role_ord, stmt_ord, unnest(aws_principals) AS who, generate_subscripts(aws_principals, 1) - 1 AS pos FROM trust_statement "
                  f"WHERE lower(effect) = 'allow' AND len(list_filter(actions, lambda a: lower(a) IN {_in(fixed.ASSUME_ACTIONS)})) > 0")
CTES["trust"] = f"SELECT *, who = '*' OR coalesce(nullif(split_part(who, ':', 5), '') <> '{ACCOUNT}', false) AS external FROM trusts"
CTES["highres"] = ("SELECT arn AS target, ordinal AS r_ord, CASE WHEN rtype = 'AWS::S3::Bucket' THEN arn || '/probe-object' ELSE arn END AS resource, "
                   "CASE WHEN rtype = 'AWS::S3::Bucket' THEN 's3:GetObject' ELSE '*' END AS action FROM resource WHERE sensitivity = 'high'")
CTES["p_cpv"] = "SELECT principal, 'iam:CreatePolicyVersion' AS action, policy AS resource, ordinal FROM attachment"
CTES["p_self"] = " UNION ALL ".join(f"SELECT arn AS principal, '{a}' AS action, arn AS resource, '{t}' AS technique, {i} AS i FROM principal WHERE ptype = '{p}'"
                                    for p, ps in fixed.SELF_GRANTS.items() for i, (a, t) in enumerate(ps))
CTES["p_launch"] = " UNION ALL ".join(f"SELECT arn AS principal, '{a}' AS action, '*' AS resource, '{t}' AS technique, '{s}' AS service, {i} AS i FROM principal" for i, (t, (a, s)) in enumerate(fixed.LAUNCHES.items()))
CTES["p_pass"] = "SELECT p.arn AS principal, 'iam:PassRole' AS action, r.arn AS resource FROM principal p, principal r WHERE r.ptype = 'role'"
CTES["p_assume"] = "SELECT who AS principal, 'sts:AssumeRole' AS action, role AS resource, role_ord, stmt_ord, pos, external FROM trust WHERE who IN (SELECT arn FROM principal)"
CTES["p_data"] = "SELECT p.arn AS principal, h.action, h.resource, h.target, h.r_ord FROM principal p, highres h"
CTES["p_all"] = " UNION ".join(f"SELECT principal, action, resource FROM {p}" for p in ("p_cpv", "p_self", "p_launch", "p_pass", "p_assume", "p_data"))
CTES["allowed"] = "SELECT * FROM (" + decisions("p_all") + ") WHERE effect = 'ALLOW'"
CTES["svc"] = "SELECT DISTINCT role, unnest(service_principals) AS service FROM trust_statement WHERE lower(effect) = 'allow'"
CTES["esc"] = f"""
SELECT 'CAN_ESCALATE_VIA' AS kind, principal AS src, 'admin:{ACCOUNT}' AS dst, [0, 0, 0, 0, 0] AS ord, 'CreatePolicyVersion' AS technique, conditional FROM p_cpv JOIN allowed USING (principal, action, resource)
  QUALIFY row_number() OVER (PARTITION BY principal ORDER BY ordinal) = 1
UNION ALL SELECT 'CAN_ESCALATE_VIA', principal, 'admin:{ACCOUNT}', [1, i, 0, 0, 0], technique, conditional FROM p_self JOIN allowed USING (principal, action, resource)
UNION ALL SELECT 'CAN_ESCALATE_VIA', l.principal, s.role, [2, rp.ordinal, l.i, 0, 0], l.technique, la.conditional OR pa.conditional FROM p_launch l JOIN allowed la ON la.principal = l.principal AND la.action = l.action AND la.resource = l.resource
  JOIN svc s ON s.service = l.service JOIN principal rp ON rp.arn = s.role JOIN allowed pa ON pa.principal = l.principal AND pa.action = 'iam:PassRole' AND pa.resource = s.role
UNION ALL SELECT 'CAN_ESCALATE_VIA', principal, resource, [3, role_ord, stmt_ord, pos, 0], 'AssumeRole', conditional FROM p_assume JOIN allowed USING (principal, action, resource)
UNION ALL SELECT 'CAN_ACCESS', principal, target, [4, r_ord, 0, 0, 0], action, conditional FROM p_data JOIN allowed USING (principal, action, resource)"""
CTES["admins"] = ("SELECT DISTINCT principal FROM app WHERE lower(effect) = 'allow' AND NOT conditional AND len(list_filter(actions, lambda a: lower(a) IN ('*', 'iam:*'))) > 0 AND list_contains(resources, '*')")
CTES["g_admin"] = f"SELECT 'admin:{ACCOUNT}' AS node, 'admin-equivalent' AS priv UNION SELECT principal, 'admin-equivalent' FROM admins"
CTES["g_sens"] = "SELECT arn AS node, 'sensitive-resource:high' AS priv FROM resource WHERE sensitivity = 'high'"
CTES["g_both"] = "SELECT * FROM g_admin UNION SELECT * FROM g_sens"
CTES["escd"] = "SELECT DISTINCT src, dst FROM esc"
for _g in ("admin", "sens", "both"):
    CTES[f"walk_{_g}"] = f"SELECT node, 0 AS d FROM g_{_g} UNION SELECT e.src, w.d + 1 FROM walk_{_g} w JOIN escd e ON e.dst = w.node WHERE w.d < 12"
    CTES[f"dist_{_g}"] = f"SELECT node, min(d) AS d FROM walk_{_g} GROUP BY node"
    CTES[f"next_{_g}"] = (f"SELECT e.*, a.d FROM esc e JOIN dist_{_g} a ON a.node = e.src JOIN dist_{_g} b ON b.node = e.dst WHERE a.d > 0 AND b.d = a.d - 1 "
                          f"QUALIFY row_number() OVER (PARTITION BY e.src ORDER BY e.ord) = 1")
    CTES[f"trail_{_g}"] = (f"SELECT node AS principal, node AS at, '' AS techniques, '' AS nodes, 0 AS len, false AS conditional, '' AS flags FROM dist_{_g} UNION ALL SELECT t.principal, n.dst, CASE WHEN t.len = 0 THEN n.technique ELSE t.techniques || ',' || n.technique END, "
                           f"CASE WHEN t.len = 0 THEN n.dst ELSE t.nodes || ',' || n.dst END, t.len + 1, t.conditional OR n.conditional, t.flags || CASE WHEN n.conditional THEN '?' ELSE '-' END FROM trail_{_g} t JOIN next_{_g} n ON n.src = t.at")
    CTES[f"path_{_g}"] = f"SELECT t.principal, t.at AS target, g.priv AS target_priv, t.techniques, t.nodes, t.len AS length, t.conditional, t.flags FROM trail_{_g} t JOIN g_{_g} g ON g.node = t.at"
CTES["paths"] = "SELECT p.* FROM path_both p JOIN principal q ON q.arn = p.principal WHERE length > 0"


def _earlier() -> None:
    """The tables up to the paths once more over the earlier snapshot, as ``<name>_before``."""
    moved = ["attachment", "trust_statement"]

    def point(names: list[str]) -> re.Pattern:
        return re.compile(rf"\b((?:FROM|JOIN|,)\s+)({'|'.join(names)})\b")

    for name in list(CTES):
        if name not in VIEWS and point(moved).search(CTES[name]):
            moved.append(name)
    for name in moved[2:]:
        CTES[f"{name}_before"] = point(moved).sub(r"\1\2_before", CTES[name])


_earlier()
_verbs = "|".join(fixed.IAM_WRITE_VERBS)
CTES["blast"] = f"""
SELECT arn AS principal, rs AS reach_sensitive, ra AS reach_admin, pa AS privesc_available, cp AS current_privilege,
  round(round(rs * 0.3 * 100, 1) + round(ra * 0.3 * 100, 1) + round(pa * 0.2 * 100, 1) + round(cp * 0.2 * 100, 1), 1) AS blast FROM (
SELECT p.arn, CASE WHEN s.principal IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rs, CASE WHEN a.principal IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ra, CASE WHEN a.length > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pa,
  CASE WHEN p.arn IN (SELECT principal FROM admins) THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, (CASE WHEN p.arn IN (SELECT src FROM esc WHERE kind = 'CAN_ACCESS') THEN 0.5::DOUBLE ELSE 0 END)
    + (CASE WHEN p.arn IN (SELECT principal FROM app WHERE lower(effect) = 'allow' AND NOT conditional AND (len(resources) > 0 OR len(not_resources) > 0)
        AND len(list_filter(actions, lambda x: lower(x) IN ('*', 'iam:*') OR regexp_matches(lower(x), '^iam:.*({_verbs})'))) > 0) THEN 0.3::DOUBLE ELSE 0 END)
    + (CASE WHEN p.arn IN (SELECT who FROM trust) THEN 0.2::DOUBLE ELSE 0 END)) END AS cp
FROM principal p LEFT JOIN path_admin a ON a.principal = p.arn LEFT JOIN path_sens s ON s.principal = p.arn)"""
CTES["touched"] = "SELECT DISTINCT case_id, actor AS principal FROM steps UNION SELECT case_id, value FROM ent WHERE kind = 'principal'"
CTES["ranked"] = ("SELECT c.*, coalesce(w.principal, '(none)') AS blast_principal, coalesce(w.blast, 0.0) AS blast, round(0.6 * (coalesce(w.blast, 0.0) / 100.0) + 0.4 * c.score, 4) AS rank FROM cases c LEFT JOIN "
                  "(SELECT case_id, b.principal, b.blast FROM touched JOIN blast b USING (principal) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY b.blast DESC, b.principal DESC) = 1) w USING (case_id)")
_tail = lambda c: f"split_part({c}, '/', -1)"
CTES["prop"] = f"""
SELECT * FROM (
SELECT case_id, step_no, 'deactivate-access-key' AS action_key, actor AS subject, 'low' AS sensitivity FROM steps WHERE attack_id IN {_in(fixed.KEY_ABUSE)} AND contains(actor, ':user/')
UNION ALL SELECT case_id, step_no, 'quarantine-principal', actor, 'low' FROM steps WHERE attack_id IN {_in(fixed.SELF_ESCALATION)}
UNION ALL SELECT case_id, step_no, 're-enable-logging', target, 'high' FROM steps WHERE attack_id = 'T1562.008' AND target <> ''
UNION ALL SELECT case_id, step_no, 'isolate-instance', target, 'low' FROM steps WHERE attack_id = 'T1496' AND target <> '')
QUALIFY row_number() OVER (PARTITION BY case_id, action_key, subject ORDER BY step_no) = 1"""
CTES["plan"] = ("SELECT p.*, r.score AS confidence, r.blast, CASE WHEN action_key = 'deactivate-access-key' AND r.score >= 0.8 THEN 'auto' ELSE 'human' END AS mode, "
                "round(least(100.0, r.blast + CASE WHEN sensitivity = 'high' THEN 10 ELSE 0 END), 1) AS priority FROM prop p JOIN ranked r USING (case_id)")


def compose(select: str) -> str:
    """Prefix a statement with the CTEs it needs, in order."""
    wanted: list[str] = []

    def need(text: str, path: tuple[str, ...]) -> None:
        for name in CTES:
            if name not in wanted and name not in path and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                need(CTES[name], (*path, name))
                wanted.append(name)

    need(select, ())
    if not wanted:
        return select
    head = "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in wanted)
    local = re.match(r"\s*WITH\s+", select)
    return head + ",\n" + select[local.end():] if local else head + "\n" + select
