"""Adapter views: the given tables read as audit events and permission tables.

The view text is shared by both engines so that checks compare operators, not adapters. Placeholders in braces hold
the few spellings that differ. Every row of the base tables takes part; ids only pick attribute values. A user or role
holds the policy of the part with its largest total quantity, summed over all order lines, so the permission graph
grows in step with the accounts; likewise for the role that trusts a user.
"""

from __future__ import annotations

import re

ACCOUNT = "111122223333"
IAM = f"arn:aws:iam::{ACCOUNT}:"
SPLIT_US = "1705363200000000"  # 2024-01-16: history before, current activity after

SPARK = {"us": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)", "list": "array", "none": "CAST(array() AS ARRAY<STRING>)"}
DUCK = {"us": "epoch_us(ts)", "list": "list_value", "none": "CAST([] AS VARCHAR[])"}

_USER = "CASE WHEN {c} % 10 = 0 THEN 'svc-' || {c} ELSE 'u' || {c} END"


def _user(c: str) -> str:
    return f"'{IAM}user/' || (" + _USER.replace("{c}", c) + ")"


def _role(c: str) -> str:
    return f"'{IAM}role/s' || ({c})"


#: The join that every sum over the order lines starts from; Spark reads it as one prepared table (``Workspace.ordered_lines``).
LINES = "orders JOIN lineitem ON o_orderkey = l_orderkey"


def _most(who: str, what: str) -> str:
    """(who, what): for every ``who`` of all order lines, the ``what`` of its largest total quantity, ties to the larger key."""
    return f"""(SELECT {who}, max(q * 1000000000000 + {what}) % 1000000000000 AS {what} FROM (
  SELECT {who}, {what}, CAST(sum(l_quantity) AS BIGINT) AS q FROM {LINES} GROUP BY {who}, {what}) s GROUP BY {who})"""


VIEWS: dict[str, str] = {}

VIEWS["ev"] = f"""
SELECT seq, 'e' || seq AS event_id, us, uid, k, '{ACCOUNT}' AS account, event,
  CASE WHEN uid % 7 = 3 THEN 'arn:aws:sts::{ACCOUNT}:assumed-role/s' || (uid % 10) || '/x' || uid ELSE {_user('uid')} END AS principal,
  CASE WHEN uid % 7 = 3 THEN 'assumed_role' WHEN uid % 53 = 0 THEN 'root' ELSE 'user' END AS principal_type,
  CASE WHEN uid % 7 = 3 THEN {_role('uid % 10')} END AS issuer,
  CASE WHEN event = 'AssumeRole' OR event = 'UpdateAssumeRolePolicy' THEN {_role('k % 10')}
       WHEN event IN ('GetObject', 'PutObject') THEN 'arn:aws:s3:::b' || (uid % 97) || '/o' || k
       WHEN event IN ('PutBucketAcl', 'PutBucketPolicy', 'DeletePublicAccessBlock', 'PutPublicAccessBlock') THEN 'arn:aws:s3:::b' || (uid % 97)
       WHEN event IN ('StopLogging', 'StartLogging', 'DeleteTrail') THEN 'arn:aws:cloudtrail:us-east-1:{ACCOUNT}:trail/t' || (uid % 25)
       WHEN event = 'RunInstances' THEN 'i-' || k WHEN event = 'AuthorizeSecurityGroupIngress' THEN 'sg-' || (k % 12)
       WHEN event = 'CreatePolicyVersion' THEN '{IAM}policy/p' || k
       WHEN event_type = 'signup' THEN {_user('uid')} END AS target,
  CASE (uid % 4 + CASE WHEN k >= 90 THEN 1 ELSE 0 END) % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' ELSE 'SG' END AS geo,
  'AS' || (uid % 17 + 100) AS asn, '10.0.' || (uid % 50) || '.' || (k % 8) AS src_ip,
  CASE k % 5 WHEN 1 THEN 'us-west-2' WHEN 2 THEN 'eu-west-1' WHEN 3 THEN 'ap-south-1' ELSE 'us-east-1' END AS region,
  uid % 2 = 0 AS mfa,
  CASE WHEN event_type IN ('view', 'click') THEN true WHEN event_type IN ('signup', 'purchase') THEN false END AS read_only,
  CASE WHEN k % 10 = 0 THEN 'high' WHEN k % 10 < 3 THEN 'medium' ELSE 'unknown' END AS resource_sensitivity,
  'aws-cli/2 <' || event_type || ' & "k"=' || k || '>' AS user_agent,
  CAST(NULL AS STRING) AS error_code, CAST(k AS DOUBLE) / 10 AS severity, 'cloudtrail' AS source, 'r' || seq AS raw_ref,
  CASE WHEN event LIKE '%Object' OR event LIKE 'PutBucket%' OR event LIKE '%PublicAccessBlock' THEN 's3.amazonaws.com'
       WHEN event_type = 'signup' OR event = 'UpdateAssumeRolePolicy' THEN 'iam.amazonaws.com' WHEN event = 'RunInstances' THEN 'ec2.amazonaws.com'
       WHEN event LIKE '%Logging' OR event = 'DeleteTrail' THEN 'cloudtrail.amazonaws.com' END AS event_source,
  CAST(floor(value * 1000000) AS BIGINT) AS bytes,
  CASE WHEN event = 'AuthorizeSecurityGroupIngress' THEN CASE k % 3
         WHEN 0 THEN '{{"groupId":"sg-1","ipPermissions":{{"items":[{{"ipRanges":[{{"cidrIp":"0.0.0.0/0"}}]}}]}}}}'
         WHEN 1 THEN '{{"0.0.0.0/0":"10.0.0.0/8"}}' ELSE '{{"cidr":["10.0.0.0/8","::/0"]}}' END
       WHEN event = 'RunInstances' THEN CASE WHEN k % 2 = 0 THEN '{{"instanceType":"p3.2xlarge"}}' WHEN k % 3 = 0 THEN '{{"instanceType":"M5.24XLARGE"}}'
         ELSE '{{"instanceType":"t3.micro"}}' END
       WHEN event = 'UpdateAssumeRolePolicy' THEN CASE k % 3
         WHEN 0 THEN '{{"policyDocument":{{"Statement":[{{"Effect":"Allow","Principal":{{"AWS":"arn:aws:iam::999988887777:root"}}}}]}}}}'
         WHEN 1 THEN '{{"policyDocument":{{"Statement":{{"Effect":"Allow","Principal":{{"AWS":["{IAM}root","*"]}}}}}}}}'
         ELSE '{{"policyDocument":{{"Statement":[{{"Effect":"Allow","Principal":{{"AWS":"{IAM}root"}}}}]}}}}' END
       WHEN event = 'PutBucketAcl' THEN CASE WHEN uid % 2 = 0 THEN '{{"x-amz-acl":"public-read"}}' ELSE '{{"x-amz-acl":"private"}}' END
       WHEN event = 'PutBucketPolicy' THEN CASE WHEN uid % 2 = 0 THEN '{{"bucketPolicy":{{"Statement":{{"Effect":"Allow","Principal":"*"}}}}}}'
         ELSE '{{"bucketPolicy":{{"Statement":{{"Effect":"Deny","Principal":"*"}}}}}}' END
       WHEN event = 'PutPublicAccessBlock' THEN CASE WHEN uid % 2 = 0 THEN '{{"PublicAccessBlockConfiguration":{{"BlockPublicAcls":false}}}}'
         ELSE '{{"PublicAccessBlockConfiguration":{{"BlockPublicAcls":true}}}}' END
       ELSE '{{"k":' || k || ',"note":"a<b & c"}}' END AS params
FROM (SELECT *, CASE event_type
    WHEN 'view' THEN CASE k % 10 WHEN 0 THEN 'DescribeInstances' WHEN 1 THEN 'ListRoles' WHEN 2 THEN 'ListUsers' WHEN 3 THEN 'GetBucketAcl'
      WHEN 4 THEN 'DescribeVpcs' WHEN 5 THEN 'ListBuckets' WHEN 6 THEN 'GetPolicy' WHEN 7 THEN 'ListPolicies' WHEN 8 THEN 'DescribeTrails' ELSE 'GetAccountSummary' END
    WHEN 'click' THEN 'GetObject'
    WHEN 'signup' THEN CASE k % 5 WHEN 0 THEN 'CreateUser' WHEN 1 THEN 'CreateAccessKey' WHEN 2 THEN 'AttachUserPolicy' WHEN 3 THEN 'PutUserPolicy' ELSE 'CreatePolicyVersion' END
    WHEN 'purchase' THEN CASE k % 6 WHEN 0 THEN 'AssumeRole' WHEN 3 THEN 'AssumeRole' WHEN 1 THEN 'RunInstances' WHEN 4 THEN 'RunInstances' WHEN 2 THEN 'PutObject'
      ELSE CASE CAST(floor(k / 6.0) AS INT) % 4 WHEN 0 THEN 'PutBucketAcl' WHEN 1 THEN 'PutBucketPolicy' WHEN 2 THEN 'DeletePublicAccessBlock' ELSE 'PutPublicAccessBlock' END END
    ELSE CASE k % 8 WHEN 0 THEN 'StopLogging' WHEN 4 THEN 'StartLogging' WHEN 1 THEN 'DeleteTrail' WHEN 5 THEN 'DeleteTrail'
      WHEN 2 THEN 'AuthorizeSecurityGroupIngress' WHEN 6 THEN 'AuthorizeSecurityGroupIngress' ELSE 'UpdateAssumeRolePolicy' END END AS event
  FROM (SELECT event_id AS seq, {{us}} AS us, user_id AS uid, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) a) b
"""

_PROMO = "p_type = 'PROMO'"
VIEWS["principal"] = f"""
SELECT '{ACCOUNT}' AS account, '{IAM}group/' || seg AS arn, seg AS name, 'group' AS ptype, 'unknown' AS sensitivity, CAST(NULL AS STRING) AS boundary,
  CAST(ascii(seg) AS BIGINT) AS ordinal FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer) g
UNION ALL
SELECT '{ACCOUNT}', {_user('c_custkey')}, {_USER.replace('{c}', 'c_custkey')}, 'user', 'unknown',
  CASE WHEN c_acctbal < 0 THEN '{IAM}policy/p' || (c_custkey % 40) END, 1099511627776 + c_custkey FROM customer
UNION ALL
SELECT '{ACCOUNT}', {_role('s_suppkey')}, 's' || s_suppkey, 'role', 'unknown', CAST(NULL AS STRING), 2199023255552 + s_suppkey FROM supplier
"""
VIEWS["attachment"] = f"""
SELECT {_user('o_custkey')} AS principal, CAST(l_partkey AS BIGINT) AS ordinal, '{IAM}policy/p' || l_partkey AS policy
FROM {_most('o_custkey', 'l_partkey')} a
UNION ALL
SELECT {_role('l_suppkey')}, CAST(l_partkey AS BIGINT), '{IAM}policy/p' || l_partkey
FROM {_most('l_suppkey', 'l_partkey')} b
"""
VIEWS["membership"] = f"SELECT {_user('c_custkey')} AS principal, CAST(0 AS BIGINT) AS ordinal, c_mktsegment AS group_name FROM customer"
VIEWS["inline_policy"] = f"""
SELECT {_role('s_suppkey')} AS principal, 'own' AS policy_name, CAST(0 AS BIGINT) AS ordinal FROM supplier
UNION ALL SELECT {_user('c_custkey')}, 'own', CAST(0 AS BIGINT) FROM customer
UNION ALL SELECT DISTINCT '{IAM}group/' || c_mktsegment, 'base', CAST(0 AS BIGINT) FROM customer
"""
VIEWS["policy"] = f"SELECT '{ACCOUNT}' AS account, '{IAM}policy/p' || p_partkey AS arn, 'p' || p_partkey AS name, CAST(p_partkey AS BIGINT) AS ordinal FROM part"
VIEWS["resource"] = f"""
SELECT '{ACCOUNT}' AS account, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'arn:aws:cloudtrail:us-east-1:{ACCOUNT}:trail/t' || p_partkey ELSE 'arn:aws:s3:::b' || p_partkey END AS arn,
  CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'AWS::CloudTrail::Trail' ELSE 'AWS::S3::Bucket' END AS rtype,
  CASE WHEN {_PROMO} AND p_size > 40 THEN 'high' WHEN {_PROMO} THEN 'medium' WHEN p_type = 'SMALL' THEN 'low' ELSE 'unknown' END AS sensitivity,
  CAST(p_partkey AS BIGINT) AS ordinal FROM part
"""
_ACT = """CASE p_partkey % 10 WHEN 0 THEN 's3:Get*' WHEN 1 THEN 's3:*' WHEN 2 THEN 'iam:CreatePolicyVersion' WHEN 3 THEN 'iam:PassRole' WHEN 4 THEN 'sts:AssumeRole'
  WHEN 5 THEN 'lambda:CreateFunction' WHEN 6 THEN 'ec2:Run?nstances' WHEN 7 THEN 'iam:Put*Policy' WHEN 8 THEN 'cloudtrail:*'
  ELSE CASE WHEN p_size < 4 THEN '*' ELSE 'iam:AttachUserPolicy' END END"""
_STMT = "owner, owner_kind, policy_name, policy_ord, stmt_ord, effect, actions, not_actions, resources, not_resources, conditional, condition_keys"
VIEWS["statement"] = f"""
SELECT '{IAM}policy/p' || p_partkey AS owner, 'policy' AS owner_kind, 'p' || p_partkey AS policy_name, CAST(0 AS BIGINT) AS policy_ord, CAST(0 AS BIGINT) AS stmt_ord,
  CASE WHEN p_size % 11 = 0 THEN 'Deny' ELSE 'Allow' END AS effect,
  CASE WHEN p_size % 13 = 0 THEN {{none}} ELSE {{list}}({_ACT}) END AS actions, CASE WHEN p_size % 13 = 0 THEN {{list}}({_ACT}, 's3:*', 'iam:*') ELSE {{none}} END AS not_actions,
  CASE p_partkey % 6 WHEN 0 THEN {{list}}('*') WHEN 1 THEN {{list}}('*') WHEN 2 THEN {{list}}('{IAM}role/s*', 'arn:aws:s3:::b1*') WHEN 3 THEN {{list}}('{IAM}*') WHEN 4 THEN {{list}}('arn:aws:s3:::b2*', '{IAM}policy/p?') ELSE {{none}} END AS resources,
  CASE WHEN p_partkey % 6 = 5 AND p_size % 2 = 0 THEN {{list}}('arn:aws:s3:::b1*') ELSE {{none}} END AS not_resources,
  p_size % 7 = 0 AS conditional, CASE WHEN p_size % 7 = 0 THEN {{list}}('aws:SourceIp') ELSE {{none}} END AS condition_keys FROM part
UNION ALL
SELECT {_role('s_suppkey')}, 'principal', 'own', CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'Allow',
  {{list}}(CASE s_suppkey % 3 WHEN 0 THEN 'iam:AttachRolePolicy' WHEN 1 THEN 's3:GetObject' ELSE 'sts:AssumeRole' END), {{none}},
  {{list}}(CASE s_suppkey % 3 WHEN 0 THEN {_role('s_suppkey')} WHEN 1 THEN 'arn:aws:s3:::b' || (s_suppkey % 9) || '*' ELSE '{IAM}role/s*' END), {{none}},
  s_nationkey % 5 = 0, CASE WHEN s_nationkey % 5 = 0 THEN {{list}}('aws:SourceVpc') ELSE {{none}} END FROM supplier
UNION ALL
SELECT {_user('c_custkey')}, 'principal', 'own', CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'Allow', {{list}}('sts:AssumeRole'), {{none}},
  {{list}}('{IAM}role/s' || (c_custkey % 10) || '*'), {{none}}, c_nationkey = 3, CASE WHEN c_nationkey = 3 THEN {{list}}('aws:MultiFactorAuthPresent') ELSE {{none}} END FROM customer
UNION ALL
SELECT DISTINCT '{IAM}group/' || c_mktsegment, 'principal', 'base', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CASE WHEN c_mktsegment = 'BUILDING' THEN 'Deny' ELSE 'Allow' END,
  {{list}}(CASE c_mktsegment WHEN 'MACHINERY' THEN 'lambda:CreateFunction' WHEN 'BUILDING' THEN 'iam:Put*' ELSE 's3:ListBucket' END), {{none}}, {{list}}('*'), {{none}}, false, {{none}} FROM customer
UNION ALL
SELECT 'arn:aws:s3:::b' || p_partkey, 'resource', 'resource-policy', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CASE WHEN p_size < 3 THEN 'Deny' ELSE 'Allow' END,
  {{list}}('s3:ListBucket'), {{none}}, {{list}}('arn:aws:s3:::b' || p_partkey), {{none}}, p_size = 9, CASE WHEN p_size = 9 THEN {{list}}('aws:PrincipalOrgID') ELSE {{none}} END
FROM part WHERE p_type = 'ECONOMY' AND p_brand NOT IN ('Brand#1', 'Brand#2')
"""
VIEWS["trust_statement"] = f"""
SELECT '{ACCOUNT}' AS account, {_role('l_suppkey')} AS role, 2199023255552 + l_suppkey AS role_ord, CAST(o_custkey AS BIGINT) AS stmt_ord, 'Allow' AS effect, {{list}}('sts:AssumeRole') AS actions,
  {{list}}({_user('o_custkey')}) AS aws_principals, {{none}} AS service_principals
FROM {_most('o_custkey', 'l_suppkey')} t
UNION ALL
SELECT '{ACCOUNT}', {_role('s_suppkey')}, 2199023255552 + s_suppkey, CAST(1000000000000 AS BIGINT), CASE WHEN s_nationkey = 7 THEN 'Deny' ELSE 'Allow' END, {{list}}('sts:*'),
  {{list}}({_role('(7 * s_suppkey + 3) % (SELECT count(*) FROM supplier)')}, CASE WHEN s_acctbal < 0 THEN '*' ELSE 'arn:aws:iam::999988887777:root' END), {{none}}
FROM supplier
UNION ALL
SELECT '{ACCOUNT}', {_role('s_suppkey')}, 2199023255552 + s_suppkey, CAST(1000000000001 AS BIGINT), 'Allow', {{list}}('sts:AssumeRole'), {{none}},
  {{list}}(CASE s_suppkey % 3 WHEN 0 THEN 'lambda.amazonaws.com' WHEN 1 THEN 'ec2.amazonaws.com' ELSE 'ecs.amazonaws.com' END) FROM supplier
"""

#: The attachments and trusts an earlier snapshot holds: those of the orders placed until then.
SNAPSHOT_DAY = "DATE '2001-01-01'"
for _name in ("attachment", "trust_statement"):
    VIEWS[f"{_name}_before"] = VIEWS[_name].replace("FROM orders JOIN", f"FROM (SELECT * FROM orders WHERE o_orderdate < {SNAPSHOT_DAY}) orders JOIN")


def on_ordered_lines(text: str) -> str:
    """The view text over the joined lines, a table ``ordered_lines``, in place of the join itself. Views of earlier orders keep their own join."""
    return text.replace(f"FROM {LINES}", "FROM ordered_lines")


def view_sql(name: str, engine: dict[str, str]) -> str:
    text = VIEWS[name]
    for key, value in engine.items():
        text = text.replace("{" + key + "}", value)
    return text if engine is SPARK else re.sub(r"\bAS STRING\)", "AS VARCHAR)", text)
