"""Fixed values. They have to equal the published detection content for results to agree."""

from __future__ import annotations

# --- fixed values: ATT&CK technique id -> (name, tactic) ---
TECHNIQUES = {
    "T1078": ("Valid Accounts", "Defense Evasion"),
    "T1078.004": ("Valid Accounts: Cloud Accounts", "Persistence"),
    "T1550": ("Use Alternate Authentication Material", "Lateral Movement"),
    "T1550.001": ("Application Access Token", "Defense Evasion"),
    "T1098": ("Account Manipulation", "Persistence"),
    "T1098.001": ("Additional Cloud Credentials", "Persistence"),
    "T1098.003": ("Additional Cloud Roles", "Privilege Escalation"),
    "T1136": ("Create Account", "Persistence"),
    "T1136.003": ("Create Account: Cloud Account", "Persistence"),
    "T1562": ("Impair Defenses", "Defense Evasion"),
    "T1562.007": ("Disable or Modify Cloud Firewall", "Defense Evasion"),
    "T1562.008": ("Disable or Modify Cloud Logs", "Defense Evasion"),
    "T1580": ("Cloud Infrastructure Discovery", "Discovery"),
    "T1526": ("Cloud Service Discovery", "Discovery"),
    "T1530": ("Data from Cloud Storage", "Collection"),
    "T1537": ("Transfer Data to Cloud Account", "Exfiltration"),
    "T1496": ("Resource Hijacking", "Impact"),
    "T1548": ("Abuse Elevation Control Mechanism", "Privilege Escalation"),
}

# --- fixed values: kill-chain order of tactics ---
TACTIC_ORDER = [
    "Initial Access", "Execution", "Persistence", "Privilege Escalation",
    "Defense Evasion", "Credential Access", "Discovery", "Lateral Movement",
    "Collection", "Exfiltration", "Impact",
]

# --- fixed values: API name -> technique for chain steps ---
STEP_TECHNIQUES = {
    "AssumeRole": "T1548", "AssumeRoleWithSAML": "T1548", "AssumeRoleWithWebIdentity": "T1548",
    "CreatePolicyVersion": "T1098.003", "SetDefaultPolicyVersion": "T1098.003",
    "AttachUserPolicy": "T1098.003", "PutUserPolicy": "T1098.003",
    "AttachRolePolicy": "T1098.003", "PutRolePolicy": "T1098.003", "UpdateAssumeRolePolicy": "T1098.003",
    "CreateAccessKey": "T1098.001", "CreateLoginProfile": "T1098.001",
    "CreateUser": "T1136.003", "RunInstances": "T1496",
    "AuthorizeSecurityGroupIngress": "T1562.007", "AuthorizeSecurityGroupEgress": "T1562.007",
    "GetObject": "T1530", "PutObject": "T1530", "CopyObject": "T1530", "SelectObjectContent": "T1530",
    "StopLogging": "T1562.008", "DeleteTrail": "T1562.008",
    "UpdateTrail": "T1562.008", "DeleteDetector": "T1562.008",
}
DISCOVERY = "T1580"

# --- fixed values: identity type names in audit records ---
PRINCIPAL_TYPES = {
    "IAMUser": "user", "Root": "root", "AssumedRole": "assumed_role", "Role": "role",
    "AWSService": "service", "AWSAccount": "account", "FederatedUser": "federated",
}

# --- fixed values: request parameters that name the target, in priority order ---
TARGET_PARAMS = ["roleArn", "policyArn", "userName", "roleName", "functionName",
                 "bucketName", "instanceId", "groupId", "trailARN", "name"]

SENSITIVITIES = ["high", "medium", "low", "unknown"]

# --- fixed values: word lists of the signature and behaviour layers ---
READ_PREFIXES = ["Describe", "List", "Get"]
AUTOMATION_TOKENS = ["bot", "ci-", "-ci", "jenkins", "terraform", "svc",
                     "service-account", "automation", "runner", "pipeline"]
IAM_WRITES = [
    "CreateUser", "DeleteUser", "CreateAccessKey", "UpdateAccessKey", "CreateLoginProfile",
    "UpdateLoginProfile", "AttachUserPolicy", "DetachUserPolicy", "PutUserPolicy", "AttachRolePolicy",
    "PutRolePolicy", "CreatePolicy", "CreatePolicyVersion", "SetDefaultPolicyVersion", "CreateRole",
    "DeleteRole", "UpdateAssumeRolePolicy", "AddUserToGroup", "CreateGroup", "PutGroupPolicy",
    "AddRoleToInstanceProfile", "PassRole",
]
OPEN_GROUP_EVENTS = ["AuthorizeSecurityGroupIngress", "AuthorizeSecurityGroupEgress", "ModifySecurityGroupRules"]
WORLD_RANGES = ["0.0.0.0/0", "::/0"]
TRUST_DOCUMENT_PARAM = {"UpdateAssumeRolePolicy": "policyDocument", "CreateRole": "assumeRolePolicyDocument"}
BIG_INSTANCE_FAMILIES = ["p2.", "p3.", "p4", "p5", "g3", "g4", "g5", "g6", "inf", "trn", "dl1", "f1", "x1", "x2"]
BIG_INSTANCE_SIZES = ["8xlarge", "12xlarge", "16xlarge", "24xlarge", "32xlarge", "48xlarge", "metal"]
S3_APIS = ["GetObject", "PutObject", "ListBucket", "PutBucketPolicy", "PutBucketAcl",
           "PutPublicAccessBlock", "DeletePublicAccessBlock"]
IAM_APIS = ["CreateRole", "UpdateAssumeRolePolicy", "AttachRolePolicy", "AttachUserPolicy",
            "PutRolePolicy", "PutUserPolicy", "CreatePolicyVersion", "PassRole"]
BLOCK_SETTINGS = ["BlockPublicAcls", "IgnorePublicAcls", "BlockPublicPolicy", "RestrictPublicBuckets"]
PUBLIC_ACLS = ["public-read", "public-read-write", "authenticated-read"]
BYTE_PARAMS = ["bytesTransferred", "bytes_transferred", "objectSize", "bytesSent"]
ASSUME_ACTIONS = ["*", "sts:*", "sts:assumerole", "sts:assumerolewithsaml", "sts:assumerolewithwebidentity"]
SENSITIVE_ACTIONS = [
    "iam:CreatePolicyVersion", "iam:PutUserPolicy", "iam:AttachUserPolicy", "iam:PassRole", "sts:AssumeRole",
    "s3:GetObject", "s3:PutObject", "s3:DeleteObject", "cloudtrail:StopLogging", "cloudtrail:DeleteTrail",
]
IAM_WRITE_VERBS = ["create", "update", "put", "attach", "detach", "delete", "add", "remove", "set"]
CAPABILITY_WEIGHTS = {"read_sensitive": 0.5, "iam_write": 0.3, "can_assume": 0.2}
BLAST_WEIGHTS = {"reach_sensitive": 0.30, "reach_admin": 0.30, "privesc_available": 0.20, "current_privilege": 0.20}

# --- fixed values: shipped rules (same document shape as the YAML rule files) ---
RULES = [
    {"id": "ec2-cryptomining-launch", "title": "GPU/large EC2 launched in an unusual region (possible crypto-mining)",
     "attack": "T1496", "confidence": 0.7, "level": "high",
     "detection": {"selection": {"event": "RunInstances", "derived.gpu_or_large_instance": True},
                   "filter": {"region": ["us-east-1", "us-west-2"]},
                   "condition": "selection and not filter"},
     "falsepositives": ["Sanctioned ML/HPC workloads", "Newly adopted region not yet in the home-region list"]},
    {"id": "iam-root-activity", "title": "Root account activity",
     "attack": "T1078.004", "confidence": 0.6, "level": "high",
     "detection": {"selection": {"principal_type": "root"}, "condition": "selection"},
     "falsepositives": ["Documented break-glass usage", "Root-only account/billing tasks"]},
    {"id": "iam-non-mfa-sensitive-write", "title": "Sensitive write performed without MFA",
     "attack": "T1078", "confidence": 0.6, "level": "medium",
     "detection": {"selection": {"mfa": False, "read_only": False, "resource_sensitivity": "high"},
                   "condition": "selection"},
     "falsepositives": ["Service/automation roles that never use MFA (scope them out)"]},
    {"id": "ct-logging-tampering", "title": "Cloud logging or threat-detection disabled",
     "attack": "T1562.008", "confidence": 0.9, "level": "high",
     "detection": {"selection": {"event": ["StopLogging", "DeleteTrail", "UpdateTrail", "DeleteDetector"]},
                   "condition": "selection"},
     "falsepositives": ["Planned trail/detector teardown or IaC replacement", "Log pipeline migration"]},
    {"id": "ec2-sg-open-world", "title": "Security group opened to the entire internet (0.0.0.0/0)",
     "attack": "T1562.007", "confidence": 0.8, "level": "high",
     "detection": {"selection": {"event": ["AuthorizeSecurityGroupIngress", "AuthorizeSecurityGroupEgress",
                                           "ModifySecurityGroupRules"],
                                 "derived.sg_opens_world": True},
                   "condition": "selection"},
     "falsepositives": ["Deliberately public load balancers / web tiers",
                        "Re-applying an existing public rule via IaC"]},
    {"id": "iam-create-user", "title": "New IAM user created",
     "attack": "T1136.003", "confidence": 0.6, "level": "medium",
     "detection": {"selection": {"event": "CreateUser"}, "condition": "selection"},
     "falsepositives": ["Routine user onboarding", "IaC-managed IAM users"]},
    {"id": "iam-add-credentials", "title": "New long-term credentials or console login profile created",
     "attack": "T1098.001", "confidence": 0.7, "level": "high",
     "detection": {"selection": {"event": ["CreateAccessKey", "CreateLoginProfile"]}, "condition": "selection"},
     "falsepositives": ["Self-service access-key rotation", "Help-desk console password reset"]},
    {"id": "iam-backdoor-trust", "title": "Role trust policy changed to add external principal",
     "attack": "T1098.003", "confidence": 0.85, "level": "high",
     "detection": {"selection": {"event": ["UpdateAssumeRolePolicy", "CreateRole"],
                                 "derived.external_trust_added": True},
                   "condition": "selection"},
     "falsepositives": ["Sanctioned cross-account trust to a known partner account (use an allowlist)"]},
]

# --- fixed values: detectors outside the rule files: key -> (title, layer, techniques, notes) ---
DETECTORS = {
    "bhv-new-geo": ("Principal active from new geography", "behavioural", ["T1078.004"],
                    ["Travel / VPN / new office location"]),
    "bhv-automation-iam-write": ("Automation principal performed an IAM write", "behavioural", ["T1098"],
                                 ["A CI/CD role that legitimately manages IAM (scope it out)"]),
    "bhv-impossible-travel": ("Impossible travel for principal", "behavioural", ["T1078"],
                              ["VPN / proxy egress hopping between regions"]),
    "bhv-enumeration-burst": ("Enumeration / discovery burst", "behavioural", ["T1580"],
                              ["Inventory tools / CSPM scanners / the console"]),
    "m8-least-privilege-unused": ("Granted permissions unused in CloudTrail lookback", "behavioural", ["T1548"],
                                  ["Break-glass or disaster-recovery permissions may be intentionally dormant",
                                   "CloudTrail data events may be disabled or the lookback may be incomplete",
                                   "Seasonal/month-end jobs can be inactive during a short lookback"]),
    "m8-new-privesc-path": ("New IAM privilege-escalation path created", "correlation", ["T1548"],
                            ["Approved IAM rollout or new workload role may intentionally create a path",
                             "Snapshot incompleteness can make an old path appear newly created",
                             "Condition-dependent edges need request-context validation before response"]),
    "m8-backdoor-trust-policy": ("Role trust policy weakened or opened externally", "signature", ["T1098"],
                                 ["Approved cross-account access for a known partner/vendor",
                                  "Federation patterns can intentionally trust another account with strong conditions",
                                  "Condition changes during IAM refactoring may preserve equivalent controls elsewhere"]),
    "m8-s3-sensitive-public-access": ("Sensitive S3 bucket public-access controls weakened", "signature", ["T1537"],
                                      ["Intentional public dataset/static-site publication",
                                       "A compensating bucket policy/control may still prevent anonymous reads"]),
    "m8-s3-exfil-anomaly": ("S3 access deviates from principal exfiltration baseline", "behavioural",
                            ["T1530", "T1537"],
                            ["Backups, analytics exports, incident-response collection and migrations can spike volume",
                             "Failover/DR or newly enabled AWS regions can create legitimate cross-region reads",
                             "Byte-volume detection depends on enriched object-size/transfer telemetry"]),
}

# --- fixed values: escalation techniques: key -> (label, target, attack id) ---
ESCALATIONS = {
    "CreatePolicyVersion": ("Set a new default version of an attached policy", "admin", "T1098.003"),
    "AttachUserPolicy": ("Attach AdministratorAccess to self (user)", "admin", "T1098.003"),
    "PutUserPolicy": ("Inline an admin policy on self (user)", "admin", "T1098.003"),
    "AttachRolePolicy": ("Attach AdministratorAccess to self (role)", "admin", "T1098.003"),
    "PutRolePolicy": ("Inline an admin policy on self (role)", "admin", "T1098.003"),
    "PassRole:lambda": ("PassRole a privileged role to a new Lambda function", "role", "T1548"),
    "PassRole:ec2": ("PassRole a privileged role to a new EC2 instance", "role", "T1548"),
    "AssumeRole": ("Assume a more-privileged role", "role", "T1548"),
}
# --- fixed values: escalation by own rights: principal type -> (action probed on itself, technique) ---
SELF_GRANTS = {
    "user": [("iam:AttachUserPolicy", "AttachUserPolicy"), ("iam:PutUserPolicy", "PutUserPolicy")],
    "role": [("iam:AttachRolePolicy", "AttachRolePolicy"), ("iam:PutRolePolicy", "PutRolePolicy")],
}
# --- fixed values: escalation by launching: technique -> (launch action, service that must be trusted) ---
LAUNCHES = {
    "PassRole:lambda": ("lambda:CreateFunction", "lambda.amazonaws.com"),
    "PassRole:ec2": ("ec2:RunInstances", "ec2.amazonaws.com"),
}

# --- fixed values: response actions: key -> (title, impact, scope, reversible, always_human) ---
ACTIONS = {
    "deactivate-access-key": ("Deactivate access key", "low", "principal", True, False),
    "quarantine-principal": ("Quarantine principal (explicit deny)", "high", "principal", True, True),
    "revoke-sessions": ("Revoke active sessions", "medium", "principal", True, True),
    "isolate-instance": ("Isolate EC2 instance (quarantine SG)", "high", "resource", True, True),
    "re-enable-logging": ("Re-enable CloudTrail logging", "medium", "account", True, True),
    "snapshot-forensics": ("Snapshot volume for forensics", "low", "resource", True, True),
}
# --- fixed values: technique ids that propose a response ---
KEY_ABUSE = ["T1548", "T1078", "T1078.004"]
SELF_ESCALATION = ["T1098", "T1098.001", "T1098.003"]

# --- fixed values: shipped playbooks ---
PLAYBOOKS = [
    {"id": "PB-IAM-001", "version": "1.0.0", "title": "Compromised IAM principal containment",
     "detection_types": ["iam-create-access-key", "iam-policy-change", "ct-update-assume-role-policy",
                         "least-privilege-unused-permission", "new-privesc-path"],
     "attack_ids": ["T1098", "T1098.001", "T1098.003", "T1548"],
     "action_names": ["deactivate-access-key", "quarantine-principal", "revoke-sessions"],
     "steps": ["Preserve relevant CloudTrail event ids and IAM graph paths.",
               "Validate whether credential or policy changes were authorised.",
               "Contain the affected principal using the approved response action.",
               "Recompute effective permissions and privilege-escalation paths after containment."]},
    {"id": "PB-LOG-001", "version": "1.0.0", "title": "CloudTrail logging tampering response",
     "detection_types": ["ct-stop-logging", "ct-delete-trail", "logging-tampering"],
     "attack_ids": ["T1562.008"], "action_names": ["re-enable-logging"],
     "steps": ["Preserve the tampering event and actor identity.",
               "Verify trail configuration and organisation-level logging state.",
               "Re-enable logging through the approved human-gated action.",
               "Review activity during the visibility gap."]},
    {"id": "PB-S3-001", "version": "1.0.0", "title": "S3 data access and exfiltration triage",
     "detection_types": ["s3-volume-anomaly", "s3-cross-region-access", "s3-sensitive-public-access"],
     "attack_ids": ["T1530", "T1537"], "action_names": ["quarantine-principal"],
     "steps": ["Preserve GetObject event ids, byte counts, regions, and bucket identifiers.",
               "Compare observed access with the principal baseline and approved workloads.",
               "Validate sensitive-bucket public access configuration changes.",
               "Contain the principal if the activity is unauthorised."]},
]

# --- fixed values: text patterns of the grounding audit ---
REF_PATTERN = r"\[\[ref:([^\]]+)\]\]"
ARN_PATTERN = r"\barn:aws(?:-[a-z0-9-]+)?:[A-Za-z0-9_./:=+@,-]+"
S3_URI_PATTERN = r"\bs3://[A-Za-z0-9][A-Za-z0-9._-]{1,62}(?:/[A-Za-z0-9._~!$&'()*+,;=:@%/-]*)?"
API_PATTERN = r"\b(?:Get|Put|List|Create|Delete|Update|Assume|Stop|Start|Describe|Attach|Detach|Pass|Revoke|Terminate|Disable|Enable|Set|Modify|Add|Remove|Tag|Untag|Copy|Head|Batch|Invoke)[A-Z][A-Za-z0-9]+\b"
DIRECTIVE_PATTERN = r"(?i)(?:^|[.!?]\s+)(?:please\s+)?(?:run|execute|delete|disable|enable|revoke|rotate|terminate|block|isolate|attach|detach|create|update|put|remove|stop|start|assume|modify|set|add|copy|invoke|remediate)\b"
# a sentence starts a segment; anchoring it there keeps the search linear on long lines
SENTENCE_PATTERN = r"(?<![^\n.!?])[^\n.!?]++(?:[.!?](?=\s|$)|$)"
