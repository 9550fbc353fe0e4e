"""Values that results must agree on. All of them are defaults of arguments.

Fixed values: names, thresholds, patterns and texts below are part of the output.
"""

from __future__ import annotations

# ---- fixed values: columns kept whatever their fill rate ----
REQUIRED_COLUMNS = (
    "eventTime",
    "eventName",
    "eventSource",
    "eventType",
    "sourceIPAddress",
    "userAgent",
    "awsRegion",
    "requestID",
    "errorCode",
    "errorMessage",
    "userIdentity.type",
    "userIdentity.userName",
    "userIdentity.arn",
    "userIdentity.invokedBy",
    "userIdentity.accountId",
    "requestParameters.bucketName",
    "requestParameters.roleName",
    "requestParameters.userName",
    "requestParameters.keyId",
)
FILL_THRESHOLD = 0.05

# ---- fixed values: columns whose lists stay as they are ----
KEEP_LIST_COLUMNS = ("userAgent", "resources", "eventTime")

# ---- fixed values: sessions, splits, noise ----
SESSION_KEYS = ("sourceIPAddress", "userIdentity.arn")
TRAIN_TYPE = "Root"
TEST_TYPE = "AssumedRole"
TEST_USER_NAMES = ("backup", "Level6")
NOISE_USER_AGENTS = ("CloudMapper", "boto3")
NOISE_INVOKED_BY = ("amazonaws.com",)
NULL_TEXT = "None"
UNKNOWN_SESSION = "unknown"
MISSING_CONTEXT = "N/A"

# ---- fixed values: masks, applied in this order ----
WILDCARD = "<*>"
MASK_PATTERNS = (
    r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",
    r"arn:aws:[a-zA-Z0-9\-]+::[0-9]+:[a-zA-Z0-9/\-_:]+",
    r"AKIA[0-9A-Z]{16}",
    r"AIDA[0-9A-Z]{16}",
    r"AROA[0-9A-Z]{16}",
    r"ASIA[0-9A-Z]{16}",
    r"\b[0-9a-fA-F]{12,}\b",
    r"\b0x[0-9a-fA-F]+\b",
    r"\b\d+\.\d+\.\d+\b",
    r"\b\d+\b",
)
# a text without the literal cannot match the pattern of the same place
MASK_LITERALS = (".", "-", "arn:aws:", "AKIA", "AIDA", "AROA", "ASIA", "", "0x", ".", "")

# ---- fixed values: template mining and next-key model ----
DEPTH = 4
SIMILARITY = 0.4
MAX_CHILDREN = 100
WINDOW_WIDTH = 10
TOP_K = 9

# ---- fixed values: severity by flagged share, first match wins ----
SEVERITY_RULES = (
    ("High", 30, "{ratio} of session events are anomalous, indicating a sustained deviation from normal behaviour."),
    ("Medium", 15, "{ratio} anomaly ratio suggests intermittent suspicious activity within an otherwise normal session."),
)
SEVERITY_DEFAULT = ("Low", "Only {ratio} of events are anomalous; this may be benign but warrants monitoring.")

# ---- fixed values: attack patterns by event name, first match wins ----
ATTACK_RULES = (
    (
        ("createuser", "attachuserpolicy"),
        "MITRE ATT&CK: T1136 (Create Account), T1098 (Account Manipulation) — Privilege Escalation / Persistence.",
    ),
    (
        ("putbucketpolicy", "putobject"),
        "MITRE ATT&CK: T1530 (Data from Cloud Storage Object) — Data Exfiltration / Resource Manipulation.",
    ),
    (
        ("assumerole", "getcalleridentity"),
        "MITRE ATT&CK: T1550.001 (Use Alternate Authentication Material: Application Access Token) — Lateral Movement.",
    ),
)
ATTACK_DEFAULT = "No direct MITRE ATT&CK mapping identified from event names alone.  Manual review recommended."

# ---- fixed values: texts of prompt and report ----
NO_EVENTS_TEXT = "  No detailed event data available."
RULE_LINE = "=" * 72
SYSTEM_TEXT = (
    "You are a senior AWS Cloud Security Analyst performing autonomous "
    "incident response.  A DeepLog LSTM anomaly-detection model has flagged "
    "the following CloudTrail events as statistically anomalous — their "
    "log-key transitions deviate from the learned normal baseline.\n\n"
    "Analyse the flagged events and produce a structured incident report "
    "with EXACTLY the following five sections:\n\n"
    "1. **Incident Summary** — 1–2 sentences describing the overall incident.\n"
    "2. **Anomaly Analysis** — For each flagged event, explain why it is "
    "suspicious in the context of AWS security.\n"
    "3. **Severity Assessment** — Rate as Critical / High / Medium / Low "
    "with a brief justification.\n"
    "4. **Attack Pattern Classification** — Map to MITRE ATT&CK tactics "
    "and techniques where applicable.\n"
    "5. **Recommended Mitigation** — Numbered, actionable remediation steps "
    "an incident responder should execute immediately.\n\n"
    "Be concise, precise, and actionable.  Do not speculate beyond what the "
    "evidence supports."
)
PROMPT_OPEN = "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n"
PROMPT_USER = "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n"
PROMPT_CLOSE = "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"
SUMMARY_TEXT = (
    "DeepLog flagged {n} anomalous event(s) in session {session}.  The flagged actions deviate from the "
    "normal CloudTrail activity baseline learned during training."
)
EVENT_NOTE = (
    "This event deviates from the learned normal sequence pattern and was not predicted by the DeepLog model."
)
MITIGATION_TEXT = (
    "1. Immediately review the IAM activity for the affected identities.\n"
    "2. Rotate credentials for any compromised access keys.\n"
    "3. Enable CloudTrail log-file validation if not already active.\n"
    "4. Restrict overly permissive IAM policies identified in the flagged events.\n"
    "5. Escalate to the security operations team for deeper forensic investigation."
)
CLOSING_TEXT = "---\n[MOCK MODE — This report was generated without Llama-3 inference]"
SECTION_TITLES = (
    "## 1. Incident Summary",
    "## 2. Anomaly Analysis",
    "## 3. Severity Assessment",
    "## 4. Attack Pattern Classification",
    "## 5. Recommended Mitigation",
)
