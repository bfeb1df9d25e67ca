"""Word lists of the domain."""

from __future__ import annotations

# Results depend on these lists being exactly so.
NETWORK_FUNCTIONS = [
    "AMF", "SMF", "UPF", "AUSF", "UDM", "UDR", "PCF", "NRF", "NSSF", "NEF",
    "CHF", "BSF", "UDSF", "SMSF", "SEPP", "SCP", "N3IWF", "TNGF", "W-AGF",
    "TWIF", "gNB", "ng-eNB", "UE", "DN", "AF", "SEAF",
]
PARAMETERS = [
    "SUCI", "SUPI", "5G-GUTI", "IMSI", "IMEI", "PEI", "TMSI", "GUTI",
    "S-NSSAI", "DNN", "PDU Session ID", "QFI", "5QI", "ARP", "AMBR",
    "Session-AMBR", "UE-AMBR", "Slice ID", "SST", "SD", "PLMN ID",
    "TAI", "CGI", "ECGI", "NCGI", "LAI", "RAI", "SAI",
]
KEYS = [
    "5G-AKA", "EAP-AKA'", "Kausf", "Kseaf", "Kamf", "Ksmf", "Kn3iwf",
    "5G HE AV", "5G AV", "RAND", "AUTN", "XRES*", "RES*", "CK", "IK",
    "Kc", "SRES", "Ks", "K_AMF", "K_gNB", "K_N3IWF", "K_UPF",
    "HXRES*", "HRES*", "KDF", "NH", "K_eNB", "K_enb*", "5G SE AV",
]
MESSAGES = [
    "Registration Request", "Registration Accept", "Registration Reject",
    "Authentication Request", "Authentication Response", "Authentication Result",
    "Security Mode Command", "Security Mode Complete", "Identity Request", "Identity Response",
    "Service Request", "Service Accept", "Service Reject",
    "PDU Session Establishment Request", "PDU Session Establishment Accept",
    "PDU Session Establishment Reject", "PDU Session Release Request",
    "UE Configuration Update Command", "UE Configuration Update Complete",
    "Nausf_UEAuthentication_Authenticate Request", "Nausf_UEAuthentication_Authenticate Response",
    "Nudm_UEAuthentication_Get Request", "Nudm_UEAuthentication_Get Response",
]
STOP_WORDS = [
    "3gpp", "to", "request", "one", "first", "second", "third", "step", "figure",
    "section", "clause", "document", "procedure", "process", "method", "example",
    "note", "editor", "shall", "should", "may", "must", "can", "will", "would",
    "could", "might", "need", "use", "used", "using", "based", "case", "cases",
    "type", "types", "value", "values", "field", "fields", "bit", "bits",
    "byte", "bytes", "length", "size", "number", "numbers", "time", "times",
    "plmn", "operator", "network", "core", "access", "service", "services",
    "information", "data", "control", "user", "plane", "interface", "protocol",
    "message", "messages", "parameter", "parameters", "identifier", "id",
    "element", "elements", "container", "list", "item", "items",
]
STOP_PHRASES = ["such as", "for example", "in this case", "as shown"]
RELATION_TYPES = ["INVOLVE", "FOLLOWED_BY", "CONTAINS", "SEND", "INVOKE", "SEND_BY", "SEND_TO", "PART_OF"]
CHECKED_RELATION_TYPES = ["INVOLVE", "FOLLOWED_BY", "CONTAINS", "INVOKE", "SEND_BY", "SEND_TO", "PART_OF"]
TITLE_WORDS = [
    "procedure", "authentication", "registration", "establishment",
    "aka", "handover", "attach", "detach", "selection", "update",
    "roaming", "breakout", "mobility", "session", "bearer", "context",
    "transfer", "allocation", "notification", "exposure", "policy",
    "control", "management", "slice", "discovery", "trigger",
    "emergency", "suspend", "resume", "connection", "modification",
    "release", "preparation", "execution", "phase", "cancel",
]
TEXT_WORDS = [
    "amf", "smf", "upf", "ausf", "udm", "udr", "pcf", "nrf",
    "ue", "gnb", "ng-ran", "enb", "mme", "sgw", "pgw", "hss",
    "nef", "nssf", "smsf", "seaf", "n3iwf", "tngf", "w-agf",
    "plmn", "snpn", "tai", "guti", "supi", "imsi", "imei",
    "pdu", "qos", "qfi", "ambr", "dnn", "s-nssai", "slice",
    "bearer", "flow", "tunnel", "session", "context", "anchor",
]
STEP_MARKS = [
    r"step\s+\d+", r"\d+\.\s+[A-Z]", r"[a-z]\)\s+[A-Z]", r"first.*?second", r"then.*?next",
    r"phase\s+\d+", r"procedure.*?follows", r"flow.*?described",
]
FIGURE_EXCLUDED = ["overview", "introduction", "background"]
PLAIN_EXCLUDED = ["overview", "general", "architecture", "introduction", "background", "summary"]
FUNCTION_PHRASES = {
    "AUTHENTICATION SERVER": "AUSF",
    "ACCESS MOBILITY MANAGEMENT": "AMF",
    "SESSION MANAGEMENT": "SMF",
    "USER PLANE": "UPF",
    "POLICY CONTROL": "PCF",
    "UNIFIED DATA MANAGEMENT": "UDM",
    "UNIFIED DATA REPOSITORY": "UDR",
    "NETWORK REPOSITORY": "NRF",
    "NETWORK SLICE SELECTION": "NSSF",
}
#: Type and surface forms of the ontology builder, in its order.
ONTOLOGY = {
    "NetworkFunction": ["AMF", "AUSF", "UDM", "UDR", "PCF", "SMF", "UPF", "NSSF", "NEF", "NRF", "SEAF"],
    "Actor": ["UE", "USIM", "ME", "gNB", "NG-RAN", "DN"],
    "Procedure": [
        "Registration procedure", "Authentication procedure", "5G AKA",
        "Security Mode Control procedure", "Initial Context Setup", "Handover", "UE Requested PDU session establishment",
        "Initiation of authentication and selection of authentication method",
    ],
    "Key": ["KAMF", "KSEAF", "KAUSF", "KGNB", "HXRES*", "XRES*", "AV", "RES*"],
    "Parameter": ["SUCI", "RAND", "AUTN", "HXRES*", "XRES*", "SUPI", "5G-GUTI", "IMSI", "IMEI"],
    "State": ["CM-IDLE", "CM-CONNECTED", "RRC_IDLE", "RRC_CONNECTED", "RRC_INACTIVE"],
}
#: Functions that the entity-recognition builder knows.
RECOGNISED_FUNCTIONS = [
    "AMF", "SMF", "UPF", "AUSF", "UDM", "UDR", "PCF", "NSSF",
    "NEF", "NRF", "SMSF", "LMF", "GMLC", "SCP", "SEPP", "NWDAF",
    "CHF", "BSF", "UDSF", "DCCF", "UCMF", "EASDF", "SEAF",
]
PAIR_TEMPLATES = [
    (r"(\w+)\s+(?:sends?|transmits?)\s+.*?\s+to\s+(\w+)", "SENDS_TO"),
    (r"(\w+)\s+(?:derives?|generates?)\s+(\w+)", "DERIVES"),
    (r"(\w+)\s+(?:contains?|includes?)\s+(\w+)", "CONTAINS"),
    (r"(\w+)\s+is\s+part\s+of\s+(\w+)", "PART_OF"),
    (r"(\w+)\s+(?:authenticates?|verifies?)\s+(\w+)", "AUTHENTICATES"),
]
TYPE_PATTERNS = [
    ("Key", r"\bK_[A-Z_]+\b"),
    ("Key", r"\b[A-Z]+\*\b"),
    ("Parameter", r"\b[A-Z]{3,6}\b(?=\s+(?:parameter|identifier|value))"),
    ("Parameter", r"\b(?:SUCI|SUPI|GUTI|IMSI|IMEI)\b"),
    ("Procedure", r"\b\w+\s+procedure\b"),
    ("Procedure", r"\b\w+\s+authentication\b"),
    ("Procedure", r"\b\w+\s+registration\b"),
    ("Message", r"\b\w+\s+(?:request|response|indication|confirm)\b"),
    ("Actor", r"\b(?:UE|gNB|ng-eNB|USIM|ME|NG-RAN|DN|AF)\b"),
]
#: Verbs and the relation that each stands for between its subject and its object.
VERB_RELATIONS = {
    "COMMUNICATES_WITH": ["send", "transmit", "receive", "forward"],
    "DERIVES": ["derive", "generate", "compute", "calculate"],
    "CONTAINS": ["contain", "include", "comprise"],
    "PARTICIPATES_IN": ["participate", "involve", "engage"],
    "AUTHENTICATES": ["authenticate", "verify", "validate"],
}
SUBJECTS = ["nsubj", "nsubjpass"]
OBJECTS = ["dobj", "pobj", "attr"]
#: A line that starts a step; words at its start, and within it, that tie it to what was said before.
STEP_STARTS = [r"^\d+[a-z]*\.\s+", r"^Step\s+\d+"]
CONNECTORS = [
    r"^(after|before|when|once|since|until|while)",
    r"^(if|unless|provided|given)",
    r"^(also|additionally|furthermore|moreover)",
    r"^(however|nevertheless|nonetheless|although)",
    r"^(this|that|these|those|such|the\s+\w+)",
]
BACK_REFERENCES = [
    r"\b(this|that|these|those|such|the\s+above|the\s+following)\b",
    r"\b(it|they|them|its|their)\b",
    r"\b(the\s+\w+\s+mentioned|as\s+described|as\s+stated)\b",
]
SEARCH_WEIGHTS = {"title": 1.7, "parent": 1.7, "description": 16.0}
# End of the fixed values.
