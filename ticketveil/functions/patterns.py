"""Patterns, placeholders, labels and word lists.

Everything here has to stay as it is for results to be right. Patterns are Java
regular expressions. Text is judged by Unicode rules, so white space, word characters and
digits are classes of their own (Java's ``\\s``, ``\\w`` and ``\\d`` are ASCII only), and a word
boundary is a look-around on ``WORD`` (its meaning does not change with the Java version).
Classes name their most frequent part first, which is tested first.
"""

from dataclasses import dataclass

SPACE_SET = r"\t-\r\x1c-\x20\x85\p{Z}"
SPACE = f"[{SPACE_SET}]"
NOT_SPACE = f"[^{SPACE_SET}]"
WORD = r"[\w\p{L}\p{N}]"
DIGIT = r"\p{Nd}"
NO_WORD_BEFORE = f"(?<!{WORD})"
NO_WORD_AFTER = f"(?!{WORD})"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"
RARE_LINE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

# The same set as characters, for trimming.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# White space inside a line.
INLINE_SPACE = r"[\t\x0B-\r\x1c-\x20\x85\p{Z}]"

# --- fixed values: redaction patterns ---------------------------------------------------
# A boundary in front of a match is tested after its first character (a look-behind over two
# characters): most positions then fail on that character alone.
IP_ADDRESS = (
    rf"{DIGIT}(?<!{WORD}.){DIGIT}{{0,2}}\.(?:{DIGIT}{{1,3}}\.){{2}}{DIGIT}{{1,3}}{NO_WORD_AFTER}"
)
PRIVATE_IP = r"^(?:0?10\.|172\.0?(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.)"
MAC_ADDRESS = r"\p{XDigit}{2}[:-](?:\p{XDigit}{2}[:-]){4}\p{XDigit}{2}"
PHONE = (
    rf"(?=[+(0-9])(?:\+?1[-.{SPACE_SET}]?)?\(?[0-9]{{3}}\)?[-.{SPACE_SET}]?[0-9]{{3}}"
    rf"[-.{SPACE_SET}]?[0-9]{{4}}{NO_WORD_AFTER}"
)
EMAIL = (
    rf"(?:\w(?<!{WORD}.)|[.%+-](?<={WORD}.))[\w.%+-]*+"
    rf"@[\p{{Alnum}}.-]+\.[\p{{Alpha}}|]{{2,}}"
    rf"(?:(?<=\p{{Alpha}}){NO_WORD_AFTER}|(?<=\|)(?={WORD}))"
)
EMPLOYEE_ID = rf"EVE{DIGIT}{{8}}"
IMEI = rf"IMEI[#{SPACE_SET}]*{DIGIT}+"
ACCOUNT = rf"Account{SPACE}+{DIGIT}{{8,}}(?:-{DIGIT}+)?"
URL = rf"https?://{NOT_SPACE}+"
# A pattern that begins with four letters or more outside of a group is looked for by skips.
RUN_BY = rf"Run ([Bb]y{SPACE}*:{SPACE}*)[^\n]+"
NAME = rf"[A-Z](?<!{WORD}.)[a-z]+{SPACE}+[A-Z][a-z]+{NO_WORD_AFTER}"

# Put around matches where a text is cut at them; texts hardly ever hold it.
MARK = "\x01"


@dataclass(frozen=True)
class Part:
    """Pattern that every match of a rule contains and that is quick to look for."""

    pattern: str


MAC_PART = Part(r"[:-]\p{XDigit}{2}[:-]\p{XDigit}{2}[:-]")
PHONE_PART = Part(rf"[0-9]{{3}}\)?[-.{SPACE_SET}]?[0-9]{{3}}[-.{SPACE_SET}]?[0-9]{{4}}")

# Context that turns a phone-like match into a reference number.
PHONE_CONTEXT_CHARS = 15
CASE_MARK = "#"
CASE_PREFIX = "6-"
TEN_DIGITS = r"^[0-9]{10}\z"

# Kinds in the order the stages run; the total is the sum of these ten.
KINDS = (
    "ip_addresses",
    "mac_addresses",
    "phone_numbers",
    "email_addresses",
    "employee_ids",
    "imei_numbers",
    "account_numbers",
    "urls",
    "run_by_fields",
    "names_truncated",
)

# Kinds shown together as "other" in a summary.
OTHER_KINDS = ("mac_addresses", "employee_ids", "account_numbers", "imei_numbers")

# kind: (pattern, replacement, literal or pattern that every match contains)
PLAIN_RULES = {
    "mac_addresses": (MAC_ADDRESS, "[REDACTED MAC]", MAC_PART),
    "email_addresses": (EMAIL, "[REDACTED EMAIL]", "@"),
    "employee_ids": (EMPLOYEE_ID, "[REDACTED EMPLOYEE ID]", "EVE"),
    "imei_numbers": (IMEI, "IMEI#[REDACTED]", "IMEI"),
    "account_numbers": (ACCOUNT, "Account [REDACTED]", "Account"),
    "urls": (URL, "[REDACTED URL]", "://"),
    "run_by_fields": (RUN_BY, "Run $1[REDACTED]", "Run "),
}
IP_PLACEHOLDER = "[REDACTED IP]"
PHONE_PLACEHOLDER = "[REDACTED PHONE]"
# Address beginnings left out of the address count (wider than the ranges that are kept).
IP_UNCOUNTED_PREFIXES = ("10.", "172.", "192.168.")

# --- fixed values: words that mark a capitalised pair as something other than a person ----
# General service-desk vocabulary.
PRESERVE_WORDS = (
    # places and premises
    "eastern western northern southern central employee human resources "
    "datacenter promotions spare production "
    # business and service
    "security service management client customer activity change request access event status "
    "pending hold time integration monitoring network device system server router firewall "
    "configuration automation logic center communications manager instance compute storage "
    "floor monitor unavailable offline online "
    "services offering category subcategory carrier vendor circuit wireless start "
    # time and process
    "daylight standard mountain pacific atlantic worked notes steps team group resolution "
    "escalation priority impact urgency assignment billing reporting entitlement date run "
    "opened closed updated created resolved assigned caller contact description summary "
    "comments worknotes private public minutes seconds hours days weeks months years elapsed "
    "percentage achieved cancelled breached threshold alert level "
    # ticket states
    "progress new draft review rejected processing complete failed success waiting active "
    "inactive enabled disabled available maintenance operational critical high medium low "
    "informational warning error debug trace verbose quiet silent "
    # technical
    "resource ethernet fabric virtual backup restore patch managed collaboration engineer "
    "hypervisor cluster domain controller console terminal shell registry daemon process "
    "thread memory disk interface port protocol "
    # monitoring
    "notification baseline metric dashboard report analytics statistics performance "
    "utilization capacity availability reliability scalability compliance audit log problem "
    "release deployment rollback upgrade downgrade "
    # ticket fields
    "ticket number state reason follow business location handoff query related parent primary "
    "secondary reference"
).split()

# Names of places, companies, products and network protocols. Both lists are kept by default; a site adds its
# own as ``PreserveTerms`` (see operators.redaction.load_terms).
PRESERVE_NAMES = (
    # places and premises
    "niagara delaware melbourne presidio docklands tower wheeling downs gaming falls stadium island hotel casino "
    "racetrack banquet buffet showroom lounge giftshop sportsbook pointe restaurant "
    # systems and products
    "incident switch appliance checkpoint verizon logicmonitor unified unity vmware vcenter vmotion "
    "gewig gewiggafw gewigga gewigoamt gewigfpclus gewigagysws gewiggavrapp meraki cisco catalyst proliant "
    "nimble esxi windows linux ubuntu redhat centos microsoft intel amd hp dell itrak everi approved "
    # companies
    "companies inc corp ltd llc north comcast segra metro eline etta lopp cfw "
    # protocols and tools
    "drs ha dhcp dns ntp snmp ssh rdp vnc bash powershell cmd cpu tcp udp icmp http https ftp sftp smtp imap"
).split()

# Two-word terms that neither the words above nor the marks and endings below keep.
PRESERVE_PHRASES = (
    "delaware north",
    "niagara falls",
    "melbourne docklands",
    "wheeling downs",
    "hotel casino",
    "casino racetrack",
    "ip address",
    "mac address",
    "responsible party",
    "work in",
    "solution provided",
    "last touched",
    "gaming hotel",
    "hotel guest",
    "sports book",
    "gift shop",
    "pointe restaurant",
    "banquet comcast",
    "cloud foundations",
    "select tier",
    "quarterly true",
    "meraki portal",
    "allied servicedesk",
    "snmp configure",
    "logicmonitor backups",
)
TECHNICAL_MARKS = ("vm", "srv", "app", "db", "fw", "sw", "rtr", "ws", "inc", "gewig")
BUSINESS_ENDINGS = ("ing", "tion", "ment", "ness", "ity", "ics", "ogy")

# --- fixed values: line classes ----------------------------------------------------------
LABEL_LINE = rf"^(?:[A-Za-z0-9 \-/\(\)\[\]#>]+:|{DIGIT}+\.|[•*\-]|\[code\])"
TABLE_ROW_LINE = (
    rf"^(?:{DIGIT}+{SPACE}+(?:Minute|Hour|Day)s?"
    rf"|{DIGIT}+{SPACE}+{WORD}+{SPACE}+{DIGIT}{{4}}"
    rf"|{DIGIT}+{SPACE}*-{SPACE}*{WORD}+"
    rf"|[A-Z][a-z]+{SPACE}+[A-Z][a-z]+{SPACE}+{DIGIT}{{2,4}}"
    rf"|{DIGIT}+\.|[A-Z][a-z]+:)"
)

# Labels after which an empty line is wanted.
BREAK_AFTER_LABELS = (
    "Run By :", "Notes", "Additional comments:", "Work notes(Private):", "Resolution:", "RCA:",
    "Short description:", "Current status:", "Table name:", "Related List Title:",
    "Query Condition:", "Sort O.:", "Incident Details Page", "SLA definition", "Time worked",
    "Assignment group:", "Assigned to:", "Company:", "Location:", "Configuration item:",
    "Category:", "Subcategory:", "Application:", "Business service:", "Service offering:",
    "Contact type:", "Caller name:", "Caller email:", "Caller phone:", "Vendor:", "Carrier:",
    "Follow up by:", "Event date:", "Primary agreement:", "Pending reason:", "Handoff:",
    "Last R.:", "Last Touched:", "Service Restored:", "Alert Cleared:", "Customer:",
    "Close code:", "Cause code:", "Close notes:", "Root cause:",
)

# Labels that get a line of their own when one of BREAK_WORDS stands before them.
FIELD_LABELS = (
    "Impact:", "Urgency:", "Priority:", "Responsible party:", "Assignment group:",
    "Customer Assignment Group:", "Assigned to:", "Opened by:", "Resolved by:", "Company:",
    "Location:", "Configuration item:", "Service Offering:", "Category:", "Subcategory:",
    "Application:", "Business service:", "Service offering:", "Contact type:", "Caller name:",
    "Caller email:", "Caller phone:", "Caller:", "Vendor:", "Carrier:", "Follow up by:",
    "Event date:", "Primary agreement:", "Pending reason:", "Handoff:", "Last Reoccurrence:",
    "Last Touched:", "Sync Ticket with Customer:", "Service Restored:", "Alert Cleared:",
    "Short description:", "Notes:", "Watch list:", "Time worked:", "Customer watch list:",
    "Current status:", "Next steps:", "Additional comments:", "Close code:", "Cause code:",
    "Close notes:", "Root cause:",
)
BREAK_WORDS = (
    "high", "medium", "low", "critical", "the", "and", "or", "but", "with", "from", "to",
)

# (kind of value, label): a line break goes between value and label, in this order.
VALUE_LABEL_RULES = (
    ("rating", "Responsible party:"),
    ("company", "Urgency:"),
    ("numbered rating", "Assignment group:"),
    ("engineer or pair", "Customer Assignment Group:"),
    ("truth", "Service Offering:"),
    ("network or pair", "Category:"),
)
RATINGS = ("High", "Medium", "Low", "Critical")
TRUTHS = ("true", "false")
ENGINEER, NETWORK = "MSC Network Engineer", "Network Services"
# Of the two companies one is a value with all that follows it up to the next colon.
CLOSED_VALUE, OPEN_VALUE = "Presidio", "Delaware North"

CODE_TAG = r"\[/?code\]"
BOLD_TAG = r"</?b>"
BREAK_TAG = rf"(?i)<br{SPACE}*/?>"


def any_of(literals) -> str:
    """Alternation of literals; they hold no regex metacharacters but ``.``, ``(`` and ``)``."""
    return "|".join(
        s.replace(".", r"\.").replace("(", r"\(").replace(")", r"\)") for s in literals
    )
