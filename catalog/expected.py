"""Values that results have to agree with, stated once more for the checks, so that a value lost in the library
turns a query or a test red. Fixed values."""

WORDS = (
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

NAMES = (
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

PHRASES = (
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

# (value, label): a line break goes between them, in this order; plain regular expressions.
VALUE_LABELS = (
    (r"High|Medium|Low|Critical", "Responsible party:"),
    (r"Presidio|Delaware North[^:]*", "Urgency:"),
    (r"\p{Nd}+\s*-\s*(?:High|Medium|Low|Critical)", "Assignment group:"),
    (r"MSC Network Engineer|[A-Z][a-z]+ [A-Z][a-z]+", "Customer Assignment Group:"),
    (r"true|false", "Service Offering:"),
    (r"Network Services|[A-Z][a-z]+ [A-Z][a-z]+", "Category:"),
)
