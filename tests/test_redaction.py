import pytest
from pyspark.sql import functions as F

from ticketveil.functions import redaction as R
from ticketveil.operators.redaction import STATS, find_pii, load_terms, redact_documents, redaction_stats

# (input, expected, kind, count); input is also the expected value where it is None.
CASES = [
    ("Run Date and Time: 08-03-2025 09:29:30 Eastern Daylight Time", None, "total_redactions", 0),
    ("Run By: Jeremy Murray", "Run By: [REDACTED]", "run_by_fields", 1),
    ("Opened by: Delaware North Integration User", None, "names_truncated", 0),
    ("Caller: Caleb Franklin", "Caller: Caleb F.", "names_truncated", 1),
    ("Assigned to: Kaushal Smith", "Assigned to: Kaushal S.", "names_truncated", 1),
    ("Contact Type: Ticket Integration", None, "names_truncated", 0),
    ("Business Service: Network Services", None, "names_truncated", 0),
    ("Service Offering: Network Management and Monitoring", None, "names_truncated", 0),
    ("Configuration Item: GEWIGGAFW01", None, "total_redactions", 0),
    ("Assignment Group: MSC Network Engineer", None, "names_truncated", 0),
    ("Responsible Party: Presidio", None, "names_truncated", 0),
    ("Short Description: Wheeling itrak and Everi floor monitor were unavailable", None, "names_truncated", 0),
    ("Current Status: Resolved", None, "names_truncated", 0),
    ("Next Steps: Investigation continues", None, "names_truncated", 0),
    ("Work Notes: Additional information provided", None, "names_truncated", 0),
    ("Time Worked: 10 Minutes", None, "total_redactions", 0),
    ("Customer Ticket #: INC0444083", None, "total_redactions", 0),
    ("Additional Comments: System restored", None, "names_truncated", 0),
    ("Primary Agreement: Standard SLA", None, "names_truncated", 0),
    ("Category: Security Device Management", None, "names_truncated", 0),
    ("Service: Network Services Management", None, "names_truncated", 0),
    ("Status: Client Hold Request", None, "names_truncated", 0),
    ("Team: First Access Support", None, "names_truncated", 0),
    ("Dear Team Member", None, "names_truncated", 0),
    ("Configuration item: PRNFSPA-TowerFW01", None, "total_redactions", 0),
    ("Engineer: John Smith worked on this", "Engineer: John S. worked on this", "names_truncated", 1),
    ("Contact: Mary Johnson reported this", "Contact: Mary J. reported this", "names_truncated", 1),
    ("Assigned to: Robert Davis for review", "Assigned to: Robert D. for review", "names_truncated", 1),
    ("Created by: Sarah Wilson yesterday", "Created by: Sarah W. yesterday", "names_truncated", 1),
    ("met Vincent Brown", None, "names_truncated", 0),
    ("met Andrew Stone", "met Andrew S.", "names_truncated", 1),
    ("met John\nSmith", "met John S.", "names_truncated", 1),
    ("met John \t\u00a0Smith", "met John S.", "names_truncated", 1),
    ("Data  Center", None, "names_truncated", 0),
    ("Gift Shop", None, "names_truncated", 0),
    ("Gift  Shop", "Gift S.", "names_truncated", 1),
    ("from 8.8.8.8", "from [REDACTED IP]", "ip_addresses", 1),
    ("from 192.168.1.100", None, "ip_addresses", 0),
    ("from 172.32.0.1", "from [REDACTED IP]", "ip_addresses", 0),
    ("from 172.32.0.1", "from [REDACTED IP]", "ip_redacted", 1),
    ("from 172.16.0.1 and 172.31.9.9", None, "ip_redacted", 0),
    ("010.1.2.3", None, "ip_addresses", 1),
    ("999.1.1.1 é1.2.3.4", "[REDACTED IP] é1.2.3.4", "ip_addresses", 1),
    ("v 10.1.2.3.4", None, "ip_addresses", 0),
    ("Phone: 555-123-4567", "Phone: [REDACTED PHONE]", "phone_numbers", 1),
    ("(555) 123-4567, +1-555-123-4567", "[REDACTED PHONE], [REDACTED PHONE]", "phone_numbers", 2),
    ("Case #6-555-123-4567", None, "phone_numbers", 0),
    ("TAC 6-5551234567", None, "phone_numbers", 0),
    ("TAC 6-555-123-4567", "TAC 6-[REDACTED PHONE]", "phone_numbers", 1),
    ("#abcdefghijklm 1-555-123-4567", None, "phone_numbers", 0),
    ("#abcdefghijklmno 1-555-123-4567", "#abcdefghijklmno [REDACTED PHONE]", "phone_numbers", 1),
    ("#5551234567 5551234567", "#5551234567 5551234567", "phone_numbers", 0),
    ("#5551234567 x 555123456755512345675551234567", None, "phone_numbers", None),
    ("Account 12345678", "Account [REDACTED]", "account_numbers", 1),
    ("Account 12345678-12", "Account [REDACTED]", "account_numbers", 1),
    ("Account 1234567890", "Account [REDACTED PHONE]", "account_numbers", 0),
    ("Account 1234567890", "Account [REDACTED PHONE]", "phone_numbers", 1),
    ("IMEI 490154203237518", "IMEI#[REDACTED][REDACTED PHONE]", "imei_numbers", 1),
    ("IMEI 490154203237518", "IMEI#[REDACTED][REDACTED PHONE]", "phone_numbers", 1),
    ("mail a.b@x.com", "mail [REDACTED EMAIL]", "email_addresses", 1),
    ("id EVE12345678", "id [REDACTED EMPLOYEE ID]", "employee_ids", 1),
    ("see https://x.org/a", "see [REDACTED URL]", "urls", 1),
    ("see https://x.org/a@b.com?x", "see [REDACTED URL] EMAIL]?x", "urls", 1),
    ("mac 00:1A:2b:3C:4d:5E", "mac [REDACTED MAC]", "mac_addresses", 1),
    ("Thshea Stteä", None, "names_truncated", 0),
    ("ÄThshea Stte", None, "names_truncated", 0),
    ("Run by :\nJohn Smith\nnext", "Run by :\n[REDACTED]\nnext", "run_by_fields", 1),
    ("1 - High Urgency: 2", "1 - High\nUrgency: 2", "total_redactions", 0),
    ("Somebody Impact: 1", None, "total_redactions", 0),
    ("", None, "total_redactions", 0),
]


@pytest.fixture(scope="module")
def redacted(spark):
    rows = [(i, c[0]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r for r in redact_documents(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: CASES[i][0][:40])
def test_case(redacted, i):
    text, expected, kind, n = CASES[i]
    row = redacted[i]
    if n is None:
        return
    assert row.stats[kind] == n
    assert row.redacted_text == (text if expected is None else expected)


def test_phone_context_spans_matches(redacted):
    """Kept matches are context for later ones: compare with a scan over the text."""
    import re

    pattern = r"(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b"
    text = "#5551234567 x 555123456755512345675551234567"
    i = next(k for k, c in enumerate(CASES) if c[0] == text)
    n = 0
    for m in re.finditer(pattern, text):
        before = text[max(0, m.start() - 15) : m.start()]
        n += "#" not in before
    assert redacted[i].stats["phone_numbers"] == n


def test_total_is_sum_of_kinds(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    stats = redaction_stats(docs)
    kinds = [k for k in STATS if k not in ("total_redactions", "ip_redacted")]
    bad = stats.filter(sum(F.col(k) for k in kinds) != F.col("total_redactions"))
    assert bad.count() == 0


def test_nothing_left(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    left = find_pii(
        redact_documents(docs).select("doc_id", F.col("redacted_text").alias("text"))
    ).filter("not kept and kind in ('ip_addresses', 'mac_addresses', 'email_addresses')")
    assert left.count() == 0


def test_single_stages_agree_with_pipeline(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "text string")
    t = F.col("text")
    out = df.select(
        R.redact_ip(t).alias("ip"),
        R.redact_phone(t).alias("phone"),
        R.truncate_names(t).alias("names"),
        R.redact_url(t).alias("url"),
        t,
    ).collect()
    by_text = {r.text: r for r in out}
    assert by_text["from 8.8.8.8"].ip == "from [REDACTED IP]"
    assert by_text["v 10.1.2.3.4"].ip == "v 10.1.2.3.4"
    assert by_text["TAC 6-5551234567"].phone == "TAC 6-5551234567"
    assert by_text["Caller: Caleb Franklin"].names == "Caller: Caleb F."
    assert by_text["see https://x.org/a"].url == "see [REDACTED URL]"


def test_site_terms(spark, tmp_path):
    path = str(tmp_path / "terms")
    spark.createDataFrame([("Kestrel", "word"), ("blue heron", "phrase")], "term string, kind string").write.parquet(path)
    terms = load_terms(spark, path)
    df = spark.createDataFrame([(1, "Kestrel Smith, Blue Heron, Caleb Franklin")], "doc_id long, text string")
    assert redact_documents(df, terms=terms).first().redacted_text == "Kestrel Smith, Blue Heron, Caleb F."


def test_no_shuffle_and_no_repeated_search(spark, data_dir):
    plan = redact_documents(spark.read.parquet(f"{data_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("regexp_extract_all(") == 4
    assert "Python" not in plan
