"""Steps that read less of a text or make it once, against the plain way."""

import random
import time

from pyspark.sql import functions as F

from catalog import audits
from ticketveil.functions import lines as L
from ticketveil.functions import parts as C
from ticketveil.functions import patterns as P
from ticketveil.functions import redaction as R
from ticketveil.functions import tickets as K
from ticketveil.functions.text import line_array, strip
from ticketveil.operators import issues as I
from ticketveil.operators import parts as O
from ticketveil.plans import stored
from ticketveil.plans.stored import CLEANUP

PIECES = [
    "a.b@x.org", "é.b@x.com", "ü@ü.de", "@", "a@b.c|", "a@b.cd|e", "%x@y.zz", "word", "你好", "\U0001f600", "\n", "\n", "\r\n", " ", " ", " ",
    ".", "-", "|", "6-", "#", "\x01", "EVE12345678", "5551234567", "555-123-4567", "(555) 123 4567", "1 555 765 4321", "Label: v", " Pending :  x", "x: ", ":", "a:b:c", "1a: x",
    "\x85k: v", "k : v", "#a: b", "Close Notes:　", "and a long line of small letters to end\nA", "\nb: ",
]


def documents(spark, seed=5, n=3000):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choices(PIECES, k=rng.randrange(1, 25)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, ""), (n + 1, None)], "id long, t string").repartition(4)


def test_emails_by_line(spark):
    t, pattern = F.col("t"), F.lit(P.EMAIL)
    found = documents(spark).select(
        R.find_emails(t).alias("hits"), F.coalesce(F.regexp_extract_all(t, pattern, F.lit(0)), F.array()).alias("all"),
        R.plain_stage(t, "email_addresses").alias("s"), F.regexp_replace(t, P.EMAIL, "[REDACTED EMAIL]").alias("text"),
    )
    wrong = (F.col("hits") != F.col("all")) | ~F.col("s.text").eqNullSafe(F.col("text")) | (F.col("s.n") != F.size("all"))
    assert found.filter(wrong).isEmpty() and found.filter(F.size("hits") > 1).count() > 100


def test_heads_of_parts(spark):
    for cut in (C.LINE_CUT, C.REDACTION_CUT):
        parts = documents(spark, 8).select("id", F.lit(3).alias("part"), F.col("t").alias("text"))
        halves = F.split(F.coalesce("text", F.lit("")), cut, 2)
        plain = parts.select("id", F.posexplode(halves).alias("k", "text")).select("id", F.when(F.col("k") > 0, 3).otherwise(-1).alias("segment"), "text")
        found = O.segments(parts, cut, "id", "part", "text")
        assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty() and plain.filter("segment = 3").count() > 0


def test_text_before_a_number(spark):
    def plain(turns, i):
        return F.right(F.array_join(F.slice(turns, 1, i), ""), F.lit(P.PHONE_CONTEXT_CHARS))

    turns = documents(spark, 6).filter("t is not null").select(R.split_at(F.col("t"), P.PHONE).alias("turns"))
    numbers = turns.select("turns", F.posexplode("turns").alias("i", "hit")).filter("i % 2 = 1")
    pairs = numbers.select(R.text_before(F.col("turns"), F.col("i")).alias("a"), plain(F.col("turns"), F.col("i")).alias("b"))
    assert pairs.filter("a <> b").isEmpty() and pairs.count() > 1000


def test_fields_by_first_colon(spark):
    def parse(line, i):
        label = F.regexp_extract(strip(line), K.FIELD_LABEL, 1)
        value = strip(F.substr(strip(line), F.length(label) + 2))
        return F.struct(i.alias("line_no"), F.lower(strip(label)).alias("field"), value.alias("value"))

    plain = F.filter(F.transform(line_array(F.col("t")), parse), lambda f: f["field"] != "")
    both = documents(spark, 7).select(K.fields(F.col("t")).alias("a"), plain.alias("b"))
    assert both.filter(~F.col("a").eqNullSafe(F.col("b"))).isEmpty() and both.filter(F.size("a") > 1).count() > 100


def test_values_are_made_once(spark):
    """The value is made once for the blocks' ends and for the rows before each row."""
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    rows = spark.range(5000).select(F.lit(1).alias("doc"), F.col("id").alias("part"), F.udf(seen, "long")("id").alias("v"))
    before = {r.part: r.previous for r in O.previous(rows, "doc", "part", "v").collect()}
    assert before == {i: i - 1 if i else None for i in range(5000)} and made.value == 5000


def test_history_is_parsed_once(spark, data_dir, monkeypatch):
    """Each run of the history had parsed the reports anew, twice."""
    append, read = audits.append_history, []
    monkeypatch.setattr(audits, "append_history", lambda rows, *to: (read.extend(rows.inputFiles()), append(rows, *to)))
    assert audits.history_round_trip(spark, data_dir).count() > 0
    assert read and all("/rows-" in f for f in read)


def test_a_phrase_of_many_issues_is_looked_up_once(spark, tmp_path):
    """Equal reports are counted where they are found, and words have their phrases without the issues."""
    kept = []

    def store(df):
        kept.append(df.columns)
        df.write.parquet(f"{tmp_path}/{len(kept)}")
        return spark.read.parquet(f"{tmp_path}/{len(kept)}")

    files = spark.createDataFrame([("success", "❌ time worked lost")] * 3 + [("success", "not owner set"), ("success", "owner set")], "status string, audit_report string")
    issues = spark.createDataFrame([(i, f"i{i}", p) for i in range(4) for p in ("Time worked", "owner", "lost")], "position int, issue string, phrase string")
    found = {r.position: (r.issue, r.reports, r.n) for r in I.issue_counts(files, issues, store).collect()}
    assert found == {i: (f"i{i}", 4, 5) for i in range(4)}
    assert {"id", "copies", "low", "failing"} in map(set, kept) and ["word", "phrase"] in kept


WORDS_AND_LABELS = [
    *P.FIELD_LABELS, *P.BREAK_WORDS, *P.BREAK_WORDS, "The", "AND", *P.RATINGS, *P.TRUTHS, P.ENGINEER, P.NETWORK, P.CLOSED_VALUE, P.OPEN_VALUE,
    "John Smith", "2 - High", "٣ -Low", "xthe", "é", ":", "Urgency", "category:", "\U0001f600",
]
SPACES_BETWEEN = [" ", " ", " ", "  ", "\n", "\t", "\r\n", " \n ", " ", " ", "\x1f", ""]


def labelled(spark, n=4000):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice(WORDS_AND_LABELS) + rng.choice(SPACES_BETWEEN) for _ in range(rng.randrange(1, 12)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, ""), (n + 1, None), (n + 2, ":")], "id long, t string").repartition(4)


def analyzed(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_labels_by_pieces_between_colons(spark):
    """As searches of the whole text, one rule after the other; only pieces that end like a label are searched."""

    def plain(t):
        word = rf"(?<={P.NO_WORD_BEFORE}(?i:{P.any_of(P.BREAK_WORDS)}){P.SPACE})"
        t = F.regexp_replace(t, rf"{P.SPACE}{word}{P.SPACE}*({P.any_of(P.FIELD_LABELS)})", "\n$1")
        pair, rating = r"[A-Z][a-z]+ [A-Z][a-z]+", rf"{P.DIGIT}{P.SPACE}{{0,9}}-{P.SPACE}{{0,9}}(?:{'|'.join(P.RATINGS)})"
        ends = ("|".join(P.RATINGS), P.CLOSED_VALUE, rating, f"{P.ENGINEER}|{pair}", "|".join(P.TRUTHS), f"{P.NETWORK}|{pair}")
        for (kind, label), end in zip(P.VALUE_LABEL_RULES, ends, strict=True):
            if kind == "company":
                t = F.regexp_replace(t, rf"({P.OPEN_VALUE}[^:]*){P.SPACE}{label}", f"$1\n{label}")
            end = end.replace("[a-z]+ [A-Z][a-z]+", "[a-z]{1,15} [A-Z][a-z]{1,15}")
            t = F.regexp_replace(t, rf"(?<={end}){P.SPACE}+{label}", f"\n{label}")
        return t

    t = F.col("t")
    both = labelled(spark).select("t", L.break_labels(t).alias("a"), L.break_value_label(L.break_before_labels(t)).alias("b"), plain(t).alias("c"))
    assert both.filter("not (a <=> b) or not (a <=> c)").isEmpty() and both.filter("a <> t").count() > 500
    assert analyzed(labelled(spark).select(L.break_labels(t))).count("split(") <= 2  # once, and in a name


def test_mark_is_looked_for_once(spark):
    t = F.col("t")
    assert analyzed(documents(spark).select(R.redact(t))).count(f", {P.MARK})") <= 2  # once, and in a name
    chained = documents(spark).select(R.redact(t).alias("r"), L.break_labels(t).alias("x"))
    for kind in P.KINDS:
        chained = chained.withColumn("x", R.redact_one(F.col("x"), kind))
    assert chained.filter("not (x <=> r.redacted_text)").isEmpty() and chained.filter(F.col("x").contains(P.MARK)).count() > 100


def test_lines_are_judged_at_their_start(spark):
    """A pattern is held against the start of a line only, and white space is cut off where the line is appended."""
    t = F.col("t")
    lines = documents(spark, 11).unionByName(labelled(spark)).select(F.explode(line_array(t)).alias("t"))
    for pattern in (P.LABEL_LINE, P.TABLE_ROW_LINE):
        both = lines.select(L._starts_with(t, pattern).alias("a"), strip(t).rlike(pattern).alias("b"))
        assert both.filter("a <> b").isEmpty() and both.filter("a").count() > 50
    assert "RLIKE" not in analyzed(lines.select(L.join_wrapped_lines(t)))


def test_terms_without_searches(spark):
    rng = random.Random(12)
    words = ["Vmware", "Testing", "Ment", "Inc", "Since", "Smith", "Swift", "Logy", "Manager", "Appliance", "Delaware", "North", "Ubuntu", "Boats", "Mentor"]
    names = spark.createDataFrame([(rng.choice(words) + rng.choice([" ", "\n", " "]) + rng.choice(words),) for _ in range(400)], "t string")
    t = F.col("t")
    marks, endings = "|".join(P.TECHNICAL_MARKS), "|".join(P.BUSINESS_ENDINGS)
    none = R.PreserveTerms((), ())
    both = names.select(R.preserve_term(t, none).alias("a"), (t.rlike(f"(?i)(?:{marks})") | t.rlike(rf"(?:{endings})\z")).alias("b"))
    assert both.filter("a <> b").isEmpty() and both.filter("a").count() > 50 and both.filter("not a").count() > 50
    assert "RLIKE" not in analyzed(names.select(R.preserve_term(t, none)))


def test_stored_steps_leave_no_shuffles(spark, tmp_path):
    """The shuffle files of a stored step go when it is written, and the setting is as before."""

    def shuffles():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get(CLEANUP)
    rows = spark.range(50_000).selectExpr("id % 1000 AS k", "cast(id AS string) AS t").groupBy("k").agg(F.collect_list("t").alias("t"))
    found = stored(rows, "step", str(tmp_path))
    until = time.time() + 10
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get(CLEANUP) == setting
    assert found.count() == 1000 and all(".zstd." in f for f in found.inputFiles())
