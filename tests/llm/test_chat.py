import hashlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ticketveil.llm import chat

CONTROL = ["</s>", "[INST]", "[/INST]", "<|user|>\n", "\\", "\\l", "<", "|", "\n", "ok", "é", "😀", ""]
text = st.one_of(st.text(max_size=12), st.lists(st.sampled_from(CONTROL), max_size=6).map("".join))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(text, text), min_size=1, max_size=6))
def test_parse_is_the_inverse(turns):
    turns = [(a.encode("utf-8", "replace"), b.encode("utf-8", "replace")) for a, b in turns]
    data, at, spans = chat.assemble(pa.array([a for a, _ in turns], pa.binary()), pa.array([b for _, b in turns], pa.binary()))
    whole = data.tobytes()
    assert chat.parse(whole) == turns
    assert [chat.unescape(whole[a:b]) for a, b in spans] == [b for _, b in turns]
    assert whole.count(b"</s>") == len(turns) and b"[" not in whole and at[-1] == len(whole)


def brute(rows):
    by = {}
    for conv, turn, role, said in rows:
        key = (turn is not None, turn or 0, (role or "").encode(), (said or "").encode())
        by.setdefault(conv, []).append((key, (role or "").encode(), (said or "").encode()))
    out = {}
    for conv, turns in by.items():
        turns = [t[1:] for t in sorted(turns)]
        loss = b"".join(t for r, t in turns if r == b"assistant")
        out[conv] = (
            len(turns),
            hashlib.sha256(b"".join(b"%s\n%s\n" % t for t in turns)).hexdigest(),
            len(loss.decode()),
            hashlib.sha256(loss).hexdigest(),
        )
    return out


ROWS = [
    (1, 1, "assistant", "two </s>"), (1, 0, "user", "one"), (2, 0, "system", None), (2, 1, None, "x"), (None, 0, "user", "n"),
    (3, 0, "user", "a"), (3, 0, "user", "a"), (3, None, "assistant", "first"), (3, 2, "assistant", "[INST]" * 3000),
    (4, 0, "assistant", ""), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"),
] + [(100 + i, t, ("user", "assistant")[t % 2], f"{i} {t} <b>") for i in range(40) for t in range(i % 5 + 1)]


def test_tables(spark):
    df = spark.createDataFrame([(*r, "e", 1) for r in ROWS], "conv_id long, turn long, role string, text string, conv string, loss int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("10000", "3", "1"):  # conversations within and across batches
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_conversations(df)).collect()}
            assert got == brute(ROWS)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_escape_of_a_sliced_column():
    column = pa.array([b"a<", b"[", b"", b"\\x"], pa.binary()).slice(1)
    data, at = chat.escaped(*chat._buffer(column))
    assert data.tobytes() == b"\\b\\\\x" and np.array_equal(at, [0, 2, 2, 5])
