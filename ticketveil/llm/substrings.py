"""Long byte strings that repeat across documents are removed, found by two-stage suffix sorting.

Suffixes are sorted in groups that no match can straddle. In every window of ``length`` bytes the least hash of its
24-byte strings is the window's anchor, so equal windows have equal anchors. Windows next to each other with one anchor
are one stretch of text. Only stretches whose anchor stands in several documents are sorted; sorting brings equal
windows together, and each learns the least document that has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits, stored, utf8

#: Bytes of an anchor; bytes of texts in a block; positions that are hashed together.
GRAM, BLOCK, SLICE = 24, 4 << 20, 1 << 18
#: Anchors of a bucket that are compared together, on average.
BUCKET = 500_000
#: Bytes of stretches with one anchor that are sorted together; with more, each window is a group of its own.
CROWD = 1 << 20
#: Rows of stretches whose suffixes are sorted together, in whole anchors.
TOGETHER = 2500
#: Crowded anchors that may be broadcast, 8 bytes each. More are joined by a shuffle.
BROADCAST_ANCHORS = 100_000
#: Symbols in a word of the suffix sort: bytes from 1 on, 0 ends a stretch; nine bits each.
_WORD, _BITS = 7, 9
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_KEY = np.uint64((1 << 40) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``GRAM`` bytes."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data),), "<u8", buffer=padded, strides=(1,)) * _MIX[0]
    eight ^= eight >> np.uint64(29)
    n = len(data) - GRAM + 1
    out = eight[:n].copy()
    for at in range(8, GRAM, 8):
        out *= _MIX[1]
        out ^= eight[at : at + n]
    out *= _MIX[2]
    return out ^ (out >> np.uint64(32))


def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """Of each ``width`` hashes the place of the least, the first of equal ones."""
    value, at, covered = (hashes >> np.uint64(32)).astype(np.uint32), np.arange(len(hashes)), 1
    while covered < width:
        step = min(covered, width - covered)
        right = value[step:] < value[:-step]
        at, value = np.where(right, at[step:], at[:-step]), np.minimum(value[step:], value[:-step])
        covered += step
    return at


def stretches(data: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor hash, first and last window of each run of windows with one anchor. No window crosses an end."""
    inside = np.ones(max(len(data) - length + 1, 0), bool)
    for before in range(1, length):
        places = ends - before
        inside[places[(places >= 0) & (places < len(inside))]] = False
    for at in range(0, len(inside), SLICE):
        own = inside[at : at + SLICE]
        if not own.any():
            continue
        hashes = gram_hashes(data[at : at + len(own) + length - 1])
        anchor = _least(hashes, length - GRAM + 1)[: len(own)]
        opens = own.copy()
        opens[1:] &= (anchor[1:] != anchor[:-1]) | ~own[:-1]
        closes = own.copy()
        closes[:-1] &= opens[1:] | ~own[1:]
        first, last = np.flatnonzero(opens), np.flatnonzero(closes)
        yield hashes[anchor[first]], first + at, last + at


def two_stage_sort(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` symbols at least, and the words of ``_WORD`` symbols from each place on.

    Suffixes smaller than their successor are sorted directly, by words, ties by the next words. The others are
    induced: those that begin with c are ordered by their successors, which either begin with less and have their
    place already, or with c too and follow in rounds, one symbol of the run of c a round. ``symbols`` ends with 0.
    """
    n = len(symbols)
    words = np.zeros(n + depth + _WORD, np.uint64)
    padded = np.concatenate((symbols.astype(np.uint64), np.zeros(depth + 2 * _WORD, np.uint64)))
    for i in range(_WORD):
        words |= padded[i : i + len(words)] << np.uint64(_BITS * (_WORD - 1 - i))
    change = np.flatnonzero(symbols[1:] != symbols[:-1])
    following = np.append(change, n - 1)[np.searchsorted(change, np.arange(n))]  # the last place of each run
    smaller = symbols[np.minimum(following + 1, n - 1)] > symbols
    direct = _sort_directly(np.flatnonzero(smaller), words, depth)

    bucket = np.zeros(258, np.int64)
    np.cumsum(np.bincount(symbols, minlength=257), out=bucket[1:])
    induced = np.bincount(symbols[~smaller], minlength=257)
    order, rank = np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
    by_symbol = np.split(np.flatnonzero(~smaller)[np.argsort(symbols[~smaller], kind="stable")], np.cumsum(induced)[:-1])
    own = np.split(direct, np.cumsum(np.bincount(symbols[direct], minlength=257))[:-1])
    for c in np.flatnonzero(np.bincount(symbols, minlength=257)):
        at, members = int(bucket[c]), by_symbol[c]
        if c == 0:
            order[at : at + len(members)] = members
        else:
            round_ = members[symbols[members + 1] < c]
            round_ = round_[np.argsort(rank[round_ + 1], kind="stable")]
            while len(round_):
                order[at : at + len(round_)] = round_
                at += len(round_)
                round_ = round_[round_ > 0] - 1
                round_ = round_[symbols[round_] == c]
        order[bucket[c + 1] - len(own[c]) : bucket[c + 1]] = own[c]
        rank[order[bucket[c] : bucket[c + 1]]] = np.arange(bucket[c], bucket[c + 1])
    return order, words


def _sort_directly(suffixes: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    key = words[suffixes]
    sort = np.argsort(key, kind="stable")
    order, key = suffixes[sort], key[sort]
    if not len(order):
        return order
    group = np.cumsum(np.append(True, key[1:] != key[:-1]))
    for at in range(_WORD, depth, _WORD):
        tied = np.bincount(group)[group] > 1
        places = np.flatnonzero(tied)
        if not len(places):
            break
        key = words[order[places] + at]
        sort = np.lexsort((key, group[places]))
        order[places], key = order[places][sort], key[sort]
        apart = np.zeros(len(order), bool)
        apart[places[1:]] = key[1:] != key[:-1]
        apart[1:] |= group[1:] != group[:-1]
        group = np.cumsum(apart) + 1
    return order


def common_prefix(order: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix has its first ``length`` symbols in common with the one before; they are compared word by word."""
    same = np.zeros(len(order), bool)
    places = np.arange(1, len(order))
    for depth in range(0, length, _WORD):
        keep = min(_WORD, length - depth)
        shift = np.uint64(_BITS * (_WORD - keep))
        places = places[words[order[places] + depth] >> shift == words[order[places - 1] + depth] >> shift]
    same[places] = True
    return same


def least_holders(texts: list[bytes], holders: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of the texts (in order): its text, its place there, and the least holder of a text with that window."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    symbols[ends] = 0
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    place = np.arange(len(symbols)) - (ends - sizes)[text]
    window = place + length <= sizes[text]
    order, words = two_stage_sort(symbols, length)
    order = order[window[order]]
    least = np.empty(len(symbols), np.int64)
    if len(order):
        opens = np.flatnonzero(~common_prefix(order, words, length))
        lows = np.minimum.reduceat(holders[text[order]], opens)
        least[order] = np.repeat(lows, np.diff(np.append(opens, len(order))))
    return text[window], place[window], least[window]


def _pack(*columns: np.ndarray) -> bytes:
    """Whole numbers column by column, each without the bytes that are zero in all of it."""
    parts = [len(columns[0]).to_bytes(4)]
    for column in columns:
        planes = column.astype(np.int64).view(np.uint8).reshape(-1, 8).T
        width = 8 if column.min(initial=0) < 0 else (int(column.max(initial=0)).bit_length() + 7) // 8
        parts += [bytes([width]), np.ascontiguousarray(planes[:width]).tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def _unpack(packed: bytes, columns: int) -> list[np.ndarray]:
    raw = zstandard.decompress(packed)
    n, at, out = int.from_bytes(raw[:4]), 4, []
    for _ in range(columns):
        width = raw[at]
        planes = np.zeros((8, n), np.uint8)
        planes[:width] = np.frombuffer(raw, np.uint8, width * n, at + 1).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(np.int64).ravel())
        at += 1 + width * n
    return out


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


_BLOCKS = "block long, ids array<long>, ends array<long>, h array<long>, g array<long>, texts binary"


def blocks(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows in blocks of about ``BLOCK`` bytes: ids, where each text ends, 128 bits of hash of each, and the texts'
    bytes, compressed. A longer text is a block of its own. Stored once, so blocks keep their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, number = [], [], 0, TaskContext.get().partitionId() << 40

        def block() -> pa.RecordBatch:
            prints = np.array([xxhash.xxh3_128_intdigest(t).to_bytes(16) for t in texts], "S16")
            halves = np.frombuffer(prints.tobytes(), np.int64).reshape(-1, 2)
            ends = np.cumsum([len(t) for t in texts])
            return _batch(_BLOCKS, [number], [ids], [ends], [halves[:, 0]], [halves[:, 1]], [zstandard.compress(b"".join(texts), 3)])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if texts and size + len(t.as_buffer()) > BLOCK:
                    yield block()
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(i)
                texts.append(t.as_py())
                size += len(texts[-1])
        if texts:
            yield block()

    return stored(docs.select(F.col(id).cast("long"), utf8(text)).mapInArrow(run, _BLOCKS))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, so that one block is unpacked at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}


def _texts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, ends, ids (zero for null) and whether a row takes part: it has an id and is no copy of an earlier text."""
    taking = np.array([i is not None for i in row["ids"]])
    taking[row.get("copies") or []] = False
    ids = np.array([i or 0 for i in row["ids"]], np.int64)
    return np.frombuffer(zstandard.decompress(row["texts"]), np.uint8), np.array(row["ends"]), ids, taking


def _copies(cut: DataFrame) -> DataFrame:
    """``(block, copies)``: places of rows whose whole text stands at a smaller id, too."""
    each = cut.select("block", F.posexplode(F.arrays_zip("ids", "h", "g")).alias("place", "t")).select("block", "place", "t.*")
    least = each.groupBy("h", "g").agg(F.min("ids").alias("least"), F.max("ids").alias("most")).filter("least < most")
    later = each.join(least, ["h", "g"]).filter("ids > least")
    return stored(later.groupBy("block").agg(F.collect_list("place").alias("copies")))


def _buckets(cut: DataFrame, length: int) -> int:
    """Ranges of hashes, so that one holds about ``BUCKET`` anchors of all documents."""
    size = cut.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    return min(64 + size * 2 // (length - GRAM + 2) // BUCKET, 1 << 20)


def _shared_anchors(cut: DataFrame, length: int, buckets: int) -> DataFrame:
    """``(block, shared)``: packed anchors of the block that stand at several ids in all. Each block sends its distinct
    anchors, with their least and greatest id, to the bucket of their range."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data, ends, ids, taking = _texts(row)
            found = [np.zeros((0, 2), np.uint64)]
            for hashes, first, _ in stretches(data, ends, length):
                doc = np.searchsorted(ends, first, "right")
                found.append(np.stack((hashes, doc.astype(np.uint64)), 1)[taking[doc]])
            hashes, doc = np.concatenate(found).T
            if not len(hashes):
                continue
            full, doc = _address(hashes, buckets), ids[doc.astype(np.int64)]
            sort = np.argsort(full, kind="stable")
            full, doc = full[sort], doc[sort]
            opens = np.flatnonzero(np.append(True, full[1:] != full[:-1]))
            full, low, high = full[opens], np.minimum.reduceat(doc, opens), np.maximum.reduceat(doc, opens)
            bucket, base = full >> np.uint64(40), int(low.min())
            edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() + [len(full)]
            packed = [_pack(full[a:b] & _KEY, low[a:b] - base, high[a:b] - low[a:b]) for a, b in zip(edges, edges[1:])]
            k = len(packed)
            yield _batch("bucket long, block long, base long, packed binary", bucket[edges[:-1]].astype(np.int64), [row["block"]] * k, [base] * k, packed)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for row in _rows(batches):
            if row["bucket"] != now:
                yield from shared(now, held)
                now, held = row["bucket"], []
            held.append((row["block"], row["base"], _unpack(row["packed"], 3)))
        yield from shared(now, held)

    def shared(bucket: int, held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        keys = np.concatenate([k for _, _, (k, _, _) in held])
        low = np.concatenate([low + base for _, base, (_, low, _) in held])
        high = low + np.concatenate([more for _, _, (_, _, more) in held])
        which = np.repeat(np.arange(len(held)), [len(k) for _, _, (k, _, _) in held])
        sort = np.argsort(keys, kind="stable")
        opens = np.flatnonzero(np.append(True, np.diff(keys[sort]) != 0))
        several = np.minimum.reduceat(low[sort], opens) < np.maximum.reduceat(high[sort], opens)
        several = sort[np.repeat(several, np.diff(np.append(opens, len(keys))))]
        keys, which = keys[several], which[several]
        sort = np.argsort(which, kind="stable")
        parts = np.split(keys[sort], np.cumsum(np.bincount(which, minlength=len(held)))[:-1])
        own = [(block, _pack(np.sort(k) | bucket << 40)) for (block, _, _), k in zip(held, parts) if len(k)]
        if own:
            yield _batch("block long, shared binary", *zip(*own))

    sent = cut.mapInArrow(send, "bucket long, block long, base long, packed binary")
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare, "block long, shared binary")
    return dealt.groupBy("block").agg(F.collect_list("shared").alias("shared"))


def _address(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (from the first 24 bits) and the other 40 bits."""
    return ((hashes >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)) << np.uint64(40) | hashes & _KEY


_CANDIDATES = "key long, content binary, block long, number int, at int, low long, high long, places binary"


def _candidates(cut: DataFrame, copies: DataFrame, length: int) -> DataFrame:
    """Stretches with a shared anchor, each distinct one of a block once: ``key`` (its anchor), ``content``, ``number`` in
    the block, least and greatest id. One more row of a block, without key, has the ``places`` of all its stretches."""

    buckets = _buckets(cut, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data, ends, ids, taking = _texts(row)
            raw, shared = data.tobytes(), np.concatenate([_unpack(s, 1)[0] for s in row["shared"]]).astype(np.uint64)
            shared = np.sort(shared)
            numbers: dict[bytes, int] = {}
            found: list[list[np.ndarray]] = [[], [], [], []]
            for hashes, first, last in stretches(data, ends, length):
                full, doc = _address(hashes, buckets), np.searchsorted(ends, first, "right")
                at = np.minimum(np.searchsorted(shared, full), len(shared) - 1)
                take = (shared[at] == full) & taking[doc]
                hashes, first, last, doc = hashes[take], first[take], last[take], doc[take]
                texts = [raw[a:b] for a, b in zip(first.tolist(), (last + length).tolist())]
                own = np.fromiter((numbers.setdefault(t, len(numbers)) for t in texts), np.int64, len(texts))
                for column, values in zip(found, (own, first, hashes, ids[doc])):
                    column.append(values)
            if not numbers:
                continue
            own, first, hashes, holder = map(np.concatenate, found)
            sort = np.argsort(own, kind="stable")
            opens = np.searchsorted(own[sort], np.arange(len(numbers)))
            low, high = np.minimum.reduceat(holder[sort], opens), np.maximum.reduceat(holder[sort], opens)
            keys, texts, n = hashes[sort][opens].view(np.int64), list(numbers), len(numbers)
            for a in range(0, n, 10_000):
                b = min(a + 10_000, n)
                k = b - a
                yield _batch(_CANDIDATES, keys[a:b], texts[a:b], [row["block"]] * k, np.arange(a, b), [0] * k, low[a:b], high[a:b], [None] * k)
            yield _batch(_CANDIDATES, [None], [None], [row["block"]], [None], [None], [None], [None], [_pack(own, first)])

    marked = cut.drop("h", "g").join(copies, "block", "left")
    return stored(marked.join(_shared_anchors(marked, length, buckets), "block").mapInArrow(run, _CANDIDATES))


_HITS = "block long, hits binary"


def _hits(block: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of hits, packed by block."""
    sort = np.argsort(block, kind="stable")
    block, columns = block[sort], [c[sort] for c in columns]
    edges = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist() + [len(block)]
    if len(block):
        yield _batch(_HITS, block[edges[:-1]], [_pack(*(c[a:b] for c in columns)) for a, b in zip(edges, edges[1:])])


def _sorted_windows(length: int):
    """Sorts the suffixes of whole groups of stretches, read in the order of key and content, and gives for each stretch
    of a block the windows that an id under its greatest has, with the least such id."""

    def solve(held: dict) -> Iterator[pa.RecordBatch]:
        content = held["content"]
        opens = [i for i in range(len(content)) if not i or content[i] != content[i - 1]]
        low = np.minimum.reduceat(held["low"], opens)
        text, place, least = least_holders([content[i] for i in opens], low, length)
        runs = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (least[1:] != least[:-1])))
        last = np.append(runs[1:], len(text)) - 1
        # every row of a text with each of the text's runs
        edges = np.append(opens, len(content))
        rows = np.diff(edges)[text[runs]]
        run = np.repeat(np.arange(len(runs)), rows)
        row = np.arange(len(run)) - np.repeat(np.cumsum(rows) - rows, rows) + edges[text[runs]][run]
        hit = least[runs][run] < held["high"][row]
        run, row = run[hit], row[hit]
        yield from _hits(held["block"][row], held["number"][row], place[runs][run], place[last][run], least[runs][run])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "block", "number", "low", "high")}
            new["content"] = batch.column("content").to_pylist()
            if held:
                new = {n: held[n] + new[n] if n == "content" else np.concatenate((held[n], new[n])) for n in new}
            whole = int(np.searchsorted(new["key"], new["key"][-1])) if len(new["key"]) else 0
            for a, b in _whole_keys(new["key"][:whole]):
                yield from solve({n: c[a:b] for n, c in new.items()})
            held = {n: c[whole:] for n, c in new.items()} if len(new["key"]) else None
        if held:
            yield from solve(held)

    return run


def _whole_keys(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of ``TOGETHER`` rows or more that end with a key's last row."""
    a, ends = 0, np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
    while a < len(keys):
        b = int(ends[min(np.searchsorted(ends, a + TOGETHER), len(ends) - 1)])
        yield a, b
        a = b


def _adjacent_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for single windows in the order of content and least id: the first of equal ones has the least id."""
    before, least = None, 0
    for batch in batches:
        content, low = batch.column("content").to_pylist(), batch.column("low").to_pylist()
        lows = np.empty(len(content), np.int64)
        for i, c in enumerate(content):
            if c != before:
                before, least = c, low[i]
            lows[i] = least
        hit = lows < batch.column("high").to_numpy()
        block, number, at = (batch.column(n).to_numpy()[hit] for n in ("block", "number", "at"))
        yield from _hits(block, number, at, at, lows[hit])


def _repeats(candidates: DataFrame, length: int) -> DataFrame:
    """``(block, hits)`` of all candidates. Stretches of an anchor with over ``CROWD`` bytes are taken apart into windows."""
    rows = candidates.filter("key is not null").drop("places")
    weight = F.sum(F.length("content") + 48)
    crowded = stored(rows.groupBy("key").agg(weight.alias("w")).filter(F.col("w") > CROWD).select("key"))
    if crowded.isEmpty():
        return _by_anchor(rows, length)
    if fits(crowded, BROADCAST_ANCHORS):
        crowded = F.broadcast(crowded)
    starts = F.sequence(F.lit(0), F.length("content") - length)
    windows = rows.join(crowded, "key", "left_semi").withColumn("at", F.explode(starts))
    windows = windows.withColumn("content", F.col("content").substr(F.col("at") + 1, F.lit(length)))
    dealt = windows.repartition("content").sortWithinPartitions("content", "low")
    return _by_anchor(rows.join(crowded, "key", "left_anti"), length).unionAll(dealt.mapInArrow(_adjacent_windows, _HITS))


def _by_anchor(rows: DataFrame, length: int) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "content").mapInArrow(_sorted_windows(length), _HITS)


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, spans, kept)``, one row per row of ``docs``.

    Of each text as UTF-8 bytes, those are removed that lie in a string of ``length`` bytes which also starts in a row with a
    smaller id, whatever is removed there. ``kept`` has the others (binary, as a cut may divide a character), ``spans`` the
    removed stretches as (start, end). Null text is empty. ``id`` has to be whole numbers; a row with a null id stays whole
    and counts for no other, rows with one id don't count for each other. No other column of ``docs`` is read.

    Texts are put into blocks, which are stored compressed. Blocks send anchors (8 bytes or less) and the stretches of
    shared ones, each distinct one once, so copies and hot passages are merged before they are shuffled; they get
    back which windows are repeated. ``length`` is at least 32.
    """
    if length < GRAM + 8:
        raise ValueError(f"length has to be {GRAM + 8} at least")
    kind = docs.schema[id].dataType.simpleString()
    cut = blocks(docs, id, text)
    copies = _copies(cut)
    candidates = _candidates(cut, copies, length)
    places = candidates.filter("key is null").select("block", "places")
    hits = _repeats(candidates, length).groupBy("block").agg(F.collect_list("hits").alias("hits"))
    joined = cut.drop("h", "g").join(copies, "block", "left").join(places, "block", "left").join(hits, "block", "left")
    schema = "id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield from _without(row, length)

    return joined.mapInArrow(run, schema).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id)


def _without(row: dict, length: int) -> Iterator[pa.RecordBatch]:
    """The rows of a block without what its hits cover."""
    data, ends, ids, _ = _texts(row)
    starts = np.append(0, ends[:-1])
    gone = np.zeros(len(data) + 1, np.int32)
    for i in row["copies"] or []:
        if ends[i] - starts[i] >= length:
            gone[starts[i]] += 1
            gone[ends[i]] -= 1
    if row["hits"]:
        number, place = _unpack(row["places"], 2)
        sort = np.argsort(number, kind="stable")
        edges, place = np.searchsorted(number[sort], np.arange(number.max() + 2)), place[sort]
        holder = ids[np.searchsorted(ends, place, "right")]
        for packed in row["hits"]:
            own, first, last, least = _unpack(packed, 4)
            times = edges[own + 1] - edges[own]
            hit = np.repeat(np.arange(len(own)), times)
            at = np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times) + edges[own][hit]
            later = holder[at] > least[hit]
            hit, at = hit[later], at[later]
            np.add.at(gone, place[at] + first[hit], 1)
            np.add.at(gone, place[at] + last[hit] + length, -1)
    gone = np.cumsum(gone[:-1], dtype=np.int32) > 0
    opens, closes = gone.copy(), gone.copy()
    opens[1:] &= ~gone[:-1]
    closes[:-1] &= ~gone[1:]
    inner = starts[(ends > starts)]
    opens[inner] = gone[inner]
    closes[inner[inner > 0] - 1] = gone[inner[inner > 0] - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    kept, left = data[~gone].tobytes(), np.append(0, np.cumsum(~gone))
    bounds = np.searchsorted(first, np.append(starts, len(data)))
    n = len(ids)
    for a in range(0, n, 1000):
        rows = range(a, min(a + 1000, n))
        spans = [
            [{"start": x, "end": y} for x, y in zip((first[p:q] - starts[i]).tolist(), (last[p:q] - starts[i]).tolist())]
            for i, p, q in ((i, bounds[i], bounds[i + 1]) for i in rows)
        ]
        sizes = (ends - starts)[a : rows[-1] + 1]
        texts = [kept[left[starts[i]] : left[ends[i]]] for i in rows]
        columns = [
            pa.array([row["ids"][i] for i in rows], pa.int64()),
            pa.array(sizes),
            pa.array(sizes - np.array([len(t) for t in texts])),
            pa.array([len(s) for s in spans], pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            pa.array(texts, pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])
