"""Removal of long byte strings that stand in more than one place, by suffix arrays.

Windows of WINDOW bytes that are equal share an anchor (see anchors.py), so the corpus falls into
groups, one for each anchor string, and equal windows always meet in a group. Anchors that stand in one
place only are dropped; of the others the contexts (runs of windows) are compared:

- contexts that are equal as a whole repeat in all their windows, however many there are;
- of the distinct contexts of a group one copy each is fetched, and groups are packed into blocks whose
  suffix array is built by linear grouping (lyndon.py). The symbols are CELL-byte cells, numbered from
  the anchor on, so a window is 15 whole cells and 25 bytes around them: suffixes that share 15 symbols
  stand next to each other in the array, and among these the bytes left and right of the cells are
  compared as they are;
- a group with more distinct contexts than one task should hold (LARGE) is not put into an array: its
  windows are counted by their digests, a row each, which no hot group overloads.

All three are exact. Texts are dealt out twice, by row: to fetch contexts and to cut the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.anchors import MOST, Anchors
from palisade.llm.common import identified, save, scanned, text_of, tidy
from palisade.llm.lyndon import common_prefixes, suffix_array

WINDOW, CELL = 400, 25
#: Whole cells in a window, wherever it starts.
CORE = WINDOW // CELL - 1
#: Distinct contexts of a group that one suffix array takes (about 12 MB of bytes).
LARGE = 20_000
#: Symbols of a block, about; a block holds whole groups.
BLOCK = 8_192
CONTEXTS = pa.schema([("gram", pa.int64()), ("content", pa.int64()), ("uid", pa.binary()), ("start", pa.int32()), ("lead", pa.int32()), ("size", pa.int32())])
SPANS = pa.schema([("uid", pa.binary()), ("start", pa.int32()), ("stop", pa.int32())])


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and the offsets of the texts in them."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of at most MOST bytes: first and last text, start and end. A longer text comes in
    stretches of its own that overlap by a window less one byte, so no window is lost or comes twice."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + MOST, "right")) - 1
        if to > at:
            yield at, to, int(offsets[at]), int(offsets[to])
            at = to
            continue
        for a in range(int(offsets[at]), int(offsets[at + 1]) - WINDOW + 1, MOST - WINDOW + 1):
            yield at, at + 1, a, min(a + MOST, int(offsets[at + 1]))
        at += 1


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, text) to a row for each context."""
    anchors = Anchors(WINDOW, WINDOW // 4)
    for b in batches:
        data, offsets = utf8(b.column(1))
        uids = b.column(0)
        for at, to, lo, hi in pieces(offsets):
            part = data[lo:hi]
            starts = np.maximum(offsets[at:to] - lo, 0)
            ends = np.minimum(offsets[at + 1 : to + 1] - lo, hi - lo)
            text, first, last, gram, place = anchors.runs(part, starts, ends)
            raw = memoryview(part.tobytes())
            stop = last + WINDOW
            content = np.frombuffer(b"".join([hashlib.blake2b(raw[a:z], digest_size=8).digest() for a, z in zip(first.tolist(), stop.tolist(), strict=True)]), np.int64)
            yield pa.record_batch([pa.array(gram.view(np.int64)), pa.array(content), uids.take(pa.array(text + at)), pa.array((first + lo - offsets[at + text]).astype(np.int32)), pa.array((place - first).astype(np.int32)), pa.array((stop - first).astype(np.int32))], schema=CONTEXTS)


def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, wanted array<struct<gram, uid, start, lead, size, alone>>) to the wanted contexts with their bytes."""
    for b in batches:
        data, offsets = utf8(b.column(0))
        lists = b.column(1)
        flat = lists.flatten()
        of = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
        start = flat.field("start").to_numpy(zero_copy_only=False) + offsets[of]
        size = flat.field("size").to_numpy(zero_copy_only=False)
        raw = data.tobytes()
        for a in range(0, len(flat), 4096):
            own = [raw[s : s + n] for s, n in zip(start[a : a + 4096].tolist(), size[a : a + 4096].tolist(), strict=True)]
            cut = flat.slice(a, 4096)
            yield pa.record_batch([cut.field("gram"), cut.field("uid"), cut.field("start"), cut.field("lead"), cut.field("alone"), pa.array(own, pa.binary())], names=["gram", "uid", "start", "lead", "alone", "bytes"])


def repeats(block: list[tuple[int, bytes]]) -> list[set[int]]:
    """Contexts (the place of the anchor in them, bytes) to the starts in each of the windows that
    another context, or another place of it, has too."""
    found: list[set[int]] = [set() for _ in block]
    symbols: dict[tuple[int, bytes], int] = {}
    text: list[int] = []
    owner: list[tuple[int, int]] = []
    for k, (lead, data) in enumerate(block):
        c = -(lead // CELL)
        for p in range(lead + c * CELL, len(data) - CELL + 1, CELL):
            text.append(symbols.setdefault((c, data[p : p + CELL]), len(symbols)))
            owner.append((k, p))
            c += 1
        text.append(-1 - k)  # ends are all different: no common prefix crosses them
        owner.append((k, -1))
    order = suffix_array(text)
    shared = common_prefixes(text, order)
    i, n = 1, len(order)
    while i < n:
        if shared[i] < CORE:
            i += 1
            continue
        members = [owner[order[i - 1]]]
        while i < n and shared[i] >= CORE:
            members.append(owner[order[i]])
            i += 1
        around = []
        for k, p in members:
            data = block[k][1]
            around.append((k, p, data[max(0, p - CELL + 1) : p], data[p + CORE * CELL : p + CORE * CELL + CELL]))
        if len(around) == 2:
            (k, p, la, ra), (m, q, lb, rb) = around
            left, right = common_end(la, lb), common_start(ra, rb)
            for t in range(CELL - right, left + 1):
                found[k].add(p - t)
                found[m].add(q - t)
            continue
        for t in range(CELL):
            seen: dict[bytes, tuple[int, int]] = {}
            again: set[bytes] = set()
            for k, p, a, z in around:
                if len(a) < t or len(z) < CELL - t:
                    continue
                key = a[len(a) - t :] + z[: CELL - t]
                if key in seen:
                    found[k].add(p - t)
                    if key not in again:
                        again.add(key)
                        m, q = seen[key]
                        found[m].add(q - t)
                else:
                    seen[key] = (k, p)
    return found


def common_start(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def common_end(a: bytes, b: bytes) -> int:
    return common_start(a[::-1], b[::-1])


def stretches(starts: set[int]) -> Iterator[tuple[int, int]]:
    """Window starts as maximal covered runs."""
    first = last = None
    for s in sorted(starts):
        if last is not None and s <= last:
            last = s + WINDOW
            continue
        if last is not None:
            yield first, last
        first, last = s, s + WINDOW
    if last is not None:
        yield first, last


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by gram (gram, uid, start, lead, alone, bytes) to spans of those that stand alone."""

    def done(block: list) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [])
        for (uid, start, _, alone, _), starts in zip(block, repeats([(x[2], x[4]) for x in block]), strict=True):
            if alone:
                for a, z in stretches(starts):
                    out[0].append(uid)
                    out[1].append(start + a)
                    out[2].append(start + z)
        return pa.record_batch(list(out), schema=SPANS)

    block: list = []
    cells, last = 0, None
    for b in batches:
        for gram, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if gram != last and cells >= BLOCK:
                yield done(block)
                block, cells = [], 0
            last = gram
            block.append(row)
            cells += len(row[4]) // CELL
    if block:
        yield done(block)


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts to a row for each window: digest, uid, start, alone."""
    for b in batches:
        for _, uid, start, _, alone, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n = len(data) - WINDOW + 1
            digests = [hashlib.blake2b(data[i : i + WINDOW], digest_size=16).digest() for i in range(n)]
            yield pa.record_batch([pa.array(digests, pa.binary()), pa.array([uid] * n, pa.binary()), pa.array(np.arange(start, start + n, dtype=np.int32)), pa.array([alone] * n)], names=["digest", "uid", "start", "alone"])


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) to doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, the text that is left
    and the removed spans."""
    for b in batches:
        data, offsets = utf8(b.column(1))
        out: tuple[list, ...] = ([], [], [], [], [], [], [])
        for i, spans in enumerate(b.column(2).to_pylist()):
            own = data[offsets[i] : offsets[i + 1]].tobytes()
            runs: list[list[int]] = []
            for s in sorted((x["start"], x["stop"]) for x in spans or ()):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            kept, at = [], 0
            for a, z in runs:
                kept.append(own[at:a])
                at = z
            rest = b"".join([*kept, own[at:]])
            for column, value in zip(out, (len(own), len(own) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), len(rest), rest.decode("utf-8", "ignore"), [{"start": a, "stop": z} for a, z in runs]), strict=True):
                column.append(value)
        yield pa.record_batch([b.column(0), *[pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "text", "removed"])


def repeated_spans(spark: SparkSession, texts: DataFrame, large: int = LARGE) -> DataFrame:
    """uid and spans (array<struct<start, stop>> in bytes, they may overlap) of rows (uid, text) that
    have repeated windows."""
    found = save(spark, texts.mapInArrow(contexts, "gram long, content long, uid binary, start int, lead int, size int"), "contexts")
    same = found.groupBy("gram", "content").agg(F.count(F.lit(1)).alias("same"))
    groups = same.groupBy("gram").agg(F.sum("same").alias("places"), F.count(F.lit(1)).alias("kinds")).filter("places > 1").select("gram", "kinds")
    wanted = same.join(groups, "gram")
    meant = save(spark, found.join(wanted, ["gram", "content"]), "meant")
    whole = meant.filter("same > 1").select("uid", "start", (F.col("start") + F.col("size")).alias("stop"))

    one = F.min(F.struct("uid", "start", "lead", "size")).alias("at")
    several = meant.filter("kinds > 1").groupBy("gram", "content", "same", "kinds").agg(one)
    row = F.struct("gram", "at.uid", "at.start", "at.lead", "at.size", (F.col("same") == 1).alias("alone"))
    spans = [whole]
    for hot in (False, True):
        chosen = several.filter(F.col("kinds") > large if hot else F.col("kinds") <= large)
        if hot and chosen.isEmpty():
            continue
        lists = chosen.groupBy("at.uid").agg(F.collect_list(row).alias("wanted"))
        copies = texts.join(lists.hint("shuffle_hash"), "uid").select("text", "wanted").mapInArrow(fetched, "gram long, uid binary, start int, lead int, alone boolean, bytes binary")
        if hot:
            each = save(spark, copies.mapInArrow(windows, "digest binary, uid binary, start int, alone boolean"), "windows")
            again = each.groupBy("digest").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select("digest")
            spans.append(each.filter("alone").join(again, "digest").select("uid", "start", (F.col("start") + WINDOW).alias("stop")))
        else:
            dealt = copies.repartition("gram").sortWithinPartitions("gram")
            spans.append(dealt.mapInArrow(compared, "uid binary, start int, stop int"))
    every = spans[0]
    for s in spans[1:]:
        every = every.unionByName(s)
    return every.groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


@tidy
def without_repeats(spark: SparkSession, docs: DataFrame, large: int = LARGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, text and removed for each row of docs
    (doc_id, text).

    n_kept bytes are left; text is those, without the parts of a character that was cut through.

    A byte is removed if a window of WINDOW bytes that covers it also starts somewhere else, in this
    row or another one; removed lists the maximal removed runs. Texts are UTF-8 bytes as they were put
    in; a null text is empty, texts shorter than a window lose nothing, a row that repeats another is
    removed whole if it is that long. An empty table gives no rows.
    """
    docs = scanned(spark, docs)
    texts = identified(docs, [text_of(docs).alias("text")])
    spans = save(spark, repeated_spans(spark, texts, large), "spans")
    rows = identified(docs, [docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")])
    joined = rows.join(spans.hint("shuffle_hash"), "uid", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, text string, removed array<struct<start:int,stop:int>>")
