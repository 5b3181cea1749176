"""Removal of repeated strings by a logarithmic family of sampled suffix arrays.

A byte goes if some ``length``-byte string over it also starts elsewhere.  Suffixes are sampled by content: the
anchor of a window is the leftmost smallest hash among its places with at least ``core``
bytes to come, so equal windows have their anchors at the same offset, and the consecutive windows
with one anchor, a *run*, lie in one stretch of text.

Documents come in batches.  A batch gets a suffix array: its anchors' suffixes, each once with its number, ordered by
their first eight bytes and behind these by a fingerprint of the first ``core``, in tables that are
bucketed and sorted by that key.  The array is merge-scanned against every level of the family: two
sorted tables with the same buckets meet in a sort-merge join without a shuffle, and equal keys are suffixes with ``core``
bytes in common.  Levels of equal rank are merged in the same way into the next, so an entry is rewritten
once a doubling.  The family lies in a folder and takes further batches later.

Only matched entries go on: stretches that are equal as a whole repeat in all their windows, and the
other stretches behind a suffix are compared window by window at equal offsets, which gives the matches'
full lengths.  Windows are compared by two 64-bit polynomial hashes, stretches by a 128-bit digest.

Beside the strings of ``length`` bytes, *passages* can be found in the same scan: maximal runs of repeated
``short``-byte strings with at least so many words.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import chunks, removed, row_key, shared_dir, stored, texts

CORE, SHORT = 64, 240
KEY = ["head", "print"]
#: Rows up to which their keys (16 bytes each) are sent to every task, to find their texts without moving all.
FEW_ROWS = 300_000
MIX = np.uint64(0x9E3779B97F4A7C15)
_R = np.random.default_rng(40)
BASES = [int(x) | 1 for x in _R.integers(1 << 40, 1 << 63, 2)]
CODES = _R.integers(1, 1 << 63, (2, 256), np.uint64)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in a row, and where each starts and the last ends."""
    if column.offset:
        column = pa.concat_arrays([column])
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
    return body, bounds - bounds[0]


def runs(body: np.ndarray, bounds: np.ndarray, length: int, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of every run."""
    none = np.zeros(0, np.int64)
    if len(body) < length:
        return none, none, none
    x = body.astype(np.uint64)
    for k in (1, 2, 4):
        x = x[:-k] | (x[k:] << np.uint64(8 * k))
    x = (x[:-8] * MIX) ^ (x[8:] * np.uint64(0xC2B2AE3D27D4EB4F)) if core >= 16 else x * MIX
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x &= np.uint64(0xFFFFFFFF00000000)
    x |= np.arange(len(x), dtype=np.uint64)
    wide, size = length - core + 1, 1
    while 2 * size <= wide:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    n = len(body) - length + 1
    anchor = (np.minimum(x[:n], x[wide - size : wide - size + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.ones(n, bool)
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        valid[max(s, e - length + 1) : e] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none
    anchor = anchor[at]
    cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(at) != 1)) + 1
    first = np.concatenate([[0], cut])
    return anchor[first], at[first], np.diff(np.concatenate([first, [len(at)]]))


def all_runs(body: np.ndarray, bounds: np.ndarray, length: int, core: int, part: int = 4 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``runs`` of a body of any size, about ``part`` bytes of it at a time.  A run cut by a border is two with one anchor, whose windows still meet their equals."""
    if len(body) <= part + length:
        return runs(body, bounds, length, core)
    found = []
    for s in range(0, len(body), part):
        own = body[s : s + part + length - 1]
        anchor, first, n = runs(own, np.unique(np.clip(bounds - s, 0, len(own))), length, core)
        found.append((anchor + s, first + s, n))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def suffixes(rows: DataFrame, length: int, core: int, short: int) -> DataFrame:
    """The entries of ``row, text``: ``head, print`` (first bytes as a number in their order, and fingerprint), ``s1, s2`` (digest of the stretch), ``row, at, lead, windows, n``.

    ``at`` is the first window's place, ``lead`` the anchor's distance from it; windows are ``short`` bytes wide, and the stretch goes on
    as far as ``length`` bytes from its last window reach within the text.  A stretch that a text has ``n`` times is
    one entry; its other places are rows with an ``n`` of 0, those that join put together.  So a text that goes
    round and round has a few rows, not one a turn.
    """
    names = ["head", "print", "s1", "s2", "row", "at", "lead", "windows", "n"]
    kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int32()] * 4

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            body, bounds = raw(texts(batch, "text"))
            anchor, first, n = all_runs(body, bounds, short, core)
            raw_bytes = body.tobytes()
            view = memoryview(raw_bytes)
            prints = np.fromiter((xxhash.xxh3_64_intdigest(view[a : a + core]) for a in anchor.tolist()), np.uint64, len(anchor))
            text = np.searchsorted(bounds, first, "right") - 1
            stop = np.minimum(first + n - 1 + length, bounds[text + 1])
            whole = b"".join(xxhash.xxh3_128_digest(view[f:e], (k << 32) + a - f) for a, f, k, e in zip(anchor.tolist(), first.tolist(), n.tolist(), stop.tolist(), strict=True))
            whole = np.frombuffer(whole, np.int64).reshape(-1, 2)
            order = np.lexsort((first, whole[:, 1], whole[:, 0], text))
            fresh = np.ones(len(order), bool)
            if len(order):
                fresh[1:] = (np.diff(text[order]) != 0) | (np.diff(whole[order], axis=0) != 0).any(1)
            heads = np.flatnonzero(fresh)
            times = np.diff(np.append(heads, len(order)))
            own, rest = order[heads], np.sort(order[~fresh])
            joins = np.zeros(len(rest), bool)
            joins[1:] = (text[rest][1:] == text[rest][:-1]) & (first[rest][1:] == (first + n)[rest][:-1])
            lead, last = np.flatnonzero(~joins), np.flatnonzero(~np.append(joins, False)[1:])
            keep = np.concatenate([own, rest[lead]])
            n = np.concatenate([n[own], (first + n)[rest[last]] - first[rest[lead]]])
            times = np.concatenate([times, np.zeros(len(lead), np.int64)])
            bytes_of = np.zeros((len(keep), 8), np.uint8)
            for k in range(8):
                bytes_of[:, 7 - k] = body[anchor[keep] + k]
            front = (bytes_of.view(np.uint64)[:, 0] ^ np.uint64(1 << 63)).astype(np.int64)
            row = batch.column("row").take(pa.array(text[keep], pa.int64()))
            columns = front, prints[keep].astype(np.int64), whole[keep, 0], whole[keep, 1], row, first[keep] - bounds[text[keep]], (anchor - first)[keep], n, times
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return rows.mapInArrow(sample, "head long, print long, s1 long, s2 long, row binary, at int, lead int, windows int, n int")


class Family:
    """A logarithmic family of suffix arrays in a folder; a level of rank r holds the suffixes of ``2 ** r`` batches.

    The folder has ``entries/batch=k`` and ``hits/batch=k`` (suffixes of batch k that are there twice by then), the
    levels, and a list of them for each batch that is wholly in; a batch that was broken off leaves no list and is taken anew.
    """

    def __init__(self, spark: SparkSession, folder: str, length: int = 400, core: int = CORE, short: int | None = None):
        self.spark, self.folder = spark, folder
        self.length, self.core, self.short = length, core, short or length
        self.levels: list[tuple[int, str, int]] = []
        self.batches = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        while files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/list-{self.batches}/_SUCCESS")):
            self.batches += 1
        if self.batches:
            self.levels = [tuple(x) for x in spark.read.parquet(f"{folder}/list-{self.batches - 1}").orderBy(F.desc("rank")).collect()]

    def add(self, rows: DataFrame, batches: int = 1) -> None:
        """Takes ``row, text`` in, dealt out to so many batches by row."""
        entries = suffixes(rows, self.length, self.core, self.short)
        first = self.batches
        dealt = entries.withColumn("batch", first + F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int"))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.folder}/entries")
        for k in range(first, first + batches):
            self.take(self.entries().where((F.col("batch") == k) & (F.col("n") > 0)))

    def entries(self) -> DataFrame:
        kinds = "head long, print long, s1 long, s2 long, row binary, at int, lead int, windows int, n int, batch int"
        return self.spark.read.schema(kinds).parquet(f"{self.folder}/entries")

    def hits(self) -> DataFrame:
        return self.spark.read.schema("head long, print long").parquet(*[f"{self.folder}/hits/{k}" for k in range(self.batches)]).distinct()

    def array(self, counted: DataFrame, buckets: int) -> tuple[str, int]:
        """A sorted level of ``head, print, n``: its path and number of buckets."""
        at, name = f"{self.folder}/level-{uuid.uuid4().hex}", f"suffixes_{uuid.uuid4().hex}"
        counted.write.format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY).option("path", at).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay
        return at, buckets

    def opened(self, at: str, buckets: int) -> tuple[DataFrame, str]:
        name = f"suffixes_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (head LONG, print LONG, n LONG) USING parquet CLUSTERED BY (head, print) SORTED BY (head, print) INTO {buckets} BUCKETS LOCATION '{at}'")
        return self.spark.table(name), name

    def take(self, batch: DataFrame) -> None:
        """A batch's entries get their array, are scanned against the levels, and levels of equal rank are merged."""
        buckets = self.levels[0][2] if self.levels else int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        at = self.array(batch.groupBy(*KEY).agg(F.sum("n").alias("n")), buckets)[0]
        new, *names = self.opened(at, buckets)
        hits = new.where("n > 1").select(*KEY)
        for _, path, n in self.levels:
            level, name = self.opened(path, n)
            names.append(name)
            hits = hits.unionByName(level.select(*KEY).join(new.select(*KEY).hint("merge"), KEY))
        hits.write.mode("overwrite").parquet(f"{self.folder}/hits/{self.batches}")
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            level, name = self.opened(*self.levels.pop()[1:])
            names.append(name)
            both = level.withColumnRenamed("n", "m").join(new.hint("merge"), KEY, "full_outer")
            at = self.array(both.select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")), buckets)[0]
            new, name = self.opened(at, buckets)
            names.append(name)
            rank += 1
        self.levels.append((rank, at, buckets))
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
        self.spark.createDataFrame(self.levels, "rank int, path string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/list-{self.batches}")
        self.batches += 1

    def spans(self, rows: DataFrame, most: int = 20_000) -> DataFrame:
        """``row, spans`` of each row with repeats, among all batches: places, numbers of windows and kind (0: of either width, 1: short, 2: long).

        ``rows`` are all rows that were taken in; stretches are cut from their texts.
        """
        work = f"{self.folder}/work-{uuid.uuid4().hex}"
        entries = self.entries().drop("batch")
        met = stored(entries.where("n > 0").join(stored(self.hits(), "hits", work), KEY), "met", work)
        same = met.groupBy(*KEY, "s1", "s2").agg(F.sum("n").alias("n"), F.min(F.struct("row", "at", "lead", "windows")).alias("e"))
        same = stored(same.select(*KEY, "s1", "s2", "n", "e.*"), "stretches", work)
        several = stored(same.groupBy(*KEY).agg(F.count("*").alias("m")).where("m > 1"), "several", work)
        mixed = stored(same.join(several, KEY), "mixed", work)
        full = met.join(same.where("n > 1").select(*KEY, "s1", "s2"), [*KEY, "s1", "s2"]).select("row", "at", "windows", F.lit(0).alias("kind"))
        again = entries.where("n = 0").select("row", "at", "windows", F.lit(0).alias("kind"))
        spans = full.unionByName(again).unionByName(partly(mixed, rows, self.length, self.short, most, work))
        spans = stored(spans.groupBy("row").agg(F.collect_list(F.struct("at", "windows", "kind")).alias("spans")), "spans")
        removed(self.spark, work)
        return spans


def window_hashes(body: np.ndarray, starts: np.ndarray, length: int, which: int) -> np.ndarray:
    """A polynomial hash of the ``length`` bytes from each start, the same whatever stands around them."""
    n = len(body)
    power = np.full(n + 1, BASES[which], np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(CODES[which][body] * power[:n], out=total[1:])
    # A sum from place p on has a factor of B ** p; it is brought to one high power, the same for every body.
    rest = np.uint64(pow(BASES[which], (1 << 40) - n, 1 << 64))
    return (total[starts + length] - total[starts]) * power[n - starts] * rest


def compared(groups: np.ndarray, lead: np.ndarray, windows: np.ndarray, stretches: list[bytes], length: int, at_once: int = 400_000) -> list[list[tuple[int, int]]]:
    """For each stretch the ranges of its windows that another stretch of its group has at the same offset.

    Windows meet at equal offsets only, so many of them are compared in bands of offsets of about ``at_once`` windows.
    """
    again = [np.zeros(w, bool) for w in windows.tolist()]
    low, high = int((lead - windows + 1).min()), int(lead.max()) + 1
    band = high - low if windows.sum() <= at_once else max(1, at_once // len(stretches))
    for o in range(low, high, band):
        first, last = np.maximum(lead - (o + band - 1), 0), np.minimum(lead - o, windows - 1)
        inside = np.flatnonzero(first <= last)
        size = (last - first + 1)[inside]
        one, two = (np.empty(int(size.sum()), np.uint64) for _ in range(2))
        ends = np.cumsum(size)
        s = 0
        while s < len(inside):  # hashes of about a quarter of a megabyte of text at a time
            e, n = s, 0
            while e < len(inside) and (e == s or n + size[e] + length <= 1 << 18):
                n += size[e] + length
                e += 1
            own, count = inside[s:e], size[s:e]
            body = b"".join(stretches[k][f : l + length] for k, f, l in zip(own.tolist(), first[own].tolist(), last[own].tolist(), strict=True))
            starts = np.cumsum(count + length - 1) - (count + length - 1)
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            place = np.repeat(starts, count) + step
            part = slice(int(ends[s] - size[s]), int(ends[e - 1]))
            one[part], two[part] = (window_hashes(np.frombuffer(body, np.uint8), place, length, w) for w in (0, 1))
            offset = (np.repeat((lead - first)[own], count) - step).astype(np.uint64)
            one[part] ^= np.repeat(groups[own].astype(np.uint64) * MIX, count) ^ (offset * np.uint64(0xC2B2AE3D27D4EB4F))
            s = e
        order = np.argsort(one, kind="stable")
        same = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
        found = np.zeros(len(one), bool)
        found[order[1:]] |= same
        found[order[:-1]] |= same
        for k, e, n in zip(inside.tolist(), ends.tolist(), size.tolist(), strict=True):
            again[k][first[k] : last[k] + 1] = found[e - n : e]
    out = []
    for flags in again:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
    return out


def partly(mixed: DataFrame, rows: DataFrame, length: int, short: int, most: int, work: str) -> DataFrame:
    """``row, at, windows, kind``: the repeated windows of single stretches that share a suffix with others.

    ``mixed`` has ``head, print, s1, s2, n, m, row, at, lead, windows``, one row for each different stretch; m is their number behind the suffix.
    """
    at = mixed.groupBy("row").agg(F.collect_list(F.struct(*KEY, "n", "m", "at", "lead", "windows")).alias("parts"))
    part = "struct<head:long,print:long,n:long,m:long,at:int,lead:int,windows:int>"
    own = stored(at.select("row"), "mixed-rows", work)
    if own.count() <= FEW_ROWS:
        rows = rows.join(F.broadcast(own), "row", "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 19):  # what comes out is several times as large
            parts = batch.column("parts")
            flat = parts.flatten()
            text = np.repeat(np.arange(batch.num_rows), np.diff(parts.offsets.to_numpy()))
            field = {k: flat.field(k) for k in (*KEY, "n", "m", "at", "lead", "windows")}
            column = texts(batch, "text")
            whole = [x.as_py().encode() for x in column]
            out = [whole[t][a : a + w + length - 1] for t, a, w in zip(text.tolist(), field["at"].to_pylist(), field["windows"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(text, pa.int64())), *field.values(), pa.array(out, pa.binary())], ["row", *field, "stretch"])

    schema = "row binary, head long, print long, n long, m long, at int, lead int, windows int, stretch binary"
    pieces = rows.join(at, "row").select("row", "text", F.col("parts").cast(f"array<{part}>").alias("parts")).mapInArrow(cut, schema)
    small = pieces.where(F.col("m") <= most)
    widths = [(0, length)] if short == length else [(1, short), (2, length)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, last = 0, None

        def close() -> pa.RecordBatch:
            out = []
            for kind, width in widths:
                wide = [(h, min(h["windows"], len(h["stretch"]) - width + 1)) for h in held]
                wide = [(h, w) for h, w in wide if w > 0]
                if not wide:
                    continue
                groups = np.unique([h["head"] ^ h["print"] for h, _ in wide], return_inverse=True)[1]
                found = compared(groups, np.array([h["lead"] for h, _ in wide]), np.array([w for _, w in wide]), [h["stretch"][: w + width - 1] for h, w in wide], width)
                out += [(h["row"], h["at"] + s, e - s, kind) for (h, _), ranges in zip(wide, found, strict=True) if h["n"] == 1 for s, e in ranges]
            columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["row", "at", "windows", "kind"])

        for batch in batches:
            for part in chunks([batch], "stretch", 1 << 20):
                for row in part.to_pylist():
                    key = row["head"], row["print"]
                    if key != last and size > 1 << 20:
                        yield close()
                        held, size = [], 0
                    if key == last and held and row["row"] == held[-1]["row"] and row["at"] == held[-1]["at"]:
                        continue  # the same row of a repeated document
                    last = key
                    held.append(row)
                    size += len(row["stretch"])
        if held:
            yield close()

    found = small.repartition(*KEY).sortWithinPartitions(*KEY, "row", "at").mapInArrow(compare, "row binary, at int, windows int, kind int")
    if mixed.where(F.col("m") > most).isEmpty():
        return found

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "stretch", 1 << 16):
            out = []
            for r in batch.to_pylist():
                s = memoryview(r["stretch"])
                out += [(xxhash.xxh3_128_digest(s[k : k + width]), r["row"], r["at"] + k, r["n"], kind) for kind, width in widths for k in range(min(r["windows"], len(s) - width + 1))]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["window", "row", "at", "n", "kind"])

    # Too many different stretches for one task: their windows are counted one by one, combined before the shuffle.
    every = pieces.where(F.col("m") > most).mapInArrow(explode, "window binary, row binary, at int, n long, kind int").distinct()
    twice = every.groupBy("window", "kind").agg(F.count("*").alias("c")).where("c > 1").select("window", "kind")
    return found.unionByName(every.join(stored(twice, "twice", work), ["window", "kind"]).where("n = 1").select("row", "at", F.lit(1).alias("windows"), "kind"))


def covered(spans: list[dict], width: int, kinds: tuple[int, ...], n: int) -> np.ndarray:
    """Which of ``n`` bytes lie in windows of these kinds."""
    edge = np.zeros(n + 1, np.int32)
    for s in spans:
        if s["kind"] in kinds and (w := min(s["windows"], n - width - s["at"] + 1)) > 0:
            edge[s["at"]] += 1
            edge[s["at"] + w + width - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def stretches(flags: np.ndarray) -> np.ndarray:
    """Start and end of each maximal run."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))).reshape(-1, 2)


def stripped(docs: DataFrame, spans: DataFrame, text_col: str, length: int, short: int, words: int, passages_go: bool) -> DataFrame:
    """``doc`` (the input's row), ``kept`` (text without what goes, halves of characters at a cut dropped too) and the measures; ``docs`` has ``doc, row, text``."""
    names = ["doc", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes"]

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            out = []
            for text, own in zip(texts(batch, "text"), batch.column("spans").to_pylist(), strict=True):
                whole = text.as_py()
                body = whole.encode()
                if not own:
                    out.append((whole, len(body), 0, 0, hashlib.sha256(body).hexdigest(), 0, 0))
                    continue
                x = np.frombuffer(body, np.uint8)
                gone = covered(own, length, (0, 2), len(x))
                found = np.zeros((0, 2), np.int64)
                if words:
                    white = (x == 32) | ((x >= 9) & (x <= 13))
                    found = stretches(covered(own, short, (0, 1), len(x)))
                    begins = np.concatenate([[0], np.cumsum(~white & np.append(True, white[:-1]))])
                    many = [begins[e] - begins[s] + (not white[s] and s > 0 and not white[s - 1]) for s, e in found.tolist()]
                    found = found[np.array(many, np.int64) >= words]
                if passages_go:
                    for s, e in found.tolist():
                        gone[s:e] = True
                kept = x[~gone].tobytes()
                out.append((kept.decode("utf-8", "ignore"), len(x), int(gone.sum()), len(stretches(gone)), hashlib.sha256(kept).hexdigest(), len(found), int(np.diff(found).sum())))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]], names)

    joined = docs.join(spans, "row", "left").select("doc", "text", "spans")
    kind = docs.schema["doc"].dataType.simpleString()
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema["doc"].dataType.fields) if kind.startswith("struct") else ""
    return joined.mapInArrow(strip, f"doc struct<{fields}>, kept string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long")


def kept_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, core: int = CORE, batches: int = 2, most: int = 20_000,
    short: int = SHORT, words: int = 0, passages_go: bool = False, carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """``doc`` (a struct of the input's row, or of the columns ``carry``), ``kept`` (what remains of its text), ``n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes``.

    Strings of ``length`` bytes that repeat go.  With ``words``, maximal runs of repeated ``short``-byte strings
    that have at least so many words (parts of words at the ends count) are passages: counted, and removed too if ``passages_go``.

    Null texts count as empty.  Repeated rows are texts that each repeat the other.  Null ids are passed on; a text may be of any
    length; an empty table gives an empty result.  Columns of any name are carried in the struct, where they clash with nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("doc"), row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    family = Family(spark, f"{shared_dir(spark)}/suffixes-{uuid.uuid4().hex}", length, core, min(short, length) if words else length)
    family.add(rows.select("row", "text"), batches)
    spans = family.spans(rows.select("row", "text"), most)
    removed(spark, family.folder)  # the spans are written; nothing reads the arrays any more
    return stripped(rows, spans, text_col, length, family.short, words, passages_go)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 51, **options: int) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row, and ``n_passages, passage_bytes``: its repeated passages of over 50 words, which need not have ``length`` bytes and are counted, not removed.

    Null texts count as empty.  Repeated rows are texts that each repeat the other.  Null ids are passed
    on; a text may be of any length; an empty table gives an empty result; further columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = kept_texts(rows, "doc_id", "text", words=words, carry=("doc_id",), **options)
    return out.select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes")
