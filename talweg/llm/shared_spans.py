"""Long exact spans shared between documents, by restricted recompression.

Recompression replaces, round by round, runs of a symbol and pairs of symbols by new symbols. A symbol's name here is a hash of what
it replaces, so a name is global without any exchange: all tasks name equal runs and pairs alike. In a round only symbols of up
to ``ROUNDS[i]`` characters take part, so whether a place is a symbol boundary depends on nearby text only: by ``CONTEXT`` characters
to either side after all rounds. A span of SPAN characters in two documents is therefore cut into the same symbols but
for CONTEXT characters at its ends, no symbol there is longer than ``LONGEST`` unless it is a run, and each window of ``WINDOW``
characters that starts at a boundary has the same least symbol in both. These least symbols, with their CONTEXT
characters on both sides, are the shared high-level symbols: every pair of documents with a common span has one in common.
Long runs are anchors of their own, at their start and at their end.

Anchors are grouped by key; those in two or more documents fetch their surroundings, and within a group the exact length
of the common span decides. A group of more than ``SMALL_GROUP`` occurrences is divided by longer keys before any pair is
made: a common span reaches over the anchor by some amount to the left, and for each multiple of ``GRAIN`` there
is a key of SPAN - GRAIN characters; pairs are made within equal long keys only, spread by salt. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.session import cut, spread

SPAN = 200
#: (longest active symbol, whether runs are replaced too) of each round.
ROUNDS = ((1, True), (1, False), (2, True), (2, False), (3, False), (4, True), (6, False), (8, False))
LONGEST = 2 * ROUNDS[-1][0]
CONTEXT = sum(n * (2 if runs else 1) for n, runs in ROUNDS) + 1
WINDOW = SPAN - 2 * CONTEXT - LONGEST
SMALL_GROUP = 48
GRAIN = 8
SALTS = 16
CHUNK = 1 << 19
_INDEX_BITS = 20
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK * 2, 1 << int(n).bit_length())
    if size not in _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        up = np.cumprod(np.full(size, _BASE, dtype=_U))
        down = np.cumprod(np.full(size, inverse, dtype=_U))
        _powers[size] = (up, down)
    return _powers[size]


def symbols(codes: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Names and starts of the symbols after all rounds, the characters' values, and the long runs (starts, ends, base names).

    ``breaks``: places in ``codes`` that part documents; no symbol goes over them.
    """
    value = _mix(codes.astype(_U) + _U(0x51ED2701))
    name, start, n = value.copy(), np.arange(len(codes), dtype=np.int64), len(codes)
    fixed = np.zeros(n, dtype=bool)
    fixed[breaks] = True
    long_runs = []
    for r, (most, runs) in enumerate(ROUNDS):
        active = (np.diff(start, append=n) <= most) & ~fixed
        if runs:
            same = (name[1:] == name[:-1]) & active[1:] & active[:-1]
            if same.any():
                first = np.flatnonzero(np.concatenate(([True], ~same)))
                count = np.diff(first, append=len(name))
                ends = np.append(start[first][1:], n)
                far = np.flatnonzero((count > 1) & (ends - start[first] > LONGEST))
                if len(far):
                    long_runs.append((start[first][far], ends[far], name[first][far]))
                base = name[first]
                name = np.where(count > 1, _mix(base * _U(0xD6E8FEB86659FD93) + count.astype(_U)), base)
                start, fixed = start[first], fixed[first]
                active = (np.diff(start, append=n) <= most) & ~fixed
        left = (name * _U((0xA24BAED4963EE407 + 0x9FB21C651E98DF24 * (r + 1) * 2) % (1 << 64)) >> _U(63)) == 0
        heads = np.flatnonzero(active[:-1] & active[1:] & left[:-1] & ~left[1:])
        name[heads] = _mix(name[heads] * _U(0xC2B2AE3D27D4EB4F) ^ (name[heads + 1] + _U(0x165667B19E3779F9)))
        keep = np.ones(len(name), dtype=bool)
        keep[heads + 1] = False
        name, start, fixed = name[keep], start[keep], fixed[keep]
    name[fixed] = np.iinfo(np.uint64).max
    return name, start, value, long_runs


def _least_in_windows(name: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Indices of the symbols that are the least of a window of WINDOW characters starting at a boundary."""
    ends = np.append(start[1:], n)
    order = (name >> _U(_INDEX_BITS) << _U(_INDEX_BITS)) | np.arange(len(name), dtype=_U)
    last = np.searchsorted(ends, start + WINDOW, "right")
    width = last - np.arange(len(name))
    whole = np.flatnonzero((width > 0) & (start + WINDOW <= n))
    if not len(whole):
        return np.empty(0, dtype=np.int64)
    level = np.floor(np.log2(width[whole])).astype(np.int64)
    out, table, step = [], order, 1
    for k in range(int(level.max()) + 1):
        at = whole[level == k]
        if len(at):
            out.append(np.minimum(table[at], table[last[at] - step]))
        if len(table) > step:
            table = np.minimum(table[:-step], table[step:])
        step *= 2
    chosen = np.unique(np.concatenate(out)) & _U((1 << _INDEX_BITS) - 1)
    return np.unique(chosen).astype(np.int64)


def anchors(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document index, key, start in the document, length) of the anchors of the documents at ``offsets`` (with the end last).

    Documents are parted by one character each, so document i is codes[offsets[i] : offsets[i + 1] - 1].
    """
    n = len(codes)
    breaks = offsets[1:] - 1
    name, start, value, runs = symbols(codes, breaks)
    chosen = _least_in_windows(name, start, n)
    ends = np.append(start[1:], n)
    a, b = start[chosen] - CONTEXT, ends[chosen] + CONTEXT
    kinds = np.zeros(len(a), dtype=_U)
    doc = np.searchsorted(offsets, start[chosen], "right") - 1
    ok = (a >= offsets[doc]) & (b <= offsets[doc + 1] - 1)
    a, b, doc, kinds = a[ok], b[ok], doc[ok], kinds[ok]
    up, down = _power_tables(n)
    prefix = np.concatenate((np.zeros(1, dtype=_U), np.cumsum(value * up[:n])))
    key = _mix((prefix[b] - prefix[a]) * down[a] + (b - a).astype(_U) * _U(0x9FB21C651E98DF25))
    parts = [(doc, key, a - offsets[doc], b - a)]
    for at, end, base in runs:
        d = np.searchsorted(offsets, at, "right") - 1
        for mark, place in ((1, at), (2, end)):
            parts.append((d, _mix(base + _U(mark)), place - offsets[d], np.zeros(len(d), dtype=np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchor_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, texts = batch["doc_id"].to_numpy(), batch["text"].tolist()
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
                size += len(texts[j]) + 1
                j += 1
            part = texts[i:j]
            for doc, key, at, length in _anchor_chunks(part):
                yield pd.DataFrame({"key": key.astype(np.int64), "doc_id": ids[i:j][doc], "start_at": at.astype(np.int32), "width": length.astype(np.int32)}).drop_duplicates()
            i = j


def _anchor_chunks(texts: list[str]):
    """Anchors of texts that fit a chunk together, or of one longer text in overlapping chunks."""
    if len(texts) == 1 and len(texts[0]) >= CHUNK:
        text, lap = texts[0], 2 * (SPAN + CONTEXT + LONGEST)
        for at in range(0, len(text), CHUNK - lap):
            piece = text[at : at + CHUNK]
            doc, key, start, width = _of_texts([piece])
            # Next to an artificial end symbols may differ; the next or previous chunk has those places inside.
            inside = (start >= (lap // 4 if at else 0)) & (start + width <= (len(piece) - lap // 4 if at + CHUNK < len(text) else len(piece)))
            yield doc[inside], key[inside], start[inside] + at, width[inside]
    else:
        yield _of_texts(texts)


def _of_texts(texts: list[str]):
    codes = np.frombuffer(("\x00".join(texts) + "\x00").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return anchors(codes, offsets)


def _common(x: str, y: str) -> int:
    """Length of the common beginning, by halving whole slices."""
    low, high = 0, min(len(x), len(y))
    if x[:high] == y[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _reach(x: str, i: int, y: str, j: int) -> tuple[int, int]:
    """How far two texts agree to the left of places i, j, and to the right."""
    return _common(x[:i][::-1], y[:j][::-1]), _common(x[i:], y[j:])


_SPANS = "doc_id_a bigint, doc_id_b bigint, start_a int, start_b int, span_chars int"


def shared_spans(documents: DataFrame, least: int = SPAN) -> DataFrame:
    """Common spans of at least ``least`` (SPAN or more) characters: doc_id_a < doc_id_b, start_a, start_b (0-based), span_chars.

    One row per pair and anchor; a span longer than its anchor's surroundings is given in overlapping parts that together are all of it.
    ``documents``: doc_id bigint (unique) and text; null and shorter texts share nothing; white space and letter case
    count; very long texts are read whole in overlapping chunks; repeated rows of one id share nothing with each other; copies
    share one span of their length; an empty table gives no rows; other columns are ignored.
    """
    if least < SPAN:
        raise ValueError(f"spans under {SPAN} characters may have no anchor")
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.length("text") >= least)
    found = cut(spread(docs).mapInPandas(_anchor_batches, "key bigint, doc_id bigint, start_at int, width int"))
    groups = found.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key", "n")
    shared = found.join(groups, "key").groupBy("doc_id").agg(F.collect_list(F.struct("key", "start_at", "width", "n")).alias("places"))

    def surroundings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, places in b[["doc_id", "text", "places"]].itertuples(index=False, name=None):
                for p in places:
                    at, width = p["start_at"], p["width"]
                    need = max(0, least - width)
                    lo = max(0, at - need)
                    rows.append((p["key"], doc, at, width, p["n"], at - lo, text[lo : at + width + need]))
            yield pd.DataFrame(rows, columns=["key", "doc_id", "start_at", "width", "n", "lead", "around"])

    schema = "key bigint, doc_id bigint, start_at int, width int, n bigint, lead int, around string"
    places = cut(docs.join(shared, "doc_id").mapInPandas(surroundings, schema))

    def compared(x: tuple, y: tuple) -> tuple | None:
        """x, y: (doc_id, start_at, lead, around)."""
        left, right = _reach(x[3], x[2], y[3], y[2])
        if left + right < least:
            return None
        return (x[0], y[0], x[1] - left, y[1] - left, left + right)

    def within_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for members in b["members"]:
                m = sorted((x["doc_id"], x["start_at"], x["lead"], x["around"]) for x in members)
                for i, x in enumerate(m):
                    for y in m[i + 1 :]:
                        if x[0] != y[0] and (row := compared(x, y)):
                            rows.append(row)
            yield pd.DataFrame(rows, columns=["doc_id_a", "doc_id_b", "start_a", "start_b", "span_chars"])

    member = F.struct("doc_id", "start_at", "lead", "around")
    small = places.where(F.col("n") <= SMALL_GROUP).groupBy("key").agg(F.collect_list(member).alias("members")).mapInPandas(within_groups, _SPANS)

    # Large groups: equal keys of least - GRAIN characters first, for each amount of reach to the left.
    reach = F.lit(least - GRAIN)
    large = places.where(F.col("n") > SMALL_GROUP).withColumn("extra", F.greatest(reach - F.col("width"), F.lit(0)))
    large = large.withColumn("to_left", F.explode(F.sequence(F.lit(0), F.col("extra") + GRAIN, F.lit(GRAIN)))).withColumn("to_left", F.least("to_left", "extra"))
    begin = F.col("lead") - F.col("to_left") + 1
    large = large.where((begin >= 1) & (begin + F.greatest(reach, F.col("width")) - 1 <= F.length("around")))
    large = large.withColumn("long_key", F.xxhash64("key", "to_left", F.substring("around", begin, F.greatest(reach, F.col("width")))))
    large = large.select("long_key", "doc_id", "start_at", "lead", "around").dropDuplicates(["long_key", "doc_id", "start_at"])
    one = large.select("long_key", F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("salt"), member.alias("x"))
    two = large.select("long_key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), member.alias("y"))
    met = one.join(two, ["long_key", "salt"]).where("x.doc_id < y.doc_id").select("x", "y")

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = (compared((x["doc_id"], x["start_at"], x["lead"], x["around"]), (y["doc_id"], y["start_at"], y["lead"], y["around"])) for x, y in zip(b["x"], b["y"], strict=True))
            yield pd.DataFrame([r for r in pairs if r], columns=["doc_id_a", "doc_id_b", "start_a", "start_b", "span_chars"])

    return small.unionByName(met.mapInPandas(verified, _SPANS))


def shared_parts(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """How much of each document also occurs in others: doc_id, n_chars, shared_chars, shared_ratio. Documents sharing nothing have 0."""
    sides = spans.select(F.col("doc_id_a").alias("doc_id"), F.col("start_a").alias("a"), (F.col("start_a") + F.col("span_chars")).alias("b")).unionByName(
        spans.select(F.col("doc_id_b").alias("doc_id"), F.col("start_b").alias("a"), (F.col("start_b") + F.col("span_chars")).alias("b")))
    # Distinct spans of one document are bounded by its length, so the union of intervals is a fold over its own array.
    ordered = sides.distinct().groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("s"))
    zero = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("to"))
    folded = F.aggregate("s", zero, lambda acc, x: F.struct(
        (acc["covered"] + F.greatest(x["b"] - F.greatest(x["a"], acc["to"]), F.lit(0))).alias("covered"), F.greatest(acc["to"], x["b"]).alias("to")))
    covered = ordered.select("doc_id", folded["covered"].alias("shared_chars"))
    sizes = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.length("text").alias("n_chars"))
    joined = sizes.join(covered, "doc_id", "left").fillna(0, ["shared_chars"])
    return joined.withColumn("shared_ratio", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)))
