"""Removal of long repeated strings by blockwise suffix sorting with a difference cover.

A byte goes when it lies in a string of ``length`` bytes that also starts earlier (in a
document with a smaller key, or before in the same one). Suffixes are dealt into buckets by
the smallest hash of the ``GRAM``-byte grams in their first ``length`` bytes: equal strings
fall into one bucket, and neighbouring suffixes mostly into the same, so they travel as
runs and not one by one.

1. Runs travel as fingerprints. Of equal runs all but the first are repeated as a whole.
   A run without another one of the same smallest hash holds no repeated string. Runs that a
   task met twice wait in it to its end, so a frequent run is sent once by a task.
2. Where the different runs of one smallest hash hold more than ``hot`` bytes, they are cut
   by the place of that gram in the string (``SPLITS`` places together, at last one by one)
   and keyed by the bytes that all strings of a part share. The parts are treated as runs
   were in 1. A part of one place is its string, so this ends.
3. The first ones of different runs with the same smallest hash are taken from the texts
   again and sorted, one bucket at a time; buckets are made by the bytes that reach them.
   Ranks of 32-byte strings are made for a bucket by doubling, and from them the ranks of
   the cover sample: the places whose number modulo ``PERIOD`` is in ``COVER``. Any two
   places have a common shift below the period that brings both into the sample. Suffixes
   are sorted by their first and last 32 bytes, and a longer tie is resolved by the sample
   ranks at the common shift. So memory and time do not depend on how long the repeats are.

The driver sees counts only. Spans meet the texts by key at the end. A text of more than
``PIECE_BYTES`` is worked on in parts that overlap by a string, so that no more is held of it
than its own bytes.

Defined results: null texts are empty. Texts shorter than ``length`` stay. Rows with the
same key are ordered by the checksum of their text; a row that repeats key and text is the
same document. Rows without a key stay as they are.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, functions as F

from srcframe.llm.common import pieces, stored
from srcframe.session import broadcast_if_small


@dataclasses.dataclass(frozen=True)
class Settings:
    length: int = 100
    # runs in a bucket of the first pass, about
    bucket: int = 400_000
    # bytes in a bucket that is sorted, about; the sort needs some sixty times as much
    sorted_bytes: int = 1 << 20
    # bytes of different runs with one smallest hash above which they are cut further
    hot: int = 1 << 20


GRAM = 32
# Places of the gram that are taken together, round by round, where a hash is hot.
SPLITS = (9, 1)
# Bytes of text worked on at a time; numpy needs some eighty times as much.
PIECE_BYTES = 2 << 20
# Every residue is the difference of two of the cover modulo the period.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)

# n suffixes from ``at`` on, whose smallest gram stands ``gram`` bytes after ``at``
RUN = [("least", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("sum", "<u4"), ("at", "<u4"), ("n", "<u2"), ("gram", "<u2")]
SPAN = [("doc", "<i8"), ("sum", "<u4"), ("start", "<u4"), ("end", "<u4")]
WANTED = [("doc", "<i8"), ("sum", "<u4"), ("at", "<u4"), ("n", "<u2"), ("gram", "<u2"), ("least", "<u8")]
# Runs that a task keeps to its end.
WAITING = 200_000
SPANS, SORTED, HOT = 0, 1, 2
STEP = 0x9E3779B97F4A7C15
UNSTEP = pow(STEP, -1, 1 << 64)


def _mixed(x):
    import numpy as np

    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def runs(blob, lengths, length: int):
    """Runs of suffixes with the same smallest gram, of several texts laid end to end.

    Gives arrays: number of the text, place in it, how many suffixes, smallest hash, a
    fingerprint of all bytes that the run's strings cover, and the gram's place in the run.
    """
    import numpy as np

    n = len(blob)
    none = *[np.empty(0, np.int64)] * 3, *[np.empty(0, np.uint64)] * 2, np.empty(0, np.int64)
    if n < length:
        return none
    table = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP))
    grams, width, power = table[blob], 1, STEP
    while width < GRAM:
        grams = grams[:-width] * np.uint64(power) + grams[width:]
        width, power = width * 2, power * power % (1 << 64)
    least = _mixed(grams)
    place = np.arange(len(least), dtype=np.int32)
    inside, width = length - GRAM + 1, 1  # grams in a string

    def lower(a, a_place, b, b_place):  # the first of equal ones
        right = b < a
        return np.where(right, b, a), np.where(right, b_place, a_place)

    while width * 2 <= inside:
        least, place = lower(least[:-width], place[:-width], least[width:], place[width:])
        width *= 2
    if inside > width:
        more = inside - width
        least, place = lower(least[:-more], place[:-more], least[more:], place[more:])
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[:len(least)]
    valid = np.arange(len(least)) + length <= ends[text]
    first = valid.copy()
    first[1:] &= (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return none
    stops = np.flatnonzero(valid & np.r_[first[1:] | ~valid[1:], True])
    count = stops - starts + 1
    powers, back = _powers(n)
    summed = np.zeros(n + 1, np.uint64)
    np.cumsum(table[blob] * powers[:n], out=summed[1:])
    content = (summed[stops + length] - summed[starts]) * back[starts]
    owner = text[starts]
    return (owner, starts - (ends - lengths)[owner], count, least[starts], _mixed(content + count.astype(np.uint64)),
            place[starts] - starts)


def _powers(n: int):
    """Powers of the step and of its inverse, kept for the next piece."""
    import numpy as np

    from srcframe.llm.common import per_worker

    held = per_worker(("suffix powers",), dict)
    if len(held.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, step in (("up", STEP), ("down", UNSTEP)):
            factors = np.full(size, step, np.uint64)
            factors[0] = 1
            held[name] = np.multiply.accumulate(factors)
    return held["up"], held["down"]


def _dealt(values, bucket, kind: int | None = None):
    """Structured values as packed rows by bucket."""
    import numpy as np
    import pyarrow as pa

    turn = np.argsort(bucket, kind="stable")
    values, bucket = values[turn], bucket[turn]
    full, first = np.unique(bucket, return_index=True)
    bounds = np.r_[first, len(values)]
    columns = [pa.array(full.astype(np.int64)), pa.array([values[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())]
    names = ["bucket", "packed"]
    if kind is not None:
        columns.append(pa.array(np.full(len(full), kind, np.int32)))
        names.append("kind")
    return pa.RecordBatch.from_arrays(columns, names=names)


def _by_document(values, owners: int):
    """The bucket of a document: one of as many in every pass."""
    import numpy as np

    return (_mixed(values["doc"].astype(np.uint64)) % np.uint64(owners)).astype(np.int64)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    held = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(key).cast("bigint").alias("_doc"), held.alias("_text"))


def _pieces(batches, length: int):
    """Texts, piece by piece: bytes end to end, lengths, keys, checksums and places of the parts.

    A long text comes in parts; each holds the strings that start in it.
    """
    import zlib

    import numpy as np

    for whole in batches:
        for batch in pieces(whole, "_text", PIECE_BYTES):
            parts = []
            for doc, text in zip(batch.column("_doc").to_pylist(), batch.column("_text")):
                data = memoryview(text.as_buffer())
                total = zlib.crc32(data)
                parts += [(data[at:at + PIECE_BYTES + length - 1], doc, total, at) for at in range(0, len(data), PIECE_BYTES)]
            while parts:
                size = taken = 0
                while taken < len(parts) and (not taken or size + len(parts[taken][0]) <= 2 * PIECE_BYTES):
                    size, taken = size + len(parts[taken][0]), taken + 1
                held, parts = parts[:taken], parts[taken:]
                blob = np.frombuffer(b"".join(p[0] for p in held), np.uint8)
                numbers = [np.array([p[i] for p in held], np.int64) for i in (1, 2, 3)]
                yield blob, np.array([len(p[0]) for p in held], np.int64), *numbers


class Firsts:
    """Runs of a task: the first of equal ones, and spans of the others."""

    def __init__(self, length: int):
        import numpy as np

        self.length, self.waiting = length, np.empty(0, RUN)

    def add(self, found):
        """Runs to send now and spans to delete; runs met twice wait."""
        import numpy as np

        firsts, spans, often = _split_equal(np.concatenate([self.waiting, found]), self.length, len(self.waiting))
        self.waiting = firsts[often]
        if len(self.waiting) > WAITING:
            self.waiting, out = self.waiting[:0], firsts
        else:
            out = firsts[~often]
        return out, spans


def _split_equal(found, length: int, known: int = 0):
    """The first of equal runs, merged spans of the rest, and which of the first were met twice.

    The first ``known`` rows were met twice before.
    """
    import numpy as np

    often = np.zeros(len(found), bool)
    often[:known] = True
    turn = np.lexsort((found["at"], found["sum"], found["doc"], found["content"], found["least"]))
    found, often = found[turn], often[turn]
    least, content = found["least"], found["content"]
    again = np.zeros(len(found), bool)
    again[1:] = (least[1:] == least[:-1]) & (content[1:] == content[:-1])
    heads = np.flatnonzero(~again)
    leader = np.maximum.accumulate(np.where(~again, np.arange(len(found)), 0))
    # a repeat of the first place, by a repeated row, is no later place
    as_first = (found["doc"] == found["doc"][leader]) & (found["sum"] == found["sum"][leader]) & (found["at"] == found["at"][leader])
    repeated = found[again & ~as_first]
    spans = np.empty(len(repeated), SPAN)
    for name in ("doc", "sum"):
        spans[name] = repeated[name]
    spans["start"], spans["end"] = repeated["at"], repeated["at"] + repeated["n"].astype(np.int64) + (length - 1)
    twice = np.add.reduceat(again | often, heads) > 0 if len(heads) else np.empty(0, bool)
    return found[heads], merged(spans), twice


def _sent(found, spans, buckets: int, owners: int):
    """Runs by hash, and spans by document under numbers below zero, as rows of one shuffle."""
    import numpy as np
    import pyarrow as pa

    least = found["least"].astype(np.uint64)
    return pa.Table.from_batches([
        _dealt(found, (_mixed(least) % np.uint64(buckets)).astype(np.int64)),
        _dealt(spans, -1 - _by_document(spans, owners))]).to_batches()


def _meet(settings: Settings, owners: int, last: bool):
    """Equal runs of a bucket, from all tasks; different runs of one hash go on."""
    length, hot = settings.length, settings.hot

    def meet(table):
        import numpy as np
        import pyarrow as pa

        below = table.column("bucket")[0].as_py() < 0
        packed = table.column("packed").to_pylist()
        del table
        if below:
            spans = merged(np.concatenate([np.frombuffer(p, SPAN) for p in packed]))
            return pa.Table.from_batches([_dealt(spans, _by_document(spans, owners), SPANS)])
        found = np.concatenate([np.frombuffer(p, RUN) for p in packed])
        del packed
        firsts, spans, _ = _split_equal(found, length)
        del found
        starts = np.flatnonzero(np.r_[True, firsts["least"][1:] != firsts["least"][:-1]])
        sizes = np.diff(np.r_[starts, len(firsts)])
        held = np.add.reduceat(firsts["n"].astype(np.int64) + (length - 1), starts)
        wanted = np.empty(len(firsts), WANTED)
        for name in ("doc", "sum", "at", "n", "gram", "least"):
            wanted[name] = firsts[name]
        # at the last split runs of one hash are one string
        mixed, hotter = np.repeat((sizes > 1) & (not last), sizes), np.repeat(held > hot, sizes)
        cold, warm = wanted[mixed & ~hotter], wanted[mixed & hotter]
        return pa.Table.from_batches([
            _dealt(spans, _by_document(spans, owners), SPANS), _dealt(cold, _by_document(cold, owners), SORTED),
            _dealt(warm, _by_document(warm, owners), HOT)])

    return meet


def _first_pass(docs: DataFrame, key: str, text: str, settings: Settings, buckets: int) -> DataFrame:
    length = settings.length

    def run(batches):
        import numpy as np

        firsts = Firsts(length)
        for blob, lengths, keys, sums, begin in _pieces(batches, length):
            owner, at, count, least, content, gram = runs(blob, lengths, length)
            found = np.empty(len(owner), RUN)
            found["doc"], found["sum"], found["at"] = keys[owner], sums[owner], at + begin[owner]
            found["n"], found["gram"], found["least"], found["content"] = count, gram, least, content
            yield from _sent(*firsts.add(found), buckets, buckets)
        yield from _sent(firsts.waiting, np.empty(0, SPAN), buckets, buckets)

    packed = _texts(docs, key, text).where(F.col("_doc").isNotNull()).mapInArrow(run, "bucket bigint, packed binary")
    return packed.groupBy("bucket").applyInArrow(_meet(settings, buckets, False), "bucket bigint, packed binary, kind int")


def parts_of(data: bytes, run, width: int, length: int):
    """Parts of a run by the gram's place in the string: key, fingerprint, start and number of suffixes.

    The key tells the bytes that all strings of such a part share.
    """
    import xxhash

    at, n, gram = int(run["at"]), int(run["n"]), int(run["at"]) + int(run["gram"])
    most = length - GRAM
    for part in range((gram - at - n + 1) // width, (gram - at) // width + 1):
        low, high = part * width, min(part * width + width - 1, most)  # places of the gram
        start, stop = max(at, gram - high), min(at + n - 1, gram - low)
        shared = data[gram - low:gram + length - high]
        seed = (int(run["least"]) ^ part * STEP) & 0xFFFFFFFFFFFFFFFF
        body = data[start:stop + length]
        yield xxhash.xxh3_64_intdigest(shared, seed), xxhash.xxh64_intdigest(body, stop - start + 1), start, stop - start + 1


def _split_pass(docs: DataFrame, wanted: DataFrame, key: str, text: str, settings: Settings, buckets: int, owners: int, width: int) -> DataFrame:
    """Parts of the runs of hot hashes, met like runs."""
    length = settings.length

    def run(batches):
        import numpy as np

        firsts = Firsts(length)
        for batch in batches:
            for data, packed in zip(batch.column("_text").to_pylist(), batch.column("wanted").to_pylist()):
                for some in np.array_split(np.frombuffer(packed, WANTED), -(-len(packed) // (1 << 20)) or 1):
                    rows = []
                    for value in some:
                        gram = int(value["at"]) + int(value["gram"])
                        rows += [
                            (least, content, value["doc"], value["sum"], start, n, gram - start)
                            for least, content, start, n in parts_of(data, value, width, length)]
                    yield from _sent(*firsts.add(np.array(rows, RUN)), buckets, owners)
        yield from _sent(firsts.waiting, np.empty(0, SPAN), buckets, owners)

    packed = _with_wanted(docs, wanted, key, text).mapInArrow(run, "bucket bigint, packed binary")
    return packed.groupBy("bucket").applyInArrow(_meet(settings, owners, width == 1), "bucket bigint, packed binary, kind int")


def _with_wanted(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    texts = _texts(docs, key, text)
    return texts.withColumn("_sum", F.crc32("_text")).join(broadcast_if_small(wanted), ["_doc", "_sum"]).select("_text", "wanted")


def merged(spans):
    """Spans of each document joined where they touch; sorted by document and start."""
    import numpy as np

    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["sum"], spans["doc"]))]
    new_doc = np.r_[True, (spans["doc"][1:] != spans["doc"][:-1]) | (spans["sum"][1:] != spans["sum"][:-1])]
    # ends so far, within a document: a number of the document above the end keeps them apart
    far = np.cumsum(new_doc).astype(np.int64) << 32
    reach = np.maximum.accumulate(far + spans["end"])
    fresh = np.r_[True, (far + spans["start"])[1:] > reach[:-1]]
    starts = np.flatnonzero(fresh)
    out = spans[starts].copy()
    out["end"] = (reach[np.r_[starts[1:] - 1, len(spans) - 1]] & 0xFFFFFFFF).astype(np.uint32)
    return out


def _per_document(rows: DataFrame, dtype: list, name: str) -> DataFrame:
    """``_doc``, ``_sum`` and the values of each document, merged if they are spans."""
    spans = dtype == SPAN

    def meet(table):
        import numpy as np
        import pyarrow as pa

        values = np.concatenate([np.frombuffer(p, dtype) for p in table.column("packed").to_pylist()])
        values = merged(values) if spans else values[np.lexsort((values["at"], values["sum"], values["doc"]))]
        new = np.flatnonzero(np.r_[True, (values["doc"][1:] != values["doc"][:-1]) | (values["sum"][1:] != values["sum"][:-1])])
        bounds = np.r_[new, len(values)]
        return pa.table({
            "_doc": np.ascontiguousarray(values["doc"][new]), "_sum": values["sum"][new].astype(np.int64),
            name: pa.array([values[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
        })

    return rows.select("bucket", "packed").groupBy("bucket").applyInArrow(meet, f"_doc bigint, _sum bigint, {name} binary")


def ranks_of_pairs(left, right):
    """Ranks of pairs, from 0, equal for equal pairs and in their order."""
    import numpy as np

    turn = np.lexsort((right, left))
    a, b = left[turn], right[turn]
    new = np.zeros(len(turn), np.int64)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(turn), np.int64)
    out[turn] = np.cumsum(new)
    return out


def common_shifts():
    """For two residues, the least shift that brings both into the cover."""
    import numpy as np

    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    shift = np.full((PERIOD, PERIOD), -1)
    for a in range(PERIOD):
        for b in range(PERIOD):
            shift[a, b] = next(d for d in range(PERIOD) if inside[(a + d) % PERIOD] and inside[(b + d) % PERIOD])
    return shift


def repeated_suffixes(blob, starts, order, length: int):
    """Which of the suffixes at ``starts`` have an earlier one with the same ``length`` bytes.

    ``order`` are keys of ``starts`` for earlier and later, most important first.
    """
    import numpy as np

    n = len(blob)
    padded = np.zeros(n + length + 8, np.uint8)
    padded[:n] = blob
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n].copy().view(">u8")[:, 0].astype(np.uint64)
    zeros = np.zeros(length, np.int64)
    eight = np.concatenate([words, zeros.astype(np.uint64)])
    del words, padded
    sixteen = np.concatenate([ranks_of_pairs(eight[:n], eight[8:n + 8]), zeros])
    del eight
    ranks = np.concatenate([ranks_of_pairs(sixteen[:n], sixteen[16:n + 16]), zeros])  # of 32 bytes
    del sixteen
    # ranks of the sample: the bytes between the first and the last 32 of a suffix at any shift
    middle = length - PERIOD
    in_cover = np.zeros(PERIOD, bool)
    in_cover[list(COVER)] = True
    sample = np.flatnonzero(in_cover[np.arange(n) % PERIOD])
    pair = ranks_of_pairs(ranks[sample], ranks[sample + middle - 32])
    for shift in range(32, middle - 32, 32):
        pair = ranks_of_pairs(pair, ranks[sample + shift])
    sampled = np.zeros(n + length, np.int64)
    sampled[sample] = pair
    first, last = ranks[starts], ranks[starts + length - 32]
    turn = np.lexsort((*reversed(order), last, first))
    new = np.r_[True, (first[turn][1:] != first[turn][:-1]) | (last[turn][1:] != last[turn][:-1])]
    again = np.zeros(len(starts), bool)
    shifts = common_shifts()
    left, group = turn, np.cumsum(new)  # suffixes still without a class, by tie and age
    while len(left):
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        head = np.repeat(left[heads], np.diff(np.r_[heads, len(left)]))
        mine, its = starts[left], starts[head]
        shift = shifts[mine % PERIOD, its % PERIOD]
        same = sampled[mine + shift] == sampled[its + shift]
        again[left[same & (left != head)]] = True
        left, group = left[~same], group[~same]
    return again


def _second_pass(docs: DataFrame, wanted: DataFrame, key: str, text: str, settings: Settings, buckets: int, owners: int) -> DataFrame:
    length = settings.length

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        rows: dict[str, list] = {"bucket": [], "runs": [], "bytes": []}
        held = 0

        def passed():
            return pa.RecordBatch.from_arrays([
                pa.array(rows["bucket"], pa.int64()), pa.array(rows["runs"], pa.binary()), pa.array(rows["bytes"], pa.binary())],
                names=["bucket", "runs", "bytes"])

        for batch in batches:
            for data, packed in zip(batch.column("_text").to_pylist(), batch.column("wanted").to_pylist()):
                values = np.frombuffer(packed, WANTED)
                bucket = (_mixed(values["least"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                for b in np.unique(bucket):
                    mine = values[bucket == b]
                    rows["bucket"].append(int(b))
                    rows["runs"].append(mine.tobytes())
                    rows["bytes"].append(b"".join(data[v["at"]:int(v["at"]) + int(v["n"]) + length - 1] for v in mine))
                    held += len(rows["bytes"][-1])
                    if held > PIECE_BYTES:
                        yield passed()
                        held = 0
                        for values_ in rows.values():
                            values_.clear()
        yield passed()

    def meet(table):
        import numpy as np
        import pyarrow as pa

        # a repeated row brings the same runs again; they are no earlier strings
        texts = dict(zip(table.column("runs").to_pylist(), table.column("bytes").to_pylist()))
        del table
        held = np.concatenate([np.frombuffer(p, WANTED) for p in texts])
        blob = np.frombuffer(b"".join(texts.values()), np.uint8)
        del texts
        sizes = held["n"].astype(np.int64)
        offsets = np.r_[0, np.cumsum(sizes + length - 1)[:-1]]
        run = np.repeat(np.arange(len(held)), sizes)
        inner = np.arange(len(run)) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        doc, total, at = held["doc"][run], held["sum"][run], held["at"][run] + inner
        again = repeated_suffixes(blob, offsets[run] + inner, (doc, total, at), length)
        spans = np.empty(int(again.sum()), SPAN)
        spans["doc"], spans["sum"] = doc[again], total[again]
        spans["start"], spans["end"] = at[again], at[again] + length
        spans = merged(spans)
        return pa.Table.from_batches([_dealt(spans, _by_document(spans, owners))])

    dealt = _with_wanted(docs, wanted, key, text).mapInArrow(cut, "bucket bigint, runs binary, bytes binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "bucket bigint, packed binary")


def _runs_of(passes: list[DataFrame], kind: int) -> DataFrame:
    out = passes[0].where(F.col("kind") == kind)
    for more in passes[1:]:
        out = out.unionByName(more.where(F.col("kind") == kind))
    return stored(_per_document(out, WANTED, "wanted"))


def _number(total: int, each: int) -> int:
    return max(48, -(-total // each))


def repeated_spans(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_doc``, ``_sum`` and packed merged ``spans`` of the documents that lose bytes."""
    import numpy as np

    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    each = (settings.length - GRAM) // 2  # suffixes in a run, on average
    buckets = _number(total, settings.bucket * each)
    passes = [stored(_first_pass(docs, key, text, settings, buckets))]
    size = np.dtype(WANTED).itemsize
    for width in SPLITS:
        hot = _runs_of(passes[-1:], HOT)
        runs_ = hot.agg(F.sum(F.octet_length("wanted")) / size).first()[0] or 0
        if not runs_:
            break
        parts = _number(int(runs_) * (settings.length // width), settings.bucket)
        passes.append(stored(_split_pass(docs, hot, key, text, settings, parts, buckets, width)))
    cold = _runs_of(passes, SORTED)
    reach = (cold.agg(F.sum(F.octet_length("wanted")) / size).first()[0] or 0) * (settings.length + each)
    second = _second_pass(docs, cold, key, text, settings, _number(int(reach), settings.sorted_bytes), buckets)
    out = second
    for found in passes:
        out = out.unionByName(found.where(F.col("kind") == SPANS).select("bucket", "packed"))
    return _per_document(out, SPAN, "spans")


def dedup(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``kept`` (binary), ``n_bytes``, ``n_removed``, ``n_spans`` and packed ``spans``."""
    spans = stored(repeated_spans(docs, settings, key, text))
    texts = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    texts = texts.withColumn("_doc", F.col(key).cast("bigint")).withColumn("_sum", F.crc32("_text"))
    joined = texts.join(broadcast_if_small(spans), ["_doc", "_sum"], "left").select(key, "_text", "spans")

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for batch in pieces(whole, "_text"):
                kept, removed, count = [], [], []
                for data, packed in zip(batch.column("_text").to_pylist(), batch.column("spans").to_pylist()):
                    gone = np.frombuffer(packed or b"", SPAN)
                    edges = [0, *np.column_stack([gone["start"], gone["end"]]).ravel().tolist(), len(data)]
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    removed.append(len(data) - len(kept[-1]))
                    count.append(len(gone))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(kept, pa.binary()), pa.array([k + r for k, r in zip(map(len, kept), removed)], pa.int64()),
                    pa.array(removed, pa.int64()), pa.array(count, pa.int64()), batch.column("spans"),
                ], names=[key, "kept", "n_bytes", "n_removed", "n_spans", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return joined.mapInArrow(cut, f"`{key}` {kind}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, spans binary")
