"""Long spans that stand verbatim in more than one document, by repeated-phrase automata.

1. Every window of ``least`` characters is represented by one of the phrases of ``PHRASE`` characters in it, the one
   with the smallest hash, so two documents that share a window also share its phrase. Phrases that
   occur in more than one document are the recurring ones.
2. Recurring phrases are cut from one document each, divided into shards and compiled into Aho-Corasick automata.
   Every document that holds a recurring phrase is streamed through the automata of its shards.
3. Around each occurrence the windows that contain it are compared: equal windows are shared spans.

No step compares documents with each other; each window is looked up by its own hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.common import HOT_SHARE, col, hot_keys
from assaylake.session import Scratch

LEAST = 160
PHRASE = 96
#: Phrases per automaton and characters streamed through one copy of it.
SHARD_PHRASES = 4096
PART_CHARS = 4_000_000
#: Characters that are hashed at once.
CHUNK = 1 << 18
#: Buckets of the bitmap of recurring phrases that all tasks get: 2 MB whatever the data. Once it is
#: crowded it lets more phrases through to the exact join, which decides alone.
BUCKET_BITS = 24
#: A phrase or window is joined by broadcast beyond this many rows and HOT_SHARE of all rows.
HOT_ROWS = 100_000
#: Members of a span that meet in one task when pairs are formed; more are dealt to blocks.
BLOCK_MEMBERS = 2_000

_U = np.uint64
#: Odd multipliers of the hash, and another set for a second, independent hash.
_FIRST = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xBF58476D1CE4E5B9))
_SECOND = (_U(0xC2B2AE3D27D4EB4F), _U(0x94D049BB133111EB), _U(0xA0761D6478BD642F))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def run_hashes(cp: np.ndarray, length: int, by: tuple[np.uint64, np.uint64, np.uint64] = _FIRST) -> np.ndarray:
    """A 64-bit hash of every run of ``length`` code points, by doubling."""
    _A, _B, _C = by
    n = len(cp) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, size, out, done = cp.astype(np.uint64), 1, None, 0
    power += _U(1)
    power *= _A
    power ^= power >> _U(31)
    while True:
        if length & size:
            if out is None:
                out, done = power.copy(), size
            else:
                m = min(len(out), len(power) - done)
                nxt = out[:m] * _B
                nxt += power[done : done + m]
                nxt ^= nxt >> _U(29)
                nxt *= _C
                out, done = nxt, done + size
        size *= 2
        if size > length:
            break
        m = len(power) - size // 2
        nxt = power[:m] * _A
        nxt += power[size // 2 : size // 2 + m]
        nxt ^= nxt >> _U(32)
        nxt *= _C
        power = nxt
    out ^= out >> _U(32)
    return out[:n]


def chosen_phrases(cp: np.ndarray, ends: np.ndarray, least: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the phrases that represent the windows of some texts written one after another.

    ``ends`` has for each position the end of its text; windows don't reach over it.
    """
    h = run_hashes(cp, phrase)
    span = least - phrase + 1
    if len(h) < span:
        return np.zeros(0, dtype=np.int64), h[:0]
    bits = max(1, int(len(h)).bit_length())
    v = (h >> _U(bits)) << _U(bits)
    v |= np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if size < span:
        v = np.minimum(v[: len(v) - (span - size)], v[span - size :])
    at = np.arange(len(v))
    low = (v & _U((1 << bits) - 1)).astype(np.int64)[ends[: len(v)] - at >= least]
    low = low[np.r_[True, low[1:] != low[:-1]]] if len(low) else low
    return low, h[low]


def phrases_of(texts: list[str], least: int, phrase: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text index, position, hash) of the chosen phrases, in pieces of bounded memory; repeats may occur between pieces."""
    held: list[tuple[int, int, str]] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lens = np.array([len(t) for _, _, t in held])
        stops = np.cumsum(lens)
        low, h = chosen_phrases(code_points("".join(t for _, _, t in held)), np.repeat(stops, lens), least, phrase)
        k = np.searchsorted(stops, low, side="right")
        return np.array([i for i, _, _ in held])[k], low - (stops - lens)[k] + np.array([o for _, o, _ in held])[k], h

    for i, t in enumerate(texts):
        for o in range(0, max(len(t) - least + 1, 0), CHUNK):
            piece = t[o : o + CHUNK + least - 1]
            held.append((i, o, piece))
            size += len(piece)
            if size >= CHUNK:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _recurring(docs: DataFrame, least: int, phrase: int) -> DataFrame:
    """(h, rep) of the phrases that more than one document holds; rep is the smallest id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            for k, _, h in phrases_of(pdf["text"].tolist(), least, phrase):
                yield pd.DataFrame({"h": h.view(np.int64), "id": ids[k]})

    found = docs.mapInPandas(run, f"h bigint, id {dict(docs.dtypes)['id']}")
    both = found.groupBy("h").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    return both.where("rep <> last").select("h", "rep")


def _bitmap(recurring: DataFrame, bits: int) -> np.ndarray:
    """A bit for every bucket that holds a recurring phrase; 2 ** bits bits, whatever the data."""
    bucket = F.pmod(F.col("h"), F.lit(1 << bits))
    words = recurring.groupBy(F.shiftright(bucket, 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(h, 32) as int))")).alias("b")).toPandas()
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    out[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.uint32)
    return out


def _holders(docs: DataFrame, recurring: DataFrame, least: int, phrase: int, bits: int) -> DataFrame:
    """(id, text, n, found: array of (h, h2, pos)) of the documents with phrases whose bucket recurs; h2 is a second, independent hash."""
    shipped = docs.sparkSession.sparkContext.broadcast(_bitmap(recurring, bits))
    mask = (1 << bits) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shipped.value
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["id"].to_numpy()
            hs: dict[int, list] = {}
            for k, p, h in phrases_of(texts, least, phrase):
                b = (h & _U(mask)).astype(np.int64)
                ok = np.flatnonzero((words[b >> 5] >> (b & 31).astype(np.uint32)) & np.uint32(1))
                for i, x, y in zip(k[ok].tolist(), h[ok].view(np.int64).tolist(), p[ok].tolist(), strict=True):
                    second = xxhash.xxh3_64_intdigest(texts[i][y : y + phrase].encode("utf-8", "surrogatepass"))
                    hs.setdefault(i, []).append((x, second - (1 << 64) if second >> 63 else second, y))
            if hs:
                cut = lambda j: [[x[j] for x in v] for v in hs.values()]
                yield pd.DataFrame({"id": ids[list(hs)], "text": [texts[i] for i in hs], "hs": cut(0), "h2s": cut(1), "ps": cut(2)})

    out = docs.mapInPandas(run, f"id {dict(docs.dtypes)['id']}, text string, hs array<bigint>, h2s array<bigint>, ps array<bigint>")
    return out.select("id", "text", F.arrays_zip("hs", "h2s", "ps").alias("found"))


def _with_frequent(rows: DataFrame, keyed: DataFrame, keys: list[str], rows_in_all: int, hot_rows: int) -> DataFrame:
    """``rows`` joined with ``keyed`` (unique keys, ``n`` their rows): the few keys with very many rows by broadcast, at most 1 / HOT_SHARE, the others by shuffle."""
    if rows_in_all <= hot_rows:
        # No key of a table this small is hot.
        return rows.join(keyed.hint("merge"), keys)
    often = F.col("n") > max(hot_rows, rows_in_all * HOT_SHARE)
    hot = F.broadcast(keyed.where(often))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(keyed.where(~often).hint("merge"), keys)
    return rows.join(hot, keys).unionByName(cold)


def _streams(hits: DataFrame, holders: DataFrame, phrase: int, shard_phrases: int, part_chars: int, hot_rows: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Rows (shard, part, parts, kind, id, h, text): the phrases of each shard (kind 0), then its documents (kind 1); and the number of shards.

    A phrase recurs if two documents hold it by both hashes. A shard takes phrases that stand near each other in the document they are cut from, so that a
    document with a copied passage meets few shards. Shards with many documents are dealt to several parts,
    each with its own copy of the phrases.
    """
    keyed = hits.groupBy("h", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("rep <> last").drop("last")
    keyed = scratch.write(keyed, "phrases")
    shards = max(1, -(-keyed.count() // shard_phrases))
    n_hits = hits.count()
    met = scratch.write(_with_frequent(hits.withColumnRenamed("n", "chars"), keyed, ["h", "h2"], n_hits, hot_rows), "hits")
    own = met.where("id = rep").groupBy("h", "h2", "rep").agg(F.min("pos").alias("pos"), F.max("n").alias("n"))
    own = own.withColumn("shard", F.pmod(F.xxhash64("rep", F.expr("pos div 65536")), F.lit(shards)).cast("int"))
    meets = _with_frequent(met.select("h", "h2", "id", "chars"), own.select("h", "h2", "shard", "n"), ["h", "h2"], n_hits, hot_rows).select("id", "chars", "shard").distinct()
    parts = meets.groupBy("shard").agg(F.ceil(F.sum("chars") / part_chars).cast("int").alias("parts"))
    meets = meets.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    copies = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = own.join(copies, "shard").select(F.col("rep").alias("id"), F.struct("shard", "part", "parts", F.lit(0).alias("kind"), "h", "pos").alias("to"))
    seen = meets.select("id", F.struct("shard", "part", "parts", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("pos")).alias("to"))
    # A document's row is joined once; only its own phrases and shards are listed beside it.
    lists = cut.unionByName(seen).groupBy("id").agg(F.collect_list("to").alias("to"))
    rows = holders.select("id", "text").join(lists.hint("merge"), "id").select("id", "text", F.explode("to").alias("to"))
    text = F.when(F.col("to.kind") == 0, F.substring(F.col("text"), F.col("to.pos").cast("int") + 1, F.lit(phrase))).otherwise(F.col("text"))
    return rows.select("to.shard", "to.part", "to.parts", "to.kind", "id", "to.h", text.alias("text")), shards


def _windows(streams: DataFrame, least: int, phrase: int, interior: bool) -> DataFrame:
    """(w, w2, before, id, start, stop) of the windows around occurrences of recurring phrases.

    w and w2 are two independent hashes of the window, ``before`` is the hash of the window one character earlier. Where
    a shard is one part, all documents with a phrase are in it, and windows that nothing shares are dropped
    at once; so are windows inside spans, which tell no new pair. With ``interior`` the shared characters are told instead: intervals (id, start,
    stop) of what two documents of one part share, with w NULL, and, where a shard has several parts, one row for every
    different window of a part, with a NULL id if two of its documents hold it.
    """
    id_type = dict(streams.dtypes)["id"]
    whole_ids = id_type in ("tinyint", "smallint", "int", "bigint")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, automaton, ready, one = None, None, False, True
        held: list[tuple] = []

        def windows(doc: object, text: str) -> tuple | None:
            top = len(text) - least
            # Windows start at most this far before the end of a phrase that they hold.
            runs: list[list[int]] = []
            for end, _ in automaton.iter(text):
                a, b = max(0, end + 1 - least), min(top, end + 1 - phrase)
                if runs and a <= runs[-1][1] + 1:
                    runs[-1][1] = max(b, runs[-1][1])
                elif a <= b:
                    runs.append([a, b])
            if not runs:
                return None
            w, w2, before, starts = [], [], [], []
            for a, b in runs:
                lo = max(0, a - 1)
                cp = code_points(text[lo : b + least])
                h = run_hashes(cp, least)
                w.append(h[a - lo :])
                w2.append(run_hashes(cp[a - lo :], least, _SECOND))
                # A window at the very beginning has nothing before it, which differs from document to document.
                first = [_U(xxhash.xxh3_64_intdigest(f"{doc}"))] if a == 0 else h[:1]
                before.append(np.concatenate([first, h[: len(h) - 1] if a == 0 else h[1 : len(h) - 1]]).astype(np.uint64))
                starts.append(np.arange(a, b + 1))
            return np.concatenate(w), np.concatenate(w2), np.concatenate(before), np.concatenate(starts)

        def close() -> pd.DataFrame | None:
            if not held:
                return None
            w, w2, before, starts = (np.concatenate([x[j] for x in held]) for j in (1, 2, 3, 4))
            which = np.repeat(np.arange(len(held)), [len(x[1]) for x in held])
            if interior:
                return covered(w, w2, starts, which)
            keep = np.arange(len(w))
            if one:
                order = np.argsort(w, kind="stable")  # stable: documents stay in order within a window
                sw, sd, sb = w[order], which[order], before[order]
                first = np.flatnonzero(np.r_[True, sw[1:] != sw[:-1]])
                size = np.diff(np.r_[first, len(sw)])
                good = sd[first] != sd[first + size - 1]
                good &= np.minimum.reduceat(sb, first) != np.maximum.reduceat(sb, first)
                keep = order[np.repeat(good, size)]
            if not len(keep):
                return None
            keep.sort()
            ids = np.array([x[0] for x in held])
            return pd.DataFrame({"w": w[keep].view(np.int64), "w2": w2[keep].view(np.int64), "before": before[keep].view(np.int64), "id": ids[which[keep]], "start": starts[keep], "stop": starts[keep] + least})

        def covered(w: np.ndarray, w2: np.ndarray, starts: np.ndarray, which: np.ndarray) -> pd.DataFrame:
            order = np.lexsort((w2, w))  # stable: documents stay in order within a window
            sw, sv, sd = w[order], w2[order], which[order]
            first = np.flatnonzero(np.r_[True, (sw[1:] != sw[:-1]) | (sv[1:] != sv[:-1])])
            size = np.diff(np.r_[first, len(sw)])
            many = sd[first] != sd[first + size - 1]
            at = np.sort(order[np.repeat(many, size)])
            ids = pd.array([x[0] for x in held], dtype="Int64" if whole_ids else "object")
            cuts = np.flatnonzero(np.r_[True, (which[at][1:] != which[at][:-1]) | (starts[at][1:] != starts[at][:-1] + 1)]) if len(at) else at
            begin, end = at[cuts], at[np.r_[cuts[1:] - 1, len(at) - 1]] if len(at) else at
            frames = [pd.DataFrame({"w": pd.array([None] * len(begin), dtype="Int64"), "w2": pd.array([None] * len(begin), dtype="Int64"), "id": ids.take(which[begin]), "start": starts[begin], "stop": starts[end] + least})]
            if not one:
                lone, rep = order[np.repeat(~many, size)], order[first[many]]
                for rows, own in ((lone, ids.take(which[lone])), (rep, pd.array([None] * len(rep), dtype=ids.dtype))):
                    frames.append(pd.DataFrame({"w": pd.array(w[rows].view(np.int64), dtype="Int64"), "w2": pd.array(w2[rows].view(np.int64), dtype="Int64"), "id": own, "start": starts[rows], "stop": starts[rows] + least}))
            out = pd.concat([f for f in frames if len(f)] or frames[:1], ignore_index=True)
            return out.assign(before=pd.array([None] * len(out), dtype="Int64"))[["w", "w2", "before", "id", "start", "stop"]]

        for pdf in batches:
            for shard, part, parts, kind, doc, h, text in zip(*(pdf[c] for c in ("shard", "part", "parts", "kind", "id", "h", "text")), strict=True):
                if (shard, part) != group:
                    if (out := close()) is not None:
                        yield out
                    group, automaton, ready, one, held, size = (shard, part), ahocorasick.Automaton(), False, parts == 1, [], 0
                if kind == 0:
                    automaton.add_word(text, h)
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                if (got := windows(doc, text)) is not None:
                    held.append((doc, *got))
                    size += len(text)
                if not one and size > PART_CHARS:
                    if (out := close()) is not None:
                        yield out
                    held, size = [], 0
        if (out := close()) is not None:
            yield out

    return streams.mapInPandas(run, f"w bigint, w2 bigint, before bigint, id {id_type}, start bigint, stop bigint")


def _found(docs: DataFrame, row_id: str, text: str, least: int, interior: bool, shard_phrases: int, part_chars: int, bits: int, hot_rows: int, scratch: Scratch) -> DataFrame:
    phrase = min(PHRASE, least)
    rows = docs.select(col(row_id).alias("id"), col(text).alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= least))
    recurring = scratch.write(_recurring(rows, least, phrase), "recurring")
    holders = scratch.write(_holders(rows, recurring, least, phrase, bits), "holders")
    hits = holders.select("id", F.length("text").alias("n"), F.explode("found").alias("f")).select("id", "n", F.col("f.hs").alias("h"), F.col("f.h2s").alias("h2"), F.col("f.ps").alias("pos"))
    streams, shards = _streams(hits, holders, phrase, shard_phrases, part_chars, hot_rows, scratch)
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, 2 * shards)
    streams = streams.repartition(tasks, "shard", "part").sortWithinPartitions("shard", "part", "kind", "id")
    windows = scratch.write(_windows(streams, least, phrase, interior), "windows")
    scratch.drop("recurring", "holders", "phrases", "hits")
    return windows


def shared_windows(
    docs: DataFrame, row_id: str, text: str, least: int = LEAST, shard_phrases: int = SHARD_PHRASES, part_chars: int = PART_CHARS, bits: int = BUCKET_BITS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(w, w2, before, id, start) of the windows with which a span begins that some pair of documents shares, as a written table.

    Texts are compared as they are, code point by code point. NULL ids and texts are left out, texts shorter than
    ``least`` share nothing, very long texts are hashed in pieces that overlap, repeats within one
    document don't count, a repeated id counts as one document, an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    windows = _found(docs, row_id, text, least, False, shard_phrases, part_chars, bits, hot_rows, scratch).drop("stop")
    kept = windows.groupBy("w", "w2").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min("before").alias("c"), F.max("before").alias("d"), F.count(F.lit(1)).alias("n"))
    kept = scratch.write(kept.where("a <> b and c <> d").select("w", "w2", "n"), "kept")
    out = scratch.write(_with_frequent(windows, kept, ["w", "w2"], windows.count(), hot_rows).drop("n").distinct(), "shared")
    scratch.drop("windows", "kept")
    return out


def shared_members(docs: DataFrame, row_id: str, text: str, least: int = LEAST, **how: int) -> DataFrame:
    """(span, span2, row id, start): which documents hold which shared span, and where its first ``least`` characters stand in them first.

    A span is named by two hashes of its first ``least`` characters. Two documents share text exactly if they are members of one
    span; nothing is expanded into pairs. What is empty, NULL or too short is treated as in ``shared_windows``.
    """
    s = shared_windows(docs, row_id, text, least, **how)
    return s.groupBy(F.col("w").alias("span"), F.col("w2").alias("span2"), F.col("id").alias(row_id)).agg(F.min("start").alias("start"))


def shared_classes(members: DataFrame, row_id: str) -> DataFrame:
    """(span, span2, n_documents, row id, start): one row per span of ``members`` with its first document."""
    first = F.min(F.struct(col(row_id), F.col("start")))
    out = members.groupBy("span", "span2").agg(F.count(F.lit(1)).alias("n_documents"), first.alias("f"))
    return out.select("span", "span2", "n_documents", F.col("f").getField(row_id).alias(row_id), F.col("f.start").alias("start"))


def shared_pairs(docs: DataFrame, row_id: str, text: str, least: int = LEAST, block_members: int = BLOCK_MEMBERS, **how: int) -> DataFrame:
    """(id_a, id_b), the smaller id first, of documents with a common run of at least ``least`` characters.

    Pairs come from the members of each span. The members of a span that very many documents hold are dealt to blocks, and each pair of
    blocks is a key of its own, so no task holds them all.
    """
    s = shared_windows(docs, row_id, text, least, **how).select("w", "w2", "before", "id").distinct()
    hot = F.broadcast(hot_keys(s, ["w", "w2"], block_members).select("w", "w2", "salts"))
    s = s.join(hot, ["w", "w2"], "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    s = s.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    s = s.select("w", "w2", "before", "id", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    a, b = s.alias("a"), s.alias("b").hint("merge")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("w", "w2", "lo", "hi")]
    pairs = a.join(b, [*same, (F.col("a.id") < F.col("b.id")) & (F.col("a.before") != F.col("b.before")) & ((F.col("a.lo") == F.col("a.hi")) | (F.col("a.block") != F.col("b.block")))])
    return pairs.select(F.col("a.id").alias(f"{row_id}_a"), F.col("b.id").alias(f"{row_id}_b")).distinct()


def shared_coverage(docs: DataFrame, row_id: str, text: str, least: int = LEAST, shard_phrases: int = SHARD_PHRASES, part_chars: int = PART_CHARS, bits: int = BUCKET_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(row id, n_chars, shared_chars, shared_share) of every document with an id; texts that are NULL have 0 characters."""
    scratch = Scratch(docs.sparkSession)
    windows = _found(docs, row_id, text, least, True, shard_phrases, part_chars, bits, hot_rows, scratch)
    parts = windows.where("w is not null")
    # A window that one part holds in one document only is shared if another part holds it in another document.
    both = parts.groupBy("w", "w2").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.max(F.col("id").isNull()).alias("many")).where("many or a <> b").select("w", "w2")
    lone = parts.where("id is not null").join(both.hint("merge"), ["w", "w2"], "left_semi").select("id", "start", "stop")
    spans = windows.where("w is null").select("id", "start", "stop").unionByName(lone).distinct()
    reach = F.max("stop").over(Window.partitionBy("id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("stop") - F.greatest(F.col("start"), F.coalesce(reach, F.lit(0))), F.lit(0))
    covered = spans.withColumn("new", new).groupBy("id").agg(F.sum("new").alias("shared_chars"))
    sizes = docs.where(col(row_id).isNotNull()).groupBy(col(row_id).alias("id")).agg(F.max(F.coalesce(F.length(col(text)), F.lit(0))).cast("long").alias("n_chars"))
    out = sizes.join(covered, "id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0).cast("long")))
    return out.select(F.col("id").alias(row_id), "n_chars", "shared_chars", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)).alias("shared_share"))
