"""Near-duplicate texts by bottom-k sketches from one hash function.

The set of a text's word shingles is hashed by one function. Shingles are ranked by how common they are in the whole collection
(a power of two, from a table of counts of fixed size), then by hash; the sketch of a text is the k first of its shingles in that order,
k growing with the text. Inverted lists lead from each of the first n - ceil(0.8 n) + 1 retained values of a set of n to the texts that retain it:
two sets that share 80 % of their union have the first of their common values there, both of them. Pairs from the lists are left out
where sizes, places or the parities of the sets refute the threshold, then filtered on the union of their sketches: as far as both sketches reach in the common
order, all differences show, and more of them than the threshold allows refute the pair. What is left is verified exactly on the texts.
No step loses a pair.

A list that is longer than `list_limit` is split by the next common value of its pairs, which is one place further at most, up to three values;
where splitting costs more than pairing, and what is still too long, is paired in blocks spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.lookalikes import not_blank
from ledgerloom.llm.textstream import WordStreams, chunks, mix
from ledgerloom.operators.scratch import Scratch

_ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)
_BUCKETS = 1 << 20
_CHUNK = 1 << 12
_LEVELS = 3  # common values that a list may be split by
_BLOCK = 512  # owners of a block of a list that is paired whole
_ROW = 64  # pairs compared for the price of a row sent


def shingle_sets(streams: WordStreams, size: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of the distinct shingles of every text with enough words, docs ascending."""
    docs, words = streams.word_hashes()
    enough = np.bincount(docs, minlength=streams.n) >= max(size, least_words)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - size + 1)
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h += words[k : k + n] * _ODD[k % len(_ODD)] if k < len(_ODD) else mix(words[k : k + n], seed=k)
    own = (docs[:n] == docs[size - 1 :]) & enough[docs[:n]] if n else np.zeros(0, bool)
    doc, h = docs[:n][own], mix(h[own], seed=11)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[fresh], h[fresh]


def _short(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def common_shingles(texts: DataFrame, size: int, least_words: int) -> np.ndarray:
    """log2 of the number of texts with a shingle, for 2^20 buckets of shingles. The table has one size whatever the collection;
    tasks send their counts in 256 chunks that are summed by chunk."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BUCKETS, np.int64)
        for batch in batches:
            for _, some in chunks(batch.column(0)):
                _, h = shingle_sets(WordStreams(some), size, least_words)
                total += np.bincount(_short(h) >> 12, minlength=_BUCKETS)
        parts = [total[i : i + _CHUNK].astype("<u4").tobytes() for i in range(0, _BUCKETS, _CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, "<u4").astype(np.int64)
        bits = [np.ceil(np.log2(s + 1)).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], names=["chunk", "counts"])

    kind = "chunk int, counts binary"
    table = np.zeros(_BUCKETS, np.uint8)
    for row in texts.select("text").mapInArrow(count, kind).repartition("chunk").mapInArrow(add, kind).collect():  # 256 rows of 4 KB
        table[row["chunk"] * _CHUNK : (row["chunk"] + 1) * _CHUNK] = np.frombuffer(row["counts"], np.uint8)
    return table


def _ranks(short: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (table[short >> 12].astype(np.int64) << 32) | short.astype(np.int64)


def sketches(texts: DataFrame, table: np.ndarray, size: int, least_words: int, share: float, extra: int, threshold: float) -> DataFrame:
    """(id, class, n, sketch, odd_0, odd_1) of texts with enough words: hash of the word sequence, size of the shingle set, its first ranks in
    order, and for each of 128 parts of the hashes whether the set has an odd number there."""
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks_of = sent.value
        for ids, some in ((batch.column(0).slice(at, len(some)), some) for batch in batches for at, some in chunks(batch.column(1))):
            streams = WordStreams(some)
            doc, h = shingle_sets(streams, size, least_words)
            if not len(doc):
                continue
            high, low = streams.text_hashes()
            rank = _ranks(_short(h), ranks_of)
            n = np.bincount(doc, minlength=streams.n)
            starts = np.cumsum(n) - n
            bit = np.uint64(1) << (h & np.uint64(63))
            odd = [np.bitwise_xor.reduceat(np.where((h >> np.uint64(6)) & np.uint64(1) == k, bit, np.uint64(0)), starts[n > 0]).view(np.int64) for k in range(2)]
            order = np.lexsort((rank, doc))
            doc, rank = doc[order], rank[order]
            # what the lists need is there whatever the share
            kept = np.arange(len(doc)) - starts[doc] < np.maximum(np.ceil(share * n) + extra, n - np.ceil(threshold * n - 1e-9) + _LEVELS)[doc]
            doc, rank = doc[kept], rank[kept]
            own = np.nonzero(n)[0]
            ends = np.cumsum(np.bincount(doc, minlength=streams.n)[own])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(rank.astype(np.uint32).view(np.int32)))
            both = np.stack([high[own], low[own]], 1).astype(">u8").tobytes()
            classes = pa.array([both[i : i + 16] for i in range(0, len(both), 16)], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), classes, pa.array(n[own], pa.int32()), lists, *map(pa.array, odd)], names=["id", "class", "n", "sketch", "odd_0", "odd_1"])

    return texts.select("id", "text").mapInArrow(run, "id string, class binary, n int, sketch array<int>, odd_0 bigint, odd_1 bigint")


def _lists_to_pairs(lists: DataFrame, limit: int | None, threshold: float, level: int) -> DataFrame:
    """(a, b, key, n, at, odd_0, odd_1) from lists (key, owner, n, at, odd_0, odd_1): pairs a < b of a list's owners, with at -1, or, of lists
    beyond the limit, if there is one, rows (owner, owner, key, n, at, odd_0, odd_1).

    A key is of `level` values, the last of them at place `at` of the owner's order. Of the pairs those are left out that can't reach the threshold: by set
    sizes, by what is left behind the places (true of a pair's first common values, and so of one of its lists), or
    by the shingles that must be apart where the parities of the sets differ.
    The rows are sorted by key and streamed, so a list never has to fit in memory: as soon as it is too long it flows through."""
    slack = (1 - threshold) / (1 + threshold)
    names = ["a", "b", "key", "n", "at", "odd_0", "odd_1"]
    types = (*[pa.int64()] * 3, *[pa.int32()] * 2, *[pa.int64()] * 2)

    def result(*columns):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        flowing = None
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(6)]
            if rest is not None and len(rest[0]):
                rows = [np.concatenate(x) for x in zip(rest, rows)]
            rest = None
            if flowing is not None:  # the list that is too long goes on
                end = np.searchsorted(rows[0], flowing, "right")
                if end:
                    yield long([x[:end] for x in rows])
                rows = [x[end:] for x in rows]
                if len(rows[0]):
                    flowing = None
            if not len(rows[0]):
                continue
            last = np.searchsorted(rows[0], rows[0][-1], "left")
            yield from pairs([x[:last] for x in rows])
            rest = [x[last:] for x in rows]
            if limit is not None and len(rest[0]) > limit:
                flowing = rest[0][0]
                yield long(rest)
                rest = None
        if rest is not None:
            yield from pairs(rest)

    def long(rows):
        key, owner, *other = rows
        return result(owner, owner, key, *other)

    def pairs(rows):
        key = rows[0]
        if not len(key):
            return
        starts = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1])
        sizes = np.diff(np.append(starts, len(key)))
        most = sizes.max() if limit is None else limit
        big = np.repeat(sizes > most, sizes)
        if big.any():
            yield long([x[big] for x in rows])
        small = ~big & np.repeat(sizes > 1, sizes)
        key, owner, n, at, odd_0, odd_1 = (x[small] for x in rows)
        n = n.astype(np.int64)
        found = []
        for step in range(1, most):
            i = np.nonzero(key[step:] == key[:-step])[0]
            if not len(i):
                break
            j = i + step
            total = n[i] + n[j]
            apart = sum(np.bitwise_count((x[i] ^ x[j]).view(np.uint64)).astype(np.int64) for x in (odd_0, odd_1))
            good = (owner[i] != owner[j]) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9) & (apart <= slack * total + 1e-9)
            good &= level - 1 + np.minimum(n[i] - at[i], n[j] - at[j]) >= threshold / (1 + threshold) * total - 1e-9
            x, y = owner[i[good]], owner[j[good]]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
        if found:
            both = np.unique(np.concatenate(found), axis=0)
            none = np.zeros(len(both), np.int64)
            yield result(both[:, 0], both[:, 1], none, none, none - 1, none, none)

    own = lists.select("key", "owner", "n", "at", "odd_0", "odd_1").repartition("key").sortWithinPartitions("key")
    return own.mapInArrow(run, "a bigint, b bigint, key bigint, n int, at int, odd_0 bigint, odd_1 bigint")


def _block_pairs(lists: DataFrame, threshold: float, level: int) -> DataFrame:
    """(a, b) of the pairs of each list that _lists_to_pairs() doesn't refute, made in pairs of blocks of owners spread over tasks."""
    # the number of a list's blocks follows its size
    sizes = lists.groupBy("key").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("m"))
    placed = lists.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("owner"), F.col("m")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return _lists_to_pairs(spread.withColumn("key", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))), None, threshold, level).select("a", "b")


def _candidates(classes: DataFrame, scratch: Scratch, limit: int, threshold: float) -> DataFrame:
    """(a, b): owners (the classes' short ids) of all pairs that reach the threshold, and of few others.

    The k-th common value of such a pair is among the first n - ceil(threshold * n) + k of each side's order, so each pair stands in the list of its first
    common value, in that of its first two, and so on, as long as it has so many in common."""
    needed = F.ceil(F.col("n") * threshold - 1e-9).cast("int")
    reach = lambda level: F.least(F.col("n"), F.col("n") - needed + level)
    odd = ("odd_0", "odd_1")
    lists = classes.select("owner", "n", *odd, F.posexplode(F.slice("sketch", 1, reach(1))).alias("at", "value")).select(F.xxhash64("value").alias("key"), "owner", "n", "at", *odd)
    pairs = None
    for level in range(1, _LEVELS + 1):
        found = scratch.save(_lists_to_pairs(lists, limit, threshold, level))
        own = found.where("at < 0").select("a", "b")
        pairs = own if pairs is None else pairs.unionByName(own)
        long = found.where("at >= 0").select("key", F.col("a").alias("owner"), "n", "at", *odd)
        if long.isEmpty():
            break
        # a list is split by the next common value where that makes fewer rows than its pairs are worth
        rows = F.sum((reach(level + 1) - F.col("at") - 1).cast("bigint"))
        split = 2 * _ROW * rows < F.count("*") * F.count("*") if level < _LEVELS else F.lit(False)
        marked = scratch.save(long.join(long.groupBy("key").agg(split.alias("split")), "key"))
        # a pair without a next common value has sets of at most level / threshold values
        pairs = pairs.unionByName(_block_pairs(marked.where(~F.col("split") | (needed <= level)), threshold, level))
        next_ones = marked.where("split")
        if next_ones.isEmpty():
            break
        rest = F.slice("sketch", F.col("at") + 2, F.greatest(F.lit(0), reach(level + 1) - F.col("at") - 1))
        lists = next_ones.join(classes.select("owner", "sketch"), "owner").select("key", "owner", "n", "at", *odd, F.posexplode(rest).alias("step", "value"))
        lists = lists.select(F.xxhash64("key", "value").alias("key"), "owner", "n", (F.col("at") + 1 + F.col("step")).alias("at"), *odd)
    return pairs.distinct()


def _filtered(pairs: DataFrame, classes: DataFrame, table: np.ndarray, threshold: float) -> DataFrame:
    """The pairs whose sketches' union doesn't refute the threshold."""
    sent = classes.sparkSession.sparkContext.broadcast(table)
    side = lambda x: classes.select(F.col("owner").alias(x), F.col("class").alias(f"class_{x}"), F.col("rep").alias(f"rep_{x}"), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    slack = (1 - threshold) / (1 + threshold)
    ratio = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(ratio).select("class_a", "class_b", "rep_a", "rep_b", "n_a", "n_b", "sketch_a", "sketch_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks_of = sent.value
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            own, rank, reach = [], [], []
            for column in (6, 7):
                lists = batch.column(column)
                sizes = np.diff(lists.offsets.to_numpy())
                r = _ranks(lists.flatten().to_numpy().view(np.uint32), ranks_of)
                own.append(np.repeat(np.arange(m), sizes))
                rank.append(r)
                n = batch.column(column - 2).to_numpy()
                ends = np.cumsum(sizes)
                # a sketch that holds the whole set reaches to the end of the order
                reach.append(np.where(sizes >= n, np.iinfo(np.int64).max, r[ends - 1]))
            limit = np.minimum(*reach)
            pair, r = np.concatenate(own), np.concatenate(rank)
            seen = r <= limit[pair]
            pair, r = pair[seen], r[seen]
            order = np.lexsort((r, pair))
            pair, r = pair[order], r[order]
            twin = np.zeros(len(r), bool)
            twin[1:] = (pair[1:] == pair[:-1]) & (r[1:] == r[:-1])
            shared = np.bincount(pair[twin], minlength=m)
            apart = np.bincount(pair, minlength=m) - 2 * shared
            total = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            keep = np.nonzero(apart <= slack * total + 1e-9)[0]
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep)) for i in range(4)], names=["class_a", "class_b", "rep_a", "rep_b"])

    return both.mapInArrow(run, "class_a binary, class_b binary, rep_a string, rep_b string")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """(class_a, class_b) of the pairs whose texts' shingle sets reach the threshold."""
    ends = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("id")).distinct()
    own = texts.join(ends, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    both = pairs.join(own.select(F.col("id").alias("rep_a"), F.col("text").alias("text_a")), "rep_a").join(own.select(F.col("id").alias("rep_b"), F.col("text").alias("text_b")), "rep_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.chunked_array([batch.column(2), batch.column(3)]).combine_chunks().dictionary_encode()
            where, texts = values.indices.to_numpy(), values.dictionary
            found = [(at + doc, h) for at, some in chunks(texts) for doc, h in [shingle_sets(WordStreams(some), size, 0)]]
            doc, h = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            edges = np.searchsorted(doc, np.arange(len(texts) + 1))
            m = batch.num_rows
            good = np.zeros(m, bool)
            for i in range(m):
                a, b = (h[edges[k] : edges[k + 1]] for k in (where[i], where[m + i]))
                shared = len(np.intersect1d(a, b, assume_unique=True))
                good[i] = shared >= threshold * (len(a) + len(b) - shared) - 1e-9
            keep = pa.array(np.nonzero(good)[0])
            yield pa.RecordBatch.from_arrays([batch.column(i).take(keep) for i in range(2)], names=["class_a", "class_b"])

    return both.select("class_a", "class_b", "text_a", "text_b").mapInArrow(run, "class_a binary, class_b binary")


def near_duplicates(rows: DataFrame, scratch: Scratch, text: str = "captured_text", size: int = 3, least_words: int = 30, threshold: float = 0.8, share: float = 0.3, extra: int = 6, list_limit: int = 64) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (class_a, class_b) of classes of texts whose sets of `size` consecutive words share at least
    `threshold` of their union, and members (class, id).

    Texts of one word sequence are one class; pairs are between different classes, each once. Texts of fewer than
    `least_words` words, null and blank ones, and rows without an id have no class; repeated deliveries are one member. Words are those of the
    plain form in lower case. Other columns are not read. No links give empty pairs.
    """
    mark = scratch.mark()
    texts = rows.where(F.col("id").isNotNull() & not_blank(F.col(text))).select("id", F.col(text).alias("text"))
    table = common_shingles(texts, size, least_words)
    all_sketches = scratch.save(sketches(texts, table, size, least_words, share, extra, threshold))
    classes = scratch.save(
        all_sketches.groupBy("class").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "sketch", "odd_0", "odd_1")))
        .withColumn("owner", F.xxhash64("class"))
    )
    members = scratch.save(all_sketches.select("class", "id").distinct())
    pairs = scratch.save(_filtered(_candidates(classes, scratch, list_limit, threshold), classes, table, threshold))
    verified = scratch.save(_verified(pairs, texts, size, threshold))
    scratch.release(mark, verified, members)
    return verified, members


def near_duplicate_records(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(id_a, id_b): see p2_found in TESTDATA.md; near_duplicates() with its classes expanded to records."""
    pairs, members = near_duplicates(rows, scratch)
    one = members.select(F.col("class").alias("class_a"), F.col("id").alias("x"))
    two = members.select(F.col("class").alias("class_b"), F.col("id").alias("y"))
    return pairs.join(one, "class_a").join(two, "class_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a <> id_b").distinct()
