"""Near-duplicate documents: one-permutation hashing, banded buckets, star-shaped candidate edges.

A document is its set of distinct five-word shingles (the whole word sequence, if it has
fewer words). One 64-bit hash of each shingle is the only permutation: its top bits name one
of ``BINS`` bins, and the least hash of each bin is the signature; empty bins take the value
of a filled bin through a fixed random sequence per bin (optimal densification). ``BANDS``
bands of ``BINS / BANDS`` values give the buckets.

Documents with equal sets are one node from the start. A bucket gives one candidate edge per
member, to its centre. Edges whose signatures can't belong to the threshold are left out
(``SLACK``; pairs with a small set are compared by their hashes), the others are confirmed on the
full sets. A star can miss a link between two
members that aren't linked to the centre, so that buckets with members of several components
are looked at again, in blocks of bounded size: each pair of members from different
components is compared by signature inside a task, and only possible ones leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from pageloom.functions.core import join_facts
from pageloom.llm.tables import components, saved
from pageloom.llm.words import Hasher, mix, spaced_words, text_chunks, words_of
from pageloom.session import ship_by_value

ship_by_value(__name__)

WORDS = 5
BINS = 128
BANDS = 32
#: Bins of the second signature, of one byte each, by which candidates are compared before their texts are read.
SKETCH = 1024
#: A pair at the threshold agrees in 0.75 of these bins, give or take 0.015 at most; more than five times that may be lacking.
SLACK = 0.08
#: Sets up to this size are compared by 32 bits of each hash, exactly: a sketch says little of them.
SMALL = SKETCH // 4
BLOCK_ROWS = 2048


def shingle_sets(texts, table: np.ndarray, hasher: Hasher) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = words_of(texts, table, hasher)
    counts = np.bincount(words.row, minlength=texts.rows)
    stops = np.cumsum(counts)
    h = words.hash
    n = len(h) - WORDS + 1
    if n > 0:
        full = np.zeros(n, np.uint64)
        for k in range(WORDS):
            full = mix(full + h[k:k + n] + np.uint64(k + 1))
    out = []
    for stop, count in zip(stops.tolist(), counts.tolist()):
        if count >= WORDS:
            out.append(np.unique(full[stop - count:stop - WORDS + 1]))
        elif count:
            one = np.full(1, count + 100, np.uint64)
            for k in range(stop - count, stop):
                one = mix(one + h[k:k + 1])
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def donors(bins: int) -> np.ndarray:
    """The fixed random sequence of bins that each empty bin asks."""
    return np.random.default_rng(20240607).integers(0, bins, (1024, bins))


def signature(hashes: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Least hash of each bin; empty bins take another bin's value."""
    bins = asked.shape[1]
    edges = np.arange(bins, dtype=np.uint64) << np.uint64(64 - bins.bit_length() + 1)
    at = np.searchsorted(hashes, edges)
    filled = np.diff(at, append=len(hashes)) > 0
    value = hashes[np.minimum(at, len(hashes) - 1)]
    if not filled.all():
        empty = np.flatnonzero(~filled)
        for part in (asked[:32], asked):
            hit = filled[part[:, empty]]
            found = hit.any(axis=0)
            which = part[hit.argmax(axis=0), empty]
            value[empty[found]] = value[which[found]]
            empty = empty[~found]
            if not len(empty):
                break
        value[empty] = hashes[0]
    return value


def band_keys(values: np.ndarray) -> np.ndarray:
    """64-bit bucket key of each band, for rows of signatures."""
    width = BINS // BANDS
    parts = values.reshape(len(values), BANDS, width)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(width):
        key = mix(key + parts[:, :, k])
    return key


def _hashes(sig: bytes, size: int) -> np.ndarray:
    """The 32-bit hashes in the signature of a set; a sketch may come before them."""
    return np.frombuffer(sig, np.uint32, offset=0 if size <= SMALL else SKETCH)


def _possible(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether pairs of sets, each as its hashes, may reach the threshold: hashes that collide only add to what is common."""
    nx, ny = np.array([len(h) for h in x]), np.array([len(h) for h in y])
    key = lambda h, n: (np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(32)) | np.concatenate(h).astype(np.uint64)
    hit = np.isin(key(x, nx), key(y, ny))
    common = np.bincount(np.repeat(np.arange(len(nx)), nx)[hit], minlength=len(nx))
    return 100 * common >= percent * (nx + ny - common)


FINGERPRINTS = "doc_id bigint, n_shingles bigint, set_hash bigint, sig binary, keys array<bigint>"


def fingerprints(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, set_hash, sig, keys)`` of ``docs(doc_id, text)``; empty sets have no keys.

    ``sig`` holds 8 bits of the value of each of ``SKETCH`` bins, if the set is larger than ``SMALL``,
    then 32 bits of each hash, if a set of ``SMALL`` can be linked with it.
    """
    hashed = 100 * SMALL // max(percent, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hasher, asked, asked_more = spaced_words(), Hasher(), donors(BINS), donors(SKETCH)
        for batch in batches:
            ids = batch.column(0)
            for texts in text_chunks(batch.column(1)):
                sets = shingle_sets(texts, table, hasher)
                sizes = np.array([len(s) for s in sets])
                set_hash = np.array([mix(mix(s).sum(keepdims=True) + np.uint64(len(s)))[0] if len(s) else 0 for s in sets], np.uint64)
                some = np.flatnonzero(sizes)
                values = np.array([signature(sets[i], asked) for i in some], np.uint64).reshape(-1, BINS)
                sigs, keys = [None] * len(sets), [None] * len(sets)
                for i, k in zip(some.tolist(), band_keys(values).astype(np.int64)):
                    sketch = mix(signature(sets[i], asked_more)).astype(np.uint8).tobytes() if sizes[i] > SMALL else b""
                    sigs[i], keys[i] = sketch + (sets[i].astype(np.uint32).tobytes() if sizes[i] <= hashed else b""), k
                yield pa.RecordBatch.from_arrays([
                    ids.slice(texts.first_row, texts.rows), pa.array(sizes, pa.int64()),
                    pa.array(set_hash.astype(np.int64)), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                ], ["doc_id", "n_shingles", "set_hash", "sig", "keys"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, FINGERPRINTS)


def _shared(members: DataFrame) -> DataFrame:
    """``(key, node, crowd)`` of the rows of ``members(key, node)`` whose bucket has another member.

    Keys are range-partitioned, so that a bucket that most documents share spreads over tasks.
    ``crowd`` is the size of the bucket as far as one Arrow batch sees it, and a row at the edge
    of a batch is kept in any case: a lone member is harmless later on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            if not len(keys):
                continue
            cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
            crowd = np.repeat(np.diff(cuts), np.diff(cuts))
            keep = crowd > 1
            keep[0] = keep[-1] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(crowd, pa.int64())], ["key", "node", "crowd"]).filter(pa.array(keep))

    parts = members.repartitionByRange("key", "node").sortWithinPartitions("key")
    return parts.mapInArrow(run, "key bigint, node bigint, crowd bigint")


def _stars(members: DataFrame) -> DataFrame:
    """Spokes ``(key, centre, node)`` of each bucket of ``members(key, node, crowd)``: the centre and every other member.

    The centre is the member that shares most places with others over all its buckets: an original
    shares more buckets with each of its copies than they do among themselves. Buckets are cut at
    the borders of range partitions; each part has its own centre, and the parts' centres form a star.
    """
    rank = members.groupBy("node").agg(F.sum("crowd").alias("_places")).select("node", (-F.col("_places")).alias("rank"))
    parts = join_facts(members.select("key", "node"), rank, "node", "inner").withColumn("tie", F.xxhash64("node"))
    parts = parts.repartitionByRange("key", "rank", "tie", "node").sortWithinPartitions("key", "rank", "tie", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = centre = None

        def rows(keys, centres, nodes):
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(centres, pa.int64()), pa.array(nodes, pa.int64())], ["key", "centre", "node"])

        opened = False
        for batch in batches:
            keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            new = np.empty(len(keys), np.bool_)
            new[0] = key is None or keys[0] != key
            new[1:] = keys[1:] != keys[:-1]
            at = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
            centres = np.where(at < 0, centre if centre is not None else 0, nodes[at])
            if not opened:  # the first bucket may go on from the part before
                yield rows(keys[:1], nodes[:1], nodes[:1])
                opened = True
            key, centre = int(keys[-1]), int(centres[-1])
            spoke = centres != nodes
            yield rows(keys[spoke], centres[spoke], nodes[spoke])
        if opened:  # the last bucket may go on in the part after
            yield rows([key], [centre], [centre])

    spokes = saved(parts.select("key", "node").mapInArrow(run, "key bigint, centre bigint, node bigint"), "spokes")
    ends = spokes.where("centre = node").select("key", "node").distinct()
    first = ends.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = ends.join(first.select("key", "centre"), "key").where("centre <> node").select("key", "centre", "node")
    return spokes.where("centre <> node").unionByName(joined)


def _agreeing(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures don't rule out the threshold."""
    sigs = nodes.select(F.col("doc_id").alias("node"), "n_shingles", "sig")
    left = sigs.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    least = _least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                sa, sb = (batch.column(c).to_pylist() for c in ("sa", "sb"))
                na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
                keep = np.zeros(n, np.bool_)
                small = np.minimum(na, nb) <= SMALL
                if small.any():
                    i = np.flatnonzero(small)
                    keep[i] = _possible([_hashes(sa[k], na[k]) for k in i], [_hashes(sb[k], nb[k]) for k in i], percent)
                i = np.flatnonzero(~small)
                x, y = (np.frombuffer(b"".join(s[k][:SKETCH] for k in i), np.uint8).reshape(-1, SKETCH) for s in (sa, sb))
                keep[i] = (x == y).sum(axis=1) >= least
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _least_agreement(percent: int) -> int:
    return int(SKETCH * (percent / 100 - SLACK))


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold; ``texts`` hold the documents of all pairs."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hasher = spaced_words(), Hasher()
        for batch in batches:
            a, ta = batch.column(0).to_numpy(), batch.column("ta")
            if not len(a):
                continue
            other = (a[1:] != a[:-1]) | pc.not_equal(ta[1:], ta[:-1]).to_numpy(zero_copy_only=False).astype(bool)
            fresh = np.flatnonzero(np.r_[True, other])  # rows mostly come sorted by a: its set is made once per run
            sets = [
                [s for t in text_chunks(column) for s in shingle_sets(t, table, hasher)]
                for column in (ta.take(pa.array(fresh)), batch.column("tb"))
            ]
            which = np.searchsorted(fresh, np.arange(len(a)), side="right") - 1
            keep = []
            for i, y in enumerate(sets[1]):
                x = sets[0][which[i]]
                at = np.searchsorted(x, y)
                common = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) and len(y) else 0
                keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # merge joins at every size: a hot document's rows can be split, and no text is broadcast
    both = pairs.distinct().join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of the documents in some pairs."""
    ids = pairs.select(F.col("a").alias("doc_id")).distinct().union(pairs.select(F.col("b").alias("doc_id")).distinct()).distinct()
    return saved(docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi"), "texts")


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _across(spokes: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Possible pairs between different components of a bucket, found in blocks of bounded size."""
    inner = spokes.select("key", F.col("centre").alias("node")).distinct().union(spokes.select("key", "node")).distinct()
    facts = nodes.select(F.col("doc_id").alias("node"), "n_shingles", "sig", "keys").join(
        labels.select(F.col("id").alias("node"), "component_id"), "node", "left")
    facts = facts.withColumn("component_id", F.coalesce("component_id", "node"))
    members = saved(inner.join(facts.select("node", "component_id"), "node"), "members")
    buckets = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("component_id").alias("lo"), F.max("component_id").alias("hi")
    ).where("lo <> hi").select("key", "size")
    open_ = saved(join_facts(members, saved(buckets, "buckets"), "key", "inner"), "open")
    parts = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    rows = open_.join(facts.select("node", "n_shingles", "sig", "keys"), "node").withColumn("parts", parts).withColumn(
        "part", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                       "part", "node", "component_id", "n_shingles", "sig", "keys")
    least = _least_agreement(percent)

    def compare(block: pa.Table) -> pa.RecordBatch:
        node, comp, size = (block.column(c).to_numpy() for c in ("node", "component_id", "n_shingles"))
        part = block.column("part").to_numpy()
        i, j = block.column("i")[0].as_py(), block.column("j")[0].as_py()
        sig = block.column("sig").to_pylist()
        large = np.flatnonzero(size > SMALL)
        sigs = np.zeros((len(node), SKETCH), np.uint8)
        sigs[large] = np.frombuffer(b"".join(sig[k][:SKETCH] for k in large), np.uint8).reshape(-1, SKETCH)
        # all hashes of the sets that have them, sorted, with the row of each
        sets = [_hashes(s, n) for s, n in zip(sig, size)]
        hashes = np.concatenate(sets)
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], np.repeat(np.arange(len(node)), [len(h) for h in sets])[order]
        keys = np.concatenate([c.flatten().to_numpy() for c in block.column("keys").chunks]).reshape(len(node), BANDS)
        band = (keys == block.column("key")[0].as_py()).argmax(axis=1)
        out = []
        for x in np.flatnonzero(part == i):
            other = (part == j) & (comp != comp[x]) & (node > node[x] if i == j else True)
            other &= 100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x])
            y = np.flatnonzero(other)
            if len(y):
                exact = np.minimum(size[y], size[x]) <= SMALL
                keep = np.zeros(len(y), np.bool_)
                if exact.any():
                    lo, hi = np.searchsorted(hashes, sets[x], side="left"), np.searchsorted(hashes, sets[x], side="right")
                    at = np.repeat(hi - np.cumsum(hi - lo), hi - lo) + np.arange((hi - lo).sum())
                    common = np.bincount(owner[at], minlength=len(node))[y]
                    keep = exact & (100 * common >= percent * (size[y] + size[x] - common))
                far = np.flatnonzero(~exact)
                keep[far] = (sigs[y[far]] == sigs[x]).sum(axis=1) >= least
                y = y[keep]
                y = y[(keys[y] == keys[x]).argmax(axis=1) == band[x]]  # a pair leaves the first bucket that it shares, no other
                out.append(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], axis=1))
        pairs = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the block that is still open: two parts of about BLOCK_ROWS at most
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            if not len(keys):
                continue
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for k, (start, stop) in enumerate(zip(cuts, cuts[1:])):
                piece = batch.slice(start, stop - start)
                if held and (k or any(held[-1].column(c)[-1] != piece.column(c)[0] for c in ("key", "i", "j"))):
                    yield compare(pa.Table.from_batches(held))
                    held = []
                held.append(piece)
        if held:
            yield compare(pa.Table.from_batches(held))

    spread = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return spread.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs(doc_id, text)``.

    Documents whose sets have ``100 * intersection >= percent * union`` are linked; a component
    carries its smallest doc_id, and that document is kept. Null and empty texts and texts
    without words have an empty set and no links. Repeated rows with one doc_id and one text
    are one document (each row keeps its own line here); rows that share a doc_id but differ
    are linked through it. A null doc_id links with equal sets only and never names a component
    that has another id; it stays null otherwise. Other columns of ``docs`` aren't read.
    """
    prints = saved(fingerprints(docs, percent), "fingerprints")
    whole = F.struct("doc_id", "n_shingles", "sig", "keys")
    nodes = saved(
        prints.where("n_shingles > 0 and doc_id is not null").groupBy("set_hash", "n_shingles")
        .agg(F.min(whole).alias("x")).select("set_hash", "x.doc_id", "x.n_shingles", "x.sig", "x.keys"), "nodes")
    members = saved(_shared(nodes.select(F.explode("keys").alias("key"), F.col("doc_id").alias("node"))), "shared")
    spokes = _stars(members)
    stars = saved(_agreeing(_ordered(spokes, "centre", "node").distinct(), nodes, percent), "candidates")
    links = saved(_confirmed(stars, _texts(docs, stars), percent), "links")
    labels = components(links)
    others = saved(_across(spokes, nodes, labels, percent).distinct(), "candidates")
    more = _confirmed(others, _texts(docs, others), percent)
    labels = components(links.union(more))
    classes = nodes.select("set_hash", F.col("n_shingles").alias("n"), F.col("doc_id").alias("id")).join(labels, "id", "left").select(
        "set_hash", "n", F.coalesce("component_id", "id").alias("component_id"))
    classes = saved(classes, "classes")
    rows = prints.select("doc_id", "n_shingles", "set_hash")
    facts = classes.select(F.concat_ws(":", "set_hash", "n").alias("set"), "component_id")
    found = join_facts(rows.withColumn("set", F.concat_ws(":", "set_hash", "n_shingles")), facts, "set")
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each component of near-duplicates, with the columns of ``docs``.

    Repeated rows of a kept document leave one row. Rows without a doc_id all stay.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), percent).where("kept and doc_id is not null").select("doc_id").distinct()
    plain = [F.to_json(c) if t.startswith(("map", "variant")) else F.col(f"`{c}`") for c, t in docs.dtypes]
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.xxhash64(*plain).alias("_tie"))
    some = rows.where("_id is not null").join(kept.withColumnRenamed("doc_id", "_id"), "_id", "left_semi")
    first = Window.partitionBy("_id").orderBy("_tie")
    some = some.withColumn("_k", F.row_number().over(first)).where("_k = 1").select("row.*")
    return some.unionByName(rows.where("_id is null").select("row.*"))
