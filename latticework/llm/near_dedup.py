"""MinHash near-deduplication over word shingles.

One-permutation hashing fills BINS bins with the smallest hash of a document's shingles in each; empty
bins borrow from a filled one along a fixed random order of their own (optimal densification). Bands of
ROWS bins name buckets. In a bucket a hub is held against the others (a star), never all against all, and
a document is tried with the hub that it shares most buckets with. Pairs whose signatures agree too
little for the threshold leave; the others are confirmed on their full sets, and the links make components. Where a
bucket still holds several components, those outside its largest one are strays: each is tried with a member of
that component, one row a stray and bucket. Rounds of such stars go on while they pay. What is
then still open is finished exactly: blocks of members are held against each other, and every pair of two components
whose signatures agree is confirmed, so that no link inside a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import MULT, forget, mix, pieces, raw, rolled, words, written
from latticework.llm.components import components, joined_up

BINS, ROWS = 160, 5
BANDS = BINS // ROWS
#: Hubs that a document is tried with in a round after the first, each of other buckets.
STARS = 4
#: Rounds of stars end when one links less than a PAYS-th of the documents that it tries. What is left is finished exactly, so that this changes the work and no result.
PAYS = 10
#: Bins of BINS in which the signatures of a pair agree at least; at a similarity of 0.75 fewer agree in one of ten million pairs.
AGREE = 92
#: Members of an open bucket in a block, about; 440 bytes each and then their texts.
BLOCK = 128
_rng = np.random.default_rng(20240229)
#: For each bin the order in which it looks for a filled one.
PROBES = np.stack([_rng.permutation(BINS) for _ in range(BINS)])
SALTS = _rng.integers(1, 1 << 63, BANDS).astype(np.uint64)
SKETCH = "doc_id long, n long, set_key binary, buckets array<long>, signature binary"


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, lower-cased in A-Z. Fewer words than `width` make one shingle."""
    hashes, at, _, _ = words(texts, lower=True)
    out = []
    for s, e in zip(at[:-1], at[1:]):
        if e - s >= width:
            out.append(np.unique(rolled(hashes[s:e], width)))
        elif e > s:
            out.append(rolled(hashes[s:e], e - s) ^ mix(np.array([e - s], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(own: np.ndarray) -> np.ndarray:
    """BINS values of a sorted, non-empty set."""
    bins = (((own >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    filled, values = np.zeros(BINS, bool), np.empty(BINS, np.uint64)
    filled[bins[first]], values[bins[first]] = True, own[first]
    empty = np.flatnonzero(~filled)
    if len(empty):
        probes = PROBES[empty]
        values[empty] = values[probes[np.arange(len(empty)), filled[probes].argmax(axis=1)]]
    return values


def buckets(signatures: np.ndarray) -> np.ndarray:
    """BANDS bucket keys for each row of signatures."""
    bands = signatures.reshape(len(signatures), BANDS, ROWS)
    key = np.broadcast_to(SALTS, bands.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * MULT + bands[:, :, r])
    return key.view(np.int64)


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        sets = shingle_sets(batch.column("text"))
        full = [i for i, s in enumerate(sets) if len(s)]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        named: list = [None] * len(sets)
        short: list = [None] * len(sets)
        if full:
            signed = np.stack([signature(sets[i]) for i in full])
            for i, b, s in zip(full, buckets(signed), mix(signed).astype(np.uint8)):
                named[i], short[i] = b, s.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(named, pa.list_(pa.int64())), pa.array(short, pa.binary())],
            names=["doc_id", "n", "set_key", "buckets", "signature"],
        )


def linked(percent: int):
    """The pairs whose sets meet 100 * intersection >= percent * union."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in pieces(batches, "text", 1 << 20):
            hubs, own = batch.column("hub").to_pylist(), shingle_sets(batch.column("text"))
            sizes = pc.binary_length(batch.column("hub_text")).to_pylist()
            keep = np.zeros(len(hubs), bool)
            for i, (hub, s) in enumerate(zip(zip(hubs, sizes), own)):
                if hub != last[0]:
                    last = (hub, shingle_sets(batch.column("hub_text").slice(i, 1))[0])
                h = last[1]
                both = len(np.intersect1d(h, s, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(h) + len(s) - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("hub").filter(mask), batch.column("doc").filter(mask)], names=["hub", "doc"])

    return confirm


def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("one", "two"))
            mask = pa.array((one == two).sum(axis=1) >= AGREE)
            yield pa.RecordBatch.from_arrays([batch.column("hub").filter(mask), batch.column("doc").filter(mask)], names=["hub", "doc"])


def confirmed(pairs: DataFrame, suspects: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, doc) that are links."""
    signature = suspects.select(F.col("id").alias("i"), "signature")
    both = pairs.join(signature.withColumnRenamed("signature", "one"), F.col("hub") == F.col("i")).select("hub", "doc", "one")
    both = both.join(signature.withColumnRenamed("signature", "two"), F.col("doc") == F.col("i")).select("hub", "doc", "one", "two")
    likely = written(both.mapInArrow(agreeing, "hub long, doc long").distinct(), "likely", narrow=True)
    one, two = (suspects.select(F.col("id").alias("i"), F.col("text").alias(y)) for y in ("text", "hub_text"))
    met = likely.join(one, F.col("doc") == F.col("i")).select("hub", "doc", "text").join(two, F.col("hub") == F.col("i")).select("hub", "doc", "text", "hub_text")
    found = written(met.mapInArrow(linked(percent), "hub long, doc long").distinct(), "found", narrow=True)
    forget(likely)
    return found


def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of two blocks of a bucket, or inside one if `two` is null, that are of different components and agree.

    A pair that meets in several buckets is given in the first of its bands alone.
    """

    def members(rows: pa.ListArray) -> tuple[np.ndarray, ...]:
        flat = rows.flatten()
        doc, component = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in ("doc", "component"))
        named = pc.struct_field(flat, "buckets").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
        return doc, component, raw(pc.struct_field(flat, "signature"))[0].reshape(-1, BINS), named

    for batch in batches:
        one, two, bucket = batch.column("one"), batch.column("two"), batch.column("bucket").to_numpy()
        rows, hubs, docs = [], [], []
        for i in range(batch.num_rows):
            a = members(one.slice(i, 1))
            within = not two[i].is_valid
            b = a if within else members(two.slice(i, 1))
            own: list[tuple[np.ndarray, np.ndarray]] = []
            for k in range(len(a[0])):
                at = k + 1 if within else 0
                like = at + np.flatnonzero(b[1][at:] != a[1][k])
                like = like[np.count_nonzero(b[2][like] == a[2][k], axis=1) >= AGREE]
                if len(like):
                    first = (b[3][like] == a[3][k]).argmax(axis=1)
                    like = like[a[3][k][first] == bucket[i]]
                    own.append((np.full(len(like), a[0][k]), b[0][like]))
            if sum(len(d) for _, d in own):
                rows.append(i)
                hubs.append(np.concatenate([h for h, _ in own]))
                docs.append(np.concatenate([d for _, d in own]))
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(at) for c in ("bucket", "x", "y")), pa.array(hubs, pa.list_(pa.int64())), pa.array(docs, pa.list_(pa.int64()))], names=["bucket", "x", "y", "hubs", "docs"]
        )


def shared_counts(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """How many values each two of the sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, named, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    new = np.cumsum(often > 1) - 1
    owner, named = owner[often[named] > 1], new[named[often[named] > 1]]
    order = np.argsort(named, kind="stable")
    owner, named = owner[order], named[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for lo in range(0, int(named[-1]) + 1 if len(named) else 0, width):
        s, e = np.searchsorted(named, [lo, lo + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[s:e], named[s:e] - lo] = 1
        out += (has @ has.T).astype(np.int64)
    return out


def matched(percent: int):
    """The links among the pairs (hubs, docs) of a row, whose texts are in `texts`."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                flat = batch.column("texts").slice(i, 1).flatten()
                ids, sets = pc.struct_field(flat, "doc").to_numpy(zero_copy_only=False), shingle_sets(pc.struct_field(flat, "text"))
                size = np.array([len(s) for s in sets])
                both = shared_counts(sets)
                near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
                near &= (size > 0)[:, None] & (size > 0)[None, :]
                # An id may have several texts.
                names, at = np.unique(ids, return_inverse=True)
                linked_ids = np.zeros((len(names), len(names)), bool)
                x, y = np.nonzero(near)
                linked_ids[at[x], at[y]] = True
                hubs, docs = (batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in ("hubs", "docs"))
                keep = linked_ids[np.searchsorted(names, hubs), np.searchsorted(names, docs)]
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(hubs[keep]), pa.array(docs[keep])], names=["hub", "doc"])

    return confirm


def finished(marked: DataFrame, suspects: DataFrame, percent: int) -> DataFrame:
    """The links (hub, doc) of different components in a bucket: all pairs that agree are confirmed.

    marked: (bucket, doc, component) of the buckets that hold several. A bucket's largest component and its other
    members are dealt over blocks of their own; blocks of the former are never held against each other.
    """
    size = marked.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    size = size.groupBy(F.col("bucket").alias("b")).agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all")).where("main.n < all")
    over = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    small = F.col("all") <= BLOCK
    most = F.when(small, 1).otherwise(over(F.col("all") - F.col("main.n")))
    size = written(size.select("b", F.col("main.component").alias("main"), most.alias("strays"), F.when(small, 0).otherwise(over(F.col("main.n"))).alias("mains")), "sizes", narrow=True)
    slot = lambda n: F.pmod(F.xxhash64("doc"), n).cast("int")
    place = F.when((F.col("component") == F.col("main")) & (F.col("mains") > 0), F.col("strays") + slot(F.col("mains"))).otherwise(slot(F.col("strays")))
    dealt = marked.join(size, F.col("bucket") == F.col("b")).select("bucket", "doc", "component", place.alias("x"), (F.col("mains") == 0).alias("lone"), (place < F.col("strays")).alias("within"))
    dealt = dealt.join(suspects.select("id", "signature", "buckets"), F.col("doc") == F.col("id"))
    packed = written(dealt.groupBy("bucket", "x", "lone", "within").agg(F.collect_list(F.struct("doc", "component", "signature", "buckets")).alias("one")), "blocks")
    inside = packed.where("within and size(one) > 1").select("bucket", "x", F.col("x").alias("y"), "one", F.lit(None).cast(packed.schema["one"].dataType).alias("two"))
    each = size.where("mains > 0").select("b", "strays", "mains", F.explode(F.sequence(F.lit(0), F.col("strays") - 1)).alias("k"))
    each = each.select("b", "k", F.explode(F.sequence(F.col("k") + 1, F.col("strays") + F.col("mains") - 1)).alias("y"))
    left = packed.where("not lone").select("bucket", "x", "one")
    right = packed.where("not lone").select(F.col("bucket").alias("r_b"), F.col("x").alias("r_x"), F.col("one").alias("two"))
    across = each.join(left, (F.col("b") == F.col("bucket")) & (F.col("k") == F.col("x"))).join(right, (F.col("b") == F.col("r_b")) & (F.col("y") == F.col("r_x"))).select("bucket", "x", "y", "one", "two")
    likely = written(inside.union(across).mapInArrow(held, "bucket long, x int, y int, hubs array<long>, docs array<long>"), "rest")
    needed = likely.select("bucket", "x", "y", F.explode(F.array_distinct(F.concat("hubs", "docs"))).alias("doc"))
    brought = needed.join(suspects.select(F.col("id").alias("i"), "text"), F.col("doc") == F.col("i")).groupBy(*[F.col(c).alias(f"t_{c}") for c in ("bucket", "x", "y")]).agg(F.collect_list(F.struct("doc", "text")).alias("texts"))
    both = likely.join(brought, (F.col("bucket") == F.col("t_bucket")) & (F.col("x") == F.col("t_x")) & (F.col("y") == F.col("t_y"))).select("hubs", "docs", "texts")
    found = written(both.mapInArrow(matched(percent), "hub long, doc long").distinct(), "found", narrow=True)
    forget(packed, likely, size)
    return found


def best_hubs(meetings: DataFrame, most: int) -> DataFrame:
    """Of meetings (hub, doc, a row for each shared bucket) the `most` hubs of a doc that it meets most often."""
    met = meetings.groupBy("hub", "doc").agg(F.count("*").alias("n"))
    slot = F.pmod(F.xxhash64("hub"), F.lit(most))
    return met.groupBy("doc", slot.alias("slot")).agg(F.max(F.struct("n", "hub")).alias("best")).select(F.col("best.hub").alias("hub"), "doc")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id long, text string).

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id
    is the smallest doc_id that links reach and kept tells whether it is the row's own. Equal sets are one
    node, so that copies cost nothing. Null and empty texts and those without words have no shingles and link
    with nothing. Rows that share a doc_id are one document with several texts. A null doc_id is linked with
    nothing: component_id is null, kept true. Other columns are ignored. percent must be 75 or more for the
    bands' recall (a pair at 75 meets in no bucket with a chance of 2 in 10 000, one at 80 of 3 in a million).
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = written(source.mapInArrow(sketches, SKETCH), "sketch")
    # Equal sets are one node, named after the smallest document.
    reps = written(sketch.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep")), "reps")
    own = reps.select(F.col("rep").alias("r_id"), F.col("set_key").alias("r_key"))
    nodes = sketch.join(own, (F.col("doc_id") == F.col("r_id")) & (F.col("set_key") == F.col("r_key")), "left_semi")
    placed = nodes.select(F.col("doc_id").alias("doc"), F.explode("buckets").alias("bucket"))
    shared = written(placed.groupBy("bucket").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("size")).where("lo < hi").select(F.col("bucket").alias("b"), "size"), "buckets")
    members = written(placed.join(shared, F.col("bucket") == F.col("b")).select("bucket", "doc", "size"), "members")
    forget(shared)
    # The first hub of a bucket is the document that meets most others in its buckets.
    weight = written(members.groupBy(F.col("doc").alias("w_doc")).agg(F.sum("size").alias("weight")), "weights", narrow=True)
    # The texts of those that meet others are dealt once; what is confirmed later takes them from here.
    known = nodes.join(weight, F.col("doc_id") == F.col("w_doc"), "left_semi").select(F.col("doc_id").alias("id"), "signature", "buckets")
    texts = source.select(F.col("doc_id").alias("t_id"), "text")
    suspects = written(known.join(texts, F.col("id") == F.col("t_id")).select("id", "signature", "buckets", "text"), "suspects")
    best = members.join(weight, F.col("doc") == F.col("w_doc")).groupBy(F.col("bucket").alias("b")).agg(F.max(F.struct("weight", (-F.col("doc")).alias("neg"))).alias("best"))
    hubs = written(best.select("b", (-F.col("best.neg")).alias("hub")), "hubs", narrow=True)
    pairs = written(best_hubs(members.join(hubs, F.col("bucket") == F.col("b")).where("doc <> hub").select("hub", "doc"), 1), "pairs", narrow=True)
    tried = pairs
    label = components(confirmed(pairs, suspects, percent), "hub", "doc")
    open_ = members.select("bucket", "doc")
    turn = 1
    while True:
        marked = open_.join(label, F.col("doc") == F.col("node"), "left").select("bucket", "doc", F.coalesce("component", "doc").alias("component"))
        parts = marked.groupBy("bucket", "component").agg(F.count("*").alias("size"), F.max(F.struct(F.xxhash64("doc", F.lit(turn)).alias("order"), "doc")).alias("some"))
        split = parts.groupBy(F.col("bucket").alias("b")).agg(F.count("*").alias("kinds"), F.max(F.struct("size", "component", "some")).alias("main")).where("kinds > 1")
        main = written(split.select("b", F.col("main.component").alias("main"), F.col("main.some.doc").alias("hub")), "open", narrow=True)
        marked = written(marked.join(main, F.col("bucket") == F.col("b")).select("bucket", "doc", "component", "main", "hub"), "marked")
        open_ = marked.select("bucket", "doc")
        seen = tried.select(F.col("hub").alias("t_hub"), F.col("doc").alias("t_doc"))
        meetings = best_hubs(marked.where("component <> main").select("hub", "doc"), STARS)
        pairs = written(meetings.join(seen, (F.col("hub") == F.col("t_hub")) & (F.col("doc") == F.col("t_doc")), "left_anti"), "pairs", narrow=True)
        asked = pairs.select("doc").distinct().count()
        if not asked:
            break
        found = confirmed(pairs, suspects, percent)
        tried = tried.union(pairs)
        won = found.select("doc").distinct().count()
        label = joined_up(label, found, "hub", "doc")
        turn += 1
        if PAYS * won < asked:
            break
    # Links that the last round found join components; pairs of one are held against each other no more.
    marked = open_.join(label, F.col("doc") == F.col("node"), "left").select("bucket", "doc", F.coalesce("component", "doc").alias("component"))
    label = joined_up(label, finished(marked, suspects, percent), "hub", "doc")
    named = written(reps.join(label, F.col("rep") == F.col("node"), "left").select(F.col("set_key").alias("r_key"), F.coalesce("component", "rep").alias("component_id")), "named")
    forget(members, weight, suspects, hubs, reps)
    out = sketch.select("doc_id", "n", "set_key").join(named, F.col("set_key") == F.col("r_key"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
