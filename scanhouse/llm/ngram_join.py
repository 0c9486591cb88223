"""Operator 1: n-gram Jaccard join by blocked sparse products of document x n-gram incidence.

Rows of the incidence matrix are documents, columns are shingle fingerprints. Two sets of sizes
a <= b with Jaccard >= t differ in at most (1-t)/(1+t) * (a+b) shingles. So if a range of sizes
cuts the fingerprints into more parts than that, two linked sets agree on some whole part. The
parts' fingerprints give the blocks: documents joined by agreeing parts form a candidate group,
cut into blocks of bounded size. Within a pair of blocks, overlaps of a row with all others are
accumulated over the row's columns (a sparse row times a sparse matrix), and pairs below the
bound t/(1+t) * (a+b) are discarded. Rows that are already connected need no product, so a
large group of near copies costs about one product, not all pairs.

The blocking loses no link: see ``part_rows`` for documents whose parts are empty or common.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanhouse.llm.common import BROADCAST_ROWS, connected_components, discard, join_groups, key_filter, materialise, null_safe, table
from scanhouse.llm.shingles import batch_sets, mix
from scanhouse.llm.worker import forget
from scanhouse.session import shuffles_dropped

#: Non-zeros and rows of one block; a task holds two blocks.
BLOCK_NNZ, BLOCK_ROWS = 1 << 20, 8192
#: Shingles in so many unlike documents of a sample of about HOT_SAMPLE documents count as common.
HOT_SAMPLE, HOT_LEAST = 20_000, 4
SEEN = 200_000

SETS = "doc_id bigint, n_shingles bigint, digest binary, h bigint"
GRAMS = "component bigint, n_blocks int, block int, class_id bigint, grams array<bigint>"


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_keys(digests: list[bytes]) -> np.ndarray:
    """The first 64 bits of each digest, a node id for blocking (a clash only widens a block)."""
    return np.frombuffer(b"".join(d[:8] for d in digests), dtype=np.int64)


def set_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for lo, _, sizes, digests in batch_sets(batch, words):
                ids = batch.column(0).slice(lo, len(sizes))
                cols = [ids, pa.array(sizes), pa.array(digests, pa.binary()), pa.array(set_keys(digests))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "digest", "h"])

    return rows


# --- blocking -------------------------------------------------------------------------


def bands(num: int, den: int, most: int = 1 << 40) -> np.ndarray:
    """Lower ends of the size ranges; a range's ends differ by a factor of about t**-2."""
    ends = [1]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, -(-ends[-1] * den * den // (num * num))))
    return np.array(ends, dtype=np.int64)


def most_differing(n: np.ndarray, band: np.ndarray, num: int, den: int, ends: np.ndarray) -> np.ndarray:
    """How many shingles a set of size n can differ in from a linked set of sizes in ``band``."""
    upper = ends[band + 1] - 1
    partner = np.minimum(upper, n * den // num)
    return (den - num) * (n + partner) // (den + num)


def n_parts(band: int, num: int, den: int) -> int:
    """Parts for a size range: as few as give any of its sets more filled parts than differences."""
    ends = bands(num, den)
    low, up = int(ends[band]), int(ends[band + 1]) - 1
    low = -(-low * num // den)

    def fills(n: int, k: int) -> bool:
        empty = k * math.exp(-n / k)
        d = int(most_differing(np.array([n]), np.array([band]), num, den, ends)[0])
        return k - empty - 6 * math.sqrt(min(empty, n)) >= d + 1

    k = (den - num) * 2 * up // (den + num) + 1
    while k < 8 * up and not (fills(low, k) and fills(up, k)):
        k += max(1, k // 50)
    return k


def part_rows(grams, sizes, keys, hot, num, den, known: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """``(part fingerprint, set key)`` for each filled part of each set.

    A set takes part in its own size range and, if it can link to a larger set of the next one,
    in that as well. Parts of common shingles only are left out where enough others remain (more
    than the set can differ in: then one of them agrees in any linked set). A set with too few
    others gives all its filled parts, and if those are too few as well, the empty ones too;
    two linked sets that both lack enough of a kind share a part of the next kind. ``known``
    remembers the number of parts of each size range.
    """
    out_p, out_k = [], []
    ends = bands(num, den)
    own = np.searchsorted(ends, sizes, side="right") - 1
    cold = np.ones(len(grams), bool)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
        cold = hot[at] != grams
    row = np.repeat(np.arange(len(sizes)), sizes)
    mixed = mix(grams)
    for up in (0, 1):
        band = own + up
        use = sizes > 0
        if up:
            use = use & (sizes * den >= ends[band] * num)
        if not use.any():
            continue
        for b in np.unique(band[use]).tolist():
            if b not in known:
                known[b] = n_parts(b, num, den)
        k = np.array([known[b] if u else 1 for b, u in zip(band.tolist(), use.tolist(), strict=True)], dtype=np.uint64)
        keep = use[row]
        r, part = row[keep], ((grams[keep] >> np.uint64(32)) * k[row[keep]]) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (part[1:] != part[:-1])]))
        r0, p0 = r[start], part[start]
        body = np.add.reduceat(mixed[keep], start)
        filled = np.add.reduceat(cold[keep].astype(np.int64), start) > 0
        tag = mix(band.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(num * 1000 + den))
        prints = mix(body + mix(p0 + tag[r0]))
        differ = most_differing(sizes, np.where(use, band, 0), num, den, ends)
        enough = np.bincount(r0, weights=filled, minlength=len(sizes)) > differ
        take = filled | ~enough[r0]
        out_p.append(prints[take])
        out_k.append(keys[r0[take]])
        for i in np.flatnonzero(use & (np.bincount(r0, minlength=len(sizes)) <= differ)):  # few sets
            empty = np.setdiff1d(np.arange(int(k[i]), dtype=np.uint64), p0[r0 == i])
            out_p.append(mix(mix(empty + tag[i])))
            out_k.append(np.full(len(empty), keys[i]))
    if not out_p:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_p), np.concatenate(out_k)


def combine(prints: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that give the same connections with fewer of them: one row per part of the piece;
    for each further set of a part, a part of its own that it shares with the first one."""
    if not len(prints):
        return prints, keys
    order = np.lexsort((keys, prints))
    p, k = prints[order], keys[order]
    head = np.concatenate([[True], p[1:] != p[:-1]])
    lead = k[np.maximum.accumulate(np.where(head, np.arange(len(p)), 0))]
    more = ~head & (k != lead)
    pairs = np.unique(np.stack([k[more], lead[more]], axis=1), axis=0)
    own = mix(mix(pairs[:, 0].view(np.uint64)) + pairs[:, 1].view(np.uint64))
    return np.concatenate([p[head], own, own]), np.concatenate([k[head], pairs[:, 0], pairs[:, 1]])


def part_kernel(words: int, num: int, den: int, hot: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: set[int] = set()
        known: dict[int, int] = {}
        for batch in batches:
            for _, grams, sizes, digests in batch_sets(batch, words):
                keys = set_keys(digests)
                new = np.zeros(len(keys), bool)
                for i, k in enumerate(keys.tolist()):  # copies within a task give their parts once
                    if k not in seen:
                        seen.add(k)
                        new[i] = True
                if len(seen) > SEEN:
                    seen.clear()
                prints, k = combine(*part_rows(grams[np.repeat(new, sizes)], sizes[new], keys[new], hot, num, den, known))
                yield pa.RecordBatch.from_arrays([pa.array(as_long(prints)), pa.array(k)], names=["part", "h"])

    return rows


def gram_kernel(words: int):
    """Each shingle of each row, with one bit that near copies mostly have in common."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, grams, sizes, _ in batch_sets(batch, words):
                first = np.cumsum(sizes) - sizes
                least = np.zeros(len(sizes), np.uint64)
                least[sizes > 0] = grams[first[sizes > 0]]  # a set's smallest fingerprint
                bit = np.repeat(np.uint64(1) << (mix(least) & np.uint64(63)), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(grams)), pa.array(as_long(bit))], names=["gram", "bit"])

    return rows


def common_shingles(docs: DataFrame, n_docs: int, words: int) -> np.ndarray:
    """Shingles that unlike documents share (lines, passages, phrases), sorted.

    They are found in a bounded sample, and there are at most (shingles of the sample) / HOT_LEAST.
    They only steer the blocking, whose result is the same for any set of them.
    """
    share = min(1.0, HOT_SAMPLE / max(n_docs, 1))
    sample = docs.select("text").sample(share, seed=7) if share < 1 else docs.select("text")
    with shuffles_dropped(docs.sparkSession):
        bits = sample.mapInArrow(gram_kernel(words), "gram bigint, bit bigint").groupBy("gram").agg(F.bit_or("bit").alias("bits"))
        found = bits.where(F.bit_count("bits") >= HOT_LEAST).select("gram").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64))


# --- products -------------------------------------------------------------------------


def block_links(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each row of a block (pair), the smallest id that it is linked with, in steps or at once.

    Takes a row's overlaps with all others at once, by adding up the rows of its columns; a pair
    stays if den * overlap >= num * union. Only rows outside the largest group found so far
    are taken, each at most once: any link between two groups has such an end.
    """
    m = len(ids)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=m)
    _, cols = np.unique(np.concatenate(sets), return_inverse=True)
    row_at = np.concatenate([[0], np.cumsum(sizes)])
    by_col = np.argsort(cols, kind="stable")
    col_rows = np.repeat(np.arange(m), sizes)[by_col]
    col_at = np.concatenate([[0], np.cumsum(np.bincount(cols))])
    label, done = np.arange(m), np.zeros(m, bool)
    while True:
        left = np.flatnonzero((label != np.bincount(label, minlength=m).argmax()) & ~done)
        if not len(left):
            return np.minimum.reduceat(ids[np.argsort(label, kind="stable")], _heads(label))[_ranks(label)] if m else ids
        r = int(left[0])
        done[r] = True
        c = cols[row_at[r] : row_at[r + 1]]
        lo, n = col_at[c], col_at[c + 1] - col_at[c]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        overlap = np.bincount(col_rows[at], minlength=m)
        linked = den * overlap >= num * (sizes[r] + sizes - overlap)
        groups = np.unique(label[linked])
        label[np.isin(label, groups)] = groups[0]


def _heads(label: np.ndarray) -> np.ndarray:
    s = np.sort(label, kind="stable")
    return np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))


def _ranks(label: np.ndarray) -> np.ndarray:
    return np.unique(label, return_inverse=True)[1]


def rep_grams(words: int):
    """Sets of the candidate rows, with what is known of them; a row that repeats an id with
    another text is not the one meant and goes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["component", "n_blocks", "block", "class_id"]
        for batch in batches:
            want = batch.column(batch.schema.get_field_index("digest")).to_pylist()
            for lo, grams, sizes, digests in batch_sets(batch, words):
                ok = np.array([d == w for d, w in zip(digests, want[lo : lo + len(digests)], strict=True)], bool)
                part = batch.slice(lo, len(sizes)).filter(pa.array(ok))
                offsets = np.concatenate([[0], np.cumsum(sizes[ok])]).astype(np.int32)
                values = pa.array(as_long(grams[np.repeat(ok, sizes)]))
                cols = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(offsets, values)], names=[*names, "grams"])

    return rows


def tile_links(num: int, den: int):
    """Rows sorted by (component, lo, hi) to ``(component, n_blocks, class_id, root)``."""

    def close(key, ids, sets):
        first = np.unique(np.array(ids, dtype=np.int64), return_index=True)[1]  # a class counts once
        ids, sets = np.array(ids, dtype=np.int64)[first], [sets[i] for i in first]
        root = block_links(ids, sets, num, den)
        n = len(ids)
        cols = [pa.array(np.full(n, key[0])), pa.array(np.full(n, key[3], np.int32)), pa.array(ids), pa.array(root)]
        return pa.RecordBatch.from_arrays(cols, names=["component", "n_blocks", "class_id", "root"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        key, ids, sets = None, [], []
        for batch in batches:
            col = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            comp, lo, hi, nb = (col[c].to_numpy() for c in ("component", "lo", "hi", "n_blocks"))
            cid, grams = col["class_id"].to_numpy(), col["grams"]
            at = grams.offsets.to_numpy()
            values = grams.values.to_numpy()
            for i in range(batch.num_rows):
                k = (int(comp[i]), int(lo[i]), int(hi[i]), int(nb[i]))
                if k != key:
                    if key is not None:
                        yield close(key, ids, sets)
                    key, ids, sets = k, [], []
                ids.append(cid[i])
                sets.append(values[at[i] : at[i + 1]].copy())
        if key is not None:
            yield close(key, ids, sets)

    return rows


# --- the join -------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_shingles, component_id, digest.

    Two documents link when the Jaccard index of their sets of ``words``-word shingles is at least
    ``threshold`` (a fraction). ``component_id`` is the smallest doc_id that a document reaches
    by links, itself included. NULL, empty or blank texts have an empty set, link with nothing
    and are their own component. Rows with equal texts or repeated ids link like others; NULL
    ids are never the smallest unless a component has no other. Other columns are not read. Sets
    are compared by 64-bit fingerprints of their shingles.
    """
    num, den = threshold
    docs = docs.select("doc_id", "text")
    rows = materialise(docs.mapInArrow(set_rows(words), SETS), "sets")
    first, count = F.min("doc_id").alias("first_id"), F.count("*").alias("n")
    classes = rows.where("n_shingles > 0").groupBy("digest", "h", "n_shingles").agg(first, count)
    classes = materialise(classes.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    n_docs = rows.count()
    hot = common_shingles(docs, n_docs, words)

    parts = docs.mapInArrow(part_kernel(words, num, den, hot), "part bigint, h bigint")
    lead = parts.withColumn("lead", F.min("h").over(Window.partitionBy("part"))).where("h <> lead")
    groups = connected_components(lead.select("h", "lead"))
    groups = groups.select(F.col("node").alias("h"), "component")

    members = materialise(classes.join(groups, "h"), "members")
    weight = members.groupBy("component").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("nnz")).where("m > 1")
    blocks = F.greatest(F.ceil(F.col("nnz") / BLOCK_NNZ), F.ceil(F.col("m") / BLOCK_ROWS)).cast("int")
    weight = weight.select("component", blocks.alias("n_blocks"))
    block = F.pmod(F.xxhash64("class_id"), F.col("n_blocks")).cast("int").alias("block")
    reps = members.join(weight, "component").select("component", "n_blocks", block, "class_id", "digest", "first_id")
    reps = materialise(reps, "reps")
    if (n_reps := reps.count()) <= BROADCAST_ROWS:
        reps, candidates = F.broadcast(reps), docs
    else:  # texts that are no candidate's stay where they are
        candidates = docs.where(key_filter(reps, "first_id", n_reps)(docs["doc_id"]))
    texts = candidates.join(reps, null_safe(candidates, reps, [("doc_id", "first_id")])).drop("doc_id", "first_id")
    sets = texts.mapInArrow(rep_grams(words), GRAMS)

    # a block meets every other one of its component; a component of one block is one tile
    other = F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_blocks") - 1, F.lit(0))))
    tiles = sets.withColumn("other", other).where("n_blocks = 1 or other <> block").select(
        "component", "n_blocks", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "class_id", "grams"
    )
    tiles = tiles.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
    links = tiles.mapInArrow(tile_links(num, den), "component bigint, n_blocks int, class_id bigint, root bigint")
    links = materialise(links, "links")
    whole = links.where("n_blocks = 1").select("class_id", "root")
    split = links.where("n_blocks > 1 and class_id <> root").select("class_id", "root")
    if not split.isEmpty():
        whole = whole.unionByName(connected_components(split).toDF("class_id", "root"))
    rooted = classes.join(whole, "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    resolved = materialise(rooted.join(lowest, "root").select("digest", "n", "component_id"), "resolved")
    for done in (classes, members, links):
        discard(done)
    full = join_groups(rows.where("n_shingles > 0"), resolved, ["digest"], "n", n_docs)
    empty = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    cols = ["doc_id", "n_shingles", "component_id", "digest"]
    return full.select(*cols).unionByName(empty.select(*cols))


def drop_near_duplicates(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of ``docs`` of which one stays for each component, with all their columns.

    The row with the component's smallest doc_id stays. Rows without words all stay, and so does
    a component without ids. A repeated id goes only if all its rows would.
    """
    goes = F.expr("not (doc_id <=> component_id)").alias("goes")
    found = near_duplicates(docs, words, threshold).select("doc_id", goes)
    gone = found.groupBy("doc_id").agg(F.min("goes").alias("goes")).where("goes").select("doc_id")
    gone = materialise(gone, "dropped")
    same = docs["doc_id"].eqNullSafe(gone["doc_id"])
    if (n_gone := gone.count()) <= BROADCAST_ROWS:
        return docs.join(F.broadcast(gone), same, "left_anti")
    maybe = key_filter(gone, "doc_id", n_gone)(docs["doc_id"])  # other texts stay where they are
    return docs.where(maybe).join(gone, same, "left_anti").unionByName(docs.where(~maybe))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=(9, 10)).drop("digest")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [ws]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2]) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS low FROM r GROUP BY x) m ON m.x = d.doc_id
"""
