"""Near-duplicate detection by ProbMinHash over weighted shingles of five words.

Each distinct word sequence is represented once. Its shingles (weight: how often they occur) arrive as exponential
processes of rate weight; an element stops as soon as its next arrival is later than the largest register, so the
signature takes about n + m ln m arrivals. Two signatures agree in a register with the probability Jaccard similarity
of the shingle weights. Bands of registers give candidates, and every candidate that matters is verified exactly on the
whole texts; documents linked by a similarity of `threshold` or more, directly or through others, form a class.

Large buckets never expand into pairs of rows. First each member of a bucket is compared with the bucket's leader. Then
members of buckets that still hold several components are laid into blocks, a row for each block, and blocks are compared
inside a task: sketches (two bits of each of 1,024 registers) find members that may be alike and are not linked yet, each
pair in its first shared band only; those members come once more with their texts, are verified exactly, closest pairs
first, and a local union-find leaves out what is linked by then. Tasks emit members and spanning links, never pairs, so
rows grow with members. At similarity 0.8 a sketch errs with probability 3e-5 (the 128-bit one: 3e-6), less above.

With 32 bands of 4 a pair at similarity 0.8 shares no band with probability (1 - 0.8^4)^32 = 5e-8.

Defined results: null, empty and wordless texts have no shingles and stay alone; a text of one to four words is one
shingle; equal word sequences are always one class. A class is named (`class_id`) by its smallest doc_id, and its largest
doc_id stays (of rows that share it, the one with the largest content locator; rows that repeat identifier and text stay
or go together). Identifiers may be null (smaller than any other) or shared by different texts: where the smallest doc_id
is null or names another class too, class_id is a negative number of the class's own. Identifiers are whole numbers (64
bits): others have to be numbered first. Empty tables give no rows; other columns are ignored, and pass through `drop_near_copies` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_classes, maybe_among, packed, row_at, shared_dir, small_batches, stored, words_of

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
M = BANDS * ROWS
#: Words, and texts, whose shingles are hashed together in one numpy pass.
CHUNK_WORDS, CHUNK_DOCS = 150_000, 2_000
#: Links of one document that one task takes.
SALT_ROWS = 500
#: Members of a block, and bytes of their texts, about.
BLOCK_MEMBERS, BLOCK_BYTES = 1_000, 8 << 20
#: Registers of the wide sketch, and those in which a pair at the threshold may differ by two bits: 153.6 on average, four deviations above.
WIDE, WIDE_APART = 1_024, 199
#: Sketch bits that a pair at the threshold may differ in: mean 12.8 of 128, four and a half deviations above.
SKETCH_BITS = 28

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ALL = 2**64 - 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], seen: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of all runs of five words, repeats included; of all words where there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    ids = np.array([seen.get(w) or seen.setdefault(w, _word_hash(w)) for w in words], np.uint64)
    n = min(SHINGLE, len(ids))
    h = np.full(len(ids) - n + 1, np.uint64(n))
    for j in range(n):
        h = mix(h * _MIX + ids[j : len(ids) - n + 1 + j])
    return h


def _word_hash(w: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(w, 7) or 1


def prob_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, docs: int, m: int = M) -> np.ndarray:
    """(docs, m) registers: for each, the element whose process reached it first. owner[i] is element i's document."""
    first = np.full(docs * m, np.inf)
    which = np.zeros(docs * m, np.uint64)
    latest = np.full(docs, np.inf)
    live = np.arange(len(elements))
    at = np.zeros(len(elements))
    nth = 0
    while len(live):
        nth += 1
        r = mix(elements[live] + np.uint64(nth * int(_MIX) & _ALL))
        gap = -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        at[live] += gap / weights[live]
        live = live[at[live] < latest[owner[live]]]
        r = mix(elements[live] ^ np.uint64(nth * int(_M1) & _ALL))
        slot = owner[live] * m + (r % np.uint64(m)).astype(np.int64)
        t = at[live]
        np.minimum.at(first, slot, t)
        won = first[slot] == t
        which[slot[won]] = elements[live[won]]
        latest = first.reshape(docs, m).max(axis=1)
        live = live[t < latest[owner[live]]]
    return which.reshape(docs, m)


def counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(hashes, return_counts=True)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Exact probability Jaccard of two shingle multisets, given as hashes with repeats."""
    return probability_jaccard(counted(a), counted(b))


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two shingle multisets, given as distinct hashes and how often each occurs."""
    (x, p), (y, q) = a, b
    if not len(x) or not len(y):
        return 0.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    if p.max() == 1 and q.max() == 1:
        return len(i) / (len(x) + len(y) - len(i))
    # sum over shared d of 1 / sum over e of max(p_e / p_d, q_e / q_d): sorted by q/p the inner sum is two running sums
    pe = np.concatenate([p.astype(float), np.zeros(len(y) - len(j))])
    rest = np.ones(len(y), bool)
    rest[j] = False
    qe = np.zeros(len(x))
    qe[i] = q[j]
    qe = np.concatenate([qe, q[rest].astype(float)])
    with np.errstate(divide="ignore"):
        ratio = np.where(pe > 0, qe / pe, np.inf)
    order = np.argsort(ratio, kind="stable")
    ratio, pe, qe = ratio[order], pe[order], qe[order]
    below, above = np.concatenate([[0.0], np.cumsum(pe)]), np.concatenate([[0.0], np.cumsum(qe)])
    k = np.searchsorted(ratio, q[j] / p[i], side="right")  # elements up to k follow p, those after follow q
    return float(np.sum(1.0 / (below[k] / p[i] + (above[-1] - above[k]) / q[j])))


SIGNED = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("content", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch1", pa.int64()), ("sketch2", pa.int64())])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, at, content, bands, sketch1, sketch2) for every row: content is a hash of the word sequence, null without words.

    Identifiers and locators pass as Arrow columns, untouched.
    """

    def sign(texts: list[str | None]) -> list[pa.Array]:
        import xxhash

        seen: dict[bytes, int] = {}
        content, parts, owns = [], [], []
        for text in texts:
            words = words_of(text)
            content.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
            if words:
                owns.append(len(content) - 1)
                parts.append(counted(shingle_hashes(words, seen)))
        bands: list = [None] * len(texts)
        sketch = np.zeros((len(texts), 2), np.int64)
        if parts:
            owner = np.repeat(np.arange(len(parts)), [len(e) for e, _ in parts])
            sig = prob_minhash(np.concatenate([e for e, _ in parts]), np.concatenate([c for _, c in parts]).astype(float), owner, len(parts))
            low = mix(sig + np.uint64(1)).astype(np.uint8) & np.uint8(1)
            sketch[owns] = np.packbits(low, axis=1).view(">u8").astype(np.uint64).view(np.int64)
            band = sig.reshape(len(parts), BANDS, ROWS)
            key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(parts), 1))
            for r in range(ROWS):
                key = mix(key * _MIX + band[:, :, r])
            for at, k in zip(owns, key.view(np.int64)):
                bands[at] = k
        return [pa.array(content, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, start, size = pc.fill_null(pc.binary_length(b.column(2)), 0).to_pylist(), 0, 0
            for i, n in enumerate(lengths):
                size += n // 6
                if size >= CHUNK_WORDS or i + 1 - start >= CHUNK_DOCS or i + 1 == len(lengths):
                    part = b.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *sign(part.column(2).to_pylist())], schema=SIGNED)
                    start, size = i + 1, 0

    small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_at(F.col("doc_id"), F.col("text")).alias("at"), "text")
    return d.mapInArrow(run, "doc_id long, at long, content binary, bands array<long>, sketch1 long, sketch2 long")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of pairs whose whole texts reach the threshold. b may be a leader of many: its text goes to salts."""
    per = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("links"))
    salts = F.ceil(F.col("links") / SALT_ROWS).cast("int")
    per = per.withColumn("salts", salts)
    spread = per.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    leaders = spread.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    salted = join_classes(pairs, per, "b", "links", max(1, pairs.count()))
    salted = salted.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"), F.lit(0)))
    both = salted.select("a", "b", "salt").join(leaders, ["b", "salt"]).select("a", "b", "text_b")
    both = both.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            seen: dict[bytes, int] = {}
            hashed: dict[int, np.ndarray] = {}
            ok = []
            for a, b, s, t in zip(x["a"], x["b"], x["text_a"], x["text_b"]):
                if b not in hashed:
                    if len(hashed) > 256:
                        hashed.clear()
                    hashed[b] = shingle_hashes(words_of(t), seen)
                ok.append(similarity(shingle_hashes(words_of(s), seen), hashed[b]) >= threshold)
            yield x.loc[ok, ["a", "b"]]

    return both.select("a", "b", "text_a", "text_b").mapInPandas(compare, "a long, b long")


def components(pairs: DataFrame, work: str) -> DataFrame:
    """(id, comp) of every id in the (a, b) pairs: comp is the smallest id of its component.

    Each task first replaces its edges by stars of their components, which leaves a row for each id it has seen; then
    alternating large-star and small-star rounds until nothing changes. A round is grouped minima and joins, with the
    centre of a large star joined as a heavy key, written to the shared folder.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}
        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                _join(root, u, v)
        if root:
            u = list(root)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array([_find(root, x) for x in u])], names=["u", "v"])

    edges = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").mapInArrow(contract, "u long, v long")
    edges = stored(edges.where("u <> v").distinct(), f"{work}/e0")
    total, before, nth = max(1, edges.count()), None, 0
    while True:
        nth += 1
        ends = F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = edges.select(F.inline(ends))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
        large = join_classes(both, low, "u", "degree", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        star = F.struct(F.col("u").alias("u"), F.col("m").alias("v"))
        small = small.select(F.inline(F.array(star, F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).where("u <> v")
        edges = stored(small.distinct(), f"{work}/e{nth}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
            return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(roots)
        before = now


def _find(root: dict[int, int], x: int) -> int:
    root.setdefault(x, x)
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _join(root: dict[int, int], a: int, b: int) -> None:
    """The smaller root stays."""
    lo, hi = sorted((_find(root, a), _find(root, b)))
    root[hi] = lo


def bits_apart(x1: str, x2: str, y1: str, y2: str) -> Column:
    """Bits in which two 128-bit sketches differ."""
    return F.bit_count(F.col(x1).bitwiseXOR(F.col(y1))) + F.bit_count(F.col(x2).bitwiseXOR(F.col(y2)))


def wide_sketches(texts: DataFrame) -> DataFrame:
    """(id, wide): two bit planes of the wide signature's registers, 64 registers a number, of (id, text) with words."""

    def sketch(rows: list[tuple]) -> pd.DataFrame:
        seen: dict[bytes, int] = {}
        parts = [counted(shingle_hashes(words_of(t), seen)) for _, t in rows]
        if not rows:
            return pd.DataFrame(columns=["id", "wide"])
        owner = np.repeat(np.arange(len(parts)), [len(e) for e, _ in parts])
        sig = prob_minhash(np.concatenate([e for e, _ in parts]), np.concatenate([c for _, c in parts]).astype(float), owner, len(parts), WIDE)
        low = mix(sig + np.uint64(1)).astype(np.uint8)
        planes = [np.packbits((low >> np.uint8(k)) & np.uint8(1), axis=1).view(">i8").astype(np.int64) for k in (0, 1)]
        return pd.DataFrame({"id": [i for i, _ in rows], "wide": [x.tobytes() for x in np.hstack(planes)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held = list(zip(b["id"], b["text"]))
            for at in range(0, len(held), 100):  # a signature has 8 KB while it is made
                yield sketch(held[at : at + 100])

    return texts.select("id", "text").mapInPandas(run, "id long, wide binary")


class _Side:
    """One block, as arrays."""

    def __init__(self, block: pa.StructArray):
        of = dict(zip((f.name for f in block.type), block.flatten()))
        self.id, self.comp = of["id"].to_numpy(), of["comp"].to_numpy()
        self.sketch = [of[k].to_numpy(zero_copy_only=False).view(np.uint64) for k in ("sketch1", "sketch2")]
        self.bands = of["bands"].flatten().to_numpy().reshape(-1, BANDS)
        self.wide = np.frombuffer(b"".join(of["wide"].to_pylist()), np.uint64).reshape(-1, 2, WIDE // 64)
        self.text, self.shingles = of.get("text"), {}

    def counted(self, i: int, seen: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.shingles:
            self.shingles[i] = counted(shingle_hashes(words_of(self.text[i].as_py()), seen))
        return self.shingles[i]


def _close(a: _Side, b: _Side, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Members (i of a, j of b) of different components that sketches don't rule out and whose first shared band is key, closest first."""
    found = []
    step = max(1, 1_000_000 // len(b.id))
    for at in range(0, len(a.id), step):
        part = slice(at, at + step)
        apart = sum(np.bitwise_count(x[part, None] ^ y[None]).astype(np.int16) for x, y in zip(a.sketch, b.sketch))
        ok = (apart <= SKETCH_BITS) & (a.comp[part, None] != b.comp[None])
        if a is b:
            ok &= a.id[part, None] > b.id[None]
        i, j = np.nonzero(ok)
        i += at
        for k in range(0, len(i), 50_000):
            x, y = i[k : k + 50_000], j[k : k + 50_000]
            far = np.bitwise_count((a.wide[x, 0] ^ b.wide[y, 0]) | (a.wide[x, 1] ^ b.wide[y, 1])).sum(axis=1, dtype=np.int64)
            x, y, far = (v[far <= WIDE_APART] for v in (x, y, far))
            first = (a.bands[x] == b.bands[y]).argmax(axis=1)
            found.append(np.stack([far, x, y])[:, a.bands[x, first] == key])
    far, i, j = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((b.id[j], a.id[i], far))
    return i[order], j[order]


def in_blocks(members: DataFrame, threshold: float | None) -> DataFrame:
    """Compares the members (key, id, comp, sketch1, sketch2, bands, wide) of each key that are of different components.

    Without a threshold: the (key, id) of those that sketches find alike. With one, members have their text too: (a, b),
    links of that similarity that join components, at most one less than a task sees. A block is one row; it is compared
    with itself and, where a key has several, with each other one.
    """
    exact = threshold is not None
    members = stored(members)
    size = F.sum(F.octet_length("text")) if exact else F.lit(0)
    per = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), size.alias("bytes"))
    per = per.withColumn("blocks", F.ceil(F.greatest(F.col("n") / BLOCK_MEMBERS, F.col("bytes") / BLOCK_BYTES)).cast("int")).where("n > 1")
    m = join_classes(members, per.select("key", "n", "blocks"), "key", "n", max(1, members.count())).where("n is not null")
    m = m.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    fields = ["id", "comp", "sketch1", "sketch2", "bands", "wide", *(["text"] if exact else [])]
    rows = stored(m.groupBy("key", "blocks", "block").agg(F.collect_list(F.struct(*fields)).alias("x")))
    several = rows.where("blocks > 1")
    other = several.select(F.col("key").alias("_key"), F.col("block").alias("_block"), F.col("x").alias("y"))
    pairs = several.join(other, (F.col("key") == F.col("_key")) & (F.col("block") < F.col("_block"))).select("key", "x", "y")
    pairs = pairs.unionByName(rows.select("key", "x", F.lit(None).cast(rows.schema["x"].dataType).alias("y")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                a = _Side(x.values)
                b = _Side(y.values) if y.is_valid else a
                i, j = _close(a, b, key)
                if not exact:
                    ids = np.union1d(a.id[i], b.id[j])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key)), pa.array(ids)], names=["key", "id"])
                    continue
                seen: dict[bytes, int] = {}
                root: dict[int, int] = {}
                links = []
                for p, q in zip(i.tolist(), j.tolist()):
                    ca, cb = int(a.comp[p]), int(b.comp[q])
                    if _find(root, ca) != _find(root, cb) and probability_jaccard(a.counted(p, seen), b.counted(q, seen)) >= threshold:
                        _join(root, ca, cb)
                        links.append((int(a.id[p]), int(b.id[q])))
                yield pa.RecordBatch.from_arrays([pa.array([n[k] for n in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long" if exact else "key long, id long")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, class_size, kept) for every row."""
    return located(docs, threshold).drop("at")


def located(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, at, class_id, class_size, kept) for every row; at is the locator of its content."""
    work = shared_dir(docs.sparkSession)
    signed = stored(signatures(docs).withColumn("row", F.monotonically_increasing_id()), f"{work}/signed")
    total = max(1, signed.count())
    # one number for each distinct word sequence, and where to find one of its texts
    some = F.first(F.struct("doc_id", "at", "bands", "sketch1", "sketch2"))
    per = signed.where("content is not null").groupBy("content").agg(
        F.min("doc_id").alias("first_id"), F.max(F.struct("doc_id", "at")).alias("last"), F.count(F.lit(1)).alias("copies"), some.alias("s"))
    per = stored(per.withColumn("id", F.monotonically_increasing_id()), f"{work}/per")
    reps = per.select("id", "s.bands", "s.sketch1", "s.sketch2")
    member = reps.select("id", "sketch1", "sketch2", F.explode("bands").alias("key"))

    lead = F.min_by(F.struct("id", "sketch1", "sketch2"), "id").alias("l")
    buckets = stored(member.groupBy("key").agg(F.count(F.lit(1)).alias("open"), lead).where("open > 1"), f"{work}/buckets")
    members = stored(join_classes(member, buckets, "key", "open", total).where("open is not null"), f"{work}/members")
    needed = members.select("id").distinct().join(per.select("id", "s.doc_id", "s.at"), "id")
    needed = stored(needed.select("id", F.col("doc_id").alias("_id"), "at"), f"{work}/needed")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_at(F.col("doc_id"), F.col("text")).alias("at"))
    some = maybe_among(d, "at", needed.select("at"), needed.count()).where("_maybe").drop("_maybe")
    texts = some.join(needed, "at").where(F.col("doc_id").eqNullSafe(F.col("_id"))).select("id", "text")
    texts = stored(texts.dropDuplicates(["id"]), f"{work}/texts")

    # each member against its bucket's leader
    led = members.where((F.col("id") != F.col("l.id")) & (bits_apart("sketch1", "sketch2", "l.sketch1", "l.sketch2") <= SKETCH_BITS))
    pairs = stored(led.select(F.col("id").alias("a"), F.col("l.id").alias("b")).distinct(), f"{work}/pairs")
    links = stored(verified(pairs, texts, threshold), f"{work}/links0")
    comp = stored(components(links, f"{work}/c0"), f"{work}/comp0")
    # members of buckets that still hold several components, against each other
    own = members.select("key", "id", "sketch1", "sketch2").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    own = stored(own, f"{work}/own")
    mixed = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("open")).where("lo <> hi")
    open_ = stored(join_classes(own, mixed.select("key", "open"), "key", "open", total).where("open is not null").drop("open"), f"{work}/open")
    wide = stored(wide_sketches(texts.join(open_.select("id").distinct(), "id", "left_semi")), f"{work}/wide")
    sketched = open_.join(reps.select("id", "bands").join(wide, "id"), "id")
    alike = stored(in_blocks(sketched, None).distinct(), f"{work}/alike")
    more = stored(in_blocks(sketched.join(alike, ["key", "id"], "left_semi").join(texts, "id"), threshold), f"{work}/links1")
    comp = components(links.union(more), f"{work}/c1")

    linked = stored(per.drop("s").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id")), f"{work}/linked")
    whole = linked.groupBy("comp").agg(F.min("first_id").alias("first_id"), F.max("last").alias("keep"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("texts"))
    whole = stored(whole, f"{work}/whole")
    alone = signed.where("content is null")
    # identifiers that would name several classes; those of null classes are told apart, so that they don't meet in one task
    names = whole.select(F.col("first_id").alias("_name")).unionByName(alone.select(F.col("doc_id").alias("_name"))).where("_name is not null")
    twice = stored(names.groupBy("_name").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1"), f"{work}/twice")

    def named(df: DataFrame, first: str, number: Column) -> DataFrame:
        df = df.withColumn("_key", F.coalesce(F.col(first), number))
        j = join_classes(df, twice.withColumnRenamed("_name", "_key"), "_key", "classes", total)
        return j.withColumn("class_id", F.when(F.col(first).isNull() | F.col("classes").isNotNull(), number).otherwise(F.col(first)))

    whole = named(whole, "first_id", -(F.col("comp") + 1)).select("comp", "class_id", "class_size", "keep", "texts")
    out = join_classes(linked.select("content", "copies", "comp"), whole, "comp", "texts", total)
    out = stored(out.drop("texts", "comp"), f"{work}/classes")
    out = join_classes(signed.where("content is not null").select("doc_id", "at", "content"), out, "content", "copies", total)
    kept = F.struct("doc_id", "at").eqNullSafe(F.col("keep"))
    out = out.select("doc_id", "at", "class_id", "class_size", kept.alias("kept"))
    one = named(alone.select("doc_id", "at", "row"), "doc_id", -F.col("row") - F.lit(1 << 62))
    return out.unionByName(one.select("doc_id", "at", "class_id", F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept")))


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stay, one document of each class, with all their columns; the others need no shuffle to stay."""
    going = stored(located(docs, threshold).where("not kept").select("at", F.col("doc_id").alias("_id")).distinct())
    keyed = packed(docs).withColumn("at", row_at(F.col("d")["doc_id"], F.col("d")["text"]))
    keyed = maybe_among(keyed, "at", going.select("at"), going.count())
    gone = going.withColumnRenamed("at", "_at")
    some = keyed.where("_maybe").join(gone, (F.col("at") == F.col("_at")) & F.col("d.doc_id").eqNullSafe(F.col("_id")), "left_anti")
    return keyed.where("not _maybe").select("d.*").unionByName(some.select("d.*"))
