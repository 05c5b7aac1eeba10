"""Near-duplicate documents: SuperMinHash, banding, confirmation on whole shingle sets, components.

1. One scan makes each document's set digest (128 bits), set size and signature. Documents of equal sets form
   a class, which gets a number, so a thousand exact copies cost as much as one.
2. Classes fall into one bucket for each of 32 bands of 4 slots. At similarity 0.8 two share no bucket with
   probability (1 - 0.8**4)**32 < 5e-8.
3. In each bucket every member is paired with the smallest one (a star, never all pairs). Pairs whose
   signatures agree in 72 of 128 slots (6.7 standard deviations below 0.8) are confirmed on whole sets.
4. Components of those links are joined. A bucket that still holds several components may hide a link
   between two members of which neither is the smallest: those buckets alone, in blocks of bounded size,
   are searched within one task that holds the whole sets, tests pairs of different components and emits
   a link only where it joins two of them. No list of pairs is ever written.

Every row is a document, rows of equal ids and other texts too: each is linked by its own text. Nulls: a null or
blank text has an empty set and links with nothing. A null id takes no part (component_id null, kept false).
Texts are read whole; sets of very long ones are drawn for in stretches. Ties: of equal ids in one component
all rows are kept. Without documents the result is empty. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop_tables, hash_words, materialize, mix, pick, set_apart, shingles, text_slices, utf8, words
from .components import components
from .superminhash import SLOTS, signatures

BANDS = 32
#: Share of equal slots from which a pair is confirmed on whole sets. At similarity 0.8 fewer have probability 3e-10, by binomial.
LEAST_ALIKE = 72 / SLOTS
#: Members of a bucket that one task compares with each other, or with as many others.
BLOCK = 1024
#: Bytes of text whose sets are made together; rows of an Arrow batch of whole sets or signatures.
SET_BYTES, SET_ROWS = 1 << 19, 64


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b in text_slices(texts, SET_BYTES):
        data, off = utf8(texts.slice(a, b - a))
        begins, ends, starts = words(data, off)
        yield a, b, *shingles(hash_words(data, begins, ends), starts, k)


def _binary_rows(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values of a uint8 buffer, by bounds in bytes."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(flat.tobytes())])


def _digests(s: np.ndarray, starts: np.ndarray) -> pa.Array:
    """128 bits of each set."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (mix(s), mix(s ^ np.uint64(0x5851F42D4C957F2D)))]
    both = np.stack([c[starts[1:]] - c[starts[:-1]] for c in sums], axis=1)
    return _binary_rows(both.view(np.uint8).ravel(), np.arange(len(starts)) * 16)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s, starts in _sets(batch.column(1), k):
                n = np.diff(starts)
                sig = signatures(s, starts)
                own = [c.slice(a, b - a) for c in (batch.column(0), batch.column(2))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n.astype(np.int64)), _digests(s, starts), _binary_rows(sig.view(np.uint8).ravel(), np.arange(len(n) + 1) * 2 * SLOTS)], names=["doc_id", "text_hash", "n_shingles", "digest", "sig"])

    return run


def _whole_sets(k: int):
    """(cls, text, digest) -> the sets of the texts that have the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s, starts in _sets(batch.column(1), k):
                cls = batch.column(0).slice(a, b - a)
                out = pa.RecordBatch.from_arrays([cls, _binary_rows(s.view(np.uint8), starts * 8)], names=["cls", "shingle_set"])
                yield out.filter(pc.equal(batch.column(2).slice(a, b - a), _digests(s, starts)))

    return run


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs (a, b, sig_a, sig_b) whose signatures agree well enough."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SLOTS) for i in (2, 3))
            keep = (x == y).mean(axis=1) >= LEAST_ALIKE
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = [_linked(np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64), percent) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return run


def _open_pairs(sig: np.ndarray, comp: np.ndarray, side: np.ndarray, band: int, two_sided: bool) -> Iterator[np.ndarray]:
    """Index pairs of different components, alike enough, that share no earlier band; most alike first in each stretch."""
    bands = sig.view(np.uint64)
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two_sided else (np.arange(len(sig)),) * 2
    for a in range(0, len(left), 64):
        i = left[a : a + 64]
        apart = comp[i][:, None] != comp[right][None, :]
        if not two_sided:
            apart &= i[:, None] < right[None, :]
        p, q = np.nonzero(apart)
        for c in range(0, len(p), 1 << 16):
            x, y = i[p[c : c + (1 << 16)]], right[q[c : c + (1 << 16)]]
            same = (sig[x] == sig[y]).sum(axis=1)
            ok = same >= LEAST_ALIKE * SLOTS
            x, y, same = x[ok], y[ok], same[ok]
            if band and len(x):
                first = ~(bands[x, :band] == bands[y, :band]).any(axis=1)
                x, y, same = x[first], y[first], same[first]
            if len(x):
                order = np.argsort(-same, kind="stable")
                yield np.stack([x[order], y[order]])


def _numbered(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode().indices.to_numpy()


def _needed(key, table):
    """Of a block's members those that some open pair needs."""
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, SLOTS)
    use = np.zeros(len(sig), bool)
    i, j = key[2].as_py(), key[3].as_py()
    for pairs in _open_pairs(sig, _numbered(table.column("comp")), table.column("side").to_numpy(), key[0].as_py(), i != j):
        use[pairs.ravel()] = True
    return table.select(["band", "bucket", "i", "j", "side", "cls", "comp", "sig"]).filter(pa.array(use))


def _joining(percent: int):
    def run(key, table):
        """Links that join different components, found on whole sets."""
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, SLOTS)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingle_set")]
        comp, cls = _numbered(table.column("comp")), table.column("cls").to_pylist()
        parent: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = parent.get(up, up)
                c = up
            return c

        out: list[tuple[int, int]] = []
        i, j = key[2].as_py(), key[3].as_py()
        for pairs in _open_pairs(sig, comp, table.column("side").to_numpy(), key[0].as_py(), i != j):
            for x, y in pairs.T.tolist():
                p, q = find(comp[x]), find(comp[y])
                if p != q and _linked(sets[x], sets[y], percent):
                    parent[max(p, q)] = min(p, q)
                    out.append((cls[x], cls[y]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) for each document of ``docs`` (doc_id, text).

    Documents are linked if their sets of distinct k-word shingles have 100 * intersection >= percent *
    union. component_id is the smallest doc_id reachable by links, kept is doc_id = component_id.
    """
    return _grouped(docs, k, percent, block).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """near_duplicates(), with a hash of the text and ``root``, the class that names the component (null for an empty set)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    sketch = materialize(hashed.mapInArrow(_sketch(k), "doc_id long, text_hash long, n_shingles long, digest binary, sig binary"), "sketch")
    classes = sketch.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")  # written once, so the numbers stay
    sigs = classes.select("cls", "sig")

    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.expr("sig").substr(i * 8 + 1, F.lit(8))))).alias("band", "bucket")
    members = sigs.select("cls", band)
    keys = ["band", "bucket"]
    buckets = members.groupBy(*keys).agg(F.min("cls").alias("first"), F.count("*").alias("n")).where("n > 1")
    members = materialize(members.join(buckets, keys).select(*keys, "cls", "first", "n"), "members")

    star = members.where("cls != first").select(F.col("first").alias("a"), F.col("cls").alias("b")).distinct()
    end = lambda c: sigs.select(F.col("cls").alias(c), F.col("sig").alias(f"sig_{c}"))
    pairs = star.join(end("b"), "b").join(end("a"), "a").select("a", "b", "sig_a", "sig_b")
    star = materialize(pairs.mapInArrow(_alike, "a long, b long"), "star")

    def whole(cls: DataFrame) -> DataFrame:
        """Sets of classes, from a row of the smallest id; rows that repeat it are left out."""
        wanted = classes.select("cls", "digest", F.col("rep").alias("doc_id")).join(cls, "cls")
        rows = docs.join(wanted, "doc_id").withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "cls", "h"])
        return rows.select("cls", "text", "digest").mapInArrow(_whole_sets(k), "cls long, shingle_set binary")

    wanted = materialize(star.select(F.col("a").alias("cls")).union(star.select("b")).distinct(), "wanted")
    sets = materialize(whole(wanted), "sets")
    side = lambda c: sets.select(F.col("cls").alias(c), F.col("shingle_set").alias(f"set_{c}"))
    pairs = star.join(side("b"), "b").join(side("a"), "a").select("a", "b", "set_a", "set_b")
    links = materialize(pairs.mapInArrow(_confirm(percent), "a long, b long"), "links")
    drop_tables(star, wanted, sets)

    comp = components(links)
    by_cls = comp.select(F.col("node").alias("cls"), F.col("component").alias("comp"))
    rest = members.where("n > 2 and cls != first").join(by_cls, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    rest = materialize(rest.select(*keys, "cls", "comp"), "rest")
    mixed = rest.groupBy(*keys).agg(F.count("*").alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y")
    # blocks i <= j of a bucket meet in one group; side tells which of the two a member belongs to
    blocks = F.ceil(F.col("n") / block).cast("int")
    rest_in = rest.join(mixed.select(*keys, blocks.alias("g")), keys).join(sigs, "cls").withColumn("own", F.pmod(F.xxhash64("cls"), "g").cast("int"))
    rest_in = rest_in.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select(
        *keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cls", "comp", "sig"
    )
    group = [*keys, "i", "j"]
    needed = rest_in.groupBy(*group).applyInArrow(_needed, "band int, bucket long, i int, j int, side int, cls long, comp long, sig binary")
    needed = materialize(needed, "needed")
    if not needed.isEmpty():
        wanted = materialize(needed.select("cls").distinct(), "wanted")
        sets = materialize(whole(wanted).dropDuplicates(["cls"]), "sets")
        more = needed.join(sets, "cls").groupBy(*group).applyInArrow(_joining(percent), "a long, b long")
        more = materialize(more, "links")
        if not more.isEmpty():
            old, comp = comp, components(links.union(more))
            drop_tables(old)
        drop_tables(wanted, sets, more)
    drop_tables(members, rest, needed, links)

    of_class = classes.select("digest", "cls", "rep").join(comp.select(F.col("node").alias("cls"), F.col("component").alias("root")), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = of_class.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = materialize(of_class.join(smallest, "root").select("digest", "root", "component_id"), "named")
    out = sketch.drop("sig").withColumn("digest", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest"))).join(named, "digest", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    out = out.select("doc_id", "text_hash", "n_shingles", "root", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    out = materialize(out, "grouped")
    drop_tables(sketch, classes, comp, named)
    return out


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, that of the smallest id, with the columns it came with.

    Rows of one id with texts that aren't linked are documents of their own; rows of one id and text, or of one id
    in one group, are one. Rows of one id without words are one. Rows without an id can't be told apart and all stay.
    """
    rows, columns = set_apart(docs, "doc_id", "text")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text_hash", F.coalesce(F.xxhash64("text"), F.lit(0)))
    grouped = _grouped(docs, k, percent, BLOCK)
    kept = grouped.where("kept").groupBy("doc_id", "root").agg(F.min("text_hash").alias("text_hash"))
    kept = materialize(kept.select("doc_id", "text_hash").distinct(), "kept")
    drop_tables(grouped)
    named = rows.join(kept, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return named.select(*columns).union(rows.where("doc_id is null").select(*columns))


#: DuckDB: all pairs, by the shingles they share.
ORACLE_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
x as (select doc_id, len(ws) as n, unnest(ws) as w, generate_subscripts(ws, 1) as i from w),
y as (select doc_id, n, i, array_to_string(list(w) over (partition by doc_id order by i rows between current row and 3 following), ' ') as s from x),
s as (select distinct doc_id, s from y where i <= n - 3 or (n < 4 and i = 1)),
c as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join c x on x.doc_id = a join c y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on r.b = e.a),
m as (select a as doc_id, min(b) as component_id from r group by a)
select d.doc_id, coalesce(c.n, 0)::bigint as n_shingles, m.component_id, d.doc_id = m.component_id as kept from documents d join m using (doc_id) left join c using (doc_id)
"""
