"""Near-duplicate documents: bottom-k sketches, inverted lists of their values, exact Jaccard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import exchange as X
from fathom.llm import hashing as H
from fathom.llm.common import components, cut
from fathom.llm.run_index import ranges

#: Values in a sketch, and how many of them any linked pair shares: at a Jaccard similarity of 0.8 the number of the
#: union's 48 least values that are in both sets is below 20 with a probability of 1e-9.
K, SHARED = 48, 20
#: Neighbours in sketch order that linked pairs share: 27 of 47 on average at a similarity of 0.8, with a deviation of 4.
PAIRS = 4
#: Lists up to this length are compared by pairs of rows, longer ones by packed tiles of about TILE documents.
SHORT, TILE = 24, 512
#: Ids of documents that are read again: up to so many are broadcast, more are joined.
BROADCAST_IDS = 1_000_000
_NONE = np.uint64(2**64 - 1)


def shingle_sets(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's distinct shingles in order, and where each text's begin (one more at the end)."""
    buf, at = H.text_block(column)
    buf = H.LOWER[buf]
    start, end, doc = H.words_of(buf, at)
    words = H.spans_hash(buf, start, end, 1)
    edge = np.searchsorted(doc, np.arange(len(at)))
    n = max(0, len(words) - size + 1)
    own = np.flatnonzero(doc[:n] == doc[size - 1 :][:n]) if n else np.zeros(0, np.int64)
    keys, of = H.windows_hash(words, size, 1)[own], doc[own]
    for few in range(1, size):  # texts with fewer words are one shingle
        at_few = edge[:-1][np.diff(edge) == few]
        if len(at_few):
            keys, of = np.concatenate([keys, H.mix(H.windows_hash(words, few, 1)[at_few] + np.uint64(few))]), np.concatenate([of, doc[at_few]])
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    keys, of = keys[new], of[new]
    return keys, np.searchsorted(of, np.arange(len(at)))


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, number of shingles, a signature of the set in 128 bits, its K least hashes."""

    def run(batches):
        for whole in batches:
            for b in H.slices(whole):
                keys, edge = shingle_sets(b.column(1), shingle)
                n = np.diff(edge)
                full = np.flatnonzero(n)
                sig = np.zeros((2, len(n)), np.uint64)
                if len(full):
                    sig[0, full] = np.add.reduceat(H.mix(keys), edge[full])
                    sig[1, full] = np.add.reduceat(H.mix(keys ^ np.uint64(0xA5A5A5A5DEADBEEF)), edge[full])
                low = [keys[i : min(i + K, j)].tobytes() for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                yield pa.record_batch({"doc_id": b.column(0), "n_shingles": pa.array(n, pa.int64()), "s1": pa.array(sig[0].view(np.int64)), "s2": pa.array(sig[1].view(np.int64)), "sketch": pa.array(low, pa.binary())})

    return docs.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, sketch binary")


def _needed(n: np.ndarray) -> np.ndarray:
    """How many sketch values a set of n shingles shares with any partner: sets of up to 0.8 K are compared whole."""
    return np.where(n <= K * 4 // 5, -(-4 * n // 5), SHARED)


def _needed_pairs(n: np.ndarray) -> np.ndarray:
    """Likewise for pairs of neighbours: one that only the other set has breaks one, one that it lacks two.

    Sets that are compared whole share 0.6 n - 1 for certain; four or fewer shingles link with equal sets only.
    """
    return np.where(n <= K * 4 // 5, np.maximum(1, np.minimum(PAIRS, 3 * n // 5 - 1)), PAIRS)


def postings(reps: DataFrame, count: int) -> DataFrame:
    """(value, id, n): the inverted lists that generate candidates.

    A list belongs to two values that are neighbours in a sketch: unrelated documents seldom share such a pair, while
    linked ones share many (PAIRS). Of m pairs, of which a partner shares k or more, any m - k + 1 hold a shared one. The
    rarest over all documents are taken, so lists of common passages aren't used; pairs found once have no list.
    """
    size = 1 << max(0, (-(-count * K * 8 // X.BLOCK_BYTES) - 1).bit_length())
    reps = reps.select("id", F.col("n_shingles").alias("n"), "sketch", F.pmod(F.xxhash64("id"), F.lit(size)).cast("int").alias("blk"))

    def values(t: pa.Table):
        t = t.take(pa.array(np.lexsort((t.column("n").to_numpy(), t.column("id").to_numpy()))))
        parts = [np.frombuffer(x, np.uint64) for x in t.column("sketch").to_pylist()]
        parts = [H.mix(x[:-1] + H.mix(x[1:])) for x in parts]
        lens = np.array([len(x) for x in parts], np.int64)
        keys = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        return t, lens, keys, *np.unique(keys, return_inverse=True, return_counts=True)

    def first(t: pa.Table) -> pa.Table:
        _, _, _, one, _, many = values(t)
        return X.messages(X.ask(t.column("blk")[0].as_py(), size, one, many.astype(np.int32)))

    def bucket(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        sizes = [len(r["a"]) // 12 for r in rows]
        one, group = np.unique(np.concatenate([np.frombuffer(r["a"], np.uint64, n) for r, n in zip(rows, sizes, strict=True)]), return_inverse=True)
        total = np.zeros(len(one), np.int32)
        np.add.at(total, group, np.concatenate([np.frombuffer(r["a"], np.int32, n, 8 * n) for r, n in zip(rows, sizes, strict=True)]))
        return X.messages([(r["bucket"], r["blk"], 1, total[group[e - n : e]].tobytes(), b"") for r, n, e in zip(rows, sizes, np.cumsum(sizes), strict=True)])

    def last(t: pa.Table, said: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("value", "id", "n")})
        t, lens, keys, one, group, _ = values(t)
        total = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(a, np.int32) for _, a in X.answers(said)[1])])[group]
        who = np.repeat(np.arange(len(lens)), lens)
        order = np.lexsort((keys, total, who))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(lens) - lens, lens)
        keep = rank <= (lens - _needed_pairs(t.column("n").to_numpy()))[who[order]]
        order = order[keep]
        order = order[total[order] > 1]
        return pa.table({"value": pa.array(keys[order].view(np.int64)), **{c: pa.array(t.column(c).to_numpy()[who[order]]) for c in ("id", "n")}})

    said = reps.groupBy("blk").applyInArrow(first, X.MESSAGE).groupBy("bucket").applyInArrow(bucket, X.MESSAGE)
    return reps.groupBy("blk").cogroup(said.groupBy("blk")).applyInArrow(last, "value long, id long, n long")


def estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose sketches allow a similarity of 0.8: of the union's K least values enough are in both."""

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                b = whole.slice(i, 4096)
                n = [b.column(c).to_numpy() for c in (2, 3)]
                wide = np.full((b.num_rows, 2 * K), _NONE)
                for side, c in ((0, 4), (K, 5)):
                    for r, x in enumerate(b.column(c).to_pylist()):
                        v = np.frombuffer(x, np.uint64)
                        wide[r, side : side + len(v)] = v
                wide.sort(axis=1)
                real = wide != _NONE
                twice = np.zeros_like(real)
                twice[:, 1:] = (wide[:, 1:] == wide[:, :-1]) & real[:, 1:]
                place = np.cumsum(real & ~twice, axis=1)
                both = (twice & (place <= K)).sum(axis=1)
                small = (n[0] <= K) & (n[1] <= K)
                ok = np.where(small, 100 * twice.sum(axis=1) >= 80 * place[:, -1], both >= np.minimum(SHARED, np.minimum(_needed(n[0]), _needed(n[1]))))
                yield pa.record_batch({"a": b.column(0), "b": b.column(1)}).filter(pa.array(ok))

    def side(x: str) -> DataFrame:
        return reps.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    near = pairs.join(side("a"), "a").join(side("b"), "b").where("100 * least(na, nb) >= 80 * greatest(na, nb)")
    return near.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def again(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents whose doc_id is in `ids` (distinct); the ids are broadcast if they are few."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("doc_id", "text")


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(id, s): the packed set of every document whose doc_id is in `wanted`, made again from its text."""

    def sets(batches):
        for whole in batches:
            for b in H.slices(whole):
                keys, edge = shingle_sets(b.column(1), shingle)
                yield pa.record_batch({"id": b.column(0), "s": pa.array([keys[i:j].tobytes() for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.binary())})

    return again(docs, wanted).mapInArrow(sets, "id long, s binary")


def linked_rows(p: list[np.ndarray], q: list[np.ndarray], cp: np.ndarray, cq: np.ndarray) -> list[tuple[int, int]]:
    """For every set of p, one linked set of q (by row) for each component there that isn't its own.

    Inverted lists of q's sketches count overlaps; where enough are shared, lists of q's whole sets give the exact ones.
    """

    def lists(sets: list[np.ndarray]):
        keys = np.concatenate(sets)
        order = np.argsort(keys, kind="stable")
        return keys[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]

    def overlaps(x: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        i, j = np.searchsorted(keys, x, "left"), np.searchsorted(keys, x, "right")
        return np.bincount(rows[ranges(i, j - i)], minlength=len(q))

    size = np.array([len(s) for s in q])
    sketch, whole, out = lists([s[:K] for s in q]), lists(q), []
    for r, x in enumerate(p):
        able = (cq != cp[r]) & (100 * np.minimum(size, len(x)) >= 80 * np.maximum(size, len(x)))
        if able.any() and (able & (overlaps(x[:K], *sketch) >= np.minimum(SHARED, np.minimum(_needed(size), _needed(np.array(len(x))))))).any():
            both = overlaps(x, *whole)
            hit = np.flatnonzero(able & (100 * both >= 80 * (size + len(x) - both)))
            _, first = np.unique(cq[hit], return_index=True)
            out += [(r, int(j)) for j in hit[first]]
    return out


def tiled(member: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Links between components in long lists: (a, b), for each document at most one into each other component.

    member: value, id, c (component) of long lists. Lists with the same least component are taken together, as lists of
    one group of near copies hold much the same documents. Its most frequent component, already linked, is never
    compared within; all others are, with it and with each other, tile by tile.
    """
    low = member.groupBy("value").agg(F.min("c").alias("g"))
    m = member.join(low, "value").select("g", "id", "c").distinct()
    per = m.groupBy("g", "c").agg(F.count("*").alias("n")).groupBy("g").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    m = m.join(per, "g").withColumn("rest", F.col("c") != F.col("main"))
    of = F.when(F.col("rest"), F.col("n") - F.col("most")).otherwise(F.col("most"))
    m = cut(m.select("g", "id", "c", "rest", F.pmod(F.xxhash64("id"), F.ceil(of / TILE)).cast("int").alias("tile")))

    def pack(t: pa.Table) -> pa.Table:
        sets = t.column("s").to_pylist()
        one = {c: t.column(c)[:1] for c in ("g", "rest", "tile")}
        lens = np.array([len(s) // 8 for s in sets], np.int64)
        return pa.table(one | {"ids": pa.array([t.column("id").to_numpy().tobytes()], pa.binary()), "cs": pa.array([t.column("c").to_numpy().tobytes()], pa.binary()), "lens": pa.array([lens.tobytes()], pa.binary()), "sets": pa.array([b"".join(sets)], pa.binary())})

    def compare(batches):
        for b in batches:
            for r in range(b.num_rows):
                got = [np.frombuffer(b.column(k)[r].as_buffer(), np.uint64 if k in (3, 7) else np.int64) for k in range(8)]
                sets = [np.split(got[k], np.cumsum(got[k - 1])[:-1]) for k in (3, 7)]
                links = linked_rows(*sets, got[1], got[5])
                yield pa.record_batch({"a": pa.array([int(got[0][i]) for i, _ in links], pa.int64()), "b": pa.array([int(got[4][j]) for _, j in links], pa.int64())})

    full = full_sets(docs, m.select(F.col("id").alias("doc_id")).distinct(), shingle)
    tiles = cut(m.join(full, "id").select("g", "rest", "tile", "id", "c", "s").groupBy("g", "rest", "tile").applyInArrow(pack, "g long, rest boolean, tile int, ids binary, cs binary, lens binary, sets binary"))
    p, q = tiles.where("rest").alias("p"), tiles.alias("q")
    met = p.join(q, (F.col("p.g") == F.col("q.g")) & (~F.col("q.rest") | (F.col("p.tile") <= F.col("q.tile"))))
    return met.select("p.ids", "p.cs", "p.lens", "p.sets", "q.ids", "q.cs", "q.lens", "q.sets").toDF(*"abcdefgh").repartition("a", "e").mapInArrow(compare, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Pairs with 100 * intersection >= 80 * union over the full sets, which are made again from the texts.

    Texts travel, not sets: they take a third of the bytes.
    """

    def exact(batches):
        for whole in batches:
            for b in H.slices(whole, "ta"):
                p, at = shingle_sets(b.column(2), shingle)
                one = b.column(3).dictionary_encode()
                q, of = shingle_sets(one.dictionary, shingle)
                ok = []
                for r, j in enumerate(one.indices.to_pylist()):
                    x, y = p[at[r] : at[r + 1]], q[of[j] : of[j + 1]]
                    i = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * i >= 80 * (len(x) + len(y) - i) and i > 0)
                yield pa.record_batch({"a": b.column(0), "b": b.column(1)}).filter(pa.array(ok, pa.bool_()))

    pairs = cut(pairs)
    texts = again(docs.where("text is not null"), pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    both = pairs.join(texts.selectExpr("doc_id as a", "text as ta"), "a").join(texts.selectExpr("doc_id as b", "text as tb"), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(exact, "a long, b long").distinct()


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) after more links, which are followed between the components found so far."""
    ends = {c: found.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in "ab"}
    edges = cut(links.join(ends["a"], "a", "left").join(ends["b"], "b", "left").select(F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v")).where("u <> v"))
    if edges.isEmpty():
        return found
    more = components(edges, "u", "v")
    old = found.join(more.select(F.col("id").alias("component"), F.col("component").alias("low")), "component", "left").select("id", F.coalesce("low", "component").alias("component"))
    return cut(old.union(more.join(found, "id", "left_anti")))


def near_duplicates(docs: DataFrame, shingle: int = 2) -> DataFrame:
    """One row per document: n_shingles, component_id (the least doc_id reachable by links) and kept.

    Documents link when 100 * intersection >= 80 * union of their sets of distinct shingles of `shingle` words (A-Z
    lower-cased; a text with fewer words is one shingle; one with none links with nothing). Documents with equal sets
    become one before anything else, so thousands of copies cost one signature each. Candidates come from inverted
    lists of neighbouring sketch values (`postings`), whose hubs are three of their members. First each document meets the
    hub that it shares most lists with, which settles most of a group of near copies in proportion to its size; then its
    other hubs, if they are in other components; then all pairs that are still apart, of short lists as rows, of long
    ones in packed tiles. Sketches filter them, full sets confirm each. No list is capped.

    Null and empty texts get an empty set and their own component. Rows that repeat a doc_id count as one document,
    which has the links of each. Rows without doc_id link with nothing, have no component and are kept. Other columns
    go; empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    each = cut(sketches(docs, shingle))
    same = each.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch"))
    reps = cut(same)
    lists = cut(postings(reps, reps.count()))
    fit = "100 * least(n, m) >= 80 * greatest(n, m)"
    ends = [F.min(F.struct("id", "n")), F.max(F.struct("id", "n")), F.min_by(F.struct("id", "n"), F.xxhash64("id"))]
    hubs = lists.groupBy("value").agg(*(e.alias(x) for e, x in zip(ends, "xyz", strict=True))).where("x.id < y.id")
    star = lists.join(hubs, "value").select("id", "n", F.explode(F.array_distinct(F.array("x", "y", "z"))).alias("h")).select("id", "n", F.col("h.id").alias("h"), F.col("h.n").alias("m"))
    star = cut(star.where("id <> h").where(fit).groupBy("id", "h").agg(F.count("*").alias("k")))
    pair = [F.least("id", "h").alias("a"), F.greatest("id", "h").alias("b")]
    best = star.groupBy("id").agg(F.max_by("h", F.struct("k", -F.col("h"))).alias("h")).select(*pair).distinct()
    found = components(verified(estimated(best, reps), docs, shingle))
    part = found.select(F.col("id").alias("h"), F.col("component").alias("d"))
    apart = star.join(found, "id", "left").join(part, "h", "left").where("coalesce(component, id) <> coalesce(d, h)").select(*pair).distinct()
    star = star.select(*pair).distinct()
    found = merged(found, verified(estimated(apart, reps), docs, shingle))
    member = lists.join(found, "id", "left").select("value", "id", "n", F.coalesce("component", "id").alias("c"))
    open_lists = member.groupBy("value").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("many")).where("lo < hi and many > 2").select("value", "many")
    member = cut(member.join(open_lists, "value"))
    short, other = member.where(F.col("many") <= SHORT), member.where(F.col("many") <= SHORT).select("value", F.col("id").alias("h"), F.col("n").alias("m"), F.col("c").alias("d"))
    cross = short.join(other, "value").where("id < h and c <> d").where(fit).select(F.col("id").alias("a"), F.col("h").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    more = verified(estimated(cross, reps), docs, shingle).union(tiled(member.where(F.col("many") > SHORT), docs, shingle))
    final = merged(found, more)
    own = each.drop("sketch").join(reps.select("s1", "s2", "n_shingles", "id"), ["s1", "s2", "n_shingles"], "left")
    own = own.join(final, "id", "left").select("doc_id", "n_shingles", F.coalesce("component", "id", "doc_id").alias("component_id"))
    return own.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
