"""Finds benchmark items in documents, re-parameterised ones too, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import cut

TOKEN = r"[0-9]+(?:[.,][0-9]+)*|\p{L}[\p{L}'-]*"
#: TOKEN with each character as a token of its own where scripts have no spaces between words.
SPACELESS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
FINE = rf"[0-9]+(?:[.,][0-9]+)*|[{SPACELESS}]\p{{M}}*|[\p{{L}}&&[^{SPACELESS}]][[\p{{L}}&&[^{SPACELESS}]]'-]*"
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "lb", "oz", "ml", "l", "s", "sec", "min", "h", "hr", "hours", "minutes", "seconds", "days", "meters", "miles", "dollars", "euros", "usd", "eur", "percent")
#: Template tokens in a window, the share of an item's windows that a leak has, and windows or documents to broadcast.
WINDOW, SHARE, BROADCAST_ROWS = 5, 0.8, 500_000
#: Shifts, in tokens, between the parts of one occurrence: none, and inserted or lost words up to each of these.
SHIFTS = (0, 4, 16, 64)


def _template(raw, cased: bool = True):
    """A number, a unit, a name (a word that begins with a capital, if case counts), or else the word in lower case."""
    head, low = F.substring(raw, 1, 1), F.lower(raw)
    slot = F.when(head.between("0", "9"), "<NUM>").when(low.isin(*UNITS), "<UNIT>")
    return (slot.when(head != F.lower(head), "<NAME>") if cased else slot).otherwise(low)


def _countable(w: DataFrame) -> DataFrame:
    """The windows with two plain words or more."""
    return w.where(F.size(F.filter("tpl", lambda x: ~x.startswith("<"))) >= 2)


def _held(df: DataFrame, *keep: str, **made) -> DataFrame:
    """df's columns `keep` with columns made once a row, behind a generator, so that no use makes them again."""
    return df.select(*keep, *[F.explode(F.array(c)).alias(n) for n, c in made.items()])


def _hashes(tokens: str, size: int):
    """For each token hash: a hash of it and the next ones of its window, null where the text ends before."""
    near = lambda i: [F.get(F.col(tokens), i + k) for k in range(1, size)]
    return F.transform(tokens, lambda x, i: F.when(i <= F.size(tokens) - size, F.xxhash64(x, *near(i))))


def windows(texts: DataFrame, key: str, size: int, cased: bool = True) -> DataFrame:
    """(key, row, at, h, tpl, raw) for every window of `size` template tokens: its text, position, hash and tokens."""
    t = texts.select(F.col(key), F.xxhash64("text").alias("row"), F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("raw")).where(F.size("raw") >= size)
    t = _held(t, key, "row", raw=F.col("raw"))
    t = _held(t, key, "row", "raw", tpl=F.transform("raw", lambda x: _template(x, cased)))
    t = _held(t, key, "row", "raw", "tpl", th=F.transform("tpl", lambda x: F.xxhash64(x)))
    t = t.select(key, "row", "raw", "tpl", F.posexplode(_hashes("th", size)).alias("at", "h")).where("h is not null")
    return t.select(key, "row", "at", "h", F.slice("tpl", F.col("at") + 1, size).alias("tpl"), F.slice("raw", F.col("at") + 1, size).alias("raw"))


def found_windows(docs: DataFrame, known: DataFrame, size: int, few: bool) -> DataFrame:
    """(doc_id, cased, h), each once, for the windows in `known` (cased, h), of both templates, in one pass over the texts.

    The templates differ in capitalised words only, so the second is made from the hashes of the first.
    """
    name, number, unit = (F.xxhash64(F.lit(x)) for x in ("<NAME>", "<NUM>", "<UNIT>"))
    t = docs.select("doc_id", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("raw")).where(F.size("raw") >= size)
    t = _held(t, "doc_id", raw=F.col("raw"))
    t = _held(t, "doc_id", "raw", u=F.transform("raw", lambda x: F.xxhash64(_template(x, False))))
    plain = lambda x, h: h.isin(number, unit) | (F.substring(x, 1, 1) == F.lower(F.substring(x, 1, 1)))
    t = _held(t, "doc_id", "u", c=F.transform("raw", lambda x, i: F.when(plain(x, F.get("u", i)), F.get("u", i)).otherwise(name)))
    both = F.array(*[F.struct(F.lit(cased).alias("cased"), _hashes(x, size).alias("w")) for cased, x in ((False, "u"), (True, "c"))])
    t = t.select("doc_id", F.explode(both).alias("k")).select("doc_id", "k.cased", F.explode("k.w").alias("h")).where("h is not null")
    return t.join(F.broadcast(known) if few else known, ["cased", "h"]).groupBy("doc_id", "cased", "h").agg(F.lit(1).alias("one")).select("doc_id", "cased", "h")


def _consistent(pairs: DataFrame, by: list[str], share: float) -> DataFrame:
    """The groups whose slot values in the item go with one value in the document, in `share` or more of the slots."""
    slot = F.filter(F.arrays_zip("tpl", "asked", "given"), lambda z: z["tpl"].startswith("<"))
    slots = pairs.select(*by, F.explode_outer(slot).alias("z")).groupBy(*by, "z.asked", "z.given").agg(F.count("*").alias("n"))
    most = slots.groupBy(*by, "asked").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    agree = most.groupBy(*by).agg(F.sum(F.when(F.col("asked").isNotNull(), F.col("top"))).alias("top"), F.sum(F.when(F.col("asked").isNotNull(), F.col("n"))).alias("n"))
    return agree.where(F.coalesce(F.col("top") >= share * F.col("n"), F.lit(True))).select(*by)


def _occurrences(pairs: DataFrame, own: DataFrame, share: float) -> DataFrame:
    """(doc_id, item_id) where one occurrence has `share` of an item's windows and is consistent by itself.

    An occurrence starts at a shift between item and document. Of each window of the item it takes the match whose
    shift is nearest, if not further off than one of SHIFTS; each of these is tried. Matches meet shifts by ranges of
    shifts, so a document with many occurrences costs in proportion to them.
    """
    need = own.groupBy("item_id", F.col("row").alias("item_row")).agg(F.count_distinct("h").alias("need"))
    whole, width = ["doc_id", "doc_row", "item_id", "item_row"], max(SHIFTS)
    pairs = pairs.withColumn("shift", F.col("doc_at") - F.col("item_at")).withColumn("range", F.floor(F.col("shift") / width))
    starts = pairs.select(*whole, F.col("shift").alias("start")).distinct()
    starts = starts.withColumn("range", F.explode(F.array(*[F.floor(F.col("start") / width) + k for k in (-1, 0, 1)])))
    near = pairs.join(starts, [*whole, "range"]).withColumn("off", F.abs(F.col("shift") - F.col("start"))).where(F.col("off") <= width)
    best = near.groupBy(*whole, "start", "item_at").agg(F.min(F.struct("off", "shift", "h", "tpl", "asked", "given")).alias("m")).select(*whole, "start", "m.*")
    one = [*whole, "start", "reach"]
    tried = best.withColumn("reach", F.explode(F.array(*[F.lit(k) for k in SHIFTS]))).where("off <= reach")
    full = tried.groupBy(*one).agg(F.count_distinct("h").alias("n")).join(need, ["item_id", "item_row"]).where(F.col("n") >= share * F.col("need")).select(*one)
    return _consistent(tried.join(full, one), one, share).select("doc_id", "item_id").distinct()


def _found(docs: DataFrame, items: DataFrame, size: int, share: float) -> DataFrame:
    """`leaks` by templates with names (cased) and without."""
    own = {cased: cut(_countable(windows(items, "item_id", size, cased))) for cased in (True, False)}
    known = {cased: own[cased].select("item_id", "h").distinct() for cased in own}
    every = known[True].select(F.lit(True).alias("cased"), "h").union(known[False].select(F.lit(False).alias("cased"), "h")).distinct()
    small = every.count() <= BROADCAST_ROWS
    hit = cut(found_windows(docs, every, size, small))
    return _judged(docs, own[True], known[True], hit.where("cased"), size, share, True, small).union(_judged(docs, own[False], known[False], hit.where("not cased"), size, share, False, small))


def _judged(docs: DataFrame, own: DataFrame, known: DataFrame, hit: DataFrame, size: int, share: float, cased: bool, small: bool) -> DataFrame:
    """The items of which a document has enough windows (hit), with consistent slots."""
    need = known.groupBy("item_id").agg(F.count("*").alias("need"))
    hint = F.broadcast if small else lambda df: df
    some = hit.select("doc_id", "h").join(hint(known), "h").groupBy("doc_id", "item_id").agg(F.count("*").alias("n")).join(hint(need), "item_id")
    some = cut(some.where(F.col("n") >= share * F.col("need")).select("doc_id", "item_id", (F.col("n") / F.col("need")).alias("share")))
    ids = some.select("doc_id").distinct()
    few = ids.count() <= BROADCAST_ROWS
    again = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    mine = windows(again, "doc_id", size, cased).join(hint(known.select("h").distinct()), "h", "left_semi")
    mine = mine.select("doc_id", F.col("row").alias("doc_row"), F.col("at").alias("doc_at"), "h", "tpl", F.col("raw").alias("given"))
    asked = own.select("item_id", F.col("row").alias("item_row"), F.col("at").alias("item_at"), "h", F.col("raw").alias("asked"))
    # a window meets the items that its document may hold, not all that share it
    both = ["doc_id", "item_id"]
    pairs = cut(mine.join(some.drop("share"), "doc_id").join(hint(asked), ["item_id", "h"]))
    pooled = cut(_consistent(pairs, both, share))
    single = _occurrences(pairs.join(pooled, both, "left_anti"), own, share)
    return some.join(pooled.union(single), both, "left_semi").select(*both, "share")


def _head_hash(k: int):
    """From a position in the tokens f to a hash of k tokens."""
    return lambda i: F.xxhash64(F.array_join(F.slice("f", i, k), " "))


def _exact(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(doc_id, item_id, share) for items without countable windows or with a script without spaces, or None.

    They are compared by their whole sequence of tokens in lower case, where characters of such scripts are tokens, as
    the words around a copy run into those of TOKEN. Sequences meet by a hash of their first tokens, as many as the
    greatest power of two in them, and are then compared whole. The driver sees the distinct powers.
    """
    fine = lambda df, key: df.select(key, F.transform(F.regexp_extract_all("text", F.lit(FINE), F.lit(0)), F.lower).alias("f")).where(F.size("f") > 0)
    have = _countable(windows(items, "item_id", size, True)).select("item_id").union(_countable(windows(items, "item_id", size, False)).select("item_id")).distinct()
    rare = fine(items.join(have, "item_id", "left_anti").union(items.where(F.col("text").rlike(f"[{SPACELESS}]"))), "item_id").distinct()
    rare = cut(rare.withColumn("k", F.expr("cast(1 as int) << cast(floor(log2(size(f))) as int)")).select("item_id", "k", _head_hash(F.col("k"))(1).alias("h"), F.array_join("f", " ").alias("asked")))
    sizes = [r.k for r in rare.select("k").distinct().collect()]
    whole = None
    for k in sizes:
        # a separate pass for each power; the benchmark of the test data needs none
        at = F.transform(F.sequence(F.lit(1), F.size("f") - (k - 1)), _head_hash(k))
        own = rare.where(F.col("k") == k).drop("k")
        hashes = fine(docs, "doc_id").where(F.size("f") >= k).select("doc_id", F.explode(F.array_distinct(at)).alias("h"))
        hit = hashes.join(F.broadcast(own) if own.count() <= BROADCAST_ROWS else own, "h").select("doc_id", "item_id", "asked").distinct()
        whole = hit if whole is None else whole.union(hit)
    if whole is None:
        return None
    texts = fine(docs, "doc_id").select("doc_id", F.concat(F.lit(" "), F.array_join("f", " "), F.lit(" ")).alias("given"))
    whole = texts.join(whole, "doc_id").where(F.contains("given", F.concat(F.lit(" "), "asked", F.lit(" "))))
    return whole.select("doc_id", "item_id").distinct().withColumn("share", F.lit(1.0))


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, share): the items that a document holds, for documents with a doc_id.

    Texts become templates: numbers, units and names (capitalised words) turn into typed placeholders, other words into
    lower case, and punctuation goes. A document holds an item if it has `share` or more of the item's distinct windows
    of `size` template tokens, and its slots are consistent, over all windows found or in one occurrence that has `share`
    of the windows by itself: each slot value of the item goes with one value in the document, in `share` or more of the
    slots. Windows with fewer than two plain words don't count.

    All this is done twice, and what either finds counts: as told, and with case put aside, where names stay words in
    lower case. The second finds copies in capitals or in lower case only; their names must be those of the item.

    Windows meet in a hash join, broadcast if the benchmark has no more than BROADCAST_ROWS of them; likewise the
    documents with enough windows, which alone are read again for their slots. Items without
    countable windows, or in scripts without spaces, are matched exactly by all their tokens, see `_exact`; those without any token are
    not found. Null texts hold nothing; rows that repeat a doc_id are taken together,
    as are rows that repeat an item_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    both = _found(docs, items, size, share)
    whole = _exact(docs, items, size)
    both = both if whole is None else both.union(whole)
    return both.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: contaminated, n_items that it holds, the least of their item_ids. See `leaks`."""
    found = leaks(docs, benchmark).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.min("item_id").alias("item_id"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, "doc_id", "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id")


ORACLE = r"""
with recursive src as (select 'd' as kind, doc_id as id, regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*|\p{L}[\p{L}''-]*') as raw from documents where doc_id is not null
  union all select 'b', item_id, regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*|\p{L}[\p{L}''-]*') from benchmark where item_id is not null),
tpl as (select kind, id, raw, list_transform(raw, lambda x: case when substr(x, 1, 1) between '0' and '9' then '<NUM>' when lower(x) in (UNITS) then '<UNIT>'
  when substr(x, 1, 1) <> lower(substr(x, 1, 1)) then '<NAME>' else lower(x) end) as tpl from src where len(raw) >= 5),
win as (select kind, id, unnest(list_transform(range(1, len(raw) - 3), lambda i: {'t': tpl[i:i + 4], 'r': raw[i:i + 4]})) as w from tpl),
own as (select id as item_id, w.t as t, w.r as r from win where kind = 'b' and len(list_filter(w.t, lambda x: not starts_with(x, '<'))) >= 2),
known as (select distinct item_id, t from own),
need as (select item_id, count(*) as need from known group by item_id),
hit as (select distinct id as doc_id, w.t as t from win where kind = 'd' and w.t in (select t from known)),
enough as (select doc_id, item_id from hit join known using (t) join need using (item_id) group by doc_id, item_id, need having count(*) >= 0.8 * need),
pair as (select s.doc_id, s.item_id, unnest(list_filter(list_transform(range(1, 6), lambda i: case when starts_with(own.t[i], '<') then {'a': own.r[i], 'g': win.w.r[i]} end), lambda z: z is not null)) as z
  from enough s join own using (item_id) join win on win.kind = 'd' and win.id = s.doc_id and win.w.t = own.t),
most as (select doc_id, item_id, a, max(n) as top, sum(n) as n from (select doc_id, item_id, z.a as a, z.g as g, count(*) as n from pair group by all) group by all),
agree as (select doc_id, item_id, sum(top) as top, sum(n) as n from most group by all),
leak as (select doc_id, item_id from enough left join agree using (doc_id, item_id) where n is null or top >= 0.8 * n)
select d.doc_id, l.n is not null as contaminated, coalesce(l.n, 0)::bigint as n_items, l.item_id from documents d
left join (select doc_id, count(*) as n, min(item_id) as item_id from leak group by doc_id) l using (doc_id)
""".replace("UNITS", ", ".join(f"'{u}'" for u in UNITS)).replace("with recursive", "with")
