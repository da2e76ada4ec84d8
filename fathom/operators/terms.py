"""The term dictionary, per-document term statistics, and highlights."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.operators.intervals import edits
from fathom.plans.spread import spread


def held(df: DataFrame, *keep: str, **made: Column) -> DataFrame:
    """df's columns `keep` with columns made once a row, behind a generator, so that no use makes them again."""
    return df.select(*keep, *[F.explode(F.array(c)).alias(n) for n, c in made.items()])


def postings(df: DataFrame, id_field: str, tokens: Column, keep: str | None = None) -> DataFrame:
    """(id, term, tf, size): one row per document and term.

    Each document's tokens are sorted and counted in its own row, so nothing is shuffled and no task holds more than a
    row. `keep` is a whole-term regex; size counts all tokens.
    """
    t = spread(df, id_field).select(F.col(id_field).alias("id"), tokens.alias("raw"))
    t = held(t, "id", size=F.size("raw"), t=F.sort_array(F.filter("raw", lambda x: x.isNotNull()))).where(F.size("t") > 0)
    t = held(t, "id", "size", "t", first=F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i - 1) != F.get("t", i))))
    t = t.select("id", "size", "t", "first", F.posexplode("first").alias("k", "i"))
    t = t.select("id", "size", F.get("t", F.col("i")).alias("term"), (F.coalesce(F.get("first", F.col("k") + 1), F.size("t")) - F.col("i")).cast("long").alias("tf"))
    return t.where(F.col("term").rlike(f"^(?:{keep})$")) if keep else t


def term_list(df: DataFrame, tokens: Column, start: str | None = None, end: str | None = None, keep: str | None = None, drop: str | None = None, min_df: int = 0, min_tf: int = 0, only: list[str] | None = None, amount: int = -1) -> DataFrame:
    """(term, doc_freq, term_freq) by term: from `start` up to but without `end`, kept and dropped by whole-term regex.

    Each document's tokens are sorted in its own row, and a token unlike the one before it counts the document. Tokens
    out of range leave first, and what is shuffled are counts combined by task.
    """
    t = held(spread(df).select(tokens.alias("raw")), t=F.sort_array("raw"))
    one = t.select(F.posexplode("t").alias("at", "term"), "t")
    one = one.where(F.col("term").isNotNull())
    if start is not None:
        one = one.where(F.col("term") >= start)
    if end is not None:
        one = one.where(F.col("term") < end)
    if only is not None:
        one = one.where(F.col("term").isin(only))
    if keep:
        one = one.where(F.col("term").rlike(f"^(?:{keep})$"))
    if drop:
        one = one.where(~F.col("term").rlike(f"^(?:{drop})$"))
    one = one.select("term", F.when(F.col("at") == 0, 1).otherwise(F.when(F.get("t", F.col("at") - 1).eqNullSafe(F.col("term")), 0).otherwise(1)).alias("new"))
    out = one.groupBy("term").agg(F.sum("new").alias("doc_freq"), F.count("*").alias("term_freq"))
    out = out.where((F.col("doc_freq") >= min_df) & (F.col("term_freq") >= min_tf)).orderBy("term")
    return out if amount < 0 else out.limit(amount)


def behind(last: str) -> str:
    """The start of the next page behind the last term of one."""
    return last + "\0"


def fuzzy_terms(terms: DataFrame, word: str, most: int = 2, prefix: int = 0, swaps: bool = False) -> DataFrame:
    """Terms within an edit distance, with a score that falls with it."""
    t = terms.where(F.col("term").startswith(word[:prefix])) if prefix else terms
    if swaps:
        distance = F.pandas_udf(lambda s: s.map(lambda w: edits(word, w, most)), "int")
        t = t.where(F.abs(F.length("term") - len(word)) <= most).withColumn("distance", distance("term")).where(F.col("distance") <= most)
    else:
        t = t.withColumn("distance", F.levenshtein("term", F.lit(word), most)).where(F.col("distance") >= 0)
    return t.withColumn("score", 1 - F.col("distance") / F.greatest(F.lit(1), F.least(F.length("term"), F.lit(len(word)))))


def document_terms(df: DataFrame, id_field: str, tokens: Column, top: int = 10, order: str = "TFIDF", min_length: int = 0, max_length: int = 1 << 30, min_df: float = 0, max_df: float = 1 << 60, rows: int | None = None, keep: str | None = None) -> DataFrame:
    """(id, term, tf, doc_freq, score): each document's first terms by TFIDF, TF or alphabet (ABC).

    min_df and max_df below 1 are shares of all documents. Document frequencies are a window-free aggregate joined back.
    `keep` is a whole-term regex. Postings stream past a hash table of their range of terms, unsorted, and are sorted once,
    by document.
    """
    p = postings(df, id_field, tokens, keep).where(F.length("term").between(min_length, max_length))
    n = rows if rows is not None else df.select(id_field).count()
    freq = p.groupBy("term").agg(F.count("*").alias("doc_freq"))
    low, high = (x * n if x < 1 else x for x in (min_df, max_df))
    freq = freq.where(F.col("doc_freq").between(low, high))
    p = p.join(freq.hint("shuffle_hash"), "term").withColumn("score", F.col("tf") * F.log(F.lit(1.0) + F.lit(float(n)) / F.col("doc_freq")))
    key = {"TFIDF": [F.desc("score"), F.col("term")], "TF": [F.desc("tf"), F.col("term")], "ABC": [F.col("term")]}[order]
    # written so that Spark takes no limit from it: a document's postings meet in no task before the shuffle, so a sort there is for nothing
    ranked = p.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*key))).where(F.col("rank") - top <= 0)
    return ranked.select("id", "term", "tf", "doc_freq", "score", "rank")


def summary_terms(df: DataFrame, id_field: str, tokens: Column, top: int = 10, per_document: int | None = None, keep: str | None = None) -> DataFrame:
    """(term, tf, docs) over all hits, most frequent first; with per_document only of each one's first terms."""
    p = document_terms(df, id_field, tokens, per_document, "TFIDF", keep=keep) if per_document else postings(df, id_field, tokens, keep)
    return p.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("docs")).orderBy(F.desc("tf"), "term").limit(top)


def mark(text: Column, words: list[str], pre: str = "<em>", post: str = "</em>") -> Column:
    """The whole text with the words marked, whatever their case."""
    body = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}_])({body})(?![\p{{L}}\p{{N}}_])", f"{pre}$1{post}")


def fragments(text: Column, words: list[str], pre: str = "<em>", post: str = "</em>", number: int = 1, length: int = 100) -> Column:
    """Up to `number` stretches of about `length` characters with most of the words, marked; none without a word.

    Meant for the rows of one page: it runs in Python, in Arrow batches.
    """
    pattern = re.compile(r"(?<!\w)(" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + r")(?!\w)", re.I)

    def cut(s: str | None) -> list[str]:
        if s is None:
            return []
        parts, at = [], 0
        while at < len(s):
            end = at + length
            if end < len(s):
                space = s.rfind(" ", at + 1, end + 1)
                end = space + 1 if space > at else end
            parts.append(s[at:end])
            at = end
        scored = [(len(pattern.findall(p)), -i, p) for i, p in enumerate(parts)]
        best = sorted((x for x in scored if x[0]), reverse=True)[:number]
        return [pattern.sub(rf"{pre}\1{post}", p).strip() for _, _, p in sorted(best, key=lambda x: -x[1])]

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(cut)

    return run(text)
