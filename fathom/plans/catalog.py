"""Every query over the driver's tables, with the SQL that says what it returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.config import FieldConfig, IndexConfig
from fathom.functions import analysis
from fathom.operators import facets as FA
from fathom.operators import ml, similar, store, terms
from fathom.operators import vectors as V
from fathom.operators.search import Clause, CountFacet, DrillDown, Search, Searcher, Sort, project, range_text, union_indexes, values_text
from fathom.sources.readers import read_csv, read_json_array, read_json_lines, read_tsv, typed
from fathom.sources.scratch import scratch
from fathom.sources.writers import as_text, write_csv, write_json_lines, write_tsv
from fathom.streaming.nrt import windowed_facets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FC = FieldConfig
DOCS = IndexConfig("documents", "doc_id", (FC("doc_id", "LONG", sort="STANDARD"), FC("text", "STRING", {"text": "standard", "stem": "minStem", "kstem": "kstem", "pair": "twoTwoShingle", "whole": "lcKeyword"}), FC("lang", "STRING", {"lang": "keyword"}, "STANDARD", "FLAT"), FC("source", "STRING", {"source": "keyword"}, "STANDARD", "FLAT"), FC("n_chars", "LONG", sort="STANDARD")), ("text",), {"anywhere": ("text", "lang")})
ORDERS = IndexConfig("orders", "o_orderkey", (FC("o_orderkey", "LONG", sort="STANDARD"), FC("o_custkey", "LONG", sort="STANDARD"), FC("o_orderstatus", "STRING", {"o_orderstatus": "keyword"}, "STANDARD", "FLAT"), FC("o_totalprice", "DOUBLE", sort="STANDARD"), FC("o_orderdate", "DATE", sort="STANDARD", facet="HIERARCHICAL"), FC("o_orderpriority", "STRING", {"o_orderpriority": "lcKeyword", "prio": "standard"}, "LOWERCASE", "FLAT")), ("prio",))
LINES = IndexConfig("lineitem", "lid", (FC("lid", "LONG", sort="STANDARD"), FC("l_quantity", "DOUBLE", sort="STANDARD"), FC("l_extendedprice", "DOUBLE", sort="STANDARD"), FC("l_discount", "DOUBLE", sort="STANDARD"), FC("l_linenumber", "INT", sort="STANDARD", facet="FLAT"), FC("l_returnflag", "STRING", {"l_returnflag": "keyword"}, "STANDARD", "FLAT"), FC("l_linestatus", "STRING", {"l_linestatus": "keyword"}, "STANDARD", "FLAT"), FC("l_shipdate", "DATE", sort="STANDARD", facet="FLAT")))
PART = IndexConfig("part", "p_partkey", (FC("p_partkey", "LONG", sort="STANDARD"), FC("p_name", "STRING", {"p_name": "standard"}, "LOWERCASE_FOLDING"), FC("p_brand", "STRING", {"p_brand": "lcKeyword"}, "STANDARD", "FLAT"), FC("p_type", "STRING", {"p_type": "standard"}, "STANDARD", "FLAT"), FC("p_size", "INT", sort="STANDARD", facet="FLAT"), FC("p_retailprice", "DOUBLE", sort="STANDARD")), ("p_name",))
CUST = IndexConfig("customer", "c_custkey", (FC("c_custkey", "LONG", sort="STANDARD"), FC("c_name", "STRING", {"c_name": "standard"}, "STANDARD"), FC("c_acctbal", "DOUBLE", sort="STANDARD"), FC("c_nationkey", "INT", sort="STANDARD", facet="FLAT"), FC("c_mktsegment", "STRING", {"c_mktsegment": "lcKeyword"}, "STANDARD", "FLAT"), FC("place", "GEO_POINT", lat_key="lat", lon_key="lon")))
EMB = IndexConfig("embeddings", "vec_id", (FC("vec_id", "LONG", sort="STANDARD"), FC("label", "INT", sort="STANDARD", facet="FLAT"), FC("embedding", "UNIT_VECTOR", dimension=64)))
EVENTS = IndexConfig("events", "event_id", (FC("event_id", "LONG", sort="STANDARD"), FC("event_type", "STRING", {"event_type": "keyword"}, "STANDARD", "FLAT"), FC("value", "DOUBLE", sort="STANDARD"), FC("user_id", "LONG", sort="STANDARD", facet="FLAT"), FC("ts", "DATE", sort="STANDARD", facet="FLAT")))
USERS = IndexConfig("users", "user_id", (FC("user_id", "LONG", sort="STANDARD"), FC("kinds", "STRING", {"kinds": "keyword"}, "STANDARD", "FLAT"), FC("amounts", "DOUBLE", sort="STANDARD"), FC("days", "INT", sort="STANDARD", facet="FLAT")))
#: Tokens of the standard analyzer, in SQL.
TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
T_TEXT, T_NAME = TOK.format("text"), TOK.format("p_name")


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark, sf) -> Searcher:
    return Searcher(t(spark, sf, "lineitem").withColumn("lid", F.col("l_orderkey") * 10 + F.col("l_linenumber")), LINES)


def users(spark, sf) -> Searcher:
    """One row per user with lists: the many-valued fields that no table has by itself."""
    e = t(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"), F.array_sort(F.collect_list(F.round("value", 2))).alias("amounts"), F.array_sort(F.collect_set(F.dayofmonth("ts"))).alias("days"))
    return Searcher(e, USERS)


USERS_SQL = "(select user_id, list_sort(list_distinct(list(event_type))) as kinds, list_sort(list(round(value, 2))) as amounts, list_sort(list_distinct(list(day(ts)))) as days from events group by user_id)"


def places(spark, sf) -> Searcher:
    c = t(spark, sf, "customer")
    lat, lon = (F.col("c_custkey") * 37) % 180 - 90, (F.col("c_custkey") * 73) % 360 - 180
    return Searcher(c.withColumn("place", F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))), CUST)


PLACES_SQL = "(select *, ((c_custkey * 37) % 180 - 90)::double as lat, ((c_custkey * 73) % 360 - 180)::double as lon from customer)"


def km(lat: float, lon: float) -> str:
    return f"(2 * 6371.0087714 * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians({lat})) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin(radians(lon - ({lon})) / 2), 2)))))"


def add(name: str, sql: str | None, run: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def searcher(table: str, config: IndexConfig):
    return lambda spark, sf: Searcher(t(spark, sf, table), config)


docs, orders, part, cust, emb, events = (searcher(a, b) for a, b in (("documents", DOCS), ("orders", ORDERS), ("part", PART), ("customer", CUST), ("embeddings", EMB), ("events", EVENTS)))


def hits(name: str, of, q: str, table: str, key: str, where: str, **options) -> None:
    """A text clause as a filter: the ids that match."""
    add(name, f"select {key} from {table} where {where}", lambda spark, sf: of(spark, sf).hits(Search((Clause("FILTER", q, **options),)), scored=False).select(key))


# flagship: a term filter with a facet over its hits
add("flagship_term_facet", f"select lang as label, count(*) as \"count\" from documents where list_contains({T_TEXT}, 'de') group by lang", lambda s, d: docs(s, d).count_facet(Search((Clause("FILTER", "text:de"),)), "lang"))

# predicates over numbers, dates, booleans, lengths
L_TABLE = "(select *, l_orderkey * 10 + l_linenumber as lid from lineitem)"
hits("p_range", lines, "l_quantity:[10 TO 20} AND l_discount:{0.02 TO 0.05]", L_TABLE, "lid", "l_quantity >= 10 and l_quantity < 20 and l_discount > 0.02 and l_discount <= 0.05")
hits("p_cmp", lines, "l_quantity>=45 l_extendedprice<1000", L_TABLE, "lid", "l_quantity >= 45 or l_extendedprice < 1000")
hits("p_num_range_rules", part, "p_size:[1a TO 10] OR p_size:[1.5 TO 9] OR p_retailprice:[9,50 TO 9,60]", "part", "p_partkey", "p_retailprice between 950 and 960")
hits("p_numeric_term", part, "p_size:(7 OR 9) OR p_size:(5 -3)", "part", "p_partkey", "p_size in (5, 7, 9)")
hits("p_date_range", orders, "o_orderdate:[1996-02 TO 1997}", "orders", "o_orderkey", "o_orderdate >= '1996-02-01' and o_orderdate < '1997-01-01'")
hits("p_date_term", orders, "o_orderdate:1996/3", "orders", "o_orderkey", "o_orderdate >= '1996-03-01' and o_orderdate < '1996-04-01'")
hits("p_zl_ns", part, "p_size:zl:ns(1 5 12)", "part", "p_partkey", "p_size in (1, 5, 12)")
hits("p_zl_tq", part, 'p_name:zl:tq("red" blue)', "part", "p_partkey", f"list_has_any({T_NAME}, ['red', 'blue'])")
hits("p_exists", orders, "o_orderpriority:* -o_orderstatus:zzz", "orders", "o_orderkey", "o_orderpriority is not null")
hits("p_nonempty", docs, "lang:*?", "documents", "doc_id", "length(lang) >= 1")
hits("p_match_all", part, "*:*", "part", "p_partkey", "true")
hits("p_unknown_field", part, "madeUp:solr OR p_size:3", "part", "p_partkey", "p_size = 3")
hits("p_char_len", part, "|p_brand|:[1 TO 7]", "part", "p_partkey", "length(p_brand) between 1 and 7")
hits("p_list_len", users, "|||kinds|||:3 OR |||amounts|||>25", USERS_SQL, "user_id", "len(kinds) = 3 or len(amounts) > 25")
hits("p_multi_range", users, "amounts:[50 TO 60] AND days:[1 TO 3]", USERS_SQL, "user_id", "len(list_filter(amounts, lambda x: x between 50 and 60)) > 0 and len(list_filter(days, lambda x: x between 1 and 3)) > 0")
add("p_bool", "select o_orderkey from orders where o_orderstatus = 'F'", lambda s, d: Searcher(t(s, d, "orders").withColumn("done", F.col("o_orderstatus") == "F"), IndexConfig("o", "o_orderkey", (FC("done", "BOOL"),))).hits(Search((Clause("FILTER", "done:Yes"),)), scored=False).select("o_orderkey"))

# predicates over text
hits("p_term", docs, "text:de", "documents", "doc_id", f"list_contains({T_TEXT}, 'de')")
hits("p_bool_ops", docs, "(text:de AND NOT text:la) OR (+text:the -text:and)", "documents", "doc_id", f"(list_contains({T_TEXT}, 'de') and not list_contains({T_TEXT}, 'la')) or (list_contains({T_TEXT}, 'the') and not list_contains({T_TEXT}, 'and'))")
hits("p_phrase", docs, '"of the"', "documents", "doc_id", f"contains(' ' || array_to_string({T_TEXT}, ' ') || ' ', ' of the ')")
hits("p_prefix", part, "p_name:gr* OR p_name:BL*", "part", "p_partkey", f"len(list_filter({T_NAME}, lambda x: starts_with(x, 'gr') or starts_with(x, 'bl'))) > 0")
hits("p_wildcard", part, "p_name:*i?g*", "part", "p_partkey", f"len(list_filter({T_NAME}, lambda x: regexp_full_match(x, '.*i.g.*'))) > 0")
hits("p_regex", part, "p_name:/.*(ed|ue)/", "part", "p_partkey", f"len(list_filter({T_NAME}, lambda x: regexp_full_match(x, '.*(ed|ue)'))) > 0")
hits("p_fuzzy", part, "p_name:rad~1", "part", "p_partkey", f"len(list_filter({T_NAME}, lambda x: levenshtein(x, 'rad') <= 1)) > 0")
hits("p_mm", docs, "text:(de la the and of)@3", "documents", "doc_id", " + ".join(f"list_contains({T_TEXT}, '{w}')::int" for w in ("de", "la", "the", "and", "of")) + " >= 3")
hits("q_mm", docs, "de la the and of", "documents", "doc_id", " + ".join(f"list_contains({T_TEXT}, '{w}')::int" for w in ("de", "la", "the", "and", "of")) + " >= 4", mm=4)
hits("q_default_op", docs, "the of", "documents", "doc_id", f"list_contains({T_TEXT}, 'the') and list_contains({T_TEXT}, 'of')", default_and=True)
hits("p_field_glob", part, "p_*ame,p_brand:red", "part", "p_partkey", f"list_contains({T_NAME}, 'red') or lower(p_brand) = 'red'")
hits("p_field_alias", docs, "anywhere:de", "documents", "doc_id", f"list_contains({T_TEXT}, 'de') or lang = 'de'")
hits("q_pure_negative", docs, "-lang:en", "documents", "doc_id", "lang is distinct from 'en'")
hits("q_empty_text", docs, "", "documents", "doc_id", "true")
hits("a_query_side", part, 'p_type:"SMALL"', "part", "p_partkey", f"list_contains({TOK.format('p_type')}, 'small')")
hits("q_range_builder", lines, range_text("l_quantity", 5, 9, "INCLUDE_MIN"), L_TABLE, "lid", "l_quantity >= 5 and l_quantity < 9")
hits("q_values_builder", part, values_text(("p_name",), ["red", "blue", "green"], 1), "part", "p_partkey", f"list_has_any({T_NAME}, ['red', 'blue', 'green'])")
hits("iv_ordered", docs, "fn:ordered(of the)", "documents", "doc_id", f"list_contains({T_TEXT}, 'the') and list_position({T_TEXT}, 'of') > 0 and list_position({T_TEXT}, 'of') < len({T_TEXT}) + 1 - list_position(list_reverse({T_TEXT}), 'the')")
def where_of(*words: str) -> str:
    """Positions of some words in the list t, in SQL."""
    return f"list_filter(range(1, len(t) + 1), lambda i: t[i] in ({', '.join(repr(w) for w in words)}))"


def next_pairs(a: str, b: str) -> str:
    """Shortest stretches from a position in list a to a later one in list b, in SQL: [first, last, the b before]."""
    return f"list_filter(list_transform({b}, lambda j: [list_max(list_filter({a}, lambda i: i < j)), j, coalesce(list_max(list_filter({b}, lambda k: k < j)), 0)]), lambda z: z[1] > z[3])"


def near(low: int, high: int, a: str = "p_of", b: str = "p_the") -> str:
    return f"len(list_filter({a}, lambda i: len(list_filter({b}, lambda j: j - i between {low} and {high})) > 0)) > 0"


WITH_POSITIONS = f"(select doc_id, t, {where_of('of')} as p_of, {where_of('the')} as p_the, {where_of('and')} as p_and from (select doc_id, {T_TEXT} as t from documents))"
OF_THE, THE_AND, THE_OF = next_pairs("p_of", "p_the"), next_pairs("p_the", "p_and"), next_pairs("p_the", "p_of")
HOLDS = "len(list_filter(p_and, lambda k: k > z[1] and k < z[2])) {}"
for name, q, where in (
    ("iv_maxgaps", "fn:maxgaps(2 fn:unordered(of and))", near(-3, 3, "p_of", "p_and")),
    ("iv_within", "fn:within(of 3 the)", near(-3, 3)),
    ("iv_not_within", "fn:notWithin(of 2 the)", "len(list_filter(p_of, lambda i: len(list_filter(p_the, lambda j: abs(j - i) <= 2)) = 0)) > 0"),
    ("iv_extend", "fn:containing(fn:extend(of 2 2) the)", near(-2, 2)),
    ("iv_atleast", "fn:maxwidth(6 fn:atLeast(2 of the and))", f"{near(-5, 5)} or {near(-5, 5, 'p_of', 'p_and')} or {near(-5, 5, 'p_the', 'p_and')}"),
    ("iv_maxwidth", "fn:maxwidth(3 fn:ordered(of the))", near(1, 2)),
    ("iv_containing", "fn:containing(fn:ordered(the of) and)", f"len(list_filter({THE_OF}, lambda z: {HOLDS.format('> 0')})) > 0"),
    ("iv_not_containing", "fn:notContaining(fn:ordered(of the) and)", f"len(list_filter({OF_THE}, lambda z: {HOLDS.format('= 0')})) > 0"),
    ("iv_contained_by", "fn:containedBy(and fn:ordered(the of))", f"len(list_filter({THE_OF}, lambda z: {HOLDS.format('> 0')})) > 0"),
    ("iv_not_contained_by", "fn:notContainedBy(and fn:ordered(the of))", f"len(list_filter(p_and, lambda k: len(list_filter({THE_OF}, lambda z: k > z[1] and k < z[2])) = 0)) > 0"),
    ("iv_before", "fn:before(of the)", "list_min(p_of) < list_max(p_the)"),
    ("iv_after", "fn:after(of the)", "list_max(p_of) > list_min(p_the)"),
    ("iv_overlapping", "fn:overlapping(fn:ordered(of the) fn:ordered(the and))", f"len(list_filter({OF_THE}, lambda z: len(list_filter({THE_AND}, lambda y: y[1] <= z[2] and z[1] <= y[2])) > 0)) > 0"),
    ("iv_nonoverlapping", "fn:nonOverlapping(fn:ordered(of the) fn:ordered(the and))", f"len(list_filter({OF_THE}, lambda z: len(list_filter({THE_AND}, lambda y: y[1] <= z[2] and z[1] <= y[2])) = 0)) > 0"),
    ("iv_or", "fn:ordered(fn:or(de la) fn:or(en el))", f"list_min({where_of('de', 'la')}) < list_max({where_of('en', 'el')})"),
    ("iv_phrase", "fn:phrase(of the)", near(1, 1)),
    ("iv_unordered", "fn:unordered(of the)", "len(p_of) > 0 and len(p_the) > 0"),
    ("iv_unordered_no", "fn:unorderedNoOverlaps(of the)", "len(p_of) > 0 and len(p_the) > 0"),
    ("iv_text", 'fn:containing("of the" the)', near(1, 1)),
    ("iv_wildcard", "fn:ordered(of fn:wildcard(th*))", "list_min(p_of) < list_max(list_filter(range(1, len(t) + 1), lambda i: starts_with(t[i], 'th')))"),
    ("iv_fuzzyterm", "fn:maxgaps(0 fn:ordered(of fn:fuzzyTerm(tha 1)))", "len(list_filter(p_of, lambda i: i < len(t) and damerau_levenshtein(t[i + 1], 'tha') <= 1)) > 0"),
    ("p_slop", '"of the"~2', near(-1, 3)),
):
    hits(name, docs, q, WITH_POSITIONS, "doc_id", where)
hits("p_zl_geo", places, "zl:geo(place 40.7 -74.0 3000)", PLACES_SQL, "c_custkey", f"{km(40.7, -74.0)} <= 3000")
hits("p_zl_bbox", places, "zl:geoBbox(place -10 40 170 -170)", PLACES_SQL, "c_custkey", "lat between -10 and 40 and (lon >= 170 or lon <= -170)")

# clause algebra
DE, THE = f"list_contains({T_TEXT}, 'de')", f"list_contains({T_TEXT}, 'the')"
add("q_filter", f"select doc_id from documents where {DE} and lang = 'fr'", lambda s, d: docs(s, d).hits(Search((Clause("FILTER", "text:de"), Clause("FILTER", "lang:fr")))).select("doc_id"))
add("q_filter_not", f"select doc_id from documents where {THE} and lang <> 'en'", lambda s, d: docs(s, d).hits(Search((Clause("FILTER", "text:the"), Clause("FILTER_NOT", "lang:en")))).select("doc_id"))
add("q_terms", "select c_custkey from customer where lower(c_mktsegment) in ('building', 'machinery')", lambda s, d: cust(s, d).hits(Search((Clause("TERMS", fields=("c_mktsegment",), values=("building", "machinery")),)), scored=False).select("c_custkey"))
add("q_terms_not", "select c_custkey from customer where lower(c_mktsegment) not in ('building', 'machinery')", lambda s, d: cust(s, d).hits(Search((Clause("TERMS_NOT", fields=("c_mktsegment",), values=("building", "machinery")),))).select("c_custkey"))
add("q_numset", "select p_partkey from part where p_size in (3, 4, 49)", lambda s, d: part(s, d).hits(Search((Clause("NUMERIC_SET", fields=("p_size",), values=(3, 4, 49)),)), scored=False).select("p_partkey"))
add("q_numset_not", "select p_partkey from part where p_size not in (3, 4, 49)", lambda s, d: part(s, d).hits(Search((Clause("NUMERIC_SET_NOT", fields=("p_size",), values=(3, 4, 49)),))).select("p_partkey"))
add("q_match_all", "select count(*) as total_hits from documents", lambda s, d: docs(s, d).total(Search()))
add("q_multi_index", "select 'customer' as index_name, c_custkey as id, c_acctbal as bal from customer where c_acctbal > 9000 union all select 'supplier', s_suppkey, s_acctbal from supplier where s_acctbal > 9000", lambda s, d: union_indexes({"customer": t(s, d, "customer").selectExpr("c_custkey as id", "c_acctbal as bal"), "supplier": t(s, d, "supplier").selectExpr("s_suppkey as id", "s_acctbal as bal")}, ["everyone", "supp*"], {"everyone": ["customer", "supplier"]}).where("bal > 9000"))

# scores
def scores(counts: str, value: str, where: str, columns: str = "lang") -> str:
    return f"with t as (select doc_id, {columns}, {T_TEXT} as t from documents), s as (select count(*) as n, avg(case when len(t) > 0 then len(t) end) as mean, {counts} from t) select doc_id, round({value}, 6) as score from t, s where {where}"


def bm(w: str) -> str:
    tf = f"len(list_filter(t, lambda x: x = '{w}'))"
    return f"(case when list_contains(t, '{w}') then ln(1 + (n - d_{w} + 0.5) / (d_{w} + 0.5)) * {tf} * 2.2 / ({tf} + 1.2 * (1 - 0.75 + 0.75 * len(t) / mean)) else 0 end)"


def dfs(*ws: str) -> str:
    return ", ".join(f"count(*) filter (list_contains(t, '{w}')) as d_{w}" for w in ws)


def scored(name: str, clauses: tuple[Clause, ...], sql: str | None, **options) -> None:
    add(name, sql, lambda s, d: docs(s, d).hits(Search(clauses, **options), scored=True).select("doc_id", F.round("score", 6).alias("score")))


scored("sc_bm25", (Clause("SCORE_MUST", "text:(de la)"),), scores(dfs("de", "la"), f"{bm('de')} + {bm('la')}", "list_contains(t, 'de') or list_contains(t, 'la')"))
scored("q_score_must", (Clause("SCORE_MUST", "text:de"), Clause("FILTER", "lang:fr")), scores(dfs("de"), bm("de"), "list_contains(t, 'de') and lang = 'fr'"))
scored("q_score_should", (Clause("FILTER", "lang:en"), Clause("SCORE_SHOULD", "text:the")), scores(dfs("the"), bm("the"), "lang = 'en'"))
scored("q_boost", (Clause("SCORE_MUST", "text:de", boost=2.5), Clause("SCORE_SHOULD", "text:la^3")), scores(dfs("de", "la"), f"2.5 * {bm('de')} + 3 * {bm('la')}", "list_contains(t, 'de')"))
scored("q_score_fn", (Clause("SCORE_MUST", "text:de", score_function="score * ln(1 + n_chars) / max(2, sqrt(n_chars)) + (n_chars > 1000 ? 1 : 0)"),), scores(dfs("de"), f"{bm('de')} * ln(1 + n_chars) / greatest(2, sqrt(n_chars)) + (case when n_chars > 1000 then 1 else 0 end)", "list_contains(t, 'de')", "lang, n_chars"))
TF = "len(list_filter(t, lambda x: x = 'de'))"
scored("sc_tfidf", (Clause("SCORE_MUST", "text:de"),), scores(dfs("de"), f"sqrt({TF}) * pow(1 + ln((n + 1) / (d_de + 1)), 2) / sqrt(len(t))", "list_contains(t, 'de')"), similarity=(("text", "tfidf"),))
scored("sc_tf", (Clause("SCORE_MUST", "text:de"),), scores(dfs("de"), f"{TF}::double", "list_contains(t, 'de')"), similarity=(("text", "tf"),))
scored("sc_constant", (Clause("SCORE_MUST", "text:de"),), scores(dfs("de"), "1.0::double", "list_contains(t, 'de')"), similarity=(("text", "constant"),))
scored("sc_const_multi", (Clause("SCORE_MUST", "text:th*^2"),), scores(dfs("de"), "2.0::double", "len(list_filter(t, lambda x: starts_with(x, 'th'))) > 0"))
add("sc_order", scores(dfs("de"), bm("de"), "list_contains(t, 'de')") + " order by score desc, doc_id limit 20", lambda s, d: docs(s, d).top(Search((Clause("SCORE_MUST", "text:de"),), amount=20, sorts=(Sort("score", True),))).select("doc_id", F.round("score", 6).alias("score")))
add("sc_field_boost", scores(dfs("de"), f"{bm('de')} * 2 + 0", "list_contains(t, 'de') or lang = 'de'").replace("+ 0,", "+ (case when lang = 'de' then ln(1 + (n - (select count(*) from documents where lang = 'de') + 0.5) / ((select count(*) from documents where lang = 'de') + 0.5)) * 2.2 / (1 + 1.2) else 0 end),"), lambda s, d: docs(s, d).hits(Search((Clause("SCORE_MUST", "de", fields=("text^2", "lang")),)), scored=True).select("doc_id", F.round("score", 6).alias("score")))

# sorts and paging


def page(name: str, of, sql: str, sorts: tuple[Sort, ...], columns: tuple[str, ...], **options) -> None:
    add(name, sql, lambda s, d: of(s, d).top(Search(sorts=sorts, fields=columns, **options)).select(*columns))


page("sort_field", orders, "select o_orderkey, o_totalprice from orders order by o_orderpriority collate nocase, o_totalprice desc, o_orderkey limit 50", (Sort("o_orderpriority"), Sort("o_totalprice", True)), ("o_orderkey", "o_totalprice"), amount=50)
page("sort_missing", cust, "select c_custkey from customer order by c_acctbal desc nulls first, c_custkey limit 30", (Sort("c_acctbal", True, True),), ("c_custkey",), amount=30)
page("sort_id", orders, "select o_orderkey from orders order by o_orderkey desc limit 25", (Sort("o_orderkey", True),), ("o_orderkey",), amount=25)
page("sort_len", users, f"select user_id from {USERS_SQL} order by len(amounts) desc, user_id limit 20", (Sort("|||amounts|||", True),), ("user_id",), amount=20)
page("sort_text_len", part, "select p_partkey from part order by length(p_name), p_partkey limit 20", (Sort("|p_name|"),), ("p_partkey",), amount=20)
page("sort_multi", users, f"select user_id from {USERS_SQL} order by list_min(amounts), user_id limit 20", (Sort("amounts"),), ("user_id",), amount=20)
page("sort_multi_desc", users, f"select user_id from {USERS_SQL} order by list_max(amounts) desc, user_id limit 20", (Sort("amounts", True),), ("user_id",), amount=20)
page("sort_text", part, "select p_partkey, p_name from part order by lower(p_name) desc, p_partkey limit 40", (Sort("p_name", True),), ("p_partkey", "p_name"), amount=40)
page("sort_geo", places, f"select c_custkey from {PLACES_SQL} order by round({km(48.85, 2.35)}, 6), c_custkey limit 15", (Sort("geodist(place,48.85,2.35)"),), ("c_custkey",), amount=15)
page("offset", orders, "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 100", (Sort("o_totalprice", True),), ("o_orderkey", "o_totalprice"), amount=20, start=100)
page("topk", lines, f"select lid, l_extendedprice from {L_TABLE} order by l_extendedprice desc, lid limit 100", (Sort("l_extendedprice", True),), ("lid", "l_extendedprice"), amount=100)
page("cursor", orders, "select o_orderkey from orders where o_totalprice < 100000 or (o_totalprice = 100000 and o_orderkey > 5) order by o_totalprice desc, o_orderkey limit 20", (Sort("o_totalprice", True),), ("o_orderkey",), amount=20, after=(100000.0, 5))
add("sort_values", "select o_orderkey, o_totalprice, o_orderpriority from orders order by o_totalprice, o_orderkey limit 10", lambda s, d: orders(s, d).top(Search(sorts=(Sort("o_totalprice"),), amount=10)).select("o_orderkey", "o_totalprice", "o_orderpriority"))
add("sort_score", scores(dfs("de"), bm("de"), "list_contains(t, 'de')") + " order by score, doc_id limit 20", lambda s, d: docs(s, d).top(Search((Clause("SCORE_MUST", "text:de"),), amount=20, sorts=(Sort("score"),))).select("doc_id", F.round("score", 6).alias("score")))

# facets
add("f_count", "select o_orderpriority as label, count(*) as \"count\" from orders where o_totalprice > 150000 group by 1 order by 2 desc, 1 limit 3", lambda s, d: orders(s, d).count_facet(Search((Clause("FILTER", "o_totalprice>150000"),)), "o_orderpriority", top=3))
add("f_count_multi", f"select k as label, count(*) as \"count\" from (select unnest(kinds) as k from {USERS_SQL}) group by 1", lambda s, d: users(s, d).count_facet(Search(), "kinds", top=-1))
add("f_count_numeric", "select p_size::varchar as label, count(*) as \"count\" from part group by 1 order by 2 desc, 1 limit 10", lambda s, d: part(s, d).count_facet(Search(), "p_size"))
add("f_date", "select strftime(l_shipdate, '%Y-%m-%d') as label, count(*) as \"count\" from lineitem group by 1 order by 2 desc, 1 limit 10", lambda s, d: lines(s, d).count_facet(Search(), "l_shipdate"))
add("f_hier", "select month(o_orderdate)::varchar as label, count(*) as \"count\" from orders where year(o_orderdate) = 1995 group by 1", lambda s, d: orders(s, d).count_facet(Search(), "o_orderdate", ("1995",), -1))
add("f_hier_root", "select year(o_orderdate)::varchar as label, count(*) as \"count\" from orders group by 1", lambda s, d: orders(s, d).count_facet(Search(), "o_orderdate", (), -1))
add("f_hier_path", "select n_name as label, count(*) as \"count\" from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' group by 1", lambda s, d: Searcher(t(s, d, "customer").join(F.broadcast(t(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("where", F.concat_ws("/", "r_name", "n_name")), IndexConfig("c", "c_custkey", (FC("where", facet="HIERARCHICAL"),))).count_facet(Search(), "where", ("ASIA",), -1))
add("f_drill", "select count(*) as total_hits from orders where year(o_orderdate) = 1996 and month(o_orderdate) in (2, 3) and o_orderstatus <> 'O'", lambda s, d: orders(s, d).total(Search(drill_downs=(DrillDown("o_orderdate", (("1996", "2"), ("1996", "3"))), DrillDown("o_orderstatus", ("O",), exclude=True)))))
add("f_drill_mm", f"select user_id from {USERS_SQL} where (list_contains(days, 1)::int + list_contains(days, 2)::int + list_contains(days, 3)::int) >= 2", lambda s, d: users(s, d).hits(Search(drill_downs=(DrillDown("days", ("1", "2", "3"), mm=2),))).select("user_id"))
add("f_many", "select 'l_returnflag' as dimension, l_returnflag as label, count(*) as \"count\" from lineitem where l_quantity < 25 group by all union all select 'l_linestatus', l_linestatus, count(*) from lineitem where l_quantity < 25 group by all union all select 'l_linenumber', l_linenumber::varchar, count(*) from lineitem where l_quantity < 25 group by all", lambda s, d: lines(s, d).counts(Search((Clause("FILTER", "l_quantity<25"),)), ["l_returnflag", "l_linestatus", "l_linenumber"]))
add("f_empty", "select lang as label, count(*) as \"count\" from documents where false group by 1", lambda s, d: docs(s, d).count_facet(Search((Clause("FILTER", "text:zzzznothing"),)), "lang"))

add("f_maxhits", "select o_orderstatus as label, count(*) as \"count\" from orders where (select count(*) from orders) <= 100 group by 1", lambda s, d: orders(s, d).count_facet(Search(), "o_orderstatus", max_hits=100))
add("f_dup_merge", "select o_orderpriority as label, count(*) as \"count\" from orders group by 1 order by 2 desc, 1 limit 4", lambda s, d: orders(s, d).run(Search(), facets=(CountFacet("o_orderpriority", top=2), CountFacet("o_orderpriority", top=4))).facets["o_orderpriority", ()])
add("f_error", "select o_orderpriority as label, count(*) as \"count\", 0::bigint as max_error, false as possible_missing from orders group by 1", lambda s, d: orders(s, d).count_facet(Search(), "o_orderpriority", top=-1).withColumns({"max_error": F.lit(0).cast("long"), "possible_missing": F.lit(False)}))
add("f_order", "select p_brand as label, count(*) as \"count\" from part where p_size < 10 group by 1 order by 2 desc, 1 limit 5", lambda s, d: part(s, d).count_facet(Search((Clause("FILTER", "p_size<10"),)), "p_brand", top=5))

# statistics
STATS = "min({0}) as min, max({0}) as max, round(sum({0}), 2) as sum, count({0}) as doc_count, count(*) as all_doc_count, count({0}) as value_count"


def stats(df: DataFrame) -> DataFrame:
    return df.withColumn("sum", F.round("sum", 2))


add("st_global", f"select {STATS.format('l_extendedprice')} from lineitem where l_shipdate >= '1995-01-01'", lambda s, d: stats(lines(s, d).stat(Search((Clause("FILTER", "l_shipdate>=1995"),)), "l_extendedprice")))
add("st_facet", f"select l_returnflag as label, {STATS.format('l_quantity')} from lineitem group by 1", lambda s, d: stats(lines(s, d).stat(Search(), "l_quantity", "l_returnflag")))
add("st_multi", f"select list_min(list(list_min(a))) as min, list_max(list(list_max(a))) as max, round(sum(list_sum(a)), 2) as sum, count(*) as doc_count, count(*) as all_doc_count, sum(len(a))::bigint as value_count from (select list_distinct(amounts) as a from {USERS_SQL})", lambda s, d: stats(users(s, d).stat(Search(), "amounts")))
add("st_hier", f"select month(o_orderdate)::varchar as label, {STATS.format('o_totalprice')} from orders where year(o_orderdate) = 1996 group by 1", lambda s, d: stats(orders(s, d).stat(Search(), "o_totalprice", "o_orderdate", ("1996",), -1)))
add("st_types", "select min(p_size)::double as min, max(p_size)::double as max, sum(p_size)::double as sum, count(p_size) as doc_count, count(*) as all_doc_count, count(p_size) as value_count from part", lambda s, d: part(s, d).stat(Search(), "p_size").withColumns({c: F.col(c).cast("double") for c in ("min", "max", "sum")}))
add("st_pct", "with r as (select l_returnflag as label, l_quantity as x, row_number() over (partition by l_returnflag order by l_quantity) - 1 as k, count(*) over (partition by l_returnflag) as n from lineitem) select label, max(x) filter (k = 0) as q0, max(x) filter (k = floor(0.25::double * (n - 1))) as q1, max(x) filter (k = floor(0.5::double * (n - 1))) as q2, max(x) filter (k = floor(0.95::double * (n - 1))) as q3 from r group by 1", lambda s, d: FA.exact_quantiles(t(s, d, "lineitem").withColumnRenamed("l_returnflag", "label"), "l_quantity", (0.0, 0.25, 0.5, 0.95), ["label"]))
G = 1.001 / 0.999
SK = f"with r as (select o_orderpriority as label, o_totalprice as x, row_number() over (partition by o_orderpriority order by o_totalprice) - 1 as k, count(*) over (partition by o_orderpriority) as n from orders) select label, round(2 * pow({G!r}, ceil(ln(max(x) filter (k = floor(0.5::double * (n - 1)))) / ln({G!r}))) / ({G!r} + 1), 3) as q0, round(2 * pow({G!r}, ceil(ln(max(x) filter (k = floor(0.99::double * (n - 1)))) / ln({G!r}))) / ({G!r} + 1), 3) as q1 from r group by 1"
add("st_pct_sketch", SK, lambda s, d: FA.quantiles(t(s, d, "orders").withColumnRenamed("o_orderpriority", "label"), "o_totalprice", (0.5, 0.99), 0.001, ["label"]).select("label", F.round("q0", 3).alias("q0"), F.round("q1", 3).alias("q1")))
add("st_empty", "select lang as label, null::double as min, null::double as max, null::double as sum, 0::bigint as doc_count, count(*) as all_doc_count, 0::bigint as value_count from documents group by 1", lambda s, d: Searcher(t(s, d, "documents").withColumn("none", F.lit(None).cast("double")), IndexConfig("d", "doc_id", (FC("lang", facet="FLAT"), FC("none", "DOUBLE", sort="STANDARD")))).stat(Search(), "none", "lang"))
add("st_err", f"select l_linestatus as label, {STATS.format('l_discount')}, 0.0::double as max_sum_error from lineitem group by 1", lambda s, d: stats(lines(s, d).stat(Search(), "l_discount", "l_linestatus")).withColumn("max_sum_error", F.lit(0.0)))
add("agg_count", "select count(*) as total_hits from lineitem", lambda s, d: lines(s, d).total(Search()))
add("st_events", "select count(*) as n, round(sum(value), 2) as total, event_type, epoch(time_bucket(interval '1 hour', ts))::bigint as hour from events group by event_type, hour", lambda s, d: windowed_facets(t(s, d, "events"), "ts", "event_type", "value").select("event_type", "n", F.round("total", 2).alias("total"), F.unix_seconds(F.col("window_start").cast("timestamp")).alias("hour")))

# vectors
QUERY = [((i * 37) % 19 - 9) / 10 for i in range(64)]
QSQL = "[" + ", ".join(f"{x}::double" for x in QUERY) + "]"
E_ = "embedding::double[]"
add("v_knn", f"select vec_id, round(list_cosine_similarity({E_}, {QSQL}), 6) as similarity from embeddings order by list_cosine_similarity({E_}, {QSQL}) desc, vec_id limit 50", lambda s, d: V.nearest(t(s, d, "embeddings"), "embedding", QUERY, 50, "COSINE", "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity")))
add("v_sim_dot", f"select vec_id, round(list_dot_product({E_}, {QSQL}), 6) as similarity from embeddings order by list_dot_product({E_}, {QSQL}) desc, vec_id limit 50", lambda s, d: V.nearest(t(s, d, "embeddings"), "embedding", QUERY, 50, "DOT_PRODUCT", "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity")))
add("v_sim_euclid", f"select vec_id, round(1 / (1 + pow(list_distance({E_}, {QSQL}), 2)), 6) as similarity from embeddings order by list_distance({E_}, {QSQL}), vec_id limit 50", lambda s, d: V.nearest(t(s, d, "embeddings"), "embedding", QUERY, 50, "EUCLIDEAN", "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity")))
add("v_sim_mip", ORACLES["v_sim_dot"], lambda s, d: V.nearest(t(s, d, "embeddings"), "embedding", QUERY, 50, "MAX_INNER_PRODUCT", "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity")))
add("v_prefilter", f"select vec_id from embeddings where label in (2, 3) order by list_cosine_similarity({E_}, {QSQL}) desc, vec_id limit 20", lambda s, d: emb(s, d).hits(Search((Clause("VECTOR", fields=("embedding",), values=tuple(QUERY), top_n=20, pre=("label:[2 TO 3]",)),))).select("vec_id"))
add("q_vector", f"select vec_id from (select * from embeddings order by list_cosine_similarity({E_}, {QSQL}) desc, vec_id limit 40) where label = 3", lambda s, d: emb(s, d).hits(Search((Clause("VECTOR", fields=("embedding",), values=tuple(QUERY), top_n=40), Clause("FILTER", "label:3")))).select("vec_id"))
REV = f"list_reverse({E_})"
add("v_fields", f"select vec_id from embeddings order by greatest(list_cosine_similarity({E_}, {QSQL}), list_cosine_similarity({REV}, {QSQL})) desc, vec_id limit 25", lambda s, d: Searcher(t(s, d, "embeddings").withColumn("back", F.reverse("embedding")), IndexConfig("e", "vec_id", (FC("embedding", "VECTOR", dimension=64), FC("back", "VECTOR", dimension=64)))).hits(Search((Clause("VECTOR", fields=("embedding", "back"), values=tuple(QUERY), top_n=25),))).select("vec_id"))
add("q_vector_should", f"select vec_id, round(coalesce(c, 0), 6) as score from embeddings left join (select vec_id as v, list_cosine_similarity({E_}, {QSQL}) as c from embeddings order by c desc, v limit 30) on v = vec_id where label = 1", lambda s, d: emb(s, d).hits(Search((Clause("FILTER", "label:1"), Clause("VECTOR_SHOULD", fields=("embedding",), values=tuple(QUERY), top_n=30))), scored=False).select("vec_id", F.round("score", 6).alias("score")))
add("total_hits_vector", "select least(count(*), 25)::bigint as total_hits from embeddings", lambda s, d: emb(s, d).total(Search((Clause("VECTOR", fields=("embedding",), values=tuple(QUERY), top_n=25),))))
add("v_oversample", f"select vec_id from embeddings order by list_cosine_similarity({E_}, {QSQL}) desc, vec_id limit 20", lambda s, d: V.nearest_oversampled(t(s, d, "embeddings"), "embedding", QUERY, 20, "INT8", 4.0, "COSINE", "vec_id").select("vec_id"))
SIGNS = "[" + ", ".join(f"{x}::double" for x in QUERY) + "]"
add("v_quant", f"select vec_id from (select vec_id, embedding from embeddings order by round(list_dot_product(list_transform({E_}, lambda x: sign(x)::double), {SIGNS}), 9) desc, vec_id limit 60) order by list_cosine_similarity({E_}, {QSQL}) desc, vec_id limit 20", lambda s, d: V.nearest_oversampled(t(s, d, "embeddings"), "embedding", QUERY, 20, "BBQ", 0.0, "COSINE", "vec_id").select("vec_id"))
CENT = "(select list(m order by i) as c from (select i, avg(embedding[i]::double) as m from embeddings, range(1, 65) r(i) where vec_id in (1, 2, 3) group by i))"
add("m_vec", f"select vec_id from embeddings, {CENT} where vec_id not in (1, 2, 3) order by list_cosine_similarity({E_}, c) desc, vec_id limit 30", lambda s, d: similar.near_vectors(t(s, d, "embeddings"), "embedding", "vec_id", [1, 2, 3], 30).select("vec_id"))

# similar documents, terms
def likeness(source: int, most: int, limit: str = "order by s desc, doc_id limit 50") -> str:
    """Documents like one document by its telling terms, in SQL."""
    return f"""with d as (select doc_id, {T_TEXT} as t from documents), n as (select count(*) as n, avg(case when len(t) > 0 then len(t) end) as mean from d),
p as (select doc_id, w, count(*) as tf from (select doc_id, unnest(t) as w from d) group by all), f as (select w, count(*) as df from p group by w),
pick as (select w, df from p join f using (w), n where doc_id = {source} and tf >= 2 and df between 5 and greatest(1, floor(n * 0.25)) order by -tf * (1 + ln((n + 1) / (df + 1))), w limit {most}),
found as (select doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))) as s from p join pick using (w) join d using (doc_id), n where doc_id <> {source} group by doc_id)
select doc_id, round(s, 6) as score from found {limit}"""


add("m_lex", likeness(3, 10), lambda s, d: similar.more_like(t(s, d, "documents"), DOCS, ("text",), [r[1] for r in similar.sources(t(s, d, "documents"), "doc_id", [3], ["text"])], exclude=[3], max_terms=10).select("doc_id", F.round("score", 6).alias("score")).limit(50))
like = lambda **how: (Clause("MORE_LIKE_THIS", like=similar.Like(text_fields=("text",), **how)),)
add("q_mlt", likeness(3, 8, ""), lambda s, d: docs(s, d).hits(Search(like(ids=(3,), options=(("max_terms", 8),)))).select("doc_id", F.round("score", 6).alias("score")))
add("m_resolve", likeness(3, 6, ""), lambda s, d: docs(s, d).hits(Search(like(ids=(3,), index=t(s, d, "documents"), options=(("max_terms", 6),)))).select("doc_id", F.round("score", 6).alias("score")).where("doc_id <> 3"))
add("m_exclude", f"select doc_id from ({likeness(3, 8, '')}) union all select 3", lambda s, d: docs(s, d).hits(Search(like(ids=(3,), include_sources=True, options=(("max_terms", 8),)))).select("doc_id"))
BOTH = IndexConfig("both", "doc_id", (*DOCS.fields, FC("embedding", "UNIT_VECTOR", dimension=64)), ("text",))
both = lambda s, d: Searcher(t(s, d, "documents").join(t(s, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id"), BOTH)
add("m_hybrid", None, lambda s, d: both(s, d).hits(Search((Clause("MORE_LIKE_THIS", like=similar.Like(ids=(3, 7), text_fields=("text",), vector_field="embedding", top_n=20, text_weight=0.5, vector_weight=2.0)),))).select("doc_id", F.round("score", 6).alias("score")))
TERM = f"(select doc_id, unnest({T_TEXT}) as term from documents)"
text_tokens = lambda s, d: analysis.tokens(F.col("text"), "standard")
add("t_terms", f"select term, count(distinct doc_id) as doc_freq, count(*) as term_freq from {TERM} where term >= 'a' and term < 'c' and regexp_full_match(term, '[a-z]+') group by term having count(distinct doc_id) >= 3 order by term limit 200", lambda s, d: terms.term_list(t(s, d, "documents"), text_tokens(s, d), "a", "c", "[a-z]+", None, 3, amount=200))
add("t_include", f"select term, count(distinct doc_id) as doc_freq, count(*) as term_freq from {TERM} where term in ('de', 'the', 'la') group by term", lambda s, d: terms.term_list(t(s, d, "documents"), text_tokens(s, d), only=["de", "the", "la"]))
add("t_fuzzy", f"select term, levenshtein(term, 'then') as distance from (select distinct term from {TERM} where regexp_full_match(term, '[a-z]+') and starts_with(term, 't')) where levenshtein(term, 'then') <= 1", lambda s, d: terms.fuzzy_terms(terms.term_list(t(s, d, "documents"), text_tokens(s, d), keep="[a-z]+"), "then", 1, 1).select("term", F.col("distance").cast("long").alias("distance")))
add("an_tokens", f"select doc_id, len({T_TEXT})::bigint as n, {T_TEXT}[1] as first from documents", lambda s, d: t(s, d, "documents").select("doc_id", text_tokens(s, d).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.get("t", 0).alias("first")))
DT = f"p as (select doc_id as id, term, count(*) as tf from {TERM} where regexp_full_match(term, '[a-z]+') group by all), f as (select term, count(*) as doc_freq from p group by term having count(*) >= 2)"
add("an_docterms", f"with {DT} select id, term, tf from p join f using (term) qualify row_number() over (partition by id order by tf desc, term) <= 5", lambda s, d: terms.document_terms(t(s, d, "documents"), "doc_id", text_tokens(s, d), 5, "TF", min_df=2, keep="[a-z]+").select("id", "term", "tf"))
add("an_docterms_tfidf", f"with {DT}, n as (select count(*) as n from documents) select id, term, round(tf * ln(1.0 + n.n::double / doc_freq), 6) as score from p join f using (term), n qualify row_number() over (partition by id order by tf * ln(1.0 + n.n::double / doc_freq) desc, term) <= 3", lambda s, d: terms.document_terms(t(s, d, "documents"), "doc_id", text_tokens(s, d), 3, min_df=2, keep="[a-z]+").select("id", "term", F.round("score", 6).alias("score")))
add("an_summary", f"with {DT} select term, sum(tf)::bigint as tf, count(*) as docs from p group by term order by 2 desc, term limit 30", lambda s, d: terms.summary_terms(t(s, d, "documents"), "doc_id", text_tokens(s, d), 30, keep="[a-z]+"))
add("h_highlight", "select p_partkey, regexp_replace(p_name, '(?i)\\b(red|blue)\\b', '<em>\\1</em>', 'g') as marked from part", lambda s, d: t(s, d, "part").select("p_partkey", terms.mark(F.col("p_name"), ["red", "blue"]).alias("marked")))
add("h_fragments", None, lambda s, d: t(s, d, "documents").select("doc_id", terms.fragments(F.col("text"), ["the", "of"]).alias("fragments")))

add("h_terms", "select doc_id, contains(lower(text), 'the') as marked from documents where list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), 'the')", lambda s, d: docs(s, d).hits(Search((Clause("FILTER", "text:the"),)), scored=False).select("doc_id", terms.mark(F.col("text"), ["the"]).contains("<em>").alias("marked")))
add("an_override", "select doc_id, len(regexp_extract_all(text, '\\S+'))::bigint as n from documents", lambda s, d: t(s, d, "documents").select("doc_id", F.size(analysis.tokens(F.col("text"), "whitespace")).cast("long").alias("n")))
add("t_last", f"select term, count(distinct doc_id) as doc_freq from {TERM} where term > 'cb' and regexp_full_match(term, '[a-z]+') group by term order by term limit 50", lambda s, d: terms.term_list(t(s, d, "documents"), text_tokens(s, d), terms.behind("cb"), keep="[a-z]+", amount=50).select("term", "doc_freq"))

# analysis
for n in (2, 3, 4, 5):
    add(f"a_shingle{n}", f"select doc_id, len(s)::bigint as n, s[1] as first, s[-1] as last from (select doc_id, list_transform(range(1, len(t) - {n - 2}), lambda i: array_to_string(t[i:i + {n - 1}], ' ')) as s from (select doc_id, {T_TEXT} as t from documents))", lambda s, d, n=n: terms.held(t(s, d, "documents"), "doc_id", t=text_tokens(s, d)).select("doc_id", analysis.FILTERS[f"shingle{n}"][0](F.col("t")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.get("s", 0).alias("first"), F.try_element_at("s", F.lit(-1)).alias("last")))


def analyzer(name: str, sql: str | None, column: str = "p_name", table: str = "part", key: str = "p_partkey", steps: str = "standard", more: str = "") -> None:
    """The tokens of a column, with `more` behind each text: words that the rule is about and the table lacks."""
    config = IndexConfig("x", key, (), analyzers={"x": tuple(steps.split("+"))}) if "+" in steps else None
    source = f"(select * replace (concat({column}, '{more.replace(chr(39), chr(39) * 2)}') as {column}) from {table})" if more else table
    text = lambda: F.concat(F.col(column), F.lit(more)) if more else F.col(column)
    add(name, f"select {key}, array_to_string({sql}, ' ') as tokens from {source}" if sql else None, lambda s, d: t(s, d, table).select(key, F.array_join(analysis.tokens(text(), "x" if config else steps, config), " ").alias("tokens")))


analyzer("a_tok_standard", T_NAME)
analyzer("a_tok_keyword", "[lower(p_type)]", "p_type", steps="lcKeyword")
analyzer("a_tok_whitespace", r"list_filter(regexp_split_to_array(p_type, '\s+'), lambda x: x <> '')", "p_type", steps="whitespace")
analyzer("a_upper", "list_transform(regexp_extract_all(p_name, '\\w+'), lambda x: upper(x))", steps="tok_standard+upper")
analyzer("a_html", r"regexp_extract_all(lower(regexp_replace(html, '<[^>]*>', '', 'g')), '[\p{L}\p{N}_]+')", "html", "pages", "page_id", "standardHtml")
analyzer("a_concat_all", r"[lower(regexp_replace(c_name, '[^\p{L}\p{N}]', '', 'g'))]", "c_name", "customer", "c_custkey", "lcConcatAll")
analyzer("a_possessive", "list_transform(regexp_extract_all(p_name, '\\S+'), lambda x: regexp_replace(x, '[''’][sS]$', ''))", steps="tok_whitespace+possessive", more="'s lion’s DOG'S s")
def chained(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"regexp_replace({x}, '{old}', '{new}', 'g')"
    return x


ASCII = "strip_accents(replace(replace(replace(x, 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'))"
WORDS, LOW = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')", T_TEXT
US = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in analysis.BRITISH.items()) + "}"
MIN = "case when length(x) > 3 and ends_with(x, 's') then case when regexp_matches(x, '[^ae]ies$') then left(x, -3) || 'y' when regexp_matches(x, '[aeo]es$') then x when regexp_matches(x, '[^us]s$') then left(x, -1) else x end else x end"
for name, steps, sql in (
    ("a_lower", "tok_standard+lower", LOW),
    ("a_stop", "tok_standard+lower+stop", f"list_filter({LOW}, lambda x: x not in ({', '.join(repr(w) for w in analysis.STOP)}))"),
    ("a_minstem", "tok_standard+lower+min_stem", f"list_transform({LOW}, lambda x: {MIN})"),
    ("a_british_us", "tok_standard+lower+british_us", f"list_transform({LOW}, lambda x: coalesce({US}[x], x))"),
    ("a_german", "tok_standard+lower+german", f"list_transform({LOW}, lambda x: {chained('x', (('ä', 'a'), ('ö', 'o'), ('ü', 'u'), ('ae', 'a'), ('oe', 'o'), ('([^q]|^)ue', chr(92) + '1u'), ('([^q]|^)ue', chr(92) + '1u'), ('ß', 'ss')))})"),
    ("a_ascii", "tok_standard+lower+ascii", f"list_transform({LOW}, lambda x: {ASCII})"),
    ("a_case_protect", "tok_standard+case_protect+lower", f"list_transform({WORDS}, lambda x: case when x = 'AIDS' then x else lower(x) end)"),
    ("a_named", "threeThreeShingle", f"list_transform(range(1, len({LOW}) - 1), lambda i: {ASCII.replace('(x,', f"(array_to_string({LOW}[i:i + 2], ' '),")})"),
    ("a_kstem", "kstem", None),
    ("a_snowball", "tok_standard+lower+snowball", None),
):
    analyzer(name, sql, "text", "benchmark", "item_id", steps, " Colour of grey theatres AIDS aids l'été Straße")
add("a_gap", "select 1 as n, false as \"match\"", lambda s, d: Searcher(s.createDataFrame([(1, ["one two", "three four"])], "id long, v array<string>"), IndexConfig("g", "id", (FC("v", "STRING", {"v": "standard"}),), ("v",))).hits(Search((Clause("FILTER", '"two three"'),)), scored=False).agg(F.lit(1).alias("n"), (F.count("*") > 0).alias("match")))
add("a_minhash", None, lambda s, d: t(s, d, "benchmark").select("item_id", analysis.minhash(analysis.FILTERS["shingle2"][0](analysis.tokens(F.col("text"), "standard")), 16).alias("signature")))
add("s_levenshtein", "select p_partkey, levenshtein(p_name, 'red blue') as n from part", lambda s, d: t(s, d, "part").select("p_partkey", F.levenshtein("p_name", F.lit("red blue")).cast("long").alias("n")))

# storing, fetching, projection
add("scan_index", "select count(*) as n, sum(o_totalprice)::decimal(20, 2)::varchar as total from orders", lambda s, d: t(s, d, "orders").agg(F.count("*").alias("n"), F.sum("o_totalprice").cast("decimal(20,2)").cast("string").alias("total")))
add("store_upsert", "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1", lambda s, d: store.latest(t(s, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", "event_type"), "user_id", "at").select("user_id", "event_id", "event_type"))
add("delete_by_id", "select o_orderkey from orders where o_orderkey not in (select distinct l_orderkey from lineitem where l_quantity > 49)", lambda s, d: store.delete(t(s, d, "orders"), t(s, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey"))
add("fetch_by_id", "select p_partkey, p_name from part where p_partkey = 7", lambda s, d: store.fetch(t(s, d, "part"), "p_partkey", 7, ("p_name",)))
add("batch_fetch", "select i as p_partkey, p_name, p_name is not null as found from (values (1), (5), (99999999)) v(i) left join part on p_partkey = i", lambda s, d: store.batch_fetch(t(s, d, "part"), s.createDataFrame([(1,), (5,), (99999999,)], "p_partkey long"), "p_partkey").select("p_partkey", "p_name", "found"))
add("project_fields", "select o_orderkey, o_orderstatus from orders", lambda s, d: project(t(s, d, "orders"), "o_orderkey", ("o_orderstatus",)))
add("mask_fields", "select r_regionkey from region", lambda s, d: project(t(s, d, "region"), "r_regionkey", (), ("r_name",)))
add("fetch_type", "select o_orderkey from orders", lambda s, d: project(t(s, d, "orders"), "o_orderkey", ("o_orderkey",)))
add("batch_delete", f"select lid from {L_TABLE} where lid not in (select lid from {L_TABLE} where l_returnflag = 'R')", lambda s, d: store.delete(lines(s, d).df, lines(s, d).hits(Search((Clause("FILTER", "l_returnflag:R"),)), scored=False), "lid").select("lid"))
add("sink_cells", "select p_partkey::varchar as p_partkey, printf('%.3f', p_retailprice) as p_retailprice, p_name from part", lambda s, d: as_text(t(s, d, "part").select("p_partkey", "p_retailprice", "p_name")))
add("src_typed_get", "select c_custkey, try_cast(regexp_extract(c_name, '[0-9]+') as bigint) as number, coalesce(try_cast(c_mktsegment as bigint), -1) as none from customer", lambda s, d: t(s, d, "customer").select("c_custkey", typed(F.regexp_extract("c_name", "[0-9]+", 0), "long").alias("number"), typed(F.col("c_mktsegment"), "long", -1).cast("long").alias("none")))
add("rest_csv", "select 'o_orderstatus' as facetName, o_orderstatus as facetKey, count(*) as facetValue from orders group by all", lambda s, d: orders(s, d).counts(Search(), ["o_orderstatus"]).toDF("facetName", "facetKey", "facetValue"))
add("project_nested", "select o_orderkey, o_totalprice as price from orders", lambda s, d: project(t(s, d, "orders").select("o_orderkey", F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")).alias("o")), "o_orderkey", ("o",), ("o.status",)).select("o_orderkey", "o.*"))
add("rest_truncate", "select doc_id, substr(text, 1, 40) as text from documents", lambda s, d: t(s, d, "documents").select("doc_id", F.substring("text", 1, 40).alias("text")))
add("i_fields", "select * from (values ('doc_id'), ('text'), ('lang'), ('source'), ('n_chars')) v(name)", lambda s, d: s.createDataFrame([(f.name,) for f in DOCS.fields], "name string"))
add("i_schema_tally", "select 'orders.' || k as path, n as docs from (select count(o_orderkey) as o_orderkey, count(o_totalprice) as o_totalprice from orders) unpivot (n for k in (o_orderkey, o_totalprice))", lambda s, d: store.schema_tally(t(s, d, "orders").select("o_orderkey", "o_totalprice")).select(F.concat(F.lit("orders."), "path").alias("path"), "docs"))
CODES = "list_transform(string_split(c_name, ''), lambda c: ascii(c)::hugeint)"
HASH = f"list_reduce(list_concat([5381::hugeint], {CODES}), lambda h, c: (h * 33 + c) % 18446744073709551616)"
add("shard_of", f"select abs(case when h >= 9223372036854775808 then h - 18446744073709551616 else h end) % 5 as shard, count(*) as n from (select {HASH} as h from customer) group by 1", lambda s, d: t(s, d, "customer").select("c_custkey", store.shard_of(F.col("c_name"), 5).alias("shard")).groupBy("shard").agg(F.count("*").alias("n")))


# files: written below the shared folder and read again
def written(write: Callable[[DataFrame, str], None], read: Callable[[SparkSession, str], DataFrame], ends: str, made: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = scratch(spark, "files") + ends
        write(made(spark, sf), path)
        return read(spark, path)

    return run


def plain_lines(df: DataFrame, path: str) -> None:
    df.coalesce(1).sortWithinPartitions("at").select("value").write.text(path)


AS_TEXT = "select {0}::varchar as {0}, {1} as {1}, printf('%.3f', {2}) as {2} from {3}"
add("src_csv", AS_TEXT.format("p_partkey", "p_name", "p_retailprice", "part"), written(write_csv, read_csv, "", lambda s, d: t(s, d, "part").select("p_partkey", "p_name", "p_retailprice")))
add("src_tsv", AS_TEXT.format("s_suppkey", "s_name", "s_acctbal", "supplier"), written(write_tsv, read_tsv, "", lambda s, d: t(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")))
add("src_csv_quotes", "select c_custkey::varchar as c_custkey, concat('say \"', c_name, '\", ', c_mktsegment) as said from customer", written(write_csv, read_csv, "", lambda s, d: t(s, d, "customer").select("c_custkey", F.concat(F.lit('say "'), "c_name", F.lit('", '), "c_mktsegment").alias("said"))))
add("src_header_map", "select n_nationkey::varchar as \"key\", n_name as column2, n_name as key_2 from nation", written(plain_lines, read_csv, "", lambda s, d: t(s, d, "nation").select(F.col("n_nationkey").alias("at"), F.concat_ws(",", "n_nationkey", "n_name", "n_name").alias("value")).union(s.createDataFrame([(-1, "key,,key")], "at long, value string"))))
add("src_jsonl", "select o_orderkey, o_totalprice, o_orderstatus from orders", written(write_json_lines, lambda s, p: read_json_lines(s, p, schema="o_orderkey long, o_totalprice double, o_orderstatus string"), "", lambda s, d: t(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")))
add("src_jsonl_bad", "select c_custkey, c_name from customer where c_custkey % 10 <> 0", written(lambda df, p: df.write.text(p), lambda s, p: read_json_lines(s, p, skip_bad=True, schema="c_custkey long, c_name string"), "", lambda s, d: t(s, d, "customer").select(F.when(F.col("c_custkey") % 10 == 0, "{\"c_custkey\": oops").otherwise(F.to_json(F.struct("c_custkey", "c_name"))).alias("value"))))
add("src_json_array", "select r_regionkey, r_name from region", written(lambda df, p: df.write.text(p), read_json_array, "", lambda s, d: t(s, d, "region").agg(F.to_json(F.array_agg(F.struct("r_regionkey", "r_name"))).alias("value"))))
add("store_dump", "select n_nationkey, n_name, n_regionkey from nation", written(lambda df, p: store.dump(df, DOCS, p), lambda s, p: store.restore(s, p)[0].select("n_nationkey", "n_name", "n_regionkey"), "", lambda s, d: t(s, d, "nation")))
add("src_json_path", "select key, count(*) as docs from (select unnest(json_keys(props)) as key from events) group by 1", lambda s, d: store.json_tally(t(s, d, "events"), "props").groupBy("key").agg(F.sum("docs").alias("docs")))

# features
add("ml_featstat", "with r as (select i - 1 as feature, embedding[i]::double as x from embeddings, range(1, 65) t(i)), k as (select *, row_number() over (partition by feature order by x) - 1 as k, count(*) over (partition by feature) as n from r) select feature::int as feature, min(x) as min, max(x) as max, round(avg(x), 6) as avg, max(x) filter (k = floor(0.5::double * (n - 1))) as p50 from k group by feature", lambda s, d: ml.feature_stats(t(s, d, "embeddings"), "embedding", exact=True).select("feature", "min", "max", F.round("avg", 6).alias("avg"), "p50"))
add("ml_minmax", "with m as (select min(embedding[1]::double) as lo, max(embedding[1]::double) as hi from embeddings) select vec_id, round((embedding[1]::double - lo) / (hi - lo), 6) as x from embeddings, m", lambda s, d: t(s, d, "embeddings").select("vec_id", F.round(F.get(ml.min_max(F.col("embedding"), ml.feature_stats(t(s, d, "embeddings"), "embedding", exact=True)), 0), 6).alias("x")))
add("ml_pctclip", "with r as (select embedding[1]::double as x, row_number() over (order by embedding[1]) - 1 as k, count(*) over () as n from embeddings), m as (select avg(x) as a, max(x) filter (k = floor(0.75::double * (n - 1))) - max(x) filter (k = floor(0.25::double * (n - 1))) as w from r) select vec_id, round(greatest(-3, least(3, (embedding[1]::double - a) / w)), 6) as x from embeddings, m", lambda s, d: t(s, d, "embeddings").select("vec_id", F.round(F.get(ml.percentile_clip(F.col("embedding"), ml.feature_stats(t(s, d, "embeddings"), "embedding", exact=True)), 0), 6).alias("x")))
add("ml_metrics", "select count(*) filter (quality = 1 and toxic = 1) as tp, count(*) filter (quality = 0 and toxic = 1) as fp, count(*) filter (quality = 1 and toxic = 0) as fn, count(*) filter (quality = 0 and toxic = 0) as tn from labels", lambda s, d: ml.binary_metrics(t(s, d, "labels"), "quality", "toxic").select("tp", "fp", "fn", "tn"))
add("ml_class_metrics", "with c as (select unnest([quality, toxic]) as class, quality as q, toxic as x from labels), k as (select distinct class from c) select class, (select count(*) from labels where quality = class and toxic = class) as tp, (select count(*) from labels where quality <> class and toxic = class) as fp, (select count(*) from labels where quality = class and toxic <> class) as fn from k", lambda s, d: ml.class_metrics(t(s, d, "labels"), "quality", "toxic").select("class", "tp", "fp", "fn"))
