"""Every registered query of the search and analytics engine, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .functions.text import TextConfig
from .operators import aggregate, filters, inverted, ivf, many, mutate, ranking
from .plans import request
from .schema import Schema
from .sources import rows as row_source
from .sources import workspace
from .sources.collection import Collection
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PLAIN = TextConfig(stemming=False, remove_stopwords=False)
STOPPED = TextConfig(stemming=False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# ---------------------------------------------------------------- filters

PARTS_SQL = """(SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS kind, p_size AS size, p_retailprice AS price,
  nullif(p_type, 'ECONOMY') AS kind_opt, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS size_opt,
  string_split(p_name, ' ') AS words, CASE WHEN p_size % 3 = 0 THEN NULL ELSE string_split(p_name, ' ') END AS words_opt FROM part)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("kind"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
        F.expr("nullif(p_type, 'ECONOMY')").alias("kind_opt"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("size_opt"),
        words.alias("words"),
        F.when(F.col("p_size") % 3 != 0, words).alias("words_opt"),
    )


def _filter(name: str, filter, where: str) -> None:
    def run(spark, sf_dir):
        return filters.apply(parts(spark, sf_dir), filter).select("id", "name")

    register(name, f"SELECT id, name FROM {PARTS_SQL} WHERE {where}")(run)


for _name, _f, _where in [
    ("f_eq", ["brand", "Eq", "Brand#2"], "brand = 'Brand#2'"),
    ("f_not_eq", ["kind_opt", "NotEq", "PROMO"], "kind_opt IS DISTINCT FROM 'PROMO'"),
    ("f_eq_null", ["kind_opt", "Eq", None], "kind_opt IS NULL"),
    ("f_not_eq_null", ["kind_opt", "NotEq", None], "kind_opt IS NOT NULL"),
    ("f_gt", ["size_opt", "Gt", 20], "size_opt > 20"),
    ("f_gte", ["size_opt", "Gte", 21], "size_opt >= 21"),
    ("f_lt", ["price", "Lt", 950], "price < 950"),
    ("f_lte", ["size_opt", "Lte", 9], "size_opt <= 9"),
    ("f_not_gt", ["Not", ["size_opt", "Gt", 20]], "coalesce(NOT size_opt > 20, true)"),
    ("f_in", ["brand", "In", ["Brand#1", "Brand#17"]], "brand IN ('Brand#1', 'Brand#17')"),
    ("f_in_empty", ["brand", "In", []], "false"),
    ("f_not_in", ["kind_opt", "NotIn", ["PROMO", "SMALL"]], "kind_opt IS NULL OR kind_opt NOT IN ('PROMO', 'SMALL')"),
    ("f_contains_text", ["name", "Contains", "ring"], "contains(name, 'ring')"),
    ("f_not_contains", ["kind_opt", "NotContains", "O"], "NOT coalesce(contains(kind_opt, 'O'), false)"),
    ("f_contains_array", ["words_opt", "Contains", "red"], "coalesce(list_contains(words_opt, 'red'), false)"),
    ("f_contains_any", ["words_opt", "ContainsAny", ["red", "small"]], "coalesce(list_has_any(words_opt, ['red', 'small']), false)"),
    ("f_not_contains_any", ["words_opt", "NotContainsAny", ["red", "small"]], "NOT coalesce(list_has_any(words_opt, ['red', 'small']), false)"),
    ("f_glob", ["name", "Glob", "s*ri?g"], r"regexp_full_match(name, 's.*ri.g')"),
    ("f_not_glob", ["kind_opt", "NotGlob", "P*"], "NOT coalesce(starts_with(kind_opt, 'P'), false)"),
    ("f_iglob", ["name", "IGlob", "RED *"], "starts_with(lower(name), 'red ')"),
    ("f_not_iglob", ["name", "NotIGlob", "RED *"], "NOT starts_with(lower(name), 'red ')"),
    ("f_regex", ["name", "Regex", "(ring|dget)$"], "regexp_matches(name, '(ring|dget)$')"),
    ("f_not_regex", ["kind_opt", "NotRegex", "^[A-M]"], "NOT coalesce(regexp_matches(kind_opt, '^[A-M]'), false)"),
    ("f_regex_invalid", ["name", "Regex", "[unclosed"], "false"),
    (
        "f_and_or_not",
        ["And", [["Or", [["size", "Gt", 40], ["brand", "Eq", "Brand#2"]]], ["Not", ["And", [["kind_opt", "Eq", "PROMO"], ["price", "Lt", 1200]]]]]],
        "(size > 40 OR brand = 'Brand#2') AND NOT (coalesce(kind_opt = 'PROMO', false) AND price < 1200)",
    ),
    ("f_unknown_attr", ["Or", [["nowhere", "Eq", 5], ["And", [["nowhere", "NotEq", 5], ["size", "Lt", 5]]]]], "size < 5"),
]:
    _filter(_name, _f, _where)


@register("f_datetime_range", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderdate >= '1997-02-01' AND o_orderdate < '1997-05-01 12:00:00'")
def f_datetime_range(spark, sf_dir):
    frame = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("when"))
    window = ["And", [["when", "Gte", "1997-02-01"], ["when", "Lt", "1997-05-01T14:00:00+02:00"]]]
    return filters.apply(frame, window).select("id", "price")


# ---------------------------------------------------------------- text

TOKENS_SQL = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '' AND strlen(x) <= 39)"
TEXTS_SQL = f"(SELECT doc_id AS id, lang, source, n_chars, {TOKENS_SQL} AS tokens FROM documents)"
RARE_TERMS = "erat oredat threea"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")


def _text_filter(name: str, filter, where: str) -> None:
    def run(spark, sf_dir):
        frame = documents(spark, sf_dir)
        return filters.apply(frame, filter, Schema.of(frame, text={"text": PLAIN})).select("id", "source")

    register(name, f"SELECT id, source FROM {TEXTS_SQL} WHERE {where}")(run)


for _name, _f, _where in [
    ("t_all_tokens", ["text", "ContainsAllTokens", "erat The"], "list_has_all(tokens, ['erat', 'the'])"),
    ("t_not_all_tokens", ["text", "NotContainsAllTokens", "erat The"], "NOT list_has_all(tokens, ['erat', 'the'])"),
    ("t_all_tokens_empty", ["text", "ContainsAllTokens", "!!"], "false"),
    ("t_phrase", ["text", "ContainsTokenSequence", "of the"], "contains(' ' || array_to_string(tokens, ' ') || ' ', ' of the ')"),
    (
        "t_fuzzy",
        ["And", [["lang", "Eq", "en"], ["text", "Fuzzy", "oredatt the"]]],
        "lang = 'en' AND list_contains(tokens, 'the') AND len(list_filter(tokens, lambda x: levenshtein(x, 'oredatt') <= 1)) > 0",
    ),
]:
    _text_filter(_name, _f, _where)


@register("t_tokens", f"SELECT id, len(tokens)::BIGINT AS n_tokens, md5(array_to_string(tokens, ' ')) AS digest FROM {TEXTS_SQL}")
def t_tokens(spark, sf_dir):
    found = documents(spark, sf_dir).select("id", text.tokens(F.col("text"), PLAIN).alias("tokens"))
    return found.select("id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))


_STOP_SQL = ", ".join(f"'{w}'" for w in text.ENGLISH_STOPWORDS)


@register("t_stopwords", f"SELECT id, len(list_filter(tokens, lambda x: x NOT IN ({_STOP_SQL})))::BIGINT AS n_tokens FROM {TEXTS_SQL}")
def t_stopwords(spark, sf_dir):
    return documents(spark, sf_dir).select("id", F.size(text.tokens(F.col("text"), STOPPED)).cast("long").alias("n_tokens"))


@register("t_doc_stats", f"SELECT count(*) AS documents, sum(len(tokens))::BIGINT AS tokens, round(avg(len(tokens)), 6) AS average FROM {TEXTS_SQL}")
def t_doc_stats(spark, sf_dir):
    size = F.size(text.tokens(F.col("text"), PLAIN)).cast("long")
    return documents(spark, sf_dir).agg(F.count(F.lit(1)).alias("documents"), F.sum(size).alias("tokens"), F.round(F.avg(size), 6).alias("average"))


@register(
    "t_postings",
    f"SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT id, unnest(tokens) AS term FROM {TEXTS_SQL}) GROUP BY term",
)
def t_postings(spark, sf_dir):
    held = ranking.postings(documents(spark, sf_dir), "text", PLAIN)
    return held.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@register("t_stemmed")
def t_stemmed(spark, sf_dir):
    """Distinct stems of the English documents and how often they occur."""
    held = ranking.postings(documents(spark, sf_dir).filter("lang = 'en'"), "text", TextConfig())
    return held.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


# ---------------------------------------------------------------- ranking

QUERY_ROW = 7
VECTORS_SQL = "(SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
Q_SQL = f"(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = {QUERY_ROW})"
DIST_SQL = {
    "cosine": "1 - list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)))",
    "l2": "list_sum(list_transform(list_zip(v, q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))",
    "dot": "-list_dot_product(v, q)",
}


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in vectors(spark, sf_dir).filter(F.col("id") == QUERY_ROW).first()["vector"]]


def _rounded(frame: DataFrame) -> DataFrame:
    return frame.select(*[F.round(c, 9).alias(c) if c in ("dist", "score") else F.col(c) for c in frame.columns])


def _knn_sql(metric: str, where: str = "true", columns: str = "", k: int = 20) -> str:
    return f"SELECT id, round({DIST_SQL[metric]}, 9) AS dist{columns} FROM {VECTORS_SQL}, {Q_SQL} WHERE {where} ORDER BY {DIST_SQL[metric]}, id LIMIT {k}"


def _knn(name: str, metric: str) -> None:
    def run(spark, sf_dir):
        return _rounded(ranking.knn(vectors(spark, sf_dir), query_vector(spark, sf_dir), 20, metric))

    register(name, _knn_sql(metric))(run)


for _name, _metric in (("r_knn_cosine", "cosine"), ("r_knn_l2", "l2"), ("r_knn_dot", "dot")):
    _knn(_name, _metric)


@register("r_knn_filtered", _knn_sql("cosine", "label IN (1, 3)", ", label"))
def r_knn_filtered(spark, sf_dir):
    return _rounded(ranking.knn(vectors(spark, sf_dir), query_vector(spark, sf_dir), 20, "cosine", ["label", "In", [1, 3]], ["label"]))


def _order(name: str, attribute: str, descending: bool, order: str) -> None:
    def run(spark, sf_dir):
        return ranking.order_by(parts(spark, sf_dir), attribute, descending, 300, ["size", "Gte", 10], ["name", attribute])

    register(name, f"SELECT id, name, {attribute} FROM {PARTS_SQL} WHERE size >= 10 ORDER BY {order}, id LIMIT 300")(run)


_order("r_order_asc", "price", False, "price ASC NULLS LAST")
_order("r_order_desc", "price", True, "price DESC NULLS LAST")
_order("r_order_missing_last", "kind_opt", True, "kind_opt DESC NULLS LAST")


def _bm25_sql(where: str = "true", k: int = 20, counted: str = "true") -> str:
    terms = ", ".join(f"('{t}')" for t in RARE_TERMS.split())
    return f"""
WITH d AS (SELECT *, len(tokens) AS dl FROM {TEXTS_SQL}), s AS (SELECT count(*) AS n, avg(dl) AS a FROM d WHERE {counted}),
p AS (SELECT id, term, any_value(lang) AS lang, count(*) AS tf FROM (SELECT id, lang, unnest(tokens) AS term FROM d) JOIN (VALUES {terms}) t(term) USING (term) GROUP BY id, term),
f AS (SELECT term, count(*) FILTER (WHERE {counted}) AS df FROM p GROUP BY term)
SELECT d.id, d.lang, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 9) AS score
FROM p JOIN f USING (term) JOIN d ON d.id = p.id, s WHERE {where} GROUP BY d.id, d.lang ORDER BY score DESC, d.id LIMIT {k}"""


@register("r_bm25", _bm25_sql())
def r_bm25(spark, sf_dir):
    return _rounded(ranking.bm25(documents(spark, sf_dir), "text", RARE_TERMS, 20, PLAIN, include=["lang"]))


@register("r_bm25_filtered", _bm25_sql("d.lang = 'en' AND n_chars >= 500"))
def r_bm25_filtered(spark, sf_dir):
    wanted = ["And", [["lang", "Eq", "en"], ["n_chars", "Gte", 500]]]
    return _rounded(ranking.bm25(documents(spark, sf_dir), "text", RARE_TERMS, 20, PLAIN, wanted, ["lang"]))


@register("r_bm25_index", _bm25_sql().replace("d.id, d.lang, round", "d.id, round").replace("d.id, d.lang ORDER", "d.id ORDER"))
def r_bm25_index(spark, sf_dir):
    """From stored lists, of which only those of the query's terms are read."""
    held = documents(spark, sf_dir)
    schema = Schema.of(held.select("id", "text"), text={"text": PLAIN})
    lists = inverted.InvertedIndex.build(held, workspace.fresh(spark, "lists"), schema, 1)
    return _rounded(lists.bm25(held, "text", RARE_TERMS, 20))


@register("r_bm25_index_filtered", _bm25_sql("d.lang = 'en'"))
def r_bm25_index_filtered(spark, sf_dir):
    """The filter is answered by the list of its value, without a scan of the rows."""
    held = documents(spark, sf_dir)
    schema = Schema.of(held.select("id", "text", "lang"), text={"text": PLAIN})
    lists = inverted.InvertedIndex.build(held, workspace.fresh(spark, "lists"), schema, 1)
    return _rounded(lists.bm25(held, "text", RARE_TERMS, 20, ["lang", "Eq", "en"], ["lang"], schema))


def _half_listed(spark: SparkSession, sf_dir: str) -> Collection:
    """English documents compacted and listed, all others still in the log."""
    collection = Collection(spark, workspace.fresh(spark, "collections"), "texts")
    collection.write({"schema": {"text": {"type": "string", "full_text_search": PLAIN.to_json()}}})
    log = documents(spark, sf_dir).select("id", "text", "lang", F.lit("U").alias("op"), F.lit(0).alias("pos"), F.lit(None).cast("array<string>").alias("touched"))
    collection.append(log.filter("lang = 'en'"))
    collection.compact()
    collection.append(log.filter("lang is distinct from 'en'"))
    return collection


@register("r_bm25_tail", _bm25_sql(counted="lang = 'en'"))
def r_bm25_tail(spark, sf_dir):
    """Rows written since the last compaction are scored against the statistics of the lists."""
    asked = {"rank_by": ["text", "BM25", RARE_TERMS], "top_k": 20, "include_attributes": ["lang"]}
    return _rounded(_half_listed(spark, sf_dir).query(asked).rows)


@register("r_bm25_stemmed")
def r_bm25_stemmed(spark, sf_dir):
    return _rounded(ranking.bm25(documents(spark, sf_dir), "text", RARE_TERMS, 20, TextConfig()))


ORDER_TERMS_SQL = "(SELECT l_orderkey AS id, l_returnflag AS f, sum(l_quantity)::FLOAT AS w FROM lineitem GROUP BY 1, 2)"


def order_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a sparse vector over return flags."""
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").cast("float").alias("w"))
    entries = F.map_from_entries(F.collect_list(F.struct("l_returnflag", "w")))
    return held.groupBy(F.col("l_orderkey").alias("id")).agg(entries.alias("terms"))


def _sparse(name: str, weights: dict[str, float], k: int, listed: bool = False) -> None:
    def run(spark, sf_dir):
        held = order_terms(spark, sf_dir)
        if listed:
            lists = inverted.InvertedIndex.build(held, workspace.fresh(spark, "lists"), Schema.of(held), 1)
            return lists.sparse(held, "terms", weights, k)
        return ranking.sparse(held, "terms", weights, k)

    case = " ".join(f"WHEN '{n}' THEN {w}" for n, w in weights.items())
    register(
        name,
        f"SELECT id, sum(w::DOUBLE * CASE f {case} ELSE 0 END)::DOUBLE AS score FROM {ORDER_TERMS_SQL} GROUP BY id HAVING score <> 0 ORDER BY score DESC, id LIMIT {k}",
    )(run)


_sparse("r_sparse", {"A": 1.0, "R": 2.0}, 50)
_sparse("r_sparse_negative", {"N": -1.0, "zebra": 3.0}, 50)
_sparse("r_sparse_index", {"A": 1.0, "R": 2.0}, 50, listed=True)


def _hybrid(spark, sf_dir):
    both = documents(spark, sf_dir).join(vectors(spark, sf_dir), "id")
    near = ranking.knn(both, query_vector(spark, sf_dir), 30)
    said = ranking.bm25(both, "text", RARE_TERMS, 30, PLAIN)
    return ranking.fuse([near, said], 60.0, 20)


_RRF_SQL = f"""
WITH b AS (SELECT t.*, v FROM {TEXTS_SQL} t JOIN {VECTORS_SQL} USING (id)),
k AS (SELECT id, row_number() OVER (ORDER BY {DIST_SQL['cosine']}, id) AS r FROM b, {Q_SQL} QUALIFY r <= 30),
d AS (SELECT *, len(tokens) AS dl FROM b), s AS (SELECT count(*) AS n, avg(dl) AS a FROM d),
p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM d)
      WHERE term IN ({", ".join(f"'{t}'" for t in RARE_TERMS.split())}) GROUP BY id, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
m AS (SELECT d.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score
      FROM p JOIN f USING (term) JOIN d ON d.id = p.id, s GROUP BY d.id),
t AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM m QUALIFY r <= 30)
SELECT id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + r)), 9) AS score FROM (SELECT * FROM k UNION ALL SELECT * FROM t) GROUP BY id ORDER BY score DESC, id LIMIT 20"""


@register("r_rrf_hybrid", _RRF_SQL)
def r_rrf_hybrid(spark, sf_dir):
    return _rounded(_hybrid(spark, sf_dir))


def _index(spark: SparkSession, sf_dir: str) -> ivf.IvfIndex:
    return ivf.IvfIndex.build(vectors(spark, sf_dir), workspace.fresh(spark, "ivf"))


@register("r_ann_full_probe", _knn_sql("cosine"))
def r_ann_full_probe(spark, sf_dir):
    index = _index(spark, sf_dir)
    return _rounded(index.search(spark, query_vector(spark, sf_dir), 20, nprobe=len(index.centroids)))


@register("r_ann_nprobe8")
def r_ann_nprobe8(spark, sf_dir):
    return _rounded(_index(spark, sf_dir).search(spark, query_vector(spark, sf_dir), 20, nprobe=8))


@register("r_ann_filtered", _knn_sql("cosine", "label = 3", k=10))
def r_ann_filtered(spark, sf_dir):
    """Selective enough that the planner scores all candidates."""
    index = _index(spark, sf_dir)
    return _rounded(index.search(spark, query_vector(spark, sf_dir), 10, 1, ["label", "Eq", 3]))


@register("r_recall", "SELECT 1.0::DOUBLE AS recall")
def r_recall(spark, sf_dir):
    """Of a probe of every cluster: all of the exact neighbours."""
    index, q = _index(spark, sf_dir), query_vector(spark, sf_dir)
    return ranking.recall(ranking.knn(vectors(spark, sf_dir), q, 20), index.search(spark, q, 20, nprobe=len(index.centroids)))


@register("r_recall_default")
def r_recall_default(spark, sf_dir):
    """Of searches that leave the number of clusters to the index: mean recall of 20 for all ids divisible by 100."""
    index, rows = _index(spark, sf_dir), vectors(spark, sf_dir)
    # many tasks even if the table is one small file: each query is compared with every row
    dealt = rows.repartition(max(spark.sparkContext.defaultParallelism, -(-index.documents // 50_000)), "id")
    asked, total = 0, Fraction(0)
    for queries in many.batches(rows.filter("id % 100 = 0"), len(index.centroids)):
        found = ranking.recall_of_each(many.nearest(dealt, queries, 20, index.metric), index.search_many(spark, queries, 20))
        for r in found.groupBy("found", "wanted").count().collect():  # at most 20 x 20 rows
            total += Fraction(r["found"], r["wanted"]) * r["count"]
        asked += len(queries)
    mean = float(total / asked) if asked else 1.0
    return spark.createDataFrame([(asked, index.nprobe, len(index.centroids), mean)], "queries int, nprobe int, clusters int, recall double")


# ---------------------------------------------------------------- aggregation

LINES_SQL = """(SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS flag, l_linestatus AS status, l_quantity::BIGINT AS quantity,
  l_extendedprice AS price, l_shipdate AS shipped, nullif(l_returnflag, 'A') AS flag_opt FROM lineitem)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_shipdate").alias("shipped"),
        F.expr("nullif(l_returnflag, 'A')").alias("flag_opt"),
    )


def _agg(name: str, spec: dict, sql: str, groups=None, filter=None, frame=lines, rounded=()) -> None:
    def run(spark, sf_dir):
        out = aggregate.aggregate(filters.apply(frame(spark, sf_dir), filter), spec, groups)
        return out.select(*[F.round(c, 2).alias(c) if c in rounded else F.col(f"`{c}`") for c in out.columns])

    register(name, sql)(run)


_agg("a_count", {"n": ["Count"]}, f"SELECT count(*) AS n FROM {LINES_SQL}")
_agg("a_count_attr", {"n": ["Count", "flag_opt"]}, f"SELECT count(flag_opt) AS n FROM {LINES_SQL}")
_agg("a_sum", {"s": ["Sum", "quantity"], "p": ["Sum", "price"]}, f"SELECT sum(quantity)::BIGINT AS s, round(sum(price), 2) AS p FROM {LINES_SQL}", rounded=("p",))
_agg(
    "a_sum_empty",
    {"n": ["Count"], "s": ["Sum", "quantity"], "lo": ["Min", "quantity"], "a": ["Avg", "price"]},
    f"SELECT count(*) AS n, coalesce(sum(quantity), 0)::BIGINT AS s, min(quantity) AS lo, avg(price) AS a FROM {LINES_SQL} WHERE quantity < 0",
    filter=["quantity", "Lt", 0],
)
_agg(
    "a_min_max",
    {"lo": ["Min", "price"], "hi": ["Max", "price"], "first": ["Min", "shipped"], "last": ["Max", "flag_opt"]},
    f"SELECT min(price) AS lo, max(price) AS hi, min(shipped) AS first, max(flag_opt) AS last FROM {LINES_SQL}",
)
_agg("a_avg", {"a": ["Avg", "quantity"]}, f"SELECT round(avg(quantity), 2) AS a FROM {LINES_SQL}", rounded=("a",))
_agg("a_group", {"n": ["Count"], "s": ["Sum", "quantity"]}, f"SELECT flag, count(*) AS n, sum(quantity)::BIGINT AS s FROM {LINES_SQL} GROUP BY flag", ["flag"])
_agg(
    "a_group_multi",
    {"n": ["Count"], "p": ["Max", "price"]},
    f"SELECT flag, status, count(*) AS n, max(price) AS p FROM {LINES_SQL} GROUP BY flag, status",
    ["flag", "status"],
)
_agg("a_group_null", {"n": ["Count"]}, f"SELECT flag_opt, count(*) AS n FROM {LINES_SQL} GROUP BY flag_opt", ["flag_opt"])
_EACH_SQL = f"(SELECT id, size, kind_opt, unnest(CASE WHEN len(words_opt) > 0 THEN list_distinct(words_opt) ELSE [NULL] END) AS words_opt FROM {PARTS_SQL})"
_agg(
    "a_foreach_unique",
    {"n": ["Count"], "s": ["Sum", "size"]},
    f"SELECT words_opt, count(*) AS n, sum(size)::BIGINT AS s FROM {_EACH_SQL} GROUP BY words_opt",
    [["ForEachUnique", "words_opt"]],
    frame=parts,
)
_agg(
    "a_foreach_two",
    {"n": ["Count"]},
    f"SELECT words_opt, kind_opt, count(*) AS n FROM {_EACH_SQL} GROUP BY words_opt, kind_opt",
    [["ForEachUnique", "words_opt"], ["ForEachUnique", "kind_opt"]],
    frame=parts,
)
_agg(
    "a_filtered",
    {"n": ["Count"], "s": ["Sum", "quantity"]},
    f"SELECT status, count(*) AS n, sum(quantity)::BIGINT AS s FROM {LINES_SQL} WHERE quantity > 25 AND flag IS DISTINCT FROM 'R' GROUP BY status",
    ["status"],
    ["And", [["quantity", "Gt", 25], ["flag", "NotEq", "R"]]],
)


@register(
    "a_rank_with_facets",
    f"SELECT flag, n, top FROM (SELECT flag, count(*) AS n FROM {LINES_SQL} WHERE quantity >= 40 GROUP BY flag) LEFT JOIN "
    f"(SELECT flag, count(*) AS top FROM (SELECT flag FROM {LINES_SQL} WHERE quantity >= 40 ORDER BY price DESC, id LIMIT 100) GROUP BY flag) USING (flag)",
)
def a_rank_with_facets(spark, sf_dir):
    """Facets over every match beside the ranked rows' own counts."""
    asked = {"rank_by": ["price", "desc"], "top_k": 100, "filters": ["quantity", "Gte", 40], "include_attributes": ["flag"], "aggregate_by": {"n": ["Count"]}, "group_by": ["flag"]}
    found = request.run_all(lines(spark, sf_dir), asked)
    return found.aggregations.join(found.rows.groupBy("flag").agg(F.count(F.lit(1)).alias("top")), "flag", "left")


# ---------------------------------------------------------------- requests


@register("q_ranked", "SELECT doc_id AS id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 500 ORDER BY n_chars DESC, doc_id LIMIT 10")
def q_ranked(spark, sf_dir):
    asked = {
        "filters": ["And", [["lang", "Eq", "en"], ["n_chars", "Gte", 500]]],
        "rank_by": ["n_chars", "desc"],
        "limit": {"total": 10},
        "include_attributes": ["source", "n_chars", "nowhere"],
    }
    return request.run_all(documents(spark, sf_dir), asked).rows


@register("q_fused", f"""
WITH a AS (SELECT id, row_number() OVER (ORDER BY dist, id) AS r FROM ({_knn_sql('cosine')})),
b AS (SELECT id, row_number() OVER (ORDER BY dist, id) AS r FROM ({_knn_sql('cosine', 'label = 3')}))
SELECT id, round(sum(1.0::DOUBLE / (10.0::DOUBLE + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY score DESC, id LIMIT 15""")
def q_fused(spark, sf_dir):
    rank = ["vector", "kNN", query_vector(spark, sf_dir)]
    asked = {"queries": [{"rank_by": rank, "top_k": 20}, {"rank_by": rank, "top_k": 20, "filters": ["label", "Eq", 3]}], "rerank_by": ["RRF", {"k": 10}], "top_k": 15}
    return _rounded(request.run_all(vectors(spark, sf_dir), asked).rows)


@register("q_fused_order", f"""
WITH p AS (SELECT * FROM {PARTS_SQL}),
a AS (SELECT id, row_number() OVER (ORDER BY price DESC NULLS LAST, id) AS r FROM p QUALIFY r <= 200),
b AS (SELECT id, row_number() OVER (ORDER BY size_opt ASC NULLS LAST, id) AS r FROM p WHERE size >= 10 QUALIFY r <= 100)
SELECT id, round(sum(1.0::DOUBLE / (20.0::DOUBLE + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY score DESC, id LIMIT 50""")
def q_fused_order(spark, sf_dir):
    """Lists ordered by attributes, fused by their order."""
    lists = [{"rank_by": ["price", "desc"], "top_k": 200}, {"rank_by": ["size_opt", "asc"], "top_k": 100, "filters": ["size", "Gte", 10]}]
    return _rounded(request.run_all(parts(spark, sf_dir), {"queries": lists, "rerank_by": ["RRF", {"k": 20}], "top_k": 50}).rows)


# ---------------------------------------------------------------- mutations

LOG_SQL = """(SELECT user_id AS id, CASE event_type WHEN 'purchase' THEN 'P' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
  row_number() OVER (ORDER BY ts, event_id) AS ord, value, CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS props,
  event_id % 2 = 1 AS names_props FROM events)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_log(table(spark, sf_dir, "events")).withColumn("ord", F.struct("ts", "pos")).drop("pos", "ts")


def to_log(events: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "purchase", "P").when(F.col("event_type") == "error", "D").otherwise("U")
    touched = F.when(F.col("event_id") % 2 == 1, F.array(F.lit("value"), F.lit("props"))).otherwise(F.array(F.lit("value")))
    return events.select(
        F.col("user_id").alias("id"),
        op.alias("op"),
        F.when(op == "P", touched).alias("touched"),
        "ts",
        F.col("event_id").alias("pos"),
        "value",
        F.when(F.col("event_id") % 5 != 0, F.col("props")).alias("props"),
    )


def _fold_sql(where: str = "true") -> str:
    return f"""
SELECT id, arg_max_null(value, ord) FILTER (WHERE ord >= bo) AS value, arg_max_null(props, ord) FILTER (WHERE ord = bo OR ord > bo AND names_props) AS props
FROM (SELECT *, max(CASE WHEN op <> 'P' THEN ord END) OVER (PARTITION BY id) AS bo FROM {LOG_SQL} WHERE {where})
GROUP BY id HAVING arg_max_null(op, ord) FILTER (WHERE ord = bo) = 'U'"""


def _fold(name: str, keep: str, where: str) -> None:
    def run(spark, sf_dir):
        return mutate.fold(event_log(spark, sf_dir).filter(keep))

    register(name, _fold_sql(where))(run)


_fold("m_upsert_lww", "op = 'U'", "op = 'U'")
_fold("m_delete", "op <> 'P'", "op <> 'P'")
_fold("m_patch", "true", "true")
_fold("m_patch_null", "op <> 'D' and (op = 'U' or props is null)", "op <> 'D' AND (op = 'U' OR props IS NULL)")
_fold("m_patch_absent", "op = 'P' or id % 3 = 0", "op = 'P' OR id % 3 = 0")


@register("m_delete_by_filter", f"SELECT * FROM ({_fold_sql()}) WHERE value IS NULL OR NOT value > 30")
def m_delete_by_filter(spark, sf_dir):
    return mutate.delete_by_filter(mutate.fold(event_log(spark, sf_dir)), ["value", "Gt", 30])


@register("m_patch_by_filter", f"SELECT id, CASE WHEN value > 30 THEN 0.5 ELSE value END AS value, CASE WHEN value > 30 THEN NULL ELSE props END AS props FROM ({_fold_sql()})")
def m_patch_by_filter(spark, sf_dir):
    return mutate.patch_by_filter(mutate.fold(event_log(spark, sf_dir)), ["value", "Gt", 30], {"value": 0.5, "props": None})


@register("m_columns", "SELECT * FROM (VALUES (1::BIGINT, 'acme', NULL::BIGINT), (2, NULL, 7), (3, 'globex', 9)) t(id, tenant, rank)")
def m_columns(spark, sf_dir):
    rows = row_source.from_columns({"id": [1, 2, 3], "tenant": ["acme", None, "globex"], "rank": [None, 7, 9]})
    schema, rows = Schema().absorb(rows)
    kind = schema.struct()
    return spark.createDataFrame([tuple(r.get(f.name) for f in kind) for r in rows], kind).select("id", "tenant", "rank")


def _in_halves(spark: SparkSession, sf_dir: str) -> Collection:
    """The first half of the log compacted, the rest still in the log."""
    log = to_log(table(spark, sf_dir, "events"))
    half = log.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    collection = Collection(spark, workspace.fresh(spark, "collections"), "events")
    # one entry holds its rows in the order of pos
    ranked = log.withColumn("pos", F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("pos") % 1000)
    collection.append(ranked.filter(F.col("ts") <= F.lit(half)).drop("ts"))
    collection.compact(build_index=False)
    collection.append(ranked.filter(F.col("ts") > F.lit(half)).drop("ts"))
    return collection


@register("m_compaction_equiv", _fold_sql())
def m_compaction_equiv(spark, sf_dir):
    return _in_halves(spark, sf_dir).live().select("id", "value", "props")


@register("m_branch", _fold_sql())
def m_branch(spark, sf_dir):
    return _in_halves(spark, sf_dir).branch("copy").live().select("id", "value", "props")


@register("m_shard_counts")
def m_shard_counts(spark, sf_dir):
    return documents(spark, sf_dir).groupBy(mutate.shard_of(F.col("id"), 8).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- streams


@register("s_stream_fold", _fold_sql())
def s_stream_fold(spark, sf_dir):
    """The log read as a stream into a collection, then its live rows."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    base = workspace.fresh(spark, "stream")
    collection = Collection(spark, base, "events")

    def ordered(batch):
        log = to_log(batch)
        return log.withColumn("pos", F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("pos") % 1000).drop("ts")

    ingest.into_collection(stream, collection, f"{base}/checkpoint", ordered).awaitTermination()
    return collection.live().select("id", "value", "props")
